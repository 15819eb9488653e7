"""Operator 8, MinHash near-dedup: fixed bands, and a chosen-path set similarity join inside large ones.

Every tree sends a document down paths of minwise shingles: the node a document reaches names the least shingles of
its set under the orderings of its levels. Documents of Jaccard similarity s stay together for a level with
probability s; those that share nothing part at once. The first two levels of all trees come with the signature and are
grouped by Spark; they are MinHash bands, tree t taking orderings t and 16 + t whatever the path. A node that is still
large branches on, in its task, by orderings that its path chooses, several at a time, as long as that lessens the
pairs. Small nodes, and those that do not thin out, are compared exhaustively by signature. With 16
trees of two levels a pair of similarity 0.75 is missed with probability (1 - 0.75**2)**16 < 2e-6.

What the trees link is a superset of candidates. Its connected parts ("clusters") are checked on full shingle sets, in
blocks of bounded size, and only links of the stated similarity make components. A cluster larger than a block is
checked in three rounds: within its blocks; between one document for each part that was found; and, where it still has
several parts, all documents outside the largest part against all others, which loses no link. Equal sets are one class
from the start, so copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import _repeats as R
from lexloom.llm._tables import stored
from lexloom.llm.components import connected_components

U = np.uint64
SHINGLE, TREES, LEVELS, ORDERINGS = 5, 16, 2, 64
PERCENT = 75
#: Of 64 orderings, those in which a pair must agree to be a candidate: 5.8 standard deviations under 0.75.
AGREE = 28
LARGE, BRANCHES, DEPTH = 256, 4, 8
BLOCK = 250  # documents of one side whose sets are compared in one task
BLOCK_SHINGLES = 4_000_000  # and their shingles, about
#: Bits of the filter that texts pass before they are joined with the documents to compare: CHUNKS maps of 4096 bytes, 8 MB
#: at any size of the table. It lets some others through (all of them far beyond BITS documents); the join settles it.
CHUNKS, CHUNK_BITS = 2048, 32_768
BITS = CHUNKS * CHUNK_BITS
_RNG = np.random.default_rng(5)
_MULTIPLY = _RNG.integers(0, 2**63, ORDERINGS, dtype=np.uint64) * U(2) + U(1)
_FLIP = _RNG.integers(0, 2**63, ORDERINGS, dtype=np.uint64)
SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print_a", pa.int64()), ("print_b", pa.int64()), ("nodes", pa.list_(pa.int64())), ("signature", pa.binary())])
SKETCH_DDL = "doc_id long, n_shingles long, print_a long, print_b long, nodes array<long>, signature binary"
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
EDGE_DDL = "u long, v long"


def shingles(text: bytes, power: R.Powers) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles (A-Z lower-cased, ASCII-whitespace words)."""
    ids = R.Words.measured(text.lower(), power)[0]
    n = len(ids)
    if not n:
        return np.empty(0, U)
    k = min(n, SHINGLE)
    power.to(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(ids * power.down[:n], out=sums[1:])
    return np.unique(R.mixed((sums[k:] - sums[:-k]) * power.up[: n - k + 1] + U(k)))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, print_a, print_b, nodes, signature): what of a document goes on; about 200 bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = R.Powers()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py() or b"", power)
                if not len(s):
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                least = np.full(ORDERINGS, 2**64 - 1, U)
                for lo in range(0, len(s), 2048):
                    np.minimum(least, ((s[lo : lo + 2048, None] ^ _FLIP) * _MULTIPLY).min(0), out=least)
                path = np.zeros(TREES, U)
                for level in range(LEVELS):
                    path = R.mixed(path * U(0x9E3779B97F4A7C15) + least[level * TREES : (level + 1) * TREES])
                path = R.mixed(path + np.arange(TREES, dtype=U))
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                a, b = np.array([whole >> 64, whole & (2**64 - 1)], U).view(np.int64).tolist()
                rows.append((doc_id, len(s), a, b, path.view(np.int64).tolist(), (R.mixed(least) >> U(56)).astype(np.uint8).tobytes()))
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], schema=SKETCH)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, SKETCH_DDL)


class Parts:
    """Disjoint sets of 0..n-1; the root is the least index."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def compare(sig: np.ndarray, which: np.ndarray, parts: Parts) -> None:
    """Join all pairs of ``which`` that agree in enough orderings."""
    m = sig[which]
    step = max(1, 200_000 // len(which))
    for lo in range(0, len(which), step):
        agree = (m[lo : lo + step, None, :] == m[None, lo:, :]).sum(2, dtype=np.uint8) >= AGREE
        for i, j in zip(*np.nonzero(np.triu(agree, 1))):
            parts.join(int(which[lo + i]), int(which[lo + j]))


def branch(sig: np.ndarray, which: np.ndarray, parts: Parts, path: int, depth: int = 0) -> None:
    """Compare a node, or send it down the branches that its path chooses."""
    if len(which) <= LARGE or depth == DEPTH:
        return compare(sig, which, parts)
    children = []
    for k in np.random.default_rng(path).choice(ORDERINGS, BRANCHES, replace=False):
        order = np.argsort(sig[which, k], kind="stable")
        values = sig[which[order], k]
        children += [(int(k) * 256 + int(values[x[0]]), which[order[x]]) for x in np.split(np.arange(len(which)), np.flatnonzero(np.diff(values)) + 1) if len(x) > 1]
    if sum(len(c) ** 2 for _, c in children) > 0.5 * len(which) ** 2:  # alike throughout: branching doesn't lessen the pairs
        return compare(sig, which, parts)
    for name, c in children:
        branch(sig, c, parts, (path * 1_000_003 + name) % (1 << 61), depth + 1)


def candidate_links(classes: DataFrame) -> DataFrame:
    """(u, v): stars over the parts of each node; classes: rep, nodes, signature."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(node: np.ndarray, rep: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
            cut = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            good = two[(sig[two] == sig[two + 1]).sum(1) >= AGREE]
            u, v = [np.maximum(rep[good], rep[good + 1])], [np.minimum(rep[good], rep[good + 1])]
            for lo, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
                parts = Parts(n)
                ids = rep[lo : lo + n]
                branch(sig[lo : lo + n], np.arange(n), parts, int(node[lo]) & (2**61 - 1))
                roots = np.array([parts.root(i) for i in range(n)])
                u.append(ids[roots != np.arange(n)])
                v.append(ids[roots[roots != np.arange(n)]])
            u, v = np.concatenate(u), np.concatenate(v)
            return pa.record_batch([np.maximum(u, v), np.minimum(u, v)], schema=EDGE)

        held: list[pa.RecordBatch] = []  # rows of the last node met, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            start = int(np.searchsorted(node == node[-1], True)) if node[0] != node[-1] else 0
            if start == 0 and held and held[-1].column(0)[-1].as_py() != node[0]:
                done, held = held, [batch]
            elif start == 0:
                held.append(batch)
                continue
            else:
                done, held = [*held, batch.slice(0, start)], [batch.slice(start)]
            yield solve(*_arrays(done))
        if held:
            yield solve(*_arrays(held))

    rows = classes.select(F.explode("nodes").alias("node"), "rep", "signature")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(stream, EDGE_DDL)


def _arrays(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    sig = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(-1, ORDERINGS)
    return table.column(0).to_numpy(), table.column(1).to_numpy(), sig


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars over the parts that links connect within each (component, a, b) of rows sorted by it: (.., part, doc_id, text).

    Links are tested on full shingle sets. Documents of one part, which is named by one of them, are known to be connected;
    links that would connect nothing new are not looked for.
    """
    power = R.Powers()

    def solve(rows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        rows.sort(key=lambda x: (len(x[2]), x[1]))
        parts = Parts(len(rows))
        known: dict[int, int] = {}
        for i, (part, *_) in enumerate(rows):
            parts.join(known.setdefault(part, i), i)
        # documents in order of size; a link needs a common shingle among the first quarter (and one) of each,
        # in one order of all shingles
        index: dict[int, list[int]] = {}
        left = len(known)
        for j, (_, _, s) in enumerate(rows):
            head = s[: len(s) - (PERCENT * len(s) + 99) // 100 + 1].tolist()
            met = np.unique(np.array([i for h in head for i in index.get(h, ())], int))
            for i in met[::-1].tolist() if left > 1 else ():
                other = rows[i][2]
                if parts.root(i) != parts.root(j) and 100 * len(other) >= PERCENT * len(s) and linked(other, s):
                    parts.join(i, j)
                    left -= 1
            for h in head:
                index.setdefault(h, []).append(j)
        least: dict[int, int] = {}
        for part, i in known.items():
            least[parts.root(i)] = min(part, least.get(parts.root(i), part))
        return [(part, least[parts.root(i)]) for part, i in known.items() if least[parts.root(i)] != part]

    key, rows, out = None, [], []
    for batch in batches:
        for *at, part, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if at != key:
                out += solve(rows) if len(rows) > 1 else []
                key, rows = at, []
            rows.append((part, doc_id, shingles(text, power)))
        if len(out) > 10_000:
            yield pa.record_batch([list(c) for c in zip(*out)], schema=EDGE)
            out = []
    out += solve(rows) if len(rows) > 1 else []
    if out:
        yield pa.record_batch([list(c) for c in zip(*out)], schema=EDGE)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


def _likely(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id may be a node of ``ids``, and few others, without a shuffle of the texts."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    dealt = ids.select(place("node").alias("place")).select(F.expr(f"place div {CHUNK_BITS}").alias("chunk"), (F.col("place") % CHUNK_BITS).alias("at"))
    # ids are dealt by chunk before they become maps, so that no task sends maps of its own for all chunks
    maps = dealt.repartition("chunk").groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("bits"))
    hit = F.expr(f"shiftright(cast(conv(hex(substring(bits, cast(place % {CHUNK_BITS} div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) & 1 = 1")
    placed = texts.withColumn("place", place("doc_id")).withColumn("chunk", F.expr(f"place div {CHUNK_BITS}"))
    return placed.join(F.broadcast(maps), "chunk").where(hit).select(*texts.columns)


def _compared(docs: DataFrame, dealt: DataFrame, label: str) -> DataFrame:
    """Links among the documents of each (component, a, b). dealt: component, a, b, part, node."""
    dealt = stored(dealt, f"{label}-dealt")
    texts = _likely(docs.select("doc_id", F.col("text").cast("binary").alias("text")), dealt)
    rows = dealt.join(texts, F.col("node") == F.col("doc_id")).select("component", "a", "b", "part", "doc_id", "text")
    return stored(rows.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b").mapInArrow(verified, EDGE_DDL), f"{label}-links")


def _blocks(of: DataFrame, *by: str) -> DataFrame:
    """(by, blocks): how many blocks hold the documents ``of`` (by, n) in bounded memory."""
    size = of.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    return size.select(*by, F.ceil(F.greatest(F.col("docs") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def cluster_links(docs: DataFrame, clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """(u, v): links on full sets that connect what is connected. clusters: node, component; sizes: node, n (shingles)."""
    sized = stored(clusters.join(sizes, "node"), "clusters")
    blocks = stored(_blocks(sized, "component"), "blocks")
    own = sized.join(blocks, "component").select("component", "node", "n", "blocks", _block("blocks").alias("a"))
    links = _compared(docs, own.select("component", "a", F.col("a").alias("b"), F.col("node").alias("part"), "node"), "inner")
    if blocks.where("blocks > 1").isEmpty():
        return links
    # a document has one block, so the stars of the blocks are parts; their centres, and documents alone, stand for them
    large = stored(sized.join(blocks.where("blocks > 1"), "component").join(links.withColumnRenamed("u", "node"), "node", "left").select("component", "node", "n", F.coalesce("v", "node").alias("head")), "large")
    heads = large.where("head = node")
    several = heads.join(_blocks(heads, "component"), "component")
    between = _compared(docs, several.select("component", _block("blocks").alias("a"), F.lit(-1).alias("b"), F.col("node").alias("part"), "node"), "heads")
    links = links.unionByName(between)
    # where a cluster still has several parts, those outside the largest are compared with everything
    split = stored(large.join(between.withColumnRenamed("u", "head"), "head", "left").select("component", "node", "n", F.coalesce("v", "head").alias("part")), "split")
    of_part = split.groupBy("component", "part").agg(F.count(F.lit(1)).alias("c"))
    main = stored(of_part.groupBy("component").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"), "main")
    if main.isEmpty():
        return links
    sides = split.join(main, "component").withColumn("inside", F.col("part") == F.col("main")).drop("main")
    counts = _blocks(sides, "component", "inside").groupBy("component").agg(F.max(F.when(F.col("inside"), F.col("blocks"))).alias("ins"), F.max(F.when(~F.col("inside"), F.col("blocks"))).alias("outs"))
    sides = sides.join(stored(counts, "counts"), "component")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ["component", "a", "b", "part", "node"]
    inner = sides.where("inside").select("component", "part", "node", _block("ins").alias("a"), every("outs").alias("c")).withColumn("b", -1 - F.col("c"))
    outer = sides.where("not inside").withColumn("own", _block("outs"))
    dealt = inner.select(*row).unionByName(outer.select("component", "part", "node", every("ins").alias("a"), (-1 - F.col("own")).alias("b")).select(*row))
    dealt = dealt.unionByName(outer.select("component", "part", "node", "own", every("outs").alias("c")).select("component", "part", "node", F.least("own", "c").alias("a"), F.greatest("own", "c").alias("b")).select(*row))
    return links.unionByName(_compared(docs, dealt, "outer"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """Link documents whose sets of 5-word shingles have Jaccard similarity of 0.75 or more; one of a group stays.

    docs: doc_id, text and any other columns, which are ignored. Returns doc_id, n_shingles, component_id (smallest
    doc_id reachable by links), kept (doc_id = component_id), one row per input row.

    A text of fewer than five words is one shingle; null, empty and blank texts have none and are linked with
    nothing. Rows without a doc_id are linked with nothing, their component_id is null, and they are kept. Rows that
    repeat a doc_id are all returned, those with one text alike; with several texts, each is linked by its own set, and
    all stand under the one id. An empty table gives an empty result. Texts of any length are read whole; a task holds
    the sets of two blocks. A link is confirmed on full sets, and is a candidate with a probability of
    1 - (1 - 0.75**2)**16, about 1 - 2e-6, less what branching and the test of ``AGREE`` orderings lose (see tests).
    """
    sets = stored(sketched(docs), "sketches")
    of_class = ["n_shingles", "print_a", "print_b"]
    some = sets.where("doc_id is not null and n_shingles > 0")
    classes = stored(some.groupBy(*of_class).agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("nodes", "signature"), "doc_id").alias("x")).select(*of_class, "rep", "x.nodes", "x.signature"), "classes")
    maybe = connected_components(candidate_links(classes), "candidates")
    links = cluster_links(docs, maybe, classes.select(F.col("rep").alias("node"), F.col("n_shingles").alias("n")))
    found = stored(connected_components(links, "links"), "components")
    named = stored(classes.select(*of_class, "rep").join(found, F.col("rep") == F.col("node"), "left").select(*of_class, F.coalesce("component", "rep").alias("component")), "named")
    alone = sets.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.join(named, of_class).select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
