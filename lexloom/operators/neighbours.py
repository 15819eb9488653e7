"""Exact nearest neighbours: dense vectors by a metric index, sparse ones by pairs of chunks.

Dense: a bounded sample of the training vectors are pivots; every training row lies in the ball of its nearest pivot. A
query is first compared with its own ball, which bounds how far its k-th neighbour can be. By the triangle inequality it
then visits only balls that reach into that distance, and within them only rows whose distance to the pivot is right.
Balls are cut into parts of bounded size, rows and queries meet by part, and a task holds one part. Where more visits are left
than chunks of all rows and queries would ship, as in high dimensions, those meet instead, each pair of chunks in a task.
What the driver reads are the pivots and a radius for each.

Sparse: rows with equal vectors are one. Training rows and queries are dealt to chunks of bounded size, and each pair of
chunks meets in a task: it holds the vectors of one, streams those of the other past them, and returns the k best it has.
All pairs of different vectors are summed, so the work is quadratic; memory and what a task reads are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import kept

#: Pivots at most, and training rows of one part of a ball on average.
PIVOTS, PART_ROWS = 256, 2048
#: Dense rows of a chunk on average, as training rows and as queries, where balls are no help; cells of a matrix of distances.
CHUNK_DENSE, MATRIX_CELLS = 32_768, 1 << 21
#: Distances and sums are compared with this much room, so that rounding loses no neighbour.
ROOM = 1e-9
#: Sparse rows of one chunk, as training rows and as queries, and postings, on average.
CHUNK_TRAIN, CHUNK_TEST, CHUNK_POSTINGS = 16_384, 8_192, 3 << 20
#: Terms and cells of a dense matrix at most. A sum of single postings costs as much as so many of the matrix.
DENSE_TERMS, DENSE_CELLS, DENSE_GAIN = 2_048, 12 << 20, 300
#: Queries that are summed at a time, and single postings of them.
PROBE, SLICE_SUMS = 128, 3 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows, from differences: equal rows are at 0, and nearby ones lose no digits."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for lo in range(0, len(a), step):
        out[lo : lo + step] = np.sqrt(((a[lo : lo + step, None, :] - b[None, :, :]) ** 2).sum(2))
    return out


def _nearest_rows(v: np.ndarray, x: np.ndarray, near: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of v, rows of x, distances): the k nearest of each, ties by the smaller ``near``, some rows of v at a time.

    Products of matrices turn down all but those within their error of the k-th; these have their distances from differences.
    """
    if not (np.isfinite(v).all() and np.isfinite(x).all()):
        d = _distances(v, x)
        order = np.lexsort((np.broadcast_to(near, d.shape), d), axis=1)[:, :k]
        yield np.repeat(np.arange(len(v)), order.shape[1]), order.ravel(), np.take_along_axis(d, order, 1).ravel()
        return
    xx, step = (x * x).sum(1), max(1, MATRIX_CELLS // len(x))
    for lo in range(0, len(v), step):
        a = v[lo : lo + step]
        aa = (a * a).sum(1)
        squares = aa[:, None] + xx[None, :] - 2 * (a @ x.T)
        # sums of n products are wrong by n half units in the last place of the sum of their sizes at most
        room = 8 * (v.shape[1] + 4) * 2.0**-53 * (aa + xx.max())
        kth = np.partition(squares, k - 1, axis=1)[:, k - 1] if len(x) > k else squares.max(1)
        r, c = np.nonzero(squares <= (kth + 2 * room)[:, None])
        d = np.concatenate([np.sqrt(((a[r[i : i + step]] - x[c[i : i + step]]) ** 2).sum(1)) for i in range(0, len(r), step)])
        order = np.lexsort((near[c], d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield lo + r[first], c[first], d[first]


def _placed(rows: DataFrame, pivots: np.ndarray, every: bool) -> DataFrame:
    """Rows (id, v) with their nearest pivot (ties: the first) and their distance to it, and with all distances for queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column(1)), pivots)
                ball = d.argmin(1)
                columns = [batch.column(0), batch.column(1), pa.array(ball.astype(np.int32)), pa.array(d[np.arange(len(d)), ball])]
                yield pa.record_batch(columns + [pa.array(list(d))] * every, names=["id", "v", "ball", "d"] + ["all"] * every)

    return rows.mapInArrow(run, "id long, v array<double>, ball int, d double" + ", all array<double>" * every)


_FOUND = "id long, neighbour long, distance double"


def _visited(k: int):
    """What is applied to rows (g, query, id, v, d, limit), a part's training rows before its queries: k best a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ready = None, [], None
        for batch in batches:
            names = batch.column(0).to_pylist()
            edges = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if names[lo] != group:
                    group, held, ready = names[lo], [], None
                part = batch.slice(lo, hi - lo)
                asks = part.column(1).to_numpy(zero_copy_only=False)
                n = int((~asks).sum())
                if n:
                    held.append((part.column(2).to_numpy()[:n], _matrix(part.column(3).slice(0, n)), part.column(4).to_numpy()[:n]))
                if n == len(asks) or not held:
                    continue
                if ready is None:
                    ready = tuple(np.concatenate(x) for x in zip(*held))
                    order = np.argsort(ready[2], kind="stable")
                    ready = tuple(x[order] for x in ready)
                ids, x, away = ready
                q, dq, limit = part.column(2).to_numpy()[n:], part.column(4).to_numpy()[n:], part.column(5).to_numpy()[n:]
                first, last = np.searchsorted(away, dq - limit, "left"), np.searchsorted(away, dq + limit, "right")
                some = np.nonzero(last > first)[0]
                if not len(some):
                    continue
                v = _matrix(part.column(3).slice(n))[some]
                # rows are sorted by their distance to the pivot: only the stretch that any of these queries needs
                low, high = first[some].min(), last[some].max()
                near = ids[low:high]
                for r, c, d in _nearest_rows(v, x[low:high], near, k):
                    fine = d <= limit[some][r]
                    if fine.any():
                        yield pa.record_batch([q[some][r[fine]], near[c[fine]], d[fine]], names=["id", "neighbour", "distance"])

    return run


def _visits(balls: DataFrame, asked: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """The k best of each visit. balls: ball, part, id, v, d; asked: ball, id, v, d, limit; parts: ball, parts."""
    n = int(balls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = lambda part: F.format_string("%d-%d", F.col("ball"), part)
    rows = balls.select(name(F.col("part")).alias("g"), F.lit(False).alias("query"), "id", "v", "d", F.lit(0.0).alias("limit"))
    dealt = asked.join(parts, "ball").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = rows.unionByName(dealt.select(name(F.col("part")).alias("g"), F.lit(True).alias("query"), "id", "v", "d", "limit"))
    return both.repartition(n, "g").sortWithinPartitions("g", "query").mapInArrow(_visited(k), _FOUND)


def _chunks_met(known: DataFrame, asked: DataFrame, c: int, e: int, k: int) -> DataFrame:
    """The k best of each query in each of c chunks of the training rows. known: id, v; asked: id, v, limit."""
    dealt = lambda df, own, other, g, query, limit: df.select(
        F.pmod(F.xxhash64("id"), F.lit(own)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("j"), "id", "v", limit.alias("limit")
    ).select(g.cast("int").alias("g"), F.lit(query).alias("query"), "id", "v", F.lit(0.0).alias("d"), "limit")
    rows = dealt(known, c, e, F.col("i") * e + F.col("j"), False, F.lit(0.0)).unionByName(dealt(asked, e, c, F.col("j") * e + F.col("i"), True, F.col("limit")))
    return rows.repartitionById(c * e, F.col("g")).sortWithinPartitions("g", "query").mapInArrow(_visited(k), _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int = 3) -> DataFrame:
    """(key, neighbour, label, distance, rank): the k nearest training rows of each test row by Euclidean distance.

    Ties go to the smaller training key. Keys are longs, one a row; null vectors have no neighbours and are none. All
    vectors have one length. With fewer training rows than k, all of them.
    """
    spark = train.sparkSession
    rows = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    known = kept(rows(train), "train")
    n = known.count()
    empty = spark.createDataFrame([], f"{key} long, neighbour long, label {dict(train.dtypes)[label]}, distance double, rank int")
    if not n:
        return empty
    few = min(PIVOTS, max(1, math.isqrt(n)))
    pivots = np.array([r["v"] for r in known.orderBy(F.xxhash64("id"), "id").limit(few).collect()], float)
    placed = kept(_placed(known, pivots, every=False), "placed")
    reach = {r["ball"]: r["r"] for r in placed.groupBy("ball").agg(F.max("d").alias("r")).collect()}
    parts = kept(placed.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts")), "parts")
    balls = placed.join(parts, "ball").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    asked = kept(_placed(rows(test), pivots, every=True), "asked")
    home = _top(_visits(balls, asked.select("ball", "id", "v", "d", F.lit(math.inf).alias("limit")), parts, k), k)
    home = kept(home, "home")
    limits = kept(home.where(F.col("rank") == k).select("id", (F.col("distance") * (1 + ROOM) + ROOM).alias("limit")), "limits")
    radii = F.array(*[F.lit(float(reach.get(i, -math.inf))) for i in range(len(pivots))])
    far = asked.join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf)))
    # a ball is visited if it reaches into the limit, and if the plane between its pivot and the own one does
    balls_met = F.filter(
        F.transform("all", lambda d, i: F.struct(i.alias("ball"), d.alias("d"))),
        lambda b: (b["ball"] != F.col("ball")) & (b["d"] - F.get(radii, b["ball"]) <= F.col("limit")) & ((b["d"] - F.col("d")) / 2 <= F.col("limit")),
    )
    visits, m = far.agg(F.coalesce(F.sum(F.size(balls_met)), F.lit(0)), F.count(F.lit(1))).first()
    c, e = -(-n // CHUNK_DENSE), max(1, -(-m // CHUNK_DENSE))
    c = max(c, min(-(-n // 1024), -(-2 * spark.sparkContext.defaultParallelism // e)))
    labels = train.select(F.col(key).cast("long").alias("neighbour"), F.col(label).alias("label"))
    if visits > c * m + e * n:
        # few balls are ruled out: chunks of rows and queries ship less
        every = _chunks_met(known, far.select("id", "v", "limit"), c, e, k)
        return _top(every, k).join(labels, "neighbour").select(F.col("id").alias(key), "neighbour", "label", "distance", "rank")
    away = far.select("id", "v", "limit", F.explode(balls_met).alias("b")).select(F.col("b.ball").alias("ball"), "id", "v", F.col("b.d").alias("d"), "limit")
    every = home.drop("rank").unionByName(_visits(balls, away, parts, k))
    return _top(every, k).join(labels, "neighbour").select(F.col("id").alias(key), "neighbour", "label", "distance", "rank")


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs that begin at ``starts``, one after the other."""
    return np.repeat(starts - _starts(lengths)[:-1], lengths) + np.arange(lengths.sum())


class Held:
    """Vectors of one chunk, and the k best of them for each of a stream of queries.

    Terms that many rows have are columns of a dense matrix, the others are postings. Both are summed in single precision,
    which turns down all rows but those within its error of the k-th best; these are summed anew in double precision.
    """

    def __init__(self, sizes: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
        self.n, self.starts, self.w = len(sizes), _starts(sizes), w
        self.names, self.at, df = np.unique(at, return_inverse=True, return_counts=True)
        most = max(1, min(DENSE_TERMS, DENSE_CELLS // max(1, self.n)))
        often = np.argsort(-df, kind="stable")[:most]
        often = often[df[often] ** 2 * DENSE_GAIN > self.n**2]
        self.column = np.full(len(df), -1)
        self.column[often] = np.arange(len(often))
        row = np.repeat(np.arange(self.n), sizes)
        place = self.column[self.at]
        self.dense = np.zeros((len(often), self.n), np.float32)
        self.dense[place[place >= 0], row[place >= 0]] = w[place >= 0]
        rare = np.nonzero(place < 0)[0]
        rare = rare[np.argsort(self.at[rare], kind="stable")]
        self.rows, self.weights = row[rare].astype(np.int32), w[rare].astype(np.float32)
        self.df = np.where(self.column < 0, df, 0)
        self.lists = _starts(self.df)

    def best(self, sizes: np.ndarray, at: np.ndarray, w: np.ndarray, k: int, allowed=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, dots): the k greatest dots over 0, rounded to 12 digits; ties go to the smaller row.

        ``allowed`` of two row numbers (slices of queries, all rows) is what may meet; by default all.
        """
        if not self.n or not len(self.names):
            return
        term = np.minimum(np.searchsorted(self.names, at), len(self.names) - 1)
        fits = self.names[term] == at
        owner = np.repeat(np.arange(len(sizes)), sizes)[fits]
        term, w = term[fits], w[fits]
        starts = np.searchsorted(owner, np.arange(len(sizes) + 1))
        work = _starts(self.df[term])[starts]
        buffer = np.zeros(len(self.names))
        lo = 0
        while lo < len(sizes):
            hi = lo + 1
            while hi < len(sizes) and hi - lo < PROBE and work[hi + 1] - work[lo] <= SLICE_SUMS:
                hi += 1
            part = slice(starts[lo], starts[hi])
            t, x, r = term[part], w[part], owner[part] - lo
            q = np.zeros((hi - lo, len(self.dense)), np.float32)
            c = self.column[t]
            q[r[c >= 0], c[c >= 0]] = x[c >= 0]
            sums = q @ self.dense if len(self.dense) else np.zeros((hi - lo, self.n), np.float32)
            rare = c < 0
            lengths = self.df[t[rare]]
            places = _spread(self.lists[t[rare]], lengths)
            cells = np.repeat(r[rare] * self.n, lengths) + self.rows[places]
            np.add.at(sums.ravel(), cells, np.repeat(x[rare].astype(np.float32), lengths) * self.weights[places])
            if allowed is not None:
                sums[~allowed(slice(lo, hi))] = 0
            kth = np.partition(sums, self.n - k, axis=1)[:, self.n - k] if self.n > k else np.zeros(hi - lo, np.float32)
            # two sums of n products each, of vectors of length 1, are wrong by (n + 3) half units in the last place at most
            floor = kth - 2.1 * (starts[lo + 1 : hi + 1] - starts[lo:hi] + 4) * 2.0**-24
            found = np.flatnonzero((sums >= floor[:, None]) & (sums > 0))
            edges = np.searchsorted(found, np.arange(hi - lo + 1) * self.n)
            for i in range(hi - lo):
                rows = found[edges[i] : edges[i + 1]] - i * self.n
                if not len(rows):
                    continue
                mine = slice(starts[lo + i], starts[lo + i + 1])
                buffer[term[mine]] = w[mine]
                lengths = self.starts[rows + 1] - self.starts[rows]
                places = _spread(self.starts[rows], lengths)
                dots = np.round(np.add.reduceat(self.w[places] * buffer[self.at[places]], _starts(lengths)[:-1]), 12)
                buffer[term[mine]] = 0
                order = np.lexsort((rows, -dots))[:k]
                order = order[dots[order] > 0]
                yield lo + i, rows[order], dots[order]
            lo = hi


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a column of lists."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def runs(names: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of equal neighbours."""
    edges = np.concatenate([[0], np.nonzero(names[1:] != names[:-1])[0] + 1, [len(names)]])
    return ((int(lo), int(hi)) for lo, hi in zip(edges, edges[1:]) if lo < hi)


def _met(k: int, kind: pa.DataType):
    """What is applied to rows (g, query, id, at, w), a group's training rows by id before its queries: k best a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ids, ready = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi in runs(batch.column(0).to_numpy()):
                if batch.column(0)[lo].as_py() != group:
                    group, held, ids, ready = batch.column(0)[lo].as_py(), [], [], None
                part = batch.slice(lo, hi - lo)
                n = int((~part.column(1).to_numpy(zero_copy_only=False)).sum())
                if n:
                    held.append(_lists(part.column(3).slice(0, n)) + _lists(part.column(4).slice(0, n))[1:])
                    ids += part.column(2).slice(0, n).to_pylist()
                if n == hi - lo or not held:
                    continue
                ready = ready or Held(*(np.concatenate(x) for x in zip(*held)))
                asks = part.column(2).slice(n).to_pylist()
                out = ([], [], [])
                for q, rows, dots in ready.best(*_lists(part.column(3).slice(n)), _lists(part.column(4).slice(n))[1], k):
                    out[0].extend([asks[q]] * len(rows))
                    out[1].extend(ids[j] for j in rows)
                    out[2].extend(dots.tolist())
                if out[0]:
                    yield pa.record_batch([pa.array(out[0], kind), pa.array(out[1], kind), pa.array(out[2])], names=["q", "rep", "dot"])

    return run


def chunks(n: int, postings: int, rows: int, most: int = CHUNK_POSTINGS) -> int:
    """Chunks of so many rows and postings on average."""
    return max(1, -(-n // rows), -(-postings // most))


def _classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(vectors (id, s, at, w) of the first row of each class of equal ones in a group s, members (rep, member): the k first of each).

    Vectors with a column d are stored, and it tells those apart that differ.
    """
    text = lambda c: F.col(c).cast("array<string>")
    told = F.unhex(F.sha2(F.concat_ws(",", F.col("s").cast("string"), text("at"), text("w")).cast("binary"), 256))
    keyed = vectors if "d" in vectors.columns else kept(vectors.withColumn("d", told), "vectors")
    first = kept(keyed.groupBy("d").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "first")
    # most are alone in their class
    members = keyed.select("id", "d").join(first.where("n > 1").select("d", "rep"), "d").select("rep", F.col("id").alias("member"))
    if k:
        members = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("member"))).where(F.col("r") <= k).drop("r")
    members = kept(members.unionByName(first.where("n = 1").select("rep", F.col("rep").alias("member"))), "members")
    return keyed.join(first.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "s", "at", "w"), members


def sparse_nearest(train: DataFrame, test: DataFrame, key: str, k: int = 3, train_keys: DataFrame | None = None, test_keys: DataFrame | None = None) -> DataFrame:
    """(key, neighbour, distance, rank) over L2-normed long tables (key, term, weight >= 0): distance sqrt(2 - 2 dot).

    The greatest dots count, rounded to 12 digits; ties go to the smaller training key. Rows without a term are not in the
    tables: ``train_keys`` and ``test_keys`` (key) name all rows, so that they are neighbours and have some; by default
    they are those of the tables. What shares no term with a query has dot 0, and is a neighbour where fewer than k rows
    share one.
    """
    whole = lambda df: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("v"))
    keys = lambda df, named: (df if named is None else named).select(key).where(f"{key} is not null").distinct()
    return vectors_nearest(whole(train), whole(test), key, "v", k, keys(train, train_keys), keys(test, test_keys))


def best_met(train: DataFrame, test: DataFrame, key: str, vector: str, k: int, group: str | None = None, groups: int = 1) -> DataFrame:
    """(q, neighbour, dot, rank): the k best of those that share a term. ``group``, from 0 to ``groups`` - 1, tells rows that meet; keys are of one group."""
    # terms are 64-bit hashes from here on; equal ones of one row would count once
    number = F.lit(0) if group is None else F.col(group)
    hashed = lambda df: df.select(F.col(key).alias("id"), number.cast("int").alias("s"), F.transform(vector, lambda x: F.xxhash64(x["term"])).alias("at"), F.col(f"{vector}.weight").alias("w"))
    return placed_met(hashed(train), hashed(test), k, groups)


def placed_met(train: DataFrame, test: DataFrame, k: int, groups: int = 1) -> DataFrame:
    """``best_met`` of rows (id, s, at, w): s is the group, ``at`` numbers the terms. With a column d, see ``_classes``."""
    kind = dict(train.dtypes)["id"]
    (known, like), (asked, alike) = _classes(train, k), _classes(test, 0)
    n, m = (df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("at")), F.lit(0))).first() for df in (known, asked))
    c, e = chunks(n[0] // groups, n[1] // groups, CHUNK_TRAIN), chunks(m[0] // groups, m[1] // groups, CHUNK_TEST)
    # small tables too are work for all cores
    c = max(c, min(-(-n[0] // groups // 1024), -(-2 * train.sparkSession.sparkContext.defaultParallelism // (e * groups))))
    dealt = lambda df, own, other, g, query: df.select(
        F.pmod(F.xxhash64("id"), F.lit(own)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("j"), "s", "id", "at", "w"
    ).select((F.col("s") * (c * e) + g).cast("int").alias("g"), F.lit(query).alias("query"), "id", "at", "w")
    both = dealt(known, c, e, F.col("i") * e + F.col("j"), False).unionByName(dealt(asked, e, c, F.col("j") * e + F.col("i"), True))
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    met = both.repartitionById(groups * c * e, F.col("g")).sortWithinPartitions("g", "query", "id").mapInArrow(_met(k, arrow), f"q {kind}, rep {kind}, dot double")
    kth = Window.partitionBy("q").orderBy(F.col("dot").desc(), "rep")
    met = kept(met.withColumn("dot", F.bround("dot", 12)).withColumn("r", F.row_number().over(kth)).where(F.col("r") <= k).drop("r"), "met")
    # among the members of k classes are the k neighbours; queries with equal vectors have the same ones
    each = met.join(like, "rep").select("q", F.col("member").alias("neighbour"), "dot")
    first_k = each.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("dot").desc(), "neighbour"))).where(F.col("rank") <= k)
    return kept(first_k.join(alike.withColumnRenamed("rep", "q"), "q").select(F.col("member").alias("q"), "neighbour", "dot", "rank"), "top")


def vectors_nearest(train: DataFrame, test: DataFrame, key: str, vector: str, k: int, train_keys: DataFrame, test_keys: DataFrame) -> DataFrame:
    """As ``sparse_nearest``, of one row a key: key, and ``vector`` as structs (term, weight) in the order of terms. Keys are all, once each."""
    return filled(best_met(train, test, key, vector, k), key, k, train_keys, test_keys)


def filled(top: DataFrame, key: str, k: int, train_keys: DataFrame, test_keys: DataFrame) -> DataFrame:
    """``vectors_nearest`` of the rows of ``best_met``."""
    kind, all_known, all_asked = dict(train_keys.dtypes)[key], train_keys.select(F.col(key).alias("id")), test_keys.select(F.col(key).alias("id"))
    held = top.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.collect_set("neighbour").alias("has"))
    short = all_asked.select(F.col("id").alias("q")).join(held, "q", "left").where("n is null or n < %d" % k)
    first = [r["id"] for r in all_known.orderBy("id").limit(2 * k).collect()]
    none = F.coalesce("has", F.array().cast(f"array<{kind}>"))
    spare = F.slice(F.array_except(F.array(*map(F.lit, first)).cast(f"array<{kind}>"), none), F.lit(1), k - F.coalesce("n", F.lit(0)))
    more = short.select("q", F.coalesce("n", F.lit(0)).alias("n"), F.posexplode(spare).alias("i", "neighbour")).select("q", "neighbour", F.lit(0.0).alias("dot"), (F.col("n") + F.col("i") + 1).cast("int").alias("rank"))
    every = top.select("q", "neighbour", "dot", "rank").unionByName(more)
    return every.select(F.col("q").alias(key), "neighbour", F.sqrt(F.greatest(2 - 2 * F.col("dot"), F.lit(0.0))).alias("distance"), "rank")


def vote(neighbours: DataFrame, key: str) -> DataFrame:
    """(key, predicted): the most frequent label of each key's neighbours; ties go to the smallest label."""
    counts = neighbours.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(F.col("label"), F.struct((-F.col("n")).alias("n"), F.col("label"))).alias("predicted"))
