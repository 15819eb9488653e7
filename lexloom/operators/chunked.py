"""The nearest rows of other folds, from counts of terms: what a setting and fold makes of them is worked out in the tasks.

A row has as many vectors as there are settings and folds, but counts once. So counts are what is shipped: rows are packed
to chunks, a chunk being one binary value, and each task meets a few chunks of asking rows with a part of the chunks of
held ones, by a cross join that reads both sides again and writes nothing. All pairs are summed: time grows with the
square of the rows, while memory is bounded and disk grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.neighbours import _classes, _spread, _starts
from lexloom.session import kept

#: Rows of a chunk that asks and of one that is held, on average.
ASK_ROWS, HELD_ROWS = 8_192, 16_384
#: Rows whose words are counted at a time.
SLICE = 1_024
#: Cells of the matrix of held rows, rows that are asked for at a time, and sums from which a first bound is taken.
HELD_CELLS, TILE, FIRST = 6 << 20, 512, 2_048


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``SLICE`` rows, as texts may be long; empty ones are left out."""
    return (batch.slice(lo, SLICE) for batch in batches for lo in range(0, batch.num_rows, SLICE))


def owners(lists: pa.Array) -> np.ndarray:
    """The row of each value of a column of lists; null lists have none."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def tallied(owner: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, how often), each pair once, in order; codes are under ``size``."""
    both, n = np.unique(owner.astype(np.int64) * size + code, return_counts=True)
    return both // max(size, 1), both % max(size, 1), n


def word_counts(rows: DataFrame, fold: str) -> DataFrame:
    """(term, fold, df, tf) of words, of rows (fold, t); df counts rows."""
    kind = dict(rows.dtypes)[fold]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words = batch.column(1).flatten().dictionary_encode()
            names, folds = words.dictionary, batch.column(0).dictionary_encode()
            row, code, n = tallied(owners(batch.column(1)), words.indices.to_numpy(), len(names))
            of = folds.indices.to_numpy()[row] if len(row) else row
            at, place = np.unique(of * max(len(names), 1) + code, return_inverse=True)
            df, tf = np.bincount(place, minlength=len(at)), np.bincount(place, n, len(at)).astype(np.int64)
            columns = [names.take(pa.array(at % max(len(names), 1))), folds.dictionary.take(pa.array(at // max(len(names), 1))), pa.array(df.astype(np.int64)), pa.array(tf)]
            yield pa.record_batch(columns, names=["term", fold, "df", "tf"])

    each = rows.select(fold, "t").mapInArrow(run, f"term string, {fold} {kind}, df long, tf long")
    return each.groupBy("term", fold).agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def _neighbouring(lists: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place) of the values that are among ``words``, and where such a value comes right after another of its row."""
    owner, place = owners(lists), lists.flatten()
    place = pc.index_in(place, value_set=words).fill_null(-1).to_numpy()
    follows = np.nonzero((owner[1:] == owner[:-1]) & (place[1:] >= 0) & (place[:-1] >= 0))[0]
    return owner, place.astype(np.int64), follows


def pair_counts(rows: DataFrame, fold: str, words: list[str]) -> DataFrame:
    """(term, fold, df, tf) of pairs of neighbouring words that are both among ``words``, of rows (fold, t)."""
    kind = dict(rows.dtypes)[fold]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size, held, whole = pa.array(words, pa.string()), len(words) ** 2, {}, None
        for batch in _slices(batches):
            whole = batch.schema.field(0).type
            owner, place, first = _neighbouring(batch.column(1), known)
            row, code, n = tallied(owner[first], place[first] * len(words) + place[first + 1], size)
            folds = batch.column(0).to_pylist()
            number = {x: i for i, x in enumerate(dict.fromkeys(folds))}
            of = np.array([number[x] for x in folds])[row] if len(row) else row
            for x, i in number.items():
                # a task's pairs are added up: they are many in each batch, and the same ones
                mine = of == i
                at, df, tf = held.get(x, (np.zeros(0, np.int64),) * 3)
                at, place_of = np.unique(np.concatenate([at, code[mine]]), return_inverse=True)
                add = lambda old, new: np.bincount(place_of, np.concatenate([old, new]), len(at)).astype(np.int64)  # noqa: B023, E731
                held[x] = at, add(df, np.ones(mine.sum())), add(tf, n[mine])
        for x, (at, df, tf) in held.items():
            for lo in range(0, len(at), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.record_batch([pa.array(at[part]), pa.array([x] * len(at[part]), whole), pa.array(df[part]), pa.array(tf[part])], names=["code", fold, "df", "tf"])

    each = rows.select(fold, "t").mapInArrow(run, f"code long, {fold} {kind}, df long, tf long") if words else rows.sparkSession.createDataFrame([], f"code long, {fold} {kind}, df long, tf long")
    return each.groupBy("code", fold).agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def coded(rows: DataFrame, key: str, fold: str, terms: list[tuple[str, bool]]) -> DataFrame:
    """(id, s, at, w, d) of rows (key, fold, t): places in ``terms`` (term, whether a pair), in order, and counts; s is the fold. Rows without any are left out."""
    words = sorted({x for term, pair in terms for x in (term.split(" ") if pair else [term])})
    number = {x: i for i, x in enumerate(words)}
    singly = np.full(max(len(words), 1), -1)
    for i, (term, pair) in enumerate(terms):
        if not pair:
            singly[number[term]] = i
    listed = sorted((number[a] * len(words) + number[b], i) for i, (term, pair) in enumerate(terms) if pair for a, b in [term.split(" ")])
    codes, which = (np.array(x, np.int64) for x in zip(*listed)) if listed else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for batch in _slices(batches):
            owner, place, first = _neighbouring(batch.column(2), known)
            mine = np.nonzero(place >= 0)[0]
            row, at = [owner[mine]], [singly[place[mine]]]
            if len(codes):
                code = place[first] * len(words) + place[first + 1]
                there = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                row.append(owner[first])
                at.append(np.where(codes[there] == code, which[there], -1))
            row, at = np.concatenate(row), np.concatenate(at)
            row, at, n = tallied(row[at >= 0], at[at >= 0], len(terms))
            sizes = np.bincount(row, minlength=batch.num_rows)
            ends = pa.array(_starts(sizes).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at, n)]
            yield pa.record_batch([*batch.columns[:2], *lists], names=["id", "s", "at", "w"]).filter(pa.array(sizes > 0))

    slim = rows.select(F.col(key).cast("long").alias("id"), F.col(fold).cast("int").alias("s"), "t").mapInArrow(run, "id long, s int, at array<int>, w array<int>")
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    return slim.withColumn("d", F.unhex(F.sha2(F.concat_ws("|", F.col("s").cast("string"), text("at"), text("w")).cast("binary"), 256)))


def _packed(units: DataFrame, c: int) -> DataFrame:
    """(chunk): the rows (id, s, at, w), dealt to c chunks, each as one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if got:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, got[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in got:
                    out.write_batch(x)
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk"])

    dealt = units.repartitionById(c, F.pmod(F.xxhash64("id"), F.lit(c)).cast("int"))
    return dealt.select("id", "s", "at", "w").mapInArrow(run, "chunk binary")


class _Rows:
    def __init__(self, chunk: bytes) -> None:
        table = pa.ipc.open_stream(chunk).read_all().combine_chunks()
        self.ids, self.folds = table["id"].to_numpy(), table["s"].to_numpy()
        self.owner = owners(table["at"].combine_chunks())
        self.at, self.tf = (table[x].combine_chunks().flatten().to_numpy() for x in ("at", "w"))
        self.logs = 1 + np.log(self.tf)

    def of(self, mine: np.ndarray, column: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the rows with a term, starts of theirs, columns, weights), of rows that are ``mine``."""
        fits = np.nonzero(mine[self.owner] & (column[self.at] >= 0))[0]
        at, owner = self.at[fits], self.owner[fits]
        w = self.logs[fits] * idf[at]
        sums = np.bincount(owner, w * w, len(self.ids))
        sizes = np.bincount(owner, minlength=len(self.ids))
        some = np.nonzero(sizes)[0]
        return some, _starts(sizes[some]), column[at], w / np.sqrt(sums)[owner]


def _filled(starts: np.ndarray, col: np.ndarray, w: np.ndarray, lo: int, hi: int, width: int, kind: type) -> np.ndarray:
    out, part = np.zeros((hi - lo, width), kind), slice(starts[lo], starts[hi])
    out[np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1])), col[part]] = w[part]
    return out


def _first(r: np.ndarray, dot: np.ndarray, rep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest dots of each r, ties by the smaller rep."""
    order = np.lexsort((rep, -dot, r))
    r, dot, rep = r[order], dot[order], rep[order]
    some = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[some], dot[some], rep[some]


class Asked:
    """The rows of a chunk with the k best rows of other folds so far, for each setting.

    Sums in single precision turn down all but those within their error of the k-th best; these are summed in double
    precision and rounded to 12 digits. idf: settings x folds x terms, 0 for terms that were not fitted.
    """

    def __init__(self, chunk: bytes, idf: np.ndarray, folds: list[int], k: int) -> None:
        self.rows, self.idf, self.folds, self.k = _Rows(chunk), idf, folds, k
        n = (len(idf), len(self.rows.ids), k)
        self.dots, self.reps = np.zeros(n), np.zeros(n, np.int64)
        self.width = (idf > 0).sum(2)
        self.column = np.where(idf > 0, np.cumsum(idf > 0, axis=2) - 1, -1)

    def meet(self, chunk: bytes) -> None:
        held = _Rows(chunk)
        for s in range(len(self.idf)):
            for o, fold in enumerate(self.folds):
                how = self.column[s, o], self.idf[s, o]
                mine, starts, col, w = self.rows.of(self.rows.folds == fold, *how)
                other, theirs, their_col, their_w = held.of(held.folds != fold, *how)
                if not len(mine) or not len(other):
                    continue
                width = int(self.width[s, o])
                step = max(1, HELD_CELLS // width)
                for lo in range(0, len(other), step):
                    hi = min(lo + step, len(other))
                    matrix = _filled(theirs, their_col, their_w, lo, hi, width, np.float32)
                    for a in range(0, len(mine), TILE):
                        b = min(a + TILE, len(mine))
                        self._tile(s, mine[a:b], np.diff(starts[a : b + 1]), _filled(starts, col, w, a, b, width, float), matrix, held.ids[other[lo:hi]], theirs[lo : hi + 1], their_col, their_w)

    def _tile(self, s: int, mine: np.ndarray, sizes: np.ndarray, asks: np.ndarray, matrix: np.ndarray, ids: np.ndarray, starts: np.ndarray, col: np.ndarray, w: np.ndarray) -> None:
        sums, k = asks.astype(np.float32) @ matrix.T, self.k
        floor = self.dots[s, mine, k - 1].astype(np.float32)
        new = np.nonzero(floor <= 0)[0]
        if len(new) and len(ids) > k:
            some = sums[new, : max(FIRST, k + 1)]
            floor[new] = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k]
        # two sums of n products each, of vectors of length 1, are wrong by (n + 3) half units in the last place at most
        floor = np.maximum(floor - (2.1 * (sizes + 4) * 2.0**-24).astype(np.float32), np.finfo(np.float32).tiny)
        r, c = np.divmod(np.flatnonzero(sums >= floor[:, None]), len(ids))
        if not len(r):
            return
        dots = []
        for lo in range(0, len(r), 1 << 14):
            x, y = r[lo : lo + (1 << 14)], c[lo : lo + (1 << 14)]
            lengths = starts[y + 1] - starts[y]
            places = _spread(starts[y], lengths)
            dots.append(np.add.reduceat(w[places] * asks[np.repeat(x, lengths), col[places]], _starts(lengths)[:-1]))
        dots = np.round(np.concatenate(dots), 12)
        known = self.dots[s, mine]
        r, dots, reps = (np.concatenate(x) for x in ((r, np.repeat(np.arange(len(mine)), k)), (dots, known.ravel()), (ids[c], self.reps[s, mine].ravel())))
        r, dots, reps = _first(r[dots > 0], dots[dots > 0], reps[dots > 0], k)
        place = np.arange(len(r)) - np.searchsorted(r, r)
        self.dots[s, mine[r], place], self.reps[s, mine[r], place] = dots, reps

    def found(self) -> pa.RecordBatch:
        s, r, i = np.nonzero(self.dots > 0)
        return pa.record_batch([pa.array(s.astype(np.int32)), pa.array(self.rows.ids[r]), pa.array(self.reps[s, r, i]), pa.array(self.dots[s, r, i])], names=["s", "q", "rep", "dot"])


def nearest_of_other_folds(rows: DataFrame, key: str, fold: str, terms: list[tuple[str, bool]], idf: np.ndarray, folds: list[int], k: int) -> DataFrame:
    """(s, id, neighbour): the k rows of other folds with the greatest dots, for each setting s, an index of ``idf``; ties go to the smaller key."""
    units, members = _classes(kept(coded(rows, key, fold, terms), "coded"), 0)
    n = units.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = kept(_packed(units, max(1, -(-n // HELD_ROWS))), "held")
    asks = _packed(units, max(1, -(-n // ASK_ROWS), min(2 * cores, -(-n // 256))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, None
        for batch in batches:
            for mine, other in zip(batch.column(0), batch.column(1)):
                mine = mine.as_py()
                if mine != now:
                    if asked is not None:
                        yield asked.found()
                    now, asked = mine, Asked(mine, idf, folds, k)
                asked.meet(other.as_py())
        if asked is not None:
            yield asked.found()

    pairs = asks.select(F.col("chunk").alias("asks")).crossJoin(held.hint("shuffle_replicate_nl"))
    met = kept(pairs.mapInArrow(run, "s int, q long, rep long, dot double"), "met")
    best = lambda df, by, c: df.withColumn("r", F.row_number().over(Window.partitionBy("s", "q").orderBy(F.col("dot").desc(), by))).where(F.col("r") <= c).drop("r")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("member"))).where(F.col("r") <= k)
    near = best(best(met, "rep", k).join(first.select("rep", F.col("member").alias("neighbour")), "rep"), "neighbour", k)
    # rows with equal counts in one fold have the same neighbours
    return near.select("s", F.col("q").alias("rep"), "neighbour").join(members, "rep").select("s", F.col("member").alias("id"), "neighbour")
