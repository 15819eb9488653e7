"""Finding every repeat of at least ``length`` tokens: sampled suffixes, shared by substring and suffix-array dedup.

A repeat of ``length`` tokens contains a *minimizer*: of the hashes of its ``seed``-token grams, the least. Equal
windows have equal minimizers, so it is enough to compare suffixes that begin at minimizers ("anchors"), each with
the tokens on its left. Two anchors whose common text reaches ``l`` tokens right and ``r`` tokens left with
``l + r >= length`` make a repeat; the later one loses that stretch. No window is missed and none is guessed: hashes
choose candidates, the tokens themselves are compared.

Steps, each bounded by a batch or a sort that can spill:

1. ``anchors``: one scan of the texts. Anchors of one batch whose whole contexts are equal become one leaf with members
   (pre-aggregation of copies; hash, then the text compared). Nothing is decided here.
2. ``repeated``: rows sorted by key; keys met once, by one anchor without members, are dropped. Keys with more than
   ``most`` anchors are marked hot.
3. ``contexts``: the texts again, to cut the context of each surviving anchor.
4. the operator's own structure (suffix tree or interval tree) over contexts sorted by their right side: it names the
   nodes, ``taken`` reads from them what each leaf and its members lose.
5. ``apply``: spans merged by document and cut out.

A hot gram (a passage that a third of all documents hold, say) is not put in one task: ``level_spans`` builds the nodes
of its tree level by level as rows. A node of the level that reaches ``l`` tokens left and ``length - l`` right is one
window; its first leaf is found by partial aggregates, and all other leaves lose the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._tables import stored

U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15, 2**64
_INVERSE = pow(_BASE, -1, _MASK)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_FLUSH_BYTES = 24 << 20  # of texts and anchors that are held together
MOST = 50_000  # anchors of one gram that one task may hold
CHUNK = 30_000  # contexts that are read into one tree or array, rounded up to whole keys


class Powers:
    """base**i and base**-i mod 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (U(_BASE), U(_INVERSE)))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def sliding(a: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        a = pick(a[:-step], a[step:])
        step *= 2
    return pick(a[: len(a) - (width - step)], a[width - step :]) if width > step else a


#: ASCII whitespace, as `bytes.split` has it.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """ASCII-whitespace words, identified by a 64-bit hash of their bytes."""

    @staticmethod
    def measured(text: bytes, power: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(identifier, start, end in the text) of each word."""
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        power.to(n + 1)
        word = np.zeros(n + 2, np.int8)
        word[1:-1] = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(word))
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTES[data] * power.down[:n], out=sums[1:])
        return mixed((sums[end] - sums[start]) * power.up[start] + (end - start).astype(U)), start, end

    def split(self, text: bytes) -> list[bytes]:
        self.plain = b"\x00" not in text and b"\x01" not in text
        return text.split()

    def right(self, words: list[bytes], lo: int, hi: int) -> bytes:
        return self.joined(words[lo:hi])

    def left(self, words: list[bytes], lo: int, hi: int) -> bytes:
        return self.joined(words[lo:hi][::-1])

    def joined(self, words: list[bytes]) -> bytes:
        """Each word with an end mark that sorts below any word, so that the order of the bytes is that of the word lists."""
        if not self.plain:
            words = [w.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") for w in words]
        return b"\x00".join([*words, b""])

    @staticmethod
    def matrix(texts: list[pa.Array], widths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(numbers of the words, 0 after the last; how many) of each array; equal words have equal numbers in all."""
        parts = [_buffers(x) for x in texts]
        data = np.concatenate([d for d, _ in parts])
        ends = np.flatnonzero(data == 0) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        number = words.dictionary_encode().indices.to_numpy().astype(np.int32) + 1
        out, lo, base = [], 0, 0
        for (d, at), width in zip(parts, widths):
            n = np.diff(np.searchsorted(ends, base + at, "right"))
            out.append((_filled(number[lo : lo + n.sum()], n, width), n))
            lo, base = lo + int(n.sum()), base + len(d)
        return out


class Bytes:
    """UTF-8 bytes."""

    @staticmethod
    def measured(text: bytes, power: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(len(text) + 1)
        return _BYTES[np.frombuffer(text, np.uint8)], at[:-1], at[1:]

    def split(self, text: bytes) -> bytes:
        return text

    @staticmethod
    def right(text: bytes, lo: int, hi: int) -> bytes:
        return text[lo:hi]

    @staticmethod
    def left(text: bytes, lo: int, hi: int) -> bytes:
        return text[lo:hi][::-1]

    @staticmethod
    def matrix(texts: list[pa.Array], widths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(bytes, 0 after the last; how many) of each array."""
        parts = [_buffers(x) for x in texts]
        return [(_filled(d, np.diff(at), width), np.diff(at)) for (d, at), width in zip(parts, widths)]


def _buffers(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary array."""
    at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    data = x.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _filled(values: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``n`` values each, padded with 0."""
    out = np.zeros((len(n), width), values.dtype)
    out[np.arange(width) < n[:, None]] = values
    return out


ANCHOR = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("members", pa.binary())])
ANCHOR_DDL = "key long, doc_id long, pos int, members binary"
PLACE_DDL = ANCHOR_DDL + ", hot boolean"
CONTEXT_DDL = "key long, right binary, left binary, doc_id long, pos int, members binary"
SPAN = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("stop", pa.int32())])
SPAN_DDL = "doc_id long, pos int, stop int"
WINDOW = pa.schema([("node", pa.binary()), ("doc_id", pa.int64()), ("pos", pa.int32())])
WINDOW_DDL = "node binary, doc_id long, pos int"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def anchors(docs: DataFrame, tokens: Callable, length: int, seed: int, levels: int = 0) -> DataFrame:
    """(key, doc_id, pos, members): an anchor, and the other anchors of its batch with the same whole context.

    ``members`` holds two 64-bit numbers each: what doc_id and pos add to those of the row; the row is the first of them.
    ``levels``: 16-bit fields at the top of the key, each a hash of one more leading token, so that a bit prefix of
    the key stands for a token prefix of the suffix; the rest is the gram's hash.
    """
    width = length - seed + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, power = tokens(), Powers()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            doc = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[2]) for x in held])
            which = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
            pos, key, whole = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
            order = np.argsort(whole, kind="stable")  # doc_id, then position within equal contexts
            same = np.zeros(len(order), bool)
            same[1:] = whole[order][1:] == whole[order][:-1]
            first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            row = np.full(len(order), -1)  # of a member, the anchor that stands for it
            gone = np.zeros(len(order), bool)
            for a, b in zip(order[same].tolist(), first[same].tolist()):
                _, (x, start_x, end_x), *_ = held[which[a]]
                _, (y, start_y, end_y), *_ = held[which[b]]
                p, q = int(pos[a]), int(pos[b])
                lo, hi, low, high = max(0, p - width + 1), min(len(end_x), p + length), max(0, q - width + 1), min(len(end_y), q + length)
                if (doc[a], p) == (doc[b], q):  # one document twice: the same place
                    gone[a] = True
                elif p - lo == q - low and hi - p == high - q and x[start_x[lo] : end_x[hi - 1]] == y[start_y[low] : end_y[high - 1]]:
                    gone[a] = True
                    if hi - lo >= length:
                        row[a] = b
            keep = ~gone
            member = np.flatnonzero(row >= 0)
            member = member[np.argsort(row[member], kind="stable")]
            more = np.stack([doc[member] - doc[row[member]], pos[member] - pos[row[member]]], 1).astype(np.int64)
            ends = np.cumsum(16 * np.bincount(row[member], minlength=len(row))[keep])
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            members = pa.Array.from_buffers(pa.binary(), int(keep.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(more.tobytes())])
            return pa.record_batch([key[keep].view(np.int64), doc[keep], pos[keep].astype(np.int32), members], schema=ANCHOR)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text or len(text) < length:
                    continue
                values, start, end = kind.measured(text, power)
                n = len(values)
                if n < length:
                    continue
                power.to(n + 1)
                sums = np.zeros(n + 1, U)
                np.cumsum(values * power.down[:n], out=sums[1:])
                h = mixed((sums[seed:] - sums[:-seed]) * power.up[: n - seed + 1])
                least = sliding(h, width, np.minimum)
                pad = np.zeros(width - 1, U)
                at = np.flatnonzero(h == sliding(np.concatenate([pad, least, pad]), width, np.maximum))
                lo, hi = np.maximum(at - width + 1, 0), np.minimum(at + length, n)
                whole = mixed((sums[hi] - sums[lo]) * power.up[lo] + (at - lo).astype(U) * U(_INVERSE) + (hi - at).astype(U))
                key = h[at]
                if levels:
                    top = np.zeros(len(at), U)
                    for i in range(levels):
                        top = (top << U(16)) | (mixed((sums[at + i + 1] - sums[at]) * power.up[at]) >> U(48))
                    key = (top << U(64 - 16 * levels)) | (key >> U(16 * levels))
                held.append((doc_id, (text, start, end), at, key, whole))
                size += len(text) + 48 * max(0, len(at) - len(text) // 16)
                if size > _FLUSH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return _texts(docs).where("doc_id is not null").mapInArrow(scan, ANCHOR_DDL)


def repeated(found: DataFrame, most: int = MOST) -> DataFrame:
    """Anchors whose key is met at least twice or that have members, and whether the key has more than ``most`` rows."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, hot_key = None, None  # the rows of the last key, unless it is known to be hot

        def out(batch: pa.RecordBatch, keep: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
            full = pa.record_batch([*batch.columns, pa.array(hot)], names=[*batch.schema.names, "hot"])
            return full.filter(pa.array(keep))

        for batch in batches:
            if not batch.num_rows:
                continue
            if tail is not None:
                batch = pa.concat_batches([tail, batch])
            key = batch.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            size = np.diff(cut)
            hot = size > most
            hot[0] |= hot_key is not None and int(key[0]) == hot_key
            at = np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset :][: len(key) + 1]
            keep = np.repeat(hot | (size > 1), size) | (np.diff(at) > 0)
            each = np.repeat(hot, size)
            if hot[-1]:
                hot_key, tail = int(key[-1]), None
                yield out(batch, keep, each)
            else:
                last = int(cut[-2])
                tail = batch.slice(last)
                yield out(batch.slice(0, last), keep[:last], each[:last])
        if tail is not None:
            n = tail.num_rows
            at = np.frombuffer(tail.column(3).buffers()[1], np.int32)[tail.column(3).offset :][: n + 1]
            yield out(tail, (np.diff(at) > 0) | (n > 1), np.zeros(n, bool))

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(stream, PLACE_DDL)


def _by_doc(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, text, at): texts with their places; the text is null where there is none."""
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "pos", "members")).alias("at"))
    # a left join like that of apply(): an inner one would filter the texts first, and Spark shuffle them twice
    return _texts(docs).join(by_doc, "doc_id", "left").select("doc_id", F.when(F.col("at").isNotNull(), F.col("text")).alias("text"), "at")


def _cut(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[tuple[list, list[int], pa.Array, np.ndarray]]:
    """(texts, how many places in each, the places, their doc_ids) of rows as of ``_by_doc``, some ``rows`` places at a time."""
    for batch in batches:
        lists = batch.column(2)
        valid = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array(valid))
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        flat, ids = lists.flatten(), batch.column(0).to_numpy()
        lo = 0
        while lo < len(ends):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + rows, "right")))
            counts = np.diff(ends[lo:hi], prepend=before)
            yield batch.column(1).slice(lo, hi - lo).to_pylist(), counts.tolist(), flat.slice(before, int(ends[hi - 1]) - before), np.repeat(ids[lo:hi], counts)
            lo = hi


def contexts(docs: DataFrame, places: DataFrame, tokens: Callable, length: int, seed: int) -> DataFrame:
    """The text around each place: ``right`` from the anchor on, ``left`` read backwards from it."""
    reach = length - seed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokens()
        for texts, counts, at, ids in _cut(batches):
            key, pos, members = (at.field(i) for i in range(3))
            places, right, left, lo = pos.to_pylist(), [], [], 0
            for text, n in zip(texts, counts):
                items = kind.split(text)
                for p in places[lo : lo + n]:
                    right.append(kind.right(items, p, p + length))
                    left.append(kind.left(items, max(0, p - reach), p))
                lo += n
            yield pa.record_batch([key, pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(ids), pos, members], names=["key", "right", "left", "doc_id", "pos", "members"])

    return _by_doc(docs, places).mapInArrow(cut, CONTEXT_DDL)


def shared(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many leading values the rows of two matrices share, of rows of n and m values."""
    differ = a != b
    at = differ.argmax(1)
    return np.minimum(np.where(differ[np.arange(len(at)), at], at, a.shape[1]), np.minimum(n, m))


Nodes = Callable[[list[int], int], tuple[list[int], list[int], list[int]]]


def taken(right: tuple, left: tuple, new: np.ndarray, rank: np.ndarray, length: int, nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): how far the stretch that each row loses reaches from its anchor; 0, 0 where it loses nothing.

    right, left: matrices and sizes of contexts, sorted by right, then left, within each key; ``new`` marks a key's first row;
    ``rank``: the order of (doc_id, pos). Rows of equal context are one leaf; its first row stands for it, the others lose
    the whole context. ``nodes(depths, least)`` names the nodes of ``least`` depth or more, as (depth, first leaf, last leaf +
    1), from the common depth of each leaf and the one before. Under a node of depth d a leaf loses, for the earlier leaf
    that shares most on the left, b, the stretch of b and d around its anchor, if that is long enough.
    """
    (r, nr), (s, ns) = right, left
    depth, back = np.zeros(len(nr), int), np.zeros(len(nr), int)
    depth[1:], back[1:] = shared(r[:-1], r[1:], nr[:-1], nr[1:]), shared(s[:-1], s[1:], ns[:-1], ns[1:])
    depth[new] = 0
    same = np.zeros(len(nr), bool)
    same[1:] = ~new[1:] & (depth[1:] == nr[1:]) & (nr[1:] == nr[:-1]) & (back[1:] == ns[1:]) & (ns[1:] == ns[:-1])
    at = np.flatnonzero(~same)
    leaf = np.cumsum(~same) - 1
    first = np.minimum.reduceat(rank, at)
    s, ns = s[at], ns[at]
    far_left, far_right = np.zeros(len(at), int), np.zeros(len(at), int)

    def lose(x: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        np.maximum.at(far_left, x, b)
        np.maximum.at(far_right, x, d)

    d, lo, hi = (np.array(x, int) for x in nodes(depth[at].tolist(), length - s.shape[1]))
    two = hi - lo == 2
    x, y = lo[two], lo[two] + 1
    b = shared(s[x], s[y], ns[x], ns[y])
    good = d[two] + b >= length
    lose(np.where(first[x] > first[y], x, y)[good], b[good], d[two][good])
    d, lo, hi = d[~two], lo[~two], hi[~two]
    if len(d):
        place = np.empty(len(at), int)  # in the order of the left sides
        place[np.lexsort((ns, _sortable(s)))] = np.arange(len(at))
        held = np.cumsum(hi - lo)
        i = 0
        while i < len(d):  # some nodes at a time
            j = max(i + 1, int(np.searchsorted(held, (held[i - 1] if i else 0) + 300_000, "right")))
            size = (hi - lo)[i:j]
            node = np.repeat(np.arange(j - i), size)
            x = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[i:j], size)
            order = np.argsort(node * len(at) + place[x])
            node, x = node[order], x[order]
            b = np.full(len(x), -1)
            b[1:] = shared(s[x[:-1]], s[x[1:]], ns[x[:-1]], ns[x[1:]])
            of = d[i:j][node]
            joined = np.zeros(len(x) + 1, bool)
            joined[1:-1] = (node[1:] == node[:-1]) & (of[1:] + b[1:] >= length)
            some = joined[:-1] | joined[1:]  # in a run of leaves that share enough
            x, b, of, starts = x[some], b[some], of[some], ~joined[:-1][some]
            got = _earlier(first[x].tolist(), b.tolist(), starts.tolist())
            got = np.maximum(got, _earlier(first[x][::-1].tolist(), np.roll(b, -1)[::-1].tolist(), np.roll(starts, -1)[::-1].tolist())[::-1])
            good = got >= 0
            lose(x[good], got[good], of[good])
            i = j
    whole = nr + (left[1]) >= length
    is_first = rank == first[leaf]
    return np.where(is_first, far_left[leaf], np.where(whole, left[1], 0)), np.where(is_first, far_right[leaf], np.where(whole, nr, 0))


def _sortable(s: np.ndarray) -> np.ndarray:
    """The rows as byte strings whose order is that of the rows."""
    s = np.ascontiguousarray(s if s.dtype == np.uint8 else s.astype(">i4"))
    return s.view(f"S{s.shape[1] * s.itemsize}").ravel()


def _earlier(rank: list[int], shared_with_last: list[int], starts: list[bool]) -> np.ndarray:
    """For each leaf of runs, what it shares with the nearest one before it that has a lower rank; -1 if there is none."""
    out, stack = [], []
    for i, (k, b, start) in enumerate(zip(rank, shared_with_last, starts)):
        if start:
            stack = [(k, 0)]
            out.append(-1)
            continue
        while stack and stack[-1][0] > k:
            b = min(b, stack.pop()[1])
        out.append(b if stack else -1)
        stack.append((k, b))
    return np.array(out, int)


def spans_of(nodes: Nodes, tokens: Callable, length: int, seed: int):
    """What ``mapInArrow`` applies to contexts sorted by key, right and left: the spans that the nodes take."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key, doc, pos = (table.column(c).to_numpy() for c in ("key", "doc_id", "pos"))
        right, left, members = (table.column(c).chunk(0) for c in ("right", "left", "members"))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        order = np.lexsort((pos, doc))
        step = np.zeros(len(key), int)
        step[1:] = (doc[order][1:] != doc[order][:-1]) | (pos[order][1:] != pos[order][:-1])
        rank = np.empty(len(key), int)
        rank[order] = np.cumsum(step)
        right, left = tokens.matrix([right, left], [length, length - seed])
        b, d = taken(right, left, new, rank, length, nodes)
        some = d > 0
        data, at = _buffers(members)
        n = np.diff(at) // 16
        of = np.repeat(np.arange(len(n)), n)
        more = np.frombuffer(data.tobytes(), np.int64).reshape(-1, 2)
        at = pos[of] + more[:, 1]
        lo, hi = np.concatenate([(pos - b)[some], at - left[1][of]]), np.concatenate([(pos + d)[some], at + right[1][of]])
        return pa.record_batch([np.concatenate([doc[some], doc[of] + more[:, 0]]), lo.astype(np.int32), hi.astype(np.int32)], schema=SPAN)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > CHUNK:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                others = np.flatnonzero(key != key[-1])
                last = int(others[-1]) + 1 if len(others) else 0  # the last key may go on
                if last:
                    yield solve(table.slice(0, last))
                held, n = table.slice(last).to_batches(), len(key) - last
        if n:
            yield solve(pa.Table.from_batches(held))

    return walk


def level_spans(docs: DataFrame, places: DataFrame, tokens: Callable, length: int, seed: int) -> DataFrame:
    """Spans of hot places: all leaves but the first of each window, of all levels of the tree, by Spark's aggregates."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokens()
        for texts, counts, at, ids in _cut(batches, 500):
            doc, rows = ids.tolist(), []
            places, members, i = at.field(1).to_pylist(), at.field(2).to_pylist(), 0
            for text, n in zip(texts, counts):
                items = kind.split(text)
                for p in places[i : i + n]:
                    more = [(0, 0), *np.frombuffer(members[i], np.int64).reshape(-1, 2).tolist()]
                    for lo in range(max(0, p - (length - seed)), min(p, len(items) - length) + 1):
                        node = hashlib.md5(kind.right(items, lo, lo + length)).digest()
                        rows += [(node, doc[i] + d, lo + q) for d, q in more]
                    i += 1
                    if len(rows) > 50_000:
                        yield pa.record_batch([list(c) for c in zip(*rows)], schema=WINDOW)
                        rows = []
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], schema=WINDOW)

    windows = stored(_by_doc(docs, places).mapInArrow(cut, WINDOW_DDL), "levels")
    first = windows.groupBy("node").agg(F.min(F.struct("doc_id", "pos")).alias("x")).select("x.*")
    return windows.join(first, ["doc_id", "pos"], "left_anti").select("doc_id", "pos", (F.col("pos") + length).alias("stop"))


def all_spans(docs: DataFrame, tokens: Callable, length: int, seed: int, nodes: Nodes, levels: int = 0, deal: Callable[[DataFrame], DataFrame] | None = None, most: int = MOST) -> DataFrame:
    """(doc_id, pos, stop): stretches covered by windows met earlier; they may overlap. ``deal`` gives places the keys of groups."""
    places = stored(repeated(anchors(docs, tokens, length, seed, levels), most), "repeats")
    usual, hot = places.where("not hot").drop("hot"), places.where("hot").drop("hot")
    rows = contexts(docs, deal(usual) if deal else usual, tokens, length, seed)
    found = rows.repartition("key").sortWithinPartitions("key", "right", "left").mapInArrow(spans_of(nodes, tokens, length, seed), SPAN_DDL)
    return found if hot.isEmpty() else found.unionByName(level_spans(docs, hot, tokens, length, seed))


def _texts(docs: DataFrame) -> DataFrame:
    """One shape of the texts for both joins, so that Spark reuses one exchange."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((doc_id, text), names): the documents, and (doc_id, id) if their ids are replaced by numbers.

    Places and spans are joined with texts by doc_id, so it must name one text. Where an id has several, its texts are
    numbered in the order of (doc_id, SHA-256 of the text); equal rows share a number, and rows without an id stay without.
    """
    slim = docs.select("doc_id", "text")
    known = slim.where("doc_id is not null").withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    if known.groupBy("doc_id").agg((F.min("sha") != F.max("sha")).alias("several")).where("several").isEmpty():
        return slim, None
    names = stored(known.select("doc_id", "sha").distinct().orderBy("doc_id", "sha").select(F.col("doc_id").alias("id"), "sha", F.monotonically_increasing_id().alias("doc_id")), "names")
    told = known.withColumnRenamed("doc_id", "id").join(names, ["id", "sha"]).select("doc_id", "text")
    return stored(told.unionByName(slim.where("doc_id is null")), "rows"), names.drop("sha")


def named(result: DataFrame, names: DataFrame | None) -> DataFrame:
    """``result`` with the ids that ``told_apart`` replaced."""
    if names is None:
        return result
    return result.join(names, "doc_id", "left").select(*[F.col("id").alias(c) if c == "doc_id" else c for c in result.columns])


def apply(docs: DataFrame, spans: DataFrame, digest: Callable[[bytes | None, list[tuple[int, int]]], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """One row per document from its text and its merged spans."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, *digest(text.as_py(), merged([(x["pos"], x["stop"]) for x in at.as_py() or ()])))
                for doc_id, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2))
            ]
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows)], schema=schema)

    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "stop")).alias("at"))
    return _texts(docs).join(by_doc, "doc_id", "left").select("doc_id", "text", "at").mapInArrow(finish, ddl)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
