"""Operator 6, suffix-array dedup: a common-prefix interval tree over the bytes of all texts.

The suffixes that begin at anchors (see ``_repeats``), sorted by Spark, are a sparse suffix array; with the common
prefix of neighbours it is enhanced. A scan with a stack gives the tree of common-prefix intervals. An interval's
occurrences are tested for left-extension diversity in the order of their left contexts: those that agree on enough
bytes to the left are a repeat group with all occurrences, and each but the first loses as much as it shares with an
earlier one. Copies met in one batch are one suffix with members, which the tree settles with it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm import _repeats as R

SEED = 24
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def intervals(depths: list[int], least: int) -> tuple[list[int], list[int], list[int]]:
    """(common prefix, first, last + 1) of each common-prefix interval of ``least`` or more; children come first.

    depths: the array's common prefixes, each of a suffix and the one before it.
    """
    tops: list[int] = []  # the open intervals, innermost last: common prefix, and first suffix
    lows: list[int] = []
    found: tuple[list[int], list[int], list[int]] = [], [], []
    for i, value in enumerate([*depths, 0]):
        low = i - 1
        while tops and tops[-1] > value:
            low = lows.pop()
            for column, x in zip(found, (tops.pop(), low, i)):
                column.append(x)
        if value >= least and (not tops or tops[-1] < value):
            tops.append(value)
            lows.append(low)
    return found


def spans(docs: DataFrame, length: int = 100, most: int = R.MOST) -> DataFrame:
    """(doc_id, pos, stop): stretches of bytes covered by strings met earlier; they may overlap."""
    return R.all_spans(docs, R.Bytes, length, SEED, intervals, most=most)


def suffix_array_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """Drop each UTF-8 byte covered by a ``length``-byte string that also starts earlier in (doc_id, position) order.

    docs: doc_id, text and any other columns, which are ignored. Returns doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and kept (the remaining bytes; a cut may fall inside a character), one row per input row.

    Null and empty texts have no bytes; texts under ``length`` bytes lose nothing. Rows without a doc_id lose nothing
    and take nothing. Rows of one doc_id with other
    texts are documents of their own, in the order of the texts' SHA-256; equal rows are one. An empty table gives an empty result. Documents
    of any length are read whole.
    """

    def digest(text: bytes | None, taken: list[tuple[int, int]]) -> tuple:
        text = text or b""
        kept, at = [], 0
        for lo, hi in taken:
            kept.append(text[at:lo])
            at = hi
        kept.append(text[at:])
        out = b"".join(kept)
        return len(text), len(text) - len(out), len(taken), R.sha256(out), out

    rows, names = R.told_apart(docs)
    return R.named(R.apply(rows, spans(rows, length), digest, OUT, OUT_DDL), names)
