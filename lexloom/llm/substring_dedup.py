"""Operator 1, substring dedup: prefix-partitioned suffix trees over words.

Suffixes that begin at anchors (see ``_repeats``) are dealt to memory-sized groups by variable-length prefixes: the
key of an anchor is four 16-bit fields, hashes of its first one, two, three and four words; a group is a stretch of the
sorted keys, named by as many leading fields as tell it from the group before. One group's suffixes make one subtree; an
internal node whose depth plus the common left context of some of its leaves reaches ``length`` words is a maximal
repeat, and all of its leaves but the first lose it. Copies met in one batch are one leaf with members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm import _repeats as R

SEED = 4
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
OUT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


class Tree:
    """The suffix tree of sorted suffixes, grown one leaf at a time along its rightmost path.

    depths: what each suffix has in common with the one before it. ``nodes``: (depth, first leaf, last leaf + 1) of the
    internal nodes of ``least`` words or more.
    """

    def __init__(self, depths: list[int], least: int) -> None:
        self.nodes: list[tuple[int, int, int]] = []
        path: list[tuple[int, int]] = []  # (depth, first leaf) of the inner nodes above the last leaf, root first
        for leaf, depth in enumerate(depths):
            begins = leaf - 1
            while path and path[-1][0] > depth:
                below, begins = path.pop()
                self.nodes.append((below, begins, leaf))
            if depth >= least and (not path or path[-1][0] < depth):
                path.append((depth, begins))
        self.nodes += [(depth, begins, len(depths)) for depth, begins in reversed(path)]


def deep_nodes(depths: list[int], least: int) -> tuple[list[int], list[int], list[int]]:
    return tuple(map(list, zip(*Tree(depths, least).nodes))) or ([], [], [])


def prefix_groups(places: DataFrame, rows_per_group: int) -> DataFrame:
    """Places with the prefix of their group for a key: neighbours in the order of keys, ``rows_per_group`` or few more.

    A group ends where a key ends; from half its size on, where a leading word ends. Its prefix is as short as tells it
    from the group before: keys are sorted, so that equal prefixes are one stretch of one task.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, prefix, size = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            names, n = [], np.diff(cut)
            for k, rows in zip(key[cut[:-1]].tolist(), n.tolist()):
                if last is None:
                    prefix = k
                elif k != last and (size >= rows_per_group or 2 * size >= rows_per_group and k >> 48 != last >> 48):
                    field = next(f for f in (48, 32, 16, 0) if k >> f != last >> f)
                    prefix, size = k >> field << field, 0
                names.append(prefix)
                last, size = k, size + rows
            yield pa.record_batch([np.repeat(np.array(names, np.int64), n), *batch.columns[1:]], schema=R.ANCHOR)

    return places.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(stream, R.ANCHOR_DDL)


def spans(docs: DataFrame, length: int = 20, rows_per_group: int = 5_000, most: int = R.MOST) -> DataFrame:
    """(doc_id, pos, stop): stretches of words that are covered by windows met earlier; they may overlap."""
    return R.all_spans(docs, R.Words, length, SEED, deep_nodes, levels=SEED, deal=lambda places: prefix_groups(places, rows_per_group), most=most)


def substring_dedup(docs: DataFrame, length: int = 20) -> DataFrame:
    """Drop each word covered by a ``length``-word window whose words also start earlier in (doc_id, position) order.

    docs: doc_id, text and any other columns, which are ignored. Returns doc_id, n_words, n_removed, kept_sha256 and
    kept_text (the kept words joined by one space), one row per input row.

    Null or empty texts and texts of fewer than ``length`` words lose nothing; a null text has no words and an empty
    kept_text. Rows without a doc_id lose nothing and take nothing. Rows of one doc_id with other
    texts are documents of their own, in the order of the texts' SHA-256; equal rows are one.
    An empty table gives an empty result. Documents of any length are read whole.
    """

    def digest(text: bytes | None, taken: list[tuple[int, int]]) -> tuple:
        words = (text or b"").split()
        kept, at = [], 0
        for lo, hi in taken:
            kept += words[at:lo]
            at = hi
        kept += words[at:]
        out = b" ".join(kept)
        return len(words), len(words) - len(kept), R.sha256(out), out.decode()

    rows, names = R.told_apart(docs)
    return R.named(R.apply(rows, spans(rows, length), digest, OUT, OUT_DDL), names)
