"""Operator 12, conversation structure repair: dynamic programming shared along a prefix trie of signatures.

A conversation's signature has one symbol a row: its role's initial and its fault. Each distinct signature is solved once.
Sorted signatures are dealt to tasks by range; a task inserts each into a prefix trie, of which it holds the path to the
last signature. One layer of the dynamic programme (for each state of the role grammar, the cheapest edits so far) belongs
to each node of the path: layers of a shared prefix are computed once, and an answer is read off at each terminal node.

Layers are kept with costs and ties relative to their least, so that only few distinct ones exist; a node of the path is a
small integer. Rows are brought in order by a range shuffle on (conversation, turn, role, text), so the signature of a
conversation of any size is made by many tasks, in pieces. Only the repaired text goes by conversation, as a stream.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm._tables import stored

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Symbols of one piece of a signature.
PIECE = 1 << 20
#: Repaired rows and characters that are handed on at once.
BATCH_ROWS, BATCH_CHARS = 5_000, 8 << 20

# States of the role grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, S, U, A = range(4)
#: The role that comes next by insertion or rerole, and the state after it.
NEXT = [(U, "user"), (U, "user"), (A, "assistant"), (U, "user")]
#: Where keeping a row of an initial leads from each state; None where the grammar forbids it.
KEPT = {"s": [S, None, None, None], "u": [U, U, None, U], "a": [None, None, A, None], "o": [None] * 4}


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with seeded damage; copies is 0 for a dropped row, 2 for a repeated one."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, initial, fault) of (conv_id, turn, role, text, copies), equal rows summed up.

    fault is that of the first copy; further copies are duplicates, or blank. initial is o for any but s, u and a.
    """
    once = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    said = once.where("copies > 0").select("conv_id", "role", digest.alias("digest"), place.alias("place"))
    again = said.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stored(again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "digest", "first"), "said-again")
    both = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (digest == F.col("digest"))
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    head = F.substring("role", 1, 1)
    fault = F.when(last == "", "blank").when(F.col("first").isNotNull() & (place > F.col("first")), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return once.join(again, both, "left").select("conv_id", "turn", "role", "text", "copies", F.when(head.isin("s", "u", "a"), head).otherwise("o").alias("initial"), fault.alias("fault"))


PIECE_DDL = (
    "conv_id long, at long, signature string, n long, opening string, closing string, illegal long, blank long, duplicate long, truncated long,"
    " lo long, hi long, turns long"
)
_PIECE = pa.schema(
    [("conv_id", pa.int64()), ("at", pa.int64()), ("signature", pa.string()), ("n", pa.int64()), ("opening", pa.string()), ("closing", pa.string())]
    + [(c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated", "lo", "hi", "turns")]
)
LEGAL = {"su", "ua", "au"}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature pieces with their counts, of rows in order."""
    at = TaskContext.get().partitionId() << 32
    done: list[tuple] = []
    conv, signs, size, opening, closing, counts, lo, hi, turns = (), [], 0, "", "", {}, None, None, 0

    def close() -> None:
        nonlocal at
        if conv:
            done.append((conv[0], at, "".join(signs), size, opening, closing, *(counts[c] for c in ("illegal", "blank", "duplicate", "truncated")), lo, hi, turns))
            at += 1

    for batch in batches:
        for c, turn, copies, initial, fault in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if conv != (c,) or size >= PIECE:
                close()
                conv, signs, size, opening, closing, lo, hi, turns = (c,), [], 0, "", "", None, None, 0
                counts = dict.fromkeys(("illegal", "blank", "duplicate", "truncated"), 0)
            while copies:
                # a row that is repeated without end is cut into pieces too
                take = min(copies, PIECE)
                if size and size + take > PIECE:
                    close()
                    signs, size, opening, closing, lo, hi, turns = [], 0, "", "", None, None, 0
                    counts = dict.fromkeys(counts, 0)
                first = "x" if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial
                signs.append(first + "x" * (take - 1))
                if size:
                    counts["illegal"] += closing + initial not in LEGAL
                counts["illegal"] += take - 1
                if fault:
                    counts[fault] += 1
                counts["blank" if fault == "blank" else "duplicate"] += take - 1
                opening, closing = opening or initial, initial
                size += take
                copies -= take
                fault = "blank" if fault == "blank" else "duplicate"
                if turn is not None:
                    turns += turn != hi
                    lo, hi = turn if lo is None else lo, turn
        if done:
            yield pa.record_batch([list(c) for c in zip(*done)], schema=_PIECE)
            done = []
    close()
    if done:
        yield pa.record_batch([list(c) for c in zip(*done)], schema=_PIECE)


def signatures(marked: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal): one row for each conversation of ``faults``."""
    order = _order()
    rows = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = rows.select("conv_id", "turn", "copies", "initial", "fault").mapInArrow(_pieces, PIECE_DDL)
    each = F.struct("at", "signature", "n", "opening", "closing", "lo", "hi")
    sums = [F.sum(c).alias(c) for c in ("illegal", "blank", "duplicate", "truncated", "turns")]
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("p"), *sums, F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = whole.withColumn("p", F.filter("p", lambda x: x["n"] > 0))
    ahead = F.when(F.size("p") > 1, F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    count = lambda test: F.coalesce(F.size(F.filter(ahead, test)), F.lit(0)).cast("long")
    border = count(lambda x: ~F.concat(x["a"]["closing"], x["b"]["opening"]).isin(*LEGAL))
    shared = count(lambda x: F.coalesce(x["a"]["hi"] == x["b"]["lo"], F.lit(False)))
    distinct = F.col("turns") - shared
    gaps = F.when(F.col("lo").isNull(), F.lit(0)).otherwise(F.try_subtract(F.try_add(F.try_subtract("hi", "lo"), F.lit(1)), distinct))
    return whole.select(
        "conv_id", F.array_join(F.transform("p", lambda x: x["signature"]), "").alias("signature"), gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + border).alias("illegal"),
    )


class Layers:
    """The layers of the dynamic programme, numbered as they turn up, and the steps between them.

    A layer holds, for each state, None or (cost above the layer's least, rank, tail): (rank, tail) orders the edits so far
    as strings. Strings of which one begins another share a rank; their tails are insertions only, as both have read the
    same rows.
    """

    def __init__(self) -> None:
        self.layers: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, list]] = {}
        #: (layer, its least cost, state -> (state before, edits)) before any row
        self.first = self._closed({START: (0, (0, ""), None, "")})

    def _closed(self, arrived: dict[int, tuple]) -> tuple[int, int, list]:
        """Add insertions to what arrives (state -> cost, key, state before, edits) and number the layer."""
        found = dict(arrived)
        for _ in range(3):
            for state, (cost, (rank, tail), before, edits) in list(found.items()):
                to = NEXT[state][0]
                new = (cost + INSERT, (rank, tail + "I"), before, edits + "I")
                if to not in found or new[:2] < found[to][:2]:
                    found[to] = new
        # A can do all that the others can, but for keeping an s at the start, which is worth a deletion: states that are
        # dearer than that lead to no cheapest edits. Without them costs differ by few, so that layers recur
        for state, worth in ((START, DELETE), (S, 0)):
            if state in found and found[state][0] > found[A][0] + worth:
                del found[state]
        least = min(f[0] for f in found.values())
        layer: list = [None] * 4
        head, rank = None, -1
        for state, f in sorted(found.items(), key=lambda x: x[1][1]):
            key = f[1]
            if head is None or key[0] != head[0] or not key[1].startswith(head[1]):
                head, rank = key, rank + 1
            layer[state] = (f[0] - least, rank, key[1][len(head[1]) :])
        number = self.numbers.setdefault(tuple(layer), len(self.layers))
        if number == len(self.layers):
            self.layers.append(tuple(layer))
        return number, least, [(found[s][2], found[s][3]) if s in found else None for s in range(4)]

    def step(self, number: int, symbol: str) -> tuple[int, int, list]:
        """(next layer, cost added, back) for one more row."""
        got = self.steps.get((number, symbol))
        if got is None:
            arrived: dict[int, tuple] = {}

            def reach(state: int | None, cost: int, key: tuple, before: int, edit: str) -> None:
                new = (cost, (key[0], key[1] + edit), before, edit)
                if state is not None and (state not in arrived or new[:2] < arrived[state][:2]):
                    arrived[state] = new

            cut = TRUNCATED if symbol.isupper() else 0
            for state, entry in enumerate(self.layers[number]):
                if entry is not None:
                    cost, key = entry[0], entry[1:]
                    reach(state, cost + DELETE, key, state, "D")
                    if symbol != "x":
                        reach(KEPT[symbol.lower()][state], cost + KEEP + cut, key, state, "K")
                        reach(NEXT[state][0], cost + REROLE + cut, key, state, "R")
            got = self.steps[number, symbol] = self._closed(arrived)
        return got

    def best(self, number: int) -> tuple[int, int]:
        """(cost above the least, state) of the cheapest edits that the grammar accepts."""
        end, state = min((self.layers[number][s], s) for s in (START, A) if self.layers[number][s] is not None)
        return end[0], state


class Trie:
    """The path of a prefix trie to the last of sorted signatures, with a layer at each node."""

    def __init__(self) -> None:
        self.known = Layers()
        self.last = ""
        self.path = array("L", [self.known.first[0]])
        self.costs = array("q", [self.known.first[1]])

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of a signature; layers of the prefix that it shares with the last one are there already."""
        shared = len(os.path.commonprefix([self.last, signature]))
        del self.path[shared + 1 :], self.costs[shared + 1 :]
        number, total = self.path[-1], self.costs[-1]
        for symbol in signature[shared:]:
            number, cost, _ = self.known.step(number, symbol)
            total += cost
            self.path.append(number)
            self.costs.append(total)
        self.last = signature
        cost, state = self.known.best(number)
        edits = []
        for depth in range(len(signature), 0, -1):
            state, edit = self.known.steps[self.path[depth - 1], signature[depth - 1]][2][state]
            edits.append(edit)
        edits.append(self.known.first[2][state][1])
        return total + cost, "".join(reversed(edits))


def audits(signed: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature: the cheapest edits that give the role grammar, ties ASCII-least."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            found = [(s, *trie.answer(s)) for s in batch.column(0).to_pylist()]
            if found:
                yield pa.record_batch([list(c) for c in zip(*found)], names=["signature", "cost", "audit"])

    distinct = signed.select("signature").distinct()
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(solve, "signature string, cost long, audit string")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows, of rows in order with each conversation's audit before them."""
    names = ["conv_id", "place", "edit", "role", "text"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))))
    out: list[tuple] = []
    chars = 0
    conv, audit, at, place, state = None, "", 0, 0, START

    def put(edit: str, role: str, text: str) -> None:
        nonlocal place, chars
        out.append((conv, place, edit, role, text))
        place += 1
        chars += len(text)

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, role = NEXT[state]
            put("I", role, "")
            at += 1

    for batch in batches:
        for c, opens, given, role, text, copies, initial in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if opens:
                insert()
                conv, audit, at, place, state = c, given, 0, 0, START
                continue
            for _ in range(copies):
                insert()
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = KEPT[initial][state]
                    put("K", role, text)
                elif edit == "R":
                    state, new = NEXT[state]
                    put("R", new, text)
            if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield pa.record_batch([list(x) for x in zip(*out)], schema=schema)
                out, chars = [], 0
    insert()
    if out:
        yield pa.record_batch([list(x) for x in zip(*out)], schema=schema)


def repaired(marked: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows that the edits leave, each conversation's in order within one partition.

    marked: of ``faults``; answers: conv_id, audit. The audit comes first in its conversation's stream, so that no join
    copies it to every row. A conversation's rows pass one task, as a stream.
    """
    null = lambda t: F.lit(None).cast(t)
    heads = answers.select("conv_id", F.lit(True).alias("opens"), null("long").alias("turn"), F.col("audit"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), null("string").alias("initial"))
    rows = marked.where("copies > 0").select("conv_id", F.lit(False).alias("opens"), "turn", null("string").alias("audit"), "role", "text", "copies", "initial")
    first, *others = _order()
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(first, F.col("opens").desc(), *others)
    return both.select("conv_id", "opens", "audit", "role", "text", "copies", "initial").mapInArrow(_repaired, "conv_id long, place long, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` joined by newlines. rows: as ``repaired`` returns them, in their order."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = (), None
        for batch in batches:
            found = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != (c,):
                    if conv:
                        found.append((conv[0], sha.hexdigest()))
                    conv, sha = (c,), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if found:
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), [f[1] for f in found]], names=["conv_id", "repaired_sha256"])
        if conv:
            yield pa.record_batch([pa.array([conv[0]], pa.int64()), [sha.hexdigest()]], names=["conv_id", "repaired_sha256"])

    return rows.select("conv_id", "role", "text").mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, rows): each conversation's faults and cheapest edits, and its repaired rows.

    rows: conv_id, turn, role, text, copies (how often the row stands there; with 0 it only names its conversation), and any
    other columns, which are ignored. No value but conv_id and turn may be null (``damaged`` sees to that). Rows go by turn
    (nulls first); rows of one turn by role, then text, equal rows side by side. A null conv_id is a conversation like
    others. Blank rows are those without a character besides ASCII whitespace, the empty ones among them; texts of any
    length are read whole. Roles of other initials than s, u and a are never legal. gaps is null where it fits no long. An
    empty table gives an empty result.
    """
    marked = stored(faults(rows.select("conv_id", "turn", "role", "text", "copies")), "marked-turns")
    signed = stored(signatures(marked), "signatures")
    solved = stored(audits(signed), "audits")
    report = stored(signed.join(solved, "signature").drop("signature"), "repairs")
    return report, repaired(marked, report.where("audit <> ''").select("conv_id", "audit"))


def audit_conversations(conversations: DataFrame) -> DataFrame:
    """Damage conversations by their rows' checksums, repair them, and return each one's report with a digest of the result.

    conversations: conv_id, turn, role, text. Nulls count as one space, but a null turn stays one; see ``repair`` for ties,
    repeated rows and the rest. A conversation all of whose rows are dropped has zeros, an empty audit and the empty hash.
    """
    report, rows = repair(damaged(conversations))
    done = digests(rows).withColumnRenamed("conv_id", "c")
    empty = F.lit(hashlib.sha256().hexdigest())
    return report.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
