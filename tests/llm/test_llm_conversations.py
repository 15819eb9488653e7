import hashlib
import heapq
import itertools
import random
import zlib

import pytest

from lexloom.llm import conversation_repair as C
from lexloom.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def grammar(initials: str) -> bool:
    body = initials.removeprefix("s")
    return initials == "" or (body != "" and body == "ua" * (len(body) // 2))


def cheapest(rows):
    """(cost, audit, repaired) by a uniform-cost search over whole edit strings; rows: (role, text, fault)."""
    step = {"": "u", "s": "u", "a": "u", "u": "a"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        new = step[last]
        name = "user" if new == "u" else "assistant"
        heapq.heappush(heap, (cost + 3, audit + "I", i, new, (*out, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                cut = 3 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + cut, audit + "R", i + 1, new, (*out, f"{name}:{text}")))
                first = role[:1]
                if first in "sua" and first != "" and (first == new or (first == "s" and last == "")):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, first, (*out, f"{role}:{text}")))
    raise AssertionError


def brute(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            if kind:
                text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
                rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        said, marked = set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            marked.append((role, text, "blank" if not bare else "duplicate" if (role, text) in said else "truncated" if bare[-1] not in ".!?" else ""))
            said.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, done = cheapest(marked)
        assert grammar("".join(x[:1] for x in done))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked)), cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest(),
        )
    return out


def test_the_trie_finds_what_a_search_over_edit_strings_finds():
    rng = random.Random(5)
    signatures = {"".join(p) for n in range(4) for p in itertools.product("xsuaoSUAO", repeat=n)}
    signatures |= {"".join(rng.choice("xsuaoSUAOuaua") for _ in range(rng.randint(4, 12))) for _ in range(400)}
    trie = C.Trie()
    roles = {"x": "user", "s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for signature in sorted(signatures):
        rows = [(roles[c.lower()], "", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in signature]
        assert trie.answer(signature) == cheapest(rows)[:2], signature
    assert len(trie.known.layers) < 200
    steps = len(trie.known.steps)
    assert trie.answer("ua" * 50_000) == (0, "K" * 100_000) and len(trie.known.steps) - steps < 10


def table(n=60):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "So", "", " \n", "Yes. ", "trail\t", "ends…", "x" * 50_000 + ".", None, "a.b", "...", "ünï."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2", " "]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, t + 1, t * 3, None]), rng.choice(roles[: rng.choice([3, 10])]), rng.choice(texts)))
    rows += [(None, t, "user", "Hm.") for t in range(5)] + [rows[0]] * 4 + [(n, t, "user" if t % 2 else "assistant", f"t{t % 40}.") for t in range(300)]
    return rows + [(10_000 + i, i, "user", "Yes.") for i in range(40)]


@pytest.mark.parametrize("piece", [1 << 20, 3])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    rows = table()
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS audit", "2 AS copies").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_repair_returns_the_rows(spark):
    rows = [(1, 0, "system", "Be good.", 1), (1, 1, "user", "Hi?", 2), (1, 2, "user", "Well?", 1), (2, 0, "user", "Gone.", 0)]
    report, out = C.repair(spark.createDataFrame(rows, SCHEMA + ", copies long"))
    assert [(r.edit, r.role, r.text) for r in sorted(out.collect(), key=lambda r: r.place)] == [("K", "system", "Be good."), ("K", "user", "Hi?"), ("R", "assistant", "Well?")]
    assert {r.conv_id: (r.cost, r.audit, r.duplicate) for r in report.collect()} == {1: (7, "KKDR", 1), 2: (0, "", 0)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op12_conversation_repair(spark, str(tmp_path)).count() == 0
