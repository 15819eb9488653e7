"""Operators 1, 4, 6, 8 and 9 against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lexloom.llm import _repeats as R
from lexloom.llm import near_dedup as near
from lexloom.llm import substring_dedup as sub
from lexloom.llm import suffix_array_dedup as suffix
from lexloom.llm._tables import shared_dir
from lexloom.llm.components import connected_components
from lexloom.llm.decontamination import decontaminate, without_hits
from lexloom.llm.exact_dedup import exact_dedup
from lexloom.llm.near_dedup import near_dedup
from lexloom.llm.substring_dedup import substring_dedup
from lexloom.llm.suffix_array_dedup import suffix_array_dedup

#: Columns whose names the operators use inside.
CLASHING = "doc_id long, text string, h string, pos int, key string, kept boolean, component string"


def corpus() -> dict[int, str | None]:
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)] + ["é%d" % i for i in range(40)] + ["A\x01B", "\x02"]
    draw = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, long = draw(60), draw(3000)
    docs: dict[int, str | None] = {0: None, 1: "", 2: " \t\n", 3: "one", 4: "One", 5: "a b c d", 6: "a b  c d"}
    for i in range(10, 20):
        docs[i] = f"{draw(rng.randint(5, 90))} {passage} {draw(rng.randint(0, 60))}"
    docs |= {20: long, 21: long + " " + draw(30), 22: docs[10], 23: docs[10] + " ", 24: docs[10].upper()}
    docs |= {30: "ab " * 300, 31: "ab " * 150 + "x", 32: "a" * 1000, 33: "a" * 120, 34: "\x00" * 250}
    base = draw(200).split()
    for i in range(40, 52):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(200)] = rng.choice(vocabulary)
        docs[i] = " ".join(w)
    docs[60] = passage
    return docs


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def table(spark, docs):
    rows = [(i, t, "x", 1, "k", True, "c") for i, t in docs.items()]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


def marked(seqs, length):
    """Places covered by a window that starts earlier."""
    seen, out = set(), {}
    for i, s in sorted(seqs.items()):
        gone = [False] * len(s)
        for j in range(len(s) - length + 1):
            w = tuple(s[j : j + length])
            if w in seen:
                gone[j : j + length] = [True] * length
            seen.add(w)
        out[i] = gone
    return out


def test_substring_dedup(table, empty, docs):
    seqs = {i: (t or "").encode().split() for i, t in docs.items()}
    gone = marked(seqs, 20)
    got = {r.doc_id: r for r in substring_dedup(table).collect()}
    assert set(got) == set(docs)
    for i, s in seqs.items():
        kept = b" ".join(w for w, x in zip(s, gone[i]) if not x)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].kept_text) == (len(s), sum(gone[i]), hashlib.sha256(kept).hexdigest(), kept.decode()), i
    assert substring_dedup(empty).collect() == []


def test_prefix_groups_do_not_change_the_result(table):
    one = {(r.doc_id, r.pos, r.stop) for r in sub.spans(table, 20).collect()}
    many = {(r.doc_id, r.pos, r.stop) for r in sub.spans(table, 20, rows_per_group=7).collect()}
    assert one == many


def covered(spans):
    return {(r.doc_id, i) for r in spans.collect() for i in range(r.pos, r.stop)}


def test_hot_grams_are_solved_level_by_level_alike(table):
    for spans in (sub.spans, suffix.spans):
        assert covered(spans(table)) == covered(spans(table, most=3))


def test_copies_of_a_batch_are_members_of_one_leaf(table):
    leaves = R.anchors(table, R.Words, 20, 4).collect()
    assert any(r.members for r in leaves) and set(leaves[0].asDict()) == {"key", "doc_id", "pos", "members"}


def test_a_cluster_without_a_shared_folder_is_refused():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


@pytest.mark.parametrize("seed", range(4))
def test_nodes_against_pairs(seed):
    """What ``taken`` reads from either tree is what all pairs of contexts give."""
    rng = random.Random(seed)
    length, reach, n = 12, 9, 120
    text = lambda k: bytes(rng.choices(b"ab", [9, 1], k=k))
    rows = sorted((rng.randrange(3), b"abc"[: 3] + text(rng.choice([9, 9, 9, 4])), text(rng.choice([9, 9, 2])), i) for i in range(n))
    order = rng.sample(range(n), n)
    key, rank = R.np.array([x[0] for x in rows]), R.np.array([order[x[3]] for x in rows])
    new = R.np.append(True, key[1:] != key[:-1])
    right, left = R.Bytes.matrix([R.pa.array([x[i] for x in rows], R.pa.binary()) for i in (1, 2)], [length, reach])
    same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = []
    for i in range(n):
        reached = [(same(rows[i][2], rows[j][2]), same(rows[i][1], rows[j][1])) for j in range(n) if key[i] == key[j] and rank[j] < rank[i]]
        reached = [x for x in reached if sum(x) >= length]
        want.append((max((x[0] for x in reached), default=0), max((x[1] for x in reached), default=0)))
    for nodes in (sub.deep_nodes, suffix.intervals):
        b, d = R.taken(right, left, new, rank, length, nodes)
        assert list(zip(b.tolist(), d.tolist())) == want


def test_suffix_array_dedup(table, empty, docs):
    seqs = {i: (t or "").encode() for i, t in docs.items()}
    gone = marked(seqs, 100)
    got = {r.doc_id: r for r in suffix_array_dedup(table).collect()}
    for i, s in seqs.items():
        kept = bytes(b for b, x in zip(s, gone[i]) if not x)
        runs = len(re.findall("x+", "".join("x" if x else "." for x in gone[i])))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, bytes(got[i].kept)) == (len(s), sum(gone[i]), runs, hashlib.sha256(kept).hexdigest(), kept), i
    assert suffix_array_dedup(empty).collect() == []


def test_exact_dedup(table, empty, docs):
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append(i)
    got = {r.doc_id: r for r in exact_dedup(table).collect()}
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(docs[i] or ""), i))
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()), i
    assert exact_dedup(empty).collect() == []


def components(sets):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def shingle_sets(docs):
    words = {i: (t or "").encode().lower().split() for i, t in docs.items()}
    return {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}


def check_near(got, docs):
    sets = shingle_sets(docs)
    want = components(sets)
    for i in docs:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i), i


def test_near_dedup(table, empty, docs):
    check_near({r.doc_id: r for r in near_dedup(table).collect()}, docs)
    assert near_dedup(empty).collect() == []


def test_near_dedup_in_small_blocks_and_branches(spark, monkeypatch):
    """Links are the same when clusters are compared in blocks and nodes branch at once."""
    rng = random.Random(4)
    base = [f"v{i}" for i in range(120)]
    docs = {i: " ".join(base[:k] + [f"r{rng.randrange(9)}x{i}" for _ in range(120 - k)]) for i, k in enumerate([120, 118, 116, 110, 100, 90, 60, 20, 0, 0, 119, 117])}
    monkeypatch.setattr(near, "BLOCK", 3)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    check_near({r.doc_id: r for r in near_dedup(df).collect()}, docs)
    sig = near.np.frombuffer(near.np.random.default_rng(1).bytes(600 * 64), near.np.uint8).reshape(600, 64).copy()
    sig[:40] = sig[0]
    parts = near.Parts(600)
    near.branch(sig, near.np.arange(600), parts, 11)
    assert len({parts.root(i) for i in range(40)}) == 1 and len({parts.root(i) for i in range(600)}) == 561


def family(rng, n, words, low, high):
    """Texts that differ from one text in so many words that some are linked by 0.75 to 0.80, some barely not."""
    base = [f"b{i}" for i in range(words)]
    out = {}
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words), rng.randint(low, high)):
            w[k] = f"x{rng.randrange(10**9)}"
        out[i] = " ".join(w)
    return out


def test_a_cluster_of_many_blocks_and_parts_is_whole(spark, monkeypatch):
    """Rounds over blocks give the components of all pairs: a large part, small parts, single documents."""
    rng = random.Random(12)
    monkeypatch.setattr(near, "BLOCK", 8)
    docs = family(rng, 60, 200, 0, 9)
    docs |= {100 + i: t for i, t in family(rng, 30, 200, 9, 13).items()} | {200: " ".join(docs[0].split()[:150])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    one = spark.createDataFrame([(i, 0) for i in docs], "node long, component long")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in shingle_sets(docs).items()], "node long, n long")
    found = {r.node: r.component for r in connected_components(near.cluster_links(df, one, sizes)).collect()}
    want = components(shingle_sets(docs))
    assert {i: found.get(i, i) for i in docs} == want and len(set(want.values())) > 3


def test_recall_of_links_in_a_large_node():
    """Sets of one node of 800, in pairs of similarity 0.75 to 0.80: branching and signatures keep the links."""
    rng = near.np.random.default_rng(13)
    common = rng.integers(0, 2**63, 260, dtype=near.U)
    sets, wanted = [], []
    for pair in range(400):
        both = near.np.concatenate([common, rng.integers(0, 2**63, 140, dtype=near.U)])
        k = int(rng.integers(50, 67))  # 400 shared, k own each: 400 / (400 + 2k)
        sets += [near.np.concatenate([both, rng.integers(0, 2**63, k, dtype=near.U)]) for _ in range(2)]
        if 100 * 400 >= 75 * (400 + 2 * k):
            wanted.append((2 * pair, 2 * pair + 1))
    sig = near.np.array([(R.mixed(((s[:, None] ^ near._FLIP) * near._MULTIPLY).min(0)) >> near.U(56)).astype(near.np.uint8) for s in sets])
    parts = near.Parts(800)
    near.branch(sig, near.np.arange(800), parts, 5)
    met = sum(parts.root(i) == parts.root(j) for i, j in wanted)
    assert len(wanted) > 300 and met / len(wanted) >= 0.99, met / len(wanted)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (5, 5), (7, 3), (None, 4)], "u long, v long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 9: 8, 8: 8}
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.component for r in connected_components(path).collect()} == {0}


def contamination(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = defaultdict(set)
    for item, t in items:
        w = words(t)
        for j in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[j : j + n])].add(item)
    out = {}
    for i, t in docs.items():
        w = words(t)
        hit, found = set(), set()
        for size in {len(g) for g in grams}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in grams:
                    hit |= set(range(j, j + size))
                    found |= {x for x in grams[tuple(w[j : j + size])] if x is not None}
        out[i] = (len(w), hit, found, [x for j, x in enumerate(w) if j not in hit])
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination(spark, table, empty, docs, most):
    passage = docs[60].split()
    items = [(1, " ".join(passage[5:30]).upper()), (2, " ".join(passage[20:33])), (10, "One"), (3, None), (4, "..."), (5, "b, c"), (5, "b, c"), (None, "ab ab"), (6, "nowhere to be seen")]
    benchmark = spark.createDataFrame([(i, t, "w", "h") for i, t in items], "item_id long, text string, w string, gram string")
    want = contamination(docs, items)
    got = {r.doc_id: r for r in decontaminate(table, benchmark, broadcast_grams=most).collect()}
    for i, (n, hit, found, clean) in want.items():
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, len(hit), len(found), digest, bool(hit)), i
    if most:
        clean = {r.doc_id: r.clean_words for r in without_hits(table, benchmark).collect()}
        assert clean == {i: want[i][3] for i in docs}
        assert decontaminate(empty, benchmark).collect() == []
        assert not any(r.contaminated for r in decontaminate(table, benchmark.where("false")).collect())


def test_rows_without_or_with_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    taken = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in substring_dedup(df).collect())
    assert taken == [(False, 0, 0), (True, 1, 0), (True, 1, 0), (True, 2, 60)]
    assert sorted(r.n_removed for r in suffix_array_dedup(df).collect()) == [0, 0, 0, len(text)]
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup(df).collect() if r.doc_id) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert [(r.component_id, r.kept) for r in near_dedup(df).collect() if r.doc_id is None] == [(None, True)]
    assert sorted((r.doc_id or 0, r.keep_id, r.kept) for r in exact_dedup(df).collect()) == [(0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert len(decontaminate(df, spark.createDataFrame([(1, text)], "item_id long, text string")).collect()) == 4


def test_texts_that_share_a_doc_id_are_told_apart(spark):
    draw = lambda k: " ".join(f"{k}{i}" for i in range(60))
    x, y, z = draw("x"), draw("y"), draw("z")
    rows = [(1, x), (2, x), (2, y), (2, y), (3, y + " " + z), (None, z), (-4, z), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(df).collect())
    assert got == [(-4, 60, 0), (0, 60, 0), (1, 60, 0), (2, 60, 0), (2, 60, 0), (2, 60, 60), (3, 120, 120), (4, 0, 0), (4, 0, 0)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_array_dedup(df).collect())
    n = len(x)
    assert [g for g in got if g[0] in (1, 2)] == [(1, n, 0, 0), (2, n, 0, 0), (2, n, 0, 0), (2, n, n, 1)]
    assert [g[2] for g in got if g[0] == 3] == [2 * n]


def test_texts_pass_a_filter_that_loses_none(spark):
    texts = spark.sql("select cast(id as long) doc_id, 'x' text from range(-50, 20000) union all select null, 'y'")
    ids = spark.sql("select explode(array(-50, -1, 0, 7, 19999, 7)) node").withColumn("node", F.col("node").cast("long"))
    got = {r.doc_id for r in near._likely(texts, ids).collect()}
    assert got >= {-50, -1, 0, 7, 19999} and len(got) < 50
    assert near._likely(texts, ids.where("false")).collect() == []
