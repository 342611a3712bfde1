import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshlark.llm import simhash
from meshlark.llm.bktree import BKForest, roots
from tests.llm.cases import DOCS, awkward, frame


def plain(text, k=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + k]).encode(), 42) for i in range(max(1, len(tokens) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(fps, radius):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius:
                    label[i] = min(label[i], label[j])
    return label


@given(st.one_of(st.none(), st.text(alphabet="aB c\t\né漢", max_size=60)))
def test_fingerprint_is_the_definition(text):
    raw = None if text is None else text.encode()
    assert simhash.fingerprint(raw)[0] == plain(text)
    assert simhash.fingerprint(raw, 4, 3)[0] == plain(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 63)), min_size=1, max_size=60), st.integers(0, 6))
def test_forest_finds_every_link(parts, radius):
    seeds = sorted({(s, v) for s, v, _, _ in parts} | {(s, v ^ (1 << a) ^ (1 << b)) for s, v, a, b in parts})
    shard, values = np.array([s for s, _ in seeds]), np.array([v for _, v in seeds], np.uint64)
    got = {(int(i), int(j)) for a, b in BKForest(values, shard).links(radius) for i, j in zip(a, b)}
    want = {(i, j) for j in range(len(seeds)) for i in range(j) if shard[i] == shard[j] and (seeds[i][1] ^ seeds[j][1]).bit_count() <= radius}
    assert got == want


def test_roots():
    assert roots(6, [(np.array([4, 1]), np.array([3, 4])), (np.array([5]), np.array([0]))]).tolist() == [0, 1, 2, 1, 1, 0]


def test_groups_match_brute_force_with_full_shards(spark):
    rng = np.random.default_rng(3)
    rows = awkward()
    for k in range(12):
        tokens = [f"t{x}" for x in rng.integers(0, 400, 150)]
        for v in range(8):
            tokens[int(rng.integers(0, 150))] = f"v{v}"
            rows.append((100 + 10 * k + v, " ".join(tokens), "en", "a", 1))
    fps = [plain(r[1]) for r in rows]
    label = closure(fps, 4)
    least = {}
    for r, g in zip(rows, label):
        least[g] = min(x for x in (least.get(g), r[0]) if x is not None) if r[0] is not None or least.get(g) is not None else None
    want = sorted(((r[0], f, least[g]) for r, f, g in zip(rows, fps, label)), key=str)
    for shard in (2048, 3):
        got = simhash.simhash_groups(frame(spark, rows), shard=shard).collect()
        assert sorted(((r.id, r.fp % 2**64, r.component) for r in got), key=str) == want


def near_copies(seed=9, groups=25, copies=4, n=200):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{x}" for x in rng.integers(0, 5000, n)]
        for c in range(copies):
            words = list(base)
            for at in rng.integers(0, n, c):  # c words replaced: Jaccard of about (196 - 5c) / (196 + 5c)
                words[at] = f"e{g}x{c}x{at}"
            rows.append((100 * g + c, " ".join(words), None, None, None))
    return rows


def test_wide_fingerprints_find_similar_texts(spark):
    rows = near_copies()
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [r[1].split()] for i in range(len(w) - 4)} for r in rows}
    for shard in (2048, 5):
        got = {r.id: r.component for r in simhash.simhash_groups(frame(spark, rows), shingle=5, similarity=0.8, shard=shard).collect()}
        close = [(a, b) for a in sets for b in sets if a < b and a // 100 == b // 100 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
        assert len(close) > 50 and np.mean([got[a] == got[b] for a, b in close]) > 0.9
        assert all(got[a] // 100 == a // 100 for a in got)
    kept = simhash.keep_one(frame(spark, rows + awkward()), shingle=5, similarity=0.8)
    assert 25 <= kept.where("doc_id is null or doc_id >= 100 or doc_id = 0").count() < 45


def test_one_row_of_each_group_stays(spark):
    docs = frame(spark)
    kept = simhash.keep_one(docs, shingle=4)
    assert kept.columns == docs.columns
    groups = simhash.simhash_groups(docs).select("root").distinct().count()
    rows = kept.collect()
    assert len(rows) == groups
    assert {1, 7, None} <= {r.doc_id for r in rows} and 2 not in {r.doc_id for r in rows}


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.simhash_groups(docs).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def repeated_lines():
    """Pairs of ids and whether they are near: the same shingles with a line once and 20 times; texts that share only a line, 20 times."""
    rng = np.random.default_rng(6)
    rows, near = [], []
    for g in range(20):
        line = " ".join(f"l{g}x{k}" for k in range(24))
        a, b, c = (" ".join(f"{x}{g}y{int(v)}" for v in rng.integers(0, 10**6, 104)) for x in "abc")
        many = " ".join([line] * 20)
        rows += [(10 * g + 1, f"{a} {line} {line}"), (10 * g + 2, f"{a} {many}"), (10 * g + 3, f"{b} {many}"), (10 * g + 4, f"{c} {many}")]
        near += [(10 * g + 1, 10 * g + 2, True), (10 * g + 3, 10 * g + 4, False)]
    return [(i, t, None, None, None) for i, t in rows], near


def test_wide_fingerprints_count_a_repeated_shingle_once(spark):
    rows, near = repeated_lines()
    got = {r.id: r.component for r in simhash.simhash_groups(frame(spark, rows), shingle=5, similarity=0.8).collect()}
    assert all((got[a] == got[b]) == linked for a, b, linked in near)


def threshold_pairs(pairs=60, n=200):
    """Texts of ``n`` distinct shingles in pairs (10 g + 1, 10 g + 2) of Jaccard 0.802, and with a third of 0.794 to the first."""
    rows = []
    for g in range(pairs):
        word = lambda x, k: f"{x}{g}z{k}"
        texts = [[word("c", k) for k in range(c + 4)] + [word(x, k) for k in range(n - c)] for x, c in (("o", n), ("p", 178), ("q", 177))]
        rows += [(10 * g + 1 + i, " ".join(t), None, None, None) for i, t in enumerate(texts)]
    return rows


def test_similarity_is_verified_and_pairs_at_it_are_found(spark):
    rows = threshold_pairs()
    rows = [r for r in rows if r[0] % 10 == 1 or (r[0] % 10 == 2) == (r[0] // 10 % 2 == 0)]
    for shard in (2048, 3):
        got = {r.id: r.component for r in simhash.simhash_groups(frame(spark, rows), shingle=5, similarity=0.8, shard=shard).collect()}
        assert [i for i in got if i % 10 == 2 and got[i] != i - 1] == []
        assert [i for i in got if i % 10 == 3 and got[i] != i] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), max_size=25))
def test_similar_forest_is_that_of_all_pairs(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = roots(len(sets), [simhash.similar_forest(arrays, 0.6)])
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6]
    want = roots(len(sets), [(np.array([i for i, _ in pairs], int), np.array([j for _, j in pairs], int))])
    assert got.tolist() == want.tolist()


def test_large_groups_are_compared_through_their_core(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CORE", 7)
    rows = [(5000 + r[0], *r[1:]) for r in threshold_pairs(6)] + near_copies(groups=3, copies=5)
    # One large group: copies of one text with a word changed, a text near only to some of them, and a chain beyond.
    base = [f"h{k}" for k in range(120)]
    for c in range(40):
        words = list(base)
        words[3 * c % 120] = f"x{c}"
        rows.append((9000 + c, " ".join(words), None, None, None))
    for c in range(1, 6):
        rows.append((9100 + c, " ".join([f"y{k}" for k in range(11 * c)] + base[11 * c :]), None, None, None))
    docs = frame(spark, rows)
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [r[1].split()] for i in range(len(w) - 4)} for r in rows}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            label[a] = min(label[b] for b in sets if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    for shard in (2048, 20, 3):
        members = spark.createDataFrame([(k, 1, r[0]) for k, r in enumerate(rows)], "node long, root long, id long")
        texts = docs.select("doc_id", simhash._text_hash("text").alias("h"))
        members = members.join(texts, F.col("id") == F.col("doc_id")).select("node", "root", F.struct("id", F.col("h").alias("text_hash")).alias("rep"))
        edges = simhash.verified_edges(docs, members, id_col="doc_id", text_col="text", shingle=5, similarity=0.8, shard=shard).collect()
        found = roots(len(rows), [(np.array([e.a for e in edges], int), np.array([e.b for e in edges], int))])
        groups = {}
        for k, r in enumerate(rows):
            groups.setdefault(found[k], set()).add(r[0])
        want = {}
        for i, g in label.items():
            want.setdefault(g, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), max_size=12), st.lists(st.sets(st.integers(0, 12), min_size=1), max_size=12))
def test_first_similar_ones(sets, others):
    arrays = [[np.array(sorted(s), np.uint64) for s in side] for side in (sets, others)]
    got = dict(zip(*map(np.ndarray.tolist, simhash.similar_to(*arrays, 0.6)), strict=True))
    near = {i: [j for j, y in enumerate(others) if len(x & y) / len(x | y) >= 0.6] for i, x in enumerate(sets)}
    assert got == {i: js[0] for i, js in near.items() if js}
