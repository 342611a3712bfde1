import numpy as np
from pyspark.sql import functions as F

from meshlark.llm import mixing
from tests.llm.cases import DOCS, awkward, frame


def targets(sizes, most=3):
    """By resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > most * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **want}
        fixed.update({s: most * sizes[s] for s in over})


def sized(rows):
    out = {}
    for r in rows:
        out[r[3]] = out.get(r[3], 0) + len((r[1] or "").split())
    return out


def test_targets_match_resharing(spark):
    rng = np.random.default_rng(1)
    for _ in range(4):
        sizes = {f"s{i}": int(10 ** rng.uniform(0, 5)) for i in range(9)} | {None: 17}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit("a")).alias("p"))
        got = [r.p for r in df.collect()]
        assert sorted(got) == list(range(n))
        assert n < 1000 or got != list(range(n))


def test_taken_words(spark):
    rng = np.random.default_rng(2)
    rows = awkward() + [(1000 + i, "w " * int(rng.integers(1, 400)), "en", "abcdefg"[int(rng.integers(0, 7)) if i % 3 else 0], 1) for i in range(600)]
    docs = frame(spark, rows)
    got = mixing.mix(docs, block=16, slots=64).collect()
    again = mixing.mix(docs.repartition(7), block=16, slots=64).collect()
    key = lambda r: (r.id is None, r.id or 0, r.text_hash, r.source or "", r.size, r.taken)
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(again, key=key)]
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len((r[1] or "").split()) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    sizes = sized(rows)
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert abs(mine[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r.taken for r in mine) - want[s]) <= 0.05 * want[s] + 64


def test_no_words_and_empty(spark):
    rows = [(1, None, None, "a", 1), (2, " ", None, "b", 1)]
    assert [(r.size, r.target, r.taken) for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mixed_documents_keep_columns(spark):
    docs = frame(spark)
    kept = mixing.mixed_documents(docs, block=4)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()


def test_mixed_documents_hold_what_the_mix_takes(spark):
    rng = np.random.default_rng(4)
    rows = awkward() + [(1000 + i, "  " + "\n".join(f"d{i}w{k}" for k in range(int(rng.integers(1, 400)))), "en", "abcdefg"[int(rng.integers(0, 7)) if i % 3 else 0], -1) for i in range(600)]
    docs = frame(spark, rows)
    got = mixing.mixed_documents(docs, block=16, slots=64).collect()
    want = targets(sized(rows))
    for s, target in want.items():
        assert abs(sum(len(r.text.split()) for r in got if r.source == s) - target) <= 0.05 * target + 64
    took = {(r.id, r.text_hash): r.taken for r in mixing.mix(docs, block=16, slots=64).collect() if (r.id or 0) >= 1000}
    text = {r[0]: r[1] for r in rows}
    changed = 0
    for r in got:
        if (r.doc_id or 0) < 1000:
            continue
        words, whole = r.text.split(), text[r.doc_id].split()
        assert set(words) <= set(whole) and max(words.count(w) for w in words[:3]) <= 3
        assert r.n_chars == (-1 if r.text == text[r.doc_id] else len(r.text))
        assert len(words) == next(v for (i, _), v in took.items() if i == r.doc_id)
        changed += words != whole
    assert changed > 100 and len([v for v in took.values() if v]) == sum((r.doc_id or 0) >= 1000 for r in got)


def test_what_is_drawn_over_a_limit_is_drawn_again():
    assert mixing.redrawn([3.0, 5.2, 1.1], [5, 4, 1], [3, 100, 100]) == [-2, 2, 0]
    assert mixing.redrawn([3.0, 5.2, 1.1], [3, 5, 1], [3, 100, 100]) == [0, 0, 0]
    assert sum(mixing.redrawn([30.0] * 3, [33, 29, 28], [30, 30, 30])) == 0


def test_sources_at_their_limit_get_all_of_it(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 2)  # several ranges of output shards
    rows = [(i, " ".join(["w"] * 64), "en", "b" if i % 40 == 0 else "a" if i % 40 == 1 else "c", 1) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block=64, slots=64).groupBy("source").agg({"taken": "sum", "target": "max", "size": "sum"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 64 * 2
        assert r["sum(taken)"] <= 3 * r["sum(size)"]
