import numpy as np
import pandas as pd

from meshlark.llm import quality
from meshlark.llm.queries import op7_quality_classifier
from tests.llm.cases import DOCS, frame, new_columns

GOOD = "The plain words of this text are many, and each of them is as good as another one. "


def test_label_model_recovers_classes():
    rng = np.random.default_rng(0)
    k = len(quality.LABELLERS)
    truth = rng.random(20000) < 0.8
    votes = np.zeros((20000, k), int)
    votes[:, 0] = np.where(rng.random(20000) < np.where(truth, 0.9, 0.1), quality.GOOD, quality.NONE)
    for j in range(1, k):  # each finds a part of the bad
        votes[:, j] = np.where(rng.random(20000) < np.where(truth, 0.005, 0.35), quality.BAD, quality.NONE)
    codes, counts = np.unique(votes @ 3 ** np.arange(k - 1, -1, -1), return_counts=True)
    assert (quality.unpacked(codes) == quality.unpacked(codes)).all()
    post = quality.fit_label_model(codes, counts.astype(float))
    said = np.array([post[c] for c in votes @ 3 ** np.arange(k - 1, -1, -1)]) > 0.5
    assert (said == truth).mean() > 0.95


def test_counts_of_all_rows_matter():
    codes = np.array([0, 1])
    few, many = (quality.fit_label_model(codes, np.array(c, float)) for c in ([10, 1], [1000, 900]))
    assert few != many


def test_junk_goes_and_clean_stays(spark):
    word = lambda n: "".join("aeioubdlmt"[int(c)] for c in str(n))
    clean = [(i, GOOD + " ".join(word(1000 + 37 * i + 11 * k * k) for k in range(20 + 3 * i)) + ".", None, None, None) for i in range(60)]
    kinds = ["BUY!! NOW!! CHEAP!! DEAL!! ", "one*** two### three$$$ four%%% ", "word ", "a | b | c | d | e | "]
    junk = [(100 + 10 * k + i, kind * (20 + 5 * i), None, None, None) for k, kind in enumerate(kinds) for i in range(5)]
    none = [(200, None, None, None, None), (201, "", None, None, None), (202, " \n\t", None, None, None), (203, "one", None, None, None), (None, GOOD, None, None, None)]
    docs = frame(spark, clean + junk + none)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(60)) | {None} <= ids
    assert not {i for i in ids if i is not None and 100 <= i < 203}
    assert new_columns(kept, docs) == []
    scored = quality.score_quality(docs)
    assert new_columns(scored, docs) == ["quality_posterior_", "quality_score_"]
    assert all(0 <= r.quality_score_ <= 1 and 0 <= r.quality_posterior_ <= 1 for r in scored.collect())


def by_hand(texts, threshold=0.5):
    """Votes, label model and scorer in one process; which of the texts stay."""
    seen = [quality.measures(t.encode()) for t in texts]
    codes = [None if m is None else quality.votes(m) for m in seen]
    kinds, counts = np.unique([c for c in codes if c is not None], return_counts=True)
    posterior = quality.fit_label_model(kinds, counts.astype(float))
    rows = sorted({t for t, m in zip(texts, seen, strict=True) if m})
    pairs = [quality.features(t.encode(), quality.measures(t.encode())) for t in rows]
    w = quality.fit_scorer(np.array([quality.votes(quality.measures(t.encode())) for t in rows]), [a for a, _ in pairs], [v for _, v in pairs], posterior)
    out = []
    for t, m in zip(texts, seen, strict=True):
        at, value = quality.features(t.encode(), m) if m else ([], np.zeros(0))
        out.append(1 / (1 + np.exp(-(w[at] @ value + w[-1]))) if m else 0.0)
    return [x >= threshold for x in out], out


def test_query_agrees_with_one_process(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    stay, score = by_hand([t or "" for t in docs.text])
    got = op7_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    assert np.allclose(got.score[docs.doc_id], score, atol=1e-4) and (got.keep[docs.doc_id].to_numpy() == stay).all()


def test_few_texts_on_many_rows(spark):
    plain, junk = GOOD * 3, "BUY!! NOW!! CHEAP!! DEAL!! " * 20
    docs = spark.range(60_000).selectExpr("id as doc_id", f"if(id % 3 = 0, '{junk}', '{plain}') as text")
    got = {r.text: r.s for r in quality.score_quality(docs).groupBy("text").agg({"quality_score": "max"}).withColumnRenamed("max(quality_score)", "s").collect()}
    assert got[junk] < 0.5 < got[plain]


def test_whole_word_shapes_are_features():
    a, b = b"aB" * 20 + b"1", b"aB" * 20 + b"2c"
    assert quality.measures(a)["words"] == 1
    one, two = (set(quality.features(t, quality.measures(t))[0].tolist()) for t in (a, b))
    assert one != two


def test_long_text_and_empty_table(spark):
    long = [(1, GOOD * 3000, None, None, None)]
    assert quality.score_quality(spark.createDataFrame(long, DOCS)).count() == 1
    assert quality.score_quality(spark.createDataFrame([], DOCS)).count() == 0


def test_held_out_accuracy_on_tables(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet"))
    got = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality_score", "quality").toPandas()
    keep = got.quality_score >= 0.5
    assert isinstance(got, pd.DataFrame)
    assert keep[got.quality == 1].mean() > 0.99 and keep[got.quality == 0].mean() < 0.1


def test_every_text_has_a_part_in_the_scorer(spark):
    """Each text has a shape of its own; the weights of a sample's scorer would be 0 where it has none of them."""
    shape = lambda n: "".join("aA1"[int(c)] for c in np.base_repr(n + 3**5, 3))
    rows = [(i, GOOD + shape(i), None, None, None) for i in range(400)]
    _, weights = quality.fit(spark.createDataFrame(rows + rows, DOCS), fit_rows=50)
    for _, text, *_ in rows:
        at, _ = quality.features(text.encode(), quality.measures(text.encode()))
        assert (weights[at] != 0).all()


def test_shards_agree_with_one_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = quality.score_quality(docs).select("doc_id", "quality_score").toPandas().set_index("doc_id").quality_score
    parts = quality.score_quality(docs, fit_rows=100).select("doc_id", "quality_score").toPandas().set_index("doc_id").quality_score
    assert ((whole >= 0.5) == (parts[whole.index] >= 0.5)).mean() > 0.995
    assert np.abs(whole - parts[whole.index]).mean() < 0.02
