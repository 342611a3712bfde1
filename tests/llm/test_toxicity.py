import numpy as np
import pytest

from meshlark.llm import toxicity
from meshlark.llm.common import held_out
from tests.llm.cases import DOCS, frame, new_columns


@pytest.fixture(scope="module")
def restorer():
    text = "you are an idiot and a stupid clown of the worthless kind as this trash is scum to them in that house " * 50
    return toxicity.Restorer.of_counts(toxicity.trigrams(text))


@pytest.mark.parametrize(
    "seen, meant",
    [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("$tupid", "stupid"), ("cl0wn", "clown"), ("tr@sh!!", "trash"), ("s-c-u-m", "scum"), ("i d i o t", "idiot"), ("house", "house"), ("***", ""), ("h0use***", "house")],
)
def test_restores(restorer, seen, meant):
    assert restorer.word(seen.lower()) == meant


def test_decoding_is_the_least_path(restorer):
    from itertools import product

    for token in ("1d10t", "c1own", "tr4sh", "a.b0"):
        options = [restorer.options(c, 1) for c in token]
        best = None
        for way in product(*options):
            x = y = 0
            cost, out = 0.0, ""
            for letters, price in way:
                cost += price
                for ch in letters:
                    s = toxicity.symbol(ch)
                    cost += 2.0 if y == 0 else restorer.cost[x, y, s]
                    x, y, out = y, s, out + ch
            cost += restorer.cost[x, y, 0] if y else 8.0
            best = min(best or (cost, out), (cost, out))
        assert restorer.decode(token) == best[1]


def test_spaced_letters_make_a_word(restorer):
    assert "clown" in restorer.words("what a c l o w n here")
    assert restorer.restore("A cl0wn, an 1d10t!") == "a clown an idiot"


def test_counts_cover_all_words():
    c = toxicity.trigrams("ab ab").reshape((28,) * 3)
    assert c[0, 1, 2] == 2 and c[1, 2, 0] == 2 and c.sum() == 4
    assert toxicity.trigrams("12 !").sum() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, toxicity.labelled_rows(docs, labels.where(~held_out(labels.doc_id))))
    got = toxicity.score_toxicity(docs.join(labels, "doc_id").where(held_out(docs.doc_id)), model).select("toxic", "toxicity").toPandas()
    said = got.toxicity >= 0.3
    assert said[got.toxic == 1].mean() > 0.8 and said[got.toxic == 0].mean() < 0.03


def test_awkward_texts(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    rows = toxicity.labelled_rows(docs, labels)
    assert sorted(r.toxic for r in rows.collect()) == [0, 1]
    model = toxicity.fit_toxicity(docs, rows)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.toxicity_ <= 1 for r in got)
    assert new_columns(toxicity.score_toxicity(docs, model), docs) == ["toxicity_"]
    assert len({r.toxicity_ for r in got if not (r.text or "").split()}) == 1
    none = toxicity.fit_toxicity(docs, rows.where("false"))
    assert all(r.toxicity_ < 1e-6 for r in toxicity.score_toxicity(docs, none).collect())
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, rows.where("false"))).count() == 0
    assert np.isfinite(model[2])


def test_features_are_the_surest_ones(spark):
    rows = [("good word here", 0)] * 3 + [(f"idiot stuff {k}", 1) for k in range(30)] + [(f"kind stuff {k}", 0) for k in range(60)]
    docs = spark.createDataFrame(rows, "text string, toxic int")
    restorer, weights, const = toxicity.fit_toxicity(docs, docs, used=2)
    assert set(np.flatnonzero(weights)) <= set(toxicity.hashed("idiot")) | set(toxicity.hashed("kind"))
    assert np.count_nonzero(weights) == 2
    assert const + weights[restorer.numbers("idiot")].sum() > const + weights[restorer.numbers("kind")].sum()
