import zlib

import numpy as np

from meshlark.llm import language
from meshlark.llm.common import held_out
from tests.llm.cases import DOCS, frame, new_columns


def plain(text):
    """Sets of n-grams of letters, by the definition."""
    s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def test_features_are_ngrams():
    for text in ("The CAT sat.", "a1b2  c", "été à l'école"):
        assert abs(len(language.features(text)) - len(plain(text))) <= 1  # hashing may join two
    assert np.array_equal(language.features("The, CAT"), language.features("the cat!"))
    assert len(language.features(None)) == len(language.features("12 !?")) == 0


def test_kernel_is_the_definition():
    texts = ["the cat sat on the mat", "der hund lief", "le chat est ici", "the dog"]
    sets = [language.features(t) for t in texts]
    model = language.fit_model(sets, ["en", "de", "fr", "en"])
    k = model.kernel(sets)
    order = [int(np.argmax(row)) for row in k]
    assert np.allclose(k.max(1), 1) and len(set(order)) == 4
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            want = len(set(a) & set(b)) / np.sqrt(len(a) * len(b))
            assert np.isclose(k[i, order[j]], want, atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~held_out(docs.doc_id)))
    got = language.identify(docs, model).where(held_out(docs.doc_id) & docs.lang.isNotNull()).select("doc_id", "lang", "lang_pred", "lang_score").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert got.lang_score.between(0, 1).all()


def test_awkward_texts(spark):
    docs = frame(spark)
    got = language.identify(docs, language.fit(docs)).collect()
    by = {(r.doc_id, r.text): (r.lang_pred_, r.lang_score_) for r in got}
    assert new_columns(language.identify(docs, None), docs) == ["lang_pred_", "lang_score_"]
    assert len(got) == docs.count()
    assert all(v == ("und", 0.0) for (_, t), v in by.items() if not any(c.isalpha() for c in t or ""))
    assert {v[0] for v in by.values()} <= {"und", "en", "de", "fr", "es"}
    assert {r.lang_pred_ for r in language.identify(docs, None).collect()} == {"und"}
    one = language.fit(spark.createDataFrame([(1, "only words", "en", "a", 1)], DOCS))
    assert {r.lang_pred_ for r in language.identify(docs, one).collect()} == {"und", "en"}
    assert language.identify(spark.createDataFrame([], DOCS), None).count() == 0


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the plain words number {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10 % 10]} {'uvwxyz'[i // 100 % 6]}{'abcdefghij'[i // 600 % 10]}", "en", "a", 1) for i in range(6000)]
    rows += [(7000 + i, f"żółć gęślą jaźń {'abcdefghij'[i]}", "pl", "a", 1) for i in range(3)]
    docs = frame(spark, rows)
    model = language.fit(docs, fit_rows=100)
    assert model.langs == ["en", "pl"]
    assert {r.lang_pred_ for r in language.identify(docs.where("lang = 'pl'"), model).collect()} == {"pl"}


def test_shares():
    assert language._share([5, 1000, 1000], 405) == 200
    assert language._share([5, 6], 4000) >= 6 and language._share([10**9] * 1000, 4000) == language.FIT_LEAST
    assert language._share([], 10) == language.FIT_LEAST


def test_few_texts_on_many_rows(spark):
    texts = {"en": "the plain words", "de": "der kleine hund", "fr": "le chat est ici"}
    case = " ".join(f"when id % 3 = {k} then '{lang}'" for k, lang in enumerate(texts))
    docs = spark.range(60_000).selectExpr("id as doc_id", f"case {case} end as lang").selectExpr("*", "case " + " ".join(f"when lang = '{x}' then '{t}'" for x, t in texts.items()) + " end as text")
    model = language.fit(docs)
    assert sorted(model.langs) == ["de", "en", "fr"]
    assert language.identify(docs, model).where("lang <> lang_pred").count() == 0


def test_sample_is_exact_and_takes_all_rare_rows(spark):
    docs = spark.range(9000).selectExpr("concat('text ', id) as text", "if(id < 30, 'pl', 'en') as lang")
    got = language._sample(docs.union(docs), 1000).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"pl": 30, "en": 970}


def test_packed_features_are_bounded():
    for found in (np.zeros(0, np.int32), np.array([5, 70000], np.int32), np.arange(0, language.SPACE, 3, dtype=np.int32)):
        assert np.array_equal(language.unpacked(language.packed(found)), found)
        assert len(language.packed(found)) <= language.SPACE // 8 + 1
