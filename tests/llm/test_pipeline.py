import corpus_pipeline
from meshlark.llm import mixing, packing, quality, secrets, simhash
from meshlark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.cases import DOCS, awkward

GOOD = "The plain words of this text are many, and each of them is as good as another one. "


def spelled(n):
    return "".join("abcdefghij"[int(c)] for c in str(n + 12345))


def rows():
    key = "".join("0123456789abcdef"[i * 7 % 16] for i in range(40))
    out = [(100 + i, GOOD + " ".join(spelled(31 * i + 7 * k * k) for k in range(30 + i)) + (f' token = "{key}"' if i % 4 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(40)]
    junk = [(300 + i, "BUY!! NOW!! CHEAP!! DEAL!! " * (20 + i), "en", "s0", 1) for i in range(8)]
    return out + junk + [(500, out[0][1], "en", "s1", 1), (501, out[1][1], "en", "s1", 1)] + awkward()


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    docs = spark.createDataFrame(rows(), DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)

    one = stage[names[0]](spark, docs, d)
    kept = {r.doc_id for r in one.collect()}
    want = {r.doc_id for r in quality.score_quality(docs).where("quality_score >= 0.5").collect()}
    assert kept == want and set(range(100, 140)) <= kept and not kept & set(range(300, 308)) and not {4, 5, 6} & kept

    two = stage[names[1]](spark, one, d)
    ids = {r.doc_id for r in two.collect()}
    groups = simhash.simhash_groups(one, shingle=5, similarity=0.8).collect()
    assert two.count() == len({r.root for r in groups})
    assert set(range(100, 140)) <= ids and not {500, 501} & ids and 2 not in ids

    three = stage[names[2]](spark, two, d).collect()
    assert {r.doc_id for r in three} == ids
    assert all(not secrets.base((r.text or "").encode()) for r in three)
    assert sum("[SECRET]" in (r.text or "") for r in three) == 10
    assert all(r.text == dict((x[0], x[1]) for x in rows())[r.doc_id] for r in three if "[SECRET]" not in r.text)

    docs3 = spark.createDataFrame(three, DOCS)
    four = stage[names[3]](spark, docs3, d)
    took = {r.id for r in mixing.mix(docs3).where("taken > 0").collect()}
    assert {r.doc_id for r in four.collect()} == took
    for df in (one, two, four):
        assert df.columns == docs.columns

    five = stage[names[4]](spark, four, d).collect()
    assert sum(r.n_tokens for r in five) == sum(len(r.text.split()) for r in four.collect())
    key = lambda r: (r.doc_id or -1, r.piece, r.n_tokens, r.bucket, r.batch, r.slot)
    assert sorted(map(key, corpus_pipeline.run(spark, d).collect())) == sorted(map(key, five))
    assert packing.CONTEXT >= max(r.n_tokens for r in five)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_run_on_the_small_tables(spark):
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 11)} and set(ORACLE_SQL) <= set(QUERIES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name, f in QUERIES.items():
        df = f(spark, "/root/testdata/sf0.001")
        assert df.columns[0] in ("doc_id", "vec_id")
        if not name.startswith(("op6_", "op8_")):
            assert df.count() == docs
