import pytest

from meshlark.llm import common
from tests.llm.cases import DOCS


def test_sample_has_exactly_the_keys_it_may(spark):
    many = spark.range(20_000).selectExpr("concat('t', id) as text")
    for copies in (1, 3):
        rows = many
        for _ in range(copies - 1):
            rows = rows.union(many)
        for most in (1, 100, 15_000, 20_000, 30_000):
            got = common.bounded_sample(rows, "text", most)
            assert got.count() == got.distinct().count() == min(most, 20_000)
    few = spark.range(60_000).selectExpr("concat('t', id % 3) as text")
    assert common.bounded_sample(few, "text", 4000).count() == 3
    assert common.bounded_sample(few, "text", 2).count() == 2
    hot = few.union(many)  # copies of three texts are most of the rows
    assert common.bounded_sample(hot, "text", 500).count() == 500


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Size int, size_ int")
    assert common.free_names(df, "size", "x", "x") == ["size__", "x", "x_"]


def test_scratch_deletes_what_is_written_inside(spark):
    with common.scratch(spark):
        inner = common.materialise(spark.range(3), "inner")
        outer = common.materialise(inner, "outer", keep=True)
    assert outer.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        inner.count()


def test_words(spark):
    df = spark.createDataFrame([(1, " a\x0bb\u00a0c ", None, None, None), (2, None, None, None, None)], DOCS)
    assert [r[0] for r in df.select(common.words(df.text)).collect()] == [["a", "b\u00a0c"], []]
    assert [r[0] for r in df.select(common.word_count(df.text)).collect()] == [2, 0]


def test_kth_least_is_that_of_the_sorted_rows(spark):
    values = [-(1 << 62), -70_000, -1, -1, 0, 3, 3, 3, 65_536, 65_537, 1 << 40, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values[::-1]], "v long")
    assert [common.kth_least(df, "v", k) for k in (0, 3, 7, 9, 11)] == [values[k] for k in (0, 3, 7, 9, 11)]
