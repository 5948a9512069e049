"""One test per rule in which a statistics data frame differs from SQL."""

import pytest
from pyspark.sql import functions as F

from panelstats import functions as fn
from panelstats.operators import agg, joins, reshape


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_filter_drops_unknown(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert rows(df.where("x > 2")) == [(3,)]


def test_conditional_sum_skip_and_propagate(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, None), ("b", 4.0, True), ("b", 8.0, False)], "k string, w double, c boolean")
    skip = dict(rows(agg.cond_sums(df, ["k"], "w", {"n": F.col("c")})))
    prop = dict(rows(agg.cond_sums(df, ["k"], "w", {"n": F.col("c")}, na="propagate")))
    assert skip == {"a": 1.0, "b": 4.0} and prop == {"a": None, "b": 4.0}


def test_null_matches_null(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    assert sorted(rows(joins.rjoin(a, b).select("a", "b"))) == [("x", "p"), ("y", "q")]
    assert a.join(b, "k").count() == 1


def test_natural_join_uses_all_shared_names(spark):
    a = spark.createDataFrame([(1, 2, "x")], "k int, t int, a string")
    b = spark.createDataFrame([(1, 2, "p"), (1, 3, "q")], "k int, t int, b string")
    assert rows(joins.rjoin(a, b)) == [(1, 2, "x", "p")]


def test_join_with_different_names_and_outer(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, "p"), (3, "q")], "kk int, b string")
    assert sorted(rows(joins.rjoin(a, b, {"k": "kk"}, "outer"))) == [(1, "x", None), (2, "y", "p"), (3, None, "q")]


def test_membership_is_never_null(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert rows(df.select(fn.isin("x", [1]))) == [(True,), (False,)]
    assert rows(df.select(fn.isin("x", [None]))) == [(False,), (True,)]


def test_round_half_even(spark):
    assert [one(spark, fn.bround(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]


def test_zero_division_is_null(spark):
    assert one(spark, fn.ratio_pct(F.lit(1.0), F.lit(0.0))) is None


def test_cut_is_right_closed_and_drops_the_first_break(spark):
    df = spark.createDataFrame([(-2,), (-1,), (0,), (2,), (3,), (None,)], "x int")
    labels = [r[0] for r in rows(df.select(fn.cut("x", [-2, 0, 2, float("inf")], ["a", "b", "c"])))]
    assert labels == [None, "a", "a", "b", "c", None]


def test_paste_prints_na(spark):
    assert one(spark, fn.paste(F.lit("a"), F.lit(None).cast("string"), F.lit(3))) == "a_NA_3"


def test_weighted_mean_drops_unknown_values_only(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 100.0), (3.0, 3.0)], "x double, w double")
    assert df.agg(fn.wmean("x", "w")).first()[0] == pytest.approx(2.5)


def test_unknown_predicate_leaves_the_denominator(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0), (9, 3.0)], "x int, w double")
    assert df.agg(fn.wpct(F.col("x") > 5, "w")).first()[0] == pytest.approx(75.0)


def test_pairing_a_doubled_role_fails(spark):
    df = spark.createDataFrame([(1, "main", 5), (1, "main", 6), (1, "partner", 7)], "h int, role string, v int")
    with pytest.raises(Exception, match="twice"):
        reshape.pair_wide(df, ["h"], "role", ["main", "partner"], ["v"]).collect()
    out = reshape.pair_wide(df, ["h"], "role", ["main", "partner"], ["v"], first_by=["v"])
    assert rows(out) == [(1, 5, 7)]


def test_complete_crosses_null_levels(spark):
    df = spark.createDataFrame([("a", 1, 5.0), (None, 2, 6.0)], "k string, t int, n double")
    out = {(r["k"], r["t"]): r["n"] for r in reshape.complete(df, ["k", "t"]).collect()}
    assert out == {("a", 1): 5.0, ("a", 2): 0.0, (None, 1): 0.0, (None, 2): 6.0}


def test_complete_with_stated_levels(spark):
    df = spark.createDataFrame([("a", True, 5.0)], "k string, f boolean, n double")
    out = reshape.complete(df, ["k", "f"], levels={"f": [True, False]})
    assert sorted(rows(out)) == [("a", False, 0.0), ("a", True, 5.0)]


def test_choice_with_unknown_condition(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert rows(df.select(fn.if_else(F.col("x") > 0, F.lit("y"), F.lit("n")))) == [("y",), (None,)]


def test_clamp_sentinel_fallback(spark):
    df = spark.createDataFrame([(1,), (5,), (None,), (99,)], "x int")
    assert [r[0] for r in rows(df.select(fn.clamp_low("x", 3)))] == [3, 5, None, 99]
    assert [r[0] for r in rows(df.select(fn.sentinel_null("x", 5, ge=90)))] == [1, None, None, None]


def test_text_functions(spark):
    assert one(spark, fn.pad0(F.lit(7), 3)) == "007" and one(spark, fn.pad0(F.lit(12345), 3)) == "12345"
    assert one(spark, fn.number(F.lit(" 1,234.5 "))) == 1234.5 and one(spark, fn.number(F.lit("(NA)"))) is None
    assert one(spark, fn.first_match(F.lit("abc"), r"\d+")) is None
    assert one(spark, fn.percent_label(F.lit(2.5))) == "2.50%" and one(spark, fn.comma(F.lit(1234567))) == "1,234,567"
    assert one(spark, fn.sentence_case(F.lit("two WORDS"))) == "Two words" and one(spark, fn.title_case(F.lit("two words"))) == "Two Words"


def test_recode_keeps_or_defaults(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    assert [r[0] for r in rows(df.select(fn.recode("x", {"a": "A"})))] == ["A", "z", None]
    assert [r[0] for r in rows(df.select(fn.recode("x", {"a": "A"}, "other")))][:2] == ["A", "other"]
