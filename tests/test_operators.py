import math
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from panelstats.functions import centers, cochran_var
from panelstats.operators import agg, joins, panel, reshape, segregation as seg, topk
from panelstats.operators.survey import SurveyDesign, clip_interval
from panelstats.sources import io


def test_quantiles_equal_numpy_also_for_a_hot_group(spark):
    rng = np.random.default_rng(1)
    data = [("hot", float(x)) for x in rng.normal(size=4000).round(3)] + [("small", 1.0), ("small", 4.0), ("one", 7.0)]
    df = spark.createDataFrame(data, "k string, x double")
    out = {r["k"]: (r["q2_5"], r["q50"], r["q97_5"]) for r in agg.quantiles(df, ["k"], "x", [0.025, 0.5, 0.975]).collect()}
    for k in out:
        v = [x for g, x in data if g == k]
        assert out[k] == pytest.approx(tuple(np.quantile(v, [0.025, 0.5, 0.975])), abs=1e-12)
    whole = agg.quantiles(df, [], "x", [0.3]).first()["q30"]
    assert whole == pytest.approx(np.quantile([x for _, x in data], 0.3))


@pytest.mark.parametrize("slack, room", [(agg.SLACK, agg.ROOM), (0.0, 1), (0.3, 300)])
def test_quantiles_of_all_columns_and_groups_at_once(spark, slack, room):
    """Also where brackets miss their ranks, and where kept values must be cut."""
    rng = np.random.default_rng(8)
    n = 6000
    k = rng.choice(["a", "b", None], n, p=[0.9, 0.09, 0.01])
    x, ties = rng.normal(1e6, 3, n), rng.integers(0, 3, n).astype(float)
    gaps = [None if g == "b" or i % 7 == 0 else float(v) for i, (g, v) in enumerate(zip(k, rng.exponential(size=n)))]
    data = [(g, float(a), float(b), c) for g, a, b, c in zip(k, x, ties, gaps)]
    data += [("nan", float("nan"), 1.0, None), ("nan", 2.0, 1.0, None), ("none", None, None, None), ("inf", float("inf"), 0.0, 1.0)]
    df = spark.createDataFrame(data, "k string, x double, ties double, gaps double")
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    out = agg.quantile_rows(df, ["k"], ["x", "ties", "gaps"], probs, overall=True, slack=slack, room=room).collect()
    found = {(r["k"], r["variable"]): [r[c] for c in ("q0", "q10", "q50", "q99_9", "q100")] for r in out}
    assert len(found) == len(out)
    for j, c in enumerate(("x", "ties", "gaps"), 1):
        for g in ("a", "b", None, "inf", "none", "Overall"):
            v = np.array([r[j] for r in data if r[j] is not None and (g == "Overall" or r[0] == g)])
            if not len(v):
                assert (g, c) not in found
            elif g == "Overall" and c == "x":  # infinity and NaN come last
                v = np.sort(v)
                assert found[g, c][:3] == pytest.approx([v[0], *[np.interp(p * (len(v) - 1), np.arange(len(v) - 2), v[:-2]) for p in (0.1, 0.5)]], abs=1e-9)
            elif g != "inf" or c != "x":
                assert found[g, c] == pytest.approx(list(np.quantile(v, probs)), abs=1e-9)
    assert found["nan", "x"][0] == 2.0 and math.isnan(found["nan", "x"][-1])


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert agg.quantiles(empty, ["k"], "x", [0.5]).count() == 0
    assert agg.quantiles(empty, [], "x", [0.5]).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=3, max_size=12))
def test_interpolation_passes_known_points(spark, values):
    df = spark.createDataFrame([("k", 2000 + i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, t int, v double")
    out = [r["v"] for r in panel.interpolate(df, ["k"], "t", "v").orderBy("t").collect()]
    known = [i for i, v in enumerate(values) if v is not None]
    if len(known) < 2:
        assert out == [None if v is None else float(v) for v in values]
    else:
        assert out == pytest.approx(list(np.interp(range(len(values)), known, [values[i] for i in known])))


def test_a_long_key_is_spread_with_the_same_answers(spark, monkeypatch):
    rng = np.random.default_rng(12)
    keys = ["hot"] * 900 + ["b"] * 40 + [None] * 30 + ["one"]
    data = [(k, i, None if rng.random() < 0.6 else float(rng.integers(0, 50)), i % 7) for i, k in enumerate(keys)]
    data += [("empty", i, None, 0) for i in range(25)] + [("lone", i, 4.0 if i == 3 else None, 0) for i in range(9)]
    data = [data[i] for i in rng.permutation(len(data))]
    df = spark.createDataFrame(data, "k string, t int, v double, x int")

    def rows(out):
        return sorted((tuple(r) for r in out.select(sorted(out.columns)).collect()), key=str)

    calls = {f"shift {k}": lambda k=k, d=d: panel.shift(df, ["k"], "t", "x", k, default=d)
             for k, d in ((1, None), (-1, 99), (45, None), (-130, None), (400, 5))}
    calls |= {"sum": lambda: panel.cumsum(df, ["k"], ["t"], "v"), "locf": lambda: panel.locf(df, ["k"], "t", "v"),
              "line": lambda: panel.interpolate(df, ["k"], "t", "v"), "named": lambda: panel.interpolate(df, ["k"], "t", "v", "w"),
              "replaced": lambda: panel.interpolate(df, ["k"], "t", "v", "x"), "no key": lambda: panel.cumsum(df, [], ["t", "k"], "x")}
    plain = {n: f() for n, f in calls.items()}
    kept = {n: (rows(o), o.columns) for n, o in plain.items()}
    monkeypatch.setattr(panel, "LONG_KEY", 10)
    monkeypatch.setattr(panel, "PIECE", 50)
    for n, f in calls.items():
        out = f()
        assert sorted(out.columns) == sorted(kept[n][1]), n
        assert rows(out) == kept[n][0], n
    blocks = panel._blocks(df, ["k"], ["t"])
    assert blocks.where("k = 'hot'").select("__block").distinct().count() > 4


def test_an_owner_deletes_what_was_staged(spark):
    from panelstats.models import linear
    from panelstats.session import shared_folder, stage, stages

    folder = shared_folder(spark).removeprefix("file:")

    def files():
        return {os.path.join(at, f) for at, _, names in os.walk(folder) for f in names}

    df = spark.range(300).selectExpr("cast(id % 7 as int) as g", "cast(id * id % 11 as double) as x", "cast(id % 5 as double) as y")
    kept = stage(df)
    before = files()
    with stages(spark):
        fit = linear.ols(df, "y ~ x", absorb="g")
        table = linear.level_table(fit).collect()
        with stages(spark):
            agg.quantiles(df, ["g"], "x", [0.5]).collect()
        assert files() > before
    assert len(table) == 7 and files() == before and kept.count() == 300
    with pytest.raises(ZeroDivisionError), stages(spark):
        stage(df)
        1 / 0
    assert files() == before


def test_allocation_keeps_totals(spark):
    points = spark.createDataFrame([(1, "a", 10.0), (1, "b", 5.0), (1, "a", 2.0)], "y int, zip string, v double")
    cw = spark.createDataFrame([("a", "p", 0.25), ("a", "q", 0.75), ("b", "q", 1.0)], "zip string, area string, ratio double")
    out = {r["area"]: r["v"] for r in joins.allocate(points, cw, ["zip"], ["area"], "ratio", ["v"], ["y"]).collect()}
    assert out == {"p": 3.0, "q": 14.0}


def test_baseline_and_share_of_row(spark):
    df = spark.createDataFrame([("US", 1, 10.0), ("MX", 1, 4.0), ("MX", 2, 3.0)], "k string, t int, v double")
    out = {(r["k"], r["t"]): r["v_dif"] for r in joins.baseline_diff(df, "t", "k", "US", "v").collect()}
    assert out == {("US", 1): 0.0, ("MX", 1): -6.0, ("MX", 2): None}
    assert joins.share_of_row(df, "t", "k", "US", "v").where("k = 'MX' and t = 1").first()["prop"] == 0.4


def test_deflate_and_lookup_first(spark):
    idx = spark.createDataFrame([(1999, 100.0), (2009, 125.0)], "y int, l double")
    df = spark.createDataFrame([(2009, 50.0), (2030, 1.0)], "year int, v double")
    assert sorted(r["v"] for r in joins.deflate(df, idx, "year", ["v"], 1999).collect() if r["v"]) == [40.0]
    a = spark.createDataFrame([("x", "X1")], "c string, o string")
    b = spark.createDataFrame([("name", "Y1")], "c string, o string")
    d = spark.createDataFrame([("x", "name"), (None, "name"), (None, None)], "code string, nm string")
    assert [r["out"] for r in joins.lookup_first(d, [("code", a), ("nm", b)], "out").collect()] == ["X1", "Y1", None]


def test_pair_long_inverts_pair_wide(spark):
    df = spark.createDataFrame([(1, "main", 5, "a"), (1, "partner", 7, "b"), (2, "main", 1, "c")], "h int, role string, v int, s string")
    wide = reshape.pair_wide(df, ["h"], "role", ["main", "partner"], ["v", "s"])
    back = sorted(tuple(r) for r in reshape.pair_long(wide, ["main", "partner"], "role").collect())
    assert back == [(1, "main", 5, "a"), (1, "partner", 7, "b")]


def test_carry_forward_and_calendar(spark):
    df = spark.createDataFrame([("a", 2019, 1), ("a", 2020, 2)], "k string, year int, v int")
    out = sorted(tuple(r) for r in reshape.carry_forward(df, "year", 2020, [2021, 2022]).collect())
    assert out == [("a", 2019, 1), ("a", 2020, 2), ("a", 2021, 2), ("a", 2022, 2)]
    assert reshape.calendar(df, ["k"], 2000, 2004).count() == 5


def test_mode_takes_the_first_seen_on_a_tie(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 4), ("g", "b", 3)], "k string, v string, o int")
    assert agg.mode_first(df, ["k"], "v", "o").first()["v"] == "b"
    assert agg.mode_first(df, ["k"], "v").first()["v"] == "a"


def test_row_id_counts_over_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5000).alias("x"))
    out = panel.row_id(df, ["x"]).collect()
    assert sorted((r["id"], r["x"]) for r in out) == [(i + 1, i) for i in range(5000)]


def test_rows_take_the_id_of_their_flag_combination(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (0, 0, 4.0), (None, None, 8.0)], "a int, b int, w double")
    ids = panel.row_id(agg.combos(df.where("a is not null"), ["a", "b"]), ["a", "b"])
    out = reshape.match_combo(df, ids, ["a", "b"], F.col("a").isNull())
    assert sorted((r["id"] or 0, r["w"]) for r in out.collect()) == [(0, 8.0), (1, 4.0), (2, 1.0), (3, 2.0)]


def test_product_meets_every_pair_once(spark):
    a, b = spark.range(2).toDF("a"), spark.range(37).toDF("b")
    out = reshape.product([a, b, spark.range(3).toDF("c")]).collect()
    assert len(out) == len(set(out)) == 2 * 37 * 3


def test_top_k_and_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    assert [r["id"] for r in topk.top_k(df, ["-id"], 3).collect()] == [999, 998, 997]
    within = topk.top_k(df, ["-id"], 2, ["g"]).collect()
    assert sorted(r["id"] for r in within) == [994, 995, 996, 997, 998, 999]
    a = {r["id"] for r in topk.sample_n(df, 50, 3, ["id"]).collect()}
    b = {r["id"] for r in topk.sample_n(df.repartition(13), 50, 3, ["id"]).collect()}
    assert a == b and len(a) == 50
    cc = topk.case_control(df, F.col("g") == 0, 10, 3, ["id"])
    assert cc.where("g = 0").count() == 334 and cc.where("g <> 0").count() == 10


def _survey_rows(spark, n=400):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 60, n)
    data = [(int(i), int(g[i]), int(g[i] % 4 if i % 5 else 9), float(rng.uniform(1, 5)), float(rng.normal(10, 3)), "abc"[int(rng.integers(0, 3))])
            for i in range(n)]
    return data, spark.createDataFrame(data, "i int, psu int, dom int, w double, x double, lev string")


def _lin_se(data, in_domain, psus, center, value):
    w = sum(d[3] for d in data if in_domain(d))
    m = sum(d[3] * value(d) for d in data if in_domain(d)) / w
    z = {p: 0.0 for p in psus}
    for d in data:
        if in_domain(d):
            z[d[center]] += d[3] * (value(d) - m) / w
    g = len(psus)
    return m, np.sqrt(g / (g - 1) * sum(v * v for v in z.values()))


def test_survey_mean_total_prop_match_brute_force(spark):
    data, df = _survey_rows(spark)
    psus = {d[1] for d in data}
    design = SurveyDesign(df, "w", "psu")
    for r in design.mean("x", ["dom"]).collect():
        m, se = _lin_se(data, lambda d: d[2] == r["dom"], psus, 1, lambda d: d[4])
        assert (r["x"], r["x_se"]) == (pytest.approx(m), pytest.approx(se))
    for r in design.prop("lev", ["dom"], ("se",)).collect():
        m, se = _lin_se(data, lambda d: d[2] == r["dom"], psus, 1, lambda d: float(d[5] == r["lev"]))
        assert (r["coef"], r["coef_se"]) == (pytest.approx(m), pytest.approx(se))
    flat = SurveyDesign(df, "w")
    for r in flat.prop("lev", [], ("se",)).collect():
        m, se = _lin_se(data, lambda d: True, {d[0] for d in data}, 0, lambda d: float(d[5] == r["lev"]))
        assert (r["coef"], r["coef_se"]) == (pytest.approx(m), pytest.approx(se))
    for r in design.total(["dom"], vartype=("se",)).collect():
        t = {p: 0.0 for p in psus}
        for d in data:
            if d[2] == r["dom"]:
                t[d[1]] += d[3]
        v = np.array(list(t.values()))
        assert r["n_se"] == pytest.approx(np.sqrt(len(v) / (len(v) - 1) * ((v - v.mean()) ** 2).sum()))


def test_equal_weights_give_the_classical_error(spark):
    _, df = _survey_rows(spark)
    r = SurveyDesign(df.withColumn("w", F.lit(2.0)), "w").mean("x").first()
    c = df.agg(F.stddev_samp("x") / F.sqrt(F.count("*"))).first()[0]
    assert r["x_se"] == pytest.approx(c)
    v = df.agg(cochran_var("x", F.lit(2.0))).first()[0]
    assert v == pytest.approx(c * c)


def test_clip_and_domain(spark):
    _, df = _survey_rows(spark)
    whole = SurveyDesign(df, "w", "psu")
    assert whole.domain(F.col("dom") == 1).n_psu == whole.n_psu
    out = clip_interval(spark.createDataFrame([(-0.5,), (0.2,)], "low double"), "low")
    assert [r["low"] for r in out.collect()] == [0.0, 0.2]


def _seg(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(int(rng.integers(0, 25)), "ab"[int(rng.integers(0, 2))], float(rng.integers(1, 9))) for _ in range(3000)],
                                 "u int, g string, w double")


def test_index_properties(spark):
    df = _seg(spark)
    d = seg.dissimilarity(df, "g", ("a", "b"), ["u"], "w").first()["D"]
    assert 0 <= d <= 1 and d == pytest.approx(seg.dissimilarity(df, "g", ("b", "a"), ["u"], "w").first()["D"])
    h = seg.mutual_information(df, "g", ["a", "b"], ["u"], "w").first()
    assert 0 <= h["H"] <= 1
    exp = seg.exposure(df, "g", ["a", "b"], ["u"], "w").groupBy("of").agg(F.sum("exposure").alias("s")).collect()
    assert [r["s"] for r in exp] == pytest.approx([1.0, 1.0])
    boot = seg.dissimilarity(df, "g", ("a", "b"), ["u"], "w", boot=60, seed=1).first()
    again = seg.dissimilarity(df.repartition(5), "g", ("a", "b"), ["u"], "w", boot=60, seed=1).first()
    assert boot["se"] > 0 and boot["bias"] > 0 and boot["D"] < d
    assert boot["se"] == pytest.approx(again["se"])
    apart = df.withColumn("u", F.when(F.col("g") == "a", 1).otherwise(2))
    assert seg.dissimilarity(apart, "g", ("a", "b"), ["u"], "w").first()["D"] == 1.0


def test_bootstrap_is_a_multinomial_of_the_period_total(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(y), int(u), g, float(rng.gamma(2, 3))) for y in (1, 2) for u in range(40) for g in "ab" if rng.random() > 0.1]
    rows += [(2, 99, "a", 4000.0), (None, 1, "a", 7.0), (None, 2, "b", 5.0), (3, 1, "a", 6.0)]
    df = spark.createDataFrame(rows, "y int, u int, g string, w double")
    flat = seg.replicates(df, "g", ("a", "b"), ["u"], "w", ["y"], boot=400, seed=3).toPandas()
    monkeypatch.setattr(seg, "FAN", 4)  # a tree of several levels
    deep = seg.replicates(df, "g", ("a", "b"), ["u"], "w", ["y"], boot=400, seed=3).toPandas()
    for out in (flat, deep):
        assert len(out) == 4 * 400
        for y in (1, 2, 3, None):
            part = out[out.y.isna()] if y is None else out[out.y == y]
            own = [r for r in rows if r[0] == y]
            n = round(sum(r[3] for r in own))
            assert (part.a + part.b == n).all()
            if y == 3:  # no second group: D is unknown
                assert part.D.isna().all() and (part.b == 0).all()
                continue
            share = sum(r[3] for r in own if r[2] == "a") / sum(r[3] for r in own)
            sd = math.sqrt(share * (1 - share) / n)
            assert abs((part.a / n).mean() - share) < 5 * sd / 20 and 0.8 < (part.a / n).std() / sd < 1.2
            assert part.chi2.mean() == pytest.approx(len(own) - 1, rel=0.2)
    one = deep[deep.y == 1].D.to_numpy()
    p = np.array([[sum(r[3] for r in rows if r[:3] == (1, u, g)) for g in "ab"] for u in range(40)])
    draws = np.random.default_rng(0).multinomial(round(p.sum()), (p / p.sum()).ravel(), 4000).reshape(-1, 40, 2)
    plain = 0.5 * np.abs(draws[..., 0] / draws[..., 0].sum(1, keepdims=True) - draws[..., 1] / draws[..., 1].sum(1, keepdims=True)).sum(1)
    assert one.mean() == pytest.approx(plain.mean(), abs=5 * plain.std() / 20) and one.std() == pytest.approx(plain.std(), rel=0.2)


def test_no_operator_plans_a_cross_join(spark):
    df = _seg(spark)
    whole = agg.share(df.groupBy("u").agg(F.sum("w").alias("n")), "n")
    plans = [whole, reshape.complete(df.groupBy("u", "g").agg(F.sum("w").alias("n")), ["u", "g"]), panel.zscore(df, ["w"]),
             agg.crosstab_pct(df, "u", "g", [], ["a", "b"]), seg.dissimilarity(df, "g", ("a", "b"), ["u"], "w")]
    for p in plans:
        text = p._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_results_do_not_depend_on_partitioning(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    a, b = (sorted(tuple(r) for r in agg.subgroup_shares(x, ["l_returnflag", "l_linestatus"], ["l_linenumber"], "l_quantity").collect())
            for x in (li, li.repartition(17, "l_partkey")))
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert [r[3] for r in a] == pytest.approx([r[3] for r in b])


def test_sources(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿Code,1960 [1960],Name\nAFG,293,\"a, b\"\nALB,(NA),x\n,,\nnote,,\n", encoding="utf-8")
    df = io.load_csv(spark, str(p), "Code string, `1960 [1960]` double, Name string", nulls=["(NA)", ""], key="Code")
    assert [tuple(r) for r in df.collect()] == [("AFG", 293.0, "a, b"), ("ALB", None, "x"), ("note", None, None)]
    assert [tuple(r) for r in reshape.years_to_rows(df.drop("Name"), ["Code"], "n").collect()][0] == ("AFG", 1960, 293.0)
    t = tmp_path / "t.txt"
    t.write_text("id year v\nLAS01 1999   4.5 \nLAS02  2000\n\n")
    assert [tuple(r) for r in io.load_ragged(spark, str(t), "id string, year int, v double").collect()] == [("LAS01", 1999, 4.5), ("LAS02", 2000, None)]
    book = io.codebook(spark, {"sex": {1: "Male", 2: " Female"}})
    codes = io.literal_table(spark, "sex int", [(1,), (2,), (3,)])
    assert [r["sex_label"] for r in io.add_labels(codes, book, ["sex"]).orderBy("sex").collect()] == ["male", "female", None]
    io.save_table(codes.withColumn("v", F.lit(1)), str(tmp_path / "p"), ["sex"])
    assert io.load_table(spark, str(tmp_path / "p")).count() == 3


def test_spread_survives_a_large_level(spark):
    rng = np.random.default_rng(9)
    x, w = rng.normal(size=400), rng.uniform(1, 3, 400)
    df = spark.createDataFrame([(float(1e9 + a), float(b), i % 40) for i, (a, b) in enumerate(zip(x, w))], "x double, w double, psu int")
    m = (w * x).sum() / w.sum()
    r = SurveyDesign(df, "w").mean("x", vartype=("se", "ci")).first()
    se = np.sqrt(400 / 399 * ((w * (x - m)) ** 2).sum()) / w.sum()
    assert r["x_se"] == pytest.approx(se, rel=1e-5) and r["x"] - 1e9 == pytest.approx(m, abs=1e-5)
    assert r["x_low"] < r["x"] < r["x_upp"]
    z = np.bincount(np.arange(400) % 40, w * (x - m))
    r = SurveyDesign(df, "w", "psu").mean("x").first()
    assert r["x_se"] == pytest.approx(np.sqrt(40 / 39 * (z ** 2).sum()) / w.sum(), rel=1e-5)
    s = agg.summary_table(df, ["x"], w="w").first()
    assert s["stat_2"] == pytest.approx(np.sqrt((w * (x - m) ** 2).sum() / w.sum() * 400 / 399), rel=1e-5)
    v = df.agg(cochran_var("x", "w", centers(df, "x")[0])).first()[0]
    assert v == pytest.approx(400 / 399 * ((w * (x - m)) ** 2).sum() / w.sum() ** 2, rel=1e-5)
