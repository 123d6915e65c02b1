"""Operators against hand values, brute force and their invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import dist
from cohortloom.operators import audit, clean, compare, figures, places, prepare, profile, roles, series, survival
from cohortloom.sources import reader


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([("a", float(x)) for x in range(1, 6)] + [("b", float(x)) for x in range(3, 8)], "g string, x double")


def test_effect_sizes(two):
    assert compare.hedges_g(two, "x", "g", "a", "b") == pytest.approx(-1.1425, abs=1e-4)
    assert compare.smd(two, "x", "g", "a", "b") == pytest.approx(-2 / math.sqrt(2.5))
    r = compare.mann_whitney(two, "x", "g", "a", "b")
    assert r["u"] == 4.5 and r["delta"] == pytest.approx(2 * 4.5 / 25 - 1)
    assert compare.welch(two, "x", "g", "a", "b")["t"] == pytest.approx(-2.0)
    assert compare.anova(two, "x", "g")["f"] == pytest.approx(4.0)
    assert compare.eta_squared(two, "x", "g").first()[0] == pytest.approx(10 / 30)


def test_k_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, m in (("a", 0), ("b", 0), ("c", 2)) for v in rng.normal(m, 1, 30)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert compare.kruskal(df, "x", "g")["p"] < 1e-6
    got = {(r["a"], r["b"]): r for r in compare.dunn(df, "x", "g")}
    assert got["a", "b"]["p_adjusted"] > 0.05 > got["a", "c"]["p_adjusted"]
    assert min(r["p"] for r in compare.tukey(df, "x", "g")) < 1e-6
    bell = spark.createDataFrame([(dist.normal_ppf((i + 0.5) / 30),) for i in range(30)], "x double")
    assert compare.normality(bell, "x")["normal"] and not compare.normality(bell.select(F.exp("x").alias("x")), "x")["normal"]
    rows = compare.compare_groups(df.withColumn("s", (F.col("x") > 1).cast("string")), "g", ["x", "s"], {"x"})
    assert all(r["q"] < 0.01 for r in rows)
    assert compare.table_one(df, ["x"], {"x"}, "g")[0] == {"row": "n", "Overall": "90", "a": "30", "b": "30", "c": "30"}


def test_categorical(spark):
    df = spark.createDataFrame([("x", "p")] * 3 + [("x", "q")] + [("y", "p")] + [("y", "q")] * 3, "a string, b string")
    assert compare.categorical_test(df, "a", "b") == {"test": "fisher", "p": pytest.approx(0.4857142857)}
    assert compare.chi_square(df, "a", "b").first()["chi2"] == pytest.approx(2.0)
    d = spark.createDataFrame([("a", v) for v in [1] * 6 + [0] * 4] + [("b", v) for v in [1] * 3 + [0] * 7], "g string, v int")
    assert compare.smd_categorical(d, "v", "g", "a", "b") == pytest.approx(0.3 / math.sqrt(0.225))


def test_limits_and_suspects(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"), "id")
    assert tuple(profile.iqr_limits(df, "x").first()) == (25.75 - 74.25, 75.25 + 74.25)
    assert tuple(profile.iqr_limits(df.limit(3), "x").first()) == (-math.inf, math.inf)
    odd = df.withColumn("x", F.when(F.col("id") == 50, 99999.0).otherwise(F.col("x")))
    assert [(r.side, r.row) for r in profile.entry_suspects(odd, "x", "id").collect()] == [("high", 50)]
    assert profile.flag_outliers(odd, "x", profile.iqr_limits(odd, "x"), action="drop").count() == 99
    with_null = df.unionByName(spark.createDataFrame([(None, 101)], "x double, id long"))
    out = profile.flag_outliers(with_null, "x", profile.quantile_limits(with_null, "x"), action="winsorize")
    assert out.filter("x IS NULL").count() == 1


@pytest.mark.parametrize("parts", [1, 8])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 3).alias("g")).repartition(parts)
    assert [tuple(r) for r in compare.rank_sums(df, "x", "g").orderBy("g").collect()] == [(0, 67, 6737.5), (1, 67, 6709.5), (2, 66, 6653.0)] or compare.rank_sums(df, "x", "g").agg(F.sum("rank_sum")).first()[0] == 200 * 201 / 2


def test_preparation_learns_on_train_only(spark):
    df = spark.createDataFrame([(i, float(i) if i % 5 else None, "rare" if i == 3 else "ab"[i % 2], "train" if i < 40 else "test") for i in range(60)], "id int, x double, c string, _split string")
    train, test = prepare.sides(df)
    p = prepare.Preparation(numeric=["x"], nominal=["c"], policy={"encode": {"min_frequency": 0.05}})
    with pytest.raises(prepare.LeakageError):
        p.fit(test)
    with pytest.raises(prepare.LeakageError):
        p.transform(test)
    x = np.array([i for i in range(40) if i % 5], dtype=float)
    p.fit(train)
    assert p.fitted["numeric"]["x"]["fill"] == np.median(x)
    filled = np.r_[x, [np.median(x)] * 8]
    got = p.transform(train).toPandas()
    assert got["x"].mean() == pytest.approx(0, abs=1e-9) and got["x"].std(ddof=0) == pytest.approx(1) and filled.std() == pytest.approx(p.fitted["numeric"]["x"]["width"])
    assert list(got.columns) == ["x", "c=b", "c=(rare)"] and got["c=(rare)"].sum() == 1
    again = prepare.Preparation.from_json(p.to_json())
    assert again.transform(test).collect() == p.transform(test).collect()


def test_stream_gets_the_same_projection(spark, tmp_path):
    from cohortloom.streaming import prepare_stream

    df = spark.range(50).select(F.col("id").cast("double").alias("x"))
    df.write.parquet(str(tmp_path / "in"))
    p = prepare.Preparation(numeric=["x"]).fit(prepare.SplitFrame(df, "train"))
    stream = spark.readStream.schema("x double").parquet(str(tmp_path / "in"))
    with pytest.raises(prepare.LeakageError):
        prepare.Preparation(numeric=["x"]).fit(prepare.SplitFrame(stream, "train"))
    q = prepare_stream(p, stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert reader.same_rows(spark.read.parquet(str(tmp_path / "out")), p.transform(df))


def test_splits(spark):
    df = spark.range(400).select("id", (F.col("id") % 40).alias("g"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    s = prepare.split_random(df, "id", 0.25, "y")
    assert {(r.y, r._split): r["count"] for r in s.groupBy("y", "_split").count().collect()} == {(0, "test"): 80, (0, "train"): 240, (1, "test"): 20, (1, "train"): 60}
    assert prepare.entity_overlap(prepare.split_group(df, "g"), "g").count() == 0
    t = prepare.split_time(df, "g", "id", 0.1)
    assert t.filter("_split = 'test'").count() == 40 and t.filter("_split = 'test'").agg(F.min("g")).first()[0] == 36
    assert prepare.leak_check(s, "id", ["g"], "y")[0]["found"] == 0
    assert prepare.folds(df, "g").groupBy("g").agg(F.count_distinct("_fold").alias("k")).filter("k > 1").count() == 0


def test_survival_hand_values(spark):
    df = spark.createDataFrame([(float(t), 1, "a") for t in (1, 2, 3, 8, 9)], "t double, e int, g string")
    assert survival.rmst(df, "t", "e", tau=5.0).first()["rmst"] == pytest.approx(3.2)
    assert [round(r.survival, 10) for r in survival.km(df, "t", "e").orderBy("t").collect()] == [0.8, 0.6, 0.4, 0.2, 0.0]
    h = spark.createDataFrame([(0.5, 1), (2.0, 1), (0.3, 0), (1.0, 1), (3.0, 0)], "d double, e int")
    assert [r[0] for r in h.select(survival.binary_at(F.col("d"), F.col("e"), 1.0)).collect()] == [1, 0, None, 1, 0]


def test_cox_and_logrank_against_brute_force(spark):
    rng = np.random.default_rng(20)
    n = 120
    x = rng.normal(size=n)
    t = np.ceil(rng.exponential(1 / (0.15 * np.exp(0.8 * x))) * 2) / 2
    e = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(float(a), int(b), float(c), "hi" if c > 0 else "lo") for a, b, c in zip(t, e, x)], "t double, e int, x double, g string")

    def loglik(b):
        total = 0.0
        for s in sorted(set(t[e == 1])):
            d, r = (t == s) & (e == 1), t >= s
            w = np.exp(b * x)
            total += b * x[d].sum() - sum(math.log(w[r].sum() - k / d.sum() * w[d].sum()) for k in range(d.sum()))
        return total

    got = survival.cox(df, "t", "e", ["x"])
    b = got["table"][0]["coef"]
    assert loglik(b) >= max(loglik(b + 1e-3), loglik(b - 1e-3))
    two, trend = survival.logrank(df, "t", "e", "g"), survival.logrank_trend(df, "t", "e", "g", {"lo": 0, "hi": 1})
    assert two["chi2"] == pytest.approx(trend["chi2"], rel=1e-9) and sum(two["observed"].values()) == e.sum()
    assert survival.choose_horizon(df, "t", "e", 0.5)["tau"] > 0


def test_roles_and_yaml(spark):
    rows = [(f"K{i:03d}", "AB"[i % 2] + "院", "男女"[i % 2], 40 + i % 37, f"2013/{1 + i % 12}/{1 + i % 28}", i % 5, 7, f"{i}番の長い自由記述の文章がここに入ります。もっと長く", i * 2.5, i * 5.0, i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "`仮名ID` string, `施設` string, `性別` string, `年齢` int, `観察開始年月日` string, `ECOG` int, `研究` int, `備考` string, `x` double, `y` double, `転帰` int")
    s = roles.infer(df, target="転帰")
    got = {c: v.role for c, v in s.columns.items()}
    assert got == {"仮名ID": "id", "施設": "binary", "性別": "binary", "年齢": "numeric", "観察開始年月日": "datetime", "ECOG": "ordinal", "研究": "constant", "備考": "high_cardinality", "x": "numeric", "y": "duplicate_of", "転帰": "outcome"}
    assert all(v.reason for v in s.columns.values()) and s.columns["性別"].value_map == {"男": 1, "女": 0}
    again = roles.Schema.from_yaml(s.to_yaml())
    assert again == s and not s.diff(again)
    again.override({"年齢": {"role": "text", "unit": None}})
    assert s.diff(again) == [{"column": "年齢", "field": "role", "was": "numeric", "now": "text"}, {"column": "年齢", "field": "action", "was": "keep", "now": "drop"}]
    with pytest.raises(ValueError):
        roles.Schema.from_yaml(s.to_yaml().replace("role: numeric", "role: nonsense"))


def test_cleaning(spark):
    df = spark.createDataFrame([("<0.1", "10.8", 3), ("0.3", "108", 4), ("9999", "11.2", 5), ("2", "300", 6)], "CRP string, Hb string, other int")
    out, report = clean.clean_numeric(df)
    rows = out.orderBy("other").collect()
    assert [r.CRP for r in rows] == [0.05, 0.3, None, 2.0] and [r.Hb for r in rows] == pytest.approx([10.8, 10.8, 11.2, None], nan_ok=True) or rows[3].Hb is None
    assert [r.CRP__low for r in rows] == [1, 0, 0, 0] and report.unmatched == ["other"]
    got, bad, problems = clean.apply_ranges(df, {"other": [4, 5], "Hb": [2, 1], "lost": [0, 1]})
    assert [r.other for r in got.collect()].count(None) == 2 and bad.count() == 2 and len(problems) == 2
    kept, blank = clean.drop_blank_rows(spark.createDataFrame([("a", None), (" ", "　"), (None, "b")], "x string, y string"))
    assert kept.count() == 2 and blank.count() == 1
    times = clean.normalize_times(spark.createDataFrame([("21時00分", "1:35"), ("未記入", "12:00")], "s string, e string"), "s", "e").collect()
    assert [tuple(r) for r in times] == [("21:00", "25:35"), ("未記入", "12:00")]
    assert [r.exclude_reason for r in clean.mark_exclusions(df, {"a": F.col("other") > 4, "b": F.col("other") > 5}).orderBy("other").collect()] == ["", "", "a", "a／b"]


def test_audit(spark):
    rows = [(f"K{i}", 60.0 if i % 2 else 20.0, 20.0, i % 2, " Ａ院" if i == 0 else "A院", float(i), i * 2.0 + (i % 2) * 0.1) for i in range(40)]
    df = spark.createDataFrame(rows, "`仮名ID` string, `透析前BUN` double, `透析後BUN` double, `転帰` int, `施設` string, `x` double, `z` double")
    checks = {(f["check"], f["severity"]) for f in audit.audit(df.unionByName(df.limit(1)), "仮名ID", "転帰", "施設")}
    assert {("duplicate rows", "error"), ("duplicate ids", "error"), ("spelling", "warn"), ("leakage", "error"), ("groups", "warn")} <= checks
    swapped = df.withColumn("透析後BUN", F.col("透析前BUN") + 5)
    assert ("pre and post", "error") in {(f["check"], f["severity"]) for f in audit.pre_post(swapped)}
    assert not [f for f in audit.audit(df.filter(F.col("施設") == "A院").select("仮名ID", "x"), "仮名ID") if f["severity"] == "error"]


def test_series(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 20.0), (1, 4.0, 10.0), (2, 0.0, 5.0), (2, 0.0, 6.0), (3, 1.0, 4.0)], "k int, t double, c double")
    got = {r.k: (r.tac, r.repeated) for r in series.tac_trapezoid(df, "k", "t", "c").collect()}
    assert got == {1: (15.0, 0), 2: (None, 1), 3: (None, 0)}


def test_reader(spark, tmp_path):
    text = "題名,,\n仮名ID,年齢,空\nK1,40,\nK2,　,\n"
    (tmp_path / "a.csv").write_bytes(text.encode("cp932"))
    got = reader.read_any(spark, str(tmp_path / "a.csv"))
    assert [tuple(r)[:2] for r in got.df.collect()] == [("K1", "40"), ("K2", "　")] and "空" not in got.df.columns and any("cp932" in n for n in got.notes)
    with pytest.raises(ValueError):
        reader.read_any(spark, "x.sav")
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "b"), (3, " ")], "_row_id long, x string")
    assert reader.drop_trailing_blank(df).count() == 3
    assert reader.same_rows(df, df.repartition(3)) and not reader.same_rows(df, df.limit(2))


def test_places_read_their_input_once(spark, tmp_path):
    """Bounds and ranges come from one exchange of counts; halving finds the range of each value, in groups too."""
    spark.range(5000).select(((F.col("id") * 37) % 1013).cast("double").alias("v"), (F.col("id") % 3).alias("g")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    pdf = df.toPandas()
    for by, few in ((["g"], True), (["g"], False), ([], False)):
        got = places.quantiles(df, "v", [0.0, 0.1, 0.5, 0.9, 1.0], by, few=few)
        rows = {r["g"] if by else None: r for r in got.collect()}
        plan = got._jdf.queryExecution().toString().split("Initial Plan")[0].split("Final Plan")[-1]
        assert plan.count("FileScan") == 1
        for k, r in rows.items():
            v = pdf.v if k is None else pdf.v[pdf.g == k]
            assert r.n == len(v) and r.q == pytest.approx(list(v.quantile([0.0, 0.1, 0.5, 0.9, 1.0])))


def test_places_of_weighted_rows(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 4)], "v double, w long")
    r = places.quantiles(df, "v", [0.5, 0.6], weight="w").first()
    assert (r.n, r.q) == (10, pytest.approx([1.5, 4.8]))


def test_method_step_ranks_where_medians_differ(spark, monkeypatch):
    """Ranks (the dear half) are asked for only where the medians differ by 15 %."""
    asked = []
    real = audit.mann_whitney
    monkeypatch.setattr(audit, "mann_whitney", lambda *a: asked.append(a[1]) or real(*a))
    k = F.col("id")
    df = spark.range(200).select(F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")).alias("day"), (k % 10 + 1.0).alias("same"), F.when(k >= 100, k % 10 + 5.0).otherwise(k % 10 + 1.0).alias("moved"))
    assert audit.method_step(df, "day", "same", "2020-04-10")[0]["severity"] == "info"
    assert audit.method_step(df, "day", "moved", "2020-04-10")[0]["severity"] == "error"
    assert asked == ["moved"]


def test_running_median_reads_twice(spark, tmp_path):
    """Bins of x come from the counts of its values: what runs reads the table once for x and once for y."""
    spark.range(3000).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 31 % 997).cast("double").alias("y")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got, pdf = figures.running_median(df, "x", "y"), df.toPandas()
    rows = {r.bin: r for r in got.collect()}
    assert got._jdf.queryExecution().toString().split("Initial Plan")[0].split("Final Plan")[-1].count("FileScan") == 2
    edges = [pdf.x.quantile(k / 12) for k in range(13)]
    for k in range(12):
        part = pdf[(pdf.x >= edges[k]) & (pdf.x <= edges[k + 1])]
        assert (rows[k].n, rows[k].x, rows[k].y) == (len(part), part.x.median(), part.y.median())


def test_numbers_are_not_read_as_text(spark):
    """A column of numbers isn't written out and parsed; what is no finite number is missing."""
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (12.5,), (None,)], "`フェリチン` double")
    got, report = clean.clean_numeric(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "transform(" not in plan
    assert [r[0] for r in got.collect()] == [None, None, 12.5, None] and report.actions == []


def test_codes_over_the_range_need_no_quantile(spark, monkeypatch):
    """A code over the possible range is missing whatever the other values are: the 99 % point isn't asked for."""
    asked = []
    real = clean.quantiles_of
    monkeypatch.setattr(clean, "quantiles_of", lambda df, columns, ps: asked.extend(columns) or real(df, columns, ps))
    df = spark.createDataFrame([(str(v), w) for v, w in zip([9999] * 4 + [11, "<12"], [9999.0] * 4 + [11.0, 12.0])], "Hb string, `フェリチン` double")
    got, report = clean.clean_numeric(df)
    assert len(asked) == 1  # ferritin can be 9999
    assert sorted(r.Hb for r in got.collect() if r.Hb is not None) == [6.0, 11.0]
    assert sorted((a["column"], a["action"]) for a in report.actions if a["action"] == "missing code") == [("Hb", "missing code"), ("フェリチン", "missing code")]
