"""Worked examples and boundary cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import dates, dialysis, dist, numeric
from cohortloom.plans import dictionary


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_percent_cgr_worked_example(spark):
    v = [F.lit(float(x)) for x in (60, 60, 20, 12, 4, 63, 60, 4)]
    r = one(spark, dialysis.percent_cgr(F.lit(True), *v).alias("x")).x
    want = {"ktv": 1.3412048739, "npcr": 0.9806154514, "cr_corrected": 5.2625155371, "a": 5142.1477249759, "g_total": 18.5839184553, "g_ext": 1.6642476884, "g_int": 16.9196707669, "g_ref": 14.53, "value": 116.4464608869}
    for k, x in want.items():
        assert r[k] == pytest.approx(x, rel=1e-9), k
    assert r.reasons == []


def test_invalid_inputs_are_null_with_a_reason(spark):
    v = [F.lit(float(x)) for x in (60, 0, 20, 12, 4, 63, 60, 4)]
    r = one(spark, dialysis.percent_cgr(F.lit(True), *v).alias("x")).x
    assert r.value is None and r.reasons == ["bun"]


def test_indices(spark):
    x = lambda v: F.lit(v).cast("double")
    r = one(spark, dialysis.urr(x(60), x(20)), dialysis.corrected_ca(x(8.5), x(3)), dialysis.corrected_ca(x(8.5), x(4)), dialysis.corrected_ca(x(8.5), x(None)), dialysis.tsat(x(60), x(300)), dialysis.clear_space(x(15120), x(60), x(36))["percent"], dialysis.removed_mass(x(12), x(126)), dialysis.gnri(x(4), x(None), x(160)), dialysis.tac_simple(x(20), x(60)))
    assert r[0] == pytest.approx(66.6666666667) and r[1:5] == (9.5, 8.5, None, 20.0) and r[5] == pytest.approx(70) and r[6:] == (15120.0, None, 40.0)


@pytest.mark.parametrize("text, want", [("<0.1", (0.05, 1, 0)), ("0.1未満", (0.05, 1, 0)), ("＞500", (500.0, 0, 1)), ("1,234", (1234.0, 0, 0)), ("-3.5", (-3.5, 0, 0)), ("1e3", (1000.0, 0, 0)), ("ー", (None, 0, 0)), ("1.2.3", (None, 0, 0)), ("12 mg/dL", (12.0, 0, 0)), (None, (None, None, None))])
def test_censored(spark, text, want):
    r = one(spark, numeric.censored(F.lit(text).cast("string")).alias("x")).x
    assert r.value == want[0] and (text is None or (r.low, r.high) == want[1:])


def test_units_and_limits(spark):
    hb = [one(spark, numeric.rescaled(F.lit(v), 1.5, 25, [0.1]))[0] for v in (10.8, 108.0, 11.2)]
    assert hb == pytest.approx([10.8, 10.8, 11.2])
    assert one(spark, numeric.plausible(F.lit(300.0), 1, 200))[0] is None
    assert [one(spark, numeric.between(F.lit(v), 3.5, 5.5, True, False))[0] for v in (5.4, 5.5, None)] == [True, False, None]
    assert numeric.interval({"low": 1, "upper": 2}) == (1.0, 2.0)
    for bad in ([2, 1], [None, None], ["a", 1], [True, 2]):
        with pytest.raises(ValueError):
            numeric.interval(bad)


@pytest.mark.parametrize("text", ["2013-03-03", "2013/3/3", "2013.03.03", "２０１３／３／３", "20130303", "2013年3月3日", "平成25年3月3日", "H25.3.3", "h25/3/3", "41336", "2013-03-03 12:30", "(2013/3/3)"])
def test_one_day_in_many_notations(spark, text):
    df = spark.createDataFrame([(text,)], "d string")
    r = dates.read_dates(df, ["d"])[0]
    assert str(df.select(r.expr).first()[0]) == "2013-03-03" and r.n_failed == 0


def test_order_is_not_guessed(spark):
    df = spark.createDataFrame([("03/04/2013",), ("05/06/2013",), ("未測定",), ("R5.3.3",)], "d string")
    r = dates.read_dates(df, ["d"])[0]
    assert r.order == "ambiguous_dmy_mdy" and [str(x[0]) for x in df.select(r.expr).collect()] == ["None", "None", "None", "2023-03-03"]
    assert (r.n_null, r.n_parsed, r.n_failed) == (1, 1, 2)
    df = spark.createDataFrame([("13/04/2013",), ("05/06/2013",)], "d string")
    r = dates.read_dates(df, ["d"])[0]
    assert r.order == "dmy" and sorted(str(x[0]) for x in df.select(r.expr).collect()) == ["2013-04-13", "2013-06-05"]


@pytest.mark.parametrize("text, want", [("9:00", 9), ("13：15", 13.25), ("21時00分", 21), ("未記入", None), ("25:35", 25 + 35 / 60), ("0.5", 12), ("8", 8), ("48:00", None)])
def test_clock(spark, text, want):
    got = one(spark, dates.to_hours(F.lit(text)))[0]
    assert got == (want if want is None else pytest.approx(want))


def test_hhmm_and_sessions(spark):
    r = one(spark, dates.hhmm(F.lit(25 + 35 / 60)), dates.session_hours(F.lit(22.0), F.lit(1.5)), dates.session_hours(F.lit(1.0), F.lit(20.0)))
    assert r[0] == "25:35" and r[1] == 3.5 and r[2] is None


def test_distributions():
    assert dist.normal_sf(1.959963985) == pytest.approx(0.025, rel=1e-6)
    assert dist.chi2_sf(3.841458821, 1) == pytest.approx(0.05, rel=1e-7) and dist.chi2_sf(18.307038, 10) == pytest.approx(0.05, rel=1e-6)
    assert dist.t_two_sided(2.228138852, 10) == pytest.approx(0.05, rel=1e-7) and dist.f_sf(3.885293835, 2, 12) == pytest.approx(0.05, rel=1e-6)
    assert dist.studentized_range_sf(3.877, 3, 10) == pytest.approx(0.05, abs=2e-4)
    assert dist.fisher_2x2(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert dist.adjusted([0.01, 0.04, None, 0.03], "holm") == pytest.approx([0.03, 0.06, None, 0.06])
    assert dist.adjusted([0.01, 0.04, 0.03], "bh") == pytest.approx([0.03, 0.04, 0.04])
    w, p = dist.shapiro_wilk(sorted([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.01
    assert math.isclose(dist.chi2_ppf(0.95, 1), 3.841458821, rel_tol=1e-6)


def test_names_and_timing():
    assert dictionary.timing("透析前BUN") == ("pre", "bun") and dictionary.timing("BUN_post")[0] == "post" and dictionary.timing("年齢")[0] == "unknown"
    assert dictionary.item_of("透析後 BUN") == "BUN" and dictionary.item_of("intact PTH") == "iPTH" and dictionary.item_of("備考") is None
    r = {x["index"]: x for x in dictionary.requirements(["透析前BUN", "BUN", "Ca", "Alb"])}
    assert r["補正Ca"]["ready"] and r["URR"]["missing"] == ["BUN:post: timing unknown"]
    assert all(lo < hi for _, lo, hi, _ in dictionary.ITEMS.values())


def test_percent_cgr_terms_stay_few(spark):
    """Each step names the one before it once where it can: the whole expression stays small, and no zero divides."""
    from pyspark.sql import functions as F

    names = ["age", "b1", "b2", "c1", "c2", "w1", "w2", "h"]
    df = spark.createDataFrame([(60.0, 60.0, 20.0, 12.0, 4.0, 63.0, 60.0, 4.0), (60.0, 60.0, 20.0, 0.0, 4.0, 63.0, 0.0, 72.0)], names)
    got = df.select(dialysis.percent_cgr(F.lit(True), *[F.col(c) for c in names]).getField("value").alias("v"))
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("ln(") < 20
    rows = [r.v for r in got.collect()]
    assert abs(rows[0] - 116.446461) < 1e-5 and rows[1] is None
