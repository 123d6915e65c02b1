"""Readers, books, exact places, names, and Cox parts against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import places, prepare, roles, survival
from cohortloom.plans import dictionary, labels
from cohortloom.sources import reader, sheets


def rows(loaded):
    return sorted(map(str, ([r[c] for c in loaded.df.columns if c != "_row_id"] for r in loaded.df.collect())))


def test_title_lines_are_skipped_by_place(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(",title,\nid,v,w\n1,a,b\n,c,d\nid,e,f\n")
    got = reader.read_any(spark, f"file://{p}")
    assert got.df.columns[:3] == ["id", "v", "w"] and rows(got) == sorted(map(str, (["1", "a", "b"], [None, "c", "d"], ["id", "e", "f"])))


def test_quoted_headers_and_blank_rows(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text('id,"a,b",c,id,empty\n1,"x, ""y""",z,2,\n,,,,\n3,u,v,4,\n,,,,\n,,,,\n')
    got = reader.read_any(spark, f"file://{p}")
    assert got.df.columns == ["id", "a,b", "c", "id.1", "_row_id"] and got.df.count() == 3
    assert got.df.filter("id = 1").first()["a,b"] == 'x, "y"'
    assert any("occurs twice" in n for n in got.notes) and any("1 blank rows" in n for n in got.notes) and any("empty" in n for n in got.notes)


def test_books_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("ア<&>", 1.5, 3), (None, None, 4)], "`名` string, x double, n int")
    sheets.write_book({"first": df, "second": df.limit(1)}, f"file://{tmp_path}/b.xlsx")
    assert sheets.read_sheet(spark, f"file://{tmp_path}/b.xlsx") == [["名", "x", "n"], ["ア<&>", "1.5", "3"], ["", "", "4"]]
    got = reader.read_any(spark, f"file://{tmp_path}/b.xlsx", sheet=1)
    assert got.df.drop("_row_id").collect()[0] == ("ア<&>", "1.5", "3")
    with pytest.raises(ValueError):
        sheets.write_book({"big": spark.range(20)}, f"file://{tmp_path}/c.xlsx", most=10)


def test_places_against_numpy(spark):
    rng = np.random.default_rng(0)
    values = [(g, float(v)) for g in ("a", "b", None) for v in np.r_[rng.normal(size=40).round(1), [0.0] * 30]] + [("c", 5.0), ("a", None)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r.g: (r.n, r.q) for r in places.quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0], ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        x = [v for k, v in values if k == g and v is not None]
        assert got[g][0] == len(x) and got[g][1] == pytest.approx(np.quantile(x, [0.0, 0.1, 0.5, 0.99, 1.0]).tolist())
    assert places.quantiles(df.limit(0), "v", [0.5]).first() == (0, [None]) and places.quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0
    split = prepare.split_random(spark.range(1000), "id", 0.3)
    assert split.filter("_split = 'test'").count() == 300


def test_names():
    assert [roles.names_an_id(c) for c in ("患者番号", "patient_id", "ID", "No.1", "no", "idea", "valid", "note")] == [True, True, True, True, True, False, False, False]
    assert dictionary.timing("前回日")[0] == "unknown" and dictionary.timing("前K") == ("pre", "k") and dictionary.timing("Hb_後")[0] == "post" and dictionary.timing("representative")[0] == "unknown"
    assert labels.width("日本a") == 5 and labels.missing_english(["謎", "年齢", "x"]) == ["謎"]


def test_cox_parts_against_newton_in_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, 150)
    t = np.ceil(rng.exponential(20, 150) * np.exp(-0.7 * x)) + 1
    e = rng.random(150) < 0.8
    df = spark.createDataFrame([(float(a), int(b), float(c), "LMH"[k % 3], None if k % 10 == 0 else float(k % 7)) for k, (a, b, c) in enumerate(zip(t, e, x))], "t double, e int, x double, g string, z double")
    beta = 0.0
    for _ in range(30):
        u = h = 0.0
        for at in np.unique(t[e]):
            dead, risk = e & (t == at), t >= at
            for k in range(dead.sum()):
                w = np.exp(beta * x) * (risk - k / dead.sum() * dead)
                m = (w * x).sum() / w.sum()
                u, h = u - m, h + (w * x * x).sum() / w.sum() - m * m
            u += x[dead].sum()
        beta += u / h
    fit = survival.cox(df, "t", "e", ["x"])
    assert fit["beta"][0] == pytest.approx(beta, abs=1e-6) and fit["table"][0]["se"] == pytest.approx(1 / math.sqrt(h), rel=1e-5)
    got = survival.cox_model(df, "t", "e", ["x", "g", "z", "gone"], screen_p=0.5)
    assert got["reference"]["g"] in "LMH" and got["dropped"] == ["gone: no such column"] and got["imputed"][0]["missing"] == 15
    assert "x" in {r["covariate"] for r in got["table"]} and got["lost_rows"] == 0 and all(0 <= r["p"] <= 1 for r in got["ph"])
