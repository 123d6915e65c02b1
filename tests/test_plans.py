"""Figure data, multivariate operators, runs and the orchestrated way."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import figures, multivariate
from cohortloom.plans import orchestrate, runs

ROOT = Path(__file__).resolve().parents[1]


def test_figures(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), F.concat(F.lit("L"), (F.col("id") % 7).cast("string")).alias("c"))
    h = figures.histogram(df, "x", 10).orderBy("bin").collect()
    assert [r.n for r in h] == [10] * 10 and h[-1].high == pytest.approx(99)
    assert [r.level for r in figures.level_counts(df, "c", 2).collect()] == ["L0", "L1"]
    assert sorted(r[0] for r in figures.fold_levels(df, "c", 3).select("c").distinct().collect()) == ["L0", "L1", "その他"]
    assert all(r.y == pytest.approx(2 * r.x) for r in figures.running_median(df, "x", "y").collect())
    assert figures.display_decimals(df.withColumn("z", F.col("x") / 1000), ["x", "z"]) == {"x": 0, "z": 3}


def test_multivariate(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    x[0] = [9, -9, 9]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    c = np.cov(x.T)
    d2 = np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(c), x - x.mean(0))
    got = multivariate.mahalanobis(df, ["a", "b", "c"]).toPandas()
    assert np.allclose(np.sort(got.d2), np.sort(d2)) and got.d2__outlier.sum() >= 1
    pc = multivariate.principal_components(df, ["a", "b", "c"])
    assert sum(pc["explained"]) == pytest.approx(1) and pc["explained"] == sorted(pc["explained"], reverse=True)
    assert set(multivariate.leaf_order(np.corrcoef(x.T), ["a", "b", "c"])) == {"a", "b", "c"}
    lost = df.withColumn("b", F.when(F.col("a") < 0.5, F.col("b")))
    assert [(r["column"], r["other"]) for r in multivariate.mcar_signals(lost, ["a", "b", "c"], {"a", "b", "c"})] == [("b", "a")]


def test_runs(spark, tmp_path):
    base = f"file://{tmp_path}/out"
    a, b = runs.new_run(spark, base), runs.new_run(spark, base)
    assert (a.rsplit("/", 1)[-1], b.rsplit("/", 1)[-1]) == ("run1", "run2")
    runs.write_log(spark, a, status="done", rows=3)
    assert [(r.run, r.status, r.rows) for r in runs.history(spark, base).collect()] == [("run1", "done", 3), ("run2", "running", None)]
    for at in (a, b):
        spark.range(3).selectExpr("id", "id / 3D AS x").write.parquet(f"{at}/table/book")
    assert runs.reproduced(spark, a, b, ["book"]) == [{"book": "book", "same": True}]


def test_orchestrated_run(spark):
    rows = [(f"K{i:03d}", "男女"[i % 2], str(40 + i % 30) if i % 9 else None, "108" if i == 7 else f"{10 + i % 3}.5", f"2013/{1 + i % 12}/{1 + i % 28}", int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, ["仮名ID", "性別", "年齢", "Hb", "検体採取日", "転帰"])
    r = orchestrate.run(df, target="転帰")
    assert r.schema.columns["年齢"].role == "numeric" and r.schema.columns["検体採取日"].role == "datetime" and r.schema.columns["仮名ID"].role == "id"
    assert r.books["analysis"].count() == 120 and r.frame.filter("Hb > 25").count() == 0
    assert r.books["train"].count() + r.books["test"].count() == 120 and all(x["found"] == 0 for x in r.leaks)
    assert {"年齢", "性別"} <= set(r.books["train"].columns) and not r.skipped
    assert any(x["target"] == "仮名ID" for x in r.ledger())
    assert "train" not in orchestrate.quicklook(df, target="転帰").books


def test_whole_run_saved_and_reproduced(spark, tmp_path):
    from cohortloom.sources.cohort import cohort

    df = cohort(spark, 300)
    assert len(df.columns) == 33 and df.exceptAll(cohort(spark, 300)).count() == 0
    base = f"file://{tmp_path}/out"
    r = orchestrate.run(df, "転帰", entity="患者番号", survival=("観察開始日", "死亡日", "打ち切り日"), as_of="2030-01-01")
    assert {"analysis", "model", "no_outcome", "survival", "km", "train", "test"} <= set(r.books) and not r.skipped
    assert r.books["analysis"].count() == 300 and {"URR(%)", "spKt/V", "TSAT(%)"} <= set(r.frame.columns)
    assert r.books["model"].count() == df.filter("`転帰` IS NOT NULL").count() and dict(r.books["analysis"].dtypes)["糖尿病"] == "int"
    assert {"duplicate ids", "survival dates", "cross items"} <= {f["check"] for f in r.findings}
    at = orchestrate.save(r, base)
    page = spark.read.text(f"{at}/report/report.html", wholetext=True).first()[0]
    assert "<h2>1. Settings</h2>" in page and "K0000001" not in page
    found = orchestrate.reproduce(spark, at, base, seed=5)
    assert {x["book"]: x["same"] for x in found if not x["same"]} == {"seed: 5 was given, the saved 0 is used": False}


def test_queries_are_read_without_a_session():
    # a column made while a module is imported needs a session, which the driver starts only later
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 0, done.stderr


def test_a_run_infers_and_splits_once(spark, monkeypatch):
    """A table to which cleaning adds nothing keeps its first roles, and both sides are read from one split on disk."""
    from pyspark.sql import functions as F

    from cohortloom.plans import orchestrate

    asked = []
    real = orchestrate.roles.infer
    monkeypatch.setattr(orchestrate.roles, "infer", lambda *a: asked.append(a) or real(*a))
    k = F.col("id")
    df = spark.range(200).select(k.alias("_row_id"), (k * 7 % 101 + 0.5).alias("price"), F.when(k % 3 == 0, "a").otherwise("b").alias("s"), F.when(k % 5 != 0, (k % 2).cast("int")).alias("y"))
    got = orchestrate.run(df, "y")
    assert len(asked) == 1
    assert all("xxhash64" not in got.books[b]._jdf.queryExecution().optimizedPlan().toString() for b in ("train", "test"))
    assert (got.books["train"].count(), got.books["test"].count()) == (120, 40)
    assert [x["found"] for x in got.leaks] == [0, 0, 0]
