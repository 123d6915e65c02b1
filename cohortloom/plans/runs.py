"""Numbered runs: folders, their logs and the history of all of them.  Driver-side bookkeeping through Hadoop's file system."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = ("table", "model", "figure", "report")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def next_number(spark: SparkSession, base: str) -> int:
    """One more than the largest run folder."""
    fs, p = _fs(spark, base)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return 1 + max((int(m[1]) for n in names if (m := re.fullmatch(r"run(\d+)", n))), default=0)


def new_run(spark: SparkSession, base: str) -> str:
    """The path of a fresh run with its folders and a log of status running."""
    to = f"{base.rstrip('/')}/run{next_number(spark, base)}"
    for name in FOLDERS:
        fs, p = _fs(spark, f"{to}/{name}")
        fs.mkdirs(p)
    write_log(spark, to, status="running", started=time.strftime("%Y-%m-%dT%H:%M:%S"))
    return to


def write_log(spark: SparkSession, run: str, **facts) -> None:
    """Add facts to the run's log."""
    fs, p = _fs(spark, f"{run}/log.json")
    old = json.loads(spark.read.text(f"{run}/log.json", wholetext=True).first()[0]) if fs.exists(p) else {"run": run.rsplit("/", 1)[-1]}
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(old | facts, ensure_ascii=False).encode()))
    out.close()


def history(spark: SparkSession, base: str) -> DataFrame:
    """All logs as rows, by start time; keys that some lack are NULL there."""
    return spark.read.json(f"{base.rstrip('/')}/run*/log.json").orderBy("started", "run")


def reproduced(spark: SparkSession, run: str, other: str, books: list[str], tolerance: float = 1e-9, drop: tuple[str, ...] = ()) -> list[dict]:
    """book, same: equal as bags of rows, doubles rounded at the tolerance; columns to drop are left out."""
    places = max(0, round(-__import__("math").log10(tolerance)))

    def read(at, name):
        df = spark.read.parquet(f"{at}/table/{name}").drop(*drop)
        return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})

    out = []
    for name in books:
        a, b = read(run, name), read(other, name)
        same = sorted(a.columns) == sorted(b.columns) and not a.exceptAll(b.select(a.columns)).limit(1).count() and not b.select(a.columns).exceptAll(a).limit(1).count()
        out.append({"book": name, "same": bool(same)})
    return out
