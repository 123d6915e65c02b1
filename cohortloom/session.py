"""Session services shared by all operators: shared scratch space, shipping of the package, size-checked joins."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_READ = "spark.sql.parquet.columnarReaderBatchSize"


BATCH_BYTES = 4 << 20  # of an Arrow batch: whole texts are long, so batches are bounded by bytes and not by rows alone
READ_ROWS = 256  # of Parquet that a task holds as vectors, which have room for twice their texts
GROUP_BYTES = 16 << 20  # of a row group, which a task that writes holds


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application; bound batches.

    The bounds on Arrow batches and on read vectors are set where the session still has Spark's own (64 MB, 4096 rows), so
    a setting of the user's stays.
    """
    if spark.conf.get(_BATCH, "64m").rstrip("bB") in ("64m", str(64 << 20)):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if spark.conf.get(_READ, "4096") == "4096":
        spark.conf.set(_READ, str(READ_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    to = Path(tempfile.mkdtemp()) / "cohortloom.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def lean(run):
    """A function of Arrow batches that gives its memory back when a partition is done.

    Python workers are kept and used again, so what one task needed at its peak would else stay beside the next one.
    """

    def wrapped(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            batches = None
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; unset, our own in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/{os.getpid()}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back; survives the loss of executors.

    Row groups are bounded, since Spark's own (128 MB) of a few tasks fill a heap of 1 GB.
    """
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what came of them must be staged itself by now."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if "/staged/" in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let the shuffle files of steps that are over go now: Spark deletes them when the driver has collected their plans,
    which with a large heap and little garbage comes long after."""
    spark._jvm.System.gc()


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = 8 << 20, salt: int = 16) -> DataFrame:
    """Null-safe join of big with small on columns that both have.

    small is counted first (rows and bytes of its string columns); up to limit bytes it is broadcast, beyond that both
    sides are shuffled with a salt on the key, so a hot key of big spreads over `salt` tasks.  The salt is a hash of the
    row, so a task that runs again deals its rows alike.
    """
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, t in small.dtypes if t == "string"]
    n, *strings = small.agg(F.count(F.lit(1)), *text).first()
    right = small.select(*[F.col(c).alias(f"__r_{c}") for c in small.columns])
    if n * 16 * len(small.columns) + sum(strings) <= limit:
        right = F.broadcast(right)
        cond = [big[c].eqNullSafe(right[f"__r_{c}"]) for c in on]
    else:
        big = big.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, t in big.dtypes if "map<" not in t]), F.lit(salt)).cast("int"))
        right = right.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        cond = [big[c].eqNullSafe(right[f"__r_{c}"]) for c in on] + [big["__salt"] == right["__r_salt"]]
    out = big.join(right, on=cond, how=how)
    keep = [big[c] for c in big.columns if c != "__salt"] + [right[f"__r_{c}"].alias(c) for c in small.columns if c not in on]
    return out.select(*keep)
