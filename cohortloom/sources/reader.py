"""Reading tables by extension with a row id, no NaN and no empty columns; writing results."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortloom.functions.numeric import blank
from cohortloom.sources.sheets import read_sheet

ENCODINGS = ["utf-8-sig", "cp932", "utf-8", "euc-jp", "latin-1"]
SPARK_NAMES = {"utf-8-sig": "UTF-8", "cp932": "windows-31j", "utf-8": "UTF-8", "euc-jp": "EUC-JP", "latin-1": "ISO-8859-1"}
PROBE = 1 << 20


@dataclass
class Loaded:
    df: DataFrame
    notes: list[str] = field(default_factory=list)


def sniff(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """(encoding, first lines) from the first bytes, read by Spark so that any file system works."""
    head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, PROBE)).first()[0])
    for name in ENCODINGS:
        try:
            text = head.decode(name)
        except UnicodeDecodeError as e:
            if e.start < len(head) - 4 or len(head) < PROBE:
                continue
            text = head[: e.start].decode(name)
        return name, text.splitlines()[:11]
    raise ValueError(f"{path}: no known encoding")


def header_row(rows: list[list[str]]) -> int:
    """The first of ten rows with at least max(2, half the columns) filled cells, else the first."""
    width = max(map(len, rows[:10]), default=0)
    return next((i for i, r in enumerate(rows[:10]) if sum(bool(c.strip()) for c in r) >= max(2, 0.5 * width)), 0)


def column_names(cells: list[str]) -> tuple[list[str], list[str]]:
    """(names, notes): blank names are numbered, repeated ones get a suffix."""
    names, notes, seen = [], [], {}
    for i, c in enumerate(cells):
        c = c.strip().lstrip("\ufeff") or f"column{i}"
        seen[c] = seen.get(c, 0) + 1
        if seen[c] > 1:
            notes.append(f"column {c} occurs twice")
        names.append(c if seen[c] == 1 else f"{c}.{seen[c] - 1}")
    return names, notes


def after_lines(df: DataFrame, n: int) -> DataFrame:
    """The rows of one text file but its first n lines, by their place: rows of the split at offset 0 are numbered as they are read."""
    placed = df.withColumns({"__at": F.monotonically_increasing_id(), "__from": F.col("_metadata.file_block_start")})
    first = placed.filter("__from = 0").agg(F.min("__at")).first()[0]
    return placed.filter((F.col("__from") != 0) | (F.col("__at") >= F.lit(first) + n)).drop("__at", "__from") if first is not None else df


def read_any(spark: SparkSession, path: str, sheet: int = 0, header: int | str = "auto", encoding: str | None = None) -> Loaded:
    """csv, txt, tsv, xlsx, parquet, json, jsonl, orc; other extensions are refused with what to do instead.

    Title lines above the header are skipped by their place, never by what they hold.  Empty columns and the blank rows
    at the end are left out; blank rows in between stay and are counted in the notes.
    """
    notes: list[str] = []
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt", "tsv"):
        sep = "\t" if kind == "tsv" else ","
        found, lines = sniff(spark, path)
        rows = list(csv.reader(lines, delimiter=sep))
        skip = header_row(rows) if header == "auto" else int(header)
        encoding = encoding or found
        if encoding != "utf-8-sig":
            notes.append(f"read as {encoding}")
        if SPARK_NAMES.get(encoding, "UTF-8") not in ("UTF-8", "ISO-8859-1"):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else Spark refuses this encoding
        names, more = column_names(rows[skip]) if rows else ([], [])
        notes += more
        quoted = [c.replace("`", "``") for c in names]
        reader = spark.read.option("sep", sep).option("encoding", SPARK_NAMES.get(encoding, encoding)).option("enforceSchema", True).option("escape", '"')
        df = reader.schema(", ".join(f"`{c}` string" for c in quoted)).csv(path)
        if skip:
            notes.append(f"the header is in line {skip + 1}")
        # Spark leaves out blank lines, so they don't count as rows
        df = after_lines(df, sum(bool(x.strip()) for x in lines[: skip + 1]))
    elif kind in ("xlsx", "xlsm"):
        cells = read_sheet(spark, path, sheet)
        skip = header_row(cells) if header == "auto" else int(header)
        names, more = column_names(cells[skip]) if cells else ([], [])
        notes += more
        rows = [[*r[: len(names)], *[""] * (len(names) - len(r))] for r in cells[skip + 1 :]]
        df = spark.createDataFrame([[c if c != "" else None for c in r] for r in rows], StructType([StructField(c, StringType()) for c in names]))
    elif kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("json", "jsonl"):
        df = spark.read.option("multiLine", kind == "json").json(path)
    elif kind == "orc":
        df = spark.read.orc(path)
    else:
        raise ValueError(f"{path}: export {kind} files as CSV or Parquet first")
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(f"`{c}`")) for c, t in df.dtypes if t in ("double", "float")})
    df = df.withColumn("_row_id", F.monotonically_increasing_id())
    columns = [c for c in df.columns if c != "_row_id"]
    if not columns:
        return Loaded(df, notes)
    counts = df.agg(*[F.count(F.when(~blank(F.col(f"`{c}`")), 1)) for c in columns], F.count_if(all_blank(df))).first()
    empty = [c for c, n in zip(columns, counts) if not n]
    if empty:
        notes.append(f"empty columns left out: {', '.join(empty)}")
    if counts[-1]:
        df = drop_trailing_blank(df)
        if inside := df.filter(all_blank(df)).count():
            notes.append(f"{inside} blank rows between filled ones")
    return Loaded(df.drop(*empty), notes)


def all_blank(df: DataFrame, row: str = "_row_id"):
    out = F.lit(True)
    for c in df.columns:
        if c != row:
            out = out & blank(F.col(f"`{c}`"))
    return out


def drop_trailing_blank(df: DataFrame, row: str = "_row_id") -> DataFrame:
    """Blank rows after the last filled one go; those in between stay."""
    last = df.agg(F.max(F.when(~all_blank(df, row), F.col(row)))).first()[0]
    return df.filter(F.col(row) <= F.lit(-1 if last is None else last))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows."""
    return a.columns == b.columns and not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def write_books(books: dict[str, DataFrame], to: str) -> list[str]:
    """Each artefact as a Parquet directory."""
    for name, df in books.items():
        df.write.mode("overwrite").parquet(f"{to}/{name}")
    return sorted(f"{to}/{name}" for name in books)
