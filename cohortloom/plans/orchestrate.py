"""The whole way from a raw table to a model matrix, every step reported; accessories that fail are skipped with the reason."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.dates import read_dates
from cohortloom.operators import audit, clean, derived, prepare, profile, roles
from cohortloom.operators.multivariate import imputation_table
from cohortloom.operators.survival import binary_at, build_survival, choose_horizon, km_at
from cohortloom.plans import labels, runs
from cohortloom.session import release, stage
from cohortloom.sources.sheets import put


@dataclass
class Result:
    schema: roles.Schema
    frame: DataFrame
    books: dict[str, DataFrame] = field(default_factory=dict)
    findings: list[dict] = field(default_factory=list)
    actions: list[dict] = field(default_factory=list)
    messages: list[str] = field(default_factory=list)
    skipped: dict[str, str] = field(default_factory=dict)
    preparation: prepare.Preparation | None = None
    leaks: list[dict] = field(default_factory=list)
    settings: dict = field(default_factory=dict)
    raw: DataFrame | None = None

    def report(self, title: str = "Run", show_values: bool = False) -> str:
        """The run as an HTML page, what needs attention first; values of single cases only if asked for."""
        roles_ = [{"column": c, "role": s.role, "reason": s.reason, "action": s.action} for c, s in self.schema.columns.items()]
        small = {name: [r.asDict() for r in self.books[name].limit(50).collect()] for name in ("missing", "patterns", "km", "excluded_by_reason") if name in self.books}
        fitted = [{"column": c, **{k: round(v, 4) if isinstance(v, float) else v for k, v in x.items()}} for c, x in (self.preparation.fitted["numeric"] if self.preparation else {}).items()]
        sections = {"Settings": [{"setting": k, "value": str(v)} for k, v in self.settings.items()], "Roles": roles_, "Findings": self.findings, "Taken away": self.ledger(), **small, "Preparation": fitted, "Leaks": self.leaks, "Skipped": [{"what": k, "why": v} for k, v in self.skipped.items()]}
        return labels.report(title, {k: v or "none" for k, v in sections.items()}, self.messages, show_values)

    def ledger(self) -> list[dict]:
        """What was taken away: values by cleaning, columns by role, most first."""
        rows = [{"kind": "value", "target": a["column"], "count": a["count"], "reason": a["action"]} for a in self.actions]
        rows += [{"kind": "column", "target": c, "count": 1, "reason": s.reason} for c, s in self.schema.columns.items() if s.action == "drop"]
        return sorted(rows, key=lambda r: (r["kind"] != "column", -r["count"], r["target"]))


def quicklook(df: DataFrame, **settings) -> Result:
    """Everything up to the split."""
    return run(df, **settings, do_split=False)


DEFAULTS = {"target": None, "row": "_row_id", "entity": None, "ranges": None, "edits": None, "policy": None, "test": 0.25, "seed": 0, "do_split": True, "survival": None, "as_of": None, "grid": 30.0}


def resolved(saved: dict, given: dict) -> tuple[dict, list[str]]:
    """(settings, what differs): saved ones win over given ones; a given one that differs from both its default and the saved one is told."""
    out, told = DEFAULTS | given | {k: v for k, v in saved.items() if k in DEFAULTS}, []
    for k, v in given.items():
        if k not in DEFAULTS:
            raise ValueError(f"no setting {k!r}")
        if v != DEFAULTS[k] and out[k] != v:
            told.append(f"{k}: {v!r} was given, the saved {out[k]!r} is used")
    return out, told


def run(df: DataFrame, target: str | None = None, row: str = "_row_id", entity: str | None = None, ranges: dict | None = None, edits: dict | None = None, policy: dict | None = None, test: float = 0.25, seed: int = 0, do_split: bool = True, survival: tuple[str, str, str] | None = None, as_of: str | None = None, grid: float = 30.0) -> Result:
    """raw -> audit -> numbers -> ranges -> dates -> derived columns -> survival, horizon -> roles -> missing, outliers ->
    books -> split -> preparation fitted on train.

    survival names the start, event and censor dates; without a target the outcome is then the event within the best horizon.
    """
    settings = {k: v for k, v in locals().items() if k in DEFAULTS}
    if row not in df.columns:
        df = df.withColumn(row, F.monotonically_increasing_id())
    raw = df.drop(row)
    found = audit.audit(raw, entity, target)
    df, report = clean.clean_numeric(df)
    out = Result(roles.Schema({}), df, findings=found, actions=report.actions, settings=settings, raw=raw)
    out.messages += [f["message"] for f in found if f["severity"] == "error"]
    if ranges:
        df, out.books["range_violations"], problems = clean.apply_ranges(df, ranges)
        out.messages += problems
    # cells are read once: what follows works on the cleaned table, not on its expressions
    df = cleaned = stage(df)
    first = roles.infer(df.drop(row), target)
    days = [c for c, s in first.columns.items() if s.role == "datetime" and dict(df.dtypes)[c] == "string"]
    for d in read_dates(df, days) if days else []:
        if d.order.startswith("ambiguous") or d.n_parsed < 0.5 * (d.n_total - d.n_null):
            out.messages.append(f"{d.column}: left as text, the order of day and month is {d.order}")
        else:
            df = df.withColumn(d.column, d.expr)
    before = df.columns
    df, notes = derived.derive(df)
    out.messages += [n for n in notes if "does not say" in n]
    # a table to which nothing was added stays as it is, and so do its roles
    changed = bool(days or notes) or df.columns != before
    if changed:
        df = stage(df)
        release(cleaned)
    if survival:
        df, target = with_survival(df, out, row, survival, as_of, target, grid)
    inner = [c for c in (row, "reason", "duration", "event") if c in df.columns and (survival or c == row)]
    out.schema = roles.infer(df.drop(*inner), target) if changed or survival else first
    for c in survival or ():
        out.schema.columns[c].action = "drop"
    if edits:
        out.schema.override(edits)
    out.frame = df
    kept = [c for c, s in out.schema.columns.items() if s.action == "keep"]
    numbers = [c for c in kept if out.schema.columns[c].role == "numeric" and dict(df.dtypes)[c] != "string"]
    maps = {c: ([k for k, v in s.value_map.items() if v], [k for k, v in s.value_map.items() if not v]) for c, s in out.schema.columns.items() if s.role == "binary" and s.action == "keep" and s.value_map}
    ids = [c for c, s in out.schema.columns.items() if s.role == "id"]
    # the analysis book keeps every row; flags of censored values are kept columns themselves
    out.books["analysis"], told = clean.encode_binaries(df.select(row, *ids, *kept), maps)
    out.messages += [f"{t['column']}: {t['unread']} cells fit neither side" for t in told if t["unread"]]
    if target:
        why = {"no outcome": F.col(f"`{target}`").isNull()} | ({"no survival time": F.col("reason").isNotNull()} if survival else {})
        out.books["no_outcome"] = clean.without_outcome(df, row, why)
        of_role = lambda role: [c for c in out.schema.features() if out.schema.columns[c].role == role and c != target]
        out.books["model"] = clean.model_frame(df, target, [c for c in numbers if c != target], {c: m for c, m in maps.items() if c != target}, {c: out.schema.columns[c].order for c in of_role("ordinal")}, [*of_role("nominal"), *(c for c in of_role("binary") if c not in maps)])
    for name, f in {"missing": lambda: profile.missing_summary(df, kept), "patterns": lambda: profile.missing_patterns(df, kept)}.items():
        try:
            out.books[name] = f()
        except Exception as e:  # an accessory
            out.skipped[name] = str(e)[:200]
    if do_split and target:
        rows = df.filter(F.col(target).isNotNull())
        split = prepare.split_group(rows, entity, test, seed) if entity and rows.groupBy(entity).count().filter("count > 1").limit(1).count() else prepare.split_random(rows, row, test, target if out.schema.columns[target].n_unique <= 10 else None, seed)
        split = stage(split)  # all that follows reads it
        features = out.schema.features()
        of = lambda role: [c for c in features if out.schema.columns[c].role == role]
        maps = {c: m for c, m in maps.items() if c in features}
        p = prepare.Preparation(numeric=[c for c in numbers if c in features], ordinal={c: out.schema.columns[c].order for c in of("ordinal")}, binary=maps, nominal=[*of("nominal"), *(c for c in of("binary") if c not in maps)], policy=policy or {})
        train, held = prepare.sides(split)
        out.preparation = p.fit(train)
        out.books["train"], out.books["test"] = (p.transform(s, [row, target]) for s in (train, held))
        out.leaks = prepare.leak_check(split, row, [*p.numeric, *p.ordinal, *p.binary, *p.nominal], target, entity)
        imputed = imputation_table(train.df, held.df, p.fitted)
        out.messages += [f"{r['column']}: {r['train']:.0%} of train imputed with the {r['method']}" for r in imputed if r["train"] and r["train"] >= 0.2]
    return out


def with_survival(df: DataFrame, out: Result, row: str, survival: tuple[str, str, str], as_of: str | None, target: str | None, grid: float) -> tuple[DataFrame, str | None]:
    """df with reason, duration and event beside every row (missing where a rule fails), and the outcome's name."""
    if not as_of:
        raise ValueError("survival needs as_of, the day of the data")
    start, event, censor = (F.col(f"`{c}`").cast("date") for c in survival)
    df = build_survival(df, start, event, censor, F.lit(as_of).cast("date"))
    out.findings += audit.survival_dates(df.select(start.alias("s"), event.alias("e"), censor.alias("c")), "s", "e", "c")
    out.books["survival"] = df.filter("reason IS NULL").select(row, "duration", "event")
    out.books["excluded_by_reason"] = df.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    out.books["km"] = km_at(df, "duration", "event", [365.25, 3 * 365.25])
    if target is None:
        best = choose_horizon(df.filter("reason IS NULL"), "duration", "event", grid)
        if best:
            target = "outcome_at_horizon"
            df = df.withColumn(target, binary_at(F.col("duration"), F.col("event"), best["tau"]))
            out.messages.append(f"the outcome is the event within {best['tau']:g} days; {best['undetermined']:.0%} of the rows are undetermined")
    return df, target


def save(result: Result, base: str) -> str:
    """Everything of a run in a numbered folder: raw table and books as Parquet, schema, settings, report, log; its path."""
    spark = result.frame.sparkSession
    to = runs.new_run(spark, base)
    books = {"raw": result.raw, **result.books}
    for name, book in books.items():
        book.write.parquet(f"{to}/table/{name}")
    put(spark, f"{to}/table/schema.yaml", result.schema.to_yaml().encode())
    put(spark, f"{to}/report/report.html", result.report(to.rsplit("/", 1)[-1]).encode())
    put(spark, f"{to}/report/attention.txt", labels.attention(result.messages))
    runs.write_log(spark, to, status="done", settings=json.dumps(result.settings, ensure_ascii=False), books=sorted(result.books))
    return to


def reproduce(spark: SparkSession, saved: str, base: str, **given) -> list[dict]:
    """Run again from a saved run's raw table, settings and roles, save that, and compare every book as a bag of rows."""
    log = spark.read.json(f"{saved}/log.json").first()
    settings, told = resolved(json.loads(log.settings), given)
    schema = roles.Schema.from_yaml(spark.read.text(f"{saved}/table/schema.yaml", wholetext=True).first()[0])
    raw = spark.read.parquet(f"{saved}/table/raw")
    again = run(raw, **settings)
    out = [{"book": "schema", "same": not schema.diff(again.schema)}, *({"book": t, "same": False} for t in told)]
    # row numbers are given anew with each run, so they are no part of a book's content
    return out + runs.reproduced(spark, saved, save(again, base), list(log.books), drop=(settings["row"],))
