"""Columns derived from others, only where all inputs are there and nobody has given the column already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import dates, dialysis
from cohortloom.plans.dictionary import pick

# fixed values: names of derived columns
HOURS, LOSS, URR, KTV, TSAT, CCA, CCAP, BMI = "透析時間(hr)", "除水量(kg)", "URR(%)", "spKt/V", "TSAT(%)", "iCa(mg/dL)", "iCa×P", "BMI"
CLOCKS = (("開始", "時"), ("start", "time")), (("終了", "時"), ("end", "time"))


def clock_column(columns: list[str], ways) -> str | None:
    return next((c for words in ways for c in columns if all(w in c.lower() for w in words)), None)


def number(c: str) -> Column:
    return F.col(f"`{c}`").try_cast("double")


def derive_dialysis(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Session hours, weight loss, urea reduction, spKt/V, TSAT, corrected calcium and its product with phosphate.

    Each step may use the columns of earlier ones.  A missing input gives NULL, never the uncorrected value.  Notes say
    what was made of which columns, and where a column without a timing stood in for one.
    """
    notes: list[str] = []

    def add(name: str, value: Column, places: int, *used: tuple[str, bool]) -> None:
        nonlocal df
        df = df.withColumn(name, F.round(value, places))
        notes.append(f"{name} from {', '.join(c for c, _ in used)}")
        notes.extend(f"{name}: {c} does not say its timing" for c, assumed in used if assumed)

    def of(item: str, when: str | None = None) -> tuple[str | None, bool]:
        return pick(df.columns, item, when)

    start, end = (clock_column(df.columns, w) for w in CLOCKS)
    if start and end and HOURS not in df.columns:
        add(HOURS, dates.session_hours(*(dates.to_hours(F.col(f"`{c}`")) for c in (start, end))), 2, (start, False), (end, False))
    before, after = of("weight", "pre"), of("weight", "post")
    if before[0] and after[0] and before[0] != after[0] and LOSS not in df.columns:
        add(LOSS, number(before[0]) - number(after[0]), 2, before, after)
    pre, post = of("BUN", "pre"), of("BUN", "post")
    both = pre[0] and post[0] and pre[0] != post[0]
    if both and URR not in df.columns:
        add(URR, F.when(number(pre[0]) != 0, (number(pre[0]) - number(post[0])) / number(pre[0]) * 100), 2, pre, post)
    hours = HOURS if HOURS in df.columns else of("Td")[0]
    if both and LOSS in df.columns and after[0] and hours and KTV not in df.columns:
        r = F.when(number(pre[0]) != 0, number(post[0]) / number(pre[0]))
        inner = r - number(hours) * 0.008
        add(KTV, -F.ln(F.when(inner > 0, inner)) + (F.lit(4.0) - r * 3.5) * F.col(f"`{LOSS}`") / F.when(number(after[0]) != 0, number(after[0])), 3, pre, post, (LOSS, False), (hours, False))
    iron, tibc = of("Fe"), of("TIBC")
    if iron[0] and tibc[0] and not of("TSAT")[0] and TSAT not in df.columns:
        add(TSAT, F.when(number(tibc[0]) != 0, number(iron[0]) / number(tibc[0]) * 100), 2, iron, tibc)
    ca, alb = of("Ca", "pre"), of("Alb", "pre")
    if ca[0] and alb[0] and CCA not in df.columns:
        add(CCA, dialysis.corrected_ca(number(ca[0]), number(alb[0])), 2, ca, alb)
    phosphate = of("P")
    if CCA in df.columns and phosphate[0] and CCAP not in df.columns:
        add(CCAP, F.col(f"`{CCA}`") * number(phosphate[0]), 2, (CCA, False), phosphate)
    return df, notes


def derive(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The body mass index, if there is none, then `derive_dialysis`."""
    height, weight = (pick(df.columns, k)[0] for k in ("height", "weight"))
    notes = []
    if height and weight and not pick(df.columns, "BMI")[0]:
        df = df.withColumn(BMI, F.round(dialysis.bmi(number(weight), number(height)), 2))
        notes.append(f"{BMI} from {weight}, {height}")
    df, more = derive_dialysis(df)
    return df, notes + more


def check_simple_inputs(df: DataFrame, post: str, next_pre: str) -> list[str]:
    """Warnings on inputs of the two-point mean: the next value before a session under the last one after it, or over 6 times it."""
    a, b = F.col(post), F.col(next_pre)
    low, high = df.agg(F.count_if(b < a), F.count_if((a > 0) & (b / a > 6))).first()
    return [f"{n} rows: {next_pre} {what} {post}" for n, what in ((low, "is under"), (high, "is over 6 times")) if n]
