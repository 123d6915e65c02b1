"""A synthetic dialysis cohort with planted defects, made by hashing row numbers: any size, the same rows every time, no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cohort(spark: SparkSession, rows: int = 600, seed: int = 0, defects: bool = True) -> DataFrame:
    """33 columns; with defects: words and codes for missing, censored values, mixed units and notations, impossible values,
    repeated ids, swapped sides of the session at one site, blank rows, a copied column and an identifier among the features."""
    k = F.col("id")

    def u(name: str) -> Column:
        return (F.pmod(F.xxhash64(k, F.lit(name), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    def normal(name: str, mean: float, sd: float, places: int = 1) -> Column:
        return F.round(mean + sd * F.sqrt(-2 * F.ln(u(name))) * F.cos(2 * math.pi * u(f"{name}'")), places)

    def pick(name: str, *levels: str) -> Column:
        return F.element_at(F.array(*map(F.lit, levels)), (F.floor(u(name) * len(levels)) + 1).cast("int"))

    day = lambda name, start, days: F.date_add(F.lit(start).cast("date"), F.floor(u(name) * days).cast("int"))
    age, risk = normal("age", 66, 11, 0), u("risk")
    start = day("start", "2013-01-01", 900)
    follow = F.floor(-F.ln(u("life")) * 1400 * F.exp((66 - age) / 40)).cast("int") + 1
    dead = follow < 1200
    weight, bun = normal("weight", 58, 9), normal("bun", 62, 13)
    columns = {
        "患者番号": F.format_string("K%07d", k), "施設": pick("site", "A院", "B院", "C院", "D院"), "性別": pick("sex", "男", "女"), "年齢": age,
        "身長": normal("height", 160, 9), "透析前体重": weight, "透析後体重": F.round(weight - 1 - 2 * u("loss"), 1), "透析歴(月)": F.floor(u("vintage") * 200).cast("double"),
        "糖尿病": pick("dm", "あり", "なし"), "NYHA": pick("nyha", "I", "II", "III", "IV"), "収縮期血圧": normal("sbp", 145, 18, 0), "拡張期血圧": normal("dbp", 78, 10, 0),
        "透析前BUN": bun, "透析後BUN": F.round(bun * (0.25 + 0.15 * u("urr")), 1), "透析前Cr": normal("cr", 10.5, 2.2), "透析後Cr": normal("cr2", 4.1, 0.8),
        "透析前K": normal("k", 4.9, 0.6), "透析前P": normal("p", 5.2, 1.2), "透析前Ca": normal("ca", 8.9, 0.6), "透析前Alb": normal("alb", 3.6, 0.3),
        "透析前Hb": normal("hb", 10.9, 1.0), "Fe": normal("fe", 62, 18, 0), "TIBC": normal("tibc", 250, 35, 0), "フェリチン": F.round(F.exp(4 + u("ferritin")), 0),
        "CRP": F.round(0.05 + u("crp") * u("crp2") * 3, 2), "iPTH": F.round(F.exp(4.2 + 1.4 * u("pth")), 0), "透析開始時刻": F.format_string("%d:%02d", (8 + F.floor(u("begin") * 3)).cast("int"), (F.floor(u("minute") * 4) * 15).cast("int")),
        "透析時間": F.round(3.5 + u("hours"), 1), "検体採取日": day("sample", "2013-01-01", 900), "観察開始日": start, "死亡日": F.when(dead, F.date_add(start, follow)), "打ち切り日": F.when(~dead, F.date_add(start, F.least(follow, F.lit(1200)))), "転帰": (risk < 0.15 + (age - 66) / 100).cast("int"),
    }
    text = {c: x if c in ("年齢", "転帰") else x.cast("string") for c, x in columns.items()}
    if defects:
        hit = lambda name, share: u(f"defect {name}") < share
        text |= {
            "患者番号": F.when(hit("id", 0.01), "K0000001").otherwise(text["患者番号"]),
            "CRP": F.when(hit("censored", 0.1), "<0.05").otherwise(text["CRP"]),
            "透析前Hb": F.when(hit("unit", 0.05), (columns["透析前Hb"] * 10).cast("string")).when(hit("word", 0.03), "未測定").otherwise(text["透析前Hb"]),
            "透析前K": F.when(hit("impossible", 0.01), "49").when(hit("code", 0.02), "9999").otherwise(text["透析前K"]),
            "Fe": F.when(hit("iron", 0.01), (columns["TIBC"] + 20).cast("string")).when(hit("blank iron", 0.08), None).otherwise(text["Fe"]),
            "性別": F.when(hit("width", 0.02), F.concat(text["性別"], F.lit("　"))).otherwise(text["性別"]),
            "検体採取日": F.when(hit("era", 0.2), F.concat(F.lit("H"), (F.year(columns["検体採取日"]) - 1988).cast("string"), F.date_format(columns["検体採取日"], "'.'M'.'d"))).when(hit("slash", 0.3), F.date_format(columns["検体採取日"], "yyyy/M/d")).otherwise(text["検体採取日"]),
            "透析前BUN": F.when(text["施設"] == "D院", text["透析後BUN"]).otherwise(text["透析前BUN"]),
            "透析後BUN": F.when(text["施設"] == "D院", text["透析前BUN"]).otherwise(text["透析後BUN"]),
            "打ち切り日": F.when(hit("both", 0.03), F.date_add(start, 10).cast("string")).otherwise(text["打ち切り日"]),
            "転帰": F.when(~hit("outcome", 0.02), columns["転帰"]),
        }
    return spark.range(rows).select(*[x.alias(c) for c, x in text.items()])
