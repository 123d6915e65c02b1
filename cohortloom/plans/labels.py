"""Names and texts for people: labels with unit and timing, English names, tables as text and HTML, messages, reports."""

from __future__ import annotations

import html
import re
import unicodedata

from cohortloom.plans.dictionary import ITEMS, TARGETS, folded_name, item_of, timing

# fixed values: what a 0/1 column is called after its 1
ONE_NAMES = {"男": "男性", "男性": "男性", "m": "男性", "male": "男性", "死亡": "死亡"}
# fixed values: English forms of units, levels, timings and suffixes
UNITS = {"歳": "years", "月": "months", "日": "days", "年": "years", "時間": "hours", "hr": "hours", "分": "minutes", "秒": "seconds", "比": "ratio", "回": "times", "件": "n", "例": "n", "人": "n"}
LEVELS = {"男": "Male", "女": "Female", "男性": "Male", "女性": "Female", "あり": "Yes", "なし": "No", "有": "Yes", "無": "No", "はい": "Yes", "いいえ": "No", "陽性": "Positive", "陰性": "Negative", "死亡": "Died", "生存": "Alive", "その他": "Other"}
TIMINGS = {"pre": "Pre-dialysis", "post": "Post-dialysis"}
SIGNS = {"pre": "透析前", "post": "透析後"}
PLACES = {"病院": "Hospital", "院": "Hospital", "クリニック": "Clinic"}
NAMES = {"age": "Age", "height": "Height", "weight": "Body weight", "DW": "Dry weight", "BMI": "Body mass index", "vintage": "Dialysis vintage", "SBP": "Systolic blood pressure", "DBP": "Diastolic blood pressure", "Td": "Treatment time", "UF": "Ultrafiltration volume", "KtV": "Kt/V", "BUN": "Blood urea nitrogen", "Cr": "Creatinine", "P": "Phosphate", "Ca": "Calcium", "Alb": "Albumin", "TP": "Total protein", "K": "Potassium", "Na": "Sodium", "Cl": "Chloride", "Mg": "Magnesium", "UA": "Uric acid", "Fe": "Iron", "Hb": "Haemoglobin", "Ht": "Haematocrit", "WBC": "White blood cells", "RBC": "Red blood cells", "Plt": "Platelets", "CRP": "C-reactive protein", "GLU": "Glucose", "cCa": "Corrected calcium", "TSAT": "Transferrin saturation", "Ferritin": "Ferritin", "GNRI": "Geriatric nutritional risk index"}


def binary_name(column: str, ones: list[str]) -> str:
    """What a 0/1 column is called: its 1 where that says more than the column, else the column."""
    return next((ONE_NAMES[folded_name(v)] for v in ones if folded_name(v) in ONE_NAMES), column)


def unit_en(unit: str) -> str:
    return UNITS.get(unicodedata.normalize("NFKC", unit).strip(), unit)


def level_en(level: str) -> str:
    """A level in English; "A院" becomes "Hospital A"; an unknown one stays, it is never spelt in Latin letters."""
    v = unicodedata.normalize("NFKC", str(level)).strip()
    if v in LEVELS:
        return LEVELS[v]
    for end, name in PLACES.items():
        head = v.removesuffix(end)
        if head != v and head and head.isascii():
            return f"{name} {head}"
    return v


def column_en(column: str) -> str:
    """A column in English by its dictionary item and timing; an unknown one stays."""
    name, (when, _) = NAMES.get(item_of(column) or ""), timing(column)
    if name is None:
        return column
    return f"{TIMINGS[when]} {name[0].lower()}{name[1:]}" if when in TIMINGS else name


def missing_english(columns: list[str]) -> list[str]:
    return [c for c in columns if column_en(c) == c and not c.isascii()]


def label(column: str) -> str:
    """A column with its unit and timing, as tables show it."""
    k, (when, _) = item_of(column), timing(column)
    unit = ITEMS[k][0] if k else ""
    return column + (f" [{unit}]" if unit not in ("", "index") else "") + (f"（{SIGNS[when]}）" if when in SIGNS else "")


def target_text(item: str) -> str:
    """A target in words: 3.5 ≤ P < 5.5."""
    low, low_in, high, high_in = TARGETS[item]
    left = f"{low:g} {'≤' if low_in else '<'} " if low is not None else ""
    return f"{left}{item}" + (f" {'≤' if high_in else '<'} {high:g}" if high is not None else "")


def width(text: str) -> int:
    """Columns a text takes on a terminal: East Asian wide characters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def text_table(rows: list[dict]) -> str:
    """Rows as text with columns in line, numbers to the right."""
    if not rows:
        return ""
    names = list(rows[0])
    cells = [names, *[["" if r.get(n) is None else f"{r[n]:g}" if isinstance(r[n], float) else str(r[n]) for n in names] for r in rows]]
    wide = [max(width(r[i]) for r in cells) for i in range(len(names))]
    right = [all(isinstance(r.get(n), (int, float, type(None))) for r in rows) for n in names]
    pad = lambda c, i: " " * (wide[i] - width(c)) + c if right[i] else c + " " * (wide[i] - width(c))
    return "\n".join("  ".join(pad(c, i) for i, c in enumerate(r)).rstrip() for r in cells)


def html_table(rows: list[dict], title: str = "") -> str:
    if not rows:
        return ""
    head = "".join(f"<th>{html.escape(str(n))}</th>" for n in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><caption>{html.escape(title)}</caption><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def entry_messages(suspects: list[dict], column: str) -> list[str]:
    """One sentence for the suspected entry errors of a column; values stand where `masked` hides them."""
    if not suspects:
        return []
    top = max(suspects, key=lambda r: r["z"])
    values = ", ".join(f"{r['row']}: {r['value']:g}" for r in suspects)
    return [f"{column}: {len(suspects)} values may be entry errors (e.g. [{values}]); the farthest has a robust z of {top['z']:g}"]


def masked(message: str) -> str:
    """A message without values of single cases."""
    return re.sub(r"\(e\.g\. \[.*?\]\)", "(e.g. [...])", message)


def attention(messages: list[str], show_values: bool = False) -> bytes:
    """Messages as a text file for spreadsheet programs: UTF-8 with its mark, lines end in CRLF."""
    return ("\ufeff" + "".join(f"{i}. {m if show_values else masked(m)}\r\n" for i, m in enumerate(messages, 1))).encode()


def report(title: str, sections: dict[str, list[dict] | str], messages: list[str], show_values: bool = False) -> str:
    """An HTML page: messages first, then numbered sections of tables or text."""
    said = "".join(f"<li>{html.escape(m if show_values else masked(m))}</li>" for m in messages)
    parts = "".join(f"<h2>{i}. {html.escape(name)}</h2>" + (f"<p>{html.escape(x)}</p>" if isinstance(x, str) else html_table(x, name)) for i, (name, x) in enumerate(sections.items(), 1))
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{said}</ul>{parts}</body></html>'
