"""Dialysis and nutrition indices as Column expressions.  Missing or invalid input gives NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def urr(pre: Column, post: Column) -> Column:
    return F.when(pre > 0, (1 - post / pre) * 100)


def sp_ktv(pre: Column, post: Column, hours: Column, weight_pre: Column, weight_post: Column) -> Column:
    r = F.when(pre > 0, post / pre)
    inner = r - hours * 0.008
    ok = _all(pre > 0, post > 0, hours > 0, hours < 72, weight_pre > 0, weight_post > 0, inner > 0)
    return F.when(ok, -F.ln(inner) + (F.lit(4.0) - r * 3.5) * (weight_pre - weight_post) / weight_post)


def npcr(ktv: Column, pre: Column, post: Column) -> Column:
    return ktv * 0.0136 * (pre + post) / 2 + 0.251


def percent_cgr(male: Column, age: Column, bun_pre, bun_post, cr_pre, cr_post, weight_pre, weight_post, hours) -> Column:
    """struct of all intermediates, the percentage and the reasons for a NULL; fixed coefficients as published."""
    loss = weight_pre - weight_post
    k = sp_ktv(bun_pre, bun_post, hours, weight_pre, weight_post)
    n = npcr(k, bun_pre, bun_post)
    bad = {
        "bun": ~_all(bun_pre > 0, bun_post > 0),
        "cr": ~_all(cr_pre > 0, cr_post > 0),
        "weight": ~_all(weight_pre > 0, weight_post > 0),
        "hours": ~_all(hours > 0, hours < 72),
    }
    ok = _all(*[~b for b in bad.values()])
    corrected = F.when(ok, (F.ln(cr_post / cr_pre) * -81.622 / (hours * 60) + 0.942) * cr_post)
    # ln and try_divide give NULL for what can't be, without a test that repeats the whole term: terms that name others
    # twice would double at each step
    log = F.ln(F.try_divide(corrected, cr_pre))
    d = (hours * 0.019 + 0.999) * log - (hours * 0.00367 - 0.0219)
    a = F.lit(3864.0) + (hours * 7.8 + 411) * log - hours * 1.5 - F.try_divide(F.lit(1449.0), d)
    total = cr_pre * (F.try_divide(F.lit(7056.0), a) + F.try_divide(F.try_divide(loss, weight_post) * 240, F.lit(72.0) - hours))
    external = n * n * 7.79 - n * 7.91 + 1.93
    internal = total - external
    reference = F.when(male, F.lit(23.53) - age * 0.15).otherwise(F.lit(19.58) - age * 0.12)
    reference = F.when(male.isNotNull(), reference)
    value = F.when((reference > 0) & (internal >= 0), internal / reference * 100)
    bad |= {"corrected": corrected <= 0, "d": d == 0, "a": a == 0, "reference": reference <= 0, "internal": internal < 0}
    reasons = F.array_compact(F.array(*[F.when(b, F.lit(name)) for name, b in bad.items()]))
    names = {"ktv": k, "npcr": n, "cr_corrected": corrected, "l": log, "d": d, "a": a, "g_total": total, "g_ext": external, "g_int": internal, "g_ref": reference, "value": value, "reasons": reasons}
    return F.struct(*[c.alias(x) for x, c in names.items()])


def clear_space(mass: Column, concentration: Column, volume: Column) -> Column:
    """struct(a, ratio, percent); may exceed 100."""
    a = F.when(_all(concentration > 0, mass >= 0), mass / (concentration * 10))
    ratio = F.when(volume > 0, a / volume)
    return F.struct(a.alias("a"), ratio.alias("ratio"), (ratio * 100).alias("percent"))


def removed_mass(concentration: Column, volume: Column) -> Column:
    return F.when((concentration >= 0) & (volume >= 0), concentration * volume * 10)


def clear_space_estimated(v_pre, v_post, c_pre, c_post, generation, hours) -> Column:
    return F.when((v_post > 0) & (c_pre > 0), (v_pre / v_post - c_post / c_pre + generation * hours / (c_pre * v_post * 10)) * 100)


def clear_space_by_weight(loss: Column, v_post: Column, c_pre: Column, c_post: Column) -> Column:
    return F.when((v_post > 0) & (c_pre > 0), (1 + loss / v_post - c_post / c_pre) * 100)


def salt_intake(gain: Column, sodium: Column, days: Column | None = None) -> Column:
    days = F.lit(2.0) if days is None else days
    return F.when(_all(gain >= 0, sodium > 0, days > 0), gain * sodium / 17 / days)


def bmi(weight: Column, height_cm: Column) -> Column:
    return F.when((weight > 0) & (height_cm > 0), weight / (height_cm / 100) / (height_cm / 100))


def ideal_weight(height_cm: Column) -> Column:
    return F.when(height_cm > 0, height_cm / 100 * height_cm / 100 * 22)


def weight_for_gnri(dry: Column, post: Column) -> Column:
    """struct(weight, source): the dry weight, else the one after the session, never the one before."""
    return F.struct(F.coalesce(dry, post).alias("weight"), F.when(dry.isNotNull(), "dry").when(post.isNotNull(), "post").alias("source"))


def gnri(albumin: Column, weight: Column, height_cm: Column) -> Column:
    r = weight / ideal_weight(height_cm)
    return albumin * 14.89 + F.when(r.isNotNull(), F.least(r, F.lit(1.0))) * 41.7


def corrected_ca(ca: Column, albumin: Column) -> Column:
    return F.when(albumin.isNotNull(), F.when(albumin < 4, ca + 4 - albumin).otherwise(ca))


def tsat(iron: Column, tibc: Column) -> Column:
    return F.when(tibc > 0, iron / tibc * 100)


def tac_simple(post: Column, next_pre: Column) -> Column:
    return F.when((post >= 0) & (next_pre >= 0), (post + next_pre) / 2)


def interdialytic_hours(interval: Column, session: Column) -> Column:
    return F.when(interval > session, interval - session)


def urea_from_bun(x: Column) -> Column:
    return x * 60 / 28


def bun_from_urea(x: Column) -> Column:
    return x * 28 / 60


def mmol_from_bun(x: Column) -> Column:
    """Urea in mmol/L from BUN in mg/dL."""
    return x / 2.8
