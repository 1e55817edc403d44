"""Reusable column expressions; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolake.functions import constants as C

# Decimal inputs often land exactly on a rounding tie; this shift moves them off it, so that two engines round alike.
TIE_SHIFT = 1.234567e-10


def rnd(c, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(TIE_SHIFT), digits) + F.lit(0.0)


_CASTS = {"i": "bigint", "s": "string", "b": "boolean", "d": "string"}


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Project to the named and typed columns of ``spec``: ``name:i|s|b|d`` or ``name:f<digits>``."""
    cols = []
    for item in spec.split():
        name, kind = item.split(":")
        c = F.col(name)
        cols.append((rnd(c, int(kind[1:] or 6)) if kind[0] == "f" else c.cast(_CASTS[kind])).alias(name))
    return df.select(*cols)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp that keeps NULL (``greatest`` and ``least`` skip NULL)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def denan(c: Column) -> Column:
    """NaN and infinities become NULL, because Spark orders NaN above every number."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def day_num(date: str | Column) -> Column:
    return F.datediff(F.col(date) if isinstance(date, str) else date, F.lit(C.EPOCH).cast("date"))


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns({"year": F.year(d), "doy": F.dayofyear(d), "month": F.month(d), "day": day_num(d)})


def source_code(cols=C.SOURCES) -> Column:
    """Index of the first source that is present, -1 when none is."""
    out = F.lit(-1)
    for i in reversed(range(len(cols))):
        out = F.when(F.col(cols[i]).isNotNull(), F.lit(i)).otherwise(out)
    return out


def source_label(code: Column, none: str = "none") -> Column:
    out = F.lit(none)
    for i, name in enumerate(C.SOURCES):
        out = F.when(code == i, name).otherwise(out)
    return out


def source_offset(code: Column, offsets=C.SOURCE_OFFSET) -> Column:
    out = F.lit(None).cast("double")
    for i, v in enumerate(offsets):
        out = F.when(code == i, F.lit(float(v))).otherwise(out)
    return out


def encode(c: Column, mapping: dict) -> Column:
    """Dictionary code of a label, -1 for an unknown one."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(-1))


def parse_flag(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def in_season(doy: Column, lo: int = C.SEASON_DOY[0], hi: int = C.SEASON_DOY[1]) -> Column:
    return doy.between(lo, hi)


def status_from_z(z: Column, null_as_normal: bool = False) -> Column:
    c = F.when(z < C.Z_CRITICAL, "critical").when(z < C.Z_DEPRESSED, "depressed")
    return c.otherwise("normal") if null_as_normal else c.when(z.isNotNull(), "normal")


def phase_of(doy: Column) -> Column:
    out = F.lit("out_of_season")
    for name, lo, hi in C.PHASES:
        out = F.when(doy.between(lo, hi), name).otherwise(out)
    return out


def bin_week(doy: Column) -> Column:
    return F.floor((doy - C.SEASON_DOY[0]) / 7).cast("int")


def bin_days(doy: Column, n: int) -> Column:
    return (F.floor(doy / n) * n).cast("int")


def bin_edges(c: Column, edges, labels, right_closed: bool = True) -> Column:
    """Label of the interval between consecutive edges; the last one is open above."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, list(edges[1:]) + [None], labels))):
        low = (c > lo) if right_closed else (c >= lo)
        high = F.lit(True) if hi is None else ((c <= hi) if right_closed else (c < hi))
        out = F.when(low & high, label).otherwise(out)
    return out


def cycle_residue(day: Column, period: int) -> Column:
    return F.pmod(day, F.lit(period))


def on_fixed_grid(doy: Column) -> Column:
    return doy.isin(*C.GRID_DOY)


def bounded_score(rmse: Column) -> Column:
    return F.round(C.SCORE_MAX * F.greatest(F.lit(0.0), 1 - rmse / C.SCORE_RMSE) + F.lit(TIE_SHIFT), 2)


def normalized_difference(a: Column, b: Column, valid: Column) -> Column:
    return F.when(valid & (a >= 0) & (b >= 0) & (a + b > 0), (a - b) / (a + b))


def qa_clear(qa: Column, bits) -> Column:
    """True when the flag word is non-zero and none of the ``bits`` is set."""
    bad = F.lit(False)
    for bit in bits:
        bad = bad | (F.shiftright(qa, bit).bitwiseAND(1) == 1)
    return (qa != 0) & ~bad


def audit_equal(a: Column, b: Column, atol: float) -> Column:
    return F.avg(F.when(F.abs(a - b) <= atol, 1.0).otherwise(0.0))


def bbox_valid(s: Column, w: Column, n: Column, e: Column, max_deg2: float = 0.25) -> Column:
    return ((s >= -90) & (s < n) & (n <= 90) & (w >= -180) & (w < e) & (e <= 180)
            & ((n - s) * (e - w) <= max_deg2))


def bbox_area_ha(s: Column, w: Column, n: Column, e: Column) -> Column:
    return F.greatest((n - s) * (e - w) * 111.32 ** 2 * F.cos(F.radians((s + n) / 2)), F.lit(0.0)) * 100


def fingerprint(df: DataFrame, cols) -> DataFrame:
    """Order-free content hash: row count and the sum of 32-bit md5 prefixes."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")).alias("hash"))


def short_id(*cols: str, digits: int = 12) -> Column:
    """Stable id of a row's columns: the first hex digits of their sha256; NULL parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256), 1, digits)


def year_in_text(text: Column, known: Column) -> Column:
    """First year 1900 to 2099 that stands alone in the text and is one of the array ``known``; NULL if there is none.

    Digits or letters that touch a number make it another one. A NULL text or array gives NULL.
    """
    years = F.regexp_extract_all(text, F.lit(r"(?U)\b(?:19|20)[0-9]{2}\b"), F.lit(0)).cast("array<int>")
    return F.get(F.filter(years, lambda y: F.array_contains(known, y)), F.lit(0))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The noun's form after a whole number, by its last digits: 1 and 21 take ``one``, 2 to 4 and 22 ``few``, 5, 11 to 14 and 0 ``many``."""
    tens, units = F.abs(n) % 100, F.abs(n) % 10
    teen = tens.between(11, 14)
    return F.when(n.isNull(), None).when(~teen & (units == 1), one).when(~teen & units.between(2, 4), few).otherwise(many)


def counted(n: Column, one: str, few: str, many: str) -> Column:
    """The number and its noun; NULL for NULL."""
    return F.concat(n.cast("bigint").cast("string"), F.lit(" "), plural(n, one, few, many))


def over_entity(*extra: str):
    return Window.partitionBy("pid", *extra)
