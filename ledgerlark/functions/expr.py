"""Column expressions shared by the operators (all JVM-side built-ins, no UDFs).

Conventions: every coercion is a ``try_`` form (ANSI mode is on, bad input becomes
NULL, never an error); NaN is folded into NULL at ingest because the reference's
pandas code treats both as "missing".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c: Column, numeric: bool = False) -> Column:
    """``pd.to_numeric(errors="coerce")``: text or numbers to DOUBLE, bad/NaN -> NULL.
    ``numeric=True`` (input already numeric) skips the text round trip."""
    if numeric:
        return nan_to_null(c.cast("double"))
    return nan_to_null(F.trim(c.cast("string")).try_cast("double"))


def safe_numeric(c: Column, fill: float | None = 0.0, numeric: bool = False) -> Column:
    v = to_double(c, numeric)
    return v if fill is None else F.coalesce(v, F.lit(float(fill)))


def fix_percent(c: Column) -> Column:
    """``"13.56%"`` -> 13.56."""
    return nan_to_null(F.trim(F.replace(c.cast("string"), F.lit("%"), F.lit(""))).try_cast("double"))


def parse_month_year(c: Column) -> Column:
    """``"Dec-2015"`` -> DATE 2015-12-01; unparsable -> NULL. Text of the usual form is read by place, which gives what
    the parser gives at a part of its cost; any other goes to the parser."""
    months = "JanFebMarAprMayJunJulAugSepOctNovDec"
    usual = (F.length(c) == 7) & c.rlike("^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-(1[6-9]|[2-9][0-9])[0-9][0-9]")
    month = F.floor((F.instr(F.lit(months), F.substring(c, 1, 3)) + 2) / 3).cast("int")
    read = F.make_date(F.substring(c, 5, 4).try_cast("int"), month, F.lit(1))
    return F.when(usual, read).otherwise(F.try_to_timestamp(c, F.lit("MMM-yyyy")).cast("date"))


def first_int(c: Column) -> Column:
    """First run of digits as DOUBLE (``"10+ years"`` -> 10, ``"< 1 year"`` -> 1, ``"n/a"`` -> NULL)."""
    return F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("double")


def normalize_location(c: Column) -> Column:
    """Upper-case, keep ``[A-Z0-9 ]``, collapse spaces, trim; empty/NAN/NONE/NULL -> UNKNOWN."""
    s = F.upper(c.cast("string"))
    s = F.regexp_replace(s, r"[^A-Z0-9 ]", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(s.isNull() | s.isin("", "NAN", "NONE"), F.lit("UNKNOWN")).otherwise(s)


ISO_RE = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
DMY_RE = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})$"


def parse_mixed_dates(c: Column, pivot: int = 76) -> Column:
    """Day-first mixed-format dates.

    ``yyyy-mm-dd`` is read as ISO; ``d/m/y`` or ``d-m-y`` is day-first, falling back to
    month-first when the second number cannot be a month. Two-digit years ``yy`` map to
    ``2000+yy`` when ``yy < pivot`` else ``1900+yy`` (76 reproduces a 2026 run of the
    reference's parser). Impossible dates and other text -> NULL.
    """
    s = F.trim(c.cast("string"))
    yy = F.substring(s, -2, 2).try_cast("int")
    century = F.when(s.rlike(r"[/-]\d{2}\z"), F.when(yy < pivot, "20").otherwise("19")).otherwise("")

    def read(order: str) -> Column:
        # the numbers in ISO order, read by the cast: once for most rows, as each use of a part would split the text again
        return F.concat(century, F.regexp_replace(s, DMY_RE, order)).try_cast("date")

    # a day-first reading that is no date has a month that no month-first reading can save, unless its second number is above 12
    return F.when(s.rlike(ISO_RE), s.try_cast("date")).when(s.rlike(DMY_RE), F.coalesce(read("$3-$2-$1"), read("$3-$1-$2")))


def cut(c: Column, edges: list[float], labels: list[str]) -> Column:
    """``pd.cut(include_lowest=True)``: right-closed bins, the first also closed on the
    left; values outside every bin (or NULL) give the string ``"nan"``."""
    out = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = ((c >= lo) if i == 0 else (c > lo)) & (c <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit("nan"))


def band(c: Column, cuts: list[float], labels: list[str], right_closed: bool = True) -> Column:
    """Open-ended bands: ``labels[0]`` up to ``cuts[0]`` ... ``labels[-1]`` beyond the last cut."""
    out = None
    for cut_, label in zip(cuts, labels):
        cond = (c <= cut_) if right_closed else (c < cut_)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def threshold_label(c: Column, thresholds: list[float], labels: list[str], default: str) -> Column:
    """First label whose threshold ``c >= t`` holds, checked in order (High >= .65, ...)."""
    out = None
    for t, label in zip(thresholds, labels):
        out = F.when(c >= t, F.lit(label)) if out is None else out.when(c >= t, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def reasons(pairs: list[tuple[Column, str]], default: str | None = None, sep: str = ", ") -> Column:
    """Comma-joined reason text from (condition, text) pairs, in order."""
    arr = F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]), lambda x: x.isNotNull())
    joined = F.array_join(arr, sep)
    if default is None:
        return joined
    return F.when(F.size(arr) == 0, F.lit(default)).otherwise(joined)


def exact_mean2(c: str) -> Column:
    """Mean of a 2-decimal quantity (money, rates) computed from an exact DECIMAL sum,
    so every engine returns the same double whatever the summation order."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(c)


def exact_sum2(c: str) -> Column:
    """Exact sum of a 2-decimal quantity, as DOUBLE."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def rnd(c: Column, digits: int) -> Column:
    """Round half up as ``floor(x * 10^d + 0.5) / 10^d``: the same IEEE operations in
    every engine, so equal inputs give equal outputs even on exact ties."""
    p = float(10 ** digits)
    return (F.floor(c * p + 0.5) / p).cast("double")


def sql_rnd(expr: str, digits: int) -> str:
    p = float(10 ** digits)
    return f"(floor(({expr}) * {p!r} + 0.5) / {p!r})"
