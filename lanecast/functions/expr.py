"""Column-expression builders (all JVM-side, no UDFs).

NULL stands for a missing value everywhere; NaN is never produced on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanecast import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- H2 / strings -----------------------------------------------------------------

def strip(c) -> Column:
    """Python-style ``str.strip()``: removes leading/trailing white space of any kind.

    ``(?U)`` makes the white-space class Unicode-aware (no-break space, ideographic space,
    ...), as Python's ``str.strip()`` does; Spark's ``trim`` removes blanks only.
    """
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def place_key(c) -> Column:
    """H2: strip + lower."""
    return F.lower(strip(c))


def city_key(c) -> Column:
    """H1: first address token after the first that is neither empty nor 'india', else the first token.

    A NULL address is keyed as the text 'nan' (what a stringified missing value gives).
    """
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("nan")), ","), lambda p: F.lower(strip(p)))
    later = F.filter(parts, lambda p, i: (i > 0) & (p != F.lit("")) & (p != F.lit("india")))
    return F.coalesce(F.get(later, 0), F.get(parts, 0))


# --- H3 / H4 time -----------------------------------------------------------------

def hours_between(start, end) -> Column:
    """H3: (end - start) in fractional hours via whole microseconds; NULL if either is NULL."""
    us = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return us / F.lit(1_000_000.0) / F.lit(3600.0)


def weekday(c) -> Column:
    """H4: Monday = 0 ... Sunday = 6."""
    return F.weekday(col(c))


def is_peak_month(month_col) -> Column:
    return F.coalesce(col(month_col).isin(*K.PEAK_MONTHS), F.lit(False))


def season(month_col) -> Column:
    """H5: month -> season name."""
    m = col(month_col)
    expr = None
    for month, name in K.SEASON_MAP.items():
        expr = F.when(m == month, F.lit(name)) if expr is None else expr.when(m == month, F.lit(name))
    return expr


# --- H8 geometry ---------------------------------------------------------------------

def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """H8: great-circle distance in km, R = 6371, asin form."""
    la1, lo1, la2, lo2 = col(lat1), col(lon1), col(lat2), col(lon2)
    dlat = F.radians(la2 - la1)
    dlon = F.radians(lo2 - lo1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * F.pow(F.sin(dlon / 2), 2))
    return F.lit(6371.0) * 2 * F.asin(F.sqrt(a))


# --- H9 / H10 numeric ----------------------------------------------------------------

def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """np.clip semantics: NULL stays NULL (unlike greatest/least, which skip NULL) and NaN stays NaN."""
    x = col(c)
    out = x
    if hi is not None:
        out = F.when((x > hi) & ~F.isnan(x), F.lit(float(hi))).otherwise(out)
    if lo is not None:
        out = F.when(x < lo, F.lit(float(lo))).otherwise(out)
    return out


def not_nan(c) -> Column:
    """NaN -> NULL: a missing number is NULL everywhere in this library."""
    x = col(c)
    return F.when(~F.isnan(x), x)


def round_even(c, digits: int) -> Column:
    """H10, numpy rule: rint(x * 10^n) / 10^n (half-even on the scaled double)."""
    x = col(c)
    if digits == 0:
        return F.rint(x)
    p = float(10 ** digits)
    return F.rint(x * F.lit(p)) / F.lit(p)


_SPLIT = 134217729.0   # 2^27 + 1: Veltkamp split constant for an error-free product


def _split(v: float) -> tuple[float, float]:
    t = v * _SPLIT
    hi = t - (t - v)
    return hi, v - hi


def py_round(c, digits: int) -> Column:
    """H10, Python ``round(x, n)`` rule: half-even on the exact binary value of x.

    y = fl(x * 10^n) is rounded with rint, except when y lands exactly on .5: then the
    sign of the exact product's rounding error (Dekker two-product) decides the side.
    """
    x = col(c)
    p = float(10 ** digits)
    y = x * F.lit(p)
    t = x * F.lit(_SPLIT)
    xh = t - (t - x)
    xl = x - xh
    ph, pl = _split(p)
    err = ((xh * F.lit(ph) - y) + xh * F.lit(pl) + xl * F.lit(ph)) + xl * F.lit(pl)
    fl = F.floor(y).cast("double")
    tie = (y - fl) == F.lit(0.5)
    r = (F.when(tie & (err > 0), fl + F.lit(1.0)).when(tie & (err < 0), fl).otherwise(F.rint(y)))
    return r if digits == 0 else r / F.lit(p)


# --- H14 bands -----------------------------------------------------------------------

def distance_category(km) -> Column:
    """< 200 -> 0, < 500 -> 1, else 2 (NULL compares false -> 2)."""
    d = col(km)
    return F.when(d < 200, F.lit(0)).when(d < 500, F.lit(1)).otherwise(F.lit(2))


def efficiency_band(score) -> Column:
    """Service bands of the predicted efficiency."""
    s = col(score)
    return (F.when(s >= 0.85, F.lit("Elite")).when(s >= 0.65, F.lit("High"))
            .when(s >= 0.35, F.lit("Medium")).otherwise(F.lit("Low")))


def confidence_band(score) -> Column:
    s = col(score)
    return (F.when(s >= 0.82, F.lit("Elite")).when(s >= 0.62, F.lit("High"))
            .when(s >= 0.42, F.lit("Moderate")).otherwise(F.lit("Low")))


def delay_risk_label(p) -> Column:
    """Display label of the delay probability."""
    return F.when(col(p) < 0.3, F.lit("Low Risk")).otherwise(F.lit("High Risk"))


def score_colour(s) -> Column:
    """Display colour bands of a score."""
    x = col(s)
    return (F.when(x >= 0.75, F.lit("#34d399")).when(x >= 0.50, F.lit("#22d3ee"))
            .when(x >= 0.35, F.lit("#fbbf24")).otherwise(F.lit("#f87171")))


def market_flag(c) -> Column:
    """Stripped value equal to 'Regular' -> 1, anything else or NULL -> 0."""
    return F.coalesce((strip(c) == F.lit("Regular")).cast("int"), F.lit(0))


# --- H11 -------------------------------------------------------------------------------

def survival_note(feasible, c_survival) -> Column:
    """Fixed text when feasible, else the survival amount with thousands separators."""
    return F.when(col(feasible), F.lit("Trip covers driver survival earnings.")).otherwise(
        F.concat(F.lit("Price raised to survival floor Rs "), F.format_number(col(c_survival), 0),
                 F.lit(" — review route viability.")))
