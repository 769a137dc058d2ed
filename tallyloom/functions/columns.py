"""Column expressions: text, numbers, dates, coordinates and checks.

Everything here returns a ``Column`` built from native functions, so it stays
inside whole-stage code generation.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with accents and their plain ASCII letters.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -----------------------------------------------------------------


def snake_name(name: str) -> str:
    """Header text to snake_case."""
    import re

    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip())
    return re.sub(r"[^0-9A-Za-z]+", "_", spaced).strip("_").lower()


def extract_or_null(c: str | Column, pattern: str, group: int = 1) -> Column:
    """Capture group, NULL (not '') when the pattern does not match."""
    return F.when(col(c).rlike(pattern), F.regexp_extract(col(c), pattern, group))


def split_part_or_null(c: str | Column, pattern: str, index: int, limit: int = -1) -> Column:
    return F.get(F.split(col(c), pattern, limit), index)


def parse_number(c: str | Column) -> Column:
    """First number in a text ("$1,234.5 net" to 1234.5), NULL without one."""
    plain = F.regexp_replace(col(c), r"(?<=\d),(?=\d{3})", "")
    return F.regexp_substr(plain, F.lit(r"-?[0-9]+(\.[0-9]+)?")).try_cast("double")


def parse_percent(c: str | Column, decimal_comma: bool = True) -> Column:
    """"6,5%" to 0.065."""
    text = F.regexp_replace(col(c), r"[%\s]", "")
    if decimal_comma:
        text = F.translate(text, ",", ".")
    return text.try_cast("double") / 100


def to_int_truncating(c: str | Column) -> Column:
    """Integer cast that accepts "8.5" (to 8) and gives NULL for other text."""
    return col(c).try_cast("double").try_cast("int")


def strip_accents(c: str | Column) -> Column:
    return F.translate(col(c), ACCENTED, PLAIN)


def url_path(c: str | Column) -> Column:
    """Path of a URL without query string and fragment."""
    return F.parse_url(col(c), F.lit("PATH"))


def url_host(c: str | Column) -> Column:
    return F.parse_url(col(c), F.lit("HOST"))


def drop_query(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[?#].*$", "")


# --- codes, coordinates, distances ------------------------------------------


def binary_code(c: str | Column, zeros: str, ones: str) -> Column:
    """Integer from a text whose letters stand for binary digits."""
    digits = F.translate(col(c), zeros + ones, "0" * len(zeros) + "1" * len(ones))
    return F.conv(digits, 2, 10).cast("long")


def dms_to_degrees(c: str | Column) -> Column:
    """Degree-minute-second text with N/S/E/W, or plain decimal, to degrees."""
    text = F.trim(col(c))
    nums = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    part = lambda i: F.coalesce(F.get(nums, i).try_cast("double"), F.lit(0.0))
    sign = F.when(F.upper(text).rlike("[SW]$"), -1.0).otherwise(1.0)
    dms = sign * (part(0) + part(1) / 60 + part(2) / 3600)
    return F.when(F.upper(text).rlike("[NSEW]$"), dms).otherwise(text.try_cast("double"))


def centre_distance(cols: Sequence[str | Column], centre: float) -> Column:
    """Euclidean distance to the point (centre, centre, ...)."""
    squares = [F.pow(col(c) - F.lit(centre), F.lit(2.0)) for c in cols]
    return F.sqrt(functools.reduce(lambda a, b: a + b, squares))


def grown_bounds(lo: Column, hi: Column, fraction: float = 0.1) -> tuple[Column, Column]:
    """Range grown on both ends by a fraction of its length."""
    return lo - fraction * (hi - lo), hi + fraction * (hi - lo)


# --- dates ------------------------------------------------------------------


def day_month_year(c: str | Column) -> Column:
    return F.try_to_date(col(c), "d/M/yyyy")


def floor_minutes(c: str | Column, minutes: int) -> Column:
    """Start of the tumbling bucket a timestamp falls in."""
    return F.window(col(c), f"{minutes} minutes")["start"]


# --- arrays -----------------------------------------------------------------


def argmax_index(c: str | Column) -> Column:
    """1-based index of the first largest element."""
    return F.array_position(col(c), F.array_max(col(c)))


def elementwise_difference(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


# --- categories -------------------------------------------------------------


def level_code(c: str | Column, levels: Sequence[str], unlisted: str = "null") -> Column:
    """Ordinal (1-based) of a category in a fixed order.

    ``unlisted="last"`` puts unknown values after the listed ones.
    """
    if unlisted not in ("null", "last"):
        raise ValueError("unlisted must be 'null' or 'last'")
    code = F.array_position(F.array(*[F.lit(v) for v in levels]), col(c)).cast("int")
    other = F.lit(None).cast("int") if unlisted == "null" else F.lit(len(levels) + 1)
    return F.when(col(c).isNull(), F.lit(None).cast("int")).when(code > 0, code).otherwise(other)


def one_hot(c: str | Column, levels: Sequence) -> Column:
    return F.array(*[F.when(col(c) == F.lit(v), 1).otherwise(0) for v in levels])


def first_match(rules: Sequence[tuple[Column, Column | str | float]], default=None) -> Column:
    """Value of the first rule that holds, NULL when none does."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if default is None else out.otherwise(default)


# --- record checks -----------------------------------------------------------


def in_range(c: str | Column, lo: float, hi: float) -> Column:
    """TRUE only for a number inside [lo, hi]; missing or other text is FALSE."""
    return F.coalesce(col(c).try_cast("double").between(lo, hi), F.lit(False))


def range_by_unit(c: str | Column, ranges: dict[str, tuple[float, float]]) -> Column:
    """Number with a unit suffix; every unit has its own valid range."""
    out = F.lit(False)
    for unit, (lo, hi) in ranges.items():
        value = extract_or_null(c, rf"^(\d+){unit}$")
        out = out | in_range(value, lo, hi)
    return out


def has_format(c: str | Column, pattern: str) -> Column:
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def one_of(c: str | Column, values: Sequence[str]) -> Column:
    return F.coalesce(col(c).isin(*values), F.lit(False))


def exactly_one(a: Column, b: Column) -> Column:
    """Exclusive or of two conditions."""
    return a != b


def char_at_is(text: str | Column, position: str | Column, letter: str | Column) -> Column:
    return F.substr(col(text), col(position), F.lit(1)) == col(letter)


def char_count(text: str | Column, letter: str | Column) -> Column:
    """How often a letter occurs in a text."""
    return F.length(col(text)) - F.length(F.replace(col(text), col(letter), F.lit("")))


# --- seeded draws ------------------------------------------------------------


def hash_draw(seed: int, *keys: str | Column) -> Column:
    """Uniform 32-bit integer that depends only on the keys and the seed.

    Unlike ``rand()``, the draw of a row does not change with partitioning,
    retries or engine; MD5 is used so that any SQL engine gives the same value.
    """
    parts = [F.lit(str(seed)), *[col(k).cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def hash_uniform(seed: int, *keys: str | Column) -> Column:
    """Uniform value in [0, 1) from :func:`hash_draw`."""
    return hash_draw(seed, *keys) / F.lit(4294967296.0)


def hash_normal(seed: int, *keys: str | Column) -> Column:
    """Standard normal value by the Box-Muller transform of two draws."""
    u1 = (hash_draw(seed, *keys) + 1) / F.lit(4294967297.0)
    u2 = hash_uniform(seed + 1, *keys)
    return F.sqrt(-2 * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)
