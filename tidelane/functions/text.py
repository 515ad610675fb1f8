"""Text clean-up, numbers in texts, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET_PER_METRE = 3.28084
# The patterns in this module follow the wording and layout of the sources' texts (fixed values).


def station_name(name: Column) -> Column:
    """Without a trailing offset such as ``, 0.6 mi. NE of`` and what follows it."""
    short = F.regexp_replace(name, r"(?i),\s*\d+(?:\.\d+)?\s*(?:mi\.?|miles?)\b.*$", "")
    return F.regexp_replace(short, r"[ ,]+$", "")


def display_name(short: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(short, F.lit("")), station_name(name))


def decimals(number: Column) -> Column:
    """Digits behind the first dot of a number's text; 0 without one."""
    t = F.trim(number)
    return F.when(F.instr(t, ".") > 0, F.length(t) - F.instr(t, ".")).otherwise(0).cast("int")


def close_gaps(line: Column) -> Column:
    """Numbers torn by the layout: ``4 .8`` and ``4. 8`` are 4.8, ``- 0.1`` is -0.1."""
    out = F.regexp_replace(line, r"(?<=\d)\s+(?=\.)", "")
    out = F.regexp_replace(out, r"(?<=\.)\s+(?=\d)", "")
    return F.regexp_replace(out, r"(?<!\S)-\s+(?=\d)", "-")


def split_joined_diff(line: Column) -> Column:
    """Hours and minutes written together: ``+013`` is ``+0 13``."""
    return F.regexp_replace(line, r"(?<![\w.])([+-]\d)(\d{2})(?![\d.:])", "$1 $2")


def recover_dotted_diff(line: Column) -> Column:
    """``+0.05`` as ``+0 05``, for a line that failed as it stands."""
    return F.regexp_replace(line, r"(?<!\d)([+-]\d)\.(\d{2})(?!\S)", "$1 $2")


def time_diff(raw: Column) -> Column:
    """``-0 22`` as ``-00:22``; marks of footnotes are dropped; null if it is no difference."""
    g = lambda i: F.regexp_extract(raw, r"^\s*([+-]?)\s*(\d{1,2})[ :](\d{2})\s*(?:\*|\(a\))?\s*$", i)
    sign = F.when(g(1) == "-", "-").otherwise("+")
    return F.when(g(3) != "", F.concat(sign, F.lpad(g(2), 2, "0"), F.lit(":"), g(3)))


def has_footnote(raw: Column) -> Column:
    return raw.rlike(r"\*|\(a\)")


def feet(metres: Column) -> Column:
    return F.round(metres * FEET_PER_METRE, 1)


def one_decimal(value: Column) -> Column:
    """A number with one decimal, rounded by its exact value: to the nearer tenth, and away from zero from the middle.

    Ten times a double is rounded itself, so a value that looks like a middle is held against it by exact parts: the double
    is split into two halves of 26 digits, whose multiples are exact. Beyond 2**48 a double has no tenths to round."""
    size = F.abs(value)
    tenths = F.floor(size * 10 + 0.5)
    high = size * 134217729.0 - (size * 134217729.0 - size)  # 2**27 + 1
    above = (high * 20 - (2 * tenths - 1)) + (size - high) * 20  # 20 * size - (2 * tenths - 1): below zero, a tenth less
    near = F.abs(size * 20 - (2 * tenths - 1)) < 1e-3
    exact = F.when(near & (above < 0), tenths - 1).otherwise(tenths).cast("long")
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.floor(exact / 10).cast("string"), F.lit("."), (exact % 10).cast("string"))
    return F.when(size < 2.0**48, text).otherwise(F.format_string("%.1f", value))


def height_text(metres: Column, in_feet: bool = False) -> Column:
    """A height with one decimal and its unit."""
    value = metres * FEET_PER_METRE if in_feet else metres
    return F.concat(one_decimal(value), F.lit(" ft" if in_feet else " m"))


def speed_text(knots: Column) -> Column:
    """A speed with its sign, one decimal and the unit."""
    return F.concat(one_decimal(knots), F.lit(" kt"))


def speed_value(knots: Column) -> Column:
    """A speed without sign or unit, for a marker."""
    return one_decimal(F.abs(knots))


def upper_key(name: Column) -> Column:
    """Upper case with every run of other characters one space."""
    return F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))
