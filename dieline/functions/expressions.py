"""Column expressions for flags, predicates, labels and identity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """True for values that are neither null nor NaN; a comparison with NaN must not count."""
    return value.isNotNull() & ~F.isnan(value)


def finite(value: Column) -> Column:
    return number(value) & (F.abs(value) < F.lit(float("inf")))


def outside(result: Column, low: Column, high: Column) -> Column:
    """result below low or above high; a side that is null or NaN never fails."""
    below = F.coalesce(number(result) & number(low) & (result < low), F.lit(False))
    above = F.coalesce(number(result) & number(high) & (result > high), F.lit(False))
    return below | above


def failed(test_pass: Column, result: Column, low: Column, high: Column) -> Column:
    """Row failure (P1): a failing flag or a result outside the limits."""
    return F.coalesce(~test_pass, F.lit(False)) | outside(result, low, high)


def limit_failed(result: Column, low: Column, high: Column) -> Column:
    """Limit failure (P2): as above, for finite results only."""
    return F.coalesce(finite(result), F.lit(False)) & outside(result, low, high)


def percent(part: Column, total: Column) -> Column:
    """part of total in percent; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part * 100.0 / total)


def test_label(num: Column, text: Column) -> Column:
    named = F.concat(num.cast("string"), F.lit(" - "), text)
    return F.when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit("TEST "), num.cast("string"))).otherwise(named)


def wafer_label(wafer: Column) -> Column:
    return F.coalesce(wafer, F.lit("(no wafer)"))


def site_label(head: Column, site: Column) -> Column:
    return F.concat(F.lit("H"), head.cast("string"), F.lit(" / S"), site.cast("string"))


def bin_label(kind: str, number_: Column) -> Column:
    return F.concat(F.lit(f"{kind} "), number_.cast("string"))


def ptr_passed(test_flg: Column) -> Column:
    """Null where bit 6 says that the flag isn't valid, else whether bit 7 is clear."""
    return F.when(test_flg.bitwiseAND(0x40) == 0, test_flg.bitwiseAND(0x80) == 0)


def part_passed(part_flg: Column) -> Column:
    """Bits 3 and 4 clear: a part without an indication doesn't pass."""
    return part_flg.bitwiseAND(0x18) == 0


def traced_passed(part_flg: Column) -> Column:
    """X11: null for abnormal ends or missing indications (bits 2 and 4), else bit 3 clear."""
    return F.when(part_flg.bitwiseAND(0x14) == 0, part_flg.bitwiseAND(0x08) == 0)


def valid_bin(bin_: Column) -> Column:
    return F.when(bin_ <= 32767, bin_)


def limits_valid(opt_flag: Column) -> tuple[Column, Column]:
    """Whether the low and the high limit of a PTR hold."""
    return (
        F.coalesce(opt_flag.bitwiseAND(0x50) == 0, F.lit(False)),
        F.coalesce(opt_flag.bitwiseAND(0xA0) == 0, F.lit(False)),
    )


def wafer_key(wafer: Column, x: Column, y: Column) -> Column:
    """["wafer-prr",wafer,x,y] for an upper-case alphanumeric wafer and positive coordinates."""
    good = wafer.rlike(r"^[A-Z0-9]+\z") & (x > 0) & (y > 0)
    return F.when(good, F.concat(F.lit('["wafer-prr","'), wafer, F.lit('",'), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]")))


def lot_key(lot: Column, x: Column, y: Column) -> Column:
    """["lot-ptr",lot,x,y] for a lot with both measured axes; the lot is JSON-escaped."""
    quoted = F.to_json(F.array(lot))
    inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    good = (F.coalesce(lot, F.lit("")) != "") & x.isNotNull() & y.isNotNull()
    return F.when(good, F.concat(F.lit('["lot-ptr",'), inner, F.lit(","), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]")))


def positive_integer(value: Column) -> Column:
    """I4: the value as bigint if it is finite, positive, integral and below 2 ** 63."""
    wide = value.cast("double")
    good = finite(wide) & (wide > 0) & (wide == F.floor(wide)) & (wide < 2.0**63)
    return F.when(good, wide.try_cast("bigint"))


#: Substrings that name an axis outright (I3), with "x" for the axis.
AXIS_NAMES = (
    "coordx", "xcoord", "coordinatex", "positionx", "xposition", "locationx", "xlocation", "diex", "xdie", "waferx", "xwafer",
)


def _capital(letter: str) -> str:
    """The one code point that is a letter's capital; where upper() takes several, its title letter, if that is one."""
    if letter == "\u00df":
        return "\u1e9e"
    return next((c for c in (letter.upper(), letter.title()) if len(c) == 1), letter)


#: No letter beyond the first two planes has a case.
_CAPITALS = {c: u for c in map(chr, range(0x20000)) if (u := _capital(c)) != c}


def upper_letters(text: Column) -> Column:
    """text with each code point in upper case for itself, as DuckDB has it, so that its length stays; upper() makes SS of a sharp s."""
    return F.translate(text, "".join(_CAPITALS), "".join(_CAPITALS.values()))


def axis(name: Column) -> Column:
    """struct<axis, rank> of a test name; rank 2 for an explicit axis, 1 for a bare letter, else null.

    Camel case splits words; a word that is the letter alone, or one of AXIS_NAMES, is explicit. Names
    that point at both axes at the same rank are ambiguous.
    """
    split = F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    words = F.split(F.lower(split), "[^a-z]+")
    lower = F.lower(name)

    def explicit(letter: str) -> Column:
        names = "|".join(n.replace("x", letter) for n in AXIS_NAMES)
        return F.array_contains(words, letter) | lower.rlike(names)

    x2, y2 = explicit("x"), explicit("y")
    x1, y1 = lower.contains("x"), lower.contains("y")

    def result(letter: str, rank: int) -> Column:
        return F.struct(F.lit(letter).alias("axis"), F.lit(rank).alias("rank"))

    return (
        F.when(x2 & y2, F.lit(None))
        .when(x2, result("x", 2))
        .when(y2, result("y", 2))
        .when(x1 & y1, F.lit(None))
        .when(x1, result("x", 1))
        .when(y1, result("y", 1))
    )


#: SI prefixes by scale exponent (SC8).
PREFIXES = {15: "f", 12: "p", 9: "n", 6: "u", 3: "m", 2: "%", 0: "", -3: "K", -6: "M", -9: "G", -12: "T"}


def epoch_text(seconds: Column) -> Column:
    """SC6: DD-Mon-YYYY HH:MM:SS; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "dd-MMM-yyyy HH:mm:ss")


def scoped_part_key(key: Column, source: Column, sequence: Column) -> Column:
    """The merge key, or else a key that only this attempt of this source has."""
    own = F.concat(F.lit('["unresolved","'), source, F.lit('",'), sequence.cast("string"), F.lit("]"))
    return F.coalesce(key, own)
