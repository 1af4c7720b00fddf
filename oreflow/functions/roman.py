"""Integer to Roman numeral as a plain Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_NUMBER = 1
MAX_NUMBER = 3999

# Numeral of each decimal digit by place.
THOUSANDS = ["", "M", "MM", "MMM"]
HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]

# Fixed value: alphabet of a numeral.
NUMERAL_PATTERN = "^[MDCLXVI]+$"
# Fixed value: numerals made of one repeated symbol.
SINGLE_SYMBOL_PATTERN = "^(I{1,3}|V|X{1,3}|L|C{1,3}|D|M{1,3})$"


def in_domain(number: Column) -> Column:
    """True when the number has a numeral."""
    return number.between(MIN_NUMBER, MAX_NUMBER)


def _digit(number: Column, divisor: int, numerals: list[str]) -> Column:
    position = F.floor(number / F.lit(divisor)).cast("int") % 10
    return F.element_at(F.array(*[F.lit(n) for n in numerals]), position + 1)


def to_roman(number: Column) -> Column:
    """Numeral text, NULL outside 1..3999."""
    return F.when(
        in_domain(number),
        F.concat(
            _digit(number, 1000, THOUSANDS),
            _digit(number, 100, HUNDREDS),
            _digit(number, 10, TENS),
            _digit(number, 1, ONES),
        ),
    )


def audit_reason(number: Column, numeral: Column) -> Column:
    """Why a recorded numeral is wrong; NULL when it is right."""
    return (
        F.when(numeral.isNull() & number.isNull(), F.lit(None).cast("string"))
        .when(numeral.isNull(), F.lit("MISSING"))
        .when(~numeral.rlike(NUMERAL_PATTERN), F.lit("BAD_ALPHABET"))
        .when(~numeral.eqNullSafe(to_roman(number)), F.lit("MISMATCH"))
    )


def range_reject_reason(low: Column, high: Column) -> Column:
    """Why a range request is refused; NULL when it is valid."""
    return (
        F.when(low.isNull() | high.isNull(), F.lit("MISSING_BOUND"))
        .when(~in_domain(low), F.lit("MIN_OUT_OF_RANGE"))
        .when(~in_domain(high), F.lit("MAX_OUT_OF_RANGE"))
        .when(low >= high, F.lit("MIN_NOT_BELOW_MAX"))
    )


def size_bucket(number: Column) -> Column:
    """Size class of a number."""
    # Class labels.
    return (
        F.when(number <= 10, "1-10 (Small)")
        .when(number <= 100, "11-100 (Medium)")
        .when(number <= 1000, "101-1000 (Large)")
        .otherwise("1001-3999 (Very Large)")
    )


def roundness(number: Column) -> Column:
    """Roundness class of a number; the first matching divisor wins."""
    # Divisors and labels.
    label = None
    for divisor in (100, 50, 10, 5):
        test, text = number % divisor == 0, f"Multiple of {divisor}"
        label = F.when(test, text) if label is None else label.when(test, text)
    return label.otherwise("Other")
