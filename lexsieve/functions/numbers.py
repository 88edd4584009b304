"""Numbers spoken as English words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexsieve.functions.text import to_column

# Fixed values of English number names.
ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen "
    "fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
LATIN_LOW = "m b tr quadr quint sext sept oct non".split()
LATIN_UNITS = ["", *"un duo tre quattuor quin sex sept octo novem".split()]
LATIN_TENS = (
    "dec vigint trigint quadragint quinquagint sexagint septuagint octogint nonagint"
).split()

BELOW_HUNDRED = ONES + [
    ten if one == 0 else f"{ten}-{ONES[one]}" for ten in TENS for one in range(10)
]
SCALES = ["", " thousand"] + [
    f" {name}illion"
    for name in [*LATIN_LOW, *(u + t for t in LATIN_TENS for u in LATIN_UNITS), "cent"]
]
# Beyond the last name, names start again with it as their unit: a thousand centillion and so on.
LAST_SCALE = len(SCALES) - 1

NUMBER = "^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:E[+-]?[0-9]+)?$"


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _whole_and_rest(s: Column, max_exponent: int) -> tuple[Column, Column]:
    """Digits before and after the decimal point, after any exponent is worked in; null for
    an exponent beyond the limit, so that no text of that many zeros is made."""
    unsigned = F.ltrim(s, F.lit("+-"))
    mantissa = F.substring_index(unsigned, "E", 1)
    whole = F.substring_index(mantissa, ".", 1)
    rest = F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("")
    digits = F.concat(whole, rest)
    exponent = F.substring_index(s, "E", -1).try_cast("int")
    point = F.length(whole) + F.when(exponent.between(-max_exponent, max_exponent), exponent)
    moved_whole = F.when(point > 0, F.rpad(F.substring(digits, F.lit(1), point), point, "0")).otherwise("")
    moved_rest = F.when(point > 0, F.substring(digits, point + 1, F.length(digits))).otherwise(
        F.concat(F.repeat(F.lit("0"), -point), digits)
    )
    has_exponent = s.contains("E")
    known = point.isNotNull()
    return (
        F.ltrim(F.when(has_exponent, F.when(known, moved_whole)).otherwise(whole), F.lit("0")),
        F.rtrim(F.when(has_exponent, F.when(known, moved_rest)).otherwise(rest), F.lit("0")),
    )


def _cardinal(digits: Column) -> Column:
    """Words of a run of digits without leading zeros, three digits at a time."""
    below_hundred, scales = _literal(BELOW_HUNDRED), _literal(SCALES)
    padded = F.lpad(digits, F.ceil(F.length(digits) / 3).cast("int") * 3, "0")
    from_right = F.reverse(F.regexp_extract_all(padded, F.lit("([0-9]{3})"), 1))
    parts = F.reverse(
        F.transform(
            from_right,
            lambda g, i: F.struct(g.cast("int").alias("value"), i.alias("scale")),
        )
    )

    def spoken(part: Column, i: Column) -> Column:
        value, scale = part["value"], part["scale"]
        hundreds, low = F.floor(value / 100).cast("int"), value % 100
        link = (
            F.when(i == 0, "")
            .when((scale == 0) & (value < 100), " and ")
            .otherwise(", ")
        )
        return F.concat(
            link,
            F.when(hundreds > 0, F.concat(below_hundred[hundreds], F.lit(" hundred"))).otherwise(""),
            F.when((hundreds > 0) & (low > 0), " and ").otherwise(""),
            F.when(low > 0, below_hundred[low]).otherwise(""),
            scales[scale % LAST_SCALE],
            F.repeat(F.lit(SCALES[LAST_SCALE]), F.floor(scale / LAST_SCALE).cast("int")),
        )

    nonzero = F.filter(parts, lambda p: p["value"] > 0)
    return F.when(digits == "", "zero").otherwise(F.array_join(F.transform(nonzero, spoken), ""))


def number_to_words(c: Column | str, max_exponent: int = 100_000) -> Column:
    """English cardinal of a number or of text holding one; otherwise null.

    Works on the decimal text, so no digit is lost: every digit before the point and
    every digit after it, trailing zeros aside. Groups from 10**303 on are named by repeated
    centillions. A number in exponent form is null if its exponent is beyond
    ``max_exponent``, as a short text could ask for gigabytes of zeros.
    """
    s = F.translate(F.trim(to_column(c).cast("string")), "e", "E")
    whole, rest = _whole_and_rest(s, max_exponent)
    minus = F.when(s.startswith("-") & ((whole != "") | (rest != "")), "minus ").otherwise("")
    ones = _literal(ONES)
    decimals = F.when(
        rest != "",
        F.concat(
            F.lit(" point "),
            F.array_join(F.transform(F.split(rest, ""), lambda d: ones[d.cast("int")]), " "),
        ),
    ).otherwise("")
    return F.when(s.rlike(NUMBER), F.concat(minus, _cardinal(whole), decimals))
