"""Scalar expressions: missing values, clipping, logs, text formats, hash randomness."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NaN and +-infinity become NULL, so that every aggregate skips them."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: Column | str, lo, hi) -> Column:
    """Bound ``x``; a missing ``x`` stays missing (``greatest`` alone would skip it)."""
    x = col(x)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))


def floor_at_one(pred: Column | str) -> Column:
    """Predicted life is at least one cycle."""
    x = col(pred)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(1.0)))


def clip_probability(p: Column | str, eps: float = 1e-6) -> Column:
    return clip(p, eps, 1.0 - eps)


def in_range_or_null(x: Column | str, lo, hi) -> Column:
    x = col(x)
    return F.when(x.between(lo, hi), x)


def positive_or_null(x: Column | str) -> Column:
    x = col(x)
    return F.when(x > 0, x)


def zero_if_missing(x: Column | str) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def ratio(a, b) -> Column:
    """Division that yields NULL on a zero divisor (ANSI ``/`` would raise)."""
    return F.try_divide(col(a), col(b))


def log10_abs(x: Column | str, eps: float = EPS) -> Column:
    return F.log10(F.abs(col(x)) + F.lit(eps))


def ln_eps(x: Column | str, eps: float = EPS) -> Column:
    return F.log(col(x) + F.lit(eps))


def percent_effect(phi: Column | str) -> Column:
    """Effect in ln(life) as a percentage change of life."""
    return F.lit(100.0) * F.expm1(col(phi))


def format_g(x: Column | str) -> Column:
    """Shortest text of a number with six significant digits: 3.6 -> '3.6', 80.0 -> '80', 123.4567891 -> '123.457', 1e-7 -> '1e-07'."""
    x = col(x).cast("double")
    six = lambda v: F.call_function("format_number", v, F.lit("0.00000E00"))  # noqa: E731  d.dddddE[-]xx, halves to the even digit
    large = F.abs(x).between(1e6, 1e18)  # Java takes the halves among these doubles up, but not those of the same decimals
    java = F.when(large, six(x.try_cast("decimal(38,12)"))).otherwise(six(x))
    exponent_text = F.when(_is_finite(x), F.regexp_replace(F.regexp_replace(java, "E(?=[0-9])", "e+"), "E", "e")).otherwise(F.format_string("%.5e", x))

    def text(e: Column) -> Column:
        exponent = F.regexp_extract(e, "e([+-][0-9]+)$", 1).cast("int")
        digits = _without_zeros(F.regexp_extract(e, "^(-?[0-9.]+)e", 1))
        plain = _without_zeros(F.format_string("%.9f", e.cast("double")))  # nine places hold six digits from 1e-4 on
        scientific = F.concat(digits, F.lit("e"), F.regexp_extract(e, "e([+-][0-9]+)$", 1))
        return F.when(exponent.between(-4, 5), plain).otherwise(scientific)

    return F.when(x.isNotNull(), F.element_at(F.transform(F.array(exponent_text), text), 1))


def _without_zeros(text: Column) -> Column:
    return F.regexp_replace(text, "\\.?0+$", "")


def _is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def number_text(x: Column | str, digits: int, signed: bool = False) -> Column:
    """Text of a number with ``digits`` decimals; a value halfway between two texts goes to the even digit, as C and Python print it.

    ``format_string`` rounds the shortest decimal text of a double half up: 22.5 -> '23', 1.005 -> '1.01'.
    """
    x = col(x).cast("double")
    body = "0." + "0" * digits if digits else "0"
    exact = F.call_function("format_number", x, F.lit(f"+{body};-{body}" if signed else body))
    return _known(x, F.when(_is_finite(x), exact).otherwise(F.format_string(f"%{'+' if signed else ''}.{digits}f", x)))


def _known(x: Column, text: Column) -> Column:
    """A missing number has no text (``format_string`` would print it)."""
    return F.when(x.isNotNull(), text)


def format_signed_percent(x: Column | str) -> Column:
    return _known(col(x), F.concat(number_text(x, 0, True), F.lit("%")))


def format_signed(x: Column | str, digits: int = 1) -> Column:
    return _known(col(x), number_text(x, digits, True))


def format_fixed(x: Column | str, digits: int = 1) -> Column:
    return _known(col(x), number_text(x, digits))


def mean_pm_std(mean: Column | str, std: Column | str, digits: int = 1) -> Column:
    """'mean ± sd', or only the mean when the spread is missing or zero."""
    m, s = col(mean), finite(std)
    both = F.concat(number_text(m, digits), F.lit(" ± "), number_text(F.coalesce(s, F.lit(0.0)), digits))
    return _known(m, F.when(s > 0, both).otherwise(format_fixed(m, digits)))


def interval_text(mean, lo, hi, digits: int = 1) -> Column:
    return _known(col(mean), F.concat(number_text(mean, digits), F.lit(" ["), number_text(lo, digits), F.lit(", "), number_text(hi, digits), F.lit("]")))


def sign_class(rho: Column | str, cut: float = 0.3) -> Column:
    """Direction of an association: '+', '-' or '~' (weak or undefined)."""
    r = finite(rho)
    return F.when(r > cut, "+").when(r < -cut, "-").otherwise("~")


def hash_uniform(*parts) -> Column:
    """Uniform number in [0, 1) from the text of its parts.

    The value depends only on the parts, never on partitioning or task order,
    so a re-run after a lost executor draws the same numbers.
    """
    text = F.concat_ws(",", *[(F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_uniform_53(*parts) -> Column:
    """The same with 53 random bits, all that a double in [0, 1) holds."""
    text = F.concat_ws(",", *[(F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in parts])
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), 7).cast("double") / F.lit(2.0**53)


def hash_normal(*parts) -> Column:
    """Standard normal number by the Box-Muller transform of two hash draws."""
    u1 = hash_uniform(*parts, F.lit("u1"))
    u2 = hash_uniform(*parts, F.lit("u2"))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hash_index(n: Column, *parts) -> Column:
    """Uniform integer in [0, n) from the text of its parts: 60 bits of the hash, so every entity of any fleet can be drawn."""
    text = F.concat_ws(",", *[(F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), n).cast("long")
