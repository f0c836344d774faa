"""Column expressions that operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A likelihood is kept within these bounds, and a log likelihood ratio within the cap.
LEAST_P, MOST_P, CAP = 0.01, 0.99, 2.5


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def clip(x: Column | str, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(col(x).isNotNull(), F.greatest(F.least(col(x), F.lit(high)), F.lit(low)))


def log_ratio_absent(p_true: Column | str, p_false: Column | str | float) -> Column:
    """Log likelihood ratio of not finding a thing; never above 0."""
    p, q = clip(p_true, LEAST_P, MOST_P), clip(p_false if not isinstance(p_false, float) else F.lit(p_false), LEAST_P, MOST_P)
    return F.least(clip(F.ln((1 - p) / (1 - q)), -CAP, CAP), F.lit(0.0))


def log_ratio_found(p_true: Column | str, p_false: Column | str | float) -> Column:
    p, q = clip(p_true, LEAST_P, MOST_P), clip(p_false if not isinstance(p_false, float) else F.lit(p_false), LEAST_P, MOST_P)
    return clip(F.ln(p / q), -CAP, CAP)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Days with fractions between two TIMESTAMP_NTZ columns."""
    return micros_between(later, earlier) / F.lit(86_400_000_000.0)


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return micros_between(later, earlier) / F.lit(60_000_000.0)


def micros_between(later: Column | str, earlier: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later))


def contains_any(text: Column | str, terms: list[str]) -> Column:
    """Plain, case-insensitive substring test for any term."""
    return F.lower(col(text)).rlike("|".join(re.escape(t.lower()) for t in terms)) if terms else F.lit(False)


def leading_number(text: Column | str) -> Column:
    """The number before the first underscore, or null: `11_entries` gives 11."""
    return F.split_part(col(text), F.lit("_"), F.lit(1)).try_cast("double")


def short_digest(x: Column | str, digits: int = 16) -> Column:
    """The first hex digits of SHA-256."""
    return F.substring(F.sha2(col(x), 256), 1, digits)


def first_of(kept: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = None
    for condition, name in kept:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def confidence_band(log_odds: Column | str) -> Column:
    """A word for log-odds of either sign: high from 2, medium from 0.5, else low; null stays null."""
    far = F.abs(col(log_odds))
    return F.when(far >= 2.0, "high").when(far >= 0.5, "medium").when(far.isNotNull(), "low")


def written_sum(terms: Column | str, total: Column | str) -> Column:
    """An array of numbers as a line of arithmetic: `-1.2 + 0.6 = -0.6`, one decimal each."""
    show = lambda x: F.call_function("format_number", x, F.lit("0.0"))
    return F.concat(F.array_join(F.transform(col(terms), show), " + "), F.lit(" = "), show(col(total)))


def first_mode(values: Column | str) -> Column:
    """The commonest value of an array; of equally common ones that which comes first. Nulls don't count."""
    kept = F.filter(col(values), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(kept), lambda x: F.struct(F.size(F.filter(kept, lambda y: y == x)).alias("n"), (-F.array_position(kept, x)).alias("at"), x.alias("x")))
    return F.array_max(counted)["x"]
