"""Column expressions. All of them stay inside whole-stage codegen."""

from pyspark.sql import Column, functions as F

UNITS = 1_000_000


def epoch_micros(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("bigint")


def amount_log(amount: Column) -> Column:
    return F.log1p(amount)


def hour_of_day(ts_us: Column) -> Column:
    """Hour in UTC, whatever the session time zone is."""
    return F.floor(F.pmod(ts_us, F.lit(86_400_000_000)) / 3_600_000_000).cast("int")


def day_of_week(ts_us: Column) -> Column:
    """Monday 0 to Sunday 6, in UTC; 1970-01-01 was a Thursday."""
    days = F.floor((ts_us - F.pmod(ts_us, F.lit(86_400_000_000))) / 86_400_000_000)
    return F.pmod(days + 3, F.lit(7)).cast("int")


def is_weekend(ts_us: Column) -> Column:
    return day_of_week(ts_us) >= 5


def clip_probability(p: Column) -> Column:
    """Clip to [0, 1]; NaN stays NaN and NULL stays NULL."""
    return F.when(F.isnan(p), p).otherwise(F.when(p < 0, 0.0).when(p > 1, 1.0).otherwise(p))


def probability_of(output: Column) -> Column:
    """Probability from one model output held as array<double>; NULL for an empty output.

    Two values in [0, 1] are class probabilities and the last one counts; any other array holds
    one prediction per row and the first counts.
    """
    first, last = F.get(output, F.lit(0)), F.get(output, F.size(output) - 1)
    pair = (F.size(output) == 2) & F.forall(output, lambda x: (x >= 0) & (x <= 1))
    return clip_probability(F.when(F.size(output) > 0, F.when(pair, last).otherwise(first)))


def probability_of_matrix(output: Column) -> Column:
    """Probability from a two-dimensional output: last column of the first row."""
    row = F.get(output, F.lit(0))
    return clip_probability(F.get(row, F.size(row) - 1))


def decision(p: Column, review: float = 0.4, block: float = 0.75) -> Column:
    """APPROVE / REVIEW / BLOCK on the unrounded probability; NaN is BLOCK, NULL stays NULL."""
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p < review, "APPROVE")
        .when(p < block, "REVIEW")
        .otherwise("BLOCK")
    )


def value_slice(value: Column, bits: int = 14) -> Column:
    """A bucket number that grows with the value and is about 2^-bits wide in relative terms.

    Used to cut an ordered prefix sum into independent pieces without a pass for the bounds.
    """
    step = float(1 << bits)
    size = F.abs(value)
    exponent = F.floor(F.log2(size)).cast("bigint")
    place = (exponent + 1100) * int(step) + F.floor(size / F.pow(F.lit(2.0), exponent) * step).cast("bigint")
    # infinities lie beyond all other buckets
    place = F.when(size == float("inf"), F.lit(1 << 40)).otherwise(place)
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, place).otherwise(-place)
