"""Ordered running totals and hot-key helpers that never put one key into one task.

An ordered group is cut into slices along its order. Per-slice totals are a small, map-side
combined aggregate; their running sums become one *carry row* at the head of every slice. A window
over (key, slice) then gives the totals over the whole key.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from txrisk.functions.scalar import value_slice
from txrisk.session import checkpointed


def running_totals(rows: DataFrame, keys: list[str], order: str, sums: list[str],
                   slice_by: Column | None = None) -> DataFrame:
    """Add `<s>_upto` (inclusive) and `<s>_total` for each of `sums`, and `prev_<order>`.

    `rows` has one row per (keys, order). `slice_by` must grow with `order`; by default it is the
    relative-width bucket of the order value.
    """
    rows = rows.withColumn("slice", value_slice(F.col(order)) if slice_by is None else slice_by)
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "slice")
        .agg(F.max(order).alias(order), *[F.sum(s).alias(s) for s in sums])
        .select(
            *keys, "slice", F.lit(True).alias("is_carry"),
            F.max(order).over(before).alias(order),
            *[F.sum(s).over(before).alias(s) for s in sums],
            *[F.sum(s).over(by_key).alias(f"{s}_total") for s in sums],
        )
    )
    both = rows.withColumn("is_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    # the carry row of the first slice has no order value and so still comes first
    in_slice = Window.partitionBy(*keys, "slice").orderBy(F.asc_nulls_first(order))
    upto = in_slice.rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumns({
            f"prev_{order}": F.lag(order).over(in_slice),
            **{f"{s}_upto": F.sum(s).over(upto) for s in sums},
            **{f"{s}_total": F.max(f"{s}_total").over(upto) for s in sums},
        })
        .filter(~F.col("is_carry"))
        .drop("is_carry", "slice")
    )


def exact_quantiles(value: str, count: str, probs: dict[str, float]) -> dict[str, Column]:
    """Aggregates that give linearly interpolated quantiles over `running_totals` rows of a histogram."""
    total, upto = F.col(f"{count}_total"), F.col(f"{count}_upto")
    out = {}
    for name, q in probs.items():
        place = (total - 1) * F.lit(q)
        lo, hi = F.floor(place), F.ceil(place)

        def at(rank: Column) -> Column:
            return F.max(F.when((rank >= upto - F.col(count)) & (rank < upto), F.col(value)))

        out[name] = at(lo) + (at(hi) - at(lo)) * F.max(place - lo)
    return out


def slice_widths(rows: DataFrame, keys: list[str], time: str, widths: list[int], hot_rows: int,
                 slice_rows: int, broadcast_rows: int) -> DataFrame | None:
    """(keys, width) of every group with more than `hot_rows` rows; None if there is no such group.

    `width` is the coarsest of `widths` (each a multiple of the next) whose fullest slice of `time`
    holds at most `slice_rows` rows, else the finest. The table has at most rows / hot_rows entries.
    """
    return rows_and_widths(rows, keys, time, widths, hot_rows, slice_rows, broadcast_rows)[1]


def rows_and_widths(rows: DataFrame, keys: list[str], time: str, widths: list[int], hot_rows: int,
                    slice_rows: int, broadcast_rows: int) -> tuple[int, DataFrame | None]:
    """The number of `rows`, from the same pass, and what `slice_widths` gives."""
    # one row per hot group, and one for all others
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn(
        "hot", F.when(F.col("n") > hot_rows, F.struct(*keys)))
    found = checkpointed(counts.groupBy("hot").agg(F.sum("n").alias("n")))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = found.filter("hot is not null").select("hot.*")
    if hot.isEmpty():
        return total, None
    finest = widths[-1]
    some = F.broadcast(hot) if within_limit(hot, broadcast_rows) else hot
    places = (
        rows.join(some, keys).withColumn("width", F.lit(finest))
        .groupBy(*keys, slice_of(time).alias("place")).agg(F.count("*").alias("n"))
    )
    fullest = (
        places.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])))
        .groupBy(*keys, "width", F.floor(F.col("place") / (F.col("width") / finest)).alias("wide"))
        .agg(F.sum("n").alias("n"))
        .groupBy(*keys, "width").agg(F.max("n").alias("n"))
    )
    return total, checkpointed(fullest.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("n") <= slice_rows, F.col("width"))), F.lit(finest)).alias("width")))


def dealt(rows: DataFrame, keys: list[str], count: int, task_rows: int) -> DataFrame:
    """`rows`, about `count` of them, shuffled by `keys` into partitions of about `task_rows` rows, so that what a task
    holds does not grow with the table; few rows are left to adaptive execution."""
    n = -(-count // task_rows)
    return rows.repartition(n, *keys) if n > 1 else rows.repartition(*keys)


def slice_of(time: str) -> Column:
    """Number of the slice of `width` that a time falls into."""
    return F.expr(f"({time} - pmod({time}, width)) div width")


def global_rank(rows: DataFrame, keys: list[str], order: list[str], slice_by: Column) -> DataFrame:
    """Add `rank` (0-based row number along `order` within `keys`).

    `slice_by` must grow with `order`. Slice counts are combined before the shuffle and the table
    of slices stays small, so ranking a huge group uses as many tasks as it has slices.
    """
    rows = rows.withColumn("slice", slice_by)
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "slice").agg(F.count("*").alias("slice_rows")).select(
        *keys, "slice", F.coalesce(F.sum("slice_rows").over(before), F.lit(0)).alias("rank_start"))
    in_slice = Window.partitionBy(*keys, "slice").orderBy(*order)
    return (
        rows.withColumn("rank_in_slice", F.row_number().over(in_slice))
        .join(starts, [*keys, "slice"])
        .withColumn("rank", F.col("rank_start") + F.col("rank_in_slice") - 1)
        .drop("slice", "rank_start", "rank_in_slice")
    )


def within_limit(df: DataFrame, limit: int) -> bool:
    """Whether `df` has at most `limit` rows; no more than limit + 1 rows are produced to tell."""
    return df.limit(limit + 1).count() <= limit
