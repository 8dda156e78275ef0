"""Connected components of a link table, by alternating large-star and small-star steps.

Links, labels and components stay distributed. Every step is a minimum per node, combined before the
shuffle, joined back to the node's links; the number of steps grows with the logarithm of the longest chain.
"""

from pyspark.sql import DataFrame, functions as F

from txrisk.session import checkpointed

#: Links of a task at least; few links do not leave files of as many tasks as there are shuffle partitions.
TASK_LINKS = 1 << 16


def _stars(links: DataFrame, small: bool, tasks: int) -> DataFrame:
    """links: (a, b) with a > b, in `tasks` tasks at most. Attach neighbours to the smallest one around a node."""
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a").coalesce(tasks)
    least = least.coalesce(tasks)
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = out.unionByName(least.select("a", F.col("m").alias("b"))).filter(F.col("a") > F.col("b"))
    return out.filter(F.col("a") > F.col("b")).distinct().coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (columns a, b); component is its smallest node."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = checkpointed(links.select(a.alias("a"), b.alias("b")).filter("a > b").distinct())
    tasks = 1 + now.count() // TASK_LINKS
    now, state = now.coalesce(tasks), None
    while True:
        now = checkpointed(_stars(_stars(now, small=False, tasks=tasks), small=True, tasks=tasks))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(tasks))
