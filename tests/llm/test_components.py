from pyspark.sql import functions as F

from txrisk.llm.components import components


def test_few_links_take_few_tasks(spark):
    """Steps over a short table leave the files of a few tasks, however many shuffle partitions there are."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "60")
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    links = own.createDataFrame([(i, i + 1) for i in range(20) if i % 7] + [(5, 40), (40, 5)], "a long, b long")
    found = components(links)
    assert found.rdd.getNumPartitions() <= 2
    want = {1: range(1, 8), 8: range(8, 15), 15: range(15, 21)}
    want = {n: min(g) for g in want.values() for n in g} | {40: 1}
    assert {r.node: r.component for r in found.collect()} == want
    assert found.groupBy("node").count().filter(F.col("count") > 1).isEmpty()
