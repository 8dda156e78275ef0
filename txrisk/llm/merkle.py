"""A Merkle manifest of documents: leaves, one tree per source and one over the sources, with a proof for each document.

The nodes of a source are dealt out in blocks of 3^7 leaves, so a tree of any size has no large window. Within a block seven
levels are built on the same rows: the node of a level sits on the row of its first leaf, its siblings are lag and lead
columns 3^level and 2 * 3^level rows away, and a first child's row hashes the parent. The roots of the blocks are the leaves
of the next round.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from txrisk.llm.stages import stored
from txrisk.session import checkpointed

#: Children of a node, and levels that are built in one block.
RUN, LEVELS = 3, 7
BLOCK = RUN ** LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(docs: DataFrame, text: Column | None = None) -> Column:
    """The digest of a document: each field as its length in bytes and its value, `-` for a null."""
    fields = [(F.col(name) if name != "text" or text is None else text).cast("string") for name in FIELDS]
    return _hash(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields])


def ordered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add `pos` (from 0, along `order`, nulls first) and `n` (rows of the group); equal rows may change places.

    Rows are dealt out by ranges of (group, order), so a group of any size is ordered in many tasks; what is summed up over
    a group is a count for each range.
    """
    by = [F.asc_nulls_first(c) for c in order]
    ranged = checkpointed(rows.repartitionByRange(F.asc(group), *by).withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(group, "part").agg(F.count("*").alias("own")).select(
        group, "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"), F.sum("own").over(whole).alias("n"))
    in_part = Window.partitionBy(group, "part").orderBy(*by)
    return (ranged.withColumn("place", F.row_number().over(in_part)).join(parts, [group, "part"])
            .withColumn("pos", F.col("start") + F.col("place") - 1).drop("start", "place", "part"))


def _levels(nodes: DataFrame) -> DataFrame:
    """Add `block`, `path` (siblings to the left and right on each level, up to the block's root) and `top`, which the
    block's first row holds: the block's root.

    nodes: (name, pos, n, digest). A level of one node is the root of its source: it has no siblings and no parent.
    """
    rows = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("d", F.col("digest"))
    along = Window.partitionBy("name", "block").orderBy("pos")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    path = []
    for level in range(LEVELS):
        step = RUN ** level
        nodes_here = F.expr(f"(n + {step - 1}) div {step}")
        place = F.expr(f"pos div {step}")
        slot = place % RUN
        run = F.least(F.lit(RUN), nodes_here - (place - slot))
        rows = rows.withColumns({
            "slot": slot, "run": run, "is_node": F.col("pos") % step == 0, "many": nodes_here > 1,
            "lag1": F.lag("d", step).over(along), "lag2": F.lag("d", 2 * step).over(along),
            "lead1": F.lead("d", step).over(along), "lead2": F.lead("d", 2 * step).over(along)})
        nothing = F.lit("")
        left = F.when(F.col("slot") == 0, nothing).when(F.col("slot") == 1, F.col("lag1")).otherwise(F.concat("lag2", "lag1"))
        near = F.when(F.col("run") > F.col("slot") + 1, F.col("lead1")).otherwise(nothing)
        far = F.when((F.col("slot") == 0) & (F.col("run") > 2), F.col("lead2")).otherwise(nothing)
        own = F.when(F.col("is_node") & F.col("many"), F.struct(left.alias("left"), F.concat(near, far).alias("right")))
        first_child = F.col("pos") % (step * RUN) == 0
        rows = rows.withColumns({
            f"level{level}": own, "d": F.when(first_child, F.when(F.col("many"), _hash(F.col("d"), near, far)).otherwise(F.col("d")))})
        path.append(F.last(f"level{level}", ignorenulls=True).over(upto) if level else F.col("level0"))
    return (rows.withColumns({f"up{level}": p for level, p in enumerate(path)})
            .withColumn("path", F.array_compact(F.array(*[F.col(f"up{level}") for level in range(LEVELS)])))
            .withColumnRenamed("d", "top")
            .drop("slot", "run", "is_node", "many", "lag1", "lag2", "lead1", "lead2",
                  *[f"level{level}" for level in range(LEVELS)], *[f"up{level}" for level in range(LEVELS)]))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round: those given, then the roots of their blocks, until every name has one node."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        roots = _levels(rounds[-1].select("name", "pos", "n", "digest")).filter(F.col("pos") % BLOCK == 0)
        rounds.append(checkpointed(roots.select(
            "name", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("digest"))))
        most = -(-most // BLOCK)
    return rounds


def _with_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's nodes with `path` up to the last root; `above` has (name, higher, ...) for each name.

    A round's rows lie by (name, block) after its windows, and so they meet the paths of their blocks without a shuffle.
    """
    paths = above.withColumn("block", F.lit(0).cast("bigint"))
    for nodes in reversed(rounds[:-1]):
        found = _levels(nodes).join(paths, ["name", "block"]).withColumn("path", F.concat("path", "higher"))
        if nodes is rounds[0]:
            return found.drop("block", "top", "higher")
        paths = found.drop("block", "top", "higher", "digest", "n").withColumnsRenamed({"pos": "block", "path": "higher"})
    return rounds[0].join(paths.drop("block"), "name").withColumnRenamed("higher", "path")


def manifest(leaves: DataFrame) -> DataFrame:
    """`leaves` (doc_id, source, leaf and whatever else is to be kept) with `subroot`, `root` and `path`, the siblings of
    every level from the leaf to the root as (left, right).

    Leaves of a source ascend by doc_id (nulls first, then by digest); sources by their bytes, null first. A source with one
    leaf has it as its subroot, a table with one source has its subroot as root; an empty table gives no row.
    """
    rows = stored(leaves.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))), "merkle-leaves")
    rounds = _rounds(ordered(rows.withColumn("digest", F.col("leaf")), "name", ["doc_id", "leaf"]).transform(checkpointed))
    subroots = rounds[-1].select("name", F.col("digest").alias("subroot"))
    sources = subroots.select(F.lit("").alias("name"), F.col("name").alias("source_name"), "subroot", F.col("subroot").alias("digest"))
    tops = _rounds(checkpointed(ordered(sources, "name", ["source_name"])))
    root = tops[-1].select("digest").first()
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    to_root = _with_paths(tops, tops[-1].select("name", nothing.alias("higher")))
    above = checkpointed(to_root.select(F.col("source_name").alias("name"), "subroot", F.col("path").alias("higher")))
    found = _with_paths(rounds, above)
    return found.withColumn("root", F.lit(root[0] if root else None).cast("string")).drop("name", "pos", "n", "digest")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, digest, lambda own, sides: _hash(sides["left"], own, sides["right"]))


def proof(path: Column) -> Column:
    """One digest of all siblings of a path, level by level, left to right."""
    return _hash(F.array_join(F.transform(path, lambda sides: F.concat(sides["left"], sides["right"])), ""))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of all documents, checked against texts that lost their line ends where crc32 of the id is even.

    A row without doc_id is not tampered with. Rows that share an id are leaves of their own, in the order of their digests;
    other columns than the five of a leaf are left out.
    """
    ids = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = F.when(ids % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    docs = docs.select(*FIELDS)
    leaves = docs.select("doc_id", "source", leaf(docs).alias("leaf"), leaf(docs, cut).alias("present"))
    return manifest(leaves).select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        fold(F.col("present"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
