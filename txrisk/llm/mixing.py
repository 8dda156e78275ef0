"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs.

Only DataFrame functions. A document's size is read from its text once; what is aggregated, joined and sorted
afterwards are a few numbers of each document. Sizes are summed by source and slice of the hash order; running sums over
the slices find the slice that a source's budget ends in, and only the documents of that slice are sorted. The
result is one row per source, so no source, however large, is gathered anywhere.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from txrisk.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Sources in code point order, null last, take these weights in turn.
WEIGHTS = (1, 2, 3)
#: No source is taken more often than this.
MAX_EPOCHS = 3
#: Hash keys have 60 bits; their top bits number the slice.
KEY_DIGITS, SLICE_BITS = 15, 12
#: Parts that each source is dealt over when its cut is looked up.
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), doc)), 1, KEY_DIGITS), 16, 10).cast("long")
    return docs.withColumns({
        "key": key, "place": F.shiftright(key, 4 * KEY_DIGITS - SLICE_BITS),
        "name": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
    })


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) with the hash key of each document, read from the texts once."""
    return checkpointed(_keyed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        size_of(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("content"))))


def targets(sized: DataFrame) -> DataFrame:
    """(name, source_size, target, epochs, rest): words to take of each source, as whole epochs and a rest.

    A source above MAX_EPOCHS times its size stops there. In ascending order of limit / weight, the sources
    that stop come first, so running sums give the share of all others without a loop.
    """
    sources = sized.groupBy("name", "source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    turn = F.pmod(F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(WEIGHTS)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), turn + 1).cast("long"))
    limit = F.col("source_size") * MAX_EPOCHS
    by_limit = everything.orderBy((limit / F.col("weight")).asc(), "name")
    before, onward = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    shared = weighed.withColumns({"left": left, "weights": F.sum("weight").over(onward)}).withColumn(
        "stops", limit.cast("double") * F.col("weights") <= F.col("weight") * F.col("left"))
    open_ = F.when(~F.col("stops"), F.struct((limit / F.col("weight")).alias("ratio"), "name", "left", "weights"))
    first = F.min(open_).over(everything)
    share = F.coalesce((F.col("weight") * first["left"]).cast("double") / first["weights"], limit.cast("double"))
    budget = F.floor(F.col("target") + 0.5)
    return (
        shared.withColumn("target", F.when(F.col("stops"), limit.cast("double")).otherwise(share))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
        .select("name", "source_size", "target", "epochs", "rest")
    )


def cuts(sized: DataFrame) -> DataFrame:
    """`targets` with the row at which each source's last epoch ends (`cut`), its equal rows (`copies`), how many of them are
    taken whole before it, and the words it gives."""
    goals = targets(sized)
    in_order = Window.partitionBy("name").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    slices = sized.groupBy("name", "place").agg(F.sum("size").alias("words")).withColumn(
        "before", F.coalesce(F.sum("words").over(in_order), F.lit(0)))
    ends = slices.join(goals.select("name", "rest"), "name").filter("rest > before and rest <= before + words").select(
        "name", "place", F.col("before").alias("ahead"), "rest")
    # rows that share an id, a size and a text are one step of the order
    steps = sized.join(ends, ["name", "place"]).groupBy("name", "place", "rest", "ahead", "size", _order().alias("cut")).agg(F.count("*").alias("copies"))
    by_key = Window.partitionBy("name", "place").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("copies")
    found = (
        steps.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum(words).over(by_key), F.lit(0)))
        .filter((F.col("rest") > F.col("ahead")) & (F.col("rest") <= F.col("ahead") + words))
        .withColumn("whole", F.ceil((F.col("rest") - F.col("ahead")) / F.col("size")) - 1)
        .select("name", "cut", "copies", "whole", (F.col("rest") - F.col("ahead") - F.col("whole") * F.col("size")).alias("cut_words"))
    )
    return checkpointed(goals.join(found, "name", "left"))


def _order() -> Column:
    """The order of a source's rows: by hash key, then by doc_id (nulls first), size and text."""
    return F.struct("key", F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "size", "content")


def _with_cuts(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows with the cut of their source and `copy`, their number among the equal rows at the cut, else 0. Every source is
    dealt over SALTS parts by hash key, the hot one too; only equal rows at a cut are numbered together."""
    salted = ends.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("part", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["name", "part"]).drop("part")
    if ends.filter("copies > 1").isEmpty():
        return joined.withColumn("copy", F.lit(0))
    several = F.coalesce((F.col("copies") > 1) & (_order() == F.col("cut")), F.lit(False))
    numbered = joined.filter(several).withColumn("copy", F.row_number().over(Window.partitionBy("name").orderBy("key")) - 1)
    return joined.filter(~several).withColumn("copy", F.lit(0)).unionByName(numbered)


def _taken() -> Column:
    """Words that the mix takes of a document joined with its source's cut."""
    extra = (
        F.when(F.col("cut").isNull(), 0)
        .when((_order() < F.col("cut")) | ((_order() == F.col("cut")) & (F.col("copy") < F.col("whole"))), F.col("size"))
        .when((_order() == F.col("cut")) & (F.col("copy") == F.col("whole")), F.col("cut_words"))
        .otherwise(0))
    return F.col("epochs") * F.col("size") + extra


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document.

    A null text has size 0, a null source is a source of its own, the last one. Documents without words take
    nothing. Repeated rows and rows that share an id are separate documents; equal rows at a cut are numbered in one task.
    """
    sized = sizes(docs)
    return _with_cuts(sized, cuts(sized)).select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself with the columns of `docs`: each document as often as it is taken, the one at a source's
    cut shortened to its words there (`n_chars` follows). Documents without words stay once."""
    sized = sizes(docs)
    work = _keyed(docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                              F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"),
                              F.xxhash64(F.col("text").cast("string")).alias("content")))
    taken = _with_cuts(work, cuts(sized)).withColumn("taken", _taken())
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    out = taken.withColumn("words", F.explode(copies))
    text = F.col("row.text")
    cut = F.concat_ws("", F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("words").cast("int")))
    own = {"text": F.when(F.col("words") > 0, cut).otherwise(text)}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("words") > 0, F.length(cut).cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
