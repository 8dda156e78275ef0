"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (norm) into buckets, and large buckets are dealt over blocks. A first look at the block of
the longest vectors gives each query, a stated part of the rows, a lower bound of its k-th best product: with its own length,
the least length that a better vector has. Queries are then put into blocks by that length, and a block of queries goes only to
the blocks of longer vectors. There, the bound over the product of lengths is a local cosine threshold. Is it low,
vectors too short for the bound are left out; is it high, vectors are left out whose largest query coordinates lie outside the
interval that the threshold leaves for them, if those are most. What remains is verified with integer products, of many queries
at once where they share their vectors. A vector is left out only if its product is below the bound, so the result is exact.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from txrisk.llm import text as T
from txrisk.session import checkpointed

SCALE = 256
K = 5
EVERY = 50
#: Vectors of a candidate block and queries of a query block.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Queries whose products with a block are worked out at once.
AT_ONCE = 256
#: Buckets per doubling of the norm.
STEPS = 8
#: Coordinates prune a block for a query if they leave at most this part of it; products of pairs in a task's share.
FEW, SHARE = 0.1, 4
#: Local cosine threshold from which coordinates prune rather than lengths, and the number of coordinates.
HIGH_COSINE, FOCUS = 0.3, 3
#: Rounding of pruning bounds; products themselves are exact integers.
SLACK = 1e-6


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(SCALE * x) of each component as 64-bit integers, with size and norm; unusable vectors go."""
    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("embedding")
        keep, size, norm, data = [], [], [], []
        flat = lists.flatten()
        numbers = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        lengths = np.nan_to_num(np.array(lists.value_lengths().to_pylist(), float), nan=-1).astype(np.int64)
        end = np.cumsum(np.maximum(lengths, 0))
        for r in range(len(lists)):
            if lengths[r] < 0 or not ids[r].is_valid:
                continue
            x = numbers[end[r] - lengths[r]:end[r]]
            if np.isfinite(x).all():
                v = np.floor(SCALE * x)
                if np.abs(v).max(initial=0) >= 2.0 ** 63:
                    raise ArithmeticError(f"a component of vector {ids[r]} does not fit 64 bits")
                keep.append(r)
                size.append(len(v))
                norm.append(float(np.sqrt((v * v).sum())))
                data.append(v.astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(size, pa.int32()), pa.array(norm, pa.float64()), pa.array(data, pa.binary())],
                                         names=["vec_id", "size", "norm", "data"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its ids, its vectors in descending order of norm, in the smallest integer type, and their bounds."""
    for g in T.in_groups(batches, ["size", "bucket", "part"]):
        order = np.argsort(-g["norm"].to_numpy(), kind="stable")
        vectors = np.frombuffer(b"".join(g["data"].to_pylist()), np.int64).reshape(g.num_rows, -1)[order]
        most = int(np.abs(vectors).max(initial=0))
        kind = next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
        yield pa.RecordBatch.from_arrays(
            [g[c][:1].combine_chunks() for c in ("size", "bucket", "part")]
            + [pa.array([np.dtype(kind).name]), pa.array([g["vec_id"].to_numpy()[order].tobytes()], pa.binary()), pa.array([vectors.astype(kind).tobytes()], pa.binary()),
               pa.array([g["bound"].to_numpy()[order].tobytes()], pa.binary())],
            names=["size", "bucket", "part", "kind", "ids", "data", "bounds"])


_BLOCK = "size int, bucket int, part int, kind string, ids binary, data binary, bounds binary"


def _bucket(length: Column) -> Column:
    return F.floor(F.log2(length + 1) * STEPS).cast("int")


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """`rows` (vec_id, size, bucket, norm, data, bound) packed into blocks of about `most` vectors of one size and bucket."""
    counts = rows.groupBy("size", "bucket").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = rows.join(counts, ["size", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    keys = ["size", "bucket", "part"]
    return dealt.select(*keys, "vec_id", "norm", "data", "bound").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_pack, _BLOCK)


def _unpack(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}data"], np.dtype(row[f"{prefix}kind"])).reshape(len(ids), -1)


def _products(vectors: np.ndarray, exact: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer products of rows with one query or several (then one column each): as doubles where these are exact, else as
    whole numbers of any size, which must fit 64 bits."""
    most = float(np.abs(query).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(vectors.shape[1], 1)
    if most < 2.0 ** 52:
        return (vectors @ query.T.astype(float)).astype(np.int64)
    if most < 2.0 ** 62:
        return exact.astype(np.int64) @ query.T.astype(np.int64)
    scores = exact.astype(object) @ query.T.astype(object)
    if scores.size and max(abs(int(x)) for x in scores.flat) >= 2 ** 63:
        raise ArithmeticError("an inner product does not fit 64 bits")
    return scores.astype(np.int64)


def best_of_block(query: np.ndarray, own_id: int, bound: float, ids: np.ndarray, exact: np.ndarray, vectors: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and products of the query's k best rows of a block with a product of at least `bound`.

    `exact` holds the integer vectors, `vectors` the same as doubles, both in descending order of `norms`.
    """
    length = float(np.sqrt((query.astype(float) ** 2).sum()))
    rows = np.arange(len(ids))
    if bound > 0:
        if length * norms[0] * (1 + SLACK) < bound:
            return ids[:0], np.zeros(0, np.int64)
        cosine = bound / (length * norms[0])
        if cosine < HIGH_COSINE:
            rows = rows[:int(np.searchsorted(-norms, -(bound / length) * (1 - SLACK), "right"))]
        else:
            focus = np.argsort(-np.abs(query), kind="stable")[:FOCUS]
            unit = query[focus] / length
            # a vector with a cosine of at least t has coordinate f within these bounds of its own length
            lives = np.minimum(bound / (length * np.maximum(norms, SLACK)), 1.0)
            fits = bound <= length * norms * (1 + SLACK)
            for f, q in zip(focus, unit):
                reach = np.sqrt(np.maximum((1 - q * q) * (1 - lives * lives), 0)) + SLACK
                own = vectors[:, f] / np.maximum(norms, SLACK)
                # an axis that lies within the angle of the query is no limit on its side
                fits &= (own >= np.where(-q >= lives - SLACK, -2.0, q * lives - reach)) & (own <= np.where(q >= lives - SLACK, 2.0, q * lives + reach))
            rows = np.flatnonzero(fits)
    rows = rows[ids[rows] != own_id]
    if not len(rows):
        return ids[:0], np.zeros(0, np.int64)
    scores = _products(vectors[rows], exact[rows], query)
    at = np.flatnonzero(scores >= bound) if np.isfinite(bound) else np.arange(len(rows))
    top = at[np.lexsort((ids[rows[at]], -scores[at]))[:k]]
    return ids[rows[top]], scores[top]


def _ranges(queries: np.ndarray, lengths: np.ndarray, cosines: np.ndarray, units: np.ndarray) -> list[np.ndarray | None]:
    """For each query the rows whose coordinate lies in the interval that the block's cosine threshold leaves for it, for
    whichever of the query's FOCUS largest coordinates leaves least; None if that is more than the FEW part."""
    out: list[np.ndarray | None] = [None] * len(queries)
    least = np.full(len(queries), FEW * len(units))
    focus = np.argsort(-np.abs(queries), axis=1, kind="stable")[:, :FOCUS]
    for f in np.unique(focus):
        own = np.flatnonzero((focus == f).any(1))
        order = np.argsort(units[:, f], kind="stable")
        values = units[order, f]
        q, t = queries[own, f] / lengths[own], cosines[own]
        reach = np.sqrt(np.maximum((1 - q * q) * (1 - t * t), 0)) + SLACK
        lo = np.searchsorted(values, np.where(-q >= t - SLACK, -2.0, q * t - reach), "left")
        hi = np.searchsorted(values, np.where(q >= t - SLACK, 2.0, q * t + reach), "right")
        for i in np.flatnonzero(hi - lo <= least[own]):
            out[own[i]], least[own[i]] = np.sort(order[lo[i]:hi[i]]), hi[i] - lo[i]
    return out


def best_of_blocks(q_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, products): each query's k best rows of a block with a product of at least its bound.

    The block's rows come in descending order of norm.
    """
    vectors = exact.astype(float)
    norms = np.sqrt((vectors * vectors).sum(1))
    wanted = queries.astype(float)
    lengths = np.sqrt((wanted * wanted).sum(1))
    asks = bounds > 0
    upto = np.full(len(queries), len(ids))
    upto[asks] = np.searchsorted(-norms, -(bounds[asks] / np.maximum(lengths[asks], SLACK)) * (1 - SLACK), "right")
    left = upto > 0
    cosines = np.zeros(len(queries))
    if len(norms) and norms[0] > 0:
        cosines[asks] = np.minimum(bounds[asks] / np.maximum(lengths[asks] * norms[0], SLACK), 1.0)
    high = np.flatnonzero(left & (cosines >= HIGH_COSINE))
    if len(high):
        units = vectors / np.maximum(norms, SLACK)[:, None]
        for q, rows in zip(high, _ranges(wanted[high], lengths[high], cosines[high], units)):
            if rows is not None:
                left[q] = False
                if len(rows):
                    found, scores = best_of_block(queries[q].astype(np.int64), int(q_ids[q]), float(bounds[q]), ids[rows], exact[rows], vectors[rows], norms[rows], k)
                    yield np.full(len(found), q_ids[q]), found, scores
    rest = np.flatnonzero(left)
    rest = rest[np.argsort(upto[rest], kind="stable")]
    for lo in range(0, len(rest), AT_ONCE):
        own = rest[lo:lo + AT_ONCE]
        rows = int(upto[own].max())
        scores = _products(vectors[:rows], exact[:rows], queries[own]).T
        fits = (ids[None, :rows] != q_ids[own][:, None]) & (scores >= bounds[own][:, None])
        if rows > k:
            masked = np.where(fits, scores, np.iinfo(np.int64).min)
            fits &= scores >= np.partition(masked, rows - k, axis=1)[:, rows - k][:, None]
        q, r = np.nonzero(fits)
        order = np.lexsort((ids[r], -scores[q, r], q))
        q, r = q[order], r[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        q, r = q[place < k], r[place < k]
        yield q_ids[own][q], ids[r], scores[q, r]


def _search(k: int):
    """A query block against a candidate block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, exact = _unpack(row, "")
                queries, wanted = _unpack(row, "q_")
                for found in best_of_blocks(queries, wanted, np.frombuffer(row["q_bounds"], float), ids, exact, k):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["query_id", "vec_id", "score"])
    return run


_HITS = "query_id long, vec_id long, score long"
_WORK = ["kind", "ids", "data", "q_kind", "q_ids", "q_data", "q_bounds"]


def _query_blocks(rows: DataFrame) -> DataFrame:
    return _blocks(rows, QUERY_BLOCK).select("size", F.col("bucket").alias("q_bucket"), F.col("part").alias("q_part"),
                                             *[F.col(c).alias(f"q_{c}") for c in ("kind", "ids", "data", "bounds")])


def top_products(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner products of each query.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows but those with the query's
    vec_id; ties go to the smaller vec_id. Vectors that are null or hold a null or a non-finite component take no part, nor do
    rows without vec_id. Products are of vectors of one size; repeated rows are queries and
    candidates each, and a query_id's ranks run over all of its rows. Other columns are left out. Components and products must fit 64 bits, else the
    query raises an error.
    """
    rows = checkpointed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
                        .mapInArrow(_quantised, "vec_id long, size int, norm double, data binary")
                        .withColumns({"bucket": _bucket(F.col("norm")), "bound": F.lit(float("-inf"))}))
    keys = ["size", "bucket", "part"]
    blocks = checkpointed(_blocks(rows, BLOCK).drop("bounds"))
    # blocks are numbered by size, longest vectors first
    numbered = blocks.select(*keys).withColumn("block", F.row_number().over(Window.partitionBy("size").orderBy(F.desc("bucket"), "part")) - 1)
    candidates = blocks.join(numbered, keys).drop("bucket", "part")
    queries = rows.filter(F.col("vec_id") % every == 0)

    # the first look: the block of the longest vectors of a size goes to each block of queries
    looking = checkpointed(_query_blocks(queries.withColumn("bucket", F.lit(0))))
    parts = looking.groupBy("size").agg((F.max("q_part") + 1).alias("looks"))
    longest = candidates.filter("block = 0").join(parts, "size").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("looks") - 1)))
    looks = looking.count()
    first = _dealt(longest.join(looking, ["size", "q_part"]), looks).mapInArrow(_search(k), _HITS)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))

    # a query's bound over its length is the least length of a vector that reaches it
    known = queries.drop("bound", "bucket").join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    least = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm") * (1 - SLACK)).otherwise(0.0)
    armed = checkpointed(_query_blocks(known.withColumn("bucket", _bucket(least))))
    # per size at most a few hundred buckets: how many blocks have vectors of a bucket
    held = numbered.groupBy("size", "bucket").agg(F.count("*").alias("blocks")).groupBy("size").agg(F.collect_list(F.struct("bucket", "blocks")).alias("held"))
    reached = F.aggregate(F.filter("held", lambda h: h["bucket"] >= F.col("q_bucket")), F.lit(0).cast("bigint"), lambda n, h: n + h["blocks"])
    visits = armed.join(held, "size").withColumn("reached", reached).filter("reached > 0").drop("held")
    pairs = visits.agg(F.sum("reached")).first()[0] or 0
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("reached").cast("int") - 1)))
    hits = _dealt(candidates.join(visits, ["size", "block"]), pairs).mapInArrow(_search(k), _HITS)
    return hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _dealt(work: DataFrame, pairs: int) -> DataFrame:
    """Pairs of blocks, whose work is far more than their bytes tell, over as many tasks as that takes."""
    tasks = max(1, min(-(-pairs // SHARE), 100_000))
    return work.repartition(tasks, "size", "block", "q_bucket", "q_part").select(*_WORK)
