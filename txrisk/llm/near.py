"""Near copies of texts: MinHash bands find candidates, exact set likeness confirms them, components class them.

Texts with equal shingle sets become one node. A band key that several nodes share is a bucket; its nodes are
compared block by block on packed b-bit signatures, and each node keeps the best partner that could still be
linked. Those pairs are confirmed on full sets, which joins nearly every group; what is left, pairs of nodes
that share a bucket, look alike and lie in different components, is compared on full sets, block by block,
and only the links that join components leave a task. So a group of m near copies costs m confirmations and no
list of its pairs, and no link between different texts is lost beyond the recall of the bands.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txrisk.llm import text as T
from txrisk.llm.components import components
from txrisk.llm.stages import stored
from txrisk.session import checkpointed, release

U64 = np.uint64
#: Expected nodes of a block of a bucket; a task compares two blocks.
BLOCK = 512
#: Rows of a bucket that is compared together with others, and pairs of rows that are compared at once.
SMALL, PAIRS = 64, 1 << 17
#: Rows of a bucket whose pairs are compared on full sets one by one, those of many buckets at once, and shingles that are looked up at once.
FEW, VALUES = 8, 1 << 18
#: Bytes of text of buckets that are cut into shingles together.
TEXTS = 1 << 21


class Banding:
    """Shingles of `width` words; a link needs 100 * intersection >= percent * union.

    `bands` bands of `rows` minima each find a pair of likeness s with probability 1 - (1 - s^rows)^bands.
    The low `bits` bits of all minima are kept; a pair is given up without a look at the full sets only when
    its matching minima are `sigmas` standard deviations below what the least link would show.
    """

    def __init__(self, width: int, percent: int, bands: int, rows: int, bits: int = 2, sigmas: float = 6.0):
        self.width, self.percent, self.bands, self.rows, self.bits = width, percent, bands, rows, bits
        self.hashes = bands * rows
        if 64 % bits or self.hashes * bits % 64:
            raise ValueError("signatures are packed into whole 64-bit words")
        self.longs = self.hashes * bits // 64
        chance = 2.0 ** -bits
        p = percent / 100 + (1 - percent / 100) * chance
        self.least_matches = int(np.floor(self.hashes * p - sigmas * np.sqrt(self.hashes * p * (1 - p))))

    def factors(self) -> np.ndarray:
        return T.mix(np.arange(1, self.hashes + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)

    def likeness(self, matches: np.ndarray) -> np.ndarray:
        """Similarity from matching b-bit minima, corrected for matches by chance."""
        chance = 2.0 ** -self.bits
        return np.clip((matches / self.hashes - chance) / (1 - chance), 0, 1)


def _minima(sets: np.ndarray, ends: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(hashes, rows) smallest 32-bit values of each non-empty row under each hash."""
    out, product = np.empty((len(factors), len(ends) - 1), U64), np.empty_like(sets)
    for k, f in enumerate(factors):
        np.minimum.reduceat(np.multiply(sets, f, out=product), ends[:-1], out=out[k])
    return out >> U64(32)


def _key_names(how: Banding) -> list[str]:
    return [f"k{j}" for j in range(how.bands)]


def _sign_names(how: Banding) -> list[str]:
    return [f"s{j}" for j in range(how.longs)]


def _signatures(how: Banding):
    factors = how.factors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            found = []
            for lo, hi, data, off in T.runs(batch.column("text")):
                sets, ends = T.shingles(*T.words(data, off), how.width)
                n = np.diff(ends)
                full = np.flatnonzero(n > 0)
                out = np.zeros((3 + how.bands + how.longs, hi - lo), np.int64)
                out[0] = n
                marks, keys, signs = out[1:3], out[3:3 + how.bands], out[3 + how.bands:]
                if len(full):
                    own = np.append(ends[:-1][full], ends[-1])
                    for j, salt in enumerate((U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25))):
                        marks[j, full] = T.mix(np.add.reduceat(T.mix(sets ^ salt), own[:-1])).view(np.int64)
                    low = _minima(sets, own, factors)
                    bands = low.reshape(how.bands, how.rows, -1)
                    h = np.arange(1, how.bands + 1, dtype=U64)[:, None] * U64(0x9E3779B97F4A7C15)
                    for r in range(how.rows):
                        h = T.mix(h ^ bands[:, r])
                    keys[:, full] = h.view(np.int64)
                    packed = (low & U64((1 << how.bits) - 1)).reshape(how.longs, -1, len(full))
                    for j in range(packed.shape[1]):
                        signs[:, full] |= (packed[:, j] << U64(j * how.bits)).view(np.int64)
                found.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, np.concatenate(found, 1))], names=["id", "n", "h1", "h2", *_key_names(how), *_sign_names(how)])
    return run


def signatures(rows: DataFrame, how: Banding) -> DataFrame:
    """(id, text) to id, set size n, 128-bit set hash h1 and h2, band keys k0, k1, ..., packed signature s0, s1, ..."""
    return rows.select("id", "text").mapInArrow(_signatures(how), ", ".join(f"{c} long" for c in ("id", "n", "h1", "h2", *_key_names(how), *_sign_names(how))))


def _block_rows(shared: DataFrame) -> DataFrame:
    """Deal the rows of each bucket into pairs of blocks: a row meets each block of its bucket once."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return (
        shared.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .drop("other", "size")
        .repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )


def _matches(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Matching minima of each pair of packed signatures (rows of a and of b)."""
    lanes = U64(sum(1 << k for k in range(0, 64, bits)))
    out = np.full((len(a), len(b)), a.shape[1] * (64 // bits), np.int32)
    for j in range(a.shape[1]):
        x = a[:, j][:, None] ^ b[:, j][None, :]
        folded = x
        for k in range(1, bits):
            folded = folded | (x >> U64(k))
        out -= np.bitwise_count(folded & lanes)
    return out


def _look_across(how: Banding, comp: np.ndarray, signs: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of two blocks that have a likely partner in the other one, the best partner of each, and its matches."""
    m = _matches(signs[left], signs[right], how.bits)
    m[(comp[left][:, None] == comp[right][None, :]) | (m < how.least_matches)] = -1
    best_l, got_l = m.argmax(1), m.max(1)
    l = np.flatnonzero(got_l >= 0)
    if same:
        return left[l], right[best_l[l]], got_l[l]
    best_r, got_r = m.argmax(0), m.max(0)
    r = np.flatnonzero(got_r >= 0)
    return np.concatenate([left[l], right[r]]), np.concatenate([right[best_l[l]], left[best_r[r]]]), np.concatenate([got_l[l], got_r[r]])


def _look_within(how: Banding, comp: np.ndarray, signs: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many small buckets of one block each, at rows `first` and the next `size`, all at once."""
    pairs = size * size
    start = np.repeat(first, pairs)
    wide = np.repeat(size, pairs)
    at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    j = start + at % wide
    i = start + at // wide
    x = signs[i] ^ signs[j]
    folded = x
    for k in range(1, how.bits):
        folded = folded | (x >> U64(k))
    lanes = U64(sum(1 << k for k in range(0, 64, how.bits)))
    m = how.hashes - np.bitwise_count(folded & lanes).sum(1, dtype=np.int64)
    m[(comp[i] == comp[j]) | (m < how.least_matches)] = -1
    # the most matches, then the first row
    heads = np.flatnonzero(at % wide == 0)
    best = np.maximum.reduceat((m << 32) - j, heads)
    found = best > 0
    got = -(-best[found] >> 32)
    return i[heads][found], (got << 32) - best[found], got


def _look(how: Banding):
    """For each row of a block pair, its best partner in another component that may be linked."""
    names = _sign_names(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in T.whole_groups(batches, ["key", "lo", "hi"]):
            comp, node, block, lo, hi = (table[c].to_numpy() for c in ("component", "node", "block", "lo", "hi"))
            signs = np.stack([table[s].to_numpy() for s in names], 1).view(U64)
            first, size = cuts[:-1], np.diff(cuts)
            several = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)
            small = several & (lo[first] == hi[first]) & (size <= SMALL)
            found = []
            own, n = first[small], size[small]
            part = np.cumsum(n * n) // PAIRS
            for k in np.split(np.arange(len(own)), np.flatnonzero(np.diff(part)) + 1) if len(own) else []:
                found.append(_look_within(how, comp, signs, own[k], n[k]))
            for g in np.flatnonzero(several & ~small):
                rows = np.arange(cuts[g], cuts[g + 1])
                left, right = rows[block[rows] == lo[rows[0]]], rows[block[rows] == hi[rows[0]]]
                if len(left) and len(right):
                    found.append(_look_across(how, comp, signs, left, right, lo[rows[0]] == hi[rows[0]]))
            if found:
                out, partner, matches = (np.concatenate(f) for f in zip(*found))
                taken = table.select(["key", "lo", "hi", "block", "node", "component"]).take(pa.array(out))
                yield from taken.append_column("partner", pa.array(node[partner])).append_column("matches", pa.array(matches.astype(np.int32))).to_batches()
    return run


LOOK = "key long, lo int, hi int, block int, node long, component long, partner long, matches int"


def _packed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed) of the texts of `nodes`, compressed before they are shuffled."""
    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in T.slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())],
                names=["node", "packed", "raw"])
    return rows.mapInArrow(run, "node long, packed binary, raw long").join(nodes, "node", "left_semi")


def _sets(packed: list[bytes], raw: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    codec = pa.Codec("zstd")
    texts = [codec.decompress(p, n, asbytes=True) for p, n in zip(packed, raw)]
    off = np.concatenate(([0], np.cumsum(raw))).astype(np.int64)
    return T.shingles(*T.words(np.frombuffer(b"".join(texts), np.uint8), off), width)


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _confirm(how: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            out = []
            for i, (a, b) in enumerate(zip(cols["a"], cols["b"])):
                sets, ends = _sets([cols["packed_a"][i], cols["packed_b"][i]], [cols["raw_a"][i], cols["raw_b"][i]], how.width)
                one, two = sets[:ends[1]], sets[ends[1]:]
                if linked(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two), how.percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


def confirmed(pairs: DataFrame, packed: DataFrame, how: Banding) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are alike enough."""
    def side(s):
        return packed.select(F.col("node").alias(s), F.col("packed").alias(f"packed_{s}"), F.col("raw").alias(f"raw_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirm(how), "a long, b long")


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _joining(how: Banding, comp: np.ndarray, sets: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows of two blocks that join components. A left row counts what it shares with each right row."""
    sizes = np.diff(ends)
    order = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in right]) if len(right) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(right)), sizes[right])
    by = np.argsort(sets[order], kind="stable")
    values, owner = sets[order][by], owner[by]
    forest, out = _Forest(), []
    for l in left:
        own = sets[ends[l]:ends[l + 1]]
        a, b = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = b - a
        hits = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        shared = np.bincount(owner[hits], minlength=len(right))
        alike = (100 * shared >= how.percent * (sizes[l] + sizes[right] - shared)) & (comp[right] != comp[l])
        out += [(int(l), int(r)) for r in right[np.flatnonzero(alike)] if forest.join(int(comp[l]), int(comp[r]))]
    return out


def _linked_pairs(how: Banding, sets: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows of each pair are linked, for many pairs at once."""
    sizes = np.diff(ends)
    out = linked(np.minimum(sizes[i], sizes[j]), sizes[i], sizes[j], how.percent)
    values, rank = np.unique(sets, return_inverse=True)
    keys = np.repeat(np.arange(len(sizes)), sizes) * len(values) + rank  # ascending: by row, then by value
    asked = np.flatnonzero(out)
    part = np.cumsum(sizes[i[asked]]) // VALUES
    for now in np.split(asked, np.flatnonzero(np.diff(part)) + 1) if len(asked) else []:
        n = sizes[i[now]]
        start = np.cumsum(n) - n
        own = rank[np.arange(n.sum()) + np.repeat(ends[i[now]] - start, n)]
        want = np.repeat(j[now], n) * len(values) + own
        shared = np.add.reduceat(keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want, start, dtype=np.int64)
        out[now] = linked(shared, n, sizes[j[now]], how.percent)
    return out


def _joining_few(how: Banding, comp: np.ndarray, sets: np.ndarray, ends: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """The same as `_joining` within many buckets of few rows, at rows `first` and the next `size`."""
    found = []
    for a in range(FEW):
        for b in range(a + 1, FEW):
            own = first[size > b]
            found.append((own + a, own + b))
    i, j = (np.concatenate(x) for x in zip(*found))
    pick = comp[i] != comp[j]
    i, j = i[pick], j[pick]
    ok, forest = _linked_pairs(how, sets, ends, i, j), _Forest()
    return [(int(l), int(r)) for l, r in zip(i[ok], j[ok]) if forest.join(int(comp[l]), int(comp[r]))]


def _compare(how: Banding):
    """Full sets of two blocks against each other; the links that join components leave the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in T.whole_groups(batches, ["key", "lo", "hi"]):
            comp, node, block, lo, hi, raw = (table[c].to_numpy() for c in ("component", "node", "block", "lo", "hi", "raw"))
            first = cuts[:-1]
            open_ = np.flatnonzero(np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first))
            # texts of several buckets are cut into shingles at once
            part = np.cumsum(np.add.reduceat(raw, first)[open_]) // TEXTS
            for groups in np.split(open_, np.flatnonzero(np.diff(part)) + 1) if len(open_) else []:
                rows = np.concatenate([np.arange(cuts[g], cuts[g + 1]) for g in groups])
                sets, ends = _sets(table["packed"].take(pa.array(rows)).to_pylist(), raw[rows].tolist(), how.width)
                size = cuts[groups + 1] - cuts[groups]
                at = np.cumsum(size) - size
                few = (size <= FEW) & (lo[first[groups]] == hi[first[groups]])
                own = comp[rows]
                out = _joining_few(how, own, sets, ends, at[few], size[few])
                for g, start in zip(groups[~few], at[~few]):
                    here = np.arange(start, start + cuts[g + 1] - cuts[g])
                    b = block[rows[here]]
                    out += _joining(how, own, sets, ends, here[b == lo[first[g]]], here[b == hi[first[g]]])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(node[rows[[p[k] for p in out]]]) for k in (0, 1)], names=["a", "b"])
    return run


def near_classes(rows: DataFrame, how: Banding) -> DataFrame:
    """(id, n, component) for each row of `rows` (id, text); n is the size of the shingle set.

    component is the smallest id that can be reached over links. A row without shingles is its own component.
    Rows that share an id are one node; a row without id gets no component and links nothing.
    """
    marks = stored(signatures(rows, how), "marks")
    full = marks.filter("n > 0 and id is not null")
    classes = full.groupBy("h1", "h2", "n").agg(F.min("id").alias("node"))
    tagged = full.join(classes, ["h1", "h2", "n"])
    keys, names = _key_names(how), _sign_names(how)
    # rows of equal sets have equal keys and signatures, so any of them, as the least, is the node's
    nodes = full.groupBy("h1", "h2", "n").agg(F.min("id").alias("node"), *[F.min(c).alias(c) for c in keys + names])
    # band keys travel alone; most are a single node's, and only the others meet their signatures again, once the keys' files are gone
    keyed = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    size = keyed.groupBy("key").agg(F.count("node").alias("size")).filter("size > 1")  # of the node, so that both read the same files
    several = checkpointed(keyed.join(size.hint("shuffle_hash"), "key"))
    release(rows.sparkSession)
    shared = checkpointed(several.join(nodes.select("node", *names), "node"))
    release(rows.sparkSession)

    alone = shared.withColumn("component", F.col("node"))
    first = checkpointed(_block_rows(alone).mapInArrow(_look(how), LOOK))
    packed = checkpointed(_packed(rows.select("id", "text"), first.select("node").unionByName(first.select(F.col("partner").alias("node"))).distinct()).dropDuplicates(["node", "packed"]))
    best = first.groupBy("node").agg(F.max(F.struct("matches", (-F.col("partner")).alias("partner"))).alias("best"))
    pairs = best.select(F.least("node", -F.col("best.partner")).alias("a"), F.greatest("node", -F.col("best.partner")).alias("b")).distinct()
    release(rows.sparkSession)
    links = checkpointed(confirmed(pairs, packed, how))

    def labelled(df: DataFrame, found: DataFrame) -> DataFrame:
        return df.join(found.withColumnRenamed("component", "own"), "node", "left").withColumn("component", F.coalesce("own", "node")).drop("own")

    # buckets that still hold several components, without the rows that have no likely partner in them
    found = components(links)
    release(rows.sparkSession)
    flagged = labelled(first.select("key", "node").distinct().join(shared, ["key", "node"]), found)
    split = flagged.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("members")).filter("c0 <> c1").select("key", "members")
    open_rows = flagged.drop("size").join(split, "key").withColumnRenamed("members", "size")
    again = _block_rows(open_rows).mapInArrow(_look(how), LOOK)
    left = again.select("key", "lo", "hi", "block", "node", "component")
    compared = left.join(packed, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_compare(how), "a long, b long")
    found = components(links.unionByName(compared))
    release(rows.sparkSession)
    member = labelled(tagged.select("id", "node"), found).groupBy("id").agg(F.min("component").alias("component"))
    return (
        marks.select("id", "n").join(member, "id", "left")
        .select("id", "n", F.coalesce("component", "id").alias("component"))
    )
