"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. On each level, runs of equal names become one, deterministic coin tossing shortens the
names to a few labels that depend on close neighbours only, and local maxima of the labels begin phrases. A
phrase's name is a hash of the names in it, so a substring gets the same phrases, but for a few at its ends,
wherever it stands. The phrase names of the second and of the higher levels, up to the root, are sampled into bins
(the smallest hash of each bin, of which one byte is kept); equal bins of two fingerprints estimate their likeness.
"""

from collections.abc import Iterator
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from txrisk.llm import text as T
from txrisk.session import checkpointed

U64 = np.uint64
#: Bins for phrases of the second level and of those above it.
LOW_BINS, HIGH_BINS = 16, 48
BINS = LOW_BINS + HIGH_BINS
EMPTY = 255
#: Characters that are parsed at once; a longer text is parsed alone.
RUN_CHARS = 1 << 16

_STEP, _SIZE, _LEVEL = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def _toss_table(size: int) -> np.ndarray:
    """Label of a symbol next to its left neighbour: twice the lowest bit in which they differ, plus the symbol's bit."""
    out = np.zeros((size, size), np.uint8)
    for left in range(size):
        for own in range(size):
            if left != own:
                bit = ((left ^ own) & -(left ^ own)).bit_length() - 1
                out[left, own] = 2 * bit + (own >> bit & 1)
    return out


_TOSS = [_toss_table(n) for n in (130, 16, 8)]


def _parse_level(names: np.ndarray, heads: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level and where each text begins in them; `heads` are the first places of non-empty texts."""
    first = np.zeros(len(names), bool)
    first[heads] = True
    new = first.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(names)))
    own, first = names[at], first[at]
    many = sizes > 1
    own[many] = T.mix(own[many] ^ (sizes[many].astype(U64) * _SIZE))
    left = np.empty_like(own)
    left[0], left[1:] = 0, own[:-1]
    differ = own ^ left
    bit = np.bitwise_count((differ & (~differ + U64(1))) - U64(1))
    labels = (2 * bit + ((own >> np.minimum(bit, 63).astype(U64)) & U64(1)).astype(np.uint8)).astype(np.uint8)
    labels[first] = 129
    for table in _TOSS:
        before = np.empty_like(labels)
        before[0], before[1:] = 0, labels[:-1]
        before[first] = 0
        labels = table[before, labels]
    begins = first.copy()
    ends = np.append(first[1:], True)  # the last name of a text has none behind it, and begins no phrase
    begins[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~ends[1:-1]
    starts = np.flatnonzero(begins)
    n = np.diff(np.append(starts, len(own)))
    place = (np.arange(len(own)) - np.repeat(starts, n)).astype(U64)
    total = np.add.reduceat(T.mix(own + (place + U64(1)) * _STEP), starts)
    return T.mix(total + n.astype(U64) * _SIZE + U64((level + 1) * int(_LEVEL) & 0xFFFFFFFFFFFFFFFF)), np.flatnonzero(first[starts])


def _sample(low: np.ndarray, rows: np.ndarray, names: np.ndarray, level: int) -> None:
    """Keep the smallest hash of each bin of each row."""
    h = T.mix(names ^ (_LEVEL if level == 2 else U64(0)))
    count, base = (LOW_BINS, 0) if level == 2 else (HIGH_BINS, LOW_BINS)
    bins = base + ((h >> U64(40)) % U64(count)).astype(np.int64)
    np.minimum.at(low.reshape(-1), rows * BINS + bins, h & U64(0xFFFFFFFF))


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Root name and bins of each text. An empty text has root 0 and empty bins."""
    roots, low = np.zeros(len(texts), U64), np.full((len(texts), BINS), 1 << 32, U64)
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = np.flatnonzero(sizes > 0)
    lo = 0
    ends = np.cumsum(sizes[rows])
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN_CHARS, "right")))
        live = rows[lo:hi]
        points = np.frombuffer("".join([texts[r] for r in live]).encode("utf-32-le", "surrogatepass"), np.uint32)
        names, heads, level = points.astype(U64) + U64(1), np.cumsum(sizes[live]) - sizes[live], 0
        while len(live):
            names, heads = _parse_level(names, heads, level)
            level += 1
            n = np.diff(np.append(heads, len(names)))
            if level >= 2:
                _sample(low, np.repeat(live, n), names, level)
            done = n == 1
            roots[live[done]] = names[heads[done]]
            if level == 1:  # a text of one phrase has no higher ones
                _sample(low, live[done], names[heads[done]], 3)
            names, live, n = names[np.repeat(~done, n)], live[~done], n[~done]
            heads = np.cumsum(n) - n
        lo = hi
    return roots, np.where(low == 1 << 32, EMPTY, low % U64(EMPTY)).astype(np.uint8)


def fingerprints(roots: np.ndarray, bins: np.ndarray) -> list[str]:
    """Root name and bins as hexadecimal text."""
    return [f"{r:016x}{b.tobytes().hex()}" for r, b in zip(roots.tolist(), bins)]


def likeness(roots_a: np.ndarray, bins_a: np.ndarray, roots_b: np.ndarray, bins_b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those filled in either, less the matches of bytes by chance; 1 for equal roots."""
    filled = ((bins_a != EMPTY) | (bins_b != EMPTY)).sum(1)
    same = ((bins_a == bins_b) & (bins_a != EMPTY)).sum(1) / np.maximum(filled, 1)
    return np.where(roots_a == roots_b, 1.0, np.clip((same - 1 / EMPTY) / (1 - 1 / EMPTY), 0, 1))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters from the begin of the next text, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _results(ids: list, texts: list[str], following: list[str], own, after) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, following)]
    other = sketches(changed)
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            T.strings([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            T.strings(fingerprints(*own)), T.strings(fingerprints(*other)), pa.array(likeness(*own, *other)), pa.array(likeness(*own, *after))]


def _names() -> list[str]:
    return [c.split()[0] for c in _RESULT.split(", ")]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows that have their next row in the same partition, then the first and last row as edges."""
    nothing = [None] * len(_names())
    before = first = None

    def edge(kind: int, doc_id, text: str) -> pa.RecordBatch:
        row = [pa.array([v], t) for v, t in zip([doc_id, *nothing[1:]], (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays([*row, pa.array([kind], pa.int32()), pa.array([text], pa.string())], names=[*_names(), "edge", "text"])

    for batch in T.slices(batches, 1 << 21):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for lo in range(0, len(ids), 512):
            own_ids, own = ids[lo:lo + 512], texts[lo:lo + 512]
            if first is None:
                first = (own_ids[0], own[0])
            roots, bins = sketches(own)
            if before is not None:
                own_ids, own = [before[0], *own_ids], [before[1], *own]
                roots, bins = np.append(before[2], roots), np.concatenate((before[3], bins))
            before = (own_ids[-1], own[-1], roots[-1:], bins[-1:])
            if len(own) > 1:
                out = _results(own_ids[:-1], own[:-1], own[1:], (roots[:-1], bins[:-1]), (roots[1:], bins[1:]))
                n = len(own) - 1
                yield pa.RecordBatch.from_arrays([*out, pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())], names=[*_names(), "edge", "text"])
    if before is not None:
        yield edge(1, *first)
        yield edge(2, *before[:2])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays(_results(batch.column("doc_id").to_pylist(), texts, following, sketches(texts), sketches(following)), names=_names())


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike it is to that and to the next document.

    The next document is the one with the next doc_id (nulls first; rows that share an id are in the order of their texts);
    after the last comes the first, so a single row is its own next. A null text is empty; equal texts have
    equal fingerprints, two empty ones a likeness of 1.

    The texts are dealt out once, by ranges of doc_id. Only the first and the last row of a range are matched
    with those of other ranges afterwards.
    """
    rows = T.id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    ranged = rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    found = checkpointed(ranged.mapInArrow(_in_order, _RESULT + ", edge int, text string"))
    edges = found.filter("edge > 0").select("edge", "doc_id", "text")
    by_id = Window.partitionBy("edge").orderBy(F.asc_nulls_first("doc_id"))
    # the k-th range ends before the next one begins; the ranges are few, and only their ids are ordered
    places = edges.select("edge", "doc_id").withColumn("range", F.row_number().over(by_id))
    count = F.max("range").over(Window.partitionBy("edge"))
    turned = places.withColumn("range", F.when(F.col("edge") == 2, F.col("range") % count + 1).otherwise(F.col("range")))

    def side(kind: int, doc_id: str, text: str) -> DataFrame:
        own = turned.filter(F.col("edge") == kind).select("range", F.col("doc_id").alias(doc_id))
        texts = edges.filter(F.col("edge") == kind).select(F.col("doc_id").alias("of"), F.col("text").alias(text))
        return own.join(texts, F.col(doc_id).eqNullSafe(F.col("of"))).drop("of")

    ends = side(2, "doc_id", "text").join(side(1, "next_id", "following"), "range").select("doc_id", "text", "following").mapInArrow(_edges, _RESULT)
    return found.filter("edge = 0").select(*_names()).unionByName(ends)
