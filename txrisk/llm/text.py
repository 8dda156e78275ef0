"""Whole texts as numpy arrays: Arrow columns cut into runs of documents, their words and shingles as 64-bit hashes.

Words are maximal runs of characters other than U+0020 and U+0009 to U+000D, with A-Z lower-cased. All of
it works on the UTF-8 bytes of an Arrow column, so no Python string is made for a word.
"""

from collections.abc import Iterator
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on at once; a longer document is a run of its own.
RUN_BYTES = 1 << 16
_ODD = U64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(64, _ODD), dtype=U64)


def keep_memory_low() -> None:
    """Let freed arrays go back to the system at once: by default the C library keeps more and more of them, and a
    worker process lives as long as its executor. Without that library nothing changes."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # arrays from 1 MB on are mapped, and unmapped when freed
        libc.mallopt(-8, 2)        # two arenas
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], limit: int = 1 << 23, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `limit` bytes of text, or one row."""
    keep_memory_low()
    for batch in batches:
        texts = batch.column(column)
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        keep_memory_low()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators need; whatever else `docs` has stays out of their way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the place where each row begins; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    off = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, places) of neighbouring rows with at most `limit` bytes or one row."""
    data, off = bytes_of(column)
    lo, rows = 0, len(column)
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all words without space, where each word begins there, where it begins in `data`,
    and the number of the first word of each row (one more entry than rows)."""
    low = LOWER[data]
    inside = ~SPACE[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(low)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    at = np.cumsum(inside)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    return low[inside], at, starts, np.searchsorted(starts, off)


def hash_words(kept: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    global _powers
    if not len(at):
        return np.zeros(0, U64)
    sizes = np.diff(np.append(at, len(kept)))
    if (longest := int(sizes.max())) > len(_powers):
        _powers = np.cumprod(np.full(longest, _ODD), dtype=U64)
    place = np.arange(len(kept)) - np.repeat(at, sizes)
    return mix(np.add.reduceat(_powers[place] * (kept.astype(U64) + U64(1)), at) + sizes.astype(U64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run, and the number of the first word of each row."""
    kept, at, _, first = word_bounds(data, off)
    return hash_words(kept, at), first


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row in one array, and where each row begins.

    A row with fewer than `width` words has its whole sequence as its one shingle; without words it has none.
    """
    sizes = np.diff(first)
    rows = len(sizes)
    out = np.zeros(len(hashes), U64)
    for k in range(width):
        left = len(hashes) - k
        if left > 0:
            out[:left] += hashes[k:] * (_powers[k] | U64(1))
    out = mix(out + U64(width))
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    for r in np.flatnonzero((sizes > 0) & (sizes < width)):
        own = hashes[first[r]:first[r + 1]]
        out[first[r]] = mix((own * (_powers[:len(own)] | U64(1))).sum(dtype=U64, keepdims=True) + U64(len(own)))[0]
    row = np.repeat(np.arange(rows), counts)
    own = sorted_rows(out[np.arange(len(row)) + np.repeat(first[:-1] - np.cumsum(counts) + counts, counts)], row, counts)
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    return own[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=rows)))).astype(np.int64)


def sorted_rows(values: np.ndarray, row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values in order within each row; `counts` of them follow one another in a row."""
    if len(values) > 256 * len(counts):
        return np.concatenate([np.sort(part) for part in np.split(values, np.cumsum(counts)[:-1])])
    # many short rows at once: by row and the upper 48 bits, which leave hardly a tie open
    out = values[np.argsort((row.astype(U64) << U64(48)) | (values >> U64(16)))]
    if len(counts) > 1 << 16 or ((out[1:] < out[:-1]) & (row[1:] == row[:-1])).any():
        out = values[np.lexsort((values, row))]
    return out


def strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal `keys` and the bounds of the runs, from rows that come sorted by them."""
    keep_memory_low()
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        if not now.num_rows:
            rest = now
            continue
        change = np.zeros(now.num_rows - 1, bool)
        for k in keys:
            own = now[k].to_numpy()
            change |= own[1:] != own[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1))
        now = now.combine_chunks()
        if len(cuts) > 1:
            yield now.slice(0, cuts[-1]), cuts
        rest = now.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of rows with equal `keys`, from rows that come sorted by them."""
    for table, cuts in whole_groups(batches, keys):
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield table.slice(lo, hi - lo)
