"""Repeated lines: levelled sorted runs of line keys, and documents without the lines that others hold.

A key is a hash of 128 bits of a line without white space at its ends, with A-Z lower-cased. Documents come in batches. Each
batch is anti-joined with the runs so far, adds a run of its own, and `fan` runs of a level become one of the next level.
Runs are Parquet tables in buckets, sorted by key, so neither the anti-join nor the merge shuffles them.
"""

from collections.abc import Iterator
from functools import reduce
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txrisk.llm import text as T
from txrisk.llm.stages import stored
from txrisk.session import ensure_checkpoint_dir

#: Keys of fewer code points are never dropped; a key counts as repeated from so many documents on.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches of a table, and runs of a level that are merged.
BATCHES, FAN = 4, 2
#: A key that holds more than this part of a batch's rows is hot; a batch has at most as many hot keys.
HOT_PART = 1024
#: Stands for a null doc_id: one document below all others.
NO_ID = -(1 << 63)
SPACES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """The key of a line in UTF-8, None if it is too short to be dropped."""
    line = line.strip(SPACES).lower()
    if len(line) < LEAST_CHARS or (len(line) < 4 * LEAST_CHARS and len(line.decode()) < LEAST_CHARS):
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches, 1 << 21):
        docs, keys = [], []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            own = {line_key(line) for line in (text or b"").split(b"\n")} - {None}
            docs += [doc] * len(own)
            keys += own
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.binary())], names=["doc", "key"])


class SortedRuns:
    """Runs of (key, docs, largest, hot): in how many documents a key was seen, the largest of them, whether it is hot.

    `docs` may stop to grow once a key is known in `least` documents of which none added later is larger.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCS, fan: int = FAN):
        ensure_checkpoint_dir(spark)
        self.spark, self.least, self.fan = spark, least, fan
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/line-runs-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.written = 0

    def _write(self, run: DataFrame) -> DataFrame:
        self.written += 1
        name = f"line_run_{self.folder[-32:]}_{self.written}"
        run.select("key", "docs", "largest", "hot").write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option(
            "path", f"{self.folder}/{self.written}").saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows of `batch` that tell the runs something new: keys not yet seen in `least` documents, or not in one as
        large, and hot ones."""
        known = batch
        for i, run in enumerate(self.runs()):
            own = run.select("key", F.col("docs").alias(f"docs{i}"), F.col("largest").alias(f"largest{i}"))
            known = known.join(own, "key", "left")
        count = len(self.runs())
        if not count:
            return batch
        seen = reduce(Column.__add__, [F.coalesce(F.col(f"docs{i}"), F.lit(0)) for i in range(count)])
        above = reduce(Column.__or__, [F.coalesce(F.col(f"largest{i}") >= F.col("largest"), F.lit(False)) for i in range(count)])
        return known.filter(~((seen >= self.least) & above) | F.col("hot")).select("key", "docs", "largest", "hot")

    def add(self, batch: DataFrame) -> None:
        """Add the run of a batch (key, docs, largest, hot) of documents that no earlier batch had."""
        new = self._write(self.unsettled(batch))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(new)
        for at in range(len(self.levels)):
            if len(self.levels[at]) == self.fan:
                merged = self._write(self._merged(self.levels[at]))
                self.levels[at] = []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            other = b.select("key", F.col("docs").alias("docs_b"), F.col("largest").alias("largest_b"), F.col("hot").alias("hot_b"))
            no = F.lit(False)
            return a.join(other, "key", "full").select(
                "key", (F.coalesce("docs", F.lit(0)) + F.coalesce("docs_b", F.lit(0))).alias("docs"),
                F.greatest("largest", "largest_b").alias("largest"), (F.coalesce("hot", no) | F.coalesce("hot_b", no)).alias("hot"))
        return reduce(two, runs)

    def repeated(self) -> DataFrame:
        """(key, largest, hot) of the keys seen in `least` documents or more."""
        return self._merged(self.runs()).filter(F.col("docs") >= self.least).select("key", "largest", "hot")


def _counted(keyed: DataFrame) -> DataFrame:
    rows = keyed.count()
    return keyed.groupBy("key").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("largest")).withColumn(
        "hot", F.col("docs") * HOT_PART > rows)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches, 1 << 21):
        texts, lines, dropped = [], [], []
        for text, drops in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("drops").to_pylist()):
            own = (text or b"").split(b"\n")
            drops = set(drops or ())
            kept = [line for line in own if line_key(line) not in drops] if drops else own
            texts.append(b"\n".join(kept).decode())
            lines.append(len(own))
            dropped.append(len(own) - len(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            names=["doc_id", "text", "n_lines", "n_dropped"])


def drops(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc, key) of the lines to drop: repeated keys in all documents but the largest.

    Hot keys, at most HOT_PART for each batch, are broadcast, so that the rows of one key never meet in one task; a key that
    is hot in no batch holds less than that part of all rows.
    """
    hot = F.broadcast(repeated.filter("hot").drop("hot"))
    rest = keyed.join(hot.select("key"), "key", "left_anti").join(repeated.filter("not hot").drop("hot"), "key")
    return keyed.join(hot, "key").unionByName(rest).filter(F.col("doc") < F.col("largest")).select("doc", "key")


def without_repeated_lines(docs: DataFrame, batches: int = BATCHES, least: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every document: its text without the lines whose key at least `least` documents
    hold, unless it has the largest doc_id of them.

    A null or empty text is one empty line. Rows that share a doc_id are one document, rows without one together the
    smallest; other columns are left out. Batches are ranges of doc_id from the largest on, equal in rows but for ties.
    """
    rows = T.id_and_text(docs).withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    shares = [i / batches for i in range(1, batches)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc", shares, 10000)).first()[0] or [])) if shares else []
    number = reduce(Column.__add__, [(F.col("doc") <= b).cast("int") for b in bounds], F.lit(0))
    found = rows.select("doc", "text").mapInArrow(_keys, "doc long, key binary")
    keyed = stored(found.withColumn("batch", number), "line-keys", by=["batch"])
    runs = SortedRuns(docs.sparkSession, least)
    for batch in range(len(bounds) + 1):
        runs.add(_counted(keyed.filter(F.col("batch") == batch).select("doc", "key")))
    lost = drops(keyed.select("doc", "key"), runs.repeated()).groupBy("doc").agg(F.collect_set("key").alias("drops"))
    return rows.join(lost, "doc", "left").select("doc_id", "text", "drops").mapInArrow(
        _without, "doc_id long, text string, n_lines long, n_dropped long")

