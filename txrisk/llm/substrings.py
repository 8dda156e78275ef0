"""Substring dedup: near copies of paragraphs, found by MinHash bands, and repeated passages of whole texts, wherever they begin.

A passage is a run of words each of which lies in a stretch of PASSAGE words that the corpus has before, in order of
doc_id and place. Each stretch has an anchor, the word run of ANCHOR words in it whose hash is least, so equal stretches
have equal anchors, and a text has about one anchor in 14 words. Only anchors that occur again are looked at further:
an anchor whose stretches are all those of an earlier one needs no look at the text, for the others the text is read
again and every stretch is compared by itself. Paragraphs that go as near copies are no part of any stretch.
"""

from collections.abc import Iterator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from txrisk.llm import text as T
from txrisk.llm.near import Banding, near_classes
from txrisk.llm.stages import stored
from txrisk.session import checkpointed, release

U64 = np.uint64

#: 12 bands of 2 minima find a pair of likeness 0.8 with probability 1 - 5e-6.
PARAGRAPHS = Banding(width=5, percent=80, bands=12, rows=2, bits=8)
#: Lines with fewer words are no paragraphs: they repeat by chance, and in lists and headings.
LEAST_WORDS = 20
#: A paragraph's id is its document's id, then its number in this many bits.
PLACE_BITS = 24
WORD, BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
#: Words of the shortest passage that counts as a repeat, and of an anchor.
PASSAGE, ANCHOR = 51, 25
#: Stretches of several texts that leave a task together.
WAITING = 1 << 15


def paragraphs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, text) of the lines of whole texts that have at least `least_words` words, numbered from 0 in their text."""
    lines = T.id_and_text(docs).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "text"))
    wide = 1 << (62 - PLACE_BITS)
    fits = F.col("doc_id").between(-wide, wide - 1) & (F.col("place") < (1 << PLACE_BITS))
    # looks at no more words than it takes to tell, and never back
    long = rf"\A{BLANK}*+(?:{WORD}+{BLANK}++){{{least_words - 1}}}{WORD}" if least_words > 0 else ""
    return lines.filter(F.col("text").rlike(long)).select(
        F.when(F.coalesce(fits, F.lit(True)), F.col("doc_id") * (1 << PLACE_BITS) + F.col("place"))
        .otherwise(F.raise_error(F.lit("document ids or line numbers are too large for paragraph ids")).cast("long")).alias("id"), "text")


def _doc(paragraph: Column) -> Column:
    return F.shiftright(paragraph, PLACE_BITS)


def _place(paragraph: Column) -> Column:
    return paragraph.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def repeated_paragraphs(docs: DataFrame, how: Banding = PARAGRAPHS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, paragraph, class_doc_id, class_paragraph, removed) of each paragraph that has near copies.

    A class is a component of links between paragraphs; it is named by its first paragraph, in order of doc_id and place, which stays.
    Documents whose paragraphs all stand alone have no row, nor have null and empty texts. Repeated rows
    of one doc_id are one document; rows without doc_id are in no class.
    """
    found = near_classes(paragraphs(docs, least_words).filter("id is not null"), how)
    copies = found.filter("id <> component").select("id", "component").distinct()
    firsts = copies.select("component").distinct().select(F.col("component").alias("id"), "component")
    return copies.unionByName(firsts).select(
        _doc(F.col("id")).alias("doc_id"), _place(F.col("id")).alias("paragraph"), _doc(F.col("component")).alias("class_doc_id"),
        _place(F.col("component")).alias("class_paragraph"), (F.col("id") != F.col("component")).alias("removed"))


_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` neighbouring words."""
    n = len(hashes)
    if n > len(_powers[0]):
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, U64), np.full(max(n, 1 << 14) - 1, b, U64))), dtype=U64) for b in (_POWER, _INVERSE)]
    up, down = _powers[0][:n], _powers[1]
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * up, dtype=U64)))
    return T.mix((sums[width:] - sums[:-width]) * down[:max(n - width + 1, 0)] + U64(width)) if n >= width else np.zeros(0, U64)


def _begins(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of PASSAGE words begins that lies in one row, and its row."""
    sizes = np.maximum(np.diff(first) - PASSAGE + 1, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return first[:-1][row] + np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row], row


def _stretches(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each stretch of PASSAGE words begins that lies in one row, its row, its hash, and where its anchor begins."""
    begin, row = _begins(first)
    if not len(begin):
        return begin, row, np.zeros(0, U64), begin
    return begin, row, _run_hashes(hashes, PASSAGE)[begin], _first_least(_run_hashes(hashes, ANCHOR), PASSAGE - ANCHOR + 1)[begin]


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value in each window of `width` neighbours, from windows of 1, 2, 4, ... of them."""
    least, at, reach = values, np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        later = least[step:] < least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        reach += step
    return at


def _list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, n): how often each anchor begins a run of stretches in a slice, without more."""
    for batch in T.slices(batches):
        found = []
        for _, _, data, off in T.runs(batch.column("text")):
            hashes, first = T.words(data, off)
            begin, _ = _begins(first)
            if len(begin):
                anchors = _run_hashes(hashes, ANCHOR)
                at = _first_least(anchors, PASSAGE - ANCHOR + 1)[begin]
                found.append(anchors[at[np.concatenate(([True], at[1:] != at[:-1]))]])
        anchor, n = np.unique(np.concatenate([np.zeros(0, U64), *found]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        found = []
        for lo, _, data, off in T.runs(batch.column("text")):
            kept, at, starts, first = T.word_bounds(data, off)
            hashes = T.hash_words(kept, at)
            begin, row, own, anchor = _stretches(hashes, first)
            if not len(begin):
                continue
            heads = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            n = np.diff(np.append(heads, len(begin)))
            alike = T.mix(np.add.reduceat(T.mix(own ^ U64(0x2545F4914F6CDD1D)), heads) + n.astype(U64))
            lines = np.concatenate(([0], np.cumsum(data == 10)))
            r, b = row[heads], begin[heads]
            line, last = (lines[starts[w]] - lines[off[r]] for w in (b, b + n + PASSAGE - 2))
            found.append((lo + r, _run_hashes(hashes, ANCHOR)[anchor[heads]].view(np.int64), alike.view(np.int64),
                          *(x.astype(np.int32) for x in (b - first[r], n, line, last))))
        if found:
            r, *columns = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r)), *map(pa.array, columns)], names=["doc_id", "anchor", "alike", "place", "n", "line", "last"])


_ANCHORS = "doc_id long, anchor long, alike long, place int, n int, line int, last int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=1)
    for batch in T.slices(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())],
            names=["doc_id", "packed", "raw"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, place, own): the stretches of the anchors in `open`, without those that touch a line of `gone`."""
    codec = pa.Codec("zstd")
    T.keep_memory_low()
    for batch in batches:
        found, waiting = [], 0
        for r in range(batch.num_rows):
            size = batch.column("raw")[r].as_py()
            data = np.frombuffer(codec.decompress(batch.column("packed")[r].as_py(), size, asbytes=True), np.uint8)
            kept, at, starts, _ = T.word_bounds(data, np.array([0, size]))
            asked = batch.column("open")[r].values
            head, n = (asked.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("place", "n"))
            place = np.repeat(head - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = _run_hashes(T.hash_words(kept, at), PASSAGE)
            place = np.unique(place[place < len(own)])
            if (gone := batch.column("gone")[r].as_py()) and len(place):
                lines = np.cumsum(data == 10)[starts]
                lost = np.concatenate(([0], np.cumsum(np.isin(lines, gone))))
                place = place[lost[place + PASSAGE] == lost[place]]
            found.append((np.full(len(place), batch.column("doc_id")[r].as_py(), np.int64), place.astype(np.int32), own[place].view(np.int64)))
            waiting += len(place)
            if waiting >= WAITING or r == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["doc_id", "place", "own"])
                found, waiting = [], 0


def repeated_passages(docs: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(doc_id, first_word, n_words, class_doc_id, class_word) of each passage that the corpus has before.

    Words are numbered from 0 in their text. The class is where the passage's first stretch occurs first. `gone`
    (doc_id, paragraph) names lines that take no part. Repeated rows of one doc_id are one document; rows without
    doc_id take no part.
    """
    rows = T.id_and_text(docs).filter("doc_id is not null and text is not null")
    if gone is None:
        gone = docs.sparkSession.createDataFrame([], "doc_id long, paragraph long")
    gone = gone.groupBy("doc_id").agg(F.collect_set("paragraph").alias("gone"))
    # anchors that occur once end here; what the joins below ask for is stored first, so Spark can split the rows of a very common anchor
    anchors = rows.mapInArrow(_find_anchors, _ANCHORS)
    again = stored(rows.mapInArrow(_list_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("times")).filter("times > 1").select("anchor"), "again")
    # an anchor that lies in a line that is gone ends here, too; one beside such a line is compared by its stretches
    touched = F.exists(F.coalesce("gone", F.array().cast("array<bigint>")), lambda k: k.between(F.col("line"), F.col("last")))
    shared = stored(anchors.join(again.hint("shuffle_hash"), "anchor").join(gone, "doc_id", "left").withColumn("part", touched)
                    .filter("not (part and line = last)").drop("gone", "line", "last"), "anchors")
    release(docs.sparkSession)
    whole = shared.filter("not part")
    firsts = stored(whole.groupBy("anchor", "alike").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.first("n").alias("n")), "firsts")
    several = stored(shared.groupBy("anchor").agg((F.max("part") | (F.min("alike") != F.max("alike"))).alias("open")).filter("open").select("anchor"), "several")
    release(docs.sparkSession)
    same = whole.join(firsts.drop("n"), ["anchor", "alike"]).filter(F.struct("doc_id", "place") != F.col("first")).select(
        "doc_id", "place", (F.col("place") + F.col("n") + (PASSAGE - 1)).alias("end"), F.col("first.doc_id").alias("class_doc_id"), F.col("first.place").alias("class_word"))

    unsure = firsts.join(several, "anchor", "left_semi").select("first.doc_id", "first.place", "n").unionByName(shared.filter("part").select("doc_id", "place", "n"))
    asked = unsure.groupBy("doc_id").agg(F.collect_set(F.struct("place", "n")).alias("open")).join(gone, "doc_id", "left")
    packed = rows.mapInArrow(_pack, "doc_id long, packed binary, raw long")
    stretches = stored(packed.join(asked, "doc_id").mapInArrow(_compare, "doc_id long, place int, own long"), "stretches")
    release(docs.sparkSession)
    earliest = stretches.groupBy("own").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    single = stretches.join(earliest, "own").filter(F.struct("doc_id", "place") != F.col("first")).select(
        "doc_id", "place", (F.col("place") + PASSAGE).alias("end"), F.col("first.doc_id").alias("class_doc_id"), F.col("first.place").alias("class_word"))

    order = Window.partitionBy("doc_id").orderBy("place", F.desc("end"), "class_doc_id", "class_word")
    pieces = same.unionByName(single).withColumn("ahead", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = pieces.withColumn("run", F.sum(F.coalesce((F.col("place") > F.col("ahead")).cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "run").agg(
        F.min("place").alias("first_word"), F.max("end").alias("end"),
        F.min(F.struct("place", "class_doc_id", "class_word")).alias("from")).select(
        "doc_id", F.col("first_word").cast("long").alias("first_word"), (F.col("end") - F.col("first_word")).cast("long").alias("n_words"),
        F.col("from.class_doc_id").alias("class_doc_id"), F.col("from.class_word").cast("long").alias("class_word"))


def repeats(docs: DataFrame, how: Banding = PARAGRAPHS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of `repeated_paragraphs`, and below them those of `repeated_passages` in what is left, all removed.

    Rows of paragraphs have no first_word, n_words and class_word, rows of passages no paragraph and class_paragraph.
    """
    lines = checkpointed(repeated_paragraphs(docs, how, least_words))
    release(docs.sparkSession)
    return lines.unionByName(repeated_passages(docs, lines.filter("removed")).withColumn("removed", F.lit(True)), allowMissingColumns=True)


def cut(text: str, gone: list[int], runs: list[tuple[int, int]]) -> str:
    """The text without the lines of `gone` and without runs of words (first, number); a line that loses its last word goes."""
    gone, out, at = set(gone), [], 0
    lost = {w for first, n in runs for w in range(first, first + n)}
    for k, line in enumerate(text.split("\n")):
        spans = [m.span() for m in re.finditer(WORD, line)]
        own = [at + j in lost for j in range(len(spans))]
        at += len(spans)
        if k in gone or spans and all(own):
            continue
        kept, start = [], 0
        for j, (s, e) in enumerate(spans):
            if own[j]:
                kept.append(line[start:s])
                start = spans[j + 1][0] if j + 1 < len(spans) else e
        out.append("".join([*kept, line[start:]]))
    return "\n".join(out)


def without_repeats(docs: DataFrame, how: Banding = PARAGRAPHS, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of `docs` without their removed paragraphs and passages; `n_chars` follows. Every row stays, if need be with an empty text."""
    gone = repeats(docs, how, least_words).filter("removed").groupBy(F.col("doc_id").alias("own_id")).agg(
        F.collect_set("paragraph").alias("gone"), F.collect_set(F.when(F.col("first_word").isNotNull(), F.struct("first_word", "n_words"))).alias("runs"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    @F.arrow_udf("string")
    def left(texts: pa.Array, lines: pa.Array, runs: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for r, (k, w) in enumerate(zip(lines.to_pylist(), runs.to_pylist())):
            if out[r] is not None and (k or w):
                out[r] = cut(out[r], k, [(p["first_word"], p["n_words"]) for p in w])
        return pa.array(out, pa.string())

    done = rows.join(gone, F.col("doc_id") == F.col("own_id"), "left").withColumn("text", left("text", "gone", "runs"))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    return done.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
