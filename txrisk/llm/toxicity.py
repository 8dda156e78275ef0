"""Toxicity by non-negative positive-unlabelled learning on the words of whole texts.

Confirmed toxic documents are the positives; all other text of the learning part counts as unlabelled, whatever
it is. Document frequencies of the words that occur in the positives come from all of the learning part; the words
that set positives apart most become the features of a linear classifier. It is fitted in numpy, on samples whose
sizes are bounded by parameters, with the non-negative risk

    prior * E_P[loss(f, +1)] + max(0, E_U[loss(f, -1)] - prior * E_P[loss(f, -1)]).

Scores come from the words alone: labels, language, source and id are no inputs.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from txrisk.llm import text as T
from txrisk.session import checkpointed

U64 = np.uint64
#: A document is toxic from this score on.
THRESHOLD = 0.7


@dataclass
class ToxicityOptions:
    """Bounds of what is gathered for the fit; frequencies always come from all documents."""
    positives: int = 4096
    unlabelled: int = 16384
    candidates: int = 32768
    features: int = 2048
    least_positives: int = 2
    #: Words that may be expected among the features without being signs of positives (Chernoff's bound).
    chance_words: float = 0.2
    #: Toxic share among a feature's documents, at least.
    least_posterior: float = 0.5
    rounds: int = 1500
    rate: float = 0.05
    decay: float = 1e-6
    #: Share of the correction that is walked back while the unlabelled part of the risk is negative.
    gamma: float = 0.0


@dataclass
class Classifier:
    """Word hashes in ascending order, their weights, the intercept."""
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -2.0

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for lo, hi, data, off in T.runs(column):
            rows, cols = _features(*T.words(data, off), self.words)
            z = self.bias + np.bincount(rows, weights=self.weights[cols] if len(cols) else None, minlength=hi - lo)
            out[lo:hi] = 1 / (1 + np.exp(-z))
        return out


def _features(hashes: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each feature word that a row has, once per row."""
    if not len(words) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    hit = np.flatnonzero(words[at] == hashes)
    row = np.searchsorted(first, hit, "right") - 1
    pair = np.unique(row * len(words) + at[hit])
    return pair // len(words), pair % len(words)


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learnt from; a null id is not one of them, and teaches nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(ids: DataFrame, size: int) -> DataFrame:
    """At most `size` ids, those with the smallest hashes."""
    return checkpointed(ids.orderBy(F.xxhash64(F.lit("nnpu"), "doc_id"), "doc_id").limit(size)).select(F.col("doc_id").alias("own_id"))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct word hashes of each document."""
    for batch in T.slices(batches):
        for _, _, data, off in T.runs(batch.column("text")):
            h, first = T.words(data, off)
            own = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["word"])


def _frequencies(words: np.ndarray):
    """Documents of a task that have each of `words`; one row per word and task. -1 counts the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(len(words), np.int64), 0
        for batch in T.slices(batches):
            docs += batch.num_rows
            for _, _, data, off in T.runs(batch.column("text")):
                counts += np.bincount(_features(*T.words(data, off), words)[1], minlength=len(words))
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(counts[hit], docs))], names=["feature", "docs"])
    return run


def _examples(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            for lo, hi, data, off in T.runs(batch.column("text")):
                rows, cols = _features(*T.words(data, off), words)
                ends = np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("positive")[lo:hi], pa.ListArray.from_arrays(pa.array(ends), pa.array(cols.astype(np.int32)))], names=["positive", "features"])
    return run


def _loss_slope(z: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss of scores z for label y, and its derivative."""
    return np.logaddexp(0, -y * z), -y / (1 + np.exp(y * z))


def nnpu_fit(rows_p: list, rows_u: list, size: int, prior: float, opts: ToxicityOptions) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk, by Adam on full batches."""
    def matrix(rows):
        n = [len(r) for r in rows]
        return np.repeat(np.arange(len(rows)), n), (np.concatenate([np.asarray(r, np.int64) for r in rows]) if sum(n) else np.zeros(0, np.int64)), max(len(rows), 1)

    (rp, cp, np_), (ru, cu, nu) = matrix(rows_p), matrix(rows_u)
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, opts.rounds + 1):
        zp = w[-1] + np.bincount(rp, weights=w[cp], minlength=len(rows_p))
        zu = w[-1] + np.bincount(ru, weights=w[cu], minlength=len(rows_u))
        (_, up), (loss_pn, down), (loss_un, away) = _loss_slope(zp, 1), _loss_slope(zp, -1), _loss_slope(zu, -1)

        def gradient(dp, du):
            g = np.bincount(cp, weights=dp[rp], minlength=size) + np.bincount(cu, weights=du[ru], minlength=size)
            return np.append(g, dp.sum() + du.sum())

        if loss_un.mean() - prior * loss_pn.mean() >= 0:
            g = gradient(prior * (up - down) / np_, away / nu)
        else:
            g = gradient(prior * (up + opts.gamma * down) / np_, -opts.gamma * away / nu)
        g[:-1] += opts.decay * w[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= opts.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, opts: ToxicityOptions | None = None) -> Classifier:
    """Fit on the rows of `docs` that are not held out. Several labels of a document: toxic if one says so.

    Without toxic examples, or without a word that sets them apart, every text gets the same low score.
    """
    opts = opts or ToxicityOptions()
    rows = T.id_and_text(docs).filter("doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*"), F.sum("toxic")).first()
    if not counts[1]:
        return Classifier()
    prior = float(np.clip(counts[1] / counts[0], 0.001, 0.5))
    # both samples have a bounded number of ids, so they may be sent to every task
    toxic = F.broadcast(_sample(known.filter("toxic = 1").select("doc_id"), opts.positives))
    plain = F.broadcast(_sample(rows.select("doc_id"), opts.unlabelled))
    positives = checkpointed(rows.join(toxic, F.col("doc_id") == F.col("own_id"), "left_semi").dropDuplicates(["text"]))
    n_p = positives.count()
    by_count = positives.mapInArrow(_word_rows, "word long").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= opts.least_positives)
    found = by_count.orderBy(F.desc("n"), "word").limit(opts.candidates).collect()
    words = np.array([r.word for r in found], np.int64).view(U64)
    order = np.argsort(words)
    words, in_p = words[order], np.array([r.n for r in found], float)[order]
    if not len(words) or not n_p:
        return Classifier(bias=float(np.log(prior / (1 - prior))))
    seen = {r.feature: r.docs for r in rows.mapInArrow(_frequencies(words), "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).collect()}
    n_u, in_u = max(seen.get(-1, 0), 1), np.array([seen.get(k, 0) for k in range(len(words))], float)
    share, own = np.clip(n_p / n_u, 1e-9, 0.5), np.clip(in_p / np.maximum(in_u, in_p), 1e-9, 1 - 1e-9)
    evidence = np.maximum(in_u, in_p) * (own * np.log(own / share) + (1 - own) * np.log((1 - own) / (1 - share)))
    evidence[(own < share) | (prior * (in_p / n_p) < opts.least_posterior * np.maximum(in_u, in_p) / n_u)] = 0
    top = np.sort(np.argsort(-evidence, kind="stable")[:opts.features])
    words = words[top[evidence[top] >= np.log(len(words) / opts.chance_words)]]
    if not len(words):
        return Classifier(bias=float(np.log(prior / (1 - prior))))
    chosen = positives.withColumn("positive", F.lit(True)).unionByName(rows.join(plain, F.col("doc_id") == F.col("own_id"), "left_semi").withColumn("positive", F.lit(False)))
    examples = chosen.select("text", "positive").mapInArrow(_examples(words), "positive boolean, features array<int>").collect()
    weights, bias = nnpu_fit([r.features for r in examples if r.positive], [r.features for r in examples if not r.positive], len(words), prior, opts)
    return Classifier(words, weights, bias)


def score_column(model: Classifier, text: Column) -> Column:
    """Toxicity score of a text column."""
    sent = model

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(sent.scores(t))
    return score(text.cast("string"))


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document; null and empty texts are scored as texts without words."""
    rows = T.id_and_text(docs)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of `docs` that score below the threshold, all columns as they are."""
    own = "score of the row"
    while own in docs.columns:
        own += "_"
    return docs.withColumn(own, score_column(model, F.col("text"))).filter(F.col(f"`{own}`") < THRESHOLD).drop(own)
