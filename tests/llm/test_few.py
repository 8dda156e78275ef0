"""Steps of near copies and passages that work on many rows at once give what one row at a time gives."""

import re

import numpy as np
import pyarrow as pa
import pytest

from txrisk.llm import near, substrings
from txrisk.llm import text as T


def test_links_within_few_rows():
    """Pairs that join components are the same by pairs of many buckets and by blocks; pairs are looked up in several parts."""
    how, rng = substrings.PARAGRAPHS, np.random.default_rng(5)
    rows, size = [], []
    for _ in range(400):
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        size.append(int(rng.integers(2, near.FEW + 1)))
        rows += [np.unique(np.concatenate((base[:int(rng.integers(40, 61))], rng.integers(0, 1 << 40, int(rng.integers(0, 12))).astype(np.uint64)))) for _ in range(size[-1])]
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    sets, comp, size = np.concatenate(rows), np.arange(len(rows)), np.array(size)
    first = np.cumsum(size) - size
    comp[first[::3] + 1] = comp[first[::3]]

    def joined(links):
        forest = near._Forest()
        for a, b in links:
            forest.join(int(comp[a]), int(comp[b]))
        return [forest.root(int(c)) for c in comp]

    blocks = [p for f, n in zip(first, size) for p in near._joining(how, comp, sets, ends, np.arange(f, f + n), np.arange(f, f + n))]
    few = near._joining_few(how, comp, sets, ends, first, size)
    assert few and joined(few) == joined(blocks) and len(set(joined(few))) > len(size)
    i, j = np.repeat(np.arange(40), 40), np.tile(np.arange(40), 40)
    want = [near.linked(len(np.intersect1d(rows[a], rows[b])), len(rows[a]), len(rows[b]), how.percent) for a, b in zip(i, j)]
    assert near._linked_pairs(how, sets, ends, i, j).tolist() == want


def test_rows_are_sorted_whatever_their_ties():
    rng = np.random.default_rng(6)
    for top, counts in ((1 << 63, [3, 0, 700, 1]), (1 << 17, [50] * 40), (3, [5, 0, 9]), (1 << 63, [5000, 2])):
        counts = np.array(counts)
        values = rng.integers(0, top, counts.sum()).astype(np.uint64)
        row = np.repeat(np.arange(len(counts)), counts)
        assert (T.sorted_rows(values, row, counts) == values[np.lexsort((values, row))]).all()


@pytest.mark.parametrize("least", [1, 2, 20])
def test_paragraphs_have_enough_words(spark, least):
    texts = ["", " ", "a", " a ", "a b", "\ta  b\x0b", " ".join("w" * 19), " ".join("w" * 20), "\x0c " + "\r ".join("é" * 20) + " ", "x y " * 10, "x y " * 20]
    docs = spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")
    got = [r.id & ((1 << substrings.PLACE_BITS) - 1) for r in substrings.paragraphs(docs, least).collect()]
    assert got == [k for k, t in enumerate(texts) if len(re.findall(substrings.WORD, t)) >= least]


def test_listed_anchors_are_those_found():
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, n)) for n in (0, 50, 51, 52, 400, 3000, 20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    listed = {a: n for b in substrings._list_anchors(iter([batch])) for a, n in zip(b["anchor"].to_pylist(), b["n"].to_pylist())}
    found = np.concatenate([b["anchor"].to_numpy() for b in substrings._find_anchors(iter([batch]))])
    assert listed == dict(zip(*(x.tolist() for x in np.unique(found, return_counts=True))))
