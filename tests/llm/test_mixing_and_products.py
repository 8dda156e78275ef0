"""Rows that share an id in the mix, and exact products by blocks, against plain lists and SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import connect
from txrisk.llm import catalog, mixing, topk

DOCS = "doc_id long, source string, text string, n_chars long, cut string"


def words(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def sql(rows):
    con = connect("/root/testdata/sf0.001")
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM (VALUES " + ", ".join(
        f"({'NULL' if d is None else d}::BIGINT, {'NULL' if s is None else repr(s)}::VARCHAR, {'NULL' if t is None else repr(t)}::VARCHAR)"
        for d, s, t in rows) + ") t(doc_id, source, text)")
    got = con.execute(catalog.SQL["op6_mix_sources"]).fetchall()
    names = [c[0] for c in con.description]
    return sorted((tuple(r[names.index(c)] for c in ("doc_id", "size", "source_size", "target", "taken")) for r in got), key=str)


@pytest.mark.parametrize("ids", [1, 3, 200])
def test_ids_repeat_with_other_sizes(spark, ids):
    rows = [(i % ids, f"s{i % 4}", words(2 + (i * 7) % 40, f"t{i % 5}_")) for i in range(120)] + [(None, None, "a b c")] * 4 + [(7, "s1", None), (7, "s1", "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(5)
    got = mixing.mixture(docs)
    assert all(r.taken <= 3 * r.size for r in got.collect())
    for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert r.taken == int(r.target + 0.5) or r.source_size == 0
    assert sorted((tuple(r) for r in got.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str) == sql(rows)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    total = sum(len((r.text or "").split()) for r in mixed.collect())
    assert total == got.agg(F.sum("taken")).first()[0]


def test_equal_rows_at_the_cut(spark):
    """One text many times under one id: the last copy is cut, the ones before are whole."""
    rows = [(1, "a", words(10))] * 30 + [(2, "b", words(3))] * 400
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(3)
    got = sorted((tuple(r) for r in mixing.mixture(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    assert got == sql(rows)
    assert len({r[-1] % 10 for r in got if r[0] == 1}) <= 2


def brute(rows, every=50, k=5):
    ok = [(i, [int(x) for x in np.floor(256 * np.array(v, float))]) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        found = sorted((-sum(x * y for x, y in zip(a, b)), j) for i, a in ok if i == q for j, b in ok if j != q and len(a) == len(b))[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return out


def products(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, size int, bucket string").repartition(4)
    return sorted(tuple(r) for r in topk.top_products(df).collect())


@pytest.mark.parametrize("block", [(64, 8), (8192, 1024)])
def test_products_in_blocks(spark, monkeypatch, block):
    """Clusters, few lengths, repeated rows, ties, several sizes, in blocks that are small and that hold all."""
    monkeypatch.setattr(topk, "BLOCK", block[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", block[1])
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 4
    rows = [(int(i), [float(x) for x in centres[i % 6] + rng.normal(size=8) * (0.1 if i % 2 else 1)]) for i in range(700)]
    rows += [rows[50], rows[50], rows[3], rows[3], (900, rows[7][1]), (901, rows[7][1]), (950, [0.0] * 8), (1000, [1.0, 2.0]), (1001, [1.0, 3.0]), (1050, []), (1051, [])]
    assert products(spark, rows) == brute(rows)


def test_few_vectors(spark):
    assert products(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert products(spark, [(0, [1.0])]) == []


def test_large_components(spark):
    """Products beyond 53 bits are exact, those beyond 64 an error."""
    rows = [(0, [3e6, 1.0, -2e5]), (1, [5e6, 7.0, 1e5]), (2, [5e6, 7.00390625, 1e5]), (3, [-5e6, 7.0, 1e5]), (4, [1.0, 1.0, 1.0])]
    assert products(spark, rows) == brute(rows)
    for wide in ([1e9, 0.0, 0.0], [1e300, 0.0, 0.0]):
        with pytest.raises(Exception, match="64 bits"):
            products(spark, [(0, wide), (1, wide)])


def test_blocks_of_queries_lose_nothing():
    rng = np.random.default_rng(4)
    for turn in range(150):
        d, n, m = int(rng.integers(1, 6)), int(rng.integers(1, 80)), int(rng.integers(1, 9))
        rows = np.floor(rng.normal(size=(n, d)) * rng.choice([3, 300]) + rng.choice([0, 200])).astype(np.int64)
        rows = rows[np.argsort(-np.sqrt((rows.astype(float) ** 2).sum(1)), kind="stable")]
        queries = np.floor(rng.normal(size=(m, d)) * 50).astype(np.int64)
        ids, q_ids = rng.permutation(n), np.arange(m) - m
        scores = queries @ rows.T
        bounds = np.where(rng.random(m) < 0.2, -np.inf, np.sort(scores, 1)[:, ::-1][:, min(n - 1, 4)]).astype(float)
        got = [np.concatenate(x) if x else np.zeros(0) for x in ([], [], [])]
        found = list(topk.best_of_blocks(q_ids, queries, bounds, ids, rows, 5))
        if found:
            got = [np.concatenate(x) for x in zip(*found)]
        want = set()
        for i in range(m):
            at = np.flatnonzero(scores[i] >= bounds[i])
            for j in at[np.lexsort((ids[at], -scores[i][at]))[:5]]:
                want.add((q_ids[i], ids[j], scores[i][j]))
        assert {tuple(x) for x in zip(*got)} == want
