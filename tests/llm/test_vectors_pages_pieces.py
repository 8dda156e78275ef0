"""Top-k products, URL filter, pieces, pipeline and the registered queries."""

import math

import numpy as np
import pytest

from llm.conftest import ODD
from txrisk.llm import catalog, pieces, topk, urls
from txrisk.llm import text as T

SF = "/root/testdata/sf0.001"


def test_top_products(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (5 if i % 9 == 0 else 1)]) for i in range(400)]
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [inf] * 6), (550, [nan] * 6), (None, [9.0] * 6), (1000, rows[3][1]), (1001, rows[3][1]), (600, [0.0] * 6), (650, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ok = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, a in ok:
        if q % 50 == 0:
            found = sorted(((int(-(a @ b)), i) for i, b in ok if i != q and len(a) == len(b)))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    got = [tuple(r) for r in topk.top_products(df).orderBy("query_id", "rank").collect()]
    assert got == sorted(want)
    assert topk.top_products(df.filter("vec_id is null")).count() == 0


def test_pruning_loses_nothing():
    rng = np.random.default_rng(1)
    for turn in range(400):
        d, n = int(rng.integers(1, 6)), int(rng.integers(1, 60))
        rows = np.floor(rng.normal(size=(n, d)) * rng.choice([3, 300])).astype(np.int64)
        query = np.floor(rng.normal(size=d) * 50).astype(np.int64)
        rows = rows[np.argsort(-np.sqrt((rows.astype(float) ** 2).sum(1)), kind="stable")]
        ids, scores = rng.permutation(n), rows @ query
        bound = float(np.sort(scores)[::-1][min(n - 1, 4)])
        found, own = topk.best_of_block(query, -1, bound, ids, rows, rows.astype(float), np.sqrt((rows.astype(float) ** 2).sum(1)), 5)
        at = np.flatnonzero(scores >= bound)
        best = at[np.lexsort((ids[at], -scores[at]))[:5]]
        assert found.tolist() == ids[best].tolist() and own.tolist() == scores[best].tolist()


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?y#z"), (4, "http://example.net"), (5, "http://x.example.com/de/1"), (6, "https://www.b.org/fr/"),
            (7, "http://notnet/"), (8, "http://cheap-pills.example.org/en/1"), (9, "http://library.example.org/en/12"), (10, "x://h?q/p"), (11, "http://a.net/EN/"), (12, "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1][:3] == ("", "", None) and got[2][:3] == ("", "", None) and got[12][:3] == ("", "", None)
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4][:3] == ("example.net", "", None)
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow") and got[7][2] is None
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow") and got[10][:2] == ("h", "") and got[11][2:] == ("net/", "block")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(pieces.read_model())


TEXTS = ["", " ", "  a  b ", "▁▁x", "日本語\x00\n\n", "a▁b", "😀é" * 5, "x" * 300, " " * 50, "The quick brown fox.\nAnd so on, antidisestablishmentarianism!"]


def best_weight(v, text):
    """Greatest weight of a segmentation, by the plain recursion over all pieces."""
    codes = v.chars[[ord(c) for c in " " + text]] if text else []
    table = {}
    for n, b in enumerate(v.bytes):
        if v.weights[n]:
            table[b.decode()] = int(v.weights[n])
    s, best = " " + text if text else "", [0]
    for end in range(1, len(s) + 1):
        last = s[end - 1]
        own = [best[end - 1] + (int(v.fallback) if codes[end - 1] == v.unknown else -10**18)]
        own += [best[start] + table[s[start:end]] for start in range(max(0, end - v.longest), end) if s[start:end] in table and "▁" not in s[start:end]]
        best.append(max(own))
    return best[-1]


def test_pieces_are_best_and_decode(vocabulary):
    v = vocabulary
    ids, off = pieces.encode_texts(v, TEXTS)
    for k, t in enumerate(TEXTS):
        own = ids[off[k]:off[k + 1]]
        assert pieces.decode_ids(v, own) == t
        if all(c in " " or v.chars[ord(c)] != v.unknown for c in t):
            assert int(v.weights[own].sum()) == best_weight(v, t)


def test_chunks_give_the_best_segmentation(spark, vocabulary):
    texts = [t * 40 for t in TEXTS] + ["dup " * 300] * 2
    docs = spark.createDataFrame([(i % 11, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    got = pieces.encode(docs, chunk=37).collect()
    assert len(got) == len(texts) + 1 and all(r.round_trip for r in got)
    weight = lambda ids: int(vocabulary.weights[np.array(ids, np.int64)].sum()) if ids else 0
    ids, off = pieces.encode_texts(vocabulary, texts)
    want = sorted([weight(ids[a:b].tolist()) for a, b in zip(off[:-1], off[1:])] + [0])
    assert sorted(weight(r.ids) for r in got) == want
    back = pieces.decode(spark.createDataFrame(got)).collect()
    assert sorted(r.text for r in back) == sorted([*texts, ""])


def test_transfer_matrices_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-50, 0, (4, 4)).astype(np.int64) for _ in range(3))
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


def test_pieces_of_odd_rows(odd, nothing):
    rows = pieces.encode(odd).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows) and pieces.encode(nothing).count() == 0


def test_queries_run(spark):
    for name, query in catalog.QUERIES.items():
        table = "pages" if name.startswith("op7") else "documents"
        if name.startswith(("op2_", "op5_")):
            assert query(spark, SF).count() > 0
        else:
            assert query(spark, SF).count() == T.table(spark, SF, table).count(), name


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = T.table(spark, SF, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        if name != "pieces":
            assert after.columns == docs.columns
            if name in ("toxicity", "near_copies"):
                assert after.exceptAll(before).count() == 0 and 0.8 * before.count() <= after.count()
            if name == "personal_data":
                assert after.count() == before.count()
        before = after
    assert before.filter("not round_trip").count() == 0 and math.isclose(before.count(), docs.count(), rel_tol=0.5)
