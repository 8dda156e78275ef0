"""Repeated lines against plain dictionaries, whatever the batches, runs and merges."""

from collections import defaultdict
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from oracle import connect
from txrisk.llm import catalog, lines
from txrisk.llm import text as T

SPACES = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows, least=3):
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 20:
                held[key_of(line)].add(lines.NO_ID if doc is None else doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        me = lines.NO_ID if doc is None else doc
        kept = [x for x in own if len(held[key_of(x)]) < least or me == max(held[key_of(x)])]
        out.append((doc, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


A, B, C = "A line that is shared by MANY", "another line of more than twenty", "é" * 20
ODD = [
    (1, f"{A}\n{B}"), (2, f"  {A.lower()}\t\n{C}"), (3, f"{A}\r\n{A}\nonly here but long enough"), (4, A.upper()), (5, None), (6, ""), (7, "\n\n"),
    (8, f"{C}\n{C.upper()}"), (9, C), (10, C + "x"), (11, "é" * 19), (12, "é" * 19), (13, "é" * 19), (14, f"{B}\n\n{B}"), (15, f"\x0b{B}\x0c"),
    (15, f"{B} \nrepeated row id with another text"), (16, " " + A), (17, "x" * 30000), (18, "x" * 30000), (19, "x" * 30000),
    (None, A), (None, "a row without id, once more long"), (-5, A), (20, "nul\x00 inside a long enough line"), (21, "nul\x00 inside a long enough line"),
    (22, "NUL\x00 inside a long enough line"),
]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_odd_lines(spark, batches):
    docs = spark.createDataFrame([(*r, "k", 1) for r in ODD], "doc_id long, text string, key string, doc int")
    assert got(lines.without_repeated_lines(docs, batches)) == brute(ODD)


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    pool = [f"line number {i} of a pool of some lines" for i in range(12)]
    rows = [(rng.randint(0, 60), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(lines.without_repeated_lines(docs, 4)) == brute(rows)
    assert got(lines.without_repeated_lines(docs, 7, least=2)) == brute(rows, 2)


def test_no_rows(spark):
    assert lines.without_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert got(lines.without_repeated_lines(nulls)) == [(None, "", 1, 0)] * 3


def test_runs_come_in_any_order(spark):
    """Batches of documents in ascending, descending and mixed order end in the same repeated keys."""
    rng = random.Random(9)
    pairs = {(rng.randint(0, 40), rng.randint(0, 14)) for _ in range(150)}
    want = {}
    for k in range(15):
        docs = [d for d, key in pairs if key == k]
        if len(docs) >= 3:
            want[bytes([k])] = max(docs)
    for order in (sorted, lambda x: sorted(x, reverse=True), lambda x: rng.sample(sorted(x), len(x))):
        runs = lines.SortedRuns(spark, fan=3)
        ids = list(order({d for d, _ in pairs}))
        for i in range(0, len(ids), 6):
            own = [(d, bytes([k])) for d, k in pairs if d in ids[i:i + 6]]
            runs.add(lines._counted(spark.createDataFrame(own, "doc long, key binary")))
            assert all(len(level) < 3 for level in runs.levels)
        assert {bytes(r.key): r.largest for r in runs.repeated().collect()} == want
        assert len(runs.levels) >= 2


def test_settled_keys_add_nothing(spark):
    """A key known in three documents above a batch's own is not written again; a new one is."""
    runs = lines.SortedRuns(spark)
    runs.add(spark.createDataFrame([(b"k", 3, 9, False)], "key binary, docs long, largest long, hot boolean"))
    batch = spark.createDataFrame([(b"k", 5, 8, False), (b"n", 1, 8, False)], "key binary, docs long, largest long, hot boolean")
    assert [bytes(r.key) for r in runs.unsettled(batch).collect()] == [b"n"]
    above = spark.createDataFrame([(b"k", 5, 10, False)], "key binary, docs long, largest long, hot boolean")
    assert runs.unsettled(above).count() == 1


def test_merges_do_not_shuffle(spark):
    runs = lines.SortedRuns(spark)
    for i in range(3):
        runs.add(spark.createDataFrame([(bytes([i, j]), 1, 10 * i + j, False) for j in range(5)], "key binary, docs long, largest long, hot boolean"))
    merged = runs._merged(runs.runs())
    assert merged.count() == 15
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in runs._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_lines(spark):
    """One line in every document."""
    rows = [(i, f"{A}\nown line of document number {i}\n{B if i % 2 else C}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(lines.without_repeated_lines(docs)) == brute(rows)


def test_query_and_its_sql(spark):
    """Rows of odd lines through the SQL as well."""
    con = connect(SF)
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM (VALUES " + ", ".join(
        f"({'NULL' if d is None else d}::BIGINT, {'NULL' if t is None else chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39)})"
        for d, t in ODD if t is None or "\x00" not in t) + ") t(doc_id, text)")
    rows = [(d, t) for d, t in ODD if t is None or "\x00" not in t]
    want = sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, k in brute(rows)), key=str)
    found = con.execute(catalog.SQL["op12_line_dedup"]).fetchall()
    names = [c[0] for c in con.description]
    sql = sorted((tuple(r[names.index(c)] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in found), key=str)
    assert sql == want


def test_table(spark):
    docs = T.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, k in brute(rows)]
    assert sorted((tuple(r) for r in catalog.op12_line_dedup(spark, SF).collect()), key=str) == sorted(want, key=str)
    assert catalog.op12_line_dedup(spark, SF).agg(F.sum("n_dropped")).first()[0] > 0
