"""The manifest against a plain tree on lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF
from txrisk.llm import catalog, merkle
from txrisk.llm import text as T

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [*row[:4], text]
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(digests):
    """The root, and for each leaf the (left, right) siblings of its levels."""
    paths = [[] for _ in digests]
    nodes = [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for lo in range(0, len(nodes), 3):
            run = nodes[lo:lo + 3]
            for k, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1:])))
            above.append((sha(*[d for d, _ in run]), [i for _, b in run for i in b]))
        nodes = above
    return nodes[0][0], paths


def brute(rows):
    groups = {}
    for row in rows:
        text = row[4]
        if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        groups.setdefault(row[1], []).append((row[0], leaf(row, row[4]), leaf(row, text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, paths = {}, {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subs[name], paths[name] = tree([r[1] for r in groups[name]])
    if not names:
        return []
    root, tops = tree([subs[n] for n in names])
    out = []
    for name, top in zip(names, tops):
        for (doc, own, present), path in zip(groups[name], paths[name]):
            path = path + top
            folded = present
            for left, right in path:
                folded = sha(left, folded, right)
            out.append((doc, own, subs[name], root, sha(*[x for side in path for x in side]), folded, folded == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def random_rows(n, sources, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["a\nb", "plain", "", None, "é\n\n日"])) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28, 82, 244])
def test_sizes(spark, n):
    rows = random_rows(n, ["s"])
    assert got(merkle.tampered_manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    """Null sources and ids, repeated ids and rows, empty names, sources of any script, clashing columns."""
    rows = random_rows(120, [None, "", "a", "ab", "Z", "é", "日", "\U0001f600"], 3)
    rows += [rows[5], rows[5], (7, "a", "en", 1, "another text"), (None, "a", None, None, "x\n"), (None, None, None, None, None), (-3, "a", "en", 2, "neg\n")]
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA + ", pos int, path string, n int").repartition(7)
    assert got(merkle.tampered_manifest(docs)) == brute(rows)


def test_trees_of_several_rounds(spark, monkeypatch):
    """Blocks of nine leaves, so that the roots of blocks make rounds of their own, for documents and for sources."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = random_rows(260, ["hot"] * 30 + [f"s{i}" for i in range(25)], 5)
    assert got(merkle.tampered_manifest(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def test_integer_widths(spark):
    docs = spark.createDataFrame([(1, "s", "en", 2, "t")], "doc_id int, source string, lang string, n_chars int, text string")
    assert got(merkle.tampered_manifest(docs)) == brute([(1, "s", "en", 2, "t")])


def test_paths_prove_membership(spark):
    rows = random_rows(50, ["a", "b"], 7)
    docs = spark.createDataFrame(rows, SCHEMA)
    made = merkle.manifest(docs.select("doc_id", "source", merkle.leaf(docs).alias("leaf"), F.lit("kept").alias("note")))
    checked = made.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), "note").collect()
    assert all(r.ok and r.note == "kept" for r in checked) and len(checked) == 50
    wrong = made.select((merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert not any(r.ok for r in wrong)


def test_table(spark):
    rows = [tuple(r) for r in T.table(spark, SF, "documents").select(*merkle.FIELDS).collect()]
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    want = brute(rows)
    assert got(catalog.op13_merkle_manifest(spark, SF)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)
