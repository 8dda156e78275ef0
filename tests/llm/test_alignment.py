"""Two tokenizers' alignment against plain loops over the tokens of two independent encoders."""

from collections import Counter, defaultdict
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF
from txrisk.llm import alignment, catalog
from txrisk.llm import text as T

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    first = Tokenizer.from_file(alignment.BYTE_MODEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
    letters = alignment._byte_letters()

    def spans(ids, pieces):
        ends = np.cumsum([len(p) for p in pieces]).tolist()
        return list(zip(ids, [0, *ends[:-1]], ends))

    found, held = [], Counter()
    for doc, text in rows:
        a = b = []
        if text:
            ids = first.encode(" " + text, add_special_tokens=False).ids
            pieces = [bytes(letters[c] for c in first.id_to_token(i)) for i in ids]
            ids_b = second.encode(text)
            pieces_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in zip(ids_b, map(second.id_to_piece, ids_b))]
            if b"".join(pieces) == b"".join(pieces_b) == (" " + text).encode():
                a, b = spans(ids, pieces), spans(ids_b, pieces_b)
        links, from_ = [], 0
        for i, s, e in a:
            while b[from_][2] <= s:
                from_ += 1
            j = from_
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        groups = []
        lo = 0
        for cut in sorted({e for _, _, e in a} & {e for _, _, e in b}):
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s < cut) for side in (a, b)))
            lo = cut
        found.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
        held.update(set(links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return sorted(((doc, na, nb, ng, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else "") for doc, na, nb, ng, links, text in found), key=str)


def got(df):
    return sorted((tuple(r) for r in df.withColumnRenamed("groups", "groups_sha256").select(*COLUMNS).collect()), key=str)


ODD = ["", None, " ", "\n\n", "a", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁odd▁mark", "tab\there", "  two  spaces ", "é é",
       "\U0001f600\U0001f600 smile", "\x00\x01", "﻿bom", "x" * 3000, "1234567890" * 50, "café naïve 日本語 русский", " lead",
       " nbsp　wide", "don't we'll I'VE", "\r\n\r\n", "​zero"]


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(4, "a"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, part long, groups string")
    want = brute(rows)
    assert got(alignment.aligned_tokens(docs, digest=True)) == want
    assert sum(r[1] > 0 for r in want) >= 14
    assert got(alignment.aligned_tokens(docs.repartition(9), digest=True)) == want


def test_query_over_the_small_table(spark):
    docs = T.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(catalog.op11_token_alignment(spark, SF)) == brute(rows)


def test_groups_are_written_out(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.aligned_tokens(docs).collect()}
    assert rows[1].groups.count(";") == rows[1].n_groups - 1 and rows[1].groups.count("|") == rows[1].n_groups
    assert (rows[2].groups, rows[2].n_links) == ("", 0)


def test_no_rows(spark):
    assert alignment.aligned_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_change_nothing(spark, monkeypatch):
    """Documents over parts of their own, among them one longer than a part."""
    docs = T.table(spark, SF, "documents").limit(40)
    want = got(alignment.aligned_tokens(docs, digest=True))
    assert want == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(alignment.aligned_tokens(docs.repartition(40), digest=True)) == want


def test_links_follow_from_tokens_and_groups(spark):
    for r in catalog.op11_token_alignment(spark, SF).collect():
        assert r.n_links == r.n_a + r.n_b - r.n_groups


@pytest.mark.parametrize("seed", range(6))
def test_galloping_finds_every_rank(seed):
    rng = random.Random(seed)
    longer = np.array(sorted(rng.sample(range(5000), rng.choice([0, 1, 7, 300, 4000]))), np.int64)
    shorter = np.array(sorted(rng.sample(range(5000), rng.choice([0, 1, 2, 63, 64, 65, 500]))), np.int64)
    assert alignment.gallop(shorter, longer).tolist() == np.searchsorted(longer, shorter).tolist()


def test_tokenizer_is_the_named_one():
    """The pair merges give the same ids as the vocabulary file's own library."""
    model = alignment.ByteTokens(alignment.BYTE_MODEL)
    own = Tokenizer.from_file(alignment.BYTE_MODEL)
    own.encode_special_tokens = True
    texts = [t for t in ODD if t]
    assert [x.tolist() for x in model.encode(texts)] == [own.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_skewed_pairs(spark):
    """One text in a third of all documents."""
    rows = [(i, "same text here") for i in range(40)] + [(i, f"text number {i} is here") for i in range(40, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(alignment.aligned_tokens(docs, digest=True)) == brute(rows)
    _, counts = alignment.pair_counts(docs)
    assert counts.agg(F.max("count")).first()[0] == 120
