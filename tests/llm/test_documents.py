"""Operators over documents against brute force, with odd rows."""

from collections import Counter
import hashlib
import math
import re
import zlib

import pytest

from llm.conftest import ODD
from txrisk.llm import contextmix, minhash, mixing, phrases, pii, substrings, toxicity
from txrisk.llm import text as T

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def small(spark):
    return T.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}


def components(sets, percent):
    """Smallest id that each id reaches over links of all pairs."""
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text, width):
    w = words(text)
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_word_hashes_are_words():
    import pyarrow as pa
    column = pa.array(["Aa  bb", None, "", "bb\taa\x0bcc", "x" * 5000 + " " + "X" * 5000, "é É"])
    got = []
    for lo, hi, data, off in T.runs(column, 7):
        h, first = T.words(data, off)
        got += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert [len(g) for g in got] == [2, 0, 0, 3, 2, 2]
    assert got[0][0] == got[3][1] and got[0][1] == got[3][0] and got[4][0] == got[4][1] and got[5][0] != got[5][1]


def test_near_duplicates_against_all_pairs(small, texts):
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    want = components(sets, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(small).collect()}
    assert got == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert {got[i][1] for i in (4, 5, 6, 7, 8)} == {4} and got[4][2] and not got[5][2]
    assert got[9][:2] == (1, 9) and got[10] == (1, 9, False) and got[12][1] == 11
    assert got[None][1:] == (None, True)
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns and {4, 9, 11} <= {r.doc_id for r in kept.collect()} and kept.filter("doc_id in (5, 10, 12)").count() == 0


def test_repeated_paragraphs_against_all_pairs(small, texts):
    sets = {(i, k): shingles(line, 5) for i, t in texts.items() for k, line in enumerate(t.split("\n")) if len(words(line)) >= 20}
    want = components(sets, 80)
    sizes = Counter(want.values())
    got = {(r.doc_id, r.paragraph): (r.class_doc_id, r.class_paragraph, r.removed) for r in substrings.repeated_paragraphs(small).collect()}
    assert got == {k: (*c, c != k) for k, c in want.items() if sizes[c] > 1}


def test_paragraphs_are_removed(odd, nothing):
    out = {r.doc_id: r.text for r in substrings.without_repeats(odd).collect()}
    assert out[4] == BASE_TEXT and out[5] == "" and out[6] == "" and out[1] is None and out[2] == ""
    assert substrings.repeated_paragraphs(nothing).count() == 0


BASE_TEXT = next(t for i, t, _ in ODD if i == 4)


def test_fingerprints(odd, nothing, small, texts):
    rows = {r.doc_id: r for r in phrases.document_fingerprints(small).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        after = texts[ids[(k + 1) % len(ids)]]
        half = len(texts[i]) // 2
        assert rows[i].edited_sha256 == hashlib.sha256((texts[i][:len(texts[i]) - half] + after[:half]).encode()).hexdigest()
        assert rows[i].n_chars == len(texts[i])
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in rows.values() if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next + 0.1 for r in long) >= 0.97 * len(long)
    got = phrases.document_fingerprints(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert phrases.document_fingerprints(nothing).count() == 0
    one = phrases.document_fingerprints(odd.filter("doc_id = 15")).first()
    assert (one.n_chars, one.near_next) == (3, 1.0)


def test_phrases_inside_a_text_do_not_depend_on_its_place():
    body = " ".join(f"token{i * i % 1009}" for i in range(3000))
    roots, bins = phrases.sketches([body, "something else before " + body, body[::-1]])
    assert phrases.likeness(roots[:1], bins[:1], roots[1:2], bins[1:2])[0] > 0.9
    assert phrases.likeness(roots[:1], bins[:1], roots[2:], bins[2:])[0] < 0.2
    assert phrases.sketches([body])[0][0] == phrases.sketches(["x" * 70000, "", body])[0][2]


def test_toxicity_of_planted_words(spark):
    docs = [(i, " ".join(["plain", f"word{i % 50}", f"more{i % 7}"] * 5 + (["vile", "nasty"] if i % 8 == 0 else []))) for i in range(1200)]
    labels = [(i, int(i % 8 == 0)) for i in range(0, 1200, 2)] + [(1, None), (None, 1)]
    docs = spark.createDataFrame(docs + [(None, "vile nasty"), (2000, None), (2001, "")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == 1203
    for r in rows:
        assert r.predicted == int(r.doc_id is None or (r.doc_id < 1200 and r.doc_id % 8 == 0)) and 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    kept = toxicity.without_toxic(docs.withColumnRenamed("text", "text"), model)
    assert kept.count() == 1200 - 150 + 2


def test_toxicity_without_examples(odd, nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    assert {r.predicted for r in toxicity.scored(odd, model).collect()} == {0}
    assert toxicity.scored(nothing, toxicity.learn(nothing, labels)).count() == 0


def test_non_negative_risk_separates():
    weights, bias = toxicity.nnpu_fit([[0], [0, 1]] * 50, [[0]] * 10 + [[1]] * 60 + [[]] * 30, 2, 0.1, toxicity.ToxicityOptions())
    assert bias < -1 and weights[0] + bias > 1 and weights[1] < weights[0] / 2


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if [True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 13 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15][kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    import random
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("a1234567890.@-+ ()%é\n25") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text)


def test_personal_data(odd, nothing, small, texts):
    for r in pii.personal_data(small).collect():
        spans = brute_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    rows = {r.doc_id: r for r in pii.personal_data(odd).collect()}
    assert (rows[13].n_email, rows[13].n_ip, rows[13].n_card, rows[13].n_phone) == (1, 1, 1, 1) and rows[1].spans == ""
    clean = {r.doc_id: r for r in pii.without_personal_data(odd).collect()}
    assert clean[13].text == "mail <EMAIL>, card <CARD> ip <IP> tel <PHONE>." and clean[13].n_chars == len(clean[13].text)
    assert clean[1].text is None and clean[4].text == BASE_TEXT
    assert pii.personal_data(nothing).count() == 0


def test_context_patterns_find_unseen_numbers(spark):
    seeds = ["4111111111111111", "4012888888881881", "5555555555554444", "5105105105105100", "378282246310005", "6011111111111117"]
    rows = [(i, f"some text{i} account number {n} was used") for i, n in enumerate(seeds)]
    rows += [(100, "your account number 1234567890123456 was used"), (101, "room 1234567890123456 here")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "card:20:36" and got[100].n_card == 0 and got[101].spans == ""


def test_mixture(small, texts, odd, nothing):
    rows = {r.doc_id: r for r in mixing.mixture(small).collect()}
    source = {r.doc_id: r.source for r in small.collect()}
    names = sorted(set(source.values()))
    size = {n: sum(len(words(texts[i])) for i in texts if source[i] == n) for n in names}
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(size.values()))
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > 3 * size[n]}
        if not over:
            target |= share
            break
        target |= {n: 3.0 * size[n] for n in over}
        left -= sum(3 * size[n] for n in over)
        open_ -= over
    for n in names:
        own = [rows[i] for i in rows if source[i] == n]
        assert own[0].target == pytest.approx(target[n]) and abs(sum(r.taken for r in own) - target[n]) <= 0.5
        assert all(r.taken <= 3 * r.size and r.size == len(words(texts[r.doc_id])) and r.source_size == size[n] for r in own)
    assert len(mixing.mixture(odd).collect()) == len(ODD) and mixing.mixture(nothing).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert sum(len(words(r.text)) for r in out.collect()) == pytest.approx(sum(r.taken for r in mixing.mixture(odd).collect()), abs=60)
    assert mixing.mixed(nothing).count() == 0


def test_context_mixing(small, texts, odd, nothing):
    rows = {r.doc_id: r for r in contextmix.scored(small).collect()}
    c = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(words(t))
            c[None] += 1
    total, kinds = sum(c.values()), len(c)
    for i, t in texts.items():
        tokens = [*words(t), None]
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in c for w in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    got = contextmix.scored(odd).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert contextmix.scored(nothing).count() == 0
    unseen = contextmix.scored(odd.filter("doc_id is null")).first()
    assert (unseen.train_tokens, unseen.n_known, unseen.base_score) == (0, 0, 0.0)
