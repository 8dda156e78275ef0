import pytest

from txrisk.llm import substrings
from txrisk.llm import text as T

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"long{i}" for i in range(60))


def words(text):
    return (text or "").encode().lower().split()


def brute(texts, gone=()):
    """Places of words in stretches of 51 that an earlier place has, no line of `gone` being part of one."""
    seen, out = set(), set()
    for i in sorted(texts):
        own = [(w, (i, k) in gone) for k, line in enumerate((texts[i] or "").split("\n")) for w in words(line)]
        for p in range(len(own) - 50):
            stretch = own[p:p + 51]
            if any(g for _, g in stretch):
                continue
            key = tuple(w for w, _ in stretch)
            if key in seen:
                out |= {(i, p + k) for k in range(51)}
            seen.add(key)
    return out


def covered(rows):
    return {(r.doc_id, r.first_word + k) for r in rows for k in range(r.n_words)}


@pytest.fixture(scope="module")
def planted(spark):
    """A passage inside long lines, over short lines broken elsewhere, twice in one text, in odd case; 50 words do not count."""
    def fill(tag, n):
        return " ".join(f"{tag}{j}" for j in range(n))
    lines = "\n".join(" ".join(PASSAGE.split()[k:k + 7]) for k in range(0, 60, 7))
    rows = [(1, f"{fill('a', 80)} {PASSAGE} {fill('b', 90)}"), (2, f"{fill('c', 100)} {PASSAGE.upper()} {fill('d', 70)}"), (3, f"head line\n{lines}\ntail line"),
            (4, f"{fill('e', 30)} {' '.join(PASSAGE.split()[5:55])} {fill('f', 30)}"), (5, f"{fill('g', 60)} x {fill('g', 60)}"), (6, None), (7, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_passages_inside_lines_and_across_them(planted):
    got = {(r.doc_id, r.first_word, r.n_words, r.class_doc_id, r.class_word) for r in substrings.repeats(planted).collect() if r.removed}
    assert got == {(2, 100, 60, 1, 80), (3, 2, 60, 1, 80), (5, 61, 60, 5, 0)}
    out = {r.doc_id: r.text for r in substrings.without_repeats(planted).collect()}
    assert out[3] == "head line\ntail line" and out[2].split()[99:101] == ["c99", "d0"] and out[5].endswith("g59 x ") and out[6] is None and out[7] == ""
    assert PASSAGE in out[1] and len(out[4].split()) == 110


def test_passages_against_brute_force(spark):
    docs = T.table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute(texts)
    assert want and covered(substrings.repeated_passages(docs).collect()) == want
    rows = substrings.repeats(docs).collect()
    gone = {(r.doc_id, r.paragraph) for r in rows if r.removed and r.paragraph is not None}
    assert covered([r for r in rows if r.paragraph is None]) == brute(texts, gone)
