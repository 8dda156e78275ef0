"""Two tokenizers' tokens of the same text, aligned by their byte ranges.

Token ends of a document are two ascending lists. Each value of the shorter list looks for its place in the longer one by
galloping: hops that double from a place known to lie before it, then a binary search in the last hop. Ends that both lists
hold cut the tokens into groups; the difference of two neighbouring ranks is the range of tokens that overlap.
"""

from collections.abc import Iterator
import functools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from txrisk.llm import text as T
from txrisk.llm.stages import stored
from txrisk.session import checkpointed

#: Where the public vocabulary files lie; both paths are parameters.
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that one task aligns at once; a longer document is a part of its own.
PART_BYTES = 1 << 22


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from
    U+0100 on in ascending order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class ByteTokens:
    """Tokenizer A: byte-level pair merges, with the bytes of each id. Strings of special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        special = {t["id"] for t in model.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token
        self._encoding = tiktoken.Encoding("byte tokens", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encoding.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64) for text in texts]


class PieceTokens:
    """Tokenizer B: pieces, where U+2581 stands for a space and <0xHH> for a byte; it puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode()
                      for i in range(self.size) for p in [self._model.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self._model.encode(texts, num_threads=1)]


@functools.lru_cache(4)
def _tokenizers(byte_model: str, piece_model: str) -> tuple[ByteTokens, PieceTokens, np.ndarray, np.ndarray, list[bytes]]:
    a, b = ByteTokens(byte_model), PieceTokens(piece_model)
    names = [b"%d%s" % (i, end) for i in range(a.size) for end in (b",", b"|")]
    names += [b"%d%s" % (i, end) for i in range(b.size) for end in (b",", b";")]
    return a, b, np.array([len(x) for x in a.bytes]), np.array([len(x) for x in b.bytes]), names


def _place(values: np.ndarray, longer: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many of `longer` (with a last entry above all values) lie below each value; at least `start` do."""
    lo, hi = start.copy(), start.copy()
    last, hop = len(longer) - 1, 1
    open_ = np.arange(len(values))
    while len(open_):
        open_ = open_[longer[np.minimum(hi[open_], last)] < values[open_]]
        lo[open_] = hi[open_] + 1
        hi[open_] += hop
        hop *= 2
    hi = np.minimum(hi, last)
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        middle = (lo[open_] + hi[open_]) >> 1
        below = longer[middle] < values[open_]
        lo[open_[below]] = middle[below] + 1
        hi[open_[~below]] = middle[~below]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def gallop(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """The rank of each value of an ascending list in another one: how many entries there lie below it.

    Values are placed in strides that halve: each starts from the rank of the value one stride before it.
    """
    ranks = np.zeros(len(shorter), np.int64)
    padded = np.append(longer, np.iinfo(np.int64).max)
    stride = 1 << max(0, len(shorter) - 1).bit_length()
    ranks[:1] = _place(shorter[:1], padded, np.zeros(min(1, len(shorter)), np.int64))
    while stride > 1:
        half = stride >> 1
        at = np.arange(half, len(shorter), stride)
        ranks[at] = _place(shorter[at], padded, ranks[at - half])
        stride = half
    return ranks


def overlaps(shorter: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the token ends of two cuts of the same bytes: the places in both lists of the ends they share, the first token
    of the longer list that overlaps each one of the shorter, and how many do."""
    ranks = gallop(shorter, longer)
    shared = longer[np.minimum(ranks, len(longer) - 1)] == shorter if len(longer) else np.zeros(len(shorter), bool)
    first = np.concatenate(([0], ranks + shared))[:-1]
    return np.flatnonzero(shared), ranks[shared], first, ranks - first + 1


def _aligned(texts: list[str | None], models: tuple) -> dict:
    """The alignment of some documents: counts per document, the text of its groups, and its linked id pairs."""
    a, b, size_a, size_b, names = models
    clean = [text or "" for text in texts]
    pairs = []
    for text, own_a, own_b in zip(clean, a.encode(clean), b.encode(clean)):
        want = b" " + text.encode()
        same = text != "" and all(b"".join(map(m.bytes.__getitem__, own.tolist())) == want for m, own in ((a, own_a), (b, own_b)))
        pairs.append((own_a, own_b) if same else (own_a[:0], own_b[:0]))
    n = len(texts)
    n_a, n_b = (np.array([len(p[side]) for p in pairs], np.int64) for side in (0, 1))
    ids_a, ids_b = (np.concatenate([p[side] for p in pairs]).astype(np.int64) if n else np.zeros(0, np.int64) for side in (0, 1))
    # ends count on over the documents, so that one search serves all of them; each one's own list drives where it is shorter
    ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    links = []
    a_drives = n_a <= n_b
    for drives in (True, False):
        at_a, at_b = np.flatnonzero(a_drives[doc_a] == drives), np.flatnonzero(a_drives[doc_b] == drives)
        own, other = (at_a, at_b) if drives else (at_b, at_a)
        ends, others = (ends_a[at_a], ends_b[at_b]) if drives else (ends_b[at_b], ends_a[at_a])
        here, there, first, count = overlaps(ends, others)
        (last_a if drives else last_b)[own[here]] = True
        (last_b if drives else last_a)[other[there]] = True
        from_ = np.repeat(own, count)
        to = other[np.arange(len(from_)) - np.repeat(np.cumsum(count) - count - first, count)] if len(from_) else from_
        links.append((from_, to) if drives else (to, from_))
    link_a, link_b = (np.concatenate([pair[side] for pair in links]) for side in (0, 1))
    pair_of = (doc_a[link_a] * a.size + ids_a[link_a]) * b.size + ids_b[link_b]
    own_pairs, times = np.unique(pair_of, return_counts=True)
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_a[last_a], minlength=n), "n_links": np.bincount(doc_a[link_a], minlength=n),
            "groups": _written(ids_a, ids_b, last_a, last_b, n_a, n_b, 2 * a.size, names),
            "doc": own_pairs // (a.size * b.size), "pair": own_pairs % (a.size * b.size), "times": times}


def _written(ids_a, ids_b, last_a, last_b, n_a, n_b, after_a: int, names: list[bytes]) -> list[bytes]:
    """The groups of each document as `a1,a2|b1;a3|b2,b3`."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    many_a, many_b = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
    order = np.zeros(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + (np.cumsum(many_b) - many_b)[group_a]] = 2 * ids_a + last_a
    order[np.arange(len(ids_b)) + np.cumsum(many_a)[group_b]] = after_a + 2 * ids_b + last_b
    ends = np.cumsum(n_a + n_b)
    return [b"".join(map(names.__getitem__, order[lo:hi].tolist()))[:-1] for lo, hi in zip(ends - n_a - n_b, ends)]


_DOCS = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, refs binary, times binary"
_PAIRS = "place int, a int, b int, docs long"
_EMPTY = {f.split()[0]: t for f, t in zip((_DOCS + ", " + _PAIRS).split(", "), [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()])}


def _rows(columns: dict) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in _EMPTY.items()],
                                      names=list(_EMPTY))


def _align(batches: Iterator[pa.RecordBatch], byte_model: str, piece_model: str, digest: bool) -> Iterator[pa.RecordBatch]:
    """One row per document, whose refs are places in its part's list of id pairs, and that list with document counts."""
    import hashlib
    models = _tokenizers(byte_model, piece_model)
    part = TaskContext.get().partitionId() << 32
    for batch in T.slices(batches, PART_BYTES):
        got = _aligned(batch.column("text").to_pylist(), models)
        pairs, refs, docs = np.unique(got["pair"], return_inverse=True, return_counts=True)
        cuts = np.searchsorted(got["doc"], np.arange(batch.num_rows + 1))
        refs, times = refs.astype("<i4"), got["times"].astype("<i4")
        groups = [g.decode() if not digest else hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]
        yield _rows({
            "part": np.full(batch.num_rows, part), "doc_id": batch.column("doc_id"), **{c: got[c] for c in ("n_a", "n_b", "n_groups", "n_links")},
            "groups": groups, "refs": [refs[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])],
            "times": [times[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])]})
        yield _rows({"part": np.full(len(pairs), part), "place": np.arange(len(pairs)), "a": pairs // models[1].size,
                     "b": pairs % models[1].size, "docs": docs})
        part += 1


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _counted(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a part with the sums over their links of what the corpus says about each id pair."""
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, bool)
    place = pairs["place"].to_numpy()
    count[place], best[place] = pairs["count"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for refs, times in zip(docs["refs"].to_pylist(), docs["times"].to_pylist()):
        refs, times = np.frombuffer(refs, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
        sums.append(int((count[refs] * times).sum()))
        bests.append(int(times[best[refs]].sum()))
    return pa.table({**{c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                     "n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups": docs["groups"]})


def pair_counts(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The stored alignment, and (a, b, count, best): in how many documents ids a and b are linked, and whether no other b has
    more for that a."""
    found = T.id_and_text(docs).mapInArrow(lambda batches: _align(batches, byte_model, piece_model, digest), f"{_DOCS}, {_PAIRS}")
    aligned = stored(found, "alignment")
    counts = checkpointed(aligned.filter("place is not null").groupBy("a", "b").agg(F.sum("docs").alias("count")))
    # one row for each id of vocabulary A, which bounds the table
    most = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("most")))
    return aligned, counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned_tokens(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, digest: bool = False) -> DataFrame:
    """Per document: tokens of both tokenizers, groups between shared ends, links (token pairs whose bytes overlap), how many
    links have a pair that is best for its A id in the corpus, the sum of the links' document counts, and `groups` as text
    (or its SHA-256, if `digest`; '' without tokens).

    Texts that are null, empty or not given back byte for byte by both tokenizers have no tokens. Rows that share a doc_id,
    and rows without one, are documents of their own; other columns are left out.

    A task lists the id pairs of a part of its texts once; documents hold places in that list. So the corpus counts come back
    once for each part and pair, not for each document, and a part is the largest group that meets in a task.
    """
    aligned, ranked = pair_counts(docs, byte_model, piece_model, digest)
    looked = aligned.filter("place is not null").join(ranked, ["a", "b"]).select(F.col("part").alias("of_part"), "place", "count", "best")
    rows = aligned.filter("place is null").select(*[c.split()[0] for c in _DOCS.split(", ")])
    return rows.groupBy("part").cogroup(looked.groupBy("of_part")).applyInArrow(_counted, _RESULT)
