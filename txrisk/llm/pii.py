"""Personal data: fixed patterns find seeds, whose contexts become patterns that find further identifiers.

Base spans (email, ip, card, phone) come from one pass over the whole texts. The same pass notes every other token
with a digit or an at-sign as a possible identifier (numbers in groups as one), and the lexical patterns around both: the
words before and after, each for one coarse form of identifiers and for all, and the word before with the shape. Pattern and instance form a graph. Spark scores it in rounds:
a pattern's confidence is the mean score of its distinct instances, an instance's score the best confidence of its
patterns, seeds being certain. Possible identifiers of a pattern with enough confidence and enough distinct seeds become spans of
the kind of its seeds. Edges are made distinct before they are joined, so a common word costs its distinct instances only.
"""

from collections.abc import Iterator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import xxhash

from txrisk.llm import text as T
from txrisk.session import checkpointed

#: Kinds in the order of the output, fixed values.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: A pattern is trusted from this confidence, n known instances of n + 1, and this many distinct seeds on.
CONFIDENCE, SEEDS, ROUNDS = 0.8, 4, 3
#: Characters of context in which neighbouring words are looked up, and the most digits of an identifier written in groups.
CONTEXT, MOST_DIGITS = 64, 34

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_AFTER_PLUS = re.compile(r"[0-9][\x20().0-9-]+")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SHAPE = re.compile(r"[0-9]+|[^\W\d_]+")
_SPACES = frozenset(" \t\n\x0b\x0c\r")
_EDGES = "\"'`([{<>}]),.;:!?|*"
_NUMBER = re.compile(r"\+?[0-9][0-9()./-]*")
_BETWEEN = frozenset((" ", ") ", " (", ") ("))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _addresses(text: str, numbers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Four runs of digits with one dot between neighbours; each at most 255, else the match is dropped."""
    out, k = [], 0
    while k + 3 < len(numbers):
        four = numbers[k:k + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            parts = [text[s:e].lstrip("0") for s, e in four]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                out.append((four[0][0], four[3][1]))
            k += 4
        else:
            k += 1
    return out


def _cards(text: str, numbers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of digits chained by single spaces or hyphens; 13 to 19 digits with a right check digit."""
    out, k = [], 0
    while k < len(numbers):
        last, size = k, numbers[k][1] - numbers[k][0]
        while last + 1 < len(numbers) and numbers[last + 1][0] == numbers[last][1] + 1 and text[numbers[last][1]] in " -":
            last += 1
            size += numbers[last][1] - numbers[last][0]
        if 13 <= size <= 19 and _luhn("".join(text[s:e] for s, e in numbers[k:last + 1])):
            out.append((numbers[k][0], numbers[last][1]))
        k = last + 1
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("+")
    while at >= 0:
        if m := _AFTER_PLUS.match(text, at + 1):
            end = m.end()
            while not "0" <= text[end - 1] <= "9":
                end -= 1
            if end >= at + 4 and 9 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15:
                out.append((at, end))
        at = text.find("+", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    numbers = [m.span() for m in _DIGITS.finditer(text)]
    out = [(EMAIL, s, e) for s, e in _emails(text)]
    if numbers:
        out += [(IP, s, e) for s, e in _addresses(text, numbers)]
        out += [(CARD, s, e) for s, e in _cards(text, numbers)]
        out += [(PHONE, s, e) for s, e in _phones(text)]
    return out


def _possible(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit or an at-sign, without marks at their edges, that touch no base span; numbers in groups are one."""
    out, done, k = [], 0, 0
    taken = sorted(taken)
    for m in re.finditer(r"[0-9@]", text):
        if m.start() < done:
            continue
        s = e = m.start()
        while s > done and text[s - 1] not in _SPACES:
            s -= 1
        while e < len(text) and text[e] not in _SPACES:
            e += 1
        done = e
        token = text[s:e]
        s += len(token) - len(token.lstrip(_EDGES))
        e = s + len(token.strip(_EDGES))
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if e > s and not any(a < e for a, b in taken[k:k + 4] if b > s):
            out.append((s, e))
    return _grouped(text, out)


def _grouped(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring numbers with one space between them as one; with more than MOST_DIGITS digits they stay single."""
    out, k = [], 0
    while k < len(tokens):
        last = k
        if _NUMBER.fullmatch(text, *tokens[k]):
            while last + 1 < len(tokens) and text[tokens[last][1]:tokens[last + 1][0]] in _BETWEEN and _NUMBER.fullmatch(text, *tokens[last + 1]):
                last += 1
        s, e = tokens[k][0], tokens[last][1]
        if last > k and sum("0" <= c <= "9" for c in text[s:e]) <= MOST_DIGITS:
            surplus = text.count("(", s, e) - text.count(")", s, e)
            out.append((s - (surplus < 0 and text[s - 1:s] == "("), e + (surplus > 0 and text[e:e + 1] == ")")))
        else:
            out += tokens[k:last + 1]
        k = last + 1
    return out


def _form(instance: str) -> str:
    """Coarse form of an identifier. A context is scored for this form and for all forms together."""
    if "@" in instance:
        return "@"
    if instance[0] == "+":
        return "+"
    if not instance.strip("0123456789."):
        return "."
    return "0" if not instance.strip("0123456789 -") else "x"


def _patterns(text: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a stretch of text."""
    before = _WORDS.findall(text[max(0, start - CONTEXT):start].lower())[-2:]
    after = _WORDS.findall(text[end:end + CONTEXT].lower())[:1]
    inner = text[start:end] if end - start <= CONTEXT else text[start:start + CONTEXT]
    shape = _SHAPE.sub(lambda m: f"9{len(m[0])}" if m[0][0].isdigit() else "a", inner)
    form = _form(inner)
    own = [f"s {shape} {before[-1]}"] if before else []
    for f in (form, "any"):
        if before:
            own.append(f"l {f} {before[-1]}")
        if len(before) > 1:
            own.append(f"m {f} {before[0]} {before[1]}")
        if after:
            own.append(f"r {f} {after[0]}")
        if before and after:
            own.append(f"c {f} {before[-1]} {after[0]}")
    return [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in own]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_SEEN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_FOUND = ("doc_id long, mark long, base array<struct<kind: int, start: long, end: long>>, "
          "seen array<struct<kind: int, start: long, end: long, instance: long, patterns: array<long>>>")


def _worth(column: pa.Array) -> np.ndarray:
    """Rows with a digit or an at-sign; no other row has a span."""
    out = np.zeros(len(column), bool)
    hit = np.zeros(256, bool)
    hit[[*range(48, 58), 64]] = True
    for lo, hi, data, off in T.runs(column, 1 << 20):
        places = np.flatnonzero(hit[data])
        out[lo:hi] = np.searchsorted(places, off[1:]) > np.searchsorted(places, off[:-1])
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        texts = batch.column("text")
        base: list = [[] for _ in range(len(texts))]
        seen: list = [[] for _ in range(len(texts))]
        for r in np.flatnonzero(_worth(texts)):
            t = texts[r].as_py()
            spans = base_spans(t)
            base[r] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            possible = [(-1, s, e) for s, e in _possible(t, [(s, e) for _, s, e in spans])]
            seen[r] = [{"kind": k, "start": s, "end": e, "instance": xxhash.xxh3_64_intdigest(t[s:e]) - (1 << 63), "patterns": _patterns(t, s, e)}
                       for k, s, e in spans + possible]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))],
            names=["doc_id", "mark", "base", "seen"])


def extracted(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, seen) for each document; mark is a hash of the text, null texts being empty."""
    rows = T.id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(_extract, _FOUND)


def trusted_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that enough distinct seeds support."""
    seen = found.select(F.explode("seen").alias("s")).select("s.kind", "s.instance", F.explode("s.patterns").alias("pattern"))
    edges = checkpointed(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    scores = edges.select("instance", "kind").groupBy("instance").agg((F.max("kind") >= 0).cast("double").alias("score"))
    for _ in range(ROUNDS):
        patterns = checkpointed(
            edges.join(scores, "instance").groupBy("pattern").agg(
                (F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.sum((F.col("kind") >= 0).cast("int")).alias("seeds"),
                *[F.sum((F.col("kind") == k).cast("int")).alias(f"k{k}") for k in range(len(KINDS))])
            .filter(F.col("seeds") >= SEEDS))
        best = edges.join(patterns.filter("confidence >= 0.5").select("pattern", "confidence"), "pattern", "left")
        scores = checkpointed(best.groupBy("instance").agg(
            F.when(F.max("kind") >= 0, F.lit(1.0)).otherwise(F.coalesce(F.max("confidence"), F.lit(0.0))).alias("score")))
    most = F.greatest(*[f"k{k}" for k in range(len(KINDS))])
    kind = F.coalesce(*[F.when(F.col(f"k{k}") == most, F.lit(k)) for k in range(len(KINDS))])
    return patterns.filter(F.col("confidence") >= CONFIDENCE).select("pattern", kind.alias("kind"), "confidence")


def learned_spans(found: DataFrame) -> DataFrame:
    """(doc_id, mark, learned): possible identifiers that a trusted pattern surrounds."""
    rows = found.select("doc_id", "mark", F.explode("seen").alias("s")).filter("s.kind < 0").select(
        "doc_id", "mark", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.explode("s.patterns").alias("pattern"))
    hits = rows.join(trusted_patterns(found), "pattern").groupBy("doc_id", "mark", "start", "end").agg(
        F.max(F.struct("confidence", (-F.col("kind")).alias("kind"))).alias("best"))
    return hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct((-F.col("best.kind")).alias("kind"), "start", "end")).alias("learned"))


def _with_learned(rows: DataFrame, found: DataFrame) -> DataFrame:
    learned = learned_spans(found).select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), "learned")
    return rows.join(learned, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")), "left").drop("own_id", "own_mark")


def _all_spans(docs: DataFrame) -> DataFrame:
    found = checkpointed(extracted(docs))
    none = F.array().cast("array<struct<kind: int, start: long, end: long>>")
    return _with_learned(found, found).select("doc_id", "mark", "base", F.coalesce("learned", none).alias("learned"))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned) for each document.

    The counts and the digest are those of the base spans; `spans` has the learned ones too. Null and empty
    texts have no span. Rows that share id and text are reported each.
    """
    own = _all_spans(docs)

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return own.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "learned")).alias("spans"),
        F.size("learned").cast("long").alias("n_learned"))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by the name of its first kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with personal data replaced in `text`; `n_chars` follows. Every row stays."""
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                         F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"))
    rows = _with_learned(marked, checkpointed(extracted(docs)))

    @F.arrow_udf("string")
    def masked(texts: pa.Array, more: pa.Array) -> pa.Array:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        out = texts.to_pylist()
        for r in np.flatnonzero(_worth(texts)):
            extra = [(s["kind"], s["start"], s["end"]) for s in more[int(r)].as_py() or []]
            out[r] = mask(out[r], base_spans(out[r]) + extra)
        return pa.array(out, pa.string())

    done = rows.withColumn("clean", masked(F.col("row.text").cast("string"), F.col("learned")))
    own = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("clean").isNull(), F.col("row.n_chars")).otherwise(F.length("clean").cast("long"))
    return done.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
