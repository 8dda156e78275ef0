"""The registered queries over the text tables, each beside its SQL where SQL can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from txrisk.llm import (alignment, contextmix, lines, merkle, minhash, mixing, phrases, pieces, pii, substrings, topk, toxicity,
                        urls)
from txrisk.llm import text as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.document_fingerprints(T.table(spark, sf_dir, "documents"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(T.table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, T.table(spark, sf_dir, "labels")))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(T.table(spark, sf_dir, "documents"))


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(T.table(spark, sf_dir, "embeddings"))


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(T.table(spark, sf_dir, "documents"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(T.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(T.table(spark, sf_dir, "documents"))


@query
def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.scored(T.table(spark, sf_dir, "documents"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(T.table(spark, sf_dir, "documents"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned_tokens(T.table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeated_lines(T.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(T.table(spark, sf_dir, "documents"))


WORDS = r"[^\x20\x09-\x0D]+"

SQL["op5_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scores)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""

SQL["op6_mix_sources"] = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS name, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
sources AS (
  SELECT name, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY name, source),
weighed AS (
  SELECT *, source_size * 3 / weight::DOUBLE AS ratio, CAST(sum(source_size) OVER () AS BIGINT)
           - CAST(coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight::DOUBLE, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_of_all,
         CAST(sum(weight) OVER (ORDER BY source_size * 3 / weight::DOUBLE, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights
  FROM sources),
stopped AS (SELECT *, (source_size * 3)::DOUBLE * weights <= weight * rest_of_all AS stops FROM weighed),
share AS (SELECT rest_of_all AS open_rest, weights AS open_weights FROM stopped WHERE NOT stops ORDER BY ratio, name LIMIT 1),
goals AS (
  SELECT name, source_size, CASE WHEN stops OR open_weights IS NULL THEN (source_size * 3)::DOUBLE ELSE (weight * open_rest)::DOUBLE / open_weights END AS target
  FROM stopped LEFT JOIN share ON true),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS epochs, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM goals),
ordered AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY name ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM sized)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken
FROM ordered JOIN budgets USING (name)
"""

SQL["op10_minhash_near_dedup"] = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT DISTINCT a AS x, a AS y FROM links UNION SELECT reach.x, links.b FROM reach JOIN links ON reach.y = links.a),
least_of AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM split LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON x = doc_id
"""

SQL["op12_line_dedup"] = r"""
WITH rows AS (SELECT *, row_number() OVER () AS r FROM documents),
split AS (SELECT r, coalesce(doc_id, -9223372036854775808) AS doc, string_split(coalesce(text, ''), chr(10)) AS l FROM rows),
lines AS (SELECT r, doc, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (SELECT key, max(doc) AS largest FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc) >= 3),
marked AS (SELECT k.*, p.key IS NOT NULL AND k.doc < p.largest AS lost FROM keyed k LEFT JOIN repeated p USING (key)),
joined AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '') AS kept
  FROM marked GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM rows JOIN joined USING (r)
"""

_TEXT_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || {0}, '-')"
_HEAD = " || ".join(_TEXT_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE marked AS (
  SELECT *, coalesce('=' || source, '') AS name, coalesce(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda d, y: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END + y))) & 1 = 1, false) AS tampered
  FROM documents),
leaves AS (
  SELECT doc_id, name, sha256({_HEAD} || {_TEXT_FIELD.format("text")}) AS leaf,
         CASE WHEN tampered THEN sha256({_HEAD} || {_TEXT_FIELD.format("replace(text, chr(10), '')")}) ELSE sha256({_HEAD} || {_TEXT_FIELD.format("text")}) END AS present
  FROM marked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY name) AS n,
         row_number() OVER () AS r FROM leaves),
nodes AS (
  SELECT name, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT name, any_value(level) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY name, pos // 3),
subroots AS (
  SELECT name, digest AS subroot, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY pos // 3),
root AS (SELECT digest AS root FROM tops WHERE n = 1),
sides AS (
  SELECT name, level, pos, CASE pos % 3 WHEN 0 THEN '' WHEN 1 THEN lag(digest) OVER run ELSE lag(digest, 2) OVER run || lag(digest) OVER run END AS lefts,
         CASE pos % 3 WHEN 0 THEN coalesce(lead(digest) OVER run, '') || coalesce(lead(digest, 2) OVER run, '') WHEN 1 THEN coalesce(lead(digest) OVER run, '') ELSE '' END AS rights
  FROM (SELECT name, level, pos, n, digest FROM nodes UNION ALL SELECT NULL, level, pos, n, digest FROM tops) WHERE n > 1
  WINDOW run AS (PARTITION BY name, level, pos // 3 ORDER BY pos)),
steps AS (
  SELECT r, level AS k, lefts, rights FROM placed p JOIN sides s ON s.name = p.name AND s.pos = p.pos // CAST(power(3, level) AS BIGINT)
  UNION ALL
  SELECT r, 1000 + level, lefts, rights FROM placed p JOIN subroots t ON t.name = p.name JOIN sides s ON s.name IS NULL AND s.pos = t.pos // CAST(power(3, level) AS BIGINT)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS i FROM steps),
proofs AS (SELECT r, sha256(string_agg(lefts || rights, '' ORDER BY i)) AS proof_sha256, max(i) AS many FROM numbered GROUP BY r),
folds AS (
  SELECT r, CAST(0 AS BIGINT) AS i, present AS digest FROM placed
  UNION ALL
  SELECT f.r, s.i, sha256(s.lefts || f.digest || s.rights) FROM folds f JOIN numbered s ON s.r = f.r AND s.i = f.i + 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM placed p JOIN subroots t USING (name) CROSS JOIN root LEFT JOIN proofs q USING (r) JOIN folds f ON f.r = p.r AND f.i = coalesce(q.many, 0)
"""
