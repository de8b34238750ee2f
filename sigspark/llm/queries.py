"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import bpe, copies, decontaminate, embeddings, html, jaccard, language, negatives, pii, recurrent, tables, toxicity, turns, warc
from sigspark.llm.tables import bounded_batches, remainder

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Replace in production; whoever holds it can undo the pseudonyms.
PII_KEY = b"replace me"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return tables.read(spark, sf_dir, name)


def _held_out(divisor: int, value: int):
    return remainder("doc_id", divisor) == value


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), size=3, percent=90)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = language.learn_profiles(docs.where(~_held_out(5, 0)))
    return language.identify(docs, profiles).withColumn("held_out", _held_out(5, 0)).select(
        "doc_id", "held_out", "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), ~_held_out(5, 0))
    scored = toxicity.score(docs, model).withColumn("held_out", _held_out(5, 0))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN, with_ids=False)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(read(spark, sf_dir, "documents"), PII_KEY)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archives(read(spark, sf_dir, "pages"), folder, shard_bytes=32 << 20)
    return warc.read_archives(spark, folder).drop("payload", "url")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = recurrent.log_likelihoods(docs, ~_held_out(7, 2)).withColumn("held_out", _held_out(7, 2))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", label)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.exact_duplicates(read(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return turns.repaired(rows, turns.damaged(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_SHINGLES = r"""w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s FROM w)"""


# CRC-32 by its polynomial; then the cheapest, ASCII-least edits into each state, row after row
_TURNS = r"""WITH RECURSIVE
tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT coalesce('v' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce([4294967295::BIGINT] || list_transform(
          string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS k
      FROM conversations, tab),
m AS (SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS c
      FROM d WHERE k <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), c) AS i FROM m),
f AS (SELECT *, substr(role, 1, 1) AS o, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
        WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS f,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS before FROM p),
r(conv, i, q, cost, audit, lines) AS (
  SELECT DISTINCT conv, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM f
  UNION ALL
  SELECT conv, i, q, cost, audit, lines FROM (
    SELECT r.conv, f.i, CASE letter WHEN 'D' THEN z WHEN 'K' THEN s ELSE [2, 2, 3, 2][z + 1] END AS q,
      r.cost + 5 * ins + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
        + CASE WHEN letter <> 'D' AND f.f = 't' THEN 5 ELSE 0 END AS cost,
      r.audit || repeat('I', ins) || letter AS audit,
      r.lines || CASE ins WHEN 0 THEN [] WHEN 1 THEN [w[r.q + 1] || ':'] ELSE [w[r.q + 1] || ':', w[[2, 2, 3, 2][r.q + 1] + 1] || ':'] END
        || CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [w[z + 1] || ':' || f.text] END AS lines
    FROM r JOIN f ON f.conv = r.conv AND f.i = r.i + 1, (VALUES (0), (1), (2)) a(ins), (VALUES ('D'), ('K'), ('R')) e(letter),
      LATERAL (SELECT CASE ins WHEN 0 THEN r.q WHEN 1 THEN [2, 2, 3, 2][r.q + 1] ELSE [2, 2, 3, 2][[2, 2, 3, 2][r.q + 1] + 1] END AS z,
                      ['user', 'user', 'assistant', 'user'] AS w) y,
      LATERAL (SELECT CASE WHEN z = 0 AND f.o = 's' THEN 1 WHEN z IN (0, 1, 3) AND f.o = 'u' THEN 2 WHEN z = 2 AND f.o = 'a' THEN 3 END AS s) x
    WHERE letter = 'D' OR (f.f NOT IN ('b', 'd') AND (letter = 'R' OR s IS NOT NULL)))
  QUALIFY row_number() OVER (PARTITION BY conv, q ORDER BY cost, audit) = 1),
n AS (SELECT conv, max(i) AS i, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || o NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
g AS (SELECT conv, cost + [0, 10, 5, 0][q + 1] AS cost, audit || ['', 'II', 'I', ''][q + 1] AS audit,
        lines || CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END AS lines FROM r JOIN n USING (conv, i)),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY conv ORDER BY cost, audit) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN n ON n.conv = coalesce('v' || c.conv_id, '') LEFT JOIN b ON b.conv = n.conv"""


def oracle_sql() -> dict[str, str]:
    return {
        "op13_turn_repair": _TURNS,
        "op12_exact_dedup": r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, min(doc_id) OVER w = doc_id AS kept,
       sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)""",
        "op11_hard_negatives": """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 10""",
        "op8_embeddings": """WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.y, r.c FROM r JOIN p ON p.x = r.vec_id),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.c) AS component_id, min(r.c) = vec_id AS kept
FROM r LEFT JOIN n ON n.x = r.vec_id GROUP BY vec_id""",
        "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n,
       sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m ON m.d = p.d AND n >= 1000""",
        "op1_ngram_jaccard": f"""WITH RECURSIVE {_SHINGLES},
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s.s)""",
    }
