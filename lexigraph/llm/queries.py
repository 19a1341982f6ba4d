"""The registered queries of the pipeline operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path
from . import chat_format, fingerprints, hard_negatives, importance, language_id, line_dedup, packing, ppm, prob_minhash, quality_rules, source_mix, substring_dedup, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op5_source_mix", f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)) AS BIGINT) AS w,
             2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
f AS (SELECT *, cap / w AS r,
             CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_before,
             CAST(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_w FROM w),
o AS (SELECT 3 * total - 2 * full_before AS left2, open_w FROM f
      WHERE (3 * total - 2 * full_before) * w <= cap * open_w * 2 ORDER BY r, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, total,
             least(CAST(cap AS DOUBLE), coalesce(w * (SELECT left2 FROM o) / (2.0::DOUBLE * (SELECT open_w FROM o)), CAST(cap AS DOUBLE))) AS target FROM f),
q AS (SELECT d.doc_id, d.source, d.size, d.h, t.source_size, t.target, t.total, c.copy,
             CAST(sum(d.size) OVER (PARTITION BY d.source, c.copy ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) c(copy)),
k AS (SELECT *, CASE WHEN target > 0 THEN CAST(cum + copy * source_size AS DOUBLE) / target END AS finish FROM q),
x AS (SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, source IS NOT NULL, source, h, doc_id NULLS FIRST, copy ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN run <= (3 * total) // 2 THEN size ELSE 0 END) AS BIGINT) AS taken
FROM x GROUP BY doc_id, source, h, size, source_size, target, CASE WHEN copy = 0 THEN cum ELSE cum END
""")
def q_op5(spark, sf_dir):
    """Weighted fair queueing over all documents: words taken of each."""
    docs = table(spark, sf_dir, "documents")
    return source_mix.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def _esc_sql(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for i, s in enumerate(chat_format.CONTROL):
        out = f"replace({out}, '{s}', '\\{i}')"
    return out


@query("op6_chat_format", f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, before IS NULL OR before <> role AS first_of, length({_esc_sql('text')}) AS n_esc,
             CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 WHEN 'system' THEN 7 ELSE 13 + length({_esc_sql('role')}) END AS mark FROM o)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_esc + CASE WHEN first_of THEN 7 + mark ELSE 6 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
""")
def q_op6(spark, sf_dir):
    """All conversations plus one that quotes control strings, formatted and
    read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = chat_format.read_chats(chat_format.format_chats(turns.unionByName(quoting)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


_BIN = "CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END"


def _low_sql(b: str) -> str:
    return f"(CASE WHEN {b} < 64 THEN {b} ELSE ({b} - ({b} // 32 - 1) * 32) << ({b} // 32 - 1) END)"


def _quartiles_sql(by: str) -> str:
    part = f"PARTITION BY {by + ', ' if by else ''}rule"
    return f"""
  SELECT {by + ', ' if by else ''}rule, max(total) AS docs,
         {_low_sql('min(bin) FILTER (WHERE upto * 4 >= total)')} AS q1,
         {_low_sql('(min(bin) FILTER (WHERE upto * 4 >= total * 3) + 1)')} - 1 AS q3
  FROM (SELECT *, sum(n) OVER ({part} ORDER BY bin) AS upto, sum(n) OVER ({part}) AS total
        FROM (SELECT {by + ', ' if by else ''}rule, bin, sum(n) AS n FROM sk GROUP BY ALL))
  GROUP BY {by + ', ' if by else ''}rule"""


def _value_sql() -> str:
    return """CASE rule WHEN 'word_length' THEN word_chars * 100 // n_words WHEN 'symbols' THEN n_symbols * 1000 // n_words
              WHEN 'dup_lines' THEN n_dup_lines * 1000 // n_lines ELSE n_repeat_words * 1000 // n_words END"""


@query("op1_quality_rules", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {WORDS} AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, text FROM d),
p AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
k AS (SELECT rid, i, CASE WHEN i + 4 <= len(ws) THEN array_to_string(list_slice(ws, i, i + 4), ' ') END AS win FROM p),
t AS (SELECT rid, i, win IS NOT NULL AND count(*) OVER (PARTITION BY rid, win) > 1 AS twice FROM k),
c AS (SELECT rid, bool_or(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM t),
r AS (SELECT rid, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY rid),
s AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)),
x AS (SELECT lang, source, rule, {_value_sql()} AS v FROM s CROSS JOIN (VALUES ('word_length'), ('symbols'), ('dup_lines'), ('repeats')) u(rule) WHERE n_words > 0),
sk AS (SELECT lang, source, rule, {_BIN} AS bin, count(*) AS n FROM x GROUP BY ALL),
q2 AS ({_quartiles_sql('lang, source')}), q1 AS ({_quartiles_sql('lang')}), q0 AS ({_quartiles_sql('')}),
f AS (SELECT q2.lang, q2.source, rule,
             CASE WHEN q2.docs >= 100 THEN q2.q1 WHEN q1.docs >= 100 THEN q1.q1 ELSE q0.q1 END AS a,
             CASE WHEN q2.docs >= 100 THEN q2.q3 WHEN q1.docs >= 100 THEN q1.q3 ELSE q0.q3 END AS b
      FROM q2 JOIN q1 USING (rule) JOIN q0 USING (rule) WHERE q2.lang IS NOT DISTINCT FROM q1.lang),
g AS (SELECT lang, source, rule, a, b, 3 * greatest(b - a, CASE rule WHEN 'word_length' THEN 40 WHEN 'dup_lines' THEN 100 WHEN 'repeats' THEN 60 ELSE 25 END) AS reach FROM f),
j AS (SELECT s.*, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
             EXISTS (SELECT 1 FROM g WHERE n_words > 0 AND g.lang IS NOT DISTINCT FROM s.lang AND g.source IS NOT DISTINCT FROM s.source
                     AND ({_value_sql()} > b + reach OR (rule = 'word_length' AND {_value_sql()} < a - reach))) AS out_of_fence
      FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT out_of_fence AS kept
FROM j
""")
def q_op1(spark, sf_dir):
    """Signals, base rules and adaptive thresholds over all documents."""
    d = quality_rules.judge(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_packing")
def q_op9(spark, sf_dir):
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op3_prob_minhash")
def q_op3(spark, sf_dir):
    """Near-duplicate class of every document."""
    return prob_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_substring_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT rid, doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
k AS (SELECT rid, doc_id, i, ws[i] AS w, CASE WHEN i + 49 <= len(ws) THEN md5(array_to_string(list_slice(ws, i, i + 49), ' ')) END AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM k WHERE win IS NOT NULL GROUP BY win),
t AS (SELECT rid, i, w, coalesce(first < doc_id, false) AS again FROM k LEFT JOIN f USING (win)),
c AS (SELECT rid, i, w, bool_or(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM t),
s AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (rid)
""")
def q_op7(spark, sf_dir):
    """Words left after removing 50-word windows that an earlier document holds."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query("op10_line_dedup", """
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, regexp_matches(s, '[^\\x20\\x09-\\x0D]') AS solid FROM d),
f AS (SELECT s, min((doc_id, line)) AS p FROM w WHERE solid GROUP BY s),
h AS (SELECT s, p, length(s) AS n, unnest([length(s), length(s) - 1]) AS l FROM f),
k AS (SELECT *, unnest(['a' || left(s, CAST(l // 2 AS INT)), 'b' || right(s, CAST(l // 2 AS INT))]) AS half FROM h),
c AS (SELECT DISTINCT a.s AS s, a.p AS p, b.s AS t, a.n AS n, b.n AS m FROM k a JOIN k b ON a.l = b.l AND a.half = b.half AND b.p < a.p AND least(a.n, b.n) = a.l),
e AS (SELECT DISTINCT s FROM c WHERE
        CASE WHEN n = m THEN len(list_filter(range(1, n + 1), lambda i: s[i] <> t[i])) = 1
             WHEN n = m + 1 THEN len(list_filter(range(1, n + 1), lambda i: s[1:i - 1] || s[i + 1:] = t)) > 0
             ELSE len(list_filter(range(1, m + 1), lambda i: t[1:i - 1] || t[i + 1:] = s)) > 0 END),
g AS (SELECT doc_id, line, w.s, solid AND ((doc_id, line) <> f.p OR e.s IS NOT NULL) AS gone FROM w LEFT JOIN f ON w.s = f.s AND solid LEFT JOIN e ON w.s = e.s)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (WHERE gone IS NOT TRUE), '')) AS kept_sha256
FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
""")
def q_op10(spark, sf_dir):
    """Lines left after removing repeats and lines one edit from an earlier one."""
    d = line_dedup.remove_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", "kept_sha256")


@query("op2_language_id")
def q_op2(spark, sf_dir):
    """Predicted language of every document, learned from those not held out."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op8_importance_resampling")
def q_op8(spark, sf_dir):
    """Importance weight of every document and whether it is drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_fingerprints")
def q_op4(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, compared."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def _remainder(doc_id: str, of: int):
    """CRC-32 of the id's text, modulo ``of``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of)), F.lit(0))


@query("op11_lm_score")
def q_op11(spark, sf_dir):
    """PPM and single-token log probabilities of all documents, learned from
    nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    held = _remainder("doc_id", 10) == 0
    got = ppm.score_documents(docs, ~held)
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLOORS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def _nearest_sql(books: str) -> str:
    """Each part's nearest entry: key = squared distance * 64 + entry."""
    return f"""SELECT rid, part, v, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS key
  FROM parts JOIN {books} USING (part) GROUP BY rid, part, v"""


def _refined_sql(books: str, near: str) -> str:
    return f"""SELECT part, e, coalesce(m, c) AS c FROM {books} LEFT JOIN (
    SELECT part, e, list(m ORDER BY i) AS m FROM (
      SELECT part, key % 64 AS e, i, CAST(floor(sum(v[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
      FROM (SELECT part, key, v, unnest(range(1, len(v) + 1)) AS i FROM {near}) GROUP BY ALL) GROUP BY part, e) USING (part, e)"""


@query("op12_vector_codes", f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, {_FLOORS} AS v FROM embeddings WHERE {_FINITE}),
parts AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM (SELECT rid, v, unnest(range(16)) AS part FROM k)),
c0 AS MATERIALIZED (SELECT part, rid AS e, v AS c FROM parts WHERE rid < 64),
n0 AS MATERIALIZED ({_nearest_sql('c0')}), c1 AS MATERIALIZED ({_refined_sql('c0', 'n0')}),
n1 AS MATERIALIZED ({_nearest_sql('c1')}), c2 AS MATERIALIZED ({_refined_sql('c1', 'n1')}),
n2 AS MATERIALIZED ({_nearest_sql('c2')}),
s AS (SELECT rid, string_agg(lower(printf('%02x', CAST(key % 64 AS INT))), '' ORDER BY part) AS code, CAST(sum(key // 64) AS BIGINT) AS error FROM n2 GROUP BY rid),
d AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, i)) AS digest FROM (SELECT part, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM c2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT digest FROM d) AS codebooks_sha256
FROM k JOIN s USING (rid)
""")
def q_op12(spark, sf_dir):
    """All vectors coded by codebooks of 16 parts and 64 entries."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


@query("op13_hard_negatives", f"""
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_FLOORS} AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
a AS (SELECT DISTINCT vec_id, label, v FROM r WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, a.v AS own, a.label AS own_label, r.vec_id, r.label, rid,
             CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM a JOIN r ON len(a.v) = len(r.v)),
p AS (SELECT anchor_id, own, vec_id AS positive_id, rid AS positive_row, score AS positive_score FROM s WHERE label = own_label AND vec_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id, own, own_label ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.own, positive_row ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.own = s.own AND s.label <> own_label
  WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
WHERE rank <= 10
""")
def q_op13(spark, sf_dir):
    """Hard negatives of every hundredth vector among all vectors."""
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(e.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)
