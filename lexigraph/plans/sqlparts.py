"""ANSI/DuckDB SQL fragments for the oracle twins of the catalogue queries.

These restate, in plain SQL over the same parquet tables, what the Spark
operators compute; they share the fixed word lists with the library so
both sides tokenise the same way.
"""

from __future__ import annotations

from ..functions import fixed

WS = fixed.PY_WHITESPACE


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_str(w) for w in words) + "]"


def fill(template: str, **kw) -> str:
    """Replace $NAME markers (regexes keep their braces untouched)."""
    out = template.replace("$WS", WS)
    for k, v in kw.items():
        out = out.replace("$" + k, v)
    return out


STOP_EN = sql_list(fixed.stop_words(None))
STOP_NETWORK = sql_list(fixed.stop_words("network"))
STOP_TOPICS = sql_list(fixed.stop_words("topics"))
STOP_EMBED = sql_list(fixed.stop_words("embedding"))


def word_count(expr: str) -> str:
    return fill("CAST(len(regexp_extract_all($E, '[^$WS]+')) AS BIGINT)", E=expr)


def strip(expr: str) -> str:
    return fill("regexp_replace($E, '^[$WS]+|[$WS]+$', '', 'g')", E=expr)


def tok_words(expr: str, min_len: int = 2) -> str:
    return fill(
        r"list_filter(regexp_extract_all(lower($E), '[\p{L}\p{N}_]+'), "
        r"lambda t: regexp_full_match(t, '[a-z]{$N,}'))", E=expr, N=str(min_len))


def tok_norm(expr: str) -> str:
    return fill(
        r"list_filter(regexp_extract_all(strip_accents(lower($E)), '[\p{L}\p{Nl}\p{No}_]+'), "
        r"lambda t: length(t) BETWEEN 3 AND 15 AND NOT starts_with(t, '_'))", E=expr)


def drop_words(expr: str, words_sql: str) -> str:
    return f"list_filter({expr}, lambda t: NOT list_contains({words_sql}, t))"


# All documents as the document table (before the length filter).
ALL_DOCS = fill("""WITH all_docs AS (
  SELECT doc_id, source AS archive_folder, lang AS place, source AS source_file,
         regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text
  FROM documents
)""")

SERIES = ("CASE WHEN starts_with(source_file, 'TBUK') THEN 'TBUK' "
          "WHEN starts_with(source_file, 'VF_NEW') THEN 'VF_NEW' "
          "WHEN starts_with(source_file, 'VF:') THEN 'VF_NEW' "
          "WHEN starts_with(source_file, 'TWA') THEN 'TWA' ELSE 'WESA' END")

# The corpus: documents with at least 20 words.
CORPUS = ALL_DOCS + """,
corpus AS (
  SELECT doc_id, archive_folder, place, source_file, text,
         """ + SERIES + """ AS series, """ + word_count("text") + """ AS word_count
  FROM all_docs
  WHERE """ + word_count("text") + """ >= 20
)"""

# Network tokens (normalised, network stop list) per corpus document.
NET_TOKENS = CORPUS + """,
net_tokens AS (
  SELECT doc_id, """ + drop_words(tok_norm("text"), STOP_NETWORK) + """ AS tokens FROM corpus
)"""

NET_STATS = NET_TOKENS + """,
net_occ AS (SELECT doc_id, unnest(tokens) AS word FROM net_tokens),
net_stats AS (
  SELECT word, count(*) AS freq, count(DISTINCT doc_id) AS doc_freq FROM net_occ GROUP BY word
)"""

# TF-IDF terms: letters-only words, English stop list removed, 1-2-grams.
TFIDF_TERMS = CORPUS + """,
tf_tok AS (
  SELECT doc_id, """ + drop_words(tok_words("text"), STOP_EN) + """ AS toks FROM corpus
),
tf_terms AS (
  SELECT doc_id, toks || list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) AS terms
  FROM tf_tok
),
tf_rows AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tf_terms)
  GROUP BY doc_id, term
),
n_docs AS (SELECT count(*) AS n FROM corpus)"""

# Fitted TF-IDF vocabulary and unit-length weights.
TFIDF = TFIDF_TERMS + """,
tf_stats AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf_rows GROUP BY term),
vocab AS (
  SELECT term, df, total, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
  FROM tf_stats, n_docs
  WHERE df >= 2 AND df <= 0.85 * n
  ORDER BY total DESC, term LIMIT 5000
),
w0 AS (SELECT r.doc_id, r.term, r.tf * v.idf AS w FROM tf_rows r JOIN vocab v USING (term)),
wts AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""

# Cosine of every pair that shares a term (self-join on term).
SIMS = TFIDF + """,
sims AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, sum(a.weight * b.weight) AS sim
  FROM wts a JOIN wts b ON a.term = b.term AND a.doc_id < b.doc_id
  GROUP BY 1, 2
),
p95 AS (
  SELECT quantile_cont(coalesce(s.sim, 0.0), 0.95) AS p95
  FROM (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM corpus a JOIN corpus b ON a.doc_id < b.doc_id) ap
  LEFT JOIN sims s USING (doc_a, doc_b)
),
dir AS (SELECT doc_a AS d, doc_b AS nb, sim FROM sims UNION ALL SELECT doc_b, doc_a, sim FROM sims),
knn AS (
  SELECT d, nb, sim, r FROM (
    SELECT d, nb, sim, row_number() OVER (PARTITION BY d ORDER BY round(sim, 6) DESC, nb) AS r FROM dir)
  WHERE r <= 5 AND round(sim, 6) >= 0.15
),
graph AS (SELECT least(d, nb) AS doc_a, greatest(d, nb) AS doc_b, any_value(sim) AS sim FROM knn GROUP BY 1, 2),
src AS (SELECT doc_id, source_file FROM corpus)"""


def shared_terms(edges: str, n: int = 4) -> str:
    """SQL selecting (doc_a, doc_b, shared_terms) for the pairs of ``edges``."""
    return f"""(
  SELECT doc_a, doc_b, string_agg(term, ', ' ORDER BY rn) AS shared_terms FROM (
    SELECT e.doc_a, e.doc_b, x.term,
           row_number() OVER (PARTITION BY e.doc_a, e.doc_b
                              ORDER BY round(x.weight * y.weight, 12) DESC, x.term) AS rn
    FROM {edges} e JOIN wts x ON x.doc_id = e.doc_a
    JOIN wts y ON y.doc_id = e.doc_b AND y.term = x.term
  ) WHERE rn <= {n} GROUP BY doc_a, doc_b
)"""

# Co-occurrence windows over the top-400 vocabulary (a real window frame).
COOC = NET_STATS + """,
top400 AS (
  SELECT word, freq, doc_freq, row_number() OVER (ORDER BY freq DESC, word) AS rank
  FROM net_stats WHERE freq >= 8 AND doc_freq >= 3 ORDER BY freq DESC, word LIMIT 400
),
pos AS (SELECT doc_id, unnest(tokens) AS word, unnest(range(1, len(tokens) + 1)) AS p FROM net_tokens),
vpos AS (
  SELECT pos.doc_id, pos.p, CASE WHEN t.word IS NOT NULL THEN pos.word END AS vw
  FROM pos LEFT JOIN top400 t ON t.word = pos.word
),
win AS (
  SELECT doc_id, p, vw AS anchor,
         list_distinct(list_filter(list(vw) OVER (PARTITION BY doc_id ORDER BY p
                                                  ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING),
                                   lambda x: x IS NOT NULL AND x <> vw)) AS partners
  FROM vpos
),
anchors AS (SELECT * FROM win WHERE anchor IS NOT NULL AND len(partners) > 0),
pairs AS (
  SELECT least(anchor, q) AS w1, greatest(anchor, q) AS w2, count(*) AS n
  FROM (SELECT anchor, unnest(partners) AS q FROM anchors) GROUP BY 1, 2
),
anc AS (SELECT anchor AS word, count(*) AS windows FROM anchors GROUP BY 1),
tot AS (SELECT sum(n) AS total FROM pairs),
scored AS (
  SELECT w1, w2, n, pmi, CASE WHEN pp >= 1.0 THEN 1.0 ELSE pmi / (-log2(pp)) END AS npmi FROM (
    SELECT p.w1, p.w2, p.n, p.n / tot.total AS pp,
           log2((p.n / tot.total) / ((a1.windows / tot.total) * (a2.windows / tot.total))) AS pmi
    FROM pairs p, tot JOIN anc a1 ON a1.word = p.w1 JOIN anc a2 ON a2.word = p.w2
    WHERE p.n >= 3 AND a1.windows > 0 AND a2.windows > 0)
  WHERE pmi > 0
),
top_edges AS (
  SELECT w1, w2, n, npmi, row_number() OVER (ORDER BY round(npmi, 9) DESC, w1, w2) AS rank
  FROM scored ORDER BY round(npmi, 9) DESC, w1, w2 LIMIT 600
),
ends AS (SELECT w1 AS word FROM top_edges UNION ALL SELECT w2 FROM top_edges),
deg AS (SELECT word, count(*) AS degree FROM ends GROUP BY word),
nodes AS (
  SELECT word, degree FROM deg
  UNION ALL
  SELECT word, 0 FROM top400 WHERE rank <= 100 AND word NOT IN (SELECT word FROM deg)
)"""

# Lexicon derived from the corpus words (a stand-in; the scoring is general).
LEXICON = CORPUS + """,
lex_words AS (SELECT DISTINCT unnest(""" + tok_words("text", 1) + """) AS word FROM corpus),
lexicon AS (
  SELECT word, 1.0 + ascii(word) % 9 AS valence, 1.0 + length(word) % 9 AS arousal,
         1.0 + (ascii(word) + length(word)) % 9 AS dominance
  FROM lex_words WHERE ascii(word) % 2 = 0
),
ltoks AS (SELECT doc_id, place, """ + tok_words("text", 1) + """ AS t FROM corpus),
locc AS (SELECT doc_id, place, len(t) AS n_tokens, unnest(t) AS word FROM ltoks),
scores AS (
  SELECT o.doc_id, any_value(o.place) AS place, avg(l.valence) AS valence, avg(l.arousal) AS arousal,
         avg(l.dominance) AS dominance, count(*) AS matched, count(*) / any_value(o.n_tokens) AS coverage
  FROM locc o JOIN lexicon l USING (word) GROUP BY o.doc_id
)"""

# Stand-in topic assignment: one topic per language, numbered by name.
ASSIGN = CORPUS + """,
topic_ids AS (SELECT place, CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS topic_num
              FROM (SELECT DISTINCT place FROM corpus)),
assign AS (SELECT c.doc_id, c.archive_folder, t.topic_num, c.place AS topic, c.place AS keywords
           FROM corpus c JOIN topic_ids t USING (place))"""

# Embedding-sentence word frequencies and the top-800 words.
EMB_WORDS = CORPUS + """,
esents AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\\n]+')) AS s FROM corpus),
ekept AS (SELECT """ + drop_words(tok_norm("s"), STOP_EMBED) + """ AS t FROM esents),
efreq AS (SELECT word, count(*) AS frequency FROM (SELECT unnest(t) AS word FROM ekept WHERE len(t) >= 3) GROUP BY word),
top800 AS (SELECT word, frequency FROM efreq ORDER BY frequency DESC, word LIMIT 800)"""

EMB = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def category_case(col: str = "word") -> str:
    parts = []
    for cat, words in fixed.CATEGORY_RULES:
        parts.append(f"WHEN {col} IN ({', '.join(sql_str(w) for w in words)}) THEN {sql_str(cat)}")
    return "CASE " + " ".join(parts) + f" ELSE {sql_str(fixed.DEFAULT_CATEGORY)} END"
