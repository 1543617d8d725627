"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from brindle.functions.text import _ACCENTED, _PLAIN, STOPWORDS

WORD = r"[\p{L}\p{N}_]+"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def fold(c: str) -> str:
    return rf"regexp_replace(translate(lower({c}), '{_ACCENTED}', '{_PLAIN}'), '\p{{Mn}}+', '', 'g')"


def tokens(c: str) -> str:
    return f"regexp_extract_all({fold(c)}, '{WORD}')"


def content_tokens(c: str) -> str:
    return f"list_distinct(list_filter({tokens(c)}, lambda t: length(t) >= 2 AND t NOT IN ({', '.join(repr(w) for w in STOPWORDS)})))"


def lines(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, '{LINE_END}'), lambda x: trim(x)), lambda x: x <> '')"


def embedding(p: str, table: str, key: str, text: str = "text", width: int = 256) -> str:
    """CTEs that end in ``{p}e(k, idx, v)``."""
    return f"""{p}t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower(coalesce({text}, '')), '{WORD}')) AS t FROM {table}),
{p}c AS (SELECT k, t, count(*) AS n, sha256(t) AS h FROM {p}t GROUP BY k, t),
{p}w AS (SELECT k, ('0x' || substr(h, 1, 8))::BIGINT % {width} AS idx, n * (CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1::DOUBLE ELSE -1::DOUBLE END) * (1::DOUBLE + ('0x' || substr(h, 11, 2))::BIGINT / 255::DOUBLE) AS w FROM {p}c),
{p}s AS (SELECT k, idx, sum(w) AS w FROM {p}w GROUP BY k, idx UNION ALL SELECT {key}, 0, 1e-6::DOUBLE FROM {table} WHERE len(regexp_extract_all(coalesce({text}, ''), '{WORD}')) = 0),
{p}n AS (SELECT k, sqrt(sum(w * w)) AS norm FROM {p}s GROUP BY k),
{p}e AS (SELECT k, idx, CASE WHEN norm > 1e-5 THEN w / norm ELSE w END AS v FROM {p}s JOIN {p}n USING (k))"""


def bm25(name: str, k: int = 12) -> str:
    """CTEs that end in ``{name}(item_id, doc_id, score, rank)``: documents for the benchmark's questions."""
    return f"""b_t AS (SELECT doc_id, {tokens("coalesce(text, '')")} AS l FROM documents),
b_p AS (SELECT doc_id, len(l) AS len, unnest(l) AS term FROM b_t),
b_tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM b_p GROUP BY doc_id, term),
b_n AS (SELECT count(*) AS n, (SELECT sum(len) FROM (SELECT doc_id, any_value(len) AS len FROM b_tf GROUP BY doc_id)) AS total FROM documents),
b_df AS (SELECT term, count(*) AS df FROM b_tf GROUP BY term),
b_q AS (SELECT DISTINCT item_id, unnest({tokens("coalesce(text, '')")}) AS term FROM benchmark),
b_s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / (total / n)))), 6) AS score
  FROM b_q JOIN b_tf USING (term) JOIN b_df USING (term), b_n GROUP BY item_id, doc_id),
{name} AS (SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM b_s) WHERE rank <= {k})"""


def dense(name: str, k: int = 12) -> str:
    """CTEs that end in ``{name}(item_id, doc_id, score, rank)`` by hash embeddings."""
    return f"""{embedding('d', 'documents', 'doc_id')}, {embedding('q', 'benchmark', 'item_id')},
h_s AS (SELECT qe.k AS item_id, de.k AS doc_id, round(sum(qe.v * de.v), 6) AS score FROM qe JOIN de USING (idx) GROUP BY qe.k, de.k),
{name} AS (SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM h_s) WHERE rank <= {k})"""


def fused(name: str, k: int = 8) -> str:
    """CTEs that end in ``{name}(item_id, doc_id, dense_rank, sparse_rank, rrf, rank)``."""
    return f"""{bm25('sparse')}, {dense('near')},
f_s AS (SELECT item_id, doc_id, n.rank AS dense_rank, s.rank AS sparse_rank, round(coalesce(1::DOUBLE / (60 + n.rank), 0) + coalesce(1::DOUBLE / (60 + s.rank), 0), 8) AS rrf FROM near n FULL JOIN sparse s USING (item_id, doc_id)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id)::INT AS rank FROM f_s) WHERE rank <= {k})"""
