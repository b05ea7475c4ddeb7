"""The text rules as SQL expressions for DuckDB, from the same constants."""

from __future__ import annotations

import re

from regelspur.functions import replies, titles
from regelspur.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(expr: str, pattern: str, replacement: str) -> str:
    """Replace everywhere; references are written with a backslash there."""
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(re.sub(r'\$(\d)', r'\\\1', replacement))}, 'g')"


def chain(expr: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, replacement in steps:
        expr = sub(expr, pattern, replacement)
    return expr


def strip(expr: str) -> str:
    return sub(expr, f"^{T.WS}+|{T.WS}+\\z", "")


def clean(expr: str) -> str:
    return chain(expr, T.CLEAN)


def normalise(expr: str) -> str:
    return sub(sub(f"lower({chain(expr, T.NORMALISE)})", T.WS + "+", " "), "^ | \\z", "")


def letters(expr: str) -> str:
    return f"length({sub(expr, r'[^\p{L}]', '')})"


def is_boilerplate(expr: str, kind: str) -> str:
    bare = strip(expr)
    return (
        f"CASE WHEN length(coalesce({bare}, '')) = 0 THEN true WHEN regexp_matches({expr}, {lit(T.LEADERS)}) OR regexp_matches({bare}, {lit(T.IMPRINT)}) THEN true "
        f"WHEN coalesce({kind}, '') = 'Table' THEN false ELSE {letters(bare)}::DOUBLE / length({bare}) < 0.35 END"
    )


def tokenize(expr: str) -> str:
    return f"regexp_extract_all({sub(normalise(expr), *T.PARAGRAPH_SIGN)}, {lit(T.TERM)}, 1)"


def analyse(expr: str) -> str:
    stop = ", ".join(map(lit, T.STOPWORDS))
    return f"list_filter({tokenize(expr)}, lambda t: length(t) >= 2 AND t NOT IN ({stop}))"


def tokens(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(T.TOKEN)}))"


def heading(expr: str) -> str:
    return f"regexp_matches({expr}, {lit(T.HEADING)})"


def chunk_id(source: str, page: str, kind: str, text: str) -> str:
    return f"substr(sha256({source} || '|' || coalesce({page}::VARCHAR, 'None') || '|' || {kind} || '|' || {text}), 1, 16)"


def trim(expr: str, chars: str) -> str:
    return sub(expr, f"^[{chars}]+|[{chars}]+\\z", "")


def tidy(expr: str) -> str:
    flat = trim(sub(sub(expr, titles.QUOTES, ""), T.WS + "+", " "), " \\-–")
    return flat


def citation_names(expr: str) -> str:
    return f"regexp_extract_all({expr}, {lit(replies.CITATION)}, 1)"


#: Blocks of the documents table, cleaned and accepted: (source_file, elem_idx, text, page_number).
ELEMENTS = f"""
  raw AS (SELECT 'doc-' || doc_id AS source_file, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS parts FROM documents WHERE text IS NOT NULL),
  blocks AS (SELECT source_file, i - 1 AS elem_idx, {clean('parts[i]')} AS text, ((i - 1) // 4 + 1)::INTEGER AS page_number
             FROM raw, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
  elements AS (SELECT * FROM blocks WHERE length(text) > 0 AND NOT ({is_boilerplate('text', "'NarrativeText'")}))"""

#: C1 as a recursion over the blocks of a document: (source_file, elem_idx, chunk_no, text, page_number).
ASSIGN = f"""{ELEMENTS},
  sized AS (SELECT source_file, elem_idx, text, page_number, row_number() OVER (PARTITION BY source_file ORDER BY elem_idx) AS i,
                   {tokens('text')} AS tk, length(text) AS ch, {heading('text')} AS hd FROM elements),
  fold AS (
    SELECT source_file, i, 0 AS cn, CASE WHEN tk > 600 THEN 1 ELSE 0 END AS no, CASE WHEN tk > 600 THEN 0 ELSE 1 END AS n,
           CASE WHEN tk > 600 THEN 0 ELSE tk END AS bt, CASE WHEN tk > 600 THEN 0 ELSE ch END AS bc FROM sized WHERE i = 1
    UNION ALL
    SELECT source_file, i, cn, cn + CASE WHEN bt2 > 600 THEN 1 ELSE 0 END, CASE WHEN bt2 > 600 THEN 0 ELSE 1 END,
           CASE WHEN bt2 > 600 THEN 0 ELSE bt2 END, CASE WHEN bt2 > 600 THEN 0 ELSE bc2 END
    FROM (SELECT s.source_file, s.i, f.no + (CASE WHEN brk THEN 1 ELSE 0 END) AS cn, (CASE WHEN brk THEN 0 ELSE f.bt END) + s.tk AS bt2,
                 (CASE WHEN brk THEN 0 ELSE f.bc END) + s.ch AS bc2
          FROM (SELECT f0.*, s0.tk AS stk, s0.hd AS shd, (f0.n > 0 AND (f0.bt + s0.tk > 600 OR (s0.hd AND f0.bc >= 300))) AS brk
                FROM fold f0 JOIN sized s0 ON s0.source_file = f0.source_file AND s0.i = f0.i + 1) f
          JOIN sized s ON s.source_file = f.source_file AND s.i = f.i + 1)
  ),
  assigned AS (SELECT s.source_file, s.elem_idx, f.cn AS chunk_no, s.text, s.page_number FROM sized s JOIN fold f USING (source_file, i))"""

#: C1 assembled: (source_file, chunk_no, text, page_number, page_end).
FOLDED = f"""{ASSIGN},
  folded AS (SELECT source_file, chunk_no, string_agg(text, chr(10) || chr(10) ORDER BY elem_idx) AS text,
                    arg_min(nullif(page_number, 0), elem_idx) AS page_number, max(nullif(page_number, 0)) AS page_end FROM assigned GROUP BY ALL)"""

#: C2 as a second recursion: (source_file, chunk_no, group_no, ...).
MERGED = f"""{FOLDED},
  lens AS (SELECT *, length(text) AS x, row_number() OVER (PARTITION BY source_file ORDER BY chunk_no) AS j FROM folded),
  fold2 AS (
    SELECT source_file, j, 0 AS own, CASE WHEN x < 300 THEN 0 ELSE 1 END AS g, CASE WHEN x < 300 THEN x END AS p FROM lens WHERE j = 1
    UNION ALL
    SELECT l.source_file, l.j, f.g, CASE WHEN coalesce(f.p + 2, 0) + l.x < 300 THEN f.g ELSE f.g + 1 END,
           CASE WHEN coalesce(f.p + 2, 0) + l.x < 300 THEN coalesce(f.p + 2, 0) + l.x END
    FROM fold2 f JOIN lens l ON l.source_file = f.source_file AND l.j = f.j + 1
  ),
  ends AS (SELECT source_file, arg_max(g, j) AS g, max(j) AS last, arg_max(CASE WHEN p IS NULL THEN 0 ELSE 1 END, j) AS rest FROM fold2 GROUP BY 1),
  grouped AS (SELECT l.source_file, l.chunk_no, CASE WHEN e.rest = 1 AND e.g > 0 THEN least(f.own, e.g - 1) ELSE f.own END AS group_no,
                     l.text, l.page_number, l.page_end
              FROM lens l JOIN fold2 f ON f.source_file = l.source_file AND f.j = l.j JOIN ends e ON e.source_file = l.source_file)"""

#: The passages indexed: one a chunk_id, the first exported.
FIRST = "passages AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY coalesce(chunk_id, chr(0) || position) ORDER BY position) = 1)"

#: Postings and statistics over the passages.
INDEX = f"""{FIRST},
  analysed AS (SELECT chunk_id, {analyse("coalesce(text, '')")} AS terms FROM passages),
  doc_stats AS (SELECT chunk_id, len(terms) AS dl FROM analysed),
  postings AS (SELECT term, chunk_id, count(*)::INTEGER AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM analysed) GROUP BY ALL),
  corpus AS (SELECT count(*) AS n, coalesce(avg(dl), 0.0) AS avgdl FROM doc_stats),
  term_stats AS (SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1), corpus)"""

#: The questions asked: every twentieth entry.
ASKED = "asked AS (SELECT qid, question FROM queries WHERE regexp_extract(qid, '([0-9]+)', 1)::BIGINT % 20 = 0)"

#: BM25 over them to depth 20: (qid, rank, chunk_id, score).
BM25 = f"""{INDEX}, {ASKED},
  wanted AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({analyse('question')}) AS term FROM asked) GROUP BY ALL),
  scored AS (SELECT qid, p.chunk_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
             FROM wanted JOIN term_stats USING (term) JOIN postings p USING (term) JOIN doc_stats USING (chunk_id), corpus GROUP BY ALL),
  bm25 AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INTEGER AS rank, chunk_id, score FROM scored QUALIFY rank <= 20)"""

#: A second ranking: the share of a question's distinct terms that a passage holds.
OVERLAP = f"""{BM25},
  sizes AS (SELECT qid, count(*) AS size FROM wanted GROUP BY 1),
  shared AS (SELECT qid, p.chunk_id, round(count(*)::DOUBLE / any_value(size), 6) AS score FROM wanted JOIN postings p USING (term) JOIN sizes USING (qid) GROUP BY ALL),
  overlap AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INTEGER AS rank, chunk_id, score FROM shared QUALIFY rank <= 20)"""

FUSED = f"""{OVERLAP},
  both_lists AS (SELECT *, 0 AS branch FROM bm25 UNION ALL SELECT *, 1 AS branch FROM overlap),
  fused AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, max(score) FILTER (branch = 0) AS score_branch_0, max(rank) FILTER (branch = 0) AS rank_branch_0,
                   max(score) FILTER (branch = 1) AS score_branch_1, max(rank) FILTER (branch = 1) AS rank_branch_1 FROM both_lists GROUP BY ALL),
  rrf AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INTEGER AS rank, chunk_id, score, score_branch_0, rank_branch_0, score_branch_1, rank_branch_1 FROM fused)"""

#: One row a gold entry (repeated ones once) and form.
GOLD = "gold AS (SELECT * FROM goldset QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_id) = 1)"
