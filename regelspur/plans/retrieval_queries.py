"""Queries on the index, retrieval, fusion, evaluation, gold set, answers and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regelspur.config import RetrievalConfig
from regelspur.functions import replies
from regelspur.functions import text as T
from regelspur.operators import answers, chunking, compare, dense, evaluation, fusion, goldset, lexical, metrics, retrievers
from regelspur.plans import sql as S
from regelspur.plans.text_queries import table
from regelspur.session import cut, fits, shared_dir
from regelspur.sources import elements, tables
from regelspur.sources.store import upserted

#: Anchor terms up to which they are broadcast to the passages; beyond it the planner chooses.
BROADCAST_ANCHORS = 1000


def passages(spark, sf) -> DataFrame:
    return chunking.dedupe_first(table(spark, sf, "chunks").where("NOT (type <=> 'Image')"))


def _texts(spark, sf) -> DataFrame:
    """The same passages for searches: only rows of repeated keys are shuffled."""
    return chunking.first_of_each(table(spark, sf, "chunks").where("NOT (type <=> 'Image')"))


def asked(spark, sf) -> DataFrame:
    """The stated query set of searches: the questions of every entry whose number is divisible by 20."""
    return table(spark, sf, "queries").where(F.regexp_extract("qid", "([0-9]+)", 1).cast("long") % 20 == 0)


def entries(spark, sf) -> DataFrame:
    """Gold entries, repeated ones once."""
    return chunking.dedupe_first(table(spark, sf, "goldset"), "id", "chunk_id")


def postings(spark, sf):
    return lexical.build_index(passages(spark, sf)).postings


def doc_stats(spark, sf):
    return lexical.build_index(passages(spark, sf)).doc_stats.select("chunk_id", F.col("dl").cast("long").alias("dl"))


def term_stats(spark, sf):
    return lexical.build_index(passages(spark, sf)).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(spark, sf):
    return lexical.build_index(passages(spark, sf)).corpus_stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def _index(spark, sf):
    return lexical.build_index(_texts(spark, sf))


def _bm25(spark, sf, k=20):
    return lexical.search(_index(spark, sf), asked(spark, sf), k, decimals=6)


def bm25_topk(spark, sf):
    return _bm25(spark, sf)


def overlap_topk(spark, sf):
    return lexical.overlap(_index(spark, sf), asked(spark, sf), 20)


def rrf_fusion(spark, sf):
    index, questions = _index(spark, sf), asked(spark, sf)
    return fusion.reciprocal_rank_fusion([lexical.search(index, questions, 20, decimals=6), lexical.overlap(index, questions, 20)], decimals=6)


def hybrid_topk(spark, sf):
    return rrf_fusion(spark, sf).where("rank <= 5").select("qid", "rank", "chunk_id", "score")


def dense_hybrid_topk(spark, sf):
    """Nearest passages by embedding and BM25, both to depth 20, fused by rank."""
    texts = _texts(spark, sf)
    vectors = dense.embed(texts.where("text is not null").select("chunk_id", "text"), "text", dense.HashingEmbedder()).select("chunk_id", "embedding")
    near = retrievers.DenseRetriever(vectors, dense.HashingEmbedder(), decimals=6)
    both = retrievers.HybridRetriever(near, retrievers.LexicalRetriever(lexical.build_index(texts), decimals=6), decimals=6)
    return both.retrieve(asked(spark, sf), 5).select("qid", "rank", "chunk_id", "score")


def rerank_topk(spark, sf):
    return fusion.rerank(_bm25(spark, sf), asked(spark, sf), passages(spark, sf), 5, decimals=6)


def dense_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_embedding"))
    found = dense.nearest(vectors, "vec_id", "embedding", queries, "qid", "query_embedding", 10, self_match=False)
    return found.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def hashing_embed(spark, sf):
    """The components that are not 0, to six digits."""
    made = dense.embed(passages(spark, sf).select("chunk_id", "text"), "text", dense.HashingEmbedder())
    return made.select("chunk_id", F.posexplode("embedding").alias("component", "v")).select("chunk_id", "component", F.round(F.col("v").cast("double"), 6).alias("value")).where("value <> 0")


def upsert_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    middle = F.col("vec_id") % 3
    old, new = e.where(middle != 0), e.where(middle != 1).withColumn("label", F.col("label") + 1000)
    return upserted(old, new, "vec_id").select("vec_id", "label")


def usable_chunks(spark, sf):
    return table(spark, sf, "chunks").where(goldset.is_usable(F.col("type"), F.col("text"))).select("position", "chunk_id")


def stratified_sample(spark, sf):
    usable = passages(spark, sf).where(goldset.is_usable(F.col("type"), F.col("text")))
    return goldset.stratified_sample(usable, 5, 42).select("source_file", "chunk_id")


def gold_exclude(spark, sf):
    return goldset.exclude_used(passages(spark, sf), table(spark, sf, "goldset")).select("chunk_id")


def gold_validate(spark, sf):
    gold = entries(spark, sf).select("id", "chunk_id", "question_colloquial", "question_precise", "answer_snippet")
    joined = gold.join(passages(spark, sf).select("chunk_id", "text"), "chunk_id")
    why = goldset.problem(F.col("question_colloquial"), F.col("question_precise"), F.col("answer_snippet"), F.col("text"))
    return joined.select("id", F.coalesce(why, F.lit("sound")).alias("problem"))


def gold_generate(spark, sf):
    return goldset.new_entries(passages(spark, sf), table(spark, sf, "goldset")).select("id", "chunk_id", "source_file", "question_colloquial", "answer_snippet")


def question_forms(spark, sf):
    return evaluation.unpivot(entries(spark, sf)).select("id", "variant", "question")


def _judged(spark, sf):
    questions = evaluation.unpivot(entries(spark, sf)).join(asked(spark, sf).select("qid"), "qid", "left_semi")
    texts = _texts(spark, sf)
    found = lexical.with_passages(lexical.search(lexical.build_index(texts), asked(spark, sf), 20, decimals=6), texts)
    # used several times, and judged once
    return questions, cut(metrics.hits(found, questions).drop("text", "type"), "judged")


def relevance_hits(spark, sf):
    return _judged(spark, sf)[1].select("qid", "rank", "chunk_id", "hit")


def first_hit_rank(spark, sf):
    return metrics.first_hits(*_judged(spark, sf))


def misses(spark, sf):
    return evaluation.misses(*_judged(spark, sf)).select("qid", "expected", "retrieved")


def recall_mrr_ndcg(spark, sf):
    return evaluation.variant_metrics(table(spark, sf, "per_question"))


def _files(spark, sf):
    return entries(spark, sf).select("id", "source_file")


def per_document_recall(spark, sf):
    return evaluation.per_document_recall(table(spark, sf, "per_question"), _files(spark, sf))


def per_document_pivot(spark, sf):
    return evaluation.per_document_pivot(per_document_recall(spark, sf))


def mcnemar(spark, sf):
    log = table(spark, sf, "per_question")
    return compare.mcnemar(log, "dicht", "misch_rang").select("variant", "measure", "questions", "fixed", "broken", "net", "p_value", "significant")


def abstention_rollup(spark, sf):
    """An unanswerable question abstains if no passage holds its anchor term; all are searched, however many."""
    rows = table(spark, sf, "unanswerable")
    anchors = rows.select("id", F.lower("anchor_term").alias("a"))
    anchors = F.broadcast(anchors) if fits(anchors, BROADCAST_ANCHORS) else anchors
    held = passages(spark, sf).select(T.normalise(F.col("text")).alias("n")).join(anchors, F.contains(F.col("n"), F.col("a"))).select("id").distinct()
    judged = rows.join(held.withColumn("held", F.lit(True)), "id", "left").select("category", F.col("held").isNull().alias("abstained"))
    return evaluation.abstention(judged)


def _replies(spark, sf):
    """Replies made from the gold set: the snippet and a citation; every third one a refusal that cites all the same."""
    g = entries(spark, sf)
    third = F.regexp_extract("id", "([0-9]+)", 1).cast("long") % 3 == 0
    bare = F.regexp_replace("source_file", F.lit(r"\.pdf$"), F.lit(""))
    cite = F.concat(F.lit(" ["), F.when(third, F.col("source_file")).otherwise(bare), F.lit(" , Seite "), F.coalesce(F.col("page_number"), F.lit(0)).cast("string"), F.lit("]"))
    text = F.concat(F.when(third, F.lit("[KEINE_ANTWORT] ")).otherwise(F.lit("")), F.coalesce("answer_snippet", F.lit("")), cite)
    return g.select(F.col("id").alias("qid"), "source_file", "page_number", "chunk_id", text.alias("answer"))


def parse_citations(spark, sf):
    found = _replies(spark, sf).select("qid", F.explode(replies.citations(F.col("answer"))).alias("c"))
    return found.select("qid", F.col("c.file").alias("file"), F.col("c.page").alias("page"))


def refusal_split(spark, sf):
    a = F.col("answer")
    return _replies(spark, sf).select("qid", replies.is_refusal(a).alias("refused"), replies.without_refusal(a).alias("shown"))


def build_sources(spark, sf):
    made = _replies(spark, sf)
    retrieved = made.select("qid", "source_file", "page_number").unionByName(made.select("qid", "source_file", (F.col("page_number") + 1).alias("page_number")))
    return answers.build_sources(retrieved, table(spark, sf, "titles"), made.select("qid", "answer"))


def build_context(spark, sf):
    found = lexical.with_passages(_bm25(spark, sf, 5), passages(spark, sf))
    return answers.build_context(found).select("qid", F.md5("context").alias("context_md5"))


def answer_offline(spark, sf):
    texts, questions = _texts(spark, sf), asked(spark, sf)
    done = answers.answer(questions, lexical.search(lexical.build_index(texts), questions, 20, decimals=6), texts, table(spark, sf, "titles"))
    return done.select("qid", "answer", "abstained", F.size("sources").alias("sources"))


def _round_trip(df, write, read):
    """What is read again of what was written to the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/regelspur/trip-{uuid.uuid4().hex}"
    write(df, path)
    return read(df.sparkSession, path)


def chunks_round_trip(spark, sf):
    kept = _round_trip(table(spark, sf, "chunks"), lambda d, p: tables.write_chunks(d, p + ".jsonl"), lambda s, p: tables.read_chunks(s, p + ".jsonl"))
    return kept.select("chunk_id", "source_file", "page_number", "type", F.md5("text").alias("text_md5"))


def goldset_scan(spark, sf):
    return tables.read_goldset(spark, f"{sf}/goldset.parquet").select("id", "chunk_id", "page_number", "question_precise")


def unanswerable_scan(spark, sf):
    return tables.read_unanswerable(spark, f"{sf}/unanswerable.parquet").select("id", "question", "category")


def results_round_trip(spark, sf):
    return _round_trip(table(spark, sf, "per_question"), tables.write_results, lambda s, p: tables.read_results(s, p, "dicht")).select("config", "variant", "id", "rank")


def titles_map(spark, sf):
    paths = table(spark, sf, "titles").select(F.concat(F.lit("/a/"), "source_file").alias("path"), "title")
    other = paths.select(F.concat(F.lit("/b"), "path").alias("path"), F.concat(F.lit("neu "), "title").alias("title"))
    return tables.build_titles(paths.unionByName(other))


def no_overlap(spark, sf):
    """Passages as blocks with rectangles: what a table of its page overlaps is left out."""
    at = F.col("position") % 7
    c = table(spark, sf, "chunks").select("position", "source_file", "page_number", "type", F.lit(0.0).alias("x0"), at.cast("double").alias("y0"), F.lit(1.0).alias("x1"), (at + 2).cast("double").alias("y1"))
    return elements.without_overlap(c).select("position", "type")


def table_passages(spark, sf):
    """Tables become passages of their own, beside those folded of text."""
    c = table(spark, sf, "chunks").select("source_file", F.col("position").alias("elem_idx"), "type", "text", "page_number")
    return chunking.build_chunks(c).where("type = 'Table'").select("source_file", "seq", "page_number", "page_end", "chunk_id")


def question_log(spark, sf):
    questions, judged = _judged(spark, sf)
    return evaluation.per_question(questions, judged, RetrievalConfig("bm25"))


NAMES = "chunks_round_trip goldset_scan unanswerable_scan results_round_trip titles_map no_overlap table_passages question_log postings doc_stats term_stats corpus_stats bm25_topk overlap_topk rrf_fusion hybrid_topk dense_hybrid_topk rerank_topk dense_topk hashing_embed upsert_vectors usable_chunks stratified_sample gold_exclude gold_validate gold_generate question_forms relevance_hits first_hit_rank misses recall_mrr_ndcg per_document_recall per_document_pivot mcnemar abstention_rollup parse_citations refusal_split build_sources build_context answer_offline".split()

_USABLE = f"type IN ('NarrativeText', 'Table') AND length(text) >= 300 AND NOT regexp_matches(text, {S.lit(T.LEADERS)}) AND {S.letters('text')}::DOUBLE / length(text) > 0.55"
_N, _NS = S.normalise("coalesce(text, '')"), S.normalise("answer_snippet")
_FORMS = f"""{S.GOLD}, forms AS (SELECT id, 'colloquial' AS variant, question_colloquial AS question, id || '-c' AS qid, source_file, page_number, answer_snippet FROM gold
      UNION ALL SELECT id, 'precise', question_precise, id || '-p', source_file, page_number, answer_snippet FROM gold)"""
_JUDGED = f"""{S.BM25}, {_FORMS}, asked_forms AS (SELECT * FROM forms WHERE qid IN (SELECT qid FROM asked)),
      judged AS (SELECT b.qid, b.rank, b.chunk_id, p.source_file, p.page_number,
                 coalesce(p.source_file = f.source_file AND (p.page_number IS NOT DISTINCT FROM f.page_number OR ({S.normalise("coalesce(f.answer_snippet, '')")} <> '' AND contains({S.normalise("coalesce(p.text, '')")}, {S.normalise("coalesce(f.answer_snippet, '')")}))), false) AS hit
                 FROM bm25 b JOIN passages p USING (chunk_id) JOIN asked_forms f USING (qid)),
      firsts AS (SELECT f.qid, j.rank FROM asked_forms f LEFT JOIN (SELECT qid, min(rank) FILTER (hit) AS rank FROM judged GROUP BY 1) j USING (qid))"""
_LOG = "log AS (SELECT DISTINCT config, variant, id, rank FROM per_question)"
_RECALL = f"""{_LOG}, {S.GOLD}, recall AS (SELECT config, variant, source_file, count(*) AS questions, round(coalesce(avg(coalesce((rank <= 5)::INTEGER::DOUBLE, 0)), 0), 6) AS recall FROM log JOIN gold USING (id) GROUP BY ALL)"""
_REPLIES = f"""{S.GOLD}, replies AS (SELECT id AS qid, source_file, page_number,
      CASE WHEN third THEN '[KEINE_ANTWORT] ' ELSE '' END || coalesce(answer_snippet, '') || ' [' || CASE WHEN third THEN source_file ELSE regexp_replace(source_file, '\\.pdf$', '') END || ' , Seite ' || coalesce(page_number, 0) || ']' AS answer
      FROM (SELECT *, regexp_extract(id, '([0-9]+)', 1)::BIGINT % 3 = 0 AS third FROM gold))"""
_CITED = f"""{_REPLIES}, cites AS (SELECT qid, {S.strip('n')} AS name, p::INTEGER AS page FROM (SELECT qid, unnest({S.citation_names('answer')}) AS n, unnest(regexp_extract_all(answer, {S.lit(replies.CITATION)}, 2)) AS p FROM replies)),
      cited AS (SELECT DISTINCT qid, CASE WHEN lower(name) LIKE '%.pdf' THEN name ELSE name || '.pdf' END AS file, page FROM cites)"""

#: The offline embeddings, a row a component: (chunk_id, component, value) and (qid, component, value).
def _embedded(name: str, rows: str, key: str, text: str) -> str:
    return f"""{name}_words AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-zäöüß0-9]+')) AS w FROM {rows} WHERE {text} IS NOT NULL),
      {name}_sums AS (SELECT {key}, (('0x' || substr(md5(w), 1, 4))::INTEGER % 64)::INTEGER AS component, sum(CASE WHEN ('0x' || substr(md5(w), 5, 2))::INTEGER >= 128 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_words GROUP BY ALL),
      {name} AS (SELECT {key}, component, round(v / sqrt(sum(v * v) OVER (PARTITION BY {key})), 6) AS value FROM {name}_sums WHERE v <> 0)"""


_HYBRID = f"""{S.BM25}, {_embedded('pv', 'passages', 'chunk_id', 'text')}, {_embedded('qv', 'asked', 'qid', 'question')},
      dots AS (SELECT qid, chunk_id, sum(a.value * b.value) AS dot FROM qv a JOIN pv b USING (component) GROUP BY ALL),
      near AS (SELECT q.qid, row_number() OVER (PARTITION BY q.qid ORDER BY round(coalesce(dot, 0), 6) DESC, p.chunk_id) AS rank, p.chunk_id
               FROM (SELECT qid FROM asked WHERE question IS NOT NULL) q CROSS JOIN (SELECT chunk_id FROM passages WHERE text IS NOT NULL) p LEFT JOIN dots d ON d.qid = q.qid AND d.chunk_id = p.chunk_id QUALIFY rank <= 20),
      both_near AS (SELECT qid, chunk_id, rank FROM near UNION ALL SELECT qid, chunk_id, rank FROM bm25),
      fused_near AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM both_near GROUP BY ALL)"""
_LONGEST = f"list_sort(list_transform({S.analyse('text')}, lambda t: {{'n': -length(t), 't': t}}))[1].t"
_GENERATED = f"""{S.FIRST}, used AS (SELECT DISTINCT chunk_id FROM goldset WHERE chunk_id IS NOT NULL),
      picked AS (SELECT * FROM passages WHERE {_USABLE} AND chunk_id NOT IN (SELECT chunk_id FROM used) QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY md5('42|' || chunk_id), chunk_id, position) <= 5),
      said AS (SELECT *, {_LONGEST} AS longest, array_to_string(regexp_split_to_array({S.strip('text')}, {S.lit(T.WS + '+')})[1:8], ' ') AS answer_snippet FROM picked),
      kept AS (SELECT *, 'Was gilt eigentlich für ' || longest || '?' AS question_colloquial FROM said WHERE longest IS NOT NULL AND len(list_filter(regexp_split_to_array(answer_snippet, {S.lit(T.WS + '+')}), lambda w: w <> '')) >= 4 AND contains({_N}, {_NS})),
      last AS (SELECT coalesce(max(try_cast(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT)), 0) AS n FROM goldset)"""
_BEST = f"""{S.BM25}, five AS (SELECT qid, rank, text, source_file, page_number FROM bm25 JOIN passages USING (chunk_id) WHERE rank <= 5),
      terms AS (SELECT qid, list_distinct({S.analyse('question')}) AS ts FROM asked),
      sentences AS (SELECT qid, rank, source_file, page_number, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM five),
      shares AS (SELECT qid, rank, source_file, page_number, s, len(list_intersect(ts, {S.analyse('s')}))::DOUBLE / nullif(len(ts), 0) AS v FROM sentences JOIN terms USING (qid)),
      best AS (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v DESC NULLS LAST, rank, s DESC, source_file DESC NULLS LAST, page_number DESC NULLS LAST) = 1),
      raw AS (SELECT a.qid, CASE WHEN b.qid IS NULL THEN NULL WHEN v >= 0.5 THEN s || ' [' || coalesce(source_file, '?') || ', Seite ' || coalesce(page_number::VARCHAR, '?') || ']'
                     ELSE '{replies.REFUSAL_TOKEN} Der Kontext beantwortet die Frage nicht.' END AS answer FROM asked a LEFT JOIN best b USING (qid)),
      refusals AS (SELECT *, answer IS NULL OR regexp_matches(answer, {S.lit(replies.REFUSAL)}) AS abstained FROM raw),
      cites AS (SELECT qid, {S.strip('n')} AS name, try_cast(p AS INTEGER) AS page FROM (SELECT qid, unnest({S.citation_names('answer')}) AS n, unnest(regexp_extract_all(answer, {S.lit(replies.CITATION)}, 2)) AS p FROM refusals WHERE NOT abstained)),
      cited AS (SELECT DISTINCT qid, CASE WHEN lower(name) LIKE '%.pdf' THEN name ELSE name || '.pdf' END AS file, page FROM cites),
      counted AS (SELECT f.qid, count(DISTINCT (source_file, page_number)) AS sources FROM five f JOIN cited c ON c.qid = f.qid AND c.file = f.source_file AND c.page = f.page_number GROUP BY 1)"""

ORACLE = {
    "dense_hybrid_topk": f"WITH {_HYBRID} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)::INTEGER AS rank, chunk_id, score FROM fused_near QUALIFY rank <= 5",
    "chunks_round_trip": "SELECT chunk_id, source_file, page_number, type, md5(text) AS text_md5 FROM chunks WHERE type IS DISTINCT FROM 'Image'",
    "goldset_scan": "SELECT id, chunk_id, page_number, question_precise FROM goldset",
    "unanswerable_scan": "SELECT id, question, category FROM unanswerable",
    "results_round_trip": "SELECT config, variant, id, rank FROM per_question WHERE config = 'dicht'",
    "titles_map": "SELECT source_file, 'neu ' || title AS title FROM titles",
    "no_overlap": """WITH r AS (SELECT *, position % 7 AS y FROM chunks) SELECT position, type FROM r a WHERE NOT EXISTS
      (SELECT 1 FROM r t WHERE t.type = 'Table' AND a.type <> 'Table' AND t.source_file = a.source_file AND t.page_number = a.page_number AND a.y < t.y + 2 AND a.y + 2 > t.y)""",
    "table_passages": f"""SELECT source_file, position AS seq, page_number, page_number AS page_end, {S.chunk_id('source_file', 'page_number', 'type', 'text')} AS chunk_id FROM chunks WHERE type = 'Table' AND length(text) > 0""",
    "question_log": f"""WITH {_JUDGED} SELECT 'bm25' AS config, f.variant, f.id, coalesce(r.rank <= 5, false) AS hit_at_5, coalesce(r.rank <= 20, false) AS hit_at_20, r.rank FROM asked_forms f JOIN firsts r USING (qid)""",
    "hashing_embed": f"WITH {S.FIRST}, {_embedded('pv', 'passages', 'chunk_id', 'text')} SELECT chunk_id, component, value FROM pv WHERE value <> 0",
    "gold_generate": f"""WITH {_GENERATED} SELECT 'gold-' || lpad((n + row_number() OVER (ORDER BY source_file, coalesce(page_number, 0), chunk_id))::VARCHAR, greatest(3, length((n + row_number() OVER (ORDER BY source_file, coalesce(page_number, 0), chunk_id))::VARCHAR))::INTEGER, '0') AS id,
      chunk_id, source_file, question_colloquial, answer_snippet FROM kept, last""",
    "answer_offline": f"""WITH {_BEST} SELECT qid, CASE WHEN answer IS NULL THEN '{replies.NO_PASSAGE}' WHEN abstained THEN {S.strip(S.sub('answer', replies.REFUSAL, ''))} ELSE answer END AS answer, abstained, coalesce(sources, 0)::INTEGER AS sources
      FROM refusals LEFT JOIN counted USING (qid)""",
    "postings": f"WITH {S.INDEX} SELECT term, chunk_id, tf FROM postings",
    "doc_stats": f"WITH {S.INDEX} SELECT chunk_id, dl::BIGINT AS dl FROM doc_stats",
    "term_stats": f"WITH {S.INDEX} SELECT term, df, round(idf, 6) AS idf FROM term_stats",
    "corpus_stats": f"WITH {S.INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM corpus",
    "bm25_topk": f"WITH {S.BM25} SELECT * FROM bm25",
    "overlap_topk": f"WITH {S.OVERLAP} SELECT * FROM overlap",
    "rrf_fusion": f"WITH {S.FUSED} SELECT * FROM rrf",
    "hybrid_topk": f"WITH {S.FUSED} SELECT qid, rank, chunk_id, score FROM rrf WHERE rank <= 5",
    "rerank_topk": f"""WITH {S.OVERLAP}, pool AS (SELECT b.qid, b.chunk_id, b.rank AS base_rank, b.score AS dense_score, coalesce(s.score, 0) AS score FROM bm25 b LEFT JOIN shared s USING (qid, chunk_id))
      SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, base_rank)::INTEGER AS rank, chunk_id, score, dense_score FROM pool QUALIFY rank <= 5""",
    "dense_topk": """SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id)::INTEGER AS rank,
      b.vec_id AS vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10""",
    "upsert_vectors": """SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 1)
      UNION ALL SELECT vec_id, label + 1000 AS label FROM embeddings WHERE vec_id % 3 <> 1""",
    "usable_chunks": f"SELECT position, chunk_id FROM chunks WHERE {_USABLE}",
    "stratified_sample": f"""WITH {S.FIRST} SELECT source_file, chunk_id FROM passages WHERE {_USABLE} QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY md5('42|' || chunk_id), chunk_id, position) <= 5""",
    "gold_exclude": f"WITH {S.FIRST} SELECT chunk_id FROM passages WHERE chunk_id NOT IN (SELECT chunk_id FROM goldset WHERE chunk_id IS NOT NULL)",
    "gold_validate": f"""WITH {S.FIRST}, {S.GOLD} SELECT id, CASE WHEN coalesce(question_colloquial, '') = '' OR coalesce(question_precise, '') = '' THEN 'missing question' WHEN coalesce(answer_snippet, '') = '' THEN 'missing snippet'
      WHEN len(list_filter(regexp_split_to_array(answer_snippet, {S.lit(T.WS + '+')}), lambda w: w <> '')) < 4 THEN 'snippet too short to be evidence'
      WHEN NOT contains({_N}, {_NS}) THEN 'snippet not found verbatim in the chunk' WHEN question_colloquial = question_precise THEN 'both questions are identical' ELSE 'sound' END AS problem
      FROM gold JOIN (SELECT chunk_id, text FROM passages) USING (chunk_id)""",
    "question_forms": f"WITH {_FORMS} SELECT id, variant, question FROM forms",
    "relevance_hits": f"WITH {_JUDGED} SELECT qid, rank, chunk_id, hit FROM judged",
    "first_hit_rank": f"WITH {_JUDGED} SELECT qid, rank FROM firsts",
    "misses": f"""WITH {_JUDGED}, tops AS (SELECT qid, string_agg(source_file || ' p.' || coalesce(page_number::VARCHAR, 'None'), '; ' ORDER BY rank) AS retrieved FROM judged WHERE rank <= 3 GROUP BY 1)
      SELECT f.qid, f.source_file || ' p.' || coalesce(f.page_number::VARCHAR, 'None') AS expected, coalesce(retrieved, '') AS retrieved FROM asked_forms f JOIN firsts USING (qid) LEFT JOIN tops USING (qid) WHERE rank IS NULL""",
    "recall_mrr_ndcg": f"""WITH {_LOG} SELECT config, variant, count(*) AS questions, round(avg(coalesce((rank <= 5)::INTEGER::DOUBLE, 0)), 6) AS recall_at_5, round(avg(coalesce((rank <= 20)::INTEGER::DOUBLE, 0)), 6) AS recall_at_20,
      round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg_at_5, count(*) FILTER (rank IS NULL) AS no_hit FROM log GROUP BY ALL""",
    "per_document_recall": f"WITH {_RECALL} SELECT * FROM recall",
    "per_document_pivot": f"""WITH {_RECALL} SELECT config, source_file, coalesce(max(recall) FILTER (variant = 'colloquial'), 0) AS colloquial, coalesce(max(recall) FILTER (variant = 'precise'), 0) AS precise FROM recall GROUP BY ALL""",
    "mcnemar": """WITH RECURSIVE long AS (SELECT config, variant, id, 'hit_at_5' AS measure, bool_or(hit_at_5) AS hit FROM per_question GROUP BY ALL UNION ALL SELECT config, variant, id, 'hit_at_20', bool_or(hit_at_20) FROM per_question GROUP BY ALL),
      counts AS (SELECT variant, measure, count(*) AS questions, count(*) FILTER (NOT a.hit AND b.hit) AS fixed, count(*) FILTER (a.hit AND NOT b.hit) AS broken
                 FROM long a JOIN long b USING (variant, id, measure) WHERE a.config = 'dicht' AND b.config = 'misch_rang' GROUP BY ALL),
      tests AS (SELECT *, fixed + broken AS n, least(fixed, broken) AS m FROM counts),
      p AS (SELECT variant, measure, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, m + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END AS v FROM tests)
      SELECT variant, measure, questions, fixed, broken, fixed - broken AS net, round(v, 6) AS p_value, round(v, 6) < 0.05 AS significant FROM tests JOIN p USING (variant, measure)""",
    "abstention_rollup": f"""WITH {S.FIRST}, n AS (SELECT {S.normalise('text')} AS n FROM passages), a AS (SELECT coalesce(category, 'uncategorised') AS category, NOT EXISTS (SELECT 1 FROM n WHERE contains(n.n, lower(u.anchor_term))) AS abstained FROM unanswerable u)
      SELECT category, count(*) AS questions, round(avg(abstained::INTEGER::DOUBLE), 6) AS abstention_rate, grouping(category)::INTEGER AS total FROM a GROUP BY ROLLUP (category)""",
    "parse_citations": f"WITH {_CITED} SELECT qid, file, page FROM cited",
    "refusal_split": f"""WITH {_REPLIES} SELECT qid, regexp_matches(answer, {S.lit(replies.REFUSAL)}) AS refused,
      CASE WHEN regexp_matches(answer, {S.lit(replies.REFUSAL)}) THEN {S.strip(S.sub('answer', replies.REFUSAL, ''))} ELSE answer END AS shown FROM replies""",
    "build_sources": f"""WITH {_CITED}, pages AS (SELECT qid, source_file, page_number FROM replies UNION SELECT qid, source_file, page_number + 1 FROM replies), n AS (SELECT source_file, max(title) AS title FROM titles GROUP BY 1)
      SELECT p.qid, p.source_file, p.page_number, coalesce(nullif(n.title, ''), p.source_file) AS title FROM pages p JOIN cited c ON c.qid = p.qid AND c.file = p.source_file AND c.page = p.page_number
      JOIN replies r ON r.qid = p.qid LEFT JOIN n ON n.source_file = p.source_file WHERE NOT regexp_matches(r.answer, {S.lit(replies.REFUSAL)})""",
    "build_context": f"""WITH {S.BM25} SELECT qid, md5(string_agg('[' || coalesce(source_file, '?') || ', Seite ' || coalesce(page_number::VARCHAR, '?') || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5
      FROM bm25 JOIN passages USING (chunk_id) WHERE rank <= 5 GROUP BY 1""",
}
