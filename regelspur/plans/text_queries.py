"""Queries on text rules, blocks, passages and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regelspur.functions import replies, titles
from regelspur.functions import text as T
from regelspur.operators import chunking
from regelspur.plans import sql as S
from regelspur.sources import elements as E


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


def normalise_text(spark, sf):
    return table(spark, sf, "chunks").select("position", T.normalise(F.col("text")).alias("normalised"))


def boilerplate_filter(spark, sf):
    return table(spark, sf, "chunks").select("position", T.is_boilerplate(F.col("text"), F.col("type")).alias("boilerplate"))


def tokenize(spark, sf):
    tokens = T.tokenize(F.col("text"))
    return table(spark, sf, "chunks").select("position", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens")).where("n >= 0")


def analyse_filtered(spark, sf):
    return table(spark, sf, "chunks").where("text is not null").select("position", F.array_join(T.analyse(F.col("text")), " ").alias("terms"))


def token_estimate(spark, sf):
    return table(spark, sf, "chunks").select("position", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


def elements(spark, sf):
    return E.accept(E.from_text_table(table(spark, sf, "documents"))).select("source_file", F.col("elem_idx").cast("long").alias("elem_idx"), "text", "page_number")


def document_assembly(spark, sf):
    return E.documents(E.accept(E.from_text_table(table(spark, sf, "documents"))))


def split_by_type(spark, sf):
    text, tables = E.split_types(table(spark, sf, "chunks"))
    count = F.count(F.lit(1)).alias("n")
    return text.groupBy("source_file", "type").agg(count).unionByName(tables.groupBy("source_file", "type").agg(count))


def heading_blocks(spark, sf):
    return elements(spark, sf).where(T.is_heading(F.col("text"))).select("source_file", "elem_idx", "text")


def chunk_ids(spark, sf):
    c = table(spark, sf, "chunks").where("text is not null")
    return c.select("position", T.chunk_id(F.col("source_file"), F.col("page_number"), F.col("type"), F.col("text")).alias("content_id"))


def dedupe_first(spark, sf):
    return chunking.dedupe_first(table(spark, sf, "chunks")).select("position", "chunk_id")


def _blocks(spark, sf):
    return E.accept(E.from_text_table(table(spark, sf, "documents")))


def chunk_assign(spark, sf):
    return chunking.assign_chunks(_blocks(spark, sf)).select("source_file", F.col("elem_idx").cast("long").alias("elem_idx"), "chunk_no")


def chunk_fold(spark, sf):
    return chunking.fold_chunks(_blocks(spark, sf)).select("source_file", "chunk_no", "text", "page_number", "page_end")


def chunk_merge(spark, sf):
    return chunking.merge_groups(chunking.fold_chunks(_blocks(spark, sf))).select("source_file", "chunk_no", "group_no")


def chunks_final(spark, sf):
    return chunking.build_chunks(_blocks(spark, sf)).select("source_file", F.col("seq").alias("group_no"), "text", "page_number", "page_end", "chunk_id")


def index_report(spark, sf):
    return chunking.index_report(table(spark, sf, "chunks"))


def titles_tidy(spark, sf):
    shown = titles.tidy(F.concat(F.lit("„"), F.col("title"), F.lit("“ – ")))
    return table(spark, sf, "titles").select("source_file", shown.alias("shown"), titles.undouble(F.concat_ws(" ", "title", "title")).alias("once"))


def titles_join(spark, sf):
    names = table(spark, sf, "titles").groupBy("source_file").agg(F.max("title").alias("title"))
    files = table(spark, sf, "chunks").groupBy("source_file").agg(F.count(F.lit(1)).alias("passages"))
    return files.join(names, "source_file", "left").select("source_file", "passages", titles.describe(F.col("title"), F.col("source_file")).alias("shown"))


def llm_json_parse(spark, sf):
    parsed = replies.json_object(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    rows = table(spark, sf, "events").select("event_id", parsed.alias("p"))
    return rows.select("event_id", F.col("p").isNotNull().alias("is_object"), replies.json_field(F.col("p"), "k").alias("k"))


def prompts(spark, sf):
    made = replies.prompt("Auszug aus {source_file}:\n{text}", source_file=F.col("source_file"), text=F.col("text"))
    return table(spark, sf, "chunks").select("position", F.md5(made).alias("prompt_md5"))


NAMES = "clean_text normalise_text boilerplate_filter tokenize analyse_filtered token_estimate elements document_assembly split_by_type heading_blocks chunk_ids dedupe_first chunk_assign chunk_fold chunk_merge chunks_final index_report titles_tidy titles_join llm_json_parse prompts".split()

_D = titles.DESIGNATION
_FLAT = S.tidy("'„' || title || '“ – '")
_HEAD = f"regexp_extract(flat, {S.lit('^' + _D)}, 0)"
_REST = S.sub(S.trim(f"substr(flat, length({_HEAD}) + 1)", " \\-–:"), f"^{titles._NAME}{T.WS}+(?i:Regel|Information|Vorschrift){T.WS}*", "")

ORACLE = {
    "clean_text": f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents",
    "normalise_text": f"SELECT position, {S.normalise('text')} AS normalised FROM chunks",
    "boilerplate_filter": f"SELECT position, {S.is_boilerplate('text', 'type')} AS boilerplate FROM chunks",
    "tokenize": f"SELECT position, len(t)::INTEGER AS n, array_to_string(t, ' ') AS tokens FROM (SELECT position, {S.tokenize('text')} AS t FROM chunks WHERE text IS NOT NULL)",
    "analyse_filtered": f"SELECT position, array_to_string({S.analyse('text')}, ' ') AS terms FROM chunks WHERE text IS NOT NULL",
    "token_estimate": f"SELECT position, {S.tokens('text')}::BIGINT AS tokens FROM chunks",
    "elements": f"WITH {S.ELEMENTS} SELECT source_file, elem_idx, text, page_number FROM elements",
    "document_assembly": f"WITH {S.ELEMENTS} SELECT source_file, string_agg(text, chr(10) || chr(10) ORDER BY elem_idx) AS content FROM elements GROUP BY 1",
    "split_by_type": "SELECT source_file, type, count(*) AS n FROM chunks WHERE type IN ('NarrativeText', 'Table') GROUP BY ALL",
    "heading_blocks": f"WITH {S.ELEMENTS} SELECT source_file, elem_idx, text FROM elements WHERE {S.heading('text')}",
    "chunk_ids": f"SELECT position, {S.chunk_id('source_file', 'page_number', 'type', 'text')} AS content_id FROM chunks WHERE text IS NOT NULL",
    "dedupe_first": f"WITH {S.FIRST} SELECT position, chunk_id FROM passages",
    "chunk_assign": f"WITH RECURSIVE {S.ASSIGN} SELECT source_file, elem_idx, chunk_no FROM assigned",
    "chunk_fold": f"WITH RECURSIVE {S.FOLDED} SELECT source_file, chunk_no, text, page_number, page_end FROM folded",
    "chunk_merge": f"WITH RECURSIVE {S.MERGED} SELECT source_file, chunk_no, group_no FROM grouped",
    "chunks_final": f"""WITH RECURSIVE {S.MERGED},
      final AS (SELECT source_file, group_no, string_agg(text, chr(10) || chr(10) ORDER BY chunk_no) AS text, arg_min(page_number, chunk_no) AS page_number, max(page_end) AS page_end FROM grouped GROUP BY 1, 2)
      SELECT source_file, group_no, text, page_number, page_end, {S.chunk_id('source_file', 'page_number', "'NarrativeText'", 'text')} AS chunk_id FROM final""",
    "index_report": f"""WITH sized AS (SELECT source_file, type, {S.tokens("coalesce(text, '')")} AS tokens FROM chunks)
      SELECT source_file, count(*) AS chunks, count(*) FILTER (type = 'Table') AS tables, round(coalesce(median(tokens) FILTER (type = 'NarrativeText'), 0.0), 6) AS median_tokens,
             round(100.0::DOUBLE * count(*) FILTER (tokens >= 540) / count(*), 6) AS at_cap_percent, grouping(source_file)::INTEGER AS total
      FROM sized GROUP BY ROLLUP (source_file)""",
    "titles_tidy": f"""WITH f AS (SELECT source_file, title, {_FLAT} AS flat FROM titles)
      SELECT source_file, CASE WHEN length({_HEAD}) = 0 THEN flat WHEN length({_REST}) = 0 THEN {_HEAD} ELSE {S.trim(f"{_HEAD} || ' - ' || {_REST}", " \\-")} END AS shown,
             coalesce({S.strip('title')}, '') AS once FROM f""",
    "titles_join": """WITH n AS (SELECT source_file, max(title) AS title FROM titles GROUP BY 1), f AS (SELECT source_file, count(*) AS passages FROM chunks GROUP BY 1)
      SELECT source_file, passages, coalesce(nullif(title, ''), source_file) AS shown FROM f LEFT JOIN n USING (source_file)""",
    "llm_json_parse": """SELECT event_id, coalesce(json_type(CASE WHEN json_valid(props) THEN props END) = 'OBJECT', false) AS is_object, coalesce(trim(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k')), '') AS k FROM events""",
    "prompts": "SELECT position, md5('Auszug aus ' || coalesce(source_file, '') || ':' || chr(10) || coalesce(text, '')) AS prompt_md5 FROM chunks",
}
