"""Queries of search: documents are cards (their source a workbook, their language a sheet), benchmark items and turns are questions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions import text as T
from gridspark.operators import aggregates, nearest, retrieval
from gridspark.plans.register import Register, Tables

REGISTER = query = Register()

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKENS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t NOT IN (" + STOP.replace("{", "{{") + ") AND (length(t) >= 2 OR regexp_matches(t, '^\\p{{Nd}}+$')))"
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def cards(t: Tables):
    return t.documents.select(F.lit(0).alias("scope"), F.col("doc_id").alias("card_id"), F.col("source").alias("workbook"), F.col("lang").alias("sheet"), F.col("text").alias("card"), F.col("doc_id").alias("ord"))


def questions(t: Tables):
    return t.benchmark.select(F.lit(0).alias("scope"), F.col("item_id").alias("query_id"), "text")


BM25 = f"""d AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), k AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM d),
q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS token FROM benchmark) GROUP BY 1, 2),
p AS (SELECT doc_id, token, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM d) WHERE token IN (SELECT token FROM q) GROUP BY 1, 2, 3),
f AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT item_id AS query_id, doc_id AS card_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS bm25 FROM q JOIN p USING (token) JOIN f USING (token), k GROUP BY 1, 2)"""


@query(f"WITH {BM25} SELECT query_id, card_id, round(bm25, 6) AS bm25 FROM s")
def bm25(t: Tables):
    return retrieval.bm25(questions(t), cards(t)).withColumn("bm25", F.round("bm25", 6))


@query(f"WITH {BM25}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, card_id) AS INTEGER) AS rank FROM s) SELECT query_id, card_id, rank, round(bm25, 6) AS bm25 FROM r WHERE rank <= 10")
def bm25_topk(t: Tables):
    """The ten best cards of each question, without scoring every hit."""
    place = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "card_id"))
    best = retrieval.top_bm25(questions(t), cards(t), 10).withColumn("rank", place).where("rank <= 10")
    return best.select("query_id", "card_id", "rank", F.round("bm25", 6).alias("bm25"))


@query(f"""WITH {BM25}, a AS (SELECT item_id AS query_id, doc_id AS card_id, coalesce(bm25, 0) AS bm25 FROM benchmark CROSS JOIN documents LEFT JOIN s ON s.query_id = item_id AND s.card_id = doc_id),
m AS (SELECT *, min(bm25) OVER w AS lo, max(bm25) OVER w AS hi FROM a WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE (bm25 - lo) / (hi - lo) END AS score FROM m),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, card_id) AS INTEGER) AS rank FROM z)
SELECT query_id, card_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def hybrid_rank(t: Tables):
    return retrieval.hybrid_rank(questions(t), cards(t), 10).select("query_id", "card_id", "rank", F.round("score", 6).alias("score"))


@query()
def hybrid_rank_embedded(t: Tables):
    """Lexical and embedding evidence together, with the built-in offline embedding."""
    c, q = cards(t), questions(t)
    c = c.join(retrieval.hash_embedding(c, "card_id", "card"), "card_id")
    q = q.join(retrieval.hash_embedding(q, "query_id", "text"), "query_id")
    return retrieval.hybrid_rank(q, c, 10)


@query(f"SELECT item_id, doc_id, len(list_intersect(list_distinct({WORDS.format('b.text')}), list_distinct({WORDS.format('d.url')}))) AS words FROM benchmark b, (SELECT page_id AS doc_id, url FROM pages) d")
def lexical_overlap(t: Tables):
    pages = t.pages.select(F.col("page_id").alias("doc_id"), T.distinct_words(F.col("url")).alias("u"))
    asked, shown = retrieval.in_blocks(t.benchmark.select("item_id", T.distinct_words(F.col("text")).alias("q")), pages, "item_id", "doc_id")
    return asked.join(shown, ["qb", "rb"]).select("item_id", "doc_id", F.size(F.array_intersect("q", "u")).cast("bigint").alias("words"))


@query(f"""WITH q AS (SELECT conv_id, turn, text, list_distinct({TOKENS.format('text')}) AS t FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role <> 'user' GROUP BY 1), c AS (SELECT conv_id, c.text AS card FROM conversations c JOIN a USING (conv_id, turn) WHERE role <> 'user')
SELECT q.conv_id, q.turn, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_filter(t, lambda x: contains(lower(card), x))) / len(t) END, 6) AS coverage FROM q JOIN c USING (conv_id)""")
def entity_coverage(t: Tables):
    first = t.conversations.where("role <> 'user'").groupBy("conv_id").agg(F.min("turn").alias("turn"))
    card = t.conversations.where("role <> 'user'").join(first, ["conv_id", "turn"]).select("conv_id", F.col("text").alias("card"))
    return t.conversations.where("role = 'user'").join(card, "conv_id").select("conv_id", "turn", F.round(retrieval.entity_coverage(F.col("text"), F.col("card")), 6).alias("coverage"))


@query("""SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id""")
def cosine_similarity(t: Tables):
    return retrieval.pair_similarities(t.embeddings, "label", "vec_id").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 10""")
def nearest_vectors(t: Tables):
    """The ten nearest vectors of the same label for every hundredth one, without meeting blocks that are too far away."""
    rows = t.embeddings.select(F.col("label").alias("scope"), "vec_id", "embedding")
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return nearest.nearest(asked, rows, 10, same=True).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH w AS (SELECT item_id, unnest({WORDS.format('text')}) AS w FROM benchmark), c AS (SELECT item_id, CAST('0x' || substr(md5(w), 31, 2) AS INTEGER) & 127 AS slot, count(*) AS n FROM w GROUP BY 1, 2)
SELECT item_id, CAST(slot AS INTEGER) AS slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 5) AS value FROM c""")
def hash_embedding(t: Tables):
    made = retrieval.hash_embedding(t.benchmark, "item_id", "text").select("item_id", F.posexplode("embedding").alias("slot", "value"))
    return made.where("value > 0").select("item_id", "slot", F.round(F.col("value").cast("double"), 5).alias("value"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'workbook|file|metadata|structure|cấu trúc|vai trò|ghi chú|description|table nào|sheet nào|tên sheet|tên bảng|danh sách sheet|có những sheet|chứa sheet|sheet list|available sheets|sheet names|table names') AND conv_id % 2 = 0 THEN 'metadata' ELSE 'data' END AS kind FROM conversations""")
def query_type(t: Tables):
    return t.conversations.select("conv_id", "turn", retrieval.query_type(F.col("text"), F.col("conv_id") % 2 == 0).alias("kind"))


@query("""SELECT conv_id AS query_id, 'src' || (conv_id % 20) AS workbook, 'exact' AS match FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 20 < 10""")
def workbook_guard(t: Tables):
    books = t.documents.select(F.lit(0).alias("scope"), F.col("source").alias("workbook")).distinct()
    asked = t.conversations.select("conv_id").distinct().select(F.lit(0).alias("scope"), F.col("conv_id").alias("query_id"), F.concat(F.lit("total of SRC-"), (F.col("conv_id") % 20).cast("string"), F.lit(", please")).alias("text"))
    return retrieval.workbook_guard(asked, books).drop("terms")


@query("SELECT conv_id AS query_id, ['en','fr','de','es'][conv_id % 4 + 1] AS sheet FROM (SELECT DISTINCT conv_id FROM conversations)")
def sheet_guard(t: Tables):
    sheets = t.documents.select(F.lit(0).alias("scope"), F.col("lang").alias("sheet")).distinct()
    name = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("conv_id") % 4 + 1).cast("int"))
    asked = t.conversations.select("conv_id").distinct().select(F.lit(0).alias("scope"), F.col("conv_id").alias("query_id"), F.concat(F.lit("What does sheet "), F.upper(name), F.lit(" say?")).alias("text"))
    return retrieval.sheet_guard(asked, sheets).drop("match")


@query("SELECT p_partkey AS query_id, 't' AS table_id, p_brand AS header_id, p_brand AS label FROM part")
def header_hints(t: Tables):
    brands = t.part.select(F.lit(0).alias("scope"), F.lit("t").alias("table_id"), F.col("p_brand").alias("header_id"), F.col("p_brand").alias("label")).distinct()
    asked = t.part.select(F.lit(0).alias("scope"), F.col("p_partkey").alias("query_id"), F.concat(F.lit("How many of "), F.upper("p_brand"), F.lit(" are there?")).alias("text"))
    return retrieval.header_hints(asked, brands)


@query("""SELECT 'wb:' || source || ':t' AS card_id, 'Workbook: wb' || chr(10) || 'Sheet: ' || source || chr(10) || 'Table: ' || source || chr(10) || 'Description: ' || chr(10) || 'Headers: ' || string_agg(lang, ', ' ORDER BY lang) AS card FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source""")
def cards_table(t: Tables):
    langs = t.documents.select(F.lit("wb").alias("wb_id"), F.col("source").alias("sheet"), F.lit("t").alias("table_id"), F.col("lang").alias("label")).distinct().withColumn("ord", F.col("label"))
    tables = langs.select("wb_id", "sheet", "table_id", F.col("sheet").alias("name"), F.lit(None).cast("string").alias("description")).distinct()
    return retrieval.table_cards(tables, langs).select("card_id", "card")


@query("""SELECT source AS wb_id, 'Workbook: ' || source || chr(10) || 'Sheets (' || count(*) || '): ' || string_agg(lang, ', ' ORDER BY lang) || chr(10) || 'Tables (' || count(*) || '): ' || string_agg(lang, ', ' ORDER BY lang) AS card FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1""")
def cards_workbook(t: Tables):
    return retrieval.workbook_cards(t.documents.select(F.col("source").alias("wb_id"), F.col("lang").alias("sheet"), F.col("lang").alias("name")).distinct())


@query("""WITH r AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), s AS (SELECT source, lang, min(rank) AS rank FROM r GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS place FROM s)
SELECT 0 AS query_id, source AS workbook, string_agg(lang, ',' ORDER BY place) AS sheets FROM p WHERE place <= 3 GROUP BY source HAVING count(*) >= 2""")
def metadata_expand(t: Tables):
    rank = F.row_number().over(W.Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = t.documents.select(F.lit(0).alias("query_id"), F.col("source").alias("workbook"), F.col("lang").alias("sheet"), rank.alias("rank"))
    return retrieval.metadata_expansion(ranked.select("query_id", "workbook").distinct(), ranked).select("query_id", "workbook", F.array_join("sheets", ",").alias("sheets"))


@query("""WITH r AS (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents), s AS (SELECT source, min(doc_id) % 90 AS i, count(*) AS n FROM documents GROUP BY 1)
SELECT source AS query_id, doc_id, rank, NOT (i % 2 = 0 AND i < n) AS fallback_used FROM r JOIN s USING (source) WHERE rank = CASE WHEN i % 2 = 0 AND i < n THEN i + 1 ELSE 1 END""")
def apply_selection(t: Tables):
    rank = F.row_number().over(W.Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = t.documents.select(F.col("source").alias("query_id"), "doc_id", rank.alias("rank"))
    chosen = t.documents.groupBy(F.col("source").alias("query_id")).agg((F.min("doc_id") % 90).alias("selected_index")).where("selected_index % 2 = 0")
    return retrieval.apply_selection(ranked, chosen)


@query("SELECT source AS wb_id, lang AS sheet, string_agg(DISTINCT source || lang, ',') AS tables FROM documents GROUP BY 1, 2")
def sheet_catalogue(t: Tables):
    name = F.concat("source", "lang")
    tables = t.documents.select(F.col("source").alias("wb_id"), F.col("lang").alias("sheet"), F.lit("t").alias("table_id"), name.alias("name"), F.lit("d").alias("description")).distinct()
    headers = tables.select("wb_id", "sheet", "table_id", F.lit(1).alias("ord"), F.col("name").alias("label"), "description")
    return aggregates.sheet_catalogue(headers, tables).select("wb_id", "sheet", F.array_join("tables", ",").alias("tables"))
