"""Queries over sources: documents are candidates (their source a workbook, their language a sheet), benchmark items and turns are questions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions import text as T
from gridspark.operators import retrieval, sourcing
from gridspark.plans.register import Register, Tables

REGISTER = query = Register()

#: Every document is a candidate of the question that its id falls to.
CANDIDATES = "c AS (SELECT doc_id % 25 AS query_id, doc_id AS card_id, source AS workbook, lang AS sheet, source || '-' || lang AS table_id, CASE WHEN doc_id % 5 = 0 THEN 'metadata' ELSE 'data' END AS retrieval_type, CAST(length(text) % 97 AS DOUBLE) AS score FROM documents)"


def candidates(t: Tables):
    kind = F.when(F.col("doc_id") % 5 == 0, "metadata").otherwise("data")
    return t.documents.select(
        (F.col("doc_id") % 25).alias("query_id"), F.col("doc_id").alias("card_id"), F.col("source").alias("workbook"), F.col("lang").alias("sheet"), F.concat("source", F.lit("-"), "lang").alias("table_id"),
        kind.alias("retrieval_type"), (F.length("text") % 97).cast("double").alias("score"),
    )


@query("""WITH x AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 97 = 0) SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.source = d.source AND x.lang = d.lang)""")
def source_exclusion(t: Tables):
    listed = t.documents.where("doc_id % 97 = 0").select(F.concat(F.lit("C:\\books\\"), F.upper("source")).alias("workbook"), F.concat(F.upper("lang"), F.lit("-")).alias("sheet"))
    own = t.documents.select("doc_id", F.concat(F.lit("/data/"), "source").alias("workbook"), F.col("lang").alias("sheet"))
    return sourcing.not_excluded(own, listed).select("doc_id")


@query(f"""WITH {CANDIDATES}, k AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'metadata' ELSE 'both' END AS query_type FROM c),
f AS (SELECT *, query_type = 'both' OR query_type = retrieval_type AS fits FROM k), a AS (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS any_fit FROM f)
SELECT query_id, card_id, retrieval_type FROM a WHERE fits OR NOT any_fit""")
def candidate_pool(t: Tables):
    kinds = candidates(t).select("query_id").distinct().withColumn("query_type", F.when(F.col("query_id") % 3 == 0, "data").when(F.col("query_id") % 3 == 1, "metadata").otherwise("both"))
    return sourcing.candidate_pool(candidates(t), kinds).select("query_id", "card_id", "retrieval_type")


@query("""WITH r AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '  ' WHEN page_id % 4 = 1 THEN url END AS upload, CASE WHEN page_id % 4 < 3 THEN url || '#doc' END AS document, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'sheet' END AS sheet,
CASE WHEN page_id % 3 = 0 THEN ' card ' END AS card, CASE WHEN page_id % 3 = 1 THEN '{}' END AS metadata FROM pages)
SELECT page_id, CASE WHEN trim(upload) <> '' THEN upload ELSE document END AS workbook, CASE WHEN card IS NULL THEN '{}' ELSE 'card' END AS retrieval_card FROM r WHERE (trim(upload) <> '' OR document IS NOT NULL) AND sheet <> '' AND (card IS NOT NULL OR metadata IS NOT NULL)""")
def eligible_records(t: Tables):
    k = F.col("page_id")
    rows = t.pages.select("page_id", F.when(k % 4 == 0, F.lit("  ")).when(k % 4 == 1, F.col("url")).alias("upload_name"), F.when(k % 4 < 3, F.concat("url", F.lit("#doc"))).alias("document_name"), F.when(k % 5 == 0, "").otherwise("sheet").alias("sheet_name"), F.when(k % 3 == 0, " card ").alias("retrieval_card"), F.when(k % 3 == 1, "{}").alias("metadata"))
    return sourcing.eligible(rows).select("page_id", "workbook", "retrieval_card")


@query("""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN NOT (turn % 3 = 1 OR turn % 5 = 2) ELSE false END AS search FROM conversations""")
def retrieval_needed(t: Tables):
    mode = F.element_at(F.array(*map(F.lit, ("off", "hybrid", "auto", "indexed"))), (F.col("conv_id") % 4 + 1).cast("int"))
    sheets = F.when(F.col("turn") % 3 == 1, F.array("role", F.lit(" "))).when(F.col("turn") % 3 == 2, F.array("role", "role"))
    return t.conversations.select("conv_id", "turn", sourcing.should_retrieve(mode, sheets, F.when(F.col("turn") % 5 == 2, "t1")).alias("search"))


@query(f"""WITH {CANDIDATES}, r AS (SELECT query_id, card_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM c)
SELECT query_id, card_id, CAST(rank AS INTEGER) AS rank, CAST(ceil(rank / 8) AS INTEGER) AS batch FROM r WHERE rank <= 24""")
def candidate_batches(t: Tables):
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "card_id"))
    return sourcing.candidate_batches(candidates(t).withColumn("rank", rank), 8, 3).select("query_id", "card_id", "rank", "batch")


@query(f"""WITH {CANDIDATES}, f AS (SELECT * FROM c WHERE score > query_id % 7 * 10 AND (query_id % 3 <> 0 OR sheet IN ('en', 'fr')) AND (query_id % 4 <> 0 OR workbook IN ('src1', 'src2', 'src3'))),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, table_id ORDER BY score DESC, card_id) AS k FROM f) SELECT query_id, table_id, card_id, score FROM b WHERE k = 1 AND (query_id % 2 = 1 OR sheet IN (SELECT DISTINCT lang FROM documents WHERE doc_id % 3 = 0))""")
def search_requests(t: Tables):
    q = F.col("query_id")
    asked = candidates(t).select("query_id").distinct().select("query_id", F.array().cast("array<string>").alias("allowed_table_ids"), F.when(q % 4 == 0, F.array(*map(F.lit, ("src1", "src2", "src3")))).alias("workbooks"), F.when(q % 3 == 0, F.array(F.lit("en"), F.lit("fr"))).alias("sheets"), (q % 7 * 10).cast("double").alias("min_score"))
    required = asked.where("query_id % 2 = 0").select("query_id", F.lit(" Language").alias("label"))
    kept = t.documents.where("doc_id % 3 = 0").select("lang").distinct()
    headers = t.documents.join(kept, "lang", "left_semi").select(F.concat("source", F.lit("-"), "lang").alias("table_id"), F.lit("language ").alias("label")).distinct()
    return sourcing.searched(candidates(t), asked, required, headers).select("query_id", "table_id", "card_id", "score")


@query(f"""WITH {CANDIDATES}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, workbook ORDER BY score DESC, card_id) AS place FROM c),
g AS (SELECT query_id, workbook, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS grp FROM p WHERE place = 1)
SELECT query_id, workbook, card_id, CAST(place AS INTEGER) AS place, CAST(grp AS INTEGER) AS "group" FROM p JOIN g USING (query_id, workbook)""")
def answers_by_workbook(t: Tables):
    return sourcing.by_workbook(candidates(t)).select("query_id", "workbook", "card_id", "place", "group")


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM c), n AS (SELECT query_id, count(*) AS candidate_count, count(DISTINCT workbook) AS workbook_count FROM c GROUP BY 1)
SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'both' ELSE 'data' END AS query_type, candidate_count, workbook_count, 'd' || card_id AS document_id, workbook, sheet, card_id AS selected_card_id, CAST(least(candidate_count, 10) AS INTEGER) AS audited, CAST(CASE WHEN candidate_count > 1 THEN 2 ELSE 1 END AS INTEGER) AS selected_at
FROM r JOIN n USING (query_id) WHERE rank = CASE WHEN candidate_count > 1 THEN 2 ELSE 1 END""")
def selection_payload(t: Tables):
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "card_id"))
    ranked = candidates(t).withColumn("rank", rank)
    second = ranked.where("rank <= 2").withColumn("last", F.max("rank").over(W.Window.partitionBy("query_id"))).where("rank = last")
    own = candidates(t).withColumn("document_id", F.concat(F.lit("d"), F.col("card_id").cast("string")))
    kinds = candidates(t).where("query_id % 2 = 0").select("query_id", F.lit("both").alias("query_type")).distinct()
    chosen = second.withColumn("workbook", F.concat(F.lit("/books/"), "workbook"))
    made = sourcing.selection_payloads(chosen, own, kinds, retrieval.audit(ranked.where("rank <= 10")))
    at = F.filter("audit", lambda x: x["selected"])[0]["rank"]
    return made.select("query_id", "query_type", "candidate_count", "workbook_count", "document_id", "workbook", "sheet", "selected_card_id", F.size("audit").alias("audited"), at.alias("selected_at"))


@query("""WITH p AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1), q AS (SELECT p.doc_id AS query_id, d.source, d.lang FROM p JOIN documents d USING (doc_id)), s AS (SELECT source, lang, min(doc_id) AS path FROM documents GROUP BY 1, 2)
SELECT query_id, s.lang AS sheet, 'p' || lpad(CAST(path AS VARCHAR), 9, '0') AS path FROM q JOIN s USING (source) WHERE s.lang <> q.lang""")
def related_sheets(t: Tables):
    first = t.documents.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    primary = t.documents.join(first, ["source", "doc_id"]).select(F.col("doc_id").alias("query_id"), F.concat(F.lit("/run/"), "source").alias("workbook"), F.col("lang").alias("sheet"))
    path = F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    structures = t.documents.select(F.concat(F.lit("D:\\old\\"), "source").alias("workbook"), F.col("lang").alias("sheet"), path.alias("path"))
    return sourcing.related_sheets(primary, structures).select("query_id", "sheet", "path")


@query("""WITH r AS (SELECT conv_id, turn, role, conv_id * 100 + turn AS ord FROM conversations WHERE turn % 4 <> 3), k AS (SELECT conv_id % 50 AS k, max(ord) AS ord FROM r GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS sample_id, 'dir' || k.ord AS source, 't' || k.ord AS table_id FROM (SELECT DISTINCT conv_id FROM conversations) JOIN k ON conv_id % 50 = k.k""")
def earlier_sources(t: Tables):
    n = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    reports = t.conversations.select(
        F.lpad(F.col("conv_id").cast("string"), 9, "0").alias("report"), F.col("turn").alias("ord"), F.lit(None).cast("string").alias("sample_id"), F.concat(F.lit("q"), (F.col("conv_id") % 50).cast("string")).alias("question"), (F.col("turn") % 4 == 3).alias("error"), F.lit(True).alias("success"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("C:\\out\\dir"), n)).otherwise(F.concat(F.lit("/out/dir"), n, F.lit("/structure.yaml"))).alias("source"), F.concat(F.lit("t"), n).alias("table_id"),
    )
    asked = t.conversations.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("sample_id"), F.concat(F.lit("q"), (F.col("conv_id") % 50).cast("string")).alias("question"))
    return sourcing.earlier_sources(reports, asked)


@query("""WITH n AS (SELECT c_nationkey AS wb_id, c_custkey, 'sheet_' || c_custkey % 3 AS base, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY c_custkey) AS k FROM customer) SELECT wb_id, c_custkey, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS id FROM n""")
def unique_sheet_ids(t: Tables):
    names = t.customer.select(F.col("c_nationkey").alias("wb_id"), "c_custkey", F.concat(F.lit("!"), (F.col("c_custkey") % 3).cast("string"), F.lit(" -")).alias("sheet"))
    return sourcing.unique_ids(names, ["wb_id"], "sheet", "c_custkey").select("wb_id", "c_custkey", "id")


@query("""WITH s AS (SELECT source, lang, min(doc_id) AS ord, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source AS wb_id, string_agg(lang || '=' || lang || '_sheet:' || n, ';' ORDER BY ord) AS sheets FROM s GROUP BY 1""")
def schema_artifact(t: Tables):
    g = t.documents.groupBy(F.col("source").alias("wb_id"), F.col("lang").alias("sheet")).agg(F.min("doc_id").alias("ord"), F.count("*").cast("string").alias("description"))
    sheets = g.withColumn("key", F.col("sheet")).withColumn("sheet", F.concat("sheet", F.lit(" Sheet")))
    tables = g.select("wb_id", F.concat("sheet", F.lit(" Sheet")).alias("sheet"), F.lit("t1").alias("table_id"), F.col("sheet").alias("name"), "description", F.array("sheet").alias("headers"))
    made = sourcing.workbook_schemas(sheets, tables)
    line = F.transform("schema", lambda s: F.concat(s["tables"][0]["name"], F.lit("="), s["id"], F.lit(":"), s["description"]))
    return made.select("wb_id", F.array_join(line, ";").alias("sheets"))


@query("""WITH s AS (SELECT DISTINCT source AS wb_id, lang AS sheet FROM documents), f AS (SELECT wb_id, min(sheet) AS first FROM s GROUP BY 1), t AS (SELECT doc_id, source AS wb_id, doc_id % 4 AS k, lang FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN lang WHEN 1 THEN NULL WHEN 2 THEN lang ELSE first END AS sheet FROM t JOIN f USING (wb_id)""")
def table_sheet(t: Tables):
    k = F.col("doc_id") % 4
    tables = t.documents.select(F.col("source").alias("wb_id"), F.col("doc_id").cast("string").alias("table_id"), F.when(k == 2, F.upper("lang")).when(k == 3, "nowhere").alias("name"), F.when(k == 0, F.concat(F.lit(" "), "lang")).when(k == 1, "Missing").otherwise(" ").alias("sheet"))
    sheets = t.documents.select(F.col("source").alias("wb_id"), F.col("lang").alias("sheet"), F.ascii("lang").alias("ord")).distinct()
    order = F.row_number().over(W.Window.partitionBy("wb_id").orderBy("sheet"))
    return sourcing.table_sheets(tables, sheets.withColumn("ord", order)).select(F.col("table_id").cast("bigint").alias("doc_id"), "sheet")


@query("""SELECT l_orderkey * 8 + l_linenumber AS ask_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_partkey IN (SELECT p_partkey FROM part) THEN 't' || l_partkey END AS table_id FROM lineitem""")
def table_lookup(t: Tables):
    tables = t.part.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table_id"), F.concat(F.lit("Table "), F.col("p_partkey").cast("string")).alias("name"))
    n, k = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 3
    asked = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ask_id"), F.when(k == 0, F.concat(F.lit("x"), n)).when(k == 1, F.concat(F.lit("t"), n)).otherwise(F.concat(F.lit("Table "), n)).alias("wanted"))
    return sourcing.find_tables(asked, tables).select("ask_id", "table_id")


@query("""WITH k AS (SELECT c_nationkey AS k, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line FROM customer)
SELECT k, CAST(0 AS BIGINT) AS line, '| Customer | seg |' AS text FROM (SELECT DISTINCT k FROM k) UNION ALL SELECT DISTINCT k, 1, '| --- | --- |' FROM k UNION ALL SELECT k, line + 1, '| ' || c_name || ' | ' || c_mktsegment || '\\|x |' FROM k""")
def result_table(t: Tables):
    rows = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("who"), F.concat("c_mktsegment", F.lit("|x")).alias("seg"))
    labels = t.nation.select(F.explode(F.array(F.struct(F.lit("who").alias("header_id"), F.lit("Customer ").alias("label")), F.struct(F.lit("seg").alias("header_id"), F.col("n_name").alias("label")))).alias("x")).select("x.*")
    return sourcing.result_markdown(rows, labels, "k", ["who", "seg"])


#: Questions about parts; a brand is a table, its headers are its parts' types.
BRANDS = """t AS (SELECT DISTINCT p_brand AS table_id, 'Catalogue ' || p_brand AS name, 'parts' AS description FROM part), h AS (SELECT DISTINCT p_brand AS table_id, p_type AS header_id, lower(p_type) AS label FROM part),
q AS (SELECT p_partkey AS query_id, 'How many ' || p_type || ' in catalogue ' || p_brand || '?' AS text FROM part)"""
#: A brand's words are brand and its number: 3 each for those in id and name and 3 for `catalogue`, 20 for the whole name, 2 and 10 for the type.
ROUTED = """s0 AS (SELECT query_id, table_id, 3.0 * (2 + CASE WHEN text LIKE '%' || table_id || '?' THEN 1 ELSE 0 END) + CASE WHEN position(lower(name) IN lower(text)) > 0 THEN 20 ELSE 0 END
  + (SELECT count(*) FROM h WHERE h.table_id = t.table_id AND position(label IN lower(text)) > 0) * 12.0 AS x FROM q, t), s AS (SELECT query_id, table_id, CAST(x AS DOUBLE) AS score FROM s0)"""


def brands(t: Tables):
    tables = t.part.select(F.lit(0).alias("scope"), F.col("p_brand").alias("table_id"), F.concat(F.lit("Catalogue "), "p_brand").alias("name"), F.lit("parts").alias("description")).distinct()
    headers = t.part.select(F.lit(0).alias("scope"), F.col("p_brand").alias("table_id"), F.col("p_type").alias("header_id"), F.lower("p_type").alias("label"), F.lit("").alias("description")).distinct()
    asked = t.part.select(F.lit(0).alias("scope"), F.col("p_partkey").alias("query_id"), F.concat(F.lit("How many "), "p_type", F.lit(" in catalogue "), "p_brand", F.lit("?")).alias("text"))
    return asked, tables, headers


@query(f"WITH {BRANDS}, {ROUTED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) AS rank FROM s) SELECT query_id, table_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3 AND score > 5")
def table_routing(t: Tables):
    return retrieval.search_tables(*brands(t), top_k=3, min_score=5.0).select("query_id", "table_id", "score", "rank")


@query("""SELECT p_partkey AS query_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE (SELECT max(p_brand) FROM part) END AS table_id, CASE WHEN p_partkey % 2 = 0 THEN 'retriever' ELSE 'lexical' END AS reason FROM part""")
def retriever_hook(t: Tables):
    """A retriever answers half of the questions, with tables that don't exist among its answers; the lexical search has the rest."""
    _, tables, headers = brands(t)
    asked = t.part.select(F.lit(0).alias("scope"), F.col("p_partkey").alias("query_id"), F.lit("parts").alias("text"), "p_brand")
    last = t.part.agg(F.max("p_brand").alias("last"))

    def search(queries, known):
        own = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.array(F.struct(F.col("p_brand").alias("table_id"), F.lit(0.5).alias("score")), F.struct(F.lit("unknown").alias("table_id"), F.lit(9.0).alias("score")))).alias("x"))
        return own.select("query_id", "x.table_id", "x.score")

    only = tables.join(last, tables["table_id"] == last["last"]).drop("last").withColumn("description", F.lit("parts"))
    rest = tables.join(last, tables["table_id"] == last["last"], "left_anti").withColumn("description", F.lit("none"))
    return retrieval.search_tables(asked, only.unionByName(rest), headers, retriever=search).select("query_id", "table_id", "reason")


@query(f"""WITH {BRANDS}, w AS (SELECT table_id, list_distinct(flatten(list(x))) AS w FROM (SELECT table_id, regexp_extract_all(lower(table_id || ' ' || name || ' ' || description), '[a-z0-9]+') AS x FROM t UNION ALL SELECT table_id, regexp_extract_all(lower(header_id || ' ' || label), '[a-z0-9]+') FROM h) GROUP BY 1),
s AS (SELECT query_id, table_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), w)) AS score FROM q, w)
SELECT query_id, max({{'s': score, 't': table_id}}).t AS table_id, max(score) AS score FROM s GROUP BY 1""")
def table_pick(t: Tables):
    return retrieval.pick_tables(*brands(t))


@query("""WITH r AS (SELECT DISTINCT p_brand AS relation_id, 'sum of ' || p_brand AS description FROM part), q AS (SELECT p_partkey AS query_id, 'sum for ' || p_brand AS text, p_brand FROM part),
s AS (SELECT query_id, relation_id, CAST(2 + (p_brand = relation_id)::INT + 20 * (position(lower(relation_id) IN lower(text)) > 0)::INT AS DOUBLE) AS score FROM q, r)
SELECT query_id, relation_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, relation_id) <= 3""")
def find_relation(t: Tables):
    relations = t.part.select(F.lit(0).alias("scope"), F.col("p_brand").alias("relation_id"), F.concat(F.lit("sum of "), "p_brand").alias("description")).distinct()
    asked = t.part.select(F.lit(0).alias("scope"), F.col("p_partkey").alias("query_id"), F.concat(F.lit("sum for "), "p_brand").alias("text"))
    return retrieval.find_relations(asked, relations).select("query_id", "relation_id", "score")


@query("""SELECT p_partkey AS query_id, p_type AS sheet, CASE WHEN p_partkey % 2 = 0 THEN CAST(length(p_type) AS DOUBLE) ELSE 1000.0 + length(p_type) END AS score FROM part""")
def explicit_sheet(t: Tables):
    names = t.part.select(F.lit(0).alias("scope"), F.col("p_type").alias("sheet")).distinct()
    sheets = names.withColumn("ord", F.length("sheet"))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("How much is in "), F.lower("p_type"), F.lit("?"))).otherwise(F.concat(F.lit("What does sheet "), "p_type", F.lit(", say")))
    asked = t.part.select(F.lit(0).alias("scope"), F.col("p_partkey").alias("query_id"), text.alias("text"))
    return retrieval.explicit_sheets(asked, sheets)


@query("SELECT p_partkey AS query_id, p_brand AS sheet, p_brand AS table_id, CAST(2 + 6 + 8 AS DOUBLE) AS score FROM part")
def label_score(t: Tables):
    brand = F.col("p_brand")
    tables = t.part.select(F.lit(0).alias("scope"), brand.alias("sheet"), brand.alias("table_id"), F.concat(F.lit("x"), F.regexp_replace(brand, "#", "-"), F.lit("x")).alias("name")).distinct()
    headers = tables.select("scope", "sheet", F.concat(F.lit("Cost_"), "name").alias("label"))
    asked = t.part.select(F.lit(0).alias("scope"), F.col("p_partkey").alias("query_id"), F.concat(F.lit("cost x"), brand, F.lit("x now")).alias("text"))
    return retrieval.label_scores(asked, tables, headers)


@query("""WITH h AS (SELECT DISTINCT p_brand AS header_id, 'parts of ' || p_brand AS label, CAST(substr(p_brand, 7) AS BIGINT) AS ord FROM part), q AS (SELECT p_partkey AS query_id, 'of ' || p_brand AS text, p_brand FROM part),
s AS (SELECT query_id, header_id, ord, 2 + (p_brand = header_id)::INT + 10 * (position(lower(text) IN lower(label)) > 0)::INT AS score FROM q, h)
SELECT query_id, header_id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) <= 4""")
def find_headers(t: Tables):
    headers = t.part.select(F.lit(0).alias("scope"), F.col("p_brand").alias("header_id"), F.concat(F.lit("parts of "), "p_brand").alias("label"), F.lit("").alias("description"), F.substring("p_brand", 7, 9).cast("bigint").alias("ord")).distinct()
    asked = t.part.select(F.lit(0).alias("scope"), F.col("p_partkey").alias("query_id"), F.concat(F.lit("of "), "p_brand").alias("text"))
    return retrieval.find_headers(asked, headers, 4).select("query_id", "header_id", F.col("score").cast("int").alias("score"), "rank")


STOP = ", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS)
TERMS = "list_distinct(list_filter(list_transform(regexp_extract_all(lower({}), '[0-9A-Za-zÀ-ỹ가-힣#./+-]+'), lambda t: regexp_replace(t, '^\\.+|\\.+$', '', 'g')), lambda t: t <> '' AND t NOT IN (" + STOP + ") AND (length(t) >= 2 OR regexp_matches(t, '^[0-9]$'))))"


@query(f"SELECT item_id, array_to_string(list_sort({TERMS.format('text')}), ' ') AS terms FROM benchmark")
def query_terms(t: Tables):
    return t.benchmark.select("item_id", F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"))


@query(f"""WITH q AS (SELECT item_id, {TERMS.format('text')} AS t FROM benchmark), p AS (SELECT item_id, t, lower(html) AS card FROM q JOIN pages ON page_id = item_id)
SELECT item_id, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_filter(t, lambda x: contains(card, x))) / len(t) END, 6) AS share, CAST(len(list_filter(t, lambda x: contains(card, x))) AS INTEGER) AS matched, CAST(len(list_filter(t, lambda x: NOT contains(card, x))) AS INTEGER) AS missing FROM p""")
def entity_terms(t: Tables):
    pairs = t.benchmark.join(t.pages, F.col("item_id") == F.col("page_id"))
    return pairs.select("item_id", retrieval.entity_match(F.col("text"), F.col("html")).alias("m")).select("item_id", F.round("m.share", 6).alias("share"), F.size("m.matched").alias("matched"), F.size("m.missing").alias("missing"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1.0 WHEN c_custkey % 3 = 1 THEN round(2.0 * length(c_name) / (2 * length(c_name) + 2), 6) ELSE 0.0 END AS likeness FROM customer""")
def similarity_ratio(t: Tables):
    other = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit("~~"))).otherwise("~~~~")
    return t.customer.select("c_custkey", F.round(T.similarity_ratio("c_name", other), 6).alias("likeness"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 140) || chr(10) || '...[truncated]...' || chr(10) || right(text, 141) END AS clipped, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 80) || chr(10) || '...TRUNCATED...' END AS cut,
CASE WHEN length(text) <= 100 THEN text ELSE chr(10) || '...[truncated]...' || chr(10) || right(text, 81) END AS tail FROM documents""")
def clipped_texts(t: Tables):
    return t.documents.select("doc_id", T.clipped(F.col("text"), 300).alias("clipped"), T.truncated(F.col("text"), 80).alias("cut"), T.clipped(F.col("text"), 100, tail=True).alias("tail"))


@query("""SELECT p_partkey, 'floor' || p_partkey AS sheet, 'v1.' || p_partkey || ' report' AS tokens, length('' || p_partkey) >= 3 AS strong FROM part""")
def name_forms(t: Tables):
    n = F.col("p_partkey").cast("string")
    return t.part.select("p_partkey", T.sheet_alias(F.concat(F.lit("Flöor F"), n)).alias("sheet"), F.array_join(T.workbook_tokens(F.concat(F.lit("V1."), n, F.lit(" - Report XLSX"))), " ").alias("tokens"), T.strong_token(n).alias("strong"))


@query("""SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) >= 2 OR item_id % 2 = 0 OR item_id % 3 = 0 AS enough FROM benchmark""")
def evidence_enough(t: Tables):
    return t.benchmark.select("item_id", retrieval.evidence(T.overlap(F.col("text"), F.col("text")), F.when(F.col("item_id") % 2 == 0, 0.5).otherwise(0.25), F.when(F.col("item_id") % 3 == 0, 0.75)).alias("enough"))


@query("""SELECT vec_id, vec_id % 3 = 0 AS reused, CASE WHEN vec_id % 3 = 0 THEN round(CAST(embedding[1] AS DOUBLE), 6) ELSE -1.0 END AS first FROM embeddings""")
def embeddings_kept(t: Tables):
    cards = t.embeddings.select(F.col("vec_id").alias("card_id"), F.lit("x").alias("card"))
    stored = t.embeddings.where("vec_id % 3 < 2").select(F.col("vec_id").alias("card_id"), F.when(F.col("vec_id") % 3 == 0, "m1").otherwise("m0").alias("model"), F.col("embedding").cast("array<double>").alias("embedding"))
    made = retrieval.with_embeddings(cards, stored, "m1", lambda rest: rest.select("card_id", F.array(F.lit(-1.0)).alias("embedding")))
    return made.select(F.col("card_id").alias("vec_id"), "reused", F.round(F.col("embedding")[0], 6).alias("first"))


def load_vowels():
    """A stand-in for a model: how often a text has each of the letters a, e, i, o, u."""
    return lambda texts: np.array([[text.count(c) for c in "aeiou"] for text in texts], np.float64)


@query("""SELECT doc_id, doc_id % 3 = 0 AS reused, CASE WHEN doc_id % 3 = 0 THEN -1.0 ELSE CAST(length(text) - length(replace(text, c, '')) AS DOUBLE) END AS value, CAST(i AS INTEGER) AS at
FROM documents, (VALUES (0, 'a'), (1, 'e'), (2, 'i'), (3, 'o'), (4, 'u')) v(i, c)""")
def embeddings_encoded(t: Tables):
    """Documents' embeddings: a third is stored, the others come from a batch encoder."""
    cards = t.documents.select(F.col("doc_id").alias("card_id"), F.col("text").alias("card"))
    stored = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("card_id"), F.lit("m1").alias("model"), F.array_repeat(F.lit(-1.0), 5).alias("embedding"))
    made = retrieval.with_embeddings(cards, stored, "m1", retrieval.batch_encoder(load_vowels))
    return made.select(F.col("card_id").alias("doc_id"), "reused", F.posexplode("embedding").alias("at", "value"))


@query("""WITH p AS (SELECT a.vec_id, a.label % 4 AS query_id, a.embedding AS v, b.embedding AS w, a.vec_id % 7 = 0 AS odd FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2)
SELECT vec_id, query_id, CASE WHEN query_id = 1 THEN vec_id / 2.0 WHEN odd THEN NULL ELSE round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(w AS DOUBLE[])), 6) END AS embedding_score FROM p""")
def embedding_evidence(t: Tables):
    half = t.embeddings.select(F.col("vec_id").alias("h"), F.col("embedding").alias("q_embedding"))
    rows = t.embeddings.withColumn("h", F.floor(F.col("vec_id") / 2)).join(half, "h")
    odd = F.col("vec_id") % 7 == 0
    group = F.col("label") % 4
    pairs = rows.select("vec_id", group.alias("query_id"), "q_embedding", F.when(odd, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"), F.when((group == 1) | (group == 2) & (F.col("vec_id") % 2 == 0), F.col("vec_id") / 2).alias("index_score"))
    return retrieval.embedding_scores(pairs).select("vec_id", "query_id", F.round("embedding_score", 6).alias("embedding_score"))


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT doc_id, source, lang FROM r WHERE k = 1""")
def first_candidates(t: Tables):
    return sourcing.keep_first(t.documents.select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], [F.desc("n_chars"), "doc_id"]).select("doc_id", "source", "lang")


@query("""WITH t AS (SELECT DISTINCT source AS wb, lang AS sheet, 'tab_' || lang || '_' || doc_id % 2 AS table_id FROM documents), q AS (SELECT source AS wb, min(doc_id) AS ask_id, min(lang) AS own FROM documents GROUP BY 1)
SELECT ask_id, t.sheet, CAST(NULL AS VARCHAR) AS table_id FROM q JOIN (SELECT DISTINCT wb, sheet FROM t) t USING (wb) WHERE ask_id % 4 = 0 OR (ask_id % 4 = 1 AND t.sheet = own)
UNION ALL SELECT ask_id, t.sheet, t.table_id FROM q JOIN t USING (wb) WHERE (ask_id % 4 = 2 AND t.sheet = own) OR ask_id % 4 = 3""")
def catalogue_scope(t: Tables):
    """By workbook: all sheets; the sheet that a question says; the tables that a target names in part; all tables where nothing matches."""
    tables = t.documents.select(F.col("source").alias("wb_id"), F.col("lang").alias("sheet"), F.concat_ws("_", F.lit("tab"), "lang", (F.col("doc_id") % 2).cast("string")).alias("table_id")).distinct().withColumn("name", F.concat(F.lit("Name "), "table_id"))
    own = t.documents.groupBy(F.col("source").alias("wb_id")).agg(F.min("doc_id").alias("ask_id"), F.min("lang").alias("own"))
    k = F.col("ask_id") % 4
    asked = own.select(
        "ask_id", "wb_id", F.when(k == 0, "workbook").when(k == 1, "sheet").otherwise("table").alias("scope"), F.when(k == 2, F.array(F.concat(F.lit("TAB-"), "own"))).when(k == 3, F.array(F.lit("nothing"))).alias("targets"),
        F.when(k == 1, F.upper("own")).otherwise("-").alias("text"),
    )
    return sourcing.catalogue_scope(asked, tables)


@query("""WITH k AS (SELECT c_nationkey AS k, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line FROM customer), n AS (SELECT k, c_name AS first FROM k WHERE line = 1)
SELECT k, CAST(0 AS BIGINT) AS line, '| ' || first || ' | Column 2 | x |' AS text FROM n UNION ALL SELECT k, 1, '| --- | --- | --- |' FROM n UNION ALL SELECT k, line, '| ' || c_name || ' |  | x |' FROM k WHERE line > 1""")
def raw_rows_markdown(t: Tables):
    rows = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("ord"), F.array("c_name", F.lit(None).cast("string"), F.lit("x"), F.lit(" "), F.lit("")).alias("values"))
    return sourcing.raw_markdown(rows, "k")
