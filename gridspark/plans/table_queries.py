"""Queries over tables: joins, unions, group-bys, spreadsheet aggregates and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import aggregates, filters, reads, relational
from gridspark.plans.register import Register, Tables

REGISTER = query = Register()


def small(t: Tables):
    """Customers of two kinds of segment with a key that is null for some, and nations with one of their own."""
    a = t.customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("n_key"), F.col("c_mktsegment").alias("label"))
    b = t.nation.where("n_nationkey <> 5").select(F.nullif(F.col("n_nationkey"), F.lit(3)).alias("n_key"), F.col("n_name").alias("label"), "n_regionkey")
    return a, b


SMALL = "a AS (SELECT c_custkey, nullif(c_nationkey, 3) AS n_key, c_mktsegment AS label FROM customer), b AS (SELECT nullif(n_nationkey, 3) AS n_key, n_name AS label, n_regionkey FROM nation WHERE n_nationkey <> 5)"
JOINED = "SELECT a.c_custkey, coalesce(a.n_key, b.n_key) AS n_key, a.label AS label_left, b.label AS label_right, b.n_regionkey FROM a {} JOIN b ON a.n_key IS NOT DISTINCT FROM b.n_key"


def _join(how: str):
    def run(t: Tables):
        return relational.join_tables(*small(t), on="n_key", how=how, suffixes=("_left", "_right"))

    run.__name__ = f"join_{how}"
    query(f"WITH {SMALL} {JOINED.format({'outer': 'FULL'}.get(how, how.upper()))}")(run)


for _how in ("inner", "left", "right", "outer"):
    _join(_how)


@query(f"WITH {SMALL} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.n_key IS NOT DISTINCT FROM b.n_key)")
def join_anti(t: Tables):
    return relational.join_tables(*small(t), on="n_key", how="left_anti")


@query("SELECT o.o_orderkey, o.o_custkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_validate(t: Tables):
    orders, customers = t.orders.select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_name")
    return relational.join_tables(orders, customers, left_on="o_custkey", right_on="c_custkey", validate="m:1").drop("c_custkey")


@query("SELECT l_orderkey AS order_id, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_key_inference(t: Tables):
    return relational.join_tables(t.lineitem.select(F.col("l_orderkey").alias("order_id"), "l_linenumber"), t.orders.select(F.col("o_orderkey").alias("order_id"), "o_totalprice"))


@query("SELECT c_name AS name, c_nationkey AS nation, 'table_1' AS source_table FROM customer UNION ALL SELECT s_name, s_nationkey, 'table_2' FROM supplier")
def union_source_label(t: Tables):
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return relational.union_tables([a, t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))], source_column="source_table")


@query("SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier")
def union_missing(t: Tables):
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return relational.union_tables([a, t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))], strict_schema=False)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, round(avg(l_discount), 6) AS l_discount, count(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL")
def groupby_map(t: Tables):
    g = relational.groupby_table(t.lineitem, ["l_returnflag", "l_linestatus"], {"l_quantity": "sum", "l_discount": "mean", "l_orderkey": "count"}, sort=False)
    return g.withColumn("l_quantity", F.round("l_quantity", 2)).withColumn("l_discount", F.round("l_discount", 6))


@query("""SELECT o_orderpriority, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, round(median(o_totalprice), 4) AS o_totalprice_median,
round(stddev_samp(o_totalprice), 4) AS o_totalprice_std, count(DISTINCT o_custkey) AS o_custkey_nunique, arg_min(o_custkey, o_orderkey) AS o_custkey_first, arg_max(o_custkey, o_orderkey) AS o_custkey_last FROM orders GROUP BY 1""")
def groupby_list(t: Tables):
    g = relational.groupby_table(t.orders, "o_orderpriority", {"o_totalprice": ["min", "max", "median", "std"], "o_custkey": ["nunique", "first", "last"]}, sort=False, order=F.col("o_orderkey"))
    return g.withColumn("o_totalprice_median", F.round("o_totalprice_median", 4)).withColumn("o_totalprice_std", F.round("o_totalprice_std", 4))


@query("SELECT nullif(c_nationkey, 3) AS n_key, round(coalesce(sum(CASE WHEN c_nationkey <> 4 THEN c_acctbal END), 0), 2) AS bal FROM customer GROUP BY 1")
def groupby_null_keys(t: Tables):
    rows = t.customer.select(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("n_key"), F.when(F.col("c_nationkey") != 4, F.col("c_acctbal")).alias("bal"))
    return relational.groupby_table(rows, "n_key", {"bal": "sum"}, sort=False).withColumn("bal", F.round("bal", 2))


@query("SELECT nullif(c_nationkey, 3) AS n_key, count(*) AS c_custkey FROM customer WHERE c_nationkey <> 3 GROUP BY 1")
def groupby_dropna(t: Tables):
    rows = t.customer.select(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("n_key"), "c_custkey")
    return relational.groupby_table(rows, "n_key", {"c_custkey": "size"}, dropna=True, sort=False)


AGGS = """agg AS (SELECT p_brand, i AS col, round(coalesce(sum(n), 0), 2) AS "sum", round(avg(n), 6) AS average, min(n) AS "min", max(n) AS "max", count(n) AS "count", count(*) AS counta FROM (
  SELECT p_brand, 3 AS i, NULL AS n FROM part UNION ALL SELECT p_brand, 5, p_size FROM part UNION ALL SELECT p_brand, 6, p_retailprice FROM part) GROUP BY 1, 2)"""


def brand_aggregates(t: Tables):
    cells = reads.cells_from_table(t.part, "part", F.col("p_partkey")).where("row > 1 and col in (3, 5, 6)")
    keyed = cells.join(t.part.select((F.col("p_partkey") + 2).alias("row"), "p_brand"), "row")
    g = aggregates.spreadsheet_aggregates(keyed, ["p_brand", "col"])
    return g.withColumn("sum", F.round("sum", 2)).withColumn("average", F.round("average", 6))


@query(f'WITH {AGGS} SELECT p_brand, CAST(col AS INTEGER) AS col, "sum", average, CAST("min" AS DOUBLE) AS "min", CAST("max" AS DOUBLE) AS "max", "count", counta FROM agg')
def spreadsheet_aggs(t: Tables):
    return brand_aggregates(t)


@query(f"""WITH {AGGS} SELECT p_brand, CAST(col AS INTEGER) AS col, CAST(code AS INTEGER) AS code, CASE code % 100 WHEN 1 THEN average WHEN 2 THEN "count" WHEN 3 THEN counta WHEN 4 THEN "max" WHEN 5 THEN "min" ELSE "sum" END AS value
FROM agg, (SELECT unnest([1, 2, 3, 4, 5, 9, 101, 109]) AS code)""")
def subtotal_codes(t: Tables):
    coded = brand_aggregates(t).withColumn("code", F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 5, 9, 101, 109)))))
    return coded.select("p_brand", "col", "code", aggregates.subtotal(F.col("code")).alias("value"))


@query("""SELECT user_id AS run_id, count(*) AS calls, count(*) FILTER (event_type = 'click') AS capped_calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_ms,
CAST(sum(event_id % 7) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 5) AS BIGINT) AS completion_tokens, bool_and(event_type <> 'error') AS success FROM events GROUP BY 1""")
def call_rollup(t: Tables):
    calls = t.events.select(F.col("user_id").alias("run_id"), F.floor("value").alias("duration_ms"), (F.col("event_id") % 7).alias("prompt_tokens"), (F.col("event_id") % 5).alias("completion_tokens"), (F.col("event_type") == "click").alias("capped"), (F.col("event_type") != "error").alias("success"))
    return aggregates.call_rollup(calls)


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn DESC) AS place FROM conversations)
SELECT conv_id, turn AS round, score, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS shown FROM r WHERE place <= 5""")
def best_attempts(t: Tables):
    attempts = t.conversations.select("conv_id", F.col("turn").alias("round"), F.length("text").cast("bigint").alias("score"))
    return aggregates.best_attempts(attempts, "conv_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn DESC) AS place FROM conversations WHERE turn > 0)
SELECT conv_id, coalesce(string_agg('<attempt round="' || turn || '" subtask="' || role || '">' || chr(10) || '  <description>d</description>' || chr(10) || '  <reasoning></reasoning>' || chr(10) || '  <code>' || chr(10)
|| CASE WHEN length(text) <= 60 THEN text ELSE text[:20] || chr(10) || '...[truncated]...' || chr(10) || text[-21:] END || chr(10) || '  </code>' || chr(10) || '  <observation>' || chr(10)
|| CASE WHEN length(text) <= 30 THEN text ELSE text[:30] || '...' END || chr(10) || '  </observation>' || chr(10) || '</attempt>', chr(10) || chr(10) ORDER BY turn), 'No previous experience.') AS text
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT * FROM r WHERE place <= 5) USING (conv_id) GROUP BY 1""")
def attempts_text(t: Tables):
    said = t.conversations.where("turn > 0").select("conv_id", F.col("turn").alias("round"), F.col("role").alias("subtask_id"), F.lit("d").alias("description"), F.lit(None).cast("string").alias("reasoning"), F.col("text").alias("code"), F.col("text").alias("observation"), F.length("text").alias("score"))
    return aggregates.attempts_text(said, "conv_id", code_chars=60, observation_chars=30, keys=t.conversations)


@query("""WITH s AS (SELECT DISTINCT source AS wb_id, lang AS sheet FROM documents), r AS (SELECT source AS wb_id, lang AS sheet, CASE WHEN bool_and(quality = 1) THEN 'good' ELSE 'not_good' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT wb_id, sheet, coalesce(status, 'not_good') AS status FROM s LEFT JOIN r USING (wb_id, sheet)""")
def completeness(t: Tables):
    where = [F.col("source").alias("wb_id"), F.col("lang").alias("sheet")]
    results = t.documents.join(t.labels, "doc_id").groupBy(*where).agg(F.when(F.bool_and(F.col("quality") == 1), "good").otherwise("not_good").alias("status"))
    return aggregates.completeness(t.documents.select(*where).distinct(), results)


@query("SELECT user_id AS run_id, count(*) AS results, count(*) FILTER (event_type <> 'click' OR event_id % 5 = 0) AS failures FROM events GROUP BY 1")
def run_failures(t: Tables):
    status = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_type") == "click", "good").otherwise("not_good")
    return aggregates.failures(t.events.select(F.col("user_id").alias("run_id"), status.alias("status")))


@query("SELECT count(DISTINCT source) AS files, count(*) AS sheets, count(*) / greatest(count(DISTINCT source), 1) AS sheets_per_file FROM (SELECT DISTINCT source, lang FROM documents)")
def work_totals(t: Tables):
    return aggregates.work_totals(t.documents.select(F.col("source").alias("wb_id"), F.col("lang").alias("sheet")).distinct())


@query("SELECT source AS wb_id, l AS sheet FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(['en', 'fr', 'xx']) AS l) EXCEPT SELECT source, lang FROM documents")
def missing_sheets(t: Tables):
    sheets = t.documents.select(F.col("source").alias("wb_id"), F.col("lang").alias("sheet")).distinct()
    return filters.missing_sheets(sheets.select("wb_id").distinct(), sheets, ["en, fr", "xx"])


@query("SELECT page_id, url FROM pages WHERE lower(string_split(url, '/')[-1]) IN (SELECT lower(string_split(url, '/')[-1]) FROM pages WHERE page_id % 3 = 0)")
def authorised_pages(t: Tables):
    allowed = t.pages.where("page_id % 3 = 0").select(F.col("url").alias("path"))
    return filters.authorised(t.pages.select("page_id", F.col("url").alias("path")), allowed).select("page_id", F.col("path").alias("url"))
