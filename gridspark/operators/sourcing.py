"""Which sources a question may use, and what is reported of those that it got.

candidates: query_id, card_id, workbook, sheet, table_id, retrieval_type, retrieval_level, score, rank.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.functions.text import alias, safe_name
from gridspark.operators.retrieval import mentions


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)


def not_excluded(sources: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Sources without those whose file name and sheet, as compact names, are listed (exclusions: workbook, sheet)."""
    listed = exclusions.select(alias(file_name(F.col("workbook"))).alias("_book"), alias(F.col("sheet")).alias("_sheet")).distinct()
    keyed = sources.withColumn("_book", alias(file_name(F.col("workbook")))).withColumn("_sheet", alias(F.col("sheet")))
    return keyed.join(listed, ["_book", "_sheet"], "left_anti").drop("_book", "_sheet")


def candidate_pool(candidates: DataFrame, query_types: DataFrame) -> DataFrame:
    """Candidates of a question's type: data, metadata or both (query_types: query_id, query_type); a metadata question without any gets data ones."""
    j = candidates.join(query_types, "query_id")
    is_metadata = F.col("retrieval_type") == "metadata"
    fits = F.when(F.col("query_type") == "both", F.lit(True)).when(F.col("query_type") == "metadata", is_metadata).otherwise(~is_metadata)
    any_fit = F.max(fits).over(W.Window.partitionBy("query_id"))
    return j.withColumn("_fits", fits).withColumn("_any", any_fit).where("_fits or not _any").drop("_fits", "_any", "query_type")


def eligible(records: DataFrame, workbooks: DataFrame | None = None) -> DataFrame:
    """Records with a known workbook, a sheet and a card: workbook, sheet and card are the first of their names that is not blank.

    records: upload_name, document_name, workbook, sheet, sheet_name, retrieval_card, metadata (text of a mapping), all optional.
    """
    given = lambda *names: F.coalesce(F.lit(None).cast("string"), *(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in records.columns))
    has = records.select("*", given("upload_name", "document_name", "workbook").alias("_workbook"), given("sheet", "sheet_name").alias("_sheet"), given("retrieval_card", "metadata").alias("_card"))
    fine = has.where("_workbook is not null and _sheet is not null and _card is not null")
    if workbooks is not None:
        fine = fine.join(workbooks.select(F.col("workbook").alias("_workbook")).distinct(), "_workbook", "left_semi")
    rest = [c for c in records.columns if c not in ("workbook", "sheet", "retrieval_card")]
    return fine.select(*rest, F.col("_workbook").alias("workbook"), F.col("_sheet").alias("sheet"), F.col("_card").alias("retrieval_card"))


def should_retrieve(mode: Column, sheets: Column, table_id: Column) -> Column:
    """Whether a question needs a search: never if off or indexed, always in other fixed modes; auto searches unless one sheet or a table is given."""
    named = F.size(F.filter(F.coalesce(sheets, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    given = (named == 1) | (F.coalesce(table_id, F.lit("")) != "")
    return F.when(mode.isin("off", "indexed"), F.lit(False)).when(mode == "auto", ~given).otherwise(F.lit(True))


def candidate_batches(ranked: DataFrame, top_k: int, max_batches: int) -> DataFrame:
    """ranked with batch (from 1) of top_k candidates each, max_batches at most; batch b shows all of batches 1 to b."""
    batch = F.ceil(F.col("rank") / top_k).cast("int")
    return ranked.withColumn("batch", batch).where(F.col("batch") <= max_batches)


def searched(candidates: DataFrame, requests: DataFrame, required: DataFrame | None = None, headers: DataFrame | None = None) -> DataFrame:
    """Candidates that a search request allows: its tables, workbooks and sheets (arrays; empty or null: all), scores above min_score, each table once at its best.

    requests: query_id, allowed_table_ids, workbooks, sheets, min_score; required (query_id, label) asks for headers (table_id, label) too.
    """
    j = candidates.join(requests.select("query_id", F.col("allowed_table_ids").alias("_t"), F.col("workbooks").alias("_w"), F.col("sheets").alias("_s"), "min_score"), "query_id")
    inside = lambda listed, x: F.col(listed).isNull() | (F.size(listed) == 0) | F.array_contains(F.col(listed), F.col(x))
    fine = j.where(inside("_t", "table_id") & inside("_w", "workbook") & inside("_s", "sheet") & (F.col("score") > F.col("min_score"))).drop("_t", "_w", "_s", "min_score")
    if required is not None and headers is not None:
        low = lambda c: F.lower(F.trim(c))
        wanted = required.select("query_id", low("label").alias("label")).distinct()
        got = wanted.join(headers.select("table_id", low("label").alias("label")).distinct(), "label").groupBy("query_id", "table_id").agg(F.count("*").alias("n"))
        total = wanted.groupBy("query_id").agg(F.count("*").alias("needed"))
        have = got.join(total, "query_id").where("n = needed").select("query_id", "table_id")
        free = fine.join(total, "query_id", "left_anti")
        fine = free.unionByName(fine.join(have, ["query_id", "table_id"], "left_semi").select(free.columns))
    best = F.row_number().over(W.Window.partitionBy("query_id", "table_id").orderBy(F.desc("score"), "card_id"))
    return fine.withColumn("_best", best).where("_best = 1").drop("_best")


def by_workbook(candidates: DataFrame, workbooks: DataFrame | None = None) -> DataFrame:
    """Candidates with group (their workbook's place by best score) and place (within it, by score): the order of answers from many sources.

    Equal scores keep the order of card_id; workbooks (workbook), if given, are the known ones.
    """
    known = candidates if workbooks is None else candidates.join(workbooks.select("workbook").distinct(), "workbook", "left_semi")
    score = F.coalesce("score", F.lit(0.0))
    inside = W.Window.partitionBy("query_id", "workbook")
    ranked = known.withColumn("place", F.row_number().over(inside.orderBy(F.desc(score), "card_id")))
    heads = ranked.where("place = 1").select("query_id", "workbook", F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc(score), "card_id")).alias("group"))
    return ranked.join(heads, ["query_id", "workbook"])


def selection_payloads(selected: DataFrame, eligible_records: DataFrame, query_types: DataFrame, audits: DataFrame) -> DataFrame:
    """What is reported of each question's selection: query_type, candidate and workbook counts, the selected card's ids, and the audit with the selected one marked.

    selected: query_id, card_id, workbook, sheet, table_id; eligible_records: query_id, card_id, workbook, document_id; audits: query_id, audit (rank, card_id, score).
    """
    counts = eligible_records.groupBy("query_id").agg(F.count("*").alias("candidate_count"), F.countDistinct("workbook").alias("workbook_count"))
    document = eligible_records.groupBy("query_id", "card_id").agg(F.min("document_id").alias("document_id"))
    j = selected.join(counts, "query_id", "left").join(document, ["query_id", "card_id"], "left").join(query_types, "query_id", "left").join(audits.select("query_id", "audit"), "query_id", "left")
    marked = F.transform("audit", lambda x: F.struct(x["rank"].alias("rank"), x["card_id"].alias("card_id"), x["score"].alias("score"), (x["card_id"] == F.col("card_id")).alias("selected")))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("query_id", F.coalesce("query_type", F.lit("data")).alias("query_type"), count("candidate_count"), count("workbook_count"), F.coalesce("document_id", F.lit("")).alias("document_id"), file_name(F.col("workbook")).alias("workbook"), "sheet", "table_id", F.col("card_id").alias("selected_card_id"), marked.alias("audit"))


def related_sheets(primary: DataFrame, structures: DataFrame) -> DataFrame:
    """query_id, workbook, sheet, path: other structures of a primary source's workbook, the same path or the same safe file name, each sheet's first by path.

    primary: query_id, workbook, sheet; structures: workbook, sheet, path.
    """
    name = lambda c: safe_name(file_name(F.col(c)))
    p = primary.select("query_id", F.col("sheet").alias("own"), name("workbook").alias("book"), F.col("workbook").alias("own_book"))
    s = structures.where(F.coalesce("workbook", F.lit("")) != "").select("workbook", "sheet", "path", name("workbook").alias("book"))
    found = p.join(s, "book").where(F.col("own") != F.col("sheet"))
    first = F.row_number().over(W.Window.partitionBy("query_id", "sheet").orderBy("path"))
    return found.withColumn("first", first).where("first = 1").select("query_id", "workbook", "sheet", "path")


def earlier_sources(reports: DataFrame, asked: DataFrame) -> DataFrame:
    """sample_id, source, table_id: the source that earlier reports name for a sample's id, or else its question; the latest result wins.

    reports: report (name, in order), ord, sample_id, question, error, success, source (folder or path of a structure file),
    table_id; failed results and those without a source say nothing. asked: sample_id, question.
    """
    path = F.regexp_replace(F.coalesce("source", F.lit("")), r"\\", "/")
    folder = F.when(path.rlike(r"\.ya?ml$"), F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)).otherwise(F.regexp_extract(path, r"([^/]*)/*$", 1))
    good = reports.where(~F.coalesce("error", F.lit(False)) & F.coalesce("success", F.lit(True))).select("report", "ord", "sample_id", "question", folder.alias("source"), F.coalesce("table_id", F.lit("")).alias("table_id")).where("source <> ''")
    latest = lambda by: good.where(F.coalesce(by, F.lit("")) != "").groupBy(by).agg(F.max_by(F.struct("source", "table_id"), F.struct("report", "ord")).alias(f"by_{by}"))
    j = asked.join(latest("sample_id"), "sample_id", "left").join(latest("question"), "question", "left").withColumn("x", F.coalesce("by_sample_id", "by_question"))
    return j.where("x is not null").select("sample_id", "x.source", "x.table_id")


def _equal(left: DataFrame, right: DataFrame, on: dict[str, str], how: str, *more: str) -> DataFrame:
    """left with more columns of right, joined where columns are equal or both null."""
    r = right.select(*(F.col(c).alias(f"_r_{c}") for c in on.values()), *more)
    return left.join(r, functools.reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(f"_r_{b}")) for a, b in on.items())), how).drop(*(f"_r_{c}" for c in on.values()))


def unique_ids(names: DataFrame, keys: list[str], name: str, order: str, stem: str = "sheet") -> DataFrame:
    """names with id: lower-case letters and digits joined by _, `stem` for none, `stem_` before a digit; of equal ones the later get _2, _3 and so on.

    An id that another name already has as its own is passed over. Equal names are numbered by their place. Only where a name
    looks like another one's numbered id (`x_2` beside `x`) does the one's number depend on the other; such families of names,
    and no others, are gone through one by one.
    """
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
    bare = F.when(bare == "", F.lit(stem)).when(bare.rlike("^[0-9]"), F.concat(F.lit(f"{stem}_"), bare)).otherwise(bare)
    based = names.withColumn("_base", bare)
    bases = based.select(*keys, "_base").distinct()
    # the shortest name that a numbered one may come from; x_2_3 may be of x_2 and of x
    endings = F.transform(F.regexp_extract_all("_base", F.lit("(?=(_[0-9]+(?:_[0-9]+)*$))"), F.lit(1)), lambda e: F.col("_base").substr(F.lit(1), F.length("_base") - F.length(e)))
    found = _equal(bases.withColumn("_of", F.explode(endings)), bases, {**{k: k for k in keys}, "_of": "_base"}, "inner").groupBy(*keys, "_base").agg(F.min_by("_of", F.length("_of")).alias("_root"))
    families = found.unionByName(found.select(*keys, F.col("_root").alias("_base"), "_root").distinct())
    based = _equal(based, families, {k: k for k in (*keys, "_base")}, "left", "_root")
    place = F.row_number().over(W.Window.partitionBy(*keys, "_base").orderBy(order))
    alone = based.where("_root is null").withColumn("_place", place).withColumn("id", F.when(F.col("_place") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), F.col("_place").cast("string"))))

    columns = [*names.columns, "id"]

    def run(frame):
        frame, used, counts, ids = frame.sort_values(order, kind="stable"), set(), {}, []
        for base in frame["_base"]:
            made, n = base, counts.get(base, 2)
            while made in used:
                made, n = f"{base}_{n}", n + 1
            counts[base] = n
            used.add(made)
            ids.append(made)
        return frame.assign(id=ids)[columns]

    schema = names.withColumn("id", F.lit("")).schema
    related = based.where("_root is not null").groupBy(*keys, "_root").applyInPandas(run, schema)
    return alone.select(columns).unionByName(related)


def workbook_schemas(sheets: DataFrame, tables: DataFrame) -> DataFrame:
    """wb_id, schema: of each sheet in order its name, unique id, description and tables (id, name, description, headers).

    sheets: wb_id, sheet, ord, description; tables: wb_id, sheet, table_id, name, description, headers (any array).
    """
    made = unique_ids(sheets.select("wb_id", "sheet", "ord", "description"), ["wb_id"], "sheet", "ord")
    of_sheet = tables.groupBy("wb_id", "sheet").agg(F.sort_array(F.collect_list(F.struct("table_id", "name", F.col("description").alias("table_description"), "headers"))).alias("tables"))
    one = F.struct("ord", "sheet", "id", "description", F.coalesce("tables", F.array().cast(of_sheet.schema["tables"].dataType.simpleString())).alias("tables"))
    return made.join(of_sheet, ["wb_id", "sheet"], "left").groupBy("wb_id").agg(F.sort_array(F.collect_list(one)).alias("schema"))


def table_sheets(tables: DataFrame, sheets: DataFrame) -> DataFrame:
    """wb_id, table_id, sheet: the sheet that a table names if there is one (else null); without a name the only sheet, else the first whose name holds the table's id or name, else the first.

    tables: wb_id, table_id, name, sheet (may be blank); sheets: wb_id, sheet, ord.
    """
    t = tables.select("wb_id", "table_id", "name", F.nullif(F.trim(F.coalesce("sheet", F.lit(""))), F.lit("")).alias("named"))
    s = sheets.select("wb_id", "sheet", "ord")
    explicit = t.where("named is not null").join(s.withColumnRenamed("sheet", "named").select("wb_id", "named", F.lit(True).alias("there")).distinct(), ["wb_id", "named"], "left")
    explicit = explicit.select("wb_id", "table_id", F.when(F.col("there"), F.col("named")).alias("sheet"))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    holds = F.contains(low("sheet"), low("table_id")) | ((low("name") != "") & F.contains(low("sheet"), low("name")))
    guessed = t.where("named is null").join(s, "wb_id").groupBy("wb_id", "table_id").agg(F.min(F.struct((~holds).alias("other"), "ord", "sheet")).alias("x"))
    return explicit.unionByName(guessed.select("wb_id", "table_id", F.col("x.sheet").alias("sheet")))


def find_tables(asked: DataFrame, tables: DataFrame) -> DataFrame:
    """asked (ask_id, wanted) with table_id: the table of that id, or else the first of that name."""
    by_id = tables.select(F.col("table_id").alias("wanted"), F.col("table_id").alias("_id")).distinct()
    by_name = tables.groupBy(F.col("name").alias("wanted")).agg(F.min("table_id").alias("_name"))
    return asked.join(by_id, "wanted", "left").join(by_name, "wanted", "left").select(*asked.columns, F.coalesce("_id", "_name").alias("table_id"))


def result_markdown(rows: DataFrame, labels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, line (from 0), text: a result as Markdown, header ids replaced by their label where all selected tables agree on one.

    rows: key, ord and columns (named by header ids); labels: header_id, label. Line 0 has the names, line 1 the rule.
    """
    agreed = labels.where("trim(header_id) <> '' and trim(label) <> ''").groupBy(F.trim("header_id").alias("header_id")).agg(F.countDistinct(F.trim("label")).alias("n"), F.min(F.trim("label")).alias("label")).where("n = 1")
    tidy = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\|", r"\\|"), r"\r?\n", "<br>")
    line = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    wanted = agreed.where(F.col("header_id").isin(columns) & ~F.col("header_id").rlike("^[0-9]+$"))
    named = {r["header_id"]: r["label"] for r in wanted.collect()}  # at most as many as columns
    heads = rows.select(key).distinct().select(key, F.lit(0).cast("bigint").alias("line"), line([tidy(F.lit(named.get(c, c))) for c in columns]).alias("text"))
    rule = rows.select(key).distinct().select(key, F.lit(1).cast("bigint").alias("line"), line([F.lit("---")] * len(columns)).alias("text"))
    place = F.row_number().over(W.Window.partitionBy(key).orderBy("ord"))
    body = rows.select(key, (place + 1).cast("bigint").alias("line"), line([tidy(F.col(f"`{c}`")) for c in columns]).alias("text"))
    return heads.unionByName(rule).unionByName(body)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def catalogue_scope(asked: DataFrame, tables: DataFrame) -> DataFrame:
    """ask_id, sheet, table_id: what of a workbook's catalogue a question is about; table_id is null where it is about whole sheets.

    asked: ask_id, wb_id, scope (workbook, sheet or table; others raise), targets (array of names), text; tables: wb_id, sheet,
    table_id, name. Targets match names that hold them; without targets names that the text holds match. A workbook's scope is
    all of its sheets, and so are the sheets, or tables, of a question that matches none.
    """
    fine = F.when(F.col("scope").isin("workbook", "sheet", "table"), F.col("scope")).otherwise(F.raise_error(F.concat(F.lit("unknown scope: "), F.coalesce("scope", F.lit("")))).cast("string"))
    a = asked.select("ask_id", "wb_id", fine.alias("scope"), F.filter(F.coalesce("targets", F.array().cast("array<string>")), lambda x: F.trim(x) != "").alias("targets"), alias(F.col("text")).alias("said"))
    sheets = tables.select("wb_id", "sheet", F.lit(None).cast("string").alias("table_id")).distinct()
    of_sheet = sheets.select("wb_id", "sheet", "table_id", F.lit("sheet").alias("scope"), alias(F.col("sheet")).alias("named"))
    of_table = tables.select("wb_id", "sheet", "table_id", F.lit("table").alias("scope"), F.explode(F.array(alias(F.col("table_id")), alias(F.col("name")))).alias("named"))
    names = of_sheet.unionByName(of_table).where("named <> ''").distinct()
    by = ["wb_id", "scope"]
    wanted = a.where(F.size("targets") > 0).select("ask_id", "wb_id", "scope", F.explode("targets").alias("t")).select("ask_id", "wb_id", "scope", alias(F.col("t")).alias("target"))
    told = mentions(names, wanted, "named", "target", by).select("ask_id", "sheet", "table_id")
    heard = mentions(a.where(F.size("targets") == 0).select("ask_id", "wb_id", "scope", "said"), names, "said", "named", by).select("ask_id", "sheet", "table_id")
    matched = told.unionByName(heard).distinct()
    rest = a.select("ask_id", "wb_id", F.when(F.col("scope") == "workbook", "sheet").otherwise(F.col("scope")).alias("scope")).join(matched.select("ask_id").distinct(), "ask_id", "left_anti")
    whole = rest.join(of_sheet.select("wb_id", "scope", "sheet", "table_id").unionByName(of_table.select("wb_id", "scope", "sheet", "table_id")).distinct(), by).select("ask_id", "sheet", "table_id")
    return matched.unionByName(whole)


def raw_markdown(rows: DataFrame, key: str) -> DataFrame:
    """key, line, text: raw rows (key, ord, values: an array of texts) as Markdown; trailing blanks of all rows are trimmed, blank names are `Column n`.

    The first row by ord has the names; line 1 is the rule. Keys whose rows are all blank have no lines.
    """
    full = F.aggregate(F.transform("values", lambda x, i: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", i + 1).otherwise(0)), F.lit(0), lambda most, x: F.greatest(most, x))
    width = rows.groupBy(key).agg(F.max(full).alias("w")).where("w > 0")
    cell = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\|", r"\\|"), r"\r?\n", "<br>")
    placed = rows.join(width, key).withColumn("line", F.row_number().over(W.Window.partitionBy(key).orderBy("ord")) - 1)
    at = F.sequence(F.lit(0), F.col("w") - 1)
    named = F.transform(at, lambda i: F.when(F.trim(F.coalesce(F.get("values", i), F.lit(""))) == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(cell(F.get("values", i))))
    plain = F.transform(at, lambda i: cell(F.get("values", i)))
    line = lambda x: F.concat(F.lit("| "), F.array_join(x, " | "), F.lit(" |"))
    body = placed.select(key, F.when(F.col("line") == 0, 0).otherwise(F.col("line") + 1).cast("bigint").alias("line"), line(F.when(F.col("line") == 0, named).otherwise(plain)).alias("text"))
    return body.unionByName(width.select(key, F.lit(1).cast("bigint").alias("line"), line(F.transform(at, lambda i: F.lit("---"))).alias("text")))
