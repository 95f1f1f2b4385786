import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import aggregates, reads, retrieval
from gridspark.sources import documents, runs, workbooks

RELATION = "wb_id bigint, table_id string, category string, ord int, relation_id string, expression string, description string, range string, pattern string, agg_function string, cell string, raw string, errors string"


def test_a_runs_tables_come_back(spark, tmp_path):
    text = '{"sea": {"name": "Sea", "headers": [{"id": "a", "label": "A", "header_range": "A1", "sub_headers": [{"id": "b", "label": "B"}]}]}}'
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    rows = [(1, "sea", "normal_formulas", 0, "r1", "a = b", "d", "A1:A3", None, None, "A1", "=B1", None), (1, "sea", "normal_formulas", 1, "r2", None, None, None, None, None, None, "=C1", None), (2, "sky", "invalid_formulas", 0, "r3", None, None, None, None, None, "C9", "=#REF!", '[{"token": "#REF!"}]')]
    relations = spark.createDataFrame(rows, RELATION)
    cards = spark.createDataFrame([("c1", "w", "s", "t", "x"), ("c1", "w", "s", "t", "later"), ("c2", "w", "s", "t", "ö\n")], "id string, workbook string, sheet string, table_id string, card string")
    metadata = spark.createDataFrame([(1, "w.xlsx", ["s"])], "wb_id bigint, name string, sheet_names array<string>")
    path = f"{tmp_path}/out"
    runs.write_run(spark, path, "first", {"schema": docs, "relations": runs.relation_documents(relations), "cards": cards, "metadata": metadata}, {"status": "good", "answers": [1, None]}, {"cards": "json", "metadata": "json"})
    assert runs.runs(spark, path) == ["first"]
    tables, facts = runs.read_run(spark, path, "first")
    assert facts == {"status": "good", "answers": [1, None]} and tables["metadata"].collect() == metadata.collect()
    assert [(r.header_id, r.parent_id) for r in documents.structure_headers(tables["schema"]).orderBy("ord").collect()] == [("a", None), ("b", "a")]
    back = documents.relations(tables["relations"], "wb_id").orderBy("relation_id").collect()
    assert [(r.doc_id, r.table_id, r.category, r.relation_id, r.expression, r.range, r.cell, r.raw, r.errors) for r in back] == [(r[0], r[1], r[2], r[4], r[5], r[7], r[10], r[11], r[12]) for r in rows]
    assert sorted(r.card for r in workbooks.first_records(tables["cards"], ["card"]).collect()) == ["later", "ö\n"]


def test_failed_and_second_runs_leave_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    fine = spark.range(3)
    with pytest.raises(Exception, match="no good"):
        runs.write_run(spark, path, "bad", {"a": fine, "b": fine.select(F.raise_error(F.lit("no good")).cast("string").alias("x"))})
    assert runs.runs(spark, path) == [] and [x for x in os.listdir(path) if not x.endswith(".crc")] == []
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, path, "bad")
    runs.write_run(spark, path, "one", {"a": fine.limit(0)})
    with pytest.raises(FileExistsError):
        runs.write_run(spark, path, "one", {"a": fine})
    tables, facts = runs.read_run(spark, path, "one")
    assert tables["a"].count() == 0 and facts == {} and tables["a"].columns == ["id"]
    for name in ("", "a/b", "_x"):
        with pytest.raises(ValueError):
            runs.write_run(spark, path, name, {})
    with pytest.raises(Exception, match="known category"):
        runs.relation_documents(spark.createDataFrame([(1, None, "normal_formulas", 0, *[None] * 9)], RELATION)).collect()


def test_an_encoder_sees_each_missing_text_once(spark, tmp_path):
    def load(folder=str(tmp_path)):
        import uuid

        def model(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write("\n".join(texts))
            return np.array([[len(x), 1.0] for x in texts])

        return model

    cards = spark.createDataFrame([(i, f"text {i}" if i != 7 else None) for i in range(50)], "card_id int, card string")
    stored = spark.createDataFrame([(i, "m", [0.5, 0.5]) for i in range(20)] + [(30, "other", [9.0, 9.0])], "card_id int, model string, embedding array<double>")
    made = {r.card_id: (r.reused, r.embedding) for r in retrieval.with_embeddings(cards.coalesce(2), stored, "m", retrieval.batch_encoder(load, 8)).collect()}
    assert len(made) == 50 and made[3] == (True, [0.5, 0.5]) and made[30] == (False, [7.0, 1.0])
    seen = [open(f"{tmp_path}/{x}").read().split("\n") for x in os.listdir(tmp_path)]
    assert sorted(x for batch in seen for x in batch) == sorted(f"text {i}" for i in range(20, 50)) and max(map(len, seen)) <= 8


def test_attempts_as_text(spark):
    rows = [(1, 1, "s1", "d", "why", "x" * 100, "o", 0.0), (1, 2, "s2", "d", None, "y", None, 1.0), (1, 3, "s3", "d", "", "z", "p", 0.0)]
    attempts = spark.createDataFrame(rows, "k int, round int, subtask_id string, description string, reasoning string, code string, observation string, score double")
    texts = {r.k: r.text for r in aggregates.attempts_text(attempts, "k", most=2, keys=spark.createDataFrame([(1,), (2,)], "k int")).collect()}
    assert texts[2] == "No previous experience."
    assert texts[1].startswith('<attempt round="2" subtask="s2">\n  <description>d</description>\n  <reasoning></reasoning>\n  <code>\ny\n  </code>\n  <observation>\n\n  </observation>\n</attempt>\n\n<attempt round="3"')
    assert texts[1].count("<attempt") == 2 and 'round="3"' in texts[1] and 'round="1"' not in texts[1]


def test_areas_grow_over_many_bands(spark):
    merges = spark.createDataFrame([("w", "s", 1, 1, 5000, 1), ("w", "s", 4990, 1, 4990, 3), ("w", "s", 9000, 1, 9001, 1), ("w", "t", 1, 1, 9, 9)], "wb_id string, sheet string, r1 bigint, c1 bigint, r2 bigint, c2 bigint")
    areas = spark.createDataFrame([("w", "s", 2, 1, 2, 1), ("w", "u", 1, 1, 1, 1)], merges.schema)
    assert {tuple(r) for r in reads.grow_to_merges(areas, merges).collect()} == {("w", "s", 1, 1, 5000, 3), ("w", "u", 1, 1, 1, 1)}
