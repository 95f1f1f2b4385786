"""Shape of plans, and the driver's entry points."""

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


JOINING = ["read_range", "formula_assign", "logical_table", "selection_read", "header_hints", "table_routing", "find_relation", "relation_table_ids"]


@pytest.mark.parametrize("name", [*JOINING, "extract_relations", "lexical_overlap"])
def test_no_nested_loops(spark, name):
    shown = plan(__spark_entry__.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


@pytest.mark.parametrize("name", JOINING)
def test_no_join_on_a_constant_or_a_sheet_alone(spark, name):
    """What is joined has a key of its own beside scope, workbook and sheet: a word, a beginning, a band, a position."""
    shown = plan(__spark_entry__.queries()[name](spark, SMALL))
    keys = re.findall(r"Left keys \[\d+\]: \[([^\]]*)\]", shown)
    assert keys
    for listed in keys:
        names = {re.sub(r"#\d+L?", "", x).strip() for x in listed.split(",")}
        assert names - {"scope", "wb_id", "sheet", "0"}, (name, listed)


def test_scan_is_narrow(spark):
    shown = plan(__spark_entry__.queries()["group_mask_any"](spark, SMALL))
    assert "l_extendedprice" not in shown and "l_discount" in shown


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and found.columns == ["query_id", "card_id", "rank", "score"]


def test_sql_is_of_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_findings(spark, tmp_path):
    """Nation 6: a label mended, a header grown to a merge over two texts; nation 7: a blank header below its parent."""
    rows = [(i, f"name {i}", 6 + i % 2, 1.5, "BUILDING", "note") for i in range(1, 9)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string, c_comment string").write.parquet(f"{tmp_path}/customer.parquet")
    found = sorted((r.wb_id, r.header_id, r.rule, r.severity) for r in __spark_entry__.queries()["verify_structure_all"](spark, str(tmp_path)).collect())
    assert found == [
        ("6", "kid", "child_header_outside", "error"), ("6", "kid", "label_repaired", "action"), ("6", "kid", "parent_data_over_child", "action"),
        ("6", "seg", "data_realigned", "action"), ("6", "seg", "header_merged", "action"), ("6", "seg", "header_texts", "error"), ("6", "seg", "label_repaired", "action"), ("6", "who", "label_repaired", "action"),
        ("7", "kid", "header_blank", "error"), ("7", "kid", "parent_data_over_child", "action"),
    ]
