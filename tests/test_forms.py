"""Names in compatibility forms."""

import unicodedata

from pyspark.sql import functions as F

from gridspark.functions import text as T

NAMES = ["Trần Đình", "ＡＢＣ　１２", "ﬁnal ﬂow", "한국어 시트", unicodedata.normalize("NFD", "한국어 시트"), "①②", "½ ㎏", "Café", "Café", "𝐁𝐨𝐥𝐝 𝟏", "Ǆ", "ابﷺ", "plain [x]-^&", "", "ё й", "ﾊﾟｶﾞ", "ȩ́́", "日本語", "각", "가힣"]


def bare(text):
    d = {"Đ": "D", "đ": "d"}
    return "".join(d.get(c, c) for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_unaccented(spark):
    """Equal to the decomposition without marks, for names and for every character that has one."""
    every = [chr(i) for i in range(0x20, 0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.normalize("NFKD", chr(i)) != chr(i)]
    texts = NAMES + ["".join(every[i : i + 500]) for i in range(0, len(every), 500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").withColumn("u", T.unaccented(F.col("t"))).collect()
    assert {r.i: r.u for r in rows} == {i: bare(t) for i, t in enumerate(texts)} | {-1: None}


def test_names_meet(spark):
    pairs = [("ＳＡＬＥＳ２０２０", "sales2020"), ("한국어", unicodedata.normalize("NFD", "한국어")), ("ﬁrst", "FIRST"), ("Tổng hợp", "tong hop")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(T.alias(F.col("a")).alias("a"), T.alias(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b and r.a for r in rows)
