"""Stages of the pipeline on the small corpus."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import near_duplicates
from tests.llm.test_search import components, shingles


def test_stages(spark, docs, labels, tmp_path):
    named = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(None, "lost " * 20, "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    named.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids, columns = [], kept.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        found = stage(spark, kept, str(tmp_path))
        found.write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        ids.append([r.doc_id for r in kept.collect()])
        assert set(ids[-1]) <= before
        if i < 4:
            assert kept.columns == columns
    assert None not in ids[0] and not {50, 51, 52, 53, 54} & set(ids[0])
    assert len(set(ids[2])) == len(ids[2]) and len({40, 41, 42, 43, 44, 45} & set(ids[2])) <= 1 and len({3, 46, 47} & set(ids[2])) <= 1
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in run.collect()}) == sorted(set(ids[4]))


def test_stages_of_an_empty_table_and_of_clashing_columns(spark, docs, no_docs, labels, tmp_path):
    """Columns named like the operators' own stay as they are, and a table without rows goes through."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, some in (("none", no_docs), ("all", docs.withColumns({"row": F.lit(1), "kept": F.lit("k"), "score": F.lit(0.5), "n": F.lit("n")}))):
        some.write.parquet(f"{tmp_path}/{name}.parquet")
        kept = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        columns = kept.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{i}")
            kept = spark.read.parquet(f"{tmp_path}/{name}-{i}")
            assert i == 4 or kept.columns == columns
        assert kept.count() == 0 if name == "none" else kept.count() > 0


def test_one_row_of_a_repeated_id_stays(spark):
    rng = random.Random(2)
    say = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    texts = [say() for _ in range(3)]
    docs = spark.createDataFrame([(1, t, "en", "s", 1) for t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = min(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert [r.text for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [want]


def test_near_dedup_is_brute_force(spark):
    """Groups by brute force, with pairs planted from 0.78 to 0.87: from 0.80 on one of each goes."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        copy = words[: 204 - (16 + i // 2)] + [f"n{rng.randrange(10**6)}" for _ in range(i % 2)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    sets = {i: shingles(t) for i, t in rows}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    planted = [share(2 * i, 2 * i + 1) for i in range(60)]
    assert sum(0.8 <= s < 0.85 for s in planted) >= 10 and min(planted) < 0.8 and max(planted) >= 0.85
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = sorted(set(components(links, sets).values()))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want


def test_least_matches():
    assert near_duplicates.least_matches(85) == 16 and near_duplicates.least_matches(80) == 13
