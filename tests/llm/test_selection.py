"""Filter audit and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import filter_audit, importance

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(text, doc_id, rows):
    words = WORD.findall(text)
    return "".join(
        f
        for f, x in zip(
            "ABCDE",
            (
                len(words) < 100,
                100 * len(set(words)) < 80 * len(words),
                100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                any(c in "#$%&*|" for c in text),
                doc_id is not None and any(t == text and i is not None and i < doc_id for i, t, _ in rows),
            ),
            strict=True,
        )
        if x
    )


def plain_audit(rows, labels):
    """Every document through every order, one by one."""
    rows = [(i, t or "", part or "") for i, t, part in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = [(i, part, failing(t, i, rows)) for i, t, part in rows]
    out = {}
    for part in {p for _, p, _ in judged}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in judged if p == part]
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                everything = [x for _, p, x in judged if p == part]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x for x in everything) - len(gone), sum(x == f for x in everything), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def audited(corpus):
    odd = [(60, "A a " * 60, ""), (61, "A a " * 60, None), (None, "one two", "fr"), (None, None, "fr"), (62, "x$ " + " ".join(map(str, range(120))), "en"), (62, "x$ " + " ".join(map(str, range(120))), "es"), (-5, "one two", "en")]
    return corpus + odd


def test_audit(spark, audited):
    labels = [(i, (i or 0) % 2, (i or 0) % 3 % 2) for i, _, _ in audited] + [(62, 0, None), (None, 1, 1), (41, None, 1)]
    docs = spark.createDataFrame([(*r, "x", 1, 1, b"d", 0) for r in audited], "doc_id bigint, text string, lang string, part string, mask int, id int, digest binary, copy int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit_text_filters(docs, marks)
    assert found.dtypes[:3] == [("part", "string"), ("filter_order", "string"), ("step", "int")] and {t for _, t in found.dtypes[3:]} == {"bigint"}
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in found.collect()}
    assert got == plain_audit(audited, labels)
    assert len(got) == 4 * 600
    assert filter_audit.audit_text_filters(docs.limit(0), marks).collect() == []
    assert filter_audit.audit_text_filters(docs, marks.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_removal_steps():
    names, places = filter_audit.orders("ABC")
    assert names == ["ABC", "ACB", "BAC", "BCA", "CAB", "CBA"] and places[:, names.index("CAB")].tolist() == [2, 3, 1]
    fails = np.array([[False, False, False], [True, False, True], [False, True, False]])
    assert filter_audit.removal_steps(fails, places).tolist() == [[4] * 6, [1, 1, 2, 2, 1, 1], [2, 3, 1, 1, 3, 2]]


def test_audit_of_other_filters(spark):
    """Any number of filters, profiles in several rows, counts that need more than 32 bits."""
    rows = [("p", 0b01, 3_000_000_000, 5, 1), ("p", 0b01, 2, 0, 0), ("p", 0b11, 7, 7, 0), ("q", 0, 4, 4, 0)]
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, n bigint, good bigint, toxic bigint"), "XY").collect()}
    assert found["p", "XY", 1] == [0, 3_000_000_009, 0, 3_000_000_002, 12, 1, 6_000_000_011]
    assert found["p", "YX", 1] == [3_000_000_002, 7, 0, 0, 7, 0, 7] and found["p", "YX", 2] == [0, 3_000_000_002, 7, 3_000_000_002, 5, 1, 6_000_000_011]
    assert found["q", "XY", 2] == [4, 0, 0, 0, 0, 0, 0] and len(found) == 8


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_resample(rows, target, seed, share, least, most):
    def runs(text):
        words = WORDS.findall(lower(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    found = [(i, *runs(t)) for i, t in rows]
    source, aim = Counter(b for _, _, x in found for b in x), Counter(b for t in target for b in runs(t)[1])
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (source.total() + 10000) / ((source[b] + 1) * (aim.total() + 10000))))
    out = []
    for i, words, x in found:
        weight = math.floor(sum(map(gain, x)) / len(x)) if x else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    may = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], -r[2], r[1]))
    for rank, r in enumerate(may[: len(may) * share // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("share", "most"), [(10, 1), (50, 1), (100, 2), (0, 1)])
def test_resample(spark, docs, corpus, share, most):
    extra = [(None, "ing on " * 40), (-9, "É1é x²\x7f0ab " * 30), (70, "the " * 5000)]
    rows = [(i, t) for i, t, _ in corpus] + extra
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(*r, None) for r in extra], "doc_id bigint, text string, lang string"))
    table = table.selectExpr("*", "1 as score", "2 as rank", "'w' as weight")
    target = [corpus[0][1], "The on the", None, ""]
    found = importance.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), share=share, most_words=most)
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    got, want = Counter(map(tuple, found.collect())), plain_resample(rows, target, "2024", share, 20, most)
    assert got == want


def test_resample_nothing(spark, docs, no_docs):
    empty = spark.createDataFrame([], "text string")
    assert importance.resample(no_docs, empty).collect() == []
    assert {r["rank"] for r in importance.resample(docs.where("length(text) < 30 or text is null"), empty).collect()} == {None}


def test_ranks_over_ranges(spark):
    """Ranks run on over several ranges, ties included."""
    rows = spark.range(1000).selectExpr("id", "id % 7 as score")
    found = importance.ranked(rows, [F.desc("score"), F.asc("id")], rows_a_part=90).collect()
    want = sorted(((r["id"], r["score"]) for r in found), key=lambda x: (-x[1], x[0]))
    assert [(r["id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in found) == list(range(1, 1001))


def test_bit_sliced_sum():
    rng = np.random.default_rng(3)
    gains, counts = rng.integers(-20000, 20000, importance.BUCKETS), rng.integers(0, 3, importance.BUCKETS)
    counts[17] = (1 << 40) + 5  # a count of many planes
    every = np.arange(importance.BUCKETS)
    plus, minus = (importance.bit_planes(every, np.maximum(x, 0)) for x in (gains, -gains))
    at = np.flatnonzero(counts)
    assert importance.weighted_sum(importance.bit_planes(at, counts[at]), plus, minus) == sum(int(c) * int(g) for c, g in zip(counts, gains, strict=True))
