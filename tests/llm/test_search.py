"""Vector search, near duplicates and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridspark.llm import near_duplicates, substring_dedup, vector_search
from gridspark.llm.components import connected_components


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    want = components(pairs, {x for p in pairs for x in p})
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def check_near(rows, corpus):
    sets = {i: shingles(t) for i, t, _ in corpus}
    ids = sorted(sets)
    linked = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
    want = components([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if linked(sets[a], sets[b])], ids)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == Counter((i, len(sets[i]), want[i], want[i] == i) for i, _, _ in corpus)


def test_near_duplicates(docs, no_docs, corpus):
    check_near(near_duplicates.near_duplicate_components(docs).collect(), corpus)
    assert near_duplicates.near_duplicate_components(no_docs).collect() == []


def test_near_duplicates_in_chains(spark):
    """A group in which neighbours are linked and the ends are not, and near copies that only some link to."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 200]), "en") for i in range(40)]
    base = words[600:800]
    for i in range(100, 130):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "en"))
    check_near(near_duplicates.near_duplicate_components(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect(), rows)


def test_partners_are_dealt_without_bound(spark, monkeypatch):
    """A centre of 400 partners at 2 a task comes to more than 64 groups, each a small one."""
    monkeypatch.setattr(near_duplicates, "SALTED", 2)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 401)], "a bigint, b bigint")
    sets = near_duplicates._sets(spark.createDataFrame([(i, "a b c d e f g" if i % 2 == 0 else "h i j k l m n") for i in range(401)], "id bigint, text string"))
    dealt = []
    frame = type(pairs)
    group = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda df, *by: (dealt.append(df) if by == ("a", "salt") else None) or group(df, *by))
    found = near_duplicates.confirmed(pairs, sets, 85)
    assert sorted((r.a, r.b) for r in found.collect()) == [(0, i) for i in range(2, 401, 2)]
    sizes = [r["count"] for r in group(dealt[0], "a", "salt").count().collect()]
    assert len(sizes) > 64 and max(sizes) <= 12


def test_null_ids(spark):
    rows = near_duplicates.near_duplicate_components(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter({(None, None, True): 2, (1, 1, True): 1})


def removed(corpus, width):
    texts = [(i, (t or "").encode()) for i, t, _ in corpus]
    seen = Counter(b[k : k + width] for _, b in texts for k in range(len(b) - width + 1))
    want = Counter()
    for i, b in texts:
        off = [False] * len(b)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                off[k : k + width] = [True] * width
        kept = bytes(x for x, gone in zip(b, off, strict=True) if not gone)
        spans = sum(gone and (k == 0 or not off[k - 1]) for k, gone in enumerate(off))
        want[i, len(b), sum(off), spans, hashlib.sha256(kept).hexdigest()] += 1
    return want


def test_substring_dedup(docs, no_docs, corpus):
    found = substring_dedup.remove_repeats(docs, block_bytes=8192).collect()
    assert Counter(tuple(r) for r in found) == removed(corpus, 200)
    assert substring_dedup.remove_repeats(no_docs).collect() == []


def test_substring_dedup_borders(spark):
    """Matches of 199, 200 and 201 bytes, overlapping repeats within a text, and stretches of one byte."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    shared = [noise(n) for n in (199, 200, 201, 450)]
    rows = [(i, noise(37 + i) + s + noise(61), "en") for i, s in enumerate(shared)] + [(10 + i, noise(90) + s + noise(5 * i), "en") for i, s in enumerate(shared)]
    rows += [(20, "z" * 900, "en"), (21, shared[3][100:400] + noise(10) + shared[3][:260], "en"), (22, noise(150) * 4, "en"), (23, noise(200), "en")]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), with_text=True).collect()
    assert Counter(tuple(r)[:5] for r in found) == removed(rows, 200)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found)


def test_substring_dedup_of_texts_written_to_collide(spark):
    """Thue-Morse blocks share every polynomial fingerprint modulo a power of two; no 200-byte string repeats here."""
    signs = [bin(i).count("1") % 2 for i in range(64)]
    word = lambda turn: "".join(a[s ^ turn] for a in ("+>", "[R", "CX") for s in signs) + "filler--"
    one, other = word(0), word(1)
    rows = [(1, one, "en"), (2, other, "en"), (3, one[:199] + "?", "en"), (4, other[:199] + "?", "en")]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert Counter(tuple(r) for r in found) == removed(rows, 200)
    assert not any(r.n_removed for r in found)


def test_fingerprints_are_of_the_whole_string():
    rng = np.random.default_rng(3)
    data, drawn = rng.integers(0, 256, 700_000).astype(np.uint8), substring_dedup.multipliers()
    data[400_000:400_500] = data[1000:1500]
    for width in (14, 133, 200, 300):
        x = substring_dedup.fingerprints(data, width, drawn)
        assert len(x) == len(data) - width + 1 and x.max() <= substring_dedup.PRIME
        _, first, n = np.unique(x, return_index=True, return_counts=True)
        assert sorted(first[n > 1]) == list(range(1000, 1501 - width))
        change = data[:width].copy()
        for i in range(width):
            change[i] ^= 1
            assert substring_dedup.fingerprints(change, width, drawn)[0] != x[0]
            change[i] ^= 1


def test_packed_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 61, 5000, dtype=np.uint64))
    assert (substring_dedup.unpacked_keys(substring_dedup.packed_keys(keys, np.zeros(len(keys), bool))) == keys).all()


def test_substring_dedup_carries_rows(docs, corpus):
    found = substring_dedup.remove_repeats(docs, with_text=True, carry=True)
    assert found.select("row.*").columns == [c for c in docs.columns if c != "text"]
    assert Counter((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()) == removed(corpus, 200)


def test_cover():
    cover, v = substring_dedup.COVER, substring_dedup.COVER_PERIOD
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def brute_top(rows, k=5):
    ok = [(i, [int(256 * x // 1) for x in v]) for i, v in rows if i is not None and v and all(x is not None and abs(x) < float("inf") for x in v)]
    want = Counter()
    for q, a in ok:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            for rank, (s, i) in enumerate(scored, 1):
                want[q, rank, i, -s] += 1
    return want


def test_vector_search(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(230)]
    rows += [(i + 1000, rows[i][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [float("nan")] * 24), (2002, [None] * 24), (2050, []), (2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (None, rows[0][1]), (2150, [float("inf")] * 24), (3000, [0.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    found = vector_search.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert Counter(tuple(r) for r in found) == brute_top(rows)
    assert vector_search.top_k(df.limit(0), F.lit(True)).collect() == []


def test_vector_search_of_repeated_rows(spark):
    """Rows of one id are one vector: no neighbour comes twice, and no query has two answers."""
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-9, 9)) for _ in range(6)]) for i in range(120)]
    df = spark.createDataFrame([*rows, *rows[:60], *[rows[50]] * 30, (7, [99.0] * 6)], "vec_id bigint, embedding array<double>")
    found = vector_search.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert Counter(tuple(r) for r in found) == brute_top(sorted(({i: v for i, v in rows} | {7: min(rows[7][1], [99.0] * 6)}).items()))


def test_bounds_leave_few_pairs():
    """On the given table less than a fifth of the pairs survives all levels, and each level lets through fewer."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.floor(256 * np.array(table["embedding"].to_pylist())).astype(np.int64)
    ids, counts = table["vec_id"].to_numpy(), []
    ask = ids % 50 == 0
    seeds = vector_search.exact_scores(x[ask], x[:512])
    seeds[ids[ask][:, None] == ids[None, :512]] = -(10**9)
    floors = np.sort(seeds, axis=1)[:, -5]
    got = vector_search.top_k_block(ids[ask], x[ask], floors, ids, x, vector_search.turned(x[:1024]), 5, counts)
    shares = counts[0][1:] / counts[0][0]
    assert (np.diff(shares) <= 0).all() and shares[-1] < 0.2
    want = x[ask] @ x.T
    want[ids[ask][:, None] == ids[None, :]] = -(10**9)
    assert (got[2].reshape(-1, 5) == -np.sort(-want, axis=1)[:, :5]).all()


def test_exact_scores_of_large_numbers():
    q, x = np.array([[2**31, 3], [1, 1]]), np.array([[2**30, 5], [-7, 2]])
    assert vector_search.exact_scores(q, x).tolist() == [[2**61 + 15, -7 * 2**31 + 6], [2**30 + 5, -5]]


def test_vector_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CANDIDATES", 50)
    monkeypatch.setattr(vector_search, "QUERIES", 2)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(260)]
    found = vector_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert Counter(tuple(r) for r in found) == brute_top(rows)
