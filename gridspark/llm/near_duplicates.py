"""Near duplicates by a signature-coordinate inverted join.

A text's set of word shingles has a MinHash signature; texts are posted under (coordinate, value) pairs. Two signatures that
agree in at least m of COORDINATES coordinates must share one of their COORDINATES - m + 1 rarest pairs, so that
only these are posted: long lists are skipped without losing a collision. Pairs of texts that meet in lists have their collisions
counted, the count is completed over the skipped coordinates from both signatures, and pairs of at least m are confirmed on full sets.

Each text of a list meets the list's most central one, which links most copies without all pairs of a list. Texts of lists that
hold several components yet are joined once more, by the rarest shingles of their full sets, which is exact; their collisions
are counted too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import kept, save, slices, text_or_empty
from gridspark.llm.components import connected_components

#: Words of a shingle, coordinates of a signature, and how rarely a pair at the least similarity may lack agreeing ones.
SHINGLE, COORDINATES, MISSED = 5, 32, 1e-6
#: Texts compared with one central text in a task.
SALTED = 256
#: Remembered words of a worker.
REMEMBERED = 500_000

_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3)) & (2**64 - 1) | 1 for i in range(64)], np.uint64)


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value



def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, A-Z lower-cased; a shorter text is one shingle, an empty one has none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(kept("shingles", _Words).__getitem__, words), np.uint64, len(words))
    span = min(size, len(words))
    n = len(words) - span + 1
    total = np.full(n, span, np.uint64)
    for i in range(span):
        total += hashes[i : i + n] * _MIX[i]
    return np.unique(_mixed(total))


def signatures(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """Least mixed hash of each non-empty set under each coordinate's multiplier."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat(_mixed(joined * m), starts) for m in _MIX[16 : 16 + coordinates]], axis=1)


def least_matches(per_cent: int, coordinates: int = COORDINATES) -> int:
    """Most coordinates that may be asked to agree: a pair at a similarity of per_cent / 100 has fewer with a chance below MISSED (16 at 85, 13 at 80)."""
    p, fewer = per_cent / 100, 0.0
    for m in range(coordinates + 1):
        fewer += math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if fewer >= MISSED:
            break
    if m == 0:
        raise ValueError(f"{coordinates} coordinates are too few for a similarity of {per_cent} per cent")
    return m


def _features(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("signature", pa.list_(pa.int64()))])

    def run(batches):
        for part in slices(batches):
            sets = [shingle_set(t) for t in part.column(1).to_pylist()]
            filled = [s for s in sets if len(s)]
            rows = iter(signatures(filled).view(np.int64) if filled else ())
            sig = [next(rows) if len(s) else None for s in sets]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sig, schema.field(3).type)], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_hash binary, signature array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    """id, items: full sets, packed."""
    schema = pa.schema([("id", pa.int64()), ("items", pa.binary())])

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "id bigint, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets' Jaccard similarity is at least per_cent / 100; a text with many partners is dealt to tasks of about SALTED of them."""
    wide = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / SALTED).cast("bigint").alias("ways"))
    dealt = pairs.join(wide, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("ways")).alias("salt"))
    many = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "items")
    one = dealt.select("a", "salt").distinct().join(sets.withColumnRenamed("id", "a"), "a").select(F.col("a").alias("centre"), F.col("salt").alias("part"), F.col("items").alias("centre_items"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        centre = np.frombuffer(right["centre_items"][0].as_py(), np.uint64)
        near = []
        for raw in left["items"].to_pylist():
            other = np.frombuffer(raw, np.uint64)
            at = np.searchsorted(centre, other)
            shared = int((np.append(centre, 0)[at] == other)[at < len(centre)].sum())
            near.append(100 * shared >= per_cent * (len(centre) + len(other) - shared))
        return left.select(["a", "b"]).filter(pa.array(near))

    return many.groupBy("a", "salt").cogroup(one.groupBy("centre", "part")).applyInArrow(compare, "a bigint, b bigint")


def above_threshold(pairs: DataFrame, signatures: DataFrame, matches: int) -> DataFrame:
    """Those of the pairs (a, b, collisions in their lists) that agree in at least `matches` coordinates; signatures: id, signature.

    Pairs with as many collisions in their lists already are not looked at again; the others' counts are completed.
    """
    enough = pairs.where(F.col("collisions") >= matches).select("a", "b")
    open_ = pairs.where(F.col("collisions") < matches).select("a", "b")
    for x in "ab":
        open_ = open_.join(signatures.select(F.col("id").alias(x), F.col("signature").alias(f"s_{x}")), x)
    agree = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return enough.unionByName(open_.where(agree >= matches).select("a", "b"))


def _rarest_shingles(sets: DataFrame, per_cent: int) -> DataFrame:
    """Of sets: the shingles that any partner must share one of (each set's rarest 100 - per_cent per cent and one more), with the set's size and how many rarer shingles it has before each."""
    n = F.octet_length("items") / 8
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("n", pa.int32())])

    def unpack(batches):
        for batch in batches:
            for one, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), one)), pa.array(items), pa.array(np.full(len(items), len(items), np.int32))], schema=schema)

    items = sets.where(n > 0).mapInArrow(unpack, "id bigint, item bigint, n int")
    shared = items.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    common = items.join(shared, "item")  # shingles of one set only drop out here; their number is what is missing
    own = common.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("c"))
    alone = F.col("n") - F.size("c")
    length = F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1 - alone
    return own.where(length > 0).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("c", F.lit(1), length.cast("int"))).alias("i", "x")).select("id", "n", (F.col("alone") + F.col("i")).alias("before"), F.col("x.item").alias("item"))


def near_duplicate_components(docs: DataFrame, per_cent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Texts whose sets of 5-word shingles have 100 * intersection >= per_cent * union are linked; component_id is the smallest
    doc_id reachable, itself included. Null and empty texts have no shingles and are linked with nothing. Rows with a null id
    are linked with nothing and kept, with a null component. Rows that repeat an id share its component.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    features = save(_features(rows), "near-features")
    classes = features.where("doc_id is not null and n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = save(classes, "near-classes")

    matches = least_matches(per_cent)
    # postings: of each class the rarest of its (coordinate, value) pairs, as far as others share them
    pairs = classes.select("id", "n", F.posexplode("signature").alias("k", "value"))
    frequent = pairs.groupBy("k", "value").agg(F.count("*").alias("f")).where("f > 1")
    shared = pairs.join(frequent, ["k", "value"]).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "k", "value"))).alias("c"))
    prefix = COORDINATES - matches + 1 - (COORDINATES - F.size("c"))
    posted = shared.where((prefix > 0) & (F.size("c") >= matches)).select("id", "n", F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + x["f"]).alias("centrality"), F.explode(F.slice("c", F.lit(1), prefix)).alias("x"))
    posted = save(posted.select("id", "n", "centrality", F.col("x.k").alias("k"), F.col("x.value").alias("value")), "near-posted")

    # each list's most central text against the others of like size
    centres = posted.groupBy("k", "value").agg(F.max_by(F.struct("id", "n"), F.struct("centrality", -F.col("id"))).alias("centre"), F.count("*").alias("members")).where("members > 1")
    to_centre = posted.join(centres, ["k", "value"]).where("centre.id <> id")
    like = (F.least("n", "centre.n") * 100 >= F.greatest("n", "centre.n") * per_cent)
    spokes = to_centre.where(like).groupBy(F.col("centre.id").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("collisions"))
    candidates = to_centre.select("id").unionByName(to_centre.select(F.col("centre.id").alias("id"))).distinct()
    sets = save(_sets(rows.where("doc_id is not null").join(candidates.withColumnRenamed("id", "doc_id"), "doc_id").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "text")), "near-sets")
    links = save(confirmed(save(above_threshold(spokes, classes, matches), "near-spokes"), sets, per_cent), "near-links")
    found = connected_components(links)

    # lists that hold several components yet: their texts are joined by the rarest shingles of their full sets, as all pairs of
    # these lists would grow with the square of a group of near copies; the pairs' collisions are counted all the same
    labelled = posted.join(found, "id", "left").select("id", "k", "value", F.coalesce("component", "id").alias("component"))
    open_lists = labelled.groupBy("k", "value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("k", "value")
    apart = save(labelled.join(open_lists, ["k", "value"], "left_semi").select("id", "component").distinct(), "near-apart")
    rare = save(_rarest_shingles(sets.join(apart, "id", "left_semi"), per_cent).join(apart, "id"), "near-rare")
    a, b = (rare.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "before", "component")), "item") for x in "ab")
    # at a pair's first common shingle neither can share the rarer ones before it: that bounds what both can have
    most = F.least(F.col("n_a") - F.col("before_a"), F.col("n_b") - F.col("before_b"))
    possible = (F.col("component_a") != F.col("component_b")) & (F.col("id_a") < F.col("id_b")) & (100 * most >= per_cent * (F.col("n_a") + F.col("n_b") - most))
    late = a.join(b, a["item"].eqNullSafe(b["item"]) & possible).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(0).alias("collisions")).distinct()
    late_links = save(confirmed(save(above_threshold(late, classes, matches), "near-late"), sets, per_cent), "near-links")
    if late_links.isEmpty():
        final = found
    else:
        final = connected_components(links.unionByName(late_links))

    of_class = classes.select("set_hash", "id").join(final, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
    joined = features.select("doc_id", "n_shingles", "set_hash").join(of_class, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
