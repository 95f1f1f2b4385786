"""Language-model scoring by prediction by partial matching over bytes, beside a unigram baseline over words.

The model is a trie of byte contexts up to a fixed order with the counts of the symbols that followed them in the training
texts (pretrained; scoring does not change it). A symbol is coded in the longest known context; where that context has not
seen it, an escape (method D: each distinct symbol of the context gives half a count to it) leads to the context one byte shorter, in
which the symbols of the longer one are excluded.

The trie never meets in one place. Blocks of texts report the distinct contexts and words they hold with training counts; a
report is dealt by a context's last three bytes, so that a shard has whole subtries of order three and more. The counts of
order two are added up apart, by the last two bytes, and each shard gets those of its contexts; orders nought and one are a table
of at most 257 x 257 counts. Shards answer each block with the log probability of each of its distinct contexts, and blocks add
up their texts. Contexts travel sorted, as differences.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_schema, block_count, block_of, crc_bucket, packed_longs, save, text_or_empty, unpacked_longs

#: Bytes of the longest context; at most 5, as a context and its symbol share 63 bits.
ORDER = 5
#: The symbol that ends a text, and stands before its first byte; bits of a symbol; symbols.
END, BITS, SYMBOLS = 256, 9, 257
#: Bytes of text of a block: long, as every block asks for each of its distinct contexts once.
BLOCK_BYTES = 12 << 20
#: Shards that contexts with equal last two bytes are dealt to at most, by the third.
SPREAD = 64
#: Symbols worked on at once.
CHUNK = 1 << 20

REPORT = "shard int, block int, grams binary, counts binary, words binary, word_counts binary"
PAIRS = "place int, grams binary, counts binary"
ANSWER = "block int, grams binary, logs binary, words binary, word_counts binary, n_words bigint, n_distinct bigint"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def symbol_runs(raws: list[bytes], order: int):
    """Chunks of (first text, its texts' symbol counts, grams): grams are order context symbols and the coded one, one per byte and text end."""

    def grams(parts: list[bytes], heads: list[bytes], ends: list[bool]):
        buffer = bytearray()
        pads, stops = [], []
        for part, head, end in zip(parts, heads, ends, strict=True):
            pads.append(len(buffer))
            buffer += bytes(order - len(head)) + head + part
            if end:
                stops.append(len(buffer))
                buffer += b"\0"
        symbols = np.frombuffer(bytes(buffer), np.uint8).astype(np.int64)
        valid = np.ones(len(symbols), bool)
        for i in range(order):
            at = np.array(pads) + i
            valid[at] = False
            symbols[at[[i < order - len(h) for h in heads]]] = END
        symbols[stops] = END
        found = np.zeros(len(symbols) - order, np.int64)
        for i in range(order + 1):
            found <<= BITS
            found |= symbols[i : len(symbols) - order + i]
        return found[valid[order:]]

    first, held, size = 0, [], 0
    for i, raw in enumerate(raws):
        if held and size + len(raw) > CHUNK:
            yield first, [len(x) + 1 for x in held], grams(held, [b""] * len(held), [True] * len(held))
            held, size = [], 0
        if len(raw) > CHUNK:
            for at in range(0, len(raw), CHUNK):
                part, end = raw[at : at + CHUNK], at + CHUNK >= len(raw)
                yield i, [len(part) + end], grams([part], [raw[max(0, at - order) : at]], [end])
            continue
        if not held:
            first = i
        held.append(raw)
        size += len(raw)
        if i + 1 < len(raws) and len(raws[i + 1]) > CHUNK:
            yield first, [len(x) + 1 for x in held], grams(held, [b""] * len(held), [True] * len(held))
            held, size = [], 0
    if held:
        yield first, [len(x) + 1 for x in held], grams(held, [b""] * len(held), [True] * len(held))


def lowered(texts: pa.ChunkedArray) -> list[bytes]:
    return [x.lower() for x in texts.cast(pa.binary()).to_pylist()]  # bytes.lower() changes A-Z only


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.add.reduceat(count[order], starts) if len(key) else count


def place_of_gram(grams: np.ndarray, places: int) -> np.ndarray:
    """By the last two context symbols."""
    key = (grams >> BITS) & ((1 << 2 * BITS) - 1)
    return ((key * 0x9E3779B1) >> 12) % places


def shard_of_gram(grams: np.ndarray, places: int, spread: int) -> np.ndarray:
    """By the last three context symbols: the place of two, and a share of it by the third."""
    third = (grams >> 3 * BITS) & ((1 << BITS) - 1)
    return place_of_gram(grams, places) * spread + ((third * 0x9E3779B1) >> 12) % spread


def _counts(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype(np.int32).tobytes(), 1)


def _counted(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), np.int32).astype(np.int64)


def report_block(block: int, texts: pa.ChunkedArray, train: np.ndarray, order: int, places: int, spread: int) -> pa.Table:
    """A block's distinct grams and words with training counts, dealt to shards; shard -1 gets its counts of symbol pairs, shards below that those of triples, by place."""
    raws = lowered(texts)
    keys, counts = [], []
    for first, sizes, grams in symbol_runs(raws, order):
        learnt = np.repeat(train[first : first + len(sizes)], sizes)
        for part, learn in ((grams[learnt], True), (grams[~learnt], False)):
            key, count = np.unique(part, return_counts=True)
            keys.append(key)
            counts.append(count if learn else np.zeros_like(count))
    keys, counts = merged(keys, counts)
    shorter = [merged([keys & ((1 << k * BITS) - 1)], [counts]) for k in (2, 3)]
    words: Counter = Counter()
    for raw, learn in zip(raws, train.tolist(), strict=True):
        if learn:
            words.update(raw.split())
    for raw, learn in zip(raws, train.tolist(), strict=True):
        if not learn:
            words.update(dict.fromkeys(raw.split(), 0))
    shards = places * spread
    dealt: list[list[bytes]] = [[] for _ in range(shards)]
    for word in words:
        dealt[zlib.crc32(word) % shards].append(word)
    rows = [(-1, packed_longs(shorter[0][0]), _counts(shorter[0][1]), b"", b"")]
    known = shorter[1][1] > 0
    triples, triple_counts = shorter[1][0][known], shorter[1][1][known]
    at = place_of_gram(triples, places)
    for p in np.unique(at).tolist():
        rows.append((-2 - p, packed_longs(triples[at == p]), _counts(triple_counts[at == p]), b"", b""))
    place = shard_of_gram(keys, places, spread)
    order_ = np.argsort(place, kind="stable")
    borders = np.searchsorted(place[order_], np.arange(shards + 1))
    for s in range(shards):
        own = order_[borders[s] : borders[s + 1]]
        if len(own) or dealt[s]:
            rows.append((s, packed_longs(keys[own]), _counts(counts[own]), b" ".join(dealt[s]), np.array([words[w] for w in dealt[s]], np.int32).tobytes()))
    columns = list(zip(*rows, strict=True))
    schema = arrow_schema(REPORT)
    return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), pa.array([block] * len(rows), pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], schema=schema)


def gram_logs(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int, triples: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each gram's last symbol after its context.

    grams: distinct, sorted; counts: in training; pairs: 257 x 257 counts. triples: all sorted triples that begin with two
    symbols of the grams' contexts, and their counts, where grams don't hold all contexts of order two.
    """
    symbol, tables = grams & ((1 << BITS) - 1), {}
    learnt = counts > 0
    keys, sums = grams[learnt], counts[learnt]
    for k in range(order, 1, -1):  # the contexts of each order: entries, and per context its total, its symbols, the total of these one order lower
        if k == 2 and triples is not None:
            keys, sums = triples
        elif k < order:
            keys, sums = merged([keys & ((1 << BITS * (k + 1)) - 1)], [sums])
        contexts = keys >> BITS
        starts = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(keys) else np.zeros(0, np.int64)
        add = lambda x, starts=starts: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64)
        tables[k] = [keys, sums, contexts[starts], add(sums), np.diff(starts, append=len(keys)), starts]
    for k in range(order, 1, -1):
        keys, starts = tables[k][0], tables[k][5]
        if k > 2:
            lower = tables[k - 1]
            below = lower[1][np.searchsorted(lower[0], keys & ((1 << BITS * k) - 1))]
        else:
            below = pairs[(keys >> BITS) & ((1 << BITS) - 1), keys & ((1 << BITS) - 1)]
        tables[k].append(np.add.reduceat(below, starts) if len(starts) else np.zeros(0, np.int64))
    singles = pairs.sum(0)
    logs, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    gone_n, gone_q = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)  # what the longer context excludes
    last = (grams >> BITS) & ((1 << BITS) - 1)
    for k in range(order, -1, -1):
        if k > 1:
            keys, sums, contexts, totals, kinds, _, lower_totals = tables[k]
            here = grams & ((1 << BITS * (k + 1)) - 1)
            at, entry = np.searchsorted(contexts, here >> BITS), np.searchsorted(keys, here)
            known = np.append(contexts, -1)[at] == here >> BITS
            n, q = np.where(known, np.append(totals, 0)[at], 0), np.where(known, np.append(kinds, 0)[at], 0)
            count = np.where(np.append(keys, -1)[entry] == here, np.append(sums, 0)[entry], 0)
            next_n = np.where(known, np.append(lower_totals, 0)[at], 0)
        elif k == 1:
            n, q, count = pairs.sum(1)[last], (pairs > 0).sum(1)[last], pairs[last, symbol]
            next_n = ((pairs > 0) @ singles)[last]
        else:
            n, q, count, next_n = np.full(len(grams), singles.sum()), np.full(len(grams), (singles > 0).sum()), singles[symbol], 0
        left_n, left_q = n - gone_n, q - gone_q
        usable = open_ & (left_n > 0)
        hit = usable & (count > 0)
        logs[hit] += np.log10((2 * count[hit] - 1) / (2 * left_n[hit]))
        miss = usable & (count == 0)
        logs[miss] += np.log10(left_q[miss] / (2 * left_n[miss]))
        open_ &= ~hit
        gone_n, gone_q = next_n, q
    logs[open_] -= np.log10(SYMBOLS - (singles > 0).sum())
    return logs


def answer_shard(table: pa.Table, triples: tuple[np.ndarray, np.ndarray], pairs: np.ndarray, order: int) -> pa.Table:
    """What a shard tells each block: its grams' log probabilities and its words' counts; block -1 gets the shard's totals."""
    get = lambda name: table[name].to_pylist()
    blocks, grams = get("block"), [unpacked_longs(x).view(np.int64) for x in get("grams")]
    keys, counts = merged(grams, [_counted(x) for x in get("counts")])
    logs = gram_logs(keys, counts, pairs, order, triples).astype(np.float32)
    words = [x.split() for x in get("words")]
    known: dict[bytes, int] = {}
    for own, own_counts in zip(words, get("word_counts"), strict=True):
        for word, n in zip(own, np.frombuffer(own_counts, np.int32).tolist(), strict=True):
            known[word] = known.get(word, 0) + n
    rows = [(-1, b"", b"", b"", b"", sum(known.values()), sum(n > 0 for n in known.values()))]
    for block, own, packed, own_words, raw in zip(blocks, grams, get("grams"), words, get("words"), strict=True):
        rows.append((block, packed, logs[np.searchsorted(keys, own)].tobytes(), raw, np.array([known[w] for w in own_words], np.int64).tobytes(), 0, 0))
    schema = arrow_schema(ANSWER)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def score(docs: DataFrame, held_out: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs, whole texts.

    Learns from all rows that aren't held out. A-Z is lower-cased. Tokens are runs without ASCII white space and one end; the
    baseline adds log10((c + 1) / (N + V + 1)) over them. The score is the model's log10 probability of the lower-cased bytes
    and the end. Null texts count as empty; without training rows the baseline is 0 and every symbol has one chance in 257.
    """
    if not 2 <= order <= 5:
        raise ValueError("order must be from 2 to 5")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), text_or_empty(F.col(text_col)).alias("text"))
    blocks = block_count(rows, "text", block_bytes)
    rows = rows.withColumn("block", block_of([F.col("doc_id"), F.col("text")], blocks))
    spread = min(SPREAD, blocks) if order > 2 else 1
    places = -(-blocks // spread)

    def report(table: pa.Table) -> pa.Table:
        return report_block(table["block"][0].as_py(), table["text"], ~table["held_out"].to_numpy(), order, places, spread)

    reports = save(rows.groupBy("block").applyInArrow(report, REPORT), "ppm-reports")

    def unpack(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked_longs(keys).view(np.int64)), pa.array(_counted(counts))], names=["pair", "n"])

    pairs = np.zeros((SYMBOLS, SYMBOLS), np.int64)  # at most 257 x 257 rows come to the driver
    for row in reports.where("shard = -1").select("grams", "counts").mapInArrow(unpack, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[row["pair"] >> BITS, row["pair"] & ((1 << BITS) - 1)] = row["n"]

    def add_triples(table: pa.Table) -> pa.Table:
        keys, counts = merged([unpacked_longs(x).view(np.int64) for x in table["grams"].to_pylist()], [_counted(x) for x in table["counts"].to_pylist()])
        return pa.Table.from_arrays([pa.array([-2 - table["shard"][0].as_py()], pa.int32()), pa.array([packed_longs(keys)]), pa.array([zstandard.compress(counts.tobytes(), 1)])], schema=arrow_schema(PAIRS))

    triples = reports.where("shard < -1").select("shard", "grams", "counts").groupBy("shard").applyInArrow(add_triples, PAIRS)
    shares = triples.select(F.explode(F.sequence(F.col("place") * spread, F.col("place") * spread + (spread - 1))).alias("own_shard"), F.col("grams").alias("triples"), F.col("counts").alias("triple_counts"))

    def answer(table: pa.Table, own: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow_schema(ANSWER).empty_table()
        known = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if own.num_rows:
            known = unpacked_longs(own["triples"][0].as_py()).view(np.int64), np.frombuffer(zstandard.decompress(own["triple_counts"][0].as_py()), np.int64)
        return answer_shard(table, known, pairs, order)

    answers = save(reports.where("shard >= 0").groupBy("shard").cogroup(shares.groupBy("own_shard")).applyInArrow(answer, ANSWER), "ppm-answers")
    totals = answers.where("block = -1").agg(F.sum("n_words").alias("n"), F.sum("n_distinct").alias("v")).first()
    ends = int(rows.where(~F.col("held_out")).count())
    n_train, distinct = (totals["n"] or 0) + ends, (totals["v"] or 0) + (ends > 0)
    per_token = np.log10(n_train + distinct + 1)
    schema = arrow_schema(SCORES)

    def add_up(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        keys = np.concatenate([unpacked_longs(x).view(np.int64) for x in found["grams"].to_pylist()])
        logs = np.concatenate([np.frombuffer(x, np.float32) for x in found["logs"].to_pylist()]).astype(np.float64)
        word_logs, known = {}, set()
        for own, counts in zip(found["words"].to_pylist(), found["word_counts"].to_pylist(), strict=True):
            counts = np.frombuffer(counts, np.int64)
            own = own.split()
            word_logs.update(zip(own, np.log10(counts + 1).tolist(), strict=True))
            known.update(w for w, n in zip(own, counts.tolist(), strict=True) if not n)
        raws, index = lowered(texts["text"]), pd.Index(keys)
        model = np.zeros(len(raws))
        for first, sizes, grams in symbol_runs(raws, order):
            each = logs[index.get_indexer(grams)]
            model[first : first + len(sizes)] += np.add.reduceat(each, np.cumsum([0, *sizes[:-1]]))
        tokens, n_known, base = [], [], []
        end_log = float(np.log10(ends + 1))
        for raw in raws:
            words = raw.split()
            tokens.append(len(words) + 1)
            n_known.append(sum([w not in known for w in words]) + (ends > 0))
            base.append(sum(map(word_logs.__getitem__, words)) + end_log - tokens[-1] * per_token)
        columns = [texts["doc_id"], texts["held_out"], tokens, n_known, [n_train] * len(raws), base, model]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(add_up, SCORES)


def score_held_out(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """score() on documents with one fold of crc32(doc_id) held out."""
    return score(docs, crc_bucket(F.col("doc_id"), folds) == fold)
