"""Packing documents into token sequences by a grouping genetic algorithm on islands.

Items are dealt to shards of bounded size. A shard's islands evolve their own populations of packings: crossover injects whole
well-filled sequences of one packing into another, drops those that would hold an item twice, and best-fits the displaced
items. Between epochs each island's elite migrates to the next island of its shard. Sequences that stay short are opened
again and their items go, pooled over all shards, through another round.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from tokenizers import Tokenizer

from gridspark.llm.common import arrow_schema, kept, no_cycles, save, slices, text_or_empty

#: Items of a shard, islands of a shard, epochs with a migration between them.
SHARD_ITEMS, ISLANDS, EPOCHS = 4096, 2, 2
#: Packings of an island and generations of an epoch.
POPULATION, GENERATIONS = 3, 5
#: A sequence filled less than this is opened again in the next round; rounds at most.
WELL_FILLED, ROUNDS = 0.995, 4
#: Remembered chunks of a worker, and characters of the longest one that is.
REMEMBERED, LONGEST = 600_000, 64

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# ---- packings -----------------------------------------------------------------------------------------------------------


def best_fit(items, lengths, bins: list[list[int]], fills: list[int], capacity: int) -> None:
    """Put items, longest first, each into the sequence that it fills most; open one where none has room."""
    rooms = sorted((capacity - fill, i) for i, fill in enumerate(fills) if fill < capacity)
    for item in items:
        need = int(lengths[item])
        at = bisect_left(rooms, (need, -1))
        if at < len(rooms):
            room, i = rooms.pop(at)
            bins[i].append(item)
            fills[i] += need
        else:
            i, room = len(bins), capacity
            bins.append([item])
            fills.append(need)
        if room > need:
            insort(rooms, (room - need, i))


def fitness(fills: list[int], capacity: int) -> tuple[int, float]:
    """Fewer sequences are better, then unevenly filled ones; larger is better."""
    return -len(fills), float(np.square(np.array(fills) / capacity).sum())


def cross(base, donor, lengths, capacity: int, rng) -> tuple[list[list[int]], list[int]]:
    """Inject well-filled sequences of donor into base; sequences of base that share an item go, their other items are best-fitted."""
    bins, fills = donor
    good = np.flatnonzero(np.array(fills) >= np.quantile(fills, 0.5))
    chosen = [i for i in good if rng.random() < 0.5]
    injected = {item for i in chosen for item in bins[i]}
    new_bins, new_fills, displaced = [list(bins[i]) for i in chosen], [fills[i] for i in chosen], []
    for items, fill in zip(*base, strict=True):
        if injected.isdisjoint(items):
            new_bins.append(list(items))
            new_fills.append(fill)
        else:
            displaced += [x for x in items if x not in injected]
    displaced.sort(key=lambda x: -lengths[x])
    best_fit(displaced, lengths, new_bins, new_fills, capacity)
    return new_bins, new_fills


def mutate(packing, lengths, capacity: int, rng):
    """Open the emptiest sequences and a few others and best-fit their items."""
    bins, fills = packing
    opened = set(np.argsort(fills)[: 1 + len(fills) // 50].tolist()) | set(rng.integers(0, len(fills), 1 + len(fills) // 50).tolist())
    new_bins = [list(x) for i, x in enumerate(bins) if i not in opened]
    new_fills = [x for i, x in enumerate(fills) if i not in opened]
    displaced = sorted((x for i in opened for x in bins[i]), key=lambda x: -lengths[x])
    best_fit(displaced, lengths, new_bins, new_fills, capacity)
    return new_bins, new_fills


def evolve(lengths: np.ndarray, capacity: int, seed: int, elites=()):
    """The best packing after an epoch; elites are packings to start from."""
    rng, population = np.random.default_rng(seed), list(elites)
    bound = -(-int(lengths.sum()) // capacity)
    while len(population) < POPULATION:
        noise = 1 if not population else rng.uniform(0.9, 1.1, len(lengths))
        packing: tuple[list, list] = ([], [])
        best_fit(np.argsort(-lengths * noise, kind="stable").tolist(), lengths, *packing, capacity)
        population.append(packing)
    rank = lambda x: fitness(x[1], capacity)
    for _ in range(GENERATIONS):
        population.sort(key=rank, reverse=True)
        if len(population[0][1]) <= bound:
            break
        children = []
        for k in range(len(population) - 1):
            a, b = rng.choice(len(population), 2, replace=False)
            children.append(cross(population[a], population[b], lengths, capacity, rng))
            if k == 0:
                children.append(mutate(population[0], lengths, capacity, rng))
        population = sorted(population + children, key=rank, reverse=True)[:POPULATION]
    return max(population, key=rank)


SOLVED = "shard bigint, island int, item bigint, length bigint, bin bigint, bins bigint, squares double"


def _epoch(members: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch of every island; members: shard, island, item, length, origin (null: not yet packed) and bin."""
    schema = arrow_schema(SOLVED)

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        shard, island = table["shard"][0].as_py(), table["island"][0].as_py()
        item, length = table["item"].to_numpy(), table["length"].to_numpy()
        ids, first, where = np.unique(item, return_index=True, return_inverse=True)
        lengths, elites = length[first], []
        if epoch:
            origin, bin_of = table["origin"].to_numpy(), table["bin"].to_numpy()
            for source in np.unique(origin):
                own = origin == source
                bins: list[list[int]] = [[] for _ in range(int(bin_of[own].max()) + 1)]
                for x, b in zip(where[own].tolist(), bin_of[own].tolist(), strict=True):
                    bins[b].append(x)
                elites.append((bins, [int(lengths[b].sum()) for b in bins]))
        bins, fills = evolve(lengths, capacity, hash((shard, island, epoch)) & 0x7FFFFFFF, elites)
        order = np.concatenate([np.array(b, np.int64) for b in bins])
        n = len(order)
        columns = [np.full(n, shard), np.full(n, island), ids[order], lengths[order], np.repeat(np.arange(len(bins)), [len(b) for b in bins]), np.full(n, len(bins)), np.full(n, fitness(fills, capacity)[1])]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return members.groupBy("shard", "island").applyInArrow(run, SOLVED)


def pack(items: DataFrame, capacity: int, item_col: str = "item", length_col: str = "length") -> DataFrame:
    """item, sequence_id, offset: a place for every item in sequences of at most capacity, offsets gapless from 0.

    Items are distinct longs of at least 0; lengths are from 0 to capacity, longer ones raise. Full items are a sequence of
    their own. An empty table gives an empty one. Work is by shards of about SHARD_ITEMS items, whatever the table's size.
    """
    longs = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(length_col).cast("bigint").alias("length"))
    too_long = F.when(F.col("length") > capacity, F.raise_error(F.lit("an item is longer than a sequence"))).otherwise(F.col("length"))
    longs = longs.select("item", too_long.alias("length"))
    placed = longs.where(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = longs.where(F.col("length") < capacity)
    for level in range(ROUNDS):
        n = rest.count()
        shards = max(1, -(-n // SHARD_ITEMS))
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)))
        members = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "item", "length", F.lit(None).cast("int").alias("origin"), F.lit(None).cast("bigint").alias("bin"))
        for epoch in range(EPOCHS):
            elites = save(_epoch(members, capacity, epoch), f"pack-{level}-{epoch}")
            to = F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)))  # an elite stays and migrates
            members = elites.select("shard", F.explode(to).alias("to"), "item", "length", F.col("island").alias("origin"), "bin").withColumnRenamed("to", "island")
        best = elites.groupBy("shard").agg(F.min(F.struct("bins", -F.col("squares"), "island"))["island"].alias("island"))
        chosen = elites.join(best, ["shard", "island"])
        in_bin = W.Window.partitionBy("shard", "bin")
        fill = F.sum("length").over(in_bin)
        offset = F.coalesce(F.sum("length").over(in_bin.orderBy("item").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
        chosen = chosen.select("item", "length", (F.lit(level << 56) + F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id"), offset.alias("offset"), fill.alias("fill"))
        if level == ROUNDS - 1 or shards == 1:
            return placed.unionByName(chosen.select("item", "sequence_id", "offset"))
        chosen = save(chosen, f"packed-{level}")
        good = F.col("fill") >= WELL_FILLED * capacity
        placed = placed.unionByName(chosen.where(good).select("item", "sequence_id", "offset"))
        rest = chosen.where(~good).select("item", "length")
    raise AssertionError("unreachable")


# ---- tokens -------------------------------------------------------------------------------------------------------------


class WordTokens:
    """Token ids of texts by a tokenizer file of word-level BPE that drops white space, chunk by chunk.

    White space never joins a token, so that chunks between white space are encoded by themselves and remembered. A chunk of
    plain Latin letters is split by the file's own pattern and its words are merged by rank in C; others go to the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            described = json.load(file)
        added = [re.escape(x["content"]) for x in described.get("added_tokens", ())]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)  # texts that may hold an added token go to the tokenizer whole
        split = described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words, self.latin = regex.compile(split), re.compile("[\x00-ɏ]*")
        vocabulary, end = described["model"]["vocab"], described["model"]["end_of_word_suffix"]
        # the printable stand-ins of bytes: printable Latin-1 characters are themselves, the rest follow from U+0100 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        # byte 255 is in no UTF-8 text; it stands for the end of a word, which the lowest ranks of two bytes join to the last one
        ranks = {bytes(byte_of[c] for c in token.removesuffix(end)) + b"\xff" * token.endswith(end): rank for token, rank in vocabulary.items()}
        self.merger = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.chunks: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        plain = chunk.isascii()
        if plain or self.latin.fullmatch(chunk):
            lowered = (chunk if plain else unicodedata.normalize("NFC", chunk)).lower()
            words = [lowered] if lowered.isalpha() else self.words.findall(lowered)
            merge = self.merger.encode_single_piece
            ids = [i for word in words for i in merge(word.encode() + b"\xff")]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        packed = array("I", ids).tobytes()
        if len(chunk) <= LONGEST:
            if len(self.chunks) >= REMEMBERED:
                self.chunks.clear()
            self.chunks[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or self.added.search(text):  # the first are white space to str.split(), not to the tokenizer
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, chunk = self.chunks.get, self._chunk
        return b"".join([known(x) or chunk(x) for x in text.split()])


def word_tokens(path: str) -> WordTokens:
    return kept(("words", path), lambda: WordTokens(path))


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and end_id after them, cut into pieces of capacity ids where it is longer.

    doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and, if asked for, ids. Null and empty
    texts are one piece that holds end_id alone. Repeated rows give repeated pieces.
    """
    ddl = PIECES + (", ids array<bigint>" if with_ids else "")
    schema, closing = arrow_schema(ddl), np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokens = word_tokens(path)
        for part in slices(batches):
            at, columns = [], [[] for _ in range(5)]
            with no_cycles():
                encoded = [tokens.encode(text) + closing for text in part.column(1).to_pylist()]
            for i, raw in enumerate(encoded):
                for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[start : start + 4 * capacity]
                    at.append(i)
                    for column, x in zip(columns, (piece, start // 4, len(cut) // 4, zlib.crc32(cut), np.frombuffer(cut, "<u4") if with_ids else None), strict=True):
                        column.append(x)
            arrays = [part.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=False))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, ddl)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """tokenized_pieces() with a sequence_id and an offset for each piece, in as few sequences as the packing finds."""
    pieces = save(tokenized_pieces(docs, path, capacity, end_id, with_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity), "item").drop("item")
