"""Removal of repeated byte strings by a blockwise, depth-limited suffix sort with a difference cover.

A byte goes if a string of `width` bytes that covers it also starts anywhere else. Only the order of suffixes to that depth
matters, and of that only which suffixes are equal. Positions of a text whose remainder modulo v is in a difference cover D
are the sample: for any two positions some shift below v takes both into it. Two suffixes that agree for width bytes
therefore hold a pair of samples that agree for width - v + 1 bytes, so that

1. sample strings are sorted, bucket by bucket, and ranked repeated or not (the cover's ranks, as far as ties need them);
2. suffixes without a repeated sample in their first v bytes are unique and drop out;
3. the others, the long ties, are sorted bucket by bucket to the full depth, and equal neighbours are repeats.

Buckets are ranges of fingerprints, so that one holds about as much as a block of text, whatever the text. A sample's
fingerprint only sifts: equal strings always have equal ones, and unequal strings that share one are told apart as ties. Ties
have fingerprints of 61 bits modulo a prime with multipliers drawn for each run, so that two given strings share one with a
chance below 2^-58, whatever they are. A block sends each distinct key once to the key's bucket, sorted and as differences.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_schema, save, save_by, text_or_empty

#: A perfect difference set: every non-zero difference modulo 133 occurs once. Fixed values.
COVER_PERIOD, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
#: Bytes of text of a block, and of a stretch that is fingerprinted at once; blocks' worth of text of a bucket.
BLOCK_BYTES, STRETCH, BLOCKS_OF_A_BUCKET = 4 << 20, 1 << 18, 2
#: Bits of a tie's key; a sample's has so many more than the samples' number, so that about one in 64 is sifted in wrongly.
TIE_BITS, SPARE_BITS = 61, 6

PRIME = (1 << 61) - 1
_M30, _M31, _P = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1), np.uint64(PRIME)

PACKED = "block bigint, names array<binary>, lengths array<bigint>, copies array<int>, texts binary"
KEYS = "bucket int, block bigint, keys binary"
BITS = "block bigint, kind int, bucket int, bits binary"
KEPT = "h binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"

_rng = np.random.Generator(np.random.PCG64(20_24))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[n] = np.cumprod(up), np.cumprod(down)
    return _powers[n]


def sifting_keys(data: np.ndarray, at: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Quick keys of the width bytes from each of the places on, which are in order. Unequal strings may share one."""
    found = np.empty(len(at), np.uint64)
    up, down = _power_tables(STRETCH + 256)
    for start in range(0, len(data), STRETCH):
        own = slice(*np.searchsorted(at, (start, start + STRETCH)))
        if own.stop > own.start:
            part, places = data[start : start + STRETCH + width - 1], at[own] - start
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)])])
            x = (sums[places + width] - sums[places]) * down[places]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            found[own] = (x ^ (x >> np.uint64(29))) >> np.uint64(64 - bits)
    return found


def multipliers() -> list[int]:
    """Drawn for each run, so that no text can be written to collide."""
    return [secrets.randbelow(PRIME - 2) + 2 for _ in range(12)]


def _joined(high: np.ndarray, multiplier: int, low: np.ndarray) -> np.ndarray:
    """high * multiplier + low modulo the prime."""
    r_high, r_low = np.uint64(multiplier >> 31), np.uint64(multiplier & ((1 << 31) - 1))
    x_high, x_low = high >> np.uint64(31), high & _M31
    middle = x_high * r_low + x_low * r_high
    x = ((x_high * r_high) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _M30) << np.uint64(31)) + x_low * r_low
    x = (x & _P) + (x >> np.uint64(61)) + low
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def fingerprints(data: np.ndarray, width: int, drawn: list[int]) -> np.ndarray:
    """61-bit fingerprint of the width bytes from each position on; width is at least 14.

    Seven bytes are a number below the prime; twice as many are joined with another multiplier at each step, and two strings
    that overlap make up the width.
    """
    n = max(0, len(data) - width + 1)
    found = np.empty(n, np.uint64)
    for at in range(0, n, STRETCH):
        x = data[at : at + STRETCH + width - 1].astype(np.uint64)
        x = x[:-1] << np.uint64(8) | x[1:]
        x = x[:-2] << np.uint64(16) | x[2:]
        x = x[:-3] << np.uint64(24) | (x[3:] & np.uint64(0xFFFFFF))
        size, level = 7, 0
        while 2 * size <= width:
            x = _joined(x[:-size], drawn[level], x[size:])
            size, level = 2 * size, level + 1
        if size < width:
            x = _joined(x[: size - width], drawn[level], x[width - size :])
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) & _P  # spreads them over the buckets, one to one
        found[at : at + len(x)] = x ^ (x >> np.uint64(29))
    return found


def packed_keys(keys: np.ndarray, here: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of their places, and a bit each."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(4, "little") + zstandard.compress(planes.tobytes() + np.packbits(here).tobytes(), 1)


def unpacked_keys(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(zstandard.decompress(raw[4:]), np.uint8, 8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1))


class Block:
    """Whole texts side by side, of width bytes at least, and the exchange of their keys with buckets."""

    def __init__(self, row: dict, width: int, buckets: int):
        self.names, self.copies = row["names"], row["copies"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.data = np.frombuffer(zstandard.decompress(row["texts"]) if row["texts"] else b"", np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.width, self.buckets = width, buckets

    def _within(self, span: int) -> np.ndarray:
        """Positions whose span bytes lie in one text."""
        ok = np.ones(max(0, len(self.data) - span + 1), bool)
        for end in np.cumsum(self.lengths)[:-1]:
            ok[max(0, end - span + 1) : end] = False
        return ok

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions and the keys of their strings."""
        span = self.width - COVER_PERIOD + 1
        pattern = np.isin(np.arange(COVER_PERIOD), COVER)
        pattern = np.tile(pattern, -(-int(self.lengths.max(initial=0)) // COVER_PERIOD))
        chosen = np.concatenate([pattern[:n] for n in self.lengths] or [pattern])
        at = np.flatnonzero(chosen[: max(0, len(self.data) - span + 1)] & self._within(span))
        return at, sifting_keys(self.data, at, span, bits)

    def ties(self, sample_at: np.ndarray, repeated: np.ndarray, drawn: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes with a repeated sample in their first v bytes, and the fingerprints of their first width bytes."""
        at = sample_at[repeated]
        text_start = self.starts[np.searchsorted(self.starts, at, "right") - 1] if len(at) else at
        n = max(0, len(self.data) - self.width + 1)
        near = spans(np.maximum(at - COVER_PERIOD + 1, text_start), at + 1, len(self.data))
        found = np.flatnonzero(near[:n] & self._within(self.width))
        if not len(found):
            return found, np.zeros(0, np.uint64)
        needed = spans(found, found + self.width, len(self.data))  # only the ties' own bytes are fingerprinted
        place = np.cumsum(needed, dtype=np.int32)[found] - 1
        return found, fingerprints(self.data[needed], self.width, drawn)[place]

    def deal(self, keys: np.ndarray, bits: int):
        """Distinct keys in order, the buckets' borders in them, each key's place and whether it is repeated here."""
        distinct, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        borders = np.searchsorted(distinct, np.array([-(-(b << bits) // self.buckets) for b in range(self.buckets + 1)], np.uint64))
        return distinct, borders, place, count > 1

    def send(self, block: int, keys: np.ndarray, bits: int) -> pa.RecordBatch:
        distinct, borders, _, here = self.deal(keys, bits)
        rows = []
        for b in np.flatnonzero(np.diff(borders)).tolist():
            own = slice(borders[b], borders[b + 1])
            rows.append((b, block, packed_keys(distinct[own], here[own])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((), (), ()), arrow_schema(KEYS), strict=True)], schema=arrow_schema(KEYS))

    def receive(self, keys: np.ndarray, answers: dict[int, bytes], bits: int) -> np.ndarray:
        """Of each key, whether it is repeated anywhere."""
        distinct, borders, place, here = self.deal(keys, bits)
        repeated = here.copy()
        for b, raw in answers.items():
            own = slice(borders[b], borders[b + 1])
            repeated[own] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=own.stop - own.start).astype(bool)
        return repeated[place]


def spans(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Positions below size that are in one of the spans from starts to before ends."""
    step = np.bincount(starts, minlength=size + 1).astype(np.int32)
    step -= np.bincount(ends, minlength=size + 1).astype(np.int32)
    return np.cumsum(step, dtype=np.int32)[:size] > 0


def sort_bucket(table: pa.Table, kind: int) -> pa.Table:
    """Sorts one bucket's keys of all blocks; tells each block which of its keys are elsewhere too."""
    keys = [unpacked_keys(raw) for raw in table["keys"].to_pylist()]
    joined = np.concatenate(keys)
    order = np.argsort(joined, kind="stable")
    same = joined[order][1:] == joined[order][:-1]
    twice = np.zeros(len(joined), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    ends = np.cumsum([len(k) for k in keys])
    bits = [np.packbits(twice[end - len(k) : end]).tobytes() for k, end in zip(keys, ends, strict=True)]
    schema = arrow_schema(BITS)
    return pa.Table.from_arrays([table["block"].combine_chunks(), pa.array([kind] * len(keys), pa.int32()), table["bucket"].combine_chunks(), pa.array(bits, pa.binary())], schema=schema)


def remove_repeats(docs: DataFrame, width: int = 200, with_text: bool = False, carry: bool = False, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id (with carry: row, a struct of all columns but the text), n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text: one row per row of docs.

    Matches lie within a text; repeats in the same text and overlapping ones count, and all are judged on the input. Texts
    that occur more than once lose everything if they have width bytes. Null texts count as empty, null ids are kept. Nothing
    of a text shorter than width goes. kept_text is what stays as characters, without bytes of characters that were cut through.
    """
    if width < COVER_PERIOD:
        raise ValueError(f"width must be at least {COVER_PERIOD}")
    schema = {name: arrow_schema(ddl) for name, ddl in (("packed", PACKED), ("keys", KEYS), ("kept", KEPT))}
    first = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row") if carry else F.col(id_col).cast("bigint").alias("doc_id")
    rows = docs.select(first, text_or_empty(F.col(text_col)).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    key = rows.columns[0]
    short = rows.where(F.col("n_bytes") < width).select(key, "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept_text"))
    long = rows.where(F.col("n_bytes") >= width).withColumn("h", F.unhex(F.sha2("text", 256)))

    # one of each text takes part, combined before it travels; a text with copies loses everything
    texts = long.groupBy("h").agg(F.count("*").alias("n"), F.first("text").alias("text")).select("h", (F.col("n") > 1).cast("int").alias("copy"), "text")

    def pack(batches):
        block = (TaskContext.get().partitionId() << 32) - 1
        names, flags, raws, size = [], [], [], 0

        def row():
            texts = zstandard.compress(b"".join(raws), 3)
            return pa.RecordBatch.from_pylist([{"block": block, "names": names, "lengths": [len(x) for x in raws], "copies": flags, "texts": texts}], schema=schema["packed"])

        for batch in batches:
            for name, copy, raw in zip(*(batch.column(i) for i in range(2)), batch.column(2).cast(pa.binary()), strict=True):
                raw = raw.as_py()
                if size and size + len(raw) > block_bytes:
                    block += 1
                    yield row()
                    names, flags, raws, size = [], [], [], 0
                names.append(name.as_py())
                flags.append(copy.as_py())
                raws.append(raw)
                size += len(raw)
        if raws:
            block += 1
            yield row()

    packed = save_by(texts.mapInArrow(pack, PACKED), "dedup-blocks", "block")
    found = packed.agg(F.count("*").alias("blocks"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("bytes")).first()
    buckets = max(1, -(-(found["bytes"] or 0) // (BLOCKS_OF_A_BUCKET * block_bytes)))
    bits = min(60, max(20, ((found["bytes"] or 0) * len(COVER) // COVER_PERIOD).bit_length() + SPARE_BITS))
    drawn = multipliers()

    def samples(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, width, buckets)
                yield block.send(row["block"], block.samples(bits)[1], bits)

    ranks = save(packed.mapInArrow(samples, KEYS).groupBy("bucket").applyInArrow(lambda t: sort_bucket(t, 0), BITS), "dedup-ranks")

    def opened(left: pa.Table, right: pa.Table):
        row = left.to_pylist()[0]
        block, answers = Block(row, width, buckets), ({}, {})
        for kind, bucket, raw in zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["bits"].to_pylist(), strict=True):
            answers[kind][bucket] = raw
        at, names = block.samples(bits)
        return (row["block"], block, *block.ties(at, block.receive(names, answers[0], bits), drawn), answers[1])

    def ties(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema["keys"].empty_table()
        number, block, _, names, _ = opened(left, right)
        return pa.Table.from_batches([block.send(number, names, TIE_BITS)])

    tied = packed.groupBy("block").cogroup(ranks.groupBy("block")).applyInArrow(ties, KEYS)
    repeats = save(tied.groupBy("bucket").applyInArrow(lambda t: sort_bucket(t, 1), BITS), "dedup-repeats")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema["kept"].empty_table()
        _, block, at, names, answers = opened(left, right)
        at = at[block.receive(names, answers, TIE_BITS)]
        gone = spans(at, at + width, len(block.data))
        out = []
        for name, copy, start, n in zip(block.names, block.copies, block.starts, block.lengths, strict=True):
            off = np.ones(n, bool) if copy else gone[start : start + n]
            kept = block.data[start : start + n][~off].tobytes()
            runs = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
            out.append({"h": name, "n_removed": int(n) - len(kept), "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode("utf-8", "ignore") if with_text else None})
        return pa.Table.from_pylist(out, schema=schema["kept"])

    unique = packed.groupBy("block").cogroup(ranks.unionByName(repeats).groupBy("block")).applyInArrow(finish, KEPT)
    kept = long.select(key, "n_bytes", "h").join(unique, "h").select(short.columns)
    result = short.unionByName(kept)
    return result if with_text else result.drop("kept_text")
