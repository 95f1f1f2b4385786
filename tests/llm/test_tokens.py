"""Packing, token counts and byte-level BPE."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from gridspark.llm import bpe, packing, token_counts

WORD, MULTI, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  a  b", "a\n b", "a \n", "\n\n x", "Don't they'll", "12345 6a7", "İstanbul ΟΔΟΣ ß ﬁ", "日本語 😀", "a\x1cb \x85x\xa0y　z", "<|endoftext|>x", "ééé" * 60, "a" * 500, " lead", "trail ", "x\t\ty"]


def encoding(path):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_tiktoken(corpus):
    own, theirs = bpe.BacktrackingBpe(bpe.read_ranks(MULTI), P.PATTERN), encoding(MULTI)
    for text in [*ODD, *(t or "" for _, t, _ in corpus)]:
        ids = theirs.encode_ordinary(text)
        assert own.encode(text) == ids
        assert own.round_trip(text) == (len(ids), ",".join(map(str, ids)), text.encode())


def test_bpe_query(docs, no_docs, corpus):
    found = Counter(tuple(r) for r in bpe.round_trip_digests(docs, MULTI, P.PATTERN).collect())
    theirs, want = encoding(MULTI), Counter()
    for i, text, _ in corpus:
        ids = theirs.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert found == want
    assert bpe.round_trip_digests(no_docs, MULTI, P.PATTERN).collect() == []


def test_word_tokens_equal_the_tokenizer(corpus):
    own, theirs = packing.WordTokens(WORD), Tokenizer.from_file(WORD)
    special = ["hello <|endoftext|> world", "a<|startoftext|>b", "<|EndOfText|> <|endoftext", "x" * 5000 + " " + "y" * 70]
    for text in [*ODD, *special, *(t or "" for _, t, _ in corpus)]:
        want = np.array(theirs.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.encode(text) == want and own.encode(text) == want


def test_packing(docs, no_docs, corpus):
    capacity = 256
    rows = packing.pack_documents(docs, WORD, capacity).collect()
    tokenizer = Tokenizer.from_file(WORD)
    want = Counter()
    for i, text, _ in corpus:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            want[i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(r.length for r in rows) // capacity) + 1
    assert packing.pack_documents(no_docs, WORD, capacity).collect() == []


def test_evolution_beats_best_fit():
    """Items between a third and a half of a sequence: which ones share a sequence matters, and crossover finds better groups."""
    lengths = np.random.default_rng(8).integers(1150, 2049, 1536)
    first: tuple[list, list] = ([], [])
    packing.best_fit(np.argsort(-lengths, kind="stable").tolist(), lengths, *first, 4096)
    one = packing.evolve(lengths, 4096, 1)
    bins, fills = packing.evolve(lengths, 4096, 2, [one, packing.evolve(lengths, 4096, 3)])
    assert packing.fitness(fills, 4096) > packing.fitness(first[1], 4096)
    assert len(fills) <= len(one[1]) <= len(first[1])
    assert sorted(x for b in bins for x in b) == list(range(1536)) and max(fills) <= 4096


def test_packing_limits(spark):
    items = spark.createDataFrame([(i, x) for i, x in enumerate([10, 10, 7, 3, 0, 5, 5])], "item bigint, length bigint")
    rows = packing.pack(items, 10).collect()
    assert len(rows) == 7 and len({r.sequence_id for r in rows if r.item != 4}) == 4
    with pytest.raises(Exception, match="longer"):
        packing.pack(spark.createDataFrame([(1, 11)], "item bigint, length bigint"), 10).collect()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, no_docs, corpus, rule):
    bpe_, want = encoding(BYTE), Counter()
    for i, text, _ in corpus:
        raw = (text or "").encode()
        owner, lines = [], raw.split(b"\n")
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        for k, line in enumerate(lines):
            owner += [k] * len(line)
        own, crossing, at = Counter(), Counter(), 0
        for token in bpe_.encode_ordinary(text or ""):
            n = len(bpe_.decode_single_token_bytes(token))
            held = owner[at : at + n]
            k = held[0] if rule == "start" else held[-1] if rule == "end" else min(set(held), key=lambda s: (-held.count(s), s))
            own[k] += 1
            crossing[k] += len(set(held)) > 1
            at += n
        start = 0
        for k, line in enumerate(lines):
            want[i, k, start, len(line), own[k], crossing[k]] += 1
            start += len(line)
    assert Counter(tuple(r) for r in token_counts.section_token_counts(docs, BYTE, P.PATTERN, rule).collect()) == want
    assert token_counts.section_token_counts(no_docs, BYTE, P.PATTERN, rule).collect() == []
