"""Byte-level BPE by backtracking over longest matches, and its inverse.

A piece is covered by its longest vocabulary matches from left to right. Where two of them could not stand side by side in a
merge-by-rank encoding, shorter matches are taken back to until all neighbours can. Whether two tokens can is decided once per
pair and remembered. The result equals merging by rank, in time linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_schema, kept, no_cycles, slices, text_or_empty

#: Remembered chunks, pairs and pieces of a worker, and characters of the longest chunk that is; a full memory is emptied, which costs time only.
REMEMBERED, LONGEST = 800_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], limit: int | None = None) -> list[bytes]:
    """The definition: join the adjacent pair of lowest rank (below limit) until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = limit, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BacktrackingBpe:
    """Encoder of pieces and decoder of ids for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.spaced_words = self.pattern.findall("ab Cd e") == ["ab", " Cd", " e"]  # a word is one match, with the space before it
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.matcher.add_word(token.decode("latin-1"), rank)
        self.matcher.make_automaton()
        # of each token: its last merge and its length
        self.lengths = [len(self.bytes_of.get(rank, b"")) for rank in range(max(self.bytes_of) + 1)]
        self.halves = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merge_by_rank(token, ranks, rank)
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        self.pairs: dict[int, bool] = {}  # by left << 32 | right
        self.starts: dict[str, tuple[str, bytes, int] | None] = {}
        self.rests: dict[str, tuple[str, bytes, int] | None] = {}

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave left and right side by side: undo merges, latest first, and look across the border. Remembered in pairs."""
        a, b, bound, answer = left, right, 1 << 60, True
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < bound:
                answer = False
                break
            open_a, open_b = self.halves.get(a), self.halves.get(b)
            if open_a is None and open_b is None:
                break
            if open_b is None or (open_a is not None and a > b):
                bound, a = a, open_a[1]
            else:
                bound, b = b + 1, open_b[0]
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[left << 32 | right] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: its longest matches if each can stand beside the next, else by backtracking."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, pairs = piece.decode("latin-1"), self.pairs
        ids = [rank for _, rank in self.matcher.iter_long(text)]
        left = ids[0]
        for right in ids[1:]:
            fits = pairs.get(left << 32 | right)
            if not (self.adjacent(left, right) if fits is None else fits):
                return self._backtrack(text)
            left = right
        return ids

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a piece from the last token of each of its prefixes.

        A prefix's last token is the longest match ending there that can follow the last token of what stands before it; the
        ids are read off backwards.
        """
        lengths, pairs = self.lengths, self.pairs
        last = [-1] * (len(text) + 1)
        for at, rank in self.matcher.iter(text):  # longer matches come first at each end
            if last[at + 1] < 0:
                start = at + 1 - lengths[rank]
                if start:
                    left = last[start]
                    fits = pairs.get(left << 32 | rank)
                    if not (self.adjacent(left, rank) if fits is None else fits):
                        continue
                last[at + 1] = rank
        ids, at = [], len(text)
        while at:
            rank = last[at]
            ids.append(rank)
            at -= lengths[rank]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern by itself."""
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _chunk(self, key: str, memory: dict, chunk: str):
        """Ids as text, decoded bytes and count of a chunk between single spaces; None where white space at an end could join its neighbour's."""
        if not key or key[0].isspace() or key[-1].isspace():
            entry = None
        else:
            ids = self.encode_piece(chunk.encode()) if key.isascii() and key.isalpha() and self.spaced_words else self.encode(chunk)
            entry = (",".join(map(str, ids)), self.decode(ids), len(ids))
        if len(key) <= LONGEST:
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[key] = entry
        return entry

    def round_trip(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, ids as decimal text joined by commas, and the bytes they decode to.

        A single space between other characters always starts a match, so that chunks between such spaces can be
        remembered; a text with other white space at a chunk's end is encoded as a whole.
        """
        if not text:
            return 0, "", b""
        first, *others = text.split(" ")
        rests = self.rests
        entries = [self.starts.get(first) or self._chunk(first, self.starts, first)]
        for key in others:
            entry = rests.get(key)
            if entry is None:
                entry = self._chunk(key, rests, " " + key)
                if entry is None:
                    break
            entries.append(entry)
        if entries[0] is None or len(entries) <= len(others):
            ids = self.encode(text)
            return len(ids), ",".join(map(str, ids)), self.decode(ids)
        return sum([e[2] for e in entries]), ",".join([e[0] for e in entries]), b"".join([e[1] for e in entries])


def encoder(path: str, pattern: str) -> BacktrackingBpe:
    """One encoder for a worker process."""
    return kept(("bpe", path, pattern), lambda: BacktrackingBpe(read_ranks(path), pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every whole text; null and empty texts have no ids. Repeated rows give repeated results."""
    schema = arrow_schema("doc_id bigint, ids array<int>")

    def run(batches):
        bpe = encoder(path, pattern)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.encode(t) for t in part.column(1).to_pylist()], schema.field(1).type)], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of ids and SHA-256 digests of the ids (decimal, comma-joined) and of the bytes they decode to.

    Null and empty texts have no ids and the digests of nothing; texts are encoded whole, whatever their length. Null document ids
    stay null, and repeated rows give repeated results.
    """
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches):
        bpe = encoder(path, pattern)
        for part in slices(batches):
            counts, ids, decoded = [], [], []
            with no_cycles():
                found = [bpe.round_trip(text) for text in part.column(1).to_pylist()]
            for n, joined, raw in found:
                counts.append(n)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, ddl)
