"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Its tokens' UTF-8 byte spans, the running sum of their byte lengths, are interval-joined to
the sections' spans. Sections of a text are its lines, each with the line feed that ends it, so that they cover every byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.bpe import read_ranks
from gridspark.llm.common import arrow_schema, kept, slices, text_or_empty

RULES = ("largest", "start", "end")
COUNTS = "doc_id bigint, section int, start bigint, length bigint, n_tokens bigint, n_crossing bigint"

def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """A worker's encoding and the byte length of each of its tokens."""

    def build():
        ranks = read_ranks(path)
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths

    return kept(("sections", path, pattern), build)


def line_starts(raw: bytes) -> np.ndarray:
    """First byte of each line; a text has one line more than line feeds, but for an empty line at its end."""
    starts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    starts = np.concatenate([[0], starts])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(raw) else starts


def attribute(token_ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and how many of them cross a border of it.

    A token within one section is that section's. One that crosses borders goes whole to the section of its first byte
    ("start"), of its last byte ("end"), or to the one that holds most of its bytes, the earlier of equals ("largest").
    """
    token_starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(starts, token_starts, "right") - 1
    last = np.searchsorted(starts, token_ends - 1, "right") - 1
    owner = last.copy() if rule == "end" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "largest":
        ends = np.append(starts[1:], size)
        for t in crossing:
            sections = np.arange(first[t], last[t] + 1)
            owner[t] = sections[np.argmax(np.minimum(ends[sections], token_ends[t]) - np.maximum(starts[sections], token_starts[t]))]
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts))


def section_token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of every whole text: doc_id, section (from 0), start and length in bytes, n_tokens, n_crossing.

    n_crossing counts those of n_tokens that also hold bytes of another section. Null and empty texts give one section of
    length 0 without tokens. The counts of a document sum to its token count. Repeated rows give repeated results.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = arrow_schema(COUNTS)

    def run(batches):
        bpe, lengths = encoding(path, pattern)
        for part in slices(batches):
            columns = [[] for _ in range(5)]
            for text in part.column(1).to_pylist():
                raw = text.encode()
                starts = line_starts(raw)
                ends = np.cumsum(lengths[np.array(bpe.encode_ordinary(text), np.int64)])
                counts, crossing = attribute(ends, starts, len(raw), rule)
                for column, x in zip(columns, (np.arange(len(starts)), starts, np.diff(starts, append=len(raw)), counts, crossing), strict=True):
                    column.append(x)
            ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in columns[0]])))
            arrays = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in columns]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, f.type) for x, f in zip(arrays, list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, COUNTS)
