"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text answers how far a text can be followed before it leaves that language's
substrings. Cutting a text greedily into such longest matches gives its phrases; a phrase costs log2 of the labelled text's
length, so that phrases * log2(length) / symbols is an entropy per symbol, and the language with the least wins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridspark.llm.common import arrow_schema, carried, crc_bucket, kept, text_or_empty

#: Bound of the labelled sample: documents of a language, and their characters in all.
SAMPLE_DOCS, SAMPLE_CHARS = 96, 60_000
#: A text beyond its share of the sample gives up to so many passages of at least so many characters.
PASSAGES, SHORTEST = 16, 120
#: Symbols of the segments of a text that are parsed side by side.
SEGMENT = 512
#: Characters parsed at once in a task.
GROUP_CHARS = 4 << 20
#: Bounds of the tables of all languages' common transitions: columns of each, and cells in all.
COLUMNS, TABLE_CELLS = 64, 32 << 20
UNDETERMINED = "und"
PREDICTED = "held_out boolean, lang_pred string, score double"


def shares(lengths: list[int], total: int = SAMPLE_CHARS) -> list[int]:
    """Characters that each text gives: all have the same bound, the highest one at which they come to at most about total."""
    left, bound = total, 0
    for i, n in enumerate(sorted(lengths)):
        bound = left // (len(lengths) - i)
        if n > bound:
            break
        left -= n
    else:
        return lengths
    return [min(n, max(1, bound)) for n in lengths]


def passages(text: Column, length: Column, share: Column) -> Column:
    """A text of up to share characters as it is; else its share in up to PASSAGES pieces, evenly drawn from start to end."""
    pieces = F.greatest(F.lit(1), F.least(F.lit(PASSAGES), F.floor(share / SHORTEST))).cast("int")
    each = F.floor(share / pieces).cast("int")
    start = lambda i: (F.lit(1) + F.floor(i * (length - each) / F.greatest(F.lit(1), pieces - 1))).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(text, start(i), each))
    return F.when(length <= share, text).otherwise(F.array_join(drawn, "\n"))


def labelled_sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> list:
    """A bounded sample of labelled texts: of each language the distinct ones of the smallest text hash, by even passages where they are long.

    Texts are chosen by their hashes alone; only the chosen ones' passages travel, copies of a text once.
    """
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    distinct = rows.where("text <> ''").groupBy("lang", "h").agg(F.max(F.length("text")).alias("n"))
    few = distinct.withColumn("r", F.row_number().over(W.Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= SAMPLE_DOCS).select("lang", "h", "n").collect()
    of_lang: dict[str, list] = {}
    for row in few:
        of_lang.setdefault(row["lang"], []).append(row)
    chosen = [(lang, r["h"], share) for lang, found in of_lang.items() for r, share in zip(found, shares([r["n"] for r in found]), strict=True)]
    if not chosen:
        return []
    bound = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, h bigint, share int"))
    drawn = rows.join(bound, ["lang", "h"]).select("lang", "h", passages(F.col("text"), F.length("text"), F.col("share")).alias("text"))
    return drawn.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect()


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    """Lower-case code points; each run of other characters than letters becomes one 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, 0)
    return codes[(codes != 0) | (np.append(1, codes[:-1]) != 0)] if len(codes) else codes


class SuffixAutomaton:
    """Transitions of the minimal automaton of a sequence's substrings, built online."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for s in symbols:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][s]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(s) == q:
                        self.next[p][s] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


class Transitions:
    """Where one automaton goes by state and symbol, and whether a phrase starts there.

    The commonest symbols (those below columns) have a column in a table with a row for each state, complete with what follows when a phrase
    ends; other symbols' targets are in open addressing, as many entries as there are such transitions, whatever the alphabet's size.
    States are given as the places of their rows in the table, 0 is the root. An entry is twice the next state, and 1 more where a phrase starts
    with the symbol because the one before could not be followed further. A symbol that the language doesn't have is a phrase of its own, after
    which the next one starts.
    """

    def __init__(self, automaton: SuffixAutomaton, alphabet: int, columns: int):
        sizes = np.fromiter(map(len, automaton.next), np.int64, len(automaton.next))
        symbols = np.fromiter((s for state in automaton.next for s in state), np.int64, sizes.sum())
        targets = np.fromiter((to for state in automaton.next for to in state.values()), np.int32, sizes.sum()) * (2 * columns)
        states = np.repeat(np.arange(len(sizes)), sizes)
        self.alphabet = alphabet
        self.begun = np.ones(alphabet, np.int32)
        self.begun[symbols[: sizes[0]]] += targets[: sizes[0]]
        follow, common = states > 0, symbols < columns
        table = np.tile(self.begun[:columns], (len(sizes), 1))
        table[states[follow & common], symbols[follow & common]] = targets[follow & common]
        self.table = table.reshape(-1)
        rare = follow & ~common
        keys, targets = states[rare] * columns * alphabet + symbols[rare], targets[rare]
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.targets = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.targets[at[placed]] = keys[left[placed]], targets[left[placed]]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def looked_up(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Entries of symbols without a column."""
        keys = states * self.alphabet + symbols
        at = self._slot(keys)
        there = self.keys[at]
        entries = self.targets[at]
        other = np.flatnonzero(there != keys)
        entries[other] = self.begun[symbols[other]]
        other = other[there[other] >= 0]
        at = at[other]
        while len(other):  # taken by another key: look on
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[other]
            entries[other[hit]] = self.targets[at[hit]]
            on = ~hit & (there >= 0)
            other, at = other[on], at[on]
        return entries


class CrossParser:
    """Phrase counts of texts against the labelled text of each language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = [np.concatenate([np.append(code_points(t), 0) for t in samples[lang]]) for lang in self.languages]
        self.bits = np.array([math.log2(max(2, len(t))) for t in texts])
        alphabet, counts = np.unique(np.concatenate([np.zeros(1, np.uint32), *texts]), return_counts=True)
        self.symbol_of = np.zeros(0x110000, np.int32)  # 0 is any that no labelled text has
        self.symbol_of[alphabet[np.argsort(-counts, kind="stable")]] = np.arange(1, len(alphabet) + 1)
        automata = [SuffixAutomaton(self.symbol_of[t].tolist()) for t in texts]
        states = sum(len(automaton.next) for automaton in automata)
        self.columns = max(1, min(len(alphabet) + 1, COLUMNS, TABLE_CELLS // max(1, states)))
        self.transitions = [Transitions(automaton, len(alphabet) + 1, self.columns) for automaton in automata]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text's code points (rows) against each language (columns).

        Texts are cut into segments that are parsed side by side, each as if a phrase began with it. A segment's true parse
        begins in the state that the one before ends in; it is followed until a phrase starts where one does in the first
        parse, from where on both agree. Where they never do, the next segment is followed again from the state that this gives.
        """
        cuts = [(i, points[at : at + SEGMENT]) for i, points in enumerate(texts) for at in range(0, len(points), SEGMENT)]
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        if not cuts:
            return found
        sizes = np.array([len(c) for _, c in cuts])
        order = np.argsort(-sizes, kind="stable")  # lanes: the longest segments first
        sizes, owner, place = sizes[order], np.array([i for i, _ in cuts]), np.argsort(order)
        before = np.full(len(cuts), -1)
        before[place[1:]] = np.where(owner[1:] == owner[:-1], place[:-1], -1)
        longest = int(sizes[0])
        grid = np.zeros((longest, len(cuts)), np.int32)
        for lane, k in enumerate(order):
            grid[: sizes[lane], lane] = self.symbol_of[cuts[k][1]]
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), "right")
        rare_at, rare_lanes = np.nonzero(grid >= self.columns)
        rare_symbols = grid[rare_at, rare_lanes]
        grid[rare_at, rare_lanes] = 0
        rare_at = np.searchsorted(rare_at, np.arange(longest + 1))
        rare_rows = {t: slice(*rare_at[t : t + 2]) for t in np.flatnonzero(np.diff(rare_at)).tolist()}
        for k, transitions in enumerate(self.transitions):
            starts, state, cell, entry = np.zeros(grid.shape, np.uint8), *np.zeros((2, len(cuts)), np.int64), np.zeros(len(cuts), np.int32)
            for t, n in enumerate(active):
                np.add(state[:n], grid[t, :n], out=cell[:n])
                transitions.table.take(cell[:n], out=entry[:n], mode="clip")
                if t in rare_rows:
                    lane = rare_lanes[rare_rows[t]]
                    entry[lane] = transitions.looked_up(state[lane], rare_symbols[rare_rows[t]])
                np.bitwise_and(entry[:n], 1, out=starts[t, :n], casting="unsafe")
                np.right_shift(entry[:n], 1, out=state[:n])
            begin = np.zeros(len(cuts), np.int64)  # the state before each segment that its parse assumes
            while True:
                true = np.where(before >= 0, state[before], 0)
                lane = np.flatnonzero(true != begin)
                if not len(lane):
                    break
                begin[lane] = now = true[lane]
                for t in range(longest + 1):
                    over = sizes[lane] <= t
                    if over.any():
                        state[lane[over]] = now[over]
                        lane, now = lane[~over], now[~over]
                    if not len(lane):
                        break
                    entries = transitions.table[now + grid[t, lane]]
                    if t in rare_rows:
                        _, here, of = np.intersect1d(lane, rare_lanes[rare_rows[t]], True, return_indices=True)
                        entries[here] = transitions.looked_up(now[here], rare_symbols[rare_rows[t]][of])
                    now, new = entries.astype(np.int64) >> 1, entries & 1
                    apart = (new & starts[t, lane]) == 0
                    starts[t, lane] = new
                    lane, now = lane[apart], now[apart]
            found[:, k] = np.bincount(owner[order], starts.sum(0), len(texts))
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        points = [code_points(t) for t in texts]
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        entropy = self.phrases(points) * self.bits
        langs, scores = [], []
        for p, h in zip(points, entropy, strict=True):
            if not p.any():
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(np.argmin(h))
            second = np.min(np.delete(h, best), initial=np.inf)
            langs.append(self.languages[best])
            scores.append(float(1 - h[best] / second) if second < np.inf else 1.0)
        return langs, scores


def identify(docs: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """doc_id (with carry: row, a struct of all columns), held_out, lang_pred and score of every whole text.

    learn marks the rows that may be learnt from; of their languages at most SAMPLE_DOCS distinct texts and about SAMPLE_CHARS
    characters each are, and all of these texts with an equal bound, so that neither copies nor one long text fill a sample. Null texts and texts without a letter, and all texts if nothing can be learnt, get `und` and 0. The score is the
    share by which the second best language's entropy exceeds the best's, 1 if there is one language only; ties go to the
    first language by name. Repeated rows give repeated results.
    """
    samples: dict[str, list[str]] = {}
    for row in labelled_sample(docs, learn, id_col, text_col, lang_col):
        samples.setdefault(row["lang"], []).append(row["text"])
    first, first_ddl = carried(docs, id_col, carry)
    names, key = arrow_schema(PREDICTED).names, hash(str(sorted(samples.items())))

    def run(batches):
        parser = kept(("languages", key), lambda: CrossParser(samples))
        for batch in batches:
            sizes = np.cumsum(batch.column(3).to_numpy()) // GROUP_CHARS
            for group in np.unique(sizes):
                at = np.flatnonzero(sizes == group)
                part = batch.slice(int(at[0]), len(at))
                langs, scores = parser.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs), pa.array(scores, pa.float64())], names=[part.schema.names[0], *names])

    text = text_or_empty(F.col(text_col))
    rows = docs.select(first, held_out.alias("held_out"), text.alias("text"), F.length(text).cast("bigint").alias("n"))
    return rows.mapInArrow(run, f"{first_ddl}, {PREDICTED}")


def identify_held_out(docs: DataFrame, folds: int = 4, fold: int = 2, carry: bool = False) -> DataFrame:
    """identify() on documents, learning from all folds of crc32(doc_id) but one."""
    held_out = crc_bucket(F.col("doc_id"), folds) == fold
    return identify(docs, ~held_out, held_out, carry=carry)
