"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of blocks: texts between borders of block elements. A block is described by the tags and names of its
ancestors and by its text; the field scores content or not from that and from the step between neighbours. It is trained on
labelled pages by the chains' exact likelihood (forward-backward), and Viterbi decoding gives the labels of a whole page.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm import labelled_pages
from gridspark.llm.common import arrow_schema, slices, text_or_empty
from gridspark.llm.line_rules import viterbi

#: Pages to train on where none are given; least pages that a feature occurs on; weight of the penalty; rounds of the fit.
TRAINING_PAGES, LEAST_PAGES, PENALTY, ROUNDS = 800, 5, 0.2, 150
EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"

#: Fixed values of HTML: elements without an end, whose text isn't shown, that part text, and that end open ones of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript svg math iframe object audio video canvas datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html ins label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("br button html body ins label option optgroup select td th tr tbody thead tfoot caption".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that bound which open element a sibling ends, and those whose innermost one says where a block is.
SCOPES = frozenset("ul ol menu dl select table".split())
ROLES = frozenset("article main nav header footer aside form section body dialog".split())


class Blocks(HTMLParser):
    """The blocks of a page: (text, features, mark). Open elements are a stack; what they say of a block is counted as they open and close."""

    def __init__(self, known: dict[str, int] | None = None):
        super().__init__(convert_charrefs=True)
        self.known, self.blocks = known, []
        self.stack: list[tuple] = []  # tag, features, mark
        self.open, self.active, self.roles, self.marks = Counter(), Counter(), ["none"], [None]
        self.texts: list[str] = []
        self.linked = 0

    def end_block(self) -> None:
        text = " ".join("".join(self.texts).split())
        if text:
            found = [*self.active, f"in:{self.roles[-1]}", f"own:{next((t for t, _, _ in reversed(self.stack) if t in BLOCKS), 'none')}", *described(text, self.linked)]
            self.blocks.append((text, found, self.marks[-1]))
        self.texts, self.linked = [], 0

    def push(self, tag: str, attrs: list) -> None:
        found, mark = {f"up:{tag}"}, None
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                found.update(f"name:{w}" for w in re.findall("[a-z]+", value.lower()))
            elif name == labelled_pages.MARK:
                mark = value
        found = tuple(f for f in found if self.known is None or f in self.known)
        self.stack.append((tag, found, mark))
        self.open[tag] += 1
        self.active.update(found)
        if tag in ROLES:
            self.roles.append(tag)
        if mark is not None:
            self.marks.append(mark)

    def pop(self) -> str:
        tag, found, mark = self.stack.pop()
        self.open[tag] -= 1
        for f in found:
            self.active[f] -= 1
            if not self.active[f]:
                del self.active[f]
        if tag in ROLES:
            self.roles.pop()
        if mark is not None:
            self.marks.pop()
        return tag

    def close_sibling(self, tags: tuple) -> None:
        """Ends the nearest open element of these tags, unless a list or table of its own lies between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] in SCOPES:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_block()
        if tag in ENDS_PARAGRAPH and self.open["p"]:
            self.handle_endtag("p")
        if tag in SIBLINGS and any(self.open[t] for t in SIBLINGS[tag]):
            self.close_sibling(SIBLINGS[tag])
        if tag == "body" and self.open["head"]:
            self.handle_endtag("head")
        if tag not in VOID:
            self.push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_block()
        if self.open[tag]:
            while self.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if any(self.open[t] for t in UNSEEN):
            return
        self.texts.append(data)
        if self.open["a"]:
            self.linked += len(data)


def described(text: str, linked: int) -> list[str]:
    """What a block's own text says: its length, links, end, capitals, digits and marks, each as one of few names."""
    words = text.split(" ")
    n, size = len(words), len(text)
    share = lambda x: "none" if x <= 0 else "few" if x < 0.3 else "many" if x < 0.8 else "all"
    return [
        "always", f"words:{min(n, 12) if n < 6 else 6 if n < 10 else 10 if n < 20 else 20 if n < 40 else 40}", f"links:{share(linked / size)}", f"end:{'stop' if text[-1] in '.?!:;' else 'other'}",
        f"capitals:{share(sum(w[:1].isupper() for w in words) / n)}", f"digits:{share(sum(map(str.isdigit, text[:4096])) / min(size, 4096))}",
        *(f"mark:{c}" for c in "©·»" if c in text),
    ]


def blocks_of(html: str, known: dict[str, int] | None = None) -> list[tuple]:
    page = Blocks(known)
    page.feed(html)
    if re.match("<[a-zA-Z/!?]", page.rawdata):  # a tag that the page's end cuts off
        page.rawdata = ""
    page.close()
    page.end_block()
    return page.blocks


def likelihood(weights: np.ndarray, step: np.ndarray, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of chains' labels (0 or 1) and its gradients by weights (features x labels) and step (labels x labels).

    x holds the blocks' features (blocks x features) of all chains, which begin at starts, longest first.
    """
    sizes = np.diff(np.append(starts, len(x)))
    emission = (x @ weights.astype(x.dtype)).astype(np.float64)
    ahead, behind = emission.copy(), np.zeros_like(emission)
    for t in range(1, sizes[0]):  # all chains longer than t at once
        at = starts[: np.searchsorted(-sizes, -t)] + t
        ahead[at] += np.logaddexp(ahead[at - 1, :1] + step[0], ahead[at - 1, 1:] + step[1])
    for t in range(sizes[0] - 1, 0, -1):
        at = starts[: np.searchsorted(-sizes, -t)] + t
        later = emission[at] + behind[at]
        behind[at - 1] = np.logaddexp(later[:, :1] + step[:, 0], later[:, 1:] + step[:, 1])
    total = np.repeat(np.logaddexp(*ahead[starts + sizes - 1].T), sizes)
    inside = np.ones(len(x), bool)
    inside[starts] = False
    at = np.flatnonzero(inside)
    pairs = np.exp(ahead[at - 1, :, None] + step + (emission[at] + behind[at])[:, None, :] - total[at, None, None])
    seen = np.bincount(2 * labels[at - 1] + labels[at], minlength=4).reshape(2, 2)
    value = emission[np.arange(len(x)), labels].sum() + (seen * step).sum() - total[starts].sum()
    return value, x.T @ (np.eye(2)[labels] - np.exp(ahead + behind - total[:, None])).astype(x.dtype), seen - pairs.sum(axis=0)


def ascend(x: np.ndarray, starts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and step of greatest penalised likelihood, by steps of adapted length."""
    n = x.shape[1]
    at, mean, spread = np.zeros(2 * n + 4), np.zeros(2 * n + 4), np.zeros(2 * n + 4)
    for i in range(1, rounds + 1):
        _, by_weights, by_step = likelihood(at[: 2 * n].reshape(n, 2), at[2 * n :].reshape(2, 2), x, starts, labels)
        slope = np.concatenate([by_weights.reshape(-1), by_step.reshape(-1)]) - PENALTY * at
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        at = at + 0.1 * (mean / (1 - 0.9**i)) / (np.sqrt(spread / (1 - 0.99**i)) + 1e-8)
    return at[: 2 * n].reshape(n, 2), at[2 * n :].reshape(2, 2)


def train(pages: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Features' numbers, weights and step learnt from labelled pages; blocks outside of all marks aren't main text."""
    chains = sorted((c for c in map(blocks_of, pages) if c), key=len, reverse=True)
    on = Counter(f for chain in chains for f in {f for _, found, _ in chain for f in found})
    known = {f: i for i, f in enumerate(sorted(f for f, n in on.items() if n >= min(LEAST_PAGES, len(chains)) and f != f"up:{labelled_pages.MARK}"))}
    blocks = [b for chain in chains for b in chain]
    if not blocks:
        return known, np.zeros((len(known), 2)), np.zeros((2, 2))
    x = np.zeros((len(blocks), len(known)), np.float32)
    for row, (_, found, _) in zip(x, blocks, strict=True):
        row[[known[f] for f in found if f in known]] = 1
    starts = np.cumsum([0, *map(len, chains)])[:-1]
    return known, *ascend(x, starts, np.array([int(mark == "1") for _, _, mark in blocks]))


@functools.cache
def default_model() -> tuple:
    """The field trained on pages of the grammar; the same in every session."""
    return train(labelled_pages.pages(TRAINING_PAGES))


def main_text(html: str, model: tuple) -> str:
    """The blocks that the field calls content, in page order, joined by one space."""
    known, weights, step = model
    blocks = blocks_of(html, known)
    if not blocks:
        return ""
    emission = np.array([weights[[known[f] for f in found if f in known]].sum(axis=0) for _, found, _ in blocks])
    return " ".join(text for (text, _, _), label in zip(blocks, viterbi(emission, step), strict=True) if label)


def extract_main_text(pages: DataFrame, labelled: list[str] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points), one row per row of pages, from the whole html.

    Learns from labelled (pages marked as in labelled_pages.MARK, a bounded list), else from TRAINING_PAGES pages of its
    grammar. Character references are decoded and white space in a block becomes one space. Null and empty pages, and pages
    without main text, give an empty text; markup that doesn't close or nest ends as browsers end it.
    """
    model = train(labelled) if labelled is not None else default_model()
    schema = arrow_schema(EXTRACTED)

    def run(batches):
        for part in slices(batches):
            texts = [main_text(html, model) for html in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(F.col(html_col)).alias("html")).mapInArrow(run, EXTRACTED)
