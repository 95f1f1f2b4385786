"""Quality, language, line rules and language-model scores."""

import math
import re
import time
import zlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import language_id, line_rules, lm_scoring, quality
from gridspark.llm.common import crc_bucket

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_language(docs, no_docs, corpus):
    rows = language_id.identify_held_out(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in corpus)
    texts = {i: (t, lang) for i, t, lang in corpus}
    for r in rows:
        text, lang = texts[r.doc_id]
        assert r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id < 46:
            assert r.lang_pred == lang
    assert language_id.identify_held_out(no_docs).collect() == []
    nothing = language_id.identify(docs, F.lit(False), F.lit(True)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language_id.identify_held_out(docs, carry=True).select("row.*").columns == docs.columns


def test_language_sample_is_of_many_texts(spark):
    """Copies count once, and a very long text leaves room for the others and is drawn from its start to its end."""
    long, copy, few = "".join(f"{chr(97 + i // 9000)} " * 9 for i in range(90_000)), "copied text", [f"other text {i}" for i in range(20)]
    rows = [(i, t, "en") for i, t in enumerate([long, *[copy] * 300, *few])] + [(900, "uno dos", "es"), (901, "", "es")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    found = language_id.labelled_sample(docs, F.lit(True), "doc_id", "text", "lang")
    english = [r.text for r in found if r.lang == "en"]
    assert sorted(t for t in english if len(t) < 100) == sorted([copy, *few]) and [r.text for r in found if r.lang == "es"] == ["uno dos"]
    drawn = max(english, key=len)
    assert set("abcdefghij") <= set(drawn) and language_id.SAMPLE_CHARS // 2 < sum(map(len, english)) <= language_id.SAMPLE_CHARS + 100
    for lengths in ([5, 70_000, 30_000, 9], [90_000] * 200, [10, 20], []):
        got = language_id.shares(lengths, 40_000)
        assert sum(got) <= 40_000 and (got == lengths or sum(got) > 39_000) and all(0 < x <= n for x, n in zip(got, lengths, strict=True))


@pytest.mark.parametrize("first", ["copies", "long"])
def test_language_learnt_beside_copies(spark, corpus, first):
    """A text that comes first by hash and fills the sample by itself, in copies or by its length, doesn't stand for its language."""
    texts = [t for i, t, lang in corpus if lang == "en" and i < 46]
    odd = F.repeat(F.lit("zz qq xx jj "), F.lit(2500 if first == "copies" else 5000))
    ranked = spark.range(3000).select(F.concat(odd, F.col("id").cast("string")).alias("t"), F.xxhash64("t").alias("h")).orderBy("h").first()
    assert ranked.h < spark.createDataFrame([(t,) for t in texts], "t string").agg(F.min(F.xxhash64("t"))).first()[0]
    rows = [(i, t, "en") for i, t in enumerate([ranked.t] * (120 if first == "copies" else 1) + texts)]
    rows += [(1000 + i, t, "es") for i, t, lang in corpus if lang == "es" and i < 46]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language_id.identify(docs, F.lit(True), F.lit(False)).where("doc_id >= 120 and doc_id < 1000" if first == "copies" else "doc_id >= 1 and doc_id < 1000").collect()
    assert len(found) == len(texts) and {r.lang_pred for r in found} == {"en"}


def longest_match_phrases(symbols, source):
    """Phrases by plain search in a string of symbols."""
    text, source, phrases, at = "".join(map(chr, symbols)), "".join(map(chr, source)), 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in source:
            n += 1
        phrases, at = phrases + 1, at + n
    return phrases


def test_phrases_are_longest_matches(monkeypatch):
    rng = random.Random(12)
    samples = {"a": ["banana bandana", "a band"], "b": ["cabbage"], "c": ["".join(rng.choice("abcdn ") for _ in range(400))]}
    parser = language_id.CrossParser(samples)
    sources = [np.concatenate([np.append(language_id.code_points(t), 0) for t in samples[lang]]) for lang in "abc"]
    texts = ["bananadanacab", "x", "zzz!banana", "", "nab" * 300, samples["c"][0][50:390] * 2, "banana bandana" * 40]
    texts += ["".join(rng.choice("abcdnxg ") for _ in range(n)) for n in (63, 64, 65, 500, 700)]
    points = [language_id.code_points(t) for t in texts]
    want = [[longest_match_phrases(p, s) for s in sources] for p in points]
    for segment in (1, 2, 7, 64, 2048):  # borders of segments don't show
        monkeypatch.setattr(language_id, "SEGMENT", segment)
        assert parser.phrases(points).tolist() == want


def test_large_alphabets():
    """Two scripts of 3,000 letters each: transitions take memory by their number, not by the alphabet's size."""
    rng = random.Random(3)
    scripts = {"h": range(0xAC00, 0xAC00 + 3000), "z": range(0x4E00, 0x4E00 + 3000)}
    samples = {lang: ["".join(chr(rng.choice(scripts[lang])) for _ in range(20_000))] for lang in scripts}
    parser = language_id.CrossParser(samples)
    assert sum(t.keys.nbytes + t.targets.nbytes for t in parser.transitions) < 24 << 20
    langs, scores = parser.predict([samples["h"][0][100:150], samples["z"][0][300:350], samples["z"][0][5000:9000], "!?"])
    assert langs == ["h", "z", "z", "und"] and min(scores[:3]) > 0.5


def test_common_letters_have_columns(monkeypatch):
    """Common letters are not probed for; with whatever number of columns, also none but that of unknown letters, phrases are longest matches."""
    rng = random.Random(21)
    samples = {"a": ["".join(rng.choice("abcdn ") for _ in range(500)) + "щю日"], "b": ["日本語 ab cabbage 日本"], "c": ["щю " * 30]}
    sources = [np.concatenate([np.append(language_id.code_points(t), 0) for t in samples[lang]]) for lang in "abc"]
    texts = ["".join(rng.choice("abcdnxщю日本語 ж") for _ in range(n)) for n in (1, 63, 500, 700)] + ["", "日本語 ab cabbage" * 30, "щюж" * 90, "".join(rng.choice("abcdn ") for _ in range(900))]
    points = [language_id.code_points(t) for t in texts]
    want = [[longest_match_phrases(p, s) for s in sources] for p in points]
    looked_up, probed = language_id.Transitions.looked_up, []
    monkeypatch.setattr(language_id.Transitions, "looked_up", lambda self, states, symbols: probed.append(len(symbols)) or looked_up(self, states, symbols))
    shares = []
    for columns, cells in ((64, 32 << 20), (9, 32 << 20), (3, 32 << 20), (1, 32 << 20), (64, 5000), (64, 10)):
        monkeypatch.setattr(language_id, "COLUMNS", columns)
        monkeypatch.setattr(language_id, "TABLE_CELLS", cells)
        parser = language_id.CrossParser(samples)
        probed.clear()
        for segment in (2, 64, 512):
            monkeypatch.setattr(language_id, "SEGMENT", segment)
            assert parser.phrases(points).tolist() == want
        shares.append(sum(probed))
        assert parser.columns == 1 or parser.columns <= columns and sum(t.table.size for t in parser.transitions) <= cells
    assert shares[0] == 0 < shares[1] < shares[2] < shares[3] == shares[5] and 0 < shares[4] < shares[3]


def test_parsing_takes_little_more_than_reading():
    """Four languages' phrases within 15 times the CPU time of folding the same texts' letters (26 to 37 times where every letter is probed for)."""
    rng = random.Random(8)
    words = [["".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(rng.randint(2, 9))) for _ in range(1500)] for _ in range(4)]
    samples = {str(i): [" ".join(rng.choices(w, k=250)) for _ in range(36)] for i, w in enumerate(words)}
    texts = [" ".join(rng.choices(rng.choice(words), k=250)) for _ in range(500)]
    parser, ratios = language_id.CrossParser(samples), []
    for _ in range(4):
        times = [time.process_time()]
        points = [language_id.code_points(t) for t in texts]
        times.append(time.process_time())
        parser.phrases(points)
        times.append(time.process_time())
        ratios.append((times[2] - times[1]) / (times[1] - times[0]))
    assert min(ratios) < 15


def test_quality(docs, no_docs, labels, corpus):
    rows = quality.classify_held_out(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in corpus)
    for r in rows:
        assert r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert len({r.score for r in rows if r.doc_id in (50, 51)}) == 1
    assert quality.classify_held_out(no_docs, labels).collect() == []
    assert {r.score for r in quality.classify_held_out(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_is_the_plain_density_ratio(docs, labels, corpus, spark):
    """Scores against class densities worked out text by text; labels that are none, and a document of both, among them."""
    odd = spark.createDataFrame([(0, 1, 0), (2, 7, 0), (4, -1, 0)], "doc_id bigint, quality int, toxic int")
    mark = {i: i % 2 for i, _, _ in corpus} | {0: 1}
    x, own, weight, learnt = [], [], [], []
    for i, text, _ in corpus:
        n = len((text or "").split())
        x.append(quality.statistics(text or ""))
        own.append(i)
        weight.append(n / (n + quality.SHORT_WORDS))
        learnt.append(crc(i, 5) != 0)
    x, weight, learnt, marks = np.array(x), np.array(weight), np.array(learnt), np.array([mark[i] for i in own])
    average = (x[learnt] * weight[learnt, None]).sum(0) / weight[learnt].sum()
    drawn = average + (x - average) * weight[:, None]
    spread = np.sqrt(np.maximum(drawn[learnt].var(0), 1e-9))
    logs = []
    for k in (0, 1):
        part = drawn[learnt & (marks == k)]
        z = (part - part.mean(0)) / spread
        cov = z.T @ z / len(z)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        d = (drawn - part.mean(0)) / spread
        logs.append(np.log(len(part) / learnt.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    got = {}
    for r in quality.classify_held_out(docs, labels.unionByName(odd)).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    for i, w in zip(own, want, strict=True):
        assert all(abs(g - w) < 1e-6 for g in got[i])


def test_quality_discriminates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (400, quality.N_STATISTICS)), rng.normal(0, 3, (300, quality.N_STATISTICS))
    moments = {k: (len(x), x.sum(0), x.T @ x) for k, x in ((1, good), (0, bad))}
    model = quality.QuadraticDiscriminant(moments)
    assert (model.score(good) > 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95


def test_line_rules(docs, no_docs, labels, corpus):
    rows = line_rules.judge_lines(docs, labels).collect()
    want = Counter()
    for i, text, _ in corpus:
        words = WORDS.findall((text or "").encode())
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        held = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x.encode())]
        failed = len(words) < 10 or 100 * len(held) > 20 * len(words)
        want[i, len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert line_rules.judge_lines(no_docs, labels).collect() == []
    unlabelled = line_rules.judge_lines(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in unlabelled)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for n in (1, 2, 6):
        emission, step = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y: sum(emission[i, y[i]] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1))
        every = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        assert math.isclose(value(line_rules.viterbi(emission, step)), max(map(value, every)))


def test_labelled_lines_are_of_whole_distinct_texts(spark, monkeypatch):
    """Copies give one chain, a long document all of its lines, and one beyond the sample's characters none."""
    long = "\n".join(["a line of words"] * 100 + ["#"] * 100)
    rows = [*((i, "copy") for i in range(50)), (50, long), (51, "other\ntext"), (52, "x" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i != 50), 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(line_rules, "SAMPLE_CHARS", 4000)
    chains = line_rules.labelled_chains(docs, labels, "doc_id", "text")
    assert sorted(len(x) for x, _ in chains) == [1, 2, 200]
    assert (max((x for x, _ in chains), key=len)[:, 5] == 1).sum() == 100


def test_upper_case_of_whole_lines():
    """Capitals off a stride, behind 4,096 characters, and outside of ASCII count like all others."""
    lines = ["aBaaBaaBa", "x" * 4096 + "Y" * 4096, "ÄÖü Ⅷ 日本 ß😀", "", "A" * 5000, "plain"]
    want = [sum(c.isupper() for c in line) / max(1, len(line)) for line in lines]
    assert line_rules.line_features(lines)[:, 4].tolist() == want
    assert [line_rules.upper_case(line, 7) for line in lines] == [sum(c.isupper() for c in line) for line in lines]


def test_fitted_field_separates():
    good = line_rules.line_features(["The quick brown fox jumps over a lazy dog.", "It runs away from all of them."])
    bad = line_rules.line_features(["BUY!! NOW!! ###", "$$$ *** &&&"])
    weights, step = line_rules.fit([(good, 1), (bad, 0)] * 20)
    assert line_rules.viterbi(good @ weights, step).all() and not line_rules.viterbi(bad @ weights, step).any()


def test_lines_of_mixed_documents_are_told_apart(spark):
    """Bad documents mix prose and junk; no line is labelled, and yet the share of content is that of the prose."""
    rng = random.Random(9)
    prose = lambda: " ".join(rng.choice(["the", "house", "stands", "near", "old", "river", "and", "sleeps"]) for _ in range(rng.randint(8, 14))) + "."
    junk = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "###", "CLICK!!"]) for _ in range(rng.randint(8, 14)))
    rows, labels = [], []
    for i in range(240):
        n = rng.randint(2, 12)
        lines = [prose() for _ in range(n)]
        if i % 3 == 0:
            at = rng.randint(0, n - 1)
            lines[at:at] = [junk() for _ in range(n * (1 + i % 2) // 2)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(i % 3 > 0), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in line_rules.judge_lines(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    off, mixed = [], 0
    for i, text in rows:
        lines = text.split("\n")
        want = sum(len(x) for x in lines if x.endswith(".")) / sum(map(len, lines))
        off.append(abs(found[i].content_share - want))
        mixed += 0 < found[i].content_share < 1
    assert sum(off) / len(off) < 0.08 and mixed > 60


def test_steps_are_learnt():
    """Content stays content: a doubtful line takes its neighbours' label."""
    good = line_rules.line_features(["The quick brown fox jumps over a lazy dog."] * 6)
    bad = line_rules.line_features(["BUY!! NOW!! ###", "$$$ *** &&&"] * 3)
    weights, step = line_rules.fit([(good, 1), (np.concatenate([good, bad]), 0), (bad, 0)] * 10)
    assert step[0, 0] > step[0, 1] and step[1, 1] > step[1, 0]

def ppm(texts, train, order):
    """log10 probabilities by plain dictionaries."""
    counts = defaultdict(Counter)
    symbols = lambda t: [256] * order + list(t) + [256]
    for t in train:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    out = []
    for t in texts:
        s, total = symbols(t), 0.0
        for i in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                seen = {x: n for x, n in counts.get(tuple(s[i - k : i]), {}).items() if x not in gone}
                n = sum(seen.values())
                if n and s[i] in seen:
                    total += math.log10((2 * seen[s[i]] - 1) / (2 * n))
                    break
                if n:
                    total += math.log10(len(seen) / (2 * n))
                gone |= set(seen)
            else:
                total -= math.log10(257 - len(gone))
        out.append(total)
    return out


@pytest.mark.parametrize("order", [2, 3, 5])
def test_language_model(docs, no_docs, corpus, order):
    held = crc_bucket(F.col("doc_id"), 7) == 2
    rows = lm_scoring.score(docs, held, order, block_bytes=4096).collect()
    texts = [(t or "").encode().lower() for _, t, _ in corpus]
    train = [t for (i, _, _), t in zip(corpus, texts, strict=True) if crc(i, 7) != 2]
    known = Counter(w for t in train for w in WORDS.findall(t))
    total, distinct, ends = sum(known.values()) + len(train), len(known) + 1, len(train)
    want = defaultdict(list)
    for (i, _, _), t, score in zip(corpus, texts, ppm(texts, train, order), strict=True):
        words = WORDS.findall(t)
        base = sum(math.log10(known[w] + 1) for w in words) + math.log10(ends + 1) - (len(words) + 1) * math.log10(total + distinct + 1)
        want[i].append((crc(i, 7) == 2, len(words) + 1, sum(w in known for w in words) + 1, total, base, score))
    assert Counter(r.doc_id for r in rows) == Counter({i: len(x) for i, x in want.items()})
    for r in rows:
        assert tuple(r)[1:5] == want[r.doc_id][0][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][0][4], rel=1e-9)
        assert r.score == pytest.approx(want[r.doc_id][0][5], rel=1e-5)
    assert lm_scoring.score_held_out(no_docs).collect() == []
    nothing = lm_scoring.score(docs.where("doc_id = 52"), F.lit(True)).first()
    assert nothing.base_score == 0 and nothing.score == pytest.approx(-8 * math.log10(257))


def test_long_text_in_chunks(monkeypatch):
    texts = [b"abc" * 50, b"x" * 700, b"", b"hello world"]
    whole = np.concatenate([g for _, _, g in lm_scoring.symbol_runs(texts, 3)])
    monkeypatch.setattr(lm_scoring, "CHUNK", 64)
    parts = list(lm_scoring.symbol_runs(texts, 3))
    assert np.array_equal(whole, np.concatenate([g for _, _, g in parts]))
    sizes = Counter()
    for first, held, _ in parts:
        for i, n in enumerate(held):
            sizes[first + i] += n
    assert [sizes[i] for i in range(4)] == [len(t) + 1 for t in texts]


def test_a_long_text_goes_through_whole(spark):
    """2.5 MB in one row, with short ones beside it in the same batch: nothing is cut off at either end."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    text = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(35_000)) + "\nLAST"
    rows = [(1, text, "en"), (2, "a short one, and no more than that: ten words here", "en"), (3, text[-5000:], "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    judged = {r.doc_id: r for r in line_rules.judge_lines(docs, labels).collect()}
    assert judged[1].n_words == len(text.split()) and judged[1].word_chars == len(text) - text.count(" ") - text.count("\n")
    assert {r.lang_pred for r in language_id.identify(docs, F.lit(True), F.lit(False)).collect()} == {"en"}
    scored = {r.doc_id: r for r in lm_scoring.score(docs, F.col("doc_id") == 2).collect()}
    assert scored[1].n_tokens == len(text.split()) + 1 and scored[1].score < scored[3].score < 0
