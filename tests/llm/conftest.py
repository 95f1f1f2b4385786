import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang): copies, near copies, a shared passage, short, empty, null and very long texts, a repeated row."""
    rng = random.Random(5)
    syllables = {"en": ["the", "on", "ing", "er", "an", "and"], "es": ["ción", "que", "ado", "ña", "el", "os"]}

    def prose(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = [(i, prose("en" if i % 2 else "es", rng.randint(15, 160)), "en" if i % 2 else "es") for i in range(40)]
    base = prose("en", 300).split()
    rows.append((40, " ".join(base), "en"))
    for i in range(41, 46):  # near copies by one changed word
        words = list(base)
        words[i] = f"changed{i}"
        rows.append((i, " ".join(words), "en"))
    rows += [(46, rows[3][1], "en"), (47, rows[3][1], "en")]  # exact copies
    passage = prose("en", 60)
    rows += [(48, prose("en", 80) + " " + passage + " " + prose("en", 70), "en"), (49, passage + "\n" + prose("en", 90), "en")]
    rows += [(50, "", None), (51, None, "en"), (52, "one two", "en"), (53, "  \n\t ", "en"), (54, "!!! 123 ???", "es"), (55, prose("es", 9000), "es")]
    rows += [(56, "día 日本 😀 " * 40, "es"), rows[7]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with the operators' own."""
    rows = [(i, t, lang, "src", len(t or ""), i, "x") for i, t, lang in corpus]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, block bigint, h string").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(i, i % 2, 0) for i, _, _ in corpus] + [(None, 1, 0), (999, None, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
