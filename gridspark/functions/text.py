"""Text functions of search and comparison."""

from __future__ import annotations

import difflib
import functools
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Word characters of any script.
WORD = r"[\p{L}\p{N}_]+"
#: Words that ranking leaves out. Fixed values.
STOP_WORDS = (
    "a an and are as at be by for from in is of on or the to what which with "
    "bảng các cho của là nào những trong và với"
).split()
#: Words that are no term of a question. Fixed values.
QUERY_STOP_WORDS = (
    "a an and are as by for from in is of on or sheet table the to what which with "
    "bảng bao các câu cho của gì hãy hỏi không là nào nêu những nhiêu trong và với"
).split()


@functools.cache
def _bare_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition without marks is another character or nothing, and those where it is several; syllables of Hangul are left to a rule."""
    one, several = {"Đ": "D", "đ": "d"}, {}
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000))):
        if unicodedata.decomposition(c) or unicodedata.combining(c):
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            (one if len(bare) < 2 else several)[c] = bare
    return one, several


def words(text: Column) -> Column:
    """Lower-case words in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def distinct_words(text: Column) -> Column:
    return F.array_distinct(words(text))


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct words that both have."""
    return F.size(F.array_intersect(distinct_words(F.coalesce(a, F.lit(""))), distinct_words(F.coalesce(b, F.lit("")))))


def rank_tokens(text: Column) -> Column:
    """Words for ranking: without stop words and single letters, repeats kept."""
    return F.filter(words(text), lambda t: ~t.isin(STOP_WORDS) & ((F.length(t) >= 2) | t.rlike(r"^\p{Nd}+$")))


def query_terms(question: Column) -> Column:
    """Distinct terms of a question in order: letters, digits and `#./+-`, full stops at the ends off, stop words and single letters left out."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[0-9A-Za-zÀ-ỹ가-힣#./+-]+"), F.lit(0))
    bare = F.transform(raw, lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: (t != "") & ~t.isin(QUERY_STOP_WORDS) & ((F.length(t) >= 2) | t.rlike(r"^\p{Nd}$"))))


def unaccented(text: Column) -> Column:
    """Text in compatibility decomposition without marks: letters of any script bare, full-width and circled ones plain, ligatures and syllables in letters.

    One table of single characters does for most texts; only those with others go character by character.
    """
    one, several = _bare_forms()
    plain = sorted(one, key=lambda c: one[c] == "")  # what is left out stands last
    code = lambda c: F.ascii(c) - 0xAC00
    letter = lambda first, number: F.element_at(F.array(*(F.lit(chr(first + i)) for i in range(28))), (number + 1).cast("int"))
    syllable = lambda c: F.concat(letter(0x1100, F.floor(code(c) / 588)), letter(0x1161, F.floor(code(c) % 588 / 28)), F.when(code(c) % 28 == 0, "").otherwise(letter(0x11A7, code(c) % 28)))
    known = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    spelled = lambda c: F.when(c.between("\uac00", "\ud7a3"), syllable(c)).otherwise(F.coalesce(F.try_element_at(known, c), c))
    rare = f"[\uac00-\ud7a3{''.join(several)}]"
    simple = F.translate(text, "".join(plain), "".join(one[c] for c in plain))
    return F.when(simple.rlike(rare), F.array_join(F.transform(F.regexp_extract_all(simple, F.lit("(?s)."), F.lit(0)), spelled), "")).otherwise(simple)


def normal(text: Column, case_sensitive: bool = False, ignore_accents: bool = False) -> Column:
    """Text for comparison: folded unless told otherwise, white space kept; null becomes empty."""
    value = F.coalesce(text, F.lit(""))
    value = unaccented(value) if ignore_accents else value
    return value if case_sensitive else F.lower(value)


def alias(text: Column) -> Column:
    """Name for matching: unaccented, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(unaccented(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]", "")


def sheet_alias(name: Column) -> Column:
    """alias() of a sheet's name in which a word of `f` and digits stands for the digits, as floors are written."""
    tidy = F.regexp_replace(F.lower(unaccented(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{N}_]+", " ")
    return F.regexp_replace(F.regexp_replace(tidy, r"(?<![\p{L}\p{N}_])f(?=\p{Nd}+(?![\p{L}\p{N}_]))", ""), r"[^\p{L}\p{N}]", "")


def workbook_tokens(name: Column) -> Column:
    """Words of a workbook's name or a question, dotted ones whole, without file extensions."""
    found = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin("xlsx", "xls", "xlsm", "csv"))


def strong_token(token: Column) -> Column:
    """Whether a token says something by itself: three characters, a dot or a letter beyond ASCII."""
    return (F.length(token) >= 3) | F.contains(token, F.lit(".")) | token.rlike(r"[^\x00-\x7F]")


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters, from 0 to 1 (Ratcliff and Obershelp); 0 where one is null."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)])


def _line_feeds(text: Column) -> Column:
    """Written-out `\\n` as line feeds."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\\n"), F.lit("\n"))


def squeezed(text: Column) -> Column:
    """Text without white space in lower case; a written-out `\\n` is white space."""
    return F.regexp_replace(F.lower(_line_feeds(text)), r"\s+", "")


def tidy(text: Column) -> Column:
    """Text with white space, written-out line feeds included, collapsed."""
    return F.trim(F.regexp_replace(_line_feeds(text), r"\s+", " "))


def clipped(text: Column, limit: int, tail: bool = False) -> Column:
    """Text cut to limit characters around a marker, its head and tail kept, or its tail alone; a limit too small for the marker keeps the head."""
    marker = "\n...[truncated]...\n"
    keep = limit - len(marker)
    if keep <= 20:
        cut = F.concat(F.substring(text, 1, limit), F.lit("..."))
    elif tail:
        cut = F.concat(F.lit(marker), F.right(text, F.lit(keep)))
    else:
        cut = F.concat(F.substring(text, 1, keep // 2), F.lit(marker), F.right(text, F.lit(keep - keep // 2)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def truncated(text: Column, limit: int) -> Column:
    """Text cut to limit characters with a marker after them."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("\n...TRUNCATED...")))


def compact(text: Column, limit: int) -> Column:
    """White space collapsed, cut to limit characters with an ellipsis."""
    value = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.rtrim(F.substring(value, 1, limit - 3)), F.lit("...")))


def safe_name(text: Column) -> Column:
    """Name with runs of characters unfit for a file replaced by an underscore."""
    return F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}_.-]+", "_")


def markdown(text: Column) -> Column:
    """Text of a Markdown table cell."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\|", r"\\|"), r"\r?\n", "<br>")


def phrase_in(phrase: Column, text: Column) -> Column:
    """Whether a phrase occurs in a text at word borders."""
    padded = lambda x: F.concat(F.lit(" "), F.array_join(words(x), " "), F.lit(" "))
    return (F.size(words(phrase)) > 0) & F.contains(padded(text), padded(phrase))
