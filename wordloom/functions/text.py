"""Tokenization as column expressions.

Java's own word class counts combining marks as letters and misses some numerals, so words are
spelled out as letters, numbers and the underscore.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"
COMPOUND = r"[\p{L}\p{N}_]+(?:['\-][\p{L}\p{N}_]+)*"
TAG = "<([^>]+)>"

#: Typographic apostrophe and hyphens, and what they are folded into.
FOLD_FROM, FOLD_TO = "’‐‑‒–—", "'-----"

Tokenizer = Callable[[Column], Column]


def lower_digits(text: Column) -> Column:
    """Lower case, with every decimal digit as 0."""
    return F.regexp_replace(F.lower(text), r"\p{Nd}", "0")


def strip_tags(text: Column) -> Column:
    """Text without anything between angle brackets."""
    return F.regexp_replace(text, TAG, "")


def strip_non_alphanum(text: Column) -> Column:
    """Every character that is no part of a word becomes a space."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]", " ")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode composition. Only texts with a character that it can change go to Python; the others stay in the JVM."""
    changeable = F.when(text.rlike(r"[̀-\x{10FFFF}]"), text)
    return F.coalesce(_nfc(changeable), text)


def tokens_v1(text: Column) -> Column:
    """Words of the lower-cased text without tags, digits as 0; a null text gives null."""
    return F.regexp_extract_all(strip_tags(lower_digits(text)), F.lit(WORD), F.lit(0))


def fold(text: Column, compose: bool = True, lower: bool = True, digits: bool = False) -> Column:
    """The text that tokens_v2 cuts into words."""
    text = nfc(text) if compose else text
    text = F.translate(text, FOLD_FROM, FOLD_TO)
    text = F.lower(text) if lower else text
    return F.regexp_replace(text, r"\p{Nd}", "0") if digits else text


def tokens_v2(text: Column, lower: bool = True, normalize_digits: bool = False, compose: bool = True) -> Column:
    """Words, inner apostrophes and hyphens included; `compose=False` is for text that is known to be composed."""
    return F.regexp_extract_all(fold(text, compose, lower, normalize_digits), F.lit(COMPOUND), F.lit(0))


def composed_tokens_v2(text: Column) -> Column:
    """tokens_v2 of text that is known to be composed; stays in the JVM."""
    return tokens_v2(text, compose=False)


TOKENIZERS: dict[str, Tokenizer] = {"v1": tokens_v1, "v2": tokens_v2, "v2-composed": composed_tokens_v2}


def tokenizer(choice: str | Tokenizer) -> Tokenizer:
    """A tokenizer by name, or the given function of a column itself (native or a pandas UDF)."""
    if callable(choice):
        return choice
    if choice not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {choice!r}; there are {sorted(TOKENIZERS)}")
    return TOKENIZERS[choice]


def to_item(tokens: Column) -> Column:
    """The only token of a list, or null if there is none or there are several."""
    return F.when(F.size(tokens) == 1, F.element_at(tokens, 1))


def single_token(text: Column, tokenize: Tokenizer = composed_tokens_v2) -> Column:
    """Whether a text is exactly one token."""
    return F.size(tokenize(text)) == 1


@F.pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else t.casefold())


def folded_key(text: Column, compose: bool = True) -> Column:
    """A key that is equal for texts alike but for case, by full case folding; only texts beyond ASCII go to Python."""
    text = nfc(text) if compose else text
    return F.coalesce(_casefold(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def sentences(text: Column) -> Column:
    """Sentences of a text: parts that end in a full stop, an exclamation or a question mark before white space, or at a line feed."""
    return F.filter(F.transform(F.split(strip_tags(text), r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: s != "")


ENGLISH_STOP = (
    "a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how i if in into is it its just like me "
    "more most my no not of on only or other our out over she so some such than that the their them then there these they this to up very was we were what when which "
    "who will with would you your"
).split()


def sentence_tokens(text: Column, remove_stop: bool = True, stop: list[str] | None = None) -> Column:
    """For each sentence its tokens without stop words; sentences that lose all their tokens stay as empty lists."""
    gone = F.array(*(F.lit(w) for w in (ENGLISH_STOP if stop is None else stop)))
    cut = F.transform(sentences(text), lambda s: F.regexp_extract_all(lower_digits(s), F.lit(WORD), F.lit(0)))
    if not remove_stop:
        return cut
    return F.transform(cut, lambda t: F.filter(t, lambda w: ~F.array_contains(gone, w)))
