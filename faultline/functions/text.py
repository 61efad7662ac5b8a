"""Text functions T1-T4, T6 as column expressions (no Python per row).

Sentence and word splitting are our own definitions (the original relies on a tokenizer model):

* T1 a sentence ends at ``.``, ``!`` or ``?`` followed by whitespace;
* T2 words are whitespace-separated; punctuation is trimmed from both ends and only tokens made
  of letters alone are kept (``main.yml`` and ``Debian/Ubuntu`` are dropped whole);
* T3 the kept tokens are joined with one blank.

Every pattern is accepted by both Java regex and RE2 so the SQL oracle can mirror it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f]+"
SENTENCE_END = r"([.!?])[ \t\n\r\f]+"
SEP = "\u0001"


def sentences(msg: Column) -> Column:
    """``ARRAY<STRING>`` of raw sentences."""
    return F.split(F.regexp_replace(F.coalesce(msg, F.lit("")), SENTENCE_END, "$1" + SEP), SEP)


# A whitespace-delimited token whose letters-only core is wrapped in punctuation (no digits): the
# same tokens as "split on whitespace, trim punctuation at both ends, keep letters-only", found in
# one regex pass per sentence instead of one replace per token.
TOKEN = r"(?:^|[ \t\n\r\f])[^\p{L}\p{N} \t\n\r\f]*(\p{L}+)[^\p{L}\p{N} \t\n\r\f]*(?=[ \t\n\r\f]|$)"


# Marks that end a word wherever they stand, commas and colons before anything but a digit, and
# clitics ("don't" keeps "do", "user's" keeps "user").
BREAKS = r"--+|\.\.\.|[()\[\]{}<>;@#$%&?!\"]"
COMMA = r"[:,]([^0-9])"
CLITIC = r"(?i)n't\b|'(?:s|m|d|ll|re|ve)\b"


def tokens(sentence: Column) -> Column:
    """Alphabetic tokens of one sentence, in order."""
    split = F.regexp_replace(F.regexp_replace(sentence, BREAKS, " "), COMMA, " $1")
    return F.regexp_extract_all(F.regexp_replace(split, CLITIC, " "), F.lit(TOKEN), 1)


def sentence_texts(msg: Column) -> Column:
    """T1+T2+T3: one string per sentence, tokens joined by a blank."""
    return F.transform(sentences(msg), lambda s: F.array_join(tokens(s), " "))


def collapse_ws(text: Column) -> Column:
    """T4: every whitespace run becomes one blank."""
    return F.regexp_replace(text, WS, " ")


def is_comment_line(text: Column) -> Column:
    """The line starts with ``#`` once leading whitespace is stripped."""
    return F.coalesce(text.rlike(r"^[ \t\r\f]*#"), F.lit(False))


def words(text: Column) -> Column:
    """Whitespace tokens with empties removed (product metrics M4/M5)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def sentence_token_lists(msg: Column) -> Column:
    """``ARRAY<ARRAY<STRING>>`` -- the alphabetic tokens of each sentence."""
    return F.transform(sentences(msg), tokens)
