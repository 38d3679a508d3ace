"""Quality rules that clean a text line by line before judging it as a whole.

Every line with a word is held against rules on punctuation, navigation and boilerplate.  Phrases,
tags and menu marks count against the length of the line: one in every HIT_WORDS words fails it, so a
short line goes for one of them while a long paragraph that mentions one stays.  Lines that fail are removed, and a document that loses too much of its text is rejected.  Apart from
that a text fails the base rules if it has fewer than LEAST_WORDS words or if more than
MOST_REPEATED of its words stand in 3-word windows found twice or more.

Defined results: a null text counts as empty, has no words and fails; rows that repeat an id
are judged one by one; ``clean`` passes all other columns through, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import words

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words
MOST_LOST = 30  # percent of the characters in lines with a word
WINDOW = 3
HIT_WORDS = 25  # words of a line for each phrase, tag or mark it may hold

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = " \t\n\x0b\x0c\r"

# fixed values: phrases of page furniture, and marks that separate menu entries
BOILERPLATE = re.compile(
    r"all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|use of cookies|accept cookies|"
    r"enable javascript|requires javascript|click here|subscribe to our|sign up for|follow us on|share this|"
    r"log ?in to|lorem ipsum|skip to (?:main )?content|back to top|powered by|copyright (?:\(c\)|©|[12]\d{3})",
    re.IGNORECASE,
)
NAVIGATION = re.compile(r"\s(?:\||»|›|·|•|>|/)\s")
_SENTENCE_ENDS = tuple(".!?:;…。！？\"'”’)]")
_MARKUP = re.compile(r"[{}]|</?[a-z][^<>]*>|&[a-z]+;")
_WORDISH = re.compile(r"[^\W\d_]")


def line_fails(line: str) -> bool:
    """Whether a line with a word is page furniture or noise rather than text."""
    body = line.strip(_BLANK)
    room = (body.count(" ") + 1) // HIT_WORDS
    if sum(1 for rule in (BOILERPLATE, _MARKUP) for _ in rule.finditer(body)) > room:
        return True
    if len(NAVIGATION.findall(body)) > 1 + room:
        return True
    letters = len(_WORDISH.findall(body))
    if 2 * letters < len(body):  # figures, rules and marks
        return True
    marks = sum(body.count(c) for c in "#*$%&|<>~^=_")
    if 20 * marks > len(body):
        return True
    # an unended line is a heading or a menu entry: short ones go
    return not body.endswith(_SENTENCE_ENDS) and body.count(" ") < 3


def _repeated_words(hashes: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Per text, how many words lie in a WINDOW-word run that the text has at least twice."""
    if len(hashes) < WINDOW:
        return np.zeros(rows, dtype=np.int64)
    runs = np.zeros(len(hashes) - WINDOW + 1, dtype=np.uint64)
    for j in range(WINDOW):
        runs = words.mix(runs * np.uint64(0x9E3779B97F4A7C15) + hashes[j: j + len(runs)])
    own = owner[: len(runs)]
    whole = np.flatnonzero(own == owner[WINDOW - 1:])
    order = whole[np.lexsort((runs[whole], own[whole]))]
    same = (runs[order][1:] == runs[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(hashes), dtype=bool)
    for j in range(WINDOW):
        covered[order[twice] + j] = True
    return np.bincount(owner[covered], minlength=rows)


def _line_figures(text: str) -> tuple[int, str, int, int]:
    """Repeated lines, the text without failing lines, and the characters in lines with a word, all and kept."""
    seen, repeated, kept, total, left = set(), 0, [], 0, 0
    for line in text.split("\n"):
        if not line.strip(_BLANK):
            kept.append(line)
            continue
        repeated += line in seen
        seen.add(line)
        total += len(line)
        if not line_fails(line):
            kept.append(line)
            left += len(line)
    return repeated, "\n".join(kept), total, left


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch, "text"):
            raw, offsets = words.buffer(part.column("text"))
            starts, ends, owner = words.word_bounds(raw, offsets, words.PLAIN)
            rows = part.num_rows
            n_words = np.bincount(owner, minlength=rows)
            leading = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            chars = np.bincount(owner, weights=leading[ends] - leading[starts], minlength=rows).astype(np.int64)
            symbols = np.r_[0, np.cumsum(_SYMBOLS[raw])]
            repeated = _repeated_words(words.word_hashes(raw, starts, ends), owner, rows)
            figures = [_line_figures(t or "") for t in part.column("text").to_pylist()]
            lines, cleaned, total, left = (list(c) for c in zip(*figures, strict=True))
            added = [n_words, chars, np.diff(symbols[offsets]), np.array(lines), repeated, np.array(total), np.array(left)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(a, pa.int64()) for a in added), pa.array(cleaned, pa.string())],
                names=[*part.schema.names, *_ADDED, "__cleaned"],
            )


_ADDED = ("__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__chars", "__left")


def with_figures(docs: DataFrame) -> DataFrame:
    """``docs`` with counts by word and line, ``__cleaned`` text, ``__base_failed`` and ``__kept``."""
    shape = T.StructType([
        *docs.schema.fields, *[T.StructField(c, T.LongType()) for c in _ADDED], T.StructField("__cleaned", T.StringType())
    ])
    failed = (F.col("__n_words") < LEAST_WORDS) | (100 * F.col("__n_repeat_words") > MOST_REPEATED * F.col("__n_words"))
    lost = 100 * (F.col("__chars") - F.col("__left")) > MOST_LOST * F.col("__chars")
    return docs.mapInArrow(_judged, shape).withColumns({"__base_failed": failed, "__kept": ~failed & ~lost})


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents, without their failing lines."""
    return with_figures(docs).filter("__kept").withColumn("text", F.col("__cleaned")).select(*docs.columns)


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document: counts by word and line, whether the base rules reject it, and whether it is kept."""
    names = [*_ADDED[:5], "__base_failed", "__kept"]
    return with_figures(docs.select("doc_id", "text")).select("doc_id", *[F.col(c).alias(c[2:]) for c in names])
