"""Line-first cleaning: rules judge each line, failed lines go, and a text that loses too much
goes too.

A line fails as navigation (short items between bars or arrows), as boilerplate (a phrase that
pages carry around their text), for its punctuation (no sentence ends in it and it is too short
to be one), or for its symbols and shouting. Base figures of the whole text come first and can
reject it by themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import in_arrow
from labelscope.llm.words import IDENTITY, NOT_SPACE, Words, blocks, windows

SYMBOLS = re.compile(r"[#*$%&|<>]")
LEAST_WORDS, MOST_REPEATED = 50, 50  # words, percent of words
#: Shares of a line's words; of a text's characters that must be left.
NAVIGATION, SYMBOL_WORDS, SHOUTED, LEFT = 0.25, 0.20, 0.5, 0.5
SENTENCE_WORDS = 3
_SEPARATOR = re.compile(r"(?:^|\s)(?:\||»|›|>|·|•|/)(?=\s|$)")
_END = re.compile(r"""[.!?…。！？:;]["'”’)\]]*(?:\s|$)""")
_BOILERPLATE = re.compile(
    r"\b(?:accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|"
    r"enable javascript|javascript is disabled|sign in|log in|sign up|subscribe (?:now|to)|share this|"
    r"click here|read more|back to top|skip to content|lorem ipsum)\b", re.I)
RULES = ("navigation", "boilerplate", "punctuation", "symbols", "shouting")


def line_fault(line: str) -> str | None:
    """The first rule a line fails, or None. A line without words fails nothing."""
    words = line.split()
    if not words:
        return None
    n = len(words)
    if len(_SEPARATOR.findall(line)) >= max(2, NAVIGATION * n):
        return "navigation"
    if n <= 30 and _BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 5:
        if sum(1 for w in words if SYMBOLS.search(w)) > SYMBOL_WORDS * n:
            return "symbols"
        if sum(1 for w in words if w.endswith("!") or (len(w) > 1 and w.isupper())) > SHOUTED * n:
            return "shouting"
    if n < SENTENCE_WORDS and not _END.search(line):
        return "punctuation"
    return None


def clean(text: str) -> tuple[str, int, float]:
    """The text without failed lines, their number, and the share of its word characters left."""
    lines, out, gone, left, total = text.split("\n"), [], 0, 0, 0
    for line in lines:
        size = len("".join(line.split()))
        total += size
        if line_fault(line):
            gone += 1
        else:
            out.append(line)
            left += size
    return "\n".join(out), gone, left / total if total else 0.0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            words = Words(block, NOT_SPACE, IDENTITY)
            n = words.counts
            # Code points of words: their bytes less UTF-8 continuation bytes.
            leads = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
            spread = np.concatenate(([0], np.cumsum(leads[words.end] - leads[words.start])))
            runs, _ = windows(words, 3)
            rows: list[list] = [[] for _ in range(7)]
            for d in range(block.n):
                a, b = words.bounds[d], words.bounds[d + 1]
                repeated = 0
                if b - a >= 4:
                    _, which, times = np.unique(runs[a : b - 2], return_inverse=True, return_counts=True)
                    twice = times[which] > 1
                    held = np.zeros(b - a, dtype=bool)
                    for k in range(3):
                        held[k : b - a - 2 + k] |= twice
                    repeated = int(held.sum())
                text = block.text(d).decode("utf-8", "replace")
                lines = [x for x in text.split("\n") if not _blank(x)]
                cleaned, gone, left = clean(text)
                failed = b - a < LEAST_WORDS or 100 * repeated > MOST_REPEATED * (b - a)
                for column, value in zip(rows, (
                    len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, bool(failed),
                    bool(not failed and left >= LEFT), gone, cleaned,
                )):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string())
            own = [pa.array(c, k) for c, k in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, block.n), pa.array(n.astype(np.int64)),
                 pa.array(np.diff(spread[words.bounds])), *own],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "n_removed_lines", "clean_text"])


def _blank(line: str) -> bool:
    """Whether a line has no word: nothing but ASCII white space."""
    return not line.strip(" \t\n\r\x0b\x0c")


def line_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base figures, verdict and cleaned text of every row of `docs`.

    `kept` is false if the base figures fail (fewer than 50 words, or over half of them in
    repeated three-word windows) or if the removed lines hold over half of the text. Null and
    empty texts have no words and are not kept. Rows come back one for one, also repeated ones
    and those without an id; other columns are not read.
    """
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_arrow(narrow, _rows,
                    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                    "n_repeat_words bigint, base_failed boolean, kept boolean, n_removed_lines bigint, clean_text string")
