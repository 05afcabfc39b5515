"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too
much of its text goes with them.

Line rules: a line of prose ends in closing punctuation (short final fragments pass), is not
navigation (words between bars), not boilerplate (licence and rights notices), not decoration
(words that drag symbols along), not shouting and not one word over and over. Document rules:
at least ``LEAST_WORDS`` words, at most ``MOST_REPEATED`` % of words in repeated eight-word
windows, and at most ``MOST_LOST`` of its words on removed lines.

A null text has no words and fails, as an empty one does. Very long texts are judged whole;
ties and repeated rows get equal results; an empty table gives an empty result. Extra columns
are kept unless an output column bears their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._arrow import add
from ._words import LINE, LOWER, SPACED, Texts

LEAST_WORDS, WINDOW, MOST_REPEATED, MOST_LOST = 20, 8, 30, 0.5
#: Symbols that count, closing marks, and openings of boilerplate lines.
SYMBOLS = b"#*$%&|<>"
CLOSING = b".!?:;\"')]}"
BOILERPLATE = ("all rights reserved", "licensed under", "released under", "this work is licensed", "copyright", "terms of service", "privacy policy", "cookie policy", "sign up for", "subscribe to our newsletter")
MEASURES = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    *(T.StructField(n, T.LongType()) for n in ("n_lines", "n_lines_removed", "n_words_removed")),
])
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
IS_CLOSING = np.isin(np.arange(256), list(CLOSING)) | (np.arange(256) >= 0x80)
IS_UPPER = np.isin(np.arange(256), range(65, 91))
IS_LOWER = np.isin(np.arange(256), range(97, 123))


class Judged:
    """All measures of a batch of texts; lines are those with a word."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self.words = words = texts.runs(SPACED)
        lines = texts.runs(LINE)
        line_of = np.searchsorted(lines.low, words.low, "right") - 1
        used = np.unique(line_of)
        self.low, self.high, self.code, self.text = lines.low[used], lines.high[used], lines.code[used], lines.text[used]
        self.line_of = np.searchsorted(used, line_of)
        self.words_of_line = np.bincount(self.line_of, minlength=len(used))

    def on_lines(self, mask: np.ndarray) -> np.ndarray:
        """Marked bytes of each line."""
        total = np.concatenate([[0], np.cumsum(mask[self.texts.bytes])])
        return total[self.high] - total[self.low]

    def failing(self) -> np.ndarray:
        """Which lines a rule removes."""
        data, words, n = self.texts.bytes, self.words, self.words_of_line
        if not len(n):
            return np.zeros(0, bool)
        end = np.concatenate([np.flatnonzero(np.diff(self.line_of)), [len(self.line_of) - 1]])
        unfinished = ~IS_CLOSING[data[words.high[end] - 1]] & (n >= 3)
        alone = (words.high - words.low == 1) & (data[words.low] == ord("|"))
        navigation = 5 * np.bincount(self.line_of, alone, len(n)) > n
        symbols = self.on_lines(IS_SYMBOL)
        decorated = (2 * symbols > n) & (symbols >= 3)
        upper = self.on_lines(IS_UPPER)
        shouting = (n >= 3) & (upper > self.on_lines(IS_LOWER))
        same = np.zeros(len(words.code), bool)
        same[1:] = (words.code[1:] == words.code[:-1]) & (self.line_of[1:] == self.line_of[:-1])
        droning = (n >= 4) & (2 * np.bincount(self.line_of, same, len(n)) > n)
        first = words.low[np.concatenate([[0], end[:-1] + 1])]
        return unfinished | navigation | decorated | shouting | droning | self.begins(first, BOILERPLATE)

    def begins(self, first: np.ndarray, phrases: tuple[str, ...]) -> np.ndarray:
        """Which lines begin with one of the phrases at byte ``first``, in either case."""
        out = np.zeros(len(first), bool)
        for phrase in phrases:
            on = np.flatnonzero(first + len(phrase) <= self.high)
            for k, byte in enumerate(phrase.encode()):
                on = on[LOWER[self.texts.bytes[first[on] + k]] == byte]
            out[on] = True
        return out



def measure(judged: Judged) -> list:
    """The columns of ``MEASURES``."""
    texts, words, n = judged.texts, judged.words, len(judged.texts)
    n_words = words.per_text()
    inside = np.zeros(len(texts.bytes) + 1, np.int8)
    np.add.at(inside, words.low, 1)
    np.add.at(inside, words.high, -1)
    starts = (texts.bytes & 0xC0) != 0x80
    word_chars = texts.count((np.cumsum(inside[:-1], dtype=np.int8) > 0) & starts)
    n_symbols = texts.count(IS_SYMBOL[texts.bytes])
    keys = np.stack([judged.text.astype(np.uint64), judged.code], 1)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    again = np.zeros(len(order), bool)
    again[1:] = (keys[order][1:] == keys[order][:-1]).all(1)
    n_dup = np.bincount(judged.text[order][again], minlength=n).astype(np.int64)
    n_repeat = _repeated(words, n)
    fails = judged.failing()
    lost = np.bincount(judged.text, judged.words_of_line * fails, n).astype(np.int64)
    base_failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
    kept = ~base_failed & (lost <= MOST_LOST * n_words)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, np.bincount(judged.text, minlength=n), np.bincount(judged.text, fails, n).astype(np.int64), lost]


def _repeated(words, n: int) -> np.ndarray:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more."""
    first, code = words.windows(WINDOW)
    order = np.lexsort((code, words.text[first]))
    a, b = order[:-1], order[1:]
    equal = (code[a] == code[b]) & (words.text[first[a]] == words.text[first[b]])
    twice = np.zeros(len(first), bool)
    twice[a[equal]] = twice[b[equal]] = True
    covered = np.zeros(len(words.code) + 1, np.int32)
    np.add.at(covered, first[twice], 1)
    np.add.at(covered, first[twice] + WINDOW, -1)
    return np.bincount(words.text, np.cumsum(covered)[:-1] > 0, n).astype(np.int64)


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the measures and the verdict ``kept``."""
    return add(docs, text, MEASURES, lambda: lambda part: measure(Judged(Texts.of(part.column(text)))), keep)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines."""

    def step(part):
        judged = Judged(Texts.of(part.column(text)))
        made = measure(judged)
        fails, out = judged.failing(), [bytearray() for _ in range(part.num_rows)]
        for k in np.flatnonzero(~fails).tolist():
            out[judged.text[k]] += judged.texts.bytes[judged.low[k] : judged.high[k]].tobytes() + b"\n"
        return [pa.array([bytes(x[:-1]).decode() for x in out]), made[6]]

    schema = T.StructType([T.StructField(text, T.StringType()), T.StructField("_kept", T.BooleanType())])
    return add(docs, text, schema, lambda: step).filter("_kept").select(*(f"`{c}`" for c in docs.columns))
