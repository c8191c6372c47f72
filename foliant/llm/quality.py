"""Quality rules by repetition coverage.

For several lengths n, the word n-grams of a text are hashed by a rolling hash over whole batches of
texts in numpy; characters of words inside an n-gram that occurred earlier in the same text are
measured, and so are those in lines equal to an earlier line. A text is kept if it passes the base rules
and no coverage is above its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import BYTE_CODE, ODD, U64, batches, mix64, pack, text_bytes, unnamed, word_bounds

#: Percent of word characters that may lie in repeated n-grams, by n, and in repeated lines.
LIMITS = {5: 15, 7: 13, 10: 10}
LINE_LIMIT = 30
MIN_WORDS = 50
REPEAT_WIDTH = 3
REPEAT_PERCENT = 50
GROUP_BYTES = 2 << 20
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_{n}gram_chars" for n in LIMITS]]
MEASURED = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_ODD_INVERSE = pow(int(ODD), -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        have = _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


def _run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes, by differences of a polynomial's prefix sums."""
    size = len(data) + 1
    prefix = np.zeros(size, np.uint64)
    np.cumsum(BYTE_CODE[data] * _powers("up", int(ODD), size)[:-1], dtype=np.uint64, out=prefix[1:])
    runs = (prefix[ends] - prefix[starts]) * _powers("down", _ODD_INVERSE, size)[starts]
    return mix64(runs + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def _later(keys: np.ndarray, both: bool = False) -> np.ndarray:
    """Marks the values that occurred earlier; with ``both``, all values that occur twice or more."""
    marks = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return marks
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return marks
    # Only keys that fall into a marked slot are sorted with their places.
    slots = np.zeros(1 << 20, bool)
    slots[twice & U64((1 << 20) - 1)] = True
    at = np.flatnonzero(slots[keys & U64((1 << 20) - 1)])
    at = at[np.argsort(keys[at], kind="stable")]
    same = keys[at[1:]] == keys[at[:-1]]
    marks[at[1:][same]] = True
    if both:
        marks[at[:-1][same]] = True
    return marks


def _covered(marks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words inside the marked windows of ``width`` words."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    data, offsets = pack(texts, gap=b"\n")
    n_docs = len(texts)
    start, end, doc = word_bounds(data, offsets)
    total = lambda of, weight=None: np.bincount(of, weights=weight, minlength=n_docs).astype(np.int64)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(STARTS_CHAR[data], out=chars[1:])
    word_chars = chars[end] - chars[start]
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOL[data], out=symbols[1:])
    out = {"n_words": total(doc), "word_chars": total(doc, word_chars), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}

    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else line_end
    first_word = np.searchsorted(start, line_start)
    after_word = np.searchsorted(start, line_end)
    held = after_word > first_word
    line_start, line_end, first_word, after_word = line_start[held], line_end[held], first_word[held], after_word[held]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    own = mix64(np.arange(1, n_docs + 1, dtype=np.uint64) * U64(0xA24BAED4963EE407))
    again = _later(mix64(_run_hashes(data, line_start, line_end) + own[line_doc]))
    out["n_dup_lines"] = total(line_doc[again])
    held_chars = np.concatenate(([0], np.cumsum(word_chars)))
    out["dup_line_chars"] = total(line_doc[again], (held_chars[after_word] - held_chars[first_word])[again])

    gram = words = _run_hashes(data, start, end)
    for width in range(2, max(REPEAT_WIDTH, *LIMITS) + 1):
        gram = gram[:-1] * U64(0x9FB21C651E98DF25) + words[width - 1 :] if len(gram) > 1 else gram[:0]
        if width not in LIMITS and width != REPEAT_WIDTH:
            continue
        whole = doc[: len(gram)] == doc[width - 1 :][: len(gram)]
        at = np.flatnonzero(whole)
        marks = np.zeros(len(gram), bool)
        marks[at] = _later(mix64(gram[at] + own[doc[at]]), both=width == REPEAT_WIDTH)
        inside = _covered(marks, width, len(words))
        if width == REPEAT_WIDTH:
            out["n_repeat_words"] = total(doc[inside])
        if width in LIMITS:
            out[f"dup_{width}gram_chars"] = total(doc[inside], word_chars[inside])
    return out


def _measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        parts = [measure([t for (t,) in group]) for group in batches(((bytes(t),) for t in batch), GROUP_BYTES)]
        yield pd.DataFrame({c: np.concatenate([p[c] for p in parts]) if parts else np.empty(0, np.int64) for c in COUNTS})


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``quality``: the COUNTS, base_failed and kept.

    Null, empty and wordless texts have zero counts and fail the base rules. A line or n-gram is repeated if an
    equal one stands earlier in the same text; repeated rows are judged alike. An empty table gives an empty
    table; a column ``quality`` is replaced.
    """
    docs, at, back = unnamed(docs, ("quality",))
    found = docs.withColumn("_m", F.pandas_udf(_measured, MEASURED)(text_bytes(at[text])))
    m = lambda c: F.col(f"_m.{c}")
    failed = (m("n_words") < MIN_WORDS) | (100 * m("n_repeat_words") > REPEAT_PERCENT * m("n_words"))
    passed = 100 * m("dup_line_chars") <= LINE_LIMIT * m("word_chars")
    for n, limit in LIMITS.items():
        passed = passed & (100 * m(f"dup_{n}gram_chars") <= limit * m("word_chars"))
    return found.select(*back, F.struct(*[m(c).alias(c) for c in COUNTS], failed.alias("base_failed"), (~failed & passed).alias("kept")).alias("quality"))
