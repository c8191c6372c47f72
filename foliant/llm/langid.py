"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its byte n-grams (2 to 4 bytes, letters lower-cased, other
ASCII as gaps), hashed into ``BUCKETS`` rows. Embeddings and the linear layer are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows: at most ``SAMPLE`` different rows, spread
evenly over the languages and chosen by a hash of text and label. A fifth of the sample is held back to fit the
temperature of the softmax and the rejection threshold: the score below which no more than ``REJECTED``
of the rightly named texts lie, and 0.5 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.llm.common import batches, pack, scratch, text_bytes, unnamed

BUCKETS = 1 << 12
DIM = 16
SIZES = (2, 3, 4)
#: Labelled rows that training reads, at most.
SAMPLE = 2000
EPOCHS = 60
BATCH = 32
RATE = 0.5
#: Factor of the average embedding; shares of thousands of buckets are small numbers.
SCALE = 8.0
REJECTED = 0.002
NO_LANGUAGE = "und"
GROUP_BYTES = 2 << 20
_GAP = b"    "
#: Letters lower-cased, bytes above 0x7F as they are, the rest a gap.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
ASCII_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())


def has_letter(text: bytes) -> bool:
    ascii_part = text.translate(None, ASCII_LETTER)
    if not ascii_part:
        return False
    return any(b < 128 for b in ascii_part[:64]) or any(c.isalpha() for c in ascii_part.decode("utf-8", "replace"))


def subwords(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram at every byte of the packed texts, one array for each size, and the texts' offsets.

    Bucket ``BUCKETS`` is for what is no n-gram: runs of gaps, and those that reach into the next text.
    """
    data, offsets = pack([t.translate(LETTERS) for t in texts], gap=_GAP)
    wide = data.astype(np.uint32)
    ends = (offsets[1:, None] - np.arange(1, len(_GAP) + 1)[None, :]).ravel()
    found = []
    for n in SIZES:
        code = np.zeros(len(wide), np.uint32)
        for k in range(n):
            code[: len(wide) - k] |= wide[k:] << np.uint32(8 * k)
        gaps = np.uint32(sum(0x20 << (8 * k) for k in range(n)))
        bucket = ((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)).astype(np.int32)
        bucket[code == gaps] = BUCKETS
        bucket[ends] = BUCKETS
        found.append(bucket)
    return found, offsets


def bucket_shares(text: bytes) -> np.ndarray:
    """Share of each bucket in a text's n-grams."""
    buckets, _ = subwords([text])
    counts = np.bincount(np.concatenate(buckets), minlength=BUCKETS + 1)[:BUCKETS].astype(np.float32)
    return counts / max(1.0, counts.sum())


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (BUCKETS + 1, languages): embedding times linear layer; the last row is zero
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text; NO_LANGUAGE and 0 without a letter or a language."""
        if not self.langs:
            return [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
        buckets, offsets = subwords(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        n = np.zeros(len(texts))
        for found in buckets:
            n += np.add.reduceat((found != BUCKETS).astype(np.int64), offsets[:-1])
            for k in range(len(self.langs)):
                sums[:, k] += np.add.reduceat(self.logits[:, k][found], offsets[:-1], dtype=np.float64)
        logit = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        p = _softmax(logit)
        best = p.argmax(axis=1)
        known = np.array([has_letter(t) for t in texts])
        score = np.where(known, p[np.arange(len(texts)), best], 0.0)
        return [self.langs[b] if k else NO_LANGUAGE for b, k in zip(best, known, strict=True)], score


def _softmax(logit: np.ndarray) -> np.ndarray:
    e = np.exp(logit - logit.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(shares: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """Fits embeddings and softmax on four fifths of the rows, temperature and threshold on the rest."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    held = np.arange(len(labels)) % 5 == 4 if len(labels) >= 20 else np.zeros(len(labels), bool)
    x, y = shares[~held], labels[~held]
    most = int(np.bincount(y).max())
    embed = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    layer = np.zeros((DIM, k), np.float32)
    bias = np.zeros(k, np.float32)
    one_hot = np.eye(k, dtype=np.float32)
    scale = np.float32(SCALE)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        # Every language gives equally many rows to an epoch; those of small ones come round again.
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(np.flatnonzero(y == c)), most) for c in range(k) if (y == c).any()]))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            hidden = x[at] @ embed * scale
            wrong = (_softmax(hidden @ layer + bias) - one_hot[y[at]]) / len(at)
            back = wrong @ layer.T
            layer -= rate * (hidden.T @ wrong)
            bias -= rate * wrong.sum(axis=0)
            embed -= rate * (x[at].T @ back) * scale
    logits = np.zeros((BUCKETS + 1, k), np.float32)
    logits[:BUCKETS] = embed @ layer * scale
    temperature, threshold = 1.0, 0.0
    if held.any() and k > 1:
        logit = shares[held] @ logits[:BUCKETS] + bias
        y = labels[held]
        grid = np.geomspace(1, 20, 41)
        losses = [-np.log(np.maximum(_softmax(logit / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(losses))])
        p = _softmax(logit / temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            threshold = float(min(0.5, np.quantile(p[right].max(axis=1), REJECTED)))
    return Model(langs, logits, bias, temperature, threshold)


def _share_bytes(texts: pd.Series) -> pd.Series:
    return pd.Series([bucket_shares(bytes(t)).astype(np.float16).tobytes() for t in texts])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Model of (text, lang) rows; null texts and labels are left out. Without rows it knows no language.

    Only hashed n-gram shares of at most ``sample`` rows (8 KB each) come to the driver; so at most ``sample`` languages are learned, those
    with most different rows, and none of the more frequent ones is left out.
    """
    rows = labelled.select(text_bytes(text).alias("body"), F.col(f"`{lang}`").cast("string").alias("lang")).where(F.col(f"`{text}`").isNotNull() & F.col("lang").isNotNull())
    # Copies of a text have one hash and count as one row.
    rows = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64("body", "lang"), 1))
    hashes = scratch(rows.select("lang", "_h").distinct(), "hashes")
    counts = {r.lang: r.n for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    quota = max(1, sample // len(langs))

    def below(bounds: dict[str, float]) -> DataFrame:
        held = hashes.sparkSession.createDataFrame(sorted(bounds.items()), "lang string, bound double")
        share = F.shiftrightunsigned("_h", 10).cast("double") / F.lit(float(1 << 53))
        return hashes.join(F.broadcast(held), "lang").where(share < F.col("bound")).drop("bound")

    # Hashes above a language's bound aren't among its first if enough lie below it: twice the quota do on average. A language
    # for which they don't is ranked as a whole.
    bounds = {k: min(1.0, (2 * quota + 40) / n) for k, n in counts.items()}
    passed = {r.lang: r.n for r in below(bounds).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = {k: b if passed.get(k, 0) >= min(quota, counts[k]) else 1.0 for k, b in bounds.items()}
    ranked = below(bounds).withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_h")))
    chosen = ranked.where(F.col("_rank") <= quota).orderBy("_h").limit(sample).select("lang", "_h")
    texts = rows.join(F.broadcast(chosen), ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("body").alias("body"))
    taken = texts.select("lang", F.pandas_udf(_share_bytes, T.BinaryType())("body").alias("shares"), "_h").collect()
    taken.sort(key=lambda r: (r["_h"], r.lang))
    index = {x: i for i, x in enumerate(langs)}
    taken = [r for r in taken if r.lang in index]
    shares = np.stack([np.frombuffer(r.shares, np.float16) for r in taken]).astype(np.float32)
    return train(shares, np.array([index[r.lang] for r in taken]), langs)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``language``: lang, score (0 to 1) and rejected.

    Null texts and texts without a letter are 'und' with score 0 and rejected; so is everything if the model
    knows no language. An empty table gives an empty table; a column ``language`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def named(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            langs: list[str] = []
            scores = [np.empty(0)]
            for group in batches(((bytes(t),) for t in batch), GROUP_BYTES):
                lang, score = held.value.predict([t for (t,) in group])
                langs += lang
                scores.append(score)
            yield pd.DataFrame({"lang": langs, "score": np.concatenate(scores)})

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    docs, at, back = unnamed(docs, ("language",))
    found = docs.withColumn("_l", F.pandas_udf(named, schema)(text_bytes(at[text])))
    rejected = (F.col("_l.lang") == NO_LANGUAGE) | (F.col("_l.score") < F.lit(model.threshold))
    return found.select(*back, F.struct(F.col("_l.lang").alias("lang"), F.col("_l.score").alias("score"), rejected.alias("rejected")).alias("language"))
