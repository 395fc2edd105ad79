"""Quality classifier (operator 1): logistic regression on hashed word n-grams,
trained with follow-the-regularised-leader updates, scored as sparse dot products.

Features of a text: its white-space words lower-cased (lexical words) and their
shapes (letter case, digits, trailing signs, "same as the word before"), as
unigrams and bigrams of either stream, hashed to ``2**bits`` slots; the value of
a slot is the square root of its count, and a text's values have unit length.

Training reads a bounded sample (``max_rows`` labelled rows in expectation, by a
hash of the id; of each label as many, or all of a rarer one) in up to ``BLOCKS`` even blocks of ``BLOCK_ROWS``
or more, each in a task of its own. A block runs FTRL-proximal over its rows; the model is the mean of the blocks' weights (parameter mixing), at most
``2**bits`` floats, which is what is broadcast.

Defined cases: null and empty texts have the bias feature only and get a score
too; repeated rows are scored each; repeated labels of an id count once (the
larger label holds); null labels and ids do not train; without any training row
every score is 0.5; extra columns of ``docs`` are kept by ``keep`` alone, where ``score`` and ``predicted`` are refused.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Boxed, crc_mod, even_share, flag, mix64, ship, table

BITS, BLOCKS, BLOCK_ROWS, MAX_ROWS, EPOCHS, THRESHOLD = 18, 8, 2500, 20_000, 5, 0.3
_SHAPE = [(re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "x"), (re.compile(r"[^\W\d_]+"), "X"),
          (re.compile(r"\d+"), "9")]
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> (lexical hash, shape hash); cleared at a size bound."""

    def __missing__(self, word: str):
        from xxhash import xxh3_64_intdigest
        if len(self) >= 300_000:
            self.clear()
        shape = word
        for pat, sign in _SHAPE:
            shape = pat.sub(sign, shape)
        v = self[word] = (xxh3_64_intdigest(word.lower()), xxh3_64_intdigest("\x00" + shape))
        return v


def features(text: str | None, words: _Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one whole text; slot 0 with value 1 is the bias."""
    ws = text.split() if text else []
    if not ws:
        return np.zeros(1, np.int64), np.ones(1)
    a = np.array([words[w] for w in ws], np.uint64)
    lex, shape = a[:, 0], a[:, 1].copy()
    shape[1:][lex[1:] == lex[:-1]] ^= _P  # a word that repeats the one before
    grams = np.concatenate([lex, mix64(lex[:-1] * _P + lex[1:]), shape, mix64(shape[:-1] * _P + shape[1:])])
    slot, n = np.unique(grams >> np.uint64(64 - bits), return_counts=True)
    val = np.sqrt(n)
    val /= np.sqrt((val * val).sum())
    return np.concatenate([[0], slot.astype(np.int64)]), np.concatenate([[1.0], val])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = EPOCHS, alpha: float = 2.0,
         beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> np.ndarray:
    """FTRL-proximal logistic regression: weights after ``epochs`` passes."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
    for _ in range(epochs):
        for i, x, y in rows:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            np.add.at(z, i, g - sigma * w)
            np.add.at(n, i, g * g)
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> np.ndarray:
    """Mean of the blocks' FTRL weights (float32, ``2**bits``)."""
    marks = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
             .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")))
    sizes = {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()}  # a row per label
    n = sum(sizes.values())
    blocks = min(BLOCKS, max(1, min(n, max_rows) // BLOCK_ROWS))
    lot = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = F.broadcast(marks.where(lot < even_share("quality", sizes, max_rows)))  # max_rows ids and labels: no text is shuffled
    sample = (docs.select("doc_id", "text").join(picked, "doc_id")
              .select("text", "quality", F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(F.lit(5), "doc_id").alias("lot"),
                      F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        words = _Words()
        rows = rows.sort_values(["lot", "doc_id", "text", "quality"])
        seen = [(*features(t, words, bits), int(y)) for t, y in zip(rows.text, rows.quality)]
        return pd.DataFrame({"n": [len(seen)], "w": [ftrl(seen, bits).astype("<f4").tobytes()]})
    # a block a task: dealt by range, as a hash would put several into one
    dealt = sample.repartitionByRange(blocks, "block").sortWithinPartitions("block")

    def blocks_of(batches):
        rows = pd.concat([*batches, pd.DataFrame(columns=["text", "quality", "doc_id", "lot", "block"])])
        for _, some in rows.groupby("block"):
            yield fit(some)
    fitted = dealt.mapInPandas(blocks_of, "n long, w binary").collect()  # one row a block
    if not fitted:
        return np.zeros(1 << bits, np.float32)
    return np.average([np.frombuffer(r.w, "<f4") for r in fitted], axis=0,
                      weights=[r.n for r in fitted]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` and its ``score``."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType
    bits = int(len(weights)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    cols = list(dict.fromkeys([*keep, "text"]))

    def run(batches):
        w, words = shared.value, _Words()
        for b in batches:
            dots = [float(w[i] @ x) for i, x in
                    (features(t.as_py(), words, bits) for t in b.column(cols.index("text")))]
            s = 1 / (1 + np.exp(-np.clip(np.array(dots, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(cols.index(c)) for c in keep] + [pa.array(s, pa.float64())],
                                             names=[*keep, "score"])
    picked = docs.select(*cols)
    schema = StructType([picked.schema[c] for c in keep] + [StructField("score", DoubleType())])
    return picked.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float = THRESHOLD,
             max_rows: int = MAX_ROWS) -> DataFrame:
    """``keep``, ``score`` and ``predicted`` of every document."""
    if {"score", "predicted"} & set(keep):
        raise ValueError("score and predicted are the operator's own columns")
    ship(docs.sparkSession)
    scored = score(docs, train(docs, labels, max_rows), keep)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", "quality").where(crc_mod("doc_id", 5) != 0)


def op1_quality(spark, sf_dir):
    """Every document's quality score; learns from the rows that are not held out."""
    return (classify(table(spark, sf_dir, "documents"), training_labels(table(spark, sf_dir, "labels")), ["doc_id"])
            .select("doc_id", flag(crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents that the classifier rejects go. Columns of any name come through as they are."""
    boxed = Boxed(docs, "doc_id", "text")
    kept = classify(boxed.docs, training_labels(table(spark, sf_dir, "labels")), boxed.docs.columns)
    return boxed.open(kept.where("predicted = 1"))
