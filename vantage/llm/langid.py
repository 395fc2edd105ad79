"""Language identification (operator 8): word-first backoff.

A text's words (runs of letters, lower-cased) each score every language by the
word's log frequency in it. A word that the model does not know falls back to
its character n-grams, longest first (n = 5 to 1, with word ends marked): the
first length of which any n-gram is known scores the word by their mean. The
language with the largest sum wins (ties: the smaller name).

The model is fitted on a bounded sample of labelled rows (``max_rows`` in
expectation, by a hash of the id; of each language as many, or all of a rarer one). It keeps the words and n-grams that make up
at least ``least`` of a language's words or n-grams, so at most ``1/least`` of
each per language and length, whatever the corpus: that bound is what makes the
broadcast safe.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text if nothing was learned; null ids and languages do not train.
``score`` is the posterior of the winner under equal priors.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, even_share, flag, saved, ship, table

MAX_ROWS, LEAST, LONGEST = 20_000, 1e-5, 5
_WORD = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters (Unicode L) of a text; the pattern's runs may hold other numerals (``²``, ``½``) too."""
    runs = _WORD.findall(text)
    if "".join(runs).isalpha() or not runs:
        return runs
    return "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    w = f"_{word}_"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, least: float = LEAST) -> tuple[list[str], dict]:
    """Languages and ``(n, gram) -> log frequencies``; n = 0 holds whole words."""
    rows = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    lot = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(lot < even_share("lang", sizes, max_rows)).select("lang", "text")

    def count(batches):
        import pyarrow as pa
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[lang].update(letter_runs(text.lower()))
            for lang, words in seen.items():
                found: Counter = Counter()
                for w, c in words.items():
                    found[0, w] += c
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            found[n, g] += c
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(found)), pa.array([k[0] for k in found], pa.int32()),
                    pa.array([k[1] for k in found]), pa.array(list(found.values()), pa.int64())],
                    names=["lang", "n", "gram", "c"])
    counts = sample.mapInArrow(count, "lang string, n int, gram string, c long")
    sums = counts.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    sums = saved(sums, "op8-counts")
    totals = {(r.lang, r.n): r.c for r in sums.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return [], {}
    whole = sums.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    known = (sums.join(whole, ["lang", "n"]).where(F.col("c") >= least * F.col("total"))
             .select("n", "gram").distinct())
    model: dict = {}
    place = {lang: i for i, lang in enumerate(langs)}
    for r in sums.join(known, ["n", "gram"]).toLocalIterator():  # at most 6 / least rows a language pair
        v = model.get((r.n, r.gram))
        if v is None:
            v = model[r.n, r.gram] = np.zeros(len(langs))
        v[place[r.lang]] = r.c
    total = {n: np.array([totals.get((lang, n), 0) for lang in langs], float) for n in range(LONGEST + 1)}
    for (n, _), v in model.items():
        np.log((v + 0.5) / (total[n] + 1.0), out=v)
    return langs, model


class Scorer(dict):
    """Word -> its row in ``rows`` (one column a language); emptied between texts
    at a size bound."""

    LIMIT = 200_000

    def __init__(self, langs: int, model: dict):
        super().__init__()
        self.rows = np.zeros((1024, langs))
        self.known: list[dict] = [{} for _ in range(LONGEST + 1)]  # by length; 0: whole words
        for (n, g), v in model.items():
            self.known[n][g] = v

    def __missing__(self, word: str) -> int:
        v = self.known[0].get(word)
        for n in range(LONGEST, 0, -1):
            if v is not None:
                break
            get = self.known[n].get
            hits = [x for g in grams(word, n) if (x := get(g)) is not None]
            v = np.add.reduce(hits) / len(hits) if hits else None
        at = self[word] = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = 0.0 if v is None else v
        return at

    def total(self, words: list[str]) -> np.ndarray:
        """Sum of the words' scores, by language."""
        if len(self) >= self.LIMIT:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.rows[at].sum(axis=0)


def identify(docs: DataFrame, langs: list[str], model: dict, keep: list[str]) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` of every row of ``docs``."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    cols = list(dict.fromkeys([*keep, "text"]))

    def run(batches):
        import pyarrow as pa
        names, table_ = shared.value
        scorer = Scorer(len(names), table_)
        for b in batches:
            pred, score = [], []
            for t in b.column(cols.index("text")):
                words = letter_runs((t.as_py() or "").lower())
                if not words or not names:
                    pred.append("und")
                    score.append(0.0)
                    continue
                s = scorer.total(words)
                i = int(s.argmax())
                pred.append(names[i])
                score.append(float(1 / np.exp(np.clip(s - s[i], -700, 0)).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(cols.index(c)) for c in keep] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=[*keep, "lang_pred", "score"])
    picked = docs.select(*cols)
    schema = StructType([*(picked.schema[c] for c in keep), StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])
    return picked.mapInArrow(run, schema)


def op8_langid(spark, sf_dir):
    """Every document's language; learns from the rows that are not held out."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    langs, model = fit(docs.select("doc_id", "lang", "text").where(crc_mod("doc_id", 3) != 1))
    return (identify(docs, langs, model, ["doc_id"])
            .select("doc_id", flag(crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"))
