"""Spelling variant grouping (operator 13): asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other.
Of a pair, the shorter word (of two equally long ones the smaller) contributes two disjoint
chunks of half its length q, at 0 and at q; the other contributes its
positional grams of the lengths q that words one shorter and equally long have. One edit leaves one of
two disjoint chunks whole: in place if the edit comes behind it, moved by at most one place
if before it, so that of all positional grams those count that lie so to a chunk's beginning. The same
holds within the damaged half, of whose two halves one is whole too: it joins the key, and
words meet that share three quarters of their letters at their places. The exact test, Spark's
``levenshtein`` on code points, is part of that join, so it makes rows for near words only.

A word's form is its near word of the largest count, if that is ``ratio`` times its own count; forms have
ever larger counts, and following them ends at the root. Following is done by doubling:
each round every root is replaced by its own root.

Words and counts come from whole texts (a Python pass that sums per batch); everything after is DataFrame
joins and sums. Groups of the join are words that share three quarters of their letters; AQE splits
large ones. Words of one group of variants are at most one edit from
their hub, so no hub has more neighbours than a word has variants.

Defined cases: null texts have no words; null ids count as empty text in the hash; repeated
rows count; words without a near word are their own root, with form null and n_near 0; of
equally frequent near words the smallest in code-point order is taken; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, table
from .resample import CRC_TABLE, crc_sql

LEAST_LENGTH, LEAST_COUNT, RATIO, TYPO_EVERY = 7, 2, 10, 31


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                typo_every: int = TYPO_EVERY) -> DataFrame:
    """``word, n`` over the letter runs of ``docs`` (doc_id, text), A-Z lower-cased. Where
    ``typo_every`` divides a run's hash (with its document's id), one code point is left out."""
    ship(docs.sparkSession)

    def run(batches):
        import re
        from collections import Counter
        from zlib import crc32
        import pyarrow as pa
        # shorter runs stay shorter: they can give no word
        find = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}").findall
        for b in batches:
            for i in range(0, b.num_rows, 500):
                seen: Counter[str] = Counter()
                for doc_id, text in zip(b.column(0)[i:i + 500].to_pylist(), b.column(1)[i:i + 500]):
                    if not text.is_valid:
                        continue
                    start = crc32(f"{doc_id}:".encode())
                    for w, n in Counter(find(text.as_py().lower().decode())).items():
                        h = crc32(w.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < least_length:
                                continue
                        seen[w] += n
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())],
                                                 names=["word", "n"])
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of near words of ``words`` (word, n) once; ``a`` is the shorter, or the
    smaller of two equally long ones. Words have three code points at least."""
    sized = words.withColumn("size", F.length("word"))
    # beside chunk 0 the rest is [q, q + r) and [q + r, size); beside chunk q it is [0, r) and [r, q)
    cut = "IF(at_a = 0, q + (size_a - q) div 2, q div 2)"
    left, right = "IF(at_a = 0, q, 0)", "IF(at_a = 0, size_a, q)"
    chunks = (sized.withColumnRenamed("size", "size_a").withColumn("q", F.expr("size_a div 2"))
              .withColumn("at_a", F.explode(F.array(F.lit(0), "q"))).withColumn("part", F.expr("substring(word, at_a + 1, q)"))
              .withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
              .withColumn("rest", F.expr(f"IF(half = 0, substring(word, {left} + 1, {cut} - {left}), substring(word, {cut} + 1, {right} - {cut}))"))
              .select("size_a", "at_a", "part", "half", "rest", F.col("word").alias("a"), F.col("n").alias("n_a")))
    grams = (sized.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1))))
             .withColumn("size_a", F.expr("size - longer")).withColumn("q", F.expr("size_a div 2"))
             .withColumn("at", F.explode(F.expr("sequence(0, size - q)")))
             # what stands before the edit stays in place, what stands behind it moves on in the longer word
             .withColumn("at_a", F.explode(F.expr("filter(array(0, q), s -> at = IF(s = 0, 0, s + longer))")))
             .withColumn("part", F.expr("substring(word, at + 1, q)"))
             .withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
             .withColumn("rest", F.expr(f"IF(half = 0, substring(word, {left} + 1, {cut} - {left}), "
                                        f"substring(word, {cut} + longer + 1, {right} - {cut}))"))
             .select("size_a", "at_a", "part", "half", "rest", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer"))
    near = "(longer = 1 OR a < b) AND levenshtein(a, b, 1) = 1"
    return chunks.join(grams, ["size_a", "at_a", "part", "half", "rest"]).where(near).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word of ``forms`` (word, form): where following the forms ends."""
    links = saved(forms.select("word", F.col("form").alias("root")), "op13-roots")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("upper"))
        step = saved(links.join(up, "root", "left").select("word", F.coalesce("upper", "root").alias("root"),
                                                           F.col("upper").isNotNull().alias("moved")), "op13-roots")
        links = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return links


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (word, n), a written table."""
    pairs = saved(near_pairs(words), "op13-pairs")
    sides = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("n_other"))
    sides = sides.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"),
                                           F.col("n_a").alias("n_other")))
    best = F.min(F.struct((-F.col("n_other")).alias("minus"), F.col("other")))
    found = (sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
             .withColumn("is_form", -F.col("best.minus") >= ratio * F.col("n")))
    found = saved(found.select("word", "n_near", F.when(F.col("is_form"), F.col("best.other")).alias("form"),
                               F.when(F.col("is_form"), -F.col("best.minus")).alias("form_n")), "op13-forms")
    ends = roots(found.where("form IS NOT NULL"))
    return (words.join(found, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def op13_spelling(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_variants(saved(word_counts(docs), "op13-words"))


#: Near words by leaving letters out: b without one letter is a; or a and b without the same place agree.
ORACLE_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT w, n, {crc_sql("doc_id || ':' || w")} AS h FROM each, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
less AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)),
near AS (SELECT a.word AS word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT x.word, x.n, count(*) AS n_near, min(struct_pack(m := -y.n, o := encode(near.other))) AS best
  FROM near JOIN words x ON near.word = x.word JOIN words y ON near.other = y.word GROUP BY ALL),
forms AS (SELECT word, n_near, CASE WHEN -best.m >= 10 * n THEN decode(best.o) END AS form,
    CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM best),
chain AS (SELECT word, form AS root, 1 AS k FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY 1)
SELECT w.word, form, coalesce(root, w.word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM words w LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)"""
