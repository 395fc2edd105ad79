"""Target-distribution importance resampling (operator 11): array-scored weights, then
a distributed LSD radix sort.

Words are the runs of ASCII letters, digits and non-ASCII characters of the text with A-Z
lower-cased; a feature is a run of ``n`` words or fewer. Features fall into ``BUCKETS`` by
crc32. A bucket's gain is the floored log ratio of its smoothed shares in the target and in
the raw texts; the gains are one array of ``BUCKETS`` integers (80 kB, sent to the tasks), and
a document's weight is the sum of that array at its features. A Gumbel term from the
id's SHA-256 is added, and the rows with the highest scores are drawn.

Ranks come from a radix sort over a composite key, least significant digit first: score
(descending), ``doc_id`` (ascending), number of features. Each pass of ``DIGIT_BITS`` bits is a
stable counting sort: rows lie in blocks of consecutive positions, counts by (digit, block)
are summed in Spark, prefix sums over digits and, within a digit, over blocks give where each
block's rows of each digit go, and a task ranks the rows of its block and hands each its
destination. Blocks hold equally many positions whatever the keys are, so no key, tie
or digit can overload a task. Bits that all rows share are skipped. After the last pass a row's
position is its rank. Positions are columns of written tables, so a lost executor's work is
redone with the same result.

Defined cases: null texts have no words; a document of fewer than ``least_words`` words has a
weight and a score but takes no part in the draw; ids are integers, a null id counts as empty text in the Gumbel
term and sorts after all others; repeated ids are rows of their own, equal scores and ids
are ranked by number of features (rows that agree in that too are alike);
an empty table gives no rows, an empty target has all counts 0. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship, table

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
DIGIT_BITS, BLOCK_BITS, BLOCKS_BITS = 12, 14, 16

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Buckets(dict):
    """Feature (UTF-8 bytes) -> bucket, kept per task up to a size bound."""

    LIMIT = 400_000

    def __missing__(self, feature: bytes) -> int:
        from zlib import crc32
        if len(self) >= self.LIMIT:
            self.clear()
        b = self[feature] = crc32(feature) % BUCKETS
        return b

    def of(self, text: bytes | None, longest: int) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature of a text."""
        ws = text.translate(_FOLD).split() if text else []
        found = ws + [b" ".join(ws[i:i + k]) for k in range(2, longest + 1) for i in range(len(ws) - k + 1)]
        return len(ws), np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def bucket_counts(texts: DataFrame, longest: int = 1) -> np.ndarray:
    """Features by bucket over all rows of ``texts`` (text): ``BUCKETS`` sums."""
    ship(texts.sparkSession)

    def run(batches):
        import pyarrow as pa
        seen, sums = Buckets(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 100):
                found = [seen.of(t, longest)[1] for t in b.column(0)[i:i + 100].to_pylist()]
                sums += np.bincount(np.concatenate(found), minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])
    got = (texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
           .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the raw texts)) of each bucket, one added to each count."""
    ratio = (target + 1.0) * (raw.sum() + float(BUCKETS)) / ((raw + 1.0) * (target.sum() + float(BUCKETS)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the id's SHA-256 under a seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, by_bucket: np.ndarray, longest: int = 1, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(by_bucket)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        seen, gain = Buckets(), shared.value
        for b in batches:
            words, sizes, weights = [], [], []
            for t in b.column(1):
                n, at = seen.of(t.as_py(), longest)
                words.append(n)
                sizes.append(len(at))
                weights.append(int(gain[at].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, sizes, weights))],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    got = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_words long, n_features long, weight long")
    return got.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def _halves(name: str, flip: bool) -> dict[str, Column]:
    """A long column as two sort keys of 32 bits, low half first; differences within a half cannot overflow."""
    c = F.bitwise_not(F.col(name)) if flip else F.col(name)
    c = F.coalesce(c, F.lit(0))
    return {f"{name}_low": c.bitwiseAND(F.lit(0xFFFFFFFF)), f"{name}_high": F.shiftright(c, 32)}


def _place(spread: int, digit_of: Column, rows: DataFrame, total_by_digit: np.ndarray) -> DataFrame:
    """One stable counting sort pass of ``rows`` (pos, ...) by ``digit_of``; new ``pos`` are 0, 1, 2..."""
    rows = rows.withColumn("block", F.shiftright("pos", spread)).withColumn("digit", digit_of.cast("int"))
    counts = rows.groupBy("digit", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")  # a row per block
    starts = counts.select("block", "digit", before.alias("before"))
    names = rows.columns
    base = np.cumsum(total_by_digit) - total_by_digit

    def rank(left, right):
        import pyarrow as pa
        if not left.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([(c, left.schema.field(c).type) for c in names[:-2]]))
        left = left.combine_chunks().sort_by("pos")
        digit = left["digit"].to_numpy().astype(np.int64)
        first = np.zeros(len(base), np.int64)
        first[right["digit"].to_numpy()] = right["before"].to_numpy()
        order = np.argsort(digit, kind="stable")  # the block's own counting sort
        sizes = np.bincount(digit, minlength=len(base))
        within = np.empty(len(digit), np.int64)
        within[order] = np.arange(len(digit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pos = base[digit] + first[digit] + within
        return left.set_column(names.index("pos"), "pos", pa.array(pos)).select(names[:-2])
    schema = rows.drop("block", "digit").schema
    return rows.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(rank, schema)


def radix_ranks(rows: DataFrame, descending: str, then: list[str]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... by the long column ``descending`` (highest first), then by
    ``then`` (lowest first; nulls last). ``rows`` must be a written table whose
    column ``pos`` numbers its rows, with gaps or without."""
    keys: dict[str, Column] = {}
    for name in reversed(then):
        keys |= _halves(name, False) | {f"{name}_null": F.col(name).isNull().cast("long")}
    keys |= _halves(descending, True)
    ends = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{f.__name__}") for k, c in keys.items() for f in (F.min, F.max))).first()
    if not ends.n:
        return rows.drop("pos").withColumn("rank", F.lit(None).cast("long"))
    # blocks of 2 ** BLOCK_BITS rows, larger ones beyond 2 ** (BLOCK_BITS + BLOCKS_BITS) rows: at
    # most 2 ** BLOCKS_BITS blocks, of which a window takes one digit's
    spread = max(BLOCK_BITS, ends.n.bit_length() - BLOCKS_BITS)
    for k, c in keys.items():
        low, bits = ends[f"{k}_min"], (ends[f"{k}_max"] - ends[f"{k}_min"]).bit_length()
        for at in range(0, bits, DIGIT_BITS):
            digit = F.shiftright(c - F.lit(low), at).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
            sums = np.zeros(1 << DIGIT_BITS, np.int64)
            for r in rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect():  # a row per digit value
                sums[r.digit] = r.n
            rows = saved(_place(spread, digit, rows, sums), "op11-pass")
    if not any(ends[f"{k}_max"] > ends[f"{k}_min"] for k in keys):  # all alike: one pass makes positions dense
        rows = saved(_place(spread, F.lit(0), rows, np.array([ends.n])), "op11-pass")
    return rows.withColumn("rank", F.col("pos") + 1).drop("pos")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs`` (doc_id, text), drawn
    towards the texts of ``target``: floor(percent * N / 100) of the N rows of ``least_words``
    words or more have a rank, the others null."""
    by_bucket = gains(bucket_counts(docs, longest), bucket_counts(target, longest))
    scored = saved(weigh(docs, by_bucket, longest, seed).withColumn("pos", F.monotonically_increasing_id()), "op11-scored")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = radix_ranks(fit, "score", ["doc_id", "n_features"])
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return (ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
            .unionByName(rest.drop("pos")).select("doc_id", "n_features", "weight", "score", "rank"))


def op11_resample(spark, sf_dir):
    """Weight, score and draw rank of every document, drawn towards the benchmark's texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text"))


#: crc32 of a word in SQL: the table of 256 remainders, then a fold over the UTF-8 bytes.
CRC_TABLE = """SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of ``text``, beside a row of CRC_TABLE."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({text})) + 1),
      lambda k: ('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"""


def _lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
ORACLE_SQL = f"""
WITH crc AS ({CRC_TABLE}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_lowered("coalesce(text, '')")}, {_WORDS}) AS ws FROM documents),
b AS (SELECT regexp_extract_all({_lowered("coalesce(text, '')")}, {_WORDS}) AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(ws) AS w FROM b),
vocab AS (SELECT w, {crc_sql("w")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN vocab USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN vocab USING (w) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0)::DOUBLE * ((SELECT count(*) FROM dw) + 10000.0)::DOUBLE
    / ((coalesce(s, 0) + 1.0)::DOUBLE * ((SELECT count(*) FROM bw) + 10000.0)::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket)),
w AS (SELECT r, sum(g)::BIGINT AS g FROM dw JOIN vocab USING (w) JOIN gain USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, r, len(ws)::BIGINT AS n_features, coalesce(g, 0) AS weight,
    coalesce(g, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM k) THEN rank END AS rank
FROM x LEFT JOIN k USING (r)"""
