"""MinHash near-duplicates (operator 4) with odd sketches.

A document's set is its distinct word shingles (all its words as one with fewer).
Documents with equal sets form a class; the class's smallest id stands for it.
Every class has ``HASHES`` MinHash values. They are cut into ``bands`` of ``rows``
values, which propose candidates, and all of them are folded into an odd sketch: a bitmap in
which each value flips one bit, so that the population count of two sketches' XOR
tells how many values differ. A candidate pair is dropped if that count is more than
``most_bits`` (six standard errors above what a pair at the threshold has). A second
odd sketch folds the whole set: its XOR count is never more than the number
of shingles in which two sets differ, so a count above what the threshold allows drops
a pair without loss. The others are confirmed by the exact sizes of the full
sets' intersection and union.

Groups are not expanded into pairs. First every member of a bucket is held against the
one member with the smallest hash there, another one in each band, and confirmed
links are joined to components. Only what is still apart is compared further:
in buckets that hold more than one component, members outside its largest one
against all members of other components, the sketch test being part of the join. So
every candidate pair is decided or already connected, and no bucket is cut.

With 36 bands of 7 a pair at similarity 0.85 is missed with probability 1e-6, one at
0.9 with 1e-10.

Defined cases: null texts and texts without words have an empty set and no link;
a null id has no component and is not kept; rows that share an id share a component,
whatever their texts; the pipeline's stage keeps all columns, and every row of a kept id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, Boxed, HashCache, meet, mix64, saved, ship, table
from .components import components

HASHES, SKETCH_WORDS, SET_WORDS = 256, 8, 16
_A = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32) | np.uint32(1)
_B = mix64(np.arange(1001, 1001 + HASHES, dtype=np.uint64)).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(words: list[bytes], hashes: HashCache, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.array(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(size, len(h))))
    for i in range(min(size, len(h))):
        out = mix64(out * _P + h[i:i + n])
    return np.unique(out)


def minhash(items: np.ndarray) -> np.ndarray:
    """``HASHES`` minima, of a 32-bit linear hash each."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i:i + 2048, None] * _A + _B).min(0), out=low)
    return low


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """The parity bitmap of the values, as 64-bit words."""
    return parity(mix64(low.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))), SKETCH_WORDS)


def parity(items: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of ``words`` 64-bit words in which each item flips one bit."""
    odd = np.bincount((items % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64)
    for part in low[:bands * rows].reshape(bands, rows).astype(np.uint64).T:
        key = mix64(key * _P + part)
    return key


def most_bits(threshold: float) -> int:
    """The XOR count that a pair at the threshold exceeds with probability below 1e-7."""
    bits = 64 * SKETCH_WORDS
    differ = HASHES * (1 - threshold) + 6 * (HASHES * threshold * (1 - threshold)) ** 0.5
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ)) + 10)


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, fp`` (of the set), ``bands, sketch`` (both odd sketches) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest
        hashes = HashCache()
        for b in batches:
            n, fp, keys, sketch = [], [], [], []
            for t in b.column(1):
                s = shingles(ascii_words(t.as_py()), hashes, size)
                n.append(len(s))
                fp.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                low = minhash(s) if len(s) else None
                keys.append(band_keys(low, bands, rows).view(np.int64) if len(s) else None)
                sketch.append(np.concatenate([odd_sketch(low), parity(s, SET_WORDS)]).view(np.int64) if len(s) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, longs),
                 pa.array(sketch, longs)], names=["doc_id", "n_shingles", "fp", "bands", "sketch"])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
        run, f"doc_id {id_type}, n_shingles long, fp binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, items``: the whole sets of the classes ``wanted`` (node, doc, fp), each
    made from the text of its document ``doc``."""
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest
        hashes = HashCache()
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                node, sets = [], []
                for n, fp, t in zip(*(c[i:i + 1000] for c in b.columns)):
                    items = shingles(ascii_words(t.as_py()), hashes, size)
                    if xxh3_128_digest(items.tobytes()) == fp.as_py():  # another text of that id else
                        node.append(n.as_py())
                        sets.append(items.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                                 names=["node", "items"])
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        wanted, F.col("doc_id") == F.col("doc"))
    return texts.select("node", "fp", "text").mapInArrow(run, "node long, items array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _near(a: str, b: str, percent: int):
    """The two sketch tests of a candidate pair."""
    bits = [F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(SKETCH_WORDS + SET_WORDS)]
    differ = sum(bits[SKETCH_WORDS + 1:], bits[SKETCH_WORDS])
    return ((sum(bits[1:SKETCH_WORDS], bits[0]) <= most_bits(percent / 100))
            & (differ * (100 + percent) <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = 36, rows: int = 7) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``."""
    sig = saved(sketches(docs, size, bands, rows), "op4-sketches")
    whole = sig.where("doc_id IS NOT NULL AND fp IS NOT NULL")
    # one node for each different set
    classes = saved(whole.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"))
                    .withColumn("node", F.monotonically_increasing_id()), "op4-classes")
    member = saved(meet(whole.select("doc_id", "fp"), classes.select("fp", "node", "n"), "fp")
                   .select("doc_id", "node").distinct(), "op4-members")
    # an id with several texts stands for several classes: they are linked through it
    several = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    same_id = member.join(several.select("doc_id", "a"), "doc_id").where("node <> a").select(
        F.greatest("a", "node").alias("a"), F.least("a", "node").alias("b"))
    words = [F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS + SET_WORDS)]
    classes = classes.drop("n")
    nodes = saved(whole.withColumnRenamed("fp", "f").join(classes, (F.col("f") == F.col("fp")) & (F.col("doc_id") == F.col("doc")))
                  .dropDuplicates(["node"]).select("node", "bands", F.col("n_shingles").alias("sn"), *words), "op4-nodes")
    sketch = nodes.drop("bands")

    dealt = nodes.select("node", F.explode("bands").alias("band"))
    full = (dealt.groupBy("band").agg(F.min_by("node", F.xxhash64("band", "node")).alias("centre"), F.count("*").alias("n"))
            .where("n > 1").select("band", "centre"))
    bucket = saved(dealt.join(full, "band"), "op4-buckets")
    sets = saved(full_sets(docs, classes.join(bucket.select("node").distinct(), "node"), size), "op4-sets")

    def sketched(side: str, frame=sketch):
        keep = [c for c in frame.columns if c not in sketch.columns]
        return frame.select(*keep, F.col("node").alias(side), *(
            F.col(c).alias(side + c[1:]) for c in sketch.columns if c != "node"))
    stars = bucket.where("node <> centre").select(
        F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
    stars = (stars.join(sketched("a"), "a").join(sketched("b"), "b").where(_near("a", "b", percent)).select("a", "b"))
    links = saved(confirmed(stars, sets, percent).unionByName(same_id), "op4-links")
    root = components(links)

    def rooted(frame, col="node"):
        return (frame.join(root.select(F.col("node").alias(col), "root"), col, "left")
                .withColumn("root", F.coalesce("root", F.col(col))))
    apart = saved(rooted(bucket.select("band", "node")), "op4-rooted")
    sizes = apart.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = (sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("k"))
             .where("k > 1").select("band", "main"))
    # sketches ride along only in buckets that hold several components
    apart = saved(apart.join(mixed, "band").join(sketch, "node"), "op4-apart")
    few = sketched("a", apart.where("root <> main").select("band", F.col("root").alias("ra"), *sketch.columns))
    all_ = sketched("b", apart.select("band", F.col("root").alias("rb"), *sketch.columns))
    met = (few.join(all_, "band").where((F.col("ra") != F.col("rb")) & _near("a", "b", percent))
           .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    links = saved(root.select(F.col("node").alias("a"), F.col("root").alias("b"))
                  .unionByName(confirmed(met, sets, percent)), "op4-links")
    root = components(links)
    of = saved(rooted(member), "op4-rooted")
    smallest = saved(of.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "op4-smallest")
    component = saved(meet(of, smallest, "root").groupBy("doc_id").agg(F.min("component_id").alias("component_id")),
                      "op4-components")
    return (sig.select("doc_id", "n_shingles").join(component, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def op4_neardup(spark, sf_dir):
    """Set size and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: one document of each group stays, at shingles of five words
    and a similarity of 0.8. Documents without a word, or without an id, stay too.
    Columns of any name come through as they are (only ids and texts are looked at)."""
    found = near_duplicates(docs, size=5, percent=80, bands=42, rows=6)
    gone = found.where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    boxed = Boxed(docs, "doc_id")
    return boxed.open(boxed.docs.join(gone, "doc_id", "left_anti"))
