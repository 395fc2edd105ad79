"""Benchmark decontamination (operator 5): CGK embeddings and bit sampling.

A benchmark item and the windows of a document are word sequences. A CGK random
walk copies a sequence out symbol by symbol and moves on to the next symbol or
stays, by a random bit of (step, symbol); two sequences at a small edit distance give
outputs at a small Hamming distance, as the walks fall back into step after an
edit. ``WALKS`` independent walks are taken, and from each ``SAMPLES`` times ``PICKS`` output
positions are sampled; a window is a candidate for an item if any sample agrees
in all its positions. Candidates are verified by the exact edit distance of the item
to the best part of the document around the window.

The walks drift apart as a sequence grows, so items of more than ``PIECE`` words are embedded
in equal pieces of at most that many: if the item is within the limit, so is one of its pieces
at least, and any one piece makes the whole item a candidate. Windows have the size of the
piece and begin where an anchor puts them. A piece's
anchors are its ``limit + 1`` rarest word positions, ``limit`` being the edits allowed (``edits``
of its words): as an edit spoils one word at most, any passage within the limit holds an
anchor, so the anchors lose nothing and the samples alone decide recall
(the tests plant items of 12 to 1,000 words at the limit and find all).

Words are runs of letters and digits, lower-cased; whole texts are scanned. Items
are taken ``ITEMS`` at a time: that bounds what is broadcast, whatever the benchmark's size.

Defined cases: null and empty texts contain nothing; items without words match
nothing, items of fewer than ``exact_below`` words only without an edit (by default 10; with 5, items of 5 to 9
words are found with one edited word too, of which clean texts may well hold some); repeated rows and items are
reported each; null ids are reported as null; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Boxed, mix64, saved, ship, table

EDITS, EXACT_BELOW, WALKS, SAMPLES, PICKS, ITEMS, PIECE = 0.2, 10, 12, 8, 3, 20_000, 100
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def walk_keys(symbols: np.ndarray, lengths: np.ndarray, walks: int = WALKS, samples: int = SAMPLES,
              picks: int = PICKS) -> np.ndarray:
    """Bit-sampling keys (sequence x walk * samples) of padded symbol rows."""
    rng = np.random.default_rng(5)
    where = rng.random((walks, samples, picks))  # as a share of twice the length: a walk stays half the time
    walk = np.arange(walks, dtype=np.uint64)[None, :]
    keys = np.empty((len(symbols), walks * samples), np.uint64)
    for i in range(0, len(symbols), 1024):
        part, n = symbols[i:i + 1024].astype(np.int64), lengths[i:i + 1024, None]
        rows, at = np.arange(len(part))[:, None], np.zeros((len(part), walks), np.int64)
        steps = 2 * int(n.max(initial=1))
        out = np.empty((steps, len(part), walks), np.int32)
        for step in range(steps):
            sym = np.where(at < n, part[rows, np.minimum(at, n - 1)], -1)
            out[step] = sym
            h = mix64((sym + 2).astype(np.uint64) + np.uint64(step << 32))
            at += ((h >> walk) & np.uint64(1)).astype(np.int64)
        place = (where[None] * 2 * n[:, :, None, None]).astype(np.int64)
        got = out[place, rows[:, :, None, None], np.arange(walks)[None, :, None, None]]
        key = np.broadcast_to(np.arange(walks * samples, dtype=np.uint64).reshape(1, walks, samples), got.shape[:3])
        for p in range(picks):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + (got[..., p] + 2).astype(np.uint64))
        keys[i:i + 1024] = key.reshape(len(part), -1)
    return keys


def best_part(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``part`` nearest to the whole item
    (edit distance on words; ties: the earliest end, then the latest start)."""
    m = len(part)
    row, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, sym in enumerate(item, 1):
        new, begin = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        change = row[:-1] + (part != sym)
        drop = row[1:] + 1
        new[0], begin[0] = i, 0
        take = change <= drop
        new[1:], begin[1:] = np.where(take, change, drop), np.where(take, start[:-1], start[1:])
        # an extra word of the text: the running minimum of new - place
        lead = new - np.arange(m + 1)
        low = np.minimum.accumulate(lead)
        src = np.maximum.accumulate(np.where(lead == low, np.arange(m + 1), 0))
        row, start = low + np.arange(m + 1), begin[src]
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


class Items:
    """Search tables of at most ``ITEMS`` items."""

    def __init__(self, rows: list[tuple], edits: float, exact_below: int = EXACT_BELOW):
        seqs = [words_of(t) for _, t in rows]
        often = Counter(w for s in seqs for w in s)
        self.vocab = {w: i + 1 for i, w in enumerate(sorted(often))}
        keep = [(r[0], np.array([self.vocab[w] for w in s], np.int32), s) for r, s in zip(rows, seqs) if s]
        self.ids = [k for k, _, _ in keep]
        self.seqs = [s for _, s, _ in keep]
        self.limit = [0 if len(s) < exact_below else int(edits * len(s)) for s in self.seqs]
        anchors, pieces, self.item, self.offset = defaultdict(list), [], [], []
        for n, (_, seq, ws) in enumerate(keep):
            cuts = np.linspace(0, len(ws), -(-len(ws) // PIECE) + 1).astype(int).tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                limit = self.limit[n] if len(cuts) == 2 else int(edits * (hi - lo))
                rare = sorted(range(lo, hi), key=lambda i: (often[ws[i]], -len(ws[i]), i))[:limit + 1]
                for i in rare:
                    anchors[int(seq[i])].append((len(pieces), i - lo))
                pieces.append(seq[lo:hi])
                self.item.append(n)
                self.offset.append(lo)
        self.item, self.offset = np.array(self.item, np.int64), np.array(self.offset, np.int64)
        self.is_anchor = np.zeros(len(self.vocab) + 1, bool)
        self.is_anchor[list(anchors)] = True
        self.anchors = {a: np.array(v, np.int64) for a, v in anchors.items()}
        self.width = max(map(len, pieces), default=0)
        lengths = np.array([len(s) for s in pieces], np.int64)
        self.lengths = lengths
        padded = np.zeros((len(pieces), self.width), np.int32)
        for i, s in enumerate(pieces):
            padded[i, :len(s)] = s
        self.keys = walk_keys(padded, lengths) if pieces else np.zeros((0, 0), np.uint64)

    def windows(self, symbols: np.ndarray) -> np.ndarray:
        """(piece, start) of every anchored window of one text."""
        at = np.flatnonzero(self.is_anchor[symbols])
        found = [np.stack([self.anchors[int(symbols[p])][:, 0], p - self.anchors[int(symbols[p])][:, 1]], 1) for p in at]
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def candidates(self, symbols: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Those of ``spots`` (piece, start in ``symbols``) that share a key with their
        piece; ``symbols`` has ``width`` zeros around every text."""
        hits = []
        for i in range(0, len(spots), 4096):
            part = spots[i:i + 4096]
            n = self.lengths[part[:, 0]]
            col = np.arange(self.width)[None, :]
            rows = np.where(col < n[:, None], symbols[np.clip(part[:, 1:2] + col, 0, len(symbols) - 1)], 0)
            hits.append((walk_keys(rows, n) == self.keys[part[:, 0]]).any(1))
        return spots[np.concatenate(hits)] if hits else spots


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, exact_below: int = EXACT_BELOW) -> DataFrame:
    """``doc_id, item_id, distance, similarity, first_word, last_word`` (exclusive)
    of the best place of every item in every document that contains it."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select("item_id", "text")
    parts = max(1, -(-items.count() * 5 // (4 * ITEMS)))  # by a hash: room for uneven parts
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type
    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    out = None
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in some], edits, exact_below))

        def run(batches, shared=shared):
            import pyarrow as pa
            known: Items = shared.value
            kinds = None
            for b in batches:
                kinds = b.schema.field(0).type
                for i in range(0, b.num_rows, 500):
                    found = _search(known, b.column(1)[i:i + 500])
                    ids = b.column(0)[i:i + 500]
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array([f[0] for f in found], pa.int64())).cast(kinds),
                        pa.array([known.ids[f[1]] for f in found]).cast(item_kind),
                        pa.array([f[2] for f in found], pa.int32()),
                        pa.array([1 - f[2] / len(known.seqs[f[1]]) for f in found], pa.float64()),
                        pa.array([f[3] for f in found], pa.int32()), pa.array([f[4] for f in found], pa.int32())],
                        names=["doc_id", "item_id", "distance", "similarity", "first_word", "last_word"])
        got = docs.select("doc_id", "text").mapInArrow(
            run, f"doc_id {id_type}, item_id {item_type}, distance int, similarity double, first_word int, last_word int")
        out = got if out is None else out.unionByName(got)
    return out


def _search(known: Items, texts) -> list[tuple]:
    """(row, item, distance, first word, last word) of every hit in a block of texts."""
    pad = np.zeros(known.width + 1, np.int32)
    pieces, offset, spots, owner, base = [pad], [], [], [], len(pad)
    for t in texts:
        ws = words_of(t.as_py())
        symbols = np.fromiter(map(known.vocab.get, ws, repeat(0)), np.int32, len(ws))
        w = known.windows(symbols)
        owner.append(np.full(len(w), len(offset)))
        offset.append((base, len(ws)))
        w[:, 1] += base
        spots.append(w)
        pieces += [symbols, pad]
        base += len(ws) + len(pad)
    if not offset:
        return []
    line = np.concatenate(pieces)
    spots, owner = np.concatenate(spots), np.concatenate(owner)
    all_ = np.concatenate([spots, owner[:, None]], axis=1)
    hits = known.candidates(line, all_)
    # the item and where it would begin: as often as pieces and anchors agree, taken once
    hits = np.unique(np.stack([hits[:, 2], known.item[hits[:, 0]], hits[:, 1] - known.offset[hits[:, 0]]], 1), axis=0)
    best: dict[tuple[int, int], tuple] = {}
    lo = None
    for i, (row, n, start) in enumerate(hits):
        begin, length = offset[row]
        limit, seq = known.limit[n], known.seqs[n]
        lo = max(begin, start - limit) if lo is None else lo
        hi = min(begin + length, start + len(seq) + limit)
        if i + 1 < len(hits) and tuple(hits[i + 1, :2]) == (row, n) and hits[i + 1, 2] - limit <= start + limit:
            continue  # overlapping places are searched as one
        old = best.get((row, n))
        if old is None or old[0]:
            d, a, z = best_part(seq, line[lo:hi])
            if d <= limit and (old is None or d < old[0]):
                best[row, n] = (d, int(lo + a - begin), int(lo + z - begin))
        lo = None
    return [(int(r), int(n), *v) for (r, n), v in sorted(best.items())]


def op5_decontam(spark, sf_dir):
    """Every (document, benchmark item) pair of which the document contains the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents that contain a benchmark item go, each by its own text
    (known by its SHA-256), whatever its id: null ids and repeated ids too. Columns of any name come
    through as they are."""
    boxed = Boxed(docs, "text")
    key = F.sha2(F.col("text").cast("binary"), 256)
    hits = saved(contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
                 .select(F.col("doc_id").alias("text_key")).distinct(), "op5-hits")
    return boxed.open(boxed.docs.join(hits, key == F.col("text_key"), "left_anti"))
