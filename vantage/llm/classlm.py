"""Class-based n-gram scoring (operator 3): Brown classes by exchange clustering.

Tokens are the text's words (white-space separated, A-Z lower-cased) and one end.
Every word has a class; the model gives a known word

    (1 - u) * P(class | two classes before) * count(word) / count(class)

and the event "unknown word" u = 0.1 / (N + 0.1 (V + 1)), its share in the base
model. Class transitions are counts smoothed by the next shorter history
(``STRENGTH`` pseudo-counts), so that the probabilities of the V known words and of the unknown one
sum to 1 after any history.

Clustering. The ``CORE`` most frequent words go through the exchange algorithm proper: each in turn
moves to the class that gives the class bigrams the largest likelihood, until nothing
moves. Then every other word of the vocabulary, of one occurrence or of millions, makes exchange moves
given the others' classes: its neighbours' classes are counted over the whole corpus (a table, one
packed row a word and task, merged by word), and its own row alone decides. The frequent
words (``LEAST`` of the training tokens or more: at most 1 / LEAST of them, the bound of what is
broadcast) move in each of ``ROUNDS`` rounds; the others, whose classes no task could hold, stay in a table
and move in the last round, when all frequent words have classes. Counts are integers and moves are computed
exactly from them, so classes and scores do not depend on how the rows are partitioned.

Scoring. Each (document, rare word) pair meets the word's count and class in one join, the same at every
size; the documents are then written as one byte a token (its class) and a few sums, which is what the
transition counts and the scores are read from.

Bounded, whatever the corpus: ``CORE``, ``CLASSES``, and what is broadcast. A word that is not frequent
gives its neighbours no evidence for their classes (it has a class in the model like any other). A word
without evidence goes to the class of most tokens; an unknown word counts as one of the class that has
most rare words when the words after it are scored. Words are known by 64-bit hashes (two of a billion
words fall together with probability 0.03).

All counts cover all training documents. Defined cases: null and empty texts are one end token;
null ids do not train and are not held out; repeated rows count and are scored each; with nothing to learn
from, every token is unknown and scores log10(1) = 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashCache, ascii_words, crc_mod, flag, saved, ship, table

LEAST, CORE, CLASSES, ROUNDS, STRENGTH = 1e-6, 1000, 32, 2, 50.0
END = b"\n"  # no word holds white space
RARE = -1  # the id of every word that is not frequent
UNKNOWN, OPEN = 255, 254  # class bytes: a word that training never saw; a rare word before the join
TOKENS, HELD = 1 << 18, 1 << 22  # a task counts so many tokens at a time, and holds so many counts
_ENTRY = np.dtype([("side", "u1"), ("n", "<u4")])


def vocabulary(docs: DataFrame) -> DataFrame:
    """``h, c``: every training token (hash) and its count, from ``text`` (binary)."""
    def run(batches):
        import pyarrow as pa
        hashes = HashCache()
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                found = [hashes.array([*ascii_words(t.as_py()), END]) for t in b.column(0)[i:i + 1000]]
                h, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["h", "c"])
    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Lexicon:
    """Ids of the frequent tokens: 0 the end, then words by falling count (ties by hash)."""

    def __init__(self, frequent: list[tuple[int, int]]):
        end = HashCache()[END]
        rows = sorted(((c, h) for h, c in frequent if h % (1 << 64) != end), reverse=True)
        self.hashes = np.array([end, *(r[1] % (1 << 64) for r in rows)], np.uint64)  # by id
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.words = len(self.hashes)
        counts = {h % (1 << 64): c for h, c in frequent}
        self.counts = np.array([counts.get(h, 0) for h in self.hashes.tolist()], np.float64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, h), self.words - 1)
        return np.where(self.sorted[at] == h, self.order[at], RARE).astype(np.int32)


def encode(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``row, doc_id, held_out, ids, rare``: int32 ids, and the hashes of the rare tokens in order."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        hashes, lex = HashCache(), shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                ids, rare = [], []
                for t in b.column(2)[i:i + 1000]:
                    h = hashes.array([*ascii_words(t.as_py()), END])
                    n = lex.ids(h)
                    ids.append(n.tobytes())
                    rare.append(h[n == RARE].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:i + 1000], b.column(1)[i:i + 1000], pa.array(ids, pa.binary()),
                     pa.array(rare, pa.binary())], names=["doc_id", "held_out", "ids", "rare"])
    coded = docs.mapInArrow(run, f"doc_id {id_type}, held_out boolean, ids binary, rare binary")
    return saved(coded.withColumn("row", F.monotonically_increasing_id()), "op3-encoded", "zstd")


def _flat(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one after another, and how many each row has."""
    import pyarrow as pa
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if pa.types.is_large_binary(column.type) else np.int32) if at else np.zeros(1, np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(at) or at[0] == at[-1]:
        return np.zeros(0, dtype), np.zeros(len(column), np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(dtype), np.diff(at) // np.dtype(dtype).itemsize


def _line(column, dtype=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block one after another, and where each document begins."""
    line, n = _flat(column, dtype)
    return line, np.cumsum(n) - n


def _blocks(batch, dtype=np.int32):
    """Slices of a batch, whole documents each, of about ``TOKENS`` ids of its first column (one document at least)."""
    _, starts = _line(batch.column(0), dtype)
    cuts = [*np.flatnonzero(np.diff(starts // TOKENS, prepend=-1)).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def _before(line: np.ndarray, starts: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The value one and two places before each token; before a document: ends."""
    one, two = np.empty_like(line), np.empty_like(line)
    one[1:], two[2:] = line[:-1], line[:-2]
    one[starts] = end
    two[:1] = end
    two[starts] = end
    inside = starts[starts + 1 < len(line)] + 1
    two[inside] = end
    return one, two


def _tally(coded: DataFrame, keys, size: int, column: str = "ids", dtype=np.int32) -> np.ndarray:
    """Sums by key over all training documents; ``keys(line, starts)`` gives a block's keys,
    all below ``size``, so what comes to the driver is bounded."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for part in _blocks(b, dtype):
                k, n = np.unique(keys(*_line(part.column(0), dtype)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])
    got = coded.where("NOT held_out").select(column).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    got, out = got.toPandas(), np.zeros(size)
    out[got["key"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, rounds: int = 30) -> np.ndarray:
    """Exchange clustering of words 1.. of a bigram count matrix (row before column);
    word 0, the end, has the last class for itself."""
    n, k = len(pairs), classes
    cls = np.arange(n) % (k - 1)
    cls[0] = k - 1
    c = pairs.astype(np.float64)
    one = np.zeros((n, k))
    one[np.arange(n), cls] = 1
    right, left = c @ one, c.T @ one  # by word: what follows, what precedes, by class
    g = one.T @ c @ one
    for _ in range(rounds):
        moved = 0
        for w in range(1, n):
            a, own = cls[w], c[w, w]
            r, lft = right[w].copy(), left[w].copy()
            r[a] -= own
            lft[a] -= own
            g[a, :] -= r
            g[:, a] -= lft
            g[a, a] -= own
            f = _xlogx(g)
            by_row = (_xlogx(g + r[None, :]) - f).sum(1)
            by_col = (_xlogx(g + lft[:, None]) - f).sum(0)
            d = np.arange(k)
            diag = np.diag(g)
            gain = by_row - (_xlogx(diag + r) - np.diag(f)) + by_col - (_xlogx(diag + lft) - np.diag(f))
            gain += _xlogx(diag + r + lft + own) - np.diag(f)
            rows, cols = g.sum(1), g.sum(0)
            gain -= _xlogx(rows + r.sum() + own) - _xlogx(rows) + _xlogx(cols + lft.sum() + own) - _xlogx(cols)
            gain[k - 1] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            g[b, :] += r
            g[:, b] += lft
            g[b, b] += own
            if b != a:
                moved += 1
                cls[w] = b
                right[:, a] -= c[:, w]
                right[:, b] += c[:, w]
                left[:, a] -= c[w]
                left[:, b] += c[w]
        if not moved:
            break
    return cls


def _fits(pairs: np.ndarray) -> np.ndarray:
    """What a neighbour of each class says for each class of a word, by class bigram counts: first the neighbours
    before it, then those after it. In whole units of 2 ** -20, so that sums of them are exact in any order."""
    k = len(pairs)
    into = np.log(pairs + 0.5) - np.log(pairs.sum(1) + 0.5 * k)[:, None]  # P(c | before)
    out = into - np.log(pairs.sum(0) + 0.5 * k)[:, None]  # P(after | c), and 1 / count(c)
    return np.rint(np.vstack([into, out.T]) * (1 << 20))


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def _summed(parts: list[tuple[np.ndarray, ...]], k: int):
    """One entry ``h, side, n`` for each word and side of ``parts``, by h and side as each of them is: an eighth of
    the words after the other."""
    for lo in range(8):
        some = []
        for h, side, n in parts:
            i, j = np.searchsorted(h, np.uint64(lo << 61)), (np.searchsorted(h, np.uint64(lo + 1 << 61)) if lo < 7 else len(h))
            some.append((h[i:j], side[i:j], n[i:j]))
        h, side, n = map(np.concatenate, zip(*some))
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")  # merges sorted runs
        h = h[order]
        key = np.cumsum(np.append(False, h[1:] != h[:-1])) * (2 * k) + side[order]
        inner = np.argsort(key, kind="stable")
        first = _starts(key[inner])
        yield h[inner[first]], side[order[inner[first]]], np.add.reduceat(n[order[inner]], first)


def neighbours(coded: DataFrame, cls: np.ndarray, lexicon: Lexicon, k: int, core: int, rare: bool) -> DataFrame:
    """``h, counts``: packed counts of the classes before (side 0 to k-1) and after (k to 2k-1) the frequent
    words from id ``core`` on, and with ``rare`` also the rare words; a row for each block and word."""
    shared = coded.sparkSession.sparkContext.broadcast((cls, lexicon.hashes))

    def counted(part):
        """``h, side, n`` of a few documents, by h and side."""
        cls, hashes = shared.value
        line, starts = _line(part.column(0))
        c = np.where(line >= 0, cls[line], -1)
        before, _ = _before(c, starts, k - 1)
        after = np.full(len(c), k - 1, c.dtype)
        after[:-1] = c[1:]
        after[starts[1:] - 1] = k - 1
        h = hashes[line]
        if rare:
            h[line < 0], _ = _line(part.column(1), np.uint64)
        mine = (line >= core) | (rare & (line < 0))
        at = [np.flatnonzero(mine & (x >= 0)) for x in (before, after)]
        words, back = np.unique(np.concatenate([h[i] for i in at]), return_inverse=True)
        sides = np.concatenate([before[at[0]], after[at[1]] + k])
        key, n = np.unique(back * (2 * k) + sides, return_counts=True)
        return words[key // (2 * k)], (key % (2 * k)).astype(np.uint8), n.astype(np.uint32)

    def batch(h, side, n):
        import pyarrow as pa
        first = _starts(h)
        packed = np.empty(len(h), _ENTRY)
        packed["side"], packed["n"] = side, n
        ends = (np.append(first, len(h)) * _ENTRY.itemsize).astype(np.int32)
        counts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), counts], names=["h", "counts"])

    def run(batches):
        for b in batches:
            held = []
            for part in _blocks(b):
                held.append(counted(part))
                if sum(len(x[0]) for x in held) > HELD:
                    held = list(_summed(held, k))
                    if sum(len(x[0]) for x in held) > HELD // 2:
                        yield from (batch(*x) for x in held)
                        held = []
            if held:
                yield from (batch(*x) for x in _summed(held, k))
    return coded.where("NOT held_out").select("ids", "rare").mapInArrow(run, "h long, counts binary")


def place(rows: DataFrame, pairs: np.ndarray, default: int) -> DataFrame:
    """``h, cls``: one exchange move of every word of ``rows`` (``neighbours``), each by its own counts over the
    whole corpus. Ties go to the smaller class."""
    k = len(pairs)
    shared = rows.sparkSession.sparkContext.broadcast(_fits(pairs))

    def moves(words, side, n):
        """Classes of 0.. by (word, side, n) entries, a thousand words at a time."""
        fits, won = shared.value, []
        for lo in range(0, int(words[-1]) + 1 if len(words) else 0, 1000):
            i, j = np.searchsorted(words, (lo, lo + 1000))
            size = min(1000, int(words[-1]) + 1 - lo)
            own = np.bincount((words[i:j] - lo) * (2 * k) + side[i:j], n[i:j], size * 2 * k).reshape(size, 2 * k)
            fit = own @ fits  # whole numbers far below 2 ** 53: exact
            fit[:, k - 1] = -np.inf  # the end's own
            won.append(np.where(own.any(1), fit.argmax(1), default))
        return np.concatenate(won) if won else np.zeros(0, np.int64)

    def run(batches):
        import pyarrow as pa
        held_h, held = np.zeros(0, np.int64), np.zeros(0, _ENTRY)  # the last word: its rows may go on

        def batch(h, entries_h, entries):
            words = np.searchsorted(h, entries_h)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(moves(words, entries["side"], entries["n"].astype(np.float64)), pa.int32())],
                                              names=["h", "cls"])
        for b in batches:
            entries, n = _flat(b.column(1), _ENTRY)
            h, entries = np.concatenate([held_h, np.repeat(b.column(0).to_numpy(), n)]), np.concatenate([held, entries])
            if not len(h):
                continue
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield batch(np.unique(h[:cut]), h[:cut], entries[:cut])
            held_h, held = _merged(h[cut:], entries[cut:], k)
        if len(held_h):
            yield batch(held_h[:1], held_h, held)
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, cls int")


def _merged(h: np.ndarray, entries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of one word summed by side, so that a word's rows take no more room than one (counts beyond
    32 bits stay entries of their own)."""
    if len(h) <= 4 * k:
        return h, entries
    sums = np.bincount(entries["side"], entries["n"].astype(np.float64), 2 * k)
    out = []
    for side in np.flatnonzero(sums):
        left = int(sums[side])
        while left:
            out.append((side, min(left, (1 << 32) - 1)))
            left -= out[-1][1]
    return np.full(len(out), h[0]), np.array(out, _ENTRY)


def _pairs(coded: DataFrame, cls: np.ndarray, k: int) -> np.ndarray:
    """Class bigram counts over all training documents; tokens without a class are left out."""
    shared = coded.sparkSession.sparkContext.broadcast(cls)

    def keys(line, starts):
        c = np.where(line >= 0, shared.value[line], -1).astype(np.int64)
        one, _ = _before(c, starts, k - 1)
        return (one * k + c)[(c >= 0) & (one >= 0)]
    return _tally(coded, keys, k * k).reshape(k, k)


def cluster(coded: DataFrame, lexicon: Lexicon, vocab: DataFrame, classes: int = CLASSES, core: int = CORE,
            rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """Classes of the frequent words by id, and ``h, c, cls`` of all other words of ``vocab`` (a table)."""
    core = min(core, lexicon.words)

    def near(line, starts):
        one, _ = _before(line, starts, 0)
        ok = (line >= 0) & (line < core) & (one >= 0) & (one < core)
        return one[ok].astype(np.int64) * core + line[ok]
    cls = np.full(lexicon.words, -1, np.int32)
    cls[:core] = exchange(_tally(coded, near, core * core).reshape(core, core), classes)
    for left in range(rounds, 0, -1):
        pairs = _pairs(coded, cls, classes)
        default = int(np.argmax(np.append(pairs.sum(0)[:-1], -1)))
        moved = saved(place(neighbours(coded, cls, lexicon, classes, core, rare=left == 1), pairs, default), "op3-classes")
        frequent = moved.join(F.broadcast(_as_table(coded, lexicon, core)), "h").select("h", "cls").toPandas()  # 1 / LEAST at most
        cls = cls.copy()
        cls[lexicon.ids(frequent["h"].to_numpy(np.int64).view(np.uint64))] = frequent["cls"].to_numpy(np.int32)
    cls[cls < 0] = default  # frequent words without a frequent neighbour
    others = vocab.join(F.broadcast(_as_table(coded, lexicon, 0)), "h", "left_anti")
    rare = others.join(moved, "h", "left").select("h", "c", F.coalesce("cls", F.lit(default)).cast("int").alias("cls"))
    return cls, saved(rare, "op3-words")


def _as_table(coded: DataFrame, lexicon: Lexicon, start: int) -> DataFrame:
    """``h`` of the frequent words from id ``start`` on."""
    import pandas as pd
    return coded.sparkSession.createDataFrame(pd.DataFrame({"h": lexicon.hashes[start:].view(np.int64)}), "h long")


def classed(coded: DataFrame, lexicon: Lexicon, cls: np.ndarray, rare: DataFrame, whole: float) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, emit, classes`` of every row of ``coded``: a class byte for
    each token (``UNKNOWN`` for a word that training never saw), and the sum of log10 counts of the known ones."""
    shared = coded.sparkSession.sparkContext.broadcast((cls, lexicon.counts))
    id_type = coded.schema["doc_id"].dataType.simpleString()
    sums = "n_tokens long, n_known long, base_score double, emit double"

    def frequent(batches):
        import pyarrow as pa
        cls, counts = shared.value
        seen = counts > 0
        base, emit = np.log10((counts + 0.1) / whole), np.log10(np.maximum(counts, 1))
        kinds = np.where(seen, cls, UNKNOWN).astype(np.uint8)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                line, starts = _line(part.column(3))
                known = line >= 0
                c = np.where(known, kinds[line], OPEN).astype(np.uint8)
                n = np.diff(np.append(starts, len(line)))
                found = [np.add.reduceat(np.where(known, x[line], 0), starts) for x in (seen.astype(np.int64), base, emit)]
                ends = np.append(0, np.cumsum(n)).tolist()
                raw = c.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), *map(pa.array, found),
                     pa.array([raw[i:j] for i, j in zip(ends, ends[1:])], pa.binary()), part.column(4)],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "emit", "classes", "rare"])

    def each(batches):
        import pyarrow as pa
        for b in batches:
            hs = [np.unique(np.frombuffer(x.as_buffer(), np.int64)) for x in b.column(1)]
            n = np.array([len(h) for h in hs], np.int64)
            if n.sum():
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))),
                                                  pa.array(np.concatenate(hs))], names=["row", "h"])

    def put(batches):
        import pyarrow as pa
        for b in batches:
            known, base, emit, classes = (b.column(j).to_pylist() for j in (3, 4, 5, 6))
            for i, (raw, found) in enumerate(zip(b.column(7), b.column(8))):
                raw = np.frombuffer(raw.as_buffer(), np.int64)
                if not len(raw):
                    continue
                count, kind = np.zeros(len(raw)), np.full(len(raw), UNKNOWN, np.uint8)
                if found.is_valid:
                    h, c, of = (found.values.field(j).to_numpy(zero_copy_only=False) for j in (0, 1, 2))
                    order = np.argsort(h)
                    at = np.minimum(np.searchsorted(h[order], raw), len(h) - 1)
                    own = h[order][at] == raw
                    count[own], kind[own] = c[order][at[own]], of[order][at[own]]
                line = np.frombuffer(classes[i], np.uint8).copy()
                line[line == OPEN] = kind
                known[i] += int((count > 0).sum())
                base[i] += float(np.log10((count + 0.1) / whole).sum())
                emit[i] += float(np.log10(np.maximum(count, 1)).sum())
                classes[i] = line.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(emit, pa.float64()), pa.array(classes, pa.binary())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emit", "classes"])
    found = (coded.where("length(rare) > 0").select("row", "rare").mapInArrow(each, "row long, h long")
             .join(rare, "h").groupBy("row").agg(F.collect_list(F.struct("h", "c", "cls")).alias("found")))  # words of one document
    docs = coded.select("row", "doc_id", "held_out", "ids", "rare").mapInArrow(
        frequent, f"row long, doc_id {id_type}, held_out boolean, {sums}, classes binary, rare binary")
    both = docs.join(found, "row", "left").select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "emit", "classes", "rare", "found")
    return saved(both.mapInArrow(put, f"doc_id {id_type}, held_out boolean, {sums}, classes binary"), "op3-classed", "zstd")


class Model:
    """Log10 transition table by the two classes before, with each class's share for one of its tokens."""

    def __init__(self, tri: np.ndarray, total: int, distinct: int, unknown_class: int):
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = uni / max(1.0, uni.sum())
        p2 = (bi + STRENGTH * p1) / (bi.sum(1, keepdims=True) + STRENGTH)
        p3 = (tri + STRENGTH * p2) / (tri.sum(2, keepdims=True) + STRENGTH)
        self.k, self.unknown_class = len(tri), unknown_class
        self.unknown = 0.1 / (total + 0.1 * (distinct + 1))
        with np.errstate(divide="ignore"):
            # within a class a word has its share of the class's tokens
            self.step = np.log10(p3) + np.log10(1 - self.unknown if total else 1.0) - np.log10(np.maximum(uni, 1))
        self.log_unknown = float(np.log10(self.unknown))


def transitions(docs: DataFrame, k: int) -> np.ndarray:
    """Class trigram counts over all training documents of ``classed``."""
    def keys(line, starts):
        c = line.astype(np.int64)
        one, two = _before(c, starts, k - 1)
        return (two * k + one) * k + c
    return _tally(docs, keys, k ** 3, "classes", np.uint8).reshape(k, k, k)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``classed``) with ``score`` in place of ``emit`` and ``classes``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                line, starts = _line(part.column(6), np.uint8)
                known = line != UNKNOWN
                c = np.where(known, line, m.unknown_class).astype(np.int64)
                one, two = _before(c, starts, m.k - 1)
                steps = np.add.reduceat(np.where(known, m.step[two, one, c], m.log_unknown), starts)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(steps + part.column(5).to_numpy())], names=names)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:5]) + ", score double"
    return docs.mapInArrow(run, schema)


def score_texts(docs: DataFrame, train_where, least: float = LEAST, classes: int = CLASSES, **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens`` of every row of ``docs``
    (doc_id, text) by a model of the rows that ``train_where`` (a boolean column) selects."""
    if classes >= OPEN:
        raise ValueError(f"fewer than {OPEN} classes: a class is a byte")
    ship(docs.sparkSession)
    docs = docs.select("doc_id", (~flag(train_where)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    vocab = saved(vocabulary(docs.where("NOT held_out")), "op3-vocabulary")
    sums = vocab.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums.n or 0), int(sums.v)
    end = int(np.array([HashCache()[END]], np.uint64).view(np.int64)[0])  # is clustered however rare it is
    frequent = vocab.where((F.col("c") >= least * total) | (F.col("h") == end)).toPandas()  # 1 / least + 1 at most
    lexicon = Lexicon(list(zip(frequent["h"].tolist(), frequent["c"].tolist())))
    coded = encode(docs, lexicon)
    if total:
        cls, rare = cluster(coded, lexicon, vocab, classes, **options)
    else:
        cls, rare = np.zeros(lexicon.words, np.int32), vocab.withColumn("cls", F.lit(0))
    lined = classed(coded, lexicon, cls, rare, total + 0.1 * (distinct + 1))
    tri = transitions(lined, classes) if total else np.ones((classes,) * 3)
    most = rare.groupBy("cls").count().orderBy(F.desc("count"), "cls").first()  # of ``classes`` rows
    scored = score(lined, Model(tri, total, distinct, int(most.cls) if most else 0))
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def op3_classlm(spark, sf_dir):
    """Base and model log10 probability of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_texts(docs, crc_mod("doc_id", 10) != 0)
    return got.select("doc_id", flag(crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")
