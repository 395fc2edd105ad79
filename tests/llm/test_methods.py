"""The methods against brute-force versions, planted cases and round trips."""

import base64
import gzip
import math
import random
import tracemalloc
import urllib.parse
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from vantage.llm import ann, classlm, decontam, mixing, neardup, resample, secrets, spelling, tokens, urls, warc
from vantage.llm.components import components
from vantage.llm.queries import QUERIES

WORDS = [f"w{i}" for i in range(400)]


def jaccard(a, b, size=3):
    def sets(t):
        w = t.encode().lower().split()
        return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    x, y = sets(a), sets(b)
    return 100 * len(x & y) >= 85 * len(x | y) if x and y else False


def brute_components(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(3)
    base = [" ".join(r.choices(WORDS, k=r.choice([3, 20, 80, 300]))) for _ in range(12)]
    texts = list(base)
    for _ in range(150):  # chains of edits: links that only meet through others
        w = r.choice(texts).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_set_sketch_never_drops_a_link():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 2**63, 400).astype(np.uint64)
        b = np.concatenate([a[int(r.integers(0, 60)):], r.integers(0, 2**63, int(r.integers(0, 60))).astype(np.uint64)])
        differ = len(np.setxor1d(a, b))
        bits = np.bitwise_count(neardup.parity(a, 16) ^ neardup.parity(b, 16)).sum()
        assert bits <= differ


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 400)] + [(400, 399), (900, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in range(200, 401)}}


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_decontamination_recall(spark, share):
    r = random.Random(int(share * 10))
    items = [(i, " ".join(r.choices(WORDS, k=r.randint(12, 60)))) for i in range(40)]
    docs = []
    for i, t in items:
        w = t.split()
        for _ in range(int(share * len(w))):
            k = r.randrange(len(w))
            kind = r.randrange(3)
            w[k:k + 1] = [r.choice(WORDS)] if kind == 0 else [] if kind == 1 and len(w) > 3 else [w[k], r.choice(WORDS)]
        noise = [r.choices(WORDS, k=r.randint(0, 200)) for _ in range(2)]
        docs.append((i, " ".join(noise[0]) + ". " + " ".join(w).upper() + "! " + " ".join(noise[1])))
    docs += [(1000 + i, " ".join(r.choices(WORDS, k=300))) for i in range(40)]
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in items}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


def test_best_part_is_exact():
    r = np.random.default_rng(2)
    for _ in range(100):
        a, b = r.integers(0, 4, r.integers(1, 8)), r.integers(0, 4, r.integers(0, 10))
        d, lo, hi = decontam.best_part(a, b)
        assert d == min(edit(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert d == edit(a, b[lo:hi])


SECRET = 'password = "hunter2hunter2"'


def test_decoded_layers():
    for wrap in (lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
                 lambda s: base64.b64encode(s.encode()).decode(),
                 lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
                 lambda s: base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(),
                 lambda s: base64.b64encode(urllib.parse.quote(base64.b64encode(s.encode()).decode(), safe="").encode()).decode()):
        inner = wrap(SECRET)
        text = f"Thé text {inner} and more"
        base, spans = secrets.find(text)
        assert base == [] and len(spans) == 1 and spans[0][2] == "assign", inner
        lo, hi, _ = spans[0]
        assert text.index(inner) <= lo < hi <= text.index(inner) + len(inner)
    url = "x " + urllib.parse.quote(SECRET, safe="")
    lo, hi, _ = secrets.find(url)[1][0]
    assert urllib.parse.unquote(url[lo:hi]) == SECRET[:-1]  # the mapped span is the secret's own
    assert secrets.find("%25" * 50 + "41")[1] == []  # unwraps to a fixpoint and stops
    base, spans = secrets.find(SECRET + " " + "a" * 30 + " AKIA" + "B" * 16)
    assert base == spans and [k for _, _, k in base] == ["assign", "hex", "access"]


def test_propagation(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.org/fr/", '<a href="http://good.com/">'), (2, "http://good.com/", ""),
         (3, "http://bad.com/", "<a href='//evil.net/x'>"), (4, "http://evil.net/", ""), (5, "http://plain.com/", "")],
        "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow"}
    links = urls.host_links(pages).select("src", "dst", "n").collect()
    assert sorted(map(tuple, links)) == [("a.org", "good.com", 1), ("bad.com", "evil.net", 1)]


def test_class_model_beats_the_base(spark):
    r = random.Random(4)
    texts = [" ".join(r.choices(WORDS[:40] if i % 2 else WORDS[40:80], k=50)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = classlm.score_texts(docs, F.col("doc_id") < 150).collect()
    held = [x for x in got if x.held_out]
    assert len(held) == 50 and sum(x.score for x in held) > sum(x.base_score for x in held) + 0.2 * 50 * 50


def test_class_model_sums_to_one():
    r = np.random.default_rng(3)
    cls = np.array([3, 0, 0, 1, 1, 1, 2, 2])
    line = r.integers(0, 8, 500)
    counts = np.bincount(line, minlength=8).astype(float)
    c = cls[np.concatenate([[0, 0], line])]
    tri = np.zeros((4, 4, 4))
    np.add.at(tri, (c[:-2], c[1:-1], c[2:]), 1)
    model = classlm.Model(tri, 500, 8, 0)
    for two in range(4):
        for one in range(4):
            p = 10 ** (model.step[two, one, cls] + np.log10(counts))
            assert abs(p.sum() + model.unknown - 1) < 1e-9


def test_exchange_finds_the_classes():
    r = np.random.default_rng(0)
    n = 41
    pairs = np.zeros((n, n))
    for _ in range(20_000):
        half = r.integers(0, 2)
        a, b = r.integers(1, 21, 2) + 20 * half
        pairs[a, b] += 1
    cls = classlm.exchange(pairs, 3)
    assert len(set(cls[1:21])) == 1 and len(set(cls[21:])) == 1 and cls[1] != cls[21] and cls[0] == 2


def test_mixing_meets_its_targets(spark):
    rows = [(i, "big" if i < 900 else f"s{i % 5}", "word " * (5 + i % 7)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for limit in (1.0, 1.5, 3.0):
        got = mixing.mix(docs, max_repeats=limit, block_docs=20)
        tokens_ = {r.source: (r.t, r.docs, r.w) for r in got.groupBy("source").agg(
            F.sum("__n").alias("t"), F.countDistinct("doc_id").alias("docs"), F.first("__w").alias("w")).collect()}
        assert sum(d for _, d, _ in tokens_.values()) == 1000  # every document once at least
        own = {r.source: r.t for r in mixing.mix(docs, max_repeats=1.0).groupBy("source").agg(F.sum("__n").alias("t")).collect()}
        for s, (t, _, w) in tokens_.items():
            assert t <= limit * own[s] + 20
            assert abs(t / sum(x for x, _, _ in tokens_.values()) - w) < 0.01
    few = mixing.mix(docs, budget=2000, block_docs=20).agg(F.sum("__n")).first()[0]
    assert 2000 <= few <= 2000 + 7 * 15


def test_encoder_equals_the_tokenizer():
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert enc.plain
    r = random.Random(1)
    signs = list("abcXYZ019'’!?.,%<|>endoftext éÉßÜÿ×÷́ \n\t \x0b\x1c\x85ſKΣσİǅ你好🙂\xadªµ'sll re ve")
    texts = ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "it's THE'LL we've'd ''s 's'S", "", None]
    want = [np.array(c.ids + [1], enc.dtype).tobytes()
            for c in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert enc(texts) == want and enc(texts) == want


def test_encoder_in_runs_with_emptied_store():
    import pyarrow as pa
    enc = tokens.Encoder(tokens.tokenizer_path())
    enc.CHUNK, enc.LIMIT, enc.JOINED = 200, 5, 7
    r = random.Random(2)
    texts = [None, "", "one", " ", "x" * 900, *(" ".join("".join(r.choices("abcdé,.'s", k=5)) for _ in range(r.randint(0, 40)))
                                               for _ in range(200))]
    column = pa.array(["cut off", *texts], pa.string()).slice(1)
    runs = list(enc.runs(column))
    assert [i for i, _ in runs] + [len(texts)] == [0] + [i + k for i, k in runs] and len(runs) > 50
    want = [np.array(c.ids + [1], enc.dtype).tobytes()
            for c in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x for i, k in runs for x in enc(column.slice(i, k))] == want
    assert list(enc.runs(column.slice(0, 0))) == [] and enc([]) == []


def test_token_files_give_single_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    from vantage.llm.common import qualified
    from vantage.session import shared_path
    folder = qualified(spark, shared_path(spark, "shards"))
    manifest = tokens.write_shards(docs, folder, tokens.tokenizer_path()).collect()
    enc = tokens.Encoder(tokens.tokenizer_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = 0
    for row in manifest:
        shard = tokens.Shard(row.path, enc.dtype)
        for i in reversed(range(len(shard.length))):
            seen += 1
            doc = shard.index["doc_id"][i].as_py()
            assert shard.ids(i).astype(enc.dtype).tobytes() == enc([texts[doc]])[0]
    assert seen == len(texts)


def test_graph_recall():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 16)).astype(np.float32) * r.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    lifted = ann.lift(x, float(np.sqrt((x.astype(float) ** 2).sum(1).max())))
    links, entry = ann.build(lifted)
    q = np.concatenate([x[:200], np.zeros((200, 1), np.float32)], 1)
    found, _ = ann.beam_search(lifted, links, q, entry, ann.BEAM)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(f[:20]) & set(b)) / 20 for f, b in zip(found, best)]) > 0.95


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op8_langid"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op1_quality"](spark, SF).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in got if r.quality == k] for k in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.95


def test_class_model_gives_words_under_the_broadcast_share_their_own_class(spark):
    r = random.Random(11)
    nouns, verbs = ([c + x for x in "abcd" for _ in range(10)] + [f"{c}{i}xx" for i in range(40)] for c in "nv")
    texts = [" ".join(f"the {r.choice(nouns)} to {r.choice(verbs)}" for _ in range(10)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    many, few = (np.mean([x.score for x in classlm.score_texts(docs, F.col("doc_id") < 500, least, classes=8).collect()
                          if x.held_out]) / 41 for least in (1e-6, 0.01))
    assert many > -0.8 and abs(many - few) < 0.02  # the words in "xx" end alike, but half follow "the" and half "to"


def lm_docs(spark, n=400):
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(300)], k=r.randint(0, 60))) + f" only{i}" * (i % 3 == 0)
             for i in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_class_model_does_not_depend_on_the_partitions(spark):
    texts, docs = lm_docs(spark)
    runs = []
    for parts in (1, 2, 40):
        got = classlm.score_texts(docs.repartition(parts), F.col("doc_id") % 4 != 0, 0.004, core=20, classes=8).collect()
        runs.append({x.doc_id: x for x in got})
    for other in runs[1:]:
        assert other.keys() == runs[0].keys()
        assert all(abs(x.score - runs[0][i].score) < 1e-9 and abs(x.base_score - runs[0][i].base_score) < 1e-9
                   and x[2:4] == runs[0][i][2:4] for i, x in other.items())


def test_class_model_counts_match_plain_python(spark):
    texts, docs = lm_docs(spark)
    train = Counter(w for i, t in enumerate(texts) if i % 4 for w in [*t.lower().split(), None])
    total, distinct = sum(train.values()), len(train)
    for x in classlm.score_texts(docs, F.col("doc_id") % 4 != 0, 0.004, core=20, classes=8).collect():
        line = [*texts[x.doc_id].lower().split(), None]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in line)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(line), sum(w in train for w in line), total)
        assert abs(x.base_score - base) < 1e-6


def test_moves_match_a_brute_force_count(spark):
    """Every word beyond the core, frequent and rare, goes where its own neighbours' classes fit best."""
    texts, docs = lm_docs(spark)
    docs = docs.select("doc_id", F.lit(False).alias("held_out"), F.col("text").cast("binary").alias("text"))
    classlm.ship(spark)
    vocab = classlm.vocabulary(docs)
    hashes, counts = classlm.HashCache(), Counter(w for t in texts for w in t.split())
    frequent = [w for w, c in counts.items() if c >= 40]
    end = classlm.END
    lex = classlm.Lexicon([(hashes[w.encode()], counts[w]) for w in frequent] + [(hashes[end], len(texts))])
    coded = classlm.encode(docs, lex)
    k, core = 6, 15
    name = {int(h): w for w in [*counts, end.decode()] for h in [hashes[w.encode()]]}
    ids = {name[int(h)]: i for i, h in enumerate(lex.hashes)}
    cls = np.array([k - 1, *(i % (k - 1) for i in range(1, lex.words))], np.int32)
    pairs, near = np.zeros((k, k)), {}
    for t in texts:
        line = [end.decode(), *t.split(), end.decode()]
        c = [int(cls[ids[w]]) if w in ids else -1 for w in line]
        for i in range(1, len(line)):
            if c[i - 1] >= 0 and c[i] >= 0:
                pairs[c[i - 1], c[i]] += 1
            if line[i] != end.decode() and not (line[i] in ids and ids[line[i]] < core):
                row = near.setdefault(line[i], np.zeros(2 * k))
                if c[i - 1] >= 0:
                    row[c[i - 1]] += 1
                if c[i + 1] >= 0:
                    row[k + c[i + 1]] += 1
    assert (classlm._pairs(coded, cls, k) == pairs).all()
    fits = classlm._fits(pairs)
    want = {w: int((row @ fits)[:k - 1].argmax()) for w, row in near.items() if row.any()}
    got = classlm.place(classlm.neighbours(coded.repartition(7), cls, lex, k, core, True), pairs, 0).collect()
    assert {name[r.h % (1 << 64)]: r.cls for r in got} == want
    assert vocab.count() == len(counts) + 1


class Caught:
    """Stands in for a table: ``run`` is what its tasks would run."""

    sparkSession = sparkContext = property(lambda self: self)
    broadcast = staticmethod(lambda value: SimpleNamespace(value=value))
    where = select = groupBy = agg = lambda self, *_: self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def toPandas(self):
        return pd.DataFrame({"key": [], "n": []})


def coded_batch(docs, length, words=3000, seed=5):
    """A batch as ``encode`` makes it, of ``words`` frequent words and as many rare ones, and its lexicon."""
    r = np.random.default_rng(seed)
    lex = classlm.Lexicon([(int(h), 9) for h in r.integers(1, 1 << 63, words - 1)])
    ids = [np.append(np.where(x < lex.words, x, classlm.RARE), 0).astype(np.int32) for x in r.integers(1, 2 * words, (docs, length))]
    rare = [(r.integers(1, words, int((x < 0).sum())).astype(np.uint64) << np.uint64(51)).tobytes() for x in ids]
    return lex, pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(rare, pa.binary())],
                                           names=["ids", "rare"])


def test_class_model_counts_a_large_batch_in_bounded_room(spark):
    """Room goes with ``TOKENS`` and the counts, not with the tokens of an Arrow batch."""
    lex, batch = coded_batch(3000, 500)
    k, size = 8, 1000
    cls = (np.arange(lex.words) % (k - 1)).astype(np.int32)
    near, pairs = Caught(), Caught()
    classlm.neighbours(near, cls, lex, k, size, True)
    classlm._pairs(pairs, cls, k)
    for table, most in ((near, 60e6), (pairs, 30e6)):
        tracemalloc.start()
        assert sum(b.num_rows for b in table.run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


def test_class_model_sums_counts_of_blocks(monkeypatch):
    """Small blocks and rooms give the counts of a plain walk over the tokens."""
    lex, batch = coded_batch(60, 40, words=50)
    k, core = 8, 10
    cls = np.append(np.arange(lex.words - 1) % (k - 1), -1).astype(np.int32)
    cls[0] = k - 1
    want = Counter()
    for x, rare in zip(batch.column(0), batch.column(1)):
        ids, left = np.frombuffer(x.as_py(), np.int32).tolist(), iter(np.frombuffer(rare.as_py(), np.uint64).tolist())
        c = [k - 1, *(int(cls[i]) if i >= 0 else -1 for i in ids), k - 1]
        for at, i in enumerate(ids):
            h = int(lex.hashes[i]) if i >= 0 else next(left)
            if i < 0 or i >= core:
                want.update([(h, c[at])] * (c[at] >= 0) + [(h, k + c[at + 2])] * (c[at + 2] >= 0))
    for most, held in ((1, 1), (50, 300), (500, 4000), (1 << 18, 1 << 22)):
        monkeypatch.setattr(classlm, "TOKENS", most)
        monkeypatch.setattr(classlm, "HELD", held)
        table, got = Caught(), Counter()
        classlm.neighbours(table, cls, lex, k, core, True)
        for b in table.run([batch.slice(0, 7), batch.slice(7), batch.slice(0, 0)]):
            for h, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got.update({(h % (1 << 64), int(e["side"])): int(e["n"]) for e in np.frombuffer(counts, classlm._ENTRY)})
        assert got == want


@pytest.mark.parametrize("length", [250, 500, 1000])
def test_long_items_at_the_limit_are_found(spark, length):
    r = random.Random(length)
    items, docs = [], []
    for i in range(20):
        w = [f"i{i}x{k}" for k in range(length)]
        items.append((i, " ".join(w)))
        for k in sorted(r.sample(range(length), length // 5), reverse=True):  # one edit a word: the limit exactly
            kind = r.randrange(3)
            w[k:k + 1] = [r.choice(WORDS)] if kind == 0 else [] if kind == 1 else [w[k], r.choice(WORDS)]
        docs.append((i, " ".join(r.choices(WORDS, k=50) + w + r.choices(WORDS, k=50))))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, i) for i, _ in items} and all(x.distance <= length // 5 for x in got)


def hidden(text, inner):
    """The scan finds an assignment in ``inner`` (and nothing outside of it)."""
    spans = secrets.find(text)[1]
    lo, hi = text.index(inner), text.index(inner) + len(inner)
    assert all(lo <= a < b <= hi for a, b, _ in spans), (spans, lo, hi)
    return "assign" in {k for _, _, k in spans}


def test_streams_in_streams_prefixed_and_wrapped_base64():
    raw = SECRET.encode()
    for data in (gzip.compress(zlib.compress(raw)), zlib.compress(gzip.compress(zlib.compress(raw)))):
        inner = base64.b64encode(data).decode()
        assert hidden(f"see {inner} there", inner)
    for prefix in ("https://h.example/cb/", "sess_", "abc/", "a-", "xyz"):
        for data in (raw, raw + b"\xff\x00", gzip.compress(raw)):
            inner = prefix + base64.urlsafe_b64encode(data).decode()
            assert hidden(f"see {inner} there", inner), (prefix, data)
    long = b"some words before it " * 3 + raw + bytes(range(97, 123)) * 5
    noise = random.Random(1).randbytes(300)
    for data in (long, gzip.compress(noise + long)):
        for width in (64, 76):
            for end in ("\n", "\r\n"):
                flat = base64.b64encode(data).decode()
                inner = end.join(flat[i:i + width] for i in range(0, len(flat), width))
                assert hidden(f"see {inner} there", inner), (width, end)
    flat = base64.b64encode(b"x" * 40 + b"password=abcdefghij" + b"!" * 20).decode()
    text = flat[:64] + "\n" + flat[64:]
    assert any(b > 65 > a for a, b, _ in secrets.find(text)[1])  # across the line end


def test_large_and_cut_off_streams_are_scanned():
    filler = b"all work and no play " * 900_000  # 18.9 MB
    nested = b" see " + base64.b64encode(gzip.compress(SECRET.encode())) + b" there "
    for data in (filler + SECRET.encode(), filler[:(1 << 20) - 10] + SECRET.encode() + filler, filler + nested):
        inner = base64.b64encode(zlib.compress(data)).decode()
        assert hidden(f"see {inner} there", inner)
    noise = random.Random(2).randbytes(3000).hex().upper().encode()
    whole = gzip.compress(SECRET.encode() + b" " + noise)
    cut, damaged = whole[:len(whole) // 2], whole[:-1000] + bytes(1000)
    for data in (cut, damaged):
        inner = base64.b64encode(data).decode()
        assert hidden(f"see {inner} there", inner)


def test_decontamination_stage_decides_by_row(spark, tmp):
    item = " ".join(f"i{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    rows = [(None, "a " + item), (None, "clean"), (7, item + " b"), (7, "clean too"), (8, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.stage(spark, docs, tmp).collect()
    assert {tuple(r) for r in got} == {(None, "clean"), (7, "clean too"), (8, None), (None, None)} and len(got) == 4


def test_a_budget_keeps_the_repetition_limit(spark):
    rows = [(i, "big" if i < 900 else f"s{i % 5}", "word " * (5 + i % 7)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    own = Counter()
    for _, s, t in rows:
        own[s] += len(t.split()) + 1
    whole = sum(own.values())
    for budget in (whole // 3, whole, int(1.4 * whole), 4 * whole):
        got = mixing.mix(docs, max_repeats=1.5, budget=budget, block_docs=20)
        read = {r.source: r.t for r in got.groupBy("source").agg(F.sum("__n").alias("t")).collect()}
        assert all(t <= 1.5 * own[s] + 12 for s, t in read.items())  # the document that crosses the end is taken
        assert abs(sum(read.values()) - min(budget, int(1.5 * whole))) <= 12 * len(own)
        # a plain search of the exponent: the smallest on a grid within the limit, or what the entropy asks for
        if budget < 1.5 * whole:
            def passes(a):
                z = sum(t ** a for t in own.values())
                return max(budget * t ** a / z / t for t in own.values())
            limit = min(a / 1000 for a in range(1001) if passes(a / 1000) <= 1.5)
            def entropy(a):
                p = [t ** a / sum(x ** a for x in own.values()) for t in own.values()]
                return -sum(x * math.log(x) for x in p)
            wanted = max(a / 1000 for a in range(1001) if entropy(a / 1000) >= 0.98 * math.log(len(own)))
            alpha = max(limit, wanted)
            sums = sum(t ** alpha for t in own.values())
            assert all(abs(read[s] - budget * own[s] ** alpha / sums) < 15 + 0.003 * budget for s in own)


def page(i, url, *links):
    return (i, url, "".join(f'<a class=x href="{x}">y</a>' for x in links))


def test_links_of_every_kind(spark):
    pages = spark.createDataFrame([
        (1, "http://a.org/x", "<BASE target=_top href='//Base.org/dir/'><a href=rel>r</a> <a href='?q'>q</a><a href=mailto:x@y.z>m</a>"),
        (2, "http://b.org/x", '<a href="/own">o</a><a\nhref = "https://C.org:80/p?u=//no.org">c</a> <link rel=x href=//d.org><a data-href="http://no.org">'),
        (3, "http://c.org/", "<a href='it.html'>i</a> text href=http://no.org <a href=\"javascript:go('//no.org')\">j</a>")],
        "page_id long, url string, html string")
    assert {(r.src, r.dst, r.n) for r in urls.host_links(pages).collect()} == {
        ("a.org", "base.org", 2), ("b.org", "c.org:80", 1), ("b.org", "d.org", 1)}


def test_propagation_matches_power_iteration(spark):
    r = random.Random(5)
    hosts = [f"h{i}.example.{'net' if i % 6 == 0 else 'org' if i % 3 else 'com'}" for i in range(24)]
    rows = [page(i, f"http://{hosts[i % 20]}/{'fr' if i % 4 == 0 else 'x'}/{i}", *(f"http://{h}/" for h in r.choices(hosts, k=r.randint(0, 3))))
            for i in range(60)]  # four hosts are link targets alone, some pages have no links
    rows.append(page(60, "http://bad.com/", "http://evil.net/"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: (r.trust, r.distrust, r.verdict) for r in urls.judge(pages).collect()}
    assert got["bad.com"][2] == "block"  # links to a blocked host that is not in the table itself
    links = Counter()
    for _, url, html in rows:
        for x in html.split('href="')[1:]:
            a, b = url.split("/")[2], x.split("/")[2]
            links[a, b] += a != b
    every = sorted({h for _, url, _ in rows for h in [url.split("/")[2]]} | {h for p in links for h in p})
    at, n = {h: i for i, h in enumerate(every)}, len(every)
    m = np.zeros((n, n))
    for (a, b), k in links.items():
        m[at[a], at[b]] += k
    allowed = Counter(u.split("/")[2] for _, u, _ in rows if u.split("/")[2].endswith("org") and u.split("/")[3].startswith("fr"))
    good = np.array([float(allowed[h]) for h in every])
    bad = np.array([float(h.endswith(".net")) for h in every])
    for k, (links_, seeds) in enumerate(((m, good), (m.T, bad))):
        s = seeds / seeds.sum()
        out = links_.sum(1)
        x = s.copy()
        for _ in range(400):
            x = 0.15 * s + 0.85 * (x[out == 0].sum() * s + (x[out > 0] / out[out > 0]) @ links_[out > 0])
        assert all(abs(v[k] - x[at[h]]) < 1e-3 / n for h, v in got.items())


def test_token_files_match_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(6)
    got = tokens.write_and_read(spark, docs)
    rows = got.orderBy("start").collect()
    enc = tokens.Encoder.of(tokens.tokenizer_path())
    at = 0
    for r, d in zip(rows, docs.orderBy("doc_id").collect()):
        ids = np.array([*enc.tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    folder = tokens.qualified(spark, tokens.shared_path(spark, "shards"))
    wide = tokens.saved(docs, "wide")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokens.write_shards(wide, folder, tokens.tokenizer_path())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    shards = manifest.count()
    read = tokens.read_shards(manifest, tokens.tokenizer_path()).groupBy(F.spark_partition_id().alias("p")).count().count()
    assert shards > 2 and read == shards  # a task a shard


def test_a_tokenizer_of_another_kind_is_not_retraced(tmp_path):
    import json
    with open(tokens.tokenizer_path()) as f:
        said = json.load(f)
    said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("[\\p{N}]", "[\\p{N}]+")
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    enc = tokens.Encoder(str(path))
    assert not enc.plain
    texts = ["a 12 b123's", "x9"]
    assert enc(texts) == [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids + [1], enc.dtype).tobytes() for t in texts]


def test_radix_ranks_match_a_sort(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_BITS", 4)  # many blocks
    r = random.Random(2)
    rows = [(i, r.choice([0, 5, -(1 << 40), r.randint(-9999, 9999)]), r.choice([None, -(1 << 62), 1 << 62, r.randint(0, 50)]), r.randint(0, 3))
            for i in range(400)]
    table = resample.saved(spark.createDataFrame(rows, "pos long, s long, a long, b long").repartition(5), "rows")
    got = resample.radix_ranks(table, "s", ["a", "b"]).collect()
    want = sorted(((-x.s, x.a is None, x.a or 0, x.b) for x in got))
    assert sorted(x["rank"] for x in got) == list(range(1, 401))
    assert [(-x.s, x.a is None, x.a or 0, x.b) for x in sorted(got, key=lambda x: x["rank"])] == want


def test_longer_features_match_brute_force(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choices(["Ab", "c9", "é", "x-y", "z"], k=r.randint(0, 30)))) for i in range(60)]
    aims = [" ".join(r.choices(["ab", "z"], k=20)) for _ in range(5)]
    got = {x.doc_id: x for x in resample.resample(spark.createDataFrame(docs, "doc_id long, text string"),
                                                  spark.createDataFrame([(t,) for t in aims], "text string"), longest=2).collect()}

    def features(text):
        import re
        ws = re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
        return [zlib.crc32(f.encode()) % 10_000 for f in ws + [" ".join(p) for p in zip(ws, ws[1:])]], len(ws)
    s, t = (Counter(b for text in texts for b in features(text)[0]) for texts in ([d[1] for d in docs], aims))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000))))
    for i, text in docs:
        assert (got[i].n_features, got[i].weight) == (len(features(text)[0]), sum(map(gain, features(text)[0])))
    assert sum(x["rank"] is not None for x in got.values()) == sum(features(d[1])[1] >= 20 for d in docs) // 10


def test_selected_records_are_read_by_coalesced_ranges(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (40 if i % 2 else 1)) for i in range(200)],
                                  "page_id long, url string, html string").coalesce(1)
    folder = warc.qualified(spark, warc.shared_path(spark, "archives"))
    index = warc.write_archives(pages, folder, file_bytes=9000)
    assert index.select("file").distinct().count() > 2  # files are rolled
    import gzip as gz
    for f in [r.file for r in index.select("file").distinct().collect()]:
        whole = gz.open(f.removeprefix("file://")).read()  # any reader of gzip sees one archive
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and whole.endswith(b"\r\n\r\n")
    got = warc.read_records(index.where("page_id IN (3, 4, 5, 150)")).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [3, 4, 5, 150]
    assert [r.url for r in got] == [f"http://h/{i}" for i in (3, 4, 5, 150)]
    wanted = spark.createDataFrame([(i,) for i in (1, 15, 29, 2)], "page_id long")
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc.read_payloads(index, wanted).collect()}
    assert payloads == {1: "<p>1</p>" * 40, 15: "<p>1</p>" * 40, 29: "<p>1</p>" * 40, 2: "<p>2</p>"}
    assert warc._reads([(0, 10), (10, 5), (100, 5), (99999, 1)], 100) == [[(0, 10), (10, 5), (100, 5)], [(99999, 1)]]


def test_broken_payloads_are_noticed(spark):
    pages = spark.createDataFrame([(1, "http://h/", "text")], "page_id long, url string, html string")
    index = warc.write_archives(pages, warc.qualified(spark, warc.shared_path(spark, "archives")), level=0)
    r = index.first()
    path = r.file.removeprefix("file://")
    data = open(path, "rb").read()
    member = warc.record(1, "http://h/", b"tExt", hashlib_of(b"text"), None, level=0)
    with open(path, "wb") as f:
        f.write(data[:r.offset] + member)
    with pytest.raises(Exception, match="not the one that was written"):
        warc.read_records(spark.createDataFrame([(r.file, r.offset, len(member))], "file string, offset long, length long")).collect()


def hashlib_of(data):
    import hashlib
    return hashlib.sha256(data).hexdigest()


def test_heavy_payloads_leave_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(warc, "HEAVY", 3)
    pages = spark.createDataFrame([(i, "u", ("same" if i % 2 else f"other{i % 10}") * 50) for i in range(100)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.write_and_read(spark, pages).collect()}
    assert got == {i: (None if i < 10 and (i == 1 or i % 2 == 0) else 1 if i % 2 else i % 10) for i in range(100)}


def test_spelling_matches_brute_force(spark):
    r = random.Random(8)
    base = ["".join(r.choices("abé", k=r.randint(7, 10))) for _ in range(30)]
    found = {}
    for w in base:
        found[w] = r.randint(2, 3000)
        for _ in range(6):
            i, c = r.randrange(len(w)), r.choice("abé")
            v = r.choice([w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], w[:i] + c + w[i:], c + w, w + c])
            found.setdefault(v, r.randint(2, 60))
    words = spelling.saved(spark.createDataFrame(list(found.items()), "word string, n long"), "words")

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    forms, n_near = {}, {}
    for w in found:
        others = [v for v in found if near(w, v)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-found[v], v), default=None)
        forms[w] = best if best is not None and found[best] >= 10 * found[w] else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w
    got = spelling.group_variants(words).collect()
    assert len(got) == len(found)
    assert all((x.form, x.root, x.n, x.n_near, x.form_n) == (forms[x.word], root(x.word), found[x.word], n_near[x.word], found.get(forms[x.word]))
               for x in got)
    assert sum(n_near.values()) > 200 and sum(f is not None for f in forms.values()) > 50


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)]
    got = spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert len(got) == 20 and {r.root for r in got} == {"w20"}


def test_more_codecs():
    import bz2
    import lzma

    import zstandard
    secret = "password=Zx81kQpL0 and token: abcDEF99"
    for pack in (bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress,
                 lambda b: bz2.compress(lzma.compress(b)), lambda b: zstandard.ZstdCompressor().compress(gzip.compress(b)),
                 lambda b: b.decode().encode("utf-16-le"), lambda b: b.decode().encode("utf-16-be"), lambda b: b.decode().encode("utf-16")):
        coded = base64.b64encode(pack(secret.encode())).decode()
        text = f"data {coded} end"
        base, spans = secrets.find(text)
        assert base == [] and {k for _, _, k in spans} == {"assign"}, pack
        assert all(5 <= a < b <= 5 + len(coded) for a, b, _ in spans)
    big = "x" * 3_000_000 + " " + secret  # scanned to its end, in parts
    for pack in (bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        assert secrets.find(base64.b64encode(pack(big.encode())).decode())[1]
    for pack in (bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):  # cut off or damaged: no crash
        raw = pack((secret * 50).encode())
        secrets.find(base64.b64encode(raw[:len(raw) // 2]).decode())
        secrets.find(base64.b64encode(raw[:20] + b"!!!!" + raw[24:]).decode())
    assert secrets.find("password&equals;Zx81kQpL0 &nosuch; &amp;")[1] == [(0, 25, "assign")]


def test_base_spans_match_brute_force(spark):
    import hashlib
    import re
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    pats = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    want = {}
    for d in docs.collect():
        found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(pats) for m in p.finditer(d.text or "") if ok(m)]
        want[d.doc_id] = [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
    for r in QUERIES["op6_secrets"](spark, SF).collect():
        base = want[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(filter(None, r.spans.split(",")))


@pytest.mark.parametrize("length", [5, 6, 7, 8, 9])
def test_short_items_with_an_edit(spark, length):
    r = random.Random(length)
    items, docs = [], []
    for i in range(40):
        words = [f"i{i}w{j}" for j in range(length)]
        items.append((i, " ".join(words)))
        at, kind = r.randrange(length), i % 3
        words[at:at + 1] = [["other"], [], [words[at], "more"]][kind]
        docs.append((i, " ".join(r.choices(WORDS, k=30) + words + r.choices(WORDS, k=30))))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(docs, items, exact_below=5).where("doc_id = item_id AND distance <= 1").count()
    assert found >= 38, found
    # by default an item that short is found without an edit alone (an added word at its end is none)
    assert decontam.contaminated(docs, items).where("distance > 0").count() == 0


def test_groups_of_copies_meet_their_rows(spark):
    from vantage.llm.common import meet
    rows = [(i, 0 if i % 3 == 0 else i % 40) for i in range(900)]
    left = spark.createDataFrame(rows, "id long, k long")
    right = left.groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    low = {k: min(i for i, x in rows if x == k) for _, k in rows}
    for share in (1, 3, 1000):
        got = meet(left, right, "k", share).select("id", "k", "low").collect()
        assert sorted(map(tuple, got)) == sorted((i, k, low[k]) for i, k in rows)
