"""Defined cases of every operator: nulls, empty and very long texts, repeated rows,
empty tables, extra columns; and the pipeline's stages on them."""

import hashlib

import pytest

import corpus_pipeline
from vantage.llm import (ann, classlm, decontam, langid, mixing, neardup, quality, resample, secrets, spelling, tokens, urls,
                         warc)

LONG = "long words " * 60_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "A plain text of some words here", "en", "a"), (1, "A plain text of some words here", "en", "a"),
            (2, None, None, None), (3, "", "en", "b"), (None, "no id at all", "en", None), (4, LONG, "en", "a"),
            (5, " \n\t", None, "b"), (6, "a plain TEXT of some words here", "de", "b"), (7, "\u00a0\u2003é", "fr", "a")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 9) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0), (6, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels, ["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in quality.classify(odd, labels.limit(0), ["doc_id"]).collect()} == {0.5}
    assert quality.classify(none, labels, ["doc_id"]).count() == 0


def test_mixing(odd, none):
    got = mixing.mix(odd, block_docs=2)
    assert {r.doc_id for r in got.collect()} == {1, 2, 3, None, 4, 5, 6, 7} and got.columns[:7] == odd.columns
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd.withColumnRenamed("node", "__n"))


def test_class_model(odd, none):
    from pyspark.sql import functions as F
    got = classlm.score_texts(odd, F.col("doc_id") != 6).collect()
    assert len(got) == 9 and sorted(r.n_tokens for r in got)[:3] == [1, 1, 1] and max(r.n_tokens for r in got) == 120_001
    assert all(r.score <= 0 and r.base_score <= 0 and r.n_known <= r.n_tokens for r in got)
    bare = classlm.score_texts(odd, F.lit(False)).collect()
    assert {(r.n_known, r.score, r.base_score, r.train_tokens) for r in bare} == {(0, 0.0, 0.0, 0)}
    assert classlm.score_texts(none, F.lit(True)).count() == 0


def test_near_duplicates(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 9
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {
        (1, 5, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, False), (4, 2, 4, True), (5, 0, 5, True),
        (6, 5, 1, False), (7, 1, 7, True)}
    assert neardup.near_duplicates(none).count() == 0


def test_an_id_with_several_texts(spark):
    docs = spark.createDataFrame([(5, "one two three four"), (5, "five six seven eight"), (3, "five six seven eight"),
                                  (9, "one two three four"), (8, "quite another text here")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs).collect()} == {
        (5, 3), (3, 3), (9, 3), (8, 8)}


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "plain text of some words"), (1, "plain text of some words"), (2, None), (3, ""),
                                   (None, "no id at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(odd, items).collect()}
    assert got == {(1, 1, 0), (6, 1, 0), (None, None, 0)}
    assert decontam.contaminated(none, items).count() == 0 and decontam.contaminated(odd, items.limit(0)).count() == 0


def test_secrets(odd, none):
    got = secrets.scan_secrets(odd).collect()
    assert len(got) == 9 and all(r.base == [] and r.spans == [] for r in got)
    assert secrets.scan_secrets(none).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", "<a href=x>"), (3, "HTTP://A.Example.NET/en/x?y", ""),
                                   (4, "http://a.example.net", None), (5, "x://example.com/de/", "")],
                                  "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
                   3: ("a.example.net", "/en/x", "example.net/en/", "allow"), 4: ("a.example.net", "", None, "allow"),
                   5: ("example.com", "/de/", "example.com/de/", "block")}
    assert urls.judge(pages.limit(0)).count() == 0


def test_language(odd, none):
    langs, model = langid.fit(odd.select("doc_id", "lang", "text"))
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, langs, model, ["doc_id"]).collect()}
    assert langs == ["de", "en", "fr"] and {(2, "und"), (3, "und"), (5, "und"), (4, "en"), (7, "fr")} <= got
    langs, model = langid.fit(none.select("doc_id", "lang", "text"))
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, langs, model, ["doc_id"]).collect()} == {("und", 0.0)}


def test_token_files(spark, odd, none):
    got = tokens.write_and_read(spark, odd).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(9)]
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 5)} == {1}
    assert tokens.write_and_read(spark, none).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0]) for i in range(30)] + [(40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]),
                                                            (120, [None, 1.0]), (140, [1.0]), (None, [1.0, 1.0]), (3, [3.0, 1.0])]
    got = ann.search(ann.build_index(v := ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))),
                     v.where("vec_id % 20 = 0"), k=40).collect()
    assert {r.query_id for r in got} == {0, 20}
    for q in (0, 20):
        want = sorted(((q % 7) * (i % 7) + 1.0, -i) for i in range(30) if i != q)[::-1]
        assert [(r.score, -r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
    empty = ann.valid(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert ann.search(ann.build_index(empty), empty).count() == 0


#: Names that the stages use inside, or that a caller may well have.
CLASHES = ["score", "predicted", "weight", "tokens", "quota", "passes", "rest", "full", "until", "text_key", "box", "doc", "key",
           "component_id", "kept", "n_shingles", "begin", "before", "t", "n", "part", "path", "base", "start", "n_tokens",
           "ids_crc32", "frame", "__n", "__p", "__w", "__at", "__mix_tokens", "with space", "a.b", "held_out", "c0", "root", "h"]


@pytest.fixture(scope="module")
def clashing(odd):
    from pyspark.sql import functions as F
    docs = odd.drop("node", "score")
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_pipeline_stages_keep_columns(spark, odd, clashing, none, name, stage):
    sf = "/root/testdata/sf0.001"
    last = stage is tokens.stage
    for docs in (odd, clashing):
        got = stage(spark, docs, sf)
        found = got.collect()
        if last:
            assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and len(found) == 9
            continue
        assert got.columns == docs.columns, name
        if stage is not quality.stage:  # which may reject any of them
            assert {2, 3, 5, 7} <= {r.doc_id for r in found}, name
        if docs is clashing:
            assert all([r[c] for c in CLASHES] == list(range(len(CLASHES))) for r in found)
    assert stage(spark, none, sf).count() == 0


def test_the_whole_pipeline(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
        got = corpus_pipeline.run(spark, sf).orderBy("start").collect()
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
        if docs is none:
            assert got == []


def test_resampling(spark, odd, none):
    from pyspark.sql import functions as F
    target = spark.createDataFrame([("long words",), (None,), ("",)], "text string")
    got = resample.resample(odd, target, least_words=2, percent=50).collect()
    # the null id draws as an empty text; the empty texts and the text without two words take no part
    assert len(got) == 9 and sorted(r.rank for r in got if r.rank) == [1, 2]
    assert {r.doc_id: r.n_features for r in got} == {1: 7, 2: 0, 3: 0, None: 4, 4: 120_000, 5: 0, 6: 7, 7: 1}
    order = sorted((r for r in got if r.n_features >= 2), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))
    assert [r.rank for r in order] == [1, 2] + [None] * (len(order) - 2)
    assert resample.resample(none, target).count() == 0
    assert {r.weight for r in resample.resample(odd.where("doc_id = 2"), target.limit(0)).collect()} == {0}
    same = odd.where("doc_id = 1").unionAll(odd.where("doc_id = 1"))  # rows that are alike in all keys
    assert [r["rank"] for r in resample.resample(same, target, least_words=1, percent=100).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert resample.resample(odd.withColumn("pos", F.lit(1)).withColumn("rank", F.lit(2)), target).count() == 9


def test_warc(spark, none):
    body = "x" * 100
    rows = [(3, "http://a/ b\r\nc", body, 1), (1, None, body, 1), (2, "http://b/", body[:99], 1), (5, "", body[:99], 1), (None, "http://c/é", body, 1),
            (4, "http://d/", None, 1), (6, "http://d/", "", 1), (1, "http://again/", body, 1), (7, "http://e/", "é" * 60_000, 1),
            (8, "http://f/", "\x00\r\n\r\nWARC/1.1\r\n" * 20, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.write_and_read(spark, pages).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == sorted(
        [(3, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (5, "response", None),
         (0, "revisit", 1), (4, "response", None), (6, "response", None), (7, "response", None), (8, "response", None)],
        key=lambda r: (r[0], r[1], r[2] or 0))
    want = {r[0]: (r[2] or "").encode() for r in rows}
    assert all((r.payload_bytes, r.payload_digest) == (len(want[r.page_id]), hashlib.sha256(want[r.page_id]).hexdigest()) for r in got)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_and_read(spark, empty).count() == 0


def test_spelling(spark, odd, none):
    rows = [(None, "letters LETTERS letters")] * 9 + [(5, "lettters lettters"), (6, None), (7, ""), (8, "lettres lettres"),
                                                     (9, "a" * 40_000 + " " + "a" * 40_000 + " " + "a" * 40_001 + " " + "a" * 40_001)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    got = {r.word: r for r in spelling.group_variants(spelling.saved(spelling.word_counts(docs, typo_every=1 << 40), "w")).collect()}
    assert (got["letters"].n, got["letters"].n_near, got["letters"].form, got["letters"].root) == (27, 1, None, "letters")
    assert (got["lettters"].form, got["lettters"].root, got["lettters"].form_n) == ("letters", "letters", 27)
    assert (got["lettres"].form, got["lettres"].n_near, got["lettres"].root) == (None, 0, "lettres")  # two edits away
    assert got["a" * 40_000].n_near == 1 and got["a" * 40_000].form is None
    assert spelling.group_variants(spelling.saved(spelling.word_counts(none), "w")).count() == 0


def test_letters_only(spark):
    docs = spark.createDataFrame([(1, "\u00b2 \u00bd \u2460 \u2167 12 _"), (2, "wort\u00b2wort"), (3, "word")], "doc_id long, text string")
    train = spark.createDataFrame([(1, "en", "word words"), (2, "de", "wort worte")], "doc_id long, lang string, text string")
    langs, model = langid.fit(train)
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, langs, model, ["doc_id"]).collect()} == {1: "und", 2: "de", 3: "en"}
    assert langid.letter_runs("a\u00b2b \u00bd") == ["a", "b"]
