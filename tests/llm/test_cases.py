"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm import bpe, decontam, linededup, lm, minhash, quality, secrets, sharding, suffixes, urlfilter

LONG = " ".join(f"word{i} of text number {i % 97}" for i in range(20_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rest string, lines_removed string, words_removed string, bucket string, label string, th string, gone_id string"
ROWS = [
    (1, LONG, "en", "s"), (2, None, "en", None), (3, "", None, "s"), (None, "no id but a text", "en", "s"), (None, None, None, None), (4, "same row", "de", "s"), (4, "same row", "de", "s"), (4, "other text of that id", "de", "s"),
    (5, "\n \n\t\n", "en", "s"), (6, "é ü 日本 🙂 \u0000 end", "fr", "s"), (7, "a" * 30_000, "en", "s"), (8, "x", "en", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *"abcdefg") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (3, None, 1), (77, 0, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (None, ""), (2, "too short"), (3, "word5 of text number 5 word6 of text number 6")], "item_id bigint, text string")


def pairs(df, *columns):
    return sorted(map(tuple, df.select("doc_id", *columns).collect()), key=repr)


def test_line_dedup(docs, nothing):
    out = linededup.dedup_lines(docs)
    assert set(out.columns) == set(docs.columns) and out.schema["lines_removed"].dataType.simpleString() == "bigint"
    assert pairs(out, "text", "rest", "lines_removed") == sorted([(r[0], r[1], "a", 0) for r in ROWS], key=repr)
    assert linededup.dedup_lines(nothing).count() == 0


def test_decontamination(docs, nothing, benchmark):
    out = decontam.decontaminate(docs, benchmark)
    got = {(r["doc_id"], r["words_removed"]) for r in out.collect()}
    assert (1, 10) in got and out.count() == len(ROWS) and set(out.columns) == set(docs.columns)
    assert decontam.decontaminate(nothing, benchmark).count() == 0
    assert pairs(decontam.decontaminate(docs, benchmark.limit(0)), "text") == pairs(docs, "text")


def test_secrets(docs, nothing):
    assert secrets.find_secrets(docs).count() == 0 and secrets.find_secrets(nothing).count() == 0


def test_bpe(docs, nothing):
    out = bpe.encode(docs)
    assert out.count() == len(ROWS) and out.filter("exact = false").count() == 0
    assert {(r["tokens"] is None, r["n_tokens"] is None, r["exact"] is None) for r in out.filter("doc_id = 2").collect()} == {(True, True, True)}
    assert out.filter("doc_id = 3").first()["tokens"] == []
    assert pairs(bpe.decode(out), "text") == pairs(docs, "text")
    assert bpe.encode(nothing).count() == 0 and bpe.decode(bpe.encode(nothing)).count() == 0
    odd = docs.sparkSession.createDataFrame([(1, [99999999, -1, None, 36]), (2, None), (3, [])], "doc_id bigint, tokens array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd).collect()} == {1: "���E", 2: None, 3: ""}


def test_quality(docs, nothing, labels):
    assert quality.keep_scores(docs, labels).count() == len(ROWS)
    assert pairs(quality.keep_documents(docs, labels), "text", "rest", "label") == pairs(docs, "text", "rest", "label")
    assert quality.keep_scores(docs, labels.limit(0)).count() == len(ROWS) and quality.keep_documents(nothing, labels).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "HTTPS://User@WWW.Ex.com:443/a//b/?b=2&utm_x=1&a=1#f", 1), (2, None, 1), (3, "", 1), (None, "http://sub.bad.org/x", 1), (4, "ex.com/a/b?a=1&b=2", 1), (4, "ex.com/a/b?a=1&b=2", 1), (5, "http://notbad.org/", 1), (6, "not a url " * 5000, 1)],
        "page_id bigint, url string, block int",
    )
    listed = spark.createDataFrame([("http://ex.com/a/b?b=2&a=1",), ("bad.org/",), (None,), ("",)], "url string")
    out = {(r["page_id"], r["canonical"] and r["canonical"][:20]): r["matched"] for r in urlfilter.filter_urls(pages, listed).collect()}
    assert out[1, "ex.com/a/b?a=1&b=2"] == out[4, "ex.com/a/b?a=1&b=2"] == "ex.com/a/b?a=1&b=2" and out[None, "sub.bad.org/x"] == "bad.org"
    assert out[2, None] is None and out[3, ""] is None and out[5, "notbad.org"] is None
    assert urlfilter.filter_urls(pages, listed).count() == 8 and urlfilter.filter_urls(pages, listed.limit(0)).filter("blocked").count() == 0 and urlfilter.filter_urls(pages.limit(0), listed).count() == 0


def test_lm(docs, nothing):
    rows = lm.score_documents(docs).collect()
    out = {(r["doc_id"], r["n_tokens"]): r for r in rows}
    assert len(rows) == len(ROWS) and sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 4 for r in rows) == 3
    assert out[2, None]["log2_prob"] is None and out[3, 0]["log2_prob"] == out[5, 0]["log2_prob"] == 0 and out[3, 0]["bits_per_token"] is None and out[1, 100_000]["bits_per_token"] > 0
    assert lm.score_documents(nothing).count() == 0
    assert lm.score_documents(docs.filter("doc_id = 8"), nothing).first()["log2_prob"] == 0


def test_suffixes(docs, nothing):
    assert suffixes.repeated_passages(docs).count() == 0 and suffixes.repeated_passages(nothing).count() == 0
    twice = docs.unionAll(docs.withColumn("doc_id", F.lit(9).cast("bigint")).filter("text like 'word0%'"))
    got = {(r["doc_id"], r["first_word"], r["n_words"], r["other_doc_id"]) for r in suffixes.repeated_passages(twice).collect()}
    assert got == {(1, 0, 100_000, 9), (9, 0, 100_000, 1)}
    # within one document, a word said over and over
    own = docs.sparkSession.createDataFrame([(1, "again " * 200)], "doc_id bigint, text string")
    assert [tuple(r) for r in suffixes.repeated_passages(own).collect()] == [(1, 0, 200, 200, 1)]


def test_minhash(docs, nothing, spark):
    assert minhash.near_duplicates(docs).count() == 0 and minhash.near_duplicates(nothing).count() == 0
    assert minhash.drop_near_duplicates(docs).count() == len(ROWS) - 1
    copies = spark.createDataFrame([(3, LONG), (2, LONG.upper()), (9, LONG + " more"), (4, "no"), (5, "No!"), (None, LONG)], "doc_id bigint, text string")
    assert {tuple(r) for r in minhash.near_duplicates(copies).collect()} == {(3, 2), (9, 2), (5, 4)}
    assert minhash.drop_near_duplicates(copies).count() == 3


def test_sharding(docs, nothing):
    out = sharding.shard_documents(docs, 3).collect()
    assert [(r["doc_id"]) for r in out] == sorted([r["doc_id"] for r in out], key=lambda x: (x is not None, x)) and len(out) == 9
    assert next(r for r in out if r["doc_id"] == 4)["n_bytes"] == 2 * len("same row") + len("other text of that id")
    assert sharding.shard_documents(nothing).count() == 0


def test_stages(docs, nothing, spark, tmp_path):
    (tmp_path / "t").mkdir()
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some item of a benchmark that is not there")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, str(tmp_path))
            n = out.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == rows.columns and out.schema.simpleString() == rows.schema.simpleString()
            assert n == (0 if rows is nothing else len(ROWS) - (k == 2))


def test_run_on_odd_rows(docs, nothing, spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some item of a benchmark that is not there"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    # one of the two equal rows goes
    assert pairs(bpe.decode(out), "text") == sorted({(r[0], r[1]) for r in ROWS}, key=repr) and out.count() == len(ROWS) - 1
    nothing.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_what_the_pipeline_does(spark, tmp_path):
    """Planted cases against what is left of them at the end, whatever the stages."""
    r = random.Random(6)
    vocab = ["".join(r.choices("abcdefghilmnoprstu", k=r.randint(3, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(r.choices(vocab, k=n))
    item, shared = prose(40), prose(60)
    texts = {i: "\n".join(prose(40) for _ in range(4)) for i in range(60)}
    clean = dict(texts)
    texts[100], texts[101] = texts[3], texts[4].upper()
    # a word of each line differs, so that no line is the same
    texts[102] = "\n".join(" ".join("other" if k == 10 else w for k, w in enumerate(line.split(" "))) for line in texts[5].split("\n"))
    texts[103] = f"{prose(50)} {item} {prose(50)}"
    texts[104], texts[105] = f"{prose(30)}\n{shared}\n{prose(30)}", f"{prose(30)}\n{shared}\n{prose(30)}"
    texts[106] = item
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {x["doc_id"]: x["text"] for x in bpe.decode(corpus_pipeline.run(spark, str(tmp_path))).collect()}
    assert {i: out.get(i) for i in clean} == clean and set(out) == {*clean, 103, 104, 105}
    assert item[20:-20] not in out[103] and len(out[103].split()) == 100 and out[104] == texts[104] and out[105] == texts[105].replace(shared + "\n", "")
