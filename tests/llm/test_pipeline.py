"""The pipeline's stages on a small corpus, each against what was planted."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spoorline.session import shared_root

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(0)
    parts = {"en": "th er on an re he in ed nd ha".split(), "de": "che ung keit lich ein ver ber".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5)))
    text = lambda lang, n=80: " ".join(word(lang) for _ in range(n))
    clean = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(60)]
    item = text("en", 30)
    base = clean[0][1]
    near = base.split()
    near[40] = "changed"
    planted = [
        (100, base, "de"), (101, " ".join(near), "de"), (100, base, "de"), (None, clean[1][1], "en"), (102, None, "en"), (103, "", "en"), (104, "123 !?", "en"),
        (105, text("en", 20) + " " + item + " " + text("en", 20), "en"), (106, text("en", 30) + " password=abcdef1234567890ab " + text("en", 30), None),
        (107, text("de", 4000), "de"), (107, "zwei ver", "de"),
    ]
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in clean + planted]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def ids(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in df.select("doc_id").collect())


def test_stages_keep_clean_documents_and_drop_what_they_should(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    clean = list(range(60))
    wanted = {
        "language": sorted(clean + [100, 100, 101, 105, 106, 107, 107, -1]),
        "near_duplicates": sorted(clean + [105, 106, 107, 107]),
        "benchmark_free": sorted(clean + [106, 107, 107]),
        "without_secrets": sorted(clean + [106, 107, 107]),
    }
    for i, (name, fn) in enumerate(corpus_pipeline.STAGES):
        fn(spark, docs, corpus).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name in wanted:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert ids(docs) == wanted[name], name
        if name == "without_secrets":
            row = docs.where("doc_id = 106").first()
            assert "abcdef" not in row["text"] and "[secret]" in row["text"] and row["n_chars"] == len(row["text"]) and row["lang"] == "en"
            assert docs.where("doc_id = 1").first()["n_chars"] == len(docs.where("doc_id = 1").first()["text"])
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert set(ids(docs)) == set(clean + [106, 107])


def test_run_equals_the_stages_and_leaves_no_tables(spark, corpus):
    folder = Path(shared_root(spark).removeprefix("file:")) / "spoorline"
    before = set(folder.iterdir()) if folder.exists() else set()
    out = corpus_pipeline.run(spark, corpus)
    assert set(ids(out)) == set(range(60)) | {106, 107}
    assert set(folder.iterdir()) == before
    assert out.where("length(ids) <> 4 * length or crc32(ids) <> ids_crc32").count() == 0


def test_empty_corpus(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, fn in corpus_pipeline.STAGES:
        docs = fn(spark, docs, corpus)
    assert docs.count() == 0
