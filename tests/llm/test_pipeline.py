"""The pipeline's stages on hand-made documents: what each keeps, and what happens to nulls, blanks, copies and odd columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkprep.llm.sentencepiece_unigram import decode_texts, load_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"word{r.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def documents(spark):
    rows = [(i, prose(i, 40), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, prose(1, 40), "en", "s0", 0), (101, prose(2, 40) + " tail", "en", "s1", 0)]  # an exact and a near copy
    rows += [(200, None, None, None, None), (201, "", "en", "s2", 0), (202, " \n", None, "s2", 2), (None, prose(99, 30), "en", None, 0)]
    rows += [(203, "write to jane.doe@example.org or +49 (30) 123 456 78", "en", "s1", 0), (204, prose(7, 30_000), "en", "s1", 0), (204, prose(8, 25), "en", "s1", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_near_copies(spark, folder):
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, documents(spark), folder).collect()}
    assert kept == {*range(40), 200, 201, 202, 203, 204, None}


def test_personal_data(spark, folder):
    out = {r["doc_id"]: r for r in corpus_pipeline.redact_pii(spark, documents(spark).where("doc_id >= 200 and doc_id < 204"), folder).collect()}
    assert out[203]["text"] == "write to <EMAIL> or <PHONE>" and out[203]["n_chars"] == 27
    assert out[200]["text"] is None and out[201]["text"] == "" and out[202]["text"] == " \n"


def test_toxic_documents(spark, folder):
    docs = documents(spark)
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == docs.count()  # none of these holds a toxic word


def test_mixing(spark, folder):
    mixed = corpus_pipeline.mix(spark, documents(spark), folder)
    times = {(r["doc_id"], r["n"]) for r in mixed.where("doc_id < 200").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert mixed.columns == documents(spark).columns and all(n <= 2 for _, n in times) and {i for i, _ in times} == {*range(40), 100, 101}


def test_tokens(spark, folder):
    import public_tokenizers

    docs = documents(spark).where("doc_id < 204 or doc_id is null")
    coded = corpus_pipeline.tokenize(spark, docs, folder)
    assert coded.columns == ["doc_id", "source", "n_tokens", "ids"]
    back = decode_texts(coded.select("doc_id", "ids"), load_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    assert sorted((tuple(r) for r in back.select("row.doc_id", "text").collect()), key=repr) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr)


@pytest.mark.parametrize("stage", range(5))
def test_no_documents(spark, folder, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, documents(spark).where("false"), folder).count() == 0
