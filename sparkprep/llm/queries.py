"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import oracle
from sparkprep.llm.chat_format import format_chats, loss_texts, parse_chat
from sparkprep.llm.collocations import collocations
from sparkprep.llm.embedding_dedup import embedding_links
from sparkprep.llm.fingerprints import fingerprint_with_edits
from sparkprep.llm.importance import resample
from sparkprep.llm.jaccard_join import jaccard_components
from sparkprep.llm.mixing import mix_sources
from sparkprep.llm.pii import detect, written
from sparkprep.llm.sentencepiece_unigram import encode_texts, load_vocabulary
from sparkprep.llm.substring_dedup import remove_repeats
from sparkprep.llm.token_counts import count_tokens
from sparkprep.llm.token_files import read_tokens, write_tokens
from sparkprep.llm.toxicity import held_out, score_toxicity
from sparkprep.llm.toxicity import train as train_toxicity
from sparkprep.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op1_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op2_embedding_dedup": oracle.EMBEDDING_DEDUP,
    "op7_chat_format": oracle.CHAT_FORMAT,
    "op10_jaccard_join": oracle.JACCARD_JOIN,
    "op12_resampling": oracle.RESAMPLING,
    "op13_collocations": oracle.COLLOCATIONS,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_substring_dedup(spark, folder):
    left = remove_repeats(_table(spark, folder, "documents"), window=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_token_files(spark, folder):
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(_table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path)


@query
def op7_chat_format(spark, folder):
    own = spark.createDataFrame(
        [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")],
        "conv_id long, turn long, role string, text string")
    chats = format_chats(_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    turns, loss = parse_chat(F.col("formatted")), F.array_join(loss_texts(F.col("formatted")), "")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op5_pii(spark, folder):
    found = detect(_table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "row.doc_id", count(1).alias("n_email"), count(2).alias("n_ip"), count(3).alias("n_card"), count(4).alias("n_phone"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def op4_mixing(spark, folder):
    mixed = mix_sources(_table(spark, folder, "documents"), max_repeats=3.0)
    return mixed.select("row.doc_id", "row.source", "mix_weight", "mix_block", "mix_order")


@query
def op9_toxicity(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train_toxicity(docs, _table(spark, folder, "labels")))
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_fingerprints(spark, folder):
    marks = fingerprint_with_edits(_table(spark, folder, "documents"))
    return marks.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op2_embedding_dedup(spark, folder):
    return embedding_links(_table(spark, folder, "embeddings"), threshold=0.93)


@query
def op10_jaccard_join(spark, folder):
    return jaccard_components(_table(spark, folder, "documents"), percent=75, shingle=5)


@query
def op3_sentencepiece(spark, folder):
    import public_tokenizers

    vocabulary = load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    coded = encode_texts(_table(spark, folder, "documents").select("doc_id", "text"), vocabulary)
    return coded.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


@query
def op11_token_counts(spark, folder):
    import public_tokenizers

    return count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query
def op12_resampling(spark, folder):
    return resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), percent=25, min_words=20, buckets=10_000, seed=7)


@query
def op13_collocations(spark, folder):
    return collocations(_table(spark, folder, "documents"), most_words=4, least=30, top=2000, scale=2_000_000, inside_percent=80)
