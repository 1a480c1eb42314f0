"""A training corpus from raw documents, in five stages.

``run`` applies the stages one after the other; each one's rows are written as Parquet in the shared folder and read again
as the next one's documents. All but the last return the columns of the documents they were given.

What holds for every stage: an empty table gives no rows; equal rows and equal or null ids are rows of their own (near copies
keep one of equal texts with words); columns other than those named travel in a struct or not at all, so their names cannot
clash; very long texts are handled whole. The stages need ``doc_id``, ``text`` and ``source``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm.jaccard_join import keep_one_per_class
from sparkprep.llm.mixing import mix_sources
from sparkprep.llm.pii import redact
from sparkprep.llm.sentencepiece_unigram import encode_texts, load_vocabulary
from sparkprep.llm.toxicity import score_toxicity
from sparkprep.llm.toxicity import train as train_toxicity
from sparkprep.session import cut

TOXIC = 0.7
MAX_REPEATS = 2.0
VOCABULARY = None  # the path of a SentencePiece model; by default the public one of the box


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``, by a model learned from the labels and these documents.

    A null text is scored as an empty one; neither holds a toxic word, so both stay unless the model is above the limit
    without any.
    """
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where(F.col("score") < TOXIC).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.75 or more): the one with the smallest id.

    Null ids come last. Texts without words are near nothing: all of them stay, null ones too.
    """
    return keep_one_per_class(docs, percent=75, shingle=5)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text. A null text stays null."""
    redacted = redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in redacted.columns else redacted


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of smaller sources up to ``MAX_REPEATS`` times, as the flattest temperature allows.

    A null source is a source of its own, and one without words takes no part in the weights.
    """
    return mix_sources(docs, max_repeats=MAX_REPEATS).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, its id and its source; null and empty texts have none."""
    path = VOCABULARY
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_texts(docs, load_vocabulary(path))
    return coded.select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("personal data", redact_pii),
    ("mixing", mix),
    ("tokens", tokenize),
]

ORACLE_SQL = None  # a trained classifier, boosted trees and tokens are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage{i + 1}")
    return docs
