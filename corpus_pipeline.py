"""A training-data pipeline: quality, language, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir), is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.

In every stage a null or empty text is a row like others (quality and language
judge it as the operators say; it has no lines and no near copies), a row with a
null doc_id is never a copy of another, repeated rows meet the same decision, an
empty table gives an empty one, texts of any length are taken whole, and further
columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm import language, packing, quality
from threadloom.llm.common import discard, materialise, table
from threadloom.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, learned from all labels, predicts to be good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    keep = docs.columns
    scored = quality.score(docs.withColumns({"__own": F.struct(*keep)}).select("__own", "text"), model)
    return scored.where(F.col("predicted") == 1).select("__own.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised above the calibrated threshold."""
    model = language.fit(docs)
    keep = docs.columns
    scored = language.predict(docs.withColumns({"__own": F.struct(*keep)}).select("__own", "text"), model)
    return scored.where(~F.col("rejected")).select("__own.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat, exactly or nearly, a line before them."""
    from threadloom.llm import lines

    out = lines.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    from threadloom.llm import minhash

    # A null id is never among those that go.
    gone = minhash.components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("packing", pack),
]

#: Trained models and a tokenizer take part: there is no SQL for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage{k}")
        if k:  # the first stage reads the given table
            discard(before)
    return docs
