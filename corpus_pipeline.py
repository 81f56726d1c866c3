"""The corpus pipeline: five stages, each over all that the one before has kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written
as Parquet in the shared folder and read again as the next one's documents.

All stages but the last return the columns of their input with its own values, even
where an operator has columns of the same names. What holds of each: null and empty
texts, ties, repeated rows and null ids have the result that the stage states; texts
are taken whole, however long; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strikeloom.llm.base import fresh_dir, set_apart


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that rules and host verdicts keep.

    A null or empty text has too few words and goes; a null source is a host of its
    own; repeated rows are judged each and alike; ids don't matter.
    """
    from strikeloom.llm.hostrules import judge

    own, back = set_apart(docs, "source", "text")
    return judge(own).filter("kept").select(*back)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer trained on weak labels keeps.

    A null text is scored as an empty one; equal texts have equal scores; ids only
    choose the block that a document is learned in, a null one like any other.
    """
    from strikeloom.llm.weaklabels import fit_classify

    own, back = set_apart(docs, "doc_id", "text")
    return fit_classify(own, own.columns).filter("quality_kept").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest id.

    Texts without words all stay. Of rows of the smallest id one stays; rows that
    share an id but not their words are compared each for itself; null ids come
    after all others (``ordermin.keep_one``).
    """
    from strikeloom.llm.ordermin import keep_one

    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources has it, once at least.

    A null source is a source of its own; null and empty texts count one token;
    repeated rows are repeated documents.
    """
    from strikeloom.llm.mixing import mix

    own, back = set_apart(docs, "doc_id", "source", "text")
    return mix(own).select(*back)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the text decoded from them.

    One row for each row of ``docs``; a null text is an empty one, without ids;
    columns other than the id are left out.
    """
    import public_tokenizers

    from strikeloom.llm.pieces import encode_documents

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).drop("same_text")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL can express neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
