"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.llm import hostrules, mixing, phrases, prefixtrie, shards


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded with the 32k piece model."""
    import public_tokenizers

    from strikeloom.llm.pieces import encode_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).drop("same_text")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored in tar shards and read back."""
    from strikeloom.llm.media import media_columns

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_columns(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: five-word shingles, similarity 0.8 and more."""
    from strikeloom.llm.ordermin import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a scorer trained on weak labels."""
    from strikeloom.llm.weaklabels import fit_classify

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fit_classify(docs, ["doc_id"]).select("doc_id", "quality_score", "weak_label", F.col("quality_kept").alias("kept"))


#: Rules of the URL query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs, by rules and by models of what rules accept and reject."""
    from strikeloom.llm.urls import fit, judge

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, URL_RULES, fit(pages, URL_RULES))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: 97 % of the largest entropy, no source twice as often as another."""
    from strikeloom.llm.mixing import mix

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("tokens_").alias("n_tokens"), "epoch", "block", "slot")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts are control strings, formatted, stored and read back from the stored table."""
    from strikeloom.llm.base import written
    from strikeloom.llm.chat import format_conversations, read_back

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return read_back(written(format_conversations(turns.unionByName(odd)), "formatted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host verdicts of all documents."""
    from strikeloom.llm.hostrules import COUNTS, judge

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs, with_text=False).select("doc_id", *COUNTS, "base_failed", "kept", "n_failed")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into archives and read back."""
    from strikeloom.llm.warc import round_trip

    records = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 24 even shards by key, and where one more shard would put them."""
    from strikeloom.llm.shards import slots

    return slots(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * 24, [1.0] * 25)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt as a branch of the leader of its five."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefixtrie.prefix_trie(turns, group=5)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of documents, and the terms that reveal it."""
    from strikeloom.llm.pii import personal_data

    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of documents."""
    return phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


QUERIES = {
    "op1_media": op1_media,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_sharding": op9_sharding,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_personal_data": op12_personal_data,
    "op13_collocations": op13_collocations,
}
ORACLE: dict[str, str] = {"op5_mixing": mixing.SQL, "op7_quality_rules": hostrules.SQL, "op9_sharding": shards.SQL, "op11_prefix_trie": prefixtrie.SQL, "op13_collocations": phrases.SQL}
