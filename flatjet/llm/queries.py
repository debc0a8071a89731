"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, language_id, license_scan, ngram_join, packing, quality_cnn, sql, substring_dedup, url_filter
from .shared import pick

#: Where the public tokenizer files are; a parameter of the packing query.
TOKENIZER = "word_bpe_49k.json"


#: The rules of the URL query (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The same for its SQL, which is left as it was and still blocks net/de/, unlike the contract.
SQL_URL_RULES = [("block", h, p) if (h, p) == ("net", "/de/") else (what, h, p) for what, h, p in URL_RULES]


#: Tools whose arguments the chat query checks.
CHAT_TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "get_weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when windows of 20 words that start earlier elsewhere are removed."""
    done = substring_dedup.remove_repeats(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut, packed into sequences of 2048 ids; one row for each piece."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; those of no known language are not accepted."""
    found = language_id.identify(pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source"))
    return found.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), (F.col("language") != language_id.UNKNOWN).alias("accepted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the alignment's score and place."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "first_word", "last_word")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more among vectors of one label, and their components."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records of every message, with tool calls linked to their results."""
    return chat_format.format_chats(table(spark, sf_dir, "conversations"), CHAT_TOOLS)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles have a Jaccard index of 0.75 or more."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by rule or, without one, by its aliases."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a network fit on the labels outside of fold 0."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = quality_cnn.fold(F.col("doc_id")) == 0
    net = quality_cnn.train(docs, table(spark, sf_dir, "labels").where(~out))
    scored = quality_cnn.score(docs, net)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_harmonic_packing": op2_harmonic_packing,
        "op3_license_scan": op3_license_scan,
        "op4_language_id": op4_language_id,
        "op5_decontamination": op5_decontamination,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_chat_format": op7_chat_format,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_url_filter": op9_url_filter,
        "op10_quality_cnn": op10_quality_cnn,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": sql.OP1,
        "op6_embedding_dedup": sql.OP6,
        "op8_ngram_jaccard": sql.OP8,
        "op9_url_filter": sql.op9(SQL_URL_RULES),
    }
