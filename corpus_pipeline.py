"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flatjet.llm import decontaminate, language_id, ngram_join, packing, queries, shared, substring_dedup


def _held(docs: DataFrame, *leave: str) -> Column:
    """The columns of ``docs`` but for ``leave`` in one struct, so that no operator's own columns clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in leave]).alias("held")


def _back(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` from the struct, or from ``new``, in their order."""
    return df.select(*[new[c].alias(c) if c in new else F.col(f"held.`{c}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no known language, null and blank texts among them; rows are judged one by one."""
    found = language_id.identify(docs.select("text", "lang", "source", _held(docs)))
    return _back(found.where(F.col("language") != language_id.UNKNOWN), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near copies; unlinked documents stay.

    Where an id repeats, its rows are told apart by text: of its rows in one group
    one stays, of smallest text, and those in other groups are decided there. Rows
    without an id stay.
    """
    groups = ngram_join.jaccard_components(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    again = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    if not again.isEmpty():
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        stay = groups.join(again, "doc_id", "left_semi").where("component_id = doc_id").select("doc_id", "class_id", "group_id").distinct()
        rows = docs.join(again, "doc_id", "left_semi").withColumn("class_id", ngram_join.class_of(F.col("text")))
        single = rows.join(stay, ["doc_id", "class_id"]).groupBy("doc_id", "group_id").agg(F.min(F.struct("text", *rest)).alias("row"))
        kept = kept.join(again, "doc_id", "left_anti").unionByName(single.select("doc_id", "row.*"))
    return kept.select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out; texts without any stay as they are, and documents with nothing left go.

    Rows without an id come after all others and rows of one id are one document, as in the operator.
    """
    done = substring_dedup.remove_repeats(docs.select("doc_id", "text", _held(docs, "text", "n_chars")))
    done = done.where("n_removed = 0 or kept_text <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _back(done, docs, text=text, n_chars=F.length(text).cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item or an edited copy of one; rows are known by id and text, so rows of a null or repeated id go one by one."""
    mark = F.struct(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("text")).alias("mark")
    leaks = decontaminate.find_leaks(docs.select(mark, "text"), queries.table(spark, sf_dir, "benchmark"), id_col="mark")
    gone = leaks.select("mark").distinct()
    kept = docs.select(_held(docs), mark).join(gone, "mark", "left_anti")
    return _back(kept, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left into sequences of 2048 ids, with the ids themselves; null and repeated ids are packed like others."""
    return packing.pack(docs, queries.tokenizer_path(), with_ids=True)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]

#: The tokenizer's ids have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.stored(docs, f"stage{k}")
    return docs
