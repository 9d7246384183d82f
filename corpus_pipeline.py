"""From raw documents to packed training sequences, in five stages of operators of textloom.llm.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns of
docs. Defined results for all stages: null texts and nulls in any other column go through without
harm; rows with a null doc_id are kept by the stages that compare ids (they equal no other row);
empty tables stay empty; extra columns of any name are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import discard, discard_since, made_tables, materialize, table, without_ids
from textloom.llm.countmin_dedup import dedup_substrings
from textloom.llm.decontaminate import contamination
from textloom.llm.jaccard_join import jaccard_join
from textloom.llm.language_id import identify, train
from textloom.llm.packing import pack

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; those without letters, or unlike all languages, go."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), "doc_id", "text", "lang", "source")
    return identify(rows, train(docs), declared=F.col("lang"), host=F.col("source"), carry=("whole",)).where("kept").select("whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of links (five words, similarity of 0.8 or more).
    Of rows that repeat doc_id and text, one stays."""
    linked = materialize(jaccard_join(docs, n=5, num=80, den=100), "linked")
    left = without_ids(docs, linked.where("component_id <> doc_id"))
    twice = materialize(linked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left
    again = left.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return without_ids(left, twice).unionByName(again)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words under 13-word windows that start in a smaller doc_id too; the words that are left
    are joined by single spaces, and a text that loses none stays as it is. n_chars follows the text.
    A document that loses all its words goes."""
    # the text itself comes back from the operator, so only the other columns are carried along
    others = [c for c in docs.columns if c != "text"]
    got = dedup_substrings(docs, carry=F.struct(F.struct(*(F.col(f"`{c}`") for c in others)).alias("others"), F.col("text").isNull().alias("no_text")))
    got = got.where("n_removed = 0 OR n_removed < n_words")
    new = {"text": F.when(~F.col("row.no_text"), F.col("kept_text"))}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("row.others.n_chars"))
    return got.select(*((new[c] if c in new else F.col(f"row.others.`{c}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, found.where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a row for each piece."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first and the last stage can't be expressed in SQL; a test compares run() with a brute-force chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage wrote for itself, and its input, are deleted when the next is made."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = made_tables()
        done = materialize(stage(spark, docs, sf_dir), name)
        discard_since(before, done)
        discard(docs)
        docs = done
    return docs
