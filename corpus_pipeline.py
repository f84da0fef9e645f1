"""A training corpus from ``documents``: language, quality, near duplicates, repeated passages, packing.

Each stage takes all that the one before kept and returns the columns of ``documents``; the last returns pieces
of packed sequences.  ``run`` writes and rereads every stage's rows in the shared folder, and removes a stage's table once the next one stands.

Contract of all stages: extra columns pass on whatever their names, but for the last stage, which ignores them; empty tables give empty
tables; texts are read whole, however long; the order of rows has no meaning.  A null text has no language and goes with the first stage; the
later stages take it as they say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.llm import langid, ngram_join, packing, quality, substring
from planewise.llm.common import remove, small_batches, written

#: Near duplicates here: five-word shingles, Jaccard 0.8 or more.
SHINGLE, PERCENT = 5, 80
TOKENIZER = "word_bpe_49k.json"
#: A digest of id and text, by which rows without an id or of a repeated one are told apart.
_KEY = "_near_duplicates_key"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.

    Null text, text without a letter and text that no learned language accepts go; a null id stays; of repeated rows all stay or all go.
    Nothing is learned from rows without ``lang``; with nothing to learn from every row goes.
    """
    small_batches(spark)
    return langid.keep_known(docs, langid.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null text is judged as empty text; a null id stays; of repeated rows all stay or all go; without labels of both classes every
    row has the share of label 1 as its score (0.5 without any label).
    """
    small_batches(spark)
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, that of the smallest id (rows without an id last) and text digest; one of rows equal in id and text.

    Null text and text without words have no shingles and link with nothing, so they stay.
    """
    small_batches(spark)
    names, keyed = docs.columns, docs.withColumn(_KEY, F.xxhash64("doc_id", "text"))
    found = ngram_join.component_table(keyed.select(_KEY, "text"), id_col=_KEY, size=SHINGLE, percent=PERCENT).select(F.col("doc_id").alias(_KEY), "component_id")
    links = found.where(f"component_id < {_KEY}").distinct()
    members = written(links.union(links.select("component_id", "component_id").distinct()), "members")
    ids = keyed.select(_KEY, "doc_id").join(members, _KEY)
    stay = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _KEY)).alias("x")).select(f"x.{_KEY}")
    # a table of its own, so that Spark knows its size and moves documents only if it is large
    gone = written(members.select(_KEY).join(stay, _KEY, "left_anti"), "gone")
    kept = keyed.join(gone, _KEY, "left_anti").select(*names, _KEY)
    repeated = found.groupBy(_KEY).agg(F.count("*").alias("n")).where("n > 1").select(_KEY)
    if not repeated.limit(1).count():
        return kept.select(*names)
    once = kept.join(repeated, _KEY, "left_semi").dropDuplicates([_KEY])
    return kept.join(repeated, _KEY, "left_anti").select(*names).union(once.select(*names))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier in the corpus go; every document stays, with what is its own.

    Null text stays null; rows equal in id and text are one document; ``n_chars`` is counted anew (null for null text).
    """
    small_batches(spark)
    done = substring.dedup_substrings(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences.

    Null text is empty text, one separator; a null id is packed like any other; each of repeated rows is packed for itself.
    """
    small_batches(spark)
    pieces = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: SQL has neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if made is not None:
            remove(made)
        made = docs
    return STAGES[-1][1](spark, docs, sf_dir)
