"""A corpus pipeline: drop toxic documents, keep one of each near-duplicate group, cut repeated
passages, interleave the sources by weight, and encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs, whatever their names. Rows with null ids or texts pass every stage; rows that repeat a doc_id with another text
are documents of their own, and of rows that repeat both one stays from the near-duplicate stage on.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm import mixing, near_texts, pieces, suffixes, toxicity
from keelson.llm.common import cut, shared_folder, table

#: Words of the shortest repeated passage that is cut: more than 50.
PASSAGE_WORDS = 51


def own_names(stage):
    """Rename columns that begin with two underscores while a stage that returns the columns of docs works on them."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = {c: f"held{i}:{c}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        if not held:
            return stage(spark, docs, sf_dir)
        return stage(spark, docs.withColumnsRenamed(held), sf_dir).withColumnsRenamed({v: k for k, v in held.items()})

    return run


@own_names
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of these documents, doesn't call toxic."""
    model = toxicity.train(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_texts(docs, model).where(F.col("__score") < 0.5).select(*docs.columns)


@own_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group of texts linked by a Jaccard similarity of 0.8 or more."""
    found = near_texts.near_texts(docs.select("doc_id", "text"))
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    marked = docs.withColumn("__print", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = marked.join(dropped, (marked["doc_id"] == dropped["__doc"]) & (marked["__print"] == dropped["__hash"]), "left_anti")
    repeated = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "text_hash").count().where(F.col("count") > 1)
    if not repeated.isEmpty():
        kept = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "__print"]).unionByName(kept.where(F.col("doc_id").isNull()))
    return kept.drop("__print")


@own_names
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur elsewhere too; n_chars follows the text."""
    text = F.coalesce("text", F.lit(""))
    # the text travels once, as bytes; whether it was null goes with the other columns
    others = F.struct(*(c for c in docs.columns if c != "text"), F.col("text").isNull().alias("__no_text"))
    rows = docs.select(others.alias("row"), suffixes.text_id(F.col("doc_id")).alias("id"), F.xxhash64(text).alias("print"), text.cast("binary").alias("data"))
    out = suffixes.remove_passages(rows, PASSAGE_WORDS)
    new = {"text": F.when(~F.col("row.__no_text"), F.col("__text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("__spans") > 0, F.char_length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


@own_names
def interleave(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix by mixing.TARGET."""
    return mixing.mix(docs, mixing.TARGET).orderBy("__place").select(*docs.columns)


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text) of docs with __place, from 0: where interleave has put each row.

    Files are numbered as the sorted partitions that they hold, but Spark reads them in an order of its own,
    so the place is that of the file and of the row in it. Rows that don't come straight from files are mixed here.
    """
    names = ["doc_id", "source", "text"]
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return mixing.mix(docs, mixing.TARGET).select(*names, "__place")
    part, piece = (F.regexp_extract("_metadata.file_name", p, 1).try_cast("long") for p in (r"^part-(\d+)", r"-c(\d+)\."))
    order = F.struct(part.alias("part"), piece.alias("piece"), F.col("_metadata.file_path").alias("path"))
    spots = docs.select(*names, order.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    before = F.sum("count").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    sizes = spots.groupBy("__file").count().select(F.col("__file.path").alias("__path"), F.coalesce(before, F.lit(0)).alias("__before"))
    return spots.join(F.broadcast(sizes), F.col("__file.path") == F.col("__path")).select(*names, (F.col("__before") + F.col("__row")).alias("__place"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document in the order of the mix, its place in it, and whether the ids give its text back."""
    # sorted before, so that the tokenizer's workers and the sort don't hold memory at the same time
    mixed = cut(placed(docs).orderBy("__place"))
    out = pieces.tokenize(mixed)
    restored = (F.col("__decoded") == F.coalesce("text", F.lit(""))).alias("restored")
    return out.select("doc_id", "source", F.col("__place").alias("place"), F.size("__ids").alias("n_ids"), F.col("__ids").alias("ids"), restored)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", interleave),
    ("sentencepiece", encode),
]

#: Neither a classifier's fit nor a tokenizer can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again; what a stage has read is removed once its own rows are written."""
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(now := f"{folder}/{i}-{name}")
            docs = spark.read.parquet(now)
            if before:
                path = spark._jvm.org.apache.hadoop.fs.Path(before)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            before = now
    return docs
