"""A corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Every stage takes what its predecessor kept. All but the last return the columns of documents; other columns are left
out. Rows are judged by doc_id and text, so null and shared ids lose no text. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import saved, small_enough, word_count
from chronofold.llm.decontaminate import decontaminate
from chronofold.llm.mixing import mix, text_quality
from chronofold.llm.near_dup import near_duplicates
from chronofold.llm.sharding import hilbert_shards, text_crc32, text_size
from chronofold.llm.toxicity import THRESHOLD, learn_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_key(docs: DataFrame) -> Column:
    """doc_id with a hash of the text: names a row also where ids are null or shared. Never null; ids sort first, in order."""
    nothing = F.lit(0 if docs.schema["doc_id"].dataType.typeName() != "string" else "").cast(docs.schema["doc_id"].dataType)
    text = F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b""))
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", nothing).alias("id"), text.alias("text_md5"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text), doc_id being the row's key: what the operators judge, so that a verdict holds for one text only."""
    return docs.select(row_key(docs).alias("doc_id"), "text")


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose keys are in rejected."""
    keys = small_enough(saved(rejected.select(F.col("doc_id").alias("_key")).distinct(), "rejected"))
    return docs.select(*COLUMNS, row_key(docs).alias("_key")).join(keys, "_key", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled rows among docs. Null and empty texts score as texts without terms do."""
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, score_toxicity(keyed(docs), model).filter(F.col("score") >= THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8. Rows equal in doc_id and text become one."""
    left = without(docs, near_duplicates(keyed(docs)).filter(~F.col("kept")))
    return left.withColumn("_key", row_key(left)).dropDuplicates(["_key"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no window of a benchmark item covers one word in twenty. Null and empty texts stay."""
    return without(docs, decontaminate(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole epochs first, then the sampled part. Texts without words are sampled like others."""
    keys = docs.select(*COLUMNS, row_key(docs).alias("_key"))
    rows = keys.select(F.col("_key").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), text_quality(F.col("text")).alias("quality"))
    times = mix(rows, [1, 2, 3]).filter("times > 0").select(F.col("doc_id").alias("_key"), "times").dropDuplicates(["_key"])
    taken = keys.join(times, "_key")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*COLUMNS)


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot, by language, source and size along the Hilbert curve."""
    sized = docs.select(*COLUMNS, text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    return hilbert_shards(sized, ["lang", "source", "size"], 24, ["doc_id", "text_crc32"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_corpus),
]

#: SQL can't express the nearest-example votes or the link components; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage gives is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
