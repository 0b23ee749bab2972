"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / quality, u being a hash of its id in (0, 1): ordering by it ascending is
weighted sampling without replacement. A source gives whole epochs as long as its target allows, then the
documents with the smallest keys until their sizes come to the rest. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, running, saved, small_enough, word_count

#: Buckets per unit of ln(key). The share of a bucket in its source is below 1 / FINE, whatever the qualities.
FINE = 1024


def water_levels(sizes: DataFrame, weights: list[int], total: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh as in weights, again and again. Together they get total times all
    sizes; none gets more than cap times its own size, and the excess goes to the others by weight, until no one
    is above: sorted by cap / weight, a source is capped while its cap lies under the common level. Ranks and
    sums run over ranges of sources, so there may be millions of them.
    """
    n, everything = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    named, _ = ranked(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "_nth", n)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_nth", F.lit(len(weights))) + 1).cast("int"))
    rows = named.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    ratio = F.col("_cap") / F.col("_w")
    rows = running(rows, [ratio, F.col("source").asc_nulls_last()], {"_c": F.col("_cap"), "_wb": F.col("_w")}, n)
    all_w = float(sum(weights) * (n // len(weights)) + sum(weights[: n % len(weights)]))
    rows = rows.withColumn("_level", (F.lit(everything * float(total)) - F.col("_c")) / (F.lit(all_w) - F.col("_wb"))).withColumn("_full", ratio <= F.col("_level"))
    # the first source that is not full sets the level of all that are not
    free = rows.filter(~F.col("_full")).agg(F.min(F.struct(ratio, F.col("_level").alias("level")))["level"]).first()[0]
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.lit(0.0 if free is None else free))
    return rows.select("source", "source_size", target.alias("target"))


def sample_key(doc_id, quality, seed: str):
    """-ln(u) / quality; u in (0, 1) from 48 bits of md5, so reruns and other engines get the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.ln(u) / quality


def mix(docs: DataFrame, weights: list[int], total: float = 1.0, cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, quality) with source_size, target and times: how often the mix takes the document.

    Other columns of docs are left out.
    Sizes of null count 0, qualities of null or below 0.01 count 0.01. The last, partial epoch stops at the
    document whose middle passes the rest of the target, so a source misses it by half a document at most. Equal
    keys go by doc_id, then size; rows equal in all three are interchangeable. Empty tables stay empty.
    A hot source is never in one task: sizes are summed by key bucket, and only the one bucket of each source in
    which the rest of its target ends is put in order.
    """
    docs = docs.select("doc_id", "source", "size", "quality")
    size = F.coalesce("size", F.lit(0)).cast("long")
    quality = F.greatest(F.coalesce("quality", F.lit(0.01)), F.lit(0.01))
    rows = docs.withColumn("size", size).withColumn("_key", sample_key(F.col("doc_id"), quality, seed))
    rows = saved(rows.withColumn("_bucket", F.floor(F.ln("_key") * FINE)), "mix")
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_size"))
    buckets = saved(buckets, "mix-buckets")
    targets = water_levels(buckets.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, total, cap)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(F.lit(0))
    targets = targets.withColumn("_epochs", epochs.cast("long")).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    in_order = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = buckets.withColumn("_end", F.sum("_size").over(in_order))
    ends = ends.withColumnsRenamed({"source": "_s"}).join(targets, F.col("_s").eqNullSafe(F.col("source")))
    edge = ends.filter(F.col("_end") > F.col("_rest")).groupBy("source").agg(F.min(F.struct("_bucket", (F.col("_end") - F.col("_size")).alias("_before"))).alias("_edge"))
    plan = targets.withColumnsRenamed({"source": "_s"}).join(edge.withColumnsRenamed({"source": "_e"}), F.col("_s").eqNullSafe(F.col("_e")), "left")
    plan = saved(plan.select("_s", "source_size", "target", "_epochs", "_rest", F.col("_edge._bucket").alias("_at"), F.col("_edge._before").alias("_before")), "mix-plan")
    rows = rows.join(small_enough(plan), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    on_edge = F.coalesce(F.col("_bucket") == F.col("_at"), F.lit(False))
    whole = rows.filter(~on_edge).withColumn("_more", (F.col("_at").isNull() | (F.col("_bucket") < F.col("_at"))) & (F.col("_rest") > 0))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_before") + F.sum("size").over(inside) - F.col("size") / 2
    edge_rows = rows.filter(on_edge).withColumn("_more", (middle <= F.col("_rest")) & (F.col("_rest") > 0))
    out = whole.unionByName(edge_rows).withColumn("times", (F.col("_epochs") + F.col("_more").cast("long")).cast("long"))
    return out.drop("_key", "_bucket", "_at", "_before", "_epochs", "_rest", "_more")


def text_quality(text):
    """1 for clean prose, down to 0.1 as symbols take over."""
    n = F.greatest(F.length(text), F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), 1.0 - 4.0 * symbols / n)


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words of each document that a mix with weights 1, 2, 3 of all words takes. Null ids share one key."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_quality(F.col("text")).alias("quality"))
    out = mix(rows, [1, 2, 3])
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("times") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         greatest(0.1, 1.0 - 4.0 * coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0)::DOUBLE / greatest(coalesce(length(text), 1), 1)) AS quality
  FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / quality AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS t FROM s
), l AS (
  SELECT *, (t - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, CASE WHEN cap / w <= lvl THEN cap ELSE w * (SELECT min(lvl) FROM l m WHERE m.cap / m.w = (SELECT min(cap / w) FROM l WHERE cap / w > lvl)) END AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM g
), p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size / 2.0 AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target, ((epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""
