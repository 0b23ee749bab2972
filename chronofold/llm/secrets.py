"""Secret scans with an incremental blob ledger. DataFrame functions only.

Every version of every file is addressed by the SHA-256 of its content. The ledger remembers which blob was
scanned under which rule version; only unseen pairs are scanned, and findings are joined back to all the paths
and versions that hold the blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rules of version 1: kind, pattern, least length, group that the length is of.
BASE_RULES = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
]
#: Added by version 2: blocks of private keys, by their first line.
MORE_RULES = [("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0)]
RULES = {1: BASE_RULES, 2: BASE_RULES + MORE_RULES}
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
PIECES = "array<struct<rank:int,n:int,gap:int,long:int,fits:boolean>>"


def pieces_of(text: Column, rank: int, kind: str, pattern: str, least: int, group: int) -> Column:
    """The text as a rule's leftmost non-overlapping matches cut it: (rank, n, gap, long, fits) of each match and what stands before it.

    fits: the match is long enough. The last piece has no match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("long"), sized.alias("of"))

    def piece(z: Column, n: Column) -> Column:
        fits = F.coalesce(F.length(z["of"]), F.lit(0)) >= least
        return F.struct(F.lit(rank).alias("rank"), n.alias("n"), F.length(z["gap"]).alias("gap"), F.coalesce(F.length(z["long"]), F.lit(0)).alias("long"), fits.alias("fits"))

    # most texts hold no match: one search decides
    return F.when(text.rlike(pattern), F.transform(zipped, piece)).otherwise(F.array().cast(PIECES))


def scan(blobs: DataFrame, rules: list) -> DataFrame:
    """(blob, text) as (blob, spans), blobs with spans alone: sorted by start, then by the rule's place in the list.

    A span is a match that fits, in code points, its end exclusive: the lengths before it add up to its start. Rows
    that repeat a blob count once.
    """
    pieces = blobs.select("blob", F.explode(F.concat(*[pieces_of(F.col("text"), i, *rule) for i, rule in enumerate(rules)])).alias("z"))
    pieces = pieces.select("blob", "z.*").dropDuplicates(["blob", "rank", "n"])
    so_far = Window.partitionBy("blob", "rank").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = pieces.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(so_far).cast("int")).filter("fits")
    kind = F.element_at(F.array(*[F.lit(kind) for kind, *_ in rules]), F.col("rank") + 1)
    span = F.struct((F.col("end") - F.col("long")).alias("start"), "rank", kind.alias("kind"), "end")
    return ends.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan_versions(versions: DataFrame, rule_version: int, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every (path, version, text), and the ledger (blob, rule_version, spans) grown by what was unseen.

    A null text is the empty blob. Copies of a blob are scanned once: the lowest (path, version) stands for it.
    Rows without path are blobs like others. An empty table leaves the ledger as it was.
    """
    text = F.coalesce("text", F.lit(""))
    named = saved(versions.select("path", "version", F.sha2(text, 256).alias("blob")), "versions")
    unseen = named.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    unseen = saved(unseen.select("blob", F.col("at.path").alias("_path"), F.col("at.version").alias("_version")), "unseen")
    sources = versions.select("path", "version", text.alias("text"))
    same = sources["path"].eqNullSafe(F.col("_path")) & sources["version"].eqNullSafe(F.col("_version"))
    blobs = sources.join(unseen, same).filter(F.sha2("text", 256) == F.col("blob")).select("blob", "text")
    found = unseen.select("blob").join(scan(blobs, RULES[rule_version]), "blob", "left")
    scanned = found.select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    grown = saved(scanned, "ledger") if ledger is None else ledger.unionByName(saved(scanned, "ledger"))
    fitting = grown.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    findings = named.join(fitting, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    return findings, grown


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document is one version of the path doc_id; the ledger starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    findings, _ = scan_versions(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"), 2)
    base_spans = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return findings.select(F.col("path").alias("doc_id"), *[count(kind) for kind, *_ in BASE_RULES], F.sha2(listed(base_spans), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), p AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, 6 AS least, string_split_regex(text, ASSIGN) AS gaps, regexp_extract_all(text, ASSIGN) AS found, regexp_extract_all(text, ASSIGN, 2) AS sized FROM t
  UNION ALL SELECT doc_id, 1, 'access', 20, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT doc_id, 2, 'hex', 24, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM t
  UNION ALL SELECT doc_id, 3, 'private', 1, string_split_regex(text, PRIVATE_RULE), regexp_extract_all(text, PRIVATE_RULE), regexp_extract_all(text, PRIVATE_RULE) FROM t
), m AS (
  SELECT doc_id, rank, kind, least, n, length(gaps[n]) AS gap, length(found[n]) AS long, length(sized[n]) AS of FROM (SELECT *, unnest(range(1, len(found) + 1)) AS n FROM p)
), e AS (
  SELECT *, sum(gap + long) OVER (PARTITION BY doc_id, rank ORDER BY n) AS fin FROM m
), s AS (
  SELECT doc_id, rank, fin - long AS start, kind || ':' || (fin - long)::BIGINT::VARCHAR || ':' || fin::BIGINT::VARCHAR AS span FROM e WHERE of >= least
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS k, count(*) FILTER (WHERE rank = 2) AS h,
         string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id
)
SELECT t.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
""".replace("ASSIGN", r"""'(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""").replace("PRIVATE_RULE", "'-----BEGIN [A-Z ]*PRIVATE KEY-----'")
