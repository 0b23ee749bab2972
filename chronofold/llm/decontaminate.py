"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

The index holds a posting (term, row, position) for every training token that some test item has. Each test phrase
starts from the postings of its rarest term, shifted by the term's place in the phrase to where the phrase would
begin; the shifted lists of its other terms are intersected with those by equality joins. Beginnings that all terms
agree on are exact matches; where the rarest terms lie within a few words of their places, it's a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, saved, small_enough

#: Any run of these separates words: ASCII but for digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in order; an empty list for null or wordless texts."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), NOT_WORD), ""), F.array().cast("array<string>"))


def phrases_of(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(phrase, words) and its owners (phrase, item_id): windows of width consecutive words of (item_id, text).

    A shorter item is one window; items without words have none. phrase is a number.
    """
    words = items.select("item_id", words_of(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    windows = words.select("item_id", "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - width, F.lit(0)))).alias("_i"))
    windows = windows.select("item_id", F.slice("_w", F.col("_i") + 1, width).alias("words"))
    windows = saved(windows.withColumn("name", F.sha2(F.array_join("words", " "), 256)).distinct(), "item-windows")
    phrases = windows.groupBy("name").agg(F.first("words").alias("words")).withColumn("phrase", F.monotonically_increasing_id())
    phrases = saved(phrases, "phrases")
    owners = windows.select("name", "item_id").join(phrases.select("name", "phrase"), "name").select("phrase", "item_id")
    return phrases.select("phrase", "words"), saved(owners, "owners")


def build_index(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (term, row, position) of (row, words) for the terms in (word, term)."""
    tokens = rows.select("row", F.posexplode("words").alias("position", "word"))
    return saved(tokens.join(small_enough(vocabulary), "word").select("term", "row", "position"), "postings")


def rarest_terms(places: DataFrame, frequency: DataFrame, lists: int) -> DataFrame:
    """(phrase, rank, term, at, lists): the rarest distinct terms of each phrase with their first places, rank 1 the rarest.

    places: (phrase, at, term). Phrases with a term that the index lacks occur nowhere and are left out.
    """
    first = places.groupBy("phrase", "term").agg(F.min("at").alias("at"))
    known = first.join(small_enough(frequency), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = Window.partitionBy("phrase")
    known = known.withColumn("least", F.min("n").over(every)).withColumn("rank", F.row_number().over(every.orderBy("n", "term")))
    kept = known.filter((F.col("least") > 0) & (F.col("rank") <= lists))
    return kept.select("phrase", "rank", "term", "at", F.max("rank").over(every).alias("lists"))


def blocks_of(postings: DataFrame, width: int) -> DataFrame:
    """(term, row, block, bits): which positions of each block of width words hold the term."""
    bit = F.expr(f"shiftleft(1L, cast(position % {width} as int))")
    return postings.groupBy("term", "row", F.expr(f"cast(position div {width} as int)").alias("block")).agg(F.bit_or(bit).alias("bits"))


def phrase_matches(postings: DataFrame, phrases: DataFrame, vocabulary: DataFrame, lists: int = 3, slack: int = 10) -> tuple[DataFrame, DataFrame]:
    """Exact matches (phrase, row, start, length) and proximity matches (phrase, row) of phrases in the index.

    Proximity: the phrase's rarest terms, shifted to a common start, lie within slack words of the rarest one. All
    joins are on a term or on (term, row, block of words), so their work grows with the postings, however often a
    text repeats a term.
    """
    width = 2 * slack + 1
    if not 0 <= slack <= 30:
        raise ValueError("slack must be 0 to 30")
    places = phrases.select("phrase", F.posexplode("words").alias("at", "word")).join(vocabulary, "word").select("phrase", "at", "term")
    places = saved(places, "places")
    frequency = saved(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "frequency")
    probes = saved(rarest_terms(places, frequency, lists), "probes")
    first = probes.filter("rank = 1").select("phrase", "term", "at", "lists")
    found = postings.join(small_enough(first), "term").select("phrase", "row", (F.col("position") - F.col("at")).alias("start"), "lists", F.lit(True).alias("same"))
    for k in range(2, lists + 1):
        probe = probes.filter(F.col("rank") == k).select("phrase", "term", "at")
        wanted = found.filter(F.col("lists") >= k).join(small_enough(probe), "phrase").withColumn("_x", F.col("start") + F.col("at"))
        ends = [F.floor((F.col("_x") + d) / width).cast("int") for d in (-slack, slack)]
        wanted = wanted.withColumn("block", F.explode(F.array_distinct(F.array(*ends))))
        other = blocks_of(postings.join(small_enough(probe.select("term").distinct()), "term", "left_semi"), width)
        met = wanted.join(other, ["term", "row", "block"])
        # which bits of the block lie within slack of _x, and which one is _x
        at = F.col("_x") - F.col("block") * width
        low, high = F.greatest(at - slack, F.lit(0)), F.least(at + slack, F.lit(width - 1))
        near = F.expr("shiftleft(1L, cast(_high + 1 as int)) - shiftleft(1L, cast(_low as int))")
        same = (at >= 0) & (at < width) & (F.getbit("bits", F.least(F.greatest(at, F.lit(0)), F.lit(width - 1)).cast("int")) == 1)
        met = met.withColumns({"_low": low, "_high": high}).filter(F.col("bits").bitwiseAND(near) != 0)
        met = met.groupBy("phrase", "row", "start", "lists").agg(F.max(F.col("same") & same).alias("same"))
        found = saved(found.filter(F.col("lists") < k).unionByName(met), "candidates")
    sizes = phrases.select("phrase", F.size("words").alias("length"))
    near = found.select("phrase", "row").distinct().join(small_enough(sizes.filter("length > 1")), "phrase", "left_semi")
    # what the rarest terms agree on, intersected with the lists of all terms
    strict = found.filter((F.col("start") >= 0) & F.col("same")).select("phrase", "row", "start").distinct()
    strict = saved(strict, "strict")
    whole = strict.join(small_enough(places), "phrase").withColumn("_x", F.col("start") + F.col("at"))
    whole = whole.withColumn("block", F.floor(F.col("_x") / width).cast("int"))
    there = blocks_of(postings.join(small_enough(strict.select("row").distinct()), "row", "left_semi"), width)
    agreed = whole.join(there, ["term", "row", "block"]).filter(F.getbit("bits", F.pmod("_x", F.lit(width)).cast("int")) == 1)
    agreed = agreed.groupBy("phrase", "row", "start").agg(F.count(F.lit(1)).alias("n")).join(small_enough(sizes), "phrase").filter("n = length")
    return saved(agreed.select("phrase", "row", "start", "length"), "matches"), near


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    A word is hit if it lies in any occurrence of a window of width words of an item; a document is contaminated
    if at least one word in share is hit. Every row is judged by itself, also where its doc_id is null or shared.
    Null and empty texts have no words and no hits. Items without words match nothing. Texts are cut into words once.
    """
    words = words_of(F.col("text"))
    rows = docs.select("doc_id", words.alias("words")).withColumn("n_words", F.size("words").cast("long")).withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows, "worded")
    phrases, owners = phrases_of(items.select("item_id", "text"), width)
    vocabulary = phrases.select(F.explode("words").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id())
    vocabulary = saved(vocabulary, "vocabulary")
    exact, near = phrase_matches(build_index(rows.select("row", "words"), vocabulary), phrases, vocabulary)
    covered = exact.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).distinct()
    hits = covered.groupBy("row").agg(F.count(F.lit(1)).alias("_hit"))
    owners = small_enough(owners)
    named = exact.select("row", "phrase").distinct().join(owners, "phrase").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    listed = named.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    close = near.join(owners, "phrase").select("row", "item_id").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("_near"))
    found = saved(hits.join(listed, "row", "full").join(close, "row", "full"), "hits")
    out = rows.select("row", "doc_id", "n_words").join(found, "row", "left")
    items_list = F.coalesce("_items", F.array().cast("array<string>"))
    out = out.select(
        "doc_id", "n_words", F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_list).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_list, ","), 256).alias("items_sha256"), F.coalesce("_near", F.lit(0)).cast("long").alias("n_near_items"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: windows of thirteen words, one word in twenty hit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[s:s + least(len(ws), 13) - 1], ' ') AS p
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS s FROM i WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS p
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)
), m AS (
  SELECT dw.doc_id, dw.s, dw.k, iw.item_id FROM dw JOIN iw ON dw.p = iw.p AND dw.k = iw.k
), h AS (
  SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM (SELECT DISTINCT doc_id, s, k FROM m)) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
"""
