"""Line dedup by winnowing over line hashes. DataFrame functions only.

Lines with a word are hashed. A window is one line or two that have enough words, or any three lines. Each window
selects its rightmost smallest line hash as its fingerprint, so two equal runs are sure to share fingerprints.
Fingerprints found once in the corpus end there. Around the others the windows that selected them are compared:
a window's place is joined with the first place of the same window, matches that go on at the same distance are
extended both ways into runs, and all lines of later runs are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Lines of the longest window, and the words that make shorter ones count.
WIDTH, WORDS = 3, 12
#: Tasks that the places of one fingerprint or window are dealt to in joins.
SALTS = 4
BLANKS = " \t\r\x0b\x0c"


def hashed_lines(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, text_hash, lines) and more columns of docs: lines with a word, as (raw line number, number of words, two hashes)."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("core"), x.alias("x")))
    lines = F.transform(
        F.filter(numbered, lambda z: z["core"] != ""),
        lambda z: F.struct(z["i"].alias("i"), F.regexp_count(z["core"], F.lit(r"[^\x20\x09-\x0D]+")).alias("w"), F.xxhash64(z["x"]).alias("h"), F.crc32(z["x"].cast("binary")).alias("c")),
    )
    return docs.select("doc_id", "text", *more, F.xxhash64("text").alias("text_hash"), F.coalesce(lines, F.array().cast("array<struct<i:int,w:int,h:bigint,c:bigint>>")).alias("lines"))


def fingerprints(rows: DataFrame, width: int, words: int) -> DataFrame:
    """(place, mark, windows): each line that some window selects, its hash, and the windows (at, size, run, check) that select it.

    A window selects its rightmost smallest line hash, so each window stands with one fingerprint only. place orders
    rows by doc_id (nulls last), then text; at is the window's first line among the row's lines.
    """
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), "text_hash")
    # each line with its neighbours, so that no row carries a whole text
    near = F.transform("lines", lambda z, i: F.struct(i.alias("p"), *[(F.get("lines", i + k) if k else z).alias(f"l{k + width}") for k in range(1 - width, width)]))
    at = rows.select(place.alias("place"), F.explode(near).alias("z")).select("place", "z.*")

    def line(k: int) -> Column:
        return F.col(f"l{k + width}")

    found = []
    for size in range(1, width + 1):
        for o in range(size):
            own = [line(j - o) for j in range(size)]
            least = [own[o]["h"] <= own[j]["h"] if j < o else own[o]["h"] < own[j]["h"] for j in range(size) if j != o]
            selects = reduce(lambda a, b: a & b, least, own[o]["h"].isNotNull())
            if size < width:
                selects = selects & (sum((x["w"] for x in own), F.lit(0)) >= words)
            run, check = (F.xxhash64(F.lit(size), *[x[part] for x in own]) for part in ("h", "c"))
            found.append(F.when(F.coalesce(selects, F.lit(False)), F.struct((F.col("p") - o).alias("at"), F.lit(size).alias("size"), run.alias("run"), check.alias("check"))))
    return at.select("place", line(0)["h"].alias("mark"), F.array_compact(F.array(*found)).alias("windows")).filter(F.size("windows") > 0)


def met(df: DataFrame, keys: list[str], others: DataFrame, how: str) -> DataFrame:
    """df joined with others, which are unique in keys; each key is dealt to SALTS tasks, so that a common one fills none."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int"))
    every = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, [*keys, "salt"], how).drop("salt")


def repeated_runs(rows: DataFrame, width: int = WIDTH, words: int = WORDS) -> DataFrame:
    """(place, first, last, of_place, of_first): runs of lines, as long as they go, that match an earlier place."""
    marked = fingerprints(rows, width, words)
    marks = marked.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    shared = met(marked, ["mark"], marks, "left_semi").select("place", F.explode("windows").alias("w"))
    shared = saved(shared.select("place", "w.*"), "shared-windows")
    here = F.struct("place", "at")
    first = shared.groupBy("run", "check").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    matches = met(shared, ["run", "check"], first, "inner").filter(here > F.col("first"))
    matches = matches.select("place", "at", "size", F.col("first.place").alias("of_place"), F.col("first.at").alias("of_at"))
    # matches of a row with the same earlier row, at the same distance, that touch or overlap are one run
    along = Window.partitionBy("place", "of_place", "shift").orderBy("at", "size")
    reach = F.max(F.col("at") + F.col("size")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = matches.withColumn("shift", F.col("of_at") - F.col("at")).withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("at")).cast("int"))
    runs = fresh.withColumn("nth", F.sum("new").over(along)).groupBy("place", "of_place", "shift", "nth")
    runs = runs.agg(F.min("at").alias("first"), (F.max(F.col("at") + F.col("size")) - 1).alias("last"))
    return runs.select("place", "first", "last", "of_place", (F.col("first") + F.col("shift")).alias("of_first"))


def slices_without(items: Column, gone: Column) -> Column:
    """items without the places in the ascending list gone: the stretches between them, put together."""
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g + 1))
    ends = F.concat(gone, F.array(F.size(items)))
    return F.flatten(F.transform(F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: z["b"] > z["a"]), lambda z: F.slice(items, z["a"] + 1, z["b"] - z["a"])))


def dedup_lines(docs: DataFrame, width: int = WIDTH, words: int = WORDS) -> DataFrame:
    """(doc_id, text) as doc_id, n_lines, n_dropped, dropped, text: text without the lines of later repeated runs.

    A run is one or two lines of at least so many words, or at least width lines; it is later if the same lines
    stand at a smaller doc_id (nulls last, equal ids by text) or further up in the same text. Only lines with a word
    count; blank lines between them stay. dropped lists the places of deleted lines among the lines with words. A
    null text stays null, has no lines and loses none; rows that share a doc_id but not the text are documents of
    their own, also without doc_id, and rows equal in both are one document.
    """
    rows = hashed_lines(docs)
    gone = repeated_runs(rows, width, words).select("place", F.explode(F.sequence("first", "last")).alias("at"))
    gone = gone.groupBy(F.col("place.id").alias("_id"), F.col("place.text_hash").alias("_hash")).agg(F.sort_array(F.collect_set("at")).alias("gone"))
    texts = docs.select("doc_id", "text").withColumn("_text_hash", F.xxhash64("text"))
    met_rows = texts.join(gone, (F.col("_text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    out = hashed_lines(met_rows.select("doc_id", "text", "gone"), "gone")
    none = F.array().cast("array<int>")
    raw = F.transform("gone", lambda g: F.col("lines")[g]["i"])
    left = F.array_join(slices_without(F.split("text", "\n"), raw), "\n")
    return out.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(F.coalesce("gone", none)).cast("long").alias("n_dropped"),
        F.array_join(F.coalesce("gone", none).cast("array<string>"), ",").alias("dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs of lines: three lines, or fewer of twelve words together."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", "dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS core
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), p AS (
  SELECT *, core <> '' AS worded, sum((core <> '')::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, len(regexp_extract_all(core, '[^\x20\x09-\x0D]+')) AS w FROM l
), n AS (
  SELECT doc_id, pos, line, w, lead(line, 1) OVER o AS l1, lead(w, 1) OVER o AS w1, lead(line, 2) OVER o AS l2 FROM p WHERE worded WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), w AS (
  SELECT doc_id, pos, 1 AS size, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS rn FROM n WHERE w >= 12
  UNION ALL SELECT doc_id, pos, 2, row_number() OVER (PARTITION BY line, l1 ORDER BY doc_id, pos) FROM n WHERE l1 IS NOT NULL AND w + w1 >= 12
  UNION ALL SELECT doc_id, pos, 3, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, pos) FROM n WHERE l2 IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM w, (SELECT unnest([0, 1, 2]) AS k) WHERE rn > 1 AND k < size
), r AS (
  SELECT p.doc_id, sum(worded::INT)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_dropped,
         coalesce(string_agg(g.pos::BIGINT::VARCHAR, ',' ORDER BY g.pos) FILTER (WHERE g.pos IS NOT NULL), '') AS dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos AND p.worded GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped,
       md5(coalesce(kept, '')) AS text_md5, length(coalesce(kept, ''))::BIGINT AS n_chars_left
FROM documents d LEFT JOIN r USING (doc_id)
"""
