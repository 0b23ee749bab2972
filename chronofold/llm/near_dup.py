"""MinHash near-dedup with b-bit signatures.

Texts with equal shingle sets form one class at once. Class representatives get minima under many hash
functions: whole minima name the buckets of each band, their low bits are packed into a signature. Pairs from
shared buckets pass if the collision-corrected estimate from the signatures' differing bits is near enough, and are
then confirmed on full shingle sets. Links join into components by min-label propagation with shortcuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WordHashes, mixed, saved, small_enough, tasks_for

#: 40 bands of 5 minima: a pair at 0.8 shares no bucket with probability (1 - 0.8**5)**40, about 1e-7.
BANDS, ROWS = 40, 5
#: Low bits kept of each minimum.
BITS = 2
#: Pairs estimated this far below the threshold are dropped: over five standard deviations of 200 minima at 0.8.
MARGIN = 0.18
#: Buckets up to this size give all pairs; larger ones give stars, and then what the stars left open.
ALL_PAIRS = 24
#: Tasks that a family's members are dealt to where those off its centre meet them.
SALTS = 16
#: Minima of the finer signatures, and their margin: five standard deviations again.
FINE, FINE_MARGIN = 2048, 0.053


def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingle_set(raw: bytes, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of width words; a shorter sequence is one shingle."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    out = np.zeros(max(1, len(h) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(h))):
            out = mixed(out * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + len(out)] + np.uint64(k + 1))
        if len(h) < width:
            out = mixed(out + np.uint64(len(h)))
    return np.unique(out)


def set_name(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def minima(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(least, (s[at : at + 512, None] * factors[None, :]).min(axis=0), out=least)
    return mixed(least)


def pack(least: np.ndarray) -> np.ndarray:
    """The low bits of minima in 64-bit limbs."""
    low = (least & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits = ((low[:, None] >> np.arange(BITS)) & 1).astype(np.uint8).ravel()
    return np.packbits(np.pad(bits, (0, -len(bits) % 64))).view(np.uint64)


def signature(s: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one hash per band, packed low bits) of a set's minima."""
    least = minima(s, factors)
    bands, grid = np.zeros(BANDS, np.uint64), least.reshape(BANDS, ROWS)
    for k in range(ROWS):
        bands = mixed(bands * np.uint64(0xBF58476D1CE4E5B9) + grid[:, k])
    return bands, pack(least)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, name, bands, bits) of each row; name, bands and bits are null for empty sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = WordHashes(), multipliers(BANDS * ROWS)
        for batch in batches:
            sizes, names, bands, bits = [], [], [], []
            for raw in batch.column(1):
                s = shingle_set(raw.as_py() or b"", hashes, width)
                sizes.append(len(s))
                if len(s):
                    b, p = signature(s, factors)
                    names.append(set_name(s))
                    bands.append(b.view(np.int64))
                    bits.append(p.view(np.int64))
                else:
                    names.append(None), bands.append(None), bits.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=schema.names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("name", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text")).mapInArrow(sketch, schema)


def estimate(a: Column, b: Column, count: int) -> Column:
    """Similarity from two packed signatures: matching minima, corrected for low bits that agree by chance.

    Two bits differ if either does: the odd bits fold onto the even ones before counting.
    """
    even = sum(1 << i for i in range(0, 64, 2))
    fold = lambda x: x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(even))
    limbs = -(-count * BITS // 64)
    differ = sum((F.bit_count(fold(a[i].bitwiseXOR(b[i]))) for i in range(limbs)), F.lit(0))
    chance = 0.5**BITS
    return (1.0 - differ / float(count) - chance) / (1.0 - chance)


def shingle_sets(names: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(name, shingles) of the classes in (name, rep), from the whole texts of their representatives.

    rep is a row's doc_id, which may be null, and the hash of its text.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found: dict[bytes, np.ndarray] = {}
                for raw, want in zip(part.column(0), part.column(1), strict=True):
                    s = shingle_set(raw.as_py() or b"", hashes, width)
                    if len(s) and set_name(s) == want.as_py():  # hashes of two texts may be equal
                        found[want.as_py()] = s
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([s.tobytes() for s in found.values()], pa.binary())], names=["name", "shingles"])

    wanted = small_enough(names.select(F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash"), "name"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    texts = docs.select("doc_id", "text").join(wanted, same).select(F.col("text").cast("binary").alias("text"), "name").dropDuplicates(["name"])
    schema = T.StructType([T.StructField("name", T.BinaryType()), T.StructField("shingles", T.BinaryType())])
    return saved(texts.mapInArrow(named, schema), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set names whose full sets are similar enough."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(judge, T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])).distinct()


def fine_bits(sets: DataFrame) -> DataFrame:
    """(name, fine): low bits of many more minima, for the few classes whose coarse estimates leave too much open."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(BANDS * ROWS + FINE)[BANDS * ROWS :]
        for batch in batches:
            packed = [pack(minima(np.frombuffer(raw.as_buffer(), np.uint64), factors)).view(np.int64) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.list_(pa.int64()))], names=["name", "fine"])

    return sets.select("name", "shingles").mapInArrow(each, T.StructType([T.StructField("name", T.BinaryType()), T.StructField("fine", T.ArrayType(T.LongType()))]))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of each linked node's component, from links (a, b).

    Each round, every node takes the smallest label among its own, its neighbours' and its label's own label;
    rounds grow with the logarithm of a component's length. Labels are written to the shared folder each round, by
    as many tasks as the number of links asks for.
    """
    tasks = tasks_for(links.sparkSession, 2 * links.count())
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links", tasks)
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-0", tasks)
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        hop = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        taken = labels.join(near.withColumnRenamed("a", "node"), "node").withColumn("via", F.least("root", "m"))
        new = taken.join(hop, "via").select("node", F.least("via", "far").alias("root"), (F.least("via", "far") != F.col("root")).alias("changed"))
        new = saved(new, f"{name}-{step}", tasks)
        labels = new.select("node", "root")
        if new.filter("changed").isEmpty():
            return labels


def all_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) from (bucket, name) of small buckets."""
    # at most ALL_PAIRS names in a list
    lists = rows.groupBy("bucket").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return lists.select("names", F.posexplode("names").alias("i", "b")).filter("i > 0").select(F.explode(F.slice("names", F.lit(1), F.col("i"))).alias("a"), "b")


def centred(large: DataFrame) -> DataFrame:
    """(bucket, name, n) of large buckets with each bucket's centre: the member that meets most others over all its buckets.

    In a family of copies that is the text they were made from, or the copy nearest to it.
    """
    met = large.groupBy("name").agg(F.sum("n").alias("met"))
    best = large.join(met, "name").groupBy("bucket").agg(F.max(F.struct("met", "name"))["name"].alias("centre"))
    return large.join(best, "bucket")


def leftovers(members: DataFrame, percent: int, salts: int = SALTS) -> DataFrame:
    """(a, b): members (family, name, root, fine) off their centre's component with the family's others, if near enough.

    A pair is judged by its finer signatures and given only if near; the others of a family are dealt to several
    tasks, and each of those meets the members that are off.
    """
    off = members.filter(F.col("root") != F.col("family")).select(F.col("family").alias("of"), F.col("name").alias("b"), F.col("root").alias("rb"), F.col("fine").alias("y"))
    off = off.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int"))
    once = (F.col("root") == F.col("family")) | (F.col("name") < F.col("b"))  # two members that are both off meet once
    near = once & (F.col("root") != F.col("rb")) & (estimate(F.col("fine"), F.col("y"), FINE) >= percent / 100 - FINE_MARGIN)
    met = off.join(dealt, (F.col("of") == F.col("family")) & (F.col("share") == F.col("salt")) & near)
    return met.select(F.least("name", "b").alias("a"), F.greatest("name", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) as doc_id, n_shingles, component_id (smallest linked doc_id) and kept, one row per input row.

    Links: 100 * common shingles >= percent * all shingles. Words are lower-cased (A-Z); a text of fewer words
    than width is one shingle. Null and wordless texts have no shingles, are linked with nothing and kept. Rows
    without doc_id are linked like others, but a null is never the smallest of a component with other ids; where
    all are null, component_id is null and the rows kept. Rows that repeat a doc_id with equal texts are one document.
    """
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    rows = saved(sketches(docs, width), "sketches")
    rep = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    reps = rows.filter(F.col("name").isNotNull()).groupBy("name").agg(F.min(rep).alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    reps = saved(reps, "classes")
    banded = reps.select("name", F.posexplode("bands").alias("band", "h")).select("name", F.xxhash64("band", "h").alias("bucket"))
    sizes = saved(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    tasks = tasks_for(spark, sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    shared = saved(banded.join(sizes, "bucket"), "shared-buckets")
    large = saved(centred(shared.filter(F.col("n") > ALL_PAIRS)), "large-buckets", tasks)
    stars = large.filter(F.col("name") != F.col("centre")).select(F.least("name", "centre").alias("a"), F.greatest("name", "centre").alias("b"))
    pairs = all_pairs(shared.filter(F.col("n") <= ALL_PAIRS)).unionByName(stars).distinct()
    bits = reps.select("name", "bits")

    def close(pairs: DataFrame) -> DataFrame:
        a, b = bits.select(F.col("name").alias("a"), F.col("bits").alias("x")), bits.select(F.col("name").alias("b"), F.col("bits").alias("y"))
        return saved(pairs.join(a, "a").join(b, "b").filter(estimate(F.col("x"), F.col("y"), BANDS * ROWS) >= percent / 100 - MARGIN).select("a", "b"), "pairs", 4 * tasks)

    pairs = close(pairs)
    crowd = saved(large.select("name").distinct(), "crowd", tasks)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("name")).unionByName(crowd).distinct()
    sets = shingle_sets(wanted.join(reps.select("name", "rep"), "name"), docs, width)
    links = saved(confirmed(pairs, sets, percent), "links")
    labels = components(links)
    # large buckets: members off their centre's component meet the others, judged by finer signatures first
    if not crowd.isEmpty():
        fine = saved(fine_bits(sets.join(crowd, "name", "left_semi")), "fine")
        rooted = labels.withColumnRenamed("node", "name")
        centres = rooted.select(F.col("name").alias("centre"), F.col("root").alias("centre_root"))
        families = large.join(centres, "centre", "left").select("name", F.coalesce("centre_root", "centre").alias("family")).distinct()
        members = saved(families.join(rooted, "name", "left").withColumn("root", F.coalesce("root", "name")).join(fine, "name"), "members")
        more = saved(leftovers(members, percent), "more-pairs")
        extra = saved(confirmed(more, sets, percent), "more-links")
        if not extra.isEmpty():
            links = links.unionByName(extra)
            labels = components(links, "components-again")
    rooted = reps.select("name", "rep.doc_id").join(labels.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = saved(rooted.join(least, "root").select("name", "component_id"), "named")
    out = rows.select("doc_id", "n_shingles", "name").join(named, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Groups of all documents by shingles of two words, similarity 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || coalesce(ws[i + 1], '') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS shared FROM s JOIN s t ON s.sh = t.sh AND s.doc_id < t.doc_id GROUP BY s.doc_id, t.doc_id
), e AS (
  SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), f AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT a AS node, a AS seen FROM f UNION SELECT r.node, f.b FROM r JOIN f ON r.seen = f.a
), m AS (
  SELECT node, least(min(seen), node) AS component_id FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.node
"""
