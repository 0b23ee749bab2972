"""Substring dedup by sliding sentence spans.

Every run of consecutive sentences with enough words is hashed and joined globally; a sentence goes if any run over it
occurred before (by doc_id, then place).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, mixed

#: A run goes on until it has so many words.
WORDS = 16
#: A longer sentence is cut after each word whose hash is the smallest (the last of equals) of any SPAN words in a row
#: within it. Copies are cut alike but for SPAN - 1 words at their ends, and no piece is longer than SPAN. So a stretch
#: of over 50 words (same words, stops and line ends) loses 17 at most at either end, and the rest holds a common run.
LONG, SPAN = 16, 9
#: Factor of the runs' polynomial hashes, and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class Powers:
    """Powers of FACTOR and INVERSE modulo 2**64, as many as were asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full((2, 2 * n), 1, np.uint64)
            steps[0, 1:], steps[1, 1:] = FACTOR, INVERSE
            self.up, self.down = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def sentences_of(raw: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end) in bytes and (first, last) word of each piece, and the words' hashes; together they hold every word.

    A sentence ends after a word that ends in a stop, or before a line end.
    """
    b = np.frombuffer(raw, np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True]))))
    starts, ends = edges[0::2], edges[1::2]
    n = len(starts)
    if not n:
        none = np.empty((0, 2), np.int64)
        return none, none, np.empty(0, np.uint64)
    final = b[ends - 1]
    stops = ((final == 46) | (final == 33) | (final == 63)) & (ends < len(raw))
    line_ends = np.flatnonzero(b == 10)
    after = np.append(starts[1:], len(raw))
    at = np.searchsorted(line_ends, ends)
    next_line = np.append(line_ends, len(raw))[at]
    breaks = next_line < after
    last = stops | breaks
    last[-1] = True
    first = np.append(True, last[:-1])
    # where a sentence begins: at its first word after a stop, else behind the last line end before it
    before = np.append(0, line_ends + 1)[np.searchsorted(line_ends, starts)]
    begin = np.where(np.append(False, stops[:-1]), starts, before)
    stop = np.where(stops, ends, np.where(breaks, next_line, len(raw)))
    h = hashes(raw.split())
    sentence = np.cumsum(first) - 1
    size = np.diff(np.append(np.flatnonzero(first), n))
    cut = last
    if n >= SPAN and size.max() > LONG:
        long = (size > LONG)[sentence]
        windows = np.lib.stride_tricks.as_strided(h[::-1], (n - SPAN + 1, SPAN), (-8, -8))
        low = n - SPAN - np.arange(n - SPAN + 1)  # a window's first word; the last of equal hashes wins
        place = low + SPAN - 1 - windows.argmin(axis=1)
        cut = last.copy()
        cut[place[(sentence[low] == sentence[low + SPAN - 1]) & long[low]]] = True
    ends_at = np.flatnonzero(cut)
    firsts = np.append(0, ends_at[:-1] + 1)
    begins = np.where(first[firsts], begin[firsts], ends[firsts - 1])
    return np.stack([begins, np.where(last[ends_at], stop[ends_at], ends[ends_at])], axis=1), np.stack([firsts, ends_at], axis=1), h


def runs_of(raw: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash, check) of the runs: from each piece on, the shortest of enough words.

    Hashes are polynomials of the words' hashes, so white space between words doesn't count.
    """
    _, words, h = sentences_of(raw, hashes)
    if len(h) < WORDS:
        return (*[np.empty(0, np.int64)] * 3, np.empty(0, np.int16))
    upto = words[:, 1] + 1
    last = np.searchsorted(upto, words[:, 0] + WORDS)
    first = np.flatnonzero(last < len(upto))
    last = last[first]
    up, down = POWERS(len(h))
    a, z = words[first, 0], upto[last]
    with np.errstate(over="ignore"):
        lanes = []
        for x in (h, mixed(h)):
            sums = np.append(np.uint64(0), np.cumsum(x * up, dtype=np.uint64))
            lanes.append(mixed((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64)))
    return first, last, lanes[0].view(np.int64), (lanes[1] >> np.uint64(48)).astype(np.uint16).view(np.int16)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the runs of each document that occurred before, as first sentence * 2**32 + last sentence.

    A slice of rows sends each run into the global comparison once, by its first place in the slice; its other places
    there are known to be later and travel under keys of their own. So a run that every document holds meets itself
    once a slice only, and the runs are shuffled once.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, texts = part.column(0).to_pylist(), part.column(1)
                order = sorted(range(len(ids)), key=ids.__getitem__)
                found = [runs_of(texts[i].as_py() or b"", hashes) for i in order]
                first, last, run, check = (np.concatenate(c) for c in zip(*found, strict=True))
                if not len(first):
                    continue
                lengths = [len(f[0]) for f in found]
                row = np.repeat(order, lengths)
                # rows that share an id share their places
                new = np.array([k == 0 or ids[i] != ids[order[k - 1]] for k, i in enumerate(order)])
                place = (np.repeat(np.cumsum(new), lengths) << 32) + first
                by = np.lexsort((place, check, run))
                same = np.append(False, (run[by][1:] == run[by][:-1]) & (check[by][1:] == check[by][:-1]))
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
                sent = ~same | (place[by] != place[by][head])
                keep, later = by[sent], same[sent]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(row[keep])), pa.array(first[keep].astype(np.int32)), pa.array(last[keep].astype(np.int32)), pa.array(run[keep]), pa.array(check[keep]), pa.array(later),
                ], names=schema.names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("check", T.ShortType()), T.StructField("later", T.BooleanType())])
    runs = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(compare, schema)
    keyed = runs.withColumn("run", F.when(F.col("later"), F.xxhash64("doc_id", "first")).otherwise(F.col("run")))
    order = Window.partitionBy("run", "check", "later").orderBy("doc_id", "first")
    later = keyed.withColumn("nth", F.rank().over(order)).filter(F.col("later") | (F.col("nth") > 1))
    span = F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")
    return later.groupBy("doc_id").agg(F.collect_set(span).alias("spans"))


def without_pieces(raw: bytes, spans: list[int], hashes: WordHashes) -> tuple[bytes, list[int]]:
    """The text without the pieces of spans, and their numbers."""
    pieces, lost = sentences_of(raw, hashes)[0], set()
    for s in spans:
        lost.update(range(s >> 32, (s & 0xFFFFFFFF) + 1))
    gone, kept, at = sorted(lost), [], 0
    for a, z in pieces[gone].tolist():
        kept.append(raw[at:a])
        at = z
    return b"".join([*kept, raw[at:]]), gone


def dedup_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as doc_id, n_dropped, dropped, text, without the sentences of repeated runs.

    dropped lists the numbers of the pieces that went. A null text stays null and loses none; so does a text of fewer
    than sixteen words. Rows without doc_id are kept as they are; rows that share a doc_id are one document. Runs are
    equal if their words are; the white space between words does not count.
    """
    rows = docs.select("doc_id", "text").join(repeated_spans(docs.select("doc_id", "text")), "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts, spans = part.column(1), part.column(2)
                hit = pc.and_(spans.is_valid(), texts.is_valid())
                some = [without_pieces(t.as_py(), s.as_py(), hashes) for t, s in zip(texts.filter(hit), spans.filter(hit), strict=True)]
                left = pc.replace_with_mask(texts, hit, pa.array([t for t, _ in some], texts.type))
                counts = pc.replace_with_mask(pa.array(np.zeros(part.num_rows, np.int64)), hit, pa.array([len(g) for _, g in some], pa.int64()))
                dropped = pc.replace_with_mask(pa.array([""] * part.num_rows, pa.string()), hit, pa.array([",".join(map(str, g)) for _, g in some], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), counts, dropped, left.cast(pa.string())], names=["doc_id", "n_dropped", "dropped", "text"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_dropped", T.LongType()), T.StructField("dropped", T.StringType()), T.StructField("text", T.StringType())])
    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), "spans").mapInArrow(cut, schema)


def op8_sentence_spans(spark, sf_dir: str) -> DataFrame:
    """All documents without the sentences of runs that an earlier document, or an earlier place of the same, holds."""
    out = dedup_sentences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_dropped", "dropped", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"))
