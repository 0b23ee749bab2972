"""Token ids as Parquet list columns.

Texts are encoded by a public tokenizer and written in ascending doc_id order: file by file, row group by row
group. Ids are dictionary-encoded, doc_id and n_tokens delta-encoded (format v2), row groups and pages have set
sizes, and the page indexes let a reader fetch a few documents' ids, or the metadata alone, without the rest.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, partitions, shared_path

#: Texts that aren't cut: white space beyond ASCII's and control characters that regex engines disagree on.
UNCUT = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Bytes of text that are encoded at a time.
SLICE = 4 << 20
#: Units of more bytes aren't remembered.
LONGEST = 64


#: What a byte is; those of other characters than ASCII's are MIXED until their letters are found.
MIXED, LETTER, DIGIT, MARK, APOSTROPHE, GAP, SPACE = range(7)


def _kinds() -> np.ndarray:
    out = np.full(256, MIXED, np.uint8)
    for kind, characters in ((MARK, string.punctuation), (LETTER, string.ascii_letters), (DIGIT, string.digits), (APOSTROPHE, "'"), (GAP, "\t\n\r\x0b\x0c"), (SPACE, " ")):
        out[list(characters.encode())] = kind
    return out


def _cuts() -> np.ndarray:
    """By 8 * kind + next kind: whether a piece always ends between the two."""
    out = np.zeros((8, 8), bool)
    out[:GAP, GAP:] = True  # no piece goes on with white space
    out[GAP, :GAP] = True  # none begins with it and goes on, but for a space
    out[LETTER, DIGIT : APOSTROPHE + 1] = True
    out[DIGIT, [LETTER, MARK, APOSTROPHE]] = True
    out[[MARK, MARK, APOSTROPHE], [LETTER, DIGIT, DIGIT]] = True  # an apostrophe may begin 's, 't, 're
    return out.ravel()


KINDS, CUTS = _kinds(), _cuts()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each byte begins a unit, for texts joined in data that begin at starts.

    The pre-tokenizer of byte-level BPE cuts at each of these places, whatever stands around them, and looks at
    nothing before a place: a unit alone gives the pieces that it gives in its text.
    """
    kinds = KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # U+00C0 to U+024F are letters, but for two signs
    lead = lead[lead + 1 < len(data)]
    second = data[lead + 1]
    lead = lead[np.where(data[lead] == 0xC3, (second != 0x97) & (second != 0xB7), (data[lead] < 0xC9) | (second < 0x90))]
    kinds[lead] = kinds[lead + 1] = LETTER
    begins = np.zeros(len(data) + 1, bool)
    begins[starts] = True
    # the last of several spaces before something else: it stands alone or begins what follows
    blank = np.flatnonzero(kinds >= GAP)
    last = blank[1:][np.diff(blank) == 1]
    last = last[last + 1 < len(data)]
    last = last[(kinds[last + 1] < GAP) & ~begins[last + 1]]
    begins[1:-1] |= CUTS[kinds[:-1] << 3 | kinds[1:]]
    begins[last] = True
    return begins[:-1]


def binaries(offsets: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def contents(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a large binary or string array without nulls."""
    _, places, data = array.buffers()
    offsets = np.frombuffer(places, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return offsets - offsets[0], held[offsets[0] : offsets[-1]]


class Encoder:
    """Byte-level BPE through the tokenizers library, remembering what it has encoded.

    BPE never crosses the pieces that this pre-tokenizer cuts, so texts are cut into units where a piece always ends
    (unit_starts): mostly words, with the space before them, and the marks between. Arrow numbers the units of a
    slice, finds those that are remembered and puts the texts' ids together; only new units go through the library,
    joined, and the tokens that begin with a space (or line feeds put between units without one) tell where each
    starts. Texts with added tokens or unusual white space, and all texts under another pre-tokenizer, go through the
    library whole. The memory of units is bounded: the least lately used ones go.
    """

    def __init__(self, path: str, end_id: int, remember: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        cutter = setup["pre_tokenizer"] or {}
        self.byte_level = cutter.get("type") == "ByteLevel" and not cutter["add_prefix_space"] and cutter.get("use_regex", True) and not setup["normalizer"]
        self.uncut = "|".join([UNCUT, *(re.escape(t["content"]) for t in setup["added_tokens"])])
        if self.byte_level:
            self.tokenizer.post_processor = None  # it only trims offsets
        vocabulary = self.tokenizer.get_vocab()
        self.opens, self.feeds = np.zeros((2, max(vocabulary.values()) + 1), dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True  # a space, as this vocabulary writes it
        self.feeds[[i for token, i in vocabulary.items() if token == "\u010a"]] = True  # a line feed
        self.end = np.array([end_id], dtype="<u4")
        self.remember = remember
        self.units = self.ids = pa.array([], pa.large_binary())
        self.used = np.empty(0, np.int64)
        self.now = 0

    def library(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), 64):
            out += [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
        return out

    def apart(self, units: list[bytes], before: bytes, opens: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The library's ids of units, each with before put in front, in lists of ids and of the places where units begin."""
        chunks = [units[i : i + 1000] for i in range(0, len(units), 1000)]
        ids = self.library([(before + before.join(c)).decode() for c in chunks])
        starts = [np.flatnonzero(opens[x]) for x in ids]
        if any(len(at) != len(c) or at[0] for at, c in zip(starts, chunks, strict=True)):
            raise ValueError("this tokenizer's pieces can't be told apart")
        return ids, starts

    def learn(self, units: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Ids of units that aren't remembered; short ones will be."""
        if not len(units):
            return units
        offsets, data = contents(units)
        first, second = KINDS[data[offsets[:-1]]], KINDS[data[np.minimum(offsets[:-1] + 1, offsets[1:] - 1)]]
        # white space has pieces of its own, and so may what stands in a text that isn't cut
        alone = (first == GAP) | ((first == SPACE) & (second >= GAP)) | pc.match_substring_regex(units.cast(pa.large_string()), self.uncut).to_numpy(zero_copy_only=False)
        words = units.to_numpy(zero_copy_only=False)
        groups = [np.flatnonzero(~alone & (first == SPACE)), np.flatnonzero(~alone & (first != SPACE)), np.flatnonzero(alone)]
        spaced, at = self.apart(words[groups[0]].tolist(), b"", self.opens)
        sizes = [np.diff(a, append=len(x)) for x, a in zip(spaced, at, strict=True)]
        bare, at = self.apart(words[groups[1]].tolist(), b"\n", self.feeds)
        sizes += [np.diff(a, append=len(x)) - 1 for x, a in zip(bare, at, strict=True)]
        whole = self.library([x.decode() for x in words[groups[2]].tolist()])
        sizes.append(np.array([len(x) for x in whole], dtype=np.int64))
        flat = np.concatenate([*spaced, *[x[~self.feeds[x]] for x in bare], *whole])
        ids = binaries(4 * np.cumsum(np.concatenate([[0], *sizes])), flat.view(np.uint8)).take(pa.array(np.argsort(np.concatenate(groups))))
        short = np.flatnonzero(np.diff(offsets) < LONGEST)
        kept = np.arange(len(self.used))
        if len(kept) + len(short) > self.remember:
            kept = np.sort(np.argsort(self.used, kind="stable")[len(kept) // 2 :])
            short = short[: self.remember]
        self.units = pa.concat_arrays([self.units.take(pa.array(kept)), units.take(pa.array(short))])
        self.ids = pa.concat_arrays([self.ids.take(pa.array(kept)), ids.take(pa.array(short))])
        self.used = np.concatenate([self.used[kept], np.full(len(short), self.now)])
        return ids

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """32-bit ids of each text, the end id after them."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.byte_level:
            each = [np.append(x, self.end) for x in self.library(texts.to_pylist())]
            ends = np.cumsum([0, *map(len, each)])
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([self.end[:0], *each]).astype(np.int32)))
        offsets, data = contents(texts)
        begins = unit_starts(data, offsets[:-1])
        for i in np.flatnonzero(pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False)).tolist():
            begins[offsets[i] + 1 : offsets[i + 1]] = False
        starts = np.flatnonzero(begins)
        coded = binaries(np.append(starts, len(data)), data).dictionary_encode()
        known = self.ids
        self.now += 1
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.units), -1).to_numpy().astype(np.int64)
        self.used[at[at >= 0]] = self.now
        new = np.flatnonzero(at < 0)
        at[new] = len(known) + np.arange(len(new))
        ids = pa.concat_arrays([known, self.learn(coded.dictionary.take(pa.array(new))), binaries(np.array([0, 4]), self.end.view(np.uint8))])
        # the units of each text, then the end
        places = np.insert(at[coded.indices.to_numpy()], np.searchsorted(starts, offsets[1:]), len(ids) - 1)
        ends, flat = contents(ids.take(pa.array(places)))
        last = np.searchsorted(starts, offsets) + np.arange(len(offsets))
        return pa.ListArray.from_arrays(pa.array((ends[last] // 4).astype(np.int32)), pa.array(flat.view(np.int32)))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One per Python worker, kept between tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about SLICE bytes of text, a row at least; small batches are put together."""
    held, now, begun = [], 0, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64) + 64
        group, at = (begun + np.cumsum(sizes) - sizes) // SLICE, 0
        begun += int(sizes.sum())
        for g, n in zip(*[x.tolist() for x in np.unique(group, return_counts=True)], strict=True):
            if g != now and held:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(at, n))
            now, at = g, at + n
    if held:
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, group_mb: int = 32, page_rows: int = 2000) -> None:
    """Write (doc_id, text) as (doc_id, bucket, place, n_tokens, tokens) in ascending doc_id order, nulls first.

    A null text is empty: its ids are the end id alone. Rows with equal doc_id go by text hash; equal rows are
    interchangeable. bucket is the number of the range that a file holds, ascending with doc_id; place numbers the
    rows of a bucket in the order in which they were written.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, place = encoder(tokenizer, end_id), 0
        for some in slices(batches, 1):
            tokens = coder.encode(some.column(1))
            sizes = tokens.value_lengths().cast(pa.int64())
            places = pa.array(np.arange(place, place + some.num_rows))
            place += some.num_rows
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), places, sizes, tokens], names=["doc_id", "bucket", "place", "n_tokens", "tokens"])

    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.col("h"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text", F.spark_partition_id().alias("bucket"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("bucket", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    options = {
        "parquet.block.size": group_mb << 20, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "v2", "compression": "zstd",
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#place": "false", "parquet.enable.dictionary#n_tokens": "false",
    }
    with bounded_batches(spark):
        ordered.mapInArrow(encode, schema).write.options(**options).parquet(path)


def token_digests(spark, path: str, id_type: T.DataType) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of write_tokens: start counts the ids of all documents before."""
    import zlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            raw = memoryview(np.ascontiguousarray(values.astype("<u4"))).cast("B")
            crc = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array((ends[1:] - ends[:-1]).astype(np.int64)), crc], names=["doc_id", "bucket", "place", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("bucket", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    rows = spark.read.parquet(path).select("doc_id", "bucket", "place", "tokens").mapInArrow(digest, schema)
    # metadata alone, from the files' delta-encoded columns; one row per file range meets in the window
    sizes = spark.read.parquet(path).groupBy("bucket").agg(F.sum("n_tokens").alias("_n"))
    before = sizes.select("bucket", (F.sum("_n").over(Window.orderBy("bucket")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(before), "bucket").withColumn("start", F.col("_before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def read_tokens(spark, path: str, low: int, high: int) -> DataFrame:
    """(doc_id, tokens) of the documents from low to high: statistics and page indexes skip the rest."""
    return spark.read.parquet(path).filter(F.col("doc_id").between(low, high)).select("doc_id", "tokens")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents' token ids written and read back. A null text counts as empty; rows that share a doc_id follow each other in file order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, default_tokenizer(), 2)
    return token_digests(spark, path, docs.schema["doc_id"].dataType)
