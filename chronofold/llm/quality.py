"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a bounded sample; rules then run in order of rejections per
cost, and a document leaves at the first rule that rejects it. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, window_hashes

NOT_SYMBOL = bytes(b for b in range(256) if b not in b"#*$%&|<>")
NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
#: Rows of the sample that costs and rejection rates are measured on.
SAMPLE = 400


class Text:
    """A text's measures, each worked out when first asked for."""

    def __init__(self, raw: bytes | None, hashes: WordHashes):
        self.raw, self.hashes = raw or b"", hashes

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        setattr(self, name, value)
        return value

    def _words(self) -> list[bytes]:
        return self.raw.split()

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))

    def _n_symbols(self) -> int:
        return len(self.raw.translate(None, NOT_SYMBOL))

    def _n_letters(self) -> int:
        return len(self.raw.translate(None, NOT_LETTER))

    def _lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        """Words inside runs of five that the text holds twice or more."""
        if self.n_words < 6:
            return 0
        runs = window_hashes(self.hashes(self.words), 5)
        order = np.argsort(runs, kind="stable")
        ranked = runs[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return 0
        twice = np.zeros(len(runs), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = np.zeros(self.n_words + 1, np.int32)
        np.add.at(hit, np.flatnonzero(twice), 1)
        np.add.at(hit, np.flatnonzero(twice) + 5, -1)
        return int(np.count_nonzero(np.cumsum(hit[:-1])))


#: name: a text is rejected if this holds. Every rule says no more than it names.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 10,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "duplicate_lines": lambda t: len(t.lines) >= 3 and 10 * t.n_dup_lines > 3 * len(t.lines),
    "word_length": lambda t: t.n_words > 0 and not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
    "letters": lambda t: 2 * t.n_letters < len(t.raw) - t.raw.count(b" "),
}


def measure_rules(sample: list[bytes | None], rules: dict[str, Callable[[Text], bool]]) -> list[tuple[str, float, float]]:
    """(name, seconds a text, share rejected) of each rule on its own."""
    out = []
    for name, rule in rules.items():
        hashes, began = WordHashes(), time.thread_time()
        rejected = sum(rule(Text(raw, hashes)) for raw in sample)
        out.append((name, (time.thread_time() - began) / max(1, len(sample)), rejected / max(1, len(sample))))
    return out


def cascade_order(measured: list[tuple[str, float, float]]) -> list[str]:
    """Rules by rejections per cost, best first; equals by name."""
    return [name for name, cost, share in sorted(measured, key=lambda m: (-(m[2] / max(m[1], 1e-9)), m[0]))]


def quality_cascade(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] | None = None, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(doc_id, text) with kept, rejected_by, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    rejected_by names all rules but the first rejecting one away: it is the cascade's verdict, and so depends on
    the measured order; kept does not. Rows without doc_id, or that share one, are judged like others. A null text is empty and fails few_words. The sample that orders the rules
    is the rows with the smallest id hashes, a bounded number; the rules themselves see every row.
    """
    rules = RULES if rules is None else rules
    hashed = docs.select(F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("h"), F.col("text").cast("binary").alias("text"))
    # the smallest of each partition first, then of those: no shuffle of ids or texts
    least = [r["h"] for r in hashed.select("h").orderBy("h").limit(sample).collect()]
    drawn = [r["text"] for r in hashed.filter(F.col("h").isin(sorted(set(least)))).select("text").limit(sample).collect()] if least else []
    order = cascade_order(measure_rules([raw and bytes(raw) for raw in drawn], rules))
    chain = [(name, rules[name]) for name in order]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                t = Text(raw.as_py(), hashes)
                by = next((name for name, rule in chain if rule(t)), None)
                base = t.n_words < 10 or 100 * t.n_repeat_words > 20 * t.n_words
                rows.append((by is None and not base, by, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, base))
            kinds = [pa.bool_(), pa.string(), *[pa.int64()] * 5, pa.bool_()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    long = lambda n: T.StructField(n, T.LongType())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType()), *map(long, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("base_failed", T.BooleanType())])
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(judge, schema)


def op9_quality_cascade(spark, sf_dir: str) -> DataFrame:
    """The base measures and the verdict of all rules on every document."""
    out = quality_cascade(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
), q AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM q WHERE n > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         strlen(text) - length(regexp_replace(text, '[A-Za-z]|[^\x00-\x7F]', '', 'g')) AS n_letters, strlen(text) - (length(text) - length(replace(text, ' ', ''))) AS n_unspaced
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR (n_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
            OR (n_words > 0 AND NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words)) OR 2 * n_letters < n_unspaced) AS kept
FROM m
"""
