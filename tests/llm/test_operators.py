"""The dealt operators against brute force and on awkward rows: nulls, empty and long texts, repeats, no rows, clashing columns."""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from chronofold.llm import decontaminate as dc  # noqa: E402
from chronofold.llm import common, line_dedup, mixing, near_dup, quality, queries, secrets, sharding, substring_dedup, tokens, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, gone string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = "The first line is here.\nThe second line goes on.\nThe third line ends it with a few more words."
ROWS = [
    (1, None, None, None, None, 5, "x"), (2, "", "en", "a", 0, 5, "x"), (3, " \n\t ", "en", "a", 4, None, None), (4, LONG, "en", None, len(LONG), 1, "y"),
    (5, PASSAGE, "en", "b", 9, 1, "y"), (6, "Own words before.\n" + PASSAGE + "\nAnd after.", "en", "b", 9, 1, "y"), (7, PASSAGE, "de", "b", 9, 1, "y"), (7, PASSAGE, "de", "b", 9, 1, "y"),
    (None, PASSAGE, None, "c", 1, 1, "z"), (8, "password: abcdefgh é token=x password=token: abcdefgh AKIA" + "Z" * 20 + " " + "0f" * 14, "fr", "c", 3, 0, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    at = sharding.hilbert_index(grid, 3)
    assert sorted(at) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_hilbert_runs_fill_aligned_cubes():
    """With unit steps, what makes a curve Hilbert's: every run of 8**k places is a cube whose side is 2**k, on the grid."""
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    laid = grid[np.argsort(sharding.hilbert_index(grid, 3))]
    for k in (1, 2):
        for i in range(0, 512, 8**k):
            assert len({tuple(c) for c in laid[i : i + 8**k] // 2**k}) == 1


def test_op1_equals_brute_force(spark, table):
    """Quantiles, cells of whole texts, ranks, shards and slots worked out in one place."""
    rows = [(r["doc_id"], r["lang"], r["source"], len(r["text"].encode()) + 8, zlib.crc32(r["text"].encode())) for r in table.collect()]
    cells = 32

    def text_cells(values):
        counts, before, cuts = Counter(v for v in values if v is not None), 0, {}
        total = sum(counts.values())
        for v in sorted(counts, key=str.encode):
            cuts.setdefault(before * (cells - 1) // total, v)
            before += counts[v]
        edges = [v for c, v in cuts.items() if c > 0]
        return [0 if v is None else 1 + sum(v.encode() >= e.encode() for e in edges) for v in values]

    sizes = sorted(r[3] for r in rows)
    edges = sorted({sizes[max(0, -(-len(sizes) * i // (cells - 1)) - 1)] for i in range(1, cells - 1)})
    number_cells = [min(cells - 1, 1 + sum(e <= r[3] for e in edges)) for r in rows]
    at = sharding.hilbert_index(np.array([text_cells([r[1] for r in rows]), text_cells([r[2] for r in rows]), number_cells]).T, 5)
    order = sorted(range(len(rows)), key=lambda i: (at[i], rows[i][0], rows[i][4]))
    want, n = {}, len(rows)
    for rank, i in enumerate(order):
        shard = rank * 24 // n
        want[rows[i][0]] = (rows[i][3], rows[i][4], "rows", shard, rank - -(-shard * n // 24), None)
    out = queries.QUERIES["op1_hilbert_shards"](spark, SF)
    assert rows_of(out, "size", "text_crc32", "law", "shard", "slot", "grown_shard") == want


def test_shards_are_even_and_gapless(spark, docs):
    sized = docs.select("*", sharding.text_size(F.col("text")).alias("size"))
    out = sharding.hilbert_shards(sized, ["lang", "source", "size"], 4, ["doc_id"]).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(ROWS) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert sharding.hilbert_shards(sized.limit(0), ["lang", "size"], 4, ["doc_id"]).count() == 0


def test_decontamination_equals_brute_force(spark, table, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(dc.decontaminate(table, items), *columns) == brute.decontaminate(plain(table), [tuple(r) for r in items.collect()])
    few = [(1, "the third line ends it with a few more words"), (2, None), (3, "w1 W2"), (None, "zz zz")]
    few_items = spark.createDataFrame(few, "item_id long, text string")
    named = docs.filter("doc_id is not null")
    assert rows_of(dc.decontaminate(named, few_items), *columns) == brute.decontaminate(plain(named), few)
    assert dc.decontaminate(docs.limit(0), few_items).count() == 0
    assert dc.decontaminate(docs, few_items.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("n", ["1", "11"])
def test_decontamination_with_other_shuffle_partitions(spark, docs, n):
    items = [(1, "the third line ends it with a few more words")]
    named, key = docs.filter("doc_id is not null"), "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        found = dc.decontaminate(named, spark.createDataFrame(items, "item_id long, text string"))
        assert rows_of(found, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.decontaminate(plain(named), items)
    finally:
        spark.conf.set(key, before)


def test_decontamination_judges_every_row_by_itself(spark, monkeypatch):
    """Null and shared ids, texts that repeat their terms, and joins that shuffle because nothing is small enough."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    two = " ".join("ab"[i % 2] for i in range(20_000))
    rows = [(None, "x y z the end"), (None, "nothing here"), (7, "say x y z"), (7, "other"), (8, two), (9, "a b a b b a"), (9, "a b a b b a")]
    items = [(1, "X y Z"), (2, "a b a b a b a b a b a b a"), (3, "a b b a"), (3, "a b b a"), (None, "")]
    out = dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = [(d, *brute.decontaminate([(0, t)], items)[0]) for d, t in rows]
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_proximity_matches(spark):
    items = spark.createDataFrame([(1, "red green blue"), (2, "red green violet")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "red one two green three blue violet"), (2, "red " + "w " * 30 + "green blue"), (3, "red green blue")], "doc_id long, text string")
    assert rows_of(dc.decontaminate(docs, items), "n_items", "n_near_items") == {1: (0, 2), 2: (0, 0), 3: (1, 1)}


def test_tokens_round_trip(spark, table, docs):
    path = tokens.default_tokenizer()
    assert rows_of(queries.QUERIES["op3_token_output"](spark, SF), "start", "n_tokens", "ids_crc32") == brute.tokens(plain(table), path)
    coder, odd = tokens.Encoder(path, 2, remember=50), ["", "  a  b ", "don't x's", "a 's b", "x\x1d0 \x1e", "\xa0 q", "z" * 100 + " " + "q" * 90, "a<|endoftext|> b", "x\x1cy z", "naïve Straße, 中文 🙂  x \n y", "End.\nNext, q'd'm't a_b c-1 'sfoo ɏ.z ɐ.z İ!y é́.x", "b.\n\nc d\n\n e\r\nf. g\n", LONG]
    for _ in range(3):
        assert coder.encode(pa.array([*odd, None])).to_pylist() == [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in [*odd, ""]]
    assert coder.encode(pa.array([], pa.string())).to_pylist() == []


def test_tokens_of_every_character_between_others():
    coder = tokens.Encoder(tokens.default_tokenizer(), 2, remember=5000)
    signs = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000] + ["中", "\ufeff", "\uff0c", "🙂", "𝒳"]
    texts = [f"a{c}.b {c}1'{c}s\n{c} {c}{c}\n {c}'{c}" for c in signs] + ["".join(np.random.default_rng(i).choice([*"aZé7 \n\t.'s,-", "…", "٣"], 30)) for i in range(2000)]
    for part in (texts[:9000], texts[9000:], texts[7000:9500]):
        assert coder.encode(pa.array(part)).to_pylist() == [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in part]
    assert len(coder.units) <= 2 * 5000


def test_tokens_of_known_pieces_need_no_library(monkeypatch):
    coder, texts = tokens.Encoder(tokens.default_tokenizer(), 2), ["End it. Now go on, 12 more.\nThe last"]
    coder.encode(pa.array(texts))
    sent = []
    monkeypatch.setattr(coder, "library", lambda some, library=coder.library: sent.extend(some) or library(some))
    again = "End it. Now go.\nEnd on,The last.\nThe it\nEnd 12."
    expected = [*coder.tokenizer.encode(again, add_special_tokens=False).ids, 2]
    assert coder.encode(pa.array([again, "The it."])).to_pylist()[0] == expected and sent == []


def test_slices_put_small_batches_together(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 1000)
    table = pa.table({"doc_id": list(range(40)), "text": ["x" * 36] * 30 + [None, "y" * 2500] + [""] * 8})
    got = list(tokens.slices(iter(table.to_batches(max_chunksize=3)), 1))
    assert pa.Table.from_batches(got) == table.combine_chunks() and [b.num_rows for b in got] == [10, 10, 10, 2, 6, 2]
    assert list(tokens.slices(iter([]), 1)) == []


def test_tokens_of_repeated_ids_stand_where_start_says(spark, tmp_path):
    rows = [(7, "one two three four"), (7, "x"), (3, None), (7, "a longer text with more words in it"), (None, "first"), (7, "x"), (None, ""), (9, "the end")]
    path = f"{tmp_path}/tokens"
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, tokens.default_tokenizer(), 2)
    files = spark.read.parquet(path).orderBy("bucket", "place").collect()
    flat = [i for r in files for i in r["tokens"]]
    out = tokens.token_digests(spark, path, files and spark.read.parquet(path).schema["doc_id"].dataType).collect()
    assert [r["doc_id"] for r in files] == [None, None, 3, 7, 7, 7, 7, 9] and len(out) == len(rows)
    for r in out:
        ids = flat[r["start"] : r["start"] + r["n_tokens"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and ids[-1] == 2 and 2 not in ids[:-1]
    assert [r["doc_id"] for r in tokens.read_tokens(spark, path, 3, 7).collect()].count(7) == 4
    empty = f"{tmp_path}/empty"
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty, tokens.default_tokenizer(), 2)
    assert tokens.token_digests(spark, empty, files and spark.read.parquet(path).schema["doc_id"].dataType).count() == 0


def test_token_files_are_encoded_as_said(spark, tmp_path):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/tokens"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    tokens.write_tokens(spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(300)], "doc_id long, text string"), path, tokens.default_tokenizer(), 2)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    meta = pq.ParquetFile(next(Path(path).glob("part-*"))).metadata.row_group(0)
    encodings = {meta.column(i).path_in_schema.split(".")[0]: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["doc_id"].encodings and "RLE_DICTIONARY" in encodings["tokens"].encodings
    assert all(c.has_offset_index for c in encodings.values())


def test_line_dedup(docs):
    out = rows_of(line_dedup.dedup_lines(docs.filter("doc_id is not null")), "n_dropped", "text")
    assert out[5] == (0, PASSAGE) and out[6] == (3, "Own words before.\nAnd after.") and out[7] == (3, "")
    assert out[1] == (0, None) and out[2] == (0, "")
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_equals_brute_force(spark):
    """Short runs that count by their words, blank lines inside runs, null and shared ids, ties, repeats within a text."""
    rng = np.random.default_rng(9)
    long = [" ".join(f"l{k}w{i}" for i in range(14)) for k in range(4)]
    lines = [*long, "short one", "short two", "", "  ", "third short line here", "é ü ñ"]
    texts = ["\n".join(lines[i] for i in rng.integers(0, len(lines), rng.integers(1, 9))) for _ in range(120)] + [None, "", "\n\n", long[0], long[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, long[1] + "\nown tail"), (None, "own head\n" + long[2])]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.line_runs(rows[: len(texts)])
    got = {r["doc_id"]: ([int(x) for x in r["dropped"].split(",") if x], r["text"]) for r in out if r["doc_id"] is not None}
    assert got == dict(enumerate(want))
    assert sorted(r["text"] for r in out if r["doc_id"] is None) == ["own head", "own tail"]


def test_line_dedup_extends_matches_into_runs(spark):
    """One run for a stretch of equal lines, however long, and linear work in the lines of a text."""
    many = "\n".join(f"line number {i} of a very long list" for i in range(30_000))
    rows = line_dedup.hashed_lines(spark.createDataFrame([(1, many), (2, "head\n" + many + "\ntail")], "doc_id long, text string"))
    runs = line_dedup.repeated_runs(rows).collect()
    assert [(r["first"], r["last"], r["of_first"]) for r in runs] == [(1, 30_000, 0)]
    out = rows_of(line_dedup.dedup_lines(spark.createDataFrame([(1, many), (2, "head\n" + many + "\ntail")], "doc_id long, text string")), "n_dropped", "text")
    assert out[2] == (30_000, "head\ntail") and out[1] == (0, many)


def test_sentence_spans(docs):
    out = rows_of(substring_dedup.dedup_sentences(docs.filter("doc_id is not null")), "n_dropped", "text")
    assert out[5][0] == 0 and out[6][0] == 3 and "second line" not in out[6][1] and "And after." in out[6][1] and out[7][0] == 3
    assert out[1] == (0, None) and out[4][0] == 0 or out[4][1] is not None
    assert substring_dedup.dedup_sentences(docs.limit(0)).count() == 0


def test_sentence_spans_equal_brute_force(table, docs):
    for some in (table, docs.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        found = rows_of(substring_dedup.dedup_sentences(some), "dropped")
        assert {d: [int(x) for x in s.split(",")] for d, (s,) in found.items() if s} == brute.sentence_spans(plain(some))


def test_sentence_spans_find_every_passage_of_over_fifty_words():
    rng = np.random.default_rng(4)
    hashes = substring_dedup.WordHashes()

    def prose(n, stops, vocabulary):
        return [f"v{w}" + ("." if rng.random() < stops else "") for w in rng.integers(0, vocabulary, n)]

    for i in range(3000):
        stops, vocabulary = rng.choice([0, 0.03, 0.1, 0.3]), int(rng.choice([3, 50, 5000]))
        passage = prose(51 + i % 10, stops, vocabulary)
        runs = []
        for _ in range(2):
            before, after = ([f"o{rng.integers(1 << 40)}" + ("." if rng.random() < 0.05 else "") for _ in range(rng.integers(0, 60))] for _ in range(2))
            _, _, run, check = substring_dedup.runs_of(" ".join(before + passage + after).encode(), hashes)
            runs.append(set(zip(run.tolist(), check.tolist())))
        assert runs[0] & runs[1], (i, passage)


def test_toxicity_learns_terms_and_searches_exactly(spark, table):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, (" ".join(rng.choice(words, 30)) + (" nasty vile" if i % 4 == 0 else "")).encode(), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.Neighbours.learn(rows, {0: 300, 1: 100})
    assert model.score(b"a nasty text")[0] > 0.8 and model.score(b"a nice text")[0] < 0.1 and model.score(None) == model.score(b"")
    v = model.vector(toxicity.terms_of(b"nasty vile word1 word2"))
    full = np.zeros(len(model.keys))
    for t, x in zip(*v):
        for b, (places, values) in model.postings[t].items():
            full[b * toxicity.BLOCK + places] += x * values
    best = sorted(((round(c, 12), -i) for i, c in enumerate(full) if c > 0), reverse=True)[:15]
    assert [(round(c, 12), -p) for c, p in model.nearest(v, 15)] == best
    blank = toxicity.Neighbours.learn([], {})
    assert blank.score(b"anything")[0] == 0
    out = queries.QUERIES["op5_toxicity"](spark, SF)
    assert out.count() == table.count() and out.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_drops_only_confirmed_copies():
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(words, 40, replace=False)).encode(), i % 2) for i in range(400)]
    assert [k for k, *_ in toxicity.distinct_examples(rows)] == [k for k, *_ in rows]
    own = rows[0][1].split()
    copies = [(1000, rows[0][1], 0), (1001, b" ".join([*own[:38], b"new1", b"new2"]), 0)]
    others = [(1002, rows[0][1], 1), (1003, b" ".join([*own[:30], *(b"other%d" % i for i in range(10))]), 0)]
    assert [k for k, *_ in toxicity.distinct_examples(rows + copies + others)] == [k for k, *_ in rows + others]
    near = [(i, b" ".join(rng.choice(own, 35, replace=False).tolist()), i % 2) for i in range(60)]
    sets, want = {k: set(t.split()) for k, t, _ in near}, []
    for k, _, y in near:
        if not any(y == v and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) for j, v in want):
            want.append((k, y))
    assert [(k, y) for k, _, y in toxicity.distinct_examples(near)] == want and len(want) < 60


def test_toxicity_held_out(spark):
    out = queries.QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    c = Counter((r["predicted"], r["toxic"]) for r in out.collect())
    assert c[1, 0] <= 2 and c[1, 1] >= 8


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(table, width):
    assert rows_of(near_dup.near_duplicates(table, width), "n_shingles", "component_id", "kept") == brute.near_duplicates(plain(table), width)


def test_near_duplicates_on_awkward_rows(docs):
    out = near_dup.near_duplicates(docs, 2).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["kept"] and by[2]["n_shingles"] == 0 and by[7]["component_id"] == 5 and not by[7]["kept"] and by[None]["component_id"] == 5
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_large_families(spark, monkeypatch):
    """Families beyond the all-pairs size: stars and the leftovers' comparison must find what brute force finds."""
    monkeypatch.setattr(near_dup, "ALL_PAIRS", 3)
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(80, rng.integers(0, 9), replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dup.near_duplicates(df, 2), "n_shingles", "component_id", "kept") == brute.near_duplicates(rows, 2)


def test_near_duplicates_link_rows_without_id(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:59], "other"]
    rows = [(None, " ".join(base)), (None, " ".join(base)), (4, " ".join(near)), (None, "quite another text of its own"), (None, "quite another text of its own"), (5, "alone here")]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in out) == sorted(map(str, [(None, 4, False), (None, 4, False), (4, 4, True), (None, None, True), (None, None, True), (5, 5, True)]))


def test_near_duplicates_in_a_family_of_thousands(spark):
    """Copies of one template, linked and unlinked: every member's group is what pairwise comparison with the template gives."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(40)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2500):
        words = list(base)
        for at in rng.choice(40, 2 if i % 5 else 20, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    out = rows_of(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2), "component_id")
    sets = [{(a, b) for a, b in zip(w, w[1:])} for w in (t.split() for _, t in rows)]
    linked = [i for i in range(2500) if 100 * len(sets[0] & sets[i]) >= 80 * len(sets[0] | sets[i])]
    assert len(linked) > 500 and all(out[i] == (0,) for i in linked)
    assert all(out[i] == (i,) for i in range(5, 2500, 5) if not any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(2500) if j != i))


def test_b_bit_estimate_is_close(spark):
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    factors = near_dup.multipliers(near_dup.BANDS * near_dup.ROWS)
    x, y = (near_dup.signature(np.unique(s), factors)[1].view(np.int64).tolist() for s in (a, b))
    got = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(near_dup.estimate(F.col("x"), F.col("y"), near_dup.BANDS * near_dup.ROWS)).first()[0]
    assert abs(got - 800 / 1200) < 0.15


def test_secret_scan_equals_brute_force(spark, table, docs):
    for some in (table, docs.filter("doc_id is not null")):
        findings, _ = secrets.scan_versions(some.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"), 1)
        got = {r["path"]: r["s"] for r in findings.select("path", secrets.listed(F.col("spans")).alias("s")).collect()}
        assert got == {d: brute.secrets(t)[4] for d, t in plain(some)}


def test_secret_scan_of_many_matches_and_rows_without_path(spark):
    many = " ".join(f"{i:024x}" for i in range(20_000))
    rows = [(1, many), (None, "token=abcdefgh"), (None, "token=abcdefgh"), (2, "token=abcdefgh"), (3, None)]
    versions = spark.createDataFrame(rows, "path long, text string").withColumn("version", F.lit(0))
    findings, ledger = secrets.scan_versions(versions, 1)
    got = sorted(str((r["path"], r["s"])) for r in findings.select("path", secrets.listed(F.col("spans")).alias("s")).collect())
    assert got == sorted(str((d, brute.secrets(t)[4])) for d, t in rows) and ledger.count() == 3
    assert secrets.scan_versions(versions.limit(0), 1)[0].count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    versions = spark.createDataFrame([("a", 0, "token=abcdefgh"), ("b", 0, "token=abcdefgh"), ("c", 0, None)], "path string, version int, text string")
    first, ledger = secrets.scan_versions(versions, 1)
    assert ledger.count() == 2 and first.filter("size(spans) = 1").count() == 2
    more = versions.unionByName(spark.createDataFrame([("a", 1, "-----BEGIN RSA PRIVATE KEY-----")], "path string, version int, text string"))
    again, grown = secrets.scan_versions(more, 1, ledger)
    assert grown.count() == 3 and again.count() == 4
    newer, all_pairs = secrets.scan_versions(more, 2, grown)
    assert all_pairs.count() == 6 and newer.filter("size(spans) = 1").count() == 3


def test_quality_equals_brute_force(table, docs):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for some in (table, docs.filter("doc_id is not null")):
        assert rows_of(quality.quality_cascade(some), *columns) == {d: brute.quality(t) for d, t in plain(some)}
    assert quality.quality_cascade(docs.limit(0)).count() == 0


def test_cascade_order_is_by_rejections_per_cost():
    assert quality.cascade_order([("slow", 2.0, 0.5), ("fast", 0.1, 0.2), ("never", 0.1, 0.0)]) == ["fast", "slow", "never"]


def test_mix_meets_targets(spark, docs):
    rows = [(i, ["a", "b", "c", None][min(i % 5, 3)], 10 + i % 7, 0.2 + (i % 3) / 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")
    out = mixing.mix(df, [1, 2, 3]).collect()
    assert len(out) == 2000 and max(r["times"] for r in out) <= 3
    taken, target = Counter(), {}
    for r in out:
        taken[r["source"]] += r["times"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 17 for s, t in target.items())
    assert abs(sum(target.values()) - sum(r[2] for r in rows)) < 1e-6
    assert sorted(map(str, mixing.mix(df, [1, 2, 3]).collect())) == sorted(map(str, out))
    awkward = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.text_quality(F.col("text")).alias("quality"))
    assert mixing.mix(awkward, [1, 2, 3]).count() == len(ROWS) and mixing.mix(awkward.limit(0), [1]).count() == 0


def test_mix_never_exceeds_the_cap_and_leaves_clashing_columns_out(spark, monkeypatch):
    """Empty documents of a source at its cap, and sources in more than one range."""
    monkeypatch.setattr(common, "TASK_ROWS", 2)
    rows = [(i, f"s{i % 7}", 0 if i % 3 == 0 else 5 + (i % 7) * 40, 0.5, "t", 1) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double, target string, times int")
    out = mixing.mix(df, [1, 2, 3]).collect()
    assert len(out) == 700 and max(r["times"] for r in out) <= 3 and {r["target"] for r in out if r["source"] == "s0"} == {3.0 * sum(r[2] for r in rows if r[1] == "s0")}
    assert abs(sum({r["source"]: r["target"] for r in out}.values()) - sum(r[2] for r in rows)) < 1e-6
    nothing = mixing.mix(df.filter("size = 0"), [1, 2, 3]).collect()
    assert max(r["times"] for r in nothing) <= 3 and {r["target"] for r in nothing} == {0.0}


def test_shards_by_whole_texts_and_clashing_names(spark, monkeypatch):
    """Values that share a long prefix get cells of their own; helper columns give way to the table's."""
    monkeypatch.setattr(common, "TASK_ROWS", 3)
    rows = [(i, f"https://one.example/{'abcdefgh'[i % 8]}", i, 1, 2, 3, 4) for i in range(640)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, _rank int, _at int, _range int, _size int")
    assert sharding.text_cuts(df, "source", 32) == [f"https://one.example/{c}" for c in "bcdefgh"]
    out = sharding.hilbert_shards(df, ["source", "size"], 8, ["doc_id"])
    assert set(df.columns) < set(out.columns) and {r["_at"] for r in out.collect()} == {2}
    ordered = out.orderBy("hilbert", "doc_id").collect()
    assert [(r["shard"], r["slot"]) for r in ordered] == [(i // 80, i % 80) for i in range(640)]
    assert out.select("shard", "source").distinct().count() < 64  # at least some shards are skipped for a source


def test_shard_files_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(800)], "doc_id long, source string, size long")
    path = f"{tmp_path}/shards"
    sharding.write_shards(sharding.hilbert_shards(df, ["source", "size"], 8, ["doc_id"]), path)
    import pyarrow.parquet as pq

    ranges = []
    for f in Path(path).rglob("*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        ranges += [(s.min, s.max) for i in range(group.num_columns) if group.column(i).path_in_schema == "size" and (s := group.column(i).statistics)]
    assert len(ranges) == 8 and sum(low <= 5 <= high for low, high in ranges) <= 3
    assert spark.read.parquet(path).filter("size = 5").count() == 1


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    df = common.saved(spark.range(100).selectExpr("id", "repeat('x', 1000) as t"), "rows")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.small_enough(df)) and not hinted(common.small_enough(df, 99))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 50_000)
    assert not hinted(common.small_enough(df))


def test_operators_equal_themselves_where_every_join_shuffles(spark, table, monkeypatch):
    want = {n: sorted(map(str, queries.QUERIES[n](spark, SF).collect())) for n in ("op6_near_duplicates", "op10_mix_sources")}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    for n, rows in want.items():
        assert sorted(map(str, queries.QUERIES[n](spark, SF).collect())) == rows


def test_sql_agrees(spark):
    import duckdb

    for name, sql in queries.ORACLE_SQL.items():
        c = duckdb.connect()
        for t in ("documents", "benchmark"):
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = c.sql(sql)
        got = queries.QUERIES[name](spark, SF).select(*want.columns)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall())), name


def test_pipeline_stages_equal_brute_force(spark, table):
    import corpus_pipeline as p

    docs = {r["doc_id"]: r for r in table.collect()}
    model = toxicity.learn_toxicity(table, spark.read.parquet(f"{SF}/labels.parquet"))
    left = [d for d in sorted(docs) if model.score(docs[d]["text"].encode())[0] < toxicity.THRESHOLD]
    kept = brute.near_duplicates([(d, docs[d]["text"]) for d in left], 5)
    left = [d for d in left if kept[d][2]]
    dirty = brute.decontaminate([(d, docs[d]["text"]) for d in left], [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    left = [d for d in left if not dirty[d][4]]
    out = p.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} <= set(left)
    words = {d: len(brute.WORD.findall(docs[d]["text"])) for d in left}
    taken = Counter()
    for r in out:
        taken[r["doc_id"]] += 1
    assert abs(sum(words[d] * n for d, n in taken.items()) - sum(words.values())) <= 20 * max(words.values())
    assert max(taken.values()) <= 3 and all(r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]["text"].encode()) for r in out)
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_pipeline_keeps_texts_with_null_or_shared_ids(spark, tmp_path):
    import corpus_pipeline as p

    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{i}v{w}" for w in rng.integers(0, 10_000, 40)) for i in range(9)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, None), (1, texts[2]), (1, texts[2]), (1, texts[3]), (2, texts[4]), (2, texts[5]), (3, texts[5]), (1, texts[6]), (None, texts[6]), (4, texts[7]), (4, texts[8])]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = p.drop_near_duplicates(spark, docs, SF)
    found = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert found == Counter([(None, texts[0]), (None, texts[1]), (None, None), (1, texts[2]), (1, texts[3]), (2, texts[4]), (2, texts[5]), (1, texts[6]), (4, texts[7]), (4, texts[8])])
    spark.createDataFrame([(1, texts[7]), (2, texts[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = p.drop_contaminated(spark, left, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == found - Counter([(4, texts[7]), (None, texts[0])])
    mixed = Counter((r["doc_id"], r["text"]) for r in p.mix_sources(spark, clean.filter("text is not null"), SF).collect())
    assert set(mixed) == set(found) - {(4, texts[7]), (None, texts[0]), (None, None)}


def test_toxicity_votes_equal_brute_force(spark):
    """Votes and calibrated scores from cosines worked out in full, and awkward rows."""
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, (" ".join(rng.choice(words, 12)) + (" nasty vile" if i % 4 == 0 else "") + (" vile" if i % 9 == 0 else "")).encode(), int(i % 4 == 0)) for i in range(300)]
    model = toxicity.Neighbours.learn(rows, {0: 900, 1: 75})
    terms = sorted(model.vocabulary, key=model.vocabulary.get)
    examples = {k: Counter(t.decode().split()) for k, t, _ in rows}

    def vector(counts):
        raw = {t: (1 + np.log(counts[t.decode()])) * model.idf[i] for i, t in enumerate(terms) if counts.get(t.decode())}
        size = sum(x * x for x in raw.values()) ** 0.5
        return {t: x / size for t, x in raw.items()}

    assert set(terms) <= {b"nasty", b"vile"}
    y, w = dict(zip(model.keys.tolist(), model.labels)), dict(zip(model.keys.tolist(), model.weights))
    place = {k: i for i, k in enumerate(model.keys.tolist())}
    for text in ("a vile text", "nasty", "vile vile nasty word1"):
        v = vector(Counter(text.split()))
        cosines = sorted(((round(sum(v[t] * u.get(t, 0) for t in v), 12), -place[k], k) for k in y for u in [vector(examples[k])] if any(t in u for t in v)), reverse=True)[: toxicity.NEIGHBOURS]
        votes = [(w[k] / (0.05 + 1 - c), y[k]) for c, _, k in cosines]
        share = sum(a * b for a, b in votes) / sum(a for a, _ in votes)
        assert abs(model.vote(model.vector(toxicity.terms_of(text.encode())))[0] - share) < 1e-6
        x, level = model.steps
        want = 0.98 * level[min(np.searchsorted(x, share), len(level) - 1)] + 0.02 * share
        assert abs(model.score(text.encode())[0] - want) < 1e-4
    assert (np.diff(model.steps[1]) > 0).all()


def test_toxicity_on_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, 1, None), (7, 0, 1), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn_toxicity(docs, labels)
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert abs(toxicity.learn_toxicity(docs.limit(0), labels).score(b"x")[0] - 2 / 3) < 1e-9 and toxicity.learn_toxicity(docs, labels.limit(0)).score(b"x")[0] == 0


def test_pipeline_stages_on_awkward_rows(spark, docs):
    import corpus_pipeline as p

    for rows in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, rows.withColumn("_key", F.lit(1)).withColumn("target", F.lit(2)), SF)
            if name != "sharding":
                assert out.columns == p.COLUMNS, name
            n = out.count()
            assert n == 0 if rows is not docs else 0 < n <= 3 * len(ROWS), name
