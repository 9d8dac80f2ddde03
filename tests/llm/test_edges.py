"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackspark.llm import fuzzy_lines, language_id, media, order_minhash, packing, paragraphs, quality_rules, sentence_pieces, substrings, toxicity

LONG = " ".join(f"word{i % 977} of{i % 13}." for i in range(30_000))
ROWS = [
    (1, "Hello there, this is a small text.\nWith two lines.", "en", "a", 50, 1),
    (2, None, "en", "a", None, 1),
    (3, "", None, None, 0, 1),
    (4, LONG, "en", "b", len(LONG), 2),
    (5, LONG, "en", "b", len(LONG), 2),
    (6, "\n\n  \t\n", "de", "b", 6, 2),
    (6, "\n\n  \t\n", "de", "b", 6, 2),
    (7, "日本語のテキストです。<|endoftext|> und Übermut", None, "c", 20, 3),
    (None, "no id, and a line that stands alone here", "en", "c", 40, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone long"
LABELS = [(1, 0), (4, 1), (5, 1), (7, 0), (2, 0), (None, 1), (9, 1), (8, None)]


@pytest.fixture(scope="module")
def docs(spark):
    names = SCHEMA + ", lines string, places string, rest string, `key.dot` int"
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in ROWS], names)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


OPERATORS = {
    "line_frequency": lambda d, labels: quality_rules.line_frequency(d),
    "substrings": lambda d, labels: substrings.remove_repeats(d),
    "packing": lambda d, labels: packing.pack(d),
    "language": lambda d, labels: language_id.identify(d, language_id.fit_profiles(d)),
    "lines": lambda d, labels: fuzzy_lines.dedup_lines(d),
    "near": lambda d, labels: order_minhash.near_duplicates(d),
    "pieces": lambda d, labels: sentence_pieces.encode(d),
    "toxicity": lambda d, labels: toxicity.score(d, toxicity.fit(d, labels)),
    "media": lambda d, labels: media.media_columns(d),
    "paragraphs": lambda d, labels: paragraphs.remove_paragraphs(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("name", ["line_frequency", "language", "pieces", "toxicity", "media"])
def test_row_by_row_operators_keep_every_row(docs, labels, name):
    assert OPERATORS[name](docs, labels).count() == len(ROWS)


def test_line_frequency(docs):
    found = by_id(quality_rules.line_frequency(docs))
    assert found[2]["n_words"] == found[3]["n_words"] == found[6]["n_words"] == 0
    assert found[2]["base_failed"] and not found[2]["kept"]
    assert found[4]["n_words"] == 60_000 and found[4]["word_chars"] == len(LONG) - LONG.count(" ")


def test_substrings(docs):
    found = by_id(substrings.remove_repeats(docs))
    assert len(found) == len(ROWS) - 1  # rows of one doc_id are one document
    assert found[5]["n_removed"] == found[5]["n_bytes"] == len(LONG) and found[5]["n_spans"] == 1
    assert found[5]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found[2]["n_bytes"] == 0 and found[None]["n_removed"] == 0


def test_packing_tiles_every_document(docs):
    rows = packing.pack(docs, with_ids=True).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 1  # only the closing id
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(fill) == list(range(len(fill))) and sum(sum(n for _, n in p) for p in fill.values()) > 1024 * (len(fill) - 1)


def test_packing_targets(docs):
    rows = packing.pack(docs, window=4096, targets={"b": 0.5}).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}


def test_language(docs):
    found = by_id(language_id.identify(docs, language_id.fit_profiles(docs)))
    assert [found[i]["lang_pred"] for i in (2, 3, 6)] == ["und"] * 3
    assert found[4]["lang_pred"] == "en" and 0 <= found[4]["score"] <= 1
    assert found[7]["lang_pred"] != "und"


def test_lines(docs):
    found = by_id(fuzzy_lines.dedup_lines(docs))
    assert found[2]["text"] is None and found[2]["n_lines"] == 0
    assert found[3]["text"] == "" and found[6]["text"] == "\n\n  \t\n"
    assert found[4]["text"] == LONG and found[5]["text"] == "" and found[5]["n_removed"] == 1


def test_near(docs):
    found = by_id(order_minhash.near_duplicates(docs))
    assert found[5]["class_id"] == 4 and found[5]["exact"] and found[5]["class_size"] == 2
    assert [found[i]["class_id"] for i in (2, 3, 6)] == [2, 3, 6]
    assert found[None]["class_id"] is None


def test_paragraphs(docs):
    found = by_id(paragraphs.remove_paragraphs(docs))
    assert found[5]["n_removed"] == 1 and found[5]["n_words_removed"] == found[5]["n_words"] == 60_000 and found[5]["text"] == ""
    assert 25_000 < found[4]["n_words"] - found[4]["n_words_removed"] < 26_000  # it repeats itself after 25,402 words
    assert found[2]["text"] is None


def test_media(docs):
    found = by_id(media.media_columns(docs))
    assert found[2]["payload_bytes"] == 192 and found[2]["payload_sha256"] == found[3]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()
    assert found[7]["n_bytes"] == len(ROWS[7][1].encode())
    assert found[4]["media_sha256"] == found[5]["media_sha256"]


def test_stages_keep_columns_and_types(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        empty = stage(spark, now.limit(0), str(tmp_path))
        assert empty.count() == 0
        if name == "packing":
            assert out.count() >= 1
            break
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    kept = {r["doc_id"] for r in now.select("doc_id").collect()}
    assert {1, 7} <= kept and not {4, 5} <= kept


def test_stages_with_maps_and_names_that_differ_in_case(spark, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line, {"a": 1}, "x", "en"), (1, line, {"b": 2}, "y", "en"), (2, line + " z", None, None, None), (3, None, {}, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, facts map<string,int>, `Text` string, source string")
    for name, run in OPERATORS.items():
        assert {r["doc_id"] for r in run(docs.withColumn("lang", F.lit("en")), labels).collect()} == {1, 2, 3}, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {r[0] for r in out.collect()} >= {1, 3}, name


def test_same_result_for_any_partitioning(spark, docs):
    one = docs.repartition(1).orderBy(F.desc("doc_id"))
    many = docs.repartition(7)
    for run in (substrings.remove_repeats, order_minhash.near_duplicates, fuzzy_lines.dedup_lines, paragraphs.remove_paragraphs):
        assert sorted(map(str, run(one).collect())) == sorted(map(str, run(many).collect()))


def test_rows_that_repeat_an_id_are_documents(spark, tmp_path):
    """Two texts under one id, two without id, copies of one row: every row comes back, under its own id, and the order of
    the ids tells which copy stays."""
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcdef"]
    rows = [(1, long[0]), (1, long[1]), (None, long[2]), (None, long[3]), (7, long[4]), (3, long[4]), (5, long[5]), (5, long[5]), (2, None), (2, "")]
    docs = spark.createDataFrame([(*r, "en", "a", 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    key = lambda r: tuple(str(v) for v in r)
    found = {name: OPERATORS[name](docs, None).collect() for name in ("substrings", "near", "lines", "paragraphs")}
    for name, got in found.items():
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows), name
    gone = {name: sorted(key((r["doc_id"], r[column])) for r in found[name] if r[column]) for name, column in (("substrings", "n_removed"), ("lines", "n_removed"), ("paragraphs", "n_words_removed"))}
    assert [d for d, _ in gone["substrings"]] == [d for d, _ in gone["lines"]] == [d for d, _ in gone["paragraphs"]] == ["5", "7"]
    assert sorted(key((r["doc_id"], r["class_id"])) for r in found["near"] if r["exact"]) == [("5", "5"), ("7", "3")]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, docs, str(tmp_path)).collect()
        assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "1", "None", "None", "3", "5", "2", "2"])
