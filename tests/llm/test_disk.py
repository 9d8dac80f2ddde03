"""What stays in the shared folder."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from trackspark.llm import common, fuzzy_lines, order_minhash, paragraphs, set_join
from trackspark.sources.tables import shared_dir


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = []
    for _ in range(30):
        base = rng.choices(vocabulary, k=90)
        for _ in range(6):  # near copies, so that components need rounds and buckets are opened
            words = [rng.choice(vocabulary) if rng.random() < 0.02 else w for w in base]
            rows.append("\n".join([" ".join(words[:45]), " ".join(words[45:])]))
    return common.stored(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "docs")


def tables(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}


@pytest.mark.parametrize("run", [fuzzy_lines.dedup_lines, order_minhash.near_duplicates, paragraphs.remove_paragraphs, set_join.jaccard_components])
def test_only_tables_that_the_result_reads_stay(spark, docs, run):
    before = tables(spark)
    found = run(docs)
    rows = found.collect()
    read = {Path(f).parent.name for f in found.inputFiles()}
    assert len(rows) == 180 and tables(spark) - before == read - before
    assert sorted(map(str, found.collect())) == sorted(map(str, rows))


def test_stages_of_the_pipeline_drop_the_one_before(spark, monkeypatch):
    before = tables(spark)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda spark, docs, sf_dir: docs.filter("doc_id >= 0")) for n in "abc"])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == 200
    assert [n.rsplit("-", 1)[0] for n in tables(spark) - before] == ["stage-b"]


def test_dropped_tables_are_those_named(spark):
    kept, gone, other = (common.stored(spark.range(n), f"table-{n}") for n in (1, 2, 3))
    both = common.together([gone, other])
    assert both.count() == 5
    before = tables(spark)
    common.drop(both, spark.range(3))
    assert len(before - tables(spark)) == 2 and kept.count() == 1
