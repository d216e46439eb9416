"""The corpus pipeline stage by stage on the smallest tables."""

import collections
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    from hindcast.llm.scratch import kept

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, sf_dir), "test")
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def test_stages_keep_the_columns(tables):
    for rows in tables[:-1]:
        assert rows and set(rows[0]) == set(corpus_pipeline.COLUMNS)


def test_quality_keeps_good_documents(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").collect()}
    good, bad = [i for i, q in marks.items() if q == 1], [i for i, q in marks.items() if q == 0]
    assert sum(i in left for i in good) >= 0.97 * len(good) and sum(i in left for i in bad) <= 0.05 * len(bad)


def test_lines_recur_once(tables):
    homes = collections.defaultdict(set)
    before = collections.defaultdict(set)
    for seen, rows in ((before, tables[1]), (homes, tables[2])):
        for r in rows:
            for line in r["text"].split("\n"):
                if len(line.split()) >= 3:
                    seen[line].add(r["doc_id"])
    assert all(len(homes[line]) <= 1 for line, d in before.items() if len(d) >= 3)
    unique = {line for line, d in before.items() if len(d) == 1 and not re.search(r"\d", line)}
    assert sum(line in homes for line in unique) >= 0.95 * len(unique)


def test_one_of_each_group_stays(tables):
    from test_operators import linked_sets

    want = linked_sets([(r["doc_id"], r["text"]) for r in tables[2]], 5, 80)
    assert {r["doc_id"] for r in tables[3]} == {i for i, (n, root) in want.items() if n == 0 or root == i}


def test_mix_takes_whole_documents(tables):
    source = {r["doc_id"]: r for r in tables[3]}
    times = collections.Counter(r["doc_id"] for r in tables[4])
    assert max(times.values()) <= 3 and all(source[r["doc_id"]]["text"] == r["text"] for r in tables[4])


def test_last_stage_encodes_every_row(tables):
    assert collections.Counter(r["doc_id"] for r in tables[5]) == collections.Counter(r["doc_id"] for r in tables[4])
    assert all(r["n_tokens"] == len(r["ids"]) for r in tables[5])


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
