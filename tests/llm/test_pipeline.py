"""The stages in order, each judged on what the one before it kept; and the queries with SQL."""

import hashlib

import pytest

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, awkward, brute_components, brute_contamination, brute_lines, brute_simhash, make
from tests.test_oracles import compare
from titleweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, small, name):
    compare(spark, small, queries.queries()[name], queries.oracle_sql()[name])


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in kept.collect()]
        out = stage(spark, kept, small)
        after = {r["doc_id"]: r for r in out.collect()}
        if k < 4:
            assert out.columns == docs.columns
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if k == 0:
            assert {i for i, t in before if t and any(c.isalpha() for c in t)} >= set(after) and len(after) >= 0.97 * len(before)
        elif k == 1:
            for i, n, gone, digest in brute_lines(before):
                if i in after:
                    assert hashlib.sha256(after[i]["text"].encode()).hexdigest() == digest
                else:
                    assert digest == hashlib.sha256(b"").hexdigest()
        elif k == 2:
            assert set(after) == set(brute_components([brute_simhash(t) for _, t in before], [i for i, _ in before]))
        elif k == 3:
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            judged = brute_contamination(before, bench)
            assert set(after) == {x[0] for x in judged if not x[5]}
            clean = {x[0] for x in judged if x[2] == 0}
            assert all(after[i]["text"] == t for i, t in before if i in clean)
        else:
            assert set(after) == {i for i, _ in before} and "ids_sha256" in out.columns
        kept = out
    ran = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in ran.collect()} == set(after)


def test_tables_on_the_way_go(spark, small):
    from pathlib import Path

    from titleweave.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "titleweave"
    before = set(folder.iterdir()) if folder.exists() else set()
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["stage-4"]


@pytest.mark.parametrize("lang", [None, "xx"])
def test_stages_with_awkward_rows(spark, small, lang):
    from pyspark.sql import functions as F

    for rows in (awkward(), []):
        docs = (make(spark, rows) if rows else spark.createDataFrame([], SCHEMA)).withColumn("lang", F.lit(lang))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, small)
            kept = [(r["doc_id"], r["text"]) for r in out.collect()] if k == 0 else None
            assert out.count() <= len(rows)
            if k < 4:
                assert out.columns == docs.columns
            if k == 0:  # without a language to learn all are undetermined; with one, every text that has a letter is kept
                want = [(i, t) for i, t in rows if lang and t and any(c.isalpha() for c in t)]
                assert sorted(kept, key=str) == sorted(want, key=str)
