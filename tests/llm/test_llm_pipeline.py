"""Pipeline stages and registered queries on the small tables."""

import collections

from test_llm_documents import ODD, classes_by_hand, near_copies

import corpus_pipeline
from offerscope.llm import queries
from offerscope.llm.bagminhash import near_duplicate_stage
from offerscope.llm.repeats import substring_stage

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS)


def test_near_duplicate_stage(spark, sf):
    import random

    rows = list(near_copies(random.Random(9), 150)) + [(1000 + d, t) for d, t in ODD if d and t != "x"]
    rows += rows[:3]
    docs = documents(spark, rows)
    kept = near_duplicate_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({least for _, least, _ in classes_by_hand(rows)})
    assert near_duplicate_stage(spark, docs.limit(0), sf).count() == 0


def test_substring_stage(spark, sf):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"one  start\n{passage} end"), (2, f"two {passage}"), (3, "left  as\nit is"), (4, None), (5, passage)]
    got = {r.doc_id: (r.text, r.n_chars) for r in substring_stage(spark, documents(spark, rows), sf).collect()}
    assert got == {1: ("one start end", 13), 2: ("two", 3), 3: ("left  as\nit is", 14), 4: (None, 0), 5: ("", 0)}


def test_run(spark, sf):
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        if name != "packing":
            assert out.columns == docs.columns
            ids = [r.doc_id for r in out.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and (before is None or set(ids) <= before)
            before, docs = set(ids), out
    pieces = collections.defaultdict(int)
    for r in out.select("doc_id", "length", "doc_tokens").collect():
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert {d for d, _ in pieces} == before and all(total == n for (_, total), n in pieces.items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == before


def test_registered():
    names = set(queries.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names - {"pipeline"}}
