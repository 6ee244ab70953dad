"""Large numbers, long keys, repeated ids and clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

from offerscope.llm import common, repeats, toxicity, va_file
from offerscope.llm.bagminhash import near_duplicate_stage
from offerscope.llm.repeats import substring_stage
from offerscope.llm.toxicity import toxicity_stage

VECTORS = "vec_id long, v array<bigint>"


def plain_top(rows, k):
    for query, q in rows:
        if query % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != query and len(v) == len(q))
            yield from ((query, rank, i, -score) for rank, (score, i) in enumerate(scored[:k], 1))


def test_scores_above_two_to_the_53(spark):
    big = 200_000_000
    rows = [(0, [big, big, 1])] + [(i, [big, big, 8 - i]) for i in range(1, 8)]
    rnd = random.Random(11)
    rows += [(i, [rnd.randint(-(2**30), 2**30) for _ in range(3)]) for i in range(100, 400)]
    rows += [(i, [2**30 - i, 2**30, i % 7]) for i in range(400, 500)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in va_file.top_k(df, df.where("vec_id % 100 = 0"), 3).collect())
    assert got == sorted(plain_top(rows, 3))
    assert [r[2:] for r in got if r[0] == 0 and r[1] <= 3] and max(r[3] for r in got) > 2**53


def test_scores_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(0, [2**40]), (1, [2**40])], VECTORS)
    with pytest.raises(Exception, match="64 bits"):
        va_file.top_k(df, df.where("vec_id = 0")).collect()


def test_long_keys_are_not_kept():
    calls = []
    memo = common.Memo(lambda key: calls.append(key) or len(key))
    long = "x" * (common.MEMO_KEY + 1)
    assert [memo["ab"], memo["ab"], memo[long], memo[long]] == [2, 2, len(long), len(long)]
    assert calls == ["ab", long, long] and list(memo) == ["ab"]
    words = repeats.Words()
    for i in range(50):
        words.codes([b"%d" % i + b"y" * 100_000])
    assert not words.memo


def test_an_id_of_many_rows_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(i, f"text {i} {c}") for i in range(40) for c in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, toxic int")
    rows = toxicity.training_sample(docs, labels).collect()
    learnt = [r.doc_id for r in docs.select("doc_id").distinct().where(~toxicity.held_out()).collect()]
    assert len(rows) == len(learnt) and {r._text.split()[1] for r in rows} == {str(i) for i in learnt}


CLASHING = ("_text", "_key", "_at", "_unique", "kept", "n_words", "n_removed", "_other", "_number", "_toxicity", "_row", "_pivot", "score", "a.b")


def test_stages_keep_columns_of_any_name(spark, sf):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"one {passage} end"), (2, f"two {passage}"), (3, "left  as\nit is"), (4, None), (5, "left  as\nit is")]
    plain = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    more = plain.select("*", *(F.concat(F.lit(f"{name} "), "doc_id").alias(name) for name in CLASHING))
    for stage in (toxicity_stage, near_duplicate_stage, substring_stage):
        out = stage(spark, more, sf)
        assert out.columns == more.columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert {d: (r["text"], r["n_chars"]) for d, r in got.items()} == {r.doc_id: (r.text, r.n_chars) for r in stage(spark, plain, sf).collect()}
        assert all(r[name] == f"{name} {d}" for d, r in got.items() for name in CLASHING)
