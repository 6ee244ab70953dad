"""Physical plans, registration rules and the streaming merge."""

import inspect
import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from offerscope import plans
from offerscope.operators.canonical import canonicalize
from offerscope.operators.dedupe import dedupe_by_quality
from offerscope.plans import market
from offerscope.sources.tables import offers, raw_offers
from offerscope.streaming.feed import merge_batches, stream_offers


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["a1_compare", "a3_coverage", "a5_gap", "a13_positioning", "a21_missing_vs_base", "j1_dedupe_quality", "j5_validated_merge",
                                  "h6_live_check", "h7_question_names", "q2_audit", "w1_simulate", "f1_match_catalogue", "f4_match_slugs", "f6_best_of_candidates"])
def test_no_cross_joins(name, spark, sf):
    text = plan_of(plans.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_grams_are_never_broadcast(spark, sf):
    """The planner takes exploded grams for as small as the table that they come from."""
    assert "Broadcast" not in plan_of(plans.queries()["h7_question_names"](spark, sf))


@pytest.mark.parametrize("name", ["j1_dedupe_quality", "j2_dedupe_cheapest", "q1_latest_rows", "q3_validation_sample", "w9_interleave"])
def test_groups_are_cut_before_the_shuffle(name, spark, sf):
    text = plan_of(plans.queries()[name](spark, sf))
    assert text.index("WindowGroupLimit") >= 0 and re.search(r"WindowGroupLimit[\s\S]*Partial|Partial[\s\S]*WindowGroupLimit", text)


def test_scans_read_only_needed_columns(spark, sf):
    text = plan_of(market.R.by_competitor(offers(spark, sf)))
    schema = re.findall(r"ReadSchema: (struct<l_[^>]*>)", text)[0]
    assert "l_tax" not in schema and "l_extendedprice" in schema


def test_gate_runs_in_generated_code(spark, sf):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_of(dedupe_by_quality(canonicalize(raw_offers(spark, sf))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "codegen id" in text and "PythonUDF" not in text and "lambdafunction" not in text


@pytest.mark.parametrize("name", ["e2_teaser", "f15_search_cards", "g_reason_counts", "j1_dedupe_quality", "l6_publishable", "n2_canonicalize", "p9_first_and_keyword_price"])
def test_generated_methods_are_compiled(name, spark, sf):
    """The virtual machine interprets methods of more than 8,000 bytes, however often they run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert stages.size() > 0 and max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= 8000


@pytest.mark.parametrize("name", ["j4_slice_replacement", "j5_validated_merge"])
def test_existing_rows_are_not_moved_by_the_slice(name, spark, sf):
    """The few selected keys are known before the merge is planned, and come to the existing rows."""
    assert not re.search(r"Arguments: hashpartitioning\([^)]*k_model", plan_of(plans.queries()[name](spark, sf)))


def test_cards_are_not_judged_inside_the_join(spark, sf):
    """There the condition would clean both names for each family and variant."""
    text = plan_of(plans.queries()["f15_search_cards"](spark, sf))
    assert text.count("promotion") < 10


def test_hot_key_is_not_gathered(spark, sf):
    """With a third of all rows under one key, no task after the shuffle sees that third."""
    hot = offers(spark, sf).withColumn("model", F.when(F.col("term_months").isNull(), "hot").otherwise(F.col("model")))
    compared = market.C.groups(hot)
    assert compared.where("model = 'hot'").agg(F.sum("n_offers")).first()[0] == hot.where("model = 'hot'").count()
    assert "HashAggregate" in plan_of(compared) or "SortAggregate" in plan_of(compared)


def test_library_never_uses_forbidden_actions():
    import pathlib

    root = pathlib.Path(inspect.getfile(plans)).parents[1]
    for path in root.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".crossJoin(" not in text and ".toPandas(" not in text, path
        assert ".collect()" not in text, path


def test_stream_merges_batch_by_batch(spark, sf, tmp_path):
    rows = canonicalize(raw_offers(spark, sf)).withColumn("_ord", F.xxhash64("_ord"))
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    first, second = rows.where("snapshot_id < '1999-01'"), rows.where("snapshot_id >= '1999-01'")
    first.coalesce(1).write.parquet(source)
    writer = merge_batches(stream_offers(spark, source, rows.schema), root).option("checkpointLocation", str(tmp_path / "cp"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    second.coalesce(1).write.mode("append").parquet(source)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    v0, v1 = (spark.read.parquet(f"{root}/version={i}") for i in range(2))
    kept = {r.retailer for r in v0.select("retailer").distinct().collect()}
    assert 0 < len(kept) <= first.select("retailer").distinct().count()
    assert v0.count() == dedupe_by_quality(first).where(F.col("retailer").isin(*kept)).count()
    assert v1.count() >= v0.count() * 0.5
    assert v1.where("extracted_at >= '1999-01'").count() > 0


def test_audit_looks_at_the_base_products_alone(spark):
    """Other products leave before the latest rows are looked for; blanks around a key still mean the same product."""
    rows = [("Home Store", "a", "m1", None, "cash", None, 100, "2020-01-01", 1), (" Home Store", " a", "m1 ", None, "cash", None, 90, "2019-01-01", 2),
            ("Amazon", "a ", "m1", None, "cash", None, 200, "2020-01-01", 3), ("Amazon", "a", "m1", None, "cash", None, 95, "2021-01-01", 4),
            ("Fnac", "a", "m1", None, "cash", 12, 300, "2020-01-01", 5), ("Fnac", "a", "m2", 64, "cash", None, 300, "2020-01-01", 6),
            ("Fnac", None, "m1", None, "cash", None, 300, "2020-01-01", 7), ("Orange", "a", "m1", None, "cash", None, 10, "2020-01-01", 8)]
    o = spark.createDataFrame([(*r[:6], float(r[6]), *r[7:], "url") for r in rows],
                              "retailer string, brand string, model string, capacity_gb int, offer_type string, term_months int, price_value double, extracted_at string, _ord long, source_url string")
    for ignore, kept in ((False, [1, 2, 3, 4, 8]), (True, [1, 2, 3, 4, 5, 8])):
        beside = market.C.beside_base(o, ignore_term=ignore)
        assert beside.columns == o.columns and sorted(r._ord for r in beside.collect()) == kept
        whole = market.C.audit(market.latest_rows(o), ignore_term=ignore).collect()
        assert whole and sorted(map(str, market.audit(o, ignore).collect())) == sorted(map(str, whole))


def test_product_keys_are_worked_out_before_the_join(spark, sf):
    """Once per product, not for each of its prices."""
    from offerscope.plans.matching import price_points

    text = price_points(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "iphone" in text[text.index("Join"):] and "iphone" not in text[:text.index("Join")]


def test_names_are_cleaned_once(spark, sf):
    """The clean name is one column of the plan, whatever reads it."""
    text = plans.queries()["f0_f4b_name_features"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("^(apple|samsung)") == 1


def test_seeds_spelled_alike_meet_before_the_first_cut(spark):
    """No task sorts seeds in the order of the input; columns that are keys are not copied; other spellings still share a seed."""
    from offerscope.operators.dedupe import best_seed_per_model, first_per_key

    rows = [("Mobile", " Galaxy  S25", 64, "a", 5), ("mobile", "galaxy s25", 64, "ab", 7), ("mobile", "galaxy s25", 64, "ab", 6),
            ("mobile", "galaxy s25", None, "", 1), (None, None, None, None, 3), (None, "", None, "", 4)] + [("mobile", "hot", 1, "x", i) for i in range(50, 10, -1)]
    seeds = spark.createDataFrame(rows, "device_type string, model string, capacity_gb int, product_code string, _ord long")
    best = best_seed_per_model(seeds, F.length("product_code"))
    assert sorted(r._ord for r in best.collect()) == [1, 4, 6, 11]
    text = best._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Window ") < text.index("RebalancePartitions")
    assert "_k" in text and "AS _k2" not in text
    assert " AS _k0" not in first_per_key(seeds, ["model"], [F.col("_ord").asc()])._jdf.queryExecution().optimizedPlan().toString()


def test_sample_takes_the_first_distinct_of_every_task(spark):
    """A retailer's offers are dealt to tasks and moved whole only once; the result is that of one ordered walk over all of them."""
    import random

    from offerscope.fixed import VALIDATION_PRIORITY
    from offerscope.operators.ordering import validation_sample

    pick = random.Random(3)
    kinds = [*VALIDATION_PRIORITY, "Cash", "other"]
    rows = [(pick.choice(["A", "B", None]), pick.choice(kinds), pick.choice(["x", "X", " x", "y"]), pick.choice([None, 0, 64]), pick.choice([None, 6]), pick.choice(["u", None]), i)
            for i in range(300)] + [("hot", "cash", pick.choice(["m", "M "]), 64, None, "u", i) for i in range(300, 500)]
    offers_ = spark.createDataFrame(rows, "retailer string, offer_type string, model string, capacity_gb int, term_months int, source_url string, _ord long")
    expected, seen, taken = [], set(), {}
    for r in sorted(rows, key=lambda r: (VALIDATION_PRIORITY.get(r[1], 9), r[2], r[3] or 0, r[6])):
        key = (r[0], r[2].strip().lower(), r[3], r[1].strip().lower(), r[4], r[5])
        if key not in seen and taken.get(r[0], 0) < 3:
            expected.append(r[6])
            taken[r[0]] = taken.get(r[0], 0) + 1
        seen.add(key)
    found = validation_sample(offers_, 3)
    assert found.columns == offers_.columns and sorted(r._ord for r in found.collect()) == sorted(expected)
    text = plan_of(validation_sample(offers_, 3)).split("(1) ")[0]
    assert text.count("Exchange") == 3 and "WindowGroupLimit" not in text[text.rindex("Exchange"):]
