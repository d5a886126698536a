"""What the plans of queries may not hold, as larger tables would show it."""

from pyspark.sql import functions as F

import __spark_entry__
from tallyline.functions import money
from tallyline.operators import headers


def optimized(spark, sf, name):
    return __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_merged_headers_scores_a_cell_once(spark, sf):
    plan = optimized(spark, sf, "merged_headers")
    assert "Join" not in plan
    assert len(plan) < 200_000


def test_no_frame_is_summed_anew_for_each_row(spark, sf):
    for name in ("nearest_owner", "continuation_kinds"):
        assert "unboundedfollowing" not in optimized(spark, sf, name).lower()


def test_short_paths_say_what_the_grammar_says(spark):
    texts = [f"{a}{s}{b}" for a in ("12", "12.5", "12.50", "0.0", "1.234", "12.", "9" * 37) for s in ("", " ") for b in ("$", "USD", "₪", "NIS", "EU", "usd", "$\n")] + ["$ 12.50", "ILS12", "7/8", "a", "3 of 12", "12.50", "31/12/2023"]
    terms = [t for of in headers.TERMS.values() for t in of]
    df = spark.createDataFrame([(t,) for t in texts + terms + [t.upper() for t in terms]], "t string")
    # what follows a space takes the long way
    t, long = F.col("t"), F.concat(F.lit(" "), "t")
    rows = df.select(t, money.parse_amount(t).alias("a"), money.parse_amount(long).alias("b"), money.money_shaped(t).alias("c"), money.is_money_shaped(money.parse_amount(long)).alias("d"), headers.role_scores(t).alias("e"), headers.role_scores(long).alias("f")).collect()
    assert [r for r in rows if r.a != r.b or r.c != r.d or r.e != r.f] == []
    assert [r.t for r in rows if r.t.lower() in terms and not r.e] == []


def test_characters_and_words_are_sorted_without_a_comparator(spark, sf):
    for name in ("reading_signatures", "layout_rows"):
        plan = optimized(spark, sf, name)
        assert "sort_array(" in plan and "array_sort(" not in plan
