"""Rules are worked out once a row: not inside what is exploded, and a text is normalised once."""

from pyspark.sql import functions as F

from murmuration.operators import rules, swarms


def generated(df):
    """What the plan's explodes are made of."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode" in x]


def test_long_form_explodes_columns(spark):
    rows = spark.range(5).selectExpr("CAST(id AS STRING) AS account_id", "id AS n")
    ratio = F.when(F.col("n") > 2, F.col("n") / 4).otherwise(0.0)
    out = rules.long_form(rows, {"a": ("1.0.0", ratio >= 0.5, ratio, F.col("n") > 0, F.concat(F.lit("ratio="), ratio.cast("string"))), "b": ("2.0.0", ratio < 0.5, ratio, F.lit(True), F.lit("b"))})
    assert len(generated(out)) == 1 and "CASE" not in generated(out)[0]
    got = {(r["account_id"], r["label_key"]): tuple(r)[3:] for r in out.collect()}
    assert got["0", "a"] == (False, 0.5, False, "ratio=0.0") and got["3", "a"] == (True, 0.75, True, "ratio=0.75") and got["1", "b"] == (True, 0.0, True, "b") and len(got) == 10


def test_first_replies_normalise_once(spark):
    rows = spark.createDataFrame([("r1", "u1", 0, "t", "@x What a  wonderful photo of it"), ("r2", "u2", 0, "t", "short"), ("r3", "u3", 0, "t", None)], "id string, account_id string, at_us long, target string, text string")
    out = swarms.first_replies(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert [tuple(r) for r in out.collect()] == [("t", "u1", 0, "what a wonderful photo of it")]
