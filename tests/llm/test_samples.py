"""The texts that the classifiers learn from are read where they lie."""

from murmuration.llm import quality


def test_learning_shuffles_no_texts(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('a text number ', id) AS text")
    labelled = spark.range(0, 200, 3).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (1000, 20):
            rows = quality.sampled_texts(docs, labelled, "toxic", limit)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
            assert rows.count() == 67 if limit == 1000 else 0 < rows.count() < 67
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
