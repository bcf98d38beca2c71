"""The counts that a stream keeps up: labels are joined batch by batch, no Python state is called for each of them."""

from murmuration.streaming import counts, generations

ROW = "account_id string, label_key string, value boolean, confidence_milli long, rule_version string, reason string, labeled_us long, id string"
COUNTS = "label_key string, kind string, name string, n long, milli long"


def test_a_batch_is_a_join_without_state(spark, tmp_path):
    rows = [("a", "x", True, 450, "1", "p", 120_000_000, "r1"), ("a", "x", False, 1000, "2", "q", 60_000_000, "r2"), ("b", "x", None, 0, "1", "p", 59_999_999, "r3")]
    for n, row in enumerate(rows):
        spark.createDataFrame([row], ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ROW).parquet(f"{tmp_path}/in")
    query = counts.keep_counts(stream, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert all(p["stateOperators"] == [] for p in query.recentProgress)
    got = {tuple(r) for r in generations.newest(spark, f"{tmp_path}/out", COUNTS).collect()}
    want = {("value", "true", 1, 450), ("decile", "4", 1, 0), ("version", "1", 2, 0), ("minute", "2", 1, 0), ("reason", "p", 1, 0), ("value", "false", 1, 0), ("decile", "0", 1, 0), ("minute", "0", 1, 0)}
    assert got == {("x", *w) for w in want}
