"""Lines of the made payloads that are cut off."""

from murmuration.sources import payloads, signals


def test_a_line_that_is_cut_off_is_never_whole(spark, tmp_path):
    """Account 1517 is without its legacy part and cut at 40 characters, which is all that its line has."""
    spark.createDataFrame([(1517,), (41,), (37,), (43,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    bad = payloads.rejected(signals.raw_users(spark, str(tmp_path)), payloads.USER)
    assert sorted(r["problem"] for r in bad.collect()) == ["incomplete", "malformed", "malformed", "malformed"]
