"""Review operators and the streaming guard at their edges."""

import math

from pyspark.sql import functions as F

from murmuration.operators import review
from murmuration.streaming.generations import newest
from murmuration.streaming.guard import keep_newest

JUDGED = "label_key string, value boolean, run string, seq long, rule_version string, confidence_milli long, correct boolean, weight long"


def plain_calibration(rows):
    cells, out = {}, []
    for run in sorted({r[2] for r in rows}):
        touched = set()
        for key, value, _, _, version, milli, correct, weight in sorted((r for r in rows if r[2] == run), key=lambda r: r[3]):
            cell = cells.get((key, value))
            if cell is None or cell[0] != version:
                cell = cells[key, value] = (version, [])
            cell[1].append((min(milli // 100, 9), milli, correct, weight))
            touched.add((key, value))
        for key, value in touched:
            version, entries = cells[key, value]
            for b in {e[0] for e in entries}:
                own = [e for e in entries if e[0] == b]
                w, w2 = sum(e[3] for e in own), sum(e[3] ** 2 for e in own)
                enough = w * w / w2 >= 20
                right = sum(e[3] for e in own if e[2]) / w
                brier = sum(e[3] * (e[1] / 1000 - e[2]) ** 2 for e in own) / w
                out.append((key, value, run, version, b, len(own), round(w * w / w2, 6), round(right, 6) if enough else None, round(brier, 6) if enough else None))
    return sorted(out, key=str)


def test_rolling_calibration_resets_with_the_version_and_equals_plain_python(spark):
    rows = [("x", i % 4 != 0, f"run{i // 60}", i, "1" if i < 70 else "2" if i < 75 else "1", 250 if i % 3 else 955, i % 5 != 0, 1 + i % 3) for i in range(300)]
    found = review.rolling_calibration(spark.createDataFrame(rows, JUDGED)).collect()
    got = sorted(((r.label_key, r.value, r.run, r.rule_version, r.bin, r.n, round(r.n_eff, 6), r.correctness and round(r.correctness, 6), r.brier and round(r.brier, 6)) for r in found), key=str)
    assert got == plain_calibration(rows)
    assert any(r[7] is None for r in got) and any(r[7] is not None for r in got)
    assert review.rolling_calibration(spark.createDataFrame([], JUDGED)).count() == 0


def test_common_words(spark):
    texts = [("a", 1, "buy now green tea"), ("a", 2, "buy now black tea"), ("a", 3, "buy now"), ("a", 4, "x y buy"), ("b", 1, "buy now"), ("c", 1, ""), ("c", 2, "")]
    got = {(r.grp, r.id): r.text for r in review.without_common_words(spark.createDataFrame(texts, "grp string, id int, text string")).collect()}
    assert got == {("a", 1): "green tea", ("a", 2): "black tea", ("a", 3): "buy now", ("a", 4): "x y", ("b", 1): "buy now", ("c", 1): "", ("c", 2): ""}


def test_scores_of_the_review(spark):
    r = spark.range(1).select(
        review.smoothed_rate(F.lit(3), F.lit(8)).alias("a"), review.smoothed_rate(F.lit(9), F.lit(8)).alias("b"), review.relative_delta(F.lit(0.0), F.lit(0.0)).alias("c"), review.relative_delta(F.lit(1.0), F.lit(0.0)).alias("d"),
        review.risk_score(F.lit(3), F.lit(2), F.lit(0.3), F.lit(0.7), F.lit(0.2)).alias("e"), review.risk_score(F.lit(0), F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.1)).alias("f"),
        review.freshness_status(F.lit(None).cast("long"), 5, 9).alias("g"), review.freshness_status(F.lit(9), 5, 9).alias("h"), review.freshness_status(F.lit(5), 5, 9).alias("i"), review.bucket_key(F.lit(9)).alias("j"), review.completeness(F.lit(0.9), F.lit(0.1), 0.8, 0.1).alias("k"),
    ).first()
    assert tuple(r) == (0.4, None, 0.0, 1.0, round(1 + 4 + math.log2(3) + 3 + 2 + 2, 3), 1.0, "unknown", "stale", "delayed", "0.9-1.0", "complete")


def test_runs_and_worst_and_dominant(spark):
    seen = [("x", "01", False, False), ("x", "02", False, True), ("x", "03", True, False), ("x", "04", False, True), ("y", "01", False, True), ("y", "02", False, False), ("z", "01", True, False)]
    runs = review.exceeded_in_a_row(spark.createDataFrame(seen, "label_key string, month string, missing boolean, exceeded boolean")).collect()
    assert {r.label_key: r.run for r in runs} == {"x": 2, "y": 0}
    rows = spark.createDataFrame([("a", "low"), ("a", "high"), ("b", "odd"), ("c", None)], "k string, s string")
    assert {r.k: r.status for r in review.worst(rows, "k", "s", ("low", "medium", "high")).collect()} == {"a": "high", "b": "unknown", "c": "unknown"}
    assert {r.k: r.dominant for r in review.dominant(spark.createDataFrame([("a", "q"), ("a", "p"), ("a", "q"), ("a", "p")], "k string, s string"), "k", "s").collect()} == {"a": "p"}


def test_a_late_batch_replaces_nothing_newer(spark, tmp_path):
    schema = "account_id string, label_key string, id long, labeled_at long, value boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(number, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        keep_newest(stream, out, ("account_id", "label_key"), ("labeled_at", "id")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return {(r.account_id, r.id) for r in newest(spark, out, schema).collect()}

    assert feed(0, ("a", "x", 1, 10, True), ("a", "x", 2, 10, False)) == {("a", 2)}
    assert feed(1, ("a", "x", 0, 5, True), ("b", "x", 3, 1, True)) == {("a", 2), ("b", 3)}
    assert feed(2, ("a", "x", 4, 11, True)) == {("a", 4), ("b", 3)}
