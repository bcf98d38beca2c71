"""Rules chosen by name: the same rows as of all rules, without what the others ask of other rows."""

from murmuration.operators import rules

ACCOUNT = "id string, screen_name string, tweet_count long, age_days double, fetched boolean"
POST = "id string, account_id string, at_us long, text string, is_reply boolean, is_retweet boolean, is_promoted boolean, is_paid boolean, in_reply_to string"


def test_one_rule_alone(spark):
    accounts = spark.createDataFrame([("a", "ann", 5, 1.0, True), ("b", "bob", 5, 1.0, False)], ACCOUNT)
    posts = spark.createDataFrame([(f"p{i}", "a", i * 1_000_000, "the same long text sent to everyone", True, False, False, False, f"t{i}") for i in range(6)], POST)
    key = "cross_target_templated_reply"
    one = rules.rules(accounts, posts, only=(key,))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in rules.rules(accounts, posts).where(f"label_key = '{key}'").collect()}
    assert one.where("value").count() == 1
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("Join") == 1
