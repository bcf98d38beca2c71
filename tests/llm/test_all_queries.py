"""Every query of the subpackage and the pipeline, on empty tables and on a few awkward rows."""

import pytest
from helpers import frame, rows

import corpus_pipeline
from murmuration.llm.queries import QUERIES

LABELS, TURNS = "doc_id long, quality int, toxic int", "conv_id long, turn long, role string, text string"
ALL = {**QUERIES, "pipeline": corpus_pipeline.run}


@pytest.fixture(scope="module")
def few():
    made = [r for r in rows(seed=11, n=14) if r[1] is None or len(r[1]) < 3000]
    return [*made, (None, "no id at all, but some words", None, None, None), made[0], made[0]]


@pytest.fixture(scope="module")
def folders(spark, few, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    for name, data in (("empty", []), ("few", few)):
        frame(spark, data).coalesce(1).write.parquet(f"{base}/{name}/documents.parquet")
        known = [(r[0], int(r[0] % 3 > 0), int(r[0] % 5 == 0)) for r in data if r[0] is not None]
        spark.createDataFrame([*known, *([(None, 1, None)] if known else [])], LABELS).coalesce(1).write.parquet(f"{base}/{name}/labels.parquet")
        spark.createDataFrame([(1, 0, "user", "Hi.")] if data else [], TURNS).coalesce(1).write.parquet(f"{base}/{name}/conversations.parquet")
    return base


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables_give_empty_results(spark, folders, name):
    assert ALL[name](spark, f"{folders}/empty").collect() == []


@pytest.mark.parametrize("name", sorted(set(ALL) - {"op12_conversations"}))
def test_each_row_has_a_result(spark, folders, few, name):
    got = ALL[name](spark, f"{folders}/few").collect()
    if name == "pipeline":
        assert {r["doc_id"] for r in got} <= {r[0] for r in few} and got
    elif name != "op7_line_dedup":
        assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(map(repr, (r[0] for r in few)))
    else:
        assert {r["doc_id"] for r in got} <= {r[0] for r in few}


