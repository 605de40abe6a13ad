import pytest

import __spark_entry__
from rankloom.plans.queries import ORACLES, QUERIES

from .oracle import SF, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_ranks_planted_models(spark):
    ranked = [r["model"] for r in __spark_entry__.entry(spark).orderBy("rank").collect()]
    assert ranked == ["planted-0.2", "planted-0.1", "planted-0.05", "planted-0.02", "planted-0.0"]


@pytest.mark.parametrize("metric", ["logme", "knn"])
def test_planted_signal_orders_models(spark, metric):
    rows = QUERIES[f"rank_planted_{metric}"](spark, SF).orderBy("rank").collect()
    assert [r["model"] for r in rows] == ["planted-0.2", "planted-0.1", "planted-0.05", "planted-0.02", "planted-0.0"]


def test_concat_splits_keeps_every_language(spark, tmp_path):
    for k, some in enumerate(([(1, "de"), (2, "it"), (3, None), (4, None), (5, "")], [(1, None)], [])):
        spark.createDataFrame(some, "doc_id long, lang string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = QUERIES["concat_splits"](spark, f"{tmp_path}/{k}").select("doc_id", "lang", "split").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((*r, r[1]) for r in some), key=repr)


def test_ranker_runs_prefer_the_telling_encoder(spark):
    rows = QUERIES["ranker_run_words"](spark, SF).collect()
    assert {(r["layer_aggregator"], r["model"]) for r in rows if r["rank"] == 1} == {(a, "telling") for a in ("bestlayer", "lastlayer", "layermean")}


def test_labels_within_the_bound_go_to_the_texts(spark):
    from rankloom.plans.queries import labelled

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    try:
        spark.conf.set(threshold, "1k")
        sent, dealt = labelled(spark, SF), labelled(spark, SF, bound=0)
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan(sent) and "Exchange hashpartitioning" not in plan(sent) and "SortMergeJoin" in plan(dealt)
        assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, dealt.collect()))
    finally:
        spark.conf.set(threshold, before)
