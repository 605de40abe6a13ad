import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators import prepare
from rankloom.operators.prepare import Preparer, Task


@pytest.fixture
def custom(spark):
    rows = [("whatsup", "Papers", 1, 100), ("quick", "with", 0, 200), ("", "code", 2, 300), ("datasets", "humboldt", 1, 400), ("test", "focus", 2, 500)]
    return spark.createDataFrame(rows, "text string, other string, label int, extra int")


def test_finds_columns():
    assert prepare.find_column(["other", "text", "label"], "text") == "text"
    assert prepare.find_column(["sentence", "some_text"], "text") == "some_text"  # keywords come before columns
    assert prepare.find_column(["x", "ner_tags"], "label") == "ner_tags"
    with pytest.raises(ValueError):
        prepare.find_column(["Text"], "text")


def test_samples_exactly_and_repeatably(custom):
    df = prepare.with_row_id(custom)
    assert prepare.downsample(df, 0.5).count() == 2
    assert sorted(prepare.downsample(df, 0.5).collect()) == sorted(prepare.downsample(df.repartition(3), 0.5).collect())
    assert prepare.downsample(df, 0.1).count() == 0
    assert prepare.downsample(df, 1.0).count() == 5
    with pytest.raises(ValueError):
        prepare.downsample(df, 1.5)


def test_cleans_rows(spark, custom):
    assert prepare.clean_rows(custom, "text", "label").count() == 4
    rows = [("a", 1), (" ", 1), ("a️", 1), (None, 1), ("b", None), ("c", -1), ("", 1)]
    df = spark.createDataFrame(rows, "text string, label int")
    assert sorted(r["text"] for r in prepare.clean_rows(df, "text", "label").collect()) == [" ", "a"]
    tags = spark.createDataFrame([(["a"], [1, None]), (["a"], [1, -1]), (["a"], []), ([], [1]), (["a", "️"], [1, 1]), (["a", None], [1])], "tokens array<string>, tags array<int>")
    assert prepare.clean_rows(tags, "tokens", "tags").count() == 3


def test_merges_pairs(custom):
    merged, name = prepare.merge_pair(custom, "text", "other")
    assert name == "text_pair_other" and merged.first()[name] == "whatsup [SEP] Papers"
    with pytest.raises(ValueError):
        prepare.merge_pair(custom, "text", "missing")


@pytest.mark.parametrize(
    "kind, pair, task",
    [
        (T.IntegerType(), None, Task.TEXT_CLASSIFICATION),
        (T.LongType(), "b", Task.PAIR_CLASSIFICATION),
        (T.StringType(), None, Task.TEXT_CLASSIFICATION),
        (T.FloatType(), None, Task.TEXT_REGRESSION),
        (T.DoubleType(), "b", Task.SENTENCE_SIMILARITY),
        (T.ArrayType(T.IntegerType()), "b", Task.TOKEN_CLASSIFICATION),
    ],
)
def test_infers_tasks(kind, pair, task):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("y", kind)])
    assert prepare.infer_task(schema, "y", pair) == task


@pytest.mark.parametrize("kind", [T.BooleanType(), T.TimestampType(), T.DecimalType(), T.MapType(T.StringType(), T.StringType())])
def test_rejects_other_label_types(kind):
    with pytest.raises(ValueError):
        prepare.infer_task(T.StructType([T.StructField("y", kind)]), "y")


def test_rejects_null_labels_when_inferring(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "text string, label int")
    with pytest.raises(ValueError):
        Preparer()(df)
    assert Preparer(task_category=Task.TEXT_CLASSIFICATION)(df).data.count() == 1
    with pytest.raises(ValueError):
        Preparer()(df.limit(0))
    with pytest.raises(ValueError):
        Preparer()("trec")


@pytest.mark.parametrize("bound", [0, prepare.BROADCAST_BYTES])
def test_long_label_maps_are_joined(spark, bound):
    df = spark.range(3000).selectExpr("id", "if(id % 100 = 7, null, concat('l', id % 1000)) label", "'x' name", "id idx")
    mapping = {f"l{i}": i for i in range(1000)}
    made = prepare.encode_labels(df, "label", mapping, bound)
    assert ("BroadcastHashJoin" in made._jdf.queryExecution().toString()) == bool(bound)  # as planned, before any row is read
    assert made.columns == df.columns and dict(made.dtypes)["label"] == "int"
    assert {(r["id"], r["label"]) for r in made.collect()} == {(i, None if i % 100 == 7 else i % 1000) for i in range(3000)}
    with pytest.raises(Exception, match="not in the label map"):
        prepare.encode_labels(df, "label", {k: v for k, v in mapping.items() if v != 5}, bound).collect()


def test_label_maps(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    mapping = prepare.label_map(df, "label")
    assert mapping == {"a": 0, "b": 1}
    assert [r["label"] for r in prepare.encode_labels(df, "label", mapping).collect()] == [1, 0, 1]
    ints = spark.createDataFrame([(5,), (1,), (2,)], "label int")
    assert prepare.label_map(ints, "label") == {"1": 0, "2": 1, "5": 2}
    assert sorted(r["label"] for r in prepare.encode_labels(ints, "label", {"1": 0}).collect()) == [1, 2, 5]
    named = df.select(F.col("label").alias("label", metadata={"names": ["x", "y"]}))
    assert prepare.label_map(named, "label") == {"x": 0, "y": 1}
    lists = spark.createDataFrame([(["b", "a"],)], "label array<string>")
    assert prepare.encode_labels(lists, "label", mapping).first()["label"] == [1, 0]
    with pytest.raises(Exception, match="label map"):
        prepare.encode_labels(df, "label", {"a": 0}).collect()


def test_strips_bio(spark):
    names = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC"]
    df = spark.createDataFrame([([0, 1, 2, 8, 7],)], "tags array<int>")
    stripped, mapping = prepare.remove_bio(df, "tags", {n: i for i, n in enumerate(names)})
    assert mapping == {"O": 0, "PER": 1, "ORG": 2, "LOC": 3, "MISC": 4}
    assert stripped.first()["tags"] == [0, 1, 1, 4, 4]
    with pytest.raises(Exception, match="label map"):
        prepare.remove_bio(df, "tags", {"O": 0, "B-X": 1})[0].collect()


def test_prepares_splits_and_tokens(spark, custom):
    prepared = Preparer(text_pair_column="other", dataset_downsample=0.8)({"train": custom, "test": custom})
    assert prepared.task == Task.PAIR_CLASSIFICATION and prepared.text == "text_pair_other" and prepared.data.count() == 8
    tags = spark.createDataFrame([(["x", "y"], ["B-A", "O"]), (["z"], ["I-A"])], "tokens array<string>, ner_tags array<string>")
    made = Preparer()(tags)
    assert made.task == Task.TOKEN_CLASSIFICATION and made.label_map == {"A": 0, "O": 1}
    assert sorted((r["word_pos"], r["label"]) for r in made.targets().collect()) == [(0, 0), (0, 0), (1, 1)]


def test_row_ids_are_unique_and_samples_do_not_depend_on_partitions(custom):
    twice = custom.unionAll(custom)
    numbered = prepare.with_row_id(twice)
    ids = sorted(r["row_id"] for r in numbered.collect())
    assert len(set(ids)) == 10 and ids == sorted(r["row_id"] for r in numbered.collect())
    samples = []
    for some in (twice, twice.repartition(5), twice.repartition(1)):
        got = prepare.Preparer(dataset_downsample=0.5)(some)
        samples.append(sorted((r[got.text], r[got.label]) for r in got.data.collect()))
    assert samples[0] == samples[1] == samples[2] and len(samples[0]) <= 5


def test_keys_of_any_type_must_be_unique(spark):
    rows = [(f"k{i}", f"text {i}", i % 2) for i in range(20)]
    made = prepare.with_row_id(spark.createDataFrame(rows, "k string, text string, label int"), "k")
    assert made.schema["row_id"].dataType.typeName() == "long" and made.select("row_id").distinct().count() == 20
    for more in (("k3", "again", 1), (None, "none", 0)):
        with pytest.raises(ValueError, match="keys"):
            prepare.with_row_id(spark.createDataFrame([*rows, more], "k string, text string, label int"), "k")


def test_sample_looks_into_crowded_bins(spark, monkeypatch):
    monkeypatch.setattr(prepare, "EDGE_ROWS", 1)
    df = spark.range(3000).withColumnRenamed("id", "row_id")
    crowded = prepare.downsample(df, 0.3)
    monkeypatch.undo()
    assert crowded.count() == 900 and sorted(map(tuple, crowded.collect())) == sorted(map(tuple, prepare.downsample(df, 0.3).collect()))
    same = df.withColumn("text", F.lit("x"))
    assert prepare.downsample(same, 0.5, on=F.xxhash64("text")).count() == 1500
