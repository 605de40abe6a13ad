import logging

import pytest
from pyspark.sql import functions as F

from rankloom import ModelRanker, Result, prepare_popular_models
from rankloom.operators import pooling
from rankloom.sources.datasets import read_dataset
from rankloom.sources.embedder import Embedder
from rankloom.sources.encoders import FunctionEncoder, HashEncoder, TableEncoder, register_encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "text", "quality")


def test_parses_layers():
    assert pooling.parse_layers("all", 12) == list(range(12))
    assert pooling.parse_layers("-1,-2,-3, -4", 12) == [8, 9, 10, 11]
    assert pooling.parse_layers("0,-1,2,-3", 12) == [0, 2, 9, 11]
    with pytest.raises(ValueError):
        pooling.parse_layers("100", 12)


def test_result_orders_merges_and_prints():
    a, b = Result("hscore"), Result("hscore")
    assert str(a) == "No scores available." and a.best_model == ""
    for model, score in (("x", 1.0), ("y", 2.0), ("z", 2.0), ("n", float("nan"))):
        a.add_score(model, score)
    assert a.best_model == "y" and str(a).split("\n") == ["Rank 1. y: 2.0000", "Rank 2. z: 2.0000", "Rank 3. x: 1.0000", "Rank 4. n: nan"]
    b.add_score("x", 3.0)
    b.add_score("w", 0.5)
    a.append(b)
    assert list(a.scores) == ["x", "y", "z", "n", "w"] and a.best_model == "x"
    with pytest.raises(ValueError):
        a.append(Result("knn"))


@pytest.mark.parametrize("estimator", ["hscore", "logme", "knn"])
@pytest.mark.parametrize("aggregator", ["layermean", "lastlayer", "bestlayer"])
def test_ranks_encoders(texts, estimator, aggregator):
    ranker = ModelRanker(texts, label_column="quality", row_id="doc_id")
    result = ranker.run([HashEncoder("a"), HashEncoder("b", 3)], estimator, aggregator)
    assert len(str(result).split("\n")) == 2
    layers = {"layermean": [1, 1], "lastlayer": [1, 1], "bestlayer": [2, 3]}[aggregator]
    assert [len(result.layerwise_scores[m]) for m in ("a", "b")] == layers
    assert all(result.scores[m] == max(result.layerwise_scores[m].values()) for m in ("a", "b"))


def test_tags_words_and_stored_vectors(spark):
    rows = [(i, ["one", "two", "three"][: i % 3 + 1], [["B-A", "O", "B-B"][j] for j in range(i % 3 + 1)]) for i in range(30)]
    ranker = ModelRanker(spark.createDataFrame(rows, "id long, tokens array<string>, ner_tags array<string>"), row_id="id")
    encoder = HashEncoder("a", 2, dim=4, piece=2)
    result = ranker.run([encoder], "knn", "bestlayer")
    assert result.scores["a"] == 1.0
    stored = encoder.encode(ranker.prepared.data, ranker.prepared.text, [0, 1])
    again = ranker.run([TableEncoder("a", stored, 2)], "knn", "bestlayer")
    assert again.scores == result.scores

    def own(batch, layers):
        return [[(i, {layer: [len(w), layer] for layer in layers}) for i, w in enumerate(words)] for words in batch]

    assert ranker.run([FunctionEncoder("f", 1, own)], "logme").scores["f"] is not None


def test_rejects_unknown_options(texts):
    ranker = ModelRanker(texts, label_column="quality", row_id="doc_id")
    for options in ({"estimator": "x"}, {"layer_aggregator": "x"}):
        with pytest.raises(ValueError):
            ranker.run([HashEncoder()], **options)
    regression = ModelRanker(texts.withColumn("quality", F.col("quality").cast("float")), label_column="quality", row_id="doc_id")
    with pytest.raises(ValueError):
        regression.run([HashEncoder()], "hscore")
    assert "hash" in regression.run([HashEncoder()], "logme").scores


def test_pools_by_hand(spark):
    rows = [("m", 0, t, w, 0, [float(t), 1.0]) for t, w in [(0, None), (1, 0), (2, 0), (3, 1), (4, None)]]
    tokens = spark.createDataFrame(rows, "model string, row_id long, tok_pos int, word_id int, layer int, vec array<double>")
    words = lambda how: [r["vec"] for r in pooling.pool_words(tokens, how).orderBy("word_id").collect()]
    assert words("first") == [[1.0, 1.0], [3.0, 1.0]] and words("last") == [[2.0, 1.0], [3.0, 1.0]] and words("mean") == [[1.5, 1.0], [3.0, 1.0]]
    text = lambda how: pooling.pool_texts(pooling.pool_words(tokens), how).first()["vec"]
    assert text("mean") == pytest.approx([2.25, 1.0]) and text("weighted_mean") == pytest.approx([0.9 * 1.5 + 0.1 * 3, 1.0])
    with pytest.raises(ValueError):
        text("other")


def test_catalogue_and_readers(spark, tmp_path):
    assert len(prepare_popular_models()) == len(prepare_popular_models("tiny")) == 17 and len(prepare_popular_models("large")) == 11
    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "a.csv").write_text("text,label\nhello,1\n")
    (tmp_path / "a.json").write_text('{"text": "a", "label": 1}\n')
    assert [r["text"] for r in read_dataset(spark, str(tmp_path / "a.txt"), "text").collect()] == ["x", "y"]
    assert read_dataset(spark, str(tmp_path / "a.csv"), "csv").first()["label"] == 1
    assert set(read_dataset(spark, {"train": str(tmp_path / "a.json")}, "json")) == {"train"}
    with pytest.raises(ValueError):
        read_dataset(spark, "x", "xml")


def test_logs_nothing_globally():
    assert not logging.getLogger("rankloom").handlers


def test_embeds_texts_at_hand(spark):
    encoder = HashEncoder("a", 3, dim=4)
    words = Embedder(encoder).embed(spark, "two words")
    assert sorted((r["word_id"], r["layer"], len(r["vec"])) for r in words.collect()) == [(w, layer, 4) for w in (0, 1) for layer in (0, 1, 2)]
    assert Embedder(encoder, layer_ids="-1,0").embed(spark, [["a", "b", "c"], ["d"]]).count() == 8
    texts = Embedder(encoder, sentence_pooling="mean", layer_mean=True).embed(spark, ["x y", "z!", "\U0001f600", "1 2 3", "word " * 3000, "$%&"])
    assert texts.count() == 6 and {r["layer"] for r in texts.collect()} == {0}
    assert Embedder(encoder).embed(spark, [""]).count() == 0 and Embedder(encoder).embed(spark, []).count() == 0


def test_registered_and_loaded_encoders(texts):
    register_encoder("named", lambda: HashEncoder("named"))
    ranker = ModelRanker(texts, label_column="quality", row_id="doc_id")
    own = FunctionEncoder("loaded", 1, lambda scale, batch, layers: [[(i, {layer: [scale * len(w), 1.0] for layer in layers}) for i, w in enumerate(words)] for words in batch], load=lambda: 0.5)
    assert set(ranker.run(["named", own, "named"], "logme").scores) == {"named", "loaded"}
    with pytest.raises(ValueError):
        ranker.run(["unknown"])


def test_each_model_reads_each_text_once(spark, tmp_path):
    """Whatever passes an estimator takes; calls hold at most `batch_size` texts."""
    from rankloom import ModelRanker
    from rankloom.sources.encoders import FunctionEncoder

    log = str(tmp_path / "calls")

    def encode(words, layers):
        with open(log, "a") as f:
            f.write(f"{len(words)}\n")
        return [[(i, {layer: [len(w) + layer, i, len(w) ** 2 % 7] for layer in layers}) for i, w in enumerate(text)] for text in words]

    rows = [(i, " ".join(["ab", "cde", "f" * (i % 5 + 1)]), i % 3) for i in range(90)]
    data = spark.createDataFrame(rows, "id long, text string, label int").repartition(3)
    ranker = ModelRanker(data, row_id="id")
    for estimator in ("hscore", "logme", "knn"):
        open(log, "w").close()
        result = ranker.run([FunctionEncoder("f", 2, encode)], estimator=estimator, layer_aggregator="bestlayer", batch_size=7, subword_pooling="first")
        calls = [int(x) for x in open(log)]
        assert sum(calls) == 90 and max(calls) <= 7 and len(result.layerwise_scores["f"]) == 2


def test_models_that_need_absent_packages_fail_early():
    import importlib.util

    from rankloom.sources.encoders import TransformerEncoder

    if importlib.util.find_spec("transformers") is None:
        with pytest.raises(ImportError, match="transformers"):
            TransformerEncoder("some-model", 12)


def test_pre_tokenizer_of_the_user(spark):
    from pyspark.sql import functions as F

    from rankloom.sources.encoders import HashEncoder

    encoder = HashEncoder(dim=2)
    encoder.pre_tokenizer = lambda text: F.split(text, "-")
    df = spark.createDataFrame([(1, "a-b-c")], "row_id long, text string")
    assert {r["word_id"] for r in encoder.encode(df, "text", [0]).collect()} == {0, 1, 2}


@pytest.mark.parametrize("sentence", [None, "first", "last", "mean", "weighted_mean"])
def test_pooling_at_once_equals_its_steps(spark, sentence):
    """Texts that span Arrow batches too, and tokens without a word."""
    rows = spark.range(0, 40, numPartitions=3).withColumn("tok_pos", F.explode(F.sequence(F.lit(0), (F.col("id") % 7 * 3 + F.when(F.col("id") == 20, 9000).otherwise(1)).cast("int"))))
    rows = rows.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(2), F.lit(1))))
    word = F.when(F.col("tok_pos") % 5 > 0, (F.col("tok_pos") / 3).cast("int"))
    vec = F.array(*((F.pmod(F.xxhash64("id", "tok_pos", "layer", F.lit(i)), F.lit(1000)) / 1000.0) for i in range(2)))
    tokens = rows.select(F.lit("m").alias("model"), F.col("id").alias("row_id"), "tok_pos", word.alias("word_id"), "layer", vec.alias("vec"))
    for mean_of_layers in (False, True):
        for how in ("first", "last", "mean"):
            steps = pooling.layer_mean(tokens, ["model", "row_id", "tok_pos", "word_id"]) if mean_of_layers else tokens
            steps = pooling.pool_words(steps, how)
            want = pooling.pool_texts(steps, sentence) if sentence else steps
            got = [pooling.pool(tokens, how, sentence, mean_of_layers, gathered=True), pooling.pool(tokens.orderBy("tok_pos"), how, sentence, mean_of_layers)]
            key = lambda r: (r["row_id"], r["layer"], r.asDict().get("word_id"))
            want = {key(r): r["vec"] for r in want.collect()}
            for made in got:
                made = made.collect()
                assert len(made) == len(want) and all(r["vec"] == pytest.approx(want[key(r)], abs=1e-12) for r in made)
    with pytest.raises(ValueError):
        pooling.pool(tokens, "weighted_mean")
    with pytest.raises(ValueError):
        pooling.pool(tokens, "mean", "other")


def test_tokens_of_a_text_are_pooled_where_they_are_made(spark):
    """Vectors of tokens are not shuffled, only those of stored tables are, once."""
    texts = spark.createDataFrame([(i, "some words of a text") for i in range(8)], "row_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for encoder, shuffles in ((HashEncoder("a", 3, dim=4), 0), (FunctionEncoder("f", 3, lambda words, layers: []), 0)):
        assert plan(Embedder(encoder, sentence_pooling="mean", layer_mean=True).embed_table(texts)).count("Exchange ") == shuffles


@pytest.mark.parametrize("mean_of_layers", [False, True])
def test_wide_tokens_pool_as_layer_rows(spark, mean_of_layers):
    """Compiled and interpreted; texts of more words than the encoder takes."""
    from rankloom.sources import encoders

    rows = [(i, ["abcdefgh", "", "xyz12", "ab"] * (i % 5 * 4 + 1)) for i in range(30)]
    texts, encoder, layers = spark.createDataFrame(rows, "row_id long, words array<string>"), HashEncoder("a", 3, dim=3, max_length=20), [0, 2]
    bound = encoders.COMPILED
    for sentence in (None, "weighted_mean"):
        want = pooling.pool(encoder.tokens(texts, layers), "mean", sentence, mean_of_layers).collect()
        for encoders.COMPILED in (bound, 0):
            wide = encoder.wide_tokens(texts, layers)
            compiled = "lambdafunction" not in wide.select("vec")._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
            assert compiled == (encoders.COMPILED > 0)
            got = pooling.pool(wide, "mean", sentence, mean_of_layers, gathered=True, layers=layers).collect()
            key = lambda r: (r["row_id"], r["layer"], r.asDict().get("word_id"))
            assert sorted(map(key, got)) == sorted(map(key, want))
            vectors = {key(r): r["vec"] for r in want}
            assert all(r["vec"] == pytest.approx(vectors[key(r)], abs=1e-12) for r in got)
    encoders.COMPILED = bound


def test_runs_equal_single_runs_and_read_texts_once(texts):
    ranker = ModelRanker(texts, label_column="quality", row_id="doc_id")
    ways, models, read = ["bestlayer", "lastlayer", "layermean"], [HashEncoder("a", 3, dim=4), HashEncoder("b", 2)], []
    units = ranker.units
    ranker.units = lambda m, *a: read.append(m.name) or units(m, *a)
    together = ranker.runs(models, ways, "logme")
    assert read == ["a", "b"]
    for way, result in zip(ways, together):
        alone = ranker.run(models, "logme", way)
        assert [m for m, _ in result.ranked] == [m for m, _ in alone.ranked]
        for model in "ab":
            assert result.layerwise_scores[model] == pytest.approx(alone.layerwise_scores[model], abs=1e-9)
    own = FunctionEncoder("f", 2, lambda words, layers: [[(i, {layer: [len(w), layer + 1.0] for layer in layers}) for i, w in enumerate(text)] for text in words])
    assert len(ranker.runs([own, models[0]], ["lastlayer", "bestlayer"], "logme")[1].layerwise_scores["f"]) == 2
