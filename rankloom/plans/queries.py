"""Queries over the test tables, one for each operator, and their SQL equivalents."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens
from ..operators import pooling, prepare, ranking
from ..operators.estimators import HScore, LogME, NearestNeighbors
from ..operators.stats import Sums, layer_stats
from ..sources.catalog import model_table, prepare_popular_models
from ..sources.encoders import HashEncoder, TableEncoder
from .ranker import ModelRanker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TAGS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC"]
PLANTED = (0.0, 0.02, 0.05, 0.1, 0.2)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Preparation


@query("SELECT doc_id, lang, lang AS split FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')")
def concat_splits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    found = sorted((r["lang"] for r in docs.select("lang").distinct().collect()), key=lambda x: (x is None, x or "")) or [None]
    united = prepare.concat_splits({x: docs.where(F.col("lang").eqNullSafe(x)) for x in found})
    return united.withColumn(prepare.SPLIT, F.col(prepare.SPLIT).cast("string"))


@query(
    """SELECT * FROM (VALUES ('benchmark', 'text', NULL, NULL), ('conversations', 'text', NULL, NULL), ('documents', 'text', NULL, NULL),
    ('embeddings', NULL, 'label', 'text classification'), ('events', NULL, NULL, NULL), ('labels', NULL, NULL, NULL), ('pages', NULL, NULL, NULL))
    t(name, text_column, label_column, task)"""
)
def infer_schema(spark, sf_dir):
    def found(columns, role):
        try:
            return prepare.find_column(columns, role)
        except ValueError:
            return None

    rows = []
    for name in ("benchmark", "conversations", "documents", "embeddings", "events", "labels", "pages"):
        df = table(spark, sf_dir, name)
        label = found(df.columns, "label")
        rows.append((name, found(df.columns, "text"), label, prepare.infer_task(df.schema, label).value if label else None))
    return spark.createDataFrame(rows, "name string, text_column string, label_column string, task string")


@query("SELECT conv_id, turn, role || ' [SEP] ' || text AS role_pair_text FROM conversations")
def merge_text_pair(spark, sf_dir):
    merged, name = prepare.merge_pair(table(spark, sf_dir, "conversations"), "role", "text")
    return merged.select("conv_id", "turn", name)


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM documents)")
def downsample_exact(spark, sf_dir):
    return prepare.downsample(table(spark, sf_dir, "documents").select("doc_id"), 0.2, "doc_id")


def dirty(spark, sf_dir) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    k = F.col("doc_id") % 97
    text = F.when(k == 0, "").when(k == 1, " ").when(k == 2, F.concat("text", F.lit("️"))).otherwise(F.col("text"))
    return joined.select("doc_id", text.alias("text"), F.when(k == 3, -1).otherwise(F.col("quality")).alias("quality"))


@query(
    """SELECT doc_id, length(t) AS n, q AS quality FROM (SELECT doc_id, CASE doc_id % 97 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN text || chr(65039) ELSE text END AS t,
    CASE WHEN doc_id % 97 = 3 THEN -1 ELSE quality END AS q FROM documents LEFT JOIN labels USING (doc_id))
    WHERE t IS NOT NULL AND t <> '' AND NOT contains(t, chr(65039)) AND q IS NOT NULL AND q <> -1"""
)
def clean_rows(spark, sf_dir):
    return prepare.clean_rows(dirty(spark, sf_dir), "text", "quality").select("doc_id", F.length("text").cast("long").alias("n"), "quality")


@query(
    """SELECT vec_id, len(tags) AS n FROM (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN [label, -1] WHEN 1 THEN [label, NULL] WHEN 2 THEN CAST([] AS INTEGER[]) WHEN 3 THEN NULL ELSE [label] END AS tags FROM embeddings)
    WHERE tags IS NOT NULL AND NOT coalesce(list_contains(tags, -1), false)"""
)
def clean_minus_one(spark, sf_dir):
    k, none = F.col("vec_id") % 5, F.lit(None).cast("int")
    tags = F.when(k == 0, F.array("label", F.lit(-1))).when(k == 1, F.array(F.col("label"), none)).when(k == 2, F.array().cast("array<int>")).when(k == 3, F.lit(None)).otherwise(F.array("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.lit("w")).alias("tokens"), tags.alias("tags"))
    return prepare.clean_rows(rows, "tokens", "tags").select("vec_id", F.size("tags").cast("long").alias("n"))


@query("SELECT event_type AS name, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT event_type FROM events)")
def label_map(spark, sf_dir):
    return prepare.label_table(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type FROM events")
def encode_labels(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return prepare.encode_labels(events, "event_type", prepare.label_map(events, "event_type"))


def tagged(spark, sf_dir) -> DataFrame:
    ids = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: ((F.col("vec_id") + i) % 9).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), ids.alias("tags"))


@query("SELECT vec_id AS row_id, CAST(p AS INTEGER) AS word_pos, CAST((((vec_id + p) % 9) + 1) // 2 AS INTEGER) AS label FROM embeddings, (VALUES (0), (1), (2)) t(p)")
def bio_flatten(spark, sf_dir):
    stripped, _ = prepare.remove_bio(tagged(spark, sf_dir), "tags", {n: i for i, n in enumerate(TAGS)})
    return prepare.flatten_labels(stripped, "tags")


@query(
    r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, t[1] AS first_token, t[-1] AS last_token
    FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+') AS t FROM documents)"""
)
def pretokenize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", whitespace_tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.get("t", F.lit(0)).alias("first_token"), F.try_element_at("t", F.lit(-1)).alias("last_token"))


# Pooling: a vector is a token, three tokens are a word, four words a text


def token_table(spark, sf_dir) -> DataFrame:
    i = F.col("vec_id")
    place = {"row_id": F.floor(i / 12), "tok_pos": i % 12, "word_id": F.floor(i / 3) % 4, "layer": F.lit(0)}
    return table(spark, sf_dir, "embeddings").select(F.lit("m").alias("model"), *(c.cast("int" if n != "row_id" else "long").alias(n) for n, c in place.items()), F.col("embedding").alias("vec"))


def by_dim(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("vec").alias("dim", "v")).select(*keys, "dim", F.round(F.col("v").cast("double"), 6).alias("value"))


TOKEN_SQL = "SELECT vec_id // 12 AS row_id, vec_id // 3 % 4 AS word_id, vec_id % 12 AS tok, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings"
WORDS = {"first": "arg_min(v, tok)", "last": "arg_max(v, tok)", "mean": "avg(v)"}
TEXTS = {
    "first": "arg_min(v, word_id)",
    "last": "arg_max(v, word_id)",
    "mean": "avg(v)",
    "weighted_mean": "sum(v * CASE WHEN n = 1 THEN 1.0 ELSE 0.9 - 0.8 * i / (n - 1) END) / sum(CASE WHEN n = 1 THEN 1.0 ELSE 0.9 - 0.8 * i / (n - 1) END)",
}


def _pool_words(how, spark, sf_dir):
    return by_dim(pooling.pool_words(token_table(spark, sf_dir), how), "row_id", "word_id")


def _pool_texts(how, spark, sf_dir):
    return by_dim(pooling.pool_texts(pooling.pool_words(token_table(spark, sf_dir), "mean"), how), "row_id")


for _how, _agg in WORDS.items():
    QUERIES[f"subword_pool_{_how}"] = functools.partial(_pool_words, _how)
    ORACLES[f"subword_pool_{_how}"] = f"SELECT row_id, CAST(word_id AS INTEGER) AS word_id, CAST(dim AS INTEGER) AS dim, round({_agg}, 6) AS value FROM ({TOKEN_SQL}) GROUP BY ALL"
for _how, _agg in TEXTS.items():
    QUERIES[f"word_pool_{_how}"] = functools.partial(_pool_texts, _how)
    ORACLES[f"word_pool_{_how}"] = f"""WITH w AS (SELECT row_id, word_id, dim, avg(v) AS v FROM ({TOKEN_SQL}) GROUP BY ALL),
        x AS (SELECT *, row_number() OVER (PARTITION BY row_id, dim ORDER BY word_id) - 1 AS i, count(*) OVER (PARTITION BY row_id, dim) AS n FROM w)
        SELECT row_id, CAST(dim AS INTEGER) AS dim, round({_agg}, 6) AS value FROM x GROUP BY row_id, dim"""


def layered(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.lit("m").alias("model"), F.col("vec_id").alias("unit_id"), F.explode(F.array(*map(F.lit, range(4)))).alias("layer"), "embedding")
    return rows.select("model", "unit_id", "layer", F.slice("embedding", F.col("layer") * 16 + 1, 16).alias("vec"))


@query("SELECT vec_id AS unit_id, CAST(l AS INTEGER) AS layer, CAST(d AS INTEGER) AS dim, round(embedding[l * 16 + d + 1]::DOUBLE, 6) AS value FROM embeddings, (VALUES (1), (3)) t(l), range(16) r(d)")
def layer_select(spark, sf_dir):
    return by_dim(pooling.select_layers(layered(spark, sf_dir), pooling.parse_layers("-1,1,-3", 4)), "unit_id", "layer")


@query("SELECT vec_id AS unit_id, CAST(d AS INTEGER) AS dim, round((embedding[d + 1]::DOUBLE + embedding[d + 17] + embedding[d + 33] + embedding[d + 49]) / 4, 6) AS value FROM embeddings, range(16) r(d)")
def layer_mean(spark, sf_dir):
    return by_dim(pooling.layer_mean(layered(spark, sf_dir), ["model", "unit_id"]), "unit_id")


# Estimators


def units(spark, sf_dir, label=None, vec="embedding") -> DataFrame:
    y = F.col("label") if label is None else label
    return table(spark, sf_dir, "embeddings").select(F.lit("m").alias("model"), F.lit(0).alias("layer"), F.col("vec_id").alias("unit_id"), F.col(vec).cast("array<double>").alias("vec"), y.cast("double").alias("label"))


def _from_stats(stats: DataFrame, rows: Callable[[Sums], list[tuple]], ddl: str) -> DataFrame:
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches):
        for pdf in batches:
            for data in pdf.stats:
                yield pd.DataFrame(rows(Sums.unpack(data)), columns=names)

    return stats.mapInPandas(run, ddl)


@query("SELECT CAST(label AS DOUBLE) AS label, count(*) AS n, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, dim")
def class_stats(spark, sf_dir):
    def rows(s):
        return [(c, int(s[f"n:{c!r}"]), d, float(v)) for c in s.classes for d, v in enumerate(s[f"s:{c!r}"] / s[f"n:{c!r}"] + s["mean"])]

    return _from_stats(layer_stats(units(spark, sf_dir)), rows, "label double, n long, dim int, mean double").withColumn("mean", F.round("mean", 6))


@query(
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
    c AS (SELECT vec_id, dim, v - avg(v) OVER (PARTITION BY dim) AS v FROM x), n AS (SELECT count(*) AS n FROM embeddings),
    g AS (SELECT a.dim AS i, b.dim AS j, sum(a.v * b.v) / any_value(n) AS c FROM c a JOIN c b USING (vec_id), n GROUP BY ALL),
    s AS (SELECT sum(c * c) AS delta_, sum(c) FILTER (i = j) AS tr FROM g), q AS (SELECT sum(t * t) AS norm4 FROM (SELECT sum(v * v) AS t FROM c GROUP BY vec_id)),
    r AS (SELECT n, tr / 64 AS m, norm4 / n AS beta_, delta_, tr FROM s, q, n)
    SELECT n, round(m, 6) AS m, round(beta_, 6) AS beta_, round(delta_, 6) AS delta_, round(greatest(0, least(1, ((beta_ - delta_) / (64 * n)) / ((delta_ - 2 * m * tr + 64 * m * m) / 64))), 6) AS alpha FROM r"""
)
def shrinkage_scalars(spark, sf_dir):
    def rows(s):
        cov, m, alpha = HScore.shrinkage(s)
        return [(int(s["n"]), round(m, 6), round(float(s["norm4"] / s["n"]), 6), round(float((cov * cov).sum()), 6), round(alpha, 6))]

    return _from_stats(layer_stats(units(spark, sf_dir)), rows, "n long, m double, beta_ double, delta_ double, alpha double")


@query(
    """WITH x AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS b, floor(l_quantity / 10) AS y FROM lineitem),
    c AS (SELECT a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, y FROM x),
    g AS (SELECT count(*)::DOUBLE AS n, avg(a * a) AS aa, avg(a * b) AS ab, avg(b * b) AS bb, avg((a * a + b * b) ** 2) AS q FROM c),
    s AS (SELECT *, (aa + bb) / 2 AS m, aa * aa + bb * bb + 2 * ab * ab AS sq FROM g),
    w AS (SELECT *, greatest(0, least(1, ((q - sq) / (2 * n)) / ((sq - 2 * m * (aa + bb) + 2 * m * m) / 2))) AS alpha FROM s),
    v AS (SELECT *, (1 - alpha) * aa + alpha * m AS saa, (1 - alpha) * ab AS sab, (1 - alpha) * bb + alpha * m AS sbb FROM w),
    k AS (SELECT y, count(*) AS nc, avg(a) AS ma, avg(b) AS mb FROM c GROUP BY y)
    SELECT round(sum(nc * (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / (saa * sbb - sab * sab) * (1 - alpha) / (n - 1)), 6) AS score FROM k, v"""
)
def hscore_2d(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(
        F.lit("m").alias("model"), F.lit(0).alias("layer"), F.lit(0).alias("unit_id"), F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("vec"), F.floor(F.col("l_quantity") / 10).cast("double").alias("label")
    )
    return HScore().score(x).select(F.round("score", 6).alias("score"))


@query()
def hscore_full(spark, sf_dir):
    return HScore().score(units(spark, sf_dir))


@query()
def logme_classification(spark, sf_dir):
    return LogME().score(units(spark, sf_dir))


@query()
def logme_regression(spark, sf_dir):
    return LogME(regression=True).score(units(spark, sf_dir))


@query(
    """WITH RECURSIVE x AS (SELECT embedding[1]::DOUBLE AS x, label::DOUBLE AS y FROM embeddings),
    t AS (SELECT count(*)::DOUBLE AS n, sum(x * x) AS s, sum(x * y) ** 2 / sum(x * x) AS z, sum(y * y) - sum(x * y) ** 2 / sum(x * x) AS r FROM x),
    it AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS pw, 0.0::DOUBLE AS re, false AS stop FROM t
      UNION ALL SELECT i + 1, a2, b2, p, e, abs(a2 / b2 - tau) / tau <= 1e-3 FROM (
        SELECT i, tau, p, e, g / (p + 1e-5) AS a2, (n - g) / (e + 1e-5) AS b2 FROM (
          SELECT i, n, a / b AS tau, s / (s + a / b) AS g, s * z / (a / b + s) ** 2 AS p, z / (1 + s / (a / b)) ** 2 + r AS e FROM it, t WHERE NOT stop AND i < 11))),
    f AS (SELECT * FROM it ORDER BY i DESC LIMIT 1)
    SELECT round((0.5 * ln(a) + n / 2 * ln(b) - 0.5 * ln(a + b * s) - b / 2 * re - a / 2 * pw - n / 2 * ln(2 * pi())) / n, 6) AS score FROM f, t"""
)
def logme_1d_regression(spark, sf_dir):
    x = units(spark, sf_dir).withColumn("vec", F.slice("vec", 1, 1))
    return LogME(regression=True).score(x).select(F.round("score", 6).alias("score"))


def _knn(spark, sf_dir, label=None, scale=False, **options):
    x = units(spark, sf_dir, label)
    if scale:
        x = x.withColumn("vec", F.transform("vec", lambda v: v * (1 + F.col("label"))))
    return NearestNeighbors(**options).score(x).select(F.round("score", 9).alias("score"))


def _knn_sql(finish: str, label: str = "label", vec: str = "embedding::DOUBLE[]", distance: str = "list_distance") -> str:
    return f"""WITH e AS (SELECT vec_id, {vec} AS v, {label} AS y FROM embeddings),
    p AS (SELECT a.vec_id, a.y, b.y AS ny, row_number() OVER (PARTITION BY a.vec_id ORDER BY {distance}(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    k AS (SELECT * FROM p WHERE r <= 3),
    vote AS (SELECT vec_id, y, ny, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, ny) AS o FROM k GROUP BY vec_id, y, ny),
    m AS (SELECT vec_id, y, avg(ny) AS p FROM k GROUP BY vec_id, y), best AS (SELECT y, ny AS p FROM vote WHERE o = 1) {finish}"""


ACCURACY = "SELECT round(avg(CAST(y = p AS INTEGER)), 9) AS score FROM best"


@query(_knn_sql(ACCURACY))
def knn_euclid(spark, sf_dir):
    return _knn(spark, sf_dir)


@query(_knn_sql(ACCURACY))
def knn_euclid_blocks(spark, sf_dir):
    return _knn(spark, sf_dir, block_rows=128, broadcast_bytes=0)


@query(_knn_sql(ACCURACY, vec="list_transform(embedding::DOUBLE[], lambda x: x * (1 + label))", distance="list_cosine_distance"))
def knn_cosine(spark, sf_dir):
    return _knn(spark, sf_dir, scale=True, distance="cosine")


@query(_knn_sql("SELECT round(2.0 * count(*) FILTER (y = 1 AND p = 1) / (2 * count(*) FILTER (y = 1 AND p = 1) + count(*) FILTER ((y = 1) <> (p = 1))), 9) AS score FROM best", label="label % 2"))
def knn_binary_f1(spark, sf_dir):
    return _knn(spark, sf_dir, F.col("label") % 2)


@query(_knn_sql("SELECT round(corr(y, p), 9) AS score FROM m"))
def knn_regression(spark, sf_dir):
    return _knn(spark, sf_dir, regression=True)


# Ranking


def score_rows(spark, sf_dir) -> DataFrame:
    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select((i % 5).alias("seq"), (i % 3).cast("int").alias("layer"), F.get("embedding", F.lit(0)).cast("double").alias("v"))
    return rows.groupBy("seq", "layer").agg(F.round(F.avg("v"), 6).alias("score")).select("seq", F.concat(F.lit("m"), "seq").alias("model"), "layer", "score")


SCORE_SQL = "SELECT vec_id % 5 AS seq, 'm' || (vec_id % 5) AS model, CAST(vec_id % 3 AS INTEGER) AS layer, round(avg(embedding[1]::DOUBLE), 6) AS score FROM embeddings GROUP BY ALL"
#: Two of the models tie, so that the earlier one must come first.
TIED_SQL = f"SELECT seq, model, CASE WHEN seq = 4 THEN max(max(score)) OVER () ELSE max(score) END AS score FROM ({SCORE_SQL}) GROUP BY seq, model"


def tied(spark, sf_dir) -> DataFrame:
    best = score_rows(spark, sf_dir).groupBy("seq", "model").agg(F.max("score").alias("score"))
    top = best.agg(F.max("score").alias("top"))
    return best.join(F.broadcast(top)).select("seq", "model", F.when(F.col("seq") == 4, F.col("top")).otherwise(F.col("score")).alias("score"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY score DESC, seq) AS INTEGER) AS rank, seq, model, score FROM ({TIED_SQL})")
def rank_models(spark, sf_dir):
    return ranking.rank(tied(spark, sf_dir))


@query(f"SELECT model, score FROM ({TIED_SQL}) ORDER BY score DESC, seq LIMIT 1")
def best_model(spark, sf_dir):
    return ranking.best_model(tied(spark, sf_dir))


@query(f"SELECT model, max(score) AS score FROM ({SCORE_SQL}) GROUP BY model")
def best_layer(spark, sf_dir):
    return ranking.reduce_layers(score_rows(spark, sf_dir), "bestlayer")


@query(f"SELECT model, arg_max(score, layer) AS score FROM ({SCORE_SQL}) GROUP BY model")
def last_layer(spark, sf_dir):
    return ranking.reduce_layers(score_rows(spark, sf_dir), "lastlayer")


@query(
    """WITH x AS (SELECT l AS layer, embedding[l * 2 + 1]::DOUBLE AS a, embedding[l * 2 + 2]::DOUBLE AS b, label AS y FROM embeddings, range(4) t(l)),
    c AS (SELECT layer, a - avg(a) OVER (PARTITION BY layer) AS a, b - avg(b) OVER (PARTITION BY layer) AS b, y FROM x),
    g AS (SELECT layer, count(*)::DOUBLE AS n, avg(a * a) AS aa, avg(a * b) AS ab, avg(b * b) AS bb, avg((a * a + b * b) ** 2) AS q FROM c GROUP BY layer),
    s AS (SELECT *, (aa + bb) / 2 AS m, aa * aa + bb * bb + 2 * ab * ab AS sq FROM g),
    w AS (SELECT *, greatest(0, least(1, ((q - sq) / (2 * n)) / ((sq - 2 * m * (aa + bb) + 2 * m * m) / 2))) AS alpha FROM s),
    v AS (SELECT *, (1 - alpha) * aa + alpha * m AS saa, (1 - alpha) * ab AS sab, (1 - alpha) * bb + alpha * m AS sbb FROM w),
    k AS (SELECT layer, y, count(*) AS nc, avg(a) AS ma, avg(b) AS mb FROM c GROUP BY layer, y)
    SELECT 'm' AS model, CAST(layer AS INTEGER) AS layer, round(sum(nc * (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / (saa * sbb - sab * sab) * (1 - alpha) / (n - 1)), 6) AS score
    FROM k JOIN v USING (layer) GROUP BY layer"""
)
def layerwise_scores(spark, sf_dir):
    """H-scores of four layers of two dimensions each."""
    rows = units(spark, sf_dir).withColumn("layer", F.explode(F.array(*map(F.lit, range(4)))))
    return HScore().score(rows.withColumn("vec", F.slice("vec", F.col("layer") * 2 + 1, 2))).select("model", "layer", F.round("score", 6).alias("score"))


@query(
    f"""WITH s AS ({SCORE_SQL}), a AS (SELECT seq, model, score FROM s WHERE layer = 0 AND seq < 3), b AS (SELECT seq, model, score FROM s WHERE layer = 1 AND seq >= 2)
    SELECT coalesce(a.seq, b.seq + (SELECT max(seq) + 1 FROM a)) AS seq, model, coalesce(b.score, a.score) AS score FROM a FULL JOIN b USING (model)"""
)
def append_results(spark, sf_dir):
    rows = score_rows(spark, sf_dir)
    first, second = rows.where("layer = 0 and seq < 3"), rows.where("layer = 1 and seq >= 2")
    return ranking.append_results(first.select("seq", "model", "score"), second.select("seq", "model", "score"))


def _listed(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) t({columns})"


@query(_listed("seq, model", list(enumerate(prepare_popular_models()))))
def popular_models(spark, sf_dir):
    return model_table(spark)


def planted_units(spark, sf_dir) -> DataFrame:
    """Five models that show the label more and more clearly in their first dimension."""
    rows = table(spark, sf_dir, "embeddings").withColumn("c", F.explode(F.array(*map(F.lit, PLANTED))))
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i == 0, x + F.col("c") * F.col("label")).otherwise(x))
    return rows.select(F.concat(F.lit("planted-"), F.col("c").cast("string")).alias("model"), F.lit(0).alias("layer"), F.col("vec_id").alias("unit_id"), vec.alias("vec"), F.col("label").cast("double").alias("label"))


def _planted(metric, spark, sf_dir):
    scores = metric().score(planted_units(spark, sf_dir)).select(F.col("model"), "score")
    return ranking.rank(scores.withColumn("seq", F.lit(0)))


def _planted_order(metric, spark, sf_dir):
    return _planted(metric, spark, sf_dir).select("rank", "model")


for _metric in (HScore, LogME, NearestNeighbors):
    QUERIES[f"rank_planted_{_metric.name}"] = functools.partial(_planted, _metric)
    QUERIES[f"planted_order_{_metric.name}"] = functools.partial(_planted_order, _metric)
    ORACLES[f"planted_order_{_metric.name}"] = _listed("rank, model", [(i, f"planted-{c}") for i, c in enumerate(sorted(PLANTED, reverse=True), 1)])


# The ranker, end to end


def _ranked(ranker, models, spark, **options) -> DataFrame:
    """(estimator, layer_aggregator, rank, model, score) of runs with each way to reduce layers."""
    rows = []
    for aggregator, result in zip(ranking.AGGREGATORS, ranker.runs(models, list(ranking.AGGREGATORS), **options)):
        rows += [(result.metric, aggregator, i, model, float(score)) for i, (model, score) in enumerate(result.ranked, 1)]
    return spark.createDataFrame(rows, "estimator string, layer_aggregator string, rank int, model string, score double")


def labelled(spark, sf_dir, bound: int = prepare.BROADCAST_BYTES) -> DataFrame:
    """Texts with their quality. Labels within the bound, at 32 bytes a row, go to the texts, which then stay where they are."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(labels) if labels.count() * 32 <= bound else labels, "doc_id")


@query()
def ranker_run_texts(spark, sf_dir):
    """Labelled documents, half of them, by two encoders of three layers."""
    ranker = ModelRanker(labelled(spark, sf_dir), dataset_downsample=0.5, text_column="text", label_column="quality")
    return _ranked(ranker, [HashEncoder("hash-8", 3, 8), HashEncoder("hash-4", 3, 4)], spark, estimator="hscore")


@query()
def ranker_run_words(spark, sf_dir):
    """Three tagged words of each vector's row; two stored encoders, one of which shows the tag."""
    rows = tagged(spark, sf_dir).withColumn("tokens", F.array(*map(F.lit, "abc")))
    ranker = ModelRanker(rows, text_column="tokens", label_column="tags", row_id="row_id", label_map={n: i for i, n in enumerate(TAGS)})
    i, word, layer = F.col("vec_id"), F.col("word_id"), F.col("layer")
    tokens = table(spark, sf_dir, "embeddings").withColumn("word_id", F.explode(F.array(*map(F.lit, range(3))))).withColumn("layer", F.explode(F.array(*map(F.lit, range(2)))))
    shown = F.floor(((i + word) % 9 + 1) / 2).cast("double")

    def stored(name: str, strength: float) -> TableEncoder:
        vec = F.transform(F.slice("embedding", layer * 8 + 1, 8).cast("array<double>"), lambda x, k: x + F.when(k == 0, strength * (layer + 1) * shown).otherwise(0.0))
        return TableEncoder(name, tokens.select(F.lit(name).alias("model"), i.alias("row_id"), word.alias("tok_pos"), "word_id", "layer", vec.alias("vec")), 2)

    return _ranked(ranker, [stored("plain", 0.0), stored("telling", 0.3)], spark, estimator="logme")
