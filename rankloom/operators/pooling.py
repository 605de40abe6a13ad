"""Layer selection and pooling of token vectors into words and texts.

Token tables have (model, row_id, tok_pos, word_id, layer, vec); word_id is null for special tokens.  A group
is a word or a text, so what a task gathers is bounded by the length of a text in the encoder.  `pool` takes all
steps at once, text by text as the tokens stream by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, scaled, weighted_sum
from .stats import matrix

KEYS = ("model", "row_id")
WORDS, TEXTS = ("first", "last", "mean"), ("first", "last", "mean", "weighted_mean")


def parse_layers(layer_ids: str, n_layers: int) -> list[int]:
    """Layer numbers of 'all' or of a comma list; negative ones count from the end; sorted, each once."""
    if layer_ids == "all":
        return list(range(n_layers))
    wanted = [int(x) for x in layer_ids.split(",")]
    for x in wanted:
        if not -n_layers <= x < n_layers:
            raise ValueError(f"no layer {x}: the encoder has {n_layers}")
    return sorted({x % n_layers for x in wanted})


def select_layers(df: DataFrame, layers: list[int]) -> DataFrame:
    """Rows of these layers; a table stored by layer is pruned to them."""
    return df.where(F.col("layer").isin(layers))


def _pool(df: DataFrame, by: list[str], order: str, how: str) -> DataFrame:
    grouped = df.groupBy(*by)
    if how == "first":
        return grouped.agg(F.min_by(as_double("vec"), order).alias("vec"))
    if how == "last":
        return grouped.agg(F.max_by(as_double("vec"), order).alias("vec"))
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("vec").alias("vec")))).alias("l"))
    if how == "mean":
        parts = F.transform("l", lambda r: F.struct(F.lit(1.0).alias("w"), r["vec"].alias("vec")))
        return listed.select(*by, scaled(weighted_sum(parts), 1.0 / F.size("l")).alias("vec"))
    if how == "weighted_mean":
        # Weights fall evenly from 0.9 to 0.1; one element weighs 1.
        n = F.size("l")
        weight = lambda i: F.when(n == 1, F.lit(1.0)).otherwise(0.9 - 0.8 * i / F.greatest(n - 1, F.lit(1)))
        parts = F.transform("l", lambda r, i: F.struct(weight(i).alias("w"), r["vec"].alias("vec")))
        total = F.when(n == 1, F.lit(1.0)).otherwise(0.5 * n)
        return listed.select(*by, scaled(weighted_sum(parts), 1.0 / total).alias("vec"))
    raise ValueError(f"unknown pooling '{how}'")


def layer_mean(df: DataFrame, unit: list[str]) -> DataFrame:
    """The mean vector over the layers present; the one layer left has number 0."""
    return _pool(df, unit, "layer", "mean").withColumn("layer", F.lit(0))


def pool_words(tokens: DataFrame, how: str = "mean") -> DataFrame:
    """(model, row_id, layer, word_id, vec): `first`, `last` or `mean` of a word's tokens; tokens without a word are left out."""
    if how not in WORDS:
        raise ValueError(f"unknown subword pooling '{how}'")
    return _pool(tokens.where("word_id is not null"), [*KEYS, "layer", "word_id"], "tok_pos", how)


def pool_texts(words: DataFrame, how: str = "mean") -> DataFrame:
    """(model, row_id, layer, vec): `first`, `last`, `mean` or `weighted_mean` of a text's words."""
    return _pool(words, [*KEYS, "layer"], "word_id", how)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches cut between texts: rows of a text that goes on in the next batch wait for it."""
    held, key = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        model, row_id = (batch.column(i) for i in range(2))
        last = (model[n - 1].as_py(), row_id[n - 1].as_py())
        same = pc.and_(pc.equal(model, model[n - 1]), pc.equal(row_id, row_id[n - 1])).to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~same)
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut or held and key != last:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
        key = last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _reduced(x: np.ndarray, how: str, keys: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Vectors and keys of the groups with equal keys, each pooled in its order; the groups are sorted by keys."""
    at = np.lexsort((order, *keys[::-1]))
    keys, x = [k[at] for k in keys], x[at]
    starts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    n = np.diff(np.append(starts, len(x)))
    if how == "first":
        made = x[starts]
    elif how == "last":
        made = x[starts + n - 1]
    elif how == "mean":
        made = np.add.reduceat(x, starts, axis=0) * (1.0 / n)[:, None]
    else:
        size = np.repeat(n, n)
        weight = np.where(size == 1, 1.0, 0.9 - 0.8 * (np.arange(len(x)) - np.repeat(starts, n)) / np.maximum(size - 1, 1))
        made = np.add.reduceat(x * weight[:, None], starts, axis=0) * (1.0 / np.where(n == 1, 1.0, 0.5 * n))[:, None]
    return made, [k[starts] for k in keys]


def pool(tokens: DataFrame, subword: str = "mean", sentence: str | None = None, mean_of_layers: bool = False, gathered: bool = False, layers: list[int] | None = None) -> DataFrame:
    """What `layer_mean` (if wanted), `pool_words` and `pool_texts` (with a `sentence` pooling) give one after the other.

    With `gathered`, the rows of a text (row_id is its key) follow each other in one partition, and nothing is shuffled;
    else the token table is dealt out by text once.  With `layers`, each vector has these layers one after the other, and
    there is no layer column.
    """
    if subword not in WORDS:
        raise ValueError(f"unknown subword pooling '{subword}'")
    if sentence and sentence not in TEXTS:
        raise ValueError(f"unknown pooling '{sentence}'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            model, row_id = rows.column(0).combine_chunks(), rows.column(1).to_numpy()
            pos, word = (rows.column(i).to_numpy() for i in (2, 3))
            layer = np.zeros(len(pos), np.int32) if layers else rows.column(4).to_numpy()
            x = matrix(rows.column(rows.num_columns - 1).combine_chunks())
            changed = (row_id[1:] != row_id[:-1]) | pc.not_equal(model[1:], model[:-1]).to_numpy(zero_copy_only=False)
            text = np.append(0, np.cumsum(changed))
            first = np.flatnonzero(np.append(True, changed))
            if mean_of_layers and layers:
                parts = x.reshape(len(x), len(layers), -1)
                x = parts.sum(1) * (1.0 / len(layers))
            elif mean_of_layers:
                x, (text, pos, word) = _reduced(x, "mean", [text, pos, word], layer)
                layer = np.zeros(len(x), np.int32)
            x, (text, layer, word) = _reduced(x, subword, [text, layer, word], pos)
            if sentence:
                x, (text, layer) = _reduced(x, sentence, [text, layer], word)
            if layers and not mean_of_layers:
                n = len(layers)
                x, text, word, layer = x.reshape(len(x) * n, -1), np.repeat(text, n), word if sentence else np.repeat(word, n), np.tile(layers, len(x))
            at = first[text]
            columns = [model.take(pa.array(at)), pa.array(row_id[at]), pa.array(layer, pa.int32()), *([] if sentence else [pa.array(word, pa.int32())])]
            offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=names)

    schema = f"model string, row_id long, layer int, {'' if sentence else 'word_id int, '}vec array<double>"
    names = [c.split()[0] for c in schema.split(", ")]
    whole = {"row_id": "long", "tok_pos": "int", "word_id": "int"} | ({} if layers else {"layer": "int"})
    rows = tokens.where("word_id is not null").select("model", *(F.col(c).cast(kind).alias(c) for c, kind in whole.items()), as_double("vec").alias("vec"))
    if not gathered:
        rows = rows.repartition(*KEYS).sortWithinPartitions(*KEYS)
    return rows.mapInArrow(run, schema)
