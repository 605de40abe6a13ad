"""Encoders: where token vectors come from.

An encoder turns prepared texts into a token table (model, row_id, tok_pos, word_id, layer, vec).  Language
models themselves are not part of this library: `TableEncoder` reads vectors that are stored,
`FunctionEncoder` runs a batch function of the user on executors (a loaded model stays in the worker), and
`HashEncoder` makes deterministic vectors from the tokens, for tests and dry runs.
"""

from __future__ import annotations

import importlib.util
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import whitespace_tokens

TOKENS = "model string, row_id long, tok_pos int, word_id int, layer int, vec array<double>"
#: Numbers up to which the hash vectors of a token are written out in the plan, which compiles them.
COMPILED = 128


class Encoder(ABC):
    """A named model with a number of layers.

    `pre_tokenizer`, a function of a text column that gives an array of words, takes the place of the default one.
    `gathered` says that the tokens of a text follow each other in one partition, so that pooling shuffles nothing;
    `wide`, that `wide_tokens` gives all layers of a token as one row.
    """

    batch_size: int = 32
    gathered: bool = False
    wide: bool = False
    pre_tokenizer: Callable[[Column], Column] | None = None

    def __init__(self, name: str, n_layers: int) -> None:
        self.name, self.n_layers = name, n_layers

    @abstractmethod
    def tokens(self, texts: DataFrame, layers: list[int]) -> DataFrame:
        """The token table of (row_id, words array<string>) for some layers."""

    def wide_tokens(self, texts: DataFrame, layers: list[int]) -> DataFrame:
        """The same without the layer: vec has these layers, one after the other."""
        raise NotImplementedError

    def encode(self, data: DataFrame, text: str, layers: list[int], row_id: str = "row_id", wide: bool = False) -> DataFrame:
        """The token table of texts or token lists."""
        words = F.col(text) if isinstance(data.schema[text].dataType, T.ArrayType) else (self.pre_tokenizer or whitespace_tokens)(F.col(text))
        return (self.wide_tokens if wide else self.tokens)(data.select(F.col(row_id).alias("row_id"), words.alias("words")), layers)


class HashEncoder(Encoder):
    """Vectors from hashes of subwords: pieces of `piece` letters; equal pieces have equal vectors."""

    gathered = wide = True

    def __init__(self, name: str = "hash", n_layers: int = 2, dim: int = 16, piece: int = 4, max_length: int = 512) -> None:
        super().__init__(name, n_layers)
        self.dim, self.piece, self.max_length = dim, piece, max_length

    def pieces(self, texts: DataFrame) -> DataFrame:
        size = F.lit(self.piece)
        cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(w), F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring(w, i * size + 1, size))
        # Each word has a piece at least, so words beyond as many have none within the length.
        words = F.slice("words", 1, self.max_length)
        pieces = F.flatten(F.transform(words, lambda w, i: F.transform(cut(w), lambda p: F.struct(p.alias("piece"), i.alias("word_id")))))
        return texts.select("row_id", F.posexplode(F.slice(pieces, 1, self.max_length)).alias("tok_pos", "t"))

    def unit(self, layer: Column, i: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.name), "t.piece", layer, i), F.lit(20011)) / 10005.0 - 1.0

    def table(self, rows: DataFrame, layer: list[Column], vec: Column) -> DataFrame:
        return rows.select(F.lit(self.name).alias("model"), "row_id", "tok_pos", F.col("t.word_id").cast("int").alias("word_id"), *layer, vec.alias("vec"))

    def tokens(self, texts: DataFrame, layers: list[int]) -> DataFrame:
        rows = self.pieces(texts).withColumn("layer", F.explode(F.array(*map(F.lit, layers))))
        vec = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: self.unit(F.col("layer"), i))
        return self.table(rows, [F.col("layer")], vec)

    def wide_tokens(self, texts: DataFrame, layers: list[int]) -> DataFrame:
        if len(layers) * self.dim <= COMPILED:
            vec = F.array(*(self.unit(F.lit(layer), F.lit(i)) for layer in layers for i in range(self.dim)))
        else:
            # A function over numbers is interpreted, but keeps the plan short.
            vec = F.flatten(F.transform(F.array(*map(F.lit, layers)), lambda layer: F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: self.unit(layer, i))))
        return self.table(self.pieces(texts), [], vec)


class TableEncoder(Encoder):
    """Vectors of a stored table with the columns of a token table; only the wanted layers are read."""

    def __init__(self, name: str, table: DataFrame, n_layers: int) -> None:
        super().__init__(name, n_layers)
        whole = isinstance(table.schema["row_id"].dataType, T.IntegralType)
        self.table = table if whole else table.withColumn("row_id", F.xxhash64("row_id"))

    def tokens(self, texts: DataFrame, layers: list[int]) -> DataFrame:
        mine = self.table.where((F.col("model") == self.name) & F.col("layer").isin(layers))
        return mine.join(texts.select("row_id"), "row_id", "left_semi").select(*(c.split()[0] for c in TOKENS.split(", ")))


_loaded: dict[str, object] = {}


class FunctionEncoder(Encoder):
    """A user's function of a batch, run on executors.

    It takes (lists of words, layers) and gives, for each text, (word number or None, {layer: vector}) of each
    token.  With `load`, a function without arguments, the function gets what that returns as its first
    argument; each Python worker loads it once.  At most `batch_size` texts go to a call, and their vectors go on as
    one Arrow batch.
    """

    gathered = True

    def __init__(self, name: str, n_layers: int, function: Callable, load: Callable | None = None, batch_size: int = 32) -> None:
        super().__init__(name, n_layers)
        self.function, self.load, self.batch_size = function, load, batch_size

    def tokens(self, texts: DataFrame, layers: list[int]) -> DataFrame:
        name, function, load, size = self.name, self.function, self.load, max(1, self.batch_size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if load is not None and name not in _loaded:
                _loaded[name] = load()
            first = () if load is None else (_loaded[name],)
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    made = function(*first, part.column(1).to_pylist(), layers)
                    rows, vectors = [], []
                    for i, tokens in zip(part.column(0).to_pylist(), made):
                        for pos, (word, by_layer) in enumerate(tokens):
                            rows += [(i, pos, word, layer) for layer in by_layer]
                            vectors += by_layer.values()
                    if rows:
                        yield _token_batch(name, rows, vectors)

        return texts.select("row_id", "words").mapInArrow(run, TOKENS)


def _token_batch(name: str, rows: list[tuple], vectors: list) -> pa.RecordBatch:
    flat = [np.asarray(v, np.float64).ravel() for v in vectors]
    offsets = np.append(0, np.cumsum([len(v) for v in flat])).astype(np.int32)
    row_id, pos, word, layer = zip(*rows)
    columns = [pa.array([name] * len(rows)), pa.array(row_id, pa.int64()), pa.array(pos, pa.int32()), pa.array(word, pa.int32()), pa.array(layer, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TOKENS.split(", ")])


class TransformerEncoder(FunctionEncoder):
    """A public language model by name, where the packages `transformers` and `torch` are installed on all nodes.

    Model and tokenizer (the model's own, or `tokenizer` by name) load once a worker; texts are cut at `max_length`
    subwords.  Whether the packages are there is asked before any job runs.
    """

    def __init__(self, name: str, n_layers: int, tokenizer: str | None = None, max_length: int = 512, batch_size: int = 32) -> None:
        missing = [x for x in ("transformers", "torch") if importlib.util.find_spec(x) is None]
        if missing:
            raise ImportError(f"{name} needs the packages {missing}; give vectors by TableEncoder or a function by FunctionEncoder")

        def load():
            import torch
            from transformers import AutoModel, AutoTokenizer

            return AutoTokenizer.from_pretrained(tokenizer or name, use_fast=True, add_prefix_space=True), AutoModel.from_pretrained(name, output_hidden_states=True).eval(), torch

        def encode(loaded, words, layers):
            subwords, model, torch = loaded
            fed = subwords(words, is_split_into_words=True, truncation=True, max_length=max_length, padding=True, return_tensors="pt")
            with torch.no_grad():
                hidden = model(**fed).hidden_states[-n_layers:]
            for i in range(len(words)):
                places = [k for k, real in enumerate(fed["attention_mask"][i].tolist()) if real]
                yield [(fed.word_ids(i)[k], {layer: hidden[layer][i, k].numpy() for layer in layers}) for k in places]

        super().__init__(name, n_layers, encode, load, batch_size)


_registry: dict[str, Callable[[], Encoder]] = {}


def register_encoder(name: str, make: Callable[[], Encoder]) -> None:
    """Let a model be named by a string."""
    _registry[name] = make


def resolve(models: list[Encoder | str]) -> list[Encoder]:
    """Encoders of encoders and registered names, each name once, in order. Unknown names fail before any job runs."""
    unknown = [m for m in models if isinstance(m, str) and m not in _registry]
    if unknown:
        raise ValueError(f"no encoder is registered for {unknown}; known are {sorted(_registry)}")
    made = [_registry[m]() if isinstance(m, str) else m for m in models]
    return list({m.name: m for m in made}.values())
