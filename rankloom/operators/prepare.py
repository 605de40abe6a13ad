"""Dataset preparation: union, inference, pair merge, sampling, cleaning and label encoding, as one lazy plan.

Only three things leave the executors: the row count (for an exact sample), the distinct labels (for a label
map; a vocabulary, not rows), and the checks that the caller asked for.
"""

from __future__ import annotations

import functools
import logging
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..functions import text as X
from ..sources.store import kept

logger = logging.getLogger("rankloom")

# The words that mark a column, in order of precedence.
TEXT_KEYWORDS = ["text", "sentence", "token", "tweet", "document", "paragraph", "description", "comment", "utterance", "question", "story", "context", "passage"]
LABEL_KEYWORDS = ["label", "ner_tag", "named_entities", "entities", "tag", "target", "category", "class", "sentiment", "score", "polarity", "rating", "stance"]

ROW_ID, SPLIT, LABEL = "row_id", "split", "label"

#: Labels up to which a label map is a literal of the plan; a longer one is a table that is joined.
MANY_LABELS = 200
#: Largest label map, in bytes of its names and indexes, that is sent to every executor.
BROADCAST_BYTES = 32 << 20


class Task(str, Enum):
    TOKEN_CLASSIFICATION = "token classification"
    TEXT_CLASSIFICATION = "text classification"
    PAIR_CLASSIFICATION = "text pair classification"
    TEXT_REGRESSION = "text regression"
    SENTENCE_SIMILARITY = "sentence similarity"

    @property
    def is_classification(self) -> bool:
        return "classification" in self.value

    @property
    def is_regression(self) -> bool:
        return not self.is_classification


def concat_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits below each other, duplicates kept, each row with the name of its split."""
    if not splits:
        raise ValueError("no splits")
    named = [df.withColumn(SPLIT, F.lit(name)) for name, df in splits.items()]
    return functools.reduce(DataFrame.unionByName, named)


def find_column(columns: list[str], role: str) -> str:
    """The first column that holds a keyword of the role; earlier keywords come first."""
    for keyword in TEXT_KEYWORDS if role == "text" else LABEL_KEYWORDS:
        for column in columns:
            if keyword in column:
                return column
    raise ValueError(f"{role} column not found in dataset: {columns}. Set {role}_column manually.")


def infer_task(schema: T.StructType, label: str, pair: str | None = None) -> Task:
    """The task by the type of the label column."""
    kind = schema[label].dataType
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.StringType)):
        task = Task.TEXT_CLASSIFICATION
    elif isinstance(kind, T.ArrayType):
        task = Task.TOKEN_CLASSIFICATION
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        task = Task.TEXT_REGRESSION
    else:
        raise ValueError(f"cannot determine the task category for labels of type {kind.simpleString()}")
    if pair in schema.names:
        task = {Task.TEXT_CLASSIFICATION: Task.PAIR_CLASSIFICATION, Task.TEXT_REGRESSION: Task.SENTENCE_SIMILARITY}.get(task, task)
    return task


def check_labels(df: DataFrame, label: str) -> None:
    """Inferring a task needs labels of one type in a table with rows: a null among them is another type."""
    rows, nulls = df.agg(F.count("*"), F.count_if(F.col(label).isNull())).first()
    if not rows:
        raise ValueError("the dataset is empty")
    if nulls:
        raise ValueError(f"inconsistent label types: {nulls} of {rows} labels are null")


def merge_pair(df: DataFrame, text: str, pair: str) -> tuple[DataFrame, str]:
    """The text column becomes `{text}_pair_{pair}`, both sides joined by a separator; a null side gives null."""
    if pair not in df.columns:
        raise ValueError(f"text pair column '{pair}' not found; columns are {df.columns}")
    name = f"{text}_pair_{pair}"
    return df.withColumn(text, X.pair(text, pair)).withColumnRenamed(text, name), name


def sample_order(row_id: Column, seed: int = 42) -> Column:
    """A pseudo-random total order of rows that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))))


#: Rows of an edge that are sorted.
EDGE_ROWS = 20_000


def downsample(df: DataFrame, ratio: float, row_id: str = ROW_ID, seed: int = 42, on: Column | None = None) -> DataFrame:
    """Exactly int(rows * ratio) rows, without replacement, the same ones for the same seed.

    The order is by a hash of row_id, or of `on`, where row_id decides among equals.  A histogram of the orders'
    first digits (4,096 counts) finds where the last row of the sample lies, further ones look into that bin until
    few rows are left to sort.  The sample itself is a filter, so rows stay where they are.
    """
    if ratio > 1:
        raise ValueError("the ratio of a sample is at most 1")
    key = F.col(row_id)
    order = sample_order(key if on is None else on, seed)
    ordered = df.select(order.alias("o"), key.alias("k"))
    start, left = "", None
    while True:
        here = ordered.where(F.col("o").startswith(start))
        bins = sorted(map(tuple, here.groupBy(F.substring("o", len(start) + 1, 3)).count().collect()))
        left = int(sum(n for _, n in bins) * ratio) if left is None else left
        if left <= 0:
            return df.limit(0)
        for digits, n in bins:
            if left <= n:
                break
            left -= n
        start += digits
        if n <= EDGE_ROWS or len(start) >= 30:
            break
    edge = ordered.where(F.col("o").startswith(start)).orderBy("o", "k").limit(left)
    last = edge.agg(F.max(F.struct("o", "k")).alias("m")).select("m.*").first()
    return df.where((order < last["o"]) | ((order == last["o"]) & (key <= last["k"])))


def clean_rows(df: DataFrame, text: str, label: str) -> DataFrame:
    """Rows with a usable text and label."""
    tokens = isinstance(df.schema[text].dataType, T.ArrayType)
    return df.where(X.is_clean_text(text, tokens) & L.is_clean_label(label, df.schema[label].dataType))


def schema_names(df: DataFrame, label: str) -> list[str] | None:
    """Label names from the column's metadata."""
    return df.schema[label].metadata.get("names")


def label_table(df: DataFrame, label: str) -> DataFrame:
    """(name, idx): distinct labels in their own order, as strings, numbered from 0."""
    c = F.explode(label) if isinstance(df.schema[label].dataType, T.ArrayType) else F.col(label)
    distinct = df.select(c.alias("v")).where("v is not null").distinct()
    listed = distinct.agg(F.array_sort(F.collect_list("v")).alias("v"))
    return listed.select(F.posexplode("v").alias("idx", "v")).select(F.col("v").cast("string").alias("name"), "idx")


def label_map(df: DataFrame, label: str) -> dict[str, int]:
    """Name to index, from metadata or else from the data. The vocabulary comes to the driver."""
    if names := schema_names(df, label):
        return {str(n): i for i, n in enumerate(names)}
    return {r["name"]: r["idx"] for r in label_table(df, label).collect()}


def encode_labels(df: DataFrame, label: str, mapping: dict[str, int], bound: int = BROADCAST_BYTES) -> DataFrame:
    """String labels, alone or in lists, become their indexes; integer labels stay as they are.

    A map of over `MANY_LABELS` labels is joined to single labels: broadcast within the bound, shuffled beyond it.
    Tags in lists are looked up in the map itself, whatever its length.
    """
    kind = df.schema[label].dataType
    if not mapping:
        return df
    if isinstance(kind, T.StringType):
        if len(mapping) > MANY_LABELS:
            return _join_labels(df, label, mapping, bound)
        return df.withColumn(label, _known(F.element_at(L.map_column(mapping), F.col(label)), F.col(label)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        lookup = L.map_column(mapping)
        return df.withColumn(label, F.transform(label, lambda x: _known(F.element_at(lookup, x), x)))
    return df


def _join_labels(df: DataFrame, label: str, mapping: dict[str, int], bound: int) -> DataFrame:
    table = df.sparkSession.createDataFrame(list(mapping.items()), "name string, idx int").select(F.struct("name", "idx").alias("entry"))
    if sum(len(name.encode()) + 64 for name in mapping) <= bound:
        table = F.broadcast(table)
    rows = df.select(F.struct("*").alias("row"))
    joined = rows.join(table, rows["row"][label] == table["entry"]["name"], "left")
    old = F.col("row").getField(label)
    return joined.select(*((_known(F.col("entry.idx"), old) if c == label else F.col("row").getField(c)).alias(c) for c in df.columns))


def _known(found: Column, value: Column) -> Column:
    """The mapped value; a value that the map lacks fails the job."""
    return F.when(found.isNull() & value.isNotNull(), F.raise_error(F.concat(F.lit("label not in the label map: "), value.cast("string"))).cast("int")).otherwise(found)


def remove_bio(df: DataFrame, label: str, mapping: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """Tags without their B-, I- prefixes, and the new label map."""
    new, ids = L.strip_tags(mapping)
    if new == mapping:
        logger.warning("Could not remove BIO encoding. Pass a label map with prefixed names.")
    lookup = L.map_column(ids)
    return df.withColumn(label, F.transform(label, lambda i: _known(F.element_at(lookup, i.cast("int")), i))), new


def flatten_labels(df: DataFrame, label: str, row_id: str = ROW_ID) -> DataFrame:
    """(row_id, word_pos, label): a row for each word."""
    return df.select(row_id, F.posexplode(label).alias("word_pos", LABEL))


@dataclass
class Prepared:
    """A prepared dataset: row_id, text (or tokens) and label columns."""

    data: DataFrame
    text: str
    label: str
    task: Task
    label_map: dict[str, int] | None

    def targets(self) -> DataFrame:
        """(row_id, word_pos, label): word_pos is null where a text has one label."""
        if self.task == Task.TOKEN_CLASSIFICATION:
            return flatten_labels(self.data, self.label)
        return self.data.select(ROW_ID, F.lit(None).cast("int").alias("word_pos"), F.col(self.label).alias(LABEL))


@dataclass
class Preparer:
    """Parameters and order of the preparation."""

    dataset_downsample: float | None = None
    text_column: str | None = None
    text_pair_column: str | None = None
    label_column: str | None = None
    label_map: dict | None = None
    task_category: Task | None = None
    cleanup_rows: bool = True
    remove_bio_encoding: bool = True
    tokenize: bool = False
    row_id: str | None = field(default=None, kw_only=True)

    def __call__(self, dataset: DataFrame | dict[str, DataFrame]) -> Prepared:
        if isinstance(dataset, dict) and all(isinstance(x, DataFrame) for x in dataset.values()):
            df = concat_splits(dataset)
        elif isinstance(dataset, DataFrame):
            df = dataset
        else:
            raise ValueError(f"a dataset is a DataFrame or a dictionary of them, not {type(dataset).__name__}")
        columns = [c for c in df.columns if c not in (SPLIT, self.row_id)]
        text = self.text_column or find_column(columns, "text")
        label = self.label_column or find_column(columns, "label")
        if self.task_category:
            task = Task(self.task_category)
        else:
            task = infer_task(df.schema, label, self.text_pair_column)
            check_labels(df, label)
        wanted = [text, label, *([self.text_pair_column] if self.text_pair_column else [])]
        if self.text_pair_column and self.text_pair_column not in df.columns:
            raise ValueError(f"text pair column '{self.text_pair_column}' not found; columns are {df.columns}")
        own_ids = not self.row_id and ROW_ID not in df.columns
        df = with_row_id(df.select(*dict.fromkeys([*wanted, *([self.row_id] if self.row_id else [ROW_ID] if ROW_ID in df.columns else [])])), self.row_id)
        digest = content(df, wanted) if own_ids else None
        size = None
        if self.dataset_downsample:
            size = df.count()
            df = downsample(df, self.dataset_downsample, on=digest)
        if self.text_pair_column:
            df, text = merge_pair(df, text, self.text_pair_column)
        df = df.select(ROW_ID, text, label)
        if self.cleanup_rows:
            df = clean_rows(df, text, label)
        mapping = self.label_map
        if task.is_classification:
            mapping = mapping or label_map(df, label)
            df = encode_labels(df, label, mapping)
            if task == Task.TOKEN_CLASSIFICATION and self.remove_bio_encoding:
                df, mapping = remove_bio(df, label, mapping)
        facts = {"task": task.value, "text": text, "label": label}
        if size is not None and self.dataset_downsample < 1:
            facts["rows"] = f"{int(size * self.dataset_downsample)} of {size}"
        if task.is_classification:
            facts["labels"] = mapping
        logger.info("prepared: %s", ", ".join(f"{k}={v}" for k, v in facts.items()))
        return Prepared(df, text, label, task, mapping)


def content(df: DataFrame, columns: list[str]) -> Column:
    """A hash of a row's columns, whatever its place in the table."""
    return F.xxhash64(*(F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in columns))


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """A `row_id`: the caller's key, or a running number.

    A key of whole numbers is taken as it is, one of another type by its hash (`TableEncoder` does the same); a key
    that is null or repeated fails, as vectors could not be told apart.  Running numbers are no function of the
    rows, so the table is written once and read back with them; no row is shuffled.
    """
    if key:
        whole = isinstance(df.schema[key].dataType, T.IntegralType)
        df = df.withColumn(ROW_ID, F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key)))
        rows, known, distinct = df.agg(F.count("*"), F.count(ROW_ID), F.count_distinct(ROW_ID)).first()
        if rows != distinct:
            raise ValueError(f"row_id column '{key}': {rows - known} of {rows} keys are null, {known - distinct} are repeated")
        return df
    if ROW_ID in df.columns:
        return df
    return kept(df.withColumn(ROW_ID, F.monotonically_increasing_id()))
