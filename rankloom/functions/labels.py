"""Functions of labels and label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORED = -1


def is_clean_label(label: str, kind: T.DataType) -> Column:
    """Not null and not -1, in a list not any -1; a null inside a list is kept."""
    c = F.col(label)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.NumericType):
            return c.isNotNull() & ~F.coalesce(F.exists(c, lambda x: x == IGNORED), F.lit(False))
        return c.isNotNull()
    if isinstance(kind, T.NumericType):
        return c.isNotNull() & (c != IGNORED)
    return c.isNotNull()


def map_column(mapping: dict) -> Column:
    """A label map (of the size of a label vocabulary) as a literal map."""
    return F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))


def strip_tags(label_map: dict[str, int]) -> tuple[dict[str, int], dict[int, int]]:
    """The map of names without prefixes, numbered as first seen, and from old to new ids."""
    bare = {name: name.rpartition("-")[2] for name in label_map}
    new = {name: i for i, name in enumerate(dict.fromkeys(bare.values()))}
    return new, {i: new[bare[name]] for name, i in label_map.items()}
