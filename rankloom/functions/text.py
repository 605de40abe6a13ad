"""Functions of texts and token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The emoji variation selector marks noisy texts.
BAD_CHARACTER = "️"
SEPARATOR = " [SEP] "


def whitespace_tokens(text: Column | str) -> Column:
    """Words and runs of punctuation; letters and digits of all scripts."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s]+)"), 1)


def pair(a: str, b: str) -> Column:
    return F.concat(F.col(a), F.lit(SEPARATOR), F.col(b))


def is_clean_text(text: str, tokens: bool) -> Column:
    """Not null, not empty, without the bad character in the text or in any token."""
    c = F.col(text)
    if tokens:
        return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(F.exists(c, lambda t: F.contains(t, F.lit(BAD_CHARACTER))), F.lit(False))
    return c.isNotNull() & (c != "") & ~F.contains(c, F.lit(BAD_CHARACTER))
