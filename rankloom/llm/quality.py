r"""Quality rules: document rules, failure rates by host with an empirical beta prior, host verdicts on documents.

Only DataFrame functions.  Words are ``[^\x20\x09-\x0D]+``.  A document fails the base rules with fewer than
`min_words` words, or if more than `max_repeat_percent` percent of its words lie in 5-word windows that occur
twice or more in it.  Failures are counted by host; a host's rate is shrunk to the mean of all hosts with a
beta prior whose strength is fitted to the spread of the host rates beyond sampling noise; documents of a
host with a shrunk rate above `max_host_rate` are rejected.

Every rule works within its row, so nothing but counts by host is shuffled, after partial aggregation.

Cases: a null text has no words (and fails); a null host counts as the empty host; repeated rows count each
time; a single host, or hosts that all agree, get the strongest prior; an empty table gives an empty result.
Windows are compared by 64-bit hashes of word hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, SPACE_CLASS, cut, fresh, lookup, need, row_key, small

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5
WINDOW = 5
SPACES = " \t\n\x0b\x0c\r"
WEAKEST, STRONGEST = 1.0, 1000.0
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: str, name: str, body: str) -> str:
    """SQL for `body` with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str) -> str:
    """SQL: the number of words in windows that occur twice or more."""
    row = ", ".join(f"get(h, i + {k})" for k in range(WINDOW))
    windows = f"if(size(h) >= {WINDOW}, transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({row})), cast(array() as array<bigint>))"
    covered = f"{WINDOW}L + aggregate(transform(r, (y, j) -> if(j = 0, 0, least({WINDOW}, y - get(r, j - 1)))), 0L, (a, y) -> a + y)"
    starts = "sort_array(filter(transform(p, (x, j) -> if(coalesce(x.w = get(p, j - 1).w, false) or coalesce(x.w = get(p, j + 1).w, false), x.i, null)), y -> y is not null))"
    slow = let("sort_array(transform(ws, (w, i) -> struct(w, i)))", "p", let(starts, "r", covered))
    return let(f"transform({words}, w -> xxhash64(w))", "h", let(windows, "ws", f"if(size(array_distinct(ws)) = size(ws), 0L, {slow})"))


def with_metrics(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    need(docs, text)
    body, trimmed, words, lines = fresh(docs, "__body", "__trimmed", "__words", "__lines")
    t = F.col(body)
    full = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(trimmed, F.btrim(t, F.lit(SPACES)))
    out = out.withColumn(words, F.when(F.col(trimmed) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))).withColumn(lines, full)
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace(t, f"{SPACE_CLASS}+", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.expr(_repeat_words(f"`{words}`")),
        }
    ).drop(body, trimmed, words, lines)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, host: str, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_rejected) of rows with base_failed."""
    hosts = cut(rows.groupBy(F.coalesce(F.col(host), F.lit("")).alias("__host")).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")), 8)
    rate = F.col("host_failed") / F.col("host_docs")
    # Moments of the host rates; the noise of a rate over n documents is taken off their variance. One row.
    mean, spread, noise = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(rate * (1 - rate) / F.col("host_docs"))).first()
    mean = mean or 0.0
    between = max((spread or 0.0) - (noise or 0.0), 0.0)
    strength = min(max(mean * (1 - mean) / between - 1, WEAKEST), STRONGEST) if between else STRONGEST
    shrunk = (F.col("host_failed") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > max_host_rate)


def apply_verdicts(rows: DataFrame, hosts: DataFrame, host: str, bound: int | None = None) -> DataFrame:
    """Rows with base_failed, joined to the verdicts of their hosts: host_docs, host_failed, host_rate, host_rejected, kept."""
    named = rows.withColumn("__host", F.coalesce(F.col(host), F.lit("")))
    return lookup(named, hosts, ["__host"], bound=bound).drop("__host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE, bound: int | None = None) -> DataFrame:
    """doc_id, host, metrics and verdicts of each document; the texts are read once and not carried on."""
    need(docs, "doc_id", host, text)
    rows = cut(with_metrics(docs.select("doc_id", host, text), text).drop(text))
    return apply_verdicts(rows, host_verdicts(rows, host, max_host_rate), host, bound)


def digest(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("doc_id", *METRICS, "base_failed", "kept", "host_docs", "host_failed", "host_rejected")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE, bound: int | None = None) -> DataFrame:
    """The documents that pass, with their columns.

    The texts are judged once; the keys of the rejected rows, while within the bound of a broadcast, strike them out.
    Beyond it the rule is worked out again on the second reading, which costs less than a shuffle of the texts.
    """
    need(docs, "doc_id", host, text)
    key = list(KEY)
    keyed = docs.select(*row_key(F.col("doc_id"), F.col(text), F.col(host)), F.col(host).alias("__h"), F.col(text).alias("__t"), F.struct("*").alias("__row"))
    rows = with_metrics(keyed, "__t").drop("__t")
    judged = cut(rows.select(*key, "__h", "base_failed"))
    hosts = host_verdicts(judged, "__h", max_host_rate)
    bad = cut(apply_verdicts(judged, hosts, "__h", bound).where("not kept").select(*key).distinct(), 8)
    if small(bad, bound):
        return keyed.join(F.broadcast(bad), key, "left_anti").select("__row.*")
    return apply_verdicts(rows, hosts, "__h", bound).where("kept").select("__row.*")
