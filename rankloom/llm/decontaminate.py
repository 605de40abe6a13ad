r"""Benchmark decontamination by winnowing.

Only DataFrame functions.  Texts are lower-cased over A-Z and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
Of every window of `WINDOW` = 10 words the 5-gram with the least hash is a fingerprint.  Equal windows have
equal least hashes, so every shared span of 10 words or more shares a fingerprint, at about a third of the
positions.  Fingerprints of the documents are joined to those of the benchmark; each hit carries the words
around it (as hashes) and is extended to the windows that hold it, which are then joined to the benchmark's
windows as wholes.  An item of fewer than 10 words is one window of its own length; documents are then
searched for windows of these few lengths too.

The benchmark's side is broadcast within a checked size.  Beyond it fingerprints alone, without words, are shuffled
by their keys, and hits go back to their documents.  Only hits and one row for each document are grouped.

Cases: null texts and texts without words have no windows and are clean; equal rows each get a row; items
with equal windows all count; items without an item_id count as one, which the list of ids leaves out; an empty benchmark leaves all documents clean; other columns pass unread.
Words and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, KEY, cut, lookup, need, packed, partitions, row_key, small, unpacked
from .quality import let

WINDOW = 10
GRAM = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAMS = WINDOW - GRAM + 1
#: A fingerprint is the upper 33 bits of a 5-gram's hash above 31 bits of its position, so the least is the leftmost.
PLACE = 31
NO_LONGS = "cast(array() as array<bigint>)"


def _hash(array: str, at: str, n: int) -> str:
    return f"xxhash64({', '.join(f'get({array}, {at} + {k})' for k in range(n))})"


def _rolled(array: str, n: int, body: str, empty: str) -> str:
    """SQL: `body` for each window start i of n elements."""
    return f"if(size({array}) >= {n}, transform(sequence(0, size({array}) - {n}), i -> {body}), {empty})"


GRAM_HASHES = _rolled("h", GRAM, f"(shiftleft(shiftrightunsigned({_hash('h', 'i', GRAM)}, {PLACE}), {PLACE}) | cast(i as bigint))", NO_LONGS)
LEAST = f"least({', '.join(f'get(g, i + {k})' for k in range(GRAMS))})"


def word_hashes(text: str):
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return F.transform(F.array_remove(F.split(lowered, SEPARATORS), ""), lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(len, window, key, items) for each distinct window: `key` is its fingerprint (of a short item, its own hash)."""
    need(benchmark, "item_id", "text")
    h = benchmark.select(F.col("item_id").cast("string").alias("item"), word_hashes("text").alias("h"))
    none = "cast(array() as array<struct<len:int,window:bigint,key:bigint>>)"
    long_ = let("h", "h", let(GRAM_HASHES, "g", _rolled("h", WINDOW, f"struct({WINDOW} as len, {_hash('h', 'i', WINDOW)} as window, shiftrightunsigned({LEAST}, {PLACE}) as key)", none)))
    short = " ".join(f"when size(h) = {n} then array(struct({n} as len, {_hash('h', '0', n)} as window, {_hash('h', '0', n)} as key))" for n in range(1, WINDOW))
    each = h.select("item", F.explode(F.expr(f"case {short} else {long_} end")).alias("w")).select("item", "w.*")
    return each.groupBy("len", "window", "key").agg(F.collect_set(F.struct("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, bound: int | None = None) -> DataFrame:
    """For each document: its key (two hashes), doc_id, n_words, n_hit (words in windows of items), n_items, items (sorted ids) and spans."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    windows = cut(benchmark_windows(benchmark).select(F.col("len").cast("int").alias("len"), "window", "key", "items"), 8)
    lengths = [r["len"] for r in windows.select("len").distinct().collect() if r["len"] < WINDOW]  # nine at most
    keys = cut(windows.select("len", "key").distinct(), 8)

    none = "cast(array() as array<struct<len:int,key:bigint,p:int>>)"
    found = [f"transform(array_distinct({_rolled('h', WINDOW, LEAST, NO_LONGS)}), f -> struct({WINDOW} as len, shiftrightunsigned(f, {PLACE}) as key, cast(f & {(1 << PLACE) - 1}L as int) as p))"]
    found = [let(GRAM_HASHES, "g", found[0])]
    found += [_rolled("h", n, f"struct({n} as len, {_hash('h', 'i', n)} as key, cast(i as int) as p)", none) for n in sorted(lengths)]
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.col("doc_id").cast("long").alias("doc_id"), word_hashes("text").alias("h"))
    rows = rows.select(*KEY, "doc_id", F.size("h").cast("long").alias("n_words"), "h")
    # One more row brings each document through the joins; its key, that of the document, meets nothing and no other.
    mark = "array(struct(0 as len, __k1 as key, -1 as p))"
    ones = F.lit(1).alias("met")
    prints = F.expr(let("h", "h", f"concat({', '.join(found)})"))
    if small(keys, bound):
        each = rows.select(*KEY, "doc_id", "n_words", F.explode(F.expr(let("h", "h", f"concat({', '.join(found)}, {mark})"))).alias("f"), "h").select(*KEY, "doc_id", "n_words", "f.*", "h")
        hits = _around(each).join(F.broadcast(keys.select("*", ones)), ["len", "key"], "left").where("met = 1 or len = 0").drop("met")
    else:
        # Fingerprints alone are shuffled by their keys; what they hit goes back to the words of the document.
        thin = rows.select(*KEY, F.explode(prints).alias("f")).select(*KEY, "f.*")
        back = thin.join(keys, ["len", "key"], "left_semi").groupBy(*KEY).agg(F.collect_set(F.struct("len", "key", "p")).alias("f"))
        each = rows.join(back, list(KEY), "left").withColumn("f", F.expr(f"concat(coalesce(f, {none}), {mark})"))
        hits = _around(each.select(*KEY, "doc_id", "n_words", F.explode("f").alias("f"), "h").select(*KEY, "doc_id", "n_words", "f.*", "h"))

    starts = [f"p - {GRAMS - 1 - k}" for k in range(GRAMS)]
    grown = ", ".join(f"if({s} >= 0 and {s} <= n_words - {WINDOW}, struct({s} as s, {_hash('around', f'({s} - {FIRST})', WINDOW)} as window), null)" for s in starts)
    spread = F.explode(F.expr(f"if(len = {WINDOW}, array({grown}), array(struct(p as s, key as window)))")).alias("w")
    held = hits.select(*KEY, "doc_id", "n_words", "len", spread).where("w is not null").select(*KEY, "doc_id", "n_words", "len", "w.s", "w.window")
    met = lookup(held, windows.select("len", "window", "items", ones), ["len", "window"], "left", bound).where("met = 1 or len = 0")

    grouped = met.groupBy(*KEY, "doc_id", "n_words").agg(
        F.count(F.when(F.col("len") == 0, 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("len") > 0, F.struct("s", (F.col("s") + F.col("len")).alias("e"))))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("len") > 0, F.col("items"))))).alias("items"),
    )
    covered = "aggregate(spans, struct(0 as e, 0L as n), (a, x) -> struct(greatest(a.e, x.e) as e, a.n + greatest(0, x.e - greatest(a.e, x.s)) as n)).n"
    # Rows equal in doc_id and text were grouped; each comes back.
    again = F.explode(F.expr("sequence(1, greatest(copies, 1))")).alias("copy")
    # What is left is a small part of what was read.
    grouped = grouped.coalesce(partitions(spark, 8))
    ids = F.expr("array_sort(filter(transform(items, x -> x.item), x -> x is not null))").alias("items")
    return grouped.select(*KEY, "doc_id", "n_words", F.expr(covered).alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids, "spans", again).drop("copy")


#: The first word that is carried with a hit, and the hit's words around it, as hashes.
FIRST = f"greatest(p - {GRAMS - 1}, 0)"


def _around(prints: DataFrame) -> DataFrame:
    return prints.withColumn("around", F.expr(f"if(len = {WINDOW}, slice(h, {FIRST} + 1, {WINDOW + GRAMS - 1}), {NO_LONGS})")).drop("h")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, bound: int | None = None) -> DataFrame:
    """The documents that hold no window of the benchmark, with their columns."""
    bad = cut(contamination(docs, benchmark, bound).where("n_hit > 0").select(*KEY).distinct(), 8)
    return unpacked(lookup(packed(docs), bad, list(KEY), "left_anti", bound), docs.columns)
