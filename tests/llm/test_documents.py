"""Operators on documents against brute force, with awkward rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import common, components, decontaminate, quality, queries, simhash, substring

from ..oracle import SF, same
from .conftest import multiset

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


# Quality rules


def judged(text):
    text = text or ""
    w = SPACED.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


@pytest.mark.parametrize("bound", [None, 0])
def test_quality_rules(awkward, awkward_rows, nothing, bound):
    got = quality.digest(quality.quality_rules(awkward, bound=bound)).collect()
    assert multiset((r[0], *r[1:7]) for r in got) == multiset((x[0], *judged(x[1])) for x in awkward_rows)
    assert quality.quality_rules(nothing).count() == 0
    kept = quality.keep_good(awkward, bound=bound)
    assert kept.columns == awkward.columns and quality.keep_good(nothing).count() == 0
    assert multiset(tuple(r) for r in kept.collect()) == multiset(x for x in awkward_rows if not judged(x[1])[5])


def test_hosts_are_shrunk_and_joined_back(spark):
    rows = [(i, "bad" if i < 80 else " ".join(f"w{i}x{j}" for j in range(12)), "spam" if i < 80 else "fine") for i in range(200)]
    rows += [(1000 + i, " ".join(f"v{i}x{j}" for j in range(12)), "spam") for i in range(3)] + [(2000, "bad", "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert not got[1000]["kept"] and not got[1000]["base_failed"] and got[1000]["host_rejected"]
    assert got[150]["kept"] and not got[150]["host_rejected"]
    assert 0 < got[2000]["host_rate"] < 1  # one failure of one document says little
    assert quality.keep_good(docs).count() == quality.keep_good(docs, bound=0).count() == 120


# Decontamination


def hits(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = LETTERS.findall(lowered(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(None if item is None else str(item))
    out = []
    for row in rows:
        w, covered, found = LETTERS.findall(lowered(row[1])), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    covered |= set(range(i, i + n))
                    found |= windows[k]
        out.append((row[0], len(w), len(covered), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(covered)))
    return out


@pytest.mark.parametrize("bound", [common.BROADCAST_BYTES, 0])
def test_decontamination(spark, awkward, awkward_rows, nothing, bound):
    text = {x[0]: x[1] for x in awkward_rows}
    items = [(1, text[6]), (2, text[6]), (3, " ".join(text[5].split()[500:530])), (4, "One TWO"), (5, None), (6, "!!"), (7, " ".join(text[25].split()[:4])), (10, "x y z x y z x y z x y z"), (None, text[6]), (None, "b c d"), (11, text[25])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(awkward, bench, bound)).collect()
    assert multiset(map(tuple, got)) == multiset(hits(awkward_rows, items))
    assert decontaminate.contamination(nothing, bench, bound).count() == 0
    clean = decontaminate.contamination(awkward, bench.limit(0), bound)
    assert clean.count() == len(awkward_rows) and clean.where("n_hit > 0").count() == 0
    kept = decontaminate.keep_clean(awkward, bench, bound)
    dirty = [h[5] for h in hits(awkward_rows, items)]
    assert kept.columns == awkward.columns
    assert multiset(tuple(r) for r in kept.collect()) == multiset(x for x, d in zip(awkward_rows, dirty) if not d)


def test_every_shared_span_is_found(spark):
    rng = np.random.default_rng(3)
    words = [[f"w{x}" for x in rng.integers(0, 40, 200)] for _ in range(30)]
    items = [(i, " ".join(words[i][50:90])) for i in range(10)]
    rows = [(i, " ".join(w[:20] + words[i % 10][55 : 55 + 8 + i % 5] + w[20:60]), "") for i, w in enumerate(words)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert multiset(map(tuple, got)) == multiset(hits(rows, items))


# SimHash


def slow_fingerprint(text):
    w = SPACED.findall(lowered(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(zip(ids, fps))], len({find(i) for i in range(len(fps))})


@pytest.mark.parametrize("bound", [None, 0])
def test_simhash(awkward, awkward_rows, nothing, bound, monkeypatch):
    monkeypatch.setattr(components, "HUB", 2)
    want, groups = slow_components([x[0] for x in awkward_rows], [slow_fingerprint(x[1]) for x in awkward_rows])
    assert multiset(tuple(r) for r in simhash.digest(awkward, bound).collect()) == multiset(want)
    assert simhash.digest(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
    kept = simhash.keep_one(awkward, bound)
    assert kept.columns == awkward.columns and kept.count() == groups


@pytest.mark.parametrize("bound", [None, 0])
def test_components_of_hubs_and_chains(spark, bound, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    rng = np.random.default_rng(1)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 108)] + [(999, i) for i in range(200, 230)] + [(7, 7), (500, 500)] + [tuple(map(int, rng.integers(600, 640, 2))) for _ in range(60)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        up[b] = a
    got = components.components(spark.createDataFrame(edges, "u long, v long"), bound).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((x, root(x)) for x in {x for e in edges if e[0] != e[1] for x in e})


@pytest.mark.parametrize("n", [40, 400])
def test_anchors_lose_no_link(spark, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:20].tolist():
        for _ in range(n // 20):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                y ^= 1 << b
            fps.add(y)
            x = y if rng.random() < 0.3 else x
    fps = sorted(fps)
    rows = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {int(np.int64(r["fp"]).view(np.uint64)): r["component_id"] for r in simhash.fingerprint_components(rows).collect()}
    want, _ = slow_components(list(range(len(fps))), fps)
    assert [got[f] for f in fps] == [w[2] for w in want]


def test_large_group_at_an_anchor():
    rng = np.random.default_rng(0)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    edges = list(simhash._search(fps))
    assert len({x for e in edges for x in e}) == len(fps) and len(edges) == len(fps) - 1


def test_golay_code_is_perfect():
    code = simhash.Golay()
    assert len(code.errors) == 10903 and (code.counts >= 1).all() and max(int(e).bit_count() for e in code.errors[code.offsets]) == 3


# Substring dedup


def slow_removal(rows):
    words = [SPACED.findall(x[1] or "") for x in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for x, w in zip(rows, words):
        gone = {i + k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(35)}
        out.append((x[0], len(w), len(gone), hashlib.sha256(" ".join(t for i, t in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block_words", [substring.BLOCK_WORDS, 100])
def test_substrings(awkward, awkward_rows, nothing, block_words):
    got = substring.digest(substring.with_spans(awkward, block_words=block_words))
    want = slow_removal(awkward_rows)
    assert multiset(tuple(r) for r in got.collect()) == multiset(want) and any(w[2] for w in want)
    assert substring.digest(substring.with_spans(nothing)).count() == 0


@pytest.mark.parametrize("bound", [None, 0])
def test_removes_passages_and_leaves_clean_texts(awkward, awkward_rows, nothing, bound):
    out = substring.remove_repeats(awkward, bound=bound)
    assert out.columns == awkward.columns and substring.remove_repeats(nothing).count() == 0
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    for row, (_, n, gone, kept) in zip(awkward_rows, slow_removal(awkward_rows)):
        texts = [t for (d, t), _ in got.items() if d == row[0]]
        if not gone:
            assert row[1] in texts
        else:
            assert any(hashlib.sha256(" ".join(SPACED.findall(t or "")).encode()).hexdigest() == kept for t in texts)


def test_substrings_over_many_partitions(spark, awkward_rows):
    """As many ranges of hashes as a power of two, where block numbers must not fall into a few of them."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    docs = spark.createDataFrame([x[:2] for x in awkward_rows], "doc_id long, text string").repartition(16)
    spark.conf.set("spark.sql.shuffle.partitions", "256")
    try:
        got = [tuple(r) for r in substring.digest(substring.with_spans(docs)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert multiset(got) == multiset(slow_removal(awkward_rows))


def test_sizes_of_rows_are_real(spark):
    rows = spark.createDataFrame([("x" * 1000, [{"first": 1, "last": 2}] * 500, ["ab"] * 100), (None, None, None)], "t string, spans array<struct<first:int,last:int>>, l array<string>")
    total = rows.agg(F.sum(common.row_bytes(rows.schema))).first()[0]
    assert 1000 + 500 * 16 + 100 * 10 < total < 40_000
    assert common.small(rows, 40_000) and not common.small(rows, 5000)


def test_window_hashes_are_positional():
    w = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 5, 35):
        h = substring.window_hashes(w, n)
        assert len(h) == len(w) - n + 1 == len(set(h.tolist()))
        assert h[3] == substring.window_hashes(w[3 : 3 + n], n)[0]
    assert len(substring.window_hashes(w[:4], 5)) == 0


def test_lookup_beyond_the_bound(spark):
    big = spark.range(100).withColumn("k", F.col("id") % 7)
    table = spark.createDataFrame([(i, str(i)) for i in range(5)], "k long, v string")
    rows = [multiset(map(tuple, common.lookup(big, table, ["k"], "left", bound).collect())) for bound in (1 << 20, 0)]
    assert rows[0] == rows[1] and len(rows[0]) == 100
