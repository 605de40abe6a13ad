"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Training.  Of the labelled rows open to learning, at most `MAX_EXAMPLES` of each class (those with the least
hash of their doc_id; a parameter) become examples.  Terms are words cut to `STEM` letters, which gathers the forms
of a word; all terms of the examples span the vector space, none is chosen or left out.  A term that no example has
adds to no dot product and has no place in the space, so it does not lengthen a vector either.  Weights are counts
times log((1 + 1 / (share + s)) / 2) + `FLOOR`, where share is the part of all documents that have the term, counted
over the whole table, and s = `SMOOTH` keeps terms met once from ruling every vector.  Labels (without texts, bounded
as above) are sent to the texts, never shuffled with them.  Index, terms and shares are bounded by the examples' texts
whatever the corpus and are sent to the workers.

Search.  Examples that have the same heaviest common terms lie side by side, in blocks of 64.  Posting lists of
common terms (longer than a sixteenth of the examples) are kept by block, with the largest weight of each list in
each block; other lists are plain.  Documents go in small batches.  Plain lists are scored first; with them the
blocks' maxima bound the cosines of all examples of a block, and only blocks whose bound reaches the document's
k-th best score so far are visited, many documents at once.  The result is exact: an example is passed over only if
its cosine cannot be among the k best.  Cosines are rounded to twelve digits, ties are won by the smaller doc_id.

Score.  The k nearest vote with a power of their cosine as weight, against a prior weight of the base rate among
examples; a document that shares no term has the base rate of such examples.  Votes are calibrated by a
logistic curve fitted to leave-one-out votes of the examples, which also choose k.  Evidence: the nearest examples.

Cases: null and empty texts (and texts without a word of any example) share no term and get that base rate; whole
texts of any length are read; several labels of one doc_id count by their largest; of several texts under one
labelled doc_id the first in order teaches; equal rows get equal rows; where open labels lack one of the two
classes there is no index, and every score is the base rate (0 without any label); an empty table gives an empty
result.  Labels, lang, source and doc_id of the scored document are no inputs of its score.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, need

MAX_EXAMPLES = 4000
#: Numbers of neighbours to choose from.
NEIGHBOURS = (10, 20, 40)
PRIOR_WEIGHT = 0.1
#: A neighbour's vote weighs its cosine to this power.
SHARPNESS = 2
SMOOTH, FLOOR = 0.01, 0.02
BLOCK = 64
#: Posting lists longer than this part of the examples are kept by block.
COMMON = 16
#: Letters of a term.
STEM = 4
#: Documents that are worked on together, and bytes of their texts.
BATCH, BATCH_BYTES = 128, 1 << 20
#: Digits of a cosine, and more than a sum of 32 bits can be off.
DIGITS, SLACK = 12, 1e-5
STEP = 32
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same separators as spaces, in lower case.
SPACED = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))
EVIDENCE = "array<struct<doc_id:long,label:int,cosine:double>>"


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def stems(text: str | None) -> list[str]:
    """The words of a text in lower case, cut to `STEM` letters, repeats included."""
    return [w[:STEM] for w in WORD.findall(text.lower())] if text else []


class Places:
    """Numbers of the terms of many texts at once."""

    def __init__(self, terms: list[str]) -> None:
        self.at = {t: i for i, t in enumerate(terms)}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Owner and number of all known terms of the texts, repeats included; each distinct one is looked up once."""
        plain = [(t or "").lower().encode().translate(SPACED).decode() for t in texts]
        split = pc.split_pattern(pa.array(plain, pa.string()), " ")
        coded = pc.utf8_slice_codeunits(pc.list_flatten(split), 0, STEM).dictionary_encode()
        number = np.fromiter(map(self.at.get, coded.dictionary.to_pylist(), repeat(-1)), np.int64, len(coded.dictionary))
        owner, found = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy()), number[coded.indices.to_numpy()]
        return owner[found >= 0], found[found >= 0]


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded text (but for the length of one text) and few rows."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, weight = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and (weight + n > BATCH_BYTES or i - at == BATCH):
            yield batch.slice(at, i - at)
            at, weight = i, 0
        weight += n
    if at < batch.num_rows:
        yield batch.slice(at)


def frequencies(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each term, over the whole table."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, size = Places(sent.value), len(sent.value)
        n, seen = 0, np.zeros(size, np.int64)
        for batch in batches:
            n += batch.num_rows
            for part in parts(batch, 0):
                owner, term = place(part.column(0).to_pylist())
                seen += np.bincount(np.unique(owner * size + term) % size, minlength=size)
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1), pa.int64()), pa.array(np.append(seen[met], n), pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the examples, and one
    term, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    frequency = np.zeros(len(terms))
    frequency[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), frequency


def inverse(total: int, frequency: np.ndarray) -> np.ndarray:
    return np.log((1 + 1 / (frequency / max(total, 1) + SMOOTH)) / 2) + FLOOR


@dataclass
class Index:
    """Block-max inverted index over the examples, with what turns votes into scores."""

    terms: list[str]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    base: float
    lonely: float
    #: Terms and counts of each example, one after the other, and where each begins.
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    owned: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    k: int = max(NEIGHBOURS)
    curve: tuple[float, float] = (0.0, 1.0)
    _made: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    def lists(self) -> dict:
        """Plain posting lists, and blocks of the common terms; made once in each process."""
        if self._made:
            return self._made
        n = len(self.ids)
        blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))
        weight = self.counts * self.idf[self.owned]
        norms = np.sqrt(np.bincount(owner, weight * weight, n))
        weight = (weight / norms[owner]).astype(np.float32)
        length = np.bincount(self.owned, minlength=len(self.terms))
        common = length > n / COMMON
        row = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
        mine = common[self.owned]
        table = np.zeros((blocks, int(common.sum()), BLOCK), np.float32)
        table[owner[mine] // BLOCK, row[self.owned[mine]], owner[mine] % BLOCK] = weight[mine]
        owned, owner, weight = self.owned[~mine], owner[~mine], weight[~mine]
        order = np.argsort(owned, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(owned, minlength=len(self.terms))))
        self._made.update(place=Places(self.terms), row=row, table=table, maxima=np.ascontiguousarray(table.max(2).T), examples=owner[order], weights=weight[order], ends=ends)
        return self._made

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, term and unit weight of each term of each text, in order."""
        size = max(len(self.terms), 1)
        owner, term = self.lists()["place"](texts)
        key = owner * size + term
        key, n = np.unique(key, return_counts=True)
        owner, term = key // size, key % size
        return owner, term, self.unit(owner, n * self.idf[term])

    @staticmethod
    def unit(owner: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return weight / np.sqrt(np.bincount(owner, weight * weight))[owner] if len(owner) else weight

    def nearest(self, texts: list[str | None], k: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the k examples of largest positive cosine (all, if fewer) and their cosines."""
        return self.search(len(texts), *self.vectors(texts), k or self.k)

    def search(self, n: int, owner: np.ndarray, term: np.ndarray, q: np.ndarray, k: int, but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same of n vectors; example but[i] is left out for vector i."""
        made = self.lists()
        if not len(made["table"]):
            return [(np.empty(0, np.int64), np.empty(0))] * n
        out = []
        for first in range(0, n, STEP):  # sums of a few documents stay in the processor's cache
            last = min(first + STEP, n)
            mine = slice(*np.searchsorted(owner, [first, last]))
            out += self._few(last - first, owner[mine] - first, term[mine], q[mine], k, None if but is None else but[first:last])
        return out

    def _few(self, n: int, owner: np.ndarray, term: np.ndarray, q: np.ndarray, k: int, but: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        made = self.lists()
        table, row, ends = made["table"], made["row"], made["ends"]
        blocks, n_common, _ = table.shape
        width = blocks * BLOCK
        plain = row[term] < 0
        begin, size = ends[term[plain]], ends[term[plain] + 1] - ends[term[plain]]
        past = np.cumsum(size)
        at = np.repeat((begin - past + size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        to = made["examples"][at]
        to += np.repeat((owner[plain] * width).astype(np.int32), size)
        scores = np.bincount(to, made["weights"][at] * np.repeat(q[plain], size), n * width).astype(float).reshape(n, width)  # whole numbers, if no list is plain
        own = np.arange(n)
        if but is not None:
            scores[own, but] = 0
        heavy = np.zeros((n, n_common), np.float32)
        heavy[owner[~plain], row[term[~plain]]] = q[~plain]

        def kth(sums: np.ndarray) -> np.ndarray:
            return np.partition(sums, width - k, axis=1)[:, width - k] if width > k else np.zeros(n)

        alive = scores.reshape(n, blocks, BLOCK).max(2) + heavy @ made["maxima"] >= kth(scores)[:, None] - SLACK
        sums = scores.astype(np.float32)
        for b in range(blocks):
            if len(which := np.flatnonzero(alive[:, b])):
                sums[which, b * BLOCK : (b + 1) * BLOCK] += heavy[which] @ table[b]
        if but is not None:
            sums[own, but] = 0
        least = kth(sums) - SLACK
        bounds = np.searchsorted(owner[~plain], np.arange(n + 1))
        common, share = row[term[~plain]], q[~plain]
        out = []
        for i in range(n):
            # With fewer than k examples that share a term, all that do are candidates.
            best = np.flatnonzero((sums[i] >= least[i]) & (sums[i] > 0))
            mine = slice(bounds[i], bounds[i + 1])
            exact = scores[i, best] + share[mine] @ table[best // BLOCK, common[mine, None], best % BLOCK].astype(float)
            cosine = np.round(exact, DIGITS)
            order = np.lexsort((self.ids[best], -cosine))[:k]
            out.append((best[order], cosine[order]))
        return out

    def vote(self, best: np.ndarray, cosine: np.ndarray) -> float:
        weight = cosine**SHARPNESS
        return float((weight @ self.labels[best] + PRIOR_WEIGHT * self.base) / (weight.sum() + PRIOR_WEIGHT))

    def score(self, best: np.ndarray, cosine: np.ndarray) -> float:
        if not len(best):
            return self.lonely
        v = np.clip(self.vote(best, cosine), 1e-6, 1 - 1e-6)
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a + b * np.log(v / (1 - v))))))


def _curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, tuple[float, float]]:
    """A logistic curve over the votes' log odds, by Newton steps, with a ridge towards leaving them as they are; its log loss first."""
    votes = np.clip(votes, 1e-6, 1 - 1e-6)
    x = np.c_[np.ones(len(votes)), np.log(votes / (1 - votes))]
    w, ridge = np.array([0.0, 1.0]), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (p - labels)) + ridge * (w - [0, 1])
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    w[1] = max(w[1], 0.05)
    loss = weights @ np.logaddexp(0, np.where(labels > 0, -1, 1) * (x @ w))
    return float(loss), (float(w[0]), float(w[1]))


def _side_by_side(starts: np.ndarray, owned: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """An order of the examples in which those with the same three heaviest common terms are neighbours."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    length = np.bincount(owned, minlength=len(idf))
    common = length[owned] > n / COMMON
    owner, term, weight = owner[common], owned[common], (counts * idf[owned])[common]
    order = np.lexsort((term, -weight, owner))
    owner, term = owner[order], term[order]
    first = np.searchsorted(owner, np.arange(n))
    last = np.searchsorted(owner, np.arange(n), side="right")
    term = np.append(term, -1)
    top = [np.where(first + r < last, term[np.minimum(first + r, len(term) - 1)], -1) for r in range(3)]
    return np.lexsort(top[::-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_EXAMPLES) -> Index:
    """The index, learned from labelled documents that are not held out."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", label)
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("doc")).agg((F.max(F.col(label)) > 0).cast("int").alias("label"))
    known = cut(known, 8)
    sizes = dict(map(tuple, known.groupBy("label").count().collect()))
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    base = (n_pos + 0.5) / (n_pos + n_neg + 1) if n_pos + n_neg else 0.0
    index = Index([], np.empty(0), np.empty(0, np.int64), np.empty(0), base, base)
    if not (n_pos and n_neg):
        return index
    # Labels of bounded number meet the texts where these are.
    examples = F.broadcast(cut(_least(known, sizes, most), 8))
    ids, y, sizes, names, counts = _pick(docs.select("doc_id", "text").join(examples, F.col("doc_id") == F.col("doc")).select("doc_id", "label", "text"))
    vocabulary = pc.unique(names)
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary))
    if not len(vocabulary):
        return index
    owned = pc.index_in(names, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int32)
    del names
    index.terms = vocabulary.to_pylist()
    index.idf = inverse(*frequencies(docs, index.terms))
    starts = np.append(0, np.cumsum(sizes))
    order = _side_by_side(starts, owned, counts, index.idf)
    size = sizes[order]
    at = np.arange(size.sum()) + np.repeat(starts[order] - np.cumsum(size) + size, size)
    index.ids, index.labels, y, sizes = ids[order], y[order].astype(float), y[order], size
    index.starts, index.owned, index.counts = np.append(0, np.cumsum(size)), owned[at], counts[at].astype(np.int32)
    # Each class weighs as in all open labelled rows.
    share = np.bincount(y, minlength=2)
    heft = np.where(y == 1, n_pos / max(share[1], 1), n_neg / max(share[0], 1))
    lone = sizes == 0
    index.lonely = float((heft[lone] @ index.labels[lone] + base) / (heft[lone].sum() + 1))
    found = []
    for i in range(0, len(ids), BATCH):
        j = min(i + BATCH, len(ids))
        mine = slice(index.starts[i], index.starts[j])
        owner = np.repeat(np.arange(j - i), sizes[i:j])
        sort = np.lexsort((index.owned[mine], owner))
        owner, term = owner[sort], index.owned[mine][sort].astype(np.int64)
        found += index.search(j - i, owner, term, index.unit(owner, index.counts[mine][sort] * index.idf[term]), max(NEIGHBOURS), but=np.arange(i, j))
    some = np.array([len(b) > 0 for b, _ in found])
    if some.any():
        y, heft, found = index.labels[some], heft[some], [f for f in found if len(f[0])]
        tried = []
        for k in NEIGHBOURS:
            votes = np.array([index.vote(b[:k], c[:k]) for b, c in found])
            tried.append((*_curve(votes, y, heft), k))
        _, index.curve, index.k = min(tried)
    return index


def _least(known: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """At most `most` labelled rows of each class, by least hash of doc_id.

    A bound on the hash that keeps about twice as many comes first, so that no task gathers all rows.
    """
    spread = 1 << 30
    place = F.pmod(F.xxhash64("doc"), F.lit(spread))
    parts = []
    for y, n in sorted(sizes.items()):
        mine = known.where((F.col("label") == y) & (place < int(spread * min(1.0, 2 * most / n))))
        parts.append(mine if n <= most else mine.orderBy(place, "doc").limit(most))
    return functools.reduce(DataFrame.unionAll, parts) if parts else known.limit(0)


def _pick(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """doc_id, label and number of terms of the examples, and these terms with their counts. Equal texts teach once."""
    first = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", F.xxhash64("text").alias("copy"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [Counter(stems(x.as_py())) for x in batch.column(3)]
            names, counts = pa.array([list(g) for g in got], pa.list_(pa.string())), pa.array([list(g.values()) for g in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], names, counts], names=["doc_id", "label", "copy", "terms", "counts"])

    made = first.mapInArrow(lean(run), "doc_id long, label int, copy long, terms array<string>, counts array<int>").toArrow()
    order = np.argsort(made["doc_id"].to_numpy(), kind="stable")
    _, once = np.unique(made["copy"].to_numpy()[order], return_index=True)
    made = made.take(pa.array(order[np.sort(once)])).combine_chunks()
    sizes = pc.list_value_length(made["terms"]).to_numpy().astype(np.int64)
    flat = [pc.list_flatten(made[c]).combine_chunks() for c in ("terms", "counts")]
    return made["doc_id"].to_numpy(), made["label"].to_numpy(), sizes, flat[0], flat[1].to_numpy(zero_copy_only=False)


def score(docs: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (the nearest examples with their cosines) of each document."""
    need(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in parts(batch, 2):
                found = known.nearest(part.column(2).to_pylist())
                scores = [known.score(best, cosine) for best, cosine in found]
                shown = [[{"doc_id": int(known.ids[b]), "label": int(known.labels[b]), "cosine": float(c)} for b, c in zip(best[:evidence], cosine)] for best, cosine in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array(shown, kind)], names=["doc_id", "held_out", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(lean(run), f"doc_id long, held_out boolean, score double, evidence {EVIDENCE}")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def digest(scored: DataFrame) -> DataFrame:
    return scored.drop("evidence")
