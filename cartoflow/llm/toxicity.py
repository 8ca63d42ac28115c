r"""Toxic spans by a linear-chain conditional random field.

1. Evidence.  In a bounded sample of labelled documents, words and word beginnings of 4, 5, 6 and 8 bytes get the
   log-odds of being in toxic ones (the lower end of an interval).  A word with a clear one is a candidate.  Candidates get
   a second evidence from the words beside them: how the pair with the word before, and with the word after, parts toxic
   from clean documents among those that have the candidate; it may speak for or against.
2. Tokens' labels.  All tokens of clean documents are clean.  In toxic ones, candidates start as toxic and the rest as
   clean; after a fit, those stay toxic whose marginal is a half or more, and the likeliest one of the document (some token
   must be), and the field is fitted again.
3. Field.  All words of a text are one chain with two states.  Potentials: for the toxic state, by the bucket of the
   word's evidence (or that it has none) and by the sign of both neighbours' evidence; for each pair of states of
   neighbours.  Words without evidence in a row are one step, a power of their 2 x 2 matrix in closed form, so inference
   is exact over all words and costs what the candidates cost.  Weights maximise the labels' conditional likelihood.
4. Documents.  Marginals give the expected number of toxic words and the largest marginal; a logistic function of both
   and of the number of words, fitted to the same sample, is the score.  Words in a row with a marginal of a half or more
   are the spans (a row of words without evidence between two of them too, if all its marginals are).

Bound: SAMPLE documents a class are the fit (the least hashes of their ids); all pieces of evidence that they give are
kept.  Scoring reads every whole text.

Cases.  Null or empty text: no candidates, the score of a text without any.  A document with several labels is toxic if
one says so; null labels count for nothing.  No labelled rows: every score is 0.  Labels of one class only: every score
is the share of toxic labels, (toxic + 1/2) / (all + 1).  A doc_id with several texts is fitted by the least of them.
Repeated rows: a row each.  Empty table: empty result.  Null doc_id: scored, held_out null.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import ALNUM, Block, blocks, hashed_sample, mixed, only, small_batches, span_hashes, spool

#: Labelled documents a class that the fit looks at, at most.
SAMPLE = 8_000
#: Least log-odds and least number of toxic documents of evidence.
CLEAR, SUPPORT = 1.5, 3
BEGINNINGS = (4, 5, 6, 8)
BUCKETS = np.array([2.0, 2.5, 3.5, 4.5])
#: Longest row of words without evidence that may be within a span.
BRIDGE = 64
_FILTER_BITS = 22
_SALT = np.uint64(0xD6E8FEB86659FD93)


def held_out_of(doc_id, folds: int = 5):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0


def _evidence(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of the block, and for words and beginnings which words have one and its hash."""
    data = block.lower()
    starts, ends, owners = block.words(data, ALNUM)
    kinds = [(np.arange(len(starts)), span_hashes(data, starts, ends))]
    for k in BEGINNINGS:
        has = np.flatnonzero(ends - starts >= k)
        kinds.append((has, mixed(span_hashes(data, starts[has], starts[has] + k) + np.uint64(k))))
    return starts, ends, owners, kinds


class Table:
    """Values by hash, 0 for others, with a bit table in front of the binary search."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the table, and their values."""
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(maybe):
            return maybe, np.zeros(0)
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], self.values[at[hit]]


class Candidates(NamedTuple):
    """In order: text, word number in the text, start, end, evidence, hashes of the pairs with both neighbours (0 where
    there is none); and words of each text."""

    owner: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    evidence: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray


def candidates(lexicon: Table, block: Block) -> Candidates:
    starts, ends, owners, kinds = _evidence(block)
    best = np.zeros(len(starts))
    for which, hashes in kinds:
        at, values = lexicon.of(hashes)
        np.maximum.at(best, which[at], values)
    counts = block.per_text(owners)
    first = np.cumsum(counts) - counts
    at = np.flatnonzero(best > 0)
    words, owner = kinds[0][1], owners[at]
    place = at - first[owner]
    pairs = np.zeros((len(at), 2), np.uint64)
    left, right = np.flatnonzero(place > 0), np.flatnonzero(place + 1 < counts[owner])
    pairs[left, 0] = mixed(words[at[left] - 1] * _SALT + words[at[left]])
    pairs[right, 1] = mixed(words[at[right]] * _SALT + words[at[right] + 1] + np.uint64(1))
    return Candidates(owner, place, starts[at] - block.starts[owner], ends[at] - block.starts[owner], best[at], pairs, counts)


#: Weights: evidence buckets, neighbours against and for (before, after), no evidence; pairs clean-toxic, toxic-clean,
#: toxic-toxic (clean-clean is 0).
UNARY = len(BUCKETS) + 1
WEIGHTS = UNARY + 4 + 1 + 3


class Field:
    """The chain over all words, for one set of weights, or for several at once (the first axis)."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros(WEIGHTS) if weights is None else np.asarray(weights, float)

    @staticmethod
    def codes(evidence: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Indicators of a candidate's features, by weight."""
        x = np.zeros((len(evidence), UNARY + 4))
        x[np.arange(len(evidence)), np.searchsorted(BUCKETS, evidence, "right")] = 1
        for k, value in enumerate((left, right)):
            x[:, UNARY + 2 * k], x[:, UNARY + 2 * k + 1] = value < 0, value > 0
        return x

    @staticmethod
    def shape(owner: np.ndarray, place: np.ndarray, counts: np.ndarray):
        """Per candidate whether it is the first of its text, and the words since the one before; per text the words after
        its last; and, longest chains first, the texts with candidates, their first candidate and their candidates."""
        n = len(owner)
        first = np.ones(n, bool)
        first[1:] = owner[1:] != owner[:-1]
        gap = place.copy()
        gap[~first] -= place[np.flatnonzero(~first) - 1] + 1
        size = np.bincount(owner, minlength=len(counts))
        last = np.cumsum(size) - 1
        tail = counts.copy()
        tail[size > 0] -= place[last[size > 0]] + 1
        texts = np.flatnonzero(size)
        texts = texts[np.argsort(-size[texts], kind="stable")]
        return first, gap, tail, texts, (last - size + 1)[texts], size[texts]

    def _steps(self):
        """Matrices of a pair of neighbours, of a word without evidence, and what its powers are made of."""
        w = np.atleast_2d(self.weights)
        pair = np.exp(np.stack([np.zeros(len(w)), *w[:, -3:].T], 1)).reshape(-1, 2, 2)
        none = np.exp(w[:, UNARY + 4])
        step = pair * np.stack([np.ones(len(w)), none], 1)[:, None, :]
        half, det = (step[:, 0, 0] + step[:, 1, 1]) / 2, step[:, 0, 0] * step[:, 1, 1] - step[:, 0, 1] * step[:, 1, 0]
        root = np.sqrt(np.maximum(half**2 - det, 1e-300))
        big, small, one = half + root, half - root, np.eye(2)
        split = lambda x: x[:, None, None]
        return pair, none, (step - split(small) * one) / split(2 * root), (split(big) * one - step) / split(2 * root), small / big, np.log(big)

    def _power(self, steps, n: np.ndarray) -> np.ndarray:
        """Powers of the step without evidence, each by its largest eigenvalue: (set, n, 2, 2)."""
        _, _, one, two, ratio, _ = steps
        return one[:, None] + (np.sign(ratio)[:, None] ** (n % 2) * np.abs(ratio)[:, None] ** n)[:, :, None, None] * two[:, None]

    def forward(self, codes: np.ndarray, shape, counts: np.ndarray):
        """log Z of each text; forward messages, the matrices between candidates, and potentials of toxic."""
        first, gap, tail, texts, heads, sizes = shape
        steps = self._steps()
        pair, none, *_, growth = steps
        sets = len(pair)
        toxic = np.exp(np.clip(np.atleast_2d(self.weights)[:, : UNARY + 4] @ codes.T, -30, 30))
        gaps, which = np.unique(np.maximum(gap - first, 0), return_inverse=True)  # few different ones
        between = np.einsum("smij,sjk->smik", self._power(steps, gaps), pair)[:, which]
        begin = np.stack([np.ones(sets), none], 1)
        z = np.zeros((sets, len(counts)))
        message = np.zeros((sets, len(gap), 2))
        longest = int(sizes[0]) if len(sizes) else 0
        for t in range(longest):
            alive = int(np.searchsorted(-sizes, -t, "left"))
            i, of = heads[:alive] + t, texts[:alive]
            if t:
                before, m = message[:, i - 1], between[:, i]
                before = before[:, :, :1] * m[:, :, 0] + before[:, :, 1:] * m[:, :, 1]
            else:
                before = np.einsum("si,smij->smj", begin, between[:, i])
                before[:, gap[i] == 0] = 1  # nothing comes before
            before[:, :, 1] *= toxic[:, i]
            total = before.sum(2)
            message[:, i] = before / total[:, :, None]
            steps_here = np.maximum(gap[i] - (t == 0), 0)
            z[:, of] += np.log(total) + growth[:, None] * steps_here
        tails, which = np.unique(tail, return_inverse=True)
        ends = self._power(steps, tails).sum(3)[:, which]  # (set, text, state)
        if len(texts):
            z[:, texts] += np.log(np.einsum("smi,smi->sm", message[:, heads + sizes - 1], ends[:, texts])) + growth[:, None] * tail[texts]
        bare = np.flatnonzero((np.bincount(texts, minlength=len(counts)) == 0) & (counts > 0))
        z[:, bare] += np.log(np.einsum("si,smij->sm", begin, self._power(steps, counts[bare] - 1))) + growth[:, None] * (counts[bare] - 1)
        return z, message, between, toxic, ends

    def score(self, codes: np.ndarray, labels: np.ndarray, shape) -> np.ndarray:
        """What the weights say of labels, less what is the same for all: of candidates as labelled and other words clean."""
        first, gap, tail, texts, heads, sizes = shape
        w = np.atleast_2d(self.weights)
        near = ~first & (gap == 0)
        before = np.concatenate([[0.0], labels[:-1]]) if len(labels) else labels
        last = labels[heads + sizes - 1] * (tail[texts] > 0)
        enter = (labels * ((gap > 0) | (near & (before == 0)))).sum()
        leave = (before * (~first & ((gap > 0) | (near & (labels == 0))))).sum() + last.sum()
        stay = (before * labels * near).sum()
        return w[:, : UNARY + 4] @ (codes.T @ labels) + w[:, -3:] @ np.array([enter, leave, stay])

    def fit(self, codes: np.ndarray, labels: np.ndarray, shape, counts: np.ndarray, steps: int = 25, penalty: float = 0.5) -> "Field":
        """BFGS on the conditional log-likelihood less a square penalty; slopes by differences, all at once."""
        n, h = max(1.0, len(labels)), 1e-5

        def value(theta: np.ndarray) -> np.ndarray:
            sets = Field(theta)
            return (sets.score(codes, labels, shape) - sets.forward(codes, shape, counts)[0].sum(1)) / n - penalty / 2 / n * (theta**2).sum(1)

        def slope(theta: np.ndarray) -> tuple[float, np.ndarray]:
            found = value(np.concatenate([theta[None], theta + h * np.eye(WEIGHTS)]))
            return found[0], (found[1:] - found[0]) / h

        theta, inverse = self.weights.copy(), np.eye(WEIGHTS)
        now, g = slope(theta)
        for _ in range(steps):
            step = inverse @ g
            step *= min(1.0, 4 / max(1e-12, np.abs(step).max()))
            sizes = 0.5 ** np.arange(6)
            tried = value(theta + sizes[:, None] * step)
            best = int(tried.argmax())
            if tried[best] <= now + 1e-9:
                break
            step = sizes[best] * step
            theta = theta + step
            now, after = slope(theta)
            y = g - after  # of what is minimised
            g = after
            if (step @ y) > 1e-12:
                a = np.eye(WEIGHTS) - np.outer(step, y) / (step @ y)
                inverse = a @ inverse @ a.T + np.outer(step, step) / (step @ y)
        self.weights = theta
        return self

    def marginals(self, codes: np.ndarray, shape, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each candidate, of being toxic; and of each row of words before a candidate, the least one within it (0 for
        rows over BRIDGE words, or of those that begin a text)."""
        first, gap, tail, texts, heads, sizes = shape
        _, message, between, toxic, ends = self.forward(codes, shape, counts)
        message, between, toxic = message[0], between[0], toxic[0]
        back = np.ones((len(gap), 2))
        back[heads + sizes - 1] = ends[0, texts]
        longest = int(sizes[0]) if len(sizes) else 0
        for t in range(longest - 2, -1, -1):
            alive = int(np.searchsorted(-sizes, -(t + 1), "left"))
            i = heads[:alive] + t
            after = back[i + 1] * np.stack([np.ones(len(i)), toxic[i + 1]], 1)
            back[i] = np.einsum("mij,mj->mi", between[i + 1], after)
            back[i] /= back[i].sum(1, keepdims=True)
        both = message * back
        p = both[:, 1] / both.sum(1)
        inside = np.where(~first & (gap == 0), 1.0, 0.0)
        rows = np.flatnonzero(~first & (gap > 0) & (gap <= BRIDGE))
        rows = rows[(p[rows] >= 0.5) & (p[rows - 1] >= 0.5)]
        if len(rows):
            steps = self._steps()
            which = np.repeat(rows, gap[rows])
            k = np.arange(len(which)) - np.repeat(np.cumsum(gap[rows]) - gap[rows], gap[rows]) + 1
            here = np.einsum("mi,mij->mj", message[which - 1], self._power(steps, k)[0])
            after = back[which] * np.stack([np.ones(len(which)), toxic[which]], 1)
            rest = np.einsum("mij,jk,mk->mi", self._power(steps, gap[which] - k)[0], steps[0][0], after)
            both = here * rest
            inside[rows] = np.minimum.reduceat(both[:, 1] / both.sum(1), np.cumsum(gap[rows]) - gap[rows])
        return p, inside


def _document_features(n: int, owner: np.ndarray, toxic: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total, most = np.bincount(owner, toxic, n), np.zeros(n)
    np.maximum.at(most, owner, toxic)
    return np.stack([np.ones(n), most, np.log1p(total), total / np.maximum(1, counts)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps; the penalty keeps separable data finite."""
    theta = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        theta = theta + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ theta)
    return theta


class Model(NamedTuple):
    lexicon: Table
    context: Table
    field: Field
    theta: np.ndarray | None
    flat: float

    def codes(self, found: Candidates) -> np.ndarray:
        beside = np.zeros((2, len(found.owner)))
        for k in range(2):
            at, values = self.context.of(found.pairs[:, k])
            beside[k, at] = values
        return Field.codes(found.evidence, *beside)

    def score(self, block: Block) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Score of each text, and its spans: byte offsets and the largest marginal."""
        spans: list[list[tuple[int, int, float]]] = [[] for _ in range(block.n)]
        if self.theta is None:
            return np.full(block.n, self.flat), spans
        found = candidates(self.lexicon, block)
        p, inside = self.field.marginals(self.codes(found), Field.shape(found.owner, found.place, found.counts), found.counts)
        x = _document_features(block.n, found.owner, p, found.counts)
        last = -2
        for i in np.flatnonzero(p >= 0.5).tolist():
            doc, a, b = int(found.owner[i]), int(found.start[i]), int(found.end[i])
            if last == i - 1 and inside[i] >= 0.5:
                spans[doc][-1] = (spans[doc][-1][0], b, max(float(p[i]), spans[doc][-1][2]))
            else:
                spans[doc].append((a, b, float(p[i])))
            last = i
        return 1 / (1 + np.exp(-np.clip(x @ self.theta, -30, 30))), spans


def _log_odds(n: dict[int, int], sign: int = -1):
    """Of columns t and c, the lower (or upper) end of a 95 % interval, so that rare pieces need a clearer case."""
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    return F.log(t / (n.get(1, 0) + 1.0)) - F.log(c / (n.get(0, 0) + 1.0)) + sign * 1.96 * F.sqrt(1 / t + 1 / c)


def _table(rows: DataFrame) -> Table:
    """Of columns h and value; what a bounded sample of documents gives."""
    found = rows.select("h", "value").toArrow()
    return Table(found["h"].to_numpy().astype(np.int64).view(np.uint64), found["value"].to_numpy().astype(float))


def _counted(of: np.ndarray, hashes: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
    """Of each hash, in how many toxic and clean texts it is."""
    one = np.unique(np.stack([hashes, of.astype(np.uint64)], 1), axis=0)
    hashes, at = np.unique(one[:, 0], return_inverse=True)
    n = np.bincount(at, minlength=len(hashes))
    t = np.bincount(at, toxic[one[:, 1].astype(np.int64)], len(hashes)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(t), pa.array(n - t)], names=["h", "t", "c"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents that are not held out, ``sample`` of each class at most."""
    spark = docs.sparkSession
    small_batches(spark)
    nothing = Table(np.zeros(0, np.uint64), np.zeros(0))
    known = only(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out_of(F.col("doc_id"), folds))
    known = spool(known)
    totals = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        every = sum(totals.values())
        return Model(nothing, nothing, Field(), None, (totals.get(1, 0) + 0.5) / (every + 1) if every else 0.0)
    # A sample of bounded size by the hash of the id; it may be broadcast.
    chosen = spool(hashed_sample(known.where("toxic = 1"), ["doc_id"], sample, totals[1]).union(hashed_sample(known.where("toxic = 0"), ["doc_id"], sample, totals[0])))
    texts = only(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    texts = spool(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches, "text"):
            _, _, owners, kinds = _evidence(block)
            yield _counted(np.concatenate([owners[w] for w, _ in kinds]), np.concatenate([h for _, h in kinds]), np.array(rows.column("toxic").to_pylist()))

    sums = lambda rows: rows.groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    n = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    lexicon = _table(sums(texts.mapInArrow(count, "h long, t long, c long")).where(F.col("t") >= SUPPORT).withColumn("value", _log_odds(n)).where(F.col("value") >= CLEAR))
    shared = spark.sparkContext.broadcast(lexicon)

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches, "text"):
            found = candidates(shared.value, block)
            offsets = pa.array(np.searchsorted(found.owner, np.arange(block.n + 1)).astype(np.int32))
            lists = lambda x, offsets=offsets: pa.ListArray.from_arrays(offsets, pa.array(x))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), pa.array(found.counts), lists(found.place), lists(found.evidence), lists(found.pairs[:, 0].copy().view(np.int64)), lists(found.pairs[:, 1].copy().view(np.int64))], names=["doc_id", "toxic", "n", "place", "evidence", "before", "after"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spool(texts.select("doc_id", "toxic", "text").mapInArrow(chains, f"doc_id {kind}, toxic int, n long, place array<long>, evidence array<double>, before array<long>, after array<long>"))
    # Pairs of a candidate and its neighbour: what they say beyond the candidate itself, among the texts that have one.
    having = {r[0]: r[1] for r in rows.where(F.size("place") > 0).groupBy("toxic").count().collect()}
    beside = rows.select("doc_id", "toxic", F.explode(F.array_distinct(F.concat("before", "after"))).alias("h")).where("h <> 0")
    beside = beside.groupBy("h").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).where(F.col("t") + F.col("c") >= SUPPORT)
    context = _table(beside.withColumn("value", F.when(_log_odds(having) > 0, 1).when(_log_odds(having, 1) < 0, -1)).where("value is not null"))

    got = rows.orderBy("doc_id").toArrow()  # a few numbers a candidate of the sample
    array = lambda c: got[c].combine_chunks()
    toxic_doc, counts, size = array("toxic").to_numpy(), array("n").to_numpy(), np.diff(array("place").offsets.to_numpy())
    flat = lambda c, kind: array(c).flatten().to_numpy().astype(kind)
    owner = np.repeat(np.arange(len(counts)), size)
    none = np.zeros(len(owner), np.int64)
    pairs = np.stack([flat("before", np.int64).view(np.uint64), flat("after", np.int64).view(np.uint64)], 1)
    found = Candidates(owner, flat("place", np.int64), none, none, flat("evidence", float), pairs, counts)
    model = Model(lexicon, context, Field(np.array([0.0] * (UNARY + 4) + [-4.0, 0.0, 0.0, 0.0])), np.zeros(4), 0.0)
    codes, shape = model.codes(found), Field.shape(owner, found.place, counts)
    marginals = np.ones(len(owner))
    for _ in range(2):
        most = np.zeros(len(counts))
        np.maximum.at(most, owner, marginals)
        tagged = (toxic_doc[owner] == 1) & ((marginals >= 0.5) | (marginals == most[owner]))
        model.field.fit(codes, tagged.astype(float), shape, counts)
        marginals = model.field.marginals(codes, shape, counts)[0]
    weight = np.where(toxic_doc == 1, totals[1] / max(1, (toxic_doc == 1).sum()), totals[0] / max(1, (toxic_doc == 0).sum()))
    return model._replace(theta=_logistic(_document_features(len(counts), owner, marginals, counts), toxic_doc.astype(float), weight))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, spans (byte offsets within the UTF-8 text, largest marginal)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches, "text"):
            score, spans = model.value.score(block)
            spans = pa.array([[dict(zip(("start", "end", "p"), x, strict=True)) for x in row] for row in spans], span)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), spans], names=["doc_id", "held_out", "score", "predicted", "spans"])

    source = only(docs, doc_id="doc_id", text="text").withColumn("held_out", held_out_of(F.col("doc_id"), folds))
    return source.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long,p:double>>")
