r"""Language-model scores: a causal self-attention model on subword ids, trained in numpy, and a unigram base.

Words and an end a text are the tokens of the contract.  Counts of words and of subwords cover all training documents:
each shard of documents sends its distinct words with their training counts, and gets back the corpus counts of those.

The model sees a word as the byte-level subwords of a public vocabulary; an id also says whether it ends its word, so
words are a prefix code.  One layer of causal attention over windows of 2 * STRIDE subwords, of which the later half is
scored, so windows overlap and every subword is scored once; then a hidden layer, a softmax over groups of classes, one
over the classes of the group, and within its class each id's share of the corpus.  Frequent ids have an input and a class
of their own; all others, whatever their number, are dealt over the remaining ones.

The fit reads every training document, each in one of the rounds (small corpora: more than once).  A round's texts are dealt
over trainers when it comes, and cut to subwords there, as their ids are several times as large and hardly shrink on disk;
every trainer takes gradient steps on its part from the same weights, and the weights are averaged (by a tree of partial averages, so the driver gets a few of
them only).

The probability of a word mixes, by Witten and Bell's weight N / (N + V), two ways to say it: as a word of the corpus,
which is the model's probability of its first subword times the word's share of the corpus among words that begin so,
and subword by subword.

Cases.  Null or empty text: the end alone.  Null doc_id: a training document, held_out false.  Repeated rows: a row and
a count each.  No training documents: base_score 0, and the untrained model's score.  Empty table: empty result.  Words
of over PIECE characters are cut to pieces of so many before subwords, all of which are scored.  Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.llm.common import NOT_SPACE, Block, blocks, only, small_batches, span_hashes
from cartoflow.llm.shards import SHARD, SUMMARY, spool_shards, summaries, with_side, write_side

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A corpus of fewer than PASSES subwords is passed over again, three times at most; rounds have these learning rates.
PASSES, RATES = 1 << 21, (0.03, 0.015, 0.006)
#: Subwords a trainer has, and trainers at most (beyond, they have more each).
TRAINER, TRAINERS = 1 << 19, 4096
#: Averages that reach the driver at once, and subwords of a row of the fit.
FEW, PIECE_IDS = 16, 1 << 16
STRIDE, WIDTH, HIDDEN = 16, 16, 47
#: Inputs of ids: the OWN_INPUTS most frequent have one each, others share the rest.  Input 0 begins a text.
INPUTS, OWN_INPUTS = 2048, 1792
#: Classes of ids: GROUPS of MEMBERS each; the OWN most frequent ids have one each, others share the rest.
GROUPS, MEMBERS, OWN = 32, 32, 960
SHARD_BYTES = 24 << 20
#: Characters of a word that are cut to subwords at a time.
PIECE = 64
#: Weights that a step changes at a time.
ADAM = 1 << 14


def held_out_of(doc_id, folds: int = 7, fold: int = 2):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


class Subwords:
    """Words to ids: twice the vocabulary's number, plus one for the last of a word; the last id of all is the end."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self._encoding = tiktoken.Encoding("subwords", pat_str=rf"[^ ]{{1,{PIECE}}}", mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._bytes[list(ranks.values())] = list(map(len, ranks))
        self.size = 2 * len(self._bytes) + 1
        self.end = self.size - 1

    def encode(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words, each followed by a space in ``raw``: how many ids each has, and all ids."""
        if not len(lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = raw.tobytes().decode("utf-8", "replace")
        if "�" in text:  # bytes that are no UTF-8 count as question marks here
            raw = np.where(raw < 0x80, raw, np.uint8(0x3F))
            text = raw.tobytes().decode()
        ids = np.array(self._encoding.encode_ordinary(text), np.int64)
        last = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(lengths))
        ids *= 2
        ids[last] += 1
        return np.diff(last, prepend=-1), ids


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words: lower-cased data, starts, ends, texts, hashes."""
    data = block.lower()
    starts, ends, owners = block.words(data, NOT_SPACE)
    return data, starts, ends, owners, span_hashes(data, starts, ends)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges starts[i] .. starts[i] + lengths[i] - 1."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def spaced(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The words with a space after each."""
    raw = data[spread(starts, lengths + 1)]
    raw[np.cumsum(lengths + 1) - 1] = 0x20
    return raw


class Words:
    """Distinct words by ascending hash, with the ids of each; at last the end of a text."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, flat: np.ndarray, end: int):
        self.hashes, self.sizes, self.flat = hashes, np.append(sizes, 1), np.append(flat, end)
        self.heads = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, block: Block, subwords: Subwords) -> "Words":
        data, starts, ends, _, hashes = tokens(block)
        distinct, first = np.unique(hashes, return_index=True)
        lengths = (ends - starts)[first]
        return cls(distinct, *subwords.encode(spaced(data, starts[first], lengths), lengths), subwords.end)


def sequence(block: Block, words: Words) -> tuple[np.ndarray, ...]:
    """Per word, ends of texts included: its number among ``words`` and text; per subword: id and the word it is of."""
    _, _, _, owners, hashes = tokens(block)
    ends = np.cumsum(block.per_text(owners))
    at = np.insert(np.searchsorted(words.hashes, hashes), ends, len(words.hashes))
    texts = np.insert(owners, ends, np.arange(block.n))
    n = words.sizes[at]
    return at, texts, words.flat[spread(words.heads[at], n)], np.repeat(np.arange(len(at)), n)


def keep_memory() -> None:
    """An array of this size, once freed, has the allocator keep smaller ones: else it maps a step's arrays anew each time,
    and a third of a fit's time is page faults."""
    np.empty(1 << 24, np.uint8)


class Attention:
    """Tables of queries, keys, values and inputs by input id; biases by distance; a hidden layer (and a constant);
    weights of groups, and of a group's classes."""

    def __init__(self, size: int, seed: int = 0):
        r = np.random.default_rng(seed)
        init = lambda *shape, scale=0.1: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"q": init(INPUTS, WIDTH), "k": init(INPUTS, WIDTH), "v": init(INPUTS, WIDTH), "e": init(INPUTS, WIDTH, scale=0.5), "near": np.zeros(2 * STRIDE, np.float32), "we": init(WIDTH, HIDDEN, scale=0.3), "wa": init(WIDTH, HIDDEN, scale=0.3), "b": np.zeros(HIDDEN, np.float32), "u": init(HIDDEN + 1, GROUPS, scale=0.05), "u2": init(GROUPS, HIDDEN + 1, MEMBERS, scale=0.05)}
        self.learn_ids(np.zeros(size, np.int64))

    def learn_ids(self, counts: np.ndarray) -> None:
        """Inputs and classes from how often each id occurs: the most frequent have their own, others, in order of
        frequency, classes of about equal weight, and inputs in turn."""
        order = np.lexsort((np.arange(len(counts)), -counts))
        place = np.arange(len(counts))
        self.inputs = np.zeros(len(counts), np.int32)
        self.inputs[order] = np.where(place < OWN_INPUTS - 1, 1 + place, OWN_INPUTS + place % (INPUTS - OWN_INPUTS))
        weight, shared = counts[order[OWN:]] + 1e-3, GROUPS * MEMBERS - OWN
        self.classes = np.zeros(len(counts), np.int32)
        self.classes[order[:OWN]] = place[: len(order[:OWN])]
        self.classes[order[OWN:]] = OWN + np.minimum((np.cumsum(weight) / weight.sum() * shared).astype(int), shared - 1)
        smooth = counts + 0.01
        self.share = np.log(smooth / np.bincount(self.classes, smooth, GROUPS * MEMBERS)[self.classes])
        # Biases start at the corpus's own frequencies.
        by_class = np.bincount(self.classes, smooth, GROUPS * MEMBERS).reshape(GROUPS, MEMBERS) + 1e-6
        self.p["u"][-1] = np.log(by_class.sum(1) / by_class.sum())
        self.p["u2"][:, -1] = np.log(by_class / by_class.sum(1, keepdims=True))
        self._tables()

    def _tables(self) -> None:
        """What scoring derives from the weights once."""
        p, one = self.p, np.ones((INPUTS, 1), np.float32)
        distance = (STRIDE + np.arange(STRIDE))[:, None] - np.arange(2 * STRIDE)
        self.distance, self.group, self.member = distance, (self.classes // MEMBERS).astype(np.uint8), (self.classes % MEMBERS).astype(np.int32)
        self.bias = np.where(distance >= 0, np.exp(p["near"][np.maximum(distance, 0)]), np.float32(0))
        self.direct = np.concatenate([p["e"] @ p["we"] + p["b"], one], 1)
        self.values = np.concatenate([p["v"], one], 1)
        self.lift = np.concatenate([p["wa"], np.zeros((WIDTH, 1), np.float32)], 1)

    def copy(self) -> "Attention":
        other = object.__new__(type(self))
        other.__dict__ = self.__dict__ | {"p": {k: a.copy() for k, a in self.p.items()}}
        return other

    def load(self, weights: np.ndarray) -> "Attention":
        at = 0
        for k, a in self.p.items():
            self.p[k] = weights[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size
        self._tables()
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.p.values()])

    def windows(self, ids: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and texts in a row of which each 2 * STRIDE from a multiple of STRIDE are a window; padding is of text
        -1.  Every text begins at a multiple of STRIDE, so what is said of it does not depend on its neighbours; third,
        where each subword is among what is scored."""
        first = np.ones(len(ids), bool)
        first[1:] = texts[1:] != texts[:-1]
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, len(ids)))
        padded = -(-sizes // STRIDE) * STRIDE
        at = np.arange(len(ids)) + np.repeat(np.cumsum(padded) - padded - heads, sizes)
        n = int(padded.sum())
        x, of = np.zeros(n + STRIDE, np.int32), np.full(n + STRIDE, -1, np.int32)
        before = np.empty(len(ids), np.int32)
        before[1:] = self.inputs[ids[:-1]]
        before[first] = 0
        x[STRIDE + at], of[STRIDE + at] = before, texts
        return x, of, at

    def log_probabilities(self, ids: np.ndarray, texts: np.ndarray, batch: int = 512) -> np.ndarray:
        """Of each subword given those before it in its text."""
        keep_memory()
        p, (x, of, at) = self.p, self.windows(ids, texts)
        n = len(x) // STRIDE - 1
        group, member, out = np.zeros(n * STRIDE, np.uint8), np.zeros(n * STRIDE, np.int32), np.ones(n * STRIDE, np.float32)
        group[at], member[at] = self.group[ids], self.member[ids]
        ones_g, ones_m = np.ones(GROUPS, np.float32), np.ones(MEMBERS, np.float32)
        several = of[: n * STRIDE : STRIDE] != of[STRIDE::STRIDE]  # only windows over several texts, or with padding, need a mask
        padded = of[STRIDE:].reshape(n, STRIDE)[:, -1] < 0

        def overlapping(table: np.ndarray, m: int) -> np.ndarray:
            a, b = table.strides
            return np.lib.stride_tricks.as_strided(table, (m, 2 * STRIDE, table.shape[1]), (STRIDE * a, a, b))

        for i in range(0, n, batch):
            m = min(batch, n - i)
            lo, hi = i * STRIDE, (i + m) * STRIDE
            here = x[lo : hi + STRIDE]
            late = here[STRIDE:]
            weight = np.matmul(p["q"][late].reshape(m, STRIDE, WIDTH), overlapping(p["k"][here], m).transpose(0, 2, 1))
            np.exp(np.minimum(weight, 60, out=weight), out=weight)
            weight *= self.bias
            cut = np.flatnonzero(several[i : i + m] | padded[i : i + m])
            if len(cut):
                owner = of[lo + cut[:, None] * STRIDE + np.arange(2 * STRIDE)]
                weight[cut] *= owner[:, STRIDE:, None] == owner[:, None, :]
            value = np.matmul(weight, overlapping(self.values[here], m)).reshape(-1, WIDTH + 1)
            hidden = (value[:, :WIDTH] / value[:, WIDTH:]) @ self.lift
            hidden += self.direct[late]
            np.maximum(hidden, 0, out=hidden)
            rows = np.arange(hi - lo)
            logits = hidden @ p["u"]
            np.exp(np.clip(logits, -60, 60, out=logits), out=logits)
            said = logits[rows, group[lo:hi]] / (logits @ ones_g)
            order = np.argsort(group[lo:hi], kind="stable")
            by_group, logits, begin = hidden[order], np.empty((hi - lo, MEMBERS), np.float32), 0
            for g, end in enumerate(np.cumsum(np.bincount(group[lo:hi], minlength=GROUPS)).tolist()):
                if end > begin:
                    np.dot(by_group[begin:end], p["u2"][g], out=logits[begin:end])
                begin = end
            np.exp(np.clip(logits, -60, 60, out=logits), out=logits)
            said[order] *= logits[rows, member[lo:hi][order]] / (logits @ ones_m)
            out[lo:hi] = said
        return np.log(np.maximum(out[at], 1e-36)).astype(np.float64) + self.share[ids]

    def fit(self, ids: np.ndarray, texts: np.ndarray, passes: int, rate: float, part: int = 0, of: int = 1, batch: int = 96, seed: int = 1) -> int:
        """Adam on the class cross-entropy of every ``of``-th window from the ``part``-th, ``passes`` times; how many
        windows that were."""
        x, owner, at = self.windows(ids, texts)
        goal = np.full(len(x) - STRIDE, -1, np.int64)
        goal[at] = self.classes[ids]
        view = lambda a: np.lib.stride_tricks.sliding_window_view(a, 2 * STRIDE)[::STRIDE]
        x, owner, goal = view(x), view(owner), goal.reshape(-1, STRIDE)
        mine = np.arange(part % max(1, min(of, len(x))), len(x), of)
        if not len(mine):
            return 0
        keep_memory()
        r, weights = np.random.default_rng(seed), self.flat()
        self.p, step, steps = self._parts(weights), 0, passes * -(-len(mine) // batch)
        # Moments are kept as sums, g + 0.9 m and g * g + 0.98 v; the step scales them.
        grown, m, v, t = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(weights), np.empty(ADAM, np.float32)
        g = self._parts(grown)
        for _ in range(passes):
            order = r.permutation(mine)
            for i in range(0, len(order), batch):
                pick, step = order[i : i + batch], step + 1
                self.gradients(x[pick], owner[pick], goal[pick], g)
                now = rate * min(1.0, step / 10, 1.5 * (1 - step / (steps + 1)) + 0.1)
                root = np.sqrt(0.02 / (1 - 0.98**step))
                far, least = np.float32(now * 0.1 / (1 - 0.9**step) / root), np.float32(1e-8 / root)
                for j in range(0, len(weights), ADAM):  # pieces that stay in the cache
                    here = slice(j, j + ADAM)
                    gj, mj, vj = grown[here], m[here], v[here]
                    tj = t[: len(gj)]
                    mj *= np.float32(0.9)
                    mj += gj
                    np.multiply(gj, gj, out=tj)
                    vj *= np.float32(0.98)
                    vj += tj
                    np.sqrt(vj, out=tj)
                    tj += least
                    np.divide(mj, tj, out=tj)
                    tj *= far
                    weights[here] -= tj
        self._tables()
        return passes * len(mine)

    def _parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The tables as views of one array, in the order of ``flat``."""
        ends = np.cumsum([a.size for a in self.p.values()])
        return {k: flat[end - a.size : end].reshape(a.shape) for (k, a), end in zip(self.p.items(), ends.tolist(), strict=True)}

    def gradients(self, x: np.ndarray, owner: np.ndarray, goal: np.ndarray, g: dict[str, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean class cross-entropy of the later halves of windows, and its gradient (written over ``g`` where given)."""
        p, n, late = self.p, len(x), x[:, STRIDE:]
        g = {name: np.empty_like(a) for name, a in p.items()} if g is None else g
        rows = lambda a: a.reshape(-1, a.shape[-1])
        q, k, v = p["q"].take(late, axis=0), p["k"].take(x, axis=0), p["v"].take(x, axis=0)
        score = np.matmul(q, k.transpose(0, 2, 1))
        np.exp(np.minimum(score, 60, out=score), out=score)
        score *= np.where(self.distance >= 0, np.exp(p["near"][np.maximum(self.distance, 0)]), np.float32(0))
        several = np.flatnonzero((owner != owner[:, -1:]).any(1))  # other windows are of one text
        score[several] *= owner[several][:, STRIDE:, None] == owner[several][:, None, :]
        score /= np.maximum(rows(score) @ np.ones(2 * STRIDE, np.float32), np.float32(1e-30)).reshape(n, STRIDE, 1)
        mixed = rows(np.matmul(score, v))
        inner = rows(p["e"].take(late, axis=0))
        within = inner @ p["we"]
        within += mixed @ p["wa"]
        within += p["b"]
        np.maximum(within, 0, out=within)

        # From here on by group; padding is in group 0 and weighs nothing.
        goals = goal.ravel()
        real = goals >= 0
        order = np.argsort((np.maximum(goals, 0) // MEMBERS).astype(np.uint8), kind="stable")
        goals = np.maximum(goals[order], 0)
        scale = (real[order] / max(1, real.sum())).astype(np.float32)
        group, member = goals // MEMBERS, goals % MEMBERS
        hidden = np.ones((n * STRIDE, HIDDEN + 1), np.float32)
        hidden[:, :HIDDEN] = within[order]

        def softmax(z: np.ndarray, want: np.ndarray) -> tuple[float, np.ndarray]:
            np.exp(np.clip(z, -60, 60, out=z), out=z)
            each, at = 1 / (z @ np.ones(z.shape[1], z.dtype)), np.arange(0, z.size, z.shape[1]) + want
            said = z.ravel()[at] * each
            z *= (each * scale)[:, None]
            z.ravel()[at] -= scale
            return -float(np.dot(np.log(np.maximum(said, 1e-30)), scale)), z

        loss, d = softmax(hidden @ p["u"], group)
        np.matmul(hidden.T, d, out=g["u"])
        dh = d @ p["u"].T
        cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        logits = np.empty((len(order), MEMBERS), np.result_type(hidden, p["u2"]))
        for j in range(GROUPS):
            np.matmul(hidden[cuts[j] : cuts[j + 1]], p["u2"][j], out=logits[cuts[j] : cuts[j + 1]])
        more, d = softmax(logits, member)
        loss += more
        back = np.empty((len(order), HIDDEN + 1), logits.dtype)
        for j in range(GROUPS):
            part = d[cuts[j] : cuts[j + 1]]
            np.matmul(hidden[cuts[j] : cuts[j + 1]].T, part, out=g["u2"][j])
            np.matmul(part, p["u2"][j].T, out=back[cuts[j] : cuts[j + 1]])
        dh += back
        by_group, dh = dh, np.empty_like(within)
        dh[order] = by_group[:, :HIDDEN]
        dh *= within > 0
        g["b"][:] = np.ones(len(dh), dh.dtype) @ dh
        np.matmul(inner.T, dh, out=g["we"])
        np.matmul(mixed.T, dh, out=g["wa"])
        dm = (dh @ p["wa"].T).reshape(n, STRIDE, WIDTH)
        ds = np.matmul(dm, v.transpose(0, 2, 1))
        ds -= (rows(dm) * mixed @ np.ones(WIDTH, dm.dtype)).reshape(n, STRIDE, 1)  # of a row: its weights times da, summed
        ds *= score
        g["near"][:] = np.bincount(np.maximum(self.distance, 0).ravel(), (ds.sum(0) * (self.distance >= 0)).ravel(), 2 * STRIDE)
        for at, parts in ((late, {"e": dh @ p["we"].T, "q": rows(np.matmul(ds, k))}), (x, {"k": rows(np.matmul(ds.transpose(0, 2, 1), q)), "v": rows(np.matmul(score.transpose(0, 2, 1), dm))})):
            cells = (at.reshape(-1, 1).astype(np.int64) * (2 * WIDTH) + np.arange(2 * WIDTH)).ravel()
            sums = np.bincount(cells, np.concatenate(list(parts.values()), 1).ravel(), INPUTS * 2 * WIDTH).reshape(INPUTS, 2 * WIDTH)
            for i, name in enumerate(parts):
                g[name][:] = sums[:, i * WIDTH : (i + 1) * WIDTH]
        return loss, g


#: Shards told of their words: n of a word; of an id, minus how often it occurs (h: the id) and begins a word (h: -1 - id).
_SUMMARY = pa.struct([("h", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32()))])
_SUMMARY_DDL = "struct<h:long,n:long,ids:array<int>>"


def _spooled(source: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """The documents in shards, with each shard's distinct words, their training counts and ids."""

    def add(found: list, rows: pa.RecordBatch, block: Block) -> None:
        data, starts, ends, owners, hashes = tokens(block)
        training = ~rows.column(rows.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = (ends - starts)[at]
        found.append((distinct, np.bincount(inverse, training[owners], len(distinct)).astype(np.int64), lengths, spaced(data, starts[at], lengths) if len(at) else np.zeros(0, np.uint8)))

    def close(found: list) -> pa.StructArray:
        hashes, n, lengths, raw = (np.concatenate(x) for x in zip(*found, strict=True))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(inverse, n, len(distinct)).astype(np.int64)
        heads = np.cumsum(lengths + 1) - lengths - 1
        sizes, flat = _subwords(vocabulary).encode(raw[spread(heads[first], lengths[first] + 1)], lengths[first])
        every = np.bincount(flat, np.repeat(n, sizes)).astype(np.int64)
        begin = np.bincount(flat[np.cumsum(sizes) - sizes], n).astype(np.int64)
        a, b = np.flatnonzero(every), np.flatnonzero(begin)
        ends = np.concatenate([[0], np.cumsum(sizes), np.full(len(a) + len(b), len(flat))]).astype(np.int32)
        h = np.concatenate([distinct.view(np.int64), a, -1 - b])
        return pa.StructArray.from_arrays([pa.array(h), pa.array(np.concatenate([n, -every[a], -begin[b]])), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))], ["h", "n", "ids"])

    return spool_shards(source, _SUMMARY, _SUMMARY_DDL, add, close, SHARD_BYTES)


_loaded: dict[int, Subwords] = {}


def _subwords(vocabulary: Broadcast) -> Subwords:
    """One table a worker."""
    key = hash(vocabulary.value)
    if key not in _loaded:
        _loaded[key] = Subwords(vocabulary.value)
    return _loaded[key]


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _of_round(key: Column, part: int, of: int) -> Column:
    return F.pmod(key, F.lit(of)) == part


def _fit_rows(base: DataFrame, vocabulary: Broadcast, tasks: int | None = None) -> DataFrame:
    """(key, ids) of the training documents of ``base``; very long ones in pieces.  Texts are dealt over ``tasks`` before they
    are cut."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches, "text"):
            subwords = _subwords(vocabulary)
            _, texts, ids, of = sequence(block, Words.of(block, subwords))
            keys = rows.column(rows.schema.get_field_index("key")).to_pylist()
            cuts = np.searchsorted(texts[of], np.arange(block.n + 1)).tolist()
            found = [(keys[i], ids[at : min(at + PIECE_IDS, cuts[i + 1])].astype(np.int32).tobytes()) for i in range(block.n) for at in range(cuts[i], cuts[i + 1], PIECE_IDS)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["key", "ids"])

    texts = base.where(~F.col("held_out")).select(_key().alias("key"), "text")
    return (texts.repartition(tasks) if tasks else texts).mapInArrow(each, "key long, ids binary")


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weights = 0, 0.0
    for batch in batches:
        for n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total, weights = total + n, weights + n * np.frombuffer(w, np.float32).astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(weights / total).astype(np.float32).tobytes()])], names=["n", "weights"])


def trained(rows: DataFrame, counts: np.ndarray, rates: tuple[float, ...] = RATES, turn: Callable[[int, int, int], DataFrame] | None = None) -> Attention:
    """The model of rows (key, ids), in rounds of local steps and averages; ``counts`` of all ids in the corpus.  Rows are of
    one round by their keys; ``turn`` gives those of a round, dealt over so many tasks, where that is cheaper than to pick them
    from all."""
    spark, model = rows.sparkSession, Attention(len(counts))
    model.learn_ids(counts)
    turn = turn or (lambda part, of, tasks: rows.where(_of_round(F.col("key"), part, of)).repartition(tasks))
    size = int(counts.sum())
    if not size:
        return model
    passes = min(3, -(-PASSES // size))
    trainers = min(TRAINERS, size * passes // TRAINER + 1)
    for part, rate in enumerate(rates):
        now = spark.sparkContext.broadcast(model)

        def each(batches: Iterator[pa.RecordBatch], rate: float = rate, now: Broadcast = now) -> Iterator[pa.RecordBatch]:
            found = [np.frombuffer(x, np.int32) for batch in batches for x in batch.column(1).to_pylist()]
            if found:
                texts = np.repeat(np.arange(len(found)), [len(x) for x in found])
                mine = now.value.copy()
                n = mine.fit(np.concatenate(found), texts, passes, rate)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mine.flat().tobytes()])], names=["n", "weights"])

        weights, left = turn(part, len(rates), trainers).sortWithinPartitions("key", "ids").mapInArrow(each, "n long, weights binary"), trainers
        while left > FEW:
            left = int(np.ceil(np.sqrt(left)))
            weights = weights.repartition(left).mapInArrow(_average, "n long, weights binary")
        for batch in _average(iter(weights.toArrow().to_batches())):
            model.load(np.frombuffer(batch.column(1)[0].as_py(), np.float32))
    return model


def scored(docs: DataFrame, vocabulary: str = VOCABULARY, rates: tuple[float, ...] = RATES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        raw = f.read()
    pieces, size = spark.sparkContext.broadcast(raw), Subwords(raw).size
    base = _spooled(only(docs, doc_id="doc_id", text="text").withColumn("held_out", held_out_of(F.col("doc_id"))), pieces)

    # A word that is everywhere has one row a shard here, already counted.
    told = summaries(base).select(SHARD, "h", "n")
    shards = base.where(F.col(SUMMARY).isNotNull()).count()
    of = Window.partitionBy("h")
    words = told.where("n >= 0").repartition(shards + 1, "h").withColumns({"c": F.sum("n").over(of), "one": F.row_number().over(of.orderBy(SHARD)) == 1}).where("c > 0")
    folder = write_side(words.select(SHARD, "h", "n", "c", "one"), shards + 1)
    total, distinct = spark.read.schema("n long, one boolean").parquet(folder).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if("one")).first()
    n_train = base.where("not held_out").count()
    total, distinct = total + n_train, distinct + (n_train > 0)

    # Counts of ids: two numbers for each of the vocabulary at most.
    of_ids = told.where("n < 0").groupBy("h").agg((-F.sum("n")).alias("n")).toPandas()
    h, n = of_ids["h"].to_numpy(np.int64), of_ids["n"].to_numpy(np.int64)
    counts, begins = np.zeros(size, np.int64), np.zeros(size, np.int64)
    counts[h[h >= 0]], begins[-1 - h[h < 0]] = n[h >= 0], n[h < 0]
    counts[-1] = begins[-1] = n_train
    model = spark.sparkContext.broadcast(trained(_fit_rows(base, pieces), counts, rates, lambda part, of, tasks=None: _fit_rows(base.where(_of_round(_key(), part, of)), pieces, tasks)))
    known_share = total / (total + distinct) if total else 0.0

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for _, rows, side in with_side(batches, folder, "h"):
            told = rows[-1].column(rows[-1].schema.get_field_index(SUMMARY))[-1].values
            told = told.filter(pc.greater_equal(told.field("n"), 0))
            ids = told.field("ids")
            words = Words(told.field("h").to_numpy().view(np.uint64), np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy(), size - 1)
            of_word = np.zeros(len(words.sizes), np.int64)
            if side:
                of_word[np.searchsorted(words.hashes, side["h"].view(np.uint64))] = side["c"]
            of_word[-1] = n_train
            plain = np.log10((of_word + 1) / (total + 1 * (distinct + 1)))
            with np.errstate(divide="ignore"):
                of_first = np.log(of_word / np.maximum(1, begins[words.flat[words.heads]]))
            for sub, block in blocks(iter(rows), "text"):
                at, texts, ids, of = sequence(block, words)
                of_id = net.log_probabilities(ids, texts[of])
                heads = np.searchsorted(of, np.arange(len(at)))
                word = np.add.reduceat(of_id, heads)
                if known_share:
                    word = np.logaddexp(np.log(known_share) + of_id[heads] + of_first[at], np.log(1 - known_share) + word)
                score = np.bincount(texts, word / np.log(10), block.n)
                columns = [pa.array(np.bincount(texts, minlength=block.n)), pa.array(np.bincount(texts, of_word[at] > 0, block.n).astype(np.int64)), pa.array(np.full(block.n, total, np.int64)), pa.array(np.bincount(texts, plain[at], block.n)), pa.array(score)]
                yield pa.RecordBatch.from_arrays([sub.column(0), sub.column(1), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return base.select("doc_id", "held_out", "text", SHARD, SUMMARY).mapInArrow(each, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
