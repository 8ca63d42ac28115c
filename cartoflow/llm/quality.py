r"""Quality by weak supervision.

Rules look at whole-text counts and vote good (+), bad (-) or abstain (0).  How often each pattern of votes occurs over
all documents that pass the base conditions is counted (at most 3**rules patterns, the only thing that reaches the driver), and
expectation-maximisation of a two-class model, one vote distribution a rule and class, gives each pattern a posterior
probability of being good.  A document is kept unless it fails the base conditions or its posterior is under
``least``; no rule alone rejects, however it votes.

Cases.  Null or empty text: no words, so base_failed.  Repeated rows: a row each.  Empty table: empty result.  Other
columns are ignored by ``judged`` and kept by ``filtered``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import NOT_SPACE, Block, blocks, byte_table, gram_hashes, mixed, only, small_batches, span_hashes, spool

SYMBOLS = byte_table()
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER, ASCII_LETTER = byte_table((0x41, 0x5A)), byte_table((0x41, 0x5A), (0x61, 0x7A))
NOT_CONTINUED = ~byte_table((0x80, 0xBF))
SENTENCE_END = byte_table()
SENTENCE_END[list(b".!?")] = True
_SALT = np.uint64(0xD6E8FEB86659FD93)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another equals it, and whether an earlier one does."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    any_, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order], earlier[order] = same[1:] | same[:-1], same[:-1]
    return any_, earlier


def features(block: Block, window: int = 8) -> dict[str, np.ndarray]:
    """Counts of each text of the block."""
    data, n = block.data, block.n
    starts, ends, owners = block.words(data, NOT_SPACE)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[block.ends] - sums[block.starts]

    out = {"n_words": block.per_text(owners), "word_chars": count(NOT_SPACE[data] & NOT_CONTINUED[data]), "n_symbols": count(SYMBOLS[data])}
    # Lines: each ends at a line feed, the block's own one after each text among them.
    feeds = np.flatnonzero(data == 10)
    heads = np.concatenate([[0], feeds[:-1] + 1]) if len(feeds) else feeds
    seen = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    filled = seen[feeds] > seen[heads]
    heads, feeds = heads[filled], feeds[filled]
    of = np.searchsorted(block.ends, heads)
    out["n_dup_lines"] = block.per_text(of[_repeated(mixed(span_hashes(data, heads, feeds) + of.astype(np.uint64) * _SALT))[1]])
    out["n_lines"] = block.per_text(of)
    words = span_hashes(data, starts, ends)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= window:
        grams = mixed(gram_hashes(words, window) + owners[: len(words) - window + 1].astype(np.uint64) * _SALT)
        at = np.flatnonzero(owners[: len(grams)] == owners[window - 1 :])
        at = at[_repeated(grams[at])[0]]
        covered[at] += 1
        covered[at + window] -= 1
    out["n_repeat_words"] = block.per_text(owners[np.cumsum(covered)[:-1] > 0])
    out["n_upper"], out["n_letters"] = count(UPPER[data]), count(ASCII_LETTER[data])
    out["n_marks"] = count(data == 0x21)
    out["n_ends"] = block.per_text(owners[SENTENCE_END[data[ends - 1]]]) if len(ends) else np.zeros(n, np.int64)
    out["n_echoes"] = block.per_text(owners[1:][(words[1:] == words[:-1]) & (owners[1:] == owners[:-1])]) if len(words) else np.zeros(n, np.int64)
    return out


#: (name, value of a text, bad from, good up to): bad above the first, good below the second, else no vote.
RULES = (
    ("symbols", lambda f: f["n_symbols"] / np.maximum(1, f["n_words"]), 0.2, 0.05),
    ("capitals", lambda f: f["n_upper"] / np.maximum(1, f["n_letters"]), 0.5, 0.2),
    ("repeats", lambda f: f["n_repeat_words"] / np.maximum(1, f["n_words"]), 0.3, 0.1),
    ("lines", lambda f: f["n_dup_lines"] / np.maximum(1, f["n_lines"]), 0.3, 0.1),
    ("long_words", lambda f: f["word_chars"] / np.maximum(1, f["n_words"]), 20.0, 12.0),
    ("marks", lambda f: f["n_marks"] / np.maximum(1, f["n_words"]), 0.3, 0.1),
    ("echoes", lambda f: f["n_echoes"] / np.maximum(1, f["n_words"]), 0.3, 0.1),
    ("short", lambda f: 20.0 - f["n_words"], 0.0, -20.0),
)


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def votes(f: dict[str, np.ndarray]) -> list[str]:
    """One character a rule: ``+``, ``-`` or ``0``."""
    columns = []
    for _, value, bad, good in RULES:
        x = value(f)
        columns.append(np.where(x > bad, "-", np.where(x < good, "+", "0")))
    return ["".join(row) for row in np.array(columns).T.tolist()] if len(columns[0]) else []


#: Priors as (documents, share of them), whatever the table's size: bad votes of good and bad documents, good votes of both.
BAD_VOTES, GOOD_VOTES = ((2.0, 0.01), (2.0, 0.1)), ((2.0, 0.9), (2.0, 0.5))
#: What fixes which class is good: a rule is against at most this share of its documents ...
MOST_BAD = 0.005
#: ... and of the bad class, at most this share has no bad vote at all.
MISSED = 0.02


def fit(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """EM over vote patterns: the posterior of good for each; patterns with a count of 0 are judged but teach nothing.

    A class has, for each rule, the share of documents where it votes bad, and of the others the share where it votes
    good.  Good votes mostly agree with each other, so those of one document count as one (their mean log-likelihood);
    bad votes count each.  Shares come from the votes, with priors of a few documents.  Votes alone do not say which
    class is which, nor part an ordinary document from a bad one that no rule noticed: MOST_BAD and MISSED do, and rules
    are better than chance (bad votes not rarer in the bad class, good votes not rarer in the good one).  So a rule's
    lone bad vote is believed where it is common, and not where it is rare and nothing else agrees.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    minus = np.array([[c == "-" for c in p] for p in patterns], float)
    plus = np.array([[c == "+" for c in p] for p in patterns], float)
    other = 1 - minus
    share = other / np.maximum(1, other.sum(1, keepdims=True))
    clean = ~minus.any(1)
    total = n.sum()
    post = np.where(clean, 0.9, 0.1)
    for _ in range(rounds):
        weights = n * post, n * (1 - post)
        bad, bad_b = ((w @ minus + k * x) / (w.sum() + k) for w, (k, x) in zip(weights, BAD_VOTES, strict=True))
        good, good_b = ((w @ plus + k * x) / (w @ other + k) for w, (k, x) in zip(weights, GOOD_VOTES, strict=True))
        bad = np.minimum(bad, MOST_BAD)
        bad_b, good_b = np.maximum(bad_b, bad), np.minimum(good_b, good)
        logs = [minus @ np.log(x) + other @ np.log(1 - x) + (share * plus) @ np.log(y) + (share * (other - plus)) @ np.log(1 - y) for x, y in ((bad, good), (bad_b, good_b))]
        none = np.log(1 - bad_b).sum()  # of a bad document that no rule is against; MISSED takes its place
        logs[1] += np.where(clean, np.log(MISSED) - none, np.log((1 - MISSED) / -np.expm1(none)))
        shares = [np.log((w.sum() + 1) / (total + 2)) for w in weights]
        new = 1 / (1 + np.exp(np.clip(logs[1] + shares[1] - logs[0] - shares[0], -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return dict(zip(patterns, post.tolist(), strict=True))


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and the votes, from doc_id and text."""
    names = [*BASE]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches, "text"):
            f = features(block)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(f[c].astype(np.int64)) for c in names], pa.array(base_failed(f)), pa.array(votes(f), pa.string())], names=["doc_id", *names, "base_failed", "votes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    return only(docs, doc_id="doc_id", text="text").mapInArrow(each, f"doc_id {kind}, {', '.join(f'{c} long' for c in names)}, base_failed boolean, votes string")


def _posteriors(measured: DataFrame) -> dict[str, float]:
    """Fitted on what passes the base conditions: the rest goes anyway, and would teach the bad class its own kind."""
    counts = measured.groupBy("votes").agg(F.count_if(~F.col("base_failed")).alias("n"))
    return fit({r["votes"]: r["n"] for r in counts.collect()})  # 3**len(RULES) rows at most


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row: doc_id, the five base counts, base_failed, kept, and the posterior."""
    rows = spool(_measured(docs))
    found = _posteriors(rows)
    table = docs.sparkSession.createDataFrame(sorted(found.items()), "votes string, posterior double")
    out = rows.join(F.broadcast(table), "votes")  # bounded by the number of patterns
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"), "posterior", "votes")


def filtered(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that are kept, all columns, in a second pass that needs no shuffle."""
    good = {p for p, x in _posteriors(_measured(docs)).items() if x >= least}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in blocks(batches, "text"):
            f = features(block)
            yield rows.filter(pa.array(~base_failed(f) & np.fromiter((v in good for v in votes(f)), bool, block.n)))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(each, docs.schema)
