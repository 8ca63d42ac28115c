"""The fill-in-the-middle scan against brute force: marks, white space, long texts, chunk borders, nulls, repeats, clashes."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoflow.llm import infill

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n, hexed = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text))


def rows(seed, chunk):
    r = random.Random(seed)
    out = [(None, "a b"), (None, None), (1, ""), (2, " "), (3, " \n\t"), (4, "x" * (3 * chunk)), (5, " " * (2 * chunk)), (6, "é " * chunk), (7, "<P"), (8, "<S>"), (9, "\0 \0")]
    letters = ["a", "b", "é", "日", " ", "\n", "\x0b", "<", "P", "M", ">"]
    for i in range(10, 210):
        size = r.choice([63, 64, 65, chunk - 1, chunk, chunk + 1, 3 * chunk]) if i % 5 == 0 else r.randrange(200)
        out.append((i, "".join(r.choice(letters if i % 3 else letters[:7]) for _ in range(size))))
    return out + out[-4:] + out[3:7]


@pytest.mark.parametrize("seed, chunk", [(0, 100), (1, 1 << 15), (2, 7)])
def test_infill(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(infill, "CHUNK", chunk)
    data = rows(seed, chunk if chunk < 1000 else 30)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    df = df.selectExpr("*", "1 AS n", "'x' AS form", "true AS marked", "5 AS `__shard`", "6 AS h", "array(1) AS pieces")
    got = infill.digests(df)
    assert got.columns == COLUMNS
    assert Counter(tuple(x) for x in got.collect()) == Counter(brute(*x) for x in data)


def test_infill_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infill.digests(df).collect() == []


def test_forms_are_all_met(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("one two  three\nfour ").alias("text"))
    assert {x["form"] for x in infill.transformed(df).collect()} == {"plain", "psm", "spm"}


def test_chunks_compose_to_the_whole():
    """A text's function and counts are those of its chunks composed, whatever the chunks, from every start state."""
    r = random.Random(3)
    for _ in range(40):
        raw = bytes(r.choice(b"ab <PSM>\n\xc3\xa9") for _ in range(r.randrange(1, 400)))
        cuts = sorted(r.sample(range(len(raw) + 1), min(5, len(raw))))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        whole, pieces = infill.Scan([raw]).fold, infill.Scan(parts).fold
        joined = infill.fold(pieces.after.astype(np.uint8), pieces.ends, pieces.marks, pieces.chars, np.array([len(parts)]))
        for name in ("after", "ends", "marks", "chars"):
            assert (getattr(whole, name) == getattr(joined, name)).all()
