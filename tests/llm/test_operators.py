"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and other
columns with clashing names."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartoflow.llm import decontaminate, licences, lm, mixing, quality, simhash, suffixes, toolcalls, toxicity, warc
from cartoflow.llm.common import Block
from cartoflow.operators.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns of other tables, under names that operators use inside.
CLASH = {"h": "1", "row": "2", "fp": "3", "part": "4", "size": "5", "payload": "'x'", "votes": "'+'", "held_out": "true", "__shard": "6", "words": "array(1)"}


def table(spark, rows, schema, clash=True):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.selectExpr("*", *[f"{v} AS `{k}`" for k, v in CLASH.items() if k not in df.columns]) if clash else df


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "é", "ß!", "x1", "the", "of", "end."]
    out = [None, "", "   ", "\n\n", "one", "One  two\tthree", "long " * 30_000, "é" * 200, "line\nline\nline\nother"]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(1, 90))) for _ in range(12)]
    while len(out) < n:
        t = r.choice(base)
        out.append(t if r.random() < 0.4 else t + " " + r.choice(words) if r.random() < 0.5 else "\n".join(r.sample(base, 3)))
    return out


def docs(spark, seed=0, repeat=True, clash=True):
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts(seed))]
    rows += rows[10:14] if repeat else []
    return rows, table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long", clash)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ------------------------------------------------------------------------------------------------------------ WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nb é", "x"), (2, None, "x"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é\r\n\r\n" * 9), (None, "http://f", "x"), (7, "u", "z" * 3_000_000), (2, None, "x"), (8, "u", "only")]
    out = warc.archive(table(spark, rows, "page_id long, url string, html string"), payloads=True).collect()
    assert len(out) == len(rows)
    seen = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        first = min(same)
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)] += 1
    assert seen == want
    assert {r["page_id"]: bytes(r["payload"]) for r in out if r["record_type"] == "response"}[5] == ("é\r\n\r\n" * 9).encode()
    assert sorted((str(r["page_id"]), r["url"] or "") for r in out) == sorted((str(i), u or "") for i, u, _ in rows)


def test_warc_least_and_empty(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert got(warc.archive(df, least=3), "page_id", "record_type") == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_files_are_members(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(i, "u", str(i) * 9) for i in range(20)], "page_id long, url string, html string").repartition(2)
    index = warc.write_warc(warc.plan_records(df), folder)
    for r in index.collect():
        raw = open(r["file"].removeprefix("file://"), "rb").read()
        fields, payload, _ = warc.parse_record(zlib.decompress(raw[r["offset"] : r["offset"] + r["length"]], 31))
        assert fields["x-page-id"] == str(r["page_id"]) and payload == str(r["page_id"]).encode() * 9
    assert warc.read_warc(index.where("page_id % 7 = 3")).count() == 3


# -------------------------------------------------------------------------------------------------- decontamination

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, items):
    lists = [(i, ALNUM.findall((t or "").translate(LOWER))) for i, t in items]
    out = []
    for r in rows:
        w = ALNUM.findall((r[1] or "").translate(LOWER))
        hit, ids = set(), set()
        for i, x in lists:
            n = min(13, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids.add("" if i is None else str(i))
        joined = ",".join(sorted(ids))
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_contamination(spark, seed):
    rows, df = docs(spark, seed)
    r = random.Random(seed)
    long = [t for _, t, *_ in rows if t and 20 < len(t.split()) < 400]
    items = [(1, None), (2, "-- !"), (3, "gamma"), (4, "the of"), (5, long[0]), (5, long[1]), (None, long[2])] + [(6 + i, " ".join(r.choice(long).split()[3:24])) for i in range(9)]
    bench = table(spark, items, "item_id long, text string")
    found = decontaminate.contamination(df, bench)
    assert got(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_contamination(rows, items)
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(x[0] for x in got(kept, "doc_id")) == sorted(x[0] for x in brute_contamination(rows, items) if not x[5])


def test_contamination_empty(spark):
    rows, df = docs(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(x[0] for x in got(decontaminate.contamination(df, none), "contaminated"))
    assert decontaminate.contamination(empty(spark), none).count() == 0


# ----------------------------------------------------------------------------------------------------- suffix dedup


def brute_removal(rows):
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_suffix_removal(spark, seed):
    r = random.Random(seed)
    rnd = lambda n: "".join(r.choice("abcdefghij klmnopé") for _ in range(n))
    passages = [rnd(r.randrange(90, 400)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a" * 400), (3, "é" * 130)]
    while len(rows) < 70:
        t = rows[-1][1] if r.random() < 0.1 else "".join(r.choice(passages) if r.random() < 0.5 else rnd(r.randrange(150)) for _ in range(r.randrange(1, 6)))
        rows.append((len(rows), t))
    df = table(spark, rows, "doc_id long, text string")
    assert got(suffixes.removal(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removal(rows)


@pytest.mark.parametrize("hot", [2, 40, 1024])
def test_suffix_passage_in_many_shards(spark, monkeypatch, hot):
    """A passage that most documents share, in shards of a few documents, at anchors that are hot and that are not; ids
    are strings."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    r = random.Random(7)
    rnd = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage, rows = rnd(400), []
    for i in range(120):
        rows.append((f"d{i:03}", (rnd(r.randrange(150)) + passage[r.randrange(0, 50, 25) :] + rnd(r.randrange(150)) if i % 3 else rnd(300)) if i % 11 else rows[-1][1] if rows else passage))
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(8)
    assert got(suffixes.removal(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removal(rows)


def test_suffix_cases(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    rows = [(1, text), (1, text), (None, text), (0, text[50:]), (2, "short")]
    out = got(suffixes.removal(table(spark, rows, "doc_id long, text string")), "doc_id", "n_removed")
    assert out == sorted([(0, 0), (1, 250), (1, 300), (None, 300), (2, 0)], key=repr)
    clean = suffixes.cleaned(table(spark, [(i, t, len(t)) for i, t in rows if i is not None], "doc_id long, text string, n_chars long"))
    assert all(x["n_chars"] == len(x["text"]) and x["text"] for x in clean.collect())
    assert suffixes.removal(empty(spark)).count() == 0


def test_suffix_array_parts():
    r = np.random.default_rng(0)
    text = r.integers(97, 99, 5000).astype(np.uint8)
    text[3000:3400] = text[100:500]
    at = np.arange(len(text) - 100)
    order = suffixes.suffix_order(text, at)
    raw = text.tobytes()
    assert [raw[i : i + 100] for i in order] == sorted(raw[i : i + 100] for i in at)
    shared = suffixes.common_prefixes(text, order)
    for k in range(1, len(order), 37):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == n
    lost = np.zeros(6, bool)
    keys = lambda *x: np.array(x, "S2")
    merged, owners = suffixes.merged([(keys(b"a", b"c"), np.array([0, 3])), (keys(b"a", b"b"), np.array([2, 1])), (keys(b"c", b"d"), np.array([4, 5]))], lost)
    assert merged.tolist() == [b"a", b"b", b"c", b"d"] and lost.tolist() == [False, False, True, False, True, False] and owners.tolist() == [0, 1, 3, 5]


# ---------------------------------------------------------------------------------------------------------- quality


def brute_quality(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


@pytest.mark.parametrize("seed", [0, 1])
def test_quality_base(spark, seed):
    rows, df = docs(spark, seed)
    out = got(quality.judged(df), "doc_id", *quality.BASE, "base_failed")
    assert out == sorted(((r[0], *brute_quality(r[1])) for r in rows), key=repr)
    kept = Counter(got(quality.judged(df).where("kept"), "doc_id"))
    again = quality.filtered(df)
    assert again.columns == df.columns and Counter(got(again, "doc_id")) == kept
    assert quality.judged(empty(spark)).count() == 0 and quality.filtered(empty(spark)).count() == 0


def test_quality_verdicts(spark):
    r = random.Random(3)
    prose = lambda: " ".join(f"{r.choice('abcdefg')}{r.randrange(99)}word" for _ in range(80)) + "."
    good = [prose() for _ in range(300)]
    bad = [" | ".join(prose().split()) for _ in range(30)] + [prose().upper().replace(" ", "!! ") for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.judged(df).where("kept").collect()}
    assert kept == set(range(300))
    post = quality.fit({"++++++++": 1000, "-+++++++": 80, "++++++-+": 1})
    assert post["++++++++"] > 0.5 > post["-+++++++"] and quality.fit({}) == {}


@pytest.mark.parametrize("bad", [250, 300, 330, 400, 500])
@pytest.mark.parametrize("kinds", [["-+++++++"], ["-++++-++"], ["-+++++++", "+-++++++", "+++++-++"]])
def test_quality_of_skewed_votes(bad, kinds):
    counts = {"++++++++": 800 - bad, "+++0++++": 199, "++++++-+": 1} | {k: bad // len(kinds) for k in kinds}
    post = quality.fit(counts)
    assert {p for p, x in post.items() if x >= 0.5} == {"++++++++", "+++0++++", "++++++-+"}


def test_quality_among_short_rows(spark):
    r = random.Random(8)
    prose = lambda n=80: " ".join(f"{r.choice('abcdefg')}{r.randrange(99)}word" for _ in range(n)) + "."
    rows = [prose() for _ in range(100)] + [prose(5) for _ in range(80)] + [" | ".join(prose().split()) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["doc_id"] for r in quality.judged(df).where("kept").collect()} == set(range(100)) == {r["doc_id"] for r in quality.filtered(df).collect()}


# ----------------------------------------------------------------------------------------------------------- mixing


def brute_mix(rows, weights=(5, 2, 1), cap=3):
    size = {i: len(SPACED.findall(t or "")) for i, t in enumerate(r[1] for r in rows)}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    have = {s: sum(size[i] for i, r in enumerate(rows) if r[3] == s) for s in sources}
    w = {s: weights[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(have.values()))
    while free:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > cap * have[s]}
        if not over:
            break
        for s in over:
            target[s] = float(cap * have[s])
        left -= sum(target[s] for s in over)
        free -= over
    for s in free:
        target[s] = left * w[s] / sum(w[x] for x in free)
    return size, have, target


def test_mix(spark):
    rows, df = docs(spark, repeat=False)
    size, have, target = brute_mix(rows)
    out = {r["doc_id"]: r for r in mixing.mix_table(df).collect()}
    taken = Counter()
    for i, r in enumerate(rows):
        x = out[r[0]]
        assert (x["size"], x["source_size"]) == (size[i], have[r[3]]) and math.isclose(x["target"], target[r[3]], rel_tol=1e-9)
        assert x["taken"] % max(1, x["size"]) == 0 and x["taken"] <= 3 * x["size"]
        taken[r[3]] += x["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(size[i] for i, r in enumerate(rows) if r[3] == s)
    assert got(mixing.mix_table(df), "doc_id", "taken") == got(mixing.mix_table(df.repartition(5)), "doc_id", "taken")
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    assert all(x["taken"] == mixed.get(i, 0) * x["size"] for i, x in out.items())


def test_mix_caps_ties_and_empty(spark):
    rows = [(i, "w " * (1 if i % 3 else 90), "en", "a" if i % 3 else "b", 0) for i in range(30)] + [(99, "w " * 5, "en", "c", 0)] * 4 + [(None, "w", "en", None, 0)]
    size, have, target = brute_mix(rows)
    assert any(target[s] == 3 * have[s] for s in have)
    out = mixing.mix_table(table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert out.count() == len(rows) and {math.isclose(r["target"], target[{have[s]: s for s in have}[r["source_size"]]]) for r in out.collect()} == {True}
    assert mixing.mix_table(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    zero = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", "b", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(mixing.mix_table(zero), "size", "taken", "target") == [(0, 0, 0.0)] * 2


# ------------------------------------------------------------------------------------------------------- tool calls


def test_tool_calls(spark):
    calls = [("a", None, "add", '{"y": 2, "x": 1}'), ("b", "a", "add", '{"x": "no"}'), ("c", "b", "say", "{broken"), ("d", "zz", "say", '{"t": "é\\n"}'), ("e", "f", "say", "{}"), ("f", "e", "say", "{}"), ("a", None, "add", '{"y": 2, "x": 1}')]
    results = [("a", "3"), ("b", None), ("zz", "lost"), ("a", "3")]
    schemas = {"add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "integer", "minimum": 0}, "y": {"type": "integer"}}}, None: {"type": "object", "required": ["t"], "properties": {"t": {"type": "string", "minLength": 2}}}}
    out = {r["id"]: r for r in toolcalls.link(spark.createDataFrame(calls, "id string, parent string, name string, arguments string"), spark.createDataFrame(results, "id string, content string"), schemas).collect()}
    assert {k: r["depth"] for k, r in out.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "zz": None}
    assert {k: r["status"] for k, r in out.items()} == {"a": "linked", "b": "linked", "c": "unanswered", "d": "unanswered", "e": "unanswered", "f": "unanswered", "zz": "orphan"}
    assert out["a"]["canonical_json"] == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"3"}' and out["a"]["n_repeats"] == 2
    assert out["a"]["valid"] and out["d"]["valid"] and out["b"]["errors"] == "$.x: type; $.y: required" and out["c"]["errors"] == "$: json"
    assert json.loads(out["d"]["canonical_json"])["arguments"] == {"t": "é\n"}


def test_tool_call_conflicts(spark):
    """Equal rows fold; different calls or answers of one identifier are all told, and linked to nothing."""
    calls = [("a", None, "f", "{}"), ("a", None, "g", "{}"), ("a", None, "g", "{}"), ("b", "a", "f", '{"x": "' + "y" * 200_000 + '"}'), ("c", None, "f", "{}")]
    results = [("a", "1"), ("b", "2"), ("c", "3"), ("c", "4"), ("c", "4"), ("d", "5"), ("d", "6")]
    out = toolcalls.link(spark.createDataFrame(calls, "id string, parent string, name string, arguments string"), spark.createDataFrame(results, "id string, content string"), {}).collect()
    told = sorted((r["id"], r["status"], r["name"] or "", r["n_repeats"], json.loads(r["canonical_json"])["result"] or "") for r in out)
    assert told == [("a", "conflict", "", 1, "1"), ("a", "conflict", "f", 1, ""), ("a", "conflict", "g", 2, ""), ("b", "linked", "f", 1, "2"), ("c", "conflict", "", 1, "3"), ("c", "conflict", "", 2, "4"), ("c", "conflict", "f", 1, ""), ("d", "conflict", "", 1, "5"), ("d", "conflict", "", 1, "6")]
    assert next(r for r in out if r["id"] == "b")["depth"] == 1


def test_schema_keywords(spark):
    rows = ['{"k": true}', '{"k": "true"}', '{"k": 1}', '{"k": 1.0}', '{"k": "1"}', '{"k": 12345678901234567890}', '{"k": 1.5}', '{"k": null}', "{}"]
    df = spark.createDataFrame([(x,) for x in rows], "j string")
    errors = lambda rule, **more: [r[0] for r in df.select(F.array_join(toolcalls.violations(F.col("j"), {"type": "object", "properties": {"k": rule}} | more), ";")).collect()]
    bad = "$.k: enum"
    assert errors({"enum": [True, 1]}) == ["", bad, "", "", bad, bad, bad, bad, ""]
    assert errors({"enum": ["1", None]})[2:5] == [bad, bad, ""] and errors({"enum": ["1", None]})[7:] == ["", ""]
    assert errors({"type": "integer"}) == ["$.k: type", "$.k: type", "", "", "$.k: type", "", "$.k: type", "$.k: type", ""]
    assert errors({}, required=["k", "z"])[-1] == "$.k: required;$.z: required"
    for rule in ({"pattern": "x"}, {"type": ["string", "null"]}, {"enum": [[1]]}, {"type": "object", "additionalProperties": False}):
        with pytest.raises(ValueError):
            toolcalls.violations(F.col("j"), {"type": "object", "properties": {"k": rule}})


def test_turns(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(9)] + [(1, 2, "user", "t2"), (2, 0, "assistant", "x"), (2, 4, "user", ""), (2, 6, "user", None), (3, None, "user", "n"), (None, 1, None, None), (4, 0, None, 'q"\\\n')]
    out = toolcalls.turns(table(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    by = {r["id"]: r for r in out if r["id"]}
    assert by["1:6"]["depth"] == 3 and by["1:6"]["status"] == "linked" and by["1:2"]["n_repeats"] == 2 and by["1:8"]["status"] == "unanswered"
    assert by["2:-1"]["status"] == "orphan" and by["2:4"]["errors"] == "$.text: minLength" and by["2:6"]["errors"] == "$.text: type" and by["2:6"]["depth"] == 1
    assert sum(r["status"] == "no_id" for r in out) == 2 and json.loads(by["4:0"]["canonical_json"])["arguments"]["text"] == 'q"\\\n'
    assert toolcalls.turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --------------------------------------------------------------------------------------------------------- licences


def test_licences(spark):
    words = lambda t: re.findall("[a-z0-9]+", t.translate(LOWER))
    grams = lambda t: set(zip(words(t), words(t)[1:], strict=False))
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 100)
    rows = [(1, "Code.\nReleased under the MIT license!\nBye"), (2, mit), (3, mit.replace(", ", ",\n")), (4, None), (5, ""), (6, "Licensed"), (7, "licensed under the apache license version 2.0"), (8, "nothing to see here at all " * 999), (1, "Code.\nReleased under the MIT license!\nBye")]

    def best(t):
        parts = (t or "").split("\n")
        found, n = [], 0
        for p in parts + ([t] if len(parts) > 1 else []):
            of = [(-2 * len(grams(p) & grams(x)) / (len(grams(p)) + len(grams(x))), name) for name, x in licences.TEMPLATES if grams(p)]
            of = [x for x in of if x[0] <= -0.8]
            n, found = n + bool(of), found + of
        pairs = list(zip(words(t or ""), words(t or "")[1:], strict=False))
        for name, x in licences.TEMPLATES:
            for i, pair in enumerate(pairs):
                if pair in grams(x) and len(pairs) < 5000:
                    run = set(pairs[i : i + len(words(x)) - 1])
                    found += [(d, name) for d in [-2 * len(run & grams(x)) / (len(run) + len(grams(x)))] if d <= -0.8]
        return (min(found)[1], -min(found)[0], n) if found else (None, 0.0, 0)

    out = got(licences.scanned(table(spark, rows, "doc_id long, text string")), "doc_id", "licence", "dice", "n_passages")
    assert out == sorted(((i, *best(t)) for i, t in rows), key=repr) and {x[1] for x in out} == {"MIT", "Apache-2.0", None}
    assert licences.scanned(table(spark, [(None, "Released under the MIT License.")], "doc_id long, text string")).first()["licence"] == "MIT"
    assert licences.scanned(empty(spark)).count() == 0


@pytest.mark.parametrize("licence", ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib"])
def test_licence_wrapped_in_code(spark, licence):
    import textwrap

    text = max((x for name, x in licences.TEMPLATES if name == licence), key=len)
    code = "\n".join(f"    x{i} = f(y{i * 7 % 11}, {i}) if z else g_{i}(w)" for i in range(60))
    notice = "\n".join("# " + x for x in textwrap.wrap(f"Copyright 2020 A. Nobody {text}", 70))
    rows = [(1, f"{notice}\n{code}"), (2, f"{code}\n{notice}\n{code}"), (3, code)]
    out = {r["doc_id"]: (r["licence"], r["dice"]) for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1][0] == out[2][0] == licence and out[1][1] > 0.95 and out[3] == (None, 0.0)


# ------------------------------------------------------------------------------------------------------ LM scoring


def test_lm_base(spark):
    rows, df = docs(spark)
    out = lm.scored(df, rates=(0.01,)).collect()
    split = [(i, SPACED.findall((t or "").translate(LOWER)) + [None]) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, x in split if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((i, held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in x), 6)) for i, x in split)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lm.scored(empty(spark), rates=(0.01,)).count() == 0


def test_lm_null_ids(spark):
    df = table(spark, [(None, "a b"), (None, None), (2, ""), (9, "a")], "doc_id long, text string")
    out = lm.scored(df, rates=()).collect()
    assert {(r["doc_id"], r["n_tokens"], r["train_tokens"]) for r in out if r["doc_id"] is None} == {(None, 3, out[0]["train_tokens"]), (None, 1, out[0]["train_tokens"])}
    assert not any(r["held_out"] for r in out if r["doc_id"] is None)


def subwords_of():
    with open(lm.VOCABULARY, "rb") as f:
        return lm.Subwords(f.read())


def slow_probabilities(net, ids):
    """Of the subwords of one text, one at a time."""
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    p, s, out = net.p, lm.STRIDE, []
    inputs = [0, *net.inputs[ids[:-1]]]
    for i, token in enumerate(ids):
        context = range(max(0, i // s * s - s), i + 1)
        weights = softmax(np.array([p["q"][inputs[i]] @ p["k"][inputs[j]] + p["near"][i - j] for j in context]))
        mixed = sum(w * p["v"][inputs[j]] for w, j in zip(weights, context, strict=True))
        hidden = np.append(np.maximum(p["e"][inputs[i]] @ p["we"] + mixed @ p["wa"] + p["b"], 0), 1)
        group, member = divmod(net.classes[token], lm.MEMBERS)
        out.append(math.log(softmax(hidden @ p["u"])[group]) + math.log(softmax(hidden @ p["u2"][group])[member]) + net.share[token])
    return np.array(out)


def test_lm_subwords():
    subwords = subwords_of()
    long = "a" * 300 + "é" * 100
    block = Block(["Hello  wide world".encode(), b"", f"{long} b".encode(), "caf\u00a0é \ufffd".encode()])
    at, owners, ids, of = lm.sequence(block, lm.Words.of(block, subwords))
    assert owners.tolist() == [0, 0, 0, 0, 1, 2, 2, 2, 3, 3, 3] and (ids == subwords.end).sum() == 4
    assert (np.diff(of) >= 0).all() and set(of.tolist()) == set(range(len(owners)))
    last = np.append(of[1:] != of[:-1], True) & (ids != subwords.end)
    assert ((ids[ids != subwords.end] % 2 == 1) == last[ids != subwords.end]).all()  # a word's last subword, and no other, says so
    lengths = subwords._bytes[ids[of == 5] // 2].sum()
    assert lengths == len(long.encode())


def test_lm_probabilities_and_gradients():
    net = lm.Attention(5000)
    r = np.random.default_rng(0)
    ids, owners = r.integers(0, 5000, 400) * r.integers(0, 2, 400), np.repeat([0, 1, 2, 5], [130, 1, 69, 200])
    net.learn_ids(np.bincount(ids, minlength=5000))
    net.p["near"][:] = r.standard_normal(2 * lm.STRIDE)
    net.load(net.flat())
    assert np.allclose(np.bincount(net.classes, np.exp(net.share))[np.unique(net.classes)], 1)
    slow = np.concatenate([slow_probabilities(net, ids[owners == k]) for k in (0, 1, 2, 5)])
    assert np.allclose(net.log_probabilities(ids, owners), slow, atol=1e-3)
    x, of, at = net.windows(ids, owners)
    goal = np.full(len(x) - lm.STRIDE, -1)
    goal[at] = net.classes[ids]
    view = lambda a: np.lib.stride_tricks.sliding_window_view(a, 2 * lm.STRIDE)[:: lm.STRIDE]
    case = view(x), view(of), goal.reshape(-1, lm.STRIDE)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    loss, g = net.gradients(*case)
    assert math.isclose(loss, -np.mean(slow - net.share[ids]), rel_tol=1e-3)
    for k in net.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep, sides = net.p[k][i], []
        for step in (1e-4, -1e-4):
            net.p[k][i] = keep + step
            sides.append(net.gradients(*case)[0])
        net.p[k][i] = keep
        assert math.isclose(g[k][i], (sides[0] - sides[1]) / 2e-4, rel_tol=2e-2, abs_tol=1e-5), k


def test_lm_score(spark, monkeypatch):
    """The score against the mixture, word by word, of a model that the test knows."""
    subwords = subwords_of()
    net = lm.Attention(subwords.size, seed=3)
    counts_seen = []

    def known(rows, counts, rates):
        counts_seen.append(counts)
        net.learn_ids(counts)
        return net

    monkeypatch.setattr(lm, "trained", known)
    rows, df = docs(spark, 1)
    rows = [(i, "word " * 90 if t and len(t) > 5000 else t, *x) for i, t, *x in rows]
    df = table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = lm.scored(df).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    split = [(i, SPACED.findall((t or "").translate(LOWER)) + [None]) for i, t, *_ in rows]

    def ids_of(word):
        if word is None:
            return [subwords.end]
        raw = np.frombuffer(word.encode() + b" ", np.uint8)
        return subwords.encode(raw, np.array([len(raw) - 1]))[1].tolist()

    c = Counter(w for i, x in split if not held(i) for w in x)
    begins = Counter()
    every = Counter()
    for w, n in c.items():
        begins[ids_of(w)[0]] += n
        for k in ids_of(w):
            every[k] += n
    assert all(counts_seen[0][k] == n for k, n in every.items()) and counts_seen[0].sum() == sum(every.values())
    n, v = sum(c.values()), len(c)
    want = []
    for i, x in split:
        lists = [ids_of(w) for w in x]
        p, at, score = slow_probabilities(net, np.array([k for y in lists for k in y])), 0, 0.0
        for w, y in zip(x, lists, strict=True):
            spelled, whole = p[at : at + len(y)].sum(), p[at]
            total = v / (n + v) * math.exp(spelled) + (n / (n + v) * math.exp(whole) * c[w] / begins[y[0]] if c[w] else 0)
            score, at = score + math.log10(total), at + len(y)
        want.append((i, score))
    assert np.allclose(sorted(want), sorted((r["doc_id"], r["score"]) for r in out), rtol=1e-3, atol=1e-2)


def test_lm_learns(spark):
    r = random.Random(0)
    texts_ = [" ".join(r.choice(["tick tock", "ding dong"]) for _ in range(60)).encode() for _ in range(60)]
    subwords = subwords_of()

    def ids_of(some):
        block = Block(some)
        _, owners, ids, of = lm.sequence(block, lm.Words.of(block, subwords))
        return ids, owners[of]

    ids, owners = ids_of(texts_[10:])
    rows = spark.createDataFrame([(int(k), bytearray(ids[owners == k].astype(np.int32).tobytes())) for k in range(50)], "key long, ids binary").repartition(3)
    counts = np.bincount(ids, minlength=subwords.size)
    before, after = (lm.trained(rows, counts, rates).log_probabilities(*ids_of(texts_[:10])).mean() for rates in ((), (0.03, 0.01)))
    assert after > before + 0.3


# ---------------------------------------------------------------------------------------------------------- SimHash


def brute_simhash(text):
    w = SPACED.findall((text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    count = Counter(h)
    return sum(1 << b for b in range(64) if 2 * sum(n for x, n in count.items() if x >> b & 1) > len(h))


def test_simhash(spark):
    rows, df = docs(spark, 4)
    fp = {i: brute_simhash(t) for i, t, *_ in rows}
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fp:
        for j in fp:
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    out = simhash.linked(df).select("doc_id", simhash.hex64("fp").alias("f"), "component_id")
    assert got(out, "doc_id", "f", "component_id") == sorted(((r[0], f"{fp[r[0]]:016x}", root(r[0])) for r in rows), key=repr)
    assert simhash.linked(empty(spark)).count() == 0


def test_simhash_nulls(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "only nulls here now"), (7, None)], "doc_id long, text string")
    out = {(r["doc_id"], r["component_id"]) for r in simhash.linked(df).collect()}
    assert out == {(None, 5), (5, 5), (None, None), (7, 7)}


def test_xxh64_lengths():
    raw = bytes(range(256)) * 4
    data = np.frombuffer(raw, np.uint8)
    starts = np.repeat(np.arange(40), 100)
    lengths = np.tile(np.arange(100), 40)
    want = [xxhash.xxh64_intdigest(raw[a : a + n], 42) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    assert simhash.xxh64(data, starts, lengths).tolist() == want


def test_majority_of_long_texts():
    h = np.random.default_rng(0).integers(0, 1 << 63, 200_000, dtype=np.int64).view(np.uint64)
    n = np.array([0, 150_000, 1, 49_999])
    out, at = simhash.majority(h, n), 0
    for k, f in zip(n.tolist(), out.tolist(), strict=True):
        bits = ((h[at : at + k, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
        assert f == sum(1 << b for b in range(64) if 2 * int(bits[b]) > k)
        at += k


def test_ball_links_are_whole(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(4)} | set(base)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.ball_links(spark.createDataFrame(signed, "fp long"))
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    for a, in signed:
        for b, in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and a != b:
                assert roots[a] == roots[b]


def brute_shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_planted(spark):
    import corpus_pipeline

    r = random.Random(11)
    words = lambda n: [f"{r.choice('bcdfgklm')}{r.randrange(10_000)}" for _ in range(n)]
    rows, copies, expected = [], {}, 0.0
    for n, changed in ((100, 1), (100, 2), (300, 2), (300, 5), (1000, 5), (1000, 20)) * 10:
        first = words(n)
        second = list(first)
        for i in range(changed):
            second[(2 * i + 1) * n // (2 * changed)] = "other"
        assert 0.8 <= jaccard(" ".join(first), " ".join(second)) < 0.96
        expected += simhash.meeting(jaccard(" ".join(first), " ".join(second)))
        copies[len(rows) + 1] = len(rows)
        rows += [" ".join(first), " ".join(second)]
    far = words(200)
    rows += [" ".join(far), " ".join(far[:150] + words(50))]  # about 0.6: both stay
    df = table(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    left = {x[0] for x in got(kept, "doc_id")}
    assert kept.columns == df.columns and left >= set(range(len(rows))) - set(copies)
    # As many as the formula says, which is nearly all: within three standard deviations of 60 draws.
    assert 55 < expected < 60 and len(copies) - len(left & set(copies)) >= expected - 3 * math.sqrt(60 - expected)
    assert simhash.meeting(0.8) > 0.9 and simhash.meeting(0.85) > 0.98 and simhash.meeting(0.9) > 0.999


def test_near_copies_brute(spark):
    rows, df = docs(spark, 4)
    text = {i: t for i, t, *_ in rows}
    root = {i: i for i in text}
    for i in text:
        for j in text:
            if root[i] != root[j] and jaccard(text[i], text[j]) >= 0.8:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert sorted(x[0] for x in got(simhash.deduplicated(df), "doc_id")) == sorted(set(root.values()))
    assert simhash.deduplicated(empty(spark)).count() == 0


# --------------------------------------------------------------------------------------------------------- toxicity


def toxic_rows(n=400, seed=0):
    r = random.Random(seed)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(5, 80))]
        bad = i % 5 == 0
        for _ in range(r.randrange(1, 4)) if bad else ():
            words.insert(r.randrange(len(words)), r.choice(["scummy", "vilefoo", "vilebar", "vilebaz"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    rows += [(1000, None), (1001, ""), (1002, "x " * 40_000 + "scummy"), (None, "vilefoo"), rows[0]]
    lab = table(spark, labels + [(5, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(table(spark, rows, "doc_id long, text string"), lab).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    right = [(r["predicted"] == (r["doc_id"] % 5 == 0)) for r in out if r["held_out"] and r["doc_id"] < 400]
    assert sum(right) / len(right) > 0.95
    text = {i: t for i, t in rows}
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < 400 and r["predicted"]:
            assert any(text[r["doc_id"]].encode()[s["start"] : s["end"]].startswith((b"vile", b"scum")) for s in r["spans"])


def test_toxicity_without_labels(spark):
    rows, _ = toxic_rows(20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.scored(df, none).collect()} == {0.0}
    assert toxicity.scored(df.limit(0), none).count() == 0


def test_toxicity_of_one_class(spark):
    rows, _ = toxic_rows(20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for toxic in (0, 1):
        labels = spark.createDataFrame([(i, 1, toxic) for i in range(20)], "doc_id long, quality int, toxic int")
        assert {r["predicted"] for r in toxicity.scored(df, labels).collect()} == {toxic}


def test_toxicity_by_context(spark):
    """A word that is toxic alone and harmless after ``not``; repeated ids are fitted by their least text."""
    r = random.Random(3)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(plain) for _ in range(r.randrange(10, 60))]
        kind = i % 9
        for _ in range(2) if kind < 2 else ():
            words[r.randrange(len(words)) : 0] = ["vilefoo"] if kind == 0 else ["not", "vilefoo"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind == 0)))
    rows += [(5, "vilefoo vilefoo vilefoo"), (11, "zz vilefoo")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.scored(df, lab).collect()
    right = [r["predicted"] == (r["doc_id"] % 9 == 0) for r in out if r["held_out"] and r["doc_id"] not in (5, 11)]
    assert sum(right) / len(right) > 0.97
    negated = [r for r in out if r["doc_id"] % 9 == 1]
    assert sum(bool(r["spans"]) for r in negated) / len(negated) < 0.1
    again = toxicity.scored(df.repartition(7), lab).collect()
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in out) == sorted((r["doc_id"], round(r["score"], 9)) for r in again)


def test_field_against_enumeration():
    r = np.random.default_rng(0)
    field = toxicity.Field(r.normal(size=toxicity.WEIGHTS))
    counts = np.array([6, 3, 0, 4, 1, 5])
    owner, place = np.array([0, 0, 3, 3, 4, 5]), np.array([1, 4, 0, 1, 0, 3])
    codes = toxicity.Field.codes(r.uniform(1, 6, 6), r.integers(-1, 2, 6), r.integers(-1, 2, 6))
    shape = toxicity.Field.shape(owner, place, counts)
    z, p = field.forward(codes, shape, counts)[0][0], field.marginals(codes, shape, counts)[0]
    labels = np.array([1, 0, 1, 1, 0, 1.0])
    w, pair = field.weights, np.array([0, *field.weights[-3:]]).reshape(2, 2)
    said = 0.0
    for text, n in enumerate(counts.tolist()):
        at = np.flatnonzero(owner == text)
        of_word = np.full(n, w[toxicity.UNARY + 4])
        of_word[place[at]] = codes[at] @ w[: toxicity.UNARY + 4]
        total, marginal = 0.0, np.zeros(n)
        for k in range(2**n):
            y = np.array([k >> i & 1 for i in range(n)], int)
            e = math.exp(y @ of_word + sum(pair[a, b] for a, b in zip(y, y[1:])))
            total, marginal = total + e, marginal + e * y
        assert math.isclose(z[text], math.log(total), abs_tol=1e-9) and np.allclose(p[at], (marginal / total)[place[at]])
        y = np.zeros(n, int)
        y[place[at]] = labels[at]
        said += y @ of_word + sum(pair[a, b] for a, b in zip(y, y[1:]))
    assert math.isclose(field.score(codes, labels, shape)[0], said)
    before = (field.score(codes, labels, shape) - field.forward(codes, shape, counts)[0].sum(1))[0]
    field.fit(codes, labels, shape, counts, steps=10)
    assert (field.score(codes, labels, shape) - field.forward(codes, shape, counts)[0].sum(1))[0] > before


def test_spans_bridge():
    """Words between two toxic ones are in the span when toxic words come in rows, by enumeration."""
    w = np.zeros(toxicity.WEIGHTS)
    w[0], w[toxicity.UNARY + 4], w[-3:] = 4, 0.2, (-3, -3, 0)
    field, counts = toxicity.Field(w), np.array([5])
    owner, place = np.array([0, 0]), np.array([0, 3])
    codes = toxicity.Field.codes(np.array([1.2, 1.2]), np.zeros(2), np.zeros(2))
    p, inside = field.marginals(codes, toxicity.Field.shape(owner, place, counts), counts)
    total, marginal = 0.0, np.zeros(5)
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        e = math.exp(sum(4 * y[i] for i in (0, 3)) + 0.2 * sum(y[i] for i in (1, 2, 4)) - 3 * sum(a != b for a, b in zip(y, y[1:])))
        total, marginal = total + e, marginal + e * np.array(y)
    assert np.allclose(p, (marginal / total)[[0, 3]]) and math.isclose(inside[1], (marginal / total)[1:3].min(), rel_tol=1e-9)


# --------------------------------------------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    prose = lambda n=120: " ".join(f"{r.choice('bcdfgklm')}{r.choice('aeiou')}{r.randrange(10_000)}x" for _ in range(n)) + "."
    shared = prose(60)
    good = [prose() for _ in range(40)]
    bench = [prose(40) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100, good[3]), (101, " | ".join(prose().split())), (102, "short"), (103, None), (104, shared + " " + prose()), (105, prose() + " " + shared), (106, bench[0] + " " + prose(20)), (107, "from " * 300)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x") for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        assert out.columns[: len(docs_.columns)] == docs_.columns or name == "source mix"
        docs_ = spark.read.parquet(path)
        seen[name] = {x["doc_id"]: x["text"] for x in docs_.collect()}
    assert set(seen["quality rules"]) == set(range(40)) | {100, 104, 105, 106}
    assert set(seen["near duplicates"]) == set(range(40)) | {104, 105, 106}
    assert seen["suffix dedup"][104].startswith(shared) and shared[:200] not in seen["suffix dedup"][105] and seen["suffix dedup"][0] == good[0]
    assert set(seen["benchmark decontamination"]) == set(range(40)) | {104, 105}
    assert seen["source mix"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["source mix"])


def test_pipeline_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    prose = lambda: " ".join(f"{r.choice('bcdfgklm')}{r.randrange(10_000)}x" for _ in range(80)) + "."
    names = {"copies": "7", "Copies_": "8", "id": "1", "root": "2", "k": "3", "prints": "'p'", "part": "4", "hot": "true", "digest": "'d'", "code": "5"}
    spark.createDataFrame([(i, prose(), "en", "s", 9) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"{v} AS `{k}`" for k, v in (CLASH | names).items()]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert len(rows) == 30 and {r["copies"] for r in rows} == {7} and {r["Copies_"] for r in rows} == {8} and {r["copies__"] for r in rows} == {1}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
