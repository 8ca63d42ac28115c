"""Dictionary lookup by joins against the plain way, keyword by keyword; typo pairs against all pairs."""

import difflib
import random

from cartoflow.operators import typos
from cartoflow.relevance import lookup
from cartoflow.relevance.dictionary import Concept, resolve


def typo(r, text):
    text = list(text)
    for _ in range(r.randrange(4)):
        i = r.randrange(len(text) + 1)
        text[i : i + r.randrange(2)] = r.choice(["", "x", "a", "e"])
    return "".join(text)


def test_typo_pairs(spark):
    r = random.Random(4)
    known = ["a", "ab", "gym", "gyms", "bakery", "bakeries", "dental clinic", "pooja items", "hardware and tools", "aaaaaaaaaa", "abababababab"]
    known += ["".join(r.choice("abcde") for _ in range(r.randrange(1, 24))) for _ in range(150)]
    asked = [typo(r, w) for w in known for _ in range(3)] + ["", "zzz"]
    got = {(x["keyword"], x["entry"]): x["likeness"] for x in typos.typo_pairs(spark.createDataFrame([(k,) for k in [*asked, None]], "keyword string"), spark.createDataFrame([(k,) for k in [*known, None, ""]], "entry string")).collect()}
    want = {}
    for a in set(asked):
        for b in set(known):
            if a and b and abs(len(a) - len(b)) <= 4 and (s := difflib.SequenceMatcher(None, a, b).ratio()) >= 0.78:
                want[a, b] = s
    assert got == want and len(want) > 300
    wide = {(x["a"], x["b"]) for x in typos.meeting(spark.createDataFrame([(k,) for k in asked], "a string"), spark.createDataFrame([(k,) for k in known], "b string"), 0.7).collect()}
    assert {(a, b) for a in set(asked) for b in known if a and difflib.SequenceMatcher(None, a, b).ratio() >= 0.7} <= wide


def test_resolved(spark):
    r = random.Random(5)
    nouns = ["gym", "bakery", "dental clinic", "pooja store", "hardware", "shoe store", "beauty salon", "pharmacy", "hotel", "book store"]
    concepts = []
    for n, noun in enumerate(nouns):
        strong = (noun, f"{noun} shop", f"best {noun} in town")
        concepts.append(Concept(noun.replace(" ", "_"), labels=(f"{noun}s", "place of goods"), strong=strong, defining=(f"{noun.replace(' ', '_')}_supply", f"cat{n % 3}-x")))
    words = [*nouns, "Gyms", " Bakeries ", "Best  Bakery in town", "town best bakery in", "place of goods", "goods of place", "cat1 here", "nothing at all", "", "supply", "dental_clinic"]
    words += [typo(r, f"{w} shop") for w in nouns for _ in range(3)] + [typo(r, w) for w in nouns for _ in range(3)]
    table = spark.createDataFrame([(i, c.concept_id, list(c.labels), list(c.strong), list(c.defining)) for i, c in enumerate(concepts)], "position int, concept_id string, labels array<string>, strong array<string>, defining array<string>")
    got = {x["keyword"]: (x["concept_id"], x["confidence"], x["way"]) for x in lookup.resolved(spark.createDataFrame([(w,) for w in [*words, words[0], None]], "keyword string"), table).collect()}
    want = {w: resolve(w, concepts) for w in words}
    assert got == want
    assert {way for _, _, way in want.values()} == {"exact", "alias", "fuzzy", "tokens", "taxonomy", "unresolved"}
