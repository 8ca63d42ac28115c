"""Text normalisation and small text measures, as Column builders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Company words that say nothing of a business.
COMPANY_WORDS = ("pvt", "ltd", "private", "limited", "llp", "inc", "co", "corp", "enterprises", "traders")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition: there is no built-in; rows of ASCII need not come here."""
    return text.str.normalize("NFKC")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sanitized(text: Column) -> Column:
    """Lower-case words: joiners go, all but word characters (underscores too) and white space become blanks."""
    text = F.regexp_replace(text, "[­​-‏﻿]", "")
    return F.lower(collapsed(F.regexp_replace(text, r"(?U)[^\w\s]", " ")))


def with_latin(text: Column, latin: Column) -> Column:
    """A text of another script followed by its transliteration, where there is one (see ``transliterated``)."""
    return F.when(latin.isNotNull() & (latin != text), F.concat_ws(" ", text, latin)).otherwise(text)


#: First code point of each block of an Indic script; blocks are laid out alike, 128 code points each.
INDIC_BLOCKS = {"devanagari": 0x0900, "tamil": 0x0B80, "telugu": 0x0C00, "kannada": 0x0C80, "malayalam": 0x0D00}
# Latin letters by the offset within a block.
_VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0F: "e", 0x10: "ai", 0x13: "o", 0x14: "au"}
_CONSONANTS = {0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "c", 0x1B: "ch", 0x1C: "j", 0x1D: "jh", 0x1E: "ny", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x32: "l", 0x33: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h"}
_SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x47: "e", 0x48: "ai", 0x4B: "o", 0x4C: "au"}


@F.pandas_udf(T.StringType())
def transliterated(text: pd.Series) -> pd.Series:
    """Latin letters of Indic text by the block of its first Indic letter; null where there is none."""

    def one(value: str | None) -> str | None:
        base = next((b for c in value or "" for b in INDIC_BLOCKS.values() if b <= ord(c) < b + 128), None)
        if base is None:
            return None
        out = []
        for c in value:
            k = ord(c) - base
            if k in _SIGNS or k == 0x4D:
                if out and out[-1] == "a":
                    out.pop()
                out.append(_SIGNS.get(k, ""))
            elif k in _CONSONANTS:
                out += [_CONSONANTS[k], "a"]
            elif k in _VOWELS:
                out.append(_VOWELS[k])
            else:
                out.append("" if 0 <= k < 128 else c)
        return "".join(out)

    return text.map(one, na_action=None)


def business_name(name: Column) -> Column:
    words = "|".join(COMPANY_WORDS)
    return collapsed(F.regexp_replace(F.regexp_replace(F.lower(name), rf"\b({words})\b", ""), r"[^\w\s]", " "))


# Letters with marks and the letters below them.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def taxonomy_text(text: Column) -> Column:
    """ASCII letters: marks are stripped, other letters go, all but words, blanks and hyphens become blanks."""
    plain = F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"[^\x00-\x7F]", "")
    return F.lower(collapsed(F.regexp_replace(plain, r"[^\w\s-]", " ")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; a shorter text is its own."""
    text = F.lower(F.trim(text))
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3))))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) < 3, F.array(text)).otherwise(many)


def trigram_jaccard(a: Column, b: Column) -> Column:
    a, b = trigrams(a), trigrams(b)
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def lexical_score(name: Column, strong: list[str], supporting: list[str], labels: list[str]) -> Column:
    """Strong terms 1.0, of several words 1.2; supporting .35 and .5; the best label's trigram likeness times .4; halved,
    one at most."""
    tokens = words(name)
    score = F.lit(0.0)
    for terms, one, many in ((strong, 1.0, 1.2), (supporting, 0.35, 0.5)):
        for term in terms:
            parts = term.split()
            has = F.array_contains(tokens, term) if len(parts) == 1 else F.size(F.array_except(F.array(*map(F.lit, parts)), tokens)) == 0
            score += F.when(has, one if len(parts) == 1 else many).otherwise(0.0)
    if labels:
        best = [trigram_jaccard(name, F.lit(x)) for x in labels]
        score += 0.4 * (F.greatest(*best) if len(best) > 1 else best[0])
    return F.least(F.lit(1.0), score / 2)


def stem(word: Column) -> Column:
    """Plural endings: ies to y; es (but not ses, ches, shes) and s (but not ss) off."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 3), F.concat(F.substr(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("es") & ~word.rlike("(ses|ches|shes)$") & (n > 2), F.substr(word, F.lit(1), n - 2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 1), F.substr(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def grounded(quote: Column, source: Column) -> Column:
    return F.coalesce(source.contains(quote) | F.lower(source).contains(F.lower(quote)), F.lit(False))


def verdict(decision: Column, quote: Column, profile: Column, terms: list[str]) -> Column:
    """An accepting verdict counts only with a quote from the profile that has a valid term; else it is for review."""
    has = F.lit(False)
    for term in terms:
        has |= F.lower(quote).contains(term)
    return F.when(decision == "accepted", F.when(grounded(quote, profile) & F.coalesce(has, F.lit(False)), "accepted").otherwise("review")).when(decision == "rejected", "rejected").otherwise("review")


def simhash64(df, text: str, key: str):
    """Of each key: 64-bit SimHash of the words of three and more letters, by the first 16 hex digits of their MD5.

    Words are counted first, so a key's row count is its distinct words; the 64 votes are sums in one aggregation.
    """
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "<[^>]+>", " "))
    rows = df.select(key, F.explode_outer(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]{3,}"), 0)).alias("_w")).groupBy(key, "_w").agg(F.count("*").alias("_n"))
    rows = rows.withColumn("_h", F.conv(F.substring(F.md5("_w"), 1, 16), 16, -10).cast("long"))
    votes = [F.sum(F.when(F.shiftright("_h", i).bitwiseAND(F.lit(1)) == 1, F.col("_n")).otherwise(-F.col("_n"))).alias(f"_b{i}") for i in range(64)]
    bits = [F.when(F.col(f"_b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(64)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return rows.groupBy(key).agg(*votes).select(key, out.alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def change_band(distance: Column) -> Column:
    return F.when(distance <= 3, "unchanged").when(distance <= 8, "minor").otherwise("substantive")


# What challenge pages say; the first four tell by themselves.
CHALLENGES = ("just a moment", "checking your browser", "cf-browser-verification", "challenge-platform", "captcha", "access denied", "attention required", "unusual traffic")


def bot_challenge(html: Column, status: Column) -> Column:
    """By any of the phrases where the status is 403, 429 or 503; by the first four for any status."""
    head, top = F.substring(html, 1, 3000), F.substring(html, 1, 1500)
    return F.coalesce((status.isin(403, 429, 503) & head.rlike("(?i)" + "|".join(CHALLENGES))) | top.rlike("(?i)" + "|".join(CHALLENGES[:4])), F.lit(False))
