"""What web pages say of a business: structured data, contacts, branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of structured items that are about a business, and networks whose links count.
KINDS = "localbusiness|store|organization|restaurant|place"
NETWORKS = ("facebook.com", "instagram.com", "twitter.com", "linkedin.com", "youtube.com")


def structured(pages: DataFrame, key: str) -> DataFrame:
    """JSON-LD (items of @graph too) and microdata of business kinds: first name and address, all phones and mails."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    rows = pages.select(key, F.posexplode(blocks).alias("at", "json")).withColumn("v", F.try_parse_json("json")).where("v is not null")
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    whole = F.array("v")
    items = F.coalesce(get(F.col("v"), "$['@graph']", "array<variant>"), get(F.col("v"), "$", "array<variant>"), whole)
    rows = rows.select(key, "at", F.posexplode(items).alias("nth", "item"))
    kind = F.lower(F.coalesce(get(F.col("item"), "$['@type']"), get(F.col("item"), "$['@type'][0]"), F.lit("")))
    address = F.coalesce(get(F.col("item"), "$.address.streetAddress"), get(F.col("item"), "$.address"))
    rows = rows.where(kind.rlike(KINDS)).select(key, F.struct("at", "nth").alias("o"), get(F.col("item"), "$.name").alias("name"), get(F.col("item"), "$.telephone").alias("phone"), F.lower(get(F.col("item"), "$.email")).alias("email"), address.alias("address"))
    micro = F.regexp_extract("html", rf'(?is)itemtype="[^"]*(?:{KINDS})[^"]*".*?itemprop="name"[^>]*>([^<]+)<', 1)
    plain = pages.select(key, F.struct(F.lit(1 << 30).alias("at"), F.lit(0).alias("nth")).alias("o"), micro.alias("name"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("address")).where("name <> ''")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("o"))).alias(c)
    return rows.unionByName(plain).groupBy(key).agg(first("name"), first("address"), F.array_sort(F.collect_set("phone")).alias("phones"), F.array_sort(F.collect_set("email")).alias("emails"))


def extracted(html: Column) -> Column:
    """struct(phones, emails, socials) by links and patterns: tel: and mailto:, numbers in the text, one link a network."""
    tel = F.transform(F.regexp_extract_all(html, F.lit(r'href="tel:([^"]+)"'), 1), lambda x: F.regexp_replace(x, r"[^\d+]", ""))
    mail = F.transform(F.regexp_extract_all(html, F.lit(r'href="mailto:([^"]+)"'), 1), lambda x: F.lower(F.substring_index(x, "?", 1)))
    text = F.regexp_replace(html, "<[^>]+>", " ")
    said = F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^\d])((?:\+91[ -]?)?[6-9]\d{4}[ -]?\d{5})(?![\d])"), 1), lambda x: F.concat(F.lit("+91"), F.right(F.regexp_replace(x, r"\D", ""), F.lit(10))))
    links = F.array(*[F.nullif(F.regexp_extract(html, rf'href="(https?://(?:www\.)?{n.replace(".", chr(92) + ".")}/[^"]+)"', 1), F.lit("")) for n in NETWORKS])
    return F.struct(F.array_distinct(F.concat(F.filter(tel, lambda x: F.length(x) >= 10), said)).alias("phones"), F.array_distinct(F.filter(mail, lambda x: x.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"))).alias("emails"), F.filter(links, lambda x: x.isNotNull()).alias("socials"))


def branch(branches: Column, locality: Column, city: Column) -> Column:
    """The first branch whose address has the locality or the city, else the first."""
    near = F.filter(branches, lambda b: F.lower(b["address"]).contains(F.lower(locality)) | F.lower(b["address"]).contains(F.lower(city)))
    return F.coalesce(F.try_element_at(near, F.lit(1)), F.try_element_at(branches, F.lit(1)))
