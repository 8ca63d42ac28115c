"""Registered queries: text, geography, statistics, the relevance cascade, entities, evaluation, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoflow.functions import contact, fuzzy, geo, stats, text
from cartoflow.plans.carriers import query
from cartoflow.relevance import cascade
from cartoflow.relevance.dictionary import Concept

GYM = Concept("gym", labels=("gym", "fitness centre"), strong=("gym", "fitness"), medium=("iron", "workout"), defining=("gym", "fitness_centre"), host=("hotel",), incompatible=("shoe_store", "pharmacy"), veto=("footwear", "hair salon"))


def _candidates(t):
    return t.places.select("id", F.col("source"), F.col("id").cast("string").alias("source_record_id"), "name", "lon", "lat", F.array("category").alias("categories"), F.col("status").alias("operating_status"), "phone", "domain", "category", "confidence")


# ----------------------------------------------------------------------------------------------------- text, urls


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' & Co.'), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS clean FROM part")
def str_01(t):
    return t.part.select("p_partkey", text.sanitized(F.concat("p_name", F.lit(" & Co."))).alias("clean"))


@query("SELECT 1 AS id, 'gama' AS latin")
def str_02(t):
    rows = t.spark.createDataFrame([(1, "गम")], "id int, w string")
    return rows.select("id", F.concat(F.regexp_replace(text.transliterated("w"), "a$", ""), F.lit("a")).alias("latin"))


@query("SELECT DISTINCT replace(category, '_', '') AS word, CASE WHEN category IN ('pooja_store', 'dental_clinic', 'beauty_salon', 'shoe_store') THEN replace(category, '_', '+') ELSE replace(category, '_', '') END AS parts FROM places")
def str_03(t):
    words = t.places.select(F.regexp_replace("category", "_", "").alias("word")).distinct()
    lexicon = {"pooja", "store", "dental", "clinic", "beauty", "salon", "shoe", "sho", "pharma"}
    return words.select("word", F.array_join(fuzzy.split_compounds(F.col("word"), lexicon - {"pharma"}), "+").alias("parts"))


_VARIANTS = (("hotel", "lodge"), ("pharmacie", "chemist"), ("bakerry", "bakehouse"), ("foodwear", "shoes"), ("divin", "holy"), ("kental", "teeth"), ("royall", "regal"), ("mettro", "subway"))


@query(f"""WITH words AS (SELECT DISTINCT unnest(string_split(lower(name), ' ')) AS word FROM places), variants(variant, canonical) AS (VALUES {', '.join(map(str, _VARIANTS))}),
near AS (SELECT word, arg_max(canonical, (jaro_winkler_similarity(word, variant), canonical)) AS canonical FROM words, variants
  WHERE length(word) >= 5 AND jaro_winkler_similarity(word, variant) >= 0.92 AND word NOT IN (SELECT variant FROM variants) GROUP BY word)
SELECT w.word, coalesce(v.canonical, n.canonical, w.word) AS canonical FROM words w LEFT JOIN variants v ON v.variant = w.word LEFT JOIN near n ON n.word = w.word""")
def str_04(t):
    words = t.places.select(F.explode(F.split(F.lower("name"), " ")).alias("word")).distinct()
    return fuzzy.canonical_words(words, t.spark.createDataFrame(_VARIANTS, "variant string, canonical string"))


@query("SELECT id, regexp_matches(lower(name), '(^| )(sri|store)( |$)') AS generic FROM places")
def str_05(t):
    from cartoflow.relevance.dictionary import NON_EVIDENCE

    return t.places.select("id", F.arrays_overlap(text.words(text.sanitized(F.col("name"))), F.array(*map(F.lit, NON_EVIDENCE))).alias("generic"))


@query("SELECT id, len(string_split(name, ' '))::BIGINT AS n_tokens, (len(string_split(name, ' ')) - 1)::BIGINT AS n_bigrams, name || ' | categories: ' || category || '; osm:' AS profile_text FROM places")
def str_06(t):
    rows = cascade.profiled(_candidates(t))
    return rows.select("id", F.size("name_tokens").cast("long").alias("n_tokens"), F.size("name_bigrams").cast("long").alias("n_bigrams"), "profile_text")


@query("SELECT id, trim(regexp_replace(regexp_replace(lower(name), '\\b(pvt|ltd)\\b', '', 'g'), ' +', ' ', 'g')) AS norm FROM places")
def str_07(t):
    return t.places.select("id", text.business_name(F.col("name")).alias("norm"))


@query("SELECT n_nationkey, lower(n_name) || ' cafe' AS norm FROM nation")
def str_08(t):
    return t.nation.select("n_nationkey", text.taxonomy_text(F.concat("n_name", F.lit(" Café!"))).alias("norm"))


@query("SELECT p_partkey, len(list_distinct([substr(lower(trim(p_name)), i, 3) FOR i IN range(1, greatest(length(trim(p_name)) - 1, 2))]))::BIGINT AS n FROM part")
def str_09(t):
    return t.part.select("p_partkey", F.size(text.trigrams(F.col("p_name"))).cast("long").alias("n"))


_TRI = "list_distinct([substr(lower({0}), i, 3) FOR i IN range(1, length({0}) - 1)])"


@query(f"SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6)::DOUBLE AS likeness FROM (SELECT p_partkey, {_TRI.format('p_name')} AS x, {_TRI.format('p_type')} AS y FROM part)")
def str_10(t):
    return t.part.select("p_partkey", F.round(text.trigram_jaccard(F.col("p_name"), F.col("p_type")), 6).alias("likeness"))


@query("SELECT id, least(1.0, CASE WHEN category = 'gym' THEN 1.0 ELSE 0 END / 2 + CASE WHEN category = 'gym' THEN 0.35 ELSE 0 END / 2)::DOUBLE AS score FROM places")
def str_11(t):
    return t.places.select("id", text.lexical_score(text.sanitized(F.col("name")), ["gym"], ["iron"], []).alias("score"))

def _lcs(a: str, b: str) -> str:
    """Longest common subsequence in SQL: rows of the table, one list each."""
    row = f"list_prepend([0::BIGINT], [[i] FOR i IN range(1, length({a}) + 1)])"
    step = f"list_append(acc_, greatest(acc_[len(acc_)], line_[e_[1] + 1], line_[e_[1]] + (ord({a}[e_[1]]) = x_[1])::BIGINT))"
    return f"list_last(list_reduce(list_prepend([0::BIGINT FOR i IN range(0, length({a}) + 1)], [[ord(ch)::BIGINT] FOR ch IN string_split({b}, '')]), lambda line_, x_: list_reduce({row}, lambda acc_, e_: {step})))"


def _indel(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0 * {_lcs(a, b)} / (length({a}) + length({b})) END)::DOUBLE"


_SORTED = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda w: w <> '')), ' ')"


@query(f"SELECT p_partkey, round({_indel('x', 'y')}, 6) AS ratio FROM (SELECT p_partkey, {_SORTED.format('p_name')} AS x, {_SORTED.format('p_type')} AS y FROM part)")
def str_12(t):
    # Ratios of distinct pairs: the table has each many times.
    pairs = t.part.select("p_name", "p_type").distinct().withColumn("ratio", F.round(fuzzy.token_sort_ratio("p_name", "p_type"), 6))
    return t.part.join(pairs, ["p_name", "p_type"]).select("p_partkey", "ratio")


_WORDS = "list_distinct(string_split({0}, ' '))"
_JOINED = "array_to_string(list_sort({0}), ' ')"


@query(f"""WITH pairs AS (SELECT p_partkey, p_name || ' ' || lower(p_mfgr) AS a, lower(p_type) || ' ' || p_name AS b, p_brand, p_name FROM (SELECT p_partkey, p_name, p_type, p_brand, 'x' || (p_partkey % 5) AS p_mfgr FROM part)),
sets AS (SELECT *, {_JOINED.format(f"list_filter({_WORDS.format('a')}, lambda w: list_contains({_WORDS.format('b')}, w))")} AS s, {_JOINED.format(f"list_filter({_WORDS.format('a')}, lambda w: NOT list_contains({_WORDS.format('b')}, w))")} AS l,
  {_JOINED.format(f"list_filter({_WORDS.format('b')}, lambda w: NOT list_contains({_WORDS.format('a')}, w))")} AS r FROM pairs),
whole AS (SELECT *, trim(s || ' ' || l) AS one, trim(s || ' ' || r) AS two FROM sets),
pieces AS (SELECT DISTINCT p_brand, p_name, p_name[greatest(1, i + 1) : i + length(p_brand)] AS piece FROM (SELECT DISTINCT p_brand, p_name, unnest(range(1 - length(p_brand), length(p_name))) AS i FROM part)),
best AS (SELECT p_brand, p_name, max({_indel('p_brand', 'piece')}) AS partial FROM pieces GROUP BY ALL)
SELECT p_partkey, round(CASE WHEN s <> '' AND (l = '' OR r = '') THEN 1.0 ELSE greatest({_indel('one', 'two')}, CASE WHEN s <> '' THEN {_indel('s', 'one')} ELSE 0 END, CASE WHEN s <> '' THEN {_indel('s', 'two')} ELSE 0 END) END, 6)::DOUBLE AS token_set, round(partial, 6) AS partial
FROM whole JOIN best USING (p_brand, p_name) WHERE length(p_brand) <= length(p_name)""")
def str_13(t):
    rows = t.part.where(F.length("p_brand") <= F.length("p_name")).select("p_partkey", "p_brand", "p_name", F.concat_ws(" ", "p_name", F.concat(F.lit("x"), F.col("p_partkey") % 5)).alias("a"), F.concat_ws(" ", F.lower("p_type"), "p_name").alias("b"))
    sets = rows.select("a", "b").distinct().withColumn("token_set", F.round(fuzzy.token_set_ratio("a", "b"), 6))
    parts = rows.select("p_brand", "p_name").distinct().withColumn("partial", F.round(fuzzy.partial_ratio("p_brand", "p_name"), 6))
    return rows.join(sets, ["a", "b"]).join(parts, ["p_brand", "p_name"]).select("p_partkey", "token_set", "partial")


@query("SELECT DISTINCT w, w IN ('gizmo', 'widget') AS close FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)")
def str_14(t):
    # One letter away from either: ratios 0.8 and 0.83; nothing else is near.
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return words.select("w", (fuzzy.close_typo(F.col("w"), F.lit("gismo")) | fuzzy.close_typo(F.col("w"), F.lit("wigdet"))).alias("close"))


@query("SELECT id, CASE WHEN category = 'bakery' THEN 'city bakery' ELSE 'non' END AS stem FROM (SELECT id, category FROM places)")
def str_15(t):
    plural = F.when(F.col("category") == "bakery", "city bakeries").otherwise("nones")
    return t.places.select("id", text.stem(plural).alias("stem"))


@query("SELECT id, phone AS e164 FROM places")
def str_16(t):
    return t.places.select("id", contact.phone_e164(F.concat(F.lit("0"), F.substring("phone", 4, 10))).alias("e164"))


@query("SELECT id, phone IS NOT NULL AS valid, coalesce(regexp_matches(phone, '^\\+91[6-9]') AND domain IS NULL, false) AS risk FROM places")
def str_17(t):
    c = contact.phone_check(F.col("phone"), F.col("domain"))
    return t.places.select("id", c["valid"].alias("valid"), c["personal_risk"].alias("risk"))


@query("SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:]+)', 1), '^www\\.', '') AS domain FROM pages")
def str_18(t):
    return t.pages.select("page_id", contact.domain(F.col("url")).alias("domain"))


@query("SELECT id, domain IS NOT NULL AS ok FROM places")
def str_19(t):
    return t.places.select("id", contact.email_valid(F.concat(F.lit("info@"), "domain")).alias("ok"))


@query("SELECT page_id, replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), 'www.', '') AS host FROM pages")
def str_20(t):
    return t.pages.select("page_id", F.map_keys(contact.socials(F.array(F.lower("url"))))[0].alias("host"))


@query("SELECT n_nationkey, sha256('{\"city\":\"' || lower(n_name) || '\"}') AS cache_key FROM nation")
def str_21(t):
    return t.nation.select("n_nationkey", F.sha2(F.to_json(F.struct(text.sanitized(F.col("n_name")).alias("city"))), 256).alias("cache_key"))


@query("SELECT p_partkey, contains(lower(p_name), lower(substr(p_name, 2, 6))) AS grounded, contains(lower(p_name), lower(p_brand)) AS other FROM part")
def str_22(t):
    return t.part.select("p_partkey", text.grounded(F.upper(F.substring("p_name", 2, 6)), F.col("p_name")).alias("grounded"), text.grounded(F.col("p_brand"), F.col("p_name")).alias("other"))


@query("SELECT id, CASE WHEN category = 'gym' THEN 'accepted' ELSE 'review' END AS verdict FROM places")
def str_23(t):
    return t.places.select("id", text.verdict(F.lit("accepted"), F.substring_index("name", " ", 2), F.col("name"), ["gym"]).alias("verdict"))


@query("SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '^https?://(10\\.|127\\.|192\\.168\\.|localhost)') AS public FROM pages")
def url_01(t):
    return t.pages.select("page_id", contact.public_url(F.col("url")).alias("public"))


_BITS = ", ".join(f"sum(CASE WHEN (h >> {i}) & 1 = 1 THEN n ELSE -n END) AS b{i}" for i in range(64))
_PACK = " | ".join(f"(CASE WHEN b{i} > 0 THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END)" for i in range(64))


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS k, unnest(regexp_extract_all(lower(regexp_replace(text, '<[^>]+>', ' ', 'g')), '[\\p{{L}}\\p{{N}}_]{{3,}}')) AS w FROM conversations),
c AS (SELECT k, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT k, {_BITS} FROM c GROUP BY k) SELECT DISTINCT conv_id * 1000 + turn AS k, coalesce(to_hex({_PACK}), '0') AS hex FROM conversations LEFT JOIN v ON v.k = conv_id * 1000 + turn""")
def txt_01(t):
    rows = t.conversations.withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return text.simhash64(rows, "text", "k").select("k", F.hex("simhash").alias("hex"))


@query("SELECT o_orderkey, bit_count(xor(o_orderkey, o_orderkey * 5))::INT AS distance, CASE WHEN bit_count(xor(o_orderkey, o_orderkey * 5)) <= 3 THEN 'unchanged' WHEN bit_count(xor(o_orderkey, o_orderkey * 5)) <= 8 THEN 'minor' ELSE 'substantive' END AS band FROM orders")
def txt_02(t):
    d = text.hamming(F.col("o_orderkey"), F.col("o_orderkey") * 5)
    return t.orders.select("o_orderkey", d.alias("distance"), text.change_band(d).alias("band"))


@query("SELECT page_id, 'Shop ' || page_id AS name, '+91' || (6000000000 + page_id) AS phone FROM pages WHERE page_id % 3 = 0")
def txt_03(t):
    from cartoflow.sources.pages import structured

    k = F.col("page_id").cast("string")
    data = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type": "LocalBusiness", "name": "Shop '), k, F.lit('", "telephone": "+91'), (F.lit(6_000_000_000) + F.col("page_id")).cast("string"), F.lit('"}</script>'))).otherwise("")
    return structured(t.pages.withColumn("html", F.concat("html", data)), "page_id").select("page_id", "name", F.element_at("phones", 1).alias("phone"))


@query("""SELECT page_id, 'Shop ' || page_id AS name, CASE page_id % 4 WHEN 1 THEN page_id || ' Main' END AS address,
CASE page_id % 4 WHEN 0 THEN '+91' || page_id || '; +92' || page_id WHEN 1 THEN '+91 ' || page_id ELSE '' END AS phones,
CASE page_id % 4 WHEN 2 THEN 'a' || page_id || '@x.in' ELSE '' END AS emails, CASE page_id % 4 WHEN 2 THEN 2 ELSE 1 END::INT AS n_items FROM pages WHERE page_id % 4 < 3""")
def txt_03_markup(t):
    """Markup of four kinds put into the pages' own: a list of JSON-LD, nested microdata, several items, none."""
    from cartoflow.sources.markup import marked_up

    kinds = (
        '<script type="application/ld+json">[{"@type": "Event", "name": "no"}, {"@type": ["Thing", "Restaurant"], "name": "Shop #", "telephone": ["+91#", "+92#", "+91#"]}]</script>',
        "<section itemtype='https://schema.org/Store' itemscope><h2 itemprop=name>Shop <b>#</b></h2><div itemprop=address itemscope itemtype=https://schema.org/PostalAddress><meta itemprop=name content=no><i itemprop=streetAddress># Main</i></div><p itemprop=telephone>+91 #</section>",
        '<div itemscope itemtype="https://schema.org/Person"><b itemprop="name">no</b></div><div itemscope itemtype="https://schema.org/Organization"><b itemprop="name">Shop #</b><meta content="A#@X.in" itemprop="email"></div><p itemscope itemtype="x/Place"><i itemprop="name">late</i>',
    )
    k = F.col("page_id") % 4
    data = F.when(k == 0, kinds[0]).when(k == 1, kinds[1]).when(k == 2, kinds[2]).otherwise("<div itemscope>")
    html = F.concat(F.replace(data, F.lit("#"), F.col("page_id").cast("string")), "html")
    out = marked_up(t.pages.select("page_id", html.alias("html")), "page_id")
    return out.select("page_id", "name", "address", F.array_join("phones", "; ").alias("phones"), F.array_join("emails", "; ").alias("emails"), "n_items")


@query("SELECT page_id, '+91800000' || (1000 + page_id % 9000) AS phone, 'a' || page_id || '@x.in' AS email FROM pages")
def txt_04(t):
    from cartoflow.sources.pages import extracted

    k = F.col("page_id")
    html = F.concat("html", F.lit('<a href="tel:+91 800 000 '), (1000 + k % 9000).cast("string"), F.lit('">x</a><a href="mailto:A'), k.cast("string"), F.lit('@x.in?subject=1">y</a>'))
    out = t.pages.select("page_id", extracted(html).alias("e"))
    return out.select("page_id", F.element_at("e.phones", 1).alias("phone"), F.element_at("e.emails", 1).alias("email"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'b ' || category ELSE 'a' END AS branch FROM places")
def txt_05(t):
    from cartoflow.sources.pages import branch

    branches = F.array(F.struct(F.lit("a").alias("address")), F.struct(F.concat(F.lit("b "), "category").alias("address")))
    return t.places.select("id", branch(branches, F.when(F.col("id") % 2 == 0, F.col("category")).otherwise("zz"), F.lit("yy"))["address"].alias("branch"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props) = 'OBJECT' AS is_object FROM events")
def jsn_01(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT").alias("is_object"))


@query("SELECT event_id, substr(sha256('{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}'), 1, 16) AS etag FROM events")
def jsn_02(t):
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return t.events.select("event_id", F.substring(F.sha2(body, 256), 1, 16).alias("etag"))


# ------------------------------------------------------------------------------------------- geography, statistics

_HAV = "2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)) FROM (SELECT id, sin(radians(12.97 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(12.97)) * sin(radians(77.75 - lon) / 2) ** 2 AS a FROM places)"


@query(f"SELECT id, round(m, 1) AS m FROM (SELECT id, {_HAV.replace(' FROM', ' AS m FROM', 1)})")
def geo_01(t):
    return t.places.select("id", F.round(geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(77.75), F.lit(12.97)), 1).alias("m"))


@query("SELECT id, round(sqrt(((lon - 77.75) * 111000 * 0.98) ** 2 + ((lat - 12.97) * 111000) ** 2), 3) AS m FROM places")
def geo_02(t):
    return t.places.select("id", F.round(geo.flat_m(F.col("lon"), F.col("lat"), F.lit(77.75), F.lit(12.97)), 3).alias("m"))


@query("SELECT id, lon > 77.6005 AND lon < 78.2005 AND lat > 12.9005 AND lat < 13.6005 AS inside FROM places")
def geo_03(t):
    ring = [(77.6005, 12.9005), (78.2005, 12.9005), (78.2005, 13.6005), (77.6005, 13.6005)]
    return t.places.select("id", geo.in_ring(F.col("lon"), F.col("lat"), ring).alias("inside"))


@query("SELECT id, lon BETWEEN 77.55 - 0.01 AND 77.65 + 0.01 AND lat BETWEEN 12.85 - 0.03 AND 13.15 + 0.03 AS inside FROM places")
def geo_04(t):
    wkt = F.lit("POLYGON((77.55 12.85, 77.65 12.85, 77.65 13.15, 77.55 13.15))")
    return t.places.select("id", geo.in_bbox(F.col("lon"), F.col("lat"), wkt).alias("inside"))


_GEOHASH = "'" + geo.BASE32 + "'"


def _letters(precision: int, x: str = "x", y: str = "y") -> str:
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    letters = []
    for k in range(precision):
        bits = [f"((({x}) >> {nx - 1 - j // 2}) & 1)" if j % 2 == 0 else f"((({y}) >> {ny - 1 - j // 2}) & 1)" for j in range(5 * k, 5 * k + 5)]
        value = " + ".join(f"({b} << {4 - i})" for i, b in enumerate(bits))
        letters.append(f"substr({_GEOHASH}, ({value})::INT + 1, 1)")
    return " || ".join(letters)


def _cell_sql(precision: int, what: str) -> str:
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    return f"SELECT id, {what} FROM (SELECT id, floor((lon + 180) / 360 * {1 << nx})::BIGINT AS x, floor((lat + 90) / 180 * {1 << ny})::BIGINT AS y FROM places)"


@query(_cell_sql(7, f"{_letters(7)} AS geohash"))
def geo_05(t):
    return t.places.select("id", geo.geohash(F.col("lon"), F.col("lat"), 7).alias("geohash"))


_AROUND = ", ".join(_letters(6, f"x + {dx}", f"y + {dy}") for dx in (-1, 0, 1) for dy in (-1, 0, 1))


@query(_cell_sql(6, f"array_to_string(list_sort([{_AROUND}]), ',') AS cells"))
def geo_06(t):
    return t.places.select("id", F.array_join(F.array_sort(geo.geohash_block(F.col("lon"), F.col("lat"), 6)), ",").alias("cells"))


@query("SELECT id, round(lat + 1500 / 111320.0, 6)::DOUBLE AS north, 32::BIGINT AS corners FROM places")
def geo_07(t):
    ring = geo.buffer_ring(F.col("lon"), F.col("lat"), F.lit(1500.0))
    return t.places.select("id", F.round(F.array_max(F.transform(ring, lambda p: p["y"])), 6).alias("north"), F.size(ring).cast("long").alias("corners"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6000 <= 100 THEN 2500 WHEN o_orderkey % 6000 <= 300 THEN 4500 WHEN o_orderkey % 6000 <= 1000 THEN 8000 WHEN o_orderkey % 6000 <= 5000 THEN 14000 ELSE 1500 END AS buffer_m FROM orders")
def geo_08(t):
    return t.orders.select("o_orderkey", geo.buffer_radius(F.col("o_orderkey") % 6000, [(100, 2500), (300, 4500), (1000, 8000), (5000, 14000)], 1500).alias("buffer_m"))


@query("SELECT a.id, count(*) AS n FROM places a JOIN places b ON abs(a.lat - b.lat) < 0.001 AND 2 * 6371000 * asin(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)) <= 50 GROUP BY 1")
def geo_09(t):
    from cartoflow.operators.relational import near_counts

    return near_counts(t.places, t.places, 50.0)


@query("SELECT id, lon AS x, lat AS y FROM places")
def geo_10(t):
    p = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    return t.places.select("id", p["x"].alias("x"), p["y"].alias("y"))


@query("SELECT id, round(confidence * CASE WHEN id % 2 = 0 THEN 1 ELSE 0.6 END * CASE WHEN id % 3 = 0 THEN 1 ELSE 0.8 END, 6)::DOUBLE AS score FROM places")
def geo_11(t):
    return t.places.select("id", F.round(geo.geocode_score(F.col("confidence"), F.col("id") % 2 == 0, F.col("id") % 3 == 0), 6).alias("score"))


@query("SELECT id, round(least(1, confidence * 0.9 + CASE WHEN id % 2 = 0 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS c FROM places")
def geo_12(t):
    return t.places.select("id", F.round(geo.geo_confidence(F.col("confidence"), F.lit("locality"), F.col("id") % 2 == 0), 6).alias("c"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'alias' END, CASE WHEN n_nationkey < 10 THEN 'seed' END, 'default') AS tier FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def geo_13(t):
    # Tiers are lookups in order of trust; the first that knows answers.
    seeds = t.nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("seed").alias("seed"))
    return t.customer.join(seeds, "c_nationkey", "left").select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 5 == 0, "alias"), "seed", F.lit("default")).alias("tier"))


@query("SELECT o_orderkey, round(1 / (1 + exp(-greatest(-15.0, least(15.0, (o_orderkey % 41) - 20)))), 8)::DOUBLE AS s FROM orders")
def mth_01(t):
    return t.orders.select("o_orderkey", F.round(stats.sigmoid((F.col("o_orderkey") % 41 - 20).cast("double")), 8).alias("s"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(greatest(0, least(1, (list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / ((sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) + 1e-9) * (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9)) + 1) / 2)), 6)::DOUBLE AS c FROM embeddings, q""")
def mth_02(t):
    q = F.broadcast(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return t.embeddings.join(q, F.lit(True)).select("vec_id", F.round(stats.unit_cosine(F.col("q"), F.col("embedding")), 6).alias("c"))


@query("""SELECT source, n, round((k / n + 1.96 ** 2 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 1.96 ** 2 / (4 * n)) / n)) / (1 + 1.96 ** 2 / n), 6)::DOUBLE AS low,
round((k / n + 1.96 ** 2 / (2 * n) + 1.96 * sqrt((k / n * (1 - k / n) + 1.96 ** 2 / (4 * n)) / n)) / (1 + 1.96 ** 2 / n), 6)::DOUBLE AS high FROM (SELECT source, count(*) AS n, count(phone)::DOUBLE AS k FROM places GROUP BY 1)""")
def mth_03(t):
    w = stats.wilson(F.col("k"), F.col("n"))
    return t.places.groupBy("source").agg(F.count("*").alias("n"), F.count("phone").alias("k")).select("source", "n", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query("SELECT source, round(3.0 / greatest(count(*), 1), 8)::DOUBLE AS bound FROM places GROUP BY 1")
def mth_04(t):
    return t.places.groupBy("source").agg(F.round(stats.rule_of_three(F.count("*")), 8).alias("bound"))


@query("""WITH r AS (SELECT event_type, event_id, value, user_id % 2 = 0 AS g FROM events), seen AS (SELECT event_type, avg(g::INT) AS share, avg(value) FILTER (g) AS m FROM r GROUP BY 1),
dealt AS (SELECT r.event_type, round, avg(value) FILTER (('0x' || substr(md5('0:' || round || ':' || event_id), 1, 8))::BIGINT / 4294967296 < share) AS m0, any_value(m) AS m FROM r JOIN seen USING (event_type), range(1, 41) x(round) GROUP BY ALL)
SELECT event_type, round((count(*) FILTER (m0 >= m) + 1) / (count(*) + 1), 6)::DOUBLE AS p FROM dealt GROUP BY 1""")
def mth_05(t):
    from cartoflow.evaluate.metrics import permutation_test

    rows = t.events.select("event_type", F.col("event_id").alias("id"), "value", (F.col("user_id") % 2 == 0).alias("g"))
    return permutation_test(rows, "event_type", F.col("value"), F.col("g"), "id", 40).withColumn("p", F.round("p", 6))


@query("SELECT o_orderkey, round((epoch_us(TIMESTAMP '1999-01-01') - epoch_us(o_orderdate)) / 8.64e10, 4)::DOUBLE AS age_days, o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 365 DAY AS stale FROM orders")
def dte_01(t):
    now = F.lit("1999-01-01").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", F.round(F.timestamp_diff("MICROSECOND", "o_orderdate", now) / 8.64e10, 4).alias("age_days"), (F.col("o_orderdate") < now - F.expr("interval 365 days")).alias("stale"))


@query("SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3)::DOUBLE AS span_s FROM events GROUP BY 1")
def dte_02(t):
    return t.events.groupBy("user_id").agg(F.round(F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6, 3).alias("span_s"))


# ------------------------------------------------------------------------------------------------------- relevance


_CONCEPTS = (GYM, Concept("pooja_store", labels=("pooja items", "religious goods"), strong=("pooja", "puja"), defining=("pooja_store", "temple_supply")), Concept("dental_clinic", labels=("dentist", "dental clinic"), strong=("dental",), defining=("dental_clinic", "orthodontist")))


@query("""SELECT id, CASE category WHEN 'gym' THEN 'gym' WHEN 'pooja_store' THEN 'pooja_store' WHEN 'dental_clinic' THEN 'dental_clinic' WHEN 'bakery' THEN 'gym' WHEN 'hotel' THEN 'gym' WHEN 'pharmacy' THEN 'dental_clinic' END AS concept_id,
CASE category WHEN 'gym' THEN 'exact' WHEN 'pooja_store' THEN 'exact' WHEN 'dental_clinic' THEN 'alias' WHEN 'bakery' THEN 'tokens' WHEN 'hotel' THEN 'fuzzy' WHEN 'pharmacy' THEN 'taxonomy' ELSE 'unresolved' END AS way FROM places""")
def rel_01(t):
    from cartoflow.relevance.dictionary import resolved

    # A keyword of each kind by category: two ids (one plural), a label, a label with its words turned, a typo, a word of a category.
    said = {"gym": "Gyms", "pooja_store": "pooja store", "dental_clinic": "dentists", "bakery": "centre fitness", "hotel": "fitnes centre", "pharmacy": "orthodontist near me"}
    keyword = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in said.items() for x in kv]), F.col("category")), F.lit("shoes"))
    rows = t.places.select("id", keyword.alias("keyword"))
    return rows.join(resolved(rows.select("keyword").distinct(), _CONCEPTS), "keyword").select("id", "concept_id", "way")


@query("""SELECT unnest(['gym', 'pooja_store', 'dental_clinic', 'the_shop']) AS concept_id, unnest(['gym,fitness', 'pooja,puja', 'dental', 'the shop']) AS evidence, unnest(['footwear,hair salon,hair,salon', '', '', 'mart']) AS veto""")
def rel_02(t):
    cards = [*_CONCEPTS, Concept("the_shop", strong=("the", "shop"), veto=("mart",))]
    return t.spark.createDataFrame([(c.concept_id, ",".join(c.evidence_terms()), ",".join(c.veto_terms())) for c in cards], "concept_id string, evidence string, veto string")


@query("SELECT DISTINCT category AS query, category AS category, 1.0::DOUBLE AS score FROM places")
def rel_03(t):
    from cartoflow.relevance.dictionary import taxonomy_matches

    nodes = t.places.select("category", F.regexp_replace("category", "_", " ").alias("display_name")).distinct()
    return taxonomy_matches(t.places.select(F.col("category").alias("query")).distinct(), nodes)


_FEATURES = """SELECT id, name, category, status, (category = 'gym')::INT AS cat, (category = 'hotel')::INT AS host, (category = 'gym')::INT AS nm, (category = 'gym')::INT / 3.0 AS sup FROM places"""


@query(f"SELECT id, cat::DOUBLE AS f_def_cat, nm::DOUBLE AS f_def_name, host::DOUBLE AS f_host_cat, round(sup, 6)::DOUBLE AS f_sup_count FROM ({_FEATURES})")
def rel_04(t):
    return cascade.features(_candidates(t), GYM).select("id", "f_def_cat", "f_def_name", "f_host_cat", F.round("f_sup_count", 6).alias("f_sup_count"))


_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / ((sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) + 1e-9) * (sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])) + 1e-9))"
_UNIT = f"greatest(0, least(1, ({_COS.format('q', 'v')} + 1) / 2))"


@query(f"""WITH protos AS (SELECT vec_id % 2 = 0 AS positive, embedding AS q FROM embeddings WHERE vec_id < 8),
named AS (SELECT id, embedding AS v FROM places LEFT JOIN embeddings ON vec_id = id),
best AS (SELECT id, max({_UNIT}) FILTER (positive) AS pos, max({_UNIT}) FILTER (NOT positive) AS neg FROM named, protos WHERE v IS NOT NULL GROUP BY 1)
SELECT id, round(coalesce(pos, 0.5), 6)::DOUBLE AS f_sem_pos, round(coalesce(neg, 0.5), 6)::DOUBLE AS f_sem_neg, round(coalesce(pos, 0.5) - coalesce(neg, 0.5), 6)::DOUBLE AS f_sem_margin FROM named LEFT JOIN best USING (id)""")
def rel_05(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    # Prototypes are a card's examples: a few, positive and negative.
    positive, negative = ([r["embedding"] for r in t.embeddings.where(f"vec_id < 8 and vec_id % 2 = {k}").orderBy("vec_id").collect()] for k in (0, 1))
    rows = cascade.features(_candidates(t).join(vectors, "id", "left"), GYM, prototypes=(positive, negative))
    return rows.select("id", *[F.round(c, 6).alias(c) for c in ("f_sem_pos", "f_sem_neg", "f_sem_margin")])


_P = "1 / (1 + exp(-(0.3 + 3.2 * cat + 1.4 * nm + 0.2 * host + 0.8 * sup)))"


@query(f"SELECT id, round({_P}, 6)::DOUBLE AS p, CASE WHEN {_P} >= 0.75 AND cat = 1 THEN 'accepted' WHEN {_P} < 0.35 THEN 'rejected' ELSE 'uncertain' END AS outcome FROM ({_FEATURES})")
def rel_06(t):
    rows = cascade.scored(cascade.features(_candidates(t), GYM), GYM)
    return rows.select("id", F.round("p", 6).alias("p"), F.col("score_outcome").alias("outcome"))


_GATED = "CASE WHEN status = 'permanently_closed' OR category IN ('shoe_store', 'pharmacy', 'beauty_salon') THEN 'rejected' WHEN category = 'gym' THEN 'accepted' ELSE 'review' END"


@query("""SELECT id, CASE WHEN status = 'permanently_closed' OR category IN ('shoe_store', 'pharmacy', 'beauty_salon') THEN 'rejected' WHEN category = 'gym' THEN 'accepted' WHEN id % 5 < 2 THEN 'rejected' ELSE 'review' END AS outcome,
CASE WHEN status = 'permanently_closed' OR category IN ('shoe_store', 'pharmacy', 'beauty_salon') THEN 'hard_gates' WHEN category = 'gym' THEN 'scorer' WHEN id % 5 = 2 THEN 'review_band' ELSE 'cross_encoder' END AS stage,
CASE WHEN status = 'permanently_closed' THEN 'closed' WHEN category IN ('shoe_store', 'pharmacy') THEN 'incompatible_category' WHEN category = 'beauty_salon' THEN 'veto_term' WHEN category = 'gym' THEN NULL WHEN id % 5 < 2 THEN 'cross_encoder_low' WHEN id % 5 = 2 THEN 'uncertain_llm_disabled' ELSE 'ce_accepted_no_primary' END AS code FROM places""")
def rel_07(t):
    # A reranker's scores as a column: low, in between, high; high ones without a defining category stay for review.
    ce = F.when(F.col("id") % 5 < 2, 0.1).when(F.col("id") % 5 == 2, 0.5).otherwise(0.9)
    return cascade.decided(_candidates(t), GYM, reranker=ce).select("id", "outcome", "stage", "code")


@query("SELECT outcome, stage, code, count(*) AS n FROM (SELECT 'review' AS outcome, 'review_band' AS stage, 'concept_missing' AS code FROM places WHERE (status IS NULL OR status <> 'permanently_closed') AND category NOT IN ('beauty_salon', 'shoe_store', 'pharmacy') UNION ALL SELECT 'rejected', 'hard_gates', CASE WHEN status = 'permanently_closed' THEN 'closed' WHEN category = 'beauty_salon' THEN 'veto_term' ELSE 'incompatible_category' END FROM places WHERE coalesce(status, '') = 'permanently_closed' OR category IN ('beauty_salon', 'shoe_store', 'pharmacy')) GROUP BY ALL")
def rel_08(t):
    # Adjudication is off for an unknown concept: what the gates leave is for review, whatever its score.
    return cascade.decided(_candidates(t), GYM, force_review=True).groupBy("outcome", "stage", "code").agg(F.count("*").alias("n"))


@query(f"SELECT id, {_GATED} AS outcome, CASE WHEN status = 'permanently_closed' OR category IN ('shoe_store', 'pharmacy', 'beauty_salon') THEN 'hard_gates' WHEN category = 'gym' THEN 'scorer' ELSE 'review_band' END AS stage, CASE WHEN status = 'permanently_closed' THEN 'closed' WHEN category IN ('shoe_store', 'pharmacy') THEN 'incompatible_category' WHEN category = 'beauty_salon' THEN 'veto_term' WHEN category <> 'gym' THEN 'uncertain_llm_disabled' END AS code FROM places")
def rel_09(t):
    return cascade.decided(_candidates(t), GYM).select("id", "outcome", "stage", "code")


@query(f"SELECT {_GATED} AS outcome, count(*) AS n FROM places GROUP BY 1")
def rel_10(t):
    rows = _candidates(t).withColumn("ordinal", F.col("id"))
    twice = rows.unionByName(rows.withColumn("ordinal", F.col("id") + 1_000_000_000))
    return cascade.one_pass(twice, GYM).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT 'as_is' AS rung, count(*) AS total, count(*) FILTER (status = 'permanently_closed' OR category IN ('shoe_store', 'pharmacy', 'beauty_salon')) AS rejected, false AS degenerate FROM places
UNION ALL SELECT 'unseen', count(*), 0, count(*) > 5 FROM places WHERE id % 4 <> 0 AND (status IS NULL OR status <> 'permanently_closed') AND category NOT IN ('beauty_salon', 'shoe_store', 'pharmacy')""")
def rel_11(t):
    # Rung one: what was not seen yet, all of it for review; where nothing is rejected the rung says nothing.
    rows = _candidates(t).withColumn("ordinal", F.col("id"))
    fresh = cascade.one_pass(rows, GYM, rows.where("id % 4 = 0"), force_review=True).where("stage <> 'hard_gates'")
    named = lambda name, df: cascade.degenerate(df).select(F.lit(name).alias("rung"), "*")
    return named("as_is", cascade.decided(_candidates(t), GYM)).unionByName(named("unseen", fresh))


@query(f"SELECT rank, {_GATED} AS decision FROM results JOIN places ON business_id = id")
def rel_12(t):
    now = cascade.decided(_candidates(t), GYM).select("id", "outcome")
    return t.results.join(now, F.col("business_id") == F.col("id")).select("rank", F.col("outcome").alias("decision"))


@query("SELECT rank, CASE WHEN rank % 7 = 0 THEN 'rejected' ELSE decision END AS decision FROM results")
def rel_13(t):
    from cartoflow.store.queue import relabelled

    rows = t.results.withColumn("business_id", F.col("rank"))
    labels = rows.where("rank % 7 = 0").select("run_id", "business_id", F.lit("rejected").alias("decision"), "created_at")
    return relabelled(rows, labels).select("rank", "decision")


@query("""SELECT id, CASE category WHEN 'gym' THEN 'gym,fitness_centre' WHEN 'pooja_store' THEN 'pooja_store,temple_supply' WHEN 'hotel' THEN 'gym,fitness_centre' ELSE '' END AS categories, CASE category WHEN 'gym' THEN 'gym|fitness centre|fitness' WHEN 'hotel' THEN 'gym|fitness centre|fitness' WHEN 'pooja_store' THEN 'pooja items|religious goods|pooja|puja' ELSE 'shoes' END AS synonyms FROM places""")
def rel_14(t):
    from cartoflow.relevance.dictionary import planned

    said = {"gym": "gyms", "pooja_store": "Pooja Store", "hotel": "fitnes centre"}
    keyword = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in said.items() for x in kv]), F.col("category")), F.lit("shoes"))
    rows = t.places.select("id", keyword.alias("keyword"))
    return rows.join(planned(rows.select("keyword").distinct(), _CONCEPTS), "keyword").select("id", F.array_join("categories", ",").alias("categories"), F.array_join("synonyms", "|").alias("synonyms"))


# ------------------------------------------------------------------------------- entities, checks, scores, completion


_NORM = "array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '\\b(pvt|ltd)\\b', '', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> '')), ' ')"
_PAIRS = f"""WITH s AS (SELECT *, floor((lon + 180) / 360 * {1 << 18})::BIGINT || ':' || floor((lat + 90) / 180 * {1 << 17})::BIGINT AS cell, {_NORM.format('name')} AS norm FROM places),
keys AS (SELECT id, 'c' || cell AS k FROM s UNION ALL SELECT id, 'p' || phone FROM s WHERE phone IS NOT NULL UNION ALL SELECT id, 'd' || domain FROM s WHERE domain IS NOT NULL),
met AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keys x JOIN keys y ON x.k = y.k AND x.id < y.id),
duo AS (SELECT a, b, x.norm AS m, y.norm AS n, CASE WHEN x.phone = y.phone THEN 0.95 WHEN x.domain = y.domain THEN 0.92 END AS sure,
  sqrt(((x.lon - y.lon) * 111000 * 0.98) ** 2 + ((x.lat - y.lat) * 111000) ** 2) AS d FROM met JOIN s x ON x.id = a JOIN s y ON y.id = b),
pairs AS (SELECT a, b, sure AS probability FROM duo WHERE sure IS NOT NULL
  UNION ALL SELECT a, b, least(1.0, 0.55 * {_indel('m', 'n')} + 0.45 * CASE WHEN d <= 30 THEN 1.0 WHEN d <= 80 THEN 0.75 WHEN d <= 200 THEN 0.4 ELSE 0 END) FROM duo WHERE sure IS NULL)"""


@query(f"""{_PAIRS}, ways AS (SELECT a AS id, b AS other, probability AS p FROM pairs UNION ALL SELECT b, a, probability FROM pairs),
classes AS (SELECT norm, phone, domain, lon, lat, min(id) AS class FROM s GROUP BY ALL),
records AS (SELECT s.id, any_value(class) AS class, count(*) FILTER (WHERE p IN (0.95, 0.92)) AS n_shared, count(*) FILTER (WHERE p >= 0.85 AND p NOT IN (0.95, 0.92)) AS n_match
  FROM s LEFT JOIN ways w ON w.id = s.id JOIN classes c ON c.norm = s.norm AND c.phone IS NOT DISTINCT FROM s.phone AND c.domain IS NOT DISTINCT FROM s.domain AND c.lon = s.lon AND c.lat = s.lat GROUP BY s.id),
spots AS (SELECT cell, norm, lon, lat, min(id) AS spot FROM s GROUP BY ALL)
SELECT 'record' AS kind, class AS a, id AS b, NULL::DOUBLE AS probability, n_shared, n_match FROM records
UNION ALL SELECT 'phone', min(id) OVER (PARTITION BY phone), id, 0.95, NULL, NULL FROM s WHERE phone IS NOT NULL
UNION ALL SELECT 'domain', min(id) OVER (PARTITION BY domain), id, 0.92, NULL, NULL FROM s WHERE domain IS NOT NULL
UNION ALL SELECT 'place', min(id) OVER (PARTITION BY cell, norm, lon, lat), id, 1, NULL, NULL FROM s
UNION ALL SELECT 'pair', a, b, round(least(1.0, 0.55 * {_indel('m', 'n')} + 0.45 * CASE WHEN d <= 30 THEN 1.0 WHEN d <= 80 THEN 0.75 WHEN d <= 200 THEN 0.4 ELSE 0 END), 6), NULL, NULL
  FROM (SELECT x.spot AS a, y.spot AS b, x.norm AS m, y.norm AS n, sqrt(((x.lon - y.lon) * 111000 * 0.98) ** 2 + ((x.lat - y.lat) * 111000) ** 2) AS d FROM spots x JOIN spots y ON x.cell = y.cell AND x.spot < y.spot)""")
def ent_01(t):
    from cartoflow.resolve.blocks import pair_scores

    return pair_scores(t.places).withColumn("probability", F.round("probability", 6))


@query(f"{_PAIRS} SELECT CASE WHEN probability IN (0.95, 0.92) THEN 'shared' WHEN probability >= 0.85 THEN 'match' ELSE 'apart' END AS band, count(*) AS n FROM pairs GROUP BY 1")
def ent_02(t):
    from cartoflow.resolve.blocks import bands

    return bands(t.places)


@query(f"""WITH RECURSIVE {_PAIRS[5:]}, links AS (SELECT id AS a, min(id) OVER (PARTITION BY phone) AS b FROM s WHERE phone IS NOT NULL UNION SELECT id, min(id) OVER (PARTITION BY domain) FROM s WHERE domain IS NOT NULL UNION SELECT a, b FROM pairs WHERE probability >= 0.85 AND probability NOT IN (0.95, 0.92)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM s UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a""")
def ent_03(t):
    from cartoflow.resolve.entities import clusters, match_links

    return clusters(t.places, match_links(t.places))


@query("SELECT category AS cluster, count(DISTINCT source) AS n_sources, arg_max(name, (length(name), -id)) AS canonical_name, round(avg(lon), 8) AS lon FROM places GROUP BY 1")
def ent_04(t):
    from cartoflow.resolve.entities import golden_records

    of = t.places.select("id", F.col("category").alias("cluster"))
    return golden_records(t.places, of).select("cluster", F.col("independent_source_count").cast("long").alias("n_sources"), "canonical_name", F.round("lon", 8).alias("lon"))


@query(f"""WITH m AS (SELECT *, id // 5 AS cluster, 'https://www.s' || id % 2 || '.com/p' || id AS social, CASE id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'review' ELSE 'rejected' END AS decision FROM places),
s AS (SELECT cluster, string_agg(host || '>' || url, ',' ORDER BY host) AS socials FROM (SELECT cluster, 's' || id % 2 || '.com' AS host, max(social) AS url FROM m GROUP BY ALL) GROUP BY 1),
g AS (SELECT cluster, arg_max(name, (length(name), -id)) AS canonical_name, coalesce(string_agg(DISTINCT phone, ',' ORDER BY phone), '') AS phones_e164, coalesce(string_agg(DISTINCT CASE WHEN id % 2 = 0 THEN 'a@' || domain END, ',' ORDER BY CASE WHEN id % 2 = 0 THEN 'a@' || domain END), '') AS emails,
  string_agg(DISTINCT category, ',' ORDER BY category) AS categories, arg_min(domain, id) FILTER (domain IS NOT NULL) AS website_domain, arg_min('http://' || domain, id) FILTER (domain IS NOT NULL) AS website_url, avg(lon) AS lon, avg(lat) AS lat, count(DISTINCT source) AS independent_source_count,
  string_agg(source || ':' || id, ',' ORDER BY source || ':' || id) AS source_ids, arg_min('Road ' || id, id) AS address, (list(status ORDER BY id))[1] AS operating_status, CASE WHEN bool_or(decision = 'accepted') THEN 'accepted' WHEN bool_or(decision = 'review') THEN 'review' ELSE 'accepted' END AS decision, max(confidence) AS relevance_p
  FROM m GROUP BY cluster)
SELECT g.* EXCLUDE (lon, lat), socials, round(lon, 8) AS lon, round(lat, 8) AS lat, cluster AS id, trim(regexp_replace(regexp_replace(lower(canonical_name), '\\b(pvt|ltd)\\b', '', 'g'), ' +', ' ', 'g')) AS name_norm FROM g JOIN s USING (cluster)""")
def ent_04_whole(t):
    from cartoflow.resolve.entities import golden_records

    k = F.col("id")
    rows = t.places.withColumns({"email": F.when(k % 2 == 0, F.concat(F.lit("A@"), "domain")), "website": F.concat(F.lit("http://"), "domain"), "social": F.concat(F.lit("https://www.s"), (k % 2).cast("string"), F.lit(".com/p"), k.cast("string")), "address": F.concat(F.lit("Road "), k.cast("string")), "decision": F.when(k % 4 == 0, "accepted").when(k % 4 == 1, "review").otherwise("rejected"), "p": F.col("confidence")})
    out = golden_records(rows, rows.select("id", F.floor(k / 5).cast("long").alias("cluster")))
    text = lambda c: F.array_join(c, ",").alias(c)
    social = F.array_join(F.array_sort(F.transform(F.map_entries("socials"), lambda x: F.concat(x["key"], F.lit(">"), x["value"]))), ",").alias("socials")
    same = ("cluster", "canonical_name", "website_domain", "website_url", "address", "operating_status", "decision", "relevance_p", "id", "name_norm")
    return out.select(*same, *map(text, ("phones_e164", "emails", "categories", "source_ids")), social, F.col("independent_source_count").cast("long").alias("independent_source_count"), F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query(f"SELECT id, round(m / 1000, 2) AS km FROM (SELECT id, {_HAV.replace(' FROM', ' AS m FROM', 1)})")
def ent_05(t):
    return t.places.select("id", F.round(geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(77.75), F.lit(12.97)) / 1000, 2).alias("km"))


@query("SELECT id, lower(source) <> 'osm' AS independent FROM places")
def ent_06(t):
    from cartoflow.resolve.entities import independent

    return t.places.select("id", independent(F.col("source"), F.lit("OSM")).alias("independent"))


def _entities(t):
    return t.places.select("id", "name", "lon", "lat", "phone", F.when(F.col("id") % 2 == 0, F.concat(F.lit("info@"), "domain")).alias("email"), F.col("domain").alias("website"), (F.col("id") % 6 != 0).alias("website_ok"), (F.col("id") % 3).cast("int").alias("independent_source_count"), F.col("status").alias("operating_status"), F.when(F.col("id") % 4 != 0, F.lit("12 Main Road, Bengaluru")).alias("address"))


_CHECKS = """ck AS (SELECT id, phone IS NOT NULL AS ph, id % 3 >= 2 AS ms, id % 2 = 0 AND domain IS NOT NULL AS em, id % 6 <> 0 AS web, status IS NULL OR status <> 'permanently_closed' AS op, id % 4 <> 0 AS ad, coalesce(regexp_matches(phone, '^\\+91[6-9]') AND domain IS NULL, false) AS risk, id % 3 AS nsrc FROM places)"""


_ROOM = [(77.6005, 12.9005), (78.2005, 12.9005), (78.2005, 13.6005), (77.6005, 13.6005)]


@query(f"""WITH {_CHECKS}, rows AS (
  SELECT id, 'inside_boundary' AS check_name, CASE WHEN lon BETWEEN 77.6005 AND 78.2005 AND lat BETWEEN 12.9005 AND 13.6005 THEN 'passed' ELSE 'failed' END AS outcome FROM places
  UNION ALL SELECT id, 'phone_valid', CASE WHEN phone IS NULL THEN 'inconclusive' WHEN regexp_full_match(phone, '\\+91[0-9]{{10}}') THEN 'passed' ELSE 'failed' END FROM places
  UNION ALL SELECT id, 'personal_number_risk', 'failed' FROM ck WHERE risk
  UNION ALL SELECT id, 'multi_source_agreement', 'passed' FROM ck WHERE ms
  UNION ALL SELECT id, 'email_syntax', CASE WHEN em THEN 'passed' ELSE 'inconclusive' END FROM ck
  UNION ALL SELECT id, 'email_mx', 'inconclusive' FROM ck WHERE em
  UNION ALL SELECT id, 'website_accessible', CASE WHEN web THEN 'passed' ELSE 'failed' END FROM ck
  UNION ALL SELECT id, 'operating_status_open', CASE WHEN op THEN 'passed' ELSE 'failed' END FROM ck
  UNION ALL SELECT id, 'address_complete', CASE WHEN ad THEN 'passed' ELSE 'failed' END FROM ck)
SELECT id, check_name, outcome FROM rows""")
def ver_01(t):
    from cartoflow.quality.scoring import checks

    return checks(_entities(t), _ROOM).select(F.col("entity_id").alias("id"), "check_name", "outcome")


@query()
def ver_02(t):
    from cartoflow.quality.scoring import site_names_entity

    return t.pages.select("page_id", site_names_entity(F.regexp_replace("html", "<[^>]+>", " "), F.lit("the of and")).alias("named"))


_CONF = "round(greatest(0.01, least(0.99, 0.35 + 0.15 * ph::INT + 0.1 * em::INT + 0.1 * web::INT + 0.2 * ms::INT + 0.05 * op::INT + 0.05 * ad::INT - 0.1 * risk::INT - 0.3 * (NOT op)::INT)), 3)::DOUBLE"


@query(f"WITH {_CHECKS} SELECT id, {_CONF} AS confidence FROM ck")
def sco_01(t):
    from cartoflow.quality.scoring import checks, scored

    return scored(_entities(t), checks(_entities(t))).select("id", "confidence")


@query(f"WITH {_CHECKS} SELECT id, CASE WHEN c >= 0.8 AND (ms OR web OR nsrc >= 2) THEN 'Verified' WHEN c >= 0.6 THEN 'Likely' ELSE 'Unverified' END AS tier FROM (SELECT *, {_CONF} AS c FROM ck)")
def sco_02(t):
    from cartoflow.quality.scoring import checks, scored

    return scored(_entities(t), checks(_entities(t))).select("id", "tier")


@query("SELECT unnest(['all', 'missing', 'unknown', 'none']) AS config, unnest([true, false, false, false]) AS accepted")
def sco_03(t):
    from cartoflow.quality.scoring import GAINS, validate_weights

    def accepted(weights: dict) -> bool:
        try:
            validate_weights(weights)
        except ValueError:
            return False
        return True

    configs = {"all": GAINS, "missing": dict(list(GAINS.items())[1:]), "unknown": GAINS | {"other": 0.1}, "none": {}}
    return t.spark.createDataFrame([(k, accepted(w)) for k, w in configs.items()], "config string, accepted boolean")


@query("""SELECT o_orderkey, CASE WHEN k = 0 THEN 'failed' WHEN k = 1 THEN 'cancelled' WHEN o_orderkey % 50 >= 40 THEN 'target_met' WHEN k = 2 THEN 'budget_exhausted' WHEN k = 3 THEN 'partial_sources'
WHEN k = 4 AND o_orderkey % 50 = 0 THEN 'keyword_plan_matched_nothing' WHEN k = 5 THEN 'no_new_leads' WHEN o_orderkey % 50 < 5 THEN 'low_relevance' WHEN k = 6 THEN 'region_exhausted' ELSE 'low_relevance' END AS reason FROM (SELECT o_orderkey, (o_orderkey // 50) % 8 AS k FROM orders)""")
def cmp_01(t):
    from cartoflow.quality.scoring import completion_reason

    k, a = F.floor(F.col("o_orderkey") / 50) % 8, F.col("o_orderkey") % 50
    seen = F.when((k == 4) & (a == 0), 0).otherwise(100)
    row = {"critical_error": k == 0, "cancelled": k == 1, "accepted": a, "target": F.lit(40), "budget_exhausted": k == 2, "any_failed": k == 3, "candidates_seen": seen, "raw_count": F.lit(7), "new_businesses": F.when(k == 5, 0).otherwise(3), "matched_existing": F.lit(2), "reached_final_rung": k == 6, "last_rung_new": F.lit(0)}
    return t.orders.select("o_orderkey", completion_reason(row).alias("reason"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status FROM orders")
def cmp_02(t):
    from cartoflow.quality.scoring import final_status

    reason = F.when(F.col("o_orderstatus") == "F", "target_met").when(F.col("o_orderstatus") == "O", "partial_sources").otherwise("failed")
    return t.orders.select("o_orderkey", final_status(reason, F.lit(False)).alias("status"))


@query("SELECT count(*) AS candidates_seen, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (is_new) AS new_businesses, true AS any_failed FROM results")
def cmp_03(t):
    from cartoflow.quality.scoring import evidence

    sources = t.spark.createDataFrame([("osm", True), ("overture", False)], "source string, failed boolean")
    return evidence(t.results, sources).select("candidates_seen", "accepted", "new_businesses", "any_failed")


# ------------------------------------------------------------------------------------------------------- evaluation


@query(f"SELECT count(*) FILTER (y AND {_GATED} = 'accepted') AS tp, count(*) FILTER (NOT y AND {_GATED} = 'accepted') AS fp, count(*) FILTER (y AND {_GATED} <> 'accepted') AS fn FROM (SELECT *, category IN ('gym', 'hotel') AS y FROM places)")
def eva_01(t):
    from cartoflow.evaluate.metrics import confusion

    rows = cascade.decided(_candidates(t), GYM).withColumn("y", F.col("category").isin("gym", "hotel"))
    return confusion(rows, "y", F.col("outcome") == "accepted").select("tp", "fp", "fn")


@query("""WITH coins AS (SELECT category IN ('gym', 'hotel') AS y, ('0x' || substr(md5('0:' || id), 1, 8))::BIGINT % 2 = 0 AS coin, contains(lower(name), 'royal') OR contains(lower(name), 'hotel') AS hit, id % 3 = 0 AS ok,
  coalesce(lead(category IN ('gym', 'hotel')) OVER (PARTITION BY ('0x' || substr(md5('deal:' || id), 1, 8))::BIGINT % 64 ORDER BY md5('0:' || id), id), category IN ('gym', 'hotel')) AS dealt FROM places)
SELECT 'all' AS baseline, count(*) FILTER (y) AS tp, count(*) FILTER (NOT y) AS fp FROM coins UNION ALL SELECT 'near', count(*) FILTER (y), count(*) FILTER (NOT y) FROM coins
UNION ALL SELECT 'substring', count(*) FILTER (y AND hit), count(*) FILTER (NOT y AND hit) FROM coins UNION ALL SELECT 'random', count(*) FILTER (y AND coin), count(*) FILTER (NOT y AND coin) FROM coins
UNION ALL SELECT 'shuffled', count(*) FILTER (dealt AND ok), count(*) FILTER (NOT dealt AND ok) FROM coins""")
def eva_02(t):
    from cartoflow.evaluate.metrics import baselines, confusion

    rows = t.places.select("id", "name", F.col("category").isin("gym", "hotel").alias("label"), (F.col("id") % 3 == 0).alias("accepted"))
    return confusion(baselines(rows, "royal gym hotel"), "label", F.col("accepted"), "baseline").select("baseline", "tp", "fp")


@query("""WITH base AS (SELECT id, category IN ('gym', 'hotel') AS y, id % 3 = 0 AS ok FROM places),
dealt AS (SELECT s, ok, coalesce(lead(y) OVER (PARTITION BY s, ('0x' || substr(md5('deal:' || id), 1, 8))::BIGINT % 64 ORDER BY md5(s || ':' || id), id), y) AS y FROM base, range(5) r(s)),
each AS (SELECT s, count(*) FILTER (y AND ok) / greatest(count(*) FILTER (ok), 1) AS p FROM dealt GROUP BY s)
SELECT round(avg(p), 4)::DOUBLE AS precision_mean, round(stddev_pop(p), 4)::DOUBLE AS precision_std, count(*) AS runs FROM each""")
def eva_02_deals(t):
    from cartoflow.evaluate.metrics import shuffled_control

    return shuffled_control(t.places.select("id", F.col("category").isin("gym", "hotel").alias("label"), (F.col("id") % 3 == 0).alias("accepted")))


_OPEN = "(status IS NULL OR status <> 'permanently_closed')"


@query(f"""SELECT 'none' AS mutation, count(*) FILTER ({_GATED} = 'accepted') AS n_accepted, count(*) FILTER ({_GATED} = 'rejected') AS n_rejected, count(*) AS n FROM places
UNION ALL SELECT 'no_categories', 0, count(*) FILTER (NOT {_OPEN} OR name LIKE '%Footwear%' OR name LIKE '%Salon%'), count(*) FROM places
UNION ALL SELECT 'empty', 0, 0, 0""")
def eva_03(t):
    return _mutations(t, ("none", "no_categories", "empty"))


def _mutations(t, kinds):
    from cartoflow.evaluate.metrics import mutated

    def told(kind):
        rows = cascade.decided(_candidates(t) if kind == "none" else mutated(_candidates(t), kind), GYM)
        return rows.agg(F.count_if(F.col("outcome") == "accepted").alias("n_accepted"), F.count_if(F.col("outcome") == "rejected").alias("n_rejected"), F.count("*").alias("n")).select(F.lit(kind).alias("mutation"), "*")

    out = told(kinds[0])
    for kind in kinds[1:]:
        out = out.unionByName(told(kind))
    return out


@query("""SELECT unnest(['permutation', 'duplication', 'restriction', 'irrelevant_column', 'case', 'closing', 'moved_within', 'typo']) AS relation, unnest([n, n, even, n, n, kept, n, n])::BIGINT AS n_accepted, 0::BIGINT AS n_new, true AS holds
FROM (SELECT count(*) AS n, count(*) FILTER (id % 2 = 0) AS even, count(*) FILTER (id % 3 <> 0) AS kept FROM places WHERE category = 'gym' AND (status IS NULL OR status <> 'permanently_closed'))""")
def eva_04(t):
    from cartoflow.evaluate.metrics import RELATIONS, related
    from cartoflow.store.shared import spool

    # All relations are decided in one plan, told apart by a column.
    asked, rows = {"before": "same"}, _candidates(t).withColumn("relation", F.lit("before"))
    for relation in RELATIONS:
        changed, asked[relation] = related(_candidates(t), relation)
        rows = rows.unionByName(changed.withColumn("relation", F.lit(relation)), allowMissingColumns=True)
    # Written first: the decision's long expressions are then planned once, and not for each part of the union.
    accepted = cascade.decided(spool(rows), GYM).where("outcome = 'accepted'").select("relation", "id").distinct()
    kept = accepted.groupBy("id").agg(F.collect_set("relation").alias("in"))  # nine names at most
    each = kept.select("id", "in", F.explode(F.array(*map(F.lit, RELATIONS))).alias("relation"))
    old, now = F.array_contains("in", "before"), F.array_contains(F.col("in"), F.col("relation"))
    out = each.groupBy("relation").agg(F.count_if(now).alias("n_accepted"), F.count_if(now & ~old).alias("n_new"), F.count_if(old & ~now).alias("gone"))
    fewer = F.col("relation").isin([k for k, v in asked.items() if v == "fewer"])
    return out.select("relation", "n_accepted", "n_new", ((F.col("n_new") == 0) & ((F.col("gone") == 0) | fewer)).alias("holds"))


@query("SELECT 'BLIND-' || lpad(i::VARCHAR, 3, '0') AS blind_id, id FROM (SELECT id, row_number() OVER (ORDER BY md5('0:' || id), id) AS i FROM places) WHERE i <= 20")
def eva_05(t):
    from cartoflow.evaluate.sampling import blind_sample

    return blind_sample(t.places.select("id"), "id", 20).select("blind_id", "id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY doc_id % 3, md5('0:' || doc_id), doc_id LIMIT 15")
def eva_06(t):
    from cartoflow.evaluate.sampling import label_queue

    done = t.labels.select(F.col("doc_id").alias("id"))
    return label_queue(t.documents.select(F.col("doc_id").alias("id")), F.col("id") % 3, "id", 15, done).select("id")


# --------------------------------------------------------------------------------------------------------- streams


def _stream(t, shape, mode: str = "append"):
    """Run a stream over the events files to its end, and read what it wrote; updates are kept batch by batch."""
    from cartoflow.store.shared import shared_dir
    from cartoflow.streaming import events as E

    schema = t.events.schema
    rows = E.source(t.spark, t.folder, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    root = shared_dir(t.spark)
    out = shape(rows)
    if mode == "append":
        E.publish(out, f"{root}/out", f"{root}/state").awaitTermination()
    else:
        E.upsert_batches(out, lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/state", mode).awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{root}/out")


@query("SELECT count(*) AS n FROM events")
def stm_01(t):
    return _stream(t, lambda rows: rows.select("event_id")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stm_02(t):
    return _stream(t, lambda rows: rows.select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, n - n % 5 AS evaluated FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) WHERE n >= 5")
def stm_03(t):
    """Running counters with state, as a stream: the count of each run when it has reached a fifth event more."""
    from cartoflow.streaming.events import counted

    out = _stream(t, lambda rows: counted(rows, "user_id"))
    return out.groupBy("user_id").agg(F.max("evaluated").alias("evaluated"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')")
def stm_04(t):
    from cartoflow.streaming.events import accepted

    return _stream(t, lambda rows: accepted(rows, ("purchase", "signup")).select("event_id", "event_type"))


@query("""WITH steps AS (SELECT value, to_timestamp(5 * unnest(range(CAST(floor(epoch(ts) / 5) AS BIGINT) - 11, CAST(floor(epoch(ts) / 5) AS BIGINT) + 1))) AS w FROM events)
SELECT epoch(w)::BIGINT AS w, max(value) AS max_value FROM steps GROUP BY 1""")
def stm_05(t):
    """The sliding maximum as a stream: windows of 60 s that move by 5 s, each written once, when the watermark passes."""
    from cartoflow.streaming.events import sliding_max

    out = _stream(t, lambda rows: sliding_max(rows).select(F.unix_timestamp("w.start").alias("w"), "max_value"), mode="update")
    return out.groupBy("w").agg(F.max("max_value").alias("max_value"))


@query("SELECT event_type AS stage, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM events GROUP BY 1")
def stm_06(t):
    return t.events.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE event_type END AS kind FROM events),
last AS (SELECT user_id, NULL::BIGINT AS event_id, (SELECT max(ms) - 600000 FROM e) AS ms, 'end' AS kind FROM e GROUP BY 1),
g AS (SELECT *, lag(ms) OVER w AS prev, CASE WHEN lag(ms) OVER w IS NULL THEN 0 ELSE greatest(0, ms - lag(ms) OVER w) // 86400000 END AS due FROM (SELECT * FROM e UNION ALL SELECT * FROM last)
  WINDOW w AS (PARTITION BY user_id ORDER BY kind = 'end', ms, event_id)),
s AS (SELECT *, sum((due > 2)::INT) OVER (PARTITION BY user_id ORDER BY kind = 'end', ms, event_id) AS session FROM g),
n AS (SELECT *, row_number() OVER w + coalesce(sum(CASE WHEN due <= 2 THEN due ELSE 0 END) OVER w, 0) AS seq, coalesce(sum((kind IN ('finished', 'failed'))::INT) OVER (PARTITION BY user_id, session ORDER BY kind = 'end', ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
  FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY kind = 'end', ms, event_id)),
o AS (SELECT *, max(CASE WHEN kind = 'started' THEN ms END) OVER (PARTITION BY user_id, session, part ORDER BY kind = 'end', ms, event_id) AS began, lag(seq) OVER (PARTITION BY user_id ORDER BY kind = 'end', ms, event_id) AS before FROM n)
SELECT user_id, seq::BIGINT AS seq, kind, 'page' AS stage, ms AS "at", CASE WHEN kind IN ('finished', 'failed') THEN ms - began END AS elapsed_ms FROM o WHERE kind <> 'end'
UNION ALL SELECT user_id, (before + k)::BIGINT, 'heartbeat', NULL, prev + k * 86400000, NULL FROM (SELECT *, unnest(range(1, least(due, 2) + 1)) AS k FROM o)
UNION ALL SELECT user_id, (before + 3)::BIGINT, 'done', NULL, prev + 3 * 86400000, NULL FROM o WHERE due > 2""")
def stm_06_lifecycle(t):
    """Stages of runs as a stream with timers: numbers, elapsed times, heartbeats after silent days, ends after two of them."""
    from cartoflow.streaming.lifecycle import lifecycle, state_in_rocksdb

    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    with state_in_rocksdb(t.spark):
        return _stream(t, lambda rows: lifecycle(rows.select("user_id", F.col("event_id").alias("id"), kind.alias("kind"), F.lit("page").alias("stage"), "ts"), "user_id", 86_400_000, 2))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events")
def stm_07(t):
    """A stream that stops and goes on from its checkpoint reads nothing twice."""
    from cartoflow.store.shared import shared_dir
    from cartoflow.streaming import events as E

    root = shared_dir(t.spark)
    for _ in range(2):
        rows = E.source(t.spark, t.folder, "events.parquet", t.events.schema).select("event_id")
        E.publish(rows, f"{root}/out", f"{root}/state").awaitTermination()
    return t.spark.read.parquet(f"{root}/out").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct"))


# -------------------------------------------------------------------------------------------------------- flagship


def ranked(t, limit: int = 50):
    """A keyword's candidates, matched, decided, resolved, conflated, checked, scored and ranked."""
    from cartoflow.operators.relational import ranked as numbered
    from cartoflow.quality.scoring import checks, scored
    from cartoflow.resolve.entities import clusters, golden_records, match_links
    from cartoflow.store.shared import spool

    found = cascade.keyword_match(_candidates(t), ["gym", "hotel"], [r"\bgym\b"], ["fitness", "lodge"])
    rows = cascade.decided(found, GYM).where("outcome <> 'rejected'").withColumns({"decision": F.col("outcome"), "status": F.col("operating_status")})
    # Read several times from here on: decided once, and narrow.
    rows = spool(rows.select("id", "source", "name", "lon", "lat", "phone", "domain", "category", "status", "decision", "p"))
    entities = spool(golden_records(rows, clusters(rows, match_links(rows))))
    entities = entities.withColumns({"name": F.col("canonical_name"), "phone": F.try_element_at("phones_e164", F.lit(1)), "email": F.lit(None).cast("string"), "website": F.col("website_domain"), "website_ok": F.lit(None).cast("boolean")})
    out = scored(entities, checks(entities)).withColumn("distance_m", F.round(geo.haversine_m(F.col("lon"), F.col("lat"), F.lit(77.75), F.lit(12.97)), 1))
    return numbered(out, [F.desc("confidence"), "distance_m", "id"], limit).select("rank", "id", "canonical_name", "decision", "confidence", "tier", "distance_m", "independent_source_count")


@query()
def ranked_entities(t):
    return ranked(t)

