"""Structured data from pages: nesting, several items, attribute order, open tags, entities, broken JSON."""

from cartoflow.sources.markup import Markup, business, marked_up


def items(html):
    page = Markup()
    page.feed(html)
    return page.done()


def test_microdata_nests():
    html = """<div itemtype="https://schema.org/LocalBusiness" class=x itemscope><h1 ITEMPROP='name alternateName'>The <b>Big</b> &amp; small
      shop<script>var a = "<p>";</script></h1>
      <p>Call <span itemprop=telephone>+91 1</span><div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress">
      <meta itemprop="name" content="inner"><span itemprop="streetAddress">1 Main</span></div>
      <a itemprop="url" href="/x">text</a><time itemprop="opens" datetime="09:00">nine</time><time itemprop="closes">18:00</time><img itemprop=image src=a.png></div><i itemprop="name">stray</i>"""
    assert items(html) == [{"@type": ["https://schema.org/LocalBusiness"], "name": ["The Big & small shop"], "alternateName": ["The Big & small shop"], "telephone": ["+91 1"], "address": [{"@type": ["https://schema.org/PostalAddress"], "name": ["inner"], "streetAddress": ["1 Main"]}], "url": ["/x"], "opens": ["09:00"], "closes": ["18:00"], "image": ["a.png"]}]
    assert business(html) == {"name": "The Big & small shop", "address": "1 Main", "phones": ["+91 1"], "emails": [], "n_items": 1}


def test_items_beside_and_in_each_other():
    html = """<ul itemscope itemtype="http://schema.org/ItemList"><li itemscope itemtype="http://schema.org/Store"><b itemprop="name">a<li itemscope
      itemtype="http://schema.org/Store"><b itemprop="name">b</ul><div itemscope><span itemprop="name">none</span></div>"""
    found = items(html)
    assert [x["@type"] for x in found] == [["http://schema.org/ItemList"], ["http://schema.org/Store"], ["http://schema.org/Store"], []]
    assert business(html)["n_items"] == 2


def test_json_ld():
    html = """<script type="application/ld+json; charset=utf-8">[{"@type": "Event", "name": "e"}, {"@type": ["Thing", "Restaurant"], "name": " r ", "telephone": ["1", 2, "1"], "email": "A@X.in",
      "address": {"@type": "PostalAddress", "addressLocality": "Pune", "postalCode": 411}}]</script><script type="application/ld+json">{broken</script>
      <script type='application/ld+json'>{"@graph": [{"@type": "Organization", "name": "o", "address": "somewhere"}, 3]}</script><script>{"@type": "Place"}</script>"""
    assert business(html) == {"name": "r", "address": "Pune, 411", "phones": ["1", "2"], "emails": ["a@x.in"], "n_items": 2}


def test_json_comes_before_microdata():
    html = '<p itemscope itemtype="x/Store"><b itemprop="name">m</b></p><script type="application/ld+json">{"@type": "Store", "name": "j"}</script>'
    assert business(html)["name"] == "j" and business(html)["n_items"] == 2


def test_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>plain"), (4, '<p itemscope itemtype="x/Store"><b itemprop="name">é' + "x" * 100_000), (5, "<" * 1000 + "itemscope"), (None, '<div itemtype="Place" itemscope>')]
    got = marked_up(spark.createDataFrame(rows, "id long, html string"), "id").collect()
    assert sorted((str(r["id"]), len(r["name"] or ""), r["n_items"]) for r in got) == [("4", 100_001, 1), ("None", 0, 1)]
    assert marked_up(spark.createDataFrame([], "id long, html string"), "id").collect() == []
