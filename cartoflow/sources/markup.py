"""Structured data of web pages: JSON-LD and microdata, read tag by tag.

A tokenizer walks a page once with a stack of open elements.  An element with ``itemscope`` opens an item: a property of the
item around it if it has ``itemprop`` too, else one of the page's own.  Values are as the microdata standard has them: the
content of ``meta``, the address of links and media, the value of ``data`` and ``meter``, the time of ``time``, the text of
anything else.  Elements that are never closed end with the element around them.  Scripts of type ``application/ld+json`` give
their objects, those of lists and of ``@graph`` one by one; what is no JSON gives nothing.

The stack is as deep as the page nests, and a page is in memory as a row is anyway.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the markup standards: elements without an end, and where other elements have their value.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
VALUE_IN = {"meta": "content", "a": "href", "area": "href", "link": "href", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src", "video": "src", "object": "data", "data": "value", "meter": "value", "time": "datetime"}
# Kinds of items that are about a business.
KINDS = ("localbusiness", "store", "organization", "restaurant", "place")


class _Element:
    __slots__ = ("tag", "item", "props", "owner", "text")

    def __init__(self, tag: str, item: dict | None, props: list[str], owner: dict | None, text: list[str] | None):
        self.tag, self.item, self.props, self.owner, self.text = tag, item, props, owner, text


class Markup(HTMLParser):
    """Items of a page, in order: ``linked`` (JSON-LD) and ``micro``; both with ``@type``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.linked: list[dict] = []
        self.micro: list[dict] = []
        self.stack: list[_Element] = []
        self.script: list[str] | None = None

    def _item(self) -> dict | None:
        return next((e.item for e in reversed(self.stack) if e.item is not None), None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(reversed(attrs))  # of equal attributes the first counts
        if tag == "script" and (a.get("type") or "").split(";")[0].strip().lower() == "application/ld+json":
            self.script = []
        props, owner, item, text = (a.get("itemprop") or "").split(), self._item(), None, None
        if "itemscope" in a:
            item = {"@type": (a.get("itemtype") or "").split()[:1]}
            if props and owner is not None:
                self._add(owner, props, item)
            else:
                self.micro.append(item)
        elif props and owner is not None:
            value = a.get(VALUE_IN.get(tag, ""))
            if value is not None or tag in VOID:
                self._add(owner, props, (value or "").strip())
            else:
                text = []
        if tag not in VOID:
            self.stack.append(_Element(tag, item, props, owner, text))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _add(self, owner: dict, props: list[str], value: str | dict) -> None:
        for p in props:
            owner.setdefault(p, []).append(value)

    def _close(self, element: _Element) -> None:
        if element.text is not None:
            self._add(element.owner, element.props, " ".join("".join(element.text).split()))

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.script is not None:
            self._read("".join(self.script))
            self.script = None
        if any(e.tag == tag for e in self.stack):
            while True:
                element = self.stack.pop()
                self._close(element)
                if element.tag == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)
            return
        if self.stack and self.stack[-1].tag in ("script", "style"):
            return
        for e in self.stack:
            if e.text is not None:
                e.text.append(data)

    def _read(self, text: str) -> None:
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            return
        for x in found if isinstance(found, list) else [found]:
            graph = x.get("@graph") if isinstance(x, dict) else None
            self.linked += [y for y in (graph if isinstance(graph, list) else [x]) if isinstance(y, dict)]

    def done(self) -> list[dict]:
        self.close()
        while self.stack:
            self._close(self.stack.pop())
        return self.linked + self.micro


def _many(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _text(value) -> str | None:
    """A value as text: of an address its street, of other objects their parts."""
    if isinstance(value, dict):
        street = [t for t in map(_text, _many(value.get("streetAddress"))) if t]
        return street[0] if street else ", ".join(t for k, v in value.items() if not k.startswith("@") for t in map(_text, _many(v)) if t) or None
    return None if value is None else str(value).strip() or None


def business(html: str) -> dict:
    """First name and address, all phones and mails (each once, in order), and how many items of business kinds there are."""
    page = Markup()
    page.feed(html)
    out: dict = {"name": None, "address": None, "phones": [], "emails": [], "n_items": 0}
    for item in page.done():
        kind = " ".join(map(str, _many(item.get("@type")))).lower()
        if not any(k in kind for k in KINDS):
            continue
        out["n_items"] += 1
        first = lambda key, item=item: next((t for t in map(_text, _many(item.get(key))) if t), None)
        out["name"] = out["name"] or first("name")
        out["address"] = out["address"] or first("address")
        out["phones"] += [t for t in map(_text, _many(item.get("telephone"))) if t]
        out["emails"] += [t.lower() for t in map(_text, _many(item.get("email"))) if t]
    return out | {k: list(dict.fromkeys(out[k])) for k in ("phones", "emails")}


def marked_up(pages: DataFrame, key: str) -> DataFrame:
    """(key, name, address, phones, emails, n_items), a row for each page with an item of a business kind."""
    fields = pa.schema([("name", pa.string()), ("address", pa.string()), ("phones", pa.list_(pa.string())), ("emails", pa.list_(pa.string())), ("n_items", pa.int32())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [business(x) if x and ("itemscope" in x.lower() or "ld+json" in x.lower()) else {"n_items": 0} for x in part.column("html").to_pylist()]
                hit = [i for i, x in enumerate(found) if x["n_items"]]
                rows = pa.RecordBatch.from_pylist([found[i] for i in hit], schema=fields)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(hit, pa.int64())), *rows.columns], names=["key", *fields.names])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.selectExpr(f"`{key}` AS key", "html").mapInArrow(each, f"key {kind}, name string, address string, phones array<string>, emails array<string>, n_items int")
    return out.withColumnRenamed("key", key)
