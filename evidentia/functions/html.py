"""One pass over HTML for what expressions cannot read: title, text, links, structured data, meta tags, languages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_STRINGS = pa.list_(pa.string())
FIELDS = {
    "title": ("string", pa.string()), "meta_description": ("string", pa.string()), "text": ("string", pa.string()), "links": ("array<string>", _STRINGS), "ldjson": ("array<string>", _STRINGS),
    "metas": ("array<struct<name:string,content:string>>", pa.list_(pa.struct([("name", pa.string()), ("content", pa.string())]))), "langs": ("array<string>", _STRINGS),
}
SCHEMA = ", ".join(f"{name} {kind}" for name, (kind, _) in FIELDS.items())
_HIDDEN = {"script", "style", "noscript"}
#: Tags whose contents the parser reads in another way, in this or in later versions of it.
_RAW = {"script", "style", "title", "textarea", "noscript", "plaintext", "xmp", "iframe", "noembed", "noframes"}
#: Tags that each field is taken from; the other fields need all tags and all text.
_TAGS = {"links": {"a"}, "ldjson": set(), "metas": {"meta"}, "langs": {"html", "link"}}
_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*")
#: Letters of HTML that are parsed before their rows are handed on; a longer page is handled alone.
_LETTERS = 1 << 18


def _plain_run(wanted: frozenset[str]) -> re.Pattern:
    """Text, end tags, and well-formed start tags of names that nothing is taken from, as far as they go on."""
    name = rf"(?!(?:{'|'.join(sorted(wanted))})[\s/>])[a-zA-Z][a-zA-Z0-9]*+"
    return re.compile(rf"""(?:[^<]*+<(?:/[a-zA-Z][a-zA-Z0-9]*+>|{name}(?:\ [a-zA-Z][a-zA-Z-]*+="[^"]*+")*+>))*+""", re.IGNORECASE | re.ASCII)


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.inside, self.texts, self.title, self.script = url, [], [], None, None
        self.links, self.ldjson, self.metas, self.langs = [], [], [], []

    def updatepos(self, i, j):
        """Lines are not counted."""
        return j

    def _language(self, value: str | None):
        short = (value or "").split("-")[0].lower()
        if len(short) == 2 and short not in self.langs:
            self.langs.append(short)

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in _HIDDEN or tag == "title":
            self.inside.append(tag)
            if tag == "script" and "ld+json" in (own.get("type") or ""):
                self.script = []
        elif tag == "html":
            self._language(own.get("lang"))
        elif tag == "link" and "alternate" in (own.get("rel") or "") and own.get("hreflang") != "x-default":
            self._language(own.get("hreflang"))
        elif tag == "meta":
            self.metas.append((own.get("name") or own.get("property") or own.get("itemprop"), own.get("content")))
        elif tag == "a" and own.get("href"):
            try:
                self.links.append(urldefrag(urljoin(self.url, own["href"]))[0])
            except ValueError:
                pass
        self.texts.append(" ")

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside = self.inside[: len(self.inside) - 1 - self.inside[::-1].index(tag)]
        if tag == "script" and self.script is not None:
            self.ldjson.append("".join(self.script))
            self.script = None
        self.texts.append(" ")

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif self.inside[-1:] == ["title"]:
            self.title = (self.title or "") + data
        elif not self.inside:
            self.texts.append(data)

    def row(self):
        described = [c for n, c in self.metas if (n or "").lower() == "description" and c]
        title = " ".join(self.title.split()) if self.title is not None else None
        return (title, described[0] if described else None, " ".join("".join(self.texts).split()), self.links, self.ldjson, self.metas, self.langs)


class _Tags(_Page):
    """A page of which only some tags are read: whatever stands between them is passed over in one step where it is plain, else parsed."""

    def __init__(self, url: str, wanted: frozenset[str], plain: re.Pattern):
        super().__init__(url)
        self.wanted, self.plain = wanted, plain

    def _after(self, k: int) -> int:
        return self.plain.match(self.rawdata, k).end() if k > 0 and self.cdata_elem is None else k

    def parse_starttag(self, i):
        read = _NAME.match(self.rawdata, i + 1)[0].lower() in self.wanted
        return self._after(super().parse_starttag(i) if read else self.check_for_whole_start_tag(i))

    def parse_endtag(self, i):
        return self._after(super().parse_endtag(i))


def _fields(names: tuple[str, ...]):
    """A function of URL and HTML that gives the named fields of a page."""
    if all(n in _TAGS for n in names):
        wanted = frozenset(_RAW.union(*[_TAGS[n] for n in names]))
        plain = _plain_run(wanted)
        page = lambda url: _Tags(url, wanted, plain)
    else:
        page = _Page
    places = [list(FIELDS).index(n) for n in names]

    def read(url: str | None, html: str | None) -> tuple:
        own = page(url or "")
        own.feed(html or "")
        own.close()
        row = own.row()
        return tuple(row[k] for k in places)

    return read


def parse(url: str | None, html: str | None) -> tuple:
    return _fields(tuple(FIELDS))(url, html)


def parsed(batches: Iterator[tuple[pa.Array, pa.Array]], names: tuple[str, ...]) -> Iterator[pa.Array]:
    """The named fields of batches of URLs and pages, handed on whenever pages of _LETTERS letters are read."""
    read, kinds = _fields(names), [FIELDS[n][1] for n in names]

    def rows(found: list[tuple]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], list(names))

    for urls, pages in batches:
        found, letters = [], 0
        for u, h in zip(urls, pages):
            h = h.as_py() or ""
            if found and letters + len(h) > _LETTERS:
                yield rows(found)
                found, letters = [], 0
            found.append(read(u.as_py(), h))
            letters += len(h)
        yield rows(found)


def parse_html(url: Column, html: Column, *fields: str) -> Column:
    """A struct of SCHEMA for each page, or of the named fields of it; null pages have no title and empty text. A worker holds one Arrow batch of
    pages and what it took from a few of them. Links, JSON-LD, meta tags and languages alone are read without the rest of the page."""
    names = fields or tuple(FIELDS)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return parsed(batches, names)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<" + ", ".join(f"{n}:{FIELDS[n][0]}" for n in names) + ">")(url, html)


def structured_data(ldjson: Column) -> Column:
    """E-mail addresses, telephone numbers, tax ids and postal addresses of JSON-LD blocks: arrays in a struct."""
    items = F.flatten(
        F.transform(
            ldjson,
            lambda text: F.coalesce(
                F.from_json(F.get_json_object(text, "$.@graph"), "array<string>"),
                F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")),
                F.array(text),
            ),
        )
    )
    pick = lambda *paths: F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(items, lambda x: F.array(*[F.get_json_object(x, p) for p in paths]))), lambda v: v.isNotNull() & (v != ""))))
    address = F.transform(items, lambda x: F.filter(F.array(*[F.get_json_object(x, f"$.address.{k}") for k in ("streetAddress", "postalCode", "addressLocality", "addressCountry")]), lambda v: v.isNotNull() & (v != "")))
    return F.struct(
        F.transform(pick("$.email", "$.contactPoint.email"), lambda v: F.regexp_replace(F.lower(v), "^mailto:", "")).alias("emails"),
        pick("$.telephone", "$.contactPoint.telephone").alias("phones"),
        pick("$.taxID", "$.vatID").alias("tax_ids"),
        F.array_sort(F.array_distinct(F.transform(F.filter(address, lambda p: F.size(p) >= 2), lambda p: F.array_join(p, ", ")))).alias("addresses"),
    )
