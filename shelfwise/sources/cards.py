"""Listings from the markup of product cards: elements by tag, class and attribute, whatever is nested in them.

Python reads the markup of a page into elements, one page at a time, and finds the fields of its cards;
what the fields mean (urls, brands, units, discounts, repeated listings) is left to columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C

#: Elements without an end tag, and those whose text is not shown (fixed values of HTML).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "template", "noscript"}


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def below(self) -> Iterator[Element]:
        """All elements inside, in the order of their start tags."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def find(self, *wanted: Select) -> Element | None:
        """The first element inside that the last selector takes, inside ones that the others take."""
        return next(self.find_all(*wanted), None)

    def find_all(self, *wanted: Select) -> Iterator[Element]:
        if len(wanted) == 1:
            yield from (e for e in self.below() if wanted[0].takes(e))
            return
        seen: set[int] = set()
        for outer in self.find_all(wanted[0]):
            for e in outer.find_all(*wanted[1:]):
                if id(e) not in seen:
                    seen.add(id(e))
                    yield e

    def text(self) -> str:
        """The text inside with that of all nested elements, white space squeezed."""
        parts, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                parts.append(e)
            elif e.tag == "br":
                parts.append(" ")
            elif e.tag not in HIDDEN:
                stack += reversed(e.children)
        return " ".join("".join(parts).split())


@dataclass(frozen=True)
class Select:
    """Takes elements of a tag (any if empty) with a class (any if empty) and without another."""

    tag: str = ""
    token: str = ""
    without: str = ""

    def takes(self, e: Element) -> bool:
        return (not self.tag or e.tag == self.tag) and (not self.token or self.token in e.classes) and (not self.without or self.without not in e.classes)


class _Reader(HTMLParser):
    """Builds elements; an end tag closes the nearest open element of its name, others close with what holds them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]
        self.depth: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)})  # of a repeated attribute the first counts
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag):
        if not self.depth.get(tag):
            return
        while True:
            e = self.open.pop()
            self.depth[e.tag] -= 1
            if e.tag == tag:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def elements(html: str) -> Element:
    """The root of a page's or fragment's elements."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def shown_number(text: str | None) -> float | None:
    """The number at the start of what is left of a text without all but digits and points."""
    found = re.match(r"[0-9]+\.?[0-9]*|\.[0-9]+", re.sub(r"[^0-9.]", "", text or ""))
    return float(found[0]) if found else None


def _text(e: Element | None) -> str | None:
    return e.text() if e is not None else None


def _attribute(e: Element | None, *names: str) -> str | None:
    """The first of the attributes that says something."""
    return next((v for n in names if e is not None and (v := e.attributes.get(n))), None)


# Classes of two stores' pages.


def preview_cards(page: Element) -> Iterator[dict]:
    """Cards that are links with a price block: a promoted price counts before the regular one."""
    for card in page.find_all(Select(token="product-preview")):
        block = card.find(Select(token="product-price"))
        if block is None:
            continue
        now = block.find(Select(token="promo-price")) or block.find(Select("span", without="promo-price"))
        yield {
            "name": _text(card.find(Select(token="product-name"))),
            "price_sgd": shown_number(_text(now)),
            "original_price_sgd": shown_number(_text(block.find(Select(token="previous-price")))),
            "unit": _text(card.find(Select(token="product-packSize"))),
            "product_url": _attribute(card, "href"),
        }


def item_cards(page: Element) -> Iterator[dict]:
    """Cards with links to details and image; of the prices the first counts that is not marked as the former one."""
    of = lambda name: f"product-item_product-item__{name}"
    for card in page.find_all(Select("div", of("BWbnO"))):
        details, image = card.find(Select("a", of("details__wi7dH"))), card.find(Select("img"))
        now = before = None
        for e in card.find_all(Select(token="product-price_product-price__price__qk_1n")):
            value = shown_number(e.text())
            if value is None:
                continue
            if "price--original" in e.attributes.get("class", ""):
                before = value
            elif now is None:
                now = value
        promos = [t for e in card.find_all(Select(token=of("blurbs__yInZN")), Select(token="blurb_blurb__oN_zE")) if (t := e.text())]
        yield {
            "name": _text(card.find(Select("p", of("name__piwWX")))) or _attribute(details, "aria-label") or _attribute(image, "alt"),
            "price_sgd": now,
            "original_price_sgd": before,
            "promo_text": " | ".join(promos) or None,
            "product_url": _attribute(details, "href") or _attribute(card.find(Select("a", of("img-link__FJWGM"))), "href"),
            "image_url": _attribute(image, "src", "data-src"),
        }


CARDS = {"shengsiong": preview_cards, "coldstorage": item_cards}
FIELDS = ["name", "price_sgd", "original_price_sgd", "unit", "promo_text", "product_url", "image_url"]
SCHEMA = "array<struct<" + ", ".join(f"{f}: {'double' if f.endswith('_sgd') else 'string'}" for f in FIELDS) + ">>"
#: Fixed value: where relative addresses of one store start.
ITEM_BASE = "https://coldstorage.com.sg"


def cards_in(html: Column, store: str) -> Column:
    """The cards of each page's markup in order, as an array of structs of FIELDS; none for null."""
    found = CARDS[store]

    def read(page: str | None):
        return [tuple(card.get(f) for f in FIELDS) for card in found(elements(page))] if page else []

    return F.udf(read, SCHEMA, useArrow=True)(html)


def card_listings(pages: DataFrame, store: str, html: str = "html", order: list[str] | None = None) -> DataFrame:
    """Listings of a store's pages, one for each address: columns of ``pages`` but the markup, and the fields.

    Listings without a name or a price are left out, of one store also those without an address. Of
    several listings of an address the first counts, in the order of pages and within them.
    """
    order = order or [c for c in pages.columns if c != html]
    kept = [c for c in pages.columns if c not in (html, *FIELDS)]
    rows = pages.select(*kept, F.posexplode(cards_in(F.col(html), store)).alias("_at", "card")).select(*kept, "_at", "card.*").withColumn("name", C.clean_text(F.col("name")))
    price, before = F.col("price_sgd"), F.col("original_price_sgd")
    if store == "shengsiong":
        rows = rows.filter("name is not null and price_sgd <> 0")
        discount = F.when(before != 0, F.round(before - price, 2))
        return rows.withColumns({"brand": F.lit(None).cast("string"), "discount_sgd": discount, "product_url": C.clean_product_url(F.col("product_url"), F.lit(store))}).drop("_at")
    rows = rows.withColumns({"product_url": C.absolute_url(F.col("product_url"), ITEM_BASE), "image_url": C.source_image_url(F.col("image_url"))})
    rows = rows.filter("name is not null and price_sgd is not null and product_url is not null")
    rows = rows.withColumns({"brand": C.infer_brand_from_name(F.col("name")), "unit": C.unit_from_name(F.col("name")), "discount_sgd": C.compute_discount(price, before)})
    first = Window.partitionBy("product_url").orderBy(*order, "_at")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_at")
