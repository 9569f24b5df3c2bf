"""Fields of product cards from markup: nesting, entities, attributes in any order, and broken markup."""

import pytest

from shelfwise.sources import cards
from shelfwise.sources.cards import Select, elements

ITEM = """<div data-x="1" class="a product-item_product-item__BWbnO">
 <a aria-label="Label" href="/p/{n}" class="product-item_product-item__details__wi7dH x"><p class="product-item_product-item__name__piwWX">{name}</p></a>
 <a class="product-item_product-item__img-link__FJWGM" href="/other"><img alt='Alt' src="/_next/image?url=https%3A%2F%2Fcdn%2F{n}.jpg&amp;w=1"></a>
 <div class="product-item_product-item__blurbs__yInZN"><span class="blurb_blurb__oN_zE">Buy <b>2</b></span><span class="blurb_blurb__oN_zE"> </span><span class="blurb_blurb__oN_zE">New</span></div>
 <div>{prices}</div></div>"""
NOW = '<span class="product-price_product-price__price__qk_1n">$<em>{}</em></span>'
BEFORE = '<span class="x price--original_z product-price_product-price__price__qk_1n">S${}</span>'


def pages(spark, *html):
    return spark.createDataFrame([(i, h, "c") for i, h in enumerate(html)], "page int, html string, category_slug string")


def item(n, name, prices):
    return ITEM.format(n=n, name=name, prices=prices)


def test_item_cards(spark):
    first = item(1, "Dr <b>Oetker</b> Pizza&nbsp;&amp; Pie <!-- no -->500g", BEFORE.format("9.50") + NOW.format("7.20") + NOW.format("1"))
    again = item(1, "Same address", NOW.format("3"))
    no_name = ITEM.format(n=2, name=" ", prices=NOW.format("4.00"))
    no_price = item(3, "No price", BEFORE.format("2") + NOW.format("soon"))
    html = f"<html><body><ul><li>{first}<li>{no_name}{again}</ul>{no_price}</body>"
    got = {r.product_url: r for r in cards.card_listings(pages(spark, html, again, None, ""), "coldstorage").collect()}
    assert set(got) == {f"{cards.ITEM_BASE}/p/{n}" for n in (1, 2)}
    one = got[f"{cards.ITEM_BASE}/p/1"]
    assert (one.page, one.category_slug, one.name, one.brand, one.unit) == (0, "c", "Dr Oetker Pizza & Pie 500g", "Dr Oetker", "500g")
    assert (one.price_sgd, one.original_price_sgd, one.discount_sgd) == (7.2, 9.5, 2.3)
    assert (one.promo_text, one.image_url) == ("Buy 2 | New", "https://cdn/1.jpg")
    assert got[f"{cards.ITEM_BASE}/p/2"].name == "Label"


def test_preview_cards(spark):
    card = '<a href="/product/{n}" class="x product-preview"><div><div class="product-name">{name}</div><div class="product-packSize">1 L</div>{price}</div></a>'
    promo = '<div class="product-price"><span class="promo-price">$2.<sup>50</sup></span> <s class="previous-price">$3.00</s></div>'
    plain = "<div class=product-price><span>S$1,204.10</span></div>"
    html = card.format(n=1, name="Milk &lt;Full&gt;", price=promo) + card.format(n=2, name="Tea", price=plain) + card.format(n=3, name="", price=plain)
    html += card.format(n=4, name="No block", price="") + card.format(n=5, name="Free", price="<div class='product-price'><span>0.00</span></div>") + card.format(n=2, name="Tea", price=plain)
    got = sorted((r.name, r.price_sgd, r.original_price_sgd, r.discount_sgd, r.unit, r.product_url) for r in cards.card_listings(pages(spark, html), "shengsiong").collect())
    base = got[0][5].rsplit("/product", 1)[0]
    assert base.startswith("https://")
    assert got == [("Milk <Full>", 2.5, 3.0, 0.5, "1 L", f"{base}/product/1"), *[("Tea", 1204.1, None, None, "1 L", f"{base}/product/2")] * 2]


def test_no_pages(spark):
    assert cards.card_listings(pages(spark, "x").limit(0), "coldstorage").collect() == []
    assert cards.card_listings(pages(spark, "<p>none", None), "shengsiong").collect() == []


def test_elements_of_broken_markup():
    root = elements("<div><p>a<span>b</div>c</p><br>d</b><img class='x y'><script>if (a < b) '</p>'</script>e")
    assert root.text() == "abc de" and [e.tag for e in root.below()] == ["div", "p", "span", "br", "img", "script"]
    assert root.find(Select("img", "y")) is not None and root.find(Select("img", without="x")) is None
    deep = elements("<b>" * 50_000 + "x" + "</b>" * 50_000)
    assert deep.text() == "x" and sum(1 for _ in deep.below()) == 50_000


@pytest.mark.parametrize("text,value", [("$1.20", 1.2), ("S$ 1,204", 1204.0), ("1.2.3", 1.2), (".5 off", 0.5), (".", None), ("", None), (None, None), ("٣", None), ("12.", 12.0)])
def test_shown_numbers(text, value):
    assert cards.shown_number(text) == value


def test_nested_selectors_take_each_element_once():
    root = elements('<div class="o"><div class="o"><i class="i">1</i></div><i class="i">2</i></div><i class="i">3</i>')
    assert [e.text() for e in root.find_all(Select(token="o"), Select(token="i"))] == ["1", "2"]
