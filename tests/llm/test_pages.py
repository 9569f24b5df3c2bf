"""Main text of the pages table against a plain rule that knows where these pages keep their article."""

import html
import re

import pyarrow.parquet as pq

from shelfwise.llm.htmltext import extract, trained


def article(page):
    """Lines of the article element, by regular expressions alone."""
    inner = re.search(r"(?s)<article\b[^>]*>(.*)</article>", page)
    if inner is None:
        return None
    text = re.sub(r"(?s)<!--.*?-->|<(script|style|aside|nav|form|footer)\b.*?</\1>", "", inner[1])
    text = re.sub(r"<br\b[^>]*>", " ", text)
    text = re.sub(r"</?(?:p|h[1-6]|ul|ol|li|div|section|table|tr|td|th|pre|blockquote|figure|figcaption)\b[^>]*>", "\0", text)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in text.split("\0")]
    return "\n".join(x for x in lines if x)


def test_pages_give_their_article():
    pages = [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist() if x]
    want = [article(x) for x in pages]
    known = [(x, w) for x, w in zip(pages, want) if w is not None]
    assert len(known) > 0.9 * len(pages)
    found = extract([x for x, _ in known], trained())
    wrong = [(f, w) for f, (_, w) in zip(found, known) if f != w]
    assert len(wrong) <= 0.01 * len(known), wrong[0]
