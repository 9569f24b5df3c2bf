"""Main text of HTML pages by boosted trees over the DOM, decoded from the root down.

Every node of a page, text segments included, is scored as wholly main text, wholly something else, or
mixed. The trees look at its tag and attribute words (as log-odds learnt in training), those of its
parent, ancestors and descendants, at depth, text, link and markup density of its subtree, and at its
siblings. Decoding finds the best labelling in which everything below a node of one kind is of that
kind and only mixed nodes hold both: one pass up the tree adds the best values of the children, one
pass down reads off the choices.

The trees are fitted on pages built here at random, whose main text is known by construction: articles
in many wrappings among menus, headers, footers, sidebars, notices, adverts, forms and comments.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import batches_by_bytes, table
from .htmltree import Forest, joined, parts

#: Pages that the trees are fitted on, and the seed they are built from.
TRAINING_PAGES, SEED = 700, 7
#: HTML bytes that are parsed together.
STEP = 4 << 20
MAIN, OTHER, MIXED = 0, 1, 2


@dataclass
class Model:
    tag_odds: dict[str, float]
    word_odds: dict[str, float]
    trees: Trees


def _fold_up(values: np.ndarray, parent: np.ndarray, depth: np.ndarray, how) -> np.ndarray:
    """Combine each node's value with those of all nodes below it."""
    out = values.copy()
    for level in _levels(depth)[:0:-1]:
        how.at(out, parent[level], out[level])
    return out


def _fold_down(values: np.ndarray, parent: np.ndarray, depth: np.ndarray, how) -> np.ndarray:
    """Combine each node's value with those of all nodes above it."""
    out = values.copy()
    for level in _levels(depth)[1:]:
        out[level] = how(out[level], out[parent[level]])
    return out


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def features(forest: Forest, a: dict[str, np.ndarray], tag_odds: dict[str, float], word_odds: dict[str, float]) -> np.ndarray:
    """A row per feature, a column per node."""
    n = len(forest.texts)
    tag, end, depth = a["tag"], a["end"], a["depth"]
    parent = np.maximum(a["parent"], 0)
    names = list(forest.tags)
    own_tag = np.array([tag_odds.get(x, 0.0) for x in names])[tag]
    own_attr = np.array([float(np.clip(sum(word_odds.get(w, 0.0) for w in set(parts(x))), -8, 8)) for x in forest.attrs])[a["attr"]]
    is_text = tag == 0
    lengths = np.array([len(x) if x is not None and not x.isspace() else 0 for x in forest.texts], np.float64)
    segments = (lengths > 0).astype(np.float64)
    points = np.array([x.count(".") + x.count(",") if x is not None and len(x) > 1 else 0 for x in forest.texts], np.float64)
    flag = lambda *which: np.isin(tag, [forest.tags[x] for x in which if x in forest.tags])
    inside_link = _fold_down(flag("a", "button").astype(np.float64), parent, depth, np.maximum) > 0
    sums = {}
    for k, v in {"chars": lengths, "links": lengths * inside_link, "tags": (~is_text).astype(float), "segments": segments, "points": points, "paras": flag("p").astype(float), "controls": flag("input", "select", "button", "textarea", "option", "label").astype(float)}.items():
        c = np.r_[0.0, np.cumsum(v)]
        sums[k] = c[end] - c[np.arange(n)]
    page = np.zeros(n, np.int64)
    page[forest.first] = 1
    root = np.array(forest.first, np.int64)[np.cumsum(page) - 1]
    total = np.maximum(sums["chars"][root], 1)
    before = np.r_[0.0, np.cumsum(lengths)][np.arange(n)]
    before -= before[root]
    both = own_tag + own_attr
    elements = ~is_text | (lengths > 0)
    size = np.bincount(parent[elements], minlength=n).astype(np.float64)
    count = np.cumsum(elements)
    # number among the siblings: nodes of one parent in page order
    order = np.lexsort((np.arange(n), parent))
    rank = np.empty(n)
    starts = np.r_[True, parent[order][1:] != parent[order][:-1]]
    rank[order] = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    chars = sums["chars"]
    density = chars / (sums["tags"] + 1)
    sibling_density = np.bincount(parent, density * (np.arange(n) != root), minlength=n)[parent] / np.maximum(1, np.bincount(parent, minlength=n)[parent])
    del count
    return np.stack([
        own_tag, own_attr, own_tag[parent], own_attr[parent],
        _fold_down(both, parent, depth, np.minimum), _fold_down(both, parent, depth, np.maximum),
        _fold_up(both, parent, depth, np.minimum), _fold_up(both, parent, depth, np.maximum),
        depth.astype(float), np.log1p(chars), sums["links"] / np.maximum(chars, 1), np.log1p(density),
        np.log1p(sums["tags"]), chars / total, before / total, sums["points"] / np.maximum(chars, 1),
        size[parent], rank / np.maximum(1, size[parent]), chars / np.maximum(1, chars[parent]),
        np.log1p(sums["paras"]), np.log1p(sums["controls"]), is_text.astype(float),
        chars / np.maximum(1, sums["segments"]), np.log1p(sibling_density), np.log1p(chars[parent]), inside_link.astype(float),
    ])


def decode(logs: np.ndarray, parent: np.ndarray, depth: np.ndarray, is_text: np.ndarray) -> np.ndarray:
    """Whether each node is main text, in the best labelling without contradictions."""
    main, other, mixed = logs[MAIN].copy(), logs[OTHER].copy(), np.where(is_text, -np.inf, logs[MIXED])
    levels = _levels(depth)
    for level in levels[:0:-1]:
        up = parent[level]
        np.add.at(main, up, main[level])
        np.add.at(other, up, other[level])
        np.add.at(mixed, up, np.maximum(np.maximum(main[level], other[level]), mixed[level]))
    own = np.argmax(np.stack([main, other, mixed]), axis=0)
    for level in levels[1:]:
        above = own[parent[level]]
        own[level] = np.where(above == MIXED, own[level], above)
    return own == MAIN


def extract(pages: list[str], model: Model) -> list[str]:
    forest = Forest()
    for page in pages:
        forest.add(page)
    a = forest.arrays()
    if not len(forest.texts):
        return []
    logs = model.trees.log_probabilities(features(forest, a, model.tag_odds, model.word_odds))
    blank = np.array([x is None or x.isspace() for x in forest.texts])
    # what holds no text has no say
    logs[:, _sum_below((~blank).astype(float), a["end"]) == 0] = 0
    chosen = decode(logs, np.maximum(a["parent"], 0), a["depth"], a["tag"] == 0)
    edges = forest.first + [len(forest.texts)]
    # white space stays with whatever of its block stays
    wanted = np.flatnonzero((chosen | blank) & np.array([x is not None for x in forest.texts]))
    at = np.searchsorted(wanted, edges)
    blocks, nodes = a["block"][wanted].tolist(), wanted.tolist()
    return [joined([forest.texts[i] for i in nodes[s:e]], blocks[s:e]) for s, e in zip(at[:-1], at[1:])]


# Training pages.

SYLLABLES = "an ba che do el fi gro ha in jo ka lu me no ov pra qui re st tu un ve wi xo yl za th er ion ing ent".split()
#: Marks a block as main text; the model never sees it.
MARK = "zzmain"

#: Attribute words of page furniture by kind, and of wrappings of main text.
FURNITURE = {
    "nav": (["nav", "ul", "div", "menu"], "nav navigation menu navbar breadcrumb breadcrumbs topnav links toc pagination pager skip tabs"),
    "header": (["header", "div"], "header masthead top topbar banner branding logo site title tagline hero"),
    "footer": (["footer", "div"], "footer bottom copyright legal colophon credits siteinfo foot"),
    "sidebar": (["aside", "div", "section"], "sidebar side aside widget related recommended rail secondary trending popular recent more tags"),
    "notice": (["div", "p", "section", "dialog"], "notice cookie cookies consent gdpr alert message popup modal overlay disclaimer warning subscribe paywall"),
    "advert": (["div", "aside", "section"], "ad ads advert advertisement adsense sponsor sponsored promo promotion banner affiliate dfp"),
    "form": (["form", "div"], "form search newsletter signup login subscribe contact searchform"),
    "comments": (["section", "div", "ol", "aside"], "comments comment commentlist respond discussion replies disqus thread reader responses"),
    "share": (["div", "ul"], "share social sharing follow buttons twitter facebook likes"),
}
WRAPPINGS = "content main article post entry story body text page document detail prose single hentry"


def _words(r: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(r.randint(low, high)):
        w = "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))
        out.append(w + r.choice(["", "", "", "", "", ",", "."]))
    text = " ".join(out)
    return html.escape((text[:1].upper() + text[1:]).rstrip(",.")) + r.choice([".", ".", "", " &amp; co."])


def _attr(r: random.Random, words: str, chance: float) -> str:
    if r.random() > chance:
        return f' class="{"".join(r.choices(SYLLABLES, k=2))}"' if r.random() < 0.3 else ""
    own = r.sample(words.split(), r.randint(1, 2))
    name = r.choice(["-", "_", " "]).join(own + r.choices(["wrap", "box", "1", "inner", "block", "area"], k=r.randint(0, 1)))
    return f' {r.choice(["class", "class", "id", "role"])}="{name}"'


def _links(r: random.Random) -> str:
    items = [f'<a href="/{i}">{_words(r, 1, 3)}</a>' for i in range(r.randint(2, 9))]
    style = r.random()
    if style < 0.6:
        return "<ul>" + "".join(f"<li>{x}" + "</li>" * (r.random() < 0.8) for x in items) + "</ul>"
    return r.choice([" | ", " ", "<br>", " &middot; "]).join(items)


def _furniture(r: random.Random, kind: str) -> str:
    tags, words = FURNITURE[kind]
    tag = r.choice(tags)
    attr = _attr(r, words, 0.35 if tag in ("nav", "header", "footer", "aside", "form") else 0.95)
    if kind == "nav":
        inner = _links(r)
    elif kind == "header":
        inner = r.choice([f"<h1>{_words(r, 1, 5)}</h1>", f'<a href="/">{_words(r, 1, 3)}</a>', f"<p>{_words(r, 2, 9)}</p>", _words(r, 1, 6)]) + (_furniture(r, "nav") if r.random() < 0.4 else "")
    elif kind == "footer":
        inner = r.choice([f"&copy; {_words(r, 1, 12)}", f"<p>&copy; {_words(r, 2, 10)}</p>" + _links(r), _links(r), _words(r, 3, 25), f"&copy; site.example &middot; {_words(r, 2, 14)}"])
    elif kind == "sidebar":
        inner = f"<h{(h := r.randint(2, 4))}>{_words(r, 1, 3)}</h{h}>" * (r.random() < 0.6) + r.choice([_links(r), f"<p>{_words(r, 4, 40)}</p>", "".join(f"<p>{_words(r, 3, 15)}</p>" for _ in range(r.randint(1, 4))), _words(r, 4, 30)])
    elif kind == "form":
        inner = f"<label>{_words(r, 1, 4)}</label><input name=q>" + f"<p>{_words(r, 3, 20)}</p>" * (r.random() < 0.4) + f"<select><option>{_words(r, 1, 2)}<option>{_words(r, 1, 2)}</select>" * (r.random() < 0.3) + f"<button>{_words(r, 1, 2)}</button>"
    elif kind == "comments":
        one = lambda: r.choice([f"<p>{_words(r, 3, 45)}</p>", f'<div class="comment"><b>{_words(r, 1, 2)}</b><p>{_words(r, 4, 50)}</p></div>', f"<li>{_words(r, 4, 40)}</li>"])
        inner = f"<h3>{_words(r, 1, 3)}</h3>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 6))) + (_furniture(r, "form") if r.random() < 0.2 else "")
        attr = attr or ' class="comments"'
    elif kind == "share":
        inner = _links(r)
    else:
        inner = r.choice([_words(r, 2, 30), f"<p>{_words(r, 3, 40)}</p>", f'<a href="/x">{_words(r, 2, 9)}</a>', f"<p>{_words(r, 3, 20)}</p><button>{_words(r, 1, 2)}</button>", f"<b>{_words(r, 2, 4)}</b> {_words(r, 2, 12)}"])
    return f"<{tag}{attr}>{inner}</{tag}>"


def _paragraph(r: random.Random) -> str:
    text = _words(r, 1, 4) if r.random() < 0.12 else _words(r, 5, 90)
    roll = r.random()
    if roll < 0.15:
        text = f"<b>{text}<br>"
    elif roll < 0.45:
        tag = r.choice(["b", "i", "em", "strong", "span", "code", "a href='/y'"])
        text += f" <{tag}>{_words(r, 1, 6)}</{tag.split()[0]}> {_words(r, 1, 20)}"
    return f"<p>{text}" + "</p>" * (r.random() < 0.85)


def _main_block(r: random.Random) -> str:
    roll = r.random()
    if roll < 0.74:
        return _paragraph(r)
    if roll < 0.82:
        return f"<h{(h := r.randint(2, 4))}>{_words(r, 1, 8)}</h{h}>"
    if roll < 0.88:
        return "<ul>" + "".join(f"<li>{_words(r, 2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
    if roll < 0.92:
        return f"<blockquote>{_words(r, 5, 40)}</blockquote>"
    if roll < 0.95:
        return "<table>" + "".join(f"<tr><td>{_words(r, 1, 4)}</td><td>{_words(r, 1, 5)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
    if roll < 0.98:
        return f"<figure><img src=x><figcaption>{_words(r, 3, 15)}</figcaption></figure>"
    return f"<div>{_words(r, 6, 60)}</div>"


def training_page(r: random.Random) -> str:
    """A random page in which an attribute tells what is main text."""
    blocks = [f"<h1>{_words(r, 2, 12)}</h1>"] * (r.random() < 0.85) + [_main_block(r) for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25]))]
    blocks = [re.sub("^<([a-z0-9]+)", rf'<\1 itemprop="{MARK}"', x) for x in blocks]
    for kind in ("advert", "share", "form", "sidebar", "notice", "comments"):
        if r.random() < 0.12:
            blocks.insert(r.randint(1, len(blocks)), _furniture(r, kind))
    tag = r.choice(["article", "article", "main", "div", "div", "section"])
    attr = _attr(r, WRAPPINGS, 0.9 if tag in ("div", "section") else 0.3)
    body = f"<{tag}{attr}>{''.join(blocks)}</{tag}>" if r.random() < 0.88 else "".join(blocks)
    if r.random() < 0.3:
        outer = r.choice(["main", "div"])
        body = f"<{outer}{_attr(r, WRAPPINGS, 0.8)}>{body}{_furniture(r, 'comments') if r.random() < 0.3 else ''}</{outer}>"
    before = [_furniture(r, k) for k, chance in (("notice", 0.25), ("header", 0.6), ("nav", 0.8), ("advert", 0.5), ("form", 0.15), ("sidebar", 0.15)) if r.random() < chance]
    after = [_furniture(r, k) for k, chance in (("share", 0.15), ("sidebar", 0.4), ("comments", 0.35), ("form", 0.15), ("advert", 0.3), ("notice", 0.1), ("footer", 0.85)) if r.random() < chance]
    if r.random() < 0.3:
        r.shuffle(before)
    if r.random() < 0.1:
        before, after = [], []
    space = r.choice(["", "", "\n", "\n  "])
    page = space.join([*before, body, *after])
    if r.random() < 0.4:
        page = f"<div{_attr(r, 'page container wrapper layout site outer', 0.8)}>{space}{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 9)}</title><style>p{{}}</style></head><body>{page}" + "</body></html>" * (r.random() < 0.9)


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Model:
    """Fit the model; the same for the same arguments."""
    r, forest = random.Random(seed), Forest()
    for _ in range(pages):
        forest.add(training_page(r))
    a = forest.arrays()
    attrs = list(forest.attrs)
    marked = np.array([MARK in x for x in attrs])[a["attr"]].astype(int)
    edge = np.zeros(len(marked) + 1)
    np.add.at(edge, np.flatnonzero(marked), 1)
    np.add.at(edge, a["end"][marked > 0], -1)
    truth = np.cumsum(edge)[:-1] > 0
    lengths = np.array([len(x.strip()) if x is not None else 0 for x in forest.texts])
    good = (truth & (lengths > 0)).astype(float)
    some, all_ = _sum_below(good, a["end"]), _sum_below((lengths > 0).astype(float), a["end"])
    label = np.where(some == 0, OTHER, np.where(some == all_, MAIN, MIXED))
    used = all_ > 0

    def odds(values: list[list[str]], least: int) -> dict[str, float]:
        counts: dict[str, list[float]] = {}
        for keys, kind, use in zip(values, label.tolist(), used.tolist()):
            if use and kind != MIXED:
                for k in set(keys) - {MARK}:
                    counts.setdefault(k, [0.0, 0.0])[kind] += 1
        prior = max(1.0, (label == MAIN).sum()) / max(1.0, (label == OTHER).sum())
        return {k: float(np.clip(np.log((x + 0.5) / (y + 0.5) / prior), -5, 5)) for k, (x, y) in counts.items() if x + y >= least}

    names = list(forest.tags)
    tag_odds = odds([[names[t]] for t in a["tag"].tolist()], 5)
    word_odds = odds([parts(attrs[t]) for t in a["attr"].tolist()], 8)
    x = features(forest, a, tag_odds, word_odds)
    return Model(tag_odds, word_odds, fit(x[:, used], label[used], 3))


def _sum_below(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.r_[0.0, np.cumsum(values)]
    return c[end] - c[: len(values)]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row, from the whole page.

    Character references are decoded. White space inside a block becomes one space; blocks are joined
    in page order by line feeds; a line break is white space. A null page, or one without main text,
    has an empty text. Repeated rows and null ids or urls are kept; an empty table gives an empty
    result; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches_by_bytes(batches, "html", STEP):
            texts = extract([x or "" for x in batch.column("html").to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
