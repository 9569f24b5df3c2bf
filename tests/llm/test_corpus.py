"""Corpus operators against brute force, round trips and held-out labels, with the awkward cases."""

import hashlib
import heapq
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import boosting, bpe, decontaminate, exact_dedup, htmltext, htmltree, minhash, registry, repair, sharding, toxicity, urls, warc
from shelfwise.llm.common import shared_dir
from tests.conftest import DATA, canonical

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 997}" for i in range(30000))
TEXTS = [None, "", "   \t\n", "One two\tTHREE four five six", "one  two three four five six", "É é ﬁ 日本 <|endoftext|> don't", "a\x00b", "x" * 5000, LONG, LONG, "ok", "ok"]


def frame(spark, texts=TEXTS, first=5):
    """Texts with ids, a null id, a repeated row, and extra columns whose names might clash."""
    rows = [(first + i, t, "n", 7) for i, t in enumerate(texts)] + [(None, "no id here", "n", 7), (first + 3, texts[3] if len(texts) > 3 else "z", "n", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, uid long")


def empty(spark):
    return frame(spark).limit(0)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert canonical(df.select(*columns).collect()) == canonical([[r[i] for i in order] for r in rel.fetchall()])


# 1


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def brute_contamination(docs, items, window=10):
    wins = {}
    for item, text in items:
        ws = words_of(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            wins.setdefault(tuple(ws[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        ws, hit, found = words_of(text), set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[w]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark, monkeypatch):
    r = random.Random(1)
    vocabulary = ["a", "b", "c", "É"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(40)] + [(50, None), (None, "a b"), (51, "A.B,c")]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(4, 14)))) for i in range(30)] + [(99, None), (98, ""), (None, "c c c c c"), (3, "b a É")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = canonical(brute_contamination(docs, items))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert canonical(decontaminate.contamination(d, b).select(*columns).collect()) == want
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert canonical(decontaminate.contamination(d, b).select(*columns).collect()) == want
    kept = {x.doc_id for x in decontaminate.decontaminated(d, b).collect()}
    assert kept == {x[0] for x in brute_contamination(docs, items) if not x[5]}


def test_blocks_are_read_again_where_they_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    b = spark.createDataFrame([(i, f"item number {i} of many") for i in range(20)], "item_id long, text string").repartition(6)
    held = decontaminate.blocks(b, "item_id", "text", 10)
    assert len(held.files) >= 7 and held.depth == 5
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 0)
    for _ in range(2):
        assert sorted(int(n) for block in held for n in block.names) == list(range(20))
        assert not [k for k in decontaminate._held if k.startswith("block")]
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 1 << 20)
    assert len(list(held)) == len([k for k in decontaminate._held if k.startswith("block")]) == len(held.files)
    d = spark.createDataFrame([(1, "an ITEM number 7 of many, item number 19 of many"), (2, "item number 77 of many")], "doc_id long, text string")
    assert {x.doc_id: (x.n_items, x.n_hit) for x in decontaminate.contamination(d, b).collect()} == {1: (2, 10), 2: (0, 0)}


def test_contamination_of_odd_texts(spark):
    b = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    got = decontaminate.contamination(frame(spark), b).collect()
    assert len(got) == len(TEXTS) + 2 and sum(x.contaminated for x in got) == 3
    assert decontaminate.contamination(empty(spark), b).count() == 0
    assert not any(x.contaminated for x in decontaminate.contamination(frame(spark), b.limit(0)).collect())
    assert decontaminate.decontaminated(frame(spark), b).columns == frame(spark).columns


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "x a b c d y"), (2, "z b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b c d e g")], "item_id long, text string")
    got = {x.item_word: (x.n_words, x.doc_id, x.doc_word) for x in decontaminate.longest_matches(d, b).collect()}
    assert got == {0: (4, 1, 1), 1: (4, 2, 1), 2: (3, 2, 2), 3: (2, 2, 3), 4: (1, 2, 4)}


def test_suffix_array_is_sorted():
    r = random.Random(2)
    texts = [" ".join(r.choices("ab", k=r.randint(0, 50))) for _ in range(20)]
    block = decontaminate.Block([(1, " ".join(r.choices("ab", k=40)))], 10)
    shard = decontaminate.Shard(pa.array(texts), block.depth)
    suffix = [tuple(shard.ids[i : i + min(shard.left[i], block.depth)]) for i in shard.array]
    assert suffix == sorted(suffix)


# 2


def test_lpt_classes_equal_the_plain_heap():
    r = random.Random(3)
    for _ in range(60):
        shards = r.randint(1, 6)
        classes = sorted({r.randint(1, 40): r.randint(1, 30) for _ in range(r.randint(1, 8))}.items(), reverse=True)
        plain, heap = [(0, s) for s in range(shards)], [(0, s) for s in range(shards)]
        for size, count in classes:
            want = [0] * shards
            for _ in range(count):
                load, s = plain[0]
                heapq.heapreplace(plain, (load + size, s))
                want[s] += 1
            assert sharding.take_class(heap, size, count) == want
            assert sorted(heap) == sorted(plain)


def test_sharding(spark):
    docs = frame(spark, [*TEXTS, *[f"text {i} " * (i % 7) for i in range(80)]])
    got = sharding.lpt_shards(docs, shards=4).collect()
    assert len(got) == docs.count()
    sizes = {}
    for x in docs.collect():
        sizes[x.text or ""] = sizes.get(x.text or "", 0) + len((x.text or "").encode()) + 1
    heap = [(0, s) for s in range(4)]
    for size in sorted(sizes.values(), reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    load = Counter()
    slots = defaultdict(list)
    for x in got:
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert sorted(load.values()) == sorted(x for x, _ in heap)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    shard_of = defaultdict(set)
    for x in got:
        shard_of[x.text_crc32].add(x.shard)
    assert all(len(v) == 1 for v in shard_of.values())
    assert sharding.lpt_shards(empty(spark)).count() == 0


# 3


def pages(spark):
    big = "<p>" + "é" * 200 + "</p>"
    rows = [(1, "http://a/1", big, 0), (2, "http://a/2", big, 0), (3, None, None, 0), (4, "u\r\nv", "", 0), (5, "http://a/5", "short", 0), (6, "x", "short", 0), (None, "y", big, 0), (1, "http://a/1", big, 0), (8, "z", LONG * 3, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def test_warc_round_trip(spark):
    folder = shared_dir(spark, "warc")
    index = warc.write_archives(pages(spark), folder)
    got = canonical((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.read_records(index, folder).collect())
    want = []
    for x in pages(spark).collect():
        data = (x.html or "").encode()
        again = len(data) >= 100 and x.page_id != (1 if x.page_id != 8 else 8)
        want.append((x.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == canonical(want)
    chosen = spark.createDataFrame([(2,), (5,), (8,)], "page_id long")
    assert {x.page_id: bytes(x.payload).decode() for x in warc.select_payloads(index, folder, chosen).collect()} == {2: pages(spark).first().html, 5: "short", 8: LONG * 3}
    none = shared_dir(spark, "warc")
    assert warc.read_records(warc.write_archives(pages(spark).limit(0), none), none).count() == 0


def test_warc_ranges_are_joined():
    spans = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP_BYTES, 5), ("a", 26 + 2 * warc.GAP_BYTES, 5), ("b", 0, 3)]
    assert list(warc.ranges(spans)) == [("a", 0, 25 + warc.GAP_BYTES, [0, 1, 2]), ("a", 26 + 2 * warc.GAP_BYTES, 31 + 2 * warc.GAP_BYTES, [3]), ("b", 0, 3, [4])]


# 4


def brute_exact(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for members in groups.values():
        best = min(members, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
        out += [(rows[i][0], rows[best][0], len(members), i == best) for i in members]
    return out


def test_exact_dedup(spark):
    docs = frame(spark).repartition(3)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    got = exact_dedup.exact_groups(docs).drop("digest").collect()
    assert canonical(map(tuple, got)) == canonical(brute_exact(rows))
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert canonical((x.doc_id,) for x in kept.collect()) == canonical((x[0],) for x in brute_exact(rows) if x[3])
    assert exact_dedup.exact_groups(empty(spark)).count() == 0 and exact_dedup.drop_exact(empty(spark)).count() == 0


# 5


def brute_near(rows, width, p, q):
    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
        sets.append({tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and q * both >= p * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    best = {}
    for i in range(len(rows)):
        best[find(i)] = min(best.get(find(i), i), i, key=order)
    return [(rows[i][0], len(sets[i]), rows[best[find(i)]][0]) for i in range(len(rows))]


def near_texts(n=150, seed=4):
    """Chains of ever more edited texts, so that components reach further than links."""
    r = random.Random(seed)
    out = []
    for _ in range(6):
        words = [f"v{r.randint(0, 400)}" for _ in range(60)]
        for _ in range(n // 6):
            words = list(words)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"v{r.randint(0, 400)}"
            out.append(" ".join(words))
    r.shuffle(out)
    return out


def test_near_groups(spark):
    docs = frame(spark, [*TEXTS, *near_texts()]).repartition(3)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    for width in (4, 5):
        got = minhash.near_groups(docs, width).collect()
        want = brute_near(rows, width, 4, 5)
        assert canonical((x.doc_id, x.n_shingles, x.component_id) for x in got) == canonical(want)
        assert sum(x.kept for x in got) == len({x[2] for x in want if x[1]} | {None}) - 1 + sum(1 for x in want if not x[1]) + sum(1 for x in want if x[0] is None and x[2] is None)
    kept = minhash.drop_near(docs, 4)
    assert kept.columns == docs.columns and kept.count() == sum(x.kept for x in minhash.near_groups(docs, 4).collect())
    assert minhash.near_groups(empty(spark)).count() == 0


def test_rest_search_finds_what_bands_pair_only_with_others(spark):
    """With no links known, prefix filtering alone finds every similar pair."""
    texts = near_texts(60, 9)
    sets = [set(x.tolist()) for x in minhash.shingle_sets(pa.array(texts), 4)]
    rows = [(i, len(s), np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "uid long, n int, set binary")
    with minhash.Scratch(spark) as keep:
        none = spark.createDataFrame([], "node long, label long")
        got = {(x.a, x.b) for x in minhash.cross_pairs(df, none, (4, 5), keep).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and sets[i] != sets[j] or sets[i] == sets[j] and i < j}
    assert want <= got and want


def test_components_of_stars_and_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 120)] + [(200, 201), (200, 201)]
    with minhash.Scratch(spark) as keep:
        got = {x.node: x.label for x in minhash.components(spark.createDataFrame(edges, "a long, b long"), keep).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {x: 100 for x in range(101, 120)} | {201: 200}


# 6


def test_url_rules(spark):
    cases = [
        ("http://WWW.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/x?y", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://example.com/de", "example.com", "/de", "com/", "allow"),
        ("http://notexample.com.net/es/", "notexample.com.net", "/es/", "net/es/", "block"),
        ("http://x.com?q", "x.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://bad.org/x#f", "bad.org", "/x", None, "block"),
        ("http://once.org/x", "once.org", "/x", None, "allow"),
    ]
    rows = [(i, c[0], 1) for i, c in enumerate(cases)] + [(100 + i, "http://bad.org/y", 1) for i in range(40)] + [(200 + i, f"http://good{i % 4}.org/", 1) for i in range(40)] + [(300, "http://once.org/z", 1)]
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(200 + i, 0) for i in range(40)] + [(300, 1)], "page_id long, bad int")
    df = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urls.judge(df, outcomes).collect()}
    assert len(got) == len(rows)
    for i, c in enumerate(cases):
        assert got[i] == c[1:], c
    assert urls.judge(df, outcomes.limit(0)).filter("rule is null and verdict = 'block'").count() == 0
    assert urls.judge(df.limit(0), outcomes).count() == 0


def test_registered_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "u:p@a.org:80": ("a.org", "org"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "": ("", ""), "com": ("com", "com")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = urls.levels_of(F.col("host"))
    assert {x[0]: (x[1], x[2]) for x in df.select("host", domain, suffix).collect()} == hosts


def test_registered_domains_by_the_full_list(spark):
    hosts = {
        "www.a.co.il": ("a.co.il", "co.il"), "a.com.sg": ("a.com.sg", "com.sg"), "x.y.edu.au": ("y.edu.au", "edu.au"), "b.a.com.ar": ("a.com.ar", "com.ar"), "me.github.io": ("me.github.io", "github.io"),
        "a.b.foo.ck": ("b.foo.ck", "foo.ck"), "a.www.ck": ("www.ck", "ck"), "a.b.unlisted": ("b.unlisted", "unlisted"), "a.\u516c\u53f8.cn": ("a.\u516c\u53f8.cn", "\u516c\u53f8.cn"), "b.a.xn--55qx5d.cn": ("a.xn--55qx5d.cn", "xn--55qx5d.cn"), "co.uk": ("co.uk", "co.uk"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = urls.levels_of(F.col("host"))
    assert {x[0]: (x[1], x[2]) for x in df.select("host", domain, suffix).collect()} == hosts


# 7

PAGE = """<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><div class="cookie-notice">We use cookies. <button>OK</button></div>
<main><article><h1>The title &amp; more</h1><p>First  paragraph with
<b>bold</b> <i>words</i> in it, long enough.</p><div class="ad">Buy things now</div><p>Second paragraph<br>of this text.</article>
<section id="comments"><h3>Comments</h3><p>Great text, thank you very much for it.</p></section></main><aside class="sidebar"><ul><li><a href=x>Other</a></ul></aside><script>var x = "<p>no</p>";</script><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (None, "u", "", 1), (3, "u", "<p>Only this paragraph is here", 1), (4, "u", "<", 1), (5, "u", "<div " * 300, 1), (1, "u", PAGE, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = [(x.page_id, x.text, x.n_chars) for x in htmltext.main_text(df).collect()]
    text = "The title & more\nFirst paragraph with bold words in it, long enough.\nSecond paragraph of this text."
    assert got[0] == got[6] == (1, text, len(text))
    assert got[1][1:] == got[2][1:] == ("", 0)
    assert got[3][1] == "Only this paragraph is here"
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_main_text_of_unseen_pages():
    r, right, found, wanted = random.Random(1234), 0, 0, 0
    for _ in range(150):
        page, forest = htmltext.training_page(r), htmltree.Forest()
        forest.add(page)
        a, attrs = forest.arrays(), list(forest.attrs)
        main = np.zeros(len(forest.texts), bool)
        for i in np.flatnonzero([htmltext.MARK in attrs[k] for k in a["attr"]]):
            main[i : a["end"][i]] = True
        at = [i for i in np.flatnonzero(main) if forest.texts[i] is not None]
        want = Counter(htmltree.joined([forest.texts[i] for i in at], [forest.block[i] for i in at]).split("\n"))
        got = Counter(htmltext.extract([page.replace(f' itemprop="{htmltext.MARK}"', "")], htmltext.trained())[0].split("\n"))
        right, found, wanted = right + sum((want & got).values()), found + sum(got.values()), wanted + sum(want.values())
    assert right / found > 0.97 and right / wanted > 0.97


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(0)
    parent = np.array([0, 0, 0, 1, 1, 2, 3, 3])
    depth = np.array([0, 1, 1, 2, 2, 2, 3, 3])
    for _ in range(50):
        logs = np.log(rng.dirichlet(np.ones(3), len(parent)).T)
        leaf = ~np.isin(np.arange(len(parent)), parent[1:])
        chosen = htmltext.decode(logs, parent, depth, leaf)
        for i in range(1, len(parent)):
            assert chosen[i] or not chosen[parent[i]]


def test_trees_learn_a_rule():
    x = np.random.default_rng(0).normal(size=(4, 3000))
    y = ((x[0] > 0.3) & (x[2] < 0)).astype(int) + (x[1] > 1)
    assert (boosting.fit(x, y, 3).log_probabilities(x).argmax(axis=0) == y).mean() > 0.97


# 8 and 10


@pytest.fixture(scope="module")
def model():
    return bpe.load(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(6)
    marks = ["'s", "'t", "!!", "...", "'", "’", "–", "1", "½", "٣", "<|endoftext|>", "<|", "|>", "\x00", "\x1c", "\xa0", " ", "\t", "\n", "ß", "İ", "Σ", "ΑΣ", "é", "ﬁ", "日本", "🙂", "ǅ", "Ⱥ", "́"]
    letters = "abcdefghijklmnopqrstuvwxyzABCéüñ"
    out = [x or "" for x in TEXTS]
    for _ in range(300):
        out.append("".join(r.choice([" ", "", ""]) + (r.choice(marks) if r.random() < 0.3 else "".join(r.choices(letters, k=r.randint(1, 12)))) for _ in range(r.randint(1, 25))))
    return out


def test_bpe_equals_the_library(model, odd_texts):
    found = model.encode(pa.array(odd_texts))
    ids, at = found.flat()
    decoded = found.decoded().to_pylist()
    for i, text in enumerate(odd_texts):
        want = model.library.encode(text, add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want, repr(text)
        assert decoded[i] == model.library.decode(want, skip_special_tokens=False)


def test_every_token_pair_check_agrees_with_merging(model):
    r = random.Random(8)
    plain = [i for i, t in enumerate(model.tokens[:49406]) if not t.endswith(bpe.END) and i >= 512]
    ends = [i for i, t in enumerate(model.tokens[:49406]) if t.endswith(bpe.END) and i >= 512]
    a, b = np.array(r.choices(plain, k=3000)), np.array(r.choices(ends, k=3000))
    body = lambda i: bytes(s & 255 for s in model.symbols(model.tokens[i]))
    want = [model.merge(body(x) + body(y)) == (x, y) for x, y in zip(a.tolist(), b.tolist())]
    assert (model.compatible(a, b) & model.valid[a] & model.valid[b]).tolist() == want


def test_encoded_table(spark, model):
    got = bpe.encoded(frame(spark), full=True).collect()
    rows = frame(spark).collect()
    assert len(got) == len(rows)
    for x, y in zip(got, rows):
        ids = model.library.encode(y.text or "", add_special_tokens=False).ids
        assert x.ids == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(model.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded(empty(spark)).count() == 0


def test_grammar_round_trip(model, odd_texts):
    texts = odd_texts * 4
    found = model.encode(pa.array(texts), repair.LibraryWords(model))
    shard = repair.Shard.unpack(repair.compress(found, pa.array(range(len(texts)), pa.int64()), len(model.tokens)).pack())
    ids, at = shard.decode()
    assert len(shard.left) > 50 and len(shard.symbols) < len(ids) / 2
    r = random.Random(1)
    for i, text in enumerate(texts):
        want = [*model.library.encode(text, add_special_tokens=False).ids, repair.END_ID]
        assert ids[at[i] : at[i + 1]].tolist() == want
        a = r.randrange(len(want))
        assert shard.slice(i, a, 5).tolist() == want[a : a + 5]
        assert shard.slice(i).tolist() == want
    assert (shard.sizes(np.arange(shard.first, shard.first + len(shard.left))) == shard.lengths).all()


@pytest.mark.parametrize("copies", [1, 3, 6])
def test_grammar_leaves_no_frequent_pair(model, copies):
    r = random.Random(3)
    passage = " ".join(r.choice(["amber", "river", "stone", "cloud", "ember"]) + str(r.randrange(99)) for _ in range(300))
    texts = [f"{r.random()} {passage} {r.random()} {'na ' * i}{'x' * 700}" for i in range(copies)] + [None, "", "ha " * 999]
    found = model.encode(pa.array(texts), repair.LibraryWords(model))
    shard = repair.Shard.unpack(repair.compress(found, pa.array(range(len(texts)), pa.int64()), len(model.tokens)).pack())
    pairs, ends = Counter(), set(shard.starts.tolist())
    symbols = shard.symbols.tolist()
    i = 0
    while i + 1 < len(symbols):
        pair = (symbols[i], symbols[i + 1])
        pairs[pair] += i + 1 not in ends
        # pairs of one run of equal symbols do not overlap
        i += 2 if pair[0] == pair[1] == (symbols + [None] * 2)[i + 2] and i + 1 not in ends else 1
    assert max(pairs.values()) < repair.USES
    assert copies < repair.USES or shard.lengths.max() >= 300
    ids, at = shard.decode()
    for i, text in enumerate(texts):
        want = [*model.library.encode(text or "", add_special_tokens=False).ids, repair.END_ID]
        assert ids[at[i] : at[i + 1]].tolist() == want
        assert shard.slice(i).tolist() == want and shard.slice(i, len(want) // 2, 3).tolist() == want[len(want) // 2 :][:3]


def shard_of_distinct_words(model, n=60_000):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(n)]
    texts = [" ".join(r.choices(words, k=300)) for _ in range(n // 60)]
    return pa.array(texts), pa.array(range(len(texts)), pa.int64())


def most_memory(f):
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_memory_of_a_shard(model):
    """Per id of a shard's texts, as several workers stand beside each other and the executor."""
    texts, ids = shard_of_distinct_words(model)
    library = repair.LibraryWords(model)
    model.encode(texts, library)
    found, most = most_memory(lambda: model.encode(texts, library))
    n = int(found.sizes[found.pieces].sum())
    assert n > 500_000
    shard, then = most_memory(lambda: repair.compress(found, ids, len(model.tokens)))
    _, last = most_memory(shard.decode)
    # bytes an id: 16, 20 and 28; with words in one list, 8-byte symbols and two maps of places 23, 34 and 51
    assert (most < 19 * n, then < 26 * n, last < 38 * n) == (True,) * 3


@pytest.mark.parametrize("bits", [1, 3, 30])
def test_grammar_is_the_same_for_any_hash(model, odd_texts, monkeypatch, bits):
    texts = odd_texts * 4 + ["na " * 500]
    found = model.encode(pa.array(texts), repair.LibraryWords(model))
    made = lambda: repair.compress(found, pa.array(range(len(texts)), pa.int64()), len(model.tokens)).pack()
    want = made()
    monkeypatch.setattr(repair, "HASH_BITS", bits)
    assert made() == want


@pytest.mark.parametrize("size", [1, 7])
def test_pieces_cut_in_any_portions(model, odd_texts, monkeypatch, size):
    want = model.encode(pa.array(odd_texts)).flat()
    monkeypatch.setattr(bpe, "CUT_BYTES", size)
    got = model.encode(pa.array(odd_texts)).flat()
    assert all((a == b).all() for a, b in zip(got, want))


def test_id_files(spark, model):
    docs = frame(spark)
    folder = shared_dir(spark, "ids")
    got = repair.read_ids(repair.write_ids(docs, folder), folder, full=True).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda x: (x.doc_id is None, x.doc_id or 0, x.text or ""))
    assert [x.doc_id for x in got] == [x.doc_id for x in rows]
    start = 0
    for x, y in zip(got, rows):
        ids = [*model.library.encode(y.text or "", add_special_tokens=False).ids, repair.END_ID]
        assert (x.start, x.n_tokens, x.ids) == (start, len(ids), ids)
        assert x.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    none = shared_dir(spark, "ids")
    assert repair.read_ids(repair.write_ids(empty(spark), none), none).count() == 0


# 9


def brute_segments(values):
    """Maximal segments by definition: the best one, then those left and right of it."""
    best = max(((sum(values[i:j]), -(j - i), i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    move = lambda found, by: [(a + by, b + by, s) for a, b, s in found]
    return [*brute_segments(values[:i]), (i, j, best[0]), *move(brute_segments(values[j:]), j)]


def test_maximal_segments():
    r = random.Random(7)
    for _ in range(300):
        values = [r.choice([-1, 1]) * r.uniform(0.1, 3) for _ in range(r.randint(0, 14))]
        got = toxicity.maximal_segments(values)
        want = brute_segments(values)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_toxicity_on_held_out_labels(spark):
    from shelfwise.llm.common import table

    at = DATA.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, at, "documents"), table(spark, at, "labels")
    model = toxicity.train(docs, labels)
    got = toxicity.scores(docs, model).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert ((got.predicted == got.toxic).mean()) > 0.97
    assert (got[got.toxic == 0].predicted).mean() < 0.01 and got[got.toxic == 1].predicted.mean() > 0.85
    found = toxicity.passages(docs, model)
    assert found.filter("expected < 0.01 and first_word < end_word").count() == found.count() > 0
    odd = toxicity.scores(frame(spark), model).collect()
    assert len(odd) == len(TEXTS) + 2 and all(0 <= x.score < 0.5 for x in odd)
    assert toxicity.scores(empty(spark), model).count() == 0
    assert toxicity.without_toxic(frame(spark), model).columns == frame(spark).columns


def test_toxicity_without_use_of_labels(spark):
    docs = frame(spark)
    for rows in ([], [(6, 1, 1), (7, None, None), (None, 1, 1)], [(6, 1, 0), (7, 1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        model = toxicity.train(docs, labels)
        assert all(0 <= x.score <= 1 for x in toxicity.scores(docs, model).collect())


def tokens_of(text):
    raw, rows = toxicity.text_bytes(pa.array(["x y", None, text, "z"]))
    coded, at = toxicity._tokens(raw, rows)
    assert at[:3].tolist() == [0, 2, 2] and at[4] - at[3] == 1
    return [w.decode() for w in coded.to_pylist()[at[2] : at[3]]]


def test_words_end_at_unicode_punctuation():
    assert tokens_of("l\u2019Idiot \u00abidiot\u00bb a\u2014idiot no\u00a0idiot\u3002idiot \ufeffidiot") == ["l", "idiot", "idiot", "a", "idiot", "no", "idiot", "idiot", "idiot"]
    assert tokens_of("caf\u00e9 na\u00efve, \u0928\u092e\u0938\u094d\u0924\u0947") == ["caf\u00e9", "na\u00efve", "\u0928\u092e\u0938\u094d\u0924\u0947"]
    assert tokens_of("\U0001f525idiot") == ["\U0001f525", "idiot"]


def test_scripts_without_spaces_are_scored_by_pieces():
    text = "\u4eca\u65e5\u306f\u3044\u3044\u5929\u6c17\u3060\u30fb\u99ac\u9e7f"
    run = text[:8]
    assert tokens_of(text + "ok") == [*(run[i : i + 4] for i in range(8)), text[9:], text[10], "ok"]
    assert tokens_of("\u0e44\u0e2d\u0e49\u0e1a\u0e49\u0e32") == ["\u0e44\u0e2d\u0e49\u0e1a\u0e49\u0e32"[i : i + 4] for i in range(6)]


def test_whole_words_have_keys_of_their_own():
    keys = toxicity.chains(pa.array([b"a" * 24 + b"bcd", b"a" * 24 + b"bce", b"a" * 24 + b"bcd"], pa.large_binary()))[-1]
    assert keys[0] == keys[2] != keys[1]


def test_toxic_passage_late_in_a_run_without_spaces(spark):
    r = random.Random(5)
    plain = lambda n: "".join(chr(0x4E00 + r.randrange(300)) for _ in range(n))
    bad = "\u9a6c\u9e7f\u6df7\u86cb"
    rows = [(i, plain(30) + (bad * 2 if i % 3 == 0 else "") + plain(30)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs, toxicity.train(docs, labels)).filter("held_out").collect()
    assert len(got) > 100 and all(x.predicted == (x.doc_id % 3 == 0) for x in got)


def test_no_count_is_left_out(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    full = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "ENTRIES", 100, raising=False)
    again = toxicity.train(docs, labels)
    assert len(full.keys) > 1000 and again.keys.tolist() == full.keys.tolist() and again.weights == pytest.approx(full.weights)


def test_shares_near_one_stay_finite():
    keys = np.arange(1, 10, dtype=np.uint64)
    model = toxicity.Model(keys, np.full(9, 1 << 30), np.zeros(9, np.int64), 0.1)
    chain = np.arange(1, 10, dtype=np.uint64).reshape(9, 1)
    assert np.isfinite(toxicity.word_scores(model, chain)).all()


# The pipeline


def test_pipeline(spark, model):
    from shelfwise.llm.common import table

    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    rows = {x.doc_id: x.text for x in docs.collect()}
    toxic = {x.doc_id for x in toxicity.scores(docs, toxicity.train(docs, labels)).filter("predicted = 1").collect()}
    left = [(i, t) for i, t in rows.items() if i not in toxic]
    left = [(i, rows[i]) for i, _, _, kept in brute_exact(left) if kept]
    left = [(i, rows[i]) for i, _, first in brute_near(left, 5, 4, 5) if i == first]
    items = [(x.item_id, x.text) for x in table(spark, DATA, "benchmark").collect()]
    left = {x[0] for x in brute_contamination(left, items) if not x[5]}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {x.doc_id for x in got} == left and len(got) == len(left)
    for x in got[:40]:
        assert x.n_tokens == len(model.library.encode(rows[x.doc_id], add_special_tokens=False).ids)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_normal_forms_are_not_needed_below_the_slow_pieces():
    assert all(unicodedata.normalize("NFC", chr(c)) == chr(c) for c in range(0x200))


def test_markup_of_all_sorts():
    def tree(page):
        f = htmltree.Forest()
        f.add(page)
        names = list(f.tags)
        return [(names[t], x) for t, x in zip(f.tag, f.texts)][1:]

    assert tree("<p title=don't>it's</p>") == [("p", None), ("#text", "it's")]
    assert tree('<a title="1>0" href=x>y</a>') == [("a", None), ("#text", "y")]
    assert tree("<p>a<p>b<div>c") == [("p", None), ("#text", "a"), ("p", None), ("#text", "b"), ("div", None), ("#text", "c")]
    assert tree("<script>if (a<b) '</p>'</script>x") == [("script", None), ("#text", "x")]
    assert tree("a <!-- <b> --> c &lt;d&gt;") == [("#text", "a "), ("#text", " c <d>")]
    assert tree("1 < 2 <") == [("#text", "1 < 2 <")]
    # no time that grows with the square of the page
    for page in ("<div " * 200_000, '<a x="' * 100_000 + ">", "<" * 500_000, "<p>" * 20_000):
        tree(page)
