"""Matching where a few keys have most rows, and fruit and vegetables as products."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import score as S
from shelfwise.operators import blocks, resolve


def keyed(r, n):
    """Nine rows in ten have one key, some have none."""
    return [(i, r.choice([*["hot"] * 18, "warm", None]), r.randint(0, 9)) for i in range(n)]


@pytest.mark.parametrize("most", [7, 50, 4000])
def test_every_pair_meets_once(spark, most):
    r = random.Random(most)
    left, right = keyed(r, 150), keyed(r, 90)
    make = lambda rows: spark.createDataFrame(rows, "id int, k string, v int")
    found = blocks.block_join(make(left), make(right), ["k"], F.col("a.v") < F.col("b.v"), most=most).select(F.col("a.id"), F.col("b.id").alias("other")).collect()
    want = Counter((x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1] and x[2] < y[2])
    assert Counter(map(tuple, found)) == want and max(want.values()) == 1


def test_no_block_has_more_than_its_share(spark):
    most = 100
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("k"))
    hot = blocks._parts(rows, rows, ["k"], most)
    assert [tuple(x) for x in hot.collect()] == [("hot", 27, 27)]
    cut = blocks._cut(rows, hot, ["k"], "id", "a", "b")
    sizes = cut.groupBy("k", "_part_a", "_part_b").count()
    assert sizes.agg(F.max("count")).first()[0] < 1.5 * most
    assert sizes.filter("k = 'hot'").count() == 27 * 27


def test_hot_brand_without_sizes_loses_no_pair(spark, monkeypatch):
    r = random.Random(4)
    names = ["green tea", "zero lemon tea", "milk", "oat milk", "jasmine tea classic"]
    rows = [(i, f"s{i % 3}", f"pokka {r.choice(names)}", "pokka" if i % 10 else "acme", None if i % 10 else "100g", 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, store string, name string, brand string, unit string, price_sgd double").withColumn("scraped_at", F.lit(None).cast("timestamp"))
    key = lambda d: sorted(map(tuple, d.select("product_id_a", "product_id_b", "match_score", "match_status").collect()))
    whole = key(resolve.scored_pairs(df))
    monkeypatch.setattr(blocks, "MOST", 5)
    assert key(resolve.scored_pairs(df)) == whole and len(whole) > 500
    assert key(resolve.scored_pairs(df, S.MEAT))


def test_plans_leave_dealing_to_adaptive_execution(spark):
    df = spark.createDataFrame([(1, "a", "x tea", "x", "1l", 1.0)], "id int, store string, name string, brand string, unit string, price_sgd double").withColumn("scraped_at", F.lit(None).cast("timestamp"))
    for pairs in (resolve.scored_pairs(df), resolve.scored_produce_pairs(df)):
        assert "REPARTITION_BY_NUM" not in pairs._jdf.queryExecution().executedPlan().toString()


LISTINGS = [
    (1, "a", "Fuji Apple China"), (2, "b", "Fuji Apple China Crunch"), (3, "b", "Red Apple"), (4, "a", "Kailan"), (5, "c", "Kailan"), (6, "c", "Kailan"),
    (7, "a", "Wonder Leaf"), (8, "b", "Wonder Leaf Premium"), (9, "c", "Thing"), (10, "a", ""), (11, "b", None),
]


def produce(spark, rows=LISTINGS):
    return spark.createDataFrame([(*x, f"2026-01-{x[0]:02d} 00:00:00") for x in rows], "id int, store string, name string, t string").select("id", "store", "name", F.col("t").cast("timestamp_ntz").alias("scraped_at"))


def digest(kind, origin, qualifiers):
    text = json.dumps({"category": "fruits-and-vegetables", "produce_type": kind, "origin": origin, "qualifiers": qualifiers}, sort_keys=True)
    return hashlib.sha1(text.encode()).hexdigest()[:12]


def test_canonical_produce_has_keys_of_type_origin_and_qualifiers(spark):
    pairs, best, products, members = resolve.match_produce(produce(spark))
    found = {x.canonical_key: x for x in products.collect()}
    kailan = found[f"fruits-vegetables-kailan-unknown-{digest('kailan', 'unknown', [])}"]
    assert (kailan.member_count, kailan.stores_present) == (3, ["a", "c"])
    fuji = found[f"fruits-vegetables-apple-china-{digest('apple', 'china', ['fuji'])}"]
    assert (fuji.canonical_name, fuji.variant_tokens, fuji.stores_present) == ("Fuji Apple China Crunch", ["fuji"], ["a", "b"])
    unknown = found[f"fruits-vegetables-unknown-unknown-{digest('unknown', 'unknown', [])}"]
    assert unknown.member_count == 5  # all of which nothing is known are one product
    of = defaultdict(set)
    for m in members.collect():
        of[m.canonical_key].add(m.product_id)
    assert {i for ids in of.values() for i in ids} == {x[0] for x in LISTINGS}
    assert all(len(of[k]) == x.member_count for k, x in found.items())
    assert {(x.product_id_a, x.product_id_b) for x in best.collect()} == {(1, 2)}  # two of unknown origin are for review


def test_produce_without_reciprocal_pairs_and_without_unknown(spark):
    _, best, products, members = resolve.match_produce(produce(spark), reciprocal=False, typed_only=True)
    assert best.count() == 0
    assert not [x for x in products.collect() if x.canonical_key.startswith("fruits-vegetables-unknown")]
    assert {m.match_confidence for m in members.collect()} == {1.0}
    assert resolve.match_produce(produce(spark).limit(0))[2].collect() == []


def test_pairs_of_first_listings_stand_for_all(spark):
    """Listings made different by their ids alone score as their classes do, and their best pairs are those of first listings."""
    r = random.Random(8)
    names = ["Fuji Apple China", "Red Apple", "Baby Kailan", "Kailan Malaysia", "Wonder Leaf", "Leaf"]
    rows = [(i, r.choice("abc"), r.choice(names)) for i in range(1, 29)]
    listings = produce(spark, rows)
    classes = {x.id: x.class_id for x in resolve.produce_classes(listings).collect()}
    pairs = resolve.scored_produce_pairs(listings)
    scores = {(x.product_id_a, x.product_id_b): (x.match_score, x.match_status) for x in pairs.collect()}
    # a number is no part of a name's words, so each of these names is a class of its own with equal scores
    apart = produce(spark, [(i, s, f"{n} {i}") for i, s, n in rows])
    expanded = resolve.scored_produce_pairs(apart)
    got = {(x.product_id_a, x.product_id_b): (x.match_score, x.match_status) for x in expanded.collect()}
    store = {i: s for i, s, _ in rows}
    want = {(i, j): scores[classes[i], classes[j]] for i in store for j in store if store[i] < store[j] and (classes[i], classes[j]) in scores}
    assert got == want and want
    as_named = expanded.withColumns({c: F.regexp_replace(c, r" \d+$", "") for c in ("name_a", "name_b")})
    key = lambda d: sorted(map(tuple, resolve.reciprocal_best(d).select("product_id_a", "product_id_b").collect()))
    assert key(pairs) == key(as_named)


def test_run_files_are_in_order(spark, tmp_path):
    from shelfwise.operators import runs

    names = ["pokka green tea", "pokka green tea", "oat milk", "acme oat milk", "jasmine"]
    rows = [(i, f"s{i % 3}", names[i % 5], "pokka" if i % 5 < 2 else "acme", "100g", 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, store string, name string, brand string, unit string, price_sgd double").withColumn("scraped_at", F.lit("2026-01-01").cast("timestamp"))
    folder = f"file://{tmp_path}/run"
    for _ in range(2):  # a run that is written again replaces its files
        summary = runs.write_run(df, "Dairy", folder).first()
    products = runs.read_artifact(spark, folder, "canonical_products", "position int, canonical_key string, member_count int, source_product_ids array<int>").orderBy("position").collect()
    assert [p.position for p in products] == list(range(1, len(products) + 1))
    order = [(-p.member_count, p.source_product_ids[0]) for p in products]
    assert order == sorted(order) and sum(p.member_count for p in products) == 30
    members = runs.read_artifact(spark, folder, "canonical_product_members", "position int, canonical_key string, store string, product_id int").orderBy("position").collect()
    place = {p.canonical_key: p.position for p in products}
    order = [(place[m.canonical_key], m.store, m.product_id) for m in members]
    assert order == sorted(order) and len(members) == 30
    pairs = runs.read_artifact(spark, folder, "strong_match_pairs", "position int, match_score double, product_id_a int").orderBy("position").collect()
    assert len(pairs) == summary.strong_match_pairs and [p.match_score for p in pairs] == sorted((p.match_score for p in pairs), reverse=True)
    top = runs.read_artifact(spark, folder, "top_pairs", "position int, match_score double")
    assert top.count() == min(20, summary.strong_match_pairs_raw + summary.review_pairs)
    assert runs.read_artifact(spark, folder, "summary", "canonical_groups int, category string").collect() == [(len(products), "Dairy")]


def test_run_files_take_little_room(spark, tmp_path):
    """Members and copies are a line for each listing, whose texts repeat."""
    from shelfwise.operators import runs

    names = "element_at(array('pokka green tea', 'pokka zero tea', 'oat milk', 'acme oat milk', 'jasmine'), cast(id % 5 + 1 as int))"
    df = spark.range(4000).selectExpr("id", "concat('s', id % 3) as store", f"{names} as name", "'acme' as brand", "'100g' as unit", "1.0D as price_sgd", "timestamp_ntz'2026-01-01' as scraped_at")
    runs.write_run(df, "Dairy", f"file://{tmp_path}/run")
    size = {d: sum(f.stat().st_size for f in (tmp_path / "run" / d).iterdir()) for d in ("canonical_product_members", "listing_copies")}
    assert size["canonical_product_members"] < 40 * 4000 and size["listing_copies"] < 20 * 4000
    assert runs.read_artifact(spark, f"file://{tmp_path}/run", "canonical_product_members", "product_id long").distinct().count() == 4000


def test_groups_may_leave_out_lone_listings(spark):
    listings = copied(spark, 3).unionByName(copied(spark, 1).filter("id in (3, 4)"))
    edges = spark.createDataFrame([(1, 1001), (1001, 7), (20, 33)], "product_id_a int, product_id_b int")
    got = []
    for groups in (resolve.components(listings, edges), resolve.linked(edges)):
        products, members = resolve.canonical_products(listings, groups, "Beverages")
        got.append([sorted(map(str, d.collect())) for d in (products, members)])
        assert products.agg(F.sum("member_count")).first()[0] == members.count() == listings.count()
    assert got[0] == got[1]
    # of an id that occurs twice the rows are one group, and lone listings are sure of their product
    assert {m.match_confidence for m in members.filter("product_id in (1, 7, 3)").collect()} == {None}
    assert {m.match_confidence for m in members.filter("product_id in (2, 1003)").collect()} == {1.0}


def copied(spark, n):
    """Listings with ``n`` copies each, of few texts, some of other prices, and without a store, price or unit."""
    names = ["green tea", "green tea", "zero lemon tea", "oat milk", "milk"]
    rows = [(i, f"s{i % 3}" if i % 11 else None, f"pokka {names[i % 5]}", "pokka" if i % 4 else None, "100g" if i % 7 else None, (1.0, 3.0, 5.0, None)[i % 13 % 4]) for i in range(1, 41)]
    rows = [(i + 1000 * k, *x) for k in range(n) for i, *x in rows]
    return spark.createDataFrame(rows, "id int, store string, name string, brand string, unit string, price_sgd double").withColumn("scraped_at", F.lit("2026-01-01").cast("timestamp"))


def test_copies_are_compared_once(spark, monkeypatch):
    compared = []
    scored = resolve._scored_classes

    def counting(classes, s):
        compared.append(classes.count())
        return scored(classes, s)

    monkeypatch.setattr(resolve, "_scored_classes", counting)
    key = lambda d: Counter((x.product_id_a % 1000, x.product_id_b % 1000, x.match_score, x.match_status, x.explanation) for x in d.collect())
    one, three = key(resolve.scored_pairs(copied(spark, 1))), key(resolve.scored_pairs(copied(spark, 3)))
    assert three == {k: 9 * v for k, v in one.items()} and any("unit_price_outlier" in k[4] for k in one)
    assert compared[0] == compared[1]


def test_pairs_of_first_copies_stand_for_all(spark):
    listings = copied(spark, 2)
    pairs, copies = resolve.scored_pairs(listings), resolve.copies(listings)
    few = resolve.scored_copies(listings)
    first = dict(map(tuple, copies.collect()))
    all_pairs = [(x.product_id_a, x.product_id_b, x.match_score, x.match_status) for x in pairs.collect()]
    stood_for = Counter((first[a], first[b], *x) for a, b, *x in all_pairs)
    assert {(x.product_id_a, x.product_id_b, x.match_score, x.match_status): x.copies_a * x.copies_b for x in few.collect()} == stood_for
    assert len(stood_for) < len(all_pairs)
    key = lambda d: sorted(map(tuple, resolve.reciprocal_best(d).select("product_id_a", "product_id_b", "match_score").collect()))
    assert key(few) == key(pairs) and key(few)
    for k in (1, 7, 20):
        top = resolve.top_pairs(few, copies, k)
        assert top.collect() == pairs.orderBy(*resolve.pair_order()).limit(k).collect()
    summary = resolve.run_summary(listings, few, resolve.reciprocal_best(few), listings.select(F.array("store").alias("stores_present"))).first()
    assert (summary.strong_match_pairs_raw, summary.review_pairs) == tuple(sum(x[3] == s for x in all_pairs) for s in ("strong_match", "review"))


def test_produce_names_are_parsed_once(spark, monkeypatch):
    rows, parsed = [], resolve.parsed_produce
    monkeypatch.setattr(resolve, "parsed_produce", lambda df: (rows.append(df.count()), parsed(df))[1])
    listings = spark.range(60).selectExpr("id", "concat('s', id % 4) as store", "case id % 3 when 0 then 'Fuji Apple China' when 1 then 'Potato' end as name", "timestamp_ntz'2026-04-01' as scraped_at")
    alone = listings.selectExpr("id", "id as component")
    _, members = resolve.canonical_produce(listings, alone)
    assert rows == [3] and members.count() == 60
