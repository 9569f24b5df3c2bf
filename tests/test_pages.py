"""Stored pages: whole tables, filters that pass over pages, order and short pages."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwise.sources import listings, pages

SCHEMA = "id long, store string, price double, scraped_at timestamp_ntz, day date, ok boolean"


def rows(spark, n=250):
    first = datetime.datetime(2026, 4, 1)
    at = [first + datetime.timedelta(hours=i) for i in range(n)]
    return spark.createDataFrame([(i, f"s{i // 100}" if i % 7 else None, i / 4, at[i], at[i].date(), i % 2 == 0) for i in range(n)], SCHEMA).orderBy(F.rand(1))


def key(df):
    return sorted(map(tuple, df.collect()), key=str)


def broken(folder: Path, numbers):
    """Leaves these pages nothing but their first line and garbage."""
    for n in numbers:
        p = folder / pages._page_name(n)
        p.write_bytes(p.read_bytes().split(b"\n", 1)[0] + b"\nno row\n")


def test_pages_give_the_table_back(spark, tmp_path):
    df = rows(spark)
    assert pages.write_pages(df, f"file://{tmp_path}/p", "id", 40) == 7
    got = pages.paged_table(spark, f"file://{tmp_path}/p", SCHEMA, 40, "id")
    assert key(got) == key(df)
    assert key(pages.paged_table(spark, f"{tmp_path}/p", "store string, id long", 40).select("id", "store")) == key(df.select("id", "store"))
    assert pages.paged_table(spark, f"{tmp_path}/none", SCHEMA).collect() == []
    assert pages.write_pages(df.limit(0), f"{tmp_path}/e", "id") == 0


def test_pushed_filters_read_fewer_pages(spark, tmp_path):
    df = rows(spark)
    pages.write_pages(df, f"{tmp_path}/p", "id", 40)
    broken(tmp_path / "p", [0, 4, 5, 6])  # 40-159 are in whole pages
    table = pages.paged_table(spark, f"{tmp_path}/p", SCHEMA, 40, "id")
    day = lambda d: d.filter("scraped_at >= timestamp_ntz'2026-04-03 00:00:00' and scraped_at < timestamp_ntz'2026-04-04 00:00:00'")
    assert key(day(table)) == key(day(df)) and day(df).count() == 24
    for where in ("id = 77", "day = date'2026-04-03'", "id >= 60 and id < 90 and store = 's0'", "price > 12.0 and price <= 30.0 and id % 3 = 0", "id between 50 and 60 and ok = true"):
        assert key(table.filter(where)) == key(df.filter(where))
    with pytest.raises(Exception, match="JSON"):
        table.filter("store = 's0'").collect()


def test_null_values_and_filters_that_stay(spark, tmp_path):
    df = rows(spark)
    pages.write_pages(df, f"{tmp_path}/p", "id", 100)
    table = pages.paged_table(spark, f"{tmp_path}/p", SCHEMA, 100)
    for where in ("store is null", "store is not null", "store = 's1' or id = 3", "store in ('s0', 's2')", "not (store = 's1')", "store > 's0'", "store like 's%'"):
        assert key(table.filter(where)) == key(df.filter(where))


def test_reading_ends_at_a_short_page(spark, tmp_path):
    pages.write_pages(rows(spark), f"{tmp_path}/p", "id", 40)
    short = tmp_path / "p" / pages._page_name(3)
    lines = short.read_text().splitlines()
    short.write_text("\n".join([lines[0].replace('"rows": 40', '"rows": 39'), *lines[1:40]]) + "\n")
    got = pages.paged_table(spark, f"{tmp_path}/p", SCHEMA, 40, "id")
    assert sorted(r.id for r in got.collect()) == list(range(159))


def test_rows_out_of_order_are_told(spark, tmp_path):
    pages.write_pages(rows(spark), f"{tmp_path}/p", "id", 40)
    a, b = (tmp_path / "p" / pages._page_name(n) for n in (1, 2))
    one, two = a.read_bytes(), b.read_bytes()
    a.write_bytes(two)
    b.write_bytes(one)
    with pytest.raises(Exception, match="not in order of id"):
        pages.paged_table(spark, f"{tmp_path}/p", SCHEMA, 40, "id").collect()


def test_day_of_a_store_is_read_from_its_pages(spark, tmp_path):
    """The half-open range of a day, its store and category go to the reader."""
    df = rows(spark).withColumn("unified_category", F.lit("Dairy"))
    pages.write_pages(df, f"{tmp_path}/p", "id", 24)
    broken(tmp_path / "p", [n for n in range(11) if n != 4])
    table = pages.paged_table(spark, f"{tmp_path}/p", SCHEMA + ", unified_category string", 24, "id")
    got = listings.day_of(table, "s1", "Dairy", "2026-04-05")
    assert [r.id for r in got.collect()] == [i for i in range(100, 120) if i % 7]
