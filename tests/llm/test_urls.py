"""Verdicts by reputation against SQL with the whole list of suffixes, where the bound decides."""

import random

import duckdb
import pandas as pd

from shelfwise.llm import urls
from tests.conftest import canonical

HOSTS = ["a.github.io", "b.github.io", "www.a.com.sg", "b.com.sg", "shop.c.com.sg", "x.foo.ck", "www.ck", "d.co.uk", "e.co.uk", "f.org", "g.org", "10.0.0.1", "user@h.org:80", "kobe.jp", "a.b.kobe.jp", "city.kobe.jp", "single", "é.de", "xn--9ca.de"]


def test_same_as_sql_where_hosts_are_blocked(spark):
    r = random.Random(7)
    pages, labels = [], []
    for i in range(3000):
        host = r.choice(HOSTS)
        bad = host in ("a.github.io", "d.co.uk", "10.0.0.1", "kobe.jp") or r.random() < 0.1
        pages.append((i, f"https://{host}/{r.choice(['en', 'x'])}/{i}"))
        labels.append((i, 0 if bad and i % 2 else 1, int(bad and not i % 2)))
    pages += [(3000, None), (3001, "no scheme"), (7, "https://a.github.io/again")]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url"]))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), urls.labelled_outcomes(given))
    columns = sorted(got.columns)
    want = con.sql(urls.oracle_sql())
    order = [want.columns.index(c) for c in columns]
    assert canonical(got.select(*columns).collect()) == canonical([[x[i] for i in order] for x in want.fetchall()])
    blocked = {x.host for x in got.filter("rule is null and verdict = 'block'").select("host").distinct().collect()}
    assert blocked == {"a.github.io", "d.co.uk", "10.0.0.1", "kobe.jp"}
