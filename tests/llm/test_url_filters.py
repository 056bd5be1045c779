"""As-of matching against brute force."""

import datetime as dt
import random

import duckdb

from gravelake.llm import url_filters as u


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def brute_force(captures, changes):
    out = {}
    for i, host, path, when in captures:
        hits = []
        for pattern in {c[0] for c in changes if c[0]}:
            if "/" in pattern:
                applies = (host + "/" + path + "/").startswith(pattern + "/")
            else:
                applies = host == pattern or host.endswith("." + pattern)
            state = {}
            for p, d, a in changes:
                if p == pattern and d is not None and d <= when:
                    state.setdefault(d, []).append(a)
            if applies and state and "remove" not in state[max(state)]:
                hits.append(pattern)
        out[i] = (len(hits), min(hits, key=lambda p: (-len(p), p)) if hits else None)
    return out


def test_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "x.other.org"]
    patterns = hosts + ["example.com/en", "other.org/en/1", "x.other.org/de"]
    captures = [(i, rng.choice(hosts), rng.choice(["", "en", "en/1", "en/1/2", "de", "english"]), day(rng.randint(0, 60))) for i in range(300)]
    changes = [(rng.choice(patterns), day(rng.randint(0, 50)), rng.choice(["add", "add", "remove"])) for _ in range(60)] + [(None, day(1), "add"), ("example.com", None, "add")]
    rows = [(i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'www.', 'me@'])}{h}{rng.choice(['', ':80'])}/{p}{rng.choice(['', '?q=/x', '#top'])}", w, "clash", "clash") for i, h, p, w in captures]
    df = spark.createDataFrame(rows, "id long, url string, fetched_on date, pattern string, blocked string")
    listed = spark.createDataFrame(changes, "pattern string, changed_on date, action string")
    want = brute_force(captures, changes)
    got = {r.id: (r.n_active, r.pattern) for r in u.match(df, listed).collect()}
    assert got == want
    allowed = u.keep_allowed(df, listed)
    assert allowed.columns == df.columns
    assert {r.id for r in allowed.collect()} == {i for i, (n, _) in want.items() if not n}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, day(3)), (2, "not a url", day(3)), (3, "http://example.com", None), (4, "http://example.com", day(3)), (4, "http://example.com", day(3)), (5, "ftp://localhost/x", day(3)), (6, "http://" + "a." * 80 + "example.com/" + "s/" * 300, day(3)), (7, "http://other.org/x\nexample.com", day(3))], "id long, url string, fetched_on date")
    listed = spark.createDataFrame([("example.com", day(1), "add")], "pattern string, changed_on date, action string")
    got = sorted((r.id, r.blocked) for r in u.match(df, listed).collect())
    assert got == [(1, False), (2, False), (3, False), (4, True), (4, True), (5, False), (6, True), (7, False)]
    assert not any(r.blocked for r in u.match(df, listed.limit(0)).collect())
    assert u.match(df.limit(0), listed).count() == 0


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    order = ["page_id", "host", "fetched_on", "n_active", "pattern", "blocked"]
    want = con.sql(f"select {', '.join(order)} from ({u.OP7_SQL}) order by 1").fetchall()
    got = sorted(tuple(r) for r in u.op7_url_filters(spark, sf_dir).select(*order).collect())
    assert got == want and 0 < sum(r[-1] for r in got) < len(got)
