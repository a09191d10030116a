import datetime as dt
import random
import zlib

import pytest

from graphloom.llm import intervals as I

DAY = dt.timedelta(days=1)
ZERO = dt.datetime(1970, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, key int"
SALES = "sale_id long, client_id long, status string, sold_at timestamp_ntz, s string"
LINES = "sale_id long, line_no int, shipped_at timestamp_ntz, open boolean"


def us(t):
    return (t - ZERO) // dt.timedelta(microseconds=1)


def brute(sales, lines, clicks):
    by, out = {}, {}
    for _, ts, client, kind, _ in clicks:
        if ts is not None and client is not None:
            by.setdefault(client, []).append((ts, kind))
    found = {}
    for client, rows in by.items():
        rows.sort(key=lambda r: r[0])
        groups = []
        for ts, kind in rows:
            if not groups or ts - groups[-1][-1][0] > dt.timedelta(minutes=5):
                groups.append([])
            groups[-1].append((ts, kind))
        found[client] = [(g[0][0], g[-1][0], any(k == "click" for t, k in g if t == g[-1][0])) for g in groups]
    slot = lambda t: us(t) // us(ZERO + DAY)
    for n, (sale, client, status, sold, _) in enumerate(sales):
        if client is None or sold is None:
            continue
        end = max([sold] + [t for i, _, t, _ in lines if i == sale and i is not None and t is not None])
        a, b, held = slot(sold), slot(end), status == "held"
        for first, last, open_ in found.get(client, []):
            c, d = slot(first), slot(last)
            if (c <= b or held) and (a <= d or open_):
                ends = (held > open_) - (held < open_) if held or open_ else (b > d) - (b < d)
                name = I.RELATIONS[4 + 3 * ((a > c) - (a < c)) + ends]
                row = out.setdefault((n, sale, name), [0, None if held and open_ else 0, 0])
                row[0] += 1
                if row[1] is not None:
                    row[1] += (d if held else b if open_ else min(b, d)) - max(a, c) + 1
                row[2] += zlib.crc32(str(us(first)).encode())
    return sorted(((sale, name, *row) for (_, sale, name), row in out.items()), key=order)


def order(r):
    return (r[0] is not None, r[0] or 0, *r[1:3], r[3] is not None, r[3] or 0, r[4])


def tables(spark, sales, lines, clicks):
    return spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), spark.createDataFrame(clicks, CLICKS)


def made(seed):
    rng = random.Random(seed)
    time = lambda: None if rng.random() < 0.03 else ZERO + dt.timedelta(days=rng.choice([-40, 19700]), seconds=rng.randrange(90 * 86400), microseconds=rng.randrange(10**6))
    client = lambda: rng.choice([None, 1, 1, 1, 2, 3])
    clicks = []
    for k in range(250):
        t, c = time(), client()
        for _ in range(rng.randrange(1, 5)):
            clicks.append((k, t, c, rng.choice(["click", "view", None]), 1))
            t = t if t is None or rng.random() < 0.2 else t + rng.choice([dt.timedelta(seconds=200), dt.timedelta(minutes=5), dt.timedelta(minutes=5, microseconds=1), dt.timedelta(seconds=299)])
    for c, begin in ((1, ZERO + dt.timedelta(days=19720)), (2, ZERO - dt.timedelta(days=20))):  # sessions of days
        clicks += [(9, begin + dt.timedelta(seconds=240 * k), c, "view", 1) for k in range(900)]
    sales = [(rng.choice([None, k, k, k]), client(), rng.choice(["held", "done", "done", None]), time(), "x") for k in range(150)]
    lines = [(rng.choice([None, *range(0, 150)]), 1, time(), True) for _ in range(300)]
    return sales + sales[:3], lines + lines[:9], clicks + clicks[:20]


@pytest.mark.parametrize("seed", [1, 2])  # the first one makes all nine relations
def test_equals_brute_force(spark, seed):
    parts = made(seed)
    found = I.sale_sessions(*tables(spark, *parts))
    assert sorted(map(tuple, found.collect()), key=order) == brute(*parts)
    assert {r[1] for r in brute(*parts)} >= set(I.RELATIONS) - {"overlapped_by"}


def test_sessions_do_not_depend_on_the_zone(spark):
    parts = made(3)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = sorted(map(tuple, I.sale_sessions(*tables(spark, *parts)).collect()), key=order)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == brute(*parts)


def test_empty_tables_and_one_hot_client(spark):
    sales, lines, clicks = tables(spark, *made(4))
    for k in range(3):
        some = [x.limit(0) if j == k else x for j, x in enumerate((sales, lines, clicks))]
        assert bool(I.sale_sessions(*some).count()) == (k == 1)
    begin = ZERO + dt.timedelta(days=19724)
    hot = ([(k, 7, "held" if k % 3 == 0 else "done", begin + dt.timedelta(hours=k), "x") for k in range(400)], [(0, k, begin + dt.timedelta(days=60), None) for k in range(500)], [(k, begin + dt.timedelta(minutes=7 * k), 7, "click" if k % 2 else "view", 0) for k in range(2000)])
    assert sorted(map(tuple, I.sale_sessions(*tables(spark, *hot)).collect()), key=order) == brute(*hot)


def test_pairs_are_listed_once_each(spark):
    rng = random.Random(8)
    side = lambda n: [(k, rng.choice([None, 1, 1, 2]), s := rng.choice([None, *range(-70, 200)]), None if s is None or rng.random() < 0.2 else s + rng.choice([0, 1, 3, 40, 400])) for k in range(n)]
    a, b = side(200), side(150)
    left, right = (spark.createDataFrame(x, "id long, key long, s long, e long") for x in (a, b))
    meets = lambda p, q: p[1] is not None and p[1] == q[1] and p[2] is not None and q[2] is not None and (q[3] is None or p[2] <= q[3]) and (p[3] is None or q[2] <= p[3])
    for width in (1, 32, 1000):
        found = sorted(map(tuple, I.overlapping_pairs(left, right, width).collect()))
        assert found == sorted((p[0], q[0]) for p in a for q in b if meets(p, q))
