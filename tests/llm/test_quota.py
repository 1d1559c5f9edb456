"""Quotas: largest remainder, floors, caps and refills, against a plain computation."""

import random

from pyspark.sql import functions as F

from loomstone.llm.quota import allocate_quotas


def plain(pools, weights, size, refill):
    total = sum(weights)
    exact = [size * w / total for w in weights]
    base = [int(x + 1e-9) for x in exact]
    turn = sorted(range(len(base)), key=lambda i: (-(exact[i] - base[i]), i))
    for i in turn[: size - sum(base)]:
        base[i] += 1
    quota = [min(b, p) for b, p in zip(base, pools, strict=True)]
    missing = min(sum(base) - sum(quota), sum(p - q for p, q, w in zip(pools, quota, weights, strict=True) if w > 0))
    return base, quota, missing


def test_against_plain(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(40):
        n = rng.randint(1, 6)
        pools = [rng.randint(0, 30) for _ in range(n)]
        weights = [rng.randint(1, 9) for _ in range(n)]
        size = rng.randint(1, 60)
        rows += [(g, f"c{i}", pools[i], weights[i], size) for i in range(n)]
        want[g] = plain(pools, weights, size, False)
    df = spark.createDataFrame(rows, "g int, cat string, pool int, want int, size int")
    fixed = allocate_quotas(df, ["g"], "cat", "pool", "want", total="size").collect()
    for g, (asked, quota, _) in want.items():
        got = sorted((r.cat, r.asked, r.quota) for r in fixed if r.g == g)
        assert got == [(f"c{i}", a, q) for i, (a, q) in enumerate(zip(asked, quota, strict=True))]
    filled = allocate_quotas(df, ["g"], "cat", "pool", "want", total="size", refill=True).collect()
    for g, (_, quota, missing) in want.items():
        mine = {r.cat: r for r in filled if r.g == g}
        assert sum(r.quota for r in mine.values()) == sum(quota) + missing
        assert all(r.quota <= r.pool for r in mine.values())
        assert all(mine[f"c{i}"].quota >= q for i, q in enumerate(quota))


def test_floor(spark):
    df = spark.createDataFrame([("a", 100, 98, 5), ("b", 100, 1, 5), ("c", 2, 1, 5)], "cat string, pool int, want int, least int")
    got = {r.cat: (r.asked, r.quota, r.shortfall) for r in allocate_quotas(df, [], "cat", "pool", "want", "least").collect()}
    assert got == {"a": (98, 98, 0), "b": (5, 5, 0), "c": (5, 2, 3)}  # no total: floors come on top
    sized = df.withColumn("size", F.lit(100))
    got = {r.cat: (r.asked, r.quota) for r in allocate_quotas(sized, [], "cat", "pool", "want", "least", "size", refill=True).collect()}
    assert got == {"a": (90, 93), "b": (5, 5), "c": (5, 2)}
    small = spark.createDataFrame([("a", 50, 0.98, 3), ("b", 50, 0.01, 3), ("c", 50, 0.01, 3)], "cat string, pool int, want double, least int")
    for size, want in ((10, (4, 3, 3)), (9, (3, 3, 3)), (7, (3, 2, 2)), (1000, (50, 50, 50)), (0, (0, 0, 0))):
        got = allocate_quotas(small.withColumn("size", F.lit(size)), [], "cat", "pool", "want", "least", "size", refill=True).collect()
        assert tuple(r.quota for r in sorted(got, key=lambda r: r.cat)) == want


def test_floors_caps_and_refill_against_bisection(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(60):
        n = rng.randint(1, 6)
        pools, weights, floors = [rng.randint(0, 30) for _ in range(n)], [rng.choice([0, 1, 2.5, 7, 40]) for _ in range(n)], [rng.choice([0, 0, 3, 9]) for _ in range(n)]
        size = rng.randint(0, 90)
        rows += [(g, f"c{i}", pools[i], weights[i] * 1.0, floors[i], size) for i in range(n)]
        lows = [min(f, p) for f, p in zip(floors, pools, strict=True)]
        highs, v = pools, weights
        if sum(lows) > size:
            lows, highs, v = [0] * n, lows, lows
        goal = min(size, sum(h if w > 0 else lo for lo, h, w in zip(lows, highs, v, strict=True)))
        a, b = 0.0, 1e9
        stand = lambda x: [min(max(x * w, lo), h) if w > 0 else lo for w, lo, h in zip(v, lows, highs, strict=True)]  # noqa: B023, E731
        for _ in range(200):
            a, b = ((a + b) / 2, b) if sum(stand((a + b) / 2)) < goal else (a, (a + b) / 2)
        want[g] = (goal, stand(b))
    df = spark.createDataFrame(rows, "g int, cat string, pool int, want double, least int, size int")
    for r in allocate_quotas(df, ["g"], "cat", "pool", "want", "least", "size", refill=True).collect():
        goal, exact = want[r.g]
        assert abs(r.quota - exact[int(r.cat[1:])]) < 1 and r.quota <= r.pool
        want[r.g] = (goal - r.quota, exact)
    assert all(left == 0 for left, _ in want.values())
