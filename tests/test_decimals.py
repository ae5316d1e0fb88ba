"""Decimals of any width against Python's."""

import random
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from tessera.functions import decimals as D


def texts(n, seed):
    r = random.Random(seed)
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    out = ["0", "-0", "+0.00", "1", "-1", "1.50", "1.5", "-1.25", "-1.5", "+12345678901234567", "12345678901234568", "99999999999999999999", "-" + "9" * 60, "9" * 60 + "." + "9" * 45, "0." + "0" * 40 + "1", "0.000000001", "999999999", "1000000000", "-999999999.999999999"]
    for _ in range(n):
        whole = digits(r.choice([1, 2, 9, 10, 18, 20, 38, 60])).lstrip("0") or "0"
        out.append(r.choice(["", "-", "+"]) + whole + r.choice(["", "." + digits(r.choice([1, 2, 8, 9, 10, 18, 40]))]))
    return out


def exact(x):
    return Decimal(x)


def plain(d):
    return "0" if d == 0 else format(d, "f")


def test_pairs(spark):
    with localcontext() as c:
        c.prec = 400
        a, b = texts(150, 1), texts(150, 2)
        random.Random(3).shuffle(b)
        pairs = list(zip(a, b)) + [(x, x) for x in a[:20]] + [("100", "100.5"), ("1000000000000000000000", "1000000000000000000001"), ("-5", "5")]
        df = spark.createDataFrame(pairs, "l string, r string")
        l, r = F.col("l"), F.col("r")
        rows = df.select("l", "r", D.difference(l, r).alias("d"), D.within(l, r, "0.5").alias("near"), D.within(l, r, "0.005", True).alias("relative"), D.within(l, r, "1234567890123.000000000000001", True).alias("wide"), D.scaled(l, "12345678901.5").alias("times"), D.product(l, r).alias("product"), D.added([(False, l), (True, r), (False, F.lit("0.5")), (True, l), (False, r), (True, r)]).alias("added"), (D.order_key(l) < D.order_key(r)).alias("less"), (D.order_key(l) == D.order_key(r)).alias("same")).collect()
        for x in rows:
            p, q = exact(x.l), exact(x.r)
            assert x.d == plain(q - p), x
            assert (x.less, x.same) == (p < q, p == q), x
            assert x.near == (abs(q - p) <= Decimal("0.5")) and x.relative == (abs(q - p) <= Decimal("0.005") * max(abs(p), abs(q))), x
            assert x.wide == (abs(q - p) <= Decimal("1234567890123.000000000000001") * max(abs(p), abs(q)))
            assert x.product == plain(p * q) and exact(x.added) == Decimal("0.5") - q, x
            assert exact(x.times) == abs(p) * Decimal("12345678901.5"), x


def test_sums(spark):
    with localcontext() as c:
        c.prec = 400
        r = random.Random(9)
        values = texts(1500, 4)
        rows = [(r.choice("abcdefg"), v) for v in values] + [("narrow", "1.50"), ("narrow", "-0.25"), ("zero", "5"), ("zero", "-5.0"), ("none", "x"), ("none", None), ("neg", "-" + "9" * 30), ("neg", "1"), ("wide", "99999999999999999999"), ("wide", "99999999999999999999")]
        got = {x.g: x.total for x in D.exact_sums(spark.createDataFrame(rows, "g string, v string").repartition(5), ["g"], "v").collect()}
        want = {}
        for g, v in rows:
            want.setdefault(g, []).append(v)
        for g, own in want.items():
            good = [Decimal(v) for v in own if v not in ("x", None)]
            assert got[g] == (plain(sum(good, Decimal(0))) if good else None), g


def test_aggregates(spark):
    rows = [("a", "1.5"), ("a", "1.50"), ("a", None), ("a", "-1" + "0" * 30), ("a", "x"), ("b", "9" * 40), ("b", "9" * 40), ("c", None)]
    got = {x.g: tuple(x)[1:] for x in D.exact_aggregates(spark.createDataFrame(rows, "g string, v string"), ["g"], "v").collect()}
    assert got == {"a": ("-" + "9" * 29 + "7.00", 5, "-1" + "0" * 30, "1.50"), "b": ("1" + "9" * 39 + "8", 2, "9" * 40, "9" * 40), "c": (None, 1, None, None)}


def test_gate(spark):
    rows = spark.createDataFrame([("007",), (".5",), ("1.",), ("1e5",), ("+1.5",), ("9" * 10_001,), (None,), ("NaN",)], "v string").select(D.is_decimal(F.col("v")).alias("ok"), D.order_key(F.col("v")).isNotNull().alias("key")).collect()
    assert [x.ok for x in rows] == [False, False, False, False, True, False, False, False] == [x.key for x in rows]


def test_sums_by_place_are_hashed_and_do_not_sort_texts(spark):
    rows = spark.createDataFrame([("a", "1" + "0" * 40), ("a", "-2.5"), ("a", "x"), (None, "3")], "g string, v string")
    made = D.exact_aggregates(rows, ["g"], "v")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "SortAggregate" in x and "_place" in x]
    assert {tuple(x) for x in made.collect()} == {("a", str(10**40 - 3) + ".5", 3, "-2.5", "1" + "0" * 40), (None, "3", 1, "3", "3")}
