"""The Spark form of every pattern finds what Python's ``re`` finds."""

import random
import re

from pyspark.sql import functions as F

from fleetscope import catalogue as c
from fleetscope.functions import text

PIECES = [
    "SELECT", "select", "ſelect", "insert", "FROM", "from", " ", "  ", "\t", "\n", "\r", "\x85", " ", " ", "\x1c", "é", "t1",
    "_", "@app.get(", "@app.route (", "@router.delete(", "@api.resource(", "('/a')", '("/b")', "'", '"', ")", "(", "+", "%", ".format(",
    "token", "TOKEN", "KEY", "Key", "key", "=", "AWS_X", "{", 'f"', "path(", "app.post(", "def f(", "a, b", "service_", "api", "worker-x",
    "db.session.add(", ".objects.get(", "requests.get (", "redis.Redis(", "feat: x", "fix(", "): y", "٣", "²",
]
IGNORING = [*c.SQL_BUILDING_PATTERNS, *c.SECRET_PATTERNS, c.SQL_FSTRING_PATTERN, *c.DB_QUERY_PATTERNS.values()]
EXACT = [
    *c.DIFF_ROUTE_PATTERNS, *c.LIBRARY_CALL_PATTERNS.values(), *c.ENDPOINT_PATTERNS.values(), c.SCOPE_PATTERN, c.HEADER_PATTERN,
    r"def\s+(\w+)\s*\(([^)]*)\)",
]


def samples():
    dice = random.Random(11)
    return ["".join(dice.choice(PIECES) for _ in range(dice.randint(1, 14))) for _ in range(3000)]


def test_matches_equal_python(spark):
    texts = samples()
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cases = [(p, False) for p in EXACT] + [(p, True) for p in IGNORING]
    found = table.select("i", *[
        F.regexp_extract_all("t", F.lit(text.pattern(p, fold)), F.lit(0)).alias(f"m{n}") for n, (p, fold) in enumerate(cases)
    ]).collect()
    hits = 0
    for row in found:
        for n, (p, fold) in enumerate(cases):
            expected = [m.group(0) for m in re.finditer(p, texts[row.i], re.IGNORECASE if fold else 0)]
            assert row[f"m{n}"] == expected, (p, texts[row.i])
            hits += len(expected)
    assert hits > 1000


def test_joined_search_equals_search_by_line(spark):
    texts = samples()
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    cases = [(p, False) for p in c.DIFF_ROUTE_PATTERNS] + [(p, True) for p in [*c.SQL_BUILDING_PATTERNS, *c.SECRET_PATTERNS]]
    found = table.select("i", *[
        F.col("t").rlike(text.pattern(p, fold, one_line=True)).alias(f"m{n}") for n, (p, fold) in enumerate(cases)
    ]).collect()
    for row in found:
        for n, (p, fold) in enumerate(cases):
            flags = re.IGNORECASE if fold else 0
            assert row[f"m{n}"] == any(re.search(p, line, flags) for line in texts[row.i].split("\n")), (p, texts[row.i])


def test_strip_words_and_fixed(spark):
    table = spark.createDataFrame([("  a b \x1c",)], "t string")
    row = table.select(text.strip(F.col("t")).alias("s"), text.words(F.col("t")).alias("w")).first()
    assert row.s == "a b" and row.w == "  a b \x1c".split()
    values = [0.125, 0.375, 2.675, 10.25, 1234567.5, 0.0, 10.05]
    numbers = spark.createDataFrame([(v,) for v in values], "v double")
    got = numbers.select("v", text.fixed(F.col("v"), 2).alias("two"), text.fixed(F.col("v"), 1).alias("one")).collect()
    for r in got:
        assert (r.two, r.one) == (f"{r.v:.2f}", f"{r.v:.1f}")
