"""How filters interact: what each of them removes, and loses, in every order they can stand in.

Each filter's failing documents are a stored relation of ids of their own. What a filter removes depends on the
set of filters before it, not on their order. So the relation of removals (filter, filters before, document) starts
with nothing before and takes in one filter after the other: a left-anti join with that filter's
failing ids gives the removals behind it. Five joins give all sets of earlier filters. Left-semi joins with
the ids of good and of toxic documents give the labels lost. Counts per set are then dealt to all orders.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Shares that each group of equal texts is dealt to.
SALTS = 32


def text_filters(text: Column, fewest_words: int = 100, distinct_percent: int = 80, upper_percent: int = 10) -> dict[str, Column]:
    """Failure conditions of one text: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < fewest_words,
        "B": F.size(F.array_distinct(words)) * 100 < n * distinct_percent,
        "C": capitals * 100 > F.char_length(text) * upper_percent,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failing_ids(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang", duplicates: str = "E",
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All documents ``row, doc_id, part`` and, for each filter, the stored relation of those that fail it.

    ``row`` tells documents apart, also repeated rows and null ids. The filter ``duplicates`` fails a text that some
    smaller id has; a null id is neither smaller nor larger. Null texts are empty, null parts the empty string.
    Equal texts meet by their digest; each group is dealt to ``SALTS`` shares on the side that holds all its rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(part_column), F.lit("")).alias("part"), text.alias("text"))
    conditions = text_filters(F.col("text"))
    checked = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *(c.alias(f) for f, c in conditions.items()))
    checked = stored(checked.withColumn("row", F.monotonically_increasing_id()), "checked")
    first = checked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = checked.select("row", "doc_id", "part", "digest", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = dealt.join(first, ["digest", "salt"]).filter("doc_id > first")
    columns = ["row", "doc_id", "part"]
    relations = {f: stored(checked.filter(F.col(f)).select(*columns), f"failing-{f}") for f in conditions}
    return checked.select(*columns), relations | {duplicates: stored(copies.select(*columns), f"failing-{duplicates}")}


def removals(relations: dict[str, DataFrame]) -> DataFrame:
    """``filter, before, row, doc_id, part``: documents that each filter removes behind each set of others.

    ``before`` is a bit set of filters in the order of ``relations``.
    """
    names = list(relations)
    found = reduce(DataFrame.unionByName, (r.select(F.lit(k).alias("filter"), F.lit(0).alias("before"), "row", "doc_id", "part") for k, r in enumerate(relations.values())))
    for k, name in enumerate(names):
        behind = found.filter(F.col("filter") != k).join(relations[name].select("row"), "row", "left_anti")
        found = stored(found.unionByName(behind.withColumn("before", F.col("before").bitwiseOR(F.lit(1 << k))).select(*found.columns)), "removals")
    return found


def audit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang",
    good_column: str = "quality", toxic_column: str = "toxic",
) -> DataFrame:
    """One row per part, order of the five filters and step; zeros included.

    ``part, filter_order, step``; counts of the part's documents ``kept`` after the step, ``removed`` at it,
    ``redundant`` (its filter fails them, an earlier one has removed them), ``unique_fails`` (only its filter fails
    them), ``good_lost`` and ``toxic_lost`` (removed here, with such a label), and ``shapley``: what its filter removes,
    summed over all orders. Every row counts as a document, repeated rows too. A null part is the empty string.
    Documents without a label, or without an id, are neither good nor toxic; of several labels of an id one is enough. No documents give no rows.
    """
    every, relations = failing_ids(docs, id_column, text_column, part_column)
    names, found = list(relations), removals(relations)
    everything = (1 << len(names)) - 1
    key = ["part", "filter", "before"]
    counts = found.groupBy(*key).agg(F.count("*").alias("removed"))
    for column, name in ((good_column, "good_lost"), (toxic_column, "toxic_lost")):
        marked = labels.filter(F.col(column) == 1).select(F.col(id_column).alias("doc_id"))
        counts = counts.join(found.join(marked, "doc_id", "left_semi").groupBy(*key).agg(F.count("*").alias(name)), key, "left")
    counts = counts.na.fill(0)
    failing = counts.filter("before = 0").select("part", "filter", F.col("removed").alias("failing"))
    alone = counts.filter(F.col("before") == F.lit(everything) - F.expr("shiftleft(1, filter)")).select("part", "filter", F.col("removed").alias("unique_fails"))
    # How many of the orders put exactly this set before the filter.
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names)))), F.bit_count("before") + 1)
    share = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    per_filter = failing.join(alone, ["part", "filter"], "left").join(share, ["part", "filter"], "left")
    steps = [
        ("".join(names[k] for k in order), step + 1, order[step], sum(1 << k for k in order[:step]))
        for order in permutations(range(len(names))) for step in range(len(names))
    ]
    orders = docs.sparkSession.createDataFrame([(k, *row) for k, row in enumerate(steps)], "place int, filter_order string, step int, filter int, before int")
    # Each part gets the places of the fixed table of all orders, which is as long whatever the data.
    parts = every.groupBy("part").agg(F.count("*").alias("documents")).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    placed = parts.join(F.broadcast(orders), "place")
    placed = placed.join(counts, key, "left").join(per_filter, ["part", "filter"], "left").na.fill(0)
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return placed.select(
        "part", "filter_order", "step", (F.col("documents") - so_far).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
