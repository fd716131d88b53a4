"""Graph operators as rounds of joins over edge tables.

Every round is materialised in the shared checkpoint folder, so a lost executor
costs one round and plans stay short. A simple path visits a node once, so rounds end
by themselves. All graphs of a table advance together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def cyclic_core(edges: DataFrame, key: str) -> DataFrame:
    """Edges left after repeatedly dropping nodes without an in- or an out-edge."""
    core = cut_lineage(edges.select(key, "source", "target").distinct())
    size = core.count()
    while size:
        heads = core.select(key, F.col("target").alias("source")).distinct()
        tails = core.select(key, F.col("source").alias("target")).distinct()
        core = cut_lineage(core.join(heads, [key, "source"], "left_semi").join(tails, [key, "target"], "left_semi"))
        left = core.count()
        if left == size:
            break
        size = left
    return core.select(key, "source", "target")


def least_reaching(edges: DataFrame, key: str) -> DataFrame:
    """``key, node, least``: the smallest node from which a path leads to each node, itself included.

    What reaches the node that reaches me reaches me: each round takes a step along the edges and a
    jump along the answers so far, so rounds follow the logarithm of a path rather than its length.
    """
    nodes = edges.select(key, F.explode(F.array("source", "target")).alias("node")).distinct()
    found = cut_lineage(nodes.withColumn("least", F.col("node")))
    while True:
        pushed = edges.join(found.withColumnRenamed("node", "source"), [key, "source"]).groupBy(key, F.col("target").alias("node")).agg(F.min("least").alias("pushed"))
        grown = found.join(pushed, [key, "node"], "left").select(key, "node", F.least("least", "pushed").alias("next"), F.col("least").alias("before"))
        jump = grown.select(key, F.col("node").alias("next"), F.col("next").alias("jumped"))
        grown = cut_lineage(grown.join(jump, [key, "next"]).select(key, "node", F.least("next", "jumped").alias("least"), "before"))
        found = grown.select(key, "node", "least")
        if grown.filter("least <> before").isEmpty():
            return found


def strong_components(edges: DataFrame, key: str = "repo_id") -> DataFrame:
    """``key, component, node`` of every node on a cycle; ``component`` is the smallest node it shares cycles with.

    A turn colours each node with the smallest node that reaches it. Nodes from which a path inside their colour leads
    back to that node are its component. What is left is trimmed and takes the next turn.
    """
    core, found = cyclic_core(edges, key), []
    while not core.isEmpty():
        colour = least_reaching(core, key)
        inside = core
        for end in ("source", "target"):
            inside = inside.join(colour.select(key, F.col("node").alias(end), F.col("least").alias(f"{end}_colour")), [key, end])
        inside = cut_lineage(inside.filter("source_colour = target_colour").select(key, F.col("source").alias("target"), F.col("target").alias("source")))
        back = least_reaching(inside, key).withColumnRenamed("least", "component")
        members = cut_lineage(back.join(colour, [key, "node"]).filter("component = least").select(key, "component", "node"))
        found.append(members)
        # Nodes without an edge inside their colour are on no cycle either.
        alone = colour.filter("node = least").select(key, "node")
        gone = cut_lineage(members.select(key, "node").unionByName(alone).distinct())
        for end in ("source", "target"):
            core = core.join(gone.withColumnRenamed("node", end), [key, end], "left_anti")
        core = cyclic_core(core, key)
    if not found:
        return edges.select(key, F.col("source").alias("component"), F.col("source").alias("node")).limit(0)
    # A node between two cycles is a component without an edge of its own.
    named = cut_lineage(_union(found))
    tails = edges.select(key, F.col("source").alias("node"), F.col("target").alias("other")).distinct().join(named, [key, "node"])
    cyclic = tails.join(named.withColumnRenamed("node", "other"), [key, "other", "component"]).select(key, "component").distinct()
    return named.join(cyclic, [key, "component"], "left_semi").select(key, "component", "node")


def inner_edges(edges: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """Edges between two nodes of one component: only these lie on cycles."""
    named = edges.select(key, "source", "target").distinct()
    for end in ("source", "target"):
        named = named.join(components.select(key, F.col("node").alias(end), F.col("component").alias(f"{end}_component")), [key, end])
    return named.filter("source_component = target_component").select(key, "source", "target")


def simple_cycles(edges: DataFrame, key: str = "repo_id") -> DataFrame:
    """Every simple cycle once, starting at its smallest node: ``key, cycle``.

    Where long paths lie between cycles, hand on ``inner_edges`` of the strong components: they are not walked then.
    """
    core = cyclic_core(edges, key)
    step = core.withColumnsRenamed({"source": "tail", "target": "next"})
    loops = core.filter("source = target").select(key, F.array("source").alias("cycle"))
    paths = core.filter("source < target").select(
        key, F.array("source", "target").alias("cycle"), F.col("target").alias("tail")
    )
    found = [loops]
    while True:
        start = F.get("cycle", F.lit(0))
        grown = paths.join(step, [key, "tail"]).filter(
            (F.col("next") == start) | ((F.col("next") > start) & ~F.array_contains("cycle", F.col("next")))
        )
        grown = cut_lineage(grown)
        found.append(grown.filter(F.col("next") == start).select(key, "cycle"))
        open_paths = grown.filter(F.col("next") != start)
        if open_paths.isEmpty():
            return _union(found)
        paths = open_paths.select(key, F.array_append("cycle", F.col("next")).alias("cycle"), F.col("next").alias("tail"))


def _passages(edges: DataFrame, components: DataFrame, key: str, keep: int) -> DataFrame:
    """``key, source, target, via``: the ``keep`` longest simple paths through a component, from where one comes in to where
    one goes out; ``via`` holds the nodes after ``source``. Only edges inside components are walked."""
    inner = inner_edges(edges, components, key)
    outer = edges.join(inner, [key, "source", "target"], "left_anti")
    node = components.select(key, "node")
    entries = outer.select(key, F.col("target").alias("node")).distinct().join(node, [key, "node"], "left_semi")
    exits = outer.select(key, F.col("source").alias("node")).distinct().join(node, [key, "node"], "left_semi")
    step = cut_lineage(inner.filter("source <> target").withColumnsRenamed({"source": "tail", "target": "next"}))
    paths = cut_lineage(entries.select(key, F.col("node").alias("tail"), F.array("node").alias("path")))
    walked = [paths]
    while not paths.isEmpty():
        grown = paths.join(step, [key, "tail"]).filter(~F.array_contains("path", F.col("next")))
        paths = cut_lineage(grown.select(key, F.col("next").alias("tail"), F.array_append("path", F.col("next")).alias("path")))
        walked.append(paths)
    rank = Window.partitionBy(key, F.get("path", F.lit(0)), "tail").orderBy(F.desc(F.size("path")), "path")
    through = _union(walked).join(exits.withColumnRenamed("node", "tail"), [key, "tail"], "left_semi")
    best = through.withColumn("position", F.row_number().over(rank)).filter(F.col("position") <= keep)
    return best.select(
        key, F.get("path", F.lit(0)).alias("source"), F.col("tail").alias("target"), F.slice("path", 2, F.size("path")).alias("via")
    )


def _place(node: Column, leaving: Column) -> Column:
    return F.struct(node.alias("node"), leaving.alias("leaving"))


def _acyclic_steps(edges: DataFrame, key: str, keep: int) -> DataFrame:
    """``key, source, target, via`` without cycles, with the same ``keep`` longest paths as ``edges``.

    Each node of a component stands twice, as a place to come in and one to leave from; the passages between
    the two take the place of the edges inside the component.
    """
    components = strong_components(edges, key)
    if components.isEmpty():
        ends = [_place(F.col(end), F.lit(False)).alias(end) for end in ("source", "target")]
        return edges.select(key, *ends, F.array("target").alias("via"))
    inside = components.select(key, F.col("node").alias("source"), F.lit(True).alias("leaving"))
    outer = edges.join(inner_edges(edges, components, key), [key, "source", "target"], "left_anti")
    outer = outer.join(inside, [key, "source"], "left").select(
        key, _place(F.col("source"), F.coalesce("leaving", F.lit(False))).alias("source"),
        _place(F.col("target"), F.lit(False)).alias("target"), F.array("target").alias("via"),
    )
    through = _passages(edges, components, key, keep).select(
        key, _place(F.col("source"), F.lit(False)).alias("source"), _place(F.col("target"), F.lit(True)).alias("target"), "via"
    )
    return outer.unionByName(through)


#: Lengths beyond this stand on cycles only and are never read.
_NO_LENGTH = 1 << 60


def topological_levels(nodes: DataFrame, edges: DataFrame, key: str = "plan_id") -> DataFrame:
    """``key, node, level``: longest distance from a root.

    ``nodes`` holds ``key, node, weight``: weight 1 for a real node, 0 for a hub,
    which passes its level on without adding one. Edges must be distinct. Nodes
    on or behind a cycle get no row.

    A common start (null) leads to every root. A node with one in-edge has the level of that edge's source plus its length, so
    in each round all edges leaving such nodes start from their sources instead, and parallel edges become the longest of them.
    Reach doubles from round to round along chains and through forks that join again: rounds follow the logarithm of a chain.
    A node is settled when its one edge leaves the start; each round settles at least one that no cycle leads to. Where forks
    do not join again, as in a grid, rounds still follow the longest path.
    """
    real = nodes.filter("weight = 1").select(key, "node").distinct()
    length = nodes.select(key, F.col("node").alias("source"), F.col("weight").cast("long").alias("length"))
    given = edges.select(key, "source", "target").join(length, [key, "source"])
    roots = nodes.select(key, F.col("node").alias("target")).distinct().join(edges.select(key, "target"), [key, "target"], "left_anti")
    start = roots.withColumn("source", F.lit(None).cast(given.schema["source"].dataType)).withColumn("length", F.lit(0).cast("long"))
    waiting = cut_lineage(given.unionByName(start))
    settled = []
    while True:
        single = waiting.groupBy(key, F.col("target").alias("node")).agg(
            F.count("*").alias("n"), F.min("source").alias("from"), F.min("length").alias("before")
        ).filter("n = 1").drop("n")
        single = cut_lineage(single)
        done = single.filter(F.col("from").isNull()).select(key, "node", F.col("before").cast("int").alias("level"))
        if done.isEmpty():
            break
        settled.append(done)
        # Settled nodes leave the table, so no edge may come to start from one.
        at_end = done.select(key, F.col("node").alias("from"), F.col("level").cast("long").alias("at"))
        single = single.join(at_end, [key, "from"], "left").select(
            key, "node", F.when(F.col("at").isNull(), F.col("from")).alias("from"), (F.col("before") + F.coalesce("at", F.lit(0))).alias("before")
        )
        left = waiting.join(done.select(key, F.col("node").alias("target")), [key, "target"], "left_anti")
        moved = left.join(single.withColumnRenamed("node", "source"), [key, "source"], "left")
        waiting = cut_lineage(moved.select(
            key, F.when(F.col("before").isNull(), F.col("source")).otherwise(F.col("from")).alias("source"), "target",
            F.least(F.col("length") + F.coalesce("before", F.lit(0)), F.lit(_NO_LENGTH)).alias("length"),
        ).groupBy(key, "source", "target").agg(F.max("length").alias("length")))
    if not settled:
        return nodes.select(key, "node", F.lit(0).alias("level")).limit(0)
    return _union(settled).join(real, [key, "node"], "left_semi")


def _in_degrees(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    degree = edges.groupBy(key, F.col("target").alias("node")).agg(F.count("*").alias("waits_for"))
    return nodes.join(degree, [key, "node"], "left").fillna(0, ["waits_for"])


def _best(paths: Column, keep: int) -> Column:
    """The ``keep`` longest of an array of paths; equal lengths in path order."""
    keyed = F.transform(paths, lambda p: F.struct((-F.size(p)).alias("rank"), p.alias("path")))
    return F.transform(F.slice(F.sort_array(keyed), 1, keep), lambda k: k["path"])


def longest_paths(edges: DataFrame, key: str = "plan_id", keep: int = 3) -> DataFrame:
    """The ``keep`` longest simple root-to-leaf paths per graph: ``key, position, path``.

    Nodes pass only the ``keep`` best partial paths on: a path ranked lower at a
    node cannot rank higher further on, so the exponential number of paths is
    never listed. That needs a graph without cycles. A path that has left a
    strong component never comes back, so simple paths are listed inside
    components only, and the best of them stand as edges of an acyclic graph.
    """
    given = cut_lineage(edges.select(key, "source", "target").distinct())
    outgoing = cut_lineage(_acyclic_steps(given, key, keep))
    nodes = outgoing.select(key, F.explode(F.array("source", "target")).alias("node")).distinct()
    # Roots and leaves are those of the given graph: a cycle without a way in is no root, one without a way out no leaf.
    leaf = given.select(key, F.col("target").alias("leaf")).distinct().join(
        given.select(key, F.col("source").alias("leaf")), [key, "leaf"], "left_anti").withColumn("is_leaf", F.lit(True))
    root = given.select(key, F.col("source").alias("root")).distinct().join(
        given.select(key, F.col("target").alias("root")), [key, "root"], "left_anti").withColumn("is_root", F.lit(True))
    named = nodes.withColumn("leaf", F.col("node.node")).withColumn("root", F.col("node.node"))
    named = named.join(leaf, [key, "leaf"], "left").join(root, [key, "root"], "left")
    none = F.array().cast("array<array<string>>")
    pending = _in_degrees(named.select(key, "node", "is_leaf", "is_root"), outgoing, key)
    pending = cut_lineage(pending.select(
        key, "node", "is_leaf", "waits_for", F.when(F.col("is_root"), F.array(F.array("node.node"))).otherwise(none).alias("paths")
    ))
    rank = Window.partitionBy(key, "node").orderBy(F.desc(F.size("path")), "path")
    leaves = []
    while True:
        ready = pending.filter("waits_for = 0")
        if ready.isEmpty():
            break
        leaves.append(ready.filter("is_leaf").select(key, F.explode("paths").alias("path")))
        moves = ready.select(key, F.col("node").alias("source"), "paths").join(outgoing, [key, "source"])
        arrivals = moves.groupBy(key, F.col("target").alias("node")).agg(F.count("*").alias("arrived"))
        offered = (
            moves.select(key, F.col("target").alias("node"), "via", F.explode("paths").alias("path"))
            .withColumn("path", F.concat("path", "via"))
            .withColumn("position", F.row_number().over(rank))
            .filter(F.col("position") <= keep)
            .groupBy(key, "node").agg(F.collect_list("path").alias("offered"))
        )
        waiting = pending.filter("waits_for > 0").join(arrivals, [key, "node"], "left").join(offered, [key, "node"], "left")
        pending = cut_lineage(
            waiting.select(
                key, "node", "is_leaf",
                (F.col("waits_for") - F.coalesce("arrived", F.lit(0))).alias("waits_for"),
                _best(F.concat("paths", F.coalesce("offered", none)), keep).alias("paths"),
            )
        )
    if not leaves:
        return given.select(key, F.lit(1).alias("position"), F.array("source").alias("path")).limit(0)
    order = Window.partitionBy(key).orderBy(F.desc(F.size("path")), "path")
    return _union(leaves).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= keep).select(
        key, "position", "path"
    )


def sharing_groups(tables: DataFrame) -> DataFrame:
    """Greedy shared-table groups in service-name order: ``repo_id, seed, service``.

    A service is a seed when no earlier service it shares a table with is one; a
    seed claims the services sharing a table with it, and a service shared by
    several seeds goes to the earliest. Seeds that claim nobody are left out.

    Services talk through their tables: a round takes the first undecided service
    of every table, so the work is linear in the (service, table) rows and no
    service pairs are formed.
    """
    uses = cut_lineage(tables.select("repo_id", "table", "service").distinct())
    as_seed = uses.withColumnRenamed("service", "seed")
    undecided = uses
    claims = []
    while True:
        # First undecided service per table; a seed is first in all of its tables.
        first = undecided.groupBy("repo_id", "table").agg(F.min("service").alias("first"))
        seeds = (
            undecided.join(first, ["repo_id", "table"])
            .groupBy("repo_id", "service")
            .agg(F.min(F.col("service") == F.col("first")).alias("is_seed"))
            .filter("is_seed").select("repo_id", F.col("service").alias("seed"))
        )
        seed_tables = as_seed.join(seeds, ["repo_id", "seed"])
        # Two seeds of a round never share a table, so a table has one seed at most.
        touched = (
            undecided.join(seed_tables, ["repo_id", "table"])
            .groupBy("repo_id", "service").agg(F.min("seed").alias("seed"))
        )
        touched = cut_lineage(touched)
        if touched.isEmpty():
            break
        claims.append(touched)
        undecided = cut_lineage(undecided.join(touched, ["repo_id", "service"], "left_anti"))
    if not claims:
        return tables.select("repo_id", F.col("service").alias("seed"), "service").limit(0)
    # A member decided in an early round may touch a seed found later; the earliest seed wins.
    decided = cut_lineage(_union(claims))
    seeds = decided.filter("seed = service").select("repo_id", "seed")
    seed_tables = as_seed.join(seeds, ["repo_id", "seed"])
    best = uses.join(seed_tables, ["repo_id", "table"]).groupBy("repo_id", "service").agg(F.min("seed").alias("seed"))
    own = decided.select("repo_id", "service", (F.col("seed") == F.col("service")).alias("is_seed"))
    members = best.join(own, ["repo_id", "service"]).select(
        "repo_id", F.when(F.col("is_seed"), F.col("service")).otherwise(F.col("seed")).alias("seed"), "service"
    )
    sizes = members.groupBy("repo_id", "seed").agg(F.count("*").alias("n_services")).filter("n_services > 1")
    return members.join(sizes, ["repo_id", "seed"]).select("repo_id", "seed", "service", "n_services")
