import random

import pytest
from helpers import rows

from fleetscope.operators import graphs


def adjacency(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    return near


def all_paths(edges):
    near = adjacency(edges)
    paths = []

    def extend(path):
        following = near.get(path[-1], set())
        if not following:
            paths.append(path)
        for node in following:
            if node not in path:
                extend(path + [node])

    for root in {a for a, _ in edges} - {b for _, b in edges}:
        extend([root])
    return sorted(paths, key=lambda p: (-len(p), p))


def all_cycles(edges):
    near = adjacency(edges)
    cycles = set()

    def extend(path):
        for node in near.get(path[-1], ()):
            if node == path[0]:
                cycles.add(tuple(path))
            elif node > path[0] and node not in path:
                extend(path + [node])

    for start in near:
        extend([start])
    return cycles


def all_levels(nodes, edges):
    levels, left = {}, set(nodes)
    while True:
        ready = {n for n in left if all(a in levels for a, b in edges if b == n)}
        if not ready:
            return levels
        for n in ready:
            levels[n] = max((levels[a] + 1 for a, b in edges if b == n), default=0)
        left -= ready


@pytest.fixture(scope="module")
def random_graphs():
    dice = random.Random(7)
    found = {}
    for g in range(80):
        size = dice.randint(2, 8)
        edges = set()
        for _ in range(dice.randint(1, 12)):
            a, b = dice.randrange(size), dice.randrange(size)
            if g % 3 and a > b:
                a, b = b, a
            if a != b:
                edges.add((f"n{a}", f"n{b}"))
        found[f"p{g}"] = ({f"n{i}" for i in range(size)}, edges)
    return found


@pytest.fixture(scope="module")
def edge_table(spark, random_graphs):
    data = [(k, a, b) for k, (_, edges) in random_graphs.items() for a, b in edges]
    return spark.createDataFrame(data, "plan_id string, source string, target string").cache()


def test_sharing_groups_hold_their_rules(spark):
    """Instead of a second implementation: what every grouping in name order must satisfy, which leaves one grouping only."""
    dice = random.Random(3)
    used = {}
    for r in range(120):
        tables = [f"t{k}" for k in range(dice.randint(1, 10))]
        used[f"r{r}"] = {f"s{k:02d}": frozenset(dice.sample(tables, dice.randint(0, min(3, len(tables))))) for k in range(dice.randint(2, 12))}
    data = [(r, s, t) for r, services in used.items() for s, tables in services.items() for t in tables]
    found = graphs.sharing_groups(spark.createDataFrame(data, "repo_id string, service string, table string")).collect()
    seed_of = {(r.repo_id, r.service): r.seed for r in found}
    assert len(seed_of) == len(found)
    for r, services in used.items():
        # Alone or not, a service that no group claims stands for itself.
        seed = {s: seed_of.get((r, s), s) for s in services}
        seeds = {s for s in services if seed[s] == s}
        for s, tables in services.items():
            earlier = {x for x in seeds if x < s and services[x] & tables}
            assert seed[s] == min(earlier, default=s)  # the earliest seed that shares a table, one hop away
        for row in found:
            if row.repo_id == r:
                assert row.n_services == sum(x == row.seed for x in seed.values()) > 1


def test_sharing_is_one_hop(spark):
    chain = spark.createDataFrame([("r", "a", "t1"), ("r", "b", "t1"), ("r", "b", "t2"), ("r", "c", "t2")],
                                  "repo_id string, service string, table string")
    assert rows(graphs.sharing_groups(chain), "seed", "service") == [("a", "a"), ("a", "b")]


def test_levels(spark, random_graphs, edge_table):
    nodes = spark.createDataFrame([(k, n, 1) for k, (names, _) in random_graphs.items() for n in names],
                                  "plan_id string, node string, weight int")
    expected = {(k, n, l) for k, (names, edges) in random_graphs.items() for n, l in all_levels(names, edges).items()}
    assert {tuple(r) for r in graphs.topological_levels(nodes, edge_table).collect()} == expected


def test_longest_paths(random_graphs, edge_table):
    expected = {(k, i + 1, tuple(p)) for k, (_, edges) in random_graphs.items() for i, p in enumerate(all_paths(edges)[:3])}
    got = {(r.plan_id, r.position, tuple(r.path)) for r in graphs.longest_paths(edge_table).collect()}
    assert got == expected


def test_cycles(random_graphs, edge_table):
    expected = {(k, c) for k, (_, edges) in random_graphs.items() for c in all_cycles(edges)}
    got = [(r.plan_id, tuple(r.cycle)) for r in graphs.simple_cycles(edge_table, "plan_id").collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_strong_components(random_graphs, edge_table):
    expected = set()
    for k, (_, edges) in random_graphs.items():
        reach = set(edges)
        while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
            reach |= more
        expected |= {(k, min(b for a, b in reach if a == n and (b, n) in reach), n) for n, m in reach if n == m}
    got = [tuple(r) for r in graphs.strong_components(edge_table, "plan_id").select("plan_id", "component", "node").collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_a_lattice_beside_and_between_cycles_is_not_walked(spark):
    layers = [(f"m{k}{a}", f"m{k + 1}{b}") for k in range(10, 40) for a in "xyz" for b in "xyz"]
    ends = [("a", "b"), ("b", "a"), ("b", "m10x"), ("m40x", "y"), ("y", "z"), ("z", "y")]
    edges = spark.createDataFrame([("p", *e) for e in layers + ends], "plan_id string, source string, target string")
    inside = graphs.inner_edges(edges, graphs.strong_components(edges, "plan_id"), "plan_id")
    assert sorted(r.cycle for r in graphs.simple_cycles(inside, "plan_id").collect()) == [["a", "b"], ["y", "z"]]


def test_self_loop(spark):
    ring = spark.createDataFrame([("p", f"n{i}", f"n{(i + 1) % 6}") for i in range(6)] + [("p", "n9", "n9")],
                                 "plan_id string, source string, target string")
    got = sorted(r.cycle for r in graphs.simple_cycles(ring, "plan_id").collect())
    assert got == [["n0", "n1", "n2", "n3", "n4", "n5"], ["n9"]]


def test_long_ring_beside_a_small_graph(spark):
    data = [("long", f"n{i:03d}", f"n{(i + 1) % 110:03d}") for i in range(110)] + [("small", "a", "b"), ("small", "b", "a")]
    edges = spark.createDataFrame(data, "plan_id string, source string, target string")
    got = {r.plan_id: len(r.cycle) for r in graphs.simple_cycles(edges, "plan_id").collect()}
    assert got == {"long": 110, "small": 2}


def test_no_edges(spark):
    none = spark.createDataFrame([], "plan_id string, source string, target string")
    assert graphs.simple_cycles(none, "plan_id").count() == 0
    assert graphs.strong_components(none, "plan_id").count() == 0
    assert graphs.longest_paths(none).count() == 0
    empty = spark.createDataFrame([], "repo_id string, service string, table string")
    assert graphs.sharing_groups(empty).count() == 0


@pytest.fixture
def rounds(monkeypatch):
    made = []
    cut = graphs.cut_lineage
    monkeypatch.setattr(graphs, "cut_lineage", lambda df: made.append(1) or cut(df))
    return made


def test_rounds_of_levels_follow_the_logarithm_of_a_chain(spark, rounds):
    names = [f"n{i:04d}" for i in range(2000)]
    chain = list(zip(names, names[1:]))
    # Beside it, forks that join again, 300 in a row.
    forks = [e for i in range(300) for side in "xy" for e in ((f"f{i:03d}", f"{side}{i:03d}"), (f"{side}{i:03d}", f"f{i + 1:03d}"))]
    ring = [("r0", "r1"), ("r1", "r0"), ("r1", "behind")]
    edges = spark.createDataFrame([("p", *e) for e in chain + forks + ring], "plan_id string, source string, target string")
    nodes = [("p", n, 1) for n in {n for e in chain + forks + ring for n in e}]
    got = {r.node: r.level for r in graphs.topological_levels(spark.createDataFrame(nodes, "plan_id string, node string, weight int"), edges).collect()}
    expected = {n: i for i, n in enumerate(names)}
    expected |= {f"f{i:03d}": 2 * i for i in range(301)} | {f"{s}{i:03d}": 2 * i + 1 for i in range(300) for s in "xy"}
    assert got == expected
    assert len(rounds) < 60  # two stored tables a round


def test_lengths_on_a_ring_do_not_overflow(spark):
    """While the chain is settled, the lengths on the ring double each time."""
    names = [f"n{i:02d}" for i in range(40)]
    edges = spark.createDataFrame([("p", *e) for e in [*zip(names, names[1:]), ("r0", "r1"), ("r1", "r0")]],
                                  "plan_id string, source string, target string")
    nodes = spark.createDataFrame([("p", n, 1) for n in names] + [("p", "r0", 1 << 59), ("p", "r1", 1 << 59)],
                                  "plan_id string, node string, weight long")
    assert {r.node: r.level for r in graphs.topological_levels(nodes, edges).collect()} == {n: i for i, n in enumerate(names)}


def test_critical_paths_of_a_lattice_behind_a_cycle(spark):
    """Only the paths through the cycle are listed, those through the lattice are not."""
    layers = [(f"m{k}{a}", f"m{k + 1}{b}") for k in range(8) for a in "xy" for b in "xy"]
    ends = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("c", "m0x"), ("d", "m0x"), ("m8y", "z")]
    edges = spark.createDataFrame([("p", *e) for e in layers + ends], "plan_id string, source string, target string")
    got = [r.path for r in graphs.longest_paths(edges).orderBy("position").collect()]
    first = ["a", "b", "c", "d", *[f"m{k}x" for k in range(8)], "m8y", "z"]
    assert got == [first, [*first[:-3], "m7y", "m8y", "z"], [*first[:-4], "m6y", "m7x", "m8y", "z"]]
