import random

from weaveline.operators import graph as G


def _edges(spark, rows, names="a string, b string"):
    return spark.createDataFrame(rows, names)


def test_components_of_paths_stars_and_loops(spark):
    rows = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)] + [("l", "l"), ("x", None)]
    random.Random(0).shuffle(rows)
    got = {r["node"]: r["component"] for r in G.connected_components(_edges(spark, rows)).collect()}
    assert all(got[f"p{i:03}"] == "p000" for i in range(61)) and all(got[f"s{i}"] == "hub" for i in range(50)) and got["l"] == "l" and "x" not in got


def test_random_components(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)]
    parent = list(range(301))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in G.connected_components(_edges(spark, rows, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for r in rows for x in r}}


def test_alias_class_takes_its_smallest_present_member(spark):
    links = spark.createDataFrame([("a", "b", "alias"), ("b", "c", "alias"), ("x", "y", "alias"), ("q", "b", "explicit-link")], "source string, target string, kind string")
    aliases = G.alias_map(links, spark.createDataFrame([("b",), ("c",)], "id string"))
    assert {r["node"]: r["canonical"] for r in aliases.collect()} == {"a": "b", "b": "b", "c": "b", "x": "x", "y": "x"}
    assert [tuple(r) for r in G.canonical_edges(links, aliases).select("source", "target").collect()] == [("q", "b")]


def test_distances_equal_breadth_first_search_also_with_hubs(spark):
    rng = random.Random(2)
    rows = {(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(70)} | {(0, i) for i in range(1, 40)}
    adj = {}
    for a, b in rows:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)

    def bfs(s, t):
        seen, edge, d = {s}, {s}, 0
        while edge and d <= 5:
            if t in edge:
                return float(d)
            edge = {y for x in edge for y in adj.get(x, ())} - seen
            seen |= edge
            d += 1
        return 6.0

    pairs = [(rng.randint(0, 85), rng.randint(0, 85)) for _ in range(150)] + [(0, 41), (3, 3)]
    adjacency = G.undirected(_edges(spark, list(rows), "source long, target long"))
    for share in (4, 1000):
        got = {(r["source"], r["target"]): r["graph_distance"] for r in G.pair_distances(adjacency, _edges(spark, pairs, "source long, target long"), hub_share=share).collect()}
        assert got == {p: bfs(*p) for p in pairs}
    near = {(r["node"]): r["hops"] for r in G.hops(adjacency, _edges(spark, [(0,)], "start long"), 2).collect()}
    assert near == {n: int(bfs(0, n)) for n in range(86) if bfs(0, n) <= 2}


def test_empty_graph(spark):
    none = _edges(spark, [], "source string, target string")
    adjacency = G.undirected(none)
    assert adjacency.count() == 0 and G.connected_components(none, "source", "target").count() == 0
    assert [r["graph_distance"] for r in G.pair_distances(adjacency, _edges(spark, [("a", "b"), ("a", "a")], "source string, target string")).orderBy("target").collect()] == [0.0, 6.0]
    assert G.common_neighbors(adjacency, _edges(spark, [("a", "b")], "source string, target string")).first()["n"] == 0


def test_propagation_and_rewiring(spark):
    adj = G.undirected(_edges(spark, [("a", "b"), ("b", "c")], "source string, target string"))
    w = {(r["a"], r["b"]): r["w"] for r in G.normalized_adjacency(adj).collect()}
    assert abs(w["a", "b"] - 1 / 6**0.5) < 1e-12 and abs(w["b", "b"] - 1 / 3) < 1e-12
    e = _edges(spark, [(f"a{i}", f"b{i}") for i in range(500)])
    r = G.rewired(e).collect()
    assert len(r) == 500 and {x["a"] for x in r} == {f"a{i}" for i in range(500)} and {x["b"] for x in r} == {f"b{i}" for i in range(500)}


def test_components_both_ways(spark):
    import random

    rng = random.Random(7)
    edges = [(f"n{rng.randint(0, 120)}", f"n{rng.randint(0, 120)}") for _ in range(70)] + [("loop", "loop"), ("z", None)] + [(f"p{i}", f"p{i + 1}") for i in range(40)]
    df = spark.createDataFrame(edges, "a string, b string")
    one, many = ({tuple(r) for r in G.connected_components(df, held=h).collect()} for h in (200_000, 0))
    assert one == many and ("loop", "loop") in one and ("p40", "p0") in one
    assert G.connected_components(df.limit(0)).count() == 0
