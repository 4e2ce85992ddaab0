"""Queries of the graph operators on the link table."""

from __future__ import annotations

from pyspark.sql import functions as F

from weaveline.operators import graph as G
from weaveline.plans import corpus as C
from weaveline.plans.tables import table


def edges(spark, sf):
    links = G.materialize(C.links(spark, sf), "links")
    aliases = G.alias_map(links, C.docs(spark, sf).select("id"))
    return G.materialize(G.canonical_edges(links, aliases), "canonical-edges")


def adjacency(spark, sf):
    return G.materialize(G.undirected(edges(spark, sf)), "adjacency")


def _pairs(spark, sf):
    """Pairs to measure: ends of edges that an edge of the first document leads on to, a tenth by hash-free rule on ids' lengths."""
    related = C.links(spark, sf).filter("kind = 'related' or kind = 'citation'")
    return related.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).filter("source < target").distinct()


def g1_adjacency(spark, sf):
    return adjacency(spark, sf)


def g2_components(spark, sf):
    return G.connected_components(C.links(spark, sf), "source", "target")


def j7_alias_canonical(spark, sf):
    return G.alias_map(C.links(spark, sf), C.docs(spark, sf).select("id"))


def g4_bfs_distance(spark, sf):
    return G.pair_distances(adjacency(spark, sf), _pairs(spark, sf))


def g5_neighborhood(spark, sf):
    start = C.docs(spark, sf).select(F.min("id").alias("start"))
    return G.hops(adjacency(spark, sf), start, 2).select("start", "node", F.col("hops").cast("int").alias("hops"))


def g6_degrees(spark, sf):
    return G.degrees(adjacency(spark, sf))


def f11_common_neighbors(spark, sf):
    return G.common_neighbors(adjacency(spark, sf), _pairs(spark, sf))


def g8_tag_pages(spark, sf):
    """Pages of each top folder that is a declared category; folders nobody declared are left out."""
    declared = table(spark, sf, "documents").select(F.lower("category").alias("tag")).filter("tag is not null").distinct()
    tags = C.docs(spark, sf).select("id", F.explode(F.array_distinct(F.slice(F.split("id", "/"), 1, 2))).alias("tag")).filter("tag <> id")
    return tags.join(declared, "tag", "left_semi").groupBy("tag").agg(F.count("*").alias("n"))


def g9_ancestor_index(spark, sf):
    pages = C.docs(spark, sf).select(F.col("id").alias("page"))
    folders = pages.select(F.regexp_extract("page", "^([^/]+)/", 1).alias("f")).filter("f <> ''").groupBy("f").agg(F.count("*").alias("n")).filter("n >= 5")
    indexes = folders.select(F.concat("f", F.lit("/index")).alias("page")).union(spark.createDataFrame([("index",)], "page string"))
    return G.ancestor_index(pages, indexes)


def g10_stripped_links(spark, sf):
    return C.links(spark, sf).filter(~F.col("target").startswith("tags/")).groupBy("source").agg(F.count_distinct("target").alias("n_links"))


def g11_index_validation(spark, sf):
    """Ids on one side only: link sources without a document, documents without a link."""
    linked = C.links(spark, sf).select(F.col("source").alias("id")).distinct().withColumn("l", F.lit(1))
    have = C.docs(spark, sf).select("id").withColumn("d", F.lit(1))
    return linked.join(have, "id", "full").filter("l is null or d is null").select("id", F.when(F.col("l").isNull(), "no links").otherwise("no document").alias("problem"))


def g12_normalized_adjacency(spark, sf):
    return G.normalized_adjacency(adjacency(spark, sf)).select("a", "b", F.round("w", 9).alias("w"))


def g13_propagation(spark, sf):
    adj = adjacency(spark, sf)
    signal = G.degrees(adj).select("node", F.col("degree").cast("double").alias("x"))
    return G.propagate(G.normalized_adjacency(adj), signal).select("node", F.round("x", 6).alias("x"))


def g14_label_agreement(spark, sf):
    adj = adjacency(spark, sf)
    labels = adj.select(F.col("a").alias("node")).distinct().select("node", F.substring_index("node", "/", 1).alias("label"))
    return G.label_agreement(adj.filter("a < b"), labels).select("n_edges", "n_same", F.round("share", 9).alias("share"))


def g14_rewired_agreement(spark, sf):
    adj = adjacency(spark, sf)
    labels = adj.select(F.col("a").alias("node")).distinct().select("node", F.substring_index("node", "/", 1).alias("label"))
    return G.label_agreement(G.rewired(adj.filter("a < b")), labels)


def g15_adjacency_lists(spark, sf):
    """Adjacency lists written out as edges again."""
    lists = C.links(spark, sf).groupBy("source").agg(F.collect_set("target").alias("targets"))
    return lists.select("source", F.explode("targets").alias("target"))


def y1_source_statistics(spark, sf):
    r = table(spark, sf, "relationships")
    return r.filter(F.col("kind").contains("unresolved")).groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (g1_adjacency, g2_components, j7_alias_canonical, g4_bfs_distance, g5_neighborhood, g6_degrees, f11_common_neighbors, g8_tag_pages, g9_ancestor_index, g10_stripped_links,
                                   g11_index_validation, g12_normalized_adjacency, g13_propagation, g14_label_agreement, g14_rewired_agreement, g15_adjacency_lists, y1_source_statistics)}

_COMPONENTS = """
{name}_adj AS (SELECT source AS a, target AS b FROM links WHERE {where} UNION SELECT target, source FROM links WHERE {where}),
{name}(node, component) USING KEY (node) AS (
  SELECT a, a FROM {name}_adj
  UNION
  SELECT x.b, min(f.component) FROM {name} f JOIN {name}_adj x ON x.a = f.node JOIN recurring.{name} r ON r.node = x.b WHERE f.component < r.component GROUP BY x.b)"""
ALIAS = _COMPONENTS.format(name="cls", where="kind = 'alias'") + """,
alias_of AS (SELECT node, coalesce(min(CASE WHEN node IN (SELECT id FROM docs) THEN node END) OVER (PARTITION BY component), min(node) OVER (PARTITION BY component)) AS canonical FROM cls)"""
ADJ = ALIAS + """,
edges AS (SELECT coalesce(x.canonical, source) AS source, coalesce(y.canonical, target) AS target, kind FROM links LEFT JOIN alias_of x ON x.node = source LEFT JOIN alias_of y ON y.node = target WHERE kind <> 'alias'),
adj AS MATERIALIZED (SELECT source AS a, target AS b FROM edges WHERE source <> target UNION SELECT target, source FROM edges WHERE source <> target)"""


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n"


_ADJ = recursive(C.DOCS, C.LINKS, ADJ)
_PAIRS_SQL = "pairs AS (SELECT DISTINCT least(source, target) AS source, greatest(source, target) AS target FROM links WHERE kind IN ('related', 'citation') AND source <> target)"
_W = """deg AS (SELECT a, count(*) + 1 AS d FROM adj GROUP BY a),
w AS (SELECT x.a, x.b, 1 / sqrt(p.d * q.d) AS w FROM (SELECT a, b FROM adj UNION ALL SELECT a, a FROM deg) x JOIN deg p ON p.a = x.a JOIN deg q ON q.a = x.b)"""
_AND = lambda base, *ctes: base.rstrip() + ",\n" + ",\n".join(ctes) + "\n"

ORACLE = {
    "g1_adjacency": _ADJ + "SELECT a, b FROM adj",
    "g2_components": recursive(C.LINKS, _COMPONENTS.format(name="cc", where="true")) + "SELECT node, component FROM cc",
    "j7_alias_canonical": recursive(C.DOCS, C.LINKS, ALIAS) + "SELECT node, canonical FROM alias_of",
    "g4_bfs_distance": _AND(_ADJ, _PAIRS_SQL, """walk(start, node, hops) AS (
  SELECT DISTINCT source, source, 0 FROM pairs UNION SELECT start, b, hops + 1 FROM walk JOIN adj ON a = node WHERE hops < 5)""") + """
SELECT p.source, p.target, coalesce(min(hops)::DOUBLE, 6.0) AS graph_distance FROM pairs p LEFT JOIN walk w ON w.start = p.source AND w.node = p.target GROUP BY ALL""",
    "g5_neighborhood": _AND(_ADJ, """walk(start, node, hops) AS (
  SELECT min(id), min(id), 0 FROM docs UNION SELECT start, b, hops + 1 FROM walk JOIN adj ON a = node WHERE hops < 2)""") + "SELECT start, node, min(hops) AS hops FROM walk GROUP BY ALL",
    "g6_degrees": _ADJ + "SELECT a AS node, count(*) AS degree FROM adj GROUP BY a",
    "f11_common_neighbors": _AND(_ADJ, _PAIRS_SQL) + "SELECT p.source, p.target, (SELECT count(*) FROM adj x JOIN adj y ON x.b = y.b WHERE x.a = p.source AND y.a = p.target) AS n FROM pairs p",
    "g8_tag_pages": recursive(C.DOCS) + """, tags AS (SELECT DISTINCT id, unnest(list_distinct(string_split(id, '/')[1:2])) AS tag FROM docs)
SELECT tag, count(*) AS n FROM tags WHERE tag <> id AND tag IN (SELECT lower(category) FROM documents) GROUP BY tag""",
    "g9_ancestor_index": recursive(C.DOCS) + """, big AS (SELECT regexp_extract(id, '^([^/]+)/', 1) AS f FROM docs GROUP BY 1 HAVING f <> '' AND count(*) >= 5)
SELECT id AS page, CASE WHEN regexp_extract(id, '^([^/]+)/', 1) IN (SELECT f FROM big) AND id <> regexp_extract(id, '^([^/]+)/', 1) || '/index' THEN regexp_extract(id, '^([^/]+)/', 1) || '/index' ELSE 'index' END AS index_page FROM docs WHERE id <> 'index'""",
    "g10_stripped_links": recursive(C.LINKS) + "SELECT source, count(DISTINCT target) AS n_links FROM links WHERE NOT starts_with(target, 'tags/') GROUP BY source",
    "g11_index_validation": recursive(C.DOCS, C.LINKS) + """SELECT coalesce(l.id, d.id) AS id, CASE WHEN l.id IS NULL THEN 'no links' ELSE 'no document' END AS problem
FROM (SELECT DISTINCT source AS id FROM links) l FULL JOIN docs d ON l.id = d.id WHERE l.id IS NULL OR d.id IS NULL""",
    "g12_normalized_adjacency": _AND(_ADJ, _W) + "SELECT a, b, round(w, 9) AS w FROM w",
    "g13_propagation": _AND(_ADJ, _W) + "SELECT w.a AS node, round(sum(w * (d - 1)), 6) AS x FROM w JOIN deg ON deg.a = w.b GROUP BY w.a",
    "g14_label_agreement": _ADJ + "SELECT count(*) AS n_edges, sum((split_part(a, '/', 1) = split_part(b, '/', 1))::BIGINT)::BIGINT AS n_same, round(avg((split_part(a, '/', 1) = split_part(b, '/', 1))::DOUBLE), 9) AS share FROM adj WHERE a < b",
    "g15_adjacency_lists": recursive(C.LINKS) + "SELECT DISTINCT source, target FROM links",
    "y1_source_statistics": "SELECT kind, count(*) AS n FROM relationships WHERE contains(kind, 'unresolved') GROUP BY kind",
}
