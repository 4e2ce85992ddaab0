"""Queries of the pair pipeline: neighbours of the corpus's units, pairs, features, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from weaveline.functions import text as X
from weaveline.functions import vectors as V
from weaveline.operators import knn as K
from weaveline.operators import pairs as P
from weaveline.operators import ranking as R
from weaveline.plans import corpus as C
from weaveline.plans import graphs
from weaveline.plans.tables import table
from weaveline.scratch import materialize, spread

NEIGHBORS, PER_DOCUMENT, VERSION = 10, 20, "weighted-1"
KINDS = ["explicit-link"]
FEATURES = ["document_similarity", "title_similarity", "best_chunk_similarity", "top_r_mean_similarity", "csls_best_chunk_similarity", "forward", "backward", "support_breadth", "lexical_similarity", "graph_distance",
            "common_neighbor_count", "hubness_source", "hubness_target", "source_chunk_count", "target_chunk_count", "source_token_count", "target_token_count", "csls_similarity", "near_duplicate_probability"]


def doc_tokens(spark, sf):
    """Token sets of the documents' chunks."""
    c = spread(table(spark, sf, "search_chunks").filter("file_path is not null and text is not null").select("chunk_id", "file_path", "text"), "chunk_id")
    return c.select(F.regexp_replace("file_path", r"\.md$", "").alias("doc"), F.explode(X.lexical_tokens(F.col("text"))).alias("t")).groupBy("doc").agg(F.collect_set("t").alias("tokens"))


class Stage:
    """Steps of the pipeline up to the bounded pairs, each written once."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        self.units = materialize(C.units(spark, sf), "units")
        self.neighbors = materialize(K.top_k(self.units, "unit", "v", NEIGHBORS, "view"), "neighbors")
        self.density = materialize(K.local_density(self.neighbors), "density")

    def matches(self):
        return P.unblocked(P.unit_matches(self.neighbors, self.units), C.links(self.spark, self.sf), KINDS)

    def bounded(self):
        self.kept = P.kept_matches(materialize(self.matches(), "matches"))
        return materialize(P.bounded_pairs(self.kept, PER_DOCUMENT), "pairs")

    def features(self):
        pairs = self.bounded()
        kept = self.kept.join(pairs.select("source", "target"), ["source", "target"], "left_semi")
        return materialize(P.pair_features(pairs, kept, self.units, self.density, doc_tokens(self.spark, self.sf), graphs.adjacency(self.spark, self.sf)), "features")

    def scored(self):
        f = self.features()
        section = self.kept.groupBy("source", "target").agg(F.max(F.col("view") == "section").alias("has_section"))
        present = C.docs(self.spark, self.sf).filter(F.length(X.collapse_space(F.col("content"))) > 0).select(F.col("id").alias("doc"))
        s = R.scored(f, present=present).join(section, ["source", "target"])
        return s.withColumn("direction", R.direction(F.col("forward"), F.col("backward"), F.col("has_section")))


def j5_knn_by_view(spark, sf):
    return K.exact_top_k(materialize(C.units(spark, sf), "units"), "unit", "v", NEIGHBORS, "view").select(F.col("part").alias("view"), "unit", "neighbor", "sim", "rank")


def j1_knn_exact(spark, sf):
    return K.exact_top_k(table(spark, sf, "embeddings"), "vec_id", "embedding", 10).select("unit", "neighbor", "sim", "rank")


def j2_knn_query(spark, sf):
    e = table(spark, sf, "embeddings")
    return K.exact_top_k(e, "vec_id", "embedding", 5, queries=e.filter("vec_id % 20 = 0")).select("unit", "neighbor", "sim", "rank")


def j3_knn_approximate(spark, sf):
    return K.approximate_top_k(table(spark, sf, "embeddings"), "vec_id", "embedding", 10).select("unit", "neighbor", "sim", "rank")


def j9_search(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    return K.search(e, "vec_id", "embedding", list(q), 10)


def x21_item_similarity(spark, sf):
    return j9_search(spark, sf).withColumn("rank", F.row_number().over(K.Window.orderBy(F.desc("sim"), "vec_id")))


def e3_normalized(spark, sf):
    e = table(spark, sf, "chunk_vectors").filter("embedding is not null and size(embedding) > 0")
    return V.usable(e, "embedding", 96).select("id", F.posexplode(V.normalize(F.col("embedding"))).alias("i", "x")).select("id", "i", F.round("x", 9).alias("x"))


def e8_cosine(spark, sf):
    e = V.usable(table(spark, sf, "chunk_vectors"), "embedding", 96).select("chunk_id", "id", "embedding")
    return e.alias("a").join(e.alias("b"), "chunk_id").filter("a.id < b.id").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.round(V.cosine(F.col("a.embedding"), F.col("b.embedding")), 9).alias("cosine"))


def e1_hash_embed(spark, sf):
    return table(spark, sf, "search_chunks").filter("text is not null").select("chunk_id", V.hash_embedder(64)(F.col("text")).alias("v"))


def y9_document_vectors(spark, sf):
    u = C.units(spark, sf).filter("view = 'document'")
    best = u.groupBy("doc").agg(F.min("unit").alias("unit"), F.min_by("v", "unit").alias("v"))
    return best.select("doc", "unit", F.posexplode("v").alias("i", "x")).select("doc", "unit", "i", F.round("x", 9).alias("x"))


def f3_local_density(spark, sf):
    return K.local_density(j5_knn_by_view(spark, sf)).select("unit", F.round("density", 12).alias("density"))


def f4_hubness(spark, sf):
    s = Stage(spark, sf)
    return P.hubness(s.units, s.density).select("doc", F.round("hubness", 12).alias("hubness"))


def f12_csls(spark, sf):
    s = Stage(spark, sf)
    return K.csls(s.neighbors, s.density).select("unit", "neighbor", F.round("csls", 12).alias("csls"))


def f15_consistency(spark, sf):
    e = table(spark, sf, "chunk_vectors").select(F.col("chunk_id").alias("unit"), "id")
    return P.missing_units(e, table(spark, sf, "search_chunks").select(F.col("chunk_id").alias("unit"))).select("id")


def j6_unit_matches(spark, sf):
    s = Stage(spark, sf)
    return P.unit_matches(s.neighbors, s.units)


def j8_unblocked(spark, sf):
    return Stage(spark, sf).matches()


def f1_kept_matches(spark, sf):
    s = Stage(spark, sf)
    return P.kept_matches(s.matches()).drop("sim")


def f2_bounded_pairs(spark, sf):
    return Stage(spark, sf).bounded().select("source", "target", "best")


def f5_pair_features(spark, sf):
    return Stage(spark, sf).features().select("source", "target", *[F.round(F.col(c).cast("double"), 12).alias(c) for c in FEATURES])


def missing_links(spark, sf):
    """Flagship: ranked document pairs that lack a link."""
    s = Stage(spark, sf).scored()
    id_ = R.proposal_id(F.col("source"), F.col("target"), F.col("direction"), VERSION)
    keep = ["score", "relatedness", "usefulness", "missingness", "quality"]
    return s.select(id_.alias("id"), "source", "target", "direction", *[F.round(c, 12).alias(c) for c in keep])


def proposals(spark, sf):
    """Scored, diversified and ranked proposals."""
    s = materialize(missing_links(spark, sf), "scored")
    ordered = R.diverse_order(s, doc_tokens(spark, sf))
    return materialize(R.total_order(ordered).join(s.drop("score"), ["source", "target"]), "proposals")


def a11_mmr_order(spark, sf):
    return proposals(spark, sf).select("id", "source", "target", "score", "position", "rank")


def decisions(proposals):
    """Reviews derived from the ids: each proposal decided up to twice."""
    h = F.pmod(F.conv(F.substring("id", 8, 6), 16, 10).cast("long"), F.lit(10))
    kind = F.when(h < 5, "accept").when(h < 8, "reject").otherwise("defer")
    first = proposals.select("id", F.lit(1).alias("seq"), F.lit("reject").alias("decision"), F.lit("too_generic").alias("reason")).filter(F.pmod(F.length("source"), F.lit(3)) == 0)
    return first.unionByName(proposals.select("id", F.lit(2).alias("seq"), kind.alias("decision"), F.lit(None).cast("string").alias("reason")).filter(F.pmod(F.length("target"), F.lit(2)) == 0))


def a13_confidence(spark, sf):
    s = materialize(missing_links(spark, sf), "scored")
    d = R.latest_decisions(decisions(s)).filter("decision in ('accept', 'reject')").join(s, "id").select("id", "quality", (F.col("decision") == "accept").alias("accepted"))
    return R.banded(s, R.band_thresholds(d)).select("id", "confidence")


def a14_latest_decisions(spark, sf):
    return R.latest_decisions(decisions(missing_links(spark, sf)))


def a15_with_reviews(spark, sf):
    s = materialize(missing_links(spark, sf), "scored")
    return R.with_reviews(s, decisions(s)).select("id", "review_status", "review_reason")


def a10_evidence(spark, sf):
    s = Stage(spark, sf)
    pairs = s.bounded()
    c = table(spark, sf, "search_chunks").select("chunk_id", F.array(F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end"))).alias("spans"))
    spans = s.units.join(c, "chunk_id").select("unit", "spans")
    e = R.evidence(s.kept.join(pairs, ["source", "target"], "left_semi"), spans)
    e = e.select("source", "target", F.explode("evidence").alias("e"))
    return e.select("source", "target", "e.place", "e.src_unit", "e.tgt_unit", "e.sim", *[F.col(f"e.{c}_spans")[0][x].alias(f"{c}_{x}") for c in ("src", "tgt") for x in ("start", "end")])


def a16_review_queue(spark, sf):
    return R.review_queue(proposals(spark, sf), 50).select("id", "rank", "stratum")


QUERIES = {f.__name__: f for f in (j1_knn_exact, j2_knn_query, j3_knn_approximate, j5_knn_by_view, j9_search, x21_item_similarity, e1_hash_embed, e3_normalized, e8_cosine, y9_document_vectors, f3_local_density, f4_hubness, f12_csls,
                                   f15_consistency, j6_unit_matches, j8_unblocked, f1_kept_matches, f2_bounded_pairs, f5_pair_features, missing_links, a10_evidence, a11_mmr_order, a13_confidence, a14_latest_decisions, a15_with_reviews, a16_review_queue)}

_KNN = """SELECT * FROM (SELECT a.vec_id AS unit, b.vec_id AS neighbor, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON {on}) WHERE rank <= {k}"""
NN = f"""
nn AS MATERIALIZED (SELECT * FROM (SELECT a.view, a.unit, b.unit AS neighbor, round(list_dot_product(a.v, b.v), 9) AS sim,
  row_number() OVER (PARTITION BY a.view, a.unit ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.unit) AS rank
  FROM units a JOIN units b ON a.view = b.view AND a.unit <> b.unit) WHERE rank <= {NEIGHBORS}),
density AS MATERIALIZED (SELECT unit, avg(sim) AS density FROM nn WHERE rank <= 10 GROUP BY unit)"""
HUB = """
hub AS (SELECT d.doc, coalesce(h, 0) AS hubness FROM (SELECT DISTINCT doc FROM units) d LEFT JOIN (SELECT doc, avg(density) AS h FROM units JOIN density USING (unit) WHERE view = 'document' GROUP BY doc) USING (doc))"""
MATCHES = """
matches AS MATERIALIZED (
  SELECT least(x.doc, y.doc) AS source, greatest(x.doc, y.doc) AS target, CASE WHEN x.doc > y.doc THEN neighbor ELSE nn.unit END AS src_unit, CASE WHEN x.doc > y.doc THEN nn.unit ELSE neighbor END AS tgt_unit, nn.view, max(sim) AS sim
  FROM nn JOIN units x ON x.unit = nn.unit JOIN units y ON y.unit = nn.neighbor WHERE x.doc <> y.doc GROUP BY ALL),
free AS MATERIALIZED (SELECT * FROM matches m WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.kind IN ('explicit-link', 'exclusion') AND least(l.source, l.target) = m.source AND greatest(l.source, l.target) = m.target)),
kept AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY sim DESC, src_unit, tgt_unit, view) AS place FROM free) WHERE place <= 8),
best AS (SELECT source, target, max(sim) AS best FROM kept GROUP BY ALL),
ends AS (SELECT source, target, best, row_number() OVER (PARTITION BY doc ORDER BY best DESC, source, target) AS r FROM (SELECT *, source AS doc FROM best UNION ALL SELECT *, target FROM best)),
bounded AS MATERIALIZED (SELECT source, target, best FROM ends WHERE r <= 20 GROUP BY ALL HAVING count(*) = 2)"""
_CL = lambda x: f"least(greatest({x}, 0.0), 1.0)"
FEATS = f"""
u2 AS MATERIALIZED (SELECT u.*, coalesce(density, 0) AS density FROM units u LEFT JOIN density USING (unit)),
cells AS MATERIALIZED (SELECT p.source, p.target, a.unit AS ua, b.unit AS ub, a.view AS va, b.view AS vb, a.density AS da, b.density AS db, round(list_dot_product(a.v, b.v), 9) AS sim
  FROM bounded p JOIN u2 a ON a.doc = p.source JOIN u2 b ON b.doc = p.target WHERE a.view = b.view OR (a.view = 'section' AND b.view = 'document') OR (a.view = 'document' AND b.view = 'section')),
peaks AS (SELECT source, target, max(CASE WHEN va = 'document' AND vb = 'document' THEN sim END) AS dd, max(CASE WHEN va = 'title' AND vb = 'title' THEN sim END) AS tt,
  max(CASE WHEN va = 'section' AND vb = 'document' THEN sim END) AS fw, max(CASE WHEN va = 'document' AND vb = 'section' THEN sim END) AS bw FROM cells GROUP BY ALL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY sim DESC, ua, ub) AS r FROM cells WHERE va = 'section' AND vb = 'section'),
secs AS (SELECT source, target, max(sim) AS best, avg(sim) AS top, max(CASE WHEN r = 1 THEN 2 * sim - da - db END) AS cb FROM firsts WHERE r <= 3 GROUP BY ALL),
breadth AS (SELECT source, target, least(1.0, (count(DISTINCT CASE WHEN view = 'section' THEN src_unit END) + count(DISTINCT CASE WHEN view = 'section' THEN tgt_unit END)) / 6) AS sb FROM kept GROUP BY ALL),
toks AS MATERIALIZED (SELECT doc, list(DISTINCT t) AS ts FROM (SELECT regexp_replace(file_path, '\\.md$', '') AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS t FROM search_chunks WHERE file_path IS NOT NULL AND text IS NOT NULL) GROUP BY doc),
lex AS (SELECT p.source, p.target, coalesce(len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts))), 0) AS ls FROM bounded p LEFT JOIN toks a ON a.doc = p.source LEFT JOIN toks b ON b.doc = p.target),
walk(start, node, hops) AS (SELECT DISTINCT source, source, 0 FROM bounded UNION SELECT start, b, hops + 1 FROM walk JOIN adj ON a = node WHERE hops < 5),
dist AS (SELECT p.source, p.target, coalesce(min(hops)::DOUBLE, 6.0) AS gd FROM bounded p LEFT JOIN walk w ON w.start = p.source AND w.node = p.target GROUP BY ALL),
common AS (SELECT p.source, p.target, count(*) AS cn FROM bounded p JOIN adj x ON x.a = p.source JOIN adj y ON y.a = p.target AND x.b = y.b GROUP BY ALL),
sizes AS (SELECT doc, coalesce(max(CASE WHEN view = 'section' THEN n END), max(CASE WHEN view = 'document' THEN n END), sum(n))::DOUBLE AS n, coalesce(max(CASE WHEN view = 'section' THEN t END), max(CASE WHEN view = 'document' THEN t END), sum(t))::DOUBLE AS t
  FROM (SELECT doc, view, count(*) AS n, sum(tokens) AS t FROM units GROUP BY ALL) GROUP BY doc),
base AS (SELECT p.source, p.target, coalesce(dd, 0) AS document_similarity, coalesce(tt, 0) AS title_similarity, coalesce(s.best, 0) AS best_chunk_similarity, coalesce(top, 0) AS top_r_mean_similarity, coalesce(cb, 0) AS csls_best_chunk_similarity,
  coalesce(fw, 0) AS forward, coalesce(bw, 0) AS backward, coalesce(sb, 0) AS support_breadth, ls AS lexical_similarity, gd AS graph_distance, coalesce(cn, 0) AS common_neighbor_count, hs.hubness AS hubness_source, ht.hubness AS hubness_target,
  zs.n AS source_chunk_count, zt.n AS target_chunk_count, zs.t AS source_token_count, zt.t AS target_token_count
  FROM bounded p LEFT JOIN peaks USING (source, target) LEFT JOIN secs s USING (source, target) LEFT JOIN breadth USING (source, target) JOIN lex USING (source, target) JOIN dist USING (source, target) LEFT JOIN common USING (source, target)
  JOIN hub hs ON hs.doc = p.source JOIN hub ht ON ht.doc = p.target JOIN sizes zs ON zs.doc = p.source JOIN sizes zt ON zt.doc = p.target),
feats AS MATERIALIZED (SELECT *, 2 * document_similarity - hubness_source - hubness_target AS csls_similarity,
  {_CL('(document_similarity - 0.95) / 0.05')} * (0.6 + 0.25 * {_CL('(lexical_similarity - 0.5) / 0.5')} + 0.15 * {_CL("(CASE WHEN greatest(source_token_count, target_token_count) > 0 THEN least(source_token_count, target_token_count) / greatest(source_token_count, target_token_count) ELSE 0 END - 0.5) / 0.5")}) AS near_duplicate_probability FROM base)"""
SCORED = f"""
norms AS (SELECT *, {_CL('(csls_similarity + 1) / 2')} AS cs, {_CL('best_chunk_similarity')} AS bc, {_CL('document_similarity')} AS ds, {_CL('top_r_mean_similarity')} AS tr, {_CL('support_breadth')} AS sbn, {_CL('lexical_similarity / 0.5')} AS lx,
  {_CL('near_duplicate_probability')} AS dup, {_CL('(hubness_source + hubness_target) / 2')} AS hub, CASE WHEN graph_distance <= 1 THEN 1.0 WHEN graph_distance <= 2 THEN 0.7 WHEN graph_distance <= 3 THEN 0.3 WHEN graph_distance <= 4 THEN 0.1 ELSE 0 END AS red
  FROM feats WHERE near_duplicate_probability <= 0.98 AND source IN (SELECT id FROM docs WHERE trim(content) <> '') AND target IN (SELECT id FROM docs WHERE trim(content) <> '')),
bridged AS (SELECT *, cs * CASE WHEN graph_distance <= 2 THEN 0 WHEN graph_distance <= 3 THEN 0.5 WHEN graph_distance <= 4 THEN 0.8 ELSE 1 END AS br FROM norms),
final AS (SELECT source, target, {_CL('0.35 * cs + 0.30 * bc + 0.15 * sbn + 0.10 * lx + 0.10 * br - 0.10 * hub - 0.20 * dup - 0.10 * red')} AS score, {_CL('0.4 * ds + 0.4 * bc + 0.2 * tr')} AS relatedness,
  {_CL('0.5 + 0.25 * sbn + 0.25 * br - 0.25 * hub - 0.5 * dup')} AS usefulness, least(greatest(0.3 + 0.175 * (graph_distance - 2), 0.1), 1.0) AS missingness,
  CASE WHEN NOT EXISTS (SELECT 1 FROM kept k WHERE k.source = b.source AND k.target = b.target AND k.view = 'section') THEN 'undirected' WHEN forward - backward > 0.02 THEN 'source-to-target' WHEN backward - forward > 0.02 THEN 'target-to-source' ELSE 'undirected' END AS direction FROM bridged b),
props AS MATERIALIZED (SELECT 'sha256:' || sha256('["' || source || '","' || target || '","' || direction || '","{VERSION}"]') AS id, source, target, direction, round(score, 12) AS score, round(relatedness, 12) AS relatedness, round(usefulness, 12) AS usefulness,
  round(missingness, 12) AS missingness, round(relatedness * usefulness, 12) AS quality FROM final)"""
DECISIONS = """
reviews AS (SELECT id, 1 AS seq, 'reject' AS decision, 'too_generic' AS reason FROM props WHERE length(source) % 3 = 0
  UNION ALL SELECT id, 2, CASE WHEN h < 5 THEN 'accept' WHEN h < 8 THEN 'reject' ELSE 'defer' END, NULL FROM (SELECT id, target, ('0x' || substr(id, 8, 6))::BIGINT % 10 AS h FROM props) WHERE length(target) % 2 = 0),
latest AS (SELECT id, decision, reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM reviews) WHERE r = 1)"""

_UNITS = graphs.recursive(C.UNITS)
_NN = graphs.recursive(C.UNITS, NN)
_MATCH = graphs.recursive(C.LINKS, C.UNITS, NN, MATCHES)
_FEATS = graphs.recursive(C.DOCS, C.LINKS, graphs.ADJ, C.UNITS, NN, HUB, MATCHES, FEATS)
_PROPS = graphs.recursive(C.DOCS, C.LINKS, graphs.ADJ, C.UNITS, NN, HUB, MATCHES, FEATS, SCORED)
_REVIEWED = graphs.recursive(C.DOCS, C.LINKS, graphs.ADJ, C.UNITS, NN, HUB, MATCHES, FEATS, SCORED, DECISIONS)
_FINITE = "len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

ORACLE = {
    "a10_evidence": _MATCH.rstrip() + """, sp AS (SELECT unit, start_char AS s, end_char AS e FROM units JOIN search_chunks USING (chunk_id))
SELECT k.source, k.target, place, src_unit, tgt_unit, sim, a.s AS src_start, a.e AS src_end, b.s AS tgt_start, b.e AS tgt_end FROM kept k JOIN bounded USING (source, target) LEFT JOIN sp a ON a.unit = src_unit LEFT JOIN sp b ON b.unit = tgt_unit WHERE place <= 3""",
    "j1_knn_exact": _KNN.format(on="a.vec_id <> b.vec_id", k=10),
    "j2_knn_query": _KNN.format(on="a.vec_id % 20 = 0", k=5),
    "j9_search": "SELECT b.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) ORDER BY sim DESC, vec_id LIMIT 10",
    "x21_item_similarity": "SELECT b.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim, row_number() OVER (ORDER BY round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) ORDER BY sim DESC, vec_id LIMIT 10",
    "j5_knn_by_view": _NN + "SELECT view, unit, neighbor, sim, rank FROM nn",
    "e3_normalized": f"WITH e AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM chunk_vectors WHERE {_FINITE}) SELECT id, unnest(range(96))::INT AS i, unnest(list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 9))) AS x FROM e",
    "e8_cosine": f"WITH e AS (SELECT id, chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM chunk_vectors WHERE {_FINITE}) SELECT a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM e a JOIN e b USING (chunk_id) WHERE a.id < b.id",
    "y9_document_vectors": _UNITS + "SELECT doc, unit, unnest(range(96))::INT AS i, unnest(list_transform(v, lambda x: round(x, 9))) AS x FROM (SELECT doc, min(unit) AS unit, arg_min(v, unit) AS v FROM units WHERE view = 'document' GROUP BY doc)",
    "f3_local_density": _NN + "SELECT unit, round(density, 12) AS density FROM density",
    "f4_hubness": graphs.recursive(C.UNITS, NN, HUB) + "SELECT doc, round(hubness, 12) AS hubness FROM hub",
    "f12_csls": _NN + "SELECT nn.unit, neighbor, round(2 * sim - coalesce(a.density, 0) - coalesce(b.density, 0), 12) AS csls FROM nn LEFT JOIN density a ON a.unit = nn.unit LEFT JOIN density b ON b.unit = neighbor",
    "f15_consistency": "SELECT id FROM chunk_vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM search_chunks)",
    "j6_unit_matches": _MATCH + "SELECT * FROM matches",
    "j8_unblocked": _MATCH + "SELECT * FROM free",
    "f1_kept_matches": _MATCH + "SELECT source, target, src_unit, tgt_unit, view, place FROM kept",
    "f2_bounded_pairs": _MATCH + "SELECT source, target, best FROM bounded",
    "f5_pair_features": _FEATS + "SELECT source, target, " + ", ".join(f"round({c}::DOUBLE, 12) AS {c}" for c in FEATURES) + " FROM feats",
    "missing_links": _PROPS + "SELECT * FROM props",
    "a13_confidence": _REVIEWED.rstrip() + """,
d AS (SELECT id, quality, (decision = 'accept')::DOUBLE AS ok, ntile(10) OVER (ORDER BY quality DESC, id) AS decile FROM latest JOIN props USING (id) WHERE decision IN ('accept', 'reject')),
rates AS (SELECT decile, avg(ok) AS rate, min(quality) AS low FROM d GROUP BY decile),
runs AS (SELECT low, min((rate >= 2 / 3)::INT) OVER (ORDER BY decile) AS h, min((rate >= 1 / 3)::INT) OVER (ORDER BY decile) AS m FROM rates),
cuts AS (SELECT CASE WHEN (SELECT count(*) FROM d) < 20 THEN 0.45 ELSE min(CASE WHEN h = 1 THEN low END) END AS high, CASE WHEN (SELECT count(*) FROM d) < 20 THEN 0.25 ELSE min(CASE WHEN m = 1 THEN low END) END AS medium FROM runs)
SELECT id, CASE WHEN quality >= high THEN 'high' WHEN quality >= medium THEN 'medium' ELSE 'low' END AS confidence FROM props, cuts""",
    "a14_latest_decisions": _REVIEWED + "SELECT id, decision, reason FROM latest",
    "a15_with_reviews": _REVIEWED + "SELECT id, coalesce(decision, 'unreviewed') AS review_status, reason AS review_reason FROM props LEFT JOIN latest USING (id)",
}
