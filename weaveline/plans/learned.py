"""Queries of learned heads, joins of notebooks, caches and queues."""

from __future__ import annotations

from functools import cached_property

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from weaveline.functions import text as X
from weaveline.functions import vectors as V
from weaveline.operators import anchors as N
from weaveline.operators import audit as A
from weaveline.operators import encoders as EN
from weaveline.operators import evaluate as E
from weaveline.operators import graph as G
from weaveline.operators import heads as H
from weaveline.operators import knn as K
from weaveline.operators import learned as L
from weaveline.operators import regions as R
from weaveline.operators import simulate as Q
from weaveline.operators import spans as S
from weaveline.operators.references import clean_reference
from weaveline.plans import corpus as C
from weaveline.plans import evaluation as EV
from weaveline.plans import graphs, inline
from weaveline.plans.tables import table
from weaveline.scratch import materialize
from weaveline.streaming import incremental as W

#: Folder of public vocabularies.
VOCABULARIES = "/opt/tokenizers"
FEATURES = ["keyphraseness", "commonness_top", "anchor_count", "target_count", "word_count", "char_count", "is_title_match", "is_alias_match", "sentence_position", "region_prose", "shape_title", "shape_acronym", "shape_hyphen"]


def i22_training_rows(spark, sf):
    """Audited items and other links as training rows: label and weight."""
    tiers = A.consensus_tier(EV._votes(spark, sf).filter("field = 'tier'")).select(F.col("item").alias("span_id"), "tier")
    items = table(spark, sf, "audit_items").select(F.col("id").alias("span_id"), F.lit(None).cast("double").alias("best_target"))
    rest = table(spark, sf, "relationships").filter("anchor_text is not null").select(F.col("rel_id").cast("string").alias("span_id"), (F.pmod("rel_id", F.lit(10)) / 10.0).alias("best_target"))
    return L.training_rows(items.unionByName(rest), tiers).select("span_id", "label", "weight")


def j17_hard_negatives(spark, sf):
    u = C.units(spark, sf)
    sections = u.filter("view = 'section'").select(F.col("unit").alias("query"), "doc", "v")
    targets = u.filter("view = 'document'").select(F.col("unit").alias("target"), "doc", "v")
    positives = sections.select("query", "doc").join(targets.select("target", "doc"), "doc").select("query", "target")
    return L.hard_negatives(sections.select("query", "v"), targets.select("target", "v"), positives, 3).select("query", "target", "sim", "rank")


def y11_best_target_cosine(spark, sf):
    u = C.units(spark, sf)
    near = K.exact_top_k(u.filter("view = 'document'"), "unit", "v", 1, queries=u.filter("view = 'section'").select("unit", "v"))
    return near.select("unit", F.col("sim").alias("best"))


def _audited(spark, sf):
    """The thirteen features of each audited item with a span in a present document; the position is that in the whole document."""
    counts = inline._counts(spark, sf)
    per = N.commonness(counts).groupBy("mention").agg(F.count("*").alias("n_targets"), F.max("commonness").alias("top"), F.sum("cnt").alias("total"))
    kinds = counts.groupBy("mention").agg(F.max(F.col("origin") == "title").alias("is_title"), F.max(F.col("origin") == "alias").alias("is_alias"))
    known = inline._phrases(spark, sf, counts).select("mention", "keyphraseness").join(per, "mention").join(kinds, "mention")
    d = C.docs(spark, sf).select(F.col("id").alias("source_document_id"), "content")
    i = table(spark, sf, "audit_items").filter("span_start is not null and span_end is not null").join(d, "source_document_id")
    i = i.withColumn("text", F.substring("content", F.col("span_start").cast("int") + 1, F.greatest(F.col("span_end") - F.col("span_start"), F.lit(0)).cast("int"))).withColumn("mention", X.mention_key(F.col("text")))
    words = X.split_space(F.col("text"))
    shapes = S.shapes
    shape = F.udf(lambda t: [float(x) for x in shapes(t)], "array<double>")  # a row an audited item
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    first_upper = F.forall(words, lambda w: F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)))
    return i.join(known, "mention", "left").withColumn("shape", shape("text")).select(
        "id", "source_document_id", "span_start", "span_end", "anchor_text", number("keyphraseness").alias("keyphraseness"), number("top").alias("commonness_top"), number("total").alias("anchor_count"), number("n_targets").alias("target_count"),
        F.size(words).cast("double").alias("word_count"), F.length("text").cast("double").alias("char_count"), number("is_title").alias("is_title_match"), number("is_alias").alias("is_alias_match"),
        F.least(F.lit(1.0), F.col("span_start") / F.greatest(F.length("content"), F.lit(1))).alias("sentence_position"), (F.col("region_kind") == "prose").cast("double").alias("region_prose"),
        ((F.size(words) > 0) & first_upper & (F.upper("text") != F.col("text"))).cast("double").alias("shape_title"), F.col("shape")[1].alias("shape_acronym"), F.col("shape")[2].alias("shape_hyphen"),
    )


def y10_audited_features(spark, sf):
    return _audited(spark, sf).select("id", *[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in FEATURES])


def y7_link_regions(spark, sf):
    """The region kind of each link's span: related under such a heading, else the smallest region around it, else prose."""
    d = C.docs(spark, sf)
    spans = inline._link_spans(spark, sf)
    regions = materialize(R.region_table(d, "id", "content"), "regions").select("doc", "start", "end", "kind")
    related = R.related_regions(d, "id", "content").withColumn("kind", F.lit("related"))
    under = S.smallest_container(spans, related).filter("kind is not null").select("span_id", F.col("kind").alias("override")).distinct()
    kinds = S.smallest_container(spans, regions).join(under, "span_id", "left")
    return kinds.select("span_id", F.coalesce("override", "kind", F.lit("prose")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def y12_recall_gate(spark, sf):
    """Recall of audited prose anchors by the proposed spans when explicit links with spans are taken away."""
    counts = inline._counts(spark, sf)
    dictionary = inline._dictionary(spark, sf, counts, N.commonness(counts))
    d = C.docs(spark, sf)
    left = table(spark, sf, "relationships").filter(~F.col("kind").eqNullSafe("explicit-link") & F.expr("span_start is not null and span_end > span_start"))
    left = left.select(F.col("source_id").alias("doc"), F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    proposed = materialize(S.proposals(d, "id", "content", materialize(dictionary, "dictionary"), left, in_links=True).select("doc", "start", "end"), "proposed")
    items = table(spark, sf, "audit_items").filter("region_kind = 'prose' and span_start is not null and span_end is not null")
    gold = items.select(F.col("id").alias("item"), F.col("source_document_id").alias("doc"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.col("anchor_text").alias("anchor"))
    return S.span_recall(S.narrowed(gold, d.select(F.col("id").alias("doc"), F.col("content").alias("body"))), proposed)


def i21_naturalness_head(spark, sf):
    """Scores of all proposed spans by a naturalness head fitted on audited spans by their consensus tier, other spans being weak negatives."""
    features = inline._features(spark, sf, inline._counts(spark, sf))
    tiers = A.consensus_tier(EV._votes(spark, sf).filter("field = 'tier'")).select(F.col("item").alias("span_id"), "tier")
    audited = _audited(spark, sf).withColumn("span_id", F.col("id")).join(tiers.select("span_id"), "span_id", "left_semi")
    named = features.withColumn("span_id", F.concat_ws(":", "doc", F.col("start").cast("string"), F.col("end").cast("string")))
    both = audited.select("span_id", F.lit(None).cast("double").alias("best_target"), *FEATURES).unionByName(named.select("span_id", F.col("commonness_top").alias("best_target"), *FEATURES))
    model = L.fit_head(materialize(L.training_rows(both, tiers), "training-rows"), FEATURES)
    return L.head_scores(model, named, FEATURES, "learned").select("doc", "start", "end", F.round("learned", 6).alias("learned"))


class _Targets:
    """Catalogue, linked spans and shortlists of the learned target choice, each written once, when first asked for."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        d = C.docs(spark, sf)
        self.docs = d.select(F.col("id").alias("doc"), F.col("content").alias("body"))
        self.titles = d.select("id", "title")

    @cached_property
    def catalog(self):
        described = C.docs(self.spark, self.sf).select("id", "title", F.get_json_object("metadata", "$.category").alias("description"))
        return materialize(H.target_catalog(described, "id", "title", "description"), "catalog")

    @cached_property
    def links(self):
        links = inline._link_spans(self.spark, self.sf).join(table(self.spark, self.sf, "relationships").select(F.col("rel_id").alias("span_id"), "target_id", "kind", "anchor_text"), "span_id").filter("kind = 'explicit-link'")
        return materialize(links.select("doc", "start", "end", clean_reference(F.col("target_id")).alias("target"), "anchor_text").filter("target is not null").dropDuplicates(["doc", "start", "end", "target"]), "linked-spans")

    @cached_property
    def _anchored(self):
        counts = inline._counts(self.spark, self.sf)
        return counts, N.commonness(counts), inline._features(self.spark, self.sf, counts)

    @property
    def features(self):
        return self._anchored[2]

    @cached_property
    def _every(self):
        asked = self.features.filter("mention is not null").select(F.col("doc").alias("source"), "start", "end", "text", "mention")
        linked = self.links.filter("anchor_text is not null").select(F.col("doc").alias("source"), "start", "end", F.col("anchor_text").alias("text"), X.mention_key(F.col("anchor_text")).alias("mention"))
        return materialize(asked.unionByName(linked).filter("mention is not null").distinct(), "asked-spans")

    @cached_property
    def short(self):
        counts, common, _ = self._anchored
        named = counts.filter("origin = 'title'").select("mention", "target")
        return materialize(self._every.join(N.targets_of(self._every.select("source", "mention"), common, named), ["source", "mention"]), "shortlists")

    @cached_property
    def interiors(self):
        """Of asked and linked spans."""
        spans = self._every.select(F.col("source").alias("doc"), "start", "end").unionByName(self.links.select("doc", "start", "end"))
        return materialize(H.span_interiors(self.docs, spans.distinct()), "interiors")

    @cached_property
    def linked_interiors(self):
        """Of linked spans, for what asks for no others."""
        return materialize(H.span_interiors(self.docs, self.links.select("doc", "start", "end").distinct()), "interiors")

    def head(self, interiors):
        rows = self.links.join(interiors, ["doc", "start", "end"]).select("v", "target")
        return H.fit_target_head(rows, self.catalog)


def i24_target_catalog(spark, sf):
    d = C.docs(spark, sf).select("id", "title", F.get_json_object("metadata", "$.category").alias("description"))
    return H.target_catalog(d, "id", "title", "description").select("target", F.posexplode("v").alias("i", "x")).select("target", "i", F.round("x", 9).alias("x"))


def y14_interactions(spark, sf):
    t = _Targets(spark, sf)
    near = t.links.join(t.linked_interiors.withColumnRenamed("v", "interior"), ["doc", "start", "end"]).join(t.catalog, "target")
    return near.select("doc", "start", "end", "target", F.round(H.interaction(F.col("interior"), F.col("v")), 9).alias("cosine"))


def i23_learned_drafts(spark, sf):
    """Every proposed span's best target: softmax of the target head over its shortlist, reranked, with a calibrated confidence."""
    t = _Targets(spark, sf)
    scored = materialize(H.scored_shortlist(t.short, t.interiors, t.catalog, t.titles, t.head(t.interiors)), "scored-shortlists")
    positives = t.links.select(F.col("doc").alias("source"), "start", "end", "target")
    model = H.fit_reranker(scored, positives)
    linked = L.head_scores(model, scored.join(positives.withColumn("label", F.lit(True)), ["source", "start", "end", "target"], "left"), H.RERANK_FEATURES, "rerank")
    judged = linked.join(positives.select("source", "start", "end").distinct(), ["source", "start", "end"], "left_semi").select(F.col("rerank_logit").alias("logit"), F.coalesce("label", F.lit(False)).alias("label"))
    temperature = E.fit_temperature(judged) if judged.select("label").distinct().count() == 2 else 1.0
    proposed = scored.join(t.features.select(F.col("doc").alias("source"), "start", "end").distinct(), ["source", "start", "end"], "left_semi")
    return H.learned_drafts(proposed, model, temperature).select("source", "start", "end", "target", F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"), "abstained")


def y15_bundle(spark, sf):
    """Version of a saved target head, and whether loading it gives the same weights."""
    import os
    import tempfile

    import numpy as np

    t = _Targets(spark, sf)
    head, encoder = t.head(t.linked_interiors), {"name": "hashing-tokens", "dims": 32}
    with tempfile.TemporaryDirectory() as folder:  # a report of the driver's, not data of the job
        path = os.path.join(folder, "bundle.json")
        saved = H.save_bundle(path, {"span": head.span, "target": head.target}, encoder, {"scale": head.scale})
        weights, settings, loaded = H.load_bundle(path, encoder)
    same = bool((weights["span"] == head.span).all() and np.array_equal(weights["target"], head.target) and settings["scale"] == head.scale)
    return spark.createDataFrame([(saved == loaded, same)], "same_version boolean, same_weights boolean")


def x20_recommendations(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("user"))
    bought = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("user", F.col("l_partkey").cast("int").alias("item")).agg(F.count("*").cast("float").alias("n"))
    return L.recommend(materialize(bought, "bought"), "user", "item", "n", 5)


def x24_graph_classifier(spark, sf):
    """Topic of a document from its neighbours' words: share of right answers with and without propagation."""
    adj = graphs.adjacency(spark, sf)
    w = materialize(G.normalized_adjacency(adj), "weights")
    nodes = adj.select(F.col("a").alias("node")).distinct()
    vec = V.hash_embedder(32)
    d = C.docs(spark, sf).select(F.col("id").alias("node"), "content").join(nodes, "node", "left_semi")
    x = materialize(d.select("node", array_to_vector(vec("content").cast("array<double>")).alias("features")), "features")
    labels = d.select("node", F.substring_index("node", "/", 1).alias("topic"))
    kinds = labels.select("topic").distinct().withColumn("label", F.dense_rank().over(K.Window.orderBy("topic")).cast("double") - 1)
    labels = labels.join(F.broadcast(kinds), "topic").select("node", "label")  # a row a topic
    out = None
    for hops in (0, 2):
        got = L.graph_classifier(w, x, labels, hops).filter("not train").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy")).select(F.lit(hops).alias("hops"), "n", "accuracy")
        out = got if out is None else out.unionByName(got)
    return out


def j12_left_merge(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return line.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("p_brand").agg(F.count("*").alias("n"))


def j18_known_edges(spark, sf):
    from weaveline.sources.scan import known_edges

    return known_edges(C.links(spark, sf), C.docs(spark, sf)).select("source", "target", "kind")


def e4_fresh_units(spark, sf):
    """Chunks whose text no chunk of even number has."""
    c = table(spark, sf, "search_chunks").filter("text is not null").select(F.col("chunk_id").alias("unit"), F.sha2("text", 256).alias("content_hash"))
    tag = W.fingerprint(["m", {}])
    cache = c.filter("unit % 2 = 0").select(F.sha2(F.concat_ws("|", "content_hash", F.lit(tag)), 256).alias("cache_key"))
    return W.fresh_units(c, cache, "m").select("unit")


def _jobs(spark, sf):
    e = table(spark, sf, "events").filter("value is not null")
    return e.select(F.col("event_type").alias("queue"), F.col("event_id").alias("job"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"), F.round(F.col("value") * 1_000_000).cast("long").alias("size"))


def sim_fifo(spark, sf):
    return Q.fifo(_jobs(spark, sf)).select("queue", "job", "completion")


def sim_fifo_waits(spark, sf):
    return Q.nearest_rank(Q.fifo(_jobs(spark, sf)).withColumn("wait", F.col("completion") - F.col("arrival") - F.col("size")), "queue", "wait")


def sim_srpt(spark, sf):
    return Q.policy(_jobs(spark, sf), "srpt")


def sim_sjf(spark, sf):
    return Q.policy(_jobs(spark, sf), "sjf")


def sim_rr(spark, sf):
    return Q.policy(_jobs(spark, sf), "rr", 10_000_000)


def sim_admitted(spark, sf):
    """Jobs a queue takes, with room for eight, and what it turns away."""
    a = Q.admitted(_jobs(spark, sf), 8)
    return a.groupBy("queue").agg(F.count("*").alias("n"), F.sum(F.col("admitted").cast("long")).alias("admitted"), F.max("completion").alias("last"))


def sim_hedged(spark, sf):
    e = table(spark, sf, "events").filter("value is not null").select(F.col("event_id").alias("call"), F.round(F.col("value") * 1_000_000).cast("long").alias("first"))
    return Q.hedged(e.withColumn("second", F.pmod(F.col("first") * 7919, F.lit(1_000_003))))


def sim_batched(spark, sf):
    r = _jobs(spark, sf).select("queue", F.col("job").alias("request"), "arrival")
    return Q.batched(r, 16, 1_000_000, 500_000, 20_000)


def sim_deficit(spark, sf):
    j = _jobs(spark, sf)
    return Q.flows_by_deficit(j.select("queue", F.pmod("job", F.lit(4)).alias("flow"), F.col("job").alias("packet"), "size"), 50_000_000, 20)


def c2_model_tokens(spark, sf):
    """Tokens of every document by a public vocabulary, counted by two libraries that hold the same one."""
    d = table(spark, sf, "documents").filter("text is not null")
    a, b = (EN.model_token_count(F.col("text"), f"{VOCABULARIES}/byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    return d.select("doc_id", a.alias("n_tokens"), (a == b).alias("same"))


def e5_embedded(spark, sf):
    """Vectors of chunk headings by the hashing encoder, at unit length."""
    c = table(spark, sf, "search_chunks").filter("heading is not null")
    v = EN.embedded(c, "chunk_id", "heading", "hashing", dims=32)
    return v.select("chunk_id", F.posexplode("v").alias("i", "x")).select("chunk_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def v16_calibrated_acceptance(spark, sf):
    """Sheets accepted above the conformal threshold of their tempered probability."""
    s = EV._scored(spark, sf).withColumn("p", E.with_temperature(F.col("prob") * 6 - 2, 2.0))
    t = E.conformal_threshold(s.select(F.col("p").alias("prob"), F.col("label").alias("correct")), 0.2)
    return s.agg(F.count("*").alias("n"), F.sum((F.col("p") > t).cast("long")).alias("accepted"))


QUERIES = {f.__name__: f for f in (i21_naturalness_head, i22_training_rows, i23_learned_drafts, j12_left_merge, j17_hard_negatives, j18_known_edges, e4_fresh_units, y7_link_regions, y10_audited_features, y11_best_target_cosine, y12_recall_gate, x20_recommendations,
                                   x24_graph_classifier, i24_target_catalog, y14_interactions, y15_bundle, c2_model_tokens, e5_embedded, sim_rr, sim_admitted, sim_hedged, sim_batched, sim_deficit, sim_fifo, sim_fifo_waits, sim_srpt, sim_sjf, v16_calibrated_acceptance)}

_UN = graphs.recursive(C.UNITS)
_JOBS = "jobs AS (SELECT event_type AS queue, event_id AS job, epoch_us(ts) AS arrival, round(value * 1000000)::BIGINT AS size FROM events WHERE value IS NOT NULL)"
_FIFO = _JOBS + """, w AS (SELECT *, (sum(size) OVER (PARTITION BY queue ORDER BY arrival, job ROWS UNBOUNDED PRECEDING))::BIGINT AS work FROM jobs),
f AS (SELECT *, max(arrival - (work - size)) OVER (PARTITION BY queue ORDER BY arrival, job ROWS UNBOUNDED PRECEDING) + work AS completion FROM w)"""

ORACLE = {
    "i22_training_rows": f"""WITH {EV.VOTES}, {EV.TIER}, s AS (SELECT id AS span_id, NULL::DOUBLE AS b FROM audit_items UNION ALL SELECT rel_id::VARCHAR, (rel_id % 10) / 10.0::DOUBLE FROM relationships WHERE anchor_text IS NOT NULL)
SELECT span_id, CASE WHEN tier = 'a' THEN 1.0 ELSE 0.0 END::DOUBLE AS label, CASE WHEN tier IS NOT NULL OR coalesce(b < 0.2, false) THEN 1.0 ELSE 0.05 END::DOUBLE AS weight FROM s LEFT JOIN tiers ON item = span_id WHERE tier IS NULL OR tier IN ('a', 'd')""",
    "j17_hard_negatives": _UN + """SELECT * FROM (SELECT a.unit AS query, b.unit AS target, round(list_dot_product(a.v, b.v), 9) AS sim, row_number() OVER (PARTITION BY a.unit ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.unit) AS rank
FROM units a JOIN units b ON a.view = 'section' AND b.view = 'document' AND a.doc <> b.doc) WHERE rank <= 3""",
    "y11_best_target_cosine": _UN + "SELECT a.unit, max(round(list_dot_product(a.v, b.v), 9)) AS best FROM units a, units b WHERE a.view = 'section' AND b.view = 'document' GROUP BY a.unit",
    "y10_audited_features": inline._OCC.rstrip() + f""", t AS (SELECT i.*, content, content[span_start + 1:greatest(span_end, span_start)] AS txt FROM audit_items i JOIN docs ON docs.id = source_document_id WHERE span_start IS NOT NULL AND span_end IS NOT NULL),
m AS (SELECT *, {inline._KEY('txt')} AS mention, list_filter(regexp_split_to_array(txt, '{inline._SP}+'), lambda w: w <> '') AS ws FROM t),
com AS (SELECT mention, count(*) AS n_targets, max(cnt) / sum(cnt) AS top, sum(cnt) AS total FROM (SELECT mention, target, sum(cnt) AS cnt FROM counts GROUP BY ALL) GROUP BY mention), kd AS (SELECT mention, bool_or(origin = 'title') AS ti, bool_or(origin = 'alias') AS al FROM counts GROUP BY mention)
SELECT id, round(coalesce(keyphraseness, 0), 9)::DOUBLE AS keyphraseness, round(coalesce(top, 0), 9)::DOUBLE AS commonness_top, coalesce(total, 0)::DOUBLE AS anchor_count, coalesce(n_targets, 0)::DOUBLE AS target_count, len(ws)::DOUBLE AS word_count, length(txt)::DOUBLE AS char_count,
  coalesce(ti, false)::INT::DOUBLE AS is_title_match, coalesce(al, false)::INT::DOUBLE AS is_alias_match, round(least(1.0::DOUBLE, span_start / greatest(length(content), 1)), 9) AS sentence_position, (region_kind = 'prose')::INT::DOUBLE AS region_prose,
  (len(ws) > 0 AND len(list_filter(ws, lambda w: w[1] = lower(w[1]))) = 0 AND upper(txt) <> txt)::INT::DOUBLE AS shape_title, regexp_full_match(txt, '[[:upper:]][[:upper:][:digit:]]+')::INT::DOUBLE AS shape_acronym,
  (regexp_full_match(txt, '[[:alnum:]]+(-[[:alnum:]]+)+') AND regexp_matches(txt, '[[:alpha:]]'))::INT::DOUBLE AS shape_hyphen
FROM m LEFT JOIN phr USING (mention) LEFT JOIN com USING (mention) LEFT JOIN kd USING (mention)""",
    "v16_calibrated_acceptance": EV._S + """, p AS (SELECT 1 / (1 + exp(-(prob * 6 - 2) / 2.0)) AS p, label FROM scored), t AS (SELECT s FROM (SELECT CASE WHEN label THEN '-inf'::DOUBLE ELSE p END AS s, row_number() OVER (ORDER BY CASE WHEN label THEN '-inf'::DOUBLE ELSE p END) AS r FROM p) WHERE r = ceil(((SELECT count(*) FROM p) + 1) * 0.8::DOUBLE))
SELECT count(*) AS n, count(*) FILTER (p > s) AS accepted FROM p, t""",
    "sim_hedged": """WITH c AS (SELECT event_id AS call, round(value * 1000000)::BIGINT AS first FROM events WHERE value IS NOT NULL), p AS (SELECT min(first) AS a FROM (SELECT first, row_number() OVER (ORDER BY first) AS r, count(*) OVER () AS n FROM c) WHERE r >= ceil(0.95::DOUBLE * n))
SELECT call, CASE WHEN first > a THEN least(first, a + (first * 7919) % 1000003) ELSE first END AS latency FROM c, p""",
    "j12_left_merge": "SELECT p_brand, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "j18_known_edges": graphs.recursive(C.DOCS, C.LINKS) + "SELECT source, target, kind FROM links WHERE source IN (SELECT id FROM docs) AND target IN (SELECT id FROM docs)",
    "e4_fresh_units": "SELECT chunk_id AS unit FROM search_chunks WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM search_chunks WHERE chunk_id % 2 = 0 AND text IS NOT NULL)",
    "sim_fifo": f"WITH {_FIFO} SELECT queue, job, completion FROM f",
    "sim_fifo_waits": f"WITH {_FIFO}, r AS (SELECT queue, completion - arrival - size AS wait, row_number() OVER (PARTITION BY queue ORDER BY completion - arrival - size) AS r, count(*) OVER (PARTITION BY queue) AS n FROM f) SELECT queue, " + ", ".join(f"min(wait) FILTER (r >= ceil({p}::DOUBLE * n)) AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM r GROUP BY queue",
}
