"""Queries of evaluation, calibration, audit and notebook statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weaveline.operators import audit as A
from weaveline.operators import evaluate as E
from weaveline.operators import linear
from weaveline.operators import pairs as P
from weaveline.operators import ranking as R
from weaveline.plans import corpus as C
from weaveline.plans import graphs
from weaveline.plans import pairs as PP
from weaveline.plans.tables import table
from weaveline.scratch import bounded_broadcast, materialize

FIELDS = ["target_correct", "anchor_natural", "placement_valid", "tier"]


def _ranked(spark, sf):
    """A ranking of all pairs of near documents, linked or not: (id, source, target, rank, score)."""
    s = PP.Stage(spark, sf)
    pairs = P.bounded_pairs(P.kept_matches(P.unit_matches(s.neighbors, s.units)), 20)
    ordered = pairs.select("source", "target", F.col("best").alias("score"), F.lit(0).alias("position"))
    return materialize(R.total_order(ordered).withColumn("id", F.concat_ws(">", "source", "target")), "ranking")


def _held(spark, sf):
    return C.links(spark, sf).filter("kind = 'explicit-link' and pmod(length(source) + length(target), 3) = 0")


def _visible(spark, sf):
    return C.links(spark, sf).filter("kind = 'explicit-link' and pmod(length(source) + length(target), 3) <> 0")


def _decided(ranked):
    kind = F.when(F.pmod(F.length("source"), F.lit(3)) < 2, "accept").otherwise("reject")
    return ranked.filter(F.pmod(F.length("target"), F.lit(2)) == 0).select("id", kind.alias("decision"))


def _scored(spark, sf):
    """Answer sheets with a probability that follows the length of the item's context, and whether the target was right."""
    items = table(spark, sf, "audit_items").select(F.col("id").alias("item_id"), F.least(F.lit(1.0), F.length("context") / 400.0).alias("prob"))
    return table(spark, sf, "audit_labels").filter("target_correct is not null").join(items, "item_id").select("label_id", "item_id", "prob", F.col("target_correct").alias("label"))


def _sheets(spark, sf):
    items = table(spark, sf, "audit_items").select(F.col("id").alias("item"))
    return A.latest_sheets(table(spark, sf, "audit_labels"), "item_id", "annotator", "labeled_at", "label_id", FIELDS).join(items, "item", "left_semi")


def _votes(spark, sf):
    return materialize(A.long_votes(_sheets(spark, sf), FIELDS).filter("field <> 'tier' or answer in ('a', 'b', 'c', 'd')"), "votes")


def v1_holdout(spark, sf):
    return E.holdout(table(spark, sf, "relationships").select("rel_id", F.col("source_id").alias("source"), "kind"), "rel_id", 0.2).groupBy("bucket", "held").agg(F.count("*").alias("n"))


def v2_recovery(spark, sf):
    r = E.recovery(_ranked(spark, sf), _held(spark, sf))
    return r.select(*[F.round(c, 9).alias(c) for c in ("recall_at_5", "recall_at_10", "recall_at_25", "mrr")], "recovered", "held_out")


def v3_recovery_by_degree(spark, sf):
    return E.recovery_by_degree(_ranked(spark, sf), _held(spark, sf), _visible(spark, sf), 1000).select("bucket", F.round("recall", 9).alias("recall"), "held_out")


def v4_reviewer_quality(spark, sf):
    ranked = _ranked(spark, sf)
    q = E.reviewer_quality(ranked, _decided(ranked), (10, 100, 1000))
    return q.select(*[F.round(c, 9).alias(c) for c in q.columns])


def v5_rank_agreement(spark, sf):
    a = _ranked(spark, sf)
    b = R.total_order(a.select("id", "source", "target", F.round(F.col("score") - 0.2 * F.pmod(F.length("target"), F.lit(5)) / 5, 9).alias("score"), F.lit(0).alias("position")))
    r = E.rank_agreement(a, b, 200)
    return r.select(*[F.round(c, 9).alias(c) for c in ("jaccard", "spearman", "score_divergence")], "shared_pairs")


def _spans(spark, sf):
    return table(spark, sf, "relationships").filter("span_start is not null and span_end is not null").select(F.col("source_id").alias("doc"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), "rel_id")


def v7_span_f1_exact(spark, sf):
    s = _spans(spark, sf)
    r = E.exact_span_f1(s.filter("rel_id % 3 <> 0"), s.filter("rel_id % 3 <> 1"), ["doc", "start", "end"])
    return r.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "matched")


def v7_span_f1_overlap(spark, sf):
    s = _spans(spark, sf)
    shifted = s.filter("rel_id % 3 <> 0").withColumn("start", F.col("start") + F.col("rel_id") % 4)
    return E.overlap_span_f1(shifted, s.filter("rel_id % 3 <> 1"), "doc")


def v8_retrieval_metrics(spark, sf):
    """Whether a chunk's other embedding is found among its neighbours."""
    e = materialize(PP.V.usable(table(spark, sf, "chunk_vectors"), "embedding", 96).select("id", "chunk_id", F.col("embedding").alias("v")), "vectors")
    again = e.groupBy("chunk_id").agg(F.min("id").alias("query"), F.max("id").alias("item")).filter("query < item").select("query", "item")
    r = E.retrieval_metrics(PP.K.pair_ranks(e, "id", "v", again, 10), again)
    return r.select(*[F.round(c, 9).alias(c) for c in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr")], "queries")


def v9_judged_precision(spark, sf):
    ranked = _ranked(spark, sf)
    j = ranked.join(_decided(ranked), "id", "left").select("rank", (F.col("decision") == "accept").alias("judged"), (F.pmod(F.length("source"), F.lit(7)) == 0).alias("abstained"))
    r = E.judged_precision(j)
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


def v10_bpref(spark, sf):
    s = _scored(spark, sf)
    by = Window.partitionBy("item_id").orderBy("label_id")
    return E.bpref(s.select(F.col("item_id").alias("query"), F.row_number().over(by).alias("rank"), F.col("label").alias("relevant"))).select("query", F.round("bpref", 9).alias("bpref"))


def v11_slices(spark, sf):
    items = table(spark, sf, "audit_items").select(F.col("id").alias("item_id"), F.substring_index("region_kind", "_", 1).alias("kind"), (F.col("anchor_word_count") >= 4).alias("hard"))
    cases = _scored(spark, sf).join(items, "item_id").select("kind", "hard", F.col("label").alias("correct"))
    return E.slices(cases, ["prose", "list", "other", "table", "code", "related", "citation", "heading"]).select("slice", "n", "correct", F.round("accuracy", 9).alias("accuracy"))


SWEEP = [i / 20 for i in range(21)]


def v14_pr_sweep(spark, sf):
    return E.pr_sweep(_scored(spark, sf), SWEEP).select("threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "accepted")


def v12_operating_point(spark, sf):
    return E.operating_point(v14_pr_sweep(spark, sf), 0.7)


def v13_kill_criterion(spark, sf):
    p = v12_operating_point(spark, sf)
    return p.select("threshold", ((F.col("recall") < 0.2) | (F.col("precision") < 0.7)).alias("killed"))


def _logits(spark, sf):
    return _scored(spark, sf).select("label", (F.col("prob") * 6 - 2).alias("logit"))


def v15_temperature_fit(spark, sf):
    return spark.createDataFrame([(round(E.fit_temperature(_logits(spark, sf)), 6),)], "temperature double")


def v16_tempered(spark, sf):
    s = _scored(spark, sf)
    return s.select("label_id", F.round(E.with_temperature(F.col("prob") * 6 - 2, 1.7), 9).alias("p"))


def v17_reliability_table(spark, sf):
    return E.reliability_table(_scored(spark, sf)).select("bin", "n", F.round("mean_prob", 9).alias("mean_prob"), F.round("share_true", 9).alias("share_true"))


def v17_ece(spark, sf):
    return E.calibration_error(E.reliability_table(_scored(spark, sf))).select(F.round("ece", 9).alias("ece"))


def v18_conformal(spark, sf):
    t = E.conformal_threshold(_scored(spark, sf).select("prob", F.col("label").alias("correct")), 0.1)
    return spark.createDataFrame([(float(t),)], "threshold double")


def v19_kappa(spark, sf):
    return A.pairwise_kappa(_votes(spark, sf)).select("field", "rater_a", "rater_b", "n", F.round("kappa", 9).alias("kappa"))


def v20_alpha(spark, sf):
    return A.alpha(_votes(spark, sf)).select("field", "n_units", "n_ratings", F.round("alpha", 9).alias("alpha"))


def v21_agreement_report(spark, sf):
    return A.agreement_report(_votes(spark, sf)).select("field", F.round("kappa", 9).alias("kappa"), F.round("alpha", 9).alias("alpha"))


def v22_derived_tiers(spark, sf):
    items = table(spark, sf, "audit_items").select(F.col("id").alias("item_id"), "region_kind")
    tier = A.derived_tier(F.col("target_correct"), F.col("anchor_natural"), F.col("placement_valid"), F.col("region_kind"))
    return table(spark, sf, "audit_labels").join(items, "item_id").select("label_id", tier.alias("tier"))


def v22_consensus_tier(spark, sf):
    return A.consensus_tier(_votes(spark, sf).filter("field = 'tier'"))


def v23_audit_report(spark, sf):
    votes = _votes(spark, sf)
    r = A.audit_report(table(spark, sf, "audit_items"), A.consensus_tier(votes.filter("field = 'tier'")), A.agreement_report(votes))
    return r.withColumn("min_kappa", F.round("min_kappa", 9))


def v24_stratified_sample(spark, sf):
    return A.stratified_sample(table(spark, sf, "audit_items"), "id", "strata_key", 60).groupBy("strata_key").agg(F.count("*").alias("n"))


def v24_strata(spark, sf):
    i = table(spark, sf, "audit_items")
    kind = F.when(F.col("source_document_id").endswith("index"), "index").otherwise("page")
    return i.select("id", A.strata_key(F.col("region_kind"), F.col("anchor_word_count"), F.col("topic_family"), kind).alias("key"))


def v25_context_windows(spark, sf):
    from weaveline.functions.text import context_window

    d = C.docs(spark, sf).select("id", "content")
    r = table(spark, sf, "relationships").filter("span_start is not null and span_end >= span_start").select("rel_id", F.col("source_id").alias("id"), "span_start", "span_end")
    return r.join(d, "id").filter("span_end <= length(content)").select("rel_id", context_window(F.col("content"), F.col("span_start"), F.col("span_end")).alias("context"))


def x18_leave_last_out(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return E.leave_last_out(o, "o_custkey", "o_orderdate", "o_orderkey").filter("held").select("o_custkey", "o_orderkey")


def x19_seen_masked_recall(spark, sf):
    """Recall@10 of a customer's last part in the list of most bought parts, the customer's other parts left out.

    A part beyond place 10 + n can't be among the first 10 of a customer with n parts, so the list ends there for the largest n.
    """
    line = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), "l_shipdate", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("o"))
    last = line.groupBy("user").agg(F.max_by("item", "o").alias("item"))
    owned = materialize(line.select("user", F.col("item").alias("had")).distinct(), "owned")
    most = owned.groupBy("user").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    popular = line.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(most + 10).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "item"))).select("item", "place")
    # a held item moves up by the better placed items that its customer has already
    popular = materialize(popular, "popular")
    asked = last.join(bounded_broadcast(popular)[0], "item")
    better = owned.join(bounded_broadcast(popular.select(F.col("item").alias("had"), F.col("place").alias("had_place")))[0], "had")
    moved = asked.join(better, "user").filter("had_place < place").groupBy("user").agg(F.count("*").alias("up"))
    ranks = asked.join(moved, "user", "left").select(F.col("user").alias("query"), "item", (F.col("place") - F.coalesce("up", F.lit(0))).alias("rank")).filter("rank <= 10")
    r = E.retrieval_metrics(ranks, last.select(F.col("user").alias("query"), "item"), (10,))
    return r.select(F.round("recall_at_10", 9).alias("recall_at_10"), F.round("mrr", 9).alias("mrr"), "queries")


def x22_class_sample(spark, sf):
    by = Window.partitionBy("label").orderBy(F.xxhash64("vec_id"), "vec_id")
    return table(spark, sf, "embeddings").select("vec_id", "label", F.row_number().over(by).alias("r")).filter("r <= 20").groupBy("label").agg(F.count("*").alias("n"))


def x23_row_share(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    return e.select("vec_id", F.posexplode(PP.V.row_share(F.col("v"))).alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))


def x25_pca(spark, sf):
    """Variances of the vectors' first 8 principal components."""
    return linear.explained_variance(table(spark, sf, "embeddings"), "embedding", 8)


def x26_taxonomy_view(spark, sf):
    d = table(spark, sf, "documents").filter(F.lower("category").contains("m"))
    return d.groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def y2_corpus_fingerprint(spark, sf):
    """Digest of the set of (id, revision, key) rows: sums of four 60-bit parts of the rows' digests, which need no order, and their number."""
    d = table(spark, sf, "source_documents").filter("id is not null")
    h = F.sha2(F.concat_ws("\t", "id", F.coalesce("revision", F.lit("")), F.col("doc_key").cast("string")), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return d.agg(F.concat_ws("\n", F.count("*").cast("string"), *[part(i) for i in range(4)]).alias("x")).select(F.concat(F.lit("sha256:"), F.sha2("x", 256)).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (v1_holdout, v2_recovery, v3_recovery_by_degree, v4_reviewer_quality, v5_rank_agreement, v7_span_f1_exact, v7_span_f1_overlap, v8_retrieval_metrics, v9_judged_precision, v10_bpref, v11_slices,
                                   v12_operating_point, v13_kill_criterion, v14_pr_sweep, v15_temperature_fit, v16_tempered, v17_reliability_table, v17_ece, v18_conformal, v19_kappa, v20_alpha, v21_agreement_report, v22_derived_tiers,
                                   v22_consensus_tier, v23_audit_report, v24_stratified_sample, v24_strata, v25_context_windows, x18_leave_last_out, x19_seen_masked_recall, x22_class_sample, x23_row_share, x25_pca, x26_taxonomy_view, y2_corpus_fingerprint)}

RANKED = """
kept2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY sim DESC, src_unit, tgt_unit, view) AS place FROM matches) WHERE place <= 8),
best2 AS (SELECT source, target, max(sim) AS best FROM kept2 GROUP BY ALL),
ends2 AS (SELECT source, target, best, row_number() OVER (PARTITION BY doc ORDER BY best DESC, source, target) AS r FROM (SELECT *, source AS doc FROM best2 UNION ALL SELECT *, target FROM best2)),
ranked AS MATERIALIZED (SELECT source || '>' || target AS id, source, target, best AS score, row_number() OVER (ORDER BY best DESC, source, target) AS rank FROM (SELECT source, target, best FROM ends2 WHERE r <= 20 GROUP BY ALL HAVING count(*) = 2)),
held AS (SELECT * FROM links WHERE kind = 'explicit-link' AND (length(source) + length(target)) % 3 = 0),
decided AS (SELECT id, CASE WHEN length(source) % 3 < 2 THEN 'accept' ELSE 'reject' END AS decision FROM ranked WHERE length(target) % 2 = 0)"""
_R = graphs.recursive(C.LINKS, C.UNITS, PP.NN, PP.MATCHES, RANKED).rstrip()
_RECALL = lambda k: f"round(avg((place <= {k})::DOUBLE), 9) AS recall_at_{k}"
SCORED = "scored AS (SELECT label_id, item_id, least(1.0, length(context) / 400.0)::DOUBLE AS prob, target_correct AS label FROM audit_labels JOIN audit_items i ON i.id = item_id WHERE target_correct IS NOT NULL)"
_S = f"WITH {SCORED}"
_SP = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
VOTES = """sheets AS (SELECT item_id AS item, lower(trim(annotator)) AS annotator, lower(trim(tier)) AS tier, target_correct, anchor_natural, placement_valid,
    row_number() OVER (PARTITION BY item_id, lower(trim(annotator)) ORDER BY labeled_at DESC, label_id DESC) AS rn FROM audit_labels WHERE trim(annotator) <> '' AND item_id IN (SELECT id FROM audit_items)),
votes AS MATERIALIZED (SELECT item, 'tier' AS field, annotator, tier AS answer FROM sheets WHERE rn = 1 AND tier IN ('a', 'b', 'c', 'd')
  UNION ALL SELECT item, 'target_correct', annotator, target_correct::VARCHAR FROM sheets WHERE rn = 1 AND target_correct IS NOT NULL
  UNION ALL SELECT item, 'anchor_natural', annotator, anchor_natural::VARCHAR FROM sheets WHERE rn = 1 AND anchor_natural IS NOT NULL
  UNION ALL SELECT item, 'placement_valid', annotator, placement_valid::VARCHAR FROM sheets WHERE rn = 1 AND placement_valid IS NOT NULL)"""
KAPPA = """both_ AS (SELECT a.field, a.annotator AS rater_a, b.annotator AS rater_b, a.answer AS x, b.answer AS y FROM votes a JOIN votes b ON a.item = b.item AND a.field = b.field AND a.annotator < b.annotator),
tot AS (SELECT field, rater_a, rater_b, count(*) AS n, avg((x = y)::DOUBLE) AS o FROM both_ GROUP BY ALL),
ma AS (SELECT field, rater_a, rater_b, x AS answer, count(*) AS m FROM both_ GROUP BY ALL), mb AS (SELECT field, rater_a, rater_b, y AS answer, count(*) AS m FROM both_ GROUP BY ALL),
ch AS (SELECT ma.field, ma.rater_a, ma.rater_b, sum(ma.m * mb.m)::DOUBLE AS p FROM ma JOIN mb USING (field, rater_a, rater_b, answer) GROUP BY ALL),
kappa AS (SELECT t.field, t.rater_a, t.rater_b, n, CASE WHEN coalesce(p, 0) = n * n THEN (o = 1)::INT::DOUBLE ELSE (o - coalesce(p, 0) / (n * n)) / (1 - coalesce(p, 0) / (n * n)) END AS kappa FROM tot t LEFT JOIN ch USING (field, rater_a, rater_b))"""
ALPHA = """cells AS (SELECT field, item, answer, count(*)::DOUBLE AS n FROM votes GROUP BY ALL), us AS (SELECT field, item, sum(n) AS m, sum(n * n) AS sq FROM cells GROUP BY ALL HAVING sum(n) > 1),
seen AS (SELECT field, count(*) AS n_units, sum(m) AS total, sum((m * m - sq) / (m - 1)) AS apart FROM us GROUP BY field),
chance AS (SELECT field, sum(n * n) AS sq FROM (SELECT field, answer, sum(n) AS n FROM cells JOIN us USING (field, item) GROUP BY ALL) GROUP BY field),
alpha AS (SELECT field, n_units, total::BIGINT AS n_ratings, CASE WHEN total * total = sq THEN 1.0 ELSE 1 - (apart / total) / ((total * total - sq) / (total * (total - 1))) END AS alpha FROM seen JOIN chance USING (field))"""
TIER = "tiers AS (SELECT item, arg_max(answer, (n, answer)) AS tier FROM (SELECT item, answer, count(*) AS n FROM votes WHERE field = 'tier' GROUP BY ALL) GROUP BY item)"
_SWEEP = "cuts AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(21) t(i)), sweep AS (SELECT threshold, round(coalesce(avg(CASE WHEN prob >= threshold THEN label::INT::DOUBLE END), 0), 9) AS precision, round(count(*) FILTER (prob >= threshold AND label) / (SELECT count(*) FROM scored WHERE label), 9) AS recall, count(*) FILTER (prob >= threshold) AS accepted FROM cuts, scored GROUP BY threshold)"
_F1 = "round(m / p, 9) AS precision, round(m / g, 9) AS recall, round(2 * m / (p + g), 9) AS f1, m::BIGINT AS matched"

ORACLE = {
    "v15_temperature_fit": r"""WITH RECURSIVE s AS (SELECT label, (CASE WHEN label THEN 1 ELSE -1 END) * (least(1.0, length(context) / 400.0)::DOUBLE * 6 - 2) AS z FROM (SELECT l.target_correct AS label, i.context FROM audit_labels l JOIN audit_items i ON i.id = item_id WHERE target_correct IS NOT NULL)),
zs AS (SELECT list(z) AS z FROM s),
b(lo, hi, i) AS (SELECT 0.05::DOUBLE, 20.0::DOUBLE, 0 UNION ALL SELECT CASE WHEN d < 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN d < 0 THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT lo, hi, i, list_sum(list_transform(z, lambda x: -x / (1 + exp(x * (lo + hi) / 2)))) AS d FROM b, zs WHERE i < 60)),
m AS (SELECT (lo + hi) / 2 AS beta FROM b WHERE i = 60), l AS (SELECT beta, list_avg(list_transform(z, lambda x: ln(1 + exp(-x * beta)))) AS fitted, list_avg(list_transform(z, lambda x: ln(1 + exp(-x)))) AS plain FROM m, zs)
SELECT round(CASE WHEN fitted <= plain THEN 1 / beta ELSE 1.0 END, 6) AS temperature FROM l""",
    "y2_corpus_fingerprint": "WITH h AS (SELECT sha256(concat_ws(chr(9), id, coalesce(revision, ''), doc_key::VARCHAR)) AS h FROM source_documents WHERE id IS NOT NULL) SELECT 'sha256:' || sha256(concat_ws(chr(10), count(*)::VARCHAR, "
    + ", ".join(f"sum(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT::HUGEINT)::VARCHAR" for i in range(4)) + ")) AS fingerprint FROM h",
    "v25_context_windows": graphs.recursive(C.DOCS) + rf""", r AS (SELECT rel_id, content, greatest(span_start - 240, 0) AS a, least(span_end + 240, length(content)) AS b FROM relationships JOIN docs ON docs.id = source_id WHERE span_start IS NOT NULL AND span_end >= span_start AND span_end <= length(content))
SELECT rel_id, CASE WHEN a > 0 THEN '... ' ELSE '' END || trim(regexp_replace(content[a + 1:b], '{_SP}+', ' ', 'g')) || CASE WHEN b < length(content) THEN ' ...' ELSE '' END AS context FROM r""",
    "v24_stratified_sample": """WITH c AS (SELECT strata_key, count(*) AS n FROM audit_items WHERE strata_key IS NOT NULL GROUP BY strata_key), t AS (SELECT sum(n) AS total, count(*) AS k, sum(n - 1) AS room FROM c),
q AS (SELECT strata_key, n, total, k, (60 - k) * (n - 1) / greatest(room, 1)::DOUBLE AS share, row_number() OVER (ORDER BY n DESC, strata_key) AS big FROM c, t),
b AS (SELECT *, 1 + least(floor(share), n - 1) AS base FROM q), o AS (SELECT *, row_number() OVER (ORDER BY base >= n, share - floor(share) DESC, strata_key) AS place, 60 - sum(base) OVER () AS short FROM b)
SELECT strata_key, CASE WHEN total <= 60 THEN n WHEN k >= 60 THEN 1 ELSE base + (place <= short)::INT END::BIGINT AS n FROM o WHERE total <= 60 OR k < 60 OR big <= 60""",
    "v1_holdout": """WITH d AS (SELECT source_id, count(*) AS deg FROM relationships WHERE kind = 'explicit-link' GROUP BY source_id), e AS (SELECT r.kind, CASE WHEN r.kind = 'explicit-link' THEN CASE WHEN deg <= 1 THEN '1' WHEN deg <= 4 THEN '2-4' ELSE '5+' END END AS bucket FROM relationships r LEFT JOIN d USING (source_id)),
n AS (SELECT bucket, count(*) AS n FROM e GROUP BY bucket), q AS (SELECT bucket, n, CASE WHEN bucket IS NULL THEN 0 ELSE round_even(0.2 * n, 0)::BIGINT END AS held FROM n)
SELECT bucket, held, n FROM (SELECT bucket, true AS held, held AS n FROM q UNION ALL SELECT bucket, false, n - held FROM q) WHERE n > 0""",
    "v2_recovery": _R + f""", e AS (SELECT source AS doc, target AS other, rank FROM ranked UNION ALL SELECT target, source, rank FROM ranked),
placed AS (SELECT least(doc, other) AS a, greatest(doc, other) AS b, min(place) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank) AS place FROM e) GROUP BY ALL),
h AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM held WHERE source <> target),
j AS (SELECT coalesce(place, 1000000) AS place, place AS found FROM h LEFT JOIN placed USING (a, b))
SELECT {_RECALL(5)}, {_RECALL(10)}, {_RECALL(25)}, round(avg(coalesce(1 / found, 0)), 9) AS mrr, count(found) AS recovered, count(*) AS held_out FROM j""",
    "v3_recovery_by_degree": _R + """, deg AS (SELECT source, count(*) AS d FROM links WHERE kind = 'explicit-link' AND (length(source) + length(target)) % 3 <> 0 GROUP BY source),
h AS (SELECT DISTINCT source, target FROM held), top AS (SELECT least(source, target) AS a, greatest(source, target) AS b FROM ranked WHERE rank <= 1000),
r AS (SELECT CASE WHEN coalesce(d, 0) <= 1 THEN '1' WHEN d <= 4 THEN '2-4' ELSE '5+' END AS bucket, (EXISTS (SELECT 1 FROM top WHERE a = least(h.source, h.target) AND b = greatest(h.source, h.target)))::INT::DOUBLE AS hit FROM h LEFT JOIN deg USING (source))
SELECT bucket, round(coalesce(avg(hit), 0), 9) AS recall, count(hit) AS held_out FROM (VALUES ('1'), ('2-4'), ('5+')) b(bucket) LEFT JOIN r USING (bucket) GROUP BY bucket""",
    "v4_reviewer_quality": _R + """, d AS (SELECT rank, (decision = 'accept')::INT::DOUBLE AS ok FROM ranked JOIN decided USING (id)),
per AS (SELECT doc, count(*) AS x, min(rank) AS best FROM (SELECT source AS doc, rank FROM ranked UNION ALL SELECT target, rank FROM ranked) GROUP BY doc),
o AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n, sum(x) OVER () AS s FROM per)
SELECT (SELECT round(coalesce(avg(ok) FILTER (rank <= 10), 0), 9) FROM d) AS precision_at_10, (SELECT round(coalesce(avg(ok) FILTER (rank <= 100), 0), 9) FROM d) AS precision_at_100, (SELECT round(coalesce(avg(ok) FILTER (rank <= 1000), 0), 9) FROM d) AS precision_at_1000,
(SELECT round(avg(ok), 9) FROM d) AS acceptance_rate, (SELECT round(avg((best <= 1000)::INT::DOUBLE), 9) FROM per) AS coverage, (SELECT round(2 * sum(i * x) / (any_value(n) * any_value(s)) - (any_value(n) + 1) / any_value(n), 9) FROM o) AS concentration""",
    "v5_rank_agreement": _R + """, b AS (SELECT *, row_number() OVER (ORDER BY s2 DESC, source, target) AS r2 FROM (SELECT *, round(score - 0.2::DOUBLE * (length(target) % 5) / 5, 9) AS s2 FROM ranked)),
u AS (SELECT *, rank <= 200 AS ina, r2 <= 200 AS inb FROM b WHERE rank <= 200 OR r2 <= 200),
s AS (SELECT *, row_number() OVER (ORDER BY rank) - row_number() OVER (ORDER BY r2) AS d FROM u WHERE ina AND inb)
SELECT round((SELECT count(*) FROM s) / (SELECT count(*) FROM u), 9) AS jaccard, (SELECT round(1 - 6 * sum(d * d) / (count(*) * (count(*) * count(*) - 1)), 9) FROM s) AS spearman, (SELECT round(max(abs(score - s2)), 9) FROM s) AS score_divergence, (SELECT count(*) FROM s) AS shared_pairs""",
    "v7_span_f1_exact": f"""WITH s AS (SELECT source_id, span_start, span_end, rel_id FROM relationships WHERE span_start IS NOT NULL AND span_end IS NOT NULL AND source_id IS NOT NULL),
c AS (SELECT count(*) FILTER (rel_id % 3 <> 0) AS p, count(*) FILTER (rel_id % 3 <> 1) AS g FROM s GROUP BY source_id, span_start, span_end), t AS (SELECT sum(least(p, g))::DOUBLE AS m, sum(p)::DOUBLE AS p, sum(g)::DOUBLE AS g FROM c) SELECT {_F1} FROM t""",
    "v8_retrieval_metrics": f"""WITH e AS (SELECT id, chunk_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM chunk_vectors WHERE {PP._FINITE}),
q AS (SELECT min(id) AS q, max(id) AS i FROM e GROUP BY chunk_id HAVING count(*) > 1),
r AS (SELECT q, i, (SELECT count(*) FROM e x WHERE x.id <> q AND (round(list_dot_product(x.v, a.v), 9) > round(list_dot_product(b.v, a.v), 9) OR (round(list_dot_product(x.v, a.v), 9) = round(list_dot_product(b.v, a.v), 9) AND x.id <= i))) AS rank FROM q JOIN e a ON a.id = q JOIN e b ON b.id = i)
SELECT round(avg((rank <= 1)::INT), 9) AS recall_at_1, round(avg((rank <= 5)::INT), 9) AS recall_at_5, round(avg((rank <= 10)::INT), 9) AS recall_at_10, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 9) AS mrr, count(*) AS queries FROM r""",
    "v9_judged_precision": _R + """, l AS (SELECT rank, decision FROM ranked LEFT JOIN decided USING (id) WHERE length(source) % 7 <> 0), j AS (SELECT row_number() OVER (ORDER BY rank) AS p, (decision = 'accept')::INT::DOUBLE AS ok FROM l WHERE decision IS NOT NULL)
SELECT (SELECT round(coalesce(avg(ok) FILTER (p <= 5), 0), 9) FROM j) AS precision_at_5, (SELECT round(coalesce(avg(ok) FILTER (p <= 10), 0), 9) FROM j) AS precision_at_10, (SELECT round(coalesce(avg(ok) FILTER (p <= 25), 0), 9) FROM j) AS precision_at_25,
(SELECT round(avg((decision IS NOT NULL)::INT::DOUBLE), 9) FROM l) AS judged_fraction""",
    "v10_bpref": _S + """, o AS (SELECT item_id, label, count(*) FILTER (label) OVER (PARTITION BY item_id) AS r, count(*) FILTER (NOT label) OVER (PARTITION BY item_id) AS n,
  coalesce(sum((NOT label)::INT) OVER (PARTITION BY item_id ORDER BY label_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM scored)
SELECT item_id AS query, round(coalesce(sum(CASE WHEN label THEN CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 1 - least(above, r) / least(r, n) END END) / nullif(max(r), 0), 0), 9) AS bpref FROM o GROUP BY item_id""",
    "v11_slices": _S + """, c AS (SELECT split_part(region_kind, '_', 1) AS kind, anchor_word_count >= 4 AS hard, label FROM scored JOIN audit_items i ON i.id = item_id), t AS (SELECT kind AS slice, label FROM c UNION ALL SELECT 'hard_case', label FROM c WHERE hard UNION ALL SELECT 'overall', label FROM c)
SELECT slice, count(label) AS n, count(*) FILTER (label) AS correct, round(coalesce(count(*) FILTER (label) / nullif(count(label), 0), 0), 9) AS accuracy
FROM (SELECT unnest(['prose', 'list', 'other', 'table', 'code', 'related', 'citation', 'heading', 'hard_case', 'overall']) AS slice) LEFT JOIN t USING (slice) GROUP BY slice""",
    "v14_pr_sweep": _S + ", " + _SWEEP + " SELECT * FROM sweep",
    "v12_operating_point": _S + ", " + _SWEEP + " SELECT * FROM sweep WHERE precision >= 0.7 ORDER BY recall DESC, precision DESC, threshold LIMIT 1",
    "v13_kill_criterion": _S + ", " + _SWEEP + " SELECT threshold, recall < 0.2 OR precision < 0.7 AS killed FROM sweep WHERE precision >= 0.7 ORDER BY recall DESC, precision DESC, threshold LIMIT 1",
    "v16_tempered": _S + " SELECT label_id, round(1 / (1 + exp(-(prob * 6 - 2) / 1.7)), 9) AS p FROM scored",
    "v17_reliability_table": _S + " SELECT b::INT AS bin, count(prob) AS n, round(coalesce(avg(prob), 0), 9) AS mean_prob, round(coalesce(avg(label::INT), 0), 9) AS share_true FROM range(10) t(b) LEFT JOIN scored ON least(floor(prob * 10), 9) = b GROUP BY b",
    "v17_ece": _S + " SELECT round(sum(n * abs(p - y)) / sum(n), 9) AS ece FROM (SELECT count(*) AS n, avg(prob) AS p, avg(label::INT) AS y FROM scored GROUP BY least(floor(prob * 10), 9))",
    "v18_conformal": _S + " SELECT s AS threshold FROM (SELECT CASE WHEN label THEN '-inf'::DOUBLE ELSE prob END AS s, row_number() OVER (ORDER BY CASE WHEN label THEN '-inf'::DOUBLE ELSE prob END) AS r FROM scored) WHERE r = ceil(((SELECT count(*) FROM scored) + 1) * 0.9::DOUBLE)",
    "v19_kappa": f"WITH {VOTES}, {KAPPA} SELECT field, rater_a, rater_b, n, round(kappa, 9) AS kappa FROM kappa",
    "v20_alpha": f"WITH {VOTES}, {ALPHA} SELECT field, n_units, n_ratings, round(alpha, 9) AS alpha FROM alpha",
    "v21_agreement_report": f"WITH {VOTES}, {KAPPA}, {ALPHA} SELECT field, round(avg(kappa), 9) AS kappa, round(any_value(alpha), 9) AS alpha FROM kappa JOIN alpha USING (field) GROUP BY field",
    "v22_derived_tiers": """SELECT label_id, CASE WHEN target_correct IS NULL THEN NULL WHEN NOT target_correct THEN 'd' WHEN split_part(region_kind, '_', 1) IN ('related', 'heading', 'table', 'code') THEN 'c'
  WHEN coalesce(anchor_natural AND placement_valid, false) THEN 'a' ELSE 'b' END AS tier FROM audit_labels JOIN audit_items i ON i.id = item_id""",
    "v22_consensus_tier": f"WITH {VOTES}, {TIER} SELECT item, tier FROM tiers",
    "v23_audit_report": f"""WITH {VOTES}, {KAPPA}, {TIER}, mk AS (SELECT round(min(k), 9) AS k FROM (SELECT avg(kappa) AS k FROM kappa GROUP BY field)),
c AS (SELECT count(*) AS n_labeled, count(*) FILTER (tier = 'a') AS tier_a, count(*) FILTER (tier = 'b') AS tier_b, count(*) FILTER (tier = 'c') AS tier_c, count(*) FILTER (tier = 'd') AS tier_d FROM tiers)
SELECT (SELECT count(*) FROM audit_items) AS n_items, c.*, k AS min_kappa, k >= 0.6 AND tier_a + tier_b >= 150 AS go FROM c, mk""",
    "v24_strata": "SELECT id, concat_ws('|', region_kind, CASE WHEN anchor_word_count <= 1 THEN '1' WHEN anchor_word_count <= 3 THEN '2-3' ELSE '4+' END, topic_family, CASE WHEN ends_with(source_document_id, 'index') THEN 'index' ELSE 'page' END) AS key FROM audit_items",
    "x18_leave_last_out": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
    "x19_seen_masked_recall": """WITH line AS (SELECT o_custkey AS u, l_partkey AS item, (l_shipdate, l_orderkey, l_linenumber, l_partkey) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey), last AS (SELECT u, arg_max(item, o) AS item FROM line GROUP BY u),
pop AS (SELECT item, count(*) AS n FROM line GROUP BY item), seen AS (SELECT DISTINCT u, item FROM line),
off AS (SELECT l.u, p.item, row_number() OVER (PARTITION BY l.u ORDER BY n DESC, p.item) AS rank FROM last l, pop p WHERE p.item = l.item OR NOT EXISTS (SELECT 1 FROM seen s WHERE s.u = l.u AND s.item = p.item)),
r AS (SELECT l.u, min(rank) AS rank FROM last l LEFT JOIN off o ON o.u = l.u AND o.item = l.item AND rank <= 10 GROUP BY l.u)
SELECT round(avg((rank IS NOT NULL)::INT), 9) AS recall_at_10, round(avg(coalesce(1 / rank, 0)), 9) AS mrr, count(*) AS queries FROM r""",
    "x22_class_sample": "SELECT label, least(count(*), 20) AS n FROM embeddings GROUP BY label",
    "x23_row_share": "SELECT vec_id, unnest(range(len(embedding)))::INT AS i, unnest(list_transform(embedding, lambda x: round(abs(x::DOUBLE) / greatest(list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE))), 1), 9))) AS x FROM embeddings",
    "x26_taxonomy_view": "SELECT category, count(*) AS n FROM documents WHERE contains(lower(category), 'm') GROUP BY category",
}
