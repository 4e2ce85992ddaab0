"""Queries of sources, regions, units, anchors, spans, inline proposals, sinks and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weaveline.functions import text as X
from weaveline.functions import vectors as V
from weaveline.operators import anchors as A
from weaveline.operators import chunking as K
from weaveline.operators import inline as I
from weaveline.operators import regions as R
from weaveline.operators import spans as S
from weaveline.plans import corpus as C
from weaveline.plans import graphs
from weaveline.plans.tables import table
from weaveline.scratch import materialize, spread
from weaveline.sources import scan, sinks
from weaveline.streaming import incremental as W


def _links(spark, sf):
    r = spread(table(spark, sf, "relationships").filter("kind = 'explicit-link'").select("rel_id", "source_id", "target_id", "anchor_text"), "rel_id")
    return r.select(C.clean_reference(F.col("source_id")).alias("source"), C.clean_reference(F.col("target_id")).alias("target"), "anchor_text", "rel_id").filter("source is not null and target is not null")


def _aliases(spark, sf):
    return C.links(spark, sf).filter("kind = 'alias'").select(F.col("target").alias("id"), X.humanize(F.col("source")).alias("alias"))


def _link_spans(spark, sf):
    return table(spark, sf, "relationships").filter("span_start is not null and span_end > span_start and source_id is not null").select(F.col("rel_id").alias("span_id"), F.col("source_id").alias("doc"), F.col("span_start").alias("start"), F.col("span_end").alias("end"))


def _chunks(spark, sf):
    c = table(spark, sf, "search_chunks").filter("file_path is not null and start_char is not null and end_char is not null")
    return c.select(F.regexp_replace("file_path", r"\.md$", "").alias("doc"), F.col("start_char").alias("start"), F.col("end_char").alias("end"), F.coalesce("heading", F.lit("")).alias("kind"))


def _counts(spark, sf):
    return materialize(A.anchor_counts(_links(spark, sf), C.docs(spark, sf), _aliases(spark, sf)), "anchor-counts")


def _phrases(spark, sf, counts):
    return materialize(A.keyphraseness(counts, A.occurrences(C.docs(spark, sf), "content", counts.select("mention"))), "phrases")


# sources ------------------------------------------------------------------

def s2_glob_filter(spark, sf):
    c = table(spark, sf, "search_chunks").filter("file_path is not null")
    return c.filter(scan.matches(F.col("file_path"), ("**/*.md",), ("systems/**", "ml/*/a*.md"))).groupBy("file_path").agg(F.count("*").alias("n"))


def s4_document_ids(spark, sf):
    return table(spark, sf, "search_chunks").select(F.regexp_replace("file_path", r"\.md$", "").alias("id")).distinct()


def s5_front_matter(spark, sf):
    r = R.region_table(table(spark, sf, "documents"), "doc_id", "text")
    return r.filter("kind = 'metadata'").select("doc", "end", F.length("text").alias("size"))


def s6_titles(spark, sf):
    """Title of the front matter, else the first top heading, else none; counted by where it came from."""
    from pyspark.sql.types import StringType

    from weaveline.operators import markdown as M

    heading = F.pandas_udf(lambda s: s.map(M.first_heading, na_action="ignore"), StringType())
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract(F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1), r"(?m)^title: *(.+?)\s*$", 1).alias("fm"), heading(F.col("text")).alias("h1"))
    return d.select("doc_id", F.coalesce(F.when(F.col("fm") != "", F.col("fm")), "h1", F.lit("untitled")).alias("title"))


def s8_flags(spark, sf):
    d = table(spark, sf, "source_documents")
    return d.select("doc_key", F.coalesce("is_archived", F.lit(False)).alias("archived"), F.lower(F.substring("content", 1, 500)).contains("<!-- generated -->").alias("marked"))


def s9_revisions(spark, sf):
    return table(spark, sf, "source_documents").select("doc_key", F.sha2(F.col("content").cast("binary"), 256).alias("revision"))


def s11_links(spark, sf):
    return R.link_table(table(spark, sf, "documents"), "doc_id", "text").groupBy("doc", "style").agg(F.count("*").alias("n"))


def s12_resolved_links(spark, sf):
    d = table(spark, sf, "documents").select(F.concat_ws("/", F.coalesce("category", F.lit("pages")), F.col("doc_id").cast("string")).alias("id"), "text")
    known = table(spark, sf, "source_documents").select("id").union(d.select("id"))
    return R.resolved_links(R.link_table(d, "id", "text"), known).groupBy("doc", "kind").agg(F.count("*").alias("n"))


def s21_content_index(spark, sf):
    """An index entry a document: links and tags as arrays, made and exploded."""
    links = C.links(spark, sf).groupBy(F.col("source").alias("slug")).agg(F.array_sort(F.collect_set("target")).alias("links"))
    return links.select("slug", F.posexplode("links").alias("i", "target")).select("slug", "target")


def s25_changed(spark, sf):
    d = table(spark, sf, "source_documents").filter("id is not null").select("id", "revision", "arrived_at")
    cut = F.to_timestamp(F.lit("2025-06-01"))
    return scan.changed(d.filter(F.col("arrived_at") >= cut), d.filter(F.col("arrived_at") < cut)).select("id", "revision").distinct()


# regions and units --------------------------------------------------------

def r3_regions(spark, sf):
    return R.region_table(table(spark, sf, "documents"), "doc_id", "text").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def r7_eligible(spark, sf):
    return R.eligible(table(spark, sf, "source_documents")).select("doc_key")


def r8_empty_bodies(spark, sf):
    return table(spark, sf, "source_documents").filter(X.strip_space(F.coalesce("content", F.lit(""))) == "").select("doc_key")


def r12_publication(spark, sf):
    from pyspark.sql.types import StringType

    from weaveline.operators import markdown as M

    strip = F.pandas_udf(lambda s: s.map(M.without_repeated_title, na_action="ignore"), StringType())
    d = table(spark, sf, "source_documents").filter(~F.coalesce("is_archived", F.lit(False)))
    return d.select("doc_key", F.length(strip(F.col("content"))).alias("n_chars"))


def _regions(spark, sf):
    return materialize(R.region_table(C.docs(spark, sf), "id", "content"), "regions")


def _titles(spark, sf):
    return C.docs(spark, sf).select(F.col("id").alias("doc"), "title")


def c4_section_units(spark, sf):
    return K.section_units(_regions(spark, sf), _titles(spark, sf)).select("unit", "doc", "ordinal", "token_count", F.size("spans").alias("n_spans"))


def c9_document_view(spark, sf):
    return K.document_view(_regions(spark, sf), _titles(spark, sf)).select("doc", "token_count", F.sha2("text", 256).alias("digest"))


def c11_views(spark, sf):
    """Digest and tokens of the units of all three views, by the order in which vectors are written."""
    v = K.unit_views(["section", "document", "title"], _regions(spark, sf), _titles(spark, sf)).withColumn("unit", F.concat_ws("#", "doc", "view", F.col("ordinal").cast("string")))
    return K.in_unit_order(v).select("doc", "view", "ordinal", "token_count", F.sha2("text", 256).alias("digest"))


def c10_title_view(spark, sf):
    aliases = _aliases(spark, sf).groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    d = C.docs(spark, sf).join(aliases, "id", "left")
    return d.select("id", K.title_view(F.col("title"), F.col("aliases"), F.lit(None).cast("string")).alias("view")).filter("view is not null")


def c13_word_windows(spark, sf):
    c = spread(table(spark, sf, "search_chunks").filter("text is not null").select("chunk_id", "text"), "chunk_id")
    return c.select("chunk_id", F.posexplode(K.word_windows(F.col("text"), 100, 20)).alias("i", "window")).select("chunk_id", "i", F.sha2("window", 256).alias("digest"))


def c14_header_segments(spark, sf):
    return K.header_segments(table(spark, sf, "source_documents"), "doc_key", "content").groupBy("doc").agg(F.max("section").alias("last_section"), F.count("*").alias("paragraphs"))


def y4_token_accounting(spark, sf):
    c = table(spark, sf, "search_chunks").filter("text is not null").select(X.token_count(F.col("text")).alias("n"))
    return c.agg(F.count("*").alias("units"), F.sum("n").cast("long").alias("tokens"), F.sum((F.col("n") > 250).cast("long")).alias("truncated"))


def y5_vector_references(spark, sf):
    return table(spark, sf, "search_chunks").filter("id is not null").select("chunk_id", sinks.vector_reference(F.regexp_replace("id", "::", "#")).alias("r")).select("chunk_id", F.col("r.key").alias("key"), F.col("r.row").alias("row"))


def y6_vector_subset(spark, sf):
    wanted = table(spark, sf, "search_chunks").filter("heading_level = 1").select("chunk_id")
    return table(spark, sf, "chunk_vectors").join(wanted, "chunk_id", "left_semi").select("id", "chunk_id")


def y19_previews(spark, sf):
    return table(spark, sf, "search_chunks").filter("text is not null").select("chunk_id", F.substring("text", 1, 200).alias("preview"))


def e9_token_states(spark, sf):
    """Span representations of link anchors: the first of the numbers of each."""
    from pyspark.sql.types import DoubleType

    rep = F.pandas_udf(lambda s: s.map(lambda t: float(V.span_representation(t, 0, len(t))[0]), na_action="ignore"), DoubleType())
    return table(spark, sf, "relationships").filter("anchor_text is not null").select("anchor_text").distinct().select("anchor_text", F.round(rep(F.col("anchor_text")), 9).alias("first"))


# anchors and spans --------------------------------------------------------

def i2_anchor_counts(spark, sf):
    return _counts(spark, sf)


def i3_commonness(spark, sf):
    return A.commonness(_counts(spark, sf)).select("mention", "target", "cnt", F.round("commonness", 12).alias("commonness"))


def i6_occurrences(spark, sf):
    return A.occurrences(C.docs(spark, sf), "content", _counts(spark, sf).select("mention"))


def i4_keyphraseness(spark, sf):
    return _phrases(spark, sf, _counts(spark, sf)).select("mention", "linked", "occurrences", F.round("keyphraseness", 12).alias("keyphraseness"))


def i5_eligible(spark, sf):
    c = _counts(spark, sf)
    return A.eligible(c, _phrases(spark, sf, c)).select("mention", "is_title", "is_alias")


def i7_anchor_stats(spark, sf):
    c = _counts(spark, sf)
    return A.anchor_stats(c, _phrases(spark, sf, c)).select("stat", F.round("value", 9).alias("value"))


def j14_span_containers(spark, sf):
    return S.smallest_container(_link_spans(spark, sf), _chunks(spark, sf)).select("span_id", "kind")


def j15_free_spans(spark, sf):
    items = table(spark, sf, "audit_items").filter("span_start is not null").select(F.col("id").alias("item"), F.col("source_document_id").alias("doc"), F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return S.not_overlapping(items, _link_spans(spark, sf)).select("item")


def i10_span_recall(spark, sf):
    gold = table(spark, sf, "audit_items").filter("region_kind = 'prose' and span_start is not null").select(F.col("id").alias("item"), F.col("source_document_id").alias("doc"), F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    r = S.span_recall(gold, _link_spans(spark, sf))
    return r.select(F.round("exact_recall", 9).alias("exact_recall"), F.round("overlap_recall", 9).alias("overlap_recall"), "n_items")


def i12_edit_ratio(spark, sf):
    r = table(spark, sf, "relationships").filter("anchor_text is not null and raw_target is not null")
    return r.select("rel_id", F.round(X.edit_similarity(F.lower("anchor_text"), F.lower(X.humanize(F.col("raw_target")))), 9).alias("ratio"))


def _derived(spark, sf):
    """Score inputs that follow the rows of relationships."""
    r = table(spark, sf, "relationships").filter("anchor_text is not null")
    words = F.size(X.split_space(F.col("anchor_text")))
    f = lambda n, m: (F.pmod(F.col("rel_id") * n, F.lit(m)) / (m - 1.0))
    n = I.naturalness(f(7, 11) * 0.4, F.pmod("rel_id", F.lit(3)) == 0, words)
    t = I.target_score(f(5, 13), f(3, 17), f(11, 7), F.pmod("rel_id", F.lit(4)) + 1)
    p = I.placement(F.when(F.pmod("rel_id", F.lit(5)) > 0, 1.0).otherwise(0.0), f(13, 10))
    d = r.select("rel_id", F.col("source_id").alias("source"), n.alias("naturalness"), t.alias("target_score"), p.alias("placement"))
    return d.withColumn("score", I.geometric({c: F.col(c) for c in I.COMBINE}))


def i13_head_scores(spark, sf):
    return _derived(spark, sf).select("rel_id", *[F.round(c, 9).alias(c) for c in ("naturalness", "target_score", "placement")])


def i15_combined(spark, sf):
    return _derived(spark, sf).select("rel_id", F.round("score", 9).alias("score"))


def i16_partitioned(spark, sf):
    return I.partitioned(_derived(spark, sf), F.pmod("rel_id", F.lit(10)) == 0).select("rel_id", "reason", "suggest_better_anchor")


def i17_budgets(spark, sf):
    return C.docs(spark, sf).select("id", I.budget(F.size(X.split_space(F.col("content")))).alias("budget"))


def _dictionary(spark, sf, counts, common):
    phrases = _phrases(spark, sf, counts)
    per = common.groupBy("mention").agg(F.count("*").alias("n_targets"), F.max("commonness").alias("top_commonness"))
    return A.eligible(counts, phrases).join(phrases.select("mention", "linked"), "mention").join(per, "mention")


def _features(spark, sf, counts):
    """The proposed spans with their features."""
    dictionary = _dictionary(spark, sf, counts, A.commonness(counts))
    links = _link_spans(spark, sf).select("doc", "start", "end")
    return materialize(S.span_features(S.proposals(C.docs(spark, sf), "id", "content", materialize(dictionary, "dictionary"), links)), "span-features")


def _drafts(spark, sf):
    counts = _counts(spark, sf)
    common = A.commonness(counts)
    d = C.docs(spark, sf)
    features = _features(spark, sf, counts)
    titles = counts.filter("origin = 'title'").select("mention", "target")
    short = A.targets_of(features.filter("mention is not null").select(F.col("doc").alias("source"), "mention"), common, titles)
    return materialize(I.drafts(features, short, d.select("id", "title")), "drafts"), features


def i8_proposed_spans(spark, sf):
    return _features(spark, sf, _counts(spark, sf)).select("doc", "start", "end", "text", "kind")


def i9_span_features(spark, sf):
    return _features(spark, sf, _counts(spark, sf)).drop("mention", "text", "kind")


def i14_drafts(spark, sf):
    return _drafts(spark, sf)[0].select("source", "start", "end", "target", F.round("score", 9).alias("score"))


def inline_proposals(spark, sf):
    d = I.partitioned(_drafts(spark, sf)[0])
    budgets = C.docs(spark, sf).select(F.col("id").alias("source"), I.budget(F.size(X.split_space(F.col("content")))).alias("budget"))
    chosen = materialize(I.selected(d.filter("reason is null"), budgets), "selected")
    return I.presented(chosen, d.filter("reason is not null").select("source", "start", "end", "target", "score", "reason"))


def i18_selected(spark, sf):
    return inline_proposals(spark, sf).select("source", "start", "end", "target", F.round("score", 9).alias("score"), "reason", "rank")


def v6_three_way_split(spark, sf):
    """Link items split so that no document, anchor or target is on two sides."""
    from weaveline.operators.splits import three_way

    items = _links(spark, sf).filter("anchor_text is not null").select("rel_id", "source", F.lower(X.collapse_space(F.col("anchor_text"))).alias("anchor"), "target")
    return three_way(items, "rel_id", ["source", "anchor", "target"], 0.15, 0.15).groupBy("split").agg(F.count("*").alias("n"))


# sinks and windows --------------------------------------------------------

def k1_json_lines(spark, sf):
    r = table(spark, sf, "relationships").select("rel_id", "kind", "directed")
    return sinks.json_lines(r, ["rel_id"])


def k9_upsert(spark, sf):
    c = table(spark, sf, "search_chunks").select("id", "chunk_id", "token_count")
    return sinks.upserted(c.filter("chunk_id % 2 = 0"), c.filter("chunk_id % 2 = 1"), "id", "chunk_id")


def k11_export(spark, sf):
    u = C.units(spark, sf)
    return u.join(table(spark, sf, "search_chunks").select("chunk_id", "start_char", "end_char"), "chunk_id").select("unit", "doc", "view", "start_char", "end_char", F.size("v").alias("dims"))


def a14_dedupe_latest(spark, sf):
    e = table(spark, sf, "events")
    return W.latest_by(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def w1_tumbling(spark, sf):
    return W.tumbling(table(spark, sf, "events"), "ts", "1 hour", ["event_type"], "value").select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


def w2_sliding(spark, sf):
    return W.sliding(table(spark, sf, "events"), "ts", "1 hour", "20 minutes", ["event_type"], "value").select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


def w3_sessions(spark, sf):
    return W.sessions(table(spark, sf, "events"), "ts", "2 hours", "user_id")


QUERIES = {f.__name__: f for f in (s2_glob_filter, s4_document_ids, s5_front_matter, s6_titles, s8_flags, s9_revisions, s11_links, s12_resolved_links, s21_content_index, s25_changed, r3_regions, r7_eligible, r8_empty_bodies, r12_publication, c4_section_units,
                                   c9_document_view, c10_title_view, c11_views, c13_word_windows, c14_header_segments, y4_token_accounting, y5_vector_references, y6_vector_subset, y19_previews, e9_token_states, i2_anchor_counts, i3_commonness, i4_keyphraseness, i5_eligible,
                                   i6_occurrences, i7_anchor_stats, j14_span_containers, j15_free_spans, i10_span_recall, i12_edit_ratio, i13_head_scores, i15_combined, i16_partitioned, i17_budgets, i8_proposed_spans, i9_span_features, i14_drafts, i18_selected, v6_three_way_split,
                                   k1_json_lines, k9_upsert, k11_export, a14_dedupe_latest, w1_tumbling, w2_sliding, w3_sessions)}

_SP = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
_KEY = lambda c: rf"nullif(lower(regexp_replace(trim(regexp_replace({c}, '{_SP}+', ' ', 'g')), '^({_SP}|\p{{P}})+|({_SP}|\p{{P}})+$', '', 'g')), '')"
COUNTS = f"""
lk AS (SELECT {C._CLEAN.format('source_id')} AS source, {C._CLEAN.format('target_id')} AS target, anchor_text FROM relationships WHERE kind = 'explicit-link'),
al AS (SELECT DISTINCT target AS id, {_KEY("replace(string_split(source, '/')[-1], '-', ' ')")} AS mention FROM links WHERE kind = 'alias'),
allm AS (SELECT {_KEY('anchor_text')} AS mention, target, 'linked' AS origin FROM lk WHERE source IN (SELECT id FROM docs) AND target IN (SELECT id FROM docs)
  UNION ALL SELECT {_KEY('title')}, id, 'title' FROM docs UNION ALL SELECT mention, id, 'alias' FROM al),
counts AS MATERIALIZED (SELECT mention, target, origin, count(*) AS cnt FROM allm WHERE mention IS NOT NULL AND length(mention) >= 3 AND len(string_split(mention, ' ')) <= 5 GROUP BY ALL)"""
_PIECES = lambda c: rf"regexp_extract_all(lower(trim(regexp_replace({c}, '{_SP}+', ' ', 'g'))), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]')"
OCC = f"""
ms AS MATERIALIZED (SELECT DISTINCT mention, len({_PIECES('mention')}) AS width FROM counts),
dp AS MATERIALIZED (SELECT {_PIECES('content')} AS p FROM docs WHERE content IS NOT NULL),
runs AS (SELECT array_to_string(p[i:i + width - 1], '') AS run FROM dp, (SELECT DISTINCT width FROM ms) w, unnest(range(1, len(p) - width + 2)) t(i)),
rc AS (SELECT run, count(*) AS n FROM runs GROUP BY run),
occ AS MATERIALIZED (SELECT mention, coalesce(n, 0) AS occurrences FROM ms LEFT JOIN rc ON run = mention),
phr AS MATERIALIZED (SELECT mention, linked, occurrences, CASE WHEN occurrences > 0 THEN least(1.0, linked / occurrences) ELSE 0.0 END::DOUBLE AS keyphraseness
  FROM (SELECT mention, sum(CASE WHEN origin = 'linked' THEN cnt ELSE 0 END)::BIGINT AS linked FROM counts GROUP BY mention) JOIN occ USING (mention))"""
_CNT = graphs.recursive(C.DOCS, C.LINKS, COUNTS)
_OCC = graphs.recursive(C.DOCS, C.LINKS, COUNTS, OCC)
SPANS = "ls AS (SELECT rel_id AS span_id, source_id AS doc, span_start AS s, span_end AS e FROM relationships WHERE span_start IS NOT NULL AND span_end > span_start AND source_id IS NOT NULL)"
_CLAMP = lambda x: f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"
_F = lambda n, m: f"((rel_id * {n}) % {m} / {m - 1}.0::DOUBLE)"
_NW = rf"len(list_filter(regexp_split_to_array(anchor_text, '{_SP}+'), lambda w: w <> ''))"
DERIVED = f"""
d0 AS (SELECT rel_id, source_id AS source,
  {_CLAMP(f"(0.7::DOUBLE * {_CLAMP(_F(7, 11) + ' * 0.4::DOUBLE / 0.3::DOUBLE')} + 0.3::DOUBLE * (rel_id % 3 = 0)::INT) * CASE WHEN {_NW} < 2 THEN 0.7::DOUBLE WHEN {_NW} <= 3 THEN 1.0::DOUBLE ELSE greatest(0.3::DOUBLE, 1 - 0.15::DOUBLE * ({_NW} - 3)) END")} AS naturalness,
  {_CLAMP(f"(0.4::DOUBLE * {_F(5, 13)} + 0.35::DOUBLE * {_F(3, 17)} + 0.25::DOUBLE * {_F(11, 7)}) / (1 + ln((rel_id % 4 + 1)::DOUBLE))")} AS target_score,
  {_CLAMP(f"greatest((rel_id % 5 > 0)::INT * (1 - 0.25::DOUBLE * {_F(13, 10)}), 0.05::DOUBLE)")} AS placement FROM relationships WHERE anchor_text IS NOT NULL),
d1 AS (SELECT *, CASE WHEN naturalness = 0 OR target_score = 0 OR placement = 0 THEN 0.0::DOUBLE ELSE exp(0.35::DOUBLE * ln(naturalness) + 0.45::DOUBLE * ln(target_score) + 0.2::DOUBLE * ln(placement)) END AS score FROM d0)"""

ORACLE = {
    "s5_front_matter": r"""WITH m AS (SELECT doc_id AS doc, regexp_extract(text, '(?s)\A---[ \t]*\r?\n(?:.*?\n)??(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)', 0) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc, length(x) AS "end", length(regexp_replace(regexp_extract(x, '(?s)\A---[ \t]*\r?\n(.*?)(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)\z', 1), '^\s+|\s+$', '', 'g')) AS size FROM m WHERE x <> ''""",
    "s2_glob_filter": "SELECT file_path, count(*) AS n FROM search_chunks WHERE ends_with(file_path, '.md') AND NOT starts_with(file_path, 'systems/') AND NOT regexp_matches(file_path, '^ml/[^/]*/a[^/]*\\.md$') GROUP BY file_path",
    "s4_document_ids": r"SELECT DISTINCT regexp_replace(file_path, '\.md$', '') AS id FROM search_chunks",
    "s8_flags": "SELECT doc_key, coalesce(is_archived, false) AS archived, contains(lower(substr(content, 1, 500)), '<!-- generated -->') AS marked FROM source_documents",
    "s9_revisions": "SELECT doc_key, sha256(content) AS revision FROM source_documents",
    "s21_content_index": graphs.recursive(C.LINKS) + "SELECT DISTINCT source AS slug, target FROM links",
    "s25_changed": "SELECT DISTINCT id, revision FROM source_documents d WHERE id IS NOT NULL AND arrived_at >= '2025-06-01'::TIMESTAMPTZ AND NOT EXISTS (SELECT 1 FROM source_documents o WHERE o.id = d.id AND o.revision = d.revision AND o.arrived_at < '2025-06-01'::TIMESTAMPTZ)",
    "r7_eligible": "SELECT doc_key FROM source_documents WHERE NOT coalesce(is_excluded, false) AND NOT coalesce(is_generated, false) AND NOT coalesce(is_archived, false)",
    "r8_empty_bodies": rf"SELECT doc_key FROM source_documents WHERE regexp_replace(coalesce(content, ''), '{_SP}+', '', 'g') = ''",
    "c10_title_view": graphs.recursive(C.DOCS, C.LINKS) + """, a AS (SELECT target AS id, list_sort(list_distinct(list(replace(string_split(source, '/')[-1], '-', ' ')))) AS al FROM links WHERE kind = 'alias' GROUP BY target),
v AS (SELECT docs.id, array_to_string(list_filter(list_concat([title], coalesce(al, [])), lambda x: x IS NOT NULL AND trim(x) <> ''), chr(10)) AS view FROM docs LEFT JOIN a USING (id)) SELECT * FROM v WHERE view <> ''""",
    "c13_word_windows": rf"""WITH w AS (SELECT chunk_id, list_filter(regexp_split_to_array(text, '{_SP}+'), lambda w: w <> '') AS w FROM search_chunks WHERE text IS NOT NULL),
s AS (SELECT chunk_id, w, len(w) AS n, list_filter(range(0, greatest(len(w), 1), 80), lambda s: s = 0 OR s + 20 < len(w)) AS st FROM w WHERE len(w) > 0),
o AS (SELECT chunk_id, list_concat(list_transform(st, lambda s: array_to_string(w[s + 1:s + 100], ' ')), CASE WHEN n > 20 THEN [array_to_string(w[n - 19:n], ' ')] ELSE [] END) AS ws FROM s)
SELECT chunk_id, (unnest(range(len(ws))))::INT AS i, sha256(unnest(ws)) AS digest FROM o""",
    "y4_token_accounting": rf"WITH t AS (SELECT len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}]')) AS n FROM search_chunks WHERE text IS NOT NULL) SELECT count(*) AS units, sum(n)::BIGINT AS tokens, sum((n > 250)::INT)::BIGINT AS truncated FROM t",
    "y5_vector_references": r"SELECT chunk_id, CASE WHEN regexp_matches(id, '^.+::[0-9]+$') THEN regexp_extract(id, '^(.+)::([0-9]+)$', 1) END AS key, CASE WHEN regexp_matches(id, '^.+::[0-9]+$') THEN regexp_extract(id, '^(.+)::([0-9]+)$', 2)::BIGINT END AS row FROM search_chunks WHERE id IS NOT NULL",
    "y6_vector_subset": "SELECT id, chunk_id FROM chunk_vectors WHERE chunk_id IN (SELECT chunk_id FROM search_chunks WHERE heading_level = 1)",
    "y19_previews": "SELECT chunk_id, substr(text, 1, 200) AS preview FROM search_chunks WHERE text IS NOT NULL",
    "i2_anchor_counts": _CNT + "SELECT mention, target, origin, cnt FROM counts",
    "i3_commonness": _CNT + "SELECT mention, target, sum(cnt)::BIGINT AS cnt, round(sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY mention), 12) AS commonness FROM counts GROUP BY mention, target",
    "i6_occurrences": _OCC + "SELECT mention, occurrences FROM occ",
    "i4_keyphraseness": _OCC + "SELECT mention, linked, occurrences, round(keyphraseness, 12) AS keyphraseness FROM phr",
    "i5_eligible": _OCC + "SELECT mention, bool_or(origin = 'title') AS is_title, bool_or(origin = 'alias') AS is_alias FROM counts JOIN phr USING (mention) GROUP BY mention HAVING bool_or(origin <> 'linked') OR any_value(keyphraseness) >= 0.065",
    "i7_anchor_stats": _OCC + """SELECT 'mentions' AS stat, count(DISTINCT mention)::DOUBLE AS value FROM counts UNION ALL SELECT o, coalesce(sum(cnt), 0)::DOUBLE FROM (VALUES ('linked'), ('title'), ('alias')) v(o) LEFT JOIN counts ON origin = o GROUP BY o
UNION ALL SELECT 'p' || (i * 10)::INT, round(q[i + 1], 9) FROM (SELECT quantile_cont(keyphraseness, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM phr), range(11) t(i)""",
    "j14_span_containers": f"""WITH {SPANS}, r AS (SELECT regexp_replace(file_path, '\\.md$', '') AS doc, start_char AS a, end_char AS b, coalesce(heading, '') AS kind FROM search_chunks WHERE file_path IS NOT NULL AND start_char IS NOT NULL AND end_char IS NOT NULL)
SELECT span_id, (SELECT kind FROM r WHERE r.doc = ls.doc AND a <= s AND e <= b ORDER BY b - a, a, kind LIMIT 1) AS kind FROM ls""",
    "j15_free_spans": f"WITH {SPANS} SELECT id AS item FROM audit_items i WHERE span_start IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ls WHERE doc = source_document_id AND s < i.span_end AND i.span_start < e)",
    "i10_span_recall": f"""WITH {SPANS}, g AS (SELECT id, span_start, span_end, EXISTS (SELECT 1 FROM ls WHERE doc = source_document_id AND s = span_start AND e = span_end) AS ex,
  EXISTS (SELECT 1 FROM ls WHERE doc = source_document_id AND span_end > span_start AND least(e, span_end) - greatest(s, span_start) >= 0.8 * (span_end - span_start)) AS ov FROM audit_items WHERE region_kind = 'prose' AND span_start IS NOT NULL)
SELECT round(coalesce(avg(ex::INT), 0), 9) AS exact_recall, round(coalesce(avg((ex OR ov)::INT), 0), 9) AS overlap_recall, count(*) AS n_items FROM g""",
    "i12_edit_ratio": "WITH p AS (SELECT rel_id, lower(anchor_text) AS a, lower(replace(string_split(raw_target, '/')[-1], '-', ' ')) AS b FROM relationships WHERE anchor_text IS NOT NULL AND raw_target IS NOT NULL) SELECT rel_id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END, 9) AS ratio FROM p",
    "i13_head_scores": f"WITH {DERIVED} SELECT rel_id, round(naturalness, 9) AS naturalness, round(target_score, 9) AS target_score, round(placement, 9) AS placement FROM d1",
    "i15_combined": f"WITH {DERIVED} SELECT rel_id, round(score, 9) AS score FROM d1",
    "i16_partitioned": f"""WITH {DERIVED}, r AS (SELECT *, CASE WHEN rel_id % 10 = 0 THEN 'abstained_upstream' WHEN score < 0.5 THEN 'below_accept_threshold' WHEN naturalness < 0.2 AND target_score < 0.7 THEN 'below_naturalness_floor' END AS reason FROM d1)
SELECT rel_id, reason, reason IS NULL AND naturalness < 0.2 AS suggest_better_anchor FROM r""",
    "i17_budgets": graphs.recursive(C.DOCS) + rf"SELECT id, least(10, greatest(1, len(list_filter(regexp_split_to_array(content, '{_SP}+'), lambda w: w <> '')) // 175))::INT AS budget FROM docs",
    "k1_json_lines": "SELECT '{' || CASE WHEN directed IS NULL THEN '' ELSE '\"directed\":' || directed || ',' END || CASE WHEN kind IS NULL THEN '' ELSE '\"kind\":\"' || kind || '\",' END || '\"rel_id\":' || rel_id || '}' AS line FROM relationships",
    "k9_upsert": "SELECT id, chunk_id, token_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chunk_id DESC) AS r FROM search_chunks) WHERE r = 1",
    "k11_export": graphs.recursive(C.UNITS) + "SELECT unit, doc, view, start_char, end_char, len(v) AS dims FROM units JOIN search_chunks USING (chunk_id)",
    "a14_dedupe_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "w1_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "w2_sliding": "SELECT time_bucket(INTERVAL 20 MINUTE, ts) - i * INTERVAL 20 MINUTE AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, range(3) t(i) GROUP BY 1, 2",
    "w3_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
}
