"""Queries of the text expressions and word statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weaveline.functions import text as X
from weaveline.operators import textstats as S
from weaveline.plans.tables import table
from weaveline.scratch import spread

QUERY_WORDS = ["the", "model", "register", "cache"]
STOPWORDS = "about after all and any are because before but can each for from has have her his into its may more not now our out she some such than that the their then there these they this under until was were what when where which while who will with without you your".split()


def docs(spark, sf):
    """The documents; one small file is spread over the cores, as words are taken out row by row."""
    return spread(table(spark, sf, "documents"), "doc_id")


def c1_token_counts(spark, sf):
    return docs(spark, sf).select("doc_id", X.token_count(F.col("text")).cast("long").alias("n_tokens"))


def f9_lexical_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.lexical_tokens(F.col("text"))).cast("long").alias("n_lexical"))


def _index(spark, sf):
    return S.inverted_index(docs(spark, sf), "doc_id", X.split_space(F.col("text")))


def x1_inverted_index(spark, sf):
    return _index(spark, sf)


def x2_tfidf(spark, sf):
    return S.tfidf(_index(spark, sf)).select("word", "doc", F.round("tf", 9).alias("tf"), F.round("idf", 9).alias("idf"), F.round("tfidf", 9).alias("tfidf"))


def j10_tfidf_search(spark, sf):
    return S.tfidf_search(S.tfidf(_index(spark, sf)), QUERY_WORDS).select("doc", F.round("score", 9).alias("score"))


def x3_vocabulary(spark, sf):
    return S.vocabulary(docs(spark, sf), "text")


def x4_cooccurrence(spark, sf):
    return S.cooccurrence(docs(spark, sf), "doc_id", "text", S.vocabulary(docs(spark, sf), "text"))


def x5_ppmi(spark, sf):
    return S.ppmi(x4_cooccurrence(spark, sf)).select("a", "b", "n", F.round("ppmi", 6).alias("ppmi"))


def x7_shared_words(spark, sf):
    index = S.inverted_index(docs(spark, sf), "doc_id", X.words(F.col("text")))
    return S.shared_word_links(index, top=100).select("word", F.col("df").cast("long").alias("df"), F.array_join(F.transform("docs", lambda d: d.cast("string")), ",").alias("docs"))


def x8_top_keywords(spark, sf):
    return S.top_keywords(S.tfidf(_index(spark, sf)))


def x9_lemma_distinct(spark, sf):
    return x8_top_keywords(spark, sf).select(F.regexp_replace(F.lower("word"), "(s|es|ed|ing)$", "").alias("stem")).filter("stem <> ''").distinct()


def x10_keyword_files(spark, sf):
    return S.keyword_index(x8_top_keywords(spark, sf)).select("word", F.col("n_docs").cast("long").alias("n_docs"), F.array_join(F.transform("docs", lambda d: d.cast("string")), ",").alias("docs"))


def x11_category_counts(spark, sf):
    return S.value_counts(docs(spark, sf), F.col("category"), "category").orderBy(F.desc("n"), "category").limit(20)


def x11_sparse_sources(spark, sf):
    return S.sparse_values(S.value_counts(docs(spark, sf), F.col("source"), "source"), 5)


def x12_tag_collisions(spark, sf):
    return S.spelling_collisions(docs(spark, sf), F.col("category"), X.tag_key(F.col("category"))).select("key", F.array_join("variants", "|").alias("variants"), "n")


def x13_untagged_mentions(spark, sf):
    d = table(spark, sf, "source_documents")
    listed = F.from_json("metadata", "tags array<string>")["tags"]
    tagged = d.select(F.col("doc_key").alias("doc"), F.explode(listed).alias("tag")).select("doc", X.tag_key(F.col("tag")).alias("tag")).distinct()
    return S.untagged_mentions(d, "doc_key", "content", tagged.select("tag").distinct(), tagged)


def x15_index_stats(spark, sf):
    return table(spark, sf, "search_chunks").agg(F.count("*").alias("n_chunks"), F.count_distinct("file_path").alias("n_files"), F.avg("token_count").alias("mean_tokens"))


def x15_top_files(spark, sf):
    return S.value_counts(table(spark, sf, "search_chunks"), F.col("file_path"), "file_path").orderBy(F.desc("n"), "file_path").limit(10)


def x16_edit_similarity(spark, sf):
    p = table(spark, sf, "part").select("p_name").distinct()
    q = p.select(F.col("p_name").alias("b"), F.substring_index("p_name", " ", 1).alias("w"))
    return p.select(F.col("p_name").alias("a"), F.substring_index("p_name", " ", 1).alias("w")).join(q, "w").select("a", "b", F.round(X.edit_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


def j11_fuzzy_merge(spark, sf):
    return S.fuzzy_pairs(table(spark, sf, "part"), "p_name", 0.8).select("a", "b", F.round("similarity", 9).alias("similarity"))


def x17_apply_merge(spark, sf):
    """Each string of a fuzzy pair is renamed to the pair's smallest partner; others stay."""
    merge = S.fuzzy_pairs(table(spark, sf, "part"), "p_name", 0.8).groupBy("b").agg(F.min("a").alias("to"))
    return table(spark, sf, "part").join(merge, F.col("p_name") == F.col("b"), "left").groupBy(F.coalesce("to", "p_name").alias("name")).agg(F.count("*").alias("n"))


def r1_canonical(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(X.strip_line_tails(X.line_ends(F.col("text"))), 256).alias("digest"))


def r1_canonical_nfc(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(X.canonical(F.col("text")), 256).alias("digest"))


def r9_strip_markdown(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(X.strip_markdown(F.col("text")), 256).alias("digest"))


def r10_plain_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.plain_words(F.col("text"), STOPWORDS)).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def r13_non_ascii(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.non_ascii(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def i1_mention_keys(spark, sf):
    return table(spark, sf, "relationships").select(X.mention_key(F.col("anchor_text")).alias("mention")).groupBy("mention").agg(F.count("*").alias("n"))


def g7_slugs(spark, sf):
    return table(spark, sf, "relationships").select(X.slug_key(F.col("raw_target")).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


def x6_metadata_index(spark, sf):
    d = table(spark, sf, "source_documents")
    tags = F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>")
    return S.metadata_index(d.select("title", F.get_json_object("metadata", "$.category").alias("category"), tags.alias("tags"), "source_ref"), "title", "category", "tags", "source_ref")


def k5_escaped_titles(spark, sf):
    return docs(spark, sf).filter("title is not null").select("doc_id", X.escape_markdown(F.col("title")).alias("escaped"))


def s13_humanized(spark, sf):
    return table(spark, sf, "relationships").filter("raw_target is not null").select(X.humanize(F.col("raw_target")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def x14_rule_validation(spark, sf):
    """Documents against rules: title, category and body present, no second top heading in the body, fences balanced."""
    t = F.col("text")
    heads = F.size(F.filter(F.split(F.regexp_replace(X.line_ends(t), r"(?s)```.*?(```|$)", ""), "\n"), lambda x: x.startswith("# ")))
    rules = {
        "missing title": F.coalesce(X.strip_space(F.col("title")), F.lit("")) == "",
        "missing category": F.coalesce(X.strip_space(F.col("category")), F.lit("")) == "",
        "empty body": F.coalesce(X.strip_space(t), F.lit("")) == "",
        "several top headings": heads > 1,
        "unbalanced fence": F.regexp_count(t, F.lit("```")) % 2 == 1,
        "updated after ingestion": F.col("updated_at") > F.col("ingested_at"),
    }
    errors = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return docs(spark, sf).select("doc_id", F.explode(errors).alias("error"))


QUERIES = {f.__name__: f for f in (
    c1_token_counts, f9_lexical_tokens, x1_inverted_index, x2_tfidf, j10_tfidf_search, x3_vocabulary, x4_cooccurrence, x5_ppmi, x7_shared_words, x8_top_keywords, x9_lemma_distinct,
    x10_keyword_files, x11_category_counts, x11_sparse_sources, x12_tag_collisions, x13_untagged_mentions, x14_rule_validation, x15_index_stats, x15_top_files, x16_edit_similarity, x17_apply_merge,
    j11_fuzzy_merge, r1_canonical, r1_canonical_nfc, r9_strip_markdown, r10_plain_words, r13_non_ascii, i1_mention_keys, g7_slugs, x6_metadata_index, k5_escaped_titles, s13_humanized)}

_SP = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
_W = r"[\p{L}\p{N}_]+"
_PIECES = rf"list_filter(regexp_split_to_array(text, '{_SP}+'), lambda w: w <> '')"
_INDEX = f"""
posts AS (SELECT doc_id AS doc, unnest({_PIECES}) AS word FROM documents),
idx AS (SELECT word, doc, count(*) AS n FROM posts GROUP BY ALL)"""
_TFIDF = _INDEX + """,
lens AS (SELECT doc, sum(n) AS len FROM idx GROUP BY doc),
idfs AS (SELECT word, ln((SELECT count(*) FROM lens) / count(*)) AS idf FROM idx GROUP BY word),
w AS (SELECT word, doc, n / len AS tf, idf, n / len * idf AS tfidf FROM idx JOIN lens USING (doc) JOIN idfs USING (word))"""
_TOP = _TFIDF + """,
top AS (SELECT doc, word, rank FROM (SELECT doc, word, row_number() OVER (PARTITION BY doc ORDER BY round(tfidf, 12) DESC, word) AS rank FROM w) WHERE rank <= 5)"""
_VOCAB = f"""
placed AS (SELECT doc_id AS doc, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents)),
vocab AS (SELECT word, count(*) AS n FROM placed WHERE length(word) >= 3 GROUP BY word ORDER BY n DESC, word LIMIT 10000)"""
_COOC = _VOCAB + """,
kept AS (SELECT doc, word, row_number() OVER (PARTITION BY doc ORDER BY pos) AS p FROM placed JOIN vocab USING (word)),
cooc AS (SELECT a.word AS a, b.word AS b, count(*) AS n FROM kept a JOIN kept b ON a.doc = b.doc AND b.p BETWEEN a.p - 20 AND a.p + 20 AND a.p <> b.p GROUP BY ALL)"""
_SIM = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END"
_FUZZY = f"""
names AS (SELECT DISTINCT p_name FROM part),
fuzzy AS (SELECT a, b, {_SIM} AS similarity FROM (SELECT x.p_name AS a, y.p_name AS b FROM names x JOIN names y ON x.p_name < y.p_name) WHERE {_SIM} >= 0.8)"""

_TAGKEY = rf"trim(regexp_replace(replace(lower(category), '-', ' '), '{_SP}+', ' ', 'g'))"
_MENTION = rf"nullif(lower(regexp_replace(trim(regexp_replace(anchor_text, '{_SP}+', ' ', 'g')), '^({_SP}|\p{{P}})+|({_SP}|\p{{P}})+$', '', 'g')), '')"
_STRIP = lambda c: rf"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"

ORACLE = {
    "x6_metadata_index": r"""WITH p AS (SELECT trim(title) AS title, lower(trim(metadata::JSON ->> '$.category')) AS category, list_transform(CAST(metadata::JSON -> '$.tags' AS VARCHAR[]), lambda t: lower(trim(t))) AS tags, regexp_extract_all(lower(source_ref), '[\p{L}\p{N}_]+') AS words FROM source_documents WHERE trim(title) <> '')
SELECT DISTINCT kind, value, title FROM (SELECT 'title' AS kind, title AS value, title FROM p UNION ALL SELECT 'category', category, title FROM p UNION ALL SELECT 'tag', unnest(tags), title FROM p UNION ALL SELECT 'description', unnest(words), title FROM p) WHERE value IS NOT NULL AND value <> ''""",
    "c1_token_counts": rf"SELECT doc_id, len(regexp_extract_all(text, '{_W}|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}]')) AS n_tokens FROM documents",
    "f9_lexical_tokens": "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS n_lexical FROM documents",
    "x1_inverted_index": "WITH " + _INDEX + " SELECT word, doc, n FROM idx",
    "x2_tfidf": "WITH " + _TFIDF + " SELECT word, doc, round(tf, 9) AS tf, round(idf, 9) AS idf, round(tfidf, 9) AS tfidf FROM w",
    "j10_tfidf_search": "WITH " + _TFIDF + f" SELECT doc, round(sum(tfidf * idf), 9) AS score FROM w WHERE word IN {tuple(QUERY_WORDS)} GROUP BY doc ORDER BY round(sum(tfidf * idf), 12) DESC, doc LIMIT 10",
    "x3_vocabulary": "WITH " + _VOCAB + " SELECT word, n FROM vocab",
    "x4_cooccurrence": "WITH " + _COOC + " SELECT a, b, n FROM cooc",
    "x5_ppmi": "WITH " + _COOC + """, margin AS (SELECT a, sum(n) AS m FROM cooc GROUP BY a)
SELECT * FROM (SELECT c.a, c.b, n, round(greatest(0, log2(n * (SELECT sum(n) FROM cooc) / ((x.m + 1e-10) * (y.m + 1e-10)))), 6) AS ppmi
FROM cooc c JOIN margin x ON x.a = c.a JOIN margin y ON y.a = c.b
WHERE n * (SELECT sum(n) FROM cooc) / ((x.m + 1e-10) * (y.m + 1e-10)) > 1)""",
    "x7_shared_words": f"""WITH posts AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(lower(text), '{_W}')) AS word FROM documents),
df AS (SELECT word, count(*) AS df, list(doc ORDER BY doc) AS docs FROM posts GROUP BY word)
SELECT word, df, array_to_string(docs, ',') AS docs FROM df WHERE df >= 2 AND df <= greatest(2, 0.02 * (SELECT count(DISTINCT doc) FROM posts)) ORDER BY df DESC, word LIMIT 100""",
    "x8_top_keywords": "WITH " + _TOP + " SELECT doc, word, rank FROM top",
    "x9_lemma_distinct": "WITH " + _TOP + " SELECT DISTINCT regexp_replace(lower(word), '(s|es|ed|ing)$', '') AS stem FROM top WHERE regexp_replace(lower(word), '(s|es|ed|ing)$', '') <> ''",
    "x10_keyword_files": "WITH " + _TOP + " SELECT word, count(*) AS n_docs, string_agg(doc, ',' ORDER BY doc) AS docs FROM top GROUP BY word",
    "x11_category_counts": "SELECT category, count(*) AS n FROM documents WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category LIMIT 20",
    "x11_sparse_sources": "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) < 5",
    "x12_tag_collisions": f"SELECT {_TAGKEY} AS key, string_agg(DISTINCT category, '|' ORDER BY category) AS variants, count(*) AS n FROM documents WHERE category IS NOT NULL GROUP BY 1 HAVING count(DISTINCT category) > 1",
    "x13_untagged_mentions": rf"""WITH t AS (SELECT doc_key AS doc, trim(regexp_replace(replace(lower(unnest(from_json(metadata, '{{"tags": ["VARCHAR"]}}').tags)), '-', ' '), '{_SP}+', ' ', 'g')) AS tag FROM source_documents WHERE metadata IS NOT NULL AND json_valid(metadata)),
d AS (SELECT doc_key AS doc, ' ' || array_to_string(regexp_extract_all(lower(content), '{_W}'), ' ') || ' ' AS body FROM source_documents),
tags AS (SELECT DISTINCT tag, ' ' || array_to_string(regexp_extract_all(tag, '{_W}'), ' ') || ' ' AS run FROM t)
SELECT DISTINCT d.doc, g.tag FROM d JOIN tags g ON contains(d.body, g.run) WHERE trim(g.run) <> '' AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc = d.doc AND t.tag = g.tag)""",
    "x14_rule_validation": rf"""WITH d AS (SELECT *, coalesce({_STRIP('title')}, '') = '' AS e1, coalesce({_STRIP('category')}, '') = '' AS e2, coalesce({_STRIP('text')}, '') = '' AS e3,
  len(list_filter(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '```.*?(```|$)', '', 'gs'), chr(10)), lambda x: starts_with(x, '# '))) > 1 AS e4,
  len(regexp_extract_all(text, '```')) % 2 = 1 AS e5, updated_at > ingested_at AS e6 FROM documents)
SELECT doc_id, unnest(list_filter([CASE WHEN e1 THEN 'missing title' END, CASE WHEN e2 THEN 'missing category' END, CASE WHEN e3 THEN 'empty body' END, CASE WHEN e4 THEN 'several top headings' END,
  CASE WHEN e5 THEN 'unbalanced fence' END, CASE WHEN e6 THEN 'updated after ingestion' END], lambda x: x IS NOT NULL)) AS error FROM d""",
    "x15_index_stats": "SELECT count(*) AS n_chunks, count(DISTINCT file_path) AS n_files, avg(token_count) AS mean_tokens FROM search_chunks",
    "x15_top_files": "SELECT file_path, count(*) AS n FROM search_chunks WHERE file_path IS NOT NULL GROUP BY file_path ORDER BY n DESC, file_path LIMIT 10",
    "x16_edit_similarity": f"WITH p AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS w FROM part), q AS (SELECT x.p_name AS a, y.p_name AS b FROM p x JOIN p y USING (w)) SELECT a, b, round({_SIM}, 9) AS similarity FROM q",
    "j11_fuzzy_merge": "WITH " + _FUZZY + " SELECT a, b, round(similarity, 9) AS similarity FROM fuzzy",
    "x17_apply_merge": "WITH " + _FUZZY + ", m AS (SELECT b, min(a) AS t FROM fuzzy GROUP BY b) SELECT coalesce(t, p_name) AS name, count(*) AS n FROM part LEFT JOIN m ON p_name = b GROUP BY 1",
    "r1_canonical": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g')) AS digest FROM documents",
    "r1_canonical_nfc": r"SELECT doc_id, sha256(nfc_normalize(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'))) AS digest FROM documents",
    "r9_strip_markdown": rf"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```.*?```', '', 'gs'), '`([^`]+)`', '\1', 'g'),
  '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^{_SP}+|{_SP}+$', '', 'g')) AS digest FROM documents""",
    "r10_plain_words": rf"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[\p{{P}}\p{{S}}0-9]', '', 'g'), '{_SP}+')) AS word FROM documents)
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM p WHERE length(word) > 2 AND word NOT IN {tuple(STOPWORDS)} GROUP BY word""",
    "r13_non_ascii": r"WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM documents) SELECT ch, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM p GROUP BY ch",
    "i1_mention_keys": f"SELECT {_MENTION} AS mention, count(*) AS n FROM relationships GROUP BY 1",
    "g7_slugs": rf"SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STRIP('raw_target')}, '[#?].*$', ''), '\.md$', ''), '^/+|/+$', '', 'g'), '(^|/)index$', '') AS slug, count(*) AS n FROM relationships GROUP BY 1",
    "k5_escaped_titles": r"SELECT doc_id, regexp_replace(title, '([\\`*_\[\]#<>{}|])', '\\\1', 'g') AS escaped FROM documents WHERE title IS NOT NULL",
    "s13_humanized": "SELECT replace(string_split(raw_target, '/')[-1], '-', ' ') AS label, count(*) AS n FROM relationships WHERE raw_target IS NOT NULL GROUP BY 1",
}
