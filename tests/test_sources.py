import json
import time

import pytest
from pyspark.sql import functions as F

from weaveline.operators import chunking as K
from weaveline.operators import markdown as M
from weaveline.operators import regions as R
from weaveline.sources import scan, sinks
from weaveline.streaming import incremental as W

CORPUS = {
    "index.md": "---\ntitle: Start\ncategory: home\ntags: [a, b]\naliases: [Home]\n---\n# Start\n\nSee [[systems/consistency|strong reads]] and [[systems/dynamo#quorum]].\n\n- [[math/attention]]\n",
    "systems/consistency.md": "---\ntitle: Consistency\ntags: single\n---\n\nNext to [dynamo](dynamo.md) and [self](#here).\n\n> quoted\n\n```text\n[[not/a-link]]\n```\n\n$$\nx = 1\n$$\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n",
    "systems/dynamo.md": "# Dynamo\n\n[[nowhere]] [out](https://x.org) ![pic](p.png) [up](../index.md)\n\n1. one\n   more\n2. two\n",
    "plain.md": "no title here, [a](./systems/dynamo.md)\n",
    "unicode.md": "---\ntitle: Ü\n---\n𝑥𝑦 é [[index|da]]\n",
    "private.md": "---\nprivate: true\n---\n[[index]]\n",
    "drafts/wip.md": "---\ndraft: true\n---\nwip\n",
    "generated/auto.md": "<!-- Generated -->\nauto\n",
    "archive/old.md": "---\nstatus: archived\n---\nold\n",
    "templates/page.md": "---\ntitle: T\n---\n",
    "plain.txt": "not markdown",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in CORPUS.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(root)


def test_scan(spark, tree):
    rows = {r["id"]: r for r in scan.read_markdown(spark, tree, scan.MarkdownOptions.of(exclude=["templates/**"])).collect()}
    assert set(rows) == {n[:-3] for n in CORPUS if n.endswith(".md")} - {"templates/page"}
    assert {k: rows[k]["title"] for k in ("index", "systems/dynamo", "plain")} == {"index": "Start", "systems/dynamo": "Dynamo", "plain": "plain"}
    assert (rows["index"]["tags"], rows["systems/consistency"]["tags"], rows["index"]["aliases"]) == (["a", "b"], ["single"], ["Home"])
    flags = {k: (r["is_excluded"], r["is_generated"], r["is_archived"]) for k, r in rows.items()}
    assert flags["private"][0] and flags["drafts/wip"][0] and flags["generated/auto"][1] and flags["archive/old"][2] and flags["index"] == (False, False, False)
    with pytest.raises(ValueError):
        scan.MarkdownOptions.of(colour="red")


def test_links_and_resolution(spark, tree):
    docs = scan.read_markdown(spark, tree)
    got = {(r["doc"], r["target"], r["resolved"], r["kind"]) for r in R.resolved_links(R.link_table(docs, "id", "content"), docs).collect()}
    e, u = "explicit-link", "unresolved-link"
    assert got == {
        ("index", "systems/consistency", "systems/consistency", e), ("index", "systems/dynamo", "systems/dynamo", e), ("index", "math/attention", None, u), ("systems/consistency", "dynamo.md", "systems/dynamo", e),
        ("systems/dynamo", "nowhere", None, u), ("systems/dynamo", "../index.md", "index", e), ("plain", "./systems/dynamo.md", "systems/dynamo", e), ("unicode", "index", "index", e), ("private", "index", "index", e),
    }
    link = next(r for r in R.link_table(docs, "id", "content").collect() if r["doc"] == "unicode")
    assert CORPUS["unicode.md"][link["start"] : link["end"]] == "[[index|da]]" and link["display"] == "da"


def test_regions(spark, tree):
    docs = scan.read_markdown(spark, tree)
    rows = R.region_table(docs, "id", "content").collect()
    kinds = lambda d: [r["kind"] for r in sorted((r for r in rows if r["doc"] == d), key=lambda r: r["ordinal"])]
    assert kinds("systems/consistency") == ["metadata", "prose", "quote", "code", "equation", "table"]
    assert kinds("index") == ["metadata", "boilerplate", "prose", "list"] and kinds("systems/dynamo") == ["heading", "prose", "list"]
    for r in rows:
        raw = CORPUS[r["doc"] + ".md"][r["start"] : r["end"]]
        assert raw.strip() and (r["kind"] != "code" or raw.startswith("```"))
    assert [r.text for r in M.plain_regions("a b\nc\n\n  d\n", "T")] == ["T", "a b\nc", "d"]
    assert M.regions("") == [] and [r.kind for r in M.regions("```\nopen")] == ["code"]


def test_front_matter_and_titles():
    assert M.front_matter("---\n: [\n---\nx")[2] == 12 and M.front_matter("---\n: [\n---\nx")[0] == {}
    assert M.front_matter("no")[2] == 0
    assert M.simple_mapping("a: 1\nb:\n  - x\n  - 'y'\nc: [p, q]") == {"a": "1", "b": ["x", "y"], "c": ["p", "q"]}
    assert M.first_heading("```\n# no\n```\n# yes #\n") == "yes"
    assert M.without_repeated_title("---\ntitle: T\n---\n# T\nbody") == "---\ntitle: T\n---\nbody"
    assert M.clean_inline("**a** _b_ `*c*` [[x/y-z]] [d](e)") == "a b `*c*` y z d"


def test_glob():
    import re

    hit = lambda g, p: re.match(scan.glob_pattern(g), p) is not None
    assert hit("**/*.md", "a.md") and hit("**/*.md", "x/y/a.md") and not hit("*.md", "x/a.md") and hit("x/**", "x/y/z") and hit("?.md", "a.md") and not hit("?.md", "ab.md")


def test_units(spark, tree):
    docs = scan.read_markdown(spark, tree)
    regions = R.region_table(docs, "id", "content")
    titles = docs.select(F.col("id").alias("doc"), "title")
    units = K.section_units(regions, titles, target=20, most=30, overlap=4).collect()
    assert len({u["unit"] for u in units}) == len(units) and all(u["token_count"] <= 30 for u in units)
    view = {r["doc"]: r for r in K.document_view(regions, titles, 12).collect()}
    assert view["index"]["text"].startswith("Start") and all(K.count_tokens(r["text"]) == r["token_count"] <= 12 for r in view.values())
    segments = K.header_segments(docs, "id", "content").filter("doc = 'systems/dynamo'").collect()
    assert {s["heading"] for s in segments} == {"Dynamo"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in scan.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception):
        scan.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "u.data").write_bytes("1\t2\tcaf\xe9\n".encode("latin-1"))
    assert scan.read_delimited(spark, str(tmp_path / "u.data"), "u int, i int, s string").first()["s"] == "café"
    (tmp_path / "c").write_text("p1 1 0 ml\np2 0 1 db\n")
    (tmp_path / "e").write_text("p1 p2\np1 p9\n")
    nodes, edges = scan.read_citations(spark, str(tmp_path / "c"), str(tmp_path / "e"))
    assert {(r["id"], tuple(r["words"]), r["label"]) for r in nodes.collect()} == {("p1", (1.0, 0.0), "ml"), ("p2", (0.0, 1.0), "db")} and [tuple(r) for r in edges.select("source", "target").collect()] == [("p2", "p1")]
    (tmp_path / "i.json").write_text(json.dumps({"x": {"title": "X", "links": ["y"], "tags": [], "content": "c"}}))
    assert scan.read_content_index(spark, str(tmp_path / "i.json")).first()["links"] == ["y"]


def test_config():
    known = {"preprocess": {"target_tokens": 200, "max_tokens": 250, "overlap_tokens": 30}, "ranking": {"diversity": 0.3}}
    assert scan.read_config("ranking:\n  diversity: 1\n", known)["ranking"]["diversity"] == 1
    for bad in ("what: {}", "ranking: {x: 1}", "preprocess: {target_tokens: 300}", "ranking: {diversity: high}"):
        with pytest.raises(ValueError):
            scan.read_config(bad, known)
    assert scan.load_plugin("collections:OrderedDict", "keys") == {}
    with pytest.raises(TypeError):
        scan.load_plugin("collections:OrderedDict", "rank")


def test_sinks(spark, tmp_path):
    store = sinks.ArtifactStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(1, [0.5, 0.25])], "unit long, v array<double>")
    for _ in range(2):
        assert store.through("vectors", ["c", 1], lambda: df).count() == 1
    assert (store.hits, store.misses) == (1, 1)
    with pytest.raises(ValueError):
        store.path("..", "x")
    with pytest.raises(FileNotFoundError):
        store.read("vectors", "none")
    sinks.save_vectors(df, f"{tmp_path}/v")
    assert sinks.load_vectors(spark, f"{tmp_path}/v", df).count() == 1
    with pytest.raises(ValueError):
        sinks.load_vectors(spark, f"{tmp_path}/v", df.limit(0))
    sinks.write_text(str(tmp_path / "r" / "x.md"), "hi")
    assert (tmp_path / "r" / "x.md").read_text() == "hi"
    p = spark.createDataFrame([("a|b", "c", 1, 0.5, 0.25)], "source string, target string, rank int, score double, relatedness double")
    report = sinks.proposals_markdown(p)
    assert "## a\\|b" in report and "relatedness: 0.2500" in report and "nothing to propose" in sinks.proposals_markdown(p.limit(0))
    drafts = spark.createDataFrame([("n", 0, 3, "t", 0.7, None, 1), ("n", 5, 9, "u", 0.2, "over_budget", None)], "source string, start int, end int, target string, score double, reason string, rank int")
    assert "- 0-3 to t (0.700)" in sinks.inline_markdown(drafts) and "over_budget: 1" in sinks.inline_markdown(drafts)
    sinks.write_json_lines(p, f"{tmp_path}/j")
    assert json.loads(spark.read.text(f"{tmp_path}/j").first()[0])["target"] == "c"
    assert sinks.run_manifest("r", [], {"b": 1, "a": 2}) == sinks.run_manifest("r", [], {"a": 2, "b": 1})


def test_cache_embeds_each_content_once(spark):
    units = spark.createDataFrame([("u1", "h1", "text"), ("u2", "h1", "text"), ("u3", "h2", "other")], "unit string, content_hash string, text string")
    embed = lambda c: F.array(F.length(c).cast("double"))
    cache = spark.createDataFrame([], "cache_key string, v array<double>")
    vectors, cache = W.embed_through(units, cache, "m", embed)
    assert vectors.count() == 3 and cache.count() == 2
    assert W.fresh_units(units, cache, "m").count() == 0 and W.fresh_units(units, cache, "other").count() == 3


def test_stream_of_documents_and_windows(spark, tmp_path):
    schema = "id string, revision string, arrived_at timestamp, doc_key long"
    from datetime import datetime as D

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.1)

    seen = []
    build = lambda df, n: seen.extend((r["id"], r["revision"]) for r in df.collect())
    run = lambda: W.follow_documents(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", build, f"{tmp_path}/cp").awaitTermination()
    put("1", [("a", "r1", D(2025, 1, 1), 1), ("a", "r2", D(2025, 1, 2), 2), ("b", "r1", D(2025, 1, 1), 3)])
    run()
    put("2", [("a", "r2", D(2025, 1, 3), 4), ("b", "r9", D(2025, 1, 3), 5)])
    run()
    assert sorted(seen) == [("a", "r2"), ("b", "r1"), ("b", "r9")]

    events = spark.createDataFrame([(1, D(2025, 1, 1, 0, m), "x", 1.0) for m in (0, 5, 50)], "user long, ts timestamp, kind string, value double")
    events.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    query = W.tumbling(stream, "ts", "30 minutes", ["kind"], "value", "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbling_test").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("tumbling_test").collect()) == [1, 2]
    assert sorted(r["n"] for r in W.sessions(events, "ts", "10 minutes", "user").collect()) == [1, 2]
    assert W.latest_by(events, "user", "ts", "kind").first()["ts"] == D(2025, 1, 1, 0, 50)


def test_reports_say_what_they_leave_out(spark):
    drafts = spark.createDataFrame([("n", i, i + 1, "t", 0.5, None, i + 1) for i in range(5)], "source string, start int, end int, target string, score double, reason string, rank int")
    assert "3 more accepted ones" in sinks.inline_markdown(drafts, limit=2) and "not listed" not in sinks.inline_markdown(drafts, limit=5)
    proposals = drafts.select("source", "target", "rank", "score")
    assert "3 more of lower rank" in sinks.proposals_markdown(proposals, limit=2) and "not listed" not in sinks.proposals_markdown(proposals)
