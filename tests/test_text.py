import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weaveline.functions import text as X
from weaveline.functions import vectors as V
from weaveline.operators import chunking as K
from weaveline.operators import textstats as S


def _one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_tokens_are_unicode(spark):
    for t in ("naïve café, x_1!", "𝑥 + Ünï code…", "", "a​b", "été"):
        assert _one(spark, t, X.token_count(F.col("t")))[0] == len(re.findall(r"\w+|[^\w\s]", t)), t
    assert _one(spark, None, X.token_count(F.col("t")))[0] is None


def test_normal_forms(spark):
    assert _one(spark, "a \r\nb\t\rc", X.canonical(F.col("t")))[0] == "a\nb\nc"
    assert _one(spark, "é", X.canonical(F.col("t")))[0] == "é"
    assert _one(spark, "  «Hash  Table»,", X.mention_key(F.col("t")))[0] == "hash table"
    assert _one(spark, "...", X.mention_key(F.col("t")))[0] is None
    assert _one(spark, "/a/b/index.md#x", X.slug_key(F.col("t")))[0] == "a/b"
    assert _one(spark, "a*b|c", X.escape_markdown(F.col("t")))[0] == "a\\*b\\|c"
    assert _one(spark, "ß", X.casefold(F.col("t")))[0] == "ss"


def test_edit_similarity(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("", "a"), ("x", "x")], "a string, b string").select(X.edit_similarity(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 9) for r in rows] == [round(1 - 3 / 7, 9), 1.0, 0.0, 1.0]


def test_fuzzy_pairs_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(0)
    names = {"".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(80)}
    base = ["distributed index", "consistent hashing", "page table"]
    names |= {w[:i] + rng.choice("xyz") + w[i + rng.randint(0, 1) :] for w in base for i in range(len(w))}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for threshold in (0.6, 0.8):
        want = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if 1 - lev(a, b) / max(len(a), len(b)) >= threshold - 1e-12}
        got = {(r["a"], r["b"]) for r in S.fuzzy_pairs(spark.createDataFrame([(n,) for n in names] + [(None,)], "n string"), "n", threshold).collect()}
        assert got == want


def _windows(text, size, overlap):
    words, out, i = text.split(), [], 0
    while i < len(words):
        j = min(i + size, len(words))
        out.append(" ".join(words[i:j]))
        i = j - overlap if j - overlap > i else j
    return out


def test_word_windows(spark):
    cases = [" ".join(str(i) for i in range(n)) for n in (0, 1, 2, 3, 7, 8, 9, 10, 15, 16, 17, 18, 30)]
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", K.word_windows(F.col("t"), 8, 3).alias("w")).collect()
    for r in rows:
        assert r["w"] == _windows(r["t"], 8, 3)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.normalize(F.col("a")).alias("n")).collect()
    assert [round(r["c"], 9) for r in rows] == [0.96, 0.0] and rows[0]["n"] == [0.6, 0.8] and rows[1]["n"] == [0.0, 0.0]
    vs = spark.createDataFrame([("hello world",), ("hello world",), ("",), (None,)], "t string").select(V.hash_embedder(64)("t").alias("v")).collect()
    assert vs[0]["v"] == vs[1]["v"] and abs(sum(x * x for x in vs[0]["v"]) - 1) < 1e-5 and set(vs[2]["v"]) == {0.0} and vs[3]["v"] is None


@given(st.lists(st.text(alphabet="ab .\n", max_size=40), max_size=6))
@settings(max_examples=100, deadline=None)
def test_section_chunks_keep_the_limit(bodies):
    group = [{"kind": "prose", "text": b, "level": None} for b in bodies if b.strip()]
    if group:
        for text, used in K.section_chunks("T", ["H"], group, 20, 24, 4):
            assert K.count_tokens(text) <= 24 and used


def test_unit_ids_number_repeats():
    ids = K.unit_ids("d", [("section", [], "x"), ("section", [], "y"), ("section", [], "x")])
    assert ids[2] == ids[0] + "~1" and ids[0] != ids[1]
    assert K.combine_fingerprints("a", "b") != K.combine_fingerprints("b", "a")
