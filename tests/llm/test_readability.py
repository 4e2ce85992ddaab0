import os
import re

import numpy as np
import pandas as pd
import pytest

from weaveline.llm import readability as R

EASY = "The cat sat on the mat. It was a big red cat. We like the cat. Now the dog ran to it. "
HARD = "Notwithstanding considerable methodological heterogeneity, the comparative evaluation of distributed synchronization mechanisms, which necessitates systematic characterization of computational dependencies, demonstrates that conventional approximations are fundamentally inadequate whenever the underlying infrastructure exhibits nonlinear degradation. "


def test_prose_leaves_out_what_is_no_prose():
    text = "---\ntitle: T\n---\n\n# Head\n\nOne *two* [three](x.md) [[a/b|four]] `code` $x+1$ five.\n\n```py\nno = 1\n```\n\n$$\ny\n$$\n\n| a | b |\n|---|---|\n| c | d |\n\n- item one\n- item two\n\n<p>six &amp; seven<br/>eight</p>\n\n> wrapped cho-\nsen line"
    words = R._WORD.findall(" ".join(R.running_prose(text)))
    assert words == "One two three four five item one item two six seven eight wrapped chosen line".split()
    assert R.running_prose("") == [] and R.running_prose("```\nopen") == []


def test_language():
    assert R.is_english(R._WORD.findall(EASY.lower()))
    assert not R.is_english("der die das und ist nicht mit von dem haus".split())
    assert not R.is_english([])


def test_isotonic_pools_violators():
    knots, levels = R.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert list(levels) == [1, 2.5, 4] and list(knots) == [1, 2.5, 4]


LAYOUTS = {
    "as it is": lambda t: t,
    "html": lambda t: "<p>" + "<br/>".join(re.split(r"(?<=\.) ", t)) + "</p>",
    "a sentence a line": lambda t: "\n".join(s.rstrip(".") for s in re.split(r"(?<=\.) ", t)),
    "other marks": lambda t: t.replace(".", "!!").replace(",", " ;"),
    "wrapped": lambda t: re.sub(r"(.{50,60}) ", r"\1\n", t),
}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the graded samples")
@pytest.mark.parametrize("layout", LAYOUTS)
def test_held_out_accuracy_in_any_layout(layout):
    f = pd.read_parquet("/root/testdata/sf0.1/graded_samples.parquet").dropna(subset=["text", "grade"])
    fold = np.random.default_rng(1).integers(0, 4, len(f))
    right = []
    for k in range(4):
        train, test = f[fold != k], f[fold == k]
        model = R.LevelModel.fit(train["text"].tolist(), train["grade"].astype(int).tolist())
        right += [np.floor(model.level(R.running_prose(LAYOUTS[layout](t))) + 0.5) == g for t, g in zip(test["text"], test["grade"])]
    assert np.mean(right) > 0.93


def test_levels_of_a_table(spark):
    graded = spark.createDataFrame([(i, (EASY if i % 2 else HARD) * 6, 1 if i % 2 else 5) for i in range(20)] + [(98, None, 3), (99, "x", None)], "sample_id long, text string, grade int")
    model = R.fit_levels(graded, "sample_id", "text", "grade")
    docs = [(1, EASY * 8), (2, HARD * 8), (3, EASY), (4, None), (5, ""), (6, "der die das und ist nicht mit von dem haus " * 20), (7, "```\n" + EASY * 10 + "```"), (2, HARD * 8)]
    got = [(r["doc_id"], r["grade"]) for r in R.reading_levels(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 as grade"), "doc_id", "text", model).collect()]
    assert sorted(got) == [(1, 1), (2, 5), (2, 5)]
    assert R.reading_levels(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", model).collect() == []
    with pytest.raises(ValueError):
        R.fit_levels(graded.limit(0), "sample_id", "text", "grade")

OTHER = {
    "de": "Der schnelle Fuchs springt über den faulen Hund, und wir sehen ihm dabei zu. Das Verfahren sortiert die Werte, bevor es sie speichert. Danach prüft jede Einheit ihre eigenen Ergebnisse. ",
    "nl": "De snelle vos springt over de luie hond en wij kijken ernaar. Het systeem sorteert de waarden voordat het ze opslaat. Daarna controleert elke eenheid zijn eigen uitkomsten. ",
}


def test_languages_are_learned_despite_wrong_labels(spark):
    rows = [(i, EASY * 3 + HARD, "EN" if i % 5 else "de") for i in range(40)] + [(100 + i, OTHER["de"] * 4, "de-DE") for i in range(30)]
    rows += [(200 + i, OTHER["nl"] * 4, " nl") for i in range(30)] + [(300, None, "en"), (301, "x", None), (302, "", "en"), (303, "rare words", "zz")]
    learned = R.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert learned.labels == ["de", "en", "nl"]
    assert learned.of(R.prose_words("We sort the values before each unit stores its own results.")) == "en"
    assert learned.of(R.prose_words("Wir speichern die Werte, bevor jede Einheit sie sortiert.")) == "de"
    assert learned.of(R.prose_words("Wij controleren de waarden voordat het systeem ze sorteert.")) == "nl"
    assert learned.of([]) is None
    model = R.LevelModel.fit([EASY * 6, HARD * 6] * 5, [1, 5] * 5)
    docs = spark.createDataFrame([(1, EASY * 8), (2, OTHER["nl"] * 8), (3, OTHER["de"] * 8)], "doc_id long, text string")
    assert [r["doc_id"] for r in R.reading_levels(docs, "doc_id", "text", model, languages=learned).collect()] == [1]


def test_all_pairs_count_and_long_formulas_are_no_prose():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["cat", "dog", "runs", "far"], 30)) + "." for _ in range(900)] + [HARD] * 900
    assert R.LevelModel.fit(texts, [1] * 900 + [5] * 900).level(R.running_prose(HARD)) > 4  # 810,000 pairs
    assert R.prose_words("before $" + "x + y " * 80 + "$ after") == ["before", "after"]
