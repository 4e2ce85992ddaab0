"""Reading level of the English prose in marked-up texts."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.scratch import spread

#: Most graded rows the model is fitted on, by hash order.
TRAIN_ROWS = 5_000
#: Rows a label, by hash order, that language profiles are learned from, and labels, by number of rows.
LANGUAGE_ROWS, LANGUAGES = 400, 16
#: Texts with fewer words of running prose get no level.
LEAST_WORDS = 80

# Frequent function words by language, for texts that come without labelled rows to learn languages from.
FUNCTION_WORDS = {
    "en": "a about after all an and any are as at be because before but by can do each for from had has have he her his how i if in into is it its may more my no not now of on one or our out so some such than that the their then there these they this to too under until up was we were what when where which while who will with without you your",
    "fr": "au aux avec avant ce ces cet cette chaque comme dans de des du elle en est et il ils je jusqu la le les leur lorsque mais ne nous on ou par pas plus pour puis quand que qui sans se ses si son sont sur un une vers y",
    "de": "aber als am an auf aus bei bevor bis das dass dem den der des die doch ein eine einem einen einer er es für genau hat ich im in ist jede man mit nach nicht noch nur oder sich sie sind so um und von vor wenn wie wird zu zum zur",
    "es": "al antes cada como con cuando de del el ella en entre es esta este hasta hay la las le lo los luego más menos no o para pero por porque que queda se según si sin sobre su sus también un una unos y ya",
}
_LANGUAGE = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}

# Word classes of the syntax features.
SUBORDINATORS = frozenset("although because if provided rather since than though unless until whereas whether while".split())
RELATIVES = frozenset("that which who whose whom".split())
LINKERS = frozenset("and but here now so then too yet".split())
BE = frozenset("am are be been being is was were".split())
PREPOSITIONS = frozenset("across against behind between by during for from in into of on over through to under with within without".split())

_FRONT = re.compile(r"\A﻿?\s*(---|\+\+\+)[ \t]*\n.*?\n(\1|\.\.\.)[ \t]*(?:\n|\Z)", re.S)
_FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,})[^\n]*(?:\n.*?(?:^[ \t>]*\1[`~]*[ \t]*$|\Z)|\Z)", re.S | re.M)
_DISPLAY = re.compile(r"\$\$.*?(?:\$\$|\Z)|\\\[.*?\\\]|\\begin\{(\w+\*?)\}.*?\\end\{\1\}", re.S)
_HTML_BLOCK = re.compile(r"<!--.*?-->|<(pre|code|script|style|table|h[1-6]|title|svg|math)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_HTML_BREAK = re.compile(r"<br\s*/?>", re.I)
_HTML_PART = re.compile(r"</?(?:p|div|li|ul|ol|section|article|blockquote|hr)\b[^>]*>", re.I)
_HTML_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_HEADING = re.compile(r"^[ \t>]{0,6}#{1,6}(?:[ \t][^\n]*)?$|^[^\n|>#-][^\n]*\n(?:=+|-{3,})[ \t]*$", re.M)
_TABLE = re.compile(r"^[ \t>]*\|[^\n]*$|^[^\n|]*\|[^\n|]*\|[^\n]*$|^[ \t]*:?-{3,}:?[ \t]*\|[^\n]*$", re.M)
_RULE = re.compile(r"^[ \t]*(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)
_INDENTED = re.compile(r"^(?: {4,}|\t)[^\n]*(?:[=(){};]|\w_\w)[^\n]*$", re.M)
_CODE = re.compile(r"(`+)[^`\n]+\1")
_MATH = re.compile(r"\$[^$\n]+\$|\\\([^\n]*?\\\)")
_IMAGE = re.compile(r"!\[\[[^\]\n]*\]\]|!\[[^\]\n]*\]\([^)\n]*\)")
_WIKI = re.compile(r"\[\[(?:[^\]|\n]*\|)?(?:[^\]|\n]*/)?([^\]|\n/]*)\]\]")
_LINK = re.compile(r"\[([^\]\n]*)\](?:\([^)\n]*\)|\[[^\]\n]*\])")
_URL = re.compile(r"\bhttps?://\S+")
_EMPHASIS = re.compile(r"\*+|__+|~~|(?<!\w)_|_(?!\w)")
_MARKER = re.compile(r"^[ \t]*(?:>[ \t]*)*(?:[-*+•][ \t]+|\d{1,3}[.)][ \t]+)", re.M)
_QUOTE = re.compile(r"^[ \t]*(?:>[ \t]?)+", re.M)
_WRAPPED = re.compile(r"(?<=[^\W\d_])-\n[ \t]*(?=[a-zà-ÿ])")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")
_BLANK = re.compile(r"\n[ \t]*\n\s*")
_END = re.compile(r"[.!?…]+[\"')\]”’]*\s+")
_WORD = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")
_VOWELS = re.compile(r"[aeiouy]+")


def running_prose(text: str) -> list[str]:
    """Blocks of running prose of a marked-up text.

    Front matter, code, formulas, tables, headings and rules are left out, of
    Markdown and of HTML; links give their text; emphasis, list and quote marks
    go; words broken at a line end are joined.  Line ends inside a block stay.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _FRONT.sub("\n", text, count=1)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "$" in text or "\\" in text:
        text = _DISPLAY.sub("\n\n", text)
    if "<" in text:
        text = _HTML_BLOCK.sub("\n\n", text)
        text = _HTML_TAG.sub("", _HTML_PART.sub("\n\n", _HTML_BREAK.sub("\n", text)))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "[" in text:
        text = _LINK.sub(r"\1", _WIKI.sub(r"\1", _IMAGE.sub("", text)))
    text = _HEADING.sub("\n", text)
    if "|" in text:
        text = _TABLE.sub("", text)
    text = _INDENTED.sub("", _RULE.sub("", text))
    if "`" in text:
        text = _CODE.sub(" ", text)
    if "$" in text or "\\(" in text:
        text = _MATH.sub(" ", text)
    if "://" in text:
        text = _URL.sub("", text)
    text = _MARKER.sub("\n\n", text)
    text = _QUOTE.sub("", text)
    text = _EMPHASIS.sub("", text)
    text = _WRAPPED.sub("", text)
    return [b for b in (part.strip() for part in _BLANK.split(text)) if b]


def sentences(block: str) -> list[str]:
    """Sentences of a block; a line end ends one only where nearly every line begins like a sentence."""
    lines = [x.strip() for x in block.split("\n")]
    starts = [x for x in lines[1:] if x]
    if starts and sum(x[0].isupper() or x[0].isdigit() for x in starts) >= 0.9 * len(starts):
        return [s for x in lines for s in _END.split(x) if s]
    return [s for s in _END.split(" ".join(lines)) if s]


def is_english(words: list[str], least: float = 0.15) -> bool:
    """Whether English function words make up `least` of the words and more than those of any other language."""
    if not words:
        return False
    counts = Counter(words)
    share = {lang: sum(counts[w] for w in known) / len(words) for lang, known in _LANGUAGE.items()}
    return share["en"] >= least and share["en"] > max(v for k, v in share.items() if k != "en")


class Languages:
    """Naive Bayes over the character n-grams (1 to 4, with word ends) of words, learned from labelled texts whose labels may be wrong."""

    def __init__(self, labels: list[str], grams: dict[str, int], logs: np.ndarray):
        self.labels, self.grams, self.logs = labels, grams, logs
        self.known: dict[str, int] = {}
        self.matrix = np.empty((1024, len(labels)), np.float32)

    @staticmethod
    def fit(texts: list[list[str]], labels: list[str], rounds: int = 3, smoothing: float = 0.5) -> "Languages":
        """Fit on lower-cased words; after each round texts take the label they are given, so wrong ones stop counting."""
        names = sorted(set(labels))
        at = np.array([names.index(x) for x in labels])
        bags = [Counter(words) for words in texts]
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*bags)))}
        grams: dict[str, int] = {}
        parts = [np.array([grams.setdefault(g, len(grams)) for g in word_grams(w)]) for w in vocabulary]
        sizes, flat = np.array([len(p) for p in parts]), np.concatenate(parts)
        rows = [(np.array([vocabulary[w] for w in b], int), np.array(list(b.values()), float)) for b in bags]
        for _ in range(rounds):
            counts = np.zeros((len(names), len(grams)))
            for k in range(len(names)):
                words = np.zeros(len(vocabulary))
                for (w, n), label in zip(rows, at):
                    if label == k:
                        words[w] += n
                counts[k] = np.bincount(flat, np.repeat(words, sizes), len(grams))
            logs = np.log((counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * (len(grams) + 1))).T
            model = Languages(names, grams, np.vstack([logs, np.log(smoothing / (counts.sum(1) + smoothing * (len(grams) + 1)))]).astype(np.float32))
            by_word = np.add.reduceat(logs[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            new = np.array([int((by_word[w] * n[:, None]).sum(0).argmax()) if len(w) else a for (w, n), a in zip(rows, at)])
            if (new == at).all():
                break
            at = new
        return model

    def _row(self, word: str) -> int:
        """Place of a word's log-likelihoods by label in the matrix of words met so far."""
        at = len(self.known)
        if at == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
        get, other = self.grams.get, len(self.grams)
        self.matrix[at] = self.logs[[get(g, other) for g in word_grams(word)]].sum(0)
        self.known[word] = at
        return at

    def of(self, words: list[str]) -> str | None:
        """Label of a text by its lower-cased words, None without words."""
        if not words:
            return None
        if len(self.known) > 500_000:
            self.known.clear()
        counts, get = Counter(words), self.known.get
        rows = [get(w) for w in counts]
        if None in rows:
            rows = [self._row(w) if r is None else r for w, r in zip(counts, rows)]
        return self.labels[int((np.fromiter(counts.values(), np.float32, len(rows)) @ self.matrix[rows]).argmax())]


def word_grams(word: str) -> list[str]:
    marked = f" {word[:64]} "  # longer runs are no words of a language
    return [marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)]


def prose_words(text: str) -> list[str]:
    return _WORD.findall("\n".join(running_prose(text)).lower())


def fit_languages(labelled: DataFrame, key: str, text: str, label: str, also: dict[str, list[str]] | None = None, rows: int = LANGUAGE_ROWS) -> Languages:
    """Language profiles learned on the driver from at most `rows` texts a label, of the LANGUAGES most frequent labels; `also` adds texts by label.

    Labels are taken by their first two letters without case; rows without
    label or text don't count, and labels of fewer than three rows neither.
    """
    named = labelled.select(F.col(key).alias("k"), F.lower(F.substring(F.trim(label), 1, 2)).alias("label")).filter(F.col("label").rlike("^[a-z]{2}$") & F.col(text).isNotNull())
    usual = named.groupBy("label").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "label").limit(LANGUAGES)
    order = Window.partitionBy("label").orderBy(F.xxhash64("k"), "k")
    chosen = named.join(F.broadcast(usual), "label").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows).select("k", "label")
    got = labelled.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").orderBy("label", F.xxhash64("k"), "k", "t").toPandas()  # at most LANGUAGES x rows
    texts, labels = [prose_words(t) for t in got["t"]], got["label"].tolist()
    for name, more in (also or {}).items():
        texts += [prose_words(t) for t in more]
        labels += [name] * len(more)
    kept = [i for i, t in enumerate(texts) if t]
    if not kept:
        raise ValueError("labelled texts with prose are needed")
    return Languages.fit([texts[i] for i in kept], [labels[i] for i in kept])


#: Names of the features, in the order of `surface_features`; the vocabulary difficulty comes last.
FEATURES = ["log_sentence", "word_length", "long", "very_long", "syllables", "subordinators", "relatives", "linkers", "be", "of", "prepositions", "the", "clauses", "participles", "nominals", "adverbs", "short_sentences", "difficulty"]


def surface_features(blocks: list[str]) -> tuple[list[float], list[str]]:
    """(syntax and vocabulary features without the learned difficulty, lower-cased words)."""
    lengths, words = [], []
    for block in blocks:
        for s in sentences(block):
            found = _WORD.findall(s.lower())
            if found:
                lengths.append(len(found))
                words += found
    n = max(len(words), 1)
    plain = [w for w in words if w.isalpha()]
    m = max(len(plain), 1)
    counts = Counter(plain)
    of = lambda known: sum(counts[w] for w in known) / n
    ends = lambda *tails: sum(c for w, c in counts.items() if len(w) > 5 and w.endswith(tails)) / n
    length = sum(len(w) * c for w, c in counts.items())
    syllables = sum(len(_VOWELS.findall(w)) * c for w, c in counts.items())
    sub, rel = of(SUBORDINATORS), of(RELATIVES)
    return [
        float(np.log(n / max(len(lengths), 1))),
        length / m,
        sum(c for w, c in counts.items() if len(w) >= 7) / m,
        sum(c for w, c in counts.items() if len(w) >= 10) / m,
        syllables / m,
        sub,
        rel,
        of(LINKERS),
        of(BE),
        counts["of"] / n,
        of(PREPOSITIONS),
        counts["the"] / n,
        (sub + rel) * n / max(len(lengths), 1),
        ends("ed"),
        ends("tion", "sion", "ment", "ness", "ity", "ance", "ence"),
        ends("ly"),
        sum(x <= 8 for x in lengths) / max(len(lengths), 1),
    ], plain


class LevelModel:
    """A linear pairwise ranker whose scores isotonic regression maps to grades."""

    def __init__(self, table: dict, default: float, mean, scale, weights, knots, levels):
        self.table, self.default, self.mean, self.scale, self.weights, self.knots, self.levels = table, default, mean, scale, weights, knots, levels

    @staticmethod
    def fit(texts: list[str], grades: list[int], ridge: float = 1.0, rounds: int = 25) -> "LevelModel":
        """Fit on graded texts (unmarked or marked up).

        A word's difficulty is the smoothed mean grade of the texts it is in;
        a training text's own share is taken out of it.  The ranker is a
        logistic regression on feature differences of all pairs of unlike grade.
        """
        rows = [surface_features(running_prose(t)) for t in texts]
        y = np.asarray(grades, dtype=float)
        sums, seen = Counter(), Counter()
        bags = [set(words) for _, words in rows]
        for bag, g in zip(bags, y):
            for w in bag:
                sums[w] += g
                seen[w] += 1
        default, prior = float(y.mean()), 2.0
        table = {w: (sums[w] + prior * default) / (seen[w] + prior) for w in seen if seen[w] >= 3}
        x = []
        for (surface, words), bag, g in zip(rows, bags, y):
            own = {w: (sums[w] - g + prior * default) / (seen[w] - 1 + prior) for w in bag if seen[w] >= 4}
            x.append([*surface, float(np.mean([own.get(w, default) for w in words])) if words else default])
        x = np.asarray(x)
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        z = (x - mean) / scale
        w, pairs = np.zeros(z.shape[1]), sum(int((y < g).sum()) for g in y)
        for _ in range(rounds):
            grad, hess = -ridge * 1e-2 * w, ridge * 1e-2 * np.eye(len(w))
            for g in np.unique(y):  # all pairs, a block of upper texts at a time
                below, upper = z[y < g], z[y == g]
                step = max(1, 200_000 // max(len(below), 1))
                for i in range(0, len(upper) if len(below) else 0, step):
                    d = (upper[i : i + step, None] - below[None]).reshape(-1, len(w))
                    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                    grad = grad + d.T @ (1 - p) / pairs
                    hess = hess + (d * (p * (1 - p))[:, None]).T @ d / pairs
            step = np.linalg.solve(hess, grad)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        score = z @ w
        knots, levels = isotonic(score, y)
        return LevelModel(table, default, mean, scale, w, knots, levels)

    def features(self, blocks: list[str]) -> list[float]:
        surface, words = surface_features(blocks)
        get, default = self.table.get, self.default
        return [*surface, sum(get(w, default) for w in words) / len(words) if words else default]

    def level(self, blocks: list[str]) -> float:
        """Calibrated reading level: the fitted steps, joined by straight lines between their middles."""
        score = float(((np.asarray(self.features(blocks)) - self.mean) / self.scale) @ self.weights)
        return float(np.interp(score, self.knots, self.levels))


def isotonic(score: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic least squares by pooling adjacent violators: (mean score, level) of the pools."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of targets, sum of scores, size
    for s, t in zip(score[order], target[order]):
        pools.append([t, s, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][2] >= pools[-1][0] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[1] / p[2] for p in pools]), np.array([p[0] / p[2] for p in pools])


def fit_levels(graded: DataFrame, key: str, text: str, grade: str, train_rows: int = TRAIN_ROWS) -> LevelModel:
    """The model, fitted on the driver on at most `train_rows` rows with a text and a grade."""
    rows = graded.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(grade).cast("int").alias("g")).filter("t is not null and g is not null").orderBy(F.xxhash64("k"), "k").limit(train_rows).toPandas().sort_values(["k", "t"])
    if rows["g"].nunique() < 2:
        raise ValueError("graded rows of at least two grades are needed")
    return LevelModel.fit(rows["t"].tolist(), rows["g"].tolist())


def graded_texts(graded: DataFrame, key: str, text: str, rows: int = LANGUAGE_ROWS) -> list[str]:
    """At most `rows` texts, by hash order."""
    return [r["t"] for r in graded.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").orderBy(F.xxhash64("k"), "k").limit(rows).collect()]


def reading_levels(texts: DataFrame, key: str, text: str, model: LevelModel, *, languages: Languages | None = None, english: str = "en", lowest: int = 1, highest: int = 5, least_words: int = LEAST_WORDS) -> DataFrame:
    """Level of each English text with at least `least_words` words of prose: (key, grade, level, prose_words).

    The language is that of the prose, whatever a column says: by the learned
    profiles of `languages`, or by function words without them.  Each row is
    settled by itself, without a shuffle.  Null, empty, short and non-English
    texts have no row; repeated rows each have one; other columns are ignored.
    """
    source = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null"), "key")
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("grade", T.IntegerType()), T.StructField("level", T.DoubleType()), T.StructField("prose_words", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"]):
                blocks = running_prose(t)
                words = _WORD.findall("\n".join(blocks).lower())
                if len(words) < least_words or not (languages.of(words) == english if languages else is_english(words)):
                    continue
                level = model.level(blocks)
                rows.append((k, int(min(max(np.floor(level + 0.5), lowest), highest)), level, len(words)))
            yield pd.DataFrame(rows, columns=schema.names)

    return source.mapInPandas(run, schema)


def level_profile(levels: DataFrame, corpus: DataFrame, key: str, by: str) -> DataFrame:
    """Documents and mean level per value of `by` and grade: (by, grade, n_docs, mean_level, prose_words)."""
    return levels.join(corpus.select(key, by), key).groupBy(by, "grade").agg(F.count("*").alias("n_docs"), F.avg("level").alias("mean_level"), F.sum("prose_words").alias("prose_words"))
