"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.scratch import spread

TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE_END = frozenset(".!?。！？…")
_CLAUSE_END = frozenset(",;:、，；)")

#: Strengths of a boundary, by what stands in the gap between two tokens.
BLANK_LINE, HEADING, LINE, SENTENCE, CLAUSE, SPACE, INSIDE = 6, 7, 5, 4, 3, 2, 1


def boundary_strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary before each token but the first (index 0 is unused).

    A heading or blank line outranks a line end, that a sentence end, that a
    clause mark, that plain white space; between tokens without white space
    there is the weakest one.
    """
    out = [0] * len(spans)
    for i in range(1, len(spans)):
        end, start = spans[i - 1][1], spans[i][0]
        if start == end:
            out[i] = INSIDE
            continue
        gap = text[end:start]
        breaks = gap.count("\n") or gap.count("\r")
        if breaks:
            out[i] = (HEADING if text[start] == "#" else BLANK_LINE) if breaks > 1 else (BLANK_LINE if text[start] == "#" else LINE)
        else:
            last = text[end - 1]
            if last in "\"'”’)" and end > 1 and text[end - 2] in _SENTENCE_END:
                last = text[end - 2]
            out[i] = SENTENCE if last in _SENTENCE_END else CLAUSE if last in _CLAUSE_END else SPACE
    return out


def bisect_tokens(strength: list[int], n: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges from recursive bisection: each at most `limit` tokens once its overlap is attached.

    A range longer than limit - overlap is cut at the strongest boundary of its
    middle half, ties to the one nearest the midpoint, then to the earlier.
    """
    if n <= limit:
        return [(0, n)]
    room, done, todo = limit - overlap, [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            done.append((a, b))
            continue
        mid, reach = (a + b) // 2, max((b - a) // 4, 1)
        lo, hi = max(a + 1, mid - reach), min(b - 1, mid + reach)
        best = max(strength[lo : hi + 1])
        cut = min((i for i in range(lo, hi + 1) if strength[i] == best), key=lambda i: (abs(i - mid), i))
        todo += [(cut, b), (a, cut)]
    return done


def overlap_start(strength: list[int], previous: tuple[int, int], start: int, overlap: int) -> int:
    """Where the repeated tail of the piece before begins: at most `overlap` tokens back, at the strongest boundary of the last fifth of that reach."""
    far = max(previous[0], start - overlap)
    near = max(far, start - overlap + overlap // 5)
    if overlap <= 0 or far == previous[0]:
        return far if overlap > 0 else start
    return max(range(far, near + 1), key=lambda i: (strength[i], -i))


def split_text(text: str, limit: int = 250, overlap: int = 40) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, repeated tokens) of each piece of `text`, offsets in code points.

    The pieces cover all tokens; white space between two pieces belongs to
    neither.  A text of at most `limit` tokens is one piece with its own ends.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    if len(text) <= limit:  # a token has at least one character
        return [(0, len(text), len(TOKEN.findall(text)), 0)]
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return [(0, len(text), n, 0)]
    strength = boundary_strengths(text, spans)
    cores, out = bisect_tokens(strength, n, limit, overlap), []
    for k, (a, b) in enumerate(cores):
        first = overlap_start(strength, cores[k - 1], a, overlap) if k else a
        out.append((spans[first][0], spans[b - 1][1], b - first, a - first))
    return out


def split_items(items: DataFrame, key: str, text: str, start: str | None = None, *, limit: int = 250, overlap: int = 40) -> DataFrame:
    """Pieces of every item: (key, piece, n_pieces, start_char, end_char, token_count, overlap_tokens, text).

    Recursive bisection of each text by itself, so rows never move: the scan
    feeds the Python workers and no shuffle follows.  Sizes are measured, a
    stored count is not trusted.  `piece` counts from 0.  Offsets are shifted
    by the item's own `start` and null where that is null or not given; the text is
    always a slice of the item's.  A null text gives no piece, an empty one a
    single empty piece.  Repeated rows give repeated pieces.  Other columns
    are dropped, so their names cannot clash.
    """
    source = spread(items.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(start) if start else F.lit(None)).cast("long").alias("base")).filter("text is not null"), "key")
    schema = T.StructType(
        [T.StructField(key, items.schema[key].dataType)]
        + [T.StructField(n, T.IntegerType()) for n in ("piece", "n_pieces")]
        + [T.StructField(n, T.LongType()) for n in ("start_char", "end_char", "token_count", "overlap_tokens")]
        + [T.StructField("text", T.StringType())]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, base in zip(batch["key"], batch["text"], batch["base"]):
                pieces = split_text(t, limit, overlap)
                known = not pd.isna(base)
                for i, (a, b, n, rep) in enumerate(pieces):
                    rows.append((k, i, len(pieces), int(base) + a if known else None, int(base) + b if known else None, n, rep, t[a:b]))
            out = pd.DataFrame(rows, columns=schema.names)
            yield out.astype({"start_char": "Int64", "end_char": "Int64"})

    return source.mapInPandas(cut, schema)


def oversized(pieces: DataFrame, key: str) -> DataFrame:
    """Keys of the items that were split: each has exactly one second piece."""
    return pieces.filter("piece = 1").select(key)


