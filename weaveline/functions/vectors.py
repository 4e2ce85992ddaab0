"""Vector expressions and hashing embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is missing or has norm 0; an error if the lengths differ."""
    scale = norm(a) * norm(b)
    value = F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)
    unlike = F.raise_error(F.lit("vectors of unequal length")).cast("double")
    return F.when(a.isNull() | b.isNull(), 0.0).when(F.size(a) != F.size(b), unlike).otherwise(value)


def normalize(a: Column) -> Column:
    """Unit length as array<double>; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def row_share(a: Column) -> Column:
    """Numbers divided by their sum, by 1 if that is less."""
    total = F.greatest(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    return F.transform(a, lambda x: x / total)


def usable(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Rows whose vector has `dims` finite numbers, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(v.isNotNull() & (F.size(v) == dims)).filter(~bad & F.exists(v, lambda x: x != 0))


def hash_embedder(dims: int = 256, *, instruction: str = "", most_tokens: int | None = None):
    """A pandas UDF that embeds text by signed hashing of character 3-, 4- and 5-grams, at unit length.

    A gram's 8-byte BLAKE2b value v, big-endian, adds 1 to number (v >> 1) mod
    dims, or takes 1 off if v is odd.  Texts are cut after `most_tokens` white
    space tokens.  Null gives null, a text without grams the zero vector.
    """

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for t in texts:
            if len(known) > 1_000_000:
                known.clear()
            out.append(None if t is None else _hash_vector(t, dims, instruction, most_tokens, known).astype(np.float32))
        return pd.Series(out)

    return embed


def hash_vector(text: str, dims: int = 256, instruction: str = "", most_tokens: int | None = None) -> np.ndarray:
    """The vector of `hash_embedder` for one text."""
    return _hash_vector(text, dims, instruction, most_tokens, {})


def _hash_vector(text: str, dims: int, instruction: str, most_tokens: int | None, known: dict) -> np.ndarray:
    if most_tokens is not None:
        text = " ".join(text.split()[:most_tokens])
    text = instruction + text
    out = np.zeros(dims)
    for n in (3, 4, 5):
        for i in range(len(text) - n + 1):
            gram = text[i : i + n]
            if gram not in known:
                value = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
                known[gram] = ((value >> 1) % dims, -1.0 if value & 1 else 1.0)
            at, sign = known[gram]
            out[at] += sign
    length = np.linalg.norm(out)
    return out / length if length else out


def token_states(text: str, dims: int = 32) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, state) of every white space token: bytes of SHA-256 blocks scaled to [-1, 1], half of the state before added, at unit length."""
    import re

    out, before = [], np.zeros(dims)
    for m in re.finditer(r"\S+", text):
        raw = b"".join(hashlib.sha256(f"{i}:{m.group()}".encode()).digest() for i in range(-(-dims // 32)))[:dims]
        state = np.frombuffer(raw, np.uint8) / 127.5 - 1 + 0.5 * before
        state = state / max(float(np.linalg.norm(state)), 1e-6)
        out.append((m.start(), m.end(), state))
        before = state
    return out


def token_states_of(texts: list[str], dims: int = 32) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, states) of each text, the same numbers as those of `token_states`: texts advance together, token by token, and a word is hashed once."""
    import re

    found = [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]
    sizes = np.array([len(f) for f in found], int)
    first = np.concatenate([[0], np.cumsum(sizes)])
    known: dict[str, int] = {}
    number = np.array([known.setdefault(t[a:b], len(known)) for t, f in zip(texts, found) for a, b in f], int)
    raw = b"".join(b"".join(hashlib.sha256(f"{i}:{w}".encode()).digest() for i in range(-(-dims // 32)))[:dims] for w in known)
    own = np.frombuffer(raw, np.uint8).reshape(-1, dims) / 127.5 - 1
    states, order = np.empty((len(number), dims)), np.argsort(-sizes, kind="stable")
    open_at = len(texts) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), "right")
    before = np.zeros((len(texts), dims))
    for i, n in enumerate(open_at):
        at = first[order[:n]] + i
        s = own[number[at]] + 0.5 * before[:n]
        before = s / np.maximum(np.sqrt(np.vecdot(s, s)), 1e-6)[:, None]
        states[at] = before
    ends = [np.array(f, int).reshape(-1, 2) for f in found]
    return [(e[:, 0], e[:, 1], states[a:b]) for e, a, b in zip(ends, first, first[1:])]


def span_representation(text: str, start: int, end: int, dims: int = 32) -> list[float]:
    """[first state, last state, mean state, one of five width classes] of the tokens that meet a span; zeros where none does."""
    inside = [s for a, b, s in token_states(text, dims) if a < end and start < b]
    width = np.zeros(5)
    if not inside:
        return [*np.zeros(3 * dims), *width]
    width[min(len(inside), 5) - 1] = 1.0
    return [*inside[0], *inside[-1], *np.mean(inside, axis=0), *width]
