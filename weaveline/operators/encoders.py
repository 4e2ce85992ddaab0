"""Encoders by name: token counts, text vectors, devices and batch sizes that adapt."""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.functions.vectors import hash_vector, token_states
from weaveline.scratch import spread, worker_cache

# Texts a batch by device.
BATCH = {"cpu": 16}
ACCELERATED_BATCH = 32


class HashingEncoder:
    """Signed hashing of character n-grams: needs no model and no download."""

    def __init__(self, dims: int = 256, instruction: str = "", most_tokens: int | None = None, device: str = "cpu"):
        self.dims, self.instruction, self.most_tokens = dims, instruction, most_tokens

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.stack([hash_vector(t, self.dims, self.instruction, self.most_tokens) for t in texts]) if texts else np.empty((0, self.dims))

    def count_tokens(self, text: str) -> int:
        return len(text.split())


class SentenceEncoder:
    """A sentence-transformers model from a local folder; the package is looked for only when one is asked for."""

    def __init__(self, path: str, device: str = "cpu", instruction: str = ""):
        self.model = importlib.import_module("sentence_transformers").SentenceTransformer(path, device=device, local_files_only=True)
        self.instruction = instruction

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model.encode([self.instruction + t for t in texts], batch_size=len(texts) or 1, show_progress_bar=False))

    def count_tokens(self, text: str) -> int:
        return len(self.model.tokenizer(text, add_special_tokens=False)["input_ids"])


class CausalTokenEncoder:
    """Last hidden states and offsets of a transformers model in a local folder."""

    def __init__(self, path: str, device: str = "cpu"):
        package, torch = importlib.import_module("transformers"), importlib.import_module("torch")
        self.tokenizer, self.torch, self.device = package.AutoTokenizer.from_pretrained(path, local_files_only=True), torch, device
        self.model = package.AutoModel.from_pretrained(path, local_files_only=True).to(device).eval()

    def states(self, text: str) -> list[tuple[int, int, np.ndarray]]:
        got = self.tokenizer(text, return_offsets_mapping=True, add_special_tokens=False, return_tensors="pt")
        offsets = got.pop("offset_mapping")[0].tolist()
        with self.torch.no_grad():
            hidden = self.model(**got.to(self.device)).last_hidden_state[0].float().cpu().numpy()
        return [(a, b, h) for (a, b), h in zip(offsets, hidden)]


class HashingTokenEncoder:
    def __init__(self, dims: int = 32, device: str = "cpu"):
        self.dims = dims

    def states(self, text: str) -> list[tuple[int, int, np.ndarray]]:
        return token_states(text, self.dims)


class HostedEncoder:
    """Vectors from a service, `send` posting a list of texts and returning their vectors; at most `batch` texts a call."""

    def __init__(self, send: Callable[[list[str]], list[list[float]]], batch: int = 32, device: str = "cpu"):
        self.send, self.batch = send, batch

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.asarray([v for i in range(0, len(texts), self.batch) for v in self.send(texts[i : i + self.batch])])

    def count_tokens(self, text: str) -> int:
        return len(text.split())


ENCODERS: dict[str, type] = {"hashing": HashingEncoder, "sentence": SentenceEncoder, "hosted": HostedEncoder, "hashing-tokens": HashingTokenEncoder, "causal-tokens": CausalTokenEncoder}


def create_encoder(name: str, **options):
    """An encoder by name; an unknown name is a ValueError, a missing package a RuntimeError that names it."""
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name}, not among {', '.join(sorted(ENCODERS))}")
    try:
        return ENCODERS[name](**options)
    except ModuleNotFoundError as e:
        raise RuntimeError(f"encoder {name} needs the package {e.name}") from e


def qualified_device(candidates: list[str], probe: Callable[[str], None]) -> tuple[str, list[dict]]:
    """(the first device whose probe doesn't fail, what happened in order); no device is a RuntimeError."""
    events: list[dict] = []
    for device in candidates:
        try:
            probe(device)
        except Exception as e:
            events.append({"device": device, "ok": False, "error": f"{type(e).__name__}: {e}"})
            continue
        return device, [*events, {"device": device, "ok": True, "error": None}]
    raise RuntimeError(f"no device passed: {events}")


def automatic_batch(device: str, asked: int | None = None) -> int:
    """Texts a batch: what is asked for, else by device."""
    return asked if asked else BATCH.get(device, ACCELERATED_BATCH)


def encode_adaptively(encode: Callable[[list[str]], np.ndarray], texts: list[str], batch: int) -> tuple[np.ndarray, list[int]]:
    """(vectors, batch sizes that failed): a batch that runs out of memory is halved and taken up again after the last whole one; failing at one text is an error."""
    out, failed, at = [], [], 0
    while at < len(texts):
        try:
            out.append(np.asarray(encode(texts[at : at + batch])))
            at += len(texts[at : at + batch])
        except MemoryError:
            failed.append(batch)
            if batch == 1:
                raise
            batch = max(1, batch // 2)
    return (np.concatenate(out) if out else np.empty((0, 0))), failed


def embedded(rows: DataFrame, key: str, text: str, encoder: str = "hashing", batch: int | None = None, **options) -> DataFrame:
    """(key, v) of all rows with a text, by one encoder a worker; vectors at unit length, zero ones stay."""
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("v", T.ArrayType(T.FloatType()))])
    size = automatic_batch(options.get("device", "cpu"), batch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache()
        name = f"encoder:{encoder}:{sorted(options.items(), key=str)}"
        if name not in cache:
            cache[name] = create_encoder(encoder, **options)
        for b in batches:
            if len(b):
                v, _ = encode_adaptively(cache[name].encode, b["text"].tolist(), size)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({key: b["key"], "v": list((v / np.where(length > 0, length, 1.0)).astype(np.float32))})

    source = spread(rows.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null"), "key")
    return source.mapInPandas(run, schema)


def _tokenizer(path: str) -> Callable[[str], int]:
    """A counter for a vocabulary file: .tiktoken (byte pairs), .json (tokenizers) or .model (sentencepiece)."""
    if path.endswith(".tiktoken"):
        tiktoken = importlib.import_module("tiktoken")
        with open(os.path.realpath(path), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        split = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: how the vocabulary's texts were cut
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=split, mergeable_ranks=ranks, special_tokens={})
        return lambda t: len(encoding.encode_ordinary(t))
    if path.endswith(".json"):
        model = importlib.import_module("tokenizers").Tokenizer.from_file(path)
        return lambda t: len(model.encode(t, add_special_tokens=False).ids)
    if path.endswith(".model"):
        pieces = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=path)
        return lambda t: len(pieces.encode(t))
    raise ValueError(f"unknown kind of vocabulary {path}")


def model_token_count(text: Column, vocabulary: str) -> Column:
    """Tokens by a model's own tokenizer, without special tokens; null for null.  The file is read once a worker."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        cache, name = worker_cache(), f"counter:{vocabulary}"
        if name not in cache:
            cache[name] = _tokenizer(vocabulary)
        return pd.Series([None if t is None else cache[name](t) for t in texts], dtype="Int64")

    return count(text)
