"""What a model has to offer, a deterministic stand-in, retries and readers of replies. No network is used here."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import time
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import REFUSALS, is_refusal

WAITS = (2.0, 5.0, 15.0)
RETRIED = frozenset([429, *range(500, 600)])


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    def entities(self, text: str) -> str: ...
    def edges(self, names: Sequence[str], text: str) -> str: ...


class Answerer(Protocol):
    def answer(self, system: str, user: str, most_tokens: int) -> str: ...


class Reader(Protocol):
    def read(self, image: bytes, prompt: str) -> str: ...


class Judge(Protocol):
    def judge(self, question: str, gold: str, prediction: str) -> bool: ...


class TransportError(Exception):
    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


def with_retries(call: Callable[[], str], wait: Callable[[float], None] = time.sleep, waits: Sequence[float] = WAITS) -> str:
    """A call again after 2, 5 and 15 seconds when its status is 429 or 5xx; other errors are raised at once."""
    for pause in (*waits, None):
        try:
            return call()
        except TransportError as error:
            if pause is None or error.status not in RETRIED:
                raise
            wait(pause)
    raise AssertionError


def in_order(reply: Sequence[dict], n: int) -> list[list[float]]:
    """Vectors of a batch reply put back in the order of their index."""
    out: list[list[float]] = [[] for _ in range(n)]
    for item in reply:
        out[item["index"]] = item["embedding"]
    return out


def judged_yes(reply: str) -> bool:
    return reply.strip().lower().startswith("yes")


def refused(text: str) -> bool:
    return text.strip().lower().startswith(REFUSALS)


def read_page(reader: Reader, image: bytes, prompt: str, again: str) -> str:
    """One picture; a refusal is asked once more with another prompt."""
    text = reader.read(image, prompt)
    return reader.read(image, again) if refused(text) else text


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG or JPEG, or None."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + size
    return None


def double_page(data: bytes) -> bool:
    size = image_size(data)
    return bool(size and size[1] and size[0] / size[1] > 1.3)


class PatternExtractor:
    """Two capitalised words are an entity and names that follow each other are related: repeatable, without
    understanding; for tests and dry runs."""

    def entities(self, text: str) -> str:
        names = dict.fromkeys(re.findall(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", text))
        return json.dumps({"extracted_entities": [{"name": n, "entity_type": "Person", "description": ""} for n in names]})

    def edges(self, names: Sequence[str], text: str) -> str:
        rows = [{"relation_type": "FOLLOWED_BY", "source_entity_id": i, "target_entity_id": i + 1, "fact": f"{a} is followed by {b}"} for i, (a, b) in enumerate(zip(names, names[1:], strict=False))]
        return json.dumps(rows)


class FirstFactAnswerer:
    """Answers with the first line of the context, and judges by equal words."""

    def answer(self, system: str, user: str, most_tokens: int) -> str:
        lines = [x for x in user.split("\n") if re.match(r"\d+\. ", x)]
        return " ".join(re.sub(r"^\d+\. (?:\[[^\]]*\] )?", "", lines[0]).split()[:most_tokens]) if lines else ""

    def judge(self, question: str, gold: str, prediction: str) -> bool:
        return set(re.findall(r"\w+", gold.lower())) <= set(re.findall(r"\w+", prediction.lower()))


class HashEmbedder:
    """Hashed words as a vector of length one: repeatable, without meaning; for tests and dry runs."""

    def __init__(self, dim: int = 32) -> None:
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            size = np.linalg.norm(v)
            out.append((v / size if size else v).tolist())
        return out


def apply_model(df: DataFrame, call: Callable[..., str], into: str, *columns: str, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """df with into, a struct of the model's reply to the columns and the error if there is none.

    Rows go to the model in Arrow batches on the executors, with retries; a call that fails spoils its own row
    only. A null in the first column is not asked for.
    """

    @F.pandas_udf("struct<reply:string,error:string>")
    def ask(*values: pd.Series) -> pd.DataFrame:
        rows = []
        for row in zip(*values, strict=True):
            if row[0] is None:
                rows.append((None, None))
                continue
            try:
                rows.append((with_retries(lambda row=row: call(*row), wait), None))
            except Exception as error:
                rows.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["reply", "error"])

    return df.withColumn(into, ask(*columns))


def embed_column(df: DataFrame, text: str, embedder: Embedder, into: str = "embedding", wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """A vector for each row's text, embedded in Arrow batches with retries; null and empty texts have none."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        some = [t for t in texts if t]
        made = iter(with_retries(lambda: embedder.embed(some), wait)) if some else iter(())
        return pd.Series([next(made) if t else None for t in texts], dtype=object)

    return df.withColumn(into, embed(text))


def decode_vectors(df: DataFrame, blob: str, into: str = "embedding") -> DataFrame:
    """Vectors from bytes of little-endian 32-bit floats; empty bytes give null."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, "<f4").tolist() if b else None for b in blobs], dtype=object)

    return df.withColumn(into, decode(blob))


def encode_vector(v: Sequence[float] | None) -> bytes:
    return np.asarray(v if v is not None else [], "<f4").tobytes()


__all__ = ["Answerer", "Embedder", "Extractor", "FirstFactAnswerer", "HashEmbedder", "Judge", "PatternExtractor", "apply_model", "Reader", "TransportError", "decode_vectors", "double_page", "embed_column", "encode_vector", "in_order", "is_refusal", "judged_yes", "read_page", "refused", "with_retries"]
