"""Model slots: encoder, reranker, generator and page extractor.

Each slot is a small protocol. The defaults need no model files and always give the same
result; real models plug in as Arrow UDFs that load once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import GENERATION_ERROR
from paperloom.functions.answers import mock_answer
from paperloom.functions.strings import as_col
from paperloom.functions.tokens import hash_slots, tokenize
from paperloom.operators.rerank import overlap_score


class Encoder(Protocol):
    def encode(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class Generator(Protocol):
    def generate(self, prompt: Column, question: Column) -> Column: ...


class PageExtractor(Protocol):
    """Turns one document's bytes into pages (dicts with the fields of the page schema)."""

    def pages(self, name: str, content: bytes) -> Iterator[dict]: ...


class HashEncoder:
    """Signed feature hashing of index tokens to unit vectors; equal on every run and worker."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def encode(self, text: Column | str) -> Column:
        dim = self.dim

        @F.arrow_udf("array<float>")
        def gather(slots: pa.Array) -> pa.Array:
            rows = len(slots)
            lengths = pc.fill_null(pc.list_value_length(slots), 0).to_numpy(zero_copy_only=False)
            slot = slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            cell = np.repeat(np.arange(rows), lengths) * dim + np.abs(slot) - 1
            sums = np.bincount(cell, weights=np.sign(slot), minlength=rows * dim).reshape(rows, dim)
            norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            units = (sums / np.where(norms == 0, 1.0, norms)).astype(np.float32)
            offsets = np.arange(0, (rows + 1) * dim, dim, dtype=np.int32)
            return pa.ListArray.from_arrays(offsets, units.ravel())

        return gather(hash_slots(tokenize(text), dim))


class FunctionEncoder:
    """Wrap ``factory() -> encode(list[str]) -> matrix``; the factory runs once per worker."""

    def __init__(self, factory: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32):
        self.factory, self.batch = factory, batch

    def encode(self, text: Column | str) -> Column:
        factory, size = self.factory, self.batch

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = factory()
            for texts in batches:
                values = texts.fillna("").tolist()
                rows = [
                    row.astype(np.float32)
                    for start in range(0, len(values), size)
                    for row in np.asarray(encode(values[start : start + size]))
                ]
                yield pd.Series(rows)

        return run(as_col(text))


class OverlapReranker:
    def score(self, query: Column, text: Column) -> Column:
        return F.round(overlap_score(query, text), 9)


class FunctionReranker:
    """Wrap ``factory() -> score(queries, texts) -> scores`` such as a cross-encoder."""

    def __init__(self, factory: Callable[[], Callable[[list[str], list[str]], np.ndarray]]):
        self.factory = factory

    def score(self, query: Column, text: Column) -> Column:
        factory = self.factory

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            score = factory()
            for queries, texts in batches:
                yield pd.Series(np.asarray(score(queries.tolist(), texts.tolist()), dtype=float))

        return run(query, text)


class MockGenerator:
    def generate(self, prompt: Column, question: Column) -> Column:
        return mock_answer(prompt)


class CitingGenerator:
    """Deterministic stand-in that answers with the first source, for tests of citation binding."""

    def generate(self, prompt: Column, question: Column) -> Column:
        return F.concat(question, F.lit(" [Source 1]"))


class FunctionGenerator:
    """Wrap ``factory() -> generate(prompts) -> answers``; a prompt that fails gets the failure as its answer."""

    def __init__(self, factory: Callable[[], Callable[[list[str]], list[str]]]):
        self.factory = factory

    def generate(self, prompt: Column, question: Column) -> Column:
        factory = self.factory

        def answer_one(generate, prompt: str) -> str:
            try:
                return generate([prompt])[0]
            except Exception as error:  # noqa: BLE001 - the text of the failure is the answer
                return GENERATION_ERROR.format(error=error)

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            generate = factory()
            for prompts in batches:
                asked = prompts.tolist()
                try:
                    answers = generate(asked)
                except Exception:  # noqa: BLE001 - some prompt fails: each is tried by itself
                    answers = [answer_one(generate, p) for p in asked]
                yield pd.Series(answers)

        return run(prompt)


def encode_table(
    chunks: DataFrame, encoder: Encoder, id_col: str = "chunk_id", text_col: str = "text"
) -> DataFrame:
    return chunks.select(F.col(id_col).alias("chunk_id"), encoder.encode(F.col(text_col)).alias("embedding"))


def encode_missing(chunks: DataFrame, done: DataFrame, encoder: Encoder) -> DataFrame:
    """Encode only chunks without a vector, to continue after a stop."""
    return encode_table(chunks.join(done.select("chunk_id"), "chunk_id", "left_anti"), encoder)
