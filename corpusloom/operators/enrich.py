"""Batch translation: a backend per worker, positions kept, resumed by what is done and not by a cursor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..corpus import SENTENCE
from ..functions.morph import blank


class Backend(Protocol):
    def translate_batch(self, texts: list[str]) -> list[str | None]: ...


class Identity:
    """Stands in where no model is at hand."""

    def translate_batch(self, texts: list[str]) -> list[str | None]:
        return list(texts)


class Fallback:
    """The first backend for the whole batch, the second where the first fails."""

    def __init__(self, first: Backend, second: Backend):
        self.first, self.second = first, second

    def translate_batch(self, texts: list[str]) -> list[str | None]:
        try:
            return self.first.translate_batch(texts)
        except Exception:  # noqa: BLE001  any failure of a backend means the other one
            return self.second.translate_batch(texts)


def translate(sentences: DataFrame, make: Callable[[], Backend] = Identity, text: str = "sentence", batch: int = 64) -> DataFrame:
    """Sentences with a translation; blank texts are skipped and keep their place."""
    kinds = {f.name: f.dataType.simpleString() for f in sentences.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in sentences.columns), "translation string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for b in batches:
            out: list[str | None] = [None] * len(b)
            want = [i for i, t in enumerate(b[text]) if t is not None and t.strip()]
            for k in range(0, len(want), batch):
                part = want[k : k + batch]
                for i, t in zip(part, backend.translate_batch([b[text].iloc[i] for i in part]), strict=True):
                    out[i] = t
            yield b.assign(translation=out)

    return sentences.mapInPandas(run, schema)


def remaining(sentences: DataFrame, done: DataFrame, text: str = "sentence") -> DataFrame:
    """What a resumed run still has to do."""
    return sentences.where(~blank(F.col(text))).join(done.select(*SENTENCE), SENTENCE, "left_anti")


def batch(sentences: DataFrame, most: int) -> DataFrame:
    """The first sentences in corpus order, for a run of limited length."""
    return sentences.orderBy(*SENTENCE).limit(most)
