"""Token counts of the sections of a document, from one encoding of the whole document.

Encoding sections one by one gives other tokens at their edges than the document has. Here the
document is encoded once, every token keeps the span of characters it stands for, and the spans
are joined with the sections by position. A token that crosses an edge is allocated whole to
the section that holds most of its characters, the earlier one of equals; so the counts of the
sections add up to the tokens of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, EncoderSource

COUNTED = "start array<long>, stop array<long>, n_tokens array<long>, n_crossing array<long>"


def line_starts(text: str | None) -> np.ndarray:
    """First characters of the lines of a text; a line keeps its line break."""
    lines = (text or "").split("\n")
    sizes = np.array([len(line) + 1 for line in lines], dtype=np.int64)
    return np.cumsum(sizes) - sizes


def allocate(
    spans: np.ndarray, starts: np.ndarray, stops: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token, and whether it crosses an edge.

    ``starts`` are ascending, and every token starts in a section. A token may lie across any
    number of sections.
    """
    first = np.searchsorted(starts, spans[:, 0], side="right") - 1
    last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1
    crossing = last > first
    section = first.copy()
    for token in np.flatnonzero(crossing):
        own = np.arange(first[token], last[token] + 1)
        held = np.minimum(stops[own], spans[token, 1]) - np.maximum(starts[own], spans[token, 0])
        section[token] = own[int(held.argmax())]
    return section, crossing


def count_sections(
    encoder: Encoder, texts: list[str | None], starts: list[np.ndarray]
) -> pd.DataFrame:
    """A row of arrays per text, with an entry per section."""
    rows, at = [], 0
    for spans, bases in encoder.encode_spans(texts):
        own = starts[at : at + len(bases)]
        lengths = np.array([len(text or "") for text in texts[at : at + len(bases)]])
        at += len(bases)
        many = np.array([len(s) for s in own], dtype=np.int64)
        cuts = np.cumsum(many)
        begin = np.concatenate([*own, np.zeros(0, dtype=np.int64)]) + np.repeat(bases, many)
        end = np.append(begin[1:], 0)
        end[cuts - 1] = bases + lengths
        section, crossing = allocate(spans, begin, end)
        tokens = np.bincount(section, minlength=len(begin))
        crossed = np.bincount(section[crossing], minlength=len(begin))
        values = (begin - np.repeat(bases, many), end - np.repeat(bases, many), tokens, crossed)
        rows += zip(*(np.split(v, cuts[:-1]) for v in values), strict=True) if len(bases) else []
    return pd.DataFrame(rows, columns=["start", "stop", "n_tokens", "n_crossing"])


def section_tokens(
    text: Column, docs: DataFrame, tokenizer: str, starts: Column | None = None, special: bool = False
) -> Column:
    """Sections of a text with their tokens: a struct of the arrays ``start``, ``stop``,
    ``n_tokens`` and ``n_crossing``, an entry for each section.

    ``starts`` is an array of the first characters of the sections, ascending from 0 (positions
    count code points); without it every line is a section and keeps its line break.
    ``n_crossing`` counts those tokens of a section that reach into another one. NULL and
    empty texts have one empty section. ``tokenizer`` is the path of a byte-level BPE file,
    ``special`` says whether its added tokens are looked for in texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(EncoderSource(tokenizer, True, special))

    @F.pandas_udf(COUNTED)
    def by_line(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = shared.value.encoder()
        for batch in batches:
            texts = list(batch)
            yield count_sections(encoder, texts, [line_starts(t) for t in texts])

    @F.pandas_udf(COUNTED)
    def by_start(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder = shared.value.encoder()
        for batch, given in batches:
            own = [np.array(s if s is not None and len(s) else [0], dtype=np.int64) for s in given]
            yield count_sections(encoder, list(batch), own)

    return by_line(text) if starts is None else by_start(text, starts)


def attribute_tokens(docs: DataFrame, tokenizer: str, special: bool = False) -> DataFrame:
    """One row per document and line: ``doc_id``, ``section`` (from 0), ``start``, ``stop``,
    ``n_tokens``, ``n_crossing``.

    Needs ``doc_id`` and ``text``; every row of ``docs`` has one section at least, repeated rows
    and NULL ids included. Empty in, empty out.
    """
    counted = section_tokens(F.col("text"), docs, tokenizer, special=special)
    found = docs.select("doc_id", counted.alias("_found"))
    names = ("start", "stop", "n_tokens", "n_crossing")
    zipped = F.arrays_zip(*[F.col(f"_found.{name}").alias(name) for name in names])
    rows = found.select("doc_id", F.posexplode(zipped).alias("section", "_one"))
    return rows.select("doc_id", "section", *[F.col(f"_one.{name}").alias(name) for name in names])
