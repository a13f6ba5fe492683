"""Benchmark passages in documents, by backward search in an FM-index per shard.

A document word is hit if it lies in an occurrence of a *window*: 13 consecutive words of a
benchmark item, or a whole item of fewer words. Every task cuts its documents into shards of
a bounded number of bytes (a longer text is one by itself), and per shard

* keeps the stretches of text in which each pair of neighbouring words is also a pair of
  neighbours in some item - an occurrence of a window lies wholly in such a stretch, so
  nothing is lost and the index holds little besides passages;
* builds an FM-index of the stretches: suffix array, Burrows-Wheeler transform in a wavelet
  matrix, and every sixteenth suffix position;
* searches all windows at once, backwards, and locates their occurrences by walking to the
  next sampled position;
* merges the occurrences to spans.

The work of a row depends on its text alone: there is no shuffle, and hot passages or copies
change nothing. Windows are broadcast in blocks of a bounded number of item words, one at a time:
if there are more blocks, the result of each is written and taken up by the pass of the next.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .wavelet import WaveletMatrix

#: Words of a window.
WINDOW = 13

#: A document is contaminated from one hit word in so many words on.
CONTAMINATED = 20

#: Item words in one broadcast block; eight bytes of text count as one word at least.
BLOCK_WORDS = 500_000

#: Bytes of text from which on a shard is full, and bytes of a text that are cut into words at once.
SHARD_BYTES, CHUNK = 1 << 22, 1 << 20

#: Text positions between sampled suffix positions.
SAMPLE = 16

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")

RESULT = (
    "n_words long, n_hit long, items array<long>, spans array<struct<start: long, stop: long>>"
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z."""
    return _WORDS.findall(text.lower()) if text else []


def numbers_of(text: bytes | None, numbers: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text, 0 if it has none; the words are not held together."""
    lowered, found, at = (text or b"").lower(), [], 0
    while at < len(lowered):
        gap = _GAP.search(lowered, at + CHUNK)
        stop = gap.start() if gap else len(lowered)
        words = _WORDS.findall(lowered, at, stop)
        found.append(np.fromiter(map(numbers.get, words, itertools.repeat(0)), np.int64, len(words)))
        at = stop
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


@dataclass
class WindowBlock:
    """Windows of some items as word numbers (from 1), by window length."""

    numbers: dict[bytes, int]
    pairs: np.ndarray  # neighbouring words, first * (number of words + 1) + second, sorted
    windows: dict[int, np.ndarray]  # length -> one row per different window
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> window of each item, item id

    @classmethod
    def build(cls, items: list[tuple[int | None, list[bytes]]], window: int) -> WindowBlock:
        numbers: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        pairs: set[tuple[int, int]] = set()
        for item, words in items:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in words]
            pairs.update(zip(ids[:-1], ids[1:], strict=True))
            size = min(window, len(ids))
            own = found.setdefault(size, {}) if size else {}
            for i in range(len(ids) - size + 1 if size else 0):
                own.setdefault(tuple(ids[i : i + size]), set()).update(() if item is None else (item,))
        base = len(numbers) + 1
        codes = np.array(sorted(a * base + b for a, b in pairs), dtype=np.int64)
        windows, of_items = {}, {}
        for size, own in found.items():
            windows[size] = np.array(list(own), dtype=np.int64).reshape(-1, size)
            of = [(n, item) for n, named in enumerate(own.values()) for item in sorted(named)]
            table = np.array(of, dtype=np.int64).reshape(-1, 2)
            of_items[size] = (table[:, 0], table[:, 1])
        return cls(numbers, codes, windows, of_items)


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order by doubling; separators (0) count as different, in text order."""
    gaps = text == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, text + np.count_nonzero(gaps)).astype(np.int64)
    length, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.full(length, -1, dtype=np.int64)
        after[: max(length - step, 0)] = rank[step:]
        code = rank * (length + int(text.max()) + 2) + after + 1
        order = np.argsort(code, kind="stable")
        new = np.empty(length, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(code[order]) != 0)])
        rank, step = new, step * 2
        if rank[order[-1]] == length - 1:
            return order


class FMIndex:
    """Index of a text of word numbers in which 0 ends every stretch."""

    def __init__(self, text: np.ndarray):
        order = _suffix_array(text)
        before = text[order - 1]  # the last separator comes before position 0
        self.transform = WaveletMatrix.build(before, max(int(text.max()).bit_length(), 1))
        counts = np.bincount(text)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.length = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, and the range of suffixes that start with each."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.length)
        known = len(self.first) - 1
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[which, column]
            fits = symbol < known
            which, symbol, low, high = which[fits], symbol[fits], low[fits], high[fits]
            low = self.first[symbol] + self.transform.rank(symbol, low)
            high = self.first[symbol] + self.transform.rank(symbol, high)
            left = low < high
            which, low, high = which[left], low[left], high[left]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        moving = np.flatnonzero(~self.sampled[at])
        while len(moving):
            symbol = self.transform.access(at[moving])
            at[moving] = self.first[symbol] + self.transform.rank(symbol, at[moving])
            steps[moving] += 1
            moving = moving[~self.sampled[at[moving]]]
        return self.samples[self.sample_rank[at]] + steps


def _stretches(numbers: np.ndarray, doc: np.ndarray, block: WindowBlock) -> np.ndarray:
    """Positions to index; -1 where a stretch ends."""
    base, least = len(block.numbers) + 1, min(block.windows)
    pair = numbers[:-1] * base + numbers[1:]
    place = np.searchsorted(block.pairs, pair)
    place[place == len(block.pairs)] = 0
    linked = (numbers[:-1] > 0) & (numbers[1:] > 0) & (doc[:-1] == doc[1:])
    linked &= block.pairs[place] == pair if len(block.pairs) else False
    starts = np.flatnonzero(np.concatenate([[True], ~linked]))
    stops = np.concatenate([starts[1:], [len(numbers)]])
    kept = (stops - starts >= least) & (numbers[starts] > 0)
    starts, stops = starts[kept], stops[kept]
    sizes = stops - starts + 1
    place = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    place[np.cumsum(sizes) - 1] = -1
    return place


def scan_shard(
    texts: Sequence[bytes | None],
    blocks: list[WindowBlock],
    known: Sequence[tuple[Sequence[int], ...]] | None = None,
) -> pd.DataFrame:
    """Words, hit words, items and spans of each text of one shard.

    ``known`` has what other blocks have found: per text the items, and the starts and stops of the
    spans.
    """
    split = [numbers_of(text, blocks[0].numbers if blocks else {}) for text in texts]
    sizes = np.array([len(words) for words in split], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    hits = np.zeros(len(doc) + 1, dtype=np.int64)
    pairs: list[np.ndarray] = []
    for text, (items, begins, stops) in enumerate(known or ()):
        np.add.at(hits, starts[text] + np.asarray(begins, dtype=np.int64), 1)
        np.add.at(hits, starts[text] + np.asarray(stops, dtype=np.int64), -1)
        if len(items):
            pairs.append(np.stack([np.full(len(items), text), np.asarray(items, dtype=np.int64)]))
    for n, block in enumerate(blocks):
        if not block.windows or not len(doc):
            continue
        split = [numbers_of(text, block.numbers) for text in texts] if n else split
        numbers = np.concatenate(split)
        place = _stretches(numbers, doc, block)
        if not len(place):
            continue
        index = FMIndex(np.where(place < 0, 0, numbers[place]))
        for size, windows in block.windows.items():
            which, low, high = index.search(windows)
            many = high - low
            rows = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
            at = place[index.locate(rows)]
            np.add.at(hits, at, 1)
            np.add.at(hits, at + size, -1)
            found = np.unique(doc[at] * len(windows) + np.repeat(which, many))
            of_window, items = block.items[size]
            first = np.searchsorted(of_window, found % len(windows), side="left")
            last = np.searchsorted(of_window, found % len(windows), side="right")
            many = last - first
            named = np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)
            both = np.stack([np.repeat(found // len(windows), many), items[named]])
            pairs.append(np.unique(both, axis=1))
    hit = np.cumsum(hits[:-1]) > 0
    items = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
    cut = np.searchsorted(items[0], np.arange(len(texts) + 1))
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    fresh = np.zeros(len(doc), dtype=bool)
    fresh[starts[sizes > 0]] = True
    begin = np.flatnonzero((edge[:-1] == 1) | (hit & fresh)) if len(doc) else np.zeros(0, int)
    last = np.flatnonzero((edge[1:] == -1) | (hit & np.append(fresh[1:], True))) if len(doc) else begin
    spans: list[list[dict[str, int]]] = [[] for _ in texts]
    for a, b in zip(begin, last, strict=True):
        spans[doc[a]].append({"start": int(a - starts[doc[a]]), "stop": int(b + 1 - starts[doc[a]])})
    n_hit = np.bincount(doc[hit], minlength=len(texts)) if len(doc) else np.zeros(len(texts), int)
    return pd.DataFrame(
        {
            "n_words": sizes,
            "n_hit": n_hit.astype(np.int64),
            "items": [items[1][a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)],
            "spans": spans,
        }
    )


def window_blocks(
    benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS
) -> Iterator[WindowBlock]:
    """Blocks of windows, one at least. Only the words of one are held at a time; an item of more
    is cut into pieces that share all but one word of a window."""
    items, size = [], 0
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    for row in rows.toLocalIterator():
        words = words_of(row.text)
        for at in range(0, max(len(words) - window + 1, 1), block_words):
            piece = words[at : at + block_words + window - 1]
            items.append((row.item_id, piece))
            size += max(len(piece), sum(map(len, piece)) // 8)
            if size >= block_words:
                yield WindowBlock.build(items, window)
                items, size = [], 0
    yield WindowBlock.build(items, window)


def scan_batch(texts: Sequence[bytes | None], block: WindowBlock, known: list) -> pd.DataFrame:
    """:func:`scan_shard` for the shards of a batch."""
    found, at, size = [], 0, 0
    for stop, text in enumerate(texts, 1):
        size += len(text or b"")
        if size >= SHARD_BYTES or stop == len(texts):
            found.append(scan_shard(texts[at:stop], [block], known[at:stop]))
            at, size = stop, 0
    return pd.concat(found, ignore_index=True) if found else scan_shard([], [block])


def _overlap(text: Column, known: list[Column], shared: Broadcast) -> Column:
    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *earlier in batches:
            yield scan_batch(list(texts), shared.value, list(zip(*earlier, strict=True)))

    return scan(text.cast("binary"), *known)


def overlap(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """What of each text occurs in the benchmark: a struct ``row`` with all columns of ``docs``, and
    ``found`` with ``n_words``, ``n_hit``, ``items``, ``spans``.

    ``docs`` needs ``text``; other columns may have any names. ``benchmark`` has ``item_id`` (long)
    and ``text``. ``items`` are the ids of items with an occurring window, ascending and each once;
    ``spans`` are stretches of hit words (start, stop; stop excluded), merged where they touch. NULL
    and empty texts have no words, on either side; texts of any length are read whole, and repeated
    rows give a row each. An item without id makes hits but is not listed; equal items are
    listed both. An empty benchmark hits nothing.

    A block of windows is broadcast at a time. All but the last pass are written, with
    the rows, to the shared folder.
    """
    none = F.array().cast("array<long>")
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    known, shared = [none, none, none], None
    for block in window_blocks(benchmark, window, block_words):
        if shared is not None:
            found = materialize(found, "overlap")
            shared.unpersist()
            known = [F.col(f"found.{c}") for c in ("items", "spans.start", "spans.stop")]
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found = found.select("row", _overlap(F.col("row.text"), known, shared).alias("found"))
    return found


def contaminated(found: Column) -> Column:
    """The contamination rule on the result of :func:`overlap`."""
    hit = found["n_hit"]
    return (hit > 0) & (hit * CONTAMINATED >= found["n_words"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, columns as before.

    Needs ``text``; other columns pass through, whatever their names. Documents with fewer
    hits stay as they are.
    """
    found = overlap(docs, benchmark)
    return found.filter(~contaminated(F.col("found"))).select("row.*")
