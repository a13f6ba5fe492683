"""Main text of web pages by a recurrent labeller of their blocks.

A page is a sequence of leaf blocks. Each block is a vector: the mean embedding of the different
names on its path (elements, classes and ids), the mean hashed embedding of its words, and a few
counts. A bidirectional LSTM reads the sequence, so the label of each block - article or not -
depends on the whole page. Embeddings and LSTM are trained together, in NumPy on the driver,
on pages that :mod:`training_pages` makes by rule; a process trains once and tasks get the
weights. Names and words that training never met have the embedding zero.

All of a page is read, parsed and labelled inside the task that holds its row: no shuffle,
nothing that grows on the driver.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, Path, bucket, leaf_blocks
from .training_pages import PageMaker

#: Hash buckets and widths of the embeddings of path names and of words; units per direction.
PATH_BUCKETS, PATH_WIDTH, WORD_BUCKETS, WORD_WIDTH, UNITS = 2048, 24, 4096, 8, 24

#: Pages to train on, passes, pages in a step, step size, and the seed of pages and weights.
TRAINING_PAGES, EPOCHS, BATCH, RATE, SEED = 700, 12, 16, 0.004, 11

#: Share of words, and of blocks whose words are all left out, in training, so that the labels
#: lean on markup and shape.
WORD_DROPOUT, BLOCK_DROPOUT = 0.3, 0.4

#: Steps of a sequence whose inputs are held at once, and blocks that are labelled together.
SEGMENT, TOGETHER = 2048, 20_000

_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_MARKS = re.compile(r"[.,;:!?]")
N_COUNTS = 8


def _counts(block: Block) -> list[float]:
    text, size = block.text, len(block.text)
    last = "".join(block.path.last(1))
    return [
        np.log1p(size) / 5,
        block.link_chars / size,
        np.log1p(text.count(" ")) / 4,
        10 * len(_MARKS.findall(text)) / size,
        float(text[-1] in ".!?"),
        len(_DIGIT.findall(text)) / size,
        float(re.fullmatch("h[1-6]", last) is not None),
        float("©" in text),
    ]


class _WordBuckets(dict):
    """Bucket of a word, hashed when it is first asked for."""

    def __missing__(self, word: str) -> int:
        found = self[word] = bucket(word, WORD_BUCKETS)
        return found


class Features:
    """Hashed names and words of blocks, each different one looked up once."""

    def __init__(self) -> None:
        self.words = _WordBuckets()
        self.sums: dict[tuple[str, ...], np.ndarray] = {}

    def bags(self, block: Block) -> tuple[list[int], list[int], list[float]]:
        """Buckets of the different names on the path and of the words, and the counts."""
        names = [*block.path.different(), *_ends(block.path)]
        return [bucket(n, PATH_BUCKETS) for n in names] or [0], self.word_bag(block), _counts(block)

    def word_bag(self, block: Block) -> list[int]:
        if len(self.words) > 100_000:
            self.words = _WordBuckets()
        return list(map(self.words.__getitem__, _WORD.findall(block.text.lower()))) or [0]

    def sum_of(self, names: tuple[str, ...], table: np.ndarray) -> np.ndarray:
        found = self.sums.get(names)
        if found is None:
            if len(self.sums) > 20_000:
                self.sums = {}
            rows = [bucket(n, PATH_BUCKETS) for n in names]
            found = self.sums[names] = table[rows].sum(axis=0, dtype=np.float64)
        return found

    def summed(self, block: Block, table: np.ndarray) -> tuple[np.ndarray, list[int], list[float]]:
        """As :meth:`bags`, with the mean embedding of the names in place of their buckets. It is
        summed downwards, so a path costs what its last element adds."""
        waiting, at = [], block.path
        while at is not None and at.total is None:
            waiting.append(at)
            at = at.above
        total = at.total if at is not None else (np.zeros(table.shape[1]), 0)
        for at in reversed(waiting):
            if at.fresh:
                total = total[0] + self.sum_of(at.fresh, table), total[1] + len(at.fresh)
            at.total = total
        ends = _ends(block.path)
        many = total[1] + len(ends)
        mean = (total[0] + self.sum_of(ends, table)) / many if many else table[0]
        return mean, self.word_bag(block), _counts(block)


def _ends(path: Path) -> tuple[str, ...]:
    return tuple(f"{name}$" for name in path.last(2))


def _mean_rows(table: np.ndarray, bags: list[list[int]]) -> np.ndarray:
    flat = np.fromiter(itertools.chain.from_iterable(bags), dtype=np.int64)
    sizes = np.array([len(bag) for bag in bags])
    return np.add.reduceat(table[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as (step, page, value) and the lengths."""
    sizes = np.array([len(r) for r in rows])
    out = np.zeros((sizes.max(), len(rows), rows[0].shape[1]), dtype=np.float32)
    for i, row in enumerate(rows):
        out[: len(row), i] = row
    return out, sizes


def _turn(sequences: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every sequence reversed inside its own length; padding stays at the end."""
    steps = np.arange(len(sequences))[:, None]
    place = np.where(steps < sizes, sizes - 1 - steps, steps)
    return np.take_along_axis(sequences, place[:, :, None], axis=0)


class Recurrent:
    """One direction of the LSTM; gates are input, forget, output and candidate."""

    def __init__(self, weights: dict[str, np.ndarray], name: str):
        self.w, self.u, self.b = (weights[f"{name}_{k}"] for k in "wub")
        self.units = self.u.shape[0]

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step. ``keep`` gets what :meth:`back` needs."""
        units, pages = self.units, x.shape[1]
        h, c = (np.zeros((pages, units), dtype=np.float32) for _ in range(2))
        out = np.empty((len(x), pages, units), dtype=np.float32)
        for start in range(0, len(x), SEGMENT):
            part = x[start : start + SEGMENT]
            flat = part.reshape(-1, part.shape[2]) @ self.w + self.b
            for step, gate in enumerate(flat.reshape(len(part), pages, -1), start):
                gate = gate + h @ self.u
                gate[:, : 3 * units] /= 2
                gate = np.tanh(gate)  # the logistic function is a tanh of half its argument
                ifo, g = (gate[:, : 3 * units] + 1) / 2, gate[:, 3 * units :]
                i, f, o = ifo[:, :units], ifo[:, units : 2 * units], ifo[:, 2 * units :]
                before, old = c, h
                c = f * c + i * g
                t = np.tanh(c)
                h = o * t
                out[step] = h
                if keep is not None:
                    keep.append((i, f, o, g, before, t, old))
        return out

    def back(self, x: np.ndarray, kept: list, error: np.ndarray) -> tuple[np.ndarray, dict]:
        """Error of the inputs, and of the weights, from that of the states."""
        gates = np.empty((len(x), x.shape[1], 4 * self.units), dtype=np.float32)
        dh = np.zeros_like(kept[0][0])
        dc = np.zeros_like(dh)
        du = np.zeros_like(self.u)
        for step in range(len(x) - 1, -1, -1):
            i, f, o, g, before, t, old = kept[step]
            dh = dh + error[step]
            dc = dc + dh * o * (1 - t * t)
            gate = np.concatenate(
                [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)],
                axis=1,
            )
            gates[step] = gate
            du += old.T @ gate
            dh, dc = gate @ self.u.T, dc * f
        flat = gates.reshape(-1, gates.shape[2])
        dw = x.reshape(-1, x.shape[2]).T @ flat
        return gates @ self.w.T, {"w": dw, "u": du, "b": flat.sum(axis=0)}


class BlockLabeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, seed: int) -> BlockLabeller:
        draw, width = np.random.default_rng(seed), PATH_WIDTH + WORD_WIDTH + N_COUNTS
        weights = {
            "path": draw.normal(0, 0.3, (PATH_BUCKETS, PATH_WIDTH)),
            "word": draw.normal(0, 0.1, (WORD_BUCKETS, WORD_WIDTH)),
            "out": draw.normal(0, 0.2, (2 * UNITS, 1)),
            "bias": np.zeros(1),
        }
        for name in ("ahead", "behind"):
            weights[f"{name}_w"] = draw.normal(0, width**-0.5, (width, 4 * UNITS))
            weights[f"{name}_u"] = draw.normal(0, UNITS**-0.5, (UNITS, 4 * UNITS))
            weights[f"{name}_b"] = np.concatenate([np.zeros(UNITS), np.ones(UNITS), np.zeros(2 * UNITS)])
        return cls({k: v.astype(np.float32) for k, v in weights.items()})

    def inputs(self, bags: list[tuple]) -> np.ndarray:
        paths, words, counts = zip(*bags, strict=True)
        if isinstance(paths[0], list):
            paths = _mean_rows(self.weights["path"], list(paths))
        words = _mean_rows(self.weights["word"], list(words))
        return np.concatenate([np.array(paths), words, np.array(counts)], axis=1).astype(np.float32)

    def logits(self, pages: list[list[tuple]]) -> list[np.ndarray]:
        """One value per block; above 0 means article."""
        x, sizes = _pad([self.inputs(page) for page in pages])
        ahead = Recurrent(self.weights, "ahead").run(x)
        behind = _turn(Recurrent(self.weights, "behind").run(_turn(x, sizes)), sizes)
        out = np.concatenate([ahead, behind], axis=2) @ self.weights["out"] + self.weights["bias"]
        return [out[:size, i, 0] for i, size in enumerate(sizes)]

    def gradient(self, pages: list[list[tuple]], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradient of the mean logistic loss over all blocks."""
        rows = [self.inputs(page) for page in pages]
        x, sizes = _pad(rows)
        turned = _turn(x, sizes)
        directions = {name: Recurrent(self.weights, name) for name in ("ahead", "behind")}
        kept: dict[str, list] = {"ahead": [], "behind": []}
        ahead = directions["ahead"].run(x, kept["ahead"])
        behind = _turn(directions["behind"].run(turned, kept["behind"]), sizes)
        states = np.concatenate([ahead, behind], axis=2)
        out = (states @ self.weights["out"] + self.weights["bias"])[:, :, 0]
        error = np.zeros_like(out)
        for i, label in enumerate(labels):
            error[: sizes[i], i] = _sigmoid(out[: sizes[i], i]) - label
        error = (error / sizes.sum())[:, :, None]
        found = {"out": np.einsum("tbk,tbo->ko", states, error), "bias": error.sum(axis=(0, 1))}
        up = error @ self.weights["out"].T
        dx, of = directions["ahead"].back(x, kept["ahead"], up[:, :, :UNITS])
        found |= {f"ahead_{k}": v for k, v in of.items()}
        dy, of = directions["behind"].back(turned, kept["behind"], _turn(up[:, :, UNITS:], sizes))
        found |= {f"behind_{k}": v for k, v in of.items()}
        dx = dx + _turn(dy, sizes)
        for name, place in (("path", 0), ("word", 1)):
            start = 0 if place == 0 else PATH_WIDTH
            stop = PATH_WIDTH if place == 0 else PATH_WIDTH + WORD_WIDTH
            table = np.zeros_like(self.weights[name])
            for i, page in enumerate(pages):
                bags = [block[place] for block in page]
                many = np.array([len(bag) for bag in bags])
                own = np.repeat(dx[: len(page), i, start:stop] / many[:, None], many, axis=0)
                np.add.at(table, np.fromiter((n for bag in bags for n in bag), dtype=np.int64), own)
            found[name] = table
        return found


def _examples(count: int, seed: int) -> tuple[list[list[tuple]], list[np.ndarray]]:
    maker, features = PageMaker(seed), Features()
    blocks = [b for b in (leaf_blocks(maker.page()) for _ in range(count)) if b]
    labels = [np.array([block.keep for block in page], dtype=np.float32) for page in blocks]
    return [[features.bags(block) for block in page] for page in blocks], labels


@functools.lru_cache(maxsize=1)
def trained_labeller() -> BlockLabeller:
    """The labeller, trained by Adam; the same weights in every process."""
    model, draw = BlockLabeller.fresh(SEED), np.random.default_rng(SEED)
    pages, labels = _examples(TRAINING_PAGES, SEED)
    met = {"path": np.zeros(PATH_BUCKETS, dtype=bool), "word": np.zeros(WORD_BUCKETS, dtype=bool)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    steps, step = EPOCHS * -(-len(pages) // BATCH), 0
    for _ in range(EPOCHS):
        order = sorted(draw.permutation(len(pages)), key=lambda i: len(pages[i]))
        batches = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
        for at in draw.permutation(len(batches)):
            chosen = []
            for i in batches[at]:
                page = []
                for path, words, counts in pages[i]:
                    left_out = 1.0 if draw.random() < BLOCK_DROPOUT else WORD_DROPOUT
                    words = [w for w in words if draw.random() >= left_out] or [0]
                    met["path"][path] = True
                    met["word"][words] = True
                    page.append((path, words, counts))
                chosen.append(page)
            found = model.gradient(chosen, [labels[i] for i in batches[at]])
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for name, gradient in found.items():
                first, second = moments[name]
                first += 0.1 * (gradient - first)
                second += 0.001 * (gradient * gradient - second)
                change = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                model.weights[name] = (model.weights[name] - rate * change).astype(np.float32)
    for name, seen in met.items():
        model.weights[name][~seen] = 0
    return model


def extract(pages: list[str | None], model: BlockLabeller, features: Features) -> list[str]:
    """Main text of each page, blocks joined by line breaks."""
    texts = [""] * len(pages)
    waiting: list[tuple[int, list[str], list[tuple]]] = []

    def label() -> None:
        waiting.sort(key=lambda item: len(item[1]))
        at = 0
        while at < len(waiting):
            stop = at + 1
            while stop < len(waiting) and (stop + 1 - at) * len(waiting[stop][1]) <= TOGETHER:
                stop += 1
            group = waiting[at:stop]
            for (place, blocks, _), logit in zip(group, model.logits([g[2] for g in group]), strict=True):
                texts[place] = "\n".join(b for b, keep in zip(blocks, logit > 0, strict=True) if keep)
            at = stop
        waiting.clear()

    held = 0
    for place, page in enumerate(pages):
        blocks = leaf_blocks(page)
        if blocks:
            bags = [features.summed(b, model.weights["path"]) for b in blocks]
            waiting.append((place, [b.text for b in blocks], bags))
            held += len(blocks)
        if held >= TOGETHER:
            label()
            held = 0
    label()
    return texts


def main_text(html: Column, docs: DataFrame) -> Column:
    """The article of a page: blocks in page order joined by one line break.

    White space inside a block is one space, character references are decoded. NULL, empty
    pages and pages without an article give the empty text. A page is read whole, whatever
    its length; equal pages give equal texts. ``docs`` gives the session.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained_labeller().weights)

    @F.pandas_udf("string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, features = BlockLabeller(shared.value), Features()
        for batch in batches:
            yield pd.Series(extract(list(batch), model, features), dtype="object")

    return scan(html)
