"""Language of a text: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte n-grams of the letters of a text, words parted by single spaces. Each
n-gram is hashed to a bucket that has an embedding; a text is the mean of its embeddings, and
a linear layer with softmax gives the languages. Embeddings and layer are trained by stochastic
gradient descent in NumPy on the driver, on a sample of labelled texts. Its size is bounded,
however many languages there are, by ``SAMPLE_TEXTS`` and ``SAMPLE_BYTES``, and that of the model
by ``TABLE_ENTRIES``. Prediction uses every text whole.

Because everything after the lookup is linear, a trained model is one table with a row of
logits per bucket. The softmax is calibrated by a temperature fitted on documents that the
descent did not see, and a text is rejected if its calibrated score does not exceed the score
of a text that tells nothing, one over the number of languages, by ``REJECT_MARGIN`` of the
way to certainty. A text written in two or three of the languages is above that.

The score cannot tell a foreign text whose n-grams are all known. So a text is rejected as well
if its n-grams are too improbable for the mixture of its languages that fits it best. The bound
is set on the documents that the descent did not see: they are clean text as they are, foreign
text to the model of the other languages, and junk with their letters shuffled or redrawn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Different texts in the training sample: of a language, of all, and bytes of all, as expected
#: values of a draw by hash.
SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS, SAMPLE_BYTES = 1500, 10_000, 100_000_000

#: Of a training text with more bytes than this, so many pieces of so many characters are learnt
#: from, evenly spread over the whole text.
LONG_BYTES, PIECES, PIECE = 50_000, 20, 1000

#: Entries of a table with a value per bucket and language; buckets are halved until it holds.
TABLE_ENTRIES = 1 << 24

#: Up to so many languages their shares go to every task; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000

#: Share of the way from chance to certainty that a score must make.
REJECT_MARGIN = 0.1

#: Share of clean text that the bound on improbable n-grams may reject, and share of foreign and
#: of junk texts that it shall reject; the first goes first if both cannot be had.
CLEAN_LOSS, STRANGE_REJECTED = 0.001, 0.95

#: Languages that a text may mix, steps that fit their shares, and share of n-grams that are like
#: none of the language's.
MIXED, MIXING_STEPS, UNLIKE = 3, 4, 0.05

#: Different n-grams of a text from which on its mean varies by its subject more than by chance.
SETTLED = 1000

#: Lengths of the n-grams in bytes, buckets (a power of two) and width of an embedding.
NGRAMS, BUCKET_BITS, WIDTH = (2, 3, 4), 18, 16

#: Steps of the descent, however small the sample is, texts in a step, n-grams drawn from a text,
#: and step size.
STEPS, BATCH, DRAWN, RATE = 2000, 32, 192, 2.0

#: N-grams of a text that are kept, at random, for the steps to draw from.
KEPT_GRAMS = 2000

#: Share of the sample that calibrates, and temperatures tried.
CALIBRATION, TEMPERATURES = 0.2, tuple(float(t) for t in np.geomspace(0.02, 20, 61))

#: Bytes of a text that are looked up at once.
CHUNK = 1 << 20

#: Language of a text without letters.
UNDETERMINED = "und"

RESULT = "lang_pred string, score double, rejected boolean"

_NO_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIER = 2654435761  # odd, near 2 ** 32 divided by the golden ratio


def letters_of(text: str | None) -> bytes:
    """Lower-case words of letters, single spaces around them; empty if there is no letter."""
    words = _NO_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return f" {words} ".encode() if any(map(str.isalpha, words)) else b""


def buckets_of(letters: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Buckets of all n-grams that start in a part of the letters and span no space inside."""
    stop = len(letters) if stop is None else stop
    part = np.frombuffer(letters, dtype=np.uint8)[start : stop + max(NGRAMS) - 1].astype(np.uint32)
    found, code, inside = [], part.copy(), np.ones(len(part), dtype=bool)
    for size in range(2, max(NGRAMS) + 1):
        code = code[:-1] | (part[size - 1 :] << np.uint32(8 * (size - 1)))
        if size > 2:
            inside = inside[:-1] & (part[size - 2 : -1] != 32)
        else:
            inside = inside[:-1]
        if size in NGRAMS:
            count = min(len(code), stop - start)
            kept = code[:count][inside[:count]]
            mixed = (kept ^ np.uint32(size * 0x9E3779)) * np.uint32(_MULTIPLIER)
            found.append(mixed >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, dtype=np.int64)


@dataclass
class LanguageModel:
    """``logits`` has a row for each bucket; a text's logits are their mean. ``shares`` is the
    probability of each bucket in each language, ``usual`` the mean surprise of a language's texts
    and ``bound`` the strangeness from which on a text is rejected."""

    languages: list[str]
    logits: np.ndarray
    temperature: float
    shares: np.ndarray | None = None
    usual: np.ndarray | None = None
    bound: float = float("inf")
    rates: dict[str, float] = field(default_factory=dict)
    bits: int = BUCKET_BITS

    def buckets(self, letters: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
        return buckets_of(letters, start, stop) >> (BUCKET_BITS - self.bits)

    def grams(self, letters: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The different buckets of a text, ascending, and their numbers."""
        if len(letters) <= CHUNK:
            return np.unique(self.buckets(letters), return_counts=True)
        times = np.zeros(1 << self.bits, dtype=np.int64)
        for start in range(0, len(letters), CHUNK):
            buckets = self.buckets(letters, start, min(start + CHUNK, len(letters)))
            times += np.bincount(buckets, minlength=len(times))
        own = np.flatnonzero(times)
        return own, times[own]

    def _mean_logits(self, own: np.ndarray, times: np.ndarray) -> np.ndarray:
        total = times.astype(np.float64) @ self.logits[own].astype(np.float64)
        return total / max(int(times.sum()), 1)

    def text_logits(self, letters: bytes) -> np.ndarray:
        return self._mean_logits(*self.grams(letters))

    def strangeness(
        self, own: np.ndarray, times: np.ndarray, logits: np.ndarray, without: int | None = None
    ) -> float:
        """Surprise per n-gram beyond the usual one, in units of what chance gives a text with so
        many different n-grams. ``without`` leaves a language out."""
        order = [k for k in np.argsort(-logits) if k != without][:MIXED]
        likely, total = self.shares[own][:, order], times.sum()
        parts = np.full(len(order), 1 / len(order))
        for _ in range(MIXING_STEPS):
            held = likely * parts
            parts = (times / held.sum(axis=1)) @ held / total
        surprise = -(times @ np.log(likely @ parts)) / total
        return float((surprise - self.usual[order] @ parts) / np.sqrt(1 / len(own) + 1 / SETTLED))

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        rows = []
        for text in texts:
            letters = letters_of(text)
            if not letters or not self.languages:
                rows.append((UNDETERMINED, 0.0, True))
                continue
            own, times = self.grams(letters)
            logits = self._mean_logits(own, times)
            chance = _softmax(logits[None] / self.temperature)[0]
            best = int(chance.argmax())
            score = float(chance[best])
            rejected = score < self.least_score()
            if self.shares is not None and len(own):
                rejected = rejected or self.strangeness(own, times, logits) > self.bound
            rows.append((self.languages[best], score, rejected))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    def least_score(self) -> float:
        chance = 1 / len(self.languages)
        return chance + REJECT_MARGIN * (1 - chance)


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def fit(texts: list[str], languages: list[str], seed: int = 7) -> LanguageModel:
    """Train and calibrate a model; the same rows in the same order give the same model."""
    names = sorted(set(languages))
    places = {name: k for k, name in enumerate(names)}
    target = np.array([places[name] for name in languages], dtype=np.int64)
    draw = np.random.default_rng(seed)
    bits = min(BUCKET_BITS, (TABLE_ENTRIES // max(len(names), 1)).bit_length() - 1)
    grams = []
    for text in texts:
        own = buckets_of(letters_of(text)) >> (BUCKET_BITS - bits)
        kept = draw.choice(own, KEPT_GRAMS, replace=False) if len(own) > KEPT_GRAMS else own
        grams.append(kept.astype(np.int32))
    usable = np.array([i for i, g in enumerate(grams) if len(g)], dtype=np.int64)
    draw.shuffle(usable)
    held = usable[: int(len(usable) * CALIBRATION)]
    learnt = usable[len(held) :]
    size = 1 << bits
    table = draw.uniform(-1 / WIDTH, 1 / WIDTH, (size, WIDTH)).astype(np.float32)
    layer = np.zeros((len(names), WIDTH), dtype=np.float32)
    met = np.zeros(size, dtype=bool)
    for step in range(STEPS if len(learnt) else 0):
        rows = draw.choice(learnt, BATCH)
        drawn = np.stack([draw.choice(grams[i], DRAWN) for i in rows])
        met[drawn] = True
        mean = table[drawn].mean(axis=1)
        error = _softmax(mean @ layer.T)
        error[np.arange(BATCH), target[rows]] -= 1
        error *= RATE * (1 - step / STEPS) / BATCH
        back = error @ layer
        layer -= error.T @ mean
        np.subtract.at(table, drawn.ravel(), np.repeat(back * BATCH / DRAWN, DRAWN, axis=0))
    table[~met] = 0
    model = LanguageModel(names, table @ layer.T, 1.0, bits=bits)
    if len(held):
        logits = np.stack([model.text_logits(letters_of(texts[i])) for i in held])
        losses, doubt = [], 1 / (len(held) + 2)  # as if one more text had been taken for another
        for t in TEMPERATURES:
            right = _softmax(logits / t)[np.arange(len(held)), target[held]]
            wrong = (1 - right) / max(len(names) - 1, 1)
            loss = (1 - doubt) * np.log(right + 1e-12) + doubt * np.log(wrong + 1e-12)
            losses.append(-loss.mean())
        model.temperature = TEMPERATURES[int(np.argmin(losses))]
        counts = np.zeros((size, len(names)), dtype=np.float32)
        for i in learnt:
            np.add.at(counts[:, target[i]], grams[i], 1)
        if counts.any(axis=0).all():
            counts /= counts.sum(axis=0, dtype=np.float64)
            model.shares = (1 - UNLIKE) * counts + UNLIKE / size
            set_bound(model, [letters_of(texts[i]) for i in held], target[held], draw)
    return model


def set_bound(
    model: LanguageModel, clean: list[bytes], target: np.ndarray, draw: np.random.Generator
) -> None:
    """Set ``usual``, ``bound`` and ``rates`` by clean texts that the model was not trained on."""
    model.usual = np.zeros(len(model.languages))
    read = [model.grams(letters) for letters in clean]
    logits = [model._mean_logits(*grams) for grams in read]
    sizes = np.array([len(own) for own, _ in read])
    own = np.array([model.strangeness(*g, x) for g, x in zip(read, logits, strict=True)])
    surprise, weight = own * np.sqrt(1 / sizes + 1 / SETTLED), np.minimum(sizes, SETTLED)
    for k in range(len(model.usual)):
        rows = target == k if (target == k).any() else np.ones(len(target), dtype=bool)
        model.usual[k] = np.average(surprise[rows], weights=weight[rows])
    kinds: dict[str, list[float]] = {"clean": [], "foreign": [], "shuffled": [], "random": []}
    for letters, grams, x, k in zip(clean, read, logits, target, strict=True):
        kinds["clean"].append(model.strangeness(*grams, x))
        if len(model.languages) > 1:
            kinds["foreign"].append(model.strangeness(*grams, x, int(k)))
        marks = list(letters.decode())
        alphabet = sorted(set(marks) - {" "})
        redrawn = [m if m == " " else alphabet[i] for m, i in zip(marks, draw.integers(0, len(alphabet), len(marks)), strict=True)]
        for kind, made in (("shuffled", draw.permutation(marks).tolist()), ("random", redrawn)):
            junk = model.grams(letters_of("".join(made)))
            if len(junk[0]):
                kinds[kind].append(model.strangeness(*junk, model._mean_logits(*junk)))
    least = np.quantile(kinds["clean"], 1 - CLEAN_LOSS, method="higher")
    most = min(np.quantile(v, 1 - STRANGE_REJECTED) for k, v in kinds.items() if v and k != "clean")
    least = max(float(least), 0.5)
    model.bound = float(np.sqrt(least * most)) if most > least else least
    model.rates = {k: float(np.mean(np.array(v) > model.bound)) for k, v in kinds.items() if v}


def training_sample(
    docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, texts: int = SAMPLE_TEXTS
) -> pd.DataFrame:
    """About ``per_language`` different texts of each language, about ``texts`` and
    ``SAMPLE_BYTES`` in all, each language with an equal part of these.

    Texts are drawn by a hash, so equal ones together, and kept once for each language; copies do
    not change the share. Rows without text or ``lang`` are not drawn. Of a text of over
    ``LONG_BYTES`` pieces from start to end are taken.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select(
        "lang", "text", F.xxhash64("text").alias("_hash")
    )
    size = F.least(F.octet_length("text"), F.lit(LONG_BYTES)).alias("_size")
    different = labelled.select("lang", "_hash", size).distinct()
    counts = different.groupBy("lang").agg(F.count("*").alias("_n"), F.avg("_size").alias("_mean"))
    counts = materialize(counts, "language-counts")
    languages = counts.count()
    if not languages:
        return pd.DataFrame({"lang": [], "text": []}, dtype=object)
    most = F.least(
        F.lit(float(per_language)), F.lit(texts / languages), F.lit(SAMPLE_BYTES / languages) / F.col("_mean")
    )
    shares = counts.select("lang", (most * (1 << 30) / F.col("_n")).alias("_share"))
    if languages <= BROADCAST_LANGUAGES:
        shares = F.broadcast(shares)
    drawn = labelled.join(shares, "lang")
    drawn = drawn.filter(F.pmod("_hash", F.lit(1 << 30)) < F.col("_share"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(PIECES - 1)),
        lambda i: F.substr(
            "text", (i * F.char_length("text") / PIECES).cast("int") + 1, F.lit(PIECE)
        ),
    )
    long = F.octet_length("text") > LONG_BYTES
    text = F.when(long, F.concat_ws(" ", pieces)).otherwise(F.col("text")).alias("text")
    drawn = drawn.select("lang", "text").distinct().select("lang", text)
    return drawn.toPandas().sort_values(["lang", "text"], ignore_index=True)


def fit_documents(docs: DataFrame) -> LanguageModel:
    """A model trained on a sample of the labelled rows of ``docs`` (``text``, ``lang``)."""
    sample = training_sample(docs)
    if sample.empty:
        return LanguageModel([], np.zeros((0, 0)), 1.0)
    return fit(sample.text.tolist(), sample.lang.tolist())


def learnable(doc_id: Column) -> Column:
    """False for the quarter of documents that is held out: crc32 of the id, modulo 4, is 2."""
    held_out = F.crc32(doc_id.cast("string")) % 4 == 2
    return ~F.coalesce(held_out, F.lit(False))


def predict(text: Column, model: LanguageModel, docs: DataFrame) -> Column:
    """``lang_pred``, calibrated ``score`` and ``rejected`` of a text.

    NULL, empty texts and texts without a letter are ``und`` with score 0 and rejected, and so is every
    text if the model knows no language. Nothing but the text is used; ``docs`` gives the
    session.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield shared.value.predict(list(batch))

    return scan(text)


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language the model does not reject, columns as before.

    Needs ``doc_id``, ``text`` and ``lang``; the model learns from the rows that are not held
    out. Other columns pass through, whatever their names. If no row is labelled there is no
    model, and then no row is rejected for its score; texts without letters still go.
    """
    model = fit_documents(docs.filter(learnable(F.col("doc_id"))))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    if not model.languages:
        return packed.filter(F.rlike(F.col("_row.text"), F.lit(r"\p{L}"))).select("_row.*")
    found = packed.withColumn("_found", predict(F.col("_row.text"), model, docs))
    return found.filter(~F.col("_found.rejected")).select("_row.*")
