"""Byte-level BPE encoding of whole texts with a cache of their pieces.

The tokenizer's rule never joins characters across a single space or line break with
non-space characters on both sides: such a space starts a piece, such a line break is one. So
a text may be cut before these spaces and around these line breaks, and the ids of the text
are those of the parts, one after the other. Parts are encoded by the tokenizers library, each
different one once while it is in the cache. Texts are cut and equal parts found in Arrow, for many
texts together, so Python sees each part once; new parts that start with a space go to it joined
to one text, and the bytes that each id stands for tell where a part ends. Parts that are a
single word of Latin letters need no cutting into words: they go to the file's BPE model with
white space as the only rule, in the byte alphabet of its vocabulary. The bytes of each id give the
characters that a token stands for as well, so the cache has ids alone but for added tokens.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts in the cache before it is emptied.
CACHE = 1_200_000

#: Parts that are encoded as one text.
JOINED = 8_000

#: Characters of texts whose parts are looked up together.
TOGETHER = 1 << 23

#: The same where the characters of all tokens are asked for, which take some 100 bytes a token.
TOGETHER_SPANS = 1 << 21

#: Parts whose tokens are put in place together.
PLACED = 1 << 20

_MARK = "\0"
_WORD = re.compile(r" [A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
_BREAK = re.compile(r"(?<=\S)(?= \S)")


def marked(text: str) -> str | None:
    """Text with a mark between its parts; None if its white space is not single spaces and line
    breaks between other characters, or a character does not print."""
    flat = text.replace("\n", " ")
    if not flat.isprintable() or "  " in flat or flat[:1] in ("", " ") or flat[-1] == " ":
        return None
    return text.replace(" ", f"{_MARK} ").replace("\n", f"{_MARK}\n{_MARK}")


def parts_of(text: str) -> list[str]:
    """Parts of a text that can be encoded one by one."""
    if not text:
        return []
    shown = marked(text)
    return _BREAK.split(text) if shown is None else shown.split(_MARK)


def placed(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions of the runs (start, size) that ``codes`` name, one after the other."""
    many = sizes[codes]
    ends = np.cumsum(many)
    return np.arange(int(many.sum())) + np.repeat(starts[codes] - (ends - many), many)


def byte_alphabet() -> dict[int, str]:
    """Character of the vocabulary for each byte: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}


class Encoder:
    """Encodes texts with a tokenizer given as its JSON.

    ``special``: markers like <|endoftext|> in a text are the tokenizer's added tokens, as in the
    library's own call; else they are ordinary text.
    """

    def __init__(self, tokenizer_json: str, offsets: bool = False, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = not special
        added = list(self.tokenizer.get_added_tokens_decoder().values()) if special else []
        self.whole = any(a.lstrip or a.rstrip or a.single_word for a in added)
        names = sorted((re.escape(a.content) for a in added), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(names)})") if names else None
        # a text is cut at added tokens, so a part is one or holds none, unless texts stay whole
        contents = {a.content for a in added}
        self.holds_added = self.added.search if self.whole else contents.__contains__
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.alphabet = byte_alphabet()
        self.offsets = offsets
        self.ids: dict[str, bytes] = {}
        self.spans: dict[str, np.ndarray] = {}  # of parts with added tokens
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():  # a character of the vocabulary is a byte
            self.sizes[number] = len(token)

    def _learn(self, parts: list[str]) -> None:
        """Encode those of different parts that the cache lacks. Nothing made here refers to itself, so looking for
        cycles among so many parts is put off."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            self._learn_parts(parts)
        finally:
            if collecting:
                gc.enable()

    def _learn_parts(self, parts: list[str]) -> None:
        if len(self.ids) > CACHE:
            self.ids, self.spans = {}, {}
        words, plain, others, named = [], [], [], []
        for part in parts:
            if part in self.ids:
                continue
            if self.holds_added(part):
                named.append(part)
            elif _WORD.fullmatch(part):
                words.append(part)
            elif part[0] == " " and part.count(" ") == 1 and len(part) > 1 and part.isprintable():
                plain.append(part)
            else:
                others.append(part)
        for at in range(0, len(words), JOINED):
            self._learn_joined(words[at : at + JOINED], True)
        for at in range(0, len(plain), JOINED):
            self._learn_joined(plain[at : at + JOINED], False)
        encode = self.tokenizer.encode_batch_fast
        for part, found in zip(others, encode(others, add_special_tokens=False), strict=True):
            self.ids[part] = np.array(found.ids, dtype="<u4").tobytes()
        encode = self.tokenizer.encode_batch if self.offsets else encode
        for part, found in zip(named, encode(named, add_special_tokens=False), strict=True):
            self.ids[part] = np.array(found.ids, dtype="<u4").tobytes()
            if self.offsets:
                self.spans[part] = np.array(found.offsets, dtype="<i8").reshape(-1, 2)

    def _learn_joined(self, parts: list[str], words: bool) -> None:
        """``words``: each part is a space and letters."""
        joined = "".join(parts)
        raw = joined.encode()
        if words:
            shown = raw.decode("latin-1").replace(" ", "\n ")  # line breaks between the words
            shown = shown.translate({b: c for b, c in self.alphabet.items() if b != 10})
            found = self.words.encode_batch_fast([shown], add_special_tokens=False)
        else:
            found = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
        ids = np.array(found[0].ids, dtype="<u4")
        data, ends = ids.tobytes(), np.cumsum(self.sizes[ids])
        stops = np.cumsum([len(p) for p in parts])
        if len(raw) != len(joined):
            leads = np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80
            stops = np.append(np.flatnonzero(leads), len(raw))[stops]
        cuts = np.searchsorted(ends, stops) + 1
        slices = zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)
        self.ids.update(zip(parts, [data[4 * a : 4 * b] for a, b in slices], strict=True))

    def _spans(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First and last character (excluded) within its part of each token of some parts, and the
        number of tokens of each part."""
        data = list(map(self.ids.__getitem__, parts))
        tokens = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
        of_token = self.sizes[np.frombuffer(b"".join(data), dtype="<u4")]
        joined = "".join(parts)
        raw = joined.encode()
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        leads, byte_starts = None, starts
        if len(raw) != len(joined):
            leads = np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80
            byte_starts = np.append(np.flatnonzero(leads), len(raw))[starts]
        ends = np.cumsum(of_token)
        before = np.append(0, ends)[np.cumsum(tokens) - tokens]  # bytes of the tokens of earlier parts
        ends += np.repeat(byte_starts - before, tokens)
        spans = np.stack([ends - of_token, ends], axis=1)
        if leads is not None:  # from bytes to the characters that hold them
            place = np.cumsum(leads) - 1
            last = len(raw) - 1
            first = place[np.minimum(spans[:, 0], last)]
            spans = np.stack([first, place[np.minimum(ends - 1, last)] + 1], axis=1)
        spans -= np.repeat(starts, tokens)[:, None]
        if self.spans:
            stops = np.cumsum(tokens)
            for i, part in enumerate(parts):
                if part in self.spans:
                    spans[stops[i] - tokens[i] : stops[i]] = self.spans[part]
        return spans, tokens

    def _parts(self, text: str) -> list[str]:
        if not self.added or not self.added.search(text):
            return parts_of(text)
        if self.whole:
            return [text]
        pieces = self.added.split(text)  # every second one is an added token
        cut = ([p] if i % 2 else parts_of(p) for i, p in enumerate(pieces))
        return list(itertools.chain.from_iterable(cut))

    def _groups(self, texts: Sequence[str | None], together: int) -> Iterator[Sequence[str | None]]:
        at, size = 0, 0
        for stop, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= together:
                yield texts[at:stop]
                at, size = stop, 0
        yield texts[at:]

    def _numbered(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different parts of some texts, the number of each part among them in the order of the
        texts, and how many parts each text has."""
        plain, odd, of_plain = [], [], np.zeros(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            shown = marked(text) if text and not (self.added and self.added.search(text)) else None
            of_plain[i] = shown is not None
            if shown is None:
                odd.append(self._parts(text or ""))
            else:
                plain.append(shown)
        split = pc.split_pattern(pa.array(plain, pa.large_string()), _MARK)
        many = np.zeros(len(texts), dtype=np.int64)
        many[of_plain] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        many[~of_plain] = [len(parts) for parts in odd]
        rest = pa.array(list(itertools.chain.from_iterable(odd)), pa.large_string())
        named = pa.concat_arrays([split.flatten(), rest]).dictionary_encode()
        codes = named.indices.to_numpy(zero_copy_only=False)
        if odd:  # they were put behind the others
            order = np.argsort(~of_plain, kind="stable")
            starts = np.zeros(len(texts), dtype=np.int64)
            starts[order] = np.cumsum(many[order]) - many[order]
            codes = codes[placed(starts, many, np.arange(len(texts)))]
        return named.dictionary.to_pylist(), codes, many

    def encode(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for NULL."""
        for group in self._groups(texts, TOGETHER):
            parts, codes, many = self._numbered(group)
            self._learn(parts)
            data = list(map(self.ids.__getitem__, parts))
            sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) // 4
            starts, known = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(data), dtype="<u4")
            blocks = (codes[at : at + PLACED] for at in range(0, len(codes), PLACED))
            found = [known[placed(starts, sizes, block)] for block in blocks]
            ids = memoryview(np.concatenate(found or [known]).view(np.uint8))
            ends = np.append(0, np.cumsum(sizes[codes]))[np.append(0, np.cumsum(many))] * 4
            for a, b in itertools.pairwise(ends.tolist()):
                yield bytes(ids[a:b])

    def encode_spans(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per group of consecutive texts, first and last character (excluded) of each token, and
        where each text starts; positions count through the group, with one between texts."""
        for group in self._groups(texts, TOGETHER_SPANS):
            parts, codes, many = self._numbered(group)
            self._learn(parts)
            known, tokens = self._spans(parts)
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))[codes]
            text = np.repeat(np.arange(len(group)), many)
            at = np.cumsum(sizes) - sizes + text
            lengths = np.bincount(text, sizes, len(group)).astype(np.int64) + 1
            spans = known[placed(np.cumsum(tokens) - tokens, tokens, codes)]
            yield spans + np.repeat(at, tokens[codes])[:, None], np.cumsum(lengths) - lengths


class EncoderSource:
    """What is broadcast for an encoder: the tokenizer's JSON, a few megabytes.

    A worker process keeps the value of a broadcast from task to task, so it makes the encoder
    once and its cache stays warm.
    """

    def __init__(self, path: str, offsets: bool = False, special: bool = False):
        with open(path, encoding="utf-8") as file:
            self.json = file.read()
        self.offsets, self.special, self._made = offsets, special, None

    def __getstate__(self) -> dict:
        return {"json": self.json, "offsets": self.offsets, "special": self.special, "_made": None}

    def encoder(self) -> Encoder:
        if self._made is None:
            self._made = Encoder(self.json, self.offsets, self.special)
        return self._made
