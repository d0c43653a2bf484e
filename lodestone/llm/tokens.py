"""Token ids of texts with a public tokenizer file, inside Spark tasks."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a Python worker remembers; it starts again beyond that.
REMEMBERED = 1_000_000
#: Bytes of text whose words are looked up together (a longer text is one such part).
TOGETHER = 4 << 20
#: Words encoded in one call, with a separator that is a token of its own between them.
JOINED = 2048
SEPARATOR = "\x01"

_CODES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
#: 1 for a-z and 0-9, 2 for ASCII marks other than the apostrophe, 0 for the rest.
_KIND = np.array(
    [
        1 if chr(c).isalnum() and c < 128 else 2 if 32 < c < 127 and c != 39 else 0
        for c in range(256)
    ],
    np.uint8,
)


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    For tokenizers that drop white space and never look across it, a text's ids
    are its words' ids one after another, so each word is encoded once per worker.
    Texts are cut at the six ASCII white space characters and between ASCII letters
    or digits and marks, after A-Z are lower-cased; probes of the file show whether
    none of that changes ids. Texts that hold one of the file's special tokens, or
    a word that normalization would still change, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = ["a b", "a", "b", "a\tb\n", " \r\x0b\x0c", "\x0ba \x0cb\r"]
        blank = self._encode(probe)
        marks = self._encode(["Ab3.,(c", "ab3", ".,(", "c", f"ab3 {SEPARATOR} .,(", SEPARATOR])
        self.by_word = (
            blank[0] == blank[1] + blank[2] == blank[3] == blank[5]
            and not blank[4]
            and marks[0] == marks[1] + marks[2] + marks[3]
            and marks[4] == marks[1] + marks[5] + marks[2]
            and len(marks[5]) == 1
        )
        self.separator = marks[5][0] if marks[5] else -1
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.places: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.sizes = np.empty(1 << 14, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.places)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while first + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.empty_like(self.sizes)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.sizes[first : first + len(words)] = sizes
        self.starts[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.places.update(zip(words, range(first, first + len(words))))
        self.used += len(ids)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self._encode([f" {SEPARATOR} ".join(some)])[0], np.int64)
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) == len(some) - 1:
                sizes = np.diff(np.r_[-1, cuts, len(ids)]) - 1
                self._add(some, np.delete(ids, cuts), sizes)
            else:  # the separator's id also stands for something in a word
                each = self._encode(some)
                self._add(some, np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each]))

    def _words(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Place of every word (-1: its text must be encoded whole), and words per text."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
        ends = ends - ends[0]
        kind = _KIND[data]
        apart = 1 + np.flatnonzero(kind[1:] + kind[:-1] == 3)
        data = np.insert(data, apart, 32)
        ends = (ends + np.searchsorted(apart, ends)).astype(np.int32)
        clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(data))
        cut = pc.ascii_split_whitespace(clean)
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        odd = {w for w in words if not w.isascii() and not unicodedata.is_normalized("NFC", w)}
        self._learn([w for w in words if w not in self.places and w not in odd])
        places = np.array([self.places.get(w, -1) for w in words], np.int64)
        if odd:
            places[[i for i, w in enumerate(words) if w in odd]] = -1
        return places[coded.indices.to_numpy()], np.diff(cut.offsets.to_numpy())

    def _part(self, texts: pa.StringArray) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(i, np.uint32) for i in self._encode(texts.to_pylist())]
        if len(self.places) > REMEMBERED:
            self._reset()
        places, counts = self._words(texts)
        sizes = np.where(places >= 0, self.sizes[places], 0) if len(places) else places
        ends = np.r_[0, np.cumsum(sizes)]
        shift = np.repeat(self.starts[places] - ends[:-1], sizes) if len(places) else places
        flat = self.pool[shift + np.arange(ends[-1])]
        text_ends = np.r_[0, np.cumsum(counts)]
        out = np.split(flat, ends[text_ends[1:-1]]) if len(texts) else []
        whole = np.zeros(len(texts), bool)
        for content in self.special:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        whole[np.searchsorted(text_ends, np.flatnonzero(places < 0), "right") - 1] = True
        for i in np.flatnonzero(whole):
            out[i] = np.array(self._encode([texts[int(i)].as_py()])[0], np.uint32)
        return out

    def ids(self, texts) -> Iterator[np.ndarray]:
        """Ids of every text as unsigned 32-bit integers; none for null or empty texts."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else []
        at = 0
        while at < len(texts):
            most = (sizes[at - 1] if at else 0) + TOGETHER
            end = max(int(np.searchsorted(sizes, most, "right")), at + 1)
            yield from self._part(texts.slice(at, end - at))
            at = end


def framed(ids: np.ndarray, end: int) -> np.ndarray:
    """Ids with the id that ends a document."""
    return np.append(ids, np.uint32(end)).astype("<u4")


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def encoder_of(paths: str, known: dict[str, Encoder] = {}) -> Encoder:  # noqa: B006
    """One encoder per Python worker and file."""
    if paths not in known:
        known[paths] = Encoder(paths)
    return known[paths]
