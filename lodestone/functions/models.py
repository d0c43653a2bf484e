"""Model protocols and their deterministic, offline defaults.

Neural models are plugged in by the caller; every protocol works on Arrow or
pandas batches inside tasks:

* embedder:   ``dimension``, ``token_limit``, ``encode(list[str]) -> ndarray``,
              ``count_tokens(list[str]) -> list[int]``
* pair scorer: ``predict(list[(query, text)]) -> list[float]``
* generator:  ``generate(list[(question, context)]) -> list[str]``,
              ``count_tokens(list[str]) -> list[int]``
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa

TOKEN = re.compile("[0-9a-z가-힣:,.]+")
#: Words whose places an embedder remembers from batch to batch, about.
KNOWN_WORDS = 1 << 17
SENTENCE_GAP = re.compile(r"(?<=[.!?。！？])\s+|\n+")


HANGUL = re.compile("[가-힣]")
#: Bytes of a token stay; all others, those of further letters too, become blanks.
_BLANKED = bytes(b if b < 128 and TOKEN.match(chr(b)) else 32 for b in range(256))


def words(text: str) -> list[str]:
    lowered = text.lower()
    if lowered.isascii() or not HANGUL.search(lowered):
        return lowered.encode("utf-8", "replace").translate(_BLANKED).decode("ascii").split()
    return TOKEN.findall(lowered)


#: The same for bytes that are not lower-cased yet.
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else _BLANKED[b] for b in range(256))
#: Bytes that begin a Hangul syllable, among others; the other letters whose lower
#: case has an ASCII letter.
_HANGUL_FIRST, _HANGUL_LAST = 0xEA, 0xED
_TO_ASCII = ("\u0130".encode(), "\u212a".encode())


def _odd_rows(raw: bytes, data: np.ndarray, ends: np.ndarray) -> list[int]:
    """Rows that need more than their bytes looked up one by one."""
    if raw.isascii():
        return []
    places = [np.flatnonzero((data >= _HANGUL_FIRST) & (data <= _HANGUL_LAST))]
    places += [[m.start() for m in re.finditer(letter, raw)] for letter in _TO_ASCII if letter in raw]
    rows = np.searchsorted(ends, np.concatenate(places).astype(np.int64), "right")
    return np.unique(rows).tolist()


def token_lists(texts) -> pa.ListArray:
    """The ``words`` of every text of an Arrow column, null for null, found in the
    bytes of all texts at once."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    absent = texts.is_null()
    texts = texts.cast(pa.string()).fill_null("")
    _, places, bytes_of = texts.buffers()
    rows = len(texts)
    if not rows:
        return pa.array([], pa.list_(pa.string()))
    places = np.frombuffer(places, np.int32, rows + 1, 4 * texts.offset).astype(np.int64)
    raw = bytes(bytes_of[places[0] : places[-1]]) if places[-1] > places[0] else b""
    places -= places[0]
    spelled = raw.translate(_LOWERED)
    odd = _odd_rows(raw, np.frombuffer(raw, np.uint8), places[1:])
    if odd:
        parts, lengths, at = [], np.diff(places), 0
        for row in odd:
            parts += [spelled[at : places[row]], " ".join(words(texts[row].as_py())).encode()]
            at, lengths[row] = places[row + 1], len(parts[-1])
        spelled = b"".join([*parts, spelled[at:]])
        places = np.r_[0, np.cumsum(lengths)]
    data = np.frombuffer(spelled, np.uint8)
    solid = data != 32
    # A token ends where its text does.
    cuts = np.zeros(len(data) + 1, bool)
    cuts[places] = True
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cuts[1:-1]
    stops[:-1] &= ~solid[1:] | cuts[1:-1]
    begins = np.flatnonzero(begins)
    ends = np.r_[0, np.cumsum(np.flatnonzero(stops) + 1 - begins)].astype(np.int32)
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(data[solid]))
    lists = np.searchsorted(begins, places).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), found, mask=absent)


class HashingEmbedder:
    """Signed feature hashing of tokens: the offline stand-in for a bi-encoder.

    A token's bucket is the first 28 bits of its MD5, its sign the parity of
    the next four, so that the same vector can be computed in SQL.
    """

    def __init__(self, dimension: int = 64, token_limit: int = 256):
        self.dimension, self.token_limit = dimension, token_limit
        self._known: dict[str, int] = {}

    def count_tokens(self, texts: list[str]) -> list[int]:
        return [len(words(text)) for text in texts]

    def _places(self, words: list[str]) -> list[int]:
        """Twice the bucket of each word, and one more if its sign is negative."""
        known, digests = self._known, hashlib.md5
        places = list(map(known.get, words))
        fresh = [i for i, place in enumerate(places) if place is None]
        if fresh:
            first = b"".join([digests(words[i].encode()).digest()[:4] for i in fresh])
            bits = np.frombuffer(first, ">u4").astype(np.int64)
            found = ((bits >> 4) % self.dimension * 2 + bits % 2).tolist()
            for i, place in zip(fresh, found):
                places[i] = known[words[i]] = place
        return places

    def encode(self, texts: list[str]) -> np.ndarray:
        if len(self._known) > KNOWN_WORDS:
            self._known.clear()
        tokens = token_lists(pa.array(texts, pa.string()))
        spelled = tokens.flatten().dictionary_encode()
        places = self._places(spelled.dictionary.to_numpy(zero_copy_only=False).tolist())
        cells = np.array(places, dtype=np.int64)[spelled.indices.to_numpy()]
        signed = 2 * self.dimension
        rows = np.repeat(np.arange(len(texts)), np.diff(tokens.offsets.to_numpy()))
        counts = np.bincount(rows * signed + cells, minlength=len(texts) * signed)
        counts = counts.reshape(len(texts), self.dimension, 2)
        return (counts[:, :, 0] - counts[:, :, 1]).astype(float)


class OverlapPairScorer:
    """Share of the query's distinct words a text holds, damped by text length:
    the offline stand-in for a cross-encoder."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        scores = []
        for query, text in pairs:
            asked, present = set(words(query)), words(text)
            shared = len(asked & set(present))
            scores.append(shared / (max(len(asked), 1) + 0.01 * len(present)))
        return scores


class ExtractiveGenerator:
    """Answers with the context sentence sharing most words with the question,
    or abstains when fewer than ``threshold`` of them occur in any sentence.

    ``max_input_tokens`` is what a caller may ask a model for; contexts are never
    cut to it.
    """

    def __init__(self, threshold: float = 0.25, max_input_tokens: int = 512):
        self.threshold, self.max_input_tokens = threshold, max_input_tokens

    def count_tokens(self, prompts: list[str]) -> list[int]:
        return [len(prompt.split()) for prompt in prompts]

    def generate(self, pairs: list[tuple[str, str]]) -> list[str]:
        answers = []
        for question, context in pairs:
            asked = set(words(question))
            best, best_score = "not stated", 0.0
            for sentence in SENTENCE_GAP.split(context):
                score = len(asked & set(words(sentence))) / max(len(asked), 1)
                if sentence.strip() and score >= self.threshold and score > best_score:
                    best, best_score = sentence.strip(), score
            answers.append(best)
        return answers
