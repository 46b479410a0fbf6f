"""Exact and fast encoding of whole texts with a public tokenizer: every distinct word is encoded once a worker.

The vocabulary drops white space and encodes each pre-token on its own, so a text's ids are its white-space chunks'
ids joined, and a chunk's are its pre-tokens'. Chunks outside a simple alphabet go to the library as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

# The pre-tokenizer's pattern for the simple alphabet (ASCII and Latin-1 letters, lower case).
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t\n\r]+")
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
SIMPLE = re.compile(r"[\x20-\x7e\t\n\rÀ-ÖØ-öø-ÿ]*")
SPLIT = re.compile(r"[ \t\n\r]+")
CACHED = 800_000
JOINED = 4096


class WordEncoder:
    """Ids of texts as little-endian arrays; the cache of pieces is bounded and lives as long as the worker."""

    _own: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.end[i] = token.endswith("</w>")
        self.dtype = np.dtype("<u2") if len(self.end) <= 1 << 16 else np.dtype("<u4")
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def letters(self, words: list[str]) -> list[bytes]:
        """Words of letters, many in one text; each one's ids end with the id that ends a word."""
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            own = words[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self.end[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(own):
                out += self.plain(own)
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def learn(self, new: set[str]) -> None:
        words = [p for p in new if LETTERS.fullmatch(p)]
        rest = list(new.difference(words))
        self.pieces.update(zip(words, self.letters(words), strict=True))
        self.pieces.update(zip(rest, self.plain(rest), strict=True))

    def split(self, text: str | None) -> list[str]:
        """Pieces of a text whose ids, joined, are the text's: pre-tokens, or whole chunks outside the alphabet."""
        if not text:
            return []
        if "<|" not in text and SIMPLE.fullmatch(text):
            return PIECES.findall(text.lower())
        out: list[str] = []
        for c in SPLIT.split(text):
            if "<|" not in c and SIMPLE.fullmatch(c):
                out += PIECES.findall(c.lower())
            else:
                out.append(c)
        return out

    def encode(self, texts: list[str | None], most_chars: int = 4_000_000):
        """An array of ids for each text, in order; null texts are empty."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < most_chars):
                chars += len(texts[end] or "")
                end += 1
            split = [self.split(t) for t in texts[at:end]]
            if len(self.pieces) > CACHED:
                self.pieces = {}
            if new := set().union(*split) - self.pieces.keys():
                self.learn(new)
            get = self.pieces.__getitem__
            for s in split:
                yield np.frombuffer(b"".join(map(get, s)), self.dtype)
            at = end


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()
