"""Token ids of whole texts, by the tokenizers library, with a bounded memo of words.

A pre-tokenizer that drops white space never joins across it, so a text's ids are its
white-space-separated chunks' ids in order. Chunks repeat; each worker remembers the ids of
those it has met, up to a fixed number, and asks the library for the rest.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks and words that one worker remembers (about 150 bytes each).
MEMO_CHUNKS = 300_000
MEMO_WORDS = 450_000
#: Python splits at these, the library's white space does not hold them.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts with a tokenizer file whose pre-tokenizer drops white space."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.vocab_size = self.lib.get_vocab_size()
        self.memo_chunks, self.memo_words = memo_chunks, memo_words
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pattern, self.table = self._plain(spec), str.maketrans(byte_letters())

    @staticmethod
    def _plain(spec: dict) -> regex.Pattern | None:
        """The word pattern, if the file normalises and splits in the way that ``_word_ids`` follows; else None."""
        try:
            steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
            split, level = spec["pre_tokenizer"]["pretokenizers"]
            if steps != ["NFC", "Replace", "Lowercase"] or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True):
                return None
            if level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"] or spec["model"]["type"] != "BPE":
                return None
            return regex.compile(split["pattern"]["Regex"])
        except (KeyError, TypeError, ValueError):
            return None

    def _word_ids(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.table)
            ids = [t.id for t in self.lib.model.tokenize(letters)]
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.words) < self.memo_words:
                self.words[word] = found
        return found

    def _chunk_ids(self, chunk: str) -> bytes:
        if self.pattern is None or not (chunk.isascii() or max(chunk) < "ɐ" and unicodedata.is_normalized("NFC", chunk)):
            return np.array(self.lib.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        low = chunk.lower()
        if low.isalpha():
            return self._word_ids(low)
        if low[:-1].isalpha() and low[-1] in ".,":
            return self._word_ids(low[:-1]) + self._word_ids(low[-1])
        return b"".join(map(self._word_ids, self.pattern.findall(low)))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers; null is empty. The same ids as the library's own encode()."""
        if not text:
            return np.zeros(0, "<u4")
        if self.pattern is None or SEPARATORS.search(text) or "<" in text and self.special and self.special.search(text):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(self._ids_of(text.split())), "<u4")

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        memo = self.chunks
        found = list(map(memo.get, chunks))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[k]
                    ids = memo.get(chunk)
                    if ids is None:
                        ids = self._chunk_ids(chunk)
                        if len(memo) < self.memo_chunks and len(chunk) <= 64:
                            memo[chunk] = ids
                    found[k] = ids
        return found


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
