"""Token ids and counts by public vocabulary files, for whole texts.

The files name the vocabulary; ids are those that the ``tokenizers`` library gives without begin, end or padding.
``tokenizers`` itself encodes texts with characters whose class or case could depend on a library's Unicode version,
while the rest goes to ``tiktoken``'s merge loop over the same vocabulary, which is several times faster.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Below this code point letters, numbers, spaces and cases are the same in every Unicode version.
PLAIN = 0x180
PLAIN_TEXT = re.compile(f"[\\x00-{chr(PLAIN - 1)}‐-‧€]*")
#: Room for words in a worker's memory.
WORDS_KEPT = 500_000


def vocabulary_path(name: str) -> str:
    """Where an installed public vocabulary file lies; any other path may be given in its stead."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or the next free character from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _load(path: str) -> tuple[dict, object]:
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return spec, Tokenizer.from_file(path)


class ByteTokens:
    """Byte-level BPE: every byte of a text lies in exactly one token, so byte offsets are running sums."""

    def __init__(self, path: str) -> None:
        import tiktoken

        spec, self.library = _load(path)
        table = _byte_of()
        ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        for token, i in self.special.items():
            self.lengths[i] = len(token.encode())
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def ids(self, text: str) -> list[int]:
        """Token ids; a special string inside the text is its special token, as the library has it by default."""
        if PLAIN_TEXT.fullmatch(text) is None:
            return self.library.encode(text, add_special_tokens=False).ids
        if self.marks is None or "<|" not in text:
            return self.fast.encode_ordinary(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self.fast.encode_ordinary(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self.fast.encode_ordinary(text[at:])

    def ends(self, data: bytes) -> np.ndarray:
        """The byte offset at which each token of ``data`` ends."""
        return np.cumsum(self.lengths[self.ids(data.decode("utf-8"))])


def _char_start(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _stable(data: bytes, at: int) -> bool:
    """Is ``at`` a token boundary whatever the text around it?

    No pre-token has a white-space character after another kind, so a text always parts before white space that
    follows something else; what is found from there on doesn't depend on what stood before.
    """
    if not 0 < at < len(data) or data[at] not in b" \t\n\r\x0b\x0c":
        return False
    start = at - 1
    while start and data[start] & 0xC0 == 0x80:
        start -= 1
    return not data[start:at].decode("utf-8").isspace()


def count_spliced(tokens: ByteTokens, text: str, chunk: int = 1 << 16, overlap: int = 256) -> int:
    """Tokens of ``text``, encoded in overlapping chunks of about ``chunk`` bytes and spliced.

    Two neighbours are spliced at the first offset of their overlap that is a token end in the left, a token start in
    the right, and provably stable; without one, the overlap is doubled and the left chunk encoded anew, up to the end
    of the text at most. Memory is bounded by the chunk and the overlap that is needed.
    """
    data = text.encode("utf-8")
    if len(data) <= chunk + overlap:
        return len(tokens.ids(text))
    total, start = 0, 0  # tokens up to ``start``, a stable boundary
    while start < len(data):
        cut, wide = _char_start(data, min(len(data), start + chunk)), overlap
        while True:
            end = _char_start(data, min(len(data), cut + wide))
            left = tokens.ends(data[start:end]) + start
            if end == len(data):
                return total + len(left)
            right = tokens.ends(data[cut:end]) + cut
            common = np.intersect1d(left, right, assume_unique=False)
            at = next((int(p) for p in common if p < end and _stable(data, int(p))), None)
            if at is not None:
                break
            wide *= 2
        total += int(np.searchsorted(left, at, side="right"))
        start = at
    return total


class WordTokens:
    """BPE within words, lower-cased, white space dropped: a text's ids are its words' ids in order.

    Words are parted at ASCII white space only; other white space stays within a word, which then goes to the library.
    Ids of recent words are kept, so the merge loop runs once for a word that repeats.
    """

    END = b"\xff"  # in no UTF-8 text: marks a piece's end in the merge loop
    SIMPLE = re.compile(rb"([A-Za-z]+)([!-&(-/:;=-@[-`{}~]*)")  # letters, then marks that open no contraction or special token

    def __init__(self, path: str) -> None:
        import tiktoken

        spec, self.library = _load(path)
        table, end = _byte_of(), spec["model"]["end_of_word_suffix"]
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            body, closed = (token[: -len(end)], self.END) if token.endswith(end) and token != end else (token, b"")
            ranks[bytes(table[c] for c in body) + closed] = i
        ranks.setdefault(self.END, max(ranks.values()) + 1)  # never left alone: each byte has a closed form
        self.merge = tiktoken.Encoding("word", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.bounds = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 14, dtype=np.int64)

    def word(self, word: bytes) -> list[int]:
        if m := self.SIMPLE.fullmatch(word):
            letters, marks = m.groups()
            found = self.merge(letters.lower() + self.END)
            return found + self.merge(marks + self.END) if marks else found
        text = word.decode("utf-8")
        if ord(max(text)) >= PLAIN or "İ" in text or "<|" in text or not text.isprintable():
            return self.library.encode(text, add_special_tokens=False).ids
        text = text.lower()
        pieces = (text,) if text.isalpha() else self.piece.findall(text)
        return [i for p in pieces for i in self.merge(p.encode("utf-8") + self.END)]

    def _learn(self, words: set[bytes]) -> None:
        """Append the ids of new words to the flat store, which doubles when it is full."""
        found = [self.word(w) for w in words]
        n, flat = len(self.known), np.fromiter(chain.from_iterable(found), dtype=np.uint32)
        ends = self.bounds[n] + np.cumsum(np.fromiter(map(len, found), dtype=np.int64))
        while n + len(found) >= len(self.bounds):
            self.bounds = np.append(self.bounds, np.zeros_like(self.bounds))
        while self.bounds[n] + len(flat) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.bounds[n] : self.bounds[n] + len(flat)] = flat
        self.bounds[n + 1 : n + 1 + len(found)] = ends
        self.known.update(zip(words, range(n, n + len(found)), strict=True))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets of the texts)."""
        if len(self.known) > WORDS_KEPT:
            self._forget()
        words = [t.encode("utf-8").split() for t in texts]
        every_word = list(chain.from_iterable(words))
        at = np.fromiter(map(self.known.get, every_word, repeat(-1)), dtype=np.int64, count=len(every_word))
        if len(new := np.flatnonzero(at < 0)):
            self._learn({every_word[i] for i in new})
            at[new] = [self.known[every_word[i]] for i in new]
        every, cuts = self.flat, self.bounds
        size = cuts[at + 1] - cuts[at]
        upto = np.append(0, np.cumsum(size))
        out = every[np.repeat(cuts[at] - upto[:-1], size) + np.arange(upto[-1])]
        return out, upto[np.append(0, np.cumsum([len(ws) for ws in words], dtype=np.int64))]


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
