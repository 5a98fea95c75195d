"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, stored as sorted arrays that workers map into
memory.

1. Words are hashed and counted; parts by the hash's leading bits become sorted arrays of hashes and counts in the
   shared folder. A word's number is its place in that order; the number after the last starts a text.
2. Tasks count n-grams as tuples of numbers, sorted and compressed, and Spark shuffles these runs by part: a hash of the
   context, or of the whole n-gram where the context's words are so frequent that its followers might not fit a part.
3. Each trigram part is merged into a sorted array of hashed trigrams and their counts, and one of its contexts: how often
   each comes and how many followers it has once, twice and more. To the bigram parts go, as runs again, how many words
   come before each bigram (one that starts a text keeps its count), and the same of contexts that were split.
4. Each bigram part is merged into sorted arrays alike; the same goes to the words' parts for words as contexts, with how
   many words precede each word.
5. Scoring tasks map the arrays and look up whole batches, sorted, by binary search.

Tasks write a file under a name of their own and then move it, and write the same bytes when they run again.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import remainder, shared_path, stored, text_slices
from grovewise.llm.shingles import mixed, words_of

END = np.uint64(0x9D39247E33776D41)  # the hash that stands for the end of a text
RUN_WORDS = 3_000_000  # words that a counting task holds
RUNS = "part int, kind int, keys binary, counts binary, last binary"
TRIGRAM_PART_WORDS = 4_000_000
ODD = np.uint64(0xD6E8FEB86659FD93)
FAN_IN = 32  # runs that a task merges
U32 = np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)


# ---- files in the shared folder


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def save(uri: str, name: str, array: np.ndarray) -> None:
    system, path = _fs(uri)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(array))
    system.move(own, f"{path}/{name}.npy")


@lru_cache(maxsize=4096)
def mapped(uri: str, name: str) -> np.ndarray:
    """The array, memory-mapped; one that lies in a store is copied to the worker's temporary folder first."""
    system, path = _fs(uri)
    path = f"{path}/{name}.npy"
    if system.type_name != "local":
        local = os.path.join(tempfile.gettempdir(), f"{abs(hash(uri))}-{name}.npy")
        if not os.path.exists(local):
            own = f"{local}.{uuid.uuid4().hex}"
            with system.open_input_stream(path) as src, open(own, "wb") as out:
                while block := src.read(1 << 22):
                    out.write(block)
            os.replace(own, local)
        path = local
    return np.load(path, mmap_mode="r")


# ---- sorted runs


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers, by bytes of equal significance, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def run_row(part: int, kind: int, keys: np.ndarray, counts: np.ndarray, last: np.ndarray | None = None) -> tuple[int, int, bytes, bytes, bytes]:
    """Sorted keys as differences, with their counts and, for trigrams, the last word."""
    size = len(keys).to_bytes(8, "little")
    return part, kind, size + pack(np.diff(keys, prepend=np.uint64(0))), pack(counts), b"" if last is None else pack(last)


def small(values: np.ndarray) -> np.ndarray:
    """In the least type that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def read_run(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(keys[:8], "little")
    return np.cumsum(unpack(keys[8:], n), dtype=np.uint64), unpack(counts, n)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "kind", "keys", "counts", "last"])


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[cuts], np.add.reduceat(counts, cuts)


def split(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The arrays by part, in their order within a part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[a]), tuple(x[order[a:b]] for x in arrays)


# ---- words


@dataclass(frozen=True)
class Words:
    """The vocabulary: ``2**bits`` parts by the hash's leading bits; ``first[p]`` is the number of part p's first word."""

    uri: str
    bits: int
    first: tuple[int, ...]

    @property
    def size(self) -> int:
        return self.first[-1]

    def part(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each of the sorted hashes; ``size`` for unknown words."""
        out = np.full(len(hashes), self.size, dtype=np.int64)
        bounds = np.searchsorted(self.part(hashes), np.arange((1 << self.bits) + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            some = slice(bounds[p], bounds[p + 1])
            known = mapped(self.uri, f"words-{p}")
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
                out[some] = np.where(known[at] == hashes[some], at + self.first[p], self.size)
        return out

    def values(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """An array of the words' parts at sorted numbers; 0 for unknown words."""
        out = np.zeros(len(numbers), dtype=np.int64)
        bounds = np.searchsorted(numbers, self.first)
        for p in np.flatnonzero(np.diff(bounds)):
            some = slice(bounds[p], bounds[p + 1])
            out[some] = mapped(self.uri, f"{name}-{p}")[numbers[some] - self.first[p]]
        return out


def _with_end(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, an END after each text; first word of each text and the total)."""
    words, first = words_of(texts)
    return np.insert(words, first[1:], END), first + np.arange(len(first))


def _count_words(at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", at_once):
                words, counts = np.unique(_with_end(part.column("text"))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    return run


def _write_words(uri: str):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        words = table.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        save(uri, f"words-{part}", words[order])
        save(uri, f"raw-{part}", small(table.column("n").to_numpy()[order]))
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(words)], pa.int64())})

    return run


def _signed_part(bits: int):
    """The leading bits of a hash kept as a signed long."""
    return F.shiftrightunsigned("word", 64 - bits).cast("int") if bits else F.lit(0)


# ---- bigrams


def _bigram_part(words: Words, u: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """By the first word, or by both where the first is hot."""
    alone = mixed(u.astype(np.uint64))
    both = mixed((u.astype(np.uint64) << U32) | w.astype(np.uint64))
    return (np.where(np.isin(u, hot), both, alone) % np.uint64(parts)).astype(np.int64)


def _bigrams(words: Words, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous word's number, word's number) of each token; the number after the vocabulary's starts a text."""
    before = np.append(words.size, numbers[:-1])
    before[first[:-1]] = words.size
    return before, numbers


def _numbered(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    tokens, first = _with_end(texts)
    kinds, back = np.unique(tokens, return_inverse=True)
    return words.numbers(kinds)[back], first


def _count_bigrams(words: Words, hot: np.ndarray, parts: int, at_once: int):
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        part = _bigram_part(words, (keys >> U32).astype(np.int64), (keys & LOW).astype(np.int64), hot, parts)
        return batch_of([run_row(p, 0, k, c) for p, (k, c) in split(part, keys, counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in text_slices(batch, "text", at_once):
                before, numbers = _bigrams(words, *_numbered(words, part.column("text")))
                held.append((before.astype(np.uint64) << U32) | numbers.astype(np.uint64))
                n += len(numbers)
                if n >= RUN_WORDS:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


# ---- trigrams


def _sorted3(pairs: np.ndarray, last: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams (first two words, last word) in order, with their counts."""
    order = np.lexsort((last, pairs))
    pairs, last = pairs[order], last[order]
    cuts = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (last[1:] != last[:-1]))) if len(pairs) else np.zeros(0, int)
    if counts is None:
        return pairs[cuts], last[cuts], np.diff(np.append(cuts, len(pairs)))
    return pairs[cuts], last[cuts], np.add.reduceat(counts[order], cuts) if len(cuts) else counts[order]


def _trigram_keys(pairs: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mixed(mixed(pairs) + last.astype(np.uint64) * ODD)


def _both_hot(pairs: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Pairs of two frequent words, whose followers are split over parts; others come no more often than such a word."""
    return np.isin((pairs >> U32).astype(np.int64), hot) & np.isin((pairs & LOW).astype(np.int64), hot)


def _trigram_part(pairs: np.ndarray, last: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    return (np.where(_both_hot(pairs, hot), _trigram_keys(pairs, last), mixed(pairs)) % np.uint64(parts)).astype(np.int64)


def _pairs_before(words: Words, before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The two words before each token as one number; before the first and second of a text there are starts."""
    second = np.append(words.size, before[:-1])
    second[first[:-1]] = words.size
    return (second.astype(np.uint64) << U32) | before.astype(np.uint64)


def _count_trigrams(words: Words, hot: np.ndarray, parts: int, at_once: int):
    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs, last, counts = _sorted3(*(np.concatenate(x) for x in zip(*held, strict=True)))
        part = _trigram_part(pairs, last, hot, parts)
        return batch_of([run_row(p, 0, k, c, w) for p, (k, c, w) in split(part, pairs, counts, last)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in text_slices(batch, "text", at_once):
                numbers, first = _numbered(words, part.column("text"))
                held.append((_pairs_before(words, _bigrams(words, numbers, first)[0], first), numbers.astype(np.uint32)))
                n += len(numbers)
                if n >= RUN_WORDS:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


#: Kinds of runs for bigram parts: bigrams with their counts, and what pairs have as contexts.
CONTEXT = {11: "total", 12: "once", 13: "twice", 14: "more"}


def _merge_trigrams(words: Words, hot: np.ndarray, bigram_parts: int):
    """A part's runs to its arrays, and runs for the bigram parts."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        now = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64))
        held: list[tuple] = []
        for k, c, w in zip(table.column("keys"), table.column("counts"), table.column("last"), strict=True):
            keys, counts = read_run(k.as_py(), c.as_py())
            held.append((keys, unpack(w.as_py(), len(keys)).astype(np.uint32), counts))
            if sum(len(h[0]) for h in held) > max(len(now[0]), 1 << 20):  # merge when as much as is merged waits
                now, held = _sorted3(*(np.concatenate(x) for x in zip(now, *held, strict=True))), []
        pairs, last, counts = _sorted3(*(np.concatenate(x) for x in zip(now, *held, strict=True)))

        start = (np.uint64(words.size) << U32) | np.uint64(words.size)
        opening = pairs == start
        bigrams = [((np.uint64(words.size) << U32) | last[opening].astype(np.uint64), counts[opening])]
        pairs, last, counts = pairs[~opening], last[~opening], counts[~opening]
        keys = _trigram_keys(pairs, last)
        order = np.argsort(keys)
        save(words.uri, f"trigrams-{part}", keys[order])
        save(words.uri, f"counts-{part}", small(counts[order]))
        rows = [(-1, 0, b"", pack(np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)), b"")]

        bigrams.append(np.unique(((pairs & LOW) << U32) | last.astype(np.uint64), return_counts=True))
        for k, n in bigrams:
            to = _bigram_part(words, (k >> U32).astype(np.int64), (k & LOW).astype(np.int64), hot, bigram_parts)
            rows += [run_row(p, 0, x, m) for p, (x, m) in split(to, k, n)]
        cuts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, int)
        contexts = pairs[cuts]
        split_up = _both_hot(contexts, hot)
        to = _bigram_part(words, (contexts >> U32).astype(np.int64), (contexts & LOW).astype(np.int64), hot, bigram_parts)
        save(words.uri, f"contexts-{part}", contexts[~split_up])
        for (kind, name), of in zip(CONTEXT.items(), (counts, counts == 1, counts == 2, counts > 2), strict=True):
            n = np.add.reduceat(of.astype(np.int64), cuts) if len(cuts) else np.zeros(0, np.int64)
            save(words.uri, f"{name}-of-{part}", small(n[~split_up]))
            has = split_up & (n > 0)
            rows += [run_row(p, kind, x, m) for p, (x, m) in split(to[has], contexts[has], n[has])]
        return pa.Table.from_batches([batch_of(rows)])

    return run


def _summed(runs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one kind as one."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for k, c in runs:
        held.append(read_run(k, c))
        if sum(len(h[0]) for h in held) > max(len(keys), 1 << 20):  # merge when as much as is merged waits
            keys, counts = merged(np.concatenate([keys, *(h[0] for h in held)]), np.concatenate([counts, *(h[1] for h in held)]))
            held = []
    return merged(np.concatenate([keys, *(h[0] for h in held)]), np.concatenate([counts, *(h[1] for h in held)]))


def _merge_bigrams(words: Words):
    """A part's runs to its arrays; to each word's part go: preceding words (kind 1), followers once, twice, more (2-4) and
    what all followers' counts sum up to (5)."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part == -1:  # what the trigram parts have noted
            noted = sum(unpack(c.as_py(), 6) for c in table.column("counts"))
            return pa.Table.from_batches([batch_of([(-2, 0, b"", pack(noted), b"")])])
        runs: dict[int, list[tuple[bytes, bytes]]] = {}
        for kind, k, c in zip(table.column("kind").to_pylist(), table.column("keys"), table.column("counts"), strict=True):
            runs.setdefault(kind, []).append((k.as_py(), c.as_py()))
        keys, counts = _summed(runs.get(0, []))
        save(words.uri, f"pairs-{part}", keys)
        save(words.uri, f"times-{part}", small(counts))
        contexts, total = _summed(runs.get(11, []))  # none in a model of order 2
        save(words.uri, f"split-{part}", contexts)
        save(words.uri, f"split-total-{part}", small(total))
        for kind in (12, 13, 14):
            own, n = _summed(runs.get(kind, []))
            values = np.zeros(len(contexts), dtype=np.uint64)
            values[np.searchsorted(contexts, own)] = n
            save(words.uri, f"split-{CONTEXT[kind]}-{part}", small(values))
        rows = [(-1, 0, b"", pack(np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)), b"")]
        bounds = np.array(words.first)
        for kind, of in ((1, keys & LOW), (2, keys[counts == 1] >> U32), (3, keys[counts == 2] >> U32), (4, keys[counts > 2] >> U32), (5, keys >> U32)):
            if kind == 5:
                ids, n = merged(of, counts)
            else:
                ids, n = np.unique(of, return_counts=True)
            for p, (i, m) in split(np.minimum(np.searchsorted(bounds, ids.astype(np.int64), side="right") - 1, len(bounds) - 1), ids, n):
                rows.append(run_row(p, kind, i, m))
        return pa.Table.from_batches([batch_of(rows)])

    return run


def _merge_runs(table: pa.Table) -> pa.Table:
    """Some of a word part's runs of one kind as one run."""
    part, kind = (table.column(k)[0].as_py() for k in ("part", "kind"))
    keys, counts = zip(*(read_run(k.as_py(), c.as_py()) for k, c in zip(table.column("keys"), table.column("counts"), strict=True)), strict=True)
    return pa.Table.from_batches([batch_of([run_row(part, kind, *merged(np.concatenate(keys), np.concatenate(counts)))])])


def _few_runs(runs: DataFrame, n_each: int) -> DataFrame:
    """``runs``, of which a part and kind has up to ``n_each``, merged until it has few, so that no task gets them all."""
    while n_each > 2 * FAN_IN:
        slices = -(-n_each // FAN_IN)
        sliced = runs.withColumn("slice", F.pmod(F.xxhash64("keys", "counts"), F.lit(slices)))
        runs, n_each = stored(sliced.groupBy("part", "kind", "slice").applyInArrow(_merge_runs, RUNS), "lm-runs"), slices
    return runs


KINDS = {1: "preceding", 2: "once", 3: "twice", 4: "more", 5: "total"}


def _write_sums(words: Words):
    """A word part's runs to its arrays; the number after the vocabulary's has a part of its own. Returns how many
    words have 1, 2, 3, 4 or more preceding words."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        first = words.first[part]
        n = words.first[part + 1] - first if part + 1 < len(words.first) else 1
        sums = {name: np.zeros(n, dtype=np.int64) for name in KINDS.values()}
        for kind, k, c in zip(table.column("kind").to_pylist(), table.column("keys"), table.column("counts"), strict=True):
            ids, m = read_run(k.as_py(), c.as_py())
            sums[KINDS[kind]][ids.astype(np.int64) - first] += m.astype(np.int64)
        for name, values in sums.items():
            save(words.uri, f"{name}-{part}", small(values))
        often = np.bincount(np.minimum(sums["preceding"], 5), minlength=6)
        return pa.table({"part": pa.array([part] * 5, pa.int32()), "k": pa.array(range(1, 6), pa.int32()), "n": pa.array(often[1:], pa.int64())})

    return run


def discounts(often: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many have count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = often[:4]
    if not n1 or not n2:
        return 0.5, 0.75, 0.9  # too little to estimate
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def _place(there: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, is it there?) of each key in a sorted array that isn't empty."""
    at = np.minimum(np.searchsorted(there, keys), len(there) - 1)
    return at, there[at] == keys


@dataclass(frozen=True)
class Model:
    words: Words
    hot: tuple[int, ...]
    parts: int
    trigram_parts: int  # 0 for a model of order 2
    texts: int
    tokens: int
    pairs: int
    preceding: tuple[int, ...]  # words with 1, 2, 3, 4, more preceding words
    d1: tuple[float, float, float]  # discounts of numbers of preceding words
    d2: tuple[float, float, float]  # discounts of bigram counts
    d3: tuple[float, float, float] = (0.5, 0.75, 0.9)  # discounts of trigram counts

    @property
    def order(self) -> int:
        return 3 if self.trigram_parts else 2

    def _looked_up(self, keys: np.ndarray, part: np.ndarray, of: str, names: tuple[str, ...]) -> list[np.ndarray]:
        """The values of some arrays at keys, which are looked up in the sorted arrays ``of``; 0 where there is none."""
        out = [np.zeros(len(keys), dtype=np.int64) for _ in names]
        for p, (k, where) in split(part, keys, np.arange(len(keys))):
            there = mapped(self.words.uri, f"{of}-{p}")
            if len(there):
                at, found = _place(there, k)
                for values, name in zip(out, names, strict=True):
                    values[where[found]] = mapped(self.words.uri, f"{name}-{p}")[at[found]]
        return out

    def _pair_part(self, pairs: np.ndarray) -> np.ndarray:
        return _bigram_part(self.words, (pairs >> U32).astype(np.int64), (pairs & LOW).astype(np.int64), np.array(self.hot, dtype=np.int64), self.parts)

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, base score and log10 probability."""
        words, v = self.words, self.words.size
        numbers, first = _numbered(words, texts)
        before, _ = _bigrams(words, numbers, first)
        kinds, back = np.unique(numbers, return_inverse=True)
        raw = words.values("raw", kinds)
        base = np.log10((raw + 1) / (self.tokens + v + 1))[back]

        d = np.array([0.0, *self.d1])
        seen = words.values("preceding", kinds)
        kept = np.maximum(seen - d[np.minimum(seen, 3)], 0) / max(self.pairs, 1)
        spare = sum(x * n for x, n in zip(self.d1, (*self.preceding[:2], sum(self.preceding[2:])), strict=True)) / max(self.pairs, 1)
        low = (kept + (spare if self.pairs else 1.0) / (v + 1))[back]

        contexts, cback = np.unique(before, return_inverse=True)
        start = {name: int(mapped(words.uri, f"{name}-{len(words.first) - 1}")[0]) if self.pairs else 0 for name in ("once", "twice", "more", "total")}
        total, *followers = (np.where(contexts == v, start[k], words.values(k, contexts)) for k in ("total", "once", "twice", "more"))
        back_off = sum(x * n for x, n in zip(self.d2, followers, strict=True)) / np.maximum(total, 1)
        back_off = np.where(total > 0, back_off, 1.0)
        unseen_before = np.append(True, numbers[:-1] == v)  # an unknown word isn't the start
        unseen_before[first[:-1]] = False

        known = ~unseen_before & (numbers < v)
        pairs, pback = np.unique((before[known].astype(np.uint64) << U32) | numbers[known].astype(np.uint64), return_inverse=True)
        (times,) = self._looked_up(pairs, self._pair_part(pairs), "pairs", ("times",))
        d = np.array([0.0, *self.d2])
        high = np.zeros(len(numbers))
        high[known] = np.maximum(times - d[np.minimum(times, 3)], 0)[pback]
        p = np.where(unseen_before, low, high / np.maximum(total, 1)[cback] + back_off[cback] * low)
        if self.trigram_parts:
            p = self._with_trigrams(numbers, before, first, unseen_before, p)
        sums = [np.add.reduceat(x, first[:-1]) if len(texts) else np.zeros(0) for x in (np.log10(p), base, (raw > 0)[back].astype(np.int64))]
        return {"n_tokens": np.diff(first), "n_known": sums[2], "base_score": sums[1], "score": sums[0]}

    def _with_trigrams(self, numbers: np.ndarray, before: np.ndarray, first: np.ndarray, unseen_before: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The probabilities of tokens with two known words, or the start and one, before them; the others' stay."""
        opening = np.zeros(len(numbers), dtype=bool)
        opening[first[:-1]] = True
        usable = np.flatnonzero(~opening & ~unseen_before & ~np.append(True, unseen_before[:-1]))
        pairs = _pairs_before(self.words, before, first)[usable]
        contexts, back = np.unique(pairs, return_inverse=True)
        hot = np.array(self.hot, dtype=np.int64)
        split_up = _both_hot(contexts, hot)
        found = np.zeros((4, len(contexts)), dtype=np.int64)
        whole, parted = contexts[~split_up], contexts[split_up]
        found[:, ~split_up] = self._looked_up(whole, (mixed(whole) % np.uint64(self.trigram_parts)).astype(np.int64), "contexts", ("total-of", "once-of", "twice-of", "more-of"))
        found[:, split_up] = self._looked_up(parted, self._pair_part(parted), "split", ("split-total", "split-once", "split-twice", "split-more"))
        total, *followers = found
        back_off = np.where(total > 0, sum(x * n for x, n in zip(self.d3, followers, strict=True)) / np.maximum(total, 1), 1.0)
        keys, one, kback = np.unique(_trigram_keys(pairs, numbers[usable]), return_index=True, return_inverse=True)
        part = _trigram_part(pairs[one], numbers[usable][one], hot, self.trigram_parts)
        (times,) = self._looked_up(keys, part, "trigrams", ("counts",))
        d = np.array([0.0, *self.d3])
        high = np.maximum(times - d[np.minimum(times, 3)], 0)[kback] * (numbers[usable] < self.words.size)
        out = p.copy()
        out[usable] = high / np.maximum(total, 1)[back] + back_off[back] * p[usable]
        return out


def _with_all_parts(runs: DataFrame, parts: int) -> DataFrame:
    """``runs`` and an empty one for each part, so that every part has its arrays."""
    none = F.lit(bytearray()).alias("none")
    empty = runs.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("kind"), F.lit(bytearray(8)).alias("keys"), none.alias("counts"), none.alias("last"))
    return runs.unionByName(empty)


def _often(runs: DataFrame, mark: int) -> np.ndarray:
    """How many n-grams have which count, up to 5 or more, as the parts have noted."""
    often = np.zeros(6, dtype=np.int64)
    for r in runs.where(F.col("part") == mark).select("counts").toLocalIterator():
        often += unpack(bytes(r["counts"]), 6).astype(np.int64)
    return often


def train(docs: DataFrame, order: int = 2, at_once: int = 512, part_words: int = 8_000_000) -> Model:
    """Count a model of ``order`` 2 or 3 of the rows of ``docs`` (text); null texts are empty and count as an end.

    What stays in the driver is a number for each part. Counts may be any number; 2**32 distinct words or more are an
    error. A table without rows gives a model that knows no word.
    """
    if order not in (2, 3):
        raise ValueError(f"a model of order {order}: 2 and 3 are known")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = stored(texts.mapInArrow(_count_words(at_once), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    v, tokens = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_texts = counted.where(F.col("word") == int(END.view(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if v >= LOW:
        raise ValueError(f"{v} distinct words: bigrams are numbered for fewer than 2**32")
    uri = shared_path(docs.sparkSession, "lm-model")
    bits = max(0, (v // 1_000_000).bit_length())
    sizes = dict(counted.withColumn("part", _signed_part(bits)).groupBy("part").applyInArrow(_write_words(uri), "part int, n long").collect())
    for p in range(1 << bits):
        if p not in sizes:
            save(uri, f"words-{p}", np.zeros(0, np.uint64))
            save(uri, f"raw-{p}", np.zeros(0, np.int64))
    first = np.append(0, np.cumsum([sizes.get(p, 0) for p in range(1 << bits)]))
    words = Words(uri, bits, tuple(int(x) for x in first))

    # At most tokens / (part_words / 8) words are hot; a start of text is if there are as many texts.
    parts, limit = max(1, -(-tokens // part_words)), part_words // 8
    hot_hashes = np.sort(np.array([r["word"] for r in counted.where(F.col("n") > limit).select("word").collect()], dtype=np.int64).view(np.uint64))
    hot = np.append(words.numbers(hot_hashes), [v] if n_texts > limit else []).astype(np.int64)
    trigram_parts = 0
    if order == 3:
        trigram_parts = max(1, -(-tokens // min(part_words, TRIGRAM_PART_WORDS)))
        runs = texts.mapInArrow(_count_trigrams(words, hot, trigram_parts, at_once), RUNS)
        runs = _with_all_parts(runs, trigram_parts).groupBy("part").applyInArrow(_merge_trigrams(words, hot, parts), RUNS)
    else:
        runs = texts.mapInArrow(_count_bigrams(words, hot, parts, at_once), RUNS)
    sums = stored(_with_all_parts(runs, parts).groupBy("part").applyInArrow(_merge_bigrams(words), RUNS), "lm-sums")
    often, often3 = _often(sums, -1), _often(sums, -2)
    d3 = discounts(list(often3[1:5]))
    before = _few_runs(sums.where("part >= 0"), parts).groupBy("part").applyInArrow(_write_sums(words), "part int, k int, n long")
    before = dict(before.groupBy("k").agg(F.sum("n")).collect())
    preceding = tuple(int(before.get(k, 0)) for k in range(1, 6))
    return Model(words, tuple(int(x) for x in hot), parts, trigram_parts, int(n_texts), int(tokens), int(often.sum()), preceding, discounts(list(preceding)), discounts(list(often[1:5])), d3)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_documents(docs: DataFrame, model: Model, at_once: int = 512) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of ``docs``; null texts are empty: one end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", at_once):
                found = model.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *[pa.array(x) for x in found.values()]], names=["doc_id", *found])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(run, SCORES)


def language_model_scores(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """Train on the rows whose crc32 of the id leaves another remainder than ``held``, and score all.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). A model of order 3 takes some five times the
    room of the texts, which is why 2 is the default. Rows with a null id are scored and count
    as held out. Repeated rows are counted and scored each. Other columns are ignored; an empty table gives no rows.
    """
    out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(True))
    model = train(docs.where(~out), order)
    scored = score_documents(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
