"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, undoes compatibility forms, drops invisible characters, maps look-alike letters to Latin ones and
digits and symbols inside words to the letters they stand for; ``l``, ``i`` and ``1`` become one letter. The lexicon is
learned from labelled texts folded alike: whole words and word beginnings that toxic texts use in too many different
contexts for chance. Contexts (previous words) are counted instead of texts, so that copies of one text count once.
Hits inside exception phrases don't count: two-word phrases of clean texts that hold a term, come in several contexts and
never in a toxic text are learned as such, and more can be given. The score is logistic in the hits' weight, absolute and by length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import text_slices
from grovewise.llm.labelled import SAMPLE_ROWS, held_out, labelled_sample, logistic

# Look-alikes by the letter they resemble: Cyrillic, Greek and others. Digits stand for letters in every position.
LOOKALIKES = {
    "a": "аα@4", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еεєё3", "f": "ғ", "g": "ɡ9", "h": "һн", "i": "іιıїl1ӏ|!", "j": "јϳ", "k": "кκ", "m": "м",
    "n": "пη", "o": "оοσ0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ʐ2",
}
FOLD = {ord(c): letter for letter, looks in LOOKALIKES.items() for c in looks if c not in "@$|!"}
FOLD |= {ord(c.upper()): letter for letter, looks in LOOKALIKES.items() for c in looks if c.isalpha() and len(c.upper()) == 1 and not c.isascii()}
FOLD |= dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0x00AD], None)
SYMBOL = {c: letter for letter, looks in LOOKALIKES.items() for c in looks if c in "@$|!"}
IN_WORD = re.compile(r"[@$|!](?=\w)")
WORDS = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
FEATURES = "doc_id long, y int, weight double, words long"


def fold(text: str) -> str:
    """The text as the lexicon sees it."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if not 0x300 <= ord(c) <= 0x36F)
    text = text.lower().translate(FOLD)
    return IN_WORD.sub(lambda m: SYMBOL[m.group()], text) if "@" in text or "$" in text or "|" in text or "!" in text else text


@dataclass(frozen=True)
class Lexicon:
    """``words`` and ``stems`` with weights, phrases that excuse the hits inside them, and the score's coefficients."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (-4.0, 2.0, 1.0)

    def matcher(self):
        import ahocorasick

        entries: dict[str, list] = {}
        for kind, terms in ((0, dict.fromkeys(self.exceptions, 0.0)), (1, self.stems), (2, self.words)):
            for term, weight in terms.items():
                if folded := fold(term):
                    entries.setdefault(folded, []).append((kind, weight))
        found = ahocorasick.Automaton()
        for term, meanings in entries.items():
            found.add_word(term, (len(term), tuple(meanings)))
        if entries:
            found.make_automaton()
        return found if entries else None


def _hits(matcher, folded: str) -> dict[int, tuple[int, float, str]]:
    """By its start: end, weight and text of the heaviest term there that no exception phrase covers."""
    hits: dict[int, tuple[int, float, str]] = {}
    excused: list[tuple[int, int]] = []
    for last, (size, meanings) in matcher.iter(folded):
        start, end = last - size + 1, last + 1
        if start and (folded[start - 1].isalnum() or folded[start - 1] == "_"):
            continue
        closed = end == len(folded) or not (folded[end].isalnum() or folded[end] == "_")
        for kind, weight in meanings:
            if kind == 0 and closed:
                excused.append((start, end))
            elif kind == 1 or kind == 2 and closed:
                hits[start] = max(hits.get(start, (0, 0.0, "")), (end, weight, folded[start:end]), key=lambda h: h[1])
    if excused:
        hits = {s: h for s, h in hits.items() if not any(a <= s and h[0] <= b for a, b in excused)}
    return hits


def weigh(matcher, text: str) -> tuple[float, int]:
    """(summed weight of the distinct terms hit, number of words).

    A word counts for its heaviest term, unless an exception phrase covers it; a term that comes again adds half its
    weight once more, so one repeated line isn't mistaken for much evidence.
    """
    folded = fold(text)
    n_words = folded.count(" ") + folded.count("\n") + 1
    if matcher is None:
        return 0.0, n_words
    hits = _hits(matcher, folded)
    times = Counter(term for _, _, term in hits.values())
    weights = {term: w for _, w, term in hits.values()}
    return sum(w * (1.0 + 0.5 * (times[t] > 1)) for t, w in weights.items()), n_words


def phrases_of(matcher, text: str) -> Iterator[tuple[str, str]]:
    """(phrase, context) of each hit with the word before it and with the one after, one space apart; the context is the
    word on the other side of the phrase."""
    folded = fold(text)
    hits = _hits(matcher, folded) if matcher is not None else {}
    if not hits:
        return
    words = [(m.start(), m.end()) for m in WORDS.finditer(folded)]
    word = lambda i: folded[slice(*words[i])] if 0 <= i < len(words) else ""
    for i, (start, _) in enumerate(words):
        if start in hits:
            for a, b, other in ((i - 1, i, i + 1), (i, i + 1, i - 1)):
                if a >= 0 and b < len(words) and folded[words[a][1] : words[b][0]] == " ":
                    yield f"{word(a)} {word(b)}", word(other)


def _features(lexicon: Lexicon, labelled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for part in (p for b in batches for p in text_slices(b, "text")):
            found = [weigh(matcher, t or "") for t in part.column("text").to_pylist()]
            y = part.column("y") if labelled else pa.nulls(part.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), y.cast(pa.int32()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "y", "weight", "words"])

    return run


def terms_of(text: str) -> Iterator[tuple[str, str]]:
    """(term, previous word) of each word of a folded text and of its beginnings, which end in ``*``."""
    before = ""
    for m in WORDS.finditer(fold(text)):
        word = m.group()
        yield word, before
        for n in PREFIXES:
            if len(word) > n:
                yield word[:n] + "*", before
        before = word


def _contexts(only: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in text_slices(b, "text", size=1 << 18)):
            found = {(t, c) for text in part.column("text").to_pylist() for t, c in terms_of(text) if only is None or t in only}
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], names=["term", "context"])

    return run


def learn_lexicon(sample: DataFrame, exceptions: Iterable[str] = (), certainty: float = 0.1, precision: float = 0.9, least: int = 3) -> Lexicon:
    """A lexicon from (doc_id, text, y).

    A word enters if at least ``precision`` of its contexts, and a beginning if all, are in toxic texts and as many by chance would be expected
    of fewer than ``certainty`` of all the terms that were tried. Its weight is its smoothed log odds. What is collected
    is bounded by the sample. A sample without toxic or without clean texts gives an empty lexicon.
    """
    counts = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, {}, tuple(exceptions))
    schema = "term string, context string"
    seen = sample.where("y = 1").select("text").mapInArrow(_contexts(None), schema).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    in_toxic = {r["term"]: r["n"] for r in seen.collect()}
    others = sample.where("y = 0").select("text").mapInArrow(_contexts(frozenset(in_toxic)), schema).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    in_clean = {r["term"]: r["n"] for r in others.collect()}
    share = toxic / (toxic + clean)
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for term, t in in_toxic.items():
        n = in_clean.get(term, 0)
        if t < precision * (t + n) or n and term.endswith("*"):
            continue
        # log of the chance that t of t + n contexts are toxic: log(share**t * binomial), an upper bound for n = 0
        chance = t * log(share) + sum(log((t + n - k) / (k + 1)) for k in range(n))
        if chance <= log(certainty / len(in_toxic)):
            weight = log((t + 0.5) / (toxic + 1)) - log((n + 0.5) / (clean + 1))
            (stems if term.endswith("*") else words)[term.rstrip("*")] = weight
    return Lexicon(words, stems, tuple(exceptions))


def _phrases(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for part in (p for b in batches for p in text_slices(b, "text")):
            found = {(p, c, y) for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True) for p, c in phrases_of(matcher, text)}
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], names=["phrase", "context", "y"])

    return run


def learn_exceptions(sample: DataFrame, lexicon: Lexicon, least: int = 3) -> tuple[str, ...]:
    """Phrases with a term of ``lexicon`` that come in at least ``least`` contexts of clean texts and in no toxic text.

    What is collected is bounded by the sample.
    """
    seen = sample.select("text", "y").mapInArrow(_phrases(lexicon), "phrase string, context string, y int").distinct()
    clean, toxic = (F.count(F.when(F.col("y") == y, F.lit(1))).alias(name) for y, name in ((0, "clean"), (1, "toxic")))
    found = seen.groupBy("phrase").agg(clean, toxic).where((F.col("clean") >= least) & (F.col("toxic") == 0))
    return tuple(sorted(r["phrase"] for r in found.select("phrase").collect()))


def _score(lexicon: Lexicon, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    b, w, d = lexicon.coefficients
    return 1 / (1 + np.exp(-(b + _inputs(weight, words) @ np.array([w, d]))))


def _inputs(weight, words):
    return np.column_stack((np.log1p(weight), np.log1p(100 * weight / (words + 20))))


def fit(sample: DataFrame, exceptions: Iterable[str] = ()) -> Lexicon:
    """The lexicon of a labelled sample, with the given and the learned exceptions and the coefficients of its score."""
    lexicon = learn_lexicon(sample, exceptions)
    lexicon = replace(lexicon, exceptions=(*lexicon.exceptions, *learn_exceptions(sample, lexicon)))
    rows = sample.mapInArrow(_features(lexicon, True), FEATURES).select("y", "weight", "words").toPandas()
    if rows["y"].nunique() < 2:
        return lexicon
    w = logistic(_inputs(rows["weight"].to_numpy(), rows["words"].to_numpy()), rows["y"].to_numpy())
    # More weight never lowers a score.
    return Lexicon(lexicon.words, lexicon.stems, lexicon.exceptions, (float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, weight) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null texts are scored as empty ones: no hits. Repeated rows are scored each; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_features(lexicon, False), FEATURES)
    b, w, d = lexicon.coefficients
    x = F.lit(b) + F.lit(w) * F.log1p("weight") + F.lit(d) * F.log1p(F.lit(100.0) * F.col("weight") / (F.col("words") + 20))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    return rows.select("doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "weight")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, weight, held_out) for every row of ``docs``, fitted on ``labels.toxic`` outside the
    held-out fold; labels other than 0 and 1 are ignored.

    Null and empty texts are scored as texts without hits; rows with a null id are scored and not held out; repeated
    rows are scored each. Without labels of both kinds nothing is toxic. An empty table gives no rows; other columns
    are ignored.
    """
    lexicon = fit(labelled_sample(docs, labels, "toxic", rows))
    return score_toxicity(docs, lexicon, threshold).withColumn("held_out", held_out(F.col("doc_id")))


def clean_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose toxicity score stays below ``threshold``, with all their columns, of any name.

    Fitted and scored as by ``toxicity``: null and empty texts and rows with a null id stay unless they score so high,
    repeated rows are judged alike, an empty table gives no rows.
    """
    lexicon = fit(labelled_sample(docs, labels, "toxic", rows))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for part in (p for b in batches for p in text_slices(b, at)):
            found = np.array([weigh(matcher, t or "") for t in part.column(at).to_pylist()], dtype=np.float64).reshape(-1, 2)
            yield part.filter(pa.array(_score(lexicon, found[:, 0], found[:, 1]) < threshold))

    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
