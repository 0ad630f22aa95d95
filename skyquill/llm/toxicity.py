"""Toxicity of texts behind a noisy channel: Viterbi decoding of disguised words, then a score of the restored text.

A writer may have replaced letters by look-alikes, repeated them, or set spaces and dots between them. For each word or run of
single characters that looks so, a lattice holds what every character may stand for (itself, a letter it looks like, part of
a repetition, or nothing between letters); the likeliest path under a character trigram model of the corpus is the
restored word. Words that show no such sign are their own restoration. Both the written and the restored word are scored.

The character model is counted over all texts. The scorer weighs words and word beginnings by how much likelier toxic
texts hold them, on a bounded sample of labelled rows (``SAMPLE``, the least hashes of doc_id), and calibrates the sum by
weighing each half of the sample with the words of the other. Null texts are empty texts and get a score like any. Rows of equal text get equal scores.
Nothing but the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm.storage import small_batches, stored
from skyquill.llm.textkit import IS_SEPARATOR, LOWER, SEPARATORS, slices, text_bytes, word_borders

#: Labelled rows that the scorer is fitted on at most.
SAMPLE = 20_000
#: Words and beginnings that keep a weight, and toxic texts that must hold one.
FEATURES, LEAST_TEXTS = 20_000, 3
#: Score from which a text counts as toxic.
THRESHOLD = 0.7

#: What characters may stand for besides themselves (look-alikes, as text).
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
              "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou"}
#: Log probabilities of the channel: a character as it is, a look-alike, a repeated one, a mark between letters.
PLAIN, DISGUISED, REPEATED, BETWEEN = math.log(0.9), math.log(0.08), math.log(0.3), math.log(0.5)

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the model: word border, a-z, bytes of other letters, marks and digits.
_OTHER, _MARKS, _SYMBOLS = 27, 28, 29
_SYMBOL = np.full(256, _OTHER, np.uint8)
_SYMBOL[:128] = _MARKS
_SYMBOL[list(_LETTERS.encode())] = np.arange(1, 27)
_SYMBOL[list(SEPARATORS)] = 0

_EDGES = b".,;:?\"'()[]{}<>*_-~`"
_MARK = rb"[0-9@$!|+(*#]"
_DISGUISE = re.compile(rb"[a-z]" + _MARK + rb"|" + _MARK + rb"[a-z]|([a-z])\1\1|[a-z][.\-_*][a-z][.\-_*][a-z]")
#: Single characters, each set off by one or two spaces or marks: three or more of them.
_SPACED = re.compile(rb"(?<![^\x20\x09-\x0D])(?:[a-z0-9@$!|+][\x20.\-_*]{1,2}){2,}[a-z0-9@$!|+](?![^\x20\x09-\x0D.,;:?!])")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of symbols, the borders of words and texts included."""
    total = np.zeros(_SYMBOLS ** 3, np.int64)
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for a, b in slices(offsets):
            codes = _SYMBOL[LOWER[data[offsets[a]:offsets[b]]]].astype(np.int32)
            codes = np.concatenate([[0], np.insert(codes, (offsets[a + 1:b + 1] - offsets[a]), 0), [0]])
            total += np.bincount(codes[:-2] * _SYMBOLS ** 2 + codes[1:-1] * _SYMBOLS + codes[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(third | first, second) of symbols, counted over all texts and smoothed by shorter histories."""
    counts = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "gram int, n long")
              .groupBy("gram").agg(F.sum("n").alias("n")))
    with small_batches(docs.sparkSession):
        counts = counts.toPandas()  # as many rows as trigrams of symbols at most
    grams = np.zeros(_SYMBOLS ** 3)
    grams[counts["gram"]] = counts["n"]
    grams = grams.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    one = (grams.sum(axis=(0, 1)) + 1) / (grams.sum() + _SYMBOLS)
    two = (grams.sum(axis=0) + 5 * one) / (grams.sum(axis=0).sum(axis=1, keepdims=True) + 5)
    three = (grams + 5 * two[None]) / (grams.sum(axis=2, keepdims=True) + 5)
    return np.log(three)


@dataclass
class Restorer:
    """Viterbi decoding of one disguised word at a time; decoded words are remembered."""

    model: np.ndarray
    remembered: int = 100_000
    known: dict[bytes, bytes] = field(default_factory=dict)

    def _readings(self, character: str) -> list[tuple[str, int, float]]:
        if character in _LETTERS:
            return [(character, _LETTERS.index(character) + 1, PLAIN)]
        readings = [(character, _MARKS if character.isascii() else _OTHER, PLAIN)]
        return readings + [(x, _LETTERS.index(x) + 1, DISGUISED - math.log(len(LOOKS_LIKE[character])))
                           for x in LOOKS_LIKE.get(character, "")]

    def word(self, written: bytes) -> bytes:
        """The likeliest word behind ``written`` (lower case, without what surrounds it)."""
        found = self.known.get(written)
        if found is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            found = self.known[written] = self._decode(written)
        return found

    def _decode(self, written: bytes) -> bytes:
        model = self.model
        text = written.decode()
        long_run = [False] * len(text)  # of three and more of a character
        for found in re.finditer(r"(.)\1\1+", text):
            long_run[found.start():found.end()] = [True] * (found.end() - found.start())
        # state: the last two symbols, the last letter as written; value: log probability and a chain of restored letters
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for character, repeats in zip(text, long_run, strict=True):
            after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

            def offer(state: tuple[int, int, str], value: float, chain: tuple | None) -> None:
                if state not in after or after[state][0] < value:  # noqa: B023
                    after[state] = (value, chain)  # noqa: B023

            readings = self._readings(character)
            for (x, y, last), (value, chain) in states.items():
                for letter, symbol, log in readings:
                    offer((y, symbol, letter), value + log + model[x, y, symbol], (letter, chain))
                    if repeats and letter == last:  # goes on saying the same letter
                        offer((x, y, last), value + log + REPEATED, chain)
                if character in " .-_*~" and last:
                    offer((x, y, last), value + BETWEEN, chain)
            states = after
        value, chain = max(((value + model[x, y, 0], chain) for (x, y, _), (value, chain) in states.items()), key=lambda z: z[0])
        letters = []
        while chain is not None:
            letter, chain = chain
            letters.append(letter)
        return "".join(reversed(letters)).encode()

    def words(self, text: bytes, odd: list[bytes] | None = None, spaced: bool = True) -> set[bytes]:
        """The distinct words of a lower-cased text, as written and as restored.

        ``odd`` are the words in which ``signs`` saw a disguise (all words are looked at without it), and
        ``spaced`` says whether it saw single characters set apart.
        """
        out = {word.strip(_EDGES) for word in set(text.split())}
        for word in list(out) if odd is None else odd:
            # a mark may also end a word, which then is not part of it
            for bare in {word.strip(_EDGES), word.strip(_EDGES).rstrip(b"!")}:
                if _DISGUISE.search(bare):
                    out.add(self.word(bare))
        if spaced:
            for run in _SPACED.finditer(text):
                out.add(self.word(run.group()))
        out |= {word.rstrip(b"!") for word in out if word.endswith(b"!")}
        out.discard(b"")
        return out


def features(words: set[bytes]) -> set[bytes]:
    """Words and beginnings of words (marked by a following tilde) of four, five and six bytes."""
    out = set(words)
    for n in (4, 5, 6):
        out.update({word[:n] + b"~" for word in words if len(word) > n})
    return out


_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[list(_LETTERS.encode())] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"0123456789@$!|+(*#")] = True
_IS_BETWEEN = np.zeros(256, bool)
_IS_BETWEEN[list(b".-_*")] = True
_IS_SINGLE = _IS_LETTER | _IS_MARK
_IS_APART = IS_SEPARATOR | _IS_BETWEEN


def signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lower-cased bytes show a sign of disguise, and where a single character stands apart from its neighbours.

    Both find every place that the patterns of words and of spaced runs can match at, and more.
    """
    n = len(data)
    odd, apart = np.zeros(n, bool), np.zeros(n, bool)
    if n > 2:
        letter, mark = _IS_LETTER[data], _IS_MARK[data]
        odd[:-1] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        odd[:-2] |= letter[:-2] & (data[:-2] == data[1:-1]) & (data[:-2] == data[2:])
        odd[:-2] |= letter[:-2] & _IS_BETWEEN[data[1:-1]] & letter[2:]
        apart[1:-1] = _IS_APART[data[:-2]] & _IS_SINGLE[data[1:-1]] & _IS_APART[data[2:]]
    return odd, apart


def _lower_texts(column: pa.Array) -> Iterator[tuple[bytes, list[bytes], bool]]:
    """Each text lower-cased, its words with a sign of disguise, and whether single characters stand apart in it."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets):
        part = LOWER[data[offsets[a]:offsets[b]]]
        whole = part.tobytes()
        at = offsets[a:b + 1] - offsets[a]
        odd, apart = signs(part)
        singles = np.concatenate([[0], np.cumsum(apart)])
        starts, ends, first = word_borders(part, at)
        strange = np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)
        strange = strange[strange >= 0]
        split = np.searchsorted(strange, first)
        words = [whole[s:e] for s, e in zip(starts[strange].tolist(), ends[strange].tolist(), strict=True)]
        for k, (s, e) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
            yield whole[s:e], words[split[k]:split[k + 1]], bool(singles[e] > singles[s])


def _tally(model: np.ndarray):
    """How many toxic and other texts of a task and half hold each feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        counts = {(toxic, half): Counter() for toxic in (1, 0) for half in (0, 1)}

        def given() -> Iterator[pa.RecordBatch]:
            names = list(set().union(*counts.values()))
            for s in range(0, len(names), 1 << 16):
                part = names[s:s + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.hex() for x in part]), *(pa.array([c[x] for x in part], pa.int64()) for c in counts.values())],
                    ["feature", "t0", "t1", "o0", "o1"])
            for c in counts.values():
                c.clear()

        for batch in batches:
            for toxic, half, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _lower_texts(batch.column(0)),
                                         strict=True):
                counts[toxic, half].update(features(restorer.words(*text)))
                if sum(map(len, counts.values())) > 500_000:
                    yield from given()
        yield from given()
    return run


@dataclass
class Scorer:
    """Weights of features, and a logistic curve over a text's weighty words."""

    model: np.ndarray
    weights: dict[bytes, float]
    curve: np.ndarray

    def __post_init__(self) -> None:
        #: the first bytes of all features: other words weigh nothing
        self.heads = {feature.removesuffix(b"~")[:4] for feature in self.weights}

    def measures(self, restorer: Restorer, text: tuple[bytes, list[bytes], bool]) -> tuple[float, ...]:
        """One, all evidence, the three weightiest words, and the share of weighty words."""
        words = restorer.words(*text)
        get, heads = self.weights.get, self.heads
        hits = sorted((best for word in words if word[:4] in heads and (best := max(get(word, 0.0), *(get(word[:n] + b"~", 0.0) for n in (4, 5, 6))))),
                      reverse=True)
        return 1.0, math.log1p(sum(hits)), sum(hits[:3]), 10 * len(hits) / (10 + len(words))

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures @ self.curve, -30, 30)))


def _measured(scorers: list[Scorer]):
    """Measures of (text, label, half) by the half's scorer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(scorers[0].model)
        for batch in batches:
            rows = [scorers[half].measures(restorer, text) for half, text in
                    zip(batch.column(2).to_pylist(), _lower_texts(batch.column(0)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])
    return run


def _scored(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(scorer.model)
        for batch in batches:
            rows = np.array([scorer.measures(restorer, text) for text in _lower_texts(batch.column(0))]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scorer.score(rows))], ["doc_id", "score"])
    return run


def _logistic(measures: np.ndarray, label: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a logistic curve with a small ridge."""
    curve = np.zeros(measures.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(measures @ curve, -30, 30)))
        slope = measures.T @ (p - label) + ridge * curve
        bend = (measures * (p * (1 - p))[:, None]).T @ measures + ridge * np.eye(len(curve))
        step = np.linalg.solve(bend, slope)
        curve -= step
        if np.abs(step).max() < 1e-8:
            break
    return curve


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> Scorer:
    """A scorer for ``docs`` from ``labels`` (doc_id, toxic); several labels of a document count by the highest."""
    model = character_model(docs)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    draw = F.xxhash64(F.lit(11), "doc_id")
    chosen = known.select("doc_id", "toxic", draw.alias("draw")).orderBy("draw", "doc_id").limit(sample)
    chosen = stored(chosen, "toxic-sample")
    rows = stored(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.pmod("draw", F.lit(2)).cast("int").alias("half")),
                  "toxic-rows")
    size = {(x["toxic"], x["half"]): x["n"] for x in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    counted = stored(rows.mapInArrow(_tally(model), "feature string, t0 long, t1 long, o0 long, o1 long").groupBy("feature").agg(
        *[F.sum(c).alias(c) for c in ("t0", "t1", "o0", "o1")]), "toxic-features")

    def weights(*halves: int) -> dict[bytes, float]:
        """A bound below the log ratio of a feature's share of toxic and of other texts, where it is clear."""
        toxic, other = (sum((F.col(f"{side}{h}") for h in halves), F.lit(0)) for side in ("t", "o"))
        all_toxic, all_other = (sum(size.get((side, h), 0) for h in halves) for side in (1, 0))
        ratio = F.log((toxic + 0.5) / (all_toxic + 1)) - F.log((other + 0.5) / (all_other + 1))
        bound = ratio - F.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
        top = (counted.where(toxic >= LEAST_TEXTS).select("feature", bound.alias("weight")).where("weight > 1")
               .orderBy(F.desc("weight"), "feature").limit(most).collect())
        return {bytes.fromhex(x["feature"]): x["weight"] for x in top}

    # the curve sees each half through the weights of the other
    halves = [Scorer(model, weights(1), np.zeros(4)), Scorer(model, weights(0), np.zeros(4))]
    seen: pd.DataFrame = rows.mapInArrow(_measured(halves), "toxic int, x array<double>").toPandas()  # no more than the sample
    curve = np.array([-3.0, 0.5, 0.5, 0.0])
    if seen["toxic"].nunique() == 2:
        curve = _logistic(np.stack(seen["x"]), seen["toxic"].to_numpy(float))
    return Scorer(model, weights(0, 1), curve)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) of every row, over its whole text."""
    return docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        _scored(scorer), "doc_id long, score double")
