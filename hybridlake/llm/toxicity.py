"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel compares two words by the subsequences of four letters they share, gaps allowed: each counts
``DECAY ** (its span)``, so inserted characters weaken a match but do not end it. A word's score is linear in its kernel
values to the landmarks (Nyström), hence linear in its subsequences: after training, the landmarks fold into one weight
per subsequence, a table of fixed size, and scoring a word looks up its own subsequences only. A text scores as its
most toxic word; letters written apart (``i d i o t``) are read as one word too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hybridlake.llm.stored import stored
from hybridlake.llm.texts import CACHED_LENGTH, CACHED_WORDS, documents, trimmed

ORDER = 4            # letters of a subsequence
SPAN = 8             # most characters it may stretch over
DECAY = 0.6
CODES = 34           # a-z, five classes of other letters, the start and the end of a word, and what is no letter
START, END, NONE = 31, 32, 33
LONGEST = 20         # longer words are read in overlapping windows of this many characters
SENTENCE_WORDS = 60

THRESHOLD = 0.3
#: The bounded sample of labelled documents a model is fitted on: the least hashes of each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
LANDMARKS = 128      # of witnesses, of other words and of hard ones each
WITNESSES, OTHERS, HARD = 500, 8000, 2000
LEAST_SENTENCES = 4  # sentences that hold a witness, at least; and one for each SHARE toxic documents
SHARE = 100
GAPPED = 0.3         # weight of a witness's gapped forms beside its own

SPLIT = re.compile(r"[.!?\n]+(?=\s|$)|\n")
APART = re.compile(r"(?<!\S)\S(?:\s\S(?!\S)){2,}")
DOTTED = re.compile(r"(?<!\w)(?:\w[^\w\s]){3,}\w(?!\w)")
NO_LETTER = re.compile(r"[\W_]+")


# --- subsequences ------------------------------------------------------------------
def _layout(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and decay of all subsequences of a word of ``n`` characters, span bounded."""
    at = [c for c in combinations(range(n), ORDER) if c[-1] - c[0] < SPAN]
    places = np.array(at, dtype=np.int64).reshape(-1, ORDER)
    return places, (DECAY ** (places[:, -1] - places[:, 0] + 1 - ORDER)).astype(np.float32)


_LAYOUTS = {n: _layout(n) for n in range(2, LONGEST + 3)}


def letters(words: list[str]) -> np.ndarray:
    """Codes of words of one length, between start and end: one row per word."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.int64)
    codes = np.full(flat.shape, NONE, dtype=np.int64)
    plain = (flat >= 97) & (flat <= 122)
    codes[plain] = flat[plain] - 97
    other = flat >= 0xAA
    codes[other] = 26 + flat[other] * 7 % 5
    edge = np.ones((len(words), 1), dtype=np.int64)
    return np.concatenate([edge * START, codes, edge * END], axis=1)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table index (-1: holds a character that is no letter) and decay of each subsequence; words of one length."""
    codes = letters(words)
    places, decay = _LAYOUTS[codes.shape[1]]
    index = np.zeros((len(words), len(places)), dtype=np.int64)
    none = np.zeros(index.shape, dtype=bool)
    for j in range(ORDER):
        picked = codes[:, places[:, j]]
        none |= picked == NONE
        index = index * CODES + picked
    index[none] = -1
    return index, decay


def norm(decay: np.ndarray) -> float:
    """Length of a word's feature vector if all its subsequences differ."""
    return float(np.sqrt((decay.astype(np.float64) ** 2).sum())) or 1.0


def windows(word: str) -> list[str]:
    """The word itself, or windows over a long one that overlap by half."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        groups.setdefault(len(word), []).append(i)
    return groups


def features(words: list[str], index: dict[int, int]) -> np.ndarray:
    """Kernel features of words over the subsequences in ``index``."""
    out = np.zeros((len(words), len(index)), dtype=np.float32)
    place = np.full(CODES ** ORDER + 1, -1, dtype=np.int64)
    place[list(index)] = list(index.values())
    for n, members in by_length(words).items():
        found, decay = subsequences([words[i] for i in members])
        at = place[found]
        rows = np.repeat(np.array(members), found.shape[1]).reshape(found.shape)
        ok = at >= 0
        np.add.at(out, (rows[ok], at[ok]), np.broadcast_to(decay / norm(decay), found.shape)[ok])
    return out


# --- the model -----------------------------------------------------------------------
@dataclass
class Model:
    """One weight per subsequence, the word bias, and the sigmoid that turns the best word into a score."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def words(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias, dtype=np.float64)
        for n, members in by_length(words).items():
            for at in range(0, len(members), 2048):
                part = members[at:at + 2048]
                found, decay = subsequences([words[i] for i in part])
                out[part] += (self.weights[found] * (decay / norm(decay))).sum(axis=1)
        return out

    def score(self, best: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * best + self.offset, -50, 50))))


def tokens(text: str | None) -> set[str]:
    """The distinct words of a text: separated by white space; letters written apart or dotted are read as one word too."""
    if not text:
        return set()
    lowered = text.lower()
    found = set(lowered.split())
    for run in APART.findall(lowered) + DOTTED.findall(lowered):
        found.add(NO_LETTER.sub("", run))
    found.discard("")
    return found


def sentences(text: str | None) -> list[str]:
    """Sentences of a text; longer ones are cut every SENTENCE_WORDS words."""
    out = []
    for sentence in SPLIT.split(text or ""):
        words = sentence.split()
        out += [" ".join(words[i:i + SENTENCE_WORDS]) for i in range(0, len(words), SENTENCE_WORDS)]
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear squared-hinge support vector machine by Newton steps; y is +1 or -1."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    loss = lambda w: 0.5 * w @ ridge @ w + c * (weight * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum()
    for _ in range(rounds):
        active = y * (x1 @ w) < 1
        xa, wa = x1[active], weight[active]
        gradient = ridge @ w + 2 * c * xa.T @ (wa * (xa @ w - y[active]))
        step = np.linalg.solve(ridge + 2 * c * (xa * wa[:, None]).T @ xa, gradient)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids and labels of the bounded sample: labelled rows whose crc32(doc_id) mod 4 is not 2, least hashes first.

    Rows with a NULL doc_id or label teach nothing; a doc_id with both labels counts as toxic.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != 2))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    ids = ids.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    pick = lambda label, n: ids.where(F.col("label") == label).orderBy("h", "doc_id").limit(n)
    return pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_CLEAN)).select("doc_id", "label")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the distinct sentences of the sample; None without words to tell the labels apart (every score is 0 then).

    A sentence has the label of its document; one that also stands in a clean document is clean. Counting each sentence
    once keeps groups of copies from speaking for the words they share. Words of enough toxic sentences and of no clean
    one are the witnesses, the positive instances; their gapped forms join them. Negative instances are words of clean
    sentences: the commonest, a sample by hash, and, after a first fit, those it finds most toxic. The sigmoid is fitted
    to the best word of each document of the sample.
    """
    sample = labelled_sample(docs, labels)
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label"), "labelled")

    def sentences_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [(s, label) for text, label in zip(frame["text"], frame["label"]) for s in sentences(text)]
            yield pd.DataFrame(found, columns=["sentence", "label"])

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            counts: dict[str, list[int]] = {}
            for sentence, label in zip(frame["sentence"], frame["label"]):
                for word in {w for t in tokens(sentence) for w in windows(t)}:
                    counts.setdefault(word, [0, 0])[label] += 1
            yield pd.DataFrame([(w, c, t) for w, (c, t) in counts.items()], columns=["word", "clean", "toxic"])

    distinct = rows.mapInPandas(sentences_of, "sentence string, label int").groupBy("sentence").agg(F.min("label").alias("label"))
    counts = stored(distinct.mapInPandas(words_of, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "word-counts")
    least = max(LEAST_SENTENCES, rows.where("label = 1").count() // SHARE)
    clean = counts.where("clean > 0")
    top = lambda df, n, *order: df.orderBy(*order, "word").limit(n).collect()
    witnesses = top(counts.where((F.col("clean") == 0) & (F.col("toxic") >= least)), WITNESSES, F.desc("toxic"))
    others = sorted({r["word"] for r in top(clean, OTHERS // 4, F.desc("clean")) + top(clean, OTHERS, F.xxhash64("word"))})
    if not witnesses or not others:
        return None
    words, seen = [r["word"] for r in witnesses], np.array([r["toxic"] for r in witnesses], dtype=np.float64)
    first = spark.sparkContext.broadcast(fit(words, seen, others, []))

    def scored_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"word": frame["word"], "score": first.value.words(frame["word"].tolist())})

    hard = top(clean.select("word").mapInPandas(scored_words, "word string, score double"), HARD, F.desc("score"))
    model = fit(words, seen, others, sorted(r["word"] for r in hard))
    table = spark.sparkContext.broadcast(model)

    def best_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(table.value)
        for frame in batches:
            yield pd.DataFrame({"best": scorer.best(frame["text"].tolist()), "label": frame["label"]})

    found = rows.mapInPandas(best_of, "best double, label int").toPandas()  # two numbers per document of the sample
    model.slope, model.offset = sigmoid(found["best"].to_numpy(), found["label"].to_numpy())
    return model


def gapped(word: str) -> list[str]:
    """Forms of a word with characters put in: all letters apart, one sign inside, one letter twice."""
    half = len(word) // 2
    return [".".join(word), f"{word[:half]}*{word[half:]}", f"{word[:half]}{word[half:half + 1]}{word[half:]}"]


def fit(witnesses: list[str], seen: np.ndarray, others: list[str], hard: list[str]) -> Model:
    """The kernel machine over words, folded into one weight per subsequence; ``hard`` are others it took for toxic."""
    forms = [(f, n) for word, n in zip(witnesses, seen) for f in gapped(word) if len(f) <= LONGEST]
    own, seen = witnesses, np.concatenate([seen, [GAPPED * n for _, n in forms]])
    witnesses = witnesses + [f for f, _ in forms]
    step = lambda words, n: words[::max(1, len(words) // n)][:n]
    landmarks = own[:LANDMARKS] + step(others, LANDMARKS) + step(hard, LANDMARKS)
    used = sorted({int(i) for n, m in by_length(landmarks).items() for i in np.unique(subsequences([landmarks[k] for k in m])[0]) if i >= 0})
    index = {code: k for k, code in enumerate(used)}
    phi = features(landmarks, index)
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    keep = values > 1e-5 * max(values.max(), 1e-12)
    project = vectors[:, keep] / np.sqrt(values[keep])  # kernel values to the landmarks → Nyström features
    words = witnesses + others + hard
    x = np.concatenate([features(words[i:i + 100], index) @ phi.T for i in range(0, len(words), 100)]) @ project
    rest = len(words) - len(witnesses)
    y = np.concatenate([np.ones(len(witnesses)), -np.ones(rest)])
    weight = np.concatenate([seen / seen.sum(), np.full(rest, 1.0 / rest)]) * len(y) / 2
    direction, bias = svm(x, y, weight)
    weights = np.zeros(CODES ** ORDER + 1, dtype=np.float32)  # the last one, for -1, stays 0
    weights[used] = phi.T @ (project @ direction)
    return Model(weights, bias, 1.0, 0.0)


def sigmoid(best: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid by Newton steps, with his smoothed targets, both labels of equal weight."""
    n1, n0 = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, 0.5 / n1, 0.5 / n0)
    x = np.stack([np.clip(best, -5, 5), np.ones(len(best))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


class Scorer:
    """Scores of words seen by one worker, in a bounded table."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def best(self, texts: list[str | None]) -> list[float]:
        """The score of the most toxic word of each text; a text without words scores as one that shares nothing."""
        out = []
        for text in texts:
            words = tokens(text)
            new = [w for w in words if w not in self.known]
            if new:
                if len(self.known) + len(new) > CACHED_WORDS:
                    self.known, new = {}, list(words)
                parts = [windows(w) for w in new]
                values = self.model.words([p for ps in parts for p in ps])
                ends = np.cumsum([len(p) for p in parts])
                self.known.update(zip(new, np.maximum.reduceat(values, np.concatenate(([0], ends[:-1]))).tolist()))
            out.append(max(map(self.known.__getitem__, words), default=min(self.model.bias, -1.0)))
            for word in new:
                if len(word) > CACHED_LENGTH:
                    del self.known[word]
        return out


def toxicity(spark: SparkSession, model: Model | None, text: Column | str) -> Column:
    """Score of each whole text from 0 to 1. NULL and empty texts score as texts without any toxic word."""
    table = spark.sparkContext.broadcast(model)  # a table of 33 ** 4 weights, whatever the corpus

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(table.value) if table.value else None
        for texts in trimmed(batches, scorer.known if scorer else None):
            yield pd.Series([scorer.model.score(b) for b in scorer.best(texts.tolist())] if scorer else [0.0] * len(texts), dtype="float64")

    return score(text)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; labels of one fold in four are held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", toxicity(spark, model, "text").alias("score"))
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
