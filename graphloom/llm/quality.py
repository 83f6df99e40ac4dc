"""Document quality: random-indexing word vectors, pooled, then a two-layer network.

Every word has a sparse random index vector from its hash; its vector is that plus the index
vectors of its neighbours in the training texts. A document is the mean of its words' vectors.
Runs of punctuation are words; capitals, repeats, digits and unknown words are words of their own.
The network gives a logit, and a temperature fitted on rows set aside makes it a probability.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, kept_in_worker, of_texts, pieces, with_last
from .labelled import labelled_sample

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
MARKS = ("<unknown>", "<capitals>", "<repeat>", "<digits>", "<break>")
UNKNOWN, CAPITALS, REPEAT, DIGITS, BREAK = range(len(MARKS))
UNSEEN = 1 << 40
#: A short text says little: its vector is drawn towards the average by so many words.
PRIOR = 20.0


def index_vector(word: str, dims: int, ones: int = 6) -> np.ndarray:
    """A sparse vector of +1 and -1, the same for a word wherever it is computed."""
    r = np.random.default_rng(np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32))
    v = np.zeros(dims, np.float32)
    v[r.choice(dims, ones, replace=False)] = r.choice([-1, 1], ones)
    return v


@dataclass
class Words:
    """Numbers of words; the same token always has the same number."""

    numbers: dict[str, int]
    most_kept: int = 100_000
    seen: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def number(self, token: str) -> int:
        if token.isdecimal():
            n = DIGITS
        elif len(token) > 1 and token.isupper():
            n = CAPITALS
        else:
            low = token.lower()
            n = self.numbers.get(low, -1)
            if n < 0:  # a number above all known words', so that repeats of it show
                n = UNSEEN + zlib.crc32(low.encode("utf-8", "surrogatepass"))
        if len(self.seen) >= self.most_kept:
            self.seen.clear()
        self.seen[token] = n
        return n

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, a break at each text's end, and each text's count."""
        all_numbers: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        get = self.seen.get
        for i, text in enumerate(texts):
            tokens = TOKEN.findall(text)
            own = [self.number(t) if n is None else n for n, t in zip(map(get, tokens), tokens, strict=True)]
            own.append(BREAK)
            counts[i] = len(own)
            all_numbers += own
        numbers = np.array(all_numbers, np.int64)
        again = np.zeros(len(numbers), bool)
        for lag in (1, 2, 3):  # a word again, or two or three words again
            same = (numbers[lag:] == numbers[:-lag]) & (numbers[lag:] >= len(MARKS))
            again[lag:] |= same if lag == 1 else same & np.concatenate([[False], same[:-1]])
        numbers[numbers >= UNSEEN] = UNKNOWN
        numbers[again] = REPEAT
        return numbers, counts


@dataclass
class QualityModel:
    words: Words
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    shift: float = 0.0
    temperature: float = 1.0

    def pooled(self, texts: list[str], prior: float = 0.0) -> np.ndarray:
        """The mean word vector of each text, as if it had ``prior`` average words besides."""
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        for a, b in pieces(texts, 1_000_000):
            numbers, counts = self.words.read(texts[a:b])
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            for k in range(b - a):  # a text's own words only: a mean over at most its length
                own = numbers[starts[k] : starts[k] + counts[k]]
                n = np.bincount(own) if len(own) > 4 * len(self.vectors) else None
                out[a + k] = (n @ self.vectors[: len(n)] if n is not None else self.vectors[own].sum(0)) / counts[k]
                out[a + k] = self.mean + (out[a + k] - self.mean) * (counts[k] / (counts[k] + prior))
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.mean) / self.spread
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2 + self.shift

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts, PRIOR)) / self.temperature, -50, 50)))


def fit_quality(rows: pd.DataFrame, share: float, dims: int = 64, hidden: int = 24, window: int = 2, least: int = 3, most_words: int = 20_000, rounds: int = 60, seed: int = 3) -> QualityModel:
    """Fits on rows (text, label); ``share`` is label 1's share where the sample came from."""
    texts, y = rows["text"].tolist(), rows["label"].to_numpy(np.float32)
    counts = Counter(t.lower() for x in texts for t in TOKEN.findall(x))
    names = [*MARKS, *(w for w, n in counts.most_common(most_words) if n >= least)]
    words = Words({w: i for i, w in enumerate(names) if i >= len(MARKS)})
    index = np.array([index_vector(w, dims) for w in names])
    numbers, _ = words.read(texts)
    context = np.zeros_like(index)
    for d in range(1, window + 1):
        a, b = numbers[:-d], numbers[d:]
        for p, q in ((a, b), (b, a)):  # the counts of pairs of words, times the neighbours' vectors
            pairs, n = np.unique(p * len(names) + q, return_counts=True)
            for lo in range(0, len(pairs), 25_000):
                word, near = np.divmod(pairs[lo : lo + 25_000], len(names))
                starts = np.flatnonzero(np.diff(word, prepend=-1))
                context[word[starts]] += np.add.reduceat(index[near] * n[lo : lo + 25_000, None].astype(np.float32), starts)
            del pairs, n
    words.seen.clear()
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    vectors = (unit(index) + unit(context)).astype(np.float32)
    r = np.random.default_rng(seed)
    zero = QualityModel(words, vectors, np.zeros(dims), np.ones(dims), r.normal(0, dims**-0.5, (dims, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), 0.0)
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the share is the score
        zero.w2[:] = 0
        zero.b2 = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return zero
    x = zero.pooled(texts)
    model = QualityModel(words, vectors, x.mean(0), x.std(0) + 1e-6, zero.w1, zero.b1, zero.w2, 0.0)
    z = (x - model.mean) / model.spread
    apart = np.arange(len(y)) % 5 == 0  # for the temperature
    train = np.flatnonzero(~apart)
    p = [model.w1, model.b1, model.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        r.shuffle(train)
        for lo in range(0, len(train), 64):
            k = train[lo : lo + 64]
            h = np.tanh(z[k] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[k]) / len(k)
            back = e[:, None] * p[2] * (1 - h * h)
            step += 1
            for a, g, m1, v1 in zip(p, (z[k].T @ back + 1e-3 * p[0], back.sum(0), h.T @ e + 1e-3 * p[2], np.array([e.sum()])), m, v, strict=True):
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                a -= 0.005 * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
    model.b2 = float(p[3][0])
    logit, t = model.logits(x[apart]), y[apart]
    loss = lambda c: np.logaddexp(0, -logit / c * (2 * t - 1)).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss)) if len(t) else 1.0
    own = float(y.mean())
    odds = lambda q: np.log(q / (1 - q))
    model.shift = float((odds(min(max(share, 1e-3), 1 - 1e-3)) - odds(own)) * model.temperature)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 3000) -> QualityModel:
    """Fits on at most ``most_rows`` labelled rows outside the held-out fifth."""
    return fit_quality(*labelled_sample(docs, labels, "quality", most_rows))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The input's columns and ``score_col``, the probability that a document is of label 1.

    Only the whole text is an input of the score; null counts as empty, which gets a score too. A
    column of the input named ``score_col`` is replaced. Repeated rows each get their score; an empty
    table gives an empty result. Without labelled rows of both kinds, all scores are label 1's share.
    """
    arrow_batches(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[list[str]]) -> Iterator[pa.Array]:
        own = kept_in_worker(f"quality {key}", lambda: shared.value)
        for texts in batches:
            yield pa.array(own.scores(texts), pa.float64())
        own.words.seen.clear()

    return with_last(docs, **{score_col: of_texts(run, "double")(F.col(f"`{text_col}`"))})
