"""Toxicity: a bidirectional gated recurrent network with attention pooling, over windows of words.

A word's input is its own vector (unknown words share one) beside the mean of its character
trigrams' vectors. The network reads windows that overlap and together cover the whole text; a
document scores as its worst window. It is trained in numpy, on the worst windows of documents.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, kept_in_worker, of_texts, pieces, with_last
from .labelled import labelled_sample

WORD = re.compile(r"[^\W\d_]+")
TRIGRAMS = 4096

Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words (with marks at both ends), and where each word's begin."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashed = (codes[:-2] * 0x9E3779B1 ^ codes[1:-1] * 0x85EBCA77 ^ codes[2:] * 0xC2B2AE3D) * np.uint64(0x27D4EB2F165667C5)
    inside = (codes[:-2] != 3) & (codes[1:-1] != 3)
    number = np.cumsum(codes == 2)[:-2][inside] - 1
    return (hashed[inside] >> np.uint64(40)).astype(np.int64) % TRIGRAMS, np.searchsorted(number, np.arange(len(words)))


@dataclass
class ToxicModel:
    numbers: dict[str, int]
    p: Weights
    shift: float = 0.0
    width: int = 64
    step: int = 52

    @property
    def h(self) -> int:
        return self.p["u"].shape[1]

    def read(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, each word's number among them, and each text's count of words."""
        lists = [WORD.findall(x.lower()) for x in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        codes, uniques = pd.factorize(np.array([w for x in lists for w in x], object)) if counts.sum() else (np.zeros(0, np.int64), [])
        return list(uniques), codes, counts

    def windows(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every window's text, first word (of all texts' words) and length."""
        many = np.maximum(1, -(-(counts - (self.width - self.step)) // self.step))
        text = np.repeat(np.arange(len(counts)), many)
        at = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * self.step
        return text, at + (np.cumsum(counts) - counts)[text], np.minimum(self.width, counts[text] - at)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """A vector for each word, and what the gradient needs."""
        own = np.array([self.numbers.get(w, 0) for w in words], np.int64)
        grams, starts = trigrams(words)
        n = np.diff(starts, append=len(grams))
        chars = np.add.reduceat(self.p["chars"][grams], starts) / n[:, None]
        return np.concatenate([self.p["words"][own], chars], 1), (own, grams, n)

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Logits of windows. gates: (time, window, direction, 3h) from the inputs; mask: (time, window)."""
        t, n, h, p = *mask.shape, self.h, self.p
        states = np.empty((2, t, n, h), np.float32)
        kept: list = []
        for d, order in enumerate((range(t), range(t - 1, -1, -1))):
            u, state = p["u"][d], np.zeros((n, h), np.float32)
            for i in order:
                g, m = gates[i, :, d], mask[i][:, None]
                own = state @ u
                zr = sigmoid(g[:, : 2 * h] + own[:, : 2 * h])
                new = np.tanh(g[:, 2 * h :] + zr[:, h:] * own[:, 2 * h :])
                after = new + zr[:, :h] * (state - new)
                after = state + m * (after - state)
                if keep:
                    kept.append((d, i, state, zr, new, own[:, 2 * h :]))
                states[d, i] = state = after
        both = np.concatenate([states[0], states[1]], 2)
        look = np.tanh(both @ p["a"] + p["a0"])
        weight = np.where(mask > 0, look @ p["v"], -1e9)
        weight[0] = np.where(mask.any(0), weight[0], 0)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * both).sum(0)
        return pooled @ p["w"] + p["b"][0], [kept, both, look, weight, pooled]

    def logits(self, texts: list[str], block: int = 1024) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The logit of every window, the window's text, and the windows themselves."""
        words, codes, counts = self.read(texts)
        text, first, length = self.windows(counts)
        out = np.zeros(len(text), np.float32)
        h = self.h
        gates = np.zeros((1, 2, 3 * h), np.float32)
        for lo in range(0, len(words), 50_000):  # the gates' inputs, once for each distinct word
            x, _ = self.inputs(words[lo : lo + 50_000])
            gates = np.concatenate([gates, (x @ self.p["x"] + self.p["x0"]).reshape(-1, 2, 3 * h)])
        for lo in range(0, len(text), block):
            at = first[lo : lo + block] + np.arange(self.width)[:, None]
            mask = np.arange(self.width)[:, None] < length[lo : lo + block]
            number = np.where(mask, codes[np.minimum(at, max(len(codes) - 1, 0))] + 1, 0) if len(codes) else np.zeros(at.shape, np.int64)
            out[lo : lo + block] = self.run(gates[number], mask.astype(np.float32))[0]
        return out, text, (words, codes, first, length)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of label 1: of each text's worst window."""
        out = np.full(len(texts), -np.inf)
        for a, b in pieces(texts, 1_000_000):
            logit, text, _ = self.logits(texts[a:b])
            np.maximum.at(out, text + a, logit)
        return 1 / (1 + np.exp(-np.clip(out + self.shift, -50, 50)))

    def gradient(self, words: list[str], number: np.ndarray, length: np.ndarray, y: np.ndarray) -> Weights:
        """Of the mean loss over windows; number: (time, window) among ``words``."""
        p, h, (t, n) = self.p, self.h, number.shape
        mask = (np.arange(t)[:, None] < length).astype(np.float32)
        x, (own, grams, many) = self.inputs(words)
        gates = (x @ p["x"] + p["x0"]).reshape(-1, 2, 3 * h)[number]
        logit, (kept, both, look, weight, pooled) = self.run(gates, mask, keep=True)
        e = (sigmoid(logit) - y) / n
        g: Weights = {"w": pooled.T @ e, "b": np.array([e.sum()])}
        back = e[:, None] * p["w"]
        share = (both * back).sum(2)
        d_weight = weight * (share - (weight * share).sum(0)) * (mask > 0)
        d_look = d_weight[:, :, None] * p["v"] * (1 - look * look)
        g["v"] = np.einsum("tnk,tn->k", look, d_weight)
        g["a"], g["a0"] = np.einsum("tni,tnj->ij", both, d_look), d_look.sum((0, 1))
        d_both = weight[:, :, None] * back + d_look @ p["a"].T
        d_gates = np.zeros_like(gates)
        g["u"] = np.zeros_like(p["u"])
        d_state, last = np.zeros((n, h), np.float32), -1
        for d, i, state, zr, new, lin in reversed(kept):
            if d != last:
                d_state, last = np.zeros((n, h), np.float32), d
            d_state = d_state + d_both[i, :, d * h : (d + 1) * h]
            m = mask[i][:, None]
            d_after = d_state * m
            z, r = zr[:, :h], zr[:, h:]
            d_new = d_after * (1 - z) * (1 - new * new)
            d_z = d_after * (state - new) * z * (1 - z)
            d_r = d_new * lin * r * (1 - r)
            d_gates[i, :, d] = np.concatenate([d_z, d_r, d_new], 1)
            d_lin = np.concatenate([d_z, d_r, d_new * r], 1)
            g["u"][d] += state.T @ d_lin
            d_state = d_state * (1 - m) + d_after * z + d_lin @ p["u"][d].T
        per_word = np.zeros((len(words), 6 * h), np.float32)
        np.add.at(per_word, number.ravel(), d_gates.reshape(-1, 6 * h))
        g["x"], g["x0"] = x.T @ per_word, per_word.sum(0)
        d_x, dims = per_word @ p["x"].T, p["words"].shape[1]
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], own, d_x[:, :dims])
        np.add.at(g["chars"], grams, np.repeat(d_x[:, dims:] / many[:, None], many, axis=0))
        return g


def fit_toxicity(rows: pd.DataFrame, share: float, most_words: int = 6000, least: int = 4, dims: int = 8, hidden: int = 8, rounds: int = 6, seed: int = 5) -> ToxicModel:
    """Fits on rows (text, label). The first rounds take any window of a document, the later ones its
    worst (of documents of label 0 the worst two); ``share`` is label 1's share outside the sample.
    Few rows make smaller steps and more rounds, so that there are some 250 steps at least."""
    texts, y = rows["text"].tolist(), rows["label"].to_numpy(np.float32)
    r = np.random.default_rng(seed)
    counts = Counter(w for x in texts for w in set(WORD.findall(x.lower())))
    names = [w for w, n in counts.most_common(most_words) if n >= least]
    n = lambda *s: r.normal(0, s[-2] ** -0.5 if len(s) > 1 else 0.1, s).astype(np.float32)
    p: Weights = {"words": 0.3 * r.normal(size=(len(names) + 1, dims)).astype(np.float32), "chars": 0.3 * r.normal(size=(TRIGRAMS, dims)).astype(np.float32), "x": n(2 * dims, 6 * hidden), "x0": np.zeros(6 * hidden, np.float32), "u": n(2, hidden, 3 * hidden), "a": n(2 * hidden, hidden), "a0": np.zeros(hidden, np.float32), "v": n(hidden), "w": n(2 * hidden), "b": np.zeros(1, np.float32)}
    model = ToxicModel({w: i + 1 for i, w in enumerate(names)}, p)
    odds = lambda q: float(np.log(min(max(q, 1e-3), 1 - 1e-3) / (1 - min(max(q, 1e-3), 1 - 1e-3))))
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the share is the score
        p["w"][:] = 0
        model.shift = odds(share)
        return model
    words, codes, counts_ = model.read(texts)
    text, first, length = model.windows(counts_)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    size = min(128, max(16, len(texts) // 16))
    rounds = max(rounds, min(40, -(-250 * size // (2 * len(texts)))))
    for turn in range(rounds):
        early = turn < rounds // 2
        if early:  # any windows, up to three of a text
            order = r.permutation(len(text))
        else:
            order = np.argsort(-np.concatenate([model.logits(texts[lo : lo + 500])[0] for lo in range(0, len(texts), 500)]), kind="stable")
        rank = pd.Series(text[order]).groupby(text[order]).cumcount().to_numpy()
        chosen = order[rank < (3 if early else np.where(y[text[order]] > 0, 1, 2))]
        chosen = r.permutation(chosen[length[chosen] > 0])
        for lo in range(0, len(chosen), size):
            k = chosen[lo : lo + size]
            at = first[k] + np.arange(model.width)[:, None]
            number = codes[np.minimum(at, len(codes) - 1)]
            own, local = np.unique(number, return_inverse=True)
            step += 1
            for key, g in model.gradient([words[i] for i in own], local.reshape(number.shape), length[k], y[text[k]]).items():
                m[key] += 0.1 * (g - m[key])
                v[key] += 0.001 * (g * g - v[key])
                p[key] -= (0.01 / (1 + 2 * turn / rounds) * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    # windows were drawn by label; a scale and shift of the worst window's logit fit the documents
    logit = np.full(len(texts), -np.inf)
    for lo in range(0, len(texts), 500):
        got, of, _ = model.logits(texts[lo : lo + 500])
        np.maximum.at(logit, of + lo, got)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.shift = float(min(np.linspace(-6, 6, 121), key=lambda c: (weight * np.logaddexp(0, -(logit + c) * (2 * y - 1))).sum()))
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 2000) -> ToxicModel:
    """Fits on at most ``most_rows`` labelled rows outside the held-out fifth."""
    return fit_toxicity(*labelled_sample(docs, labels, "toxic", most_rows))


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The input's columns and ``score_col``, the probability that a document is toxic.

    Only the whole text is an input of the score; null counts as empty, and a text without words is
    one empty window. A column of the input named ``score_col`` is replaced. Repeated rows each get
    their score; an empty table gives an empty result. Without labelled rows of both kinds, all
    scores are label 1's share.
    """
    arrow_batches(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[list[str]]) -> Iterator[pa.Array]:
        own = kept_in_worker(f"toxicity {key}", lambda: shared.value)
        for texts in batches:
            yield pa.array(own.scores(texts), pa.float64())

    return with_last(docs, **{score_col: of_texts(run, "double")(F.col(f"`{text_col}`"))})
