"""A sentence encoder over given weights: word pieces, a transformer's forward pass in numpy, the first token's state, length 1.

Weights are an .npz file with arrays named as below, and its vocabulary a text file of one piece a line; both must be where every worker can open them. A
worker loads them once. Texts are encoded in batches, longest beside longest, so that little is padding; what is padding is masked.

    word, position, kind (rows of the embeddings), norm.w, norm.b, heads, and for layer k: k.q.w, k.q.b, k.k.*, k.v.*, k.o.*, k.norm1.*, k.up.*, k.down.*, k.norm2.*

Matrices multiply from the right (rows of states times w). A null text counts as empty; a text of more pieces than there are positions is cut there, as the
published models do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql.types import ArrayType, FloatType

#: Texts that go through the layers together, and the smallest variance that is divided by.
BATCH, EPSILON = 32, 1e-12
#: Pieces that a vocabulary of this kind has, and characters of a word that are tried at most.
CLASSIFY, SEPARATE, UNKNOWN, INSIDE, LONGEST = "[CLS]", "[SEP]", "[UNK]", "##", 100


def _alone(c: str) -> bool:
    """Characters that are words by themselves: punctuation, symbols of ASCII, and CJK."""
    n = ord(c)
    return unicodedata.category(c)[0] == "P" or (n < 128 and not c.isalnum() and not c.isspace()) or 0x4E00 <= n <= 0x9FFF or 0x3400 <= n <= 0x4DBF or 0xF900 <= n <= 0xFAFF or 0x20000 <= n <= 0x2EBEF


def words(text: str) -> list[str]:
    """Lower-case words without accents and control characters."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return "".join(f" {c} " if _alone(c) else " " if c.isspace() else "" if unicodedata.category(c)[0] == "C" else c for c in plain).split()


def pieces(text: str | None, known: dict[str, int], most: int) -> list[int]:
    """Piece ids of a text between the first and the last token; each word by its longest known beginnings, or unknown as a whole."""
    out = [known[CLASSIFY]]
    for word in words(text or ""):
        own, at = [], 0
        while at < len(word) <= LONGEST:
            end = next((e for e in range(len(word), at, -1) if (INSIDE if at else "") + word[at:e] in known), None)
            if end is None:
                break
            own.append(known[(INSIDE if at else "") + word[at:end]])
            at = end
        out += own if at == len(word) else [known[UNKNOWN]]
    return [*out[: most - 1], known[SEPARATE]]


def _normed(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = x - x.mean(-1, keepdims=True)
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + EPSILON) * w + b


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function to seven digits (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - series * np.exp(-x * x))


class Encoder:
    def __init__(self, weights: dict[str, np.ndarray], vocabulary: list[str]):
        self.w, self.known = weights, {p: i for i, p in enumerate(vocabulary)}
        self.heads, self.most = int(weights["heads"]), len(weights["position"])
        self.layers = 1 + max((int(k.split(".")[0]) for k in weights if k.split(".")[0].isdigit()), default=-1)

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.w[f"{name}.w"] + self.w[f"{name}.b"]

    def forward(self, ids: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The first token's states of texts (rows of ids), where `there` marks what is no padding."""
        n, length = ids.shape
        x = _normed(self.w["word"][ids] + self.w["position"][:length] + self.w["kind"][0], self.w["norm.w"], self.w["norm.b"])
        size = x.shape[2] // self.heads
        for k in range(self.layers):
            q, key, v = (self._linear(x, f"{k}.{c}").reshape(n, length, self.heads, size).transpose(0, 2, 1, 3) for c in "qkv")
            seen = q @ key.transpose(0, 1, 3, 2) / np.sqrt(size) + np.where(there, 0, -1e9)[:, None, None, :]
            seen = np.exp(seen - seen.max(-1, keepdims=True))
            met = (seen / seen.sum(-1, keepdims=True)) @ v
            x = _normed(x + self._linear(met.transpose(0, 2, 1, 3).reshape(n, length, -1), f"{k}.o"), self.w[f"{k}.norm1.w"], self.w[f"{k}.norm1.b"])
            up = self._linear(x, f"{k}.up")
            x = _normed(x + self._linear(up * 0.5 * (1 + _erf(up / np.sqrt(2))), f"{k}.down"), self.w[f"{k}.norm2.w"], self.w[f"{k}.norm2.b"])
        return x[:, 0]

    def encode(self, texts: list[str | None]) -> np.ndarray:
        listed = [pieces(t, self.known, self.most) for t in texts]
        out = np.zeros((len(texts), self.w["word"].shape[1]))
        order = sorted(range(len(texts)), key=lambda i: len(listed[i]))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            ids = np.zeros((len(own), max(len(listed[i]) for i in own)), np.int64)
            there = np.zeros(ids.shape, bool)
            for row, i in enumerate(own):
                ids[row, : len(listed[i])], there[row, : len(listed[i])] = listed[i], True
            out[own] = self.forward(ids, there)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


def loaded(weights: str, vocabulary: str) -> Encoder:
    with np.load(weights) as found, open(vocabulary, encoding="utf-8") as f:
        return Encoder({k: found[k] for k in found.files}, f.read().splitlines())


def sentence_encoder(weights: str, vocabulary: str, batch: int = 256) -> Callable[[Column], Column]:
    """A function of a text column that gives vectors of length 1, for hybrid or dense retrieval."""

    def make():
        model = loaded(weights, vocabulary)
        return lambda texts: model.encode(texts.tolist()).astype(np.float32)

    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch)
