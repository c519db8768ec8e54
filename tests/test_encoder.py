"""The sentence encoder against a plain forward pass, token by token."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import encoder
from quern.operators import retrieval as R

VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "fire", "##man", "##s", "water", "a", "b", "##c", "火", "灾", ",", ".", "cafe", "stairs", "use"]


def tiny(seed=0, d=8, heads=2, layers=2, positions=12):
    rng = np.random.default_rng(seed)
    w = {"word": rng.normal(size=(len(VOCABULARY), d)), "position": rng.normal(size=(positions, d)), "kind": rng.normal(size=(2, d)), "norm.w": rng.normal(size=d), "norm.b": rng.normal(size=d), "heads": np.array(heads)}
    for k in range(layers):
        for name, shape in (("q", (d, d)), ("k", (d, d)), ("v", (d, d)), ("o", (d, d)), ("up", (d, 3 * d)), ("down", (3 * d, d))):
            w[f"{k}.{name}.w"], w[f"{k}.{name}.b"] = rng.normal(size=shape) * 0.5, rng.normal(size=shape[1])
        for name in ("norm1", "norm2"):
            w[f"{k}.{name}.w"], w[f"{k}.{name}.b"] = rng.normal(size=d), rng.normal(size=d)
    return w


def plain(w, ids):
    def norm(x, name):
        m = sum(x) / len(x)
        v = sum((a - m) ** 2 for a in x) / len(x)
        return [(a - m) / math.sqrt(v + 1e-12) * s + b for a, s, b in zip(x, w[f"{name}.w"], w[f"{name}.b"], strict=True)]

    linear = lambda x, name: [sum(a * w[f"{name}.w"][i][j] for i, a in enumerate(x)) + w[f"{name}.b"][j] for j in range(len(w[f"{name}.b"]))]
    states = [norm([w["word"][t][i] + w["position"][p][i] + w["kind"][0][i] for i in range(w["word"].shape[1])], "norm") for p, t in enumerate(ids)]
    for k in range(2):
        q, key, v = ([linear(x, f"{k}.{c}") for x in states] for c in "qkv")
        after = []
        for i, x in enumerate(states):
            met = []
            for h in range(2):
                part = slice(4 * h, 4 * h + 4)
                scores = [sum(a * b for a, b in zip(q[i][part], other[part], strict=True)) / 2 for other in key]
                e = [math.exp(s - max(scores)) for s in scores]
                met += [sum(share / sum(e) * o[part][c] for share, o in zip(e, v, strict=True)) for c in range(4)]
            x = norm([a + b for a, b in zip(x, linear(met, f"{k}.o"), strict=True)], f"{k}.norm1")
            up = [a * 0.5 * (1 + math.erf(a / math.sqrt(2))) for a in linear(x, f"{k}.up")]
            after.append(norm([a + b for a, b in zip(x, linear(up, f"{k}.down"), strict=True)], f"{k}.norm2"))
        states = after
    size = math.sqrt(sum(a * a for a in states[0]))
    return [a / size for a in states[0]]


TEXTS = ["Firemans use water", "", None, "火灾, fire.", "Café zebra abc", "fire " * 30, "a", "stairs"]


def test_word_pieces():
    known = {p: i for i, p in enumerate(VOCABULARY)}
    name = lambda t: [VOCABULARY[i] for i in encoder.pieces(t, known, 12)]
    assert name("Firemans,USE 火灾") == ["[CLS]", "fire", "##man", "##s", ",", "use", "火", "灾", "[SEP]"]
    assert name("Café firex abc bc") == ["[CLS]", "cafe", "[UNK]", "[UNK]", "b", "##c", "[SEP]"] and name(None) == ["[CLS]", "[SEP]"]
    assert len(name("fire " * 30)) == 12 and name("x" * 101) == ["[CLS]", "[UNK]", "[SEP]"]


def test_like_a_plain_forward_pass():
    w = tiny()
    model = encoder.Encoder(w, VOCABULARY)
    got = model.encode(TEXTS)
    for vector, text in zip(got, TEXTS, strict=True):
        assert np.allclose(vector, plain(w, encoder.pieces(text, model.known, 12)), atol=1e-5)
    assert np.allclose(model.encode(TEXTS[:1])[0], got[0])  # padding changes nothing


def test_in_spark_and_in_retrieval(spark, tmp_path):
    np.savez(tmp_path / "w.npz", **tiny())
    (tmp_path / "v.txt").write_text("\n".join(VOCABULARY) + "\n", encoding="utf-8")
    encode = encoder.sentence_encoder(str(tmp_path / "w.npz"), str(tmp_path / "v.txt"))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.id: r.v for r in df.select("id", encode("text").alias("v")).collect()}
    want = encoder.Encoder(tiny(), VOCABULARY).encode(TEXTS)
    assert all(np.allclose(got[i], want[i], atol=1e-6) for i in range(len(TEXTS)))
    docs = df.select(F.col("id").cast("string").alias("evidence_id"), F.coalesce("text", F.lit("")).alias("text"))
    best = R.hybrid(docs, docs.where("text = 'stairs'").select(F.lit("q").alias("query_id"), "text"), 1, 3, encoder=encode).first()
    assert best.evidence_id == "7"
    assert sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-6)
