"""Hashes of words and segments, on words that simple hashes take for each other."""

import numpy as np
import pytest

from quern.llm import common, tokens
from quern.llm.ngram_join import ngram_components
from quern.llm.tokens import default_path


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def packed(texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends


def test_span_hashes_tell_words_apart():
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("ab"), int(n))) for n in rng.integers(1, 40, 3000)} | {"a" * n for n in range(1, 200)} | {"\0" * n for n in range(1, 80)}
    words |= {w + "\0" for w in list(words)[:200]} | {f(n) for n in (8, 64, 1024, 4096) for f in (thue_morse, lambda n: thue_morse(n, "b", "a"))}
    words = sorted(words)
    hashes = common.span_hashes(*packed(words))
    assert len(set(hashes.tolist())) == len(words)
    assert (common.span_hashes(*packed([*words, *words]))[len(words) :] == hashes).all()


def test_spans_equal():
    data, starts, ends = packed(["a" * 9 + "c", "a" * 9 + "d", "a" * 9 + "c", "x" * 100, "x" * 99 + "y", "x" * 100, "abcd"])
    same = lambda like: common.spans_equal(data, starts, ends, np.array(like))
    assert same([0, 1, 0, 3, 4, 3, 6]) and not same([0, 0, 0, 3, 4, 3, 6]) and not same([0, 1, 0, 3, 3, 3, 6]) and not same([0, 1, 0, 3, 4, 3, 0])


def test_long_words_do_not_link(spark):
    texts = [thue_morse(4096), thue_morse(4096, "b", "a")]
    got = ngram_components(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 0}


@pytest.mark.parametrize("collide", [False, True])
def test_segments_of_one_hash(collide, monkeypatch):
    """Ids are the library's even if all segments of over eight bytes have one hash."""
    if collide:
        monkeypatch.setattr(tokens, "span_hashes", lambda *spans: np.where(spans[2] - spans[1] > common.EXACT, np.uint64(0), common.span_hashes(*spans)))
    path = default_path("byte_bpe_50k.json")
    texts = ["Some words, and more.\nSome words again\n\n  spaced é à l'été çà", thue_morse(2048) + " " + thue_morse(2048, "b", "a"), "Édition ×÷ naïveté\nÉlan's 'tis\nfin", "ÀÉ\nB 5\n6 a5 5a 中文 字　x y", "", " ", "\n", "a\n", "é\nb\nc,d\ne'\ns x"]
    memo = tokens.SegmentMemo(path)
    for _ in range(2):
        for t, ids in zip(texts, memo.encode(texts), strict=True):
            assert np.frombuffer(ids, memo.kind).tolist() == tokens.tokenizer(path).encode(t, add_special_tokens=False).ids
