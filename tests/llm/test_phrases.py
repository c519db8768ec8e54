"""Phrases against a plain count of all runs of words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most_words=3, least=10, covered=50, top=2000):
    found, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        if text is None:
            continue
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text.translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                found[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in found.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        covers = defaultdict(int)
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covers[p[i : i + k]] = max(covers[p[i : i + k]], a)
        scored = []
        for p, a in often.items():
            if 100 * covers[p] >= covered * a and covers[p]:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumn("block", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("words", F.lit(None))
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def texts(seed, count, vocab=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)] + ["É", "é", "New", "York", "ab#", "çelik", "日本"]
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "!"]) for _ in range(rng.randint(0, 80)))
    rows = [(make(), rng.choice(["en", "de", None])) for _ in range(count)]
    return rows + [("new york city " * rng.randint(1, 4), "en") for _ in range(20)] + [(None, "en"), ("", "de"), (" .,;", None)] + rows[:3]


@pytest.mark.parametrize("options", [{}, {"most_words": 2, "least": 5}, {"most_words": 5, "least": 3, "covered": 80}, {"top": 7}])
def test_like_a_plain_count(spark, options):
    rows = texts(len(options), 150)
    assert found(spark, rows, **options) == plain(rows, **options)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 200)
    monkeypatch.setattr(phrases, "WAITING", 500)
    rows = texts(9, 120, 12) + [("x y z " * 300, "en"), ("a" * 5000 + " b", "fr"), ("lone words\n" * 40, "xx")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, most_words=4) == plain(rows, 4)


def test_overlapping_repeats_and_ties(spark):
    rows = [("a a a a a a a a a a a a", "en"), ("b c b c b c b c b c b c b c b c b c b c b", "en"), *[("d e. f g. h i", "en")] * 12]
    got = found(spark, rows)
    assert got == plain(rows)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[2] in ("d e", "f g", "h i")] == ["d e", "f g", "h i"]


def test_nothing(spark):
    assert found(spark, []) == [] and found(spark, [(None, None), ("", "en"), ("one two three", "en")]) == []


def test_words_of_one_hash_stay_apart(monkeypatch):
    data = np.frombuffer(b"one two. one  three\ttwo", np.uint8)
    words, counts, seq = phrases.words_of(data)
    assert [words[i].decode() if i >= 0 else "|" for i in seq] == ["one", "two", "|", "one", "three", "two"] and sorted(counts) == [1, 2, 2]
    monkeypatch.setattr(phrases, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words, counts, seq = phrases.words_of(data)
    assert [words[i].decode() if i >= 0 else "|" for i in seq] == ["one", "two", "|", "one", "three", "two"] and sorted(counts) == [1, 2, 2]


def test_scores_beyond_64_bits(spark):
    f, left, right = 3 * 10**15, 4 * 10**15 + 1, 5 * 10**15 + 7
    row = spark.createDataFrame([(f, [left], [right])], "f bigint, prefixes array<bigint>, suffixes array<bigint>").select(F.expr(phrases.CUTS)[0]["score"].alias("s")).first()
    assert row.s == 1_000_000 * f * f // (left * right)
