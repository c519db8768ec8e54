"""Mining of URL rules against all itemsets, and URLs that would have FP-growth list too many."""

import itertools
import math
import random

from quern.llm import url_rules


def test_mining_matches_all_itemsets(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        own = sorted(t for t, p in (("a", 0.5), ("b", 0.5), ("c", 0.3), ("d", 0.3), ("e", 0.2)) if rng.random() < p)
        own += ["a2"] * ("a" in own)  # always beside a
        rows.append((own, int(rng.random() < (0.9 if {"a", "b"} <= set(own) else 0.2))))
    least, confidence, sure = 5, 0.5, 1.5
    total, blocked = len(rows), sum(label for _, label in rows)
    base, rules = blocked / total, {}
    far = lambda n, m: m / n >= base and sum(x * math.log(x / n / b) for x, b in ((m, base), (n - m, 1 - base)) if x) > sure
    for k in range(1, 6):
        for own in itertools.combinations("abcde", k):
            fits = [label for tokens, label in rows if set(own) <= set(tokens)]
            if sum(fits) >= least and sum(fits) / len(fits) >= confidence and far(len(fits), sum(fits)):
                rules[own] = sum(fits) / len(fits)
    want = {o: c for o, c in rules.items() if not any(set(p) < set(o) and rules[p] >= c for p in rules)}
    want = {tuple(sorted([*o, *(["a2"] if "a" in o else [])])): c for o, c in want.items()}
    got = {tuple(r.tokens): r.confidence for r in url_rules.mined_rules(spark.createDataFrame(rows, "tokens array<string>, label int"), support=0.0, confidence=confidence, least=least, sure=sure).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[o] - want[o]) < 1e-12 for o in want)


def test_items_behind_the_first_ones_of_a_row_are_in_rules_too(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        own = sorted(t for t, p in (("a", 0.5), ("b", 0.6), ("c", 0.5), ("d", 0.7), ("e", 0.4), ("f", 0.8)) if rng.random() < p)
        rows.append((own, int(rng.random() < (0.95 if {"b", "d", "f"} <= set(own) else 0.9 if {"a", "c"} <= set(own) else 0.2))))
    frame = spark.createDataFrame(rows, "tokens array<string>, label int")
    mined = lambda: {tuple(r.tokens): (round(r.confidence, 12), round(r.support, 12)) for r in url_rules.mined_rules(frame, support=0.0, confidence=0.5, least=5, sure=1.5).collect()}
    want = mined()
    assert max(map(len, want)) > 2
    for most in (0, 1, 2, 3):
        monkeypatch.setattr(url_rules, "ITEMS", most)
        assert mined() == want


def test_rules_by_chance_are_pruned(spark):
    rng = random.Random(5)
    rows = [([f"t{rng.randrange(60)}", f"u{rng.randrange(5)}"], int(rng.random() < 0.3)) for _ in range(2000)]
    assert url_rules.mined_rules(spark.createDataFrame(rows, "tokens array<string>, label int"), confidence=0.4).count() == 0


def test_copies_of_long_urls(spark):
    """60 copies of a URL of 40 segments, and URLs that mix many segments: FP-growth would list 2**40 and 2**20 sets."""
    long_ = "http://bad.example.org/" + "/".join(f"seg{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    rng = random.Random(6)
    mixes = ["http://mix.example.org/" + "/".join(f"part{chr(97 + j)}" for j in range(22) if rng.random() < 0.9) for _ in range(60)]
    rows = [(i, long_) for i in range(60)] + [(100 + i, f"http://good{i % 7}.example.org/en/{i}") for i in range(200)] + [(400 + i, u) for i, u in enumerate(mixes)]
    labels = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(150)] + [(400 + i, i % 2) for i in range(40)]
    got = {r.page_id: r.verdict for r in url_rules.url_verdicts(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, label int"), []).collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[100 + i] for i in range(200)} == {"allow"}
