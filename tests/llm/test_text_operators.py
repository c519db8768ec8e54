"""Quality rules, URL filters, HTML text, toxicity, token counts, word BPE and the token store against brute force."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import html_text, queries, quality, token_store, toxicity, url_rules, word_bpe
from quern.llm.common import released, scratch
from quern.llm.token_counts import token_counts
from quern.llm.tokens import SegmentMemo, default_path, safe_parts, special_strings, tokenizer

SF = "/root/testdata/sf0.001"
BYTE, WORD = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "word " * 9, "x" * 5000, "Straße ÉTÉ 東京 ｶﾞ \U0001f600", "a  b\t c\n d", "<|endoftext|> a <|startoftext|>b", "don't we'll 's", "end.\nNext line, same. ", "\x00 nul \x1c sep", "é" * 300 + " " + "tail " * 3000]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_tokens string"


def odd_docs(spark):
    """Odd texts, a null key, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, None, None, None, None, "clash") for i, t in enumerate(ODD)] + [(None, "a null key", "en", "s", 1, 0.5, "clash")] + [(3, ODD[3], None, None, None, None, "clash")]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("path", [BYTE, default_path("piece_bpe_32k.model")])
def test_token_counts(spark, path):
    got = token_counts(odd_docs(spark), path, batch_bytes=100, part_chars=50).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = ("a null key" if r.doc_id is None else ODD[r.doc_id]) or ""
        if path.endswith(".json"):
            want = len(tokenizer(path).encode(text, add_special_tokens=False).ids)
        else:
            import sentencepiece

            want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), want)
    assert token_counts(empty_docs(spark), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t'sa1!.é\u3000\u00a0\x1c<|>東", max_size=60), st.integers(1, 9))
def test_cuts_never_change_ids(text, most):
    ids = tokenizer(BYTE).encode(text, add_special_tokens=False).ids
    memo = SegmentMemo(BYTE, 50)
    parts = safe_parts(text, most, special_strings(BYTE))
    assert "".join(parts) == text
    assert [i for p in parts for i in tokenizer(BYTE).encode(p, add_special_tokens=False).ids] == ids
    assert [np.frombuffer(x, "<u2").tolist() for x in memo.encode([text, "", text])] == [ids, [], ids]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n'sa1!,.İÉßﬁ\u0308\u3000東<|endoftext|>thing", max_size=60))
def test_trie_codes_like_the_library(text):
    t = tokenizer(WORD)
    ids = t.encode(text, add_special_tokens=False).ids
    assert next(iter(word_bpe.codec(WORD).coded([text]))) == (" ".join(map(str, ids)), len(ids), t.decode(ids, skip_special_tokens=False))


def test_word_bpe_rows(spark):
    t = tokenizer(WORD)
    got = word_bpe.word_bpe_digests(odd_docs(spark), WORD, slice_bytes=64).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = ("a null key" if r.doc_id is None else ODD[r.doc_id]) or ""
        ids = t.encode(text, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    assert word_bpe.word_bpe(empty_docs(spark), WORD).count() == 0


def test_store_round_trip(spark):
    passage = " ".join(f"common{i}" for i in range(1500))
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame([(100 + i, f"start {i} " + passage) for i in range(12)], "doc_id bigint, text string"))
    folder = scratch(spark, "test")
    token_store.write_store(docs, folder, BYTE, 2, slice_bytes=3000)
    rows = {(r.key, r.start): list(r.ids) for r in token_store.read_documents(spark, folder).collect()}
    assert len(rows) == docs.count()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    at = 0
    for (key, start), ids in sorted(rows.items(), key=lambda x: x[0][1]):
        assert start == at
        at += len(ids)
        assert ids in [tokenizer(BYTE).encode(t, add_special_tokens=False).ids + [2] for t in texts[key]]
    keys = [k for k, _ in sorted(rows, key=lambda x: x[1])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    sums = {(r.key, r.start): r.ids_crc32 for r in token_store.document_checksums(spark, folder).collect()}
    assert sums == {k: zlib.crc32(np.array(v, "<u4").tobytes()) for k, v in rows.items()}
    chunks = token_store.chunks(spark, folder)
    assert chunks.count() == chunks.select("digest").distinct().count()
    used = sum(len(r.digests) for r in token_store.recipes(spark, folder).collect())
    assert chunks.count() < 0.6 * used  # the common passage is stored once
    assert len(token_store.store_root(spark, folder)) == 32 and token_store.manifest(spark, folder).agg(F.sum("n_tokens")).first()[0] == at


def test_damaged_store_is_found(spark):
    folder = scratch(spark, "test")
    token_store.write_store(spark.createDataFrame([(i, f"document {i} " + "has some words " * 300) for i in range(8)], "doc_id bigint, text string"), folder, BYTE, 2)
    parts = {name: spark.read.parquet(f"{folder}/{name}") for name in ("packs", "recipes", "manifest")}
    lost = parts["packs"].where("kind = 1").agg(F.min("digest")).first()[0]
    swapped = F.when(F.col("key") == 3, F.expr("concat(slice(digests, 2, 1), slice(digests, 1, 1), slice(digests, 3, 9999))")).otherwise(F.col("digests"))
    damages = [("packs", parts["packs"].where((F.col("kind") == 0) | (F.col("digest") != lost))), ("recipes", parts["recipes"].withColumn("digests", swapped)), ("recipes", parts["recipes"].where("key <> 5")), ("manifest", parts["manifest"].withColumn("n_docs", F.col("n_docs") + 1))]
    for i, (name, damaged) in enumerate([("packs", parts["packs"]), *damages]):
        other = scratch(spark, "test")
        for n, df in parts.items():
            (damaged if n == name else df).write.parquet(f"{other}/{n}")
        if i == 0:
            assert token_store.document_checksums(spark, other).count() == 8
        else:
            with pytest.raises(Exception, match="match|not in the packs"):
                token_store.document_checksums(spark, other).collect()


def test_empty_store(spark):
    folder = scratch(spark, "test")
    token_store.write_store(empty_docs(spark), folder, BYTE, 2)
    assert token_store.document_checksums(spark, folder).count() == 0 and token_store.store_root(spark, folder) == ""


def counts(text):
    w, t = words(text), text or ""
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    docs = odd_docs(spark).union(spark.createDataFrame([(50, "a b c d e f a b c d e f g\na b\na b\n#*", None, None, None, None, None)], DOCS))
    got = quality.quality_votes(docs).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        text = {None: "a null key", 50: "a b c d e f a b c d e f g\na b\na b\n#*"}.get(r.doc_id, ODD[r.doc_id] if r.doc_id is not None and r.doc_id < len(ODD) else None)
        want = counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and 0 <= r.quality <= 1 and not (r.base_failed and r.kept)
    assert quality.quality_votes(empty_docs(spark)).count() == 0 and quality.kept_documents(empty_docs(spark)).count() == 0


def em(patterns):
    """The same estimate in plain Python: rates of keeping, rejecting and abstaining by class, all free."""
    k, n = len(quality.RULES), sum(patterns.values())
    prior = {c: {1: p[0], -1: p[1], 0: 1 - sum(p)} for c, p in (("good", quality.GOOD), ("bad", quality.BAD))}
    share, rates = 0.8, {c: [dict(p) for _ in range(k)] for c, p in prior.items()}

    def posterior(v):
        g, b = share, 1 - share
        for x, good, bad in zip(v, rates["good"], rates["bad"], strict=True):
            g, b = g * good[x], b * bad[x]
        return g / (g + b)

    for _ in range(quality.ROUNDS):
        q = {v: posterior(v) for v in patterns}
        mass = {"good": {v: m * q[v] for v, m in patterns.items()}, "bad": {v: m * (1 - q[v]) for v, m in patterns.items()}}
        total = {c: sum(m.values()) for c, m in mass.items()}
        seen = lambda c, j, x: sum(m for v, m in mass[c].items() if v[j] == x)
        new = {c: [{x: (seen(c, j, x) + quality.IMAGINED * prior[c][x]) / (total[c] + quality.IMAGINED) for x in (1, -1, 0)} for j in range(k)] for c in mass}
        for j in range(k):  # worse than chance: both classes get the rates of all
            g, b = new["good"][j], new["bad"][j]
            if g[1] < b[1] or g[-1] > b[-1]:
                new["good"][j] = new["bad"][j] = {x: (total["good"] * g[x] + total["bad"] * b[x]) / n for x in g}
        rates, share = new, min(0.98, max(0.3, (total["good"] + 9) / (n + 10)))
    return {v: posterior(v) for v in patterns}


def test_planted_rates_are_recovered(spark):
    """Votes drawn from known rates: the estimate finds the share of good documents and each rule's rates to 0.05."""
    rng = np.random.default_rng(8)
    k, n, share = len(quality.RULES), 40_000, 0.7
    good = np.stack([rng.uniform(0.55, 0.95, k), rng.uniform(0.01, 0.1, k)])  # keep, reject
    bad = np.stack([rng.uniform(0.1, 0.4, k), rng.uniform(0.3, 0.55, k)])
    is_good = rng.random(n) < share
    u, p = rng.random((n, k)), np.where(is_good[:, None, None], good[None], bad[None])
    votes = np.where(u < p[:, 0], 1, np.where(u < p[:, 0] + p[:, 1], -1, 0))
    counted = collections.Counter(map(tuple, votes.tolist()))
    got = {tuple(r.votes): r.quality for r in quality.estimated(spark.createDataFrame([(list(v), m) for v, m in counted.items()], "votes array<int>, n bigint")).collect()}
    q = np.array([got[tuple(v)] for v in votes.tolist()])
    assert abs(q.mean() - share) < 0.05 and ((q >= 0.5) == is_good).mean() > 0.95
    for w, planted in ((q, good), (1 - q, bad)):
        for x, rates in zip((1, -1), planted, strict=True):
            assert np.abs((w[:, None] * (votes == x)).sum(axis=0) / w.sum() - rates).max() < 0.05


def test_quality_estimate_and_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    voted = quality.with_counts(docs).select("doc_id", quality.votes().alias("v")).collect()
    want = em(collections.Counter(tuple(r.v) for r in voted))
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, SF).collect()}
    for r in voted:
        assert abs(got[r.doc_id].quality - want[tuple(r.v)]) < 1e-9
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}


def test_weak_rule_is_learned(spark):
    """A source holds a third of the rows, and the rule of sentence ends alone rejects them: they are good all the same."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    n = docs.count()
    verse = spark.range(n // 2).select((F.col("id") + 10**9).alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 60), i -> concat('word', id, 'x', i)))").alias("text"))
    votes = quality.with_counts(verse).select(quality.votes().alias("v")).distinct().collect()
    assert [list(r.v) for r in votes] == [[1 if name != "stops" else -1 for name in quality.RULES]]
    got = {r.doc_id: r for r in quality.quality_votes(docs.union(verse)).collect()}
    assert all(r.kept for k, r in got.items() if k >= 10**9)
    known = [(r.quality, got[r.doc_id].kept) for r in labels.where("quality is not null").collect() if r.doc_id in got]
    assert sum(not kept for good, kept in known if not good) >= 0.95 * sum(not good for good, _ in known)
    assert sum(kept for good, kept in known if good) >= 0.9 * sum(good for good, _ in known)


RULES = queries.URL_RULES


def verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, (max(fits)[1] if fits else None), (max(fits)[2] if fits else None)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net", "https://net/", "http://x.net/de/", "http://notnet/", "http://my.example.com/de/a", "http://example.org/fr/", "http://a://b/", "x://É.org/fr/", "http://a.org?/fr/", "http://multi\nline.net/x"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://q.net/", "c"), (4, urls[4], "clash")], "page_id bigint, url string, verdict string")
    none = spark.createDataFrame([], "page_id bigint, label int")
    got = url_rules.url_verdicts(pages, none, RULES).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        h, p, rule, v = verdict("http://q.net/" if r.page_id is None else urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, rule, v or "allow")
    assert url_rules.url_verdicts(pages.limit(0), none, RULES).count() == 0


def test_url_association_rules(spark):
    rows = [(i, f"http://casino{'-win' if i % 3 else ''}.example.org/en/{i}") for i in range(60)] + [(100 + i, f"http://blog{i % 5}.example.org/en/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100 + i, int(i % 20 == 0)) for i in range(100)] + [(0, None), (999, 1)], "page_id bigint, label int")
    got = {r.page_id: r.verdict for r in url_rules.url_verdicts(pages, labels, []).collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[100 + i] for i in range(200)} == {"allow"}


def test_url_rules_match_brute_force(spark):
    pages, labels = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    taught = labels.select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("label"))
    tokens = pages.select("page_id", url_rules.url_tokens(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("tokens"))
    mined = url_rules.mined_rules(tokens.join(taught, "page_id").select("tokens", "label"), confidence=0.2, least=2, sure=-1)
    rules = [(set(r.tokens), r.confidence) for r in mined.collect()]
    got = {r.key: r.confidence for r in url_rules.rule_matches(tokens.withColumnRenamed("page_id", "key"), mined).collect()}
    want = {r.page_id: max(c for t, c in rules if t <= set(r.tokens)) for r in tokens.collect() if any(t <= set(r.tokens) for t, _ in rules)}
    assert rules and got == want
    assert {r.page_id: r.rule for r in queries.op2_url_filters(spark, SF).collect()} == {r.page_id: verdict(r.url)[2] for r in pages.collect()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="with-sidebar"><div id="cookie-notice">Cookies!</div>
<header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div class="wrap"><div class="post-body"><h2>Head &amp; more</h2><p>First&nbsp;para <a href=x>link</a> of the
  article, with words.<p><b>Second<br>para<p>Third &lt;p&gt; here.<ul><li>one<li>two</ul><div class="ad">Buy</div><form>Name <input></form><!-- <p>hidden</p> --><aside>side</aside>
<div class="comments"><p>Nice article, thank you for writing all of it, I read every single word of it!</p></div></div></div><footer>foot</footer></body></html>"""


def test_html_text(spark):
    want = "Head & more\nFirst para link of the article, with words.\nSecond para\nThird <p> here.\none\ntwo"
    rows = [(1, "http://h/1", PAGE), (2, None, PAGE), (3, "http://h/2", None), (4, "http://h/3", ""), (5, "http://h/4", "<p>only"), (6, "http://h/5", "plain text"), (1, "http://h/1", PAGE), (7, "http://h/6", "<div>" * 3000 + "<p>deep words</p>"), (8, "http://h/7", "<script>x")]
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))).collect()]
    texts = dict((k, t) for k, t, _ in got)
    assert len(got) == 9 and all(n == len(t) for _, t, n in got)
    assert texts == {1: want, 2: want, 3: "", 4: "", 5: "only", 6: "plain text", 7: "deep words", 8: ""}
    assert html_text.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_host_votes_outweigh_a_page(spark):
    page = lambda side, body: f"<body><div class='a'><p>{side}</p></div><div class='b{len(body)}'><p>{body}</p></div></body>"
    rows = [(i, "http://h/", page("short one", "long words " * 30)) for i in range(5)] + [(9, "http://h/", page("a side text that is longer here " * 20, "the body words"))]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "the body words"


def test_article_in_several_containers(spark):
    body = lambda x: f"<p>{f'{x} words of it. ' * 20}</p>"
    page = lambda inside: f"<body><nav>Menu</nav><div class='side'><p>a side text</p></div>{inside}<footer>foot</footer></body>"
    sections = page(f"<article><h1>Head</h1><div class=body><section>{body('first')}{body('more')}</section><section>{body('second')}</section></div></article>")
    grid = page(f"<main><h1>Head</h1><div class=row><div class=col>{body('first')}{body('more')}</div><div class=col>{body('second')}</div></div><div class=row><div class=col>{body('third')}</div></div></main>")
    named = page(f"<article><h1>Head</h1><section class=intro>{body('first')}</section><section class=rest>{body('second')}{body('third')}</section></article>")
    rows = [(i, "http://a/", sections) for i in range(3)] + [(10, "http://b/", grid), (11, None, grid), (20, "http://c/", named)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    text = lambda *parts: "\n".join(["Head", *[f"{x} words of it. " * 19 + f"{x} words of it." for x in parts]])
    assert got == {0: text("first", "more", "second")} | {i: text("first", "more", "second") for i in (1, 2)} | {i: text("first", "more", "second", "third") for i in (10, 11)} | {20: text("first", "second", "third")}


def test_test_pages(spark):
    for r in queries.op8_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        import html as h

        inside = re.sub("<br>", " ", re.search("(?s)<article>(.*?)</article>", r.html)[1])
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|div|ul|li)[^>]*>", inside)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}" for a in ("an", "the", "or", "en", "ti") for b in ("der", "ing", "on", "es", "ha")]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 30))
        if i % 4 == 0:
            w[int(rng.integers(30))] = "zorx" + str(rng.choice(plain))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, None), (5, rows[5][1])], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    labelled = spark.createDataFrame(labels + [(0, 1), (7777, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labelled).collect()
    assert len(got) == 600 + len(ODD) + 2
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.9
    for one in (labelled.where("toxic = 1"), labelled.limit(0)):
        assert toxicity.toxicity(docs, one).select("score").distinct().count() == 1
    assert toxicity.toxicity(docs.limit(0), labelled).count() == 0


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    def on_the_driver(*_):
        raise AssertionError("texts and training are in the driver's memory")

    rows = [(i, f"{'zorx' if i % 4 == 0 else 'other'} word{i % 7} and{i % 5}", int(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    learned = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 5), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1]))
    want = toxicity.fitted([r[1] for r in learned], [r[2] for r in learned])
    monkeypatch.setattr(toxicity, "fitted", on_the_driver)
    got = toxicity.toxicity(df.select("doc_id", "text").repartition(3), df.select("doc_id", "toxic")).orderBy("doc_id").collect()
    scores = toxicity.scores(want, *toxicity._packed([r[1] for r in rows]))
    assert np.abs(np.array([r.score for r in got]) - scores).max() < 1e-9
    assert toxicity.clean_documents(df, df).count() == int((scores < 0.5).sum())


def toxic_model(rng):
    plain = [f"{a}{b}" for a in ("an", "the", "or", "en", "ti") for b in ("der", "ing", "on", "es", "ha")]
    texts = [" ".join([*rng.choice(plain, 12), *(["zorx " + str(rng.choice(plain))] if i % 3 == 0 else [])]) for i in range(300)]
    return toxicity.fitted(texts, [int(i % 3 == 0) for i in range(300)])


def test_scores_match_a_direct_forward_pass():
    """Embeddings, filters, maxima and output, word by word; and the same in parts of a long text."""
    rng = np.random.default_rng(9)
    model = toxic_model(rng)
    for text in ("", "!!", "one", "the zorx ander", " ".join(rng.choice(["zorx", "ander", "été", "theha", "a1_b", "x" * 2500], 200))):
        w = toxicity.words_of(*toxicity._packed([text]))
        vectors = toxicity.embedded(model, w)
        run = np.concatenate([vectors[w.ids], np.zeros((3, toxicity.DIM), np.float32)])
        best = [max(sum(run[i + j] @ f[j][:, m] for j in range(width)) if i + width <= len(run) else 0.0 for i in range(len(run))) for f, width in zip(model.filters, toxicity.WIDTHS, strict=True) for m in range(toxicity.FILTERS)]
        want = np.maximum(np.array(best) + model.bias, 0) @ model.output + model.base
        assert abs(toxicity.logits(model, w)[0] - want) < 1e-4


def test_long_texts_are_scored_by_parts(monkeypatch):
    rng = np.random.default_rng(10)
    model = toxic_model(rng)
    words = ["zorx", "ander", "été", "theha", "le", "der", "the", "x" * 2500, "...", "\n \n", "-" * 300]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(6)] + ["é" * 20_000, " " * 9000, "." * 5000 + "zorx" + "." * 5000 + " ander", "zorx" * 5000]
    data, offsets = toxicity._packed(texts)
    whole = toxicity.scores(model, data, offsets)
    monkeypatch.setattr(toxicity, "SLICE", 1 << 11)
    assert np.abs(toxicity.scores(model, data, offsets) - whole).max() < 1e-5


def test_gradient_steps_lower_the_loss():
    """A step on a batch moves each part of the model as finite differences say."""
    rng = np.random.default_rng(11)
    model = toxic_model(rng)
    texts, y = ["zorx ander theha", "ander theha oron", "the zorx", "tion andes enha"], np.array([1, 0, 1, 0])
    w = toxicity.words_of(*toxicity._packed(texts))

    def loss():
        z = toxicity.logits(model, w)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    at = (0, 0, 0)
    for part in (model.bias, model.output, model.filters[0]):
        where = at[: part.ndim]
        old, values = part[where], []
        for move in (-1e-2, 1e-2):
            part[where] = old + move
            values.append(loss())
        part[where] = old
        slope = values[1] - values[0]
        before = np.array(part, float)
        keep = [np.array(x) for x in (model.vectors, *model.filters, model.bias, model.output)]
        base = model.base
        toxicity._step(model, w, y, [np.full(len(model.vectors), 1e-3, np.float32), *[np.full(f.shape, 1e-3, np.float32) for f in model.filters], np.full(model.bias.shape, 1e-3), np.full(model.output.shape, 1e-3)])
        moved = float(part[where] - before[where])
        for x, k in zip((model.vectors, *model.filters, model.bias, model.output), keep, strict=True):
            x[...] = k
        model.base = base
        assert abs(slope) < 1e-7 or moved * slope < 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="the larger tables are missing")
def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/check_s"
    rows = queries.op6_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    assert rows.predicted[rows.toxic == 1].mean() > 0.95 and rows.predicted[rows.toxic == 0].mean() < 0.02


def test_memory_freed_outside_the_heap_goes_back(spark):
    """The driver's JVM does not keep what it has freed outside its heap, beside a heap that may grow to its limit."""
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def own():  # MB above the addresses of a small heap
        found = re.findall(r"^([0-9a-f]+)-[0-9a-f]+ .*\n(?:\w+:.*\n)*?Anonymous:\s+(\d+)", open(f"/proc/{pid}/smaps").read(), re.M)
        return sum(int(size) for start, size in found if int(start, 16) >= 1 << 36) >> 10

    native = [jvm.java.util.zip.Deflater() for _ in range(2000)]  # zlib's memory, some 170 MB, is not in the heap
    for d in native[:-1]:
        d.end()
    for _ in range(3):
        jvm.System.gc()
    before = own()
    released(spark)
    assert before - own() > 100
    native[-1].end()
