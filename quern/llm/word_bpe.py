"""BPE encoding and decoding by a trie of distinct words.

The vocabulary is one whose words end in a suffix token ("word ends"). Distinct words go into a trie in sorted
order. A depth-first walk keeps, for each prefix on the current path, the last token of that prefix's encoding:
that token and the encoding of what precedes it give the whole encoding, so the encodings of shared prefixes are
computed once. A token may follow another one only if merging their characters gives back these two tokens.

Null and empty texts have no ids and decode to an empty text. Each text is handled as a whole, however long.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_bytes, held, small_batches, trimmed
from quern.llm.tokens import tokenizer

NEVER = 1 << 60
#: Lengths of tokens that a text may end in whatever its last characters.
_SHORT = (2, 1)


class TrieEncoder:
    """Ids of words in the byte-level alphabet, equal to those of rank-ordered merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left, right) as one integer -> (rank, merged)
        self.merges = {self.vocab[a] << 32 | self.vocab[b]: (r, self.vocab[a + b]) for r, (a, b) in reversed([*enumerate(pairs)])}
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        self.left: dict[int, list[tuple[int, int, int]]] = {}
        self.right: dict[int, list[tuple[int, int, int]]] = {}
        n = len(self.suffix)
        for token, i in self.vocab.items():
            ends = n and token.endswith(self.suffix) and len(token) > n
            bare = token[:-n] if ends else token
            symbols = [*bare[:-1], bare[-1] + self.suffix] if ends else [*bare]
            tree = self._merged([self.vocab[s] for s in symbols])
            if tree is None or tree[0] != i:
                continue  # merging its characters gives other tokens, so it never appears
            (self.final if ends else self.inner)[bare] = i
            self.left[i], self.right[i] = self._edge(tree, 1), self._edge(tree, 2)
        if not n:
            self.final = self.inner
        #: the lengths of tokens with the last three characters of a longer text, longest first
        self.inner_ends, self.final_ends = self._lengths(self.inner), self._lengths(self.final)
        self.follows: dict[int, bool] = {}
        self.size = {i: len(t) for t, i in self.inner.items()} | {i: len(t) for t, i in self.final.items()}

    @staticmethod
    def _lengths(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        by_end: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) > 2:
                by_end.setdefault(t[-3:], set()).add(len(t))
        return {end: (*sorted(lengths, reverse=True), *_SHORT) for end, lengths in by_end.items()}

    def _merged(self, ids: list[int]) -> tuple | None:
        """The tree (token, left, right, rank) if merging by rank, leftmost first, leaves one token."""
        trees = [(i, None, None, -1) for i in ids]
        while len(trees) > 1:
            best = min(range(len(trees) - 1), key=lambda k: self.merges.get(trees[k][0] << 32 | trees[k + 1][0], (NEVER,))[0])
            if (found := self.merges.get(trees[best][0] << 32 | trees[best + 1][0])) is None:
                return None
            trees[best : best + 2] = [(found[1], trees[best], trees[best + 1], found[0])]
        return trees[0]

    @staticmethod
    def _edge(tree: tuple, side: int) -> list[tuple[int, int, int]]:
        """The tokens at one edge while the tree grows: (token, rank that made it, rank that ends it)."""
        out, ends = [], NEVER
        while tree is not None:
            out.append((tree[0], tree[3], ends))
            tree, ends = tree[side], tree[3]
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b leaves exactly a and b.

        A merge across the border happens while both of its parts stand at the border; of two equal pairs the
        left one is merged first.
        """
        key = a << 32 | b
        if (known := self.follows.get(key)) is None:
            known = True
            for x, x_from, x_to in self.right[a]:
                for y, y_from, y_to in self.left[b]:
                    found = self.merges.get(x << 32 | y)
                    if found and x_from < found[0] < x_to and y_from < found[0] <= y_to:
                        known = False
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            self.follows[key] = known
        return known

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of distinct words in sorted order; sorted words are the trie's leaves, depth first."""
        inner, final, size, known, may_follow = self.inner, self.final, self.size, self.follows, self.may_follow
        inner_ends, final_ends = self.inner_ends, self.final_ends
        last: list[int] = [0] * (max(map(len, words), default=0) + 1)
        out, before, done = [], "", 0  # last[1] to last[done] hold for the prefixes of `before`
        for w in words:
            n, k = len(w), 0
            most = min(done, n - 1)
            while k < most and w[k] == before[k]:
                k += 1
            for i in range(k + 1, n):  # one trie node each
                for length in inner_ends.get(w[i - 3 : i], _SHORT) if i > 2 else range(i, 0, -1):
                    if length <= i and (t := inner.get(w[i - length : i])) is not None:
                        if length == i:
                            break
                        if (fits := known.get(key := last[i - length] << 32 | t)) is None:
                            fits = may_follow(key >> 32, t)
                        if fits:
                            break
                last[i] = t
            done, before = n - 1, w
            for length in final_ends.get(w[-3:], _SHORT) if n > 2 else range(n, 0, -1):
                if length <= n and (t := final.get(w[n - length :])) is not None and (length == n or may_follow(last[n - length], t)):
                    break
            ids, at = [t], n - length
            while at:
                ids.append(t := last[at])
                at -= size[t]
            ids.reverse()
            out.append(ids)
        return out


class WordCodec:
    """Encodes and decodes texts as the library does, by a trie over each slice's new words.

    Runs between spaces are looked up among those seen before; only new ones are normalised, cut into words
    and walked through the trie. The memories of runs and of words are bounded by `most` entries each, and each slice's new ones.
    """

    def __init__(self, path: str, most: int = 300_000):
        self.library, self.trie, self.most = tokenizer(path), TrieEncoder(path), most
        self.names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.added = added
        self.pattern = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.runs: dict[str, tuple[str, int, str]] = {}
        self.words: dict[str, tuple[str, int, str]] = {}

    def _words(self, runs: list[str]) -> list[list[str]]:
        """The words of each run by the library's own normaliser and pattern, many runs at a time."""
        library, plain = self.library, [library_word(r) for r in runs]
        rest = [i for i, p in enumerate(plain) if p is None]
        shown = [library.normalizer.normalize_str(runs[i]) for i in rest]
        joined, starts, at = [], [], 0
        for s in shown:
            starts.append(at)
            joined.append(s)
            at += len(s) + 1
        out = [p or [] for p in plain]
        if rest:
            found = library.pre_tokenizer.pre_tokenize_str(" ".join(joined))
            owner = np.searchsorted(starts, [a for _, (a, _) in found], side="right") - 1
            for (w, _), k in zip(found, owner.tolist(), strict=True):
                out[rest[k]].append(w)
        return out

    def _learn(self, runs: list[str]) -> None:
        """Codes new runs. One that is a known or new run and a sign behind a letter is put together from the two."""
        known, ended, bare = self.runs, [], {}
        for r in runs:
            if len(r) > 1 and r[-1] in SIGNS and r[-2].isalpha() and r[-2] < "\u0250" and len(r[-2].lower()) == 1:
                ended.append(r)
                for part in (r[:-1], r[-1]):
                    if part not in known:
                        bare[part] = None
            else:
                bare[r] = None
        self._code(list(bare))
        for r in ended:
            x, y = known[r[:-1]], known[r[-1]]
            known[r] = (f"{x[0]} {y[0]}", x[1] + y[1], f"{x[2]} {y[2]}")

    def _code(self, runs: list[str]) -> None:
        by_run = self._words(runs)
        seen, names = self.words, self.names
        if len(seen) > self.most:
            seen.clear()
        words = sorted({w for ws in by_run for w in ws if w not in seen})
        for w, ids in zip(words, self.trie.encode(words), strict=True):
            seen[w] = (" ".join(map(str, ids)), len(ids), " ".join([names[i] for i in ids]))
        for run, ws in zip(runs, by_run, strict=True):
            if len(ws) == 1:
                self.runs[run] = seen[ws[0]]
            else:
                own = [seen[w] for w in ws]
                self.runs[run] = (" ".join([x[0] for x in own]), sum([x[1] for x in own]), " ".join([x[2] for x in own]))

    def _pieces(self, text: str) -> list[str]:
        return [r for r in text.replace("\n", " ").split(" ") if r]

    def coded(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """For each text: its ids as decimals with single spaces, their number, and the decoded text.

        The decoder is none: the decoded text is the tokens' own strings with single spaces.
        """
        if len(self.runs) > self.most:
            self.runs.clear()
        split = []
        for t in texts:
            if self.pattern and self.pattern.search(t):
                parts, at = [], 0
                for m in self.pattern.finditer(t):
                    parts += [*self._pieces(t[at : m.start()]), "\0" + m[0]]
                    at = m.end()
                split.append([*parts, *self._pieces(t[at:])])
            else:
                split.append(self._pieces(t))
        known = self.runs.get
        found = [list(map(known, rs)) for rs in split]
        new: dict[str, None] = {}
        late = [k for k, xs in enumerate(found) if None in xs]
        for k in late:
            new.update(dict.fromkeys([r for r, x in zip(split[k], found[k], strict=True) if x is None]))
        for r in [r for r in new if r[0] == "\0" and r[1:] in self.added]:
            self.runs[r] = (str(self.added[r[1:]]), 1, r[1:])
            del new[r]
        self._learn(list(new))
        for k in late:
            found[k] = list(map(known, split[k]))
        for xs in found:
            ids, counts, names = zip(*xs, strict=True) if xs else ((), (), ())
            if 0 in counts:  # runs without a word
                ids, names = [x for x in ids if x], [x for x in names if x]
            yield " ".join(ids), sum(counts), " ".join(names)


SIGNS = frozenset(",.;:!?")
_APART = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
_SIMPLE = re.compile(r"[!-~]+\Z")


def library_word(run: str) -> list[str] | None:
    """The words of a run of visible ASCII characters without an apostrophe; for any other run, None.

    There the pattern is: letters together, digits one by one, other signs together; the byte-level alphabet
    is these characters themselves.
    """
    if not _SIMPLE.match(run) or "'" in run:
        return None
    return _APART.findall(run.lower())


def codec(path: str) -> WordCodec:
    return held("word_bpe", path, lambda: WordCodec(path))


def word_bpe(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """(key, ids, n_tokens, decoded) of each row: ids as decimals joined by one space, and the decoded text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(_coder(path, key, slice_bytes, None), f"`{key}` {kind}, ids string, n_tokens bigint, decoded string")


def word_bpe_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", slice_bytes: int = 1 << 20) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row, the digests of what word_bpe returns."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(_coder(path, key, slice_bytes, _sha), f"`{key}` {kind}, ids_sha256 string, n_tokens bigint, decoded_sha256 string").select(key, "n_tokens", "ids_sha256", "decoded_sha256")


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _coder(path: str, key: str, slice_bytes: int, digest):
    names = [key, "ids", "n_tokens", "decoded"] if digest is None else [key, "ids_sha256", "n_tokens", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            for i, j in by_bytes(np.array([len(t) for t in texts], np.int64), slice_bytes):
                rows = list(c.coded(texts[i:j]))
                ids, counts, decoded = zip(*rows, strict=True)
                if digest:
                    ids, decoded = [digest(x) for x in ids], [digest(x) for x in decoded]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(ids, pa.string()), pa.array(counts, pa.int64()), pa.array(decoded, pa.string())], names=names)
        trimmed()

    return run
