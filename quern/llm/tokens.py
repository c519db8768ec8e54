"""Tokenizers of the installed libraries, loaded once in each Python worker, and exact cuts of texts."""

from __future__ import annotations

import os
import re

import numpy as np

from quern.llm.common import span_hashes, spans_equal

_loaded: dict[str, object] = {}


def default_path(name: str) -> str:
    """Where the machine keeps a public tokenizer's file; callers may give another path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The `tokenizers` library's object for a .json file, without threads of its own, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def special_strings(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def id_width(path: str) -> int:
    """Bytes that each of a tokenizer's ids needs in a file: 2 or 4."""
    return 2 if max(tokenizer(path).get_vocab().values(), default=0) < 1 << 16 else 4


#: A space before a character that is no white space: there the byte-level pattern always begins a new word,
#: as only a word's own leading space can stand before its letters, digits or signs.
CUT = re.compile(r" (?=[^\s\x1c-\x1f\x85])")
#: Bytes that no white space begins with: visible ASCII, and lead bytes of characters other than U+0080 to U+00BF,
#: U+1000 to U+3FFF. And bytes that can end a segment which others follow: letters, digits and signs of ASCII.
AFTER = np.zeros(256, bool)
AFTER[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
PLAIN_END = np.zeros(256, bool)
PLAIN_END[0x21:0x7F] = True
#: ASCII letters, and ASCII signs: behind a letter the pattern always begins a new word at a sign.
LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def safe_parts(text: str, most: int, special: list[str]) -> list[str]:
    """A text in parts of about `most` characters, whose encodings follow each other as the whole text's.

    A cut stands before a single space between two characters that are no white space. A text that holds a special
    token's string, or has no such place, stays whole there.
    """
    if len(text) <= most or any(s in text for s in special):
        return [text]
    parts, at = [], 0
    while len(text) - at > most:
        found = CUT.search(text, at + most)
        while found and text[found.start() - 1].isspace():
            found = CUT.search(text, found.end())
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


class SegmentMemo:
    """Ids of byte-level texts by the library, where each distinct segment of a slice is encoded once.

    A segment begins at a space before a byte that cannot begin white space, at a sign behind a letter, and on both
    sides of a single line feed. The byte-level pattern always begins a new word at these places, so segments
    encode one by one to the same ids as the text. Segments of a slice are found and told apart in numpy: by 64-bit hashes, then
    by all their bytes. Those not seen in earlier slices are joined and encoded together; the bytes
    that each id stands for tell where a segment's ids end. At most `most` earlier segments are remembered.
    """

    def __init__(self, path: str, most: int = 600_000):
        self.library, self.most = tokenizer(path), most
        vocab = self.library.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)  # one character of the byte-level alphabet stands for one byte
        self.special = special_strings(path)
        self.kind = np.dtype(f"<u{id_width(path)}")
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Encodes segments that may follow each other, many at a time; one that begins with no space stands behind a
        line feed, which is an id of its own."""
        at, width = 0, self.kind.itemsize
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size < 1 << 17):
                size += len(new[end])
                end += 1
            group = new[at:end]
            apart = [s[0] != 32 for s in group]
            shown = b"".join([b"\n" + s if x else s for s, x in zip(group, apart, strict=True)])
            ids = np.array(self.library.encode_batch_fast([shown.decode()], add_special_tokens=False)[0].ids, self.kind)
            sizes = np.array([len(s) + x for s, x in zip(group, apart, strict=True)])
            ends = (np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1) * width
            starts = np.concatenate([[0], ends[:-1]]) + np.array(apart) * width
            raw = ids.tobytes()
            for s, i, j in zip(group, starts.tolist(), ends.tolist(), strict=True):
                self.memo[s] = raw[i:j]
            at = end

    @staticmethod
    def _joins(s: bytes) -> bool:
        """Whether a segment's words are the same between others: it begins with a space, or with a letter or sign, and
        ends in a visible ASCII character or a letter of Latin-1."""
        return (s[0] == 32 or LETTER[s[0]]) and (PLAIN_END[s[-1]] or len(s) > 1 and s[-2] == 0xC3)

    def _known(self, segments: list[bytes]) -> list[bytes]:
        if len(self.memo) > self.most // 2:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        found = list(map(memo.get, segments))
        late = [i for i, x in enumerate(found) if x is None]
        joined, apart, joins = [], [], self._joins
        for i in late:
            s = segments[i]
            if (old := older.get(s)) is not None:
                memo[s] = old
            elif joins(s):
                joined.append(s)
            else:
                apart.append(s)
        self._learn(joined)
        if apart:
            for s, e in zip(apart, self.library.encode_batch_fast([s.decode() for s in apart], add_special_tokens=False), strict=True):
                memo[s] = np.array(e.ids, self.kind).tobytes()
        for i in late:
            found[i] = memo[segments[i]]
        return found

    def encode_slice(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of neighbouring texts, and where each text's begin; `edges` are the texts' offsets in the bytes."""
        n = len(data)
        if not n:
            return np.zeros(0, self.kind), np.zeros(len(edges), np.int64)
        begins = np.zeros(n + 1, bool)
        letter = LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begins[: n - 1] = (data[:-1] == 0x20) & AFTER[data[1:]]
        begins[1:n] |= letter[:-1] & SIGN[data[1:]]
        feed = np.flatnonzero((data[1:-1] == 0x0A) & (letter[:-2] | SIGN[data[:-2]]) & AFTER[data[2:]]) + 1
        begins[feed] = begins[feed + 1] = True
        begins[edges] = True
        starts = np.flatnonzero(begins[:n])
        ends = np.append(starts[1:], n)
        raw = data.tobytes()
        _, at, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if not spans_equal(data, starts, ends, at[inverse]):  # one hash for different segments: told apart by their bytes
            first: dict[bytes, int] = {}
            like = np.array([first.setdefault(raw[i:j], k) for k, (i, j) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))])
            at, inverse = np.unique(like, return_inverse=True)
        s, e = starts[at].tolist(), ends[at].tolist()
        found = self._known([raw[i:j] for i, j in zip(s, e, strict=True)])
        sizes = np.array([len(f) for f in found]) // self.kind.itemsize
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ids = np.frombuffer(b"".join(found), self.kind)
        own = sizes[inverse]
        ahead = np.concatenate([[0], np.cumsum(own)])
        out = ids[np.repeat(offsets[inverse] - ahead[:-1], own) + np.arange(ahead[-1])]
        return out, ahead[np.searchsorted(starts, edges)]

    def encode_texts(self, data: np.ndarray, edges: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Like encode_slice; texts that hold a special token's string are encoded as a whole, and an end id may follow each text."""
        raw = data.tobytes()
        if any(t.encode() in raw for t in self.special):
            parts = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = raw[a:b]
                if any(t.encode() in own for t in self.special):
                    parts.append(np.frombuffer(self.whole(own.decode()), self.kind))
                else:
                    parts.append(self.encode_slice(data[a:b], np.array([0, b - a]))[0])
            ids, ahead = np.concatenate(parts or [np.zeros(0, self.kind)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        else:
            ids, ahead = self.encode_slice(data, edges)
        if end_id is not None:
            ids = np.insert(ids, ahead[1:], end_id)
            ahead = ahead + np.arange(len(ahead))
        return ids, ahead

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of `kind`."""
        packed = [t.encode() for t in texts]
        ids, ahead = self.encode_texts(np.frombuffer(b"".join(packed), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype(np.int64))
        return [ids[a:b].tobytes() for a, b in zip(ahead[:-1].tolist(), ahead[1:].tolist(), strict=True)]
