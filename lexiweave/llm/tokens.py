"""Token ids and prefix token counts over public tokenizer files.

Both tokenizers here split a text into pieces that never span what their cache keys hold, and encode
each piece by itself, so pieces are encoded once and kept in a bounded cache. Texts with characters
beyond the ranges for which the split is known to agree go to the library as whole texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from sys import getsizeof

import numpy as np

#: Entries of a cache, and the bytes of its keys and values; whichever comes first empties it.
CACHE = 800_000
CACHE_BYTES = 150 << 20

_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: Anything else sends the text to the library: other scripts, controls, special tokens.
_UNUSUAL = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]|<\|")


@functools.cache
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The visible stand-in for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Cache(dict):
    """Values of `make` by key; emptied when full in entries or bytes, so its memory is bounded."""

    def __init__(self, make: Callable, most: int = CACHE, most_bytes: int = CACHE_BYTES):
        super().__init__()
        self.make, self.most, self.most_bytes, self.held = make, most, most_bytes, 0

    def __missing__(self, key):
        value = self.make(key)
        size = getsizeof(key) + getsizeof(value)
        if len(self) >= self.most or self.held + size > self.most_bytes:
            self.clear()
            self.held = 0
        if size <= self.most_bytes // 1024:  # one long piece does not push the others out
            self[key] = value
            self.held += size
        return value


class WordTokens:
    """Ids of the lower-casing word BPE: white space is dropped, so white-space separated words are encoded alone."""

    _PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.visible = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces = _Cache(self._piece, CACHE // 8)
        self.words = _Cache(self._word)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.visible)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # of the usual characters: one piece
            return self._piece(word)
        return b"".join(map(self.pieces.__getitem__, self._PIECES.findall(word)))

    def ids(self, text: str) -> np.ndarray:
        """The library's ids of the text, without special tokens added."""
        if not text.isascii() and _UNUSUAL.search(text) or text.isascii() and _ODD_ASCII.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.lower().split())), dtype="<u4")


_ODD_ASCII = re.compile(r"[^\t\n\r -~]|<\|")
_BEYOND = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
#: White space as the tokenizers see it; Python's \s has some controls besides.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class PrefixCounts:
    """Exact token counts of every prefix of a text under the byte-level BPE.

    Within a piece, the last token of each byte prefix is found by dynamic programming: a token t that
    ends at i may follow the last token s of the prefix before it exactly if the pair (s, t) encodes to
    itself, and then count[i] = count[i - len(t)] + 1. Each prefix of a piece has one such t. The store
    holds the change of the count at each code point, so any prefix count is a running sum.
    """

    _PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
    _MORE = re.compile(r"\s\s|'(?:re|ve|ll)")

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        shown = _byte_letters()
        back = {c: b for b, c in shown.items()}
        self.visible = str.maketrans({chr(b): c for b, c in shown.items()})
        added = self.tokenizer.get_added_tokens_decoder()
        special = set(added)
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()) or "(?!)")
        vocabulary = {bytes(back[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if i not in special}
        # A token that does not encode to itself stands in no encoding.
        self.token = {t: i for t, i in vocabulary.items() if self._encode(t) == [i]}
        self.spelled = {i: t for t, i in self.token.items()}
        lengths: dict[bytes, set[int]] = {}
        for t in self.token:
            lengths.setdefault(t[-2:], {1}).add(len(t))
        self.by_last = {x: sorted(ns, reverse=True) for x, ns in lengths.items()}
        self.pair_ok = _Cache(self._pair_ok, CACHE // 2)
        self.changes = _Cache(self._changes)

    def _encode(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.visible))]

    def _pair_ok(self, pair: int) -> bool:
        a, b = pair >> 20, pair & 0xFFFFF
        return self._encode(self.spelled[a] + self.spelled[b]) == [a, b]

    def piece_counts(self, raw: bytes) -> list[int]:
        """Token count of each byte prefix of one piece, the empty prefix first."""
        last, count = [0], [0]
        token, ok, lengths, one = self.token.get, self.pair_ok, self.by_last.get, (1,)
        for i in range(1, len(raw) + 1):
            for n in lengths(raw[i - 2 : i] if i > 1 else raw[:1], one):
                if n <= i and (t := token(raw[i - n : i])) is not None and (n == i or ok[last[i - n] << 20 | t]):
                    last.append(t)
                    count.append(count[i - n] + 1)
                    break
            else:
                raise AssertionError("every byte is a token")
        return count

    def _changes(self, piece: str) -> bytes:
        """For each code point of the piece, the change of the count, as int8."""
        raw = piece.encode()
        counts = self.piece_counts(raw)
        if piece in ("'re", "'ve", "'ll"):  # a shorter prefix splits after the apostrophe
            counts[2] = counts[1] + self.piece_counts(raw[1:2])[1]
        if len(raw) != len(piece):
            counts = [c for i, c in enumerate(counts) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])

    def store(self, text: str) -> np.ndarray:
        """int8 change of the token count at each code point; its running sum is the count of each prefix."""
        if not self.added.search(text):
            return self._store_plain(text)
        parts, at = [], 0
        for m in self.added.finditer(text):
            # A prefix that ends inside the added token's string has that start of it as ordinary text.
            part = self._store_plain(text[at : m.end() - 1])
            inside = int(part[m.start() - at :].sum(dtype=np.int64))
            parts += [part, np.array([1 - inside], dtype=part.dtype)]
            at = m.end()
        return np.concatenate([*parts, self._store_plain(text[at:])])

    def _store_plain(self, text: str) -> np.ndarray:
        """store() of a text without added tokens."""
        if _BEYOND.search(text):
            return self._store_whole(text)
        if len(text) > 100_000:  # long runs without a break would make one very long piece
            pieces = [m.group() for m in self._PIECES.finditer(text)]
        else:
            pieces = self._PIECES.findall(text)
        out = b"".join(map(self.changes.__getitem__, pieces))
        if not self._MORE.search(text):
            return np.frombuffer(out, dtype=np.int8)
        return self._mend_spaces(text, np.frombuffer(out, dtype=np.int8).copy())

    def _mend_spaces(self, text: str, change: np.ndarray) -> np.ndarray:
        """A prefix that ends with a whole run of white space has the run as one piece."""
        for m in re.finditer(rf"{_SPACE}{{2,}}(?!{_SPACE}|\Z)", text):
            i = m.end() - 1  # the run's last code point, which the text splits off
            run = self.piece_counts(m.group().encode())[-1]
            short = self.piece_counts(m.group()[:-1].encode())[-1]
            now, after = int(change[i]), run - short
            change[i] = after
            change[i + 1] += now - after
        return change

    def _store_whole(self, text: str) -> np.ndarray:
        """The library's own counts, for texts outside the known ranges: pieces by its own pre-tokenizer.

        Counts of prefixes are those of the pieces' prefixes; a text where pieces cannot be aligned holds the
        library's whole count at its end.
        """
        total = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        out = np.zeros(len(text), dtype=np.int8)
        at = 0
        for shown, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            if a != at:
                break
            out[a:b] = np.frombuffer(self._changes(text[a:b]), dtype=np.int8)
            at = b
            del shown
        if at == len(text) and int(out.sum(dtype=np.int64)) == total:
            return self._mend_spaces(text, out)
        wide = np.zeros(len(text), dtype=np.int64)
        if len(text):
            wide[-1] = total
        return wide


def prefix_counts(store: np.ndarray) -> np.ndarray:
    """Token count of each prefix, from the empty one on."""
    return np.concatenate([[0], np.cumsum(store, dtype=np.int64)])


def truncation_point(store: np.ndarray, budget: int) -> int:
    """The most code points from the start whose text has at most `budget` tokens."""
    return int(np.flatnonzero(prefix_counts(store) <= budget)[-1])
