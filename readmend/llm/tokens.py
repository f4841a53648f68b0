"""Token ids by the tokenizers library, word by word.

Both public vocabularies used here merge only inside what their own splitter calls a
word, so the ids of a text are the ids of its white-space pieces one after the other.
A worker keeps the ids of pieces it has met (at most `CACHE_WORDS`); the library encodes
the others. Texts where that rule may not hold go to the library whole: those that hold
the string of a special token, or separators that Python calls white space and the
library does not.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

END_ID = 2
CACHE_WORDS = 250_000
RARE_WORDS = 60_000
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")

_ENDS = ".,;:!?"
#: What the byte-level splitter takes a piece apart into, where it has no apostrophe and no odd letter.
_RUNS = re.compile(" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@[-`{-~]+)")
# byte-level vocabularies write each byte as a letter: printable ones as themselves,
# the others from code point 256 on
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_BYTE_LETTERS = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(_OTHERS)}
_SPACE = chr(_BYTE_LETTERS[ord(" ")])

_OPEN: dict[str, PieceTokenizer] = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTokenizer:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.rare: dict[str, bytes] = {}
        # words after one space, without it
        self.spaced: dict[str, bytes] = {}
        self.rare_spaced: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.pieces = self._splitter(json.load(f))
        self.lower = self.pieces is str.split
        self.tokenize = self.tokenizer.model.tokenize
        self.ends = {"": []} | {
            e: self.tokenizer.encode(e, add_special_tokens=False).ids for e in _ENDS}

    @staticmethod
    def _splitter(spec: dict):
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") \
                and not pre.get("add_prefix_space") and not norm:
            return _SPACED.findall
        steps = [s.get("type") for s in norm.get("normalizers", ())]
        inner = pre.get("pretokenizers") or [{}]
        if steps == ["NFC", "Replace", "Lowercase"] and inner[0].get("type") == "Split" \
                and inner[0].get("behavior") == "Removed" and inner[0].get("invert"):
            return str.split
        return None

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, without an end id."""
        return self.encode_all([text])[0]

    def encode_all(self, texts) -> list[bytes]:
        return list(self.encoded(texts))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encoded(self, texts) -> Iterator[bytes]:
        known = self.known
        for text in texts:
            if not text:
                yield b""
                continue
            if self.pieces is None or any(odd in text for odd in _ODD):
                yield self._whole(text)
                continue
            if not self.lower and (ids := self._of_words(text)) is not None:
                yield ids
                continue
            pieces = self.pieces(text)
            parts = list(map(known.get, pieces))
            if None in parts:
                if len(self.rare) > RARE_WORDS:
                    self.rare = {}
                rare = self.rare
                for i in [i for i, ids in enumerate(parts) if ids is None]:
                    piece = pieces[i]
                    parts[i] = rare.get(piece) or known.get(piece) or self._learn(piece)
            yield b"".join(parts)

    def _of_words(self, text: str) -> bytes | None:
        """The ids of a text whose words are all parted by one space or one line end; None of others. It is cut
        without a regular expression."""
        known, out = self.spaced, []
        for line in text.split("\n"):
            words = line.split(" ")
            parts = list(map(known.get, words))
            first = words[0]
            if first.split() != [first]:
                return None
            parts[0] = self.known.get(first) or self.rare.get(first) or self._learn(first)
            if None in parts:
                if len(self.rare_spaced) > RARE_WORDS:
                    self.rare_spaced = {}
                rare = self.rare_spaced
                for i in [i for i, ids in enumerate(parts) if ids is None]:
                    word = words[i]
                    ids = rare.get(word) or known.get(word)
                    if ids is None:
                        if word.split() != [word]:
                            return None
                        into = known if len(known) + len(self.known) < CACHE_WORDS else rare
                        into[word] = ids = self._ids(" " + word)
                    parts[i] = ids
            out.append(b"".join(parts))
        if len(self.rare) > RARE_WORDS:
            self.rare = {}
        return out[0] if len(out) == 1 else self._line_end().join(out)

    def _line_end(self) -> bytes:
        return self.known.get("\n") or self.rare.get("\n") or self._learn("\n")

    def _learn(self, piece: str) -> bytes:
        ids = self._ids(piece)
        # frequent pieces turn up early, so the first ones stay for good
        into = self.known if len(self.known) + len(self.spaced) < CACHE_WORDS else self.rare
        into[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        body, end = (piece[:-1], piece[-1]) if piece[-1] in _ENDS else (piece, "")
        spaced = body[:1] == " "
        word = body[1:] if spaced else body
        if word.isalpha() and (word.isascii() or max(word) <= "\xff"):  # one word of the splitter
            body = body.lower() if self.lower else body
            if not word.isascii():
                body = body.encode().decode("latin-1").translate(_BYTE_LETTERS)
            elif spaced:
                body = _SPACE + body[1:]
            return array("I", [t.id for t in self.tokenize(body)] + self.ends[end]).tobytes()
        if not self.lower and len(runs := _RUNS.findall(piece)) > 1 and sum(map(len, runs)) == len(piece):
            return b"".join([self.rare.get(run) or self.known.get(run) or self._learn(run) for run in runs])
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()


def open_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer per worker process."""
    if path not in _OPEN:
        _OPEN[path] = PieceTokenizer(path)
    return _OPEN[path]
