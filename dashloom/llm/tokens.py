"""Encoding of whole texts with a file of the tokenizers library, word by word where that is exact."""

from __future__ import annotations

import array
import os
import re
from functools import cache

#: Texts of these characters only are cut at white space here; others go to the library whole.
_PLAIN = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-\xff]")
_ODD_SPACE = re.compile(r"[\t\x0b\x0c\r]|  | \n|\n |^ | $")
_LETTER, _DIGIT = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")
_WORDS = 1 << 19  # words remembered in one Python worker; then it starts afresh


def _byte_marks() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids and counts of texts as the library gives them, without special tokens added.

    In a text of Latin characters the tokens of a word do not depend on its neighbours, so
    each distinct word is encoded once and remembered (a bounded number of them). Texts with
    other characters or with the strings of special tokens are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = _byte_marks()
        self.ids_of: dict[str, bytes] = {}
        self.count_of: dict[str, int] = {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, text: str) -> bool:
        return not _PLAIN.search(text) and not any(s in text for s in self.special)

    def _word_ids(self, word: str) -> bytes:
        ids = array.array("I")
        for piece in _PIECE.findall(word):
            ids.extend(t.id for t in self.tokenizer.model.tokenize("".join([self.marks[b] for b in piece.encode()])))
        return ids.tobytes()

    def ids(self, text: str | None) -> bytes:
        """Ids as unsigned 32-bit numbers, for files that lower-case and drop white space."""
        if not text:
            return b""
        if not self._plain(text):
            return array.array("I", self._whole(text)).tobytes()
        known = self.ids_of
        words = text.lower().split()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > _WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._word_ids(w)
            return b"".join([known[w] for w in words])

    def _count(self, part: str) -> int:
        n = self.count_of.get(part)
        if n is None:
            if len(self.count_of) > _WORDS:
                self.count_of.clear()
            n = self.count_of[part] = len(self._whole(part))
        return n

    def count(self, text: str | None) -> int:
        """Number of ids, for byte-level files that keep a word's space with the word."""
        if not text:
            return 0
        if not self._plain(text) or _ODD_SPACE.search(text):
            return len(self._whole(text))
        known, total = self.count_of, 0
        for line in text.split("\n"):
            if line:
                first, *rest = line.split(" ")
                total += self._count(first)
                try:
                    total += sum([known[w] for w in map(" ".__add__, rest)])
                except KeyError:
                    total += sum([self._count(" " + w) for w in rest])
        for run in re.findall("\n+", text) if "\n" in text else ():
            # Before a word, the last newline of a run is a token of its own.
            total += self._count("\n") + (self._count(run[1:]) if len(run) > 1 else 0)
        if text[-1] == "\n":
            run = text[len(text.rstrip("\n")):]
            total += self._count(run) - self._count("\n") - (self._count(run[1:]) if len(run) > 1 else 0)
        return total


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, made once."""
    return Encoder(path)
