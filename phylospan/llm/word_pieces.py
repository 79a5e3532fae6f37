"""Texts to ids by a word-end BPE file (lower case, white space dropped), equal to the tokenizers library.

A text is put in lower case, cut into words by array steps over the classes of its characters, and goes
through the file's merges compiled for bytes, in which a line feed stands for the end of a word (words have no white space).
Texts that need more care are cut at spaces and line feeds, where a word always ends, and of these stretches
the library itself encodes those with special strings, with characters that are decomposed, that
this Python's tables do not know or that are put in lower case by their place in a word (capital sigma), and
very long ones.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from phylospan.llm.common import Remembered
from phylospan.llm.pretokens import WHITE, _byte_alphabet, all_assigned

#: The file's contractions (fixed values).
_contraction = re.compile("'(?:s|t|re|ve|m|ll|d)")
SPACE, LETTER, NUMBER, OTHER = range(4)
_white = re.compile(f"[{WHITE}]")


def _kind(c: str) -> int:
    return SPACE if _white.match(c) else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The class of every character of the basic plane."""
    return np.array([_kind(chr(c)) for c in range(1 << 16)], np.uint8)


def words_of(low: str) -> list[str] | None:
    """The words of a lower-case text; None where one is very long.

    Words are runs of letters, single numbers, runs of other characters, and contractions, which go first
    wherever a word begins with an apostrophe.
    """
    ascii_only = low.isascii()
    chars = np.frombuffer(low.encode("ascii" if ascii_only else "utf-32-le"), np.uint8 if ascii_only else "<u4")
    if not len(chars):
        return []
    if ascii_only:
        kind = _kinds()[:128][chars]
    else:
        kind = _kinds()[np.minimum(chars, 0xFFFF)]
        for k in np.flatnonzero(chars > 0xFFFF):
            kind[k] = _kind(chr(chars[k]))
    ends = np.empty(len(chars), bool)
    np.not_equal(kind[1:], kind[:-1], out=ends[:-1])
    ends[-1] = True
    ends |= kind == NUMBER
    at = low.find("'")
    while at >= 0:
        if at == 0 or kind[at - 1] != OTHER:
            m = _contraction.match(low, at)
            if m:
                ends[at : m.end() - 1] = False
                ends[m.end() - 1] = True
        at = low.find("'", at + 1)
    inside = kind != SPACE
    ends &= inside
    last = np.flatnonzero(ends) + 1
    starts = inside.copy()
    starts[1:] &= ends[:-1] | ~inside[:-1]
    first = np.flatnonzero(starts)
    if len(last) and (last - first).max() > LONG:
        return None
    return [low[a:b] for a, b in zip(first.tolist(), last.tolist())]


#: Characters of a word at most; longer ones are left to the library.
LONG = 2000
#: Stretches of texts that need care remembered in each of two generations.
REMEMBERED = 1 << 14
#: Words remembered, the first ones seen: common words come early.
WORDS = 1 << 19
WORD_END = "</w>"
#: Characters of a text that are split at a time.
SLICE = 1 << 20


class WordPieces:
    """``encode_bytes(text)``: ids of a text as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a BPE file with word ends, in lower case, is asked for")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        top = max(max(model["vocab"].values()), *(t["id"] for t in spec["added_tokens"]))
        self.width = 2 if top < 1 << 16 else 4
        self.compiled = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=self._ranks(model["vocab"]), special_tokens={}).encode_to_numpy
        self.ends = np.zeros(top + 1, bool)
        self.ends[[i for s, i in model["vocab"].items() if s.endswith(WORD_END)]] = True
        self.words: dict[str, bytes] = {}
        self.memo = Remembered(self._stretch, REMEMBERED)

    def _ranks(self, vocab: dict[str, int]) -> dict[bytes, int]:
        """Byte strings by id, a word's end as a line feed: ids stand in the order of the merges."""
        byte_of = _byte_alphabet()
        ranks: dict[bytes, int] = {}
        for s, i in vocab.items():
            if s in self.special:
                continue
            word, end = (s[: -len(WORD_END)], True) if s.endswith(WORD_END) and s != WORD_END else (s, False)
            b = bytes(byte_of[c] for c in word)
            if b"\n" in b and (end or len(b) > 1):
                continue  # no word has a line feed
            ranks[b + b"\n" if end else b] = i
        return ranks

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def _plain(self, text: str) -> bool:
        """Whether lower case and splitting need no more than single characters, all of them known here."""
        if "<|" in text and any(x in text for x in self.special):
            return False
        return text.isascii() or ("\u03a3" not in text and unicodedata.is_normalized("NFC", text) and all_assigned(text))

    def _merged(self, text: str) -> bytes | None:
        """Ids by remembered words; the others go through the merges together, and their last tokens tell them apart."""
        words = words_of(text.lower()) if self._plain(text) else None
        if words is None:
            return None
        known = list(map(self.words.get, words))
        if None in known:
            new = list({w: None for w, ids in zip(words, known) if ids is None})
            ids = self.compiled("\n".join(new) + "\n")
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()]
            data = ids.astype(f"<u{self.width}").tobytes()
            got = {w: data[lo:hi] for w, lo, hi in zip(new, cuts, cuts[1:])}
            known = [got[w] if ids is None else ids for w, ids in zip(words, known)]
            if len(self.words) < WORDS:
                self.words.update(got)
        return b"".join(known)

    def _stretch(self, s: str) -> bytes:
        got = self._merged(s)
        return self._by_library(s) if got is None else got

    def encode_bytes(self, text: str) -> bytes:
        out, lo = [], 0
        while lo < len(text):
            hi = len(text) if len(text) - lo <= SLICE else text.find(" ", lo + SLICE)
            part = text[lo : hi if hi >= 0 else len(text)]
            lo = hi if hi >= 0 else len(text)
            got = self._merged(part)
            if got is None:
                got = b"".join(map(self.memo.__getitem__, part.replace("\n", " ").split(" ")))
            out.append(got)
        return b"".join(out)


@lru_cache(2)
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)
