"""Vocabulary and pre-tokenisation of the byte-level BPE files, exactly as the library splits."""

from __future__ import annotations

import importlib
import json
import re
import sys
import unicodedata
from functools import cached_property, lru_cache

#: White space of the Unicode property White_Space (fixed values).
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level split's contractions (fixed values).
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The same split in the compiled encoder's pattern language (fixed values).
COMPILED_SPLIT = CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Without the look-ahead, which only matters where white space runs on; some quarter faster.
SINGLE_SPLIT = COMPILED_SPLIT.replace(r"|\s+(?!\S)", "")


def tokenizer_path(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def _ranges(categories: str) -> str:
    """A character class body of all code points whose category starts so."""
    out, start = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and unicodedata.category(chr(cp)).startswith(categories)
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    def split(letter: str, number: str, other: str, white: str) -> re.Pattern:
        return re.compile(f"(?:{CONTRACTIONS})| ?{letter}+| ?{number}+| ?{other}+|[{white}]+(?![^{white}])|[{white}]+")

    ascii_white = "\\t\\n\\x0b\\x0c\\r "
    narrow = split("[A-Za-z]", "[0-9]", f"[^A-Za-z0-9{ascii_white}]", ascii_white)
    number = _ranges("N")
    wide = split(f"[^\\W_{number}]", f"[{number}]", f"(?:[^\\w{WHITE}]+|_+)", WHITE)
    return narrow, wide


#: The first code point that no character is assigned to; texts below it need no closer look (fixed value).
_late = re.compile("[\u0378-\U0010ffff]")
_assigned: set[str] = set()


def all_assigned(text: str) -> bool:
    """Whether this Python's Unicode tables know every character of the text."""
    if text.isascii() or _late.search(text) is None:
        return True
    new = set(text) - _assigned
    if any(unicodedata.category(c) == "Cn" for c in new):
        return False
    _assigned.update(new)
    return True


#: Before a space that stands between no white space and a letter a pre-token always begins.
_border = re.compile(r"(?<=\S) (?=[A-Za-z])")


def chunks(text: str, size: int = 1 << 20):
    """A text in pieces of about ``size`` characters that split and merge apart just as together.

    A stretch without a safe border stays whole.
    """
    lo = 0
    while len(text) - lo > size:
        m = _border.search(text, lo + size)
        if m is None:
            break
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


#: A superset of runs of white space.
_white_run = re.compile(r"\s\s")


class BytePairVocabulary:
    """A byte-level BPE file: token bytes, merge ranks, special strings, and the pre-token splitter.

    Code points that this Python's Unicode tables do not know yet are rare; a text with one is split by
    the library's own pre-tokeniser, so that newer tables never make a difference.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] is not None:
            raise ValueError("a byte-level BPE file without normaliser or prefix space is asked for")
        self.path = path
        self.byte_of = _byte_alphabet()
        self.bytes_of = {i: bytes(self.byte_of[c] for c in s) for s, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = model["vocab"][left], model["vocab"][right]
            self.merges[a, b] = (rank, model["vocab"][left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._library = None

    def pieces(self, text: str):
        """``(is_special, string)`` runs of a text: special strings are cut out before anything else."""
        if self.special_split is None or not any(s in text for s in self.special):
            return [(False, text)]
        return [(bool(k % 2), s) for k, s in enumerate(self.special_split.split(text)) if s]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings; joined they are the text."""
        narrow, wide = _patterns()
        if text.isascii():
            return narrow.findall(text)
        if all_assigned(text):
            return wide.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [bytes(self.byte_of[c] for c in s).decode() for s, _ in self._library.pre_tokenize_str(text)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by plain pair merging, lowest rank first; for short strings and proofs."""
        ids = [self.id_of[piece[k : k + 1]] for k in range(len(piece))]
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:])))
            if best[0] == 1 << 60:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and self.merges.get((ids[k], ids[k + 1])) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    @cached_property
    def unbroken(self) -> frozenset[int]:
        """Ids of the vocabulary strings that their own merges leave whole: proved once per process by merging each."""
        return frozenset(i for b, i in self.id_of.items() if len(b) == 1 or self.merge(b) == [i])

    def compiled_encoder(self):
        """Text to ids with the splitting and merging compiled, equal to the library's; see :meth:`merger`."""
        import tiktoken

        merge = self.merger()
        with_runs, single = (tiktoken.Encoding("split", pat_str=p, mergeable_ranks=self.id_of, special_tokens={}).encode_ordinary for p in (COMPILED_SPLIT, SINGLE_SPLIT))

        def ordinary(text: str) -> list[int]:
            return (with_runs if _white_run.search(text) else single)(text)

        def encode(text: str) -> list[int]:
            runs = self.pieces(text)
            if len(runs) == 1 and not runs[0][0] and all_assigned(text):
                return ordinary(text)
            ids: list[int] = []
            for special, run in runs:
                if special:
                    ids.append(self.special[run])
                elif all_assigned(run):
                    ids.extend(ordinary(run))
                else:
                    for piece in self.split(run):
                        ids.extend(merge(piece))
            return ids

        return encode

    def merger(self):
        """A compiled merge of one pre-token.

        It merges any two neighbours that join to a vocabulary string, lowest rank first.  That is the
        file's pair list exactly if every string is left whole by its own merges, which is asserted: up to
        a rank, the bytes between two token borders have then gone through the same merges as alone.
        """
        import tiktoken

        if len(self.unbroken) < len(self.id_of):
            return lambda piece: self.merge(piece.encode())
        whole = "(?s).+"
        return tiktoken.Encoding("pairs", pat_str=whole, mergeable_ranks=self.id_of, special_tokens={}).encode_ordinary


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where printable, else 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def vocabulary(path: str) -> BytePairVocabulary:
    return BytePairVocabulary(path)
