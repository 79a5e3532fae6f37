"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a pre-token has exactly one BPE encoding, and all but its last token is the encoding of
a shorter prefix.  So one stored number per prefix is enough: its last token.  For each end position an
automaton over the vocabulary with suffix links lists the tokens that end there, longest first; the one
whose predecessor (the last token stored for the prefix before it) is pair-compatible is the last token.
Two tokens are compatible when merging their joined bytes gives back just these two.  Following the
stored tokens backwards from the end emits the ids.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm.common import Remembered, each_row
from phylospan.llm.pretokens import BytePairVocabulary, chunks, tokenizer_path, vocabulary

#: Encoded pre-tokens remembered per generation in a task (two generations, some 170 MB together).
REMEMBERED = 350_000
#: Tested pairs remembered; the memory starts anew beyond it.
PAIRS = 500_000


class PrefixEncoder:
    def __init__(self, vocab: BytePairVocabulary):
        self.vocab = vocab
        self.automaton = ahocorasick.Automaton()
        self.length = {}
        for token, i in vocab.id_of.items():
            if i in vocab.unbroken:  # a token that merging never leaves whole ends no prefix
                self.automaton.add_word(token.decode("latin-1"), i)
                self.length[i] = len(token)
        self.automaton.make_automaton()
        self.parts = {made: pair for pair, (_, made) in vocab.merges.items()}
        self.rank = {made: rank for rank, made in vocab.merges.values()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joined bytes gives back just them."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._never_merged(left, right)
        return known

    def _never_merged(self, left: int, right: int) -> bool:
        """Undo both tokens' merges, latest first: at no moment may the two that touch have had an earlier merge.

        The seam's neighbours at any time are a suffix part of ``left`` and a prefix part of ``right``.
        A merge across the seam happens if its rank comes before the next merge that either side does
        on its own (on equal rank the left one is done first).
        """
        merges, parts, rank = self.vocab.merges, self.parts, self.rank
        until_left = until_right = 1 << 60  # ranks of the merges that end the neighbours' present forms
        while True:
            across = merges.get((left, right))
            # the left neighbour is replaced by a merge of rank until_left that ends at the seam, the
            # right one by one of until_right that starts there: the left merge takes precedence at a tie
            if across is not None and across[0] < until_left and across[0] <= until_right:
                return False
            r_left, r_right = rank.get(left, -1), rank.get(right, -1)
            if r_left < 0 and r_right < 0:
                return True
            if r_left >= r_right:
                until_left = r_left
                left = parts[left][1]
            else:
                until_right = r_right
                right = parts[right][0]

    def last_tokens(self, piece: bytes) -> list[int]:
        """The unique last token of every non-empty prefix."""
        last: list[int] = []
        length, pairs = self.length, self.pairs
        done = 0
        for end, token in self.automaton.iter(piece.decode("latin-1")):  # longest first at each end
            if end < done:
                continue
            start = end + 1 - length[token]
            if start:
                before = last[start - 1]
                fits = pairs.get((before, token))
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last.append(token)
            done = end + 1
            if len(last) != done:
                break
        if len(last) != len(piece):
            raise ValueError("a byte of the text is no token, or a prefix has no encoding")
        return last

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.vocab.id_of.get(piece)
        if whole in self.length:
            return [whole]
        last = self.last_tokens(piece)
        ids, end = [], len(piece)
        while end:
            ids.append(last[end - 1])
            end -= self.length[ids[-1]]
        return ids[::-1]


@lru_cache(2)
def prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(vocabulary(path))


class TextCodec:
    """Encodes and decodes whole texts; remembers encoded pre-tokens up to a bound."""

    def __init__(self, path: str):
        self.encoder = prefix_encoder(path)
        self.vocab = self.encoder.vocab
        self.known = Remembered(lambda piece: tuple(self.encoder.encode(piece.encode())), REMEMBERED)

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them without added special tokens; special strings in the text are their ids."""
        vocab, known = self.vocab, self.known
        ids: list[int] = []
        for special, run in vocab.pieces(text):
            if special:
                ids.append(vocab.special[run])
                continue
            ids.extend(chain.from_iterable(map(known.__getitem__, vocab.split(run))))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _codec(path: str | None) -> TextCodec:
    return TextCodec(path or tokenizer_path("byte_bpe_50k.json"))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` per row.  Null text is empty: no ids.  Other columns are ignored; no shuffle."""

    def setup():
        codec = _codec(tokenizer)
        return lambda doc_id, text: (doc_id, codec.encode(text or ""))

    return each_row(_plain(docs, id_col, text_col), setup, "doc_id long, ids array<int>", rows=64)


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``.  Null ids are an empty text."""

    def setup():
        codec = _codec(tokenizer)
        return lambda doc_id, ids: (doc_id, codec.decode(ids or []))

    return each_row(encoded.select("doc_id", "ids"), setup, "doc_id long, text string", rows=64)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded, and decoded from its ids.

    Null text is empty (no ids, the digest of nothing), null ids stay null, repeated rows repeat, other
    columns are ignored, and an empty table gives an empty one.  Ids stay in the task, those of a million characters at a time: nothing is shuffled.
    """

    def setup():
        codec = _codec(tokenizer)
        decimal = {i: str(i) for i in codec.vocab.bytes_of}.__getitem__

        def row(doc_id, text):
            n, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for chunk in chunks(text or ""):
                ids = codec.encode(chunk)
                if ids:
                    listed.update((("," if n else "") + ",".join(map(decimal, ids))).encode())
                    decoded.update(codec.decode(ids).encode())
                    n += len(ids)
            return doc_id, n, listed.hexdigest(), decoded.hexdigest()

        return row

    return each_row(_plain(docs, id_col, text_col), setup, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=64)
