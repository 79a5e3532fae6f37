"""Token counts by the whole-token shortcut.

A pre-token that is itself a vocabulary string encodes as that one token whenever merging its bytes alone
ends in it.  This is proved offline, before the table is read, for every vocabulary string by merging it; the
proved ids go to the tasks, whose count of a text is then one dictionary look-up per pre-token, and only
pre-tokens that are no proved string are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.llm.common import Remembered, each_row
from phylospan.llm.pretokens import BytePairVocabulary, chunks, tokenizer_path, vocabulary

#: Merged pre-tokens remembered per generation in a task (two generations, some 150 MB together).
REMEMBERED = 450_000


def whole_tokens(vocab: BytePairVocabulary) -> set[str]:
    """The vocabulary strings that are one pre-token and are proved to encode alone as one token."""
    proved = set()
    for token, i in vocab.id_of.items():
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if i in vocab.unbroken and vocab.split(text) == [text]:
            proved.add(text)
    return proved


def token_counter(path: str, whole: set[str] | None = None):
    """A function from text to its number of tokens under the file at ``path``; ``whole`` are proved strings."""
    vocab = vocabulary(path)
    merge = vocab.merger()
    proved = whole_tokens(vocab) if whole is None else whole

    def merged(piece: str) -> int:
        return 1 if piece in proved else len(merge(piece))

    look_up = Remembered(merged, REMEMBERED).__getitem__

    def count(text: str) -> int:
        return sum(1 if special else sum(map(look_up, vocab.split(run))) for chunk in chunks(text) for special, run in vocab.pieces(chunk))

    return count


def _setup(path: str, limit: int, proof):
    def setup():
        whole, unbroken = proof.value
        vocab = vocabulary(path)
        vocab.unbroken = unbroken
        count = token_counter(path, {vocab.bytes_of[i].decode() for i in whole})

        def row(doc_id, text):
            text = text or ""
            n = count(text)
            return doc_id, len(text.encode()), n, n > limit

        return row

    return setup


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs``.

    Null text counts as empty (0 tokens), a null id stays null, repeated rows give repeated results, and
    columns besides the two named are ignored; an empty table gives an empty one.  No shuffle; memory is bounded by the vocabulary, the
    remembered pre-tokens and one text, which is split a million characters at a time.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    vocab = vocabulary(path)
    proof = docs.sparkSession.sparkContext.broadcast(([vocab.id_of[t.encode()] for t in whole_tokens(vocab)], vocab.unbroken))  # two ids a vocabulary string at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return each_row(rows, _setup(path, limit, proof), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
