"""Token counts under a unigram vocabulary, by forward scores shared in a trie of distinct pre-tokens.

Distinct pre-tokens (white-space separated words, marked at their start) are gathered in buckets and sorted
(``wordtable``).  Walking them in order is a depth-first walk of their trie: the forward scores along the current path
stay on a stack, so the best score of a prefix is computed once for all pre-tokens that share it, and each terminal
stores its token count.  Scores are those of a Zipf law over the vocabulary's ranks, as integers; of equal scores the
fewer tokens win.  Characters that no piece spells cost one token a UTF-8 byte.  Counts come back to the pre-tokens'
places and are summed by text.

Defined cases: null, empty and blank texts count 0; rows that repeat each give a row; null doc_ids are kept; words of
any length count whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palisade.llm.common import table
from palisade.llm.wordtable import BLOCK, bytes_of, with_values

MARK = "▁"
FILE = "piece_bpe_32k.model"


def read_pieces(path: str | None = None) -> list[str]:
    """Pieces in rank order, without control, byte and unknown pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FILE)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def zipf(pieces: list[str]) -> tuple[dict[str, int], int]:
    """Integer scores by rank, and that of a byte: the rank behind all pieces."""
    score = lambda r: -round(1e6 * math.log(r + 2.7))
    out: dict[str, int] = {}
    for r, p in enumerate(pieces):
        out.setdefault(p, score(r))
    return out, score(len(pieces))


class Trie:
    """Forward scores along the path of the last pre-token."""

    def __init__(self, scores: dict[str, int], byte: int):
        self.scores, self.byte, self.longest = scores, byte, max(map(len, scores), default=0)
        self.word, self.best = "", [(0, 0)]  # (score, minus tokens) of each prefix
        self.computed = 0

    def count(self, word: str) -> int:
        shared = 0
        for a, b in zip(self.word, word, strict=False):
            if a != b:
                break
            shared += 1
        best, get = self.best, self.scores.get
        del best[shared + 1 :]
        for j in range(shared + 1, len(word) + 1):
            n = len(word[j - 1].encode("utf-8", "surrogatepass"))
            s, t = best[j - 1]
            top = (s + n * self.byte, t - n)
            for i in range(max(0, j - self.longest), j):
                if (v := get(word[i:j])) is not None and (x := (best[i][0] + v, best[i][1] - 1)) > top:
                    top = x
            best.append(top)
        self.computed += len(word) - shared
        self.word = word
        return -best[-1][1]


def token_counts(docs: DataFrame, pieces: list[str], block: int = BLOCK) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for each row of ``docs``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(zipf(pieces))

    def make_value() -> Callable[[list[str]], list[bytes]]:
        trie = Trie(*vocabulary.value)
        return lambda words: [trie.count(MARK + w).to_bytes(8, "little") for w in words]  # sorted: a walk of their trie

    def finish(ids: pa.Array, ends: np.ndarray, found: pa.BinaryArray) -> pa.Table:
        sums = np.concatenate([[0], np.cumsum(bytes_of(found).view("<i8"))])
        at = np.concatenate([[0], ends])
        return pa.table({"doc_id": ids, "n_pretokens": pa.array(np.diff(at), pa.int64()), "n_tokens": pa.array(np.diff(sums[at]), pa.int64())})

    return with_values(docs, make_value, finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long", separators=True, block=block)


def op9_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), read_pieces(path))
