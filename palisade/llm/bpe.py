"""BPE encoding and decoding by a table of distinct words.

Spark ranks the words of all texts, encodes each distinct word once with the tokenizer's own model, and joins the ids
back by position: frequent words (a fixed number) come from a broadcast table; the occurrences of any other word are
shuffled together, get their ids there, and are gathered by document and put in their places.  Decoding joins ids with pieces, a table as large as the
vocabulary.

Splitting equals the tokenizer's normalizer and pre-tokenizer: its own code runs for unusual characters, a plain
regular expression for texts of ASCII and Latin letters, where both agree.

Defined cases: null and empty texts have no ids and decode to an empty text; special tokens written out in a text
are single ids, as the library takes them; rows that repeat a doc_id or a whole row each give a row; null doc_ids are
kept; extra columns are ignored; very long words and texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import lean, table
from palisade.llm.wordtable import BLOCK, binary_of, bytes_of, ends_of, with_values

#: Characters for which str.lower(), NFC and the classes below equal the library's.
PLAIN = re.compile("[\x00-įı-ɏ]*")
FILE = "word_bpe_49k.json"
#: Parts of words whose ids a worker remembers.
PARTS = 100_000
#: Texts decoded at once.
ROWS = 1_000


class Words:
    """Splits texts as a tokenizer file says, and encodes single words."""

    def __init__(self, content: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        spec = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain = regex.compile(pattern.replace(r"[^\s", r"[^\t-\r \x85\xa0"))
        self.slow = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """Words in order; a special token has a space before it, which no word has."""
        if self.cut is None or not self.cut.search(text):
            return self._split(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [" " + part] if part in self.special else self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.plain.findall(text.lower())
        return [w for w, _ in self.slow.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))] if text else []

    def encode(self, word: str) -> list[int]:
        if word[0] == " ":
            return [self.special[word[1:]]]
        parts = [word] if word.isascii() and word.isprintable() else [w for w, _ in self.bytes.pre_tokenize_str(word)]
        return [t.id for w in parts for t in self.tokenizer.model.tokenize(w)]


def read_tokenizer(path: str | None = None) -> str:
    """The tokenizer file's content; read by the driver, since executors may not have the file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FILE)
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces_of(content: str) -> list[str | None]:
    spec = json.loads(content)
    by_id = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [by_id.get(i) for i in range(max(by_id) + 1)]


def _unit(content: str) -> str:
    """Two bytes an id where they are enough, else four."""
    return "<u2" if len(pieces_of(content)) <= 1 << 16 else "<u4"


def encode(docs: DataFrame, content: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of ``docs``; ids: binary, little-endian unsigned 32-bit."""
    return _encoded(docs, content, block, lambda: lambda t: t, "n_tokens long, ids binary")


def _encoded(docs: DataFrame, content: str, block: int, make_last: Callable[[], Callable[[pa.Table], pa.Table]], schema: str) -> DataFrame:
    """What the function that ``make_last`` gives makes of (doc_id, n_tokens, ids), in the worker that has them."""
    unit, tokenizer = _unit(content), docs.sparkSession.sparkContext.broadcast(content)

    def make_value() -> Callable[[list[str]], list[bytes]]:
        words, known = Words(tokenizer.value), {}

        def ids(word: str) -> bytes:
            out = []
            for part in words.split(word):
                if (found := known.get(part)) is None:
                    if len(known) >= PARTS:
                        known.clear()
                    found = known[part] = words.encode(part)
                out += found
            return np.array(out, unit).tobytes()

        return lambda kinds: list(map(ids, kinds))

    def finish(ids: pa.Array, ends: np.ndarray, found: pa.BinaryArray) -> pa.Table:
        at, width = ends_of(found), np.dtype(unit).itemsize
        raw = bytes_of(found).view(unit).astype("<u4")
        at = np.concatenate([[0], (at - at[0])[ends] // width])
        if 4 * len(raw) < 1 << 31:
            texts = binary_of(4 * np.diff(at), raw.tobytes(), pa.binary())
        else:
            texts = pa.array([raw[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())
        return make_last()(pa.table({"doc_id": ids, "n_tokens": pa.array(np.diff(at), pa.int64()), "ids": texts}))

    return with_values(docs, make_value, finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}", separators=False, block=block)


def texts_of(ids: pa.BinaryArray, pieces: pa.StringArray) -> pa.StringArray:
    """The decoded text of each row of ids."""
    at = ends_of(ids)
    flat = bytes_of(ids).view("<u4").astype(np.int64)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array((at - at[0]) // 4, pa.int32()), pieces.take(pa.array(flat))), " ")


def decode(encoded: DataFrame, content: str) -> DataFrame:
    """``encoded`` with ``decoded``: its ids joined with their pieces, as the library's decode gives them."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces_of(content))
    names = encoded.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value, pa.string())
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, texts_of(b["ids"], pieces)], [*names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded string"]))


def digests(docs: DataFrame, content: str, keep_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if wanted, for each row of ``docs``; decoded texts stay in the worker."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces_of(content))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids]

    def make_last() -> Callable[[pa.Table], pa.Table]:
        pieces, sha = pa.array(shared.value, pa.string()), lambda a: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in a], pa.string())

        def last(t: pa.Table) -> pa.Table:
            ids, sums = t["ids"].combine_chunks(), [pa.array([], pa.string())]
            for at in range(0, len(ids), ROWS):
                sums.append(sha(texts_of(ids.slice(at, ROWS), pieces)))
            return pa.table([t["doc_id"], t["n_tokens"], sha(ids), pa.concat_arrays(sums), ids][: 4 + keep_ids], names)

        return last

    return _encoded(docs, content, block, make_last, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), read_tokenizer(path))
