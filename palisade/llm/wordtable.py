"""A table of distinct words: each word of a corpus gets its value once, and values meet the words' places.

Texts are split at white space and coded in blocks of about ``BLOCK`` bytes: a block is one row that holds, for each
place of its texts, the number of the word in the block's own list of distinct words.  The lists are shuffled by the
words' hashes; there each distinct word of the corpus is given its value, and the values go back to the blocks, where
they meet the places.  A text is split once, and never leaves its block's row: only numbers do.

Blocks are named by partition and number within it, so a task that runs again after a lost executor makes the same
blocks, provided that it reads its rows in the same order again: read tables, or settled ones, not shuffled frames.
What a worker holds is a block, or a bucket of words; buckets follow the size of the input (``common.buckets``).  The
most frequent word is in each list once, so no bucket is much larger than another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import buckets, lean, partitions, parts, release
from palisade.llm.dartminhash import mix

#: Bytes of text in a block at most; a longer text is a block of its own.  A batch of rows is one block or more.
BLOCK = 32 << 20
#: Bytes of input whose words share a bucket.
BUCKET = 4 << 20
_BASE = 0x100000001B3
#: White space as regular expressions of tokenizers take it: without the four separators U+001C to U+001F.
SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = r"[\x1c-\x1f]"


def split(texts: pa.Array, separators: bool) -> pa.ListArray:
    """Words between white space; empty strings may stand at the ends.  separators: whether U+001C to U+001F separate."""
    if separators or not pc.any(pc.match_substring_regex(texts, SEPARATORS)).as_py():
        return pc.utf8_split_whitespace(texts)
    return pa.array([SPACES.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of the bytes of each word."""
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(words), 50_000):
        part = words.slice(at, 50_000)
        data, ends = bytes_of(part), ends_of(part) - ends_of(part)[0]
        power = np.cumprod(np.full(len(data), _BASE, np.uint64))
        back = np.cumprod(np.full(len(data) + 1, pow(_BASE, -1, 2**64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
        out.append(mix((sums[ends[1:]] - sums[ends[:-1]]) * back[ends[:-1]]))
    return np.concatenate(out)


def ends_of(a: pa.Array) -> np.ndarray:
    """Ends of the values of a string or binary array in its bytes, a start before them."""
    return np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)


def bytes_of(a: pa.Array) -> np.ndarray:
    if not len(a):
        return np.zeros(0, np.uint8)
    ends = ends_of(a)
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def binary_of(sizes: np.ndarray, data: bytes, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _packed(zip_: pa.Codec, numbers: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[int, int, bytes]:
    raw = numbers.astype("<u4").tobytes() + sizes.astype("<u4").tobytes() + data.tobytes()
    return len(numbers), len(raw), zip_.compress(raw, asbytes=True)


def _unpacked(zip_: pa.Codec, n: int, size: int, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zip_.decompress(data.as_buffer(), size, asbytes=True)
    return np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u4", n, 4 * n), raw[8 * n :]


def coded_words(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words by number, ends of the rows among them, distinct words); empty strings have no place, but may be among the distinct ones."""
    coded = words.flatten().dictionary_encode()
    codes, ends, kinds = coded.indices.to_numpy(), words.offsets.to_numpy()[1:] - words.offsets[0].as_py(), coded.dictionary
    empty = kinds.index("").as_py() if len(kinds) else -1
    if empty >= 0:
        keep = codes != empty
        ends, codes = np.concatenate([[0], np.cumsum(keep)])[ends], codes[keep]
    return codes, ends, kinds


def _cut(count: int, separators: bool, most: int) -> Callable:
    names = ["key", "block", "ids", "ends", "n", "size", "data"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, zip_ = TaskContext.get(), pa.Codec("zstd", compression_level=3)
        first = context.partitionId() << 32 if context else 0
        whole = ((b, a, z) for b in batches for a, z in parts(b["text"], most))
        for block, (b, a, z) in enumerate(whole, first):
            ids, (codes, ends, kinds) = b["doc_id"].slice(a, z - a), coded_words(split(b["text"].slice(a, z - a), separators))
            planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            rows = [(-1 - block, len(codes), len(planes), zip_.compress(planes, asbytes=True) if planes else b"")]
            del planes
            of = (word_hashes(kinds) % np.uint64(count)).astype(np.int64)
            by = np.argsort(of, kind="stable")
            kinds, of = kinds.take(pa.array(by)), of[by]
            at, data = ends_of(kinds), bytes_of(kinds)
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=False):
                rows.append((int(of[i]), *_packed(zip_, by[i:j], np.diff(at[i : j + 1]), data[at[i] - at[0] : at[j] - at[0]])))
            rest = len(rows) - 1
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()),
                pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * (rest + 1), pa.int32()), ids), pa.array([ends.tolist()] + [None] * rest, pa.list_(pa.int64())),
                pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()),
            ], names)

    return run


def _valued(make_value: Callable[[], Callable[[list[str]], list[bytes]]]) -> Callable:
    names = ["key", "n", "size", "data"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, value, held, at = pa.Codec("zstd", compression_level=3), make_value(), [], None

        def out() -> pa.RecordBatch:
            packs = [_unpacked(zip_, *p[1:]) for p in held]
            words = binary_of(np.concatenate([p[1] for p in packs]), b"".join(p[2] for p in packs), pa.string()).dictionary_encode()
            kinds = words.dictionary.to_pylist()
            by = sorted(range(len(kinds)), key=kinds.__getitem__)
            found = [b""] * len(kinds)
            for i, v in zip(by, value([kinds[i] for i in by]), strict=True):
                found[i] = v
            found, done, rows = pa.array(found, pa.binary()), 0, []
            for (block, *_), (numbers, *_) in zip(held, packs, strict=True):
                mine = found.take(words.indices.slice(done, len(numbers)))
                done += len(numbers)
                rows.append((-1 - block, *_packed(zip_, numbers, np.diff(ends_of(mine)), bytes_of(mine))))
            held.clear()
            types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for b in batches:  # sorted by key
            for key, block, n, size, data in zip(b["key"].to_pylist(), b["block"].to_pylist(), b["n"].to_pylist(), b["size"].to_pylist(), b["data"], strict=True):
                if key < 0:
                    continue
                if key != at and held:
                    yield out()
                at = key
                held.append((block, n, size, data))
        if held:
            yield out()

    return run


def with_values(
    docs: DataFrame, make_value: Callable[[], Callable[[list[str]], list[bytes]]], finish: Callable[[pa.Array, np.ndarray, pa.BinaryArray], pa.Table], schema: str, separators: bool, block: int = BLOCK
) -> DataFrame:
    """What ``finish(ids, ends, values)`` makes of each block: its doc_ids, the ends of their texts among the words, and each word's value.

    make_value is called once in each worker and gives a function from distinct words, sorted, to their values in
    bytes.  A null text is empty.
    """
    n, kind = partitions(docs.sparkSession), docs.schema["doc_id"].dataType.simpleString()

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or left["key"][0].as_py() >= 0:  # a bucket of words, which only the other branch reads
            return empty()
        zip_, row = pa.Codec("zstd"), left.slice(0, 1).to_batches()[0]
        ends, count = row["ends"][0].values.to_numpy(zero_copy_only=False), row["n"][0].as_py()
        planes = zip_.decompress(row["data"][0].as_buffer(), row["size"][0].as_py(), asbytes=True) if count else b""
        codes = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        packs = [_unpacked(zip_, *p) for p in zip(right["n"].to_pylist(), right["size"].to_pylist(), right["data"], strict=True)]
        if packs:
            found = binary_of(np.concatenate([p[1] for p in packs]), b"".join(p[2] for p in packs), pa.binary())
            by = np.argsort(np.concatenate([p[0] for p in packs]))
            found = found.take(pa.array(by)).take(pa.array(codes))
        else:
            found = pa.array([], pa.binary())
        del packs, codes, planes
        release()
        return finish(row["ids"][0].values, ends, found)

    def empty() -> pa.Table:
        return finish(pa.array([], arrow_kind), np.zeros(0, np.int64), pa.array([], pa.binary()))

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = texts.mapInArrow(_cut(buckets(docs, BUCKET), separators, block), f"key long, block long, ids array<{kind}>, ends array<long>, n int, size long, data binary")
    cut = cut.repartition(n, "key")  # one exchange serves both branches
    values = cut.sortWithinPartitions("key").mapInArrow(_valued(make_value), "key long, n int, size long, data binary").repartition(n, "key")
    return cut.groupBy("key").cogroup(values.groupBy("key")).applyInArrow(met, schema)
