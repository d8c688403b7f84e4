"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Every 50-byte string has an anchor: the least hash among its 20-byte windows.  Equal strings have equal anchors at the
same place in them.  So

1. every document's anchors are shuffled by hash, and those that one document has alone are dropped;
2. each remaining anchor brings the run of strings whose anchor it is (up to 80 bytes) to its hash's shard;
3. a shard sorts the suffixes of its distinct runs with the difference-cover algorithm (``suffixes``): sampled
   triples are named, names sorted by recursion, the remaining suffixes merged, adjacent 50-byte prefixes compared;
   each class of equal prefixes has its least document, and documents above it lose the bytes.

Rows of both shuffles are packed, one compressed block for each bucket of hashes, and a batch combines what it holds
twice: anchors known to be shared travel once, and of equal runs only those of the batch's least document go to the
shard (the others are covered already).  So a passage in a third of all documents sends a row for each batch, not for
each document, and a bucket's size is the data's over the number of buckets.

Defined cases: null text is empty; texts under 50 bytes keep all; a null doc_id takes no part (nothing of it is
removed, nor does it remove); rows that repeat a doc_id do not remove each other's bytes; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.common import buckets, lean, partitions, table
from palisade.llm.dartminhash import mix
from palisade.llm.suffixes import DEPTH, prefix_classes

ANCHOR = 20
SPAN = DEPTH - ANCHOR  # an anchor's string starts at most so far before it
CHUNK = 1 << 20  # bytes hashed at once
PART = 8 << 20  # bytes of text whose runs are held at once
SHARD = 1 << 19  # bytes sorted at once
BUCKETS = 4  # of each partition, at least
BUCKET = 2 << 20  # bytes of input that share a bucket of hashes
_BASE = 0x100000001B3
_INDEX = np.uint64(2**36 - 1)


def gram_hashes(b: np.ndarray, k: int = ANCHOR) -> np.ndarray:
    """Hash of each k-byte window, by doubling."""
    cur, size, out, done = b.astype(np.uint64) + np.uint64(1), 1, None, 0
    while k:
        if k & 1:
            if out is None:
                out, done = cur, size
            else:
                n = len(b) - done - size + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 2**64)) + cur[done : done + n]
                done += size
        k >>= 1
        if k:
            n = len(b) - 2 * size + 1
            cur = cur[:n] * np.uint64(pow(_BASE, size, 2**64)) + cur[size : size + n]
            size *= 2
    return mix(out)


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): the anchor's place for each start of a 50-byte string, and the hash of each 20-byte window."""
    if len(b) < DEPTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(b)
    cur, size, width = (h & ~_INDEX) | np.arange(len(h), dtype=np.uint64), 1, SPAN + 1
    n = len(h) - width + 1
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return (np.minimum(cur[:n], cur[width - size : width - size + n]) & _INDEX).astype(np.int64), h


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _packed(key: np.ndarray, columns: dict[str, pa.Array], count: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, compressed rows with their 48-bit keys), the rows of each bucket sorted by key."""
    key = key & np.uint64(2**48 - 1)
    bucket = (key % np.uint64(count)).astype(np.int64)
    by = np.lexsort((key, bucket))
    rows = pa.table({"low": pa.array((key & np.uint64(2**32 - 1)).astype(np.uint32)), "high": pa.array((key >> np.uint64(32)).astype(np.uint16))} | columns).take(pa.array(by))
    starts = _heads(bucket[by])
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(by)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(rows.slice(a, z - a).combine_chunks())
        yield int(bucket[by[a]]), sink.getvalue().to_pybytes()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket, sorted by key (column ``key``); batches are sorted by bucket."""
    held, at = [], None

    def out() -> pa.Table:
        t = pa.concat_tables(held).combine_chunks()
        key = t["low"].to_numpy().astype(np.uint64) | (t["high"].to_numpy().astype(np.uint64) << np.uint64(32))
        by = np.argsort(key, kind="stable")
        return t.drop_columns(["low", "high"]).append_column("key", pa.array(key)).take(pa.array(by))

    for b in batches:
        for p, block in zip(b["bucket"].to_pylist(), b["block"], strict=True):
            if p != at and held:
                yield out()
                held = []
            at = p
            with pa.ipc.open_stream(block.as_buffer()) as r:
                held.append(r.read_all())
    if held:
        yield out()


def _chunks(b: pa.RecordBatch, text: Callable[[int], bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, sizes, bytes) of parts of a batch."""
    rows, raw, n = [], [], 0
    for i in range(b.num_rows):
        raw.append(text(i))
        rows.append(i)
        n += len(raw[-1])
        if n >= CHUNK or i + 1 == b.num_rows:
            yield rows, np.array([len(x) for x in raw]), np.frombuffer(b"".join(raw), np.uint8)
            rows, raw, n = [], [], 0


def _anchored(count: int) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, bytes]] = []
            for rows, sizes, text in _chunks(b, lambda i, b=b: (b["text"][i].as_py() or "").encode()):
                out += _chunk(b["doc_id"], rows, sizes, text, count)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "block"])

    return run


def _chunk(ids: pa.Array, rows: list[int], sizes: np.ndarray, text: np.ndarray, count: int) -> Iterator[tuple[int, bytes]]:
    ends = np.cumsum(sizes)
    at, h = anchors(text)
    at = at[_heads(at)]
    doc = np.searchsorted(ends, at, side="right")
    inside = at + ANCHOR <= ends[doc] if len(at) else np.zeros(0, bool)
    at, doc = at[inside], doc[inside]
    if not len(at):
        return
    by = np.argsort(h[at], kind="stable")  # documents stay in order within a hash
    hs, ds = h[at][by], doc[by]
    start = _heads(hs)
    size = np.diff(np.concatenate([start, [len(hs)]]))
    known = np.repeat(ds[start] != ds[start + size - 1], size)
    away = known.copy()
    away[start] = False  # one of them stays under its hash, for other chunks to meet
    key = np.where(away, mix(hs ^ mix(np.arange(len(hs), dtype=np.uint64))), hs)
    pos = at[by] - (ends - sizes)[ds]
    yield from _packed(key, {"doc_id": ids.take(pa.array(np.array(rows)[ds])), "pos": pa.array(pos, pa.int32()), "known": pa.array(known)}, count)


@lean
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that another document has."""
    for t in _unpacked(batches):
        start = _heads(t["key"].to_numpy())
        code = t["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        size = np.diff(np.concatenate([start, [len(code)]]))
        shared = np.minimum.reduceat(code, start) != np.maximum.reduceat(code, start)
        keep = pa.array(np.repeat(shared, size) | t["known"].to_numpy())
        yield from t.select(["doc_id", "pos"]).filter(keep).combine_chunks().to_batches()


@lean
def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``PART`` bytes of text, or of one row."""
    for b in batches:
        size, at = np.cumsum(b["size"].to_numpy()), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART, side="right")))
            yield b.slice(at, end - at)
            at = end


def _runs(b: pa.RecordBatch) -> pa.Table:
    """Each run of strings with a shared anchor: its row, its start in the text, the anchor's hash, and its bytes."""
    zip_, out = pa.Codec("zstd"), [pa.table({c: pa.array([], t) for c, t in (("row", pa.int64()), ("lo", pa.int32()), ("hash", pa.uint64()), ("window", pa.binary()))})]
    raw = lambda i: zip_.decompress(b["block"][i].as_buffer(), b["size"][i].as_py(), asbytes=True)
    for rows, sizes, text in _chunks(b, raw):
        ends = np.cumsum(sizes)
        begin = ends - sizes
        flagged = np.zeros(len(text), bool)
        for i, o in zip(rows, begin.tolist(), strict=True):
            flagged[b["at"][i].values.to_numpy() + o] = True
        at, h = anchors(text)
        starts = np.flatnonzero(flagged[at])
        doc = np.searchsorted(ends, starts, side="right")
        starts, doc = (x[starts + DEPTH <= ends[doc]] for x in (starts, doc)) if len(starts) else (starts, doc)
        if not len(starts):
            continue
        first = _heads(at[starts])
        a, z, doc = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1] + DEPTH, doc[first]
        to = np.cumsum(z - a).astype(np.int32)
        data = np.empty(int(to[-1]), np.uint8)
        # Bytes are copied offset by offset: a run has 50 to 80 of them.
        begun = to - (z - a)
        for k in range(DEPTH + SPAN):
            inside = slice(None) if k < DEPTH else a + k < z
            data[begun[inside] + k] = text[a[inside] + k]
        windows = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.concatenate([[0], to]).astype(np.int32)), pa.py_buffer(data)])
        out.append(pa.table({"row": pa.array(np.array(rows)[doc], pa.int64()), "lo": pa.array(a - begin[doc], pa.int32()), "hash": pa.array(h[at[a]], pa.uint64()), "window": windows}))
    return pa.concat_tables(out).combine_chunks()


def _ranks(ids: pa.Array) -> np.ndarray:
    """Equal numbers for equal ids, in their order."""
    coded = ids.dictionary_encode()
    return pa.compute.rank(coded.dictionary, tiebreaker="dense").to_numpy().astype(np.int64)[coded.indices.to_numpy()]


def _sent(count: int) -> Callable:
    """Runs of each batch's least documents, packed by their anchors' hashes; spans of the other documents' runs."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            runs = _runs(b)
            if not runs.num_rows:
                continue
            row, lo = runs["row"].to_numpy(), runs["lo"].to_numpy()
            size = pa.compute.binary_length(runs["window"]).to_numpy()
            coded = runs["window"].combine_chunks().dictionary_encode()
            kind, rank = coded.indices.to_numpy(), _ranks(b["doc_id"])[row]
            least = np.full(len(coded.dictionary), 2**62)
            np.minimum.at(least, kind, rank)
            first = rank == least[kind]
            # The others' runs lose all; those of a row are in order, so spans that meet are merged in one pass.
            others = np.flatnonzero(~first)
            of, a, z = row[others], lo[others], lo[others] + size[others]
            new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (a[1:] > z[:-1])])) if len(of) else others
            last = np.concatenate([new[1:], [len(of)]]) - 1 if len(of) else others
            of = pa.array(of[new], pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(row[others][new] % count, pa.int32()), pa.nulls(len(of), pa.binary()), b["doc_id"].take(of), b["h"].take(of),
                pa.array(a[new], pa.int32()), pa.array(z[last], pa.int32()),
            ], names)
            sent = pa.array(np.flatnonzero(first))
            of = runs["row"].take(sent).combine_chunks()
            columns = {"window": runs["window"].take(sent).combine_chunks(), "doc_id": b["doc_id"].take(of), "h": b["h"].take(of), "lo": runs["lo"].take(sent).combine_chunks()}
            del coded
            for bucket, block in _packed(runs["hash"].take(sent).to_numpy(), columns, count):
                none = pa.nulls(1, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.binary()), pa.nulls(1, b["doc_id"].type), pa.nulls(1, b["h"].type), none, none], names)

    names = ["bucket", "block", "doc_id", "h", "a", "z"]
    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def shard_spans(windows: pa.Array, docs: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, from, to): what rows lose to smaller documents."""
    coded = windows.dictionary_encode()
    kinds, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    sizes = np.array([len(w) for w in kinds])
    ends = np.cumsum(sizes)
    valid = sizes - DEPTH + 1
    begin = np.cumsum(valid) - valid
    kind = np.repeat(np.arange(len(kinds)), valid)
    offset = np.arange(len(kind)) - begin[kind]
    cls = prefix_classes(np.frombuffer(b"".join(kinds), np.uint8), (ends - sizes)[kind] + offset)
    ids = docs.dictionary_encode()
    rank = pa.compute.rank(ids.dictionary, tiebreaker="dense").to_numpy().astype(np.int64)[ids.indices.to_numpy()]
    own = np.full(len(kinds), 2**62)
    np.minimum.at(own, of, rank)
    least = np.full(int(cls.max()) + 1, 2**62)
    np.minimum.at(least, cls, own[kind])
    # A row above its window's least document loses all of it; the least one's rows lose what other windows have.
    above = np.flatnonzero(rank > own[of])
    lost = least[cls] < own[kind]
    change = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])) | np.concatenate([np.diff(np.concatenate([[-1], kind])) != 0, [True]]))
    a, z = change[:-1], change[1:]
    a, z = a[lost[a]], z[lost[a]]
    # Rows of the least document by kind, met with the kind's pieces.
    rest = np.flatnonzero(rank == own[of])
    rest = rest[np.argsort(of[rest], kind="stable")]
    lo, hi = np.searchsorted(kind[a], of[rest], "left"), np.searchsorted(kind[a], of[rest], "right")
    times = hi - lo
    row = np.repeat(rest, times)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
    return (
        np.concatenate([above, row]),
        np.concatenate([starts[above], starts[row] + offset[a[piece]]]),
        np.concatenate([starts[above] + sizes[of[above]], starts[row] + offset[z[piece] - 1] + DEPTH]),
    )


@lean
def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they come, and those of the packed runs; a shard ends where a key ends."""
    names = ["doc_id", "h", "a", "z"]
    passed: list[pa.RecordBatch] = []

    def blocks() -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.compute.is_valid(b["block"])
            passed.append(pa.RecordBatch.from_arrays([b[c] for c in names], names).filter(pa.compute.invert(packed)))
            yield b.select(["bucket", "block"]).filter(packed)

    for t in _unpacked(blocks()):
        yield from passed
        passed.clear()
        key = t["key"].to_numpy()
        size = np.cumsum(pa.compute.binary_length(t["window"]).to_numpy())
        ends = np.concatenate([_heads(key)[1:], [len(key)]])
        at = 0
        while at < len(key):
            full = np.searchsorted(size[ends - 1], (size[at - 1] if at else 0) + SHARD)
            end = int(ends[min(full, len(ends) - 1)])
            part = t.slice(at, end - at).combine_chunks()
            row, a, z = shard_spans(part["window"].combine_chunks(), part["doc_id"].combine_chunks(), part["lo"].to_numpy().astype(np.int64))
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks().take(of), part["h"].combine_chunks().take(of), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names)
            at = end
    yield from passed


@lean
def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = pa.Codec("zstd", compression_level=3)
    for b in batches:
        raw = (t.as_buffer() for t in b["text"])
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["h1"], b["h2"], pa.compute.binary_length(b["text"]).cast(pa.int64()), pa.array([zip_.compress(x, asbytes=True) for x in raw], pa.binary())], ["doc_id", "h1", "h2", "size", "block"])


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = pa.Codec("zstd")
    for whole in batches:
        for b in _parts(iter([whole])):
            cols: list[list] = [[], [], [], []]
            for i, (h, spans) in enumerate(zip(b["h"].to_pylist(), b["spans"].to_pylist(), strict=True)):
                raw = zip_.decompress(b["block"][i].as_buffer(), n, asbytes=True) if (n := b["size"][i].as_py()) else b""
                found = merged([(s["a"], s["z"]) for s in spans or () if s["h"] == h])
                kept, at = [], 0
                for a, z in found:
                    kept.append(raw[at:a])
                    at = z
                kept.append(raw[at:])
                for c, v in zip(cols, (len(raw), sum(z - a for a, z in found), len(found), b"".join(kept)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs``; kept: binary, what remains of the text."""
    n, count = partitions(docs.sparkSession), max(BUCKETS * partitions(docs.sparkSession), buckets(docs, BUCKET))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    zipped = f"doc_id {kind}, h1 long, h2 long, size long, block binary"
    hashed = rows.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    # The same exchange serves both joins on doc_id; the second filter is what the first join would add to its side.
    named = F.col("doc_id").isNotNull()
    keyed = hashed.where(named).mapInArrow(_zipped, zipped).where(named).repartition(n, "doc_id")
    # Rows of a doc_id with different texts are numbered, by 128 bits of hash.
    keyed = keyed.select("doc_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("h1", "h2")).alias("h"), "size", "block")
    met = (
        rows.where(named).mapInArrow(_anchored(count), "bucket int, block binary")
        .repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_met, f"doc_id {kind}, pos int")
    )
    places = met.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    shared = keyed.join(places.hint("merge"), "doc_id")
    spans = (
        shared.mapInArrow(_sent(count), f"bucket int, block binary, doc_id {kind}, h int, a int, z int")
        .repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_sharded, f"doc_id {kind}, h int, a int, z int")
    )
    lost = spans.groupBy("doc_id").agg(F.collect_set(F.struct("h", "a", "z")).alias("spans"))
    joined = keyed.join(lost.hint("merge"), "doc_id", "left").select("doc_id", "h", "size", "block", "spans")
    unnamed = hashed.where(~named).mapInArrow(_zipped, zipped).select("doc_id", F.lit(1).alias("h"), "size", "block", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans"))
    return joined.unionByName(unnamed).mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
