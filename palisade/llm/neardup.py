"""Near duplicates: DartMinHash signatures, banded joining, exact check, connected components.

A document's set is its distinct runs of five words (all its words, if it has fewer), as 64-bit hashes; two documents are linked if
the Jaccard similarity of their sets is 0.8 or more, and a class is what links connect.  40 bands of 6 coordinates
find a pair at 0.8 with probability 1 - (1 - 0.8^6)^40 > 0.99999, and more similar pairs with more.

With ``weighted``, a run weighs as often as it occurs: signatures come from the weighted regions, and the similarity is
the sum of least counts over the sum of greatest counts.  Without it every distinct run weighs 1.

Equal word sequences become one node first, so copies cost nothing.  Within a band's bucket every node is compared
with the bucket's least node only; verified links give components.  Buckets whose nodes are then still in different
components are compared exactly, in tiles of about ``CHUNK`` by ``CHUNK`` nodes and ``ELEMENTS`` elements: a tile is one
matrix product in one task and returns a spanning forest of its links, never all pairs.  So no link between different
texts is lost, no bucket is held in one task (nor all pairs of a lead: its set is sent once to each chunk of them), and
rows stay in proportion to nodes.

Defined cases: texts without a word are linked only to equal texts; null text is empty; a null doc_id is in no class
(class_id null); rows that repeat a doc_id are one document, linked by any of its texts, and each gives a row; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import lean, settle, table
from palisade.llm.components import components
from palisade.llm.dartminhash import bands, mix, regions, signatures

WORD = re.compile(r"\w+")
SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 40, 6
CHUNK, SALTS = 512, 64
#: Sets signed at once, and elements of the sets signed at once or of a chunk: bounds a worker's memory.
SETS, ELEMENTS = 500, 500_000


class Shingler:
    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(text.lower()) if text else []

    def shingles(self, words: list[str]) -> np.ndarray:
        """Distinct element ids, sorted; empty without words."""
        return np.unique(self.runs(words))

    def regions(self, words: list[str], weighted: bool) -> np.ndarray:
        """What the exact check compares: elements, or each element's regions, as many as it has occurrences."""
        if not weighted:
            return self.shingles(words)
        elements, counts = np.unique(self.runs(words), return_counts=True)
        return np.unique(regions(elements, counts)[0])

    def runs(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        h = np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in words], np.uint64)
        n = min(SHINGLE, len(h))
        if n == 0:
            return h
        s = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            s = mix(s ^ h[j : len(h) - n + 1 + j])
        return s


def pack(a: np.ndarray) -> bytes:
    return a.astype("<u8").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def _signed(weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(ids: pa.Array, keys: list[bytes], sets: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets])
        if (full := sizes[sizes > 0]).size:
            weights = np.concatenate(counts).astype(float) if weighted else None
            hashes = bands(signatures(np.concatenate(sets), weights, full, BANDS * ROWS), ROWS).ravel()
        else:
            hashes = np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
        parts = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes, pa.int64()))
        total = pa.array([int(c.sum()) for c in counts] if weighted else sizes, pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(parts[:, 0].copy()), pa.array(parts[:, 1].copy()), total, lists], ["doc_id", "k1", "k2", "size", "bands"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler()
        for b in batches:
            ids = b["doc_id"]
            at, keys, sets, counts, n = 0, [], [], [], 0
            for i, t in enumerate(b["text"]):
                text = t.as_py() or ""
                ws = s.words(text)
                keys.append(xxhash.xxh3_128_digest(" ".join(ws) if ws else "\0" + text))
                runs = s.runs(ws)
                if weighted:
                    elements, times = np.unique(runs, return_counts=True)
                    sets.append(elements)
                    counts.append(times)
                    n += len(runs)
                else:
                    sets.append(np.unique(runs))
                    n += len(sets[-1])
                if len(sets) >= SETS or n >= ELEMENTS or i + 1 == len(ids):
                    yield out(ids.slice(at, len(sets)), keys, sets, counts)
                    at, keys, sets, counts, n = i + 1, [], [], [], 0

    return run


def _sets(weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["node"], pa.array([pack(s.regions(s.words(t.as_py()), weighted)) for t in b["text"]], pa.binary())], ["node", "set"])

    return run


@lean
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b["set_a"], b["set_b"], strict=True):
            x, y = x.as_py(), y.as_py()
            small, large = sorted((len(x), len(y)))
            if small < SIMILAR * large - 1e-9:
                keep.append(False)
                continue
            x, y = unpack(x), unpack(y)
            n = len(np.intersect1d(x, y, True))
            keep.append(n > 0 and n >= SIMILAR * (len(x) + len(y) - n) - 1e-9)
        yield pa.RecordBatch.from_arrays(pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_())).columns, ["a", "b"])


def tile_links(sets: list[np.ndarray], comps: list, chunks: list, i: int, j: int) -> list[tuple[int, int]]:
    """Spanning links among the sets of a tile; within one chunk if i equals j, else between the two."""
    sizes = np.array([len(x) for x in sets], float)
    flat = np.concatenate(sets)
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes.astype(int))
    often = times[col] > 1
    row, col = row[often], np.unique(col[often], return_inverse=True)[1]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    step = 4096
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        lo, hi = np.searchsorted(col, (c, c + step))
        m = np.zeros((len(sets), step), np.float32)
        m[row[lo:hi], col[lo:hi] - c] = 1
        shared += m @ m.T
    a, b = np.nonzero(np.triu((shared > 0) & (shared >= SIMILAR * (sizes[:, None] + sizes[None, :] - shared) - 1e-6), 1))
    root = {c: c for c in comps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (i == j or chunks[x] != chunks[y]) and (p := find(comps[x])) != (q := find(comps[y])):
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _tile(t: pa.Table) -> pa.Table:
    nodes = t["node"].to_pylist()
    sets = [unpack(x) for x in t["set"].to_pylist()]
    found = tile_links(sets, t["comp"].to_pylist(), t["chunk"].to_pylist(), t["i"][0].as_py(), t["j"][0].as_py())
    kind = t["node"].type
    return pa.table({"a": pa.array([nodes[x] for x, _ in found], kind), "b": pa.array([nodes[y] for _, y in found], kind)})


def near_duplicates(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs``; class_id is the least doc_id of the class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    signed = settle(rows.mapInArrow(_signed(weighted), f"doc_id {kind}, k1 long, k2 long, size long, bands array<long>"))
    nodes = signed.where(F.col("doc_id").isNotNull()).groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    keys = nodes.select("node", "size", F.explode("bands").alias("band"))
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / ELEMENTS)).cast("int")
    leads = keys.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n"), chunks.alias("chunks")).where(F.col("n") > 1)
    shared = settle(keys.drop("size").join(leads, "band"))

    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = shared.where(F.col("node") != F.col("lead")).groupBy(F.col("node"), F.col("lead").alias("b")).agg(F.max("chunks").alias("chunks")).select(F.col("node").alias("a"), "b", chunk.alias("chunk"))
    needed = shared.select("node").distinct()
    sets = settle(rows.join(needed, rows["doc_id"] == needed["node"]).select("node", "text").mapInArrow(_sets(weighted), f"node {kind}, set binary"))
    # A pair waits for its sets where the first of them is: the leads' sets come second, one to each chunk of a lead's pairs.
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    parts = shared.groupBy(F.col("lead").alias("b")).agg(F.max("chunks").alias("chunks"))
    lead_sets = parts.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "set_b")
    both = with_a.join(lead_sets, ["b", "chunk"]).select("a", "b", "set_a", "set_b")
    links = settle(both.mapInArrow(_linked, f"a {kind}, b {kind}"))
    first = settle(components(links))

    # A bucket's nodes are dealt by chunk wherever they meet, so that a large bucket is never in one task.
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    comp = shared.where(F.col("n") > 2).withColumn("chunk", chunk).join(first, "node", "left")
    comp = comp.select("band", "node", "chunks", "chunk", F.coalesce("root", "node").alias("comp"))
    apart = comp.groupBy("band", "chunks").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi"))
    tiles = (
        comp.join(apart.select("band", others.alias("chunk")), ["band", "chunk"])
        .select("band", "node", "comp", "chunk", others.alias("other"))
        .select("band", "node", "comp", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
        .join(sets, "node")
    )
    more = tiles.groupBy("band", "i", "j").applyInArrow(_tile, f"a {kind}, b {kind}")
    final = components(links.unionByName(more.distinct()))

    # Copies find their class by salted keys: a text that a third of all rows have is no single task's.
    classes = nodes.join(final, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("class_id"))
    dealt = signed.where(F.col("doc_id").isNotNull()).select("doc_id", "k1", "k2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    salted = dealt.select("k1", "k2", "salt").distinct().join(classes, ["k1", "k2"])
    named = dealt.join(salted, ["k1", "k2", "salt"]).select("doc_id", "class_id")
    return named.unionByName(signed.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
