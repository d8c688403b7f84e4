"""Benchmark decontamination: pigeonhole edit matching.

Items and texts are compared in lower case with every run of other characters than letters and digits as one space.
An item of m characters may have k = floor(``rate`` * m) edits.  It is cut into k + 1 pieces; k edits leave at least
one piece whole, so an Aho-Corasick automaton of all pieces finds every possible place, and Myers' bit-parallel
distance over the window around each place decides.  The cut is a binary tree: a part with k edits falls into two, one
of which has at most its share of k - 1, so a hit is first verified in the part that holds it and its neighbour, then
in ever larger parts; chance hits end there.  Texts stay where they are: nothing is shuffled.

Items are dealt by hash into blocks of about ``BLOCK_ITEMS`` rows and ``BLOCK_BYTES`` bytes at most, so what a worker
holds is bounded; a longer benchmark takes more passes over the documents.

An item too short for an edit must stand as whole words, so that "yes" is not found in "yesterday".

Defined cases: null or empty texts match nothing; items without a letter or digit, and null ones, match nothing;
a null doc_id or item_id is kept as it is; repeated rows each give their rows; extra columns are ignored; a document
that holds an item several times gives one row, its best place (the first of equals).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palisade.llm.common import lean, table

OTHER = re.compile(r"[\W_]+")
RATE = 0.1
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 1 << 20


def normal(text: str | None) -> str:
    return OTHER.sub(" ", text.lower()).strip() if text else ""


class Pattern:
    """Myers' bit vectors of one part of an item, with its place in the item, its edit budget and the part above."""

    def __init__(self, item: str, at: int, k: int, above: Pattern | None = None):
        self.item, self.m, self.at, self.k, self.above = item, len(item), at, k, above
        self.bits: tuple | None = None

    def leaves(self) -> Iterator[Pattern]:
        """The k + 1 pieces."""
        if not self.k:
            yield self
            return
        left = (self.k - 1) // 2
        cut = self.m * (left + 1) // (self.k + 1)
        yield from Pattern(self.item[:cut], self.at, left, self).leaves()
        yield from Pattern(self.item[cut:], self.at + cut, self.k - 1 - left, self).leaves()

    def _bits(self) -> tuple:
        masks: dict[str, int] = {}
        for i, c in enumerate(self.item):
            masks[c] = masks.get(c, 0) | 1 << i
        self.bits = masks.get, (1 << self.m) - 1, 1 << (self.m - 1)
        return self.bits

    def search(self, text: str) -> tuple[int, int]:
        """Least distance of the item to any substring of ``text``, and the end of the first such substring."""
        get, full, top = self.bits or self._bits()
        pv, mv, score = full, 0, self.m
        best, end = self.m, 0
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, end = score, j
                if best == 0:
                    break
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[object, str]], rate: float):
        at: dict[str, list[tuple[Pattern, Pattern, object]]] = {}
        for item, text in items:
            if n := normal(text):
                whole = Pattern(n, 0, min(int(rate * len(n) + 1e-9), len(n) - 1))
                for leaf in whole.leaves():
                    at.setdefault(leaf.item, []).append((leaf, whole, item))
        self.automaton = ahocorasick.Automaton() if at else None
        for piece, places in at.items():
            self.automaton.add_word(piece, places)
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple[object, int, int, int, int]]:
        """(item, distance, budget, first possible start, end) in the normal form of ``text``, best place of each item."""
        t = normal(text)
        if not t or self.automaton is None:
            return
        best: dict[int, tuple] = {}
        done: set[tuple[int, int]] = set()
        for end, places in self.automaton.iter(t):
            for leaf, whole, item in places:
                start = end + 1 - leaf.m - leaf.at
                if (id(whole), start) in done:
                    continue
                if not whole.k and (t[max(0, start - 1) : start].strip() or t[end + 1 : end + 2].strip()):
                    continue  # a short item is no part of a word
                part, d, stop = leaf, 0, end + 1
                while d <= part.k and (part := part.above) is not None:
                    lo = max(0, start + part.at - part.k)
                    d, stop = part.search(t[lo : max(0, start + part.at + part.m + part.k)])
                    stop += lo
                if part is None:
                    done.add((id(whole), start))
                    if (old := best.get(id(whole))) is None or (d, stop) < (old[1], old[4]):
                        best[id(whole)] = (item, d, whole.k, max(0, stop - whole.m - d), stop)
        yield from best.values()


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The distinct items with a text, (item_id, text), one block after the other; one empty block if there are none."""
    rows = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # A fifth of a block is left for what the hash deals unevenly.
    blocks = max(1, -(-count * 5 // (BLOCK_ITEMS * 4)), -(-size * 5 // (BLOCK_BYTES * 4)))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, budget, start_at, end_at): a row for each document and item within the budget."""
    spark, kinds = docs.sparkSession, (docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, budget int, start_at long, end_at long"
    out = None
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        @lean
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = Matcher(shared.value, rate).find
            for b in batches:
                of, cols = [], [[], [], [], [], []]
                for i, t in enumerate(b["text"]):
                    for hit in find(t.as_py()):
                        of.append(i)
                        for c, v in zip(cols, hit, strict=True):
                            c.append(v)
                ids = b["doc_id"].take(pa.array(of, pa.int64()))
                types = (item_kind, pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, x) for c, x in zip(cols, types, strict=True))], ["doc_id", "item_id", "distance", "budget", "start_at", "end_at"])

        found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; decided row by row, whatever their ids."""
    spark, names = docs.sparkSession, docs.columns
    out = docs
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        @lean
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = Matcher(shared.value, rate).find
            for b in batches:
                keep = [next(find(t.as_py()), None) is None for t in b["text"]]
                yield pa.RecordBatch.from_arrays(b.filter(pa.array(keep, pa.bool_())).columns, names)

        out = out.mapInArrow(run, docs.schema)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
