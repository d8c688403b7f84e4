"""Line dedup, substring dedup and near duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from palisade.llm import dartminhash, neardup, substrings
from palisade.llm.components import components
from palisade.llm.linededup import keep_bitmaps, line_dedup
from palisade.llm.substrings import substring_dedup
from palisade.llm.suffixes import order, prefix_classes

DOCS = "doc_id long, text string"


def make(seed: int, n: int = 60) -> list[tuple[int, str]]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared, base = [text(12) for _ in range(6)], text(80).split()
    out = []
    for i in range(n):
        lines = [text(r.randint(1, 15)) for _ in range(r.randint(1, 6))] + [r.choice(shared) for _ in range(r.randint(0, 3))]
        if i % 4 == 0:
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            lines = [" ".join(w)]
        r.shuffle(lines)
        out.append((i * 3, "\n".join(lines)))
    return out + [(1000, out[0][1]), (1001, ""), (1002, " \n\t\n"), (1003, "short"), (1004, "aaaa" * 60), (1005, "aaaa" * 50)]


ODD = [(None, "a line that is long enough\nanother"), (None, None), (7, None), (5, "A LINE that is long enough \nx"), (6, "a line that is long enough\ny"), (6, "a line that is long enough\ny"), (6, "other text of this id\na line that is long enough")]


def expected_lines(docs):
    first: dict[str, int] = {}
    keys = lambda t: [(x, x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})) for x in (t or "").split("\n")]
    for d, t in docs:
        for _, k in keys(t):
            if d is not None and len(k) >= 10:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        kept = [x for x, k in keys(t) if d is None or len(k) < 10 or first[k] == d]
        out.append((d, len(keys(t)), len(keys(t)) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("docs", [make(1), make(2), ODD, [], [(3, "x" * 50_000 + "\n" + "line number one\n" * 2000), (4, "line number one")]])
def test_line_dedup(spark, docs):
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS pos", "'k' AS key", "'z' AS h1")
    assert Counter(map(tuple, line_dedup(df).collect())) == expected_lines(docs)


def test_keep_bitmaps_are_runs(spark):
    docs = [(1, "the first line\nb"), (2, "a\nthe first line\nb\nthe first line\nc")]
    got = keep_bitmaps(spark.createDataFrame(docs, DOCS)).collect()
    assert [(r["doc_id"], r["n_dropped"], [tuple(x) for x in r["keep_runs"]]) for r in got] == [(2, 2, [(0, 1), (2, 1), (4, 1)])]


def test_hot_line_is_cut_into_salts(spark):
    docs = [(i, f"a line in every document\nown {i} line of text") for i in range(500)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {i: int(i > 0) for i in range(500)}


def expected_cuts(docs):
    first: dict[bytes, int] = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return Counter(out)


LONG = "shared passage of more than fifty bytes, with éàü and so on and on."


@pytest.mark.parametrize("docs", [make(3), make(4, 150), ODD, [], [(None, LONG), (2, LONG), (2, LONG + "x"), (1, "y" + LONG), (3, "z" * 5000), (4, "z" * 100 + "q" + "z" * 60), (9, "q" + LONG * 3)]])
def test_substring_dedup(spark, docs):
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS key", "'s' AS spans", "2 AS h")
    got = Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in substring_dedup(df).collect())
    assert got == expected_cuts(docs)


@pytest.mark.parametrize(("shard", "chunk"), [(200, 300), (1, 1), (1 << 20, 1 << 20)])
def test_shards_and_chunks_of_any_size(monkeypatch, shard, chunk):
    """The packed rows of both shuffles, without Spark."""
    import pyarrow as pa

    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    docs = make(5, 40)
    table = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([0] * len(docs)), pa.array([0] * len(docs)), pa.array([t for _, t in docs])], ["doc_id", "h1", "h2", "text"])

    def dealt(batches):
        rows = pa.Table.from_batches([b for b in batches if b.num_rows]).sort_by("bucket")
        return iter(rows.to_batches(max_chunksize=7))

    met = pa.Table.from_batches(list(substrings._met(dealt(substrings._anchored(3)(iter([table]))))))
    places = {}
    for d, p in zip(met["doc_id"].to_pylist(), met["pos"].to_pylist(), strict=True):
        places.setdefault(d, set()).add(p)
    zipped = next(substrings._zipped(iter([table])))
    at = pa.array([sorted(places.get(d, ())) for d, _ in docs], pa.list_(pa.int32()))
    shared = pa.RecordBatch.from_arrays([zipped["doc_id"], pa.array([1] * len(docs), pa.int32()), zipped["size"], zipped["block"], at], ["doc_id", "h", "size", "block", "at"])
    halves = iter([shared.slice(0, 21), shared.slice(21)])
    spans: dict[int, list] = {}
    for out in substrings._sharded(dealt(substrings._sent(3)(halves))):
        for d, _, a, z in zip(*(c.to_pylist() for c in out.columns), strict=True):
            spans.setdefault(d, []).append((a, z))
    want = {k[0]: (k[2], k[3]) for k in expected_cuts(docs) if k[2]}
    assert {d: (sum(z - a for a, z in substrings.merged(s)), len(substrings.merged(s))) for d, s in spans.items()} == want


def test_suffix_order_and_classes():
    r = random.Random(9)
    for _ in range(60):
        alphabet = r.choice(["a", "ab", "abcd", "".join(map(chr, range(32, 127)))])
        s = "".join(r.choice(alphabet) for _ in range(r.randint(50, 300))).encode()
        s += s[: r.randint(0, len(s))]
        a = np.frombuffer(s, np.uint8)
        got = order(a.astype(np.int64)).tolist()
        assert sorted(got) == list(range(len(s)))
        assert [s[i : i + 50] for i in got] == sorted(s[i : i + 50] for i in range(len(s)))
        starts = np.arange(len(s) - 49)
        c = prefix_classes(a, starts)
        assert len(set(zip(c.tolist(), (s[i : i + 50] for i in starts), strict=True))) == len(set(c.tolist())) == len({s[i : i + 50] for i in starts})


def expected_classes(docs, weighted=False):
    s = neardup.Shingler()
    ids = sorted({d for d, _ in docs if d is not None})

    def runs(t):
        w = s.words(t)
        found = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        return found if weighted else Counter(set(found))

    sets = [(d, runs(t), t or "") for d, t in docs if d is not None]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x, t) in enumerate(sets):
        for b, y, u in sets[:i]:
            if (not x and not y and t == u) or (x and y and (x & y).total() >= 0.8 * (x | y).total() - 1e-9):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return Counter((d, None if d is None else find(d)) for d, _ in docs)


@pytest.mark.parametrize("docs", [make(6), make(7, 120), ODD, [], [(5, "one two"), (4, "one, TWO"), (3, "two one"), (2, "word " * 3000)]])
def test_near_duplicates(spark, docs):
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS node", "2 AS band", "3 AS k1")
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == expected_classes(docs)


def test_tiles_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 3)
    docs = make(8, 80)
    assert Counter(map(tuple, neardup.near_duplicates(spark.createDataFrame(docs, DOCS)).collect())) == expected_classes(docs)


def test_weighted_near_duplicates(spark, monkeypatch):
    """Runs count as often as they occur: documents 1 and 2 hold the same runs, but not as often."""
    line, other = "one line of words that comes back. ", "another line whose words come only once in the text. "
    docs = [(1, line * 9 + other), (2, line * 3 + other), (3, line * 8 + other), (4, None), *((d + 10, t) for d, t in make(9, 80) if d is not None)]
    df = spark.createDataFrame(docs, DOCS)
    plain, counted = expected_classes(docs), expected_classes(docs, weighted=True)
    assert (2, 1) in plain and (2, 2) in counted and (3, 1) in counted
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == plain
    assert Counter(map(tuple, neardup.near_duplicates(df, weighted=True).collect())) == counted
    monkeypatch.setattr(neardup, "ELEMENTS", 40)
    assert Counter(map(tuple, neardup.near_duplicates(df, weighted=True).collect())) == counted


def test_dartminhash_estimates():
    x = np.arange(1000, dtype=np.uint64)
    one = dartminhash.signatures(np.concatenate([x, x[100:]]), None, np.array([1000, 900]), 2000)
    assert abs((one[0] == one[1]).mean() - 0.9) < 0.03
    w = np.concatenate([np.full(1000, 1.0), np.full(1000, 2.5)])
    two = dartminhash.signatures(np.concatenate([x, x]), w, np.array([1000, 1000]), 2000)
    assert abs((two[0] == two[1]).mean() - 0.4) < 0.04
    alone = dartminhash.signatures(x[:1], None, np.array([1]), 64)
    assert (alone != 0).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def test_query_columns(spark):
    from palisade.llm.queries import QUERIES

    df = QUERIES["op8_substring_dedup"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = Counter((d, n, k, s, hashlib.sha256(b).hexdigest()) for (d, n, k, s, b) in expected_cuts(docs))
    assert Counter(map(tuple, df.collect())) == want
