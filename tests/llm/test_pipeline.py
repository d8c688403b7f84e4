"""The pipeline's stages and its whole run."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from palisade.llm import decontaminate
from palisade.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    n = docs.count()
    first = cp.language_id(spark, docs, SF)
    assert first.columns == docs.columns and first.count() > 0.95 * n
    lines = cp.line_dedup(spark, docs, SF)
    assert lines.schema.names == docs.schema.names and lines.count() <= n
    near = cp.near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns and near.count() < n and near.select("doc_id").distinct().count() == near.count()
    leaks = {r["doc_id"] for r in decontaminate.contaminated(docs, table(spark, SF, "benchmark")).collect()}
    kept = {r["doc_id"] for r in cp.without_benchmark(spark, docs, SF).select("doc_id").collect()}
    assert leaks and kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - leaks
    out = cp.run(spark, SF)
    rows = out.collect()
    assert [k for k, _ in cp.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "bpe"]
    assert 0 < len(rows) < n and all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows) and not leaks & {r["doc_id"] for r in rows}


def test_clashing_columns_ties_and_long_texts(spark):
    long = " ".join(f"word{i % 977}x" for i in range(150_000))
    rows = [(1, "the same words come twice in here\n" + "b" * 30, "en"), (2, "the same words come twice in here", "en"), (3, long, "en"), (4, long, "de"), (5, "first text of five", "en"), (5, "second text of five", "en"), (5, "first text of five", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "0L AS n_chars", "7 AS score", "'q' AS lang_pred", "1 AS row", "2 AS h", "3 AS class_id", "4 AS text_hash", "5 AS node")
    want = Counter((d, t) for d, t, _ in rows)
    for name, stage in cp.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
        if name == "line_dedup":
            assert kept == want - Counter([(2, rows[1][1]), (4, long)])
        elif name == "near_duplicates":
            assert kept == Counter(set(want) - {(4, long)})
        else:
            assert kept == want
        assert {(r["score"], r["lang_pred"], r["row"], r["h"]) for r in got.collect()} == {(7, "q", 1, 2)}


def test_odd_rows(spark):
    import tempfile

    sf = tempfile.mkdtemp()
    rows = [(1, "the same words come twice in here", "en", "s", 5), (2, "the same words come twice in here", "en", "s", 5), (None, "no id but text", None, None, None), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, "un autre texte en langue connue", "fr", "s", 3), (5, "un autre texte en langue connue", "fr", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "nothing that occurs anywhere")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in cp.run(spark, sf).collect())
    assert got == [(False, 1), (False, 5), (True, 0)]
    empty = tempfile.mkdtemp()
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert cp.run(spark, empty).collect() == []


def plain_lines(docs):
    keys = lambda t: [(x, x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})) for x in (t or "").split("\n")]
    first: dict[str, int] = {}
    for d, t in docs:
        for _, k in keys(t):
            if len(k) >= 10:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        kept = [x for x, k in keys(t) if len(k) < 10 or first[k] == d]
        if len(kept) == len(keys(t)):
            out.append((d, t))
        elif "\n".join(kept).strip(" \t\n\x0b\f\r"):
            out.append((d, "\n".join(kept)))
    return out


def plain_near(docs):
    """All pairs, by the runs of words as they are; every document goes to the least one it is linked to, by any way."""

    def runs(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {t or ""}

    sets = {d: runs(t) for d, t in docs}
    of = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and of[a] != of[b]:
            lo, hi = sorted((of[a], of[b]))
            of = {d: lo if c == hi else c for d, c in of.items()}
    return [(d, t) for d, t in docs if of[d] == d]


def plain_clean(docs, items):
    """The edit distance of every item to the nearest part of every text, by the whole table of it."""
    normal = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    texts, held = [normal(t) for _, t in docs], set()
    gap = max((len(normal(x)) for x in items), default=0) + 1
    codes = np.frombuffer(("\0" * gap).join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
    at = np.cumsum([gap] + [len(t) + gap for t in texts])
    steps = np.arange(len(codes) + 1, dtype=np.int32)
    for item in map(normal, items):
        k = min(len(item) // 10, len(item) - 1)
        if k == 0:
            held |= {i for i, t in enumerate(texts) if f" {item} " in f" {t} "}
        elif item:
            row = np.zeros(len(codes) + 1, np.int32)
            for n, c in enumerate(item, 1):
                new = np.concatenate([[n], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))]).astype(np.int32)
                row = np.minimum.accumulate(new - steps) + steps
            held |= {i for i, t in enumerate(texts) if (row[at[i] : at[i] + len(t) + 1] <= k).any()}
    return [x for i, x in enumerate(docs) if i not in held]


def test_every_stage_and_the_run_equal_plain_python(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def told(rows):
        return [(d, t) for d, t in rows if re.search(r"[^\W\d_]", t or "")]

    def coded(rows):
        out = []
        for d, t in rows:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            out.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())))
        return out

    at_hand = rows
    for (name, stage), plain in zip(cp.STAGES, [told, plain_lines, plain_near, lambda x: plain_clean(x, items), coded], strict=True):
        # Each stage on all documents, where it has most to do, and then on what the ones before it left.
        for given in (rows, at_hand):
            df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in given], docs.schema)
            got = stage(spark, df if given is not rows else docs, SF)
            columns = ["doc_id", "text"] if name != "bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            want = plain(given)
            assert Counter(map(tuple, got.select(columns).collect())) == Counter(want), name
            if name == "line_dedup":
                assert all(r["n_chars"] == len(r["text"] or "") for r in got.collect())
        assert name in ("language_id", "bpe") or plain(rows) != rows  # else nothing is tested
        at_hand = want
    assert Counter(tuple(r)[:4] for r in cp.run(spark, SF).collect()) == Counter(at_hand)
