"""Language ID, words first: known words score by per-language log frequency, others by ever shorter n-grams.

Training counts every word of every training document in Spark (partial counts leave the Python workers and are
summed by Spark), then the character n-grams of all distinct words.  The model knows a word, or an n-gram, that makes
up at least ``share`` of the words, or of the n-grams of that length, of any one language: so each language brings
1 / ``share`` entries of a kind at most, however large the corpus and however rare the language's texts.  A word that
is not known backs off to its 4-grams; if none is known to its 3-grams, and so on down to letters.

A word is a run of letters, in lower case.  N-grams are kept as 64-bit hashes.

Defined cases: null text or text without a letter: ``und``, score 0; nothing learned: ``und`` for all; equal
scores: the alphabetically first language; null lang rows are never learned from; words of any length are used
whole; extra columns are kept, but for those named ``lang_pred`` or ``score``, which are replaced; each row gives one
row, repeated rows too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from palisade.llm.common import lean, parts, settle, table
from palisade.llm.dartminhash import mix
from palisade.llm.wordtable import coded_words

MAX_GRAM = 4
SHARE = 2e-6
SMOOTH = 0.5
#: Bytes of text looked at at once, and words whose n-grams are counted at once.
PART, WORDS = 16 << 20, 100_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words by number, ends of the texts among them, distinct words)."""
    return coded_words(pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")))


class Grams:
    """Hashes of the n-grams of words, which are marked at both ends but for single letters."""

    def __init__(self, words: pa.Array):
        self.points = np.frombuffer("".join(f"^{w}$" for w in words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        self.word = np.repeat(np.arange(len(words)), sizes)
        self.inner = np.ones(len(self.points), bool)
        ends = np.cumsum(sizes)
        self.inner[ends - 1] = self.inner[ends - sizes] = False

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, words by number) of all n-grams."""
        m = max(0, len(self.points) - n + 1)
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = mix(h ^ self.points[j : j + m])
        inside = self.inner[:m] if n == 1 else self.word[:m] == self.word[n - 1 : n - 1 + m]
        return h[inside], self.word[:m][inside]


def _summed(columns: dict[str, pa.Array | np.ndarray], by: list[str]) -> pa.Table:
    got = pa.table(columns).group_by(by, use_threads=False).aggregate([("n", "sum")])
    return got.select([*by, "n_sum"]).rename_columns([*by, "n"])


@lean
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, z in parts(b["text"], PART):
            codes, ends, kinds = words_of(b["text"].slice(a, z - a))
            langs = b["lang"].slice(a, z - a).dictionary_encode()
            count = len(langs.dictionary)
            of = np.repeat(langs.indices.to_numpy(), np.diff(np.concatenate([[0], ends])))
            times = np.bincount(codes.astype(np.int64) * count + of, minlength=len(kinds) * count)
            met = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(met % count)), kinds.take(pa.array(met // count)), pa.array(times[met], pa.int64())], ["lang", "key", "n"])


@lean
def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        if not t.num_rows:
            return
        lang, key, n = (pa.concat_arrays(t[c].chunks) for c in ("lang", "key", "n"))
        grams, langs, n = Grams(key), lang.dictionary_encode(), n.to_numpy()
        for size in range(1, MAX_GRAM + 1):
            h, word = grams.of(size)
            got = _summed({"lang": langs.indices.to_numpy()[word], "key": h.view(np.int64), "n": n[word]}, ["lang", "key"])
            sizes = pa.array(np.full(got.num_rows, size), pa.int32())
            yield from pa.table([langs.dictionary.take(got["lang"].combine_chunks()), sizes, got["key"], got["n"]], ["lang", "size", "key", "n"]).combine_chunks().to_batches()

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= WORDS:
            yield from out()
    if held:
        yield from out()


def _known(counts: DataFrame, by: list[str], totals: dict, share: float) -> pa.Table:
    """The keys (``by``) that make up ``share`` of a language's total, with their counts by language."""
    if not totals:
        return pa.table({c: pa.array([]) for c in (*by, "langs", "ns")})
    total = F.create_map(*(F.lit(x) for kv in totals.items() for x in kv))[F.concat_ws("\0", *(c for c in ("lang", *by) if c != "key"))]
    by_key = counts.groupBy(*by).agg(F.max(F.col("n") / total).alias("most"), F.collect_list("lang").alias("langs"), F.collect_list("n").alias("ns"))
    return by_key.where(F.col("most") >= share).drop("most").orderBy(*by).toArrow()


class Model:
    """``langs`` in order; known words, and hashes of n-grams by length, each with log frequencies by language."""

    def __init__(self, langs: list[str], words: list[tuple[str, dict]], grams: dict[int, list[tuple[int, dict]]], totals: dict[str, int], sums: dict[int, dict[str, int]]):
        self.langs = langs
        self.words = pa.array([w for w, _ in words], pa.string())
        self.logs = self._logs([c for _, c in words], totals)
        self.grams, self.gram_logs = {}, {}
        for n in range(1, MAX_GRAM + 1):
            keys = np.array([k for k, _ in grams.get(n, [])], np.int64).view(np.uint64)
            by = np.argsort(keys)
            self.grams[n], self.gram_logs[n] = keys[by], self._logs([c for _, c in grams.get(n, [])], sums.get(n, {}))[by]

    def _logs(self, counts: list[dict], totals: dict[str, int]) -> np.ndarray:
        held = np.array([[c.get(x, 0) for x in self.langs] for c in counts], float).reshape(len(counts), len(self.langs))
        whole = np.array([totals.get(x, 0) for x in self.langs], float)
        return np.log((held + SMOOTH) / (whole + SMOOTH * (len(counts) + 1))).astype(np.float32)

    def backoff(self, words: pa.Array) -> np.ndarray:
        """(words, languages): the mean of the longest n-grams known of each word; 0 if none is."""
        out, todo = np.zeros((len(words), len(self.langs))), np.arange(len(words))
        grams = Grams(words)
        for n in range(MAX_GRAM, 0, -1):
            if not len(self.grams[n]) or not len(todo):
                continue
            h, word = grams.of(n)
            wanted = np.zeros(len(words), bool)
            wanted[todo] = True
            h, word = h[wanted[word]], word[wanted[word]]
            at = np.minimum(np.searchsorted(self.grams[n], h), len(self.grams[n]) - 1)
            known = self.grams[n][at] == h
            at, word = at[known], word[known]
            times = np.bincount(word, minlength=len(words))
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(word, self.gram_logs[n][at, k], minlength=len(words)) / np.maximum(times, 1)
            todo = todo[times[todo] == 0]
        return out

    def scores(self, kinds: pa.Array) -> np.ndarray:
        """(words, languages) of distinct words."""
        at = pc.fill_null(pc.index_in(kinds, value_set=self.words), -1).to_numpy().astype(np.int64)
        out = np.zeros((len(kinds), len(self.langs)))
        out[at >= 0] = self.logs[at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        for k in range(0, len(rest), WORDS):
            out[rest[k : k + WORDS]] = self.backoff(kinds.take(pa.array(rest[k : k + WORDS])))
        return out


def train(labelled: DataFrame, share: float = SHARE) -> Model:
    """labelled: (text, lang).  Every row counts."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    words = settle(rows.mapInArrow(_word_counts, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    grams = settle(words.mapInArrow(_gram_counts, "lang string, size int, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n")))
    sums = {(r["lang"], r["size"]): r["n"] for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    known = _known(words, ["key"], totals, share).to_pylist()
    parts_known = _known(grams, ["size", "key"], {f"{x}\0{n}": v for (x, n), v in sums.items()}, share).to_pylist()
    by_size: dict[int, list] = {}
    for r in parts_known:
        by_size.setdefault(r["size"], []).append((r["key"], dict(zip(r["langs"], r["ns"], strict=True))))
    by_lang = {n: {x: v for (x, m), v in sums.items() if m == n} for n in range(1, MAX_GRAM + 1)}
    return Model(sorted(totals), [(r["key"], dict(zip(r["langs"], r["ns"], strict=True))) for r in known], by_size, totals, by_lang)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text``, then ``lang_pred`` and ``score`` (the winner's posterior, by at most 20 words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*(c for c in ("lang_pred", "score") if c != text))
    kept = [c for c in docs.columns if c != text]
    schema = StructType([*(f for f in docs.schema if f.name != text), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = pa.array([*m.langs, "und"], pa.string())
        for b in batches:
            for a, z in parts(b[text], PART):
                texts = pc.fill_null(b[text].slice(a, z - a), "")
                codes, ends, kinds = words_of(texts)
                best, score = np.full(len(texts), len(m.langs)), np.zeros(len(texts))
                sizes = np.diff(np.concatenate([[0], ends]))
                told = np.flatnonzero(sizes) if m.langs else np.zeros(0, np.int64)
                if len(told):
                    of, starts = m.scores(kinds), (ends - sizes)[told]
                    total = np.stack([np.add.reduceat(of[:, k][codes], starts) for k in range(len(m.langs))], axis=1)
                    best[told] = total.argmax(axis=1)
                    odds = np.exp((total - total.max(axis=1, keepdims=True)) * np.minimum(1.0, 20 / sizes[told])[:, None])
                    score[told] = 1 / odds.sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(b[c].slice(a, z - a) for c in kept), langs.take(pa.array(best)), pa.array(score)], [*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """A null doc_id is held out: nothing says that it may be learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(True))


def fit_on_documents(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()).select("text", "lang"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), fit_on_documents(docs))
