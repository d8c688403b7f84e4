"""License scan: an exact set-similarity join of text blocks with license templates, and phrase places.

Built-in DataFrame functions only.  A block matches a template if it holds at least ``threshold`` of the template's
distinct words.  Blocks are single lines, and all windows of as many words as the template has over the whole text, so
that a notice may wrap over lines.  One pass keeps the texts that hold enough of a template's words as plain parts, with
their template words, and settles them; over these it is counted how many texts hold each word (the global frequency
order, rarest first), and their words in that order are joined with the templates' prefixes (the first |T| - need + 1
words: any match must share one).  The length filter drops texts with fewer than
``need`` template words, the positional filter drops shared words after which too few words are left on either side,
and the rest is verified by the full intersection, of the text and then of its blocks.  Template lists are bounded
(``MAX_TEMPLATES``), so prefixes are broadcast.

Defined cases: null text is empty; empty and letterless texts give 0 words and no label; a null doc_id is kept as
its own row; repeated rows each give a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import ascii_lower, settle, table, text_hash

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label -> notice, as commonly published.
TEMPLATES = {
    "agpl-3": "licensed under the gnu affero general public license version 3",
    "apache-2": "licensed under the apache license version 2.0",
    "bsd-3": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc-4": "licensed under cc by-nc 4.0",
    "cc-by-sa-4": "licensed under cc by-sa 4.0",
    "cc0": "no copyright this work has been dedicated to the public domain under cc0",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-3": "licensed under the gnu lesser general public license version 3",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.8
MAX_TEMPLATES = 2_000
#: So many words of templates are looked for as plain parts of a text before it is split into words.
MAX_PARTS = 250


def words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0))


def _once(c: Column) -> Column:
    """``c``, which Spark then neither computes again in a filter below nor merges into its users."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    import re

    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates; scan longer lists in parts")
    found = {label: sorted(set(re.findall(WORDS, text.lower()))) for label, text in templates.items()}
    return {label: ws for label, ws in found.items() if ws}


def _need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _ranked(blocks: DataFrame, named: dict[str, list[str]], threshold: float) -> tuple[list[str], list[tuple]]:
    """The words of ``blocks.ws`` and of the templates, rarest first; the templates' prefixes in that order."""
    counts = {r["w"]: r["n"] for r in blocks.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    order = sorted({w for ws in named.values() for w in ws}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for label, ws in named.items():
        ordered, need = sorted(ws, key=rank.__getitem__), _need(len(ws), threshold)
        prefixes += [(w, label, ordered, i, len(ws), need) for i, w in enumerate(ordered[: len(ws) - need + 1])]
    return order, prefixes


def _met(blocks: DataFrame, order: list[str], prefixes: list[tuple]) -> DataFrame:
    """Each row of ``blocks`` with each template whose words ``ws`` holds: label, tws, size, need, shared."""
    prefix = blocks.sparkSession.createDataFrame(prefixes, "w string, label string, tws array<string>, at int, size int, need int")
    least = min((p[5] for p in prefixes), default=1)
    # Array_intersect keeps the order of its first argument: here, the global order.
    ordered = blocks.where(F.size("ws") >= least).withColumn("ws", F.array_intersect(_strings(order), "ws"))
    return (
        ordered.select("*", F.size("ws").alias("held"), F.posexplode("ws").alias("pos", "w"))
        .join(F.broadcast(prefix), "w")
        .where(F.col("held") >= F.col("need"))
        .where(1 + F.least(F.col("size") - F.col("at") - 1, F.col("held") - F.col("pos") - 1) >= F.col("need"))
        .withColumn("both", F.array_intersect("ws", "tws"))
        .where((F.size("both") >= F.col("need")) & (F.get("both", F.lit(0)) == F.col("w")))  # at the first shared word only
        .withColumn("shared", F.size("both"))
    )


def similar_blocks(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, block, label, containment): every line that meets a template."""
    named = template_words(TEMPLATES if templates is None else templates)
    vocabulary = _strings(sorted({w for ws in named.values() for w in ws}))
    lines = docs.select("doc_id", text_hash().alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block", "line"))
    blocks = lines.select("doc_id", "text_hash", "block", _once(F.array_intersect(words(ascii_lower(F.col("line"))), vocabulary)).alias("ws"))
    hits = _met(blocks, *_ranked(blocks, named, threshold))
    return hits.select("doc_id", "text_hash", "block", "label", (F.col("shared") / F.col("size")).alias("containment")).distinct()


def _parts(ws: list[str], threshold: float) -> Column:
    """Whether ``low`` has as many of a template's words as a match needs, as plain parts.

    A match lacks fewer words than the longest ``len(ws) - need + 1``, so one of these is looked for first.
    """
    has = lambda w: F.contains("low", F.lit(w))
    need, longest = _need(len(ws), threshold), sorted(ws, key=lambda w: (-len(w), w))
    first = longest[: len(ws) - need + 1]
    return reduce(or_, map(has, first)) & (reduce(add, (has(w).cast("int") for w in longest)) >= need)


def similar_places(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, label, places): where a line, or a window of the template's length, meets a template.

    A place (start, end, dense, containment) reaches from the first to the last word needed; it is dense if it is no
    longer than the template.
    """
    import re

    templates = TEMPLATES if templates is None else templates
    named = template_words(templates)
    vocabulary = _strings(sorted({w for ws in named.values() for w in ws}))
    low = docs.select("doc_id", text_hash().alias("text_hash"), _once(ascii_lower(F.coalesce("text", F.lit("")))).alias("low"))
    held = _once(F.array_intersect(words(F.col("low")), vocabulary)).alias("ws")
    if 0 < sum(map(len, named.values())) <= MAX_PARTS:  # a text without ``need`` of a template's words as parts does not meet it
        found = low.where(reduce(or_, (_parts(ws, threshold) for ws in named.values()))).select("*", held)
        found = settle(found.where(F.size("ws") >= min(_need(len(ws), threshold) for ws in named.values())))
    else:
        found = low.select("*", held)
    order, prefixes = _ranked(found, named, threshold)
    lengths = F.create_map(*(F.lit(x) for label in named for x in (label, len(re.findall(WORDS, templates[label].lower()))))) if named else F.create_map().cast("map<string,int>")
    hits = _met(found, order, prefixes).select("doc_id", "text_hash", "low", "label", "tws", "size", "need", lengths[F.col("label")].alias("span"))
    tokens = F.flatten(F.transform(F.split("low", "\n"), lambda line, i: F.transform(words(line), lambda w: F.struct(i.alias("block"), w.alias("w")))))
    hits = hits.select("*", _once(F.transform(tokens, lambda t, p: F.struct(p.alias("p"), t["block"].alias("block"), t["w"].alias("w")))).alias("all"))
    hits = hits.select("*", _once(F.filter("all", lambda x: F.array_contains("tws", x["w"]))).alias("mine")).drop("all", "low")
    block = lambda i: F.get("mine", i)["block"]
    first = F.filter(F.transform("mine", lambda _, i: i), lambda i: (i == 0) | (block(i) != block(i - 1)))
    hits = hits.select("*", _once(first).alias("first"))
    lines = F.transform("first", lambda s, k: F.slice("mine", s + 1, F.coalesce(F.get("first", k + 1), F.size("mine")) - s))
    windows = F.transform("mine", lambda m, i: F.filter(F.slice("mine", i + 1, F.col("span")), lambda x: x["p"] < m["p"] + F.col("span")))
    met = F.filter(F.transform(F.concat(lines, windows), lambda v: F.struct(v.alias("v"), F.array_distinct(v["w"]).alias("d"))), lambda x: F.size(x["d"]) >= F.col("need"))
    hits = hits.select("doc_id", "text_hash", "label", "size", "span", _once(met).alias("met"))
    # The end is the last of the words' first places, the start is then the first of their last places.
    at = lambda x, u: F.get(x["v"]["p"], (F.array_position(x["v"]["w"], u) - 1).cast("int"))
    ended = F.transform("met", lambda x: F.struct(x["v"].alias("v"), x["d"].alias("d"), F.array_max(F.transform(x["d"], lambda u: at(x, u))).alias("end")))
    hits = hits.select("doc_id", "text_hash", "label", "size", "span", _once(ended).alias("met"))

    def place(x: Column) -> Column:
        lasts = F.transform(x["d"], lambda u: F.array_max(F.filter(x["v"], lambda y: (y["w"] == u) & (y["p"] <= x["end"]))["p"]))
        start = F.array_min(lasts)
        return F.struct(start.alias("start"), x["end"].alias("end"), (x["end"] - start < F.col("span")).alias("dense"), (F.size(x["d"]) / F.col("size")).alias("containment"))

    hits = hits.select("doc_id", "text_hash", "label", F.explode(F.array_distinct(F.transform("met", place))).alias("place"))
    return hits.groupBy("doc_id", "text_hash", "label").agg(F.collect_set("place").alias("places"))


def _places(w: Column, phrase: list[str]) -> Column:
    """Starts of ``phrase`` in the word array ``w``."""
    last = F.size(w) - len(phrase)

    def here(i: Column) -> Column:
        out = F.get(w, i) == phrase[0]
        for k in range(1, len(phrase)):
            out = out & (F.get(w, i + k) == phrase[k])
        return out

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: the contract columns of ``op1_license_scan``.

    Every template that is met gives its label, unless each of its places lies in a dense one of a closer template.
    """
    phrases = PHRASES if phrases is None else phrases
    docs = docs.select("doc_id", "text")
    lowered = ascii_lower(F.coalesce("text", F.lit("")))
    split = {p: p.split() for p in phrases}
    maybe = F.lit(False)
    for ws in split.values():
        here = F.lit(True)
        for w in ws:
            here = here & F.contains(F.col("low"), F.lit(w))
        maybe = maybe | here
    base = docs.select("doc_id", text_hash().alias("text_hash"), lowered.alias("low")).select("doc_id", "text_hash", words(F.col("low")).alias("w"), maybe.alias("maybe"))
    none = F.array().cast("array<int>")
    for k, ws in enumerate(split.values()):
        base = base.withColumn(f"at{k}", F.when(F.col("maybe"), _places(F.col("w"), ws)).otherwise(none))
    places = F.concat(*(F.col(f"at{k}") for k in range(len(split)))) if split else none
    named = F.array(*(F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values()))).cast("array<string>")
    base = base.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), places.alias("places"), F.sort_array(F.array_distinct(F.array_compact(named))).alias("named"))
    hits = similar_places(docs, templates, threshold).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("label", "places")).alias("hits"))
    hits = hits.select("*", F.array_distinct(F.flatten("hits.places")).alias("all"))
    covers = lambda q, p: q["dense"] & (q["containment"] > p["containment"]) & (q["start"] <= p["start"]) & (q["end"] >= p["end"])
    stays = F.filter("hits", lambda h: F.exists(h["places"], lambda p: ~F.exists("all", lambda q: covers(q, p))))
    found = hits.select("doc_id", "text_hash", stays["label"].alias("more"), F.array_max(F.col("all")["containment"]).alias("best"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "more", "best")
    both = base.join(found, base["doc_id"].eqNullSafe(found["d"]) & (base["text_hash"] == found["t"]), "left")
    return both.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("named", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("named", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("named") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', {ws!r}, {_need(len(ws), THRESHOLD)})" for label, ws in template_words(TEMPLATES).items())
    return f"""
WITH low AS (SELECT doc_id, {low} AS t FROM documents),
ws AS (SELECT doc_id, regexp_extract_all(t, '{WORDS}') AS w FROM low),
phrases(p, label) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: list_slice(w, i + 1, i + len(p)) = p)) AS place
  FROM ws, phrases WHERE list_has_all(w, p)),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS ls FROM places GROUP BY doc_id),
templates(label, tw, need) AS (VALUES {templates}),
blocks AS (
  SELECT doc_id, unnest(range(0, len(string_split(t, chr(10))))) AS block,
    list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{WORDS}')) AS b FROM low),
hits AS (
  SELECT doc_id, block, label, len(list_intersect(b, tw)) / len(tw)::DOUBLE AS c FROM blocks, templates
  WHERE len(b) >= need AND len(list_intersect(b, tw)) >= need),
closest AS (SELECT * FROM hits QUALIFY c = max(c) OVER (PARTITION BY doc_id, block)),
more AS (SELECT doc_id, list(DISTINCT label) AS ls, max(c) AS c FROM closest GROUP BY doc_id)
SELECT ws.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(base.ls, []) || coalesce(more.ls, []))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.c, 0.0)::DOUBLE END AS score
FROM ws LEFT JOIN base ON ws.doc_id = base.doc_id LEFT JOIN more ON ws.doc_id = more.doc_id
"""


SQL = _sql()
