"""License scan, decontamination, page text, language ID, tokens and media."""

import hashlib
import html as entities
import random
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from palisade.llm import bpe, decontaminate, langid, licenses, media, pages, tokencounts, wordtable

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(map(tuple, df.collect()))


# License scan.


def test_license_scan(spark):
    docs = [
        (1, "x\nThis work is licensed under the GNU General Public License, version 3."), (2, "GNU-General public\nLICENSE; apache license cc by mit license"), (3, None), (4, ""), (None, "mit license"), (5, "mit license"), (5, "mit license"),
        (6, "Licensed under CC BY-NC 4.0."), (7, "gnu general publicé license"), (8, "under the license released by mit, more words than needed here"),
    ]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'a' AS w", "'b' AS labels", "'c' AS low")
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.license_scan(df).collect()}
    assert len(licenses.license_scan(df).collect()) == len(docs)
    one = got[1, 13]
    assert (one["n_base"], one["first_word"], one["last_word"], one["base_labels"], one["labels"], one["score"]) == (1, 7, 7, "gpl", "gpl,gpl-3", 1.0)
    two = got[2, 10]
    assert (two["n_base"], two["first_word"], two["last_word"], two["base_labels"]) == (4, 0, 8, "apache,cc-by,gpl,mit")
    assert (got[3, 0]["n_base"], got[3, 0]["first_word"], got[3, 0]["labels"], got[3, 0]["score"]) == (0, None, "", 0.0)
    assert got[6, 7]["labels"] == "cc-by,cc-by-nc-4" and got[7, 4]["base_labels"] == "" and got[8, 11]["base_labels"] == ""
    assert licenses.license_scan(df.limit(0)).collect() == []


def test_similar_blocks_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(25)]
    templates = {f"t{i}": " ".join(r.sample(vocabulary, r.randint(1, 8))) for i in range(12)}
    docs = [(i, "\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 14))) for _ in range(3))) for i in range(80)]
    for threshold in (0.5, 0.8, 1.0):
        want = set()
        for d, t in docs:
            for k, line in enumerate(t.split("\n")):
                for label, text in templates.items():
                    a, b = set(text.split()), set(line.split())
                    if len(a & b) >= threshold * len(a) - 1e-9:
                        want.add((d, k, label, len(a & b) / len(a)))
        got = licenses.similar_blocks(spark.createDataFrame(docs, DOCS), templates, threshold)
        assert {(x["doc_id"], x["block"], x["label"], x["containment"]) for x in got.collect()} == want


def test_wrapped_notices(spark):
    isc = "Permission to use, copy, modify, and/or distribute\nthis software for any purpose with or without fee\nis hereby granted, provided"
    mit = "x\n * Permission is hereby granted, free of\n * charge, to any person obtaining a copy\n * of this software and associated documentation\n * files (the"
    far = "permission to use copy modify\n" + "other words are between these here and there\n" * 9 + "and or distribute this software for any purpose with or without fee"
    docs = [(1, isc), (2, mit), (3, far), (4, isc.replace("\n", " ")), (5, isc + "\n" + mit), (5, isc + "\n" + mit)]
    got = Counter((r["doc_id"], r["labels"]) for r in licenses.license_scan(spark.createDataFrame(docs, DOCS)).collect())
    assert got == {(1, "isc"): 1, (2, "mit-text"): 1, (3, ""): 1, (4, "isc"): 1, (5, "isc,mit-text"): 2}


def test_all_notices_of_a_block(spark):
    both = "Licensed under CC BY-NC 4.0; code released under MIT license."
    docs = [(1, both), (2, "released under the MIT license; elsewhere licensed under the GNU Affero General Public License version 3"), (3, "Licensed under CC BY-NC 4.0."), (4, f"{both} Licensed under CC BY-SA 4.0.")]
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1] == "cc-by,cc-by-nc-4,mit,mit-notice" and got[2] == "agpl-3,mit,mit-notice"
    assert got[3] == "cc-by,cc-by-nc-4" and got[4] == "cc-by,cc-by-nc-4,cc-by-sa-4,mit,mit-notice"


def test_similar_places_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(25)]
    templates = {f"t{i}": " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 8))) for i in range(12)}
    docs = [(i, "\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 9))) for _ in range(4))) for i in range(60)]
    for threshold in (0.5, 0.8):
        want = {}
        for d, t in docs:
            for label, text in templates.items():
                a, n, ws = set(text.split()), len(text.split()), t.split()
                blocks = [x.split() for x in t.split("\n")] + [ws[i : i + n] for i in range(len(ws))]
                most = max(len(a & set(b)) for b in blocks)
                if most >= threshold * len(a) - 1e-9:
                    want[d, label] = most / len(a)
        got = {(x["doc_id"], x["label"]): x["places"] for x in licenses.similar_places(spark.createDataFrame(docs, DOCS), templates, threshold).collect()}
        assert {k: max(p["containment"] for p in v) for k, v in got.items()} == want
        for (d, label), places in got.items():
            ws, a = dict(docs)[d].split(), set(templates[label].split())
            assert all(len(a & set(ws[p["start"] : p["end"] + 1])) == round(p["containment"] * len(a)) and {ws[p["start"]], ws[p["end"]]} <= a for p in places)


# Decontamination.


def edit_distance_to_part(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, e in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != e)))
        prev = cur
    return min(prev)


def test_matcher_equals_edit_distance():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    for _ in range(150):
        item = " ".join(word() for _ in range(r.randint(1, 12)))
        text = [word() for _ in range(20)]
        broken = list(item)
        for _ in range(r.randint(0, 8)):
            k, what = r.randrange(len(broken) or 1), r.random()
            if what < 0.4 and broken:
                broken[k] = r.choice("abcxyz")
            elif what < 0.7:
                broken.insert(k, r.choice("abcxyz"))
            elif len(broken) > 1:
                del broken[k]
        doc = " ".join([*text[:10], "".join(broken), *text[10:]])
        n, t = decontaminate.normal(item), decontaminate.normal(doc)
        k = min(int(0.1 * len(n) + 1e-9), len(n) - 1)
        d = edit_distance_to_part(n, t) if k else 0 if f" {n} " in f" {t} " else len(n)  # too short for an edit: whole words
        got = list(decontaminate.Matcher([(1, item)], 0.1).find(doc))
        assert [(x[1], x[2]) for x in got] == ([(d, k)] if d <= k else []), (item, doc)


def test_contaminated(spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, None), (3, "!!"), (4, "")], "item_id long, text string")
    docs = [(1, "Prefix. THE QUICK brown-fox jumps over\nthe lazy dog near the river bank!"), (2, "the quick brown fox jumps over the lazy cat near the rivr bank"), (3, "nothing"), (4, None), (None, "the quick brown fox jumps over the lazy dog near the river bank"), (1, "clean")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS item_id", "'s' AS source")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(1, 1, 0), (2, 1, 4), (None, 1, 0)}
    kept = decontaminate.clean(df, items)
    assert kept.columns == df.columns and Counter(r["text"] for r in kept.collect()) == Counter(["nothing", None, "clean"])
    assert decontaminate.contaminated(df, items.limit(0)).collect() == [] and decontaminate.clean(df, items.limit(0)).count() == len(docs)
    assert decontaminate.contaminated(df.limit(0), items).collect() == []


@pytest.mark.parametrize(("name", "most"), [("BLOCK_ITEMS", 3), ("BLOCK_BYTES", 200)])
def test_items_in_blocks(spark, monkeypatch, name, most):
    monkeypatch.setattr(decontaminate, name, most)
    items = spark.createDataFrame([(i, f"item number {i} has its own quite long sentence {i * 7919} here") for i in range(10)], "item_id long, text string")
    assert len(list(decontaminate.item_blocks(items))) > 3
    docs = spark.createDataFrame([(i, f"before item number {i} has its own quite long sentence {i * 7919} here after") for i in range(10)], DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).where("distance = 0").collect()}
    assert got == {(i, i) for i in range(10)} and decontaminate.clean(docs, items).count() == 0


# Pages.


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<b>b</b>c&nbsp;d<br>e<div class='ad'>x</div>", "abc d e"),
        ("<nav>menu</nav><article><h1>T</h1><p>hi &amp; <i>you</i></p><ul><li>one<li>two</ul><div id=comments>c</div><aside>s</aside></article><footer>f</footer>", "T hi & you one two"),
        ("plain &lt;text&#33;", "plain <text!"), ("", ""), (None, ""), ("<script>var a='<p>no</p>'</script><p>yes", "yes"), ("<!-- <p>no</p> --><p>yes</p><style>p{}</style>", "yes"),
        ("<div class='cookie-notice'>n</div><main><p>m</p><form><input>q</form></main>", "m"), ("<p title='a>b'>x</p><p hidden>y</p>", "x"), ("<article class=comment>c</article><article><p>real text</p></article>", "real text"),
        ("<article><p>unclosed <b>bold<p>next", "unclosed bold next"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("a < b and c > d", "a < b and c > d"),
        ("<div class='shadow loading'>kept</div>", "kept"), ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<header><h1>Site</h1></header><article><header><h1>Title <i>of</i> it</h1><p>By Ann</p><nav><h2>menu</h2></nav></header><p>text</p></article>", "Title of it text"),
        ("<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then <label>this</label></p><form><label>Mail</label><input></form></article>", "if x=2 then this"),
        ("<article class='related-post'><p>the article itself</p></article><div>beside</div>", "the article itself"),
        ("<div>The story is told beside its comments.</div><article class='comment'><p>me too</p></article>", "The story is told beside its comments."),
        ("<b>" * 20_000 + "</i>" * 20_000 + "deep", "deep"),
    ],
)
def test_main_text(html, text):
    assert pages.main_text(html) == text


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_template_removal(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pages, "BROADCAST_HASHES", broadcast)
    page = lambda i, h: f"<body><div><p>Welcome to the site</p></div><div><p>Story {h} {i} tells of {i * 7} things.</p></div></body>"
    rows = [(i, f"https://h{i % 2}.example/{i}", page(i, i % 2)) for i in range(24)] + [(100, None, "<p>alone</p>"), (None, "odd", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS hash")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extract(df).collect()}
    want = {i: f"Story {i % 2} {i} tells of {i * 7} things." for i in range(24)} | {100: "alone", None: ""}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert pages.extract(df.limit(0)).collect() == []


def site(r):
    """Pages of one host as trees (tag, children) with an article or without one."""
    pool = [f"{w} of the site number {r.randint(0, 999)}" for w in ("Greeting", "Offer", "Hint", "Terms", "Imprint", "Letter")]
    has, often = r.random() < 0.6, r.choice([0.3, 0.6, 0.95])

    def block(own):
        text = r.choice(pool) if r.random() < 0.5 * often else f"Text {r.randint(0, 99_999)} & more"
        return (r.choice(["p", "div"]), [text]) if own else ("div", [("p", [text])])

    def page():
        inner = [block(True) for _ in range(r.randint(0, 5))]
        first, last = [("p", [pool[0]])] * (r.random() < often), [("div", [("p", [pool[1], ("b", [pool[2]])])])] * (r.random() < often)
        content = [("h1", [f"Title {r.randint(0, 50)}"]), *first, *inner, *last]
        if has and r.random() < 0.3:
            content = [("section", content)]
        around = [block(False) for _ in range(2)]
        return ("body", [around[0], ("article", content), around[1]] if has else [around[0], *content, around[1]])

    made = [page() for _ in range(r.choice([1, 4, 9, 30]))]
    return made + [made[0]] * r.choice([0, 3, 20])


def markup(x):
    return entities.escape(x) if isinstance(x, str) else f"<{x[0]}>" + "".join(map(markup, x[1])) + f"</{x[0]}>"


def plain(x, drop):
    """Text of a tree without the subtrees that ``drop`` takes; a list of its blocks' parts."""
    if isinstance(x, str):
        return x
    if drop(x):
        return " "
    inner = "".join(plain(c, drop) for c in x[1])
    return inner if x[0] == "b" else f" {inner} "


def expected_pages(trees):
    """Texts by counting every subtree of every different article, in plain Python."""
    tops = [next((c for c in t[1] if c[0] == "article"), ("root", [("html", [t])])) for t in trees]

    def subtrees(x):
        return {repr(x)}.union(*(subtrees(c) for c in x[1] if not isinstance(c, str)))

    def ends(top):
        blocks = list(top[1])
        while len(blocks) == 1:
            blocks = [c for c in blocks[0][1] if not isinstance(c, str) and c[0] != "b"]
        blocks = [c for c in blocks if c[0] != "h1"]
        return [] if len(blocks) < 2 else blocks[:2] + blocks[max(2, len(blocks) - 2) :]

    seen, edge = {}, {}
    for t, top in zip(trees, tops, strict=True):
        key = " ".join(plain(top, lambda x: False).split())
        for s in subtrees(t):
            seen.setdefault(s, set()).add(key)
        if top[0] == "article":
            for x in ends(top):
                edge.setdefault(repr(x), set()).add(key)
    n = len({" ".join(plain(top, lambda x: False).split()) for top in tops})
    meets = lambda found, x, least, share: len(found.get(repr(x), ())) >= max(least, share * n)
    out = []
    for top in tops:
        if top[0] == "article":
            at = [id(x) for x in ends(top) if meets(edge, x, 3, 0.5)]
            drop = lambda x, top=top, at=at: x is not top and (id(x) in at or meets(seen, x, 10, 0.8))
        else:
            drop = lambda x: meets(seen, x, 5, 0.3)
        out.append(" ".join(plain(top, drop).split()))
    return out, [" ".join(plain(top, lambda x: False).split()) for top in tops]


def test_templates_equal_brute_force(spark):
    r, rows, want, whole = random.Random(5), [], {}, {}
    for h in range(40):
        trees = site(r)
        texts, full = expected_pages(trees)
        for t, text, f in zip(trees, texts, full, strict=True):
            rows.append((len(rows), f"https://host{h}.example/{len(rows)}", f"<html>{markup(t)}</html>"))
            want[len(want)], whole[len(whole)] = text, f
    assert extracted(spark, rows) == want
    inside = [i for i, (_, _, html) in enumerate(rows) if "<article>" in html]
    assert sum(want[i] != whole[i] for i in inside) > 50 and sum(want[i] != whole[i] for i in want if i not in set(inside)) > 50


def test_article_paragraphs_are_safe(spark):
    same = "<article><h1>News</h1><p>The same paragraph on several pages.</p></article>"
    rows = [(i, "http://h/x", same if i < 8 else f"<article><p>Page {i}</p></article>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "News The same paragraph on several pages." and got[19] == "Page 19"


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_repeated_notice_in_articles(spark):
    page = lambda i: f"<article><h1>News</h1><p>Story {i}.</p><p>More of {i}.</p><p>Said in all.</p><p>And {i}.</p><p>End of {i}.</p><div>Support us with a gift.</div></article>"
    got = extracted(spark, [(i, f"http://h/{i}", page(i)) for i in range(4)] + [(9, "http://other/", page(9))])
    assert all(got[i] == f"News Story {i}. More of {i}. Said in all. And {i}. End of {i}." for i in range(4))
    assert got[9].endswith("Support us with a gift.")


def test_copied_articles_are_kept(spark):
    same = "<article><h1>News</h1><p>First words.</p><p>Second words.</p></article>"
    for url in ("http://h/", None):
        got = extracted(spark, [(i, url and url + str(i), same if i < 18 else f"<article><p>Page {i}</p></article>") for i in range(20)])
        assert got[0] == got[17] == "News First words. Second words." and got[19] == "Page 19"
    bare = extracted(spark, [(i, f"http://h/{i}", "<body><p>First words.</p><p>Second words.</p></body>") for i in range(9)])
    assert set(bare.values()) == {"First words. Second words."}


def test_short_items_are_whole_words(spark):
    items = spark.createDataFrame([(1.5, "Yes"), (2.5, "a b")], "item_id double, text string")
    docs = spark.createDataFrame([(1, "yesterday"), (2, "Well, yes!"), (3, "yes"), (4, "eyes"), (5, "la b a bc"), (6, "x a b")], DOCS)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == {(2, 1.5), (3, 1.5), (6, 2.5)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == {1, 4, 5}


# Language ID.


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    model = langid.fit_on_documents(docs)
    got = langid.predict(docs.select("doc_id", "lang", langid.held_out().alias("held_out"), "text"), model).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_language_id_odd_rows(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund lief in den wald", "de"), (3, None, "en"), (4, "x", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probe = [(1, "the cat"), (2, "hund wald"), (3, None), (4, ""), (5, "123 ???"), (6, "thecat"), (None, "the"), (7, "q" * 100_000), (8, "the cat"), (8, "the cat")]
    got = Counter((r["doc_id"], r["lang_pred"]) for r in langid.predict(spark.createDataFrame(probe, DOCS), model).collect())
    assert got[1, "en"] == 1 and got[2, "de"] == 1 and got[6, "en"] == 1 and got[None, "en"] == 1 and got[8, "en"] == 2
    assert [k for k in got if k[1] == "und"] == [(3, "und"), (4, "und"), (5, "und")] or {k for k in got if k[1] == "und"} == {(3, "und"), (4, "und"), (5, "und")}
    nothing = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict(spark.createDataFrame(probe, DOCS), nothing).collect()} == {"und"}


def test_backoff_goes_to_shorter_grams():
    import pyarrow as pa

    key = lambda g: int(langid.Grams(pa.array([g])).of(len(g))[0].view("int64")[1 if len(g) > 1 else 0])  # noqa: E731  the inner one
    m = langid.Model(["a", "b"], [("word", {"a": 3})], {2: [(key("zz"), {"b": 5})], 1: [(key("q"), {"a": 2})]}, {"a": 3, "b": 1}, {2: {"b": 5}, 1: {"a": 2}})
    got = m.scores(pa.array(["xzzx", "q1", "k", "word", "zzzz"]))
    assert got[0].tolist() == m.gram_logs[2][0].tolist() == got[4].tolist() and got[1].tolist() == m.gram_logs[1][0].tolist() and got[2].tolist() == [0, 0] and got[3].tolist() == m.logs[0].tolist()


def test_language_id_equals_plain_python(spark):
    """Counts, cut, back-off and posterior against a plain computation."""
    import math
    import re

    r = random.Random(8)
    vocabulary = {x: ["".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(60)] for x, letters in (("aa", "abcdeé"), ("bb", "cdefgß"), ("cc", "aeiouxß"))}
    text = lambda x, k: " ".join(r.choice(vocabulary[x]) for _ in range(k)) + r.choice(["", ". 12 X", "_y!"])
    rows = [(i, text(x, r.randint(1, 30)), x) for i in range(90) for x in [r.choice("aa bb cc".split())]] + [(100, None, "aa"), (101, "abc", None)]
    probe = [(i, " ".join(text(r.choice("aa bb cc".split()), r.randint(0, 4)) for _ in range(2))) for i in range(80)] + [(200, None), (201, "7 _"), (202, "zzzz"), (203, "a" * 3000)]
    share = 0.004
    find = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    langs = ["aa", "bb", "cc"]
    words = {x: Counter(w for _, t, y in rows if t and y == x for w in find(t)) for x in langs}
    grams_of = lambda w, n: [w] if n == 0 else [v[i : i + n] for v in [f"^{w}$" if n > 1 else w] for i in range(len(v) - n + 1)]
    tables = []
    for n in (0, 4, 3, 2, 1):
        c = {x: Counter() for x in langs}
        for x in langs:
            for w, k in words[x].items():
                for g in grams_of(w, n):
                    c[x][g] += k
        total = {x: sum(c[x].values()) for x in langs}
        kept = {g for x in langs for g, k in c[x].items() if k / total[x] >= share}
        tables.append((n, {g: [math.log((c[x][g] + 0.5) / (total[x] + 0.5 * (len(kept) + 1))) for x in langs] for g in kept}))

    def score(w):
        for n, t in tables:
            if known := [t[g] for g in grams_of(w, n) if g in t]:
                return [sum(v) / len(known) for v in zip(*known, strict=True)]
        return [0.0] * 3

    want = {}
    for d, t in probe:
        ws = find(t or "")
        total = [sum(v) for v in zip(*map(score, ws), strict=True)] if ws else []
        want[d] = (langs[total.index(max(total))], 1 / sum(math.exp((v - max(total)) * min(1, 20 / len(ws))) for v in total)) if ws else ("und", 0.0)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), share)
    assert any(w not in tables[0][1] for d, t in probe for w in find(t or ""))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(probe, DOCS).selectExpr("*", "9 AS score", "'q' AS lang_pred"), model).collect()}
    assert {d: g[0] for d, g in got.items()} == {d: w[0] for d, w in want.items()}
    assert all(abs(got[d][1] - want[d][1]) < 1e-4 for d in want)


# Tokens.


def odd_texts():
    r = random.Random(2)
    pool = [chr(i) for i in [*range(0, 0x250), *range(0x300, 0x400), 0x1680, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x1E9E, 0x130]] + ["'s", "'re", " ", " ", "<|endoftext|>"]
    return ["", " ", "It's  <|endoftext|>Hello\x00\x1c\x85\xa0 İstanbul ΑΣΣ don't I'LL 12½", "<|startoftext|>", "한" * 3, "a" * 3000] + ["".join(r.choice(pool) for _ in range(r.randint(1, 40))) for _ in range(300)]


@pytest.mark.parametrize("block", [500, wordtable.BLOCK])
def test_bpe_equals_the_library(spark, block):
    content = bpe.read_tokenizer()
    t = Tokenizer.from_str(content)
    texts = [*odd_texts(), None]
    docs = [*enumerate(texts), (0, ""), (2, texts[2]), (2, texts[4]), (None, texts[2]), (None, texts[3]), (None, texts[2]), (9, None)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS word", "1 AS pos", "2 AS ids")
    encoded = bpe.encode(df, content, block)
    want = []
    for d, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(bpe.digests(df, content, block=block)) == Counter(want)
    if block == 500:
        assert {r["decoded"] for r in bpe.decode(encoded, content).collect()} == {t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, x in docs}
        assert bpe.encode(df.limit(0), content).collect() == []


def test_words_end_where_the_library_splits():
    import pyarrow as pa

    t = Tokenizer.from_str(bpe.read_tokenizer())
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    pairs = [f"a{c}b" for c in chars]
    plain, slow = (wordtable.split(pa.array(x), False).to_pylist()[: len(pairs)] for x in (pairs, [*pairs, "\x1c"]))
    assert {c for c, w in zip(chars, slow) if w == ["a", "b"]} == {c for c, p in zip(chars, pairs) if t.normalizer.normalize_str(p) == "a b"}
    assert plain == slow
    assert {c for c, w in zip(chars, wordtable.split(pa.array(pairs), True).to_pylist()) if len(w) == 2} == {c for c in chars if c.isspace()}
    assert wordtable.split(pa.array(["a\x1cb c", None and ""]).fill_null(""), False).to_pylist() == [["a\x1cb", "c"], [""]]


def best_count(word, scores, byte):
    """Plain Viterbi."""
    best = [(0, 0)]
    for j in range(1, len(word) + 1):
        n = len(word[j - 1].encode())
        best.append(max([(best[j - 1][0] + n * byte, best[j - 1][1] - n)] + [(best[i][0] + scores[word[i:j]], best[i][1] - 1) for i in range(j) if word[i:j] in scores]))
    return -best[-1][1]


@pytest.mark.parametrize("block", [40, wordtable.BLOCK])
def test_token_counts(spark, block):
    pieces = tokencounts.read_pieces()
    scores, byte = tokencounts.zipf(pieces)
    docs = [(1, "The cat  sat\non the mat"), (2, None), (3, " \t "), (4, "unbelievable 北京 🙂 xyz"), (4, "unbelievable 北京 🙂 xyz"), (4, "other text"), (None, "the the the"), (None, "unbelievable xyz"), (None, "unbelievable xyz"), (6, "a\x1cb\x85c\u2003d\u3000e"), (5, "ab" * 500)]
    want = [(d, len((t or "").split()), sum(best_count("▁" + w, scores, byte) for w in (t or "").split())) for d, t in docs]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS word", "1 AS times")
    assert rows_of(tokencounts.token_counts(df, pieces, block)) == Counter(want)


def test_trie_shares_prefixes():
    scores, byte = tokencounts.zipf(["a", "ab", "abc", "b", "c"])
    trie = tokencounts.Trie(scores, byte)
    words = ["ab", "abc", "abcab", "abd", "b"]
    assert [trie.count(w) for w in words] == [best_count(w, scores, byte) for w in words]
    assert trie.computed == 2 + 1 + 2 + 1 + 1


# Media.


def test_pdfs_one_after_another():
    one = b"%PDF-1.4\nx startxref\n9\n%%EOF"
    updated = one + b"\nmore startxref 20 %%EOF"
    got = media.found_media(media.automaton(), one + b"  " + updated + b" tail %%EOF " + b"%PDF-1.4 no end")
    assert got == [(0, len(one), "application/pdf"), (len(one) + 2, len(updated), "application/pdf")]


def png(w=3, h=2):
    chunk = lambda k, d: len(d).to_bytes(4) + k + d + zlib.crc32(k + d).to_bytes(4)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4) + h.to_bytes(4) + b"\x08\x00\x00\x00\x00") + chunk(b"IDAT", zlib.compress(b"\0" * (h * (w + 1)))) + chunk(b"IEND", b"")


def test_sniffing(spark):
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\x01\x00\x18\x00" + bytes(24) + bytes(4)
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    cases = {"image/png": png(), "image/gif": gif, "image/bmp": bmp, "audio/wav": media.wav(b"\x80" * 10), "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"x" * 99), "application/pdf": pdf}
    rows = [(k, "text/plain", v) for k, v in cases.items()] + [("cut", "image/png", png()[:-5]), ("none", None, b"BM text GIF89a PK\x03\x04"), ("null", None, None), ("inner", "text/plain", b"abc" + png() + b"--" + gif)]
    df = spark.createDataFrame(rows, "name string, declared string, media binary")
    got = {r["name"]: r for r in media.inspect(df).collect()}
    for k in cases:
        assert (got[k]["detected"], got[k]["corrected"]) == (k, True)
    assert (got["cut"]["detected"], got["cut"]["corrected"]) == ("image/png", False) and got["none"]["detected"] == got["null"]["detected"] == media.UNKNOWN and got["none"]["embedded"] == []
    assert [(e["offset"], e["type"]) for e in got["inner"]["embedded"]] == [(3, "image/png"), (5 + len(png()), "image/gif")]
    carved = {r["type"]: bytes(r["bytes"]) for r in media.carve(media.inspect(df)).where("name = 'inner'").collect()}
    assert carved == {"image/png": png(), "image/gif": gif}


def test_stored_texts(spark):
    docs = [(1, "abc"), (2, None), (3, "é" * 100), (3, "é" * 100), (None, "x" * 192), (4, "BM RIFF %PDF-1.4")]
    got = media.read_back(media.inspect(media.store_texts(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS media"))))
    want = []
    for d, t in docs:
        raw = (t or "").encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(p) + 44, hashlib.sha256(media.wav(p)).hexdigest()))
    assert Counter(tuple(r)[:7] for r in got.collect()) == Counter(want)
