"""HTML extraction, license scan, language, decontamination, toxicity and token counts."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strataloom.llm import decontamination, html_extraction, language_id, license_scan, token_counts, toxicity
from strataloom.llm.html_extraction import main_text

PROSE = "This is a long enough sentence of plain prose, and it goes on for a while so that it weighs something. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain &amp; short", "plain & short"),
        ('<nav><a href="/">Home</a></nav><article><h1>T &lt;1&gt;</h1><p><b>A<br>b\n c</b><p>Of.</article><footer>&copy; x</footer>', "T <1>\n\nA b c\n\nOf."),
        ('<script>var a="</p><article>";</script><style>p{}</style><main><p>x<!-- <p>no --> y</p></main>', "x y"),
        (f'<div id="top">menu</div><div><p>{PROSE}</p><p>{PROSE}</p></div><div class="sidebar"><p>{PROSE}</p></div>', f"menu\n\n{PROSE.strip()}\n\n{PROSE.strip()}"),
        (f'<article><p>{PROSE}</p><div class="ad">buy</div><div class="related"><ul><li><a>one</a></li></ul></div><p>end</p><section id="comments"><p>nice</p></section></article>', f"{PROSE.strip()}\n\nend"),
        (f'<form id="all"><article class="post has-comments"><p>{PROSE}</p><form>name <input></form></article></form>', PROSE.strip()),
        ('<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</table></article>', "a b\n\nc"),
        ('<div class="cookie-notice">We use cookies</div><article><header><h2>Head</h2></header>body &#233;&eacute;&#x41;</article>', "Head\n\nbody ééA"),
        ('<article><ul><li>first item</li><li>second</li></ul><pre>a  b\n c</pre></article>', "first item\n\nsecond\n\na b c"),
        (f'<main id="main"><h1>Section</h1><article><h2>Title</h2><div class="entry-content"><p>{PROSE}</p></div><p>tail</p></article><div>see more</div></main>', f"Title\n\n{PROSE.strip()}\n\ntail"),
        (f'<div class="top">Menu</div><div id="content"><h1>T</h1><p>{PROSE}</p><div class="comments"><p>{PROSE}</p></div></div><div class="legal">c</div>', f"T\n\n{PROSE.strip()}"),
        ("<p>open <b>tags <i>never closed", "open tags never closed"),
        ("a < b and <3 and <>", "a < b and <3 and <>"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_no_part_of_an_article_is_lost():
    p, end = PROSE.strip(), "The closing section says what follows from all of this, at some length and with care, to its end."
    links = "".join(f'<div><a href="/{i}">link {i}</a></div>' for i in range(4))
    assert main_text("<div>" + f"<p>{p}</p>" * 40 + f"</div>{links}<div><p>{end}</p></div>") == "\n\n".join([p] * 40 + [end])
    assert main_text(f'<div class="entry-content"><p>{p}</p><p>{p}</p></div><div class="entry-content"><p>{end}</p></div>') == f"{p}\n\n{p}\n\n{end}"
    assert main_text(f"<main><h1>Day</h1><article><p>{p}</p></article><article><p>{end}</p></article></main>") == f"{p}\n\n{end}"
    assert main_text(f"<main><p>{p}</p><p>{p}</p><article><p>{end}</p></article></main>") == f"{p}\n\n{p}\n\n{end}"
    for name in ('id="discussion"', 'class="related-work"', 'id="market-share"', 'class="menu"', 'id="legal"', 'class="section-header"'):
        assert main_text(f"<article><p>{p}</p><section {name}><p>{end}</p></section></article>") == f"{p}\n\n{end}", name
    for name in ('class="related-posts"', 'id="comments"', 'class="ad"'):
        assert main_text(f"<article><p>{p}</p><div {name}><p>{end}</p></div></article>") == p, name


P = ("Some words of a paragraph that is long enough to be read as an article's own. " * 5).strip()
WHOLE = [
    (f"<article><p>Kicker line</p><h1>Title</h1><p>{P}</p></article>", f"Kicker line\n\nTitle\n\n{P}"),
    (f"<article><p>{P}</p><ul><li><a href=x>First linked item</a></li><li>plain item</li></ul></article>", f"{P}\n\nFirst linked item\n\nplain item"),
    (f"<div><p>{P}</p><p>See <a href=x>{P}</a></p><p>{P}</p></div>", f"{P}\n\nSee {P}\n\n{P}"),
    (f"<div><p>{P}</p><p>Copyright law is the topic. {P}</p></div>", f"{P}\n\nCopyright law is the topic. {P}"),
    (f"<div><p>{P}</p></div><div>Copyright 2024 Some Company</div>", P),
    (f"<div><div><p>{P}</p><div><h3>Comments</h3><p>nice one {P}</p></div></div><p>{P}</p></div>", f"{P}\n\n{P}"),
    (f'<article><p>{P}</p><div class="related work"><p>{P}</p></div><div class="related"><p>{P}</p></div></article>', f"{P}\n\n{P}"),
    (f"<p>{P} {P} {P} {P} {P}</p><main><h1>T</h1><p>{P}</p></main>", f"T\n\n{P}"),
    (f"<h1>T</h1><p>{P}</p><p>{P}</p><article><p>a teaser {P}</p></article><article><p>b teaser {P}</p></article>", None),
    *((f'<div class="big-header"><p>{"x" * n}</p><p>{P}</p></div>', f"{'x' * n}\n\n{P}") for n in (87, 90)),
]


@pytest.mark.parametrize(("page", "text"), WHOLE)
def test_no_text_of_an_article_is_lost(page, text):
    found = html_extraction.main_text(page)
    assert found == text if text is not None else P in found and found.startswith("T")


def test_extraction_of_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").withColumn("text", F.lit("clash"))
    none = spark.createDataFrame([(-1, None, None, None)], "page_id long, url string, html string, text string")
    out = html_extraction.extract_main_text(pages.unionByName(none)).collect()
    assert len(out) == pages.count() + 1 and all(r.n_chars == len(r.text) for r in out)
    for r in out:
        if r.html:
            body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
            import html

            blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
            assert r.text == "\n\n".join(b for b in blocks if b)
    assert html_extraction.extract_main_text(pages.where("false")).count() == 0


def unmarked(page):
    """The page without article, menu and footer elements and without classes."""
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", page))


def test_windows_decide(small, monkeypatch):
    p = PROSE.strip()
    import pyarrow.parquet as pq

    pages = [t for t in pq.read_table(f"{small}/pages.parquet").column("html").to_pylist() if t]
    broken = f'<article><p>{p}</p><div class="ad">buy</div><p>end</p></article>'
    assert main_text(broken) == f"{p}\n\nend"
    same = sum(main_text(unmarked(t)) == main_text(t) for t in pages)
    assert same >= 0.9 * len(pages)
    before = [main_text(t) for t in pages]
    monkeypatch.setattr(html_extraction, "WINDOW", 1)
    assert main_text(broken) == p
    monkeypatch.setattr(html_extraction, "WINDOW", 3)
    monkeypatch.setattr(html_extraction, "runs", lambda weights, threshold, heads: [])
    assert not any(main_text(t) for t in pages) and all(before)


def test_names_of_doubt():
    p, dense = PROSE.strip(), "Apple closed at a price that few had seen coming, and the market took note of it within the hour."
    for name in ("share-price", "legal-analysis", "search-results-explained"):
        assert main_text(f'<article><p>{p}</p><div class="{name}"><p>Apple closed.</p></div></article>') == f"{p}\n\nApple closed.", name
        assert main_text(f'<div><p>{p}</p><div class="{name}"><p>{dense}</p></div></div>') == f"{p}\n\n{dense}", name
        assert main_text(f'<div><p>{p}</p><div class="{name}"><p>Short words.</p></div></div>') == p, name
    for name in ("main-nav", "site-footer", "cookie-box", "left-sidebar"):
        assert main_text(f'<div><p>{p}</p></div><div class="{name}"><p>{dense}</p></div>') == p, name
    assert main_text(f'<div><p>{p}</p></div><div class="c-list"><h3>2 Comments</h3><p>{dense}</p><p>{dense}</p></div>') == p


UNITS = ["<a ", '<a x="', "<a x='>'", "<noscript>", "<div>", "</p>", "<b><div><i>", "<!--", "<p>", "<", "&", "<li>", "<svg>", "<a x=\"'", "<b '>", "<script>", "<!", "<td>", "<i></b>", "</div><div><p>x", "<a href=x>y", "word "]


@pytest.mark.parametrize("unit", UNITS)
def test_very_long_pages_take_linear_time(unit):
    import time

    for page in (unit * (2_000_000 // len(unit)), "<b><section>" + "<div>" * 50_000 + unit * (2_000_000 // len(unit)) + '>"'):
        began = time.time()
        main_text(page)
        assert time.time() - began < 20
    assert main_text(f"<p>{'a ' * 1_000_000}</p>") == " ".join("a" * 1_000_000)


def test_repeated_pages(spark):
    page = f"<nav>menu</nav><article><p>{PROSE}</p></article>"
    out = html_extraction.extract_main_text(spark.createDataFrame([(1, page, "clash")] * 3, "page_id long, html string, n_chars string")).collect()
    assert len(out) == 3 and {(r.text, r.n_chars) for r in out} == {(PROSE.strip(), len(PROSE.strip()))}


def brute_licenses(text, templates, threshold):
    norm = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip().split(" ")
    grams = lambda w: {(a, b) for a, b in zip(w, w[1:])}
    spans = (text or "").split("\n") + [b for b in re.split(r"\n[\x20\x09-\x0D]*\n", text or "") if "\n" in b.strip("\n")]
    best = {}
    for s in spans:
        for name, t in templates.items():
            a, b = grams(norm(s)), grams(norm(t))
            if a and b and (d := 2 * len(a & b) / (len(a) + len(b))) >= threshold:
                best[name] = max(best.get(name, 0), d)
    return best


def test_licenses(spark):
    apache = license_scan.TEMPLATES["apache-2.0-header"]
    rows = ["Released under the MIT license", "x\n" + apache.replace(". You", ".\nYou") + "\n\nmore", "all rights Reserved!!", "All rights are reserved.", None, "", "licensed", "Licensed under the Apache License, Version 2.0. Yes", "ALL RIGHTS RESERVED.\nReleased under the MIT License."]
    rows += ["word " * 20_000 + "\nAll rights reserved."]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)] + [(0, rows[0], "clash")], "doc_id long, text string, license string")
    out = license_scan.scan_licenses(df).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        want = brute_licenses(rows[r.doc_id], license_scan.TEMPLATES, 0.8)
        assert r.licenses == ",".join(sorted(want)), r.doc_id
        assert r.license == (min(want, key=lambda n: (-want[n], n)) if want else None) and (r.dice is None if not want else abs(r.dice - max(want.values())) < 1e-9)
    assert license_scan.scan_licenses(df.where("false")).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
MIT_REST = """The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_whole_notices_as_they_are_shipped(spark):
    commented = lambda t: "\n".join(f"# {line}".rstrip() for line in t.split("\n"))
    rows = [MIT, " ".join(MIT.split()), f"MIT License\n\n{MIT}\n\n{MIT_REST}", commented(f"{MIT}\n\n{MIT_REST}"), MPL, commented(MPL), APACHE, commented(APACHE), license_scan.TEMPLATES["mpl-2.0"], license_scan.TEMPLATES["mit-grant"]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert [out[i].license for i in range(len(rows))] == ["mit-notice"] * 3 + ["mit-text"] + ["mpl-2.0-notice"] * 2 + ["apache-2.0-header", "apache-2.0-notice", "mpl-2.0", "mit-grant"]
    for i, text in enumerate(rows):
        assert out[i].licenses == ",".join(sorted(brute_licenses(text, license_scan.TEMPLATES, 0.8))), i


def test_license_key_words_cut_nothing():
    rng = random.Random(4)
    own = [f"w{i} w{i + 1}" for i in range(12)]
    for _ in range(300):
        kept = rng.sample(own, rng.randrange(1, 12))
        if 2 * len(kept) / (len(kept) + len(own)) >= 0.8:
            words = {w for b in kept for w in b.split()}
            assert words & set(license_scan.key_words([own], 0.8 / 1.2))


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("score", F.lit("clash"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language_id.learn(docs.where(~held))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 !?"), (-4, "ñ"), (-5, "the of and " * 200_000)], "doc_id long, text string")
    out = language_id.identify(docs.unionByName(odd, allowMissingColumns=True), model).collect()
    own = {r.doc_id: r for r in out if r.doc_id < 0}
    assert [own[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and own[-4].lang_pred in model.languages and own[-5].lang_pred == "en"
    test = [r for r in out if r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in test) >= 0.95 * len(test) and all(0 <= r.score <= 1 for r in out)
    none = language_id.learn(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), model).count() == 0


def test_grams_do_not_depend_on_spans(monkeypatch):
    text = "Ábc 1déf  ghi-" * 40
    whole = language_id.counts_of(text, 1 << 12)
    for span in (1, 2, 7, 64):
        monkeypatch.setattr(language_id, "SPAN", span)
        assert (language_id.counts_of(text, 1 << 12) == whole).all()


def brute_hits(text, items, n=13):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))) if w]
    d, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for s in range(len(d) - size + 1):
                if d[s : s + size] == w[i : i + size]:
                    hit.update(range(s, s + size))
                    found.add(str(item))
    return len(d), len(hit), len(found), ",".join(sorted(found))


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "is", f"q{rng.randrange(30)}"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(11, 22)))) for i in range(12)]
    items += [(20, "tiny Item"), (21, None), (22, "..."), (23, items[0][1]), (24, "la " * 16), (None, "no item id here")]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(w) - 3))
            words[rng.randrange(len(words) + 1) :][:0] = []
            at = rng.randrange(len(words) + 1)
            words[at:at] = w[0 : len(w) - a if rng.random() < 0.5 else len(w)]
        rows.append((i, ", ".join(words).upper() if i % 3 else " ".join(words), "clash"))
    rows += [(100, None, ""), (101, "", ""), (102, "LA-la " * 40, ""), (103, items[1][1], ""), rows[5], (None, items[2][1], "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string, n_hit string").repartition(3)
    known = [x for x in items if x[0] is not None]
    for r in decontamination.contamination(df, bench).collect():
        want = brute_hits(r.text, known)
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == want, r.doc_id
        assert r.contaminated == (want[1] > 0 and 20 * want[1] >= want[0])
    assert decontamination.contamination(df, bench).count() == len(rows)
    assert decontamination.contamination(df.where("false"), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(df, bench.where("false")).collect())


def test_items_without_identifier_hit_words(spark, tmp_path):
    bench = spark.createDataFrame([(None, "no item id here"), (1, "alpha beta gamma"), (None, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "there is no item id here"), (2, "alpha beta gamma and no item id here"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in decontamination.contamination(docs, bench, unnamed=True).collect()}
    assert got == {1: (4, 0, "", True), 2: (7, 1, "1", True), 3: (0, 0, "", False)}
    import duckdb

    import corpus_pipeline
    from strataloom.llm.queries import OP5_SQL, op5_decontamination
    from tests.compare import duck_rows, spark_rows

    con = duckdb.connect()
    for name, df in (("benchmark", bench), ("documents", docs)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert spark_rows(op5_decontamination(spark, str(tmp_path))) == duck_rows(con, OP5_SQL)
    rest = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").alias("n_chars"))
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, rest, str(tmp_path)).collect()] == [3]


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta y"), (2, "alpha so beta gamma delta"), (3, "alpha x x x x x x x beta gamma delta")], "doc_id long, text string")
    _, lists = decontamination.search(docs, bench, rarest=4)
    assert {r.id for r in decontamination.phrases(lists).collect()} == {1}
    assert {r.id for r in decontamination.proximity(lists, 1).collect()} == {1, 2}


def test_lists_prune_each_other(spark):
    """One rare term is in many documents, all the others of its window in few: only the intersection tells."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(i, f"x{i} alpha y{i} " + "common words follow here") for i in range(40)]
    rows += [(100, item), (101, "alpha z z z z z z z z z z z z z z z z z beta gamma delta"), (102, item.replace("delta", "other")), (103, "pre " + item.replace("zeta", "zeta so so").upper())]
    rows += [(104 + i, " ".join(reversed(item.split()))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    items, lists = decontamination.search(df, bench)
    by_rank = {r["rank"]: r["n"] for r in lists.groupBy("rank").agg(F.count_distinct("id").alias("n")).collect()}
    met = decontamination.phrases(lists)
    assert {r.id for r in met.collect()} <= {100, 102, 103} and met.count() < lists.count()
    assert by_rank[1] < len(rows)  # a document with one list of a window alone is gone before windows are looked at
    found = decontamination.occurrences(df, items, met).collect()
    assert [(r.id, r.start, r.n) for r in found] == [(100, 0, 15)]
    out = {r.doc_id: r for r in decontamination.contamination(df, bench).collect()}
    assert {k for k, r in out.items() if r.n_hit} == {100} and out[100].n_hit == 15
    assert out[100].n_near == 3 and out[103].n_near > 0 and out[101].n_near == 0 and out[0].n_near == 0


def test_near_windows_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", f"q{rng.randrange(12)}"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 20)))) for i in range(8)]
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(25)]
    rows += [(50 + i, " ".join(w for w in items[i][1].split() if rng.random() < 0.9)) for i in range(8)]
    seen = {}
    for _, t in rows:
        for w in t.split():
            seen[w] = seen.get(w, 0) + 1
    want = {}
    for i, t in rows:
        places = {}
        for p, w in enumerate(t.split()):
            places.setdefault(w, []).append(p)
        n = 0
        for own in {x[1] for x in items}:
            w = own.split()
            size = min(13, len(w))
            for s in range(len(w) - size + 1):
                spots = range(s, s + size)
                if all(w[a] in seen for a in spots):
                    chosen = sorted(spots, key=lambda a: (seen[w[a]], a))[:3]
                    n += any(all(any(abs((p - a) - (q - chosen[0])) <= 3 for p in places.get(w[a], [])) for a in chosen) for q in places.get(w[chosen[0]], []))
        want[i] = n
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.n_near for r in got} == want


def test_hot_terms_and_long_texts(spark):
    """Windows of common words only: a posting meets each place of its term once, however many windows hold it."""
    bench = spark.createDataFrame([(1, "the of " * 40), (2, "of the end of the day " * 8)], "item_id long, text string")
    df = spark.createDataFrame([(i, "the of and " * 30) for i in range(50)] + [(90, "the of " * 20_000), (91, None), (92, "")], "doc_id long, text string")
    items, lists = decontamination.search(df, bench)
    out = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.contamination(df, bench).collect()}
    assert out[90] == (40_000, 40_000, "1") and out[0][1] == 0 and out[91] == (0, 0, "") == out[92]


def test_transducers_and_their_composition():
    table = toxicity.grammar()

    def run(symbols):
        state, out = 0, ""
        for s in symbols:
            state, mark = table[state, s]
            out += mark
        return out

    assert run("OIO") == "OIO" and run("YOI") == "YOJ" and run("IOY") == "IOJ"
    assert run("NOI") == "NOn" and run("NOOOOOI") == "NOOOOOI" and run("RI") == "Rr"
    assert run("WTY") == "WTK" and run("TY") == "TY"


def test_reported_before_and_after():
    model = toxicity.Model({"moron": 2.0}, {}, toxicity.np.zeros(15)).ready()
    of = lambda t: {m: round(x, 2) for m, x in zip(toxicity.MARKS, toxicity.np.expm1(model.features(t)[: len(toxicity.MARKS)])) if x}
    assert of("You moron") == {"J": 2.0} and of("a moron") == {"I": 2.0} and of("that is a moron") == {"P": 2.0}
    assert of("the moron and the moron") == {"I": 2.0, "H": 2.0} and of("not a moron") == {"n": 2.0}
    assert of("she said you moron") == {"r": 2.0} and of("you moron, he said") == {"r": 2.0} and of('"you moron", he said') == {"r": 2.0}
    assert of("I will kill you") == {"K": 3.0} and of("") == {} and of(None) == {}
    assert of("moron " + "calm words only. " * 200_000) == {"I": 2.0}


def test_grammar_carries_the_score(spark):
    """Where insults are in quotations and denials as often as not, only the grammar tells the texts apart."""
    rng = random.Random(8)
    insults, rows = ["moron", "idiot", "clown", "creep", "fool"], []
    filler = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(8, 30)))
    words = lambda t: re.sub(r"w(\d)(\d*)", lambda m: "abcdefghij"[int(m[1])] + "".join("klmnopqrst"[int(c)] for c in m[2]) + "x", t)
    for i in range(2400):
        x = rng.choice(insults)
        bad, fine = [f"you {x}", f"you are a {x}", f"they are such a {x}"], [f"she wrote you are a {x}", f"you are not such a {x}", f"they never called you {x}", f"you are a {x}, he said"]
        y = i % 15 == 0
        rows.append((i, words(filler()) + ". " + (rng.choice(bad) if y else rng.choice(fine) if i % 15 == 1 else "calm day") + ". " + words(filler()), int(y)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learnable = df.where("doc_id % 4 <> 0").select("doc_id", "toxic")

    def auc_and_recall(table):
        model = toxicity.learn(df.select("doc_id", "text"), learnable, table=table)
        out = toxicity.score_toxicity(df.where("doc_id % 4 = 0 and doc_id % 15 < 2"), model).collect()
        pos, neg = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg), sum(p >= 0.7 for p in pos) / len(pos)

    (on, found), (off, lost) = auc_and_recall(None), auc_and_recall(toxicity.flat())
    assert on > 0.97 and on > off + 0.1 and found > 0.9 and found > lost + 0.3, (on, off, found, lost)


def test_toxicity_learns_from_a_bounded_sample(spark, monkeypatch):
    sizes, plain = [], toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: sizes.append((name, plain(df, name))) or sizes[-1][1])
    docs = spark.createDataFrame([(1, f"you idiot {i % 7}") for i in range(5000)] + [(i, "calm words") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), *((i, 0) for i in range(2, 60)), (None, 1), (3, None)], "doc_id long, toxic int")
    toxicity.learn(docs, labels, 10, 10)
    assert all(df.count() <= 20 for _, df in sizes) and {name for name, _ in sizes} == {"toxicity-sample", "toxicity-words"}
    assert toxicity.score_toxicity(docs.where("false"), toxicity.learn(docs.where("false"), labels)).count() == 0


def test_toxicity(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text").where("doc_id < 4000")
    labels = spark.read.parquet(f"{small.replace('0.001', '0.1')}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = toxicity.learn(docs, labels.where(~held), 300, 900)
    out = toxicity.score_toxicity(docs.withColumn("score", F.lit("clash")).unionByName(spark.createDataFrame([(-1, None, ""), (-2, "", "")], "doc_id long, text string, score string")), model)
    truth = out.join(labels.where(held), "doc_id").collect()
    pos, neg = [r.score for r in truth if r.toxic], [r.score for r in truth if not r.toxic]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.85 and sum(s >= 0.7 for s in neg) <= 0.05 * len(neg)
    assert {r.predicted for r in out.where("doc_id < 0").collect()} == {0}
    one_sided = toxicity.learn(docs, labels.where("toxic = 0"))
    assert toxicity.score_toxicity(docs.limit(5), one_sided).where("predicted = 1").count() == 0


def test_token_counts(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    exact = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = [None, "", " ", "a", "Hello  world\n\n\t x", "<|endoftext|> in text<|endoftext|>", "don't we'll I'M", "日本語 テキスト 🙂🙂", "naïve café ٣٤٥ ½ ²", " nbsp em", "x" * 5000, "ab cd " * 40_000]
    texts += ["".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "1", "é", "ß", ".", "́", "‍", "<|", "|>", "漢"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[3], ""), (None, "null id", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    cache = str(tmp_path / "cache")
    out = token_counts.token_counts(df, path, cache).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.n_tokens == len(exact.encode(r.text or "", add_special_tokens=False).ids), r.text
        assert r.n_bytes == len((r.text or "").encode())
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t, _ in rows})
    again = token_counts.token_counts(df, path, cache).collect()
    assert sorted(map(str, again)) == sorted(map(str, out)) and spark.read.parquet(cache).count() == stored.count()
    assert token_counts.token_counts(df.where("false"), path, str(tmp_path / "none")).count() == 0


def test_pieces_are_cut_where_words_end():
    text = "some words of a text, " * 50
    assert "".join(token_counts.pieces(text, 40)) == text and len(list(token_counts.pieces(text, 40))) > 20
