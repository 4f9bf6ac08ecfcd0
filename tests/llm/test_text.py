"""Language, HTML, personal data, pieces, token files, URL filter and decontamination."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows_llm import documents, empty, nasty, texts  # noqa: F401
from tokenizers import Tokenizer

from paperloom.llm import decontam, html_text, language, pieces, pii, token_store, url_filter

PIECES = pieces.vocabulary_path(pieces.MODEL)
TOKENS = token_store.vocabulary_path(token_store.VOCABULARY)


# --- language ---------------------------------------------------------------------------------


def test_language_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_mixture_of_two_languages(spark, documents):
    langs, model = language.learn(documents)
    by = {r["lang"]: r["t"] for r in documents.where("lang IN ('en', 'de')").groupBy("lang").agg(F.max_by("text", F.length("text")).alias("t")).collect()}
    places, parts = language.mixture(model, by["en"][:3000] + " " + by["de"][:1000])
    assert [langs[p] for p in places][:2] == ["en", "de"]
    assert 0.6 < parts[0] < 0.9
    places, _ = language.mixture(model, by["de"])
    assert [langs[p] for p in places] == ["de"]


def test_language_nasty(nasty, empty):
    found = language.identify(nasty).collect()
    assert len(found) == nasty.count()
    assert {r["lang_pred"] for r in found if r["doc_id"] in (2, 3, 4, 8)} == {"und"}
    assert all(r["lang_pred"] == "en" for r in found if r["doc_id"] in (1, 5, 9))
    kept = language.keep_known(nasty)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 5
    assert language.identify(empty).count() == 0
    unlearned = language.identify(nasty.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in unlearned.collect()} == {("und", 0.0)}


# --- html -------------------------------------------------------------------------------------


def test_pages_against_their_source(spark):
    """The pages' articles are blocks of h1 and p; they come out whole and nothing else does."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["page_id"]: r for r in html_text.page_texts(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", page["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n\n".join(b for b in blocks if b)
        assert found[page["page_id"]]["text"] == text
        assert found[page["page_id"]]["n_chars"] == len(text)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("<body><nav><a>x</a></nav><main><h1>T&amp;t</h1><p>a  b<br>c<p>d</main><footer>f</footer>", "T&t\n\na b c\n\nd"),
        ("<article><p>one<div class='comments'><p>said</div><aside>side</aside><p>two</article>", "one\n\ntwo"),
        ("<div id=cookie-notice>ok?</div><article><ul><li>a<li>b</ul><form>f<input></form></article>", "a\n\nb"),
        ("<div class='page header-fixed has-sidebar'><article class='post'><p>a</article><article class='comment'><p>b</article></div>", "a"),
        ("<aside><article><p>teaser</article></aside><main class='with-sidebar'><p>text", "text"),
        ("<article><p>x<script>var a='<p>no</p>';</script><style>p{}</style> y</article>", "x\n\ny"),
    ],
)
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


def test_dense_lines_without_an_article():
    links = "".join(f"<li><a href='/{i}'>n{i}</a></li>" for i in range(30))
    body = "".join(f"<p>{'many words of a paragraph ' * 12}{i}</p>" for i in range(5))
    found = html_text.main_text(f"<html><body><ul>{links}</ul><div>{body}</div><ul>{links}</ul></body></html>")
    assert "many words of a paragraph" in found and found.count("\n\n") >= 4
    assert "n3" not in found.split("\n\n")


@pytest.mark.parametrize("longest", [300, 1500, 4000, 40000])
def test_one_long_paragraph_does_not_cut_the_others(longest):
    blocks = ["A heading"] + [f"{i} " + "x" * 298 for i in range(30)]
    for place in (1, 15, 30):
        blocks[place] = "y" * longest
        page = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        links = "<ul>" + "".join(f"<li><a href='/{i}'>n{i}</a></li>" for i in range(30)) + "</ul>"
        assert html_text.main_text(f"<body>{page}</body>") == "\n\n".join(blocks)
        assert html_text.main_text(f"<body>{links}<div>{page}</div>{links}</body>") == "\n\n".join(blocks)
    sections = "".join(f"<section><h2>Part {i}</h2><p>{'some words ' * n}</p></section>" for i, n in enumerate((5, 900, 6)))
    found = html_text.main_text(f"<body><div>{sections}</div></body>")
    assert [f"Part {i}" in found for i in range(3)] == [True] * 3 and found.count("some words") == 911


def test_nested_content_elements_stay_whole():
    body = "".join(f"<p>{'long body of the text ' * 20}{i}</p>" for i in range(5))
    found = html_text.main_text(f"<main><h1>title</h1><p>lede</p><article>{body}</article><p>end</p></main>").split("\n\n")
    assert found[:2] == ["title", "lede"] and found[-1] == "end" and len(found) == 8
    parts = ["a" * 100, "b" * 200, "c" * 1000]
    sections = "".join(f"<article><p>{p}</p></article>" for p in parts)
    nested = "".join(f"<article><p>{p}</p>" for p in parts)
    for page in (f"<main>{sections}</main>", sections, f"<main>{nested}</main>", nested):
        assert html_text.main_text(page) == "\n\n".join(parts)
    teasers = "".join(f"<article><h3><a href='/{i}'>A headline of another page</a></h3><p>More of it</p></article>" for i in range(9))
    marked = "<article class='teaser'><p>" + "t" * 500 + "</p></article>"
    assert html_text.main_text(f"<article><p>{parts[2]}</p></article>{teasers}{marked}") == parts[2]


def test_html_nasty(spark):
    rows = [(None, None, None), (1, "u", None), (1, "u", "<article>" + "<p>x y" * 20000), (2, None, "<" * 5000), (3, "u", "</p></div>&#0;&bogus; text")]
    found = html_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(found) == 5 and found[2]["n_chars"] == 20000 * 3 + 19999 * 2
    assert html_text.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- personal data ----------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(number):
    doubled = [int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(reversed(number))]
    return sum(doubled) % 10 == 0


def _good(kind, match):
    number = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in match.split(".")), "card": 16 <= len(number) <= 19 and _luhn(number), "phone": 8 <= len(number) <= 15}[kind]


def _base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if _good(k, m.group()))


def test_base_spans_against_brute_force(spark, texts, nasty, empty):
    draw = random.Random(5)
    bits = ["a@b.c", "@", ".", "_", "-", "+", "1", "42", "255", "256", "1.2.3.4", "300.1.1.1", " ", "  ", "(", ")", "+1 (988) 555-2485", "4041 8949-7460 8795",
            "4111111111111111", "x", "é", "😀", "joe (at) mail (dot) com", "555-123-4567", "\n", "a@b.c_d@e.f", "00", "+44", "call ", "4111.1111.1111.1111"]
    rows = list(texts) + [(10000 + i, "".join(draw.choice(bits) for _ in range(draw.randint(0, 40)))) for i in range(300)]
    rows += [(20000, "1 " * 6000), (20001, "a@b.cd " * 1500), (20002, "9" * 20000), (20003, "a" * 50000), (20004, None)]
    found = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = dict(rows)
    for r in found:
        base = _base(wanted[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        kinds = [s.split(":")[0] for s in base.split(",")]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [kinds.count(k) for k in pii.KINDS]
    assert pii.spans(nasty).count() == nasty.count() and pii.spans(empty).count() == 0


def test_reliabilities_find_the_better_labeler():
    counts = {"111": 400.0, "110": 80.0, "011": 20.0, "000": 500.0, "001": 60.0, "100": 15.0}
    real = pii.reliabilities(counts)
    assert real["111"] > 0.95 and real["000"] < 0.05 and real["110"] > real["001"]


def test_added_spans_and_redaction(spark):
    rows = [(i, f"write to user{i}@mail.example.com or call +1 988 555 {2000 + i}") for i in range(60)]
    rows += [(100 + i, f"mail joe{i} (at) example (dot) com please") for i in range(20)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("bigint")).withColumn("every", F.lit(1))
    found = {r["doc_id"]: r for r in pii.spans(documents).collect()}
    assert found[100]["n_email"] == 0 and found[100]["spans"] == "email:5:32"
    done = {r["doc_id"]: r for r in pii.redact(documents).collect()}
    assert done[3]["text"] == "write to [EMAIL] or call [PHONE]" and done[3]["n_chars"] == len(done[3]["text"])
    assert done[100]["text"] == "mail [EMAIL] please" and done[100]["every"] == 1
    odd = [(1, "4111111111111111@b.cd.ef zz"), (2, "x+1 988 555 2485@y.com"), (3, None), (4, "nothing")]
    texts = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    assert texts == {1: "[EMAIL][CARD] zz", 2: "x[PHONE][EMAIL]", 3: None, 4: "nothing"}


def test_redaction_nasty(nasty, empty):
    done = pii.redact(nasty)
    assert done.columns == nasty.columns and done.count() == nasty.count()
    assert pii.redact(empty).count() == 0


# --- pieces -----------------------------------------------------------------------------------


def _best(vocabulary, marked):
    best, back = [0.0], [0]
    for end in range(1, len(marked) + 1):
        top, link = float("-inf"), 0
        for start in range(max(0, end - vocabulary.longest), end):
            score = vocabulary.scores.get(marked[start:end], vocabulary.fallback if start == end - 1 else None)
            if score is not None and best[start] + score > top:
                top, link = best[start] + score, start
        best.append(top)
        back.append(link)
    found, end = [], len(marked)
    while end:
        piece = marked[back[end] : end]
        found.append([vocabulary.ids[piece]] if piece in vocabulary.ids else vocabulary.stand_in(piece))
        end = back[end]
    return [i for part in reversed(found) for i in part]


def test_streaming_equals_the_whole_search(texts):
    vocabulary, draw = pieces.load(PIECES), random.Random(3)
    samples = ["".join(draw.choice(a) for _ in range(n)) for n in (1, 5, 50, 1500) for a in ("ab c", "the ▁ erand\n\té  ", "abcdefghijklmnopqrstuvwxyz", "漢字 x😀", "a.b, c!\n")]
    samples += [t[:1500] for _, t in texts[:15]]
    for text, ids in zip(samples, vocabulary.encode_all(samples)):
        marked = pieces.marked(text)
        wanted = _best(vocabulary, marked)
        assert [i for part in vocabulary.stream(marked) for i in part] == wanted
        assert np.frombuffer(ids, "<i4").tolist() == np.frombuffer(vocabulary.encode(text), "<i4").tolist() == wanted
        assert vocabulary.decode(wanted) == text


def test_the_window_stays_small():
    vocabulary, sizes = pieces.load(PIECES), []
    for part in vocabulary.stream(pieces.MARK + "abcdefgh" * 20000):
        sizes.append(len(part))
    assert len(sizes) > 1000 and max(sizes) < 500


def test_pieces_round_trip(documents, nasty, empty):
    assert {r["exact"] for r in pieces.round_trip(documents, PIECES).collect()} == {True}
    found = pieces.round_trip(nasty, PIECES).collect()
    assert len(found) == nasty.count() and all(r["exact"] for r in found)
    assert {r["n_pieces"] for r in found if r["doc_id"] in (2, 3)} == {0}
    assert pieces.with_ids(nasty, PIECES).columns == [*nasty.columns, "ids"]
    assert pieces.round_trip(empty, PIECES).count() == 0


# --- token files ------------------------------------------------------------------------------


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 70000, 1 << 31])
def test_blocks_round_trip(top):
    draw = random.Random(top)
    for size in (0, 1, 511, 512, 5000):
        ids = np.array([draw.randrange(top) if draw.random() < 0.97 else draw.randrange(min(1 << 32, top * 4)) for _ in range(size)], np.uint32)
        found = token_store.TokenFile(token_store.file_bytes([1, None], np.array([size // 2, size - size // 2]), ids))
        assert (found.ids() == ids).all() and (found.document(1) == ids[size // 2 :]).all()
        assert found.keys == [1, None]
        if size > 600:
            assert (found.ids(100, 600) == ids[100:600]).all()


def test_outliers_become_exceptions():
    ids = np.array([*range(500), *[4_000_000] * 12], np.uint32)
    [block] = token_store.pack_blocks(ids)
    assert len(block) < 700  # nine bits an id and twelve exceptions, not 22 bits an id


def test_units_give_the_ids_of_the_whole_text(texts):
    tokenizer, encoder, draw = Tokenizer.from_file(TOKENS), token_store.Encoder(TOKENS), random.Random(1)
    bits = ["a", "the", ".", ",", " ", "  ", "\n", "\n\n", "\t", "é", "1", "23", "'s", "don't", "\xa0", "😀", "<|endoftext|>", "word.\nNext", "x,", "\r\n", "\x1c", "ß", "²", "3²", "я", "яa",
            "Ⅷ", "\n\nFoo", "x'll", " Foo", "(bar)", "a-b", "́a", "_x"]
    samples = ["".join(draw.choice(bits) + draw.choice(["", " "]) for _ in range(draw.randint(0, 30))) for _ in range(2000)]
    samples += [t for _, t in texts] + ["ab cd  " * 30000, "x" * 100000, None]
    for text, ids in zip(samples, encoder.encode_all(samples)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, documents, texts, nasty, empty, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_IDS", 2000)
    tokenizer = Tokenizer.from_file(TOKENS)
    folder = token_store.new_folder(spark, "tokens")
    manifest = token_store.write_tokens(documents, folder, TOKENS)
    assert manifest.count() > 20
    start, wanted = 0, {}
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        wanted[key] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    found = token_store.read_tokens(spark, manifest, folder).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == wanted
    folder = token_store.new_folder(spark, "tokens")
    found = token_store.read_tokens(spark, token_store.write_tokens(nasty, folder, TOKENS), folder).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:n]) for n in range(len(found))]
    folder = token_store.new_folder(spark, "tokens")
    assert token_store.read_tokens(spark, token_store.write_tokens(empty, folder, TOKENS), folder).count() == 0


# --- urls -------------------------------------------------------------------------------------


def test_rules_and_links(spark):
    canonical = "<link rel='canonical' href='{}'>"
    rows = [
        (1, "http://a.example.org/es/1", None),  # blocked by a rule
        (2, "http://x.net/1", canonical.format("http://a.example.org/es/1")),  # alias of a blocked url
        (3, "http://y.net/2#frag", "<meta http-equiv=refresh content='0; url=http://x.net/1'>"),  # over two links
        (4, "http://sub.org/ok", canonical.format("http://x.net/1")),  # allowed by a rule: stops the block
        (5, "http://q.net/1", canonical.format("//b.com/de/7")),  # names a blocked url that is no page
        (6, "http://q.net/2", canonical.format("/1")),  # relative, alias of 5
        (7, "HTTP://Sub.COM/fr/x?y", ""),
        (8, "http://b.com/de", ""),
        (9, "no scheme", ""),
        (10, None, None),
        (7, "HTTP://Sub.COM/fr/x?y", ""),
        (11, "http://example.org/en/12", ""),
        (12, "http://badexample.org/en/12", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("verdict", F.lit("x"))
    rules = url_filter.rule_table(spark, url_filter.RULES)
    found = [tuple(r)[:5] for r in url_filter.filter_urls(pages, rules).orderBy("page_id").collect()]
    assert found == [
        (1, "a.example.org", "/es/1", "example.org/es/", "block"),
        (2, "x.net", "/1", None, "allow"),
        (3, "y.net", "/2", None, "allow"),
        (4, "sub.org", "/ok", "org/", "allow"),
        (5, "q.net", "/1", None, "block"),
        (6, "q.net", "/2", None, "block"),
        (7, "sub.com", "/fr/x", "com/fr/", "allow"),
        (7, "sub.com", "/fr/x", "com/fr/", "allow"),
        (8, "b.com", "/de", None, "allow"),
        (9, "", "", None, "allow"),
        (10, "", "", None, "allow"),
        (11, "example.org", "/en/12", "example.org/en/1", "block"),
        (12, "badexample.org", "/en/12", "org/", "allow"),
    ]
    without = url_filter.filter_urls(pages.where("page_id <> 4"), rules).collect()
    assert {r["page_id"]: r["verdict"] for r in without}[3] == "block"
    extra = spark.createDataFrame([("http://b.com/de/1", "http://z.net/")], "src string, dst string")
    more = spark.createDataFrame([(1, "https://z.net/", None)], "page_id long, url string, html string")
    assert url_filter.filter_urls(more, rules, extra).first()["verdict"] == "block"
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_targets_relative_to_the_page(spark):
    base = "http://Q.net/a/b/c.html?x=/1/2#f"
    wanted = {
        "page.html": "q.net/a/b/page.html",
        "./page.html?y=../1": "q.net/a/b/page.html?y=../1",
        "../x": "q.net/a/x",
        "../../../x/./y/../z": "q.net/x/z",
        "dir/": "q.net/a/b/dir/",
        "..": "q.net/a/",
        ".": "q.net/a/b/",
        "?p=2": "q.net/a/b/c.html?p=2",
        "?u=http://b.com/": "q.net/a/b/c.html?u=http://b.com/",
        "/r/../s?t": "q.net/s?t",
        "/": "q.net/",
        "/..": "q.net/",
        "/a//b/": "q.net/a//b/",
        "//b.com/x": "b.com/x",
        "https://b.com/../x": "b.com/../x",
        "#top": None,
        "mailto:a@b.cd": None,
    }
    rows = [(n, base, f"<link rel=canonical href='{t}'>") for n, t in enumerate(wanted)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = url_filter.page_links(pages).select(url_filter.node(F.col("dst")).alias("n")).collect()
    assert sorted(r["n"] for r in found) == sorted(w for w in wanted.values() if w)
    rows = [
        (1, "http://b.com/de/1", "<link rel=canonical href='../about/us'>"),
        (2, "http://b.com/about/us", None),
        (3, "http://b.com/about/old", "<meta http-equiv=refresh content='0; url=us'>"),
        (4, "http://b.com/about/us?p=2", "<link rel=canonical href='?p=3'>"),
        (5, "http://b.com", "<link rel=canonical href='about/us?p=3'>"),
        (6, "http://b.com/other", "<link rel=canonical href='javascript:us'>"),
        (7, "no scheme", "<link rel=canonical href='about/us'>"),
        (8, "http://b.com/about/us?p=3", "<meta http-equiv=refresh content='0; url=us'>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert verdicts == {**dict.fromkeys((1, 2, 3, 4, 5, 8), "block"), 6: "allow", 7: "allow"}


# --- decontamination --------------------------------------------------------------------------


def _words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def test_edit_distance_of_the_best_window():
    draw = random.Random(8)
    for _ in range(60):
        item = np.array([draw.randrange(6) for _ in range(draw.randint(1, 12))], np.uint32)
        region = np.array([draw.randrange(6) for _ in range(draw.randint(1, 20))], np.uint32)
        edits, start, end = decontam.best_window(item, region)

        def distance(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row, left = [i], row
                for j, y in enumerate(b, 1):
                    row.append(min(left[j - 1] + (x != y), left[j] + 1, row[-1] + 1))
            return row[-1]

        assert edits == min(distance(item, region[i:j]) for i in range(len(region) + 1) for j in range(i, len(region) + 1))
        assert edits == distance(item, region[start:end])


def test_leaks_are_found_and_only_they(spark, documents, texts):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(documents, items).collect()}
    exact = {(i, b["item_id"]) for i, t in texts for b in items.collect() if f" {' '.join(_words(b['text']))} " in f" {' '.join(_words(t))} "}
    assert exact <= found
    assert len(found) <= len(exact) + 2
    blocked = decontam.contamination(documents, items, block=7)
    assert {(r["doc_id"], r["item_id"]) for r in blocked.collect()} == found
    kept = decontam.drop_contaminated(documents, items)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in texts} - {i for i, _ in found}


@pytest.mark.parametrize("share", [0, 0.05, 0.1, 0.15, 0.2])
def test_recall_under_edits(spark, texts, share):
    draw = random.Random(4)
    items = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    vocabulary = [w for _, t in texts[:50] for w in t.split()]
    index, samples, owners = decontam.Index(items), [], []
    for number, item in enumerate(items):
        words = item.split()
        for _ in range(int(share * len(_words(item)))):
            place, turn = draw.randrange(len(words)), draw.random()
            if turn < 0.5:
                words[place] = draw.choice(vocabulary)
            elif turn < 0.75 and len(words) > 1:
                del words[place]
            else:
                words.insert(place, draw.choice(vocabulary))
        sample = " ".join(draw.choices(vocabulary, k=40) + words + draw.choices(vocabulary, k=40))
        if decontam.best_window(index.items[number], decontam.words(sample.lower().encode())[0])[0] <= index.limits[number]:
            samples.append(sample)
            owners.append(number)
    found = decontam.scan(samples, index)
    assert sum(any(m[0] == own for m in match) for own, match in zip(owners, found)) / len(owners) >= 0.95


def test_words_by_unicode_category():
    def split(text):
        raw = text.encode()
        return [raw[a:b].decode() for a, b in zip(*decontam.words(raw)[1:])]

    assert split("a\u00a0b\u2014c \u201cd\u201d e\u3002f\uff0cg naïve e\u0301t\u00e9 9\u0663") == [*"abcdefg", "naïve", "e\u0301té", "9\u0663"]
    assert split("漢字。かなabc漢12 한국어 ไทย текст") == [*"漢字かな", "abc", "漢", "12", "한국어", *"ไทย", "текст"]
    assert split("ที่นี่") == ["ที่", "นี่"] and split("😀 ‥ «x»") == ["x"] and not split("")


def test_leaks_without_ascii_spaces(spark):
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    plain = "one item of the set whose words are set apart by common spaces"
    items = spark.createDataFrame([(1, han), (2, plain), (3, "ภาษาไทยไม่มีช่องว่างระหว่างคำ"), (4, "吾輩は猫である")], "item_id long, text string")
    docs = [
        (1, "前言，" + han + "。后记"),
        (2, "前言，" + han[:8] + "，" + han[8:12] + "甲" + han[13:] + "。后记"),  # one edit and a comma
        (3, "x " + plain.replace(" ", "\u00a0") + " y"),
        (4, "x\u2014\u201c" + plain.replace(" ", "\u2009") + "\u201d\u2014y"),
        (5, "นี่คือภาษาไทยไม่มีช่องว่างระหว่างคำครับ"),
        (6, "『吾輩は猫である。』名前は"),
        (7, han[::-1] + "吾輩は犬である"),
        (8, "甲" * 200000 + han + "乙" * 200000),
    ]
    found = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in found} == {(1, 1): 0, (2, 1): 1, (3, 2): 0, (4, 2): 0, (5, 3): 0, (6, 4): 0, (8, 1): 0}
    for r in found:
        if r["edits"] == 0 and r["item_id"] == 1:
            assert docs[r["doc_id"] - 1][1].encode()[r["start"] : r["end"]].decode() == han


def test_decontamination_nasty(spark, nasty, empty):
    items = spark.createDataFrame([(1, "the whole of erand thesh the whole of erand thesh the whole"), (None, "another text under the same id, which is not"), (3, None), (4, ""), (5, "the of"), (1, "no id but some words that stand here")], "item_id long, text string")
    found = decontam.contamination(nasty, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(5, 1), (6, 1), (1, None), (None, 1)}
    long_one = next(r for r in found if r["doc_id"] == 5)
    assert long_one["edits"] == 0
    kept = decontam.drop_contaminated(nasty, items)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 4
    assert decontam.contamination(empty, items).count() == 0 and decontam.contamination(nasty, items.limit(0)).count() == 0


def _woven(size, a="a", b="b"):
    """Thue-Morse words: two of them, exchanged, have one polynomial hash from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("size", [64, 512, 1024, 2048, 8192])
def test_ids_of_words_with_one_hash(size):
    one, two = _woven(size)
    texts = [f"x {one} y {two} z", two, f"{one} {one}", f"{two} {two} {one}"]
    model, plain = pieces.load(PIECES), Tokenizer.from_file(TOKENS)
    for text, ids in zip(texts, model.encode_all(texts)):
        assert model.decode(np.frombuffer(ids, "<i4").tolist()) == text
    assert list(model.encode_all([two])) == list(pieces.Pieces(PIECES).encode_all([two]))
    found = token_store.encoder(TOKENS).encode_all(texts)
    assert [np.frombuffer(i, np.uint32).tolist() for i in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_passages_with_wide_gaps(spark):
    """An item whose words stand thousands of spaces apart is found wherever a part of the text ends."""
    draw = random.Random(6)
    item = [f"w{draw.randrange(10**6)}" for _ in range(60)]
    passage = (" " * 3000).join(item)
    fill = lambda n: " ".join(f"f{draw.randrange(10**6)}" for _ in range(n))
    rows = [(n, f"{fill(55000 + 4000 * n)} {passage} {fill(80000)}") for n in range(6)] + [(10, fill(150000)), (11, "x" * (3 << 20)), (12, " ".join(item[:50]) + " " + fill(90000))]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, "too few words")], "item_id long, text string")
    found = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in found) == sorted([(n, i, 0) for n in range(6) for i in (1, 2)] + [(12, i, 10) for i in (1, 2)])
    assert all(rows[r["doc_id"]][1].lower().encode()[r["start"] : r["end"]].decode() == passage for r in found if r["doc_id"] < 6)


def test_equal_items_are_one_text_of_a_block(spark, documents, monkeypatch):
    texts = [r["text"] for r in documents.where("length(text) BETWEEN 200 AND 900").orderBy("doc_id").limit(6).collect()]
    items = spark.createDataFrame([(i, texts[0] if i % 3 == 0 else texts[i % 6]) for i in range(60)], "item_id long, text string")
    sizes = [len(d) for d, _, _ in decontam.blocks(items, "text", 2)]
    assert sum(sizes) == len({texts[0 if i % 3 == 0 else i % 6] for i in range(60)})
    assert len(list(decontam.blocks(items, "text", 5000, most=300))) > 1
    one, many = (sorted(map(tuple, decontam.contamination(documents, items, block=b).collect())) for b in (5000, 2))
    assert one == many and {r[1] for r in one} == set(range(60))
    kept = [sorted(r["doc_id"] for r in decontam.drop_contaminated(documents, items, block=b).collect()) for b in (5000, 2)]
    assert kept[0] == kept[1] and len(kept[0]) < documents.count()


def test_named_sections_of_articles_stay():
    """Names inside an article hide nothing that is text of the article; furniture of any such name goes."""
    text = "A paragraph of plain words that goes on for a while, as paragraphs of articles do, and then ends here."
    tags = ['section id="discussion"', 'section id="related-work"', 'div class="share-price"', 'div class="notice-board"', 'div class="search-party"', 'div class="ad-hoc"', 'div id="header"']
    for tag in tags:
        name = tag.split()[0]
        html = f"<article><h1>Title</h1><p>{text}</p><{tag}><p>Inner {text}</p><p>More {text}</p></{name}><p>Last {text}</p></article>"
        assert html_text.main_text(html) == "\n\n".join(["Title", text, f"Inner {text}", f"More {text}", f"Last {text}"]), tag
    links = "".join(f'<li><a href="/{i}">Some other page {i}</a></li>' for i in range(4))
    for tag in ['div class="share"', 'div class="related-posts"', 'ul class="social-links"', 'section class="comments"', 'div class="ad-slot-2"', 'div class="newsletter-signup"']:
        name = tag.split()[0]
        html = f"<article><h1>Title</h1><p>{text}</p><p>{text}</p><{tag}>{links}</{name}><p>Last {text}</p></article>"
        assert html_text.main_text(html) == "\n\n".join(["Title", text, text, f"Last {text}"]), tag
    comments = f'<article><h1>Title</h1><p>{text}</p><p>{text}</p><div id="comments"><p>Reader: {text}</p><p>Reader: {text}</p></div></article>'
    assert html_text.main_text(comments) == "\n\n".join(["Title", text, text])


@pytest.mark.parametrize("form", ["<b>" * 40000 + "</i>" * 40000, "<i><div>" + "<b>" * 40000 + "</i>" * 40000, "<b>" * 40000 + "<li></li>" * 40000, "<div>" * 40000 + "</section>" * 40000, "<p><b>" * 40000])
def test_deep_pages_take_time_in_proportion(form):
    import time

    start = time.perf_counter()
    found = html_text.main_text(f"<article><p>Some words of a text here</p>{form}<p>And some more of these words</p></article>")
    assert time.perf_counter() - start < 10 and found.startswith("Some words of a text here")
