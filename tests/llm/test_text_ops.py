import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspark.llm import bpe, html_extract, toxicity

SF = "/root/testdata/sf0.001"


def test_bpe_same_as_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = ["", None, " ", "  a  b\n\n c ", "it's we'll <|endoftext|>x <|endoftext|>", "a" * 3000, "ab" * 400 + " é" * 300, "\x1c x\x85y　z   q", "tab\tend\t", "𝒳😀 12,345.67--", "don't  'stop", "x\n y", "﻿bom", "İ ſ ǅ"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(odd, 10**6)), "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs))).collect()}
    t = Tokenizer.from_file(path)
    assert len(got) == len(texts)
    for i, x in texts.items():
        ids = t.encode(x, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), x
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs.limit(0)).count() == 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, sf).collect()}
    assert len(got) == docs.count()
    said = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    hit = sum(p == y == 1 for p, y in said)
    assert hit >= 0.8 * sum(y for _, y in said) and hit >= 0.9 * sum(p for p, _ in said)
    edge = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "you idiot. fine.", 3), (3, "you idiot. fine.", 3), (None, "é" * 9, 4)], "doc_id long, text string, score int")
    w = toxicity.train(docs, labels)
    rows = toxicity.score(edge, w).collect()
    assert [r.score for r in rows[:2]] == [0, 0] and rows[2].score == rows[3].score and len(rows) == 5
    assert toxicity.train(docs, labels.limit(0))[0].any() == 0


@pytest.mark.parametrize("labelled", ["both", "clean", "toxic", "none"])
def test_length_alone_is_not_toxic(spark, labelled):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    joined = docs.join(labels, "doc_id").select("toxic", "text").orderBy("doc_id").collect()
    clean = " ".join(r.text for r in joined if r.toxic == 0)
    clean *= 1 + 100_000 // len(re.findall("[.!?\n]", clean))
    long = [clean, "Some words of a plain line. " * 100_000, "." * 100_000, "\n" * 100_000]
    w = toxicity.train(docs, labels.where({"both": "true", "clean": "toxic = 0", "toxic": "toxic = 1", "none": "false"}[labelled]))
    rows = toxicity.score(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), w).orderBy("doc_id").collect()
    assert all(r.score < 0.5 and not r.offending for r in rows) and rows[2].score == rows[3].score == 0
    if labelled != "both":
        assert all(r.score == 0 for r in rows)
        return
    toxic = [r.text for r in joined if r.toxic == 1]
    bad = [t.encode()[o.start : o.end].decode() for t, r in zip(toxic, toxicity.score(spark.createDataFrame([(t,) for t in toxic], "text string"), w).collect(), strict=True) for o in r.offending]
    assert bad and toxicity.score(spark.createDataFrame([(clean + bad[0],)], "text string"), w).first().score >= 0.5


def test_toxicity_against_brute_force(spark):
    """Scores are those of the trained noisy-or, sentence by sentence."""
    import math

    from loomspark.llm import textbytes as tb
    import pyarrow as pa

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    w, bias, leak = toxicity.train(docs, labels)
    assert w.any() and leak > 0
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["", None, "...", "no"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, (w, bias, leak)).collect():
        total, bad, at = 0.0, [], 0
        for sentence in re.split("(?<=[.!?\n])", texts[r.doc_id] or ""):
            f = toxicity.features(*tb.utf8(pa.array([sentence])))[0]
            z = bias + float(w[f].sum())
            given = max(0.0, math.log1p(math.exp(-abs(z))) + max(z, 0.0) - leak) if w[f].any() else 0.0
            end = at + len(sentence.encode())
            bad += [(at, end)] if 1 - math.exp(-given) >= 0.5 else []
            total, at = total + given, end
        assert r.score == pytest.approx(1 - math.exp(-total), abs=1e-4) and [(o.start, o.end) for o in r.offending] == bad


def test_toxicity_learns_within_its_bounds(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").select(*c) for t, c in (("documents", ["doc_id", "text"]), ("labels", ["doc_id", "toxic"])))
    again = docs.unionByName(docs).unionByName(docs)  # rows that repeat a labelled id
    assert toxicity.train(again, labels)[0].any()
    full, few = toxicity.train(docs, labels)[0], toxicity.train(docs, labels, most_bytes=400_000)[0]
    assert 0 < (few != 0).sum() < (full != 0).sum()
    huge = docs.withColumn("text", F.concat("text", F.repeat(F.lit(" stupid idiot."), 200_000)))
    assert not toxicity.train(huge.limit(3), labels)[0].any()  # too long to learn from
    none = spark.createDataFrame([], "doc_id long, text string, offending int")
    assert not toxicity.train(none, labels)[0].any() and toxicity.score(none, toxicity.train(docs, labels)).count() == 0


def test_toxicity_sentences_stay_in_their_document():
    from loomspark.llm import textbytes as tb
    import pyarrow as pa

    f, owner, doc, s, e = toxicity.features(*tb.utf8(pa.array(["ab", "cd ef. gh", "", "ij"])))
    assert doc.tolist() == [0, 1, 1, 3]
    assert sorted(owner.tolist()) == [0, 1, 1, 2, 3]


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page">
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></ul></nav><div class="ad">Buy this now, a long advert that has a good many words in it.</div>
%s<h1>A &amp; B</h1><p>First   <b>paragraph</b> with&nbsp;text, long enough to count as an article, surely.<br>Next line.
<p>Short.</p><form><input><p>Your name please</p></form><p>Second paragraph is also of a fair length, so that it counts &#233;.</p>%s
<div id="comments"><p>A reader says something long enough to count, but it is only a comment here.</p></div><aside>Side</aside><footer>&copy; me</footer></body></html>"""
WANT = "A & B\nFirst paragraph with text, long enough to count as an article, surely. Next line.\nShort.\nSecond paragraph is also of a fair length, so that it counts é."


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>")])
def test_main_text_in_an_element(around):
    assert html_extract.main_text(PAGE % around) == WANT


def test_main_text_without_an_element():
    assert html_extract.main_text(PAGE % ("<div>", "</div>")).endswith(WANT.split("\n", 1)[1])


LONG = ["A paragraph of the article that is long enough to surge by itself, number %d of them." % k for k in range(4)]
SHORT = [f"Item {k}" for k in range(12)]


@pytest.mark.parametrize("part", ["<ul>%s</ul>", "<table>%s</table>", "<div>%s</div>"])
@pytest.mark.parametrize("container", ["<div class=content>%s</div>", "<section>%s</section>", "<div><div>%s</div></div>", "%s"])
@pytest.mark.parametrize("n", [1, 2])
def test_main_text_in_a_div_is_whole(part, container, n):
    row = {"<ul>": "<li>%s</li>", "<tab": "<tr><td>%s</td></tr>", "<div": "<p>%s</p>"}[part[:4]]
    middle, end = (part % "".join(row % x for x in xs) for xs in (SHORT, SHORT[:5]))
    body = "<h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in LONG[:n]) + middle + "".join(f"<p>{x}</p>" for x in LONG[n:]) + "<p>The end.</p>"
    want = ["Title", *LONG[:n], *SHORT, *LONG[n:], "The end."]
    if container != "%s":  # a light container beside the text stays out, a list or table in it doesn't
        body, want = body + end, [*want, *(SHORT[:5] if part[:4] != "<div" else [])]
    beside = "<div><a href=x>One link</a></div><div><p>Three words only</p></div>"
    assert html_extract.main_text(f"<html><body>{beside}{container % body}{beside}</body></html>") == "\n".join(want)


@pytest.mark.parametrize("around", [("<div>", "</div>"), ("<section>", "</section>"), ("", "")])
def test_main_text_without_an_element_has_its_title(around):
    assert html_extract.main_text(PAGE % around) == WANT


ARTICLE = "".join(f"<p>Paragraph number {k} of the article tells in some detail what has happened here and why.</p>" for k in range(6))
PLAIN = "\n".join(f"Paragraph number {k} of the article tells in some detail what has happened here and why." for k in range(6))
WRAPPERS = ['div class="site has-sidebar"', 'div class="post no-comments"', 'div id="search-algorithms"', 'div title="The hidden valley"', "form action=/x", 'div class="notice"', 'div class=modal', 'div class="category-legal tag-social"', 'div data-x="display:none"', 'section class="with_ads"']


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_no_wrapper_takes_the_article_away(wrapper):
    end = wrapper.split(" ")[0]
    assert html_extract.main_text(f"<html><body><nav><a href=/>Home</a></nav><{wrapper}>{ARTICLE}</{end}><footer>(c) me</footer></body></html>") == PLAIN


NAMED = ['class="sidebar"', 'class="left-sidebar"', 'class="site-footer"', "class=ad", 'class="x ad-slot"', 'id="comments-area"', 'class="post-comments"', 'class="share_buttons"', 'id="comments"', 'role="complementary"', "hidden", 'style="color:red; display: none"']


@pytest.mark.parametrize("name", NAMED)
def test_named_elements_stay_out(name):
    """However much they hold, as long as there is an article beside or around them."""
    for lines in (1, 3):
        more = "".join(f"<p>Something else, number {k}, that is long enough to surge all by itself at this place.</p>" for k in range(lines))
        for page in (f"<div>{ARTICLE}<div {name}>{more}</div></div>", f"<div>{ARTICLE}</div><div {name}>{more}</div>"):
            assert html_extract.main_text(f"<html><body>{page}</body></html>") == PLAIN
    many = "".join(f"<p>A reader writes a very long comment, number {k}, about the article and all that is in it.</p>" for k in range(60))
    assert html_extract.main_text(f"<html><body><div>{ARTICLE}</div><div class='user-comments'>{many}</div></body></html>") == PLAIN


def test_an_article_keeps_its_header_and_light_neighbours_stay_out():
    for header in ("<header class='entry-header'><h1>The title</h1></header>", "<div class='entry-header'><h1>The title</h1></div>", "<div class=t><h1>The title</h1></div>"):
        for around in ("<article>%s</article>", "<main>%s</main>") if header.startswith("<header") else ("<article>%s</article>", "<div>%s</div>"):
            assert html_extract.main_text("<html><body>" + around % (header + ARTICLE) + "</body></html>") == "The title\n" + PLAIN
    beside = "<div><p>Read next: a teaser.</p></div><div><p>anna</p><p>Nice text!</p></div>"
    for text in (f"<div>{ARTICLE}</div>", f"<div class=t><h1>The title</h1></div><div>{ARTICLE}</div>"):
        want = "The title\n" * ("h1" in text) + PLAIN
        assert html_extract.main_text(f"<html><body><div>{text}{beside}</div></body></html>") == want
        assert html_extract.main_text(f"<html><body>{text}{beside}</body></html>") == want
    blocks = ARTICLE.replace("<p>", "<div>").replace("</p>", "</div>") + "<div>A short last one.</div>"
    assert html_extract.main_text(f"<html><body><div>{blocks}</div></body></html>") == PLAIN + "\nA short last one."


def test_extract_of_an_empty_table(spark):
    none = html_extract.extract(spark.createDataFrame([], "page_id long, html string, text int"))
    assert none.count() == 0 and none.schema["text"].dataType.simpleString() == "string"


def test_extract_edges(spark):
    rows = [(1, None), (2, ""), (3, "plain words only"), (4, "<p>a"), (5, "<article>" + "<p>word word</p>" * 5000), (5, "<!-- x"), (6, "<a<b<<>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert [r.text for r in got[:4]] == ["", "", "plain words only", "a"]
    assert len(got) == 7 and got[4].text.count("\n") == 4999


def test_all_pages(spark):
    """Against the article element's blocks; the same page with a div in its place gives the same text."""
    import html as h

    for r in html_extract.op4_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert html_extract.main_text(re.sub(r"(</?)(?:article|main)\b", r"\1div", r.html)) == r.text
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1].split("<footer")[0]
        body = re.sub(r"<br>", " ", body)
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_new_words_of_a_batch_are_merged_together(monkeypatch):
    """No word of ordinary text goes through the merging by itself, whatever the caches hold, and the ids are those of single words."""
    import random

    with open(bpe.default_tokenizer()) as f:
        spec = f.read()
    coder, single = bpe.ByteBPE(spec), bpe.ByteBPE(spec)
    rng = random.Random(3)
    texts = ["", None, " ", "a", "  a  b ", "a.\nb", "x\n's it 's", "x\r\ny", "q " + "é" * 127 + " é", "a" * 127 + " " + "b" * 127 + "\n" + "c" * 300 + " d", ("xy" * 200) + " z", "中文" * 90, "é\x1cb\n\x1cc"]
    texts += ["".join(rng.choice(" abcdethé\n'12.,中\t\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    want = [b"".join(bpe.np.array(single.merge(w.encode()), "<u4").tobytes() for w in bpe._WORD.findall(t or "")) for t in texts]
    monkeypatch.setattr(bpe.ByteBPE, "merge", lambda self, word: pytest.fail("a word by itself"))
    for cache in (bpe.CACHE, 50, 0):
        monkeypatch.setattr(bpe, "CACHE", cache)
        for size in (1, 7, 400):
            assert [x for i in range(0, len(texts), size) for x in coder.encode_all(texts[i : i + size])] == want
