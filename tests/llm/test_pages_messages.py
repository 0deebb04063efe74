"""Article extraction and quotation links."""

import random
import re

import pytest

from noctule.llm import extract, quotes

PROSE = "Some longer sentence, with commas, and enough words to count as prose in any reading."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain  text\nonly", "plain text only"), ("<p>a<b>b</b> c&nbsp;d<br>e</p>", "ab c d e"), ("<script>var a = '<p>no</p>'</script>", ""),
    (f"<body class='has-sidebar'><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div id=main><h2>Title</h2><p>{PROSE}<p>Short.<ul><li>one<li>two</ul></div>"
     "<div class='side-bar'>Side, with, many, commas, and a lot of words that go on and on</div><footer>f</footer></body>", f"Title {PROSE} Short. one two"),
    (f"<article><header><h1>T &amp; U</h1></header><p>{PROSE}</p><aside>x</aside><form><p>Mail, please, write, to us, and so on and so forth</p></form><div class='cookie-notice'>We use cookies</div></article>"
     f"<section id='comments'><p>{PROSE} {PROSE} {PROSE}</p></section>", f"T & U {PROSE}"),
    (f"<div class=ad>Buy, now</div><div><div><p>{PROSE}</p></div><div><p>{PROSE} More.</p></div></div><!-- <p>hidden</p> --><p style='display:none'>{PROSE}</p>", f"{PROSE} {PROSE} More."),
    (f"<table><tr><td><p>{PROSE}<td>cell</table><p>a < b and {PROSE}", None),
    ("<a <a <a" * 2000, None), ("<div>" * 3000 + PROSE, PROSE), (f"<p>{PROSE} " * 3000, " ".join([PROSE] * 3000)),
])
def test_pages(page, text):
    got = extract.main_text(page)
    assert text is None or got == text


def test_table_of_pages(spark):
    rows = spark.createDataFrame([(1, "<p>" + PROSE, 5), (1, "<p>" + PROSE, 5), (2, None, 5)], "page_id long, html string, n_chars int")
    assert [(r["text"], r["n_chars"]) for r in extract.extract(rows).collect()] == [(PROSE, len(PROSE))] * 2 + [("", 0)]
    assert extract.extract(rows.limit(0)).collect() == []


def test_articles_of_the_table(spark):
    import html
    import re
    for r in extract.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect():
        own = re.sub(r"</?(p|h1|br)\b[^>]*>", "\n", re.search(r"<article>(.*)</article>", r["html"], re.S)[1])
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", "", own)).split()) and r["n_chars"] == len(r["text"])


LONG = f"<p>{PROSE}</p><p>{PROSE} Two.</p>"
BOTH = f"{PROSE} {PROSE} Two."


@pytest.mark.parametrize("page, text", [
    (f"<h1>T</h1><div class='layout has-sidebar'>{LONG}</div>", f"T {BOTH}"), (f"<p>x</p><div class='content-with-ads'><article>{LONG}</article></div>", BOTH),
    (f"<h1>T</h1><div id='page' class='no-comments'><main>{LONG}</main></div>", f"T {BOTH}"), (f"<p>stray</p><div class='sidebar-layout'><article>{LONG}</article><div class=sidebar><p>{PROSE} x</p></div></div>", BOTH),
    (f"<p>stray</p><div class='wrap-sidebar'><div>{LONG}</div><div id=comments><p>{PROSE} a</p><p>{PROSE} b</p><p>{PROSE} c</p></div></div>", BOTH),
    (f"<div class='page comments-open'><article>{LONG}</article><div id=comments><article class=c>{LONG}{LONG}</article></div></div>", BOTH),
    (f"<article>{LONG}</article><div class='related-box'><p>{PROSE}</p></div><div class=sidebar>{LONG}{LONG}</div>", BOTH),
    (f"<div>{'<div class=ad-x>' * 2000}<p>{PROSE}", PROSE),
    (f"<div><div><p>{PROSE}</p><p>{PROSE}</p></div><div><p>A short section, of one line, beside it.</p></div></div>", f"{PROSE} {PROSE} A short section, of one line, beside it."),
])
def test_names_of_layouts_and_short_sections(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<!DOCTYPE html><p>P</p><p>P</p>", "P P"), ("<?xml version='1.0'?><p>P</p>", "P"), ("<!doctype html PUBLIC \"-//W3C//DTD\"><html><p>P", "P"), ("<p>a</ >b<![CDATA[x]]>c<!->d</p>", "abcd"),
    (f"<h1>Title of it</h1><div>{LONG}</div>", f"Title of it {BOTH}"), (f"<div class=post><h1>Title</h1></div><div class=body>{LONG}</div>", f"Title {BOTH}"),
    (f"<div><h1><a href=/>Site</a></h1></div><div><h1>Title <em>of it</em></h1><span>By me</span></div><div class=body>{LONG}</div>", f"Title of it {BOTH}"),
    (f"<h1>Site</h1><article><h1>Own</h1>{LONG}</article>", f"Own {BOTH}"), (f"<h1>Page</h1><div><h2>Right before</h2></div><div>{LONG}</div>", f"Page Right before {BOTH}"),
    (f"<div><h2>Right before</h2></div><div>{LONG}</div>", f"Right before {BOTH}"), (f"<h1>T</h1><nav><h1>N</h1></nav><div>{LONG}</div><h1>Later</h1>", f"T {BOTH}")])
def test_declarations_and_titles(page, text):
    assert extract.main_text(page) == text


def generated(rng):
    """A page whose article is known, and its text: paragraphs, headings and lists among what is none of it."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    prose = lambda: " ".join(word() + rng.choice(["", "", "", ","]) for _ in range(rng.randrange(25, 60))) + "."
    title, parts, text = f"Title {word()}", [], []
    for _ in range(rng.randrange(3, 8)):
        kind = rng.choice(["p", "p", "p", "list", "h2"])
        if kind == "list":
            items = [prose() for _ in range(3)]
            parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            text += items
        else:
            line = prose() if kind == "p" else f"Part {word()}"
            parts.append(f"<{kind}>{line[:9]}<b>{line[9:]}</b></{kind}>")
            text.append(line)
    parts.append(f"<p>{prose()}</p>")
    text.append(re.search(r"<p>(.*)</p>", parts[-1])[1])
    menu = "<ul>" + "".join(f"<li><a href=/{i}>{word()} {word()}</a></li>" for i in range(8)) + "</ul>"
    noise = [f"<nav>{menu}</nav>", f"<div class='sidebar'><p>{prose()}</p></div>", f"<footer><p>{prose()}</p></footer>", f"<div id=cookie-consent><p>{prose()}</p></div>",
             f"<div class='ad-box'>{prose()}</div>", f"<section class=comments><p>{prose()}</p><p>{prose()}</p></section>", f"<script>var x = '<p>{prose()}</p>'</script>", f"<form><p>{prose()}</p></form>",
             f"<div class=links>{menu}</div>", "<!-- <p>no</p> -->"]
    rng.shuffle(noise)
    cut = rng.randrange(len(noise))
    body, outside = "".join(parts), f"<h1>{title}</h1>"
    body = rng.choice([f"<article>{outside}{body}</article>", f"<div class=content>{outside}{body}</div>", f"<main><div>{outside}</div><div>{body}</div></main>", f"{outside}<div>{body}</div>"])
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(noise[:cut])}{body}{''.join(noise[cut:])}</body></html>", " ".join([title, *text])


@pytest.mark.parametrize("seed", range(200))
def test_generated_pages(seed):
    page, text = generated(random.Random(seed))
    assert extract.main_text(page) == text


MESSAGES = [
    (1, 0, "Hello world.\nHow are you?"), (1, 1, "On Monday, Bob wrote:\n> Hello world.\n> How are\n> you?\n\nFine, thanks.\nAnd you?"), (1, 2, "> > How are you?\n> And you?\nGreat."),
    (1, 3, "> Great.\n>> And you?\n ok"), (1, 4, ">Never said\nx"), (2, 0, "> Hello world.\ny"), (2, None, "> y\nz"), (None, 3, "> y"), (3, 0, None), (3, 1, ""), (1, 4, ">Never said\nx"),
    (4, 5, "> Hello world"), (4, 2, "> Great\nHello World!"),
]


def test_links(spark):
    rows = spark.createDataFrame([(*m, 7) for m in MESSAGES], "conv_id long, turn long, text string, root int")
    got = {(r["conv_id"], r["turn"]): (r["text"], r["parent"], r["root"], r["reply_depth"], r["n_linked"]) for r in quotes.link(rows).collect()}
    assert quotes.link(rows).count() == len(MESSAGES) and quotes.link(rows.limit(0)).collect() == []
    assert got == {
        (1, 0): ("Hello world.\nHow are you?", None, 0, 0, 0), (1, 1): ("Fine, thanks.\nAnd you?", 0, 0, 1, 2), (1, 2): ("Great.", 1, 0, 2, 1), (1, 3): ("ok", 2, 0, 3, 1),
        (1, 4): ("x", None, 4, 0, 0), (2, 0): ("y", None, 0, 0, 0), (2, None): ("z", None, None, 0, 0), (None, 3): ("", None, 3, 0, 0), (3, 0): (None, None, 0, 0, 0),
        (3, 1): ("", None, 1, 0, 0), (4, 5): ("", 2, 2, 1, 1), (4, 2): ("Hello World!", None, 2, 0, 0)}


def test_a_long_chain_and_a_common_line(spark):
    chain = [(1, 0, "line 0\nthanks")] + [(1, i, f"> line {i - 1}\n> thanks\nline {i}\nthanks") for i in range(1, 70)]
    got = {r["turn"]: r for r in quotes.link(spark.createDataFrame(chain, "conv_id long, turn long, text string")).collect()}
    # the common line alone was first said in message 0; with the line before it the whole run is the previous message's
    assert all(got[i]["parent"] == i - 1 and got[i]["root"] == 0 and got[i]["reply_depth"] == i for i in range(1, 70))


def test_nested_levels_and_sentences(spark):
    rows = [(1, 0, "One thing was said here. Another thing was said, and more.\nA third line"), (1, 1, "> edited\n>> A third line\nyes"), (1, 2, ">>> A third line\n> edited too\nno"),
            (1, 3, "> Another thing was said,\n> and more.\nso"), (1, 4, "> yes\n>> A third line\nwell"), (1, 5, ">> so\n>>> One thing was said here.\n> unknown\nend"), (2, 0, ">> A third line"),
            (3, 0, 'He said "go." Then he left.'), (3, 1, '> Then he left.\nok')]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert {k: r["parent"] for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 4): 1, (1, 5): 3, (2, 0): None, (3, 0): None, (3, 1): 0}
    links = {k: [(x["level"], x["original"]) for x in r["links"]] for k, r in got.items()}
    assert links == {(1, 0): [], (1, 1): [(2, 0)], (1, 2): [(3, 0)], (1, 3): [(1, 0)], (1, 4): [(1, 1), (2, 0)], (1, 5): [(2, 3), (3, 0)], (2, 0): [], (3, 0): [], (3, 1): [(1, 0)]}
    assert [(got[1, i]["n_quoted"], got[1, i]["n_linked"], got[1, i]["n_all_quoted"], got[1, i]["n_all_linked"]) for i in (1, 4)] == [(1, 0, 2, 1), (1, 1, 2, 2)]
    assert got[1, 5]["root"] == 0 and got[1, 5]["reply_depth"] == 2
