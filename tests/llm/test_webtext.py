import html
import random
import time

import pytest

from palimpsest.llm.queries import op12_tag_path_ratios
from palimpsest.llm.webtext import main_blocks, main_text

WORDS = "Nebel über dem Fluss und ein Boot, das leise treibt; viel später kam niemand zurück".split()


def sentence(rng, least, most):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))) + "."


def furniture(rng):
    links = "".join(f'<li><a href="/{i}">{sentence(rng, 1, 3)}</a></li>' for i in range(rng.randint(3, 9)))
    say = sentence(rng, 5, 40)
    return [
        f"<nav><ul>{links}</ul></nav>",
        f"<header><p>{say}</p></header>",
        f'<div class="sidebar"><h3>Mehr</h3><p>{say}</p></div>',
        f'<aside><p>{say}</p></aside>',
        f'<div id="cookie-notice">{say} <button>OK</button></div>',
        f'<div class="ad-slot">{say}</div>',
        f'<div class="topMenu"><a href="/">{say}</a></div>',
        f'<form action="/s"><label>{say}</label><input name=q><select><option>{say}</select></form>',
        f'<div role="search">{say}</div>',
        f"<script>if (a<b) document.write('<p>{say}</p>')</script>",
        f"<style>p > a {{ color: red }} /* {say} */</style>",
        f"<!-- <p>{say}</p> -->",
        f'<div style="display: none">{say}</div>',
        f'<ul class="pagination">{links}</ul>',
    ]


def after(rng):
    say = "".join(f"<li><article class=comment><p>{sentence(rng, 5, 60)}</p></article></li>" for _ in range(4))
    return [f'<section class="comments"><h2>Kommentare</h2><ol>{say}</ol></section>', "<footer>&copy; 2020 Verlag.</footer>"]


def content(rng):
    """Blocks of an article, and their html."""
    blocks, out = [sentence(rng, 2, 6)], []
    out.append(f"<h1>{blocks[0]}</h1>")
    for _ in range(rng.randint(3, 9)):
        kind, text = rng.random(), sentence(rng, 25, 90)
        if kind < 0.6:
            a, b = text[: len(text) // 2], text[len(text) // 2 :]
            out.append(rng.choice([f"<p>{text}</p>", f"<p>{a}<b>{b}</b>", f"<p class=x>\n {a}<a href='?a>b'>{b}</a> </p>"]))
            blocks.append(text)
        elif kind < 0.75:
            items = [sentence(rng, 3, 9) for _ in range(3)]
            out.append("<p>" + text + "</p><ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            blocks += [text, *items]
        elif kind < 0.85:
            out.append(f"<blockquote><p>{text}</p></blockquote><h2>Jürgen &amp; S&ouml;hne &#8364;</h2>")
            blocks += [text, "Jürgen & Söhne €"]
        else:
            out.append(f"<p>{text}<br>{text}</p><p>Ja.</p>")
            blocks += [f"{text} {text}", "Ja."]
    return blocks, "".join(out)


@pytest.mark.parametrize("opens, closes", [
    ("<article>", "</article>"), ('<main id="c">', "</main>"), ('<div role="main"><div>', "</div></div>"),
    ('<div class="col"><div class="c1">', "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("", ""),
])
def test_pages_of_known_content(opens, closes):
    rng = random.Random(opens)
    for _ in range(60):
        blocks, inner = content(rng)
        page = "<!DOCTYPE html><html><head><title>T &amp; t</title></head><body>"
        page += "".join(rng.sample(furniture(rng), 6)) + opens + inner + closes
        page += "".join(after(rng)) + "".join(rng.sample(furniture(rng), 3)) + "</body></html>"
        assert main_blocks(page) == blocks


def test_references_white_space_and_broken_markup():
    page = "<article><h1>A&nbsp;&lt;b&gt; &amp c &#x41;&bogus;</h1><p><b>x\n\t y<br><p>1 < 2 & 3 > 2</i></p></section>z</article>"
    assert main_blocks(page) == ["A <b> & c A&bogus;", "x y", "1 < 2 & 3 > 2", "z"]
    assert main_blocks("<article><p>a</article><nav>b") == ["a"]
    assert main_blocks("<article>a<p title='never ends>b</p>") == ["a", "b"]
    assert main_blocks("only words") == ["only words"]
    assert main_blocks("<nav>a</nav><footer>b</footer>") == []
    assert main_blocks("<p>a</p><a href=") == ["a"]


def test_long_pages_cost_in_proportion():
    hard = [
        "<a ", '<a b="x>', '<a ">x" ', "<div>", "<div>x", "<p><b>x", "<!--", "<script>", "<div class='a b'>x</div>", "<li>x",
        "</div>", "&amp", "<td>x", "<ul>", "<tr><td>x", "<table>x", "x. ", "<p><table><td><div>",
    ]
    for unit in hard:
        def seconds(n, unit=unit):
            begun = time.perf_counter()
            main_blocks(unit * (n // len(unit)))
            return time.perf_counter() - begun

        assert seconds(400_000) < 6 * seconds(100_000) + 1, unit


def test_rows_of_every_kind(spark):
    page = "<article><p>Ein Satz.</p></article>"
    rows = [(1, "u", page, "t"), (1, None, page, "t"), (None, "u", page, "t"), (2, "u", None, "t"), (3, "u", "", "t"), (4, "u", "<br>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, main_text(df).collect()), key=repr)
    said = [(1, "u"), (1, None), (None, "u")]
    empty = [(2, "u"), (3, "u"), (4, "u")]
    assert got == sorted([(*k, "Ein Satz.", 9) for k in said] + [(*k, "", 0) for k in empty], key=repr)
    assert main_text(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]
    assert main_text(df.limit(0)).count() == 0


def test_query_keeps_every_article(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        said = [sentence(rng, 1, 60) for _ in range(rng.randint(1, 5))]
        rows.append((i, "http://x", "<nav>n</nav><article><p>" + "</p><p>".join(map(html.escape, said)) + "</article><footer>f</footer>", "\n".join(said)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in op12_tag_path_ratios(spark, str(tmp_path)).collect()}
    assert got == {r[0]: (r[3], len(r[3])) for r in rows}
