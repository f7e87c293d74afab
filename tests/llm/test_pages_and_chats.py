"""HTML extraction and chat formatting."""

import hashlib
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillframe.llm import chat_format, html_text, queries

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad">Buy <b>this</b> now, it is very good indeed</div>
<article><h1>Head &amp; line</h1><p>First   paragraph<p>Second <i>one</i>&nbsp;here<div id="comments"><p>I liked it a lot</div><script>var t="</p>";</script></article><footer>&copy; me</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "<p>" * 3000), (5, "u", "<a <b"), (1, "u", PAGE)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    got = [(r.page_id, r.main_text) for r in out.collect()]
    expected = "Head & line\nFirst paragraph\nSecond one here"
    assert sorted(got) == sorted([(1, expected), (2, ""), (3, ""), (4, ""), (5, ""), (1, expected)])


def test_tree_fits_its_pages():
    rows = html_text.labelled_blocks()
    tree = html_text.grow(rows)
    assert 100 < len(rows) < 200 and sum(html_text.decide(tree, tuple(r[:-1])) == bool(r[-1]) for r in rows) == len(rows)


def _page(rnd):
    """A page of a layout that the labelled pages lack, with the texts of its main blocks."""
    serial = iter(range(10**6))
    said = lambda n: " ".join(f"w{next(serial)}" for _ in range(n))
    main = [said(rnd.choice((3, 9, 20, 40, 70, 150))) for _ in range(rnd.randint(1, 7))]
    body = "".join(f"<p>{t}</p>" if rnd.random() < 0.85 else f"<p>{t.replace(' ', ' <em>', 1)}</em>" for t in main)
    title = said(rnd.randint(2, 9))
    links = lambda n: "".join(f'<li><a href="/{k}">{said(rnd.randint(1, 3))}</a></li>' for k in range(n))
    menu = rnd.choice((f"<nav><ul>{links(5)}</ul></nav>", f'<div id="mainMenu"><ul>{links(6)}</ul></div>', f"<ul>{links(4)}</ul>"))
    extra = rnd.choice(("", f'<div class="cookie-notice"><p>{said(30)}</p></div>', f'<div class="sidebar widget"><h3>{said(2)}</h3><p>{said(25)}</p></div>', f'<form action="/"><p>{said(12)}</p></form>'))
    after = rnd.choice(("", f"<footer><p>{said(20)}</p></footer>", f'<div class="site-footer">{said(9)}</div>', f'<section id="comments"><p>{said(50)}</p><p>{said(8)}</p></section>'))
    open_, close = rnd.choice((("<article>", "</article>"), ("<main><section>", "</section></main>"), ('<div class="entry"><div class="share-of-market">', "</div></div>"), ("<div>", "</div>")))
    return f"<html><head><title>{said(3)}</title></head><body>{menu}{extra}{open_}<h1>{title}</h1>{body}{close}{after}</body></html>", [title, *main]


def test_main_text_of_pages_of_other_layouts():
    rnd, tree = random.Random(3), html_text.grow(html_text.labelled_blocks())
    kept = wanted = right = 0
    for _ in range(400):
        page, main = _page(rnd)
        got = html_text.main_text(page, tree).split("\n")
        wanted, kept, right = wanted + len(main), kept + len(got), right + len(set(got) & set(main))
    assert right >= 0.95 * wanted and right >= 0.95 * kept


def test_class_names_count_only_as_a_whole():
    tree = html_text.grow(html_text.labelled_blocks())
    text = "word " * 30
    for name in ("share-of-market", "notice-period", "advertising-history", "menuhin", ""):
        assert html_text.main_text(f'<article><p class="{name}">{text}</p><p>{text}</p></article>', tree).count("\n") == 1, name
    for name in ("comment-list", "adBox", "cookie_banner", "x ads-300", "social share"):
        assert "\n" not in html_text.main_text(f'<article><div class="{name}"><p>{text}</p></div><p>{text}</p></article>', tree), name


def test_long_nested_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<div>" * 90_000 + "x" + "</div>" * 90_000, '<span class="ad">' * 40_000 + "x" + "</span>" * 40_000, "<p><ul><li>" * 60_000, "</div>" * 150_000, '<a "' * 200_000, "<!--" * 200_000):
        html_text.blocks_of(page)
    assert time.perf_counter() - began < 12
    assert [b.text for b in html_text.blocks_of('<p title="x>one</p><p>two</p>')] == ["one", "two"]


def test_escaping_is_reversible():
    t, rnd = chat_format.INSTRUCT, random.Random(0)
    parts = [*t.controls, "\\", "<", "[", "s>", "INST]", "/", " ", "x", "é", "\n", "<s", "</"]
    for _ in range(2000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 10)))
        escaped = t.escape(text)
        assert t.unescape(escaped) == text and not any(c in escaped for c in t.controls)
    for _ in range(300):
        turns = [(rnd.choice(("system", "user", "assistant", "tool", "", "[TEXT]", "<s> ")), "".join(rnd.choices(parts, k=rnd.randint(0, 10)))) for _ in range(rnd.randint(0, 6))]
        whole = "".join(s for role, text in turns for s, _ in t.segments(role, text))
        for step in (1, 7, 10_000):
            reader = t.reader()
            assert [x for k in range(0, len(whole), step) for x in reader.feed(whole[k : k + step])] == turns and reader.done
    with pytest.raises(ValueError):
        list(t.reader().feed("no mark"))


def test_conversations(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "</s>[INST] ok"), (2, 0, "assistant", "first"), (2, 1, None, None), (None, 0, "user", "who"), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, None, "user", "q"), (4, 1, "assistant", "")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("error", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.digests(d).collect()}
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == hexed("system\nbe kind\nuser\nhi\nassistant\n</s>[INST] ok\n") and got[1].valid
    assert (got[1].loss_chars, got[1].loss_sha256) == (13, hexed("</s>[INST] ok"))
    assert not got[2].valid and got[2].turns_sha256 == hexed("assistant\nfirst\n\n\n") and not got[None].valid and got[3].n_turns == 2 and got[4].valid
    assert chat_format.digests(d.limit(0)).count() == 0
    turns = chat_format.format_turns(d).filter("conv_id = 1").orderBy("n").collect()
    assert [[s.loss for s in r.segments] for r in turns] == [[False] * 3, [False] * 3, [False, True, False]]


def test_query_equals_brute_force(spark):
    """Every conversation of the smallest table, and the one of control strings."""
    sf, expected = "/root/testdata/sf0.001", {}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for conv, _, role, text in sorted([*rows, *queries._TRICKY], key=lambda r: (r[0], r[1])):
        own = expected.setdefault(conv, [0, "", ""])
        expected[conv] = [own[0] + 1, f"{own[1]}{role}\n{text or ''}\n", own[2] + ((text or "") if role == "assistant" else "")]
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op1_chat_format(spark, sf).collect()}
    assert -1 in got and got == {k: (n, hexed(said), len(lost), hexed(lost)) for k, (n, said, lost) in expected.items()}


def test_a_long_conversation_of_one_key(spark):
    turns = 20_000
    d = spark.range(turns).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s> said "), F.col("id")).alias("text"))
    got = chat_format.digests(d).collect()
    said = "".join(f"{'assistant' if k % 2 else 'user'}\n</s> said {k}\n" for k in range(turns))
    assert len(got) == 1 and got[0].n_turns == turns and got[0].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[0].valid


class PlainBlocks(HTMLParser):
    """Blocks of well-formed pages from the standard parser's events: a block ends where an element that makes blocks, or that is boilerplate, begins or ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.out = [], [], []

    def cut(self):
        text = " ".join("".join(t for t, _ in self.parts).split())
        kept = [x for x in self.stack if x[0] not in html_text.SILENT]
        if text and len(kept) == len(self.stack):
            linked = sum(len(t.split()) for t, x in self.parts if x)
            inner = next((n for n, _, _ in reversed(self.stack) if n in html_text.BLOCKS), "")
            kind = "heading" if inner in html_text.HEADINGS else "paragraph" if inner in html_text.PARAGRAPHS else ""
            names = {n for n, _, _ in self.stack}
            self.out.append((text, len(text.split()), min(1.0, linked / len(text.split())), kind, bool(names & {"article", "main"}), any(b for _, b, _ in self.stack), any(m for _, _, m in self.stack)))
        self.parts = []

    def handle_starttag(self, name, attributes):
        if name == "br":
            self.parts.append((" ", False))
            return
        boiler, marked = html_text._marks(name, " ".join(f'{k}="{v}"' for k, v in attributes))
        if name in html_text.BLOCKS or boiler or marked:
            self.cut()
        self.stack.append((name, boiler, marked))

    def handle_endtag(self, name):
        assert self.stack[-1][0] == name
        if name in html_text.BLOCKS or any(self.stack[-1][1:]):
            self.cut()
        self.stack.pop()

    def handle_data(self, data):
        self.parts.append((data, any(n == "a" for n, _, _ in self.stack)))


def _random_page(rnd):
    words = ["alpha", "beta", "gamma&amp;", "&lt;b&gt;", "caf&eacute;", "x&#65;y", "1,2"]
    classes = ["", ' class="content"', ' class="sidebar"', ' id="nav-menu"', ' class="post body"', ' class="ad banner"', ' role="navigation"', ' class="story__text"', ' style="display: none"']

    def inner(depth):
        out = []
        for _ in range(rnd.randint(1, 4)):
            kind = rnd.random()
            text = " ".join(rnd.choices(words, k=rnd.randint(1, 9)))
            if kind < 0.4 or depth == 0:
                out.append(f" {text} ")
            elif kind < 0.5:
                out.append(f' <a href="#">{text}</a> ')
            elif kind < 0.55:
                out.append("<br>")
            elif kind < 0.65:
                name = rnd.choice(["b", "span", "em"])
                out.append(f"<{name}{rnd.choice(classes)}> {text} </{name}>")
            else:
                name = rnd.choice(["div", "section", "article", "main", "nav", "footer", "aside", "ul", "h2", "blockquote"])
                out.append(f"<{name}{rnd.choice(classes)}>{inner(depth - 1)}</{name}>")
        return "".join(out)

    return f"<html><body>{inner(4)}</body></html>"


def test_blocks_and_features_equal_a_plain_parser():
    rnd = random.Random(21)
    kinds = set()
    for _ in range(400):
        page = _random_page(rnd)
        plain = PlainBlocks()
        plain.feed(page)
        plain.close()
        plain.cut()
        got = html_text.blocks_of(page)
        assert [(b.text, b.words, b.links, b.kind, b.article, b.boiler, b.marked) for b in got] == plain.out, page
        rows = html_text.featured(got)
        for k, row in enumerate(rows):
            here, before, after = (plain.out[n] if 0 <= n < len(rows) else ("", 0, 0.0, "", False, False, False) for n in (k, k - 1, k + 1))
            assert row == (here[1], here[2], before[1], before[2], after[1], after[2], here[3] == "paragraph", here[3] == "heading", *here[4:])
        kinds |= {b.kind for b in got}
    assert kinds == {"", "heading"} or kinds == {"", "heading", "paragraph"}


def test_tree_equals_exhaustive_search():
    """Each node splits where the weighted Gini impurity over all features and all gaps between values is least."""
    rnd = np.random.default_rng(9)

    def plain(rows, depth):
        y = [r[-1] > 0 for r in rows]
        if depth == 0 or all(y) or not any(y):
            return sum(y) / len(y) >= 0.5
        best = None
        for f in range(len(rows[0]) - 1):
            values = sorted({r[f] for r in rows})
            for low, high in zip(values, values[1:]):
                cut, score = (low + high) / 2, 0.0
                for side in (True, False):
                    own = [a for a, r in zip(y, rows) if (r[f] <= cut) == side]
                    share = sum(own) / len(own)
                    score += len(own) * share * (1 - share)
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, cut)
        if best is None:
            return sum(y) / len(y) >= 0.5
        _, f, cut = best
        return (f, cut, plain([r for r in rows if r[f] <= cut], depth - 1), plain([r for r in rows if r[f] > cut], depth - 1))

    flat = lambda t: (t.feature, t.value, flat(t.low), flat(t.high)) if isinstance(t, html_text.Node) else bool(t)
    for _ in range(20):
        rows = np.column_stack([rnd.integers(0, 6, (40, 4)), rnd.random(40) < 0.5]).astype(float)
        assert flat(html_text.grow(rows, 4)) == plain(rows.tolist(), 4)


@pytest.mark.parametrize("name", ["op1", "op4", "op9"])
def test_extra_columns_of_clashing_names(spark, name):
    """Columns named like the operators' own change nothing."""
    from quillframe.llm import rules

    clash = ("n", "key", "kind", "spans", "links", "words", "text_", "__words", "__rule", "quality", "toxic", "valid", "segments", "formatted", "loss", "rule", "n_words", "kept", "place")
    more = lambda df: df.withColumns({c: F.lit("mine") for c in clash})
    if name == "op1":
        rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "</s> yo"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
        run = lambda df: chat_format.digests(df).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    elif name == "op4":
        rows = spark.createDataFrame([(1, "u", PAGE), (2, "u", None)], "page_id long, url string, html string")
        run = lambda df: html_text.extract(df).select("page_id", "url", "main_text")
    else:
        rows = spark.createDataFrame([(1, "a b c " * 40), (2, None), (None, "x")], "doc_id long, text string")
        run = lambda df: rules.judge(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).select("doc_id", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(run(more(rows))) == key(run(rows))
