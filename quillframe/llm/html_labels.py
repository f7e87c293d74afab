"""Labelled pages that the main-text tree is grown on.

`+40` stands for a text of 40 words that belongs to the page's main text, `-3` for one of 3 words that doesn't.
"""

from __future__ import annotations

import re

PAGES = (
    # an article with a menu, an advert, a sidebar and comments
    """<header class="site-header"><a href=/>-2</a></header><nav><ul><li><a href=/>-1</a><li><a href=/>-2</a><li><a href=/>-1</a></ul></nav>
    <div class="ad">-9</div><article><h1>+7</h1><p>+60</p><p>+25</p><div class="advert-box">-14</div><p>+3</p><h2>+4</h2><p>+110</p><p>+1</p>
    <div id="comments"><h3>-2</h3><div class="comment"><p>-40</p></div><div class="comment"><p>-75</p></div></div></article>
    <aside><h3>-2</h3><p>-30</p><ul><li><a href=/>-6</a><li><a href=/>-5</a></ul></aside><footer>-12</footer>""",
    # an article that links a great deal, with notices in it
    """<div role="navigation"><a href=/>-1</a> <a href=/>-1</a></div><article><p>+2</p><p>+30 <a href=/>+25</a> +12</p><ul><li><a href=/>+5</a></li><li><a href=/>+3</a></li></ul>
    <p><a href=/>+8</a></p><p class="notice">-22</p><table><tr><td>+1<td>+2<td>+6</table><p>+14</p><div class="share"><a href=/>-1</a> <a href=/>-1</a></div></article>
    <div class="related-posts"><h4>-2</h4><a href=/>-7</a><a href=/>-8</a></div><div class="cookie-banner">-26 <button>-1</button></div>""",
    # prose in plain boxes, a last short paragraph, then a footer without a class
    """<title>-4</title><div class="menu"><a href=/>-1</a><a href=/>-1</a></div><div id="content"><h1>+5</h1><p>+45</p><p>+70</p><p>+16</p><p>+38</p></div>
    <div>-6</div><div><a href=/>-2</a> <a href=/>-2</a> <a href=/>-1</a></div>""",
    # one short paragraph and nothing else of the kind
    """<ul><li><a href=/>-1</a><li><a href=/>-1</a><li><a href=/>-2</a></ul><h1>+4</h1><p>+28</p><div>-5</div>""",
    # paragraphs in a body without boxes
    """<body><p><a href=/>-1</a> | <a href=/>-2</a> | <a href=/>-1</a></p><h2>+6</h2><p>+90</p><p>+12</p><blockquote>+20</blockquote><p>+9</p><p>+55</p><p><a href=/>-3</a></p></body>""",
    # prose in boxes instead of paragraphs
    """<div class="topbar"><a href=/>-2</a></div><div><div>+80</div><div>+35</div><div>+22</div><div>+64</div></div><div class="sidebar"><div>-12</div><div><a href=/>-4</a></div></div><div>-3</div>""",
    # a page of links: nothing is main text
    """<h1>-2</h1><div><a href=/>-6</a></div><div><a href=/>-5</a></div><div><a href=/>-9</a></div><div>-2</div><div>-3</div><div><a href=/>-12</a> -2</div>""",
    # a main element with a form, a figure and a list of short items
    """<nav>-3</nav><main><h1>+3</h1><p>+18</p><figure><figcaption>+9</figcaption></figure><ul><li>+4</li><li>+2</li><li>+11</li></ul><form><p>-15</p><label>-2</label></form>
    <p>+50</p><section class="newsletter-signup"><p>-19</p></section></main><footer><p>-24</p><p>-33</p></footer>""",
    # many short paragraphs in a row, as in talk or verse
    """<div class="nav-bar"><a href=/>-1</a><a href=/>-1</a></div><div><h1>+2</h1><p>+6</p><p>+9</p><p>+4</p><p>+11</p><p>+5</p><p>+8</p></div><div class="footer">-10</div>""",
    # pages that end with main text
    """<nav><a href=/>-1</a></nav><article><h1>+3</h1><p>+40</p><p>+26</p><p>+5</p></article>""",
    """<article><p>+12</p></article>""",
    """<article>+30<h2>+2</h2><ul><li>+7<li>+3</ul></article>""",
    """<h1>+3</h1><p>+50</p><p>+30</p><p>+8</p>""",
    """<div class="menu"><a href=/>-2</a></div><p>+35</p>""",
    """<p>+7</p>""",
    """<div>+60</div>""",
    """<article><h1>+6</h1><p>+22</p><p>+17 <a href=/>+3</a></p><p><a href=/>+4</a></p></article>""",
    """<div id="main"><p>+75</p><h3>+2</h3><p>+33</p></div><div>-4</div><div><a href=/>-3</a></div>""",
    # short and linked lines of articles beside each other
    """<article><h2>+3</h2><ul><li><a href=/>+2</a><li><a href=/>+4</a></ul><p>+6</p><p><a href=/>+5</a></p><p>+2</p><ol><li><a href=/>+9</a><li>+3<li><a href=/>+1</a></ol><h3>+1</h3></article><footer>-5</footer>""",
    """<main><p><a href=/>+2</a></p><h1>+4</h1><p><a href=/>+6</a></p><p>+3</p><p>+9</p><p><a href=/>+7</a></p></main><div>-8</div><ul><li><a href=/>-3</a></ul>""",
    # main text beside lists of links, without an article
    """<ul><li><a href=/>-1</a><li><a href=/>-2</a></ul><h1>+5</h1><p>+11</p><p>+24</p><p>+8</p><ul><li><a href=/>-4</a><li><a href=/>-3</a></ul>""",
    """<div><a href=/>-2</a></div><h2>+2</h2><p>+19</p><div><a href=/>-6</a></div>""",
    """<ul><li><a href=/>-2</a></ul><h1>+7</h1><p>+3</p><p>+2</p>""",
    """<nav><a href=/>-1</a></nav><article><h2>+4</h2><p>+1</p></article><footer>-6</footer>""",
    """<nav><a href=/>-3</a></nav><main><h1>+2</h1><p>+3</p></main>""",
    # pages that end with other text
    """<div class="navbar"><a href=/>-1</a></div><h2>+4</h2><p>+42</p><ul><li><a href=/>-2</a><li><a href=/>-3</a></ul>""",
    """<p>+66</p><p>+31</p><div>-9</div>""",
    """<article><p>+48</p><p>+29</p></article><div>-7</div><div>-3 <a href=/>-2</a></div>""",
    # boilerplate of much text without an article
    """<div class="banner">-31</div><div class="gdpr consent"><p>-85</p><p>-40</p></div><div><p>+48</p><p>+130</p></div><div class="replies"><p>-60</p><p>-12</p></div><div class="promo">-45</div>""",
)


def spelled(page: str) -> str:
    """The page with words in place of the marks: `m` for main text, `x` for other."""
    return re.sub(r"(?<=[>\s])([+-])(\d+)", lambda m: " ".join(["m" if m[1] == "+" else "x"] * int(m[2])), page)


def is_main(text: str) -> bool:
    """Whether a block of a spelled page is main text."""
    return text.count("m") > text.count("x")
