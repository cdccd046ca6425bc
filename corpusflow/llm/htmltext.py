"""Main text of web pages: flat text blocks, classified by a decision tree over themselves and their neighbours.

A page is cut into text blocks at block-level tags. Each block has its words and link density (share of words in links),
those of the block before and after, whether it is a heading or a paragraph, and hints from the tags around it: whether an
element there is furniture by its kind or its name, and what shares of the page's unlinked words that element and the
article or main around the block hold. A CART tree learns which blocks are content from the invented pages below, labelled
block by block; it is trained in the driver in a second and goes to the tasks as a few numbers. No tag or name decides by
itself: an article with a furniture word in its class, or a form around the whole page, is judged by what it holds.

Texts: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one line feed, in page order. Comments, scripts, styles and the head are no text.

Nulls: a null page is the empty page, with empty text; so is a page without text. A very long page is parsed whole, in time
proportional to its length. Broken markup never fails: an unclosed element ends with its parent or the page. Repeated rows
give repeated results; an empty table none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import read_table

# Element names by their part in a page.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
_FURNITURE = frozenset("nav footer aside form button select menu dialog label fieldset head search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p li blockquote pre dd dt figcaption address".split())
#: Parts of forms that are words of a sentence where they stand in one.
_PHRASES = frozenset("label button output".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = _BLOCKS - _VOID - {"p"} - _HEADINGS
_IN_TEXT = "script style noscript template svg title textarea iframe math object canvas audio video".split()
# Words in class, id or role that mark furniture.
_MARKS = (
    "ad ads advert adverts advertisement adbox banner breadcrumb breadcrumbs captcha comment comments comentarios contentinfo cookie cookies "
    "copyright disqus footer login masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promotion "
    "related respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget"
).split()
_FURNITURE_NAME = re.compile(r"(?<![a-z])(?<!has[-_])(?<!with[-_])(?<!no[-_])(?:" + "|".join(_MARKS) + r")(?![a-z])")
_HIDDEN = re.compile(r"(?i)\bhidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none")
_NAMED = re.compile(r"(?is)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_TOKEN = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)"
    r"|<(" + "|".join(_IN_TEXT) + r")\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*+>"
    r"|<[!?/][^>]*+>"
)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "paragraph", "story", "furniture", "held")

# Invented pages of many layouts, labelled block by block. +n stands for a block of n words that is content,
# -n for one of furniture; [n] for n linked words.
LABELLED_PAGES = [
    # an article with the usual furniture beside it, long, short and tiny
    "<nav><ul><li>-0[1]<li>-0[1]<li>-0[2]</ul></nav><div class=ad>-9</div><article><h1>+7</h1><p>+14<p>+60</p><p>+1</p><p>+85</p><p>+40[3]</p><p>+2</p></article><footer>-14</footer>",
    "<nav><ul><li>-0[1]<li>-0[1]</ul></nav><div class=ad>-8</div><article><h1>+4</h1><p>+3</p></article><footer>-15</footer>",
    "<div class=ad>-12</div><article><h1>+1</h1><p>+1</p><p>+2</p></article><footer>-9</footer>",
    "<nav>-0[3]</nav><div class='ad top'>-7</div><article></article><footer>-11</footer>",
    "<nav>-0[4]</nav><div class=ad>-10</div><article><h1>+12</h1><p>+12<p>+300</p><p>+420</p><p>+5</p><p>+1</p><p>+9</p></article><footer>-12</footer>",
    "<div class=banner>-20</div><main><h1>+5</h1><p>+30</p><ul><li>+6<li>+3[1]<li>+8</ul><h2>+3</h2><p>+55</p><pre>+20</pre></main><aside>-4<ul><li>-0[5]<li>-0[4]</ul></aside><footer>-0[3]</footer>",
    # furniture inside an article: links to other pages, share bars, comments by readers
    "<header>-2</header><article><header><h1>+6</h1><p>+5[2]</p></header><p>+70</p><p>+0[6]</p><p>+65</p><h3>-2</h3><ul><li>-0[5]<li>-0[6]<li>-0[4]<li>-0[7]</ul></article><footer>-5</footer>",
    "<article><h1>+8</h1><p>+44</p><div>-0[1]</div><div>-0[1]</div><div>-0[1]</div><p>+31</p><p>+18</p><section class=comments><h2>-2</h2><div>-2</div><p>-40</p><div>-2</div><p>-18</p></section></article>",
    "<main><h1>+5</h1><p>+90</p><blockquote>+22</blockquote><p>+33[8]</p><form><label>-2</label><button>-1</button></form><div id=share>-2[3]</div></main><div class=sidebar><h3>-2</h3><p>-25</p></div>",
    "<article><p>+50</p><ol><li>+4[3]<li>+2[4]<li>+5[2]</ol><p>+48</p><h4>-2</h4><p>-0[8]</p><p>-0[9]</p></article>",
    # paragraphs that are little but links, and the headings before them
    "<nav>-0[3]</nav><article><h1>+3</h1><p>+1[2]</p><p>+24</p><p>+18</p></article><footer>-6</footer>",
    "<article><h1>+5</h1><p>+2[5]</p><p>+40</p><p>+1[3]</p></article><div>-0[3]</div>",
    "<article><h1>+2</h1><p>+1[2]</p></article><footer>-4[2]</footer>",
    "<main><h1>+4</h1><p>+3[6]</p><p>+28</p><h2>+2</h2><p>+1[4]</p></main><footer>-2[1]</footer>",
    "<nav>-0[4]</nav><article><h1>+6</h1><p>+2[3]</p><p>+1[1]</p><p>+9</p></article>",
    "<article><h1>+1</h1><p>+10</p><p>+4</p></article>",
    "<article><h1>+3</h1><p>+12</p><p>+5</p></article>",
    "<article><h1>+2</h1><p>+8</p><address>+6</address></article>",
    "<main><h1>+2</h1><p>+14</p><address>+4</address></main>",
    # names of furniture on an element that holds the story
    "<div id=header>-3</div><article class='post comment-open'><h1>+6</h1><p>+3</p><p>+45</p><p>+28</p></article><div class=footer>-8</div>",
    "<div class=widget-content><article><h1>+3</h1><p>+36</p><p>+12</p><p>+2</p></article></div><div class=widget><h3>-2</h3><ul><li>-0[4]<li>-0[3]</ul></div>",
    "<div class='page has-share'><div class='menu'>-0[2]<br></div><div class=notification-body><p>+40</p><p>+8</p><p>+61</p></div><div class=notification>-9</div></div>",
    "<form id=page><table><tr><td>-0[3]<td>-0[2]</tr></table><h1>+4</h1><p>+52</p><p>+6</p><p>+37</p><input><button>-1</button></form><div class=copyright>-6</div>",
    "<body class=sidebar-left><div class=navbar>-0[4]</div><h1>+5</h1><p>+20</p><p>+1</p><p>+24</p><div class=cookie>-22</div></body>",
    # no article: long and short paragraphs, furniture told by its links and its neighbours
    "<div>-0[1]</div><div>-0[1]</div><div>-0[2]</div><h1>+6</h1><p>+40</p><p>+7</p><p>+66</p><p>+3</p><p>+35[2]</p><div>-0[3]</div><div>-0[2]</div><div>-6</div>",
    "<p>+1</p><p>+1</p><p>+3</p><p>+8</p>",
    "<h1>+3</h1><p>+2</p><p>+1</p><p>+6</p><p>+4</p>",
    "<div>-0[2]</div><div>-1[1]</div><p>+12</p><p>+5</p><p>+9</p><div>-0[2]</div><div>-3</div>",
    "<table><tr><td>-0[1]<td>-0[1]<td>-0[1]</tr></table><div>+75</div><div>+58[4]</div><div>+12</div><div>+90</div><table><tr><td>-3[4]<td>-2[5]</tr></table>",
    "<div>-4[9]</div><div>-2[7]</div><div>+34</div><div>+41</div><div>+5</div><div>+47</div><div>-1[6]</div><div>-3[8]</div><div>-4</div>",
    "<ul><li>-0[2]<li>-0[1]</ul><h2>+5</h2><p>+26</p><h3>+2</h3><p>+19[3]</p><ul><li>+7<li>+9<li>+4</ul><p>+30</p><h3>-2</h3><ul><li>-0[6]<li>-0[5]</ul><p>-5</p>",
    "<div>-0[3]</div><div>-8[6]</div><h1>+7</h1><div>-3[1]</div><p>+110</p><p>+95</p><div>-10[7]</div><div>-9[9]</div>",
    "<div>-0[2]</div><div>-2</div><div>-0[1]</div><div>+50</div><div>+2</div><div>+44</div><div>+1</div><div>+36</div><div>-0[3]</div><div>-2</div><div>-0[2]</div>",
    "<p>+42</p><div>+2</div><p>+38</p><div>+3</div><p>+25</p><div>-0[2]</div><div>-3</div><div>-0[4]</div><div>-2</div>",
    "<nav>-0[6]</nav><article><h1>+6</h1><p>+41</p><p>+5</p></article><div>-0[4]</div><div>-0[2]</div><footer>-3[3]</footer>",
    "<nav>-0[4]</nav><article><h1>+5</h1><p>+66</p><p>+2</p></article><div>-0[3]</div><footer>-0[5]</footer>",
    "<h1>+4</h1><p>+25</p><p>+1</p><p>+32</p>",
    "<h2>+5</h2><p>+14</p><p>+2</p><p>+41</p><p>+1</p><p>+18</p>",
    "<h1>+6</h1><p>+160</p><p>+7</p><p>+130</p><article><p>-8</p></article>",
    "<h1>+3</h1><p>+190</p><p>+110</p><p>+12</p><article><p>-4</p></article><article><p>-11</p></article><article><p>-7</p></article>",
    "<main><h1>+3</h1><p>+34</p><p>+27</p></main><section class=related><p>-0[9]</p></section>",
    "<main><h2>+4</h2><p>+30</p><ul><li>+8<li>+5</ul></main><div class=sponsored><p>-12</p></div>",
    "<p>-0[3]</p><p>-0[2]</p><p>+31</p><p>+2</p><p>+46</p><p>-1[4]</p><p>-0[3]</p><p>-4</p>",
    # small articles beside a story that stands in none
    "<div><h1>+6</h1><p>+130</p><p>+9</p><p>+140</p></div><aside><article><h4>-0[4]</h4><p>-12</p></article></aside>",
    "<div><p>+200</p><p>+180</p></div><article class=comment-body><p>-6</p></article><article class=comment-body><p>-14</p></article>",
    "<div><p>+170</p><p>+4</p><p>+150</p></div><article><h3>-1</h3><p>-3</p></article>",
    "<div><p>+210</p><p>+160</p></div><article><p>-0[5]</p><p>-4</p></article><article><p>-0[6]</p><p>-5</p></article><article><p>-0[4]</p><p>-3</p></article>",
    "<main><div><p>+88</p><p>+92</p></div><div class=related><article><h3>-0[5]</h3><p>-11</p></article><article><h3>-0[6]</h3><p>-9</p></article></div></main>",
    # a story and long text beside it
    "<article><h1>+5</h1><p>+180</p><p>+160</p></article><div><p>+190</p></div><div>-7</div><footer>-200</footer>",
    "<article><h1>+2</h1><p>+220</p><p>+200</p></article><div>-8</div><div>-2[3]</div><div class=newsletter><p>-60</p></div>",
    "<article><p>+140</p></article><section id=comments><p>-90</p><p>-120</p><p>-70</p></section>",
    "<div class=comments><p>-30</p><p>-26</p></div><div class=login>-4</div>",
    "<nav>-0[9]</nav><aside><p>-40</p></aside><footer><p>-25</p></footer>",
]


@dataclass(frozen=True)
class Tree:
    """A binary tree in arrays: feature (-1 at a leaf), threshold (<= goes left), children, value."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[int, ...]

    def classify(self, row) -> int:
        at = 0
        while self.feature[at] >= 0:
            at = self.left[at] if row[self.feature[at]] <= self.threshold[at] else self.right[at]
        return self.value[at]


def train_tree(rows: list[tuple], depth: int = 8, least: int = 4) -> Tree:
    """CART by Gini impurity, `least` rows a leaf or more; ties go to the first feature and the smallest threshold."""
    data, label = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows])
    nodes: list[list] = []

    def impurity(y: np.ndarray) -> float:
        share = y.mean() if len(y) else 0.0
        return 2 * share * (1 - share) * len(y)

    def grow(at: np.ndarray, room: int) -> int:
        me = len(nodes)
        y = label[at]
        nodes.append([-1, 0.0, -1, -1, int(2 * y.sum() >= len(y))])
        best = (impurity(y) - 1e-9, -1, 0.0)
        if room and best[0] > 0:
            for f in range(data.shape[1]):
                values = np.unique(data[at, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = data[at, f] <= cut
                    if min(low.sum(), (~low).sum()) < least:
                        continue
                    best = min(best, (impurity(y[low]) + impurity(y[~low]), f, cut), key=lambda b: b[0])
        if best[1] >= 0:
            low = data[at, best[1]] <= best[2]
            nodes[me][:2] = best[1:]
            nodes[me][2], nodes[me][3] = grow(at[low], room - 1), grow(at[~low], room - 1)
        return me

    grow(np.arange(len(rows)), depth)
    return Tree(*(tuple(n[i] for n in nodes) for i in range(5)))


def text_blocks(page: str) -> tuple[list[str], list[tuple]]:
    """Texts of the blocks of a page and their FEATURES.

    furniture: 0, 1 within an element named like furniture, 2 within one that is furniture by its kind or hidden; story and
    held: what share of the page's unlinked words the outermost article or main, and the outermost such element, holds.
    """
    blocks: list[tuple] = []  # text, words, linked words, heading, paragraph, furniture, outermost furniture and story (numbers)
    stack: list[tuple] = []  # element, furniture, outermost furniture, outermost story
    parts: list[str] = []
    linked = words = elements = 0
    in_link = heading = paragraph = False

    def close() -> None:
        nonlocal words, linked
        if words:
            blocks.append((" ".join("".join(parts).split()), words, linked, heading, paragraph, *(stack[-1][1:] if stack else (0, 0, 0))))
        parts.clear()
        words = linked = 0

    def add(raw: str) -> None:
        nonlocal words, linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if n := len(text.split()):
                words += n
                linked += n * in_link

    at = 0
    for token in _TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        name = (token[3] or "").lower()
        if name == "a":
            in_link = not token[2]
        elif name == "br":
            parts.append(" ")
        elif name in _PHRASES and (paragraph or heading):
            continue
        elif name in _BLOCKS:
            close()
            in_link = False
            heading = name in _HEADINGS and not token[2]
            paragraph = name in _PARAGRAPHS and not token[2]
            if name in _CONTAINERS:
                if token[2]:
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == name:
                            del stack[depth:]
                            break
                elif not token[4].endswith("/"):
                    if name == "body":
                        stack[:] = [s for s in stack if s[0] != "head"]
                    elements += 1
                    _, furniture, outer, story = stack[-1] if stack else ("", 0, 0, 0)
                    marks = token[4]
                    kind = 0
                    if name not in ("body", "html"):
                        if name in _FURNITURE or (name == "header" and not story) or (marks and _HIDDEN.search(marks)):
                            kind = 2
                        elif furniture < 1 and marks and _FURNITURE_NAME.search(" ".join(a or b or c for a, b, c in _NAMED.findall(marks)).lower()):
                            kind = 1
                    if not story and name in ("article", "main"):
                        story = elements
                    stack.append((name, max(furniture, kind), outer or (elements if kind else 0), story))
    add(page[at:])
    close()
    held: dict[int, int] = {}
    for b in blocks:
        for element in {b[6], b[7]}:
            held[element] = held.get(element, 0) + b[1] - b[2]
    total = max(1, sum(b[1] - b[2] for b in blocks))
    share = lambda element: held[element] / total if element else 0.0
    rows = []
    for i, (_, n, linked_words, head, para, furniture, outer, story) in enumerate(blocks):
        before, after = (blocks[j] if 0 <= j < len(blocks) else ("", 0, 0) for j in (i - 1, i + 1))
        rows.append((n, linked_words / n, before[1], before[2] / max(before[1], 1), after[1], after[2] / max(after[1], 1), int(head), int(para), share(story), furniture, share(outer)))
    return [b[0] for b in blocks], rows


def labelled_blocks(pages: list[str]) -> list[tuple]:
    """FEATURES and label of every block of labelled pages."""

    def spelled(m: re.Match) -> str:
        n, links = int(m[2]), int(m[3] or 0)
        word = "keep" if m[1] == "+" else "drop"
        return " ".join([word] * n) + (f" <a href=x>{' '.join([word] * links)}</a>" if links else "")

    out = []
    for page in pages:
        texts, rows = text_blocks(re.sub(r"(?<=>)([+-])([0-9]+)(?:\[([0-9]+)\])?", spelled, page))
        out += [(*row, int(text.startswith("keep"))) for text, row in zip(texts, rows)]
    return out


@lru_cache(maxsize=4)
def trained(pages: tuple[str, ...] = tuple(LABELLED_PAGES)) -> Tree:
    return train_tree(labelled_blocks(list(pages)))


def main_text(page: str, tree: Tree) -> str:
    texts, rows = text_blocks(page)
    return "\n".join(t for t, r in zip(texts, rows) if tree.classify(r))


def extract_text(pages: DataFrame, labelled: list[str] = LABELLED_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = trained(tuple(labelled))

    def run(batches):
        for batch in batches:
            texts = [main_text(p or "", tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))
