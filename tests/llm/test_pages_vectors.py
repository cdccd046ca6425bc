"""HTML extraction, nearest neighbours, chat formatting."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import ann, chat, htmltext
from tests.llm.fixtures import SF, SF01


def test_generated_pages(spark):
    """The pages' articles, cut out by a pattern that knows their template."""
    got = {r["page_id"]: r for r in htmltext.op5_html_extraction(spark, SF01).collect()}
    for r in spark.read.parquet(f"{SF01}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text) and got[r["page_id"]]["url"] == r["url"]


#: Layouts that the tree has not seen, in the notation of its own.
HELD_OUT = [
    "<div class=topnav>-0[3]</div><article class=entry><h1>+9</h1><p>+52</p><p>+4</p><p>+77[2]</p><p>+3</p></article><footer>-0[4]</footer>",
    "<ul><li>-0[2]<li>-0[3]<li>-0[1]</ul><div>+64</div><div>+39</div><div>+83[5]</div><div>-0[4]</div><div>-0[3]</div>",
    "<header>-3<nav>-0[5]</nav></header><main><h1>+4</h1><p>+21</p><h2>+3</h2><p>+35</p><p>+2</p><p>+48</p></main><footer>-9[3]</footer>",
    "<h1>+5</h1><p>+17</p><p>+2</p><p>+23</p><p>+1</p><p>+29</p>",
    "<div class=sidebar><ul><li>-0[3]<li>-0[4]</ul><p>-15</p></div><div class=content><h2>+6</h2><p>+58</p><p>+33</p></div><div class=advert>-11</div>",
    "<article class='share-story'><h1>+6</h1><p>+47</p><p>+8</p><p>+39</p></article><div class=share>-0[4]</div>",
    "<form><div>-0[2]</div><div>-0[3]</div><h1>+3</h1><p>+61</p><p>+44</p><p>+12</p></form>",
    "<article><h1>+7</h1><p>+38</p><p>+51</p><ul><li>-0[7]<li>-0[5]<li>-0[6]</ul></article><aside>-18</aside>",
    "<div><h1>+4</h1><p>+150</p><p>+11</p><p>+120</p></div><article><p>-5</p></article><article><p>-9</p></article>",
    "<article><h1>+8</h1><p>+95</p><p>+72</p></article><div class=comments><p>-22</p><p>-35</p><p>-8</p></div>",
    "<p>+13</p><p>+1</p><p>+4</p><p>+22</p>",
    "<nav>-0[3]</nav><div class=promo>-6</div><article><h1>+10</h1><p>+33</p><p>+3</p><p>+120[6]</p><p>+57</p></article><footer>-20</footer>",
    "<div>-0[2]</div><div>-0[4]</div><div>-0[3]</div><h2>+4</h2><div>+46</div><div>+71</div><div>+38</div><div>-2[6]</div>",
    "<header>-4</header><main><article><h1>+5</h1><p>+82</p><blockquote>+16</blockquote><p>+26</p></article></main><aside><p>-20</p><ul><li>-0[3]</ul></aside>",
    "<body class=has-footer><article id=menu-planning><h1>+4</h1><p>+64</p><p>+37</p></article><div id=menu>-0[6]</div></body>",
    "<main><h1>+3</h1><p>+28</p><p>+31[3]</p><ol><li>+9<li>+6<li>+11</ol><p>+40</p></main><section class=related><h3>-2</h3><p>-0[8]</p><p>-0[7]</p></section>",
]


def test_layouts_not_seen():
    rows = htmltext.labelled_blocks(HELD_OUT)
    tree = htmltext.trained()
    right = [tree.classify(r[:-1]) == r[-1] for r in rows]
    assert sum(right) >= 0.95 * len(rows), [r for r, ok in zip(rows, right) if not ok]
    # a tree that sees names and elements alone does worse: densities and neighbours decide
    blind = lambda r: (*[0] * 6, *r[6:])
    own = htmltext.train_tree([blind(r) for r in htmltext.labelled_blocks(htmltext.LABELLED_PAGES)])
    assert sum(own.classify(blind(r)[:-1]) == r[-1] for r in rows) < sum(right)
    assert {htmltext.FEATURES.index(f) for f in ("words", "links")} <= set(tree.feature)
    assert {htmltext.FEATURES.index(f) for f in ("words_before", "links_before", "words_after", "links_after")} & set(tree.feature)


def test_neighbours_decide():
    """The same short block counts between paragraphs and not among links."""
    tree, long = htmltext.trained(), " ".join(["word"] * 40)
    assert "No change." in htmltext.main_text(f"<p>{long}</p><div>No change.</div><p>{long}</p>", tree).split("\n")
    assert "No change." not in htmltext.main_text(f"<p>{long}</p><div><a>one</a></div><div>No change.</div><div><a>two</a></div>", tree).split("\n")


def test_names_do_not_decide_alone():
    tree = htmltext.trained()
    story = "<h1>Rain</h1><p>It rained all day and nobody came to see the garden that they had planted there.</p><p>They left at noon.</p>"
    text = "Rain\nIt rained all day and nobody came to see the garden that they had planted there.\nThey left at noon."
    assert htmltext.main_text(f'<body><article class="post comment-open">{story}</article></body>', tree) == text
    assert htmltext.main_text(f'<body><div class="widget-content"><article>{story}</article></div></body>', tree) == text
    assert htmltext.main_text("<body><p>Yes.</p><p>No.</p><p>It rained.</p><p>They left at noon and never came back.</p></body>", tree) == "Yes.\nNo.\nIt rained.\nThey left at noon and never came back."


def test_story_beside_small_article_elements():
    """Teasers, comments and cards marked up as articles do not make the story beside them furniture."""
    tree, story = htmltext.trained(), " ".join(["word"] * 200)
    text = f"<div><p>{story}</p><p>{story}</p></div>"
    cards = ("<aside><article><a>more</a> teaser one</article></aside>", "<article class='comment-body'><p>nice one indeed</p></article>", "<article><h3>More</h3><p>short card</p></article>")
    for card in cards:
        assert f"{story}\n{story}" in htmltext.main_text(f"<body>{text}{card}</body>", tree)
    assert htmltext.main_text(f"<body><article><h1>T</h1>{text}</article><footer>{story}</footer></body>", tree) == f"T\n{story}\n{story}"


def test_links_and_form_elements_within_sentences():
    """Sentences that are little but links, and labels and buttons that are words of one, stay with what stands around them."""
    tree = htmltext.trained()
    for page, text in {
        "<article><h1>Title of it</h1><p>See <a href=x>one thing</a> <a href=y>two</a>.</p><p>And then the text goes on with a good many words in it.</p></article>": "Title of it\nSee one thing two.\nAnd then the text goes on with a good many words in it.",
        "<article><h1>A head</h1><p>See <a>this page</a> and <a>that one</a>.</p></article><footer>Copyright of us all</footer>": "A head\nSee this page and that one.",
        "<article><p>text <label>term</label> text</p><p>Fine.</p></article>": "text term text\nFine.",
        "<p>text <label>term</label> text</p><p>Fine.</p>": "text term text\nFine.",
        "<article><h2>Press <button>this</button> now</h2><p>It will open the door of the house for you.</p></article>": "Press this now\nIt will open the door of the house for you.",
        "<article><h1>Where</h1><p>We live here, all of us, in one house.</p><address>12 High Street, Town</address></article>": "Where\nWe live here, all of us, in one house.\n12 High Street, Town",
    }.items():
        assert htmltext.main_text(page, tree) == text


def test_pages_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>A text of some words in it.</p></article>", "x", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in htmltext.extract_text(rows).collect()] == [(1, "u", "A text of some words in it.", 27)]


PAGE = """<html><head><title>T</title></head><body class="page has-sidebar"><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies</div>
<main><article><header><h1>Head &amp; line</h1></header><p>First   paragraph<br>goes&nbsp;on <a href="x>y">here</a>.</p><script>if (a<b) "</p>"</script>
<p>a &lt; b</p><form><label>Mail</label><input></form><ul><li>one<li>two</ul><div class='comments'><p>A long comment by a reader of this page</p></div></article></main>
<aside>Related things</aside><footer>Imprint</footer>"""


def test_page_by_hand():
    tree = htmltext.trained()
    assert htmltext.main_text(PAGE, tree) == "Head & line\nFirst paragraph goes on here.\na < b\none\ntwo"
    assert sum(tree.classify(r[:-1]) != r[-1] for r in htmltext.labelled_blocks(htmltext.LABELLED_PAGES)) <= 20
    plain = "<body><div><a href=1>Home</a> <a href=2>News</a></div><div>" + "<p>" + "word " * 40 + "</p>" * 1 + "<p>" + "more " * 30 + "</p></div>"
    assert htmltext.main_text(plain, tree) == ("word " * 40).strip() + "\n" + ("more " * 30).strip()


@pytest.mark.parametrize("page", ["", "<", "<p", "a<b", "<!--", "<script>", '<a title="', "</div></div>", "<div " * 2000, "&#xD800;&bogus;&amp", "x" * 200000, '<p "' * 3000])
def test_broken_pages(page):
    texts, rows = htmltext.text_blocks(page)
    assert len(texts) == len(rows) and all(len(r) == len(htmltext.FEATURES) for r in rows)
    assert all(t == " ".join(t.split()) and t for t in texts)
    assert htmltext.main_text(page, htmltext.trained()) == "\n".join(t for t, r in zip(texts, rows) if htmltext.trained().classify(r))


def test_null_pages(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (1, None, None)], "page_id long, url string, html string")
    assert [r["text"] for r in htmltext.extract_text(rows).collect()].count("") >= 2
    assert htmltext.extract_text(rows.limit(0)).collect() == []


def brute_neighbours(ids, vecs, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (vecs * vecs[i]).sum(axis=1)
        rest = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in rest[np.lexsort((ids[rest], -score[rest]))][:k]]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_neighbours(spark, small):
    table = spark.read.parquet(f"{SF}/embeddings.parquet" if small else f"{SF01}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, vecs = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    expected = brute_neighbours(ids, vecs, 20)
    p = ann.Projection(cell_rows=100, query_rows=7, sample=300, leaf=16) if small else ann.Projection()
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 20, p).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == expected.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        score = dict(expected[q])
        hits += sum(i in score for _, i, _ in found)
        assert all(abs(score[i] - s) < 1e-12 for _, i, s in found if i in score)
    assert hits >= 0.95 * 20 * len(got)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.5, 0.0, 0.0, 1.0]) for i in range(50)]
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (260, [float("nan")] * 6), (280, [float("inf")] + [1.0] * 5), (300, [1.0, 2.0]), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x"))
    ids = np.array([r[0] for r in rows[:110]])
    expected = brute_neighbours(ids, np.array([r[1] for r in rows[:110]]), 20)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 20, ann.Projection(cell_rows=16, leaf=4, query_rows=2, confidence=0.999999)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in e] for q, e in expected.items()}
    few = ann.nearest(table.limit(3), F.col("vec_id") == 0, 20)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2]
    assert ann.nearest(table.limit(0), F.lit(True)).collect() == []


def test_rows_that_share_an_id(spark):
    """Each row is a candidate with its own score and, if asked, a query with its own list without itself."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [-0.9, 0.1]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (20, [0.0, 1.0]), (2, [0.3, 0.2])]
    rows += [(int(i), [float(x) for x in rng.normal(size=2)]) for i in rng.integers(3, 15, 30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "row", "asked", "rank")})
    vecs, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    lists = []
    for at in np.flatnonzero(ids % 20 == 0):
        score = (vecs * vecs[at]).sum(axis=1)
        rest = np.array([j for j in range(len(rows)) if j != at])
        rest = rest[np.lexsort((ids[rest], -score[rest].round(12)))][:5]
        lists += [(int(ids[at]), r + 1, int(ids[j]), round(float(score[j]), 9)) for r, j in enumerate(rest)]
    for p in (ann.Projection(confidence=0.999999), ann.Projection(confidence=0.999999, cell_rows=8, leaf=2, query_rows=2)):
        got = ann.nearest(table, F.col("vec_id") % 20 == 0, 5, p).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(lists)
    outside = ann.nearest(table, table.where("vec_id = 0"), 1).collect()
    assert [(r["query_id"], round(r["score"], 9)) for r in outside] == [(0, round(float((vecs @ vecs[0]).max()), 9))]  # itself is a candidate here


def test_chi_square():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def lines_by_conversation(lines):
    out = {}
    for r in sorted(lines.collect(), key=lambda r: (r["conv"], r["part"], r["idx"])):
        out.setdefault(r["conv"], []).append(r)
    return out


def plain_viterbi(rows, model):
    """One pass over the lines of one conversation."""
    score, back = None, []
    for r in rows:
        place = np.uint64(r["idx"] * chat.N) + (np.uint64(r["part"]) << np.uint64(40))
        nudge = chat.mix(place + np.arange(chat.N, dtype=np.uint64)) % np.uint64(1024) / 2**24
        seen = model.see[:, r["seen"]] + nudge
        if score is None:
            score = model.start + seen
        else:
            every = score[:, None] + model.move
            back.append(every.argmax(axis=0))
            score = every.max(axis=0) + seen
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("block", [2, 5, 256])
def test_paths_are_those_of_one_pass(spark, block):
    """Blocks of any size give the path of a plain Viterbi over each conversation, long ones and one without an id included."""
    rng = random.Random(2)
    some = ["User: a?", "Bot: b", "c d e f g h", "why?\nso it goes\n\nand on", "[system] x", None, "", "\n\n", "x " * 130]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "other"]), rng.choice(some)) for c in (1, 2, None) for t in [*range(40), None, 3, 3]]
    rows += [(10 + c, t, "user", rng.choice(some)) for c in range(60) for t in range(rng.randint(0, 4))] + [(99, 0, "user", "\n".join(["line one", "User: two?"] * 300))]
    p = chat.Chat(block=block)
    lines = chat.numbered_lines(chat.pieces(turns_of(spark, rows)), p)
    models = chat.fitted(chat.numbered_lines(chat.plain_transcript(spark.read.parquet(f"{SF}/conversations.parquet")), p), p, True)
    fold = {r["conv"]: r["fold"] for r in lines.select("conv", chat._fold().alias("fold")).distinct().collect()}
    got = {}
    for r in sorted(chat.recovered(lines, models).collect(), key=lambda r: (r["part"], r["block"])):
        got.setdefault(chat.NO_ID if r["conv_id"] is None else r["conv_id"], []).extend(r["states"])
    own = lines_by_conversation(lines)
    assert got == {c: plain_viterbi(x, models[fold[c]]) for c, x in own.items()}
    assert sum(map(len, own.values())) == sum(bool(x.strip()) for *_, t in rows for x in (t or "").split("\n"))


def test_roles_of_conversations_not_fitted_on(spark):
    """Plain transcripts, a fifth of the turns unmarked: roles and turns of the half that the model has not seen."""
    turns = spark.read.parquet(f"{SF01}/conversations.parquet")
    got = chat.op4_chat_formatting(spark, SF01).collect()
    assert len(got) == turns.select("conv_id").distinct().count()
    n, agreeing = sum(r["n_lines"] for r in got), sum(r["n_agreeing"] for r in got)
    assert agreeing > 0.93 * n, agreeing / n
    number = dict(turns.groupBy("conv_id").count().collect())
    assert sum(r["n_turns"] == number[r["conv_id"]] for r in got) > 0.8 * len(got)
    # a transcript says less without its markers, and the model uses what is left
    bare = chat.format_chat(chat.pieces(turns)).agg(F.sum("n_agreeing") / F.sum("n_lines")).first()[0]
    assert 0.4 < bare < agreeing / n
    # the pieces' edges say nothing: another cut of the same lines gives the same renderings
    whole = chat.plain_transcript(turns)
    halves = whole.select("conv", "turn", "tie", "role", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.slice("lines", 1, 1).alias("l")), F.struct(F.lit(1).alias("k"), F.slice("lines", 2, 10**6).alias("l")))).alias("x"))
    cut = halves.select("conv", (F.col("turn") * 2 + F.col("x.k")).alias("turn"), "tie", F.lit(None).cast("string").alias("role"), F.col("x.l").alias("lines")).where(F.size("lines") > 0)
    a = {r["conv_id"]: r["rendered"].replace("\n\n", "\n") for r in chat.format_chat(cut, whole).collect()}
    b = {r["conv_id"]: r["rendered"].replace("\n\n", "\n") for r in chat.format_chat(whole, whole).collect()}
    assert sum(a[c] == b[c] for c in b) > 0.5 * len(b)  # less the blank lines at the new edges, which are a feature


def test_marked_transcripts(spark):
    known = chat.plain_transcript(spark.read.parquet(f"{SF}/conversations.parquet"))
    rows = [(1, 0, None, "System: be kind\nUser: Hi there?\nsecond line\n\nthird line\n\nAssistant: Hello.\n\nHuman: Bye"), (2, 0, None, "### Human: what?"), (2, 1, None, "**AI:** that"), (3, 0, None, " \n")]
    out = {r["conv_id"]: r for r in chat.format_chat(chat.pieces(turns_of(spark, rows)), known).collect()}
    assert out[1]["rendered"] == "<|system|>\nbe kind\n<|end|>\n<|user|>\nHi there?\nsecond line\n\nthird line\n<|end|>\n<|assistant|>\nHello.\n<|end|>\n<|user|>\nBye\n<|end|>"
    assert out[2]["rendered"] == "<|user|>\nwhat?\n<|end|>\n<|assistant|>\nthat\n<|end|>" and out[2]["n_turns"] == 2 and 3 not in out
    assert chat.strip_marker("No colon here") == ("No colon here", 0) and chat.strip_marker("Note that: x")[1] == 0


def test_odd_conversations(spark):
    """Blocks do not show in the rendering; equal rows, clashing names and empty tables have defined results."""
    known = chat.plain_transcript(spark.read.parquet(f"{SF}/conversations.parquet"))
    rows = [(None, None, "user", "User: a\nb"), (None, 1, "assistant", "Bot: c"), (5, 0, "user", "User: x\ny"), (5, 0, "user", "User: x\ny"), (6, 0, "user", "User: " + "long\n" * 3000 + "end"), (6, 1, "assistant", "AI: yes")]
    turns = turns_of(spark, rows).withColumns({c: F.lit("x") for c in ("conv", "part", "block", "idx", "line", "state", "fold", "rendered")})
    one, many = ({r["conv_id"]: (r["n_turns"], r["n_lines"], r["rendered"]) for r in chat.format_chat(chat.pieces(turns), known, chat.Chat(block=n)).collect()} for n in (10**6, 3))
    assert one == many and one[None][0] == 2 and one[None][2].startswith("<|user|>\na\nb\n<|end|>") and one[6][1] == 3002 and one[5][1] == 4
    assert chat.format_chat(chat.pieces(turns.limit(0)), known).collect() == []
    assert chat.format_chat(chat.plain_transcript(turns_of(spark, []))).collect() == []
