"""Row-wise operators: encoding, page text, token counts."""

import hashlib
import html
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, html_text, token_counts
from tidewatch.llm.vocabulary import production_vocabulary

tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = production_vocabulary()


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.Coder(ranks, PATTERN)


def ids_of(coder, text):
    return [int(i) for chunk in coder.chunks(text) for i in chunk.split(",")]


def test_transducer_equals_the_library_on_random_texts(coder, reference):
    rng = random.Random(1)
    for _ in range(3000):
        kind, n = rng.randrange(4), rng.randint(1, 40)
        if kind == 0:
            text = "".join(rng.choice("aaab\n\t  '") for _ in range(n))
        elif kind == 1:
            text = "".join(chr(rng.choice([rng.randint(0, 0x2FFF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(n))
        else:
            text = "".join(rng.choice(["the", "ing", "tion", "é", "ß", " ", "123", "'s", "...", "日本", "<|endoftext|>"]) for _ in range(n))
        assert ids_of(coder, text) == reference.encode_ordinary(text)


def test_transducer_forgets_states_without_changing_results(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    coder = bpe.Coder(ranks, PATTERN)
    text = " ".join(f"tionreêst{i * 7919}inger" for i in range(200))
    assert ids_of(coder, text) == reference.encode_ordinary(text)


def test_long_texts_go_in_pieces(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 100)
    text = "The thing, and then some ünïcode words 12 34.\n" * 50 + "a" * 5000
    assert ids_of(coder, text) == reference.encode_ordinary(text)


def test_streaming_decoder_takes_any_cut():
    text = "aé日𝄞z"
    data = text.encode()
    for cut in range(len(data) + 1):
        for cut2 in range(cut, len(data) + 1):
            s = bpe.Utf8Stream()
            assert s.feed(data[:cut]) + s.feed(data[cut:cut2]) + s.feed(data[cut2:]) + s.end() == text
    broken = bpe.Utf8Stream("replace")
    assert broken.feed(b"a\xe6") + broken.feed(b"\x97") + broken.end() == "a�"


def test_encoding_of_messy_rows(messy, messy_rows, reference):
    out = bpe.encode_documents(messy, PATH, PATTERN, with_ids=True)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    want = sorted((repr(i), len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
                  for i, t in ((r[0], r[1] or "") for r in messy_rows) for e in [reference.encode_ordinary(t)])
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
    back = bpe.decode_documents(out, PATH).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, ((r[0], r[1] or "") for r in messy_rows)))


def test_encoding_of_nothing(nothing):
    assert bpe.encode_documents(nothing, PATH, PATTERN).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-ads">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy this now, it is a very good thing to have in the house.</div>
<main><h1>The &amp; title</h1><p>First   paragraph\nof the <b>article</b> that says what it is about.<p>Short.
<blockquote>He said &#8220;yes&#8221;&nbsp;to it.</blockquote><aside>Read more of the same kind elsewhere in here.</aside>
<form><p>Enter your address to get more of this every week</p></form><ul><li>first point<li>second point</ul>
<section id="comments"><h2>Comments</h2><p>{comment}</p></section></main>
<div role="complementary"><p>Other things that people have been reading lately, all day.</p></div>
<div class="cookie-notice">We use cookies to make this page better for you.</div><footer>&copy; nobody</footer>"""


def test_page_text():
    want = "The & title\nFirst paragraph of the article that says what it is about.\nShort.\nHe said “yes” to it.\nfirst point\nsecond point"
    assert html_text.main_text(PAGE.format(comment="I have read it all and liked it, but the end could be much longer. " * 4)) == want
    assert html_text.main_text("") == html_text.main_text("<p>") == html_text.main_text("<script>alert(1)") == ""
    assert html_text.main_text("<article><p>a &lt;b&gt; c</article") == "a <b> c"


def test_minimum_cut_is_the_least_of_all_labellings():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 8)
        evidence = [rng.uniform(-3, 3) for _ in range(n)]
        ties = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(labels):
            return sum(-min(0, e) if x else max(0, e) for e, x in zip(evidence, labels)) + sum(
                c for (i, j), c in ties.items() if labels[i] != labels[j])

        best = min(cost([(m >> i) & 1 for i in range(n)]) for m in range(2**n))
        assert cost(html_text._min_cut(n, evidence, ties)) == pytest.approx(best)


def test_pages_table(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of the story, which goes on and on.</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", PAGE.format(comment="ok then")), (1, "u", None), (None, None, ""), (2, None, long), (2, None, long)]
    pages = spark.createDataFrame([r + ("x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = html_text.extract(pages).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text.count("\n") for r in out if r.page_id == 2] == [4999, 4999]
    assert {r.text for r in out if r.page_id is None} == {""}
    assert html_text.extract(pages.limit(0)).collect() == []


def test_article_text_of_the_pages(spark):
    """Brute force on real pages: what stands between the article tags, block by block."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for page_id, page in pages.select("page_id", "html").collect():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        cut = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", inner.replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in cut]
        assert got[page_id] == "\n".join(b for b in blocks if b)


def pieces(rng, n):
    return "".join(rng.choice(["the", " ", "  ", "\n", "'", "s", "ll", " a", "ing", "12", "!", "é", "\t", "日"]) for _ in range(n))


@pytest.mark.parametrize("leaf", [1, 3, 32])
def test_tree_counts_equal_full_counts(coder, leaf, monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    counter, rng = token_counts.Counter(coder), random.Random(leaf)
    for _ in range(250):
        text = pieces(rng, rng.choice([0, 3, 40, 400]))
        tree = token_counts.CountTree.of_text(counter, text)
        for _ in range(5):
            at, gone, new = rng.randint(0, len(text)), rng.choice([0, 1, 3, 60, 9999]), pieces(rng, rng.choice([0, 1, 4, 50]))
            text = text[:at] + new + text[at + gone:]
            tree.edit(at, gone, new)
            assert tree.text() == text
            assert tree.total() == sum(map(counter.of, coder.split.findall(text)))


def test_small_edits_touch_little(coder):
    counter = token_counts.Counter(coder)
    tree = token_counts.CountTree.of_text(counter, "some words of a text, " * 20_000)
    tree.edit(200_000, 3, "new")
    assert 0 < tree.encoded < 4 * token_counts.LEAF


def test_counts_of_messy_rows_under_edits(messy, messy_rows, reference):
    docs = messy.drop("edits").withColumn("edits", token_counts.derived_edits())
    out = token_counts.counts_under_edits(docs, PATH, PATTERN).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in out) == sorted(
        (repr(r[0]), len(reference.encode_ordinary(r[1] or ""))) for r in messy_rows)
    want = []
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "edits").collect():
        text = r.text
        for e in r.edits:
            at = min(e.pos, len(text))
            text = text[:at] + e.ins + text[at + e["del"]:]
        want.append((repr(r.doc_id), len(reference.encode_ordinary(text)), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((repr(r.doc_id), r.n_edited_tokens, r.edited_sha256) for r in out) == sorted(want)


def test_stored_trees(spark, messy, nothing, reference):
    trees = token_counts.build_trees(messy, PATH, PATTERN)
    rows = messy.drop("edits").filter("doc_id > 12").join(trees, "doc_id").withColumn(
        "edits", F.expr("array(named_struct('pos', 1, 'del', 2, 'ins', 'xyz'), null, named_struct('pos', null, 'del', null, 'ins', ' '))"))
    before = {r.doc_id: r.text or "" for r in rows.collect()}
    out = token_counts.apply_edits(rows, PATH, PATTERN).collect()
    assert len(out) == len(before)
    for r in out:
        text = " " + before[r.doc_id][:1] + "xyz" + before[r.doc_id][3:]
        assert (r.text, r.n_tokens) == (text, len(reference.encode_ordinary(text)))
        assert sum(r.leaf_tokens) == r.n_tokens and sum(r.leaf_chars) == len(text)
    assert token_counts.build_trees(nothing, PATH, PATTERN).collect() == []
    assert token_counts.counts_under_edits(nothing.withColumn("edits", token_counts.derived_edits()), PATH, PATTERN).collect() == []
