"""HTML extraction, fill-in-middle and conversation trie: edge rows, plain
Python and SQL."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_cases import edge, edge_rows, empty  # noqa: F401  (fixtures)
from weblytics.llm import fill_in_middle as fim
from weblytics.llm import html_text, prefix_trie
from weblytics.llm.oracle import oracle_sql
from weblytics.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_html_extraction", "op12_fill_in_middle", "op13_conversation_trie"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    result = con.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(map(repr, result.fetchall()))
    df = queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


# -- 11 pages -----------------------------------------------------------------------

def page(title, paragraphs, layout="article", extra=""):
    body = "".join(f"<p>{p}" for p in paragraphs)
    main = {"article": f"<article><header><h1>{title}</h1></header>{body}</article>",
            "div": f'<div id="content-12"><h1>{title}</h1>{body}</div>',
            "plain": f"<h1>{title}</h1>{body}"}[layout]
    return (f"<html><head><title>{title}</title><style>p{{}}</style><script>if (a<b) x('</p>')</script></head><body>"
            f"<header><p>Site head</p></header><nav><ul><li><a href=/a>A {title}</a><li><a href=/b>B</a></ul></nav>"
            f'<div class="cookie-notice">We use cookies</div><div class="ad">Buy {title}</div>{main}'
            f'<div class="comments"><p>I disagree, {title}</p></div><form><p>Mail <input name=x></p></form>{extra}'
            f"<aside><p>Others</p></aside><footer>&copy; site</footer></body></html>")


SITE = [(i, f"https://a.example/{i}", page(f"Title {i}", [f"First <b>bold {i}</b> text &amp; more.", f"Second\n  {i}&nbsp;x<br>y"]))
        for i in range(30)]
SCHEMA = "page_id long, url string, html string"


def extracted(spark, rows, schema=SCHEMA):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()}


@pytest.mark.parametrize("layout", ["article", "div", "plain"])
def test_main_text_without_the_rest(spark, layout):
    rows = [(i, u, page(f"Title {i}", [f"First <b>bold {i}</b> text &amp; more.", f"Second\n  {i}&nbsp;x<br>y"], layout))
            for i, u, _ in SITE]
    for i, text in extracted(spark, rows).items():
        assert text == f"Title {i}\nFirst bold {i} text & more.\nSecond {i} x y"


def test_template_text_is_left_out_and_copies_stay(spark):
    share = "<p>Share this story with a friend</p>"
    rows = [(i, f"https://share.example/{i}", page(f"T{i}", [f"Body {i}.", share])) for i in range(20)]
    assert extracted(spark, rows) == {i: f"T{i}\nBody {i}." for i in range(20)}
    # a host with copies of one page only keeps its text
    copies = [(i, "http://copy.example/x", page("Same", ["All the same.", "Two."])) for i in range(20)]
    assert set(extracted(spark, copies).values()) == {"Same\nAll the same.\nTwo."}
    # a paragraph that half of the pages share is text
    half = [(i, f"https://half.example/{i}", page(f"T{i}", [f"Body {i}.", *(["Quoted by many."] if i % 2 else [])]))
            for i in range(20)]
    assert extracted(spark, half)[1] == "T1\nBody 1.\nQuoted by many."


def test_unnamed_menus_are_found_by_their_links(spark):
    menu = '<div class="x1"><p><a href="/1">One more</a> <a href="/2">Two more</a></p></div>'
    rows = [(i, f"https://links.example/{i}", page(f"T{i}", [f"Body {i} <a href=z>link</a> and some more."], "plain", menu))
            for i in range(5)]
    assert extracted(spark, rows) == {i: f"T{i}\nBody {i} link and some more." for i in range(5)}


def test_page_edges(spark):
    long = "word " * 200_000
    rows = [(1, None, None), (2, "http://b.example", ""), (3, "relative/path", "no markup &lt; here"),
            (4, "http://b.example/4", "<article><p>open <b>and never closed"), (4, "http://b.example/4", "<article><p>open <b>and never closed"),
            (None, "HTTPS://User@B.example:80/x", "<p>a<p>b<!-- open"), (7, "http://c.example", f"<article><p>{long}</article>"),
            (8, "http://d.example", '<p title="a > b">quoted</p> < 5 <unfinished'), (9, "", "<div><div></div></div>")]
    got = html_text.extract(spark.createDataFrame([(*r, "mine", 5, "row") for r in rows],
                                                  SCHEMA + ", text string, n_chars int, row string"))
    assert got.columns == ["page_id", "url", "row", "text", "n_chars"]
    result = sorted(((r.page_id, r.text, r.n_chars, r.row) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = ["", "", "no markup < here", "open and never closed", "open and never closed", long.strip(), "quoted\n< 5", "", "a\nb"]
    assert [r[1] for r in result] == want
    assert all(r[2] == len(r[1]) and r[3] == "row" for r in result)
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_vectors_are_equal_sums(spark):
    """Classes against occurrence vectors that are kept whole."""
    rows = [(i, "http://v.example/", page(f"T{i}", [f"p{k}" for k in range(i % 4)])) for i in range(12)]
    vectors = {}
    for i, _, html in rows:
        for token, n in html_text._page_tokens(html).items():
            vectors.setdefault(token, {})[i] = n
    wanted = {}
    for token, v in vectors.items():
        wanted.setdefault(frozenset(v.items()), set()).add(token)
    df = spark.createDataFrame(rows, SCHEMA).select(F.lit("v").alias("host"), "html").repartition(5)
    got = {}
    for r in html_text.vectors(df).collect():
        got.setdefault((r.n_pages, r.low, r.high), set()).add((r.kind, r.token))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


# -- 12 fill in the middle --------------------------------------------------------------

def plain_fim(key, text, unit):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n, h = len(units), hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, n)))
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fim_edge_table(edge, unit):
    options = fim.FimOptions(unit=unit, block_bytes=64)
    rows = fim.transform(edge, opt=options, keep_text=True).withColumn("back", fim.restored()).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text, unit)
        assert r.back == (r.text or "")
        assert r.kept == "old" or r.doc_id is None     # other columns stay


def test_fim_clashing_names_and_empty(spark, empty):
    rows = [(1, "a\nb\n<M>c", 7, "x", "y"), (2, "\n\n\n", 7, "x", "y"), (2, "\n\n\n", None, None, None)]
    got = fim.transform(spark.createDataFrame(rows, "doc_id long, text string, n long, form string, output string")).collect()
    assert [(r.n, r.form) for r in got][0] == (3, "plain")
    assert [(r.n, r.output) for r in got][1:] == [plain_fim(2, "\n\n\n", "line")[::4]] * 2
    assert fim.transform(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\né日😀", max_size=40), min_size=1, max_size=8), st.integers(1, 9),
       st.sampled_from(["line", "char"]))
def test_block_index_on_arbitrary_texts(texts, block, unit):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    got = fim.cut_batch(list(range(len(texts))), data, offsets, np.zeros(len(texts), bool),
                        fim.FimOptions(unit=unit, block_bytes=block))
    for k, t in enumerate(texts):
        n, form, p, m, out = plain_fim(k, t, unit)
        assert (got[0][k], got[1][k], got[2][k], got[3][k], got[4][k].decode()) == (n, form, p, m, out)


# -- 13 conversation trie -----------------------------------------------------------------

def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = set()
    for node, convs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(o[:len(m)] == m and len(o) > len(m) for o in below)]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        ends = ",".join(str(c) for c in sorted(c for c in convs if rebuilt[c] == node))
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children),
                 len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversation_rows():
    rows = []
    for c in range(60):
        for t in range(c % 6):
            rows.append((c, t, ["user", "assistant"][t % 2], f"turn {t} of {c // 7 if t < 3 else c % 3}"))
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(5)]          # copies
    rows += [(300, None, None, None), (300, 2, "user", None), (300, 1, None, "x  y")]
    rows += [(-7, 0, "user", "negative"), (421, 0, "user", "no base, maybe no turns"), (423, 0, "user", "a b"), (425, 0, "user", "c")]
    rows += [(500, 1, "user", "twice")] * 2 + [(None, 0, "user", "lost"), (None, None, None, None)]
    return rows


CONV = "conv_id long, turn long, role string, text string"


def test_trie_against_plain_python(spark, monkeypatch):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV + ", depth string, a int")
    got = prefix_trie.build(df.repartition(3)).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain_trie(rows)
    assert prefix_trie.build(spark.createDataFrame([], CONV)).count() == 0


def test_trie_long_conversations_cross_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(c, t, "user", f"w{t} " * (t % 3)) for c in (0, 1, 2, 40) for t in range(30 - c % 7)]
    rows += [(c, t, "user", "hot") for c in range(1000, 1060) for t in range(3)]
    got = prefix_trie.build(spark.createDataFrame(rows, CONV).repartition(4)).collect()
    assert set(map(tuple, got)) == plain_trie(rows)
