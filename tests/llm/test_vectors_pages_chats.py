"""Embeddings, pages and conversations against plain versions."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import embedding, html_text, preference
from tideline.llm.common import shared_dir
from tideline.llm.components import connected_components
from tideline.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_documents import components


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(2001, 2200)]
    df = spark.createDataFrame([*links, *links[:9], (5, 5), (None, 7)], "src long, dst long")
    ids = {x for p in links if p[0] != p[1] for x in p}
    want = components(ids, [p for p in links if p[0] != p[1]])
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [4096, 50])
def test_embeddings(spark, tile, monkeypatch):
    from tideline.llm import bucket_join

    joined = bucket_join.bucket_join
    monkeypatch.setattr(embedding, "bucket_join", lambda rows, counts, match: joined(rows, counts, match, tile, 2 * tile))
    rng = np.random.default_rng(0)
    base = rng.standard_normal((1500, 32))
    noisy = lambda v, n, s: v + rng.standard_normal((n, len(v))) * s * np.linalg.norm(v) / np.sqrt(len(v))
    vectors = [*base, *noisy(base[0], 300, 0.1), *noisy(base[1], 40, 0.2), *noisy(base[2], 60, 0.3), *(base[3] * k for k in (1, 2, 3)), *[base[4]] * 200]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.permutation(np.array(vectors, dtype=np.float32)))]
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] + [1.0] * 31), (9003, [float("inf")] + [1.0] * 31), (9004, []), (9005, [None] + [1.0] * 31), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"w": F.lit("x"), "e": F.lit(1), "id": F.lit(2), "kept": F.lit(3)})
    got = {r.vec_id: r for r in embedding.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    want = near.sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= want).all() and found.sum() / want.sum() > 0.999
    comp = components(range(len(rows)), zip(*(a.tolist() for a in np.nonzero(near))))
    assert np.mean([got[i].component_id == comp[i] for i in range(len(rows))]) > 0.999
    for i in (9000, 9001, 9002, 9003, 9004, 9005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim,codes", [(24, 7), (24, 2), (1, 3), (5, 40)])
def test_filter_decoding_is_exhaustive(dim, codes):
    code = embedding.ProductCode(dim, codes)
    x = embedding._unit(np.random.default_rng(1).standard_normal((50, dim)))
    got, turned = code.decode(x), x @ code.turn
    first = turned[:, : code.half] @ code.codes[0].T
    second = turned[:, code.half :] @ code.codes[1].T if dim > 1 else np.zeros((50, 1))
    score = (first[:, :, None] + second[:, None, :]).reshape(50, -1)
    assert got.shape[1] == min(embedding.LISTED, score.shape[1])
    for i in range(50):
        assert len(set(got[i])) == len(got[i]) and np.allclose(np.sort(score[i][got[i]]), np.sort(score[i])[-len(got[i]) :])


def test_pairs_are_met_once():
    rng = np.random.default_rng(3)
    for n, most in ((40, 12), (300, 2000)):
        q, h = rng.integers(-1, most, (n, 6)), rng.integers(-1, most, (n, 6))
        a, b = (x.ravel() for x in np.indices((n, n)))
        want = [bool(set(q[i][q[i] >= 0]) & set(h[j][h[j] >= 0])) for i, j in zip(a, b)]
        assert embedding._met(q, h, a, b).tolist() == want
        assert embedding._met(q, h, a[:99], b[:99]).tolist() == want[:99]


def test_recall_and_rows_at_two_sizes(spark):
    """Every vector lists as many directions at either size, and pairs at the threshold meet."""
    rng = np.random.default_rng(7)
    for n in (2000, 10_000):
        x = embedding._unit(rng.standard_normal((n // 2, 64)))
        z = rng.standard_normal(x.shape)
        z = embedding._unit(z - (z * x).sum(1, keepdims=True) * x)
        y = 0.951 * x + np.sqrt(1 - 0.951**2) * z
        rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
        got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
        assert sum(r.n_links for r in got) >= 0.995 * n and all(r.n_links <= 1 for r in got)


PAGES = [
    ("<html><head><title>T</title><script>var a='</p><article>';</script></head><body><nav><a>menu</a></nav><header>Top</header>"
     "<article class='post'><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four</p><aside>side</aside><form>f</form><!-- c --><div id='comments'><p>hi</p></div>"
     "<ul><li>x<li>y</ul></article><footer>foot</footer>", "A & B\none two three\nfour\nx\ny"),
    ("<div class=ad>buy</div><main><p>text &lt;here&gt;&nbsp;now</p></main>", "text <here> now"),
    ("plain text", "plain text"),
    ("", ""),
    (None, ""),
    ("<p>unclosed <a href='x>y</a> z", "unclosed y z"),
    ("<article></article>", ""),
]


def test_pages(spark):
    rows = [(i, f"http://h{i}.example/x", h) for i, (h, _) in enumerate(PAGES)] + [(0, "http://h0.example/x", PAGES[0][0]), (None, None, "<p>q</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit(2), "_row": F.lit(3)})
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.main_text(df).collect())
    want = Counter((i, t, len(t)) for i, (_, t) in enumerate(PAGES)) + Counter([(0, PAGES[0][1], len(PAGES[0][1])), (None, "q", 1)])
    assert got == want
    assert html_text.main_text(df.limit(0)).count() == 0


def test_host_boilerplate(spark):
    common = "welcome to our site where we sell many things"
    rows = [(i, f"http://a.example/{i}", f"<div>{common}</div><p>story number {i} has its own words {i * 7}</p>") for i in range(5)]
    rows += [(9, "http://b.example/1", f"<div>{common}</div>"), (10, "http://b.example/1", f"<div>{common}</div>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story number {i} has its own words {i * 7}" for i in range(5))
    assert got[9] == got[10] == common  # one page, so nothing repeats between pages


def sorted_suffix_repeats(streams, least):
    """Per page, places in repeats of at least ``least`` tokens with another page, from sorted suffixes."""
    suffixes = sorted((tokens[i:], page, i) for page, tokens in streams.items() for i in range(len(tokens)))
    covered = {page: set() for page in streams}
    for step in (1, -1):
        for a in range(len(suffixes)):
            mine, page, i = suffixes[a]
            depth, b = len(mine), a + step
            while 0 <= b < len(suffixes) and depth >= least:
                depth = next((k for k, (x, y) in enumerate(zip(mine, suffixes[b][0])) if x != y), min(len(mine), len(suffixes[b][0])))
                if depth >= least and suffixes[b][1] != page:
                    covered[page] |= set(range(i, i + depth))
                    break
                b += step
    return covered


def test_long_pages_with_repeats_inside_and_outside_articles(spark):
    rng = random.Random(5)
    own = lambda n: " ".join(str(rng.random()) for _ in range(n))
    menu, quote, long = own(30), own(40), own(3000)
    rows, want = [], {}
    for i in range(4):
        mine = own(20_000)
        rows.append((i, f"http://a.example/{i}", f"<div>{menu}</div><article><p>{quote}</p><p>{mine}</p></article><div>{long}</div>"))
        want[i] = f"{quote}\n{mine}", 31 + 3001
    mine = own(20_000)
    rows.append((9, "http://a.example/9", f"<div>{menu}</div><p>{mine}</p><p>{long} {mine[:50]}</p>"))
    want[9] = f"{mine}\n{mine[:50]}", 31 + 3000
    got = {r.page_id: (r.text, r.n_repeated) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9][0] == want[9][0] and all(got[i] == want[i] for i in range(4))


def test_articles_are_in_the_order(spark):
    lead, quote = "a lead of nine words that an article begins", "a passage of seven words in two"
    rows = [
        (1, "http://a.example/1", f"<article><p>{lead}</p><p>{quote}</p><p>own words of the first article here</p></article>"),
        (2, "http://a.example/2", f"<div>menu</div><article><p>{quote}</p><p>what the second says is its own</p></article>"),
        (3, "http://a.example/3", f"<div>{lead}</div><p>here is a page without any article of its own</p>"),
        (4, "http://b.example/4", f"<div>{lead}</div>"),
    ]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == f"{lead}\n{quote}\nown words of the first article here" and got[2].text == f"{quote}\nwhat the second says is its own"
    assert got[3].text == "here is a page without any article of its own" and got[4].text == lead
    assert [(got[i].n_repeated, got[i].n_article_repeated) for i in (1, 2, 3, 4)] == [(0, 18), (0, 8), (10, 0), (0, 0)]


def test_repeat_lengths_of_the_order(spark):
    streams = [("u1", "h", b"1", "a b c d e f g x1 x2".split()), ("u2", "h", b"2", "y1 a b c d e f g y2".split()), ("u3", "h", b"3", "a b c d e f z1".split()), ("u4", "g", b"4", "a b c d e f g".split())]
    rows = [(u, h, k, t, [html_text._gram(t[i : i + 6]) for i in range(len(t) - 5)]) for u, h, k, t in streams]
    df = spark.createDataFrame(rows, "url string, host string, _key binary, tokens array<string>, grams array<long>")
    got = {bytes(r._key): sorted((x.s, x.e) for x in r.spans) for r in html_text.repeated_spans(df).collect()}
    assert got == {b"1": [(0, 7), (1, 7)], b"2": [(1, 8), (2, 8)], b"3": [(0, 6)]}


@pytest.mark.parametrize("depth", [48, 7])
def test_repeats_are_those_of_sorted_suffixes(spark, depth, monkeypatch):
    monkeypatch.setattr(html_text, "DEPTH", depth)
    rng = random.Random(4)
    common = [" ".join(rng.choice("abc") for _ in range(n)) for n in (4, 6, 9, 14)]
    pages = {i: [rng.choice(common) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(5)] for i in range(20)}
    shown = lambda i, blocks: ("<article>own text</article>" if i % 2 else "") + "".join(f"<div>{b}</div>" for b in blocks)
    rows = [(i, f"http://a.example/{i}", shown(i, blocks)) for i, blocks in pages.items()]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = sorted_suffix_repeats({i: [w for b in blocks for w in (*b.split(), "\n")] for i, blocks in pages.items()}, html_text.RUN)
    assert {i: r.n_repeated for i, r in got.items()} == {i: len(c) for i, c in want.items()}
    assert any(want[i] for i in pages if i % 2) and all(got[i].text == "own text" for i in pages if i % 2)


def shown(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


TURNS = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", None),
         (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, "alone"), (4, 0, None, "alone"), (None, 0, "user", "lost")]


def test_preference(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "side": F.lit("x"), "pair_id": F.lit(2)})
    pairs = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (1, 2, 3), (2, 4, None), (3, None, None), (4, 77, 0)], "pair_id long, chosen_id long, rejected_id long")
    rows = preference.preference_pairs(df, pairs.withColumns({"conv_id": F.lit("x"), "n": F.lit(1), "prompt": F.lit(2)})).collect()
    got = {r.pair_id: r for r in rows}
    assert len(rows) == len(got) == 5
    assert (got[0].prompt, got[0].chosen) == (shown("user", "q"), shown("assistant", "good"))
    assert got[0].rejected == shown("assistant", "bad") + shown("user", "") and got[0].n_prompt_turns == 1
    start, end = map(int, got[0].chosen_mask.split(":"))
    assert got[0].chosen[start:end] == "good" and got[0].rejected_mask.count(":") == 1
    assert (got[1].prompt, got[1].chosen, got[1].rejected, got[1].chosen_mask) == (shown("user", "same"), "", "", "")
    assert (got[2].prompt, got[2].chosen, got[2].rejected, got[2].rejected_id) == ("", shown("", "alone") * 2, "", None)
    assert tuple(got[3])[3:] == (0, "", "", "", "", "") and got[4].rejected == shown("user", "q") + shown("assistant", "good") and not got[4].chosen
    assert preference.preference_pairs(df.limit(0), pairs.limit(0)).count() == 0


def test_preference_of_long_conversations(spark):
    turns = [(c, i, "assistant" if i % 2 else "user", f"turn {i} " + "é" * 5000) for c in (0, 1) for i in range(400)]
    turns[-3] = (1, 397, "assistant", "other")
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    r = preference.preference_pairs(df, spark.createDataFrame([(7, 0, 1)], "pair_id long, chosen_id long, rejected_id long")).first()
    assert r.n_prompt_turns == 397 and r.prompt == "".join(shown(x[2], x[3]) for x in turns[:397])
    cut = [tuple(map(int, m.split(":"))) for m in r.rejected_mask.split(",")]
    assert [r.rejected[a:b] for a, b in cut] == ["other", turns[399][3]]


def test_swapped_answers(spark):
    turns = [*TURNS, (5, 0, "user", "hm"), (5, 1, "assistant", None), (-3, 0, "assistant", "below")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preference.preference_pairs(*preference.swapped_answers(df)).collect()}
    assert set(got) == set(range(6)) and {i for i, r in got.items() if r.rejected_id is not None} == {0, 1}
    assert (got[0].prompt, got[0].chosen, got[0].rejected) == (shown("user", "q"), shown("assistant", "good"), shown("assistant", "bad"))
    assert got[1].rejected == shown("assistant", "good") + shown("user", "") and got[1].n_prompt_turns == 1


def test_most_pairs_of_the_query_share_turns(spark):
    got = QUERIES["op7_preference"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_prompt_turns > 0 and bool(r.rejected) for r in got) > len(got) / 2


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = Counter(tuple(str(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert Counter(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


def test_pages_leave_only_their_spans_on_disk(spark):
    folder = Path(re.sub("^file:/*", "/", shared_dir(spark))) / "tideline"
    before = set(folder.glob("*"))
    rows = [(i, f"http://a.example/{i}", f"<div>one two three four five six seven</div><article>own {i}</article>") for i in range(4)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    left = set(folder.glob("*")) - before
    assert len(left) == 1 and [r.n_repeated for r in got.collect()] == [8] * 4


def test_grams_of_streams():
    long = "x" * 63 + "yé"
    pages = ["<p>a b c d e f g</p><article>b c d e f g a</article>", "", None, "<article>a b c d e f</article>", f"<p>{long} b c d e f {long}z b c d e f</p>", "<p>abcdefgh abcdefghi a\0 a b c</p>"]
    rows = [(f"http://{h}/{i}", page) for h in "gh" for i, page in enumerate(pages)]
    (x,) = html_text._streams(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["url", "html"])]))
    tokens = [x.text[a:b].decode() for a, b in zip(x.lo, x.hi)]
    got = {}
    for page, at, gram in zip(x.page.tolist(), x.at.tolist(), x.gram.tolist()):
        got.setdefault(gram, set()).add((page >= len(pages), *tokens[at : at + 6]))
    assert all(len(v) == 1 for v in got.values()) and len({v for x in got.values() for v in x}) == len(got)
    want = []
    for page, (_, text) in enumerate(rows):
        own, outside, _ = html_text._page(None, text)
        parts = [w for t, _ in outside for w in (*t.split(), "\n")], [w for t in own for w in (*t.split(), "\n")]
        want += [(page, tuple(p[i : i + 6])) for p in parts for i in range(len(p) - 5)]
    assert [(p, tuple(tokens[a : a + 6])) for p, a in zip(x.page.tolist(), x.at.tolist())] == want


def test_packed_grams_and_merged_repeats():
    rng = random.Random(8)
    for n in (1, 2, 5000):
        own = np.array(sorted(rng.randrange(1 << 28) for _ in range(n)), dtype=np.uint32)
        assert (html_text._unpacked(html_text._packed(own)) == own).all()
    found = [[(rng.randrange(60), rng.randint(6, 9)) for _ in range(rng.randint(1, 8))] for _ in range(300)]
    kind = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i % 256]) for i in range(300)]), pa.array([[{"s": s, "n": n} for s, n in x] for x in found], kind)], names=["piece", "found"])
    (out,) = html_text._merged(iter([batch.slice(7)]))
    for x, y in zip(found[7:], out.column(1).to_pylist(), strict=True):
        covered = {p for s, n in x for p in range(s, s + n)}
        assert {p for r in y for p in range(r["s"], r["s"] + r["n"])} == covered
        assert len(y) == sum(p - 1 not in covered for p in covered)
