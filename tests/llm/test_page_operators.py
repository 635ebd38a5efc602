"""Revisits, page extraction and vectors against brute force, and on awkward tables."""

import gzip
import io
import itertools
import os
import random
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import embed_dedup, entry, html_cut, warc
from llm.test_text_operators import check_classes, classes_of

SF = "/root/testdata/sf0.001"

# ---- revisits -------------------------------------------------------------------------------------------------------

RECORD = "record_id string, kind string, url string, captured_at long, status int, headers map<string,string>, digest string"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_latest_earlier_response_and_headers(spark):
    full = {"ETag": '"1"', "Content-Type": "text/html", "X": "old"}
    rows = [
        ("r1", "response", "http://www.a.com/x/?b=2&a=1#f", 10, 200, full, "d1"), ("r2", "response", "https://a.com/x?a=1&b=2", 20, 200, full | {"X": "new"}, "d2"),
        ("r3", "response", "http://a.com/x?a=1&b=2", 20, 500, full, "d3"), ("r4", "response", "http://a.com/x?a=1&b=2&utm_source=q", 40, 200, full, "d4"),
        ("v1", "revisit", "a.com/x?a=1&b=2", 30, 304, {"etag": 'W/"1"', "Content-Type": "x", "Y": "z"}, None), ("v2", "revisit", "http://A.com:80/x?a=1&b=2", 20, 304, {"ETag": '"1"'}, None),
        ("v3", "revisit", "http://a.com/x?a=1&b=2", 5, 304, {"ETag": '"1"'}, None), ("v4", "revisit", "http://a.com/x?a=1&b=2", 50, 304, {"ETag": '"9"'}, "d4"),
        ("v5", "revisit", "http://a.com/x?a=1&b=2", 50, 304, {}, "d4"), ("v6", "revisit", "http://a.com/x?a=1&b=2", 50, 304, None, None),
    ]
    got = {r.revisit_id: r for r in warc.resolve_revisits(records(spark, rows)).collect()}
    assert {k: (r.verdict, r.response_id) for k, r in got.items()} == {
        "v1": ("etag", "r2"), "v2": ("etag", "r1"), "v3": ("orphan", None), "v4": ("changed", None), "v5": ("digest", "r4"), "v6": ("unverifiable", None),
    }
    assert got["v1"].headers == 'content-type: text/html\netag: W/"1"\nx: new\ny: z' and got["v1"].digest == "d2"


def test_as_of_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "warcinfo"])
        tag = rng.choice([None, "a", "b"])
        rows.append((rng.choice([f"id{i}", None]) if kind == "response" else f"v{i}", kind, rng.choice(["u.com/1", "u.com/2", None]), rng.choice([*range(20), None]), rng.choice([200, 404, 304]), {"etag": tag} if tag else None, rng.choice([None, "d"])))
    got = sorted((r.revisit_id, r.response_id or "", r.verdict) for r in warc.resolve_revisits(records(spark, rows)).collect())
    want = []
    for v in rows:
        if v[1] != "revisit":
            continue
        fits = [r for r in rows if r[1] == "response" and r[4] == 200 and None not in (r[0], r[2], r[3]) and v[2] == r[2] and v[3] is not None and r[3] < v[3]]
        best = max(fits, key=lambda r: (r[3], r[0]), default=None)
        verdict = "orphan"
        if best:
            tags = (v[5] or {}).get("etag"), (best[5] or {}).get("etag")
            verdict = ("etag" if tags[0] == tags[1] else "changed") if all(tags) else "digest" if v[6] and best[6] else "unverifiable"
        want.append((v[0], best[0] if verdict in ("etag", "digest") else "", verdict))
    assert got == sorted(want)
    assert warc.resolve_revisits(records(spark, [])).count() == 0


def test_revisits_ignore_other_columns_and_repeats(spark):
    rows = [("r", "response", "u.com", 1, 200, {"ETag": "x"}, None)] * 2 + [("v", "revisit", "u.com", 2, 304, {"ETag": "x"}, None)] * 2
    df = records(spark, rows).withColumns({c: F.lit("!") for c in ("url_key", "full", "mine", "verdict", "body", "lost")})
    assert [(r.revisit_id, r.response_id) for r in warc.resolve_revisits(df).collect()] == [("v", "r")] * 2


def test_warc_files(spark, tmp_path):
    import gzip

    parts = [
        warc.format_record("response", "urn:1", "http://a.com/", "2026-01-01T00:00:00Z", 200, {"ETag": '"q"', "Content-Type": "text/html"}, b"<p>WARC/1.1 inside</p>\r\n\r\n", "sha1:x"),
        warc.format_record("revisit", "urn:2", "http://a.com/", "2026-01-02T00:00:00Z", 304, {"ETag": '"q"'}, b""),
        warc.format_record("warcinfo", "urn:3", "", "bad date", None, {}, b"software: x"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)) )
    rows = warc.read_warc(spark, str(tmp_path))
    assert rows.count() == 6
    one = rows.where("record_id = 'urn:1'").first()
    assert (one.status, one.headers["etag"], bytes(one.body)) == (200, '"q"', b"<p>WARC/1.1 inside</p>\r\n\r\n")
    assert rows.where("record_id = 'urn:3'").first().captured_at is None
    assert {(r.revisit_id, r.response_id, r.verdict) for r in warc.resolve_revisits(rows.dropDuplicates(["record_id"])).collect()} == {("urn:2", "urn:1", "etag")}
    assert list(warc.parse_warc(b"".join(parts)[:-40]))[:2] == list(warc.parse_warc(b"".join(parts)))[:2]
    assert list(warc.parse_warc(b"")) == [] and list(warc.parse_warc(b"noise")) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name, table", [("op5_revisit_resolution", "pages"), ("op10_embedding_near_dedup", "embeddings")])
def test_queries_equal_sql(spark, name, table):
    from tidemark.llm import entry

    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_dirty_headers_and_a_hot_url(spark):
    rows = [("r1", "response", "u.com/a", 1, 200, {"ETag": '"1"', "etag": '"2"', "ETAG": '"0"'}, None), ("v1", "revisit", "u.com/a", 2, 304, {"etag": '"2"'}, None)]
    got = warc.resolve_revisits(records(spark, rows)).first()
    assert (got.verdict, got.headers) == ("etag", 'etag: "2"')
    rng = random.Random(5)
    rows = [(f"x{i}", rng.choice(["response", "revisit"]), rng.choice(["hot.com/", "hot.com", "b.com", "c.com"]), rng.randrange(60), rng.choice([200, 200, 500]), {"ETag": f'"{rng.randrange(3)}"', "N": str(i)}, None) for i in range(400)]
    whole = sorted(map(repr, warc.resolve_revisits(records(spark, rows)).collect()))
    for span in (150, 20, 3):
        assert sorted(map(repr, warc.resolve_revisits(records(spark, rows), span).collect())) == whole


def test_cut_and_trailing_gzip():
    parts = [warc.format_record("response", f"urn:{i}", f"http://a.com/{i}", "2026-01-01T00:00:00Z", 200, {"ETag": str(i)}, b"x" * 5000 + bytes(range(256)) * i) for i in range(4)]
    plain = list(warc.parse_warc(b"".join(parts)))
    packed = b"".join(map(gzip.compress, parts))
    assert list(warc.parse_warc(packed)) == plain and list(warc.parse_warc(gzip.compress(b"".join(parts)))) == plain and list(warc.parse_warc(io.BytesIO(packed))) == plain
    assert list(warc.parse_warc(packed + b"trailing bytes")) == plain and list(warc.parse_warc(packed + bytes(512))) == plain
    assert list(warc.parse_warc(packed[:-60]))[:3] == plain[:3]
    for cut in range(0, len(packed), 97):
        got = list(warc.parse_warc(packed[:cut]))
        assert got == plain[: len(got)]
    damaged = bytearray(packed)
    damaged[len(packed) // 2] ^= 255
    got = list(warc.parse_warc(bytes(damaged)))
    assert got[:1] == plain[:1] and len(got) <= 4
    head = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: -5\r\n\r\n"
    assert [r[1] for r in warc.parse_warc(head + parts[0])] == ["response"]
    long_body = warc.format_record("response", "urn:l", "http://a.com/l", "2026-01-01T00:00:00Z", 200, {}, b"y" * 20_000_000)
    assert len(next(warc.parse_warc(gzip.compress(long_body, 1)))[-1]) == 20_000_000


@settings(max_examples=100, deadline=2000)
@given(st.binary(max_size=300))
def test_any_bytes_are_parsed(data):
    list(warc.parse_warc(data))
    list(warc.parse_warc(b"WARC/1.1\r\n" + data))
    list(warc.parse_warc(b"\x1f\x8b" + data))


# ---- page extraction ------------------------------------------------------------------------------------------------


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 8)
        s, t = ([rng.randrange(6) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rng.randrange(5)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side):
            return sum(t[i] if x else s[i] for i, x in enumerate(side)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023

        got = html_cut.max_flow_cut(n, s, t, edges)
        assert cost(got) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_blocks():
    page = "<html><head><title>T &amp; t</title><style>x{}</style></head><body><nav><a href=x>Home</a> <a>News</a></nav><p>One <b>two</b><br>three<p>Four<!-- no --><script>if (a<b) {}</script><div class='sidebar'>S</div></body>"
    got = [(b.text, b.place, b.tag) for b in html_cut.blocks_of(page)]
    assert got == [("Home News", -1, "nav"), ("One two three", 0, "p"), ("Four", 0, "p"), ("S", -1, "div")]
    assert html_cut.blocks_of(page)[0].linked >= 8
    assert html_cut.blocks_of("") == [] and [b.text for b in html_cut.blocks_of("plain < text")] == ["plain < text"]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><body><article><p>Real content</p></article>", "<html><head><meta charset=x><link rel=y><script>a<b</script><article><p>Real content", "<head><title>t</title>Real content",
        "<head><style>x{}</style></head><body><p>Real content", "<head><!-- <body> --><noscript><link></noscript><template><p>no</p></template><title>t</title><p>Real content", "<p>Real content<script>to the end <p>no",
        "<noscript><p>Real content", "<svg><p>Real content", "<template><p>Real content", "<svg><text>no</text></svg><p>Real content<style>no",
    ],
)
def test_missing_end_tags_lose_no_text(page):
    assert [b.text for b in html_cut.blocks_of(page)] == ["Real content"]


def test_attributes_titles_and_stray_ends():
    assert [b.text for b in html_cut.blocks_of("<p title=\"a > b\">x</p><p class='c>d'>y<p class=it's>z")] == ["x", "y", "z"]
    assert html_cut.title_of("<title>A\n b &amp; c</title>") == "A b & c" and html_cut.title_of("<title>open") is None and html_cut.title_of("<p>") is None
    assert [b.text for b in html_cut.blocks_of("</x><div>a</y><p>b</div></div>c<head>d")] == ["a", "b", "c", "d"]


@pytest.mark.parametrize(
    "part", ["<title>", "<svg>", "<head><title>", "<noscript>", "<div></x>", '<a ="', "<!--", "<!", "<a ", "<p>", "<template>x", "<title", "&#", "<li></ul>", "<div class='", "<head>"]
)
def test_blocks_in_linear_time(part):
    began = time.perf_counter()
    page = part * (300_000 // len(part))
    html_cut.blocks_of(page)
    html_cut.title_of(page)
    assert time.perf_counter() - began < 8


@settings(max_examples=200, deadline=2000)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x'>", "</div>", "<head>", "</head>", "<title>", "</title>", "<svg>", "</svg>", "<script>", "</script>", "a b", " ", "<a href=\"", "\">", "<!--", "-->", "<", ">", "&lt;", "<br/>", "<td>"]), max_size=40))
def test_any_page_has_blocks(parts):
    blocks = html_cut.blocks_of("".join(parts))
    assert all(b.text and b.text == b.text.strip() and 0 <= b.linked <= len(b.text) for b in blocks)
    assert len(html_cut.label(blocks, html_cut.default_tables())) == len(blocks)


def test_the_cut_decides_against_the_classifier():
    """A short block between long ones is boilerplate by its own features, content by its neighbours; and the reverse."""
    body = " ".join(["This sentence, with commas, belongs to the article and says something."] * 4)
    page = f"<div><p>{body}</p><p>{body}</p><p>Short one.</p><p>{body}</p></div>" + "<ul>" + "".join(f"<li><a href={i}>Link number {i}</a></li>" for i in range(6)) + "</ul>"
    blocks = html_cut.blocks_of(page)
    tables = html_cut.default_tables()
    alone, together = html_cut.unary(blocks, tables) > 0, html_cut.label(blocks, tables)
    at = [b.text for b in blocks].index("Short one.")
    assert not alone[at] and together[at] and together[:4] == [True] * 4 and not any(together[4:])


def test_features_and_tables_by_hand(spark):
    blocks = html_cut.blocks_of("<nav><a>one two</a></nav><article><p>a, b. c! d? e f g h i j</p></article>")
    assert html_cut.block_features(blocks).tolist() == [[0, 5, 0, 11, 1, 3], [3, 0, 5, 1, 0, 0]]
    page = "<nav><a>one two</a></nav><article><p>a, b. c! d? e f g h i j</p></article>"
    tables = html_cut.train_tables(spark.createDataFrame([(1, page), (2, page), (None, page)], "page_id long, html string"))
    # two blocks a class: a bin that both hold has odds of (2 + 1) / (2 + bins), one that none holds 1 / (2 + bins)
    for t, bad, good in zip(tables, *html_cut.block_features(blocks).tolist()):
        want = np.zeros(len(t))
        if bad != good:
            want[good], want[bad] = 0.5 * np.log(3), -0.5 * np.log(3)
        assert np.allclose(t, want)


def test_extraction_keeps_the_article(spark):
    body = " ".join(["This sentence, with commas, belongs to the article and says something."] * 4)
    page = f"<title>A</title><nav><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></nav><div><p>{body}</p><p>{body}</p><p>Short one.</p><p>{body}</p></div><footer>Copyright</footer>"
    rows = [(1, page, "x"), (1, page, "x"), (2, "", None), (3, None, None), (None, page, "x"), (4, "<p>" * 3000 + "deep", "x"), (5, "<div>" + "word " * 200_000 + "</div>", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, title string").withColumns({c: F.lit(1) for c in ("text", "blocks", "h")})
    got = {r.page_id: r for r in html_cut.extract_content(df).collect()}
    assert got[1].text == "\n".join([body, body, "Short one.", body]) and got[1].title == "A"
    assert (got[2].text, got[2].blocks, got[3].text, got[3].title) == ("", 0, None, None)
    assert len(html_cut.extract_content(df).collect()) == 6 and got[5].blocks == 1
    assert html_cut.extract_content(df.where("false")).count() == 0


def test_page_query_equals_one_page_at_a_time(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    tables = html_cut.train_tables(pages)
    got = {r.page_id: (r.text, r.blocks, r.content_blocks) for r in html_cut.extract_content(pages).collect()}
    for r in pages.collect():
        blocks = html_cut.blocks_of(r.html)
        keep = html_cut.label(blocks, tables)
        assert got[r.page_id] == ("\n".join(b.text for b, k in zip(blocks, keep) if k), len(blocks), sum(keep))
        # the labelling is a minimum: turning over any one block, or none, costs no less
        w = np.rint(html_cut.unary(blocks, tables) * html_cut.SCALE)
        edges = html_cut.smoothness(blocks)
        cost = lambda side: sum(max(-x, 0) if k else max(x, 0) for x, k in zip(w, side)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: B023, E731
        base = cost(keep)
        assert all(cost([k ^ (i == j) for j, k in enumerate(keep)]) >= base for i in range(len(keep)))
    assert sum(bool(t) for t, _, _ in got.values()) >= 0.9 * len(got)


# ---- vectors --------------------------------------------------------------------------------------------------------


def clusters(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[: n // 2] + rng.uniform(0.0, 0.4, (n // 2, 1)) * rng.standard_normal((n // 2, dim)) / np.sqrt(dim)
    return np.concatenate([base, near, base[:5], 3 * base[:3]])


def cosine_pairs(v, t):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u.T
    return {(i, j): c[i, j] for i, j in zip(*np.nonzero(np.triu(c >= t, 1)))}


@pytest.mark.parametrize("block", [4096, 6])
def test_pairs_and_classes_against_brute_force(spark, block):
    v = clusters(300, 32, 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = embed_dedup.near_duplicate_vectors(df, block=block).collect()
    got = {(r.vec_a, r.vec_b): r.cosine for r in rows}
    every = cosine_pairs(v, embed_dedup.THRESHOLD)
    keys = {i: x.tobytes() for i, x in enumerate(v)}
    rep = {k: min(i for i in keys if keys[i] == k) for k in keys.values()}
    # equal vectors stand by the least of them, with which the others are paired
    want = {(a, b): c for (a, b), c in every.items() if (rep[keys[a]] == a and rep[keys[b]] == b) or keys[a] == keys[b]}
    assert len(got) == len(rows) and set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[p] == pytest.approx(want[p]) for p in got)
    classes = {r.vec_id: (r.class_id, r.copies, r.links) for r in embed_dedup.near_duplicate_classes(df, block=block).collect()}
    check_classes(classes, classes_of(keys, every), 0.95)


def test_vectors_on_awkward_tables(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, [nan, 1.0]), (6, []), (7, [1.0, 0.0, 0.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 0.0]), (11, [0.0, 1.0]), (11, [1.0, 0.02])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("id", "v", "t", "h", "keys", "unit", "n", "blocks", "block", "digest", "component", "weight")})
    assert {(r.vec_a, r.vec_b) for r in embed_dedup.near_duplicate_vectors(df).collect()} == {(1, 2), (1, 10), (1, 11), (2, 11)}
    got = {tuple(r) for r in embed_dedup.near_duplicate_classes(df).collect()}
    assert got == {(1, 1, 2, 2), (2, 1, 1, 2), (10, 1, 2, 2), (7, 7, 1, 0), (11, 1, 2, 2)}
    for f in (embed_dedup.near_duplicate_vectors, embed_dedup.near_duplicate_classes):
        assert f(df.where("false")).count() == 0


def test_vector_queries_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    for name in ("op10_embedding_near_dedup", "near_copies_of_vectors"):
        got = sorted(tuple(r) for r in entry.queries()[name](spark, SF).select("vec_id", "class_id", "copies", "links").collect())
        assert got == sorted(con.execute(f"SELECT vec_id, class_id, copies, links FROM ({entry.oracle_sql()[name]})").fetchall())
    assert sum(r[3] for r in got) >= 3 * len(got) / 5


def test_collision_probability():
    rng = np.random.default_rng(0)
    for distance in (0.3, 1.0, 2.0):
        a, b = rng.standard_normal(200_000), rng.uniform(0, 1.5, 200_000)
        share = np.mean(np.floor(b / 1.5) == np.floor((a * distance + b) / 1.5))
        assert embed_dedup.collide(1.5 / distance) == pytest.approx(share, abs=0.01)
