import hashlib
import math
import random
import struct
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import CorpusError
from tidemark.functions.hashing import chunk_id, citation_id, little_endian, parse_citation
from tidemark.functions.stats import nearest_ranks
from tidemark.functions.text import check_window, join_parts, label_of, rating_label, squash, tokens, windows
from tidemark.functions.vector import dequantize_int8, float16, quantize_int8, unit
from tidemark.sources.container import chunk_id as chunk_id_plain
from tidemark.sources.container import quantize

GOLDEN = "sha256:d8f065a4cb7deaa39b68ddb63adbe28f2ffb9988eac55fb4573917c5eba2a5dd"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_chunk_id_is_the_known_one(spark):
    got = one(spark, chunk_id(F.lit("hi"), F.lit("doc.txt"), F.lit(0), F.lit(2), F.lit("demo-chunker/1")))
    assert got == GOLDEN == chunk_id_plain("hi", "doc.txt", 0, 2, "demo-chunker/1")


def test_chunk_id_depends_on_every_part():
    base = ("text", "uri", 0, 4, "v/1")
    others = [("text!", *base[1:]), ("text", "uri2", *base[2:]), ("text", "uri", 1, 4, "v/1"), ("text", "uri", 0, 5, "v/1"), ("text", "uri", 0, 4, "v/2")]
    assert len({chunk_id_plain(*x) for x in [base, *others]}) == 6


@settings(max_examples=10, deadline=None)
@given(rows=st.lists(st.tuples(st.text(max_size=20), st.text(max_size=8), st.integers(0, 2**40)), min_size=1, max_size=20))
def test_chunk_id_agrees_with_plain_python(spark, rows):
    rows = [(t.encode("utf-8", "ignore").decode(), u.encode("utf-8", "ignore").decode(), n) for t, u, n in rows]
    df = spark.createDataFrame(rows, "t string, u string, n long")
    got = df.select("t", "u", "n", chunk_id(F.col("t"), F.col("u"), F.col("n"), F.col("n") + 1, F.lit("c/1")).alias("id")).collect()
    assert all(r.id == chunk_id_plain(r.t, r.u, r.n, r.n + 1, "c/1") for r in got)


def test_little_endian(spark):
    for n in (0, 1, 255, 256, 2**31 - 1):
        assert bytes(one(spark, little_endian(F.lit(n), 8))) == struct.pack("<Q", n)


def test_windows_follow_code_points_and_bytes(spark):
    text = "olá mundo 😀 até logo"
    got = one(spark, windows(F.lit(text), 10, 3))
    raw, step = text.encode(), 7
    assert [w.piece for w in got] == [text[i : i + 10] for i in range(0, len(text) - 3, step)]
    assert all(raw[w.byte_start : w.byte_end].decode() == w.piece for w in got)
    assert got[-1].byte_end == len(raw)
    assert one(spark, windows(F.lit(""), 10, 3)) == []
    assert len(one(spark, windows(F.lit("x" * 10), 10, 3))) == 1


@pytest.mark.parametrize("size, overlap", [(0, 0), (-1, 0), (5, 5), (5, -1)])
def test_windows_refuse_bad_sizes(size, overlap):
    with pytest.raises(CorpusError):
        check_window(size, overlap)


def test_tokens(spark):
    got = one(spark, tokens(F.lit("Olá, é a Acentuação! x1 B2B  é")))
    assert got == ["olá", "acentuação", "x1", "b2b"]
    assert one(spark, tokens(F.lit(None).cast("string"))) == []


def test_squash_and_join(spark):
    assert one(spark, squash(F.lit(" a\t\n b c "))) == "a b c"
    assert one(spark, squash(F.lit(None).cast("string"))) == ""
    assert one(spark, join_parts(F.lit("a "), F.lit("  "), F.lit(None).cast("string"), F.lit("b"))) == "a b"


def test_labels(spark):
    m = {"fake": "False", "true": "True"}
    assert [one(spark, label_of(F.lit(x), m)) for x in ("FAKE", "true", "other")] == ["False", "True", "other"]
    assert [one(spark, rating_label(F.lit(x).cast("double"))) for x in (1, 2.9, 3, 3.7, 4, None)] == ["False", "False", None, None, "True", None]


def test_citations(spark):
    cite = one(spark, citation_id(F.lit("sha256:aa"), F.lit("sha256:bb")))
    for text in (cite, cite + "/more", cite.replace("sha256:aa", "aa")):
        p = one(spark, parse_citation(F.lit(text)))
        assert (p.content_hash, p.chunk_id) == ("sha256:aa", "sha256:bb")


def test_quantisation_agrees_with_numpy(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((50, 16)).astype(np.float32)
    v[0] = 0
    v[1, :] = [0.5, -0.5] * 8
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i int, v array<float>")
    got = df.select("i", quantize_int8(F.col("v")).alias("z"), float16(F.col("v")).alias("h")).select("*", dequantize_int8(F.col("z")).alias("d")).orderBy("i").collect()
    scale, q = quantize(v)
    assert np.array_equal(np.array([r.z.q for r in got]), q)
    assert np.array_equal(np.array([r.z.scale for r in got], np.float32), scale)
    assert np.array_equal(np.array([r.h for r in got], np.float32), v.astype(np.float16).astype(np.float32))
    error = np.abs(np.array([r.d for r in got]) - v).max(axis=1)
    assert (error <= scale * 0.505).all()


def test_float16_edges(spark):
    values = [0.0, 1.0, -2.0, 6.1e-5, 6.0e-8, 2.9e-8, 65504.0, 0.1, 1 / 3, 2**-24, 3 * 2**-25]
    got = one(spark, float16(F.array(*(F.lit(x).cast("float") for x in values))))
    assert np.array_equal(np.array(got, np.float32), np.array(values, np.float32).astype(np.float16).astype(np.float32))


def test_unit_of_zero_is_null(spark):
    assert one(spark, unit(F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_nearest_ranks(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2)] + [(None,)], "x double")
    # (n - 1) * 0.5 = 1.5: even takes index 2, away takes 2; (n - 1) / 6 = 0.5: even takes 0, away 1
    got = nearest_ranks(df, "x", {"a": (0.5, "even"), "b": (1 / 6, "even"), "c": (1 / 6, "away"), "d": (1.0, "even"), "e": (0.0, "away")}).first()
    assert tuple(got) == (4, 1, 2, 5, 1)
    assert math.isnan(nearest_ranks(df.where("false"), "x", {"a": (0.5, "even")}).first().a)


@pytest.mark.parametrize("sorted_whole", [10**6, 0])
def test_nearest_ranks_of_groups(spark, sorted_whole):
    """Whole groups sorted, and only what lies near a rank: equal, with ties, NaN, null keys and a group without values."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([float(rng.randrange(50)), rng.random(), float("nan")])) for _ in range(4000)] + [("none", None), ("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = {"p0": (0.0, "even"), "p50": (0.5, "even"), "p95": (0.95, "away"), "p100": (1.0, "even")}
    got = {r.g: tuple(r)[1:] for r in nearest_ranks(df, "x", wanted, ("g",), sorted_whole).collect()}
    assert set(got) == {"a", "b", None, "none", "one"}
    for g, values in got.items():
        own = sorted((x for k, x in rows if k == g and x is not None), key=lambda x: (math.isnan(x), x))
        for value, (p, ties) in zip(values, wanted.values()):
            if not own:
                assert math.isnan(value)
                continue
            at = (len(own) - 1) * p
            want = own[round(at) if ties == "even" else math.floor(at + 0.5)]
            assert value == want or (math.isnan(value) and math.isnan(want))


def windows_by_hand(text, size, overlap):
    out, step, at = [], size - overlap, 0
    while text:
        start = len(text[:at].encode())
        piece = text[at : at + size]
        out.append((piece, start, start + len(piece.encode())))
        if at + size >= len(text):
            break
        at += step
    return out


@pytest.mark.parametrize("size, overlap", [(512, 64), (10, 0), (7, 6), (3, 1), (100, 99)])
def test_windows_over_parts(spark, size, overlap):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aé漢😀\n ") for _ in range(n)) for n in (0, 1, 2, 9, 10, 11, 63, 64, 65, 449, 640, 5000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", windows(F.col("t"), size, overlap).alias("w")).collect()}
    assert got.pop(99) is None
    assert {i: [tuple(x) for x in w] for i, w in got.items()} == {i: windows_by_hand(t, size, overlap) for i, t in enumerate(texts)}


def test_windows_of_a_long_text_take_linear_time(spark):
    df = spark.createDataFrame([("word é " * 300_000,)], "t string")
    began = time.perf_counter()
    n = df.select(F.size(windows(F.col("t"), 512, 64)).alias("n")).first().n
    assert n == 1 + math.ceil((2_100_000 - 512) / 448) and time.perf_counter() - began < 30


def test_source_uri_prefix(spark):
    from tidemark.functions.hashing import source_uri

    got = one(spark, source_uri(F.lit("src"), F.lit("é")))
    assert got.endswith("/src/" + hashlib.sha256("é".encode()).hexdigest()[:16])
