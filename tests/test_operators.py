"""DataFrame operators on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewise.functions import bits, rans
from planewise.operators import coding, container, delta, elements, ordered, palette, sparse, stats, store
from planewise.streaming import ingest

SPECIAL = [0.0, -0.0, 1.0, -1.0, float("inf"), float("-inf"), float("nan"), 5e-324, 1.7976931348623157e308, None]


def test_bits_keep_signs_and_nulls(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(SPECIAL)], "i int, x double")
    got = {r.i: r.u for r in df.select("i", bits.f64_bits(F.col("x")).alias("u")).collect()}
    assert got[9] is None
    for i, x in enumerate(SPECIAL[:9]):
        assert got[i] == np.array(x).view(np.int64)
    got = {r.i: r.u for r in df.select("i", bits.f32_bits(F.col("x").cast("float")).alias("u")).collect()}
    assert got[1] == 1 << 31 and got[9] is None


def test_unsigned_order(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, -1, -(1 << 63), (1 << 63) - 1)], "u long")
    assert [r.u for r in df.orderBy(bits.unsigned_key(F.col("u"))).collect()] == [0, 1, (1 << 63) - 1, -(1 << 63), -1]


@pytest.mark.parametrize("width", [2, 4, 8])
def test_planes_join_again(spark, width):
    mask = (1 << (8 * width)) - 1
    values = [x & mask for x in (0, 1, 255, 256, 0x0123456789ABCDEF, 0xFFFFFFFFFFFFFFFF)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "i int, u long")
    back = elements.planes(df, "u", width, "i").groupBy("i").agg(bits.join_bytes(F.col("byte"), F.col("plane")).alias("u"))
    assert sorted(map(tuple, back.collect())) == list(enumerate(signed))


def test_bf16_rounding(spark):
    x = np.concatenate([np.random.default_rng(0).normal(size=500).astype(np.float32), np.array([1.00390625, 1.01171875, 0.0, -0.0], np.float32)])
    u = x.view(np.uint32).astype(np.int64)
    got = [r.h for r in spark.createDataFrame([(i, int(v)) for i, v in enumerate(u)], "i int, u long").orderBy("i").select(bits.bf16_rounded(F.col("u")).alias("h")).collect()]
    near = np.abs(((np.array(got, np.uint32)) << 16).view(np.float32) - x)
    other = np.minimum(*(np.abs((((u >> 16) + d).astype(np.uint32) << 16).view(np.float32) - x) for d in (0, 1)))
    assert (near <= other).all()


def test_registry():
    assert bits.dtype("BFLOAT16").code == "bf16" and bits.dtype(None).code == "raw" and bits.resolve_spec("fp16").mantissa == 10
    with pytest.raises(KeyError):
        bits.resolve_spec("fp64")
    with pytest.raises(ValueError):
        bits.dtype("int4")


def test_frequencies_match_the_coder(spark):
    counts = np.random.default_rng(1).integers(0, 5000, 256)
    df = spark.createDataFrame([(int(s), int(n)) for s, n in enumerate(counts) if n], "sym int, n long")
    got = {r.sym: r.freq for r in stats.frequencies(df, "sym").collect()}
    assert got == {s: int(f) for s, f in enumerate(rans.normalise(counts, 14)) if f}
    cum = stats.cumulative(stats.frequencies(df, "sym"), "sym").orderBy("sym").collect()
    assert cum[0]["cum"] == 0 and cum[-1]["cum"] + cum[-1]["freq"] == 1 << 14


def test_entropy(spark):
    h = spark.createDataFrame([("a", k, 10) for k in range(8)] + [("b", 0, 7)], "t string, s int, n long")
    got = {r.t: r.bits for r in stats.entropy(h, "t").collect()}
    assert got["a"] == pytest.approx(3) and got["b"] == pytest.approx(0)


def test_segments(spark):
    df = spark.range(10).select("id", stats.segment(F.col("id"), F.lit(10)).alias("s"))
    assert [r.s for r in df.orderBy("id").collect()] == [sum(p >= 10 * s // 4 for s in (1, 2, 3)) for p in range(10)]


def test_arrays_agree_with_elements(spark):
    """The operators on arrays, a tensor a row, give what those on element rows give."""
    rng = np.random.default_rng(11)
    tensors = {k: rng.integers(-(1 << 40), 1 << 40, n) * (rng.random(n) < 0.6) for k, n in enumerate((0, 1, 7, 8, 9, 64, 200))}
    rows = spark.createDataFrame([(k, [int(x) for x in v]) for k, v in tensors.items()], "t int, us array<bigint>")
    bitmap, dense = sparse.encode_arrays(F.col("us"))
    coded = rows.select("t", "us", bitmap.alias("b"), dense.alias("d"), F.size("us").alias("n"))
    back = coded.select("t", "b", "d", sparse.decode_arrays(F.col("b"), F.col("d"), F.col("n")).alias("vs"), elements.join(elements.split(F.col("us"), 8)).alias("ws"))
    for r in back.collect():
        v = tensors[r.t]
        assert r.vs == r.ws == v.tolist() and r.d == v[v != 0].tolist() and r.b == np.packbits(v != 0).tolist()
    other = rows.select("t", F.transform("us", lambda u: u * 3 + 1).alias("us")).where("t != 3")
    got = {r.t: r.us for r in delta.xor_arrays(rows, other, "t").collect()}
    assert got == {k: (v ^ (v * 3 + 1)).tolist() for k, v in tensors.items() if k != 3}
    assert delta.xor_arrays(rows, rows.withColumn("us", F.slice("us", 1, 5)), "t").count() == 2  # unlike lengths are no pair


def test_patterns_of_arrays(spark):
    floats = [[1.5, -0.0, float("nan")], [], None, [float("inf"), None, 2.0**-140]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(floats)], "i int, x array<float>").repartition(1)
    got = {r.i: r.us for r in rows.select("i", bits.f32_array_bits(F.col("x")).alias("us")).collect()}
    assert got[1] == [] and got[2] is None and got[3][1] is None and got[3][::2] == [0x7F800000, 1 << 9] and got[0][:2] == [0x3FC00000, 0x80000000]
    whole = rows.select("i", bits.f32_array_bits(F.col("x")).alias("us")).where("i < 2")
    packed = whole.select("i", "us", bits.packed_patterns(F.col("us"), 4).alias("p"), bits.packed_patterns(F.col("us"), 8).alias("q"))
    for r in packed.select("us", "p", bits.unpacked_patterns(F.col("p"), 4).alias("a"), bits.unpacked_patterns(F.col("q"), 8).alias("b")).collect():
        assert r.a == r.b == r.us and bytes(r.p) == np.array(r.us, "<u4").tobytes()


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    ids = rng.choice(10_000, 700, replace=False)
    df = spark.createDataFrame([(int(i), int(i) % 7) for i in ids], "k long, n long").repartition(5)
    got = {r.k: r.before for r in ordered.exclusive_sums(df, "k", {"before": "n"}, buckets=16).collect()}
    at, expect = 0, {}
    for k in sorted(ids):
        expect[int(k)], at = at, at + int(k) % 7
    assert got == expect
    assert ordered.exclusive_sums(df.where("false"), "k", {"before": "n"}).count() == 0


def _tensor(spark, values):
    return spark.createDataFrame([(t, p, v) for t, vs in values.items() for p, v in enumerate(vs)], "t string, pos long, u long")


def test_sparse(spark):
    e = _tensor(spark, {"a": [0, 5, 0, 0, -1, 0, 0, 0, 7], "b": [0] * 9, "c": [1] * 16, "d": [0] + [3] * 9, "e": [0] + [3] * 10, "minus zero": [1 << 31] * 3})
    sizes = e.groupBy("t").agg(F.count("*").alias("size"))
    back = sparse.decode(sparse.bitmap(e, "t"), sparse.dense_values(e, "t"), sizes, "t")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))
    fires = {r.t: r.fires for r in sparse.gate(e, "t").collect()}
    assert fires == {"a": True, "b": True, "c": False, "d": True, "e": False, "minus zero": False}


def test_palette(spark):
    e = _tensor(spark, {"few": [3, -1, 3, 0, 1 << 62], "many": list(range(257)), "edge": list(range(256))})
    book = palette.codebook(e, "t")
    assert [(r.u, r.idx) for r in book.where("t = 'few'").orderBy("idx").collect()] == [(0, 0), (3, 1), (1 << 62, 2), (-1, 3)]
    assert sorted(map(tuple, palette.decode(palette.encode(e, book, "t"), book, "t").select("t", "pos", "u").collect())) == sorted(map(tuple, e.collect()))
    assert {r.t: r.fires for r in palette.gate(e, "t").collect()} == {"few": True, "many": False, "edge": True}


def test_container(spark):
    raws = [b"aa", b"bb", b"aa", b"", b"", b"cc"]
    t = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "ordinal long, raw binary")
    kinds = container.dedup(t).orderBy("ordinal").collect()
    assert [(r.kind, r.ref) for r in kinds] == [("FRAME", None), ("FRAME", None), ("REF", 0), ("FRAME", None), ("REF", 3), ("FRAME", None)]
    index = spark.createDataFrame([(r.ordinal, r.kind, r.ref, 10 * (r.kind == "FRAME")) for r in kinds], "ordinal long, kind string, ref long, frame_len long")
    placed = container.resolve(container.frame_offsets(index)).orderBy("ordinal").collect()
    assert [r.frame_offset for r in placed] == [0, 10, 0, 20, 20, 30]
    spans = {"whole": [(0, 4), (4, 4), (4, 9)], "gap": [(0, 4), (5, 9)], "late": [(1, 4)], "over": [(0, 4), (3, 9)]}
    rows = spark.createDataFrame([(k, b, e) for k, v in spans.items() for b, e in v], "ckpt_id string, begin long, end long")
    assert {r.ckpt_id: r.contiguous for r in container.contiguity(rows).collect()} == {"whole": True, "gap": False, "late": False, "over": False}
    cand = spark.createDataFrame([("t", "b", 5, 1), ("t", "a", 5, 0), ("t", "c", 9, 2), ("s", "c", 1, 2)], "k string, codec string, size long, priority int")
    assert sorted(map(tuple, container.best_of(cand, "k").collect())) == [("s", "c", 1), ("t", "a", 5)]


def test_delta(spark):
    a, b = _tensor(spark, {"x": [1, 2, 3]}), _tensor(spark, {"x": [1, 0, -1]})
    d = delta.xor(a, b, ["t", "pos"])
    assert [r.u for r in d.orderBy("pos").collect()] == [0, 2, 3 ^ -1]
    make = lambda rows: spark.createDataFrame(rows, "name string, dtype string, length long, digest string")
    target = make([("same", "F32", 4, "d"), ("changed", "F32", 4, "e"), ("longer", "F32", 8, "d"), ("cast", "I32", 4, "d"), ("new", "F32", 4, "d")])
    base = make([(n, "F32", 4, "d") for n in ("same", "changed", "longer", "cast", "old")])
    assert {r.name: r.kind for r in delta.classify(target, base).collect()} == {"same": "COPY", "changed": "DELTA", "longer": "FULL", "cast": "FULL", "new": "FULL"}
    assert [r.name for r in delta.dropped(target, base).collect()] == ["old"] and [r.name for r in delta.added(target, base).collect()] == ["new"]


def test_coding(spark):
    rng = np.random.default_rng(3)
    w = rng.normal(size=5000).astype("<f4")
    rows = [(0, "w", "F32", w.tobytes()), (1, "tied", "F32", w.tobytes()), (2, "none", "U8", b""), (3, "text", "U8", b"abc" * 999), (4, "odd", "BF16", w.tobytes()[:999])]
    t = spark.createDataFrame([(i, n, d, bytearray(r)) for i, n, d, r in rows], "ordinal long, name string, dtype string, raw binary")
    for parts in (1, 5):  # tied tensors in one task, and in several
        folder = store.scratch(spark, "test")
        store.write(t.repartition(parts), folder)
        index = store.index(spark, folder)
        assert index.where("kind = 'REF' AND ref = 0").count() == 1 and index.agg(F.sum("comp_len")).first()[0] < index.agg(F.sum("orig_len")).first()[0]
        assert {r["name"]: bytes(r["raw"]) for r in store.read(spark, folder).collect()} == {n: r for _, n, _, r in rows}
        some = store.read(spark, folder, ["tied"])
        assert [bytes(r["raw"]) for r in some.collect()] == [w.tobytes()]
        plan = some._jdf.queryExecution().toString()
        assert "EqualTo(ordinal,0)], ReadSchema: struct<ordinal:bigint,payload:binary>" in plan and some._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
        assert store.read(spark, folder, ["absent"]).count() == 0
    parts = coding.chunks(t, 1024)
    assert parts.where("name = 'w'").count() == -(-20_000 // 1024)
    assert {r["name"]: bytes(r["raw"]) for r in coding.join_chunks(parts, "name").collect()} == {n: r for _, n, _, r in rows}
    frames = coding.encode(t.select("name", F.lit("raw").alias("dtype"), "raw"))
    broken = frames.withColumn("payload", F.when(F.col("name") == "w", F.lit(b"junk")).otherwise(F.col("payload")))
    assert {r["name"] for r in coding.quarantine(broken).where("error IS NOT NULL").collect()} == {"w"}
    with pytest.raises(Exception, match="truncated frame|bad magic"):
        coding.decode(broken).collect()


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ordinal"), F.col("text").cast("binary").alias("raw"), F.lit("U8").alias("dtype"))
    sizes = lambda n: sorted(map(tuple, coding.encode(docs.repartition(n)).select("ordinal", "codec", "comp_len", F.md5("payload")).collect()))
    assert sizes(1) == sizes(7)


def test_streams(spark, tmp_path):
    rows = [("c1", "2024-01-01 00:01:00", 0, "w", "F32", bytearray(b"\x01\x02\x03\x04" * 8)), ("c1", "2024-01-01 00:02:00", 1, "v", "F32", bytearray(b"\x01\x02\x03\x04" * 8))]
    spark.createDataFrame(rows, ingest.TENSORS.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = ingest.tensor_stream(spark, str(tmp_path / "in"))
    q = ingest.encode_stream(stream, str(tmp_path / "out"), str(tmp_path / "log"))
    q.awaitTermination(120)
    assert {bytes(r["raw"]) for r in coding.decode(spark.read.parquet(str(tmp_path / "out"))).collect()} == {b"\x01\x02\x03\x04" * 8}
    for made, name, mode in ((ingest.plane_counts(stream), "planes", "complete"), (ingest.seen_once(stream), "once", "append")):
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((r.plane, r.byte, r.n) for r in spark.table("planes").collect()) == [(0, 1, 16), (1, 2, 16), (2, 3, 16), (3, 4, 16)]
    assert spark.table("once").count() == 1
