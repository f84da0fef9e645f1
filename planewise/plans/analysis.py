"""Analysis queries: declarative plans with exact DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.functions import bits
from planewise.operators import container, delta, elements, palette, sparse, stats
from planewise.plans import fixtures as fx
from planewise.plans.fixtures import DOCS_INDEX, DOCS_TARGET, EMB, EMB_RECT, EMB_SNAPSHOT, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
F32, BF16 = bits.SPECS["float32"], bits.SPECS["bfloat16"]


def _query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _planes_sql(source: str, width: int, keep: str = "") -> str:
    k = f"{keep}, " if keep else ""
    return f"(SELECT {k}j::INTEGER AS plane, (u >> (8 * j)) & 255 AS byte FROM {source}, range({width}) t(j))"


#: Arithmetic shifts of negative patterns agree with logical ones after the mask.
_F64 = "(SELECT ({c}::BIT)::BIGINT AS u FROM {t})"


# -- planes and fields ------------------------------------------------------------------------


@_query(f"SELECT plane, byte, count(*) AS n FROM {_planes_sql(EMB, 4)} GROUP BY 1, 2")
def plane_hist_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(elements.planes(fx.emb(spark, sf_dir), "u", 4), "plane", "byte")


@_query(f"SELECT plane, byte, count(*) AS n FROM {_planes_sql(_F64.format(c='l_extendedprice', t='lineitem'), 8)} GROUP BY 1, 2")
def plane_hist_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "lineitem").select(bits.f64_bits(F.col("l_extendedprice")).alias("u"))
    return stats.histogram(elements.planes(u, "u", 8), "plane", "byte")


@_query(f"SELECT plane, byte, count(*) AS n FROM {_planes_sql('(SELECT o_custkey AS u FROM orders)', 8)} GROUP BY 1, 2")
def plane_hist_i64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(elements.planes(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u")), "u", 8), "plane", "byte")


@_query(f"SELECT vec_id, count(*) AS elements, 0::BIGINT AS mismatches, bit_xor(u) AS checksum FROM {EMB} GROUP BY 1")
def plane_join_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, join again, compare."""
    split = fx.emb_arrays(spark, sf_dir).withColumn("planes", elements.split(F.col("us"), 4))
    zero = F.lit(0).cast("long")
    differ = F.aggregate(F.zip_with("us", "vs", lambda u, v: (u != v).cast("long")), zero, lambda a, x: a + x)
    rows = split.withColumn("vs", elements.join(F.col("planes"))).select("vec_id", F.size("vs").cast("long").alias("n"), differ.alias("bad"), F.aggregate("vs", zero, lambda a, v: a.bitwiseXOR(v)).alias("x"))
    return rows.groupBy("vec_id").agg(F.sum("n").alias("elements"), F.sum("bad").alias("mismatches"), F.bit_xor("x").alias("checksum"))


def _field_hist(u: DataFrame, s: bits.FloatSpec) -> DataFrame:
    return stats.histogram(u.select(bits.sign(F.col("u"), s).alias("sign"), bits.exponent(F.col("u"), s).alias("exponent")), "sign", "exponent")


@_query(f"SELECT u >> 31 AS sign, (u >> 23) & 255 AS exponent, count(*) AS n FROM {EMB} GROUP BY 1, 2")
def field_hist_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field_hist(fx.emb(spark, sf_dir), F32)


@_query(f"SELECT h >> 15 AS sign, (h >> 7) & 255 AS exponent, count(*) AS n FROM (SELECT (u >> 16) & 65535 AS h FROM {EMB}) GROUP BY 1, 2")
def field_hist_bf16_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field_hist(fx.emb(spark, sf_dir).select(bits.bf16_truncated(F.col("u")).alias("u")), BF16)


@_query(f"SELECT h >> 15 AS sign, (h >> 7) & 255 AS exponent, count(*) AS n FROM (SELECT ((u + ((u >> 16) & 1) + 32767) >> 16) & 65535 AS h FROM {EMB}) GROUP BY 1, 2")
def field_hist_bf16_rne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field_hist(fx.emb(spark, sf_dir).select(bits.bf16_rounded(F.col("u")).alias("u")), BF16)


@_query(f"SELECT count(*) AS elements, 0::BIGINT AS mismatches, bit_xor(u) AS checksum, sum(u & 8388607)::BIGINT AS mantissas FROM {EMB}")
def field_join_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    v = bits.join_fields(bits.sign(u, F32), bits.exponent(u, F32), bits.mantissa(u, F32), F32)
    rows = fx.emb(spark, sf_dir).select("u", v.alias("v"), bits.mantissa(u, F32).alias("m"))
    return rows.agg(F.count("*").alias("elements"), F.sum((u != F.col("v")).cast("long")).alias("mismatches"), F.bit_xor("v").alias("checksum"), F.sum("m").alias("mantissas"))


@_query(f"SELECT vec_id, pos // 8 AS byte_no, sum((u >> 31) << (7 - pos % 8))::BIGINT AS packed FROM {EMB} GROUP BY 1, 2")
def sign_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = fx.emb(spark, sf_dir)
    return emb.groupBy("vec_id", F.floor(F.col("pos") / 8).alias("byte_no")).agg(bits.packed_byte(bits.sign(F.col("u"), F32), F.col("pos")).alias("packed"))


@_query(f"SELECT vec_id, pos // 8 AS group_no, sum(((u >> 16) & 127) << (7 * (7 - pos % 8)))::BIGINT AS packed FROM {EMB} GROUP BY 1, 2")
def mantissa_bitpack_bf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bits.mantissa(bits.bf16_truncated(F.col("u")), BF16)
    return fx.emb(spark, sf_dir).groupBy("vec_id", F.floor(F.col("pos") / 8).alias("group_no")).agg(bits.packed_low_bits(m, F.col("pos"), 7).alias("packed"))


_DTYPE_ROWS = ", ".join(f"('{d.safetensors}', '{d.code}', {d.width}, '{d.transform}')" for d in bits.DTYPES if d.safetensors)


@_query(
    f"SELECT t.dtype, d.code, d.width::INTEGER AS width, d.transform, count(*) AS tensors, sum(t.length)::BIGINT AS bytes, sum(t.length % d.width)::BIGINT AS tails "
    f"FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'BF16' WHEN 1 THEN 'F32' WHEN 2 THEN 'F64' WHEN 3 THEN 'I32' ELSE 'U8' END AS dtype, strlen(text) AS length FROM documents) t "
    f"JOIN (VALUES {_DTYPE_ROWS}) d(dtype, code, width, transform) USING (dtype) GROUP BY ALL"
)
def dtype_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors joined with the registry of element types (a fixed table of fifteen rows)."""
    name = F.expr("CASE doc_id % 5 WHEN 0 THEN 'BF16' WHEN 1 THEN 'F32' WHEN 2 THEN 'F64' WHEN 3 THEN 'I32' ELSE 'U8' END")
    tensors = table(spark, sf_dir, "documents").select(name.alias("dtype"), F.octet_length("text").cast("long").alias("length"))
    registry = spark.createDataFrame([(d.safetensors, d.code, d.width, d.transform) for d in bits.DTYPES if d.safetensors], "dtype string, code string, width int, transform string")
    joined = tensors.join(F.broadcast(registry), "dtype")
    return joined.groupBy("dtype", "code", "width", "transform").agg(F.count("*").alias("tensors"), F.sum("length").alias("bytes"), F.sum(bits.tail_length(F.col("length"), F.col("width"))).alias("tails"))


@_query("SELECT vec_id, sum(q)::BIGINT AS total, count(DISTINCT q) AS levels FROM (SELECT vec_id, CASE WHEN s > 0 THEN round_even(v / s, 0)::BIGINT ELSE 0 END AS q FROM (SELECT vec_id, v, max(abs(v)) OVER (PARTITION BY vec_id) / 7 AS s FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings))) GROUP BY 1")
def quantise_int4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric 4-bit quantisation of each vector; the levels as whole numbers."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"), (F.array_max(F.transform(v, F.abs)) / 7).alias("s"))
    q = rows.select("vec_id", F.transform("v", lambda x: bits.level(x, F.col("s"))).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.array_distinct("q")).cast("long").alias("levels"))


# -- statistics and gates ---------------------------------------------------------------------


def _tensor_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tensor, plane, byte) of three columns of doubles and of the embeddings."""
    emb = elements.planes(fx.emb(spark, sf_dir).withColumn("tensor", F.lit("embedding")), "u", 4, "tensor")
    price = table(spark, sf_dir, "orders").select(F.lit("o_totalprice").alias("tensor"), bits.f64_bits(F.col("o_totalprice")).alias("u"))
    value = table(spark, sf_dir, "events").select(F.lit("value").alias("tensor"), bits.f64_bits(F.col("value")).alias("u"))
    return emb.union(elements.planes(price.union(value), "u", 8, "tensor"))


_TENSOR_PLANES = f"(SELECT 'embedding' AS tensor, * FROM {_planes_sql(EMB, 4)} UNION ALL SELECT 'o_totalprice', * FROM {_planes_sql(_F64.format(c='o_totalprice', t='orders'), 8)} UNION ALL SELECT 'value', * FROM {_planes_sql(_F64.format(c='value', t='events'), 8)})"
_ENTROPY = "sum(n)::BIGINT AS total, count(*) AS symbols, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits"


@_query(f"SELECT tensor, plane, {_ENTROPY} FROM (SELECT tensor, plane, byte, count(*) AS n FROM {_TENSOR_PLANES} GROUP BY ALL) GROUP BY 1, 2")
def entropy0_by_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stats.entropy(stats.histogram(_tensor_planes(spark, sf_dir), "tensor", "plane", "byte"), "tensor", "plane")
    return e.withColumn("bits", F.round("bits", 6))


@_query(f"SELECT tensor, plane, total AS orig_len, ceil(round(total * bits / 8, 3))::BIGINT AS coded_len, ceil(round(total * bits / 8, 3)) < 0.99 * total AS code FROM (SELECT tensor, plane, sum(n)::BIGINT AS total, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM (SELECT tensor, plane, byte, count(*) AS n FROM {_TENSOR_PLANES} GROUP BY ALL) GROUP BY 1, 2)")
def entropy0_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy-code a plane only if that saves at least one per cent."""
    e = stats.entropy(stats.histogram(_tensor_planes(spark, sf_dir), "tensor", "plane", "byte"), "tensor", "plane")
    size = F.ceil(F.round(F.col("total") * F.col("bits") / 8, 3))
    return e.select("tensor", "plane", F.col("total").alias("orig_len"), size.cast("long").alias("coded_len"), (size < 0.99 * F.col("total")).alias("code"))


_EXP = f"(SELECT vec_id, pos, (u >> 23) & 255 AS e FROM {EMB})"
_JOINT = f"(SELECT prev, cur, count(*) AS n FROM (SELECT coalesce(lag(e) OVER (PARTITION BY vec_id ORDER BY pos), 0) AS prev, e AS cur FROM {_EXP}) GROUP BY 1, 2)"


def _exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.emb(spark, sf_dir).select("vec_id", "pos", bits.exponent(F.col("u"), F32).alias("e"))


@_query(f"SELECT prev, cur, n FROM {_JOINT}")
def joint_hist_o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.joint_histogram(_exponents(spark, sf_dir), ["vec_id"], ["pos"], "e")


@_query(f"SELECT prev, cur, count(*) AS n FROM (SELECT coalesce(lag(e) OVER (PARTITION BY vec_id, pos // 16 ORDER BY pos), 0) AS prev, e AS cur FROM {_EXP}) GROUP BY 1, 2")
def joint_hist_o1_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts start anew in each of four segments of a chunk (here a vector of 64)."""
    cut = _exponents(spark, sf_dir).withColumn("segment", stats.segment(F.col("pos"), F.lit(64)))
    return stats.joint_histogram(cut, ["vec_id", "segment"], ["pos"], "e")


@_query(f"SELECT sum(c)::BIGINT AS total, count(*) AS contexts, round(sum(c * log2(c) - s) / sum(c), 6) AS bits FROM (SELECT prev, sum(n) AS c, sum(n * log2(n)) AS s FROM {_JOINT} GROUP BY 1)")
def entropy1_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.conditional_entropy(joint_hist_o1(spark, sf_dir)).withColumn("bits", F.round("bits", 6))


@_query(f"SELECT chunk, {_ENTROPY} FROM (SELECT vec_id // 10 AS chunk, e, count(*) AS n FROM {_EXP} GROUP BY 1, 2) GROUP BY 1")
def local_entropy_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table per chunk would reach."""
    e = _exponents(spark, sf_dir).withColumn("chunk", F.floor(F.col("vec_id") / 10))
    return stats.entropy(stats.histogram(e, "chunk", "e"), "chunk").withColumn("bits", F.round("bits", 6))


_FREQ = f"(WITH h AS (SELECT plane, byte, count(*) AS n FROM {_planes_sql(EMB, 4)} GROUP BY 1, 2), s AS (SELECT plane, byte, n, greatest(1, (n * 16384) // sum(n) OVER (PARTITION BY plane))::BIGINT AS f FROM h) SELECT plane, byte, n, f + CASE WHEN row_number() OVER (PARTITION BY plane ORDER BY f DESC, n DESC, byte) = 1 THEN 16384 - sum(f) OVER (PARTITION BY plane) ELSE 0 END::BIGINT AS freq FROM s)"


@_query(f"SELECT plane, byte, n, freq::BIGINT AS freq FROM {_FREQ}")
def rans_freq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequencies(plane_hist_f32(spark, sf_dir), "byte", "plane")


@_query(f"SELECT plane, byte, n, freq::BIGINT AS freq, (sum(freq) OVER (PARTITION BY plane ORDER BY byte) - freq)::BIGINT AS cum FROM {_FREQ}")
def rans_cum_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cumulative(rans_freq_table(spark, sf_dir), "byte", "plane")


_ROWFREQ = f"(WITH s AS (SELECT prev, cur, n, greatest(1, (n * 4096) // sum(n) OVER (PARTITION BY prev))::BIGINT AS f FROM {_JOINT}) SELECT prev, cur, n, f + CASE WHEN row_number() OVER (PARTITION BY prev ORDER BY f DESC, n DESC, cur) = 1 THEN 4096 - sum(f) OVER (PARTITION BY prev) ELSE 0 END::BIGINT AS freq FROM s)"


@_query(f"SELECT prev, cur, n, freq::BIGINT AS freq FROM {_ROWFREQ}")
def rans_o1_freq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequencies(joint_hist_o1(spark, sf_dir), "cur", "prev", bits=12)


@_query(f"SELECT tensor, plane, sum(n)::BIGINT AS total, count(*) AS symbols, sum(n) >= 65536 AND count(*) <= 64 AS order1 FROM (SELECT tensor, plane, byte, count(*) AS n FROM {_TENSOR_PLANES} GROUP BY ALL) GROUP BY 1, 2")
def alphabet_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-1 coding pays on long planes of few symbols."""
    h = stats.histogram(_tensor_planes(spark, sf_dir), "tensor", "plane", "byte").groupBy("tensor", "plane").agg(F.sum("n").alias("total"), F.count("*").alias("symbols"))
    return h.withColumn("order1", (F.col("total") >= 65536) & (F.col("symbols") <= 64))


_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.columns_as_tensors(table(spark, sf_dir, "lineitem"), {c: bits.f64_bits(F.col(c)) for c in _LINE_COLUMNS})


_LINE = "(" + " UNION ALL ".join(f"SELECT '{c}' AS tensor, ({c}::BIT)::BIGINT AS u FROM lineitem" for c in _LINE_COLUMNS) + ")"
_MIXED = f"(SELECT * FROM {_LINE} UNION ALL SELECT 'rectified', u FROM {EMB_RECT})"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_tensors(spark, sf_dir).union(fx.emb_rect(spark, sf_dir).select(F.lit("rectified"), "u"))


@_query(f"SELECT tensor, count(*) AS total, count(*) FILTER (u = 0) AS zeros, round(avg((u = 0)::INTEGER), 6) AS share FROM {_MIXED} GROUP BY 1")
def sparsity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.sparsity(_mixed(spark, sf_dir), "tensor").withColumn("share", F.round("share", 6))


@_query(f"SELECT tensor, count(*) AS total, avg((u = 0)::INTEGER) >= 0.1 AS fires FROM {_MIXED} GROUP BY 1")
def sparse_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.gate(_mixed(spark, sf_dir), "tensor").select("tensor", "total", "fires")


@_query(f"SELECT vec_id, pos // 8 AS byte_no, sum((u <> 0)::INTEGER::BIGINT << (7 - pos % 8))::BIGINT AS byte FROM {EMB_RECT} GROUP BY 1, 2")
def sparse_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.bitmap(fx.emb_rect(spark, sf_dir), "vec_id")


@_query(f"SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS rank, u FROM {EMB_RECT} WHERE u <> 0")
def sparse_dense_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dense = sparse.encode_arrays(F.col("us"))
    return fx.emb_rect_arrays(spark, sf_dir).select("vec_id", F.posexplode(dense).alias("rank", "u")).select("vec_id", F.col("rank").cast("long").alias("rank"), "u")


@_query(f"SELECT vec_id, pos, u FROM {EMB_RECT}")
def sparse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded and decoded inside each row."""
    bitmap, dense = sparse.encode_arrays(F.col("us"))
    coded = fx.emb_rect_arrays(spark, sf_dir).select("vec_id", bitmap.alias("bitmap"), dense.alias("dense"), F.size("us").alias("size"))
    us = sparse.decode_arrays(F.col("bitmap"), F.col("dense"), F.col("size"))
    return coded.select("vec_id", F.posexplode(us).alias("pos", "u")).select("vec_id", F.col("pos").cast("long").alias("pos"), "u")


_PALETTED = [c for c in _LINE_COLUMNS if c != "l_extendedprice"]
_PAL = "(" + " UNION ALL ".join(f"SELECT '{c}' AS tensor, ({c}::BIT)::BIGINT AS u FROM lineitem" for c in _PALETTED) + " UNION ALL SELECT 'p_size', p_size::BIGINT FROM part)"
_BOOK = f"(SELECT tensor, u, count(*) AS n, dense_rank() OVER (PARTITION BY tensor ORDER BY u < 0, u) - 1 AS idx FROM {_PAL} GROUP BY 1, 2)"


def _paletted(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = elements.columns_as_tensors(table(spark, sf_dir, "lineitem"), {c: bits.f64_bits(F.col(c)) for c in _PALETTED})
    return line.union(table(spark, sf_dir, "part").select(F.lit("p_size"), F.col("p_size").cast("long")))


@_query(f"SELECT tensor, u, n, idx::INTEGER AS idx FROM {_BOOK}")
def palette_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.codebook(_paletted(spark, sf_dir), "tensor")


@_query(f"SELECT tensor, idx::INTEGER AS idx, n FROM {_BOOK}")
def palette_index_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the index stream, from encoded elements."""
    e = _paletted(spark, sf_dir)
    return stats.histogram(palette.encode(e, palette.codebook(e, "tensor"), "tensor"), "tensor", "idx")


@_query(f"SELECT tensor, count(*) AS total, count(DISTINCT u) AS distinct_values, count(DISTINCT u) <= 256 AS fires FROM (SELECT * FROM {_LINE} UNION ALL SELECT 'p_size', p_size::BIGINT FROM part UNION ALL SELECT 'p_retailprice', (p_retailprice::BIT)::BIGINT FROM part UNION ALL SELECT 'o_totalprice', (o_totalprice::BIT)::BIGINT FROM orders) GROUP BY 1")
def palette_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = elements.columns_as_tensors(table(spark, sf_dir, "part"), {"p_size": F.col("p_size").cast("long"), "p_retailprice": bits.f64_bits(F.col("p_retailprice"))})
    orders = table(spark, sf_dir, "orders").select(F.lit("o_totalprice"), bits.f64_bits(F.col("o_totalprice")))
    return palette.gate(_line_tensors(spark, sf_dir).union(part).union(orders), "tensor")


@_query("SELECT p_partkey, p_size FROM part")
def palette_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.lit("p_size").alias("tensor"), "p_partkey", F.col("p_size").cast("long").alias("u"))
    book = palette.codebook(e, "tensor")
    return palette.decode(palette.encode(e, book, "tensor"), book, "tensor").select("p_partkey", F.col("u").cast("int").alias("p_size"))


# -- deltas -----------------------------------------------------------------------------------


@_query(f"SELECT plane, count(*) AS total, count(*) FILTER (byte <> 0) AS nonzero FROM {_planes_sql(f'(SELECT xor(a.u, b.u) AS u FROM {EMB_SNAPSHOT} a JOIN {EMB} b USING (vec_id, pos))', 4)} GROUP BY 1")
def xor_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = delta.xor_arrays(fx.emb_snapshot_arrays(spark, sf_dir), fx.emb_arrays(spark, sf_dir), "vec_id").select(F.explode("us").alias("u"))
    return elements.planes(d, "u", 4).groupBy("plane").agg(F.count("*").alias("total"), F.sum((F.col("byte") != 0).cast("long")).alias("nonzero"))


@_query(f"SELECT vec_id, pos, u FROM {EMB_SNAPSHOT}")
def xor_delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = fx.emb_arrays(spark, sf_dir)
    back = delta.xor_arrays(delta.xor_arrays(fx.emb_snapshot_arrays(spark, sf_dir), ref, "vec_id"), ref, "vec_id")
    return back.select("vec_id", F.posexplode("us").alias("pos", "u")).select("vec_id", F.col("pos").cast("long").alias("pos"), "u")


@_query(f"SELECT t.name, CASE WHEN t.text = b.text THEN 'COPY' WHEN strlen(t.text) = strlen(b.text) THEN 'DELTA' ELSE 'FULL' END AS kind, strlen(t.text)::BIGINT AS length FROM {DOCS_TARGET} t LEFT JOIN documents b ON b.doc_id = t.name")
def model_delta_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.classify(fx.described(fx.docs_target(spark, sf_dir)), fx.described(fx.docs_base(spark, sf_dir)))


@_query(f"SELECT doc_id AS name, strlen(text)::BIGINT AS length FROM documents WHERE doc_id NOT IN (SELECT name FROM {DOCS_TARGET})")
def model_delta_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.dropped(fx.docs_target(spark, sf_dir), fx.docs_base(spark, sf_dir)).select("name", F.octet_length("raw").cast("long").alias("length"))


@_query(f"SELECT name, strlen(text)::BIGINT AS length FROM {DOCS_TARGET} WHERE name NOT IN (SELECT doc_id FROM documents)")
def model_delta_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.added(fx.docs_target(spark, sf_dir), fx.docs_base(spark, sf_dir)).select("name", F.octet_length("raw").cast("long").alias("length"))


@_query("SELECT doc_id, strlen(text)::BIGINT AS ref_len, sha256(text) AS ref_digest FROM documents")
def reference_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("ref_len"), F.sha2(F.col("text").cast("binary"), 256).alias("ref_digest"))


# -- container --------------------------------------------------------------------------------


@_query("SELECT doc_id AS ordinal, sha256(text) AS digest, CASE WHEN first = doc_id THEN 'FRAME' ELSE 'REF' END AS kind, first AS ref FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)")
def tensor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.dedup(fx.docs_raw(spark, sf_dir)).withColumn("ref", F.coalesce("ref", "ordinal"))




@_query("SELECT strlen(text)::INTEGER AS length, count(*) AS tensors, count(DISTINCT text) AS distinct_tensors FROM documents GROUP BY 1 HAVING count(*) > 1")
def fingerprint_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors of equal length are candidates; how many are distinct, by digest."""
    raw = fx.docs_raw(spark, sf_dir).select(F.octet_length("raw").alias("length"), F.sha2("raw", 256).alias("digest"))
    each = raw.groupBy("length", "digest").agg(F.count("*").alias("n"))
    return each.groupBy("length").agg(F.sum("n").alias("tensors"), F.count("*").alias("distinct_tensors")).where("tensors > 1")


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.frame_offsets(fx.docs_index(spark, sf_dir))


_OFFSETS = f"(SELECT *, (sum(frame_len) OVER (ORDER BY ordinal) - frame_len)::BIGINT AS frame_offset FROM {DOCS_INDEX})"


@_query(f"SELECT ordinal, kind, frame_len, frame_offset FROM {_OFFSETS}")
def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir).select("ordinal", "kind", "frame_len", "frame_offset")


@_query(f"SELECT a.ordinal, a.kind, coalesce(a.ref, a.ordinal) AS source, b.frame_offset, b.frame_len FROM {_OFFSETS} a LEFT JOIN {_OFFSETS} b ON b.ordinal = coalesce(a.ref, a.ordinal)")
def ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.resolve(_offsets(spark, sf_dir))


_CONT = "(SELECT doc_id % 20 AS ckpt_id, doc_id, strlen(text)::BIGINT AS n, sum(strlen(text)) OVER (PARTITION BY doc_id % 20 ORDER BY doc_id)::BIGINT AS e, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS r FROM documents)"


@_query(f"SELECT ckpt_id, count(*) AS tensors, max(e + g)::BIGINT AS data_len, bool_and(ok) AS contiguous FROM (SELECT ckpt_id, e, g, e - n + g = coalesce(lag(e + g) OVER (PARTITION BY ckpt_id ORDER BY doc_id), 0) AS ok FROM (SELECT *, CASE WHEN ckpt_id % 2 = 1 AND r >= 10 THEN 7 ELSE 0 END AS g FROM {_CONT})) GROUP BY 1")
def contiguity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty checkpoints; the odd ones have a gap of seven bytes before the tenth tensor."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("ckpt_id").orderBy("doc_id")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("ckpt_id"), "doc_id", F.octet_length("text").cast("long").alias("n"))
    gap = F.when((F.col("ckpt_id") % 2 == 1) & (F.row_number().over(w) >= 10), 7).otherwise(0)
    index = docs.select("ckpt_id", "n", (F.sum("n").over(w) + gap).alias("end")).select("ckpt_id", (F.col("end") - F.col("n")).alias("begin"), "end")
    return container.contiguity(index)


@_query(f"SELECT ordinal, name, kind, frame_offset, frame_len FROM {_OFFSETS} WHERE name IN ('tensor.3', 'tensor.77', 'tensor.150')")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir).where(F.col("name").isin("tensor.3", "tensor.77", "tensor.150")).select("ordinal", "name", "kind", "frame_offset", "frame_len")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tensor, codec, size, priority): what each tensor would take raw, as entropy-coded planes or with a palette; statistics only."""
    e = _line_tensors(spark, sf_dir)
    ent = stats.entropy(stats.histogram(elements.planes(e, "u", 8, "tensor"), "tensor", "plane", "byte"), "tensor", "plane")
    coded = ent.groupBy("tensor").agg(F.sum(F.ceil(F.round(F.col("total") * F.col("bits") / 8, 3))).cast("long").alias("size"))
    gate = palette.gate(e, "tensor")
    raw = gate.select("tensor", F.lit("STORE").alias("codec"), (F.col("total") * 8).alias("size"), F.lit(0).alias("priority"))
    pal = gate.where("fires").select("tensor", F.lit("PALETTE"), F.col("total") + F.col("distinct_values") * 8, F.lit(2))
    return raw.union(coded.select("tensor", F.lit("BYTEPLANE"), "size", F.lit(1))).union(pal)


_CAND = f"""(WITH h AS (SELECT tensor, plane, byte, count(*) AS n FROM {_planes_sql(_LINE, 8, 'tensor')} GROUP BY ALL),
 e AS (SELECT tensor, plane, sum(n) AS t, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS b FROM h GROUP BY 1, 2),
 g AS (SELECT tensor, count(*) AS t, count(DISTINCT u) AS d FROM {_LINE} GROUP BY 1)
 SELECT tensor, 'STORE' AS codec, t * 8 AS size, 0 AS priority FROM g UNION ALL SELECT tensor, 'BYTEPLANE', sum(ceil(round(t * b / 8, 3)))::BIGINT, 1 FROM e GROUP BY 1
 UNION ALL SELECT tensor, 'PALETTE', t + d * 8, 2 FROM g WHERE d <= 256)"""


@_query(f"SELECT tensor, arg_min(codec, size * 10 + priority) AS codec, min(size)::BIGINT AS size FROM {_CAND} GROUP BY 1")
def best_of_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.best_of(_candidates(spark, sf_dir), "tensor")


@_query(f"SELECT tensor, max(size) FILTER (codec = 'STORE')::BIGINT AS orig_len, max(size) FILTER (codec = 'BYTEPLANE')::BIGINT AS comp_len, CASE WHEN max(size) FILTER (codec = 'BYTEPLANE') < max(size) FILTER (codec = 'STORE') THEN 'CODED' ELSE 'STORE' END AS method FROM {_CAND} GROUP BY 1")
def store_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda codec: F.max(F.when(F.col("codec") == codec, F.col("size")))
    sizes = _candidates(spark, sf_dir).groupBy("tensor").agg(size("STORE").alias("orig_len"), size("BYTEPLANE").alias("comp_len"))
    return sizes.withColumn("method", container.store_guard(F.col("comp_len"), F.col("orig_len")))


_BF = f"(SELECT vec_id // 10 AS tensor, (u >> 16) & 65535 AS u FROM {EMB})"


@_query(
    f"""WITH b AS (SELECT tensor, j AS s, (u >> (8 * j)) & 255 AS x FROM {_BF}, range(2) t(j)), f AS (SELECT tensor, 0 AS s, u >> 15 AS x FROM {_BF} UNION ALL SELECT tensor, 1, (u >> 7) & 255 FROM {_BF} UNION ALL SELECT tensor, 2, u & 127 FROM {_BF}),
 h AS (SELECT 'byteplane' AS codec, tensor, s, x, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 'fields', tensor, s, x, count(*) FROM f GROUP BY ALL),
 e AS (SELECT codec, tensor, s, sum(n) * (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / 8 AS z FROM h GROUP BY 1, 2, 3), z AS (SELECT codec, tensor, ceil(round(sum(z), 3))::BIGINT AS size FROM e GROUP BY 1, 2)
 SELECT tensor, max(size) FILTER (codec = 'byteplane') AS byteplane, max(size) FILTER (codec = 'fields') AS fields, CASE WHEN max(size) FILTER (codec = 'byteplane') <= 1.01 * min(size) THEN 'byteplane' ELSE 'fields' END AS codec FROM z GROUP BY 1"""
)
def bf16_decode_pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte planes decode faster: they are taken if at most one per cent above the smallest."""
    u = F.col("u")
    bf = fx.emb(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).alias("tensor"), bits.bf16_truncated(u).alias("u"))
    streams = F.array(
        *(F.struct(F.lit("byteplane").alias("codec"), F.lit(j).alias("s"), bits.byte_plane(u, j).alias("x")) for j in (0, 1)),
        *(F.struct(F.lit("fields").alias("codec"), F.lit(j).alias("s"), f(u, BF16).alias("x")) for j, f in enumerate((bits.sign, bits.exponent, bits.mantissa))),
    )
    e = stats.entropy(stats.histogram(bf.select("tensor", F.inline(streams)), "tensor", "codec", "s", "x"), "tensor", "codec", "s")
    z = e.groupBy("tensor", "codec").agg(F.ceil(F.round(F.sum(F.col("total") * F.col("bits") / 8), 3)).cast("long").alias("size"))
    size = lambda codec: F.max(F.when(F.col("codec") == codec, F.col("size"))).alias(codec)
    both = z.groupBy("tensor").agg(size("byteplane"), size("fields"))
    return both.withColumn("codec", F.when(F.col("byteplane") <= 1.01 * F.least("byteplane", "fields"), "byteplane").otherwise("fields"))
