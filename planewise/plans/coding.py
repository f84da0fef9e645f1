"""Queries that code and decode: what comes back must equal what went in, so their oracle is the source."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.functions import bits, checkpoint, codec, rans
from planewise.operators import coding, store
from planewise.plans import fixtures as fx
from planewise.plans.fixtures import DOCS_TARGET, EMB, EMB_SNAPSHOT, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _digests(raws: DataFrame, key: str) -> DataFrame:
    return raws.select(key, F.octet_length("raw").cast("long").alias("orig_len"), F.md5("raw").alias("digest"))


def _digest_sql(key: str, name: str, text: str) -> str:
    return f"SELECT {key}, strlen({text})::BIGINT AS orig_len, md5({text}) AS digest FROM {name}"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"), F.lit("U8").alias("dtype"))


def _vectors(spark: SparkSession, sf_dir: str, per: int = 50, snapshot: bool = False) -> DataFrame:
    """(tensor, raw, dtype): the elements of ``per`` vectors as one float32 tensor."""
    emb = fx.emb_snapshot_arrays(spark, sf_dir) if snapshot else fx.emb_arrays(spark, sf_dir)
    ordered = emb.groupBy(F.floor(F.col("vec_id") / per).alias("tensor")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "us"))).alias("e"))
    us, ids = F.flatten(F.transform("e", lambda x: x["us"])), F.flatten(F.transform("e", lambda x: F.array_repeat(x["vec_id"], F.size(x["us"]))))
    return ordered.select("tensor", ids.alias("ids"), bits.packed_patterns(us, 4).alias("raw"), F.lit("fp32").alias("dtype"))


def _elements(decoded: DataFrame) -> DataFrame:
    """(vec_id, pos, u) of decoded float32 tensors."""
    rows = decoded.select("ids", bits.unpacked_patterns(F.col("raw"), 4).alias("us"))
    each = rows.select(F.inline(F.arrays_zip("ids", "us")))
    return each.groupBy("ids").agg(F.count("*").alias("elements"), F.bit_xor("us").alias("checksum"), F.sum("us").alias("total")).withColumnRenamed("ids", "vec_id")


_ELEMENTS = "SELECT vec_id, count(*) AS elements, bit_xor(u) AS checksum, sum(u)::BIGINT AS total FROM {t} GROUP BY 1"


def _values(spark: SparkSession, sf_dir: str, per: int = 1000) -> DataFrame:
    """(tensor, ids, raw, dtype): ``events.value`` by id as float64 tensors."""
    rows = table(spark, sf_dir, "events").select("event_id", bits.f64_bits(F.col("value")).alias("u"))
    ordered = rows.groupBy(F.floor(F.col("event_id") / per).alias("tensor")).agg(F.array_sort(F.collect_list(F.struct("event_id", "u"))).alias("e"))
    ids, us = F.transform("e", lambda x: x["event_id"]), F.transform("e", lambda x: x["u"])
    return ordered.select("tensor", ids.alias("ids"), bits.packed_patterns(us, 8).alias("raw"), F.lit("fp64").alias("dtype"))


def _values_back(decoded: DataFrame) -> DataFrame:
    rows = decoded.select("ids", bits.unpacked_patterns(F.col("raw"), 8).alias("us"))
    return rows.select(F.inline(F.arrays_zip("ids", "us"))).toDF("event_id", "u")


_VALUES = "SELECT event_id, (value::BIT)::BIGINT AS u FROM events"


@_query(_digest_sql("doc_id", "documents", "text"))
def zstd_roundtrip_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(coding.decode(coding.encode(_docs(spark, sf_dir), effort="fast")), "doc_id")


@_query(_digest_sql("page_id", "pages", "html"))
def zstd_blocks_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("raw"))
    packed = coding.map_rows(pages, "n long, payload binary", lambda r: (len(r["raw"]), codec.blocks_compress(r["raw"])), ("raw",))
    return _digests(coding.map_rows(packed, "raw binary", lambda r: (codec.blocks_decompress(r["payload"], r["n"]),), ("payload",)), "page_id")


@_query(_VALUES)
def chunked_roundtrip_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tensor becomes chunk rows, coded one by one, joined again."""
    tensors = _values(spark, sf_dir)
    parts = coding.chunks(tensors.select("tensor", "raw", "dtype"), 2048)
    back = coding.join_chunks(coding.decode(coding.encode(parts, level=1, effort="fast", auto=False)), "tensor")
    return _values_back(tensors.select("tensor", "ids").join(back, "tensor"))


@_query(_VALUES)
def turbo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = coding.map_rows(_values(spark, sf_dir), "payload binary", lambda r: (codec.turbo_compress(r["raw"], dtype=r["dtype"]),), ("raw",))
    return _values_back(coding.decode(packed))


@_query(_VALUES)
def codec_roundtrip_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values_back(coding.decode(coding.encode(_values(spark, sf_dir))))


@_query(_ELEMENTS.format(t=EMB))
def codec_roundtrip_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(coding.decode(coding.encode(_vectors(spark, sf_dir))))


@_query(_ELEMENTS.format(t=EMB))
def codec_max_roundtrip_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(coding.decode(coding.encode(_vectors(spark, sf_dir), effort="max")))


@_query(_ELEMENTS.format(t=EMB_SNAPSHOT))
def delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _vectors(spark, sf_dir, snapshot=True)
    base = _vectors(spark, sf_dir).select("tensor", F.col("raw").alias("base"))
    records = coding.encode_delta(now.join(base, "tensor"))
    return _elements(coding.decode_delta(records.join(base, "tensor")))


@_query(f"SELECT name, strlen(text)::BIGINT AS orig_len, md5(text) AS digest FROM {DOCS_TARGET}")
def model_delta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, base = fx.docs_target(spark, sf_dir), fx.docs_base(spark, sf_dir).select("name", F.col("raw").alias("base"))
    records = coding.encode_delta(target.join(base, "name", "left"))
    return _digests(coding.decode_delta(records.join(base, "name", "left")), "name")


def _rans(spark: SparkSession, sf_dir: str, mode: int) -> DataFrame:
    """The four byte planes of each tensor through one coder, joined by bits."""

    def kernel(row: dict) -> tuple:
        planes, tail = codec.split_planes(row["raw"], 4)
        coded = [(rans.encode(np.frombuffer(p, np.uint8), mode), len(p)) for p in planes]
        return (codec.join_planes([rans.decode(c, n).tobytes() for c, n in coded], 4, tail),)

    rows = _vectors(spark, sf_dir).withColumnRenamed("raw", "source")
    back = coding.map_rows(rows, "raw binary", lambda r: kernel({"raw": r["source"]}), ("source",))
    return _elements(back)


@_query(_ELEMENTS.format(t=EMB))
def rans_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rans(spark, sf_dir, rans.ADAPTIVE)


@_query(_ELEMENTS.format(t=EMB))
def rans_o1_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rans(spark, sf_dir, rans.ORDER1)


@_query(_ELEMENTS.format(t=EMB))
def rans_shared_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coder with one model a plane."""
    return _rans(spark, sf_dir, rans.ORDER0)


def _halves(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Embeddings cut to bf16, as frames of one kind, decoded again."""
    tensors = _vectors(spark, sf_dir)

    def kernel(row: dict) -> tuple:
        top = (np.frombuffer(row["raw"], "<u4") >> 16).astype("<u2")
        back = np.frombuffer(codec.decompress(codec.compress_as(kind, top.tobytes(), dtype="bf16")), "<u2")
        return (back.astype("<u4").tobytes(),)

    return _elements(coding.map_rows(tensors.withColumnRenamed("raw", "source"), "raw binary", lambda r: kernel({"raw": r["source"]}), ("source",)))


_HALVES = f"(SELECT vec_id, u >> 16 AS u FROM {EMB})"


@_query(_ELEMENTS.format(t=_HALVES))
def bf16_fields_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir, "fields")


@_query(_ELEMENTS.format(t=_HALVES))
def bf16_bitpack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir, "bitpack")


@_query("SELECT doc_id, strlen(text)::BIGINT AS orig_len, 'uint8' AS dtype, 1 AS width, false AS is_delta FROM documents")
def frame_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a frame's header tells without decoding it."""

    def kernel(row: dict) -> tuple:
        head = codec.info(row["payload"])
        return head["orig_len"], head["dtype"], head["width"], codec.peek(row["payload"]) == "delta"

    coded = coding.encode(_docs(spark, sf_dir), effort="fast").select("doc_id", "payload")
    return coding.map_rows(coded, "orig_len long, dtype string, width int, is_delta boolean", kernel, ("payload",))


@_query("SELECT doc_id, strlen(text)::BIGINT AS orig_len, md5(text) AS digest FROM documents")
def checkpoint_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents each as one checkpoint file, coded as a container and read back tensor by tensor."""
    docs = _docs(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 10).alias("file")).agg(F.collect_list(F.struct("doc_id", "raw")).alias("tensors"))

    def kernel(row: dict) -> tuple:
        tensors = {f"t{t['doc_id']}": ("U8", (len(t["raw"]),), bytes(t["raw"])) for t in row["tensors"]}
        blob = checkpoint.compress_checkpoint(checkpoint.build_safetensors(tensors))
        reader = checkpoint.CheckpointReader.from_bytes(blob)
        return ([{"doc_id": int(name[1:]), "raw": reader.read_raw(name)} for name in reader.names()],)

    each = coding.map_rows(docs, "back array<struct<doc_id:bigint,raw:binary>>", kernel, ("tensors",)).select(F.inline("back"))
    return _digests(each, "doc_id")


def _stored(tensors: DataFrame) -> str:
    """The folder of a checkpoint written for one query."""
    folder = store.scratch(tensors.sparkSession, "checkpoint")
    store.write(tensors, folder)
    return folder


@_query("SELECT doc_id AS ordinal, 'tensor.' || doc_id AS name, strlen(text)::BIGINT AS orig_len, md5(text) AS digest FROM documents")
def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a checkpoint: deduplicated, coded once each, read back through their references."""
    tensors = _docs(spark, sf_dir).select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("tensor."), F.col("doc_id").cast("string")).alias("name"), "dtype", "raw")
    back = store.read(spark, _stored(tensors))
    return back.select("ordinal", "name", F.octet_length("raw").cast("long").alias("orig_len"), F.md5("raw").alias("digest"))


@_query("SELECT name, strlen(text)::BIGINT AS orig_len, md5(text) AS digest FROM (SELECT 'tensor.' || doc_id AS name, text FROM documents) WHERE name IN ('tensor.3', 'tensor.77', 'tensor.150')")
def tensor_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tensors out of a checkpoint."""
    tensors = _docs(spark, sf_dir).select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("tensor."), F.col("doc_id").cast("string")).alias("name"), "dtype", "raw")
    return _digests(store.read(spark, _stored(tensors), ["tensor.3", "tensor.77", "tensor.150"]), "name")


@_query()
def compression_ratio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by codec of vectors, values and texts; DuckDB has no zstd to compare with."""
    some = lambda df, name: coding.encode(df).select(F.lit(name).alias("source"), "codec", "orig_len", "comp_len")
    rows = some(_vectors(spark, sf_dir), "embeddings").union(some(_values(spark, sf_dir), "events")).union(some(_docs(spark, sf_dir), "documents"))
    return coding.size_summary(rows, "source", "codec")
