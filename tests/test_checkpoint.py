"""Checkpoint files: layout, container, deltas, command line, and the safetensors source."""

import json
import os
import struct

import numpy as np
import pytest

import planewise
from planewise import cli
from planewise.functions import checkpoint
from planewise.functions.codec import FrameError
from planewise.sources.safetensors import read_checkpoints, register

RNG = np.random.default_rng(0)


def _tensors(seed=0):
    r = np.random.default_rng(seed)
    embed = r.normal(size=(64, 64)).astype("<f4")
    return {
        "embed": ("F32", (64, 64), embed.tobytes()),
        "ln.weight": ("F16", (64,), r.normal(size=64).astype("<f2").tobytes()),
        "ids": ("I64", (128,), np.arange(128, dtype="<i8").tobytes()),
        "mask": ("U8", (256,), bytes(256)),
        "bf": ("BF16", (2048,), (r.normal(size=2048).astype("<f4").view("<u4") >> 16).astype("<u2").tobytes()),
        "head": ("F32", (64, 64), embed.tobytes()),
        "empty": ("F32", (0,), b""),
    }


def test_container(tmp_path):
    blob = checkpoint.build_safetensors(_tensors(), {"format": "np"})
    packed = planewise.compress_checkpoint(blob)
    assert planewise.decompress_checkpoint(packed) == blob and planewise.peek(packed) == "checkpoint" and len(packed) < len(blob)
    path = tmp_path / "x.pw"
    path.write_bytes(packed)
    with planewise.CheckpointReader.open(str(path)) as r:
        assert r.names() == list(_tensors()) and "head" in r and "tail" not in r and r.metadata() == {"format": "np"}
        assert r.header() == blob[8 : 8 + struct.unpack("<Q", blob[:8])[0]]
        assert [t["kind"] for t in r.index()].count("REF") == 1 and r.frame_size("head") == r.frame_size("embed")
        for name, (dtype, shape, raw) in _tensors().items():
            assert r.read_raw(name) == raw
            if dtype == "BF16":
                with pytest.raises(TypeError):
                    r.read_numpy(name)
            else:
                assert r.read_numpy(name).shape == shape


def test_reading_one_tensor_reads_one_frame():
    class Counting(__import__("io").BytesIO):
        count = 0

        def read(self, n=-1):
            self.count += n
            return super().read(n)

    big = {f"t{i}": ("U8", (100_000,), RNG.bytes(100_000)) for i in range(8)}
    f = Counting(planewise.compress_checkpoint(checkpoint.build_safetensors(big)))
    r = planewise.CheckpointReader(f)
    assert f.count < 5000
    assert r.read_raw("t3") == big["t3"][2] and f.count < 110_000


def test_equal_fingerprints_are_not_equal_tensors():
    a = bytearray(RNG.bytes(50_000))
    b = bytearray(a)
    b[2000] ^= 1
    blob = checkpoint.build_safetensors({"a": ("U8", (50_000,), bytes(a)), "b": ("U8", (50_000,), bytes(b)), "c": ("U8", (50_000,), bytes(a))})
    packed = planewise.compress_checkpoint(blob)
    assert planewise.decompress_checkpoint(packed) == blob
    assert [t["kind"] for t in planewise.CheckpointReader.from_bytes(packed).index()] == ["FRAME", "FRAME", "REF"]


def test_gaps_are_kept():
    head = json.dumps({"b": {"dtype": "U8", "shape": [3], "data_offsets": [9, 12]}, "a": {"dtype": "U8", "shape": [2], "data_offsets": [0, 2]}}).encode()
    blob = struct.pack("<Q", len(head)) + head + b"xxJUNKxxxyyyTAIL"
    assert planewise.decompress_checkpoint(planewise.compress_checkpoint(blob)) == blob
    assert [t.name for t in checkpoint.parse_safetensors(blob)[1]] == ["a", "b"]
    base = checkpoint.build_safetensors({"a": ("U8", (2,), b"xx")})
    assert planewise.model_delta_decompress(planewise.model_delta_compress(blob, base), base) == blob


def test_malformed_files():
    blob = checkpoint.build_safetensors(_tensors())
    packed = planewise.compress_checkpoint(blob)
    outside = json.dumps({"a": {"dtype": "U8", "shape": [9], "data_offsets": [0, 9]}}).encode()
    for bad in (b"", b"\xff" * 8 + b"{}", struct.pack("<Q", 2) + b"[]", struct.pack("<Q", 2) + b"{x", struct.pack("<Q", len(outside)) + outside + b"12"):
        with pytest.raises(ValueError):
            planewise.compress_checkpoint(bad)
    for bad in (packed[:10], packed[:-1], b"XXXX" + packed[4:], packed[:4] + b"\x07" + packed[5:]):
        with pytest.raises(FrameError):
            planewise.decompress_checkpoint(bad)


def test_model_delta():
    base, target = _tensors(), _tensors()
    e = np.frombuffer(base["embed"][2], "<u4").copy()
    e[::50] ^= 1
    target["embed"] = ("F32", (64, 64), e.tobytes())
    target["ids"] = ("I64", (64,), np.arange(64, dtype="<i8").tobytes())
    del target["mask"]
    target["new"] = ("U8", (3,), b"abc")
    a, b = checkpoint.build_safetensors(target), checkpoint.build_safetensors(base)
    d = planewise.model_delta_compress(a, b)
    assert planewise.model_delta_decompress(d, b) == a and planewise.peek(d) == "model_delta"
    kinds = {n: k for n, k, _ in checkpoint.model_delta_info(d)}
    assert (kinds["embed"], kinds["head"], kinds["ids"], kinds["new"], kinds["bf"]) == ("DELTA", "COPY", "FULL", "FULL", "COPY")
    other = checkpoint.build_safetensors(base, {"only": "the header differs"})
    for wrong in (a, other):
        with pytest.raises(FrameError):
            planewise.model_delta_decompress(d, wrong)


def test_files_and_arrays(tmp_path):
    arrays = {"x": np.arange(12, dtype=np.float32).reshape(3, 4), "y": np.array([1, 2], np.int64)}
    path = str(tmp_path / "a.pw")
    stats = planewise.save_file(arrays, path, {"k": "v"})
    back = planewise.load_file(path)
    assert set(stats) == {"original_bytes", "compressed_bytes", "ratio"} and all((back[k] == v).all() for k, v in arrays.items())
    plain = str(tmp_path / "a.safetensors")
    assert planewise.decompress_file(path, plain)["bytes"] == os.path.getsize(plain)
    assert (planewise.load_file(plain)["x"] == arrays["x"]).all()
    assert {"original_bytes", "compressed_bytes", "ratio", "saved_pct"} == set(planewise.compress_file(plain, path))


def test_command_line(tmp_path, capsys):
    raw = np.arange(3000, dtype="<f4").tobytes()
    src, out = tmp_path / "w.bin", tmp_path / "w.back"
    src.write_bytes(raw)
    for dtype in ("fp32", "raw", "fp8", "bfloat16"):
        assert cli.main(["compress", str(src), "--dtype", dtype, "--effort", "max"]) == 0
        assert cli.main(["info", str(src) + ".pw", "--compact"]) == 0
        assert cli.main(["decompress", str(src) + ".pw", "-o", str(out)]) == 0
        assert out.read_bytes() == raw
    ckpt, base = tmp_path / "m.safetensors", tmp_path / "b.safetensors"
    ckpt.write_bytes(checkpoint.build_safetensors(_tensors(1)))
    base.write_bytes(checkpoint.build_safetensors(_tensors()))
    for extra in ([], ["--base", str(base)]):
        assert cli.main(["compress", str(ckpt), "-o", str(out), *extra]) == 0
        assert cli.main(["info", str(out), "--compact"]) == 0
        assert cli.main(["decompress", str(out), "-o", str(tmp_path / "back"), *extra]) == 0
        assert (tmp_path / "back").read_bytes() == ckpt.read_bytes()
    assert cli.main(["decompress", str(src)]) == 1 and cli.main(["info", str(tmp_path / "none")]) == 1
    assert cli.human(10) == "10 B" and cli.human(1536) == "1.5 KiB"


def test_safetensors_source(spark, tmp_path):
    register(spark)
    for k in range(2):
        (tmp_path / f"m{k}.safetensors").write_bytes(checkpoint.build_safetensors(_tensors(k)))
    df = spark.read.format("safetensors").option("partBytes", "5000").load(str(tmp_path))
    rows = df.collect()
    assert len(rows) == 14 and {(r["name"], bytes(r["raw"])) for r in rows if r["path"].endswith("m1.safetensors")} == {(n, x[2]) for n, x in _tensors(1).items()}
    assert df.rdd.getNumPartitions() > 2
    assert [(r["name"], r["dtype"], r["shape"]) for r in df.where("name = 'ids'").collect()] == [("ids", "I64", [128])] * 2
    assert df.where("name IN ('ids', 'bf') AND ordinal = 2").count() == 2
    out = str(tmp_path / "out")
    df.where("path LIKE '%m0%'").coalesce(1).write.format("safetensors").mode("append").save(out)
    again = read_checkpoints(spark, out)
    assert {(r["name"], r["dtype"], bytes(r["raw"])) for r in again.collect()} == {(n, d, raw) for n, (d, _, raw) in _tensors(0).items()}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.pw").write_bytes(planewise.compress_checkpoint(checkpoint.build_safetensors(_tensors(3))))
    assert read_checkpoints(spark, str(tmp_path / "c")).count() == 7


def test_model_delta_files(tmp_path):
    base, target = checkpoint.build_safetensors(_tensors()), checkpoint.build_safetensors(_tensors() | {"ids": _tensors()["ids"][:2] + (bytes(1024),)})
    for name, blob in (("base", base), ("target", target)):
        (tmp_path / name).write_bytes(blob)
    paths = [str(tmp_path / x) for x in ("target", "base", "delta", "back")]
    stats = planewise.model_delta_compress_file(*paths[:3])
    assert stats["original_bytes"] == len(target) and stats["compressed_bytes"] == os.path.getsize(paths[2]) and stats["ratio"] > 5
    assert planewise.model_delta_decompress_file(paths[2], paths[1], paths[3])["bytes"] == len(target)
    assert (tmp_path / "back").read_bytes() == target
