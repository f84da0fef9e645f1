"""Frames and byte coders: what decodes must be what was coded, byte for byte, and damage must be noticed."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import planewise
from planewise.functions import codec, rans
from planewise.functions.codec import FrameError

DTYPES = ["bf16", "BFLOAT16", "fp16", "float32", "fp64", "int16", "uint32", "int64", "u8", "int8", "fp8_e4m3", "bool", "raw", None]


def _buffers():
    rng = np.random.default_rng(0)
    yield b""
    for n in (1, 2, 3, 7, 8, 9, 255, 4096, 4099):
        yield bytes(n)
        yield b"\xff" * n
        yield b"\xaa" * n
        yield rng.integers(0, 256, n, np.uint8).tobytes()
        yield np.repeat(rng.integers(0, 3, n // 4 + 1), 4).astype(np.uint8).tobytes()[:n]
    yield bytes(range(256)) * 3


@pytest.mark.parametrize("effort", codec.EFFORTS)
@pytest.mark.parametrize("dtype", DTYPES)
def test_round_trip(dtype, effort):
    for raw in _buffers():
        frame = planewise.compress(raw, dtype=dtype, effort=effort)
        assert planewise.decompress(frame) == raw
        assert len(frame) <= len(raw) + 256
        assert planewise.peek(frame) == "frame"


@pytest.mark.parametrize("level", [1, 3, 9, 19])
def test_levels(level):
    raw = np.arange(5000, dtype="<f4").tobytes()
    assert codec.decompress(codec.compress(raw, dtype="fp32", level=level)) == raw


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=600), st.sampled_from(["bf16", "fp16", "fp32", "fp64", "int32", None]), st.sampled_from(codec.EFFORTS))
def test_any_bytes(raw, dtype, effort):
    assert codec.decompress(codec.compress(raw, dtype=dtype, effort=effort)) == raw
    assert codec.decompress(codec.chunked_compress(raw, dtype=dtype, chunk=56)) == raw
    assert codec.decompress(codec.turbo_compress(raw, dtype=dtype)) == raw


def test_special_floats_keep_their_bits():
    u = np.array([0, 1 << 31, 0x3F800000, 0xBF800000, 0x7F800000, 0xFF800000, 0x7FC00001, 0xFFABCDEF, 1, 0x007FFFFF, 0x00800000, 0x7F7FFFFF], "<u4")
    for dtype, x in (("fp32", u), ("bf16", (u >> 16).astype("<u2")), ("fp16", np.arange(0, 1 << 16, 7).astype("<u2"))):
        for effort in codec.EFFORTS:
            assert codec.decompress(codec.compress(x.tobytes() * 9, dtype=dtype, effort=effort)) == x.tobytes() * 9
        for pack in (False, True):
            streams, tail = codec.split_fields(x.tobytes() + b"t", dtype, pack)
            assert codec.join_fields(streams, dtype, tail, pack) == x.tobytes() + b"t"


def test_arrays():
    for a in (np.arange(24, dtype=">f8").reshape(2, 3, 4), np.zeros((0, 5), np.float32), np.array(3, np.int16), np.array([[True, False]]), np.asfortranarray(np.eye(3, dtype=np.float16))):
        b = planewise.decompress_array(planewise.compress_array(a))
        assert b.dtype == a.dtype and b.shape == a.shape and (b == a).all()
    with pytest.raises(ValueError):
        planewise.decompress_array(planewise.compress(b"bytes"))


def test_candidates():
    rng = np.random.default_rng(1)
    kind = lambda raw, dtype: codec.info(codec.compress(raw, dtype=dtype))["kind"]
    w = rng.normal(size=40_000).astype(np.float32)
    assert kind(np.where(rng.random(40_000) < 0.9, 0, w).astype("<f4").tobytes(), "fp32") == "sparse"
    assert kind(rng.choice(w[:40], 40_000).astype("<f4").tobytes(), "fp32") in ("palette", "opaque")
    assert kind(rng.bytes(1001) * 80, "fp32") == "opaque"
    assert kind(w.tobytes(), "fp32") == "byteplane"
    small, best = (len(codec.compress((w.view("<u4") >> 16).astype("<u2").tobytes(), dtype="bf16", effort=e)) for e in ("fast", "balanced"))
    assert best <= small


def test_decoding_into_a_buffer():
    raw = np.random.default_rng(7).normal(size=3000).astype("<f4").tobytes()
    for frame in (codec.compress(raw, dtype="fp32"), codec.chunked_compress(raw, dtype="fp32", chunk=999)):
        for out in (bytearray(len(raw)), bytearray(len(raw) + 5), np.zeros(3000, "<f4")):
            assert codec.decompress(frame, out=out) is out and bytes(memoryview(out).cast("B")[: len(raw)]) == raw
        with pytest.raises(ValueError):
            codec.decompress(frame, out=bytearray(10))


def test_opaque_bytes_never_lose_to_plain_zstd():
    rng = np.random.default_rng(8)
    mask = np.tile(np.array([1, 1, 0, 1, 0, 0, 0], np.uint8), 300_000).tobytes()
    for raw in (mask, b"the same words again " * 50_000, np.arange(300_000, dtype="<i4").tobytes(), rng.bytes(50_000) * 9, rng.bytes(300_000)):
        frame = codec.compress(raw)
        assert codec.decompress(frame) == raw and len(frame) <= min(len(codec.zstd_compress(raw, 3, wide)) for wide in (True, False)) + 256


def test_kinds_and_threads():
    raw = np.random.default_rng(9).normal(size=1_500_000).astype("<f4").tobytes()
    assert codec.compress(raw, dtype="fp32", threads=4) == codec.compress(raw, dtype="fp32")
    sparse_raw = (np.frombuffer(raw, "<f4") * (np.arange(1_500_000) % 3 == 0)).astype("<f4").tobytes()
    frames = {k: codec.compress_as(k, raw[:40_000], dtype="fp32") for k in ("opaque", "byteplane", "fields", "bitpack", "sparse")}
    frames["palette"] = codec.compress_as("palette", bytes(range(200)) * 8, dtype="fp32")
    for kind, frame in frames.items():
        assert codec.is_kind(frame, kind) and not codec.is_kind(frame, "none") and codec.info(frame)["kind"] == kind
    assert codec.decompress(frames["bitpack"]) == raw[:40_000] and codec.is_kind(codec.compress(sparse_raw, dtype="fp32"), "sparse")
    assert not codec.is_kind(b"", "sparse") and not codec.is_adaptive(b"PW") and not codec.is_adaptive(frames["opaque"])
    drift = np.concatenate([np.random.default_rng(k).normal(k % 7 * 30 + 10, 0.7, 1 << 17).astype(np.int64) for k in range(8)]).astype(np.uint8).tobytes()
    frame = codec.compress(drift, effort="max")
    assert codec.is_adaptive(frame) and codec.decompress(frame) == drift
    with pytest.raises(ValueError):
        codec.compress_as("fields", raw[:8], dtype="fp64")


def test_gates_of_large_tensors():
    u = np.ones(3 << 20, "<u4")
    assert not codec.sparse_gate(u.tobytes(), 4)
    u[::8] = 0
    assert codec.sparse_gate(u.tobytes(), 4)
    u[:] = 1
    u[::12] = 0  # the look lets it pass, the count does not
    assert not codec.sparse_gate(u.tobytes(), 4)


def test_turbo_looks_over_the_whole_stream():
    rng = np.random.default_rng(10)
    noise, deep = rng.bytes(1 << 20), rng.bytes(1 << 19)
    assert [p["method"] for p in codec.info(codec.turbo_compress(noise))["planes"]] == ["store"]
    repeated = deep + rng.bytes(1 << 18) + deep  # nothing to see in its first half
    assert len(codec.turbo_compress(repeated)) < 0.7 * len(repeated)
    nearly = rng.bytes(9950) + bytes(50)  # saves under one per cent
    assert [p["method"] for p in codec.info(codec.turbo_compress(nearly))["planes"]] == ["store"]
    for raw in (noise, repeated, nearly, b""):
        assert codec.decompress(codec.turbo_compress(raw)) == raw


def test_transforms_are_pruned_in_the_max_tier(monkeypatch):
    w = np.random.default_rng(11).normal(size=700_000).astype("<f4")
    half = (w.view("<u4") >> 16).astype("<u2").tobytes()
    splits = [("byteplane", *codec.split_planes(half, 2)), ("fields", *codec.split_fields(half, "bf16")), ("bitpack", *codec.split_fields(half, "bf16", pack=True))]
    size = {k: sum(len(codec.zstd_compress(s, 1)) for s in streams) for k, streams, _ in splits}
    assert [k for k, *_ in codec._pruned(splits)] == [k for k in size if k != max(size, key=size.get)]
    seen = []
    monkeypatch.setattr(codec, "Candidate", lambda kind, *a, **k: seen.append(kind) or b"x")
    codec._candidates(half, "bf16", 2, "fields", 3, "max", False, {})
    assert len(seen) == 2


def test_gates_look_at_bits():
    minus = np.full(100, -0.0, "<f4").tobytes()
    assert not codec.sparse_gate(minus, 4) and codec.sparse_gate(bytes(400), 4)
    share = lambda k: np.concatenate([np.zeros(k, "<f4"), np.ones(1000 - k, "<f4")]).tobytes()
    assert codec.sparse_gate(share(100), 4) and not codec.sparse_gate(share(99), 4)
    distinct = lambda k: np.arange(k, dtype="<u4").repeat(9).tobytes()
    assert codec.palette_gate(distinct(256), 4) and not codec.palette_gate(distinct(257), 4) and not codec.palette_gate(bytes(9), 1)


def test_preferences():
    assert codec.choose([("byteplane", b"x" * 101), ("fields", b"x" * 100)])[0] == "byteplane"
    assert codec.choose([("byteplane", b"x" * 102), ("fields", b"x" * 100)])[0] == "fields"
    assert codec.choose([("byteplane", b"x" * 100), ("opaque", b"x" * 100)])[0] == "byteplane"
    assert codec.compress_plane(np.random.default_rng(0).bytes(9999)).method == codec.STORE


def test_damage_is_noticed():
    raw = np.random.default_rng(2).normal(size=3000).astype("<f4").tobytes()
    frame = codec.compress(raw, dtype="fp32")
    for bad in (b"", frame[:7], frame[:-1], frame + b"x", b"XXXX" + frame[4:], frame[:4] + b"\x09" + frame[5:], frame[:12] + b"\xff" + frame[13:]):
        with pytest.raises(FrameError):
            codec.decompress(bad)
    chunks = codec.chunked_compress(raw, dtype="fp32", chunk=1000)
    with pytest.raises(FrameError):
        codec.decompress(chunks[:-3])
    with pytest.raises(FrameError):
        codec.join_planes([b"ab", b"a"], 2)
    with pytest.raises(FrameError):
        codec.join_palette([bytes(4), b"\x05"], 4)
    with pytest.raises(FrameError):
        codec.blocks_decompress(struct.pack("<II", 10, 3), 5)
    with pytest.raises(ValueError):
        codec.compress(b"", dtype="fp128")
    with pytest.raises(ValueError):
        codec.compress(b"", effort="heroic")


def test_delta():
    rng = np.random.default_rng(3)
    base = rng.normal(size=20_000).astype("<f4")
    now = base.copy()
    now.view("<u4")[::20] ^= 1
    d = codec.delta_compress(now.tobytes(), base.tobytes(), dtype="fp32")
    assert len(d) < len(codec.compress(now.tobytes(), dtype="fp32")) / 8
    assert codec.delta_decompress(d, base.tobytes()) == now.tobytes() == codec.decompress(d, base.tobytes())
    for wrong in (now.tobytes(), base.tobytes()[:-4]):
        with pytest.raises(FrameError):
            codec.delta_decompress(d, wrong)
    with pytest.raises(ValueError):
        codec.delta_compress(b"abc", b"ab")
    with pytest.raises(ValueError):
        codec.decompress(d)


@pytest.mark.parametrize("mode", [rans.ORDER0, rans.ADAPTIVE, rans.ORDER1])
def test_rans(mode):
    rng = np.random.default_rng(4)
    for n in (1, 2, 255, 256, 511, 70_000, 200_001):
        for a in (rng.integers(0, 256, n), (rng.normal(0, 3, n) + 128).clip(0, 255), np.zeros(n), np.arange(n) % 256):
            a = a.astype(np.uint8)
            coded = rans.encode(a, mode)
            assert (rans.decode(coded, n) == a).all()
            if n < 1000:
                assert rans.decode_scalar(coded, n) == a.tobytes()


def test_rans_reaches_its_entropy_and_notices_damage():
    a = (np.random.default_rng(5).normal(0, 3, 1 << 18) + 128).clip(0, 255).astype(np.uint8)
    coded = rans.encode(a, rans.ORDER0)
    assert len(coded) < 1.05 * codec.order0_bytes(a)
    low = bytearray(coded)
    low[len(low) // 2] ^= 0x40
    for bad in (coded[:-1], coded[:9], b"\x07" + coded[1:]):
        with pytest.raises(ValueError):
            rans.decode(bad, len(a))
    try:
        assert (rans.decode(bytes(low), len(a)) != a).any()
    except ValueError:
        pass


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=256, max_size=256), st.sampled_from([12, 14]))
def test_frequencies_sum_up(counts, bits):
    f = rans.normalise(np.array(counts), bits)
    assert f.sum() == (1 << bits if any(counts) else 0) and all((x > 0) == (c > 0) for x, c in zip(f, counts))
