"""Frames: lossless coding of one tensor's bytes, by the smallest of several reversible encodings.

A frame is self-describing: magic, version, a JSON header (kind, type, shape, plane methods and
lengths) and the payloads.  Block and chunk sizes are fixed, so frames do not depend on the machine.
These are the kernels that ``planewise.operators.coding`` maps over rows; they also serve as a
Python API for single buffers.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import zstandard

from planewise.functions import rans
from planewise.functions.bits import dtype as dtype_of

VERSION = 1
FRAME, CHUNKED, DELTA = b"PWT1", b"PWC1", b"PWD1"
_PREFIX = struct.Struct("<4sBI")
STORE, ZSTD, ZSTD_BLOCKS, RANS, RANS_ADAPTIVE, RANS_ORDER1 = range(6)
METHOD_NAMES = ["store", "zstd", "zstd_blocks", "rans", "rans_adaptive", "rans_order1"]
BLOCK, BLOCKS_FROM = 1 << 20, 4 << 20
CHUNK = 2 << 20
#: Thresholds of the candidate gates.
RANS_GATE, RANS_GAIN, RANS_FLAT, BLOCKS_SLACK, OPAQUE_GATE, FIELDS_SLACK = 0.80, 0.99, 0.995, 1.01, 0.95, 1.01
#: Of the tier ``max``: all entropy coders are tried below this share; of more than two transforms the two smallest at level 1 stay.
MAX_GATE, MAX_TRANSFORMS, PRUNED_FROM = 0.75, 2, 1 << 20
#: Other codecs are tried without ``auto`` only if the first one leaves this share.
ALTERNATIVES_GATE = 0.98
#: Of turbo: streams above this length are stored if a level-1 look leaves more than the first share, any if coding leaves the second.
TURBO_PROBED, TURBO_FLAT, TURBO_KEEP = 1 << 18, 0.97, 0.99
ORDER1_LENGTH, ORDER1_SYMBOLS = 1 << 16, 64
SPARSE_SHARE, PALETTE_MOST = 0.10, 256
#: The look at large tensors before zeros are counted: windows, their length, and the share below which they are dense.
SAMPLED_FROM, SAMPLE_WINDOWS, SAMPLE_LENGTH, SAMPLE_SHARE = 1 << 20, 64, 16_384, 0.05
THREADS_FROM = 1 << 22
EFFORTS = ("fast", "balanced", "max")


class FrameError(ValueError):
    """The bytes are not a whole, undamaged frame of a known kind and version."""


# -- byte coders --------------------------------------------------------------------------------


def zstd_compress(data: bytes, level: int = 3, long_range: bool = True) -> bytes:
    """One zstd frame whose window spans the data (up to 128 MiB)."""
    if not long_range:
        return zstandard.ZstdCompressor(level=level).compress(data)
    log = min(27, max(17, max(1, len(data) - 1).bit_length()))
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(level, window_log=log, enable_ldm=True)).compress(data)


def zstd_decompress(data: bytes, length: int) -> bytes:
    try:
        out = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompress(data, max_output_size=length) if length else b""
    except zstandard.ZstdError as e:
        raise FrameError(f"damaged zstd data: {e}") from e
    if len(out) != length:
        raise FrameError(f"{len(out)} bytes decoded, {length} expected")
    return out


def blocks_compress(data: bytes, level: int = 3) -> bytes:
    """Independent zstd blocks of a fixed size, which decode in parallel."""
    parts = [zstandard.ZstdCompressor(level=level).compress(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK)]
    return struct.pack(f"<II{len(parts)}I", BLOCK, len(parts), *map(len, parts)) + b"".join(parts)


def blocks_decompress(data: bytes, length: int) -> bytes:
    if len(data) < 8:
        raise FrameError("truncated blocks")
    block, count = struct.unpack_from("<II", data)
    if not block or count != -(-length // block) or len(data) < 8 + 4 * count:
        raise FrameError("damaged blocks")
    sizes = struct.unpack_from(f"<{count}I", data, 8)
    at, out = 8 + 4 * count, []
    if at + sum(sizes) != len(data):
        raise FrameError("damaged blocks")
    for i, n in enumerate(sizes):
        out.append(zstd_decompress(data[at : at + n], min(block, length - i * block)))
        at += n
    return b"".join(out)


def order0_bytes(plane: np.ndarray) -> float:
    """The size of a plane under its order-0 entropy."""
    n = np.bincount(plane, minlength=256)
    n = n[n > 0]
    return float(-(n * np.log2(n / n.sum())).sum() / 8)


@dataclass(frozen=True)
class Plane:
    method: int
    data: bytes
    orig_len: int


@dataclass
class Plan:
    """How a plane will be coded; an entropy coder's size is an estimate until ``plane`` runs it."""

    raw: bytes
    best: Plane
    size: float
    mode: int | None = None
    counts: np.ndarray | None = None

    def plane(self) -> Plane:
        if self.mode is not None:
            coded = rans.encode(np.frombuffer(self.raw, np.uint8), self.mode, self.counts)
            if len(coded) < len(self.best.data):
                self.best = Plane(_RANS[self.mode], coded, len(self.raw))
            self.mode, self.counts, self.size = None, None, len(self.best.data)
        return self.best


_RANS = {rans.ORDER0: RANS, rans.ADAPTIVE: RANS_ADAPTIVE, rans.ORDER1: RANS_ORDER1}


def plan_plane(raw: bytes, level: int = 3, effort: str = "balanced", opaque: bool = False) -> Plan:
    """The smallest of the byte coders whose gate opens; entropy coders are compared by what their counts promise.

    Of ``opaque`` bytes, zstd is tried with a window over the whole and with its own, which short periods prefer.
    """
    if not raw:
        return Plan(raw, Plane(STORE, b"", 0), 0)
    best = Plane(ZSTD, min((zstd_compress(raw, level, wide) for wide in ((True, False) if opaque else (True,))), key=len), len(raw))
    if len(best.data) >= len(raw):
        best = Plane(STORE, raw, len(raw))
    plan = Plan(raw, best, len(best.data))
    if effort != "fast":
        _plan_rans(plan, effort)
    if plan.mode is None and best.method == ZSTD and len(raw) >= BLOCKS_FROM:
        blocks = blocks_compress(raw, level)
        if len(blocks) <= BLOCKS_SLACK * len(best.data):
            plan.best, plan.size = Plane(ZSTD_BLOCKS, blocks, len(raw)), len(blocks)
    return plan


def _plan_rans(plan: Plan, effort: str) -> None:
    """Let an entropy coder replace the plan's plane if its counts promise less."""
    raw, best = plan.raw, plan.best
    plane = np.frombuffer(raw, np.uint8)
    modes = rans.estimates(plane, (rans.ADAPTIVE, rans.ORDER0))
    whole = modes[rans.ORDER0][1][0]
    n = whole[whole > 0]
    ideal = float(-(n * np.log2(n / n.sum())).sum() / 8)
    thorough = effort == "max" and len(best.data) <= MAX_GATE * len(raw)
    # a plane of nearly uniform bytes has nothing to gain
    if thorough or RANS_FLAT * len(raw) > ideal and len(best.data) >= RANS_GATE * ideal:
        if len(raw) >= ORDER1_LENGTH and len(n) <= ORDER1_SYMBOLS:
            modes |= rans.estimates(plane, (rans.ORDER1,))
        mode, (size, counts) = min(modes.items(), key=lambda m: m[1][0])
        if size < len(best.data) * (1 if thorough else RANS_GAIN):
            plan.mode, plan.counts, plan.size = mode, counts, size


def compress_plane(raw: bytes, level: int = 3, effort: str = "balanced") -> Plane:
    return plan_plane(raw, level, effort).plane()


def decompress_plane(p: Plane) -> bytes:
    if p.method == STORE:
        if len(p.data) != p.orig_len:
            raise FrameError("stored plane of the wrong length")
        return p.data
    if p.method == ZSTD:
        return zstd_decompress(p.data, p.orig_len)
    if p.method == ZSTD_BLOCKS:
        return blocks_decompress(p.data, p.orig_len)
    if p.method in (RANS, RANS_ADAPTIVE, RANS_ORDER1):
        try:
            return rans.decode(p.data, p.orig_len).tobytes()
        except FrameError:
            raise
        except ValueError as e:
            raise FrameError(str(e)) from e
    raise FrameError(f"unknown plane method {p.method}")


# -- transforms ---------------------------------------------------------------------------------


def split_planes(raw: bytes, width: int) -> tuple[list[bytes], bytes]:
    """(byte planes, the tail that fills no element)."""
    n = len(raw) // width
    m = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return [m[:, j].tobytes() for j in range(width)], raw[n * width :]


def join_planes(planes: list[bytes], width: int, tail: bytes = b"") -> bytes:
    if len(planes) != width or len({len(p) for p in planes}) > 1:
        raise FrameError("planes do not match the element width")
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).tobytes() + tail


#: (unsigned type, exponent bits, mantissa bits) of the float types with a field transform.
_FIELDS = {"bf16": ("<u2", 8, 7), "fp16": ("<u2", 5, 10), "fp32": ("<u4", 8, 23)}


def split_fields(raw: bytes, dtype: str, pack: bool = False) -> tuple[list[bytes], bytes]:
    """(signs packed eight to a byte, exponents, mantissa) and the tail; the mantissa as byte planes or packed bits."""
    kind, exp, man = _FIELDS[dtype]
    width = np.dtype(kind).itemsize
    n = len(raw) // width
    u = np.frombuffer(raw, kind, n)
    mantissa = u & ((1 << man) - 1)
    if pack:
        bit = (mantissa[:, None] >> np.arange(man - 1, -1, -1, dtype=u.dtype)) & 1
        streams = [np.packbits(bit.astype(np.uint8).ravel()).tobytes()]
    else:
        streams = [(mantissa >> (8 * j)).astype(np.uint8).tobytes() for j in range(-(-man // 8))]  # the low eight bits
    signs = np.packbits((u >> (exp + man)).astype(np.uint8)).tobytes()
    return [signs, ((u >> man) & ((1 << exp) - 1)).astype(np.uint8).tobytes(), *streams], raw[n * width :]


def join_fields(streams: list[bytes], dtype: str, tail: bytes = b"", pack: bool = False) -> bytes:
    kind, exp, man = _FIELDS[dtype]
    if len(streams) < 3:
        raise FrameError("field streams are missing")
    n = len(streams[1])
    if len(streams[0]) != -(-n // 8) or pack and len(streams[2]) != -(-n * man // 8) or not pack and any(len(s) != n for s in streams[2:]):
        raise FrameError("field streams of the wrong length")
    u = np.unpackbits(np.frombuffer(streams[0], np.uint8), count=n).astype(np.uint32) << (exp + man)
    u |= np.frombuffer(streams[1], np.uint8).astype(np.uint32) << man
    if pack:
        bit = np.unpackbits(np.frombuffer(streams[2], np.uint8), count=n * man).reshape(n, man).astype(np.uint32)
        u |= (bit << np.arange(man - 1, -1, -1, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    else:
        for j, s in enumerate(streams[2:]):
            u |= np.frombuffer(s, np.uint8).astype(np.uint32) << (8 * j)
    return u.astype(kind).tobytes() + tail


def split_sparse(raw: bytes, width: int) -> tuple[list[bytes], bytes]:
    """Bitmap of the non-zero elements and their byte planes."""
    n = len(raw) // width
    u = np.frombuffer(raw, f"<u{width}", n)
    dense, _ = split_planes(u[u != 0].tobytes(), width)
    return [np.packbits(u != 0).tobytes(), *dense], raw[n * width :]


def join_sparse(streams: list[bytes], width: int, count: int, tail: bytes = b"") -> bytes:
    if len(streams) != width + 1 or len(streams[0]) != -(-count // 8):
        raise FrameError("sparse streams of the wrong length")
    at = np.flatnonzero(np.unpackbits(np.frombuffer(streams[0], np.uint8), count=count))
    dense = np.frombuffer(join_planes(streams[1:], width), f"<u{width}")
    if len(at) != len(dense):
        raise FrameError("bitmap and values disagree")
    u = np.zeros(count, f"<u{width}")
    u[at] = dense
    return u.tobytes() + tail


def split_palette(raw: bytes, width: int) -> tuple[list[bytes], bytes]:
    """Codebook in unsigned order and one index byte an element."""
    n = len(raw) // width
    book, index = np.unique(np.frombuffer(raw, f"<u{width}", n), return_inverse=True)
    if len(book) > PALETTE_MOST:
        raise ValueError(f"{len(book)} distinct values are too many for a palette")
    return [book.tobytes(), index.astype(np.uint8).tobytes()], raw[n * width :]


def join_palette(streams: list[bytes], width: int, tail: bytes = b"") -> bytes:
    if len(streams) != 2 or len(streams[0]) % width:
        raise FrameError("damaged palette")
    book, index = np.frombuffer(streams[0], f"<u{width}"), np.frombuffer(streams[1], np.uint8)
    if len(index) and (not len(book) or index.max() >= len(book)):
        raise FrameError("index beyond the palette")
    return book[index].tobytes() + tail


def sparse_gate(raw: bytes, width: int, share: float = SPARSE_SHARE) -> bool:
    """Exact; of many elements a look at spread windows comes first, which tells dense ones at once."""
    n = len(raw) // width
    if not n or width not in (1, 2, 4, 8):
        return False
    u = np.frombuffer(raw, f"<u{width}", n)
    if n > SAMPLED_FROM:
        starts = np.linspace(0, n - SAMPLE_LENGTH, SAMPLE_WINDOWS).astype(np.int64)
        if np.mean([np.mean(u[a : a + SAMPLE_LENGTH] == 0) for a in starts]) < SAMPLE_SHARE:
            return False
    return float((u == 0).mean()) >= share


def palette_gate(raw: bytes, width: int, most: int = PALETTE_MOST) -> bool:
    n = len(raw) // width
    if not n or width not in (2, 4, 8):
        return False
    u = np.frombuffer(raw, f"<u{width}", n)
    return len(np.unique(u[: 4 * most])) <= most and len(np.unique(u)) <= most  # a first look settles most


# -- frames -------------------------------------------------------------------------------------


class Candidate:
    """A frame to be: ``len`` is its size as planned, ``build`` codes it."""

    def __init__(self, kind: str, head: dict, streams: list[bytes], tail: bytes, level: int, effort: str, threads: int = 1):
        self.kind, self.head, self.tail = kind, head, tail
        plan = lambda s: plan_plane(s, level, effort, kind == "opaque")
        if threads > 1 and sum(map(len, streams)) >= THREADS_FROM:
            with ThreadPoolExecutor(min(threads, len(streams))) as pool:
                self.plans = list(pool.map(plan, streams))
        else:
            self.plans = list(map(plan, streams))

    def __len__(self) -> int:
        return int(sum(p.size for p in self.plans)) + len(self.tail) + 32 * len(self.plans)

    def build(self) -> bytes:
        planes = [p.plane() for p in self.plans]
        return _build(FRAME, self.head | {"kind": self.kind, "tail": len(self.tail), "planes": [[p.method, p.orig_len, len(p.data)] for p in planes]}, [self.tail, *(p.data for p in planes)])


def _build(magic: bytes, head: dict, payload: list[bytes]) -> bytes:
    text = json.dumps(head, separators=(",", ":")).encode()
    return b"".join([_PREFIX.pack(magic, VERSION, len(text)), text, *payload])


def parse(blob: bytes, magic: bytes | None = None) -> tuple[bytes, dict, memoryview]:
    """(magic, header, payload) of any frame."""
    if len(blob) < _PREFIX.size:
        raise FrameError("truncated frame")
    found, version, size = _PREFIX.unpack_from(blob)
    if found not in (FRAME, CHUNKED, DELTA) or magic and found != magic:
        raise FrameError(f"bad magic {found!r}")
    if version != VERSION:
        raise FrameError(f"unknown version {version}")
    if len(blob) < _PREFIX.size + size:
        raise FrameError("truncated frame")
    try:
        head = json.loads(bytes(blob[_PREFIX.size : _PREFIX.size + size]))
    except ValueError as e:
        raise FrameError("damaged header") from e
    return found, head, memoryview(blob)[_PREFIX.size + size :]


def _pruned(splits: list[tuple[str, list[bytes], bytes]], most: int = MAX_TRANSFORMS) -> list[tuple[str, list[bytes], bytes]]:
    """The transforms whose streams are smallest at level 1, in the order given."""
    size = {kind: sum(len(zstd_compress(s, 1)) for s in streams if s) for kind, streams, _ in splits}
    keep = sorted(size, key=size.get)[:most]
    return [x for x in splits if x[0] in keep]


def _candidates(raw: bytes, code: str, width: int, transform: str, level: int, effort: str, auto: bool, head: dict, threads: int = 1) -> list[tuple[str, Candidate]]:
    """(codec, frame) in order of preference; the first is the primary one."""
    make = lambda kind, streams, tail=b"": (kind, Candidate(kind, head, streams, tail, level, effort, threads))
    if transform == "opaque" or width == 1:
        return [make("opaque", [raw])] + ([make("sparse", *split_sparse(raw, 1))] if auto and sparse_gate(raw, 1) else [])
    splits = [("byteplane", *split_planes(raw, width))]
    if transform == "fields" or effort == "max" and code in _FIELDS:
        splits.append(("fields", *split_fields(raw, code)))
    if effort == "max" and code in _FIELDS:
        splits.append(("bitpack", *split_fields(raw, code, pack=True)))
    if len(splits) > MAX_TRANSFORMS and len(raw) >= PRUNED_FROM:
        splits = _pruned(splits)
    out = [make(*x) for x in splits]
    smallest = min(len(f) for _, f in out)
    if auto or smallest >= ALTERNATIVES_GATE * len(raw):
        if len(raw) < 1 << 20 or smallest >= OPAQUE_GATE * len(raw) or len(zstd_compress(raw, -3)) < smallest:
            out.append(make("opaque", [raw]))
        if sparse_gate(raw, width):
            out.append(make("sparse", *split_sparse(raw, width)))
        if palette_gate(raw, width):
            out.append(make("palette", *split_palette(raw, width)))
    return out


def choose(candidates: list[tuple]) -> tuple:
    """The smallest, the first of equals; byte planes within one per cent of it are taken before fields, as they decode faster."""
    best = min(candidates, key=lambda c: len(c[1]))
    if best[0] in ("fields", "bitpack"):
        for c in candidates:
            if c[0] == "byteplane" and len(c[1]) <= FIELDS_SLACK * len(best[1]):
                return c
    return best


def compress(data, *, dtype: str | None = None, level: int = 3, effort: str = "balanced", auto: bool = True, threads: int = 1) -> bytes:
    """Code bytes, any buffer or a NumPy array; ``effort`` is fast (no entropy coder), balanced or max (all transforms, zstd 19).

    ``threads`` look at the planes of a large buffer side by side; the frame is the same.  Tasks of Spark use one.
    """
    if effort not in EFFORTS:
        raise ValueError(f"effort must be one of {EFFORTS}")
    if not 1 <= level <= 22:
        raise ValueError("level must be in 1..22")
    head: dict = {}
    if isinstance(data, np.ndarray):
        array = np.asarray(data, order="C")
        head = {"numpy": array.dtype.str, "shape": list(array.shape)}
        raw = array.astype(array.dtype.newbyteorder("<"), copy=False).tobytes()
        dtype = dtype or array.dtype.name
    else:
        raw = bytes(data)
    d = dtype_of(dtype)
    head |= {"dtype": d.code, "width": d.width, "orig_len": len(raw)}
    if effort == "max":
        level = max(level, 19)
    return choose(_candidates(raw, d.code, d.width, d.transform, level, effort, auto, head, threads))[1].build()


def compress_as(kind: str, raw: bytes, *, dtype: str, level: int = 3, effort: str = "balanced") -> bytes:
    """A frame of one given kind, whatever would be smallest."""
    d = dtype_of(dtype)
    splits: dict[str, Callable[[], tuple]] = {
        "opaque": lambda: ([raw], b""),
        "byteplane": lambda: split_planes(raw, d.width),
        "fields": lambda: split_fields(raw, d.code),
        "bitpack": lambda: split_fields(raw, d.code, pack=True),
        "sparse": lambda: split_sparse(raw, d.width),
        "palette": lambda: split_palette(raw, d.width),
    }
    if kind not in splits or kind in ("fields", "bitpack") and d.code not in _FIELDS:
        raise ValueError(f"no frame of kind {kind!r} for {d.code}")
    return Candidate(kind, {"dtype": d.code, "width": d.width, "orig_len": len(raw)}, *splits[kind](), level, effort).build()


def _planes(head: dict, payload: memoryview) -> tuple[bytes, list[bytes]]:
    sizes = [n for _, _, n in head["planes"]]
    if head["tail"] + sum(sizes) != len(payload):
        raise FrameError("payload of the wrong length")
    at, out = head["tail"], []
    for method, orig, n in head["planes"]:
        out.append(decompress_plane(Plane(method, bytes(payload[at : at + n]), orig)))
        at += n
    return bytes(payload[: head["tail"]]), out


def _decode_frame(head: dict, payload: memoryview) -> bytes:
    try:
        kind, width, code, length = head["kind"], head["width"], head["dtype"], head["orig_len"]
        tail, streams = _planes(head, payload)
    except (KeyError, TypeError) as e:
        raise FrameError("damaged header") from e
    joins: dict[str, Callable[[], bytes]] = {
        "opaque": lambda: b"".join(streams),
        "byteplane": lambda: join_planes(streams, width, tail),
        "fields": lambda: join_fields(streams, code, tail),
        "bitpack": lambda: join_fields(streams, code, tail, pack=True),
        "sparse": lambda: join_sparse(streams, width, length // width, tail),
        "palette": lambda: join_palette(streams, width, tail),
    }
    if kind not in joins:
        raise FrameError(f"unknown kind {kind!r}")
    out = joins[kind]()
    if len(out) != length:
        raise FrameError(f"{len(out)} bytes decoded, {length} expected")
    return out


def decompress(blob: bytes, reference: bytes | None = None, out=None):
    """The bytes of any frame; a delta needs its reference.  With a writable buffer ``out`` they go there, and ``out`` comes back."""
    if out is not None:
        whole = decompress(blob, reference)
        view = memoryview(out).cast("B")
        if len(view) < len(whole):
            raise ValueError(f"the buffer has {len(view)} bytes, {len(whole)} are needed")
        view[: len(whole)] = whole
        return out
    magic, head, payload = parse(blob)
    if magic == CHUNKED:
        return _decode_chunks(head, payload)
    if magic == DELTA:
        if reference is None:
            raise ValueError("a delta needs its reference")
        return delta_decompress(blob, reference)
    return _decode_frame(head, payload)


def decompress_array(blob: bytes) -> np.ndarray:
    """The array of a frame made from one."""
    _, head, _ = parse(blob, FRAME)
    if "numpy" not in head:
        raise ValueError("the frame holds bytes, not an array")
    d = np.dtype(head["numpy"])
    return np.frombuffer(decompress(blob), d.newbyteorder("<")).astype(d, copy=False).reshape(head["shape"])


def info(blob: bytes) -> dict:
    """Kind, type, lengths and plane methods, without decoding."""
    magic, head, _ = parse(blob)
    out = {"magic": magic.decode(), "stored_bytes": len(blob), **{k: head[k] for k in ("kind", "dtype", "width", "orig_len", "numpy", "shape", "ref_len") if k in head}}
    if "planes" in head:
        out["planes"] = [{"method": METHOD_NAMES[m], "orig_len": o, "comp_len": c} for m, o, c in head["planes"]]
    return out


def peek(blob: bytes) -> str | None:
    """Which kind of frame bytes begin, or None."""
    return {FRAME: "frame", CHUNKED: "chunked", DELTA: "delta"}.get(bytes(blob[:4]))


def is_kind(blob: bytes, kind: str) -> bool:
    """Whether bytes are a frame of a kind (``sparse``, ``palette``, ``byteplane``, ...), by its header."""
    return peek(blob) == "frame" and parse(blob)[1].get("kind") == kind


def is_adaptive(blob: bytes) -> bool:
    """Whether a plane of a frame is coded with a model a chunk."""
    return peek(blob) == "frame" and any(p[0] == RANS_ADAPTIVE for p in parse(blob)[1].get("planes", []))


# -- chunked ------------------------------------------------------------------------------------


def chunked_compress(data: bytes, *, dtype: str | None = None, level: int = 1, chunk: int = CHUNK) -> bytes:
    """Independent chunks of whole elements: each decodes alone, and is a row of its own in Spark."""
    d = dtype_of(dtype)
    raw, size = bytes(data), max(d.width, chunk - chunk % d.width)
    frames = [compress(raw[i : i + size], dtype=d.code, level=level, effort="fast", auto=False) for i in range(0, len(raw), size)]
    return _build(CHUNKED, {"orig_len": len(raw), "dtype": d.code, "chunks": [len(f) for f in frames]}, frames)


def _decode_chunks(head: dict, payload: memoryview) -> bytes:
    sizes = head.get("chunks", [])
    if sum(sizes) != len(payload):
        raise FrameError("payload of the wrong length")
    at, out = 0, []
    for n in sizes:
        out.append(_decode_frame(*parse(bytes(payload[at : at + n]), FRAME)[1:]))
        at += n
    whole = b"".join(out)
    if len(whole) != head["orig_len"]:
        raise FrameError("chunks of the wrong length")
    return whole


def _turbo_plane(raw: bytes, level: int) -> Plane:
    """zstd, or the bytes as they are; long streams that a cheap look over their whole length cannot shrink are not tried."""
    if len(raw) > TURBO_PROBED and len(zstd_compress(raw, 1)) > TURBO_FLAT * len(raw):
        return Plane(STORE, raw, len(raw))
    coded = zstd_compress(raw, level) if raw else b""
    return Plane(ZSTD, coded, len(raw)) if len(coded) < TURBO_KEEP * len(raw) else Plane(STORE, raw, len(raw))


def turbo_compress(data: bytes, *, dtype: str | None = None, level: int = 3) -> bytes:
    """Planes or opaque, whichever is smaller, without entropy coders; bytes that do not shrink are stored."""
    d, raw = dtype_of(dtype), bytes(data)
    head = {"dtype": d.code, "width": d.width, "orig_len": len(raw)}

    def frame(kind: str, streams: list[bytes], tail: bytes = b"") -> tuple[str, bytes]:
        planes = [_turbo_plane(s, level) for s in streams]
        return kind, _build(FRAME, head | {"kind": kind, "tail": len(tail), "planes": [[p.method, p.orig_len, len(p.data)] for p in planes]}, [tail, *(p.data for p in planes)])

    opaque = frame("opaque", [raw])
    return opaque[1] if d.width == 1 else choose([frame("byteplane", *split_planes(raw, d.width)), opaque])[1]


# -- delta --------------------------------------------------------------------------------------


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def xor(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).tobytes()


def delta_compress(current: bytes, reference: bytes, *, dtype: str | None = None, level: int = 3, effort: str = "balanced") -> bytes:
    """The XOR of two buffers of equal length, coded, with the digest of the reference."""
    if len(current) != len(reference):
        raise ValueError("current and reference differ in length")
    return _build(DELTA, {"ref_len": len(reference), "ref_digest": digest(reference)}, [compress(xor(current, reference), dtype=dtype, level=level, effort=effort)])


def delta_decompress(blob: bytes, reference: bytes) -> bytes:
    _, head, payload = parse(blob, DELTA)
    if head["ref_len"] != len(reference):
        raise FrameError("the reference has another length")
    if head["ref_digest"] != digest(reference):
        raise FrameError("this is not the reference of the delta")
    return xor(decompress(bytes(payload)), reference)
