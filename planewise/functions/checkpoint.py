"""Checkpoint files: the safetensors layout, a compressed container with random access, and deltas between checkpoints."""

from __future__ import annotations

import io
import json
import os
import struct
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

from planewise.functions import codec
from planewise.functions.bits import BY_SAFETENSORS
from planewise.functions.codec import FrameError

CONTAINER, MODEL_DELTA = b"PWS1", b"PWM1"
_FOOTER = struct.Struct("<QQ4s")


@dataclass(frozen=True)
class Tensor:
    name: str
    dtype: str
    shape: tuple[int, ...]
    begin: int
    end: int


def parse_safetensors(blob) -> tuple[bytes, list[Tensor], dict[str, str], int]:
    """(header bytes, tensors by place, metadata, where the data begin); ValueError on a malformed file."""
    blob = memoryview(blob)
    if len(blob) < 8:
        raise ValueError("too short for a safetensors file")
    size = struct.unpack("<Q", blob[:8])[0]
    if size > len(blob) - 8:
        raise ValueError("the header reaches beyond the file")
    return _parse_header(bytes(blob[8 : 8 + size]), len(blob) - 8 - size)


def _parse_header(text: bytes, data_len: int) -> tuple[bytes, list[Tensor], dict[str, str], int]:
    try:
        head = json.loads(text)
    except ValueError as e:
        raise ValueError("the header is not JSON") from e
    if not isinstance(head, dict):
        raise ValueError("the header is not an object")
    tensors, metadata = [], {}
    for name, x in head.items():
        if name == "__metadata__":
            metadata = {str(k): str(v) for k, v in x.items()}
            continue
        try:
            begin, end = x["data_offsets"]
            t = Tensor(name, str(x["dtype"]), tuple(int(n) for n in x["shape"]), int(begin), int(end))
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError(f"tensor {name!r} is malformed") from e
        if not 0 <= t.begin <= t.end <= data_len:
            raise ValueError(f"tensor {name!r} lies outside the data")
        tensors.append(t)
    return text, sorted(tensors, key=lambda t: t.begin), metadata, 8 + len(text)


def build_safetensors(tensors: dict[str, tuple[str, tuple[int, ...], bytes]], metadata: dict[str, str] | None = None) -> bytes:
    """A safetensors file of {name: (dtype, shape, bytes)}."""
    head: dict = {"__metadata__": metadata} if metadata else {}
    at = 0
    for name, (dtype, shape, raw) in tensors.items():
        head[name] = {"dtype": dtype, "shape": list(shape), "data_offsets": [at, at + len(raw)]}
        at += len(raw)
    text = json.dumps(head, separators=(",", ":")).encode()
    return struct.pack("<Q", len(text)) + text + b"".join(raw for _, _, raw in tensors.values())


def contiguous(tensors: list[Tensor], data_len: int) -> bool:
    """Whether the tensors tile the data exactly."""
    at = 0
    for t in sorted(tensors, key=lambda t: (t.begin, t.end)):
        if t.begin != at:
            return False
        at = t.end
    return at == data_len


def codec_dtype(safetensors_dtype: str) -> str | None:
    """Float types have a transform; integers in a container, and unknown types, are opaque."""
    d = BY_SAFETENSORS.get(safetensors_dtype)
    return d.code if d and d.code in ("bf16", "fp16", "fp32", "fp64") else None


# -- container ----------------------------------------------------------------------------------


def compress_checkpoint(blob: bytes, *, level: int = 3, effort: str = "balanced") -> bytes:
    """A container of one frame a distinct tensor; equal tensors refer to the first; other layouts become one opaque frame."""
    text, tensors, _, start = parse_safetensors(blob)
    data = blob[start:]
    parts: list[bytes] = [struct.pack("<4sBQ", CONTAINER, codec.VERSION, len(text)), text]
    at = sum(map(len, parts))
    index: list[dict] = []
    tiled = contiguous(tensors, len(data))
    seen: dict[tuple[str, int], int] = {}
    for i, t in enumerate(tensors if tiled else [Tensor("", "U8", (), 0, len(data))]):
        raw = data[t.begin : t.end]
        key = (codec.digest(raw), len(raw))
        row = {"name": t.name, "dtype": t.dtype, "shape": t.shape, "begin": t.begin, "end": t.end}
        first = seen.setdefault(key, i)
        if first != i:
            index.append(row | {"ref": first})
            continue
        frame = codec.compress(raw, dtype=codec_dtype(t.dtype), level=level, effort=effort)
        index.append(row | {"offset": at, "length": len(frame)})
        parts.append(frame)
        at += len(frame)
    table = json.dumps({"data_len": len(data), "contiguous": tiled, "tensors": index}, separators=(",", ":")).encode()
    return b"".join([*parts, table, _FOOTER.pack(at, len(table), CONTAINER)])


class CheckpointReader:
    """Random access to a container: opening reads its header and index, a tensor its own frame."""

    def __init__(self, file: BinaryIO):
        self.file = file
        size = file.seek(0, os.SEEK_END)
        if size < 13 + _FOOTER.size:
            raise FrameError("truncated container")
        magic, version, header_len = struct.unpack("<4sBQ", self._at(0, 13))
        at, n, end = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != CONTAINER or end != CONTAINER:
            raise FrameError("bad magic or truncated container")
        if version != codec.VERSION:
            raise FrameError(f"unknown version {version}")
        if at + n + _FOOTER.size != size or 13 + header_len > at:
            raise FrameError("damaged container")
        self._header = self._at(13, header_len)
        self._index = json.loads(self._at(at, n))
        self._by_name = {t["name"]: t for t in self._index["tensors"]} if self._index["contiguous"] else {}
        self._metadata = _parse_header(self._header, self._index["data_len"])[2]

    @classmethod
    def open(cls, path: str) -> CheckpointReader:
        return cls(open(path, "rb"))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CheckpointReader:
        return cls(io.BytesIO(blob))

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        out = self.file.read(length)
        if len(out) != length:
            raise FrameError("truncated container")
        return out

    def names(self) -> list[str]:
        return list(self._by_name)

    def header(self) -> bytes:
        return self._header

    def metadata(self) -> dict[str, str]:
        return self._metadata

    def index(self) -> list[dict]:
        """The rows of the index, with their kinds."""
        return [t | {"kind": "REF" if "ref" in t else "FRAME"} for t in self._index["tensors"]]

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def _frame(self, row: dict) -> dict:
        return self._index["tensors"][row["ref"]] if "ref" in row else row

    def frame_size(self, name: str) -> int:
        return self._frame(self._by_name[name])["length"]

    def _read(self, row: dict) -> bytes:
        f = self._frame(row)
        raw = codec.decompress(self._at(f["offset"], f["length"]))
        if len(raw) != row["end"] - row["begin"]:
            raise FrameError("tensor of the wrong length")
        return raw

    def read_raw(self, name: str) -> bytes:
        return self._read(self._by_name[name])

    def read_numpy(self, name: str) -> np.ndarray:
        row = self._by_name[name]
        d = BY_SAFETENSORS.get(row["dtype"])
        if d is None or d.numpy is None:
            raise TypeError(f"NumPy has no type for {row['dtype']}")
        return np.frombuffer(self.read_raw(name), d.numpy).reshape(row["shape"])

    def restore(self) -> bytes:
        """The whole original file."""
        out = b"".join(self._read(t) for t in self._index["tensors"])
        if len(out) != self._index["data_len"]:
            raise FrameError("data of the wrong length")
        return struct.pack("<Q", len(self._header)) + self._header + out

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> CheckpointReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def decompress_checkpoint(blob: bytes) -> bytes:
    return CheckpointReader.from_bytes(blob).restore()


def compress_file(source: str, target: str, **kw) -> dict:
    with open(source, "rb") as f:
        raw = f.read()
    out = compress_checkpoint(raw, **kw)
    with open(target, "wb") as f:
        f.write(out)
    return {"original_bytes": len(raw), "compressed_bytes": len(out), "ratio": len(raw) / len(out), "saved_pct": 100 * (1 - len(out) / len(raw))}


def decompress_file(source: str, target: str) -> dict:
    with CheckpointReader.open(source) as r:
        out = r.restore()
    with open(target, "wb") as f:
        f.write(out)
    return {"bytes": len(out)}


def load_file(path: str) -> dict[str, np.ndarray]:
    """Arrays by name from a container or a plain safetensors file; types NumPy lacks come as unsigned bits."""
    with open(path, "rb") as f:
        blob = f.read()
    if blob[:4] == CONTAINER:
        blob = decompress_checkpoint(blob)
    _, tensors, _, start = parse_safetensors(blob)
    out = {}
    for t in tensors:
        d = BY_SAFETENSORS.get(t.dtype)
        kind = d.numpy if d and d.numpy else f"<u{d.width if d else 1}"
        a = np.frombuffer(blob, np.uint8)[start + t.begin : start + t.end].view(kind)
        out[t.name] = a.reshape(t.shape) if d else a
    return out


def save_file(arrays: dict[str, np.ndarray], path: str, metadata: dict[str, str] | None = None, **kw) -> dict:
    """Write arrays as a container; returns the size statistics."""
    names = {d.numpy: d.safetensors for d in BY_SAFETENSORS.values() if d.numpy}
    tensors = {}
    for name, a in arrays.items():
        le = np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<"), copy=False)
        if le.dtype.str not in names:
            raise TypeError(f"no safetensors type for {a.dtype}")
        tensors[name] = (names[le.dtype.str], a.shape, le.tobytes())
    raw = build_safetensors(tensors, metadata)
    out = compress_checkpoint(raw, **kw)
    with open(path, "wb") as f:
        f.write(out)
    return {"original_bytes": len(raw), "compressed_bytes": len(out), "ratio": len(raw) / len(out)}


# -- deltas between checkpoints -----------------------------------------------------------------


def model_delta_compress(target: bytes, base: bytes, *, level: int = 3, effort: str = "balanced") -> bytes:
    """Per tensor COPY, DELTA or FULL against the tensor of the same name, type and length; the smaller of delta and full is kept.

    The digest covers the whole base file.  A target whose tensors do not tile its data is one opaque frame.
    """
    text, tensors, _, start = parse_safetensors(target)
    _, base_tensors, _, base_start = parse_safetensors(base)
    data = target[start:]
    by_name = {t.name: t for t in base_tensors}
    records, frames = [], []
    if contiguous(tensors, len(data)):
        for t in tensors:
            raw, b = data[t.begin : t.end], by_name.get(t.name)
            kind, frame = "FULL", codec.compress(raw, dtype=codec_dtype(t.dtype), level=level, effort=effort)
            if b and b.dtype == t.dtype and b.end - b.begin == len(raw):
                ref = base[base_start + b.begin : base_start + b.end]
                if ref == raw:
                    kind, frame = "COPY", b""
                else:
                    d = codec.delta_compress(raw, ref, dtype=codec_dtype(t.dtype), level=level, effort=effort)
                    if len(d) < len(frame):
                        kind, frame = "DELTA", d
            records.append([t.name, kind, len(frame)])
            frames.append(frame)
    else:
        frames.append(codec.compress(data, level=level, effort=effort))
        records.append(["", "OPAQUE", len(frames[0])])
    head = json.dumps({"base_digest": codec.digest(base), "data_len": len(data), "records": records}, separators=(",", ":")).encode()
    return struct.pack("<4sBQQ", MODEL_DELTA, codec.VERSION, len(head), len(text)) + head + text + b"".join(frames)


def model_delta_info(blob: bytes) -> list[list]:
    """[name, kind, stored length] of each record."""
    return _delta_parts(blob)[0]["records"]


def _delta_parts(blob: bytes) -> tuple[dict, bytes, int]:
    if len(blob) < 21:
        raise FrameError("truncated model delta")
    magic, version, n, m = struct.unpack_from("<4sBQQ", blob)
    if magic != MODEL_DELTA:
        raise FrameError("bad magic")
    if version != codec.VERSION:
        raise FrameError(f"unknown version {version}")
    if 21 + n + m > len(blob):
        raise FrameError("truncated model delta")
    return json.loads(blob[21 : 21 + n]), blob[21 + n : 21 + n + m], 21 + n + m


def model_delta_decompress(blob: bytes, base: bytes) -> bytes:
    head, text, at = _delta_parts(blob)
    if head["base_digest"] != codec.digest(base):
        raise FrameError("this is not the base of the delta")
    _, base_tensors, _, base_start = parse_safetensors(base)
    by_name = {t.name: t for t in base_tensors}
    out = []
    for name, kind, n in head["records"]:
        if at + n > len(blob):
            raise FrameError("truncated model delta")
        frame, at = blob[at : at + n], at + n
        if kind in ("COPY", "DELTA"):
            b = by_name[name]
            ref = base[base_start + b.begin : base_start + b.end]
        out.append(ref if kind == "COPY" else codec.delta_decompress(frame, ref) if kind == "DELTA" else codec.decompress(frame))
    data = b"".join(out)
    if len(data) != head["data_len"] or at != len(blob):
        raise FrameError("data of the wrong length")
    return struct.pack("<Q", len(text)) + text + data


def model_delta_compress_file(target: str, base: str, out: str, **kw) -> dict:
    """Write the delta of a checkpoint file against its base; returns the size statistics."""
    with open(target, "rb") as f, open(base, "rb") as g:
        raw = f.read()
        blob = model_delta_compress(raw, g.read(), **kw)
    with open(out, "wb") as f:
        f.write(blob)
    return {"original_bytes": len(raw), "compressed_bytes": len(blob), "ratio": len(raw) / max(1, len(blob))}


def model_delta_decompress_file(delta: str, base: str, out: str) -> dict:
    """Restore a checkpoint file from its delta and base."""
    with open(delta, "rb") as f, open(base, "rb") as g:
        blob = f.read()
        raw = model_delta_decompress(blob, g.read())
    with open(out, "wb") as f:
        f.write(raw)
    return {"compressed_bytes": len(blob), "bytes": len(raw)}


def peek(blob: bytes) -> str | None:
    """Which kind of file or frame bytes begin, or None."""
    return {CONTAINER: "checkpoint", MODEL_DELTA: "model_delta"}.get(bytes(blob[:4])) or codec.peek(blob)
