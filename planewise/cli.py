"""Command line: ``python -m planewise.cli compress|decompress|info``; ``-`` is standard input or output."""

from __future__ import annotations

import argparse
import json
import sys

from planewise.functions import checkpoint, codec

SUFFIX = ".pw"


def human(n: float) -> str:
    """A byte count with a binary unit."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def _read(path: str) -> bytes:
    if path == "-":
        return sys.stdin.buffer.read()
    with open(path, "rb") as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    if path == "-":
        sys.stdout.buffer.write(data)
        sys.stdout.buffer.flush()
        return
    with open(path, "wb") as f:
        f.write(data)


def _compress(a: argparse.Namespace) -> int:
    raw = _read(a.input)
    if a.base:
        out = checkpoint.model_delta_compress(raw, _read(a.base), level=a.level, effort=a.effort)
    elif a.checkpoint or a.input.endswith(".safetensors"):
        out = checkpoint.compress_checkpoint(raw, level=a.level, effort=a.effort)
    else:
        out = codec.compress(raw, dtype=a.dtype, level=a.level, effort=a.effort)
    target = a.output or ("-" if a.input == "-" else a.input + SUFFIX)
    _write(target, out)
    if target != "-":
        print(f"{human(len(raw))} -> {human(len(out))} ({len(raw) / max(1, len(out)):.3f}x)", file=sys.stderr)
    return 0


def _decompress(a: argparse.Namespace) -> int:
    blob = _read(a.input)
    kind = checkpoint.peek(blob)
    if kind == "checkpoint":
        out = checkpoint.decompress_checkpoint(blob)
    elif kind in ("model_delta", "delta"):
        if not a.base:
            raise ValueError("a delta needs --base")
        out = (checkpoint.model_delta_decompress if kind == "model_delta" else codec.delta_decompress)(blob, _read(a.base))
    else:
        out = codec.decompress(blob)
    default = a.input.removesuffix(SUFFIX) if a.input.endswith(SUFFIX) else a.input + ".out"
    _write(a.output or ("-" if a.input == "-" else default), out)
    return 0


def _info(a: argparse.Namespace) -> int:
    blob = _read(a.input)
    kind = checkpoint.peek(blob)
    if kind == "checkpoint":
        r = checkpoint.CheckpointReader.from_bytes(blob)
        out = {"kind": kind, "stored_bytes": len(blob), "metadata": r.metadata(), "tensors": r.index()}
    elif kind == "model_delta":
        out = {"kind": kind, "stored_bytes": len(blob), "records": checkpoint.model_delta_info(blob)}
    else:
        out = codec.info(blob)
    print(json.dumps(out, indent=None if a.compact else 2))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="planewise", description="Lossless coding of tensors and checkpoints.")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress", help="code a file")
    c.add_argument("input")
    c.add_argument("-o", "--output")
    c.add_argument("--dtype", help="element type of raw bytes")
    c.add_argument("--level", type=int, default=3)
    c.add_argument("--effort", choices=codec.EFFORTS, default="balanced")
    c.add_argument("--checkpoint", action="store_true", help="the input is a safetensors file, whatever its name")
    c.add_argument("--base", help="code as a delta against this safetensors file")
    c.set_defaults(run=_compress)
    d = sub.add_parser("decompress", help="restore a file")
    d.add_argument("input")
    d.add_argument("-o", "--output")
    d.add_argument("--base")
    d.set_defaults(run=_decompress)
    i = sub.add_parser("info", help="describe a coded file")
    i.add_argument("input")
    i.add_argument("--compact", action="store_true")
    i.set_defaults(run=_info)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (OSError, ValueError, TypeError) as e:
        print(f"planewise: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
