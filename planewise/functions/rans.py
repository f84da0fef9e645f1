"""Range asymmetric numeral systems in NumPy: many lanes step together.

A byte plane is laid out as lanes of equal length; all lanes code one symbol per step, so a step is a few
vector operations.  States are 32 bits and renormalise by 16-bit words, at most one a symbol.  The model
of a symbol is picked by a table index per lane and step, which gives three coders from one loop:

* order 0: one table;
* adaptive: one table per 64 KiB of the plane;
* order 1: one table per preceding symbol of the lane (0 before the first).

Layout: ``<BBIIII`` mode, bits, lanes, steps, length of the packed model, number of words; the model (zstd);
states; words; the bytes that fill no lane.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

ORDER0, ADAPTIVE, ORDER1 = 0, 1, 2
_HEAD = struct.Struct("<BBIIII")
_LOW = 1 << 16
CHUNK = 1 << 16
MOST_LANES = 2048


def normalise(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to a sum of 2**bits, at least 1 where there is a count; the rest goes to the largest bin, ties to the smallest symbol."""
    total, goal = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.int64) * goal // total), 0)
    rest = goal - int(f.sum())
    top = int(np.argmax(f))
    if f[top] + rest >= 1:
        f[top] += rest
        return f
    while rest < 0:  # many rare symbols: take from the largest until it fits
        top = int(np.argmax(f))
        take = min(-rest, max(1, int(f[top]) // 2))
        f[top] -= take
        rest += take
    return f


def _layout(n: int) -> tuple[int, int]:
    lanes = max(1, min(MOST_LANES, n // 256))
    return lanes, n // lanes


def _tables(mode: int, lanes: int, steps: int, symbols: np.ndarray | None = None) -> tuple[np.ndarray | None, int]:
    """(table of each lane, number of tables); order 1 has none for a lane."""
    if mode == ORDER0:
        return np.zeros(lanes, np.int64), 1
    if mode == ADAPTIVE:
        of = np.arange(lanes) * steps // CHUNK
        of = np.unique(of, return_inverse=True)[1]
        return of, int(of.max()) + 1
    return None, 256


def _model(plane: np.ndarray, mode: int) -> np.ndarray:
    """(tables, 256) symbol counts of the lanes' part of a plane."""
    lanes, steps = _layout(len(plane))
    if mode == ORDER1:
        body = plane[: lanes * steps].reshape(lanes, steps)
        key = body.astype(np.uint16)
        key[:, 1:] |= body[:, :-1].astype(np.uint16) << np.uint16(8)
        return np.bincount(key.ravel(), minlength=65536).reshape(256, 256)
    of, count = _tables(mode, lanes, steps)
    edge = np.searchsorted(of, np.arange(count + 1)) * steps
    return np.stack([np.bincount(plane[a:z], minlength=256) for a, z in zip(edge[:-1], edge[1:], strict=True)])


def estimate(counts: np.ndarray, length: int) -> float:
    """About how many bytes a plane of ``length`` with these counts is coded in: entropy, model, states."""
    lanes, steps = _layout(length)
    total = counts.sum(axis=1, keepdims=True)
    n, of = counts[counts > 0], np.broadcast_to(total, counts.shape)[counts > 0]
    return float(-(n * np.log2(n / of)).sum() / 8) + 1.6 * len(n) + 4 * lanes + _HEAD.size + 16 + length - lanes * steps


def estimates(plane: np.ndarray, modes: tuple[int, ...]) -> dict[int, tuple[float, np.ndarray]]:
    """(estimate, counts) by mode, without coding."""
    out: dict[int, tuple[float, np.ndarray]] = {}
    for mode in modes:
        counts = out[ADAPTIVE][1].sum(axis=0, keepdims=True) if mode == ORDER0 and ADAPTIVE in out else _model(plane, mode)
        out[mode] = estimate(counts, len(plane)), counts
    return out


def encode(plane: np.ndarray, mode: int = ADAPTIVE, counts: np.ndarray | None = None) -> bytes:
    """Code a uint8 array; ``counts`` are those of ``estimates``, if known."""
    bits = 12 if mode == ORDER1 else 14
    lanes, steps = _layout(len(plane))
    body = np.ascontiguousarray(plane[: lanes * steps].reshape(lanes, steps).T)
    of, _ = _tables(mode, lanes, steps)
    freq = np.stack([normalise(row, bits) for row in (_model(plane, mode) if counts is None else counts)])
    # states are whole numbers below 2**32, which doubles hold and divide exactly (quotients are at least 2**-32 from the next whole number)
    share, start = freq.ravel().astype(float), (np.cumsum(freq, axis=1) - freq).ravel().astype(float)
    x = np.full(lanes, float(_LOW))
    base = None if of is None else of.astype(np.intp) * 256
    at, f, c, q = np.empty(lanes, np.intp), np.empty(lanes), np.empty(lanes), np.empty(lanes)
    full = np.empty(lanes, bool)
    words: list[np.ndarray] = []
    limit, size = float(1 << 32 - bits), float(1 << bits)
    for t in range(steps - 1, -1, -1):
        if base is not None:
            np.add(base, body[t], out=at)
        elif t:
            np.multiply(body[t - 1], 256, out=at, dtype=np.intp)
            at += body[t]
        else:
            at[:] = body[0]
        share.take(at, out=f, mode="clip")
        start.take(at, out=c, mode="clip")
        np.multiply(f, limit, out=q)
        np.greater_equal(x, q, out=full)
        high = full.nonzero()[0]
        if len(high):
            some = x[high].astype(np.int64)
            words.append(some.astype("<u2"))
            x[high] = some >> 16
        np.divide(x, f, out=q)
        np.floor(q, out=q)
        np.subtract(size, f, out=f)  # x + q * (size - f) + c is q * size + (x - q * f) + c
        np.multiply(q, f, out=q)
        x += q
        x += c
    out = np.concatenate(words[::-1]) if words else np.zeros(0, "<u2")
    model = zstandard.ZstdCompressor(level=19 if mode == ORDER1 else 3).compress(freq.astype("<u2").tobytes())
    return _HEAD.pack(mode, bits, lanes, steps, len(model), len(out)) + model + x.astype("<u4").tobytes() + out.tobytes() + plane[lanes * steps :].tobytes()


def decode(data: bytes, length: int) -> np.ndarray:
    """Inverse of ``encode``; ValueError if the data are damaged."""
    if len(data) < _HEAD.size:
        raise ValueError("truncated rANS stream")
    mode, bits, lanes, steps, model_len, words_len = _HEAD.unpack_from(data)
    tail = length - lanes * steps
    need = _HEAD.size + model_len + 4 * lanes + 2 * words_len + tail
    if mode > ORDER1 or bits not in (12, 14) or (lanes, steps) != _layout(length) or need != len(data):
        raise ValueError("damaged rANS stream")
    at = _HEAD.size
    of, count = _tables(mode, lanes, steps)
    try:
        model = zstandard.ZstdDecompressor().decompress(data[at : at + model_len], max_output_size=count * 512)
    except zstandard.ZstdError as e:
        raise ValueError("damaged rANS model") from e
    if len(model) != count * 512:
        raise ValueError("damaged rANS model")
    freq = np.frombuffer(model, "<u2").astype(np.int64).reshape(count, 256)
    if not np.isin(freq.sum(axis=1), (0, 1 << bits)).all():
        raise ValueError("damaged rANS model")
    at += model_len
    x = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
    words = np.frombuffer(data, "<u2", words_len, at + 4 * lanes).astype(np.int64)
    size = 1 << bits
    symbol = np.zeros((count, size), np.uint8)
    for k, row in enumerate(freq):
        if row.any():
            symbol[k] = np.repeat(np.arange(256, dtype=np.uint8), row)
    cum, flat_f, symbol = (np.cumsum(freq, axis=1) - freq).ravel(), freq.ravel(), symbol.ravel()
    out = np.empty((steps, lanes), np.uint8)
    prev = np.zeros(lanes, np.int64)
    if of is not None:
        wide, narrow = of.astype(np.int64) * size, of.astype(np.int64) * 256
    place, mask = 0, size - 1
    for t in range(steps):
        slot = x & mask
        s = symbol[(prev << bits if mode == ORDER1 else wide) + slot]
        key = (prev << 8 if mode == ORDER1 else narrow) + s
        x >>= bits
        x *= flat_f[key]
        x += slot
        x -= cum[key]
        low = (x < _LOW).nonzero()[0]
        if len(low):
            if place + len(low) > words_len:
                raise ValueError("truncated rANS stream")
            x[low] = (x[low] << 16) | words[place : place + len(low)]
            place += len(low)
        out[t] = s
        if mode == ORDER1:
            prev = s.astype(np.int64)
    if place != words_len or (x != _LOW).any():
        raise ValueError("damaged rANS stream")
    return np.concatenate([out.T.ravel(), np.frombuffer(data, np.uint8, tail, len(data) - tail)])


def decode_scalar(data: bytes, length: int) -> bytes:
    """A plain, slow decoder of the same layout, one symbol at a time; the oracle of the tests."""
    mode, bits, lanes, steps, model_len, words_len = _HEAD.unpack_from(data)
    at = _HEAD.size
    of, count = _tables(mode, lanes, steps)
    model = zstandard.ZstdDecompressor().decompress(data[at : at + model_len], max_output_size=count * 512)
    freq = [list(struct.unpack_from("<256H", model, 512 * k)) for k in range(count)]
    at += model_len
    x = list(struct.unpack_from(f"<{lanes}I", data, at))
    words = iter(struct.unpack_from(f"<{words_len}H", data, at + 4 * lanes))
    out = [bytearray() for _ in range(lanes)]
    for _ in range(steps):
        for lane in range(lanes):
            row = freq[(out[lane][-1] if out[lane] else 0) if mode == ORDER1 else int(of[lane])]
            slot, s, low = x[lane] & ((1 << bits) - 1), 0, 0
            while low + row[s] <= slot:
                low += row[s]
                s += 1
            x[lane] = row[s] * (x[lane] >> bits) + slot - low
            if x[lane] < _LOW:
                x[lane] = x[lane] << 16 | next(words)
            out[lane].append(s)
    return b"".join(out) + data[len(data) - (length - lanes * steps) :]
