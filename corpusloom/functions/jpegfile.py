"""Baseline JPEG files: the entropy coder for the planes of rasters.py, with code tables fitted to each image."""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

from .rasters import jpeg_planes

#: Block places by diagonals, up and down in turn.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))


def code_lengths(counts: Counter) -> dict[int, int]:
    """Bits of each symbol's code: at most 16, and none of ones alone, which a symbol of count 0 takes."""
    heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(counts.items()))]
    heap.append((0, len(heap), [-1]))
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, -1], 0)
    tie = len(heap)
    while len(heap) > 1:
        (a, _, xs), (b, _, ys) = heapq.heappop(heap), heapq.heappop(heap)
        for s in xs + ys:
            depth[s] += 1
        heapq.heappush(heap, (a + b, tie, xs + ys))
        tie += 1
    per = Counter(max(d, 1) for d in depth.values())
    for bits in range(max(per), 16, -1):  # two of the longest become one longer neighbour of a shorter one
        while per[bits]:
            short = next(j for j in range(bits - 2, 0, -1) if per[j])
            per[bits] -= 2
            per[bits - 1] += 1
            per[short + 1] += 2
            per[short] -= 1
    lengths = [b for b in sorted(per) for _ in range(per[b])][:-1]  # the last and longest is the one of ones
    return dict(zip(sorted(counts, key=lambda s: (depth[s], s)), lengths))


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, bits) by symbol, counting up through the lengths."""
    out, code, last = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], list(lengths).index(x[0]))):
        code <<= n - last
        out[s], last = (code, n), n
        code += 1
    return out


def _size(v: int) -> tuple[int, int]:
    """(bits, their value) of a number: negative ones count from below."""
    n = abs(v).bit_length()
    return n, v if v >= 0 else v + (1 << n) - 1


def _symbols(block: list[int], before: int) -> list[tuple[int, int, int]]:
    """(symbol, extra bits, their value): the step of the first coefficient, then runs of zeros and what ends them."""
    n, v = _size(block[0] - before)
    out, run = [(n, n, v)], 0
    last = max((k for k in range(1, 64) if block[k]), default=0)
    for k in range(1, last + 1):
        if not block[k]:
            run += 1
            continue
        while run > 15:
            out.append((0xF0, 0, 0))
            run -= 16
        n, v = _size(block[k])
        out.append((run << 4 | n, n, v))
        run = 0
    return out + [(0, 0, 0)] * (last < 63)


def encode(a: np.ndarray, quality: int, subsample: bool = True) -> bytes:
    """An RGB raster as a file that any decoder reads."""
    h, w = a.shape[:2]
    unit = 16 if subsample else 8
    padded = np.pad(a, ((0, -h % unit), (0, -w % unit), (0, 0)), mode="edge")
    planes = jpeg_planes(padded, quality, subsample)
    flat = [q.reshape(*q.shape[:2], 64)[:, :, ZIGZAG].astype(int) for q, _, _ in planes]
    step = 2 if subsample else 1
    stream: list[tuple[int, list[tuple[int, int, int]]]] = []
    before = [0, 0, 0]
    for y in range(padded.shape[0] // unit):
        for x in range(padded.shape[1] // unit):
            for c in range(3):
                n = step if c == 0 else 1
                for dy in range(n):
                    for dx in range(n):
                        block = flat[c][y * n + dy, x * n + dx].tolist()
                        stream.append((min(c, 1), _symbols(block, before[c])))
                        before[c] = block[0]
    counts = {(kind, t): Counter() for kind in (0, 1) for t in (0, 1)}
    for t, symbols in stream:
        counts[0, t][symbols[0][0]] += 1
        counts[1, t].update(s for s, _, _ in symbols[1:])
    lengths = {k: code_lengths(c or Counter({0: 1})) for k, c in counts.items()}
    tables = {k: codes(v) for k, v in lengths.items()}
    out, held, bits = bytearray(), 0, 0
    for t, symbols in stream:
        for i, (s, n, v) in enumerate(symbols):
            code, m = tables[min(i, 1), t][s]
            held, bits = (held << m | code) << n | v, bits + m + n
            while bits >= 8:
                bits -= 8
                byte = held >> bits & 255
                out.append(byte)
                if byte == 255:
                    out.append(0)
            held &= (1 << bits) - 1
    if bits:
        byte = (held << (8 - bits) | (1 << (8 - bits)) - 1) & 255
        out += bytes([byte, 0] if byte == 255 else [byte])
    part = lambda marker, body: struct.pack(">BBH", 255, marker, len(body) + 2) + body
    head = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for t in (0, 1):
        head += part(0xDB, bytes([t]) + bytes(int(x) for x in planes[t][1].ravel()[ZIGZAG]))
    s = 0x22 if subsample else 0x11
    head += part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, s, 0, 2, 0x11, 1, 3, 0x11, 1]))
    for (kind, t), own in lengths.items():
        per = Counter(own.values())
        order = sorted(own, key=lambda x: tables[kind, t][x][::-1])
        head += part(0xC4, bytes([kind << 4 | t, *(per[n] for n in range(1, 17)), *order]))
    return head + part(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + bytes(out) + b"\xff\xd9"
