"""PNG files and metadata of JPEG files, read from their bytes alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..functions.jpegfile import ZIGZAG
from ..functions.rasters import LUMA, quant_table, to_rgb

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes) -> list[tuple[bytes, bytes, bool]]:
    """(type, body, whole) up to the end chunk; a file cut short has a last chunk that isn't whole."""
    out, i = [], len(SIGNATURE)
    if not data.startswith(SIGNATURE):
        return out
    while i + 8 <= len(data):
        n, kind = int.from_bytes(data[i : i + 4], "big"), data[i + 4 : i + 8]
        body = data[i + 8 : i + 8 + n]
        out.append((kind, body, len(body) == n))
        if kind == b"IEND":
            break
        i += 12 + n
    return out


def _inflated(x: bytes) -> bytes:
    try:
        return zlib.decompress(x)
    except zlib.error:
        return x


def text_chunks(data: bytes) -> dict[str, str]:
    """Keywords and texts of tEXt, zTXt and iTXt chunks, wherever in the file they are."""
    out = {}
    for kind, body, _ in chunks(data):
        if kind not in (b"tEXt", b"zTXt", b"iTXt"):
            continue
        key, _, rest = body.partition(b"\0")
        if kind == b"zTXt":
            rest = _inflated(rest[1:])
        elif kind == b"iTXt" and rest.count(b"\0") >= 3:
            flag, _, rest = rest[:1], rest[1:2], rest[2:].split(b"\0", 2)[-1]
            rest = _inflated(rest) if flag == b"\1" else rest
        out[key.decode("latin-1")] = rest.decode("utf-8", "replace")[:4000]
    return out


def decode(data: bytes) -> tuple[np.ndarray | None, str]:
    """(raster, status): status is ok, recovered_truncated or failed. 8 and 16 bits, not interlaced; rows that a cut
    file lacks are 0."""
    parts = chunks(data)
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) < 13:
        return None, "failed"
    w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", parts[0][1][:13])
    if depth not in (8, 16) or colour not in _CHANNELS or lace or not w or not h:
        return None, "failed"
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(b for k, b, _ in parts if k == b"IDAT"))
    except zlib.error:
        return None, "failed"
    step = _CHANNELS[colour] * depth // 8
    line = w * step
    whole = len(raw) >= h * (line + 1) and parts[-1][0] == b"IEND"
    if not raw:
        return None, "failed"
    rows = np.zeros((h, line), np.uint8)
    for y in range(min(h, len(raw) // (line + 1))):
        kind, cur = raw[y * (line + 1)], np.frombuffer(raw, np.uint8, line, y * (line + 1) + 1)
        rows[y] = _unfiltered(kind, cur, rows[y - 1] if y else np.zeros(line, np.uint8), step)
    a = rows.reshape(h, w, step)
    if depth == 16:
        a = a.reshape(h, w, -1, 2).astype(np.uint16)
        a = a[..., 0] << 8 | a[..., 1]
    if colour == 3:
        palette = np.frombuffer(next((b for k, b, _ in parts if k == b"PLTE"), b""), np.uint8).reshape(-1, 3)
        alpha = np.frombuffer(next((b for k, b, _ in parts if k == b"tRNS"), b""), np.uint8)
        full = np.concatenate([palette, np.concatenate([alpha, np.full(max(0, len(palette) - len(alpha)), 255, np.uint8)])[: len(palette), None]], axis=1)
        a = full[np.minimum(a[..., 0], len(full) - 1)]
    return a, "ok" if whole else "recovered_truncated"


def _unfiltered(kind: int, cur: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return cur
    if kind == 2:
        return cur + up
    if kind == 1:
        return np.add.accumulate(cur.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(cur) + step, np.int64)
    above = np.concatenate([np.zeros(step, np.int64), up])
    for i in range(step, len(out)):
        left, over, corner = out[i - step], above[i], above[i - step]
        if kind == 3:
            guess = (left + over) // 2
        else:
            p = left + over - corner
            guess = min((abs(p - left), 0, left), (abs(p - over), 1, over), (abs(p - corner), 2, corner))[2]
        out[i] = (cur[i - step] + guess) & 255
    return out[step:].astype(np.uint8)


def encode(a: np.ndarray, texts: dict[str, str] | None = None) -> bytes:
    """Lossless, without filters; grey, RGB or RGBA of 8 bits."""
    a = np.ascontiguousarray(a, np.uint8)
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, c = a.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1).tobytes()
    extra = b"".join(chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode()) for k, v in (texts or {}).items())
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def load(data: bytes | None, min_side: int | None = None, most_padding: float = 0.5) -> tuple[np.ndarray | None, str]:
    """(RGB raster, status) of a file: ok, recovered_truncated, too_small, mostly_padding or failed; never raises."""
    from ..functions.rasters import constant_rows

    a, status = decode(data or b"")
    if a is None:
        return None, status
    a = to_rgb(a)
    if status == "recovered_truncated" and constant_rows(a) > most_padding:
        return None, "mostly_padding"
    if min_side is not None and min(a.shape[:2]) < min_side:
        return a, "too_small"
    return a, status


# --- JPEG metadata


def segments(data: bytes) -> list[tuple[int, bytes]]:
    """(marker, body) of the segments before the scan."""
    out, i = [], 2
    if not data.startswith(b"\xff\xd8"):
        return out
    while i + 4 <= len(data) and data[i] == 0xFF:
        marker = data[i + 1]
        if marker in (0xD9, 0xDA):
            break
        n = int.from_bytes(data[i + 2 : i + 4], "big")
        out.append((marker, data[i + 4 : i + 2 + n]))
        i += 2 + n
    return out


def luma_table(data: bytes) -> np.ndarray | None:
    for marker, body in segments(data):
        if marker == 0xDB and len(body) >= 65 and body[0] & 15 == 0:
            wide = body[0] >> 4
            values = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
            out = np.zeros(64, np.int64)
            out[ZIGZAG] = values[:64]
            return out.reshape(8, 8)
    return None


def jpeg_quality(data: bytes) -> int | None:
    """The quality whose standard luminance table is nearest to the file's."""
    table = luma_table(data)
    return None if table is None else min(range(1, 101), key=lambda q: (int(np.abs(quant_table(LUMA, q) - table).sum()), q))


def exif_orientation(data: bytes) -> int | None:
    for marker, body in segments(data):
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            t = body[6:]
            end = "<" if t[:2] == b"II" else ">"
            try:
                at = struct.unpack(end + "I", t[4:8])[0]
                for k in range(struct.unpack(end + "H", t[at : at + 2])[0]):
                    tag, _, _, value = struct.unpack(end + "HHIH", t[at + 2 + 12 * k : at + 12 + 12 * k])
                    if tag == 274:
                        return value
            except struct.error:
                return None
    return None


#: Keywords of metadata under which generators leave their settings.
GENERATOR_KEYS = (
    "parameters", "workflow", "prompt", "software", "comment", "description",
    "sd-metadata", "dream", "invokeai", "generation_data", "negative_prompt",
    "model", "sampler", "steps", "cfg_scale", "seed", "xmp", "usercomment",
)
#: Names of tools and their settings in texts.
TOOL_MARKERS = (
    "stable diffusion", "stable-diffusion", "comfyui", "automatic1111", "a1111",
    "invokeai", "midjourney", "dall-e", "dalle", "novelai", "sdxl", "flux",
    "civitai", "lora", "denoising strength", "negative prompt", "cfg scale",
)
#: Markers of the frame headers of JPEG files, baseline and progressive.
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)


def shape(data: bytes) -> tuple[int, int, str]:
    """(width, height, status) by a file's headers, without decoding: ok, recovered_truncated or failed."""
    parts, marks = chunks(data), segments(data)
    if parts and parts[0][0] == b"IHDR" and len(parts[0][1]) >= 8 and any(k == b"IDAT" for k, _, _ in parts):
        w, h = struct.unpack(">II", parts[0][1][:8])
        return w, h, "ok" if parts[-1][0] == b"IEND" else "recovered_truncated"
    for marker, body in marks:
        if marker in FRAMES and len(body) >= 5:
            h, w = struct.unpack(">HH", body[1:5])
            return w, h, "ok" if data.rstrip(b"\0").endswith(b"\xff\xd9") else "recovered_truncated"
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h), "ok" if len(data) >= int.from_bytes(data[2:6], "little") else "recovered_truncated"
    return 0, 0, "failed"


def probe(data: bytes | None) -> dict:
    """What a file tells about itself."""
    data = data or b""
    texts, marks = text_chunks(data), segments(data)
    comments = [b.decode("latin-1", "replace") for m, b in marks if m == 0xFE]
    width, height, status = shape(data)
    blob = " ".join([*list(texts.values())[:12], *comments]).lower()
    keys = {x.lower() for x in texts} | ({"comment"} if comments else set())
    return {
        "n_bytes": len(data),
        "status": status,
        "width": width,
        "height": height,
        "n_text_chunks": len(texts),
        "metadata_keys": ",".join(sorted(keys & set(GENERATOR_KEYS)))[:200],
        "generator_marker": ",".join(m for m in TOOL_MARKERS if m in blob)[:200],
        "has_exif": any(m == 0xE1 and b.startswith(b"Exif") for m, b in marks) or any(k == b"eXIf" for k, _, _ in chunks(data)),
        "has_icc": any(m == 0xE2 and b.startswith(b"ICC_PROFILE") for m, b in marks) or any(k == b"iCCP" for k, _, _ in chunks(data)),
        "exif_orientation": exif_orientation(data),
        "jpeg_quality": jpeg_quality(data),
    }
