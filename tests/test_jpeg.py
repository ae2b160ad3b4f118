"""Pixels of JPEG files that a small encoder wrote."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from scriptorium.operators import images, jpeg


def _huffman(symbols: list[int], length: int) -> tuple[bytes, dict[int, str]]:
    """A table of codes of one length, and the codes."""
    counts = bytes(len(symbols) if k == length else 0 for k in range(1, 17))
    return counts + bytes(symbols), {s: format(i, f"0{length}b") for i, s in enumerate(symbols)}


_DC, DC = _huffman(list(range(12)), 4)
_AC, AC = _huffman([r << 4 | s for r in range(16) for s in range(11) if s or r in (0, 15)], 8)


def _number(v: int) -> tuple[int, str]:
    size = abs(v).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def _encode(planes: list[tuple[np.ndarray, int, int]], width: int, height: int, step: int, restart: int = 0) -> bytes:
    """planes: of whole units, with their sampling."""
    most_h, most_v = max(p[1] for p in planes), max(p[2] for p in planes)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    stretches, bits, before = [], "", [0] * len(planes)

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        stretches.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b"")
        bits = ""

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            flush()
            before = [0] * len(planes)
        row, column = divmod(unit, across)
        for k, (p, h, v) in enumerate(planes):
            for y in range(v):
                for x in range(h):
                    a, b = (row * v + y) * 8, (column * h + x) * 8
                    c = np.rint(jpeg._WAVES @ (p[a : a + 8, b : b + 8] - 128.0) @ jpeg._WAVES.T / step).astype(int).reshape(64)[jpeg.ZIGZAG]
                    size, text = _number(int(c[0]) - before[k])
                    before[k] = int(c[0])
                    bits += DC[size] + text
                    run = 0
                    last = max(np.flatnonzero(c[1:]) + 1, default=0)
                    for i in range(1, last + 1):
                        if not c[i]:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + AC[0xF0], run - 16
                        size, text = _number(int(c[i]))
                        bits, run = bits + AC[run << 4 | size] + text, 0
                    if last < 63:
                        bits += AC[0]
    flush()
    data = b"".join(x + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(stretches) else b"") for k, x in enumerate(stretches))
    frame = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (_, h, v) in enumerate(planes))
    scan = bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + b"\0\x3f\0"
    more = segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + bytes([step] * 64)) + segment(0xC4, b"\x00" + _DC) + segment(0xC4, b"\x10" + _AC) + segment(0xC0, frame) + more + segment(0xDA, scan) + data + b"\xff\xd9"


def _smooth(height: int, width: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    return np.clip(128 + 60 * np.sin(x / rng.uniform(4, 9)) + 50 * np.cos(y / rng.uniform(4, 9)) + rng.normal(0, 4, (height, width)), 0, 255)


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_grey(restart):
    page = _smooth(24, 40, 1)
    got = images.decode(_encode([(page, 1, 1)], 37, 21, 1, restart))
    assert got.shape == (21, 37) and np.abs(got - page[:21, :37]).max() <= 3


@pytest.mark.parametrize(("h", "v"), [(1, 1), (2, 1), (2, 2)])
def test_colour(h, v):
    y = _smooth(32, 48, 2)
    cb, cr = (np.full((32 // v, 48 // h), c, float) for c in (100, 150))
    got = images.decode(_encode([(y, h, v), (cb, 1, 1), (cr, 1, 1)], 45, 30, 1)).astype(float)
    want = np.stack([y + 1.402 * 22, y + 0.344136 * 28 - 0.714136 * 22, y - 1.772 * 28], axis=-1)
    assert got.shape == (30, 45, 3) and np.abs(got - np.clip(want, 0, 255)[:30, :45]).max() <= 4


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_other_files():
    data = _encode([(_smooth(8, 8, 3), 1, 1)], 8, 8, 1)
    with pytest.raises(ValueError, match="only baseline"):
        images.decode(data.replace(b"\xff\xc0", b"\xff\xc2"))
    with pytest.raises(ValueError, match="JPEG"):
        images.decode(data[: data.index(b"\xff\xda")])
    with pytest.raises(ValueError, match="neither"):
        images.decode(b"GIF89a")
