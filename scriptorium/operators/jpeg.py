"""Baseline JPEG (8 bits, Huffman codes, any subsampling, restarts) to pixels. Progressive files are an error."""

from __future__ import annotations

import struct

import numpy as np

#: The k-th coefficient's place in a block: along the diagonals, up and down by turns.
ZIGZAG = np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_WAVES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """By the next 16 bits: length of the code that they begin with, and its symbol."""
    out: list = [None] * 65536
    code = at = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = [(length, symbols[at])] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    """The bits of one stretch between restarts; zeros follow its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 8]
        self.at += 8
        self.held = (self.held << 64) | int.from_bytes(part.ljust(8, b"\0"), "big")
        self.n += 64

    def symbol(self, codes: list) -> int:
        if self.n < 16:
            self.fill()
        found = codes[(self.held >> (self.n - 16)) & 0xFFFF]
        if found is None:
            raise ValueError("broken JPEG")
        self.n -= found[0]
        self.held &= (1 << self.n) - 1
        return found[1]

    def value(self, size: int) -> int:
        """A number of so many bits; those that begin with 0 are negative."""
        if not size:
            return 0
        if self.n < size:
            self.fill()
        self.n -= size
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1


def _stretches(data: bytes) -> list[bytes]:
    """Coded data up to the next marker, split at restarts, without stuffed bytes."""
    out, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        kind = data[at + 1]
        if kind == 0 or kind == 0xFF:
            at += 2 - (kind == 0xFF)
        elif 0xD0 <= kind <= 0xD7:
            out.append(data[start:at])
            at = start = at + 2
        else:
            break
    end = at if at >= 0 else len(data)
    return [x.replace(b"\xff\x00", b"\xff") for x in [*out, data[start:end]]]


def decode_jpeg(data: bytes) -> np.ndarray:
    """Height x width for grey images, else height x width x 3."""
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, list] = {}
    parts: list[tuple[int, int, int, int]] = []
    width = height = restart = 0
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("broken JPEG")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or n not in (1, 3):
                raise ValueError("only JPEG of 8 bits, grey or in three colours")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            if len(tables) != len(parts):
                raise ValueError("only JPEG of one scan")
            return _pixels(_stretches(data[at:]), parts, tables, quant, codes, width, height, restart)
    raise ValueError("broken JPEG")


def _pixels(stretches, parts, tables, quant, codes, width, height, restart) -> np.ndarray:
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    planes = [np.zeros((down * v, across * h, 64)) for _, h, v, _ in parts]
    units, stretch = across * down, iter(stretches)
    bits, before = None, [0] * len(parts)
    for unit in range(units):
        if bits is None or restart and unit % restart == 0:
            bits, before = _Bits(next(stretch)), [0] * len(parts)
        row, column = divmod(unit, across)
        for k, (name, h, v, _) in enumerate(parts):
            dc, ac = codes[tables[name] >> 4], codes[16 | tables[name] & 15]
            for y in range(v):
                for x in range(h):
                    block = planes[k][row * v + y, column * h + x]
                    before[k] += bits.value(bits.symbol(dc))
                    block[0] = before[k]
                    i = 1
                    while i < 64:
                        s = bits.symbol(ac)
                        if not s:
                            break
                        i += s >> 4
                        if s & 15:
                            if i > 63:
                                raise ValueError("broken JPEG")
                            block[i] = bits.value(s & 15)
                        i += 1
    out = []
    for plane, (_, h, v, q) in zip(planes, parts, strict=True):
        blocks = np.zeros_like(plane)
        blocks[..., ZIGZAG] = plane * quant[q]
        pixels = _WAVES.T @ blocks.reshape(*plane.shape[:2], 8, 8) @ _WAVES + 128
        pixels = pixels.transpose(0, 2, 1, 3).reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        out.append(pixels.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)[:height, :width])
    if len(out) == 1:
        return np.clip(np.rint(out[0]), 0, 255).astype(np.uint8)
    y, cb, cr = out[0], out[1] - 128, out[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
