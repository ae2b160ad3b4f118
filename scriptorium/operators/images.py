"""Image kernels in numpy over images as binary columns: decode, grey, deskew, denoise, contrast, sharpen, crop, boxes.

Each image is a row; steps run inside one Arrow UDF, so a page crosses to Python once however many steps it takes.
PNG (grey, RGB, with alpha or a palette, of 1 to 16 bits, not interlaced), baseline JPEG and binary PGM/PPM are read; 8-bit PNG is written."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import decode_jpeg

STEPS = ("grayscale", "deskew", "denoise", "contrast", "sharpen")
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def decode(data: bytes) -> np.ndarray:
    """Height x width, or height x width x 3."""
    if data[:2] in (b"P5", b"P6"):
        head = data.split(maxsplit=3)
        width, height = int(head[1]), int(head[2])
        rest = head[3].split(maxsplit=1)[0]
        depth = 3 if data[:2] == b"P6" else 1
        pixels = np.frombuffer(data, np.uint8, width * height * depth, len(data) - width * height * depth)
        assert int(rest) == 255
        return pixels.reshape((height, width, 3) if depth == 3 else (height, width))
    if data[:3] == b"\xff\xd8\xff":
        return decode_jpeg(data)
    if data[:8] != _SIGNATURE:
        raise ValueError("neither PNG nor JPEG nor PGM/PPM")
    at, body, palette, width, height, depth, bits, colour = 8, b"", None, 0, 0, 1, 8, 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if interlaced or colour not in (0, 2, 3, 4, 6):
                raise ValueError("only PNG without interlacing")
            depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    values = bits * depth  # bits of a pixel
    out = _unfiltered(zlib.decompress(body), height, -(-width * values // 8), max(values // 8, 1))
    if bits == 16:
        out = out[:, ::2]
    elif bits < 8:
        out = np.unpackbits(out, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])
        out = out[:, :width]
        out = (out if colour == 3 else out * (255 // ((1 << bits) - 1))).astype(np.uint8)
    if colour == 3:
        return palette[out]
    image = out.reshape(height, width, depth)
    return image[:, :, 0] if depth < 3 else image[:, :, :3]


def _unfiltered(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """The rows of a PNG without their filters. step: bytes of a pixel."""
    raw = np.frombuffer(data, np.uint8).reshape(height, 1 + stride)
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        kind, row = raw[y, 0], raw[y, 1:]
        if kind == 0:
            out[y] = row
        elif kind == 2:
            out[y] = row + above
        elif kind == 1:
            out[y] = np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        else:
            line = [0] * stride
            up = above.tolist()
            for x, v in enumerate(row.tolist()):
                a = line[x - step] if x >= step else 0
                if kind == 3:
                    line[x] = (v + (a + up[x]) // 2) & 255
                else:
                    c = up[x - step] if x >= step else 0
                    p = a + up[x] - c
                    near = min((abs(p - a), 0, a), (abs(p - up[x]), 1, up[x]), (abs(p - c), 2, c))
                    line[x] = (v + near[2]) & 255
            out[y] = line
        above = out[y]
    return out


def encode(image: np.ndarray) -> bytes:
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    rows = np.zeros((height, 1 + image[0].size if height else 1), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def grayscale(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.rint(image[..., 0] * 0.299 + image[..., 1] * 0.587 + image[..., 2] * 0.114).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold of least variance within the two classes."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    low = np.cumsum(n)
    mass = np.cumsum(n * np.arange(256))
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (mass / low - (mass[-1] - mass) / high) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def skew_angle(image: np.ndarray, most: float = 15.0, step: float = 0.1) -> float:
    """The angle in degrees at which the rows of ink are sharpest: by the variance of projections of ink pixels."""
    y, x = np.nonzero(image <= otsu(image))
    if len(y) < 2:
        return 0.0
    if len(y) > 200_000:  # evenly thinned: the angle is a statistic of the whole page
        y, x = y[:: len(y) // 200_000 + 1], x[:: len(x) // 200_000 + 1]

    def sharpness(angle: float) -> float:
        t = np.deg2rad(angle)
        rows = np.rint(y * np.cos(t) - x * np.sin(t)).astype(int)
        n = np.bincount(rows - rows.min())
        return float((n.astype(float) ** 2).sum())

    coarse = max(np.arange(-most, most + 1e-9, 1.0), key=sharpness)
    return float(round(max(np.arange(coarse - 1, coarse + 1 + 1e-9, step), key=sharpness), 6))


def rotate(image: np.ndarray, angle: float, fill: int = 255) -> np.ndarray:
    """Turned about the middle, bilinear, on a white ground."""
    h, w = image.shape[:2]
    t = np.deg2rad(angle)
    yy, xx = np.mgrid[0:h, 0:w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.cos(t) * (xx - cx) - np.sin(t) * (yy - cy) + cx
    sy = np.sin(t) * (xx - cx) + np.cos(t) * (yy - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    padded = np.pad(image.astype(float), ((1, 2), (1, 2)), constant_values=fill)
    inside = (x0 >= -1) & (x0 < w) & (y0 >= -1) & (y0 < h)
    x0, y0, fx, fy = np.clip(x0, -1, w) + 1, np.clip(y0, -1, h) + 1, sx - np.floor(sx), sy - np.floor(sy)
    out = (padded[y0, x0] * (1 - fx) + padded[y0, x0 + 1] * fx) * (1 - fy) + (padded[y0 + 1, x0] * (1 - fx) + padded[y0 + 1, x0 + 1] * fx) * fy
    return np.where(inside, np.rint(out), fill).astype(np.uint8)


def deskew(image: np.ndarray, least: float = 0.5) -> np.ndarray:
    angle = skew_angle(image)
    return rotate(image, angle) if abs(angle) > least else image


def denoise(image: np.ndarray, diameter: int = 5, sigma_colour: float = 75.0, sigma_space: float = 75.0) -> np.ndarray:
    """A bilateral filter."""
    r = diameter // 2
    src = image.astype(np.float32)
    padded = np.pad(src, r, mode="reflect" if min(src.shape) > r else "edge")
    total, weight = np.zeros_like(src), np.zeros_like(src)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dx * dx + dy * dy > r * r:
                continue
            near = padded[r + dy : r + dy + src.shape[0], r + dx : r + dx + src.shape[1]]
            w = np.exp(-((near - src) ** 2) / (2 * sigma_colour**2) - (dx * dx + dy * dy) / (2 * sigma_space**2))
            total += near * w
            weight += w
    return np.rint(total / weight).astype(np.uint8)


def contrast(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalisation over a grid of tiles, interpolated between them."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if h > tiles and w > tiles else "edge")
    maps = np.zeros((tiles, tiles, 256))
    limit = max(int(clip * th * tw / 256), 1)
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            n[: over % 256] += 1
            maps[i, j] = np.cumsum(n) * 255.0 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    a, b = (np.clip(v, 0, tiles - 1)[:, None] for v in (y0, y0 + 1))
    c, d = (np.clip(v, 0, tiles - 1)[None, :] for v in (x0, x0 + 1))
    out = (maps[a, c, image] * (1 - fx) + maps[a, d, image] * fx) * (1 - fy) + (maps[b, c, image] * (1 - fx) + maps[b, d, image] * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    r = int(round(sigma * 4))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    out = image.astype(float)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        out = sum(k[i] * np.take(padded, np.arange(i, i + out.shape[axis]), axis=axis) for i in range(2 * r + 1))
    return out


def sharpen(image: np.ndarray, amount: float = 0.5, sigma: float = 2.0) -> np.ndarray:
    """Unsharp masking."""
    return np.clip(np.rint((1 + amount) * image.astype(float) - amount * blur(image, sigma)), 0, 255).astype(np.uint8)


def crop(image: np.ndarray, box: Sequence[int]) -> np.ndarray:
    x0, y0, x1, y1 = box
    return image[max(y0, 0) : max(y1, 0), max(x0, 0) : max(x1, 0)]


def draw_boxes(image: np.ndarray, boxes: Sequence[Sequence[int]], colour: Sequence[int] = (255, 0, 0), thickness: int = 2) -> np.ndarray:
    out = np.stack([image] * 3, axis=-1) if image.ndim == 2 else image.copy()
    for x0, y0, x1, y1 in boxes:
        for k in range(thickness):
            out[max(y0 + k, 0) : y1 - k, [min(max(x0 + k, 0), out.shape[1] - 1), min(max(x1 - 1 - k, 0), out.shape[1] - 1)]] = colour
            out[[min(max(y0 + k, 0), out.shape[0] - 1), min(max(y1 - 1 - k, 0), out.shape[0] - 1)], max(x0 + k, 0) : x1 - k] = colour
    return out


#: Letters of 3 x 5 pixels: five rows, each an octal digit.
_GLYPHS = dict(
    pair.split(":")
    for pair in "a:25755 b:65656 c:34443 d:65556 e:74647 f:74644 g:34553 h:55755 i:72227 j:11152 k:55655 l:44447 m:57755 n:65555 o:25552 p:65644 q:25563 r:65655 s:34216 t:72222 u:55557 v:55552 w:55775 x:55255 y:55222 z:71247 0:75557 1:26227 2:71747 3:71317 4:55711 5:74717 6:74757 7:71122 8:75757 9:75717 _:00007 -:00700 [:64446 ]:31113".split()
)


def write_label(image: np.ndarray, text: str, x: int, y: int, colour: Sequence[int], size: int = 2) -> np.ndarray:
    """text in white on a filled box of the colour, whose lower left corner is x, y. What isn't in the image is cut off."""
    rows = np.zeros((7, 4 * len(text) + 1), bool)
    for k, c in enumerate(text.lower()):
        for i, digit in enumerate(_GLYPHS.get(c, "00000")):
            rows[1 + i, 1 + 4 * k : 4 + 4 * k] = [int(digit) >> b & 1 for b in (2, 1, 0)]
    rows = rows.repeat(size, axis=0).repeat(size, axis=1)
    out = image.copy()
    top, left = max(y - rows.shape[0], 0), max(x, 0)
    place = out[top : top + rows.shape[0], left : left + rows.shape[1]]
    part = rows[: place.shape[0], : place.shape[1]]
    place[:] = np.where(part[:, :, None], 255, np.array(colour, np.uint8))
    return out


def preprocess(image: np.ndarray, steps: Sequence[str] = STEPS) -> np.ndarray:
    """The steps in their fixed order, always after greying."""
    kernels = {"deskew": deskew, "denoise": denoise, "contrast": contrast, "sharpen": sharpen}
    if unknown := set(steps) - set(STEPS):
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
    out = grayscale(image)
    for name in STEPS[1:]:
        if name in steps:
            out = kernels[name](out)
    return out


def variants() -> list[tuple[str, tuple[str, ...]]]:
    """The grey baseline, each single step, and all of them."""
    return [("baseline_grayscale", ("grayscale",)), *((f"{s}_only", ("grayscale", s)) for s in STEPS[1:]), ("all_steps", STEPS)]


def preprocessed(images: DataFrame, plans: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """images (name, content) once for each plan (variant, steps): variant, name, content as PNG, width, height, error."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.struct([("content", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("error", pa.string())])
        for content, steps in batches:
            out = []
            for c, s in zip(content.to_pylist(), steps.to_pylist(), strict=True):
                try:
                    made = preprocess(decode(c), s)
                    out.append({"content": encode(made), "width": made.shape[1], "height": made.shape[0], "error": None})
                except Exception as e:  # an unreadable image must not end the job
                    out.append({"content": None, "width": None, "height": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.array(*map(F.lit, s)).alias("steps")) for v, s in plans)))
    rows = images.select("name", "content", each.alias("v")).select("name", "content", "v.*")
    made = F.arrow_udf(run, "content binary, width int, height int, error string")("content", "steps")
    return rows.select("variant", F.concat(F.lit("preprocessed_"), "name").alias("name"), made.alias("m")).select("variant", "name", "m.*")


def cropped(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """images (page, content) and boxes (page, name, box of four whole numbers): name and content of each crop."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for content, box in batches:
            yield pa.array([encode(crop(decode(c), b)) for c, b in zip(content.to_pylist(), box.to_pylist(), strict=True)], pa.binary())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return boxes.join(images, "page").select("page", "name", F.arrow_udf(run, "binary")("content", "box").alias("content"))
