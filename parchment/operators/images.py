"""Image steps on (path, height, width, channels, content) rows: pixels are bytes, worked on in Arrow batches.

Only numpy is used, so contrast, smoothing and thresholds follow the published definitions and need not equal a
native library bit for bit; cropping is exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

COLUMNS = "path string, height int, width int, channels int, content binary"
#: Bytes of pixels that Spark hands to Python at a time, an image at least.
BATCH_BYTES = 8 << 20


def gray(image: np.ndarray) -> np.ndarray:
    """Blue, green, red to luminance."""
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3] @ np.array([0.114, 0.587, 0.299])).clip(0, 255).astype(np.uint8)


def upscale(image: np.ndarray, width: int = 1000) -> np.ndarray:
    """Images narrower than `width` grow to it by bicubic interpolation; heights are truncated."""
    h, w = image.shape[:2]
    if w >= width or not w:
        return image
    return resized(image, int(h * (width / w)), int(w * (width / w)))


def _cubic(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    x = (np.arange(m) + 0.5) * n / m - 0.5
    base, t = np.floor(x).astype(int), x - np.floor(x)
    d = np.abs(np.stack([t + 1, t, 1 - t, 2 - t]))
    a = -0.75
    weight = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, a * (d**3 - 5 * d**2 + 8 * d - 4))
    return np.clip(base[None] + np.arange(-1, 3)[:, None], 0, n - 1), weight


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    (rows, a), (cols, b) = _cubic(image.shape[0], height), _cubic(image.shape[1], width)
    tall = sum(image[rows[k]].astype(np.float32) * a[k][:, None] for k in range(4))
    return np.rint(sum(tall[:, cols[k]] * b[k] for k in range(4))).clip(0, 255).astype(np.uint8)


def clahe(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: clipped tile histograms, bilinear between tiles."""
    h, w = image.shape
    th, tw = max(1, -(-h // tiles)), max(1, -(-w // tiles))
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    maps = np.empty((tiles, tiles, 256), np.float32)
    limit = max(1, int(clip * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(counts - limit, 0).sum()
            counts = np.minimum(counts, limit) + over // 256
            counts[: over % 256] += 1
            maps[i, j] = np.cumsum(counts) * 255 / (th * tw)
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, tiles - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda r, c: maps.reshape(-1).take(((r * tiles)[:, None] + c) * 256 + image)
    return np.rint((at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy).clip(0, 255).astype(np.uint8)


#: Pixels that non-local means works on at a time, in whole rows.
CELLS = 1 << 16
#: Numbers that other steps work on at a time.
RUN = 1 << 13
#: How near to a half a pixel is to be made again, and how many of these at a time.
HALF, MANY = 1e-3, 1 << 12


def _sums(values: np.ndarray, size: int, step: int, out: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of each `size` (odd) values that stand `step` apart, by sums of 1, 2, 4, ... values; out and held are as long as values."""
    n = values.size - (size - 1) * step
    found, now, many, at = values[:n], values, 1, 1
    while size := size >> 1:
        k = now.size - many * step
        now, many = np.add(now[:k], now[many * step :], out=held[many.bit_length() & 1][:k]), 2 * many
        if size & 1:
            found = np.add(found, now[at * step :][:n], out=out[:n])
            at += many
    return found


def denoise(image: np.ndarray, strength: float = 10, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: shifts over the search window weighted by the mean squared difference of patches.

    Rows with their margins are one run of numbers, so that a shift is another place to begin and a step is one pass over
    what lies in order; the margins' own results aren't used. Sums over patches are of whole numbers, which single
    precision holds exactly; weights have single precision and are summed in double, a row of shifts at a time, which is
    right to 0.001 of a level. Pixels that are so near to a half are made again in double precision.
    """
    (h, w), r, pad = image.shape, search // 2, patch // 2
    margin = max(r, pad)
    padded = np.pad(np.pad(image, r, mode="reflect" if min(image.shape) > r else "edge"), margin - r, mode="edge")
    wide, values = w + 2 * margin, np.pad(padded.ravel(), r).astype(np.float32)
    scale = np.float32(-1 / (patch**2 * strength**2))
    begin = lambda row: r + (margin + row) * wide
    out, rows = np.empty((h, w), np.uint8), max(1, CELLS // wide)
    for top in range(0, h, rows):
        n = min(rows, h - top)
        low, high = max(0, top - pad), min(h, top + n + pad)  # of the rows whose differences are needed those inside
        above, below = low - (top - pad), top + n + pad - high
        square = np.empty((n + 2 * pad, wide), np.float32)
        inside = square[above : above + high - low]
        line, (down, across, *held) = inside.reshape(-1), (np.empty(square.size, np.float32) for _ in range(4))
        here, weight = values[begin(low) :][: line.size], np.zeros(n * wide, np.float32)
        total, weights = np.zeros(n * wide), np.zeros(n * wide)
        for dy in range(-r, search - r):
            some, some_weights = np.zeros(n * wide, np.float32), np.zeros(n * wide, np.float32)
            for dx in range(-r, search - r):
                shift = dy * wide + dx
                np.subtract(here, values[begin(low) + shift :][: line.size], out=line)
                np.multiply(line, line, out=line)
                inside[:, margin - pad : margin], inside[:, margin + w : margin + w + pad] = inside[:, margin : margin + 1], inside[:, margin + w - 1 : margin + w]
                square[:above], square[above + high - low :] = inside[:1], inside[-1:]
                sums = _sums(_sums(square.reshape(-1), patch, wide, down, held), patch, 1, across, held)
                middle = weight[pad : weight.size - pad]
                np.exp(np.multiply(sums, scale, out=middle), out=middle)
                some_weights += weight
                weight *= values[begin(top) + shift :][: weight.size]
                some += weight
            total += some
            weights += some_weights
        cut = lambda x: x.reshape(-1, wide)[:, margin : margin + w]
        found = cut(total) / cut(weights)
        out[top : top + n] = np.rint(found).clip(0, 255)
        y, x = np.nonzero(np.abs(found - np.floor(found) - 0.5) < HALF)
        for i in range(0, len(y), MANY):
            out[top + y[i : i + MANY], x[i : i + MANY]] = _denoised(values, (h, w), top + y[i : i + MANY], x[i : i + MANY], strength, patch, search)
    return out


def _denoised(values: np.ndarray, shape: tuple[int, int], y: np.ndarray, x: np.ndarray, strength: float, patch: int, search: int) -> np.ndarray:
    """Some pixels of denoise in double precision; values are the padded image in a run, as there."""
    (h, w), r, pad = shape, search // 2, patch // 2
    margin, wide = max(r, pad), w + 2 * max(r, pad)
    place = lambda j, i: r + (margin + j) * wide + margin + i
    near = np.arange(-pad, patch - pad)
    at = place(np.clip(y[:, None] + near, 0, h - 1)[:, :, None], np.clip(x[:, None] + near, 0, w - 1)[:, None]).reshape(len(y), -1)
    here, middle = values[at], place(y, x)
    total, weights = np.zeros(len(y)), np.zeros(len(y))
    for shift in (dy * wide + dx for dy in range(-r, search - r) for dx in range(-r, search - r)):
        apart = here - values[at + shift]
        weight = np.exp(np.einsum("ij,ij->i", apart, apart).astype(np.float64) / -(patch**2) / strength**2)
        weights += weight
        total += weight * values[middle + shift]
    return np.rint(total / weights).clip(0, 255)


def _gauss(image: np.ndarray, size: int, mode: str = "edge") -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(image, size // 2, mode=mode)
    out, rows = np.empty(image.shape), max(1, RUN // max(1, p.shape[1]))
    for top in range(0, len(out), rows):  # a few rows at a time stay near the processor
        out[top : top + rows] = _weighted(_weighted(p[top : top + rows + size - 1].astype(np.float64), k, 0), k, 1)
    return out


def _weighted(image: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Sums of the rows (axis 0) or columns that follow one another, weighted, added in order."""
    n = image.shape[axis] - len(weights) + 1
    at = lambda i: image[i : i + n] if axis == 0 else image[:, i : i + n]
    out = weights[0] * at(0)
    part = np.empty_like(out)
    for i in range(1, len(weights)):
        out += np.multiply(weights[i], at(i), out=part)
    return out


def adaptive_threshold(image: np.ndarray, size: int, offset: float) -> np.ndarray:
    return np.where(image > _gauss(image, size) - offset, 255, 0).astype(np.uint8)


def erode(image: np.ndarray) -> np.ndarray:
    """The minimum under a 2x2 kernel whose ellipse is the lower row and the upper right pixel."""
    p = np.pad(image, ((1, 0), (1, 0)), constant_values=255)
    return np.minimum(np.minimum(p[1:, :-1], p[1:, 1:]), p[:-1, 1:])


def dilate(image: np.ndarray) -> np.ndarray:
    p = np.pad(image, ((1, 0), (1, 0)), constant_values=0)
    return np.maximum(np.maximum(p[1:, :-1], p[1:, 1:]), p[:-1, 1:])


def median3(image: np.ndarray) -> np.ndarray:
    p = np.pad(image, 1, mode="edge")
    return np.median(np.stack([p[i : i + image.shape[0], j : j + image.shape[1]] for i in range(3) for j in range(3)]), 0).astype(np.uint8)


#: Fixed values of the angle's search: edge thresholds, votes a line needs, angles that count, the least that is turned.
EDGE_LOW, EDGE_HIGH = 50, 150
LINE_VOTES = 100
WIDEST, LEAST_TURN = 30, 2.0
#: tan(22.5 degrees) and tan(67.5 degrees) part the directions of gradients.
FLAT, STEEP = np.sqrt(2) - 1, np.sqrt(2) + 1


def blurred(image: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur with mirrored borders, rounded."""
    pad = size // 2
    mode = "reflect" if min(image.shape) > pad else "symmetric"
    return np.rint(_gauss(image, size, mode)).clip(0, 255).astype(np.uint8)


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives (3 x 3) along x and y, borders repeated."""
    p = np.pad(image.astype(np.int32), 1, mode="edge")
    smooth_y, smooth_x = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]


def thinned(dx: np.ndarray, dy: np.ndarray, least: int = 0) -> np.ndarray:
    """|dx| + |dy| where it is above `least` and a maximum across the edge: above the one neighbour, not below the other; else 0.

    The neighbours are those along the gradient's direction of the four. Outside the image it is 0. Only pixels above
    `least`, of which a page has few, are compared.
    """
    size = np.abs(dx) + np.abs(dy)
    wide, rim = size.shape[1] + 2, np.pad(size, 1).reshape(-1)
    place = np.flatnonzero(size > max(least, 0))
    here, dx, dy = size.reshape(-1)[place], dx.reshape(-1)[place], dy.reshape(-1)[place]
    middle = place + place // size.shape[1] * 2 + wide + 1
    ax, ay = np.abs(dx), np.abs(dy)
    level, upright, falling = ay < ax * FLAT, ay > ax * STEEP, (dx < 0) != (dy < 0)
    one = np.where(level, -1, np.where(upright, -wide, np.where(falling, 1 - wide, -1 - wide)))
    first, second = here > rim[middle + one], rim[middle - one]
    highest = first & ((here > second) | ((level | upright) & (here == second)))
    out = np.zeros(size.size, size.dtype)
    out[place[highest]] = here[highest]
    return out.reshape(size.shape)


def components(mask: np.ndarray) -> np.ndarray:
    """A number for each set pixel, the same for those that touch, also by a corner; -1 elsewhere.

    Links between neighbours are contracted: each round every root takes the least root that it is linked to, then paths
    are halved, so that rounds grow with the logarithm of a component's size, not with its length.
    """
    wide, place = mask.shape[1] + 2, np.flatnonzero(mask)
    rim = np.full((mask.shape[0] + 2) * wide, -1)
    middle = place + (place // mask.shape[1] * 2 if len(place) else 0) + wide + 1
    rim[middle] = own = np.arange(len(place))
    links = []
    for step in (1, wide, wide + 1, wide - 1):
        other = rim[middle + step]
        near = other >= 0
        links.append(np.stack([own[near], other[near]]))
    a, b = np.concatenate(links, 1)
    up = np.arange(len(place))
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        np.minimum.at(up, high, low)
        while (up != up[up]).any():
            up = up[up]
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    number = np.full(mask.size, -1)
    number[place] = up
    return number.reshape(mask.shape)


def edges(image: np.ndarray, low: int = EDGE_LOW, high: int = EDGE_HIGH) -> np.ndarray:
    """Thinned edges above `low` in components that have one above `high` (hysteresis)."""
    size = thinned(*gradients(image), low)
    number = components(size > low)
    strong = np.zeros(size.size + 1, bool)
    strong[number[size > high]] = True
    return (number >= 0) & strong[number]


def line_angles(edge: np.ndarray, votes: int = LINE_VOTES) -> list[int]:
    """The normals' angles, in whole degrees from 0 to 179, of the straight lines on which more than `votes` edge points lie.

    A line is a maximum of the count over distance (a pixel) and angle (a degree): above the neighbour before, not below
    the one after, in both. A line that is there once is found once, not with all angles that are nearly its own.
    """
    y, x = np.nonzero(edge)
    h, w = edge.shape
    middle = h + w
    wide = 2 * middle + 3
    count = np.zeros((182, wide), np.int64)
    x, y, some = x.astype(np.float64), y.astype(np.float64), max(1, 2 * RUN // max(1, len(x)))
    for start in range(0, 180, some):
        t = np.deg2rad(np.arange(start, min(start + some, 180)))[:, None]
        at = x * np.cos(t)
        at += y * np.sin(t)
        at = np.rint(at, out=at).astype(int)
        at += np.arange(len(t))[:, None] * wide + middle + 1
        count[start + 1 : start + 1 + len(t)] = np.bincount(at.reshape(-1), minlength=len(t) * wide).reshape(-1, wide)
    many = count.reshape(-1)
    place = wide + np.flatnonzero(count[1:-1] > votes)
    place = place[(place % wide > 0) & (place % wide < wide - 1)]
    here = many[place]
    peak = (here > many[place - 1]) & (here >= many[place + 1]) & (here > many[place - wide]) & (here >= many[place + wide])
    return (place[peak] // wide - 1).tolist()


def skew_angle(image: np.ndarray) -> float:
    """The angle to turn by: less the median angle of the strong lines whose normals are within WIDEST degrees of the
    horizontal; 0 without such lines and under LEAST_TURN degrees."""
    found = [a - 180 if a > 45 else a for a in line_angles(edges(blurred(gray(image), 9)))]
    near = [a for a in found if abs(a) < WIDEST]
    angle = float(np.median(near)) if near else 0.0
    return -angle if abs(angle) >= LEAST_TURN else 0.0


#: Positions between pixels are rounded to so many parts, 2 to the power of PART_BITS.
PART_BITS = 5
PARTS = 1 << PART_BITS


def turned(height: int, width: int, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Where in the image (y, x, in PARTS of a pixel) each pixel of the turned image comes from."""
    t, cy, cx = np.deg2rad(angle), height // 2, width // 2
    y, x = np.arange(float(height))[:, None] - cy, np.arange(float(width)) - cx
    source_x = np.cos(t) * x - np.sin(t) * y + cx
    source_y = np.sin(t) * x + np.cos(t) * y + cy
    return tuple(np.floor(np.add(np.multiply(s, PARTS, out=s), 0.5, out=s), out=s).astype(int) for s in (source_y, source_x))


def cubic_weights(part: np.ndarray) -> list[np.ndarray]:
    """Weights of the pixels from 1 before to 2 after a position that is part / PARTS after a pixel (a = -0.75)."""
    t, a = part / PARTS, -0.75
    near = lambda d: (a + 2) * d**3 - (a + 3) * d**2 + 1
    far = lambda d: a * (d**3 - 5 * d**2 + 8 * d - 4)
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def rotate(image: np.ndarray, angle: float) -> np.ndarray:
    """About the centre, counter-clockwise, bicubic from 4 x 4 pixels, borders repeated, same size.

    Weights depend on the parts of a pixel alone and are looked up; rows, some at a time, look their pixels up in a run of
    numbers with a rim of 3, beyond which all pixels are alike.
    """
    if not angle:
        return image
    h, w = image.shape[:2]
    planes = [np.pad(p, 3, mode="edge").reshape(-1).astype(np.float64) for p in (np.moveaxis(image, 2, 0) if image.ndim == 3 else [image])]
    one_way = cubic_weights(np.arange(PARTS))
    weights = [np.outer(down, across).reshape(-1) for down in one_way for across in one_way]
    y, x = turned(h, w, angle)
    part = ((y & (PARTS - 1)) * PARTS + (x & (PARTS - 1))).reshape(-1)
    at = ((np.clip(y >> PART_BITS, -2, h) + 2) * (w + 6) + np.clip(x >> PART_BITS, -2, w) + 2).reshape(-1)
    out = np.empty((h * w, len(planes)), np.uint8)
    for i in range(0, h * w, RUN):
        some, here = part[i : i + RUN], at[i : i + RUN]
        found, (each, one) = np.zeros((len(planes), len(some))), np.empty((2, len(some)))
        for k, weight in enumerate(weights):
            place = here + (k // 4 * (w + 6) + k % 4)
            weight.take(some, out=each, mode="wrap")  # all places are inside; the other modes look twice
            for plane, total in zip(planes, found, strict=True):
                plane.take(place, out=one, mode="wrap")
                one *= each
                total += one
        out[i : i + RUN] = np.rint(found, out=found).clip(0, 255, out=found).T
    return out.reshape(image.shape)


def deskew(image: np.ndarray, straighten: bool = False) -> np.ndarray:
    """The image turned by its skew angle. As the original has it, that is the way in which upright lines already lean;
    straighten=True turns it back instead, so that they stand upright."""
    angle = skew_angle(image)
    return rotate(image, -angle if straighten else angle)


def remove_borders(image: np.ndarray, white: float = 240, padding: int = 2, least: float = 0.3) -> np.ndarray:
    """Crops rows and columns of mean `white` or more at the edges, less a padding; not below `least` of a side."""
    image = gray(image)
    h, w = image.shape
    if not image.size:
        return image

    def span(means: np.ndarray) -> tuple[int, int]:
        dark = np.flatnonzero(means < white)
        return (int(dark[0]), int(dark[-1]) + 1) if len(dark) else (0, len(means))

    (top, bottom), (left, right) = span(image.mean(1)), span(image.mean(0))
    top, left, bottom, right = max(0, top - padding), max(0, left - padding), min(h, bottom + padding), min(w, right + padding)
    return image if bottom - top < h * least or right - left < w * least else image[top:bottom, left:right]


def noise_removal(image: np.ndarray) -> np.ndarray:
    return median3(image)


def preprocess(image: np.ndarray, use_clahe: bool = True) -> np.ndarray:
    out = remove_borders(gray(deskew(image)))
    out = denoise(clahe(out, 2.0) if use_clahe else out, 10, 7, 21)
    return dilate(erode(adaptive_threshold(out, 19, 8)))


def preprocess_receipt(image: np.ndarray, enhance_contrast: bool = True) -> np.ndarray:
    out = upscale(gray(image))
    out = denoise(clahe(out, 3.0) if enhance_contrast else out, 10, 7, 21)
    return dilate(adaptive_threshold(out, 21, 10))


def preprocess_receipt_conservative(image: np.ndarray) -> np.ndarray:
    return denoise(clahe(upscale(gray(image)), 2.0), 5, 7, 15)


def pixels(row: dict) -> np.ndarray | None:
    """A row's pixels; null where they are missing or of the wrong length."""
    h, w, c, raw = row["height"], row["width"], row["channels"], row["content"]
    if raw is None or not h or not w or not c or len(raw) != h * w * c:
        return None
    return np.frombuffer(raw, np.uint8).reshape((h, w) if c == 1 else (h, w, c))


def handed(images: DataFrame, *more: str) -> DataFrame:
    """The columns of images (and `more`) for a step in Python. Spark hands over BATCH_BYTES at a time: its default is a count
    of rows, which for pixels is gigabytes."""
    images.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return images.select("path", "height", "width", "channels", "content", *more)


def measured(images: DataFrame, measures: dict[str, Callable[[np.ndarray], float]], keep: tuple[str, ...] = ()) -> DataFrame:
    """path and a column of each measure of the images; null where there are no pixels. Columns `keep` stay."""
    kinds = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    names = "path string" + "".join(f", `{m}` double" for m in measures) + "".join(f", `{k}` {kinds[k]}" for k in keep)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(r["path"], pixels(r)) for r in batch.to_pylist()]  # views of the rows' bytes
            columns = [pa.array([None if p is None else float(f(p)) for _, p in found], pa.float64()) for f in measures.values()]
            kept = [batch.column(5 + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([pa.array([path for path, _ in found], pa.string()), *columns, *kept], names=["path", *measures, *keep])

    return handed(images, *keep).mapInArrow(run, names)


def apply(images: DataFrame, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """images (COLUMNS) with `step` done on each; rows whose pixels are missing or of the wrong length keep null content."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):  # an image at a time
                r = batch.slice(i, 1).to_pylist()[0]
                found = pixels(r)
                made = r | {"content": None}
                if found is not None:
                    out = np.ascontiguousarray(step(found))
                    made = {"path": r["path"], "height": out.shape[0], "width": out.shape[1], "channels": 1 if out.ndim == 2 else out.shape[2], "content": out.tobytes()}
                yield pa.RecordBatch.from_pylist([made], schema=batch.schema)

    return handed(images).mapInArrow(run, COLUMNS)
