"""Edges, lines, skew and rotation against plain loops over pixels."""

import math
from statistics import median

import numpy as np

from parchment.operators import images


def page(seed, h=40, w=50):
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 60, (h, w)).astype(np.uint8)
    for _ in range(4):
        y, x = rng.integers(0, h - 8), rng.integers(0, w - 8)
        out[y : y + rng.integers(3, 20), x : x + rng.integers(3, 20)] = rng.integers(80, 255)
    return out


def pixel(image, y, x, outside=None):
    h, w = len(image), len(image[0])
    if outside is not None and not (0 <= y < h and 0 <= x < w):
        return outside
    return int(image[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)])


def edges_by_hand(image, low, high):
    h, w = image.shape
    dx, dy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            p = lambda j, i: pixel(image, y + j, x + i)  # noqa: B023, E731
            dx[y, x] = p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)
            dy[y, x] = p(1, -1) + 2 * p(1, 0) + p(1, 1) - p(-1, -1) - 2 * p(-1, 0) - p(-1, 1)
    size = abs(dx) + abs(dy)
    kept = {}
    for y in range(h):
        for x in range(w):
            a, b, m = abs(dx[y, x]), abs(dy[y, x]), size[y, x]
            if b < a * math.tan(math.pi / 8):
                first, second, strict = (0, -1), (0, 1), False
            elif b > a * math.tan(3 * math.pi / 8):
                first, second, strict = (-1, 0), (1, 0), False
            else:
                s = -1 if (dx[y, x] < 0) != (dy[y, x] < 0) else 1
                first, second, strict = (-1, -s), (1, s), True
            one, two = (pixel(size, y + j, x + i, 0) for j, i in (first, second))
            if m > low and m > one and (m > two if strict else m >= two):
                kept[y, x] = m
    found, todo = set(), [k for k, m in kept.items() if m > high]
    while todo:
        y, x = todo.pop()
        if (y, x) not in found:
            found.add((y, x))
            todo += [(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1) if (y + j, x + i) in kept]
    return found


def test_edges():
    for seed in range(6):
        image = page(seed)
        for low, high in ((50, 150), (200, 300), (0, 10_000)):
            assert {(y, x) for y, x in zip(*np.nonzero(images.edges(image, low, high)))} == edges_by_hand(image, low, high)


def test_components_of_long_paths():
    spiral = np.zeros((61, 61), bool)
    y = x = 0
    dy, dx = 0, 1
    spiral[0, 0] = True
    for _ in range(5000):
        ny, nx = y + dy, x + dx
        ahead = 0 <= ny + dy < 61 and 0 <= nx + dx < 61 and spiral[ny + dy, nx + dx]
        if not (0 <= ny < 61 and 0 <= nx < 61) or spiral[ny, nx] or ahead:
            dy, dx = dx, -dy
            continue
        y, x = ny, nx
        spiral[y, x] = True
    number = images.components(spiral)
    assert len(set(number[spiral].tolist())) == 1 and (number[~spiral] == -1).all()
    two = np.zeros((5, 5), bool)
    two[0, 0] = two[1, 1] = two[4, 4] = True
    assert len(set(images.components(two)[two].tolist())) == 2
    assert images.components(np.zeros((3, 3), bool)).max() == -1


def lines_by_hand(edge, votes):
    count = {}
    for y, x in zip(*np.nonzero(edge)):
        for a in range(180):
            r = round(float(np.rint(x * math.cos(math.radians(a)) + y * math.sin(math.radians(a)))))
            count[a, r] = count.get((a, r), 0) + 1
    at = lambda a, r: count.get((a, r), 0)
    return sorted(a for (a, r), n in count.items() if n > votes and n > at(a, r - 1) and n >= at(a, r + 1) and n > at(a - 1, r) and n >= at(a + 1, r))


def test_lines():
    edge = np.zeros((150, 130), bool)
    edge[10:140, 40] = edge[20, 5:120] = True
    for y in range(140):
        edge[y, min(129, 60 + y // 3)] = True
    assert sorted(images.line_angles(edge, 60)) == lines_by_hand(edge, 60)
    assert {0, 90} < set(images.line_angles(edge, 100)) | {0, 90, 1} and images.line_angles(edge[:50], 100) == [90]


def test_angle_is_the_median_of_lines():
    image = np.full((200, 200), 255, np.uint8)
    for k, lean in enumerate((8, 8, 10)):
        for y in range(200):
            x = 30 + 50 * k + round(y * math.tan(math.radians(lean)))
            image[y, x : x + 4] = 0
    found = [a - 180 if a > 45 else a for a in images.line_angles(images.edges(images.blurred(image, 9)))]
    assert images.skew_angle(image) == -median(a for a in found if abs(a) < 30) and abs(images.skew_angle(image) - 8) <= 1
    assert images.skew_angle(np.zeros((60, 60, 3), np.uint8)) == 0.0


def rotated_by_hand(image, angle):
    h, w = image.shape
    t, out = math.radians(angle), np.zeros((h, w), np.uint8)
    weight = lambda d: 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * (d**3 - 5 * d**2 + 8 * d - 4)
    for y in range(h):
        for x in range(w):
            sx = math.floor((math.cos(t) * (x - w // 2) - math.sin(t) * (y - h // 2) + w // 2) * 32 + 0.5)
            sy = math.floor((math.sin(t) * (x - w // 2) + math.cos(t) * (y - h // 2) + h // 2) * 32 + 0.5)
            total = 0.0
            for j in range(-1, 3):
                for i in range(-1, 3):
                    total += weight(abs(j - sy % 32 / 32)) * weight(abs(i - sx % 32 / 32)) * pixel(image, sy // 32 + j, sx // 32 + i)
            out[y, x] = min(255, max(0, round(total)))
    return out


def test_rotation():
    for seed, angle in enumerate((3, -17, 90, 180, 26.5)):
        image = page(seed, 23, 31)
        got, want = images.rotate(image, angle).astype(int), rotated_by_hand(image, angle).astype(int)
        assert abs(got - want).max() <= 1 and (got != want).mean() < 0.01  # sums in another order may round a half otherwise
        assert (images.rotate(np.repeat(image[..., None], 3, 2), angle)[..., 1] == images.rotate(image, angle)).all()
    assert (images.rotate(image, 0) == image).all() and (images.rotate(image[:, :1], 5) == images.rotate(image[:, :1], 5)).all()


def test_pages_are_straightened(spark, tmp_path):
    from parchment import queries

    orders = [(k, k, 1, 1.0) for k in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, n int, p double").selectExpr("*", "timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, o_orderkey) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, s, k % 7 + 1) for k in range(40) for s in range(1, 17)], "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = queries.image_skew(spark, str(tmp_path)).collect()
    assert len(rows) == 16 and all(r.within_a_degree for r in rows)
    assert all(r.straight for r in queries.image_deskew(spark, str(tmp_path)).collect())


def denoised_by_hand(image, strength, patch, search):
    """Non-local means pixel by pixel in double precision: a patch is of differences, whose borders repeat."""
    (h, w), r, half = image.shape, search // 2, patch // 2
    padded = np.pad(image.astype(int), r, mode="reflect" if min(h, w) > r else "edge")
    out = np.zeros((h, w))
    clamp = lambda v, n: min(max(v, 0), n - 1)
    for y in range(h):
        for x in range(w):
            total = weights = 0.0
            for dy in range(search):
                for dx in range(search):
                    apart = sum((int(image[j, i]) - int(padded[j + dy, i + dx])) ** 2 for j in (clamp(y + a, h) for a in range(-half, half + 1)) for i in (clamp(x + a, w) for a in range(-half, half + 1)))
                    weight = math.exp(-apart / patch**2 / strength**2)
                    weights, total = weights + weight, total + weight * int(padded[y + dy, x + dx])
            out[y, x] = total / weights
    return np.rint(out).clip(0, 255)


def test_denoise_is_of_double_precision_however_it_is_cut(monkeypatch):
    for seed, (h, w), (strength, patch, search) in ((0, (9, 14), (10, 7, 5)), (1, (14, 6), (5, 3, 9)), (2, (3, 4), (10, 7, 11)), (3, (1, 1), (10, 7, 5)), (4, (8, 8), (40, 1, 3))):
        image = np.random.default_rng(seed).integers(0, 60, (h, w)).astype(np.uint8)
        want = denoised_by_hand(image, strength, patch, search)
        for cells in (1, 60, 1 << 16):
            monkeypatch.setattr(images, "CELLS", cells)
            assert (images.denoise(image, strength, patch, search) == want).all()
        monkeypatch.setattr(images, "HALF", 1.0)  # all pixels are made again
        assert (images.denoise(image, strength, patch, search) == want).all()
        monkeypatch.undo()


def test_steps_do_not_depend_on_how_many_numbers_are_worked_on_at_a_time(monkeypatch):
    image = page(7, 60, 90)
    edge = images.edges(images.blurred(image, 9))
    whole = images.rotate(image, 11.5), images.blurred(image, 9), images.line_angles(edge, 8)
    monkeypatch.setattr(images, "RUN", 100)
    for a, b in zip(whole, (images.rotate(image, 11.5), images.blurred(image, 9), images.line_angles(edge, 8)), strict=True):
        assert np.array_equal(a, b)
    assert whole[2] == lines_by_hand(edge, 8)
