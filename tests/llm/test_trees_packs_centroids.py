"""Merkle manifest, packing of token sequences and centroid clustering against plain code, on small and awkward tables."""

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict
from math import floor

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parchment.llm import centroids, merkle, packing
from tests.llm.test_llm import corpus, frame, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The root, and of each node (siblings before, siblings after) a level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for j, i in enumerate(at):
            run = i - i % fanout
            paths[j].append((level[run:i], level[i + 1 : run + fanout]))
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], paths


def audit_by_hand(rows, fanout):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fanout) for s in order}
    root, upper = tree([trees[s][0] for s in order], fanout)
    out = []
    for s, up in zip(order, upper):
        for (_, _, node, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            now = leaf(r, r["text"].translate(low)) if tampered and r["text"] is not None else node
            for left, right in path + up:
                now = h(*left, now, *right)
            out.append((r["doc_id"], node, trees[s][0], root, h(*(x for left, right in path + up for x in left + right)), now, now == root))
    return out


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("fanout", "levels"), [(16, 3), (2, 1), (2, 3), (3, 2)])
def test_merkle(spark, fanout, levels):
    rows = corpus() + [(1000 + i, "Some Text", "en", "one") for i in range(3)] + [(2000, "Alone É", None, "é"), (2001, "Alone", "en", "z\U0001f600"), (2002, "", "en", "")]
    docs = frame(spark, rows)
    got = merkle.audit(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, fanout, levels)
    assert sorted_rows(got.collect()) == sorted_rows(audit_by_hand([r.asDict() for r in docs.collect()], fanout))


def test_merkle_sizes(spark):
    """Trees of one node, of exactly a power, and of one more; each column's change is seen."""
    rows = [(s * 100 + i, f"t{i}", "en", f"s{s:02}") for s, n in enumerate((1, 2, 4, 5, 16, 17, 65)) for i in range(n)]
    docs = frame(spark, rows)
    got = merkle.audit(docs, F.lit(False), 4, 2).collect()
    assert sorted_rows(r[:5] for r in got) == sorted_rows(r[:5] for r in audit_by_hand([r.asDict() for r in docs.collect()], 4))
    assert all(r.verified for r in got)
    other = docs.withColumn("lang", F.when(F.col("doc_id") == 101, F.lit(None)).otherwise(F.col("lang")))
    roots = {df.select("root").first()[0] for df in (merkle.audit(d, F.lit(False), 4, 2) for d in (docs, other))}
    assert len(roots) == 2


def test_merkle_of_nothing_and_one(spark):
    assert merkle.audit(frame(spark, [(1, "a", "b", "c")]).limit(0), F.lit(True)).count() == 0
    (r,) = merkle.audit(frame(spark, [(None, None, None, None)]), F.lit(None).cast("boolean")).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == h("-----") and r.proof_sha256 == h("")


def best_fit_by_hand(sizes, capacity):
    """Bins of sizes: greedy matching of those above a third, then best fit of the others, one by one."""
    large, bins = sorted((s for s in sizes if 3 * s > capacity), reverse=True), []
    while large:
        a = large.pop(0)
        b = next((x for x in large if a + x <= capacity), None)
        if b is not None:
            large.remove(b)
        bins.append([a] if b is None else [a, b])
    rooms = [capacity - sum(b) for b in bins]
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if not fits:
            rooms.append(capacity)
            fits = [len(rooms) - 1]
        rooms[min(fits, key=lambda i: rooms[i])] -= s
    return sorted(rooms)


def test_plan_is_that_of_one_by_one():
    rng = random.Random(5)
    for trial in range(300):
        capacity = rng.choice([1, 2, 3, 7, 12, 30, 100])
        sizes = [min(capacity, 1 + int(capacity * rng.random() ** rng.choice([1, 2, 4]))) for _ in range(rng.choice([0, 1, 3, 20, 150]))]
        placings, bins = packing.plan(dict(Counter(sizes)), capacity)
        fill, ranks, pieces = defaultdict(list), defaultdict(list), Counter()
        for size, first, end, at, per_bin, offset in placings:
            for k in range(end - first):
                fill[at + k // per_bin].append((offset + k % per_bin * size, size))
                ranks[size].append(first + k)
                pieces[size] += 1
        assert pieces == Counter(sizes) and all(sorted(r) == list(range(len(r))) for r in ranks.values())
        assert sorted(fill) == list(range(bins))
        for held in fill.values():
            end = 0
            for offset, size in sorted(held):
                assert offset == end
                end += size
            assert end <= capacity and sum(3 * s > capacity for _, s in held) <= 2
        assert sorted(capacity - sum(s for _, s in f) for f in fill.values()) == best_fit_by_hand(sizes, capacity), trial


def test_plan_is_bounded_by_the_capacity():
    rng = random.Random(6)
    counts = {s: rng.randrange(1, 10**9) for s in range(1, 2049)}
    placings, bins = packing.plan(counts)
    assert len(placings) < 40_000 and bins * 2048 < 1.3 * sum(s * n for s, n in counts.items())


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packing(spark, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = corpus()
    docs = frame(spark, rows)
    pieces, places = packing.pack(docs, PATH, capacity)
    found = packing.digests(pieces, places).collect()
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want.update((r[0], k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(tuple(r)[:5] for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) == len(best_fit_by_hand([r.length for r in found], capacity))
    whole = {r.sequence_id: r.ids for r in packing.sequences(pieces, places).collect()}
    assert set(whole) == set(bins)
    for r in found:
        ids = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(array("I", ids).tobytes()) == r.ids_crc32


def test_packing_of_nothing(spark):
    pieces, places = packing.pack(frame(spark, [(1, "a", "b", "c")]).limit(0), PATH)
    assert packing.digests(pieces, places).count() == 0


def cluster_by_hand(rows, k, rounds, scale=1024):
    kept = [(i, [floor(int(x) * scale if abs(x) > 1e300 else scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and abs(x) < float("inf") for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    now = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        now = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(now)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, c, d in out:
        sums[c] += d
    fits = lambda x: x if x < 2**63 else None
    return [(i, c, fits(d), fits(sums[c]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, c, d in out]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, id string, v int").repartition(3)


def made(rng, n, size=0.3):
    return [float(np.float32(rng.gauss(0, size))) for _ in range(n)]


AWKWARD = [(None, [0.5] * 64), (900, None), (901, [0.1] * 63), (902, [0.1] * 65), (903, [0.1] * 63 + [None]), (904, [0.1] * 63 + [float("nan")]), (905, [float("-inf")] + [0.1] * 63), (906, [])]


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_centroids(spark, rounds):
    rng = random.Random(7)
    rows = [(i, made(rng, 64)) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(20)] + [rows[5], rows[5]] + AWKWARD
    rows += [(300 + i, [((i >> j) & 1) / 1024 for j in range(64)]) for i in range(40)]  # many equal distances
    assert sorted_rows(centroids.cluster(vectors(spark, rows), rounds=rounds).collect()) == sorted_rows(cluster_by_hand(rows, 8, rounds))


@pytest.mark.parametrize(("size", "kind"), [(1e4, "float"), (3e6, "float"), (1e20, "float"), (1e36, "float"), (1e305, "double")])
def test_centroids_of_large_components(spark, size, kind):
    """Beyond what float32 and 64-bit integers hold: a few huge vectors among small ones."""
    rng = random.Random(8)
    rows = [(i, made(rng, 64)) for i in range(40)] + [(100 + i, [rng.choice([-1, 1]) * size * (1 + j % 3) for j in range(64)]) for i in range(6)]
    rows = [(i, [float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows]
    got = centroids.cluster(vectors(spark, rows, kind), rounds=3).collect()
    assert sorted_rows(got) == sorted_rows(cluster_by_hand(rows, 8, 3))


def test_few_vectors_or_none(spark):
    rows = [(i, [i / 100] * 64) for i in range(3)]
    assert sorted_rows(centroids.cluster(vectors(spark, rows)).collect()) == sorted_rows(cluster_by_hand(rows, 8, 10))
    assert centroids.cluster(vectors(spark, AWKWARD[1:])).count() == 0


def test_intervals_hold_and_screen():
    """The bounds enclose the exact values, and leave one candidate for nearly all vectors that aren't made to tie."""
    rng = np.random.default_rng(9)
    for size in (3, 1000, 2**25, 2**40):
        v = rng.integers(-size, size, (300, 64))
        c = rng.integers(-size, size, (8, 64))
        c[3] = c[2] + 1
        held = centroids.Centroids(c.tolist())
        low, high = centroids.intervals(v.astype(np.int64), held)
        exact = [[sum(int(y) * (int(y) - 2 * int(x)) for x, y in zip(a, b)) for b in c] for a in v]
        assert all(lo <= e <= hi for r, s, t in zip(low.tolist(), exact, high.tolist()) for lo, e, hi in zip(r, s, t))
        if size == 1000:
            assert ((low <= high.min(1, keepdims=True)).sum(1) == 1).mean() > 0.9


def test_limbs():
    for x in (0, 1, -1, 2**31, -(2**31), 2**32 - 1, 2**32, -(2**32), 2**63, -(2**63) - 5, 3**200, -(3**200)):
        parts = centroids.limbs(x)
        assert sum(p << (32 * k) for k, p in enumerate(parts)) == x and all(-(2**63) <= p < 2**63 for p in parts)


def test_prose_packs_tightly(spark):
    """Sequences are at most a hundredth above the least number that their tokens need."""
    rng = random.Random(10)
    docs = frame(spark, [(i, prose(rng, int(600 * rng.random() ** 3)), "en", "a") for i in range(1500)])
    r = packing.digests(*packing.pack(docs, PATH)).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert r[1] <= 1.01 * -(-r[0] // 2048) + 1
