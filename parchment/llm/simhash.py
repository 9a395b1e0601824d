"""SimHash fingerprints, their links within a Hamming distance by pigeonring chains, and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, joined, stored, text_or_empty

#: 64 bits in five segments; two fingerprints at distance 4 or less have a segment from which every chain of l
#: consecutive segments (round the ring) differs in at most 4 * l / 5 bits: 0, 1, 2, 3, 4.
DISTANCE = 4
WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(WIDTHS[:i]) for i in range(5))
BUDGETS = tuple(DISTANCE * (i + 1) // 5 for i in range(5))
SEED = 42


def fingerprint(text: str, words: int = 4) -> int:
    """Lower-cased A-Z, shingles of `words` words with repeats, XXH64; a bit is 1 if set in over half the hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()  # bytes: only ASCII letters and ASCII white space
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    n = max(1, len(parts) - words + 1)
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        block = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each document; fp as a signed long. No shuffle."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, STARTS[i]).bitwiseAND((1 << WIDTHS[i]) - 1)


def _above(key: Column):
    return lambda x: x > key


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the ids (whole numbers) of the rows (id, fp), fp distinct, that connect whatever is within DISTANCE.

    Chains of two segments are the join key: the first equal, the second within one bit. Every fingerprint is at home
    under its own pair of segments for each start, and visits the pairs one bit away in the second (the larger ones
    only, so two fingerprints meet once a start): at most 70 rows a fingerprint, so the work grows with the input, and
    what meets shares 25 or more bits, so groups stay small but where texts are truly alike. There a spanning forest
    of the links is returned, never all pairs: a fingerprint is compared only with those not yet connected to it.
    """
    rows = []
    for i in range(5):
        j = (i + 1) % 5
        key = F.lit(i << 26) + segment(F.col("fp"), i) * (1 << 13) + segment(F.col("fp"), j)
        away = F.filter(F.transform(F.array(*(F.lit(1 << k) for k in range(WIDTHS[j]))), key.bitwiseXOR), _above(key))
        rows += [F.array(F.struct(key.alias("key"), F.lit(True).alias("home"))), F.transform(away, lambda x: F.struct(x.alias("key"), F.lit(False).alias("home")))]
    spread = distinct.select("id", "fp", F.explode(F.concat(*rows)).alias("k")).select("k.key", "k.home", "id", "fp")
    dealt = spread.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_forests, "a long, b long")


def within(x, start):
    """Whether the differences x keep all chain budgets from segment `start`; the last budget is the distance itself."""
    import numpy as np

    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for step in range(5):
        i = (start + step) % 5
        total += np.bitwise_count((x >> np.uint64(STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1))
        ok &= total <= BUDGETS[step]
    return ok


def forest(homes: int, fps, start: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links of the first `homes` fingerprints with each other and the rest."""
    import numpy as np

    label, edges = np.arange(len(fps)), []
    for p in range(homes):
        rest = np.flatnonzero(label != label[p])
        if not len(rest):
            break
        near = rest[within(fps[rest] ^ fps[p], start)]
        for q in near.tolist():
            if label[q] != label[p]:
                label[label == label[q]] = label[p]
                edges.append((p, q))
    return edges


def _forests(batches):
    import numpy as np
    import pyarrow as pa

    def work(key, home, ids, fps):
        cuts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1, append=key[-1:] + 1))
        sizes = np.diff(cuts)
        a, b = [], []
        for s, n in zip(cuts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            order = np.argsort(~home[s : s + n], kind="stable") + s
            homes = int(home[s : s + n].sum())
            for p, q in forest(homes, fps[order], int(key[s] >> 26)) if homes else ():
                a.append(ids[order[p]])
                b.append(ids[order[q]])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list = []
    for batch in batches:
        key, home, ids, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        held.append((key, home, ids, fps.view(np.uint64)))
        if len(key) and held[0][0][0] != key[-1]:  # all but the last key is complete
            joined = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = np.searchsorted(joined[0], joined[0][-1])
            yield work(*(c[:cut] for c in joined))
            held = [tuple(c[cut:] for c in joined)]
    if held and sum(len(h[0]) for h in held):
        yield work(*(np.concatenate(c) for c in zip(*held, strict=True)))


def near_duplicates(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, fingerprint (16 hex digits), component_id (smallest id reachable over links of
    DISTANCE differing bits or fewer, itself included).

    Fingerprints are what is linked, whatever ids they have, so a document of null id links others; rows of null id have
    their fingerprint's component, which is null where no row of it has an id. Equal fingerprints meet in an aggregate,
    so copies are one row of what follows, and fingerprints or components of many rows are joined by broadcast. ids are
    whole numbers. Null and empty texts, like those without a word, have fingerprint zero, linked like any other; texts
    are read whole, whatever their length; repeated rows are repeated; an empty table gives an empty result; other columns
    of docs are ignored.
    """
    prints = stored(fingerprints(docs, words, id_col, text_col), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").cast("long").alias("id"), F.count("*").alias("n_rows")), "distinct")
    found = connected_components(links(distinct.select(F.col("fp").alias("id"), "fp")))
    classes = stored(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", "n_rows", F.coalesce("component", "fp").alias("component")), "classes")
    firsts = stored(classes.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "firsts")
    table = joined(classes, firsts, "component", 32).select("fp", "component_id", F.col("n_rows").alias("n"))
    placed = joined(prints, stored(table, "table"), "fp", 32)
    return placed.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
