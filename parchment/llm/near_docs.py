"""Near-duplicate documents: candidates by SimHash and by MinHash of word shingles, exact Jaccard, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, joined, small, stored, text_or_empty

#: 16 bands of 4 rows: a pair at a similarity of 0.8 shares a band with probability 0.9998.
BANDS, ROWS = 16, 4
LEAST = 0.8
#: Documents of a bucket that are all compared with each other; of larger buckets each is compared with four of them,
#: and then those of different components with each other.
SMALL_BUCKET = 32
#: Longs of a set's sketch: bit b tells whether an odd number of the set's hashes end in b.
SKETCH = 16
#: Documents of a large bucket that meet as many in one block of its pairs.
PIECE = 512


def shingle_sets(texts: list[bytes], words: int):
    """For each text the sorted distinct hashes of its shingles: `words` words, or all if there are fewer; none without
    a word."""
    import numpy as np

    from .hashing import mixed, powers, word_hashes

    scale = powers(np.uint64(0xC2B2AE3D27D4EB4F), words + 1)
    for group, hashes, first in word_hashes(texts):
        n = max(0, len(hashes) - words + 1)
        whole = np.zeros(n, np.uint64)
        for k in range(words):
            whole += hashes[k : k + n] * scale[k]
        whole = mixed(whole)
        for k in range(len(group)):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            else:
                yield mixed((hashes[a:b] * scale[: b - a]).sum(keepdims=True) + scale[words] * np.uint64(b - a)) if b > a else hashes[:0]


def band_keys(hashes, masks):
    """The bands' keys of a set: the least of its hashes under each permutation, joined by bands."""
    import numpy as np

    from .hashing import mixed, powers

    least = np.full(len(masks), ~np.uint64(0))
    for i in range(0, len(hashes), 1 << 14):
        np.minimum(least, mixed(hashes[i : i + (1 << 14)] ^ masks[:, None]).min(1), out=least)
    return mixed((least.reshape(BANDS, ROWS) * powers(np.uint64(0x9E3779B97F4A7C15), ROWS + 1)[1:]).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(hashes):
    """The parities of the hashes' last bits. Each hash that only one of two sets has changes one bit, so the sketches of
    two sets differ in no more bits than the sets in hashes."""
    import numpy as np

    bits = np.bincount((hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _found(words: int, signed: bool):
    """Of each text: its id, and the digest of its set with the bands' keys, its size and its sketch (or with the set
    itself)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        masks = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
        for batch in batches:
            digests, values, sizes, sketches = [], [], [], []
            for hashes in shingle_sets([t.as_py().encode().lower() for t in batch.column(1)], words):
                digests.append(xxh3_128_digest(hashes.tobytes()))
                values.append(band_keys(hashes, masks) if signed and len(hashes) else hashes.view(np.int64))
                if signed:
                    sizes.append(len(hashes))
                    sketches.append(sketch(hashes))
            found = {"doc": batch.column(0), "id": pa.array(digests, pa.binary()), "keys" if signed else "hashes": pa.array(values, pa.list_(pa.int64()))}
            if signed:
                found |= {"size": pa.array(sizes, pa.int64()), "sketch": pa.array(sketches, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(found)

    return run


def candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of ids that share a band's key, from (id, keys) of different sets, and the places
    (key, id) of large buckets, which `bucket_pairs` compares further.

    Bucket sizes and four representatives a bucket come from a partly aggregated count; single lines leave there.
    Buckets of up to SMALL_BUCKET lines give their pairs; each line of a larger bucket is paired with the four
    representatives, so what is emitted here grows with the lines and not with a bucket's square.
    """
    members = lines.select("id", F.explode("keys").alias("key"))
    other = F.xxhash64("id")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("r1"), F.max("id").alias("r2"), F.min_by("id", other).alias("r3"), F.max_by("id", other).alias("r4")).where("n > 1")
    placed = stored(members.join(sizes, "key").select("key", "id", "n", F.array("r1", "r2", "r3", "r4").alias("reps")), "buckets")
    few = placed.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.collect_set("id").alias("ids"))
    few = few.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b")
    many = placed.where(F.col("n") > SMALL_BUCKET).select("id", F.explode("reps").alias("r")).where("id <> r").select(F.least("id", "r").alias("a"), F.greatest("id", "r").alias("b"))
    return few.unionByName(many).distinct(), placed.where(F.col("n") > SMALL_BUCKET).select("key", "id")


def may_be_alike(least: float) -> Column:
    """Whether sets of the columns size_a, sketch_a, size_b, sketch_b can have a Jaccard similarity of `least` or more: if
    they do, at most a part (1 - least) / (1 + least) of their sizes' sum is in one of them only, and so many bits of the
    sketches differ at most. No such pair is left out; few others pass."""
    a, b = F.col("size_a"), F.col("size_b")
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(SKETCH)))
    return (F.least(a, b) >= least * F.greatest(a, b) - 1e-6) & (differ * (1 + least) <= (a + b) * (1 - least) + 1e-6)


def sketched(end: str) -> list[Column]:
    """Size and sketch of a pair's end, by their names there."""
    return [F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}")]


def hopeful(pairs: DataFrame, lines: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) that may be alike, by the sketches of the rows (id, size, sketch): whole sets are read and moved for
    these only."""
    for end in "ab":
        pairs = pairs.join(lines.select(F.col("id").alias(end), *sketched(end)), end)
    return pairs.where(may_be_alike(least)).select("a", "b")


def bucket_pairs(placed: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (a, b, of_a, of_b), in some order, of different components of the places (key, id, component, size, sketch)
    that share a key, among them all whose sets have a Jaccard similarity of `least` or more.

    A bucket's lines are dealt to pieces and its pairs to blocks of two pieces, so that no task holds a bucket; pairs
    are formed and judged by their sketches inside the join, and only those that may be alike leave it.
    """
    sizes = placed.groupBy("key").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = placed.join(sizes.where("low <> high").select("key", "pieces"), "key").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int"))
    mixed = stored(mixed, "mixed")
    ends = lambda end: [F.col("id").alias(end), F.col("component").alias(f"of_{end}"), *sketched(end)]
    a = mixed.select("key", F.col("piece").alias("p"), F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("q"), *ends("a"))
    b = mixed.select("key", F.explode(F.sequence(F.lit(0), "piece")).alias("p"), F.col("piece").alias("q"), *ends("b"))
    once = (a["p"] < a["q"]) | (F.col("a") < F.col("b"))  # in a block of a piece with itself
    on = (a["key"] == b["key"]) & (a["p"] == b["p"]) & (a["q"] == b["q"]) & once & (F.col("of_a") != F.col("of_b")) & may_be_alike(least)
    return a.join(b, on).select("a", "b", "of_a", "of_b").distinct()


def alike(pairs: DataFrame, large: DataFrame, lines: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, component) by the likeness of the pairs, and of all pairs that share a large bucket's key."""
    found = stored(connected_components(stored(similar(pairs, sets, least), "alike")), "components")
    if large.isEmpty():
        return found
    placed = large.join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    more = stored(bucket_pairs(placed.join(lines.select("id", "size", "sketch"), "id"), least), "pairs")
    links = similar(more, sets, least).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    whole = stored(connected_components(links).select(F.col("node").alias("part"), F.col("component").alias("whole")), "wholes")
    merged = found.join(whole, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component"))
    single = whole.join(found, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("component"))
    return stored(merged.unionByName(single), "components")


def similar(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of `least` or more."""
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return rows.where(shared >= least * (F.size("x") + F.size("y") - shared)).select(*pairs.columns)


def near_duplicates(docs: DataFrame, words: int = 5, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id) of each row of docs: component_id is the smallest id reachable over pairs whose sets of
    shingles (lower-cased A-Z) have a Jaccard similarity of `least` or more.

    Candidates share a SimHash component or a MinHash band; all are verified exactly, in large buckets too, but for those
    that their sketches rule out and those already of one component. Equal sets are one row of all this. Texts without a word are alike. ids are whole numbers; rows
    of null id have their set's component, or null where no row of the component has an id; repeated rows are repeated;
    an empty table gives an empty result; other columns of docs are ignored. A text's set is held whole by one task.
    """
    rows = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = stored(rows.mapInArrow(_found(words, True), f"doc {kind}, id binary, keys array<long>, size long, sketch array<long>"), "signed")
    distinct = stored(signed.groupBy("id").agg(*(F.first(c).alias(c) for c in ("keys", "size", "sketch")), F.min("doc").alias("doc")), "distinct")
    linked = simhash.near_duplicates(docs, words, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("x"), F.col("component_id").alias("y")).distinct()
    of = lambda doc, name: signed.where("doc IS NOT NULL").select(F.col("doc").alias(doc), F.col("id").alias(name)).distinct()
    ends = linked.join(of("x", "p"), "x").join(of("y", "q"), "y").where("p <> q")
    more = stored(ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "pairs")

    def sets(wanted: DataFrame) -> DataFrame:
        """Sets of the wanted ids, of one row each; null ids are read whole."""
        some = stored(wanted.join(distinct.select("id", "doc"), "id"), "some")
        chosen = rows.join(small(some.where("doc IS NOT NULL").select("doc").distinct(), 16), "doc", "left_semi")
        chosen = chosen.unionByName(rows.where("doc IS NULL"))
        found = chosen.mapInArrow(_found(words, False), f"doc {kind}, id binary, hashes array<long>")
        return found.join(small(some.select("id"), 32), "id", "left_semi").groupBy("id").agg(F.first("hashes").alias("hashes"))

    pairs, large = candidates(distinct)
    pairs = stored(hopeful(pairs.unionByName(more).distinct(), distinct, least), "pairs")
    wanted = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")).distinct(), "wanted")
    found = alike(pairs, large, distinct, stored(sets(wanted), "sets"), least)
    classes = distinct.join(found, F.col("id") == F.col("node"), "left").select("id", "doc", F.coalesce("component", "id").alias("component"))
    firsts = classes.groupBy("component").agg(F.min("doc").alias("component_id"))
    counts = signed.groupBy("id").agg(F.count("*").alias("n"))
    table = classes.join(firsts, "component").join(counts, "id").select("id", "component_id", "n")
    return joined(signed.select("doc", "id"), stored(table, "classes"), "id", 40).select(F.col("doc").alias(id_col), "component_id")
