"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sum, stored, text_or_empty

#: The fixed masks: 1 takes a token's hash, 0 ignores the token. Every passage of 5 tokens or more, begun and ended by
#: equal tokens, of which at most a fifth differ, leaves one of them whole: k substitutions part the equal tokens into
#: k + 1 runs, of which one has 4 tokens, or (5 to 11, or 15 tokens) two runs meet at one substitution and fit a mask.
#: A test enumerates all patterns of 5 to 25 tokens; longer passages part into stretches of 13 to 25, one of them as alike.
MASKS = ("1111", "10111", "11011", "11101")
#: Candidates that are looked at together.
CHUNK = 1 << 16
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
PUNCTUATION = string.punctuation.encode()
#: Bytes of the test set that are held at once; more are worked on in blocks of this size, and the item that ends one.
BLOCK_BYTES = 32 << 20
#: Repetitions of a seed after up to so many tokens are one candidate a diagonal.
PERIODS = (1, 2, 3, 4)


def normalized(text: str | None) -> bytes:
    """Lower case and no punctuation (ASCII); words remain what white space parts."""
    return (text or "").encode().translate(LOWER, PUNCTUATION)


def seeds(hashes, mask: str):
    """A hash for each place where the mask fits."""
    import numpy as np

    from .hashing import mixed, powers

    n = len(hashes) - len(mask) + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k, (bit, power) in enumerate(zip(mask, powers(np.uint64(0xC2B2AE3D27D4EB4F), len(mask)), strict=True)):
            if bit == "1":
                out += hashes[k : k + n] * power
    return mixed(out)


def overlap(doc, item, shift: int, tolerance: float):
    """On the diagonal doc[i + shift] ~ item[i]: (first item token, length, matches) of the longest stretch begun and ended
    by equal tokens in which substitutions are at most `tolerance` of its length, the first of equals; zeros without one.

    Only equal tokens are tried as ends, so what lies beside a passage can't hide it.
    """
    import numpy as np

    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[low + shift : high + shift] == item[low:high]
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    allowed = round(tolerance * 1_000_000)
    sums = np.concatenate([[0], np.cumsum(np.where(same, allowed, allowed - 1_000_000))])  # a stretch within the tolerance sums to 0 or more
    least = np.minimum.accumulate(sums[at])  # over the starts up to each; the earliest start of no larger sum serves an end best
    start = at[np.minimum(np.searchsorted(-least, -sums[at + 1]), len(at) - 1)]
    length = np.where(start <= at, at + 1 - start, 0)
    k = int(length.argmax())
    first, n = int(start[k]), int(length[k])
    return low + first, n, int(same[first : first + n].sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, tolerance: float = 0.2, masks: tuple[str, ...] = MASKS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and test item that share a passage: id_col, item_col, doc_start and n_tokens of the
    passage in the document, n_matches.

    A passage is a stretch of `least` tokens or more (or the item's half or more, if the item is shorter than twice
    that, but 5 at least) in which at most `tolerance` of the tokens differ by substitution. Candidates are places
    where a spaced seed of the document equals one of the test set; each candidate's diagonal is counted around the seed,
    where equal tokens must be as many as in the shortest passage, and then compared token by token. The masks find
    every passage at a tolerance of 0.2 or less; items shorter than other masks are sought by contiguous seeds of their
    own length. Items under 5 tokens have no passage. The test set is the stated
    query set: it is held in blocks of BLOCK_BYTES against all documents, without any shuffle of the documents, and of
    each document only its passages leave a task. Of a document's passages of an item the one with the most equal tokens is
    told. A repeated token or phrase of a document and an item costs their lengths, not the product. Null and empty texts
    share nothing; texts are read whole, whatever their length; repeated rows give repeated rows; empty tables give an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"), F.coalesce(F.octet_length(item_text), F.lit(0)).cast("long").alias("bytes"))
    n = 1 + (items.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES
    if n > 1:
        items = stored(prefix_sum(items.withColumn("one", F.lit(0)), "one", ["item", "text"], "bytes", "before").withColumn("block", F.floor(F.col("before") / BLOCK_BYTES)), "items")
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, doc_start long, n_tokens long, n_matches long"
    rows = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    parts = []
    for b in range(n):
        held = (items.where(f"block = {b}") if n > 1 else items).select("item", "text").collect()
        shared = spark.sparkContext.broadcast([(r["item"], normalized(r["text"])) for r in held])
        parts.append(rows.mapInArrow(_finder(shared, least, tolerance, masks), schema))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "doc_start", "n_tokens", "n_matches")


def _finder(shared, least, tolerance, masks):
    def find(batches):
        import numpy as np
        import pyarrow as pa

        from parchment.llm.hashing import word_hashes

        held = shared.value
        tokens = [np.empty(0, np.uint64)] * len(held)
        for group, hashes, first in word_hashes([t for _, t in held]):
            for k, i in enumerate(group):
                tokens[i] = hashes[first[k] : first[k + 1]]
        lengths = np.array([len(t) for t in tokens], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate([*tokens, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(tokens)), lengths)
        needs = np.minimum(least, np.maximum(5, (lengths + 1) // 2))
        fewest = np.ceil((1 - tolerance) * needs - 1e-9).astype(np.int64)
        longest = max(map(len, masks))
        sought = {}
        for mask in dict.fromkeys([*masks, *("1" * n for n in range(5, longest))]):
            keys = seeds(flat, mask)
            at = np.flatnonzero(np.arange(len(keys)) + len(mask) <= begins[owner[: len(keys)] + 1])
            at = at[(lengths[owner[at]] >= 5) if mask in masks else (lengths[owner[at]] == len(mask))]
            if len(at):
                whole = np.zeros(len(keys), bool)
                whole[at] = True
                tables = {}
                for k in (0, *PERIODS):  # k: without places that repeat the seed k tokens before them in the item
                    again = k and whole[np.maximum(at - k, 0)] & (at >= k) & (owner[np.maximum(at - k, 0)] == owner[at]) & (keys[np.maximum(at - k, 0)] == keys[at])
                    left = at[~again] if k else at
                    order = np.argsort(keys[left], kind="stable")
                    tables[k] = keys[left][order], left[order]
                sought[mask] = tables

        def dense(hashes, first, doc, place, at):
            """Which candidates have enough equal tokens around them."""
            item = owner[at]
            reach = 2 * needs[item] + longest
            low = np.maximum(-reach, np.maximum(first[doc] - place, begins[item] - at))
            high = np.minimum(reach, np.minimum(first[doc + 1] - place, begins[item + 1] - at) - 1)
            equal = np.zeros(len(at), np.int64)
            for o in range(int(low.min()), int(high.max()) + 1):
                some = np.flatnonzero((low <= o) & (o <= high))
                equal[some] += hashes[place[some] + o] == flat[at[some] + o]
            return equal >= fewest[item]

        def repeats(found, doc, whole):
            """For each place, the least period after which its seed stood before it in the document (0: none), and
            whether it stands again after one."""
            back, ahead = np.zeros(len(found), np.int64), np.zeros(len(found), bool)
            for k in reversed(PERIODS):
                again = (found[k:] == found[:-k]) & (doc[k:] == doc[:-k]) & whole[k:] & whole[:-k]
                back[k:][again] = k
                ahead[:-k][again] = True
            return back, ahead

        for batch in batches:
            out, texts = [], [normalized(t.as_py()) for t in batch.column(1)]
            for group, hashes, first in word_hashes(texts):
                hits = set()
                for mask, tables in sought.items():
                    found = seeds(hashes, mask)
                    owners = np.searchsorted(first, np.arange(len(found)), "right") - 1
                    fits = np.arange(len(found)) + len(mask) <= first[owners + 1]
                    back, ahead = repeats(found, owners, fits)
                    for k, (keys, where) in tables.items():
                        # the place k before makes the same diagonals but for those of the item's places in this table
                        places = np.flatnonzero(fits & (back == k))
                        if not len(keys) or not len(places):
                            continue
                        low = np.searchsorted(keys, found[places])
                        hit = keys[np.minimum(low, len(keys) - 1)] == found[places]
                        places, low = places[hit], low[hit]
                        many = np.searchsorted(keys, found[places], "right") - low
                        ends = np.cumsum(many)
                        for start in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
                            n = np.arange(start, min(start + CHUNK, int(ends[-1])))
                            j = np.searchsorted(ends, n, "right")
                            place, at = places[j], where[low[j] + n - ends[j] + many[j]]
                            doc, item = owners[place], owner[at]
                            # a seed that is repeated stands for the later ones, around which it doesn't count
                            good = ahead[place] | dense(hashes, first, doc, place, at)
                            shift = place - first[doc] - at + begins[item]
                            hits.update(zip(doc[good].tolist(), item[good].tolist(), shift[good].tolist(), strict=True))
                lines = {}
                for d, item, shift in hits:
                    most = min(len(tokens[item]), int(first[d + 1] - first[d]) - shift) - max(0, -shift)
                    lines.setdefault((d, item), []).append((-most, shift))
                best = {}
                for (d, item), shifts in lines.items():
                    doc, top = hashes[first[d] : first[d + 1]], None
                    for most, shift in sorted(shifts):  # the longest diagonals first: the others can't have more matches
                        if top and -most <= top[0]:
                            break
                        start, length, matches = overlap(doc, tokens[item], shift, tolerance)
                        if length >= needs[item] and (not top or (matches, -start - shift) > top[:2]):
                            top = (matches, -start - shift, length)
                    if top:
                        best[d, item] = top
                out += [(group[d], held[item][0], -b[1], b[2], b[0]) for (d, item), b in sorted(best.items())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in out], pa.int64())), pa.array([r[1] for r in out], pa.int64() if not out else None), *(pa.array([r[k] for r in out], pa.int64()) for k in (2, 3, 4))], names=["doc", "item", "doc_start", "n_tokens", "n_matches"])

    return find
