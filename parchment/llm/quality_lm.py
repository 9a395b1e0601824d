"""Quality by perplexity: an interpolated modified Kneser-Ney model of word pairs, trained on trusted text.

The pair counts are sharded by their first word and stay in tables of the shared folder; they are joined with the
documents' pairs shard by shard and never gathered. What is sent to every task has a fixed bound: statistics of
the VOCABULARY most frequent words and a filter of FILTER_BITS bits that holds back pairs never seen. All counts cover
all trusted text and grow with it. Pairs travel as packed arrays, a row for each block of text and shard.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from .common import shuffle_partitions, small, stored, text_or_empty

#: Words that the model knows at most: the most frequent. Others count as unknown.
VOCABULARY = 1 << 20
#: Bits of the filter of known pairs: PAIR_BITS a pair, in all FILTER_BITS at most.
FILTER_BITS, PAIR_BITS = 1 << 28, 16
#: Words of text, and rows, worked on at once.
BLOCK_WORDS = 300_000
ROWS_AT_ONCE = 500
#: Different keys that a task holds at most while it counts, before they are shuffled.
HELD_KEYS = 1 << 20
ID_BITS = np.uint64(21)
#: Of trusted documents, one in HELD_OUT (by hash of the id) sets the thresholds and isn't trained on.
HELD_OUT = 5
QUANTILE, MARGIN, LEAST_WORDS, LEAST_HELD_OUT = 0.99, 1.05, 10, 30
#: A word speaks for toxic text if it is in TOXIC_DOCS toxic documents or more and TOXIC_RATIO times as likely there as in
#: trusted ones. A document is toxic if its words' log ratios sum to TOXIC_EVIDENCE or more.
TOXIC_DOCS, TOXIC_RATIO, TOXIC_EVIDENCE = 3, 20.0, 6.0


def pack(values: np.ndarray, kind: str) -> bytes:
    """Bytes in planes of 16 bits, so that high parts, mostly equal, compress to little. Sorted uint64 go as differences."""
    if kind == "u8":
        values = np.diff(values, prepend=np.uint64(0))
    width = {"u8": 4, "u4": 2, "u2": 1}[kind]
    return np.ascontiguousarray(values.astype(f"<{kind}").view("<u2").reshape(-1, width).T).tobytes()


def unpack(data: bytes, kind: str) -> np.ndarray:
    width = {"u8": 4, "u4": 2, "u2": 1}[kind]
    out = np.ascontiguousarray(np.frombuffer(data, "<u2").reshape(width, -1).T).view(f"<{kind}").ravel()
    return np.cumsum(out, dtype=np.uint64) if kind == "u8" else out


@lru_cache(maxsize=1)
def coder():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(data: bytes) -> bytes:
    """Packed planes, whose high parts are mostly equal and whose low ones are uneven, as entropy coding shrinks them."""
    return coder()[0].compress(data)


def expanded(data: bytes) -> bytes:
    return coder()[1].decompress(data)


def tokens(batches, column: int = 1):
    """For blocks of BLOCK_WORDS words or so: (row places, document of each word, word hashes). Places index the batch."""
    from parchment.llm.hashing import word_hashes

    for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
        texts = batch.column(column).cast("binary").to_pylist()
        rows, parts, docs, n = [], [], [], 0
        for group, hashes, first in word_hashes(texts):
            docs.append(np.repeat(np.arange(len(group)) + len(rows), np.diff(first)))
            parts.append(hashes[: first[-1]])
            rows += group
            n += first[-1]
            if n > BLOCK_WORDS:
                yield batch, rows, np.concatenate(docs), np.concatenate(parts)
                rows, parts, docs, n = [], [], [], 0
        if rows:
            yield batch, rows, np.concatenate(docs), np.concatenate(parts)


def by_shard(shards: np.ndarray, count: int):
    """(shard, places) for the shards that occur; places keep their order."""
    order = np.argsort(shards, kind="stable")
    cuts = np.searchsorted(shards[order], np.arange(count + 1))
    for s in range(count):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1), append=keys[-1:] ^ np.uint64(1)))
    return keys[first[:-1]], np.add.reduceat(counts, first[:-1]) if len(keys) else counts


def merged(batches):
    """For each shard of rows sorted by (shard, ...): its keys and counts, summed."""
    import pyarrow as pa

    held, now = [], None

    def out():
        keys, counts = summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack(keys, "u8")], pa.binary()), pa.array([pack(counts, "u4")], pa.binary())], names=["shard", "keys", "counts"])

    for batch in batches:
        for s, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and s != now:
                yield out()
                held = []
            now = s
            held.append((unpack(k, "u8"), unpack(c, "u4").astype(np.int64)))
            if len(held) > 32:
                held = [summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
    if held:
        yield out()


COUNTS = "shard int, keys binary, counts binary"


def counted(rows: DataFrame, name: str) -> DataFrame:
    return stored(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(merged, COUNTS), name)


def shard_rows(keys, counts, shards, n):
    import pyarrow as pa

    made = [(s, pack(keys[at], "u8"), pack(counts[at], "u4")) for s, at in by_shard(shards, n)]
    cols = list(zip(*made, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["shard", "keys", "counts"])


def counted_in_task(blocks, shard, n: int):
    """Rows of shards of the (keys, counts) of blocks, each a block's own; blocks are summed in the task first, as many as
    have HELD_KEYS different keys, so that what is frequent is shuffled once a task and not once a block."""
    held, size = [], 0

    def taken():
        return summed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    for keys, counts in blocks:
        held.append((keys, counts))
        size += len(keys)
        if size > 2 * HELD_KEYS:
            keys, counts = taken()
            if len(keys) > HELD_KEYS:
                yield shard_rows(keys, counts, shard(keys), n)
                keys, counts = keys[:0], counts[:0]
            held, size = [(keys, counts)], len(keys)
    if size:
        keys, counts = taken()
        yield shard_rows(keys, counts, shard(keys), n)


def vocabulary(trusted: DataFrame, shards: int, most: int) -> np.ndarray:
    """Hashes, ascending, of the most frequent words: all that occur at least m times, m as low as `most` allows."""
    def count(batches):
        found = (np.unique(hashes, return_counts=True) for _, _, _, hashes in tokens(batches))
        return counted_in_task(found, lambda keys: (keys % np.uint64(shards)).astype(np.int64), shards)

    table = counted(trusted.mapInArrow(count, COUNTS), "words")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            for c in batch.column(0):
                value, n = np.unique(np.minimum(unpack(c.as_py(), "u4"), 1 << 30), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n)], names=["value", "n"])

    found = table.select("counts").mapInArrow(sizes, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    total, least = 0, 1 << 31
    for r in found.orderBy(F.desc("value")).toLocalIterator():  # stops within `most` rows
        if total + r["n"] > most:
            break
        total, least = total + r["n"], r["value"]

    def frequent(batches):
        import pyarrow as pa

        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1), strict=True):
                keys = unpack(k.as_py(), "u8")[unpack(c.as_py(), "u4") >= least]
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary())], names=["keys"])

    kept = [np.frombuffer(r["keys"], np.uint64) for r in table.select("keys", "counts").mapInArrow(frequent, "keys binary").collect()]
    shared.discard(table)
    return np.sort(np.concatenate([np.empty(0, np.uint64), *kept]))


def ids_of(hashes: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """1 + place in the vocabulary; 0 for unknown words."""
    if not len(vocab):
        return np.zeros(len(hashes), np.int64)
    at = np.searchsorted(vocab, hashes)
    at[at == len(vocab)] = 0
    return np.where(vocab[at] == hashes, at + 1, 0)


def pairs(docs: np.ndarray, ids: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Context of each word (`start` for a document's first) and the key of the pair."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.flatnonzero(np.diff(docs, prepend=-1))] = start
    return before, (before.astype(np.uint64) << ID_BITS) | ids.astype(np.uint64)


def shard_of(before: np.ndarray, shards: int) -> np.ndarray:
    return (before * 2654435761 % (1 << 32)) * shards >> 32


def slots(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    from parchment.llm.hashing import mixed

    return mixed(keys) % np.uint64(bits // shards)


def discounts(n: list[int]) -> np.ndarray:
    """Of modified Kneser-Ney for counts 0, 1, 2 and 3 or more, from the numbers of things counted 1 to 4 times; where
    those are too few, one half."""
    if min(n) <= 0:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


class Model:
    """vocab; per id: gamma (weight left to the lower order), lower (its probability), total (occurrences as context);
    d: discounts; bits: the filter; table: sharded pair counts."""

    def __init__(self, trusted: DataFrame, most: int = VOCABULARY, bits: int = FILTER_BITS) -> None:
        spark, sc = trusted.sparkSession, trusted.sparkSession.sparkContext
        self.shards = shards = max(8, shuffle_partitions(spark))
        vocab = vocabulary(trusted, shards, most)
        n, start = len(vocab) + 2, len(vocab) + 1  # 0: unknown
        words = sc.broadcast(vocab)  # freed below, once the counts are stored

        def found(batches):
            for _, _, docs, hashes in tokens(batches):
                ids = ids_of(hashes, words.value)
                yield np.unique(pairs(docs, ids, start)[1][ids > 0], return_counts=True)

        def count(batches):
            return counted_in_task(found(batches), lambda keys: shard_of((keys >> ID_BITS).astype(np.int64), shards), shards)

        self.table = counted(trusted.mapInArrow(count, COUNTS), "pairs")
        n_pairs = self.table.agg(F.sum(F.octet_length("counts") / 4)).first()[0] or 0
        bits = (min(bits, 1 << max(20, int(n_pairs * PAIR_BITS).bit_length())) // (8 * shards) + 1) * 8 * shards

        words.destroy()

        def contexts(batches):
            """Of each shard: per context the total and the numbers of pairs seen once, twice, more; the filter's bits;
            the numbers of pairs seen 1 to 4 times."""
            import pyarrow as pa

            for batch in batches:
                for s, k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    keys, counts = unpack(k, "u8"), unpack(c, "u4")
                    ctx, at = np.unique(keys >> ID_BITS, return_inverse=True)
                    stats = np.stack([np.bincount(at, counts, len(ctx)), *(np.bincount(at, np.minimum(counts, 3) == j, len(ctx)) for j in (1, 2, 3))]).astype("<f8")
                    mask = np.zeros(bits // shards, bool)
                    mask[slots(keys, shards, bits)] = True
                    ends = [int((counts == j).sum()) for j in (1, 2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([ctx.astype("<i8").tobytes()], pa.binary()), pa.array([stats.tobytes()], pa.binary()), pa.array([np.packbits(mask).tobytes()], pa.binary()), pa.array([ends], pa.list_(pa.int64()))], names=["s", "ctx", "stats", "bits", "ends"])

        total, seen, filter_, ends = np.zeros(n), np.zeros((3, n)), np.zeros((shards, bits // shards // 8), np.uint8), np.zeros(4, np.int64)
        for r in self.table.mapInArrow(contexts, "s int, ctx binary, stats binary, bits binary, ends array<long>").toLocalIterator():
            ctx, stats = np.frombuffer(r["ctx"], "<i8"), np.frombuffer(r["stats"], "<f8").reshape(4, -1)
            total[ctx], seen[:, ctx] = stats[0], stats[1:]
            filter_[r["s"]] = np.frombuffer(r["bits"], np.uint8)
            ends += r["ends"]

        width = 1 << 16  # ids a slice

        def continuations(batches):
            """Distinct contexts of each word, by slices of the ids, summed over the shards of a task first."""
            import pyarrow as pa

            held = np.zeros(n, np.int64)
            for batch in batches:
                for k in batch.column(0):
                    held += np.bincount((unpack(k.as_py(), "u8") & ((np.uint64(1) << ID_BITS) - np.uint64(1))).astype(np.int64), minlength=n)
            for i in range(0, n, width):
                if held[i : i + width].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([held[i : i + width].astype("<u4").tobytes()], pa.binary())], names=["slice", "held"])

        def added(batches):
            import pyarrow as pa

            sums = {}
            for batch in batches:
                for i, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[i] = sums.get(i, 0) + np.frombuffer(held, "<u4").astype(np.int64)
            for i, held in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([held.astype("<i8").tobytes()], pa.binary())], names=["slice", "held"])

        follows = np.zeros(n, np.int64)
        slices = self.table.select("keys").mapInArrow(continuations, "slice long, held binary").repartition("slice")
        for r in slices.mapInArrow(added, "slice long, held binary").toLocalIterator():
            found = np.frombuffer(r["held"], "<i8")
            follows[r["slice"] : r["slice"] + len(found)] = found
        self.d = d = discounts(ends.tolist())
        with np.errstate(divide="ignore", invalid="ignore"):
            gamma = np.where(total > 0, (d[1] * seen[0] + d[2] * seen[1] + d[3] * seen[2]) / total, 1.0)
            less = discounts([int((follows == j).sum()) for j in (1, 2, 3, 4)])[np.minimum(follows, 3)]
            whole = max(1, follows.sum())
            lower = (follows - less) / whole + (less.sum() / whole if follows.any() else 1.0) / (len(vocab) + 1)
        self.send = sc.broadcast({"vocab": vocab, "gamma": gamma, "lower": lower, "total": total, "d": d, "bits": filter_.ravel(), "n_bits": bits, "start": start})


    def close(self) -> None:
        """Frees what was sent to the tasks and the pair counts; scores that aren't stored by then can't be computed any more."""
        self.send.destroy()
        shared.discard(self.table)


REQUESTS = "shard int, kind int, block long, keys binary, data binary, n int, ids array<{kind}>, langs array<string>, words array<long>, base array<double>, marks array<long>"


def scores(docs: DataFrame, model: Model, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, n_words, log_p, mark): the natural log probability of each document's words; mark is its text's hash."""
    shards, send, kind = model.shards, model.send, docs.schema[id_col].dataType.simpleString()
    schema = REQUESTS.format(kind=kind)

    def request(batches):
        """A row a block with its documents and what needs no count, and a row a shard with the pairs that may have one."""
        import pyarrow as pa
        from pyspark import TaskContext

        m, task, number = send.value, TaskContext.get().partitionId(), 0
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), None, pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
        for batch, rows, docs_, hashes in tokens(batches, 2):
            block, number = (task << 32) + number, number + 1
            ids = ids_of(hashes, m["vocab"])
            before, key = pairs(docs_, ids, m["start"])
            base = np.bincount(docs_, np.log(m["gamma"][before] * m["lower"][ids]), len(rows))
            where, slot = shard_of(before, shards), slots(key, shards, m["n_bits"])
            place = where * (m["n_bits"] // shards) + slot.astype(np.int64)
            maybe = np.flatnonzero((ids > 0) & ((m["bits"][place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool))
            maybe = maybe[np.argsort(key[maybe])]
            taken, types = pa.array(rows, pa.int64()), [*kinds[:6], pa.list_(batch.column(0).type), *kinds[7:]]
            out = [(block % shards, 1, block, None, None, len(rows), batch.column(0).take(taken).to_pylist(), batch.column(1).take(taken).to_pylist(), np.bincount(docs_, minlength=len(rows)).tolist(), base.tolist(), batch.column(3).take(taken).to_pylist())]
            for s, at in by_shard(where[maybe], shards):
                out.append((s, 1, block, squeezed(pack(key[maybe[at]], "u8")), squeezed(pack(docs_[maybe[at]], "u2")), len(rows), None, None, None, None, None))
            for i in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 16], strict=True), types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    def answer(batches):
        """What the counts add to the blocks' documents; the shard's table comes first."""
        import pyarrow as pa
        import pyarrow.compute

        m, now, keys, counts = send.value, None, np.empty(0, np.uint64), None
        for batch in batches:
            sums = []
            for s, k, key, data, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if k == 0:
                    now, keys, counts = s, unpack(key, "u8"), unpack(data, "u4")
                elif key is not None and now == s and len(keys):
                    asked, docs_ = unpack(expanded(key), "u8"), unpack(expanded(data), "u2")
                    at = np.searchsorted(keys, asked)
                    at[at == len(keys)] = 0
                    hit = keys[at] == asked
                    ctx, word, c = (asked[hit] >> ID_BITS).astype(np.int64), (asked[hit] & np.uint64((1 << 21) - 1)).astype(np.int64), counts[at[hit]].astype(np.int64)
                    more = np.log1p((c - m["d"][np.minimum(c, 3)]) / m["total"][ctx] / (m["gamma"][ctx] * m["lower"][word]))
                    sums.append(np.bincount(docs_[hit], more, n).astype("<f8").tobytes())
                    continue
                sums.append(None)
            out = pa.RecordBatch.from_arrays([batch.column(2), pa.array(sums, pa.binary()), *(batch.column(i) for i in (6, 7, 8, 9, 10))], names=["block", "sums", "ids", "langs", "words", "base", "marks"])
            yield out.filter(pa.compute.or_(pa.compute.is_valid(out.column(1)), pa.compute.is_valid(out.column(2))))

    def finish(batches):
        import pyarrow as pa

        held, rest = {}, {}

        def done(i):
            ids, langs, words, marks, base = rest.pop(i)
            return pa.RecordBatch.from_arrays([ids, langs, words, pa.array(np.asarray(base) + held.pop(i, 0.0)), marks], names=["id", "lang", "n_words", "log_p", "mark"])

        now = None
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column(0)[r].as_py()
                if now is not None and block != now:
                    yield done(now)
                now = block
                if (sums := batch.column(1)[r].as_py()) is not None:
                    held[block] = held.get(block, 0.0) + np.frombuffer(sums, "<f8")
                if batch.column(2)[r].is_valid:
                    rest[block] = [*(batch.column(i)[r].values for i in (2, 3, 4, 6)), batch.column(5)[r].as_py()]
        if now is not None:
            yield done(now)

    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"), F.xxhash64(text_or_empty(text_col)).alias("mark"))
    asked = rows.mapInArrow(request, schema)
    table = model.table.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "keys", F.col("counts").alias("data"))
    both = table.unionByName(asked, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "kind")
    answers = both.mapInArrow(answer, f"block long, sums binary, ids array<{kind}>, langs array<string>, words array<long>, base array<double>, marks array<long>")
    return answers.repartition("block").sortWithinPartitions("block").mapInArrow(finish, f"id {kind}, lang string, n_words long, log_p double, mark long")


def occurrences(rows: DataFrame) -> DataFrame:
    """(mark, word) for the different words of each of the rows (mark, text), hashed; ASCII letters in lower case, ASCII
    punctuation left out."""

    def run(batches):
        import pyarrow as pa

        from parchment.llm.decontaminate import normalized
        from parchment.llm.hashing import word_hashes

        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            for group, hashes, first in word_hashes([normalized(t.as_py()) for t in batch.column(1)]):
                docs = np.repeat(np.asarray(group), np.diff(first))
                order = np.lexsort((hashes, docs))
                docs, words = docs[order], hashes[order]
                new = np.ones(len(docs), bool)
                new[1:] = (docs[1:] != docs[:-1]) | (words[1:] != words[:-1])
                marks = batch.column(0).take(pa.array(docs[new], pa.int64()))
                yield pa.RecordBatch.from_arrays([marks, pa.array(words[new].view(np.int64))], names=["mark", "word"])

    return rows.select("mark", "text").mapInArrow(run, "mark long, word long")


def toxic_words(toxic: DataFrame, trusted: DataFrame) -> DataFrame:
    """(word, evidence) of the words that speak for toxic text: the log ratio of a word's probabilities under the lower
    order (words by the documents that they occur in, discounted by a half, and one half for a word never seen) of toxic
    and of trusted text. Both tables are rows (mark, text); counts cover all of them, words are joined, not gathered."""
    n_toxic, n_trusted = toxic.count(), trusted.count()
    often = stored(occurrences(toxic).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TOXIC_DOCS), "toxic")
    here = occurrences(trusted).join(small(often.select("word"), 16), "word").groupBy("word").agg(F.count("*").alias("m"))
    ratio = ((F.col("n") - 0.5) / max(1, n_toxic)) / ((F.coalesce("m", F.lit(0)) + 0.5) / max(1, n_trusted))
    found = often.join(here, "word", "left").select("word", F.log(ratio).alias("evidence"))
    return stored(found.where(F.col("evidence") >= float(np.log(TOXIC_RATIO))), "toxic")


def toxic_evidence(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(mark, evidence) of the texts of the rows (mark, text) that have any of the `words`, each word once a text."""
    found = occurrences(rows).join(small(words, 24), "word").groupBy("mark", "word").agg(F.first("evidence").alias("evidence"))
    return found.groupBy("mark").agg(F.sum("evidence").alias("evidence"))


def held_out(column: str):
    return F.pmod(F.xxhash64(column), F.lit(HELD_OUT)) == 0


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, vocabulary_size: int = VOCABULARY, key_col: str | None = None) -> DataFrame:
    """One row a document: id_col (or key_col, a key of the row), lang, n_words, perplexity (per word; null without
    words), threshold, toxic_evidence, kept.

    Trusted are the documents that `labels` (id_col, quality, toxic) gives quality 1 and toxic 0. Four fifths of them,
    all of their words, train the model; the others' log perplexities give each language's threshold: their `quantile`
    times `margin` (all languages' where a language has fewer than LEAST_HELD_OUT of them or is null). Perplexity tells
    junk, but a few toxic words change it little, so the words that labelled toxic documents have and trusted ones don't
    are weighed too: see `toxic_words`. Their sum in a text is toxic_evidence; its limit is TOXIC_EVIDENCE or, if larger,
    the same quantile of the held-out documents' own.

    A document is kept if its perplexity is at most the threshold or it has fewer than LEAST_WORDS words, which are too
    few to judge, and if its toxic evidence is below its limit (at any length). Without trusted text perplexity rejects
    nothing, without toxic labels nothing is toxic. Null and empty texts have no words and are kept; repeated rows are
    repeated; very long texts are worked on whole, as arrays of one task; empty tables give an empty result; other
    columns are ignored. The labelled ids are broadcast only if their counted size allows, and joined by a shuffle beyond.
    """
    labelled = lambda which: labels.where(which).select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    good = labelled("quality = 1 AND toxic = 0")
    text = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    trained = text.join(small(good.where(~held_out("id")), 16), "id", "left_semi")
    model = Model(trained, vocabulary_size)
    found = stored(scores(docs, model, key_col or id_col, text_col, lang_col), "scores")
    model.close()
    marked = lambda rows: rows.select(F.xxhash64("text").alias("mark"), "text")
    toxic = toxic_words(marked(text.join(small(labelled("toxic = 1"), 16), "id", "left_semi")), marked(trained))
    evidence = stored(toxic_evidence(marked(text), toxic), "evidence")
    found = found.join(small(evidence, 16), "mark", "left").withColumn("toxic_evidence", F.coalesce("evidence", F.lit(0.0)))
    found = found.withColumn("log_ppl", F.when(F.col("n_words") > 0, -F.col("log_p") / F.col("n_words")))
    aside = small(good.where(held_out("id")), 16)
    if key_col:
        aside = small(stored(docs.select(F.col(id_col).alias("id"), F.col(key_col).alias("key")).join(aside, "id", "left_semi").select(F.col("key").alias("id")), "aside"), 16)
    marks = found.where(F.col("n_words") >= LEAST_WORDS).join(aside, "id", "left_semi")
    limit = (F.percentile_approx("log_ppl", quantile, 10000) * margin).alias("limit")
    most = F.greatest(F.percentile_approx("toxic_evidence", quantile, 10000), F.lit(TOXIC_EVIDENCE)).alias("most")
    by_lang = marks.where("lang IS NOT NULL").groupBy("lang").agg(limit, most, F.count("*").alias("n")).where(F.col("n") >= LEAST_HELD_OUT).drop("n")
    for_all = marks.agg(limit.alias("limit_all"), F.coalesce(most, F.lit(TOXIC_EVIDENCE)).alias("most_all"))
    out = found.join(small(by_lang, 40), "lang", "left").crossJoin(F.broadcast(for_all))
    out = out.withColumns({"limit": F.coalesce("limit", "limit_all"), "most": F.coalesce("most", "most_all")})
    plain = F.coalesce((F.col("n_words") < LEAST_WORDS) | (F.col("log_ppl") <= F.col("limit")), F.lit(True))
    kept = plain & (F.col("toxic_evidence") < F.col("most"))
    return out.select(F.col("id").alias(key_col or id_col), "lang", "n_words", F.exp("log_ppl").alias("perplexity"), F.exp("limit").alias("threshold"), "toxic_evidence", kept.alias("kept"))
