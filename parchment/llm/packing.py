"""Packing token sequences: pieces above a third of the capacity are matched in pairs, smaller ones best-fit the gaps.

All pieces of one length are alike, so the plan is made from the number of pieces of each length, which has no more rows
than the capacity has tokens, however large the corpus is. Bins of one history are ranges of numbers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from .common import prefix_sum, shared_path, small, stored, text_or_empty

CAPACITY = 2048
#: size, first rank, end of ranks, first bin, pieces a bin, offset of the first piece in its bin.
Placing = tuple[int, int, int, int, int, int]


class Gaps:
    """Ranges of bins by the room that is left in each bin of the range: the tightest that suffices is found by bisection."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, end: int) -> None:
        if first < end and room:
            if room not in self.ranges:
                insort(self.rooms, room)
            self.ranges.setdefault(room, []).append((first, end))

    def tightest(self, size: int) -> tuple[int, int, int] | None:
        """(room, first, end) of a range of bins with the least room of `size` or more; it leaves the gaps."""
        i = bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        first, end = self.ranges[room].pop()
        if not self.ranges[room]:
            del self.ranges[room], self.rooms[i]
        return room, first, end


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placing], int]:
    """Placings of `counts` pieces of each size (1 to capacity), and the number of bins.

    Pieces above a third of the capacity, at most two of which fit a bin, are matched greedily: the largest that is left
    with the largest other that fits beside it, which for such pieces needs the fewest bins. Then the smaller ones, largest
    first, each enter the bin with the least room that suffices, or a new one. The placings are those of going piece by
    piece; that pieces of a size and bins of a history go together only bounds the work by the capacity.
    """
    out, taken, left, bins, gaps = [], dict.fromkeys(counts, 0), dict(counts), 0, Gaps()

    def place(size: int, n: int, first: int, per_bin: int, offset: int) -> None:
        out.append((size, taken[size], taken[size] + n, first, per_bin, offset))
        taken[size] += n
        left[size] -= n

    large = sorted(s for s in counts if 3 * s > capacity)
    while large:
        size = large[-1]
        fits = large[: bisect_right(large, capacity - size)]
        if fits and fits[-1] == size and left[size] == 1:
            fits.pop()
        if fits and fits[-1] == size:
            n, other = left[size] // 2, size
        elif fits:
            n, other = min(left[size], left[fits[-1]]), fits[-1]
        else:
            n, other = left[size], 0
        place(size, n, bins, 1, 0)
        if other:
            place(other, n, bins, 1, size)
        gaps.add(capacity - size - other, bins, bins + n)
        bins += n
        large = [s for s in large if left[s]]
    for size in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[size]:
            room, first, end = gaps.tightest(size) or (capacity, bins, bins + -(-left[size] // (capacity // size)))
            bins = max(bins, end)
            fit, offset = room // size, capacity - room
            full = min(end - first, left[size] // fit)
            if full:
                place(size, full * fit, first, fit, offset)
                gaps.add(room - fit * size, first, first + full)
            if left[size] and first + full < end:  # the last bin of the size takes fewer
                n = left[size]
                place(size, n, first + full, n, offset)
                gaps.add(room - n * size, first + full, first + full + 1)
                full += 1
            gaps.add(room, first + full, end)
    return out, bins


def write_pieces(docs: DataFrame, path: str, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes (row, doc_id, piece, start, length, ids_crc32, ids) to `path`: ids are the encoding of the whole text (null: empty)
    and end_id, ids_crc32 is the unsigned checksum of a piece's ids as little-endian unsigned 32-bit integers. Documents longer
    than the capacity are cut into pieces of the capacity, of which the first may be shorter."""

    def encode(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        from parchment.llm.chunked_encoding import id_bytes

        encoder, end = id_bytes(tokenizer_path), np.uint32(end_id).tobytes()
        for batch in batches:
            start, texts = 0, batch.column(2).to_pylist()
            while start < batch.num_rows:  # a few MB of text at a time
                stop, size = start, 0
                while stop < batch.num_rows and size < 4 << 20:
                    size += len(texts[stop])
                    stop += 1
                at, piece, before, lengths, crc, flat = [], [], [], [], [], []
                for i, made in enumerate(encoder.folded(texts[start:stop]), start):
                    made += end
                    n = len(made) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    at += [i] * (len(cuts) - 1)
                    piece += range(len(cuts) - 1)
                    before += cuts[:-1]
                    lengths += [b - a for a, b in zip(cuts, cuts[1:])]
                    crc += [zlib.crc32(made[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
                    flat.append(made)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))
                rows = batch.select([0, 1]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(piece, pa.int32()), pa.array(before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()), ids], names=["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                start = stop

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(encode, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>")
    with shared.shuffles_removed(docs.sparkSession):
        out.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (row, piece, doc_id, length) with sequence_id and offset.

    The driver sees how many pieces each length has, at most `capacity` numbers, and plans placings of ranges of ranks; a
    piece's rank among those of its length is a running number over ranges that split a frequent length. The placings
    are joined by length and rank, broadcast if their counted rows allow.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    placings, _ = plan(counts, capacity)
    ranked = prefix_sum(pieces.select("row", "doc_id", "piece", "length"), "length", ["doc_id", "row", "piece"], None, "rank")
    schema = "length long, first_rank long, end_rank long, first_bin long, per_bin long, at long"
    table = pieces.sparkSession.createDataFrame(placings, schema)
    found = ranked.join(small(table, 48), "length").where("rank >= first_rank AND rank < end_rank")
    nth = F.col("rank") - F.col("first_rank")
    sequence = F.col("first_bin") + F.floor(nth / F.col("per_bin"))
    return found.select("row", "doc_id", "piece", sequence.cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("per_bin") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Packs documents into sequences of at most `capacity` tokens: (pieces, places).

    pieces: row, doc_id, piece, start, length, ids_crc32, ids, as written to `path` (the shared folder unless it is given);
    places: row, doc_id, piece, sequence_id, offset. Joined by row and piece they are the packed corpus, see `sequences`; what
    needs only the checksums reads no ids, see `digests`. Null and empty texts are the end id alone; repeated rows and
    rows of a null id are packed each; a text is encoded in blocks, its ids take 4 bytes each in its task; an empty
    table gives an empty result; other columns of docs are ignored.
    """
    path = path or shared_path(docs.sparkSession, "pieces")
    write_pieces(docs, path, tokenizer_path, capacity, end_id, id_col, text_col)
    pieces = docs.sparkSession.read.parquet(path)
    return pieces, placed(pieces, capacity)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id and ids: each sequence's pieces put together in order, at most a capacity of ids and so of pieces."""
    both = pieces.join(places.drop("doc_id"), ["row", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))["ids"]
    return both.groupBy("sequence_id").agg(F.flatten(parts).alias("ids"))


def digests(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece; the ids are not read."""
    read = pieces.select("row", "piece", "start", "length", "ids_crc32")
    return read.join(places, ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
