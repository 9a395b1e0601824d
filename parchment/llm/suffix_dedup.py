"""Removal of long repeated substrings with a run-length index.

Two equal strings of LENGTH bytes choose the same anchor: the gram of GRAM bytes with the least hash in them. So every
window of LENGTH bytes belongs to one anchor occurrence, windows can only be equal under equal anchors, and an anchor
that occurs once needs no more work. For the others the text around each occurrence goes to a task by anchor. There an
index is built of all windows of an anchor: the Burrows-Wheeler transform of the occurrences, aligned at the anchor, is
taken place by place from right to left. Its symbols come in runs, as the occurrences are alike, and only runs are
sorted to step one place to the left; sampled at the run ends, the lengths of common prefixes of neighbours in suffix
order pass on, and within a run they grow by one. The larger of a row's two neighbour values is its matching
statistic, the longest match that starts there and also elsewhere; where it reaches LENGTH, the window is marked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

LENGTH, GRAM = 400, 100
#: Bits of the filters of anchors that occur twice, and over CAP times: ANCHOR_BITS an anchor, FILTER_BITS in all at most.
FILTER_BITS, ANCHOR_BITS = 1 << 28, 16
#: Occurrences of an anchor that one task takes at most; beyond, windows are counted by a 128-bit hash (see `hot_spans`).
CAP = 150_000
PIECE, AT = 1 << 21, np.uint64(24)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """For groups of texts: (joined bytes, text of each occurrence, place in that text of the group's place 0, first and
    last window start, anchor place, hash), places in the joined bytes."""
    from .hashing import INVERSE, groups, mixed, powers, prefix

    pieces = [(i, a, t[a : a + PIECE + length - 1]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - length + 1), PIECE) if len(t) - a >= length]
    width = length - gram + 1
    low = (np.uint64(1) << AT) - np.uint64(1)
    for group in groups([p[2] for p in pieces]):
        held = [pieces[k] for k in group]
        buffer = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
        begins = np.cumsum([0] + [len(p[2]) for p in held])
        sums = prefix(buffer)
        hashes = mixed((sums[gram:] - sums[:-gram]) * powers(INVERSE, len(buffer) - gram + 1))
        key = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))  # of equal hashes the last place
        span = 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :]) if width > span else key
        place = (low - (key & low)).astype(np.int64)
        start = np.arange(len(place))
        piece = np.searchsorted(begins, start, "right") - 1
        ok = start + length <= begins[piece + 1]
        start, place, piece = start[ok], place[ok], piece[ok]
        if not len(start):
            continue
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
        first, last, at = start[new], start[np.append(new[1:], len(start)) - 1], place[new]
        owner = piece[new]
        text = np.array([p[0] for p in held])[owner]
        base = np.array([p[1] for p in held])[owner] - begins[owner]
        yield buffer, text, base, first, last, at, hashes[at]


def bit_filter(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap with the places of all values of a long column set, built in slices by as many tasks."""
    slices = 64
    bits = min(bits, 1 << max(15, (values.count() * ANCHOR_BITS).bit_length()))

    def build(batches):
        import pyarrow as pa

        from parchment.llm.hashing import mixed

        held = {}
        for batch in batches:
            at = mixed(batch.column(1).to_numpy().view(np.uint64)) % np.uint64(bits // slices)
            where = batch.column(0).to_numpy()
            for s in np.unique(where).tolist():
                held.setdefault(s, np.zeros(bits // slices // 8, np.uint8))
                places = at[where == s]
                np.bitwise_or.at(held[s], (places >> np.uint64(3)).astype(np.int64), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
        for s, data in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["s", "data"])

    out = np.zeros((slices, bits // slices // 8), np.uint8)
    rows = values.select(F.pmod(F.col(column), F.lit(slices)).cast("int").alias("s"), F.col(column).alias("v"))
    for r in rows.repartition("s").mapInArrow(build, "s int, data binary").toLocalIterator():
        out[r["s"]] |= np.frombuffer(r["data"], np.uint8)
    return out


def in_filter(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    from .hashing import mixed

    slices, size = filter_.shape
    at = mixed(values) % np.uint64(size * 8)
    s = (values.view(np.int64) % slices).astype(np.int64)
    return (filter_[s, (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class RunIndex:
    """Rows of several anchors, each aligned at its anchor: matching statistics within each anchor's rows.

    text: the rows' bytes joined; begin, end: each row's stretch; at: place of the anchor in the row; group: ascending.
    """

    def __init__(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, group: np.ndarray) -> None:
        self.text, self.begin, self.end, self.group = text, begin, end, group.astype(np.int64)
        self.anchor = begin + at

    def marked(self, length: int):
        """Yields (place relative to the anchor, rows) where a match of `length` starts that also starts in another row."""
        n = len(self.begin)
        order, common = np.arange(n), np.zeros(n, np.int32)  # common[i]: prefix shared by order[i - 1] and order[i]
        low, high = int((self.begin - self.anchor).min()), int((self.end - self.anchor).max())
        for place in range(high - 1, low - 1, -1):
            at = self.anchor[order] + place
            inside = (at >= self.begin[order]) & (at < self.end[order])
            symbol = np.where(inside, self.text[np.where(inside, at, 0)].astype(np.int64), 256)
            key = self.group[order] * 257 + symbol
            heads = np.flatnonzero(np.diff(key, prepend=-1))  # runs of the transform at this place
            ends = np.append(heads[1:], n)
            run_key, sizes = key[heads], ends - heads
            moved = np.argsort(run_key, kind="stable")  # runs, not rows, are sorted
            shifts = np.repeat(heads[moved] - np.cumsum(np.append(0, sizes[moved][:-1])), sizes[moved])
            source = np.arange(n) + shifts
            grown = common[source] + 1
            new_heads = np.cumsum(np.append(0, sizes[moved][:-1]))
            # a run's first row: one more than the least between the end of the run before it, of its key, and itself
            same = np.flatnonzero(run_key[moved][1:] == run_key[moved][:-1]) + 1
            grown[new_heads] = 0
            if len(same):
                grown[new_heads[same]] = 1 + self._least(np.minimum.reduceat(common, heads), common[heads], moved[same - 1] + 1, moved[same])
            grown[symbol[source] == 256] = 0
            order, common = order[source], grown
            longest = np.maximum(common, np.append(common[1:], 0))
            if (hit := longest >= length).any():
                yield place, order[hit]

    @staticmethod
    def _least(runs: np.ndarray, at_head: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(runs[a:b], at_head[b]) for each pair, by a table of doubling spans."""
        out, gap = at_head[b].copy(), b - a
        table, span = runs, 1
        while True:
            here = np.flatnonzero((gap >= span) & (gap < 2 * span))
            if len(here):
                out[here] = np.minimum(out[here], np.minimum(table[a[here]], table[b[here] - span]))
            if not (gap >= 2 * span).any():
                return out
            table, span = np.minimum(table[:-span], table[span:]), 2 * span


SEGMENTS = "h long, tid binary, start long, at int, seg binary"
SPANS = "tid binary, start long, stop long"


def _segments(length, gram, keep, drop):
    """Rows of SEGMENTS for the anchors that `keep` has and `drop` hasn't."""

    def run(batches):
        import pyarrow as pa

        known, hot = keep.value, drop.value if drop else None
        done = set()  # texts with copies are sent once a task
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            ids = batch.column(0).to_pylist()
            new = []
            for i, tid in enumerate(ids):
                if tid not in done:
                    new.append(i)
                    done.add(tid)
            if len(done) > 1_000_000:
                done = set()
            for buffer, text, base, first, last, at, hashes in anchors([texts[i] for i in new], length, gram):
                ok = in_filter(known, hashes)
                if hot is not None:
                    ok &= ~in_filter(hot, hashes)
                pick = np.flatnonzero(ok)
                if not len(pick):
                    continue
                raw = buffer.tobytes()
                segs = [raw[a : b + length] for a, b in zip(first[pick].tolist(), last[pick].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes[pick].view(np.int64)), pa.array([ids[new[i]] for i in text[pick].tolist()], pa.binary()), pa.array(first[pick] + base[pick]),
                    pa.array((at - first)[pick].astype(np.int32)), pa.array(segs, pa.binary()),
                ], names=["h", "tid", "start", "at", "seg"])

    return run


def _matches(length, rows_at_once=40_000, bytes_at_once=24 << 20):
    """Spans of the windows that occur more than once, from SEGMENTS sorted by (h, seg)."""

    def index(rows):
        """rows: lists (h, tid, start, at, seg), distinct segments, ascending in h."""
        import pyarrow as pa

        if not rows:
            return None
        h = np.array([r[0] for r in rows])
        alone = np.ones(len(rows), bool)
        same = np.flatnonzero(h[1:] == h[:-1])
        alone[same] = alone[same + 1] = False
        rows = [r for r, a in zip(rows, alone.tolist(), strict=True) if not a]
        if not rows:
            return None
        h, sizes = h[~alone], np.array([len(r[4]) for r in rows])
        end = np.cumsum(sizes)
        group = np.cumsum(np.diff(h, prepend=h[:1]) != 0)
        at = np.array([r[3] for r in rows])
        made = RunIndex(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), end - sizes, end, at, group)
        found = [(np.full(len(who), place), who) for place, who in made.marked(length)]
        if not found:
            return None
        place, who = (np.concatenate(x) for x in zip(*found, strict=True))
        offset = place + at[who]
        order = np.lexsort((offset, who))
        who, offset = who[order], offset[order]
        cut = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(offset, prepend=-9) != 1))
        first, last, row = offset[cut], offset[np.append(cut[1:], len(offset)) - 1], who[cut]
        start = np.array([r[2] for r in rows])[row]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in row.tolist()], pa.binary()), pa.array(start + first), pa.array(start + last + length)], names=["tid", "start", "stop"])

    def run(batches):
        import pyarrow as pa

        rows, size, whole = [], 0, []

        def flush():
            made = []
            if whole:
                made.append(pa.RecordBatch.from_arrays([pa.array([r[1] for r in whole], pa.binary()), pa.array([r[2] for r in whole], pa.int64()), pa.array([r[2] + len(r[4]) for r in whole], pa.int64())], names=["tid", "start", "stop"]))
                whole.clear()
            return made

        told = True
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and r[0] == rows[-1][0] and r[4] == rows[-1][4]:  # equal segments: one row, all of each is repeated
                    if not told:
                        whole.append(rows[-1])
                        told = True
                    whole.append(r)
                    continue
                if rows and r[0] != rows[-1][0] and (len(rows) > rows_at_once or size > bytes_at_once):
                    if (out := index(rows)) is not None:
                        yield out
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
                told = False
            yield from flush()
        if (out := index(rows)) is not None:
            yield out
        yield from flush()

    return run


def hot_spans(texts: DataFrame, hot, length: int, gram: int) -> DataFrame:
    """Spans under the anchors of the filter `hot`: their windows are counted by two 64-bit hashes, partly aggregated
    before the shuffle, and the repeated ones joined back."""

    def windows(batches):
        import pyarrow as pa

        from parchment.llm.hashing import INVERSE, VALUES, powers, prefix, stretch

        held = hot.value
        other = np.random.default_rng(21).permutation(VALUES)
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), [t.as_py() for t in batch.column(1)]
            for buffer, text, base, first, last, _, hashes in anchors(raw, length, gram):
                pick = np.flatnonzero(in_filter(held, hashes))
                if not len(pick):
                    continue
                sizes = (last - first + 1)[pick]
                owner = np.repeat(pick, sizes)
                start = np.repeat(first[pick] - np.cumsum(np.append(0, sizes[:-1])), sizes) + np.arange(sizes.sum())
                inverse = powers(INVERSE, len(buffer) + 1)
                pair = [stretch(prefix(buffer, v), start, start + length, inverse).view(np.int64) for v in (VALUES, other)]
                for i in range(0, len(start), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0][part]), pa.array(pair[1][part]), pa.array([ids[k] for k in text[owner[part]].tolist()], pa.binary()), pa.array((start + base[owner])[part])], names=["h", "h2", "tid", "start"])

    rows = stored(texts.mapInArrow(windows, "h long, h2 long, tid binary, start long").distinct(), "windows")
    repeated = rows.groupBy("h", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h", "h2")
    return rows.join(repeated, ["h", "h2"]).select("tid", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cap: int = CAP, text_col: str = "text") -> DataFrame:
    """(tid, start, stop): byte spans of the texts, tid the MD5 of their bytes, that repeated strings of `length` bytes
    cover. A text that several documents have is covered whole if it is long enough."""
    spark = docs.sparkSession
    raw = F.encode(text_or_empty(text_col), "utf-8")
    texts = docs.where(F.octet_length(text_col) >= length).select(F.unhex(F.md5(raw)).alias("tid"), raw.alias("text"))

    def hashes(batches):
        import pyarrow as pa

        for batch in batches:
            found = [a[-1] for a in anchors([t.as_py() for t in batch.column(1)], length, gram)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    several = stored(texts.mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    known = spark.sparkContext.broadcast(bit_filter(several, "h", FILTER_BITS))
    hot = several.where(F.col("n") > cap)
    dropped = spark.sparkContext.broadcast(bit_filter(hot, "h", FILTER_BITS)) if hot.limit(1).count() else None
    segments = texts.mapInArrow(_segments(length, gram, known, dropped), SEGMENTS)
    # a text's copies in other tasks send the same rows again
    spans = segments.repartition("h").sortWithinPartitions("h", "seg", "tid", "start").mapInArrow(_matches(length), SPANS)
    if dropped:
        spans = spans.unionByName(hot_spans(texts, dropped, length, gram))
    copies = texts.groupBy("tid").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("stop")).where("n > 1")
    return spans.unionByName(copies.select("tid", F.lit(0).cast("long").alias("start"), "stop"))


RESULT = "id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, cap: int = CAP, with_text: bool = False) -> DataFrame:
    """One row a document: id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with_text
    kept (the remaining bytes).

    Each byte is removed that a string of `length` bytes covers which also starts anywhere else, in the same document
    or another; overlaps count, matches never cross documents, and strings are judged on the input. Null counts as
    empty; texts shorter than `length` stay; very long texts are worked on whole, each in one task; repeated rows are
    copies of each other; an empty table gives an empty result; other columns of docs are ignored.
    """
    spans = stored(repeated_spans(docs, length, gram, cap, text_col), "spans")
    by_text = spans.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for id_, text, found in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = []
                for s in found or ():
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["stop"])
                    else:
                        runs.append([s["start"], s["stop"]])
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
                del id_
            cols = list(zip(*out, strict=True)) or [()] * (5 if with_text else 4)
            types = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    raw = F.encode(text_or_empty(text_col), "utf-8")
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("text"), F.unhex(F.md5(raw)).alias("tid")).join(by_text, "tid", "left").select("id", "text", "spans")
    out = rows.mapInArrow(cut, RESULT.format(kind=kind) + (", kept binary" if with_text else ""))
    return out.withColumnRenamed("id", id_col)
