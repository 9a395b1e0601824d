"""Boxes of text joined to paragraphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Boxes are near if the gaps between them are at most so many of their mean height, across and down.
NEAR_X, NEAR_Y = 1.0, 0.5
#: Boxes whose middles are within so many heights are of one line.
SAME_LINE = 0.4
#: Boxes of a document that are all compared with each other.
ALL_PAIRS = 32


def changes(ids) -> np.ndarray:
    """Whether each of the Arrow column's values but the first differs from the one before; nulls are equal."""
    import pyarrow.compute as pc

    a, b = ids.slice(0, len(ids) - 1), ids.slice(1)
    same = pc.fill_null(pc.equal(a, b), False)
    return ~pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def components(boxes: np.ndarray, near_x: float = NEAR_X, near_y: float = NEAR_Y) -> np.ndarray:
    """The number of the first box of each box's paragraph; boxes: rows of left, top, right, bottom.

    A sweep down the page: a box is compared with those above that end near enough, among which it is joined to the near
    ones by union-find.
    """
    up = np.arange(len(boxes))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    height = boxes[:, 3] - boxes[:, 1]
    reach = near_y * height.max(initial=0)  # no pair has a larger mean height
    active: list[int] = []
    for i in np.argsort(boxes[:, 1], kind="stable").tolist():
        active = [j for j in active if boxes[j, 3] + reach >= boxes[i, 1]]
        if active:
            j = np.array(active)
            mean = (height[j] + height[i]) / 2
            across = np.maximum(boxes[j, 0], boxes[i, 0]) - np.minimum(boxes[j, 2], boxes[i, 2])
            down = np.maximum(boxes[j, 1], boxes[i, 1]) - np.minimum(boxes[j, 3], boxes[i, 3])
            for other in j[(across <= near_x * mean) & (down <= near_y * mean)].tolist():
                a, b = sorted((root(i), root(other)))
                up[b] = a
        active.append(i)
    return np.array([root(i) for i in range(len(boxes))], int)


def reading_order(boxes: np.ndarray) -> list[int]:
    """Line by line, each from left to right: a line is the topmost box that is left and those whose middles are near its own."""
    rows, heights = boxes.tolist(), boxes[:, 3] - boxes[:, 1]
    height = sum(heights.tolist()) / len(rows) if len(rows) < 8 else heights.mean()
    middle = [(r[1] + r[3]) / 2 for r in rows]
    left, out = sorted(range(len(rows)), key=middle.__getitem__), []
    while left:
        line = [i for i in left if middle[i] - middle[left[0]] < SAME_LINE * height or i == left[0]]
        out += sorted(line, key=lambda i: (rows[i][0], i))
        left = left[len(line) :]
    return out


def components_of_all(boxes: np.ndarray, first: np.ndarray, size: np.ndarray, near_x: float = NEAR_X, near_y: float = NEAR_Y) -> np.ndarray:
    """As `components`, of the boxes of many documents at once, that begin at `first` and have `size` boxes each.

    All pairs of a document of up to ALL_PAIRS boxes are compared, of all such documents in one step; others are swept.
    """
    label = np.arange(len(boxes))
    few = size <= ALL_PAIRS
    place = label - np.repeat(first, size)
    before = np.where(np.repeat(few, size), place, 0)
    i = np.repeat(label, before)
    j = np.repeat(label - place - (np.cumsum(before) - before), before) + np.arange(len(i))
    top, bottom = boxes[:, 1], boxes[:, 3]
    height = bottom - top
    mean = (height[j] + height[i]) / 2
    across = np.maximum(boxes[j, 0], boxes[i, 0]) - np.minimum(boxes[j, 2], boxes[i, 2])
    down = np.maximum(top[j], top[i]) - np.minimum(bottom[j], bottom[i])
    near = (across <= near_x * mean) & (down <= near_y * mean)
    i, j = i[near], j[near]
    while True:
        least = np.minimum(label[i], label[j])
        following = label.copy()
        np.minimum.at(following, i, least)
        np.minimum.at(following, j, least)
        following = following[following]
        if (following == label).all():
            break
        label = following
    for a, n in zip(first[~few].tolist(), size[~few].tolist(), strict=True):
        label[a : a + n] = a + components(boxes[a : a + n], near_x, near_y)
    return label


def paragraphs(elements: DataFrame, near_x: float = NEAR_X, near_y: float = NEAR_Y, keep: tuple[str, ...] = (), others: bool = False) -> DataFrame:
    """Elements (doc_id, seq, text, confidence, bbox) to one element a paragraph: doc_id, seq (that of its first element),
    text (in reading order, parted by spaces), confidence (mean), bbox (the rectangle around all), n_boxes.

    Boxes are joined where they are near, directly or through others. Documents are dealt to tasks by hash and come one
    after the other, sorted; a task holds the boxes of the documents of an Arrow batch, and of one that goes on from it. Elements without a box or a text stay out, or
    with others=True as they are, with n_boxes 0. Columns `keep`, which are the same for all elements of a document, stay.
    """
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in elements.schema if f.name in keep)
    schema = "doc_id string, seq int, text string, confidence double, left double, top double, right double, bottom double, n_boxes int" + more
    types = to_arrow_schema(elements.sparkSession.createDataFrame([], schema).schema)

    def joined(batches):
        """Paragraphs of whole documents, a column at a time; only texts of several boxes are put together one by one."""
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.Table.from_batches(batches).combine_chunks()
        known = pc.and_(pc.is_valid(rows["left"]), pc.is_valid(rows["text"]))
        if others:
            out = rows.filter(pc.invert(known))
            yield out.append_column("n_boxes", pa.array(np.zeros(len(out), np.int32)))
        rows = rows.filter(known)
        if not len(rows):
            return
        begins = np.flatnonzero(np.concatenate([[True], changes(rows["doc_id"])]))
        size = np.diff(np.append(begins, len(rows)))
        boxes = np.stack([rows[c].to_numpy() for c in ("left", "top", "right", "bottom")], 1).astype(float)
        label = components_of_all(boxes, begins, size, near_x, near_y)
        order = np.argsort(label, kind="stable")
        first, at, count = np.unique(label[order], return_index=True, return_counts=True)
        sure, texts = rows["confidence"].take(first).to_pylist(), rows["text"].take(first).to_pylist()
        every, text = rows["confidence"].to_pylist(), rows["text"].to_pylist()
        for k in np.flatnonzero(count > 1).tolist():
            of = order[at[k] : at[k] + count[k]]
            some = [c for c in (every[i] for i in of.tolist()) if c is not None]
            sure[k] = sum(some) / len(some) if some else None
            texts[k] = " ".join(text[of[i]] for i in reading_order(boxes[of]))
        edge = lambda f, c: pa.array(f.reduceat(boxes[order, c], at))
        document = np.repeat(begins, size)[first]
        found = {
            "doc_id": rows["doc_id"].take(first), "seq": rows["seq"].take(first), "text": pa.array(texts, pa.string()), "confidence": pa.array(sure, pa.float64()),
            "left": edge(np.minimum, 0), "top": edge(np.minimum, 1), "right": edge(np.maximum, 2), "bottom": edge(np.maximum, 3),
            "n_boxes": pa.array(count.astype(np.int32)), **{k: rows[k].take(document) for k in keep},
        }
        yield pa.table(found)

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.flatnonzero(changes(batch.column("doc_id"))) + 1
            if held and held[-1].column("doc_id")[-1].as_py() != batch.column("doc_id")[0].as_py():
                new = np.append(0, new)
            if len(new):  # the last document may go on in the next batch
                for table in joined([*held, batch.slice(0, int(new[-1]))]):
                    yield from table.select(types.names).cast(types).to_batches()
                held = []
                batch = batch.slice(int(new[-1]))
            held.append(batch)
        if held:
            for table in joined(held):
                yield from table.select(types.names).cast(types).to_batches()

    bound = lambda pick, i: pick(F.transform("bbox", lambda p: p[i]))
    kept = elements if others else elements.where(F.col("bbox").isNotNull() & (F.size("bbox") > 0) & F.col("text").isNotNull())
    kept = kept.select(
        "doc_id", "seq", "text", "confidence", bound(F.array_min, 0).alias("left"), bound(F.array_min, 1).alias("top"), bound(F.array_max, 0).alias("right"), bound(F.array_max, 1).alias("bottom"), *keep,
    )
    found = kept.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(run, schema)
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    box = F.array(corner("left", "top"), corner("right", "top"), corner("right", "bottom"), corner("left", "bottom"))
    return found.select("doc_id", "seq", "text", "confidence", F.when(F.col("left").isNotNull(), box).alias("bbox"), "n_boxes", *keep)
