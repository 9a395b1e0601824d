"""Terms by an index, paragraphs, medians and rounding, against plain code."""

import random
import struct
from collections import Counter
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.functions import categories as C
from parchment.functions import parsing as P
from parchment.operators import paragraphs, selection, terms


def test_terms_equal_contains(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcد é") for _ in range(n))
    texts = [(i, word(rng.choice([0, 1, 2, 3, 8, 40]))) for i in range(200)] + [(500, None), (501, "aaaa" * 300)]
    known = [(rng.choice(["x", "y"]), 1, word(rng.choice([0, 1, 2, 3, 4, 5, 9])), rng.randint(1, 3)) for _ in range(150)] + [("z", 2, None, 1), ("x", 1, "ab", 2), ("x", 1, "ab", 2)]
    want = sorted((i, c, o, w, t) for i, x in texts for c, o, t, w in known if x is not None and t is not None and t in x)
    a, b = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(known, "category string, ord int, term string, weight int")
    get = lambda: sorted((r.doc_id, r.category, r.ord, r.weight, r.term) for r in terms.matches(a, b).collect())
    assert get() == want
    monkeypatch.setattr(terms, "LIMIT", 0)  # the index is shuffled
    assert get() == want
    assert terms.matches(a, b.where("false")).count() == 0 and terms.matches(a.where("false"), b).count() == 0


def test_categories_by_table(spark):
    vendors = ["Tabali", "metro", "uber", "sweet", "cinema", "nothing", "GAS bill", "", None, "موبايل", "total"]
    rows = spark.createDataFrame([(i, v, ["Bread", "Galaxy"][: i % 3]) for i, v in enumerate(vendors)], "doc_id int, vendor string, line_items array<string>")
    key = lambda df: sorted((r.doc_id, r.category) for r in df.collect())
    assert key(terms.with_category(rows, C.term_table(spark))) == key(C.with_category(rows))


def test_terms_of_many_grams_and_of_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzد é😀") for _ in range(n))) for i, n in enumerate([0, 1, 2, 5, 300, 60_000])]
    known = sorted({x[k : k + n] for _, x in texts for n in (0, 1, 2, 3, 7) for k in rng.sample(range(max(1, len(x))), min(len(x), 9))} | {"zzzzzzz"})
    want = sorted((i, t) for i, x in texts for t in known if t in x)
    a, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(t,) for t in known], "term string")
    get = lambda: sorted((r.doc_id, r.term) for r in terms.matches(a, b).collect())
    assert get() == want
    monkeypatch.setattr(terms, "LISTED", 0)  # the texts' grams are joined
    assert get() == want
    cut = a.select(terms.grams(F.col("text"), [2, 3]).alias("g")).schema["g"].dataType.simpleString()
    assert cut == "array<bigint>"  # different ones are found by a table, not by comparing all with all


def paragraphs_by_hand(boxes):
    up = list(range(len(boxes)))
    height = [b[3] - b[1] for b in boxes]
    changed = True
    while changed:
        changed = False
        for i in range(len(boxes)):
            for j in range(len(boxes)):
                m = (height[i] + height[j]) / 2
                near = max(boxes[i][0], boxes[j][0]) - min(boxes[i][2], boxes[j][2]) <= m and max(boxes[i][1], boxes[j][1]) - min(boxes[i][3], boxes[j][3]) <= m / 2
                if near and up[i] < up[j]:
                    up[j], changed = up[i], True
    return up


def test_paragraphs_against_all_pairs():
    rng = random.Random(2)
    for _ in range(60):
        boxes = []
        for _ in range(rng.choice([1, 2, 10, 60])):
            x, y = rng.randrange(300), rng.randrange(300)
            boxes.append([x, y, x + rng.randint(1, 40), y + rng.randint(1, 20)])
        assert paragraphs.components(np.array(boxes, float)).tolist() == paragraphs_by_hand(boxes)


def test_a_term_of_many_rows_is_looked_up_once(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "abcd é😀x") for i in range(5)], "doc_id long, text string")
    rows = spark.createDataFrame([(t, f"c{k}") for t in ("bc", "é😀x", "zz", "") for k in range(40)], "term string, category string")
    index, sought = terms.index, []
    monkeypatch.setattr(terms, "index", lambda texts, known, *more: sought.append(known.count()) or index(texts, known, *more))
    assert terms.matches(texts, rows).count() == 5 * 3 * 40 and sought == [4]


def test_paragraphs_of_many_documents_at_once():
    random = np.random.default_rng(4)
    size = random.integers(1, 60, 50)
    corner = random.integers(0, 150, (size.sum(), 2))
    boxes = np.concatenate([corner, corner + random.integers(3, 14, corner.shape)], 1).astype(float)
    first = np.cumsum(size) - size
    got = paragraphs.components_of_all(boxes, first, size)
    for a, n in zip(first.tolist(), size.tolist(), strict=True):
        assert (got[a : a + n] - a).tolist() == paragraphs_by_hand(boxes[a : a + n].tolist())


def test_paragraphs_of_documents_over_several_batches(spark):
    boxes = lambda d: [[20.0 * (i % 9), 14.0 * (i // 9) + d % 3, 20.0 * (i % 9) + 11, 14.0 * (i // 9) + d % 3 + 9] for i in range(1 + d * 7 % 40)]
    rows = [(None if d == 0 else f"d{d}", i, f"t{i}", None if i % 5 == 1 else i / 7, [[a, b], [c, b], [c, e], [a, e]]) for d in range(12) for i, (a, b, c, e) in enumerate(boxes(d))]
    table = spark.createDataFrame(rows, "doc_id string, seq int, text string, confidence double, bbox array<array<double>>")
    of = lambda: sorted(map(repr, paragraphs.paragraphs(table).collect()))
    whole = of()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 5)
    try:
        assert of() == whole
    finally:
        spark.conf.unset(key)
    want = sorted((f"d{d}" if d else "", s, n) for d in range(12) for s, n in Counter(paragraphs_by_hand(boxes(d))).items())
    assert sorted((r.doc_id or "", r.seq, r.n_boxes) for r in paragraphs.paragraphs(table).collect()) == want


def test_paragraph_texts(spark):
    box = lambda x, y, w=20, h=10: [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
    rows = [("a", 3, "two", 0.5, box(22.0, 1.0)), ("a", 1, "one", 1.0, box(0.0, 0.0)), ("a", 2, "three", 0.0, box(0.0, 12.0)), ("a", 4, "far", 0.25, box(200.0, 200.0)), ("b", 0, None, None, None), ("c", 0, "x", None, box(0.0, 0.0))]
    got = {(r.doc_id, r.seq): r for r in paragraphs.paragraphs(spark.createDataFrame(rows, "doc_id string, seq int, text string, confidence double, bbox array<array<double>>")).collect()}
    assert {k: r.text for k, r in got.items()} == {("a", 1): "one two three", ("a", 4): "far", ("c", 0): "x"}
    assert got["a", 1].confidence == 0.5 and got["a", 1].n_boxes == 3 and got["a", 1].bbox == [[0.0, 0.0], [42.0, 0.0], [42.0, 22.0], [0.0, 22.0]]


def test_recognition_by_paragraphs(spark):
    from parchment.operators import recognize

    rows = spark.createDataFrame([("good", 20, 20, 1, bytearray(400)), ("bad", 2, 2, 1, None), ("none", 1, 1, 1, bytearray(1))], "path string, height int, width int, channels int, content binary")

    def reader(options):
        box = lambda x, y: [[x, y], [x + 4, y], [x + 4, y + 4], [x, y + 4]]
        return lambda r: [(box(5, 0), " 5.00", 0.5), (box(0, 0), "Total", 1.0), (box(0, 15), "Thanks", 0.5)] if r["path"] == "good" else []

    found = recognize.elements(rows, reader, recognize.Options(post_process=False, paragraph=True), None, keep_failed=True)
    got = {(r.doc_id, r.seq): (r.text, r.confidence, r.error, (r.center.x, r.center.y), r.image_dimensions.width) for r in found.collect()}
    assert got == {("good", 0): ("Total 5.00", 0.75, None, (4, 2), 20), ("good", 2): ("Thanks", 0.5, None, (2, 17), 20), ("bad", 0): (None, None, "Could not read image: bad", (None, None), 2), ("none", None): (None, None, None, (None, None), 1)}
    assert recognize.elements(rows, reader, recognize.Options(paragraph=True), None).count() == 2


@pytest.mark.parametrize("parts", [2, 1024])
def test_medians(spark, monkeypatch, parts):
    rng = random.Random(3)
    groups = {"one": [0.25], "two": [1.0, 2.0], "same": [0.5] * 9, "zero": [0.0, -0.0, 0.0], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-200, 200) for _ in range(101)], "many": [rng.random() for _ in range(2000)], "tied": [rng.choice([0.1, 0.2, 0.3]) for _ in range(50)]}
    monkeypatch.setattr(selection, "PARTS", parts)
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double").repartition(4)
    assert selection.medians(rows, "k", "v") == {k: median(v) for k, v in groups.items()}
    assert selection.medians(rows.where("false"), "k", "v") == {}


def test_no_aggregate_holds_all_values(spark):
    from parchment.operators import evaluate

    truth = spark.createDataFrame([("val", "a", "x")], "split string, stem string, ground_truth string")
    guesses = spark.createDataFrame([("val", "a", e, "x", None) for e in evaluate.ENGINES], "split string, stem string, engine string, text string, error string")
    plan = evaluate.summary(evaluate.compare(truth, guesses))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan


def test_rounding_is_pythons(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 0.125, 0.375, -0.125, 2.675, 1.005, 0.005, 0.015, -2.675, 1e300, -1e300, 2.0**45 + 0.0078125, 2.0**46 + 0.015625, 2.0**52 + 0.5, 2.0**53 + 1, 5e-324, float("inf"), 0.5, 99.995]
    values += [rng.randrange(10**6) / 8 for _ in range(300)] + [rng.randrange(10**6) / 1000 for _ in range(2000)] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-5, 16) for _ in range(2000)]
    values += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(1000)) if x == x]
    got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", P.round2(F.col("x")).alias("y")).orderBy("i").collect()]
    assert [(repr(x), repr(round(x, 2))) for x in values if x != float("inf")] == [(repr(x), repr(y)) for x, y in zip(values, got) if x != float("inf")]
