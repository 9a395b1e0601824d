"""Goldens of the scalar rules, and the operators on small awkward tables."""

import random

import pytest
from pyspark.sql import functions as F

from parchment import queries
from parchment.functions import categories as C
from parchment.functions import parsing as P
from parchment.functions import text_repair as R
from parchment.operators import evaluate, extract, recognize, repair
from parchment.plans import pipeline
from parchment.schema import ELEMENTS
from parchment.sources import files
from parchment.streaming import landing


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r.x for r in rows.select("i", f(F.col("text")).alias("x")).orderBy("i").collect()]


AMOUNTS = {
    "22.75": 22.75, "1,234.56": 1234.56, "12 345": 12345.0, "1234.56": 56.0, "1234": None, "22,75": 2275.0, "1.234,56": 1.0, "5.5": 5.0,
    "27-09-2022": 27.0, "EGP22.75": 22.75, "1E500": None, "0.00": 0.0, "": None, "abc": None, "$ 9.99": 9.99, "12\t345": None, "٢٢.٧٥": 22.75,
}
DATES = {
    "2022/09/27": "2022-09-27", "27-09-2022": "2022-09-27", "09-27-2022": "2022-09-27", "05-06-2022": "2022-06-05", "27-09-22": "2022-09-27",
    "32-09-27": "2032-09-27", "09-27-22": None, "01-02-69": "1969-02-01", "01-02-68": "2068-02-01", "2022-13-01": None, "29-02-2023": None, "29/02/2024": "2024-02-29",
    "x 2022-9-7 y": "2022-09-07", "٢٠٢٢-٠٩-٢٧": None, "27-09-٢٠٢٢": "2022-09-27", "٢٧-09-2022": None, "no": None, "2022-13-01 27-09-2022": None, "1-2-0999": "999-02-01", "0000-01-01": None,
}
REPAIRED = {
    "27-09-202&": "27-09-2022", "Totهl": "Total", "٧AT": "VAT", "٤G؟)": "EGP", "ILEI": "Q", "(22.75": "(22.75", "Receipt dac27- TW:2022-1=222-_": "Receipt dac27- TW:2022-1=222-_",
    "Grand Total": "Erand Total", "EGP 22.75": "EGP 22.75", "(Large)": "(LargEGP", "Mate": "Date", "٢٤.٧٥": "2E.V5", "Case": "Cash", "Printer": "Print", "Totals": "Total",
    "1O1O1": "10101", "1OO1": "1OO1", "Sheep": "ShEGP", "": "", "ＴＯＴＡＬ": "TOTAL", "a​ b\t c": "a b c",
}


def test_amounts(spark):
    assert column(spark, AMOUNTS, P.parse_amount) == list(AMOUNTS.values())


def test_dates(spark):
    assert column(spark, DATES, P.parse_date) == list(DATES.values())


def test_repair(spark):
    rows = repair.repair(spark.createDataFrame([(i, t, "kept") for i, t in enumerate(REPAIRED)], "i int, text string, _other string"))
    found = rows.orderBy("i").collect()
    assert [r.text for r in found] == list(REPAIRED.values())
    assert [r.original_text for r in found] == list(REPAIRED) and rows.columns == ["i", "text", "_other", "original_text"]


def plain_numbers(text):
    """The rule for digits, written apart: letters between, before or after digits, one kind after the other."""
    for letters, digit in (("Oo", "0"), ("lI", "1"), ("S", "5"), ("B", "8")):
        old = text
        text = "".join(
            digit if c in letters and ((i == 0 or old[i - 1].isdigit()) and i + 1 < len(old) and old[i + 1].isdigit() or i == len(old) - 1 and i and old[i - 1].isdigit()) else c
            for i, c in enumerate(old)
        )
    return text


def test_numbers_against_plain(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123OolISB.,-") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    texts = [t for t in texts if any(c.isdigit() for c in t)]
    assert column(spark, texts, R.fix_numbers) == [plain_numbers(t) for t in texts]


@pytest.mark.parametrize("vendor, items, category", [
    ("Tabali", ["Pepsi"], "Dining Out"), ("Chicken Fila", ["Spicy Chicken Ranch Pizzawich", "Cheese Fries"], "Dining Out"), ("Carrefour", ["Bread", "Milk", "Eggs"], "Food & Groceries"),
    ("Uber", [], "Transportation"), ("Seif Pharmacy", ["Medicine"], "Health & Medical"), ("Unknown Store", [], "Other"), (None, None, "Other"), ("metro", [], "Food & Groceries"), ("sweet", [], "Utilities"),
])
def test_categories(spark, vendor, items, category):
    rows = spark.createDataFrame([(vendor, items)], "vendor string, line_items array<string>")
    assert C.with_category(rows).first().category == category


def test_terms():
    assert [sum(t[2] == k for t in C.terms()) for k in ("keyword", "brand")] == [193, 44]


SAMPLE = ["Tabali", "Date: 27-09-2022", "Pepsi", "19.95", "Total", "22.75"]


def elements(spark, docs):
    rows = [(d, i, t, 0.5) for d, texts in docs.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, seq int, text string, confidence double").repartition(3)


def test_extract(spark):
    docs = {
        "a": SAMPLE, "late": ["Total", "a", "b", "c", "5.00"], "far": ["Total", "a", "b", "c", "d", "5.00"], "none": ["hello"], "high": ["99,999.00"],
        "best": ["Total", "100", "7.50", "Total"], "before": ["01-02-2022", "x", "Date"], "edge": ["05-05-2022", "Date", "06-06-2022"], "zero": ["Total", "0.00", "3.00"], "null": [None],
    }
    out = {r.doc_id: r for r in extract.extract(elements(spark, docs)).collect()}
    assert (out["a"].date, out["a"].total, out["a"].line_items, out["a"].vendor) == ("2022-09-27", 22.75, ["Tabali"], "Tabali")
    assert (out["late"].total, out["far"].total, out["best"].total, out["zero"].total) == (5.0, 5.0, 7.5, 3.0)
    assert out["none"].total is None and out["none"].error is None and out["high"].error == extract.NO_TOTAL
    assert (out["before"].date, out["edge"].date, out["null"].total) == ("2022-02-01", "2022-05-05", None)
    rows = {r.doc_id: r for r in extract.receipts(elements(spark, docs)).collect()}
    assert not rows["high"].success and rows["high"].category is None and sum(r.success for r in rows.values()) == len(docs) - 1
    total = extract.batch_summary(extract.receipts(elements(spark, docs))).first()
    assert (total.total, total.success, total.failed) == (len(docs), len(docs) - 1, 1)
    detail = {r.doc_id: r for r in extract.receipts_detailed(elements(spark, docs)).collect()}
    assert detail["a"].debug_info.asDict() == {"ocr_elements_found": 6, "average_confidence": 0.5, "line_items_detected": 1, "vendor_name": "Tabali", "line_items": ["Tabali"]}
    assert extract.receipts(elements(spark, {"x": []} | {"a": SAMPLE}).where("false")).count() == 0
    text = {r.doc_id: r.text for r in extract.text_only(elements(spark, docs)).collect()}
    assert text["a"] == "\n".join(SAMPLE)


def test_responses_and_json(spark, tmp_path):
    import json

    rows = {r.doc_id: json.loads(r.json) for r in pipeline.responses(elements(spark, {"a": SAMPLE, "high": ["99,999.00"]})).collect()}
    assert rows["a"]["data"]["date_epoch_ms"] == 1664236800000 and rows["high"]["success"] is False and "data" not in rows["high"]
    files.write_json(extract.receipts(elements(spark, {"a": SAMPLE})), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first().total == 22.75


def test_files_and_recognition(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  hello\n\nworld \n", encoding="utf-8")
    ppm = b"P6 4 2 255\n" + bytes(range(24))
    for name in ("a.JPG", "b.png", "c.gif"):
        (tmp_path / name).write_bytes(ppm)
    assert [r.path.rsplit("/", 1)[1] for r in files.image_files(spark, str(tmp_path)).select("path").collect()] == ["a.JPG", "b.png"]
    truth = files.ground_truth(spark, str(tmp_path), "train").collect()
    assert [(r.split, r.stem, r.ground_truth) for r in truth] == [("train", "a", "hello\n\nworld")]
    rows = spark.createDataFrame([("good", 2, 2, 1, bytearray(4)), ("bad", 2, 2, 1, None)], "path string, height int, width int, channels int, content binary")

    def reader(options):
        return lambda r: [([[0, 0], [1, 0], [1, 1], [0, 1]], " Total ", 0.9), ([[0, 0], [2, 0], [2, 1], [0, 1]], "5.00", 0.8)]

    found = recognize.recognize(rows, reader).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.text, r.error is None) for r in found] == [("bad", None, False), ("good", "Total", True), ("good", "5.00", True)]
    done = recognize.elements(rows, reader, step=None).orderBy("seq").collect()
    assert [(r.center.x, r.center.y, r.normalized_center.x) for r in done] == [(0, 0, 0.0), (1, 0, 0.5)]
    assert [r.label for r in recognize.overlays(recognize.elements(rows, reader, step=None)).orderBy("seq").collect()] == ["Total (0.90)", "5.00 (0.80)"]


def png(pixels):
    """A grey image as a PNG file."""
    import struct
    import zlib

    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(row) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_from_images_to_receipts(spark, tmp_path):
    """Files to rows: a receipt, an image in which nothing is found, one on which the engine fails, one that can't be read."""
    import json

    for name, shade in (("good.png", 10), ("empty.png", 20), ("fails.PNG", 30)):
        (tmp_path / name).write_bytes(png([[shade] * 40] * 30))
    (tmp_path / "broken.jpg").write_bytes(b"no image")

    def reader(options):
        def read(r):
            assert (r["channels"], r["width"]) == (1, 1000)  # preprocessed
            shade = round(sum(r["content"]) / len(r["content"]))
            if "fails" in r["path"]:
                raise RuntimeError("engine broke")
            return [] if "empty" in r["path"] else [([[0, 0], [9, 0], [9, 9], [0, 9]], t, 0.5) for t in SAMPLE] if shade >= 0 else None

        return read

    names = sorted(str(tmp_path / n) for n in ("good.png", "empty.png", "fails.PNG", "broken.jpg"))
    out = {r.file.rsplit("/", 1)[1]: r for r in pipeline.process_paths(spark, names, reader).collect()}
    assert (out["good.png"].success, out["good.png"].date, out["good.png"].total, out["good.png"].category) == (True, "2022-09-27", 22.75, "Dining Out")
    assert (out["empty.png"].success, out["empty.png"].total, out["empty.png"].category) == (True, None, "Other")
    assert (out["fails.PNG"].success, out["fails.PNG"].error) == (False, "engine broke") and not out["broken.jpg"].success and "Could not read image" in out["broken.jpg"].error
    (tmp_path / "calls").mkdir()
    calls = tmp_path / "calls"

    def counted(options):
        def read(r):
            import uuid

            (calls / uuid.uuid4().hex).touch()
            return reader(options)(r)

        return read

    pipeline.from_images(files.images(spark, str(tmp_path)), counted).collect()
    assert len(list(calls.iterdir())) == 3  # each image that decodes, once
    (tmp_path / "note.gif").write_bytes(b"")
    for detailed in (False, True):
        answers = {r.doc_id: (r.status, json.loads(r.json)) for r in pipeline.answers(spark, [*names, str(tmp_path / "note.gif")], reader, detailed=detailed).collect()}
        assert {k: v[0] for k, v in answers.items()} == {"good.png": 200, "empty.png": 200, "fails.PNG": 500, "broken.jpg": 500, "note.gif": 400}
        assert answers["good.png"][1]["data"]["total"] == 22.75 and answers["fails.PNG"][1]["error"] == "engine broke" and answers["note.gif"][1]["error"] == pipeline.NOT_AN_IMAGE
        assert ("debug_info" if detailed else "date_epoch_ms") in answers["good.png"][1]["data"]
    assert [r.status for r in pipeline.answers(spark, [str(tmp_path / "note.gif")], reader).collect()] == [400]
    total = extract.batch_summary(pipeline.process_paths(spark, names, reader)).first()
    assert (total.total, total.success, total.failed) == (4, 2, 2)
    detail = {r.doc_id.rsplit("/", 1)[1]: r for r in pipeline.from_images(files.images(spark, str(tmp_path)), reader, detailed=True).collect()}
    assert detail["good.png"].debug_info.vendor_name == "Tabali" and detail["broken.jpg"].error and detail["empty.png"].debug_info.ocr_elements_found == 0
    files.write_json_array(pipeline.process_paths(spark, names, reader), f"{tmp_path}/batch")
    batch = "".join(p.read_text() for p in sorted((tmp_path / "batch").glob("part-*")))
    assert [r["file"].rsplit("/", 1)[1] for r in json.loads(batch)] == ["broken.jpg", "empty.png", "fails.PNG", "good.png"]


def test_responses_by_name(spark):
    import json

    docs = {"a.png": SAMPLE, "b.gif": SAMPLE, "high.jpg": ["99,999.00"]}
    for answers, key in ((pipeline.responses, "date_epoch_ms"), (pipeline.responses_detailed, "debug_info")):
        rows = {r.doc_id: (r.status, json.loads(r.json)) for r in answers(elements(spark, docs), fix=False, check_names=True).collect()}
        assert {k: v[0] for k, v in rows.items()} == {"a.png": 200, "b.gif": 400, "high.jpg": 500}
        assert key in rows["a.png"][1]["data"] and rows["b.gif"][1]["error"] == pipeline.NOT_AN_IMAGE and rows["high.jpg"][1]["error"] == extract.NO_TOTAL


def test_compare_engines(spark, tmp_path):
    for split in files.SPLITS:
        (tmp_path / split).mkdir()
        for name in ("a", "b"):
            (tmp_path / split / f"{name}.png").write_bytes(png([[200] * 20] * 20))
        (tmp_path / split / "a.txt").write_text("Total 5\n")

    (tmp_path / "val" / "c.jpg").write_bytes(b"no image")
    (tmp_path / "val" / "c.txt").write_text("skipped")
    calls = tmp_path / "calls"
    calls.mkdir()

    def good(options):
        def read(r):
            import uuid

            (calls / uuid.uuid4().hex).touch()
            return [([[0, 0]] * 4, "Total", 0.9), ([[0, 0]] * 4, "5", 0.9)]

        return read

    def bad(options):
        def read(r):
            raise RuntimeError("no engine")

        return read

    out = pipeline.compare_engines(spark, str(tmp_path), {"easyocr": good, "pytesseract": bad}, step=None)
    rows = out.collect()
    assert len(list(calls.iterdir())) == 3  # images without ground truth, and those that don't decode, aren't recognised
    assert sorted(r.split for r in rows) == sorted(files.SPLITS) and all((r.image, r.better, r.easyocr.cer, r.pytesseract.cer, r.pytesseract.error) == ("a.png", "easyocr", 0.0, 1.0, "no engine") for r in rows)
    import json

    report, head, tail = evaluate.report_json(out)
    files.write_json_value(report, f"{tmp_path}/report", ["split", "image"], head, tail)
    told = json.loads("".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*"))))
    assert [x["split"] for x in told.pop("results")] == ["test", "train", "val"] and told == {"total_images": 3, "easyocr_mean_cer": 0.0, "pytesseract_mean_cer": 1.0}


def test_images():
    import numpy as np

    from parchment.operators import images

    page = np.full((100, 80), 255, np.uint8)
    page[20:90, 10:70] = 0
    assert images.remove_borders(page).shape == (74, 64)
    page[:] = 255
    page[50, 40] = 0
    assert images.remove_borders(page).shape == (100, 80)
    assert images.upscale(np.zeros((33, 100), np.uint8)).shape == (330, 1000)
    flat = np.full((40, 40), 90, np.uint8)
    assert (images.denoise(flat, 5, 7, 15) == 90).all() and (images.adaptive_threshold(flat, 21, 10) == 255).all()
    assert images.gray(np.full((2, 2, 3), 7, np.uint8)).tolist() == [[7, 7], [7, 7]] and images.skew_angle(flat) == 0.0
    assert images.preprocess_receipt_conservative(flat).shape == (1000, 1000) and images.preprocess(page).shape == page.shape


def test_evaluation(spark):
    truth = spark.createDataFrame([("train", "a", "Hello  World"), ("val", "b", ""), ("val", "c", "abc"), ("val", "d", None)], "split string, stem string, ground_truth string")
    rows = [(s, n, e, t, x) for s, n, t, x in (("train", "a", "hello world", None), ("val", "b", "", None), ("val", "c", None, "failed"), ("val", "d", "x", None)) for e in evaluate.ENGINES]
    guesses = spark.createDataFrame(rows, "split string, stem string, engine string, text string, error string")
    out = {r.image: r for r in evaluate.compare(truth, guesses).collect()}
    assert set(out) == {"a", "b", "c"}
    assert [out[k].easyocr.cer for k in "abc"] == [0.0, 0.0, 1.0] and out["c"].easyocr.text == "ERROR" and out["a"].better == "pytesseract"
    stats = {r.engine: r for r in evaluate.summary(evaluate.compare(truth, guesses)).collect()}
    assert stats["easyocr"].n == 3 and stats["easyocr"].median_cer == 0.0 and stats["easyocr"].mean_cer == pytest.approx(1 / 3)
    alone = evaluate.compare(truth, guesses.where("engine = 'easyocr'")).where("image = 'a'").first()
    assert (alone.easyocr.cer, alone.pytesseract.cer, alone.pytesseract.error, alone.better) == (0.0, 1.0, evaluate.NOT_RUN, "easyocr")
    none = evaluate.winner(evaluate.compare(truth.where("false"), guesses)).first()
    assert (none.total_images, none.easyocr_mean_cer, none.winner) == (0, 0.0, "pytesseract")


def test_landing(spark, tmp_path):
    rows = elements(spark, {"a": SAMPLE})
    for name, kind in (f.rsplit(" ", 1) for f in map(str, (f"{n} {t}" for n, t in (("bbox", "array<array<double>>"), ("center", "struct<x:int,y:int>"), ("normalized_center", "struct<x:double,y:double>"), ("image_dimensions", "struct<width:int,height:int>"))))):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    assert [c.split()[0] for c in ELEMENTS.split(", ")] == rows.columns
    rows.coalesce(1).write.json(f"{tmp_path}/in")
    landing.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").first().total == 22.75


def test_plan_has_one_exchange(spark):
    plan = extract.extract(elements(spark, {"a": SAMPLE}))._jdf.queryExecution().sparkPlan().toString()
    executed = extract.extract(spark.range(10).selectExpr("cast(id as string) doc_id", "0 seq", "'x' text", "0.5D confidence"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") >= 1 and executed.count("Exchange hashpartitioning") == 1


def test_repair_all_takes_whole_turns(spark, tmp_path):
    rows = [(1, 2, "user", "one two three four 27-09-202& and 1O1"), (1, 3, "user", "paid in all " + "at noon " * 50 + "(22.75 and 5S5")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.id: r.text for r in queries.repair_all(spark, str(tmp_path)).collect()}
    assert out[1002] == "one two three four 27-09-2022 and 101"
    assert out[1003] == "paid in all " + "at noon " * 50 + "(22.75 and 555"
