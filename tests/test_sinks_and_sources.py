"""The dataset source, result files, JSON values in parts, and the landing of images."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parchment.operators import evaluate
from parchment.plans.pipeline import NOT_AN_IMAGE
from parchment.sources import datasets, files
from parchment.streaming import images as landing
from tests.test_receipts import SAMPLE, png


@pytest.fixture
def dataset(tmp_path):
    for split in ("train", "val", "extra"):
        (tmp_path / split).mkdir()
        for name in ("a.png", "b.JPG", "c.jpeg", "d.gif", "e.png"):
            (tmp_path / split / name).write_bytes(f"{split}{name}".encode())
        for name in ("a", "b", "c", "d"):
            (tmp_path / split / f"{name}.txt").write_text(f"  {split}\n{name} é\n", encoding="utf-8")
    (tmp_path / "val" / "c.txt").write_bytes(b"\xff\xfe\xff")
    return tmp_path


def test_dataset_rows_are_those_of_the_reader_of_texts(spark, dataset):
    rows = datasets.read(spark, str(dataset), splits="train,val,test").collect()
    assert sorted((r.split, r.image, r.ground_truth) for r in rows) == [(s, i, f"{s}\n{i[0]} é") for s in ("train", "val") for i in ("a.png", "b.JPG", "c.jpeg") if (s, i) != ("val", "c.jpeg")]
    assert all(bytes(r.content) == f"{r.split}{r.image}".encode() for r in rows)
    texts = files.dataset(spark, str(dataset), ("train",)).where("stem <> 'd'").collect()  # d has no image
    assert sorted((r.split, r.stem, r.ground_truth) for r in texts) == sorted((r.split, r.stem, r.ground_truth) for r in rows if r.split == "train")
    every = datasets.read(spark, str(dataset), labelled="false", content="false").collect()
    assert len(every) == 8 and {r.image for r in every if r.ground_truth is None} == {"e.png", "c.jpeg"} and all(r.content is None for r in every)
    assert datasets.read(spark, str(dataset / "absent")).count() == 0


def test_filters_reach_the_plan(spark, dataset):
    read = lambda: datasets.read(spark, str(dataset), filesPerPartition="1")
    assert read().rdd.getNumPartitions() == 6
    for where, files_read, found in (
        ("split = 'val'", 3, 2), ("split IN ('train', 'test')", 3, 3), ("stem = 'a'", 2, 2), ("stem LIKE 'b%' AND split = 'train'", 1, 1), ("split = 'absent'", 1, 0),
        ("stem = 'a' AND ground_truth LIKE 'val%'", 2, 1), ("split = 'train' OR stem = 'b'", 6, 4), ("length(stem) = 1", 6, 5),
    ):
        rows = read().where(where)
        assert (rows.rdd.getNumPartitions(), rows.count()) == (files_read, found), where
    (dataset / "train" / "a.png").unlink()
    (dataset / "train" / "a.png").mkdir()  # what isn't planned isn't read
    assert read().where("split = 'val' AND stem = 'a'").count() == 1


def names(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file())


def test_result_files(spark, tmp_path):
    ids = ["x/a.png", "y/a.png", "a.jpg", "b.tar.png", "noext", ".hidden", "é.png"]
    rows = spark.createDataFrame([(i, True, 1.5, None) for i in ids], "doc_id string, success boolean, total double, error string").repartition(3)
    datasets.write_results(rows, str(tmp_path / "out"))
    found = names(tmp_path / "out")
    assert len(found) == len(ids) and {"a_result.json", "b.tar_result.json", "noext_result.json", ".hidden_result.json", "é_result.json"} < set(found)
    assert sum(n.startswith("a_") for n in found) == 3
    read = [json.loads((tmp_path / "out" / n).read_text(encoding="utf-8")) for n in found]
    assert sorted(r["doc_id"] for r in read) == sorted(ids) and all(r == {"doc_id": r["doc_id"], "success": True, "total": 1.5, "error": None} for r in read)
    assert json.loads((tmp_path / "out" / "a_result.json").read_text())["doc_id"] == "a.jpg"
    datasets.write_results(rows.where("doc_id = 'noext'"), str(tmp_path / "out"), "overwrite")
    assert names(tmp_path / "out") == ["noext_result.json"]
    datasets.write_results(rows.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or names(tmp_path / "none") == []


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    @F.udf("string")
    def breaks(x):
        if x == "d7.png":
            raise RuntimeError("lost")
        return x

    rows = spark.createDataFrame([(f"d{i}.png", True) for i in range(40)], "doc_id string, success boolean").repartition(8)
    datasets.write_results(rows.where("doc_id = 'd1.png'"), str(tmp_path / "out"))
    with pytest.raises(Exception):  # noqa: B017
        datasets.write_results(rows.withColumn("extra", breaks("doc_id")), str(tmp_path / "out"))
    assert names(tmp_path / "out") == ["d1_result.json"] and len(list((tmp_path / "out").iterdir())) == 1


def test_receipts_are_made_once_for_their_files(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        made.add(1)
        return x

    rows = spark.createDataFrame([(f"d{i}.png", True) for i in range(40)], "doc_id string, success boolean").repartition(4)
    datasets.write_results(rows.withColumn("extra", counted("doc_id")), str(tmp_path / "out"))
    assert len(names(tmp_path / "out")) == 40 and made.value == 40


def test_a_file_that_cannot_be_written_leaves_none(spark, tmp_path):
    spark.dataSource.register(datasets.ResultFiles)
    rows = spark.createDataFrame([("a_result.json", "{}"), ("no/such_result.json", "{}")], "name string, value string").repartition(2)
    with pytest.raises(Exception):  # noqa: B017
        rows.write.format("result_files").mode("append").save(str(tmp_path / "out"))
    assert names(tmp_path / "out") == []


def test_result_files_are_read_back_many_a_task(spark, tmp_path):
    ids = [f"d{i}.png" for i in range(2000)] + [".hidden", "é b.png", "_x"]
    rows = spark.createDataFrame([(i, "é\n") for i in ids], "doc_id string, error string").repartition(3)
    datasets.write_results(rows, str(tmp_path / "out"))
    (tmp_path / "out" / "other.txt").write_text("no result")
    read = datasets.read_results(spark, str(tmp_path / "out"))
    assert read.rdd.getNumPartitions() == 1 and datasets.read_results(spark, str(tmp_path / "out"), filesPerPartition="500").rdd.getNumPartitions() == 5
    found = {r["name"]: json.loads(r.value) for r in datasets.read_results(spark, str(tmp_path / "out"), filesPerPartition="500").collect()}
    assert set(found) == {n for n in names(tmp_path / "out") if n != "other.txt"} and sorted(r["doc_id"] for r in found.values()) == sorted(ids)
    assert all(r["error"] == "é\n" for r in found.values()) and {".hidden_result.json", "é b_result.json", "_x_result.json"} < set(found)
    assert datasets.read_results(spark, str(tmp_path / "absent")).count() == 0


def joined(path):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(Path(path).glob("part-*")))


@pytest.mark.parametrize(("n", "ranges"), [(0, 4), (1, 4), (3, 16), (500, 7)])
def test_json_value_in_parts(spark, tmp_path, n, ranges):
    rows = spark.createDataFrame([(f"d{i % max(1, n // 2):04}", None if i % 3 else "é, [\n]") for i in range(n)], "doc_id string, error string").repartition(5)
    files.write_json_value(rows.select("doc_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")), str(tmp_path / "a"), ["doc_id"], ranges=ranges)
    value = json.loads(joined(tmp_path / "a"))
    assert [r["doc_id"] for r in value] == sorted(r.doc_id for r in rows.collect()) and sorted(map(str, value)) == sorted(str(r.asDict()) for r in rows.collect())
    parts = [p.read_text().count("\n") for p in (tmp_path / "a").glob("part-*")]
    assert n < 500 or (len(parts) == ranges and max(parts) < n / 2)


def test_report_is_one_object(spark, tmp_path):
    truth = spark.createDataFrame([("val", f"i{i}", f"text {i}") for i in range(9)], "split string, stem string, ground_truth string")
    guesses = spark.createDataFrame([("val", f"i{i}", e, f"text {i}" if e == "easyocr" else None, None if e == "easyocr" else "failed") for i in range(9) for e in evaluate.ENGINES], "split string, stem string, engine string, text string, error string")
    for compared, n in ((evaluate.compare(truth, guesses), 9), (evaluate.compare(truth.limit(0), guesses), 0)):
        rows, head, tail = evaluate.report_json(compared)
        files.write_json_value(rows, str(tmp_path / f"r{n}"), ["split", "image"], head, tail)
        value = json.loads(joined(tmp_path / f"r{n}"))
        assert set(value) == {"total_images", "easyocr_mean_cer", "pytesseract_mean_cer", "results"} and value["total_images"] == n == len(value["results"])
        assert (value["easyocr_mean_cer"], value["pytesseract_mean_cer"]) == ((0.0, 1.0) if n else (0.0, 0.0))
    assert [r["image"] for r in json.loads(joined(tmp_path / "r9"))["results"]] == [f"i{i}" for i in range(9)]


def engine():
    """A reader that tells pages by their names; made in a function, so that tasks get it whole."""
    sample = tuple(SAMPLE)

    def reader(options):
        def read(r):
            if "broken" in r["path"]:
                raise RuntimeError("engine broke")
            found = sample[:3] if "1of2" in r["path"] else sample[3:] if "2of2" in r["path"] else sample
            return [([[0, 0], [9, 0], [9, 9], [0, 9]], t, 0.5) for t in found]

        return read

    return reader


def receipts(spark, out):
    return sorted((r.doc_id, r.success, r.date, r.total, r.error) for r in spark.read.parquet(out).collect())


def test_landing_of_images(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    put = lambda name: (folder / name).write_bytes(png([[10] * 30] * 20))
    go = lambda: landing.ingest_images(spark, str(folder), out, mark, engine()).awaitTermination()
    whole, refused = ("whole", True, "2022-09-27", 22.75, None), ("note", False, None, None, NOT_AN_IMAGE)
    for name in ("whole.png", "two.2of2.png", "note.gif"):
        put(name)
    go()
    assert receipts(spark, out) == [refused, whole]
    for name in ("whole.jpg", "two.1of2.PNG", "broken.png"):  # one comes twice, one is completed
        put(name)
    go()
    done = sorted([refused, whole, ("two", True, "2022-09-27", 22.75, None), ("broken", False, None, None, "engine broke")])
    assert receipts(spark, out) == done
    put("two.2of2.jpeg")
    go()
    go()
    assert receipts(spark, out) == done


def test_landing_after_a_failure(spark, tmp_path, monkeypatch):
    """A trigger that fails after it has begun is repeated: nothing is lost and nothing comes twice."""
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    for i in range(4):
        (folder / f"r{i}.png").write_bytes(png([[10] * 30] * 20))
    go = lambda: landing.ingest_images(spark, str(folder), out, mark, engine(), files_per_trigger=2).awaitTermination()
    kept, calls = landing.receipts_of, []

    def fails(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return kept(*args)

    monkeypatch.setattr(landing, "receipts_of", fails)
    with pytest.raises(Exception):  # noqa: B017
        go()
    assert len(receipts(spark, out)) == 2
    go()
    assert [r[0] for r in receipts(spark, out)] == ["r0", "r1", "r2", "r3"]
