"""Recognition as a generator of elements. Engines are optional; any callable bytes -> [(bbox, text, confidence)] serves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .extract import with_geometry
from .images import apply, preprocess
from .paragraphs import paragraphs
from .repair import repair

OUT = "doc_id string, seq int, text string, confidence double, bbox array<array<double>>, height int, width int, error string"
Reader = Callable[[dict], list[tuple[list[list[float]], str, float]]]


@dataclass(frozen=True)
class Options:
    use_gpu: bool = False
    languages: tuple[str, ...] = ("en", "ar")
    post_process: bool = True
    #: Whether the elements of an image are joined to paragraphs, see paragraphs.paragraphs.
    paragraph: bool = False


@lru_cache(maxsize=2)
def easyocr_reader(options: Options) -> Reader:
    """One model a Python worker; needs the easyocr package."""
    import easyocr
    import numpy as np

    model = easyocr.Reader(list(options.languages), gpu=options.use_gpu)
    return lambda r: model.readtext(np.frombuffer(r["content"], np.uint8).reshape(r["height"], r["width"], -1).squeeze(), detail=1)


@lru_cache(maxsize=2)
def tesseract_reader(options: Options) -> Reader:
    """The whole text of an image as one element; needs the pytesseract package and its program."""
    import numpy as np
    import pytesseract

    languages = "+".join({"en": "eng", "ar": "ara"}.get(x, x) for x in options.languages)

    def read(r):
        image = np.frombuffer(r["content"], np.uint8).reshape(r["height"], r["width"], -1).squeeze()
        box = [[0.0, 0.0], [r["width"], 0.0], [r["width"], r["height"]], [0.0, r["height"]]]
        return [(box, pytesseract.image_to_string(image[..., ::-1] if image.ndim == 3 else image, lang=languages), 1.0)]

    return read


def recognize(images: DataFrame, reader: Callable[[Options], Reader], options: Options = Options()) -> DataFrame:
    """Elements of image rows. An image that can't be read gives one row with error and no text, one in which nothing is
    found a row without seq, text and error: every image has a row, and is recognised once."""

    schema = to_arrow_schema(images.sparkSession.createDataFrame([], OUT).schema)

    def run(batches):
        import pyarrow as pa

        read = None
        for batch in batches:
            for r in batch.to_pylist():
                base = {"doc_id": r["path"], "height": r["height"], "width": r["width"], "error": None}
                try:
                    if r["content"] is None:
                        raise ValueError(f"Could not read image: {r['path']}")
                    read = read or reader(options)
                    rows = [base | {"seq": i, "text": t.strip(), "confidence": float(c), "bbox": [[float(x) for x in p] for p in b]} for i, (b, t, c) in enumerate(read(r))]
                except Exception as e:  # one image's failure is a row of its own
                    rows = [base | {"seq": 0, "text": None, "confidence": None, "bbox": None, "error": str(e)}]
                empty = base | {"seq": None, "text": None, "confidence": None, "bbox": None}
                yield pa.RecordBatch.from_pylist(rows or [empty], schema=schema)

    return images.select("path", "height", "width", "channels", "content").mapInArrow(run, OUT)


def prepared(images: DataFrame, step: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """Images after a preprocessing step; where it fails, and where there is none, the image as it was read."""
    return apply(images, lambda image: safely(step, image)) if step else images


def safely(step: Callable[[np.ndarray], np.ndarray], image: np.ndarray) -> np.ndarray:
    try:
        return step(image)
    except Exception:  # the step is meant to help recognition; the raw image still can be read
        return image


def elements(images: DataFrame, reader, options: Options = Options(), step: Callable[[np.ndarray], np.ndarray] | None = preprocess, keep_failed: bool = False) -> DataFrame:
    """Preprocessing, recognize, box geometry and, if asked for, repair. keep_failed keeps a failed image as one row with
    `error` and no text, and an empty image as one without either; else such rows, and the column, are left out."""
    found = recognize(prepared(images, step), reader, options)
    if options.paragraph:
        found = paragraphs(found, keep=("height", "width", "error"), others=True).drop("n_boxes")
    out = with_geometry(found).drop("height", "width")
    out = out if keep_failed else out.where("error IS NULL AND seq IS NOT NULL").drop("error")
    return repair(out) if options.post_process else out


def texts(images: DataFrame, readers: dict[str, Callable[[Options], Reader]], options: Options = Options(), step: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(path, engine, text, error) of each image and engine: the engine's texts in order, a line each, or why there is none.

    One pass without a shuffle: an image is read and preprocessed once for all engines, and an engine's lines are joined
    where they are recognised.
    """
    names = "path string, engine string, text string, error string"
    schema = to_arrow_schema(images.sparkSession.createDataFrame([], names).schema)

    def run(batches):
        import pyarrow as pa

        loaded = {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for name, reader in readers.items():
                    text = error = None
                    try:
                        if r["content"] is None:
                            raise ValueError(f"Could not read image: {r['path']}")
                        if name not in loaded:
                            loaded[name] = reader(options)
                        text = "\n".join(t.strip() for _, t, _ in loaded[name](r))
                    except Exception as e:  # one image's failure is its own
                        error = str(e)
                    rows.append({"path": r["path"], "engine": name, "text": text, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = prepared(images, step)
    return found.select("path", "height", "width", "channels", "content").mapInArrow(run, names)


def overlays(elements_: DataFrame) -> DataFrame:
    """What to draw over an image: the box's points and a label of the first 20 characters with the confidence."""
    return elements_.select("doc_id", "seq", F.col("bbox").alias("points"), F.format_string("%s (%.2f)", F.substring("text", 1, 20), "confidence").alias("label"))
