"""The recognition branch: what is arithmetic runs as expressions, what needs a library is a backend.

Image libraries and services are not part of this engine.  A backend is any object with
``is_available`` and ``recognize(content) -> dict``; without one every image gets an error row.
"""

from __future__ import annotations

import base64
import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions.latex import text_to_latex
from mathloom.runtime import spread


@dataclass(frozen=True)
class OCRConfig:
    """Limits of preprocessing and of the services."""

    min_size: int = 100
    max_size: int = 4096
    min_region_width: int = 20
    min_region_height: int = 10
    region_padding: int = 5
    timeout: int = 30
    max_retries: int = 3
    retry_delay: float = 1.0
    min_confidence: float = 0.7
    max_image_bytes: int = 10_000_000
    enable_fallback: bool = True


class OCRBackend(Protocol):
    name: str

    def is_available(self) -> bool: ...

    def recognize(self, content: bytes) -> dict: ...


class HttpOCR:
    """A recognition service that takes an image as JSON and replies with formulas.

    ``post(url, headers, body, timeout)`` gives the reply as a dict, with ``status`` and
    ``retry_after`` where the service was busy; it is all this engine needs of a client.
    """

    name = "http"

    def __init__(self, url: str, headers: dict[str, str], post: Callable[[str, dict, dict, int], dict], config: OCRConfig = OCRConfig()):
        self.url, self.headers, self.post, self.config = url, headers, post, config

    def is_available(self) -> bool:
        return bool(self.url and self.headers and all(self.headers.values()))

    def recognize(self, content: bytes) -> dict:
        from mathloom.operators.pixels import prepared_png

        body = {
            "src": "data:image/png;base64," + base64.b64encode(prepared_png(content, self.config)).decode(),
            "formats": ["latex_styled", "mathml", "asciimath"],
            "ocr": ["math", "text"],
        }
        reply = with_retries(lambda: self.post(self.url, self.headers, body, self.config.timeout), self.config)
        return {
            "latex": reply.get("latex_styled", ""),
            "confidence": float(reply.get("latex_confidence", 0.0)),
            "mathml": reply.get("mathml"),
            "asciimath": reply.get("asciimath"),
            "error": reply.get("error"),
        }


class LocalOCR:
    """Text recognition by an installed program, if its library is there; the text becomes LaTeX in ``recognize``."""

    name = "local"
    # Fixed value: the program's modes and the characters it may find.
    options = r"--oem 3 --psm 6 -c tessedit_char_whitelist=0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+-*/=()[]{}.,<>^_\\"

    def is_available(self) -> bool:
        try:
            import PIL  # noqa: F401
            import pytesseract

            pytesseract.get_tesseract_version()
        except Exception:  # a missing program shows in many ways
            return False
        return True

    def recognize(self, content: bytes) -> dict:
        import io

        import pytesseract
        from PIL import Image

        image = Image.open(io.BytesIO(content))
        words = [float(c) for c in pytesseract.image_to_data(image, output_type=pytesseract.Output.DICT)["conf"] if float(c) > 0]
        text = pytesseract.image_to_string(image, config=self.options)
        return {"text": text, "confidence": sum(words) / len(words) / 100 if words else 0.0}


#: Results that a task remembers.
MOST_REMEMBERED = 1000
RESULT = "latex string, confidence double, text string, mathml string, asciimath string, error string, backend string"
_FIELDS = ("latex", "confidence", "text", "mathml", "asciimath", "error", "backend")
_TYPES = (pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())


def image_source(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder: path, content and the hash of all of it."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("image_hash"))


def fitted_size(width: Column, height: Column, config: OCRConfig = OCRConfig()) -> Column:
    """Width and height scaled up to the least or down to the largest side allowed."""
    small = (width < config.min_size) | (height < config.min_size)
    large = (width > config.max_size) | (height > config.max_size)
    up, down = F.lit(float(config.min_size)) / F.least(width, height), F.lit(float(config.max_size)) / F.greatest(width, height)

    def scaled(side: Column) -> Column:
        return F.when(small, F.floor(side * up)).when(large, F.floor(side * down)).otherwise(side).cast("int")

    return F.struct(scaled(width).alias("width"), scaled(height).alias("height"))


def keep_box(width: Column, height: Column, page_width: Column, page_height: Column, config: OCRConfig = OCRConfig()) -> Column:
    """Whether a region is neither too small for a formula nor nearly the page."""
    return (width >= config.min_region_width) & (height >= config.min_region_height) & (width <= page_width * 0.9) & (height <= page_height * 0.9)


def padded_box(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column, config: OCRConfig = OCRConfig()) -> Column:
    """A region with its padding, inside the page."""
    pad = config.region_padding
    left, top = F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad)
    return F.struct(left.alias("x"), top.alias("y"), F.least(page_width - left, width + 2 * pad).alias("width"), F.least(page_height - top, height + 2 * pad).alias("height"))


def high_contrast(histogram: Column) -> Column:
    """Whether over 80 % of a grey image's pixels are darker than 50 or at least 200; from its 256 counts."""
    whole = F.aggregate(histogram, F.lit(0).cast("bigint"), lambda a, n: a + n)
    ends = F.aggregate(F.concat(F.slice(histogram, 1, 50), F.slice(histogram, 201, 56)), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return F.when(whole > 0, ends / whole > 0.8).otherwise(False)


def valid_result(latex: Column, confidence: Column, error: Column) -> Column:
    """A result counts if it has a formula, some confidence and no error."""
    return F.coalesce((latex != "") & (confidence > 0) & F.coalesce(error == "", F.lit(True)), F.lit(False))


def with_retries(call: Callable[[], dict], config: OCRConfig = OCRConfig(), sleep: Callable[[float], None] = time.sleep) -> dict:
    """``call`` until it succeeds; waits double, and a ``retry_after`` in the reply is honoured."""
    last: Exception | None = None
    for attempt in range(config.max_retries):
        try:
            reply = call()
        except OSError as e:
            last = e
            if attempt + 1 < config.max_retries:
                sleep(config.retry_delay * 2**attempt)
            continue
        if reply.get("status") == 429:
            sleep(float(reply.get("retry_after", 60)))
            continue
        return reply
    raise OSError(f"Failed after {config.max_retries} attempts: {last}")


def recognize(images: DataFrame, backends: list[OCRBackend], config: OCRConfig = OCRConfig()) -> DataFrame:
    """``images`` (content) with the result of the first backend that gives a valid one.

    Images stay where they are: a task remembers the results of those it met by their hash, so
    an image that many rows hold is recognised once a task, and no content is shuffled.  An unavailable or failing backend gives way to the
    next if fallback is on; the last error stays.  NULL content has the result NULL.
    """

    def one(content: bytes) -> dict:
        result: dict = {"latex": "", "confidence": 0.0, "error": "No OCR backend available"}
        for backend in backends:
            if not backend.is_available():
                continue
            try:
                result = {"error": None} | backend.recognize(content) | {"backend": backend.name}
            except Exception as e:  # a backend may fail in any way; that is a row, not the end of the job
                result = {"latex": "", "confidence": 0.0, "error": str(e), "backend": backend.name}
            if (result.get("latex") or result.get("text")) and result.get("confidence", 0) > 0 and not result.get("error") or not config.enable_fallback:
                break
        return result

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, dict] = {}
        for batch in batches:
            rows = []
            for content in batch.to_pylist():
                if content is None:
                    rows.append(None)
                    continue
                key = hashlib.sha256(content).digest()
                if key not in known:
                    if len(known) >= MOST_REMEMBERED:
                        known.clear()
                    known[key] = one(content)
                rows.append({f: known[key].get(f) for f in _FIELDS})
            yield pa.array(rows, pa.struct([*zip(_FIELDS, _TYPES, strict=True)]))

    done = F.arrow_udf(run, f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")(F.col("content"))
    rows = spread(images.drop(*_FIELDS)).withColumn("__done", done)
    text = F.when(F.col("__done").isNotNull(), F.coalesce("__done.latex", text_to_latex(F.col("__done.text"))))
    return rows.select(*(c for c in rows.columns if c != "__done"), text.alias("latex"), *(F.col("__done")[f].alias(f) for f in _FIELDS[1:]))


def recognize_regions(images: DataFrame, keys: tuple[str, ...], backends: list[OCRBackend], config: OCRConfig = OCRConfig()) -> DataFrame:
    """keys, x, y, width and height of each formula region of each image, in reading order, with its result."""
    from mathloom.operators.pixels import math_regions

    return recognize(math_regions(images, keys, config), backends, config).drop("content")
