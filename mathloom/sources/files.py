"""Scans of text files, and the rows that stand for files that can't be read.

``.txt`` and ``.tex`` are read whole; any other kind, a missing file and bytes that aren't
UTF-8 give an error row instead of ending the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = (".txt", ".tex")
SCHEMA = "source_file string, ordinal int, text string, error_type string, error string"


def _full(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The full names of those files that there are; each folder is listed once, by one call."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, tuple[str, set[str]]] = {}
    found: dict[str, str] = {}
    for path in dict.fromkeys(paths):
        folder, _, name = path.rpartition("/")
        if folder not in folders:
            target = jvm.org.apache.hadoop.fs.Path(folder or ("/" if path.startswith("/") else "."))
            system = target.getFileSystem(conf)
            full, names = system.makeQualified(target).toString().rstrip("/"), set()
            if system.exists(target):
                # All names in one text, "{path,path}": no name holds a slash, so the folder tells them apart.
                listed = jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(system.listStatus(target)))
                names = {*f",{listed[1:-1]}".split(f",{full}/")[1:]}
            folders[folder] = full, names
        full, names = folders[folder]
        if name in names:
            found[path] = f"{full}/{name}"
    return found


def _suffix(path):
    """A file's suffix in lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def _rows(files: DataFrame) -> DataFrame:
    """Text or error of files (source_file, ordinal, content)."""
    suffix = _suffix(F.col("source_file"))
    text = F.coalesce(F.col("content").cast("string"), F.lit(""))  # a file without a byte is not read at all
    is_text = suffix.isin(*TEXT_SUFFIXES)
    good = is_text & F.is_valid_utf8(text)
    kind = F.when(~is_text, "unsupported_format").when(~F.is_valid_utf8(text), "decode_error")
    message = (
        F.when(suffix == ".pdf", "PDF processing not yet implemented")
        .when(~is_text, F.concat(F.lit("Unsupported file format: "), suffix))
        .when(~F.is_valid_utf8(text), "The file is not UTF-8")
    )
    # Line ends as a text-mode read gives them.
    return files.select("source_file", "ordinal", F.when(good, F.regexp_replace(text, "\r\n?", "\n")).alias("text"), kind.alias("error_type"), message.alias("error"))


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path``, each once; columns as in ``SCHEMA``, without an order.

    Contents are read only of files whose suffix is that of a text.  A file without a byte gives no row.
    """

    def listed(**options: str) -> DataFrame:
        return spark.read.format("binaryFile").options(recursiveFileLookup="true", **options).load(path)

    columns = [F.col("path").alias("source_file"), F.lit(None).cast("int").alias("ordinal")]
    texts = listed(pathGlobFilter="*.[tT][xXeE][tTxX]").where(_suffix(F.col("path")).isin(*TEXT_SUFFIXES)).select(*columns, "content")
    names = listed().select(*columns).withColumn("content", F.lit(None).cast("binary")).where(~_suffix(F.col("source_file")).isin(*TEXT_SUFFIXES))
    return _rows(texts.unionByName(names))


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files of a list in its order (``ordinal``), with error rows for missing ones; a path named twice is read for both."""
    full = _full(spark, paths)
    requested = [(p, i, full.get(p)) for i, p in enumerate(paths)]
    missing = [(p, i, None, "file_not_found", f"File not found: {p}") for p, i, full in requested if full is None]
    result = spark.createDataFrame(missing, SCHEMA)
    present = [r for r in requested if r[2] is not None]
    if present:
        wanted = spark.createDataFrame(present, "source_file string, ordinal int, __path string")
        # Contents are read only of texts.
        texts = [*dict.fromkeys(full for p, _, full in present if p.lower().endswith(TEXT_SUFFIXES))]
        if texts:
            found = spark.read.format("binaryFile").load(texts).select(F.col("path").alias("__path"), "content")
            wanted = wanted.join(found, "__path", "left")
        else:
            wanted = wanted.withColumn("content", F.lit(None).cast("binary"))
        result = result.unionByName(_rows(wanted))
    return result
