"""Sources that give files (path, content, length), guards against what isn't text, and lines."""

from __future__ import annotations

import contextlib
import re
import tarfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

MAX_FILE, MAX_OBJECT, MAX_ENTRY = 1 << 20, 5 << 20, 2 << 20
#: Archives are dealt to tasks in slices of so many bytes.
SLICE = 64 << 20
#: How gzip, bzip2 and xz files start.
PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ")
ENTRY = pa.schema([("path", pa.string()), ("entry", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("content", pa.binary())])
FILLED = pa.schema([("entry", pa.string()), ("content", pa.binary()), ("length", pa.int64())])
# Image entries that are the system's, not the application's.
SYSTEM_PREFIXES = ("usr/share/doc/", "usr/share/man/", "usr/share/locale/", "usr/share/zoneinfo/", "usr/share/i18n/", "usr/share/terminfo/", "usr/lib/", "usr/lib64/", "lib/", "lib64/", "proc/", "sys/", "dev/", "run/", "var/cache/", "var/log/")
CERTIFICATES = r"^etc/ssl/certs/ca-(certificates|bundle)\.crt$|^etc/ssl/cert\.pem$|^etc/pki/tls/certs/ca-bundle(\.trust)?\.crt$|^etc/pki/ca-trust/extracted/|^usr/share/ca-certificates/|^etc/ca-certificates/"
REPORT_NAMES = ("report.html", "results.json", "results.sarif", "scan.json", "scan-results.json")


def text_only(files: DataFrame) -> DataFrame:
    """Binary content that passes as text: no binary extension, no NUL in the first 512 bytes, valid UTF-8."""
    head = F.hex(F.substring("content", 1, 512))
    return files.filter(~P.is_binary_name(F.col("path")) & ~head.rlike("^(..)*00")).withColumn("content", F.try_validate_utf8(F.col("content"))).filter(F.col("content").isNotNull())


def read_files(spark: SparkSession, root: str, max_bytes: int = MAX_FILE, max_depth: int | None = None, include_deps: bool = False) -> DataFrame:
    """A file tree or one file. Vendor folders are left out unless include_deps, which leaves out only .git and target."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= max_bytes)
    plain = F.regexp_replace("path", "^file:/+", "/")
    files = files.select(plain.alias("path"), "content", "length")
    alone = re.sub("^file:/+", "/", base)
    inner = F.when(F.col("path") == alone, F.lit("")).otherwise(P.relativize(F.col("path"), base))  # a file named by itself is read wherever it lies
    files = files.filter(~inner.rlike(r"(^|/)\.git/") & (~inner.rlike("(^|/)target/") if include_deps else ~P.is_vendor(inner)))
    if max_depth is not None:
        files = files.filter(F.length(F.regexp_replace(inner, "[^/]", "")) <= max_depth)
    return text_only(files)


def read_objects(spark: SparkSession, uri_prefix: str, max_bytes: int = MAX_OBJECT) -> DataFrame:
    """Objects below a key prefix of a store that Spark reads; empty and large ones and folder keys are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri_prefix).filter((F.col("length") > 0) & (F.col("length") <= max_bytes))
    return text_only(found.filter(~F.col("path").endswith("/")).select(F.regexp_replace("path", "^s3a://", "s3://").alias("path"), "content", "length"))


def open_seekable(uri: str) -> pa.NativeFile:
    """A file that is read from any place on, in a local folder or a store that Arrow reads."""
    scheme, colon, path = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + path.lstrip("/") if colon else uri)
    store, path = fs.FileSystem.from_uri(f"{scheme}:{quote(path)}")
    return store.open_input_file(path)


def image_entries(archives: DataFrame, max_bytes: int = MAX_ENTRY, opened: Callable[[str], BinaryIO] = open_seekable) -> DataFrame:
    """path, entry, at, size, content of the regular entries of 1 to max_bytes bytes in tar archives, named by the column path.

    Only headers are read, by seeking from one to the next; at is where an entry's bytes start. What can't be read from a
    place on has its content here and no place: entries of compressed archives, which are read as a stream, and sparse
    entries. An archive that breaks off gives what comes before; one that is no archive, or empty, gives nothing.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                rows, held = [], 0
                with contextlib.closing(opened(path)) as file:
                    packed = file.read(6).startswith(PACKED)
                    file.seek(0)
                    try:
                        with tarfile.open(fileobj=file, mode="r|*" if packed else "r:") as tar:
                            for m in tar:
                                tar.members = []  # tarfile would keep every header
                                if not m.isfile() or not 0 < m.size <= max_bytes:
                                    continue
                                content = tar.extractfile(m).read() if packed or m.issparse() else None
                                rows.append((path, m.name.removeprefix("./"), None if content is not None else m.offset_data, m.size, content))
                                held += len(content or b"") + 200
                                if held > SLICE // 4:
                                    yield from _batch(rows, ENTRY)
                                    rows, held = [], 0
                    except (tarfile.ReadError, EOFError, zlib.error):
                        pass
                yield from _batch(rows, ENTRY)

    return archives.select("path").mapInArrow(listed, "path string, entry string, at long, size long, content binary")


def read_entries(entries: DataFrame, opened: Callable[[str], BinaryIO] = open_seekable) -> DataFrame:
    """entry, content, length: the bytes of listed entries. Slices of SLICE bytes of each archive are dealt to all tasks, and read in order."""
    spark = entries.sparkSession

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = None, None
        for b in batches:
            rows, held = [], 0
            for r in b.to_pylist():
                if r["at"] is not None:
                    if r["path"] != last:
                        if file:
                            file.close()
                        last, file = r["path"], opened(r["path"])
                    file.seek(r["at"])
                    r["content"] = file.read(r["size"])
                    if len(r["content"]) < r["size"]:  # the archive breaks off here
                        continue
                rows.append((r["entry"], r["content"], r["size"]))
                held += r["size"]
                if held > SLICE // 4:
                    yield from _batch(rows, FILLED)
                    rows, held = [], 0
            yield from _batch(rows, FILLED)
        if file:
            file.close()

    place = F.coalesce(F.floor(F.col("at") / SLICE), F.xxhash64("entry"))
    dealt = entries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", place).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(filled, "entry string, content binary, length long")


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema)], schema=schema)


def read_image_tar(spark: SparkSession, tar_glob: str, image: str, max_bytes: int = MAX_ENTRY, opened: Callable[[str], BinaryIO] = open_seekable) -> DataFrame:
    """Regular entries of exported image file systems; one row per entry, system folders and certificate stores left out.

    An archive of any size is read by many tasks: one lists its headers, and all read the entries that are wanted, so that
    neither a row nor a task holds an archive, and what is left out is never read. Compressed archives are streamed by one
    task each.
    """
    entries = image_entries(spark.read.format("binaryFile").load(tar_glob).select("path"), max_bytes, opened)
    system = F.lit(False)
    for prefix in SYSTEM_PREFIXES:
        system = system | F.col("entry").startswith(prefix)
    kept = entries.filter(~system & ~F.col("entry").rlike(CERTIFICATES) & ~P.is_binary_name(F.col("entry")))
    return text_only(read_entries(kept, opened).select(F.concat(F.lit(f"docker://{image}/"), "entry").alias("path"), "content", "length"))


def from_text(df: DataFrame, text_col: str, label: str = "<stdin>") -> DataFrame:
    return df.select(F.lit(label).alias("path"), F.col(text_col).alias("content"), F.octet_length(text_col).cast("long").alias("length"))


def from_table(df: DataFrame, path: Column, text_col: str) -> DataFrame:
    return df.select(path.alias("path"), F.col(text_col).alias("content"), F.octet_length(text_col).cast("long").alias("length"))


def is_minified(content: Column) -> Column:
    """The first line is over 10,000 bytes, or there are fewer than 10 lines and over 50,000 bytes."""
    lines = F.split(content, "\n")
    return (F.octet_length(F.element_at(lines, 1)) > 10_000) | ((F.size(lines) < 10) & (F.octet_length(content) > 50_000))


def is_own_output(path: Column, content: Column) -> Column:
    head = F.substring(content, 1, 300)
    signature = head.contains('"version"') & head.contains('"total_findings"') & head.contains('"findings"')
    ext = F.coalesce(P.file_ext(path), F.lit(""))
    return (ext == "sarif") | P.basename(path).isin(*REPORT_NAMES) | ((ext == "json") & signature)


def skip_noise(files: DataFrame) -> DataFrame:
    return files.filter(~P.is_lockfile(F.col("path")) & ~is_minified(F.col("content")) & ~is_own_output(F.col("path"), F.col("content")))


def explode_lines(files: DataFrame) -> DataFrame:
    """path, line_number from 1, line, line_before, line_after. One trailing CR goes, and so does an empty last line. Neighbours come from the array, so that nothing is shuffled.

    The explode is an outer one, whose row for a file without lines goes again: an inner one makes Spark look at the array's
    size before, and so split every text once more.
    """
    parts = F.split("content", "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    plain = F.when(F.contains("content", F.lit("\r")), F.transform(whole, lambda x: F.regexp_replace(x, "\r$", ""))).otherwise(whole)
    at = files.select("path", plain.alias("_l")).select("path", "_l", F.posexplode_outer("_l").alias("_i", "line")).filter(F.col("_i").isNotNull())
    return at.select("path", (F.col("_i") + 1).alias("line_number"), "line", F.when(F.col("_i") > 0, F.get("_l", F.col("_i") - 1)).alias("line_before"), F.get("_l", F.col("_i") + 1).alias("line_after"))


def scan_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def warnings(files: DataFrame) -> DataFrame:
    """Files that can't be read as text, as (category, path, message), instead of stopping the scan."""
    return files.filter(F.try_validate_utf8("content").isNull()).select(F.lit("encoding").alias("category"), "path", F.lit("not valid UTF-8").alias("message"))
