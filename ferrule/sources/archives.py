"""Entries of package archives, streamed one at a time."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an entry, of an archive's entries together, and of an archive as it is stored.
LARGEST_ENTRY, LARGEST_TOTAL, LARGEST_ARCHIVE = 10 << 20, 256 << 20, 128 << 20
ENTRY = "archive string, entry string, size long, content binary, problem string"
OUTSIDE = re.compile(r"^/|(^|/)\.\.(/|$)|\\|^[A-Za-z]:")


def problem_of(member: tarfile.TarInfo, left: int, largest: int) -> str | None:
    """Why an entry has no content: it leaves its folder, is no file, or is too large."""
    if OUTSIDE.search(member.name) or "\0" in member.name:
        return "unsafe path"
    if member.issym() or member.islnk():
        return "link"
    if not member.isfile():
        return "special"
    if member.size > largest:
        return "too large"
    return "archive too large" if member.size > left else None


def entries_of(name: str, raw: bytes, largest: int, total: int) -> Iterator[tuple]:
    """Rows of an archive's entries in order, folders left out; a broken archive ends with a row that says so."""
    left = total
    try:
        if not raw:
            raise EOFError("no bytes")
        # The stream's own end is checked by gzip; tar takes a cut header for the end of the archive.
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as unpacked, tarfile.open(fileobj=unpacked, mode="r|") as archive:
            for member in archive:
                if member.isdir():
                    continue
                problem = problem_of(member, left, largest)
                content = None if problem else archive.extractfile(member).read()
                left -= len(content or b"")
                yield name, member.name, member.size, content, problem
    except (tarfile.TarError, OSError, EOFError, ValueError, zlib.error) as error:
        yield name, None, None, None, f"broken archive: {type(error).__name__}"


def archive_entries(archives: DataFrame, name: str = "path", content: str = "content", largest: int = LARGEST_ENTRY, total: int = LARGEST_TOTAL) -> DataFrame:
    """(archive, entry, size, content, problem) of every entry of gzipped tar archives.

    One entry's bytes are held at a time, next to its archive's.  Entries that leave their folder, links, special files
    and entries beyond the bounds have no content but a row with their problem, so nothing is lost in silence.  A null
    archive has no entries.
    """

    def run(batches):
        kind = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                own, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows: list[tuple] = []
                size = 0
                for row in entries_of(own, raw, largest, total) if raw is not None else ():
                    rows.append(row)
                    size += len(row[3] or b"")
                    if size > 4 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pydict(dict(zip(kind.names, map(list, zip(*rows, strict=True)), strict=True)), schema=kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(kind.names, map(list, zip(*rows, strict=True)), strict=True)), schema=kind)

    archives.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return archives.select(F.col(name).cast("string").alias("archive"), F.col(content).alias("content")).mapInArrow(run, ENTRY)


def package_archives(spark: SparkSession, root: str, largest: int = LARGEST_ENTRY, total: int = LARGEST_TOTAL, stored: int = LARGEST_ARCHIVE) -> DataFrame:
    """Entries of all landed ``*.tgz`` below ``root``; archives above ``stored`` bytes aren't opened but reported; Spark doesn't list files without bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tgz").load(root)
    none = F.lit(None)
    over = files.where(F.col("length") > stored).select(F.col("path").alias("archive"), none.cast("string").alias("entry"), F.col("length").alias("size"), none.cast("binary").alias("content"), F.lit("archive too large").alias("problem"))
    return archive_entries(files.where(F.col("length") <= stored), "path", "content", largest, total).unionByName(over)


def package_files(entries: DataFrame) -> DataFrame:
    """(archive, file_path, content) of entries with a content, the archive's own top folder cut off, as text; what isn't UTF-8 is replaced."""
    path = F.regexp_replace("entry", r"^(\./)?[^/]+/", "")
    return entries.where("problem IS NULL AND content IS NOT NULL").select("archive", path.alias("file_path"), F.decode("content", "UTF-8").alias("content"))
