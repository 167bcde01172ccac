"""Zip archives: list members first, then read them spread over the cluster.

Listing touches only the central directory of each archive. The members are then shuffled by name, so one archive that
holds most of the files is read by many tasks.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Contents of members leave a task in frames of about this size.
FRAME_BYTES, FRAME_ROWS = 4 * 1024 * 1024, 1000


def _open_zip(path: str) -> zipfile.ZipFile:
    system, inner = (fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:")
                     else (fs.LocalFileSystem(), path))
    return zipfile.ZipFile(system.open_input_file(inner))


def list_members(spark: SparkSession, archives) -> DataFrame:
    """(archive, member, size) of every entry; ``archives`` is a list of paths or a DataFrame with ``archive``."""
    paths = archives if isinstance(archives, DataFrame) else spark.createDataFrame(
        [(a,) for a in archives], "archive string")

    def listing(batches):
        for batch in batches:
            for archive in batch["archive"]:
                with _open_zip(archive) as z:
                    infos = z.infolist()
                    yield pd.DataFrame({"archive": archive, "member": [i.filename for i in infos],
                                        "size": [i.file_size for i in infos]})
    return (paths.select("archive").repartition("archive")
            .mapInPandas(listing, "archive string, member string, size long"))


def read_members(members: DataFrame, tasks: int | None = None) -> DataFrame:
    """Content of the given (archive, member) rows; a damaged entry gives NULL content and the error text."""
    def reading(batches):
        opened: dict[str, zipfile.ZipFile] = {}
        names, rows, held = ["archive", "member", "content", "error"], [], 0
        for batch in batches:
            for archive, member in zip(batch["archive"], batch["member"]):
                content, error = None, None
                try:
                    if archive not in opened:
                        opened[archive] = _open_zip(archive)
                    content = opened[archive].read(member)
                except (zipfile.BadZipFile, OSError, KeyError, EOFError, RuntimeError) as problem:
                    error = f"{type(problem).__name__}: {problem}"
                rows.append((archive, member, content, error))
                held += len(content or b"")
                if held >= FRAME_BYTES or len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)
    keys = [F.col("archive"), F.xxhash64("member")]
    spread = members.select("archive", "member")
    spread = spread.repartition(tasks, *keys) if tasks else spread.repartition(*keys)
    return spread.mapInPandas(reading, "archive string, member string, content binary, error string")


def scan_archives(spark: SparkSession, archives, year=None, suffix: str = "") -> DataFrame:
    """Members of the year folder with the given suffix, with content and per-member error."""
    members = list_members(spark, archives).filter(~F.col("member").endswith("/"))
    if year is not None:
        members = members.filter(F.col("member").startswith(f"{year}/"))
    return read_members(members.filter(F.col("member").endswith(suffix)))


def spectrum_members(members: DataFrame, valid: DataFrame) -> DataFrame:
    """Member rows that belong to the folder of a valid identification (extern_id, target_position)."""
    key = r"/([^/]+)/0_([^/]+)/"
    return (members.withColumns({"extern_id": F.regexp_extract("member", key, 1),
                                 "target_position": F.regexp_extract("member", key, 2)})
            .join(valid.select("extern_id", "target_position").distinct(), ["extern_id", "target_position"], "left_semi"))


def parse_analytes(documents: DataFrame) -> DataFrame:
    """Rows (archive, member, extern_id, target_position, matches, error) from identification XML in ``content``.

    Analytes and their matches are found at any depth; the first three matches stay in document order. A malformed
    document gives one row with the error.
    """
    def parse(batches):
        columns = ["archive", "member", "extern_id", "target_position", "matches", "error"]
        for batch in batches:
            rows = []
            for archive, member, content in zip(batch["archive"], batch["member"], batch["content"]):
                try:
                    for a in ET.fromstring(content).iter("Analyte"):
                        found = [{"pattern": m.get("referencePatternName"), "score": float(m.get("globalMatchValue", "0"))}
                                 for m in a.iter("MspMatch")][:3]
                        rows.append((archive, member, a.get("externId"), a.get("targetPosition"), found, None))
                except (ET.ParseError, ValueError, TypeError) as problem:
                    rows.append((archive, member, None, None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=columns)
    return documents.select("archive", "member", "content").mapInPandas(
        parse, "archive string, member string, extern_id string, target_position string, "
               "matches array<struct<pattern:string,score:double>>, error string")
