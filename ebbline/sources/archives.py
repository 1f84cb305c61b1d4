"""ZIP archives of bars. Spark has no ZIP codec: files come as binary rows, and each task unpacks its own archives line by line."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.functions.time import from_archive

ROWS = "archive string, archive_sha256 string, archive_bytes long, symbol string, interval string, period string, line_number int, raw_line binary, raw_line_sha256 string, fields array<string>, error string"
_IDENTITY = re.compile(r"([A-Z0-9]+)-([0-9]+[a-zA-Z]+)-([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)\.(?:zip|csv)$")


def identity(name: str) -> tuple[str, str, str] | None:
    """symbol, interval and period of an archive's or member's name."""
    found = _IDENTITY.search(name)
    return found.groups() if found else None


def _lines(path: str, content: bytes, keep_header: bool) -> Iterator[tuple]:
    digest, size = hashlib.sha256(content).hexdigest(), len(content)
    symbol, interval, period = identity(path) or (None, None, None)
    fail = lambda why: (path, digest, size, symbol, interval, period, None, None, None, None, why)
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if n.endswith(".csv")]
            if len(names) != 1:
                yield fail("not one csv")
                return
            if identity(names[0]) != identity(path):
                yield fail("member name")
                return
            with z.open(names[0]) as member:
                for number, line in enumerate(member, 1):
                    raw = line.rstrip(b"\r\n")
                    if not raw or (not raw[:1].isdigit() and not keep_header):
                        continue
                    fields = raw.decode("utf-8", "replace").split(",")
                    yield (path, digest, size, symbol, interval, period, number, raw, hashlib.sha256(raw).hexdigest(), fields, None if len(fields) == 12 else "field count")
    except (zipfile.BadZipFile, OSError, RuntimeError, zlib.error) as e:
        yield fail(f"broken archive: {type(e).__name__}")


def files(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """path and content of the files below root."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select("path", "content")


def unpacked(archives: DataFrame, keep_header: bool = False, rows_at_once: int = 20_000) -> DataFrame:
    """Every physical line of every archive (path, content) with its bytes, hash and archive; a faulty archive is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ROWS.split(", ")]
        rows = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for row in _lines(path, content, keep_header):
                    rows.append(row)
                    if len(rows) >= rows_at_once:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return archives.select("path", "content").mapInPandas(run, ROWS)


def scan(spark: SparkSession, root: str, pattern: str = "*.zip", **how) -> DataFrame:
    """Lines of the archives below root, as ``unpacked`` gives them."""
    return unpacked(files(spark, root, pattern), **how)


def _fault(path: str, content: bytes) -> str | None:
    """What is wrong with an archive itself: it can't be opened, a member's checksum fails, or it isn't the one named member."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.testzip() is not None:
                return "damaged member"
            names = z.namelist()
    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, zlib.error):
        return "broken archive"
    if len(names) != 1:
        return "not one member"
    return None if identity(names[0]) and identity(names[0]) == identity(path) else "member name"


def judged(archives: DataFrame, checksums: DataFrame) -> DataFrame:
    """Every archive (path, content) against its published checksum (name, sha256): archive, name, sha256, expected and verdict, "ok" or the first fault."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(p, p.rsplit("/", 1)[-1], hashlib.sha256(c).hexdigest(), _fault(p, c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(made, columns=["archive", "name", "sha256", "fault"])

    found = archives.select("path", "content").mapInPandas(run, "archive string, name string, sha256 string, fault string")
    joined = found.join(checksums.select("name", F.lower("sha256").alias("expected")), "name", "left")
    verdict = F.when(F.col("expected").isNull(), "no checksum").when(F.col("expected") != F.col("sha256"), "checksum differs").otherwise(F.coalesce("fault", F.lit("ok")))
    return joined.select("archive", "name", "sha256", "expected", verdict.alias("verdict"))


def verdicts(spark: SparkSession, root: str, checksums: DataFrame, pattern: str = "*.zip") -> DataFrame:
    """Verdicts of the archives below root."""
    return judged(files(spark, root, pattern), checksums)


def verified(spark: SparkSession, root: str, checksums: DataFrame, pattern: str = "*.zip", **how) -> DataFrame:
    """The lines of the archives whose verdict is ok."""
    good = verdicts(spark, root, checksums, pattern).filter("verdict = 'ok'").select("archive")
    return scan(spark, root, pattern, **how).join(good, "archive", "left_semi")


def typed(lines: DataFrame, micros_from: int = 10**15) -> DataFrame:
    """Typed bars of the lines without an error."""
    f = lambda i, kind: F.get("fields", F.lit(i)).try_cast(kind)
    names = ("open", "high", "low", "close", "volume")
    return lines.filter("error IS NULL").select(
        "symbol",
        "interval",
        "line_number",
        from_archive(f(0, "long"), micros_from).alias("open_time"),
        *(f(i, "double").alias(n) for i, n in enumerate(names, 1)),
        from_archive(f(6, "long"), micros_from).alias("close_time"),
        f(7, "double").alias("quote_volume"),
        f(8, "long").alias("trade_count"),
        f(9, "double").alias("taker_buy_base_volume"),
        f(10, "double").alias("taker_buy_quote_volume"),
    )


def before(bars: DataFrame, end_ms: int) -> DataFrame:
    """Rows before a sealed end."""
    return bars.filter(F.col("open_time") < end_ms)


def checks(lines: DataFrame) -> DataFrame:
    """Per archive: rows, first and last time, errors, and whether the times rise line by line."""
    from pyspark.sql import Window

    ts = F.get("fields", F.lit(0)).try_cast("long")
    made = lines.withColumn("ts", from_archive(ts)).withColumn("falls", F.coalesce(F.lag("ts").over(Window.partitionBy("archive").orderBy("line_number")) >= F.col("ts"), F.lit(False)))
    return made.groupBy("archive", "archive_sha256").agg(F.count("fields").alias("rows"), F.min("ts").alias("first_ms"), F.max("ts").alias("last_ms"), F.count("error").alias("errors"), (~F.bool_or("falls")).alias("ordered"))


def discover(spark: SparkSession, root: str, interval: str, first: str, last: str, suffix: str = "") -> DataFrame:
    """symbol, period and archive of the archives of an interval whose period is within first and last; names are read, contents are not."""
    name = F.regexp_extract("path", r"([A-Z0-9]+)-" + re.escape(interval) + r"-([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)\.zip$", 0)
    part = lambda i: F.regexp_extract(name, r"^([A-Z0-9]+)-[0-9]+[a-zA-Z]+-(.+)\.zip$", i)
    made = files(spark, root, f"*-{interval}-*.zip").select(part(1).alias("symbol"), part(2).alias("period"), F.col("path").alias("archive"))
    return made.filter((F.col("symbol") != "") & F.col("symbol").endswith(suffix) & F.col("period").between(first, last))
