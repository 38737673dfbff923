"""Event log access: resumed reads, rendering and parsing of event text."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow import contracts as c
from quireflow.functions import intake, shaping
from quireflow.operators import scan


def events_after(events: DataFrame, job_id, after_seq: int, limit: int = c.FETCH_LIMIT) -> DataFrame:
    """The next events of one job after ``after_seq``, by seq."""
    return events.filter((F.col("job_id") == job_id) & (F.col("seq") > after_seq)).orderBy("seq").limit(limit)


def events_after_cursors(events: DataFrame, cursors: DataFrame, limit: int = c.FETCH_LIMIT, **route) -> DataFrame:
    """The same for many readers at once: cursors has one row (job_id, after_seq) per job."""
    later = events.join(cursors, "job_id").filter(F.col("seq") > F.col("after_seq"))
    return scan.numbered(later, ["job_id"], ["seq"], "_rn", 1, **route).filter(F.col("_rn") <= limit).drop("_rn")


def resume_cursors(requests: DataFrame) -> DataFrame:
    """Requests (job_id, header, query) with the seq they resume after."""
    return requests.withColumn("after_seq", intake.resume_seq(F.col("header"), F.col("query")))


def until_final(events: DataFrame) -> DataFrame:
    """Events up to and including the first final one of their job."""
    final = events.filter(F.col("kind").isin(*c.FINAL_KINDS)).groupBy("job_id").agg(F.min("seq").alias("_final"))
    return events.join(final, "job_id", "left").filter(F.col("_final").isNull() | (F.col("seq") <= F.col("_final"))).drop("_final")


def as_sse(events: DataFrame, envelope: Column) -> DataFrame:
    return events.select("job_id", "seq", shaping.sse_text(F.col("seq"), F.col("kind"), envelope).alias("sse"))


# What ends a record, by the line ends of a capture.
_BLANK_LINES = ("\n\n", "\r\n\r\n", "\r\r")


def _captures(spark: SparkSession, path: str | list[str], separator: str, longest: int | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", separator)
    if longest:
        reader = reader.option("mapreduce.input.linerecordreader.line.maxlength", longest)  # longer rows are passed over, not held
    return reader.text(path)


def _by_separator(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a capture by the blank line they have most of. Only blank lines are held while they are counted."""
    named = lambda file: re.sub("^file:/+", "file:/", file)  # noqa: E731 - both forms are in use
    counts = {named(file): [0, 0, 0] for file in spark.read.text(path).inputFiles()}

    def count(line_end: str, blank: dict[int, str]) -> None:
        found = _captures(spark, path, line_end, 8).select("value", F.col("_metadata.file_path").alias("file"))
        for row in found.groupBy("file").agg(*[F.count_if(F.col("value") == line).alias(f"n{k}") for k, line in blank.items()]).collect():  # a row per file
            for k in blank:
                counts[named(row.file)][k] = row[f"n{k}"]

    count("\n", {0: "", 1: "\r"})
    if not all(map(any, counts.values())):
        count("\r", {2: ""})
    out: dict[str, list[str]] = {}
    for file, n in counts.items():
        out.setdefault(_BLANK_LINES[n.index(max(n))], []).append(file)
    return out


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """Captured event text: one row (id, event, data) per record that has data. A file is read record by record, by the blank line it has most
    of: read by another, it would be a single row."""
    separators = _by_separator(spark, path) or {_BLANK_LINES[0]: []}
    chunks = None
    for separator, files in separators.items():
        # all files of one form are read by the path, which also holds for none
        found = _captures(spark, path if len(separators) == 1 else [_as_path(f) for f in files], separator)
        chunks = found.select("value") if chunks is None else chunks.unionByName(found.select("value"))
    # a capture of mixed line ends has blank lines of other forms too: what one chunk holds is cut again
    records = chunks.select(F.explode(F.split("value", "|".join(_BLANK_LINES))).alias("record"))
    return parse_sse(records, "record").select("id", "event", "data")


def _as_path(file: str) -> str:
    """A file as a path of its own: its name is not encoded and its signs are no pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file))


def parse_sse(records: DataFrame, column: str) -> DataFrame:
    """Records with id, event and data: comment lines are skipped, data lines joined by newline,
    one blank after the colon belongs to the syntax; the last id or event line wins."""
    lines = F.filter(F.split(F.regexp_replace(column, "\r\n?", "\n"), "\n"), lambda s: (s != "") & ~s.startswith(":"))
    fields = F.transform(lines, lambda s: F.struct(
        F.substring_index(s, ":", 1).alias("name"),
        F.when(F.instr(s, ":") == 0, "").otherwise(
            F.regexp_replace(F.substring(s, F.instr(s, ":") + 1, F.length(s)), "^ ", "")).alias("value")))

    def values(name: str) -> Column:
        return F.transform(F.filter("_f", lambda f: f["name"] == name), lambda f: f["value"])

    def last(name: str, other: str) -> Column:
        return F.coalesce(F.try_element_at(values(name), F.lit(-1)), F.lit(other))

    parsed = records.withColumn("_f", fields).withColumns({
        "id": last("id", ""), "event": last("event", "message"), "_data": values("data")})
    return parsed.filter(F.size("_data") > 0).withColumn("data", F.array_join("_data", "\n")).drop("_f", "_data")
