"""WARC archives: writing with revisit records, reading by boundary chains.

A record's text may hold anything, also what looks like the start of a record. When
archives are read, tasks therefore only propose: every place that has the magic, a
header and a length that ends at another magic or the end of the file becomes a
candidate with its successor's offset. Pointer jumping over (archive, offset) from
each archive's start then keeps the candidates that the chain of lengths reaches;
rounds grow with the logarithm of the records in an archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegate.llm.common import folder, written
from casegate.session import broadcast_if_small, settled

# Fixed values of the format.
MAGIC, GAP = "WARC/1.1\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Fields that are read, in lower case.
READ = {
    "content-length",
    "warc-type",
    "warc-payload-digest",
    "warc-payload-length",
    "warc-record-id",
    "warc-target-uri",
    "warc-refers-to",
}
# Records per archive file.
ARCHIVE_RECORDS = 2000

CANDIDATES = (
    "archive string, start bigint, following bigint, page_id bigint, url string, record_type string, "
    "refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean"
)


def base32_of(digits: Column) -> Column:
    """A SHA-1 in hex digits as upper-case base32, four letters from each five digits."""
    letters = []
    for at in range(1, 41, 5):
        value = F.conv(F.substring(digits, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), 1, 32).substr(F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")


def _hashed(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # Every letter names the hash: it is taken once per row, not once per letter.
    hashed = settled(pages.select("page_id", "url", "html"), {"size": F.length(payload).cast("bigint"), "digits": F.sha1(payload)})
    return hashed.select("page_id", "url", "html", "size", base32_of(F.col("digits")).alias("digest"))


def repeated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Payloads of ``min_bytes`` or more that several rows have: digest, size, and the
    largest page_id as ``top``."""
    return (
        _hashed(pages)
        .where(F.col("size") >= min_bytes)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
        .where("n > 1")
    )


def records(pages: DataFrame, min_bytes: int = 0, tops: DataFrame | None = None) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html), as text in ``record``.

    The payload is html in UTF-8; null is empty. Of payloads that are equal and have
    ``min_bytes`` or more, those of the largest page_id are responses and the others
    revisit it, without a payload of their own; a null page_id counts as smallest.
    Shorter payloads are all responses. A page_id that repeats keeps all its rows.
    ``tops`` are the ``repeated`` payloads, if they are known already.
    """
    rows = _hashed(pages)
    tops = repeated(pages, min_bytes) if tops is None else tops
    revisit = F.coalesce(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.lit(False))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda value: F.concat(F.lit("<urn:page:"), value.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("top")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    return rows.join(tops, ["digest", "size"], "left").select(F.concat(header, body).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write the records of ``pages`` as archives below ``path``. A record is a line
    of the text writer whose line end is the gap between records. The repeated payloads
    are found first: up to ``BROADCAST_ROWS`` of them go to all tasks, and no page is
    shuffled; beyond, pages and they meet by digest."""
    tops = broadcast_if_small(written(repeated(pages, min_bytes), "tops"))
    rows = records(pages, min_bytes, tops)
    rows.write.option("lineSep", GAP).option("maxRecordsPerFile", archive_records).text(path)


def _number(value: str | None) -> int | None:
    found = re.search(r"-?\d+", value or "")
    return int(found[0]) if found else None


def _fields(content: bytes, start: int, head: int) -> dict[str, tuple[int, str]]:
    """Last line of each name between two offsets: where it starts, and its value."""
    found = {}
    for line in content[start:head].split(b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = start, value.strip()
        start += len(line) + 2
    return found


def candidates_of(content: bytes) -> Iterator[dict]:
    """Every place of an archive that reads as a record, with its successor's offset
    (the archive's length after the last). A header may have any length; places before
    the same blank line share its search and its lines, so the work stays linear."""
    head, shared = -1, {}
    for magic in re.finditer(rb"WARC/1\.[01]\r\n", content):
        if head < magic.end() - 2:
            head = content.find(b"\r\n\r\n", magic.end() - 2)
            if head < 0:
                break
            shared = _fields(content, magic.end(), head)
        fields = {k: shared[k][1] for k in READ & shared.keys() if shared[k][0] >= magic.end()}
        if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
            continue
        first = head + 4
        last = first + int(fields["content-length"])
        after = last + len(GAP)
        if content[last:after] != GAP.encode() or not (after == len(content) or content.startswith(b"WARC/1.", after)):
            continue
        kind, said = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
        digest, size = said, _number(fields.get("warc-payload-length"))
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(memoryview(content)[first:last]).digest()).decode()
            size = last - first
        yield {
            "start": magic.start(),
            "following": after,
            "page_id": _number(fields.get("warc-record-id")),
            "url": fields.get("warc-target-uri"),
            "record_type": kind,
            "refers_to": _number(fields.get("warc-refers-to")),
            "payload_bytes": size,
            "payload_digest": digest,
            "intact": digest == said,
        }


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            found = pd.DataFrame(list(candidates_of(content)))
            if len(found):
                found["archive"] = path
                for name in ("page_id", "refers_to", "payload_bytes"):
                    found[name] = found[name].astype("Int64")
                yield found


def reachable(links: DataFrame, start: int = 0) -> DataFrame:
    """Pointer jumping: (archive, start) of the candidates that the chain from
    ``start`` reaches. ``links`` has (archive, start, following). In round k a row
    that is reached marks the row 2**k steps on, and every pointer doubles. A pointer
    to no candidate ends its chain."""
    state = written(links.select("archive", "start", F.col("following").alias("jump"), (F.col("start") == start).alias("reached")), "chain")
    while state.where("jump is not null").limit(1).count():
        onward = state.select("archive", F.col("start").alias("jump"), F.col("jump").alias("further"))
        marks = state.where("reached and jump is not null").select("archive", F.col("jump").alias("start"), F.lit(True).alias("marked"))
        state = written(
            state.join(marks.distinct(), ["archive", "start"], "left")
            .join(onward, ["archive", "jump"], "left")
            .select("archive", "start", F.col("further").alias("jump"), (F.col("reached") | F.col("marked").isNotNull()).alias("reached")),
            "chain",
        )
    return state.where("reached").select("archive", "start")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``: archive, start, page_id, url,
    record_type, refers_to, payload_bytes, payload_digest, intact.

    Size and digest of a response are those of the payload as read, and ``intact``
    says whether its header agrees; a revisit carries those of the payload it refers
    to. Archives without a record at their start give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = written(files.mapInPandas(_scan, CANDIDATES).withColumn("archive_key", F.xxhash64("archive")), "candidates")
    chain = reachable(found.select(F.col("archive_key").alias("archive"), "start", "following"))
    return found.join(chain.withColumnRenamed("archive", "archive_key"), ["archive_key", "start"], "left_semi").drop("archive_key", "following")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back."""
    path = folder(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
