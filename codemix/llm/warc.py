"""WARC archives written from pages, and read by boundary-chain verification.

Writing: pages with the same payload of at least ``REVISIT_BYTES`` bytes share one
response record, that of the largest id, and the others become revisits of it.
Tasks write files of bounded size.

Reading: a file is read in ranges by many tasks. The start of a record can't be told
from the same bytes inside a payload, so a task lists every candidate of its range with
the offset where a record that begins there would be followed by the next, and follows
these offsets to where they leave the range. Pointer jumping over those, from the
start of each file, keeps the offsets that are reached; jumps double in length every
round. A last pass reads the records from each range's reached entry on and checks
their payloads' digests. A file whose chain doesn't end with the file is an error.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from codemix.llm.common import bounded_batches, remove, stored, written
from codemix.llm.files import committed, opened
from codemix.session import shared_folder

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
#: Most shared payloads whose digests are broadcast; more are joined by shuffling.
MAX_BROADCAST = 1_000_000
RANGE_BYTES = 4 << 20
#: Ranges that a task reads when there are many.
RANGES_PER_TASK = 16
#: What is read behind a range for headers; one that goes on is read by itself.
HEADER_BYTES = 1 << 20
MAGIC = b"WARC/1."
#: A record's first line; no field is like it, so that no header holds another one's.
_FIRST = re.compile(rb"WARC/1\.[0-9]+\r\n")
_LENGTH = re.compile(rb"(?i)[ \t]*content-length[ \t]*:")
DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = re.compile(rb"<urn:x-page:(-?[0-9]+|none)>")


# ---- writing --------------------------------------------------------------

def _name(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP header of its page but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    # a header line can't hold line ends
    address = re.sub(r"[\x00-\x20]+", "%20", url or "") or "about:blank"
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info() -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-info:0>\r\nWARC-Date: {DATE}\r\n"
    return head.encode() + b"Content-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is set for revisits."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"),
    )
    # only payloads that several pages have; digests are shuffled, and payloads stay where they are
    shared = written(rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")
    ).where("n > 1").select("digest", "first"), "warc-shared")
    if shared.count() <= MAX_BROADCAST:
        shared = F.broadcast(shared)
    revisit = (F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to")
    )


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Write a record for every row; returns (file, records, bytes).

    Null pages are empty payloads. A null id never is the largest; repeated rows
    with the largest id of their payload all are responses. An empty table has no files.
    """
    bounded_batches(pages.sparkSession)

    def write_files(batches):
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        row, number, task = next(rows, None), 0, TaskContext.get().partitionId()
        while row:
            name, n = f"part-{task:06d}-{number:04d}.warc", 0
            with committed(folder, name) as stream:
                size = stream.write(_info())
                while row and size < FILE_BYTES:
                    page, url, html, refers_to = row
                    size += stream.write(record(page, url, html.encode("utf-8", "surrogatepass"), refers_to))
                    n, row = n + 1, next(rows, None)
            number += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    made = records(pages, id_col, url_col, html_col)
    return written(made.mapInArrow(write_files, "file string, records long, bytes long"), "warc-manifest")


# ---- reading --------------------------------------------------------------

def long_header(source, at: int, length: int) -> bytes:
    """What is at an offset of a file of this length, up to the header's end if there is one."""
    size = 2 * HEADER_BYTES
    while True:
        data = source.read_at(min(size, length - at), at)
        if b"\r\n\r\n" in data or size >= length - at:
            return data
        size *= 2


def _length(value: bytes) -> int | None:
    value = value.strip()
    return int(value) if value.isdigit() and len(value) < 19 else None


def header_at(data: bytes, at: int, rest=None) -> tuple[dict[bytes, bytes], int] | None:
    """The header's fields and its end, if a record could begin there. ``rest(at)`` gives
    a header that doesn't end within ``HEADER_BYTES``; it may end behind the data."""
    first = _FIRST.match(data, at)
    if not first:
        return None
    end = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    head, found = data[at:end], end >= 0
    if not found and rest:
        head, found, _ = rest(at).partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(key.strip().lower(), value.strip())
    size = _length(fields.get(b"content-length", b""))
    return None if size is None else (fields, at + len(head) + 4)


def candidates(data: bytes, begin: int, end: int, base: int, rest=None) -> dict[int, int]:
    """Candidate starts in data[begin:end] and where the next record would be, as file
    offsets; ``base`` is the offset of data[0].

    Every line is read once, whatever candidates have it in their headers: what follows
    from a line on, the header's end and its first length, is kept.
    """
    known: dict[int, tuple[int, bytes | None] | None] = {}

    def behind(at: int) -> tuple[int, bytes | None] | None:
        """The same for the last line, which goes on behind the data."""
        text = rest(at) if rest else b""
        if text.startswith(b"\r\n"):
            return at + 2, None
        head, found, _ = text.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not found or not all(b":" in line for line in lines):
            return None
        named = [line.partition(b":")[2] for line in lines if _LENGTH.match(line)]
        return at + len(head) + 4, named[0] if named else None

    def follow(at: int) -> tuple[int, bytes | None] | None:
        """The header's end and length from a line on; None if it holds a line that is no field."""
        lines = []
        while at not in known:
            line_end = data.find(b"\r\n", at)
            if line_end < 0:
                known[at] = behind(at)
            elif line_end == at:
                known[at] = at + 2, None
            elif data.find(b":", at, line_end) < 0:
                known[at] = None
            else:
                lines.append((at, line_end))
                at = line_end + 2
        found = known[at]
        for at, line_end in reversed(lines):
            if found and (named := _LENGTH.match(data, at, line_end)):
                found = found[0], data[named.end():line_end]
            known[at] = found
        return found

    out = {}
    for first in _FIRST.finditer(data, begin):
        at = first.start()
        if at >= end:
            break
        found = follow(first.end())
        size = _length(found[1] or b"") if found else None
        if size is not None:
            out[base + at] = base + found[0] + size + 4
    return out


def exits(successors: dict[int, int], end: int) -> dict[int, int]:
    """For each candidate the first offset outside the range that its chain leads to;
    chains that lead to no candidate are left out."""
    out = {}
    for at in sorted(successors, reverse=True):
        following = successors[at]
        leads_to = following if following >= end else out.get(following)
        if leads_to is not None:
            out[at] = leads_to
    return out


def _ranges(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """(file, length, begin); names and lengths only, no contents are read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "length"
    )
    return listed.where("length > 0").select(
        "file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("begin")
    )


def _per_range(df: DataFrame, folder: str, function, schema: str) -> DataFrame:
    """Rows that ``function(open file, row)`` gives for every row (file, length, ...) of a stored table."""
    # a row stands for a range: as many tasks as Spark is set to, and more for many ranges
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGES_PER_TASK)
    target = pa.schema([
        pa.field(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in (x.split() for x in schema.split(", "))
    ])

    def run(batches):
        system, path = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{path}/{row['file']}") as source:
                    rows = list(function(source, row))
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    return df.repartition(tasks, *df.columns).mapInArrow(run, schema)


def reached_entries(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, length, at): the first record of each range that the chain from the file's
    start reaches."""
    ranges = written(_ranges(spark, folder, range_bytes), "warc-ranges")

    def jumps(source, row):
        begin, end = row["begin"], min(row["begin"] + range_bytes, row["length"])
        data = source.read_at(min(range_bytes + HEADER_BYTES, row["length"] - begin), begin)
        rest = lambda at: long_header(source, begin + at, row["length"])
        leads = exits(candidates(data, 0, end - begin, begin, rest), end)
        return [{"file": row["file"], "at": at, "to": to} for at, to in leads.items()]

    jump, jumps_at = stored(_per_range(ranges, folder, jumps, "file string, at long, to long"), "warc-jumps")
    files = ranges.where("begin = 0").select("file", "length")
    reached, reached_at = files.select("file", F.lit(0).cast("long").alias("at")), None
    longest = ranges.agg(F.max("begin")).first()[0] or 0
    # a chain has a jump for each range at most, and jumps double every round
    rounds = math.ceil(math.log2(longest // range_bytes + 1)) + 1
    for k in range(rounds):
        done = [p for p in (reached_at, jumps_at) if p]
        further = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached, reached_at = stored(reached.union(further).distinct(), "warc-reached")
        if k < rounds - 1:
            then = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
            then = jump.join(then, ["file", "to"]).select("file", "at", F.col("then").alias("to"))
            jump, jumps_at = stored(then, "warc-jumps")
        for path in done:  # a round's tables are read in the next one only
            remove(spark, path)
    joined = written(reached.join(files, "file"), "warc-entries")
    whole = joined.where("at = length").select("file").distinct()
    broken = files.join(whole, "file", "left_anti").limit(5).collect()
    if broken:
        raise ValueError(f"chains of records that don't end with their files: {[r.file for r in broken]}")
    return joined.where("at < length")


def _page(value: bytes | None) -> int | None:
    named = _RECORD_ID.fullmatch(value or b"")
    return None if not named or named[1] == b"none" else int(named[1])


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record.

    Length and digest are those of the full payload; those of responses are checked. Ids that
    a record's name doesn't have are null, records that repeat are rows of their own, other kinds of
    records are left out, and a folder without records gives no rows.
    """
    bounded_batches(spark)

    def walk(source, row):
        at, length = row["at"], row["length"]
        end = min((at // range_bytes + 1) * range_bytes, length)
        base, data = at, source.read_at(min(end - at + HEADER_BYTES, length - at), at)
        rest = lambda at: long_header(source, base + at, length)
        while at < end:
            head = header_at(data, at - base, rest)
            if head is None:
                raise ValueError(f"no record at {at} of {row['file']}")
            fields, begin = head
            size = int(fields[b"content-length"])
            block = data[begin:begin + size]
            if len(block) < size:  # a record that goes on behind what was read
                block = source.read_at(size, base + begin)
            at = base + begin + size + 4
            kind = fields.get(b"warc-type")
            if kind not in (b"response", b"revisit"):
                continue
            digest = base64.b32decode(fields[b"warc-payload-digest"].removeprefix(b"sha1:")).hex()
            payload_bytes = int(fields[b"x-payload-length"])
            if kind == b"response":
                payload = block[block.index(b"\r\n\r\n") + 4:]
                if len(payload) != payload_bytes or hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"a payload in {row['file']} is not what its header says")
            yield {
                "page_id": _page(fields.get(b"warc-record-id")), "payload_bytes": payload_bytes,
                "payload_digest": digest, "record_type": kind.decode(), "refers_to": _page(fields.get(b"warc-refers-to")),
            }

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return _per_range(reached_entries(spark, folder, range_bytes), folder, walk, schema)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession, "warc")
    if write(pages, folder, **columns).isEmpty():
        return spark.createDataFrame(
            [], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        )
    return read(spark, folder)
