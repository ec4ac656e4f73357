"""WARC archives, and reading them back by boundary-chain verification.

Writing: one record per page, as uncompressed WARC 1.1, by Spark's text writer: a
row is a record and the writer's line separator is the blank line that ends one.
Files hold about ``FILE_BYTES``.

Reading: Spark's text reader splits the files, of any size, and cuts them at the
magic string; so a row is a piece from one magic to the next, and places in a file
are sums of the lengths before. A magic string does not prove a record, since
payloads may hold it: a piece with a header block and a length is a candidate, and
names the place of its successor. A task follows the chains inside its split, so a
candidate carries the place where its chain leaves the split. Pointer jumping over
these places, from the start of each file, leaves the one place where the true
chain enters each split. A last pass walks that chain: pieces that are whole records
are read where they are, and only the pieces of records that hold the magic in their
payload are put together by record.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusguard.llm.store import BROADCAST_KEYS, stored

FILE_BYTES = 16 << 20
#: Splits whose entries (some 100 bytes each) are sent to every executor.
BROADCAST_SPLITS = 100_000
#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
BLANK = b"\r\n\r\n"
#: Our own header line.
ESCAPED = "X-Target-URI-Percent-Encoded"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of a SHA-1: 160 bits are 8 groups of 5 hex or 4 base-32 digits."""
    digest = F.sha1(value)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _lines(*pairs: tuple[str, Column | str | None]) -> Column:
    """Header lines; a null value leaves its line out."""
    made = [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v, F.lit("\r\n")) for name, v in pairs if v is not None]
    return F.concat_ws("", *made)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> int:
    """Writes ``pages(page_id, url, html, ...)`` and returns how many records.

    The payload is the html in UTF-8; null is empty. Of the pages with equal
    payloads (of at least ``least_bytes``) those of the smallest page_id are
    ``response`` and the others ``revisit`` it, with the headers of the response
    but no payload. A page with a null page_id is never revisited.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html").cast("binary"))})
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not count:
        return 0
    equal = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times"))
    equal = stored(equal.where("times > 1 and first is not null").select("digest", "first"), "equal")
    equal = F.broadcast(equal) if equal.count() <= BROADCAST_KEYS else equal
    rows = rows.join(equal, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def name(page: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(">"))

    # A URL that a header line cannot hold as it is goes percent-encoded, and a line says so.
    odd = F.col("url").rlike(r"[\r\n]|^[ \t\x0B\f]|[ \t\x0B\f]$") | F.endswith("url", F.lit(MAGIC.decode().strip()))
    escaped = F.col("url")
    for c in "%\r\n \t\x0b\x0c/":
        escaped = F.replace(escaped, F.lit(c), F.lit(f"%{ord(c):02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("n").cast("string"))), F.lit("\r\n"))
    length = F.octet_length("http") + F.when(again, 0).otherwise(F.col("n"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        _lines(
            ("WARC-Type", F.when(again, "revisit").otherwise("response")),
            ("WARC-Record-ID", name("page_id")),
            ("WARC-Refers-To", F.when(again, name("first"))),
            ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Target-URI", F.when(odd, escaped).otherwise(F.col("url"))),
            (ESCAPED, F.when(odd, "yes")),
            ("WARC-Date", date),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", length.cast("string")),
        ),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.col("http"), F.when(again, "").otherwise(F.col("html")))
    per_file = max(1, FILE_BYTES * count // (size + 600 * count))
    rows.withColumn("http", http).select(record.alias("value")).write.option("lineSep", BLANK.decode()).option("maxRecordsPerFile", per_file).text(path)
    return count


def _header(block: bytes) -> dict[bytes, bytes]:
    fields = (line.partition(b":") for line in block.split(b"\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(path, split, value)``: what lies between magic strings, in order within a split."""
    pieces = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "part-*").text(path)
    return pieces.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")


def _places(rows: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
    """The place of each row's magic within its split's bytes, and the row: ``(path,
    split, bytes, ...)``. The first piece of a file has no magic before it: -1."""
    key, at = None, 0
    for row in rows:
        first = row[:2] != key
        if first:
            key, at = row[:2], 0
        bare = first and row[1] == 0
        yield -1 if bare else at, row
        at += row[2] + (0 if bare else len(MAGIC))


def _candidates(pieces: DataFrame) -> DataFrame:
    """``(path, split, place, leaves, last)``, places within the split: for each
    candidate where its chain leaves the split and the last record in it; and for
    each split a row without a place whose ``leaves`` is its length."""
    head = F.substring_index("value", BLANK.decode(), 1)
    size = F.octet_length("value")
    stated = F.regexp_extract(F.concat(F.lit("\r\n"), head), r"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n|$)", 1)
    record = F.when((F.octet_length(head) < size) & (stated != ""), len(MAGIC) + F.octet_length(head) + 2 * len(BLANK) + stated.cast("long"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chains(key: tuple, length: int, sizes: dict[int, int]) -> pa.RecordBatch:
            found: dict[int, tuple[int, int]] = {}
            for at in sorted(sizes, reverse=True):
                after = at + sizes[at]
                if after in found:
                    found[at] = found[after]
                elif after >= length:
                    found[at] = after, at
            out = [(None, length, None), *((at, *x) for at, x in found.items())]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(out), pa.string()), pa.array([key[1]] * len(out), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))],
                ["path", "split", "place", "leaves", "last"],
            )

        key, length, sizes = None, 0, {}
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for at, row in _places(rows):
            if row[:2] != key:
                if key is not None:
                    yield chains(key, length, sizes)
                key, sizes = row[:2], {}
            if at >= 0 and row[3] is not None:
                sizes[at] = row[3]
            length = max(at, 0) + row[2] + (len(MAGIC) if at >= 0 else 0)
        if key is not None:
            yield chains(key, length, sizes)

    cut = pieces.select("path", "split", size.cast("long").alias("bytes"), record.alias("record"))
    return cut.mapInArrow(follow, "path string, split long, place long, leaves long, last long")


def record_chains(pieces: DataFrame) -> DataFrame:
    """``(path, split, base, entry, owner)`` for each split: the place where it
    begins, the first place in it that the chain from the file's start reaches (null
    if none), and the record before that, whose end the split begins with. Raises
    if a file's chain does not end where the file does."""
    found = stored(_candidates(pieces), "candidates")
    in_order = Window.partitionBy("path").orderBy("split")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    splits = found.where("place is null").select("path", "split", F.col("leaves").alias("length"))
    splits = stored(splits.withColumn("base", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))), "splits")
    # A row per record compresses to little on disk, so sizes of files would have
    # Spark broadcast them; the hint keeps these joins shuffled.
    base = F.col("base")
    jumps = found.where("place is not null").join(splits, ["path", "split"])
    jumps = stored(jumps.select("path", "split", *[(F.col(c) + base).alias(c) for c in ("place", "leaves", "last")]), "jumps").hint("merge")
    first, reached = jumps, stored(splits.select("path", F.lit(0).cast("long").alias("place")).distinct(), "reached")
    jumps, n = first.select("path", "place", "leaves"), reached.count()
    while True:
        ahead = reached.join(jumps, ["path", "place"]).select("path", F.col("leaves").alias("place"))
        grown = stored(reached.union(ahead).distinct(), "reached")
        if (size := grown.count()) == n:
            break
        reached, n = grown, size
        onward = jumps.select("path", F.col("place").alias("_next"), F.col("leaves").alias("_leaves"))
        jumps = stored(jumps.withColumnRenamed("leaves", "_next").join(onward, ["path", "_next"]).select("path", "place", F.col("_leaves").alias("leaves")), "jumps").hint("merge")
    chain = stored(first.join(reached, ["path", "place"], "left_semi"), "chain")
    ends = splits.groupBy("path").agg(F.sum("length").alias("length")).join(chain.groupBy("path").agg(F.max("leaves").alias("end")), "path", "left")
    broken = ends.where(F.coalesce("end", F.lit(-1)) != F.col("length")).select("path").limit(1).collect()
    if broken:
        raise ValueError(f"the records of {broken[0].path} do not reach its end")
    entries = splits.join(chain.groupBy("path", "split").agg(F.min("place").alias("entry"), F.max("last").alias("last")), ["path", "split"], "left")
    return stored(entries.select("path", "split", "base", "entry", F.last("last", ignorenulls=True).over(before).alias("owner")), "entries")


_FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _record(data: bytes, payload: bool) -> tuple:
    """The fields of a record, given without its magic."""

    def number(field: bytes | None) -> int | None:
        value = (field or b"").removeprefix(b"<urn:page:").removesuffix(b">")
        return int(value) if value.lstrip(b"-").isdigit() else None

    end = data.index(BLANK)
    head = _header(b"\r\n" + data[:end])
    begin, stop = end + 4, end + 4 + int(head[b"content-length"])
    http_end = data.index(BLANK, begin)
    body = data[http_end + 4 : stop]
    digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    kind = head[b"warc-type"].decode()
    if kind == "response" and b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError(f"payload of record {head[b'warc-record-id']!r} has another digest than stated")
    size = len(body) if kind == "response" else int(_header(b"\r\n" + data[begin:http_end])[b"content-length"])
    url = head.get(b"warc-target-uri")
    if url is not None and ESCAPED.lower().encode() in head:
        url = unquote_to_bytes(url)
    return number(head[b"warc-record-id"]), url.decode() if url is not None else None, size, digest, kind, number(head.get(b"warc-refers-to")), body.decode() if payload and kind == "response" else None


def _batches(rows: Iterator[tuple], schema: pa.Schema, each: int = 1000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(held) >= each or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of all archives in a folder → ``(page_id, url, payload_bytes,
    payload_digest, record_type, refers_to)``, and ``payload`` of responses if
    asked for (null for revisits).

    Length and digest are those of the full payload: computed for a response,
    stated by the record for a revisit. A response whose payload has another
    digest than it states, or a file whose chain of records does not reach its
    end, is an error. URLs and headers may be of any length.
    """
    pieces = _pieces(spark, path)
    entries = record_chains(pieces)
    fields = to_arrow_schema(StructType.fromDDL(_FIELDS))
    whole = fields.append(pa.field("path", pa.string())).append(pa.field("start", pa.int64())).append(pa.field("place", pa.int64())).append(pa.field("piece", pa.binary()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records that are one piece, and the pieces of others with their record's place."""

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield row[0], row[1], len(row[2]), *row[2:]

        def found() -> Iterator[tuple]:
            key, following, start = None, None, None
            for at, (path, split, length, value, base, entry, owner) in _places(rows()):
                if (path, split) != key:
                    key, following, start = (path, split), entry, owner
                if at < 0:
                    continue
                if at + base == following:
                    start = following
                    end = value.index(BLANK)
                    following = start + len(MAGIC) + end + 2 * len(BLANK) + int(_header(b"\r\n" + value[:end])[b"content-length"])
                    if following == start + len(MAGIC) + length:
                        yield *_record(value, payload), None, None, None, None
                        continue
                yield *[None] * len(fields), path, start, at + base, value

        yield from _batches(found(), whole)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_record(MAGIC.join(x["piece"] for x in row), payload) for batch in batches for row in batch.column(0).to_pylist()), fields)

    guided = pieces.select("path", "split", F.col("value").cast("binary").alias("value"))
    if entries.count() <= BROADCAST_SPLITS:
        guided = guided.join(F.broadcast(entries), ["path", "split"])  # keeps the order of the pieces
    else:
        guided = guided.withColumn("_order", F.monotonically_increasing_id()).join(entries, ["path", "split"])
        guided = guided.repartition("path", "split").sortWithinPartitions("path", "split", "_order").drop("_order")
    kinds = _FIELDS + ", path string, start long, place long, piece binary"
    walked = stored(guided.select("path", "split", "value", "base", "entry", "owner").mapInArrow(walk, kinds), "walked")
    parted = walked.where("path is not null").groupBy("path", "start").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
    out = walked.where("path is null").select(*fields.names).unionAll(parted.select("pieces").mapInArrow(joined, _FIELDS))
    return out if payload else out.drop("payload")


def round_trip(pages: DataFrame, path: str, payload: bool = False) -> DataFrame:
    """Writes the pages as archives in ``path`` and reads them back. No pages: no rows."""
    if write_warc(pages, path):
        return read_warc(pages.sparkSession, path, payload)
    none = pages.sparkSession.createDataFrame([], _FIELDS)
    return none if payload else none.drop("payload")
