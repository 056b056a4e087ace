"""WARC archives: written, read back, and indexed by an external merge of sorted capture runs.

Each record is a gzip member of its own, so that the index can point at it by archive, offset and length. Archives
are written by Spark's text writer, so that commits, retries and file systems are Spark's; the next one begins
after ARCHIVE_BYTES. They are read with binaryFile, record by record. Each archive yields a run of captures,
sorted locally by URL key and time and cut into small blocks. Blocks are dealt by range of the whole key and come
to a merge in the order of their first captures, so that it reads a block only when its turn has come: a k-way
loser-tree merge over the open blocks, at most one for each run, whatever the range holds. The concatenated
ranges are globally ordered capture histories.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import salted_join, scratch_path, stored

#: Payloads under so many bytes are stored each time.
LEAST_SHARED = 100
CRLF = "\r\n"
#: Time of page 0; later pages follow a second apart, since pages carry no time of their own.
EPOCH = 1_700_000_000
#: Bytes of an archive after which the next begins; bytes of a record's text in one gzip member (its length field then ends with the byte 0).
ARCHIVE_BYTES, MEMBER_BYTES = 16 << 20, 8 << 20
#: A capture: fields of the index, and what their order is, which no two captures share.
CAPTURE = "urlkey:string,ts:bigint,page:bigint,archive:string,offset:bigint,page_id:bigint,record_type:string,refers_to:bigint,payload_bytes:bigint,payload_digest:string,length:bigint"
FIELDS = [x.split(":")[0] for x in CAPTURE.split(",")]
ORDER = FIELDS[:5]
CAPTURE_TYPE = pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split(":") for x in CAPTURE.split(","))])
#: Captures and bytes of their keys in a block, about; blocks that a merge reads at a time, at least; blocks of a range, about.
BLOCK, BLOCK_BYTES, AHEAD, RANGE = 64, 16384, 64, 65536
#: Blocks by which ranges are cut, for each range.
SAMPLED = 16
#: Where a missing page_id stands in an order.
FIRST = -(1 << 63)
#: Rows of a batch that a merge hands on.
BATCH = 2000


def url_key(url: Column) -> Column:
    """Host labels reversed, then what follows the host, in lower case: `com,example,www)/a?b`. Null or no host: all of the url after `)`."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1))
    rest = F.lower(F.regexp_replace(url, r"^[^:/?#]*://[^/?#]*", ""))
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(")"))


def with_record_types(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """pages (page_id, url, html) with payload (never null), digest, record_type and refers_to."""
    payload = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    first = p.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    seen = salted_join(p, first, "digest", F.coalesce("page_id", F.lit(0)))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return seen.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def record_text() -> Column:
    """A record without its closing blank lines, from the columns of with_record_types()."""
    n = F.octet_length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    clean_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        head("WARC-Type", F.col("record_type")),
        head("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        head("WARC-Date", F.date_format(F.to_utc_timestamp(F.timestamp_seconds(EPOCH + F.coalesce("page_id", F.lit(0))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        head("WARC-Target-URI", clean_url),
        head("WARC-Target-Key", F.regexp_replace(url_key(F.col("url")), r"[\x00-\x20\x7f]", "%20")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), head("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        head("Content-Type", F.lit("application/http;msgtype=response")),
        head("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def gzip_record(record: bytes) -> bytes:
    """record as a gzip member; as several, one after the other, if it is longer than MEMBER_BYTES."""
    out = []
    for at in range(0, max(1, len(record)), MEMBER_BYTES):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [z.compress(record[at : at + MEMBER_BYTES]), z.flush()]
    return b"".join(out)


def write_warc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes pages as WARC files under path, which may be on any file system that Spark writes to; a gzip member for each record.

    A member ends with the high byte of its length, which is 0. The text writer puts it there as the line's end.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = size = 0
        for b in (x.slice(i, 100) for x in batches for i in range(0, len(x), 100)):
            number, data = [], []
            for record in b.column(0).cast(pa.binary()):
                member = gzip_record(record.as_py() + b"\r\n\r\n")
                archive, size = (archive + 1, 0) if size >= archive_bytes else (archive, size)
                size += len(member)
                number.append(archive)
                data.append(member[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(data, pa.binary())], ["archive", "value"])

    records = with_record_types(pages).select(record_text().alias("value")).mapInArrow(members, "archive int, value binary")
    records.select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\x00").text(path)
    return path


def unzipped(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, content) of each gzip member of data; data that isn't zipped is one."""
    if data[:2] != b"\x1f\x8b":
        if data:
            yield 0, len(data), data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        start, out, z = at, [], zlib.decompressobj(31)
        while not z.eof:
            if at >= len(data):
                raise ValueError(f"the member at byte {start} is cut off")
            out.append(z.decompress(view[at : at + 65536]))
            at = min(at + 65536, len(data))
        at -= len(z.unused_data)
        yield start, at, b"".join(out)


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields in lower case, block) of each record; lengths rule, so blocks may hold any bytes.

    In zipped archives offset and length are those of the record's members; one record is held at a time.
    """
    zipped = data[:2] == b"\x1f\x8b"
    held, start = b"", 0
    for a, z, content in unzipped(data):
        held, start = (held + content, start) if held else (content, a)
        at = 0
        while at < len(held):
            if not held.startswith(b"WARC/", at):
                raise ValueError(f"no record at byte {start}")
            end = held.find(b"\r\n\r\n", at)
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in held[at : end if end >= 0 else at].decode("utf-8").split(CRLF)[1:])}
            n = int(fields["content-length"]) if end >= 0 else 0
            if end < 0 or end + 8 + n > len(held):
                break  # goes on in the next member
            yield (start, z - start, fields, held[end + 4 : end + 4 + n]) if zipped else (at, end + 8 + n - at, fields, held[end + 4 : end + 4 + n])
            at = end + 8 + n
        held = held[at:]
    if held:
        raise ValueError(f"the record at byte {start} is cut off")


def read_record(data: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of the record that the index points at."""
    _, _, fields, block = next(parse_warc(data[offset : offset + length]))
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def _page(ref: str | None) -> int | None:
    x = (ref or "").removeprefix("<urn:page:").rstrip(">")
    return int(x) if x not in ("", "none") else None


def captures(data: bytes, archive: str) -> list[tuple]:
    """The captures of an archive, FIELDS each: a run in their order."""
    rows = []
    for offset, length, f, block in parse_warc(data):
        body = block[(cut := block.index(b"\r\n\r\n") + 4) :]
        n, digest = len(body), f["warc-payload-digest"].removeprefix("sha256:")
        if f["warc-type"] == "revisit":  # the payload's length is in the stored HTTP header, its digest was compared when it was written
            n = int(block[:cut].decode("latin-1").lower().partition("content-length:")[2].split("\r\n")[0])
        else:
            digest = hashlib.sha256(body).hexdigest()
        page = _page(f["warc-record-id"])
        rows.append((f["warc-target-key"], EPOCH + (page or 0), FIRST if page is None else page, archive, offset, page, f["warc-type"], _page(f.get("warc-refers-to")), n, digest, length))
    rows.sort(key=lambda r: r[:5])
    return rows


def _blocks(rows: list[tuple]) -> Iterator[list[tuple]]:
    """rows in pieces of BLOCK captures and BLOCK_BYTES of keys, about."""
    at = size = 0
    for k, r in enumerate(rows):
        size += len(r[0])
        if k + 1 - at == BLOCK or size >= BLOCK_BYTES or k + 1 == len(rows):
            yield rows[at : k + 1]
            at, size = k + 1, 0


BLOCKS = f"urlkey string, ts long, page long, archive string, offset long, captures array<struct<{CAPTURE}>>"
BLOCK_NAMES = [*ORDER, "captures"]


def _block_batch(blocks: list[list[tuple]], more: dict[str, list] | None = None) -> pa.RecordBatch:
    firsts = [pa.array([b[0][i] for b in blocks], CAPTURE_TYPE[i].type) for i in range(len(ORDER))]
    flat = [r for b in blocks for r in b]
    values = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], f.type) for i, f in enumerate(CAPTURE_TYPE)], fields=list(CAPTURE_TYPE))
    lists = pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, blocks))], pa.int32()), values)
    extra = more or {}
    return pa.RecordBatch.from_arrays([*[pa.array(v, pa.int32()) for v in extra.values()], *firsts, lists], [*extra, *BLOCK_NAMES])


def read_warc(files: DataFrame) -> DataFrame:
    """BLOCKS of the archives in files (binaryFile rows): each archive's captures as a sorted run, in blocks."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                if blocks := list(_blocks(captures(content.as_py(), path.as_py()))):
                    yield _block_batch(blocks)

    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "content").mapInArrow(parse, BLOCKS)


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match, so that the next winner costs log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._settle(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return a is not None and (b is None or (a, i) < (b, j))

    def _settle(self, i: int) -> None:
        """Run i plays its way up; a node without a loser yet keeps the player for the one to come."""
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                i, self.tree[node] = self.tree[node], i
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._settle(w)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple]]]:
    """(range, captures) of each row, a few at a time as Python objects."""
    for lo in range(0, len(batch), AHEAD):
        b = batch.slice(lo, AHEAD)
        lists = b.column(batch.schema.get_field_index("captures"))
        flat = list(zip(*[c.to_pylist() for c in lists.flatten().flatten()]))
        at = 0
        numbers = b.column(0).to_pylist() if batch.schema.names[0] == "range" else [0] * len(b)
        for number, n in zip(numbers, lists.value_lengths().to_pylist()):
            yield number, flat[at : at + n]
            at += n


def merged(blocks: Iterator[list[tuple]]) -> Iterator[tuple]:
    """The captures of blocks, which come by their first capture, in order.

    What comes before the next block's first capture can't be overtaken; it leaves through a loser tree over the
    open blocks. After that at most one block of each run is open.
    """
    held: dict[str, list[tuple]] = {}
    ahead = next(blocks, None)
    while ahead is not None:
        for _ in range(max(AHEAD, len(held))):
            if ahead is None:
                break
            held.setdefault(ahead[0][3], []).extend(ahead)
            ahead = next(blocks, None)
        cut = {run: len(rows) if ahead is None else bisect.bisect_left(rows, ahead[0][:5], key=lambda r: r[:5]) for run, rows in held.items()}
        yield from LoserTree([iter(held[run][:n]) for run, n in sorted(cut.items()) if n])
        held = {run: rows[cut[run] :] for run, rows in held.items() if cut[run] < len(rows)}


def merge_runs(runs: DataFrame, least: int = 2) -> DataFrame:
    """The captures of runs (BLOCKS) in global order of ORDER: range by range, and within each by a streaming loser-tree merge.

    Ranges are cut on the whole key, so that a URL with a third of all captures spreads over many ranges; their number
    grows with that of the blocks. Boundaries come from a bounded number of blocks; blocks that lie across one are cut.
    """
    n = max(least, -(-runs.count() // RANGE))
    # one capture of each block, at any place: the first ones of short runs all lie low
    one = F.get("captures", F.pmod(F.xxhash64(*ORDER), F.size("captures")).cast("int"))
    sample = runs.select(one.alias("c")).select(*[f"c.{x}" for x in ORDER]).orderBy(F.xxhash64(*ORDER), *ORDER).limit(SAMPLED * n).collect()  # SAMPLED for each range
    keys = sorted(tuple(r) for r in sample)
    bounds = [keys[len(keys) * k // n] for k in range(1, n)] if keys else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, blocks = [], []
            for _, rows in _rows(b):
                while rows:
                    k = bisect.bisect_right(bounds, rows[0][:5])
                    to = bisect.bisect_left(rows, bounds[k], key=lambda r: r[:5]) if k < len(bounds) else len(rows)
                    number.append(k)
                    blocks.append(rows[:to])
                    rows = rows[to:]
            if blocks:
                yield _block_batch(blocks, {"range": number})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for b in batches for row in _rows(b))
        for _, group in itertools.groupby(found, key=lambda r: r[0]):
            rows = merged(captures for _, captures in group)
            while part := list(itertools.islice(rows, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), CAPTURE_TYPE)], FIELDS)

    dealt = runs.mapInArrow(cut, f"range int, {BLOCKS}").repartitionById(n, F.col("range")).sortWithinPartitions("range", *ORDER)
    return dealt.mapInArrow(merge, CAPTURE.replace(":", " "))


def capture_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages to WARC archives, reads them back, and returns one row for each page in global capture order: FIELDS without page.

    archive, offset and length say where the record stands under path. Null html is an empty payload.
    Of equal payloads of at least 100 bytes the smallest page_id is the response (every row of it, if that row
    is repeated), the others revisit it; without any page_id all are responses. A null url has the key `)`.
    """
    spark = pages.sparkSession
    path = write_warc(pages, path or scratch_path(spark, "warc"))
    files = spark.read.format("binaryFile").load(path)
    runs = stored(read_warc(files), "warc-runs")  # read three times: counted, sampled, merged
    return merge_runs(runs, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))).drop("page")


def capture_history(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, ts of each page, in the order of capture_index()."""
    return capture_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts")


ORACLE_SQL = """
with p as (select page_id, url, coalesce(html, '') as html, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where octet_length(encode(html)) >= 100 group by d),
k as (select p.*, f.first, lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)) as host,
             lower(regexp_replace(url, '^[^:/?#]*://[^/?#]*', '')) as rest from p left join f using (d))
select page_id,
       octet_length(encode(html)) as payload_bytes, d as payload_digest,
       case when first is not null and page_id <> first then 'revisit' else 'response' end as record_type,
       case when first is not null and page_id <> first then first end as refers_to,
       coalesce(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest, ')') as urlkey,
       1700000000 + page_id as ts
from k"""
