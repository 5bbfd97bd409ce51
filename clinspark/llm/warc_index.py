"""WARC archives with revisit records, and their index merged from sorted runs by loser trees."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.llm.common import join_back, new_folder, staged
from clinspark.llm.exact_dedup import bits_for, class_marks, with_mark

ARCHIVE_BYTES = 256 << 20  # a writer starts a new archive beyond this many compressed bytes
FAN_IN = 64  # runs that one merge reads at once
RANGE_ROWS = 1_000_000  # captures that one merge writes, about
SAMPLE_PER_RANGE = 32
BATCH_ROWS = 2_048
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "key string, page_id long, url string, url_key string, captured string, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def url_key(url: str) -> str:
    """The canonical form captures are ordered by: host labels from the top-level domain down, a port
    that is not the scheme's own, then path and query in lower case."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    labels = ",".join(reversed(host.split(".")))
    usual = {"http": 80, "https": 443}.get(parts.scheme)
    shown = f":{port}" if port and port != usual else ""
    query = f"?{parts.query.lower()}" if parts.query else ""
    return f"{labels}{shown}){parts.path.lower() or '/'}{query}"


def sort_key(url: str, captured: str, page: int) -> str:
    """One string that sorts like (url key, time, page)."""
    return f"{url}\x01{captured}\x01{page + 2**63:020d}"


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def header_url(url: str) -> str:
    """A URL that fits into one header line."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda char: quote(char.group()), url)


def record(page: int | None, url: str, stamp: str, payload: bytes, digest: str, original: tuple | None) -> bytes:
    """One WARC/1.1 record; ``original`` is (page, url, time) of the response that a revisit repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if original else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {header_url(url)}",
        f"WARC-Date: {stamp}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if original:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: <urn:page:{original[0]}>",
            f"WARC-Refers-To-Date: {original[1]}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(``archive``, ``records``, ``bytes``) of the archives that hold ``rows``, one gzip member per
    record. A task writes under names of its own, and only archives of tasks that came to their end
    are listed: what a lost executor left behind is never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _file(folder)
        system.create_dir(place, recursive=True)
        stream, name, count, size = None, "", 0, 0

        def listed() -> pa.RecordBatch:
            stream.close()
            columns = [pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["archive", "records", "bytes"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = {field: batch.column(field)[at].as_py() for field in batch.schema.names}
                if stream is None:
                    name, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = system.open_output_stream(f"{place}/{name.rsplit('/', 1)[1]}")
                original = (row["first_page"], row["first_time"]) if row["revisit"] else None
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                whole = record(row["page"], row["url"], row["captured"], row["payload"], digest, original)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(whole) + packer.flush()
                stream.write(member)
                count, size = count + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield listed()
                    stream = None
        if stream is not None:
            yield listed()

    return rows.mapInArrow(run, "archive string, records long, bytes long")


def members(stream: pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, record) of each gzip member, read in pieces of bounded size."""
    offset, used, parts, data = 0, 0, [], b""
    unpacker = zlib.decompressobj(31)
    while True:
        data = data or stream.read(READ_BYTES)
        if not data:
            if used:
                raise ValueError("archive ends inside a record")
            return
        parts.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        used += len(data) - len(rest)
        data = rest
        if unpacker.eof:
            yield offset, used, b"".join(parts)
            offset, used, parts = offset + used, 0, []
            unpacker = zlib.decompressobj(31)


def parsed(whole: bytes) -> dict:
    """The capture that a record tells of; a response's payload is held against its digest."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    size = int(sizes[0].split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def page(name: str) -> int | None:
        number = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    key = url_key(fields["WARC-Target-URI"])
    return {
        "key": sort_key(key, fields["WARC-Date"], page("WARC-Record-ID") or 0),
        "page_id": page("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "url_key": key,
        "captured": fields["WARC-Date"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
    }


def read_archives(archives: DataFrame) -> DataFrame:
    """One index row per record of the archives, in the order of the archives."""
    schema = pa.schema(
        [(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (x.split() for x in INDEX.split(", "))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                system, place = _file(archive)
                rows = []
                with system.open_input_stream(place) as stream:
                    for offset, length, whole in members(stream):
                        rows.append(parsed(whole) | {"archive": archive, "offset": offset, "length": length})
                        if len(rows) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("archive").mapInArrow(run, INDEX)


class LoserTree:
    """Tournament over sorted cursors: each inner node keeps the loser of its match, so the next
    winner needs one match per level on the way from the last winner's leaf to the root."""

    def __init__(self, heads: list):
        self.heads = heads  # next key of each cursor, None at its end
        self.losers = [-1] * len(heads)
        self.winner = -1
        for leaf in range(len(heads)):
            self._enter(leaf)

    def _before(self, one: int, two: int) -> bool:
        a, b = self.heads[one], self.heads[two]
        if a is None or b is None:
            return a is not None or (b is None and one < two)
        return a < b or (a == b and one < two)

    def _enter(self, leaf: int) -> None:
        winner, node = leaf, (leaf + len(self.heads)) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:  # first to come here while the tree is built: waits for the other side
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.winner = winner

    def advance(self, key) -> None:
        """The winner's cursor moves on to ``key``."""
        self.heads[self.winner] = key
        self._enter(self.winner)


def run_batches(path: str, low: str | None, high: str | None) -> Iterator[pa.RecordBatch]:
    """Rows with ``low <= key < high`` of a sorted run; row groups outside are not read."""
    system, place = _file(path)
    with system.open_input_file(place) as source:
        run = pq.ParquetFile(source)
        at = run.schema_arrow.get_field_index("key")
        for group in range(run.num_row_groups):
            known = run.metadata.row_group(group).column(at).statistics
            if known is not None and known.has_min_max:
                if (high is not None and known.min >= high) or (low is not None and known.max < low):
                    continue
            for batch in run.iter_batches(batch_size=BATCH_ROWS, row_groups=[group]):
                keys = batch.column(at).to_pylist()
                first = 0 if low is None else bisect_left(keys, low)
                last = len(keys) if high is None else bisect_left(keys, high)
                if first < last:
                    yield batch.slice(first, last - first)


def merged(runs: list[str], low: str | None, high: str | None) -> Iterator[pa.RecordBatch]:
    """The runs' rows of one key range in order; one batch per run is in memory."""
    cursors = [run_batches(path, low, high) for path in runs]
    batches = [next(cursor, None) for cursor in cursors]
    keys = [None if batch is None else batch.column("key").to_pylist() for batch in batches]
    spots = [0] * len(runs)
    tree = LoserTree([None if key is None else key[0] for key in keys])
    held = [batch for batch in batches if batch is not None]
    bases, size = [0] * len(runs), 0
    for number, batch in enumerate(batches):
        bases[number], size = size, size + (batch.num_rows if batch is not None else 0)
    taken: list[int] = []
    while True:
        best = tree.winner
        done = best == -1 or tree.heads[best] is None
        if taken and (done or len(taken) >= BATCH_ROWS):
            yield from pa.Table.from_batches(held).take(pa.array(taken)).combine_chunks().to_batches()
            live = [number for number, batch in enumerate(batches) if batch is not None]
            held, taken, size = [batches[number] for number in live], [], 0
            for number in live:
                bases[number], size = size, size + batches[number].num_rows
        if done:
            return
        taken.append(bases[best] + spots[best])
        spots[best] += 1
        if spots[best] == len(keys[best]):
            batches[best] = next(cursors[best], None)
            spots[best] = 0
            if batches[best] is None:
                tree.advance(None)
                continue
            keys[best] = batches[best].column("key").to_pylist()
            held.append(batches[best])
            bases[best], size = size, size + batches[best].num_rows
        tree.advance(keys[best][spots[best]])


def _job_of(path: str) -> int:
    """The number of the task that wrote a file, which its name starts with."""
    return int(path.rsplit("/", 1)[1].split("-")[1])


def merge_index(captures: DataFrame) -> DataFrame:
    """All captures in the order of ``key``: (``part``, index columns), parts in key order.

    1. Captures are sorted inside their partitions and stored: every file is a sorted run.
    2. Key ranges of about ``RANGE_ROWS`` rows are fixed from a hash sample of ``SAMPLE_PER_RANGE``
       keys per range. A key holds time and page, so a URL captured very often is cut like any other.
    3. A task merges one range of up to ``FAN_IN`` runs with a loser tree, holding one batch per run.
       While there are more runs than that, passes over groups of runs make longer runs.
    """
    spark = captures.sparkSession
    folder = new_folder(spark, "index-runs")
    ordered = captures.sortWithinPartitions("key")
    ordered.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(f"{folder}/0")
    stored = spark.read.schema(captures.schema).parquet(f"{folder}/0")
    rows = stored.count()
    cores = spark.sparkContext.defaultParallelism
    ranges = max(1, -(-rows // RANGE_ROWS), min(2 * cores, rows // 2_000))
    thin = max(1, rows // (ranges * SAMPLE_PER_RANGE))
    sample = stored.filter(F.pmod(F.xxhash64("key"), F.lit(thin)) == 0).select("key").collect()
    keys = sorted({row[0] for row in sample})
    cuts = sorted({keys[len(keys) * number // ranges] for number in range(1, ranges)}) if keys else []
    bounds = [None, *cuts, None]
    kind = "part int, " + INDEX

    def pass_over(runs: list[list[str]]) -> tuple[DataFrame, list]:
        """``runs[part]`` are the groups' files of a range; one task per (range, group)."""
        jobs = [(part, group[at : at + FAN_IN]) for part, group in enumerate(runs) for at in range(0, max(len(group), 1), FAN_IN)]
        shared = spark.sparkContext.broadcast((jobs, bounds))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            todo, limits = shared.value
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    part, paths = todo[number]
                    for piece in merged(paths, limits[part], limits[part + 1]):
                        names = [name for name in piece.schema.names if name != "part"]
                        marks = pa.array([part] * piece.num_rows, pa.int32())
                        yield pa.RecordBatch.from_arrays([marks, *[piece.column(n) for n in names]], ["part", *names])

        return spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, kind), jobs

    runs = [sorted(stored.inputFiles())] * (len(bounds) - 1) if rows else [[]]
    step = 0
    while True:
        out, jobs = pass_over(runs)
        if max(map(len, runs)) <= FAN_IN:
            return out
        step += 1
        out.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(f"{folder}/{step}")
        longer: list[list[str]] = [[] for _ in runs]
        for path in sorted(spark.read.schema(kind).parquet(f"{folder}/{step}").inputFiles()):
            longer[jobs[_job_of(path)][0]].append(path)
        runs = longer


def capture_histories(
    pages: DataFrame,
    captured: Column,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    folder: str | None = None,
) -> DataFrame:
    """Write one WARC record per page, read the archives back and merge their index.

    Returns (``part``, ``key``, ``page_id``, ``url``, ``url_key``, ``captured``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``, ``archive``, ``offset``, ``length``), parts
    and rows in the order of (URL key, time, page). Of the pages with equal payloads of at least
    ``least_bytes`` bytes the one with the largest id is a response, the others are revisit records
    without a payload; smaller payloads are all responses. ``captured`` is a timestamp. Archives go to
    ``folder``, by default a folder of the session that goes when the application ends; the folder
    must be one that pyarrow can reach (file, s3, gs, hdfs).

    Payloads that occur once are found by bit masks of bounded size and never shuffled.

    Nulls and edges: a null payload is empty, a null URL is the empty URL, spaces and control
    characters of a URL are percent-encoded; a null id sorts below every id and comes back null; rows
    that repeat the largest id with the same payload are all responses; an empty table gives an empty
    index. Other columns are not read.
    """
    spark = pages.sparkSession
    place = folder or new_folder(spark, "warc")
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    url = F.coalesce(F.col(url_col), F.lit(""))
    stamp = F.coalesce(F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z"))
    base = pages.select(
        F.col(id_col).cast("long").alias("page"), url.alias("url"), stamp.alias("captured"), payload.alias("payload"), F.sha1(payload).alias("digest")
    )
    enough = F.length("payload") >= least_bytes
    groups = staged(
        base.filter(enough)
        .groupBy("digest")
        .agg(F.max(F.struct("page", "captured")).alias("first"), F.count("*").alias("_rows"))
        .filter("_rows > 1")
        .select("digest", F.col("first.page").alias("first_page"), F.col("first.captured").alias("first_time"), "_rows"),
        "warc-groups",
    )
    bits, number = bits_for(groups), F.xxhash64("digest")
    marks = staged(class_marks(groups, number, bits), "warc-marks")
    flagged = with_mark(base, marks, number, bits, "_go")
    again = F.col("_rows").isNotNull() & enough & ~F.col("page").eqNullSafe(F.col("first_page"))
    repeated = join_back(flagged.filter("_go").drop("_go"), groups, "digest", "_rows", "page", "left").withColumn("revisit", again).drop("_rows")
    single = flagged.filter("not _go").select(
        "page", "url", "captured", "payload", "digest", F.lit(None).cast("long").alias("first_page"), F.lit(None).cast("string").alias("first_time"), F.lit(False).alias("revisit")
    )
    archives = staged(write_archives(single.unionByName(repeated), place), "warc-archives")
    total = archives.agg(F.count("*"), F.sum("bytes")).first()
    tasks = min(total[0], max(2 * spark.sparkContext.defaultParallelism, (total[1] or 0) // (1 << 30)))
    return merge_index(read_archives(archives.repartition(max(1, tasks))))
