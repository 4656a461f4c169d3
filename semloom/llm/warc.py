"""WARC archives with a two-level capture index.

Records are compressed one by one and written to archives in a folder that driver and executors share. The index sorts
captures by reversed-host URL key into compressed blocks of BLOCK lines; a sparse directory holds each block's first
key and place. A look-up finds the index file by its key range, the block by binary search in that file's directory,
the line by binary search in the block, and then reads the record's range of the archive.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import ascii_lower, materialise, scratch_path

BLOCK, LEAST_PAYLOAD, LARGEST_FILE, SALTS = 1000, 1000, 1 << 30, 16
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "entry string, file string, offset long, size long"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and the folder's path in it."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def surt(url) -> F.Column:
    """The sort-friendly key of a URL: reversed host, then path and query, without scheme and fragment."""
    rest = F.regexp_extract(url, r"://([^#]*)", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?]*(.*)", 1))
    return F.regexp_replace(F.coalesce(key, F.lit(")")), r"[\x00-\x20]", "+")


def _field(value: object) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in str(value))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_field(refers_url)}")
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The fields, the HTTP fields and the payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each of captures (page_id, url, payload, digest, refers_to, refers_url, revisit) and returns
    (entry, file, offset, size) of each. A task's files have names of their own: what a lost or repeated task has
    written is in no row."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                rows = []
                columns = (batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url", "revisit", "key"))
                for page_id, url, payload, digest, refers_to, refers_url, revisit, key in zip(*columns):
                    page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                    if out is None or at >= LARGEST_FILE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, (payload or "").encode("utf-8", "surrogatepass"), digest, refers_to, refers_url, revisit)) + packer.flush()
                    out.write(data)
                    rows.append((f"{key} {'' if page_id is None else page_id}", name, at, len(data)))
                    at += len(data)
                yield pd.DataFrame(rows, columns=["entry", "file", "offset", "size"])
        finally:
            if out is not None:
                out.close()

    keyed = captures.withColumn("key", surt(F.col("url")))
    return materialise(keyed.mapInPandas(write, _CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures (entry, file, offset, size) into index files of compressed blocks, each with a directory beside
    it, and returns (first, last, name) of each index file."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.repartitionByRange(n, "entry", "file", "offset").sortWithinPartitions("entry", "file", "offset")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        name, out, at, directory, lines, first = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], [], None

        def flush() -> int:
            data = gzip.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6, mtime=0)
            out.write(data)
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(data)}")
            return len(data)

        last = None
        for batch in batches:
            for line in map("\t".join, zip(batch["entry"], batch["file"], batch["offset"].astype(str), batch["size"].astype(str))):
                if out is None:
                    out, first = files.open_output_stream(f"{root}/{name}", compression=None), line.split("\t", 1)[0]
                lines.append(line)
                if len(lines) == BLOCK:
                    at += flush()
                    last, lines[:] = lines[-1].split("\t", 1)[0], []
        if out is not None:
            if lines:
                flush()
                last = lines[-1].split("\t", 1)[0]
            out.close()
            with files.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write("\n".join(directory).encode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"first": [first], "last": [last], "name": [name]})

    return materialise(dealt.mapInPandas(write, "first string, last string, name string"), "index")


class Index:
    """Look-ups in the index files of a folder, whose key ranges are given; keeps few directories, blocks and files."""

    def __init__(self, folder: str, ranges: list[tuple[bytes, bytes, str]]):
        self.files, self.root = opened(folder)
        self.ranges = sorted(ranges)
        self.last = [r[1] for r in self.ranges]
        self.kept: OrderedDict[tuple, object] = OrderedDict()

    def _once(self, key: tuple, make):
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        while len(self.kept) >= 64:
            self.kept.popitem(last=False)
        self.kept[key] = out = make()
        return out

    def _read(self, name: str, offset: int, size: int) -> bytes:
        return self._once((name,), lambda: self.files.open_input_file(f"{self.root}/{name}")).read_at(size, offset)

    def _directory(self, name: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        with self.files.open_input_stream(f"{self.root}/{name}.directory", compression=None) as f:
            lines = [x.rsplit(b"\t", 2) for x in f.read().split(b"\n")]
        return [x[0] for x in lines], [(int(x[1]), int(x[2])) for x in lines]

    def _block(self, name: str, offset: int, size: int) -> tuple[list[bytes], list[bytes]]:
        lines = gzip.decompress(self._read(name, offset, size)).split(b"\n")
        return [x.split(b"\t", 1)[0] for x in lines], lines

    def captures(self, entry: bytes) -> Iterator[tuple[str, int, int]]:
        """(file, offset, size) of every capture of an entry."""
        for first, last, name in self.ranges[bisect_left(self.last, entry) :]:
            if first > entry:
                return
            firsts, places = self._once((name, "d"), lambda name=name: self._directory(name))
            # the block before the first that starts with the entry may end with it
            for k in range(max(0, bisect_left(firsts, entry) - 1), bisect_right(firsts, entry)):
                keys, lines = self._once((name, k), lambda name=name, at=places[k]: self._block(name, *at))
                for line in lines[bisect_left(keys, entry) : bisect_right(keys, entry)]:
                    _, file, offset, size = line.rsplit(b"\t", 3)
                    yield file.decode(), int(offset), int(size)

    def record(self, file: str, offset: int, size: int) -> bytes:
        return gzip.decompress(self._read(file, offset, size))


def read_back(entries: DataFrame, ranges: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of entries (entry),
    found through the index. The ranges, a row for each index file, go to all tasks: there are no more of them than
    partitions wrote them. A response's digest is taken from its payload and must be the one in its header."""
    known = [(r["first"].encode("utf-8", "surrogatepass"), r["last"].encode("utf-8", "surrogatepass"), r["name"]) for r in ranges.collect()]
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # in the index's order, so that neighbours find their block at hand
    dealt = entries.distinct().repartitionByRange(n, "entry").sortWithinPartitions("entry")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, names = Index(folder, known), ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            rows, held = [], 0
            for entry in batch["entry"]:
                for place in index.captures(entry.encode("utf-8", "surrogatepass")):
                    fields, http, payload = parsed(index.record(*place))
                    revisit, digest = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"a record's payload is not that of its digest: {place}")
                    page_id = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                    refers = fields["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">") if revisit else ""
                    rows.append((page_id, fields.get("WARC-Target-URI"), int(http["Content-Length"]) if revisit else len(payload), digest, fields["WARC-Type"], refers, None if revisit else payload))
                    held += len(payload)
                    if held > 1 << 25:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    out = dealt.mapInPandas(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    number = lambda c: F.expr(f"try_cast(nullif({c}, '') AS bigint)").alias(c)
    return out.select(number("page_id"), "url", "payload_bytes", "payload_digest", "record_type", number("refers_to"), "payload")


def archive(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD) -> tuple[DataFrame, DataFrame]:
    """Writes pages (page_id, url, html) and their index to a folder; returns the captures and the index files' ranges.

    The payload is the html in UTF-8, nothing where it is null. Of records with equal payloads of at least so many
    bytes, those with the largest page_id are responses and the others revisit it; a null page_id is never the largest.
    Repeated rows are records of their own, a very long html is one record, and an empty table gives empty archives.
    Other columns are not read.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    whole = F.octet_length("payload") >= least
    large = base.filter(whole).select("digest", "page_id", "url")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_url"), F.count("*").alias("n"))
    groups = materialise(groups.filter("n > 1 AND refers_to IS NOT NULL").drop("n"), "groups")
    # copies of a payload go to SALTS tasks, each of which has their group; small payloads need none
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = base.filter(whole).withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted.hint("merge"), ["digest", "salt"], "left").drop("salt")
    alone = base.filter(~whole).withColumns({"refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")})
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    captures = write_archives(found.unionByName(alone).withColumn("revisit", revisit), folder)
    return captures, write_index(captures, folder)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    captures, ranges = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_back(captures.select("entry"), ranges, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
