"""A deterministic sharded WARC writer, and its reader.

Records are range-sorted by page id, payload digest and url. Sizes are summed along that order (each task over its range, the
ranges' totals after that), and the order is cut every ``shard_bytes`` of payload, so the same table always gives the same
shards, however it is partitioned. One task sorts and writes a shard: each record is a gzip member of its own, a file is
rolled once it holds ``file_bytes`` compressed. A file is written under a temporary name of its attempt and renamed when it is
complete; the rows that the tasks return are the manifest, written last. Readers follow the manifest only, so files of lost or
repeated attempts are never seen, and a repeated attempt puts the same bytes in the same place.

Of records with equal payloads of at least ``revisit_bytes``, those with the smallest page id are responses and the others
revisits of it. Headers and digests are made anew from the rows.

Bounds: the first key of each shard (49 bytes) goes to the driver and to the tasks; beyond ``max_shards`` shards these grow
instead. Payloads are shuffled once. Rows repeated in page id, payload and url travel as one row with their number, which is
written that often and may stretch over several shards.

Defined results: a null payload is empty; a null url has no target header; a null page id comes last in the order and is a
response only if no other page has its payload; rows repeated in page id and payload have the same type; control characters
of a url are percent-coded; an empty table gives an archive without files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crategraph.shared import join_measured, scratch, settle

MANIFEST = "path string, shard long, part long, records long, bytes long, digest string"
_MANIFEST = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("shard", "part", "records", "bytes")), ("digest", pa.string())])
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
HEADERS = 300


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """key, page_id, url, payload. The key is binary: whether the id is null, the id with its sign bit turned (so that bytes
    order like ids), the SHA-256 of the payload, a hash of the url."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    hex16 = lambda c: F.lpad(F.hex(c), 16, "0")
    order = F.when(F.col("page_id").isNull(), "01" + "0" * 16).otherwise(F.concat(F.lit("00"), hex16(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63))))))
    key = F.unhex(F.concat(order, F.sha2(F.col("payload").cast("binary"), 256), hex16(F.xxhash64("url"))))
    return rows.select(key.alias("key"), "page_id", "url", "payload")


def _along(keys: DataFrame) -> DataFrame:
    """Range-sort (key, size, n) and add ``start``, the bytes ahead of each key. Settled."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            inside = np.asarray(batch.column(1)) * np.asarray(batch.column(2))
            starts = total + np.cumsum(inside) - inside
            total += int(inside.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts), pa.array(np.full(batch.num_rows, task))], names=["key", "size", "n", "ahead", "task"])

    ranged = keys.select("key", "size", "n").repartitionByRange("key").sortWithinPartitions("key")
    ranged = settle(ranged.mapInArrow(running, "key binary, size long, n long, ahead long, task long"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    offsets = ranged.groupBy("task").agg(F.sum(F.col("size") * F.col("n")).alias("inside")).select("task", F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("offset"))
    return join_measured(ranged, settle(offsets), "task").select("key", "size", "n", (F.col("ahead") + F.col("offset")).alias("start"))


def _verdicts(keys: DataFrame, revisit_bytes: int) -> DataFrame:
    """(key, refers_to) of the revisits: the key of the response that each repeats."""
    keys = keys.where(F.col("size") >= revisit_bytes + HEADERS).select("key", F.substring("key", 10, 32).alias("digest"))
    firsts = settle(keys.groupBy("digest").agg(F.min("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    page = lambda c: F.substring(c, 1, 9)
    return join_measured(keys, firsts, "digest", "inner").where((page("key") > page("refers_to")) & (F.substring("refers_to", 1, 1) == F.lit(b"\x00"))).select("key", "refers_to")


def _pieces(keys: DataFrame, width: int) -> DataFrame:
    """(key, shard, number, copies): how many copies of a repeated row go to each shard, and the number of the first."""
    last = (F.col("start") + F.col("size") * (F.col("n") - 1)) / width
    each = keys.withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last))))
    reach = lambda s: F.least(F.col("n"), F.greatest(F.lit(0), F.ceil((s * width - F.col("start")) / F.col("size")))).cast("long")
    each = each.withColumn("number", reach(F.col("shard"))).withColumn("copies", reach(F.col("shard") + 1) - F.col("number"))
    return each.where("copies > 0").select("key", F.col("shard").cast("int").alias("shard"), "number", "copies")


def write(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, shard_bytes: int = 64 << 20, file_bytes: int | None = None, max_shards: int = 20_000, revisit_bytes: int = 100, date: str = "2020-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write ``pages`` below ``root`` (a new folder of the shared one by default); the manifest, which is also kept there.
    A file is rolled at ``file_bytes``, an eighth of a shard's payload by default."""
    spark = pages.sparkSession
    root = root or scratch(spark, "warc")
    rows = _keyed(pages, id_col, url_col, payload_col)
    size = (F.octet_length("payload") + HEADERS).cast("long")
    keys = rows.select("key", size.alias("size")).groupBy("key").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    keys = _along(keys)
    total = keys.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()[0]
    width = max(1, shard_bytes, -(-total // max_shards))
    file_bytes = file_bytes or max(1, width // 8)
    repeated = settle(keys.where("n > 1"))
    pieces = None if repeated.isEmpty() else settle(_pieces(repeated, width))
    firsts = sorted((bytes(r["key"]), r["shard"]) for r in keys.groupBy(F.floor(F.col("start") / width).alias("shard")).agg(F.min("key").alias("key")).collect())  # at most max_shards + 1
    more = [] if pieces is None else [r[0] for r in pieces.select("shard").distinct().collect()]  # likewise
    dense = {s: k for k, s in enumerate(sorted({s for _, s in firsts} | set(more)))}  # a long record leaves gaps
    bounds, numbers = [k for k, _ in firsts], [dense[s] for _, s in firsts]

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: numbers[bisect_right(bounds, bytes(k)) - 1])

    @F.pandas_udf("int")
    def renumbered(shard: pd.Series) -> pd.Series:
        return shard.map(dense)

    one, none = F.lit(1).cast("long"), F.lit(None)
    verdicts = _verdicts(keys, revisit_bytes).withColumns({"shard": shard_of("key"), "number": F.lit(0).cast("long"), "copies": one})
    plain = rows
    if pieces is not None:
        again, pieces = repeated.select("key"), pieces.withColumn("shard", renumbered("shard"))
        plain = join_measured(rows, again, "key", "left_anti")
        few = join_measured(rows, again, "key", "left_semi").groupBy("key").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "payload"))).join(pieces, "key")
        spread = verdicts.select("key", "refers_to").join(pieces, "key")
        verdicts = join_measured(verdicts, again, "key", "left_anti").unionByName(spread)
    placed = plain.withColumns({"shard": shard_of("key"), "number": F.lit(0).cast("long"), "copies": one})
    placed = placed if plain is rows else placed.unionByName(few)
    placed = placed.withColumn("refers_to", none.cast("binary")).unionByName(verdicts, allowMissingColumns=True)
    # verdicts ride to the writer as rows of their own, ahead of the record they speak of: payloads move once
    placed = placed.select("shard", "key", "page_id", "url", "payload", "number", "copies", "refers_to")
    placed = placed.repartitionById(max(1, len(dense)), "shard").sortWithinPartitions("shard", "key", F.col("refers_to").asc_nulls_last())

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        writer, refers = None, (None, None)
        for batch in batches:
            for r in batch.to_pylist():
                if writer is not None and writer.shard != r["shard"]:
                    done += writer.close()
                    writer = None
                if writer is None:
                    writer = _Writer(root, r["shard"], file_bytes, date, level)
                if r["refers_to"] is not None:
                    refers = (r["key"], r["refers_to"])
                else:
                    for number in range(r["number"], r["number"] + r["copies"]):
                        writer.add(r, number, refers[1] if refers[0] == r["key"] else None)
        if writer is not None:
            done += writer.close()
        yield pa.RecordBatch.from_pylist(done, _MANIFEST)

    manifest = settle(placed.mapInArrow(put, MANIFEST))
    manifest.coalesce(1).sortWithinPartitions("shard", "part").write.json(f"{root}/manifest")
    return manifest


def record_id(key: str, number: int) -> str:
    """A record's id, from its key (hexadecimal) and the number of its earlier equals."""
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{key}/{number}'.encode()).hexdigest()[:32])}>"


class _Writer:
    """Files of one shard."""

    def __init__(self, root: str, shard: int, file_bytes: int, date: str, level: int):
        self.fs, self.root = _file_system(root)
        self.uri, self.shard, self.file_bytes, self.date, self.level = root, shard, file_bytes, date, level
        self.part, self.out, self.manifest = 0, None, []
        self.attempt = uuid.uuid4().hex

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.temporary = f"{self.root}/_temporary/{self.attempt}/{self.name}"
        self.fs.create_dir(f"{self.root}/_temporary/{self.attempt}", recursive=True)
        self.out, self.size, self.records, self.sum = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self._put([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(self.name, 0)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

    def _put(self, headers: list[tuple[str, str]], block: bytes) -> None:
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Date", self.date), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))])
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = z.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)
        self.records += 1

    def add(self, r: dict, number: int, refers_to: bytes | None) -> None:
        if self.out is None:
            self._open()
        payload = r["payload"].encode()
        headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(r["key"].hex(), number)), ("WARC-Payload-Digest", f"sha256:{r['key'][9:41].hex()}"), ("Content-Type", "application/http; msgtype=response")]
        if r["page_id"] is not None:
            headers.append(("X-Page-Id", str(r["page_id"])))
        if r["url"] is not None:
            headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"])))
        if refers_to is not None:
            page = int.from_bytes(refers_to[1:9], "big") - (1 << 63)
            headers += [("WARC-Refers-To", record_id(refers_to.hex(), 0)), ("X-Refers-To-Page", str(page)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        self._put(headers, http + (payload if refers_to is None else b""))
        if self.size >= self.file_bytes:
            self._roll()

    def _roll(self) -> None:
        self.out.close()
        final = f"{self.root}/{self.name}"
        try:
            self.fs.move(self.temporary, final)
        except OSError:  # a store that doesn't replace: an earlier attempt has put the same bytes there
            self.fs.delete_file(final)
            self.fs.move(self.temporary, final)
        self.manifest.append({"path": f"{self.uri}/{self.name}", "shard": self.shard, "part": self.part, "records": self.records, "bytes": self.size, "digest": self.sum.hexdigest()})
        self.part, self.out = self.part + 1, None

    def close(self) -> list[dict]:
        if self.out is not None:
            self._roll()
        if self.fs.get_file_info(f"{self.root}/_temporary/{self.attempt}").type.name == "Directory":
            self.fs.delete_dir(f"{self.root}/_temporary/{self.attempt}")
        return self.manifest


def read(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of the files of a manifest. Block and payload digests are checked."""
    files = manifest.select("path")
    files = files.repartitionByRange(max(1, files.count()), "path")  # one file a task

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for head, block in _members(path):
                    if head["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:") or head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: a digest of {head['WARC-Record-ID']} does not fit")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append({"page_id": number("X-Page-Id"), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": digest, "payload": payload if with_payload and head["WARC-Type"] == "response" else None})
                    size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    return files.mapInArrow(get, RECORDS)


def _members(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, read piece by piece."""
    fs, name = _file_system(path)
    with fs.open_input_stream(name, compression=None) as f:
        data = f.read(1 << 20)
        while data:
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                if not data:
                    raise ValueError(f"{path}: the file ends within a record")
                parts.append(z.decompress(data))
                data = z.unused_data if z.eof else f.read(1 << 20)
            data = data or f.read(1 << 20)
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]
