"""A deterministic sharded WARC writer and its reader.

Records are ranged by page_id into shards whose borders follow from the data alone, sorted within, and written as gzip
members to files that roll over at a compressed size. Names, dates, ids and digests are made from the records, so a task
that runs again writes the same bytes. Each file is written under a name of its own attempt and then renamed; the manifest,
written last by Spark, lists the files that count.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import map_frames, saved, scratch

DATE = "2024-01-01T00:00:00Z"
SHARD_BYTES, FILE_BYTES = 32 << 20, 8 << 20
SAMPLES_PER_SHARD = 64
SALTS = 64
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(column) -> F.Column:
    """Bare upper-case base32 of the SHA-1 of a UTF-8 text: five hex digits at a time give four characters."""
    digits = F.sha1(F.encode(column, "UTF-8"))
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):
        number = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(alphabet, F.shiftright(number, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, 1) for k in range(4)]
    return F.concat(*parts)


def record_roles(pages: DataFrame) -> DataFrame:
    """``page_id, payload_digest, payload_bytes, response_id``: the largest page_id of each payload answers for all.

    The largest id is found per share of a digest and then over the at most SALTS shares, so a payload that a third of all
    pages have is spread.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = saved(pages.select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(text).alias("payload_digest"), F.octet_length(text).cast("long").alias("payload_bytes")), "digests")
    rows = rows.withColumn("share", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    shares = rows.groupBy("payload_digest", "share").agg(F.max("page_id").alias("most"))
    shares = shares.select("payload_digest", "share", F.max("most").over(Window.partitionBy("payload_digest")).alias("response_id"))
    return rows.join(shares, ["payload_digest", "share"]).select("page_id", "payload_digest", "payload_bytes", "response_id")


def shard_borders(roles: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """Least page_ids of all shards but the first, from the data alone.

    A hash of the page_id picks about SAMPLES_PER_SHARD ids per shard; they only place borders, every row is written.
    """
    total = roles.agg(F.count("*").alias("n"), F.sum("payload_bytes").alias("size")).first()
    shards = max(1, -(-(total["size"] or 0) // shard_bytes))
    every = max(1, total["n"] // (shards * SAMPLES_PER_SHARD))
    picked = roles.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("page_id", "payload_bytes").orderBy("page_id").collect() if shards > 1 else []
    size, borders, held = sum(r["payload_bytes"] for r in picked) / shards, [], 0.0
    for row in picked:
        if held >= size * (len(borders) + 1) and (not borders or row["page_id"] > borders[-1]):
            borders.append(row["page_id"])
        held += row["payload_bytes"]
    return borders


def shard_of(page_id, borders: list[int]):
    """How many borders are at or below a page_id, by halving."""
    if not borders:
        return F.lit(0)
    values, steps = F.array(*(F.lit(b).cast("long") for b in borders)), len(borders).bit_length()
    low_high = F.struct(F.lit(0).alias("low"), F.lit(len(borders)).alias("high"))

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = (s["low"] < s["high"]) & (F.element_at(values, F.least(middle + 1, F.lit(len(borders)))) <= page_id)
        return F.struct(F.when(above, middle + 1).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(F.greatest(middle, s["low"])).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), low_high, halve)["low"]


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _member(page_id, url: str, digest: str, size: int, response_id, payload: bytes) -> bytes:
    revisit = response_id is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    target = "".join(c if " " < c < "\x7f" else f"%{b:02X}" if len(c.encode()) == 1 else "".join(f"%{x:02X}" for x in c.encode()) for c in url for b in [ord(c)])
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_base32(block)}", f"X-Page-ID: {page_id}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(response_id)}", f"X-Refers-To-Page-ID: {response_id}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Rolling:
    """Files of one shard: a new one once ``limit`` compressed bytes are reached, each committed by a rename."""

    def __init__(self, root: str, shard: int, limit: int):
        self.store, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.limit, self.number, self.out = shard, limit, 0, None

    def write(self, member: bytes) -> tuple | None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.attempt = f"{self.root}/_attempts/{self.name}.{uuid.uuid4().hex}"
            self.out, self.records, self.size, self.sum = self.store.open_output_stream(self.attempt, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sum.update(member)
        self.records += 1
        self.size += len(member)
        return self.commit() if self.size >= self.limit else None

    def commit(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.store.move(self.attempt, f"{self.root}/{self.name}")
        self.out, self.number = None, self.number + 1
        return (self.name, self.records, self.size, self.sum.hexdigest())


def write_archives(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every page (``page_id, url, html``) below ``root`` and return the manifest, which is saved beside the files.

    Null html is an empty payload, null urls are empty. Rows that repeat a page_id are records of their own; those with the
    largest id of their payload are all responses. Rows without page_id come first. No pages give an empty manifest.
    """
    roles = saved(record_roles(pages), "roles")
    borders = shard_borders(roles, shard_bytes)
    page_id = F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63)))
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(f"{folder}/_attempts", recursive=True)
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # a page's roles travel to its shard as rows of their own, just before its payload: the payloads are shuffled once
    notes = roles.select(page_id.alias("page_id"), "payload_digest", "payload_bytes", "response_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).distinct()
    bodies = pages.select(page_id.alias("page_id"), base32_sha1(text).alias("payload_digest"), F.lit(None).cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("response_id"),
                          F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text.alias("html"))
    rows = notes.unionByName(bodies).withColumn("shard", shard_of(F.col("page_id"), borders))
    rows = rows.repartitionByRange(len(borders) + 1, "shard").sortWithinPartitions("shard", "page_id", "payload_digest", F.col("html").isNotNull(), "url")

    def write(batches):
        files, known = None, None
        for pdf in batches:
            made = []
            for shard, page, digest, size, response, url, body in zip(pdf.shard, pdf.page_id, pdf.payload_digest, pdf.payload_bytes, pdf.response_id, pdf.url, pdf.html):
                if body is None:
                    known = (int(size), None if pd.isna(response) else int(response))
                    continue
                if files is None or files.shard != shard:
                    made.append(files.commit() if files else None)
                    files = _Rolling(root, int(shard), file_bytes)
                size, response = known
                shown = "" if page == -(1 << 63) else page
                refers = response if size >= 0 and response is not None and response != page else None
                made.append(files.write(_member(shown, url, digest, size, refers, body.encode())))
            yield pd.DataFrame([m for m in made if m], columns=["file", "records", "bytes", "sha256"])
        if files is not None:
            yield pd.DataFrame([m for m in [files.commit()] if m], columns=["file", "records", "bytes", "sha256"])

    manifest = map_frames(rows, write, MANIFEST)
    manifest.write.parquet(f"{root}/_manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{root}/_manifest")


def _members(stream):
    """Records of an archive: each gzip member alone in memory."""
    engine, data, raw = zlib.decompressobj(31), [], stream.read(1 << 20)
    while raw:
        data.append(engine.decompress(raw))
        if engine.eof:
            yield b"".join(data)
            raw, engine, data = engine.unused_data, zlib.decompressobj(31), []
            if raw:
                continue
        raw = stream.read(1 << 20)
    if any(data):
        raise ValueError("an archive ends within a record")


def parse(record: bytes) -> tuple:
    """One record as (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload); digests are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if f"sha1:{_base32(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or _base32(payload) != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    page, refers = fields["X-Page-ID"].strip(), fields.get("X-Refers-To-Page-ID")
    return (int(page) if page else None, fields["WARC-Target-URI"], size, digest, kind, int(refers) if refers else None, payload if kind == "response" else None)


def read_archives(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """Records of the manifest's files, one task per few files."""
    names = RECORD if payloads else RECORD.rpartition(", ")[0]
    columns = [x.split()[0] for x in names.split(", ")]

    def read(batches):
        store, folder = fs.FileSystem.from_uri(root)
        for pdf in batches:
            for name in pdf.file:
                rows = []
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        rows.append(parse(record)[:len(columns)])
                        if len(rows) == 256:
                            yield _frame(rows, columns)
                            rows = []
                yield _frame(rows, columns)

    files = manifest.select("file").repartition(max(1, min(manifest.count(), 4096)), "file")
    return map_frames(files, read, names)


def _frame(rows, columns) -> pd.DataFrame:
    whole = ("page_id", "payload_bytes", "refers_to")
    return pd.DataFrame({c: pd.array([r[i] for r in rows], "Int64") if c in whole else pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(columns)})


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder and read back what was written."""
    root = scratch(pages.sparkSession, "archives")
    if "://" not in root:
        root = f"file://{root}" if not root.startswith("file:") else root.replace("file:", "file://", 1)
    return read_archives(write_archives(pages, root), root, payloads=False)
