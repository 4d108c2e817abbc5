"""WARC records in ZIP packages: written from pages, and read by ranges without extraction.

A package holds ``archive/data.warc`` (records end to end) and ``indexes/index.cdx`` (one line for
each record: offset, length, id), both stored, not compressed, so that a record is a range of the
package. The reader finds the central directory from the end of the file, through the ZIP64
records where the package has them, locates the members, reads the index, and then only ranges.
Files are opened through Arrow file systems, so packages can lie in any shared store.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

DATA, INDEX = "archive/data.warc", "indexes/index.cdx"
_EOCD, _EOCD64, _LOCATOR, _CENTRAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
#: Bytes of a package at which a task begins the next one.
PACKAGE_BYTES = 64 << 20
#: Bytes of a package that one task reads, about.
STRETCH_BYTES = 8 << 20
#: A Bloom filter has at most so many blocks of so many bytes: 64 MB, room for 44 million keys.
BLOCK_BYTES, MOST_BLOCKS = 64 << 10, 1024
#: A payload is looked up, not joined, if more than one page in so many holds it; there are fewer than so many of these.
HOT = 1000


def filesystem(path: str):
    """An Arrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


# ------------------------------------------------------------------------------------ ZIP directory


def _extra64(extra: bytes, values: list[int]) -> list[int]:
    """Values that the directory gives as all ones, from the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            fields = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(fields) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + size
    return values


def members(handle, size: int) -> dict[str, tuple[int, int]]:
    """Start and length of the data of each stored member of a package.

    ``handle`` needs seek and read. Only the directory and local headers are read. Compressed or
    encrypted members are left out, since their records are not ranges.
    """
    tail_size = min(size, 65_557)
    handle.seek(size - tail_size)
    tail = handle.read(tail_size)
    at = tail.rfind(_EOCD)
    if at < 0:
        raise ValueError("not a ZIP package: no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        where = size - tail_size + at - 20
        handle.seek(where)
        locator = handle.read(20)
        if locator[:4] != _LOCATOR:
            raise ValueError("ZIP64 locator missing")
        handle.seek(struct.unpack_from("<Q", locator, 8)[0])
        record = handle.read(56)
        if record[:4] != _EOCD64:
            raise ValueError("ZIP64 end of central directory missing")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    handle.seek(start)
    directory = handle.read(length)
    out, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("central directory damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        plain, packed, offset = _extra64(extra, [plain, packed, offset])
        at += 46 + n_name + n_extra + n_comment
        if method == 0 and not flags & 1:
            handle.seek(offset + 26)
            local_name, local_extra = struct.unpack("<HH", handle.read(4))
            out[name] = (offset + 30 + local_name + local_extra, plain)
    return out


# ------------------------------------------------------------------------------------- WARC records


def record(page_id, url: str | None, kind: str, payload: bytes, digest: str, refers_to, full: int | None = None) -> bytes:
    """One WARC record; a revisit carries no payload but names the record that does. ``full`` is
    the length of the payload, where ``payload`` isn't given."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload) if full is None else full}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if kind == "response" else b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Package:
    """A package under way; its records go to the file as they come, directory last."""

    def __init__(self, folder: str, name: str):
        system, path = filesystem(f"{folder}/{name}")
        self.path, self.lines, self.size = f"{folder}/{name}", [], 0
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Unseekable(self.file), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, page_id, raw: bytes):
        self.lines.append(f"{self.size} {len(raw)} {'' if page_id is None else page_id}")
        self.data.write(raw)
        self.size += len(raw)

    def close(self):
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.file.close()


class _Unseekable(io.RawIOBase):
    """Streams of object stores only go forward."""

    def __init__(self, file):
        self.file = file

    def writable(self):
        return True

    def write(self, raw):
        self.file.write(bytes(raw))
        return len(raw)


class _Packages:
    """The packages that one task writes, one after the other.

    A name holds the partition and attempt, so a repeated or speculative task never writes to the
    file of another attempt; only paths that Spark commits are read back.
    """

    def __init__(self, folder: str, kind: str, package_bytes: int):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.folder, self.stem, self.most = folder, f"{kind}{context.partitionId():06d}-{context.taskAttemptId()}", package_bytes
        self.package, self.paths = None, []

    def add(self, page_id, raw: bytes):
        if self.package is None:
            self.package = _Package(self.folder, f"{self.stem}-{len(self.paths):04d}.wacz")
        self.package.add(page_id, raw)
        if self.package.size >= self.most:
            self.close()

    def close(self):
        if self.package is not None:
            self.package.close()
            self.paths.append(self.package.path)
            self.package = None

    def batch(self):
        import pyarrow as pa

        self.close()
        return pa.RecordBatch.from_arrays([pa.array(self.paths, pa.string())], names=["path"])


def _rows(batch):
    """Row dictionaries of a batch, some at a time, so that few payloads are held twice."""
    for s in range(0, batch.num_rows, 256):
        yield from batch.slice(s, 256).to_pylist()


# ------------------------------------------------------------------------------- who is a revisit


def _key(page_id, digest: bytes) -> int:
    """63 bits of a page and its payload's digest; what it is in the archive depends on these two only."""
    return int.from_bytes(hashlib.blake2b(digest + (b"" if page_id is None else page_id.to_bytes(8, "little", signed=True)), digest_size=8).digest(), "little") >> 1


class Bloom:
    """A Bloom filter in blocks: a key's block, and six bits in it. With no bits every key may be there."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits  # blocks x bytes

    @staticmethod
    def places(keys: np.ndarray) -> np.ndarray:
        """Six bit places in a block for each key."""
        a, b = keys & 0xFFFFF, (keys >> 20 & 0xFFFFF) | 1
        return (a[:, None] + np.arange(6) * b[:, None]) % (8 * BLOCK_BYTES)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(keys), bool)
        if not len(self.bits):
            return np.zeros(len(keys), bool)
        home, at = (keys >> 40) % len(self.bits), self.places(keys)
        return ((self.bits[home[:, None], at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _block(key, pdf):
    import pandas as pd

    bits = np.zeros(8 * BLOCK_BYTES, np.uint8)
    bits[Bloom.places(pdf["key"].to_numpy()).ravel()] = 1
    return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def bloom(keys: DataFrame) -> Bloom:
    """Filter over a column key (long). At most MOST_BLOCKS blocks reach the driver; a table too
    large for them gives a filter that lets everything pass."""
    n = keys.count()
    blocks = 1 << max(0, -(-12 * n // (8 * BLOCK_BYTES)) - 1).bit_length() if n else 0
    if blocks > MOST_BLOCKS:
        return Bloom(None)
    out = np.zeros((blocks, BLOCK_BYTES), np.uint8)
    if n:
        home = (F.shiftright("key", 40) % blocks).cast("int")
        for r in keys.select("key", home.alias("block")).groupBy("block").applyInPandas(_block, "block int, bits binary").collect():
            out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return Bloom(out)


def _digests(batches):
    """page_id, url, digest, length, key of each page."""
    import pyarrow as pa

    for batch in batches:
        ids, urls, digests, lengths, keys = [], [], [], [], []
        for row in _rows(batch):
            payload = (row["html"] or "").encode()
            digest = hashlib.sha1(payload).digest()
            ids.append(row["page_id"])
            urls.append(row["url"])
            digests.append(digest)
            lengths.append(len(payload))
            keys.append(_key(row["page_id"], digest))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(digests, pa.binary()), pa.array(lengths, pa.int64()), pa.array(keys, pa.int64())], names=["page_id", "url", "digest", "length", "key"])


def _write_unless(folder: str, package_bytes: int, revisits):
    def run(batches):
        """Write the response of each page that is certainly no revisit."""
        packages = _Packages(folder, "a", package_bytes)
        for batch in batches:
            for row in _rows(batch):
                payload = (row["html"] or "").encode()
                digest = hashlib.sha1(payload).digest()
                if not revisits.value.may_hold(np.array([_key(row["page_id"], digest)]))[0]:
                    packages.add(row["page_id"], record(row["page_id"], row["url"], "response", payload, base64.b32encode(digest).decode(), None))
        yield packages.batch()

    return run


def _kept_back(revisits, doubtful):
    def run(batches):
        """Pages, with digests, that may be both a revisit and one of those wrongly taken for one."""
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in _rows(batch):
                payload = (row["html"] or "").encode()
                digest = hashlib.sha1(payload).digest()
                key = np.array([_key(row["page_id"], digest)])
                if revisits.value.may_hold(key)[0] and doubtful.value.may_hold(key)[0]:
                    out.append({**row, "digest": digest})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("digest", pa.binary())]))

    return run


def _write(folder: str, kind: str, package_bytes: int):
    def run(batches):
        """Write rows that say what they are."""
        packages = _Packages(folder, kind, package_bytes)
        for batch in batches:
            for row in _rows(batch):
                digest = base64.b32encode(row["digest"]).decode()
                if row["refers_to"] is None:
                    packages.add(row["page_id"], record(row["page_id"], row["url"], "response", (row["html"] or "").encode(), digest, None))
                else:
                    packages.add(row["page_id"], record(row["page_id"], row["url"], "revisit", b"", digest, row["refers_to"], row["length"]))
        yield packages.batch()

    return run


def _ranges(batches):
    """path, offset and length of every record that a package's index names."""
    import pyarrow as pa

    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, inside = filesystem(path)
            with system.open_input_file(inside) as file:
                found = members(file, file.size())
                if DATA not in found or INDEX not in found:
                    raise ValueError(f"{path}: archive member or index missing")
                file.seek(found[INDEX][0])
                lines = file.read(found[INDEX][1]).decode().splitlines()
            first, last = found[DATA]
            places = [tuple(map(int, x.split(" ")[:2])) for x in lines]
            if any(a + n > last for a, n in places):
                raise ValueError(f"{path}: the index passes the end of the archive")
            for s in range(0, len(places), 4096):
                part = places[s : s + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([first + a for a, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], names=["path", "offset", "length"])


def _read(batches):
    """Records of ranges; neighbouring ranges of one package share an open file."""
    import pyarrow as pa

    for batch in batches:
        rows = sorted(batch.to_pylist(), key=lambda r: (r["path"], r["offset"]))
        for s in range(0, len(rows), 256):
            out, name, file = [], None, None
            for r in rows[s : s + 256]:
                if r["path"] != name:
                    system, inside = filesystem(r["path"])
                    name, file = r["path"], system.open_input_file(inside)
                headers, payload = parse(file.read_at(r["length"], r["offset"]))
                ref = headers.get("warc-refers-to", "")[len("<urn:page:") : -1]
                own = headers["warc-record-id"][len("<urn:page:") : -1]
                if headers["warc-type"] == "response" and (digest_of(payload) != headers["warc-payload-digest"].removeprefix("sha1:") or len(payload) != int(headers["x-payload-length"])):
                    raise ValueError(f"{r['path']}: the payload of page {own} isn't what its digest says")
                out.append({
                    "page_id": None if own == "None" else int(own), "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"],
                    "payload_bytes": int(headers["x-payload-length"]), "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"),
                    "refers_to": int(ref) if ref and ref != "None" else None, "payload": payload,
                })
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))


def write_packages(pages: DataFrame, folder: str | None = None, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for each page to packages in ``folder`` (default: the shared folder); their paths.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id is
    a response and the others revisit it; smaller payloads are all responses. A null html is an
    empty payload. Pages whose page_id is null are written after others: they revisit the largest
    page_id, and where a payload has no page_id at all each of its pages is a response. Rows that
    share the largest page_id are all responses. Other columns are not read; an empty table writes
    no package.

    Digests, not payloads, are shuffled to find the revisits. A page whose page_id and digest a
    Bloom filter of the revisits doesn't hold is written where it is read. A revisit needs no
    payload. Only pages that the filter holds wrongly come with their payload, by a shuffle; with
    more revisits than the filter's bound has room for, that is every response.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/packages-{spark.sparkContext.applicationId}-{spark.sql('select uuid() as u').first()['u'][:8]}"
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = cut(p.mapInArrow(_digests, "page_id long, url string, digest binary, length long, key long"), "digests")
    homes = known.where(F.col("length") >= least).groupBy("digest", "length").agg(F.max("page_id").alias("home"), F.count("*").alias("n")).where("n > 1 and home is not null")
    homes = cut(homes, "homes")
    # payloads that many pages hold, at most HOT of them by their share, are looked up; others are joined
    total = known.count()
    often = F.col("n") * HOT > total
    hot = homes.where(often).select("digest", "length", "home")
    again = ~F.col("page_id").eqNullSafe(F.col("home"))
    columns = ("page_id", "url", "digest", "length", "key", "home")
    by = ["digest", "length"]
    rest = known.join(F.broadcast(hot.select(*by)), by, "left_anti").join(homes.where(~often).select(*by, "home"), by)
    revisits = cut(known.join(F.broadcast(hot), by).select(*columns).unionByName(rest.select(*columns)).where(again), "revisits")
    may = spark.sparkContext.broadcast(bloom(revisits.select("key")))  # bounded, see MOST_BLOCKS

    def wrongly(batches):
        """Keys of pages that the filter of revisits holds."""
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(may.value.may_hold(batch.column("key").to_numpy())))

    held = known.select("page_id", "digest", "key").mapInArrow(wrongly, "page_id long, digest binary, key long")
    same = lambda a, b: (F.col(f"{a}.digest") == F.col(f"{b}.digest")) & F.col(f"{a}.page_id").eqNullSafe(F.col(f"{b}.page_id"))
    doubtful = cut(held.alias("a").join(revisits.alias("b"), same("a", "b"), "left_anti").distinct(), "doubtful")
    second = spark.sparkContext.broadcast(bloom(doubtful.select("key")))
    back = p.mapInArrow(_kept_back(may, second), "page_id long, url string, html string, digest binary")
    back = back.alias("a").join(doubtful.alias("b"), same("a", "b"), "left_semi")
    nothing = F.lit(None).cast("long")
    back = back.select("page_id", "url", "html", "digest", nothing.alias("length"), nothing.alias("refers_to"))
    later = revisits.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "length", F.col("home").alias("refers_to"))
    paths = p.mapInArrow(_write_unless(folder, package_bytes, may), "path string")
    paths = paths.union(later.mapInArrow(_write(folder, "r", package_bytes), "path string"))
    return cut(paths.union(back.mapInArrow(_write(folder, "b", package_bytes), "path string")), "paths")


def read_packages(paths: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload of every record
    of the packages in the column path. payload_bytes and payload_digest (bare upper-case base32
    SHA-1) are of the full payload; a revisit's own payload is empty. A response whose payload
    isn't that of its digest raises."""
    found = paths.select("path")
    n = max(1, found.count())
    ranges = cut(found.repartition(n, "path").mapInArrow(_ranges, "path string, offset long, length long"), "ranges")
    # records are dealt out by stretches of a package, and about as many tasks as there are stretches
    size = ranges.agg(F.sum("length").alias("n")).first()["n"] or 0
    dealt = ranges.repartition(max(1, -(-size // STRETCH_BYTES)), "path", F.floor(F.col("offset") / STRETCH_BYTES))
    return dealt.mapInArrow(_read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
