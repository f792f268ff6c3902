"""WARC archives compressed record by record with a shared Zstandard dictionary.

A dictionary is trained on a bounded sample of the records. Each archive starts with a
skippable frame that holds it; then every record is a frame of its own, so that any
record can be read from its offset with the dictionary alone. Tasks write archives of their
own partitions straight to the shared folder under names no other attempt uses; only archives in
the list that the job returns are ever read, so a lost or repeated task leaves nothing behind that counts.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import map_batches
from .scratch import materialise, new_path, release

#: Payloads shorter than this are always stored.
LEAST_REVISIT = 1000
#: Up to this many repeated payloads (some 70 bytes each) are broadcast, more are joined by a shuffle in so many parts each.
MAX_BROADCAST_COPIES, SALTS = 300_000, 64
#: Records a dictionary is trained on, at most, and the longest payload among them.
DICTIONARY_RECORDS, DICTIONARY_PAYLOAD = 1000, 1 << 16
DICTIONARY_BYTES = 1 << 16
LEVEL = 6
#: A new archive starts once one has this many compressed bytes.
ARCHIVE_BYTES = 1 << 30
# Magic of the skippable frame that carries a dictionary, and of a dictionary itself.
SKIPPABLE = 0x184D2A5D
DICTIONARY = 0xEC30A437
_FRAME_OUT = 1 << 20


def decide(pages: DataFrame, least: int = LEAST_REVISIT, most_broadcast: int = MAX_BROADCAST_COPIES) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest (hex SHA-1), record_type, refers_to.

    Equal payloads of at least ``least`` bytes: the row with the largest page_id is the
    response, the others revisit it. All else is a response. Rows that repeat that largest
    id are responses as well; rows without an id revisit those that have one.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    copies = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and newest is not null")
        .drop("n")
    )
    copies = materialise(copies, "warc_copies")
    if copies.count() <= most_broadcast:
        joined = rows.join(F.broadcast(copies), ["payload_digest", "payload_bytes"], "left")
    else:  # a payload may have very many copies: they meet its row in several places
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        spread = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        joined = salted.join(spread, ["payload_digest", "payload_bytes", "salt"], "left")
    revisits = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select(
        *rows.columns,
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisits, F.col("newest")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<{uuid.uuid4().urn}>"


def _page_of(name: str | None) -> int | None:
    prefix = "<urn:x-page:"
    return int(name[len(prefix) : -1]) if name and name.startswith(prefix) else None


def record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with its header only."""
    payload = row["html"].encode("utf-8", "surrogatepass")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    # a revisit keeps the HTTP header, and with it the length of the payload it stands for
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = "".join(c for c in row["url"] or "" if c > " ") or "urn:x-unknown"
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["record_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(row['refers_to'])}")
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(named["content-length"])]
    if len(block) < int(named["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {named.get('warc-record-id')} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode("latin-1").split("\r\n")[1:])}
    return {"warc": named, "http": fields, "payload": payload}


def train_dictionary(pages: DataFrame, records: int = DICTIONARY_RECORDS) -> bytes:
    """A dictionary from about ``records`` of the records; raw header text where there are too few.

    A hash draws them before anything is gathered, so no task handles more pages than are drawn,
    twice ``records`` at most (of equal rows all or none are drawn).
    """
    import zstandard

    fit = pages.where(F.col("record_type") == "response").where(F.col("payload_bytes") <= DICTIONARY_PAYLOAD)
    total = fit.count()
    if total > records:
        fit = fit.where(F.pmod(F.xxhash64("page_id", "payload_digest"), F.lit(1 << 40)) < -(-records * (1 << 40) // total))
    drawn = sorted(fit.limit(2 * records).collect(), key=lambda r: (r["payload_digest"], r["page_id"] or 0))
    samples = [record(r.asDict(), "2000-01-01T00:00:00Z") for r in drawn]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples
        return (b"".join(samples) + record({"html": "", "payload_digest": "00" * 20, "url": "", "record_type": "response", "page_id": 0}, ""))[-DICTIONARY_BYTES:]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, dictionary: bytes, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of :func:`decide` as archives in ``folder``: archive, page_id, offset, length of every record.

    The result is lazy; materialise it once, and read only archives that it lists.
    """
    sent = pages.sparkSession.sparkContext.broadcast(dictionary)

    def each():
        import zstandard

        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        held = {"out": None, "name": "", "at": 0}
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(sent.value), write_checksum=True)

        def start():
            if held["out"]:
                held["out"].close()
            name = f"{uuid.uuid4().hex}.warc.zst"
            held.update(out=system.open_output_stream(f"{base}/{name}", compression=None), name=name, at=0)
            head = struct.pack("<II", SKIPPABLE, len(sent.value)) + sent.value
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None)}\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            put(head)
            put(compressor.compress(info.encode()))

        def put(frame: bytes):
            held["out"].write(frame)
            held["at"] += len(frame)

        def turn(batch: pa.RecordBatch):
            rows: dict[str, list] = {"archive": [], "page_id": [], "offset": [], "length": []}
            for row in batch.to_pylist():
                if held["out"] is None or held["at"] >= ARCHIVE_BYTES:
                    start()
                frame = compressor.compress(record(row, date))
                for k, v in zip(rows, (held["name"], row["page_id"], held["at"], len(frame)), strict=True):
                    rows[k].append(v)
                put(frame)
            return rows

        def finish():
            if held["out"]:
                held["out"].close()

        turn.finish = finish
        return turn

    return map_batches(pages, "archive string, page_id long, offset long, length long", each)


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, in order: first the dictionary, then a frame at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary")
    dictionary = stream.read(size)
    if struct.unpack("<I", dictionary[:4])[0] == 0xFD2FB528:  # the dictionary may be compressed itself
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest = b""
    turn, parts = decompressor.decompressobj(), []
    while True:
        piece = rest or stream.read(_FRAME_OUT)
        if not piece:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(turn.decompress(piece))
        rest = b""
        if turn.eof:
            yield b"".join(parts)
            rest, parts, turn = turn.unused_data, [], decompressor.decompressobj()


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Read whole archives (column archive): page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is worked out anew from its payload and must be the one on record.
    """

    def each():
        system, base = _open(folder)

        def turn(batch: pa.RecordBatch):
            for name in batch.column("archive").to_pylist():
                rows, size = _empty(), 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for raw in frames(stream):
                        found = parse(raw)
                        warc = found["warc"]
                        if warc["warc-type"] == "warcinfo":
                            continue
                        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                        response = warc["warc-type"] == "response"
                        length = int(found["http"]["content-length"])
                        if response and (hashlib.sha1(found["payload"]).hexdigest() != digest or len(found["payload"]) != length):
                            raise ValueError(f"payload of {warc['warc-record-id']} in {name} is damaged")
                        values = (
                            _page_of(warc["warc-record-id"]), warc["warc-target-uri"], found["payload"].decode("utf-8", "replace") if response else None,
                            length, digest, warc["warc-type"], _page_of(warc.get("warc-refers-to")),
                        )
                        for k, v in zip(rows, values, strict=True):
                            rows[k].append(v)
                        size += len(raw)
                        if size > 16 << 20:
                            yield rows
                            rows, size = _empty(), 0
                yield rows

        return turn

    return map_batches(archives.select("archive"), "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long", each)


def _empty() -> dict[str, list]:
    return {k: [] for k in ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")}


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> tuple[DataFrame, str]:
    """Write ``pages`` (page_id, url, html) as archives; the index of their records, and the folder.

    A null html is an empty payload, a null url an unknown target; other columns are ignored; an
    empty table writes nothing. The folder is one of the cluster's shared one unless given.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    decided = materialise(decide(pages, least), "warc_pages")
    dictionary = train_dictionary(decided)
    index = materialise(write(decided, folder, dictionary), "warc_index")
    release(decided)
    return index, folder


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` and read the archives back: a row per record as :func:`read` gives it."""
    index, folder = archive(pages, least=least)
    names = index.select("archive").distinct()
    return read(names.repartition(max(1, names.count())), folder)
