"""Dictionary-compressed WARC archives, written and read by Spark.

An archive is a series of Zstandard frames: first a skippable frame (magic ``0x184D2A5D``) that
embeds the dictionary, then one compressed frame per WARC record.  Archives are rows of a text
sink whose line separator is itself an empty skippable frame, so Spark's own commit protocol writes
the files to any store it knows, a lost task leaves nothing behind, and the result is plain
``.warc.zst`` content for any reader that follows the format.

The dictionary is trained once, on at most ``SAMPLE_RECORDS`` records (smallest hash of the page id),
each cut to ``SAMPLE_BYTES``; every record is compressed whole.  Archives hold about
``archive_bytes`` of payload each, so neither a writer task nor a reader row grows with the input.

Edge cases: null html is the empty payload; a null url leaves the target header out; a page without
id is written in full and never referred to; repeated rows of one page id are equal records (if that
id is the largest of its payload, each of them is a response); an empty table writes no archive and
reads back as no rows; further columns of the input are not archived.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belfry.session import scratch_path, written

# Fixed values of the formats: frame magics, record fields, revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"  # skippable frame 0x184D2A50 of length 0
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
DICT_BYTES = 112_640
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 16_384
LEVEL = 3
FEED = 1 << 15

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _id_uri(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _id_of(uri: str) -> int | None:
    tail = uri.strip("<>").rsplit(":", 1)[-1]
    return None if tail == "none" else int(tail)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps only the HTTP head."""
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id_uri(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _id_uri(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def frames(content: bytes) -> Iterator[bytes]:
    """Records of one archive: the dictionary is taken from its leading frame, other skippable frames are passed."""
    import zstandard
    view, at, unpack = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            length, = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC and at == 0:
                held = bytes(view[8:8 + length])
                held = zstandard.ZstdDecompressor().decompress(held) if held[:4] == FRAME_MAGIC else held
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + length
            continue
        one, out = unpack.decompressobj(), []
        while not one.eof:
            piece = view[at:at + FEED]
            if not piece:
                raise ValueError("archive ends inside a record")
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(out)


def planned_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, int]:
    """Rows to archive (page_id, url, payload, payload_digest, refers_to), and the bytes of all payloads.

    Which page a revisit refers to is settled on (page_id, digest) pairs; payloads then move once, by page id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    narrow = written(rows.select("page_id", "payload_digest", F.octet_length("payload").cast("long").alias("n")), "warc-digests")
    total = narrow.agg(F.sum("n")).first()[0] or 0
    large = narrow.where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull())
    owners = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    # one map per page id (it has one entry unless the id is repeated), so that the join reuses the archives' partitioning
    revisits = (large.join(owners, "payload_digest").where("page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()
                .groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("payload_digest", "refers_to"))).alias("owners")))
    archives = max(1, -(-total // ARCHIVE_BYTES))
    named = rows.where("page_id is not null").repartition(archives, "page_id")
    unnamed = rows.where("page_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    joined = named.join(revisits, "page_id", "left").withColumn("refers_to", F.col("owners")[F.col("payload_digest")])
    return joined.select(*unnamed.columns).unionByName(unnamed), total


def train(pages: DataFrame, date: str) -> bytes:
    """A dictionary from a bounded sample of the records to be archived (collected: at most 400 x 16 KiB)."""
    import zstandard
    # every task hands the driver its smallest hashes; contents are read for the chosen ids (a bounded broadcast) only
    chosen = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_RECORDS)
    sample = (pages.join(F.broadcast(chosen.withColumnRenamed("page_id", "chosen")), F.col("page_id").eqNullSafe(F.col("chosen")))
              .select("page_id", "url", F.substring(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 1, SAMPLE_BYTES).alias("p"))
              .limit(SAMPLE_RECORDS).collect())
    sample.sort(key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["url"] or "", bytes(r["p"])))
    records = [record_bytes(r["page_id"], r["url"], bytes(r["p"]), hashlib.sha1(bytes(r["p"])).hexdigest(), None, date) for r in sample]
    pieces = [rec[i:i + 4096] for rec in records for i in range(0, len(rec), 4096)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the sample itself serves as history
        return b"".join(pieces)[-DICT_BYTES:]


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "2000-01-01T00:00:00Z") -> None:
    """Archive every page under ``path``, one file per partition."""
    dictionary = train(pages, date)
    records, _ = planned_records(pages, min_revisit_bytes)

    def archived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
        lead = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary]
        for batch in batches:
            if len(batch) == 0:
                continue
            out, lead = lead, []
            for page_id, url, payload, digest, refers_to in zip(*(batch[c] for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))):
                raw = record_bytes(None if page_id is None or pd.isna(page_id) else int(page_id), url, bytes(payload), digest,
                                   None if refers_to is None or pd.isna(refers_to) else int(refers_to), date)
                out.append(pack.compress(raw))
            yield pd.DataFrame({"frame": out})

    # ids as text: pandas would turn a long column with nulls into doubles
    as_text = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    (as_text.mapInPandas(archived, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR).text(path))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of every archive under ``path``; with ``payloads`` also the stored payload (null for revisits)."""
    schema = RECORD + (", payload binary" if payloads else "")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for raw in frames(bytes(content)):
                    fields, payload = parse_record(raw)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].split(":", 1)[1]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    row = (_id_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind,
                           _id_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
                           len(payload) if kind == "response" else int(fields["WARC-Payload-Length"]), digest)
                    rows.append(row + ((payload if kind == "response" else None,) if payloads else ()))
                    if len(rows) >= 500:
                        yield _frame(rows, names)
                        rows = []
                if rows:
                    yield _frame(rows, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
