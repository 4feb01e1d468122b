"""Media columns: Ogg streams of 8-bit samples.

``encode`` stores each text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as one 8-bit sample a byte
in an Ogg file of two logical streams: one says how many of the samples are text, the other has the samples.
``decode`` takes any such column apart: it verifies every page's checksum and sequence number, separates the logical
streams by serial number, puts packets together from the lacing values (over page bounds too) and gives each packet the
time of its granule position.

Null texts are stored as empty ones; an empty text is 64 zero samples. Equal texts give equal files, since serial numbers
come from the content. A null or damaged file decodes to nulls and an ``error``. Repeated rows are rows of their own, an
empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelode.llm.base import in_parts, table, workers_find_package

RATE = 8000
UNIT = 64
PACKET = 4096
CONTINUED, FIRST, LAST = 1, 2, 4
PAGE = struct.Struct("<4sBBqIIIB")
INFO = struct.Struct("<8sIQQ")  # magic, samples a second, bytes of text, samples
MAGIC = b"TextPCM8"
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """What is wrong with a file."""


def checksum(page: bytes) -> int:
    """Ogg's CRC-32: zlib's polynomial with bits in the other order, from 0, not inverted at the end."""
    reflected = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Packet:
    data: bytes
    granule: int | None  # of the page that it ends on, if it is the last to end there


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def pages_of(serial: int, packets: list[bytes], ends: list[int]) -> list[bytes]:
    """The pages of a logical stream; ends: each packet's granule position at its end."""
    segments: list[tuple[bytes, int | None]] = []  # a piece of at most 255 bytes, and the granule if its packet ends
    for data, end in zip(packets, ends, strict=True):
        cuts = [data[i : i + 255] for i in range(0, len(data) + 1, 255)]  # a last piece under 255 bytes, if need be empty
        segments += [(x, None) for x in cuts[:-1]] + [(cuts[-1], end)]
    out, continued = [], False
    for number, at in enumerate(range(0, len(segments), 255)):
        part = segments[at : at + 255]
        done = [g for _, g in part if g is not None]
        flags = CONTINUED * continued | FIRST * (at == 0) | LAST * (at + 255 >= len(segments))
        body = bytes(len(x) for x, _ in part) + b"".join(x for x, _ in part)
        head = PAGE.pack(b"OggS", 0, flags, done[-1] if done else -1, serial, number, 0, len(part))
        crc = checksum(head + body)
        out.append(head[:22] + crc.to_bytes(4, "little") + head[26:] + body)
        continued = part[-1][1] is None
    return out


def mux(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """An Ogg file of payload's samples; first pages of both streams come first, as the format asks."""
    serial = zlib.crc32(payload)
    cuts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    info = pages_of(serial, [INFO.pack(MAGIC, rate, n_bytes, len(payload))], [0])
    samples = pages_of(serial ^ 1, cuts, [min(len(payload), (i + 1) * PACKET) for i in range(len(cuts))])
    return b"".join([info[0], samples[0], *samples[1:]])


def demux(raw: bytes) -> dict[int, Stream]:
    """The logical streams of a file, by serial number, in order of their first pages."""
    streams: dict[int, Stream] = {}
    rest: dict[int, list[bytes]] = {}
    at = 0
    while at < len(raw):
        if len(raw) - at < PAGE.size:
            raise OggError("a page is cut off")
        magic, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(raw, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one should begin")
        lacing = raw[at + PAGE.size : at + PAGE.size + n]
        begin = at + PAGE.size + n
        end = begin + sum(lacing)
        if end > len(raw) or len(lacing) < n:
            raise OggError("a page is cut off")
        if checksum(raw[at : at + 22] + b"\0\0\0\0" + raw[at + 26 : end]) != crc:
            raise OggError("a page fails its checksum")
        if bool(flags & FIRST) != (serial not in streams):
            raise OggError("a stream begins twice or not at all")
        stream = streams.setdefault(serial, Stream(serial))
        if number != stream.pages or stream.ended:
            raise OggError("a page is missing or out of order")
        open_packet = rest.pop(serial, [])
        if bool(flags & CONTINUED) != bool(open_packet):
            raise OggError("a continued packet lacks a part")
        ended = []
        for size in lacing:
            open_packet.append(raw[begin : begin + size])
            begin += size
            if size < 255:
                ended.append(Packet(b"".join(open_packet), None))
                open_packet = []
        if (granule == -1) == bool(ended):
            raise OggError("a granule position without an ended packet, or the reverse")
        if ended:
            ended[-1].granule = granule
        stream.packets += ended
        if open_packet:
            rest[serial] = open_packet
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        at = end
    if rest or not all(s.ended for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def timed(stream: Stream) -> list[int]:
    """The granule position at each packet's end: known at the end of a page, elsewhere by counting samples back."""
    ends, after = [], None
    for p in reversed(stream.packets):
        now = p.granule if p.granule is not None else after
        ends.append(now)
        after = now - len(p.data)
    if after:
        raise OggError("granule positions and samples differ")
    return ends[::-1]


def read(raw: bytes) -> tuple[bytes, int, str]:
    """The payload, the bytes of text in it, and a feature string, from a file of encode()."""
    found = list(demux(raw).values())
    info = [s for s in found if s.packets and s.packets[0].data.startswith(MAGIC)]
    if len(info) != 1 or len(found) != 2:
        raise OggError("not a pair of an info and a sample stream")
    _, rate, n_bytes, n = INFO.unpack(info[0].packets[0].data)
    stream = next(s for s in found if s is not info[0])
    ends = timed(stream)
    payload = b"".join([p.data for p in stream.packets])
    if len(payload) != n or ends[-1] != n or n_bytes > n:
        raise OggError("the number of samples differs")
    x = np.frombuffer(payload, np.uint8)
    centred = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    feature = (
        f"ms={ends[-1] * 1000 // rate};last_ms={(ends[-2] if len(ends) > 1 else 0) * 1000 // rate};packets={len(ends)};pages={stream.pages + info[0].pages}"
        f";sum={int(centred.sum())};energy={int((centred * centred).sum())};crossings={crossings}"
    )
    return payload, n_bytes, feature


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, media: the Ogg file of each text."""
    workers_find_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches):
            media = []
            for text in b["text"]:
                raw = (text or "").encode("utf-8", "surrogatepass")
                media.append(mux(raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "media": media})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, media binary")


def decode(files: DataFrame, media: str = "media") -> DataFrame:
    """doc_id, text_bytes (as stored), payload, feature, error: what is read from each file."""
    workers_find_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches, column="media"):
            rows = []
            for raw in b["media"]:
                try:
                    if raw is None:
                        raise OggError("no file")
                    payload, n, feature = read(raw)
                    rows.append((n, payload, feature, None))
                except (OggError, struct.error) as e:
                    rows.append((None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["text_bytes", "payload", "feature", "error"])
            yield out.assign(doc_id=b["doc_id"].astype("Int64").to_numpy(), text_bytes=out["text_bytes"].astype("Int64"))

    return files.select("doc_id", F.col(media).alias("media")).mapInPandas(run, "doc_id long, text_bytes long, payload binary, feature string, error string")


def digests(docs: DataFrame) -> DataFrame:
    """The files' digests, a row for each document: encoded, read back, and told in one pass each."""
    workers_find_package(docs.sparkSession)
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches, column="media"):
            rows = []
            for raw in b["media"]:
                payload, n, feature = read(bytes(raw))
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield out.assign(doc_id=b["doc_id"].astype("Int64").to_numpy())

    return encode(docs).mapInPandas(run, fields)


def op2_ogg_media(spark, sf_dir) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
