"""Media columns in Ogg: a writer of two interleaved logical streams, and a reader that checks what it reads.

The reader verifies each page's checksum, puts packets together from lacing values (over page bounds too), takes
the logical streams apart by serial number within each link of a chain, and derives packet times from granule
positions. The first stream holds a payload as 8-bit samples in the published mapping of raw PCM to Ogg (a header
packet "PCM     ", a Vorbis comment packet, sample packets), the second one packet that describes it.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal media; a payload of any size is stored
whole. A damaged page, a lost page, a missing stream, a serial that begins twice in a link or a stream that begins
among data raises ValueError; a new link may use any serial again. describe() gives the error as the row's status,
with nulls for what could not be read, or raises it if it is strict. Both directions are map stages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..runtime import ship

RATE = 8000
PACKET = 4096
_HEADER = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_SAMPLES, _ABOUT = b"PCM     ", b"\x01about"
_FORMAT = struct.Struct(">8sHHIIBBHI")  # mark, version, sample format, rate, bits, channels, frames a packet, more headers
_UNSIGNED_8 = 1
_VENDOR = b"duoscope"
_COMMENTS = struct.pack("<I", len(_VENDOR)) + _VENDOR + struct.pack("<I", 0)


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04c11db7, not reflected, from 0): zlib's, of the bytes with their bits reversed."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def write_ogg(payload: bytes, n_bytes: int, rate: int = RATE, packet: int = PACKET) -> bytes:
    """The payload's samples and a description (unpadded size) in one Ogg file."""
    serial = zlib.crc32(payload)
    other = serial ^ 0x5A5A5A5A
    pages = [
        _page(_FIRST, 0, serial, 0, _lacing(_FORMAT.size), _FORMAT.pack(_SAMPLES, 0, 0, _UNSIGNED_8, rate, 8, 1, min(packet, 0xFFFF), 0)),
        _page(_FIRST, 0, other, 0, _lacing(len(_ABOUT)), _ABOUT),
        _page(0, 0, serial, 1, _lacing(len(_COMMENTS)), _COMMENTS),
    ]
    sizes = [packet] * (len(payload) // packet) + ([len(payload) % packet] if len(payload) % packet else [])
    lacing = b"".join(map(_lacing, sizes))
    at, number, open_packet, granule = 0, 2, False, 0
    for lo in range(0, len(lacing), 255):
        part = lacing[lo : lo + 255]
        size = sum(part)
        ends = [i for i, x in enumerate(part) if x < 255]
        done = at + sum(part[: ends[-1] + 1]) if ends else -1
        granule = done if ends else -1  # no packet ends on this page
        flags = _CONTINUED * open_packet | _LAST * (lo + 255 >= len(lacing))
        pages.append(_page(flags, granule, serial, number, part, payload[at : at + size]))
        if number == 2:
            about = struct.pack("<Q", n_bytes)
            pages.append(_page(_LAST, len(payload), other, 1, _lacing(len(about)), about))
        open_packet = part[-1] == 255
        at, number = at + size, number + 1
    return b"".join(pages)


@dataclass
class Stream:
    """One logical stream: its packets, and the granule position and time (seconds) of each page that ends one."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    partial: list[bytes] = field(default_factory=list)
    next_page: int = 0
    ended: bool = False


def read_pages(media: bytes) -> list[dict[int, Stream]]:
    """The logical streams by serial number, for each link of a chain."""
    links: list[dict[int, Stream]] = []
    streams: dict[int, Stream] = {}
    at, beginning = 0, False
    while at < len(media):
        if len(media) - at < _HEADER.size:
            raise ValueError("the last page is cut off")
        capture, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(media, at)
        if capture != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        body = at + _HEADER.size + n
        lacing = media[at + _HEADER.size : body]
        end = body + sum(lacing)
        page = media[at:end]
        if len(lacing) < n or len(page) < end - at or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise ValueError(f"the checksum of page {number} of stream {serial} is wrong")
        if flags & _FIRST:
            if not beginning:
                if not all(s.ended for s in streams.values()):
                    raise ValueError(f"stream {serial} begins among data")
                streams = {}
                links.append(streams)
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial] = Stream()
        beginning = bool(flags & _FIRST)
        own = streams.get(serial)
        if own is None or own.ended or own.next_page != number or bool(flags & _CONTINUED) != bool(own.partial):
            raise ValueError(f"stream {serial} lacks a page before {number}")
        own.next_page, own.ended = number + 1, bool(flags & _LAST)
        lo = hi = body
        finished = False
        for x in lacing:
            hi += x
            if x < 255:
                own.packets.append(b"".join([*own.partial, media[lo:hi]]))
                own.partial, lo, finished = [], hi, True
        if lo < hi or (lacing and lacing[-1] == 255):
            own.partial.append(media[lo:hi])
        if finished != (granule != -1):
            raise ValueError(f"the granule position of page {number} of stream {serial} is wrong")
        if finished:
            own.granules.append(granule)
        at = end
    if any(s.partial or not s.ended for link in links for s in link.values()):
        raise ValueError("a stream has no end")
    return links


@dataclass
class Sound:
    payload: bytes
    n_bytes: int
    rate: int
    times: list[float]


def read_chain(media: bytes) -> list[Sound]:
    """What write_ogg stored in each link, with the times at which pages end."""
    return [_sound(link) for link in read_pages(media)]


def read_ogg(media: bytes) -> Sound:
    """The one link of a file that is no chain."""
    found = read_chain(media)
    if len(found) != 1:
        raise ValueError(f"{len(found)} links where one is asked for")
    return found[0]


def _sound(link: dict[int, Stream]) -> Sound:
    found = {kind: s for s in link.values() for kind in (_SAMPLES, _ABOUT) if s.packets and s.packets[0].startswith(kind)}
    if set(found) != {_SAMPLES, _ABOUT} or len(found[_ABOUT].packets) < 2 or len(found[_SAMPLES].packets) < 2:
        raise ValueError("a logical stream is missing")
    sound, about = found[_SAMPLES], found[_ABOUT]
    if len(sound.packets[0]) != _FORMAT.size:
        raise ValueError("the header packet is cut off")
    _, _, _, kind, rate, bits, channels, _, more = _FORMAT.unpack(sound.packets[0])
    if (kind, bits, channels) != (_UNSIGNED_8, 8, 1) or not rate:
        raise ValueError("the samples are not one channel of 8 bits")
    (n_bytes,) = struct.unpack("<Q", about.packets[1])
    payload = b"".join(sound.packets[2 + more :])
    if sound.granules[-1] != len(payload):
        raise ValueError("samples are missing")
    return Sound(payload, n_bytes, rate, [g / rate for g in sound.granules[2:]])


def features(sound: Sound) -> str:
    """Duration, level, mean, zero crossings, peak, and the shares of eight amplitude bands."""
    x = np.frombuffer(sound.payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256) - 128.0
    mean = float(counts @ values) / len(x)
    level = float(counts @ values**2 / len(x)) ** 0.5
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    bands = "/".join(f"{v / len(x):.4f}" for v in counts.reshape(8, 32).sum(1).tolist())
    return f"seconds={sound.times[-1]:.3f};rms={level:.4f};mean={mean:.4f};crossings={crossings};peak={int(x.max())};bands={bands}"


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def to_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with each text stored as an Ogg file; the text column itself is dropped. Names may not clash."""
    keep = [c for c in df.columns if c != text]
    if media.lower() in (c.lower() for c in keep):
        raise ValueError(f"the input already has a column {media}; choose another name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            for lo in range(0, len(texts), 64):
                part = batch.slice(lo, 64)
                made = [write_ogg(payload_of(t), len(t)) for t in (x or b"" for x in texts.slice(lo, 64).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made, pa.binary())], [*keep, media])

    ship(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(media, T.BinaryType())]))


_READ = [("n_bytes", pa.int64(), T.LongType()), ("payload_bytes", pa.int64(), T.LongType()), ("payload_sha256", pa.string(), T.StringType()), ("tail_crc32", pa.int64(), T.LongType()), ("media_bytes", pa.int64(), T.LongType()), ("media_sha256", pa.string(), T.StringType()), ("feature", pa.string(), T.StringType()), ("status", pa.string(), T.StringType())]


def describe(df: DataFrame, key: str = "doc_id", media: str = "media", strict: bool = False) -> DataFrame:
    """Reads each media value back: digests of payload and stored form, features, and status: ok, or what is wrong."""

    def row(stored: bytes | None) -> tuple:
        try:
            s = read_ogg(stored or b"")
        except (ValueError, struct.error) as e:
            if strict:
                raise
            told = (None, None) if stored is None else (len(stored), hashlib.sha256(stored).hexdigest())
            return None, None, None, None, *told, None, str(e)
        return s.n_bytes, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(s), "ok"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(media)
            rows = [row(column[i].as_py()) for i in range(len(column))]
            columns = list(zip(*rows)) or [()] * len(_READ)
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(v, kind) for v, (_, kind, _) in zip(columns, _READ))], [key, *(c for c, _, _ in _READ)])

    ship(df.sparkSession)
    return df.select(key, media).mapInArrow(run, T.StructType([df.schema[key], *(T.StructField(c, kind) for c, _, kind in _READ)]))
