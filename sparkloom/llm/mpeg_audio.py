"""MPEG audio columns: a frame parser, and a lossless store of payloads in silent frames.

The parser resynchronises on frame headers (versions 1, 2 and 2.5, layers I to III), reads ID3 tags (texts of versions
2.3 and 2.4), skips junk, reads the table of a variable-bitrate header (Xing, Info or VBRI), verifies the checksums of
layers I and III (what layer II's covers depends on its bit allocation; such frames don't count as checked), and keeps the
exact duration as samples over rate and the byte offset of every frame. The store writes a payload as layer III frames whose side information declares no coded
audio, so that each is silence to a player and its main data is free for the payload, whose unit is the byte.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, text_bytes

# Fixed values of the format: kbit/s by (version is 1, layer), Hz by version, samples a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

#: The store's frames: MPEG 1, layer III, mono, 48 kHz, with checksums.
HEADER, SIDE = 4, 17
OVERHEAD = HEADER + 2 + SIDE
FULL = 3 * BITRATES[True, 3][14]
MULTIPLE = 64
LENGTH_TAG = "payload_bytes"


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, from 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@lru_cache(4096)
def header(word: int):
    """(size, samples, rate, layer, protected, bytes its checksum covers, kind) of a header word; None if it isn't one.

    Behind the header, a checksum covers layer III's side information and layer I's bit allocation.
    """
    version, layer, kbit, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or kbit in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    first, hertz, padding, mono = version == 3, RATES[version][rate], word >> 9 & 1, word >> 6 & 3 == 3
    bits = BITRATES[first, layer][kbit] * 1000
    samples = SAMPLES[first, layer]
    size = (12 * bits // hertz + padding) * 4 if layer == 1 else samples // 8 * bits // hertz + padding
    bound = ((word >> 4 & 3) + 1) * 4 if word >> 6 & 3 == 1 else 32  # joint stereo shares the bands from here on
    side = ((17 if mono else 32) if first else (9 if mono else 17)) if layer == 3 else (16 if mono else (bound + 32) // 2) if layer == 1 else 0
    return size, samples, hertz, layer, not word >> 16 & 1, side, (version, layer, hertz)


def id3_size(data: bytes, at: int) -> int:
    """The whole size of an ID3v2 tag at a place, or 0."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return 0
    a, b, c, d = data[at + 6 : at + 10]
    return 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[at + 5] & 0x10 else 0)


def id3_texts(tag: bytes) -> dict[str, str]:
    """The text frames of an ID3v2.3 or v2.4 tag, user-defined ones by their description; what doesn't parse is left out."""
    out, at = {}, 10
    while at + 10 <= len(tag) and tag[at] and tag[3] in (3, 4):
        a, b, c, d = tag[at + 4 : at + 8]
        size = a << 21 | b << 14 | c << 7 | d if tag[3] == 4 else int.from_bytes(tag[at + 4 : at + 8], "big")
        name, body = tag[at : at + 4].decode("latin-1"), tag[at + 10 : at + 10 + size]
        if name[0] == "T" and body[:1] in (b"\x00", b"\x03"):
            text = body[1:].decode("utf-8" if body[0] == 3 else "latin-1", "replace").rstrip("\0")
            key, _, value = text.partition("\0")
            out.update({key: value} if name == "TXXX" else {name: text})
        at += 10 + size
    return out


def parse(data: bytes) -> dict:
    """What a byte string holds as MPEG audio; junk anywhere is skipped, and nothing is an error.

    Keys: texts (of tags), frames (places of audio frames), sizes, samples, rate (0 without frames), checked and broken
    (frames with a checksum, and with a wrong one), junk (bytes outside tags and frames), kbit (mean, rounded down),
    table (variable-bitrate header: frames, bytes, seek bytes; or None) and agrees (whether its counts are true).
    """
    out = {"texts": {}, "frames": [], "sizes": [], "samples": 0, "rate": 0, "checked": 0, "broken": 0, "junk": 0, "table": None, "agrees": None}
    at, end, kind, audio, synced = 0, len(data), None, 0, False
    # A tag at the end counts where a frame, a tag or junk ends, not inside a frame.
    last = end - 128 if end >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    while at < end and at != last:
        size = id3_size(data, at)
        if size:
            out["texts"].update(id3_texts(data[at : at + size]))
            at += size
            continue
        found = header(int.from_bytes(data[at : at + 4], "big")) if at + 4 <= end else None
        if found and at + found[0] <= end and (kind is None or kind == found[6]):
            after = at + found[0]
            ahead = header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else None
            # A header counts right behind a frame, or if another frame, a tag or the end follows where it says.
            if synced or after in (end, last) or ahead and ahead[6] == found[6] or data[after : after + 3] == b"ID3":
                size, samples, rate, layer, protected, side, kind = found
                tag = at + HEADER + 2 * protected + side
                table = None
                if layer == 3 and not out["frames"] and out["table"] is None:
                    table = vbr_table(data[tag:after]) or vbri_table(data[at + 36 : after])
                if table:
                    out["table"] = table
                    audio = at
                else:
                    if protected and layer != 2:
                        out["checked"] += 1
                        guarded = data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]
                        out["broken"] += crc16(guarded) != int.from_bytes(data[at + 4 : at + 6], "big")
                    out["frames"].append(at)
                    out["sizes"].append(size)
                    out["samples"] += samples
                    out["rate"] = rate
                at, synced = after, True
                continue
        step = data.find(b"\xff", at + 1, end)
        step = end if step < 0 else step
        step = last if at < last < step else step
        tag = data.find(b"ID3", at + 1, step)
        step = step if tag < 0 else tag
        out["junk"] += step - at
        at, synced = step, False
    if out["table"]:
        stop = out["frames"][-1] + out["sizes"][-1] if out["frames"] else 0
        out["agrees"] = out["table"]["frames"] == len(out["frames"]) and out["table"]["bytes"] == stop - audio
    out["kbit"] = sum(out["sizes"]) * 8 * out["rate"] // (1000 * out["samples"]) if out["samples"] else 0
    return out


def vbr_table(tag: bytes) -> dict | None:
    """frames, bytes and the 100 seek bytes of a Xing or Info header, as far as they are there."""
    if len(tag) < 8 or tag[:4] not in (b"Xing", b"Info"):
        return None
    flags, at, out = int.from_bytes(tag[4:8], "big"), 8, {"frames": None, "bytes": None, "seek": None}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit and len(tag) >= at + 4:
            out[name] = int.from_bytes(tag[at : at + 4], "big")
            at += 4
    if flags & 4 and len(tag) >= at + 100:
        out["seek"] = tag[at : at + 100]
    return out


def vbri_table(tag: bytes) -> dict | None:
    """The same of a VBRI header, which stands 32 bytes behind a frame's header; its seek entries as they are."""
    if len(tag) < 26 or tag[:4] != b"VBRI":
        return None
    size, frames, entries, _, width = struct.unpack(">IIHHH", tag[10:24])
    return {"frames": frames, "bytes": size, "seek": tag[26 : 26 + entries * width]}


def synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def store(payload: bytes, length: int) -> bytes:
    """An MPEG audio stream that holds payload; length goes into its tag."""
    frames, at = [], 0
    while at < len(payload):
        part = payload[at : at + FULL - OVERHEAD]
        index = next(i for i in range(1, 15) if 3 * BITRATES[True, 3][i] - OVERHEAD >= len(part))
        head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC4))
        side = bytes(SIDE)
        frame = head + crc16(head[2:] + side).to_bytes(2, "big") + side + part
        frames.append(frame.ljust(3 * BITRATES[True, 3][index], b"\0"))
        at += len(part)
    info = 3 * 64  # bytes of the first frame, at 64 kbit/s
    total = info + sum(map(len, frames))
    places, offset = [], info
    for f in frames:
        places.append(offset)
        offset += len(f)
    seek = bytes(min(255, 256 * places[i * len(frames) // 100] // total) for i in range(100))
    first = bytes((0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC4)) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, len(frames), total) + seek
    text = b"\x03" + LENGTH_TAG.encode() + b"\0" + f"{length},{len(payload)}".encode()
    frame = b"TXXX" + synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + synchsafe(len(frame)) + frame + first.ljust(info, b"\0") + b"".join(frames)


def read_back(media: bytes, found: dict) -> tuple[int, bytes]:
    """(unpadded length, payload) of a stream of store() and its parse; (0, b'') for other streams."""
    lengths = found["texts"].get(LENGTH_TAG, "").split(",")
    if len(lengths) != 2 or not all(x.isdigit() for x in lengths):
        return 0, b""
    payload = b"".join(media[a + OVERHEAD : a + s] for a, s in zip(found["frames"], found["sizes"], strict=True))
    return int(lengths[0]), payload[: int(lengths[1])]


def store_as_audio(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, media (binary).

    The whole text's UTF-8 bytes, with zeros up to a positive multiple of 64, are stored losslessly. Null texts count as
    empty: 64 zeros. Equal texts give equal media; ids may be null, and other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            doc, text = batch.column("doc_id"), batch.column("text")
            begin, media, held = 0, [], 0
            for i in range(batch.num_rows):
                data = text_bytes(text, i)
                media.append(store(data.ljust(max(1, -(-len(data) // MULTIPLE)) * MULTIPLE, b"\0"), len(data)))
                held += len(media[-1])
                if held > 8_000_000 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([doc.slice(begin, len(media)), pa.array(media, pa.binary())], ["doc_id", "media"])
                    begin, media, held = i + 1, [], 0

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


AUDIO = "n_bytes long, payload binary, media_bytes long, media_sha256 string, n_frames long, samples long, sample_rate long, kbit long, checked long, broken long, junk long, table_agrees boolean, seek_offsets array<long>"


def read_audio(stored: DataFrame) -> DataFrame:
    """stored(doc_id, media) parsed: doc_id and the columns of AUDIO.

    samples / sample_rate is the exact duration, seek_offsets the place of every frame. A null medium counts as empty;
    bytes that are no MPEG audio count as junk. payload and n_bytes are what store_as_audio put in, else empty and 0.
    """
    import hashlib

    def run(batches):
        for batch in batches:
            doc, media = batch.column("doc_id"), batch.column("media")
            begin, rows, held = 0, [], 0
            for i in range(batch.num_rows):
                data = text_bytes(media, i)
                x = parse(data)
                n, payload = read_back(data, x)
                rows.append((n, payload, len(data), hashlib.sha256(data).hexdigest(), len(x["frames"]), x["samples"], x["rate"], x["kbit"], x["checked"], x["broken"], x["junk"], x["agrees"], x["frames"]))
                held += len(payload)
                if held > 8_000_000 or i + 1 == batch.num_rows:
                    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), *[pa.int64()] * 7, pa.bool_(), pa.list_(pa.int64())]
                    names = [c.split(" ")[0] for c in AUDIO.split(", ")]
                    yield pa.RecordBatch.from_arrays([doc.slice(begin, len(rows)), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", *names])
                    begin, rows, held = i + 1, [], 0

    return arrow_map(stored.select("doc_id", "media"), run, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {AUDIO}")


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    out = read_audio(store_as_audio(table(spark, sf_dir, "documents")))
    last = F.expr("substring(payload, -64, 64)")
    feature = F.concat_ws(";", F.format_string("frames=%d", "n_frames"), F.format_string("samples=%d/%d", "samples", "sample_rate"), F.format_string("kbit=%d", "kbit"), F.format_string("crc=%d/%d", F.col("checked") - F.col("broken"), F.col("checked")), F.format_string("junk=%d", "junk"), F.concat(F.lit("table="), F.col("table_agrees").cast("string")), F.concat(F.lit("seek="), F.hex(F.xxhash64("seek_offsets"))))
    return out.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(last).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))
