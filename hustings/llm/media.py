"""Media columns: ISO media containers, indexed by their boxes and sample tables without decoding what they hold."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices

#: A frame is 24 x 24 grey pixels of 8 bits.
SIDE = 24
FRAME = SIDE * SIDE
TIMESCALE, KEY_EVERY, PER_CHUNK = 25, 12, 16
#: Boxes that hold boxes, and how many bytes of their own come first.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"mvex": 0, b"moof": 0, b"traf": 0}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write_media(payload: bytes) -> bytes:
    """A container with one track of uncompressed grey frames; ``payload`` is a positive multiple of FRAME bytes, stored as it is."""
    count = len(payload) // FRAME
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    keys = range(1, count + 1, KEY_EVERY)
    whole, rest = divmod(count, PER_CHUNK)
    runs = [(1, PER_CHUNK, 1)] * (whole > 0) + [(whole + 1, rest, 1)] * (rest > 0)
    chunks = whole + (rest > 0)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))

    def head(first: int) -> bytes:
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, count, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", FRAME, count)),
            _full(b"stco", struct.pack(f">I{chunks}I", chunks, *[first + i * PER_CHUNK * FRAME for i in range(chunks)])),
        )
        reference = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, count, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), reference, table),
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, count), bytes(16), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3), media)
        movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, count, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2") + _box(b"moov", movie, track)

    return head(len(head(0)) + 8) + _box(b"mdat", payload)


#: Boxes nested deeper than this are not walked.
DEPTH = 32


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, first and last offset of the content of every box, outer boxes first. A box that claims more than there is ends the walk of its level."""
    open_boxes = [((), start, len(data) if end is None else end)]
    while open_boxes:
        path, start, end = open_boxes.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head or start + size > end:
            continue
        yield (*path, kind), start + head, start + size
        open_boxes.append((path, start + size, end))
        if kind in NESTED and len(path) < DEPTH:
            open_boxes.append(((*path, kind), start + head + NESTED[kind], start + size))


def _numbers(data: bytes, at: int, end: int, kind: str, per: int = 1) -> tuple[int, ...]:
    """The table of a box: a count, and so many groups of ``per`` numbers. A count that its box has no room for is an error."""
    count = struct.unpack_from(">I", data, at)[0]
    if at + 4 + count * per * struct.calcsize(">" + kind) > end:
        raise struct.error("table is longer than its box")
    return struct.unpack_from(f">{count * per}{kind}", data, at + 4)


def _read_track(data: bytes, found: dict[bytes, tuple[int, int]]) -> dict:
    """codec, timescale, duration, samples and key frames of a track's boxes; raises KeyError, IndexError or struct.error where a table is broken."""
    at = found[b"mdhd"][0]
    timescale = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    at = found[b"stsd"][0]
    codec = data[at + 12 : at + 16].decode("latin-1").strip()
    at, end = found[b"stsz"]
    same, count = struct.unpack_from(">II", data, at + 4)
    if same and same * count > len(data):
        raise struct.error("more samples than bytes")
    sizes = [same] * count if same else _numbers(data, at + 8, end, "I")
    times = _numbers(data, found[b"stts"][0] + 4, found[b"stts"][1], "I", 2)
    runs = _numbers(data, found[b"stsc"][0] + 4, found[b"stsc"][1], "I", 3)
    long = b"stco" not in found
    at, end = found[b"co64" if long else b"stco"]
    chunks = _numbers(data, at + 4, end, "Q" if long else "I")
    firsts, number, samples = [*runs[::3], len(chunks) + 1], 0, []
    for first, last, n in zip(firsts, firsts[1:], runs[1::3], strict=False):
        if not 1 <= first <= last <= len(chunks) + 1:
            raise struct.error("chunks out of order")
        for offset in chunks[first - 1 : last - 1]:
            for size in sizes[number : number + n]:
                if offset + size > len(data):
                    raise struct.error("sample beyond the end")
                samples.append((offset, offset + size))
                offset += size
            number += n
    keys = _numbers(data, found[b"stss"][0] + 4, found[b"stss"][1], "I") if b"stss" in found else range(1, len(samples) + 1)
    keyframes = [(k, *samples[k - 1]) for k in keys if 0 < k <= len(samples)]
    return {"codec": codec, "timescale": timescale, "duration": sum(n * step for n, step in zip(times[::2], times[1::2], strict=True)), "samples": samples, "keyframes": keyframes}


def _read_runs(data: bytes, start: int, boxes_of: list[tuple[bytes, int, int]], track: int, defaults: tuple[int, int, int]) -> list[tuple[int, int, int, bool]]:
    """(offset, size, duration, key) of a fragment's samples of a track; ``start`` is where the fragment begins, ``boxes_of`` what it holds, in order."""
    out: list[tuple[int, int, int, bool]] = []
    mine, base, next_ = False, start, start
    for kind, at, end in boxes_of:
        if kind == b"tfhd":
            flags, number = struct.unpack_from(">II", data, at)
            mine, at, base, own = number == track, at + 8, start, list(defaults)
            for bit, what in ((0x1, "base"), (0x2, ""), (0x8, 0), (0x10, 1), (0x20, 2)):
                if flags & bit:
                    value = struct.unpack_from(">Q" if what == "base" else ">I", data, at)[0]
                    at += 8 if what == "base" else 4
                    base = value if what == "base" else base
                    if isinstance(what, int):
                        own[what] = value
            next_ = base
        elif kind == b"trun" and mine:
            flags, count = struct.unpack_from(">II", data, at)
            at += 8
            offset, first = next_, None
            if flags & 0x1:
                offset, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            if flags & 0x4:
                first, at = struct.unpack_from(">I", data, at)[0], at + 4
            parts = [i for i, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & bit]
            if at + 4 * len(parts) * count > end or count > len(data):
                raise struct.error("run is longer than its box")
            for n in range(count):
                values = [*own, 0]
                for k, i in enumerate(parts):
                    values[i] = struct.unpack_from(">I", data, at + 4 * (n * len(parts) + k))[0]
                if n == 0 and first is not None:
                    values[2] = first
                if offset < 0 or offset + values[1] > len(data):
                    raise struct.error("sample beyond the end")
                out.append((offset, values[1], values[0], not values[2] & 0x10000))
                offset += values[1]
            next_ = offset
    return out


def read_index(data: bytes) -> dict:
    """codec, timescale, duration and the byte ranges of all samples and of the key frames of the first track that has samples.

    Decodes the sample tables (sizes, chunks, offsets of 32 or 64 bits, times, sync samples; no sync table means that all are key frames), and the
    runs of movie fragments, which follow the tables' samples. Each track is read from its own boxes; one that lacks a table, or whose tables point
    outside of the bytes, is passed over. Bytes that are no container, or have no such track, give an index without samples. No table is taken
    to be longer than the box that holds it, so broken counts cost nothing.

    Boxes nested deeper than DEPTH levels are not walked.
    """
    tracks: list[dict[bytes, tuple[int, int]]] = []
    fragments: list[tuple[int, list[tuple[bytes, int, int]]]] = []
    extends: dict[int, tuple[int, int, int]] = {}
    for path, start, end in boxes(data):
        if path[-1] == b"trak":
            tracks.append({})
        elif path[-1] == b"moof":
            fragments.append((start - (8 if data[start - 4 : start] == b"moof" else 16), []))
        elif path[-1] == b"trex" and start + 24 <= end:
            number, _, *defaults = struct.unpack_from(">5I", data, start + 4)
            extends[number] = tuple(defaults)
        elif tracks and b"trak" in path:
            tracks[-1].setdefault(path[-1], (start, end))
        elif fragments and path[:2] == (b"moof", b"traf"):
            fragments[-1][1].append((path[-1], start, end))
    for track in tracks:
        try:
            index = _read_track(data, track)
            if fragments:
                at = track[b"tkhd"][0]
                number = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
                for begin, inside in fragments:
                    for offset, size, duration, key in _read_runs(data, begin, inside, number, extends.get(number, (0, 0, 0))):
                        index["samples"].append((offset, offset + size))
                        index["duration"] += duration
                        if key:
                            index["keyframes"].append((len(index["samples"]), offset, offset + size))
            if index["samples"]:
                return index
        except (KeyError, IndexError, struct.error):
            continue
    return {"codec": None, "timescale": 0, "duration": 0, "samples": [], "keyframes": []}


def _mapped(df: DataFrame, taken: str, more: list[pa.Field], kinds: str, f) -> DataFrame:
    """``df`` with new columns that ``f`` makes of each value of ``taken``; columns of those names are replaced."""
    kept = [c for c in df.columns if c not in [m.name for m in more]]
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept], kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, kept.index(taken)):
            made = list(zip(*[f(x) for x in batch.column(kept.index(taken)).to_pylist()], strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, m.type) for v, m in zip(made, more, strict=True)]], names=[*kept, *[m.name for m in more]])

    return df.select(*kept).mapInArrow(run, schema)


def padded(text: str | None) -> bytes:
    """UTF-8 and bytes 255 up to a positive multiple of FRAME."""
    data = (text or "").encode()
    return data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``media``: each text as a container. Null is stored as empty; equal texts give equal bytes. No shuffle.

    An empty table gives an empty one; columns with the names of results are replaced, others pass through.
    """
    return _mapped(docs, text, [pa.field("media", pa.binary())], "media binary", lambda t: (write_media(padded(t)),))


def index_media(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``codec``, ``timescale``, ``duration``, ``n_samples`` and ``keyframes`` (sample, first byte, byte after the last) of each container.

    Only boxes and tables are read. Null, empty or broken containers give a null codec or no samples, never an error. No shuffle.

    An empty table gives an empty one; columns with the names of results are replaced, others pass through.
    """
    key = pa.list_(pa.struct([("sample", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    more = [pa.field("codec", pa.string()), pa.field("timescale", pa.int64()), pa.field("duration", pa.int64()), pa.field("n_samples", pa.int64()), pa.field("keyframes", key)]

    def read(data: bytes | None) -> tuple:
        x = read_index(data or b"")
        return x["codec"], x["timescale"], x["duration"], len(x["samples"]), [dict(zip(("sample", "start", "end"), k, strict=True)) for k in x["keyframes"]]

    return _mapped(df, media, more, "codec string, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<sample:bigint,start:bigint,end:bigint>>", read)


def _read_back(data: bytes) -> tuple:
    payload = b"".join(data[a:b] for a, b in read_index(data)["samples"])
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest()


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as containers, indexed, and read back from the stored bytes."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    media = store_texts(docs.withColumn("n_bytes", F.octet_length("text").cast("long"))).drop("text")
    more = [pa.field("payload_bytes", pa.int64()), pa.field("payload_sha256", pa.string()), pa.field("tail_crc32", pa.int64()), pa.field("media_bytes", pa.int64()), pa.field("media_sha256", pa.string())]
    back = _mapped(index_media(media), "media", more, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string", _read_back)
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string"))), ",")
    feature = F.concat_ws(";", F.col("codec"), F.concat("duration", F.lit("/"), "timescale"), F.concat(F.lit("samples="), "n_samples"), F.concat(F.lit("keyframes="), ranges))
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
