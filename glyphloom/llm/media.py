"""Media columns: ISO base media containers written, walked and indexed without decoding their payload.

A container is a tree of boxes: size (4 bytes), type (4 bytes), content; size 1 means that 8 bytes of size follow the
type, size 0 that the box reaches to the end of what holds it. ``mux`` stores a payload as samples of a raw track, and
``inspected`` walks the nested boxes of any such file, decodes the sample tables (durations, sizes, chunks, offsets, sync
samples) and the runs of its fragments, and gives codec, duration and the byte range of every keyframe of every track. Payload
bytes are only copied, never decoded.

Defined results: null counts as the empty payload, which is padded to one sample; equal payloads give equal bytes, so there are no
ties; a media value that is null or no container gives a feature of nulls with ``error`` set; repeated rows are stored each; an
empty table gives an empty one; whole texts are stored, one at a time in memory; columns beside the text may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import strings

#: Bytes of one stored sample, samples of one chunk, samples from keyframe to keyframe, and ticks of a second.
SAMPLE_BYTES = 192
CHUNK_SAMPLES = 8
KEYFRAME_EVERY = 16
TIMESCALE = 48_000
SAMPLE_TICKS = 192
CODEC = b"raw "

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}


class NotAContainer(ValueError):
    pass


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *content)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes) -> bytes:
    """The payload with bytes 32 up to a positive multiple of SAMPLE_BYTES."""
    return payload + b" " * (max(1, -(-len(payload) // SAMPLE_BYTES)) * SAMPLE_BYTES - len(payload))


def mux(payload: bytes) -> bytes:
    """A container whose one audio track holds the payload, whose length is a positive multiple of SAMPLE_BYTES."""
    n = len(payload) // SAMPLE_BYTES
    if not n or len(payload) % SAMPLE_BYTES:
        raise ValueError("the payload must be whole samples")
    chunks, rest = divmod(n, CHUNK_SAMPLES)
    runs = [(1, CHUNK_SAMPLES, 1)] if chunks else []
    if rest:
        runs.append((chunks + 1, rest, 1))
    n_chunks = chunks + bool(rest)
    sync = np.arange(1, n + 1, KEYFRAME_EVERY, dtype=">u4")
    ticks = n * SAMPLE_TICKS
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    long_mdat = len(payload) + 8 >= 1 << 32

    def moov(first: int) -> bytes:
        offsets = first + np.arange(n_chunks, dtype=np.uint64) * np.uint64(CHUNK_SAMPLES * SAMPLE_BYTES)
        long_offsets = long_mdat or int(offsets[-1]) >= 1 << 32
        entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, (TIMESCALE << 16) & 0xFFFFFFFF))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, SAMPLE_TICKS)),
            full_box(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            full_box(b"co64", struct.pack(">I", n_chunks), offsets.astype(">u8").tobytes())
            if long_offsets
            else full_box(b"stco", struct.pack(">I", n_chunks), offsets.astype(">u4").tobytes()),
        )
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"smhd", bytes(4)), dinf, stbl)
        mdia = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
            full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"),
            minf,
        )
        tkhd = full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (16 if long_mdat else 8)
    return b"".join((ftyp, moov(head), box(b"mdat", payload)))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, start and end of the content of each box between two places."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise NotAContainer("a box ends within its size")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise NotAContainer(f"box {kind!r} doesn't fit what holds it")
        yield kind, body, start + size
        start += size
    if start != end:
        raise NotAContainer("bytes are left after the last box")


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, start and end of every box's content, each followed by those within it."""
    todo = [((), boxes(data, 0, len(data)))]
    while todo:
        path, rest = todo[-1]
        for kind, x, y in rest:
            yield (*path, kind), x, y
            if kind in CONTAINERS:
                todo.append(((*path, kind), boxes(data, x, y)))
                break
        else:
            todo.pop()


def _table(data: memoryview, at: int, end: int, count: int, kind: str, width: int = 1) -> np.ndarray:
    item = np.dtype(kind)
    if count * width * item.itemsize > end - at:
        raise NotAContainer("a sample table is longer than its box")
    return np.frombuffer(data, dtype=item, count=count * width, offset=at).astype(np.int64).reshape(-1, width) if width > 1 else np.frombuffer(data, dtype=item, count=count, offset=at).astype(np.int64)


def sample_sizes(data: memoryview, found: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Of the plain table, or of the compact one, whose sizes have 4, 8 or 16 bits."""
    if b"stsz" in found or b"stz2" not in found:
        a, end = found[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, a + 4)
        return np.full(n, fixed, dtype=np.int64) if fixed else _table(data, a + 12, end, n, ">u4")
    a, end = found[b"stz2"]
    bits, n = struct.unpack_from(">II", data, a + 4)
    if bits == 4:
        pairs = _table(data, a + 12, end, (n + 1) // 2, ">u1")
        return np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[:n]
    if bits not in (8, 16):
        raise NotAContainer("sample sizes of an unknown width")
    return _table(data, a + 12, end, n, ">u1" if bits == 8 else ">u2")


def sample_table(data: memoryview, found: dict[bytes, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Size, byte offset and duration of every sample, and the numbers (from 0) of those that are keyframes."""
    try:
        sizes = sample_sizes(data, found)
        n = len(sizes)
        wide = b"co64" in found
        a, end = found[b"co64" if wide else b"stco"]
        starts = _table(data, a + 8, end, struct.unpack_from(">I", data, a + 4)[0], ">u8" if wide else ">u4")
        a, end = found[b"stsc"]
        runs = _table(data, a + 8, end, struct.unpack_from(">I", data, a + 4)[0], ">u4", 3)
        a, end = found[b"stts"]
        times = _table(data, a + 8, end, struct.unpack_from(">I", data, a + 4)[0], ">u4", 2)
    except KeyError as missing:
        raise NotAContainer(f"no {missing.args[0].decode('latin-1')} box") from None
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(starts))))
    if per_chunk.sum() != n or len(per_chunk) != len(starts) or times[:, 0].sum() != n:
        raise NotAContainer("the sample tables disagree")
    chunk = np.repeat(np.arange(len(starts)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = starts[chunk] + before - before[first[chunk]] if n else np.zeros(0, np.int64)
    if b"stss" in found:
        a, end = found[b"stss"]
        keys = _table(data, a + 8, end, struct.unpack_from(">I", data, a + 4)[0], ">u4") - 1
    else:
        keys = np.arange(n)
    if n and (int((offsets + sizes).max()) > len(data) or len(keys) and (keys.min() < 0 or keys.max() >= n)):
        raise NotAContainer("a sample lies outside the file")
    return {"sizes": sizes, "offsets": offsets, "ticks": np.repeat(times[:, 1], times[:, 0]), "keys": keys}


#: Flags of a fragment's header and of its runs of samples, and of a sample that is no keyframe. Fixed values of the format.
BASE_GIVEN, DESCRIPTION_GIVEN, TICKS_GIVEN, SIZE_GIVEN, FLAGS_GIVEN, BASE_IS_FRAGMENT = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
OFFSET_IN_RUN, FIRST_FLAGS_IN_RUN, TICKS_IN_RUN, SIZES_IN_RUN, FLAGS_IN_RUN, SHIFTS_IN_RUN = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_KEYFRAME = 0x10000


def run_of_samples(data: memoryview, a: int, end: int, at: int, base: int, defaults: tuple[int, int, int]) -> dict[str, np.ndarray]:
    """The samples of one run; ``at`` is where they begin unless the run says so itself."""
    flags = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF
    (n,) = struct.unpack_from(">I", data, a + 4)
    a += 8
    if flags & OFFSET_IN_RUN:
        at = base + struct.unpack_from(">i", data, a)[0]
        a += 4
    first = None
    if flags & FIRST_FLAGS_IN_RUN:
        (first,) = struct.unpack_from(">I", data, a)
        a += 4
    given = [flags & f for f in (TICKS_IN_RUN, SIZES_IN_RUN, FLAGS_IN_RUN, SHIFTS_IN_RUN)]
    width = sum(map(bool, given))
    columns = iter(_table(data, a, end, n, ">u4", width).reshape(n, width).T if width and n else np.zeros((width, n), np.int64))
    ticks, sizes, own = (next(columns) if g else np.full(n, d, np.int64) for g, d in zip(given, defaults))
    if first is not None and n and not given[2]:
        own[0] = first
    offsets = at + np.cumsum(sizes) - sizes
    if n and (offsets[0] < 0 or int((offsets + sizes).max()) > len(data)):
        raise NotAContainer("a sample lies outside the file")
    return {"sizes": sizes, "offsets": offsets, "ticks": ticks, "keys": np.flatnonzero(own & NO_KEYFRAME == 0), "end": at + int(sizes.sum())}


def fragments(data: memoryview, defaults: dict[int, tuple[int, int, int]]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Track and samples of every run of every fragment, in the order of the file."""
    for kind, x, y in boxes(data, 0, len(data)):
        if kind != b"moof":
            continue
        start = x - 8 if bytes(data[x - 4 : x]) == b"moof" else x - 16
        at = start
        for inner, a, b in boxes(data, x, y):
            if inner != b"traf":
                continue
            track, base, own = 0, at, (0, 0, 0)
            for k, c, end in boxes(data, a, b):
                if k == b"tfhd":
                    flags, track = struct.unpack_from(">II", data, c)
                    own, c = list(defaults.get(track, (0, 0, 0))), c + 8
                    if flags & BASE_GIVEN:
                        (base,) = struct.unpack_from(">Q", data, c)
                    elif flags & BASE_IS_FRAGMENT:
                        base = start
                    c += 8 * bool(flags & BASE_GIVEN) + 4 * bool(flags & DESCRIPTION_GIVEN)
                    for i, f in enumerate((TICKS_GIVEN, SIZE_GIVEN, FLAGS_GIVEN)):
                        if flags & f:
                            (own[i],) = struct.unpack_from(">I", data, c)
                            c += 4
                    at = base
                elif k == b"trun":
                    run = run_of_samples(data, c, end, at, base, tuple(own))
                    at = run.pop("end")
                    yield track, run


def tracks(media: bytes) -> list[dict]:
    """Codec, timescale, duration and samples of each track, those of fragments after those of its sample table."""
    data, out, defaults = memoryview(media), [], {}
    for path, a, b in walk(data):
        if path[-1] == b"trex":
            track, _, *own = struct.unpack_from(">5I", data, a + 4)
            defaults[track] = tuple(own)
        elif path[-1] == b"trak":
            out.append({"boxes": {}})
        elif out and b"trak" in path:
            out[-1]["boxes"].setdefault(path[-1], (a, b))
    if not out:
        raise NotAContainer("no track")
    for t in out:
        found = t["boxes"]
        try:
            a, _ = found[b"mdhd"]
            version = data[a]
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if version else ">II", data, a + (20 if version else 12))
            a, _ = found[b"stsd"]
            t["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
        except (KeyError, struct.error) as e:
            raise NotAContainer(f"a track lacks its header: {e}") from None
        t |= sample_table(data, found)
        a, _ = found.get(b"tkhd", (0, 0))
        t["id"] = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0] if a else 0
        del t["boxes"]
    runs: dict[int, list[dict]] = {}
    for track, run in fragments(data, defaults):
        runs.setdefault(track, []).append(run)
    for t in out:
        if more := runs.get(t["id"]):
            whole = [t, *more]
            before = np.cumsum([0, *(len(r["sizes"]) for r in whole[:-1])])
            t["keys"] = np.concatenate([r["keys"] + n for r, n in zip(whole, before, strict=True)])
            t |= {c: np.concatenate([r[c] for r in whole]) for c in ("sizes", "offsets", "ticks")}
            t["duration"] = max(t["duration"], int(t["ticks"].sum()))
    return out


def payload_of(media: bytes, track: dict) -> bytes:
    """The track's samples in order, joined. Samples that lie side by side are copied together."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    cut = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    firsts, lasts = np.append(0, cut), np.append(cut, len(offsets)) - 1
    return b"".join(media[int(offsets[a]) : int(offsets[b] + sizes[b])] for a, b in zip(firsts, lasts, strict=True))


def feature(track: dict) -> dict:
    """Codec, seconds, samples, keyframes and their byte ranges."""
    keys = track["keys"]
    ranges = np.stack([track["offsets"][keys], track["offsets"][keys] + track["sizes"][keys]], axis=1)
    return {
        "codec": track["codec"].strip(), "timescale": track["timescale"], "ticks": int(track["ticks"].sum()),
        "seconds": round(track["duration"] / track["timescale"], 6) if track["timescale"] else None,
        "samples": len(track["sizes"]), "keyframes": len(keys), "ranges": ranges.tolist(),
    }


STORED = "media binary, n_bytes bigint"


def stored(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``media``, the container that holds the text's UTF-8 bytes, and ``n_bytes``, their number."""

    @F.arrow_udf(STORED)
    def run(column: pa.Array) -> pa.Array:
        media, sizes = [], []
        for t in strings(column):
            raw = (t or "").encode()
            sizes.append(len(raw))
            media.append(mux(padded(raw)))
        return pa.StructArray.from_arrays([pa.array(media, pa.binary()), pa.array(sizes, pa.int64())], ["media", "n_bytes"])

    return docs.select(*keep, run(F.col(text)).alias("_m")).select(*keep, "_m.media", "_m.n_bytes")


INSPECTED = (
    "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, codec string, "
    "seconds double, samples bigint, keyframes bigint, keyframe_ranges array<array<bigint>>, "
    "tracks array<struct<codec:string,seconds:double,samples:bigint,keyframes:bigint,keyframe_ranges:array<array<bigint>>>>, error string"
)


def inspected(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "media") -> DataFrame:
    """``keep`` columns with what is found in the media column: digests of the first track's payload, its index of keyframes, and the
    same index of every track."""
    one = pa.struct([("codec", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.int64()), ("keyframe_ranges", pa.list_(pa.list_(pa.int64())))])
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.int64()), ("keyframe_ranges", pa.list_(pa.list_(pa.int64()))), ("tracks", pa.list_(one)), ("error", pa.string())]

    @F.arrow_udf(INSPECTED)
    def run(column: pa.Array) -> pa.Array:
        rows = []
        for m in column:
            data = m.as_py()
            if data is None:
                rows.append((None,) * 11 + ("null",))
                continue
            own = (len(data), hashlib.sha256(data).hexdigest())
            try:
                known = tracks(data)
                payload, found = payload_of(data, known[0]), [feature(t) for t in known]
            except (NotAContainer, struct.error) as e:
                rows.append((None, None, None, *own, None, None, None, None, None, None, str(e)))
                continue
            index = [tuple(f[c] for c in ("codec", "seconds", "samples", "keyframes", "ranges")) for f in found]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, *index[0], [dict(zip(one.names, x, strict=True)) for x in index], None))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    names = [n for n, _ in kinds]
    return media.select(*keep, run(F.col(column)).alias("_i")).select(*keep, *(f"_i.{n}" for n in names))

