"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, read by memory map.

A part is two files. ``part-NNNNN.bin`` holds the ids of its documents one after another, as little-endian unsigned
16-bit or 32-bit integers. ``part-NNNNN.idx`` holds a header (HEADER), then the documents' offsets in ids as n + 1
unsigned 64-bit integers, then their ids (doc_id) as n signed 64-bit integers and one byte each that is 0 where the id
is null. Documents are dealt by ranges of doc_id and sorted, so parts in order hold all documents in ascending order,
nulls first. The number of ids before a part (its base) is the prefix sum over the parts before it; a document's start
in the whole corpus is its part's base and its offset.

A task writes under a name of its own and renames when done, so a repeated task leaves the same files. ``index`` needs no
read of the ids: it is the table of parts with their bases.

The strings of the tokenizer's added tokens are cut out of a text first and give those tokens' ids, as the library does it;
``special_as_text`` takes those of special tokens for ordinary text instead.

Defined results: a null or empty text has only the end id; an empty table gives no parts; documents of the same doc_id follow
each other in the order of their texts' hashes, so equal rows (the only ties) lie side by side; columns beside id and text are
not read, whatever their names. Long texts are encoded piece by piece.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.unit_cache import LONGEST, by_size
from glyphloom.storage import qualified

MAGIC = b"TOKIDX01"
#: Magic, bytes of an id, documents, ids.
HEADER = "<8sIQQ"
END_ID = 0
BATCH_CHARS = 1 << 21
READ_BYTES = 1 << 24
#: Pieces in a generation of the cache.
GENERATION = 400_000

# What the byte-level pre-tokeniser takes for white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters by any version of Unicode. A word of such letters alone stays whole in the pre-tokeniser, with the space before
#: it; marks after it that end the piece become one token of their own; so does a line feed between what is no white space.
PLAIN, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", "!-/:-@\\[-`{-~"
WORD = re.compile(f"[{PLAIN}]+")
MARKED = re.compile(f"([{PLAIN}]+)([{MARKS}]+)")
BROKEN = re.compile(f"([^{WHITE}]+)\n([^{WHITE}]+)")
#: A piece with white space at an end, or none at all: its text is then not cut before every space.
ODD = re.compile(f"[{WHITE}].*|(?:.*[{WHITE}])?", re.DOTALL)
#: Where a text may be cut in any case: before a space between two characters that are no white space.
CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
RUN_CHARS = 1 << 16


def runs(text: str) -> list[str]:
    """The text cut into runs of about RUN_CHARS characters, where no token can cross."""
    out, a = [], 0
    while len(text) - a > RUN_CHARS and (m := CUT.search(text, a + RUN_CHARS)):
        out.append(text[a : m.start()])
        a = m.start()
    return [*out, text[a:]]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: visible ones for themselves, the others in order from code point 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


LETTERS = byte_letters()


class OddPiece(Exception):
    pass


class Pieces(dict):
    """The ids, as bytes, of what stands between two spaces, with the first of them or without. A piece is encoded when
    first asked for.

    When the young generation is full it becomes the old one, from which pieces move back as they are used.
    """

    def __init__(self, encoder: ByteLevelEncoder, space: str) -> None:
        super().__init__()
        self.encoder, self.space = encoder, space
        self.letter = LETTERS[32] if space else ""
        self.old: dict[str, bytes] = {}
        self.kind = "H" if encoder.dtype == "<u2" else "I"

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            if piece.isascii() and piece.isalpha():
                found = array(self.kind, [t.id for t in self.encoder.tokenize(self.letter + piece)]).tobytes()
            elif WORD.fullmatch(piece):
                found = array(self.kind, [t.id for t in self.encoder.tokenize(self.letter + piece.encode().decode("latin-1").translate(LETTERS))]).tobytes()
            elif m := MARKED.fullmatch(piece):
                found = self[m[1]] + self.encoder.marks(m[2])
            elif m := BROKEN.fullmatch(piece):
                found = self[m[1]] + self.encoder.marks("\n") + self.encoder.bare[m[2]]
            elif ODD.fullmatch(piece):
                raise OddPiece
            else:
                found = self.encoder.encode_whole(self.space + piece)
        if len(piece) <= LONGEST:
            self[piece] = found
        return found

    def turn(self) -> None:
        if len(self) > GENERATION:
            self.old = dict(self)
            self.clear()


class ByteLevelEncoder:
    """Encodes texts with a tokenizers file whose pre-tokeniser is byte-level, distinct pieces once."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = {k: t for k, t in self.tokenizer.get_added_tokens_decoder().items() if not (special_as_text and t.special)}
        self.added = sorted((t.content for t in added.values()), key=len, reverse=True)
        #: Tokens that take neighbouring space along, or stand only between words, are left to the library.
        self.cuts = None if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()) else re.compile(f"({'|'.join(map(re.escape, self.added))})")
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.by_pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.added_ids = {t.content: np.array([k], dtype=self.dtype).tobytes() for k, t in added.items()}
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces, self.bare = Pieces(self, " "), Pieces(self, "")
        self.marks = lru_cache(maxsize=1 << 14)(self.encode_whole)

    def encode_whole(self, text: str) -> bytes:
        """The ids of a text in one call of the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as bytes of ``dtype``."""
        return [self.encode_one(t) for t in texts]

    def encode_one(self, text: str) -> bytes:
        if not self.by_pieces:
            return self.encode_whole(text)
        if any(map(text.__contains__, self.added)):
            if self.cuts is None:
                return self.encode_whole(text)
            return b"".join(self.added_ids[part] if part in self.added_ids else self.encode_plain(part) for part in self.cuts.split(text))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        first, *pieces = text.split(" ")
        try:
            out = b"".join((self.bare[first] if text else b"", *map(self.pieces.__getitem__, pieces)))
        except OddPiece:
            out = b"".join([self.encode_whole(r) for r in runs(text)])
        self.pieces.turn()
        self.bare.turn()
        return out


@lru_cache(maxsize=4)
def encoder(path: str, threads: int = 1, special_as_text: bool = False) -> ByteLevelEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    return ByteLevelEncoder(path, special_as_text)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a qualified URI; one without a scheme is completed on the driver (``storage.qualified``)."""
    return fs.FileSystem.from_uri(uri)


PARTS = "part int, name string, n_docs bigint, n_ids bigint"


def _writer(out: str, path: str, end_id: int, threads: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, threads, special_as_text)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = _open(out)
        name = f"part-{part:05d}"
        ids: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        lengths: list[int] = []
        sink = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sink = sink or store.open_output_stream(f"{root}/.{name}-{attempt}.bin")
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            nulls.append(batch.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
            for texts in by_size((t.as_py() or "" for t in batch.column(1)), BATCH_CHARS):
                for made in enc.encode(texts):
                    sink.write(made)
                    sink.write(end)
                    lengths.append((len(made) + len(end)) // len(end))
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype="<u8")]).astype("<u8")
        with store.open_output_stream(f"{root}/.{name}-{attempt}.idx") as f:
            f.write(struct.pack(HEADER, MAGIC, len(end), len(lengths), int(offsets[-1])))
            f.write(offsets.tobytes())
            f.write(np.concatenate(ids).tobytes())
            f.write(np.concatenate(nulls).tobytes())
        for kind in ("bin", "idx"):
            store.move(f"{root}/.{name}-{attempt}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([len(lengths)], pa.int64()), "n_ids": pa.array([int(offsets[-1])], pa.int64())})

    return run


def write(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, threads: int = 1, special_as_text: bool = False) -> DataFrame:
    """Writes the files of all documents to the folder ``out`` (a URI that all machines reach) and returns their index.

    The index has a row for each part: its number, name, documents, ids, and ``base``, the ids of all parts before it.
    """
    spark = docs.sparkSession
    out = qualified(spark, out)
    store, root = _open(out)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = sorted((r["part"], r["name"], r["n_docs"], r["n_ids"]) for r in dealt.mapInArrow(_writer(out, path, end_id, threads, special_as_text), PARTS).collect())
    base, table = 0, []
    for part in parts:
        table.append((*part, base))
        base += part[3]
    return spark.createDataFrame(table, PARTS + ", base bigint")


class Range:
    """Ids in a store that gives no memory map: slices read from the file, through a buffer of the next READ_BYTES."""

    def __init__(self, file: pa.NativeFile, kind: str, total: int) -> None:
        self.file, self.kind, self.total = file, np.dtype(kind), total
        self.at, self.held = 0, np.empty(0, dtype=kind)

    def __len__(self) -> int:
        return self.total

    def __getitem__(self, where: slice) -> np.ndarray:
        a, b = where.start, where.stop
        if a < self.at or b > self.at + len(self.held):
            n = min(self.total - a, max(b - a, READ_BYTES // self.kind.itemsize))
            self.file.seek(a * self.kind.itemsize)
            self.at, self.held = a, np.frombuffer(self.file.read(n * self.kind.itemsize), dtype=self.kind)
        return self.held[a - self.at : b - self.at]


class Part:
    """One part, memory-mapped where its files are local, else read by ranges."""

    def __init__(self, out: str, name: str) -> None:
        store, root = _open(out)
        with store.open_input_file(f"{root}/{name}.idx") as f:
            magic, width, n, total = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
            if magic != MAGIC:
                raise ValueError(f"{name}.idx is no index of token ids")
            self.offsets = np.frombuffer(f.read(8 * (n + 1)), dtype="<u8").astype(np.int64)
            self.doc_ids = np.frombuffer(f.read(8 * n), dtype="<i8")
            self.has_id = np.frombuffer(f.read(n), dtype=np.uint8).astype(bool)
        kind = {2: "<u2", 4: "<u4"}[width]
        if store.get_file_info(f"{root}/{name}.bin").size != width * total:
            raise ValueError(f"{name}.bin doesn't have the ids that its index counts")
        self.ids: np.ndarray | Range = np.empty(0, dtype=kind)
        if total and isinstance(store, fs.LocalFileSystem):
            self.ids = np.memmap(f"{root}/{name}.bin", dtype=kind, mode="r", shape=(total,))
        elif total:
            self.ids = Range(store.open_input_file(f"{root}/{name}.bin"), kind, total)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, k: int) -> np.ndarray:
        return self.ids[int(self.offsets[k]) : int(self.offsets[k + 1])]

    def runs(self, docs: int = 20_000, ids: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """First and last document (exclusive) of runs of at most so many documents, and of about so many ids."""
        a = 0
        while a < len(self):
            b = int(np.searchsorted(self.offsets, self.offsets[a] + ids, side="right")) - 1
            b = min(len(self), a + docs, max(a + 1, b))
            yield a, b
            a = b


def _reader(out: str, columns):
    """Batches of doc_id, start and what ``columns`` makes of a part and the first and last document of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                p = Part(out, name)
                for a, b in p.runs():
                    own = {"doc_id": pa.array(p.doc_ids[a:b], mask=~p.has_id[a:b]), "start": pa.array(p.offsets[a:b] + base)}
                    yield pa.RecordBatch.from_pydict(own | columns(p, a, b))

    return run


def _read(index: DataFrame, out: str, columns, schema: str) -> DataFrame:
    """One task for each part: each has as many documents as one that wrote."""
    named = index.select("part", "name", "base")
    return named.repartitionByRange(max(1, index.count()), "part").mapInArrow(_reader(qualified(index.sparkSession, out), columns), "doc_id bigint, start bigint, " + schema)


def read_digests(index: DataFrame, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the crc32 of its ids as unsigned 32-bit integers."""

    def columns(p: Part, a: int, b: int) -> dict[str, pa.Array]:
        crcs = [zlib.crc32(p.document(k).astype("<u4").tobytes()) for k in range(a, b)]
        return {"n_tokens": pa.array(p.offsets[a + 1 : b + 1] - p.offsets[a:b]), "ids_crc32": pa.array(crcs, pa.int64())}

    return _read(index, out, columns, "n_tokens bigint, ids_crc32 bigint")


def read_ids(index: DataFrame, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start and the ids themselves."""

    def columns(p: Part, a: int, b: int) -> dict[str, pa.Array]:
        flat = pa.array(p.ids[int(p.offsets[a]) : int(p.offsets[b])].astype(np.int64))
        return {"ids": pa.ListArray.from_arrays(pa.array(p.offsets[a : b + 1] - p.offsets[a], pa.int32()), flat)}

    return _read(index, out, columns, "ids array<bigint>")
