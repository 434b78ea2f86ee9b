"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protocol-buffer message. It is parsed here, field by field, and rebuilt of the library's objects: the
normaliser (character map, extra white space, dummy prefix, metaspace marker), the pieces with their unigram scores or, for a BPE
model, the merges that these scores order, byte fallback, and the decoder. Pieces that users define are cut out before the
character map, as they stand. Batches are encoded by the library in several threads. ``parity`` compares a rebuilt codec with the
SentencePiece library itself. Models whose marker follows words, or that leave spaces as they are, raise NotImplementedError.

Where no piece has the marker after another character, no token crosses the start of a run of markers. Texts are then
cut there, and each distinct unit is encoded once (see unit_cache); long texts are so encoded without one huge call.
Other models are encoded a text at a time.

Defined results: a null text is encoded as the empty one, which has no ids; a text decodes to what the model's own
normalisation leaves of it; null ids decode to null. Repeated rows get equal results; an empty table gives an empty one; columns
beside the text may have any name. Of cuts of a text that a unigram model scores equally, the library takes the first by sums of
double precision, where SentencePiece's single precision may tell them apart.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphloom.llm.common import hold, sole, strings
from glyphloom.llm.unit_cache import GENERATION, UnitCache, by_size

MARKER = "▁"
#: Kinds of pieces and models in the public protocol definition.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A noncharacter.
NO_TEXT = "\U0010fffe"
BATCH_CHARS = 1 << 21


def fields(data: bytes):
    """Number and value of each field of a message: varints as int, fixed fields as bytes, the rest as bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What the file says of the model. Numbers of fields follow the public protocol definition."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    whitespace_suffix: bool = False
    unk: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    drop_extra_space: bool = True
    escape_space: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.whitespace_suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk = v
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.drop_extra_space = bool(v)
                elif n == 5:
                    m.escape_space = bool(v)
    unknown = [k for k, p in enumerate(m.pieces) if p[2] == UNKNOWN]
    m.unk = unknown[0] if unknown else m.unk
    if m.kind not in (UNIGRAM, BPE) or m.whitespace_suffix or not m.escape_space:
        raise NotImplementedError("only unigram and BPE models with a leading marker are rebuilt")
    if m.kind == BPE and any(kind == UNUSED for _, _, kind in m.pieces):
        raise NotImplementedError("a BPE model with unused pieces")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """All ways of making a piece from two, best piece first; within a piece by the places of its halves."""
    place = {p: k for k, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, score, kind in m.pieces:
        if kind == NORMAL and len(piece) > 1:
            halves = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in place and piece[k:] in place]
            found += [(-score, place[piece], place[a], place[b], a, b) for a, b in halves]
    return [x[4:] for x in sorted(found)]


def crosses(m: Model) -> bool:
    """Whether some piece has the marker after another character, so that a token may cross the start of a word."""
    return any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))


def build(m: Model):
    """The tokenizers library's object for normalised text, with the decoder.

    A unigram model there takes every piece for text: those that are none get names that no text has, and unknown
    characters are turned into bytes by the codec.
    """
    from tokenizers import Tokenizer, decoders, models

    if m.kind == UNIGRAM:
        best = max((s for _, s, kind in m.pieces), default=0.0)
        scores = [s if kind != USER_DEFINED else len(p.encode()) * best - 0.1 for p, s, kind in m.pieces]
        names = [p if kind in (NORMAL, USER_DEFINED) else NO_TEXT + p for p, _, kind in m.pieces]
        model = models.Unigram(list(zip(names, scores, strict=True)), unk_id=m.unk, byte_fallback=False)
    else:
        vocab = {p: k for k, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, merges(m), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = [decoders.ByteFallback()] if m.byte_fallback else []
    t.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), *steps, decoders.Fuse()])
    return t


def marking(m: Model):
    """The library's normaliser for what follows the character map: extra spaces, the dummy prefix, the marker."""
    from tokenizers import Regex, normalizers

    extra = [normalizers.Replace(Regex(r"\A +"), ""), normalizers.Replace(Regex(" {2,}"), " ")] if m.drop_extra_space else []
    dummy = [normalizers.Prepend(MARKER)] if m.dummy_prefix else []
    ending = [normalizers.Replace(Regex(MARKER + r"+\z"), "")] if m.drop_extra_space else []
    return normalizers.Sequence([*extra, *dummy, normalizers.Replace(" ", MARKER), *ending])


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, data: bytes, generation: int = GENERATION) -> None:
        self.model = parse(data)
        self.tokenizer = build(self.model)
        self.marking = marking(self.model)
        self.by_units = not crosses(self.model)
        self.dtype = "<u2" if len(self.model.pieces) <= 1 << 16 else "<u4"
        self.cache = UnitCache(self._encode_batch, self.dtype, generation)
        self.reference = None
        #: Units whose ids differ from the reference's; empty as long as there is none.
        self.differing: set[str] = set()
        self.bytes_of = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE} if self.model.byte_fallback else {}
        #: What the decoder gets for each id.
        self.names = [" ⁇ " if kind == UNKNOWN else p for p, _, kind in self.model.pieces]
        self.silent = {k for k, (_, _, kind) in enumerate(self.model.pieces) if kind == CONTROL}
        #: Pieces that users define, the longest first, and what finds them.
        self.defined = {p: k for k, (p, _, kind) in enumerate(self.model.pieces) if kind == USER_DEFINED}
        if any(MARKER in p or " " in p for p in self.defined):
            raise NotImplementedError("pieces defined by users that have spaces")
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.defined, key=len, reverse=True))) + ")") if self.defined else None
        self._map = None
        if self.model.charsmap:
            from tokenizers import normalizers

            self._map = normalizers.Precompiled(self.model.charsmap)

    def _encode_normal(self, texts: list[str]) -> list[list[int]]:
        """Ids of normalised texts; in a BPE model, what users define is cut out of them."""
        if self.model.kind == UNIGRAM:
            found = (self.tokenizer.encode_batch if self.bytes_of else self.tokenizer.encode_batch_fast)(texts, add_special_tokens=False)
            return [self._with_bytes(e) if self.bytes_of and self.model.unk in e.ids else e.ids for e in found]
        if self.cuts is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self.cuts.split(t) for t in texts]
        plain = [p for x in parts for p in x[::2]]
        ids = iter([e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)])
        return [[i for k, p in enumerate(x) for i in ([self.defined[p]] if k % 2 else next(ids))] for x in parts]

    def _with_bytes(self, encoding) -> list[int]:
        """The ids with the bytes of unknown characters in place of the unknown piece."""
        pairs = zip(encoding.ids, encoding.tokens, strict=True)
        return [i for k, t in pairs for i in ([self.bytes_of[b] for b in t.encode()] if k == self.model.unk else [k])]

    def _encode_batch(self, units: list[str]) -> list[list[int]]:
        ids = self._encode_normal(units)
        if self.reference is not None:
            start = len(MARKER) if self.model.dummy_prefix else 0
            wanted = self.reference.encode([u[start:].replace(MARKER, " ") for u in units], num_threads=1)
            self.differing.update(u for u, a, b in zip(units, ids, wanted, strict=True) if a != b)
        return ids

    def verified(self, text: str | None) -> bool:
        """Whether no unit of an encoded text has differed from the reference (see ``codec``)."""
        return not self.differing or self.differing.isdisjoint(self.units(self.normalise(text or "")))

    def normalise(self, text: str) -> str:
        """The text as the model sees it: mapped, extra spaces dropped if it says so, spaces as markers."""
        if self._map is not None:
            mapped = self._map.normalize_str
            text = mapped(text) if self.cuts is None else "".join(p if k % 2 else mapped(p) for k, p in enumerate(self.cuts.split(text)))
        if self.model.drop_extra_space:
            return self.marking.normalize_str(text)
        # What ``marking`` does where no space goes; a tenth of the encoding's time is saved.
        return (MARKER if self.model.dummy_prefix and text else "") + text.replace(" ", MARKER)

    def units(self, normal: str) -> list[str]:
        """The normalised text cut before each run of markers."""
        if MARKER * 2 in normal:
            return re.findall(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+", normal)
        parts = normal.split(MARKER)
        head = [parts[0]] if parts[0] else []
        return head + [MARKER + p for p in parts[1:]]

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for run in by_size((t or "" for t in texts), BATCH_CHARS):
            normal = [self.normalise(t) for t in run]
            if self.by_units:
                out += [np.frombuffer(b, dtype=self.dtype) for b in self.cache.ids([self.units(t) for t in normal])]
            else:
                out += [np.array(x, dtype=self.dtype) for x in self._encode_batch(normal)]
        return out

    @cached_property
    def adds(self) -> list[bytes]:
        """What each piece adds to a decoded text: by the library's decoder, once for each, or the byte that it stands for."""
        of = self.tokenizer.decoder.decode
        byte = {k: bytes([b]) for b, k in self.bytes_of.items()}
        return [byte[k] if k in byte else b"" if k in self.silent else of([name]).encode() for k, name in enumerate(self.names)]

    def decode(self, ids) -> str:
        """The text of the ids, without the marker that stands for the dummy prefix.

        Models that drop extra spaces take one marker from each piece before the text begins. Where bytes are no UTF-8, the
        library's decoder gets all pieces of the text.
        """
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        taken = 0
        if self.model.dummy_prefix or self.model.drop_extra_space:
            for k in ids:
                if k in self.silent:
                    continue
                name = self.names[k]
                taken += name.startswith(MARKER)
                if name != MARKER or not self.model.drop_extra_space:
                    break
        try:
            text = b"".join(map(self.adds.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = self.tokenizer.decoder.decode([self.names[k] for k in ids if k not in self.silent])
        return text[taken:]


@lru_cache(maxsize=4)
def codec(path: str, threads: int = 2, verify: bool = False, generation: int = GENERATION) -> Codec:
    """The codec of a model file that every machine has at ``path``.

    With ``verify``, whatever the codec encodes (each distinct unit once) is also encoded by the SentencePiece library
    and compared. No token crosses the start of a unit, so parity of the units is parity of the texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    with open(path, "rb") as f:
        found = Codec(f.read(), generation)
    hold("sentencepiece", codec.cache_clear)
    if verify:
        import sentencepiece

        found.reference = sentencepiece.SentencePieceProcessor(model_file=path)
    return found


def parity(path: str, texts: list[str]) -> list[int]:
    """Places of the texts for which the rebuilt codec's ids or decoded text differ from the SentencePiece library's."""
    import sentencepiece

    own, theirs = codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    wanted = theirs.encode(texts, num_threads=1)
    return [k for k, (a, b) in enumerate(zip(own.encode(texts), wanted, strict=True)) if a.tolist() != b or own.decode(a) != theirs.decode(b)]


def encoded(text: Column, path: str, threads: int = 2) -> Column:
    """An array of ids of a text column."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        sole("sentencepiece")
        c = codec(path, threads)
        ids = c.encode(strings(column))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return run(text)


def decoded(ids: Column, path: str, threads: int = 2) -> Column:
    """The text of a column of ids; null ids give null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        c = codec(path, threads)
        return pa.array([None if (x := i.as_py()) is None else c.decode(x) for i in column], pa.string())

    return run(ids)
