"""SentencePiece models run by the tokenizers library: encoding, decoding and their parity."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from lithograph.llm.common import slices, table, texts

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

# --- the model file: fields of sentencepiece_model.proto, by number ------------------------------


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


class Model(NamedTuple):
    pieces: list[Piece]
    model_type: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool
    escape_whitespaces: bool


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; 32- and 64-bit values as bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(raw, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                if wire != 2:
                    raise ValueError(f"wire type {wire} in a model file")
                size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        yield number, value


def parse_model(raw: bytes) -> Model:
    """Pieces, scores and settings of a serialised SentencePiece model."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(Piece(own.get(1, b"").decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    return Model(
        pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0),
        normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)),
    )


# --- the same model in the tokenizers library ----------------------------------------------------


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score of the whole first, as a BPE model merges them."""
    usable = {p.text: i for i, p in enumerate(model.pieces) if p.kind in (NORMAL, USER_DEFINED)}
    found = []
    for p in model.pieces:
        if p.kind in (NORMAL, USER_DEFINED):
            pairs = [(p.text[:i], p.text[i:]) for i in range(1, len(p.text)) if p.text[:i] in usable and p.text[i:] in usable]
            pairs.sort(key=lambda x: (usable[x[0]], usable[x[1]]))
            found += [(p.score, x) for x in pairs]
    found.sort(key=lambda x: -x[0])  # stable
    return [x for _, x in found]


def build(model: Model):
    """A tokenizers.Tokenizer of the model: its normaliser and marker, its pieces and scores, its decoder."""
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p.text, p.score) for p in model.pieces], model.unk_id, model.byte_fallback)
    elif model.model_type == BPE:
        vocabulary = {p.text: i for i, p in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges_of(model), unk_token=model.pieces[model.unk_id].text, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type}: neither unigram nor BPE")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if model.escape_whitespaces else " "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARKER))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse()])  # spaces: see Codec.spaced
    return out


_UNIT = re.compile(f"{MARKER}({MARKER}*[^{MARKER}]*)")
UNITS_A_ROW = 64  #: units that the library encodes as one text
UNIT_CHARS, UNITS = 64, 1 << 19  #: longer units are not remembered; units of a generation of a worker's memory


def cuts_at_markers(model: Model) -> bool:
    """Whether no BPE piece goes on with a marker after another character, so that texts may be encoded in units.

    A unit is a run of markers and what follows up to the next marker; it is named by what follows its first. Merges then never cross the bounds of units,
    and as the marker is a piece itself, neither do unknown characters nor bytes. Sums of unigram scores are rounded
    along the whole text, so unigram models encode whole texts.
    """
    own = [p.text for p in model.pieces if p.kind in (NORMAL, USER_DEFINED)]
    return model.model_type == BPE and MARKER in own and not any(re.search(f"[^{MARKER}]{MARKER}", t) for t in own)


class Codec:
    """Encodes and decodes batches of texts; threads: those of the tokenizers library, in each task.

    Where the model allows it, each distinct unit of a batch is encoded and decoded once, by the library, and units
    seen lately are remembered in two generations of bounded size.
    """

    def __init__(self, raw: bytes, threads: int = 1):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true" if threads > 1 else "false"
        self.model = parse_model(raw)
        self.tokenizer = build(self.model)
        self.normalizer, self.decoder = self.tokenizer.normalizer, self.tokenizer.decoder
        self.tokenizer.normalizer = normalizers.Sequence([])  # texts are normalised once, before
        self.bytes = np.array([p.kind == BYTE for p in self.model.pieces])
        self.by_unit = cuts_at_markers(self.model)
        texts = [p.text if p.kind in (NORMAL, USER_DEFINED) else "" for p in self.model.pieces]
        self.begins, self.blank = (np.array([bool(t) and f(t) for t in texts]) for f in (lambda t: t[0] == MARKER, lambda t: not t.strip(MARKER)))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # decodings of units that differ from the unit

    def normalised(self, text: str) -> str:
        return self.normalizer.normalize_str(text)

    def _whole(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian uint32, and their decoding, of normalised texts."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [array("I", i).tobytes() for i in ids], self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units. They are encoded in rows of many, which are cut where a piece begins with a marker after one that is not blank."""
        alone = [u for u in units if not u or u[-1] == MARKER]
        rest = [u for u in units if u and u[-1] != MARKER]
        rows = [rest[i : i + UNITS_A_ROW] for i in range(0, len(rest), UNITS_A_ROW)]
        spelled = [MARKER + u for u in alone] + [MARKER + MARKER.join(r) for r in rows]
        ids, decoded = self._whole(spelled)
        out = dict(zip(alone, ids))
        self.odd.update((u, d) for u, d in zip(alone, decoded) if MARKER + u != d)
        for own, found, text, back in zip(rows, ids[len(alone) :], spelled[len(alone) :], decoded[len(alone) :], strict=True):
            flat = np.frombuffer(found, "<u4")
            new = self.begins[flat]
            new[1:] &= ~self.blank[flat[:-1]]
            cuts = (4 * np.append(np.flatnonzero(new), len(flat))).tolist()
            out.update(zip(own, [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])], strict=True))
            if text != back:
                self.odd.update((u, d) for u, d in zip(own, self._whole([MARKER + u for u in own])[1]) if MARKER + u != d)
        return out

    def encode_decode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids and decoding of each of the normalised texts."""
        if not self.by_unit or any(t[:1] != MARKER for t in texts if t):
            ids, decoded = self._whole(texts)
            return ids, [self.spaced(t) for t in decoded]
        split = [_UNIT.findall(t) if MARKER * 2 in t else t[1:].split(MARKER) if t else [] for t in texts]
        if len(self.new) > UNITS:
            self.old, self.new = self.new, {}
            self.odd = {u: d for u, d in self.odd.items() if u in self.old}
        known, old, missing = self.new, self.old, []
        for u in set().union(*split).difference(known):
            if (found := old.get(u)) is None:
                missing.append(u)
            else:
                known[u] = found
        known.update(self._units(missing))
        ids = [b"".join(map(known.__getitem__, units)) for units in split]
        odd = self.odd
        if odd:
            texts = [t if odd.keys().isdisjoint(units) else "".join([odd.get(u, MARKER + u) for u in units]) for t, units in zip(texts, split, strict=True)]
        for u in missing:
            if len(u) > UNIT_CHARS:
                del known[u]
                odd.pop(u, None)
        return ids, [self.spaced(t) for t in texts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [array("I", x).tolist() for x in self.encode_decode([self.normalised(t) for t in texts])[0]]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """By the rebuilt decoder alone."""
        return [self.spaced(t) for t in self.tokenizer.decode_batch(ids, skip_special_tokens=False)]

    def spaced(self, text: str) -> str:
        """The decoder's last steps, which look at a whole text: markers to spaces, and the dummy prefix away."""
        out = text.replace(MARKER, " ") if self.model.escape_whitespaces else text
        return out[1:] if self.model.add_dummy_prefix and out.startswith(" ") else out


@lru_cache(maxsize=1)
def _codec(raw: bytes, threads: int) -> tuple:
    """The codec and the library that it must agree with, once per worker."""
    from sentencepiece import SentencePieceProcessor

    return Codec(raw, threads), SentencePieceProcessor(model_proto=raw)


THREADS = 2  #: of the libraries in each task
NAMES = ["doc_id", "n_tokens", "n_bytes", "ids", "decoded", "decoded_sha256", "ids_crc32", "parity", "round_trip"]
SCHEMA = "doc_id long, n_tokens long, n_bytes long, ids array<int>, decoded string, decoded_sha256 string, ids_crc32 long, parity boolean, round_trip boolean"


def encode_decode(docs: DataFrame, model_path: str, threads: int = THREADS, keep: bool = True) -> DataFrame:
    """Every whole text encoded and decoded again: NAMES, one row per input row.

    n_bytes counts tokens of the byte fallback; ids_crc32 is that of the ids as little-endian unsigned 32-bit
    integers; parity says that the sentencepiece library, which encodes and decodes every whole text, gives the same
    ids and the same text; round_trip that the decoded text is the normalised one, its markers as spaces and without
    the dummy prefix. keep=False leaves ids and decoded null, for callers who need the digests alone. threads: of the
    libraries in each task, which encode a batch of texts at a time.
    Null texts count as empty (no tokens, an empty text); null and repeated ids give a row each; other columns are
    ignored; an empty table gives an empty result.
    """
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, library = _codec(sent.value, threads)
        for batch in batches:
            at = 0
            for own in slices(batch.column("text").to_pylist()):
                normal = [codec.normalised(t) for t in own]
                ids, decoded = codec.encode_decode(normal)
                theirs = library.encode(own, num_threads=threads)
                again = library.decode(theirs, num_threads=threads)
                parity = [a == array("I", b).tobytes() and c == d for a, b, c, d in zip(ids, theirs, decoded, again, strict=True)]
                flat = np.frombuffer(b"".join(ids), np.int32)
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                spelled = np.concatenate(([0], np.cumsum(codec.bytes[flat])))
                rows = [
                    batch.column("doc_id").slice(at, len(own)),
                    pa.array(np.diff(ends)),
                    pa.array(np.diff(spelled[ends])),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)) if keep else pa.nulls(len(ids), pa.list_(pa.int32())),
                    pa.array(decoded, pa.string()) if keep else pa.nulls(len(ids), pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array(parity, pa.bool_()),
                    pa.array([codec.spaced(t) == d for t, d in zip(normal, decoded, strict=True)], pa.bool_()),
                ]
                at += len(own)
                yield pa.RecordBatch.from_arrays(rows, names=NAMES)

    return texts(docs).mapInArrow(run, SCHEMA)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=False)
    return encoded.drop("ids", "decoded")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict[str, str] = {}
