"""SentencePiece models encoded and decoded through the tokenizers library.

The model protobuf is parsed field by field and its normaliser, metaspace marker, scores and byte
fallback are rebuilt: unigram models keep their scores, BPE models get their merges in score order.
Decoding is a gather of piece bytes. Each text may be held against the sentencepiece library.

Defined cases: a null text counts as empty; repeated rows and null ids keep their rows; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import crc32_ids, map_arrow
from sparkloom.llm.units import UnitEncoder, gathered

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_MARK = "<|sparkloom-unit|>"


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """What a SentencePiece model file says, with the library's defaults for unset fields."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def load(cls, path: str) -> PieceModel:
        out = cls()
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                own = dict(_fields(value))
                out.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                out.kind, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                out.charsmap = own.get(2, b"")
                out.add_dummy_prefix, out.remove_extra_whitespaces, out.escape_whitespaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
        return out

    @property
    def unknown(self) -> int:
        return next(k for k, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best scores first, as BPE applies them."""
    score = {piece: s for piece, s, kind in model.pieces if kind in (NORMAL, USER)}
    order = {piece: k for k, (piece, _, _) in enumerate(model.pieces)}
    found = []
    for piece, s in score.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in score and right in score:
                found.append((-s, order[piece], order[left], order[right], left, right))
    return [x[-2:] for x in sorted(found)]


def build(model: PieceModel, whole: bool):
    """A tokenizers Tokenizer. whole: it also prefixes texts, else its input has been prefixed."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.kind == BPE:
        core = models.BPE({p: k for k, (p, _, _) in enumerate(model.pieces)}, merges_of(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if whole and model.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", SPACE))
    out.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    users = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER]
    if users:
        out.add_tokens(users)
    if not whole:
        out.add_special_tokens([AddedToken(_MARK, normalized=False)])
    return out


class PieceCodec:
    """Encode texts to ids and decode ids to texts as the model's own library does."""

    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = model = PieceModel.load(path)
        # words can be encoded apart where no piece reaches into a word from the one before it
        self.by_word = not model.charsmap and not model.remove_extra_whitespaces and model.add_dummy_prefix and all(kind != USER and not (p.lstrip(SPACE).count(SPACE)) for p, _, kind in model.pieces) and model.kind == BPE
        self.tokenizer = build(model, whole=not self.by_word)
        self.units = UnitEncoder(path, tokenizer=self.tokenizer) if self.by_word else None
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in model.pieces]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.units:
            return self.units.encode([" " + x if x else x for x in texts])
        ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; bytes that are no UTF-8 stay as they are."""
        width = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(width)])
        data = self.bytes[np.arange(ends[-1]) + np.repeat(self.begins[ids] - ends[:-1], width)].tobytes()
        last = np.cumsum(sizes)
        cuts = zip(ends[last - sizes].tolist(), ends[last].tolist(), strict=True)
        lead = self.model.add_dummy_prefix
        return [data[a + 1 : b] if lead and data[a : a + 1] == b" " and b > a else data[a:b] for a, b in cuts]


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


ENCODED = "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean"


def encode_documents(docs: DataFrame, model_path: str, verify: bool = True) -> DataFrame:
    """Per row: sizes, crc32 of the ids, sha256 of the decoded text, whether it equals the text, and with
    ``verify`` whether the sentencepiece library gives the same ids (else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, other = codec(model_path), None
        if verify:
            import sentencepiece

            other = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for names, texts in gathered(batches):
            ids, sizes = coder.encode(texts)
            decoded = coder.decode(ids, sizes)
            ends = np.cumsum(sizes).tolist()
            parts = [ids[e - s : e] for s, e in zip(sizes.tolist(), ends, strict=True)]
            raw = [x.encode() for x in texts]
            same = [x.tolist() == y for x, y in zip(parts, other.encode(texts, num_threads=1), strict=True)] if other else [None] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array(sizes, pa.int64()), pa.array([crc32_ids(x) for x in parts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded]), pa.array([x == y for x, y in zip(raw, decoded, strict=True)]), pa.array(same, pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ENCODED)
