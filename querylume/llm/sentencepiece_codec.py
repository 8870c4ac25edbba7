"""SentencePiece models on the tokenizers library.

The model file's protobuf is parsed here; its normaliser, metaspace marker, pieces with scores and byte fallback are
rebuilt as a tokenizers pipeline, for unigram and BPE models. All ids, and the texts that they decode to, are this
pipeline's. Batches are encoded by THREADS threads of the library; where no piece spans the start of a word, each distinct
word of a batch is encoded once, unless a text holds the marker itself.
Parity is verified for every text: the sentencepiece library encodes all that the pipeline encodes, word by word or the
whole text, and a text on which the two differ is reported. A text whose words agree agrees, as no piece spans the start
of a word; that its words' ids are put together rightly, its decoding shows, which goes over whole texts, one at a time.

Scale: one map over the documents without a shuffle, in slices of _BATCH_CHARS characters. The model path is a parameter;
its bytes (under MAX_MODEL_MB) travel with the task, and a worker rebuilds a model once.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylume.llm.common import table, tidy
from querylume.llm.word_encoder import WordEncoder, slices

MAX_MODEL_MB = 64
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of the tokenizers library in each worker, beside the worker's own.
THREADS = 2
_BATCH_CHARS = 2_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Protobuf wire format: field numbers and raw values."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value, at, shift = value | (b & 0x7F) << shift, at + 1, shift + 7
            if b < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 1:
            value, at = data[at : at + 8], at + 8
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif tag & 7 == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


class Model:
    """What a SentencePiece model file says. Field numbers are those of the public sentencepiece_model.proto."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk_id = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape, self.suffix = b"", True, True, True, False
        for field, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode("utf-8")
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                if kind == UNKNOWN:
                    self.unk_id = len(self.pieces)
                self.pieces.append((piece, score, kind))
            elif field == 2:
                for f, v in _fields(value):
                    if f == 3:
                        self.kind = v
                    elif f == 24:
                        self.suffix = bool(v)
                    elif f == 35:
                        self.byte_fallback = bool(v)
            elif field == 3:
                for f, v in _fields(value):
                    if f == 2:
                        self.charsmap = v
                    elif f in (3, 4, 5):
                        setattr(self, {3: "dummy_prefix", 4: "squeeze", 5: "escape"}[f], bool(v))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be rebuilt")


def rebuild(model: Model):
    """A tokenizers.Tokenizer that encodes as the model does, and decodes."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = model.pieces[model.unk_id][0]
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    else:
        score = {p: s for p, s, k in model.pieces if k in (NORMAL, USER_DEFINED)}
        ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        merges = [(-s, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        core = models.BPE(vocab=ids, merges=[m[3:] for m in sorted(merges)], unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if model.escape and not any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces):
        # no piece spans the start of a word, so words can be encoded one by one
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    out.add_tokens([AddedToken(p, normalized=False) for p, _, k in model.pieces if k == USER_DEFINED])
    ends = [decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " ")]  # one replacement a text, not one a piece
    out.decoder = decoders.Sequence(ends + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return out


class Codec:
    def __init__(self, data: bytes):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # else a thread, and its memory, for each core in each worker
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        model = Model(data)
        self.fast = rebuild(model)
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.words = None
        if self.fast.pre_tokenizer is not None and model.dummy_prefix and not model.charsmap and not any(k == USER_DEFINED for _, _, k in model.pieces):
            starts = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
            self.words = WordEncoder(self._whole, starts, "", False, whole=MARK, check=self.plain.encode)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], list[bool]]:
        """The rebuilt tokenizer's ids of each text, and whether they are the sentencepiece library's."""
        if self.words is None:
            part = texts.to_pylist()
            got = self._whole(part)
            return [np.asarray(x, np.int32) for x in got], [self.plain.encode(t) == x for t, x in zip(part, got)]
        ids, n, same = self.words.checked(texts)
        return np.split(ids, np.cumsum(n)[:-1]), same.tolist()

    def decode(self, ids: list[int]) -> str:
        return self.fast.decode(ids, skip_special_tokens=False)

    def run(self, texts: pa.Array) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """For each text its ids, parity of the two libraries, and whether decoding gives the text back."""
        ids, same = self.encode(texts)
        back = [self.decode(own.tolist()) == text.as_py() for text, own in zip(texts, ids)]
        return ids, same, back


@functools.lru_cache(maxsize=2)  # a worker keeps it from task to task
def codec_of(data: bytes) -> Codec:
    return Codec(data)


def _encode(data: bytes, with_ids: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in slices(texts, _BATCH_CHARS):
                ids, same, back = codec.run(texts.slice(a, b - a))
                out = {
                    "id": batch.column("id").slice(a, b - a), "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()),
                    "parity": pa.array(same, pa.bool_()), "round_trip": pa.array(back, pa.bool_()),
                }
                yield pa.RecordBatch.from_pydict(out | {"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else out)

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id_col, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), parity
    (the rebuilt tokenizer gave the sentencepiece library's ids), round_trip (decoding gave the text back), and, with
    ``with_ids``, the ids.

    A null text counts as empty and has no pieces. Other columns are ignored. An empty table gives an empty result."""
    data = open(model_path, "rb").read()
    if len(data) > MAX_MODEL_MB << 20:
        raise ValueError("the model file is larger than MAX_MODEL_MB")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_pieces long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_encode(data, with_ids), schema).withColumnRenamed("id", id_col)


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes all ``documents``: doc_id, n_pieces, ids_crc32, parity, round_trip."""
    return encode(table(spark, sf_dir, "documents"), model_file(), with_ids=False)
