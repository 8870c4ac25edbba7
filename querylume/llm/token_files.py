"""Token files by a static range asymmetric numeral system (rANS).

One frequency table, counted over all tokens of all documents, serves every block. A block holds whole documents in
ascending order. Its tokens are dealt in runs of LANE_TOKENS to lanes; each lane is a coder of its own, and CHECKPOINT
lanes are interleaved in one stream of 32-bit words. A checkpoint gives the offset of a stream and the states of its
lanes, so that any of them can be decoded alone, or all at once as wide vectors. Streams and the whole block carry
checksums.

Blocks are rows of a Parquet table: Spark's commit protocol makes their writing safe against lost executors, and any
store that Spark knows can hold them. One range exchange puts the coded documents in ascending order; each range is a part
whose blocks count their ids from its own beginning, and a small table, a row a part, says how many ids lie before it.

Block layout, little-endian: magic 'QRA1', version, table id (crc32 of the frequency table), number of documents,
of tokens and of checkpoints; per document its number of tokens; per checkpoint word offset, word count, crc32;
per lane its 64-bit state; words; crc32 of all before.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylume.llm.common import drop_frozen, freeze, shared_dir, table
from querylume.llm.word_encoder import WordEncoder, slices

END_ID = 0
SCALE_BITS = 20
LANE_TOKENS = 512
CHECKPOINT = 64
BLOCK_TOKENS = 1 << 21
MAX_VOCABULARY = 1 << 19
#: Distinct words whose ids a worker keeps.
KEPT_WORDS = 1_000_000
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHIQQI")
_MARK = struct.Struct("<QII")
MAGIC, VERSION = b"QRA1", 1


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies with the sum 2**bits, at least 1 for each counted symbol."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint64)
    if np.count_nonzero(counts) > 1 << bits:
        raise ValueError("more symbols than the scale has places")
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (1 << bits) / total).astype(np.int64)), 0)
    spare = (1 << bits) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    while spare < 0:  # many rare symbols were lifted to 1; the frequent ones give it back
        cut = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * -spare // int(freq.sum()) + 1)).clip(0)
        keep = np.cumsum(cut) <= -spare
        if not keep.any():
            cut[0], keep = min(cut[0], -spare), np.arange(len(cut)) == 0
        freq[order] -= np.where(keep, cut, 0)
        spare = (1 << bits) - int(freq.sum())
    freq[order[0]] += spare
    return freq.astype(np.uint64)


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.freq, self.bits = freq, np.uint64(bits)
        self.start = np.cumsum(freq, dtype=np.uint64) - freq
        self.wide = np.uint64(1 << bits) - freq  # x // f * 2**bits + x % f is x + x // f * (2**bits - f)
        self.table_id = zlib.crc32(freq.astype("<u8").tobytes())
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            kind = np.uint16 if len(self.freq) <= 1 << 16 else np.int32  # the smaller, the better it fits a cache
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=kind), self.freq.astype(np.int64))
        return self._symbol

    def encode(self, ids: np.ndarray, lengths: list[int]) -> bytes:
        """A block of documents; ``ids`` holds those of all in a row."""
        n = len(ids)
        lanes = -(-n // LANE_TOKENS)
        grid = np.zeros(lanes * LANE_TOKENS, np.int64)
        grid[:n] = ids
        grid = grid.reshape(lanes, LANE_TOKENS)
        size = np.full(lanes, LANE_TOKENS)
        if lanes:
            size[-1] = n - (lanes - 1) * LANE_TOKENS
        state, groups = np.full(lanes, _LOW, np.uint64), -(-lanes // CHECKPOINT)
        group = (np.arange(lanes) // CHECKPOINT).astype(np.uint16 if groups <= 1 << 16 else np.int64)  # 16 bits sort by radix
        words, owners = [], []
        for t in range(int(size.max(initial=0)) - 1, -1, -1):
            live = slice(0, lanes if t < size[-1] else lanes - 1)
            s = grid[live, t]
            f, x = self.freq[s], state[live]
            over = x >= f << (np.uint64(63) - self.bits)
            at = np.flatnonzero(over)[::-1]  # the decoder reads a step's words in lane order, so they are written backwards
            low = x[at]
            words.append(low.astype(np.uint32))
            owners.append(group[at])
            x[at] = low >> np.uint64(32)
            times = x // f
            times *= self.wide[s]
            x += times
            x += self.start[s]
        flat = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
        owner = np.concatenate(owners)[::-1] if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        flat, counts = flat[order].astype("<u4"), np.bincount(owner, minlength=groups)
        offsets = np.cumsum(counts) - counts
        out = bytearray(_HEAD.pack(MAGIC, VERSION, self.table_id, len(lengths), n, groups))
        out += np.asarray(lengths, "<u8").tobytes()
        for g in range(groups):
            part = flat[offsets[g] : offsets[g] + counts[g]]
            out += _MARK.pack(int(offsets[g]), int(counts[g]), zlib.crc32(part.tobytes()))
        out += state.astype("<u8").tobytes() + flat.tobytes()
        return bytes(out + struct.pack("<I", zlib.crc32(out)))

    def decode(self, block: bytes, only: range | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths of documents); with ``only``, the ids of these checkpoints alone."""
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("the block's checksum is wrong")
        magic, version, table_id, docs, n, groups = _HEAD.unpack_from(block)
        if (magic, version) != (MAGIC, VERSION) or table_id != self.table_id:
            raise ValueError("not a block of this format and frequency table")
        at = _HEAD.size
        lengths, at = np.frombuffer(block, "<u8", docs, at).astype(np.int64), at + 8 * docs
        marks, at = [_MARK.unpack_from(block, at + _MARK.size * g) for g in range(groups)], at + _MARK.size * groups
        lanes = -(-n // LANE_TOKENS)
        states, at = np.frombuffer(block, "<u8", lanes, at), at + 8 * lanes
        words = np.frombuffer(block, "<u4", (len(block) - 4 - at) // 4, at)
        chosen = range(groups) if only is None else only
        for g in chosen:
            off, count, crc = marks[g]
            if zlib.crc32(words[off : off + count].tobytes()) != crc:
                raise ValueError("a checkpoint's checksum is wrong")
        first, last = (chosen.start * CHECKPOINT, min(chosen.stop * CHECKPOINT, lanes)) if len(chosen) else (0, 0)
        state = states[first:last].copy()
        width = last - first
        group = np.arange(first, last) // CHECKPOINT
        cursor = np.array([marks[g][0] for g in chosen], np.int64)
        size = np.full(width, LANE_TOKENS)
        if width and last == lanes:
            size[-1] = n - (lanes - 1) * LANE_TOKENS
        grid = np.zeros((width, LANE_TOKENS), np.int32)
        edges = np.searchsorted(group, np.arange(chosen.start, chosen.stop + 1))
        local = group - chosen.start
        mask, symbol = np.uint64((1 << int(self.bits)) - 1), self.symbol
        for t in range(int(size.max(initial=0))):
            live = width if t < size[-1] else width - 1
            x = state[:live]
            slot = x & mask
            s = symbol[slot.astype(np.int64)]
            grid[:live, t] = s
            x = (x >> self.bits) * self.freq[s]
            x += slot
            x -= self.start[s]
            need = x < _LOW
            # each checkpoint has a stream of its own: a lane's word lies behind those of the lanes before it
            nth = np.cumsum(need)
            before = np.append(0, nth)[np.minimum(edges[:-1], live)]
            place = cursor[local[:live]] + nth - 1 - before[local[:live]]
            k = np.flatnonzero(need)
            x[k] = x[k] << np.uint64(32) | words[place[k]]
            cursor += np.append(0, nth)[np.minimum(edges[1:], live)] - before
            state[:live] = x
        flat = grid.reshape(-1)
        return (flat[: n if only is None else int(size.sum())] if only is None else np.concatenate([grid[i, : size[i]] for i in range(width)]) if width else flat), lengths


@functools.lru_cache(maxsize=2)  # a worker keeps it from task to task
def tokenizer_encoder(path: str) -> tuple[WordEncoder, int]:
    """The encoder of a byte-level BPE file and its vocabulary size. A text that holds the string of an added token, which
    the library takes for that token, is encoded as a whole."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads here
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    vocabulary = tk.get_vocab()
    starts = np.zeros(max(vocabulary.values()) + 1, bool)
    for piece, i in vocabulary.items():
        starts[i] = piece.startswith("Ġ")
    encode = lambda texts: [e.ids for e in tk.encode_batch_fast(texts, add_special_tokens=False)]
    added = "|".join(re.escape(t.content) for t in tk.get_added_tokens_decoder().values())
    return WordEncoder(encode, starts, " ", True, KEPT_WORDS, added), len(starts)


def _tokenise(path: str):
    """Rows (id, ids, n) of documents, and at the end of a task rows (token, count) in the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = tokenizer_encoder(path)
        kind = np.uint16 if size <= 1 << 16 else np.uint32
        for batch in batches:
            for a, b in slices(batch.column("text")):
                ids, n = encoder(batch.column("text").slice(a, b - a))
                ends = np.cumsum(n)
                data = [np.append(ids[e - k : e], END_ID).astype(kind) for e, k in zip(ends, n)]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").slice(a, b - a), "ids": pa.array([x.tobytes() for x in data], pa.binary()),
                    "n": pa.array(n + 1, pa.int64()),
                })

    return run


def _tally(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = (np.uint16 if width == 2 else np.uint32), np.zeros(size, np.int64)
        for batch in batches:
            data = batch.column("ids")
            for a in range(0, len(data), 500):
                total += np.bincount(np.frombuffer(b"".join(data.slice(a, 500).to_pylist()), kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return run


def _write(freq_bytes: bytes, width: int):
    """A part's rows in order to blocks. Each block: its part, the ids of the part before it, how many it has, the ids of
    its documents, and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind = Coder(np.frombuffer(freq_bytes, "<u8").astype(np.uint64)), np.uint16 if width == 2 else np.uint32
        part, start, held, held_n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            block = coder.encode(np.frombuffer(b"".join(x for _, x, _ in held), kind), [k for _, _, k in held])
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "start": pa.array([start], pa.int64()), "n_tokens": pa.array([held_n], pa.int64()),
                "doc_ids": pa.array([[i.as_py() for i, _, _ in held]], pa.list_(id_type)), "block": pa.array([block], pa.binary()),
            })

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for id_, data, n in zip(batch.column("id"), batch.column("ids"), batch.column("n").to_pylist()):
                if held and held_n + n > BLOCK_TOKENS:
                    yield flush()
                    start, held, held_n = start + held_n, [], 0
                held.append((id_, data.as_buffer().to_pybytes(), n))
                held_n += n
        if held:
            yield flush()

    return run


def _read(freq_bytes: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(freq_bytes, "<u8").astype(np.uint64))
        for batch in batches:
            for part, start, doc_ids, block in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("doc_ids"), batch.column("block")):
                ids, lengths = coder.decode(block.as_py())
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4")
                yield pa.RecordBatch.from_pydict({
                    "id": doc_ids.values, "part": pa.array([part] * len(ends), pa.int32()), "_at": pa.array(start + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[e - k : e]) for e, k in zip(ends, lengths)], pa.int64()),
                })

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``out_dir``/blocks, ``out_dir``/frequencies and ``out_dir``/parts (part, ids before it), as Parquet.

    Null text counts as empty: its only id is END_ID. Ids of documents may be of any type that has an order; null ids come
    first; rows with one id are in order of their ids' crc32, then of their bytes. Other columns are ignored. An empty table
    gives no block."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    _, size = tokenizer_encoder(tokenizer_path)
    width = 2 if size <= 1 << 16 else 4
    if size > MAX_VOCABULARY:
        raise ValueError("the vocabulary is larger than MAX_VOCABULARY")
    coded = freeze(rows.mapInArrow(_tokenise(tokenizer_path), f"id {kind}, ids binary, n long"), "token-ids", "zstd")
    counts = coded.select("ids").mapInArrow(_tally(width, size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    totals = np.zeros(size, np.int64)
    for r in counts.collect():  # at most MAX_VOCABULARY
        totals[r["token"]] = r["n"]
    freq = scaled(totals)
    listed = {*np.flatnonzero(freq).tolist(), size - 1}  # the last id, even unused, gives the table's length
    spark.createDataFrame([(i, int(freq[i])) for i in sorted(listed)], "token long, frequency long").coalesce(1).write.parquet(f"{out_dir}/frequencies")
    key = ["id", "_crc", "ids"]
    placed = coded.withColumn("_crc", F.crc32("ids")).repartitionByRange("id", "_crc").sortWithinPartitions(*key)
    blocks = placed.select("id", "ids", "n").mapInArrow(_write(freq.astype("<u8").tobytes(), width), f"part int, start long, n_tokens long, doc_ids array<{kind}>, block binary")
    blocks.write.option("compression", "none").parquet(f"{out_dir}/blocks")
    before, parts = 0, []
    for part, n in sorted(tuple(r) for r in spark.read.parquet(f"{out_dir}/blocks").groupBy("part").agg(F.sum("n_tokens")).collect()):  # a row a part
        parts.append((part, before))
        before += n
    spark.createDataFrame(parts, "part int, before long").coalesce(1).write.parquet(f"{out_dir}/parts")
    drop_frozen(coded)


def read_tokens(spark, out_dir: str) -> DataFrame:
    """One row per document of the blocks: id, start (ids before it), n_tokens, ids_crc32."""
    freq = np.zeros(MAX_VOCABULARY, np.uint64)
    top = -1
    for r in spark.read.parquet(f"{out_dir}/frequencies").collect():  # at most MAX_VOCABULARY
        freq[r["token"]], top = r["frequency"], max(top, r["token"])
    blocks = spark.read.parquet(f"{out_dir}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    read = blocks.select("part", "start", "doc_ids", "block").mapInArrow(_read(freq[: top + 1].astype("<u8").tobytes()), f"id {kind}, part int, _at long, n_tokens long, ids_crc32 long")
    met = read.join(F.broadcast(spark.read.parquet(f"{out_dir}/parts")), "part")  # a row a part
    return met.select("id", (F.col("before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Writes all ``documents`` as token files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    at = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), tokenizer_file(), at)
    return read_tokens(spark, at).withColumnRenamed("id", "doc_id")
