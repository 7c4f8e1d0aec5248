"""Token-id files: an adaptive range coder with mixed id predictions.

A file holds the ids of a run of documents in blocks, then a table of the documents. Every block is
coded by itself, from a fresh model, and carries a CRC-32 of its ids. A block's ids are cut into
lanes, consecutive runs that are coded side by side: at each step all lanes code one id with the
same model, which learns from all of them every EVERY steps, in the decoder as in the encoder.

The model predicts one id from the two ids before (a hashed table), one from the id before, and
has adaptive counts of all ids. The probability of an id is the mixture
w2 * [id = predicted by two] + w1 * [id = predicted by one] + w0 * share of its count; the weights
are counts of which component was right, kept for every pair of confidences of the two
predictions. Intervals of the mixture drive a carry-less range coder of 64 bits that moves 32 bits at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions_for, scratch_path, ship, written
from .textscan import pack, unpack
from .tokens import default_path, encoder, load_file
from .warc import store

BLOCK_IDS, MOST_LANES, LEAST_STEPS = 1 << 21, 1 << 13, 32
#: Text bytes that go into one file.
FILE_BYTES = 32 << 20
END_ID = 2
#: Bits of the mixture, of its part that all ids share, and of the whole of their shares.
TOTAL_BITS, FLOOR_BITS, SHARE_BITS = 28, 22, 20
#: A prediction is its id and SURE_BITS of confidence; tables of two ids have 2**SLOT_BITS of them.
SLOT_BITS, SURE_BITS, EVERY = 18, 3, 4
SURE = (1 << SURE_BITS) - 1
KINDS = (SURE + 1) ** 2 * 2
_MAGIC, _BLOCK = b"LTOK1\n", struct.Struct("<IIIIII")  # ids, lanes, words, vocabulary, crc32 of the ids, crc32 of the payload
_FOOT = struct.Struct("<QII6s")  # place of the document table, its bytes, documents, magic


class Model:
    """The predictions and what they learn; the same calls in encoder and decoder keep it the same."""

    def __init__(self, vocabulary: int):
        if vocabulary > 1 << (SHARE_BITS - 1):
            raise ValueError("the vocabulary is larger than the shares can tell apart")
        self.count = np.zeros(vocabulary, np.int64)
        empty = np.int32(vocabulary << SURE_BITS)
        self.one, self.two = np.full(vocabulary + 1, empty, np.int32), np.full(1 << SLOT_BITS, empty, np.int32)
        self.right = np.ones((KINDS, 3), np.int64)
        self.right[:, 0] = 4
        self.next, self.learnt = 0, 0
        self.shares()
        self.weights()

    def shares(self) -> None:
        """Shares of all ids in 2**SHARE_BITS: at least 1, and the rest by the counts. Renewed as often as the counts double, and at 16 steps' ids."""
        n, vocabulary = int(self.count.sum()), len(self.count)
        room = (1 << SHARE_BITS) - vocabulary
        share = 1 + ((2 * self.count + 1) * room) // (2 * n + vocabulary)
        share[int(share.argmax())] += (1 << SHARE_BITS) - int(share.sum())
        self.cum = np.concatenate([[0], np.cumsum(share)])
        self.symbol = np.repeat(np.arange(vocabulary, dtype=np.int32), share)

    def weights(self) -> None:
        scale, whole = (1 << TOTAL_BITS) - (1 << FLOOR_BITS), self.right.sum(axis=1)
        self.width2 = self.right[:, 2] * scale // whole
        self.base = self.width2 + self.right[:, 1] * scale // whole
        self.rest = (1 << TOTAL_BITS) - self.base

    def predict(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place in the table of two, prediction of two, of one, kind) after each pair of ids."""
        slot = (before.view(np.uint32) * np.uint32(0x9E3779B1) + last.view(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS)
        two, one = self.two[slot], self.one[last]
        kind = ((two & SURE) << (SURE_BITS + 1)) + ((one & SURE) << 1) + ((one ^ two) <= SURE)
        return slot, two, one, kind

    def interval(self, ids: np.ndarray, part: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of each id's interval; part tells the prediction that is right, 2 or 1, or 0 for neither."""
        width, base, rest = self.width2[kind], self.base[kind], self.rest[kind]
        low = base + (self.cum[ids] * rest >> SHARE_BITS)
        high = base + (self.cum[ids + 1] * rest >> SHARE_BITS)
        start = np.where(part == 0, low, np.where(part == 2, 0, width))
        stop = np.where(part == 0, high, np.where(part == 2, width, base))
        return start, stop - start

    def learn(
        self, ids: np.ndarray, part: np.ndarray, last: np.ndarray, slot: np.ndarray, two: np.ndarray, one: np.ndarray, kind: np.ndarray
    ) -> None:
        """A hit makes a prediction surer, a miss halves its confidence; from 1 or less a new one takes its place."""
        fresh = (ids << SURE_BITS) + np.int32(1)
        for table, at, was in ((self.one, last, one), (self.two, slot, two)):
            sure = was & SURE
            missed = np.where(sure <= 1, fresh, was - sure + (sure >> 1))
            table[at] = np.where((was >> SURE_BITS) == ids, was + (sure < SURE), missed)
        self.count += np.bincount(ids, minlength=len(self.count))
        self.right += 2 * np.bincount(kind * 3 + part, minlength=KINDS * 3).reshape(KINDS, 3)
        big = self.right.sum(axis=1) > 1 << 16
        self.right[big] = (self.right[big] + 1) >> 1
        self.weights()
        self.learnt += len(ids)
        if self.learnt >= self.next:
            self.next = self.learnt + min(self.learnt, 16 * MOST_LANES)
            self.shares()


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(MOST_LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


_HALF = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)
_UNIT = np.uint64(TOTAL_BITS)


class _Coder:
    """Carry-less interval arithmetic of all lanes."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.span = np.full(lanes, (1 << 64) - 1, np.uint64)

    def narrow(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Narrow the first lanes; returns those that move 32 bits."""
        k = len(start)
        low, span = self.low[:k], self.span[:k]
        unit = span >> _UNIT
        low += start * unit
        np.multiply(size, unit, out=span)
        at = np.flatnonzero(span <= _LOW)
        # a moving interval must not straddle a multiple of 2**32
        span[at] = np.minimum(span[at], _LOW + np.uint64(1) - (low[at] & _LOW))
        return at

    def shift(self, at: np.ndarray) -> None:
        self.low[at] <<= _HALF
        self.span[at] <<= _HALF


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of any number of ids below ``vocabulary``."""
    n = len(ids)
    lanes, steps = _lanes(n)
    padded = np.zeros(lanes * steps, np.int32)
    padded[:n] = ids
    grid = np.zeros((steps + 2, lanes), np.int32)  # two empty ids before every lane
    grid[2:] = padded.reshape(lanes, steps).T
    active = (np.clip(n - np.arange(lanes) * steps, 0, steps)[None, :] > np.arange(steps)[:, None]).sum(axis=1)  # lanes are filled in order
    model, coder = Model(vocabulary), _Coder(lanes)
    who, words = [], []
    for t in range(0, steps, EVERY):
        rows = [r for r in range(t, min(t + EVERY, steps)) if active[r]]
        if not rows:
            break
        cut = np.cumsum([0, *(int(active[r]) for r in rows)])
        x, last, before = (np.concatenate([grid[r + back, : active[r]] for r in rows]) for back in (2, 1, 0))
        slot, two, one, kind = model.predict(before, last)
        part = np.where(two >> SURE_BITS == x, 2, np.where(one >> SURE_BITS == x, 1, 0))
        start, size = (y.astype(np.uint64) for y in model.interval(x, part, kind))
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            at = coder.narrow(start[a:z], size[a:z])
            who.append(at)
            words.append((coder.low[at] >> _HALF).astype(np.uint32))
            coder.shift(at)
        model.learn(x, part, last, slot, two, one, kind)
    who.append(np.repeat(np.arange(lanes), 2))
    words.append(np.stack([coder.low >> _HALF, coder.low & _LOW], axis=1).ravel().astype(np.uint32))
    who, words = np.concatenate(who).astype(np.uint16), np.concatenate(words)
    order = np.argsort(who, kind="stable")
    payload = pack(np.bincount(who, minlength=lanes).astype(np.uint32))
    payload = struct.pack("<I", len(payload)) + payload + words[order].astype("<u4").tobytes()
    return _BLOCK.pack(
        n, lanes, len(words), vocabulary, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload)
    ) + struct.pack("<I", len(payload)) + payload


def decode_block(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(ids, place of what follows) of the block at ``at``; raises if a checksum differs."""
    n, lanes, count, vocabulary, crc, payload_crc = _BLOCK.unpack_from(blob, at)
    (size,) = struct.unpack_from("<I", blob, at + _BLOCK.size)
    payload = blob[at + _BLOCK.size + 4 : at + _BLOCK.size + 4 + size]
    if zlib.crc32(payload) != payload_crc:
        raise ValueError("damaged block")
    (head,) = struct.unpack_from("<I", payload)
    each = unpack(payload[4 : 4 + head], np.uint32).astype(np.int64)
    words = np.frombuffer(payload, "<u4", count, 4 + head)
    place = np.cumsum(each) - each
    steps = -(-n // lanes)
    active = (np.clip(n - np.arange(lanes) * steps, 0, steps)[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    model, coder = Model(vocabulary), _Coder(lanes)
    code = (words[place].astype(np.uint64) << _HALF) | words[place + 1]
    place = place + 2
    grid = np.zeros((steps + 2, lanes), np.int32)
    most, share = np.uint64((1 << TOTAL_BITS) - 1), float(1 << SHARE_BITS)
    seen: list[tuple[np.ndarray, ...]] = []
    for t in range(steps):
        k = int(active[t])
        if not k:
            break
        before, last = grid[t, :k], grid[t + 1, :k]
        slot, two, one, kind = model.predict(before, last)
        value = np.minimum((code[:k] - coder.low[:k]) // (coder.span[:k] >> _UNIT), most).astype(np.int64)
        width, base = model.width2[kind], model.base[kind]
        part = np.where(value < width, 2, np.where(value < base, 1, 0))
        # both numbers are exact in double precision, and their quotient is further from the next integer than its error
        above = np.maximum(value - base, 0)
        drawn = ((above + 1) * share - 1) / model.rest[kind]
        x = np.where(part == 0, model.symbol[drawn.astype(np.int64)], np.where(part == 2, two, one) >> SURE_BITS)
        start, narrow = model.interval(x, part, kind)
        m = coder.narrow(start.astype(np.uint64), narrow.astype(np.uint64))
        coder.shift(m)
        code[m] = (code[m] << _HALF) | words[np.minimum(place[m], count - 1)]
        place[m] += 1
        grid[t + 2, :k] = x
        seen.append((x, part, last, slot, two, one, kind))
        if len(seen) == EVERY:
            model.learn(*(np.concatenate(y) for y in zip(*seen, strict=True)))
            seen = []
    ids = np.ascontiguousarray(grid[2:].T).reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("ids differ from their checksum")
    return ids, at + _BLOCK.size + 4 + size


class Writer:
    """Writes one file: blocks of ids, the table of documents, a footer."""

    def __init__(self, folder: str, vocabulary: int):
        files, root = store(folder)
        self.name, self.vocabulary = f"{uuid.uuid4().hex}.ltok", vocabulary
        self.out = files.open_output_stream(f"{root}/{self.name}", compression=None)
        self.out.write(_MAGIC)
        self.at, self.waiting, self.size = len(_MAGIC), [], 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, pieces: list[np.ndarray]) -> None:
        self.ids.append(doc_id)
        self.lengths.append(sum(map(len, pieces)))
        self.waiting += pieces
        self.size += self.lengths[-1]
        if self.size >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        x = np.concatenate([np.empty(0, np.uint32), *self.waiting])
        while len(x) >= BLOCK_IDS or (all_of_it and len(x)):
            blob = encode_block(x[:BLOCK_IDS], self.vocabulary)
            self.out.write(blob)
            self.at += len(blob)
            x = x[BLOCK_IDS:]
        self.waiting, self.size = [x], len(x)

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        parts = [pack(known), pack(ids), pack(np.array(self.lengths, np.int64))]
        table = b"".join(struct.pack("<I", len(p)) + p for p in parts)
        self.out.write(table + _FOOT.pack(self.at, len(table), len(self.ids), _MAGIC))
        self.out.close()
        return self.name, len(self.ids), sum(self.lengths)


def read_file(file) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's documents, a block in memory at a time."""
    size = file.size()
    file.seek(size - _FOOT.size)
    at, length, count, magic = _FOOT.unpack(file.read(_FOOT.size))
    if magic != _MAGIC:
        raise ValueError("no token file")
    file.seek(at)
    table, parts, p = file.read(length), [], 0
    for kind in (np.uint8, np.int64, np.int64):
        (n,) = struct.unpack_from("<I", table, p)
        parts.append(unpack(table[p + 4 : p + 4 + n], kind))
        p += 4 + n
    place, have = len(_MAGIC), np.empty(0, np.uint32)
    for known, ident, n in zip(*(x.tolist() for x in parts), strict=True):
        pieces, missing = [have[:n]], n - len(have[:n])
        have = have[n:]
        while missing:
            file.seek(place)
            head = file.read(_BLOCK.size + 4)
            (more,) = struct.unpack_from("<I", head, _BLOCK.size)
            have, _ = decode_block(head + file.read(more))
            place += len(head) + more
            pieces.append(have[:missing])
            missing, have = missing - len(pieces[-1]), have[len(pieces[-1]) :]
        yield (ident if known else None), np.concatenate(pieces)


FILES = "place int, file string, n_docs long, n_ids long"


def write_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END_ID) -> DataFrame:
    """Encode (doc_id, text), write files in ascending doc_id order, return the table of files.

    Documents are range-partitioned by doc_id, about FILE_BYTES of text to a file; null doc_ids
    come last. Rows with one doc_id come in the order of their texts' first 64 characters, then of their
    texts' hashes, and may lie in several files. Null texts are empty and have the end id only. ``place`` numbers the files in order; a
    task that runs twice leaves a file that the table doesn't name.
    """
    spark = docs.sparkSession
    ship(spark)
    kind, blob = load_file(path or default_path())
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    keys = [F.col("doc_id").asc_nulls_last(), F.col("head").asc_nulls_first(), "tie", "row"]
    tied = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("row")
    )
    placed = tied.repartitionByRange(partitions_for(total, FILE_BYTES), *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, out, ending = encoder(kind, blob), None, np.array([end], np.uint32)
        vocabulary = e.library.get_vocab_size() if e.kind == "json" else e.library.get_piece_size()
        for batch in batches:
            names, row, pieces = batch.column(0).to_pylist(), 0, []
            for rows, ids, n in e.ids(batch.column(1)):
                out = out or Writer(folder, max(vocabulary, end + 1))
                edge = np.cumsum(n)
                for r, a, z in zip(rows.tolist(), (edge - n).tolist(), edge.tolist(), strict=True):
                    if r != row:
                        out.add(names[row], [*pieces, ending])
                        row, pieces = r, []
                    pieces.append(ids[a:z])
            if batch.num_rows:
                out.add(names[row], [*pieces, ending])
        if out:
            row = (TaskContext.get().partitionId(), *out.close())
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=[f.split()[0] for f in FILES.split(", ")]
            )

    return written(placed.mapInArrow(write, FILES), "token-files")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files that the table names."""
    ship(files.sparkSession)
    # one row per file passes through this window
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = store(folder)
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with disk.open_input_file(f"{root}/{name}") as f:
                    for ident, ids in read_file(f):
                        rows.append((ident, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[k] for r in rows[i : i + 10_000]], pa.int64()) for k in range(4)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    return starts.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    disk, root = store(folder)
    disk.create_dir(root, recursive=True)
    return read_files(write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
