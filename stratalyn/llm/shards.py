"""Token-id output in training order: fixed-stride binary shards for sequential, resumable reads.

Documents become sequences of ``LENGTH`` token ids (16 bits each; the last sequence of a document is padded). Every
sequence has a dense index: its number within its partition of the input plus the number of sequences in partitions
before, from one count a partition. A keyed Feistel network permutes an even-bit domain that covers the indexes; walking
its cycle until it falls below their number makes that a permutation of the indexes, so every sequence gets one global
slot, without a sort, a shuffle seed per run or a table of the order. Slots are range-partitioned into shards of
``PER_SHARD`` slots; a record stands at ``(slot - first slot of its shard) * stride``, so a reader resumes at any slot
by one seek.

Texts are encoded twice, once to count, where no ids are put together, and once to deal: keeping the sequences between would store all ids a third time
besides the shuffle and the shards. So the order of a given key follows the input's partitions: the same files, read in
the same way, give the same order. A partition that yields another number of sequences than was counted raises an error,
and so does a shard with a slot missing or twice; give a table, not the outcome of a shuffle, whose rows may come in
another order when a lost executor's work is repeated.

A shard is written under a name unique to the task attempt and counts only once the checkpointed manifest names it;
``materialise`` then deletes what attempts that do not count have left.

Record: doc_id (int64), number within its document (int32), tokens used (int32), ``LENGTH`` ids (uint16), little-endian.

Defined results: null and empty texts have no sequence; very long texts have as many sequences as they need; null doc_ids
are stored as the least int64 and read back null; ties and repeated rows have sequences of their own; other columns are
ignored, whatever their names; an empty table gives no shard and an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalyn.llm import bpe
from stratalyn.llm.common import cut, new_folder

LENGTH = 512
PER_SHARD = 16384
KEY = 0x5DEECE66D
ROUNDS = 4
NO_ID = -(1 << 63)
AT_ONCE = 2048  # records in one buffer
MOST_TASKS = 1 << 15  # of more shards, a task writes several, one after the other


def record(length: int) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("chunk", "<i4"), ("used", "<i4"), ("ids", "<u2", (length,))])


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of dense indexes below ``n``: a Feistel permutation of 2**(2 * half) >= n values, cycle-walked."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & low
        for i in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key + 0x1000003 * (i + 1)) & low)
        return left << bits | right

    out = once(index.astype(np.uint64))
    while (over := out >= np.uint64(n)).any():  # each walk ends within its own cycle, below n
        out[over] = once(out[over])
    return out.astype(np.int64)


def _binary(flat: np.ndarray, used: np.ndarray) -> pa.Array:
    """16-bit ids, one row after the other, as a binary column."""
    offsets = np.concatenate(([0], np.cumsum(2 * used))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat.astype("<u2")))])


def _cut(t: bpe.Tokenizer, batch: pa.RecordBatch, length: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of a batch of (doc_id, text), some texts at a time: doc_id, chunk, used, and all ids in one row."""
    row, held, size = 0, [], 0

    def made(texts: list[np.ndarray], first: int):
        n = np.array([len(x) for x in texts], np.int64)
        chunks = -(-n // length)
        chunk = bpe.spread(np.zeros(len(n), np.int64), chunks)
        used = np.minimum(length, np.repeat(n, chunks) - chunk * length)
        return batch.column(0).slice(first, len(n)).take(pa.array(np.repeat(np.arange(len(n)), chunks))), chunk, used, np.concatenate(texts)

    for pieces in t.texts(batch.column(1)):
        held.append(np.concatenate(pieces))
        size += len(held[-1])
        if size >= AT_ONCE * length:
            yield made(held, row)
            row, held, size = row + len(held), [], 0
    if held:
        yield made(held, row)


def count(docs: DataFrame, path: str, length: int = LENGTH) -> dict[int, int]:
    """The number of sequences of each partition of ``docs``: one number a partition reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, n = bpe.tokenizer(shared.value), 0
        for batch in batches:
            n += int((-(-t.counts(batch.column(0)) // length)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["part", "n"])

    return {r.part: r.n for r in docs.select(F.make_valid_utf8(F.col("text").cast("string"))).mapInArrow(run, "part int, n long").collect()}


def sequences(docs: DataFrame, path: str, counts: dict[int, int], key: int = KEY, length: int = LENGTH) -> DataFrame:
    """(slot, doc_id, chunk, used, ids): the token sequences of all documents at their global slots."""
    total, offsets = 0, {}
    for part in sorted(counts):
        offsets[part] = total
        total += counts[part]
    shared, placed = (docs.sparkSession.sparkContext.broadcast(x) for x in (bpe.read_vocabulary(path), (counts, offsets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, pos = bpe.tokenizer(shared.value), TaskContext.get().partitionId(), 0
        counts, offsets = placed.value
        for batch in batches:
            for doc_id, chunk, used, flat in _cut(t, batch, length):
                slot = permute(offsets.get(part, 0) + pos + np.arange(len(used)), total, key)
                pos += len(used)
                yield pa.RecordBatch.from_arrays([pa.array(slot), doc_id, pa.array(chunk, pa.int32()), pa.array(used, pa.int32()), _binary(flat, used)], ["slot", "doc_id", "chunk", "used", "ids"])
        if pos != counts.get(part, 0):
            raise ValueError(f"partition {part} has {pos} sequences where {counts.get(part, 0)} were counted")

    return docs.select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string"))).mapInArrow(run, "slot long, doc_id long, chunk int, used int, ids binary")


def write_shards(placed: DataFrame, total: int, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """The manifest (shard, file, first_slot, n, sha256) of the shards written."""
    kind = record(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, done, shard, n = None, [], -1, 0
        for batch in batches:
            slot, used = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            rows = np.zeros(len(slot), kind)
            rows["doc_id"], rows["chunk"], rows["used"] = batch.column(1).fill_null(NO_ID).to_numpy(), batch.column(2).to_numpy(), used
            _, offsets, raw = batch.column(4).buffers()
            o = np.frombuffer(offsets, np.int32, len(slot) + 1, 4 * batch.column(4).offset)
            rows["ids"][np.arange(length) < used[:, None]] = np.frombuffer(raw, "<u2", (int(o[-1]) - int(o[0])) // 2, int(o[0])) if len(slot) else 0
            cuts = np.flatnonzero(np.diff(slot // per_shard)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(slot)]):
                if lo == hi:
                    continue
                if slot[lo] // per_shard != shard:
                    if f:
                        f.close()
                        done.append((shard, name, shard * per_shard, n, sha.hexdigest()))
                    shard, n, sha = int(slot[lo] // per_shard), 0, hashlib.sha256()
                    name = f"{folder}/shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                    fs, at = pafs.FileSystem.from_uri(name)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    f = fs.open_output_stream(at, compression=None, buffer_size=1 << 20)
                due = np.arange(shard * per_shard + n, shard * per_shard + n + hi - lo)
                if (slot[lo:hi] != due).any():
                    raise ValueError(f"shard {shard} lacks a slot or has one twice after {due[0]}")
                piece = rows[lo:hi].tobytes()
                f.write(piece)
                sha.update(piece)
                n += hi - lo
        if f:
            f.close()
            done.append((shard, name, shard * per_shard, n, sha.hexdigest()))
        cols = list(zip(*done)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "file", "first_slot", "n", "sha256"])

    shards = max(1, -(-total // per_shard))
    tasks = min(shards, MOST_TASKS)
    # ranges of whole shards; their bounds are known, so no sample of the slots is taken
    part = F.expr(f"CAST((slot DIV {per_shard}L) * {tasks}L DIV {shards}L AS INT)")
    dealt = placed.repartitionById(tasks, part).sortWithinPartitions("slot")
    return dealt.select("slot", "doc_id", "chunk", "used", "ids").mapInArrow(run, "shard long, file string, first_slot long, n long, sha256 string")


def read_shards(manifest: DataFrame, length: int = LENGTH, resume_at: int = 0) -> DataFrame:
    """(slot, shard, doc_id, chunk, n_tokens, ids) of all slots from ``resume_at`` on, each shard read from one seek."""
    kind = record(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, name, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(at) as f:
                    slot = max(first, resume_at)
                    f.seek((slot - first) * kind.itemsize)
                    while slot < first + n:
                        rows = np.frombuffer(f.read(min(AT_ONCE, first + n - slot) * kind.itemsize), kind)
                        used, doc_id = rows["used"].astype(np.int64), rows["doc_id"]
                        ids = _binary(rows["ids"][np.arange(length) < used[:, None]], used)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.arange(slot, slot + len(rows))), pa.array(np.full(len(rows), shard, np.int64)), pa.array(doc_id, pa.int64(), mask=doc_id == NO_ID),
                            pa.array(rows["chunk"], pa.int32()), pa.array(rows["used"], pa.int32()), ids,
                        ], ["slot", "shard", "doc_id", "chunk", "n_tokens", "ids"])
                        slot += len(rows)

    wanted = manifest.where(F.col("first_slot") + F.col("n") > resume_at).select("shard", "file", "first_slot", "n")
    return wanted.mapInArrow(run, "slot long, shard long, doc_id long, chunk int, n_tokens int, ids binary")


def materialise(docs: DataFrame, path: str, key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write all shards; the manifest, checkpointed. What attempts that do not count have left is deleted."""
    folder = new_folder(docs.sparkSession, "shards")
    counts = count(docs, path, length)
    manifest = cut(write_shards(sequences(docs, path, counts, key, length), sum(counts.values()), folder, length, per_shard))
    fs, at = pafs.FileSystem.from_uri(folder)
    kept = {r.file.rsplit("/", 1)[-1] for r in manifest.select("file").toLocalIterator()}  # one name a shard
    for found in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if found.base_name not in kept:
            fs.delete_file(found.path)
    return manifest


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The columns of op7: every sequence as read back from the shards, in global order within a shard."""
    back = read_shards(materialise(docs, path))
    return back.select("slot", "shard", "doc_id", "chunk", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))
