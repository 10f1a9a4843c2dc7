"""Best-fit-decreasing packing of token sequences into fixed windows.

Every task packs the pieces of its own partition, so nothing is shuffled: a window is
never shared between tasks, and each packed run leaves about one window part empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.bpe import loaded
from modelwatch.llm.shared import arrow_schema, plain, slices, trim

RUN = 1 << 18  # pieces that are packed together at most


class OpenWindows:
    """A segment tree over remaining capacities; each leaf stacks the open windows with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least remaining capacity of at least ``need`` that some window has, or -1."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def pop(self, room: int) -> int:
        i = room + self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.stacks[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each piece and the number of windows; no length is over ``capacity``.

    Pieces go by descending length, equal ones in input order, each into the open
    window with the least room that holds it.
    """
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, n = OpenWindows(capacity), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = free.tightest(need)
        if room < 0:
            room, at, n = capacity, n, n + 1
        else:
            at = free.pop(room)
        window[k], offset[k] = at, capacity - room
        if room > need:
            free.push(room - need, at)
    return window, offset, n


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, path: str, window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (null text: empty), packed into sequences of at most ``window`` tokens.

    A document is its ids and then ``end_id``, so it has a token at least. Documents over
    ``window`` are first cut into full windows and a rest. Rows that repeat a document, or
    have no doc_id, are packed each by itself; other columns are dropped; an empty table gives
    an empty one. A task packs at most RUN pieces together, so which pieces share a sequence
    depends on the partitions of ``documents``, and each partition leaves about one window
    part empty; with_ids holds the ids of RUN pieces. sequence_id is the task's number times 2**32 plus a count within
    the task; offsets in a sequence are gapless from 0. with_ids: adds the ids of each piece.
    """
    wide = PIECE + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(wide)

    def run(batches):
        from pyspark import TaskContext

        encode = loaded(path).encode
        high, made = TaskContext.get().partitionId() << 32, 0
        end = np.array([end_id], np.uint32).tobytes()
        docs, starts, lengths, sums, totals, ids = [], [], [], [], [], []

        def packed() -> pa.RecordBatch:
            nonlocal made
            size = np.array(lengths, np.int64)
            at, offset, n = best_fit_decreasing(size, window)
            cells = [docs, starts, size, sums, totals, at + (high + made), offset]
            out = [pa.array(c, pa.int64()) for c in cells] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
            made += n
            for c in (docs, starts, lengths, sums, totals, ids):
                c.clear()
            return pa.RecordBatch.from_arrays(out, schema=schema)

        for batch in batches:
            for rows in slices(batch, "text", 4 << 20):
                for doc, raw in zip(rows.column("doc_id").to_pylist(), encode(plain(rows.column("text")).to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for at in range(0, n, window):
                        part = raw[4 * at : 4 * (at + window)]
                        docs.append(doc)
                        starts.append(at)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        totals.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(part, np.int32))
                if len(lengths) >= RUN:
                    yield packed()
        if lengths:
            yield packed()
        trim()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, wide)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document in pieces of packed sequences of 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
