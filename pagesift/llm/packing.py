"""Token-id output: documents packed into rows of a fixed length by best-fit decreasing.

Documents are encoded by the sentencepiece library, words once, and packed in blocks of about ``block_tokens`` tokens,
in the order of the scan's own partitions, so nothing is shuffled and a task holds one block at a time;
rows are the same for the same partitions, not for others. A document longer than a row is cut
into full rows and a rest, losslessly. Pieces go, longest first, to the row with the smallest room that
still takes them; a segment tree over the rooms 0..length finds that row in O(log length).
"""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, table
from .piece_encoding import ChunkEncoder, default_model, encoder

LENGTH = 2048
BLOCK_TOKENS = 1_000_000
PAD = 0


class Rooms:
    """Rows by their free room; ``best(n)`` is the smallest room of n or more that some row has, or None.

    A node of the tree tells whether any room below it is taken up by a row. Most rooms keep theirs when one
    row comes or goes, so that nothing above the leaf changes.
    """

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i, some = room + self.leaves, self.some
        while i and not some[i]:
            some[i] = 1
            i >>= 1

    def take(self, room: int) -> int:
        here = self.rows[room]
        row = here.pop()
        if not here:
            i, some = room + self.leaves, self.some
            some[i] = 0
            while i > 1 and not some[i ^ 1]:
                i >>= 1
                some[i] = 0
        return row

    def best(self, n: int) -> int | None:
        i, some = n + self.leaves, self.some
        while not some[i]:
            while i & 1:  # right children, and at last the root, have nothing to their right below their parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i *= 2
            if not some[i]:
                i += 1
        return i - self.leaves


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Rows as lists of indices into ``lengths``, each at most ``most``; equal lengths go in index order."""
    rooms, rows = Rooms(most), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = rooms.best(n)
        if room is None:
            row, room = len(rows), most
            rows.append([])
        else:
            row = rooms.take(room)
        rows[row].append(i)
        rooms.put(room - n, row)
    return rows


def pack(df: DataFrame, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed row:

    block, row; n_tokens; ids (``length`` little-endian uint16, padded with 0); cu_seqlens (0 and the end of
    each segment); positions (``length`` uint16, from 0 in every segment and in the padding); doc_ids and
    starts (for each segment its document and the segment's first token there).

    Null and empty texts take an empty segment, so that every document occurs. Repeated rows are packed
    each; ids may be null or repeat. Other columns are not read. An empty table gives an empty result.
    """
    import sentencepiece

    model_file = model_file or default_model()
    kind = dict(df.dtypes)[id_col]
    if length > 65535:
        raise ValueError("positions are 16 bits wide")
    if sentencepiece.SentencePieceProcessor(model_file=model_file).get_piece_size() > 65536:
        raise ValueError("ids are 16 bits wide")
    schema = f"block long, row int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<{kind}>, starts array<int>"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, block = encoder(model_file, ChunkEncoder), TaskContext.get().partitionId(), 0
        names = ["block", "row", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "starts"]

        def emit(docs, ids):
            """One block: its documents' ids as an Arrow array, and the token ids of each."""
            sizes = np.array([len(x) for x in ids])
            tokens, firsts = np.concatenate(ids), np.cumsum(sizes) - sizes
            # Pieces: a document's full rows and its rest; an empty document has one empty piece.
            many = np.maximum(1, -(-sizes // length))
            of = np.repeat(np.arange(len(sizes)), many)
            starts = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * length
            lengths = np.minimum(length, sizes[of] - starts)
            rows = best_fit_decreasing(lengths.tolist(), length)
            held = np.array([len(r) for r in rows])
            order = np.concatenate([np.array(r) for r in rows])
            row = np.repeat(np.arange(len(rows)), held)
            # Each piece's place in the matrix, by running sums that start anew with each row.
            n = lengths[order]
            ends = np.cumsum(n)
            filled = np.bincount(row, n, len(rows)).astype(np.int64)
            ends -= np.repeat(np.cumsum(filled) - filled, held)
            at = row * length + ends - n
            matrix, positions = np.full(len(rows) * length, PAD, "<u2"), np.zeros(len(rows) * length, np.int64)
            into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            matrix[np.repeat(at, n) + into] = tokens[np.repeat((firsts[of] + starts)[order], n) + into]
            positions[np.repeat(at, n) + into] = into
            rest = length - filled
            tail = np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
            positions[np.repeat(np.arange(len(rows)) * length + filled, rest) + tail] = tail
            bounds = np.arange(len(rows) + 1, dtype=np.int32)
            binary = lambda x: pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(bounds * 2 * length), pa.py_buffer(x.astype("<u2"))])
            pieces = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
            lists = lambda values, offsets=pieces: pa.ListArray.from_arrays(pa.array(offsets), values)
            cumulative = np.zeros(len(order) + len(rows), np.int32)
            cumulative[np.arange(len(order)) + row + 1] = ends
            return pa.RecordBatch.from_arrays([
                pa.array(np.full(len(rows), part << 32 | block)), pa.array(bounds[:-1]), pa.array(filled, pa.int32()), binary(matrix), lists(pa.array(cumulative), pieces + bounds),
                binary(positions), lists(docs.take(pa.array(of[order]))), lists(pa.array(starts[order], pa.int32())),
            ], names)

        gc.disable()  # nothing here has cycles, and looking for them among very many small lists takes a tenth of the time
        docs, ids, held = [], [], 0
        for b in batches:
            a = 0
            for i, (found, _) in enumerate(enc.batch([t or "" for t in b.column(1).to_pylist()])):
                ids.append(np.frombuffer(found, "<i4").astype("<u2"))
                held += len(ids[-1])
                if held >= block_tokens:
                    yield emit(pa.concat_arrays([*docs, b.column(0).slice(a, i + 1 - a)]), ids)
                    docs, ids, held, block, a = [], [], 0, block + 1, i + 1
            docs.append(b.column(0).slice(a))
        if ids:
            yield emit(pa.concat_arrays(docs), ids)
        gc.enable()

    return in_arrow(df.select(id_col, F.col(text_col).cast("string")), run, schema)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<int>): the segments again, one row each."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            docs, starts, out = [], [], []
            for ids, ends, ds, ss in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                row = np.frombuffer(ids, "<u2").astype("i4")
                docs += ds
                starts += ss
                out += [row[x:y].tolist() for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(2).type.value_type), pa.array(starts, pa.int32()), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    kind = dict(packed.dtypes)["doc_ids"][len("array<") : -1]
    return in_arrow(packed.select("ids", "cu_seqlens", "doc_ids", "starts"), run, f"doc_id {kind}, start int, ids array<int>")


def op9_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op9_packing": op9_packing}
