"""SentencePiece encoding and decoding by a score-ordered agenda.

A merge-type (BPE) vocabulary joins, again and again, the adjacent pair of symbols whose concatenation has
the best score, the leftmost first among equals. No piece holds a space mark after another character or a
line feed, so a text falls into chunks that encode independently; each worker keeps the encodings of short
chunks in a bounded cache. The new short chunks of a batch are merged together: their agendas are the
rows of one matrix, with a pair's rank at its place, and each step takes every row's best pair. A long
chunk has a heap for its agenda. Every new chunk is checked against the sentencepiece library, a whole
slice of an Arrow batch at a time; where they differ, the library's ids are taken for the text and n_repaired is 1.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, table

MARK = "▁"
#: The most characters of a chunk that enters a worker's cache.
LONGEST = 32
#: A worker's cache is emptied at this many bytes; an entry takes what its key and ids do and this much besides.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 200
NONE = np.int32(2**31 - 1)
#: Chunks that are checked as the lines of one text.
LINES = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def packed(ids) -> bytes:
    """Ids as 32-bit integers: caches of bytes are small and nothing for the garbage collector to walk through."""
    return np.asarray(ids, "<i4").tobytes()


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<i4").tolist()


class PairTable:
    """(rank, id) of the concatenation of two symbols, by open addressing, for arrays of symbols at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, (8 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.ids = np.full(size, -1, np.int64), np.full(size, NONE), np.full(size, -1, np.int32)
        for (x, y), (rank, i) in pairs.items():
            at = int(self._slot(np.array([x << 32 | y]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.ranks[at], self.ids[at] = x << 32 | y, rank, i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a free slot, of rank NONE, for a pair that makes no piece."""
        keys = x.astype(np.int64) << 32 | y
        at = self._slot(keys)
        while True:
            held = self.keys[at]
            on = (held != keys) & (held >= 0)
            if not on.any():
                return at
            at = np.where(on, (at + 1) & ((1 << self.bits) - 1), at)


class ChunkEncoder:
    """Encodes texts chunk by chunk, with a cache of short chunks. Here the library encodes new chunks, many as the lines of one text."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, self.scores = {}, {}
        for i in range(lib.get_piece_size()):
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)):
                self.ids[p := lib.id_to_piece(i)] = i
                self.scores[p] = lib.get_score(i)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("the vocabulary merges across words or lines")
        if lib.encode("a  b") != lib.encode("a" + MARK + MARK + "b") or lib.encode(" a") == lib.encode("a") or lib.encode("\n a") != lib.encode("\n" + MARK + "a"):
            raise ValueError("the model's normaliser drops spaces or adds no mark at the beginning")
        self.names = [str(i) for i in range(lib.get_piece_size())]
        #: What the library makes of a line feed at the beginning, and elsewhere.
        self.lead = packed(lib.encode("\n"))
        self.feed = self.lead[-4:]
        #: Packed ids of chunks by their text after the mark, and of those without a mark.
        self.marked: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.cached = 0

    def merge(self, chunk: str) -> list[int]:
        return unpacked(self.merge_packed([chunk])[0])

    def merge_packed(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(chunks), 4 * LINES):
            whole = packed(self.library.encode("\n" + "\n".join(chunks[i : i + 4 * LINES])))
            feeds = 4 * np.flatnonzero(np.frombuffer(whole, "<i4") == np.frombuffer(self.feed, "<i4"))
            out += map(whole.__getitem__, map(slice, (feeds + 4).tolist(), [*feeds[1:].tolist(), len(whole)]))
        return out

    def note(self, chunks: list[str], ids: list[bytes]) -> None:
        """New chunks that ``check`` is to look at."""

    def check(self) -> bool:
        return True

    def _new(self, cache: dict, key: str, chunk: str) -> bytes:
        found = packed(self.merge(chunk))
        self.note([chunk], [found])
        if len(key) <= LONGEST:
            cache[key] = found
            self.cached += ENTRY_BYTES + len(key) + len(found)
        return found

    def _empty(self) -> None:
        self.marked.clear()
        self.bare.clear()
        self.cached = 0

    @staticmethod
    def lines(text: str) -> list[tuple[str, list[str]]]:
        """Of each line what stands before its first mark, and what follows each mark; none for an empty text."""
        split = [line.split(" ") for line in f" {text.replace(MARK, ' ')}".split("\n")] if text else []
        return [(words[0], words[1:]) for words in split]

    def learn(self, marked: set[str], bare: set[str]) -> None:
        """Puts new short chunks into the caches."""
        for cache, words, mark in ((self.marked, marked, MARK), (self.bare, bare, "")):
            new = [w for w in words if w and len(w) <= LONGEST]
            whole = [mark + w for w in new]
            ids = self.merge_packed(whole)
            cache.update(zip(new, ids, strict=True))
            self.cached += ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(map(len, ids))
            self.note(whole, ids)

    def chunks(self, lines: list[tuple[str, list[str]]], known: list[list[bytes | None]]) -> list[bytes]:
        """The packed ids of each chunk of a text in turn; ``known`` are those of what follows the marks of each line, as far as they were cached."""
        out, marked, bare = [], self.marked, self.bare
        for i, ((first, rest), found) in enumerate(zip(lines, known, strict=True)):
            if i:
                out.append(self.feed)
            if None in found:
                if "" in rest:  # marks in a row, or at the end
                    for c in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", MARK.join([first, *rest])):
                        cache, key = (marked, c[1:]) if c[0] == MARK else (bare, c)
                        out.append(cache.get(key) or self._new(cache, key, c))
                    continue
                found = [f or marked.get(w) or self._new(marked, w, MARK + w) for w, f in zip(rest, found, strict=True)]
            if first:
                out.append(bare.get(first) or self._new(bare, first, first))
            out += found
        return out

    def batch(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """For each text its packed ids, checked, and 1 if the library's ids had to be taken for it. Full caches are emptied before."""
        if self.cached > CACHE_BYTES:
            self._empty()
        split = [self.lines(t) for t in texts]
        get, held = self.marked.get, self.bare
        known = [[list(map(get, rest)) for _, rest in lines] for lines in split]
        marked: set[str] = set()
        bare: set[str] = set()
        for lines, founds in zip(split, known, strict=True):
            for (first, rest), found in zip(lines, founds, strict=True):
                if first not in held:
                    bare.add(first)
                if None in found:
                    marked.update([w for w, f in zip(rest, found, strict=True) if f is None])
        self.learn(marked, bare)
        out = [(b"".join(self.chunks(lines, founds)), 0) for lines, founds in zip(split, known, strict=True)]
        if not self.check():
            theirs = [packed(self.library.encode(t)) for t in texts]
            out = [(b, int(a != b)) for (a, _), b in zip(out, theirs, strict=True)]
        return out


class AgendaEncoder(ChunkEncoder):
    """New chunks are merged here, by agendas, and checked against the library."""

    def __init__(self, model_file: str):
        super().__init__(model_file)
        self.unchecked: list[tuple[str, bytes]] = []
        #: Of pieces, 0 for the best score; equal scores have equal ranks.
        order = {score: r for r, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.ranks = {p: order[score] for p, score in self.scores.items()}
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    pairs[self.ids[p[:k]], self.ids[p[k:]]] = self.ranks[p], i
        self.pairs = PairTable(pairs)
        #: Whether all single characters of pieces are pieces; else chunks are merged by heap alone.
        self.closed = all(c in self.ids for p in self.ids for c in p)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.bytes = [self.library.piece_to_id(f"<0x{i:02X}>") for i in range(256)]

    def merge(self, chunk: str) -> list[int]:
        """The ids of one chunk. An entry of the agenda is a number, rank * 2**32 + place; ``now`` has the
        rank of the pair that begins at each place, so that entries of pairs that are gone are known by it."""
        symbols, rank = list(chunk), self.ranks.get
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [rank(x + y, -1) for x, y in zip(symbols, symbols[1:])]
        now.append(-1)
        agenda = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            a = entry & 0xFFFFFFFF
            if now[a] != entry >> 32:
                continue
            b = after[a]
            symbols[a] += symbols[b]
            symbols[b], now[b], c = "", -1, after[b]
            after[a] = c
            if c < n:
                before[c] = a
                now[a] = r = rank(symbols[a] + symbols[c], -1)
                if r >= 0:
                    heappush(agenda, r << 32 | a)
            else:
                now[a] = -1
            p = before[a]
            if p >= 0:
                now[p] = r = rank(symbols[p] + symbols[a], -1)
                if r >= 0:
                    heappush(agenda, r << 32 | p)
        ids = self.ids
        try:
            return [ids[s] for s in symbols if s]
        except KeyError:
            return [i for s in symbols if s for i in ([ids[s]] if s in ids else [self.bytes[x] for x in s.encode("utf-8")])]

    def merge_all(self, chunks: list[str]) -> list[list[int]]:
        """The ids of many short chunks."""
        return [unpacked(ids) for ids in self.merge_packed(chunks)]

    def merge_packed(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(chunks)
        lengths = np.array([len(c) for c in chunks], np.int64)
        low = 0
        for high in (8, 14, LONGEST + 1):
            here = np.flatnonzero((lengths > low) & (lengths <= high)) if self.closed else []
            low = high
            if len(here):
                self._merge_rows([chunks[i] for i in here], lengths[here], here.tolist(), out, high)
        return [packed(self.merge(c)) if ids is None else ids for c, ids in zip(chunks, out, strict=True)]

    def _merge_rows(self, chunks: list[str], lengths: np.ndarray, places: list[int], out: list, width: int) -> None:
        pairs = self.pairs
        symbols = np.full((len(chunks), width + 1), -2, np.int32)
        filled = np.arange(width + 1) < lengths[:, None]
        symbols[filled] = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        rows = np.flatnonzero(~((symbols == -1) & filled).any(1))  # chunks with unknown characters stay for the heap
        symbols = symbols[rows]
        ranks = pairs.ranks[pairs.find(np.maximum(symbols[:, :-1], 0), symbols[:, 1:].clip(0))]
        ranks[symbols[:, 1:] < 0] = NONE
        columns = np.arange(width + 1)

        def finish(done_rows, done_symbols):
            held = done_symbols >= 0
            every, start = packed(done_symbols[held]), 0
            for r, end in zip(done_rows.tolist(), (4 * held.sum(1).cumsum()).tolist(), strict=True):
                out[places[r]] = every[start:end]
                start = end

        while len(rows):
            at = ranks.argmin(1)
            every = np.arange(len(rows))
            on = ranks[every, at] != NONE
            if not on.all():
                finish(rows[~on], symbols[~on])
                rows, symbols, ranks, at = rows[on], symbols[on], ranks[on], at[on]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            made = pairs.ids[pairs.find(symbols[every, at], symbols[every, at + 1])]
            gone = columns > at[:, None]  # what stands right of the merged pair moves up by one
            symbols = np.take_along_axis(symbols, np.minimum(columns + gone, width), 1)
            symbols[:, -1] = -2
            symbols[every, at] = made
            ranks = np.take_along_axis(ranks, np.minimum(columns[:-1] + gone[:, :-1], width - 1), 1)
            ranks[:, -1] = NONE
            for left in (at - 1, at):
                x, y = symbols[every, left.clip(0)], symbols[every, left.clip(0) + 1]
                rank = pairs.ranks[pairs.find(x, y.clip(0))]
                rank[y < 0] = NONE
                keep = left >= 0
                ranks[every[keep], left[keep]] = rank[keep]

    def note(self, chunks: list[str], ids: list[bytes]) -> None:
        self.unchecked += zip(chunks, ids, strict=True)

    def check(self) -> bool:
        """Compares all new chunks with the library, in one call; True if all agree. Caches with others are emptied."""
        new, self.unchecked = self.unchecked, []
        lines = [new[i : i + LINES] for i in range(0, len(new), LINES)]
        theirs = self.library.encode(["\n" + "\n".join([c for c, _ in some]) for some in lines], num_threads=1)
        if all(packed(t) == self.lead + self.feed.join([ids for _, ids in some]) for some, t in zip(lines, theirs, strict=True)):
            return True
        self._empty()
        return False


_ENCODERS: dict[tuple[str, type], ChunkEncoder] = {}


def encoder(model_file: str, kind: type = AgendaEncoder) -> ChunkEncoder:
    """One encoder per worker process, model and kind."""
    if (model_file, kind) not in _ENCODERS:
        _ENCODERS[model_file, kind] = kind(model_file)
    return _ENCODERS[model_file, kind]


def encode(df: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, ids array<int>, decoded string, n_repaired) per row, or with ``digest`` their counts and hashes.

    Ids are the library's for the whole text, without begin and end ids; decoded is the library's decode of
    them. Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated
    results, and texts that repeat near each other are encoded once; other columns are not read. The model file must be at the same place on every worker.
    """
    model_file = model_file or default_model()
    kind = dict(df.dtypes)[id_col]
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] if digest else [id_col, "ids", "decoded", "n_repaired"]
    kinds = ["long", "string", "string"] if digest else ["array<int>", "string", "long"]

    def run(batches):
        import pyarrow as pa

        enc = encoder(model_file)
        decode, name = enc.library.decode, enc.names.__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [t or "" for t in b.column(1).to_pylist()]
                rows = dict.fromkeys(texts)
                for whole_text, (found, repaired) in zip(rows, enc.batch(list(rows)), strict=True):
                    ids = unpacked(found)
                    text = decode(ids) if ids else ""
                    rows[whole_text] = (len(ids), sha(",".join(map(name, ids))), sha(text)) if digest else (ids, text, repaired)
                cols = list(zip(*(rows[t] for t in texts), strict=True)) or [[], [], []]
                types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, [kind, *kinds], strict=True))
    return in_arrow(df.select(id_col, F.col(text_col).cast("string")), run, schema)


def op3_sentencepiece(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), digest=True)


SQL: dict[str, str] = {}
QUERIES = {"op3_sentencepiece": op3_sentencepiece}
