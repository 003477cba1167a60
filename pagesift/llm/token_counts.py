"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Token lengths in bytes, added up, give each token's span; sections are
spans too, and both are sorted, so the interval join is a search of the section starts. A token that
crosses a boundary is allotted by rule:

* ``first``: to the section where it begins;
* ``last``: to the section where it ends;
* ``most``: to the section that holds most of its characters, the earlier one among equals.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, table

RULES = ("first", "last", "most")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_ENCODINGS: dict = {}


def encoding(ranks_file: str):
    """(encode, length in bytes of each token), once per worker process."""
    if ranks_file not in _ENCODINGS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(t) for t in ranks]
        coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _ENCODINGS[ranks_file] = coder.encode_ordinary, lengths
    return _ENCODINGS[ranks_file]


def line_starts(text: str) -> list[int]:
    """Sections are lines with their line feed."""
    return [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))]


def _first_bytes(text: str, starts: list[int]) -> np.ndarray:
    """Byte offsets of code-point offsets."""
    parts = [text[a:b] for a, b in zip([0, *starts], starts)]
    return np.cumsum([len(p.encode("utf-8")) for p in parts])


def attribute(text: str, starts: list[int], encode: Callable, lengths: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """For each section the number of tokens and how many of these cross a boundary. ``starts`` ascends from 0."""
    n = len(starts)
    if not text:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.cumsum(lengths[np.array(encode(text), np.int64)])
    begins = np.concatenate([[0], ends[:-1]])
    first_byte = _first_bytes(text, starts)
    a = np.searchsorted(first_byte, begins, "right") - 1
    z = np.searchsorted(first_byte, ends - 1, "right") - 1
    crossing = np.flatnonzero(a != z)
    to = a.copy()
    if rule == "last":
        to = z
    elif rule == "most" and len(crossing):
        raw = text.encode("utf-8")
        for i in crossing:
            share = []
            for s in range(a[i], z[i] + 1):
                lo = max(begins[i], first_byte[s])
                hi = min(ends[i], first_byte[s + 1] if s + 1 < n else ends[i])
                share.append(sum(x & 0xC0 != 0x80 for x in raw[lo:hi]))
            to[i] = a[i] + int(np.argmax(share))
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def token_counts(df: DataFrame, rule: str = "most", sections: Callable[[str], list[int]] = line_starts, ranks_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: id, section (from 0), start, end (code points, end exclusive), n_tokens, n_crossing.

    The counts of a document's sections add up to the whole document's tokens. Null and empty texts have one
    empty section. Repeated rows give repeated results, ids may be null, other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks_file = ranks_file or default_ranks()
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        encode, lengths = encoding(ranks_file)
        names = [id_col, "section", "start", "end", "n_tokens", "n_crossing"]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                row, cols = [], [[] for _ in range(5)]
                for i, text in enumerate(b.column(1).to_pylist()):
                    text = text or ""
                    starts = sections(text)
                    counts, crossing = attribute(text, starts, encode, lengths, rule)
                    row += [i] * len(starts)
                    for c, v in zip(cols, (range(len(starts)), starts, [*starts[1:], len(text)], counts.tolist(), crossing.tolist()), strict=True):
                        c.extend(v)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return in_arrow(df.select(id_col, F.col(text_col).cast("string")), run, f"`{id_col}` {kind}, section int, start long, end long, n_tokens long, n_crossing long")


def op6_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op6_token_counts": op6_token_counts}
