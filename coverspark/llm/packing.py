"""Cost-balanced packing of token sequences, in one pass without a shuffle.

A piece of n tokens costs ``linear * n + quadratic * n * n``, the second part for attention.  Documents are cut at the
capacity; what remains of each, in descending length, goes to the sequence of least cost that still has room for it,
and is cut only if none has.  Each task packs its own rows, group after group of a bounded number of tokens, so no row
moves and a lost task is simply run again.  In a task's last group the room is the exact number of tokens: what full
sequences leave over is held by sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverspark.llm.bpe import byte_characters
from coverspark.llm.common import tidy

#: The pattern by which a byte-level vocabulary of this kind splits text (fixed value of the file format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space as the pattern has it, and runs of it that are too long for the pattern's look-ahead.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = re.compile(f"[{WHITE}]{{1000,}}")


class ByteTokenizer:
    """The byte-level BPE of a tokenizers file: the library's ids, from ranks, several times as fast.

    The pattern gives a run of white space but its last character to one piece, and looks ahead from every place to do
    so.  Long runs are cut there beforehand, which leaves all pieces as they are.
    """

    def __init__(self, path: str):
        self.path = path
        self.ranks = _ranks(path)
        self.special = self.ranks._special_tokens

    def encode(self, text: str) -> np.ndarray:
        try:
            if not LONG.search(text):
                return self.ranks.encode_to_numpy(text, allowed_special="all")
            parts, at = [], 0
            for run in LONG.finditer(text):
                # at the text's end the whole run is a piece; else its last character belongs to what follows
                end = run.end() if run.end() == len(text) or self._special_at(text, run.end()) else run.end() - 1
                parts.append(self.ranks.encode_to_numpy(text[at : run.start()], allowed_special="all"))
                parts.append(np.array(self.ranks._core_bpe.encode_single_piece(text[run.start() : end].encode()), dtype=np.uint32))
                at = end
            parts.append(self.ranks.encode_to_numpy(text[at:], allowed_special="all"))
            return np.concatenate(parts)
        except (ValueError, UnicodeError):  # what the ranks' library refuses
            return np.array(_library(self.path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _special_at(self, text: str, at: int) -> bool:
        return any(text.startswith(s, at) for s in self.special)


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def _ranks(path: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def place(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Where each document's tokens go: (document, start, length, sequence, offset) with every token in one place.

    Full pieces of ``capacity`` tokens are sequences of their own. The rest goes in descending order to the cheapest
    sequence with room; rooms add up to the tokens there are.
    """
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    for d in np.flatnonzero(lengths >= capacity):
        for k in range(int(lengths[d]) // capacity):
            out.append((int(d), k * capacity, capacity, seq, 0))
            seq += 1
    rest = lengths % capacity
    full, over = divmod(int(rest.sum()), capacity)
    room = np.array([capacity] * full + [1 << b for b in range(over.bit_length() - 1, -1, -1) if over >> b & 1], dtype=np.int64)
    filled, cost = np.zeros_like(room), np.zeros(len(room))

    def put(d: int, start: int, n: int, s: int) -> None:
        out.append((d, start, n, seq + s, int(filled[s])))
        filled[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for d in np.argsort(-rest, kind="stable"):
        n, d = int(rest[d]), int(d)
        start = int(lengths[d]) - n
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                put(d, start, n, int(fits[np.argmin(cost[fits])]))
                break
            s = int(np.argmax(room))
            part = int(room[s])
            put(d, start, part, s)
            start, n = start + part, n - part
    return out


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 0.001,
    group_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``path`` is a byte-level BPE file, readable on every executor; each document's ids are followed by ``end_id``.
    Null and empty texts have that one id, and very long texts are encoded whole.  Rows are independent, so repeated
    rows are packed each, null ids pass through, and extra columns are not read.  Sequence ids are unique, not gapless; an empty table has no pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokenizer(path).encode
        first = TaskContext.get().partitionId() << 40
        held: list[tuple[object, np.ndarray]] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            sizes = np.array([len(x) for _, x in held], dtype=np.int64)
            rows = place(sizes, capacity, linear, quadratic)
            ids = [held[d][1][s : s + n].tobytes() for d, s, n, _, _ in rows]
            columns = list(zip(*rows, strict=True))
            number = lambda xs: pa.array(xs, pa.int64())
            made = [
                pa.array([held[d][0] for d in columns[0]], id_type),
                number(columns[1]),
                number(columns[2]),
                pa.array(ids, pa.binary()),
                number(sizes[list(columns[0])]),
                number([first + s for s in columns[3]]),
                number(columns[4]),
            ]
            first += 1 + max(columns[3])
            return pa.RecordBatch.from_arrays(made, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py() or ""
                ids = np.append(encode(text), end_id).astype("<u4")
                held.append((batch.column(0)[at].as_py(), ids))
                tokens += len(ids)
                if tokens >= group_tokens:
                    # all but the part that full sequences leave over is packed now
                    over = sum(len(x) % capacity for _, x in held) % capacity
                    rest: list[tuple[object, np.ndarray]] = []
                    while over and held and len(held[-1][1]) <= over:
                        rest.append(held.pop())
                        over = sum(len(x) % capacity for _, x in held) % capacity
                    if held:
                        yield packed()
                    held, tokens = rest[::-1], sum(len(x) for _, x in rest)
        if held:
            yield packed()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
