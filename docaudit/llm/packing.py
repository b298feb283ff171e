"""Vector bin packing of tokenised examples into training sequences.

Each example asks for tokens, one segment and loss-bearing tokens; a sequence offers a limited
amount of each. Tasks pack their own rows in one streaming pass: of a bounded window of waiting
pieces, the one whose demand has the largest dot product with what the open sequence has left
goes next. Nothing is shuffled, and each task leaves at most one sequence unfilled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.pretokens import Encoder, frequent
from docaudit.llm.token_counts import default_tokenizer

END = 1  # id that closes each example
WAITING = 1024  # pieces a task holds back for a choice


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


class Window:
    """Waiting pieces as columns, so that a choice is one vector operation."""

    def __init__(self, size: int):
        self.tokens, self.loss = np.zeros(size), np.zeros(size)
        self.piece: list = [None] * size
        self.free = list(range(size))

    def __len__(self) -> int:
        return len(self.piece) - len(self.free)

    def put(self, row: int, start: int, tokens: int, bears: bool) -> None:
        at = self.free.pop()
        self.tokens[at], self.loss[at], self.piece[at] = tokens, tokens * bears, (row, start, tokens, bears)

    def take(self, at: int):
        piece, self.piece[at], self.tokens[at], self.loss[at] = self.piece[at], None, 0, 0
        self.free.append(at)
        return piece


class Packer:
    """Places pieces (row, start, tokens, loss-bearing) and gives (row, start, tokens, sequence, offset)."""

    def __init__(self, limits: Limits, cut: bool, waiting: int = WAITING):
        if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
            raise ValueError("every limit is at least 1")
        self.limits, self.cut, self.window = limits, cut, Window(waiting + 1)
        self.sequence, self.held = 0, waiting

    def add(self, row: int, tokens: int, bears: bool) -> Iterator[tuple]:
        """Takes an example; what is longer than a sequence fills whole ones at once."""
        most = min(self.limits.tokens, self.limits.loss_tokens if bears else self.limits.tokens)
        start = 0
        while tokens - start >= most:
            yield row, start, most, self.sequence, 0
            self.sequence += 1
            start += most
        if tokens > start:
            self.window.put(row, start, tokens - start, bears)
        while len(self.window) > self.held:
            yield from self.closed(self.fill())

    def fill(self) -> list[tuple]:
        """Fills the next sequence from the window."""
        limits, window, placed = self.limits, self.window, []
        tokens, segments, loss = limits.tokens, limits.segments, limits.loss_tokens
        while tokens and segments and len(window):
            fits = (window.tokens > 0) & (window.tokens <= tokens) & (window.loss <= loss)
            if fits.any():
                gain = window.tokens * (tokens / limits.tokens**2) + window.loss * (loss / limits.loss_tokens**2) + segments / limits.segments**2
                row, start, n, bears = window.take(int(np.argmax(np.where(fits, gain, -1.0))))
            else:
                room = np.where(window.tokens > 0, np.where(window.loss > 0, min(tokens, loss), tokens), 0)
                at = int(np.argmax(room))
                if not self.cut or not room[at]:
                    break
                n = int(room[at])
                row, start, whole, bears = window.take(at)
                window.put(row, start + n, whole - n, bears)
            placed.append((row, start, n, self.sequence, limits.tokens - tokens))
            tokens, segments, loss = tokens - n, segments - 1, loss - n * bears
        self.sequence += 1
        return placed

    def closed(self, placed: list[tuple]) -> Iterator[tuple]:
        """A filled sequence; with `cut` one that is short becomes sequences of powers of two, which need no padding."""
        short = sum(n for _, _, n, _, _ in placed)
        if not self.cut or short == self.limits.tokens:
            yield from placed
            return
        room, offset, sequence = 1 << (short.bit_length() - 1), 0, placed[0][3]
        for row, start, n, _, _ in placed:
            while n:
                part = min(n, room - offset)
                yield row, start, part, sequence, offset
                row, start, n, offset, short = row, start + part, n - part, offset + part, short - part
                if offset == room:
                    room, offset, sequence = 1 << max(0, short.bit_length() - 1), 0, sequence + 1
        self.sequence = sequence + 1

    def finish(self) -> Iterator[tuple]:
        """Packs all that waits."""
        while len(self.window):
            yield from self.closed(self.fill())


COLUMNS = "start long, length long, loss_tokens long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_texts(df: DataFrame, key: str, text: str = "text", loss: Column | None = None, limits: Limits = Limits(), cut: bool = True, path: str | None = None) -> DataFrame:
    """One row for each piece of each example: the key, its place and its ids.

    `loss` says which rows bear loss on their tokens (all, if not given; null: none), as answers
    do in instruction data. Null texts are empty; an empty text is the end id alone. Examples
    longer than a sequence are cut; others only with `cut`. `ids` are unsigned little-endian
    32-bit numbers. Keys may be null or repeated: each row is an example of its own, and extra
    columns are left out. An empty table gives no rows.
    """
    tables = df.sparkSession.sparkContext.broadcast(frequent(path or default_tokenizer()))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.lit(True) if loss is None else loss, F.lit(False)).alias("bears"))
    kind = dict(rows.dtypes)["key"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, base = Encoder.of(tables.value), Packer(limits, cut), TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}  # row number: key, ids, ids not placed yet, bears
        out: list[tuple] = []
        number, key_type = 0, None

        def emit(places, flush=False):
            size = 0
            for row, start, n, sequence, offset in places:
                own = held[row]
                out.append((own[0], start, n, n * own[3], len(own[1]), base + sequence, offset, own[1][start : start + n].tobytes()))
                own[2] -= n
                if not own[2]:
                    del held[row]
                size += 1
            if len(out) >= 1000 or flush and out:
                columns = list(zip(*out))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.binary())], ["key", "start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            key_type = batch.schema.field("key").type
            for own, words, bears in zip(batch["key"], batch["text"], batch["bears"]):
                ids = np.append(encoder.ids(words.as_py()), np.uint32(END)).astype("<u4")
                held[number] = [own.as_py(), ids, len(ids), bears.as_py()]
                yield from emit(packer.add(number, len(ids), bears.as_py()))
                number += 1
        if number:
            yield from emit(packer.finish(), flush=True)

    return rows.mapInArrow(pack, f"key {kind}, {COLUMNS}").withColumnRenamed("key", key)
