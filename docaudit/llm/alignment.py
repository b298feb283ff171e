"""Alignment of the tokens of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes. Every token points to its farthest-right overlapping token, and
successor doubling takes all tokens of a connected component to its last one, which labels the group.
Neither tokenizer joins a word with the white space after it, so a component lies within a unit (white
space and the word behind it): units are aligned once, many at a time, and kept on the worker.

How many documents hold an id pair is counted over the corpus. A bounded number of the most frequent
pairs is sent to the workers, which covers almost all links and all hot pairs; links of the other pairs
meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pieces_pb
from tokenizers import Tokenizer

from docaudit.llm.common import stored
from docaudit.llm.pretokens import Frequent, _bytes_of, frequent, ranked

FREQUENT = 500_000  # id pairs whose counts are sent to the workers: at most this many, whatever the corpus
HELD_UNITS = 300_000  # units a worker keeps
HELD_CHARS = 6_000_000  # and their characters
LEARNED_AT_ONCE = 1_000_000  # characters of units aligned in one go
SPACE = "▁"  # a space in the pieces

UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_WHITE = re.compile(r"[^\S \n]")  # white space that parts no units
JOINED = re.compile(rf"[^ \n{SPACE}][ \n{SPACE}]")


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: U+2581 as space, <0xHH> as the byte HH."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode("utf-8", "replace")


@dataclass(frozen=True)
class Tokenizers:
    """What is sent to the workers: both tokenizers as data."""

    first: Frequent
    second: bytes


class Aligned:
    """Aligned tokens of a batch of units: byte ends of both token rows, groups and links.

    `first` and `second` are the byte ends of the tokens in one running count over all units.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        n = len(first)
        over_first = n + np.searchsorted(second, first)  # the last second token over each first one
        over_second = np.searchsorted(first, second)
        ended = first[over_second] == second  # nothing reaches further right
        step = np.concatenate([over_first, np.where(ended, n + np.arange(len(second)), over_second)])
        while True:
            jumped = step[step]
            if np.array_equal(jumped, step):
                break
            step = jumped
        self.last = np.flatnonzero(ended)  # second tokens that end a group
        group = np.searchsorted(self.last, step - n)
        self.of_first, self.of_second = group[:n], group[n:]
        ends = np.union1d(first, second)  # each stretch between neighbouring ends lies in one token of either row: a link
        self.link_first, self.link_second = np.searchsorted(first, ends), np.searchsorted(second, ends)


class Aligner:
    """Aligns texts on a worker."""

    _own: tuple | None = None

    def __init__(self, tokenizers: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        table = tokenizers.first
        self.library = Tokenizer.from_str(table.vocabulary)
        self.library.encode_special_tokens = True  # their strings in a text are plain text
        model = json.loads(table.vocabulary)["model"]
        self.ranks = ranked(model) if table.plain else None
        self.strange = re.compile(f"[^{table.plain}]") if table.plain else None
        byte_of, names = _bytes_of(), self.library.get_vocab(with_added_tokens=True)
        self.first_bytes = [b""] * (max(names.values()) + 1)
        for entry, n in names.items():
            self.first_bytes[n] = b"".join(byte_of.get(c, c.encode()) for c in entry)
        spec = pieces_pb.ModelProto()
        spec.ParseFromString(tokenizers.second)
        self.prefixed = spec.normalizer_spec.add_dummy_prefix
        spec.normalizer_spec.add_dummy_prefix = False  # units come with the space before them
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        entries = [p.piece for p in spec.pieces]
        self.second_bytes = [piece_bytes(p) for p in entries]
        # units are safe if no piece goes on from a word into white space, and texts are normalised by no rule
        self.parted = self.ranks is not None and not any(map(JOINED.search, entries)) and spec.normalizer_spec.name == "identity" and not spec.normalizer_spec.remove_extra_whitespaces
        self.first_size, self.second_size = (np.array([len(b) for b in side], "i8") for side in (self.first_bytes, self.second_bytes))
        most = max(len(self.first_bytes), len(self.second_bytes))
        width = len(str(most))
        digits = [str(n) for n in range(most)]
        self.digit_count = np.array([len(d) for d in digits], "i8")
        self.digits = np.frombuffer("".join(d.ljust(width + 1) for d in digits).encode(), "u1").reshape(most, width + 1)
        self._forget()

    @classmethod
    def of(cls, tokenizers: Tokenizers) -> Aligner:
        """The process's own, with which the next tasks go on."""
        key = (tokenizers.first.vocabulary, tokenizers.second)
        if cls._own is None or cls._own[0] != key:
            cls._own = (key, cls(tokenizers))
        return cls._own[1]

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.written: list[str | None] = []  # the groups of each unit as text; None where the bytes differ
        self.counts = np.zeros((0, 3), "i8")  # tokens of either row and groups of each unit
        self.starts, self.links = np.zeros(1, "i8"), np.zeros(0, "i8")
        self.chars = 0

    def _first_ids(self, text: str) -> list[int]:
        if self.ranks is not None and (text.isascii() or not self.strange.search(text)):
            try:
                return self.ranks.encode_ordinary(text)
            except BaseException as failed:  # very long runs of spaces exhaust the pattern's stack
                if type(failed).__name__ != "PanicException":
                    raise
        return self.library.encode(text, add_special_tokens=False).ids

    def units(self, text: str) -> list[str]:
        """A text cut where neither tokenizer joins; whole where that isn't known."""
        if self.parted and not OTHER_WHITE.search(text) and (text.isascii() or not self.strange.search(text)):
            return UNIT.findall(text)
        return [text]

    def learn(self, units: list[str]) -> None:
        """Aligns units and keeps the results."""
        start, chars = 0, 0
        for end, unit in enumerate(units, 1):
            chars += len(unit)
            if chars >= LEARNED_AT_ONCE or end == len(units):
                self._learn(units[start:end])
                start, chars = end, 0

    def _learn(self, units: list[str]) -> None:
        first, second = [self._first_ids(u) for u in units], self.pieces.encode(units, num_threads=1)
        good = []
        for n, unit in enumerate(units):
            whole = unit.encode("utf-8", "replace")
            if b"".join(map(self.first_bytes.__getitem__, first[n])) == whole == b"".join(map(self.second_bytes.__getitem__, second[n])):
                good.append(n)
        counts, written, links = np.zeros((len(units), 3), "i8"), [None] * len(units), np.zeros(0, "i8")
        sizes = np.zeros(len(units), "i8")
        if good:
            ids = [np.fromiter(chain.from_iterable(side[n] for n in good), "i8") for side in (first, second)]
            lengths = [np.array([len(side[n]) for n in good], "i8") for side in (first, second)]
            found = Aligned(np.cumsum(self.first_size[ids[0]]), np.cumsum(self.second_size[ids[1]]))
            unit_of_first, unit_of_second = (np.repeat(np.arange(len(good)), k) for k in lengths)
            groups = np.bincount(unit_of_second[found.last], minlength=len(good))
            counts[good] = np.stack([*lengths, groups], axis=1)
            for n, text in zip(good, self._written(found, *ids, unit_of_second)):
                written[n] = text
            links = ids[0][found.link_first] * len(self.second_bytes) + ids[1][found.link_second]
            sizes[good] = np.bincount(unit_of_first[found.link_first], minlength=len(good))
        for unit in units:
            self.place[unit] = len(self.place)
        self.written += written
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        self.links = np.append(self.links, links)
        self.chars += sum(map(len, units))

    def _written(self, found: Aligned, first: np.ndarray, second: np.ndarray, unit_of_second: np.ndarray) -> list[str]:
        """The groups of each unit as a1,a2|b1;a3|b2,b3."""
        n, groups = len(first), len(found.last)
        until = np.searchsorted(found.of_first, np.arange(groups), side="right")  # first tokens up to each group's end
        before = np.append(0, found.last[:-1] + 1)  # second tokens before each group
        place_first, place_second = np.arange(n) + before[found.of_first], np.arange(len(second)) + until[found.of_second]
        ids, mark = np.empty(n + len(second), "i8"), np.full(n + len(second), ord(","), "u1")
        ids[place_first], ids[place_second] = first, second
        mark[place_first[until - 1]] = ord("|")
        ends = place_second[found.last]
        mark[ends] = np.where(np.append(unit_of_second[found.last][1:] != unit_of_second[found.last][:-1], True), ord("\n"), ord(";"))
        cells, size = self.digits[ids], self.digit_count[ids]
        cells[np.arange(len(ids)), size] = mark
        return cells[np.arange(cells.shape[1]) <= size[:, None]].tobytes().decode("ascii").split("\n")[:-1]

    def align(self, texts: list[str | None]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, digest, id pairs and how often each is linked, for each text."""
        if len(self.place) > HELD_UNITS or self.chars > HELD_CHARS:
            self._forget()
        cut = [self.units(" " + text) if text and self.prefixed else [] for text in texts]
        new = set(chain.from_iterable(cut)).difference(self.place)
        if new:
            self.learn(sorted(new))
        return [self._text(units) for units in cut]

    def _text(self, units: list[str]) -> tuple:
        nothing = (0, 0, 0, 0, "", np.zeros(0, "i8"), np.zeros(0, "i4"))
        places = list(map(self.place.__getitem__, units))
        written = list(map(self.written.__getitem__, places))
        if not units or None in written:
            return nothing
        kinds, often = np.unique(np.array(places, "i8"), return_counts=True)
        first, second, groups = (often @ self.counts[kinds]).tolist()
        sizes = self.starts[kinds + 1] - self.starts[kinds]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[kinds] - np.cumsum(sizes) + sizes, sizes)
        pairs, back = np.unique(self.links[at], return_inverse=True)
        times = np.bincount(back, np.repeat(often, sizes)).astype("i4")
        digest = hashlib.sha256(";".join(written).encode("ascii")).hexdigest()
        return first, second, groups, int(often @ sizes), digest, pairs, times


CHUNK_CHARS = 1_000_000  # characters of texts aligned together
ROWS_OUT = 2_000


def tokenizers(first: str | None = None, second: str | None = None) -> Tokenizers:
    """Both tokenizers from their files: a byte-level BPE (.json) and pieces (.model)."""
    import public_tokenizers

    with open(second or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return Tokenizers(frequent(first or public_tokenizers.path("byte_bpe_50k.json")), file.read())


def aligned_texts(df: DataFrame, key: str = "doc_id", text: str = "text", both: Tokenizers | None = None) -> DataFrame:
    """row, key, n_a, n_b, n_groups, n_links, groups_sha256, the distinct id pairs and how often each is linked.

    A pair of ids a and b is a * (number of second ids) + b. `row` tells rows with equal keys apart.
    """
    shared = df.sparkSession.sparkContext.broadcast(both or tokenizers())
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]
    names = ("row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")

    def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, values)]).astype("i4")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0), kind))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner.of(shared.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, texts = batch["key"], batch["text"]
            start = 0
            while start < len(keys):
                part, chars = [], 0
                while start + len(part) < len(keys) and chars < CHUNK_CHARS and len(part) < ROWS_OUT:
                    part.append(texts[start + len(part)].as_py())
                    chars += len(part[-1] or "")
                columns = list(zip(*aligner.align(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(part))), keys.slice(start, len(part)), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), lists(columns[5], pa.int64()), lists(columns[6], pa.int32())],
                    names,
                )
                start, row = start + len(part), row + len(part)

    return rows.mapInArrow(align, f"row long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame, second_ids: int) -> DataFrame:
    """pair, docs (documents that hold it linked) and best (whether that is the highest of its first id)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")).withColumn("a", F.floor(F.col("pair") / second_ids))
    counts = stored(counts, "pairs")
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))
    return counts.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best"))


def cross_alignment(df: DataFrame, key: str = "doc_id", text: str = "text", both: Tokenizers | None = None, most: int = FREQUENT) -> DataFrame:
    """The key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row.

    Tokens of both rows are those of a space and the text. Null and empty texts, and texts whose
    tokens don't give back their bytes, have zeros and an empty digest. Special strings are plain
    text. Each row counts as a document: rows with null or repeated keys, and equal rows, stay apart.
    Other columns are left out; an empty table gives no rows. `most` bounds how many pairs are sent
    to the workers; it changes no result. A very long text is aligned unit by unit as others are,
    unless it holds characters the two tokenizers may sort differently: then it is one unit.
    """
    both = both or tokenizers()
    spec = pieces_pb.ModelProto()
    spec.ParseFromString(both.second)
    aligned = stored(aligned_texts(df, key, text, both), "aligned")
    counts = stored(pair_counts(aligned, len(spec.pieces)), "pair-counts")
    top = counts.orderBy(F.desc("docs"), "pair").limit(most).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    table = (top["pair"].to_numpy()[order], top["docs"].to_numpy()[order], top["best"].to_numpy(zero_copy_only=False)[order])
    shared = df.sparkSession.sparkContext.broadcast(table)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = shared.value
        for batch in (whole.slice(n, ROWS_OUT) for whole in batches for n in range(0, whole.num_rows, ROWS_OUT)):
            pairs, times = batch["pairs"].flatten().to_numpy(), batch["times"].flatten().to_numpy().astype("i8")
            sizes = batch["pairs"].value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = [np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8")]
            np.add.at(sums[0], row[hit], best[at[hit]] * times[hit])
            np.add.at(sums[1], row[hit], docs[at[hit]] * times[hit])
            ends = np.append(0, np.cumsum(np.bincount(row[~hit], minlength=len(sizes)))).astype("i4")
            rest = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(pairs[~hit]), pa.array(times[~hit])], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([batch["row"], *map(pa.array, sums), rest], ["row", "n_best", "count_sum", "rest"])

    weighed = aligned.select("row", "pairs", "times").mapInArrow(weigh, "row long, n_best long, count_sum long, rest array<struct<pair: long, times: long>>")
    weighed = stored(weighed, "weighed")
    rare = weighed.select("row", F.inline("rest")).join(counts, "pair")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more"))
    summed = weighed.drop("rest").join(rare, "row", "left")
    total = summed.select("row", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"))
    found = aligned.drop("pairs", "times").join(total, "row")
    return found.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
