"""Benchmark decontamination by canonical templates.

Numbers, units and names become typed placeholders, so a question with other values has the same
template. Whether the capitalised first word of a sentence is a name can't be told, so a text has
several views: with no names, with those within sentences, with every capitalised word; in the last
and in further ones a run of names or of number words is one placeholder ("Ann Lee", "twenty five"). Windows of template words are hash-joined with those of
the benchmark. The values behind the placeholders must then agree: within an occurrence of an item,
each value of the benchmark stands for one value of the document throughout. A document may hold an
item more than once, with other values each time; its best occurrence counts.

An item that has no window, being too short or almost wholly of placeholders, is looked up whole: by its
words, values included, where they stand between sentence ends.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.llm.common import row_hash, stored

WORDS = 5
LITERAL = 2  # words of a window that aren't placeholders
SIMILARITY = 0.8
BLOCK = 2  # block of a document, in lengths of the item: an occurrence spreads over at most one
CHARS_AT_ONCE = 50_000  # of the texts that are looked through together
ROWS_OF_ITEM = 1000  # windows of an item, for the number of files they are stored in
FILTER_WORDS = 1 << 16, 1 << 23  # 64-bit words of the filter that workers get: least and most (64 MiB)
BITS_A_WINDOW = 16  # of the filter, between these
WHOLE = -1  # the view of an item that is looked up whole

# fixed values
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent mph kmh kph degree degrees watt watts volt volts joule joules newton newtons hz khz mhz ghz b kb mb gb tb".split()
)

# words, numbers, ends of sentences, signs of units; the second for ASCII texts, where it finds the same
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:]|\n[ \t\r]*\n|[$€£%]")
ASCII_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+(?:[.,][0-9]+)*|[.!?:]|\n[ \t\r]*\n|[$%]")
PLAIN, NAME, NUMBER, UNIT, LETTER, STOP = range(6)
KIND = 7  # the low bits of a token's code hold its kind
HOLES = {NAME: 8 * 1, NUMBER: 8 * 2, UNIT: 8 * 3}  # codes of the placeholders
LAST_HOLE = max(HOLES.values())
FACTOR = 0x9E3779B97F4A7C15


class Templates:
    """Turns texts into template codes. Codes of words are kept, up to a bound."""

    def __init__(self, held: int = 1_000_000):
        self.codes: dict[str, int] = {}
        self.held = held

    def _code(self, token: str) -> int:
        lower = token.lower()
        if token in ".!?:" or token[0] == "\n":
            return STOP
        if token[0].isdigit() or lower in NUMBER_WORDS:
            kind = NUMBER
        elif lower in UNITS or token in "$€£%":
            kind = UNIT if len(token) > 1 or token in "$€£%" else LETTER
        else:
            kind = NAME if len(token) > 1 and token.istitle() else PLAIN
        return xxhash.xxh64_intdigest(lower) & ~KIND | kind

    def of(self, texts: list[str]) -> Parsed:
        """The words of some texts, one after the other, with their template codes."""
        each = [(ASCII_TOKEN if text.isascii() else TOKEN).findall(text) for text in texts]
        tokens = list(chain.from_iterable(each))
        if len(self.codes) > self.held:
            self.codes = {}
        try:
            codes = np.fromiter(map(self.codes.__getitem__, tokens), "u8", len(tokens))
        except KeyError:
            for token in set(tokens).difference(self.codes):
                self.codes[token] = self._code(token)
            codes = np.fromiter(map(self.codes.__getitem__, tokens), "u8", len(tokens))
        kinds = (codes & np.uint64(KIND)).astype("u1")
        words = kinds != STOP
        at = np.flatnonzero(words)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in each])[at]
        first = np.append(True, ~words[:-1])[at]  # of a sentence
        first[1:] |= text[1:] != text[:-1]
        plain, kinds = (codes & ~np.uint64(KIND))[at], kinds[at]
        number = kinds == NUMBER
        if number.any():
            inside = text[1:] == text[:-1]
            beside = np.append(False, number[:-1] & inside) | np.append(number[1:] & inside, False)
            plain[number] = HOLES[NUMBER]
            plain[(kinds == LETTER) & beside] = HOLES[UNIT]
        plain[kinds == UNIT] = HOLES[UNIT]
        named = kinds == NAME
        if not named.any():
            return Parsed(tokens, at, first, text, [View(plain)]).merged()
        views = [plain]
        for names in (named & ~first, named):
            views.append(plain.copy())
            views[-1][names] = HOLES[NAME]
        if (named & ~first).any():
            return Parsed(tokens, at, first, text, [View(views[1]), View(plain)]).merged(views[2])
        return Parsed(tokens, at, first, text, [View(plain)]).merged(views[2])


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


@dataclass(frozen=True)
class View:
    """Template codes of a text; `starts` and `ends` are the places of their words, if runs are merged."""

    codes: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def _merged(codes: np.ndarray, first: np.ndarray) -> View | None:
    """The codes with each run of names or of numbers within a sentence as one, if there is any."""
    again = np.append(False, codes[1:] == codes[:-1]) & ((codes == HOLES[NAME]) | (codes == HOLES[NUMBER])) & ~first
    if not again.any():
        return None
    starts = np.flatnonzero(~again)
    return View(codes[starts], starts, np.append(starts[1:], len(codes)))


@dataclass(frozen=True)
class Parsed:
    """The tokens of some texts, the places of the words, and their codes in each view.

    The first `word` views have a code for each word: with names within sentences as placeholders,
    if there are any, and without names.
    """

    tokens: list[str]
    at: np.ndarray
    first: np.ndarray  # whether a word starts a sentence
    text: np.ndarray  # the text that a word is of
    views: list[View]
    word: int = 0

    def merged(self, capitals: np.ndarray | None = None) -> Parsed:
        """With the views of merged runs, and that of every capitalised word as a placeholder."""
        more = [v for view in self.views if (v := _merged(view.codes, self.first))]
        if capitals is not None:
            more.append(_merged(capitals, self.first) or View(capitals))
        return Parsed(self.tokens, self.at, self.first, self.text, self.views + more, len(self.views))

    def whole(self, start: int, words: int) -> int:
        """Hash of a run of words as they are."""
        return _signed(xxhash.xxh64_intdigest("\x1f".join(self.tokens[w] for w in self.at[start : start + words]).lower()))

    def stretches(self, lengths: list[int]) -> Iterator[tuple[int, int]]:
        """(hash, start) of the runs of whole sentences with one of some numbers of words."""
        starts = np.flatnonzero(self.first)
        ends = {*starts.tolist(), len(self.at)}
        for start in starts.tolist():
            for words in lengths:
                if start + words in ends and self.text[start] == self.text[start + words - 1]:
                    yield self.whole(start, words), start

    def place(self, view: View, n: int) -> int:
        """Place of the first word of a window."""
        return int(n if view.starts is None else view.starts[n])

    def slots(self, view: View, start: int) -> list[str]:
        """Lower-case values behind the placeholders of a window, each after its kind."""
        out = []
        for n in range(start, start + WORDS):
            if view.codes[n] <= LAST_HOLE:
                words = (n,) if view.starts is None else range(view.starts[n], view.ends[n])
                out.append(f"{int(view.codes[n])}:{' '.join(self.tokens[self.at[w]] for w in words).lower()}")
        return out


def windows(parsed: Parsed, view: View) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of template codes, and whether it lies in one text and has enough words that aren't placeholders."""
    codes = view.codes
    text = parsed.text if view.starts is None else parsed.text[view.starts]
    count = len(codes) - WORDS + 1
    if count < 1:
        return np.zeros(0, "u8"), np.zeros(0, bool)
    hashes = codes[:count].copy()
    for n in range(1, WORDS):
        hashes *= np.uint64(FACTOR)
        hashes += codes[n : n + count]
    hashes ^= hashes >> np.uint64(29)
    inside = text[:count] == text[WORDS - 1 :]
    holes = codes <= LAST_HOLE
    if not holes.any():
        return hashes, inside
    sums = np.append(0, np.cumsum(holes))
    return hashes, inside & (sums[WORDS:] - sums[:-WORDS] <= WORDS - LITERAL)


ITEM = "hash long, item long, view int, place int, windows int, words int, held array<string>"


def benchmark_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """hash, item, view and place of each window of the benchmark, how many windows and words the item has, and the values in it.

    The views with a code for each word count as one, that of the most windows; each further one for itself.
    Windows almost wholly of placeholders are left out; an item without any window has one of all its words.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            rows = []
            for item, text_of in zip(batch["item"], batch["text"]):
                parsed, before = templates.of([text_of.as_py() or ""]), len(rows)
                for n_view, view in enumerate(parsed.views):
                    hashes, fit = windows(parsed, view)
                    own = max(0, n_view - parsed.word + 1)
                    rows += [(int(hashes[n].view("i8")), item.as_py(), own, parsed.place(view, n), int(fit.sum()), len(parsed.at), parsed.slots(view, n)) for n in np.flatnonzero(fit)]
                if len(rows) == before and len(parsed.at):
                    rows.append((parsed.whole(0, len(parsed.at)), item.as_py(), WHOLE, 0, 1, len(parsed.at), []))
            yield pa.RecordBatch.from_pylist([dict(zip(("hash", "item", "view", "place", "windows", "words", "held"), r)) for r in rows], pa.schema([("hash", pa.int64()), ("item", pa.int64()), ("view", pa.int32()), ("place", pa.int32()), ("windows", pa.int32()), ("words", pa.int32()), ("held", pa.list_(pa.string()))]))

    rows = benchmark.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, ITEM).distinct()


def _filter(items: DataFrame) -> np.ndarray:
    """A bit for each window hash of the benchmark, modulo the size of the filter, which follows their number up to a bound."""
    least, most = FILTER_WORDS
    size = min(most, max(least, 1 << (items.count() * BITS_A_WINDOW // 64).bit_length()))
    place = F.pmod("hash", F.lit(size * 64))
    parts = items.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(size, "i8")
    bits[parts["word"].to_numpy()] = parts["bits"].to_numpy()
    return bits.view("u8")


def _hits(parsed: Parsed, bits: np.ndarray, mask: np.uint64, lengths: list[int]) -> list[tuple]:
    """(text, hash, place in it, values) of the windows of texts that pass the filter, each once, in order."""
    seen, begins = set(), np.searchsorted(parsed.text, np.arange(int(parsed.text.max(initial=-1)) + 1))

    def add(found: int, place: int, held: tuple) -> None:
        text = int(parsed.text[place])
        seen.add((text, found, place - int(begins[text]), held))

    for view in parsed.views:
        hashes, fit = windows(parsed, view)
        low = hashes & mask
        hit = fit & ((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0)
        for n in np.flatnonzero(hit).tolist():
            add(int(hashes[n].view("i8")), parsed.place(view, n), tuple(parsed.slots(view, n)))
    for found, start in parsed.stretches(lengths) if lengths else ():
        low = found & int(mask)
        if int(bits[low >> 6]) >> (low & 63) & 1:
            add(found, start, ())
    return sorted(seen)


@F.arrow_udf(T.IntegerType())
def agreeing(found: pa.Array) -> pa.Array:
    """Places of an item that are found with values that agree throughout, in the best occurrence where positions are given."""
    return pa.array([_best(windows_.as_py()) for windows_ in found], pa.int32())


def _best(found: list[dict]) -> int:
    """The most agreeing places of an occurrence.

    An occurrence lies at each distance of a position in the document from its place in the item. It
    has, of each place, the windows nearest to that distance, so that words put in or left out don't end it.
    """
    lines: dict[int, dict[int, list[dict]]] = {}
    for window in found:
        if window["at"] is not None:
            lines.setdefault(window["place"], {}).setdefault(window["at"] - window["place"], []).append(window)
    shifts = sorted({shift for near in lines.values() for shift in near})
    if len(shifts) < 2:
        return _agreeing(found)
    of_place = {place: sorted(near) for place, near in lines.items()}
    best, tried = 0, set()
    for shift in shifts:
        chosen = []
        for place, held in of_place.items():
            n = bisect_left(held, shift)
            chosen.append((place, min(held[max(0, n - 1) : n + 1], key=lambda s: abs(s - shift))))
        if (key := tuple(chosen)) not in tried:
            tried.add(key)
            best = max(best, _agreeing([w for place, s in chosen for w in lines[place][s]]))
        if best == len(lines):
            break
    return best


def _agreeing(found: list[dict]) -> int:
    votes: dict[str, dict[str, int]] = {}
    for window in found:
        for ours, theirs in set(zip(window["held"], window["seen"])):
            votes.setdefault(ours, {}).setdefault(theirs, 0)
            votes[ours][theirs] += 1
    chosen = {ours: min(seen, key=lambda v: (-seen[v], v)) for ours, seen in votes.items()}
    return len({w["place"] for w in found if all(chosen[a] == b for a, b in zip(w["held"], w["seen"]))})


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """key, row_hash, item, matched, windows and similarity for each document and benchmark item it holds.

    A document holds an item if it has at least the share `similarity` of the item's windows, with
    values that agree, in an occurrence or anywhere in the document; matched and windows are those of
    the view that shares most. An occurrence spreads over at
    most BLOCK times the item's words; one with more words put in is only found if the values of the
    whole document agree. An item without a window, as of fewer than five words, is held where its words
    stand as they are between sentence ends. Null and empty texts hold nothing, and an item without
    words matches nothing; a null key stays null; equal rows give one pair; null item keys don't count. row_hash,
    of all columns, tells rows with equal keys apart. Documents aren't shuffled, only the few windows
    that pass a filter built from the benchmark; beyond 64 MiB of filter more pass, to the same result.
    """
    items = stored(benchmark_windows(benchmark, item_key, item_text), "windows", ROWS_OF_ITEM * benchmark.count())
    shared = documents.sparkSession.sparkContext.broadcast(_filter(items))
    lengths = sorted(r["words"] for r in items.where(F.col("view") == WHOLE).select("words").distinct().collect())
    rows = documents.select(row_hash(documents).alias("row_hash"), F.col(text).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, bits = Templates(), shared.value
        mask = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            rows, start = [], 0
            while start < batch.num_rows:
                texts, size = [], 0
                while start + len(texts) < batch.num_rows and size < CHARS_AT_ONCE:
                    texts.append(batch["text"][start + len(texts)].as_py() or "")
                    size += len(texts[-1])
                for n, found, at, held in _hits(templates.of(texts), bits, mask, lengths):
                    rows.append((batch["row_hash"][start + n].as_py(), found, at, list(held)))
                start += len(texts)
            columns = list(zip(*rows)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())))], ["row_hash", "hash", "at", "seen"])

    hits = rows.mapInArrow(look, "row_hash long, hash long, at int, seen array<string>")
    # each window counts for the whole document, without its position, and for the two blocks that overlap there
    block = F.floor(F.col("at") / (BLOCK * F.col("words")))
    sides = [F.struct(F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("at")), *(F.struct((block - n).alias("block"), F.col("at")) for n in (0, 1))]
    spread = hits.join(items, "hash").select("row_hash", "item", "view", "windows", "place", "held", "seen", F.inline(F.array(*sides)))
    groups = spread.groupBy("row_hash", "item", "view", "block").agg(F.max("windows").alias("windows"), F.collect_set(F.struct("place", "held", "seen", "at")).alias("found"))
    enough = groups.where(F.size("found") / F.col("windows") >= similarity)
    scored = enough.select("row_hash", "item", agreeing("found").alias("matched"), "windows").withColumn("similarity", F.col("matched") / F.col("windows"))
    best = scored.groupBy("row_hash", "item").agg(F.max(F.struct("similarity", "windows", "matched")).alias("best"))
    pairs = best.select("row_hash", "item", "best.matched", "best.windows", "best.similarity")
    kept = stored(pairs.where(F.col("similarity") >= similarity), "contaminated", documents.count())
    keys = documents.select(row_hash(documents).alias("row_hash"), F.col(key).alias("key"))
    return keys.join(kept, "row_hash").distinct().select("key", "row_hash", F.col("item").alias(item_key), "matched", "windows", "similarity")
