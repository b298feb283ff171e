"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over the distinct words of a text and their first letters is fitted on a bounded
sample of labelled rows. Every labelled text that mentions groups has counterparts: the same text with
all its mentions swapped, once for the next group of the same kind and once for a neutral word. They
should score alike: the fit penalises the squared change of the text's score. So a group's name gains
no weight of its own from the company it keeps in the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: names of groups by kind, in English, French, German and Spanish; the first of each line is the neutral word
IDENTITY = (
    "person woman women man men girl girls boy boys female male nonbinary transgender trans",
    "person gay lesbian bisexual queer homosexual heterosexual straight",
    "person muslim muslims christian christians jewish jew jews hindu hindus buddhist buddhists atheist atheists catholic catholics protestant sikh",
    "person african asian european american arab latino latina hispanic mexican chinese indian black white immigrant immigrants refugee refugees foreigner foreigners",
    "person disabled deaf blind autistic",
    "person old young elderly teenager teenagers",
    "personne femme femmes homme hommes fille filles garçon garçons",
    "personne gai lesbienne bisexuel homosexuel homosexuelle hétérosexuel",
    "personne musulman musulmane musulmans chrétien chrétienne chrétiens juif juive juifs hindou bouddhiste athée catholique protestant",
    "personne africain africaine asiatique européen américain arabe mexicain chinois indien noir noire blanc blanche immigré immigrés réfugié réfugiés étranger étrangers",
    "personne handicapé handicapée sourd aveugle autiste",
    "personne vieux vieille jeune jeunes âgé adolescent",
    "mensch frau frauen mann männer mädchen junge jungen",
    "mensch schwul schwuler lesbisch lesbe bisexuell homosexuell heterosexuell",
    "mensch muslim muslime muslimin christ christen jude juden jüdisch hindu buddhist atheist katholik protestant",
    "mensch afrikaner asiate europäer amerikaner araber mexikaner chinese inder schwarzer weißer einwanderer flüchtling flüchtlinge ausländer",
    "mensch behindert behinderter taub blinder autist",
    "mensch alter alte junger jugendlicher",
    "persona mujer mujeres hombre hombres chica chicas chico chicos",
    "persona gay lesbiana bisexual homosexual heterosexual",
    "persona musulmán musulmana musulmanes cristiano cristiana cristianos judío judía judíos hindú budista ateo católico protestante",
    "persona africano africana asiático europeo americano árabe mexicano chino indio negro negra blanco blanca inmigrante inmigrantes refugiado refugiados extranjero extranjeros",
    "persona discapacitado discapacitada sordo ciego autista",
    "persona viejo vieja joven jóvenes anciano adolescente",
)

FIT_ROWS = 10_000
STARTS = (4, 5)
WORD = re.compile(r"[^\W\d_]+")


def parts_of(word: str) -> Iterator[str]:
    """A word and its starts, which inflected and compound forms share."""
    yield word
    for size in STARTS:
        if len(word) > size:
            yield word[:size] + "-"


def features(text: str) -> set[str]:
    """Distinct words and starts of words, lower case."""
    return {part for word in set(WORD.findall(text.lower())) for part in parts_of(word)}


def swaps() -> tuple[dict[str, str], dict[str, str]]:
    """What takes the place of each group's name: the next of its kind, and the neutral word. A name's first line counts."""
    after, plain = {}, {}
    for line in IDENTITY:
        neutral, *kind = line.split()
        for at, word in enumerate(kind):
            after.setdefault(word, kind[(at + 1) % len(kind)])
            plain.setdefault(word, neutral)
    return after, plain


def counterparts(found: set[str]) -> Iterator[set[str]]:
    """The features of a text's counterparts, from its own; none if it mentions no group.

    Features hold every distinct word, so that they are those of the text with the mentions swapped.
    """
    words = {part for part in found if not part.endswith("-")}
    for swap in swaps():
        if not words.isdisjoint(swap):
            yield {part for word in words for part in parts_of(swap.get(word, word))}


@dataclass(frozen=True)
class Model:
    """Weights of features; others weigh nothing."""

    bias: float
    weights: dict[str, float]


class Scorer:
    """Scores texts on a worker. Words are looked up once; what is kept of them is bounded."""

    def __init__(self, model: Model, held: int = 1_000_000):
        self.model, self.held = model, held
        self.plain: set[str] = set()
        self.weighty: dict[str, list[str]] = {}

    def score(self, text: str) -> float:
        words = set(WORD.findall(text.lower()))
        if len(self.plain) + len(self.weighty) > self.held:
            self.plain, self.weighty = set(), {}
        for word in words - self.plain:
            if word not in self.weighty:
                found = [part for part in parts_of(word) if part in self.model.weights]
                if found:
                    self.weighty[word] = found
                else:
                    self.plain.add(word)
        parts = {part for word in words - self.plain for part in self.weighty[word]}
        raw = self.model.bias + sum(self.model.weights[part] for part in sorted(parts))
        return float(1 / (1 + np.exp(-max(-35.0, min(35.0, raw)))))


def surprise(both: np.ndarray, seen: np.ndarray, positive: int, rows: int) -> np.ndarray:
    """Log-likelihood ratio of each feature and label 1, zero where the feature speaks for label 0."""

    def part(found, expected):
        return np.where(found > 0, found * np.log(np.maximum(found, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    total = part(both, seen * positive / rows) + part(seen - both, seen * (rows - positive) / rows)
    total = total + part(positive - both, (rows - seen) * positive / rows) + part(rows - seen - positive + both, (rows - seen) * (rows - positive) / rows)
    return np.where(both * rows > seen * positive, 2 * total, 0.0)


class Coded:
    """The features of some texts as numbers: `names`, and the text (`row`) and name (`column`) of each feature."""

    def __init__(self, texts: pa.ListArray):
        coded = texts.flatten().dictionary_encode()
        self.names, self.column = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        self.ends = np.append(0, np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False)))
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.ends))

    def changes(self) -> Iterator[tuple[int, list[tuple[str, int]]]]:
        """For each counterpart its text and the features that come (1) and go (-1). Texts without a mention aren't looked at."""
        terms = set().union(*swaps())
        mentioned = np.array([name in terms for name in self.names], bool)[self.column] if self.names else np.zeros(0, bool)
        for at in np.unique(self.row[mentioned]).tolist():
            own = {self.names[n] for n in self.column[self.ends[at] : self.ends[at + 1]]}
            for other in counterparts(own):
                yield at, [(part, sign) for sign, parts in ((1, other - own), (-1, own - other)) for part in sorted(parts)]


class Sample:
    """Labelled texts and their counterparts as numbers; the last weight is the bias."""

    def __init__(self, coded: Coded, labels: np.ndarray, names: list[str], changes: list[tuple[int, list[tuple[str, int]]]]):
        self.labels, self.size = np.asarray(labels, float), len(names)
        place = {name: n for n, name in enumerate(names)}
        own = np.array([place.get(name, -1) for name in coded.names], "i8")[coded.column] if coded.names else np.zeros(0, "i8")
        self.row, self.column = coded.row[own >= 0], own[own >= 0]
        self.of = np.array([at for at, _ in changes], "i8")  # the text of each counterpart
        moves = [(number, place[part], sign) for number, (_, parts) in enumerate(changes) for part, sign in parts if part in place]
        self.other, self.moved, self.sign = (np.array(x, "i8") for x in (zip(*moves) if moves else ([], [], [])))

    def loss(self, weights: np.ndarray, l2: float, swap: float) -> tuple[float, np.ndarray]:
        """Mean log loss, ridge and mean squared change of the score between texts and counterparts; with the slope."""
        y, n, size = self.labels, len(self.labels), self.size
        raw = np.bincount(self.row, weights[self.column], n) + weights[-1]
        p = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
        each = (p - y) / n
        total = float(np.mean(np.logaddexp(0, raw) - y * raw)) + l2 / 2 * float(weights[:-1] @ weights[:-1])
        slope = np.append(np.bincount(self.column, each[self.row], size) + l2 * weights[:-1], each.sum())
        if len(self.of) and swap:
            changed = raw[self.of] + np.bincount(self.other, self.sign * weights[self.moved], len(self.of))
            q = 1 / (1 + np.exp(-np.clip(changed, -35, 35)))
            change = q - p[self.of]
            total += swap * float(np.mean(change**2))
            by_other = 2 * swap / len(self.of) * change * q * (1 - q)
            by_text = np.bincount(self.of, by_other - 2 * swap / len(self.of) * change * (p * (1 - p))[self.of], n)
            slope[:-1] += np.bincount(self.column, by_text[self.row], size) + np.bincount(self.moved, self.sign * by_other[self.other], size)
            slope[-1] += by_text.sum()
        return total, slope


def fit(texts: pa.ListArray, labels: np.ndarray, least: float = 15.0, l2: float = 2e-5, swap: float = 20.0, rounds: int = 400) -> Model:
    """Fits the model on the features of labelled texts, by full-batch gradient steps of adaptive size.

    Features are those tied to label 1 by a log-likelihood ratio of `least` or more, and those in
    which texts and counterparts differ; their weights aren't negative, so that harmless text around
    an insult can't outweigh it. Without rows, or with one label only, the model gives the smoothed
    rate of label 1 to any text.
    """
    y = np.asarray(labels, float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(rate / (1 - rate)))
    if len(set(y)) < 2:
        return Model(start, {})
    coded = Coded(texts)
    seen, toxic = np.bincount(coded.column, minlength=len(coded.names)), np.bincount(coded.column, y[coded.row], len(coded.names))
    ratio = surprise(toxic, seen.astype(float), int(y.sum()), len(y))
    changes = list(coded.changes())
    kept = sorted({coded.names[n] for n in np.flatnonzero(ratio >= least)}.union(part for _, parts in changes for part, _ in parts))
    sample = Sample(coded, y, kept, changes)
    weights, first, second = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    weights[-1] = start
    for step in range(1, rounds + 1):
        slope = sample.loss(weights, l2, swap)[1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights - 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights[:-1] = np.maximum(weights[:-1], 0)
    return Model(float(weights[-1]), {name: float(w) for name, w in zip(kept, weights) if w > 1e-3})


@F.arrow_udf(T.ArrayType(T.StringType()))
def text_features(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(features(text.as_py() or "")) for text in texts], pa.list_(pa.string()))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fits the model on labelled rows: on all of them, or on `rows` drawn by a hash of the key.

    Rows without key or label don't count; a key labelled more than once takes its largest label.
    The draw bounds what is broadcast and what reaches the driver; documents aren't shuffled.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("__label"))
    drawn = known.orderBy(F.xxhash64("__key"), "__key").limit(rows)
    texts = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(drawn), "__key")
    found = texts.select(text_features("__text").alias("features"), "__label").orderBy(F.xxhash64("features"), "__label").limit(rows).toArrow()
    return fit(found["features"].combine_chunks(), found["__label"].to_numpy())


def score_toxicity(documents: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from the threshold on) to every row.

    Null texts score as empty ones, repeated rows alike. Only the text is an input. Columns of
    these names are replaced, others stay; an empty table stays empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array([scorer.score(text.as_py() or "") for text in texts], pa.float64())

    return documents.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
