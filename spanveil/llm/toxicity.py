"""Toxicity scores from a learned lexicon, misspellings and context windows.

1. Lexicon. Words of labelled texts are counted by the number of distinct
   neighbourhoods (the words before and after) they have in toxic and in other
   texts, so copies of one text count once. Words that are far commoner in toxic
   texts, and surely so, are terms; beginnings of words of which the same holds
   are stems.
2. Matching. The terms form a trie. A Levenshtein automaton for every term at
   once is run over it: its states are sets of (trie node, errors), made when
   they are first met. It accepts words within one edit of a term (two from
   LONG letters on); a swap of neighbours is one edit. Words near a term that are
   known from clean texts are innocent. Terms of three letters have to be met
   exactly.
3. Context. Each hit is scored in a window of WINDOW words on each side: quotation
   marks around it or a word of saying before it mark a quotation, which counts
   for QUOTED of an abuse.
4. A logistic model of the summed hits turns them into a score.

Bounds: FIT_ROWS toxic and FIT_ROWS other labelled rows, chosen by hash of their
ids, are learned from; so the lexicon, all words that pass the tests, is bounded
and travels with the tasks. All texts are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.quality import fold_of
from spanveil.llm.tables import saved, slices
from spanveil.llm.tokens import Kept

FIT_ROWS = 5_000
# A term has at least so many neighbourhoods in toxic texts, and this share of all of them.
MIN_PLACES, MIN_SHARE = 3, 0.9
# A stem has at least so many letters and so many terms.
MIN_SURENESS = 14
STEM_LETTERS, STEM_TERMS, STEM_WEIGHT = 4, 5, 0.8
SHORT, LONG = 4, 8
WINDOW = 6
QUOTED = 0.3
# Automaton steps that a task keeps; the store is emptied when it is full.
STEPS = 300_000

# Marks of quotation, and words of saying in four languages.
MARKS = "\"“”„«»‘‹›"
SAYING = frozenset(
    "said says say called calls quote quoted word words term terms wrote writes "
    "sagte sagt nannte nennt wort zitat schrieb dit disait appelle mot terme citation écrit "
    "dijo dice llama llamó palabra término cita escribió".split()
)


@dataclass
class Lexicon:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    innocent: set[str] = field(default_factory=set)  # near a term, but known from clean texts
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))


def allowed(term: str) -> int:
    return 0 if len(term) < SHORT else 1 if len(term) < LONG else 2


class Automaton:
    """All terms' Levenshtein automata, intersected with their trie and made deterministic as needed.

    An NFA place is a trie node with the letter still owed after a swap, if any;
    a state maps places to the fewest errors spent. ``find`` gives the nearest
    term and its distance.
    """

    def __init__(self, terms: Iterable[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room = [0]  # errors that some term below the node allows
        for term in sorted(terms):
            node, most = 0, allowed(term)
            self.room[0] = max(self.room[0], most)
            for letter in term:
                if letter not in self.child[node]:
                    self.child[node][letter] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.room.append(0)
                node = self.child[node][letter]
                self.room[node] = max(self.room[node], most)
            self.term[node] = term
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.made = 0
        self.start = self._state({(0, ""): 0})

    def _state(self, places: dict[tuple[int, str], int]) -> int:
        """The number of a state, after adding nodes reached by letters that the word lacks; -1 if it is dead."""
        todo = list(places.items())
        while todo:
            (node, owed), errors = todo.pop()
            if owed:
                continue
            for below in self.child[node].values():
                if errors + 1 <= self.room[below] and places.get((below, ""), 9) > errors + 1:
                    places[below, ""] = errors + 1
                    todo.append(((below, ""), errors + 1))
        if not places:
            return -1
        key = tuple(sorted(places.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            ends = [(e, t) for (node, owed), e in key if not owed and (t := self.term[node]) is not None and e <= allowed(t)]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[tuple[int, str], int] = {}

        def put(node: int, owed: str, errors: int) -> None:
            if errors <= self.room[node] and after.get((node, owed), 9) > errors:
                after[node, owed] = errors

        for (node, owed), errors in self.states[state]:
            if owed:
                if owed == letter:
                    put(node, "", errors)
                continue
            put(node, "", errors + 1)  # a letter too many
            for other, below in self.child[node].items():
                put(below, "", errors + (other != letter))
                if other != letter and letter in self.child[below]:
                    put(self.child[below][letter], other, errors + 1)  # two letters swapped
        return self._state(after)

    def find(self, word: str) -> tuple[str, int] | None:
        state = self.start
        for letter in word:
            following = self.steps[state].get(letter)
            if following is None:
                if self.made >= STEPS:
                    self._reset()
                    return self.find(word)
                following = self.steps[state][letter] = self._step(state, letter)
                self.made += 1
            if following < 0:
                return None
            state = following
        return self.accepts[state]


WORDS = re.compile(r"[^\W\d_]+")


class Judge:
    """Feature rows of texts by a lexicon; made once per task."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.terms = lexicon.terms
        self.stems = lexicon.stems
        self.innocent = lexicon.innocent
        self.automaton = Automaton(lexicon.terms)
        self.sizes = sorted({len(s) for s in lexicon.stems})
        self.hit = Kept(self._hit)

    def _hit(self, word: str) -> float | None:
        """Weight of a term, of a word with a stem, or of a misspelt term."""
        if word in self.terms:
            return self.terms[word]
        for size in self.sizes:
            if word[:size] in self.stems:
                return self.stems[word[:size]]
        near = None if word in self.innocent else self.automaton.find(word)
        return self.terms[near[0]] / (1 + near[1]) if near else None

    def of(self, text: str) -> list[float]:
        """Summed abuse, the surest single hit, abuse per word; the first and last as logarithms."""
        words = WORDS.findall(text := text.lower())
        hits = list(map(self.hit.__getitem__, words))
        surest = total = 0.0
        if any(hits):
            places = [m.span() for m in WORDS.finditer(text)]
            for i, weight in enumerate(hits):
                if weight:
                    weight *= self._context(text, words, places, i)
                    surest = max(surest, weight)
                    total += weight
        return [np.log1p(total), surest, np.log1p(100 * total / max(len(words), 1))]

    def _context(self, text: str, words: list[str], places: list[tuple[int, int]], i: int) -> float:
        first, last = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
        before = text[places[first][0] : places[i][0]]
        after = text[places[i][1] : places[last][1] + 1]
        marked = any(m in before for m in MARKS) and any(m in after for m in MARKS)
        said = not SAYING.isdisjoint(words[first:i])
        return QUOTED if marked or said else 1.0


def _places(docs: DataFrame) -> DataFrame:
    """Distinct (word, neighbourhood, toxic, part) of the chosen texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 2):
            seen: set[tuple[str, str, int, int]] = set()
            for toxic, part, text in zip(*(piece.column(i).to_pylist() for i in range(3))):
                words = ["", *WORDS.findall(text.lower()), ""]
                seen.update((w, f"{a} {b}", toxic, part) for a, w, b in zip(words, words[1:], words[2:]))
            columns = list(zip(*seen)) or [(), (), (), ()]
            types = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "around", "toxic", "part"])

    rows = docs.select("_toxic", "_part", F.col("_text").cast("string"))
    return rows.mapInArrow(run, "word string, around string, toxic int, part int")


def _sure(toxic: Column, other: Column, base: float) -> Column:
    """Share and chance tests: common in toxic texts only, and not by accident.

    With n = toxic + other places, n * KL(toxic / n, base) bounds the logarithm
    of the chance to see so many toxic ones.
    """
    toxic, other, p = toxic.cast("double"), other.cast("double"), F.lit(base)
    n = toxic + other
    part = lambda x, q: F.when(x > 0, x * F.log(x / n / q)).otherwise(0.0)
    fair = toxic / p
    return (fair >= MIN_SHARE * (fair + other / (1 - p))) & (part(toxic, p) + part(other, 1 - p) >= MIN_SURENESS)


def _lexicon(words: DataFrame, toxic: str, other: str, base: float) -> Lexicon:
    """Terms, stems and innocent words from a table of (word, toxic places, other places)."""
    t, o = F.col(toxic), F.col(other)
    odds = F.round(F.log((t / base + 0.5) / (o / (1 - base) + 0.5)), 6)
    rows = (
        words.where((t >= MIN_PLACES) & (F.length("word") > 2) & _sure(t, o, base))
        .select("word", odds.alias("odds")).orderBy(F.desc("odds"), "word").collect()
    )
    terms = {r.word: min(max(r.odds, 0.6), 6.0) / 6 for r in rows}
    prefixes = F.transform(F.sequence(F.lit(STEM_LETTERS), F.lit(STEM_LETTERS + 4)), lambda n: F.substring("word", F.lit(1), n))
    pooled = (
        words.where((F.length("word") >= STEM_LETTERS) & (t + o > 0))
        .select("word", t, o, F.explode(F.array_distinct(prefixes)).alias("stem"))
        .groupBy("stem").agg(F.sum(t).alias("t"), F.sum(o).alias("o"), F.count("*").alias("n"), F.max(t).alias("most"))
        .where((F.col("n") >= STEM_TERMS) & (F.col("most") * 2 <= F.col("t")) & (F.col("t") >= MIN_PLACES) & _sure(F.col("t"), F.col("o"), base))
        .orderBy(F.length("stem"), F.desc("t"), "stem").collect()
    )
    pure = {r.stem for r in pooled}
    stems = {x: STEM_WEIGHT for x in pure if not any(x[:n] in pure for n in range(STEM_LETTERS, len(x)))}
    found = Lexicon(terms, stems)
    if terms:

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(terms)
            for batch in batches:
                near = [w for w in batch.column(0).to_pylist() if w not in terms and automaton.find(w)]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["word"])

        others = words.where((o > 0) & (o >= t)).select("word").mapInArrow(close, "word string")
        found.innocent = {r.word for r in others.collect()}
    return found


def _logistic(features: np.ndarray, toxic: np.ndarray, base: float) -> np.ndarray:
    """Weights (last: constant) of a logistic model; rows count so that toxic ones have share ``base``."""
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(base / (1 - base))
    found = max(toxic.mean(), 1e-9) if len(toxic) else 0
    if not 0 < found < 1:
        return w
    rows = np.where(toxic == 1, base / found, (1 - base) / (1 - found))
    shrink = np.array([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (rows * (p - toxic)) + shrink * w
        bend = (x * (rows * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(shrink)
        w = w - np.linalg.solve(bend, slope)
    # Hits never speak for a clean text.
    w[:-1] = np.maximum(w[:-1], 0)
    return w


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2
) -> Lexicon:
    """Learns from labelled rows whose fold is not ``held_out``.

    ``labels`` has the id and ``toxic`` (1, 0, or null for unknown). Of several
    labels of one id, one that says toxic counts. The model's weights come from
    a third of the rows, judged by the lexicon of the other two thirds; the
    lexicon in use is that of all. Without toxic labels it is empty.
    """
    trained = F.coalesce(fold_of("_id", folds) != held_out, F.lit(False))
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .where(F.col("_toxic").isNotNull() & trained)
        .groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    )
    toxic, every = known.agg(F.sum(F.col("_toxic").cast("long")), F.count("*")).first()
    base = min(max((toxic or 0) / max(every, 1), 1e-3), 1 - 1e-3)
    by_hash = F.xxhash64(F.col("_id"), F.lit("toxicity"))
    kinds = [known.where(F.col("_toxic") == x).orderBy(by_hash, "_id").limit(FIT_ROWS) for x in (1, 0)]
    # At most 2 * FIT_ROWS ids, so the texts stay where they are.
    chosen = kinds[0].union(kinds[1]).withColumn("_part", F.pmod(F.xxhash64(F.col("_id"), F.lit("part")), F.lit(3)).cast("int"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sample = texts.join(F.broadcast(chosen), "_id")
    count = lambda x, p: F.count_if((F.col("toxic") == x) & p)
    two_thirds, every_part = F.col("part") != 0, F.lit(True)
    words = saved(
        _places(sample).distinct().groupBy("word")
        .agg(count(1, every_part).alias("t"), count(0, every_part).alias("o"), count(1, two_thirds).alias("t2"), count(0, two_thirds).alias("o2")),
        "toxicity-words",
    )
    among = words.agg(*(F.sum(x).alias(x) for x in ("t", "o", "t2", "o2"))).first()
    share = lambda t, o: min(max((t or 0) / max((t or 0) + (o or 0), 1), 1e-3), 1 - 1e-3)
    lexicon = _lexicon(words, "t", "o", share(among.t, among.o))
    partial = _lexicon(words, "t2", "o2", share(among.t2, among.o2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(partial)
        for piece in slices(batches, 1):
            found = [judge.of(text) for text in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "features"])

    rows = sample.where("_part = 0").select("_toxic", F.col("_text").cast("string")).mapInArrow(run, "toxic int, features array<double>").toPandas()
    features = np.array(rows["features"].tolist()).reshape(-1, 3)
    lexicon.weights = _logistic(features, rows["toxic"].to_numpy(), base)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """Id, ``score`` (0 to 1, higher is more toxic) and ``predicted`` (1 from ``least`` on).

    Null and empty texts have no hits and so the lowest score. Rows keep their
    number. No exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(lexicon)
        for piece in slices(batches, 1):
            rows = np.array([judge.of(text) for text in piece.column(1).to_pylist()])
            margin = rows @ lexicon.weights[:-1] + lexicon.weights[-1]
            scores = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores)], names=["_id", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"_id {id_type}, score double")
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= least).cast("int").alias("predicted"))
