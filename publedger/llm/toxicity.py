"""Toxicity: a learned lexicon in a trie, searched through Levenshtein automata, and context scores.

Terms are learned from labels: whole words and word stems that toxic texts hold and clean ones do
not. The trie of the terms and the Levenshtein automaton of a word are stepped together; the states
of that product are made on first use, so a word costs one table step per letter and nearly all die
after three. Whole words allow one edit from five letters and two from nine (a swap of neighbours is
one edit); stems allow any ending. A form that clean texts use is a word of its own, not a misspelling.

Each hit is weighed in its window of the text: hits between quotation marks count apart from the
rest, hits near other hits count again. A logistic model over these figures gives the score; it is
fitted on figures from lexicons that did not see the row (two folds).

Only the lexicon and the model are learned from a bounded sample of labelled rows (``SAMPLE``, chosen
by hash in each class); every whole text is scored. Labels, lang, source and doc_id are no inputs.

Defined cases: null and empty texts score as texts without hits; labels without a class or document
are ignored; without toxic or without clean labels every score is the share of toxic labels (0 without any); rows
that repeat a doc_id are each scored; other columns pass through, input columns named as an output are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from publedger.llm.common import ROW, map_batches, unpacked
from publedger.session import cut_lineage

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Most labelled rows of each class that lexicon and model are learned from.
SAMPLE = 25_000
SHORTEST, LONGEST = 3, 10
#: A term must stand in so many toxic texts, and be so much likelier there.
LEAST_DOCS, LEAST_LIFT = 3, 20.0
#: Evidence against chance, the log of how unlikely its split over the classes is; enough for some 100,000
#: tried terms. Of more terms their log is asked, so that about one passes by chance at any size.
LEAST_EVIDENCE = 11.5
WINDOW_CHARS, WINDOW_WORDS = 60, 6
QUOTES = re.compile("[\"“”„‟«»‹›]")
WORD = re.compile(r"[^\W_]+")
STATES_KEPT = 200_000
MISSES_KEPT = 500_000
FEATURES = 8


def held_out(folds: int = FOLDS, which: int = HELD_OUT):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == which


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


@dataclass
class Node:
    children: dict[str, int] = field(default_factory=dict)
    word: int = -1
    stem: int = -1
    budget: int = 0


class LexiconAutomaton:
    """Steps the lexicon trie and the Levenshtein automaton of a text word together.

    A state is a set of (trie node, edits, letter owed by a swap)."""

    DEAD = -1

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.terms = [*words, *stems]
        self.nodes = [Node()]
        for k, term in enumerate(self.terms):
            at, whole = 0, k < len(words)
            budget = edits_allowed(term) if whole else 0
            self.nodes[0].budget = max(self.nodes[0].budget, budget)
            for letter in term:
                at = self.nodes[at].children.setdefault(letter, len(self.nodes))
                if at == len(self.nodes):
                    self.nodes.append(Node())
                self.nodes[at].budget = max(self.nodes[at].budget, budget)
            setattr(self.nodes[at], "word" if whole else "stem", k)
        self._reset()

    def _reset(self) -> None:
        self.sets: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set) -> frozenset:
        """With the nodes reached by leaving out letters of the lexicon."""
        todo = list(items)
        while todo:
            node, edits, owed = todo.pop()
            if not owed:
                for child in self.nodes[node].children.values():
                    new = (child, edits + 1, "")
                    if edits < self.nodes[child].budget and new not in items:
                        items.add(new)
                        todo.append(new)
        return frozenset(items)

    def _state(self, items: frozenset) -> int:
        if not items:
            return self.DEAD
        if items not in self.ids:
            self.ids[items] = len(self.sets)
            self.sets.append(items)
            self.steps.append({})
            best = None
            for node, edits, owed in items:
                term = self.nodes[node].word
                if term >= 0 and not owed and edits <= edits_allowed(self.terms[term]) and (best is None or edits < best[1]):
                    best = (term, edits)
            stems = [self.nodes[n].stem for n, e, owed in items if not e and not owed and self.nodes[n].stem >= 0]
            self.ends.append((stems[0], 0) if stems and not (best and best[1] == 0) else best)
        return self.ids[items]

    def _step(self, state: int, letter: str) -> int:
        out = set()
        for node, edits, owed in self.sets[state]:
            here = self.nodes[node]
            if owed:
                if letter == owed:
                    out.add((node, edits, ""))
                continue
            if here.stem >= 0 and not edits:
                out.add((node, 0, ""))
            child = here.children.get(letter)
            if child is not None:
                out.add((child, edits, ""))
            if edits < here.budget:
                out.add((node, edits + 1, ""))
            for first, child in here.children.items():
                if edits < self.nodes[child].budget:
                    out.add((child, edits + 1, ""))
                    beyond = self.nodes[child].children.get(letter)
                    if beyond is not None and first != letter and edits < self.nodes[beyond].budget:
                        out.add((beyond, edits + 1, first))
        return self._state(self._closed(out))

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, None without one."""
        if len(self.sets) > STATES_KEPT:
            self._reset()
        state = 0
        for letter in word:
            following = self.steps[state].get(letter)
            if following is None:
                following = self._step(state, letter)
                self.steps[state][letter] = following
            if following == self.DEAD:
                return None
            state = following
        return self.ends[state]


@dataclass
class Lexicon:
    """Terms with their evidence (log of how much likelier they are in toxic texts), and the forms
    that are words of their own."""

    words: dict[str, float]
    stems: dict[str, float]
    own: frozenset[str] = frozenset()


class Scanner:
    """Figures of texts under a lexicon; keeps the words that hit nothing from text to text."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = LexiconAutomaton(list(lexicon.words), list(lexicon.stems))
        self.evidence = [*lexicon.words.values(), *lexicon.stems.values()]
        self.misses: set[str] = set()

    def hits(self, words: set[str]) -> dict[str, tuple[int, int]]:
        if len(self.misses) > MISSES_KEPT:
            self.misses.clear()
        out = {}
        for word in words - self.misses:
            found = self.automaton.match(word)
            if found is None or (found[1] and word in self.lexicon.own):
                self.misses.add(word)
            else:
                out[word] = found
        return out

    def figures(self, text: str) -> list[float]:
        lower = text.lower()
        words = WORD.findall(lower)
        hits = self.hits(set(words))
        out = [0.0] * FEATURES
        if not hits:
            return out
        marks = [m.start() for m in QUOTES.finditer(lower)]
        exact = fuzzy = quoted = near = 0
        terms: dict[int, float] = {}
        last = -(10**9)
        for k, m in enumerate(WORD.finditer(lower)):
            found = hits.get(m[0])
            if found is None:
                continue
            term, edits = found
            if marks and self._quoted(marks, m.start(), m.end()):
                quoted += 1
                continue
            exact += edits == 0
            fuzzy += edits > 0
            near += k - last <= WINDOW_WORDS
            last = k
            terms[term] = max(terms.get(term, 0.0), self.evidence[term] / (1 + edits))
        return [
            math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(near), math.log1p(len(terms)),
            min(10.0, sum(terms.values())), float(exact + fuzzy > 0), 100 * (exact + fuzzy) / (len(words) + 20),
        ]

    @staticmethod
    def _quoted(marks: list[int], start: int, end: int) -> bool:
        """Between two quotation marks of its window, an odd number of marks before it in the line of marks."""
        at = int(np.searchsorted(marks, start))
        return at % 2 == 1 and at < len(marks) and start - marks[at - 1] <= WINDOW_CHARS and marks[at] - end <= WINDOW_CHARS


def _strings(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> DataFrame:
    """``text, label, weight, fold``: at most about ``bound`` labelled rows of each class, outside the
    held-out part, equal texts once. The sampled ids are what is broadcast."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~held_out()).distinct()
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.lit(1.0)
    for which, n in sizes.items():
        weight = F.when(F.col("label") == which, F.lit(max(1.0, n / bound))).otherwise(weight)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    sample = known.filter(draw < 1_000_000 / weight).withColumn("weight", weight)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    text = F.coalesce("text", F.lit(""))
    unique = rows.select(text.alias("text"), "label", "weight", F.xxhash64(text, F.lit("fold")).alias("h")).dropDuplicates(["h", "label"])
    return cut_lineage(unique.withColumn("fold", F.pmod("h", F.lit(2)).cast("int")).drop("h"), "toxicity-sample")


def _terms(words: set[str]) -> set[str]:
    """Whole words as ``=word``, the beginnings of longer ones as ``^stem``."""
    out = {"=" + w for w in words if SHORTEST <= len(w) <= 40}
    for w in words:
        out.update("^" + w[:n] for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return out


def term_counts(sample: DataFrame) -> DataFrame:
    """``term, n00, n01, n10, n11``: texts with the term by fold and label; terms of no toxic text are left out."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells = [Counter() for _ in range(4)]
        for text, label, fold in zip(_strings(batch), batch.column("label").to_pylist(), batch.column("fold").to_pylist()):
            cells[2 * fold + label].update(_terms(set(WORD.findall(text.lower()))))
        terms = list(set().union(*cells))
        columns = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in cells)]
        yield pa.RecordBatch.from_arrays(columns, ["term", "n00", "n01", "n10", "n11"])

    names = ["n00", "n01", "n10", "n11"]
    rows = map_batches(sample.select("text", "label", "fold"), count, "term string, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).filter(f"n01 + n11 >= {LEAST_DOCS}")


def _evidence(bad: int, fine: int, share: float) -> float:
    total = bad + fine
    return sum(n * math.log(n / total / p) for n, p in ((bad, share), (fine, 1 - share)) if n)


def _lexicon(counts: dict[str, tuple[int, int]], toxic: int, clean: int, tried: int) -> Lexicon:
    """Telling terms: of every telling beginning the longest form that loses next to no toxic text.
    ``tried`` is the number of terms that ``counts`` was chosen from."""
    evidence = max(LEAST_EVIDENCE, math.log(max(1, tried)))
    good = {}
    for term, (bad, fine) in counts.items():
        lift = (bad / max(1, toxic)) / ((fine + 0.5) / max(1, clean))
        if bad >= LEAST_DOCS and lift >= LEAST_LIFT and _evidence(bad, fine, toxic / max(1, toxic + clean)) >= evidence:
            good[term] = (bad, math.log(lift))
    children: dict[str, list[str]] = {}
    for term in good:
        body = term[1:]
        parent = "^" + (body if term[0] == "=" else body[:-1])
        if term[0] == "=" and parent not in good:
            parent = "^" + body[:-1]
        children.setdefault(parent, []).append(term)
    words, stems = {}, {}
    tops = [t for t in good if not any("^" + t[1:n] in good for n in range(1 + SHORTEST, len(t) + (t[0] == "="))) or len(t) == 1 + SHORTEST and t[0] == "^"]
    for term in sorted(tops, key=lambda t: (-good[t][0] * good[t][1], t)):
        while longer := [c for c in children.get(term, ()) if good[c][0] >= 0.95 * good[term][0]]:
            term = max(longer, key=lambda c: (good[c][0], c))
        (words if term[0] == "=" else stems)[term[1:]] = good[term][1]
    return Lexicon(words, stems)


def _own_forms(sample: DataFrame, lexicons: list[Lexicon]) -> list[frozenset[str]]:
    """For each lexicon the misspelled forms that clean texts of its folds use."""

    def forms(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(x) for x in lexicons]
        cells = Counter()
        for text, fold in zip(_strings(batch), batch.column("fold").to_pylist()):
            words = set(WORD.findall(text.lower()))
            cells.update((k, w) for k, s in enumerate(scanners) for w, hit in s.hits(words).items() if hit[1] and k in (2, fold))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cells], pa.int32()), pa.array([w for _, w in cells], pa.string())], ["lexicon", "form"])

    clean = sample.filter("label = 0").select("text", "fold")
    found = map_batches(clean, forms, "lexicon int, form string").distinct().collect()  # within edit reach of the lexicon
    return [frozenset(r["form"] for r in found if r["lexicon"] == k) for k in range(len(lexicons))]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the last for the constant, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((np.sum(weight * y) + 0.5) / (np.sum(weight * (1 - y)) + 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, figures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(figures @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> ToxicityModel:
    sample = training_rows(docs, labels, label, bound)
    sizes = {(r["fold"], r["label"]): (r["n"], r["w"]) for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    toxic, clean = ([sizes.get((f, c), (0, 0))[0] for f in (0, 1)] for c in (1, 0))
    if not sum(toxic) or not sum(clean):
        share = 1.0 if sum(toxic) else 0.0
        return ToxicityModel(Lexicon({}, {}), np.array([0.0] * FEATURES + [30.0 if share else -30.0]))
    rows = cut_lineage(term_counts(sample), "toxicity-terms")
    tried = rows.count()
    lift = (F.col("n01") + F.col("n11")) / sum(toxic) / ((F.col("n00") + F.col("n10") + 0.5) / sum(clean))
    near = rows.filter(lift >= LEAST_LIFT / 8).collect()  # terms that any of the three lexicons can take; bounded by the sample
    counts = [{r["term"]: (r["n01"], r["n00"]) for r in near}, {r["term"]: (r["n11"], r["n10"]) for r in near}, {r["term"]: (r["n01"] + r["n11"], r["n00"] + r["n10"]) for r in near}]
    lexicons = [_lexicon(c, t, n, tried) for c, t, n in zip(counts, [*toxic, sum(toxic)], [*clean, sum(clean)])]
    for lexicon, own in zip(lexicons, _own_forms(sample, lexicons)):
        lexicon.own = own

    def figures(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(lexicons[1]), Scanner(lexicons[0])]  # a row is measured by the other fold's lexicon
        found = [scanners[f].figures(t) for t, f in zip(_strings(batch), batch.column("fold").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("label"), batch.column("weight")], ["x", "label", "weight"])

    # the sample is bounded, and rows with equal figures are one row with their weights together
    measured = map_batches(sample.select("text", "label", "weight", "fold"), figures, "x array<double>, label int, weight double")
    fitted = measured.groupBy("x", "label").agg(F.sum("weight").alias("weight")).collect()
    x, y, weight = (np.array([r[c] for r in fitted], dtype=float) for c in ("x", "label", "weight"))
    return ToxicityModel(lexicons[2], fit_logistic(x.reshape(-1, FEATURES), y, weight))


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: all) with ``score`` and ``predicted``."""
    carry = docs.columns if carry is None else carry
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in carry]).alias(ROW))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value.lexicon)
        for batch in batches:
            found = np.array([scanner.figures(t) for t in _strings(batch)], dtype=float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(sent.value.score(found))], [ROW, "__score"])

    scored = rows.mapInArrow(scan, f"{ROW} {rows.schema[ROW].dataType.simpleString()}, __score double")
    predicted = scored.withColumn("__predicted", (F.col("__score") >= threshold).cast("int"))
    return unpacked(predicted, carry, {"score": "__score", "predicted": "__predicted"})


def toxicity(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, bound: int = SAMPLE) -> DataFrame:
    return score_documents(docs, train(docs, labels, bound=bound), carry=carry)
