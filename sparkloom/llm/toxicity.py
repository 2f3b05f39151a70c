"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Letters -> classes: one trie transducer reads a word and writes INSULT, SLUR, THREAT, TARGET, NEGATION or REPORT. Its
insult arcs are words and stems, all of them learned from labelled rows and each with a weight of its own (a stem
is an arc to a state that accepts any ending). Slurs are families: stems with many endings that also begin ordinary
words now and then, so one of them says little and their number against the text's length much. The other classes
are short closed lists in four languages.

Classes -> matches: four sequential transducers rewrite the classes of a clause (a run between sentence marks).
``reported_speech`` marks insults and threats behind a verb of saying, ``negation`` those that a negation reaches,
``target`` those that a target stands before, and, read from the right, those that one follows closely. The three
that read from the left are composed to one machine (pairs of states); the fourth reads what that one wrote.
Each marked insult or threat is a match of one kind, and its weight is the unit's weight times the kind's: it is
matched clauses that score, not words on their own. A threat counts only where it is aimed. The matched slurs of a
text count by how far they exceed, in standard deviations, what a text of its length without toxicity shows.

Learning: units by their log odds between the labels, the weights of the kinds by logistic regression around a
prior (an aimed insult like a plain one, a negated or reported one a fifth, a threat three fifths of it), so that a
kind that the sample hardly shows keeps the prior and one that it shows moves to what the rows say. Near copies
(fingerprints of the whole text within ``simhash.DISTANCE`` bits, same label) count once. At most ``SAMPLE``
labelled rows of a class, and ``common.SAMPLE_BYTES`` of text, are read; every text is scored whole, and labels,
ids, languages and sources are no inputs of a score.

Defined results: null or empty text has no matches and gets the score of a text without any; with no labelled
rows of either class only threats count; repeated rows score alike; empty tables give empty results; filtering
keeps rows with null or empty text, and every column as it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, held_out, labelled_sample, slices
from .simhash import distinct_texts

SAMPLE = {1: 2000, 0: 4000}
THRESHOLD = 0.7
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SLUR = range(7)
HOSTILE = (INSULT, THREAT, SLUR)
#: Marks that transducers add to a class.
AIMED, NEGATED, REPORTED = 8, 16, 32
#: Fixed closed word lists of the grammar (English, German, French, Spanish).
THREAT_WORDS = (
    "kill killing murder murdering stab stabbing strangle hurt hurting destroy destroying beat shoot hunt "
    "töten töte tötet umbringen schlagen schlage schlägt erwürgen verprügeln tuer tue tuerai frapper frapperai étrangler matar mataré mato golpear golpearé destruir"
).split()
TARGET_WORDS = "you your he she they them him her du ihr sie er euch dich vous tu toi il elle ils usted tú te él ella ellos".split()
NEGATION_WORDS = "not no never isn't aren't wasn't nicht kein keine nie ne jamais nunca jamás".split()
REPORT_WORDS = "said says called wrote quoted claimed sagte schrieb nannte dit disait écrit dijo llamó escribió".split()
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
KINDS = ("plain", "aimed", "negated", "reported", "threat", "slurs")
#: How the prior weighs the kinds against a plain insult.
PRIOR = (1.0, 1.0, 0.2, 0.2, 0.6, 1.0)
REACH = 4


class WordTransducer:
    """Deterministic trie: arcs by letter, a class and a weight at the end of a word, and stems that accept any ending."""

    def __init__(self, insult_words: Iterable[str], insult_stems: Iterable[str], weights: dict[str, float] | None = None, families: Iterable[str] = ()):
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float]] = [(OTHER, 0.0)]
        self.open: list[tuple[int, float] | None] = [None]
        weights = weights or {}
        for words, kind in ((REPORT_WORDS, REPORT), (NEGATION_WORDS, NEGATION), (TARGET_WORDS, TARGET), (THREAT_WORDS, THREAT)):
            for w in words:
                self.ends[self._state(w)] = (kind, 1.0)
        for w in insult_words:
            self.ends[self._state(w)] = (INSULT, weights.get(w, 1.0))
        for s in insult_stems:
            self.open[self._state(s)] = (INSULT, weights.get(s + "*", 1.0))
        for s in families:
            self.open[self._state(s)] = (SLUR, 1.0)
        self.cache: dict[str, tuple[int, float]] = {}

    def _state(self, letters: str) -> int:
        state = 0
        for c in letters:
            if c not in self.arcs[state]:
                self.arcs.append({})
                self.ends.append((OTHER, 0.0))
                self.open.append(None)
                self.arcs[state][c] = len(self.arcs) - 1
            state = self.arcs[state][c]
        return state

    def read(self, word: str) -> tuple[int, float]:
        """(class, weight) of a lower-case word; what was read lately is remembered, in a table of bounded size."""
        if (known := self.cache.get(word)) is not None:
            return known
        state, out = 0, (OTHER, 0.0)
        for n, c in enumerate(word):
            state = self.arcs[state].get(c, -1)
            if state < 0:
                break
            if self.open[state] and n + 1 < len(word):
                out = self.open[state]
                break
        else:
            out = self.ends[state]
        if len(self.cache) >= 200_000:
            self.cache.clear()
        self.cache[word] = out
        return out


Rule = Callable[[int, int], tuple[int, int]]
SYMBOLS = tuple(c | m for c in range(7) for m in ((0, AIMED, NEGATED, AIMED | NEGATED, REPORTED, REPORTED | AIMED, REPORTED | NEGATED, REPORTED | NEGATED | AIMED) if c in HOSTILE else (0,)))


class Sequential:
    """A sequential transducer: one state and one written symbol for each state and read symbol; it starts in state 0."""

    def __init__(self, rule: Rule):
        """Tables of all states that ``rule(state, symbol) -> (state, symbol)`` reaches from 0."""
        number, self.arcs, todo = {0: 0}, [], [0]
        for state in todo:  # grows while states turn up
            row = {}
            for symbol in SYMBOLS:
                nxt, out = rule(state, symbol)
                if nxt not in number:
                    number[nxt] = len(todo)
                    todo.append(nxt)
                row[symbol] = (number[nxt], out)
            self.arcs.append(row)

    def then(self, other: Sequential) -> Sequential:
        """The composition: what this machine writes is what the other one reads."""
        many = len(other.arcs)

        def rule(pair: int, symbol: int) -> tuple[int, int]:
            a, b = divmod(pair, many)
            a, out = self.arcs[a][symbol]
            b, out = other.arcs[b][out]
            return a * many + b, out

        return Sequential(rule)

    def run(self, symbols: Iterable[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state, w = self.arcs[state][s]
            out.append(w)
        return out


def _hostile(symbol: int) -> bool:
    return symbol & 7 in HOSTILE


def reported_speech() -> Sequential:
    """Behind a verb of saying all of the clause is reported."""
    return Sequential(lambda s, c: (1 if c == REPORT else s, c | REPORTED if s and _hostile(c) else c))


def negation(reach: int = REACH) -> Sequential:
    """A state is how many more words the last negation reaches."""
    return Sequential(lambda s, c: (reach if c == NEGATION else max(0, s - 1), c | NEGATED if s and _hostile(c) else c))


def target_before() -> Sequential:
    return Sequential(lambda s, c: (1 if c == TARGET else s, c | AIMED if s and _hostile(c) else c))


def target_behind(reach: int = REACH) -> Sequential:
    """For clauses read from the right: a target that follows within ``reach`` words."""
    return Sequential(lambda s, c: (reach if c == TARGET else max(0, s - 1), c | AIMED if s and _hostile(c) else c))


def kind_of(symbol: int) -> str | None:
    """The kind of a marked insult or threat: reported before negated before aimed before plain; a threat that is not aimed is none."""
    kind = "reported" if symbol & REPORTED else "negated" if symbol & NEGATED else "aimed" if symbol & AIMED else "plain"
    return kind if symbol & 7 != THREAT or kind == "aimed" else None


class ClauseTransducer:
    """The machines of one clause; what it writes for each insult or threat is a kind or nothing."""

    def __init__(self):
        self.from_left = reported_speech().then(negation()).then(target_before())
        self.from_right = target_behind()
        self.kinds = {s: kind_of(s) for s in SYMBOLS if _hostile(s)}

    def read(self, classes: list[int]) -> list[tuple[int, int, str]]:
        """(place, class, kind) of each match."""
        marked = self.from_right.run(reversed(self.from_left.run(classes)))
        marked.reverse()
        return [(k, s & 7, kind) for k, s in enumerate(marked) if s & 7 in HOSTILE and (kind := self.kinds[s])]


@dataclass(frozen=True)
class ToxicityModel:
    words: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    weights: tuple[float, ...] = field(default=(-3.0, 5.0, 5.0, 1.0, 1.0, 3.0, 5.0))
    #: (word, or stem with a star; weight): the greatest is 1.
    units: tuple[tuple[str, float], ...] = ()
    #: Stems of the slurs, and their share of the words of rows that are not toxic.
    families: tuple[str, ...] = ()
    usual: float = 0.0


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.letters, self.clauses = model, WordTransducer(model.words, model.stems, dict(model.units), model.families), ClauseTransducer()

    def weighted(self, text: str | None) -> list[tuple[int, str, float]]:
        """(class, kind, weight of the unit) of the matches of a text."""
        read, out = self.letters.read, []
        low = (text or "").lower()
        if not any([read(w)[0] in HOSTILE for w in set(WORD.findall(low))]):
            return out  # nothing that a clause could match
        for clause in CLAUSE.split(low):
            symbols = [read(w) for w in WORD.findall(clause)]
            if any([s[0] in HOSTILE for s in symbols]):
                out += [(c, kind, symbols[at][1]) for at, c, kind in self.clauses.read([s[0] for s in symbols])]
        return out

    def matches(self, text: str | None) -> list[tuple[int, str]]:
        """The matched clauses of a text, as (class, kind)."""
        return [(c, kind) for c, kind, _ in self.weighted(text)]

    def features(self, text: str | None) -> list[float]:
        """For each kind the summed weights of its matches (beyond 1 they count by their logarithm), and the excess of slurs, full at 4 deviations."""
        total = Counter()
        for c, kind, weight in self.weighted(text):
            if c == SLUR:
                total["slurs"] += PRIOR[KINDS.index(kind)]
            else:
                total["threat" if c == THREAT else kind] += weight
        out = [min(1.0, total[k]) + math.log1p(max(0.0, total[k] - 1)) * 0.25 for k in KINDS[:-1]]
        if not total["slurs"]:
            return [*out, 0.0]
        usual = len(WORD.findall(text.lower())) * self.model.usual
        return [*out, min(1.0, max(0.0, (total["slurs"] - usual) / math.sqrt(usual + 0.5) / 4))]

    def score(self, text: str | None) -> float:
        w = self.model.weights
        z = w[0] + sum(a * b for a, b in zip(w[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _units(text: str) -> set[str]:
    """The words of a text, and their beginnings of 4 to 7 letters as stems."""
    bag = set(WORD.findall(text.lower()))
    return bag | {w[:n] + "*" for w in bag for n in range(4, min(8, len(w)))}


def learn_families(rows: list[tuple[str, int]], members: int = 5, ratio: float = 8.0) -> tuple[list[str], float]:
    """(stems, their share of the words of the other rows): beginnings of 3 to 7 letters that many different words of toxic rows have.

    A word counts at most three times for each row of the sample, so that a text which repeats one without end does not make it a sign.

    A stem's share of the toxic rows' words is at least ``ratio`` times that of the other rows', it stands in at
    least 5 toxic rows and 3 per cent of them, and has at least ``members`` different words there, none of them in half
    of these rows (then that word alone is the sign).
    """
    tokens, held, words, by_word = {0: Counter(), 1: Counter()}, Counter(), {}, Counter()
    total = Counter()
    for text, y in rows:
        found = Counter(WORD.findall(text.lower()))
        total[y] += sum(found.values())
        seen = set()
        for w, n in found.items():
            by_word[w] += y
            for k in range(3, min(8, len(w))):
                tokens[y][w[:k]] += min(n, 3)  # a word that a text repeats without end is one sign, not many
                if y:
                    seen.add(w[:k])
                    words.setdefault(w[:k], set()).add(w)
        held.update(seen)
    rows_1 = sum(y for _, y in rows)
    rate = {s: (tokens[1][s] / max(1, total[1])) / ((tokens[0][s] + 0.5) / max(1, total[0])) for s in words}
    good = {s for s in words if held[s] >= max(5, 0.03 * rows_1) and len(words[s]) >= members and rate[s] >= ratio and max(by_word[w] for w in words[s]) < held[s] / 2}
    out: list[str] = []
    for s in sorted(good, key=len):  # the shortest stem, and of those that cover nearly the same the longest
        if any(s.startswith(t) or t.startswith(s) for t in out):
            continue
        same = [t for t in good if t.startswith(s) and held[t] >= 0.95 * held[s] and len(words[t]) >= 0.95 * len(words[s])]
        out.append(max(same, key=lambda t: (len(t), t)))
    return sorted(out), sum(tokens[0][s] for s in out) / max(1, total[0])


def learn_insults(rows: list[tuple[str, int]], least: float = 0.002, purity: float = 0.98, families: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(words, stems) that explain the toxic rows: greedily the unit that covers most rows not yet explained.

    A unit must be nearly absent from the other rows. Rare words of a row that a strong unit explains are never
    taken up, however often that row was copied. Words of ``families`` are left to these.
    """
    toxic, clean = Counter(), Counter()
    bags: list[set[str]] = []
    totals = Counter(y for _, y in rows)
    for text, y in rows:
        bag = {u for u in _units(text) if not u.startswith(families)} if families else _units(text)
        (toxic if y else clean).update(bag)
        if y:
            bags.append(bag)
    rate = max(1, totals[1]) / max(1, totals[0])
    good = {u for u, n in toxic.items() if n >= 5 and n / (n + clean[u] * rate) >= purity}
    bags = [b & good for b in bags]
    holders: dict[str, set[int]] = {}
    for i, b in enumerate(bags):
        for u in b:
            holders.setdefault(u, set()).add(i)
    left, taken = set(range(len(bags))), []
    counts = {u: len(h) for u, h in holders.items()}
    while counts:
        most = max(counts.values())
        if most < max(5, least * len(bags)):
            break
        # of units that cover nearly as much, a whole word, else the longest stem: the narrowest that explains the rows
        u = min((x for x, n in counts.items() if n >= 0.97 * most), key=lambda x: (x[-1] == "*", -len(x), x))
        taken.append(u)
        for i in holders[u] & left:
            for x in bags[i]:
                counts[x] -= 1
        left -= holders[u]
        del counts[u]
    # what explains many rows whole, though other units covered these first
    taken += sorted(u for u, h in holders.items() if u not in taken and len(h) >= max(10, 0.02 * len(bags)))
    # a stem gives way to a longer unit that explains nearly the same rows
    bare = {u: u.rstrip("*") for u in holders}
    wide = [u for u in taken if u[-1] == "*"]
    taken = [u for u in taken if u not in wide or not any(x != u and bare[x].startswith(u[:-1]) and len(holders[x]) >= 0.95 * len(holders[u]) for x in taken)]
    stems = sorted({u[:-1] for u in taken if u[-1] == "*"})
    words = sorted({u for u in taken if u[-1] != "*"})
    # a narrower unit of a taken stem adds nothing
    stems = [s for s in stems if not any(s != t and s.startswith(t) for t in stems)]
    return [w for w in words if not any(w != t and w.startswith(t) for t in stems)], stems


def unit_weights(rows: list[tuple[str, int]], words: list[str], stems: list[str]) -> tuple[tuple[str, float], ...]:
    """The log odds of each unit between the labels, as a share of the greatest."""
    units = set(words) | {s + "*" for s in stems}
    held = {y: Counter(u for t, c in rows if c == y for u in _units(t) & units) for y in (0, 1)}
    n = Counter(y for _, y in rows)
    odds = {u: math.log((held[1][u] + 0.5) / (n[1] + 1)) - math.log((held[0][u] + 0.5) / (n[0] + 1)) for u in units}
    most = max(odds.values(), default=1.0)
    return tuple(sorted((u, max(0.0, x / most)) for u, x in odds.items()))


def around_prior(x: np.ndarray, y: np.ndarray, prior: np.ndarray, tight: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic weights (intercept first) by Newton's method, with a normal prior of the given means on all but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, mean = np.zeros(x.shape[1]), np.concatenate([[0.0], prior])
    pull = np.full(x.shape[1], tight)
    pull[0] = 1e-3
    w[1:] = prior
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (pull * (w - mean) ** 2).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (weight * (p - y)) + pull * (w - mean)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step, now = np.linalg.solve(hess, grad), loss(w)
        share = 1.0
        while loss(w - share * step) > now and share > 1e-6:  # shorter until the loss falls
            share /= 2
        w = w - share * step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: dict[int, int] | None = None) -> ToxicityModel:
    return fit_rows(labelled_sample(docs, labels, label, sample or SAMPLE, id_col, text_col))


def fit_rows(rows: list[tuple[str, int]]) -> ToxicityModel:
    rows = distinct_texts([(t, y) for t, y in rows if t])
    if len({y for _, y in rows}) < 2:
        return ToxicityModel()
    families, usual = learn_families(rows)
    words, stems = learn_insults(rows, families=tuple(families))
    units = unit_weights(rows, words, stems)
    s = Scorer(ToxicityModel(tuple(words), tuple(stems), units=units, families=tuple(families), usual=usual))
    x, y = np.array([s.features(t) for t, _ in rows]), np.array([y for _, y in rows], float)
    scale = max(0.0, float(around_prior(x.max(1, keepdims=True), y, np.array([5.0]))[1]))
    w = around_prior(x, y, scale * np.array(PRIOR))
    return ToxicityModel(tuple(words), tuple(stems), tuple(map(float, w)), units, tuple(families), usual)


def scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for b in batches:
            got = [s.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["id", "score"])

    return fields(docs, id=id_col, text=text_col).mapInArrow(run, f"id {kind}, score double")


def predictions(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    scored = scores(docs, model, id_col, text_col)
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``: one pass, no shuffle. Null and empty texts stay unless the model's own base rate is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for b in slices(batches):
            yield b.filter(pa.array([s.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
