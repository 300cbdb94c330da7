"""Toxicity: a weighted finite-state pattern grammar over clauses.

A text is cut into clauses, and a lexical transducer (an Aho-Corasick automaton) rewrites a clause's words to symbols:
insult, threat, target, negation, report or other. Five transducers, given as states and weighted arcs, read that string:
negation (marks matches within ``NEGATION_REACH`` words after one), insult, threat, target (somebody is addressed) and
reported speech (before or after the match). ``compose`` makes one weighted transducer of the five, and a clause's score is the
weight of its path: the sum of its matches' arc weights times the weight of the final state. An insult at nobody weighs
half of one at somebody; a threat without a target weighs nothing, however strong its word. A logistic model over the
clauses' scores gives the score of the document; no count of isolated words enters.

The grammar's structure and a seed lexicon are fixed; lexicon weights, further lexicon entries (words, and word
beginnings, that are significantly more frequent in toxic documents) and the logistic model are learned from at most
``max_train`` labelled documents, taken by the order of a hash of their ids, half of them of either label.

Defined results: null and empty texts match nothing and get the base score; without usable labels the seed lexicon
scores with weight 1; texts and clauses are read whole, whatever their length; repeated rows are scored each; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import small

SEEDS = {
    "insult": "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile bastard fool dumb retard idiota estúpido imbécil basura idiote stupide crétin ordure dummkopf trottel abschaum",
    "threat": "kill murder strangle stab shoot burn destroy matar tuer töten umbringen erschlagen",
}
TARGETS = frozenset("you your yours you're youre u ur they them he she him her his du dich dir ihr euch dein deine sie tu te toi vous votre ton ta il elle tú te ti usted tu su ustedes él ella".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't didn't nobody none without nicht kein keine nie niemals ne pas jamais aucun aucune sans ni nunca jamás ningún ninguna sin".split())
REPORTS = frozenset("said says say wrote writes quoted quote quotes called reported reports claims claimed alleged according sagt sagte schrieb laut dit disait écrit selon dijo dice escribió según".split())
_CLAUSE_END = re.compile(r"[.!?;\n\r]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: How far a negation reaches, in words.
NEGATION_REACH = 4
FEATURES = ("weight", "clauses", "best", "addressed", "damped", "threats")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)
#: A match that a negation reaches, between the transducers.
NOT_INSULT, NOT_THREAT = "not insult", "not threat"


@dataclass(frozen=True)
class Transducer:
    """start; arcs: (state, symbol) -> (state, symbol written, weight), where a missing arc stays and copies the symbol;
    final: state -> weights of the path's insults and threats (1 and 1 if missing)."""

    start: object
    arcs: dict
    final: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


_AFTER = range(1, NEGATION_REACH + 1)
TRANSDUCERS = (
    # Negation: the state is how many more words it reaches; a match ends it.
    Transducer(
        0,
        {(k, NEGATION): (NEGATION_REACH, NEGATION, 1.0) for k in (0, *_AFTER)}
        | {(k, x): (k - 1, x, 1.0) for k in _AFTER for x in (TARGET, REPORT, OTHER)}
        | {(k, INSULT): (0, NOT_INSULT, 0.25) for k in _AFTER}
        | {(k, THREAT): (0, NOT_THREAT, 0.25) for k in _AFTER},
        {},
    ),
    Transducer("no insult", {("no insult", x): ("insult", x, 1.0) for x in (INSULT, NOT_INSULT)}, {"no insult": (0.0, 1.0)}),
    Transducer("no threat", {("no threat", x): ("threat", x, 1.0) for x in (THREAT, NOT_THREAT)}, {"no threat": (1.0, 0.0)}),
    Transducer("nobody", {("nobody", TARGET): ("somebody", TARGET, 1.0)}, {"nobody": (0.6, 0.0), "somebody": (1.2, 1.2)}),
    Transducer("own speech", {("own speech", REPORT): ("reported", REPORT, 1.0)}, {"reported": (0.5, 0.5)}),
)


def compose(transducers: tuple[Transducer, ...]) -> Transducer:
    """One transducer for a chain of them, each reading what the one before it writes; states are tuples of theirs."""
    start = tuple(t.start for t in transducers)
    arcs, final, todo = {}, {}, [start]
    while todo:
        state = todo.pop()
        if state in final:
            continue
        ends = [t.final.get(x, (1.0, 1.0)) for t, x in zip(transducers, state, strict=True)]
        final[state] = tuple(math.prod(e[k] for e in ends) for k in (0, 1))
        for symbol in SYMBOLS:
            after, out, weight = [], symbol, 1.0
            for t, x in zip(transducers, state, strict=True):
                x, out, w = t.step(x, out)
                after.append(x)
                weight *= w
            arcs[state, symbol] = (tuple(after), out, weight)
            todo.append(tuple(after))
    return Transducer(start, arcs, final)


CLAUSE = compose(TRANSDUCERS)
_KIND = {w: REPORT for w in REPORTS} | {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS}


def clause_weights(symbols: list[tuple[str, float]]) -> tuple[list[float], list[float], int, tuple]:
    """(weights of the insults, of the threats, damped matches, final state) of a clause's (symbol, lexical weight) string."""
    state, insults, threats, damped = CLAUSE.start, [], [], 0
    for symbol, lexical in symbols:
        state, out, weight = CLAUSE.step(state, symbol)
        if out == INSULT or out == NOT_INSULT:
            insults.append(lexical * weight)
        elif out == THREAT or out == NOT_THREAT:
            threats.append(lexical * weight)
        damped += out == NOT_INSULT or out == NOT_THREAT
    of_insult, of_threat = CLAUSE.final[state]
    return [of_insult * x for x in insults], [of_threat * x for x in threats], damped, state


@dataclass
class Grammar:
    """Lexicon entries: (form, is a word beginning) -> (class, weight). bias and weights of the logistic model."""

    lexicon: dict[str, tuple[bool, str, float]] = field(default_factory=dict)
    bias: float = -2.0
    weights: tuple[float, ...] = (1.0, 0.5, 1.0, 0.5, -0.3, 0.5)
    _automaton: object = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for form, (open_end, kind, weight) in self.lexicon.items():
                a.add_word(form, (len(form), open_end, kind, weight))
            if self.lexicon:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, low: str) -> list[tuple[int, int, str, float]]:
        """(begin, end, class, weight) of the lexicon's words in a lower-cased text; the longest entry at a place counts."""
        if not self.lexicon:
            return []
        best: dict[int, tuple[int, str, float]] = {}
        n = len(low)
        for last, (size, open_end, kind, weight) in self.automaton().iter(low):
            begin, end = last + 1 - size, last + 1
            if begin and low[begin - 1].isalnum() or not open_end and end < n and low[end].isalnum():
                continue
            if begin not in best or best[begin][0] < end:
                best[begin] = (end, kind, weight)
        return [(b, *x) for b, x in sorted(best.items())]

    def clauses(self, low: str) -> Iterator[list[tuple[str, float]]]:
        """The symbol strings of those clauses of a lower-cased text that hold a match."""
        found = self.matches(low)
        if not found:
            return
        ends = [m.start() for m in _CLAUSE_END.finditer(low)]
        k = 0
        while k < len(found):
            at = bisect_left(ends, found[k][0])
            left, right = ends[at - 1] + 1 if at else 0, ends[at] if at < len(ends) else len(low)
            places = {}
            while k < len(found) and found[k][0] < right:
                begin, _, kind, weight = found[k]
                places[begin] = (kind, weight)
                k += 1
            # A match may begin inside joined words, which then stand before it.
            words = {m.start(): (_KIND.get(m.group(), OTHER), 0.0) for m in _WORD.finditer(low, left, right)}
            yield [x for _, x in sorted((words | places).items())]

    def features(self, text: str) -> list[float]:
        total = best = addressed = threatened = 0.0
        damped = scored = 0
        for symbols in self.clauses(text.lower()):
            insults, threats, negated, state = clause_weights(symbols)
            weight = sum(insults) + sum(threats)
            total += weight
            best = max([best, *insults, *threats])
            addressed += weight * ("somebody" in state)
            threatened += sum(threats)
            damped += negated + ("reported" in state) * (len(insults) + len(threats) - negated)
            scored += weight > 0
        return [math.log1p(max(total, 0.0)), math.log1p(scored), best, math.log1p(max(addressed, 0.0)), math.log1p(damped), math.log1p(max(threatened, 0.0))]

    def score(self, text: str) -> tuple[float, int]:
        x = self.features(text)
        z = self.bias + sum(a * b for a, b in zip(self.weights, x, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z)))), round(math.expm1(x[1]))


def seed_lexicon() -> dict[str, tuple[bool, str, float]]:
    return {w: (False, kind, 1.0) for kind, words in SEEDS.items() for w in words.split()}


def learn_lexicon(texts: list[str], toxic: np.ndarray, most: int = 400, least_g2: float = 18.0) -> dict[str, tuple[bool, str, float]]:
    """Seeds with learned weights, and words or word beginnings (4 to 6 letters) bound to toxic documents.

    An entry is taken if its likelihood ratio against independence is at least ``least_g2``, five toxic documents hold it
    after as many different words (so that copies of one document count once), and nine of ten documents that hold it are toxic (after weighting the labels alike).
    """
    counts = (Counter(), Counter())
    for text, y in zip(texts, toxic, strict=True):
        words = set(_WORD.findall(text.lower()))
        counts[int(y)].update(words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) >= k and w[:k].isalpha()})
    n1 = max(1, int(toxic.sum()))
    n0 = max(1, len(texts) - n1)
    lexicon = {}
    for form, (_, kind, _) in seed_lexicon().items():
        a, b = counts[1][form], counts[0][form]
        lexicon[form] = (False, kind, _weight(a, b, n1, n0) if a + b >= 5 else 1.0)
    scored = []
    for form, a in counts[1].items():
        b = counts[0][form]
        if a >= 5 and a / n1 >= 9 * b / n0 and (g := _g2(a, b, n1, n0)) >= least_g2:
            scored.append((-g, -len(form), form, a, b))
    scored.sort()
    scored = _independent(scored[:5000], [t for t, y in zip(texts, toxic, strict=True) if y], n1, n0, least_g2)
    for _, _, form, a, b in scored:
        core = form.rstrip("*")
        if len(lexicon) >= most or any(core.startswith(x) for x, (open_end, _, _) in lexicon.items() if open_end) or core in lexicon:
            continue
        if any(x.startswith(core) for x in lexicon) and form.endswith("*"):
            continue  # a longer form says the same or more
        lexicon[core] = (form.endswith("*"), "insult", _weight(a, b, n1, n0))
    return lexicon


def _independent(scored: list[tuple], toxic_texts: list[str], n1: int, n0: int, least_g2: float) -> list[tuple]:
    """Candidates whose evidence doesn't come from copies: a form counts once for each word that stands before it."""
    wanted = {form for _, _, form, _, _ in scored}
    before: dict[str, set] = {f: set() for f in wanted}
    for text in toxic_texts:
        last = ""
        for w in _WORD.findall(text.lower()):
            for form in (w, w[:4] + "*", w[:5] + "*", w[:6] + "*"):
                if form in wanted:
                    before[form].add(last)
            last = w
    kept = []
    for _, _, form, a, b in scored:
        a = min(a, len(before[form]))
        if a >= 5 and a / n1 >= 9 * b / n0 and (g := _g2(a, b, n1, n0)) >= least_g2:
            kept.append((-g, -len(form), form, a, b))
    return sorted(kept)


def _g2(a: int, b: int, n1: int, n0: int) -> float:
    total, g = n1 + n0, 0.0
    for seen, row, col in ((a, a + b, n1), (b, a + b, n0), (n1 - a, total - a - b, n1), (n0 - b, total - a - b, n0)):
        if seen > 0:
            g += 2 * seen * math.log(seen * total / (row * col))
    return g


def _weight(a: int, b: int, n1: int, n0: int) -> float:
    return max(-1.0, min(2.0, math.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))) / 3.0))


def fit(texts: list[str], toxic: list[int], prior: float | None = None) -> Grammar:
    """A grammar for labelled texts; prior: the share of toxic documents where it is used."""
    y = np.asarray(toxic, float)
    if not len(y) or not 0 < y.sum() < len(y):
        return Grammar(seed_lexicon())
    grammar = Grammar(learn_lexicon(texts, y))
    x = np.array([grammar.features(t) for t in texts])
    x1 = np.c_[np.ones(len(x)), x]
    share = y.mean()
    prior = share if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    row = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    w = np.zeros(x1.shape[1])
    ridge = np.diag([1e-3] + [0.3] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1.T * (row * p * (1 - p) + 1e-9)) @ x1 + ridge, x1.T @ (row * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    grammar.bias, grammar.weights = float(w[0]), tuple(map(float, w[1:]))
    return grammar


def train(docs: DataFrame, labels: DataFrame, usable=None, max_train: int = 6000, label: str = "toxic") -> Grammar:
    """Learn from ``docs`` joined with ``labels``; usable: a condition on doc_id for rows that may be learned from."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    if usable is not None:
        marked = marked.where(usable)
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where("y in (0, 1)").collect()}
    if not counts.get(0) or not counts.get(1):
        return Grammar(seed_lexicon())
    picks = None
    for y in (0, 1):
        some = marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2)
        picks = some if picks is None else picks.union(some)
    picked = picks.dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").collect()
    return fit([r["text"] for r in rows], [r["y"] for r in rows], counts[1] / (counts[0] + counts[1]))


def score_documents(docs: DataFrame, grammar: Grammar, threshold: float = 0.5, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with score, predicted and n_clauses (prefixed; columns of these names are replaced); only the text is scored."""
    names = [prefix + x for x in ("score", "predicted", "n_clauses")]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # at most 400 entries
    kinds = (DoubleType(), IntegerType(), IntegerType())
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in small(batches):
            done = [g.score(t or "") for t in batch.column(at).to_pylist()]
            score = pa.array([s for s, _ in done], pa.float64())
            extra = [score, pa.array([int(s >= threshold) for s, _ in done], pa.int32()), pa.array([n for _, n in done], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
