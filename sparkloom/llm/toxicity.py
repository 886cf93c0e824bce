"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses; each word is read by acceptors into a class (insult, threat,
target, negation, report, other) with a weight. A first machine reads the clause from its end and
marks the words that a target follows within its scope. Transducers for the scope of a negation, of
reported speech and of a target each keep a small counter and weigh what is inside their
scope; they are composed into one machine offline, whose table of (state, class and mark) ->
(state, factor) then runs over the clause. A clause counts with the weights of its matches
times their factors, so "not an idiot" or a quoted insult counts for less than the same word
aimed at someone; words out of their clause are never added up alone.

Acceptors are learned from labelled rows, beside a few seeds. Insults: whole words and word beginnings
that labelled texts hold far more often when toxic. Then, from the clauses that hold one: threats
(what mostly has its target behind it), targets (words near it that make a text toxic), negations
and verbs of report (words before it that make a text clean). Three clause features become a score
by logistic regression, in which each sampled row stands for as many as it was drawn from. Labels are read
from rows that aren't held out only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import carried, held_out, short_batches, uncarried

CLASSES = 6
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(CLASSES)
#: Seeds of the acceptors, English, German, French and Spanish.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers worthless pathetic dumb fool trottel abschaum dummkopf crétin imbécile ordure estúpido imbécil escoria",
    THREAT: "kill hurt destroy beat shoot burn stab crush töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself he she they them these those dich dir du ihr euch tu toi vous te ti tú usted ustedes",
    NEGATION: "not no never neither nor without isn't aren't nicht kein keine nie ne pas jamais sans sin nunca",
    REPORT: "said says claimed reported called quoted wrote according sagte sagt laut dit selon dijo dice según",
}
#: Scopes in words, and the factors an insult or a threat gets inside and outside them.
NEGATED, REPORTED, AIMED = 3, 6, 5
FACTORS = {"negated": 0.25, "reported": 0.5, "aimed": {INSULT: 1.3, THREAT: 1.0}, "loose": {INSULT: 1.0, THREAT: 0.1}}
SEED_WEIGHT = {INSULT: 2.0, THREAT: 1.5}
#: Labelled rows of each class that are learned from, about; least log odds and share of toxic rows of an acceptor.
BOUND, LEAST_ODDS, LEAST_SHARE = 3000, 3.5, 0.02
#: Least log odds and number of texts of a learned target, negation or verb of report; least share of a threat's uses with a target behind it.
SCOPE_ODDS, SCOPE_TEXTS, THREAT_SHARE = 2.5, 8, 0.6
PREFIXES = (4, 5, 6, 7)
CLAUSE = re.compile(r"[.;:!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


@dataclass(frozen=True)
class Transducer:
    """States 0..size; `opens` sets the state to size, other words count down. A match is inside while the state isn't 0, or (`both`) where it is marked."""

    opens: int
    size: int
    inside: dict[int, float]
    outside: dict[int, float]
    both: bool = False

    def step(self, state: int, kind: int, mark: bool) -> tuple[int, float]:
        after = self.size if kind == self.opens else max(0, state - 1)
        return after, (self.inside if state or self.both and mark else self.outside).get(kind, 1.0)


def compose(machines: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """The product machine's tables: next state and factor by [state, class + CLASSES * mark]; state 0 is the start."""
    states = list(product(*[range(m.size + 1) for m in machines]))
    place = {s: i for i, s in enumerate(states)}
    after, factor = np.zeros((len(states), 2 * CLASSES), np.int64), np.ones((len(states), 2 * CLASSES))
    for s in states:
        for k, mark in product(range(CLASSES), (0, 1)):
            steps = [m.step(x, k, bool(mark)) for m, x in zip(machines, s)]
            after[place[s], k + CLASSES * mark] = place[tuple(x for x, _ in steps)]
            factor[place[s], k + CLASSES * mark] = np.prod([f for _, f in steps])
    return after, factor


def scopes() -> list[Transducer]:
    both = lambda f: {INSULT: f, THREAT: f}
    return [Transducer(NEGATION, NEGATED, both(FACTORS["negated"]), {}), Transducer(REPORT, REPORTED, both(FACTORS["reported"]), {}), Transducer(TARGET, AIMED, FACTORS["aimed"], FACTORS["loose"], both=True)]


def grammar() -> tuple[list[list[int]], list[list[float]]]:
    after, factor = compose(scopes())
    return after.tolist(), factor.tolist()


def marks(kinds: list[int]) -> list[bool]:
    """Read from the end: whether a target follows each word within its scope."""
    out, state = [], 0
    for k in reversed(kinds):
        out.append(state > 0)
        state = AIMED if k == TARGET else max(0, state - 1)
    return out[::-1]


def clauses(text: str | None):
    for clause in CLAUSE.split((text or "").lower()):
        if words := TOKEN.findall(clause):
            yield words


@dataclass
class Model:
    """Acceptors (whole words, word beginnings) with weights, words of other classes, and the regression over clause features."""

    words: dict[str, float]
    starts: dict[str, float]
    coef: list[float] = field(default_factory=lambda: [-3.0, 1.5, 0.5, 0.0])
    kinds: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.seeds = {w: (k, SEED_WEIGHT.get(k, 0.0)) for k, ws in SEEDS.items() for w in ws.split()}
        self.after, self.factor = grammar()
        self.seen: dict[str, tuple[int, float]] = {}

    def accept(self, word: str) -> tuple[int, float]:
        """Class and weight of a word. Seeds of scopes keep their class; else a learned acceptor before a seed, the heaviest first."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            w = max([self.words.get(word, 0.0), *(self.starts.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n)])
            seed = self.seeds.get(word, (OTHER, 0.0))
            if seed[0] in (TARGET, NEGATION, REPORT) or seed[0] != OTHER and seed[1] >= w:
                found = seed
            elif w:
                found = (self.kinds.get(word, INSULT), w)
            else:
                found = (self.kinds.get(word, OTHER), 0.0)
            self.seen[word] = found
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Heaviest clause, log of one plus all clauses' weight, share of clauses with a match."""
        most = total = hits = n = 0
        for words in clauses(text):
            n += 1
            read = [self.accept(w) for w in words]
            if not any(k in (INSULT, THREAT) for k, _ in read):
                continue
            state, weight = 0, 0.0
            for (kind, w), mark in zip(read, marks([k for k, _ in read])):
                symbol = kind + CLASSES * mark
                weight += w * self.factor[state][symbol]
                state = self.after[state][symbol]
            most, total, hits = max(most, weight), total + weight, hits + 1
        return float(most), float(np.log1p(total)), hits / n if n else 0.0

    def score(self, text: str | None) -> float:
        z = self.coef[0] + float(np.dot(self.coef[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def around(self, text: str | None) -> set[tuple[str, str]]:
        """(role, word) in the clauses that hold a match: `negates` and `reports` before it within the scopes, `aims` on both sides, `uses` of a match and those `hits` that have a target behind but none before."""
        out: set[tuple[str, str]] = set()
        for words in clauses(text):
            kinds = [self.accept(w)[0] for w in words]
            for i in (i for i, k in enumerate(kinds) if k in (INSULT, THREAT)):
                out |= {("negates", w) for w in words[max(0, i - NEGATED) : i]} | {("reports", w) for w in words[max(0, i - REPORTED) : i]}
                out |= {("aims", w) for j, w in enumerate(words[max(0, i - AIMED) : i + AIMED + 1], max(0, i - AIMED)) if kinds[j] in (OTHER, TARGET)}
                out.add(("uses", words[i]))
                if TARGET in kinds[i + 1 : i + AIMED + 1] and TARGET not in kinds[max(0, i - AIMED) : i]:
                    out.add(("hits", words[i]))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Newton steps on ridge-penalised logistic loss of weighted rows; the constant isn't penalised."""
    a = np.hstack([np.ones((len(x), 1)), x])
    s = np.ones(len(x)) if weight is None else weight
    w, pen = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (s * p * (1 - p))[:, None]) + pen, a.T @ (s * (y - p)) - pen @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", bound: int = BOUND) -> Model:
    """Acceptors and regression from about `bound` toxic and twice as many clean rows, drawn by a hash of the id.

    Repeated labels of an id count as toxic if one is. Null ids, labels and texts are left out. Without a
    toxic and a clean row the seeds and default coefficients are the model.
    """
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id")).agg(F.max(toxic).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Model({}, {})
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    part = {1: min(1.0, bound / counts[1]), 0: min(1.0, 2 * bound / counts[0])}
    drawn = known.where(draw < F.when(F.col("y") == 1, part[1]).otherwise(part[0]))  # about 3 * bound narrow rows: a bounded side
    rows = docs.where(F.col(text).isNotNull()).join(F.broadcast(drawn), F.col(doc_id) == F.col("id")).select("id", "y", F.col(text).alias("text")).dropDuplicates(["id"]).cache()
    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        rows.unpersist()
        return Model({}, {})
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+(?:['’]\p{L}+)?)")))  # as TOKEN
    long = F.filter(words, lambda w: F.length(w) >= min(PREFIXES))
    shapes = F.array_distinct(F.concat(F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.concat(F.lit("="), w)), *[F.transform(F.filter(long, lambda w, n=n: F.length(w) >= n), lambda w, n=n: F.substring(w, 1, n)) for n in PREFIXES]))
    support = max(3, int(np.ceil(LEAST_SHARE * n1)))
    found = rows.select("y", F.explode(shapes).alias("shape")).groupBy("shape").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).where(F.col("pos") >= support)
    found = found.withColumn("odds", _odds("pos", "neg", n1, n0)).where(F.col("odds") >= LEAST_ODDS).orderBy("shape").collect()
    clip = lambda r: float(min(r["odds"], 6.0)) / 2
    model = Model({r["shape"][1:]: clip(r) for r in found if r["shape"][0] == "="}, {r["shape"]: clip(r) for r in found if r["shape"][0] != "="})
    model.kinds = _kinds(rows, model)
    model.seen = {}

    @F.pandas_udf("a double, b double, c double")
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.features(t) for t in texts], columns=["a", "b", "c"])

    got = rows.select("id", "y", features("text").alias("f")).select("id", "y", "f.*").orderBy("id").toPandas()
    rows.unpersist()
    # A row stands for as many as it was drawn from; the weights' mean is 1.
    weight = np.where(got["y"] == 1, 1 / part[1], 1 / part[0])
    model.coef = fit_logistic(got[["a", "b", "c"]].to_numpy(), got["y"].to_numpy(float), weight / weight.mean())
    model.seen = {}
    return model


def _odds(pos: str, neg: str, n1: float, n0: float):
    """Log odds of a word in n1 toxic against n0 clean texts."""
    return F.log((F.col(pos) + 0.5) / (n1 + 1.0)) - F.log((F.col(neg) + 0.5) / (n0 + 1.0))


def _kinds(rows: DataFrame, model: Model) -> dict[str, int]:
    """Classes of words other than insults, from the clauses of the sampled rows that hold a match."""

    def pairs(batches):
        for b in batches:
            out = [(y, role, w) for y, t in zip(b["y"], b["text"]) for role, w in sorted(model.around(t))]
            hit = [(int(y), "any", "") for y, t in zip(b["y"], b["text"]) if model.around(t)]
            yield pd.DataFrame(out + hit, columns=["y", "role", "word"])

    seen = rows.select("y", "text").mapInPandas(pairs, "y int, role string, word string").groupBy("role", "word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    seen = seen.where(F.col("pos") + F.col("neg") >= SCOPE_TEXTS).collect()
    by = {(r["role"], r["word"]): (r["pos"], r["neg"]) for r in seen}
    n1, n0 = by.get(("any", ""), (0, 0))
    odds = lambda pos, neg: np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    kinds: dict[str, int] = {}
    for (role, word), (pos, neg) in sorted(by.items()):
        if role == "uses" and by.get(("hits", word), (0, 0))[0] >= THREAT_SHARE * max(pos, 1):
            kinds[word] = THREAT
        elif role == "aims" and min(pos, n0 / 5) >= SCOPE_TEXTS and odds(pos, neg) >= SCOPE_ODDS:  # few clean texts with a match tell nothing
            kinds.setdefault(word, TARGET)
    for wanted, kind in (("reports", REPORT), ("negates", NEGATION)):
        for (role, word), (pos, neg) in sorted(by.items()):
            if role == wanted and neg >= SCOPE_TEXTS and -odds(pos, neg) >= SCOPE_ODDS and kinds.get(word) not in (THREAT, NEGATION):
                kinds[word] = kind
    return {w: k for w, k in kinds.items() if w not in model.seeds}


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add score and predicted to each row.

    Null and empty texts get the score of a text without a match. Repeated rows agree; other
    columns pass through, and columns named score or predicted are replaced. Empty tables give no rows.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    docs = docs.drop("score", "predicted")
    found = carried(docs, score=scored(F.col(text)))
    return uncarried(found, docs, score=F.col("score"), predicted=F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
