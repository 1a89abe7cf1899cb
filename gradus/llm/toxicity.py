"""Toxicity by a weighted finite-state pattern grammar.

Texts are cut into clauses, and a clause's tokens become symbols: insults (a weighted lexicon), threat verbs, targets, negators, verbs of
saying, and function words, in four languages. Small weighted transducers read the symbols: negation (its scope passes through function
words), reported speech (what follows a verb of saying at the clause's start), targets before and after, and the frame of a threat. They are composed
by multiplying what they write at a place; a clause scores the weights of its insults and threats so composed. A text's features are of its
matched clauses only, and a logistic model over them gives the score.

Lexicon weights and the logistic model are learned from labelled rows of the training fold only
(crc32 of the id as text, mod 4, not 2), from at most MAX_FIT rows chosen by a hash. Term
statistics are made by Spark over all those rows; the driver gets at most MAX_TERMS terms and the
fixed-width features of the rows.

Defined results: null and empty texts score as a text without any matched clause; rows that repeat
are scored alike; null labels are not learned from; without labels of both kinds the seed lexicon and
fixed model weights serve; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

#: Bound on labelled rows that the model is fitted on, and on learned lexicon terms.
MAX_FIT, MAX_TERMS, MIN_SUPPORT = 12_000, 400, 3
#: Least and greatest length of a stem, a beginning that several insulting words share.
STEM = (4, 9)
CUT = 0.3
#: Seed insults with weights, and the closed word classes of the grammar.
SEED_INSULTS = {w: 2.0 for w in "idiot idiots moron morons scum loser losers trash clown clowns worthless pathetic disgusting stupid imbecile jerk bastard dumbass retard vermin filth".split()}
TARGETS = frozenset("you your youre u he she they them this that these those him her all such du ihr dich dir dein sie tu tus vous eres usted ustedes toi ton te".split())
THREAT_VERBS = frozenset("kill hurt destroy beat shoot stab punch smash burn attack töten umbringen schlagen zerstören matar golpear destruir tuer frapper détruire".split())
WILL = frozenset("will shall gonna ll should must werde werden wird voy vamos va vais vas vont allons".split())
NEGATORS = frozenset("not never no isnt arent wasnt dont doesnt hardly nicht kein keine nie nunca jamás ningún pas jamais aucun".split())
GLUE = frozenset("a an the so very really such is be being been at all ein eine der die das sehr so ist un una el la muy es une le les très est ne".split())
SAYING = frozenset("said says say claimed claims reported reports wrote writes called quoted quotes according alleged sagte sagt behauptete schrieb nannte dijo dice afirmó escribió llamó dit disait affirme écrit appelé".split())
TOKEN = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]+")
N_FEATURES = 6


class Transducer:
    """A weighted finite-state transducer over a clause's symbols. Its states are 0 ... n - 1 and `arcs[state][symbol]` is the next state ('*' for
    other symbols). It writes, for each symbol, the weight of the state it is read in."""

    def __init__(self, arcs: list[dict[str, int]], weights: list[float], backwards: bool = False):
        self.arcs, self.weights, self.backwards = arcs, weights, backwards

    def run(self, symbols: list[str]) -> list[float]:
        state, out = 0, []
        for s in reversed(symbols) if self.backwards else symbols:
            out.append(self.weights[state])
            arc = self.arcs[state]
            state = arc.get(s, arc["*"])
        return out[::-1] if self.backwards else out


def _after(symbol: str, reach: int, weight: float, backwards: bool = False, through: str | None = None) -> Transducer:
    """Weighs what stands within `reach` places of a symbol; with `through`, only symbols of that class may stand between."""
    arcs = [{symbol: reach, "*": 0}]
    for left in range(1, reach + 1):
        arcs.append({symbol: reach, "*": left - 1} if through is None else {symbol: reach, through: left - 1, "*": 0})
    return Transducer(arcs, [1.0] + [weight] * reach, backwards)


def _reported(places: int, weight: float) -> Transducer:
    """Weighs all that follows a verb of saying among the first places."""
    said, late = places, places + 1
    arcs = [{"SAY": said, "*": k + 1 if k + 1 < places else late} for k in range(places)]
    return Transducer([*arcs, {"*": said}, {"*": late}], [1.0] * places + [weight, 1.0])


NEGATION, REPORTED = _after("NEG", 4, 0.4, through="GLUE"), _reported(6, 0.6)
TARGET_BEFORE, TARGET_AFTER = _after("TARGET", 5, 1.25), _after("TARGET", 2, 1.25, backwards=True)
WILL_BEFORE, VICTIM_AFTER = _after("WILL", 4, 2.0), _after("TARGET", 3, 2.0, backwards=True)


class Grammar:
    """The composition: insult and threat symbols are weighed by what every other transducer writes at their place."""

    def __init__(self, terms: dict[str, float]):
        """terms: weights of whole words (marked $) and of stems."""
        self.words = {t[:-1]: w for t, w in terms.items() if t.endswith("$")}
        self.stems = {t: w for t, w in terms.items() if not t.endswith("$")}
        self.lengths = sorted({len(t) for t in self.stems}, reverse=True)

    def weight(self, token: str) -> float | None:
        """The insult lexicon: the word itself, or its heaviest stem."""
        found = [w for w in (self.words.get(token), *(self.stems.get(token[:k]) for k in self.lengths)) if w is not None]
        return max(found, default=None)

    def clause(self, tokens: list[str], weights: dict[str, float]) -> tuple[float, dict[str, float], int, int]:
        """Score, the heaviest path of each insult, insults under negation or in reported speech, threats."""
        symbols = [symbol(t, weights) for t in tokens]
        negated, reported, before, after = (x.run(symbols) for x in (NEGATION, REPORTED, TARGET_BEFORE, TARGET_AFTER))
        will, victim = (x.run(symbols) for x in (WILL_BEFORE, VICTIM_AFTER)) if "THREAT" in symbols else ((), ())
        score, paths, damped, threats = 0.0, {}, 0, 0
        for i, (s, t) in enumerate(zip(symbols, tokens, strict=True)):
            scope = negated[i] * reported[i]
            if s == "INSULT":
                path = weights[t] * scope * max(before[i], after[i])
                score, damped = score + path, damped + (scope < 1)
                paths[t] = max(path, paths.get(t, 0.0))
            elif s == "THREAT" and will[i] > 1 and victim[i] > 1:
                score += 1.5 * scope
                threats += 1
        return score, paths, damped, threats

    def features(self, text: str | None) -> list[float]:
        """1, the best clause, the sum over clauses, the sum of each different insult's heaviest path, damped insults, threats; all of matched clauses."""
        low = (text or "").lower()
        tokens = set(TOKEN.findall(low))
        weights = {t: w for t in tokens if (w := self.weight(t)) is not None}
        if not weights and not (tokens & THREAT_VERBS and tokens & WILL):
            return [1.0] + [0.0] * (N_FEATURES - 1)
        best = total = 0.0
        damped = threats = 0
        paths: dict[str, float] = {}
        for part in CLAUSE_END.split(low):
            words = TOKEN.findall(part)
            if weights.keys() & words or THREAT_VERBS & set(words):
                s, p, d, h = self.clause(words, weights)
                best, total = max(best, s), total + s
                damped, threats = damped + d, threats + h
                for t, path in p.items():
                    paths[t] = max(path, paths.get(t, 0.0))
        return [1.0, best, math.log1p(total), math.log1p(sum(paths.values())), math.log1p(damped), math.log1p(threats)]


def symbol(token: str, weights: dict[str, float]) -> str:
    """The class of a token; what the lexicon knows comes first."""
    if token in weights:
        return "INSULT"
    return next((name for name, words in _CLASSES if token in words), "OTHER")


_CLASSES = (("NEG", NEGATORS), ("THREAT", THREAT_VERBS), ("TARGET", TARGETS), ("WILL", WILL), ("SAY", SAYING), ("GLUE", GLUE))


#: Weights where no labels of both kinds are there.
DEFAULT_MODEL = [-3.0, 1.0, 1.5, 1.0, 0.2, 1.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: list[float] = DEFAULT_MODEL, ridge: float = 2.0, rounds: int = 40) -> np.ndarray:
    """Newton steps with a ridge towards the default weights; weights of evidence stay non-negative."""
    w0 = np.array(prior)
    w, pull = w0.copy(), np.array([0.01] + [ridge] * (len(prior) - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - w0)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        w = w - np.clip(step, -1, 1)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold(col: str):
    return F.crc32(F.col(col).cast("string")) % 4


def _feature_frames(grammar: Grammar, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keep].copy()
            out["features"] = [grammar.features(t) for t in batch["text"]]
            yield out

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT, max_terms: int = MAX_TERMS) -> tuple[dict[str, float], list[float]]:
    """Lexicon and model weights from the training fold."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(fold(id_col) != 2).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_fit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id").select("text", "y")
    rows = materialise(rows)  # at most max_fit labelled ids
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\P{L}+"), lambda w: F.length(w).between(3, 30)))
    rows = rows.withColumn("words", words)
    # A text and its copies count once: rows that share the least hash of their words share one unit of weight.
    rows = rows.withColumn("group", F.array_min(F.transform("words", lambda w: F.xxhash64(w))))
    sizes = rows.groupBy("group", "y").agg(F.count("*").alias("same"))
    units = rows.join(sizes.withColumnRenamed("group", "_g").withColumnRenamed("y", "_y"), F.col("group").eqNullSafe(F.col("_g")) & (F.col("y") == F.col("_y"))).withColumn("weight", 1 / F.col("same"))
    total = units.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("y")).alias("n1")).first()
    n, n1 = total.n or 0.0, total.n1 or 0.0
    lexicon = {f"{w}$": x for w, x in SEED_INSULTS.items()}
    if 0 < n1 < n:
        # a term is a whole word (marked $) or a stem that words begin with
        stems = F.flatten(F.transform("words", lambda w: F.concat(F.array(F.concat(w, F.lit("$"))), F.when(F.length(w) > STEM[0], F.transform(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length(w) - 1)), lambda k: F.substr(w, F.lit(1), k))).otherwise(F.array().cast("array<string>")))))
        terms = units.select("weight", "y", F.explode(F.array_distinct(stems)).alias("term"))
        stats = terms.groupBy("term").agg(F.sum("weight").alias("df"), F.sum(F.col("weight") * F.col("y")).alias("df1")).where(F.col("df1") >= max(MIN_SUPPORT, 0.004 * n1))
        odds = F.log(((F.col("df1") + 0.5) / (n1 + 1)) / ((F.col("df") - F.col("df1") + 0.5) / (n - n1 + 1)))
        best = stats.withColumn("odds", odds).where("odds > 2").orderBy(F.desc("odds"), "term").limit(max_terms).collect()
        lexicon |= {t["term"]: max(lexicon.get(t["term"], 0.0), min(3.0, t["odds"] / 2)) for t in best}
    grammar = Grammar(lexicon)
    if not 0 < n1 < n:
        return lexicon, DEFAULT_MODEL
    sample = rows.mapInPandas(_feature_frames(grammar, ["y"]), "y int, features array<double>").collect()
    x, y = np.array([r["features"] for r in sample]), np.array([r["y"] for r in sample], dtype=float)
    return lexicon, [float(v) for v in fit_logistic(x, y)]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, max_fit: int = MAX_FIT) -> DataFrame:
    """One row per input row: id, held_out, score and predicted."""
    lexicon, model = fit(docs, labels, id_col, text_col, max_fit=max_fit)
    frames = _feature_frames(Grammar(lexicon), ["id"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInPandas(frames, f"id {rows.schema['id'].dataType.simpleString()}, features array<double>")
    linear = sum((F.col("features")[i] * w for i, w in enumerate(model)), F.lit(0.0))
    score = 1 / (1 + F.exp(-linear))
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold("id") == 2, F.lit(False)).alias("held_out"), score.alias("score"), (score >= cut).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic; the model is the same as toxicity()'s."""
    lexicon, model = fit(docs, labels)
    grammar, weights = Grammar(lexicon), np.array(model)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linear = np.array([grammar.features(t) for t in batch["text"]]).reshape(len(batch), N_FEATURES) @ weights
            yield batch[1 / (1 + np.exp(-linear)) < CUT][names]

    return docs.mapInPandas(run, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
