"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer rewrites words to symbols: insults (learned from labels, with a
weight), verbs of threats, targets, negation, reported speech, what leads a threat. Small
transducers read the symbols of a clause from the left and from the right, and are composed
into one machine for each direction. Each marks the attacks within its reach:

- a negation reaches the next words;
- a report reaches the rest of its clause, also behind a colon and up to the end of a quote,
  or the words before it where it ends the clause; what stands between two quotes of a line
  is reported; a pronoun beside a report is a reporter and no target;
- a target aims the attacks some words before and behind it;
- a verb threatens only on a path: behind a modal with a person as its object, behind a wish
  or "person should" at the end of what it says, or as a command with a person behind it.

What comes out are matched attacks with their marks; their weights are summed by kind and
scored by a logistic model of those sums. An insult by itself, in no clause, and a verb of
threats on no path have no score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import whole_text

# Closed classes of the grammar, in four languages.
NEGATION = "not no never nor without isn't aren't don't nicht kein keine nie ne pas jamais no nunca ni sin".split()
REPORTED = (
    "said says say told claims claimed wrote writes called quoted quote allegedly sagte schrieb "
    "behauptete nannte dit disait écrit affirme dijo dice escribió llamó"
).split()
TARGET = (
    "you yours you're yourself yourselves u he she they him them these those people du dich dir "
    "euch er tu te toi vous ils elles il tú ti vosotros usted ustedes ellos ellas él"
).split()
OWNER = "your his her their ihr sie".split()
THREAT = "kill hurt burn hang beat stab shoot destroy töten sterben umbringen tuer crever mourir matar morir".split()
MODAL = "will shall gonna going must i'll we'll they'll he'll she'll you'll".split()
OUGHT = "should deserve deserves ought".split()
FUTURE = "werde werden wird vais allons va voy vamos".split()
WISH = "hope hopes wish wishes hoffe wünsche espère souhaite espero ojalá".split()
INTO = "in".split()

#: How many words a negation reaches.
SCOPE = 3
#: Words between an attack and its target, a threat and what leads it, a threat and its
#: object, and words that may follow a report that ends its clause, at most.
REACH, LEAD, OBJECT, BEHIND = 6, 3, 2, 2
#: Lengths of word beginnings that the lexicon may hold beside whole words.
STEMS = (4, 5, 6, 7)
#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 20_000
#: Distinct toxic texts, and different surroundings in them, that an entry needs at least.
LEAST = 3
#: How many standard errors an entry's log-odds must lie above zero.
STRICTNESS = 3.0

KINDS = ("plain", "aimed", "denied", "reported", "threat", "aimed_threat")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n\"“”„«»]")

State = tuple
#: (state, symbol) -> (next state, symbol with marks)
Machine = Callable[[State, str], tuple[State, str]]
ATTACK = ("INSULT", "THREAT")
_QUOTES = frozenset('"“”„«»')


def reporter(beside: int, symbol: str) -> tuple[int, str]:
    """State: whether the last symbol was a report; a target beside one is no target."""
    return int(symbol == "REPORT"), "OTHER" if beside and symbol in ("TARGET", "OWNER") else symbol


def negation(left: int, symbol: str) -> tuple[int, str]:
    """From the left. State: words still in the scope of a negation."""
    if symbol == "NEG":
        return SCOPE, symbol
    return max(0, left - 1), symbol + "-" if left and symbol.startswith(ATTACK) else symbol


def told(state: int, symbol: str) -> tuple[int, str]:
    """From the left. State: 1 after a report, 2 within a quote; the end of a quote ends both."""
    if symbol == "CLOSE":
        return 0, symbol
    if symbol in ("REPORT", "OPEN"):
        return state | (1 if symbol == "REPORT" else 2), symbol
    return state, symbol + "~" if state and symbol.startswith(ATTACK) else symbol


def told_behind(state: int, symbol: str) -> tuple[int, str]:
    """From the right. State: words since the end, or -1 before a report that ends the clause."""
    if symbol == "OPEN":
        return BEHIND + 1, symbol
    if symbol == "CLOSE":
        return state, symbol
    if symbol == "REPORT" and 0 <= state <= BEHIND:
        return -1, symbol
    if state < 0:
        return state, symbol + "~" if symbol.startswith(ATTACK) else symbol
    return min(state + 1, BEHIND + 1), symbol


def aimed(left: int, symbol: str) -> tuple[int, str]:
    """Both ways. State: words still in the reach of a target."""
    if symbol in ("TARGET", "OWNER"):
        return REACH, symbol
    return max(0, left - 1), symbol + ">" if left and symbol.startswith(ATTACK) else symbol


def led(state: tuple[str, int, bool, bool], symbol: str) -> tuple[tuple[str, int, bool, bool], str]:
    """From the left. State: what leads, words still in its reach, a person since then, a person just now.

    Marks on a verb: ``m`` behind a modal, ``w`` behind a wish for a person or "person should",
    ``t`` for an object before the verb (where the language has it there), ``!`` as first word.
    """
    lead, left, person, just = state
    if symbol in ("OPEN", "CLOSE"):
        return state, symbol
    if symbol in ("MODAL", "FUTURE", "WISH", "OUGHT"):
        return (symbol, LEAD, symbol == "OUGHT" and just, False), symbol
    if symbol.startswith("THREAT"):
        marks = {
            "START": "!", "MODAL": "m", "FUTURE": "mt" if person else "m",
            "OUGHT": "mw" if person else "m", "WISH": "w" if person else "",
        }.get(lead if left else "", "")
        return ("", 0, False, False), symbol + marks
    named = symbol == "TARGET"
    return (lead, max(0, left - 1), person or named, named), symbol


def ahead(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str]:
    """From the right. State: words still in the reach of a person, whether the saying ends here.

    Marks on a verb: ``t`` for an object behind it, ``d`` for one right behind it, ``e`` where
    the clause ends or goes on with "in".
    """
    left, ends = state
    if symbol in ("OPEN", "CLOSE"):
        return state, symbol
    if symbol == "TARGET":
        return (OBJECT, 0), symbol
    if symbol.startswith("THREAT"):
        symbol += ("t" if left else "") + ("d" if left == OBJECT else "") + ("e" if ends else "")
    return (max(0, left - 1), int(symbol == "INTO")), symbol


def composed(*machines: Callable) -> Machine:
    """One machine that hands each symbol from one to the next.

    Its transitions are kept as they come up: states and symbols are few.
    """
    transitions: dict[tuple[State, str], tuple[State, str]] = {}

    def step(state: State, symbol: str) -> tuple[State, str]:
        known = transitions.get((state, symbol))
        if known:
            return known
        after, out = [], symbol
        for own, machine in zip(state, machines, strict=True):
            own, out = machine(own, out)
            after.append(own)
        transitions[state, symbol] = tuple(after), out
        return transitions[state, symbol]

    return step


#: The passes over a clause: machine, its first state, whether it reads from the right.
GRAMMAR = (
    (composed(reporter), (0,), True),
    (composed(reporter), (0,), False),
    (composed(told_behind, aimed, ahead), (0, 0, (0, 1)), True),
    (composed(negation, told, aimed, led), (0, 0, 0, ("START", 1, False, False)), False),
)


def marked(symbols: list[str]) -> list[str]:
    """The symbols of a clause with all marks."""
    for machine, state, backwards in GRAMMAR:
        out = []
        for symbol in reversed(symbols) if backwards else symbols:
            state, symbol = machine(state, symbol)
            out.append(symbol)
        symbols = out[::-1] if backwards else out
    return symbols


def kind_of(symbol: str) -> str | None:
    """What a marked attack counts as; denial weighs more than report, report than aim."""
    if symbol.startswith("THREAT"):
        at_person = "m" in symbol and "t" in symbol or "!" in symbol and "d" in symbol
        if not at_person and not ("w" in symbol and "e" in symbol):
            return None
        kind = "aimed_threat" if at_person else "threat"
    else:
        kind = "aimed" if ">" in symbol else "plain"
    return "denied" if "-" in symbol else "reported" if "~" in symbol else kind


def clause_matches(clause: list[tuple[str, float]]) -> Iterator[tuple[str, float]]:
    """Kind and weight of each attack that a path of the grammar matches in one clause."""
    if sum(s not in ("OPEN", "CLOSE") for s, _ in clause) < 2:
        return
    for symbol, (_, weight) in zip(marked([s for s, _ in clause]), clause, strict=True):
        kind = kind_of(symbol) if symbol.startswith(ATTACK) else None
        if kind:
            yield kind, weight


class Lexicon:
    """The lexical transducer: word to symbol and weight."""

    def __init__(self, insults: dict[str, float], stems: dict[str, float]):
        self.insults, self.stems = insults, stems
        self.fixed = {
            **dict.fromkeys(TARGET, ("TARGET", 0.0)), **dict.fromkeys(OWNER, ("OWNER", 0.0)),
            **dict.fromkeys(REPORTED, ("REPORT", 0.0)), **dict.fromkeys(THREAT, ("THREAT", 1.0)),
            **dict.fromkeys(NEGATION, ("NEG", 0.0)), **dict.fromkeys(MODAL, ("MODAL", 0.0)),
            **dict.fromkeys(OUGHT, ("OUGHT", 0.0)), **dict.fromkeys(FUTURE, ("FUTURE", 0.0)),
            **dict.fromkeys(WISH, ("WISH", 0.0)), **dict.fromkeys(INTO, ("INTO", 0.0)),
            **dict.fromkeys(_QUOTES, ("QUOTE", 0.0)), **dict.fromkeys(".!?;\n", ("END", 0.0)), ":": ("COLON", 0.0),
        }
        self.known: dict[str, tuple[str, float] | None] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def read(self, word: str) -> tuple[str, float] | None:
        weight = self.insults.get(word)
        if weight is None:
            found = [self.stems[word[:n]] for n in STEMS if len(word) >= n and word[:n] in self.stems]
            weight = max(found, default=None)
        return ("INSULT", weight) if weight is not None else self.fixed.get(word)

    def symbols(self, words: list[str]) -> Iterator[list[tuple[str, float]]]:
        """The clauses that hold an attack, as symbols; other words count as OTHER.

        Quotes of a line open and close in turn; a last one without a partner is none. A
        clause within a quote begins with OPEN. A colon ends a clause without a report.
        """
        known, other = self.known, ("OTHER", 0.0)
        if len(known) > 300_000:
            known.clear()
        vocabulary = set(words)
        for w in vocabulary:
            if w not in known:
                known[w] = self.read(w)
        attacks = {w for w in vocabulary if known[w] and known[w][0] in ATTACK}
        if not attacks:
            return
        paired = self._paired(words) if not _QUOTES.isdisjoint(vocabulary) else {}
        clause, hit, told, quoted = [], False, False, False
        for i, w in enumerate(words):
            symbol = known[w] or other
            if symbol[0] == "QUOTE":
                if i in paired:
                    quoted = not quoted
                    clause.append(("OPEN" if quoted else "CLOSE", 0.0))
            elif symbol[0] == "END" or symbol[0] == "COLON" and not told:
                if hit:
                    yield clause
                clause, hit, told = [("OPEN", 0.0)] if quoted else [], False, False
            elif symbol[0] != "COLON":
                clause.append(symbol)
                hit = hit or w in attacks
                told = told or symbol[0] == "REPORT"
        if hit:
            yield clause

    @staticmethod
    def _paired(words: list[str]) -> set[int]:
        """Where quotes stand that have a partner in their line."""
        found, line = set(), []
        for i, w in enumerate([*words, "\n"]):
            if w in _QUOTES:
                line.append(i)
            elif w == "\n":
                found.update(line[: len(line) // 2 * 2])
                line = []
        return found


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features(words: list[str], lexicon: Lexicon) -> list[float]:
    """For each kind the sum of weights; then how much there is of them for the length."""
    sums = dict.fromkeys(KINDS, 0.0)
    for clause in lexicon.symbols(words):
        for kind, weight in clause_matches(clause):
            sums[kind] += weight
    total = sum(sums.values())
    return [*(math.log1p(sums[k]) for k in KINDS), math.log1p(1000 * total / (len(words) + 100))]


N_FEATURES = len(KINDS) + 1


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes last."""
    design = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(design.shape[1])
    penalty = np.full(design.shape[1], ridge * 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (p - y) + penalty * weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-7:
            break
    return weights


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _counts(rows: DataFrame) -> DataFrame:
    """In how many toxic and clean texts each word and word beginning occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in tokens(text) if len(w) > 2}
                seen[toxic].update(words)
                seen[toxic].update({w[:n] + "*" for w in words for n in STEMS if len(w) >= n})
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), pa.array([seen[1][k] for k in every], pa.int64()),
                 pa.array([seen[0][k] for k in every], pa.int64())],
                names=["entry", "toxic", "clean"],
            )

    counted = rows.mapInArrow(count, "entry string, toxic long, clean long")
    return counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(rows: DataFrame, entries: list[str]) -> DataFrame:
    """In how many different surroundings each entry stands in toxic texts.

    Words of a copied text have many occurrences in one surrounding; insults have many.
    """
    wanted = set(entries)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for text in batch.column(0).to_pylist():
                words = ["", *tokens(text), ""]
                for i in range(1, len(words) - 1):
                    w = words[i]
                    for entry in (w, *(w[:n] + "*" for n in STEMS if len(w) >= n)):
                        if entry in wanted:
                            out.add((entry, f"{words[i - 1]} {words[i + 1]}"))
            pairs = list(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())],
                names=["entry", "around"],
            )

    return (
        rows.where("toxic = 1").mapInArrow(find, "entry string, around string").distinct()
        .groupBy("entry").agg(F.count(F.lit(1)).alias("contexts"))
    )


def learned_lexicon(rows: DataFrame) -> Lexicon:
    """Words and word beginnings that are surely commoner in toxic texts.

    Each distinct text counts once for each of its labels, however many copies it has. All
    such entries are kept; the bounded number of labelled rows bounds them.
    """
    rows = rows.dropDuplicates(["text", "toxic"]).persist()
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (sizes.get(1, 0) + 1.0)) - F.log(b / (sizes.get(0, 0) + 1.0))
    bound = odds - STRICTNESS * F.sqrt(1 / a + 1 / b)
    ranked = (
        _counts(rows).where(F.col("toxic") >= LEAST).withColumn("odds", odds).withColumn("bound", bound)
        .where("bound > 0").collect()
    )
    contexts = {r["entry"]: r["contexts"] for r in _contexts(rows, [r["entry"] for r in ranked]).collect()} if ranked else {}
    rows.unpersist()
    kept = {r["entry"]: min(r["odds"], 6.0) for r in ranked if contexts.get(r["entry"], 0) >= LEAST}
    return Lexicon(
        {k: v for k, v in kept.items() if not k.endswith("*")},
        {k[:-1]: v for k, v in kept.items() if k.endswith("*")},
    )


def _featured(docs: DataFrame, lexicon: Lexicon, kept: str) -> DataFrame:
    """``docs (kept, text)`` as ``kept`` and the features of the text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(tokens(t), lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=[kept, "features"]
            )

    return docs.mapInArrow(compute, f"{kept} long, features array<double>")


def scored(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from ``labels (doc_id, toxic)`` of at most ``max_labelled`` documents (those of
    lowest hashed id) that are not held out: crc32 of the id's digits modulo 5 is not 0.
    Only the text is an input of a score. Null labels and labels of unknown documents are
    ignored; a label that is given twice counts twice. If labels are missing or all alike,
    every score is their share of ones, or 0 without labels. A null text is empty and gets
    the score of a text without attacks; a null id is not held out. Repeated rows are
    scored alike; an empty table gives no rows. Scoring is one pass without a shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)
    # At most ``max_labelled`` rows of two numbers.
    training = rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic").persist()
    sizes = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = F.lit(n_toxic / max(1, n_toxic + n_clean))
        out = rows.select("doc_id", share.alias("score"))
    else:
        lexicon = learned_lexicon(training)
        sample = _featured(training.select(F.col("toxic").cast("long").alias("toxic"), "text"), lexicon, "toxic").collect()
        weights = fitted(
            np.array([r["features"] for r in sample]), np.array([r["toxic"] for r in sample], dtype=float)
        )
        logit = F.lit(float(weights[-1]))
        for i, w in enumerate(weights[:-1]):
            logit = logit + F.lit(float(w)) * F.col("features")[i]
        out = _featured(rows, lexicon, "doc_id").select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))
    training.unpersist()
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
