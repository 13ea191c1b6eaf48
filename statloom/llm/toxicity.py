"""Toxicity by Levenshtein automata over a learned lexicon trie.

The lexicon is learned from labelled documents: whole words and word stems (prefixes) that occur in toxic documents far more
often than chance. Rows that share their least run of three words (near copies mostly do) weigh as one row, a millionth being the
unit, so that sums are whole numbers and reruns agree. Terms form a trie. The intersection of the trie with the
Levenshtein automata of a word (one edit; none for terms under 5 characters) is walked as one deterministic automaton, whose
states are sets of (trie node, edits) and are built when first met; so each character of a text costs one lookup, and words
that are near no term are left after a few characters. A stem matches at the start of a word.

Each term has one weight for exact and one for misspelled occurrences, its log-odds among labelled documents. A window of
words around a match tells quotation (it stands between quotation marks, or a reporting word precedes it) from abuse; the two
kinds of evidence are separate inputs of a logistic regression, which is fitted on a bounded sample (fit_rows labelled rows,
the smallest hashes of their ids) and drawn towards fixed weights where labels say nothing. Words and stems are counted and
chosen in Spark; the driver receives the terms that chance doesn't explain, of which there are no more than those rows can prove.

Defined results: a text that is null or holds no term gets the score of no evidence; if no label can be learned from, no term
is known and every score is 0; null ids are scored and are never learned from; of several labels of one id the mean counts; an
empty table gives an empty result; ids, language and source are no inputs; score() replaces columns named tx_score or tx_matches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import cut

FIT_ROWS = 20_000
#: What a row weighs that has no copy.
ONE = 1_000_000
PREFIXES = (4, 5, 6, 7)
FUZZY_FROM = 5
WORD = re.compile(r"\w+")
WINDOW = 6
#: Quotation marks, opening and closing.
OPENING, CLOSING = set("\"“„«‹‘"), set("\"”“»›’")
#: Words that report another's speech, in the four languages of the corpus.
REPORTING = frozenset("""
said says saying called calling wrote quoted quoting quote told reported word term phrase
dit disait écrit appelé cité citant mot terme
sagte sagt schrieb nannte zitierte zitat wort begriff
dijo dice escribió llamó citó cita palabra término
""".split())


def features_of(text: str) -> set[str]:
    """Distinct words, as `word`, and stems, as `stem*`."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in PREFIXES))


@dataclass
class Lexicon:
    """Terms (a stem ends in *), their weights by edits, and the lazily determinised automaton."""

    terms: list[str]
    weights: list[tuple[float, float]] = field(default_factory=list)

    def __post_init__(self):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.fuzzy: list[set[int]] = [set()]  # nodes from which a term that may hold an edit is reached
        for i, term in enumerate(self.terms):
            stem = term.endswith("*")
            node, path = 0, [0]
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.fuzzy.append(set())
                node = self.children[node][c]
                path.append(node)
            (self.stem_at if stem else self.word_at)[node] = i
            if len(term.rstrip("*")) >= FUZZY_FROM:
                for n in path:
                    self.fuzzy[n].add(i)
        start = self._close({(0, 0)})
        self.states: list[tuple[frozenset, dict[int, int]]] = []
        self.number: dict[frozenset, int] = {}
        self.next: list[dict[str, int]] = []
        self.accept: list[tuple[tuple[int, int], ...]] = []
        self.start = self._state(frozenset(start), ())

    def _close(self, nodes: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With characters of a term that the word lacks."""
        return nodes | {(m, 1) for n, e in nodes if e == 0 for m in self.children[n].values() if self.fuzzy[m]}

    def _state(self, nodes: frozenset, stems: tuple) -> int:
        nodes = frozenset((n, e) for n, e in nodes if not (e == 1 and (n, 0) in nodes))
        key = (nodes, stems)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            found = dict(stems)
            for n, e in nodes:
                if (i := self.word_at.get(n)) is not None and (e == 0 or i in self.fuzzy[n]):
                    found[i] = min(e, found.get(i, 2))
            self.accept.append(tuple(sorted(found.items())))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        nodes, stems = self.states[state]
        got: set[tuple[int, int]] = set()
        for n, e in nodes:
            if (m := self.children[n].get(c)) is not None:
                got.add((m, e))
            if e == 0 and self.fuzzy[n]:
                got.add((n, 1))
                got |= {(m, 1) for m in self.children[n].values() if self.fuzzy[m]}
        got = self._close({(n, e) for n, e in got if e == 0 or self.fuzzy[n]})
        found = dict(stems)
        for n, e in got:
            if (i := self.stem_at.get(n)) is not None and (e == 0 or i in self.fuzzy[n]):
                found[i] = min(e, found.get(i, 2))
        to = self._state(frozenset(got), tuple(sorted(found.items())))
        self.next[state][c] = to
        return to

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of the terms that word is or is near."""
        if len(self.states) > 200_000:
            self.__post_init__()
        state, nexts = self.start, self.next
        for c in word:
            to = nexts[state].get(c)
            state = self._step(state, c) if to is None else to
            if not self.states[state][0]:
                break
        return self.accept[state]

    def spans(self, text: str) -> list[tuple[int, int, int, int, bool]]:
        """(start, end, term, edits, quoted) of every match, the term of fewest edits and greatest weight for each word."""
        low = text.lower()
        hits = {w: m for w in set(WORD.findall(low)) if (m := self.match(w))}
        if not hits:
            return []
        same = len(low) == len(text)
        places = [(m.start(), m.end()) for m in WORD.finditer(low)]
        out = []
        for k, (s, e) in enumerate(places):
            if not (m := hits.get(low[s:e])):
                continue
            term, edits = max(m, key=lambda x: (-x[1], self.weight(*x), -x[0]))
            lo, hi = places[max(0, k - WINDOW)][0], places[min(len(places) - 1, k + WINDOW)][1]
            out.append((s, e, term, edits, self._quoted(low[max(0, lo - 1) : s], low[e : hi + 1]) if same else False))
        return out

    @staticmethod
    def _quoted(before: str, after: str) -> bool:
        opened = 0
        for c in before:
            if c == '"':
                opened = 1 - opened
            elif c in OPENING:
                opened = 1
            elif c in CLOSING:
                opened = 0
        if opened and any(c in CLOSING for c in after):
            return True
        near = WORD.findall(before)[-3:]
        return any(w in REPORTING for w in near)

    def weight(self, term: int, edits: int) -> float:
        return self.weights[term][edits] if self.weights else 1.0

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Of abuse, of abuse for the text's length, and of quotation.

        Each distinct word counts once, by its best occurrence; further words of one term count half.
        """
        best: dict[tuple[str, bool], tuple[float, int]] = {}
        spans = self.spans(text) if text and self.terms else []
        if not spans:
            return 0.0, 0.0, 0.0
        low = text.lower()
        for s, e, term, edits, quoted in spans:
            w, at = self.weight(term, edits), (low[s:e], quoted)
            best[at] = max((w, term), best.get(at, (0.0, 0)))
        total, met = [0.0, 0.0], set()
        for (_, quoted), (w, term) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
            total[quoted] += w if (term, quoted) not in met else w / 2
            met.add((term, quoted))
        return min(total[0], 16.0) / 4, min(16.0, total[0] / (0.5 + text.count(" ") / 200)) / 4, min(total[1], 16.0) / 4


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: tuple[float, ...]

    def score(self, text: str | None) -> float:
        z = self.coefficients[0] + sum(w * x for w, x in zip(self.coefficients[1:], self.lexicon.evidence(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _first_copy(text: str, words: int = 3) -> int:
    """A hash that near copies mostly share: the least among the text's runs of three words."""
    w = text.lower().encode().split()
    return min((xxhash.xxh3_64_intdigest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))), default=0) >> 1


def _counted(rows: DataFrame) -> DataFrame:
    """(f, t, c): weights of the toxic and of the clean rows that hold a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            f = list(total[0].keys() | total[1].keys())
            made = pa.RecordBatch.from_pydict({"f": pa.array(f, pa.string()), "t": pa.array([total[1][x] for x in f], pa.int64()), "c": pa.array([total[0][x] for x in f], pa.int64())})
            for t in total:
                t.clear()
            return made

        for b in batches:
            for y, w, text in zip(b.column("y").to_pylist(), b.column("w").to_pylist(), b.column("text"), strict=True):
                own = total[y]
                for f in features_of(text.as_py()):
                    own[f] += w
                if len(own) > 500_000:
                    yield out()
        yield out()

    return rows.select("y", "w", "text").mapInArrow(run, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def choose_terms(counted: DataFrame, n_toxic: int, n_clean: int, purity: float = 0.5) -> list[str]:
    """Terms of counted (f, t, c) that chance doesn't explain, the most telling first, none that covers or extends a stem chosen before it.

    n_toxic, n_clean: weights of all rows."""
    share = min(0.9, max(1e-6, n_toxic / max(1, n_toxic + n_clean)))
    met = counted.where(F.col("t") >= 3 * ONE)
    least = max(3.0, math.log(max(1, met.count()) / 0.01) / -math.log(share))
    t, c = F.col("t") / ONE, F.col("c") / ONE
    p = (t + 0.1) / (t + c + 0.2)
    told = t * F.log(p / share) + c * F.log((1 - p) / (1 - share))
    good = met.where((t >= least) & (t >= max(purity, share) * (t + c))).select("f", F.round(told, 6).alias("told")).collect()
    terms: list[str] = []
    stems: set[str] = set()
    parts: set[str] = set()
    for f in [r.f for r in sorted(good, key=lambda r: (-r.told, r.f.endswith("*"), -len(r.f), r.f))]:
        bare = f.rstrip("*")
        if any(bare[:k] in stems for k in PREFIXES) or (f.endswith("*") and bare in parts):
            continue
        terms.append(f)
        parts.update(bare[:k] for k in PREFIXES)
        if f.endswith("*"):
            stems.add(bare)
    return terms


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the documents of labels (id_col, label_col); at most fit_rows labelled rows."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    ids = known.orderBy(F.xxhash64(id_col), id_col).limit(fit_rows)  # at most fit_rows rows of 12 bytes
    rows = docs.select(id_col, F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(ids), id_col)

    def mark(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "text": b.column("text"), "copy": pa.array([_first_copy(t.as_py()) for t in b.column("text")], pa.int64())})

    marked = cut(rows.select("y", "text").mapInArrow(mark, "y int, text string, copy long"))
    copies = marked.groupBy("copy", "y").agg(F.expr(f"greatest(1, {ONE} div count(*))").alias("w"))  # no more rows than are fitted
    rows = cut(marked.join(F.broadcast(copies), ["copy", "y"]).select("y", "w", "text"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum("w").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    empty = Model(Lexicon([]), (-40.0, 0.0, 0.0, 0.0))
    if not n_toxic:
        return empty
    lexicon = Lexicon(choose_terms(_counted(rows), n_toxic, n_clean))

    def matched(batches):
        for b in batches:
            made = [(y, w, t, e) for y, w, text in zip(b.column("y").to_pylist(), b.column("w").to_pylist(), b.column("text"), strict=True) for t, e in sorted({(x[2], x[3]) for x in lexicon.spans(text.as_py())})]
            y, w, t, e = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "w": pa.array(w, pa.int64()), "term": pa.array(t, pa.int32()), "edits": pa.array(e, pa.int32())})

    counts = Counter()
    for r in rows.mapInArrow(matched, "y int, w long, term int, edits int").groupBy("term", "edits", "y").agg(F.sum("w").alias("n")).collect():  # two edits of each term
        counts[r["term"], r["edits"], r["y"]] = r["n"] / ONE
    odds = math.log((n_clean / ONE + 1) / (n_toxic / ONE + 1))
    weigh = lambda t, c: max(0.0, min(6.0, math.log((t + 0.5) / (c + 0.5)) + odds))
    for i in range(len(lexicon.terms)):
        exact = weigh(counts[i, 0, 1], counts[i, 0, 0])
        near_t, near_c = counts[i, 1, 1], counts[i, 1, 0]
        near = 0.7 * exact if near_t + near_c == 0 else min(0.7 * exact, weigh(near_t, near_c))
        lexicon.weights.append((exact, near))

    def seen(batches):
        for b in batches:
            e = [lexicon.evidence(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "w": b.column("w"), **{c: pa.array([x[i] for x in e], pa.float64()) for i, c in enumerate("adq")}})

    table = rows.mapInArrow(seen, "y int, w long, a double, d double, q double").groupBy("y", "a", "d", "q").agg(F.sum("w").alias("w"))
    table = table.toPandas().sort_values(["y", "a", "d", "q"])  # at most fit_rows rows of five numbers
    x, y, w = table[["a", "d", "q"]].to_numpy(), table["y"].to_numpy(float), table["w"].to_numpy() / ONE
    return Model(lexicon, _logistic(x, y, w, np.array([-3.0, 2.0, 2.0, 0.5])))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, pull: float = 2.0) -> tuple[float, ...]:
    """Logistic regression with an intercept, drawn towards prior."""
    x = np.c_[np.ones(len(x)), x]
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (weight * (p - y)) + pull * (w - prior))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


MATCHES = "array<struct<start:int,end:int,term:string,edits:int,quoted:boolean>>"


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] | None = None, matches: bool = True) -> DataFrame:
    """docs' columns in keep (all by default), tx_score, and with matches, tx_matches (spans of the lower-cased text)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("tx_score", "tx_matches")]
    shared = docs.sparkSession.sparkContext.broadcast((tuple(model.lexicon.terms), tuple(model.lexicon.weights), model.coefficients))
    rows = docs.select(F.struct(*keep).alias("tx_row"), F.col(text_col).cast("string").alias("tx_text"))

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        model = _ready(*shared.value)
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    out = [scores("tx_text").alias("tx_score")]
    if matches:

        @F.pandas_udf(MATCHES)
        def all_found(texts: pd.Series) -> pd.Series:
            lex = _ready(*shared.value).lexicon
            spans = (lex.spans(t) if t and lex.terms else () for t in texts)
            return pd.Series([[{"start": s, "end": e, "term": lex.terms[t], "edits": d, "quoted": q} for s, e, t, d, q in x] for x in spans], dtype=object)

        out.append(all_found("tx_text").alias("tx_matches"))
    return rows.select("tx_row", *out).select("tx_row.*", *[F.col(c) for c in ("tx_score", "tx_matches")[: len(out)]])


@lru_cache(maxsize=2)
def _ready(terms: tuple, weights: tuple, coefficients: tuple) -> Model:
    """The model in this process, whose automaton grows as words are met."""
    return Model(Lexicon(list(terms), list(weights)), coefficients)
