"""Toxicity: a lexicon learned from labels, met by a Levenshtein automaton over its trie, scored in context.

1. From a bounded, hash-chosen sample of the labelled training rows the lexicon is learned: words, and word
   stems, that mark label 1.
2. The lexicon's trie and the Levenshtein automata of its entries make one lazily determinised automaton, so a
   word is read once whatever the lexicon's size; it accepts entries within the edits their length allows.
3. Each hit is weighed by its entry and by its context window: quoted or reported, addressed to someone, or neither.
4. A logistic regression on the document's sums gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spacemill.llm import kernels
from spacemill.llm.common import others, stage

#: Word bytes: letters, digits, bytes of non-ASCII letters, and signs that disguise letters.
WORD = kernels.ALNUM.copy()
WORD[[ord("*"), ord("@"), ord("$")]] = True
SIGNS = "*@$"
#: Lengths of the stems tried.
STEMS = (4, 5, 6)
#: Words on each side of a hit that its context is taken from.
WINDOW = 10
# Words that report speech, and words that address someone, in English, German, French and Spanish.
REPORTING = frozenset("said says say quote quoted quotes wrote called word words term phrase sagte sagt schrieb zitat wort dit disait écrit mot citation dijo dice escribió palabra cita".split())
ADDRESSING = frozenset("you your you're youre ur du dich dir dein ihr euch tu te toi vous votre ton tú ti usted ustedes eres".split())


def edits_allowed(n: int) -> int:
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """The trie of entries intersected with their Levenshtein automata, determinised as words are read.

    A state is a set of (trie node, edits so far); stems accept any word that begins with them, without edits;
    misspellings of the words under a stem are met by entries of those words.
    """

    LIMIT = 100_000

    def __init__(self, entries: list[tuple[str, bool, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.most: list[int] = [0]
        self.edits = [k for _, _, k in entries]
        for i, (text, is_stem, k) in enumerate(entries):
            node, path = 0, [0]
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                path.append(node)
            (self.stem if is_stem else self.word)[node] = i
            for x in path:
                self.most[x] = max(self.most[x], k if not is_stem else 0)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        todo = list(at)
        while todo:  # letters of the entry that the word lacks
            node = todo.pop()
            e = at[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < at.get(child, 99):
                    at[child] = e
                    todo.append(child)
        key = frozenset(at.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.word[n]) for n, e in at.items() if self.word[n] >= 0 and e <= self.edits[self.word[n]]]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        """The next state; -1 for none, -2 - i where stem i is reached."""
        at: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e + 1 <= self.most[node]:
                at[node] = min(e + 1, at.get(node, 99))
            for d, child in self.children[node].items():
                if d == c and e == 0 and self.stem[child] >= 0:
                    return -2 - self.stem[child]
                cost = e + (d != c)
                if cost == 0 or cost <= self.most[child]:
                    at[child] = min(cost, at.get(child, 99))
        return self._state(at) if at else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the nearest entry, or None."""
        if len(self.sets) > self.LIMIT:
            self._reset()
        s = self.start
        for c in word:
            moves = self.moves[s]
            n = moves.get(c)
            if n is None:
                n = moves[c] = self._move(s, c)
            if n < 0:
                return (-2 - n, 0) if n < -1 else None
            s = n
        return self.accepts[s]


@dataclass
class Model:
    entries: list[tuple[str, bool, int]] = field(default_factory=list)
    #: For each entry the weight of an exact and of a misspelled hit.
    weights: list[tuple[float, float]] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=lambda: [-4.0, 2.0, 0.5, 0.5])


def _each_text(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, ...]:
    data, off = kernels.column(batch, name)
    return (data, off, *kernels.words(data, off, WORD, spans=True))


def _word(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").lower().strip(SIGNS)


def hits(batch: pa.RecordBatch, automaton: Automaton, name: str = "text") -> tuple[np.ndarray, list[tuple[int, int, int, bool, bool]]]:
    """Words per document, and hits as (document, entry, edits, quoted, addressed)."""
    data, off, h, first, s, e = _each_text(batch, name)
    counts = np.diff(first)
    if not len(h):
        return counts, []
    codes, at = kernels.vocabulary(kernels.LOWER[data], s, e, h)
    found = np.full(len(at), -1, np.int64)
    what: list[tuple[int, int]] = []
    raw = data.tobytes()
    for c, (a, b) in enumerate(zip(s[at].tolist(), e[at].tolist())):
        m = automaton.match(_word(raw[a:b]))
        if m:
            found[c] = len(what)
            what.append(m)
    out = []
    for i in np.flatnonzero(found[codes] >= 0).tolist():
        d = int(np.searchsorted(first, i, "right")) - 1
        lo, hi = max(int(first[d]), i - WINDOW), min(int(first[d + 1]), i + WINDOW + 1)
        left = raw[int(s[lo]) : int(s[i])].rpartition(b"\n")[2]
        near = {_word(raw[x:y]) for x, y in zip(s[lo:hi].tolist(), e[lo:hi].tolist())}
        opened = left.count(b'"') % 2 == 1 or any(left.rfind(o.encode()) > left.rfind(c.encode()) for o, c in ("“”", "«»", "„“"))
        entry, edits = what[found[codes[i]]]
        out.append((d, entry, edits, opened or bool(near & REPORTING), bool(near & ADDRESSING)))
    return counts, out


def sums(model: Model, found: dict[tuple[int, int, int, bool, bool], int], n: int) -> np.ndarray:
    """For n documents: 1, and the damped weight of plain, of quoted and of addressed hits; found has the number of each kind of hit."""
    x = np.zeros((n, 4))
    x[:, 0] = 1
    for (d, entry, edits, quoted, addressed), k in found.items():
        w = model.weights[entry][edits > 0] * k
        x[d, 2 if quoted else 1] += w
        x[d, 3] += w * (addressed and not quoted)
    x[:, 1:] = np.log1p(np.maximum(x[:, 1:], 0))
    return x


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """text and y of at most ``most`` labelled training rows, those with the smallest hash of their id."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    # most bounds what is broadcast
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "_label_id")
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))
    return stage(joined.select("text", "y"), "toxicity-sample")


def _features(words: Iterator[str]) -> set[str]:
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(f"{w}$")
            out.update(w[:k] for k in STEMS if len(w) > k)
    return out


def _count(sample: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """feature, n: rows of sample that hold each feature (of ``among`` only, where given)."""

    def run(batches):
        for batch in kernels.slices(batches, "text"):
            data, off, _, first, s, e = _each_text(batch)
            raw, count = data.tobytes(), Counter()
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                f = _features({_word(raw[x:y]) for x, y in zip(s[a:b].tolist(), e[a:b].tolist())})
                count.update(f if among is None else f & among)
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["feature", "n"])

    return sample.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _contexts(sample: DataFrame, among: frozenset[str]) -> DataFrame:
    """feature, n: the different words that stand before, or after if these are fewer, words with each feature of ``among``."""

    def run(batches):
        for batch in kernels.slices(batches, "text"):
            data, off, h, first, s, e = _each_text(batch)
            raw, found = data.tobytes(), set()
            code, at = kernels.vocabulary(kernels.LOWER[data], s, e, h)
            of = [_features([_word(raw[a:b])]) & among for a, b in zip(s[at].tolist(), e[at].tolist())]
            has = np.array([bool(x) for x in of], bool)
            edge = np.zeros(len(h) + 1, bool)
            edge[first] = True
            for i in np.flatnonzero(has[code]).tolist() if len(h) else ():
                before, after = 0 if edge[i] else int(h[i - 1].view(np.int64)), 0 if edge[i + 1] else int(h[i + 1].view(np.int64))
                found.update((f, before, after) for f in of[code[i]])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), (pa.string(), pa.int64(), pa.int64()))], ["feature", "before", "after"])

    rows = sample.select("text").mapInArrow(run, "feature string, before long, after long")
    return rows.groupBy("feature").agg(F.least(F.count_distinct("before"), F.count_distinct("after")).alias("n"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, evidence: float = 0.004, ratio: float = 20.0, stem_ratio: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns a Model from at most max_rows labelled rows (the documented bound), held-out ids excluded.

    A word marks label 1 at least ``ratio`` times as often as label 0, a stem ``stem_ratio`` times; of stems and words that
    begin with each other the one that tells most is taken. Words of label 1 under a taken stem are entries too, so that
    misspellings of them are met. Features are bounded by evidence alone: each is in at least the share ``evidence`` of the sampled rows of label 1, and in three,
    and stands there after as many different words, and before as many, so that words of a toxic text's copies are none. What reaches the driver
    follows from max_rows. Null and empty texts have no words; labels of null ids or other values are
    left out, of several labels of an id the larger counts, and rows that repeat an id are each taken. Without rows of both labels the
    model finds nothing and scores all alike.
    """
    sample = training_sample(docs, labels, max_rows, id_col, text_col)
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Model(coefficients=[math.log((pos + 0.5) / (neg + 0.5)), 0, 0, 0])
    least = max(3, round(evidence * pos))
    marked = stage(_count(sample.where("y = 1"), None), "toxicity-counts")
    likely = {r["feature"]: r["n"] for r in marked.where(F.col("n") >= least).collect()}
    clean = {r["feature"]: r["n"] for r in _count(sample.where("y = 0"), frozenset(likely)).collect()}
    score = {f: math.log((n + 0.5) / (pos + 1)) - math.log((clean.get(f, 0) + 0.5) / (neg + 1)) for f, n in likely.items()}
    entries: list[tuple[str, bool, int]] = []
    marks = [f for f, x in score.items() if x >= math.log(ratio if f.endswith("$") else stem_ratio)]
    varied = {r["feature"]: r["n"] for r in _contexts(sample.where("y = 1"), frozenset(marks)).collect()}
    marks = [f for f in marks if varied.get(f, 0) >= least]
    for f in sorted(marks, key=lambda f: (-likely[f] * score[f], len(f), f)):
        text, is_stem = f.removesuffix("$"), not f.endswith("$")
        # a stem that one word makes up is that word
        if is_stem and any(likely[w] >= 0.9 * likely[f] for w in likely if w.endswith("$") and w.startswith(text)):
            continue
        nested = any((s and text.startswith(t)) or (is_stem and t.startswith(text)) for t, s, _ in entries)
        if not nested:
            entries.append((text, is_stem, 0 if is_stem else edits_allowed(len(text))))
    # exact words under a stem are hits of the stem
    of = list(range(len(entries)))
    stems = {t: i for i, (t, s, _) in enumerate(entries) if s}
    begins = [F.substring("feature", 1, n).isin([t for t in stems if len(t) == n]) for n in {len(t) for t in stems}]
    for r in marked.where(F.col("feature").endswith("$") & reduce(or_, begins)).orderBy("feature").collect() if stems else []:
        text = r["feature"].removesuffix("$")
        if edits_allowed(len(text)):
            entries.append((text, False, edits_allowed(len(text))))
            of.append(next(stems[text[:n]] for n in STEMS if text[:n] in stems))
    model = Model(entries, [(1.0, 1.0)] * len(entries))
    rows = _hits_of(sample, model)
    seen: dict[tuple[int, bool], list[set[int]]] = {}
    for d, (y, found) in enumerate(rows):
        for entry, edits, quoted, _ in found:  # each kind of hit once
            if not quoted:  # what a quotation is worth is for the regression to tell
                seen.setdefault((entry, edits > 0), [set(), set()])[y].add(d)
    odds = lambda key: math.log((len(seen[key][1]) + 0.5) / (pos + 1)) - math.log((len(seen[key][0]) + 0.5) / (neg + 1)) if key in seen else None
    weights = []
    for i, (text, is_stem, k) in enumerate(entries):
        exact, near = odds((of[i], False)), odds((i, True))
        # misspellings count less than the word, and not at all where they meet clean rows as often
        weights.append((max(0.0, exact or 0.0), max(0.0, min(near if near is not None else 0.5 * (exact or 0), exact or 0))))
    kept = [(t, s, k if weights[i][1] > 1 else 0) for i, (t, s, k) in enumerate(entries)]
    model = Model(kept, weights)
    x = sums(model, {(d, *h): n for d, (_, found) in enumerate(rows) for h, n in found.items() if not (h[1] > 0 and kept[h[0]][2] == 0)}, len(rows))
    model.coefficients = _logistic(x, np.array([y for y, _ in rows], float), np.array([-4.0, 2.0, 0.5, 0.5])).tolist()
    return model


def _hits_of(sample: DataFrame, model: Model) -> list[tuple[int, dict[tuple[int, int, bool, bool], int]]]:
    """Label of each sampled row, and the number of its hits of each kind; the sample and the kinds are bounded, and so is what the driver gets."""
    kinds = pa.list_(pa.struct([("entry", pa.int32()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("addressed", pa.bool_()), ("n", pa.int64())]))

    def run(batches):
        automaton = Automaton(model.entries)
        for batch in kernels.slices(batches, "text"):
            _, found = hits(batch, automaton)
            per = [[] for _ in range(batch.num_rows)]
            for (d, *h), n in Counter(found).items():
                per[d].append({"entry": h[0], "edits": h[1], "quoted": h[2], "addressed": h[3], "n": n})
            y = batch.column(batch.schema.get_field_index("y")).to_pylist()
            yield pa.RecordBatch.from_pylist([{"y": a, "hits": b} for a, b in zip(y, per)], pa.schema([("y", pa.int32()), ("hits", kinds)]))

    got = sample.mapInArrow(run, "y int, hits array<struct<entry:int,edits:int,quoted:boolean,addressed:boolean,n:long>>").collect()
    return [(r["y"], {tuple(h)[:4]: h["n"] for h in r["hits"]}) for r in got]


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.1) -> np.ndarray:
    """Newton's method on the logistic loss, with a Gaussian prior around ``prior`` (looser for the constant)."""
    b, keep = prior.copy(), np.array([0.01, *[strength] * (len(prior) - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + keep * (b - prior)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs without clashing columns, plus ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    Null and empty texts have no hits; words and texts may have any length; repeated rows are scored alike. Columns named score or
    predicted, in any case, are replaced, unless they are the text. An empty table gives no rows.
    """
    rows = docs.select(*[f"`{c}`" for c in others(docs, ("score", "predicted"), text_col)])
    fields = [f for f in rows.schema.fields if keep_text or f.name != text_col]
    b = np.array(model.coefficients)

    def run(batches):
        automaton = Automaton(model.entries)
        for batch in kernels.slices(batches, text_col):
            _, found = hits(batch, automaton, text_col)
            p = 1 / (1 + np.exp(-np.clip(sums(model, Counter(found), batch.num_rows) @ b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in fields), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*[f.name for f in fields], "score", "predicted"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double, predicted int"])
    return rows.mapInArrow(run, ddl)
