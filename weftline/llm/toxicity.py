"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Learning happens on a bounded sample of labelled rows: one part of it gives the
lexicon, another the trees, a third the calibration. Scoring is one pass over
the texts in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.runtime import held_out, small_batches

#: Labelled rows that the model is fitted on at most; taken in the order of a hash.
SAMPLE_ROWS = 16_000

#: Scores from here on are rejected.
THRESHOLD = 0.7

#: Insults that are known before any label is seen (fixed values).
SEED_WORDS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash garbage scum clown clowns pathetic worthless disgusting filthy vermin pig pigs fool fools jerk jerks bastard bitch "
    "crap damn hell hate kill die shut ugly retard imbecile dummkopf trottel abschaum arschloch connard salaud imbécile ordure idiota imbécil estúpido basura escoria".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú usted ustedes vosotros tus".split())

#: Characters that stand for letters in disguised words (fixed values).
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})

#: A prefix or word enters the lexicon from so many toxic texts on, and with so large a share of toxic among its texts.
LEAST_TEXTS, LEAST_SHARE, LEXICON_SIZE = 4, 0.6, 4000
PREFIXES = (4, 5, 6, 7)

_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")
_PLAIN = re.compile(r"^[^\W\d_]+$")

FEATURES = ("seed", "learned", "learned_share", "strongest", "strong_kinds", "seed_any", "near_second", "second", "hidden", "hidden_share", "capitals", "all_caps", "exclaim", "question", "symbols", "digits", "repeats", "log_words", "mean_word")


def _clean(word: str) -> str:
    return word.lower() if word.isalpha() else _EDGE.sub("", word.lower())


def _revealed(word: str) -> str:
    """A disguised word's letters: substitutes replaced, separators dropped; '' if it hides nothing."""
    if word.isalpha():
        return ""
    core = _EDGE.sub("", word.lower()) or word.lower()
    if not core or _PLAIN.match(core):
        return ""
    shown = _INNER.sub("", core.translate(LEET))
    return shown if len(shown) >= 3 and shown.isalpha() else ""


def keys_of(word: str) -> list[str]:
    """What the lexicon is asked for: the word, and its beginnings (marked by a star)."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


@dataclass
class Features:
    """Dense features of a text under a lexicon of word or beginning -> weight.

    What a word contributes is worked out once and kept as a row of a table; the
    table is emptied when it is full, so memory stays bounded.
    """

    lexicon: dict[str, float]
    limit: int = 200_000

    def __post_init__(self):
        self.index: dict[str, int] = {}
        self.table_of_words = np.zeros((self.limit, 14))

    def _weight(self, word: str) -> float:
        return max((self.lexicon.get(k, 0.0) for k in keys_of(word)), default=0.0)

    def _word(self, raw: str) -> tuple[float, ...]:
        word = _clean(raw)
        weight = self._weight(word) if word else 0.0
        shown = "" if raw.isalpha() else _revealed(raw)
        hidden = bool(shown) and (shown in SEED_WORDS or self._weight(shown) >= 1)
        letters = len(raw) if raw.isalpha() else sum(c.isalpha() for c in raw)
        upper = 0 if raw.islower() else sum(c.isupper() for c in raw)
        seed = word in SEED_WORDS
        loud = raw.isalpha()
        marks = (0, 0, 0, 0) if loud else (raw.count("!"), raw.count("?"), sum(c in "#*$%&|<>@^~" for c in raw), sum(c.isdigit() for c in raw))
        return (seed, weight, word in SECOND_PERSON, hidden, letters, upper, letters > 2 and upper == letters, *marks, len(raw), max(weight, 2.0 * seed), weight >= 1 or seed)

    def _ids(self, distinct: list[str]) -> list[int]:
        index = self.index
        if len(index) + len(distinct) > self.limit:
            index.clear()
            if len(distinct) > self.limit:  # a text of more distinct words than the table holds
                self.limit = 2 * len(distinct)
                self.table_of_words = np.zeros((self.limit, 14))
        for w in distinct:
            if w not in index:
                self.table_of_words[len(index)] = self._word(w)
                index[w] = len(index)
        return [index[w] for w in distinct]

    def row(self, text: str | None) -> list[float]:
        order = _SPLIT.findall(text or "")
        counts = Counter(order)
        n = max(1, len(order))
        if not counts:
            return [0.0] * len(FEATURES)
        of = self.table_of_words
        distinct = list(counts)
        ids = np.array(self._ids(distinct))
        of = self.table_of_words[ids]
        times = np.fromiter(counts.values(), dtype=float, count=len(counts))
        tot = times @ of
        bad = (of[:, 1] > 0) | (of[:, 0] > 0) | (of[:, 3] > 0)
        near = 0
        if bad.any() and tot[2]:
            worst = {w for w, x in zip(distinct, bad, strict=True) if x}
            you = {w for w, x in zip(distinct, of[:, 2], strict=True) if x}
            at = np.array([i for i, w in enumerate(order) if w in worst])
            to = np.array([i for i, w in enumerate(order) if w in you])
            j = np.searchsorted(to, at)
            y = np.concatenate([[-(10**9)], to, [10**9]])
            near = int(((at - y[j] <= 5) | (y[j + 1] - at <= 5)).sum())
        letters = max(1.0, tot[4])
        repeated = len(order) - len(counts)
        return [100 * tot[0] / n, 100 * tot[1] / n, tot[1], float(of[:, 12].max()), float(of[:, 13].sum()), tot[0], 100 * near / n, 100 * tot[2] / n, tot[3], 100 * tot[3] / n, tot[5] / letters, tot[6] / n, tot[7] / n, tot[8] / n, tot[9] / n, tot[10] / n, repeated / n, float(np.log1p(len(order))), tot[11] / n]

    def table(self, texts) -> np.ndarray:
        return np.array([self.row(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """Boosted regression trees of depth 3 for the logistic loss on quantile bins."""

    rounds: int = 60
    rate: float = 0.15
    depth: int = 3
    bins: int = 32
    least_hessian: float = 1.0
    ridge: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        # values that are rare, as most insults are, still get edges of their own
        self.edges = [np.unique(np.r_[e, np.quantile(c[c > 0], np.linspace(0, 1, 9)[:-1]) - 1e-9]) if len(x) and (c > 0).any() else e for e, c in zip(self.edges, x.T, strict=True)]
        mean = float(y.mean()) if len(y) else 0.0
        mean = min(max(mean, 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(mean / (1 - mean))), []
        b = self._binned(x)
        score = np.full(len(x), self.base)
        for _ in range(self.rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-score))
            tree, out = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            score += out
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]) if x.size else np.zeros(x.shape, int)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """One tree as lists of split (feature, bin) by heap position, and leaf values by position."""
        at = np.zeros(len(b), dtype=int)
        splits: dict[int, tuple[int, int]] = {}
        for node in range(2**self.depth - 1):
            rows = np.flatnonzero(at == node)
            if len(rows) < 2:
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            for f in range(b.shape[1]):
                m = len(self.edges[f]) + 1
                if m < 2:
                    continue
                cg = np.cumsum(np.bincount(b[rows, f], g[rows], m))[:-1]
                ch = np.cumsum(np.bincount(b[rows, f], h[rows], m))[:-1]
                gain = cg**2 / (ch + self.ridge) + (gs - cg) ** 2 / (hs - ch + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(ch < self.least_hessian) | (hs - ch < self.least_hessian)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k))
            if best[1] is not None:
                splits[node] = best[1]
                at[rows] = 2 * node + 1 + (b[rows, best[1][0]] > best[1][1])
        leaves = {int(n): float(-self.rate * g[at == n].sum() / (h[at == n].sum() + self.ridge)) for n in np.unique(at)}
        return (splits, leaves), np.array([leaves[n] for n in at])

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.base)
        for splits, leaves in self.trees:
            at = np.zeros(len(x), dtype=int)
            for node in sorted(splits):
                f, k = splits[node]
                rows = at == node
                at[rows] = 2 * node + 1 + (b[rows, f] > k)
            out += np.array([leaves.get(n, 0.0) for n in at]) if len(at) else 0
        return out


@dataclass
class Isotonic:
    """A rising step function by pooling adjacent violators; values between the steps are interpolated."""

    x: np.ndarray | None = None
    y: np.ndarray | None = None

    def fit(self, score: np.ndarray, label: np.ndarray) -> Isotonic:
        blocks: list[list[float]] = []
        for s, t in sorted(zip(score.tolist(), label.tolist(), strict=True)):
            if blocks and blocks[-1][3] == s:
                blocks[-1][0] += t
                blocks[-1][1] += 1
            else:
                blocks.append([t, 1.0, s, s])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                t2, n2, _, hi = blocks.pop()
                blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], hi]
        self.x = np.array([v for bl in blocks for v in (bl[2], bl[3])])
        self.y = np.array([v for bl in blocks for v in [(bl[0] + 0.05) / (bl[1] + 0.2)] * 2])
        self.y = np.maximum.accumulate(self.y) if len(self.y) else self.y
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return 1 / (1 + np.exp(-score))
        # the trees' own order is kept inside flat steps by a share too small to move a decision
        return np.clip(np.interp(score, self.x, self.y) * 0.999 + 0.001 / (1 + np.exp(-score)), 0, 1)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    calibration: Isotonic


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Texts of at most ``rows`` labelled documents that are not held out, chosen by a hash of the id; only their ids are broadcast."""
    may = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = may.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(rows).toPandas()  # bounded by rows
    spark = docs.sparkSession
    small = spark.createDataFrame(ids, "doc_id bigint, toxic int")
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text").join(F.broadcast(small), "doc_id")


def _part(doc_id) -> object:
    """0 and 1 of four parts give the lexicon, the others trees and calibration."""
    return F.pmod(F.xxhash64(F.lit(11), doc_id), F.lit(4))


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and beginnings that mark toxic texts: log odds, from counts of texts made in the tasks and summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, bad = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                keys = {k for w in {_clean(r) for r in _SPLIT.findall(text or "")} if w for k in keys_of(w)}
                n.update(keys)
                if toxic:
                    bad.update(keys)
            if len(n) > 400_000:
                yield pd.DataFrame([(k, c, bad[k]) for k, c in n.items()], columns=["k", "n", "bad"])
                n, bad = Counter(), Counter()
        yield pd.DataFrame([(k, c, bad[k]) for k, c in n.items()], columns=["k", "n", "bad"])

    counted = sample.select("text", "toxic").mapInPandas(count, "k string, n bigint, bad bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    strong = counted.where((F.col("bad") >= LEAST_TEXTS) & (F.col("bad") >= LEAST_SHARE * F.col("n"))).orderBy(F.col("bad").desc(), "k").limit(LEXICON_SIZE).toPandas()
    share = (strong["bad"] + 0.1) / (strong["n"] + 1.0)
    weight = np.clip(np.log(share / (1 - share)) + 1, 0.1, 4) * np.minimum(1, strong["bad"] / 8)
    return dict(zip(strong["k"], weight.astype(float), strict=True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labels.toxic of at most ``rows`` documents; with no labelled row all scores are equal and low.

    A doc_id with several labels is toxic if any of them says so; labels without
    an id or a value teach nothing, and neither do null or empty texts. Only
    doc_id, text and toxic are read, so other columns may have any name.
    """
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, rows).withColumn("part", _part(F.col("doc_id")))
    lexicon = _lexicon(sample.where("part < 2"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features(lexicon)
        for batch in batches:
            x = make.table(batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "part": batch["part"], "x": list(x)})

    rows_ = sample.where("part >= 2").select("doc_id", "text", "toxic", "part").mapInPandas(extract, "doc_id bigint, toxic int, part bigint, x array<double>")
    got = rows_.toPandas().sort_values("doc_id")  # at most the sample's rows, numbers only
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y, side = got["toxic"].to_numpy(float), (got["part"] == 2).to_numpy()
    out, lab = [], []
    for a in (side, ~side):  # each half is scored by trees that haven't seen it
        out.append(Trees().fit(x[a], y[a]).raw(x[~a]))
        lab.append(y[~a])
    calibration = Isotonic().fit(np.concatenate(out), np.concatenate(lab))
    return Model(lexicon, Trees().fit(x, y), calibration)


def score(text: Column, model: Model) -> Column:
    """struct(score, predicted) of a text; a null text scores as an empty one, equal texts equally, very long ones whole. Only the text goes to Python, in Arrow batches."""

    @F.pandas_udf("score double, predicted int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        make = Features(model.lexicon)
        for texts in batches:
            s = model.calibration(model.trees.raw(make.table(texts)))
            yield pd.DataFrame({"score": s, "predicted": (s >= THRESHOLD).astype("int32")})

    return run(text)
