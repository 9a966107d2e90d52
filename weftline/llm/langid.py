"""Language identification by rank-order profiles and out-of-place distance.

A profile is a language's most frequent n-grams in order. A document's own most
frequent n-grams are compared to it: each counts by how many places it is away
from where the profile has it, and PROFILE where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.runtime import held_out, kept, small_batches
from weftline.llm.textvec import mix64

#: n-grams of a profile, and of a document that are compared.
PROFILE, COMPARED = 400, 300

#: Longest n-gram; words are padded with a blank on both sides.
LONGEST = 3

#: Documents of a language that its profile is learned from, about; chosen by a hash of the id.
PER_LANGUAGE = 2000

UNKNOWN = "und"

#: Bits of a character in an n-gram's number; a shorter n-gram has zeros behind.
_BITS = 21
_BLANK = 32


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def number(gram: str) -> int:
    """An n-gram of up to LONGEST characters as a number."""
    out = 0
    for c in gram.ljust(LONGEST, "\0"):
        out = out << _BITS | ord(c)
    return out


def count(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of a text's n-grams within words, which have a blank on both sides; none for a text without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank behind each word
    line = np.full(int(keep.sum()) + 2, _BLANK, dtype=np.int64)
    line[1:-1] = np.where(letter, codes, _BLANK)[keep]
    blank = line == _BLANK
    one = line[~blank] << 2 * _BITS
    two = (line[:-1] << 2 * _BITS | line[1:] << _BITS)[~(blank[:-1] & blank[1:])]
    three = (line[:-2] << 2 * _BITS | line[1:-1] << _BITS | line[2:])[~blank[1:-1]]
    found = np.sort(np.concatenate([one, two, three]))
    at = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    return found[at], np.diff(np.r_[at, len(found)])


class Profiles:
    """Out-of-place distances of texts to every language's profile."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.places = np.full((len(self.languages), len(self.known) + 1), PROFILE, dtype=np.int32)
        for row, name in enumerate(self.languages):
            grams = np.array(profiles[name], dtype=np.int64)
            self.places[row, np.searchsorted(self.known, grams)] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the nearest profile, and the runner-up's share of both distances; und and 0 without a letter."""
        grams, counts = count(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        # most frequent first; equals in an order of their own that doesn't follow the alphabet
        order = -((counts << 32) + (mix64(grams.view(np.uint64)) >> np.uint64(32)).astype(np.int64))
        if len(grams) > COMPARED:
            few = np.argpartition(order, COMPARED)[:COMPARED]
            grams, order = grams[few], order[few]
        grams = grams[np.argsort(order)]
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        at[self.known[at] != grams] = len(self.known)
        places = self.places[:, at]
        away = np.where(places == PROFILE, PROFILE, np.abs(np.arange(len(grams)) - places))
        distance = away.sum(axis=1)
        order = np.argsort(distance, kind="stable")
        first = float(distance[order[0]])
        second = float(distance[order[1]]) if len(order) > 1 else float(PROFILE * len(grams))
        return self.languages[order[0]], second / (first + second) if second else 0.5


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, list[int]]:
    """Each language's profile, from text and lang of documents that are not held out; a null lang or text teaches nothing."""
    small_batches(docs.sparkSession)
    may = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in may.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, per_language / n))])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id"), 11).cast("double") / float(1 << 53)
    sample = may.where(F.col("text").isNotNull() & (draw < share[F.col("lang")])).select("lang", "text")

    def count_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                total.setdefault(lang, []).append(count(text))
            for lang, found in total.items():
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                total[lang] = [(grams, np.bincount(at, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64))]
        for lang, [(grams, n)] in total.items():
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    counted = kept(sample.mapInPandas(count_all, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    tops = [counted.where(F.col("lang") == name).orderBy(F.col("n").desc(), "gram").limit(PROFILE) for name in sorted(sizes)]
    rows = reduce(DataFrame.unionByName, tops).toPandas()  # PROFILE rows per language
    return {name: part.sort_values(["n", "gram"], ascending=[False, True])["gram"].tolist() for name, part in rows.groupby("lang")}


def predict(text: Column, profiles: dict[str, list[int]]) -> Column:
    """struct(lang, score) of a text. Only the text goes to Python, in Arrow batches."""

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Profiles(profiles)
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    return run(text)
