"""Rule bitmask ledger: every rule once per document, policies and ablations on its bits.

The ledger keeps the measurements and one failure bit per rule. A policy is a
versioned mask of rules that matter; judging documents by another policy, or
asking what a rule alone removes, reads bits and never a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.runtime import SPACE_CHARS, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails when the expression over the measurements is true."""

    bit: int
    name: str
    fails: str


#: Bits never change their meaning; a new rule takes the next one.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "n_words >= 10 AND word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "few_letters", "2 * n_letters < word_chars"),
    Rule(7, "shouting", "n_letters >= 50 AND 10 * n_upper > 6 * n_letters"),
)

#: Versioned policies: the mask of rules by which a document is dropped.
POLICIES = {"v1": 0b00000011, "v2": 0b11111111}

#: What op2 keeps by.
POLICY = "v2"


def repeated_words(w: Column) -> Column:
    """How many words lie in a window of five that occurs twice or more in the text, first occurrences included.

    Windows are hashed in place. Without a repeated hash the answer is 0; else
    sorting (hash, start) brings equal windows together, and the union of the
    covered positions is summed from the gaps between their starts.
    """
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(p: Column) -> Column:
            same = F.filter(p, lambda x, j: (F.get(p, j - 1).h == x.h) | (F.get(p, j + 1).h == x.h))
            return F.array_sort(F.transform(same, lambda x: x.i))

        def union(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0), lambda n, g: n + g)

        return _let(pairs, lambda p: _let(again(p), union))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def _let(value: Column, body) -> Column:
    """Evaluate value once per row and use it in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs with its measurements; a null text counts as empty, all of whose measurements are 0.

    Rows that repeat a key or a text are measured each by itself, and very long
    texts whole. Only the key and the text are read: other columns may have any
    name. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(key).alias("doc_id"), body.alias("body"), words(F.col(text)).alias("w"), F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0).alias("lines"))
    squeezed = F.translate("body", SPACE_CHARS, "")
    return split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(squeezed, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(squeezed, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds failures (a bit per failed rule) to the measurements."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.coalesce(F.expr(r.fails), F.lit(False)), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failures", bits)


def judge(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """Adds kept: no rule of the policy's mask has failed."""
    return book.withColumn("kept", F.col("failures").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(book: DataFrame, policy: str = POLICY, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of the policy: documents that fail it, and those that only it removes. One aggregate over the bits."""
    mask = POLICIES[policy]
    used = [r for r in rules if mask >> r.bit & 1]
    failed = F.col("failures").bitwiseAND(F.lit(mask))
    sums = [F.count_if(failed.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}") for r in used] + [F.count_if(failed == 1 << r.bit).alias(f"o{r.bit}") for r in used]
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.bit).alias("bit"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only")) for r in used])
    return book.agg(*sums).select(F.inline(rows))
