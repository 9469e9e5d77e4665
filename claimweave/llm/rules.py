"""Quality rules as a ledger: measure once, keep failure bits, apply policies later."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import WORD, documents, map_texts

SYMBOLS = "#*$%&|<>"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_alpha_words", "n_upper_words",
)
_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the measures; ``bit`` never changes its meaning."""

    bit: int
    name: str
    fails: Callable[[], Column] = field(compare=False)


RULES = (
    Rule(0, "too_few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeated_windows", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule(2, "short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule(3, "long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
    Rule(4, "symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule(5, "duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    Rule(6, "few_alphabetic_words", lambda: 10 * F.col("n_alpha_words") < 6 * F.col("n_words")),
    Rule(7, "shouting", lambda: 2 * F.col("n_upper_words") > F.col("n_words")),
)
BASE = ("too_few_words", "repeated_windows")
#: Versioned policies: the rules that reject. Published versions never change.
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "few_alphabetic_words", "shouting"),
    3: tuple(r.name for r in RULES),
}


def mask(names, rules=RULES) -> int:
    known = {r.name: r.bit for r in rules}
    return sum(1 << known[n] for n in set(names))


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text; null counts as a text without words."""
    text = text or ""
    words = re.findall(WORD, text)
    seen: dict = {}
    hit = bytearray(len(words))
    # Windows of three words found twice or more: each covers its three words.
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        first = seen.setdefault(window, i)
        if first != i:
            hit[i:i + 3] = hit[first:first + 3] = b"\1\1\1"
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), sum(hit),
        len(lines), sum(any(map(str.isalpha, w)) for w in words), sum(map(str.isupper, words)),
    )


def ledger(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its measures and ``bits``, where bit ``r.bit`` is set if rule ``r`` fails.

    One narrow pass over the whole texts, no shuffle. Null and empty texts have no
    words; texts without words fail ``too_few_words``. Rows repeat as they come.
    """
    def make():
        def fn(columns):
            rows = [measure(t) for t in columns["text"]]
            return {"doc_id": columns["doc_id"], **{m: [r[i] for r in rows] for i, m in enumerate(MEASURES)}}
        return fn

    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(0).cast("long"))
    return map_texts(documents(docs, id_col, text_col), make, _SCHEMA).withColumn("bits", bits)


def apply_policy(rows: DataFrame, version: int, policies=POLICIES, rules=RULES) -> DataFrame:
    """Adds ``policy``, ``blocking`` (failed bits that the policy enforces) and ``kept``."""
    enforced = F.lit(mask(policies[version], rules)).cast("long")
    return rows.withColumn("policy", F.lit(version)).withColumn("blocking", F.col("bits").bitwiseAND(enforced)).withColumn("kept", F.col("blocking") == 0)


def ablations(rows: DataFrame, version: int, policies=POLICIES, rules=RULES) -> DataFrame:
    """What each enforced rule does to a policy: ``rule, failed, only, kept_without``.

    ``failed`` documents fail the rule, ``only`` fail no other enforced rule, and
    ``kept_without`` would be kept if the rule were dropped. The ledger is first
    counted by blocking bits: at most two to the number of rules rows are left.
    """
    counts = apply_policy(rows, version, policies, rules).groupBy("blocking").agg(F.count("*").alias("n"))
    known = {r.name: r.bit for r in rules}
    out = []
    for name in policies[version]:
        bit = F.lit(1 << known[name]).cast("long")
        failed = F.col("blocking").bitwiseAND(bit) != 0
        out += [
            F.sum(F.when(failed, F.col("n")).otherwise(0)).alias(f"failed_{name}"),
            F.sum(F.when(F.col("blocking") == bit, F.col("n")).otherwise(0)).alias(f"only_{name}"),
        ]
    kept = F.sum(F.when(F.col("blocking") == 0, F.col("n")).otherwise(0)).alias("kept")
    wide = counts.agg(kept, *out)
    stack = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.coalesce(f"failed_{n}", F.lit(0)).alias("failed"), F.coalesce(f"only_{n}", F.lit(0)).alias("only"),
                 (F.coalesce("kept", F.lit(0)) + F.coalesce(f"only_{n}", F.lit(0))).alias("kept_without"))
        for n in policies[version]
    ])
    return wide.select(F.inline(stack))
