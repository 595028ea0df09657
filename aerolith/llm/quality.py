"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations are bit arithmetic.

`ledger` measures each text and stores one bit per failed rule. `apply_policy` keeps the rows whose bits do not meet
the mask of a named, versioned policy, so a new policy needs no new pass over the texts. `ablation` counts, from the
bits alone, what each rule rejects, what it alone rejects, and what would be kept without it.

Only column expressions are used. One row holds one text; nothing is shuffled but the few rows of an ablation.

Defined results: a null text has no words (all measurements 0, the too-short bit set); a null id stays null; repeated
rows are measured each; an empty table gives an empty ledger; other columns of the input are kept as they are unless
they bear a name of the ledger, which the ledger replaces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.base import let

SPACE = r"[\x20\x09-\x0D]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: Callable[[], Column]


def _share(part: str, whole: str, percent: int) -> Column:
    return F.col(part) * 100 > F.col(whole) * percent


RULES = [
    Rule("few_words", 0, lambda: F.col("n_words") < 50),
    Rule("repeated_words", 1, lambda: _share("n_repeat_words", "n_words", 50)),
    Rule("symbols", 2, lambda: _share("n_symbols", "word_chars", 20)),
    Rule("duplicate_lines", 3, lambda: _share("n_dup_lines", "n_lines", 50)),
    Rule("long_words", 4, lambda: F.col("word_chars") > F.col("n_words") * 30),
    Rule("short_words", 5, lambda: F.col("word_chars") < F.col("n_words") * 2),
]

# Versions are never changed, only added.
POLICIES = {
    "base/1": ["few_words", "repeated_words"],
    "web/1": ["few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words"],
}


def mask_of(names: list[str]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add the number of words inside 3-word windows that occur twice or more in the text.

    Windows are hashed and sorted as pairs of whole hash and position; equal neighbours are repeats.
    """
    rows, n = "__sorted", F.size(words)
    pair = lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    df = df.withColumn(rows, F.sort_array(F.slice(F.transform(F.col(words), pair), F.lit(1), F.greatest(n - 2, F.lit(0)))))
    same = lambda x, k: F.coalesce(x["h"] == F.get(rows, k)["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter(rows, lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["i"]))
    gaps = let(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))))
    return df.withColumn(out, F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("bigint")).drop(rows)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their measurements and `fail_bits`, one bit for each failed rule."""
    words, lines, body = "__words", "__lines", F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    out = df.withColumns({
        words: F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+")),
        lines: F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != ""),
    })
    out = out.withColumns({
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
    })
    out = with_repeated_words(out, words, "n_repeat_words")
    # a generator between measuring and judging: filters on the ledger cannot be moved below it, which would copy the
    # measuring into every condition
    measured = F.inline(F.array(F.struct(*MEASURES)))
    out = out.select(*[c for c in df.columns if c not in [*MEASURES, "fail_bits"]], measured)
    bits = [F.when(F.coalesce(r.fails(), F.lit(False)), F.lit(1 << r.bit)).otherwise(0) for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("fail_bits", total.cast("bigint"))


def failed(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) != 0


def apply_policy(rows: DataFrame, policy: str = "web/1") -> DataFrame:
    """A ledger with `kept`: no failed rule is in the policy."""
    return rows.withColumn("kept", ~failed(policy))


def ablation(rows: DataFrame, policy: str = "web/1") -> DataFrame:
    """One row per rule of the policy: rows it fails, rows only it fails, rows kept without it, rows kept with all.

    The ledger is first summed by its bits, at most 2 ^ rules rows, on the map side.
    """
    full = mask_of(POLICIES[policy])
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(full)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in RULES if r.name in POLICIES[policy]])
    each = masks.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("bigint")
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_fails"),
        count(F.col("bits") == F.col("bit")).alias("n_only"),
        count(F.col("bits").bitwiseAND(F.lit(full).bitwiseXOR(F.col("bit"))) == 0).alias("n_kept_without"),
        count(F.col("bits") == 0).alias("n_kept"),
    )
