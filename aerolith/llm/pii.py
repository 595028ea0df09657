"""Personal data: rule spans plus spans that boosted trees choose among many proposed ones.

1. Base spans follow fixed forms (address, dotted number, card with check digit, international phone). They always stay.
2. Generators of high recall propose overlapping candidates: anything around an at sign, any run of digits with
   separators, any long run of letters and digits. Each gets small whole-number features of format and context. Its label
   for training is whether it meets a base span or bears evidence of its own (`evident`): a word such as `tel` or
   `passport` right before it, the check digit of a card in groups, or, for a key, letters and digits in frequent change
   inside quotes or behind a sign of assignment. So forms that the base rules do not know count as personal data where
   texts show them as such.
3. The features are levels, so the training set is the table of counts per (features, label, half): Spark sums it over
   all documents and at most LEVELS rows, the product of the levels, can ever reach the driver. True candidates count
   once more with what decided their label masked (`masked`: the plus sign, the word before, what surrounds a key), so the
   same form without it can be told from others by the rest. Trees of depth two are boosted on these counts (logistic loss), and the
   threshold is calibrated on the other half of the texts: the lowest score above which the share of true ones is PRECISION.
4. The trees become one column expression; candidates at or above the threshold that touch no base span are added.

Only column expressions run on the executors. One row holds one text; the only shuffle is that of the counts.

Forms that would make Java's regular expressions recurse (repeated groups) are turned into plain classes first: an inner
separator is replaced by a character that the text cannot hold, which keeps all positions.

Defined results: a null or empty text has no spans; a null id stays null; repeated rows get equal spans; with no
candidates at all (also an empty table) nothing is added; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.base import let, row_key
from aerolith.session import cut_lineage

KINDS = ["email", "ip", "card", "phone", "number", "key"]  # the last two are only added by the trees
ROUNDS, RATE, PRECISION = 20, 0.5, 0.99

_SPAN = "array<struct<start: int, end: int, text: string, before: string, after: string>>"
_INNER = "\ufffe"  # a noncharacter; where a text holds it, it becomes a line end, which no pattern takes, first
_LABEL = "A-Za-z0-9-"
_LOCAL = f"A-Za-z0-9._%+{_INNER}-"


def spans(text: Column, pattern: str, context: int = 24) -> Column:
    """Every match in order, with its place in code points and the text beside it.

    A pattern cuts the text into pieces; lengths of pieces and matches in turn give the places.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)

    def located(p: Column, m: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(F.get(p, acc["n"]))
            end = start + F.length(x)
            one = F.struct(start.alias("start"), end.alias("end"), x.alias("text"), F.right(F.get(p, acc["n"]), F.lit(context)).alias("before"), F.left(F.get(p, acc["n"] + 1), F.lit(1)).alias("after"))
            return F.struct(end.alias("at"), (acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(one)).cast(_SPAN).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(m, zero, step, lambda acc: acc["out"])

    return let(found, lambda m: let(pieces, lambda p: located(p, m)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check digit of a card number holds."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.floor(d.try_cast("int") * 2 / 10).cast("int") + d.try_cast("int") * 2 % 10))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _when(cond: Column, found: Column) -> Column:
    return F.when(cond, found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> list[Column]:
    """For each of the four base kinds, its spans: leftmost, not overlapping, failing matches dropped."""
    clean = F.translate(text, _INNER, "\n")
    dotted = F.regexp_replace(clean, rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])", _INNER)
    # a match can only begin where a run of its class begins or the last match ended
    email = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++{_INNER}[{_LABEL}{_INNER}]++"
    ip = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    joined = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", _INNER)
    card = rf"(?:\G|(?<![0-9{_INNER}]))[0-9][0-9{_INNER}]++"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"

    def size(x: Column, low: int, high: int) -> Column:
        return F.length(_digits(x)).between(low, high)

    return [
        _when(F.contains(text, F.lit("@")), let(dotted, lambda t: spans(t, email))),
        _when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), F.filter(spans(text, ip), lambda s: s["text"].rlike(rf"^{part}(?:\.{part}){{3}}$"))),
        _when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.filter(let(joined, lambda t: spans(t, card)), lambda s: size(s["text"], 12, 19) & luhn(_digits(s["text"])))),
        _when(text.rlike(r"\+[0-9]"), F.filter(spans(text, phone), lambda s: size(s["text"], 9, 15))),
    ]


def _level(x: Column, *bounds: int) -> Column:
    out = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(x < bounds[k], k).otherwise(out)
    return out


_CUES = "tel|phone|call|fon|mobil|mail|card|karte|carte|tarjeta|ip|addr|contact|kontakt"
# Whole words that name what follows, with at most a few signs or letters between.
_NAMED = r"(?<![\p{L}\p{N}])(?:tel|telephone|phone|cell|mobile?|fax|call|fon|telefon|handy|t[eé]l[eé]fono?|t[eé]l[eé]phone|m[oó]vil|whatsapp|ssn|nss|passport|passeport|pasaporte|reisepass|personalausweis|dni|nie)"
_NAMED_NUMBER = _NAMED + r"(?![\p{L}\p{N}])[^0-9\n]{0,12}$"
_NAMED_ADDRESS = r"(?<![\p{L}\p{N}])(?:e-?mail|mail|mailto|correo|courriel|contact|kontakt)(?![\p{L}\p{N}])[^0-9\n]{0,12}$"

def _named(c: Column) -> Column:
    """A word right before the candidate says that it is a number, or an address, of a person."""
    before = F.lower(c["before"])
    return F.when(_address(c), before.rlike(_NAMED_ADDRESS)).otherwise(before.rlike(_NAMED_NUMBER))


def _address(c: Column) -> Column:
    return F.contains(c["text"], F.lit("@"))


def _key(c: Column) -> Column:
    return ~_address(c) & c["text"].rlike("[A-Za-z]")


def _random(c: Column) -> Column:
    """Letters and digits that change often, as in keys and tokens, and hardly in words."""
    groups = F.size(F.split(c["text"], "[^0-9]+"))
    return (F.length(c["text"]) >= 20) & (F.length(_digits(c["text"])) >= 5) & (F.length(F.regexp_replace(c["text"], "[^A-Za-z]+", "")) >= 5) & (groups >= 6)


def _plain(c: Column) -> Column:
    """A date, alone or with more digits behind it, or a decimal fraction: never personal data by itself."""
    date = c["text"].rlike(r"^(?:[12][0-9]{3}[.-][01]?[0-9][.-][0-3]?[0-9]|[0-3]?[0-9][.-][0-3]?[0-9][.-][12][0-9]{3})(?![0-9])")
    return date | c["text"].rlike(r"^[0-9]+\.[0-9]+$")


def evident(c: Column) -> Column:
    """Evidence that does not rest on the base forms: a naming word and a plausible form, or a card's check digit."""
    digits = F.length(_digits(c["text"]))
    apart = ~c["before"].rlike(r"[\p{L}\p{N}_]$") & ~c["after"].rlike(r"^[\p{L}\p{N}_]")
    number = _named(c) & digits.between(7, 15) & ~_plain(c)
    card = digits.between(13, 19) & luhn(_digits(c["text"])) & c["text"].rlike(r"^[0-9]{4}[\x20.-][0-9]{4,6}[\x20.-][0-9]{4,5}(?:[\x20.-][0-9]{1,7})?$")
    address = _named(c) & c["text"].rlike(rf"^[{_LABEL}._%+]+@[{_LABEL}.]+$")
    given = c["before"].rlike("[=:\"'`]\\s*$") | c["after"].rlike("^[\"'`]")
    return F.when(_address(c), address).when(_key(c), given & _random(c)).otherwise(apart & (number | card))


# name -> (number of levels, level of a candidate)
FEATURES: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "shape": (3, lambda c: F.when(_address(c), 1).when(_key(c), 2).otherwise(0)),
    "digits": (7, lambda c: _level(F.length(_digits(c["text"])), 7, 9, 12, 13, 16, 17)),
    "groups": (5, lambda c: _level(F.size(F.split(c["text"], "[^0-9]+")), 2, 3, 4, 5)),
    "separator": (4, lambda c: F.when(c["text"].rlike(r"[()]"), 3).when(c["text"].rlike(r"[0-9]\.[0-9]"), 2).when(c["text"].rlike(r"[\x20-]"), 1).otherwise(0)),
    "plus": (2, lambda c: c["text"].startswith("+").cast("int")),
    "before": (4, lambda c: F.when(c["before"] == "", 0).when(c["before"].rlike(r"\s$"), 1).when(c["before"].rlike(r"[\p{L}\p{N}]$"), 2).otherwise(3)),
    "after": (4, lambda c: F.when(c["after"] == "", 0).when(c["after"].rlike(r"^\s"), 1).when(c["after"].rlike(r"^[\p{L}\p{N}]"), 2).otherwise(3)),
    "cue": (3, lambda c: F.when(_named(c), 2).otherwise(F.lower(c["before"]).rlike(_CUES).cast("int"))),
    "check": (2, lambda c: luhn(_digits(c["text"])).cast("int")),
}
LEVELS = 4 * math.prod(n for n, _ in FEATURES.values())


# A run of twenty letters, digits and joining signs with a letter and a digit among its first twenty.
_MIXED = r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z0-9_/+-]{0,19}[0-9])(?=[A-Za-z0-9_/+-]{0,19}[A-Za-z])[A-Za-z0-9_/+-]{20,}+"


def proposed(text: Column) -> Column:
    """Candidates of high recall; they may overlap each other and the base spans."""
    at = r"(?:\G|(?<![^\s@,;<>\"]))[^\s@,;<>\"]++@[^\s@,;<>\"]++"
    # a match takes the whole run, so the next one can only begin after it; what stands before a run does not matter
    run = r"[+(]?[0-9][0-9()\x20.-]{5,}+"
    return F.concat(
        _when(F.contains(text, F.lit("@")), spans(text, at)),
        _when(text.rlike(r"[0-9][\x20().-]?[0-9]"), F.filter(spans(text, run), lambda s: F.length(_digits(s["text"])) >= 7)),
        _when(text.rlike(_MIXED), spans(text, _MIXED)),
    )


def _trimmed(c: Column) -> Column:
    """A run without the separators at its end."""
    body = F.regexp_replace(c["text"], r"[^0-9\p{L}]+$", "")
    return F.struct(c["start"].alias("start"), (c["start"] + F.length(body)).alias("end"), body.alias("text"), c["before"].alias("before"), F.when(F.length(body) < F.length(c["text"]), F.substring(c["text"], F.length(body) + 1, F.lit(1))).otherwise(c["after"]).alias("after"))


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def found(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, key (of id and text), base (kind, start, end in order), cands (start, end, features, label, free: not
    covered, not plain)."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), row_key(doc_id, text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kinds = [F.transform(s, _of_kind(k)) for k, s in enumerate(base_spans(F.col("text")))]
    rows = rows.select("doc_id", "key", F.sort_array(F.concat(*kinds)).alias("base"), F.transform(proposed(F.col("text")), _trimmed).alias("raw"))

    def described(c: Column) -> Column:
        meets = F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), *[f(c).cast("int").alias(n) for n, (_, f) in FEATURES.items()], (meets | evident(c)).cast("int").alias("label"), (~meets & ~_plain(c)).alias("free"))

    return rows.select("doc_id", "key", "base", F.transform("raw", described).alias("cands"))


def counts(rows: DataFrame) -> list[tuple[tuple[int, ...], int, int, int]]:
    """(features, label, half, number) summed over all documents: at most LEVELS rows."""
    each = rows.where(F.size("cands") > 0).select((F.xxhash64("doc_id", F.size("cands")).bitwiseAND(F.lit(1))).cast("int").alias("half"), F.explode("cands").alias("c"))
    names = list(FEATURES)
    table = each.groupBy(*[F.col(f"c.{n}") for n in [*names, "label"]], "half").agg(F.count(F.lit(1)).alias("n"))
    return sorted((tuple(r[n] for n in names), r["label"], r["half"], r["n"]) for r in table.collect())


def masked(table: list[tuple[tuple[int, ...], int, int, int]]) -> list[tuple[tuple[int, ...], int, int, int]]:
    """The counts, and those of true candidates again without a plus sign and a word before where they have any."""
    place = {n: k for k, n in enumerate(FEATURES)}
    hidden = [place["plus"], place["cue"]]
    bare = [(tuple(0 if k in hidden else x for k, x in enumerate(features)), label, half, n) for features, label, half, n in table if label and any(features[k] for k in hidden)]
    # a key between blanks instead of quotes
    around = [place["before"], place["after"]]
    bare += [(tuple(1 if k in around else x for k, x in enumerate(features)), label, half, n) for features, label, half, n in table if label and features[place["shape"]] == 2]
    return [*table, *bare]


Tree = tuple[int, int, tuple[tuple[int, int, float, float], ...]]


def boost(table: list[tuple[tuple[int, ...], int, int, int]]) -> tuple[float, list[Tree]]:
    """Depth-two trees on weighted counts by second-order steps of the logistic loss: (start, trees).

    A tree is (feature, bound, two children), a child (feature, bound, value below, value from the bound on).
    """
    total, good = sum(t[3] for t in table), sum(t[3] for t in table if t[1])
    start = math.log((good + 1) / (total - good + 1))
    score = [start] * len(table)
    cuts = [(f, b) for f, (n, _) in enumerate(FEATURES.values()) for b in range(1, n)]
    trees: list[Tree] = []

    def best(rows: list[int], grad: list[float], hess: list[float]) -> tuple[float, int, int, float, float]:
        out = (-1.0, 0, 1, 0.0, 0.0)
        for f, b in cuts:
            g, h = [0.0, 0.0], [1.0, 1.0]
            for r in rows:
                side = table[r][0][f] >= b
                g[side] += grad[r]
                h[side] += hess[r]
            gain = g[0] ** 2 / h[0] + g[1] ** 2 / h[1]
            if gain > out[0] + 1e-12:
                out = (gain, f, b, g[0] / h[0] * RATE, g[1] / h[1] * RATE)
        return out

    for _ in range(ROUNDS if table else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [t[3] * (t[1] - q) for t, q in zip(table, p, strict=True)]
        hess = [t[3] * q * (1 - q) for t, q in zip(table, p, strict=True)]
        _, f, b, *_ = best(list(range(len(table))), grad, hess)
        sides = [[r for r in range(len(table)) if (table[r][0][f] >= b) == bool(k)] for k in (0, 1)]
        children = tuple(best(rows, grad, hess)[1:] for rows in sides)
        trees.append((f, b, children))
        score = [s + value(t[0], trees[-1:]) for s, t in zip(score, table, strict=True)]
    return start, trees


def value(features: tuple[int, ...], trees: list[Tree]) -> float:
    out = 0.0
    for f, b, children in trees:
        g, c, low, high = children[features[f] >= b]
        out += high if features[g] >= c else low
    return out


def calibrate(table: list[tuple[tuple[int, ...], int, int, int]], start: float, trees: list[Tree]) -> float | None:
    """Lowest score from which on the share of true candidates reaches PRECISION; None where there is none."""
    by: dict[float, list[int]] = {}
    for features, label, _, n in table:
        pair = by.setdefault(round(start + value(features, trees), 9), [0, 0])
        pair[label] += n
    bad = good = 0
    chosen = None
    for s in sorted(by, reverse=True):
        bad, good = bad + by[s][0], good + by[s][1]
        if good and good >= PRECISION * (good + bad):
            chosen = s
    return chosen


def _score(c: Column, start: float, trees: list[Tree]) -> Column:
    names, out = list(FEATURES), F.lit(start)
    for f, b, children in trees:
        low, high = (F.when(c[names[g]] >= k, F.lit(up)).otherwise(F.lit(down)) for g, k, down, up in children)
        out = out + F.when(c[names[f]] >= b, high).otherwise(low)
    return out


def personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and spans, both arrays of (start, kind, end) in order, key (of id and text); kind is a place in
    KINDS."""
    rows = cut_lineage(found(df, doc_id, text))
    table = masked(counts(rows))
    start, trees = boost([t for t in table if t[2] == 0])
    bound = calibrate([t for t in table if t[2] == 1], start, trees)
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    if bound is None or not trees:
        extra = none
    else:
        # a candidate that a base span meets is covered already, a date is none
        chosen = F.filter("cands", lambda c: c["free"] & (_score(c, start, trees) >= F.lit(bound - 1e-6)))
        extra = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), F.when(c["shape"] == 1, 0).when(c["shape"] == 2, 5).otherwise(4).alias("kind"), c["end"].alias("end")))
    return rows.select("doc_id", "base", F.sort_array(F.array_union("base", extra)).alias("spans"), "key")


def as_text(found_spans: str) -> Column:
    """kind:start:end, comma-joined in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found_spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found_spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans count as one, named by the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        between = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(between)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(found_spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
