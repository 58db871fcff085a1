"""Personal data: fixed formats, and further candidates that boosted trees take for the same."""

from __future__ import annotations

import math
import random
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "likely"]

# The formats searched for. A run of characters that cannot start a match is passed over as a whole:
# the quantifiers give nothing back, and matches start where a run starts or the match before ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Candidates: anything with an at sign (or one spelled out), any group of seven digits or more, and codes.
AT_LIKE = (
    r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D]++"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?)[A-Za-z0-9-]++)*+"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++)++"
)
DIGITS_LIKE = r"[+(]?[0-9](?:[\x20().\x2d/]{0,3}[0-9]){6,}+"
CODES = {
    # account numbers: country, check digits, and up to thirty characters, in fours or without a gap
    1: r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+",
    # addresses of eight groups of hexadecimal digits, one stretch of them left out or none
    2: r"(?:[0-9A-Fa-f]{0,4}:){2,7}+(?:[0-9A-Fa-f]{1,4})?+",
    # insurance numbers of two letters, six digits and a letter
    3: r"[A-Z]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[A-Z]",
}
CODE_LIKE = r"(?<![\p{L}\p{N}_:.-])(?:" + "|".join(CODES.values()) + r")(?![\p{L}\p{N}_:])"

CHUNK = 256

# Words before a candidate that tell what it is.
CONTEXT = {1: r"(?i)\b(phone|telephone|telefon|tel|call|fax|mobile|mobil|cell)\W*$", 2: r"(?i)\b(card|visa|account|acct|iban|ssn|security)\W*$", 3: r"(?i)\b(ip|host|server|addr(ess)?)\W*$", 4: r"(?i)\b(e-?mail|mail|contact|reach)\W*$"}

# How a group of digits is written, the first that holds; a number glued to a word, sign or code has none of these.
GLUED = r"[\p{L}\p{N}_#$\u20ac\u00a3=&-]$"
SHAPES = {
    # dates, with or without an hour behind them
    3: r"^(?:(?:19|20)[0-9]{2}([-/. ]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])(?:[^0-9].*)?|[0-9]{1,2}([-/. ])[0-9]{1,2}\2(?:19|20)[0-9]{2}(?:[^0-9].*)?)$",
    # national numbers of three, three and four digits
    1: r"^(?:1[ .-])?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}$",
    # area codes behind a zero
    2: r"^\(?0[1-9][0-9]{0,3}\)?(?:[ ./-]{1,3}[0-9]{2,8}){1,4}$",
    # local numbers
    4: r"^[2-9][0-9]{2}[ .-][0-9]{4}$",
    # the same without any separator
    5: r"^(?:1?[2-9][0-9]{2}[2-9][0-9]{6}|0[1-9][0-9]{8,9})$",
    # national ids of three, two and four digits
    6: r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    # numbers behind a country's code
    7: r"^\+[1-9][0-9]{0,2}[ .-]?(?:\(0?[0-9]{1,4}\)|[0-9]{1,4})(?:[ ./-]{1,3}[0-9]{2,8}){1,4}$",
}

# An address in full or with one stretch left out, which is not a time of day, a hardware address or a scope.
ADDRESS = r"^(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*[0-9])(?!.*::.*::)(?=(?:[^:]*:){2,7}[^:]*$)[0-9A-Fa-f]{2,4}(?::[0-9A-Fa-f]{1,4})*::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)$"
INSURED = r"^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[A-D]$"
# What no host is called where "at" and "dot" are words of a sentence.
PROSE = r"(?i)\x20at\x20(?:the|a|an|this|that|each|every|my|your|his|her|its|our|their|one|no)\x20"

# Features of a candidate and how many values each has.
FEATURES = {"source": 3, "size": 8, "separator": 6, "lead": 3, "checked": 2, "groups": 5, "context": 5, "shape": 8}

# Where a number may begin or end inside a longer run of them, by what stands there: a bracket opens, or
# a space and something else. A single space is such a place for numbers without spaces of their own.
WIDE_GAP = r"\(|\x20[^\x20]|[^\x20)]\x20|\x20\x20"
LEAST_DIGITS, MOST_DIGITS = 7, 15


def running(n: Column, zero: Column, kind: str, step) -> Column:
    """What ``step(state, i)``, an array to go on with and the next state, gives for 0 to n - 1, in order.

    Results are put together in chunks of chunks, so a million of them take no array of a million copies.
    """
    empty = F.array().cast(f"array<{kind}>")

    def chunk(state: Column, c: Column) -> Column:
        first = c * CHUNK
        return F.aggregate(
            F.sequence(first, F.least(first + CHUNK, n) - 1),
            F.struct(state.alias("state"), empty.alias("out")),
            lambda a, i: F.transform(
                F.array(step(a["state"], i)),
                lambda x: F.struct(x["state"].alias("state"), F.concat(a["out"], x["out"]).alias("out")),
            )[0],
        )

    chunks = F.aggregate(
        F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")),
        F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done")),
        lambda acc, c: F.transform(
            F.array(chunk(acc["state"], c)),
            lambda x: F.struct(x["state"].alias("state"), F.concat(acc["done"], F.array(x["out"])).alias("done")),
        )[0],
        lambda acc: F.flatten(acc["done"]),
    )
    return F.when(n > 0, chunks).otherwise(empty)


def located(matches: Column, gaps: Column) -> Column:
    """(start, end, value, before) of matches: every match starts after the gaps and matches before it."""

    def step(at: Column, i: Column) -> Column:
        start = at + F.char_length(gaps[i])
        end = start + F.char_length(matches[i])
        one = F.struct(start.alias("start"), end.alias("end"), matches[i].alias("value"), F.right(gaps[i], F.lit(24)).alias("before"))
        return F.struct(end.alias("state"), F.array(one).alias("out"))

    return running(F.size(matches), F.lit(0).cast("long"), "struct<start:bigint,end:bigint,value:string,before:string>", step)


def blanked(matches: Column, gaps: Column, valid) -> Column:
    """The text with its valid matches as line ends, of the same length."""
    covered = F.transform(matches, lambda m: F.when(valid(m), F.repeat(F.lit("\n"), F.char_length(m))).otherwise(m))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), covered.alias("match")), lambda x: F.array(x["gap"], F.coalesce(x["match"], F.lit(""))))), "")


def numbers(run: Column) -> Column:
    """The spans of a run of digits that may be numbers: the run, and what lies between two places where one may begin or end.

    Every group of digits that starts at such a place starts spans of 7 to 15 digits; they overlap.
    """
    groups = F.regexp_extract_all(run["value"], F.lit("[0-9]+"), 0)
    gaps = F.split(run["value"], "[0-9]+", -1)

    def spans(at: Column, gaps: Column) -> Column:
        last = F.size(at) - 1

        def whole(i: Column, j: Column) -> Column:
            lead = F.regexp_extract(gaps[i], r"[+(]$", 0)
            more = F.when(j > i, F.transform(F.sequence(i + 1, F.greatest(j, i + 1)), lambda k: F.concat(gaps[k], at[k]["value"]))).otherwise(F.array().cast("array<string>"))
            return F.struct(
                (run["start"] + at[i]["start"] - F.length(lead)).alias("start"), (run["start"] + at[j]["end"]).alias("end"),
                F.concat(lead, at[i]["value"], F.array_join(more, "")).alias("value"),
                F.when(i == 0, run["before"]).otherwise(F.concat(at[F.greatest(i - 1, F.lit(0))]["value"], F.regexp_replace(gaps[i], r"[+(]$", ""))).alias("before"),
            )

        def free(i: Column, j: Column, s: Column) -> Column:
            """Whether the span of groups i to j stands at places where a number may begin and end."""
            left, right, spaced = gaps[i], gaps[j + 1], s["value"].contains(" ")
            opens = (i == 0) | left.rlike(WIDE_GAP) | ((left == " ") & ~spaced)
            closes = (j == last) | right.rlike(WIDE_GAP) | ((right == " ") & ~spaced)
            return opens & closes & F.length(digits(s["value"])).between(LEAST_DIGITS, MOST_DIGITS) & ~((i == 0) & (j == last))

        starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | gaps[i].contains(" ") | gaps[i].contains("("))
        return F.flatten(F.transform(starts, lambda i: F.filter(
            # as many groups as a number has digits, at most
            F.transform(F.sequence(i, F.least(i + MOST_DIGITS - 1, last)), lambda j: F.struct(i.alias("i"), j.alias("j"), whole(i, j).alias("s"))),
            lambda x: free(x["i"], x["j"], x["s"]),
        )))

    # Arrays of one keep what is between their brackets from being worked out anew for every group.
    inner = F.transform(
        F.array(F.struct(groups.alias("groups"), gaps.alias("gaps"))),
        lambda g: F.transform(F.array(located(g["groups"], g["gaps"])), lambda at: F.transform(spans(at, g["gaps"]), lambda x: x["s"]))[0],
    )[0]
    return F.concat(F.array(F.struct(run["start"], run["end"], run["value"], run["before"])), F.when(F.size(groups) > 1, inner).otherwise(F.array()))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether 12 to 19 digits pass the Luhn check; counted from the right, every second one is doubled."""
    d = digits(value)
    n = F.length(d)

    def weight(i: Column) -> Column:
        x = F.substr(d, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + weight(i))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def ip_parts(value: Column) -> Column:
    return F.forall(
        F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0"))),
        lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")),
    )


def phone_digits(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


PATTERNS = {
    "email": (EMAIL, lambda t: t.contains("@"), lambda v: F.lit(True)), "ip": (IP, lambda t: t.contains("."), ip_parts),
    "card": (CARD, lambda t: F.lit(True), luhn), "phone": (PHONE, lambda t: t.contains("+"), phone_digits),
}
GENERATORS = {
    "at": (AT_LIKE, lambda t: t.rlike(r"@|[\[({]\x20?(?i:at)\x20?[\])}]|\x20(?i:dot)\x20")), "digits": (DIGITS_LIKE, lambda t: F.lit(True)),
    "code": (CODE_LIKE, lambda t: F.lit(True)),
}


def account_check(value: Column) -> Column:
    """Whether an account number leaves 1 when divided by 97: its first four characters go last, letters count from 10."""
    v = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substr(v, F.lit(5)), F.left(v, F.lit(4)))
    place = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(
        F.transform(F.split(turned, ""), place), F.lit(0),
        lambda a, d: F.when(d > 9, a * 100 + d).otherwise(a * 10 + F.greatest(d, F.lit(0))) % 97,
    )
    return F.length(v).between(15, 34) & (rest == 1)


def features(c: Column, source: str) -> Column:
    value, before = c["value"], c["before"]
    n = F.least(F.length(digits(value)), F.lit(24))
    at_size = F.least(F.floor(F.length(value) / 8), F.lit(7)).cast("int")
    context = F.lit(0)
    for k, words in CONTEXT.items():
        context = F.when(before.rlike(words), k).otherwise(context)
    has = lambda pattern: value.rlike(pattern)
    if source == "at":
        size, groups = at_size, F.least(F.size(F.split(value, r"\.|(?i:dot)")) - 1, F.lit(4))
        named = r"(?:\.|[\])}]?\x20?(?i:dot)\x20?[\])}]\x20?)\p{L}{2,}[.,;:!?)>\]\"']*$"
        plain = r"\x20(?i:at)\x20[^\x20]++\x20(?i:dot)\x20"
        separator = F.when(has(plain), 5).when(has("@.*@"), 4).when(has(r"@[\p{L}\p{N}.-]+" + named), 1).when(has("@"), 2).when(has(named), 3).otherwise(0)
        lead = F.when(has(r"^[(<\[\"']*[\p{L}\p{N}]"), 0).otherwise(1)
        checked = has(r"^[(<\[\"']*[\p{L}\p{N}._%+-]+(?:@|\x20?[\[({])") | (has(plain) & has(r"(?i:dot)\x20[A-Za-z]{2,6}$") & ~has(PROSE))
        shape = F.lit(0)
    elif source == "code":
        size, groups, separator, lead = at_size, F.lit(0), F.lit(0), F.lit(0)
        shape = F.when(has(r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){9,}$"), 1).when(has(":"), 2).otherwise(3)
        checked = F.when(shape == 1, account_check(value)).when(shape == 2, has(ADDRESS)).otherwise(has(INSURED))
    else:
        size = F.when(n < 9, 0).when(n < 10, 1).when(n < 11, 2).when(n < 12, 3).when(n < 13, 4).when(n < 16, 5).when(n < 20, 6).otherwise(7)
        groups = F.least(F.size(F.split(value, "[^0-9+(]+")) - 1, F.lit(4))
        separator = F.when(has(r"^[+(]?[0-9]+$"), 0).when(has(r"^[0-9.]+$"), 1).when(has(r"^[0-9 ]+$"), 2).when(has("^[0-9-]+$"), 3).otherwise(4)
        lead = F.when(has(r"^\+"), 1).when(has(r"^\("), 2).otherwise(0)
        checked, shape = luhn(value), F.lit(0)
        for k, form in reversed(SHAPES.items()):
            shape = F.when(has(form), k).otherwise(shape)
        shape = F.when(before.rlike(GLUED), 0).otherwise(shape)
    values = {"source": F.lit(list(GENERATORS).index(source)), "size": size, "separator": separator, "lead": lead, "checked": checked, "groups": groups, "context": context, "shape": shape}
    return F.struct(
        c["start"].alias("start"), c["end"].alias("end"),
        *[v.cast("int").alias(k) for k, v in values.items()],
    )


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"))


def candidates(whole: DataFrame) -> DataFrame:
    """(doc_id, base, cand): spans of the fixed formats, and candidates with their features, per row of (doc_id, _text)."""
    none = F.array().cast("array<string>")

    def matched(df: DataFrame, t: Column, found: dict) -> DataFrame:
        """Matches of each pattern, and what stands between them; only texts with a match are cut."""
        df = df.select("*", *[F.when(hint(t), F.regexp_extract_all(t, F.lit(p), 0)).otherwise(none).alias(f"_m_{k}") for k, (p, hint) in found.items()])
        return df.select("*", *[F.when(F.size(f"_m_{k}") > 0, F.split(t, p, -1)).otherwise(none).alias(f"_g_{k}") for k, (p, _) in found.items()])

    fixed = matched(whole, F.col("_text"), {k: (p, hint) for k, (p, hint, _) in PATTERNS.items()})
    bare = fixed.select(
        "doc_id", F.col("_text").alias("_bare"), *[f"_{x}_{k}" for k in PATTERNS for x in "mg"],
        *[F.exists(f"_m_{k}", PATTERNS[k][2]).alias(f"_has_{k}") for k in PATTERNS],
    )
    # A text without the values of the fixed formats. The longest of them are taken out first.
    for k in ["phone", "card", "email", "ip"]:
        pattern, _, valid = PATTERNS[k]
        t = F.col("_bare")
        cut = blanked(F.regexp_extract_all(t, F.lit(pattern), 0), F.split(t, pattern, -1), valid)
        bare = bare.withColumn("_bare", F.when(F.col(f"_has_{k}"), cut).otherwise(t))
    wide = matched(bare, F.col("_bare"), GENERATORS)
    placed = wide.select(
        "doc_id", *[located(F.col(f"_m_{k}"), F.col(f"_g_{k}")).alias(f"_s_{k}") for k in [*PATTERNS, *GENERATORS]]
    )
    placed = placed.withColumn("_s_digits", F.flatten(F.transform("_s_digits", numbers)))

    def based(kind: str) -> Column:
        return F.transform(
            F.filter(f"_s_{kind}", lambda s: PATTERNS[kind][2](s["value"])),
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        )

    return placed.select(
        "doc_id", F.concat(*[based(k) for k in PATTERNS]).alias("base"),
        F.concat(*[F.transform(f"_s_{g}", _features_of(g)) for g in GENERATORS]).alias("cand"),
    )


def _features_of(source: str):
    return lambda s: features(s, source)


class Trees:
    """Gradient boosting of the logistic loss by trees of three levels over small whole numbers."""

    def __init__(self, x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 60, rate: float = 0.4):
        total = positive.sum() + negative.sum()
        share = (positive.sum() + 1) / (total + 2)
        self.start, self.trees = math.log(share / (1 - share)), []
        score = np.full(len(x), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = positive * (1 - p) - negative * p, (positive + negative) * p * (1 - p)
            tree = self._grow(x, gradient, weight, np.ones(len(x), bool), 3)
            if tree is None or isinstance(tree, float):
                break
            self.trees.append(tree)
            score += rate * self._apply(tree, x)
        self.rate, self.scales, self.least = rate, {}, {}

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, positive: np.ndarray, negative: np.ndarray, least: float) -> None:
        """Scale and threshold of each generator from rows that were not fitted.

        The threshold is the log-odds of ``least``, or more where held-out candidates from there on
        are right less often than that.
        """
        for source in range(FEATURES["source"]):
            rows = x[:, 0] == source
            score, right, wrong = self.score(x[rows]), positive[rows], negative[rows]
            self.scales[source] = a, b = self._calibrate(score, right, wrong)
            odds = a * score + b
            order = np.argsort(-odds, kind="stable")
            share = np.cumsum(right[order]) / np.maximum(np.cumsum((right + wrong)[order]), 1)
            sunk = [v for v in np.unique(odds) if share[np.flatnonzero(odds[order] >= v)[-1]] < least]
            above = odds[odds > sunk[-1]] if sunk else odds
            self.least[source] = max(math.log(least / (1 - least)), float(above.min()) - 1e-9 if len(above) else math.inf)

    @staticmethod
    def _leaf(gradient, weight, rows) -> float:
        return float(np.clip(gradient[rows].sum() / (weight[rows].sum() + 1.0), -4, 4))

    def _grow(self, x, gradient, weight, rows, depth):
        if depth == 0:
            return self._leaf(gradient, weight, rows)
        best = (1e-6, None)
        whole = gradient[rows].sum() ** 2 / (weight[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            values = x[rows, f]
            n, g, w = (np.cumsum(np.bincount(values, v)) for v in (None, gradient[rows], weight[rows]))
            for cut in range(len(n) - 1):
                if 0 < n[cut] < n[-1]:
                    gain = g[cut] ** 2 / (w[cut] + 1.0) + (g[-1] - g[cut]) ** 2 / (w[-1] - w[cut] + 1.0) - whole
                    if gain > best[0]:
                        best = (gain, (f, cut))
        if best[1] is None:
            return self._leaf(gradient, weight, rows)
        f, cut = best[1]
        left, right = rows & (x[:, f] <= cut), rows & (x[:, f] > cut)
        return f, cut, self._grow(x, gradient, weight, left, depth - 1), self._grow(x, gradient, weight, right, depth - 1)

    def _apply(self, tree, x) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, left, right = tree
        return np.where(x[:, f] <= cut, self._apply(left, x), self._apply(right, x))

    @staticmethod
    def _calibrate(score, positive, negative) -> tuple[float, float]:
        """Scale and shift after which scores are log-odds, by Newton steps on the same counts."""
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-(a * score + b)))
            g, w = positive * (1 - p) - negative * p, (positive + negative) * p * (1 - p) + 1e-9
            hess = np.array([[np.sum(w * score**2) + 1e-3, np.sum(w * score)], [np.sum(w * score), np.sum(w) + 1e-3]])
            da, db = np.linalg.solve(hess, [np.sum(g * score) - 1e-3 * (a - 1), np.sum(g) - 1e-3 * b])
            a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
        return a, b

    def margin(self, c: Column) -> Column:
        """By how much a candidate's calibrated log-odds exceed the threshold of its generator."""
        names = list(FEATURES)

        def column(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, left, right = tree
            return F.when(c[names[f]] <= cut, column(left)).otherwise(column(right))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + self.rate * column(tree)
        total, out = F.array(total), F.lit(-math.inf)
        for source, (a, b) in self.scales.items():
            out = F.when(c["source"] == source, F.transform(total, lambda t: a * t + b - self.least[source])[0]).otherwise(out)  # noqa: B023
        return out


SAMPLE = 9_000


def sample(n: int = SAMPLE, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, spans of personal data): ``n`` short texts with one value or two each, the same ones every time.

    The labels come from what was planted, not from the fixed formats. Two in five have personal data:
    national, local and foreign phones with and without an area code's zero or bracket, two of them in a
    row, mail addresses spelled with "at" and "dot" and those with letters outside ASCII, national ids,
    account numbers and long host addresses. The others are order and part numbers, tables of numbers,
    dates and times, versions, addresses out of range, amounts, book numbers, ranges, cards and accounts
    with a wrong digit, hardware addresses, handles, decorators, matrix products, hosts and prose with an "at".
    """
    r = random.Random(seed)
    pick, num = r.choice, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    area = lambda: pick("23456789") + num(2)
    name = lambda: pick(["john", "mary.smith", "j_doe", "info", "sales", "anna-b", "k.lee42", "office+x", "support", "bo", "al", "tim", "x1"])
    host = lambda: pick(["example", "mail", "acme-corp", "uni-bonn", "post", "my.host", "a1", "web", "gmx"])
    end = lambda: pick(["com", "org", "net", "de", "co.uk", "info", "io", "fr"])
    plain = ["see", "it was", "and then", "we had", "the list has", "about", ""]
    call = ["phone", "tel:", "call", "fax", "Mobile:", "Tel.", "cell", "Telefon"]
    mail = ["e-mail", "mail", "contact", "reach", "Email:"]
    account = ["account", "IBAN", "SSN", "social security:", "acct"]

    def spelled() -> str:
        if r.random() < 0.3:
            return f"{name()} at {host().replace('.', '-')} dot {pick(['com', 'org', 'net', 'de', 'co dot uk'])}"
        a, z = pick(["[]", "()", "{}"])
        gap = pick(["", " "])
        dot = pick([".", ".", f"{gap}{a}dot{z}{gap}"])
        return f"{name()}{gap}{a}{pick(['at', 'at', 'AT'])}{z}{gap}{host()}{dot}{end()}"

    def foreign() -> str:
        return f"{pick(['j\u00f6rg', 'zo\u00eb.k', 'mary', 'info'])}@{pick(['b\u00fccher', 'caf\u00e9-paris', 'm\u00fcller', '\u043f\u043e\u0447\u0442\u0430'])}.{pick(['de', 'com', 'fr', '\u0440\u0444'])}"

    def national() -> str:
        a, b, c, s = area(), num(3), num(4), pick("- .")
        return pick([f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}{s}{b}{s}{c}", f"1{s}{a}{s}{b}{s}{c}"])

    def trunk() -> str:
        if r.random() < 0.2:
            return " ".join([f"0{pick('123456789')}", *(num(2) for _ in range(4))])
        z, s = f"0{pick('123456789')}{num(r.randint(0, 3))}", pick([" ", "-", "/", " / ", " "])
        z = pick([z, z, f"({z})"])
        body = pick([num(r.randint(6, 8)), f"{num(4)} {num(4)}", f"{num(3)} {num(4)}", " ".join(num(2) for _ in range(r.randint(3, 4)))])
        return z + s + body

    def abroad() -> str:
        return f"+{pick('123456789')}{num(r.randint(0, 1))} {num(r.randint(2, 3))} {pick([num(7), num(8), f'{num(4)} {num(4)}', f'{num(3)}-{num(4)}'])}"

    def two() -> list[str]:
        s = pick("-.")
        joined = lambda: f"{area()}{s}{num(3)}{s}{num(4)}"
        return pick([[joined(), pick([" / ", " ", ". ", " - "]), joined()], [abroad(), " ", f"({area()}) {num(3)}-{num(4)}"], [f"({area()}) {num(3)}-{num(4)}", " / ", national()]])

    def person() -> str:
        return f"{pick('12345678')}{pick('12345789')}{num(1)}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}"

    def iban(wrong: int = 0) -> str:
        country, body = pick(["DE", "GB", "FR", "NL", "ES", "IT"]), pick(["", "ABCD", "WXYZ"]) + num(r.randint(14, 20))
        rest = int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        whole = f"{country}{(98 - rest + wrong) % 97:02}{body}"
        return pick([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])

    def insured() -> str:
        return pick([" ", ""]).join([pick(["AB", "CE", "JG", "PX", "SK"]), num(2), num(2), num(2), pick("ABCD")])

    def long_host() -> str:
        part = lambda: f"{r.randrange(1, 65536):x}"
        return pick([":".join(f"{r.randrange(65536):04x}" for _ in range(8)), f"2001:{part()}::{part()}", f"fe80::{part()}:{part()}:{part()}", f"2a02:{part()}:{part()}::{num(1)}"])

    def day() -> str:
        y, m, d, s = f"{pick(['19', '20'])}{num(2)}", f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}", pick("-/.")
        return pick([f"{y}{s}{m}{s}{d}", f"{d}{s}{m}{s}{y}", f"{y}-{m}-{d} {num(2)}", f"{y}{m}{d}", f"{y}{m}{d}{num(6)}", f"{y}-{m}-{d} {y}-{m}-{d}"])

    def code() -> str:
        sizes, s = [r.randint(1, 6) for _ in range(r.randint(2, 4))], pick("- ./")
        return pick([num(r.randint(7, 16)), s.join(num(k) for k in sizes + [max(1, 7 - sum(sizes))])])

    def row() -> str:
        s = pick([" ", "  ", " / "])
        return s.join(pick([num(r.randint(1, 7)), f"{num(r.randint(1, 3))}.{num(r.randint(1, 5))}", f"{num(3)}-{num(3)}"]) for _ in range(r.randint(3, 7)))

    def figure() -> str:
        return pick([
            f"{r.randint(1, 12)}.{r.randint(0, 30)}.{num(5)}.{num(4)}", f"{r.randint(256, 999)}.{num(3)}.{num(2)}.{num(1)}",
            f"{num(1)}.{num(8)}", f"{r.randint(1, 999)} {num(3)} {num(3)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
            f"19{num(2)}-20{num(2)}", f"20{num(2)}/20{num(2)}", f"{num(6)}-{num(6)}", " ".join(num(2) for _ in range(6)), f"{num(4)} {num(4)} {num(4)} {num(3)}",
        ])

    def handle() -> str:
        return pick([
            f"@{name()}", f"@{host()}.{pick(['route', 'cache', 'setter'])}", f"{name()}@{pick(['localhost', 'host', 'db1', '3', '10:30'])}", "@", f"{name()}@@{host()}.{end()}",
            f"x[0]@y.{pick(['T', 'dot'])}", f"{pick(['meet', 'look', 'stay', 'arrive'])} {pick(['(at)', '[at]', '{at}'])} {pick(['noon', 'home', 'this', 'x', 'all'])}", f"//{host()}@{num(2)}/{num(3)}",
            f"{pick(['look', 'aim', 'point'])} at {pick(['the', 'a', 'each', 'this', 'my'])} dot {pick(['com', 'matrix', 'on'])}",
        ])

    def mark() -> str:
        return pick([
            f"{num(2)}:{num(2)}:{num(2)}", ":".join(f"{r.randrange(256):02X}" for _ in range(6)), f"a::b::c{num(1)}", f"{num(1)}:{num(1)}:{num(2)}", "::",
            iban(r.randint(1, 90)), f"{pick(['DF', 'QA', 'OO', 'VV'])} {num(2)} {num(2)} {num(2)} {pick('EXYZ')}", f"9{num(2)}-{num(2)}-{num(4)}", f"{num(3)}-00-{num(4)}",
        ])

    yes = [
        (national, plain + call), (national, plain + call), (trunk, plain + call), (trunk, plain + call), (spelled, plain + mail), (spelled, plain + mail), (foreign, plain + mail),
        # bare and local numbers are phones only where a word says so
        (lambda: pick([f"{area()}-{num(4)}", area() + area() + num(4), f"0{pick('123456789')}{num(9)}"]), call),
        (two, plain + call), (person, plain + account), (iban, plain + account), (insured, plain + account), (long_host, plain + ["host", "ip"]),
    ]
    no = [day, day, handle, handle, figure, figure, figure, row, row, row, mark, mark, mark, code, code, code, code, code, lambda: pick("#$=-A") + national()]
    out = []
    while len(out) < n:
        kind = r.randrange(len(yes) + len(no))
        make, words = yes[kind] if kind < len(yes) else (no[kind - len(yes)], [*plain, "card", "host"])
        made, text, spans = make(), pick(words) + " ", []
        for i, part in enumerate([made] if isinstance(made, str) else made):
            if kind < len(yes) and i % 2 == 0:
                spans.append((len(text), len(text) + len(part)))
            text += part
        out.append((f"{text} {pick(['', 'ok', 'and more'])}", spans))
    return out


FITTED: dict[float, Trees] = {}


def fit(spark: SparkSession, least: float) -> Trees:
    """The trees for a probability, which come from the same examples every time and so are fitted once in a process."""
    if least not in FITTED:
        FITTED[least] = _fit(spark, least)
    return FITTED[least]


def _fit(spark: SparkSession, least: float) -> Trees:
    """Trees from ``sample``: its even rows are fitted, its odd rows calibrate each generator.

    A candidate is personal if it is a planted value as a whole; parts of one, and more than one, are not.
    Fixed formats are left out, as they are found without trees. The background gives every
    combination of features a small share of the negative weight: what no example speaks for is not taken.
    """
    names, planted = list(FEATURES), sample()
    texts = pa.table({"doc_id": pa.array(range(len(planted)), pa.int64()), "text": [t for t, _ in planted]})
    found = candidates(keyed(spark.createDataFrame(texts), "doc_id", "text")).select("doc_id", F.explode("cand").alias("c"))
    # Only numbers and codes have shapes; codes have nothing but these, their size, check and context.
    # The last separator is one of spelled mails.
    bare = [names.index(k) for k in ("separator", "lead", "groups")]
    grid = [g for g in product(*(range(k) for k in FEATURES.values())) if (g[0] or not g[-1]) and (g[0] < 2 or not any(g[i] for i in bare)) and (not g[0] or g[2] < 5)]
    at = {g: i for i, g in enumerate(grid)}
    # counts[held out][personal] of every combination
    counts = np.zeros((2, 2, len(grid)))
    for row in found.collect():
        c = row["c"]
        counts[row["doc_id"] % 2, int((c["start"], c["end"]) in planted[row["doc_id"]][1]), at[tuple(c[k] for k in names)]] += 1
    x = np.array(grid, np.int16)
    known = counts[1].sum(axis=0) > 0
    background = max(counts[0, 1].sum() * 0.1, 1.0) / len(grid)
    trees = Trees(x, counts[0, 1], counts[0, 0] + background)
    trees.calibrate(x[known], counts[1, 1][known], counts[1, 0][known], least)
    return trees


def best_apart(cand: Column) -> Column:
    """Of candidates (start, end, margin), in order, those that overlap give the one of the largest margin, in one pass from the left; of equal ones the longer."""
    kind = "struct<start:bigint,end:bigint,margin:double>"
    # A last candidate that overlaps nothing hands out the one before it.
    far, none = (F.struct(F.lit(v).alias("start"), F.lit(v).alias("end"), F.lit(0.0).alias("margin")).cast(kind) for v in (2**62, -1))

    def step(held: Column, i: Column) -> Column:
        c = F.coalesce(F.get(cand, i), far)
        apart = held["end"] <= c["start"]
        better = (c["margin"] > held["margin"]) | ((c["margin"] == held["margin"]) & (c["end"] - c["start"] > held["end"] - held["start"]))
        return F.struct(F.when(apart | better, c).otherwise(held).alias("state"), F.when(apart, F.array(held)).otherwise(F.array().cast(f"array<{kind}>")).alias("out"))

    chosen = running(F.size(cand) + 1, none, kind, step)
    return F.when(F.size(cand) > 0, F.filter(chosen, lambda s: s["start"] >= 0)).otherwise(F.array().cast(f"array<{kind}>"))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.95) -> DataFrame:
    """(doc_id, base, spans): a row per row of ``docs``; spans are (kind, start, end) in code points, end exclusive.

    ``base`` has the fixed formats; ``spans`` has them and the candidates outside of them whose
    calibrated probability reaches ``least``, as kind "likely", the likeliest of those that overlap;
    the trees come from planted examples (``sample``), so a document's spans do not depend on the
    others. Null and empty texts have no spans; repeated rows give repeated rows; null ids stay null;
    other columns are ignored; an empty table gives no row.
    """
    return _spans(keyed(docs, doc_id, text), least)


def _spans(whole: DataFrame, least: float) -> DataFrame:
    found, trees = candidates(whole), fit(whole.sparkSession, least)
    scored = F.transform("cand", lambda c: F.struct(c["start"], c["end"], trees.margin(c).alias("margin")))
    found = found.select("doc_id", "base", F.array_sort(F.filter(scored, lambda c: c["margin"] >= 0)).alias("likely"))
    extra = F.transform(
        best_apart(F.col("likely")), lambda c: F.struct(F.lit("likely").alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    )
    return found.select("doc_id", "base", F.concat("base", extra).alias("spans"))


BLOCK = 4096


def redact(docs: DataFrame, text: str = "text", mark: str = "[PII]", least: float = 0.95) -> DataFrame:
    """``docs`` with every span of :func:`find_pii` in its text (overlapping ones as one) replaced by ``mark``.

    A null text stays null, one without spans as it is; all other columns, null ids and repeated rows
    are kept; an empty table gives no row. Texts are cut in blocks, so that a piece of a long one is
    taken from its blocks and not looked for from the start.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"))
    old = F.col("doc_id")[text].cast("string")
    placed = _spans(whole, least).select(
        "doc_id", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"]))).alias("_spans"),
        F.regexp_extract_all(old, F.lit(f"(?s).{{1,{BLOCK}}}"), 0).alias("_blocks"), F.char_length(old).cast("long").alias("_size"),
    )

    def piece(start: Column, end: Column) -> Column:
        def part(k: Column) -> Column:
            first = F.greatest(start - k * BLOCK, F.lit(0))
            return F.substr(F.get("_blocks", k), (first + 1).cast("int"), (F.least(end - k * BLOCK, F.lit(BLOCK)) - first).cast("int"))

        first, last = (F.floor(x / BLOCK).cast("int") for x in (start, F.greatest(end - 1, start)))
        return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")

    def step(done: Column, i: Column) -> Column:
        start = F.coalesce(F.get("_spans", i)["start"], F.col("_size"))
        last = i == F.size("_spans")
        out = F.when(last, F.array(piece(done, start))).when((i > 0) & (start < done), F.array().cast("array<string>")).otherwise(F.array(piece(done, start), F.lit(mark)))
        return F.struct(F.greatest(done, F.coalesce(F.get("_spans", i)["end"], done)).alias("state"), out.alias("out"))

    new = F.array_join(running(F.size("_spans") + 1, F.lit(0).cast("long"), "string", step), "")
    clean = F.when(F.size("_spans") > 0, new).otherwise(old)
    return placed.select(*[(clean if c == text else F.col("doc_id")[c]).alias(c) for c in docs.columns])
