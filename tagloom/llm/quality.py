"""Quality rules per document, and verdicts on hosts from how often their documents fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SPACE, settle_table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"

# The host of documents that name none; no host name has this character.
NO_HOST = "\x00"
SALTS = 16
BROADCAST_HOSTS = 50_000


def _windows(words: Column, make) -> Column:
    """make(i) for every start i of three words; empty for fewer words."""
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), make))


def _own(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later steps refer to by row: a generator of one row, which the optimizer
    neither merges with the next projection nor lets a filter reach through, so that no expression is
    put in place of the column and worked out again for each word."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def with_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_rules`` of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Works row by row. The words of a row become an array column of their own, so that the steps
    below refer to it and do not split the text again. Repeated windows are looked for by hash
    first; only rows with equal hashes sort their windows and compare the words themselves.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(whole, F.lit(BLANKS))
    words, hashes, keyed = F.col("_words"), F.col("_hashes"), F.col("_keyed")
    split = _own(
        docs,
        _words=F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+")),
        _lines=F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""),
    )
    hashed = _own(split, _hashes=_windows(words, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    window = lambda i: F.struct(hashes[i].alias("h"), words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i"))
    sorted_ = _own(hashed, _keyed=F.when(repeats, F.sort_array(_windows(words, window))))

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])

    last = F.size(keyed) - 1
    twice = F.filter(
        F.sequence(F.lit(0), last),
        lambda k: F.when((k > 0), same(keyed[k], keyed[F.greatest(k - 1, F.lit(0))])).otherwise(F.lit(False))
        | F.when((k < last), same(keyed[k], keyed[F.least(k + 1, last)])).otherwise(F.lit(False)),
    )
    found = _own(sorted_, _at=F.when(keyed.isNotNull(), F.sort_array(F.transform(twice, lambda k: keyed[k]["i"]))))
    at, n_at = F.col("_at"), F.size("_at")
    covered = F.aggregate(
        F.sequence(F.lit(0), n_at - 1), F.lit(0).cast("long"),
        lambda sum_, k: sum_ + F.when(k == n_at - 1, F.lit(3)).otherwise(F.least(F.lit(3), at[F.least(k + 1, n_at - 1)] - at[k])),
    )
    n = F.size(words).cast("long")
    rules = F.struct(
        n.alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.char_length(whole) - F.char_length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n_at > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    return _own(found, _rules=rules).select(*columns, "_rules")


def base_failed(r: Column) -> Column:
    return (r["n_words"] < 50) | (100 * r["n_repeat_words"] > 50 * r["n_words"])


def soft_failed(r: Column) -> Column:
    """More than a symbol for ten words, half the lines said before, or words of no usual length."""
    return (
        (10 * r["n_symbols"] > r["n_words"]) | (2 * r["n_dup_lines"] > r["n_lines"])
        | (r["word_chars"] < 2 * r["n_words"]) | (r["word_chars"] > 20 * r["n_words"])
    )


def host_verdicts(ruled: DataFrame, watch_rate: float = 0.05, block_rate: float = 0.8) -> DataFrame:
    """(_host, n_docs, n_failed, rate, verdict): a row per host of ``ruled`` (columns _host, _rules).

    The failure rates of all hosts give a beta prior by their mean and variance (less the variance
    that counting alone brings); a host's rate is shrunk towards it, so a host of few documents is
    judged by the others. Hosts from ``block_rate`` on are "blocked", from ``watch_rate`` on
    "watched", the rest "trusted". With one host, or hosts that differ no more than chance would
    have it, all shrink strongly to the mean.
    """
    failed = base_failed(F.col("_rules")) | soft_failed(F.col("_rules"))
    # Counts are written, so the texts behind them are not measured again for the prior and the verdicts.
    hosts = settle_table(
        ruled.groupBy("_host").agg(F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed")), "hosts"
    )
    rate = F.col("n_failed") / F.col("n_docs")
    # One row reaches the driver.
    seen = hosts.agg(
        F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("noise")
    ).first()
    alpha, beta = beta_prior(seen["mean"], seen["var"], seen["noise"])
    shrunk = (F.col("n_failed") + alpha) / (F.col("n_docs") + alpha + beta)
    verdict = F.when(shrunk >= block_rate, "blocked").when(shrunk >= watch_rate, "watched").otherwise("trusted")
    return hosts.select("*", shrunk.alias("rate"), verdict.alias("verdict"))


def beta_prior(mean: float | None, var: float | None, noise: float | None) -> tuple[float, float]:
    """Parameters of the beta distribution that hosts' rates follow, by moments."""
    if mean is None:
        return 1.0, 1.0
    m = min(max(mean, 1e-3), 1 - 1e-3)
    spread = (var or 0.0) - m * (1 - m) * (noise or 0.0)
    strength = min(max(m * (1 - m) / spread - 1, 1.0), 1e4) if spread > 0 else 1e4
    return m * strength, (1 - m) * strength


def judged(ruled: DataFrame, spread: str) -> DataFrame:
    """``ruled`` (with _host and _rules) and columns base_failed, verdict and kept.

    A document is kept if it passes the base rules, its host is not blocked, and, on a watched host,
    it passes the soft rules too. Hosts are joined by broadcast while there are few, and above that
    by (host, salt), so that a host with a third of all documents is spread over tasks; the salt is a
    hash of column ``spread``, which tells the rows of a host apart.
    """
    hosts = host_verdicts(ruled).select("_host", "verdict")
    if hosts.count() <= BROADCAST_HOSTS:
        joined = ruled.join(F.broadcast(hosts), "_host")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
        joined = ruled.withColumn("_salt", salt).join(hosts.withColumn("_salt", salts), ["_host", "_salt"]).drop("_salt")
    rules, verdict = F.col("_rules"), F.col("verdict")
    kept = ~base_failed(rules) & (verdict != "blocked") & ~((verdict == "watched") & soft_failed(rules))
    return joined.select("*", base_failed(rules).alias("base_failed"), kept.alias("kept"))


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, _rules, verdict, base_failed, kept): a row per row of ``docs``; texts are read once.

    Null texts have no words and fail; null hosts are one host; repeated rows count each time; an
    empty table gives no row. Other columns are ignored.
    """
    slim = docs.select(
        docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.coalesce(docs[host].cast("string"), F.lit(NO_HOST)).alias("_host")
    )
    measured = with_rules(slim).select("doc_id", "_host", "_rules")
    return judged(settle_table(measured, "rules"), "doc_id").drop("_host")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever these are called.

    Texts are measured twice, once for their hosts and once for themselves, and not shuffled. Null texts
    have no words and go; null hosts are one host; repeated rows are judged alike and stay as often as
    they are there; an empty table gives no rows.
    """
    row = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("_row")
    named = docs.select(row, F.coalesce(docs[host].cast("string"), F.lit(NO_HOST)).alias("_host"))
    ruled = with_rules(named, f"_row.`{text}`")
    return judged(ruled, f"_row.`{doc_id}`").filter("kept").select("_row.*")
