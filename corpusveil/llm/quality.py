"""Quality rules with verdicts by host: rule failures by domain, shrunk with an empirical beta prior.

Everything is DataFrame functions. Measures of a text are array expressions over its own words, so a long
text costs one row; only counts by host are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import cut, small_or_plain, tune

SPACE = r"[\x20\x09-\x0D]+"
#: A host is rejected if the shrunk failure rate of any rule is over this.
MAX_RATE = 0.5
#: Rules that count at the level of hosts: a document fails if the condition holds.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
#: Rules that reject a document by themselves.
BASE_RULES = ("short", "repetitive")


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of three words that occur twice or more."""

    def covered(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def by_values(windows: Column, twice: Column) -> Column:
        return covered(F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(twice, F.get(windows, i))))

    def by_order(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(ordered, lambda o: covered(F.transform(F.filter(o, lambda p, j: (F.get(o, j - 1)["x"] == p["x"]) | (F.get(o, j + 1)["x"] == p["x"])), lambda p: p["i"])))

    def of_windows(windows: Column) -> Column:
        twice = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i - 1) == x)))
        return let(twice, lambda t: F.when(F.size(t) == 0, 0).when(F.size(t) <= 8, by_values(windows, t)).otherwise(by_order(windows)))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
        return F.when(F.size(h) < 3, 0).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """k, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row; a null text is as an empty one."""
    return measured_with(docs, F.col(f"`{key}`"), text, host)


def measured_with(docs: DataFrame, carried: Column, text: str, host: str) -> DataFrame:
    """The measures of each row, with another column as k."""
    own = docs.select(carried.alias("k"), F.col(f"`{host}`").cast("string").alias("host"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    words = F.filter(F.split("t", SPACE), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))
    out = own.select("k", "host", of_words.alias("w"), F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"))
    return out.select("k", "host", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def host_verdicts(measured: DataFrame, rules: dict[str, str] = RULES, max_rate: float = MAX_RATE) -> DataFrame:
    """host, n_docs, the shrunk failure rate of each rule, and rejected.

    The rates of a rule over all hosts have mean m and sample variance v; the beta prior with these moments
    has a weight of m (1 - m) / v - 1 documents (1 if that is not positive or there is one host). A null
    host is a host of its own.
    """
    sums = measured.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(F.expr(f"cast({c} as long)")).alias(f"f_{r}") for r, c in rules.items()))
    sums = cut(sums, "hosts")
    moments = sums.agg(*(f(F.col(f"f_{r}") / F.col("n_docs")).alias(f"{n}_{r}") for r in rules for n, f in (("m", F.avg), ("v", F.var_samp)))).first()
    rated = sums
    for r in rules:
        m, v = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        weight = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else 1.0
        rated = rated.withColumn(f"rate_{r}", (F.col(f"f_{r}") + weight * m) / (F.col("n_docs") + weight))
    return rated.select("host", "n_docs", *(f"rate_{r}" for r in rules), (F.greatest(*(F.col(f"rate_{r}") for r in rules), F.lit(0.0)) > max_rate).alias("rejected"))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Measures and verdict of each row: k, host, the five counts, base_failed, kept.

    A document is kept if it passes the base rules and its host is not rejected. Rows that repeat a key are
    judged and returned each; an empty text fails the base rules.
    """
    tune(docs.sparkSession)
    found = verdicts(cut(measures(docs, key, text, host), "measures"), max_rate)
    return found.select("k", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def verdicts(measured: DataFrame, max_rate: float) -> DataFrame:
    """Measured rows with base_failed and kept."""
    hosts = small_or_plain(host_verdicts(measured, max_rate=max_rate).select(F.col("host").alias("own"), "rejected"))
    base = F.expr(" or ".join(f"({RULES[r]})" for r in BASE_RULES))
    out = measured.join(hosts, F.col("host").eqNullSafe(F.col("own")), "left").withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def passing(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of `docs`, as they are, that pass the base rules and whose host is not rejected.

    Each row is judged by itself, whatever its key, so repeated rows stay or go alike; a null host is a host
    of its own. The rows are written once with their measures, and only counts by host are shuffled.
    """
    tune(docs.sparkSession)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return verdicts(cut(measured_with(docs, whole, text, host), "measures"), max_rate).where("kept").select("k.*")
