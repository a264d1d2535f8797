"""Quality rules by host: rule failures are counted per host, rates shrunk by an empirical beta prior, and host verdicts joined back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LIMIT = 0.5  # shrunk rate of failing documents beyond which a host loses all of its documents
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: What a document can fail, over its measures; the first two fail it whatever its host is.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("few_words", "repeats")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def repeated(w: Column) -> Column:
    """Words of the array ``w`` that lie in a window of three words found twice or more in it.

    Windows are sorted with their places, so equal ones are neighbours; the places are then sorted again, and each covers three words
    less what the next one covers too. Whole texts, n log n steps, no hashes.
    """
    n = F.greatest(F.size(w) - 2, F.lit(0))
    windows = F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"), F.sequence(F.lit(0), n - 1).alias("at"))

    def places(s: Column) -> Column:
        after = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(y.isNotNull() & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), True).otherwise(False))
        return let(after, lambda same: F.zip_with(s, F.zip_with(same, F.concat(F.array(F.lit(False)), same), lambda x, y: x | y), lambda x, y: F.when(y, x["at"])))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    hits = let(F.sort_array(windows), places)
    return F.when(F.size(w) < 4, 0).otherwise(let(F.sort_array(F.filter(hits, lambda x: x.isNotNull())), covered))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, MEASURES) of every whole text; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    word = lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated(w).cast("long").alias("r"))
    line = lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("r"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(without(x, BLANKS)) > 0)
    found = docs.select(
        F.col(id_col), F.col(host_col).alias("host"), F.length(without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), word).alias("w"), let(lines, line).alias("l"),
    )
    return found.select(id_col, "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.r").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"))


def beta_prior(hosts: float, docs: float, squares: float, failed: float, weighted: float) -> tuple[float, float] | None:
    """(a, b) of the beta distribution that the hosts' rates are drawn from, by moments; None where hosts do not differ beyond chance.

    ``squares`` sums the hosts' squared sizes, ``failed`` their failures, ``weighted`` squared failures over size. The spread of
    the rates beyond that of coin throws gives the correlation within a host, 1 / (a + b + 1).
    """
    if not docs or not 0 < failed < docs:
        return None
    mean = failed / docs
    chance = mean * (1 - mean)
    room = chance * (docs - squares / docs - (hosts - 1))
    within = (weighted - docs * mean * mean - chance * (hosts - 1)) / room if room > 0 else 0.0
    if within <= 0:
        return None
    strength = max(1 / min(within, 1.0) - 1, 1e-6)
    return mean * strength, (1 - mean) * strength


def host_rates(measured: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(host, n, one shrunk rate per rule) of rows (host, measures); documents without a host count nowhere."""
    fails = {r: F.expr(f"cast(sum(cast(({c}) as int)) as double)").alias(f"f_{r}") for r, c in rules.items()}
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), *fails.values())
    sums = [F.sum(F.col(f"f_{r}") if k == 0 else F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")) for r in rules for k in (0, 1)]
    row = hosts.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), *sums).first()  # one row of sums
    head, rest = [float(x or 0) for x in row[:3]], [float(x or 0) for x in row[3:]]
    rates = []
    for i, r in enumerate(rules):
        prior = beta_prior(*head, rest[2 * i], rest[2 * i + 1])
        pooled = F.lit(rest[2 * i] / head[1] if head[1] else 0.0)
        rates.append((pooled if prior is None else (F.col(f"f_{r}") + prior[0]) / (F.col("n") + prior[0] + prior[1])).alias(r))
    return hosts.select("host", F.col("n").cast("long").alias("n"), *rates)


def judge(docs: DataFrame, limit: float = LIMIT, rules: dict[str, str] = RULES, base: tuple[str, ...] = BASE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, the measures, base_failed, host_failed and kept.

    A document is kept if it fails no rule of ``base`` and its host is not rejected; a host is rejected if the shrunk rate of any rule is
    beyond ``limit``, so that few documents alone never condemn one. Where hosts do not differ beyond chance, each has the
    pooled rate. A null text is empty, a null host has no verdict, repeated rows each count and are returned each, an empty
    table gives no rows, further columns are ignored. SQL functions only; measures are written once, so texts are read once.
    """
    measured = cut(measures(docs, id_col, text_col, host_col))
    over = [F.col(r) > limit for r in rules]
    verdict = host_rates(measured, rules).select("host", F.greatest(*over, F.lit(False)).alias("host_failed"))
    failed = F.expr(" or ".join(f"({rules[r]})" for r in base))
    out = measured.withColumn("base_failed", failed).join(verdict, "host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return out.select(id_col, *MEASURES, "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
