"""Host-level quality rules, in DataFrame functions only.

Each document is measured against a few rules; failures are summed by host; each host's failure rates are shrunk towards a
beta prior fitted to all hosts; the host's verdicts go back to its documents. A host where a rule fails for half of the
documents or more is blocked. On other hosts a document is dropped for a rule's failure unless the rule practically never
fails there (a lone exception on an otherwise clean host is forgiven).

Defined results: a null text has no words and fails the base rules; a null host belongs to no host and gets the prior's
mean as its rates; repeated rows count and return once each; a document without id keeps its null id; columns other than
the three named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crategraph.shared import settle

WORD = r"[^\x20\x09-\x0D]+"
RULES = ("short", "repeats", "symbols", "duplicate_lines", "word_length")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, min_words: int = 10, repeat_percent: int = 20, symbol_share: float = 0.1, line_share: float = 0.3, word_length: tuple[float, float] = (2.0, 15.0)) -> DataFrame:
    """Counts and rule failures per document: one pass over the texts, no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("body"))
    df = df.withColumns({"words": F.regexp_extract_all("body", F.lit(WORD), F.lit(0)), "lines": F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD))})
    df = df.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("ids"),
    )
    # A window is known by the 64-bit hash of its words' hashes; only texts with an equal pair go through the sort below.
    at = lambda a, i: F.get(a, i.cast("int"))
    window = lambda i: F.xxhash64(*(at(F.col("ids"), i + k) for k in range(5)))
    df = df.withColumn("windows", F.when(F.size("ids") >= 5, F.transform(F.sequence(F.lit(0), F.size("ids") - 5), window)))
    doubled = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("sorted", F.when(doubled, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: at(F.col("sorted"), j)["h"].eqNullSafe(x["h"])
    df = df.withColumn("starts", F.array_sort(F.transform(F.filter("sorted", lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(False) | same(x, j + 1)), lambda x: x["i"])))
    step = lambda p, j: F.least(F.lit(5), F.coalesce(at(F.col("starts"), j + 1) - p, F.lit(5)))
    covered = F.aggregate(F.transform("starts", step), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("ids", "windows", "sorted", "starts")
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    fails = {
        "short": F.col("n_words") < min_words,
        "repeats": 100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"),
        "symbols": F.col("n_symbols") > symbol_share * F.col("n_words"),
        "duplicate_lines": F.col("n_dup_lines") > line_share * F.col("n_lines"),
        "word_length": (F.col("n_words") > 0) & ((mean < word_length[0]) | (mean > word_length[1])),
    }
    return df.withColumns({f"fails_{r}": fails[r] for r in RULES})


def host_rates(measured: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Shrunk failure rates per host, and the beta prior (a, b) of each rule.

    The prior's mean is the rate over all documents, its strength comes from the variance of the hosts' rates beyond what
    binomial noise explains. Without hosts the prior is (1, 1)."""
    hosts = settle(measured.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in RULES)))
    stats = [F.sum("docs").alias("docs"), F.avg(1 / F.col("docs")).alias("inverse")]
    for r in RULES:
        stats += [F.sum(r).alias(r), F.var_pop(F.col(r) / F.col("docs")).alias(f"var_{r}")]
    row = hosts.agg(*stats).first()
    prior: dict[str, tuple[float, float]] = {}
    for r in RULES:
        if not row["docs"]:
            prior[r] = (1.0, 1.0)
            continue
        mean = (row[r] + 0.5) / (row["docs"] + 1.0)
        between = max(row[f"var_{r}"] - mean * (1 - mean) * row["inverse"], 1e-9)
        strength = min(max(mean * (1 - mean) / between - 1.0, 1.0), 1e4)
        prior[r] = (mean * strength, (1 - mean) * strength)
    rate = lambda r: (F.col(r) + prior[r][0]) / (F.col("docs") + sum(prior[r]))
    return hosts.select("host", *(rate(r).alias(f"rate_{r}") for r in RULES)), prior


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, block_rate: float = 0.5, forgive_rate: float = 0.005, **rules) -> DataFrame:
    """Every document with its counts, ``base_failed``, its host's rates and ``kept``.

    The narrow measurements are settled in the shared folder, as the host totals and the final join both read them; the
    join is left to Spark, which broadcasts the hosts only if they are measured to be small, and else splits a hot host."""
    measured = settle(measure(docs, id_col, text_col, host_col, **rules))
    rates, prior = host_rates(measured)
    df = measured.join(rates, "host", "left")
    mean = {r: a / (a + b) for r, (a, b) in prior.items()}
    df = df.withColumns({f"rate_{r}": F.coalesce(F.col(f"rate_{r}"), F.lit(mean[r])) for r in RULES})
    base: Column = F.col("fails_short") | F.col("fails_repeats")
    blocked = F.greatest(*(F.col(f"rate_{r}") for r in RULES)) >= block_rate
    faults = F.lit(False)
    for r in RULES:
        faults = faults | (F.col(f"fails_{r}") & (F.col(f"rate_{r}") >= forgive_rate))
    verdict = F.when(F.col("host").isNotNull() & blocked, "blocked").when(faults, "rule").otherwise("fine")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select("doc_id", *counts, base.alias("base_failed"), (~base & (verdict == "fine")).alias("kept"), verdict.alias("host_verdict"), *(F.round(f"rate_{r}", 6).alias(f"rate_{r}") for r in RULES))
