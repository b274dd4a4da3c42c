"""Quality rules by host: failures per host, shrunk by an empirical beta prior, judged back per document.

1. Each text is measured and put to document rules.
2. Failures are counted per host and each host's rate is shrunk: with a Beta(a, b) prior fitted
   to all hosts by moments, a host with f failures in n documents has the rate
   (f + a) / (n + a + b).  A small host stays near the mean of all hosts, a large one speaks for itself.
3. The host's verdict goes back to its documents: ``trusted`` hosts lose only documents that fail
   a base rule, ``mixed`` hosts those that fail any rule, ``blocked`` hosts all.

DataFrame expressions only.  The verdict table has one row per host; a host that holds a third of all
documents is combined before the shuffle, and the join back is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritymill.llm.pii import let
from paritymill.llm.shared import stage

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOL_PERCENT = 5
EXCLAIM_PERCENT = 5
DUP_LINE_PERCENT = 40
TRUSTED_RATE, BLOCKED_RATE = 0.02, 0.5
_SPACE = r"\x20\x09-\x0D"
_SPACE_CHARS = " \t\n\x0b\f\r"
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_SPACE_CHARS))
    return F.when(F.length(bare) > 0, F.split(bare, f"[{_SPACE}]+")).otherwise(F.array().cast("array<string>"))


def _repeated_words(words: Column) -> Column:
    """Words inside eight-word windows that the text holds twice or more.

    Windows are compared by hash first; only a text with equal hashes sorts its windows, and
    neighbours count as equal when their words are.
    """

    def starts(state: Column) -> Column:
        count = F.size(state["windows"])
        ranked = F.sort_array(F.zip_with(state["windows"], F.sequence(F.lit(1), count), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            F.struct(ranked.alias("r"), state["words"].alias("words")),
            lambda s: F.flatten(
                F.zip_with(
                    F.slice(s["r"], F.lit(1), F.size(s["r"]) - 1),
                    F.slice(s["r"], F.lit(2), F.size(s["r"]) - 1),
                    lambda a, b: F.when(
                        (a["h"] == b["h"])
                        & (F.slice(s["words"], a["i"], F.lit(WINDOW)) == F.slice(s["words"], b["i"], F.lit(WINDOW))),
                        F.array(a["i"], b["i"]),
                    ).otherwise(F.array().cast("array<int>")),
                )
            ),
        )

    def covered(found: Column) -> Column:
        steps = let(
            F.sort_array(F.array_distinct(found)),
            lambda s: F.zip_with(
                s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))
            ),
        )
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    hashes = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))),
    )
    counted = let(
        F.struct(hashes.alias("windows"), words.alias("words")),
        lambda s: F.when(F.size(F.array_distinct(s["windows"])) == F.size(s["windows"]), F.lit(0)).otherwise(covered(starts(s))),
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(counted)


def text_facts(text: Column) -> Column:
    """Struct of FACTS of a text; null is empty.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    equal to an earlier line) and n_repeat_words, with exclamation marks and lines besides.
    """
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda s: s.rlike(f"[^{_SPACE}]"))

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w["words"]).cast("bigint").alias("n_words"),
            F.length(F.regexp_replace(body, f"[{_SPACE}]+", "")).cast("bigint").alias("word_chars"),
            (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
            (F.size(w["lines"]) - F.size(F.array_distinct(w["lines"]))).cast("bigint").alias("n_dup_lines"),
            _repeated_words(w["words"]).cast("bigint").alias("n_repeat_words"),
            (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).cast("bigint").alias("n_exclaims"),
            F.size(w["lines"]).cast("bigint").alias("n_lines"),
        )

    return let(F.struct(_words(body).alias("words"), lines.alias("lines")), measured)


def base_failed(facts: Column) -> Column:
    return (facts["n_words"] < MIN_WORDS) | (100 * facts["n_repeat_words"] > REPEAT_PERCENT * facts["n_words"])


def rule_failed(facts: Column) -> Column:
    """Any document rule, base rules included."""
    return (
        base_failed(facts)
        | (100 * facts["n_symbols"] > SYMBOL_PERCENT * facts["word_chars"])
        | (100 * facts["n_exclaims"] > EXCLAIM_PERCENT * facts["word_chars"])
        | (100 * facts["n_dup_lines"] > DUP_LINE_PERCENT * facts["n_lines"])
    )


def host_verdicts(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n_docs, n_failed, rate, verdict): rates shrunk by the prior of all hosts.

    The prior's mean is the failure rate of all documents.  Its weight a + b follows from
    the spread of the hosts' rates about that mean, each host counted by its size, and lies
    in [1, 1,000,000]; hosts that all behave alike give a heavy prior.
    """
    hosts = judged.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("bigint")).alias("n_failed")
    )
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    moments = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"))
    mean = F.col("f") / F.col("n")
    spread = F.greatest(F.col("ff") / F.col("n") - mean * mean, F.lit(1e-12))
    weight = F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0)), F.lit(1e6))
    prior = moments.where("n > 0").select(mean.alias("mean"), weight.alias("weight"))
    rate = (f + prior.select("mean").scalar() * prior.select("weight").scalar()) / (
        n + prior.select("weight").scalar()
    )
    verdict = (
        F.when(F.col("rate") < TRUSTED_RATE, F.lit("trusted"))
        .when(F.col("rate") > BLOCKED_RATE, F.lit("blocked"))
        .otherwise(F.lit("mixed"))
    )
    return hosts.withColumn("rate", rate).withColumn("verdict", verdict)


def judge(docs: DataFrame, keep: list[str], text: str = "text", host: str = "source") -> DataFrame:
    """Every document: struct ``row`` of the ``keep`` columns, ``facts``, base_failed, host_verdict, kept.

    ``kept`` is false for a base failure, else the method's verdict.  A null host is a host of
    its own, named ''.  Null, empty and blank texts have no words and fail the base rule.
    Repeated rows are judged alike and count as often as they come.  Columns outside ``keep``
    are dropped and names cannot clash, as kept columns stay inside ``row``.
    """
    measured = docs.select(
        F.struct(*keep).alias("row"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        text_facts(F.col(text)).alias("facts"),
    )
    judged = stage(
        measured.select("*", base_failed(F.col("facts")).alias("base_failed"), rule_failed(F.col("facts")).alias("failed")),
        "quality",
    )
    verdicts = host_verdicts(judged, "host", "failed").select("host", F.col("verdict").alias("host_verdict"))
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "blocked") & (~F.col("failed") | (F.col("host_verdict") == "trusted"))
    return judged.join(verdicts, "host").select("row", "facts", "base_failed", "host_verdict", kept.alias("kept"))
