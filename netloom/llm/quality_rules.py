"""Quality rules as a short-circuit cascade.

The base numbers of a text are computed for every document. The further rules are a cascade:
on a small sample each rule's cost (seconds) and selectivity (share it rejects) are measured,
the rules are ordered by rejection per cost, and one CASE expression tries them in this order
and stops at the first that rejects. The verdict is the same in every order.

Built-in functions only; no row leaves its partition, nothing is shuffled. Repeated word
windows are found inside the row: hashes of the windows are sorted with their places, and the
places of repeated ones are swept once.

Defined cases: a null text has no words. Repeated rows and null ids are judged each; an empty table gives no rows. Texts of any length are read whole. Extra columns are
ignored.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written

SAMPLE = 1000
MIN_WORDS, MAX_REPEATED = 50, 50
_WORD = r"[^\x20\x09-\x0D]+"


def base_numbers(docs: DataFrame) -> DataFrame:
    """doc_id, text, words and the base numbers."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn(
        "words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    )
    # Columns that a lambda reads must be columns of their own, or they are computed per element.
    rows = rows.withColumn(
        "_windows",
        F.when(
            F.size("words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
            ),
        ),
    )
    rows = rows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    again = F.filter("_sorted", lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"]) | (x["h"] == F.get("_sorted", i + 1)["h"]))
    swept = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(0).alias("covered"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["covered"] + F.least(F.lit(3), i - a["last"])).alias("covered"), i.alias("last")),
        lambda a: a["covered"],
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(_WORD))
    return rows.withColumn("_lines", lines).select(
        "doc_id", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(swept, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def _chars(pattern: str) -> Column:
    """Characters of the text outside of what ``pattern`` matches."""
    return F.length(F.regexp_replace("text", pattern, ""))


def rules() -> dict[str, Column]:
    """What each rule rejects; none is ever NULL."""
    n = F.col("n_words")
    return {
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "exclamation": 10 * _chars(r"[^!]+") > n,
        "capitals": 100 * _chars(r"[^A-Z]+") > 30 * _chars(r"[^A-Za-z]+"),
        "wordless": 100 * F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))) < 70 * n,
    }


def measured_order(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """The rules' names, the best rejection per second first; measured on about ``sample`` rows.

    They are chosen by a hash of the id, and only their numbers are computed for it.
    """
    share = min(1.0, 2.0 * sample / max(docs.count(), 1))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))
    few = written(base_numbers(docs.where(chosen).limit(sample)).drop("doc_id"), "rule-sample")

    def seconds(of: Column) -> tuple[float, int]:
        taken = []
        for _ in range(2):
            begin = time.perf_counter()
            rejected = few.agg(F.count_if(of)).first()[0]
            taken.append(time.perf_counter() - begin)
        return min(taken), rejected

    nothing, _ = seconds(F.length("text") < 0)
    worth = {}
    for name, rule in rules().items():
        taken, rejected = seconds(rule)
        worth[name] = rejected / max(taken - nothing, 1e-4)
    return sorted(worth, key=lambda name: (-worth[name], name))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, the base numbers, base_failed, kept, rejected_by (the first rule tried that rejects)."""
    numbers = base_numbers(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    every = rules()
    verdict = F.when(failed, "base")
    for name in measured_order(docs):
        verdict = verdict.when(every[name], name)
    return numbers.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), verdict.alias("rejected_by"),
    ).withColumn("kept", F.col("rejected_by").isNull())
