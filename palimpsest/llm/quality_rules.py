"""Quality rules: a threshold table compiled into one projection of built-in functions.

`measures` adds one column for each measure of a text and `verdict` compiles RULES, a table of
(name, numerator, denominator, low, high), into Column expressions. No user function takes part
and nothing is shuffled.

Defined results: a null text counts as empty; a text without words has zero in all measures and
is rejected; repeated rows are judged one by one; other columns pass through unless their names
are those of the measures, which then replace them. Column
names that begin with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, free_prefix, text_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be this by an from at or not have "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch "
    "le la les de des et un une du en que qui dans est pour par sur au pas ce il elle "
    "el los las del y por con una su para se lo no al como más"
).split()

#: name, numerator, denominator ("" for the numerator alone), least and greatest value allowed.
RULES: tuple[tuple[str, str, str, float | None, float | None], ...] = (
    ("word_length", "word_chars", "n_words", 2.0, 14.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.10),
    ("bangs_per_word", "n_bangs", "n_words", None, 0.30),
    ("stop_words", "n_stop_words", "n_words", 0.03, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.50),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 0.90),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.30),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _count_of(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each whole text, as long columns.

    n_repeat_words: three-word windows are hashed; where a window's hash occurs again in the
    text, sorting (hash, position) pairs brings its places together, and the words covered are
    the union of the three-word intervals from those places."""
    p = free_prefix(docs)
    df = docs.withColumn(f"{p}text", text_of(text))
    df = df.withColumn(f"{p}words", F.array_remove(F.split(f"{p}text", SPACE), ""))
    df = df.withColumn(f"{p}n", F.size(f"{p}words"))
    df = df.withColumn(
        f"{p}grams",
        F.when(
            F.col(f"{p}n") >= 4,
            F.transform(
                F.sequence(F.lit(1), F.col(f"{p}n") - 2),
                lambda i: F.xxhash64(F.get(f"{p}words", i - 1), F.get(f"{p}words", i), F.get(f"{p}words", i + 1)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        f"{p}sorted",
        F.when(
            F.size(F.array_distinct(f"{p}grams")) < F.size(f"{p}grams"),
            F.sort_array(F.transform(f"{p}grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    df = df.withColumn(
        f"{p}starts",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        f"{p}sorted",
                        lambda s, k: F.struct(
                            s["i"].alias("i"),
                            (
                                F.coalesce(s["h"] == F.get(f"{p}sorted", k - 1)["h"], F.lit(False))
                                | F.coalesce(s["h"] == F.get(f"{p}sorted", k + 1)["h"], F.lit(False))
                            ).alias("twice"),
                        ),
                    ),
                    lambda s: s["twice"],
                ),
                lambda s: s["i"],
            )
        ),
    )
    repeat = F.when(
        F.col(f"{p}starts").isNotNull(),
        F.aggregate(
            F.transform(f"{p}starts", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(f"{p}starts", k + 1) - i, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        ),
    ).otherwise(F.lit(0).cast("long"))
    lines = F.filter(F.split(f"{p}text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(f"{p}lines", lines)
    stops = list(dict.fromkeys(STOP_WORDS))
    found = {
        # Reading the partition id keeps the optimizer from moving a later filter on a measure
        # below these projections, where it would compute every measure again for each use.
        "n_words": F.when(F.spark_partition_id() >= 0, F.col(f"{p}n").cast("long")),
        "word_chars": F.length(F.array_join(f"{p}words", "")).cast("long"),
        "n_symbols": _count_of(F.col(f"{p}text"), r"#*$%&|<>"),
        "n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
        "n_repeat_words": repeat,
        "n_lines": F.size(f"{p}lines").cast("long"),
        "n_bangs": _count_of(F.col(f"{p}text"), "!"),
        "n_stop_words": F.size(F.filter(f"{p}words", lambda w: F.lower(w).isin(*stops))).cast("long"),
        "n_bullet_lines": F.size(F.filter(f"{p}lines", lambda x: x.rlike(r"^[\x20\t]*[-*•]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(f"{p}lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\t\r]*$"))).cast("long"),
    }
    return df.withColumns(found).drop(f"{p}text", f"{p}words", f"{p}n", f"{p}grams", f"{p}sorted", f"{p}starts", f"{p}lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression: true if every rule holds."""
    holds = F.lit(True)
    for _, top, below, low, high in rules:
        a, b = F.col(top), F.greatest(F.col(below), F.lit(1)) if below else F.lit(1)
        if low is not None:
            holds = holds & (a >= b * F.lit(float(low)))
        if high is not None:
            holds = holds & (a <= b * F.lit(float(high)))
    return holds


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with the measures, `base_failed` and `kept`."""
    df = measures(docs, text)
    return df.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)})
