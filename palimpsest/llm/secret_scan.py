r"""Secret scan: keyed assignments, access keys, hex runs, and strings of high sliding entropy.

Each pattern is matched twice by built-in functions, once for the matches and once for the pieces
between them, and running sums of their lengths give code-point offsets, in n log n steps for n
matches. Which candidates touch a match is read off running maxima over the sorted spans. Candidate strings that no
pattern covers are measured by a window of 20 characters: the counts of the candidate's characters
are kept in an array, each step takes one character out and one in, and the sum of c * log2(c),
from which Shannon entropy follows, is updated by those two counts alone. A candidate is a secret
if the highest entropy of its windows reaches the threshold of its character class. ALLOWED forms
and strings without both a letter and a digit are left out; that never touches pattern matches.

Main path: DataFrame functions only.

Defined results: a null text counts as empty; repeated rows are scanned one by one; other columns
pass through, whatever their names, unless those are of the results (base, added, n_assign,
n_access, n_hex, base_sha256, spans), which then replace them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.arrays import running_max, running_sum
from palimpsest.llm.common import free_prefix, text_of

#: The base patterns; kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: Cheap tests that a text with a match passes, to spare most texts the positions.
HINTS = {"assign": r"(?i)password|passwd|secret|token|api_?key", "access": "AKIA", "hex": r"[0-9a-f]{24}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Class of a candidate's characters and the entropy in bits from which it is a secret.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 3.0),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 3.6),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7),
)
#: Strings that are long and varied but known not to be secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|x{6}|0123456789|abcdefgh",
    r"^[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]{1,4}$",
)
KINDS = ("assign", "access", "hex", "entropy")


SPAN = "struct<start:int,rank:int,end:int,word:string>"


def _matches(text: Column, pattern: str, group: int, least: int, rank: int, hint: str | None) -> Column:
    """Spans of all matches of a pattern whose group has at least `least` characters."""
    whole, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # The last piece has no match behind it; as a row without one it does no harm.
    parts = F.arrays_zip(
        whole.alias("m"), pieces.alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g")
    )
    length = lambda name: lambda x: F.coalesce(F.length(x[name]), F.lit(0))
    ends = running_sum(F.transform(parts, lambda x: length("p")(x) + length("m")(x)))
    spans = F.zip_with(
        parts,
        ends,
        lambda x, end: F.struct(
            (end - length("m")(x)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["m"].alias("word"),
            (F.coalesce(F.length(x["g"]), F.lit(-1)) >= least).alias("held"),
        ),
    )
    plain = lambda x: F.struct(*[x[n].alias(n) for n in ("start", "rank", "end", "word")])
    found = F.transform(F.filter(spans, lambda x: x["held"]), plain).cast(f"array<{SPAN}>")
    empty = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(hint), found).otherwise(empty) if hint else found


def _clear_of(spans: Column, base: Column) -> Column:
    """Those of `spans`, themselves without overlap, that touch none of `base`. All are sorted by
    start: a span is touched if a base span before it ends behind its start, or one behind it
    starts before its end."""
    far = (1 << 31) - 1
    both = lambda: F.sort_array(F.concat(base, spans))
    rank = len(BASE)
    ends = running_max(F.transform(both(), lambda s: F.when(s["rank"] < rank, s["end"]).otherwise(0)))
    # Starts are turned round (far - start), so that the least start behind is a maximum, too.
    behind = F.reverse(running_max(F.transform(F.reverse(both()), lambda s: F.when(s["rank"] < rank, F.lit(far) - s["start"]).otherwise(0))))
    marked = F.zip_with(
        F.zip_with(both(), ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))),
        behind,
        lambda x, b: F.struct(x["s"].alias("s"), ((x["s"]["rank"] == rank) & (x["e"] <= x["s"]["start"]) & (F.lit(far) - b >= x["s"]["end"])).alias("clear")),
    )
    clear = F.transform(F.filter(marked, lambda x: x["clear"]), lambda x: x["s"]).cast(f"array<{SPAN}>")
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(clear)


def _xlog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def max_window_entropy(word: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any window of a string; 0 for shorter strings.

    The state of the fold is (counts of the distinct characters, sum of c * log2 c, least sum)."""
    chars = lambda: F.split(word, "")
    alphabet = lambda: F.array_distinct(chars())
    first = F.transform(
        alphabet(),
        lambda a: F.size(F.filter(F.slice(chars(), 1, window), lambda c: c == a)),
    )
    start = F.aggregate(first, F.lit(0.0), lambda s, c: s + _xlog(c))
    steps = F.when(
        F.length(word) > window,
        F.zip_with(
            F.slice(chars(), F.lit(1), F.length(word) - window),
            F.slice(chars(), F.lit(window + 1), F.length(word) - window),
            lambda gone, come: F.struct(
                F.array_position(alphabet(), gone).cast("int").alias("gone"),
                F.array_position(alphabet(), come).cast("int").alias("come"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<gone:int,come:int>>"))

    def step(acc: Column, x: Column) -> Column:
        out = F.get(acc["counts"], x["gone"] - 1)
        into = F.get(acc["counts"], x["come"] - 1)
        total = F.when(x["gone"] == x["come"], acc["total"]).otherwise(
            acc["total"] - _xlog(out) + _xlog(out - 1) - _xlog(into) + _xlog(into + 1)
        )
        counts = F.transform(
            acc["counts"],
            lambda c, k: c - (k == x["gone"] - 1).cast("int") + (k == x["come"] - 1).cast("int"),
        )
        return F.struct(counts.alias("counts"), total.alias("total"), F.least(acc["least"], total).alias("least"))

    least = F.aggregate(
        steps,
        F.struct(first.alias("counts"), start.alias("total"), start.alias("least")),
        step,
        lambda acc: acc["least"],
    )
    return F.when(F.length(word) >= window, F.lit(math.log2(window)) - least / window).otherwise(F.lit(0.0))


def _secret(word: Column) -> Column:
    mixed = word.rlike("[A-Za-z]") & word.rlike("[0-9]")
    for allowed in ALLOWED:
        mixed = mixed & ~word.rlike(allowed)
    limit = F.coalesce(*[F.when(word.rlike(p), F.lit(bits)) for _, p, bits in CLASSES])
    return F.when(mixed, max_window_entropy(word) >= limit).otherwise(F.lit(False))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base` and `added` (arrays of spans: start, rank of the kind, end, word), n_assign,
    n_access, n_hex, base_sha256 and spans."""
    p = free_prefix(docs)
    whole, long = f"{p}text", f"{p}long"
    df = docs.withColumn(whole, text_of(text))
    found = {}
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        found[p + kind] = _matches(F.col(whole), pattern, group, least, rank, HINTS[kind])
    found[long] = _matches(F.col(whole), CANDIDATE, 0, WINDOW, len(BASE), r"[A-Za-z0-9+/_=-]{20}")
    # Reading the partition id keeps the optimizer from moving a later filter below these steps.
    df = df.withColumns(found).withColumn(
        "base", F.when(F.spark_partition_id() >= 0, F.concat(*[F.col(p + k) for k, *_ in BASE]))
    )
    df = df.withColumn("added", F.filter(_clear_of(F.col(long), F.col("base")), lambda s: _secret(s["word"])))
    made = {f"n_{kind}": F.size(p + kind).cast("long") for kind, *_ in BASE}
    made["base_sha256"] = F.sha2(_listed(F.col("base")), 256)
    made["spans"] = _listed(F.concat("base", "added"))
    return df.withColumns(made).drop(whole, long, *[p + k for k, *_ in BASE])
