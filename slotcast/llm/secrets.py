"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings.

Two first-order models over characters are trained from strings labelled by the fixed patterns:
what the patterns find is random, all other words of all documents are ordinary.  Long strings with
letters and digits that no pattern covers are secrets if the mean log-likelihood ratio per character
step favours the random model.  All of it is built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
#: A maximal run of 16 or more is what is left of the maximal runs after the length test.
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z][A-Za-z0-9_]{5,}"
#: Character classes of the models: digits, lower case, upper case, and the rest as one.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIZE = len(ALPHABET) + 1
#: Limit of the mean log ratio.
LIMIT = 0.5

SPAN = "array<struct<start:bigint,stop:bigint,rank:int,value:string>>"


def _found(text: Column, pattern: str, rank: int, least: int, group: int = 0) -> Column:
    """Spans in code points of all matches whose ``group`` has at least ``least`` characters."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)  # what stands before, between and after the matches
    rows = F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(gaps, 1, F.size(matches)).alias("g"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"CAST(array() AS {SPAN})").alias("out"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["g"])
        stop = start + F.length(row["m"])
        span = F.struct(
            start.cast("long").alias("start"), stop.cast("long").alias("stop"),
            F.lit(rank).alias("rank"), row["v"].alias("value"),
        )
        out = F.when(F.length(row["v"]) >= least, F.array_append(state["out"], span)).otherwise(state["out"])
        return F.struct(stop.cast("long").alias("at"), out.alias("out"))

    spans = F.aggregate(rows, empty, step, lambda state: state["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def base_spans(text: Column) -> Column:
    return F.concat(
        _found(text, ASSIGN, 0, 12, 2), _found(text, ACCESS, 1, 18), _found(text, HEX, 2, 16)
    )


def _class(char: Column) -> Column:
    """Place of a character in the alphabet, from 0; other characters share the last place."""
    at = F.instr(F.lit(ALPHABET), char)
    return F.when(at > 0, at - 1).otherwise(SIZE - 1)


def _steps(strings: DataFrame, label: str) -> DataFrame:
    """(label, a, b, n): how often character class b follows a in the strings ``s``.

    Equal strings are counted before they are shuffled and taken apart only once.
    """
    counted = strings.where(F.length("s") >= 2).groupBy("s").agg(F.count(F.lit(1)).alias("w"))
    chars = F.split("s", "")
    before, after = F.slice(chars, F.lit(1), F.length("s") - 1), F.slice(chars, F.lit(2), F.length("s") - 1)
    return (
        counted.select("w", F.explode(F.arrays_zip(before.alias("a"), after.alias("b"))).alias("x"))
        .select("w", _class(F.col("x.a")).alias("a"), _class(F.col("x.b")).alias("b"))
        .groupBy("a", "b").agg(F.sum("w").alias("n")).withColumn("label", F.lit(label))
    )


def train_models(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log ratio (random over ordinary) of each step between two character classes, row by row.

    Both kinds of strings come from all documents; without any, all ratios are 0.  The driver
    receives at most 2 * SIZE^2 sums.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    random = docs.select(F.explode(base_spans(text)).alias("x")).select(F.col("x.value").alias("s"))
    rest = F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), HEX, " ")
    words = docs.select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("s"))
    counts = {"random": [[1.0] * SIZE for _ in range(SIZE)], "ordinary": [[1.0] * SIZE for _ in range(SIZE)]}
    for row in _steps(random, "random").unionByName(_steps(words, "ordinary")).collect():
        counts[row.label][row.a][row.b] += row.n
    return [
        math.log(r / sum(rand) / (o / sum(ordi)))
        for rand, ordi in zip(counts["random"], counts["ordinary"])
        for r, o in zip(rand, ordi)
    ]


def log_ratio(string: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the steps of a string."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    # the characters are cut once: looking each up by its place would read the string again and again
    codes = F.transform(F.split(string, ""), _class)
    last = F.struct(F.element_at(codes, 1).alias("at"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        F.slice(codes, F.lit(2), F.length(string) - 1), last,
        lambda state, code: F.struct(
            code.alias("at"), (state["sum"] + F.get(table, state["at"] * SIZE + code)).alias("sum")
        ),
        lambda state: state["sum"],
    )
    return total / (F.length(string) - 1)


def scan(
    docs: DataFrame, ratios: list[float] | None = None, limit: float = LIMIT, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``base`` and ``added`` spans (start, stop, rank of the kind, value) of every text.

    Offsets are code points.  Added spans have a letter and a digit and overlap no base span.  Null
    and empty texts have none.
    """
    ratios = train_models(docs, text_col) if ratios is None else ratios
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col), base_spans(text).alias("base"), _found(text, CANDIDATE, 3, 20).alias("_more")
    )
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    kept = F.filter("_more", lambda x: mixed(x) & free(x))
    return found.select(
        id_col, "base", F.filter(kept, lambda x: log_ratio(x["value"], ratios) > limit).alias("added")
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["stop"])))
    kind = lambda rank: F.element_at(F.array(*[F.lit(k) for k in KINDS]), rank + 1)
    return F.array_join(
        F.transform(order, lambda x: F.concat_ws(":", kind(x["rank"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def count_kind(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["rank"] == rank)).cast("long")
