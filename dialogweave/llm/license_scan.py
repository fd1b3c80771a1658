"""License scan by ordered signature rules, in DataFrame expressions only.

Texts that cannot match (no gate word) only have their words counted. The others are
normalized to lower-case words, every rule whose keyword occurs is matched, and detections that
lie within a detection of higher priority are suppressed (of equal priority: within a longer
one, or at the same place after an earlier rule). All of this happens within a row: no
shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogweave.llm.license_rules import BASE, GATE, rules

_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = "(?= )"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Element i: all values up to i merged. Doubles the reach of every element in each step, so
    n values take n log n merges and no growing array is copied."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1))
    steps = F.transform(F.coalesce(steps, F.array().cast("array<int>")), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.reduce(
        steps,
        values,
        lambda reached, step: F.transform(reached, lambda x, i: F.when(i >= step, merge(x, F.get(reached, i - step))).otherwise(x)),
    )


def _places(norm: Column, pattern: Column) -> Column:
    """Word intervals [start, end) of the matches: every word of ``norm`` follows a space, so
    spaces in what lies between matches and in matches count words."""
    between = F.split(norm, pattern, -1)
    found = F.transform(F.regexp_extract_all(norm, pattern, F.lit(0)), _spaces)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: _spaces(a) + b)
    ends = _running(steps, lambda x, y: x + y)
    return F.zip_with(ends, found, lambda end, words: F.struct((end - words).alias("start"), end.alias("end")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) per
    row of docs.

    n_base counts all places of the base phrases, first_word and last_word are their least and
    greatest start (NULL without any). labels are the distinct base labels and those of the
    detections that are not suppressed, sorted and joined by commas. score is the highest
    priority of a detection in hundredths, 0 without any. NULL and empty texts have no words
    and no labels. Repeated rows give repeated results; other columns are not read.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    known = rules()
    table = F.array(*(
        F.struct(
            F.lit(i).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"),
            F.lit(r.keyword).alias("keyword"), F.lit(f" {r.pattern}{_END}").alias("pattern"),
        )
        for i, r in enumerate(known)
    ))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lowered = F.translate(raw, _UPPER, _LOWER)
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, _GAP, " ")), F.lit(" "))
    rows = rows.select("id", F.regexp_count(raw, F.lit(_WORD)).cast("long").alias("n_words"), F.when(raw.rlike(GATE), norm).alias("norm"))
    phrases = F.array(*(F.struct(F.lit(f" {p}{_END}").alias("pattern"), F.lit(label).alias("label"), F.lit(p).alias("phrase")) for p, label in BASE))
    present = F.filter(phrases, lambda p: F.contains(F.col("norm"), F.concat(F.lit(" "), p["phrase"], F.lit(" "))))
    placed = F.transform(present, lambda p: F.struct(p["label"].alias("label"), _places(F.col("norm"), p["pattern"]).alias("places")))
    gated = F.filter(table, lambda r: F.contains(F.col("norm"), r["keyword"]))
    gated = F.filter(gated, lambda r: F.rlike(F.col("norm"), r["pattern"]))
    detected = F.flatten(F.transform(gated, lambda r: F.transform(
        _places(F.col("norm"), r["pattern"]),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")),
    )))
    rows = rows.withColumns({"base": F.when(F.col("norm").isNotNull(), placed), "all": F.when(F.col("norm").isNotNull(), detected)})
    rows = rows.withColumn("all", F.array_sort(F.transform("all", _placed)))
    rows = rows.withColumn("ends", F.transform(
        F.array_distinct(F.col("all")["outranked"]),
        lambda p: F.struct(p.alias("outranked"), _running(
            F.transform("all", lambda d: F.when(d["outranked"] <= p, d["end"]).otherwise(-1)), F.greatest
        ).alias("before")),
    ))
    kept = F.flatten(F.transform("ends", lambda e: F.filter("all", lambda d, i: (d["outranked"] == e["outranked"]) & (
        (i == 0) | (F.get(e["before"], i - 1) < d["end"])
    ))))
    named = F.transform(F.array_sort(kept), lambda d: F.struct(
        d["start"].alias("start"), d["end"].alias("end"), (-d["outranked"]).alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")
    ))
    rows = rows.withColumn("detections", F.coalesce(named, F.array().cast(_DETECTIONS)))
    starts = F.flatten(F.transform(F.coalesce("base", F.array().cast("array<struct<label:string,places:array<struct<start:int,end:int>>>>")), lambda b: b["places"]["start"]))
    rows = rows.withColumn("starts", starts)
    own = F.coalesce(F.col("base")["label"], F.array().cast("array<string>"))
    labels = F.array_sort(F.array_distinct(F.concat(own, F.col("detections")["label"])))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.col("detections")["priority"]) / 100.0, F.lit(0.0)).alias("score"),
        "detections",
    )


_DETECTIONS = "array<struct<start:int,end:int,priority:int,rule:int,label:string>>"


def _placed(d: Column) -> Column:
    """A detection so that those which contain another, and win where they stand alike, sort
    before it: by start, longest first, then by priority and rule."""
    return F.struct(
        d["start"].alias("start"), (d["start"] - d["end"]).alias("shortness"), (-d["priority"]).alias("outranked"), d["rule"].alias("rule"),
        d["end"].alias("end"), d["label"].alias("label"),
    )
