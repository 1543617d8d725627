"""License scans by ordered signature rules; DataFrame functions only.

A gate over the lower-case text comes before everything else. Behind it, base phrases are matched on the text itself, and the
signature rules on a normalised form, each only if one of its keywords is among the text's words, and only at words that
can open a match. Detections are intervals; one that lies inside another of higher priority, or of equal priority and
greater length, is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.license_rules import rules

#: Characters of a word, upper case included, and those between words.
INSIDE = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Every base phrase and every rule's match holds one of these in lower case: as it is, or a word and an expression behind it.
HOLDS = ("licen", "spdx", "copyright", "redistribut", "creativecommons", "mozilla")
APART = "[^0-9a-z]+"
HOLDS_BEHIND = {"public": f"public{APART}domain", "cc": f"cc{APART}by", "hereby": f"is{APART}hereby{APART}granted", "altered": f"altered{APART}source", "under": f"(?:ed|available)(?:{APART}by{APART}us)?{APART}under"}
BASE_CONFIDENCE = 0.95


def phrase(words: str) -> str:
    """An expression for places where the words stand one after another; letters A to Z match either case."""
    return f"(?i)(?<=^|{BETWEEN})" + f"{BETWEEN}+".join(words.split()) + f"(?={BETWEEN}|\\z)"


def gate(text: Column) -> Column:
    """Whether a text can hold a base phrase or a rule's match: searches for fixed words, and expressions only behind those."""
    low = F.lower(text)
    either = F.lit(False)
    for held in HOLDS:
        either = either | F.contains(low, F.lit(held))
    for held, expression in HOLDS_BEHIND.items():
        either = either | (F.contains(low, F.lit(held)) & low.rlike(expression))
    return either


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body's own lambdas read it."""
    return F.transform(F.array(value), body)[0]


def with_rules(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__gate`` and, behind it, ``__words`` and ``__rules``: the normalised ``text``'s words, and the rules that have a keyword among them."""
    when = lambda value: F.when(F.col("__gate"), value)
    table = rules()
    # One constant instead of some thousand: the planner folds it once.
    kind = "array<struct<order int, priority int, label string, keywords array<string>, expression string, confidence double, openings array<string>, span int>>"
    literal = F.from_json(F.lit(json.dumps([r.as_row() for r in table])), kind)
    keywords = F.split(F.lit(" ".join(sorted({k for r in table for k in r.keywords}))), " ")
    rows = rows.withColumn("__gate", gate(F.col("text")))
    rows = rows.withColumn("__words", when(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^0-9a-z]+", " ")), " ")))
    present = F.array_intersect("__words", keywords)
    return rows.withColumn("__rules", when(let(present, lambda p: F.filter(literal, lambda r: F.arrays_overlap(p, r["keywords"])))))


def detections(words: Column, rules_: Column) -> Column:
    """What the rules find in the normalised words, contained ones suppressed: structs of a, b (words from a to before b), priority, order, label, confidence.

    A rule is tried at each word that can open it, on the next words, as many as a match can have. Starts are
    different words, so what can contain a detection lies among as many starts before it; nothing is
    compared with all detections, and the work grows with the text's length.
    """
    widest = F.array_max(F.transform(rules_, lambda r: r["span"]))
    opening = F.array_distinct(F.flatten(F.transform(rules_, lambda r: r["openings"])))

    def starts(w: Column, width: Column, some: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda s: F.array_contains(some, s["w"]))
        return F.transform(at, lambda s: F.struct(s["w"].alias("w"), s["i"].alias("i"), F.concat(F.array_join(F.slice(w, s["i"] + 1, width), " "), F.lit(" ")).alias("t")))

    def length(s: Column, r: Column) -> Column:
        n = let(F.regexp_substr(s["t"], r["expression"]), lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
        return F.coalesce(F.when(F.array_contains(r["openings"], s["w"]), n), F.lit(0))

    def of_start(s: Column, j: Column, lengths: Column) -> Column:
        one = lambda r, k: F.struct(s["i"].alias("a"), (s["i"] + F.get(F.get(lengths, k), j)).alias("b"), r["priority"].alias("priority"), r["order"].alias("order"), r["label"].alias("label"), r["confidence"].alias("confidence"))
        return F.filter(F.transform(rules_, one), lambda d: d["b"] > d["a"])

    def stronger(e: Column, d: Column) -> Column:
        wide, narrow = e["b"] - e["a"], d["b"] - d["a"]
        return (e["a"] <= d["a"]) & (e["b"] >= d["b"]) & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & ((wide > narrow) | ((wide == narrow) & (e["order"] < d["order"])))))

    def kept(found: Column, width: Column) -> Column:
        behind = lambda j: F.slice(found, F.greatest(F.lit(1), j + 2 - width), F.least(j + 1, width))
        return F.flatten(F.transform(found, lambda own, j: F.filter(own, lambda d: ~F.exists(behind(j), lambda many: F.exists(many, lambda e: stronger(e, d))))))

    def of(w: Column, width: Column, begun: Column) -> Column:
        lengths = F.transform(rules_, lambda r: F.transform(begun, lambda s: length(s, r)))
        found = let(lengths, lambda m: F.transform(begun, lambda s, j: of_start(s, j, m)))
        return let(found, lambda f: kept(f, width))

    return let(words, lambda w: let(widest, lambda width: let(let(opening, lambda some: starts(w, width, some)), lambda begun: of(w, width, begun))))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)`` for each row.

    ``detections`` are the rules' intervals, in words of the normalised text, that are left after suppression;
    ``score`` is the highest confidence among them and the base phrases, 0 without any. A null text is empty:
    no words, empty labels, null positions. Repeated rows are returned as often as given, whole texts are
    read, other columns are ignored, and an empty table gives an empty result.
    """
    word = F.lit(f"{INSIDE}++")
    either = "|".join(f"(?:{phrase(p)})" for p in BASE.values()).replace("(?i)", "")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_rules(rows)
    when = lambda value, other=None: F.when(F.col("__gate"), value).otherwise(other)
    counts = {label: F.regexp_count("text", F.lit(phrase(p))) for label, p in BASE.items()}
    rows = rows.withColumns({f"__n_{i}": when(c, F.lit(0)) for i, c in enumerate(counts.values())})
    n_base = sum((F.col(f"__n_{i}") for i in range(1, len(BASE))), F.col("__n_0"))
    place = lambda lazy: F.when(F.col("n_base") > 0, F.regexp_count(F.regexp_extract("text", f"(?is)\\A(.*{lazy})(?:{either})", 1), word))
    base_labels = F.array_compact(F.array(*[F.when(F.col(f"__n_{i}") > 0, F.lit(label)) for i, label in enumerate(BASE)]))

    rows = rows.withColumns({"n_words": F.regexp_count("text", word).cast("long"), "n_base": n_base.cast("long"), "base": base_labels})
    rows = rows.withColumns({"first_word": place("?").cast("long"), "last_word": place("").cast("long")})
    found = F.when(F.col("__gate") & (F.size("__rules") > 0), let(F.col("__rules"), lambda r: detections(F.col("__words"), r)))
    rows = rows.withColumn("detections", F.coalesce(found, F.array().cast("array<struct<a int, b int, priority int, order int, label string, confidence double>>")))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda d: d["label"]))))
    score = F.greatest(F.when(F.col("n_base") > 0, BASE_CONFIDENCE).otherwise(0.0), F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"), "detections")
