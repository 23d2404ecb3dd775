"""Licences that documents name, by ordered signature rules, with DataFrame functions alone.

A document's words are put between single spaces. One regular expression finds which keywords it has; only rules whose
keywords are all there are tried. Each place where a rule's expression matches is a detection, an interval of words. A
detection inside another of a stronger kind, or of its own kind and longer or of an earlier rule, is suppressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeframe.llm.license_rules import KINDS, Rule, keyword_pattern, rules

DETECTION = "array<struct<start:int,end:int,level:int,number:int,label:string>>"


def normalised(text: Column) -> Column:
    """The words of a text, A-Z in lower case, each with a space before it, and one behind the last; "" without words. A word
    is of digits, letters and all that is not ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, rule: Column) -> Column:
    """Detections of a rule: what is between its matches tells at which word each starts."""
    hits = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    gaps = F.split(words, rule["pattern"], -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(DETECTION).alias("found"))

    def step(state: Column, hit: Column) -> Column:
        first = state["at"] + _spaces(hit["gap"])
        end = first + _spaces(hit["hit"])
        one = F.struct((first - 1).alias("start"), end.alias("end"), rule["level"].alias("level"), rule["number"].alias("number"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda s: s["found"])


def _unsuppressed(found: Column) -> Column:
    """Detections that no stronger one contains. In the order of their starts, the longest first, all that can contain one
    come before it, so the furthest end of each kind so far tells."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["level"].alias("level"), d["number"].alias("number"), d["label"].alias("label"))))
    state = F.struct(F.array_repeat(F.lit(0), len(KINDS)).alias("ends"), F.array().cast(DETECTION).alias("kept"))

    def step(s: Column, d: Column) -> Column:
        end = -d["back"]
        inside = F.exists(F.slice(s["ends"], F.lit(1), d["level"] + 1), lambda e: e >= end) & (d["level"] > 0)
        ends = F.transform(s["ends"], lambda e, i: F.when(i == d["level"], F.greatest(e, end)).otherwise(e))
        one = F.struct(d["start"].alias("start"), end.alias("end"), d["level"].alias("level"), d["number"].alias("number"), d["label"].alias("label"))
        return F.struct(ends.alias("ends"), F.when(inside, s["kept"]).otherwise(F.concat(s["kept"], F.array(one))).alias("kept"))

    return F.aggregate(ordered, state, step, lambda s: s["kept"])


def license_detections(docs: DataFrame, text_col: str = "text", of: list[Rule] | None = None) -> DataFrame:
    """docs with `n_words` and `detections`: of each the words from `start` up to `end` (words from 0), the rule's `level`
    (its place in KINDS), `number` and `label`, in the order of their starts. Base detections are never suppressed. Texts
    that are null or have no words have none. Places of one rule don't overlap. Nothing is dealt out or joined; a document's
    work grows with its length, and that of arrays with the square of its detections, at some bytes each."""
    of = of or rules()
    table = F.array(*(F.struct(F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, (k.rstrip("*") for k in r.keywords))).alias("keywords"), F.lit(r.level).alias("level"), F.lit(r.number).alias("number"), F.lit(r.label).alias("label")) for r in of))
    out = docs.withColumn("__words", normalised(F.col(text_col)))
    out = out.withColumn("__keywords", F.array_distinct(F.regexp_extract_all("__words", F.lit(keyword_pattern(of)), F.lit(0))))
    out = out.withColumn("__rules", F.when(F.size("__keywords") > 0, F.filter(table, lambda r: F.size(F.array_except(r["keywords"], F.col("__keywords"))) == 0)))
    none = F.array().cast(DETECTION)
    out = out.withColumn("__found", F.when(F.size("__rules") > 0, F.flatten(F.transform("__rules", lambda r: _places(F.col("__words"), r)))).otherwise(none))
    out = out.withColumn("detections", F.when(F.size("__found") > 0, _unsuppressed(F.col("__found"))).otherwise(none))
    return out.withColumn("n_words", F.greatest(_spaces(F.col("__words")) - 1, F.lit(0)).cast("long")).drop("__words", "__keywords", "__rules", "__found")


def document_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections) of each row of documents.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest start, null without
    any. Labels are distinct, sorted and joined by commas, "" without any. score: one less the product, over the labels, of
    one less how sure the surest detection of each is. Rows of null or repeated id are rows as others; other columns are not
    read; an empty table gives no rows."""
    rows = license_detections(docs.select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["level"] == 0)
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    sure = F.array(*map(F.lit, KINDS.values()))
    best = lambda label: F.array_max(F.transform(F.filter("detections", lambda d: d["label"] == label), lambda d: F.get(sure, d["level"])))
    doubt = F.aggregate(F.array_distinct(F.transform("detections", lambda d: d["label"])), F.lit(1.0), lambda s, label: s * (1 - best(label)))
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined("detections").alias("labels"),
        (1 - doubt).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
