"""Quality rules from the documents themselves and from how often their lines recur on a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.session import materialize

# The characters that separate words, as a regular expression class.
SPACE = r"\x20\x09-\x0D"
WINDOW = 8
# Frequent lines and hosts known to be that few are told to all executors; else the join shuffles.
BROADCAST_LINES = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def _windows(column: Column, size: int) -> Column:
    """64-bit hashes of all runs of `size` neighbouring words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(column) - size + 1), lambda i: F.xxhash64(F.slice(column, i, F.lit(size))))
    return F.when(F.size(column) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _repeated(df: DataFrame, column: str) -> DataFrame:
    """Add n_repeat_words: the words in runs of 8 that stand twice or more in the text.

    Only texts with such a run sort their runs; neighbours in that order tell which ones recur, and
    one pass in text order adds up what they cover.
    """
    df = df.withColumn("_runs", _windows(F.col(column), WINDOW))
    df = df.withColumn("_again", F.size(F.array_distinct("_runs")) < F.size("_runs"))
    pairs = F.array_sort(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.col("_again"), pairs)).drop("_runs")

    def recurs(pair: Column, at: Column) -> Column:
        before, after = (F.try_element_at("_sorted", at + shift) for shift in (0, 2))
        return (F.when(at > 0, before["h"] == pair["h"]).otherwise(False)) | F.coalesce(after["h"] == pair["h"], F.lit(False))

    df = df.withColumn("_marks", F.array_sort(F.transform(F.filter("_sorted", recurs), lambda p: p["i"]))).drop("_sorted")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "_marks",
        start,
        lambda acc, at: F.struct((at + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - at)).alias("n")),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_again", "_marks")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _has_word(line: Column) -> Column:
    return line.rlike(f"[^{SPACE}]")


def _line_hash(line: Column) -> Column:
    """Hash of a line with its white space collapsed, in lower case."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, f"[{SPACE}]+", " "))))


def rule_figures(docs: DataFrame, host: str = "source", whole: bool = False) -> DataFrame:
    """Per document its figures, `_host` and `_text`; with `whole` also its row as a struct `_row`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("_row")] if whole else []
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("_host"), text.alias("_text"), *row)
    df = df.withColumn("_words", words(F.col("_text")))
    df = df.withColumn("_kept", F.filter(_lines(F.col("_text")), _has_word))
    df = _repeated(df, "_words")
    return df.select(
        "doc_id",
        "_host",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(f"[{SPACE}]"))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_kept") - F.size(F.array_distinct("_kept"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "_text",
        *(["_row"] if whole else []),
    )


def frequent_lines(docs: DataFrame, host: str = "source", least_documents: int = 20, share: float = 0.1, most_documents: int | None = None) -> DataFrame:
    """(_of, _frequent): per host that has any, the hashes of the lines above the limits.

    A line is above them when more than max(least_documents, share * documents of the host) of the
    host's documents have it, or more than `most_documents`, where that is given.
    """
    rows = docs.select(F.col(host).cast("string").alias("_host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    sizes = rows.groupBy("_host").agg(F.count("*").alias("_documents"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), _has_word), _line_hash))
    counts = rows.select("_host", F.explode(hashes).alias("h")).groupBy("_host", "h").agg(F.count("*").alias("_with"))
    least = least_documents if most_documents is None else min(least_documents, most_documents)
    above = (F.col("_with") > least_documents) & (F.col("_with") > share * F.col("_documents"))
    if most_documents is not None:
        above = above | (F.col("_with") > most_documents)
    met = counts.filter(F.col("_with") > least).alias("c").join(sizes.alias("s"), F.col("c._host").eqNullSafe(F.col("s._host"))).filter(above)
    return met.groupBy(F.col("c._host").alias("_of")).agg(F.collect_list("h").alias("_frequent"))


def _judged(docs: DataFrame, host: str, least_words: int, most_repeated: int, least_documents: int, share: float, least_left: float, most_documents: int | None, whole: bool) -> DataFrame:
    """rule_figures with `_clean`, the text without the frequent lines, and all that is counted on it."""
    frequent = materialize(frequent_lines(docs, host, least_documents, share, most_documents), "frequent-lines")
    told = frequent.agg(F.sum(F.size("_frequent") + 1).alias("n")).first()["n"] or 0
    frequent = F.broadcast(frequent) if told <= BROADCAST_LINES else frequent
    df = rule_figures(docs, host, whole).join(frequent, F.col("_host").eqNullSafe(F.col("_of")), "left")
    # Which of the host's lines the text has is one set intersection; without any the text stays as it is.
    own = F.array_intersect(F.transform(F.filter(_lines(F.col("_text")), _has_word), _line_hash), "_frequent")
    df = df.withColumn("_own", F.when(F.col("_frequent").isNotNull(), own)).withColumn("_hit", F.coalesce(F.size("_own") > 0, F.lit(False)))
    left = F.filter(_lines(F.col("_text")), lambda line: ~(_has_word(line) & F.array_contains("_own", _line_hash(line))))
    df = df.withColumn("_left", F.when(F.col("_hit"), left)).withColumn("_clean", F.when(F.col("_hit"), F.array_join("_left", "\n")).otherwise(F.col("_text")))
    lines = F.when(F.col("_hit"), F.size(_lines(F.col("_text"))) - F.size("_left")).otherwise(0).cast("long")
    gone = F.when(F.col("_hit"), F.col("n_words") - F.size(words(F.col("_clean")))).otherwise(0).cast("long")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    df = df.withColumn("boilerplate_words", gone).withColumn("boilerplate_lines", lines).withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("boilerplate_words") >= least_left * F.col("n_words")))


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    least_words: int = 20,
    most_repeated: int = 30,
    least_documents: int = 20,
    share: float = 0.1,
    least_left: float = 0.3,
    most_documents: int | None = None,
) -> DataFrame:
    """Judge documents by base rules and by the frequency of their lines across the documents of a host.

    base_failed: fewer than `least_words` words, or more than `most_repeated` per cent of the words
    in repeated runs of 8. A line (white space collapsed, lower case) is boilerplate of its host when
    more than max(least_documents, share * documents of the host) of the host's documents have it;
    boilerplate lines are removed from the text, what is counted is the difference to the text that
    is left, and a document left with under `least_left` of its words is rejected. `clean` gives the
    texts. The limit is a share because the lines of a host's template are on most of its pages, while
    a sentence that is merely popular gains documents as the host grows; `most_documents` is an
    absolute limit on top, for hosts so large that even a small share is too many copies.

    Texts are read twice: for the lines of each host, then for the figures and the removal. Counting
    combines before it shuffles, so a line in a third of all documents is a handful of partial counts.
    A host has at most 1 / share times the lines of its average document as frequent lines; they are
    told to all executors if they have been counted to be few, so no text moves; beyond, the join has
    one row per host on its other side, which adaptive execution splits.

    A row is a document: repeated rows count each. Null text is empty (no words, base fails). Null
    hosts are one host of their own. Other columns are not looked at. An empty table gives no rows.
    """
    df = _judged(docs, host, least_words, most_repeated, least_documents, share, least_left, most_documents, False)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "boilerplate_words", "boilerplate_lines", "base_failed", "kept")


def clean(
    docs: DataFrame,
    host: str = "source",
    least_words: int = 20,
    most_repeated: int = 30,
    least_documents: int = 20,
    share: float = 0.1,
    least_left: float = 0.3,
    most_documents: int | None = None,
) -> DataFrame:
    """The documents `quality_rules` keeps, with all their columns, boilerplate lines removed from the text.

    Other lines stay as they are, blank ones too. n_chars, where there is one, follows a changed text.
    """
    df = _judged(docs, host, least_words, most_repeated, least_documents, share, least_left, most_documents, True).filter("kept")
    changed = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast("long")}
    new = lambda c: F.when(F.col("_hit"), changed[c]).otherwise(F.col("_row")[c]) if c in changed else F.col("_row")[c]
    return df.select(*(new(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
