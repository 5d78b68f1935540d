"""Line-first quality rules, in DataFrame functions only.

Every line is judged by rules on punctuation, navigation and boilerplate;
lines that fail are removed, and a document that loses too much of its text is
rejected.  Base measures of the whole text reject very short and very
repetitive documents before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of a document's characters, in lines with a word, that its failed lines may hold.
MAX_LOST = 0.3

# fixed values: phrases of notices that are not a document's own text
BOILERPLATE = (
    r"licensed under|is licensed|all rights reserved|copyright \(c\)|©|cookie policy|accept cookies|privacy policy|terms of (use|service)"
    r"|subscribe to|sign up for|click here|read more|javascript is disabled|powered by"
)
MAX_BOILERPLATE_WORDS = 40


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def count_of(text: Column, chars: str) -> Column:
    """Characters of a line or text that a regular-expression class holds."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", ""))


def line_failure(line: Column, words: Column) -> Column:
    """Name of the first rule that a line of so many words fails, or null; lines without a word fail none.

    navigation: separators or symbols on more than a quarter of the words.
    punctuation: five words or more without a sentence mark at any word's end,
    or doubled marks at the ends of more than half of ten words or more.
    shouting: ten words or more, with more than two capitals A-Z for each.
    boilerplate: a notice phrase in a line of at most 40 words.
    Counts are taken only of lines that hold what is counted.
    """
    marks = r"#*$%&|<>»›•→~^=\\_{}\[\]"
    doubled = F.size(F.split(F.concat(line, F.lit(" ")), r"[.!?]{2,}[\x20\x09-\x0D]")) - 1
    return (
        F.when(~line.rlike(r"[^\x20\x09-\x0D]"), None)
        .when(line.rlike(f"[{marks}]") & (count_of(line, marks) > 0.25 * words), "navigation")
        .when((words >= 5) & ~line.rlike(r"[.!?…。！？][\"'”’)\]]*(?:[\x20\x09-\x0D]|$)"), "punctuation")
        .when((words >= 10) & line.rlike(r"[.!?]{2}") & (doubled > 0.5 * words), "punctuation")
        .when((words >= 10) & line.rlike("[A-Z]{3}") & (count_of(line, "A-Z") > 2 * words), "shouting")
        .when((words <= MAX_BOILERPLATE_WORDS) & F.lower(line).rlike(BOILERPLATE), "boilerplate")
    )


def window_hashes(words: Column) -> Column:
    """Hashes of the windows of three words, in order."""
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3))
    return F.coalesce(F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))), F.array().cast("array<bigint>"))


def with_covered_words(frame: DataFrame, hashes: str, out: str) -> DataFrame:
    """Adds ``out``: words in windows that occur twice or more.  Each step is a column, so none is computed per element."""
    size = F.size(hashes)
    rest = [c for c in frame.columns if c != hashes]
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = frame.select(*rest, F.when(F.size(F.array_distinct(hashes)) < size, F.sort_array(placed)).alias("__s"))
    # sorted by hash, a window that occurs twice stands next to an equal one
    beside = lambda x, i: F.coalesce(x["h"] == F.get("__s", i)["h"], F.lit(False))
    twice = F.filter("__s", lambda x, i: beside(x, i - 1) | beside(x, i + 1))
    d = d.select(*rest, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__twice"))
    starts = F.col("__twice")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    total = F.aggregate(starts, zero, lambda acc, x: F.struct((acc["n"] + x + 3 - F.greatest(acc["end"], x)).alias("n"), (x + 3).alias("end")))
    return d.select(*rest, F.when(F.col("__twice").isNotNull(), total["n"]).otherwise(F.lit(0).cast("long")).alias(out))


def judge(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with the measures, the verdict and the cleaned text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_share, line_failures (map of rule to lines), clean_text, kept.  A null text
    counts as empty: it has no words and fails the base rules.  Columns of the input
    with these names are replaced; repeated rows are judged alike.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "line_failures", "clean_text", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    own = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own") if keep else F.struct(F.lit(1).alias("one")).alias("own")
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(own, text.alias("t"), words_of(text).alias("ws"), F.split(text, "\n").alias("lines"))
    second = first.select(
        "own", "t", F.size("ws").cast("long").alias("n_words"), window_hashes(F.col("ws")).alias("windows"),
        F.transform("lines", lambda x: F.struct(x.alias("line"), F.size(F.split(x, " ")).alias("n"))).alias("lines"),
        F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("worded"),
    )
    second = with_covered_words(second, "windows", "n_repeat_words")
    third = second.select(
        "own", "n_words", "n_repeat_words",
        F.char_length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.when(F.col("t").rlike(f"[{SYMBOLS}]"), count_of(F.col("t"), SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(x["line"].alias("line"), line_failure(x["line"], x["n"]).alias("rule"))).alias("lines"),
    ).withColumn("failed", F.filter("lines", lambda x: x["rule"].isNotNull()))
    size = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + F.char_length(x["line"]))
    judged = third.select(
        "own", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (size(F.col("failed")) / F.greatest(size(F.col("lines")), F.lit(1).cast("long"))).alias("lost_share"),
        F.map_from_entries(F.transform(
            F.array_distinct(F.transform("failed", lambda x: x["rule"])),
            lambda r: F.struct(r.alias("key"), F.size(F.filter("failed", lambda x: x["rule"] == r)).alias("value")),
        )).alias("line_failures"),
        F.array_join(F.transform(F.filter("lines", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    kept = ~F.col("base_failed") & (F.col("lost_share") <= max_lost)
    return judged.withColumn("kept", kept).select(*([F.col(f"own.`{c}`") for c in keep]), *added)
