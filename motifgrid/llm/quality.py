"""Operator 3: quality rules, line first, in DataFrame expressions only.

Each line that holds a word is judged alone: navigation (many separators for its words), symbols,
shouting (runs of marks), stutter (words equal
to the one before), boilerplate (stock phrases and navigation signs are half of the line's words or more) and punctuation (a short line without an end mark). Failing lines
are removed. Stock phrases are whole words of the lower-cased line, without its marks; each word counts once. A document is rejected if the removed lines held more than MOST_LOST of its characters in
words, or if it fails the base rules (fewer than 20 words, or over 30 % of the words in 8-word windows
that occur twice or more).

Windows are compared by 64-bit hashes of their eight words, in arrays of the row itself: there is no
shuffle, and a document is the largest unit of work. Sorting is done only where a window repeats.

Defined results: a null text has no words or lines and fails the base rules; equal rows get equal
results; other columns stay as they are in `cleaned`, and are left out in `measured`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space between words, symbols, end marks and stock phrases.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
STUTTER = r"(?<![^\x20])([^\x20\x09-\x0D]++)\x20\1(?![^\x20\x09-\x0D])"
ENDS = r"""[.!?…:;"'”’)\]][\x20\x09-\x0D]*$"""
PHRASES = (
    "subscribe to our newsletter", "this work is licensed under the", "this site uses cookies", "licensed under cc by", "licensed under the", "released under the", "accept all cookies",
    "gnu general public license", "all rights reserved", "terms and conditions", "terms of service", "skip to content", "we use cookies", "enable javascript", "cookie policy", "privacy policy",
    "creative commons", "apache license", "terms of use", "licensed under", "released under", "subscribe now", "previous page", "mit license", "back to top", "contact us", "lorem ipsum", "share this",
    "click here", "learn more", "follow us", "next page", "read more", "about us", "log out", "sign up", "sign in", "site map", "log in",
)
NOT_LETTERS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
STOCK = f" (?:{'|'.join(PHRASES).replace(' ', '  ')}) "
SIGNS = "[|»›→•]"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
STOCK_PERCENT, SHORT_WORDS, MOST_LOST = 50, 4, 0.5


def _line(x):
    return F.struct(
        x.alias("line"),
        F.concat(F.lit(" "), F.regexp_replace(F.lower(x), NOT_LETTERS, "  "), F.lit(" ")).alias("plain"),
        F.regexp_count(x, F.lit(SYMBOLS)).alias("symbols"),
        F.regexp_count(x, F.lit(r"[!?]{2,}")).alias("shouts"),
        F.regexp_count(x, F.lit(WORD)).alias("words"),
        F.regexp_count(x, F.lit(STUTTER)).alias("stutters"),
    )


def _fails(x):
    line, words = x["line"], x["words"]
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    navigation = (pipes >= 2) & (pipes * 4 >= words)
    symbols = x["symbols"] * 5 > words * 2
    shouts = x["shouts"] * 4 > words
    stutters = x["stutters"] * 4 > words
    left, signs = F.regexp_count(F.regexp_replace(x["plain"], STOCK, " "), F.lit("[^ ]+")), F.regexp_count(line, F.lit(SIGNS))
    plain = F.regexp_count(x["plain"], F.lit("[^ ]+"))
    boilerplate = (plain > left) & ((plain - left + signs) * 100 >= (plain + signs) * STOCK_PERCENT)
    unfinished = (words < SHORT_WORDS) & ~line.rlike(ENDS)
    return navigation | symbols | shouts | stutters | boilerplate | unfinished


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts, base_failed, kept and clean_text; names begin with two underscores."""
    d = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    d = d.withColumn("__w", F.filter(F.split("__t", SPACE), lambda w: w != ""))
    d = d.withColumn("__l", F.transform(F.filter(F.split("__t", "\n"), lambda x: x.rlike(WORD)), _line))
    d = d.withColumn("__n", F.size("__w")).withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # hashes of two, four and eight words; those that run over the end go below
        d = d.withColumn("__h", F.zip_with("__h", F.slice("__h", step + 1, F.greatest(F.col("__n"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("__h", F.slice("__h", 1, F.greatest(F.col("__n") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("__s", F.when(repeats, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    s, last = F.col("__s"), F.size("__s") - 1
    twice = F.filter("__s", lambda x, i: F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False) | F.when(i < last, F.get(s, i + 1)["h"] == x["h"]).otherwise(False))
    d = d.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("__p", start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(p - a["at"], F.lit(WINDOW))).alias("n")))
    d = d.withColumn("__repeated", covered["n"])
    d = d.withColumn("__bad", F.transform("__l", _fails))
    size = lambda x: F.length(F.regexp_replace(x["line"], SPACE, "")).cast("long")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("__chars", F.length(F.array_join("__w", "")).cast("long"))
    d = d.withColumn("__lost", total(F.zip_with("__l", "__bad", lambda x, b: F.when(b, size(x)).otherwise(0))))
    lines = F.transform("__l", lambda x: x["line"])
    d = d.withColumn("__symbols", total(F.transform("__l", lambda x: x["symbols"].cast("long")))).withColumn("__dup", (F.size("__l") - F.size(F.array_distinct(lines))).cast("long"))
    failed = (F.col("__n") < LEAST_WORDS) | (100 * F.col("__repeated") > MOST_REPEATED * F.col("__n"))
    d = d.withColumn("__failed", failed).withColumn("__kept", ~failed & (F.col("__lost") <= MOST_LOST * F.col("__chars")))
    good = F.transform(F.filter(F.arrays_zip("__l", "__bad"), lambda x: ~x["__bad"]), lambda x: x["__l"]["line"])
    return d.withColumn("__clean", F.when(F.exists("__bad", lambda b: b), F.array_join(good, "\n")).otherwise(F.col(text)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and lost_chars."""
    d = measures(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")))
    # a column that isn't deterministic keeps filters above the projections, which would be copied into them
    return d.select(
        "doc_id", F.col("__n").cast("long").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"), F.col("__repeated").alias("n_repeat_words"), F.col("__failed").alias("base_failed"),
        F.when(F.monotonically_increasing_id() >= 0, F.col("__kept")).alias("kept"), F.col("__lost").alias("lost_chars"),
    )


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that pass, without their failing lines; all columns of docs."""
    names = docs.columns
    rows = docs.select(F.struct(*[docs[k] for k in names]).alias("__all"), docs[text].alias("text"))  # docs may use any names
    # a column that isn't deterministic keeps the filter above the projections, which would be copied into it
    rows = measures(rows).withColumn("__row", F.monotonically_increasing_id()).filter("__kept and __row >= 0")
    return rows.select(*[F.col("__clean").alias(k) if k == text else F.col("__all")[k].alias(k) for k in names])
