"""Quality rules, line first: bad lines go, then documents that lost too much.

DataFrame functions only. A line is dropped when

* navigation: it is cut by ``|``, ``>`` and similar marks into items of hardly more than two words,
* punctuation: a fifth of its characters and more are symbols, half of its words and more end
  in doubled marks (``!!``), or it has ``long_line`` words and more and no mark that ends a clause,
* boilerplate: it holds one of the phrases of ``BOILERPLATE`` and is short.

A document stays when the lines that are left hold at least ``least_kept`` of
its word characters, unless the base rules have failed it: fewer than
``least_words`` words, or more than half of the words inside 3-word windows
that occur more than once in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: The symbols that are counted.
SYMBOLS = r"[#*$%&|<>]"
NAVIGATION_MARKS = r"[|>»•·]"
CLOSED = r"[.!?…:;,]"
BOILERPLATE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies"
    r"|enable javascript|lorem ipsum|skip to (main )?content|click here|sign (in|up)|log ?in|subscribe (now|to)|share this"
    r"|licensed under|released under|public license|back to top)\b"
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(words: Column, sorted_windows: Column) -> Column:
    """Words inside windows that occur twice or more; windows: (hash, place), sorted."""
    twice = F.filter(sorted_windows, lambda x, i: (F.get(sorted_windows, i - 1)["h"] == x["h"]) | F.coalesce(F.get(sorted_windows, i + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + (p + 3) - F.greatest(a["end"], p)).cast("long").alias("n"), (p + 3).alias("end")), lambda a: a["n"])


def good_line(line: Column, long_line: int, boilerplate_words: int) -> Column:
    words = words_of(line)
    n, marks = F.size(words), F.regexp_count(line, F.lit(NAVIGATION_MARKS))
    navigation = (marks >= 2) & (n - marks <= 3 * marks)
    symbols = (F.regexp_count(line, F.lit(SYMBOLS)) * 5 >= F.length(line)) | (F.regexp_count(line, F.lit(r"(!!|\?\?|[#*$%&]{2})")) * 2 >= n)
    unclosed = (n >= long_line) & ~line.rlike(CLOSED)
    boilerplate = line.rlike(BOILERPLATE) & (n <= boilerplate_words)
    return ~(navigation | symbols | unclosed | boilerplate)


def apply_rules(df: DataFrame, text: str = "text", least_words: int = 50, least_kept: float = 0.5, long_line: int = 40, boilerplate_words: int = 25) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    cleaned_text, kept_chars and kept.

    Null text counts as empty: no words, so the base rules fail it. A text of
    white space alone likewise. Rows are judged one by one, so repeated rows
    get equal results; columns of these names are replaced, others stay, but
    _text, _words, _windows, _lines and _good are working names and are lost.
    Windows are compared by 64-bit hashes within one document.
    """
    clean = df.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    clean = clean.withColumn("_words", words_of(F.col("_text"))).withColumn("n_words", F.size("_words").cast("long"))
    w = F.col("_words")
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
    places = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    clean = clean.withColumn("_windows", F.sort_array(F.transform(places, window)))
    lines = F.split("_text", "\n")
    clean = clean.withColumn("_lines", F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    clean = clean.withColumn("_good", F.filter("_lines", lambda x: good_line(x, long_line, boilerplate_words)))
    clean = clean.withColumns({
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(w, F.col("_windows")),
        "cleaned_text": F.array_join("_good", "\n"),
    })
    clean = clean.withColumn("kept_chars", F.length(F.regexp_replace("cleaned_text", SPACES, "")).cast("long"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    clean = clean.withColumn("base_failed", failed)
    clean = clean.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= least_kept * F.col("word_chars")))
    return clean.drop("_text", "_words", "_windows", "_lines", "_good")
