"""Quality rules, line first: lines that fail a rule go, then documents that lose too much of their text.

A line with a word fails, by the first of these that holds:

* `boilerplate`: it holds a phrase of BOILERPLATE;
* `navigation`: it is a row of links: three separators of SEPARATORS or more, between white space, or a separator at
  its end; or it has at most three words, all of them in MENU;
* `punctuation`: symbols (SYMBOLS) are more than half as many as its words; more than a quarter of its words end in
  two or more exclamation or question marks; or it has LIST_WORDS words or more, and neither ends in punctuation that
  ends a sentence nor holds an end of a sentence.

Documents also have the base figures of the whole text: n_words, word_chars (code points in words), n_symbols,
n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words in windows of WINDOW words that come
twice or more, the first one included; windows are compared by 64-bit hashes). A document fails the base if it has
fewer than 20 words or more than 30 % of them are repeated; it fails the verdict if its failing lines hold more than
half of its words.

DataFrame functions only, and no shuffle: everything about a document is found in its own row, windows by sorting
their hashes, and only where two are equal.

Edge cases: a null text has no words and fails; so does an empty one, or one of white space; lines without a word
pass all rules and stay; repeated rows are judged each for itself; an empty table gives an empty result. Other
columns stay in `cleaned`, and none but doc_id and text are read in `figures`.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import text_or_empty

# Fixed values of the rules.
WINDOW = 8
LEAST_WORDS = 20
REPEATED = 30  # percent of the words
LOST = 50  # percent of the words
LIST_WORDS = 6
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›·•>"
MENU = "home about contact login logout register search menu help faq blog news sitemap next previous back share print top"
BOILERPLATE = [
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies", "uses cookies", "accept cookies",
    "enable javascript", "javascript is", "lorem ipsum", "click here", "read more", "sign up for", "subscribe to", "our newsletter", "skip to content",
    "share this", "add to cart", "log in to", "follow us", "leave a comment", "posted by", "page not found", "download pdf", "powered by",
]

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept"]
SPACES = r"[\x20\x09-\x0D]+"
MENU_LINE = rf"(?i)^[\x20\x09-\x0D]*(?:(?:{'|'.join(MENU.split())})(?:[\x20\x09-\x0D]+|\z)){{1,3}}\z"
BOILERPLATE_LINE = rf"(?i)(?:{'|'.join(BOILERPLATE)})"
THREE_SEPARATORS = rf"(?:[{SEPARATORS}][^{SEPARATORS}]*){{3}}"  # in any place; only such lines have their words counted
LAST_SEPARATOR = rf"[{SEPARATORS}][\x20\x09-\x0D]*\z"
SENTENCE_END = r"[.!?…:;。！？।؟۔][\"'’”»)\]]*(?:[\x20\x09-\x0D]|\z)"
SHOUTED = r"[!?][!?][\x20\x09-\x0D.,]*\z"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def failed_rule(line: Column, words: Column, holds: dict[str, Column]) -> Column:
    """The rule that a line with these words fails, or null; `holds` says what the line's document has anywhere."""
    n = F.size(words)
    separators = F.size(F.filter(words, lambda w: w.isin(*SEPARATORS)))
    shouted = F.size(F.filter(words, lambda w: w.rlike(SHOUTED)))
    links = holds["separators"] & ((line.rlike(THREE_SEPARATORS) & (separators >= 3)) | line.rlike(LAST_SEPARATOR))
    return (F.when(n == 0, F.lit(None).cast("string"))
            .when(holds["phrases"] & line.rlike(BOILERPLATE_LINE), "boilerplate")
            .when(links | ((n <= 3) & line.rlike(MENU_LINE)), "navigation")
            .when((holds["symbols"] & (2 * symbols(line) > n)) | (holds["marks"] & (4 * shouted > n)) | ((n >= LIST_WORDS) & ~line.rlike(SENTENCE_END)), "punctuation"))


def _repeated(words: Column, hashes: Column) -> Column:
    """The sorted starts, from 1, of the windows whose hash comes twice or more."""
    window = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(window)).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `_lines` (line, n, rule), the base figures, lost_words, base_failed and kept."""
    # every step is a column of its own that the next one reads more than once, so none is computed again for every entry
    out = docs.withColumn("_text", text_or_empty(text))
    lines = F.transform(F.split("_text", "\n"), lambda line: F.struct(line.alias("line"), words_of(line).alias("words")))
    marks = F.col("_text").contains("!!") | F.col("_text").contains("??") | F.col("_text").contains("!?") | F.col("_text").contains("?!")
    out = out.select(*docs.columns, lines.alias("_split"), F.lower("_text").alias("_lower"), F.col("_text").rlike(f"[{SEPARATORS}]").alias("_separators"),
                     marks.alias("_marks"), symbols(F.col("_text")).cast("long").alias("n_symbols"))
    phrases = functools.reduce(operator.or_, (F.col("_lower").contains(phrase) for phrase in BOILERPLATE))
    known = ["n_symbols", "_separators", "_marks"]
    out = out.select(*docs.columns, *known, "_split", phrases.alias("_phrases"), F.flatten(F.transform("_split", lambda x: x["words"])).alias("_words"))
    known = [*known, "_split", "_phrases"]
    out = out.select(*docs.columns, *known, F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                     F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    known = [*known, "n_words", "word_chars"]
    for width in (1, 2, 4):  # the hash of a window is that of its halves' hashes
        starts = F.slice("_hashes", 1, F.greatest(F.size("_hashes") - width, F.lit(0)))
        out = out.select(*docs.columns, *known, F.transform(starts, lambda h, i: F.xxhash64(h, F.get("_hashes", i + width))).alias("_hashes"))  # noqa: B023
    worded = F.transform(F.filter("_split", lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
    holds = {"phrases": F.col("_phrases"), "separators": F.col("_separators"), "marks": F.col("_marks"), "symbols": F.col("n_symbols") > 0}
    judged = F.transform("_split", lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n"), failed_rule(x["line"], x["words"], holds).alias("rule")))
    out = out.select(*docs.columns, "n_words", "word_chars", "n_symbols", worded.alias("_worded"), judged.alias("_lines"), _repeated(F.col("_words"), F.col("_hashes")).alias("_sorted"))
    twice = F.filter("_sorted", lambda x, i: (F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"]))
    out = out.select(*docs.columns, "n_words", "word_chars", "n_symbols", "_lines",
                     (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
                     F.sort_array(F.transform(twice, lambda x: x["at"])).alias("_starts"),
                     F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + F.when(x["rule"].isNotNull(), x["n"]).otherwise(0)).alias("lost_words"))
    covered = F.transform("_starts", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - at, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, n: a + n)).drop("_starts")
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= LOST * F.col("n_words")))
    # a later filter on a figure would be moved below all steps, with every step written out in it as often as it is read; beside
    # a column that is not deterministic it stays above them
    out = out.select(*docs.columns, F.struct(F.monotonically_increasing_id().alias("_at"), *FIGURES, "_lines").alias("_figures"))
    return out.select(*docs.columns, *[F.col("_figures")[name].alias(name) for name in [*FIGURES, "_lines"]])


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, the figures, lost_words, base_failed, kept) of every row."""
    found = figures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", *FIGURES)


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; failing lines are gone from `text`."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text"))
    left = F.array_join(F.transform(F.filter("_lines", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")
    kept = figures(whole).filter("kept").select("row", left.alias("left"))
    return kept.select(*[F.col("left").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
