"""Line-first quality rules, as column expressions only.

Every line is judged on its own: a *punctuation* rule (short lines must end a sentence, no
line may be full of symbols), a *navigation* rule (menus and breadcrumbs) and a
*boilerplate* rule (legal and interface phrases, words that stutter). Phrases fail a line when
they cover at least ``MIN_PHRASE_SHARE`` of its characters, whatever its length: a line of its own
about cookies goes, a page of prose on one line that mentions a privacy policy stays. Failing
lines are removed; a document that loses more than ``max_loss`` of its characters, or fails the whole-text base rules, is
rejected. All of it is row-local: no shuffle, no Python.

Defined results: a null or empty text has no words and is rejected by the base rules; a
text of any length is judged whole; repeated rows are judged each on its own; an empty table
gives an empty table. Columns of the input that bear the name of an output column are
replaced by it; no other column name matters.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.llm.common import WS_CHARS, WS_RUN, packed, pinned, read, unpacked, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_LOSS = 0.5
#: A line this short must end like a sentence.
SHORT_LINE_WORDS = 4
MAX_SYMBOL_SHARE = 0.1
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*$"""
#: Separators of menus and breadcrumbs, and lines that are only a menu entry.
NAV_SEPARATORS = r"(?:\s[|»›→•·/>]+(?=\s|$))"
NAV_ENTRY = (r"^(?:home|menu|search|contact|contact us|about|about us|login|log in|sign in|sign up|"
             r"register|next|previous|back|top|back to top|share|print|reply|more|read more|"
             r"skip to content)[.!:]?$")
BOILERPLATE = ("all rights reserved", "copyright ©", "privacy policy", "terms of use", "terms of service",
               "cookie policy", "we use cookies", "accept cookies", "enable javascript", "click here",
               "subscribe to our newsletter", "sign up for our", "powered by", "lorem ipsum",
               "this work is licensed under", "licensed under", "released under the")
#: A copyright sign and a year, with up to three words of the owner's name.
YEAR_MARK = r"©\s*\d{4}(?:\s+\S+){0,3}"
PHRASE = "|".join([*BOILERPLATE, YEAR_MARK])
MIN_PHRASE_SHARE = 0.1
#: A word four times in a row.
STUTTER = r"(?:^|\s)(\S++)(?:\s+\1(?=\s|$)){3}"


def _symbols(text: Column) -> Column:
    """How many characters of ``text`` are symbols."""
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def _pair_up(hashes: str, step: int) -> Column:
    """Hash of element i with element i + step; the last ones have no partner and are cut off
    by the caller."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(F.col(hashes), i + step)))


def base_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of the whole text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines``
    (lines with a word equal to an earlier line), ``n_repeat_words`` (words inside 8-word
    windows that occur at least twice in the text). Windows are compared by a 64-bit hash
    of the window's word array.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.withColumn("_w", words(F.col(text_col)))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    # Hash of every 8-word window out of those of 1, 2 and 4 words: three pairings a word.
    d = d.withColumn("_h", F.when(F.col("n_words") >= WINDOW,
                                  F.transform("_w", lambda w: F.xxhash64(w))))
    step = 1
    while step < WINDOW:
        d = d.withColumn("_h", _pair_up("_h", step))
        step *= 2
    d = d.withColumn("_h", F.slice("_h", 1, (F.col("n_words") - (WINDOW - 1)).cast("int")))
    d = d.drop("_w")
    # Only texts with a repeated window go through the sort; the others stop here.
    d = d.withColumn("_s", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.drop("_h")
    d = d.withColumn("_p", F.sort_array(F.transform(
        F.filter("_s", lambda x, j: ((j > 0) & (F.get(F.col("_s"), j - 1)["h"] == x["h"]))
                 | (F.coalesce(F.get(F.col("_s"), j + 1)["h"] == x["h"], F.lit(False)))),
        lambda x: x["i"])))
    d = d.drop("_s")
    covered = F.aggregate(
        F.transform("_p", lambda p, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), j + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")
    d = d.withColumn("n_symbols", _symbols(text).cast("long"))
    d = d.withColumn("_l", F.filter(F.split(text, "\n"),
                                    lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return (d.withColumn("n_dup_lines",
                         (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
             .drop("_l"))


def _boilerplate(low: Column) -> Column:
    """Whether phrases make a line, in lower case, boilerplate. Few lines have one, so the
    plain searches come first."""
    mentions = reduce(or_, [low.contains(p) for p in (*BOILERPLATE, "©")])
    rest = F.length(F.regexp_replace(low, PHRASE, ""))
    return mentions & (F.length(low) > rest) & (F.length(low) - rest >= MIN_PHRASE_SHARE * F.length(low))


def line_passes(bare: Column, low: Column) -> Column:
    """Whether a line passes the punctuation, navigation and boilerplate rules; it is given
    without white space at its ends, as it is and in lower case.

    Blank lines pass: they separate paragraphs and carry no text.
    """
    short = F.regexp_count(bare, F.lit(WS_RUN)) < SHORT_LINE_WORDS
    bad_punct = (short & ~bare.rlike(SENTENCE_END)) | (
        _symbols(bare) > MAX_SYMBOL_SHARE * F.length(bare))
    nav = (F.regexp_count(bare, F.lit(NAV_SEPARATORS)) > 2) | (short & low.rlike(NAV_ENTRY))
    return (bare == "") | ~(bad_punct | nav | _boilerplate(low) | bare.rlike(STUTTER))


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text",
         "n_lines", "n_removed_lines", "loss", "kept")


def quality_rules(df: DataFrame, text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """``df`` with the base counts, ``base_failed``, ``clean_text`` (the lines that pass),
    ``n_lines``, ``n_removed_lines``, ``loss`` (share of characters removed) and ``kept``."""
    d = packed(df, text_col, text=F.col(text_col))
    d = base_columns(d, "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    d = d.withColumn("_l", F.split(text, "\n"))
    # Trimmed and lower-cased once; inside a lambda each use would do it again.
    d = d.withColumn("_b", F.transform("_l", lambda x: F.btrim(x, F.lit(WS_CHARS))))
    d = d.withColumn("_m", F.transform("_b", lambda x: F.lower(x)))
    d = d.withColumn("_k", F.filter("_l", lambda x, i: line_passes(
        F.get(F.col("_b"), i), F.get(F.col("_m"), i)))).drop("_b", "_m")
    d = d.withColumn("n_lines", F.size("_l").cast("long"))
    d = d.withColumn("n_removed_lines", (F.size("_l") - F.size("_k")).cast("long")).drop("_l")
    d = d.withColumn("clean_text", F.array_join("_k", "\n")).drop("_k")
    # Newlines between lines do not count on either side of the share.
    full = F.length(text) - (F.col("n_lines") - 1)
    left = F.length("clean_text") - F.greatest(
        F.col("n_lines") - F.col("n_removed_lines") - 1, F.lit(0))
    d = d.withColumn("loss", F.when(full > 0, 1 - left / full).otherwise(F.lit(0.0)))
    d = d.withColumn("kept", pinned(~F.col("base_failed") & (F.col("loss") <= max_loss)))
    return unpacked(d, df.columns, ADDED, **{text_col: F.col("text")})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_removed_lines", F.round("loss", 6).alias("loss"))
