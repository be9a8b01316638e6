"""License scans: the Dice coefficient over word bigrams against license templates.

Lines, paragraphs, runs of up to ``RUN`` paragraphs and the whole text of a document are
normalised (lower case, letters and digits only) and compared with every template as multisets of
word bigrams: ``dice = 2 * common / (size + template size)``. A template can reach the threshold t
only if the sizes are within ``t / (2 - t)`` of each other; the size is the number of words less
one. It must then share ``t / (2 - t)`` of the template's bigrams, so a unit that has none of a
chosen third of them (its *marks*, the least ordinary ones) cannot match either. Documents
without any mark go after one look at their words; only what is left is cut into units, whose
bigrams are joined with the template table, a row per template and bigram. Templates are an
argument; the customary ones are in :mod:`chunkgraph.llm.licenses`.

Defined results: null, empty and one-word texts match nothing; very long texts are scanned whole
(units longer than any template are dropped by their size); of several matches the one with most
bigrams in common counts (a whole license before a clause of it), on ties the highest coefficient,
the smallest license name, the first unit; repeated rows each come back with the same
result, also where they share an id and differ; an empty table gives an empty table. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.llm.common import pinned, read, store
from chunkgraph.llm.licenses import TEMPLATES

THRESHOLD = 0.8
#: Longest run of paragraphs that is one unit.
RUN = 6
#: Template tables of at most this many rows (template and bigram) may be broadcast.
BROADCAST_ROWS = 200_000
_ORDINARY = {"the", "of", "and", "or", "in", "to", "a", "is", "this", "for", "any", "by", "with", "be", "that", "are",
             "it", "as", "on", "you", "not", "all", "must", "may", "from", "at"}


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Hashes of the adjacent word pairs, in order."""
    pairs = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    return F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def size_bounds(size: int, threshold: float) -> tuple[float, float]:
    """The unit sizes that can reach the threshold against a template of this size."""
    slack = 1e-9  # sizes are whole numbers
    return size * threshold / (2 - threshold) - slack, size * (2 - threshold) / threshold + slack


def compile_templates(spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD):
    """``([(name, {bigram: count})], marks)``; as many rows as there are templates."""
    df = spark.createDataFrame(list(enumerate(t for _, t in templates)), "i int, text string")
    df = df.withColumn("w", normal_words(F.col("text"))).withColumn("b", bigrams(F.col("w")))
    rows = sorted(df.select("i", "w", "b").collect(), key=lambda r: r.i)
    counts = [Counter(r.b) for r in rows]
    plain = {b: sum(x in _ORDINARY for x in pair) for r in rows for b, pair in zip(r.b, zip(r.w, r.w[1:]))}
    held = Counter(b for c in counts for b in c)
    marks: set[int] = set()
    for c in counts:
        # Any match shares ``least`` bigrams: leave fewer than that without a mark. Marks that
        # are there already, then the least ordinary and most shared bigrams, come first.
        least = math.ceil(size_bounds(c.total(), threshold)[0])
        open_ = c.total()
        for b in sorted(c, key=lambda b: (b not in marks, plain[b], -held[b], b)):
            if open_ < max(least, 1):
                break
            marks.add(b)
            open_ -= c[b]
    return [(templates[r.i][0], c) for r, c in zip(rows, counts)], sorted(marks)


def scan_units(text: Column) -> Column:
    """Lines, paragraphs of several lines, the whole text, then runs of paragraphs."""
    none = F.array().cast("array<string>")
    lines, paragraphs = F.split(text, "\n"), F.split(text, r"\n[\x20\x09-\x0D]*\n")
    several = F.when(F.size(paragraphs) > 1, F.filter(paragraphs, lambda p: p.contains("\n"))).otherwise(none)
    n = F.size(paragraphs)
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(RUN)), lambda k: F.when(n >= k, F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(paragraphs, i, k), "\n\n"))).otherwise(none)))
    return F.concat(lines, F.when(F.size(lines) > 1, F.concat(several, F.array(text), F.when(n > 1, runs).otherwise(none)))
                    .otherwise(none))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, license, dice, unit, n_matches)``: the best match of every document (null
    where nothing matches) and how many units match any template."""
    spark = docs.sparkSession
    compiled, marks = compile_templates(spark, templates, threshold)
    bounds = [size_bounds(c.total(), threshold) for _, c in compiled if c]
    least, most = min(lo for lo, _ in bounds), max(hi for _, hi in bounds)

    def marked(words: Column) -> Column:
        return F.exists(bigrams(words), lambda b: b.isin(*marks))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("h"))
    # One look at every document; a word has a character and a gap, so tiny texts go at once.
    found = rows.where(F.length("t") >= least).withColumn("w", pinned(normal_words(F.col("t")))).where(marked(F.col("w")))
    units = found.select("doc_id", "h", F.posexplode(pinned(scan_units(F.col("t")))).alias("unit", "t"))
    units = units.withColumn("w", pinned(F.when(F.length("t") >= least, normal_words(F.col("t")))))
    units = units.withColumn("size", F.size("w") - 1).where((F.col("size") >= least) & (F.col("size") <= most))
    units = units.where(marked(F.col("w"))).select(
        "doc_id", "h", "unit", "size", bigrams(F.col("w")).alias("b"), F.monotonically_increasing_id().alias("row"))
    units = store(units, "license-units")
    table = spark.createDataFrame([(b, i, n) for i, (_, c) in enumerate(compiled) for b, n in c.items()],
                                  "g long, i int, n int")
    sizes = spark.createDataFrame([(i, name, c.total()) for i, (name, c) in enumerate(compiled)],
                                  "i int, license string, total int")
    if sum(len(c) for _, c in compiled) <= BROADCAST_ROWS:
        table, sizes = F.broadcast(table), F.broadcast(sizes)
    pairs = (units.select("row", F.explode("b").alias("g")).groupBy("row", "g").agg(F.count(F.lit(1)).alias("m"))
                  .join(table, "g").groupBy("row", "i").agg(F.sum(F.least("m", "n")).alias("common")).join(sizes, "i"))
    dice = 2 * F.col("common") / (F.col("size") + F.col("total"))
    best = (pairs.join(units.select("row", "doc_id", "h", "unit", "size"), "row").withColumn("d", -dice)
                 .where(F.col("d") <= -threshold)
                 .groupBy(F.col("doc_id").alias("f"), F.col("h").alias("fh")).agg(
                     F.min(F.struct((-F.col("common")).alias("c"), "d", "license", "unit")).alias("m"), F.count_distinct("unit").alias("n")))
    # The hash of the text spreads rows without an id.
    out = rows.select("doc_id", "h").join(best, F.col("doc_id").eqNullSafe(F.col("f")) & (F.col("h") == F.col("fh")), "left")
    return out.select("doc_id", F.col("m.license").alias("license"),
                      F.round(-F.col("m.d"), 6).alias("dice"), F.col("m.unit").alias("unit"),
                      F.coalesce("n", F.lit(0)).alias("n_matches"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best license match of every document."""
    return license_scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
