"""Deletion of repeated line runs, found with a suffix array over line ids; DataFrame operations alone.

A text is its sequence of lines that hold a word, with white space at their ends cut off. A line is deleted if and only
if it lies in a run of consecutive such lines with at least `min_words` words that also occurs earlier: in a text whose
smallest id is smaller (ties by digest), or higher up in the same text. The earliest copy of each run stays.

1. Rows with equal texts are one text under their smallest id; the other rows lose everything if the text has
   `min_words` words. Lines that occur once end every run, so only stretches of repeated lines with enough words go on.
2. Prefix doubling: the rank of a position by its first 2^(j+1) lines comes from sorting the distinct pairs (its rank by
   2^j lines, the rank 2^j lines further on). Ranks keep the lexicographic order, so after each round they are the
   suffix array to that depth. Pairs are made distinct before they are sorted; a frequent line is a single row there.
3. The longest-common-prefix interval of depth m around a suffix is the class of equal runs of m lines, which two ranks of
   2^j <= m lines name: that of the run's start and that of the last 2^j lines. The shortest runs with enough words that
   start or end at each position cover every longer repeated run, maximal ones among them, line by line; in each
   interval all runs but the earliest are deleted.

The doubling needs as many rounds as the shortest runs' longest has binary digits, at most log2(min_words) + 1.

Null and blank texts have no lines and stay. Rows with a null id are later copies of equal rows that have an id. Rows
that repeat id and text share their fate. Windows and arrays are bounded by one text. Extra columns are kept;
internal columns carry a prefix of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockscope.llm.common import WORD_GAP, materialize

MIN_WORDS = 50
P = "__lines_"
SPACE = " \t\n\x0b\x0c\r"


def _ranked(keys: DataFrame, columns: list[str], rank: str) -> DataFrame:
    """Distinct keys with a rank that keeps their order. Written at once: a rank is only good for one run of the sort."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(keys.select(*columns).distinct().repartitionByRange(parts, *columns).sortWithinPartitions(*columns).withColumn(rank, F.monotonically_increasing_id()), "line-ranks")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, k, at, line, words): k counts the lines with a word, at counts all lines; one row for each distinct text's line."""
    text = F.col(text_col)
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("at"), F.trim(line, F.lit(SPACE)).alias("line")))
    exploded = docs.where(text.isNotNull()).select(F.unhex(F.md5(text)).alias("digest"), F.posexplode(F.filter(numbered, lambda x: x["line"] != "")).alias("k", "x"))
    rows = exploded.select("digest", "k", F.col("x.at").alias("at"), F.unhex(F.md5("x.line")).alias("line"), F.size(F.split("x.line", WORD_GAP)).cast("long").alias("words"))
    return rows.groupBy("digest", "k").agg(F.first("at").alias("at"), F.first("line").alias("line"), F.first("words").alias("words"))


def suffix_ranks(positions: DataFrame, rounds: int) -> DataFrame:
    """Positions (digest, stretch, k, line, ...) with `ranks`: element j orders suffixes by their first 2^j lines within the stretch."""
    out = positions.join(_ranked(positions, ["line"], "rank"), "line").drop("line").withColumn("ranks", F.array("rank"))
    for j in range(rounds):
        ahead = Window.partitionBy("digest", "stretch").orderBy("k")
        out = materialize(out.withColumn("next", F.coalesce(F.lead("rank", 1 << j).over(ahead), F.lit(-1).cast("long"))), "line-suffixes")
        pairs = _ranked(out, ["rank", "next"], "new")
        out = out.join(pairs, ["rank", "next"]).withColumns({"ranks": F.concat("ranks", F.array("new")), "rank": F.col("new")}).drop("next", "new")
    return materialize(out, "line-suffixes")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, k, m): runs of m lines from line k on, in distinct texts, that occur earlier as well."""
    lines = materialize(_lines(docs, id_col, text_col), "lines")
    repeated = materialize(lines.groupBy("line").count().where("count > 1").select("line"), "line-repeated")  # stored, so that the join may split a frequent line
    by_text = Window.partitionBy("digest").orderBy("k")
    found = lines.join(repeated, "line").withColumn("stretch", F.col("k") - F.row_number().over(by_text))
    stretch = Window.partitionBy("digest", "stretch")
    so_far = stretch.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumns({"upto": F.sum("words").over(so_far), "all": F.sum("words").over(stretch)}).where(F.col("all") >= min_words)
    found = found.withColumn("before", F.col("upto") - F.col("words"))
    # the shortest runs of min_words words: the next one from here, and the last one up to here
    later = F.min("k").over(stretch.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing))
    earlier = F.max("k").over(stretch.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    found = found.withColumns({"later": later, "earlier": earlier, "first": F.min("k").over(stretch), "last": F.max("k").over(stretch)})
    onward = F.when(F.col("later").isNotNull(), F.col("later") - F.col("k")).when(F.col("all") - F.col("before") >= min_words, F.col("last") - F.col("k") + 1)
    back = F.when(F.col("earlier").isNotNull(), F.col("k") - F.col("earlier")).when(F.col("upto") >= min_words, F.col("k") - F.col("first") + 1)
    positions = materialize(found.select("digest", "stretch", "k", "line", onward.alias("onward"), back.alias("back")), "line-stretches")

    longest = positions.agg(F.max(F.greatest("onward", "back"))).first()[0] or 1
    ranks = suffix_ranks(positions.select("digest", "stretch", "k", "line", "onward", "back"), longest.bit_length() - 1)
    runs = ranks.select("digest", "k", F.col("onward").alias("m")).unionAll(ranks.select("digest", F.col("k") - F.col("back") + 1, "back")).where("m is not null").distinct()
    step = F.length(F.bin("m")) - 1  # the largest 2^step <= m
    head = ranks.select("digest", "k", F.col("ranks").alias("head"))
    tail = ranks.select("digest", F.col("k").alias("tail_at"), F.col("ranks").alias("tail"))
    named = (
        runs.join(head, ["digest", "k"])
        .withColumn("tail_at", (F.col("k") + F.col("m") - F.pow(F.lit(2.0), step)).cast("int"))
        .join(tail, ["digest", "tail_at"])
        .select("digest", "k", "m", F.get("head", step).alias("head"), F.get("tail", step).alias("tail"))
    )
    firsts = docs.where(F.col(text_col).isNotNull()).groupBy(F.unhex(F.md5(text_col)).alias("digest")).agg(F.min(id_col).alias("first_id"))
    named = materialize(named.join(firsts, "digest").withColumn("place", F.struct("first_id", "digest", "k")), "line-runs")
    intervals = named.groupBy("m", "head", "tail").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    intervals = materialize(intervals.select("m", "head", "tail", "earliest"), "line-intervals")
    return named.join(intervals, ["m", "head", "tail"]).where("place <> earliest").select("digest", "k", "m")


def mark_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with `__lines_n` (lines with a word), `__lines_gone` (those deleted) and `__lines_text` (the text that is left)."""
    gone = repeated_runs(docs, min_words, id_col, text_col).select("digest", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("m") - 1)).alias("line")).distinct()
    gone = gone.groupBy("digest").agg(F.collect_list("line").alias("cut"))  # at most the lines of one text
    text = F.col(text_col)
    firsts = docs.where(text.isNotNull()).groupBy(F.unhex(F.md5(text)).alias("digest")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n"))
    cases = firsts.join(gone, "digest", "left").where("n > 1 or cut is not null").select(F.col("digest").alias(P + "digest"), F.col("first_id").alias(P + "first"), F.col("cut").alias(P + "cut"))
    cases = materialize(cases, "line-cases")

    lines, ids, where = F.col(P + "lines"), F.col(P + "ids"), P + "digest"
    words = F.aggregate(ids, F.lit(0), lambda total, i: total + F.size(F.split(F.trim(F.get(lines, i), F.lit(SPACE)), WORD_GAP)))
    copy = F.col(P + "first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col(P + "first")) & (F.col(P + "words") >= min_words)
    out = docs.withColumn(P + "key", F.unhex(F.md5(text))).join(cases.hint("merge"), F.col(P + "key") == F.col(where), "left")  # one plan at every size
    out = out.withColumn(P + "lines", F.split(text, "\n"))
    numbered = F.filter(F.transform(lines, lambda line, i: F.when(F.trim(line, F.lit(SPACE)) != "", i)), lambda i: i.isNotNull())
    out = out.withColumn(P + "ids", F.coalesce(numbered, F.array().cast("array<int>")))  # line numbers of the lines with a word
    out = out.withColumn(P + "words", F.when(F.col(where).isNotNull(), words))
    cut = F.when(copy, ids).when(F.col(P + "cut").isNotNull(), F.transform(F.col(P + "cut"), lambda k: F.get(ids, k)))
    out = out.withColumn(P + "drop", F.coalesce(cut, F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(P + "drop"))
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    made = F.struct(F.size(ids).cast("long").alias(P + "n"), F.size(P + "drop").cast("long").alias(P + "gone"), F.when(F.size(P + "drop") > 0, rest).otherwise(text).alias(P + "text"))
    # exploding one row keeps later filters above the arrays, which would else be computed again inside the functions on them
    return out.select(*docs.columns, F.inline(F.array(made)))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, kept, text_md5) for each row: kept is false where nothing with a word is left."""
    marked = mark_lines(docs.select(id_col, text_col), min_words, id_col, text_col)
    n, gone = F.col(P + "n"), F.col(P + "gone")
    return marked.select(id_col, n.alias("n_lines"), gone.alias("n_removed"), ((gone < n) | (n == 0)).alias("kept"), F.md5(P + "text").alias("text_md5"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the text that is left; rows that lose all their lines go. All columns stay as they were but the text."""
    marked = mark_lines(docs, min_words, id_col, text_col).where((F.col(P + "gone") < F.col(P + "n")) | (F.col(P + "n") == 0))
    return marked.select(*(F.col(P + "text").alias(c) if c == text_col else F.col(c) for c in docs.columns))
