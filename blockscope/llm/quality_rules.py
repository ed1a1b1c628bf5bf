"""Quality rules learned as a decision list by sequential covering, from DataFrame operations alone.

`text_statistics` computes the counts of a text inside one projection: no shuffle, no Python. `learn_rules` joins them
with a bounded number of labels, and `cover` grows one conjunction of thresholds at a time on two thirds of these rows:
each step takes the threshold with the best information gain on the rows still covered. The other third prunes the
conjunction, dropping last conditions while that helps, and decides whether the rule is precise enough to keep; rows
that a kept rule covers leave, and the next rule is grown. `apply_rules` turns the ordered rules into one conditional
expression over all rows.

A null text has no words. Rows with a null label or id are not learned from; without labelled rows of both kinds there
are no rules, and only the base rule rejects. Repeated labelled rows count each. Equal gains go to the earlier
statistic and lower threshold. Extra columns are kept by `filter_quality`; internal columns carry a prefix of their own.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import WORD_GAP

#: Labelled rows that rules are learned from, at most; chosen by a hash of the id.
FIT_ROWS = 20_000
BINS, MAX_RULES, MAX_CONDITIONS = 32, 8, 4
MIN_PRECISION, MIN_COVER = 0.9, 8
#: A good text that a rule covers weighs as much as so many bad ones.
GOOD_WEIGHT = 10
PREFIX = "__quality_"
SPACE = " \t\n\x0b\x0c\r"


def _count(text: str, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with a struct column `__quality_stats` of counts; see the module for nulls."""
    text, words, hashes, grams = (PREFIX + c for c in ("text", "words", "hashes", "grams"))
    out = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    trimmed = F.trim(F.col(text), F.lit(SPACE))
    out = out.withColumn(words, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP)))
    # windows of three words with their places, equal ones side by side
    out = out.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    h, n = F.col(hashes), F.size(hashes)
    triples = F.slice(F.arrays_zip(h.alias("a"), F.slice(h, 2, n).alias("b"), F.slice(h, 3, n).alias("c")), 1, F.greatest(n - 2, F.lit(0)))
    out = out.withColumn(grams, F.sort_array(F.transform(triples, lambda t, i: F.struct(F.xxhash64(t["a"], t["b"], t["c"]).alias("h"), i.alias("i")))))
    g = F.col(grams)
    neighbours = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(g)), lambda k: F.get(g, k - 1)["h"] == F.get(g, k)["h"]),
        lambda k: F.struct(F.get(g, k - 1).alias("x"), F.get(g, k).alias("y")),
    )
    covered = F.flatten(F.transform(neighbours, lambda z: F.flatten(F.array(*(F.array(z[s]["i"], z[s]["i"] + 1, z[s]["i"] + 2) for s in "xy")))))
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "")
    out = out.withColumn(PREFIX + "lines", lines)
    line = F.col(PREFIX + "lines")
    stats = F.struct(
        n.cast("long").alias("n_words"),
        (F.length(text) - _count(text, r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        _count(text, r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        F.size(line).cast("long").alias("n_lines"),
        _count(text, "[A-Z]").cast("long").alias("n_upper"),
        _count(text, "[!?]").cast("long").alias("n_exclaim"),
    )
    # exploding one row keeps later filters above the arrays, which would else be computed again inside the functions on them
    return out.select(*docs.columns, F.explode(F.array(stats)).alias(PREFIX + "stats"))


def features(stats: Column) -> dict[str, Column]:
    """The statistics that rules compare with thresholds, all finite."""
    words = F.greatest(stats["n_words"], F.lit(1)).cast("double")
    return {
        "symbols_per_word": stats["n_symbols"] / words,
        "exclaims_per_word": stats["n_exclaim"] / words,
        "upper_share": stats["n_upper"] / F.greatest(stats["word_chars"], F.lit(1)).cast("double"),
        "repeat_share": stats["n_repeat_words"] / words,
        "dup_line_share": stats["n_dup_lines"] / F.greatest(stats["n_lines"], F.lit(1)).cast("double"),
        "mean_word": stats["word_chars"] / words,
        "words_per_line": words / F.greatest(stats["n_lines"], F.lit(1)).cast("double"),
        "n_words": stats["n_words"].cast("double"),
    }


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


#: A condition is (feature, "<=" or ">", threshold); a rule is a conjunction that rejects.
Condition = tuple[str, str, float]


def _holds(condition: Condition, values: dict[str, Column]) -> Column:
    name, sign, threshold = condition
    return values[name] <= threshold if sign == "<=" else values[name] > threshold


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    n, n0 = GOOD_WEIGHT * n, GOOD_WEIGHT * n0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> list[list[Condition]]:
    """Ordered rules, each a list of conditions, that reject rows whose label is 0. At most fit_rows rows of statistics are collected."""
    sample = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias(PREFIX + "id"), (F.col(label_col) == 0).alias("bad"))
        .orderBy(F.xxhash64(PREFIX + "id"), PREFIX + "id")
        .limit(fit_rows)
    )
    chosen = docs.select(id_col, text_col).join(F.broadcast(sample), F.col(id_col) == F.col(PREFIX + "id"))  # at most fit_rows labels
    values = features(F.col(PREFIX + "stats"))
    grow = F.pmod(F.xxhash64(F.lit("fold"), PREFIX + "id"), F.lit(3)) > 0
    rows = text_statistics(chosen, text_col).select("bad", grow.alias("grow"), *(v.alias(k) for k, v in values.items())).orderBy(F.xxhash64(PREFIX + "id")).limit(fit_rows).collect()
    return cover([(r[0], r[1], r[2:]) for r in rows], list(values))


def cover(rows: list[tuple[bool, bool, tuple]], names: list[str]) -> list[list[Condition]]:
    """Sequential covering of the bad rows among (bad, in the growing part, values)."""
    edges = []
    for k in range(len(names)):
        ordered = sorted(values[k] for _, _, values in rows)
        edges.append(sorted({ordered[len(ordered) * q // BINS] for q in range(1, BINS)}) if ordered else [])
    binned = [(bad, grow, [bisect_left(e, v) for e, v in zip(edges, values)]) for bad, grow, values in rows]
    index = {name: k for k, name in enumerate(names)}

    def holds(condition: Condition, bins: list[int]) -> bool:
        k = index[condition[0]]
        edge = bisect_left(edges[k], condition[2])
        return bins[k] <= edge if condition[1] == "<=" else bins[k] > edge

    def grown(covered: list[list[int]], bad: list[bool], failed: set[str]) -> list[Condition]:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            p0, n0 = sum(bad), len(bad) - sum(bad)
            if p0 < MIN_COVER or not n0:
                break
            best: tuple[float, Condition] | None = None
            for k, name in enumerate(names):
                if not rule and name in failed:
                    continue
                counts = [[0, 0] for _ in range(len(edges[k]) + 1)]
                for b, bins in zip(bad, covered):
                    counts[bins[k]][not b] += 1
                p = n = 0
                for edge, (pb, nb) in zip(edges[k], counts):
                    p, n = p + pb, n + nb
                    for sign, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                        gain = _gain(pp, nn, p0, n0)
                        if pp >= MIN_COVER and (best is None or gain > best[0] + 1e-9):
                            best = (gain, (name, sign, float(edge)))
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            kept = [(bins, b) for bins, b in zip(covered, bad) if holds(best[1], bins)]
            covered, bad = [c for c, _ in kept], [b for _, b in kept]
        return rule

    rules: list[list[Condition]] = []
    failed: set[str] = set()  # statistics whose rules, when grown first from them, were not precise enough
    while len(rules) < MAX_RULES and len(failed) < len(names):
        rule = grown([bins for _, g, bins in binned if g], [bad for bad, g, _ in binned if g], failed)
        if not rule:
            break
        worth = []
        pruning = [(bad, bins) for bad, g, bins in binned if not g]
        for k, condition in enumerate(rule):
            pruning = [(bad, bins) for bad, bins in pruning if holds(condition, bins)]
            p = sum(bad for bad, _ in pruning)
            n = len(pruning) - p
            worth.append(((p - GOOD_WEIGHT * n) / max(1, p + GOOD_WEIGHT * n), (p + 1) / (p + n + 2), -k))
        _, precision, k = max(worth)
        if precision < MIN_PRECISION:
            failed.add(rule[0][0])
            continue
        rule = rule[: 1 - k]
        rules.append(rule)
        binned = [row for row in binned if not all(holds(c, row[2]) for c in rule)]
    return rules


def _all(rule: list[Condition], values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & _holds(condition, values)
    return out


def apply_rules(rules: list[list[Condition]], stats: Column) -> Column:
    """The number (from 1) of the first rule that covers the row, 0 if none does: an ordered conditional expression."""
    values = features(stats)
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(_all(rules[k - 1], values), k).otherwise(out)
    return out


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) for each row."""
    rules = learn_rules(docs, labels, id_col, text_col, fit_rows=fit_rows)
    s = F.col(PREFIX + "stats")
    rated = text_statistics(docs.select(id_col, text_col), text_col).select(id_col, s, apply_rules(rules, s).alias("rule"))
    return rated.select(
        id_col, *(s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed(s).alias("base_failed"), (~base_failed(s) & (F.col("rule") == 0)).alias("kept"), "rule"
    )


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows that neither the base rule nor a learned rule rejects, with the columns they came with."""
    rules = learn_rules(docs, labels, id_col, text_col, fit_rows=fit_rows)
    s = F.col(PREFIX + "stats")
    return text_statistics(docs, text_col).where(~base_failed(s) & (apply_rules(rules, s) == 0)).select(*docs.columns)
