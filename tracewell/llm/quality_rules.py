"""Learned decision lists over document statistics.

Sequential covering on the labelled documents that pass the base rule: a rule,
a conjunction of thresholds, grows on most of the rows while its precision on
bad documents rises, loses conditions from its end while that helps on the
others, and is kept if it is precise there; a fifth of the rows does neither
and is left to judge the list by; the rows that it covers are set aside and the next rule
is grown.  A rule that is not precise enough ends nothing: no later rule
begins with a threshold on the same side of its first feature.  Rules that
would follow one another if each were refused grow side by side, so that the
jobs go by the rules taken.  All counts are grouped Spark aggregates over all
labelled rows; the list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import WORD_SEP, let, materialize, scratch, words

FEATURES = ("n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "digit_rate")
BINS = 32
#: The columns of the features' bins.
BINNED = [f"bin{i}" for i in range(len(FEATURES))]
#: Rules of a list, refused rules before the search ends, conditions of a rule.
MAX_RULES, MAX_REFUSED, MAX_CONDITIONS = 8, 8, 4
#: On the pruning rows a rule must have this share of bad documents ...
MIN_PRECISION = 0.9
#: ... and the share's lower bound (Wilson's, one-sided at ``Z``) must reach this, which five bad rows and no good one do.
MIN_BOUND, Z = 0.6, 1.645


def repeated_words(w: Column) -> Column:
    """Words of ``w`` in 3-word windows found twice or more in it.

    Windows are compared by 64-bit hashes; sorted with their places, equal ones
    are neighbours, and the union of their ranges is summed along the places.
    """

    def count(h: Column) -> Column:
        def ranges(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            places = F.sort_array(F.transform(same, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")), lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(3), x - a["last"])).alias("sum")))["sum"])

        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(marked), ranges))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(grams, count)).cast("long")


def statistics(docs: DataFrame, carry: Column | str = "doc_id", text_col: str = "text") -> DataFrame:
    """``carry`` (a column of ``docs``), the counts of the base rule and ``FEATURES``, a row a document; no shuffle.

    A null or empty text has no words and all counts zero.
    """
    name = carry if isinstance(carry, str) else "carried"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select((F.col(carry) if isinstance(carry, str) else carry).alias("id"), text.alias("t")).withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    counted = base.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", WORD_SEP, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("upper"),
        without("!?.,;:").alias("marks"),
        without("0123456789").alias("digits"),
        F.size(F.split("t", "\n")).alias("lines"),
    )
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        F.col("id").alias(name),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        rate("word_chars", "n_words").alias("word_length"),
        rate("n_symbols", "n_words").alias("symbol_rate"),
        rate("n_dup_lines", "lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("upper", "word_chars").alias("upper_rate"),
        rate("marks", "n_words").alias("mark_rate"),
        rate("digits", "word_chars").alias("digit_rate"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


def conjunction(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def binned(feature: str, cuts: list) -> Column:
    """How many of ``cuts`` the feature passes."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda e: e < F.col(feature)))


def lower_bound(p: int, n: int, z: float = Z) -> float:
    """Wilson's lower bound of the share of ``p`` in ``p + n``; 0 for nothing seen."""
    total = p + n
    if not total:
        return 0.0
    share, spread = p / total, z * z / total
    return (share + spread / 2 - math.sqrt(spread * (share * (1 - share) + spread / 4))) / (1 + spread)


def gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of narrowing ``p0`` bad and ``n0`` good rows to ``p`` and ``n``."""
    return p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2))) if p else 0.0


def best_condition(count: dict[tuple[int, int], tuple[int, int]], cuts: dict[str, list], barred: set[tuple[str, bool]]) -> Condition | None:
    """The condition of the highest gain, from counts of bad and good rows by (feature, bin); None if none gains or none is good.

    ``barred`` has the features and sides that it may not be of.
    """
    p0, n0 = (sum(v[i] for (pos, _), v in count.items() if pos == 0) for i in (0, 1))
    best = (1e-9, None)
    for i, f in enumerate(FEATURES):
        p = n = 0
        for b, threshold in enumerate(cuts[f]):  # bin b holds values up to cuts[b]
            dp, dn = count.get((i, b), (0, 0))
            p, n = p + dp, n + dn
            for c, x in ((Condition(f, False, float(threshold)), (p, n)), (Condition(f, True, float(threshold)), (p0 - p, n0 - n))):
                if (f, c.above) not in barred:
                    best = max(best, (gain(*x, p0, n0), c), key=lambda y: y[0])
    return best[1] if n0 else None


def pruned(rule: list[Condition], seen: list[tuple[int, int]]) -> tuple[list[Condition], int, int]:
    """The prefix of ``rule`` with the highest lower bound (the shortest of equals), and what it covers.

    ``seen`` has the bad and good pruning rows that each prefix covers.
    """
    k = max(range(len(rule)), key=lambda i: (lower_bound(*seen[i]), -i))
    return rule[: k + 1], *seen[k]


def histograms(rows: DataFrame, columns: list[str], within: list[Column]) -> list[dict[tuple[int, int], tuple[int, int]]]:
    """For each condition of ``within`` the bad and good rows that meet it, by (place in ``columns``, value).

    All are counted in one scan and one shuffle, to which a task gives a row
    for each value of a column.  The columns have few values and no nulls.
    """
    sums = [F.count_if(w & (F.col("bad") == bad)).alias(f"x{j}_{int(bad)}") for j, w in enumerate(within) for bad in (True, False)]
    out: list[dict[tuple[int, int], tuple[int, int]]] = [{} for _ in within]
    for r in rows.groupingSets([[c] for c in columns], *columns).agg(*sums).collect():
        at = next((i, r[c]) for i, c in enumerate(columns) if r[c] is not None)
        for j, table in enumerate(out):
            if r[f"x{j}_1"] or r[f"x{j}_0"]:
                table[at] = (r[f"x{j}_1"], r[f"x{j}_0"])
    return out


def counted(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Bad and good rows by (feature, bin)."""
    return histograms(rows, BINNED, [F.lit(True)])[0]


def grown(rows: DataFrame, cuts: dict[str, list], barred: set[tuple[str, bool]], most: int) -> list[list[Condition]]:
    """The rules to try on ``rows``, first ones first: each as it would grow if those before it were refused; at most ``most``.

    A refused rule sets no row aside and only bars the side that it begins
    with, so the counts of all rows give every first condition.
    """
    table, barred, rules = counted(rows), set(barred), []
    while len(rules) < most and (best := best_condition(table, cuts, barred)):
        rules.append([best])
        barred.add((best.feature, best.above))
    growing = list(rules)
    while growing:
        found = [best_condition(t, cuts, set()) for t in histograms(rows, BINNED, [conjunction(r) for r in growing])]
        for rule, best in zip(growing, found, strict=True):
            rule += [best] if best else []
        growing = [rule for rule, best in zip(growing, found, strict=True) if best and len(rule) < MAX_CONDITIONS]
    return rules


def covered(rows: DataFrame, rules: list[list[Condition]]) -> list[list[tuple[int, int]]]:
    """Bad and good rows that each prefix of each rule covers."""
    held = {f"deep{j}": sum((F.when(conjunction(rule[: i + 1]), 1).otherwise(0) for i in range(len(rule))), F.lit(0)) for j, rule in enumerate(rules)}
    [table] = histograms(rows.withColumns(held), list(held), [F.lit(True)])
    return [[tuple(sum(x[k] for (at, deep), x in table.items() if at == j and deep > i) for k in (0, 1)) for i in range(len(rule))] for j, rule in enumerate(rules)]


def learn(labelled: DataFrame, max_rules: int = MAX_RULES, max_refused: int = MAX_REFUSED, min_precision: float = MIN_PRECISION, min_bound: float = MIN_BOUND) -> list[list[Condition]]:
    """Rules for bad documents from ``labelled(bad boolean, grow boolean, *FEATURES)``.

    A rule is taken if, among the pruning rows that it covers, the share of
    bad ones is at least ``min_precision`` and its lower bound at least
    ``min_bound``, so a small table asks for purity and a large one for the
    share.  At most ``max_rules`` are taken and ``max_refused`` refused.
    Labels that are null are left out; no rows, or none bad, give no rules.
    """
    rows = materialize(labelled.filter("bad is not null"))
    quantiles = rows.agg(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(quantiles[f] or ())) for f in FEATURES}
    left = materialize(rows.select("*", *(binned(f, cuts[f]).alias(b) for f, b in zip(FEATURES, BINNED, strict=True))))
    rules: list[list[Condition]] = []
    barred: set[tuple[str, bool]] = set()
    while len(rules) < max_rules and len(barred) < max_refused:
        tried = grown(left.filter("grow"), cuts, barred, max_refused - len(barred))
        if not tried:
            break
        for rule, seen in zip(tried, covered(left.filter(~F.col("grow")), tried), strict=True):
            rule, p, n = pruned(rule, seen)
            if p >= min_precision * (p + n) and lower_bound(p, n) >= min_bound:
                rules.append(rule)
                left = left.filter(~conjunction(rule))
                break
            barred.add((rule[0].feature, rule[0].above))
        else:  # none is left to try
            break
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one expression: the number of the first rule that holds, else 0 (a good document)."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(conjunction(rule), i) if out is None else out.when(conjunction(rule), i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every row of ``docs`` with ``base_failed``, ``rule`` and ``kept``.

    ``labels(doc_id, quality)`` with quality 0 for bad documents; several
    labels of a document count as the lowest, null ones not at all.  Rows that
    share an id are judged each by its own text.
    """
    stats = materialize(statistics(docs, id_col, text_col))
    return judged(stats, learn(labelled(stats, labels, id_col)))


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", held_out: bool = False) -> DataFrame:
    """The labelled rows of ``stats`` that pass the base rule, as ``learn`` takes them.

    Of five parts by a hash of the id three grow rules and one prunes them; the
    fifth (``held_out``) does neither, so that rules can be judged on it.
    """
    graded = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg((F.min("quality") == 0).alias("bad"))
    met = stats.filter(~base_failed()).join(graded, F.col(id_col) == F.col("labelled"))
    part = F.pmod(F.xxhash64("labelled"), F.lit(5))
    return met.filter(part == 0 if held_out else part > 0).select("bad", (part > 1).alias("grow"), *FEATURES)


def precision_and_recall(rules: list[list[Condition]], rows: DataFrame) -> tuple[float | None, float | None]:
    """Of the rows that a rule rejects the share of bad ones, and the share of the bad ones that one rejects; None of none."""
    hit = verdict(rules) > 0
    r = rows.agg(F.count_if(hit & F.col("bad")).alias("right"), F.count_if(hit).alias("hit"), F.count_if("bad").alias("bad")).first()
    return r.right / r.hit if r.hit else None, r.right / r.bad if r.bad else None


def judged(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    known = labels.filter("quality is not null").select(F.col("doc_id").alias(id_col)).distinct()
    with scratch(docs.sparkSession):  # written down, or the optimiser would write the statistics' expressions into the base rule
        seen = materialize(statistics(docs.select(id_col, text_col).join(known, id_col, "left_semi"), id_col, text_col))
        rules = learn(labelled(seen, labels, id_col))
    # Numbering the rows keeps the optimiser from writing the statistics' expressions into each condition of the filter.
    whole = statistics(docs, F.struct(*(F.col(c) for c in docs.columns)), text_col).withColumn("nth", F.monotonically_increasing_id())
    return judged(whole, rules).filter("kept and nth >= 0").select("carried.*")
