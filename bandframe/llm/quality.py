"""Quality rules: base statistics of a text and learned decision lists, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandframe.llm.store import cut

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_upper", "n_dup_lines", "n_repeat_words")


def base_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Per row: id, n_words, word_chars, n_symbols, n_upper, n_dup_lines, n_repeat_words.

    Words are ``[^\x20\x09-\x0D]+``. word_chars: code points in words. n_symbols: characters of
    ``[#*$%&|<>]``. n_upper: characters A-Z. n_dup_lines: lines with a word that equal an earlier line of the text.
    n_repeat_words: words inside windows of three words that occur twice or more in the text.

    Windows are told by 64-bit hashes and sorted within the row, so nothing shuffles and a long text
    takes n log n steps. Null text gives zeros. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    rows = rows.select(
        "id", F.size("w").cast("bigint").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("n_upper"), lines.alias("lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    window = lambda i: F.struct(F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).alias("g"), i.alias("i"))
    grams = F.when(F.size("h") > 2, F.array_sort(F.transform(F.sequence(F.lit(0), F.size("h") - 3), window)))
    rows = rows.select("id", *BASE[:4], (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), grams.alias("s"))
    same = lambda x, i: F.coalesce((i > 0) & (F.get("s", F.greatest(i - 1, F.lit(0)))["g"] == x["g"]), F.lit(False)) | F.coalesce(F.get("s", i + 1)["g"] == x["g"], F.lit(False))
    rows = rows.select("id", *BASE[:5], F.array_sort(F.transform(F.filter("s", same), lambda x: x["i"])).alias("p"))
    covered = F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3))))
    return rows.select(
        F.col("id").alias(id_col), *BASE[:5],
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """What the learned conditions look at, all defined for a text without words."""
    per = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "repeated_part": per("n_repeat_words"), "symbols_per_word": per("n_symbols"),
        "chars_per_word": per("word_chars"), "dup_lines_per_word": per("n_dup_lines"), "capitals_per_char": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    """A measure above a threshold, or not above it."""

    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = measures()[self.measure]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    """Whether all conditions of a rule hold."""
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gain of a condition that leaves p of p0 bad and n of n0 good rows."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _bin(measure: str, edges: list[float], first: int = 0) -> str:
    """SQL for how many of the sorted edges a measure is above."""
    if not edges:
        return str(first)
    k = len(edges) // 2
    return f"if({measure} > {edges[k]!r}D, {_bin(measure, edges[k + 1 :], first + k + 1)}, {_bin(measure, edges[:k], first)})"


def learn_rules(
    stats: DataFrame, labels: DataFrame, *, max_rules: int = 8, max_conditions: int = 3, cuts: int = 32, precision: float = 0.9, support: int = 10, id_col: str = "doc_id", label_col: str = "quality"
) -> list[Rule]:
    """Sequential covering: rules that tell rows labelled 0 from rows labelled 1.

    Two thirds of the labelled rows (by a hash of the id) grow a rule, condition by condition, by
    information gain; the rest prunes it to the prefix with the best (bad - good) / (bad + good).
    A rule that isn't right for ``precision`` of the rows of each part that it covers, or covers
    fewer than ``support`` in all, is dropped, and the next one starts with another measure or
    direction; the list ends when none is left. Covered rows leave before the next rule.

    Thresholds are quantiles of the bad and of the good rows that the rule so far leaves open: each
    ``1 / cuts``, and at both ends halving steps down to 1/4096. So a rare kind has its own. A
    threshold ends up in the middle of the gap between the values around it.

    Spark counts all labelled rows; the driver gets, for each condition grown, at most
    2 * (``cuts`` + 13) quantiles and counts per measure. Rows without a label,
    labels other than 0 and 1, and labels of unknown ids take no part; repeated labels all count.
    No bad rows give no rules.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label"))
    rows = stats.join(marks, F.col(id_col) == F.col("label_id")).select(*BASE, (F.col("label") == 0).alias("bad"), (F.pmod(F.xxhash64("label_id"), F.lit(3)) > 0).alias("grow"))
    rows = cut(rows.select("*", *(c.alias(m) for m, c in measures().items())), "labelled")
    tails = [2.0**-k for k in range(1, 13) if 2**k > cuts]
    parts = F.array(*map(F.lit, sorted({*tails, *(k / cuts for k in range(1, cuts)), *(1 - t for t in tails)})))
    tally = (F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).alias("p"), F.coalesce(F.sum((~F.col("bad")).cast("int")), F.lit(0)).alias("n"))
    rules: list[Rule] = []
    failed: set[tuple[str, bool]] = set()
    while len(rules) < max_rules:
        rule: Rule = ()
        p0, n0 = rows.where("grow").agg(*tally).first()
        while p0 and n0 and len(rule) < max_conditions:
            left = rows.where(F.col("grow") & holds(rule))
            ends = left.agg(*(F.percentile_approx(F.when(F.col("bad") == bad, F.col(m)), parts, 10_000).alias(f"{m}_{bad}") for m in measures() for bad in (True, False))).first()
            edges = {m: sorted({*ends[f"{m}_True"], *ends[f"{m}_False"]}) for m in measures()}
            bins = F.expr("array(" + ", ".join(f"struct('{m}' AS m, {_bin(m, edges[m])} AS bin)" for m in edges) + ")")
            seen = left.select("bad", F.explode(bins).alias("b")).groupBy("b.m", "b.bin").agg(*tally).collect()
            best = (0.0, None, 0, 0)
            for m in sorted(edges):
                below_p = below_n = 0
                counts = {r["bin"]: (r["p"], r["n"]) for r in seen if r["m"] == m}
                for i, edge in enumerate(edges[m]):  # a bin holds the values up to its edge
                    p, n = counts.get(i, (0, 0))
                    below_p, below_n = below_p + p, below_n + n
                    for above, (p, n) in ((False, (below_p, below_n)), (True, (p0 - below_p, n0 - below_n))):
                        if rule or (m, above) not in failed:
                            best = max(best, (_gain(p, n, p0, n0), Condition(m, above, edge), p, n), key=lambda x: x[0])
            if best[1] is None:
                break
            rule, p0, n0 = (*rule, best[1]), best[2], best[3]
        if not rule:
            break
        heads = [rule[: k + 1] for k in range(len(rule))]
        sums = [F.coalesce(F.sum((F.col("bad") == bad).cast("int") * (F.col("grow") == grow).cast("int") * holds(h).cast("int")), F.lit(0)) for h in heads for grow in (True, False) for bad in (True, False)]
        got = rows.agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first()
        of = lambda k: tuple(got[4 * k : 4 * k + 4])  # noqa: E731  bad and good to grow, bad and good to prune
        worth = lambda k: (of(k)[2] - of(k)[3]) / max(of(k)[2] + of(k)[3], 1)
        k = max(range(len(heads)), key=lambda k: (worth(k), -k))
        p, n, p2, n2 = of(k)
        if p + p2 + n + n2 < support or p < precision * (p + n) or p2 < precision * (p2 + n2):
            failed.add((rule[0].measure, rule[0].above))
            continue
        values = [measures()[c.measure] for c in heads[k]]
        gaps = rows.agg(*(x for v, c in zip(values, heads[k]) for x in (F.max(F.when(v <= c.threshold, v)), F.min(F.when(v > c.threshold, v))))).first()
        middle = lambda lo, hi, c: c.threshold if lo is None or hi is None else (lo + hi) / 2
        rules.append(tuple(Condition(c.measure, c.above, middle(gaps[2 * i], gaps[2 * i + 1], c)) for i, c in enumerate(heads[k])))
        rows = rows.where(~holds(heads[k]))
        failed.clear()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: false at the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(holds(rules[0]), False)
    for rule in rules[1:]:
        out = out.when(holds(rule), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the base statistics, base_failed, kept (whether neither the base nor a rule drops it), and n_upper.

    The statistics of all rows are computed once and written; learning and judging read them. The
    rules are learned from the labelled rows that the base passes.
    """
    stats = cut(base_statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    rules = learn_rules(stats.where(~base_failed()), labels, id_col=id_col)
    first = [c for c in stats.columns if c != "n_upper"]
    return stats.select(*first, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"), "n_upper")
