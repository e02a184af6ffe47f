"""Quality rules: text statistics and a decision list learned from labelled statistics by sequential covering.

Statistics and verdicts are DataFrame expressions over each text, without a shuffle of documents. Rules are grown on
two thirds of a bounded labelled sample, pruned on the rest, and come out as one ordered Spark conditional.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read, words

#: Size of the windows whose repetition counts.
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: ratios, so that a rule means the same for short and long texts.
FEATURES = ("symbols_per_word", "dup_line_share", "repeat_share", "chars_per_word", "upper_share", "digit_share", "mark_share", "distinct_share", "one_char_share")


def _repeats(hashes: Column) -> Column:
    """How many positions the windows cover whose hash is in the array twice or more."""

    def covered(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)

    def slow(s: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return let(F.sort_array(F.transform(F.filter(s, lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["i"])), covered)

    pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs(h), slow)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS (long) and FEATURES (double; 0 where a text has no words) of each row.

    Windows are compared by 64-bit hashes of eight 64-bit word hashes. A null text has no words; repeated rows give
    repeated results; an empty table gives none; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select("doc_id", "_t", words(F.col("_t")).alias("_w"))
    windows = let(F.transform("_w", lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))
    without = lambda pattern: F.length(F.regexp_replace("_t", pattern, ""))
    rows = rows.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        bare.cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).alias("n"))).alias("_l"),
        F.when(F.size("_w") > WINDOW, _repeats(windows)).otherwise(0).cast("long").alias("n_repeat_words"),
        (F.length("_t") - without(r"\p{Lu}+")).alias("_upper"),
        (F.length("_t") - without(r"[0-9]+")).alias("_digit"),
        (F.length("_t") - without(r"[^\p{L}\p{N}\x20\x09-\x0D]+")).alias("_mark"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        F.size(F.filter("_w", lambda w: F.length(w) == 1)).alias("_one"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = rows.withColumns({"n_dup_lines": F.col("_l.dup"), "_lines": F.col("_l.n")})
    values = (("n_symbols", "n_words"), ("n_dup_lines", "_lines"), ("n_repeat_words", "n_words"), ("word_chars", "n_words"), ("_upper", "word_chars"), ("_digit", "word_chars"), ("_mark", "word_chars"), ("_distinct", "n_words"), ("_one", "n_words"))
    return rows.select("doc_id", *COUNTS, *[share(a, b).alias(name) for name, (a, b) in zip(FEATURES, values, strict=True)])


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction of (feature, ">" or "<=", threshold); the first that holds rejects."""

    rules: tuple[tuple[tuple[str, str, float], ...], ...] = field(default=())

    def condition(self, rule: tuple[tuple[str, str, float], ...]) -> Column:
        test = F.lit(True)
        for name, op, threshold in rule:
            test = test & ((F.col(name) > threshold) if op == ">" else (F.col(name) <= threshold))
        return test

    def rejected_by(self) -> Column:
        """The number of the first rule that holds, from 1; 0 if none."""
        verdict = None
        for k, rule in enumerate(self.rules, 1):
            verdict = F.when(self.condition(rule), k) if verdict is None else verdict.when(self.condition(rule), k)
        return F.lit(0) if verdict is None else verdict.otherwise(0)


def _covers(rule, row: dict) -> bool:
    return all(row[f] > t if op == ">" else row[f] <= t for f, op, t in rule)


def _grow(rows: list[dict], max_terms: int, n_cuts: int) -> list[tuple[str, str, float]]:
    """Adds the condition of most information gain (FOIL's) until no good row is covered."""
    rule: list[tuple[str, str, float]] = []
    while len(rule) < max_terms:
        p = sum(r["_bad"] for r in rows)
        if p == len(rows) or not p:
            break
        base, best = math.log2(p / len(rows)), (1e-9, None)
        for f in FEATURES:
            values = sorted(r[f] for r in rows)
            cuts = sorted({values[(len(values) - 1) * i // n_cuts] for i in range(n_cuts)})
            ordered = sorted((r[f], r["_bad"]) for r in rows)
            at, seen, bad = 0, 0, 0
            for cut in cuts:
                while at < len(ordered) and ordered[at][0] <= cut:
                    seen, bad, at = seen + 1, bad + ordered[at][1], at + 1
                for op, n, q in (("<=", seen, bad), (">", len(rows) - seen, p - bad)):
                    if q and (gain := q * (math.log2(q / n) - base)) > best[0]:
                        best = gain, (f, op, cut)
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if _covers(rule[-1:], r)]
    return rule


def learn(rows: list[dict], min_precision: float = 0.9, min_covered: int = 3, max_rules: int = 12, max_terms: int = 4, n_cuts: int = 64) -> DecisionList:
    """Sequential covering over rows with FEATURES and _bad (0 or 1), in the order given.

    Every third row prunes: the shortest prefix of a grown rule with the best (bad - good) / covered there stays. Learning
    ends with the first rule that covers too few pruning rows or is not precise enough on them. No rows: no rules.
    """
    grow, prune, rules = [r for i, r in enumerate(rows) if i % 3], rows[::3], []
    while len(rules) < max_rules and any(r["_bad"] for r in grow):
        rule, best = _grow(grow, max_terms, n_cuts), (-2.0, 0)
        for k in range(1, len(rule) + 1):
            hit = [r["_bad"] for r in prune if _covers(rule[:k], r)]
            worth = (2 * sum(hit) - len(hit)) / len(hit) if hit else -1
            if worth > best[0] + 1e-12:
                best = worth, k
        rule = rule[: best[1]]
        hit = [r["_bad"] for r in prune if rule and _covers(rule, r)]
        if len(hit) < min_covered or sum(hit) < min_precision * len(hit):
            break
        rules.append(tuple(rule))
        grow, prune = ([r for r in part if not _covers(rule, r)] for part in (grow, prune))
    return DecisionList(tuple(rules))


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> list[dict]:
    """Statistics of at most max_rows labelled documents, those first by a hash of doc_id; bad: quality 0.

    A document labelled both ways counts as bad; of rows that repeat an id, the one with the least hash of its text.
    """
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q"))
    sample = one.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    single = chosen.groupBy("doc_id", "_q").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = statistics(single.select(F.struct("doc_id", "_q").alias("doc_id"), "text")).select("doc_id.doc_id", *FEATURES, (1 - F.col("doc_id._q")).cast("int").alias("_bad"))
    return [r.asDict() for r in sorted(rows.collect(), key=lambda r: (hash_order(r["doc_id"]), r["doc_id"]))]


def hash_order(i: int) -> int:
    """Mixes an id, so that growing and pruning rows don't follow the order of ids."""
    i = (i ^ (i >> 30)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    return (i ^ (i >> 27)) * 0x94D049BB133111EB & (2**64 - 1)


def verdicts(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """statistics() with base_failed, the rule that rejects (0: none) and kept."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = statistics(docs, id_col, text_col).withColumns({"base_failed": base, "rule": rules.rejected_by()})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = learn(labelled_statistics(docs, read(spark, sf_dir, "labels")))
    return verdicts(docs, rules).select("doc_id", *COUNTS, "base_failed", "kept", "rule")
