"""Operator 9: quality rules as a short-circuit cascade (DataFrame functions only).

A rule is a named Boolean ``Column`` that is true where a document fails.  One job over a
stored sample that a hash picks gives the share of rows that each rule rejects (its
selectivity) and the time that its evaluation takes, by a clock read before and after it in
each row (its cost).  What is timed is what will run: rules over features that are columns
already are timed over such columns.  Rules are then ordered by rejection per cost and
become one ``CASE``, which evaluates a later rule only for rows that pass the earlier
ones.  The order never changes the verdict, only the work.

:func:`verdicts` gives verdicts alone: every rule is one expression over the text, so the
work of a rule is spared for all rows that an earlier one rejects.  :func:`apply_rules`
also returns the features, hence computes these for all rows; of the other rules, over
words and lines, it spares the rest.

Defined cases: null text has no words and fails ``few_words``; empty texts alike;
very long texts stay in their row, and repeats are found by an in-row sort in
n log n steps; repeated rows are judged alike; an empty table keeps the rules in
the order given; columns of the input named like an output are replaced, no others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.runtime import SPACE, stored, table

#: Rows that are timed and counted to order the rules (a bound on the estimate only).
SAMPLE_ROWS = 1000
#: Seconds a row below which costs are not told apart: what comparing two numbers takes at most.
LEAST_COST = 2e-7
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, LEAST_COST)


# ---- features -----------------------------------------------------------------


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def word_chars(text: Column) -> Column:
    return F.coalesce(F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("bigint")


def n_symbols(text: Column) -> Column:
    """Characters of ``[#*$%&|<>]``."""
    return F.coalesce(F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", "")), F.lit(0)).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, and only where the whole is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_repeat_words(text: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words which occurs twice.

    Windows are hashed in the row and sorted with their positions; a window is
    repeated if its neighbour in that order has the same hash, and the covered
    words follow from the gaps between repeated positions.
    """

    def windows(w: Column) -> Column:
        at = lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(window))).alias("h"), i.alias("i"))
        return F.when(F.size(w) >= window, F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - window), at)))

    def repeated(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        marked = F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
        return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.coalesce(_let(hashed, lambda w: _let(windows(w), lambda s: _let(repeated(s), covered))), F.lit(0).cast("bigint"))


def features(text: Column) -> dict[str, Column]:
    return {"n_words": n_words(text), "word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(text)}


def with_features(docs: DataFrame) -> DataFrame:
    return docs.withColumns(features(F.col("text")))


# ---- rules ---------------------------------------------------------------------


def rules_over(text: Column, held: dict[str, Column]) -> list[Rule]:
    """All rules; ``held`` gives the features, as columns or as expressions over the text."""
    n, chars = held["n_words"], held["word_chars"]
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    share = lambda values, hit, percent: _let(values, lambda a: 100 * F.size(F.filter(a, hit)) > percent * F.size(a))
    return [
        Rule("repeats", 100 * held["n_repeat_words"] > 20 * n),
        Rule("few_words", n < 10),
        Rule("symbols", 100 * held["n_symbols"] > 40 * n),
        Rule("long_words", chars > 20 * n),
        Rule("short_words", chars < 2 * n),
        Rule("dup_lines", (held["n_dup_lines"] >= 3) & (10 * held["n_dup_lines"] > 2 * n)),
        Rule("few_letters", share(words(text), lambda w: ~w.rlike(r"\p{L}"), 50)),
        Rule("cut_lines", share(lines, lambda x: x.rlike(r"(?:[.]{3}|…)[\x20\x09-\x0D]*\z"), 30)),
        Rule("bullet_lines", share(lines, lambda x: x.rlike(r"\A[\x20\x09-\x0D]*[-*•‣▪●]"), 90)),
    ]


def rules_on_features() -> list[Rule]:
    """The rules, over the columns of :func:`with_features`."""
    return rules_over(F.col("text"), {k: F.col(k) for k in features(F.col("text"))})


def text_rules() -> list[Rule]:
    """The rules, each a single expression over the text."""
    return rules_over(F.col("text"), features(F.col("text")))


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, prepared: Callable[[DataFrame], DataFrame] = lambda sample: sample) -> DataFrame:
    """About ``rows`` texts that a hash of id and text picks over all of the input, ``prepared`` and stored; at most twice as many.

    Counting reads no column; only what the hash picks leaves a task.
    """
    keys = [F.col(f"`{c}`") for c in docs.columns if c in {"doc_id", "text"}]
    share = min(1.0, rows / max(docs.count(), 1))
    picked = docs.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int(share * (1 << 40)))
    return stored(prepared(picked.select("text").limit(2 * rows)), "sample")


def timed(hit: Column) -> Column:
    """(hit, nanoseconds) of one evaluation of ``hit`` in a row.

    It stands inside a lambda, whose struct is evaluated field by field, and from which no
    part that rules share is moved ahead of the clock.
    """
    clock = lambda: F.expr("cast(reflect('java.lang.System', 'nanoTime') as bigint)")
    read = F.get(F.transform(F.array(F.lit(0)), lambda _: F.struct(clock().alias("begun"), F.coalesce(hit, F.lit(True)).alias("hit"), clock().alias("ended"))), F.lit(0))
    return _let(read, lambda r: F.struct(r["hit"].alias("hit"), (r["ended"] - r["begun"]).alias("ns")))


def estimate(sample: DataFrame, rules: list[Rule]) -> list[Estimate]:
    """Selectivity and cost (seconds a row, the clock's own time taken off) of all rules, from one job over the sample."""
    columns = [timed(F.lit(False)).alias("r0"), *(timed(rule.fails).alias(f"r{k}") for k, rule in enumerate(rules, 1))]
    sums = [c for k in range(len(columns)) for c in (F.count_if(F.col(f"r{k}.hit")), F.coalesce(F.sum(F.col(f"r{k}.ns")), F.lit(0)))]
    n, _, clock, *found = sample.select(*columns).agg(F.count(F.lit(1)), *sums).first()
    n = max(n, 1)
    return [Estimate(rule.name, max((ns - clock) / n / 1e9, LEAST_COST), bad / n) for rule, bad, ns in zip(rules, found[::2], found[1::2], strict=True)]


def cascade(rules: list[Rule], estimates: list[Estimate]) -> Column:
    """The name of the first rule that fails in the order found, or null; of rules alike, the cheaper goes first."""
    known = {e.name: (-e.worth, e.seconds) for e in estimates}
    ordered = sorted(rules, key=lambda r: known.get(r.name, (0.0, 0.0)))
    out = F.when(F.coalesce(ordered[0].fails, F.lit(True)), F.lit(ordered[0].name))
    for rule in ordered[1:]:
        out = out.when(F.coalesce(rule.fails, F.lit(True)), F.lit(rule.name))
    return out


def _judged(docs: DataFrame, rules: list[Rule], estimates: list[Estimate]) -> DataFrame:
    return docs.withColumn("failed_rule", cascade(rules, estimates)).withColumn("kept", F.col("failed_rule").isNull())


def verdicts(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``failed_rule`` (null if kept) and ``kept``; no feature is computed for rows that an earlier rule rejects."""
    rules = rules or text_rules()
    return _judged(docs, rules, estimate(sample_of(docs), rules))


def apply_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with the features, ``failed_rule`` (null if kept) and ``kept``."""
    rules = rules_on_features()
    estimates = estimate(sample_of(docs, prepared=with_features), rules)
    return _judged(with_features(docs), rules, estimates)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i:i + 4] AS g, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1)::BIGINT)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2, 3, 4]) AS o FROM win WHERE c >= 2) GROUP BY doc_id
), ln AS (
  SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines, count(*) AS n_lines,
         count(*) FILTER (WHERE regexp_matches(l, '(?:[.]{3}|…)[\x20\x09-\x0D]*$')) AS n_cut,
         count(*) FILTER (WHERE regexp_matches(l, '^[\x20\x09-\x0D]*[-*•‣▪●]')) AS n_bullet
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_no_letter, coalesce(n_lines, 0) AS n_lines, coalesce(n_cut, 0) AS n_cut, coalesce(n_bullet, 0) AS n_bullet,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN ln ON d.doc_id = ln.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 40 * n_words
            OR word_chars > 20 * n_words OR word_chars < 2 * n_words
            OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 2 * n_words)
            OR 100 * n_no_letter > 50 * n_words OR 100 * n_cut > 30 * n_lines OR 100 * n_bullet > 90 * n_lines) AS kept
FROM f
"""
