"""Quality rules: a threshold table compiled into one Spark projection, evaluated without user functions.

Words are runs of characters other than ASCII white space. Every metric is an integer per document; every rule compares
two of them by a fraction, in integers, so verdicts are exact and equal on any engine. Words of repeated three-word
windows are found inside the row: the windows are sorted with their positions and neighbours compared. One row a
document, no shuffle.

Defined results: a null or empty text has no words and fails; ratios with no denominator pass; repeated rows are judged
each; input columns named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import table, without

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on was are this by from at or as an not "
    "de la le les des et en un une est que qui dans du pour par sur pas avec au "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las y se por con una para su al lo como más del no"
).split()
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """`low` * over <= metric * per, and metric * per <= `high` * over (an absent bound holds); over is a metric or 1."""

    name: str
    metric: str
    over: str = "1"
    low: int | None = None
    high: int | None = None
    per: int = 1


#: The threshold table. `per` 100 makes bounds hundredths.
RULES = (
    Rule("words", "n_words", low=50),
    Rule("repeated_words", "n_repeat_words", "n_words", high=50, per=100),
    Rule("mean_word_length", "word_chars", "n_words", low=250, high=1200, per=100),
    Rule("symbols", "n_symbols", "n_words", high=10, per=100),
    Rule("stop_words", "n_stop_words", "n_words", low=2, per=100),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50, per=100),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90, per=100),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30, per=100),
)
BASE = ("words", "repeated_words")


def compile_rule(rule: Rule) -> Column:
    """Whether the rule holds."""
    value = F.col(rule.metric) * F.lit(rule.per)
    over = F.lit(1) if rule.over == "1" else F.col(rule.over)
    holds = F.lit(True)
    if rule.low is not None:
        holds = holds & (value >= over * rule.low)
    if rule.high is not None:
        holds = holds & (value <= over * rule.high)
    return holds


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the integer metrics that rules refer to. Helper columns start with two underscores."""
    of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(of, SPACE + "+"), "")
    lines = F.filter(F.split(of, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumns({"__words": words, "__lines": lines})
    m = F.size("__words") - 2
    windows = F.when(m > 1, F.sort_array(F.arrays_zip(F.slice("__words", F.lit(1), m).alias("a"), F.slice("__words", F.lit(2), m).alias("b"), F.slice("__words", F.lit(3), m).alias("c"), F.sequence(F.lit(1), m).alias("i"))))
    out = out.withColumn("__windows", windows)
    same = lambda x, y: (x["c"] == y["c"]) & (x["b"] == y["b"]) & (x["a"] == y["a"])
    none = F.array().cast("array<int>")
    starts = F.array_distinct(F.flatten(F.zip_with(F.slice("__windows", 1, F.size("__windows") - 1), F.slice("__windows", 2, F.size("__windows")), lambda x, y: F.when(same(x, y), F.array(x["i"], y["i"])).otherwise(none))))
    out = out.withColumn("__starts", F.coalesce(starts, none))
    covered = F.array_union(F.array_union("__starts", F.transform("__starts", lambda p: p + 1)), F.transform("__starts", lambda p: p + 2))
    is_stop = r"(?<!" + WORD + r")(?:" + "|".join(STOP_WORDS) + r")(?!" + WORD + r")"
    long = lambda c: c.cast("long")
    return out.withColumns({
        "n_words": long(F.size("__words")),
        "word_chars": long(F.length(F.regexp_replace(of, SPACE + "+", ""))),
        "n_symbols": long(F.length(of) - F.length(F.regexp_replace(of, "[#*$%&|<>]+", ""))),
        "n_lines": long(F.size("__lines")),
        "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
        "n_repeat_words": long(F.size(covered)),
        "n_stop_words": long(F.regexp_count(of, F.lit(is_stop))),
        "n_bullet_lines": long(F.size(F.filter("__lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")))),
        "n_ellipsis_lines": long(F.size(F.filter("__lines", lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$")))),
    })


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with the metrics, failed_rules (names, comma-joined), base_failed and kept."""
    names = (*METRICS, "failed_rules", "base_failed", "kept")
    base = without(docs, set(names) - {text})
    keep = base.columns
    # The row number keeps a later filter on the verdict above the metrics, which would be computed again for every rule.
    out = metrics(base, text).withColumn("__at", F.monotonically_increasing_id())
    failed = F.concat_ws(",", *[F.when(~compile_rule(r), F.lit(r.name)) for r in rules])
    base_failed = ~(compile_rule(RULES[0]) & compile_rule(RULES[1]))
    out = out.withColumns({"failed_rules": failed, "base_failed": base_failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "") & (F.col("__at") >= 0)).select(*[F.col(f"`{c}`") for c in keep], *names)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged."""
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *METRICS[:5], "base_failed", "kept", *METRICS[5:], "failed_rules")


def _sql_rule(r: Rule) -> str:
    parts = [f"{r.metric} * {r.per} >= {r.over} * {r.low}"] * (r.low is not None) + [f"{r.metric} * {r.per} <= {r.over} * {r.high}"] * (r.high is not None)
    return "(" + " AND ".join(parts) + ")"


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(len(list_aggregate(ws, 'string_agg', '')) AS BIGINT) AS chars,
        CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{s}'" for s in STOP_WORDS)}], x))) AS BIGINT) AS n_stop_words,
        CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
        CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines
      FROM w LEFT JOIN c USING (rid)),
n AS (SELECT * EXCLUDE (chars), coalesce(chars, 0) AS word_chars FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       NOT ({_sql_rule(RULES[0])} AND {_sql_rule(RULES[1])}) AS base_failed,
       {" AND ".join(map(_sql_rule, RULES))} AS kept, n_lines, n_stop_words, n_bullet_lines, n_ellipsis_lines,
       concat_ws(',', {", ".join(f"CASE WHEN NOT {_sql_rule(r)} THEN '{r.name}' END" for r in RULES)}) AS failed_rules
FROM n"""
