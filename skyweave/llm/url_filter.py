"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Features are lengths, depth, digit ratio, character entropy, hyphens, parameter counts and suffix statistics: the share
of blocked urls among the labelled ones of a host's last label, of its last two labels, and of a path's first part,
smoothed and leaving the row itself out, in training as in scoring. The trees are fitted on labelled urls, weighted so
that both labels count alike: those of `labelled`, a table of (url, blocked), or else the urls that a rule decides, so
that the trees carry the rules' judgement over to urls that no rule names. At most `sample` labelled urls are used,
those of the smallest hash, so the sample is the same however the table is partitioned; the statistics are of all.
Fitting and scoring are Spark's own; no Python runs on executors.

Defined results: a null url, or one without `://`, has an empty host and path and fits no rule; the trees judge it like
any other; with no labelled urls of both kinds there is nothing to learn and unruled urls are allowed; a url labelled
both ways counts as blocked; repeated rows get equal verdicts; input columns named like an output column are replaced.
Of two rules that fit with equal length (hosts and paths), the first listed wins.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import materialize, salted_join, table, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (verdict, rule). A rule is a host (with its subdomains) and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Suffix statistics: the name of each and the text it groups by.
SUFFIXES = {"tld": lambda host, path: F.substring_index(host, ".", -1), "suffix": lambda host, path: F.substring_index(host, ".", -2), "start": lambda host, path: F.regexp_extract(path, "^/[^/]*/?", 0)}
SAMPLE, TREES, DEPTH, PRIOR = 20_000, 10, 3, 20
#: Suffixes broadcast at most; beyond, a join in slices finds them.
MOST_SUFFIXES = 100_000
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789.-_/?=&%+#:~"
FEATURES = ("host_length", "path_length", "url_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "parameters", "entropy", "longest_label", "has_fragment", "percent_signs", *(f"{name}_{kind}" for name in SUFFIXES for kind in ("block", "count")))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(known, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(known, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of (verdict, rule); null if none does."""
    cases = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases if cases is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need no other row."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    low = F.lower(known)
    n = F.length(known)
    gone = lambda c, form: (F.length(c) - F.length(F.regexp_replace(c, form, ""))).cast("double")
    entropy = F.lit(0.0)
    for c in CHARACTERS:
        share = (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / n
        entropy = entropy - F.when(share > 0, share * F.log(share)).otherwise(0.0) / math.log(2)
    return {
        "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"), "url_length": n.cast("double"),
        "depth": gone(path, "/"), "labels": gone(host, r"\."), "digit_ratio": F.when(n > 0, gone(known, "[0-9]") / n).otherwise(0.0),
        "host_digits": gone(host, "[0-9]"), "hyphens": gone(host, "-"), "parameters": gone(known, "[?&]"),
        "entropy": F.when(n > 0, entropy).otherwise(0.0), "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))).cast("double"),
        "has_fragment": F.contains(known, F.lit("#")).cast("double"), "percent_signs": gone(known, "%"),
    }


def judge(pages: DataFrame, url: str = "url", rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """`pages` with host, path, rule, verdict, score (the trees' probability of block; null where a rule decides).

    `labelled` has the columns url (string) and blocked (boolean); without it the rules' own verdicts are the labels.
    """
    names = ("host", "path", "rule", "verdict", "score")
    base = without(pages, set(names) - {url})
    keep = base.columns
    host, path = split_url(F.col(f"`{url}`"))
    rows = base.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{url}`").cast("string").alias("u"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        named = rows.where("fit is not null").select("u", (F.col("fit.verdict") == "block").cast("double").alias("label"))
    else:
        named = labelled.select(F.col("url").cast("string").alias("u"), F.col("blocked").cast("double").alias("label")).where("u is not null and label is not null")
    named = named.groupBy("u").agg(F.max("label").alias("label"))
    host, path = split_url(F.col("u"))
    named = materialize(named.withColumns({"host": host, "path": path, "h": F.xxhash64("u")}), "labelled")
    whole = named.agg(F.sum("label").alias("bad"), F.count("*").alias("n")).first()
    plain = F.coalesce("fit.verdict", F.lit("allow"))
    if not whole.n or not 0 < whole.bad < whole.n:
        return rows.select("row.*", "host", "path", F.col("fit.rule").alias("rule"), plain.alias("verdict"), F.lit(None).cast("double").alias("score"))
    share = whole.bad / whole.n
    statistics = {name: materialize(named.groupBy(of(F.col("host"), F.col("path")).alias(name)).agg(F.sum("label").alias("bad"), F.count("*").alias("n")), name) for name, of in SUFFIXES.items()}
    least = named.select("h").orderBy("h").limit(sample).agg(F.max("h").alias("h")).first().h
    train = named.where(F.col("h") <= least).withColumn("weight", F.when(F.col("label") == 1.0, 0.5 / share).otherwise(0.5 / (1 - share)))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=32, subsamplingRate=1.0, weightCol="weight").fit(_vectors(train, statistics, share))
    # Urls that a rule decides need no score; if labels come from a table, others may have one, which is left out of their statistics.
    open_rows = rows.where("fit is null")
    known = open_rows.withColumn("label", F.lit(None).cast("double")) if labelled is None else salted_join(open_rows, named.select("u", "label"), ["u"], "row", "left")
    scored = model.transform(_vectors(known, statistics, share))
    from pyspark.ml.functions import vector_to_array

    judged = scored.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("prediction") == 1.0, "block").otherwise("allow").alias("verdict"), F.element_at(vector_to_array("probability"), 2).alias("score"))
    ruled = rows.where("fit is not null").select("row.*", "host", "path", F.col("fit.rule").alias("rule"), plain.alias("verdict"), F.lit(None).cast("double").alias("score"))
    return judged.union(ruled)


def _vectors(rows: DataFrame, statistics: dict[str, DataFrame], share: float) -> DataFrame:
    """`rows` with their features assembled. A row with a label leaves itself out of its statistics."""
    out = rows.withColumns(lexical(F.col("u"), F.col("host"), F.col("path")))
    own, one = F.coalesce("label", F.lit(0.0)), F.col("label").isNotNull().cast("int")
    for name, of in SUFFIXES.items():
        key = of(F.col("host"), F.col("path")).alias(name)
        out = out.withColumn(name, key)
        if statistics[name].count() <= MOST_SUFFIXES:
            out = out.join(F.broadcast(statistics[name]), name, "left")
        else:  # suffixes are hot keys by nature
            out = salted_join(out, statistics[name], [name], "u", "left", counts=rows.groupBy(key).agg(F.count("*").alias("rows")))
        bad, n = F.coalesce("bad", F.lit(0.0)) - own, F.coalesce("n", F.lit(0)) - one
        out = out.withColumns({f"{name}_block": (bad + share * PRIOR) / (n + PRIOR), f"{name}_count": F.log1p(n.cast("double"))}).drop("bad", "n", name)
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(out)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
