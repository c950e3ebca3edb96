"""Fill-in-middle transformation of whole texts, in Spark SQL expressions alone.

A text is cut into lines; the SHA-256 of a seed and the document's id gives, as 32-bit numbers, two cuts, whether the
text is transformed, and which arrangement it takes: prefix-suffix-middle or suffix-prefix-middle, each part behind its
sentinel. The arrangement is parsed back at its sentinels, so every row proves that its text is restored. Work is one
projection a document: no shuffle, no user functions, and the arrays of a text's lines are all that is held beside it.

Defined results: a null text reads as an empty one; an empty text, and one that holds a sentinel, stays plain; a text of
one line gives empty parts around it; very long texts are cut whole; a null id hashes as no digits; repeated rows are
transformed alike, as nothing but id and text decides; an empty table gives an empty one; input columns named like an
output column are replaced, all others carried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import table, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"
SEED, RATE, SPM_RATE = 7, 100, 50
NAMES = ("n", "form", "prefix", "middle", "suffix", "output")


def _draw(seed: int, key: Column, k: int) -> Column:
    """The k-th 8-digit group of the key's hash, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = UNIT, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """`docs` with n (units), form (plain, psm or spm), prefix, middle and suffix (null if plain) and output.

    `rate` of 100 texts are transformed, `spm_rate` of 100 of these to suffix-prefix-middle. No sentinel may start with
    what another one ends with: a text's own characters could then complete one.
    """
    for s in sentinels:
        if not s or any(a.endswith(s[:k]) for a in sentinels for k in range(1, len(s))):
            raise ValueError(f"sentinel {s!r} can't be told from a text's end")
    p, s, m = (F.lit(x) for x in sentinels)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = without(docs, set(NAMES) - {text, key})
    out = base.withColumns({"__text": whole, "__units": F.regexp_extract_all(whole, F.lit(unit), F.lit(0))})
    n, draw = F.size("__units"), lambda k: _draw(seed, F.col(key), k)
    cuts = [F.pmod(draw(k), n + 1).cast("int") for k in (0, 1)]
    held = F.contains("__text", p) | F.contains("__text", s) | F.contains("__text", m)
    plain = (F.length("__text") == 0) | held | (draw(2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(3) % 100 < spm_rate, "spm").otherwise("psm")
    out = out.withColumns({"__n": n, "__form": form, "__a": F.least(*cuts), "__b": F.greatest(*cuts)})
    part = lambda start, length: F.when(F.col("__form") != "plain", F.array_join(F.slice("__units", start, length), ""))
    out = out.withColumns({"__prefix": part(F.lit(1), F.col("__a")), "__middle": part(F.col("__a") + 1, F.col("__b") - F.col("__a")), "__suffix": part(F.col("__b") + 1, F.col("__n") - F.col("__b"))})
    arranged = F.when(F.col("__form") == "psm", F.concat(p, "__prefix", s, "__suffix", m, "__middle")).when(F.col("__form") == "spm", F.concat(s, "__suffix", p, "__prefix", m, "__middle")).otherwise(F.col("__text"))
    made = {"n": F.col("__n").cast("long"), "form": F.col("__form"), "prefix": F.col("__prefix"), "middle": F.col("__middle"), "suffix": F.col("__suffix"), "output": arranged}
    return out.select(*[F.col(f"`{c}`") for c in base.columns if c.lower() not in NAMES], *[made[x].alias(x) for x in NAMES])


def restore(transformed: DataFrame, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """`transformed` with `restored`: the text, from nothing but an output and its form."""
    base = without(transformed, {"restored"} - {output, form})
    parts = F.split(F.col(output), "|".join(map(_quoted, sentinels)), -1)
    at = lambda k: F.element_at("__parts", k)  # noqa: E731  (the first part, before any sentinel, is empty)
    back = F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(at(2), at(4), at(3))).otherwise(F.concat(at(3), at(4), at(2)))
    out = base.withColumn("__parts", F.when(F.col(form) != "plain", parts))
    return out.select(*[F.col(f"`{c}`") for c in base.columns if c.lower() != "restored"], back.alias("restored"))


def _quoted(sentinel: str) -> str:
    return re.sub(r"([^\w\s<>])", r"\\\1", sentinel)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, and restored from what it became."""
    out = restore(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    chars = lambda c: F.length(c).cast("long")
    return out.select("doc_id", "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS r FROM d),
c AS (SELECT *, len(us) AS n, least(r[1] % (len(us) + 1), r[2] % (len(us) + 1)) AS a, greatest(r[1] % (len(us) + 1), r[2] % (len(us) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS pre, coalesce(array_to_string(us[a + 1:b], ''), '') AS mid, coalesce(array_to_string(us[b + 1:n], ''), '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p),
s AS (SELECT *, strpos(output, '<P>') AS at_p, strpos(output, '<S>') AS at_s, strpos(output, '<M>') AS at_m FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN substr(output, at_p + 3, at_s - at_p - 3) || substr(output, at_m + 3) || substr(output, at_s + 3, at_m - at_s - 3)
              ELSE substr(output, at_p + 3, at_m - at_p - 3) || substr(output, at_m + 3) || substr(output, at_s + 3, at_p - at_s - 3) END) AS restored_sha256
FROM s"""
