"""Row contracts as tables: what each survey's rows must hold, compiled into one projection.

A contract is rows of (survey, rule, kind, column, argument, action), in order. The first rule that a row fails gives its
reason; what follows depends on the rule's action: `exclude` sets the row aside with the reason, `break` is an error with
the rule's name when the row is read, or, in quarantine, a reason that starts with 'broken:'.

| kind | argument | a value fits if |
|---|---|---|
| present | | it isn't null or blank |
| longest | n | its text has at most n characters |
| number | an interval, [a,b] with ( or ) for an open end, either end may be left out | it is a number in it |
| whole | an interval | it is an integer in it |
| multiple | n | it is a multiple of n |
| pattern | a regular expression | all of its text matches |
| one_of | values, comma-separated | it is one of them, whatever the case |
| text | a template with {columns} | its text is the template filled in |
| part | column ~ a regular expression with one group | it equals the group in that column, as numbers if both are |
| mapped | column: a=b, c=d | it is what the other column's value maps to |
| below | column | it is less than the other column |
| is | a value | its text is that value |

Defined results: a null fails every rule; a column name that ends with ? lets null pass; a row of a survey without a contract has
the reason 'no-contract'; a rule of an unknown kind or column, or a contract of more than MOST rules, is an error when it
is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Rules of one compiled table.
MOST = 2_000
FIELDS = ("survey", "rule", "kind", "column", "argument", "action")


def parse(text: str) -> list[Row]:
    """Rules written one a line, fields separated by ' | '; blank lines and those that start with # are skipped."""
    rows = []
    for line in text.strip().splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            parts = [p.strip() for p in line.split(" | ")]
            if len(parts) != len(FIELDS):
                raise ValueError(f"a rule has {len(FIELDS)} fields: {line}")
            rows.append(Row(**dict(zip(FIELDS, parts, strict=True))))
    return rows


def rules_of(table: DataFrame) -> list[Row]:
    """The rules of a table (FIELDS and number, their order); a contract is small, and its size is checked."""
    rows = table.select("number", *FIELDS).orderBy("survey", "number").limit(MOST + 1).collect()
    return [Row(**{f: r[f] or "" for f in FIELDS}) for r in rows]


def _interval(text: str, value: Column) -> Column:
    found = re.fullmatch(r"([\[(])\s*([^,]*?)\s*,\s*([^,]*?)\s*([\])])", text)
    if not found:
        raise ValueError(f"not an interval: {text}")
    left, low, high, right = found.groups()
    fits = value.isNotNull() & ~F.isnan(value)
    if low:
        fits = fits & ((value >= float(low)) if left == "[" else (value > float(low)))
    if high:
        fits = fits & ((value <= float(high)) if right == "]" else (value < float(high)))
    return fits


def _filled(template: str) -> Column:
    parts = [F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts) if parts else F.lit("")


def _fits(kind: str, column: str, argument: str) -> Column:
    """Whether a row's value fits; null only where the value or what it is compared with is null."""
    c = F.col(column)
    text, number = c.cast("string"), c.cast("string").try_cast("double")
    if kind == "present":
        return F.trim(text) != ""
    if kind == "longest":
        return F.length(text) <= int(argument)
    if kind == "number":
        return _interval(argument, number)
    if kind == "whole":
        return _interval(argument, number) & (number == F.floor(number))
    if kind == "multiple":
        return number % int(argument) == 0
    if kind == "pattern":
        return text.rlike(f"^(?:{argument})\\z")
    if kind == "one_of":
        return F.upper(text).isin([v.strip().upper() for v in argument.split(",")])
    if kind == "text":
        return text == _filled(argument)
    if kind == "part":
        other, pattern = (x.strip() for x in argument.split("~", 1))
        part = F.regexp_extract(F.col(other).cast("string"), pattern, 1)
        return (part != "") & F.coalesce(number == part.try_cast("double"), text == part)
    if kind == "mapped":
        other, pairs = argument.split(":", 1)
        to = [p.split("=") for p in pairs.split(",")]
        return text == F.coalesce(*[F.when(F.col(other.strip()).cast("string") == a.strip(), F.lit(b.strip())) for a, b in to])
    if kind == "below":
        return number < F.col(argument).cast("string").try_cast("double")
    if kind == "is":
        return text == argument
    raise ValueError(f"unknown kind of rule: {kind}")


def _checked(rules: list[Row], columns: Iterable[str]) -> None:
    have = {c.lower() for c in columns}
    if len(rules) > MOST:
        raise ValueError(f"more than {MOST} rules")
    for r in rules:
        if r.action not in ("break", "exclude"):
            raise ValueError(f"unknown action of rule {r.survey}.{r.rule}: {r.action}")
        named = re.findall(r"\{(\w+)\}", r.argument) if r.kind == "text" else [re.split("[~:]", r.argument)[0].strip()] if r.kind in ("part", "mapped", "below") else []
        for c in [r.column.removesuffix("?"), *named]:
            if c.lower() not in have:
                raise ValueError(f"rule {r.survey}.{r.rule} names no column: {c}")


def _fault(r: Row, quarantine: bool) -> Column:
    """What a rule says of a row of its survey; null if it fits."""
    name = r.column.removesuffix("?")
    fits = F.coalesce(_fits(r.kind, name, r.argument), F.lit(False))
    fits = fits | F.col(name).isNull() if r.column.endswith("?") else fits
    said = F.lit(r.rule)
    if r.action == "break":
        said = F.lit(f"broken:{r.rule}") if quarantine else F.raise_error(F.lit(f"row contract broken: {r.survey}.{r.rule}"))
    return F.when(~fits, said)


def _always(value: Column):
    return lambda _: value


def judged(rows: DataFrame, rules: Iterable[Row], survey: str = "survey", quarantine: bool = False) -> DataFrame:
    """`rows` with their reason (null: accepted), all surveys by one projection; a row is tried by its own survey's rules alone.

    A survey's rules stand in a lambda: Spark evaluates its body as it stands, and generates a call of it alone. So the
    generated code grows by a call a survey, and is compiled however many rules there are (as one expression, 48 rules
    already pass the 64 KB of a method).
    """
    rules = list(rules)
    _checked(rules, rows.columns)
    by_survey: dict[str, list[Row]] = {}
    for r in rules:
        by_survey.setdefault(r.survey, []).append(r)
    reason = F.lit("no-contract")
    for name, own in by_survey.items():
        faults = F.coalesce(*[_fault(r, quarantine) for r in own], F.lit(None).cast("string"))
        first = F.get(F.transform(F.array(F.lit(0)), _always(faults)), F.lit(0))
        reason = F.when(F.col(survey) == name, first).otherwise(reason)
    return rows.withColumn("reason", reason)


#: What rows of six surveys must hold.
SURVEYS = parse(r"""
sdss   | identity       | longest  | unit_id    | 160                                             | break
sdss   | run            | whole    | run        | [1,]                                            | break
sdss   | camcol         | whole    | camcol     | [1,6]                                           | break
sdss   | field          | whole    | field      | [0,]                                            | break
sdss   | rerun          | is       | rerun      | 301                                             | break
sdss   | photo-status   | is       | status     | 0                                               | break
sdss   | own-name       | text     | unit_id    | {run}/{rerun}/{camcol}/{field}                  | break
sdss   | no-region      | present  | region     |                                                 | exclude
iphas  | file-name      | pattern  | file_name  | [rR]\d{6}-[1-4]\.fits\.fz                       | break
iphas  | run            | part     | run        | file_name ~ ^[rR](\d{6})-                       | break
iphas  | ccd            | part     | ccd        | file_name ~ -([1-4])\.                          | break
iphas  | own-name       | text     | unit_id    | {run}/{ccd}                                     | break
iphas  | band           | one_of   | band       | HALPHA, R, I                                    | break
iphas  | ra             | number   | ra_min     | [0,360)                                         | break
iphas  | ra-order       | below    | ra_min     | ra_max                                          | break
iphas  | dec            | number   | dec_min    | [-90,90]                                        | break
iphas  | dec-order      | below    | dec_min    | dec_max                                         | break
iphas  | frame          | is       | frame      | ICRS                                            | break
iphas  | no-region      | present  | region     |                                                 | exclude
iphas  | not-in-release | one_of   | in_release | true                                            | exclude
ztf    | own-name       | pattern  | unit_id    | ztf_\d{6}_z[gri]_c(?:0[1-9]|1[0-6])_q[1-4]_refimg | break
ztf    | file-name      | text     | file_name  | {unit_id}.fits                                  | break
ztf    | field          | part     | field      | unit_id ~ ^ztf_(\d{6})_                         | break
ztf    | ccd            | part     | ccd        | unit_id ~ _c(\d\d)_                             | break
ztf    | filter         | part     | filter     | unit_id ~ _z([gri])_                            | break
ztf    | band           | mapped   | band       | filter: g=G, r=R, i=I                           | break
ztf    | frame          | is       | frame      | FK5(J2000)                                      | break
ztf    | no-region      | present  | region     |                                                 | exclude
decaps | file-name      | pattern  | file_name  | c4d_[A-Za-z0-9_.-]+\.fits\.fz                   | break
decaps | own-name       | text     | unit_id    | {file_name}#{ccd}                               | break
decaps | band           | one_of   | band       | G, I, R, Y, Z                                   | break
decaps | exposure       | whole    | run        | [1,]                                            | break
decaps | seconds        | number   | seconds    | (0,]                                            | break
decaps | frame          | is       | frame      | ICRS                                            | break
decaps | no-region      | present  | region     |                                                 | exclude
akari  | path           | pattern  | unit_id    | images/(?:N60|WideS|WideL|N160)/[^/]+_fixstripe\.fits | break
akari  | file-name      | part     | file_name  | unit_id ~ ([^/]+)$                              | break
akari  | band           | one_of   | band       | N60, WIDES, WIDEL, N160                         | break
akari  | filter         | part     | filter     | unit_id ~ ^images/([^/]+)/                      | break
akari  | frame          | is       | frame      | FK5(J2000)                                      | break
akari  | no-region      | present  | region     |                                                 | exclude
nvss   | header         | is       | header     | captured                                        | exclude
nvss   | path           | pattern  | unit_id    | I\d{4}[PM]\d{2}\.fits\.gz                       | break
nvss   | file-name      | text     | file_name  | {unit_id}                                       | break
nvss   | header-blocks  | multiple | header_bytes | 2880                                            | break
nvss   | header-bytes   | number   | header_bytes | [2880,)                                         | break
nvss   | frame          | is       | frame      | ICRS                                            | break
nvss   | no-region      | present  | region     |                                                 | exclude
""")
