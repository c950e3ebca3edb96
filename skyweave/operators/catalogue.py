"""The catalogue of layers: filters, registry joins, upserts, comparisons, audits and readiness.

Every operator is joins, grouping and expressions; keys are (survey, release, product) unless named otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions import hpx

PRODUCT = ["survey_id", "release_id", "product_id"]
#: Modality synonyms, denied surveys, excluded layer ids and prefixes.
SYNONYMS = {"image": "imaging", "spectrum": "spectroscopy", "spectra": "spectroscopy"}
DENIED = ("csst",)
EXCLUDED_PREFIXES = ("batch-", "warehouse-selftest-", "warehouse-caller-")
LEVELS = ("needs-information", "L0", "L1", "L2", "L3")
GAPS = ("source-not-traceable", "input-snapshot-hash-missing", "validated-coverage-missing", "source-unit-index-missing", "file-level-reverse-index-missing", "output-validation-missing")
PALETTE = ("#1e857b", "#376b9b", "#a66a25", "#b64b3e", "#3b8054", "#7a5a9e", "#b27b2d", "#2b7887")
#: Ordered steps of each recipe mode.
STEPS = {
    "fits-wcs": ("input", "filter", "header", "icrs", "geometry", "rasterize", "union", "outputs", "evidence"),
    "tile-table": ("input", "filter", "geometry", "rasterize", "union", "outputs", "evidence"),
    "catalog-radec": ("input", "filter", "geometry", "rasterize", "union", "outputs", "evidence"),
    "path-healpix": ("input", "filter", "validate", "normalize", "outputs", "evidence"),
    "regions": ("input", "parse", "icrs", "union", "rasterize", "outputs", "evidence"),
    "nested-healpix": ("input", "validate", "union", "outputs", "evidence"),
    "native-moc": ("input", "validate", "project", "union", "outputs", "evidence"),
}
#: Address blocks that aren't public, by their first octets; ends and parts of internal names; the one
#: archive whose ftp paths are public.
PRIVATE = ((0,), (10,), (127,), (169, 254), (192, 168), *((172, k) for k in range(16, 32)))
INTERNAL_ENDS, INTERNAL_PARTS, INTERNAL_LABEL = ("local", "internal"), ("elasticsearch", "kubernetes", "minio"), "svc"
FTP_HOST, FTP_PATHS = "archive.noao.edu", ("/public/hlsp/decals/dr1/coadd/", "/public/hlsp/decals/dr2/coadd/")


def modality(c: Column) -> Column:
    """The canonical name of a modality; null is empty."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(*[F.when(low == a, F.lit(b)) for a, b in SYNONYMS.items()], low)


def by_modality(layers: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Layers of the wanted modalities under any of their names; none wanted keeps all."""
    names = {SYNONYMS.get(w.strip().lower(), w.strip().lower()) for w in wanted} - {""}
    return layers.where(modality(F.col("modality")).isin(sorted(names))) if names else layers


def denied(survey: Column, layer: Column, names: Iterable[str] = DENIED) -> Column:
    """Whether a survey, or a layer named after it, is denied."""
    names = list(names)
    low = F.lower(F.trim(F.coalesce(layer, F.lit(""))))
    hit = F.lower(F.trim(F.coalesce(survey, F.lit("")))).isin(names)
    for n in names:
        hit = hit | (low == n) | low.startswith(n + "-")
    return hit


def excluded(layer: Column, ids: Iterable[str] = (), prefixes: Iterable[str] = EXCLUDED_PREFIXES) -> Column:
    hit = layer.isin(list(ids))
    for p in prefixes:
        hit = hit | layer.startswith(p)
    return hit


def warehouse_layers(layers: DataFrame, allowed: DataFrame | None = None, names: Iterable[str] = DENIED) -> DataFrame:
    """Layers that may answer: active or partitioned, no candidates, allowed by id, neither denied nor excluded."""
    out = layers.where(F.col("state").isin("ACTIVE", "PARTITIONED") & (F.coalesce("layer_mode", F.lit("")) != "CANDIDATE"))
    out = out.where(~denied(F.col("survey_id"), F.col("layer_id"), names) & ~excluded(F.col("layer_id")))
    return out if allowed is None else out.join(allowed.select("layer_id").distinct(), "layer_id", "left_semi")


def _public_host(host: Column) -> Column:
    """Whether a lower-case host is neither a private address nor an internal name."""
    return hpx.once(F.struct(host.alias("name"), F.split(host, r"\.").alias("labels")), lambda x: _public_name(x["name"], x["labels"]))


def _public_name(host: Column, labels: Column) -> Column:
    first, second = F.get(labels, F.lit(0)), F.coalesce(F.get(labels, F.lit(1)), F.lit(""))
    octets = {str(a): sorted({str(b) for x, *rest in PRIVATE if x == a for b in rest}) for a, *_ in PRIVATE}
    wide, narrow = [a for a, b in octets.items() if not b], {a: b for a, b in octets.items() if b}
    private = (host == "localhost") | first.isin(wide)
    for a, b in narrow.items():
        private = private | ((first == a) & second.isin(b))
    loopback = host.startswith("[") & (F.translate(host, "[]:0", "") == "1") & F.rtrim(F.translate(host, "]", " ")).endswith("1")
    named = F.size(labels) > 1
    ends = named & F.element_at(labels, -1).isin(*INTERNAL_ENDS)
    inner = F.array_contains(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), INTERNAL_LABEL)
    parts = F.arrays_overlap(F.split(host, "[-.]"), F.array(*[F.lit(w) for w in INTERNAL_PARTS]))
    return ~(private | loopback | ends | inner | parts)


def public_url(url: Column) -> Column:
    """http(s) urls without credentials whose host is neither private nor internal, and the trusted archive's ftp paths; others null."""
    parts = lambda u: F.struct(u.alias("url"), F.lower(F.regexp_extract(u, r"(?s)^(.*?)://([^/?#]*)(.*)$", 1)).alias("scheme"), F.lower(F.regexp_extract(u, r"(?s)^(.*?)://([^/?#]*)(.*)$", 2)).alias("authority"), F.regexp_extract(u, r"(?s)^(.*?)://([^/?#]*)(.*)$", 3).alias("path"))
    return hpx.once(F.trim(url), lambda u: hpx.once(parts(u), _judged_url))


def _judged_url(x: Column) -> Column:
    port = F.regexp_extract(x["authority"], r":(\d*)$", 1)
    host = F.regexp_replace(x["authority"], r":\d*$", "")
    sound = (host != "") & ~F.contains(x["authority"], F.lit("@"))
    web = x["scheme"].isin("http", "https") & _public_host(host)
    below = x["path"].startswith(FTP_PATHS[0]) | x["path"].startswith(FTP_PATHS[1])
    archive = (x["scheme"] == "ftp") & (host == FTP_HOST) & port.isin("", "21") & ~x["path"].rlike("[?#]") & below
    return F.when(sound & (web | archive), x["url"])


def locator(url: Column) -> Column:
    """Recorded places of a source: object stores and local files too, which are no downloads."""
    trimmed = F.trim(url)
    return F.when(trimmed.rlike(r"(?i)^(s3|oss)://") | trimmed.rlike(r"(?i)^file:///"), trimmed).otherwise(public_url(url))


def public_images(rows: DataFrame) -> DataFrame:
    """Public images of one archive with a numeric id and a region (obsid, collection, kind, rights, s_region)."""
    return rows.where(F.col("obsid").rlike(r"^\d{1,32}$") & (F.col("obsid").try_cast("double") <= 2**53 - 1) & (F.upper("collection") == "HST") & (F.lower("kind") == "image") & (F.upper("rights") == "PUBLIC") & F.col("s_region").isNotNull())


def selected(units: DataFrame, releases=(), proposals=(), targets=(), bands=(), prefixes=(), instrument: str | None = None, project: str | None = None) -> DataFrame:
    """Units that a binding's selector admits; `bands` is an array column, an empty argument asks nothing."""
    out = units
    for column, values in (("release_id", releases), ("proposal_id", proposals), ("target", targets)):
        out = out.where(F.col(column).isin(list(values))) if values else out
    if bands:
        out = out.where(F.arrays_overlap(F.transform("bands", F.upper), F.array(*[F.lit(b.upper()) for b in bands])))
    if prefixes:
        letters = [p.lower() for p in prefixes if len(p) == 1 and p.isascii() and p.isalpha()]
        if not letters:
            raise ValueError("unit prefixes are single letters")
        out = out.where(F.lower(F.substring(F.col("unit_id").cast("string"), 1, 1)).isin(letters))
    if instrument:
        own = F.upper("instrument")
        out = out.where((own == instrument.upper()) | own.startswith(instrument.upper() + "/"))
    return out.where(F.upper("project") == project.upper()) if project else out


def url_of(template: str, **parts: Column) -> Column:
    """A url from a template with {names} of string columns."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), parts[name]]
    return F.concat(*out, F.lit(rest))


def recipe_steps(recipes: DataFrame, mode: str = "mode") -> DataFrame:
    """A row for each step of each recipe, in order; unknown modes are those of a table of directions."""
    table = F.create_map(*[x for m, steps in STEPS.items() for x in (F.lit(m), F.array(*[F.lit(s) for s in steps]))])
    steps = F.coalesce(F.element_at(table, F.col(mode)), F.array(*[F.lit(s) for s in STEPS["catalog-radec"]]))
    return recipes.select("*", F.posexplode(steps).alias("step_no", "step"))


def color(name: Column) -> Column:
    """A palette colour by the 31-multiplier hash of a name, in unsigned 32 bits."""
    codes = F.transform(F.split(name, ""), F.ascii)
    value = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
    return F.element_at(F.array(*[F.lit(p) for p in PALETTE]), (value % len(PALETTE) + 1).cast("int"))


def with_registry(footprints: DataFrame, registry: DataFrame, bindings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Footprints with their registered name and unit index, and whether either is missing."""
    keys = keys or PRODUCT
    known = registry.select(*keys, F.col("name").alias("registered_name"))
    bound = bindings.groupBy(*keys).agg(F.min("index_id").alias("index_id"))
    out = footprints.join(known, keys, "left").join(bound, keys, "left")
    return out.withColumn("registration", F.when(F.col("registered_name").isNull(), "unregistered").when(F.col("index_id").isNull(), "without-index").otherwise("complete"))


def upsert(old: DataFrame, new: DataFrame, key: str, failed: str = "failed") -> DataFrame:
    """`old` with the rows of `new` in place of those of equal key, but where `new` failed: there the old row stays."""
    values = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*values).alias("a"))
    b = new.select(key, F.struct(*values).alias("b"), F.col(failed).alias("f"))
    both = a.join(b, key, "full_outer").where("a is not null or not coalesce(f, false)")
    taken = F.col("b").isNotNull() & ~F.coalesce("f", F.lit(False))
    origin = F.when(taken & F.col("a").isNotNull(), "replaced").when(taken, "added").when(F.col("b").isNotNull(), "kept-after-failure").otherwise("kept")
    return both.select(key, F.when(taken, F.col("b")).otherwise(F.col("a")).alias("v"), origin.alias("origin")).select(key, "v.*", "origin")


def compare(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Each key's state (added, removed, modified, unchanged) and the sorted names of fields that differ."""
    a = before.select(*keys, F.struct(*fields).alias("a"))
    b = after.select(*keys, F.struct(*fields).alias("b"))
    both = a.join(b, keys, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in sorted(fields)]))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("unchanged")
    return both.select(*keys, state.alias("state"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_join(changed, ",")).otherwise("").alias("fields"))


def archive_diff(remote: DataFrame, local: DataFrame, key: str, *content: str) -> DataFrame:
    """Files that the archive lacks here, holds with other content, or doesn't know: missing, changed, extra."""
    found = compare(remote, local, [key], list(content)).where("state <> 'unchanged'")
    names = {"added": "extra", "removed": "missing", "modified": "changed"}
    return found.select(key, F.coalesce(*[F.when(F.col("state") == a, F.lit(b)) for a, b in names.items()]).alias("state"))


def audit(catalogue: DataFrame, sources: DataFrame, footprints: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(rule, keys) of every reference fault between the catalogue, its sources (status, reason) and footprints (quality)."""
    keys = keys or PRODUCT
    rows: list[DataFrame] = []

    def add(rule: str, found: DataFrame) -> None:
        rows.append(found.select(F.lit(rule).alias("rule"), *keys).distinct())

    for rule, df in (("duplicate-product", catalogue), ("duplicate-source", sources), ("duplicate-footprint", footprints)):
        add(rule, df.groupBy(*keys).count().where("count > 1"))
    add("source-unregistered", sources.join(catalogue.select(*keys), keys, "left_anti"))
    add("product-without-source", catalogue.join(sources.select(*keys), keys, "left_anti"))
    add("footprint-without-source", footprints.join(sources.select(*keys), keys, "left_anti"))
    add("incomplete-without-reason", sources.where("status <> 'acquired' and coalesce(trim(reason), '') = ''"))
    add("acquired-with-reason", sources.where("status = 'acquired' and coalesce(trim(reason), '') <> ''"))
    exact = footprints.where("quality = 'moc'").select(*keys)
    add("acquired-without-moc", sources.where("status = 'acquired'").join(exact, keys, "left_anti"))
    add("overview-claims-moc", sources.where("status = 'overview_only'").join(exact, keys, "left_semi"))
    out = rows[0]
    for df in rows[1:]:
        out = out.union(df)
    return out


def readiness(products: DataFrame) -> DataFrame:
    """`products` with level (-1 to 3), label and gaps, from the flags traceable, input_locked, coverage, unit, file, validated."""
    unit = F.col("coverage") & F.col("unit")
    file = F.col("file")
    level = F.when(~F.col("traceable"), -1).when(file, 3).when(unit, 2).when(F.col("coverage"), 1).otherwise(0)
    flags = (F.col("traceable"), F.col("input_locked"), F.col("coverage"), unit, file, F.col("validated"))
    gaps = F.array_compact(F.array(*[F.when(~f, F.lit(g)) for f, g in zip(flags, GAPS, strict=True)]))
    label = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 2)
    return products.withColumns({"level": level, "label": label, "gaps": gaps})


def readiness_rollup(judged: DataFrame, *keys: str) -> DataFrame:
    """Counts of levels and capabilities, gaps, and the one precision of each key's products (mixed, or unknown)."""
    level = F.col("level")
    known = F.when(F.col("prec") != "unknown", F.col("prec"))
    n = F.count_distinct(known)
    counts = [F.sum((level == k).cast("long")).alias(x.lower().replace("-", "_")) for k, x in zip(range(-1, 4), LEVELS, strict=True)]
    capable = [F.sum((level >= k).cast("long")).alias(x) for k, x in ((1, "coverage"), (2, "unit"), (3, "file"))]
    return judged.groupBy(*keys).agg(F.count("*").alias("products"), *counts, *capable, F.sum(F.size("gaps").cast("long")).alias("gaps"), F.when(n == 0, "unknown").when(n == 1, F.max(known)).otherwise("mixed").alias("prec"))


def survey_index(layers: DataFrame) -> DataFrame:
    """One row a survey and release: products by status, and the orders that any layer has, coarsest to finest."""
    orders = F.sequence(F.lit(0).cast("long"), F.col("max_order").cast("long"))
    overview = F.max(F.least("max_order", F.lit(4)))
    many = lambda s: F.sum((F.col("status") == s).cast("long"))
    return layers.groupBy("survey_id", "release_id").agg(
        F.count_distinct("product_id").alias("products"), many("acquired").alias("acquired"), many("overview_only").alias("overview_only"), many("awaiting_geometry").alias("awaiting_geometry"),
        many("not_applicable").alias("not_applicable"), F.array_join(F.array_sort(F.collect_set(modality(F.col("modality")))), ",").alias("modalities"), overview.cast("long").alias("overview_order"),
        F.max("max_order").cast("long").alias("max_order"), F.max(F.size(orders)).cast("long").alias("orders"),
    )


def survey_tree(surveys: DataFrame, layers: DataFrame) -> DataFrame:
    """Each survey with its releases, each with its sorted products, as arrays of structs; surveys without layers stay."""
    products = layers.groupBy("survey_id", "release_id").agg(F.array_sort(F.collect_set("product_id")).alias("products"))
    releases = products.groupBy("survey_id").agg(F.array_sort(F.collect_list(F.struct("release_id", "products"))).alias("releases"))
    return surveys.join(releases, "survey_id", "left").withColumn("releases", F.coalesce("releases", F.array().cast(releases.schema["releases"].dataType)))


def release_projection(layers: DataFrame) -> DataFrame:
    """Sorted distinct modalities and the number of layers of each release."""
    kinds = F.array_join(F.array_sort(F.array_remove(F.collect_set(modality(F.col("modality"))), "")), ",")
    return layers.groupBy("survey_id", "release_id").agg(kinds.alias("modalities"), F.count("*").alias("layers"))


def survey_modalities(layers: DataFrame, order: str) -> DataFrame:
    """Each survey's modalities in the order they are first seen."""
    seen = layers.withColumn("kind", modality(F.col("modality"))).where("kind <> ''").groupBy("survey_id", "kind").agg(F.min(order).alias("at"))
    return seen.groupBy("survey_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]), ",").alias("modalities"))


def monitor(sources: DataFrame, seen: DataFrame, previous: DataFrame, alert: int = 3) -> DataFrame:
    """The next state of each source: skipped, failed, drifted (with what drifted) or unchanged, its last good revision, and alerts.

    `sources` (id, skip, sha, max_order) are the reviewed baselines, `seen` (id, sha, max_order, error) this run's
    observations, `previous` (id, good_sha, good_order, failures) the last state. A drifted source keeps its last good one.
    """
    s = sources.select("id", "skip", F.col("sha").alias("b_sha"), F.col("max_order").alias("b_order"))
    both = s.join(seen.select("id", "sha", "max_order", "error", F.lit(True).alias("here")), "id", "left").join(previous, "id", "left")
    failed = F.col("here").isNull() | F.col("error").isNotNull()
    sha = F.coalesce("good_sha", "b_sha")
    drift = F.concat_ws(",", F.when(sha.isNotNull() & (sha != F.col("sha")), "moc-bytes"), F.when(~F.coalesce("good_order", "b_order").eqNullSafe(F.col("max_order")), "max-order"))
    state = F.when(F.col("skip"), "skipped").when(failed, "failed").when(drift != "", "drifted").otherwise("unchanged")
    failures = F.when(state == "failed", F.coalesce("failures", F.lit(0)) + 1).otherwise(0).cast("long")
    good = lambda old, new: F.when(state == "skipped", F.lit(None)).when(state == "unchanged", F.col(new)).otherwise(F.col(old))
    return both.select("id", state.alias("state"), F.when(state == "drifted", drift).otherwise("").alias("drift"), good("good_sha", "sha").alias("good_sha"), good("good_order", "max_order").alias("good_order"), failures.alias("failures"), (failures >= alert).alias("alert"))


def product_id(survey: Column, release: Column, product: Column) -> Column:
    """The first 20 hex digits of the digest of the three names."""
    return F.substring(F.sha2(F.concat_ws("\n", survey, release, product), 256), 1, 20)


def slug(name: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, of at most 96 characters; Latin letters lose their marks."""
    # Marked letters, and the plain ones under them.
    plain = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    words = F.regexp_replace(plain, "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(words, "^-|-$", ""), 1, 96)


def unique_member(rows: DataFrame, key: str, policy: Column) -> DataFrame:
    """Rows whose key stands once and that satisfy `policy`."""
    once = rows.groupBy(key).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in rows.columns if c != key])
    return once.where(F.col("__n") == 1).where(policy).select(*rows.columns)


def fold_precision(ranks: Mapping[str, int]) -> tuple[Column, Column]:
    """(rank of `prec`, name of the rank in column `rank`): the greatest rank of many is their common precision."""
    rank = F.coalesce(*[F.when(F.col("prec") == n, F.lit(r)) for n, r in ranks.items()])
    back = F.coalesce(*[F.when(F.col("rank") == r, F.lit(n)) for n, r in ranks.items()])
    return rank, back


def claim_kind(product: Column, url: Column) -> Column:
    """What a product's geometry claims to be: moc, tile, raw-file or overview, by the words of its name and url."""
    text = F.lower(F.concat_ws(" ", product, url))
    return F.when(text.rlike(r"\bmoc\b|moc\.fits|moc\.json"), "moc").when(text.rlike("tile|brick|hips"), "tile").when(text.rlike("fits|file|archive|download"), "raw-file").otherwise("overview")


def canonical_json(c: Column) -> Column:
    """Compact JSON of a map of texts with its keys in order, so that equal maps have equal digests."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
