"""Versioned records (key, main, sub, deleted, ...): state as of a revision, history, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

AT = ("main", "sub")


def _latest(*columns: str) -> Column:
    return F.max_by(F.struct(*columns), F.struct(*AT))


def as_of(records: DataFrame, revision: int) -> DataFrame:
    """key, main, sub, value of the keys that live at a revision."""
    last = records.where(F.col("main") <= revision).groupBy("key").agg(_latest("main", "sub", "value", "deleted").alias("r"))
    return last.where("not r.deleted").select("key", "r.main", "r.sub", "r.value")


def rollup(records: DataFrame) -> DataFrame:
    """key, revisions, live, mod_revision, bytes (of the last record if it lives), history_bytes (all others)."""
    own = F.octet_length("key") + F.col("size")
    rows = records.withColumn("own", own).groupBy("key").agg(F.count("*").alias("revisions"), F.sum("own").alias("everything"), _latest("main", "own", "deleted").alias("r"))
    bytes_ = F.when(F.col("r.deleted"), F.lit(0)).otherwise(F.col("r.own"))
    return rows.select("key", "revisions", (~F.col("r.deleted")).alias("live"), F.col("r.main").alias("mod_revision"), bytes_.cast("long").alias("bytes"), (F.col("everything") - bytes_).cast("long").alias("history_bytes"))


def history(records: DataFrame) -> DataFrame:
    """records with the value of the last record before them that is no deletion."""
    line = Window.partitionBy("key").orderBy(*AT).rowsBetween(Window.unboundedPreceding, -1)
    return records.select("key", "main", "sub", "deleted", "value", F.last(F.when(~F.col("deleted"), F.col("value")), ignorenulls=True).over(line).alias("previous"))


def resource(key: Column) -> Column:
    """group/resource of /registry/[group/]resource/...; a first part with a dot is a group."""
    parts = F.split(key, "/")
    first = F.try_element_at(parts, F.lit(3))
    return F.when(F.startswith(key, F.lit("/registry/")), F.when(F.contains(first, F.lit(".")), F.concat_ws("/", first, F.try_element_at(parts, F.lit(4)))).otherwise(first))


def prefix_sizes(rolled: DataFrame, depth: int) -> DataFrame:
    """prefix (of so many parts), keys, bytes of live keys."""
    return rolled.where("live").groupBy(F.substring_index("key", "/", depth + 1).alias("prefix")).agg(F.count("*").alias("keys"), F.sum("bytes").alias("bytes"))


def lease_counts(leases: DataFrame, rolled: DataFrame) -> DataFrame:
    """leases(lease) with their number of live keys; rolled(lease, live)."""
    used = rolled.where("live").groupBy("lease").agg(F.count("*").alias("n"))
    return leases.join(used, "lease", "left").select("lease", F.coalesce("n", F.lit(0)).alias("keys"))


def top_keys(rolled: DataFrame, by: str, n: int = 10) -> DataFrame:
    return rolled.orderBy(F.desc(by), "key").limit(n).select("key", F.col(by).alias("measure"))


#: How a value encrypted at rest begins, and the thresholds of findings.
ENCRYPTED = r"^k8s:enc:([a-z0-9]+):(v\d+):([^:]*):"
QUOTA = 2 * 1024**3
BIG_VALUE = 1024**2
LEVELS = ("bad", "warn", "info", "ok")


def value_kind(value: Column) -> Column:
    """format (json, encrypted, text), api_version, kind, provider, managed (bytes of managedFields) of a text value, as a struct.

    Values in the binary object format are not decoded: they count as text here. Null for null.
    """
    document = F.when(F.startswith(value, F.lit("{")), F.try_parse_json(value))
    kind = lambda path: F.coalesce(F.try_variant_get(document, path, "string"), F.lit(""))
    fields = F.try_variant_get(document, "$.metadata.managedFields", "array<variant>")
    encrypted = F.startswith(value, F.lit("k8s:enc:")) & (F.length(value) > 8)
    provider = F.when(F.regexp_like(value, F.lit(ENCRYPTED)), F.concat_ws(":", F.regexp_extract(value, ENCRYPTED, 1), F.regexp_extract(value, ENCRYPTED, 2))).otherwise("unknown")
    return F.when(
        value.isNotNull(),
        F.struct(
            F.when(document.isNotNull(), "json").when(encrypted, "encrypted").otherwise("text").alias("format"),
            kind("$.apiVersion").alias("api_version"),
            kind("$.kind").alias("kind"),
            F.when(encrypted, provider).alias("provider"),
            F.when(fields.isNotNull(), F.octet_length(F.to_json(fields))).otherwise(0).cast("long").alias("managed"),
        ),
    )


def objects(records: DataFrame) -> DataFrame:
    """A row for each key: resource, live, bytes, history_bytes, revisions, value_bytes and value_kind() of its last record if it lives.

    Kinds are read before the records meet by key, so that no value is shuffled.
    """
    rows = records.select("key", *AT, "deleted", F.octet_length("value").cast("long").alias("value_bytes"), value_kind(F.col("value")).alias("what"))
    rows = rows.withColumn("own", F.octet_length("key") + F.coalesce("value_bytes", F.lit(0)))
    last = rows.groupBy("key").agg(F.count("*").alias("revisions"), F.sum("own").alias("everything"), _latest("own", "deleted", "value_bytes", "what").alias("r"))
    live = ~F.col("r.deleted")
    own = F.when(live, F.col("r.own")).otherwise(0).cast("long")
    return last.select(
        "key", resource(F.col("key")).alias("resource"), live.alias("live"), own.alias("bytes"), (F.col("everything") - own).alias("history_bytes"), "revisions",
        *[F.when(live, F.col(c)).alias(c.split(".")[-1]) for c in ("r.value_bytes", "r.what.format", "r.what.api_version", "r.what.kind", "r.what.provider", "r.what.managed")],
    )


def kinds(rows: DataFrame) -> DataFrame:
    """objects() -> kind, api_version, objects, bytes (of values), managed_bytes."""
    return rows.where("live and kind <> ''").groupBy("kind", "api_version").agg(F.count("*").alias("objects"), F.sum("value_bytes").alias("bytes"), F.sum("managed").alias("managed_bytes"))


def secrets(rows: DataFrame) -> DataFrame:
    """objects() -> provider (null: stored in the clear), secrets."""
    return rows.where("live and resource = 'secrets'").groupBy("provider").agg(F.count("*").alias("secrets"))


def findings(rows: DataFrame, size: int = 0, free: int = 0, quota: int = QUOTA) -> DataFrame:
    """objects() -> level, code, amount, total: what deserves attention, worst first, then in a fixed order.

    size and free are bytes of the database file and of its free pages, where they are known.
    """
    secret = F.col("live") & (F.col("resource") == "secrets")
    every = F.col("bytes") + F.col("history_bytes")
    amount = lambda value, when=F.lit(True): F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")
    known = F.col("live") & (F.col("kind") != "")
    t = rows.agg(
        F.count_if(secret).alias("secrets"), F.count_if(secret & F.col("provider").isNull()).alias("plain"),
        F.count_if(F.col("live")).alias("live"), F.count_if(F.col("value_bytes") >= BIG_VALUE).alias("big"),
        amount(F.col("bytes")).alias("now"), amount(F.col("history_bytes")).alias("old"), amount(every, F.col("resource") == "events").alias("events"),
        amount(F.col("managed"), known).alias("managed"), amount(F.col("value_bytes"), known).alias("values"),
    )
    c = F.col
    one = lambda level, code, when, n, of: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), n.cast("long").alias("amount"), of.cast("long").alias("total")))
    found = [
        one("bad" if size >= 0.95 * quota else "warn", "quota", F.lit(size >= 0.8 * quota), F.lit(size), F.lit(quota)),
        one("warn", "secrets", c("plain") > 0, c("plain"), c("secrets")),
        one("ok", "secrets", (c("plain") == 0) & (c("secrets") > 0), c("secrets"), c("secrets")),
        one("warn", "big-values", c("big") > 0, c("big"), c("live")),
        one("info", "free", F.lit(free > 0.25 * size), F.lit(free), F.lit(size)),
        one("info", "history", c("old") > c("now"), c("old"), c("now")),
        one("info", "events", c("events") > 0.3 * (c("now") + c("old")), c("events"), c("now") + c("old")),
        one("info", "managed-fields", (c("managed") > 0.2 * c("values")) & (c("values") > 0), c("managed"), c("values")),
    ]
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("f.level"))
    return t.select(F.posexplode(F.array(*found)).alias("place", "f")).where("f is not null").orderBy(rank, "place").select("f.*")
