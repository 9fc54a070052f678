"""Source catalog: build from a network directory, validate, diff, list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshframes.functions.scalars import unicode_trim, websocket_url
from meshframes.operators.scan import ordered_scan
from meshframes.schema import MAX_SOURCE_ID_BYTES, RelaySettings


def flatten_networks(networks: DataFrame) -> DataFrame:
    """Nested directory ``networks(pos, id, analyzers[])`` to one row per analyzer
    with its walk position: (network, npos, apos, name, url, headers)."""
    a = networks.select(F.col("id").alias("network"), F.col("pos").alias("npos"), F.posexplode("analyzers").alias("apos", "a"))
    return a.select("network", "npos", "apos", F.col("a.name").alias("name"), F.col("a.url").alias("url"),
                    F.col("a.headers").alias("headers"))


def build_source_catalog(analyzers: DataFrame, with_rejected: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """C1 (S9): networks then analyzers in walk order ``(npos, apos)``.

    URLs are normalised (P13); rejected schemes are skipped. The first occurrence of
    a URL over all networks wins. Survivors are numbered per network position from
    1: id = network id for the first, ``<network>-<n>`` after; mapping =
    ``<network>:<n-1>``; headers kept when non-empty.
    """
    a = analyzers
    if "headers" not in a.columns:
        a = a.withColumn("headers", F.lit(None).cast("map<string,string>"))
    a = a.withColumn("ws_url", websocket_url("url"))
    rejected = a.filter(F.col("ws_url").isNull()).select("network", "npos", "apos", "url")
    ok = a.filter(F.col("ws_url").isNotNull())
    # first occurrence of each url: a partial aggregation carrying the whole row, so a
    # url repeated across many networks is reduced map-side (no join on a hot url)
    cols = ["network", "npos", "apos", "headers"]
    kept = ok.groupBy("ws_url").agg(F.min_by(F.struct(*cols), F.struct("npos", "apos")).alias("_f")).select(
        "ws_url", *[F.col(f"_f.{c}").alias(c) for c in cols])
    n = ordered_scan(kept, ["npos"], "apos", bucket_ms=65536, row_number="_n")
    num = F.col("_n") + 1
    sid = F.when(num == 1, F.col("network")).otherwise(F.concat(F.col("network"), F.lit("-"), num.cast("string")))
    headers = F.when(F.size(F.coalesce(F.col("headers"), F.create_map())) > 0, F.col("headers"))
    out = n.select(
        sid.alias("id"),
        F.col("ws_url").alias("url"),
        headers.alias("headers"),
        F.lit(False).alias("disabled"),
        F.lit(None).cast("string").alias("proxy"),
        F.concat(F.col("network"), F.lit(":"), (num - 1).cast("string")).alias("mapping"),
        "network",
        "npos",
        "apos",
    )
    return (out, rejected) if with_rejected else out


def with_source_defaults(sources: DataFrame) -> DataFrame:
    """S8 defaults: headers empty, disabled false, proxy / mapping null."""
    cols = sources.columns
    d = sources
    if "headers" not in cols:
        d = d.withColumn("headers", F.lit(None).cast("map<string,string>"))
    if "disabled" not in cols:
        d = d.withColumn("disabled", F.lit(None).cast("boolean"))
    for c in ("proxy", "mapping"):
        if c not in cols:
            d = d.withColumn(c, F.lit(None).cast("string"))
    return d.select(
        "id", "url",
        F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")).alias("headers"),
        F.coalesce(F.col("disabled"), F.lit(False)).alias("disabled"),
        "proxy", "mapping",
    )


def read_sources(spark, path: str, fmt: str = "json") -> DataFrame:
    """A source catalog file (JSON lines or parquet) read with the catalog
    schema (never inferred), with defaults: headers empty, disabled false, proxy and
    mapping null."""
    from meshframes.schema import SOURCES

    df = spark.read.schema(SOURCES).format(fmt).load(path)
    return with_source_defaults(df)


def validate_sources(sources: DataFrame, settings: RelaySettings = RelaySettings()) -> DataFrame:
    """Every violation as a row ``(id, rule, detail)`` (the relay stops at the
    first; here all are listed). Catalog rules run as one aggregation + filters."""
    spark = sources.sparkSession
    rows = []
    rc, dd = settings.reconnect, settings.dedup
    checks = [
        ("channel_capacity", settings.channel_capacity <= 0),
        ("user_agent_newline", "\r" in settings.user_agent or "\n" in settings.user_agent),
        ("reconnect_initial_delay", rc.initial_delay_s <= 0),
        ("reconnect_max_delay", rc.max_delay_s < rc.initial_delay_s),
        ("reconnect_offline_threshold", rc.offline_threshold_s <= 0),
        ("reconnect_offline_delay", rc.offline_delay_s <= 0),
        ("dedup_window", dd.default_window_s <= 0),
        ("dedup_max_window", dd.max_window_s < dd.default_window_s),
    ]
    for rule, bad in checks:
        if bad:
            rows.append((None, rule, "settings"))
    policy = spark.createDataFrame(rows, "id string, rule string, detail string")

    s = sources.select("id", "proxy")
    empty = s.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0).select(
        F.lit(None).cast("string").alias("id"), F.lit("no_sources").alias("rule"), F.lit("catalog").alias("detail"))
    dup = s.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(
        "id", F.lit("duplicate_id").alias("rule"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))
    proxy = F.col("proxy")
    scheme = F.lower(F.regexp_extract(proxy, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.regexp_extract(proxy, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1)
    rule = (
        F.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("empty_id"))
        .when(F.octet_length("id") > MAX_SOURCE_ID_BYTES, F.lit("id_too_long"))
    )
    prule = (
        F.when(proxy.isNull(), F.lit(None))
        .when(unicode_trim(proxy) == "", F.lit("empty_proxy"))
        .when(scheme == "", F.lit("invalid_proxy"))
        .when(scheme != "http", F.lit("proxy_not_http"))
        .when(host == "", F.lit("proxy_without_host"))
    )
    id_rows = s.filter(rule.isNotNull()).select("id", rule.alias("rule"), F.octet_length("id").cast("string").alias("detail"))
    proxy_rows = s.filter(prule.isNotNull()).select("id", prule.alias("rule"), F.lit("proxy").alias("detail"))
    return policy.unionByName(empty).unionByName(dup).unionByName(id_rows).unionByName(proxy_rows)


def _headers_key(c) -> F.Column:
    return F.array_sort(F.coalesce(F.map_entries(F.col(c)), F.array().cast("array<struct<key:string,value:string>>")))


def diff_sources(old: DataFrame, new: DataFrame, tls_changed: bool = False) -> DataFrame:
    """Class per id between two catalogs: added, removed, stopped (now
    disabled, was enabled; disabled in both is unchanged), restarted (url, headers or proxy changed - or the TLS setting - and
    it was enabled), started (was disabled, now enabled), unchanged (a mapping
    change alone just updates the row)."""
    o = old.select("id", F.struct("url", _headers_key("headers").alias("h"), "proxy", "mapping",
                                  F.coalesce("disabled", F.lit(False)).alias("disabled")).alias("o"))
    n = new.select("id", F.struct("url", _headers_key("headers").alias("h"), "proxy", "mapping",
                                  F.coalesce("disabled", F.lit(False)).alias("disabled")).alias("n"))
    j = o.join(n, "id", "full")
    reconnect = (
        ~F.col("o.url").eqNullSafe(F.col("n.url"))
        | ~F.col("o.h").eqNullSafe(F.col("n.h"))
        | ~F.col("o.proxy").eqNullSafe(F.col("n.proxy"))
        | F.lit(bool(tls_changed))
    )
    change = (
        F.when(F.col("o").isNull(), F.lit("added"))
        .when(F.col("n").isNull(), F.lit("removed"))
        .when(F.col("n.disabled") & ~F.col("o.disabled"), F.lit("stopped"))
        .when(F.col("n.disabled"), F.lit("unchanged"))
        .when(~F.col("o.disabled") & reconnect, F.lit("restarted"))
        .when(F.col("o.disabled"), F.lit("started"))
        .otherwise(F.lit("unchanged"))
    )
    mapping_changed = F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.col("o.mapping").eqNullSafe(F.col("n.mapping"))
    return j.select("id", change.alias("change"), mapping_changed.alias("mapping_changed"))


def list_sources(sources: DataFrame, states: DataFrame) -> DataFrame:
    """C4: id, url, mapping, state, ordered by id; headers and proxy never shown."""
    return (
        sources.select("id", "url", "mapping")
        .join(states.select(F.col("source").alias("id"), "state"), "id", "left")
        .select("id", "url", "mapping", F.coalesce(F.col("state"), F.lit("disconnected")).alias("state"))
        .orderBy("id")
    )
