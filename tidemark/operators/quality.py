"""Checks of source specs, as a report with one row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import is_valid_url
from ..schema import SOURCE_TYPES, STRATEGIES

# ---- fixed values: name rule, id rule, and the path pattern shapes a spec may use ----

INDEX_NAME = r"\A[a-z0-9]([a-z0-9\-]*[a-z0-9])?\z"

STRICT_INDEX_NAME = r"\A[a-z0-9][a-z0-9\-]*[a-z0-9]\z"

# nicknames, intervals, or five to seven cron fields at the end of the text
SCHEDULE = (
    r"\A(@(annually|yearly|monthly|weekly|daily|hourly|reboot))"
    r"|(@every (\d+(ns|us|µs|ms|s|m|h))+)"
    r"|((((\d+,)+\d+|(\d+(/|-)\d+)|\d+|\*) ?){5,7})\z"
)

CLOUDS = ("Azure",)

UUID = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"

PATTERN_SHAPES = (
    # foo, foo/bar
    r"[a-zA-Z0-9._-]+(/[a-zA-Z0-9._-]+)*",
    # *, **/foo, foo/*, foo/*.go, *.go
    r"\*|\*\*/[a-zA-Z0-9._-]+|[a-zA-Z0-9._-]+/\*|[a-zA-Z0-9._-]+/\*\.[a-zA-Z0-9]+|\*\.[a-zA-Z0-9]+",
    # **/foo/bar
    r"\*\*/[a-zA-Z0-9._-]+(/[a-zA-Z0-9._-]+)*",
    # **/*.go
    r"\*\*/\*\.[a-zA-Z0-9]+",
    # foo/**, foo/bar/**
    r"[a-zA-Z0-9._-]+(/[a-zA-Z0-9._-]+)*/\*\*",
    # a/**/b
    r"([a-zA-Z0-9._-]+/)?\*\*/[a-zA-Z0-9._-]+(/[a-zA-Z0-9._-]+)*",
    # foo/bar/**/*.go
    r"[a-zA-Z0-9._-]+(/[a-zA-Z0-9._-]+)*/\*\*/\*\.[a-zA-Z0-9]+",
)

# ---- end of fixed values ----

_PATTERN = r"\A(?:" + "|".join(f"(?:{shape})" for shape in PATTERN_SHAPES) + r")\z"


def _unset(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def _any(array: str, bad) -> Column:
    return F.coalesce(F.exists(array, lambda x: F.coalesce(bad(x), F.lit(True))), F.lit(False))


def is_path_pattern(pattern: Column) -> Column:
    return pattern.rlike(_PATTERN)


def spec_rules(columns: list[str]) -> list[tuple[str, Column]]:
    """``(code, broken)`` pairs for the columns a registry has.

    Core columns: engine, index_name, type. Checked where present: repository, branch, paths,
    exclude_paths, urls, language, initial_query, schedule, policy, credential columns.
    """
    has = set(columns)
    kind = F.coalesce("type", F.lit(""))
    rules: list[tuple[str, Column]] = [
        ("engine:missing", _unset("engine")),
        ("index_name:missing", _unset("index_name")),
        ("index_name:invalid", ~_unset("index_name") & ~F.col("index_name").rlike(INDEX_NAME)),
        ("type:missing", kind == ""),
        ("type:invalid", (kind != "") & ~kind.isin(*SOURCE_TYPES)),
    ]

    def add(column: str, code: str, broken) -> None:
        if column in has:
            rules.append((code, broken()))

    git, static, database = (kind == t for t in SOURCE_TYPES)
    add("repository", "repository:missing", lambda: git & _unset("repository"))
    add("branch", "branch:missing", lambda: git & _unset("branch"))
    add("paths", "paths:invalid", lambda: git & _any("paths", lambda p: ~is_path_pattern(p)))
    add(
        "exclude_paths",
        "exclude_paths:invalid",
        lambda: git & _any("exclude_paths", lambda p: ~is_path_pattern(p)),
    )
    add("urls", "urls:missing", lambda: static & (F.coalesce(F.size("urls"), F.lit(0)) <= 0))
    add("urls", "urls:invalid", lambda: static & _any("urls", lambda u: ~is_valid_url(u)))
    add("language", "language:missing", lambda: database & _unset("language"))
    add("initial_query", "initial_query:missing", lambda: database & _unset("initial_query"))
    add(
        "schedule",
        "schedule:invalid",
        lambda: ~_unset("schedule")
        & ~(F.startswith(F.col("schedule"), F.lit("@")) | (F.octet_length("schedule") >= 5)),
    )
    add("policy", "policy:missing", lambda: F.coalesce(F.col("policy") == "", F.lit(False)))
    add(
        "policy",
        "policy:invalid",
        lambda: ~_unset("policy") & ~F.col("policy").isin(*STRATEGIES),
    )
    if "credential_type" in has:
        rules.extend(_credential_rules())
    return rules


def _credential_rules() -> list[tuple[str, Column]]:
    """Shape of ``credential_type, secret_name, secret_key, cloud, client_id, tenant_id,
    service_account, scope``; a null type means the spec has no credentials."""
    kind = F.col("credential_type")
    secret, identity = kind == "SecretRef", kind == "WorkloadIdentity"
    known_cloud = identity & F.col("cloud").isin(*CLOUDS)
    rules = [
        ("credentials:missing", kind == ""),
        ("credentials:invalid", (kind != "") & ~kind.isin("SecretRef", "WorkloadIdentity")),
        ("secret_ref:missing", secret & (_unset("secret_name") | _unset("secret_key"))),
        ("cloud:missing", identity & _unset("cloud")),
        ("cloud:invalid", identity & ~_unset("cloud") & ~F.col("cloud").isin(*CLOUDS)),
    ]
    for name in ("client_id", "tenant_id", "service_account", "scope"):
        rules.append((f"{name}:missing", known_cloud & _unset(name)))
    for name in ("client_id", "tenant_id"):
        rules.append((f"{name}:invalid", known_cloud & ~_unset(name) & ~F.col(name).rlike(UUID)))
    return [(code, F.coalesce(broken, F.lit(False))) for code, broken in rules]


def schema_rules() -> list[tuple[str, Column]]:
    """The stricter rules a registry may enforce when a spec is stored: name and schedule shapes."""
    return [
        ("index_name:schema", ~F.coalesce("index_name", F.lit("")).rlike(STRICT_INDEX_NAME)),
        ("schedule:schema", F.col("schedule").isNotNull() & ~F.col("schedule").rlike(SCHEDULE)),
    ]


def check_specs(registry: DataFrame, strict: bool = False) -> DataFrame:
    """``(namespace, name, code)``: one row per broken rule, all rules of a row in one pass."""
    rules = spec_rules(registry.columns) + (schema_rules() if strict else [])
    findings = F.array(*[F.when(broken, F.lit(code)) for code, broken in rules])
    return registry.select(
        "namespace", "name", F.explode(F.filter(findings, lambda c: c.isNotNull())).alias("code")
    )


def orphan_sources(registry: DataFrame, engines: DataFrame) -> DataFrame:
    """Sources whose engine does not exist in their namespace (or at all, without namespaces)."""
    keys = ["namespace", "engine"] if "namespace" in engines.columns else ["engine"]
    return registry.join(engines.select(*keys).distinct(), keys, "left_anti")


def spec_hash(*columns: str) -> Column:
    """Eight hex digits that change when any of the columns does; null differs from empty."""
    parts = [
        F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns
    ]
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 8)


def job_label(schedule: Column) -> Column:
    return F.when(F.coalesce(schedule, F.lit("")) != "", F.lit("scheduled-indexing")).otherwise(
        F.lit("one-time-indexing")
    )
