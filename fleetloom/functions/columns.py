"""Scalar column helpers over node, version and reference strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Roles, defaults and patterns the results depend on.
CONTROL_PLANE = "control-plane"
WORKER = "worker"
ROLES = (WORKER, CONTROL_PLANE)
DEFAULT_SCHEMATIC = "376567988ad370138ad8b2698212367b8edcb69b5fd68c80be1f2ec7d603b4ba"
DEFAULT_FACTORY = "factory.talos.dev"
DEFAULT_PLATFORM = "metal"
ENCRYPTED_PREFIX = "ENC["
REF_PATTERN = r"^ref\+[a-zA-Z0-9]+://"
IMAGE_PATTERN = r"^.*/([a-zA-Z0-9]+):v?(.+)$"

_VERSION_PATTERN = (
    r"^v?([0-9]+)(?:\.([0-9]+)"
    r"(?:\.([0-9]+)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?"
    r"(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?)?)?$"
)
_LEADING_ZERO_IDENTIFIER = r"(?:^|\.)0[0-9]+(?:\.|$)"


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    """An empty string means "not set"."""
    return F.nullif(col_of(value), F.lit(""))


def first_set(*values: Column | str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def is_control_plane(role: Column | str = "role") -> Column:
    """True for control-plane, false for everything else including null."""
    return F.coalesce(col_of(role) == F.lit(CONTROL_PLANE), F.lit(False))


def role_rank(role: Column | str = "role") -> Column:
    return F.when(is_control_plane(role), F.lit(0)).otherwise(F.lit(1))


def strip_v(value: Column | str) -> Column:
    return F.regexp_replace(col_of(value), "^v", "")


def trim_space(value: Column | str) -> Column:
    return F.regexp_replace(col_of(value), r"^\s+|\s+$", "")


def connect_endpoint(ip: Column | str = "ip", host: Column | str = "host") -> Column:
    """Address to connect to: the IP when there is one, else the host."""
    return F.coalesce(col_of(ip), col_of(host))


def installer_ref(
    factory: Column | str,
    platform: Column | str,
    schematic: Column | str,
    version: Column | str,
    node_secureboot: Column | str,
    cluster_secureboot: Column | str,
) -> Column:
    """``factory/platform-installer[-secureboot]/schematic:vVERSION``."""
    secure = F.coalesce(col_of(node_secureboot), F.lit(False)) | F.coalesce(
        col_of(cluster_secureboot), F.lit(False)
    )
    return F.concat(
        col_of(factory),
        F.lit("/"),
        col_of(platform),
        F.when(secure, F.lit("-installer-secureboot")).otherwise(F.lit("-installer")),
        F.lit("/"),
        col_of(schematic),
        F.lit(":v"),
        strip_v(version),
    )


def parse_ref(reference: Column | str) -> Column:
    """Struct ``(schematic, version, error)`` read from the tail of a reference."""
    ref = col_of(reference)
    matched = F.coalesce(ref.rlike(IMAGE_PATTERN), F.lit(False))
    return F.struct(
        F.when(matched, F.regexp_extract(ref, IMAGE_PATTERN, 1)).alias("schematic"),
        F.when(matched, F.regexp_extract(ref, IMAGE_PATTERN, 2)).alias("version"),
        F.when(~matched, F.lit("reference has no <schematic>:<version> tail")).alias("error"),
    )


def version_key(version: Column | str) -> Column:
    """Comparable ``[major, minor, patch, released]``; null when unparsable.

    Missing parts count as 0; ``released`` is 0 for a pre-release and 1 otherwise.
    """
    text = trim_space(version)
    pre = F.regexp_extract(text, _VERSION_PATTERN, 4)
    parts = [
        F.coalesce(blank_to_null(F.regexp_extract(text, _VERSION_PATTERN, i)), F.lit("0")).try_cast("bigint")
        for i in (1, 2, 3)
    ]
    well_formed = (
        text.rlike(_VERSION_PATTERN)
        & ~pre.rlike(_LEADING_ZERO_IDENTIFIER)
        & parts[0].isNotNull()
        & parts[1].isNotNull()
        & parts[2].isNotNull()
    )
    released = F.when(pre == "", F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return F.when(well_formed, F.array(*parts, released))


def version_gte(version: Column | str, bound: str, unknown: bool = True) -> Column:
    """``version >= bound`` for a released bound; blank or unparsable gives *unknown*."""
    if not re.fullmatch(r"\d+\.\d+\.\d+", bound):
        raise ValueError(f"bound must be a released x.y.z version: {bound!r}")
    limit = F.array(*[F.lit(int(p)).cast("bigint") for p in bound.split(".")], F.lit(1).cast("bigint"))
    return F.coalesce(version_key(version) >= limit, F.lit(unknown))


def is_encrypted(value: Column | str) -> Column:
    return F.startswith(col_of(value), F.lit(ENCRYPTED_PREFIX))


def is_ref(value: Column | str) -> Column:
    return col_of(value).rlike(REF_PATTERN)


def shorten(value: Column | str, keep: int = 8) -> Column:
    text = col_of(value)
    return F.when(F.length(text) > keep, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def url_part(url: Column | str, part: str) -> Column:
    """HOST, PROTOCOL, PATH, QUERY, REF ... of a URL; null when it is not one."""
    return F.try_parse_url(col_of(url), F.lit(part))


def path_key(path: Column | str) -> Column:
    """Sort key of a per-directory lexical walk."""
    return F.split(col_of(path), "/")


def effective_parallel(total: Column | str, spec: Column | str) -> Column:
    """Concurrency from ``"5"`` or ``"25%"``: rounded up, at least 1, at most *total*.

    Null when the spec is not a positive integer or a percentage of 1 to 100.
    A total of 0 does not cap the result.
    """
    n = col_of(total).cast("bigint")
    text = trim_space(spec)
    is_percent = F.endswith(text, F.lit("%"))
    digits = F.when(is_percent, trim_space(F.regexp_replace(text, "%$", ""))).otherwise(text)
    value = F.when(digits.rlike(r"^\+?[0-9]+$"), digits.try_cast("bigint"))
    valid = (value > 0) & (~is_percent | (value <= 100))
    scaled = F.call_function("div", n * value + F.lit(99), F.lit(100))
    wanted = F.greatest(F.when(is_percent, scaled).otherwise(value), F.lit(1).cast("bigint"))
    return F.when(valid, F.when(n > 0, F.least(wanted, n)).otherwise(wanted))
