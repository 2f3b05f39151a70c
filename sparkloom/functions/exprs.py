"""Column functions without UDFs: normalisation, digests, ids, locators and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Latin letters with marks and the bare letters that index terms use for them.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzz"
#: Fixed values of scoring.
STATUS_WEIGHT = {"extracted": 0.55, "verified": 0.90, "corroborated": 1.00, "contested": 0.35, "deprecated": 0.20, "rejected": 0.00}
BREADTH_WEIGHT = {"none": 0.20, "low": 0.45, "medium": 0.70, "high": 1.00}
LANE_THRESHOLD = {"reference": 0.40, "case_step": 0.45, "negative_evidence": 0.35, "guidance": 0.50}
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def normalise_text(x: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def normalise_list(x: Column) -> Column:
    """Normalised, without empties, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(x, normalise_text), lambda v: v != "")))


def normalise_heading(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def word_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}_'-]+)"), 1)).cast("long")


def strip_accents(x: Column) -> Column:
    return F.translate(x, ACCENTED, PLAIN)


def tokens(x: Column) -> Column:
    """Index terms: lower case, marks stripped, runs of letters and digits."""
    return F.regexp_extract_all(strip_accents(F.lower(x)), F.lit(f"({TOKEN})"), 1)


def truncated(x: Column, limit: int) -> Column:
    """At most ``limit`` characters; a cut text ends in the start of its digest, so that different texts stay different."""
    tail = F.concat(F.lit(" … [truncated sha256:"), F.left(F.sha2(x, 256), F.lit(16)), F.lit("]"))
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, F.lit(1), F.lit(limit) - F.length(tail)), tail))


def canonical_json(*columns: str) -> Column:
    """One JSON text for the named columns in sorted order, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def digest(*columns: Column) -> Column:
    """SHA-256 over the texts of the columns, joined by a unit separator; nulls count as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def list_digest(x: Column) -> Column:
    """SHA-256 over a list in its order."""
    return F.sha2(F.array_join(x, ","), 256)


def content_id(kind: Column, payload: Column) -> Column:
    return F.concat(kind, F.lit("-"), F.left(F.sha2(payload, 256), F.lit(24)))


def correlation_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version-5 UUID of a name: SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substr(h, F.lit(17), F.lit(2)), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)), F.concat(F.lit("5"), F.substr(h, F.lit(14), F.lit(3))), F.concat(variant, F.substr(h, F.lit(19), F.lit(2))), F.substr(h, F.lit(21), F.lit(12)))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def ancestors(path: Column) -> Column:
    """Every ancestor folder of a path, from the nearest to the root (empty text)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "/"))


def url_locator(url: Column) -> Column:
    """Scheme, host and path of an http(s) locator, lower-cased host; user, query and fragment go."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), host, path))


#: Query keys whose values are secrets.
SECRET_KEYS = ("access_token", "api_key", "apikey", "auth", "key", "password", "secret", "sig", "signature", "token")


def locator_error(url: Column) -> Column:
    """Why a locator may not be kept: not http(s), a user in it, or a query key that names a secret; null if it may."""
    keys = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)))
    return (
        F.when(~F.lower(url).rlike(r"^https?://[^/?#]"), "not_http")
        .when(url.rlike(r"^[A-Za-z]+://[^/?#]*@"), "credentials")
        .when(F.size(F.array_intersect(keys, F.array(*map(F.lit, SECRET_KEYS)))) > 0, "secret_key")
    )


def redact(x: Column) -> Column:
    """Brace tokens and standalone 32-digit hex values give way to marks."""
    # both patterns try much at each letter, so texts without a brace or without 32 digits in a row skip them
    braced = F.when(x.contains("{"), F.regexp_replace(x, r"[A-Za-z0-9_]{2,16}\{[^{}\s]{1,128}\}", "[REDACTED]")).otherwise(x)
    return F.when(x.rlike(r"\p{XDigit}{32}"), F.regexp_replace(braced, r"(^|[^A-Za-z0-9])[0-9a-fA-F]{32}([^A-Za-z0-9]|$)", "$1[REDACTED]$2")).otherwise(braced)


def target_kind(x: Column) -> Column:
    """Syntax of a target: ipv4, ipv6, url, hostname, generic or invalid."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    label = r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
    v = F.lower(F.trim(x))
    return (
        F.when(v.isNull() | (v == "") | v.rlike(r"\s"), "invalid")
        .when(v.rlike(f"^{octet}(\\.{octet}){{3}}$"), "ipv4")
        .when(v.rlike(r"^[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:.]*$"), "ipv6")
        .when(v.rlike(r"^https?://[^/?#]+"), "url")
        .when(v.rlike(f"^{label}(\\.{label})+$"), "hostname")
        .otherwise("generic")
    )


def ipv4_number(x: Column) -> Column:
    p = F.split(x, r"\.")
    return sum((p[i].cast("long") * (256 ** (3 - i)) for i in range(1, 4)), p[0].cast("long") * 256**3)


def freshness(age_days: Column, has_as_of: Column, deprecated: Column, version_sensitive: Column) -> Column:
    """How current an artifact is; only version-sensitive ones age, and a date more than 30 days ahead counts as unknown."""
    return (
        F.when(deprecated, 0.20)
        .when(~version_sensitive, 1.0)
        .when(age_days.isNull() & has_as_of, 0.25)
        .when(~has_as_of, 0.60)
        .when(age_days < -30, 0.25)
        .when(age_days <= 365, 1.0)
        .when(age_days <= 3 * 365, 0.80)
        .when(age_days <= 5 * 365, 0.60)
        .when(age_days <= 10 * 365, 0.40)
        .otherwise(0.20)
    )


def unit(x: Column) -> Column:
    """Clamped to [0, 1] and rounded to six places; exact halves go up in every engine."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) + 1e-9, 6)


def weight_of(weights: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[key]


def verification_confidence(status: Column, reliability: Column, extraction: Column, breadth: Column, support: Column, against: Column) -> Column:
    quality = 0.30 * weight_of(STATUS_WEIGHT, status) + 0.25 * reliability + 0.25 * extraction + 0.20 * weight_of(BREADTH_WEIGHT, breadth)
    return unit(F.when(support + against > 0, quality * support / (support + against)).otherwise(quality))


def source_diversity(support: Column, against: Column, frequency: Column) -> Column:
    balance = F.when(support + against > 0, support / (support + against)).otherwise(0.25)
    return unit(F.least(F.lit(1.0), 0.25 + 0.25 * support) * balance / F.sqrt(F.greatest(F.lit(1), frequency)))


def total_score(lexical: Column, coverage: Column, similarity: Column, verification: Column, fresh: Column, diversity: Column, penalty: Column) -> Column:
    return unit(0.30 * lexical + 0.20 * coverage + 0.15 * similarity + 0.20 * verification + 0.05 * fresh + 0.10 * diversity - penalty)
