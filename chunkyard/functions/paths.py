"""Request strings as columns: repository paths, byte ranges, links, headers, addresses, signing text."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "/resolve/"


def repo_type_of_prefix(prefix: Column) -> Column:
    return F.when(prefix == "datasets", "dataset").when(prefix == "spaces", "space").otherwise("model")


def split_repo_path(path: Column) -> Column:
    """(repo_type, namespace, name, rest) of a path whose first segment is a plural type; one trailing s is trimmed."""
    parts = F.split(F.ltrim(path, F.lit("/")), "/")
    return F.when(
        F.size(parts) >= 3,
        F.struct(
            F.regexp_replace(F.element_at(parts, 1), "s$", "").alias("repo_type"),
            F.element_at(parts, 2).alias("namespace"),
            F.element_at(parts, 3).alias("name"),
            F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "/").alias("rest"),
        ),
    )


def parse_resolve_path(path: Column) -> Column:
    """(repo_type, repo_id, revision, file) around the first /resolve/; null where a part is missing."""
    clean = F.ltrim(path, F.lit("/"))
    at = F.instr(clean, MARKER)
    before = F.split(F.substring(clean, F.lit(1), at - 1), "/")
    after = F.substring(clean, at + len(MARKER), F.length(clean))
    revision, file = F.split(after, "/", 2)[0], F.get(F.split(after, "/", 2), F.lit(1))
    namespace, name = F.get(before, F.size(before) - 2), F.get(before, F.size(before) - 1)
    prefix = F.get(before, F.lit(0))
    sound = (at > 1) & (F.size(before) >= 2) & (namespace != "") & (name != "") & (revision != "") & (F.coalesce(file, F.lit("")) != "")
    repo_type = F.when(F.size(before) >= 3, repo_type_of_prefix(prefix)).otherwise("model")
    return F.when(sound, F.struct(repo_type.alias("repo_type"), F.concat_ws("/", namespace, name).alias("repo_id"), revision.alias("revision"), file.alias("file")))


def repo_id_before(rest: Column, suffix: str) -> Column:
    """namespace/name in front of a suffix, or null."""
    head = F.when(rest.endswith(suffix), F.substring(rest, F.lit(1), F.length(rest) - len(suffix)))
    return F.when(F.size(F.split(head, "/")) == 2, head)


def parse_byte_range(header: Column, total: Column) -> Column:
    """(status, start, stop): `none` without a header, `ok` with an inclusive range clamped to total, else `unsatisfiable`."""
    pattern = r"^bytes= *([+-]?\d+)-([+-]?\d+)"
    low = F.regexp_extract(header, pattern, 1).try_cast("bigint")
    high = F.regexp_extract(header, pattern, 2).try_cast("bigint")
    sound = low.isNotNull() & high.isNotNull() & (low >= 0) & (high >= low) & (low < total)
    return (
        F.when(F.coalesce(header, F.lit("")) == "", F.struct(F.lit("none").alias("status"), F.lit(0).cast("bigint").alias("start"), (total - 1).cast("bigint").alias("stop")))
        .when(sound, F.struct(F.lit("ok").alias("status"), low.alias("start"), F.least(high, total - 1).cast("bigint").alias("stop")))
        .otherwise(F.struct(F.lit("unsatisfiable").alias("status"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop")))
    )


def next_link(header: Column) -> Column:
    """The address that a Link header calls next, or an empty string."""
    pattern = r'<([^>]+)>\s*;\s*rel="([^"]+)"'
    rels = F.regexp_extract_all(header, F.lit(pattern), F.lit(2))
    at = F.array_position(rels, "next")
    return F.when(at > 0, F.element_at(F.regexp_extract_all(header, F.lit(pattern), F.lit(1)), at.cast("int"))).otherwise("")


def trim_quotes(text: Column) -> Column:
    return F.when(F.length(text) >= 2, F.regexp_replace(text, '^"(.*)"$', "$1")).otherwise(text)


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("\u0000", *parts)


def file_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def source_ip(address: Column) -> Column:
    """The host of host:port; as it is without a port."""
    return F.when(address.rlike(r"^\[.*\]:\d+$"), F.regexp_extract(address, r"^\[(.*)\]:\d+$", 1)).when(address.rlike(r"^[^:]+:\d+$"), F.substring_index(address, ":", 1)).otherwise(address)


def bearer_token(header: Column) -> Column:
    return F.regexp_extract(header, r"(?i)^Bearer (.+)$", 1)


def refresh_route(repo_type: Column, repo_id: Column, revision: Column, kind: str = "read-token") -> Column:
    """Where a reader asks for a new token; `kind` is the route's last fixed segment."""
    return F.format_string(f"/api/%ss/%s/{kind}/%s", repo_type, repo_id, revision)


def object_url(base: str, prefix: str, hash_hex: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/v1/xorbs/{prefix}/"), hash_hex)


def resolve_prefix(repo_type: Column) -> Column:
    return F.when(repo_type == "dataset", "datasets/").when(repo_type == "space", "spaces/").otherwise("")


def is_under(path: Column, prefix: Column) -> Column:
    """Equal, or below prefix as a folder; an empty prefix holds everything."""
    return (F.coalesce(prefix, F.lit("")) == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def retry_after(tokens: Column, refill: float) -> Column:
    """Whole seconds until a token is there."""
    if refill <= 0:
        return F.lit(1)
    seconds = (1 - tokens) / refill
    return F.when(tokens.isNull(), 1).when(seconds <= 0, 0).when(seconds < 1, 1).otherwise(F.floor(seconds).cast("int") + 1)


def percent_encoded(text: Column, keep_slash: bool = False) -> Column:
    """RFC 3986 encoding: unreserved bytes stay, a blank is %20."""
    out = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def canonical_query(pairs: Column) -> Column:
    """Sorted k=v pairs of an array of structs (k, v)."""
    encoded = F.transform(pairs, lambda p: F.struct(percent_encoded(p["k"]).alias("k"), percent_encoded(p["v"]).alias("v")))
    return F.array_join(F.transform(F.array_sort(encoded), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def signing_key(secret: str, day: str, region: str, service: str) -> bytes:
    """The derived key of the version 4 signature scheme."""
    key = ("AWS4" + secret).encode()
    for part in (day, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return key


def canonical_uri(path: Column) -> Column:
    """The path of a signed request: encoded but for its slashes, / where empty."""
    return F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(percent_encoded(path, keep_slash=True))


def signature(key: bytes, text: str) -> str:
    """Of a string to sign."""
    return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def first_token(given: Column, *others: Column) -> Column:
    """The token given, unless it is empty or the word None, else the first of the others that is not empty, else what was given."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.nullif(some(given), F.lit("None")), *map(some, others), given)


def base_url(scheme: Column, host: Column) -> Column:
    """The address under which a request came; https only where the scheme says so."""
    return F.concat(F.when(F.lower(scheme) == "https", "https").otherwise("http"), F.lit("://"), host)


def repo_path(repo_type: Column, repo_id: Column) -> Column:
    """The path of a repository below /api/."""
    return F.concat(repo_type, F.lit("s/"), repo_id)
