"""Requests of the hub's interface as data: decoding, routing, paged listings, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = "operation string, objects array<struct<oid:string,size:bigint>>"
REPO = "type string, name string, organization string"
PREUPLOAD = "files array<struct<path:string,size:bigint>>"
ENTRY = "array<struct<type:string,path:string,oid:string,size:bigint>>"
#: Bytes of a request body; seconds that a token holds; tokens that are remembered.
MOST_BODY, TOKEN_SECONDS, MOST_TOKENS = 4 << 20, 3600, 4096


def decode_requests(requests: DataFrame, schema: str, most: int = MOST_BODY) -> DataFrame:
    """requests with `status` (ok, too_large, malformed) and `value`. A body is exactly one JSON object: what follows it makes it malformed."""
    # Put into an array, a body that holds more than one value (or less) gives another number of elements, or no array at all.
    wrapped = F.concat(F.lit("["), F.col("body"), F.lit("]"))
    parsed = F.from_json(wrapped, f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in _fields(schema))}>>", {"mode": "PERMISSIVE"})
    plain = F.trim("body", F.lit(" \t\r\n"))
    one = plain.startswith("{") & plain.endswith("}") & (F.size(parsed) == 1) & F.get(parsed, F.lit(0)).isNotNull()
    status = F.when(F.octet_length("body") > most, "too_large").when(F.coalesce(one, F.lit(False)), "ok").otherwise("malformed")
    return requests.withColumn("status", status).withColumn("value", F.when(F.col("status") == "ok", F.get(parsed, F.lit(0))))


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


#: Type (plural), namespace, name, verb, revision and the rest of a call.
CALL = r"^/?api/([^/]*?)s?/([^/]+)/([^/]+)/([^/]+)/([^/]*)(?:/(.*))?$"


def route(method: Column, path: Column) -> Column:
    """(handler, scope, repo_type, repo_id, revision, path) of a call below /api/; a null handler is not found."""
    group = lambda i: F.regexp_extract(path, CALL, i)
    creates = (method == "POST") & path.rlike("^/?api/repos/create$")
    known = ((method == "GET") & group(4).isin("read-token", "write-token", "revision", "tree")) | ((method == "POST") & group(4).isin("preupload", "commit", "branch"))
    named = lambda c: F.when(known, c)
    return F.struct(
        F.when(creates, "create").when(known, group(4)).alias("handler"),
        F.when(creates, "write").when(known, F.when((method == "POST") | (group(4) == "write-token"), "write").otherwise("read")).alias("scope"),
        named(group(1)).alias("repo_type"),
        named(F.concat_ws("/", group(2), group(3))).alias("repo_id"),
        named(group(5)).alias("revision"),
        named(group(6)).alias("path"),
    )


def tree_pages(pages: DataFrame) -> DataFrame:
    """Entries of all pages (listing, page, body: a JSON array), in page order: the union of what a paged listing returns."""
    entries = F.from_json("body", ENTRY, {"mode": "FAILFAST"})
    return pages.select("listing", "page", F.posexplode(entries).alias("at", "entry")).select("listing", "page", "at", "entry.*")


def issued_tokens(requests: DataFrame, now: Column, base_url: str, salt: str | None = None) -> DataFrame:
    """requests with access_token (32 hex digits, random, or made from the salt and `request` for repeatable runs), expires, and this service's own address in place of the upstream's."""
    token = F.replace(F.uuid(), F.lit("-")) if salt is None else F.substring(F.sha2(F.concat(F.lit(salt), F.col("request").cast("string")), 256), 1, 32)
    return requests.withColumns({"access_token": token, "expires": F.unix_timestamp(now) + TOKEN_SECONDS, "cas_url": F.lit(base_url)})


def commit_oid(request: Column, salt: str) -> Column:
    """40 hex digits for a commit."""
    return F.sha1(F.concat(F.lit(salt), request.cast("string")))


def minting_records(calls: DataFrame, issued: DataFrame, most: int | None = MOST_TOKENS, order: str = "expires") -> DataFrame:
    """calls (call, access_token) with the record under which their token was issued, null where it isn't remembered: the `most` newest are."""
    kept = issued if most is None else issued.orderBy(F.desc(order), "access_token").limit(most)
    return calls.join(kept, "access_token", "left")
