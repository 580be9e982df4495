"""Signed URLs and request signatures."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256


def presign(secret: bytes, method: Column, path: Column, exp: Column) -> Column:
    return hmac_sha256(secret, F.concat_ws(":", method, path, exp.cast("string")))


def verify(keys: dict[str, bytes], now: int, method: Column, path: Column, kid: Column, sig: Column, exp: Column) -> Column:
    """ok, or what is wrong first: missing sig, missing exp, bad exp, expired, unknown key, bad sig. Without a kid every key is tried."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    n = exp.try_cast("bigint")
    good = {k: presign(s, method, path, exp) == sig for k, s in keys.items()}
    own = F.coalesce(*[F.when(kid == k, g) for k, g in good.items()])
    any_ = F.lit(False)
    for g in good.values():
        any_ = any_ | g
    return F.when(blank(sig), "missing sig").when(blank(exp), "missing exp").when(n.isNull(), "bad exp").when(F.lit(now) > n, "expired").when(~blank(kid) & own.isNull(), "unknown key").when(F.when(blank(kid), any_).otherwise(own), "ok").otherwise("bad sig")


ALGORITHM, SERVICE = "AWS4-HMAC-SHA256", "s3"
#: Headers that a request must have signed, fixed values; seconds that its time may be off.
REQUIRED = ("host", "x-amz-content-sha256", "x-amz-date")
SKEW = 900


def signing_key(secret: str, date: str, region: str, service: str = SERVICE) -> bytes:
    key = f"AWS4{secret}".encode()
    for x in (date, region, service, "aws4_request"):
        key = hmac.new(key, x.encode(), hashlib.sha256).digest()
    return key


def _escaped(text: str) -> str:
    return quote(unquote(text), safe="-_.~")


def canonical(method: str, path: str, query: str, headers: dict[str, str], signed: list[str], body_hash: str) -> str:
    """The published canonical form of a request. headers by lower-case name, those that are signed at least."""
    pairs = sorted((_escaped(k), _escaped(v)) for k, _, v in (x.partition("=") for x in query.split("&") if x))
    lines = "".join(f"{k}:{' '.join(headers[k].split())}\n" for k in sorted(signed))
    return "\n".join([method, "/".join(map(_escaped, path.split("/"))) or "/", "&".join(f"{k}={v}" for k, v in pairs), lines, ";".join(sorted(signed)), body_hash])


def signature_v4(secret: str, method: str, path: str, query: str, headers: dict, signed: list[str], body_hash: str, stamp: str, region: str, service: str = SERVICE) -> str:
    """The published version-4 signature of a request."""
    form = canonical(method, path, query, headers, signed, body_hash)
    text = "\n".join([ALGORITHM, stamp, f"{stamp[:8]}/{region}/{service}/aws4_request", hashlib.sha256(form.encode()).hexdigest()])
    return hmac.new(signing_key(secret, stamp[:8], region, service), text.encode(), hashlib.sha256).hexdigest()


def sign_requests(requests: DataFrame, secret: str, region: str, date: str) -> DataFrame:
    """id, signature of requests (id, method, path without escapes, host, stamp, body_hash) of one date: in the JVM, as that date's key is a constant."""
    scope = f"{date}/{region}/{SERVICE}/aws4_request"
    signed = ";".join(REQUIRED)
    form = F.concat_ws("\n", "method", "path", F.lit(""), F.concat(F.lit("host:"), "host"), F.concat(F.lit("x-amz-content-sha256:"), "body_hash"), F.concat(F.lit("x-amz-date:"), "stamp"), F.lit(""), F.lit(signed), "body_hash")
    text = F.concat_ws("\n", F.lit(ALGORITHM), "stamp", F.lit(scope), F.sha2(F.encode(form, "UTF-8"), 256))
    checked = F.when(F.col("stamp").startswith(date), text).otherwise(F.raise_error(F.lit("a stamp of another date")))
    return requests.select("id", hmac_sha256(signing_key(secret, date, region), checked).alias("signature"))


def _parsed(authorization: str) -> tuple[str, str, list[str], list[str], str] | None:
    """algorithm, access key, scope, signed headers, signature; None if it isn't of that form."""
    algorithm, blank, rest = authorization.strip().partition(" ")
    fields = dict(x.strip().partition("=")[::2] for x in rest.split(","))
    key, slash, scope = fields.get("Credential", "").partition("/")
    if not blank or not key or not slash or not fields.get("SignedHeaders") or not fields.get("Signature") or any("=" not in x for x in rest.split(",")):
        return None
    return algorithm, key, scope.split("/"), sorted(fields["SignedHeaders"].lower().split(";")), fields["Signature"]


def _time(text: str, form: str) -> datetime | None:
    try:
        out = datetime.strptime(text, form).replace(tzinfo=UTC)
    except ValueError:
        return None
    return out if out.strftime(form) == text else None


def verdict(request: dict, secrets: dict[str, str], now: datetime) -> str:
    """ok, or the error code of a request (method, path, query, headers by lower-case name), checked in the order that clients see."""
    headers = request["headers"]
    if not headers.get("authorization"):
        return "MissingSecurityHeader"
    parsed = _parsed(headers["authorization"])
    if parsed is None:
        return "AuthorizationHeaderMalformed"
    algorithm, access, scope, signed, signature = parsed
    if algorithm != ALGORITHM or len(scope) != 4 or scope[3] != "aws4_request":
        return "AuthorizationHeaderMalformed"
    if access not in secrets:
        return "AccessDenied"
    stamp, body_hash = headers.get("x-amz-date", ""), headers.get("x-amz-content-sha256", "")
    if not stamp:
        return "MissingSecurityHeader"
    at = _time(stamp, "%Y%m%dT%H%M%SZ")
    if at is None or _time(scope[0], "%Y%m%d") is None or scope[0] != stamp[:8]:
        return "AuthorizationHeaderMalformed"
    if abs((at - now).total_seconds()) > SKEW:
        return "AccessDenied"
    if not body_hash:
        return "MissingSecurityHeader"
    if not set(REQUIRED) <= set(signed):
        return "AuthorizationHeaderMalformed"
    if any(k.startswith("x-amz-") and k not in signed for k in headers):
        return "AccessDenied"
    if any(not headers.get(k) for k in signed):
        return "MissingSecurityHeader"
    good = signature_v4(secrets[access], request["method"], request["path"], request["query"], headers, signed, body_hash, stamp, scope[1], scope[2])
    return "ok" if hmac.compare_digest(good, signature) else "SignatureDoesNotMatch"


def verify_requests(requests: DataFrame, secrets: dict[str, str], now: datetime) -> DataFrame:
    """id, verdict of requests (id, method, path, query, headers map by lower-case name), in Arrow batches: each row has a key chain and a canonical form of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.select(["method", "path", "query", "headers"]).to_pylist()
            out = [verdict(r | {"headers": dict(r["headers"] or ())}, secrets, now) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], ["id", "verdict"])

    return requests.select("id", "method", "path", "query", "headers").mapInArrow(run, "id long, verdict string")
