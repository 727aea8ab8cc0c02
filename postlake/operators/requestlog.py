"""Transforms over a table of HTTP request records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headers that are never kept, and the body limits in bytes.
SENSITIVE_HEADERS = ["authorization", "cookie", "x-api-key", "x-auth-token"]
MAX_REQUEST_BODY = 2048
MAX_RESPONSE_BODY = 1024


def redact(headers: Column | str) -> Column:
    headers = F.col(headers) if isinstance(headers, str) else headers
    return F.map_filter(headers, lambda name, _: ~F.lower(name).isin(SENSITIVE_HEADERS))


def _header(headers: Column, name: str) -> Column:
    """Value of a header by its name in any case; null when missing or empty."""
    hit = F.map_filter(headers, lambda k, _: F.lower(k) == name.lower())
    return F.nullif(F.get(F.map_values(hit), F.lit(0)), F.lit(""))


def client_ip(headers: Column | str, remote: Column | str) -> Column:
    """First hop of X-Forwarded-For, else X-Real-IP, else the peer address."""
    headers = F.col(headers) if isinstance(headers, str) else headers
    remote = F.col(remote) if isinstance(remote, str) else remote
    forwarded = F.split(_header(headers, "x-forwarded-for"), ",")[0]
    return F.coalesce(forwarded, _header(headers, "x-real-ip"), remote)


def level(status: Column | str) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")


def logged_request_body(method: Column | str, body: Column | str) -> Column:
    """Bodies are kept for POST, PUT and PATCH; long ones become a note."""
    method = F.col(method) if isinstance(method, str) else method
    body = F.col(body) if isinstance(body, str) else body
    size = F.octet_length(body)
    note = F.concat(F.lit("[Request body too large: "), size.cast("string"), F.lit(" bytes]"))
    kept = F.when(size <= MAX_REQUEST_BODY, body).otherwise(note)
    return F.when(method.isin("POST", "PUT", "PATCH"), kept).otherwise(F.lit(""))


def logged_response_body(status: Column | str, path: Column | str, body: Column | str) -> Column:
    """Bodies are kept for good answers below ``/api/``."""
    status = F.col(status) if isinstance(status, str) else status
    path = F.col(path) if isinstance(path, str) else path
    body = F.col(body) if isinstance(body, str) else body
    kept = F.when(F.octet_length(body) <= MAX_RESPONSE_BODY, body).otherwise(
        F.lit("[Response body too large]")
    )
    return F.when((status < 400) & F.startswith(path, F.lit("/api/")), kept).otherwise(F.lit(""))
