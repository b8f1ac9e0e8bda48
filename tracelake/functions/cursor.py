"""Opaque page cursors, limits and safe values: small driver-side helpers."""

from __future__ import annotations

import base64
import hashlib
import json
import re

SAFE = re.compile(r"^[A-Za-z0-9._:@/-]{1,256}$")


def encode(position: dict, filters: dict) -> str:
    """base64url JSON of a keyset position with a signature of the filters it belongs to."""
    body = json.dumps({"p": position, "s": signature(filters)}, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode(cursor: str, filters: dict) -> dict:
    """The position; ValueError if it is malformed or belongs to other filters."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        position, signed = body["p"], body["s"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("malformed cursor") from e
    if signed != signature(filters):
        raise ValueError("cursor belongs to other filters")
    return position


def signature(filters: dict) -> str:
    return hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else value))


def safe(value: str) -> str:
    if not SAFE.match(value):
        raise ValueError("unsafe value")
    return value
