"""Scalar column expressions. Everything here stays inside the JVM."""

from .codec import base62_decode, base62_encode, id_space, parse_duration
from .expr import let
from .sentinel import (
    OVERFLOW_ID,
    mac_pads,
    scope_key_hex,
    sentinel_encode,
    sentinel_tag,
)
from .text import bounded_capture, is_internal_address, json_escape, request_id, shannon_bits

__all__ = [
    "OVERFLOW_ID",
    "base62_decode",
    "base62_encode",
    "bounded_capture",
    "id_space",
    "is_internal_address",
    "json_escape",
    "let",
    "mac_pads",
    "parse_duration",
    "request_id",
    "scope_key_hex",
    "sentinel_encode",
    "sentinel_tag",
    "shannon_bits",
]
