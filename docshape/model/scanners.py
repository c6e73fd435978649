"""Content checks of text that the prelude names ask for."""

from __future__ import annotations

import base64
import calendar
import re

_DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:[Zz]|[+\-\u2212](\d{2}):(\d{2}))", re.A)
_PCHAR = r"(?:[A-Za-z0-9\-._~!$&'()*+,;=:@]|%[0-9A-Fa-f]{2})"
_URI = re.compile(
    rf"[A-Za-z][A-Za-z0-9+.\-]*:"
    rf"(?://(?:(?P<user>(?:[A-Za-z0-9\-._~!$&'()*+,;=:]|%[0-9A-Fa-f]{{2}})*)@)?"
    rf"(?P<host>\[[^\]]*\]|(?:[A-Za-z0-9\-._~!$&'()*+,;=]|%[0-9A-Fa-f]{{2}})*)(?::(?P<port>[0-9]*))?(?:/{_PCHAR}*)*"
    rf"|/(?:{_PCHAR}+(?:/{_PCHAR}*)*)?|{_PCHAR}+(?:/{_PCHAR}*)*|)"
    rf"(?:\?(?:{_PCHAR}|[/?])*)?(?:#(?:{_PCHAR}|[/?])*)?"
)
_FUTURE = re.compile(r"[vV][0-9A-Fa-f]+\.[A-Za-z0-9\-._~!$&'()*+,;=:]+")
#: Seconds of the years -262143 and 262142.
TIME_LOW, TIME_HIGH = -8334601228800, 8210266876799


def is_date(text: str) -> bool:
    """RFC 3339, with a leap second, lower-case letters, a space or a minus sign U+2212 allowed."""
    m = _DATE.fullmatch(text)
    if not m:
        return False
    year, month, day, hour, minute, second = (int(m[k]) for k in range(1, 7))
    if not 1 <= month <= 12 or hour > 23 or minute > 59 or second > 60:
        return False
    if not 1 <= day <= (29 if month == 2 and calendar.isleap(year) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]):
        return False
    return m[7] is None or int(m[7]) <= 23 and int(m[8]) <= 59


def is_uri(text: str) -> bool:
    """An absolute URI by RFC 3986; a port is at most 65535."""
    m = _URI.fullmatch(text)
    if not m:
        return False
    host = m["host"]
    if host and host.startswith("[") and not _FUTURE.fullmatch(host[1:-1]):
        import ipaddress

        try:
            ipaddress.IPv6Address(host[1:-1])
        except ValueError:
            return False
        if "%" in host:
            return False
    return not m["port"] or int(m["port"]) <= 65535


def is_time(value: int | float) -> bool:
    return TIME_LOW <= value <= TIME_HIGH  # NaN isn't


_ALPHABETS = {"b64u": ("-_", False), "b64c": ("+/", True)}


def decode_base64(text: str, kind: str, sloppy: bool) -> bytes | None:
    """Base64: classic with padding, or for URLs without; only sloppy ones may set unused bits."""
    marks, padded = _ALPHABETS[kind]
    body = text.rstrip("=") if padded else text
    if padded and (len(text) % 4 or len(text) - len(body) > 2 or len(text) - len(body) != -len(body) % 4):
        return None
    if len(body) % 4 == 1 or not re.fullmatch(f"[A-Za-z0-9{re.escape(marks)}]*", body, re.A):
        return None
    raw = base64.b64decode(body + "=" * (-len(body) % 4), altchars=marks.encode())
    again = base64.b64encode(raw, altchars=marks.encode()).decode().rstrip("=")
    return raw if sloppy or again == body else None


def is_b64url(text: str) -> bool:
    return decode_base64(text, "b64u", False) is not None


def decode_hex(text: str, kind: str) -> bytes | None:
    letters = {"hex": "0-9a-fA-F", "hexlc": "0-9a-f", "hexuc": "0-9A-F"}[kind]
    return bytes.fromhex(text) if len(text) % 2 == 0 and re.fullmatch(f"[{letters}]*", text) else None


def decode_base32(text: str, extended: bool) -> bytes | None:
    """Base32, or its extended hex alphabet, without padding."""
    if len(text) % 8 in (1, 3, 6) or not re.fullmatch("[0-9A-V]*" if extended else "[A-Z2-7]*", text):
        return None
    padded = text + "=" * (-len(text) % 8)
    raw = base64.b32hexdecode(padded) if extended else base64.b32decode(padded)
    again = (base64.b32hexencode if extended else base64.b32encode)(raw).decode().rstrip("=")
    return raw if again == text else None


#: Fixed value: the alphabet of RFC 9285.
_BASE45 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"


def decode_base45(text: str) -> bytes | None:
    if len(text) % 3 == 1 or any(c not in _BASE45 for c in text):
        return None
    out = bytearray()
    for k in range(0, len(text), 3):
        part = [_BASE45.index(c) for c in text[k : k + 3]]
        value = sum(v * 45**j for j, v in enumerate(part))
        width = len(part) - 1
        if value >= 256**width:
            return None
        out += value.to_bytes(width, "big")
    return bytes(out)
