"""Encodings of XML bytes."""

from __future__ import annotations

#: Codecs by encoding name; the native ones are little-endian here.
CODECS = {"utf8": "utf-8", "utf16_le": "utf-16-le", "utf16_be": "utf-16-be", "utf16": "utf-16-le", "utf32_le": "utf-32-le", "utf32_be": "utf-32-be", "utf32": "utf-32-le", "wchar": "utf-32-le", "latin1": "latin-1"}

#: First bytes and what they say, in order; byte order marks come before forms of '<'.
MARKS = [
    (b"\x00\x00\xfe\xff", "utf32_be"), (b"\xff\xfe\x00\x00", "utf32_le"), (b"\xfe\xff", "utf16_be"), (b"\xff\xfe", "utf16_le"), (b"\xef\xbb\xbf", "utf8"),
    (b"\x00\x00\x00<", "utf32_be"), (b"<\x00\x00\x00", "utf32_le"), (b"\x00<\x00?", "utf16_be"), (b"<\x00?\x00", "utf16_le"), (b"<?xm", "utf8"), (b"\x00<", "utf16_be"), (b"<\x00", "utf16_le"),
]


def detect(data: bytes, encoding: str = "auto") -> str:
    """The encoding given, or the one that the first bytes of four or more show; utf8 otherwise."""
    if encoding != "auto":
        return encoding
    return next((name for mark, name in MARKS if data.startswith(mark)), "utf8") if len(data) >= 4 else "utf8"


def decode(data: bytes, encoding: str = "auto") -> tuple[str, str]:
    """(text, encoding found); invalid sequences are left out, a byte order mark is dropped."""
    found = detect(data, encoding)
    return data.decode(CODECS[found], "ignore").removeprefix("﻿"), found


def encode(text: str, encoding: str = "utf8", bom: bool = False) -> bytes:
    """Bytes of a text; characters that the encoding lacks become '?'."""
    codec = CODECS["utf8" if encoding == "auto" else encoding]
    return ("﻿" + text if bom and codec != "latin-1" else text).encode(codec, "replace")
