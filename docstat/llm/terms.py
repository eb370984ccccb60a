"""Terms of a text: runs of digits, ASCII letters in lower case and characters beyond ASCII."""

from __future__ import annotations

#: Each byte of UTF-8 as a term has it; a space where none has.
_AS_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: The same in SQL: of a text whose A-Z are lower-cased.
SQL_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def terms_of(text: bytes | None) -> list[bytes]:
    """In order, with repeats; null has none."""
    return text.translate(_AS_TERM).split() if text else []
