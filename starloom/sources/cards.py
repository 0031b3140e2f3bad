"""FITS header cards as 80-character text: values, long texts, long names, commentary; and number text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

# Names of commentary cards.
COMMENTARY = ("COMMENT", "HISTORY", "")
STANDARD = re.compile(r"[A-Z0-9_-]{1,8}")
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?")
COMPLEX = re.compile(rf"\(\s*{NUMBER.pattern}\s*,\s*{NUMBER.pattern}\s*\)")
#: Characters of a text in one card where it goes on in the next, besides the ``&``.
PART = 66


def ascii_text(text: str) -> str:
    """Printable ASCII; a question mark for each other character."""
    return "".join(c if " " <= c <= "~" else "?" for c in text)


def is_number(value: str) -> bool:
    return bool(NUMBER.fullmatch(value.strip()) or COMPLEX.fullmatch(value.strip()))


def quoted(text: str) -> str:
    doubled = text.replace("'", "''")
    return f"'{doubled:<8}'"


def unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1].replace("''", "'").rstrip() if value.startswith("'") and value.endswith("'") and len(value) > 1 else value


def format_double(x: float) -> str:
    """The shortest of 15, 16 and 17 significant digits that reads back as the same number."""
    return next((t for n in (15, 16) if float(t := f"{x:.{n}g}") == x), f"{x:.17g}")


def value_text(value: str) -> str:
    """A value as a card holds it: logical, number with a capital exponent, or quoted text."""
    v = value.strip()
    if v in ("T", "F") or v.startswith("'"):
        return v
    return v.upper() if is_number(v) else quoted(ascii_text(value))


def format_card(name: str, value: str = "", comment: str = "") -> list[bytes]:
    """The cards of a keyword, in order. ``value`` is FITS text (quoted, a number, T or F) or plain text.

    A text too long for a card goes on in CONTINUE cards; a comment that does
    not fit is cut; a name that is not standard becomes a HIERARCH card, and
    one that cannot be written at all gives no card.
    """
    name, comment = ascii_text(name).strip().upper(), ascii_text(comment)
    if name in COMMENTARY:
        text = comment or ascii_text(value)
        return [f"{name:<8}{text[i : i + 72]}".ljust(80).encode() for i in range(0, max(1, len(text)), 72)]
    if "=" in name:
        return []
    head = f"{name:<8}= " if STANDARD.fullmatch(name) else f"HIERARCH {name} = "
    text = value_text(ascii_text(value)) if value else ""
    if not text.startswith("'"):
        line = f"{head}{text:>20}" if len(head) == 10 else head + text
        if len(line) > 80:
            return []
        return [(f"{line} / {comment}" if comment else line)[:80].ljust(80).encode()]
    line = f"{head}{text:<20}" if len(head) == 10 else head + text
    if len(line) <= 80:
        return [(f"{line} / {comment}" if comment else line)[:80].ljust(80).encode()]
    if len(head) != 10:
        return []
    rest, parts = text[1:-1].rstrip(), []
    while len(rest) > PART:
        cut = PART - (rest[:PART].count("'") % 2 if rest[PART - 1] == "'" else 0)  # a doubled quote stays together
        parts.append(rest[:cut])
        rest = rest[cut:]
    parts.append(rest)
    out = []
    for i, part in enumerate(parts):
        more = "&" if i + 1 < len(parts) else ""
        line = f"{head if not i else 'CONTINUE  '}'{part}{more}'"
        if not more and comment:
            line = f"{line} / {comment}"
        out.append(line[:80].ljust(80).encode())
    return out


def header(cards: list[tuple[str, str, str]]) -> bytes:
    """Formatted cards up to END, padded to whole blocks; LONGSTRN announces the first continued text."""
    out: list[bytes] = []
    for card in cards:
        made = format_card(*card)
        if len(made) > 1 and made[1].startswith(b"CONTINUE") and not any(c.startswith(b"LONGSTRN") for c in out):
            out += format_card("LONGSTRN", "'OGIP 1.0'", "long texts may go on in CONTINUE cards")
        out += made
    text = b"".join([*out, b"END".ljust(80)])
    return text.ljust(-(-len(text) // 2880) * 2880)


#: A point in time: signed years of four and more digits, second 60, and an offset.
TIME = re.compile(r"([+-]?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d):(\d\d)(\.\d+)?)?(Z|[+-]\d\d(?::?\d\d)?)?")


def is_time_point(text: str) -> bool:
    m = TIME.fullmatch(text.strip())
    if not m:
        return False
    year, month, day = int(m[1]), int(m[2]), int(m[3])
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    days = (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    if not 1 <= month <= 12 or not 1 <= day <= days[month - 1]:
        return False
    return m[4] is None or (int(m[4]) <= 23 and int(m[5]) <= 59 and int(m[6]) <= 60)


def fits_date(text: str) -> str | None:
    """A point in time as DATE-OBS has it; None unless it is one at no offset."""
    m = TIME.fullmatch(text.strip())
    if not m or not is_time_point(text) or (m[8] or "Z").replace(":", "") not in ("Z", "+00", "-00", "+0000", "-0000"):
        return None
    return text.strip().removesuffix(m[8] or "") if m[8] else text.strip()


def exif_time(text: str) -> str | None:
    """``2024:01:31 12:00:00`` as a point in time."""
    m = re.fullmatch(r"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)\0?", text)
    made = f"{m[1]}-{m[2]}-{m[3]}T{m[4]}:{m[5]}:{m[6]}" if m else ""
    return made if made and is_time_point(made) else None


def plus_seconds(text: str, seconds: float) -> str:
    """A point in time moved on."""
    moved = datetime.fromisoformat(text.replace("Z", "+00:00")) + timedelta(seconds=seconds)
    return moved.isoformat().replace("+00:00", "Z")
