"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found by pattern and validated (check digits, calendar, ranges). Each is
mapped to an integer below the number of values its format allows and permuted there by a keyed
Feistel network; integers that leave the range are permuted again until they are back. So a
pseudonym has the form of what it stands for, equal values get equal pseudonyms in every
document and every writing, different values different ones, and only the key can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import in_arrow

ROUNDS = 10
KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "date")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

_EMAIL = r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}(?![\w-]))"
#: In the order in which kinds that begin at one place are tried.
_SHAPES = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=[Tt][0-9])|(?![\w/-]|\.[0-9]))"
            r"|[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![\w/-]|\.[0-9]))",
    "ipv4": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w-])[0-9](?:[\x20-]?[0-9]){12,18}(?!\w|-(?![0-9]))",
    "phone": r"(?<![\w])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}(?!\w)"
             r"|(?<![\w-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])",
}
_NUMBERS = r"(?=[A-Z0-9+(])(?:" + "|".join(f"(?P<{kind}>{shape})" for kind, shape in _SHAPES.items()) + ")"
#: Texts without an at sign need not look for mail addresses.
_PATTERNS = {True: re.compile(f"{_EMAIL}|{_NUMBERS}", re.A), False: re.compile(_NUMBERS, re.A)}
_ONE = {kind: re.compile(shape, re.A) for kind, shape in _SHAPES.items()}
#: Kinds whose shape may run on into what follows the value.
_OPEN = ("iban", "card", "phone")
#: Characters of an account number by country.
_IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 "
    "FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
    "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 "
    "RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}


def feistel(value: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed permutation of 0..size-1. Two halves of equal width swap through keyed rounds;
    values outside the range are walked through until one is inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    head = tweak.encode() + size.to_bytes((size.bit_length() + 7) // 8, "big")

    def turn(step: int, right: int) -> int:
        out, block = b"", 0
        while len(out) < width:
            out += hashlib.blake2b(
                right.to_bytes(width, "big") + bytes([step, block % 256]) + head, key=key, digest_size=32).digest()
            block += 1
        return int.from_bytes(out[:width], "big") & mask

    while True:
        left, right = value >> half, value & mask
        for step in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            if undo:
                left, right = right ^ turn(step, left), left
            else:
                left, right = right, left ^ turn(step, right)
        value = (left << half) | right
        if value < size:
            return value


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _permuted(text: str, alphabets: list[str], key: bytes, tweak: str, undo: bool) -> str:
    """Every character replaced within its own alphabet, the whole as one mixed-radix number."""
    value, size = 0, 1
    for c, letters in zip(text, alphabets):
        value, size = value * len(letters) + letters.index(c), size * len(letters)
    value = feistel(value, size, key, tweak, undo)
    out = []
    for letters in reversed(alphabets):
        value, k = divmod(value, len(letters))
        out.append(letters[k])
    return "".join(reversed(out))


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def _laid_out(found: str, fresh: str) -> str:
    """The characters of `fresh` in the places of the letters and digits of `found`."""
    it = iter(fresh)
    return "".join(next(it) if c.isalnum() else c for c in found)


def _email(found: str, key: bytes, undo: bool) -> str | None:
    local, _, domain = found.rpartition("@")
    plain = [c.lower() for c in local if c.isalnum()]
    fresh = _permuted("".join(plain), [_DIGITS if c.isdigit() else _LETTERS for c in plain], key, "email@" + domain.lower(), undo)
    return _laid_out(local, fresh) + "@" + domain


def _card(found: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    # The issuer digit and the rest but the check digit permute; the check digit follows.
    body = digits[0] + _permuted(digits[1:-1], [_DIGITS] * (len(digits) - 2), key, "card" + digits[0], undo)
    return _laid_out(found, body + next(c for c in _DIGITS if luhn(body + c)))


def _iban(found: str, key: bytes, undo: bool) -> str | None:
    plain = found.replace(" ", "")
    if plain != plain.upper() or not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    country, body = plain[:2], plain[4:]
    fresh = _permuted(body, [_DIGITS if c.isdigit() else _LETTERS.upper() for c in body], key, "iban" + country, undo)
    return _laid_out(found, f"{country}{98 - _mod97(country + '00' + fresh):02d}{fresh}")


def _ssn(found: str, key: bytes, undo: bool) -> str | None:
    area, group, serial = (int(x) for x in found.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    at = area - 1 - (area > 666)
    value = feistel((at * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", undo)
    value, serial = divmod(value, 9999)
    at, group = divmod(value, 99)
    return f"{at + 1 + (at >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(found: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 7 <= len(digits) <= 15:
        return None
    keep = len(re.match(r"\+?([0-9]{0,3})", found)[1]) if found.startswith("+") else 0
    keep = min(keep, max(len(digits) - 7, 0))
    # The number permutes within its country code and length.
    return _laid_out(found, digits[:keep] + _permuted(digits[keep:], [_DIGITS] * (len(digits) - keep), key, "phone" + digits[:keep], undo))


def _ipv4(found: str, key: bytes, undo: bool) -> str | None:
    parts = [int(x) for x in found.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
        return None
    value = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4", undo)
    return ".".join(str(b) for b in value.to_bytes(4, "big"))


def _date(found: str, key: bytes, undo: bool) -> str | None:
    mark = found[4] if found[4] in "-" else found[2]
    numbers = [int(x) for x in re.split(r"[./-]", found)]
    try:
        if mark == "-":
            day, form = datetime.date(*numbers), "%Y-%m-%d"
        elif mark == "." or numbers[0] > 12:
            day, form = datetime.date(numbers[2], numbers[1], numbers[0]), f"%d{mark}%m{mark}%Y"
        else:
            day, form = datetime.date(numbers[2], numbers[0], numbers[1]), f"%m{mark}%d{mark}%Y"
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    size = (LAST_DAY - FIRST_DAY).days + 1
    return (FIRST_DAY + datetime.timedelta(days=feistel((day - FIRST_DAY).days, size, key, "date", undo))).strftime(form)


_MAKERS: dict[str, Callable] = {
    "email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "date": _date,
}


def _usual(kind: str, found: str) -> int:
    """Letters and digits that a number of this beginning usually has; 0 where none is usual."""
    if kind == "iban":
        return _IBAN_LENGTHS.get(found[:2], 0)
    if kind != "card":
        return 0
    head = re.sub(r"\D", "", found[:5])[:2]
    return 15 if head in ("34", "37") else 14 if head in ("30", "36", "38", "39") else 16


def _ends(kind: str, text: str, begin: int, end: int) -> list[int]:
    """Ends to try for a shape found at `begin` to `end`: the number's usual length, then from the
    longest down. All but the longest are followed by a separator inside of what was found."""
    if kind not in _OPEN:
        return [end]
    ends = [end] + [e for e in range(end - 1, begin, -1) if text[e] in " .-" and _ONE[kind].fullmatch(text, begin, e)]
    usual = _usual(kind, text[begin:end])
    return sorted(ends, key=lambda e: sum(c.isalnum() for c in text[begin:e]) != usual) if usual else ends


def pseudonymise(text: str, key: bytes, undo: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and `begin, end, kind` (code points of the given text) of each.

    A shape may have swallowed what follows a value. If it fails its validation, its shorter ends
    are tried, then the kinds after it in the pattern from the same place on, and then the next
    character. A pseudonym that a try before the chosen one would accept is permuted again, so
    that the text with pseudonyms is read the same way.
    """
    out, spans, last, at = [], [], 0, 0
    pattern, kinds = _PATTERNS["@" in text], list(_SHAPES)
    while found := pattern.search(text, at):
        begin, kind = found.start(), found.lastgroup
        fresh, end, failed = None, found.end(), []
        if kind == "email":
            fresh = _MAKERS[kind](found[0], key, undo)
        for kind in kinds[kinds.index(kind):] if fresh is None else ():
            shape = found if kind == found.lastgroup else _ONE[kind].match(text, begin)
            for end in _ends(kind, text, begin, shape.end()) if shape else ():
                fresh = _MAKERS[kind](text[begin:end], key, undo)
                if fresh is not None:
                    break
                failed.append((kind, end))
            if fresh is not None:
                break
        if fresh is None:
            at = begin + 1
            continue
        while any(_MAKERS[k]((fresh + text[end:e])[: e - begin], key, undo) is not None for k, e in failed):
            fresh = _MAKERS[kind](fresh, key, undo)
        out += [text[last:begin], fresh]
        spans.append((begin, end, kind))
        last = at = end
    return "".join(out) + text[last:], spans


def _rows(key: bytes):
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    may_hold = re.compile(r"[0-9@]").search

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, texts, spans = batch.column(1), [], []
            for i in range(batch.num_rows):
                text = column[i].as_py()
                found: list = []
                if text and may_hold(text):
                    text, found = pseudonymise(text, key)
                texts.append(text)
                spans.append([{"begin": b, "end": e, "kind": k} for b, e, k in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "spans"])

    return run


def pseudonyms(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, text, spans` of every row: the text with pseudonyms and where they replaced what.

    `secret` is the key of all permutations (1 to 64 bytes). Null texts stay null and empty ones
    empty, without spans. Rows come back one for one, also repeated ones and those without an
    id; other columns are not read.
    """
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_arrow(narrow, _rows(secret),
                    "doc_id bigint, text string, spans array<struct<begin: bigint, end: bigint, kind: string>>")
