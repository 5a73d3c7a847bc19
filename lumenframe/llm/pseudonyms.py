"""Format-preserving pseudonyms for personal data.

Validated values (mail addresses, telephone, card and social security numbers, IBANs, IPv4
addresses, dates, quoted secrets) are replaced by other values of the same format. A value
is numbered within the set of all values of its format and that number is permuted by a keyed
Feistel network, walked along its cycle until it lands in the set again. So equal values have
equal pseudonyms in all documents, different values different ones, check digits stay right,
and who has the key can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
HINT = re.compile(r"[0-9@]|(?i:secret|passw|token|key)")
VALUE = re.compile(
    r"""(?P<mail>(?<![\w.%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)
|(?i:\b(?:token|secret|api[ _-]?key|passwo?r?d|access[ _-]?key)\b\s{0,3}[=:]\s{0,3}["']?)(?P<secret>[A-Za-z0-9_/+-]{16,128})(?![A-Za-z0-9_/+-])
|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])
|(?<![\w.+-])(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![\w-]|\.[0-9])
|(?<![\w./-])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.[0-9])
|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])
|(?<![\w+.,-])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![\w-]|[.,][0-9])
|(?<![\w+(.,-])(?P<phone>(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5})(?![\w-])""",
    re.VERBOSE,
)


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network on an even number of bits, walked until the value is below size."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    salt = hashlib.blake2b(f"{tweak}|{size}".encode(), digest_size=16, key=key[:64]).digest()

    def f(i: int, v: int) -> int:
        out = b""
        while len(out) < width:
            out += hashlib.blake2b(salt + bytes([i, len(out) // 64]) + v.to_bytes(width, "big"), key=key[:64]).digest()
        return int.from_bytes(out[:width], "big") & mask

    while True:
        left, right = x >> half, x & mask
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ f(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ f(i, right)
        x = left << half | right
        if x < size:
            return x


CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _classes(text: str, sets: tuple[str, ...] = CLASSES) -> list[str]:
    """For each character, the set it is permuted within; others stay."""
    return [next((s for s in sets if c in s), c) for c in text]


def _by_class(text: str, move: Callable[[int, int], int], sets: tuple[str, ...] = CLASSES) -> str:
    kinds, x, size = _classes(text, sets), 0, 1
    for c, s in zip(text, kinds):
        x, size = x * len(s) + s.index(c), size * len(s)
    x, out = move(x, size), []
    for s in reversed(kinds):
        x, d = divmod(x, len(s))
        out.append(s[d])
    return "".join(reversed(out))


def _refill(layout: str, digits: str) -> str:
    """layout with its digits (and capital letters) replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def luhn(digits: str) -> int:
    """The sum of which a multiple of ten is right."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def _mail(v, move):
    local, _, domain = v.partition("@")
    return f"{_by_class(local, lambda x, n: move(x, n, domain.lower()))}@{domain}"


def _secret(v, move):
    if re.fullmatch(r"[0-9a-f]+", v):
        return _by_class(v, move, ("0123456789abcdef",))
    return _by_class(v, move) if re.search("[0-9]", v) else None


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(v, move):
    s = v.replace(" ", "")
    if not 15 <= len(s) <= 34 or _mod97(s) != 1:
        return None
    body = _by_class(s[4:], lambda x, n: move(x, n, s[:2]))
    return _refill(v, f"{s[:2]}{98 - _mod97(s[:2] + '00' + body):02d}{body}")


def _ip(v, move):
    parts = v.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(v, move):
    a, b, c = re.split(r"[-/.]", v)
    order = "ymd" if len(a) == 4 else "dmy" if "." in v or int(a) > 12 else "mdy"
    at = dict(zip(order, map(int, (a, b, c))))
    try:
        day = datetime.date(at["y"], at["m"], at["d"]).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    while True:  # in a layout that only a day over 12 tells, the pseudonym has such a day too
        day = FIRST_DAY + move(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, order)
        out = datetime.date.fromordinal(day)
        if order != "dmy" or "." in v or out.day > 12:
            break
    sep = v[4] if order == "ymd" else v[2]
    return sep.join(f"{getattr(out, {'y': 'year', 'm': 'month', 'd': 'day'}[k]):0{4 if k == 'y' else 2}d}" for k in order)


def _ssn(v, move):
    area, group, serial = map(int, v.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = move(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _card(v, move):
    digits = re.sub("[ -]", "", v)
    if luhn(digits) % 10 or digits == digits[0] * len(digits):
        return None
    body = f"{move(int(digits[:-1]), 10 ** (len(digits) - 1)):0{len(digits) - 1}d}"
    return _refill(v, f"{body}{-luhn(body + '0') % 10}")


def _phone(v, move):
    """The country code stays. Ten national digits keep the rule that area and exchange begin with 2 to 9, if they do."""
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", v)
    head = code[0] if code else "+" * v.startswith("+")
    digits = re.sub("[^0-9]", "", v[len(head) :])
    if not 7 <= len(digits) <= 14:
        return None
    strict = len(digits) == 10 and digits[0] > "1" and digits[3] > "1"
    x = size = 0
    kinds = ["23456789" if strict and i in (0, 3) else "0123456789" for i in range(len(digits))]
    size = 1
    for c, s in zip(digits, kinds):
        x, size = x * len(s) + s.index(c), size * len(s)
    x, out = move(x, size, head + "n" * strict), []
    for s in reversed(kinds):
        x, d = divmod(x, len(s))
        out.append(s[d])
    return head + _refill(v[len(head) :], "".join(reversed(out)))


MAKERS = {"mail": _mail, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The value's pseudonym, or with back the value of a pseudonym; None if the value isn't valid."""
    return MAKERS[kind](value, lambda x, size, tweak="": permute(x, size, key, f"{kind}|{tweak}", back))


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length in the result) of each. Values that fail validation stay; null stays null."""
    if not text or not HINT.search(text):
        return text, []
    out, found, at, shift = [], [], 0, 0
    pos = 0
    while m := VALUE.search(text, pos):
        kind = m.lastgroup
        new = pseudonym(kind, m[kind], key)
        if new is None:  # something else may begin within it
            pos = m.start() + 1 if m.end() <= m.start() + 1 else _next(text, m)
            continue
        start, end = m.span(kind)
        out += [text[at:start], new]
        found.append((kind, start + shift, len(new)))
        shift += len(new) - (end - start)
        at = pos = end
    out.append(text[at:])
    return "".join(out), found


def _next(text: str, m: re.Match) -> int:
    """Where to look on after a match that is not valid: behind its first run of letters or digits, so a long run is not tried at each place."""
    run = re.compile(r"[A-Za-z0-9]+").search(text, m.start(), m.end())
    return run.end() if run else m.end()


def _replacer(key: bytes, name: str) -> Callable:
    def f(texts: list) -> dict[str, list]:
        done = [replace(t, key) for t in texts]
        kinds = [Counter(k for k, _, _ in found) for _, found in done]
        return {name: [t for t, _ in done], "n_pii": [len(found) for _, found in done], "pii_kinds": [",".join(f"{k}:{n}" for k, n in sorted(c.items())) for c in kinds]}

    return f


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with pseudonyms in the text column, and n_pii long, pii_kinds string ("card:2,mail:1"; empty if none).

    One pass without a shuffle. Null texts stay null with n_pii 0; input columns named n_pii
    or pii_kinds are replaced; all others pass through; repeated rows come out alike.
    """
    if not key:
        raise ValueError("the key is empty")
    spec = T.StructType([T.StructField(text, T.StringType()), *common.fields("n_pii long, pii_kinds string")])
    order = [c for c in docs.columns if c.lower() not in ("n_pii", "pii_kinds")]
    out = common.add_columns(docs, text, spec, partial(_replacer, key, text))
    return out.select(*[f"`{c}`" for c in order], "n_pii", "pii_kinds")


#: The key of the queries and the pipeline; a deployment gives its own.
DEMO_KEY = b"lumenframe demonstration key"


def op5_pseudonyms(spark, sf_dir):
    """doc_id, text, n_pii, pii_kinds of each row of documents; nulls and repeated rows as pseudonymise has them."""
    return pseudonymise(common.read(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
