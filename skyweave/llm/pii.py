"""Personal data replaced by format-preserving Feistel pseudonyms.

Candidates of each kind are found by a pattern and kept only if they validate (Luhn, mod 97, calendar, octets, number
plans). A value's variable characters are one number in a mixed-radix domain; a keyed Feistel network over that domain,
walked until the result is valid for the kind again, is a permutation of the valid values. So an equal value gets an
equal pseudonym in every document, whatever separators it is written with; format and validity are kept; and the key's
holder can invert it. Work is per document, without a shuffle.

Kinds: email (local part; the domain stays), secret (the value after token, key, password or secret), iban, ip (v4),
date (1900 to 2099, ISO, dotted or slashed), ssn, card, phone (country code stays).

Defined results: a null text stays null with nothing found, an empty text stays empty; repeated rows get equal results;
values that don't validate stay; where two kinds overlap, the one named first above wins; input columns named like an
output column are replaced. A card or iban beside other digits or words is found by trying every reading of the run that
starts and ends at separators, usual card layouts and then longer readings first. Its pseudonym walks on while it would
make a reading valid that comes before it, so that it can be inverted; only then it differs from the value's usual one.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from bisect import bisect_left
from collections.abc import Callable
from datetime import date, timedelta
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweave.llm.common import append_columns, table

ROUNDS = 8
#: The session setting that holds the key, and the key of sessions without one: public, so those pseudonyms hide nothing from who knows it.
KEY_SETTING, DEMO_KEY = "spark.skyweave.pii.key", b"replace-with-a-secret-key"
_DAY0, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Feistel:
    """Keyed permutations of range(n), one a tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, step: int, value: int, modulus: int) -> int:
        width = (modulus.bit_length() + 7) // 8 + 8
        seed = hashlib.blake2b(b"%b|%d|%d" % (tweak, step, value), key=self.key, digest_size=32).digest()
        return int.from_bytes(hashlib.shake_256(seed).digest(width), "big") % modulus

    def permute(self, x: int, n: int, tweak: bytes, valid: Callable[[int], bool] = lambda x: True, back: bool = False) -> int:
        """The image of x (or its preimage); walks on until it is below n and valid, as x itself must be."""
        a = isqrt(max(n - 1, 1)) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if step % 2:
                    right = (right + sign * self._round(tweak, step, left, b)) % b
                else:
                    left = (left + sign * self._round(tweak, step, right, a)) % a
            x = left * b + right
            if x < n and valid(x):
                return x


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


def _alphabets(value: str, hexadecimal: bool) -> list[str]:
    """The alphabet of each variable character: hexadecimal if asked and the value is, else its own class, else fixed."""
    for hexa in _HEX if hexadecimal else ():
        if all(c in hexa for c in value):
            return [hexa] * len(value)
    return [next((a for a in _CLASSES if c in a), "") for c in value]


def _radix(value: str, alphabets: list[str], change: Callable[[int, int], int]) -> str:
    x, n = 0, 1
    for c, a in zip(value, alphabets, strict=True):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    x, out = change(x, n), []
    for c, a in zip(reversed(value), reversed(alphabets), strict=True):
        if a:
            x, k = divmod(x, len(a))
            out.append(a[k])
        else:
            out.append(c)
    return "".join(reversed(out))


def _text(kind: bytes, hexadecimal: bool = False):
    def swap(value: str, f: Feistel, back: bool) -> str:
        alphabets = _alphabets(value, hexadecimal)
        tweak = kind + "".join(a[:1] + str(len(a)) if a else c for c, a in zip(value, alphabets, strict=True)).encode()
        return _radix(value, alphabets, lambda x, n: f.permute(x, n, tweak, back=back))

    return swap


def _refill(value: str, digits: str) -> str:
    """`value` with its digits replaced, separators kept."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), value)


def _numeric(kind: bytes, valid: Callable[[str], bool], fixed: Callable[[str], int] = lambda v: 0):
    """Permute the digits after the `fixed` first ones among those that are valid."""

    def swap(value: str, f: Feistel, back: bool) -> str:
        digits = re.sub(r"\D", "", value)
        head, tail = digits[: (k := fixed(value))], digits[k:]
        show = lambda x: head + f"{x:0{len(tail)}d}"
        return _refill(value, show(f.permute(int(tail), 10 ** len(tail), kind + head.encode() + b"%d" % len(tail), lambda x: valid(show(x)), back)))

    return swap


def _card(value: str, f: Feistel, back: bool, ok: Callable[[str], bool] = lambda v: True) -> str:
    digits = re.sub(r"\D", "", value)

    def show(x: int) -> str:
        body = f"{x:0{len(digits) - 1}d}"
        return _refill(value, next(body + c for c in "0123456789" if luhn(body + c)))

    return show(f.permute(int(digits[:-1]), 10 ** (len(digits) - 1), b"card%d" % len(digits), lambda x: ok(show(x)), back))


def _iban(value: str, f: Feistel, back: bool, ok: Callable[[str], bool] = lambda v: True) -> str:
    plain = value.replace(" ", "")
    swap = _text(b"iban" + plain[:2].encode())
    body = plain[4:]
    while True:
        body = swap(body, f, back)
        out = iter(f"{plain[:2]}{98 - _mod97(f'{plain[:2]}00{body}'):02d}{body}")
        if ok(shown := "".join(c if c == " " else next(out) for c in value)):
            return shown


def _ip(value: str, f: Feistel, back: bool) -> str:
    x = f.permute(int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32, b"ip", back=back)
    return ".".join(map(str, x.to_bytes(4, "big")))


_DATES = ((re.compile(r"(\d{4})-(\d\d)-(\d\d)"), (0, 1, 2)), (re.compile(r"(\d\d)\.(\d\d)\.(\d{4})"), (2, 1, 0)), (re.compile(r"(\d\d)/(\d\d)/(\d{4})"), (2, 1, 0)), (re.compile(r"(\d\d)/(\d\d)/(\d{4})"), (2, 0, 1)))


def _parse_date(value: str) -> tuple[int, int] | None:
    """(day number, which of _DATES), the first reading that is a calendar day of 1900 to 2099."""
    for k, (form, (y, m, d)) in enumerate(_DATES):
        if got := form.fullmatch(value):
            parts = list(map(int, got.groups()))
            try:
                day = (date(parts[y], parts[m], parts[d]) - _DAY0).days
            except ValueError:
                continue
            if 0 <= day < _DAYS:
                return day, k
    return None


def _write_date(day: int, k: int) -> str:
    when = _DAY0 + timedelta(days=day)
    return (f"{when:%Y-%m-%d}", f"{when:%d.%m.%Y}", f"{when:%d/%m/%Y}", f"{when:%m/%d/%Y}")[k]


def _date(value: str, f: Feistel, back: bool) -> str:
    day, k = _parse_date(value)
    # A slashed day must be read the same way again, so that equal values stay linked and can be inverted.
    return _write_date(f.permute(day, _DAYS, b"date" if k < 3 else b"date-us", lambda x: _parse_date(_write_date(x, k)) == (x, k), back), k)


def _ssn_valid(d: str) -> bool:
    return d[:3] not in {"000", "666"} and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _country(value: str) -> int:
    """Digits of the country code that stay: those before the first separator after a plus, else none (1 to 3)."""
    if not value.startswith("+"):
        return 0
    return min(3, len(re.match(r"\+(\d+)", value)[1])) if re.match(r"\+\d{1,3}\D", value) else 1


def _phone_valid(digits: str, value: str) -> bool:
    return 8 <= len(digits) <= 15 if value.startswith("+") else len(digits) == 10


def _phone(value: str, f: Feistel, back: bool) -> str:
    return _numeric(b"phone", lambda d: _phone_valid(d, value), _country)(value, f, back)


def _digits(value: str) -> str:
    return re.sub(r"\D", "", value)


#: Kind, pattern (the value is group 1), validation and permutation, in order of precedence.
KINDS = [
    ("email", re.compile(r"(?<![\w.%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"), lambda v: True, _text(b"email")),
    ("secret", re.compile(r"(?i:\b(?:api[_-]?key|access[_-]?key|key|token|secret|password|passwd)\b[\"']?\s*[=:]\s*[\"']?)([A-Za-z0-9+/_-]{16,})"), lambda v: True, _text(b"secret", True)),
    ("iban", re.compile(r"(?<!\w)([A-Z]{2}\d{2}[A-Z0-9]*(?: [A-Z0-9]+)*)(?!\w)"), lambda v: 15 <= len(v.replace(" ", "")) <= 34 and _mod97(v.replace(" ", "")) == 1, _iban),
    ("ip", re.compile(r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"), lambda v: all(int(o) < 256 and str(int(o)) == o for o in v.split(".")), _ip),
    ("date", re.compile(r"(?<![\w./-])(\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})(?![\w/-]|\.\d)"), lambda v: _parse_date(v) is not None, _date),
    ("ssn", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])"), lambda v: _ssn_valid(_digits(v)), _numeric(b"ssn", _ssn_valid)),
    ("card", re.compile(r"(?<![\w.-])(\d(?:[ -]?\d){12,})(?!\w|-\d)"), lambda v: luhn(_digits(v)) and _digits(v).strip("0") != "", _card),
    ("phone", re.compile(r"(?<![\w.+-])(\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,5})){1,5}|(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\w|-\d)"), lambda v: _phone_valid(_digits(v), v), _phone),
]
_MAYBE = re.compile(r"[0-9@]|(?i:token|key|secret|passw)")

FIELDS = [T.StructField("n_found", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))]


def _card_readings(run: str) -> list[tuple[int, int]]:
    """Readings of 13 to 19 digits from border to border of digit groups: usual layouts, then longer ones first."""
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    ranked = []
    for i, (a, _) in enumerate(groups):
        sizes: list[int] = []
        for x, b in groups[i:]:
            sizes.append(b - x)
            n = sum(sizes)
            if n > 19:
                break
            if n >= 13:
                ranked.append((len(sizes) > 1 and sizes not in ([4, 4, 4, 4], [4, 6, 5]), -n, a, b))
    return [(a, b) for *_, a, b in sorted(ranked)]


_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")


def _iban_readings(run: str) -> list[tuple[int, int]]:
    """Readings of the form of an iban from border to border of words, longer ones first."""
    words = [m.span() for m in re.finditer(r"[A-Z0-9]+", run)]
    ranked = []
    for i, (a, _) in enumerate(words):
        for _, b in words[i : i + 10]:
            if b - a > 44:
                break
            if _IBAN.fullmatch(run, a, b):
                ranked.append((a - b, a, b))
    return [(a, b) for _, a, b in sorted(ranked)]


#: Kinds whose pattern finds runs, of which each reading may be a value.
READINGS = {"card": _card_readings, "iban": _iban_readings}


def _find(text: str) -> tuple[list[tuple[int, int, int]], dict[int, list[tuple[int, int]]]]:
    """Values as find gives them, and for the start of some the readings before it in order that overlap it and must stay invalid."""
    found: list[tuple[int, int, int]] = []
    rivals: dict[int, list[tuple[int, int]]] = {}
    if not _MAYBE.search(text):
        return found, rivals
    for k, (name, form, valid, _) in enumerate(KINDS):
        before = sorted(found)
        starts = [x for x, _, _ in before]
        free = lambda a, b: not (at := bisect_left(starts, b)) or before[at - 1][1] <= a  # noqa: E731, B023
        for m in form.finditer(text):
            a, b = m.span(1)
            if name not in READINGS:
                if valid(m[1]) and free(a, b):
                    found.append((a, b, k))
                continue
            taken = [-1] * (b - a)  # the value that holds each character
            losers: dict[int, list[tuple[int, int]]] = {}  # invalid readings by character
            for x, y in READINGS[name](m[1]):
                if any(t >= 0 for t in taken[x:y]) or not free(a + x, a + y):
                    continue
                if valid(m[1][x:y]):
                    taken[x:y] = [x] * (y - x)
                    found.append((a + x, a + y, k))
                    lost = {r for c in range(x, y) for r in losers.get(c, ())}
                    if lost:
                        rivals[a + x] = sorted((a + u, a + v) for u, v in lost)
                else:
                    for c in range(x, y):
                        losers.setdefault(c, []).append((x, y))
    return sorted(found), rivals


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every validated value, in text order, without overlaps."""
    return _find(text)[0]


def swap(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[str]]:
    """The text with pseudonyms (or, back, with the values again) and the kinds found."""
    found, rivals = _find(text)
    now = list(text) if rivals else []
    new = []
    # Back is the reverse order: a value is swapped among its neighbours as they are then.
    for a, b, k in reversed(found) if back else found:
        _, _, valid, change = KINDS[k]
        if a in rivals:

            def ok(value: str, a=a, b=b, valid=valid) -> bool:
                now[a:b] = value
                return not any(valid("".join(now[x:y])) for x, y in rivals[a])

            new.append(change(text[a:b], feistel, back, ok))
        else:
            new.append(change(text[a:b], feistel, back))
        if rivals:
            now[a:b] = new[-1]
    out, at = [], 0
    for (a, b, _), value in zip(found, reversed(new) if back else new, strict=True):
        out += [text[at:a], value]
        at = b
    return "".join(out) + text[at:], [KINDS[k][0] for _, _, k in found]


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """`docs` with `text` rewritten, n_found (values) and kinds (distinct, sorted)."""

    def make():
        feistel = Feistel(key)

        def run(col: pa.Array) -> list[pa.Array]:
            rows = [(None, []) if t is None else swap(t, feistel, back) for t in col.to_pylist()]
            return [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([sorted(set(r[1])) for r in rows], pa.list_(pa.string()))]

        return run

    order = [c for c in docs.columns if c.lower() not in {f.name for f in FIELDS}]
    return append_columns(docs, [text], [T.StructField(text, T.StringType()), *FIELDS], make).select(*order, *[f.name for f in FIELDS])


def key_of(spark: SparkSession) -> bytes:
    """The session's secret key; without one, DEMO_KEY and a warning."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key.encode()
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are keyed by a public key", stacklevel=2)
    return DEMO_KEY


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    out = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return out.select("doc_id", "text", "n_found", F.concat_ws(",", "kinds").alias("kinds"))
