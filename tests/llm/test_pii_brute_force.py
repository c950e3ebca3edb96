"""The finder of personal data against every substring of short texts, judged by rules written apart from it."""

import datetime
import random

import pytest

from skyweave.llm import pii

KINDS = [k for k, *_ in pii.KINDS]
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"


def _all(text, allowed):
    return text != "" and all(c in allowed for c in text)


def _shape(text):
    """A text with every digit as 9."""
    return "".join("9" if c in DIGITS else c for c in text)


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (2 if k % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0 and int(digits) > 0


def _email(v):
    local, _, domain = v.partition("@")
    parts = domain.split(".")
    return _all(local[:1], LETTERS + DIGITS) and _all(local, LETTERS + DIGITS + "._%+-") and len(parts) > 1 and all(_all(p, LETTERS + DIGITS + "-") for p in parts[:-1]) and len(parts[-1]) >= 2 and _all(parts[-1], LETTERS)


def _ip(v):
    parts = v.split(".")
    return len(parts) == 4 and all(_all(p, DIGITS) and len(p) <= 3 and int(p) < 256 and str(int(p)) == p for p in parts)


def _date(v):
    orders = {"9999-99-99": [(0, 4, 5, 7, 8, 10)], "99.99.9999": [(6, 10, 3, 5, 0, 2)], "99/99/9999": [(6, 10, 3, 5, 0, 2), (6, 10, 0, 2, 3, 5)]}.get(_shape(v), [])
    for a, b, c, d, e, f in orders:
        try:
            datetime.date(int(v[a:b]), int(v[c:d]), int(v[e:f]))
            return True
        except ValueError:
            continue
    return False


def _ssn(v):
    return _shape(v) == "999-99-9999" and v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"


def _iban(v):
    plain = v.replace(" ", "")
    grouped = v == plain or all(len(p) == 4 for p in v.split(" ")[:-1]) and 1 <= len(v.split(" ")[-1]) <= 4
    if not (15 <= len(plain) <= 34 and _all(plain[:2], LETTERS[26:]) and _all(plain[2:4], DIGITS) and _all(plain, LETTERS[26:] + DIGITS) and grouped):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _card(v):
    digits = [c for c in v if c in DIGITS]
    single = all(not (a in " -" and b in " -") for a, b in zip(v, v[1:], strict=False))
    return v[0] in DIGITS and v[-1] in DIGITS and _all(v, DIGITS + " -") and single and 13 <= len(digits) <= 19 and _luhn("".join(digits))


RULES = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}


def _rank(kind, v, a):
    """Which of two overlapping values of a kind goes first."""
    if kind == "card":
        sizes = [len(p) for p in v.replace("-", " ").split(" ")]
        return len(sizes) > 1 and sizes not in ([4, 4, 4, 4], [4, 6, 5]), -sum(sizes), a
    return (-len(v), a, 0) if kind == "iban" else (a, -len(v), 0)


def _group_starts(text, a):
    """Whether a group of digits that may be a card's starts at a place: inside a run of groups, or where a run may start."""
    return text[a] in DIGITS and (a == 0 or text[a - 1] in " -" and a > 1 and text[a - 2] in DIGITS or not (text[a - 1].isalnum() or text[a - 1] in "_.-"))


def _group_ends(text, b):
    after = text[b : b + 2]
    return text[b - 1] in DIGITS and (after == "" or after[0] in " -" and after[1:] in DIGITS and after[1:] != "" or not (after[0].isalnum() or after[0] == "_"))


def _brute(text):
    """Every substring that stands between borders and fits a rule; kinds in order of precedence."""
    border = [True] + [text[k - 1] in " ,;\n" or text[k] in " ,;\n" for k in range(1, len(text))] + [True]
    found = []
    for kind in KINDS:
        if kind not in RULES:
            continue
        starts = [a for a in range(len(text)) if (_group_starts(text, a) if kind == "card" else border[a] and text[a] not in " ,;\n")]
        ends = {b for b in range(1, len(text) + 1) if (_group_ends(text, b) if kind == "card" else border[b] and text[b - 1] not in " ,;\n")}
        fits = [(_rank(kind, text[a:b], a), a, b) for a in starts for b in range(a + 6, min(len(text), a + 48) + 1) if b in ends and RULES[kind](text[a:b])]
        for _, a, b in sorted(fits):
            b = a + text[a:b].index("@") if kind == "email" else b  # the value is what names the person
            if all(b <= x or a >= y for x, y, _ in found):
                found.append((a, b, kind))
    return sorted(found)


def _value(rnd):
    digits = lambda n: "".join(rnd.choices(DIGITS, k=n))
    kind = rnd.randrange(9)
    if kind == 0:
        return rnd.choice(["ann", "b.c", "x_1", "9z"]) + "@" + rnd.choice(["a.org", "mail.b-c.com", "x.y", "q.de"])
    if kind == 1:
        return ".".join(rnd.choice(["0", "7", "255", "256", "01", "99"]) for _ in range(rnd.choice([4, 4, 4, 5])))
    if kind == 2:
        return rnd.choice(["2024-02-29", "2023-02-29", "31/12/1999", "12/31/1999", "13/13/1999", "01.02.2003", "32.01.2003", "1999-1-01"])
    if kind == 3:
        return f"{rnd.choice(['078', '000', '666', '912'])}-{rnd.choice(['05', '00'])}-{rnd.choice(['1120', '0000'])}"
    if kind == 4:
        return rnd.choice(["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "DE88370400440532013000", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"])
    if kind in (5, 6):
        number = rnd.choice(["4111111111111111", "378282246310005", "4111111111111112", "6011111111111117", "4222222222222"])
        cut = rnd.choice([None, 4, 5])
        return number if cut is None else rnd.choice(" -").join(number[k : k + cut] for k in range(0, len(number), cut))
    return digits(rnd.randint(1, 6)) if kind == 7 else rnd.choice(["word", "no.", "x", "A1"])


@pytest.mark.parametrize("seed", range(20))
def test_finder_against_every_substring(seed):
    rnd = random.Random(seed)
    for _ in range(250):
        text = "".join(_value(rnd) + rnd.choice([" ", ", ", "; ", "\n", " and "]) for _ in range(rnd.randint(1, 4)))[:90]
        got = [(a, b, KINDS[k]) for a, b, k in pii.find(text)]
        assert [g for g in got if g[2] in RULES] == [w for w in _brute(text) if all(w[1] <= a or w[0] >= b for a, b, k in got if k not in RULES)], text
