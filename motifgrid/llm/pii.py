r"""Operator 2: personal data by candidate generators and gradient-boosted trees.

Base spans (fixed patterns and checks) always count. Generators with high recall propose more,
overlapping spans: spelled-out addresses, IPv6 (also with a double colon), national and 00-prefixed phone
numbers, cards in other groupings; numbers next to each other are proposed in every grouping. Boosted trees score a candidate by its format and its context; a span is added if its
calibrated probability reaches its kind's threshold and it overlaps no base span and no better
candidate. The trees are trained on the driver, from a seeded generator of formats and contexts (TRAINING
candidates, half of them to calibrate and set thresholds), so training reads no documents.

Every scan is linear in the text: patterns that start with a run of characters are tried once a run.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; equal
rows get equal results; other columns are left out in `spans`, and stay as they are in `redacted`.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Trees
from .common import batch_of, pieces, texts

KINDS = ("email", "ip", "card", "phone")
TRAINING, PRECISION, SEED = 4000, 0.98, 11
#: Base patterns, each in a form that starts a run once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; only the characters around each @ are looked at."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {"email": emails(text) if "@" in text else []}
    small = lambda x: len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() > 15 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15] if "+" in text else []
    return out


_SPELLED_AT = re.compile(r"(?i)(?:\x20?[(\[{]at[)\]}]\x20?|\x20at\x20|\x20@\x20?|@\x20)([a-z0-9-]+(?:(?:\x20?\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)[a-z0-9-]+)+)")
#: A spelled-out dot that ends here, and its greatest length.
_SPELLED_DOT, DOT_CHARS = re.compile(r"(?i)(?:\x20dot\x20|\x20?[(\[{]dot[)\]}]\x20?)\Z"), 7
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")
#: Forms with a double colon start at a run of hexadecimal digits and colons.
_SHORT_IP6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:])")
_RUN = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)[\x20. /-]?)?[0-9]+(?:[\x20. /-][0-9]+)*(?![0-9A-Za-z])")
_GROUP = re.compile(r"\([0-9]+\)|[0-9]+")
#: More digits than this are neither a card nor a phone.
DIGITS = 19
#: Candidates scored at a time.
SCORED = 4096
_WORD = re.compile(r"[^\W\d_]+")
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
_DATE = re.compile(rf"(?<![0-9])(?:{_YEAR}([-/.]){_MONTH}\1{_DAY}|{_DAY}([-/.]){_MONTH}\2{_YEAR})(?![0-9])")
#: Context words of each kind.
HINTS = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "write"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "telefon", "mobile", "fax", "fon", "móvil"),
}
_AGAINST = ("order", "version", "page", "id", "invoice", "isbn", "ref", "no", "build", "serial", "section")


def short_ip6(s: str) -> bool:
    """Whether s is an IPv6 address with one double colon."""
    halves = s.split("::")
    groups = [g for h in halves if h for g in h.split(":")]
    return len(halves) == 2 and 1 <= len(groups) <= 7 and all(1 <= len(g) <= 4 for g in groups)


def number_runs(text: str) -> list[tuple[int, int, int]]:
    """Start, end and digits of the parts of digit runs that begin and end at separators, with at most DIGITS digits.

    A part has DIGITS groups at most, so the scan is linear.
    """
    out = []
    for m in _RUN.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end(), len(digits(g[0]))) for g in _GROUP.finditer(m[0])]
        for i, (start, _, _) in enumerate(groups):
            n = 0
            for _, end, more in groups[i : i + DIGITS]:
                n += more
                if n > DIGITS:
                    break
                if n >= 7:
                    out.append((start, end, n))
    return out


def spelled_local(text: str, end: int, least: int) -> int:
    """Start of the name before a spelled-out at sign at `end`, not before `least`; `end` if there is none. Parts of the name may be joined by spelled-out dots."""
    start, at = end, end
    while True:
        first = at
        while first > least and text[first - 1] in _LOCAL:
            first -= 1
        if first == at:
            return start
        start = first
        dot = _SPELLED_DOT.search(text[max(least, start - DOT_CHARS) : start])
        if not dot:
            return start
        at = start - len(dot[0])


def overlaps(held: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether start:end meets one of the sorted spans, which don't overlap each other."""
    i = bisect.bisect_left(held, (end, end))
    return i > 0 and held[i - 1][1] > start


def candidates(text: str, known: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Overlapping proposals outside the known spans."""
    out, free = [], 0
    for m in _SPELLED_AT.finditer(text):
        if (first := spelled_local(text, m.start(), free)) < m.start():
            out.append(("email", first, m.end()))
        free = m.end()
    if ":" in text:
        out += [("ip", *m.span()) for m in _IP6.finditer(text) if "::" not in m[0]]
        if "::" in text:
            out += [("ip", *m.span()) for m in _SHORT_IP6.finditer(text) if short_ip6(m[0])]
    for start, end, n in number_runs(text):
        if n <= 15:
            out.append(("phone", start, end))
        if n >= 13:
            out.append(("card", start, end))
    apart: list[tuple[int, int]] = []
    for a, b in sorted(known):
        if apart and a <= apart[-1][1]:
            apart[-1] = (apart[-1][0], max(b, apart[-1][1]))
        else:
            apart.append((a, b))
    return [x for x in out if not overlaps(apart, *x[1:])]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, d = text[start:end], digits(text[start:end])
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 40].lower()
    near = set(_WORD.findall(before)[-4:]) | set(_WORD.findall(after)[:2])
    groups = [len(x) for x in re.split(r"\D+", s) if x]
    seps = {c for c in s if not c.isalnum()}
    return [
        *[float(kind == k) for k in KINDS], len(s), len(d), len(groups), max(groups, default=0), groups[-1] if groups else 0, groups[0] if groups else 0,
        float(bool(d) and luhn(d)), len(seps), float("." in seps), float("-" in seps), float(" " in seps), float("(" in seps or "[" in seps), float(d[:2] == "00"),
        float(d[:1] == "0"), float(bool(near & set(HINTS[kind]))), float(bool(near & set(_AGAINST))), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        sum(c.isdigit() for c in before + after), float(" dot " in s.lower()), float("." in s.rpartition("at")[2]), s.count(":"), float(before[-1:] in "#$€£=%"), float(after[:1] in "%$€£:="),
        float(" at " in s.lower()), float("@" in s), float(bool(_DATE.search(s))),
    ]


def _example(r: random.Random) -> tuple[str, str, int, int, float]:
    """A text with one candidate and its label."""
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(2, 8)))
    yes, kind = r.random() < 0.5, r.choice(KINDS)
    year, month, day = f"{r.randint(1950, 2049)}", f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}"
    date = r.choice((f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{year}/{month}/{day}", f"{day}/{month}/{year}"))
    dated = r.choice((date, f"{date} {r.randint(0, 23):02}", f"{r.randint(1, 31)} {date}", f"{date} {r.randint(0, 23):02} {r.randint(0, 59):02}", f"{year}-{month}-{day} {year}-{month}-{day}"))
    if kind == "email":
        at, dot = r.choice(((" @ ", "."), ("@ ", "."), (" (at) ", "."), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", " (dot) "), (" [at] ", ".")))
        s = f"{word()}{r.choice(('.', '_', dot))}{r.choice((word(), num(2), word() + num(3)))}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de'))}" if yes else f"{r.choice((word(), num(3), f'{num(4)}-{num(2)}-{num(2)}', f'{word()}.{word()}'))} at {word()}.{word()}"
    elif kind == "ip":
        part = lambda n: ":".join(f"{r.randrange(r.choice((10, 4096, 65536))):x}" for _ in range(n))
        short = r.random() < 0.5
        s = (f"{r.choice(('fe80', '2001:db8', part(r.randint(1, 3)), ''))}::{part(r.randint(1, 3))}" if short else part(8)) if yes else r.choice(("a::b", "c::d", "::a", f"{r.randint(1, 99)}::{r.randint(1, 99)}")) if short else f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}:{r.randint(10, 99)}"
    elif kind == "card":
        d = num(r.choice((13, 14, 15, 15, 16))) if not yes else num(14)
        d = next(d + c for c in "0123456789" if luhn(d + c)) if yes else d
        s = f"{d[:4]}{(x := r.choice(('.', ' ', '-', '/')))}{d[4:10]}{x}{d[10:]}" if r.random() < 0.6 else d
    else:
        x = r.choice((" ", "-", "."))
        s = r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{x}{num(3)}{x}{num(4)}", f"00{r.randint(1, 99)} {num(3)} {num(7)}", f"0{num(3)}/{num(7)}")) if yes else r.choice((num(r.randint(7, 15)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(2)}.{num(4)}", f"{num(5)} {num(4)} {num(6)}", f"{num(1)} {num(3)} {num(3)}", dated, dated))
    hint = r.choice(HINTS[kind]) if r.random() < (0.5 if yes else 0.1) else r.choice(_AGAINST) if r.random() < (0.03 if yes else 0.5) else word()
    before = " ".join([word() for _ in range(r.randint(0, 5))] + [hint]) + r.choice((" ", ": ", " "))
    return before + s + r.choice((" ", ". ", ", ", "")) + word(), kind, len(before), len(before) + len(s), float(yes)


def trained() -> tuple[Trees, dict[str, float]]:
    """Trees and the threshold of each kind, from TRAINING seeded candidates."""
    r = random.Random(SEED)
    made = [_example(r) for _ in range(TRAINING)]
    x, y = np.array([features(*m[:4]) for m in made]), np.array([m[4] for m in made])
    half = TRAINING // 2
    trees = Trees().fit(x[:half], y[:half]).calibrate(x[half:], y[half:])
    p, held, thresholds = trees.probability(x[half:]), y[half:], {}
    for i, k in enumerate(KINDS):
        of = x[half:, i] == 1
        order = np.argsort(-p[of])
        precision = np.cumsum(held[of][order]) / np.arange(1, of.sum() + 1)
        good = np.flatnonzero(precision >= PRECISION)
        thresholds[k] = max(0.5, float(p[of][order][good[-1]])) if len(good) else 1.1
    return trees, thresholds


def found_spans(text: str, model: tuple[Trees, dict[str, float]]) -> tuple[dict[str, list], list[tuple[str, int, int]]]:
    """Base spans by kind, and the spans that the trees add."""
    known = base(text)
    proposed = candidates(text, sorted(x for v in known.values() for x in v))
    if not proposed:
        return known, []
    trees, thresholds = model
    p = np.concatenate([trees.probability(np.array([features(text, *x) for x in proposed[i : i + SCORED]])) for i in range(0, len(proposed), SCORED)])
    added: list[tuple[str, int, int]] = []
    taken = -1
    good = [(float(v), x) for v, x in zip(p, proposed, strict=True) if v >= thresholds[x[0]]]
    groups: list[list[tuple[float, tuple[str, int, int]]]] = []
    for v in sorted(good, key=lambda v: (v[1][1], v[1][2])):  # spans that overlap are next to each other
        if v[1][1] < taken:
            groups[-1].append(v)
        else:
            groups.append([v])
        taken = max(taken, v[1][2])
    for group in groups:
        held: list[tuple[int, int]] = []
        for _, x in sorted(group, key=lambda v: (-v[0], KINDS.index(v[1][0]), v[1][1])):
            if not overlaps(held, *x[1:]):
                bisect.insort(held, x[1:])
                added.append(x)
    return known, added


def _joined(known: dict[str, list]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(known[k]))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256, all spans, and n_added."""
    held = docs.sparkSession.sparkContext.broadcast(trained())  # trees of a fixed size
    names = [f"n_{k}" for k in KINDS]
    schema = pa.schema([("doc_id", pa.int64()), *[(k, pa.int64()) for k in names], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches):
        for batch in pieces(batches, "text"):
            rows = []
            for text in texts(batch.column("text")):
                known, added = found_spans(text, held.value)
                whole = {k: [*known[k], *(x[1:] for x in added if x[0] == k)] for k in KINDS}
                rows.append((*[len(known[k]) for k in KINDS], hashlib.sha256(_joined(known).encode()).hexdigest(), _joined(whole), len(added)))
            yield batch_of(schema, doc_id=batch.column("doc_id"), **dict(zip(schema.names[1:], map(list, zip(*rows, strict=True)), strict=True)))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of `text` replaced by its kind in brackets."""
    held = docs.sparkSession.sparkContext.broadcast(trained())
    spec = ", ".join(f"`{k}` {t}" for k, t in docs.dtypes)

    def hidden(s: str | None) -> str | None:
        if not s:
            return s
        known, added = found_spans(s, held.value)
        out, at = [], 0
        for a, b, k in sorted([(a, b, k) for k in KINDS for a, b in known[k]] + [(a, b, k) for k, a, b in added]):
            if a >= at:
                out += [s[at:a], f"[{k.upper()}]"]
            elif b <= at:
                continue  # inside a span that is hidden already
            at = max(at, b)
        return "".join([*out, s[at:]])

    def run(batches):
        for batch in pieces(batches, text):
            new = pa.array([hidden(x) for x in batch.column(text).to_pylist()], batch.schema.field(text).type)
            yield batch.set_column(batch.schema.get_field_index(text), text, new)

    return docs.mapInArrow(run, spec)
