"""Personal data: base patterns, and a boosted classifier over the spans of looser generators.

Base spans (e-mail, ip, card, phone) follow fixed patterns and are always kept. High-recall generators then propose
more spans, overlapping and of doubtful kind: spaced or spelled-out addresses, numbers that look like local phones,
cards, identity numbers, bank accounts, long addresses of hosts. Boosted trees score each proposal from its format and the
words around it, a threshold for each kind (set for ``PRECISION`` on held-out proposals) selects, and of overlapping
winners the best score stays. Where a base span lies, proposals are dropped.

There are no labelled spans in the corpus, so the trees learn from proposals in sentences that are made from
templates (``TRAIN_ROWS`` of them, a fixed seed), true and misleading ones alike; held-out templates' words differ.

Defined results: a null text is empty and has no spans; offsets count code points; repeated rows are judged each;
other columns are ignored (``redact`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting
from .common import lean, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_id", "iban")
TRAIN_ROWS, PRECISION, SEED = 6000, 0.98, 20_240_601

#: Fixed patterns of the contract, but for lookbehinds and possessive marks that spare retries inside one run.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """Outward from each @: the local part is the whole run before it, so no start is tried twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in base_emails(text)] if "@" in text else []
    if not re.search(r"[0-9]", text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


#: High recall, low precision. Each proposes a kind; spans may overlap.
GENERATORS = [
    ("email", re.compile(r"[\w.%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|\s@\s?|@\s)\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]{2,63}){1,4}"), re.compile(r"[(\[{]at[)\]}]|@\s|\s@")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])"), re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")),
    ("phone", re.compile(r"(?<![0-9+])(?:\(0?[0-9]{2,4}\)|0?[0-9]{2,4})[ ./-][0-9]{3,4}[ ./-]?[0-9]{3,4}(?![0-9])"), None),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9])"), None),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])"), None),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), re.compile(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]")),
]
NUMBERS = re.compile(r"[0-9][0-9 ()./-]{7}")
FOR = re.compile(r"(?i)\b(tel|telephone|phone|call|mobile|fax|whatsapp|telefon|handy|teléfono|téléphone|mail|e-mail|email|contact|card|visa|mastercard|amex|credit|karte|tarjeta|carte|ssn|social|security|iban|konto|account|bank|ip|host|address|server|from)\b")
AGAINST = re.compile(r"(?i)\b(order|invoice|version|isbn|issn|doi|sku|part|serial|page|figure|table|section|id|ticket|ref|reference|build|score|year|date|revision|mac|hash)\b")


def candidates(text: str) -> list[tuple[str, int, int]]:
    numbers = NUMBERS.search(text) is not None
    out = []
    for kind, pattern, hint in GENERATORS:
        if (hint.search(text) if hint else numbers):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format first, context after."""
    s, before, after = text[a:b], text[max(0, a - 32) : a], text[b : b + 12]
    d = only_digits(s)
    groups = re.findall(r"[0-9]+", s)
    first = before[-1:] or " "
    return [
        float(KINDS.index(kind)), len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(set(d)),
        float(luhn(d)) if 12 < len(d) < 20 else -1.0, float(iban_ok(s)) if kind == "iban" else -1.0, float(d[:1] in "3456") if d else -1.0,
        sum(c.isalpha() for c in s), s.count(" "), s.count("-"), s.count("."), s.count("/"), float("(" in s or "[" in s), s.count(":"),
        float(d[:3] in {"000", "666"} or d[:1] == "9"), float(first.isspace()), float(first in "#$€£%=/_"), float(after[:1].isalnum() or after[:1] in "%_="),
        float(bool(FOR.search(before))), float(bool(AGAINST.search(before))), float(before.rstrip()[-1:] in ":="), float(bool(re.match(r"[.,;:!?)]?(\s|\Z)", after))),
    ]


def _iban(r: random.Random) -> str:
    body = "".join(r.choice("0123456789") for _ in range(18))
    check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
    s = f"DE{check:02}{body}"
    return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def _card(r: random.Random, good: bool) -> str:
    while True:
        d = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(r.choice((14, 15, 15, 15)) if good else r.randrange(12, 18)))
        if luhn(d) == good:
            break
    sep = r.choice(("", " ", "-", "."))
    return sep.join(d[i : i + 4] for i in range(0, len(d), 4))


def examples(n: int, seed: int, held: bool) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of proposals in made sentences; ``held`` draws filler words from another stock."""
    r = random.Random(seed)
    words = [x + y for x in ("ba", "lo", "mi", "ter", "son", "ka") for y in (("ra", "de", "nu") if held else ("li", "mo", "sta", "en"))]
    filler = lambda: " ".join(r.choice(words) for _ in range(r.randrange(2, 7)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    good = {
        "email": lambda: f"{r.choice(words)}{num(2)} {r.choice(('(at)', '[at]', '{at}'))} {r.choice(words)} {r.choice(('(dot)', '[dot]'))} {r.choice(('com', 'org', 'net', 'de'))}",
        "ip": lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8)),
        "phone": lambda: r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(4)}{num(3)}")),
        "card": lambda: _card(r, True),
        "national_id": lambda: f"{r.randrange(100, 665)}-{r.randrange(10, 99)}-{num(4)}",
        "iban": lambda: _iban(r),
    }
    bad = {
        "email": lambda: f"{r.choice(words)} @ {r.choice(words)}. {r.choice(words)}",
        "ip": lambda: ":".join(f"{r.randrange(60):02}" for _ in range(r.choice((4, 5, 6)))),
        "phone": lambda: r.choice((f"{r.randrange(1900, 2030)}-{num(4)}-{num(4)}", f"{num(2)}/{num(3)}/{num(4)}", f"{num(4)} {num(4)} {num(4)}", f"{num(3)} {num(4)}", f"{num(4)}.{num(4)}")),
        "card": lambda: _card(r, False),
        "national_id": lambda: r.choice((f"9{num(2)} {num(2)} {num(4)}", f"000-{num(2)}-{num(4)}", f"{num(3)} {num(2)} {num(4)}")),
        "iban": lambda: f"{r.choice(('XQ', 'AB', 'ZZ'))}{num(2)}" + "".join(r.choice("ABCDEF0123456789") for _ in range(16)),
    }
    lead = {"email": ("mail:", "contact", "e-mail"), "ip": ("ip", "host", "server:"), "phone": ("call", "tel:", "phone", "mobile:"), "card": ("card", "visa:", "credit card"), "national_id": ("ssn", "ssn:", "social security"), "iban": ("iban", "account:", "bank")}
    trap = ("order", "invoice", "version", "isbn", "serial", "ticket", "ref:", "part", "#", "id=", "$")
    out = []
    while len(out) < n:
        kind, right = r.choice(KINDS), r.random() < 0.5
        value = (good if right else bad)[kind]()
        cue = r.choice(lead[kind]) if r.random() < (0.7 if right else 0.15) else r.choice(trap) if not right and r.random() < 0.6 else ""
        glue = "" if cue[-1:] in {"#", "=", "$"} else " "
        text = f"{filler()} {cue}{glue if cue else ''}{value}{r.choice((' ', '. ', ', '))}{filler()}"
        # a number shape without a cue is nobody's in particular, unless its own check digits speak for it
        sure = right and (bool(cue) or kind in {"email", "ip", "iban", "card"} or (kind == "phone" and "(" in value) or (kind in {"phone", "national_id"} and "-" in value))
        at = text.index(value)
        found = [c for c in candidates(text) if c[1] < at + len(value) and c[2] > at]
        out += [(text, k, a, b, int(sure and k == kind)) for k, a, b in found]
    return out[:n]


@cache
def model(rows: int = TRAIN_ROWS, precision: float = PRECISION, seed: int = SEED) -> tuple[boosting.Trees, dict[str, float]]:
    """Trees and a threshold for each kind. Made once on the driver; both are a few kilobytes."""
    train, held = examples(rows, seed, False), examples(rows // 3, seed + 1, True)
    x = lambda e: np.array([features(t, k, a, b) for t, k, a, b, _ in e])
    y = lambda e: np.array([v for *_, v in e])
    trees = boosting.fit(x(train), y(train))
    score, label, kind = trees.score(x(held)), y(held), np.array([k for _, k, *_ in held])
    return trees, {k: max(0.5, boosting.threshold(score[kind == k], label[kind == k], precision)) for k in KINDS}


def added_spans(text: str, base: list[tuple[str, int, int]], trees: boosting.Trees, limits: dict[str, float]) -> list[tuple[str, int, int]]:
    """Winners among the proposals that touch no base span: the best score first, then the longest, the leftmost."""
    taken = sorted((a, b) for _, a, b in base)
    found = [c for c in candidates(text) if not any(a < c[2] and c[1] < b for a, b in taken)] if len(taken) < 64 else _free(candidates(text), taken)
    if not found:
        return []
    scores = trees.score(np.array([features(text, *c) for c in found]))
    ranked = sorted((-s, a - b, a, k, b) for s, (k, a, b) in zip(scores, found, strict=True) if s >= limits[k])
    out: list[tuple[str, int, int]] = []
    last: list[tuple[int, int]] = []
    for _, _, a, k, b in ranked:
        if not any(x < b and a < y for x, y in last):
            out.append((k, a, b))
            last.append((a, b))
    return out


def _free(found: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    import bisect

    top, ends = 0, []
    for _, b in taken:
        top = max(top, b)
        ends.append(top)
    out = []
    for c in found:
        i = bisect.bisect_left(taken, (c[2], 0))
        if i == 0 or ends[i - 1] <= c[1]:
            out.append(c)
    return out


def digest_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans. No row is shuffled."""
    trees, limits = model()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = base_spans(text) if text else []
                more = added_spans(text, base, trees, limits) if text else []
                rows.append((doc_id, *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(digest_text(base).encode()).hexdigest(), digest_text(base + more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def redact_text(text: str, trees: boosting.Trees, limits: dict[str, float]) -> str:
    """Each span becomes its kind in angle brackets; spans that overlap become one."""
    base = base_spans(text)
    spans = sorted((a, b, k) for k, a, b in base + added_spans(text, base, trees, limits))
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out += [text[done:a], f"<{k.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in one column; nulls stay null."""
    trees, limits = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            i = b.schema.get_field_index(column)
            new = pa.array([redact_text(t, trees, limits) if t else t for t in b.column(i).to_pylist()], b.schema.field(i).type)
            yield b.set_column(i, b.schema.field(i), new)

    return docs.mapInArrow(lean(run), docs.schema)
