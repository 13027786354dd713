"""PII: fixed patterns, and further spans that boosted trees pick among broad candidates.

Base spans (e-mail, IPv4, card, international phone) are always reported. Wide generators propose
what the base leaves out: spelled-out e-mails, IPv6 addresses, cards with other separators, phones
without a country code, national ids, bank accounts, street addresses, names after titles or
introductions, and secrets (assigned keys and passwords, tokens of known make, private key blocks,
long random words). They overlap; a boosted-tree model scores each from the format of the span
(lengths, character classes, entropy, checksums) and its context (words that go with the kind or
against it, what stands next to it), and of overlapping ones over the calibrated threshold the
likeliest is added.

The labels don't come from the base. A candidate is a positive where its format holds and the words
before it name its kind, a negative where its format fails (checksum, impossible parts, a word
instead of a random string) or the words before it name something else (order, version, commit);
others have no label. Further positives are base matches rewritten into forms the base doesn't
know, in their own context. So that small tables have both classes, `SEEDS` generated examples of
each kind and its look-alikes are added. Labelled rows also occur without their cue words, so that the format
counts too. The sample is bounded by `SAMPLE_DOCS` documents and `SAMPLE_ROWS` candidates, chosen
by hash; one half fits the trees, the other the calibration and the threshold, the least that keeps
`PRECISION`. All documents are scored.

A null or empty text has no spans. Offsets are code points, ends exclusive. Base spans of different
kinds may overlap, added spans overlap none. Very long texts are read whole, in time linear in
their length. Repeated rows get the same spans; an empty table gives an empty result.
"""

from __future__ import annotations

import ipaddress
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("address", "iban", "name", "national_id", "secret")
ORDER = {k: i for i, k in enumerate(KINDS + EXTRA)}
SAMPLE_DOCS = 20_000
SAMPLE_ROWS = 8_192
SEEDS = 60
PRECISION = 0.95
TREES, DEPTH, RATE = 60, 4, 0.2
NEAR = 40  # characters of context

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

NAME = r"[A-ZÀ-Þ][a-zß-ÿ'’-]{1,20}"
#: kind, what a text must hold one of ("0": a digit), pattern; a span is the pattern's first group if it has one.
CANDIDATES = [
    ("email", (" dot ", "[dot", "(dot", "{dot", " punto ", " punkt "), re.compile(r"(?<![\w.])([\w.+-]{1,40}(?: ?[\[({] ?(?:at|@) ?[\])}] ?| at | @ | arroba |@)[\w-]{1,30}(?:(?: ?[\[({] ?dot ?[\])}] ?| dot | punto | punkt )[A-Za-z]{2,10}){1,3})")),
    ("ip", ("::",), re.compile(r"(?<![\w:.])((?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:])(?!\.[0-9])")),
    ("ip", ("0",), re.compile(r"(?<![\w:.])((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![\w:])(?!\.[0-9])")),
    ("card", ("0",), re.compile(r"(?<![\w.-])([0-9]{4}([./_ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7})(?![\w-])")),
    ("card", ("0",), re.compile(r"(?<![\w.-])([0-9]{13,19})(?![\w-])")),
    ("phone", ("0",), re.compile(r"(?<![\w+.-])(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![\w-])")),
    ("phone", ("0",), re.compile(r"(?<![\w+.-])(\(?0[0-9]{1,4}\)?[ /-][0-9]{2,8}(?:[ -][0-9]{2,6}){0,4})(?![\w-])")),
    ("phone", ("0",), re.compile(r"(?<![\w+.-])([679][0-9]{2} [0-9]{3} [0-9]{3})(?![\w-])")),
    ("national_id", ("0",), re.compile(r"(?<![\w-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])")),
    ("national_id", ("0",), re.compile(r"(?<![\w-])([A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D])(?![\w-])")),
    ("national_id", ("0",), re.compile(r"(?<![\w-])([0-9]{8}-?[A-Z])(?![\w-])")),
    ("iban", ("0",), re.compile(r"(?<![\w-])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\w-])")),
    ("address", (" Street", " St", " Avenue", " Ave", " Road", " Rd", " Boulevard", " Blvd", " Lane", " Drive", " Court", " Square"), re.compile(rf"(?<![\w-])([0-9]{{1,5}}[a-z]? (?:{NAME} ){{1,4}}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Drive|Court|Square)\b)")),
    ("address", ("straße ", "strasse ", "weg ", "platz ", "allee ", "gasse "), re.compile(r"(?<!\w)([A-ZÄÖÜ][a-zäöüß-]{1,30}(?:straße|strasse|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?)(?!\w)")),
    ("address", ("Calle ", "Avenida ", "Plaza ", "Paseo "), re.compile(rf"(?<!\w)((?:Calle|Avenida|Plaza|Paseo) (?:de (?:la )?)?{NAME}(?: {NAME}){{0,3}},? [0-9]{{1,4}})(?!\w)")),
    ("address", (" rue ", " avenue ", " boulevard "), re.compile(rf"(?<!\w)([0-9]{{1,4}},? (?:rue|avenue|boulevard) (?:d[eu] (?:la )?)?{NAME}(?: {NAME}){{0,3}})(?!\w)")),
    ("name", ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Mme"), re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Mme)\.? ({NAME}(?: {NAME}){{0,2}})")),
    ("name", ("name is ", "am called ", "ame: ", "heiße ", "llamo ", "appelle ", "igned by ", "egards, "), re.compile(rf"(?:name is|am called|[Nn]ame:|heiße|llamo|appelle|[Ss]igned by|[Rr]egards,) ({NAME}(?: {NAME}){{1,2}})")),
    ("secret", ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk_live_", "sk_test_", "xoxb-", "xoxp-", "AIza", "eyJ"), re.compile(r"(?<!\w)((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pos]_[A-Za-z0-9]{20,255}|sk_(?:live|test)_[A-Za-z0-9]{10,99}|xox[bp]-[A-Za-z0-9-]{10,99}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?!\w)")),
    ("secret", ("token", "secret", "passw", "pwd", "key", "redential", "Token", "Secret", "Passw", "Key", "TOKEN", "SECRET", "PASSW", "PWD", "KEY"), re.compile(r"(?:token|secret|passw(?:or)?d|pwd|key|credential)s?[\"']?\s{0,3}(?:=>|[:=]|\bis\b)\s{0,3}[\"']?([^\s\"',;]{5,199}[^\s\"',;.:!?)\]}>])", re.I)),
    ("secret", ("0",), re.compile(r"(?<![\w/+=-])([A-Za-z0-9_+/-]{24,200}={0,2})(?![\w/+=-])")),
]
#: kind: words that go with it, words that go against it, in lower case, looked for before a span.
CUES = {
    "email": (r"mail|contact|write|reach|correo|escrib", r"look|meet|arriv|stay"),
    "ip": (r"ip|address|host|server|node|peer|client|login|from", r"version|release|section|chapter|time|mac|c\+\+"),
    "card": (r"card|visa|master|amex|credit|debit|pay|tarjeta|karte|carte", r"order|invoice|isbn|ean|serial|tracking|item|sku|batch|imei|ticket|id"),
    "phone": (r"call|phone|tel|fax|mobile|cell|ring|dial|whatsapp|tel[eé]fono|llama|handy|telefon|number is", r"order|invoice|isbn|version|item|sku|page|lot|serial|score|part|price|ref|code|dates?|code|room|bus|total"),
    "national_id": (r"ssn|social security|national|insurance|passport|dni|nif|tax|identity|\bni\b", r"order|invoice|isbn|item|sku|serial|part|ref|code|model|flight|lot"),
    "iban": (r"iban|account|bank|transfer|konto|cuenta|compte", r"serial|order|model|licen[cs]e key|product|part|code"),
    "address": (r"address|live|lives|living|home|house|ship|deliver|resid|wohn|vive|habite|mail to|visit|at", r"chapter|section|figure|table"),
    "name": (r"name|called|signed|regards|patient|customer|dear|sincerely|mr|mrs|ms|dr|prof|herr|frau|señora?|mme|heiße|llamo|appelle", r"chapter|street|brand|model|product|company|movie"),
    "secret": (r"token|secret|passw(?:or)?d|pwd|api.?key|access.?key|auth|private|credential|bearer|key", r"commit|sha-?[0-9]*|md5|hash|checksum|digest|uuid|etag|revision|build|version|color|url|path|file|public.?key|primary.?key|foreign.?key|keyboard"),
}
CUES = {k: tuple(re.compile(rf"(?<![a-zà-ÿ])(?:{x})s?(?![a-zà-ÿ])") for x in v) for k, v in CUES.items()}
PLAIN = re.compile(r"[A-Za-z][a-z]*(?:[-_ ]?[A-Za-z][a-z]*)*[.!?)]*|[xX*.#_-]+|[<{$\[(%].*")
PREFIXED = re.compile(r"AKIA|ASIA|gh[pos]_|sk_(?:live|test)_|xox[bp]-|AIza|eyJ|-----BEGIN")
BEGIN, END = "-----BEGIN ", "PRIVATE KEY-----"


def digits(s: str) -> str:
    return "".join(filter(lambda c: "0" <= c <= "9", s))


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches in linear time: a local part ends at its @ and begins after the last match at the earliest."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        begin = done + len(head.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if begin < at else None
        done = at + 1
        if found:
            out.append((begin, found.end()))
            done = found.end()
        at = text.find("@", done)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if not DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def keys(text: str) -> Iterator[tuple[int, int]]:
    """Private key blocks, from BEGIN to the next END."""
    at = text.find(BEGIN)
    while at >= 0:
        head = text.find(END, at, at + 60)
        end = text.find(END, head + len(END)) if head >= 0 else -1
        if head >= 0 and end < 0:
            return
        if head >= 0:
            yield at, end + len(END)
        at = text.find(BEGIN, max(at + 1, end))


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    numeric = DIGIT.search(text) is not None
    for kind, held, pattern in CANDIDATES:
        if numeric if held == ("0",) else any(w in text for w in held):
            for m in pattern.finditer(text):
                yield kind, *m.span(1)
    for a, b in keys(text):
        yield "secret", a, b


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def holds(kind: str, span: str) -> float:
    """1 if the span's format holds by what can be computed, 0 if it fails, 0.5 if there is nothing to compute."""
    d = digits(span)
    if kind == "card":
        return float(13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1)
    if kind == "phone":
        return float(7 <= len(d) <= 15 and len(set(d)) > 2)
    if kind == "ip":
        try:
            return float(ipaddress.ip_address(span).version == 6 and len(span) > 6)
        except ValueError:
            return 0.0
    if kind == "iban":
        s = span.replace(" ", "")
        return float(15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1)
    if kind == "national_id":
        if span[:1].isdigit() and span[-1:].isdigit():
            return float(span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000")
        return 0.5 if span[:1].isalpha() else float("TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23] == span[-1])
    if kind == "email":
        return float(span.rsplit(" ", 1)[-1].lower() in ("com", "org", "net", "edu", "gov", "io", "de", "es", "fr", "uk", "info", "eu", "it", "ch", "at", "us") or span[-1:] in "])}")
    if kind == "secret":
        if PREFIXED.match(span):
            return 1.0
        mixed = sum(any(map(f, span)) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in span)
        return 0.0 if PLAIN.fullmatch(span) or len(set(span)) < 5 else float(mixed > 1 and any(map(str.isdigit, span)) or mixed > 2) or 0.5
    return 0.5


def said(kind: str, text: str, a: int) -> tuple[bool, bool]:
    """Whether the words before a span go with its kind, and against it."""
    left = text[max(0, a - NEAR) : a].lower()
    return tuple(p.search(left) is not None for p in CUES[kind])


def label(kind: str, text: str, a: int, b: int) -> bool | None:
    """What format and words before a candidate say together; None if they don't."""
    right, (for_, against) = holds(kind, text[a:b]), said(kind, text, a)
    if right == 0 or against and not for_:
        return False
    return True if for_ and not against else None


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format of the span and its surroundings; the cue words come last."""
    span, left, right = text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]
    n, d, near = len(span), len(digits(span)), left + right
    for_, against = said(kind, text, a)
    return [
        *(float(kind == k) for k in KINDS + EXTRA), holds(kind, span), float(n), d / n, float(d), float(sum(c in " -./()" for c in span)), float(len(set(span))), entropy(span[:200]), sum(map(str.isupper, span)) / n, sum(map(str.islower, span)) / n,
        float(max(map(len, re.findall(r"[0-9]+", span[:200])), default=0)), float(span.count(" ")), float(left[-1:].isspace() or not left), float(right[:1].isspace() or not right), float(right[:1] in tuple(".,;:)") and right != ""), float(left[-1:] in tuple("\"'`") and left != ""),
        float(left.rstrip(" \"'")[-1:] in tuple(":=") and left.rstrip(" \"'") != ""), float(left.rstrip()[-1:] in tuple("#$€£") and left.rstrip() != ""), sum(map(str.isdigit, near)) / (len(near) + 1), sum(not c.isalnum() and not c.isspace() for c in near) / (len(near) + 1), float("\n" in near), float(for_), float(against),
    ]


def rewritten(text: str, kind: str, a: int, b: int, lot: random.Random) -> tuple[str, str, int, int] | None:
    """A base match in a form the base doesn't know, in its own context: text, kind, start, end."""
    span = text[a:b]
    if kind == "email":
        new = span.replace("@", lot.choice((" at ", " [at] ", "(at)"))).replace(".", lot.choice((" dot ", " [dot] ")))
    elif kind == "card":
        d = digits(span)
        new = lot.choice(". /_").join(d[i : i + 4] for i in range(0, 16, 4)) if len(d) == 16 else None
    elif kind == "phone":
        d = digits(span)[-10:]
        new = lot.choice((f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"0{d[1:3]} {d[3:]}"))
    else:
        new = None
    if new is None:
        return None
    left, right = text[max(0, a - NEAR) : a], text[b : b + NEAR]
    return left + new + right, kind, len(left), len(left) + len(new)


def seeds(n: int = SEEDS) -> Iterator[tuple[str, str, int, int, bool]]:
    """Generated examples (text, kind, start, end, label): n of each kind with and without cue words, n look-alikes."""
    lot = random.Random(11)
    num = lambda k: "".join(lot.choice("0123456789") for _ in range(k))
    pick = lambda chars, k: "".join(lot.choice(chars) for _ in range(k))
    low = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: pick(low, lot.randint(3, 9))
    cap = lambda: word().capitalize()
    some = low + low.upper() + "0123456789"

    def card(good: bool) -> str:
        while True:
            d = lot.choice("3456") + num(15)
            if luhn(d) == good:
                return d

    def iban() -> str:
        s = lot.choice(("DE", "GB", "ES", "FR")) + "00" + num(18)
        return f"{s[:2]}{98 - int(''.join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97:02d}{s[4:]}"

    random_ = lambda: pick(lot.choice(("0123456789abcdef", some, some + "-_")), lot.choice((24, 32, 40, 48)))
    password = lambda: pick(low, 4) + pick(low.upper(), 2) + num(3) + lot.choice("!$%-_") + pick(some, 3)
    right = {
        "email": (lambda: f"{word()} at {word()} dot {lot.choice(('com', 'org', 'net', 'de', 'es'))}", lambda: f"{word()}.{word()} [at] {word()} [dot] {lot.choice(('com', 'org', 'io'))}"),
        "ip": (lambda: ":".join(f"{lot.randint(0, 65535):x}" for _ in range(8)), lambda: f"2001:{lot.randint(1, 65535):x}::{lot.randint(1, 65535):x}"),
        "card": (lambda: ".".join((d := card(True))[i : i + 4] for i in (0, 4, 8, 12)), lambda: "/".join((d := card(True))[i : i + 4] for i in (0, 4, 8, 12))),
        "phone": (lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"0{num(2)} {num(7)}", lambda: f"0{lot.choice('12345679')} {num(2)} {num(2)} {num(2)} {num(2)}", lambda: f"{lot.choice('679')}{num(2)} {num(3)} {num(3)}"),
        "national_id": (lambda: f"{lot.randint(100, 665)}-{lot.randint(10, 99)}-{lot.randint(1000, 9999)}", lambda: f"{pick('ABCEGHJKLMNPRSTWXYZ', 2)}{num(6)}{lot.choice('ABCD')}", lambda: (d := num(8)) + "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23]),
        "iban": (iban, lambda: " ".join((s := iban())[i : i + 4] for i in range(0, 22, 4))),
        "address": (lambda: f"{lot.randint(1, 999)} {cap()} {lot.choice(('Street', 'Avenue', 'Road', 'Lane'))}", lambda: f"{cap()}straße {lot.randint(1, 99)}", lambda: f"Calle {cap()} {lot.randint(1, 99)}", lambda: f"{lot.randint(1, 99)} rue {cap()}"),
        "name": (lambda: f"{cap()} {cap()}", lambda: f"{cap()} {cap()} {cap()}"),
        "secret": (random_, random_, password, lambda: "ghp_" + pick(some, 36), lambda: "AKIA" + pick(low.upper() + "0123456789", 16)),
    }
    with_ = {
        "email": ("mail me: ", "contact ", "write to "), "ip": ("host ", "server address ", "from ip "), "card": ("card number ", "visa ", "pay with "), "phone": ("call ", "tel. ", "my phone is ", "fax: ", "mobile "), "national_id": ("ssn ", "social security ", "dni ", "passport "),
        "iban": ("iban ", "bank account "), "address": ("address: ", "lives at ", "ship to "), "name": ("Mr. ", "my name is ", "signed by ", "Dr. "), "secret": ('token = "', "password: ", "api_key=", "secret: ", "Bearer ", "access key "),
    }
    wrong = {
        "email": lambda: f"{lot.choice(('meet', 'look', 'stay'))} {lot.choice(('us', 'her', 'it'))} at {word()} dot {pick(low, 6)}",
        "ip": lambda: f"at {lot.randint(10, 23)}::{lot.randint(10, 59)}", "card": lambda: f"{lot.choice(('order', 'tracking', 'serial', 'item', ''))} {card(False)}",
        "phone": lambda: lot.choice((f"order {num(3)}-{num(3)}-{num(4)}", f"isbn {num(3)} {num(3)} {num(4)}", f"ref 0{num(3)}-{num(5)}", f"page 0{num(2)} {num(4)}", f"total {lot.choice('679')}{num(2)} {num(3)} {num(3)}", f"part {num(3)}.{num(3)}.{num(4)}")),
        "national_id": lambda: lot.choice((f"part {num(3)}-{num(2)}-{num(4)}", f"item 9{num(2)}-{num(2)}-{num(4)}", f"order {num(8)}Q", f"model {pick('ABC', 2)}{num(6)}D")),
        "iban": lambda: f"{lot.choice(('serial', 'order', 'product', ''))} {pick('ABCDEFGH', 2)}{num(14)}", "address": lambda: f"{lot.choice(('table', 'figure', 'chapter', 'section'))} {lot.randint(1, 99)} {cap()} Court", "name": lambda: f"{lot.choice(('product', 'model', 'brand'))} Dr. {cap()} {cap()}",
        "secret": lambda: lot.choice((f"commit {pick('0123456789abcdef', 40)}", f"sha256: {pick('0123456789abcdef', 64)}", f"checksum {pick('0123456789abcdef', 32)}", f"uuid {pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-4{pick('0123456789abcdef', 3)}-{pick('0123456789abcdef', 16)}", f"password: {word()}", f"the key is {word()}", f"token = {word()}_{word()}", f"url {word()}/{word()}/{word()}-{word()}-{num(4)}/{word()}")),
    }
    for kind, forms in right.items():
        for i in range(n):
            span = forms[i % len(forms)]()
            before = f"{word()} {word()} {lot.choice(with_[kind])}"
            yield f"{before}{span} {word()} {word()}", kind, len(before), len(before) + len(span), True
        for _ in range(n):
            text = f"{word()} {word()} {wrong[kind]()} {word()} {word()}"
            for k, a, b in candidates(text):
                if k == kind:
                    yield text, k, a, b, False


def rows_of(text: str, kind: str, a: int, b: int, right: bool) -> list[tuple[list[float], bool]]:
    """A labelled row, and the same without its cue words if its format is more than possible."""
    x = features(text, kind, a, b)
    bare = x[:-2] + [0.0, 0.0]
    return [(x, right), (bare, right)] if x != bare and holds(kind, text[a:b]) != 0.5 and kind != "phone" else [(x, right)]


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of the candidates that have one, and of rewritten base matches."""
    for batch in batches:
        rows, right, tags = [], [], []
        for tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text, lot, found = text or "", random.Random(tag), []
            base = base_spans(text)
            for kind, a, b in candidates(text):
                if not any(x < b and a < y for v in base.values() for x, y in v) and (y := label(kind, text, a, b)) is not None:
                    found += rows_of(text, kind, a, b, y)
            for kind, spans in base.items():
                for a, b in spans:
                    if new := rewritten(text, kind, a, b, lot):
                        found += rows_of(*new, True)
            for i, (x, y) in enumerate(found):
                rows.append(x)
                right.append(y)
                tags.append(tag ^ i)
        yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(rows, pa.list_(pa.float64())), pa.array(right, pa.bool_())], names=["tag", "x", "y"])


class Trees:
    """Gradient boosting for the logistic loss on binned features, depth-limited."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1])) for c in x.T]
        z = self.binned(x)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.start)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-f))
            tree = self.grow(z, y - q, q * (1 - q), np.arange(len(y)), depth)
            self.trees.append(tree)
            f += rate * self.walk(tree, z)
        self.rate = rate

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)

    def grow(self, z, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) > 8:
            for j in range(z.shape[1]):
                n = len(self.edges[j]) + 1
                cg = np.cumsum(np.bincount(z[rows, j], g[rows], n))[:-1]
                ch = np.cumsum(np.bincount(z[rows, j], h[rows], n))[:-1]
                if len(cg):
                    gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
        if best[1] is None:
            return float(total_g / (total_h + 1))
        _, j, k = best
        low = z[rows, j] <= k
        return j, k, self.grow(z, g, h, rows[low], depth - 1), self.grow(z, g, h, rows[~low], depth - 1)

    def walk(self, tree, z) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(z), tree)
        j, k, low, high = tree
        return np.where(z[:, j] <= k, self.walk(low, z), self.walk(high, z))

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = self.binned(x)
        return self.start + self.rate * sum(self.walk(t, z) for t in self.trees)


class Selector:
    """Trees, a logistic calibration on held-out rows, and the least threshold that keeps the precision there."""

    def __init__(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION):
        half = np.arange(len(y)) % 2 == 0
        self.trees = Trees(x[half], y[half].astype(float))
        m, t = self.trees.margin(x[~half]), y[~half].astype(float)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton with a small ridge
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-6
            g = np.array([((t - p) * m).sum() - 1e-2 * (a - 1), (t - p).sum() - 1e-2 * b])
            hess = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-2]])
            a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, g), -1, 1)
        self.a, self.b = float(a), float(b)
        p = np.sort(self.chance(x[~half]))[::-1]
        right = np.cumsum(t[np.argsort(-self.chance(x[~half]), kind="stable")]) / np.arange(1, len(t) + 1)
        good = np.flatnonzero(right >= precision)
        self.threshold = max(0.5, float(p[good[-1]])) if len(good) else 2.0

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.trees.margin(x) + self.b)))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS) -> Selector:
    """The model from the seeds and at most sample_rows candidates of about sample_docs documents."""
    tag = F.xxhash64("doc_id", "text", F.lit(11))
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.select(tag.alias("tag"), "text").filter(F.pmod("tag", F.lit(1 << 24)) < int(share * (1 << 24)))
    rows = some.mapInArrow(labelled, "tag long, x array<double>, y boolean").orderBy(F.xxhash64("tag", "x")).limit(sample_rows).collect()
    given = [(r.x, r.y) for r in rows] + [x for s in seeds() for x in rows_of(*s)]
    random.Random(5).shuffle(given)
    return Selector(np.array([x for x, _ in given]), np.array([y for _, y in given], bool))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], model: Selector) -> list[tuple[str, int, int]]:
    """The likeliest (of equally likely ones the longest) of overlapping candidates over the threshold that touch no base span."""
    taken = sorted(x for v in base.values() for x in v)
    starts, ends = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken]) if taken else np.empty(0)
    free = lambda a, b: not taken or (k := int(np.searchsorted(starts, b))) == 0 or ends[k - 1] <= a
    new = [c for c in dict.fromkeys(candidates(text)) if free(c[1], c[2])]
    if not new:
        return []
    p = model.chance(np.array([features(text, *c) for c in new]))
    covered, out = bytearray(len(text)), []
    for _, _, (kind, a, b) in sorted((-round(q, 2), c[1] - c[2], c) for q, c in zip(p.tolist(), new) if q >= model.threshold):
        if not any(covered[a:b]):
            covered[a:b] = b"\x01" * (b - a)
            out.append((kind, a, b))
    return out


def spans_of(model: Selector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                found = [(k, a, b, True) for k in KINDS for a, b in base[k]] + [(*c, False) for c in added_spans(text or "", base, model)]
                found.sort(key=lambda s: (ORDER[s[0]], s[1], s[2]))
                rows.append([{"kind": k, "start": a, "end": b, "base": c} for k, a, b, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(SPAN))], names=["doc_id", "spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base), by kind and place: a row for each row of docs."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(spans_of(fit(docs)), "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    said_ = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(said_(base), 256).alias("base_sha256"), said_(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
