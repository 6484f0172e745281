"""Personal data and secrets: generated candidates, scored by boosted trees.

High-recall patterns propose spans that may overlap; trees over features of a span's format and of its surroundings
give each a calibrated probability; per kind, a threshold that was chosen on held-out examples selects what to redact.
The trees are fitted here, on generated text.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm import trees
from pipewright.llm._shared import map_arrow, slices

_SLICE = 1 << 20
KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "secret")
#: What proposes spans of each kind: wide nets, precision is the trees' part.  Group 1, if there is one, is the span.
GENERATORS = {
    "phone": re.compile(r"(?<![\w+])(?:\+|\(|\d)[\d() ./-]{5,22}\d(?!\w)"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)|(?<![\w:])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{1,4}(?![\w:])"),
    "card": re.compile(r"(?<![\w-])\d(?:[ -]?\d){11,18}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}[- ]?\d{2}[- ]?\d{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)"),
    "secret": re.compile(r"(?i:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|credentials?)\s*[:=]\s*[\"']?([^\s\"',;]{6,})"),
}
#: What stands before and after the @ of an address, and unbroken runs that may be secrets: each is walked once.
_LOCAL, _HOST = re.compile(r"[\w.+%-]"), re.compile(r"[\w-]+(?:\.[\w-]+)*")
_RUN, _SECRET = re.compile(r"[\w/+=.-]{16,}"), re.compile(r"[A-Za-z0-9_/+=.-]{16,}")
#: Kinds that may run on into what follows: the longest stretch at every start, of which each admissible end is proposed.
_STRETCHES = {
    "phone": re.compile(r"(?<![\w+])(?=((?:\+|\(|\d)[\d() ./-]{5,22}\d))"),
    "card": re.compile(r"(?<![\w-])(?=(\d(?:[ -]?\d){11,18}))"),
    "iban": re.compile(r"(?<!\w)(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}))"),
}
_NUMBER_AFTER = re.compile(r"[ ./()-]{1,2}\d")
_NUMBER_BEFORE = re.compile(r"[\d+(][ ./()-]{1,2}\Z")
_WORD_END = re.compile(r"\w\b")
#: A candidate needs a digit or an @ somewhere, so a text without either has only the named secrets.
_WORTH = re.compile(r"[\d@]|(?i:pass|pwd|token|secret|key|credential)")
#: Words before (and after) a span that say what it is.
_CONTEXT = {
    "mail": ("mail", "contact", "correo", "courriel", "@"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "anruf", "llam", "appel"),
    "net": ("ip", "host", "server", "address", "addr", "login", "client", "ping", "peer"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "tarjeta", "carte"),
    "id": ("ssn", "social", "tax id", "passport", "national id"),
    "bank": ("iban", "bank", "konto", "account", "cuenta", "compte"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "auth", "bearer", "credential"),
    "number": ("isbn", "order", "invoice", "version", "build", "release", "no.", "nr", "ref", "id", "page", "figure", "section", "serial", "doi"),
    "hash": ("commit", "sha", "md5", "hash", "checksum", "digest", "revision", "etag"),
    "amount": ("$", "€", "usd", "eur", "total", "price", "population"),
    "date": ("date", "on ", "since", "until", "born", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december"),
}
_PREFIXES = ("akia", "ghp_", "gho_", "sk-", "sk_", "xox", "eyj", "aiza", "glpat", "pk_", "rk_", "asia")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    try:
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    except ValueError:
        return False


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every proposed span; where a number, code or word may follow, all its ends are proposed."""
    if not _WORTH.search(text):
        return []
    out = []

    def propose(kind: str, a: int, b: int) -> None:
        while b > a and text[b - 1] in ".-":
            b -= 1
        if b - a >= 5:
            out.append((kind, a, b))

    at = text.find("@")
    while at >= 0:
        # Outward from the sign, so that no run is walked more than once.
        a, host = at, _HOST.match(text, at + 1)
        while a and _LOCAL.match(text[a - 1]):
            a -= 1
        if host and a < at:
            propose("email", a, host.end())
        at = text.find("@", at + 1)
    for m in _RUN.finditer(text):
        run = m.group()
        # A run with letters of other scripts is no key, but a part of it between dots may be.
        parts = [m.span()] if run.isascii() else [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"[^.]+", run)]
        for a, b in parts:
            if _SECRET.fullmatch(text, a, b) and any(c in "0123456789" for c in text[a:b]):
                propose("secret", a, b)
    for kind, pattern in GENERATORS.items():
        grouped = pattern.groups > 0
        for m in pattern.finditer(text):
            propose(kind, *(m.span(1) if grouped and m.group(1) is not None else m.span()))
    known = set(out)
    for kind, stretch in _STRETCHES.items():
        for m in stretch.finditer(text):
            a, last = m.span(1)
            for e in _WORD_END.finditer(text, a, min(last + 1, len(text))):
                b = e.end()
                if b <= last and text[b : b + 1] != "_" and (kind, a, b) not in known and GENERATORS[kind].fullmatch(text, a, b):
                    known.add((kind, a, b))
                    out.append((kind, a, b))
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in (s.count(c) for c in set(s)))


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a span."""
    s = text[a:b]
    n = len(s)
    digits = "".join(c for c in s if "0" <= c <= "9")
    nd = len(digits)
    letters = sum(c.isalpha() for c in s)
    upper = sum(c.isupper() for c in s)
    low = s.lower()
    groups = re.findall(r"\d+", s)
    shape = [len(g) for g in groups]
    before = text[max(0, a - 40) : a].lower()
    prev, following = text[a - 1 : a], text[b : b + 1]
    octets = kind == "ip" and len(groups) == 4 and all(int(g) < 256 and (g == "0" or g[0] != "0") for g in groups)
    date = bool(re.fullmatch(r"(?:19|20)\d\d[-/. ](?:0?[1-9]|1[0-2])[-/. ](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/. ](?:0?[1-9]|[12]\d|3[01])[-/. ](?:19|20)?\d\d", s))
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    ssn = kind == "ssn" and nd == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    out = [float(kind == k) for k in KINDS]
    out += [
        n, nd, nd / n, letters / n, upper / n, len(groups), max(shape, default=0), min(shape, default=0),
        float(nd >= 12 and luhn(digits)), float(octets), float(kind == "iban" and iban_ok(s)), float(ssn), float(date),
        float(s[:1] == "+"), float("(" in s and ")" in s), float(s.count("-")), float(s.count(" ")), float(s.count(".")), float("@" in s), float(len(s.rsplit(".", 1)[-1]) if "@" in s and "." in s.split("@")[-1] else 0),
        float(bool(_NUMBER_AFTER.match(text, b))), float(bool(_NUMBER_BEFORE.search(text[max(0, a - 3) : a]))), float(s.count(":")), float("::" in s),
        _entropy(s), hexes / n, float(low.startswith(_PREFIXES)), float(n in (32, 40, 64)), float(prev in ("\"", "'", "=", ":")) + 2 * float(prev.isalnum()), float(following in ("\"", "'", ";")) + 2 * float(following.isalnum()),
    ]
    # The nearer the word, the larger the value; 0 without it.
    out += [max(before.rfind(w) for w in words) + 1.0 for words in _CONTEXT.values()]
    return out


# Generated examples.
_LETTERS = ("etaoinshrdlu", "enistrahdulc", "esaitnrulodc", "eaosrnidlctu")


class Generator:
    """Invented prose with personal data, and with what only looks like it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        return "".join(self.r.choice(self.r.choice(_LETTERS)) for _ in range(self.r.randint(2, 9)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def hex(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n))

    def card(self, good: bool) -> str:
        n = self.r.choice((16, 16, 16, 15))
        while True:
            d = self.digits(n)
            if d[0] != "0" and luhn(d) == good:
                sep = self.r.choice(("", "", "", " ", "-"))
                return sep.join(d[k : k + 4] for k in range(0, n, 4))

    def base64(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def iban(self, good: bool) -> str:
        body = self.digits(18)
        country = self.r.choice(("DE", "FR", "ES", "GB"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        if not good:
            check = (check + self.r.randint(1, 90)) % 97
        s = f"{country}{check:02d}{body}"
        return s if self.r.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    def ipv6(self) -> str:
        groups = [f"{self.r.randrange(1 << self.r.choice((4, 16, 16, 16))):x}" for _ in range(8)]
        if self.r.random() < 0.5:
            return ":".join(groups)
        n = self.r.randint(1, 4)
        return f"{self.r.choice(('fe80', '2001:db8', 'fd00'))}::{':'.join(groups[:n])}"

    def following(self, kind: str) -> str:
        """What often comes right after data of a kind."""
        r, d = self.r, self.digits
        if kind == "card":
            return r.choice((f" {r.randint(1, 12):02d}/{r.randint(24, 35)}", f" {d(3)}", f" {d(4)}", f" exp {r.randint(1, 12):02d}/{r.randint(24, 35)}"))
        if kind == "iban":
            return r.choice((f" BIC {self.base64(8).upper()}", f" {r.randint(1, 99)}", " EUR"))
        return r.choice((f" {r.randint(1, 9)} {self.word()}", f" {r.randint(2, 60)} {self.word()}", f" ext {d(3)}"))

    def positive(self, kind: str) -> tuple[str, str, str]:
        """(words before, the data, words after)"""
        r, bare = self.r, self.r.random() < 0.7
        if kind == "email":
            local = r.choice((f"{self.word()}.{self.word()}", f"{self.word()}.{r.randint(1, 99)}", self.word(), f"{self.word()}_{self.word()}", f"{self.word()}+{self.word()}"))
            host = r.choice((f"mail{r.randint(1, 9)}.{self.word()}.com", f"{self.word()}.com", f"{self.word()}.{r.choice(('org', 'net', 'de', 'fr', 'es', 'io', 'co.uk'))}"))
            return ("" if bare else r.choice(("email: ", "mail ", "contact "))), f"{local}@{host}", ""
        if kind == "phone":
            d = self.digits
            s = r.choice((f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{r.randint(1, 99)}{d(10)}", f"+49 {d(3)} {d(7)}", f"{d(3)}.{d(3)}.{d(4)}"))
            return ("" if bare else r.choice(("phone: ", "tel. ", "call ", "mobile "))), s, ""
        if kind == "ip":
            if r.random() < 0.4:
                return ("" if bare else r.choice(("ip ", "host: ", "server ", "login from "))), self.ipv6(), ""
            return ("" if bare else r.choice(("ip ", "host: ", "server ", "login from "))), ".".join(str(r.randint(0, 255)) for _ in range(4)), ""
        if kind == "card":
            return ("" if bare else r.choice(("card ", "visa: ", "payment "))), self.card(True), ""
        if kind == "ssn":
            s = f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
            return ("" if bare else r.choice(("ssn ", "SSN: ", "social security "))), s, ""
        if kind == "iban":
            return ("" if bare else r.choice(("iban ", "IBAN: ", "account "))), self.iban(True), ""
        s = r.choice((self.hex(40), self.hex(32), "AKIA" + self.base64(16).upper(), "ghp_" + self.base64(36), "sk-" + self.base64(40), self.base64(r.randint(20, 44)), f"{self.word()}{self.digits(3)}!{self.word().upper()}"))
        open_, close = r.choice((('"', '"'), ("'", "'"), ("", "")))
        return r.choice(("token = ", "TOKEN = ", "api_key = ", "secret: ", "password=", "password: ", "key = ", "auth token: ")) + open_, s, close

    def negative(self) -> str:
        """What is no personal data."""
        r, d = self.r, self.digits
        return r.choice(
            (
                lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1950, 2030)}", lambda: f"version {r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}.{r.randint(0, 9)}",
                lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), lambda: self.card(False), lambda: self.card(False), lambda: self.card(False), lambda: f"order {d(r.randint(6, 12))}", lambda: f"{r.randint(1, 999)},{d(3)},{d(3)}", lambda: f"{r.randint(1, 99999)}.{d(r.randint(1, 8))}",
                lambda: f"isbn 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"commit {self.hex(40)}", lambda: f"md5 {self.hex(32)}", lambda: f"sha256: {self.hex(64)}", lambda: f"@{self.word()}", lambda: f"{self.word()} @ {self.word()}", lambda: f"{self.word()}@{self.word()}", lambda: d(r.randint(5, 12)),
                lambda: f"https://{self.word()}.com/{self.word()}/{d(4)}-{self.word()}-{self.word()}", lambda: f"{self.word()}-{self.word()}-{self.word()}-{d(2)}", lambda: f"{self.word()}_{self.word()}_{self.word()}_{d(3)}", lambda: f"{d(4)} {d(4)}", lambda: f"{r.randint(1, 12)}:{d(2)}:{d(2)}",
                lambda: f"9{d(2)}-{d(2)}-{d(4)}", lambda: f"000-{d(2)}-{d(4)}", lambda: self.iban(False), lambda: f"{d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"section {r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}", lambda: f"{d(3)} - {d(3)}", lambda: f"{self.word()}.{self.word()}.{self.word()}{d(2)}", lambda: f"{d(r.randint(13, 22))}", lambda: f"{d(4)}-{d(4)}",
            )
        )()

    def example(self) -> tuple[str, list[tuple[str, int, int]]]:
        """A text and the spans in it that are personal data."""
        text, truth = "", []
        for _ in range(self.r.randint(2, 6)):
            text += self.words(self.r.randint(2, 12)) + self.r.choice((" ", " ", ", ", ". ", "\n"))
            if self.r.random() < 0.5:
                kind = self.r.choice(KINDS)
                before, data, after = self.positive(kind)
                truth.append((kind, len(text) + len(before), len(text) + len(before) + len(data)))
                text += before + data + after
                if kind in _STRETCHES and self.r.random() < 0.3:
                    text += self.following(kind)
            else:
                text += self.negative()
            text += self.r.choice((" ", " ", ". ", ", ", " | "))
        return text + self.words(3), truth


@dataclass(frozen=True)
class Model:
    """``slope`` and ``shift`` turn margins into probabilities; ``threshold``: least probability, per kind."""

    trees: trees.BoostedTrees
    slope: float
    shift: float
    threshold: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.shift, -50, 50)))


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of the candidates in ``n`` generated texts.  A candidate is right if it is exactly a
    span that is personal data, of its kind."""
    g = Generator(seed)
    x, y, kinds = [], [], []
    for _ in range(n):
        text, truth = g.example()
        right = set(truth)
        for c in candidates(text):
            x.append(features(text, *c))
            y.append(float(c in right))
            kinds.append(c[0])
    return np.array(x), np.array(y), kinds


@functools.lru_cache(maxsize=4)
def fit(texts: int = 3000, precision: float = 0.98, seed: int = 5) -> Model:
    """Trees on ``texts`` generated texts; calibration (Platt) and thresholds on half as many others.  A kind's
    threshold is the smallest that reaches ``precision`` there, 0.5 at least."""
    x, y, _ = examples(texts, seed)
    model = trees.fit(x, y)
    xc, yc, kinds = examples(texts // 2, seed + 1)
    margin = model.margin(xc)
    slope, shift = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -50, 50)))
        w = q * (1 - q) + 1e-9
        gradient = np.array([((q - yc) * margin).sum(), (q - yc).sum()])
        hessian = np.array([[(w * margin * margin).sum(), (w * margin).sum()], [(w * margin).sum(), w.sum()]]) + np.eye(2) * 1e-3
        step = np.linalg.solve(hessian, gradient)
        slope, shift = slope - step[0], shift - step[1]
    p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -50, 50)))
    threshold = {}
    for k in KINDS:
        own = np.array([z == k for z in kinds])
        order = np.argsort(-p[own])
        ps, ys = p[own][order], yc[own][order]
        good = np.flatnonzero((np.cumsum(ys) / np.arange(1, len(ys) + 1) >= precision) & (ps >= 0.5))
        last = good[-1] if len(good) else -1
        below = ps[last + 1] if last + 1 < len(ps) else 0.0
        # Half-way to the first one that would not do.
        threshold[k] = max(0.5, float(ps[last] + below) / 2) if len(good) else 0.5
    return Model(model, float(slope), float(shift), threshold)


def select(text_candidates: list[tuple[str, int, int]], p: np.ndarray, model: Model) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, probability) of the redactions: above the kind's threshold, the likeliest first where
    spans overlap (ties: the longer, the earlier), in reading order."""
    ranked = sorted(((q, b - a, -a, kind) for (kind, a, b), q in zip(text_candidates, p, strict=True) if q >= model.threshold[kind]), reverse=True)
    taken: list[tuple[int, int, str, float]] = []
    for q, n, minus_a, kind in ranked:
        a, b = -minus_a, n - minus_a
        # Those taken are in order and apart, so only the neighbours can overlap.
        k = bisect.bisect_left(taken, (a,))
        if (k == len(taken) or b <= taken[k][0]) and (not k or taken[k - 1][1] <= a):
            taken.insert(k, (a, b, kind, q))
    return taken


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def find_all(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str, float]]]:
    """The redactions of each text; all candidates are scored together."""
    found = [candidates(t) if t else [] for t in texts]
    x = [features(t, *c) for t, cs in zip(texts, found, strict=True) for c in cs]
    p = model.probability(np.array(x)) if x else np.zeros(0)
    out, at = [], 0
    for cs in found:
        out.append(select(cs, p[at : at + len(cs)], model) if cs else [])
        at += len(cs)
    return out


_SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def redactions(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, redactions, redacted) of every row with something to redact: the spans (code points, end exclusive),
    their kinds and probabilities, and the text with ``[KIND]`` in their place.

    Whole texts are searched, in time that grows as their length, unbroken runs of signs among them; one map, no shuffle.  Null and empty texts, and those with nothing to redact, give no
    row; a null key is kept; repeated rows give repeated results; other columns are ignored.
    """
    model = model or fit()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.where(F.octet_length(F.col(f"`{text}`")) > 0).select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind = picked.schema["k"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "t", _SLICE):
            texts = part.column("t").to_pylist()
            found = find_all(texts, shared.value)
            rows = [i for i, f in enumerate(found) if f]
            if rows:
                spans = [[{"start": a, "end": b, "kind": k, "score": round(q, 6)} for a, b, k, q in found[i]] for i in rows]
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(rows)), pa.array(spans, _ARROW_SPANS), pa.array([redact(texts[i], found[i]) for i in rows])], names=["k", "redactions", "redacted"])

    return map_arrow(picked, run, f"k {kind}, redactions {_SPANS}, redacted string").withColumnRenamed("k", key)
