"""Personal data and secrets: candidate spans from high-recall generators, chosen by boosted trees.

The base spans (emails, ip addresses, card and phone numbers) come from fixed rules and always stay. Generators propose
further, overlapping spans: numbers and addresses in looser forms, such as "name (at) host (dot) org", a phone number
without its plus sign, an address with spaces around its dots, and values that look like keys or passwords. Trees that see each span's format and its context give a
probability; a span is added when that reaches its kind's threshold and it overlaps no base span and no likelier span.

The trees learn from all documents. Positive examples are base spans, base spans rewritten in looser forms, and
made values of every kind (names, hosts, numbers and keys drawn anew, so that nothing of the table's own values is
learnt) written into every document's text in those forms; negative ones are candidates that touch no base span, and
forms with broken digits or parts. Equal texts give the same examples and count once. Descriptions are cut into bins that are
the same for every table. A form is a template; the examples of each third of the templates, and of each third of the
documents, are judged by trees of the rest, which sets the threshold of each kind, the least with a precision of 0.99. So
thresholds and recall are those on forms the trees were not taught.

Defined cases: null and empty texts have no span; spans are code points, end exclusive; the rows of a table are judged one by
one, so repeated rows get equal results; without examples of both sorts nothing is added. Columns beside the text are
kept as they are.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

BASE = ("email", "ip", "card", "phone")
#: Kinds of spans, in their order; a secret is only ever added.
KINDS = (*BASE, "secret")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; the local part is looked for from its at sign backwards, which is linear on any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[Span]:
    """By kind as listed, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


_AT, _DOT = r"(?:\x20?(?:@|[(\[{<]\x20?(?:at|@)\x20?[)\]}>])\x20?|\x20at\x20)", r"(?:\x20\.\x20|\.|\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20)"
#: Marks between the digits of looser numbers: up to three characters.
_SEP = r"[\x20./_\u2010-\u2013-]{0,3}"
GENERATORS = {
    "email": re.compile(rf"(?<![\w.])[A-Za-z0-9_%+-]{{1,64}}(?:\.[A-Za-z0-9_%+-]{{1,64}}){{0,4}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}(?![\w@])", re.I),
    "email_short": re.compile(rf"(?<![\w.])[A-Za-z0-9_%+-]{{1,64}}(?:\.[A-Za-z0-9_%+-]{{1,64}}){{0,4}}{_AT}[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z0-9-]{{2,63}}", re.I),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,4}(?:(?:\x20?[.,]\x20?|\x20?[(\[{<]\x20?(?:\.|dot)\x20?[)\]}>]\x20?|\x20dot\x20|\x20)[0-9]{1,4}){3}(?![0-9])", re.I),
    "card": re.compile(rf"(?<![0-9])[0-9](?:{_SEP}[0-9]){{12,18}}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:00|\+)?\x20?[(]?[0-9]{1,4}[)]?(?:[\x20./-]{0,3}[(]?[0-9]{2,8}[)]?){1,5}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![\w+/.-])(?=[A-Za-z0-9+/_.-]{0,80}[0-9])(?:[A-Za-z0-9+/_-]{12,512}|[A-Za-z0-9_-]{8,512}(?:\.[A-Za-z0-9_-]{8,512}){2})={0,2}(?![\w+/@-]|\.\w)"),
}
#: A secret for certain: a value of 16 characters or more behind its name; it must mix letters and digits too.
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|bearer|api[_-]?key|access[_-]?key|key)\b[\"']?\x20?[=:]\x20?[\"']?([A-Za-z0-9+/_-]{16,256}={0,2})(?![\w+/.@-])")
#: What a text must hold for a generator to find anything.
_HINT = {"email": re.compile(r"@|\bat\b", re.I), "ip": re.compile(r"[0-9]"), "card": re.compile(r"[0-9]"), "phone": re.compile(r"[0-9]"), "secret": re.compile(r"[0-9]")}
CUES = re.compile(r"\b(?:mail|e-?mail|contact|write|phone|tel|call|fax|mobile|cell|card|visa|credit|ip|host|address|server|login|kontakt|anruf|telefon|correo|llamar|adresse|courriel|carte|karte|tarjeta)\b", re.I)


#: Common ends of host names.
ENDINGS = frozenset(["com", "org", "net", "edu", "gov", "info", "io", "co", "eu", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "us", "ca", "au", "dev", "app"])
#: A name of a secret and a sign right before a span.
NAMES = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|bearer|key|auth)[\w-]{0,8}[\"']?\s?(?:[=:]|is)\s?[\"']?$")


def _mixed(s: str) -> bool:
    return sum(c.isdigit() for c in s) >= 3 and sum(c.isalpha() for c in s) >= 3


def secrets(text: str) -> list[Span]:
    """Secrets that stand behind their names."""
    return [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text) if _mixed(m[1])] if "=" in text or ":" in text else []


def candidates(text: str | None) -> list[Span]:
    if not text:
        return []
    out = []
    for kind, g in GENERATORS.items():
        if _HINT[kind.partition("_")[0]].search(text):
            for m in g.finditer(text):
                a, b = m.start(), m.end()
                while a < b and text[a] == " ":
                    a += 1
                out.append((kind.partition("_")[0], a, b))
    return list(dict.fromkeys(out))


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a span, as numbers."""
    kind, a, b = span
    s, left, right = text[a:b], text[max(0, a - 40) : a], text[b : b + 12]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    parts = [int(g[:6]) for g in groups]
    tail = re.split(r"[.\x20)\]}>]", s)[-1]
    letters = re.findall(r"[A-Za-z]+", s)
    return [
        KINDS.index(kind), len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(len(d) >= 13 and luhn(d)), max(parts, default=0), float(max(parts, default=0) <= 255), float(s.startswith("+")), float(s.startswith("00")),
        s.count("("), s.count(" "), s.count("."), s.count("-"), s.count("@"), float(bool(re.search(r"[(\[{]at|\bat\b", s, re.I))),
        float(bool(re.search(r"dot", s, re.I))), len(tail) if tail.isalpha() else 0, float(bool(re.search(r"[(\[{<]\s?(?:at|@|dot|\.)\s?[)\]}>]", s, re.I))),
        float(tail.lower() in ENDINGS), len(re.findall(r"\bdot\b|\.", s, re.I)), max(map(len, letters), default=0), sum(c.isupper() for c in s) / len(s), sum(c in "aeiouAEIOU" for c in s) / max(1, sum(map(len, letters))), float(s.startswith("(") or s.startswith("0")), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(left[-1:].isalnum()), float(left[-1:] in "([{=\"'"), float(left[-1:] in ".-/_"), float(right[:1].isalnum()), float(right[:1] in ".-/_%"),
        float(bool(CUES.search(left))), float(bool(NAMES.search(left))), len(set(s)) / len(s), sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:])) / len(s), float(bool(re.search(r"[0-9]", left[-8:]))), float(bool(re.search(r"[0-9]", right[:8]))), len(set(d)),
    ]


def _bins(*cuts: float) -> np.ndarray:
    return np.array(cuts, float)


_COUNTS = _bins(*range(16), 17, 19, 21, 23, 25, 29, 32, 36, 40, 48, 64, 96)
_FRACTIONS = _bins(*(k / 32 for k in range(31)))
_PARTS = _bins(0, 3, 9, 12, 19, 28, 31, 49, 99, 127, 199, 255, 299, 399, 499, 599, 699, 799, 899, 999, 1899, 1989, 2030, 2999, 4999, 9999, 99999)
#: Where each number of a description is cut into at most 32 bins; nothing of a table goes into them.
CUTS = [_PARTS if k == 7 else _FRACTIONS if k in (23, 24, 35, 36) else _COUNTS for k in range(40)]
BINS = 32


def coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Numbers of bins: a number is at most the cut of its bin."""
    return np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)


#: Gradients are whole multiples of this, so that their sums are the same in any order.
_GRAIN = 2.0**-24
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def _steps(tree: Tree, codes: np.ndarray, steps: int) -> np.ndarray:
    """The node that each row comes to. Nodes are numbered as in a heap; a leaf above the last level leads to the left only."""
    feature, cut, _ = tree
    at, first, flat = np.zeros(len(codes), np.int64), np.arange(len(codes)) * codes.shape[1], codes.ravel()
    for _ in range(steps):
        at = 2 * at + 1 + (flat[first + feature[at]] > cut[at])
    return at


def sums(codes: np.ndarray, y: np.ndarray, raw: np.ndarray, tree: Tree, level: int, nodes: list[int]) -> np.ndarray:
    """Sums of gradients, of their slopes and of rows by node, feature and bin."""
    n_features = codes.shape[1]
    slots = np.full(2 ** (level + 1) - 1, -1)
    slots[nodes] = np.arange(len(nodes))
    slot = slots[_steps(tree, codes, level)]
    held = slot >= 0
    prob = 1 / (1 + np.exp(-raw[held]))
    first, own, size = slot[held] * BINS, codes[held], len(nodes) * BINS
    g, h = (np.rint(v / _GRAIN) for v in (prob - y[held], prob * (1 - prob)))
    out = np.empty((len(nodes), n_features, BINS, 3))
    for f in range(n_features):
        place = first + own[:, f]
        for k, made_ in enumerate((np.bincount(place, g, size), np.bincount(place, h, size), np.bincount(place, minlength=size))):
            out[:, f, :, k] = made_.reshape(-1, BINS)
    return out


class Trees:
    """Boosted trees for the logistic loss, grown level by level on sums by bin, whoever makes these."""

    def __init__(self, rounds: int = 40, depth: int = 5, rate: float = 0.3, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[Tree] = []
        self.start = 0.0
        self.cuts = CUTS

    def begin(self, share: float) -> Trees:
        p = min(max(share, 1e-3), 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        return self

    def sprout(self) -> list[int]:
        """A new tree; the nodes to be split."""
        inner = 2**self.depth - 1
        self.trees.append((np.zeros(inner, np.int64), np.full(inner, 255, np.uint8), np.zeros(inner + 1)))
        return [0]

    def split(self, nodes: list[int], made: np.ndarray) -> list[int]:
        """Splits nodes of the last tree by their sums; the nodes of the next level that are to be split."""
        feature, cut, value = self.trees[-1]
        inner, out = len(feature), []

        def end(node: int, g: float, h: float) -> None:
            while node < inner:
                node = 2 * node + 1
            value[node - inner] = -self.rate * g / (h + 1)

        for node, own in zip(nodes, made, strict=True):
            g, h, n = (np.cumsum(own[:, :, k] * (_GRAIN if k < 2 else 1), axis=1) for k in range(3))
            sum_g, sum_h, rows = g[0, -1], h[0, -1], n[0, -1]
            gain = g**2 / (h + 1) + (sum_g - g) ** 2 / (sum_h - h + 1) - sum_g**2 / (sum_h + 1)
            gain[(n < self.least) | (rows - n < self.least)] = 0
            f, k = divmod(int(gain.argmax()), BINS)
            if gain[f, k] <= 1e-6:
                end(node, sum_g, sum_h)
                continue
            feature[node], cut[node] = f, k
            for child, cg, ch in ((2 * node + 1, g[f, k], h[f, k]), (2 * node + 2, sum_g - g[f, k], sum_h - h[f, k])):
                if child < inner:
                    out.append(child)
                else:
                    end(child, cg, ch)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Fits on rows at hand, cut at quantiles."""
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        codes, raw = coded(x, self.cuts), np.zeros(len(y))
        raw += self.begin(y.mean()).start
        for _ in range(self.rounds):
            nodes = self.sprout()
            for level in range(self.depth):
                nodes = self.split(nodes, sums(codes, y, raw, self.trees[-1], level, nodes))
            raw += self._value(self.trees[-1], codes)
        return self

    def _value(self, tree: Tree, codes: np.ndarray) -> np.ndarray:
        return tree[2][_steps(tree, codes, self.depth) - len(tree[0])]

    def raw(self, codes: np.ndarray, trees: int | None = None) -> np.ndarray:
        """Log odds by the first trees, or by all."""
        return sum((self._value(t, codes) for t in self.trees[:trees]), np.full(len(codes), self.start))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(coded(x, self.cuts))))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "l"]) for _ in range(rng.randint(1, 3)))


def made(rng: random.Random, kind: str) -> str:
    """A value of a kind in its plain form, with nothing of the table's own values."""
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == "email":
        name = rng.choice(["{a}", "{a}.{b}", "{a}_{b}", "{a}{n}", "{i}.{a}", "{a}.{n}", "{a}-{b}", "{i}{a}", "{a}.{b}{n}"]).format(a=_word(rng), b=_word(rng), i=rng.choice("abcdefghijklmnop"), n=number(rng.randint(1, 4)))
        host = rng.choice(["{a}", "{a}", "{a}{b}", "{a}-{b}", "{a}{n}", "mail.{a}", "mail{n}.{a}", "{b}.{a}"]).format(a=_word(rng), b=_word(rng), n=number(1))
        out = f"{name}@{host}.{rng.choice(sorted(ENDINGS))}"
        return out.upper() if rng.random() < 0.1 else out.title() if rng.random() < 0.1 else out
    if kind == "ip":
        return ".".join(str(rng.randint(0 if k else 1, 255)) for k in range(4))
    if kind == "card":
        d = rng.choice("3456") + number(14)
        return next(d + c for c in "0123456789" if luhn(d + c))
    if kind == "phone":
        return "+" + rng.choice(["1", "44", "49", "33", "34", "39", "61"]) + rng.choice("23456789") + number(rng.choice([8, 9, 9, 9]))
    low, up, both = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    take = lambda letters, n: "".join(rng.choices(letters, k=n))
    return rng.choice([
        lambda: take("0123456789abcdef", rng.choice([24, 32, 40, 48, 64])), lambda: rng.choice(["AK", "AS", "GO"]) + take(up, rng.randint(14, 22)), lambda: take(low[:26], 3) + "_" + take(both, rng.randint(24, 40)),
        lambda: f"{take(low[:26], 2)}_{rng.choice(['live', 'test', 'prod'])}_{take(both, rng.randint(20, 32))}", lambda: ".".join([take(both + "_-", rng.randint(16, 40)) for _ in range(3)]), lambda: take(both + "+/", rng.choice([32, 40, 60, 86])) + rng.choice(["", "=", "=="]),
        lambda: take(both, rng.randint(20, 48)), lambda: take(low, rng.randint(20, 40)), lambda: f"{take(low[:26], 4)}-{number(12)}-{take(both, 24)}",
    ])()


_ATS = [" at ", " AT ", " (at) ", "(at)", "[at]", " [at] ", "{at}", " @ ", "@ ", " @", "<at>", "(@)", " {at} ", " ( at ) "]
_DOTS = [".", " dot ", " DOT ", " (dot) ", "(dot)", "[dot]", " [dot] ", "{dot}", " . ", "<dot>", "[.]", " {dot} "]
_POINTS = [" . ", "[.]", "(.)", ". ", " .", " (dot) ", "(dot)", " dot ", "[dot]", " [dot] ", " [.] ", "{.}"]
_BARS = [".", "/", "_", "  ", " - ", " . ", "--", " / ", "\u2013", "-"]


def rewritings(rng: random.Random, kind: str, s: str) -> list[tuple[str, int, int]]:
    """(text, label, number of the template) of looser forms of a plain value, and of forms that are broken."""
    d = _digits(s)
    wrong = "".join(d[:-1]) + str((int(d[-1]) + rng.randint(1, 9)) % 10) if d else ""
    out = []
    if kind == "email":
        name, _, host = s.partition("@")
        for _ in range(4):
            i, j = rng.randrange(len(_ATS)), rng.randrange(len(_DOTS))
            if (_ATS[i].strip() == "at" and _DOTS[j].strip() == ".") or ("@" in _ATS[i] and _DOTS[j] == " . "):
                j = 1 + j % 7
            out.append((name + _ATS[i] + host.replace(".", _DOTS[j]), 1, i * len(_DOTS) + j))
        first = host.partition(".")[0]
        return [*out, (f"{name} at {first}.", 0, 0), (f"{_word(rng)} at {_word(rng)}. {_word(rng).title()}", 0, 1), (f"{_word(rng)} @ {_word(rng)} . {_word(rng)}", 0, 2)]
    if kind == "ip":
        p = s.split(".")
        bad = list(p)
        bad[rng.randrange(4)] = str(rng.randint(256, 999))
        some = rng.sample(range(len(_POINTS)), 4)
        broken = [(_POINTS[k].join(bad), 0, k) for k in some]
        plain = " ".join(str(rng.randint(1, 255)) for _ in range(4))
        return [*((_POINTS[k].join(p), 1, k) for k in some), *broken, (".".join(bad), 0, 0), (plain, 0, 2), (", ".join(p), 0, 3)]
    if kind == "card":
        forms = []
        for k in rng.sample(range(len(_BARS)), 3):
            cut = rng.choice([(4, 4, 4, 7), (4, 6, 9), (2,) * 10, (4, 4, 4, 4, 4)])
            at = [0]
            for n in cut:
                at.append(at[-1] + n)
            forms += [(_BARS[k].join(x[a:b] for a, b in zip(at, at[1:]) if x[a:b]), label, k) for x, label in ((d, 1), (wrong, 0))]
        return [*forms, (wrong, 0, 0), (rng.choice([" ", "-"]).join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), 0, 1)]
    if kind == "secret":
        other = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(12, 30)))
        date = f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        k = len(s) * 7 + sum(map(ord, s[:3]))
        half = s[: max(16, len(s) // 2)]
        return [(s, 1, k), *((x, 1, k + 1) for x in (s.lower(), s[::-1]) if _mixed(x)), *([(half, 1, k + 2)] if _mixed(half) else []),
                (f"{other}{rng.randint(1, 99)}", 0, 0), (f"{other[:6]}-{rng.randint(1, 9999)}-{other[6:]}", 0, 1), (f"{_word(rng)}_{_word(rng)}_{date}", 0, 2), (f"{_word(rng)}/{_word(rng)}/{_word(rng)}{rng.randint(1, 99)}", 0, 3), (f"{date}-{_word(rng)}-{_word(rng)}", 0, 4), (rng.choice("_-").join([_word(rng), _word(rng) + _word(rng), date[:4], f"v{rng.randint(1, 20)}"]), 0, 6), ("".join(rng.choices("0123456789", k=rng.randint(12, 24))), 0, 5)]
    body, lead = d[-10:], d[:-10] or "1"
    a, b, c = body[:3], body[3:6], body[6:]
    forms = ["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}){}-{}", "{}/{} {}", "{} - {} - {}", "({}) {} {}", "{} {}{}", "{}-{}{}"]
    k = rng.randrange(len(forms))
    local = ["0{} {} {}", "0{}/{}{}", "(0{}) {}{}", "0{} {}{}", "0{}-{}-{}", "0{}.{}.{}"]
    m = rng.randrange(len(local))
    pairs = "0" + body[0] + " " + rng.choice([" ", ".", "-"]).join(body[i : i + 2] for i in range(1, 9, 2))
    cut = rng.randint(1, 3)
    fours = f"0{body[:cut]} {body[cut : cut + 4]} {body[cut + 4 : cut + 8]}"
    return [
        (rng.choice(["", "", f"{lead} ", f"00{lead} ", f"+{lead}/"]) + forms[k].format(a, b, c), 1, k), (local[m].format(body[:cut + 1], body[cut + 1 : cut + 4], body[cut + 4 : cut + 8]), 1, 10 + m), (pairs, 1, 16), (fours, 1, 17), (f"00{lead}{body}", 1, 18),
        (f"{body[:2]} {body[2:4]}", 0, 0), (f"{body[:5]}-{body[5:7]}", 0, 1), (f"{body[:4]}", 0, 2), (f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", 0, 3), (f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", 0, 4),
        (f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", 0, 5), (" ".join(str(rng.randint(1, 99)) for _ in range(4)), 0, 6), (f"{rng.randint(1, 99)}.{rng.randint(100, 999)}.{rng.randint(100, 999)}", 0, 7), (body, 0, 8),
    ]


def formal(kind: str, s: str) -> bool:
    """Whether a candidate passes the check of its kind, and so can't serve as a negative example."""
    d = _digits(s)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "ip":
        return all(int(p) <= 255 for p in re.findall(r"[0-9]+", s))
    return kind == "email" and "@" in s or kind == "phone" and s.startswith("+") or kind == "secret" and _mixed(s)


def near_spans(text: str | None, base: list[Span]) -> list[Span]:
    """Candidates that touch no base span."""
    return [s for s in candidates(text) if not any(a < s[2] and s[1] < b for _, a, b in base)]


def examples(text: str, seed: int, base: list[Span], forms: int) -> list[tuple[list[float], int, int]]:
    """(description, label, fold) of the candidates of a text, of a good and a broken form of its base spans, and of `forms` forms of made values."""
    rng = random.Random(seed)
    known = base + secrets(text)
    out = []
    for span in candidates(text):
        touching = [b for b in known if b[1] < span[2] and span[1] < b[2]]
        if not touching:
            if not formal(span[0], text[span[1] : span[2]]):
                out.append((describe(text, span), 0, seed % 3))
        elif any(b == span for b in touching):
            out.append((describe(text, span), 1, seed % 3))
    # places for forms: where base spans are, and the spaces of the text
    places = []
    for kind, a, b in known:
        for label in (1, 0):
            some = [f for f in rewritings(rng, kind, text[a:b]) if f[1] == label]
            places.append((kind, rng.choice(some), text[max(0, a - 60) : a], text[b : b + 60]))
    while forms > 0:
        kind = rng.choice(KINDS)
        at = text.find(" ", rng.randrange(len(text) + 1)) + 1
        before = rng.choice(["key: ", "token=", "password is ", ""]) if kind == "secret" and rng.random() < 0.5 else ""
        some = rewritings(rng, kind, made(rng, kind))
        some = rng.sample(some, min(forms, len(some)))
        forms -= len(some)
        after = rng.choice([" ", ", ", ". "]) + text[at : at + 60]
        places += [(kind, f, text[max(0, at - 60) : at] + before, after) for f in some]
    for kind, (form, label, template), left, right in places:
        whole = left + form + right
        a, b = len(left), len(left) + len(form)
        for span in candidates(whole):
            if span[0] == kind and span[1] < b and a < span[2]:
                good = bool(label) and span[1:] == (a, b)
                out.append((describe(whole, span), int(good), template % 3 if good else seed % 3))
            elif span[1] < b and a < span[2] and not formal(span[0], whole[span[1] : span[2]]):
                out.append((describe(whole, span), 0, seed % 3))
    return out


class Detector:
    """Trees and thresholds; without them only base spans are found."""

    def __init__(self, trees: Trees | None = None, thresholds: dict[str, float] | None = None):
        self.trees, self.thresholds = trees, thresholds or {}

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        return self.every([text])[0]

    def every(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text, by kind as listed, then start; one prediction for all texts."""
        base = [base_spans(t) for t in texts]
        if not self.trees:
            return [(b, b) for b in base]
        near = [near_spans(t, own) for t, own in zip(texts, base, strict=True)]
        x = [describe(t, s) for t, spans in zip(texts, near, strict=True) for s in spans]
        return list(zip(base, self.chosen(base, near, coded(np.array(x), CUTS) if x else None), strict=True))

    def chosen(self, base: list[list[Span]], near: list[list[Span]], codes: np.ndarray | None) -> list[list[Span]]:
        """All spans of each text; codes: bins of the descriptions of the candidates near, text by text."""
        every = [list(b) for b in base]
        if self.trees and codes is not None and len(codes):
            who = [(i, s) for i, spans in enumerate(near) for s in spans]
            p = 1 / (1 + np.exp(-self.trees.raw(codes)))
            for k in np.argsort(-p, kind="stable").tolist():
                i, s = who[k]
                if p[k] >= self.thresholds.get(s[0], 2.0) and not any(a < s[2] and s[1] < b for _, a, b in every[i]):
                    every[i].append(s)
        return [sorted(e, key=lambda s: (KINDS.index(s[0]), s[1])) for e in every]


#: Characters of text whose candidates are judged at once.
GROUP = 4 << 20


def _groups(texts: pd.Series) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_WIDTH = len(CUTS) + 2
#: Forms of made values that a small table is filled up to, and the most in one text; at least one is written into every text.
FORMS, FORMS_A_TEXT = 16_000, 60
#: Examples that a tree is grown on, at least, where there are so many; examples of a task.
PART, TASK = 32_768, 65_536


def _listed(spans: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in spans], _SPANS)


def scanned(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each of docs: keep, base: its base spans, near: other candidates, codes: bins of their descriptions; examples: bins, label
    and fold of its examples; h1, h2: hashes of its text."""
    n = docs.count()
    forms = max(1, min(FORMS_A_TEXT, -(-FORMS // max(1, n))))
    rows = docs.select(*keep, F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"), F.col(text).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            seeds = [h % (1 << 20) for h in batch.column(batch.num_columns - 3).to_pylist()]
            base = [base_spans(t) for t in texts]
            near = [near_spans(t, own) for t, own in zip(texts, base, strict=True)]
            got = [examples(t, k, own, forms) if t else [] for t, k, own in zip(texts, seeds, base, strict=True)]
            x = [describe(t, s) for t, spans in zip(texts, near, strict=True) for s in spans] + [e[0] for own in got for e in own]
            codes = coded(np.array(x), CUTS) if x else np.zeros((0, len(CUTS)), np.uint8)
            about, at = [], 0
            for spans in near:
                about.append(codes[at : at + len(spans)].tobytes())
                at += len(spans)
            shown = []
            for own in got:
                tail = np.array([e[1:] for e in own], np.uint8).reshape(-1, 2)
                shown.append(np.hstack([codes[at : at + len(own)], tail]).tobytes())
                at += len(own)
            more = [_listed(base), _listed(near), pa.array(about, pa.binary()), pa.array(shown, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "base", "near", "codes", "examples"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(scan, f"{fields}, base {SPANS}, near {SPANS}, codes binary, examples binary")


def _parts(table: DataFrame, parts: int, tasks: int):
    """(part, examples) of a scanned table, dealt by text, each text once."""
    once = table.filter(F.octet_length("examples") > 0).select("_h1", "_h2", "examples").dropDuplicates(["_h1", "_h2"])
    dealt = once.select(F.pmod(F.xxhash64("_h2"), F.lit(parts)).alias("part"), "examples")

    def packed(rows):
        held: dict[int, list[bytes]] = {}
        for part, own in rows:
            held.setdefault(part, []).append(bytes(own))
        return [(part, b"".join(own)) for part, own in held.items()]

    return dealt.rdd.coalesce(tasks).mapPartitions(packed).persist(StorageLevel.MEMORY_AND_DISK)


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and folds."""
    e = np.frombuffer(blob, np.uint8).reshape(-1, _WIDTH)
    return np.ascontiguousarray(e[:, :-2]), e[:, -2].astype(float), e[:, -1]


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


def fit(table: DataFrame, precision: float = 0.99) -> Detector:
    """Trees and thresholds from all examples of a scanned table.

    Sums of gradients by node, feature and bin are made by the tasks and added, so the driver sees sums only. Examples are dealt
    into at most as many parts as there are rounds; each tree is grown on one part, in turn, so every example takes part. A
    small table is one part. Four forests grow at the same time: three that know two folds each, and judge the third, and
    the one that stays. Thresholds come from counts of all examples by kind and by what the forest that doesn't know them says.
    """
    most = table.agg(F.sum(F.octet_length("examples"))).first()[0] or 0
    n = most // _WIDTH
    forests = [Trees() for _ in range(4)]
    rounds, depth = forests[0].rounds, forests[0].depth
    parts = max(1, min(rounds, n // PART))
    every = _parts(table, parts, max(1, -(-n // TASK)))
    none = [np.zeros((3, 2))]
    counted = every.map(lambda r: [np.bincount(_opened(r[1])[2] * 2 + _opened(r[1])[1].astype(int), minlength=6).reshape(3, 2).astype(float)]).fold(none, _added)[0]
    if not counted.sum(axis=0).all():
        every.unpersist()
        return Detector()
    known = []
    for k, t in enumerate(forests):
        own = counted[[j for j in range(3) if j != k]].sum(axis=0)
        known.append(bool(own.all()))
        t.begin(own[1] / max(1.0, own.sum()))
    for r in range(rounds):
        before = [t.raw for t in forests]

        def with_odds(row, before=before):
            codes, y, fold = _opened(row[1])
            return codes, y, fold, [f(codes) for f in before]

        mine = every.filter(lambda row, p=r % parts: row[0] == p).coalesce(max(1, -(-n // parts // TASK))).map(with_odds).persist(StorageLevel.MEMORY_AND_DISK)
        nodes = [t.sprout() for t in forests]
        for level in range(depth):
            zero = [np.zeros((len(own), len(CUTS), BINS, 3)) for own in nodes]

            def level_sums(rows, trees=[t.trees[-1] for t in forests], level=level, nodes=nodes, zero=zero):  # noqa: B006
                total = zero
                for codes, y, fold, raw in rows:
                    rest = [fold != k for k in range(len(raw))]
                    total = _added(total, [sums(codes[w], y[w], o[w], t, level, own) for w, o, t, own in zip(rest, raw, trees, nodes, strict=True)])
                return [total]

            made_ = mine.mapPartitions(level_sums).treeReduce(_added)
            nodes = [t.split(own, m) for t, own, m in zip(forests, nodes, made_, strict=True)]
        mine.unpersist()

    def judged(row):
        """Numbers of bad and good examples by kind and by log odds, of the forests that don't know them."""
        codes, y, fold = _opened(row[1])
        raw = np.full(len(y), -np.inf)
        for k in range(3):
            if known[k]:
                raw[fold == k] = forests[k].raw(codes[fold == k])
        place = np.clip(np.floor(raw * 128), 0, 2047).astype(int)
        held = (raw >= 0) & (codes[:, 0] < len(KINDS))
        flat = (codes[held, 0].astype(int) * 2048 + place[held]) * 2 + y[held].astype(int)
        return [np.bincount(flat, minlength=len(KINDS) * 4096).reshape(len(KINDS), 2048, 2).astype(float)]

    seen = every.map(judged).treeReduce(_added)[0][:, ::-1]
    every.unpersist()
    thresholds = {}
    for kind, own in zip(KINDS, seen, strict=True):
        bad, hits = np.cumsum(own, axis=0).T
        good = np.flatnonzero((own.sum(axis=1) > 0) & (hits >= precision * (hits + bad)))
        if len(good) and hits[good[-1]] >= 10:
            thresholds[kind] = float(1 / (1 + np.exp(-(2047 - good[-1]) / 128)))
    return Detector(forests[3], thresholds)


def train(docs: DataFrame, text: str = "text", precision: float = 0.99) -> Detector:
    """Fits on the examples of all texts of docs."""
    return fit(materialize(scanned(docs, text), "scanned"), precision)


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), precision: float = 0.99) -> DataFrame:
    """keep and found (FOUND) of each of docs, by trees that learn from docs: each text is read once for both."""
    table = materialize(scanned(docs, text, keep), "scanned")
    detector = fit(table, precision)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, base, near, codes = ([[tuple(s.values()) for s in own] for own in c.to_pylist()] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns)
            every = detector.chosen(base, near, np.frombuffer(b"".join(codes), np.uint8).reshape(-1, len(CUTS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], _listed(every)], names=[*batch.schema.names[:-2], "every"])

    few = table.select(*keep, "base", "near", "codes")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema.fields[:-2])
    judged = few.filter(F.size("near") > 0).mapInArrow(choose, f"{fields}, every {SPANS}")
    rows = few.filter(F.size("near") == 0).select(*keep, "base", F.col("base").alias("every")).union(judged)
    shown = F.transform("every", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array_contains("base", s).alias("base")))
    return rows.select(*keep, shown.alias("found"))


FOUND = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(detector: Detector, text: Column | str = "text") -> Column:
    """All spans of each text, as FOUND: by kind as listed, then start."""

    @F.pandas_udf(FOUND)
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for group in _groups(texts):
            for base, every in detector.every(group):
                own = set(base)
                out.append([{"kind": s[0], "start": s[1], "end": s[2], "base": s in own} for s in every])
        return pd.Series(out)

    return of(text)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest."""
    if text is None:
        return None
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
    return "".join(out) + text[done:]


def redacted(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """docs with the text redacted and a column spans (FOUND); a column of that name is replaced."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([redact(t, [(s["kind"], s["start"], s["end"]) for s in f]) for t, f in zip(texts, found, strict=True)])

    held = docs.select(*(F.col(c) for c in docs.columns if c != "spans"), find(detector, text).alias("spans"))
    return held.withColumn(text, of(text, "spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: base spans of every document, counted and digested, and all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = detect(docs, keep=("doc_id",)).withColumnRenamed("found", "s")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("s", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = [F.size("s").cast("long").alias("n_spans"), F.size(F.filter("s", lambda x: x["kind"] == "secret")).cast("long").alias("n_secret")]
    return held.select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), *added)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
