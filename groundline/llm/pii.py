"""Personal data by a semi-Markov conditional random field over whole spans.

Base rules find plain addresses, network addresses, card and telephone numbers; what they find
always stays. The field looks at the text around triggers (at signs, long numbers, account numbers,
long mixed strings, words that announce a secret). There it cuts the text into tokens and considers
every run of up to ``LONGEST`` tokens of a line as a candidate of the kinds whose outline it has. A
candidate is scored as a whole (checksums, number of digits, balance of brackets, announcing words
before it, what touches its ends), neighbouring segments by their pair of kinds. Dynamic programming over
segments of bounded length picks the best cut into entities and single other tokens.

Weights are fitted to sentences that a fixed rule makes, with spans of every kind and look-alikes
(versions, dates, measures, order numbers, digests): there are no labels of personal data to learn
from. Fitting takes seconds on the driver; the weights, some hundreds of numbers, travel to the tasks.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm.batches import slices

# Base kinds first, in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "account", "identity", "secret")
BASE_KINDS = KINDS[:4]
LONGEST = 26  # tokens of an entity
SENTENCES = 250
PASSES = 30
SEED = 71

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from left to right; each at sign is looked at once, so long runs cost no more."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """What the base rules find: leftmost, without overlap within a kind; failing matches are dropped."""
    found = [Span(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                found.append(Span(m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        found += [Span(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


# Where candidates are looked for: cheap tests, one of which every outline below contains.
_AT_SIGNS = re.compile(r"@|[(\[{][aA][tT][)\]}]| [aA][tT] [A-Za-z0-9-]+(?: [dD][oO][tT] | ?[(\[{][dD][oO][tT])")
_NUMBERS = re.compile(r"[0-9](?:[ ().+/-]{0,2}[0-9]){6}|[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}")
_ACCOUNTS = re.compile(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")
_MIXED = re.compile(r"[A-Za-z0-9_-]{20,}+")
_ANNOUNCED = re.compile(r"(?i:password|passwd|secret|token|api.?key|credential|bearer|pwd)", re.ASCII)
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\W_]+|[^\s]")
_BEFORE, _BEHIND = 80, 60  # characters kept on both sides of a trigger
_AT = r"(?: ?@ ?| ?[(\[{]at[)\]}] ?)"
_SPELT = r"(?: ?[(\[{]dot[)\]}] ?| dot )"
_DOT = r"(?:\.| ?[(\[{]dot[)\]}] ?| dot )"
OUTLINES = (
    re.compile(
        rf"[A-Za-z0-9][A-Za-z0-9_%+-]*(?:{_DOT}[A-Za-z0-9_%+-]+)*(?:{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+| at [A-Za-z0-9-]+(?:{_SPELT}[A-Za-z0-9-]+)+)",
        re.IGNORECASE,
    ),
    re.compile(r"[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    re.compile(r"[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){2}[ .-][0-9]{1,4}(?:[ .-][0-9]{1,3})?|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}"),
    re.compile(r"(?:\+|\(|00[0-9]{1,3}[ ./-])[0-9](?:[ ()./-]{0,2}[0-9]){6,14}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"),
    re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    re.compile(r"[A-Za-z0-9][A-Za-z0-9_+/=.-]{6,}[A-Za-z0-9=]"),
)
# Words that announce each kind.
HERALDS = (
    {"mail", "email", "contact", "write", "address", "reach", "courriel", "correo"},
    {"ip", "host", "server", "address", "login", "peer", "client", "gateway"},
    {"card", "visa", "mastercard", "credit", "debit", "payment", "carte", "tarjeta", "karte"},
    {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "dial", "telefon", "téléphone", "teléfono"},
    {"iban", "account", "bank", "transfer", "konto", "compte", "cuenta"},
    {"ssn", "social", "security", "identity", "taxpayer"},
    {"password", "passwd", "secret", "token", "key", "apikey", "credential", "bearer", "pwd"},
)
# Words that announce a look-alike.
DECOYS = {"version", "order", "isbn", "invoice", "part", "serial", "commit", "sha", "sha1", "md5", "checksum", "release", "ticket", "tracking", "section", "chapter", "digest", "v", "build", "hash"}


class Window(NamedTuple):
    start: int  # of the window in the text
    text: str
    tokens: list[tuple[int, int]]


def triggers(text: str) -> list[tuple[int, int]]:
    """Places that a candidate may hold; only addresses do without a digit."""
    found = [m.span() for m in _AT_SIGNS.finditer(text)]
    if _DIGIT.search(text):
        found += [m.span() for p in (_NUMBERS, _ACCOUNTS, _ANNOUNCED) for m in p.finditer(text)]
        found += [m.span() for m in _MIXED.finditer(text) if _DIGIT.search(m[0])]
    return sorted(found)


def windows(text: str) -> Iterator[Window]:
    """Stretches of a line around triggers, merged where they meet and cut between tokens."""
    low = high = -1
    for start, end in triggers(text):
        left = max(0, start - _BEFORE, text.rfind("\n", max(0, start - _BEFORE), start) + 1)
        newline = text.find("\n", end, end + _BEHIND)
        right = newline if newline >= 0 else end + _BEHIND
        if low >= 0 and left <= high:
            high = max(high, right)
            continue
        if low >= 0:
            yield _window(text, low, high)
        low, high = left, right
    if low >= 0:
        yield _window(text, low, high)


def _window(text: str, low: int, high: int) -> Window:
    while low > 0 and text[low - 1].isalnum() and text[low].isalnum():
        low -= 1
    high = min(high, len(text))
    while high < len(text) and text[high - 1].isalnum() and text[high].isalnum():
        high += 1
    part = text[low:high]
    return Window(low, part, [m.span() for m in _TOKEN.finditer(part)])


class Candidate(NamedTuple):
    first: int  # token
    after: int  # token behind the last
    kind: int
    features: tuple[int, ...]


@cache
def _place(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % WEIGHTS


WEIGHTS = 1 << 12  # places of hashed feature names


def _iban(span: str) -> bool:
    plain = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _features(window: Window, first: int, after: int, kind: int, words: list[str]) -> tuple[int, ...]:
    """What the whole span says for or against its kind."""
    text = window.text
    start, end = window.tokens[first][0], window.tokens[after - 1][1]
    span, before, behind = text[start:end], text[start - 1 : start], text[end : end + 1]
    digits = digits_of(span)
    names = ["kind", f"digits{min(len(digits), 20)}", f"left{_edge(before)}", f"right{_edge(behind)}"]
    near = [w for w in words[max(0, first - 6) : first] if w]
    names += ["heralded"] * any(w in HERALDS[kind] for w in near) + ["decoyed"] * any(w in DECOYS for w in near)
    names += ["balanced"] if span.count("(") == span.count(")") and span.count("[") == span.count("]") else ["unbalanced"]
    if kind == 0:
        lowered = span.lower()
        names.append("sign" if "@" in span else "bracket" if re.search(r"[(\[{]at", lowered) else "word")
        names.append("dots" if "." in span.rpartition("@")[2] else "spelt")
        names.append(f"ending{min(len(re.split(r'[^a-z]', lowered)[-1]), 5)}")
    elif kind == 1:
        names.append("octets" if all(int(p) < 256 for p in re.findall("[0-9]+", span)) else "beyond")
        names += ["defanged"] * ("[" in span) + ["leading"] * bool(re.search(r"(?<![0-9])0[0-9]", span))
    elif kind == 2:
        names.append("luhn" if luhn(digits) else "unsound")
        names.append("even" if len({len(p) for p in re.split("[ .-]", span)}) <= 2 else "uneven")
        names.append(f"issuer{digits[0]}")
    elif kind == 3:
        names.append("plus" if span[0] == "+" else "bracket" if span[0] == "(" else "zeros" if digits.startswith("00") else "bare")
        groups = [len(g) for g in re.findall("[0-9]+", span)]
        names += [f"groups{min(len(groups), 6)}", f"last{min(groups[-1], 6)}"] + ["dated"] * bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-./][0-9]{2}[-./][0-9]{2}.*", span))
        names += ["decimal"] * bool(re.fullmatch(r"[0-9]+\.[0-9]+", span)) + ["apart"] * (len(groups) > 1)
    elif kind == 4:
        names.append("sum" if _iban(span) else "unsound")
    elif kind == 5:
        names.append("issued" if span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000" else "unissued")
    else:
        mixed = (any(c.isdigit() for c in span), any(c.islower() for c in span), any(c.isupper() for c in span))
        names += [f"mixed{sum(mixed)}", f"length{min(len(span) // 8, 5)}", f"hex{re.fullmatch('[0-9a-f]+', span) is not None}"]
        given = text[max(0, start - 3) : start].replace('"', "").replace("'", "").strip()
        names += ["assigned"] * given.endswith(("=", ":")) + ["heralded assigned"] * (given.endswith(("=", ":")) and any(w in HERALDS[6] for w in near[-3:]))
        names += ["varied"] * (len(set(span)) >= min(12, len(span) // 2)) + ["dotted"] * ("." in span)
    return tuple(_place(f"{KINDS[kind]} {name}") for name in names)


def _edge(c: str) -> str:
    return "end" if c in ("", "\n") else "blank" if c == " " else "digit" if c.isdigit() else "letter" if c.isalpha() else "quote" if c in "\"'`<>" else "other"


def _glued(text: str, start: int, end: int, kind: int) -> bool:
    """Whether a run goes on at one of its ends, by a letter, a digit or a joining mark before one."""
    joining = "._%+-@" if kind == 0 else "-_/@.+"
    before, behind = text[max(0, start - 2) : start], text[end : end + 2]
    on_left = before[-1:].isalnum() or (len(before) == 2 and before[1] in joining and before[0].isalnum())
    return on_left or behind[:1].isalnum() or (len(behind) == 2 and behind[0] in joining and behind[1].isalnum())


def candidates(window: Window) -> list[Candidate]:
    """Every run of tokens that has the outline of a kind and does not go on at its ends, with its features."""
    text, tokens = window.text, window.tokens
    words = [text[a:b].lower() for a, b in tokens]
    at = {a: n for n, (a, _) in enumerate(tokens)}
    ends = {b: n + 1 for n, (_, b) in enumerate(tokens)}
    out = []
    for first, (start, _) in enumerate(tokens):
        head = text[start]
        if not (head.isascii() and (head.isalnum() or head in "+(")):
            continue
        limit = tokens[min(first + LONGEST, len(tokens)) - 1][1]
        for kind, outline in enumerate(OUTLINES):
            m = outline.match(text, start, limit)
            if m is None:
                continue
            end = m.end()
            while end > start:
                after = ends.get(end)
                if after is not None and (end == m.end() or outline.fullmatch(text, start, end)):
                    if not _glued(text, start, end, kind) and (kind != 6 or _secret_like(text[start:end], words, first)):
                        out.append(Candidate(at[start], after, kind, _features(window, first, after, kind, words)))
                before = [b for _, b in tokens[first : ends.get(end, len(tokens))] if b < end]
                end = before[-1] if before and kind != 6 else start
    return out


def _secret_like(span: str, words: list[str], first: int) -> bool:
    """Long strings of letters and digits, or shorter ones shortly after a word that announces one."""
    digit, letter = any(c.isdigit() for c in span), any(c.isalpha() for c in span)
    return digit and letter and (len(span) >= 20 or any(w in HERALDS[6] for w in words[max(0, first - 4) : first]))


@dataclass
class Field:
    """Weights of span features and of pairs of neighbouring kinds (the last is any other token)."""

    weights: np.ndarray
    pairs: np.ndarray

    def scores(self, found: list[Candidate]) -> np.ndarray:
        return flat_scores(self.weights, *flat_features(found))

    def best(self, n: int, found: list[Candidate]) -> list[Candidate]:
        """The best cut of ``n`` tokens into candidates and single other tokens."""
        if not found:
            return []
        kinds = len(KINDS) + 1
        ending: dict[int, list[int]] = {}
        for x, c in enumerate(found):
            ending.setdefault(c.after, []).append(x)
        score = self.scores(found)
        value = np.full((n + 1, kinds), -np.inf)
        value[0, -1] = 0.0
        back: list[list[tuple[int, int]]] = [[(-1, -1)] * kinds for _ in range(n + 1)]
        for i in range(1, n + 1):
            via = value[i - 1] + self.pairs[:, -1]
            k = int(via.argmax())
            value[i, -1], back[i][-1] = via[k], (k, -1)
            for x in ending.get(i, ()):
                c = found[x]
                via = value[c.first] + self.pairs[:, c.kind]
                k = int(via.argmax())
                if via[k] + score[x] > value[i, c.kind]:
                    value[i, c.kind], back[i][c.kind] = via[k] + score[x], (k, x)
        out, i, kind = [], n, int(value[n].argmax())
        while i > 0:
            before, x = back[i][kind]
            if x >= 0:
                out.append(found[x])
            i, kind = (found[x].first if x >= 0 else i - 1), before
        return out[::-1]

    def expected(self, n: int, found: list[Candidate], score: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log of the sum over all cuts, and how often each candidate and pair is expected in one."""
        kinds = len(KINDS) + 1
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for x, c in enumerate(found):
            ending.setdefault(c.after, []).append(x)
            starting.setdefault(c.first, []).append(x)
        ahead, behind = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
        ahead[0, -1] = 0.0
        behind[n] = 0.0
        for i in range(1, n + 1):
            ahead[i, -1] = _log_sum(ahead[i - 1] + self.pairs[:, -1])
            for x in ending.get(i, ()):
                c = found[x]
                ahead[i, c.kind] = np.logaddexp(ahead[i, c.kind], _log_sum(ahead[c.first] + self.pairs[:, c.kind]) + score[x])
        for i in range(n - 1, -1, -1):
            behind[i] = self.pairs[:, -1] + behind[i + 1, -1]
            for x in starting.get(i, ()):
                c = found[x]
                behind[i] = np.logaddexp(behind[i], self.pairs[:, c.kind] + score[x] + behind[c.after, c.kind])
        whole = _log_sum(ahead[n])
        often, pairs = np.zeros(len(found)), np.zeros_like(self.pairs)
        for i in range(n):
            pairs[:, -1] += np.exp(ahead[i] + self.pairs[:, -1] + behind[i + 1, -1] - whole)
            for x in starting.get(i, ()):
                c = found[x]
                share = np.exp(ahead[i] + self.pairs[:, c.kind] + score[x] + behind[c.after, c.kind] - whole)
                pairs[:, c.kind] += share
                often[x] = share.sum()
        return whole, often, pairs


def flat_features(found: list[Candidate]) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of all candidates in a row, and where each one's start."""
    sizes = [len(c.features) for c in found]
    return np.fromiter((f for c in found for f in c.features), np.int64, sum(sizes)), np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64)


def flat_scores(weights: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[places], starts) if len(starts) else np.zeros(0)


def _log_sum(values: np.ndarray) -> float:
    top = values.max()
    return -np.inf if top == -np.inf else float(top + np.log(np.exp(values - top).sum()))


def _chosen(n: int, picked: list[Candidate]) -> np.ndarray:
    """Pairs of neighbouring kinds of a cut."""
    pairs, i, kind = np.zeros((len(KINDS) + 1,) * 2), 0, len(KINDS)
    for c in [*picked, None]:
        for _ in range(i, c.first if c else n):
            pairs[kind, -1] += 1
            kind = len(KINDS)
        if c:
            pairs[kind, c.kind] += 1
            i, kind = c.after, c.kind
    return pairs


class Example(NamedTuple):
    n: int
    found: list[Candidate]
    picked: list[int]
    places: np.ndarray
    starts: np.ndarray
    chosen: np.ndarray  # pairs of neighbouring kinds of the marked cut


def example(text: str, spans: set[tuple[int, int, int]]) -> Example:
    """A sentence as one window; spans are (start, end, kind)."""
    window = Window(0, text, [m.span() for m in _TOKEN.finditer(text)])
    found = candidates(window)
    picked = [x for x, c in enumerate(found) if (window.tokens[c.first][0], window.tokens[c.after - 1][1], c.kind) in spans]
    picked.sort(key=lambda x: found[x].first)
    return Example(len(window.tokens), found, picked, *flat_features(found), _chosen(len(window.tokens), [found[x] for x in picked]))


def gradient(field: Field, examples: list[Example], shrink: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalised log-likelihood of the marked cuts and its slopes."""
    total = -shrink * (np.square(field.weights).sum() + np.square(field.pairs).sum()) / 2
    weights, pairs = -shrink * field.weights, -shrink * field.pairs
    for e in examples:
        score = flat_scores(field.weights, e.places, e.starts)
        whole, often, often_pairs = field.expected(e.n, e.found, score)
        often = -often
        often[e.picked] += 1
        np.add.at(weights, e.places, np.repeat(often, np.diff([*e.starts, len(e.places)])))
        pairs += e.chosen - often_pairs
        total += score[e.picked].sum() + (e.chosen * field.pairs).sum() - whole
    return total, weights, pairs


def fit(examples: list[Example], passes: int = PASSES, shrink: float = 0.05, rate: float = 0.6) -> Field:
    """Weights of largest penalised likelihood, by steps scaled to each weight's past slopes."""
    kinds = len(KINDS) + 1
    field = Field(np.zeros(WEIGHTS), np.zeros((kinds, kinds)))
    seen_w, seen_p = np.full(WEIGHTS, 1e-6), np.full((kinds, kinds), 1e-6)
    for _ in range(passes):
        _, w, p = gradient(field, examples, shrink)
        seen_w += np.square(w)
        seen_p += np.square(p)
        field.weights += rate * w / np.sqrt(seen_w)
        field.pairs += rate * p / np.sqrt(seen_p)
    return field


_FILLING = "the a we please today then about from with list river note und der les des para con was said report only after before some more".split()
_NAMES = "anna jonas mira leo clara tomas ines paul nora emil".split()
_HOSTS = "mail example corp labs uni post nord".split()
_ENDINGS = "com org net de fr es io".split()


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _sound(rng: random.Random, n: int, good: bool) -> str:
    while luhn(d := rng.choice("3456") + _digits(rng, n - 1)) != good:
        pass
    return d


def _entity(rng: random.Random, kind: int) -> str:
    if kind == 0:
        local = rng.choice(_NAMES) + rng.choice(["", "." + rng.choice(_NAMES), _digits(rng, 2), "_" + rng.choice(_NAMES)])
        at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", ".")])
        return local + at + rng.choice(_HOSTS) + rng.choice(["", _digits(rng, 1)]) + dot + rng.choice(_ENDINGS)
    if kind == 1:
        return rng.choice([".", ".", "[.]"]).join(str(rng.randrange(1, 256)) for _ in range(4))
    if kind == 2:
        d, gap = _sound(rng, rng.choice([16, 16, 16, 13, 15]), True), rng.choice(["", " ", "-", "."])
        return gap.join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == 3:
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randrange(20, 99)} {a} {b}{c}", f"0049 {a} {b}{c}", f"{a}.{b}.{c}"])
    if kind == 4:
        plain = _digits(rng, 18)
        country = rng.choice(["DE", "FR", "ES"])
        check = 98 - int(plain + "".join(str(int(c, 36)) for c in country) + "00") % 97
        whole = f"{country}{check:02d}{plain}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.5 else whole
    if kind == 5:
        return f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
    return "".join(rng.choice(rng.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])) for _ in range(rng.choice([12, 20, 32, 40])))


def _lookalike(rng: random.Random) -> str:
    d = lambda n: _digits(rng, n)
    return rng.choice(
        [
            lambda: f"version {rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(3000)}",
            lambda: f"release {rng.randrange(400, 999)}.{d(2)}.{d(2)}.{d(3)}",
            lambda: f"on 20{d(2)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)} 12:{d(2)}:{d(2)}",
            lambda: f"order {d(rng.choice([8, 10, 12]))}",
            lambda: f"number {_sound(rng, 16, False)}",
            lambda: f"{_sound(rng, 16, False)}",
            lambda: f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            lambda: f"invoice {d(3)}-{d(4)}-{d(2)}",
            lambda: f"about {d(3)}.{d(7)} units",
            lambda: f"in {d(4)} {d(4)} {d(4)}",
            lambda: f"commit {hashlib.sha1(d(9).encode()).hexdigest()}",
            lambda: f"sha1 {hashlib.sha1(d(9).encode()).hexdigest()}",
            lambda: f"{rng.choice(_NAMES)} was at the house dot com",
            lambda: f"look at page {d(2)}.5 and stay at home",
            lambda: f"price 1{d(3)} 2{d(3)} items",
            lambda: f"{d(9)} and {d(7)}",
            lambda: f"the token of {rng.choice(_NAMES)} was a secret",
            lambda: f"serial {rng.choice(['AB', 'XK'])}{d(2)} {d(4)} {d(4)} {d(4)}",
        ]
    )()


def sentence(rng: random.Random) -> tuple[str, set[tuple[int, int, int]]]:
    """A sentence and the spans in it."""
    out, spans = "", set()
    for _ in range(rng.randrange(1, 4)):
        out += " ".join(rng.choice(_FILLING) for _ in range(rng.randrange(1, 5))) + " "
        if rng.random() < 0.45:
            out += _lookalike(rng) + rng.choice([" ", ", ", ". "])
            continue
        kind = rng.randrange(len(KINDS))
        entity = _entity(rng, kind)
        herald = rng.choice(sorted(HERALDS[kind]))
        if kind == 6:
            out += herald + rng.choice([" = ", ": ", '="', " = '"])
        elif rng.random() < (1.0 if kind == 5 or (kind == 3 and entity[0].isdigit() and "00" != entity[:2]) else 0.5):
            out += herald + rng.choice([" ", ": "])
        if kind != 6 or any(c.isdigit() for c in entity) and any(c.isalpha() for c in entity):
            spans.add((len(out), len(out) + len(entity), kind))
        out += entity + rng.choice([" ", ", ", ". ", "\n", '" ' if kind == 6 else " "])
    return out.rstrip(" "), spans


@cache
def fitted(sentences: int = SENTENCES, passes: int = PASSES, seed: int = SEED) -> Field:
    """The field fitted to ``sentences`` made ones; the same in every run."""
    rng = random.Random(seed)
    return fit([example(*sentence(rng)) for _ in range(sentences)], passes)


def spans_of(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those and the field's that do not touch one of them."""
    base = base_spans(text)
    if len(text) < 7:
        return base, base
    added, taken = [], sorted((s.start, s.end) for s in base)
    for window in windows(text):
        for c in field.best(len(window.tokens), candidates(window)):
            start, end = window.start + window.tokens[c.first][0], window.start + window.tokens[c.after - 1][1]
            added.append(Span(start, c.kind, end))
    # both lists are in order of their starts; within each of the field's spans nothing overlaps
    free, n = [], 0
    longest = np.maximum.accumulate([b for _, b in taken]) if taken else []
    starts = [a for a, _ in taken]
    for s in added:
        while n < len(starts) and starts[n] < s.end:
            n += 1
        if n == 0 or longest[n - 1] <= s.start:
            free.append(s)
    return base, sorted([*base, *free])


def spelt(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found`` of every row.

    Counts and digest are of the base spans; ``spans`` lists base spans and those of the field as
    kind:start:end in code points, end exclusive, by start and kind, and ``found`` holds them as
    structs. A span of the field that overlaps a base span is left out; base spans of different
    kinds may overlap. Null texts count as empty: no spans. Each row is looked at by itself, so
    repeated rows, null ids and empty tables are nothing special; texts are taken whole, in slices
    of bounded bytes. Other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(field or fitted())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: dict[str, list] = {name: [] for name in columns}
            for text in batch.column("text").to_pylist():
                base, spans = spans_of(text or "", known.value)
                for kind, name in enumerate(BASE_KINDS):
                    out[f"n_{name}"].append(sum(s.kind == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(spelt(base).encode()).hexdigest())
                out["spans"].append(spelt(spans))
                out["found"].append([{"kind": KINDS[s.kind], "start": s.start, "end": s.end} for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[n], kinds[n]) for n in columns)], names=["doc_id", *columns])

    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = {**{f"n_{k}": pa.int64() for k in BASE_KINDS}, "base_sha256": pa.string(), "spans": pa.string(), "found": found}
    columns = list(kinds)
    rest = T.StructType.fromDDL(", ".join([*(f"n_{k} long" for k in BASE_KINDS), "base_sha256 string, spans string, found array<struct<kind: string, start: long, end: long>>"]))
    return docs.select("doc_id", "text").mapInArrow(find, T.StructType([docs.select("doc_id").schema[0], *rest.fields]))


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets.

    Overlapping spans are replaced together, under the kind of the first. Null texts stay null.
    """
    known = docs.sparkSession.sparkContext.broadcast(field or fitted())

    @F.pandas_udf("string")
    def redact(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for s in spans_of(text, known.value)[1]:
                if s.start >= at:
                    out += [text[at : s.start], f"<{KINDS[s.kind]}>"]
                at = max(at, s.end)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", redact("text"))
