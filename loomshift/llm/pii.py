"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole segments of a window of tokens: features of the entire span (its digits, marks, checksum, shape and
what stands before it) rather than of single tokens. Dynamic programming over segments of bounded length chooses boundaries
and types jointly. It is trained here, on windows made from rules with a fixed seed, by maximum likelihood with the same
programme for the partition function.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters of a segment at most. A window has no bound of its own.
MAX_TOKENS, MAX_SPAN = 24, 160

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order: leftmost, non-overlapping, those dropped that fail their test."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and not LOCAL_END.match(text, start - 1):
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found["email"].append((start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in PHONE.finditer(text):
        if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
            found["phone"].append(m.span())
    return found


TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\S\n]+|[^A-Za-z0-9]")
#: Where a window may lie: around seven digits or more with marks between, or around a written-out or bare at sign.
NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9]){6,}")
AT = re.compile(r"@|[(\[] ?(?:at|AT) ?[)\]]")
WORDS_BEFORE = {"phone": ("tel", "phone", "call", "mobile", "fax", "cell", "ring"), "card": ("card", "visa", "mastercard", "amex", "credit"), "ip": ("ip", "host", "server", "address"), "email": ("mail", "email", "contact", "write")}


def span_features(tokens: list[str], i: int, j: int, before: str) -> tuple[str, ...]:
    """Features of the whole span tokens[i:j]; empty for spans that can be no entity at all."""
    hints = tuple(kind for kind, ws in WORDS_BEFORE.items() if any(w in before for w in ws))
    return _features("".join(tokens[i:j]), not (i and tokens[i - 1].isdigit() or j < len(tokens) and tokens[j].isdigit()), hints)


@lru_cache(maxsize=50_000)
def _features(span: str, whole: bool, hints: tuple[str, ...]) -> tuple[str, ...]:
    digits = re.sub(r"[^0-9]", "", span)
    n = len(digits)
    has_at = AT.search(span)
    if (n < 7 and not has_at) or span[0].isspace() or span[-1].isspace() or len(span) > MAX_SPAN:
        return ()
    marks = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", span))))
    letters = sum(map(str.isalpha, span))
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    out = [f"marks={marks}", f"digits={n if n < 20 else 20}", f"letters={min(3, letters)}", f"groups={min(6, len(groups))}"]
    if has_at and n < 7 or letters:
        dotted = re.search(r"(?:\.|[(\[] ?(?:dot|DOT) ?[)\]]) ?[A-Za-z]{2,}$", span)
        out += [f"at={bool(has_at)}", f"domain={bool(dotted)}", f"starts={'a' if span[0].isalnum() else 'x'}", f"written={bool(has_at and len(has_at[0]) > 1)}", f"blanks={min(5, span.count(' '))}"]
    else:
        quads = span.split(".")
        out += [f"luhn={13 <= n <= 19 and luhn(digits)}", f"quads={len(quads) == 4 and all(re.fullmatch('[0-9]{1,3}', q) and int(q) <= 255 for q in quads)}", f"plus={span[0] == '+'}", f"bracket={'(' in span and ')' in span}"]
        out += ["shape=" + "-".join(map(str, groups[:6])) if len(groups) > 1 else "shape=one", f"first={digits[0]}", f"whole={whole}"]
    return (*out, *(f"after={kind}" for kind in hints))


class SpanField:
    """Log-linear weights of (feature, kind) over segments; tokens outside entities have weight zero."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.weights = weights

    def segments(self, tokens: list[str], lead: str) -> list[list[tuple[int, tuple[str, ...]]]]:
        """For each end, the (start, features) of the segments that could be entities."""
        return list(self.segments_by_end(tokens, lead))

    def segments_by_end(self, tokens: list[str], lead: str) -> Iterator[list[tuple[int, tuple[str, ...]]]]:
        """The same end by end, holding no more than the ends that a segment can reach."""
        ends: deque[list[tuple[int, tuple[str, ...]]]] = deque([] for _ in range(MAX_TOKENS + 1))
        digits = [len(t) if t[0] in "0123456789" else 0 for t in tokens]
        signs = [t == "@" or t in "([" and "".join(tokens[k + 1 : k + 3]).strip().lower()[:2] == "at" for k, t in enumerate(tokens)]
        for i, token in enumerate(tokens):
            yield ends.popleft()
            ends.append([])  # ends[0] is now that of i + 1
            if not (token.isalnum() or token in "+("):
                continue
            before, n, m = None, 0, 0
            for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
                n, m = n + digits[j - 1], m + signs[j - 1]
                if m > 1 or n > 20:  # no entity has two at signs or so many digits
                    break
                if n < 7 and not m:
                    continue
                if before is None:
                    before = (lead + "".join(tokens[max(0, i - 12) : i]))[-24:].lower()
                if (found := span_features(tokens, i, j, before)):
                    ends[j - i - 1].append((i, found))
        yield ends.popleft()

    def score(self, found: tuple[str, ...], kind: str) -> float:
        get = self.weights.get
        return sum(get((f, kind), 0.0) for f in found)

    def best(self, tokens: list[str], lead: str = "") -> list[tuple[int, int, str]]:
        """The best segmentation's entities, as token spans."""
        n = len(tokens)
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for j, starts in enumerate(self.segments_by_end(tokens, lead)):
            if j:
                top[j], back[j] = top[j - 1], None
            for i, found in starts:
                for kind in KINDS:
                    value = top[i] + self.score(found, kind)
                    if value > top[j] + 1e-12:
                        top[j], back[j] = value, (i, j, kind)
        out, j = [], n
        while j:
            if back[j]:
                out.append(back[j])
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def expected(self, ends) -> tuple[float, dict[tuple[int, int, str], float]]:
        """Log partition function and the probability of each entity, by forward and backward sums over segments."""
        n = len(ends) - 1
        ahead = [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            terms = [ahead[j - 1], *(ahead[i] + self.score(f, k) for i, f in ends[j] for k in KINDS)]
            m = max(terms)
            ahead[j] = m + math.log(sum(math.exp(t - m) for t in terms))
        behind = [-math.inf] * n + [0.0]
        for j in range(n, 0, -1):
            for i, value in [(j - 1, behind[j]), *((i, behind[j] + self.score(f, k)) for i, f in ends[j] for k in KINDS)]:
                m = max(behind[i], value)
                behind[i] = m + math.log(math.exp(behind[i] - m) + math.exp(value - m))
        total = ahead[n]
        return total, {(i, j, k): math.exp(ahead[i] + self.score(f, k) + behind[j] - total) for j in range(1, n + 1) for i, f in ends[j] for k in KINDS}


def made_windows(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Windows with their entities as character spans, made by rules; half hold none."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghilmnoprstu") for _ in range(pick.randint(2, 8)))
    digits = lambda k: "".join(pick.choice("0123456789") for _ in range(k))

    def card(sep: str) -> str:
        body = pick.choice("3456") + digits(14)
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        return sep.join(whole[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{pick.randint(1, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"+{pick.randint(1, 99)}{a}{b}{c}", f"+{pick.randint(30, 49)} {digits(2)} {digits(4)} {digits(4)}", f"({a}) {b}.{c}", f"{a}.{b}.{c}"])

    def email() -> str:
        name, host, top = pick.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}"]), word(), pick.choice(["com", "org", "net", "example.com", "de"])
        return pick.choice([f"{name}@{host}.{top}", f"{name} (at) {host}.{top}", f"{name}[at]{host}[dot]{top}", f"{name} (at) {host} (dot) {top}", f"{name} @ {host}.{top}"])

    ip = lambda: ".".join(str(pick.randint(0, 255)) for _ in range(4))
    no = [lambda: f"{pick.randint(1900, 2030)}-{digits(2)}-{digits(2)} {digits(2)}", lambda: digits(pick.randint(7, 12)), lambda: f"{digits(2)}.{digits(3)}.{digits(3)}", lambda: f"{digits(4)} {digits(4)} {digits(1)}", lambda: f"{pick.randint(256, 999)}.{pick.randint(256, 999)}.{digits(1)}.{digits(2)}", lambda: "".join(pick.choice("0123456789abcdef") for _ in range(24)), lambda: f"{word()} @ {word()} {word()}", lambda: f"@{word()}", lambda: f"{digits(16)}{digits(6)}", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}"]
    yes = [("email", email), ("ip", ip), ("card", lambda: card(pick.choice(["", " ", "-", "."]))), ("phone", phone)]
    out = []
    for _ in range(n):
        lead = " ".join(word() for _ in range(pick.randint(0, 3)))
        lead = f"{lead} {pick.choice([w for ws in WORDS_BEFORE.values() for w in ws])}: " if pick.random() < 0.2 else lead + " " * bool(lead)
        if pick.random() < 0.5:
            kind, make = pick.choice(yes)
            text, spans = make(), []
            spans.append((len(lead), len(lead) + len(text), kind))
        else:
            text, spans = pick.choice(no)(), []
        out.append((lead + text + pick.choice(["", ".", " " + word(), ", " + word()]), spans))
    return out


@lru_cache(maxsize=1)
def trained(n: int = 700, rounds: int = 12, seed: int = 42, l2: float = 1e-3) -> SpanField:
    """Maximum-likelihood weights on n made windows, by AdaGrad in a fixed order."""
    weights: dict[tuple[str, str], float] = {}
    field, squares = SpanField(weights), {}
    data = []
    for text, spans in made_windows(n, seed):
        tokens = TOKEN.findall(text)
        starts, at = {}, 0
        for k, token in enumerate(tokens):
            starts[at] = k
            at += len(token)
        starts[at] = len(tokens)
        ends = field.segments(tokens, "")
        gold = {(starts[a], starts[b], kind) for a, b, kind in spans if a in starts and b in starts}
        if any(ends):
            data.append((ends, gold))
    for _ in range(rounds):
        for ends, gold in data:
            _, p = field.expected(ends)
            grad: dict[tuple[str, str], float] = {}
            for j, segments in enumerate(ends):
                for i, found in segments:
                    for kind in KINDS:
                        g = ((i, j, kind) in gold) - p[i, j, kind]
                        if abs(g) > 1e-4:
                            for f in found:
                                grad[f, kind] = grad.get((f, kind), 0.0) + g
            for key, g in grad.items():
                g -= l2 * weights.get(key, 0.0)
                squares[key] = squares.get(key, 0.0) + g * g
                weights[key] = weights.get(key, 0.0) + 0.5 * g / math.sqrt(squares[key] + 1e-6)
    return field


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of the text that can hold an entity, merged where they meet and as long as they get.

    An at sign's stretch has all that a segment with it can cover. Stretches begin and end between tokens.
    """
    found = [m.span() for m in NUMBERS.finditer(text)]
    for m in AT.finditer(text):
        found.append((max(0, m.start() - MAX_SPAN), min(len(text), m.end() + MAX_SPAN)))
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        while 0 < a and _one_token(text[a - 1], text[a]):
            a -= 1
        while b < len(text) and _one_token(text[b - 1], text[b]):
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _one_token(x: str, y: str) -> bool:
    return len(TOKEN.match(x + y)[0]) == 2


def field_spans(text: str, field: SpanField) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for a, b in windows(text):
        tokens = TOKEN.findall(text[a:b])
        places = [a]
        for token in tokens:
            places.append(places[-1] + len(token))
        if places[-1] != b:  # a character that is no token, such as a line end, parts the window
            tokens, places, at = [], [a], a
            for m in re.finditer(r"[A-Za-z]+|[0-9]+|[^\S\n]+|(?s:.)", text[a:b]):
                tokens.append(m[0])
                at += len(m[0])
                places.append(at)
        for i, j, kind in field.best(tokens, text[max(0, a - 24) : a]):
            found[kind].append((places[i], places[j]))
    return found


def all_spans(text: str | None, field: SpanField) -> tuple[dict, dict]:
    """(base spans, all spans): the field's spans are added where they meet no base span of any kind."""
    text = text or ""
    base = base_spans(text)
    taken = sorted(s for spans in base.values() for s in spans)
    more = {k: list(v) for k, v in base.items()}
    for kind, spans in field_spans(text, field).items():
        more[kind] += [(a, b) for a, b in spans if not any(x < b and a < y for x, y in taken)]
        more[kind].sort()
    return base, more


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each stretch of spans replaced by the kinds that cover it."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are those of the base spans, spans lists all of them. Positions are code points, ends
    exclusive. Null counts as the empty text; repeated rows come back repeated; other columns are ignored.
    """
    field = docs.sparkSession.sparkContext.broadcast(trained())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, more = all_spans(text, field.value)
                counts = [len(base[k]) for k in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(more), sum(map(len, more.values())) - sum(counts)))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
