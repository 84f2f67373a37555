"""Personal data by a semi-Markov conditional random field over whole spans.

Four patterns give the base spans. They miss other spellings of the same things (``4111.1111.1111.1111``, ``name (at) host.org``, a phone number without
its plus), which the field finds: every span that could be one is scored as a whole (its digit groups, separators, checksum, octets, what
stands beside it), and a dynamic program over the places where spans begin and end chooses boundaries and kinds together. Spans are bounded in
tokens and characters, everything else is outside and scores nothing, so texts fall into short islands around digits and at signs, which are decided one by
one without loss. The field is trained on a bounded sample of the texts themselves: base spans are the labels, and
each is also shown respelled, or replaced by a number that is none (a date, a version, an amount).
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = 0

#: Texts that the field learns from, at most, and islands of one text.
FIT_ROWS, FIT_ISLANDS = 4000, 20
EPOCHS, RATE, DECAY = 8, 0.3, 1e-4
#: Bounds of a span: tokens, characters, single blanks inside, groups of digits and least number of digits unless it has an at sign.
MAX_TOKENS, MAX_CHARS, MAX_BLANKS, MAX_GROUPS, MIN_DIGITS = 24, 80, 6, 8, 6

# The base patterns.
_EMAIL_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole or not at all, which finds the same and does not try its every digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches by their at signs: what stands before one up to the last match, then the host."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        # What precedes belongs to the run that ends here, whether or not it matched.
        if host:
            yield start, host.end()
            end = host.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns, by kind, then start; code points, end exclusive."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


# --- candidate spans ---

_AT = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]", re.IGNORECASE)
_SIGNS = re.compile(r"[0-9]|@|[(\[{<]\s?at\s?[)\]}>]", re.IGNORECASE)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)
_INSIDE = frozenset(".-()/+@[]{}<>_%,:'")
_DOT = re.compile(r"\s*[(\[{<]\s?dot\s?[)\]}>]\s*", re.IGNORECASE)
_LOOSE_AT = re.compile(r"\s*(?:@|[(\[{<]\s?at\s?[)\]}>])\s*", re.IGNORECASE)
_LOOSE_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of the text outside which no candidate can lie, cut at line ends."""
    lo = hi = None
    for m in _SIGNS.finditer(text):
        if hi is not None and m.end() <= hi - MAX_CHARS:
            continue
        a, b = max(0, m.start() - MAX_CHARS), min(len(text), m.end() + MAX_CHARS)
        if lo is not None and a <= hi:
            hi = b
        else:
            if lo is not None:
                yield lo, hi
            lo, hi = a, b
    if lo is not None:
        yield lo, hi


def _alnum(text: str, k: int) -> bool:
    return 0 <= k < len(text) and text[k].isalnum()


def candidates(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """(start, end) of the spans of an island that may be personal data.

    A candidate has no letter or digit right beside it, no line end and no two blanks in a row inside, and holds an at sign or at least MIN_DIGITS
    digits without letters.
    """
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
    kinds = []
    for a, b in tokens:
        c = text[a]
        kinds.append("d" if "0" <= c <= "9" else "l" if c.isalnum() else "b" if c in " \t " else "n" if c.isspace() else "p" if c in _INSIDE else "n")
    ats = [(m.start(), m.end()) for m in _AT.finditer(text, lo, hi)]
    out = []
    near = 0
    for i, (a, b) in enumerate(tokens):
        if kinds[i] not in "dl" and not (text[a] in "+(" and i + 1 < len(tokens) and (kinds[i + 1] == "d" or text[b] == "(")):
            continue
        if a and _alnum(text, a - 1) and (kinds[i] in "dl"):
            continue
        while near < len(ats) and ats[near][0] < a:
            near += 1
        at = ats[near] if near < len(ats) and ats[near][1] - a <= MAX_CHARS else None
        digits = blanks = n_groups = 0
        letters = False
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            start, end = tokens[j]
            kind = kinds[j]
            if end - a > MAX_CHARS or kind == "n":
                break
            if kind == "b":
                blanks += 1
                if blanks > MAX_BLANKS or kinds[j - 1] == "b":
                    break
                continue
            if kind == "l":
                letters = True
                if at is None:
                    break
            if kind == "d":
                digits += end - start
                n_groups += 1
                if n_groups > MAX_GROUPS and at is None:
                    break
            whole = at is not None and at[1] <= end
            if (kind in "dl" or text[start] in ")]}") and not _alnum(text, end) and (whole and end > at[1] or not letters and digits >= MIN_DIGITS):
                out.append((a, end))
    return out


# --- features ---


def _beside(c: str) -> str:
    return "none" if not c else "word" if c.isalnum() else "blank" if c.isspace() else c if c in ".,-/+@()$%:=\"'#_" else "sign"


@lru_cache(maxsize=100_000)
def _described(groups: str, signs: str, luhn_ok: bool, octets: bool, head: str, left: str, right: str, cut_left: bool, cut_right: bool) -> tuple[str, ...]:
    n = sum(map(int, groups.split("-")))
    size = "16-19" if 16 <= n <= 19 else "8-15" if 8 <= n <= 15 else "few" if n < 8 else "many"
    return (
        "digits", f"n={min(n, 24)}", f"size={size}", f"groups={groups if groups.count('-') < 7 else 'many'}", f"n_groups={min(groups.count('-') + 1, 9)}", f"signs={signs}",
        f"luhn={luhn_ok and size == '16-19'}", f"octets={octets}", f"octets={octets},signs={signs}", f"head={head}", f"size={size},head={head}", f"left={left}", f"right={right}",
        f"cut_left={cut_left}", f"cut_right={cut_right}",
    )


def features(text: str, start: int, end: int) -> tuple[str, ...]:
    """What the field sees of a whole span and of what stands beside it."""
    span, before, after = text[start:end], text[max(0, start - 2) : start], text[end : end + 2]
    left, right = _beside(before[-1:]), _beside(after[:1])
    if _AT.search(span):
        address = _DOT.sub(".", _LOOSE_AT.sub("@", span))
        host = address.rsplit("@", 1)[1]
        last = host.rsplit(".", 1)[-1]
        # A longer address that this one is only part of.
        part = before[-1:] in _EMAIL_LOCAL if before else False
        part_right = after[:1] in "-_" if after[:1] else False
        more = len(after) > 1 and after[0] == "." and after[1].isalnum()
        return (
            "at", f"mail={_LOOSE_MAIL.fullmatch(address) is not None}", f"ats={address.count('@')}", f"last={last.isalpha() and 2 <= len(last) <= 8}",
            f"blank_host={' ' in host}", f"blank_local={' ' in address.split('@')[0]}", f"dots={min(3, host.count('.'))}", f"bracket={'@' not in span}",
            f"part={part}", f"part_right={part_right}", f"more={more}", f"left_at={left}",
        )
    parts = re.findall(r"[0-9]+", span)
    digits = "".join(parts)
    octets = len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    signs = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
    head = span[0] if span[0] in "+(" else "0" if digits[0] == "0" else "9"
    cut_left = bool(before) and before[-1] in " .-/(+,:" and before[-2:-1].isdigit() or before[-1:] in ("+", "(")
    cut_right = bool(after) and after[0] in " .-/)(,:" and after[1:2].isdigit()
    return _described("-".join(str(len(p)) for p in parts), signs, 16 <= len(digits) <= 19 and luhn(digits), octets, head, left, right, cut_left, cut_right)


# --- the field ---


class Field:
    """Weights per feature and kind, and for kinds that follow one another without a gap."""

    def __init__(self, weights: dict[str, list[float]] | None = None, follows: list[list[float]] | None = None):
        self.weights = weights or {}
        self.follows = follows or [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)]

    def score(self, names: tuple[str, ...]) -> list[float]:
        """The sum of the weights for each kind."""
        total = [0.0] * len(KINDS)
        for name in names:
            w = self.weights.get(name)
            if w is not None:
                for y, v in enumerate(w):
                    total[y] += v
        return total


class Lattice:
    """Places where candidates begin or end, in order, and the candidates between them; what lies between two places may be outside."""

    def __init__(self, spans: list[tuple[int, int]], names: list[tuple[str, ...]]):
        self.places = sorted({p for s in spans for p in s})
        at = {p: k for k, p in enumerate(self.places)}
        self.spans, self.names = spans, names
        self.arcs = [(at[a], at[b]) for a, b in spans]
        self.starting: list[list[int]] = [[] for _ in self.places]
        for k, (i, _) in enumerate(self.arcs):
            self.starting[i].append(k)


def _sum_exp(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def _enter(column: list[float], follows: list[list[float]], y: int) -> list[float]:
    return [column[x] + follows[x][y] for x in range(len(column))]


def decode(field: Field, lattice: Lattice) -> list[tuple[int, int]]:
    """(candidate, kind index) of the best segmentation; ties go to outside, then to the earlier kind."""
    n, ys = len(lattice.places), len(KINDS) + 1
    best = [[-math.inf] * ys for _ in range(n)]
    came: list[list[tuple | None]] = [[None] * ys for _ in range(n)]
    best[0][OUTSIDE] = 0.0
    known: dict[tuple[str, ...], list[float]] = {}
    for p in range(n):
        column = best[p]
        if p + 1 < n:
            ways = _enter(column, field.follows, OUTSIDE)
            x = max(range(ys), key=ways.__getitem__)
            if ways[x] > best[p + 1][OUTSIDE]:
                best[p + 1][OUTSIDE], came[p + 1][OUTSIDE] = ways[x], (p, x, None)
        for k in lattice.starting[p]:
            j, names = lattice.arcs[k][1], lattice.names[k]
            scores = known.get(names)
            if scores is None:
                scores = known[names] = field.score(names)
            for y in range(1, ys):
                ways = _enter(column, field.follows, y)
                x = max(range(ys), key=ways.__getitem__)
                if ways[x] + scores[y - 1] > best[j][y]:
                    best[j][y], came[j][y] = ways[x] + scores[y - 1], (p, x, k)
    out = []
    p, y = n - 1, max(range(ys), key=best[n - 1].__getitem__)
    while came[p][y] is not None:
        before, x, k = came[p][y]
        if k is not None:
            out.append((k, y - 1))
        p, y = before, x
    return out[::-1]


def expectations(field: Field, lattice: Lattice) -> tuple[float, list[list[float]], list[list[float]]]:
    """Log of the sum over all segmentations, the probability of each (candidate, kind), expected numbers of (before, after) pairs."""
    n, ys = len(lattice.places), len(KINDS) + 1
    scores = [field.score(names) for names in lattice.names]
    alpha = [[-math.inf] * ys for _ in range(n)]
    beta = [[-math.inf] * ys for _ in range(n)]
    alpha[0][OUTSIDE] = 0.0

    def plus(a: float, b: float) -> float:
        if a == -math.inf or b == -math.inf:
            return b if a == -math.inf else a
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    for p in range(n):
        if p + 1 < n:
            alpha[p + 1][OUTSIDE] = plus(alpha[p + 1][OUTSIDE], _sum_exp(_enter(alpha[p], field.follows, OUTSIDE)))
        for k in lattice.starting[p]:
            j = lattice.arcs[k][1]
            for y in range(1, ys):
                alpha[j][y] = plus(alpha[j][y], _sum_exp(_enter(alpha[p], field.follows, y)) + scores[k][y - 1])
    beta[n - 1] = [0.0] * ys
    for p in range(n - 2, -1, -1):
        for x in range(ys):
            value = field.follows[x][OUTSIDE] + beta[p + 1][OUTSIDE]
            for k in lattice.starting[p]:
                j = lattice.arcs[k][1]
                for y in range(1, ys):
                    value = plus(value, field.follows[x][y] + scores[k][y - 1] + beta[j][y])
            beta[p][x] = value
    total = _sum_exp(alpha[n - 1])
    chance = [[0.0] * len(KINDS) for _ in lattice.arcs]
    pairs = [[0.0] * ys for _ in range(ys)]
    for p in range(n - 1):
        for x in range(ys):
            if alpha[p][x] == -math.inf:
                continue
            pairs[x][OUTSIDE] += math.exp(alpha[p][x] + field.follows[x][OUTSIDE] + beta[p + 1][OUTSIDE] - total)
            for k in lattice.starting[p]:
                j = lattice.arcs[k][1]
                for y in range(1, ys):
                    v = math.exp(alpha[p][x] + field.follows[x][y] + scores[k][y - 1] + beta[j][y] - total)
                    chance[k][y - 1] += v
                    pairs[x][y] += v
    return total, chance, pairs


def lattice_of(text: str, lo: int, hi: int) -> Lattice | None:
    spans = candidates(text, lo, hi)
    return Lattice(spans, [features(text, a, b) for a, b in spans]) if spans else None


def fit(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Field:
    """Maximum conditional likelihood with a quadratic penalty, by AdaGrad over the examples (text, spans).

    An example whose spans are not all candidates teaches nothing and is left out.
    """
    prepared = []
    for text, gold in examples:
        lattice = lattice_of(text, 0, len(text))
        if lattice is None:
            continue
        at = {s: k for k, s in enumerate(lattice.spans)}
        if any((a, b) not in at for _, a, b in gold) or any(x[2] > y[1] for x, y in zip(gold, gold[1:])):
            continue
        prepared.append((lattice, [(at[a, b], KINDS.index(kind)) for kind, a, b in gold]))
    field, ys = Field(), len(KINDS) + 1
    seen: dict[str, list[float]] = {}
    seen_pairs = [[1e-8] * ys for _ in range(ys)]
    order = list(range(len(prepared)))
    rng = random.Random(17)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            lattice, gold = prepared[k]
            _, chance, pairs = expectations(field, lattice)
            for c, y in gold:
                chance[c][y] -= 1.0
            last, label = 0, OUTSIDE
            for c, y in gold:  # the pairs of the true segmentation
                i, j = lattice.arcs[c]
                if i > last:
                    pairs[label][OUTSIDE] -= 1
                    pairs[OUTSIDE][OUTSIDE] -= i - last - 1
                    label = OUTSIDE
                pairs[label][y + 1] -= 1
                last, label = j, y + 1
            if last < len(lattice.places) - 1:
                pairs[label][OUTSIDE] -= 1
                pairs[OUTSIDE][OUTSIDE] -= len(lattice.places) - 2 - last
            slope: dict[str, list[float]] = {}
            for names, parts in zip(lattice.names, chance):
                if any(abs(v) > 1e-4 for v in parts):
                    for name in names:
                        s = slope.setdefault(name, [0.0] * len(KINDS))
                        for y, v in enumerate(parts):
                            s[y] += v
            for name, s in slope.items():
                w, g = field.weights.setdefault(name, [0.0] * len(KINDS)), seen.setdefault(name, [1e-8] * len(KINDS))
                for y, v in enumerate(s):
                    v += decay * w[y]
                    g[y] += v * v
                    w[y] -= rate * v / math.sqrt(g[y])
            for x in range(ys):
                for y in range(ys):
                    # Outside after outside is the measure of all others.
                    if (x, y) != (OUTSIDE, OUTSIDE):
                        v = pairs[x][y] + decay * field.follows[x][y]
                        if abs(v) > 1e-6:
                            seen_pairs[x][y] += v * v
                            field.follows[x][y] -= rate * v / math.sqrt(seen_pairs[x][y])
    return field


# --- training examples ---


def respelled(kind: str, span: str, rng: random.Random) -> str:
    """Another way to write the same thing that the base patterns do not know."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        local, host = span.split("@", 1)
        at = rng.choice([" (at) ", " [at] ", "(at)", " @ ", "[at]", " {at} "])
        return local + at + (host.replace(".", rng.choice([".", " [dot] ", "(dot)"])) if "a" in at else host)
    if kind == "ip":
        return span.replace(".", rng.choice(["[.]", " . ", "(.)", "-"]))
    if kind == "card":
        sign = rng.choice([".", "/", "_", " - "])
        return sign.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    country, rest = digits[:-10], digits[-10:]
    if len(rest) < 10:
        return digits
    area, a, b = rest[:3], rest[3:6], rest[6:]
    return rng.choice([f"({area}) {a}-{b}", f"{country} ({area}) {a}-{b}", f"{area}-{a}-{b}", f"{country}.{area}.{a}.{b}", f"+{country}/{area}/{a}/{b}", f"00{country} {area} {a} {b}"])


def harmless(rng: random.Random) -> str:
    """A number that is no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    day, month, year = rng.randrange(1, 29), rng.randrange(1, 13), rng.randrange(1900, 2100)
    unlucky = n(16)
    while luhn(unlucky):
        unlucky = n(16)
    return rng.choice([
        f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{month:02d}/{day:02d}/{year}", f"{year}-{year + 7}", f"{rng.randrange(20)}.{rng.randrange(400)}.{n(3)}", f"{n(3)},{n(3)},{n(3)}",
        f"{n(4)}.{n(2)}", n(6), n(7), n(9), n(12), unlucky, "-".join(unlucky[k : k + 4] for k in range(0, 16, 4)), f"{n(3)}.{rng.randrange(256, 999)}.{n(3)}.{rng.randrange(256, 999)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}",
        f"{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}", f"{n(5)}-{n(4)}", f"@{rng.choice(['home', 'work', 'night'])}", f"3 @ {n(2)}.{n(2)}",
    ])


def examples_of(text: str, seed: int) -> list[tuple[str, list[Span]]]:
    """The islands of a text as they are, and each once more with its spans respelled or replaced."""
    rng, out, spans = random.Random(seed), [], base_spans(text)
    for lo, hi in islands(text):
        inside = sorted(((k, a - lo, b - lo) for k, a, b in spans if lo <= a and b <= hi), key=lambda s: s[1])
        if any(x[2] > y[1] for x, y in zip(inside, inside[1:])) or any(a < hi and b > hi or a < lo < b for _, a, b in spans):
            continue
        piece = text[lo:hi]
        out.append((piece, inside))
        parts, gold, at, size = [], [], 0, 0
        for kind, a, b in inside:
            new, what = (respelled(kind, piece[a:b], rng), kind) if rng.random() < 0.6 else (harmless(rng), None)
            parts += [piece[at:a], new]
            size += a - at
            if what:
                gold.append((what, size, size + len(new)))
            size, at = size + len(new), b
        if inside:
            out.append(("".join(parts) + piece[at:], gold))
    return out


def training_rows(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(key, text) of at most ``rows`` distinct texts with a digit or an at sign: those of the least hash, the same at every run."""
    keyed = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("key"), "text")
    chosen = keyed.select("key").distinct().orderBy("key").limit(rows)
    return keyed.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"))


def fit_field(docs: DataFrame, rows: int = FIT_ROWS, per_text: int = FIT_ISLANDS) -> Field:
    """The field trained on a sample of ``docs(text)``: at most ``rows`` texts and the first ``per_text`` islands of each, cut out in the tasks.

    The driver gets those islands only, of bounded length. Without any example all weights are zero and nothing is added to the base spans.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["key"], batch["text"]):
                for n, (piece, gold) in enumerate(examples_of(text, int(key))[: 2 * per_text]):
                    if len(piece) <= 20 * MAX_CHARS:
                        out.append((key, n, piece, [f"{k}:{a}:{b}" for k, a, b in gold]))
            yield pd.DataFrame(out, columns=["key", "n", "piece", "gold"])

    found = training_rows(docs, rows).mapInPandas(cut, "key long, n int, piece string, gold array<string>").collect()
    found.sort(key=lambda r: (r["key"], r["n"]))
    return fit([(r["piece"], [(k, int(a), int(b)) for k, a, b in (g.split(":") for g in r["gold"])]) for r in found])


# --- use ---


def added_spans(field: Field, text: str, base: list[Span]) -> list[Span]:
    """What the field finds beside the base spans, none of it overlapping one."""
    out = []
    if _SIGNS.search(text) is None:
        return out
    taken = sorted((a, b) for _, a, b in base)
    for lo, hi in islands(text):
        lattice = lattice_of(text, lo, hi)
        if lattice is None:
            continue
        for k, y in decode(field, lattice):
            a, b = lattice.spans[k]
            if not any(x < b and a < z for x, z in taken):
                out.append((KINDS[y], a, b))
    return out


def find(field: Field, text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both by kind and start. NULL is the empty text."""
    base = base_spans(text or "")
    every = base + added_spans(field, text or "", base)
    every.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, every


def personal_spans(field: Field, docs: DataFrame, text: Column | str = "text") -> Column:
    """A column struct(base, spans), both arrays of struct(kind, start, end), for a text column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.follows))

    @F.pandas_udf("base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        model = Field(*shared.value)
        both = [find(model, t) for t in texts]
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return pd.DataFrame({"base": [named(b) for b, _ in both], "spans": [named(e) for _, e in both]})

    return found(F.col(text) if isinstance(text, str) else text)


def find_personal_data(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, base, spans) for each row of ``docs(doc_id, text)``, with a field trained on a sample of it.

    Offsets are code points of the whole text, ends exclusive. NULL and empty texts have no spans; rows that repeat get the same spans; an empty
    table gives an empty result; other columns are ignored.
    """
    field = fit_field(docs, rows)
    marked = docs.select("doc_id", personal_spans(field, docs).alias("found"))
    return marked.select("doc_id", "found.base", "found.spans")


def joined_spans(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(spans: Column | str, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
