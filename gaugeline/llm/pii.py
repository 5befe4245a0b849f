"""Personal data: fixed rules, and candidate spans judged by boosted trees.

Generators with a high recall propose overlapping spans around signs of an address or a number.
Trees boosted on the logistic loss judge them by their format and by the text around them. Their
examples are the finds of the fixed rules, rewritten where they stand so that no rule finds them any
more (no leading plus, other separators, "(at)" for "@"). Counter-examples are candidates that are
clearly something else: wrong check digits, dates, amounts, plain numbers, parts of words, the other
kinds; some stand in the text, some are written in the place of a find. Other candidates that no rule
finds are not learnt from, only judged. Thresholds for each kind are set on examples held back from
training. Spans of the rules always stay; judged ones are added where they overlap no other.

Defined results: a null text counts as empty and has no spans; rows are judged one by one, so
repeated rows, ties and null ids give a row each; without examples of a kind nothing of that kind is
added; other columns pass through where a function says so. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.text import give_back
from gaugeline.session import settle

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, str, int]  # start, kind, end

#: Candidates a model is fitted on at most, chosen by a hash of text and place.
MOST_CANDIDATES = 60_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9 ().+-]++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TO_DIGITS = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


#: What numbers hold beside digits.
_BETWEEN = " ().+-/\u00a0\u2010\u2011\u2012\u2013"


def _within(runs: re.Pattern, text: str, first: str) -> list[tuple[int, int]]:
    """In each run of characters, from the first one of `first` to the last digit; each is read once."""
    out = []
    for m in runs.finditer(text):
        run = m.group()
        end = len(run.rstrip(_BETWEEN))
        start = next((i for i, c in enumerate(run) if c in first), end)
        if start + 1 < end:
            out.append((m.start() + start, m.start() + end))
    return out


def _numbers(text: str) -> list[tuple[int, int]]:
    return _within(_NUMBERS, text, "+0123456789") if _DIGIT.search(text) else []


def rule_spans(text: str, numbers: list[tuple[int, int]] | None = None) -> list[Span]:
    """Spans of the fixed rules, by start and then kind as listed; each part is scanned once."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, "email", end))
        at = text.find("@", at + 1)
    for start, stop in _numbers(text) if numbers is None else numbers:
        part = text[start:stop]
        for m in _DOTTED.finditer(part):
            parts, place = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k:k + 4]
                size = sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                    found.append((start + place, "ip", start + place + size))
                place += size + 1
        for m in _CARD.finditer(part):
            digits = _TO_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((start + m.start(), "card", start + m.end()))
        for m in _PHONE.finditer(part):
            if 9 <= len(_TO_DIGITS.sub("", m.group())) <= 15:
                found.append((start + m.start(), "phone", start + m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[0], order[s[1]], s[2]))


_ENDS = frozenset("<>()[],;:\"'")
_WORDY = re.compile(r"[^\s<>()\[\],;:\"']+")
#: Signs that stand for "@" and for dots, and numbers with any usual separators.
_MARK = re.compile(r" ?[(\[{] ?(?:at|@) ?[)\]}] ?| @ ?|@ | at (?=[a-z0-9-]{1,63}(?: dot |[.][a-z]))", re.I)
_HOST = re.compile(
    r"[^\W_][\w-]{0,62}(?:(?: ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot |\.)[^\W_][\w-]{0,62}){1,8}", re.I)
_QUAD = re.compile(
    r"(?<![0-9])[0-9]{1,3}(?:(?: ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot | \. |\.)[0-9]{1,3}){3}(?![0-9])", re.I)
_LOOSE = re.compile("[0-9 ().+/\u00a0\u2010-\u2013-]++")
_GROUPED = re.compile(r"[0-9().+-]++")
_SPACED = re.compile("[^ \u00a0]+")
#: Digits of the kinds of numbers: the least and the most a candidate has. No number has more than all.
_DIGITS = {"ip": (4, 12), "card": (11, 20), "phone": (7, 16)}
_MOST_DIGITS = 20


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data; far more than there are."""
    found: set[Span] = set()
    end, at = 0, text.find("@")
    while at >= 0:
        # The stretch around the sign, which ends at blanks, brackets and quotes; each is read once.
        start = at
        while start > end and text[start - 1] not in _ENDS and not text[start - 1].isspace():
            start -= 1
        end = _WORDY.match(text, start).end()
        last = end
        while last > at + 1 and not text[last - 1].isalnum():
            last -= 1
        found.update(((start, "email", end), (start, "email", last)))
        at = text.find("@", end)
    for mark in _MARK.finditer(text):
        start = mark.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, mark.end())
        if start < mark.start() and host:
            found.add((start, "email", host.end()))
    if not _DIGIT.search(text):
        return sorted(found)
    found.update((m.start(), "ip", m.end()) for m in _QUAD.finditer(text))
    for start, stop in _within(_LOOSE, text, "+0123456789"):
        if start and text[start - 1] == "(":
            start -= 1
        run = text[start:stop]
        spans = {(start, stop)} | {(start + a, start + b) for a, b in _within(_GROUPED, run, "(+0123456789")}
        groups = [(start + m.start(), start + m.end()) for m in _SPACED.finditer(run)]
        counts = [sum(c in "0123456789" for c in text[a:b]) for a, b in groups]
        full = [i for i, n in enumerate(counts) if n]
        for k, i in enumerate(full):
            begins = [groups[i][0]]
            if i and not counts[i - 1] and text[groups[i - 1][0]] in "+(":
                begins.append(groups[i - 1][0])
            digits = 0
            for j in full[k:]:
                digits += counts[j]
                if digits > _MOST_DIGITS:
                    break
                b = groups[j][1]
                spans.update((a, b) for a in begins if text[a] in "+(0123456789" and text[b - 1].isdigit())
        for a, b in spans:
            part = text[a:b]
            digits = sum(map(part.count, "0123456789"))
            for kind, (least, most) in _DIGITS.items():
                if least <= digits <= most and (kind != "ip" or part.count(".") >= 2):
                    found.add((a, kind, b))
    return sorted(found)


_DATE = re.compile(
    r"(?:(?:1[5-9]|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:1[5-9]|20)[0-9]{2})"
    "(?:[ -]+[0-9]{1,4}.*)?")
_AMOUNT = re.compile(
    r"[0-9]+(?:[.][0-9]+)?|[0-9]{1,3}(?:([. \u00a0])[0-9]{3})(?:\1[0-9]{3})*"
    r"|(?:1[5-9]|20)[0-9]{2} ?[-\u2013/] ?(?:1[5-9]|20)[0-9]{2}")
_BOOK = re.compile(r"97[89]([- ])[0-9]{1,5}\1[0-9]{1,7}\1[0-9]{1,7}\1[0-9]")


def clearly_other(text: str, span: Span) -> bool:
    """Whether a candidate can't be personal data of its kind, whatever its separators."""
    a, kind, b = span
    part, digits = text[a:b], _TO_DIGITS.sub("", text[a:b])
    if kind == "email":
        tail = re.split(r"[\s.()\[\]{}@]+", part.rstrip(".)]}"))[-1]
        return not ("." in part or "dot" in part.lower()) or not tail[:1].isalpha() or part[:1] == "@"
    if text[a - 1:a].isalnum() or text[b:b + 1].isalnum():
        return True
    if kind == "card":
        return not (12 <= len(digits) <= 19 and _luhn(digits))
    if kind == "ip":
        fours = [x for x in _TO_DIGITS.split(part) if x]
        return len(fours) != 4 or any(int(x) > 255 for x in fours)
    if not 7 <= len(digits) <= 15 or _DATE.fullmatch(part) or _BOOK.fullmatch(part):
        return True
    # A plain number behind a word for telephones stays open.
    return bool(_AMOUNT.fullmatch(part)) and not any(h.search(text[max(a - 24, 0):a]) for h in _HINTS[3:])


def varied(part: str, kind: str, draw: random.Random, hinted: bool) -> str:
    """A find of a rule in a form that the rules don't know."""
    digits = _TO_DIGITS.sub("", part)
    if kind == "email":
        local, _, host = part.partition("@")
        sign = draw.choice([" (at) ", "(at)", " [at] ", "[at]", " {at} ", " at ", " @ ", " [@] ", " (AT) "])
        dot = draw.choice([" dot ", "."] if sign == " at " else [".", ".", " (dot) ", "(dot)", " [dot] ", "[.]"])
        return local + sign + host.replace(".", dot)
    if kind == "ip":
        return part.replace(".", draw.choice(["[.]", "(.)", " [.] ", " . ", "[dot]", " (dot) ", "{.}", " dot "]))
    if kind == "card":
        sep = draw.choice([".", "/", "  ", " - ", "\u00a0", "\u2013", "--", ". "])
        size = draw.choice([4, 4, 4, 5])
        return sep.join(digits[i:i + size] for i in range(0, len(digits), size))
    country, own = ("", digits) if len(digits) <= 10 else (digits[:-10], digits[-10:])
    if hinted and draw.random() < 0.3:
        return digits
    a, b, c = own[:-7], own[-7:-4], own[-4:]
    a = a or country or "0"
    sep = draw.choice(["-", ".", " ", "/", "\u2013", "\u00a0", " - "])
    start = draw.choice(["", "", f"{country}{sep}", f"00{country}{sep}"]) if country else ""
    plain = f"{a}{sep}{b}{sep}{c}"
    pairs = plain if start or len(own) != 10 else sep.join(own[i:i + 2] for i in range(0, 10, 2))
    local = draw.choice([plain, plain, plain, pairs, f"({a}) {b}{sep}{c}", f"({a}){sep}{b}{sep}{c}",
                         f"{a}{sep}{b}{sep}{c[:2]}{sep}{c[2:]}"])
    return start + local


def counter(part: str, kind: str, draw: random.Random) -> str:
    """Something that clearly is not of this kind, to stand where a find stood."""
    number = lambda n: str(draw.randrange(10 ** (n - 1), 10 ** n))
    year, month, day = str(draw.randrange(1900, 2100)), f"{draw.randrange(1, 13):02}", f"{draw.randrange(1, 29):02}"
    if kind == "email":
        return draw.choice([f"@{part.partition('@')[0]}", f"{draw.randrange(2, 90)} @ {number(1)}.{number(2)}",
                            part.split("@")[0] + f" (at) {number(2)}.{number(2)}",
                            part.split("@")[0] + "@" + part.split("@")[1].split(".")[0]])
    if kind == "ip":
        return draw.choice([".", "[.]", " . "]).join(number(3) for _ in range(3)) + f".{draw.randrange(256, 999)}"
    if kind == "card":
        digits = _TO_DIGITS.sub("", part)
        digits = digits[:-1] + str((int(digits[-1]) + draw.randrange(1, 10)) % 10)
        sep = draw.choice(["", ".", "/", "  ", "-", " ", "\u00a0"])
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    sep = draw.choice("-./ ")
    return draw.choice([
        sep.join((year, month, day)), sep.join((day, month, year)), f"{year}-{month}-{day} {number(4)}",
        number(draw.randrange(7, 17)), number(draw.randrange(7, 17)), f"{number(6)}.{number(2)}",
        f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
        draw.choice(". ").join((number(draw.randrange(1, 4)), number(3), number(3))),
        f"{year}{draw.choice(['-', ' - ', '/'])}{draw.randrange(1900, 2100)}"])


_HINTS = tuple(re.compile(p, re.I) for p in (
    r"mail|contact|write", r"\bip\b|host|server|addr", r"card|visa|credit|pay|account",
    r"tel|phone|call|mobile|fax"))


_DOTS = re.compile(r" ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot |\.", re.I)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span, as numbers."""
    a, kind, b = span
    part, before, after = text[a:b], text[max(a - 24, 0):a], text[b:b + 8]
    runs = [len(x) for x in _TO_DIGITS.split(part) if x] or [0]
    digits, letters = sum(runs), sum(c.isalpha() for c in part)
    at = part.find("@")
    # Signs that stand for a dot end a part of an address too.
    tail = _DOTS.split(part)[-1]
    near, next_ = before.rstrip()[-1:], after.lstrip()[:1]
    side = lambda c: (0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalnum() else 3.0)
    return [
        *(float(kind == k) for k in KINDS), len(part), digits, letters, len(runs), max(runs), min(runs),
        runs[0], runs[-1], part.count(" "), part.count("-"), part.count("."), part.count("("),
        part.count("+"), float(part[:1] == "+"), float(at), part.count("@"),
        float(len(tail)) if letters else 0.0, float(tail.isalpha()), len(set(part)) / len(part),
        float(part[:1] in "3456"), float(12 <= digits <= 19 and _luhn(_TO_DIGITS.sub("", part))), side(before[-1:]), side(after[:1]),
        *(float(bool(h.search(before))) for h in _HINTS),
        float(near.isdigit()), float(next_.isdigit()), part.count("/"), float(bool(_MARK.search(part))),
        float(bool(_QUAD.fullmatch(part)) and all(int(x) <= 255 for x in _TO_DIGITS.split(part) if x)),
        float(bool(_DATE.fullmatch(part))), float(bool(_AMOUNT.fullmatch(part))), float(len(_DOTS.findall(part))),
    ]


@dataclass(frozen=True)
class Model:
    """Trees as arrays of (feature, cut, left, right, value), and the least probability by kind."""

    base: float
    trees: tuple
    least: dict[str, float]

    def total(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                go = np.flatnonzero(feature[at] >= 0)
                if not len(go):
                    break
                node = at[go]
                at[go] = np.where(x[go, feature[node]] <= cut[node], left[node], right[node])
            total += value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.total(x), -30, 30)))


def _tree(bins: np.ndarray, cuts: list, slope: np.ndarray, curve: np.ndarray, depth: int, rate: float,
          least_curve: float = 1.0, shrink: float = 1.0):
    """One tree on gradients; splits by the gain of second-order boosting over binned features."""
    feature, cut, left, right, value = [], [], [], [], []

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        g, h = slope[rows].sum(), curve[rows].sum()
        for part, x in zip((feature, cut, left, right, value), (-1, 0.0, 0, 0, rate * g / (h + shrink))):
            part.append(x)
        best = (1e-6, -1, 0)
        if level < depth:
            for f, edges in enumerate(cuts):
                if len(edges):
                    gl = np.cumsum(np.bincount(bins[rows, f], slope[rows], len(edges) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins[rows, f], curve[rows], len(edges) + 1))[:-1]
                    gain = gl ** 2 / (hl + shrink) + (g - gl) ** 2 / (h - hl + shrink) - g * g / (h + shrink)
                    gain[(hl < least_curve) | (h - hl < least_curve)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            low = bins[rows, f] <= k
            feature[me], cut[me] = f, float(cuts[f][k])
            left[me] = grow(rows[low], level + 1)
            right[me] = grow(rows[~low], level + 1)
        return me

    grow(np.arange(len(bins)), 0)
    return tuple(np.array(p) for p in (feature, cut, left, right, value))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
            most_bins: int = 32) -> tuple[float, tuple]:
    """Base value and trees of gradient boosting on the logistic loss."""
    cuts = []
    for f in range(x.shape[1]):
        seen = np.unique(x[:, f])
        middle = (seen[1:] + seen[:-1]) / 2
        if len(middle) > most_bins:
            middle = np.unique(np.quantile(x[:, f], np.linspace(0, 1, most_bins + 1)[1:-1]))
        cuts.append(middle)
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    total, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree = _tree(bins, cuts, y - p, p * (1 - p), depth, rate)
        out.append(tree)
        total += Model(0.0, (tree,), {}).total(x)
    return base, tuple(out)


def _proposed(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the rules, and all candidates."""
    numbers = _numbers(text)
    if not numbers and "@" not in text and not _MARK.search(text):
        return [], []
    return rule_spans(text, numbers), candidates(text)


#: Examples, and counter-examples, written in the place of each find.
_VARIANTS = 8


class Taken:
    """Spans by where they lie, so that a span is compared with those beside it only."""

    def __init__(self, spans: Iterable[Span] = ()):
        self._by_place: dict[int, list[Span]] = {}
        for s in spans:
            self.add(s)

    def add(self, s: Span) -> None:
        for place in range(s[0] >> 8, (s[2] - 1 >> 8) + 1):
            self._by_place.setdefault(place, []).append(s)

    def touches(self, s: Span) -> bool:
        return any(s[0] < r[2] and r[0] < s[2] for place in range(s[0] >> 8, (s[2] - 1 >> 8) + 1)
                   for r in self._by_place.get(place, ()))


def examples(text: str) -> Iterator[tuple[str, Span, int, str]]:
    """(text, span, label, find) to learn from: rewritten finds, what stands in their place, clear
    others. `find` is the text that an example was made from."""
    rules, spans = _proposed(text)
    taken = Taken(rules)
    for s in spans:
        if not taken.touches(s) and clearly_other(text, s):
            yield text, s, 0, text[s[0]:s[2]]
    for a, kind, b in rules:
        find, before, after = text[a:b], text[max(a - 48, 0):a], text[b:b + 32]
        draw = random.Random(before + find + after)
        hinted = any(h.search(before[-24:]) for h in _HINTS[3:])
        for label in (1, 0):
            for _ in range(_VARIANTS):
                form = (varied(find, kind, draw, hinted) if label else counter(find, kind, draw))
                # Another number behind it is no part of it.
                own = before + form + (f" {draw.randrange(2, 400)}" if draw.random() < 0.2 else "") + after
                place = (len(before), kind, len(before) + len(form))
                again, proposed = rule_spans(own), candidates(own)
                if Taken(again).touches(place):
                    continue  # a rule finds it, or something beside it, in this form too
                for s in proposed:
                    if s == place:
                        if label or clearly_other(own, s):
                            yield own, s, label, find
                    elif s[0] < place[2] and place[0] < s[2] and (label or clearly_other(own, s)):
                        yield own, s, 0, find  # cut, too long or of another kind


#: Examples a task writes at once.
_AT_ONCE = 4_096


def _hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "little", signed=True)


def candidate_table(df: DataFrame, text: str = "text") -> DataFrame:
    """(mark, find, kind, label, x) of all examples of every whole text: hashes of an example with what
    is around it, and of the find it was made from."""
    own = df.select(F.col(f"`{text}`").cast("string").alias("body"))
    schema = "mark long, find long, kind string, label int, x array<double>"

    def rows(batches):
        out: list[tuple] = []

        def written() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["mark", "find", "kind", "label", "x"])
            out.clear()
            return batch

        for batch in batches:
            for body in batch.column(0):
                for own, s, y, find in examples(body.as_py() or ""):
                    near = own[max(s[0] - 48, 0):s[2] + 32]
                    out.append((_hashed(f"{s[1]} {y} {s[2] - s[0]} {near}"), _hashed(find), s[1], y, features(own, s)))
                    if len(out) >= _AT_ONCE:
                        yield written()
            if out:
                yield written()
            give_back()

    return own.mapInArrow(rows, schema)


#: One find of so many is held back from the fit with all its rewritings; thresholds are set on them.
HELD_BACK = 5
#: Steps of the probabilities that the examples are counted by.
_CELLS = 1_000


def train(df: DataFrame, text: str = "text", precision: float = 0.98,
          most_candidates: int = MOST_CANDIDATES) -> Model:
    """A model from the examples of all texts, fitted on a bounded part of them by hash.

    Each kind has an equal share of `most_candidates`, equal examples count once in the fit, and finds
    are held back whole. The thresholds come from all held-back examples of all texts, copies too,
    counted by kind and probability; of a kind without any held back, from those of the fit.
    """
    table = settle(candidate_table(df, text))
    sizes = {r.kind: r.n for r in table.groupBy("kind").agg(F.approx_count_distinct("mark").alias("n")).collect()}
    back = F.pmod("find", F.lit(HELD_BACK)) == 0
    drawn = F.lit(False)
    for kind, n in sizes.items():
        part = min(1.0, most_candidates / len(KINDS) / n)
        drawn = drawn | (F.col("kind") == kind) & (F.pmod("mark", F.lit(1 << 30)) < int((1 << 30) * part))
    rows = (table.where(drawn).groupBy("mark", "kind", "label", back.alias("back"))
            .agg(F.any_value("x").alias("x")).collect())
    never = {k: np.inf for k in KINDS}
    rows.sort(key=lambda r: (r.mark, r.kind, r.label, r.back))
    own = [r for r in rows if not r.back]
    own = own if len({r.label for r in own}) == 2 else rows
    if len({r.label for r in own}) < 2:
        return Model(0.0, (), never)
    base, trees = boosted(np.array([r.x for r in own], float), np.array([r.label for r in own], float))
    model = Model(base, trees, never)

    def scored(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                cell = np.minimum(model.probability(x) * _CELLS, _CELLS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(cell)], names=["kind", "label", "back", "cell"])

    counts = (
        table.select("kind", "label", back.alias("back"), "x")
        .mapInArrow(scored, "kind string, label int, back boolean, cell int")
        .groupBy("kind", "label", "back", "cell").agg(F.count(F.lit(1)).alias("n")).collect())
    return Model(base, trees, {k: _least([r for r in counts if r.kind == k], precision) for k in KINDS})


def _least(counts: Sequence, precision: float) -> float:
    """The least probability from which on examples of a kind are right often enough."""
    held = [r for r in counts if r.back]
    counts = held if any(r.label for r in held) else counts
    good, bad = np.zeros(_CELLS), np.zeros(_CELLS)
    for r in counts:
        (good if r.label else bad)[r.cell] += r.n
    upto, wrong = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    enough = np.flatnonzero((upto > 0) & (upto >= precision * (upto + wrong)))
    return max(0.5, enough[0] / _CELLS) if len(enough) else np.inf


def judged_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(spans of the rules, all spans); the likeliest candidate of those that overlap wins."""
    rules, spans = _proposed(text)
    taken, found = Taken(rules), list(rules)
    spans = [s for s in spans if not taken.touches(s)]
    if spans and model.trees:
        p = model.probability(np.array([features(text, s) for s in spans], float))
        for i in np.argsort(-p, kind="stable").tolist():
            s = spans[i]
            if p[i] >= model.least[s[1]] and not taken.touches(s):
                taken.add(s)
                found.append(s)
    order = {k: i for i, k in enumerate(KINDS)}
    return rules, sorted(found, key=lambda s: (s[0], order[s[1]], s[2]))


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def find_spans(df: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_email, n_ip, n_card, n_phone (of the rules), `rule_spans` and `spans`."""
    names = [f"k{i}" for i in range(len(keep))]
    own = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)],
                    F.col(f"`{text}`").cast("string").alias("body"))
    schema = T.StructType([*own.schema.fields[:-1], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           T.StructField("rule_spans", T.StringType()), T.StructField("spans", T.StringType())])

    def rows(batches):
        for batch in batches:
            found = [judged_spans(x.as_py() or "", model) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1],
                *[pa.array([sum(s[1] == k for s in r) for r, _ in found], pa.int64()) for k in KINDS],
                pa.array([written(r) for r, _ in found], pa.string()),
                pa.array([written(s) for _, s in found], pa.string())], names=schema.names)

    return own.mapInArrow(rows, schema).withColumnsRenamed(dict(zip(names, keep)))


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns as they are, with every span in the text replaced by its kind in brackets."""
    at = df.columns.index(text)
    names = [f"k{i}" for i in range(len(df.columns))]
    own = df.toDF(*names)
    schema = own.schema

    def clean(body: str | None) -> str | None:
        if not body:
            return body
        out, end = [], 0
        for a, kind, b in judged_spans(body, model)[1]:
            if a >= end:
                out += [body[end:a], f"[{kind.upper()}]"]
            end = max(end, b)
        return "".join([*out, body[end:]])

    def rows(batches):
        for batch in batches:
            column = pa.array([clean(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [column if i == at else c for i, c in enumerate(batch.columns)], names=names)
            give_back()

    return own.mapInArrow(rows, schema).toDF(*df.columns)
