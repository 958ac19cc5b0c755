"""Personal data and secrets: high-recall candidates, boosted trees, calibrated thresholds.

Four base kinds are found by fixed formats (see ``base_spans``).  Beyond them, candidate
generators propose overlapping spans (values after key words, prefixed keys, long mixed
strings, spelled-out addresses, grouped numbers); gradient-boosted trees score each by its
format and its context, and the spans that reach their kind's threshold and overlap no
base span are added, best first.

The trees are fitted on a seeded synthetic set, made by rules of formats and look-alikes
(``examples``; bounded by N_EXAMPLES), and the thresholds are the least ones that reach
PRECISION on a second one.  Neither depends on the documents.

Cases: null and empty texts have no spans (the digest of no bytes).  Values are taken whole,
however long, in time linear in the text.  Offsets are code
points of the whole text, ends exclusive.  Rows are treated one by one, so repeated rows
and repeated or null doc_ids each give their own row.  Ties in score go to the earlier,
then the longer span.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "secret", "id")
N_EXAMPLES = 6000
PRECISION = 0.995
TREES, DEPTH, RATE = 60, 3, 0.2

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TURN = re.compile(r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping within each kind."""
    out = []
    at = text.find("@")
    last = 0
    while at >= 0:  # the match that holds this @ starts with its run of local characters
        s = at
        while s > last and _LOCAL.match(text[s - 1]):
            s -= 1
        m = _EMAIL.match(text, s) if s < at else None
        if m:
            out.append((s, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


_WORDS = {
    "secret": "password passwd pwd pass secret token key apikey api_key access_key auth bearer credential private",
    "id": "ssn social security iban account passport licence license tax national identity routing",
    "phone": "phone tel telephone call mobile cell fax contact",
    "email": "mail email e-mail contact write reach address",
}
#: Words of a key, the sign after it, and the value.
_KEY = re.compile(r"(?i)pass|pwd|secret|token|key|auth|bearer|credential")
_SIGN = re.compile(r"[=:]")
_VALUE = re.compile(r"\s{0,2}[\"']?(?P<v>[A-Za-z0-9_./+=-]{8,}+)")
_CONTEXT = {k: re.compile(r"(?i)(?<![a-z])(?:" + "|".join(map(re.escape, v.split())) + r")(?![a-z])") for k, v in _WORDS.items()}

#: (kind, cheap test, pattern): high recall; the span is the group "v".  No pattern may look at a
#: run of characters again from each of its places: runs begin where the character before is of
#: another kind, and are taken whole.
GENERATORS = (
    ("secret", re.compile(r"[A-Z][A-Z0-9]{3}[A-Z0-9]{12}"), re.compile(r"(?<![A-Za-z0-9])(?P<v>[A-Z]{4}[A-Z0-9]{16})(?![A-Za-z0-9])")),
    ("secret", re.compile(r"[0-9a-fA-F]{24}|[A-Za-z0-9_]{24}"), re.compile(r"(?<![A-Za-z0-9_-])(?P<v>[A-Za-z0-9_-]{24,}+)")),
    ("id", re.compile(r"[0-9]-[0-9]"), re.compile(r"(?<![0-9-])(?P<v>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")),
    ("id", re.compile(r"[A-Z]{2}[0-9]{2}"), re.compile(r"(?<![A-Za-z0-9])(?P<v>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("phone", re.compile(r"[0-9]{3}[-. )]"), re.compile(r"(?<![0-9.+-])(?P<v>\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4})(?![0-9-])")),
    ("email", re.compile(r"(?i)[\[( ]at[\]) ]"), re.compile(r"(?i)(?<![a-z0-9._%+-])(?P<v>[a-z0-9._%+-]{1,64}+ ?[\[(]? ?at ?[\])]? ?[a-z0-9-]{1,63} ?[\[(]? ?dot ?[\])]? ?[a-z]{2,10})(?![a-z])")),
)


def keyed(text: str) -> list[tuple[int, int]]:
    """Values after a key word and a sign, at most two white spaces beside the sign."""
    out: list[tuple[int, int]] = []
    if not _KEY.search(text):
        return out
    last = 0
    for m in _SIGN.finditer(text):
        at = m.start()
        if at < last:
            continue
        end = at
        while end > max(at - 2, 0) and text[end - 1].isspace():
            end -= 1
        start = end
        while start > last and (text[start - 1].isalpha() and text[start - 1].isascii() or text[start - 1] in "_-"):
            start -= 1
        if start < end and _KEY.search(text, start, end):
            v = _VALUE.match(text, at + 1)
            if v:
                out.append(v.span("v"))
                last = v.end()
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    out = {(a, b, "secret") for a, b in keyed(text)}
    for kind, cheap, pattern in GENERATORS:
        if cheap.search(text):
            out.update((m.start("v"), m.end("v"), kind) for m in pattern.finditer(text))
    return sorted(out)


def describe(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context features of a candidate."""
    v, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 16]
    n = len(v)
    counts = {c: v.count(c) for c in set(v)}
    digits, upper, lower = (sum(k for c, k in counts.items() if f(c)) for f in (str.isdigit, str.isupper, str.islower))
    hexa = sum(k for c, k in counts.items() if c in "0123456789abcdefABCDEF")
    turns = len(_TURN.findall(v))
    return [
        KINDS.index(kind), n, digits / n, upper / n, lower / n, hexa / n, turns / n, -sum(c / n * math.log2(c / n) for c in counts.values()), sum(counts.get(c, 0) for c in "-_. ") / n,
        *(bool(p.search(before)) for p in _CONTEXT.values()), bool(re.search(r"[=:]\s*[\"']?$", before)), before[-1:] in "\"'", after[:1] in "\"'", before[-1:].isalnum(), v[:4].isupper() and v[:1].isalpha(), bool(re.search(r"(?i)at", v)) and "dot" in v.lower(), bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", v)) and v[:3] not in ("000", "666") and v[:1] != "9",
    ]


def examples(seed: int, n: int = N_EXAMPLES) -> list[tuple[str, int, int, str, int]]:
    """Synthetic (text, start, end, kind, truth): each kind's formats and its look-alikes."""
    r = random.Random(seed)
    syllables = "the an er in on re st nd es or ti le de en que os ción ung sch ver eau ment ra lo".split()

    def word() -> str:
        return "".join(r.choices(syllables, k=r.randint(1, 4)))

    def some(alphabet: str, k: int) -> str:
        return "".join(r.choices(alphabet, k=k))

    up, low, dig = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexs = dig + "abcdef"

    def make() -> tuple[str, str, str, str, int]:
        kind = r.choice(["secret"] * 4 + ["id", "id", "phone", "email"])
        quote = r.choice(["", "", '"', "'"])
        good = r.random() < 0.5
        if kind == "secret":
            lead = r.choice(_WORDS["secret"].split()) + r.choice(["=", " = ", ": ", ":"]) + quote
            if good:
                v = r.choice([some(hexs, r.choice([16, 18, 20, 24, 32, 40, 64])), some(up + low + dig, r.randint(12, 44)), r.choice(["AKIA", "ASIA", "AGPA"]) + some(up + dig, 16), some(low + dig, 10)])
                return ("" if v[:4].isupper() and len(v) == 20 and r.random() < 0.7 else lead), v, quote, kind, 1
            v = r.choice([lambda: "".join(word() for _ in range(6)).encode("ascii", "ignore").decode()[:60].ljust(8, "a"), lambda: some("-_", 30), lambda: word().encode("ascii", "ignore").decode().ljust(8, "e"), lambda: some(up, 20), lambda: "_".join([some(low, 6)] * 4), lambda: "-".join([some(low, 7) for _ in range(4)]), lambda: some(dig, 24), lambda: some(low, 30)])()
            return (lead if r.random() < 0.3 else word() + r.choice([" ", ": ", "=", "/"])), v, "", kind, 0
        if kind == "id":
            if good:
                v = r.choice([lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", lambda: some(up, 2) + some(dig, 20)])()
                return r.choice(_WORDS["id"].split()) + r.choice([": ", " ", " is "]), v, "", kind, 1
            v = r.choice([lambda: f"{r.choice(['000', '666', '912', '987'])}-{r.randint(0, 99):02d}-{r.randint(0, 9999):04d}", lambda: f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", lambda: some(up, 2) + some(dig, 2) + some(up, 12)])()
            return word() + r.choice([" no. ", " ", " part "]), v, "", kind, 0
        if kind == "phone":
            v = r.choice(["{}-{}-{}", "({}) {}-{}", "{}.{}.{}", "{} {} {}"]).format(r.randint(200, 989), r.randint(200, 999), f"{r.randint(0, 9999):04d}")
            if good:
                return r.choice(_WORDS["phone"].split()) + r.choice([": ", " ", " me at "]), v, "", kind, 1
            return word() + r.choice([" version ", " rows ", " ", " item "]), v, "", kind, 0
        name, host = some(low, r.randint(3, 9)), some(low, r.randint(4, 9))
        if good:
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)")])
            return r.choice(_WORDS["email"].split()) + r.choice([": ", " me: ", " "]), f"{name}{at}{host}{dot}{r.choice(['com', 'org', 'net', 'de'])}", "", kind, 1
        return word() + " ", f"{name} at {host} dot {some(low, 5)}", "", kind, 0

    out = []
    while len(out) < n:
        lead, v, tail, kind, truth = make()
        text = " ".join(word() for _ in range(r.randint(0, 6))) + " " + lead
        whole = text + v + tail + " " + " ".join(word() for _ in range(r.randint(0, 6)))
        out.append((whole, len(text), len(text) + len(v), kind, truth))
    return out


class Trees:
    """Boosted regression trees on binned features, with logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        b = self._bins(x)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        z, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree: list[tuple] = []
            step = np.zeros(len(y))
            self._grow(b, y - p, p * (1 - p), np.arange(len(y)), 0, tree, step)
            self.trees.append(tree)
            z += step

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(self.cuts)], axis=1)

    def _grow(self, b, g, h, rows, depth, tree, step) -> int:
        me = len(tree)
        tree.append(())
        total, weight = g[rows].sum(), h[rows].sum()
        best = (1e-6, 0, 0)
        if depth < DEPTH and len(rows) > 20:
            for i in range(b.shape[1]):
                cg, ch = (np.cumsum(np.bincount(b[rows, i], w[rows], 34))[:-1] for w in (g, h))
                gain = cg**2 / (ch + 1) + (total - cg) ** 2 / (weight - ch + 1) - total**2 / (weight + 1)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), i, k))
        if best[0] > 1e-6:
            _, i, k = best
            left = b[rows, i] <= k
            tree[me] = (i, k, self._grow(b, g, h, rows[left], depth + 1, tree, step), self._grow(b, g, h, rows[~left], depth + 1, tree, step))
        else:
            tree[me] = (RATE * total / (weight + 1),)
            step[rows] = tree[me][0]
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        z = np.full(len(x), self.base)
        for tree in self.trees:
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if len(tree[node]) == 1:
                    z[rows] += tree[node][0]
                elif len(rows):
                    i, k, left, right = tree[node]
                    low = b[rows, i] <= k
                    todo += [(left, rows[low]), (right, rows[~low])]
        return 1 / (1 + np.exp(-z))


@lru_cache(1)
def model() -> tuple[Trees, dict[str, float]]:
    """The trees and the least threshold of each kind that reaches PRECISION on fresh examples."""

    def table(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = examples(seed)
        return np.array([describe(*e[:4]) for e in rows], dtype=float), np.array([e[4] for e in rows], dtype=float), np.array([e[3] for e in rows])

    x, y, _ = table(1)
    trees = Trees(x, y)
    x, y, kinds = table(2)
    s = trees.score(x)
    least = {}
    for k in set(kinds):
        own = np.argsort(-s[kinds == k], kind="stable")
        right = np.cumsum(y[kinds == k][own]) / np.arange(1, len(own) + 1)
        ok = np.flatnonzero(right >= PRECISION)
        least[str(k)] = max(0.5, float(s[kinds == k][own][ok[-1]])) if len(ok) else 2.0
    return trees, least


def measured(seed: int = 3) -> dict[str, tuple[float, float]]:
    """(recall, precision) of each kind of added span, on examples of their own."""
    rows = examples(seed)
    found = spans([e[0] for e in rows])[1]
    out = {}
    for kind in ("secret", "id", "phone", "email"):
        own = [(e, (e[1], e[2]) in {(a, b) for a, b, _ in f}) for e, f in zip(rows, found, strict=True) if e[3] == kind]
        right, wrong, all_ = sum(ok for e, ok in own if e[4]), sum(ok for e, ok in own if not e[4]), sum(e[4] for e, _ in own)
        out[kind] = (right / max(all_, 1), right / max(right + wrong, 1))
    return out


def spans(texts: list[str]) -> tuple[list[list], list[list]]:
    """(base spans, all spans) of each text."""
    trees, least = model()
    base = [base_spans(t) for t in texts]
    found = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
    more: list[list] = [[] for _ in texts]
    if found:
        s = trees.score(np.array([describe(texts[i], a, b, k) for i, a, b, k in found], dtype=float))
        for q, (i, a, b, k) in sorted(zip(s, found, strict=True), key=lambda x: (-x[0], x[1][1], -x[1][2])):
            if q >= least.get(k, 2):
                more[i].append((a, b, k))
    out = []
    for own, extra in zip(base, more, strict=True):
        taken = _Taken((a, b) for a, b, _ in own)
        kept = list(own)
        for a, b, k in extra:
            if taken.add(a, b):
                kept.append((a, b, k))
        out.append(sorted(kept, key=lambda x: (x[0], KINDS.index(x[2]))))
    return base, out


class _Taken:
    """Covered ranges, merged; add() takes a range if it overlaps none."""

    def __init__(self, ranges):
        self.starts, self.ends = [], []
        for a, b in sorted(ranges):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        if i and self.ends[i - 1] > a:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def _joined(own: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in own)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, row for row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                base, all_ = spans([t or "" for t in batch.column("text").to_pylist()])
                n = [pa.array([sum(k == x for _, _, k in b) for b in base], pa.int64()) for x in KINDS[:4]]
                digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n, digest, pa.array([_joined(x) for x in all_], pa.string()), pa.array([len(x) - len(b) for x, b in zip(all_, base, strict=True)], pa.int64()), pa.array(list(map(len, all_)), pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by <kind>; null texts stay null."""

    def scan(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for t, own in zip(texts, spans([t or "" for t in texts])[1], strict=True):
                parts, at = [], 0
                for a, b, k in own:
                    if a >= at:
                        parts += [t[at:a], f"<{k}>"]
                    at = max(at, b)
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(scan, docs.schema)
