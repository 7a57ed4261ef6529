"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and a span classifier is trained on the result.

One pass over the texts finds the base spans and further candidates and lets every labeler vote on each (yes, no, no opinion): regular
expressions for strict forms, gazetteers of names, domains, number prefixes and words for secrets, and context words.  Candidates are open: any
capitalised words behind a word that announces a name, and any long string that is assigned to something, whatever the lists know.  How often each pattern of votes and shapes
occurs is counted over all documents; only these counts, of bounded number, reach the driver.  There expectation-maximisation estimates
how reliable each labeler is without any labelled row, and a logistic classifier of votes and shapes is trained on the resulting
probabilities.  The classifier decides on the candidates; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows
from tessera.session import cut

KINDS = ("email", "ip", "card", "phone", "name", "national_id", "secret")
THRESHOLD = 0.9
#: Candidates that a labeler pattern must have before its counts stop being smoothed towards a fair coin.
PRIOR = 4.0

# Gazetteers and context words: fixed values.
DOMAINS = frozenset("com org net edu gov info biz io co uk de fr es it eu us ca au nl ch at be se no dk pl pt jp cn in br mx".split())
FIRST_NAMES = frozenset("""Alice Anna Antonio Barbara Carlos Carmen Charles Charlotte Christine Claire Daniel David Elena Elizabeth Emma Fernando Francois Frank George
Hans Helen Isabel Jack James Jane Jean Jennifer Jessica Johann John Jose Joseph Juan Julia Karen Karl Klaus Laura Linda Lisa Louis Luis Marco Maria Marie
Martin Mary Michael Michel Miguel Monica Nancy Olivia Patricia Paul Pedro Peter Philippe Pierre Richard Robert Sarah Sofia Stefan Susan Thomas Ursula
William Wolfgang""".split())
TITLES = frozenset("Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Don Dona Senor Senora".split())
CONTEXT = {
    "email": ("mail", "contact", "write", "courriel", "correo"), "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"), "phone": ("phone", "tel", "call", "fax", "mobile", "whatsapp"),
    "name": ("name", "dear", "mr", "mrs", "dr", "signed", "author", "sincerely", "regards", "attn", "patient", "employee", "customer", "nom", "nombre", "liebe", "lieber"),
    "national_id": ("ssn", "social", "national", "security", "id"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials"),
}
#: Words inside the name that a value is assigned to which tell of something else than a secret.
OPEN = ("hash", "sha", "md5", "checksum", "digest", "etag", "commit", "url", "path", "file", "class", "href", "src")
AGAINST = ("version", "isbn", "issn", "order", "section", "page", "figure", "table", "line", "chapter", "release")

_AT = re.compile(r"@")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}){1,5}", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAME = re.compile(r"(?<![^\W_])([A-Z][a-z]+)\.? ([A-Z][a-z]+)(?: ([A-Z][a-z]+))?(?![^\W_])")
_ANNOUNCED = re.compile(r"(?<![^\W_])(?i:" + "|".join(CONTEXT["name"]) + r")(?: is)?[.:,]? {1,2}(?=[A-Z])")
_CAPITALS = re.compile(r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[-'][^\W\d_]+)*(?: (?:[A-Z]\. )?[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:[-'][^\W\d_]+)*){1,2}(?![^\W_])")
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]{1,63})[\"']? ?(?:=>|:=|=|:) ?[\"']?(?!/)([A-Za-z0-9_+/=.~-]{16,})")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_WORD = re.compile(r"[A-Za-z]+")
_LOWER = re.compile(r"(?<![^\W_])[a-z]{2,}(?![^\W_])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and a dotted domain, found from each @ outwards in time linear in the text."""
    past = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > past and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        found = _DOMAIN.match(text, at + 1) if a < at else None
        if found:
            yield a, found.end()
            past = found.end()
        else:
            past = max(past, a if a == at else past)
        at = text.find("@", max(at + 1, past))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base kinds, code points, by start and then kind; failing matches are dropped without a second try."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _more(text: str) -> Iterator[tuple[int, int, int]]:
    """Candidates beyond the base."""
    if "at" in text or "AT" in text:
        for m in _SPELLED.finditer(text) if re.search(r"[\[(]at[\])]", text, re.I) else ():
            yield *m.span(), 0
    if _DIGIT.search(text):
        for m in _LOCAL_PHONE.finditer(text):
            yield *m.span(), 3
        for m in _SSN.finditer(text):
            yield *m.span(), 5
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            yield *m.span(2), 6
    seen = set()
    for m in _NAME.finditer(text):
        if m[1] in FIRST_NAMES or m[1] in TITLES:
            seen.add(m.start())
            yield *m.span(), 4
    for lead in _ANNOUNCED.finditer(text):
        m = _CAPITALS.match(text, lead.end())
        if m and m.start() not in seen:
            yield *m.span(), 4


def entropy(text: str) -> float:
    """Bits a character, from the frequencies of the characters of ``text``."""
    n = np.array(list(Counter(text).values()), float) / max(1, len(text))
    return float(-(n * np.log2(n)).sum())


LABELERS = ("form", "check", "gazetteer", "context", "edges")


def votes(text: str, start: int, end: int, kind: int, plain: frozenset[str] | set[str] = frozenset()) -> tuple[int, ...]:
    """What each labeler says of a candidate: 1 yes, -1 no, 0 no opinion.  ``plain`` are words that the text also has in lower case."""
    span, name = text[start:end], KINDS[kind]
    digits = "".join(_DIGIT.findall(span)) if kind != 0 else ""
    form = check = gazetteer = 0
    if name == "email":
        form = 1 if "@" in span and len(span) < 255 and ".." not in span and not span.startswith(".") else 0
        gazetteer = 1 if (_WORD.findall(span) or [""])[-1].lower() in DOMAINS else -1
    elif name == "ip":
        form = 1 if all(len(p) < 4 and (p == "0" or p[0] != "0") for p in span.split(".")) else -1
        check = 1 if all(map(_octet, span.split("."))) else -1
        gazetteer = 0 if digits[0] != "0" else -1
    elif name == "card":
        form = 1 if len(digits) in (14, 15, 16, 19) else 0
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif name == "phone":
        form = 1 if span[0] in "+(" else 0
        check = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = 0 if len(set(digits)) > 2 else -1
    elif name == "national_id":
        form = 1
        check = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    elif name == "secret":
        form = 0 if digits and any(c.isalpha() for c in span) else -1
        check = 1 if entropy(span) >= 3.0 else -1
        to = _WORD.findall(text[max(0, start - 72):start].lower())[-3:]
        gazetteer = 1 if any(w in CONTEXT[name] for w in to) else -1 if any(w in OPEN for w in to) else 0
    else:
        words = _WORD.findall(span)
        gazetteer = 1 if any(w in FIRST_NAMES for w in words) else 0
        common = any(w.lower() in plain for w in words)
        check = 1 if words and words[0] in TITLES else -1 if common or words and words[-1] in FIRST_NAMES and len(words) == 2 else 0
    near = _WORD.findall(text[max(0, start - 32):start].lower())[-4:]
    against = near[-1:] and (near[-1] in AGAINST or name == "secret" and near[-1] in OPEN)
    context = 1 if any(w in CONTEXT[name] for w in near) else -1 if against else 0
    before, after = text[start - 1:start], text[end:end + 1]
    # open candidates end at such edges by their making, which tells nothing
    edges = -1 if before.isalnum() or after.isalnum() else 0 if name in ("name", "secret") else 1
    return form, check, gazetteer, context, edges


def shape(text: str, start: int, end: int) -> int:
    """A small description of a span: bucket of its length, whether it holds separators, whether it begins its line."""
    size = min(3, (end - start) // 8)
    return size * 4 + 2 * any(c in " -()." for c in text[start:end]) + (start == 0 or text[start - 1] == "\n")


class Taken:
    """Stretches of a text that are covered, kept apart and in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def cover(self, a: int, b: int) -> None:
        lo, hi = bisect_right(self.ends, a), bisect_left(self.starts, b)
        if lo < hi:
            a, b = min(a, self.starts[lo]), max(b, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [a], [b]


CANDIDATE = "array<struct<start:int,end:int,kind:int,base:boolean,votes:array<int>,shape:int>>"


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans: base spans and further candidates of each whole text with the votes on them.  Null texts count as empty."""
    def work(rows):
        for k, t in rows:
            t = t or ""
            base = base_spans(t)
            taken = Taken()
            for a, b, _ in base:
                taken.cover(a, b)
            found = [(a, b, kind, True) for a, b, kind in base]
            found += [(a, b, kind, False) for a, b, kind in _more(t) if taken.free(a, b)]
            names = any(kind == 4 for _, _, kind, _ in found)
            plain = set(_LOWER.findall(t)) if names else frozenset()
            yield k, [{"start": a, "end": b, "kind": kind, "base": is_base, "votes": list(votes(t, a, b, kind, plain)), "shape": shape(t, a, b)}
                      for a, b, kind, is_base in found]

    return map_rows(docs.select(F.col(key).alias("key"), F.col(text)), f"key {docs.schema[key].dataType.simpleString()}, spans {CANDIDATE}", work)


class SpanModel:
    """Reliabilities of the labelers and the classifier, learned from counts of (kind, votes, shape)."""

    def __init__(self, counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 50):
        kinds = np.array([c[0] for c in counts], int)
        v = np.array([c[1] for c in counts], int).reshape(len(counts), len(LABELERS))
        n = np.array([c[3] for c in counts], float)
        self.right = np.full((len(LABELERS), 2), 0.8)  # chance that a labeler with an opinion is right on (no, yes) spans
        self.share = np.full(len(KINDS), 0.5)
        p = self._posterior(kinds, v) if len(counts) else np.zeros(0)
        for _ in range(rounds if len(counts) else 0):
            for k in range(len(KINDS)):
                at = kinds == k
                self.share[k] = ((n * p)[at].sum() + PRIOR / 2) / (n[at].sum() + PRIOR)
            for j in range(len(LABELERS)):
                yes, no = n * p * (v[:, j] != 0), n * (1 - p) * (v[:, j] != 0)
                self.right[j, 1] = ((yes * (v[:, j] > 0)).sum() + 0.8 * PRIOR) / (yes.sum() + PRIOR)
                self.right[j, 0] = ((no * (v[:, j] < 0)).sum() + 0.8 * PRIOR) / (no.sum() + PRIOR)
            # a labeler is taken to know more than a coin, which also tells yes from no
            self.right = self.right.clip(0.55, 0.999)
            self.share = self.share.clip(0.01, 0.99)
            p = self._posterior(kinds, v)
        self.weights = np.zeros(self._features(0, (0,) * len(LABELERS), 0).size)
        if len(counts):
            x = np.array([self._features(*c[:3]) for c in counts])
            w = n / n.sum()
            for _ in range(400):  # Newton would do; plain steps are enough for a few hundred rows
                s = 1 / (1 + np.exp(-(x @ self.weights).clip(-30, 30)))
                self.weights -= 2.0 * (x.T @ (w * (s - p)) + 1e-4 * self.weights)

    def _posterior(self, kinds: np.ndarray, v: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.share[kinds]), np.log(1 - self.share[kinds])
        for j, (rn, ry) in enumerate(self.right):
            yes = yes + np.where(v[:, j] > 0, np.log(ry), np.where(v[:, j] < 0, np.log(1 - ry), 0))
            no = no + np.where(v[:, j] < 0, np.log(rn), np.where(v[:, j] > 0, np.log(1 - rn), 0))
        return 1 / (1 + np.exp((no - yes).clip(-50, 50)))

    @staticmethod
    def _features(kind: int, v: tuple[int, ...], form: int) -> np.ndarray:
        out = np.zeros(1 + len(KINDS) + 2 * len(LABELERS) + 6)
        out[0] = 1
        out[1 + kind] = 1
        at = 1 + len(KINDS)
        for j, x in enumerate(v):
            out[at + 2 * j] = x > 0
            out[at + 2 * j + 1] = x < 0
        at += 2 * len(LABELERS)
        out[at + form // 4] = 1
        out[at + 4] = form // 2 % 2
        out[at + 5] = form % 2
        return out

    def probability(self, kind: int, v: tuple[int, ...], form: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self._features(kind, v, form) @ self.weights, -30, 30))))


def learn(spans: DataFrame) -> SpanModel:
    """Count the patterns over all candidates and estimate; at most kinds x 3^labelers x 16 counts reach the driver."""
    rows = (spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("kind", "votes", "shape").collect())
    return SpanModel([(r["kind"], tuple(r["votes"]), r["shape"], r["n"]) for r in rows])


def decide(spans: DataFrame, model: SpanModel, threshold: float = THRESHOLD) -> DataFrame:
    """key, found: base spans and the candidates that the classifier takes, as (start, end, kind name, base), by start and then kind.

    Of overlapping candidates the more probable stays, then the earlier, then the longer.
    """
    def work(rows):
        for k, items in rows:
            keep = [(s["start"], s["end"], s["kind"], True) for s in items if s["base"]]
            rest = [(model.probability(s["kind"], tuple(s["votes"]), s["shape"]), s) for s in items if not s["base"]]
            added, taken = [], Taken()
            for _, s in sorted((x for x in rest if x[0] >= threshold), key=lambda x: (-x[0], x[1]["start"], -x[1]["end"], x[1]["kind"])):
                if taken.free(s["start"], s["end"]):
                    taken.cover(s["start"], s["end"])
                    added.append((s["start"], s["end"], s["kind"], False))
            yield k, [{"start": a, "end": b, "kind": KINDS[kind], "base": base} for a, b, kind, base in sorted(keep + added, key=lambda s: (s[0], s[2], s[1]))]

    kind = spans.schema["key"].dataType.simpleString()
    return map_rows(spans, f"key {kind}, found array<struct<start:int,end:int,kind:string,base:boolean>>", work)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, found (array of start, end, kind, base; code points, end exclusive), one row per row.

    Null and empty texts have no spans.  Keys may be null or repeat, repeated rows are treated alike, and other columns are ignored.  Whole texts are read,
    whatever their length.  An empty table gives an empty result.
    """
    spans = cut(candidates(docs, key, text))
    return decide(spans, learn(spans), threshold).withColumnRenamed("key", key)


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of ``find``, n_spans; spans written as kind:start:end, comma-joined."""
    def work(rows):
        for k, found in rows:
            base = [s for s in found if s["base"]]
            told = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
            yield (k, *(sum(s["kind"] == kind for s in base) for kind in KINDS[:4]), hashlib.sha256(told.encode()).hexdigest(),
                   ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in found), len(found))

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(find(docs, key, text, threshold), f"{key} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", work)
