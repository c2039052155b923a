"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail and IP addresses, card and phone numbers; these spans always stand. Candidates are all runs of digits with their signs, cut where whole numbers touch, and all words with an at sign. A field over a document's candidates has a label for each (none, or one of the kinds), potentials from what the candidate and its surroundings look like, chain potentials between neighbours and skip potentials between distant candidates that are the same or similar (the same digits or last digits, the same first octets, the same address or name before the at sign). Candidates under a pattern's span are fixed to its kind; loopy message passing lets them pull the rest of the document to the same label: a number that was written once in full is found again without its country code.

All potentials are trained together, by the field's pseudo-likelihood: each candidate's label given its own looks and the labels of all its neighbours. Labels are the patterns' own. So that looks alone do not decide, a document with spans also gets, where it is read for training, one of them written again in part or with other signs (its label is the span's), or a number or address of that form which is not in the document (its label is none). Training reads whole documents in order of a hash of doc_id, MOST_DOCS of them at most and as many as have MOST_EXAMPLES candidates together. Inference covers every candidate of every document, whole.

A null or empty text has no spans. Positions count code points, end exclusive. Ties between labels go to none, then to the kind listed first. Rows that repeat are searched each; a null doc_id stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .labelled import chosen, fitting

KINDS = ("email", "ip", "card", "phone")
#: Documents that the potentials are learnt from at most, and candidates of them together, about.
MOST_DOCS, MOST_EXAMPLES = 20_000, 40_000
ROUNDS, DAMPING, AT_LEAST, STEPS = 10, 0.3, 0.5, 300
#: Bounds of learnt chain and skip potentials; what skip potentials are without examples: likes attract.
CHAIN_BOUND, SKIP_BOUND, LIKES = 1.0, 5.0, 2.0

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match cannot begin inside a run of digits: it would have begun at the run's first one.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
CANDIDATE = re.compile(r"(?P<mail>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*)|[+(]{0,3}[0-9](?:[\x20().-]{0,3}[0-9])*")
WORD = re.compile(r"[^\x20\x09-\x0D]+\Z")
GROUP = re.compile(r"[0-9]+")
N_FEATURES = 24 + 32


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every pattern's leftmost matches that pass its test."""
    out = []
    if not ANY.search(text):
        return out
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def numbers(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A run of digits and signs, cut where whole numbers touch: beside a space next to nine or more digits in one go, and, where there are too many digits for one number, after a card's."""
    out: list[tuple[int, int]] = []
    groups = [m.span() for m in GROUP.finditer(text, start, end)]
    many = sum(b - a for a, b in groups) > 19
    begin, digits, last = start, "", start
    for k, (a, b) in enumerate(groups):
        spaced = k > 0 and " " in text[groups[k - 1][1] : a]
        card = many and 13 <= len(digits) <= 19 and luhn(digits)
        if k and ((spaced and max(b - a, groups[k - 1][1] - groups[k - 1][0]) >= 9) or (spaced and (card or many and len(digits) + b - a > 19))):
            out.append((begin, last))
            begin, digits = a, ""
            while begin > last and text[begin - 1] in "+(":
                begin -= 1
        digits, last = digits + text[a:b], b
    return [*out, (begin, end)]


class Candidates:
    """The candidates of a text: spans, features, labels fixed by patterns (else -1), and edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]) -> None:
        found: list[tuple[int, int, bool]] = []
        for m in CANDIDATE.finditer(text):
            if m["mail"]:
                found.append((*m.span(), True))
            elif m.end() - m.start() >= 4:
                found += [(s, e, False) for s, e in numbers(text, *m.span()) if e - s >= 4]
        self.spans = [f[:2] for f in found]
        n = len(found)
        self.fixed = np.full(n, -1)
        starts = np.array([f[0] for f in found], np.int64)
        ends = np.array([f[1] for f in found], np.int64)
        for kind, s, e in base:
            self.fixed[(starts < e) & (ends > s)] = kind + 1
        self.x = np.zeros((n, N_FEATURES), np.uint8)
        seen: dict[tuple[str, str], int] = {}
        skips: set[tuple[int, int]] = set()
        for k, (begin, end, mail) in enumerate(found):
            s = text[begin:end]
            d = only_digits(s)
            before, after = text[max(0, begin - 24) : begin], text[end : end + 1]
            word = WORD.search(before.rstrip())
            glued = bool(before[-1:].strip()) and before[-1:] not in "\"'(<[:,;="
            local, _, domain = s.partition("@")
            look = (1, mail, mail and len(local) > 1, mail and "." in domain.strip("."), s.count(".") == 3, "+" in s, "(" in s, "-" in s, " " in s, glued, after.isalnum(), s[:1] == "0")
            sizes = [len(d) <= 3, 4 <= len(d) <= 6, len(d) == 7, 8 <= len(d) <= 9, 10 <= len(d) <= 12, 13 <= len(d) <= 19, len(d) > 19]
            self.x[k, : len(look)] = look
            self.x[k, 12:19] = sizes
            octets = s.split(".")
            self.x[k, 19:24] = (13 <= len(d) <= 19 and luhn(d), all(len(p) <= 3 for p in octets), d[:1] == "4", s.count(".") == 2, "." in s)
            self.x[k, 24 + (sum(map(ord, word[0].lower())) * 7 + len(word[0])) % 32 if word else 24] = 1
            keys = [("mail", s.lower().rstrip(".")), ("name", local.lower())] if mail else [("digits", d), ("last", d[-10:]), ("last7", d[-7:])]
            if not mail and len(octets) in (3, 4) and all(p.isdigit() for p in octets[:3]):
                keys.append(("octets", "octets " + ".".join(octets[:3])))
            for key in keys:
                if len(key[1]) >= (7 if key[0] in ("digits", "last", "last7") else 4):
                    if key in seen:
                        skips.add((seen[key], k))
                    seen[key] = k
        self.skips = sorted(skips)
        self.chain = [(k, k + 1) for k in range(n - 1) if self.spans[k + 1][0] - self.spans[k][1] <= 40]

    def beside(self, y: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
        """How many neighbours of each label each candidate has."""
        out = np.zeros((len(y), len(KINDS) + 1), np.float32)
        for i, j in pairs:
            out[i, y[j]] += 1
            out[j, y[i]] += 1
        return out


def again(kind: int, span: str, r: random.Random) -> str:
    """What a span may look like where it is written again, so that no pattern finds it."""
    d = only_digits(span)
    if kind == 0:
        name, _, host = span.partition("@")
        return r.choice((f"{name}@", f"{name}@{host.split('.')[0]}"))
    if kind == 1:
        return ".".join(span.split(".")[:3])
    if kind == 2:
        parts = [d[k : k + 4] for k in range(0, len(d), 4)]
        return r.choice((".".join(parts), "  ".join(parts), f"{parts[0]}.{d[4:]}"))
    own = d[-10:] if len(d) > 10 else d[-9:]
    return r.choice((f"({own[:-7]}) {own[-7:-4]}-{own[-4:]}", f"{own[:-7]}-{own[-7:-4]}-{own[-4:]}", f"{own[:-7]} {own[-7:-4]} {own[-4:]}", own, f"{own[-7:-4]}-{own[-4:]}"))


def other(span: str, r: random.Random) -> str:
    """Something of the same form that is not the same."""
    return "".join(r.choice("0123456789") if c.isdigit() else r.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in span)


def example(text: str, doc_id: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Features, labels and labels beside (along the chain, by skips) of a document's candidates, with one more where it has spans."""
    base = base_spans(text)
    r, kind, planted = random.Random(zlib.crc32(str(doc_id).encode())), -1, ""
    if base:
        kind, s, e = r.choice(base)
        planted = again(kind, text[s:e], r)
        if r.random() < 0.4:
            kind, planted = -1, other(planted, r)
        words = text[:400].split()
        lead = " ".join(w for w in r.sample(words, min(len(words), 8)) if not ANY.search(w))
        text = f"{text} {lead} {planted}"
        base = base_spans(text)
    c = Candidates(text, base)
    if not len(c.spans):
        return None
    y = np.maximum(c.fixed, 0)
    if kind >= 0 and c.spans[-1][1] == len(text) and c.fixed[-1] < 0:
        y[-1] = kind + 1
    return c.x, y, c.beside(y, c.chain), c.beside(y, c.skips)


class Field:
    """Potentials, and marginals by loopy message passing."""

    def __init__(self, w: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.w, self.chain, self.skip = w, chain, skip

    @staticmethod
    def loss(w: np.ndarray, chain: np.ndarray, skip: np.ndarray, x: np.ndarray, y: np.ndarray, by_chain: np.ndarray, by_skip: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Minus the mean log pseudo-likelihood, and its gradients by node, chain and skip potentials, the latter two symmetric."""
        z = x @ w + by_chain @ chain + by_skip @ skip
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        rows = np.arange(len(y))
        value = -float(np.log(np.maximum(p[rows, y], 1e-12)).mean())
        p[rows, y] -= 1
        gradients = [v.T @ p / len(y) for v in (x, by_chain, by_skip)]
        return value, [gradients[0], *((g + g.T) / 2 for g in gradients[1:])]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, by_chain: np.ndarray, by_skip: np.ndarray) -> Field:
        """All potentials together, by Adam; symmetric tables of edges stay within their bounds."""
        k = len(KINDS) + 1
        start = [np.zeros((N_FEATURES, k)), np.zeros((k, k)), LIKES * (2 * np.eye(k) - 1) / 2]
        theta, ridge = [v.copy() for v in start], (1e-4, 1e-4, 1e-4)
        m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
        for t in range(1, STEPS + 1 if len(y) else 1):
            _, gradients = Field.loss(*theta, x, y, by_chain, by_skip)
            for j, g in enumerate(gradients):
                g = g + ridge[j] * (theta[j] - start[j])
                m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.99 * v[j] + 0.01 * g * g
                theta[j] -= 0.1 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
            for j, bound in ((1, CHAIN_BOUND), (2, SKIP_BOUND)):
                theta[j] = np.clip((theta[j] + theta[j].T) / 2, -bound, bound)
        return Field(*theta)

    def marginals(self, c: Candidates) -> np.ndarray:
        k, n = len(KINDS) + 1, len(c.spans)
        node = c.x @ self.w
        for i in np.flatnonzero(c.fixed >= 0):
            node[i] = -30
            node[i, c.fixed[i]] = 0
        pairs = [*c.chain, *c.skips]
        if pairs:
            a, b = np.array(pairs).T
            tables = np.stack([self.chain] * len(c.chain) + [self.skip] * len(c.skips))
            source, target = np.concatenate((a, b)), np.concatenate((b, a))
            tables = np.concatenate((tables, tables))  # both are symmetric
            back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
            message = np.zeros((len(source), k))
            for _ in range(ROUNDS):
                belief = node.copy()
                np.add.at(belief, target, message)
                z = (belief[source] - message[back])[:, :, None] + tables
                top = z.max(1, keepdims=True)
                new = np.log(np.exp(z - top).sum(1)) + top[:, 0]
                message = DAMPING * message + (1 - DAMPING) * (new - new.max(1, keepdims=True))
            np.add.at(node, target, message)
        p = np.exp(node - node.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame) -> Field:
    """Potentials from the patterns' labels on a bounded sample of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, turn, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = t.as_py() or ""
                got = example(text, doc_id) if ANY.search(text) else None
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([turn]), pa.array([len(got[1])]), *(pa.array([v.astype(kind).tobytes()], pa.binary()) for v, kind in zip(got, (np.uint8, np.uint8, np.float32, np.float32)))], ["turn", "n", "x", "y", "chain", "skip"])

    sample = docs.select("doc_id", F.xxhash64(F.lit(10), "doc_id", "text").alias("turn"), "text").filter(chosen(MOST_DOCS, docs.count(), 9))
    held = written(sample.mapInArrow(run, "turn long, n long, x binary, y binary, chain binary, skip binary"), "pii-examples")
    sizes = [(r.turn, r.n) for r in held.select("turn", "n").collect()]  # MOST_DOCS rows, about, of two numbers
    turns = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in sorted(set(fitting(sizes, MOST_EXAMPLES)))], "turn long"))
    got = held.join(turns, "turn").dropDuplicates(["turn"]).orderBy("turn").collect()
    k = len(KINDS) + 1
    part = lambda name, kind, width: np.concatenate([np.frombuffer(r[name], kind) for r in got] or [np.zeros(0, kind)]).reshape(-1, width)
    x, y = part("x", np.uint8, N_FEATURES).astype(np.float32), part("y", np.uint8, 1)[:, 0].astype(np.int64)
    return Field.fit(x, y, part("chain", np.float32, k), part("skip", np.float32, k))


def spans_of(text: str, field: Field) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, found by a pattern) of a text, in order of kind and start."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if ANY.search(text):
        c = Candidates(text, base)
        if (c.fixed < 0).any():
            p = field.marginals(c)
            for i in np.flatnonzero((c.fixed < 0) & (p[:, 1:].max(1, initial=0) >= AT_LEAST)):
                out.append((int(p[i, 1:].argmax()), *c.spans[i], False))
    return sorted(out)


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base), in order of kind (as in KINDS) and start."""
    field = fit(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e, "base": sure} for k, s, e, sure in spans_of(t.as_py() or "", field)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def op6_pii(docs: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.base)

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return pii_spans(docs).select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
