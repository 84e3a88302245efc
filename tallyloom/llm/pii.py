"""Personal data: exact patterns first, then a skip-chain conditional random field.

Nodes of the field are the white-space tokens that hold a digit or an at sign.
Chain edges join tokens that stand side by side; skip edges join each token to
the last one before it of the same normal form, and of the same shape, however
far away. Loopy sum-product messages make repeated and similar tokens agree.
Token weights and edge potentials are learnt together, by pseudo-likelihood, on a bounded
sample that the exact patterns have labelled: each token is told from its own signs and
from its neighbours' labels, and the signs of a third of the tokens are hidden in turn, so
that the edges have to carry what the signs don't. Tokens that a failing match ran together
(two cards side by side, a phone number before an address) have no label and teach
nothing; these, and bare repeats of what stands in full elsewhere, are what the field adds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, drawn, table, texts

# The kinds of personal data and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SIGN = re.compile(r"[0-9@]")
DIGITS, LETTERS = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+")
LABELS = ("none", *KINDS)
BUCKETS = 4096
#: Signs of a token's own among its features, after the constant; what training hides.
SIGNS = 7
#: Digits of all tokens of an added span.
LEAST_DIGITS, MOST_DIGITS = {"card": 13, "phone": 7, "ip": 4}, {"card": 19, "phone": 15}

Span = tuple[str, int, int]


def digits_in(form: str) -> int:
    return sum(map(len, DIGITS.findall(form)))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find: leftmost, non-overlapping within a kind, failing matches dropped."""
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
            found.append(("phone", *m.span()))
    return found


def failing(text: str) -> list[tuple[int, int]]:
    """Where a pattern matched and its match was dropped."""
    good = {(k, s, e) for k, s, e in base_spans(text)}
    return [m.span() for kind, p in (("ip", IP), ("card", CARD), ("phone", PHONE)) for m in p.finditer(text) if (kind, *m.span()) not in good]


@dataclass
class Nodes:
    """Tokens with a digit or an at sign: spans, normal forms, shapes, and which stand side by side."""

    spans: list[tuple[int, int]]
    forms: list[str]
    shapes: list[str]
    beside: list[tuple[int, int]]


def nodes_of(text: str) -> Nodes:
    out, end = Nodes([], [], [], []), 0
    for m in SIGN.finditer(text):
        if m.start() < end:
            continue
        start, end = m.start(), m.end()
        while start and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        token = text[start:end]
        core = token.strip(".,;:!?%$#&*\"'|<>[]{}")
        a = start + token.find(core) if core else start
        if out.spans and a - out.spans[-1][1] <= 1:
            out.beside.append((len(out.spans) - 1, len(out.spans)))
        out.spans.append((a, a + len(core or token)))
        out.forms.append(core.lower())
        out.shapes.append(LETTERS.sub("a", DIGITS.sub("9", core))[:40])
    return out


def skip_edges(nodes: Nodes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Each node to the last one before it of the same form, else of the same shape: as many edges as nodes at most."""
    same, alike, by_form, by_shape = [], [], {}, {}
    for i, (form, shape) in enumerate(zip(nodes.forms, nodes.shapes, strict=True)):
        if (j := by_form.get(form)) is not None:
            same.append((j, i))
        elif (j := by_shape.get(shape)) is not None:
            alike.append((j, i))
        by_form[form] = by_shape[shape] = i
    return same, alike


def features(nodes: Nodes, i: int, beside: set[tuple[int, int]] | None = None) -> list[int]:
    """Hashed signs of a token: SIGNS of its own, the constant and two of its neighbours."""
    beside = set(nodes.beside) if beside is None else beside
    form, shape = nodes.forms[i], nodes.shapes[i]
    runs = DIGITS.findall(form)
    digits = sum(map(len, runs))
    check = 16 <= digits <= 19 and luhn("".join(runs))
    parts = len(runs) == 4 and shape == "9.9.9.9" and all(len(p) < 4 and int(p) <= 255 for p in runs)
    named = (
        f"shape {shape}", f"digits {min(digits, 24)}", f"length {min(len(form), 48) // 2}", f"dots {min(form.count('.'), 5)}", f"at {form.count('@')}",
        f"first {shape[:1]}", f"shape and digits {shape} {digits} {check} {parts}",
        f"before {nodes.shapes[i - 1] if (i - 1, i) in beside else '-'}", f"after {nodes.shapes[i + 1] if (i, i + 1) in beside else '-'}",
    )
    return [0, *(1 + zlib.crc32(x.encode()) % (BUCKETS - 1) for x in named)]


def meeting(nodes: Nodes, start: int, end: int) -> range:
    """The tokens that share a character with start .. end."""
    first = bisect_right(nodes.spans, start, key=lambda s: s[1])
    return range(first, bisect_right(nodes.spans, end - 1, lo=first, key=lambda s: s[0]))


def truth(nodes: Nodes, text: str) -> tuple[list[int], list[bool]]:
    """The patterns' label of each token, and whether it teaches: not where a failing match ran several tokens together."""
    labels, teaches = [0] * len(nodes.spans), [True] * len(nodes.spans)
    for s, e in failing(text):
        own = meeting(nodes, s, e)
        if len(own) > 1:
            for i in own:
                teaches[i] = False
    for kind, s, e in base_spans(text):
        for i in meeting(nodes, s, e):
            labels[i], teaches[i] = labels[i] or LABELS.index(kind), True
    return labels, teaches


@dataclass(frozen=True)
class Field:
    """unary: weights (features, labels); chain, same, alike: log potentials (labels, labels)."""

    unary: np.ndarray
    chain: np.ndarray
    same: np.ndarray
    alike: np.ndarray
    threshold: float = 0.9
    rounds: int = 12

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Label probabilities of each node after loopy message passing, damped by a half."""
        beside = set(nodes.beside)
        local = np.array([self.unary[features(nodes, i, beside)].sum(0) for i in range(len(nodes.spans))])
        same, alike = skip_edges(nodes)
        pairs = [*nodes.beside, *same, *alike]
        if pairs:
            a, b = np.array(pairs).T
            pot = np.concatenate([np.broadcast_to(p, (n, *p.shape)) for p, n in ((self.chain, len(nodes.beside)), (self.same, len(same)), (self.alike, len(alike)))])
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            pot, back = np.concatenate([pot, pot.transpose(0, 2, 1)]), np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            messages = np.zeros((len(src), len(LABELS)))
            for _ in range(self.rounds):
                belief = local.copy()
                np.add.at(belief, dst, messages)
                out = (belief[src] - messages[back])[:, :, None] + pot
                top = out.max(1)
                new = top + np.log(np.exp(out - top[:, None]).sum(1))
                new -= new.max(1, keepdims=True)
                if np.abs(new - messages).max() < 1e-4:
                    break
                messages = 0.5 * (messages + new)
            np.add.at(local, dst, messages)
        p = np.exp(local - local.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """The patterns' spans and those the field adds; an added span touches none of the former.

        Tokens of one label that stand side by side become one span as long as their digits are no more than a card or phone
        number has; a span with fewer than one has is none.
        """
        if not text:
            return [], []
        base = base_spans(text)
        nodes = nodes_of(text)
        if not nodes.spans:
            return base, []
        p = self.marginals(nodes)
        joined, added, open_, held = set(nodes.beside), [], None, 0
        taken = sorted((s, e) for _, s, e in base)
        k = 0
        for i, (a, b) in enumerate(nodes.spans):
            label = int(p[i].argmax())
            while k < len(taken) and taken[k][1] <= a and (k + 1 == len(taken) or taken[k + 1][0] < b):
                k += 1
            hit = any(s < b and a < e for s, e in taken[max(0, k - 3) : k + 4])
            if not label or p[i][label] < self.threshold or hit:
                open_ = None
            elif open_ == label and (i - 1, i) in joined and (held := held + digits_in(nodes.forms[i])) <= MOST_DIGITS.get(LABELS[label], 0):
                added[-1] = (LABELS[label], added[-1][1], b)
            else:
                added.append((LABELS[label], a, b))
                open_, held = label, digits_in(nodes.forms[i])
        return base, [(k, s, e) for k, s, e in added if digits_in(text[s:e]) >= LEAST_DIGITS.get(k, 0)]


def fit(docs: DataFrame, *, text: str = "text", sample_rows: int = 3000, **settings) -> Field:
    """A field fitted on at most `sample_rows` texts with a digit or at sign, of long ones a stretch of 65,536 characters."""
    return trained([r.t for r in drawn(docs.where(F.col(text).rlike("[0-9@]")), text, sample_rows)], **settings)


def trained(texts: list[str], *, rounds: int = 250, hidden: float = 1 / 3, decay: float = 1e-5, edge_decay: float = 1e-4, **settings) -> Field:
    """The field of greatest pseudo-likelihood: each token given its signs and its neighbours' labels."""
    index, labels, teach = [], [], []
    edges: list[list[tuple[int, int]]] = [[], [], []]
    for t in texts:
        nodes = nodes_of(t)
        own, teaches = truth(nodes, t)
        beside, at = set(nodes.beside), len(labels)
        index += [features(nodes, i, beside) for i in range(len(own))]
        labels += own
        teach += teaches
        for held, found in zip(edges, (nodes.beside, *skip_edges(nodes)), strict=True):
            held += [(a + at, b + at) for a, b in found if teaches[a] and teaches[b]]
    n = len(LABELS)
    weights, pots = np.zeros((BUCKETS + 1, n)), [np.zeros((n, n)) for _ in edges]
    if any(teach):
        every, y, use = np.array(index), np.array(labels), np.array(teach)
        ends = [np.array(e, dtype=np.int64).reshape(-1, 2).T for e in edges]
        goal, rng = np.eye(n)[y], np.random.default_rng(0)
        seen, seen_pots = np.full_like(weights, 1e-6), [np.full((n, n), 1e-6) for _ in edges]
        for _ in range(rounds):
            x = every.copy()
            x[rng.random(len(x)) < hidden, 1 : 1 + SIGNS] = BUCKETS  # a row that stays zero
            z = weights[x].sum(1)
            for (a, b), m in zip(ends, pots, strict=True):
                np.add.at(z, b, m[y[a]])
                np.add.at(z, a, m.T[y[b]])
            p = np.exp(z - z.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True) - goal) * use[:, None] / use.sum()
            grad = decay * weights
            np.add.at(grad, x.ravel(), np.repeat(p, x.shape[1], 0))
            grad[BUCKETS] = 0
            seen += grad**2
            weights -= 0.5 * grad / np.sqrt(seen)
            for k, (a, b) in enumerate(ends):
                grad = edge_decay * pots[k]
                np.add.at(grad, y[a], p[b])
                np.add.at(grad.T, y[b], p[a])
                seen_pots[k] += grad**2
                pots[k] -= 0.5 * grad / np.sqrt(seen_pots[k])
    return Field(weights, pots[0], (pots[1] + pots[1].T) / 2, (pots[2] + pots[2].T) / 2, **settings)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_pii(docs: DataFrame, field: Field, *, text: str = "text") -> DataFrame:
    """Add base_spans and added_spans, arrays of (kind, start, end) in code points, end exclusive.

    A null or empty text has none. Whole texts count, however long. Repeated rows
    give repeated results. Columns of the new names are replaced, others stay.
    """
    kind = "array<struct<kind:string,start:long,stop:long>>"

    def make():
        def work(batch):
            found = [field.spans(t) for t in texts(batch, text)]
            return [[[{"kind": k, "start": s, "stop": e} for k, s, e in sorted(f[i], key=lambda x: (KINDS.index(x[0]), x[1]))] for f in found] for i in range(2)]

        return work

    return arrow_map(docs, [("base_spans", kind), ("added_spans", kind)], make)


def redact(docs: DataFrame, field: Field, *, text: str = "text") -> DataFrame:
    """Replace each span by its kind in brackets; overlapping spans become one. A null text stays null."""

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        base, added = field.spans(t)
        out, end = [], 0
        for kind, s, e in sorted([*base, *added], key=lambda x: (x[1], -x[2])):
            if s >= end:
                out += [t[end:s], f"[{kind.upper()}]"]
            end = max(end, e)
        return "".join([*out, t[end:]])

    return arrow_map(docs, [(text, "string")], lambda: lambda batch: [[clean(t) for t in texts(batch, text)]])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    field = fit(docs)

    def make():
        def work(batch):
            out = []
            for t in texts(batch):
                base, added = field.spans(t)
                n = [sum(k == kind for k, *_ in base) for kind in KINDS]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *added]), len(added)))
            return [[o[i] for o in out] for i in range(7)]

        return work

    fields = [(f"n_{k}", "long") for k in KINDS] + [("base_sha256", "string"), ("spans", "string"), ("n_added", "long")]
    return arrow_map(docs, fields, make, drop=("text",))
