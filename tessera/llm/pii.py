"""Personal data by patterns and a skip-chain conditional random field.

The base spans are matches of four patterns with their checks.  The patterns are greedy, so entities that stand side by side
can fail together, and they know one way of writing each kind.  So candidates are gathered around them: numbers in
common groupings, and words that equal the name or the whole of an e-mail address found in the text, or have its name
before an @.  The candidates of a document, in order, are the variables of a conditional random field:

* unary potentials from the shape of a candidate and the word before it,
* chain potentials between neighbours, and
* skip potentials between candidates that repeat or resemble each other, however far apart.

Loopy message passing spreads the labels of base spans, which are observed, over all edges, so that an entity
keeps its label throughout the document.  Every document with an open candidate is scored; a candidate that ends with a
label at `sure` or more becomes a span.

All three kinds of weights are fitted together, by the pseudo-likelihood of a bounded sample.  Its labels are those of the base
spans, and `other` for candidates that no pattern takes, unless such a one resembles a base span or stands next to another
number: what these are is for the field to say, and they are left open.  Half of the labelled candidates, by a hash, are hidden,
half of these wholly and half but for their length and the word before, so that only neighbours and other mentions tell what they
are: the weights of skip edges are learnt from there and start at nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_OTHER = len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Common groupings of numbers: area code in brackets, after a plus, card groups, three-three-four, dotted fours, one run.
_LOOSE = re.compile(
    r"(?<![0-9])(?:\+?(?:[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}|[0-9]{4}(?:[ -][0-9]{4}){3}"
    r"|(?:[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{7,19})(?![0-9])"
)
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?![A-Za-z0-9.@-])")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches, found from each @: the name reaches back as far as it can, the domain on."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _NAME:
            low -= 1
        domain = _DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            yield "email", low, domain.end()
            done = domain.end()
        # a name has no @, so what precedes it is out of reach; keeps the walk back short
        done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """The matches of the four patterns that pass their checks, by start, then kind as listed."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = "".join(_DIGITS.findall(m[0]))
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@dataclass
class _Node:
    start: int
    end: int
    label: int | None  # of a base span, which is observed
    keys: list[str]
    features: list[str]
    allowed: str  # for each label 1 if the candidate can have it: no card fails its check digit, no address has parts over 255
    crowded: bool  # next to another number


def _node(text: str, s: int, e: int, label: int | None, names: set[str]) -> _Node:
    own = text[s:e]
    digits = "".join(_DIGITS.findall(own))
    if "@" in own or own.lower() in names or not digits:
        keys = [own.lower(), own.lower().partition("@")[0]]
    else:
        keys = [digits[-9:] if 9 <= len(digits) <= 11 else digits]
    parts = own.split(".")
    quad = len(parts) == 4 and all(p.isdigit() for p in parts)
    valid = quad and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    named = any(c.isalpha() for c in own)
    can = [named, valid, 12 <= len(digits) <= 19 and not named and luhn(digits), 7 <= len(digits) <= 15 and not named, True]
    shape = [
        f"digits {min(20, len(digits))}", f"luhn {luhn(digits)}" if 12 <= len(digits) <= 19 else "luhn -",
        f"quad {valid}" if quad else "quad -", f"mail {'@' in own}", f"domain {'.' in own.partition('@')[2]}",
        f"plus {own[0] == '+'}", "separators " + "".join(sorted({c for c in own if c in " .-()/"})), f"letters {named}",
        f"glued {text[s - 1 : s].isalnum() or text[e : e + 1].isalnum()}",
    ]
    before = _TOKEN.findall(text, max(0, s - 40), s)[-1:]
    crowded = bool(re.search(r"[0-9)][ .-]{1,2}$", text[max(0, s - 3) : s]) or re.match(r"[ .-]{1,2}[0-9(+]", text[e : e + 3]))
    return _Node(s, e, label, keys, [*shape, "shape " + " ".join(x.rpartition(" ")[2] for x in shape), f"before {before[0].lower()[:12] if before else ''}"], "".join("01"[x or i == label] for i, x in enumerate(can)), crowded)


def _nodes(text: str, base: list[Span]) -> list[_Node]:
    """The candidates of a document, in order; those that no base pattern takes overlap none of its spans."""
    taken = sorted((s, e) for _, s, e in base)
    found: dict[tuple[int, int], int | None] = {(s, e): KINDS.index(k) for k, s, e in reversed(base)}
    names = {n.lower() for k, s, e in base if k == "email" for n in (text[s:e], text[s:e].partition("@")[0]) if len(n) >= 5}
    loose: list[tuple[int, int]] = []
    if _DIGITS.search(text):
        loose += [m.span() for m in _LOOSE.finditer(text)]
    if names:
        loose += [m.span() for m in _MAIL.finditer(text) if m[0].partition("@")[0].lower() in names]
        for m in _TOKEN.finditer(text):
            word = m[0].strip(".,;:!?()[]<>\"'")
            if word.lower() in names:
                at = m.start() + m[0].index(word)
                loose.append((at, at + len(word)))
    i, done = 0, 0
    for s, e in sorted(loose):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= done and not any(x < e and s < y for x, y in taken[i : i + 8]):
            found.setdefault((s, e), None)
            done = e
    return [_node(text, s, e, label, names) for (s, e), label in sorted(found.items())]


def _skips(nodes: list[_Node]) -> list[tuple[int, int]]:
    """Edges from each candidate to the one before with the same key and to the first observed one: few per candidate, however often it repeats."""
    last: dict[str, int] = {}
    seen: dict[str, int] = {}
    out = set()
    for i, n in enumerate(nodes):
        for k in n.keys:
            for other in (last.get(k), seen.get(k)):
                if other is not None and other != i:
                    out.add((other, i))
            last[k] = i
            if n.label is not None:
                seen.setdefault(k, i)
    return sorted(out)


@dataclass
class Model:
    """unary: scores of the labels for a feature; chain, skip: scores of pairs of labels (log)."""

    unary: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray


def marginals(model: Model, nodes: list[_Node], skips: list[tuple[int, int]], rounds: int = 30) -> np.ndarray:
    """Beliefs of the labels of each candidate by loopy message passing, damped; exact where the edges form no loop."""
    k = _OTHER + 1
    none = np.zeros(k)
    unary = np.array([sum((model.unary.get(f, none) for f in n.features), none) for n in nodes]).reshape(-1, k)
    for i, n in enumerate(nodes):
        unary[i, [x == "0" for x in n.allowed] if n.label is None else [x != n.label for x in range(k)]] = -50.0
    n_chain = max(0, len(nodes) - 1)
    belief = unary
    if n_chain or skips:
        edges = np.array([(i, i + 1) for i in range(n_chain)] + skips, np.int64).reshape(-1, 2)
        m = len(edges)
        a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        # messages along chain edges, along skip edges, and both ways back
        cuts = [(0, n_chain, np.exp(model.chain)), (n_chain, m, np.exp(model.skip)), (m, m + n_chain, np.exp(model.chain).T), (m + n_chain, 2 * m, np.exp(model.skip).T)]
        messages = np.zeros((2 * m, k))
        for _ in range(max(rounds, min(len(nodes), 200)) + 1):
            out = belief[a] - messages[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.concatenate([out[x:y] @ p for x, y, p in cuts])
            new = np.log(new + 1e-30)
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - messages).max(initial=0)
            messages = new if not skips else 0.3 * messages + 0.7 * new
            belief = unary.copy()
            np.add.at(belief, b, messages)
            if moved < 1e-4:
                break
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def spans(text: str, model: Model, sure: float = 0.95) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and all of them with what the field adds."""
    base = base_spans(text)
    nodes = _nodes(text, base)
    open_ = [i for i, n in enumerate(nodes) if n.label is None]
    if not open_:  # nothing to decide
        return base, base
    p = marginals(model, nodes, _skips(nodes))
    added = [(KINDS[int(p[i].argmax())], nodes[i].start, nodes[i].end) for i in open_ if p[i].argmax() != _OTHER and p[i].max() >= sure]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _labels(nodes: list[_Node], skips: list[tuple[int, int]]) -> list[int | None]:
    """What each candidate is taken for in training; None where that is left open."""
    near = {i for a, b in skips for i, j in ((a, b), (b, a)) if nodes[j].label is not None}
    return [n.label if n.label is not None else None if i in near or n.crowded else _OTHER for i, n in enumerate(nodes)]


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the field is fitted on: for each labelled candidate its features, the labels around it and at its skip edges, and how often."""
    for b in batches:
        counts: Counter = Counter()
        for t in b.column("text"):
            text = t.as_py() or ""
            nodes = _nodes(text, base_spans(text))
            skips = _skips(nodes)
            label = _labels(nodes, skips)
            linked = [[0] * (_OTHER + 1) for _ in nodes]
            for x, y in skips:
                for i, j in ((x, y), (y, x)):
                    if label[j] is not None:
                        linked[i][label[j]] += 1
            for i, n in enumerate(nodes):
                if label[i] is None:
                    continue
                hidden = zlib.crc32(f"{i} {n.keys[0]}".encode()) % 4
                # 1: shows the word before it and how many digits it has, 2: shows nothing
                features = {1: [n.features[0], n.features[-1]], 2: ["hidden"]}.get(hidden, n.features)
                hidden = hidden in (1, 2)
                around = [label[j] if 0 <= j < len(nodes) else None for j in (i - 1, i + 1)]
                counts["\t".join(features), "11111" if hidden else n.allowed, *(-1 if x is None else x for x in around), ",".join(map(str, linked[i])), label[i]] += 1
        keys = list(counts)
        kinds = {"f": pa.string(), "allowed": pa.string(), "before": pa.int32(), "after": pa.int32(), "linked": pa.string(), "y": pa.int32()}
        columns = {c: pa.array([key[at] for key in keys], kind) for at, (c, kind) in enumerate(kinds.items())}
        yield pa.RecordBatch.from_pydict(columns | {"n": pa.array(list(counts.values()), pa.int64())})


def objective(u: np.ndarray, c: np.ndarray, s: np.ndarray, data: _Data) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The penalised negative log pseudo-likelihood and its gradients by unary, chain and skip weights."""
    z = data.barred.copy()
    np.add.at(z, data.rows, u[data.cols])
    has_before, has_after = np.flatnonzero(data.before >= 0), np.flatnonzero(data.after >= 0)
    z[has_before] += c[data.before[has_before]]
    z[has_after] += c.T[data.after[has_after]]
    z += data.linked @ s
    top = z.max(axis=1, keepdims=True)
    p = np.exp(z - top)
    total = p.sum(axis=1, keepdims=True)
    p /= total
    at = np.arange(len(data.y))
    loss = -(data.n * (z[at, data.y] - top[:, 0] - np.log(total[:, 0]))).sum()
    p[at, data.y] -= 1
    p *= data.n[:, None]
    du, dc = np.zeros_like(u), np.zeros_like(c)
    np.add.at(du, data.cols, p[data.rows])
    np.add.at(dc, data.before[has_before], p[has_before])
    back = np.zeros_like(c)
    np.add.at(back, data.after[has_after], p[has_after])
    ds = data.linked.T @ p
    loss += 0.05 * (u * u).sum() + 0.5 * (c * c).sum() + 0.05 * (s * s).sum()
    return loss, du + 0.1 * u, dc + back.T + c, ds + 0.1 * s


@dataclass
class _Data:
    rows: np.ndarray  # of each feature that is set: the row
    cols: np.ndarray  # and the feature
    barred: np.ndarray  # for each label 0, or -50 where the candidate cannot have it
    before: np.ndarray  # label of the candidate before, -1: none or open
    after: np.ndarray
    linked: np.ndarray  # labels at skip edges, counted
    y: np.ndarray
    n: np.ndarray


def fitted(observed: list, steps: int = 300) -> Model:
    """The field of largest penalised pseudo-likelihood over rows (f, allowed, before, after, linked, y, n), by AdaGrad."""
    k = _OTHER + 1
    names: dict[str, int] = {}
    sets = [[names.setdefault(f, len(names)) for f in r.f.split("\t")] for r in observed]
    data = _Data(
        np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.array([f for x in sets for f in x], np.int64),
        np.array([[0.0 if x == "1" else -50.0 for x in r.allowed] for r in observed]).reshape(-1, k), np.array([r.before for r in observed], np.int64), np.array([r.after for r in observed], np.int64),
        np.array([[float(v) for v in r.linked.split(",")] for r in observed]).reshape(-1, k), np.array([r.y for r in observed], np.int64), np.array([r.n for r in observed], float),
    )
    weights = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros((k, k))]
    moved = [np.zeros_like(w) for w in weights]
    for _ in range(steps if observed else 0):
        _, *grads = objective(*weights, data)
        for w, m, g in zip(weights, moved, grads, strict=True):
            m += g * g
            w -= 0.3 * g / (np.sqrt(m) + 1e-8)
        weights[2] = (weights[2] + weights[2].T) / 2  # a skip edge has no direction
    return Model({f: weights[0][i] for f, i in names.items()}, weights[1], weights[2])


def train(docs: DataFrame, sample: int = 20000, shapes: int = 50000) -> Model:
    """A field fitted on about `sample` documents, those with the smallest hashes of doc_id, as the `shapes` commonest rows of _observed sum them up.

    Documents that share a doc_id are in or out together; only sums come to the driver.  Without any candidate in the sample all weights
    are 0, and the field adds nothing.
    """
    hashed = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text")
    bound = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = hashed.where(F.col("h") <= F.lit(bound)).select("text").mapInArrow(_observed, "f string, allowed string, before int, after int, linked string, y int, n long")
    by = ["f", "allowed", "before", "after", "linked", "y"]
    return fitted(rows.groupBy(*by).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), *by).limit(shapes).collect())


def _joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def found_spans(docs: DataFrame, model: Model, sure: float = 0.95) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, base_sha256 and spans of each document.

    Counts and base are of the base spans, spans of all: kind:start:end in code points, end exclusive, by start, then kind, comma-joined.
    A null or empty text has none; a text of any length is searched whole, in time and memory in proportion to it.  Repeated rows
    have a row each; other columns, of whatever name, are ignored.  An empty table gives an empty table.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = defaultdict(list)
            for t in b.column("text"):
                base, every = spans(t.as_py() or "", model, sure)
                kinds = Counter(k for k, _, _ in base)
                for k in KINDS:
                    out[f"n_{k}"].append(kinds[k])
                out["base"].append(_joined(base))
                out["base_sha256"].append(hashlib.sha256(out["base"][-1].encode()).hexdigest())
                out["spans"].append(_joined(every))
            types = {k: pa.string() for k in ("base", "base_sha256", "spans")}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {k: pa.array(out[k], types.get(k, pa.int64())) for k in (*(f"n_{k}" for k in KINDS), *types)})

    columns = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, columns)


def redacted(docs: DataFrame, model: Model, sure: float = 0.95) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; overlapping spans go as one, under the first's kind.

    A null text stays null.  Rows, repeated ones too, and other columns stay as they are.
    """

    @F.pandas_udf("string")
    def mask(texts):  # noqa: ANN001, ANN202  a Series to a Series
        def one(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            for k, s, e in spans(text, model, sure)[1]:
                if s >= at:
                    out += [text[at:s], f"<{k.upper()}>"]
                at = max(at, e)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", mask("text"))
