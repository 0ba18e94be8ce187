r"""Personal data: fixed patterns and a skip-chain conditional random field.

The base spans are those of four patterns with their checks. The field then labels the tokens that
hold a digit, an at sign or a plus (all others are outside by construction): O, email, ip, card or
phone. Its potentials are
  - features of a token's shape and neighbours,
  - an edge between tokens that stand next to each other,
  - a skip edge from each token to the next one with the same or a similar name, however distant. A
    token's name is its digits if there are SIMILAR of them, else its core in lower case; names of
    digits are similar if they are equal but for one digit, however long.
Loopy sum-product message passing over both kinds of edges, first along all edges at once and then
in sweeps over the tokens, there and back, until the messages settle, makes the labels of a
document's repeated entities agree.
Tokens whose marginal reaches ADD_AT and that touch no base span are added, neighbours of one label
as one span unless one of them is an entity by itself; base spans always stay.

Weights are trained by pseudo-likelihood against the base spans of a bounded sample of documents
(SAMPLE_DOCS, SAMPLE_CHARS), those of least hash in the whole table; only training is bounded, and
the choice doesn't depend on how the rows are laid out.

Repeated tokens are linked to the next occurrence only, so edges grow with the text and not with
the square of a group. Patterns are run so that no text makes them quadratic.

Defined results: a null text counts as empty; an empty table trains nothing and gives no rows;
repeated rows are scanned one by one; other columns pass through unless their names are those of
the results."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import hash_sample, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 12_000_000
ADD_AT = 0.9
SIMILAR = 6
#: Rounds along all edges at once, and sweeps that may follow until no message changes by more than
#: SETTLED. A sweep crosses the whole document, so few are needed; the later ones are damped.
ROUNDS, SWEEPS, FREE_SWEEPS = 8, 60, 6
DAMPING = 0.3
SETTLED = 1e-6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
# A digit run that follows a digit can only repeat a failure of the run's own beginning.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@+]")
_TOKEN = re.compile(r"\S+")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern. Its local part is the whole run before an at sign, as the
    sign itself is no character of a local part, so runs are looked up from the signs."""
    free = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield begin, free
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base spans, sorted."""
    if not _MARK.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """The white-space tokens that hold a digit, an at sign or a plus."""
    out: list[tuple[int, int]] = []
    end = 0
    m = _MARK.search(text)
    while m:
        begin = m.start()
        while begin > end and not text[begin - 1].isspace():
            begin -= 1
        end = _TOKEN.match(text, begin).end()
        out.append((begin, end))
        m = _MARK.search(text, end)
    return out


#: Words that announce an entity.
_HINTS = {
    **dict.fromkeys(("email", "mail", "e-mail", "contact", "write"), "mail"),
    **dict.fromkeys(("tel", "phone", "call", "fax", "mobile", "telefon", "teléfono", "téléphone"), "phone"),
    **dict.fromkeys(("card", "visa", "mastercard", "amex", "karte", "tarjeta", "carte"), "card"),
    **dict.fromkeys(("ip", "host", "server", "address", "adresse"), "ip"),
}
_NAMES = (
    ["bias", "at", "at_dot", "plus", "parenthesis", "dash", "letters", "upper", "luhn", "octets", "equals", "slash"]
    + [f"digits{i}" for i in range(7)]
    + [f"dots{i}" for i in range(5)]
    + [f"{side}_{h}" for side in ("before", "after") for h in ("mail", "phone", "card", "ip", "token")]
)
_INDEX = {name: i for i, name in enumerate(_NAMES)}
_DIGIT_STEPS = (1, 4, 7, 9, 12, 20)
_EDGE = ".,;:!?\"'*$%&#|<>[]{}"


def features(core: str, digits: str, before: str, after: str) -> list[int]:
    names = ["bias", f"digits{sum(len(digits) >= s for s in _DIGIT_STEPS)}", f"dots{min(4, core.count('.'))}"]
    tail = core.rpartition("@")[2] if "@" in core else ""
    for name, true in (
        ("at", bool(tail) or "@" in core),
        ("at_dot", "." in tail),
        ("plus", core.startswith("+")),
        ("parenthesis", "(" in core),
        ("dash", "-" in core),
        ("letters", any(c.isalpha() for c in core)),
        ("upper", any(c.isupper() for c in core)),
        ("luhn", 12 <= len(digits) <= 19 and luhn(digits)),
        ("octets", core.count(".") == 3 and all(p.isascii() and p.isdigit() and _octet(p) for p in core.split("."))),
        ("equals", "=" in core),
        ("slash", "/" in core),
    ):
        if true:
            names.append(name)
    for side, word in (("before", before), ("after", after)):
        if word == "\0":
            names.append(f"{side}_token")
        elif word in _HINTS:
            names.append(f"{side}_{_HINTS[word]}")
    return [_INDEX[n] for n in names]


@dataclass
class Graph:
    """The tokens of a document with their feature rows and edges."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    unary: list[list[int]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


def _word_before(text: str, at: int) -> str:
    """The word before a place, however many blanks lie between."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    begin = end
    while begin and not text[begin - 1].isspace():
        begin -= 1
    return text[begin:end].strip(_EDGE + "()").lower()


def _word_after(text: str, at: int) -> str:
    m = _TOKEN.search(text, at)
    return m[0].strip(_EDGE + "()").lower() if m else ""


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _name_keys(name: str) -> np.ndarray:
    """A 64-bit key of the name itself, and of a name of digits those with each digit in turn left
    open."""
    c = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = np.arange(1, len(c) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    parts = _scrambled(_scrambled(place) ^ (c + np.uint64(1)))
    total = parts.sum(dtype=np.uint64) + np.uint64(len(c))
    if len(c) < SIMILAR or not (name.isascii() and name.isdigit()):
        return total[None]
    return np.concatenate((total[None], total - parts + _scrambled(place + np.uint64(5))))


def skip_edges(names: list[str]) -> list[tuple[int, int]]:
    """Each name with the last one before it that shares a key, for all of its keys."""
    if len(names) < 2:
        return []
    keys = [_name_keys(x) for x in names]
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate(keys)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    same = (flat[1:] == flat[:-1]) & (owner[1:] != owner[:-1])
    if not same.any():
        return []
    return [tuple(x) for x in np.unique(np.stack((owner[:-1][same], owner[1:][same]), 1), axis=0).tolist()]


def graph(text: str) -> Graph:
    g = Graph()
    names: list[str] = []
    found = tokens(text)
    for k, (a, b) in enumerate(found):
        raw = text[a:b]
        core = raw.strip(_EDGE)
        digits = _NOT_DIGIT.sub("", core)
        near = k > 0 and a - found[k - 1][1] <= 2 and text[found[k - 1][1] : a].isspace()
        follows = k + 1 < len(found) and found[k + 1][0] - b <= 2 and text[b : found[k + 1][0]].isspace()
        g.spans.append((a + (len(raw) - len(raw.lstrip(_EDGE))), a + max(1, len(raw.rstrip(_EDGE)))) if core else (a, b))
        g.unary.append(features(core, digits, "\0" if near else _word_before(text, a), "\0" if follows else _word_after(text, b)))
        if near:
            g.chain.append((k - 1, k))
        names.append(digits if len(digits) >= SIMILAR else core.lower())
    g.skip = skip_edges(names)
    return g


@dataclass
class Field:
    """Weights: feature x label, and label x label for chain and skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, rounds: int | None = None) -> np.ndarray:
        """Label probabilities of the tokens by sum-product messages: after `rounds` damped rounds
        over all edges at once, or, without a number, after as many and as many sweeps as it takes."""
        n, k = len(g.spans), len(LABELS)
        score = np.array([self.unary[f].sum(0) for f in g.unary]).reshape(n, k)
        edges = g.chain + g.skip
        if edges:
            tail, head = np.array(edges).T
            weight = np.concatenate((np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)))
            source, target = np.concatenate((tail, head)), np.concatenate((head, tail))
            weight = np.concatenate((weight, weight.transpose(0, 2, 1)))
            back = np.concatenate((np.arange(len(tail)) + len(tail), np.arange(len(tail))))
            message = np.zeros((len(source), k))
            step = 1.0
            for _ in range(ROUNDS if rounds is None else rounds):
                belief = score.copy()
                np.add.at(belief, target, message)
                new = _log_sum((belief[source] - message[back])[:, :, None] + weight, 1)
                new -= _log_sum(new, 1)[:, None]
                new = DAMPING * message + (1 - DAMPING) * new
                step, message = np.abs(new - message).max(), new
            if rounds is None and step >= SETTLED:
                _sweep(score, source, target, weight, back, message)
            np.add.at(score, target, message)
        return np.exp(score - _log_sum(score, 1)[:, None])


def _sweep(score: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, back: np.ndarray, message: np.ndarray) -> None:
    """Update `message` along the tokens, there and back, each message with those just made."""
    belief = score.copy()
    np.add.at(belief, target, message)
    there, home = np.flatnonzero(source < target), np.flatnonzero(source > target)
    ways = (there[np.argsort(source[there], kind="stable")], home[np.argsort(-source[home], kind="stable")])
    sources, targets, backs = source.tolist(), target.tolist(), back.tolist()
    for turn in range(2 * SWEEPS):
        damping = 0.0 if turn < 2 * FREE_SWEEPS else DAMPING
        step = 0.0
        for e in ways[turn % 2].tolist():
            x = (belief[sources[e]] - message[backs[e]])[:, None] + weight[e]
            top = x.max(0)
            new = top + np.log(np.exp(x - top).sum(0))
            most = new.max()
            new -= most + np.log(np.exp(new - most).sum())
            new = damping * message[e] + (1 - damping) * new
            change = new - message[e]
            belief[targets[e]] += change
            message[e] = new
            step = max(step, float(np.abs(change).max()))
        if turn % 2 and step < SETTLED:
            break


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def gold(g: Graph, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Of each token the label of the base span that covers most of it, else O."""
    out = np.zeros(len(g.spans), np.int64)
    most = np.zeros(len(g.spans))
    begins = [a for a, _ in g.spans]
    for start, rank, end in spans:
        k = max(0, bisect_left(begins, start) - 1)
        while k < len(begins) and begins[k] < end:
            a, b = g.spans[k]
            over = min(b, end) - max(a, start)
            if over * 2 > b - a and over > most[k]:
                out[k], most[k] = rank + 1, over
            k += 1
    return out


def train(texts: list[str], steps: int = 200, rate: float = 0.3, decay: float = 2e-5) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels."""
    k = len(LABELS)
    rows, labels, tails, heads, kinds = [], [], [], [], []
    for text in texts:
        g = graph(text)
        at = len(labels)
        rows += g.unary
        labels += gold(g, base_spans(text)).tolist()
        for kind, edges in ((0, g.chain), (1, g.skip)):
            tails += [a + at for a, _ in edges]
            heads += [b + at for _, b in edges]
            kinds += [kind] * len(edges)
    w = Field(np.zeros((len(_NAMES), k)), np.zeros((k, k)), np.zeros((k, k)))
    if not rows:
        return w
    x = np.zeros((len(rows), len(_NAMES)))
    for i, f in enumerate(rows):
        x[i, f] = 1
    y = np.array(labels)
    hot = np.eye(k)[y]
    tail, head, kind = np.array(tails, int), np.array(heads, int), np.array(kinds, int)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w.unary, w.chain, w.skip)]
    for step in range(1, steps + 1):
        score = x @ w.unary
        for j, edge in enumerate((w.chain, w.skip)):
            a, b = tail[kind == j], head[kind == j]
            np.add.at(score, b, edge[y[a]])
            np.add.at(score, a, edge[:, y[b]].T)
        miss = np.exp(score - _log_sum(score, 1)[:, None]) - hot
        grads = [x.T @ miss / len(y) + decay * w.unary]
        for j, edge in enumerate((w.chain, w.skip)):
            a, b = tail[kind == j], head[kind == j]
            g = np.zeros((k, k))
            np.add.at(g, y[a], miss[b])
            gt = np.zeros((k, k))
            np.add.at(gt, y[b], miss[a])
            grads.append((g + gt.T) / len(y) + decay * edge)
        for p, g, m in zip((w.unary, w.chain, w.skip), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return w


def _whole(rank: int, part: str) -> bool:
    """Is a token of this kind an entity by itself, so that nothing is to be joined to it?"""
    if rank == 0:
        return "." in part.rpartition("@")[2] and "@" in part[1:]
    if rank == 1:
        return part.count(".") >= 3
    return len(_NOT_DIGIT.sub("", part)) >= (12 if rank == 2 else 9)


def _joins(rank: int, held: str, token: str) -> bool:
    """May a token lengthen a span that ends just before it?"""
    if _whole(rank, token) or _whole(rank, held.split()[-1]):
        return False
    if rank < 2:
        return not _whole(rank, held)
    have, more = (_NOT_DIGIT.sub("", x) for x in (held, token))
    if rank == 2 and (len(have) >= 16 or (len(have) >= 12 and luhn(have))):
        return False
    return len(have) + len(more) <= (19 if rank == 2 else 15)


def added_spans(text: str, base: list[tuple[int, int, int]], w: Field) -> list[tuple[int, int, int]]:
    """The field's own spans: confident tokens clear of base spans. Neighbours of a label are joined
    while neither of them is whole by itself and the span isn't either."""
    g = graph(text)
    if not g.spans:
        return []
    p = w.marginals(g)
    best = p.argmax(1)
    out: list[tuple[int, int, int]] = []
    linked = {b: a for a, b in g.chain}
    last = None
    ends = sorted((b, a) for a, _, b in base)
    only_ends = [b for b, _ in ends]
    least_start = [a for _, a in ends]
    for i in range(len(ends) - 2, -1, -1):
        least_start[i] = min(least_start[i], least_start[i + 1])
    for i, (a, b) in enumerate(g.spans):
        j = bisect_left(only_ends, a + 1)
        if best[i] == 0 or p[i, best[i]] < ADD_AT or (j < len(ends) and least_start[j] < b):
            continue
        rank = int(best[i]) - 1
        joins = out and last is not None and linked.get(i) == last and out[-1][1] == rank
        if joins and _joins(rank, text[out[-1][0] : out[-1][2]], text[a:b]):
            out[-1] = (out[-1][0], out[-1][1], b)
        else:
            out.append((a, rank, b))
        last = i
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_pii(docs: DataFrame, text: str = "text", model: Field | None = None) -> DataFrame:
    """docs without the text, with n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_added and n_spans, the number of all spans."""
    small_batches(docs.sparkSession)
    made = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "n_added", "n_spans"]
    passed = [c for c in docs.columns if c != text and c not in made]
    kinds = [T.LongType()] * 4 + [T.StringType(), T.StringType(), T.LongType(), T.LongType()]
    schema = T.StructType([docs.schema[c] for c in passed] + [T.StructField(n, t) for n, t in zip(made, kinds, strict=True)])
    w = model or train(hash_sample(docs, text, SAMPLE_DOCS, SAMPLE_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in made]
            for value in batch.column(text).to_pylist():
                value = value or ""
                base = base_spans(value)
                added = added_spans(value, base, w) if _MARK.search(value) else []
                counts = [sum(r == k for _, r, _ in base) for k in range(4)]
                row = [*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added), len(base) + len(added)]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            arrays = [batch.column(c) for c in passed] + [pa.array(v, t) for v, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=passed + made)

    return docs.select(*passed, docs[text].cast("string").alias(text)).mapInArrow(run, schema)
