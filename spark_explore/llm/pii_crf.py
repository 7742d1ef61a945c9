"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Base spans follow fixed patterns (``base_spans``) and always stay. The field labels the tokens (between white space) that
hold a digit or an at-sign, or that repeat part of a base span; all other tokens count as observed to be nothing. Its
potentials are linear in features of a token's shape; neighbours within a text share chain potentials, and distant
tokens that repeat each other (the same word, the same last digits, the local part of an address) share skip
potentials. Each occurrence is linked to the one before, and one outside the base spans also to the last occurrence inside one (or the
first, if none came before): two links at most for each key of a token, and none of them depends on how often a token occurs. Messages are passed
around the graph of a document with damping until they stop changing; tokens of base spans are held at their label, so a label spreads to
repetitions that no pattern matches, however far. A token can only have a kind of the base spans that it repeats (through any number of
repetitions), or, without those, a kind to which any links lead; it is added if that is at least ``SURE`` likely.

Weights are fitted by pseudo-likelihood on a bounded sample of ``SAMPLE`` documents (those of smallest hash that
hold a digit or an at-sign and up to ``SAMPLE_CHARS`` characters), labelled by the base spans; features are hidden from a part of the tokens, and bare
repetitions of the spans (a number without its marks, a local part alone) are appended with their label, so the links are learned.

Edge cases: a null text is empty and has no spans; positions count code points; repeated rows give repeated results; null ids are
kept; an empty table gives no rows; extra columns are ignored by ``find`` and kept by ``mask``.
"""

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.llm.chunks import text_chunks
from spark_explore.llm.sampling import hash_sample

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none
SAMPLE, SAMPLE_CHARS = 600, 1 << 16
SURE = 0.5
DAMPING, STILL = 0.5, 1e-4  # messages pass until none in the document changes by more
SPARE = 60  # rounds beyond two for each token of a document, after which messages that still swing are taken as they are
HELD = 1e9  # log potential that holds tokens of base spans, however many links lead to them

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TOKEN = re.compile(r"\S*[0-9@]\S*")
WORD = re.compile(r"\S+")
EDGES = "()[]{}<>.,;:!?\"'"


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    last = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        # The part before the sign is the longest run of its characters that no earlier match has used.
        start, width = m.start(), 64
        while True:
            begin = max(last, m.start() - width)
            start = begin + len(text[begin:m.start()].rstrip(LOCAL))
            if start > begin or begin == last:
                break
            width *= 8
        if start < m.start():
            out.append((start, 0, m.end()))
            last = m.end()
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(map(str.isdecimal, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> list[int]:
    """Numbers of the features that hold for a token."""
    digits = sum(c in "0123456789" for c in token)
    letters = sum(map(str.isalpha, token))
    flags = ["@" in token, token[0] == "+", "(" in token, "-" in token, token.count(".") == 3, "." in token, letters > 0, digits == 0,
             digits > 0 and letters == 0]
    return [i for i, f in enumerate(flags) if f] + [len(flags) + min(digits, 19)]


FEATURES = 9 + 20 + 1  # the last one always holds


@dataclass
class Graph:
    """Tokens of several documents and the links between them."""

    spans: list  # (document, start, end) of every token
    features: np.ndarray
    label: np.ndarray  # base label of every token, 0: none
    chain: np.ndarray  # pairs of tokens
    skip: np.ndarray


def _keys(token: str) -> list[str]:
    low = token.lower()
    keys = [low] if len(low) >= 5 else []
    digits = "".join(c for c in low if c in "0123456789")
    if len(digits) >= 7:
        keys.append("#" + digits[-7:])
    if "@" in low and len(low.split("@")[0]) >= 5:
        keys.append(low.split("@")[0])
    return keys


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Graph:
    spans, features, label, chain, skip = [], [], [], [], []
    for d, (text, base) in enumerate(zip(texts, bases)):
        found = {(m.start(), m.end()) for m in TOKEN.finditer(text)} if "@" in text or DIGIT.search(text) else set()
        names = {k for s, kind, e in base if kind == 0 for k in [text[s:e].split("@")[0]] if len(k) >= 5}
        if names:  # local parts of addresses that stand alone
            found.update(m.span() for m in WORD.finditer(text) if m[0] in names)
        before, seen, at, begin = None, {}, 0, len(spans)
        inside, waiting = {}, {}  # per key the last occurrence in a base span, and those that came before any
        for a, b in sorted(found):
            token = text[a:b]
            core = token.strip(EDGES) or token
            a += token.find(core)
            b = a + len(core)
            while at < len(base) and base[at][2] <= a:
                at += 1
            kind = next((k + 1 for s, k, e in base[at:at + 4] if s < b and a < e), 0)
            i = len(spans)
            spans.append((d, a, b))
            label.append(kind)
            row = np.zeros(FEATURES, np.float32)
            row[shape(core)] = row[-1] = 1
            features.append(row)
            if before is not None and a - spans[before][2] <= 3:
                chain.append((before, i))
            before = i
            keys = _keys(core)
            linked = {seen[key] for key in keys if key in seen}
            for key in keys:
                if key in seen and seen[key] != i:
                    skip.append((seen[key], i))
                if kind:
                    skip.extend((j, i) for j in waiting.pop(key, ()) if j != seen[key])
                    inside[key] = i
                elif key not in inside:
                    waiting.setdefault(key, []).append(i)
                elif inside[key] not in linked:
                    skip.append((inside[key], i))
                    linked.add(inside[key])
                seen[key] = i
        starts = [x[1] for x in spans[begin:]]
        for s, k, e in base:  # a number written over several tokens is known by its last digits
            digits = "".join(c for c in text[s:e] if c in "0123456789")
            if k in (2, 3) and len(digits) >= 7 and (j := seen.get(key := "#" + digits[-7:])) is not None:
                own = begin + bisect_left(starts, e) - 1  # its last token
                if own >= begin and s <= spans[own][1] and own != j:
                    skip.append((own, j))
                    skip.extend((own, i) for i in waiting.pop(key, ()) if i not in (own, j))
    pairs = [np.array(x, np.int64).reshape(-1, 2) for x in (chain, skip)]
    return Graph(spans, np.array(features, np.float32).reshape(-1, FEATURES), np.array(label, np.int64), *pairs)


@dataclass
class Field:
    unary: np.ndarray  # (features, labels)
    chain: np.ndarray  # (labels, labels)
    skip: np.ndarray


def train(g: Graph, steps: int = 300, hidden: float = 0.7, seed: int = 5) -> Field:
    """Pseudo-likelihood: every token is predicted from its shape and the labels of its neighbours."""
    rng = np.random.default_rng(seed)
    field = Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.eye(LABELS))
    if not len(g.label):
        return field
    n = len(g.label)
    one = np.eye(LABELS)[g.label]
    near = [np.zeros((n, LABELS)) for _ in range(3)]  # labels of the tokens before, after, and at the ends of skips
    np.add.at(near[0], g.chain[:, 1], one[g.chain[:, 0]])
    np.add.at(near[1], g.chain[:, 0], one[g.chain[:, 1]])
    for a, b in ((0, 1), (1, 0)):
        np.add.at(near[2], g.skip[:, a], one[g.skip[:, b]])
    for step in range(steps):
        shown = g.features * (rng.random((n, 1)) >= hidden)
        shown[:, -1] = 1
        score = shown @ field.unary + near[0] @ field.chain + near[1] @ field.chain.T + near[2] @ field.skip
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gap = (one - p) / n
        rate = 4.0 * (1 - step / steps)
        field.unary += rate * (shown.T @ gap) - 1e-4 * field.unary
        field.chain += rate * (near[0].T @ gap + (near[1].T @ gap).T) - 1e-4 * field.chain
        grad = near[2].T @ gap
        field.skip += rate * (grad + grad.T) / 2 - 1e-4 * field.skip
    return field


def marginals(field: Field, g: Graph, allowed: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of every token by loopy message passing; ``allowed``: the labels it can have (all, if None)."""
    local = g.features @ field.unary
    if allowed is not None:
        local[~allowed] = -HELD
    held = g.label > 0
    local[held] = 0
    local[held, g.label[held]] = HELD
    skip, times = np.unique(g.skip, axis=0, return_counts=True)  # parallel links are one link of their joint potential
    ends = np.concatenate([g.chain, skip])
    if not len(ends):
        p = np.exp(local - local.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    kind = np.concatenate([np.zeros(len(g.chain), int), times])
    source = np.concatenate([ends[:, 0], ends[:, 1]])
    target = np.concatenate([ends[:, 1], ends[:, 0]])
    bonds = np.stack([field.chain, *(field.skip * n for n in range(1, times.max(initial=0) + 1))])
    bonds = np.concatenate([bonds, bonds.transpose(0, 2, 1)])
    bonds = np.exp(bonds - bonds.max((1, 2), keepdims=True))
    kind = np.concatenate([kind, kind + len(bonds) // 2])
    # Documents whose messages have settled leave the rounds.
    document = np.array([s[0] for s in g.spans])
    most = SPARE + 2 * np.bincount(document)
    message = np.zeros((len(source), LABELS))
    moving, rounds = np.arange(len(source)), 0
    while len(moving):
        rounds += 1
        half = len(moving) // 2  # links of a document leave in both directions
        back = np.concatenate([moving[half:], moving[:half]])
        total = local.copy()
        np.add.at(total, target[moving], message[moving])
        out = total[source[moving]] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.empty_like(out)
        for k, bond in enumerate(bonds):
            new[kind[moving] == k] = out[kind[moving] == k] @ bond
        new = np.log(new + 1e-300)
        new -= new.max(1, keepdims=True)
        change = np.zeros(len(most))
        np.maximum.at(change, document[source[moving]], np.abs(new - message[moving]).max(1))
        message[moving] = DAMPING * message[moving] + (1 - DAMPING) * new
        moving = moving[((change > STILL) & (rounds < most))[document[source[moving]]]]
    total = local.copy()
    np.add.at(total, target, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _components(n: int, ends: np.ndarray) -> np.ndarray:
    """The smallest token of the component of every token: roots hook to smaller neighbours, then pointers are jumped."""
    root = np.arange(n)
    while len(ends):
        ends = root[ends]
        ends = np.sort(ends[ends[:, 0] != ends[:, 1]], axis=1)
        np.minimum.at(root, ends[:, 1], ends[:, 0])
        while (root != (jumped := root[root])).any():
            root = jumped
    return root


def _linked(g: Graph, ends: np.ndarray) -> np.ndarray:
    """Kinds of the base spans to which the links ``ends`` lead, per token: (tokens, labels)."""
    root = _components(len(g.label), ends)
    held = g.label > 0
    reach = np.zeros((len(g.label), LABELS), bool)
    reach[root[held], g.label[held]] = True
    return reach[root]


def _allowed(g: Graph) -> np.ndarray:
    """The labels that every token can have: (tokens, labels)."""
    repeated = _linked(g, g.skip)
    out = np.where(repeated.any(1, keepdims=True), repeated, _linked(g, np.concatenate([g.chain, g.skip])))
    out[:, 0] = True
    return out


def all_spans(field: Field, texts: list[str]) -> tuple[list, list]:
    """Base spans and all spans of every text."""
    bases = [base_spans(t) for t in texts]
    g = graph(texts, bases)
    spans = [list(b) for b in bases]
    if len(g.label) and (g.label > 0).any():
        p = marginals(field, g, _allowed(g))
        best = p.argmax(1)
        at = np.arange(len(best))
        new = (g.label == 0) & (best > 0) & (p[at, best] >= SURE)
        for i in np.nonzero(new)[0]:
            d, a, b = g.spans[i]
            spans[d].append((a, int(best[i]) - 1, b))
    return bases, [sorted(s) for s in spans]


def with_repetitions(text: str, base: list) -> tuple[str, list]:
    """A text for training, its base spans repeated in a barer form at the end."""
    more = list(base)
    for a, k, b in base:
        if k == 1:
            continue
        own = text[a:b].split("@")[0] if k == 0 else "".join(c for c in text[a:b] if c in "0123456789")[-10:]
        text += " \n and " + own
        more.append((len(text) - len(own), k, len(text)))
    return text, sorted(more)


def fit(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Field:
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]"))
    texts = [r[0] for r in hash_sample(rows, sample, "doc_id", "text").select("text").collect()]
    return train_on(texts)


def train_on(texts: list[str]) -> Field:
    pairs = [with_repetitions(t, base_spans(t)) for t in texts]
    return train(graph([t for t, _ in pairs], [b for _, b in pairs]))


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of base spans by kind, the SHA-256 of the base spans, and all spans."""
    def run(batches):
        for batch in text_chunks(batches, "text"):
            bases, spans = all_spans(field, [t or "" for t in batch.column("text").to_pylist()])
            counts = [pa.array([sum(s[1] == k for s in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in bases], pa.string()),
                 pa.array([written(s) for s in spans], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    counts = "".join(f"n_{k} long, " for k in KINDS)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, {counts}base_sha256 string, spans string")


def find_all(docs: DataFrame) -> DataFrame:
    return find(docs, fit(docs))


def masked(text: str, spans: list) -> str:
    """The text with ``<KIND>`` in place of every span; of overlapping spans the first gives the name."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, k, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with all spans masked; all columns stay, a null text stays null."""
    field = fit(docs, text=text)

    def run(batches):
        for batch in text_chunks(batches, text):
            texts = batch.column(text).to_pylist()
            _, spans = all_spans(field, [t or "" for t in texts])
            new = [t if t is None or not s else masked(t, s) for t, s in zip(texts, spans)]
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
