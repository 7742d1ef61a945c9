"""Language identification with a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes. Two gated recurrent units read every window, one from each end; at
every byte their states give a distribution over languages. A document's probability of a language is the mean
over all its bytes that belong to letters. Training runs in numpy: cross-entropy at every letter, backpropagation through time over the windows, Adam.

The network is fitted on a bounded sample of labelled documents: ``PER_LANGUAGE`` documents of each language on
average (all, if there are fewer), and up to ``WINDOWS_PER_DOCUMENT`` windows of each. The languages are counted over all
labelled documents; the ``MAX_LANGUAGES`` most frequent are learned (ties: the first by name). Documents of rarer ones
are not trained on, so those languages are never predicted.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without labelled documents every text is; null
ids are kept (and count as not held out); repeated rows give repeated results; very long texts are read whole, window by window; an empty table gives no rows; extra columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.llm.chunks import sums, text_bytes, text_chunks

WINDOW = 128
HIDDEN = 12
PER_LANGUAGE = 400
WINDOWS_PER_DOCUMENT = 4
MAX_LANGUAGES = 512
STEPS, BATCH, RATE = 300, 128, 0.02
BLOCK = 2048  # windows that are read side by side
CHUNK = 1 << 20  # bytes of text that are cut at once: some 40 bytes each are held for one


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Model:
    """``inputs`` (2, 256, 3h): what a byte adds to update gate, reset gate and candidate, bias included; ``gates``
    (2, h, 2h) and ``memory`` (2, h, h): the same for the state; ``out`` (2h, languages) and ``bias``. First axis: direction."""

    languages: list
    inputs: np.ndarray
    gates: np.ndarray
    memory: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    FIELDS = ("inputs", "gates", "memory", "out", "bias")


def new_model(languages: list, seed: int = 7, hidden: int = HIDDEN) -> Model:
    rng = np.random.default_rng(seed)

    def draw(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    return Model(languages, draw(2, 256, 3 * hidden, scale=0.3), draw(2, hidden, 2 * hidden, scale=hidden**-0.5),
                 draw(2, hidden, hidden, scale=hidden**-0.5), draw(2 * hidden, len(languages), scale=hidden**-0.5),
                 np.zeros(len(languages), np.float32))


def _read(model: Model, codes: np.ndarray, direction: int, tape: list | None = None) -> np.ndarray:
    """States after each byte: (length, windows, hidden). ``codes`` is (length, windows)."""
    h = model.memory.shape[1]
    inputs, gates, memory = model.inputs[direction], model.gates[direction], model.memory[direction]
    state = np.zeros((codes.shape[1], h), np.float32)
    out = np.empty((*codes.shape, h), np.float32)
    steps = range(len(codes)) if direction == 0 else range(len(codes) - 1, -1, -1)
    for t in steps:
        x = inputs[codes[t]]
        both = x[:, :2 * h] + state @ gates
        # The logistic function by way of tanh, which numpy has in vector form.
        both *= 0.5
        np.tanh(both, out=both)
        both += 1
        both *= 0.5
        z, r = both[:, :h], both[:, h:]
        kept = r * state
        c = np.tanh(x[:, 2 * h:] + kept @ memory)
        if tape is not None:
            tape.append((t, state, z, r, kept, c))
        state = c + z * (state - c)
        out[t] = state
    return out


def _states(model: Model, codes: np.ndarray, direction: int) -> np.ndarray:
    """``_read`` without a tape, for many windows: every gate has its own whole arrays, and both squashing functions come from exp."""
    h = model.memory.shape[1]
    inputs, gates, memory = model.inputs[direction], model.gates[direction], model.memory[direction]
    update, reset, fresh = (np.ascontiguousarray(v) for v in (-inputs[:, :h], -inputs[:, h:2 * h], 2 * inputs[:, 2 * h:]))
    to_update, to_reset, to_fresh = np.ascontiguousarray(-gates[:, :h]), np.ascontiguousarray(-gates[:, h:]), 2 * memory
    out = np.empty((*codes.shape, h), np.float32)
    state = np.zeros((codes.shape[1], h), np.float32)
    z, r, c, x = (np.empty_like(state) for _ in range(4))
    steps = range(len(codes)) if direction == 0 else range(len(codes) - 1, -1, -1)
    with np.errstate(over="ignore"):  # exp may be infinite: one over it is 0
        for t in steps:
            own = codes[t]
            # z and r hold one over their gates.
            for gate, table, weights in ((z, update, to_update), (r, reset, to_reset)):
                np.matmul(state, weights, out=gate)
                gate += table.take(own, axis=0, out=x, mode="clip")
                np.exp(gate, out=gate)
                gate += 1
            np.divide(state, r, out=r)
            np.matmul(r, to_fresh, out=c)
            c += fresh.take(own, axis=0, out=x, mode="clip")
            np.exp(c, out=c)
            c += 1
            np.divide(-2, c, out=c)
            c += 1
            state -= c
            state /= z
            state += c
            out[t] = state
    return out


def probabilities(model: Model, codes: np.ndarray) -> np.ndarray:
    """Distribution over languages at every byte: (languages, length, windows)."""
    h = model.memory.shape[1]
    codes = codes.astype(np.intp)
    score = model.out[:h].T @ _states(model, codes, 0).reshape(-1, h).T
    score += model.out[h:].T @ _states(model, codes, 1).reshape(-1, h).T
    score += model.bias[:, None]
    score -= score.max(0)
    np.exp(score, out=score)
    score /= score.sum(0)
    return score.reshape(-1, *codes.shape)


def gradients(model: Model, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean loss over the weighted bytes and its gradients, by backpropagation through time."""
    h = model.memory.shape[1]
    tapes: list[list] = [[], []]
    states = [_read(model, codes, d, tapes[d]) for d in (0, 1)]
    score = states[0] @ model.out[:h] + states[1] @ model.out[h:] + model.bias
    score -= score.max(-1, keepdims=True)
    p = np.exp(score)
    p /= p.sum(-1, keepdims=True)
    total = max(float(weight.sum()), 1.0)
    at = np.arange(codes.shape[1])
    loss = float(-(np.log(p[:, at, labels] + 1e-9) * weight).sum() / total)
    p[:, at, labels] -= 1
    p *= weight[..., None] / total
    grad = {f: np.zeros_like(getattr(model, f)) for f in Model.FIELDS}
    grad["bias"] = p.sum((0, 1))
    flat = p.reshape(-1, p.shape[-1])
    for d in (0, 1):
        grad["out"][d * h:(d + 1) * h] = states[d].reshape(-1, h).T @ flat
        above = p @ model.out[d * h:(d + 1) * h].T
        back = np.zeros((codes.shape[1], h), np.float32)
        for t, before, z, r, kept, c in reversed(tapes[d]):
            back = back + above[t]
            dc = back * (1 - z) * (1 - c * c)
            dz = back * (before - c) * z * (1 - z)
            dkept = dc @ model.memory[d].T
            dr = dkept * before * r * (1 - r)
            both = np.concatenate([dz, dr], 1)
            grad["memory"][d] += kept.T @ dc
            grad["gates"][d] += before.T @ both
            np.add.at(grad["inputs"][d], codes[t], np.concatenate([both, dc], 1))
            back = back * z + dkept * r + both @ model.gates[d].T
    return loss, grad


def train(windows: np.ndarray, weight: np.ndarray, labels: np.ndarray, languages: list,
          steps: int = STEPS, seed: int = 7) -> Model:
    """Adam on random batches. ``windows``: (n, WINDOW) bytes; ``weight``: which bytes count; ``labels``: language numbers."""
    model = new_model(languages, seed)
    rng = np.random.default_rng(seed)
    # Every language is drawn equally often.
    groups = [np.nonzero(labels == k)[0] for k in range(len(languages))]
    groups = [g for g in groups if len(g)]
    first = {f: np.zeros_like(getattr(model, f)) for f in Model.FIELDS}
    second = {f: np.zeros_like(getattr(model, f)) for f in Model.FIELDS}
    for step in range(1, steps + 1):
        own = rng.integers(0, len(groups), BATCH)
        pick = np.array([groups[g][rng.integers(len(groups[g]))] for g in own])
        _, grad = gradients(model, windows[pick].T, labels[pick], weight[pick].T.astype(np.float32))
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 3 * (1 - step / (steps + 1)))
        for f, g in grad.items():
            g = g * min(1.0, 1 / (size + 1e-9))
            first[f] += 0.1 * (g - first[f])
            second[f] += 0.01 * (g * g - second[f])
            setattr(model, f, (getattr(model, f) - rate * (first[f] / (1 - 0.9**step)) / (
                np.sqrt(second[f] / (1 - 0.99**step)) + 1e-6)).astype(np.float32))
    return model


def letter_bytes(data: bytes) -> np.ndarray:
    """Which bytes belong to letters."""
    raw = np.frombuffer(data, np.uint8)
    lower = raw | 32
    letters = (lower >= 97) & (lower <= 122)
    if len(raw) and raw.max() >= 0x80:
        text = data.decode("utf-8")
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        kinds, at = np.unique(codes, return_inverse=True)
        letters = np.repeat(np.array([chr(c).isalpha() for c in kinds])[at], width)
    return letters


def cut(data: bytes, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, which of their bytes count, and the text of each."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][owner][:, None]
    at = np.minimum(at, max(len(data) - 1, 0))
    raw = np.frombuffer(data, np.uint8)
    return np.where(inside, raw[at], 0), inside & letters[at], owner


def _columns(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        reject: bool = False) -> Model | None:
    """The model for labelled documents; None without any. A sampled document is drawn by the hash of its text and id.

    With ``reject`` there is one more class, named None: what no language looks like (``strange_windows``).
    """
    rows = labelled.select(*(F.col(f"`{c}`").cast("string").alias(name) for c, name in ((doc_id, "doc_id"), (text, "text"), (lang, "lang")))
                           ).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    # Each language's share of hashes, which depend on the rows alone, not on their places in files.
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    drawn = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    sample = rows.where(drawn).select("text", "lang").mapInArrow(
        lambda batches: _sampled(batches, languages), "windows binary, letters binary, label int")
    parts, letters, labels = [], [], []
    for windows, own, label in sample.limit(2 * per_language * len(languages)).collect():
        parts.append(np.frombuffer(windows, np.uint8).reshape(-1, WINDOW))
        letters.append(np.frombuffer(own, bool).reshape(-1, WINDOW))
        labels.append(np.full(len(parts[-1]), label))
    if not parts:
        return None
    windows, letters, labels = np.concatenate(parts), np.concatenate(letters), np.concatenate(labels)
    if reject:
        strange, own = strange_windows(windows, letters, -(-len(windows) // len(languages)))
        windows, letters = np.concatenate([windows, strange]), np.concatenate([letters, own])
        labels = np.append(labels, np.full(len(strange), len(languages)))
        languages = [*languages, None]
    return train(windows, letters, labels, languages)


# First and last letters of the blocks that strange windows are drawn from: Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul.
SCRIPTS = ((0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096),
           (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def strange_windows(windows: np.ndarray, letters: np.ndarray, count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """``count`` windows that are no language, and which of their bytes are letters: sampled windows with their ASCII letters in random order or
    replaced by random ones, and words of random letters of some script."""
    rng = np.random.default_rng(seed)
    out, own = windows[rng.integers(0, len(windows), count)].copy(), np.zeros((count, windows.shape[1]), bool)
    for i in range(count):
        ascii_letters = np.nonzero(((out[i] | 32) >= 97) & ((out[i] | 32) <= 122))[0]
        kind = rng.integers(3)
        if kind == 0:
            out[i, ascii_letters] = rng.permutation(out[i, ascii_letters])
        elif kind == 1:
            out[i, ascii_letters] = rng.integers(97, 123, len(ascii_letters))
        else:
            low, high = SCRIPTS[rng.integers(len(SCRIPTS))]
            text = "".join(chr(c) if rng.random() > 0.15 else " " for c in rng.integers(low, high + 1, windows.shape[1]))
            out[i] = np.frombuffer(text.encode()[:windows.shape[1]], np.uint8)
            ascii_letters = np.nonzero(out[i] >= 0x80)[0]
        own[i, ascii_letters] = True
    return out, own


def _sampled(batches, languages):
    """A few windows of each text, spread over it."""
    number = {k: i for i, k in enumerate(languages)}
    for batch in text_chunks(batches, "text", CHUNK):
        data, offsets = text_bytes(batch.column("text"))
        windows, letters, owner = cut(data, offsets, letter_bytes(data))
        bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        out = ([], [], [])
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            n = bounds[i + 1] - bounds[i]
            pick = bounds[i] + np.unique(np.linspace(0, n - 1, min(n, WINDOWS_PER_DOCUMENT)).astype(int)) if n else []
            pick = [p for p in pick if letters[p].any()]
            if pick:
                out[0].append(windows[pick].tobytes()), out[1].append(letters[pick].tobytes()), out[2].append(number[lang])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())], ["windows", "letters", "label"])


def pooled(model: Model | None, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of every text, and the mean over its letters of the probability of each language."""
    letters = letter_bytes(data)
    many = sums(letters, offsets)
    total = np.zeros((len(many), len(model.languages) if model else 1))
    if model is not None and many.any():
        windows, weight, owner = cut(data, offsets, letters)
        some = weight.any(1)
        windows, weight, owner = windows[some], weight[some], owner[some]
        for at in range(0, len(windows), BLOCK):
            part = slice(at, at + BLOCK)
            p = probabilities(model, windows[part].T)
            p *= weight[part].T
            np.add.at(total, owner[part], p.sum(1, dtype=np.float64).T)
        total /= np.maximum(many, 1)[:, None]
    return many, total


def scores(model: Model | None, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of every text (-1: none) and its pooled probability."""
    many, total = pooled(model, data, offsets)
    some = (many > 0) & (model is not None)
    best = total.argmax(1)
    return np.where(some, best, -1), np.where(some, np.clip(total[np.arange(len(best)), best], 0, 1), 0.0)


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the pooled probability) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in text_chunks(batches, "text", CHUNK):
            best, score = scores(own, *text_bytes(batch.column("text")))
            names = [own.languages[b] if b >= 0 else "und" for b in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return _columns(docs, doc_id, text).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Documents kept out of training."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict_all(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents that are not held out."""
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def reject_unknown(docs: DataFrame, most: float = 0.5) -> DataFrame:
    """The documents that look like no language by less than ``most``; all columns stay. Documents without a letter go.

    The model has a class for what is no language, and its probability is pooled over the letters; so a document in several languages stays. Rows
    are scored as they pass, so rows that repeat an id are judged one by one. Without labelled documents nothing is recognised.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out()), reject=True))

    def run(batches):
        own = shared.value
        for batch in text_chunks(batches, "text", CHUNK):
            many, total = pooled(own, *text_bytes(batch.column("text")))
            yield batch.filter(pa.array((many > 0) & (own is not None) & (total[:, -1] < most)))

    return docs.mapInArrow(run, docs.schema)
