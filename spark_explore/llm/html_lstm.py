"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of a page.

A page is cut into blocks (the text between block tags, without scripts, styles and comments). A block is described by its
tag path (tags, ids and classes of the open elements, hashed and averaged) and by its words (hashed, averaged), with
a few counts. An LSTM reads the blocks of a page from each end, so a block is judged in the context of the whole
document, and the two states say whether it belongs to the article. Training runs in numpy by backpropagation through time.

Labels come from the pages themselves: blocks inside ``article`` or ``main`` are text, and those inside elements for
navigation, headers, footers, asides, forms, adverts, notices or comments are not. The network is fitted on a
bounded sample of ``SAMPLE`` pages of up to ``SAMPLE_CHARS`` characters (drawn by hash). They are also shown with their containers renamed to other usual
ones, with other leaf tags, and with some of their texts repeated in containers for other things, so the network doesn't lean on one
way of writing pages; a page without such elements teaches nothing.

Edge cases: null and empty html give empty text; pages without blocks too; unclosed and stray tags are
tolerated; ties don't arise; repeated rows give repeated results; extra columns are ignored; an empty table gives no rows. Without
any labelled page every block is text but those in the elements named above.
"""

import html as entities
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_explore.llm.chunks import text_chunks
from spark_explore.llm.sampling import hash_sample

SAMPLE, SAMPLE_CHARS = 600, 1 << 16
HIDDEN = 16
PATH_SLOTS, WORD_SLOTS = 1 << 10, 1 << 12
EMBED = 12
STEPS, BATCH, RATE = 600, 24, 0.01
PAGES, PLACES = 256, 1 << 16  # pages read side by side, and places for their blocks

# HTML elements by their role (fixed values).
BLOCK_TAGS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
                 " head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = set("script style noscript template textarea svg iframe".split())
RAW_ENDS = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in RAW_TAGS}
# Elements that a following start tag closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"},
          "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}}
TEXT_HOMES = {"article", "main"}
OTHER_HOMES = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "button", "select"}
OTHER_NAMES = re.compile(r"\b(ads?|advert\w*|banner|promo\w*|sponsor\w*|cookie\w*|consent|notice|comments?|replies|sidebar|nav\w*|menu|"
                         r"footer|header|breadcrumb\w*|share|social|related|newsletter|subscribe|popup|modal)\b", re.I)
TEXT_NAMES = re.compile(r"\b(article|post|entry|story|main|content|body)\b", re.I)
# Usual names of containers, from which training draws others for the sampled ones (fixed values).
TEXT_WORDS = "article post entry story main content body text page-content blog news".split()
OTHER_WORDS = ("ad ads advert advertisement banner promo sponsor cookie consent notice gdpr comment comments reply replies discussion sidebar aside"
               " nav navbar menu footer header masthead breadcrumb breadcrumbs share social related recommended newsletter subscribe popup"
               " modal widget toolbar pagination tags login search form disclaimer copyright").split()
WRAPPERS = "container wrapper row page site inner layout grid col outer".split()
TEXT_LEAVES = "p p p p li blockquote h2 h3 div td pre dd figcaption section".split()
OTHER_LEAVES = "p p li a h2 h3 h4 div span label button td small strong".split()

# A value in quotes after "=" may hold ">"; a quote that is never closed is an ordinary character.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*>", re.S)
NAMES = re.compile(r"\b(?:id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"\w+")
SPACE = re.compile(r"\s+")


def slot(text: str, slots: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % slots


class Element:
    """An open element, known by its parent, so a path costs the same at any depth."""

    __slots__ = ("parent", "tag", "names", "label")

    def __init__(self, parent: "Element | None", tag: str, names: str):
        self.parent, self.tag, self.names = parent, tag, names
        label = parent.label if parent else None
        if label != 0:
            other = tag in OTHER_HOMES or (names and OTHER_NAMES.search(names) and not TEXT_NAMES.search(names))
            label = 0 if other else 1 if tag in TEXT_HOMES else label
        self.label = label


@dataclass
class Block:
    home: Element | None  # the innermost element
    text: str

    @property
    def path(self) -> tuple:
        """(tag, names) from the outermost element."""
        out, at = [], self.home
        while at is not None:
            out.append((at.tag, at.names))
            at = at.parent
        return tuple(reversed(out))

    @property
    def label(self) -> int | None:
        """1: in an article; 0: in an element for other things (also inside the article); None: neither is said."""
        return self.home.label if self.home else None


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with white space folded; blocks without text are left out."""
    out: list[Block] = []
    stack: list[Element] = []
    opened: Counter = Counter()  # tags of the stack
    parts: list[str] = []
    at, n, last = 0, len(page), page.rfind(">") + 1  # no tag ends after ``last``

    def flush():
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append(Block(stack[-1] if stack else None, text))
            parts.clear()

    while at < n:
        m = TOKEN.search(page, at, last)
        if m is None:
            hidden = page.find("<!--", at)
            parts.append(page[at:] if hidden < 0 else page[at:hidden])
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
                break  # a comment that is not closed hides the rest
            continue
        tag = m[2].lower()
        if tag in BLOCK_TAGS:
            flush()
        if m[1]:
            if opened[tag]:
                closed = 1
                while stack[-closed].tag != tag:
                    closed += 1
                if any(e.tag in BLOCK_TAGS for e in stack[-closed:]):
                    flush()
                opened.subtract(e.tag for e in stack[-closed:])
                del stack[-closed:]
            continue
        if tag in RAW_TAGS:
            flush()
            end = RAW_ENDS[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        closes = CLOSES.get(tag, ())
        while stack and (stack[-1].tag in closes or stack[-1].tag not in BLOCK_TAGS and tag in BLOCK_TAGS and any(opened[t] for t in closes)):
            opened[stack.pop().tag] -= 1
        names = " ".join(x or y or z for x, y, z in NAMES.findall(m[3])).lower() if m[3] else ""
        stack.append(Element(stack[-1] if stack else None, tag, names))
        opened[tag] += 1
    flush()
    return out


class Spelling:
    """Other ways to write a page: renamed containers, wrappers, other leaves."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.others: dict = {}
        self.wrappers = [("div", self.pick(WRAPPERS)) for _ in range(rng.integers(0, 3))]
        self.text_home = self.home(("article", "main"), TEXT_WORDS)

    def pick(self, words):
        return words[self.rng.integers(len(words))]

    def home(self, tags, words) -> list:
        if self.rng.random() < 0.35:
            return [(self.pick(tags), "")]
        names = self.pick(words) + (f"-{self.pick(words)}" if self.rng.random() < 0.4 else "")
        if self.rng.random() < 0.3:
            names = f"{self.pick(['site', 'page', 'main', 'top', 'the', 'js', 'block', 'box'])}-{names}"
        out = [(self.pick(["div", "div", "section", *tags]), names)]
        if self.rng.random() < 0.2:
            out.append(("div", self.pick(WRAPPERS)))
        return out

    def other_home(self, key) -> list:
        if key not in self.others:
            self.others[key] = self.home(("nav", "header", "footer", "aside", "form"), OTHER_WORDS)
        return self.others[key]

    def spelled(self, path: tuple, label) -> tuple:
        out = []
        for tag, names in path:
            if tag in TEXT_HOMES:
                out += self.text_home
            elif tag in OTHER_HOMES - {"head"} or (names and OTHER_NAMES.search(names)):
                out += self.other_home((tag, names))
            else:
                out.append((tag, names))
                if tag == "body":
                    out += self.wrappers
        leaves = TEXT_LEAVES if label == 1 else OTHER_LEAVES
        if label is not None and self.rng.random() < 0.4 and out and out[-1][0] != "h1" and all(t != "head" for t, _ in out):
            out = out[:-1] if out[-1][0] in ("p", "li", "a", "b") else out
            out.append((self.pick(leaves), ""))
        return tuple(out)

    def aside(self, texts: list) -> list:
        """A container for other things that holds some of the given texts."""
        home = self.home(("aside", "section", "form", "div"), OTHER_WORDS)
        inside = self.text_home if self.rng.random() < 0.3 else []
        path = [("html", ""), ("body", ""), *self.wrappers, *inside, *home]
        return [(tuple([*path, (self.pick(OTHER_LEAVES), "")]), t) for t in texts]


@lru_cache(50_000)
def step_slots(tag: str, names: str) -> tuple:
    return tuple(slot(x, PATH_SLOTS) for x in (tag, *(f".{w}" for w in WORDS.findall(names))))


def path_slots(path: tuple) -> list[int]:
    found = [i for step in path for i in step_slots(*step)]
    return [*found, slot("leaf:" + (path[-1][0] if path else ""), PATH_SLOTS)]


def path_means(table: np.ndarray, homes: list) -> np.ndarray:
    """The mean embedding of every path; sums of an element go on from those of its parent."""
    sums: dict = {None: (np.zeros(table.shape[1], table.dtype), 0)}
    out = np.empty((len(homes), table.shape[1]), table.dtype)
    for i, home in enumerate(homes):
        new, at = [], home
        while at not in sums:
            new.append(at)
            at = at.parent
        total, many = sums[at]
        for element in reversed(new):
            slots = step_slots(element.tag, element.names)
            total, many = total + table[list(slots)].sum(0), many + len(slots)
            sums[element] = (total, many)
        out[i] = (total + table[slot("leaf:" + (home.tag if home else ""), PATH_SLOTS)]) / (many + 1)
    return out


_WORDS: dict = {}


def word_slots(text: str) -> list[int]:
    out = []
    for w in text.lower().split():
        s = _WORDS.get(w)
        if s is None:
            if len(_WORDS) > 500_000:
                _WORDS.clear()
            s = _WORDS[w] = slot(w, WORD_SLOTS)
        out.append(s)
    return out or [0]


def counts_of(text: str) -> list[float]:
    n = len(text)
    words = text.count(" ") + 1
    marks = sum(map(text.count, ".!?;:,"))
    return [np.log1p(n) / 8, np.log1p(words) / 6, min(marks / words, 1.0), float(text[-1] in ".!?") if text else 0.0]


COUNTS = 4


@dataclass
class Model:
    paths: np.ndarray  # embeddings of the slots
    words: np.ndarray
    inputs: np.ndarray  # (2, inputs, 4h)
    state: np.ndarray  # (2, h, 4h)
    bias: np.ndarray  # (2, 4h)
    out: np.ndarray  # (2h + inputs,)
    shift: np.ndarray  # (1,)

    FIELDS = ("paths", "words", "inputs", "state", "bias", "out", "shift")


def new_model(seed: int = 11, h: int = HIDDEN) -> Model:
    rng = np.random.default_rng(seed)
    size = 2 * EMBED + COUNTS

    def draw(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    bias = np.zeros((2, 4 * h), np.float32)
    bias[:, h:2 * h] = 1  # forget gates begin open
    return Model(draw(PATH_SLOTS, EMBED, scale=0.3), draw(WORD_SLOTS, EMBED, scale=0.1), draw(2, size, 4 * h, scale=size**-0.5),
                 draw(2, h, 4 * h, scale=h**-0.5), bias, draw(2 * h + size, scale=0.1), np.zeros(1, np.float32))


def _mean(table: np.ndarray, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of the embeddings of every block (none is without slots)."""
    out = np.add.reduceat(table[slots], bounds[:-1], axis=0)
    return out / np.diff(bounds)[:, None]


def _ragged(lists) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return np.fromiter((i for x in lists for i in x), np.int64, int(bounds[-1])), bounds


@dataclass
class Batch:
    """Blocks of several pages: features, and where each stands (place in its page, page)."""

    paths: tuple | list  # slots and bounds; to predict, the innermost elements
    words: tuple
    counts: np.ndarray
    place: np.ndarray
    page: np.ndarray
    pages: int
    longest: int


def batch_of(pages: list[list[tuple]]) -> Batch:
    """``pages``: per page its blocks as (path slots or innermost element, word slots, counts)."""
    flat = [b for p in pages for b in p]
    homes = [b[0] for b in flat]
    paths = _ragged(homes) if homes and isinstance(homes[0], list) else homes
    sizes = np.array([len(p) for p in pages])
    page = np.repeat(np.arange(len(pages)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return Batch(paths, _ragged([b[1] for b in flat]), np.array([b[2] for b in flat], np.float32).reshape(-1, COUNTS),
                 place, page, len(pages), int(sizes.max(initial=0)))


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def forward(model: Model, batch: Batch, tape: dict | None = None) -> np.ndarray:
    """The log odds that each block is article text."""
    h = model.state.shape[1]
    paths = _mean(model.paths, *batch.paths) if isinstance(batch.paths, tuple) else path_means(model.paths, batch.paths)
    x = np.concatenate([paths, _mean(model.words, *batch.words), batch.counts], 1)
    size = x.shape[1]
    padded = np.zeros((batch.longest, batch.pages, size), np.float32)
    padded[batch.place, batch.page] = x
    inside = np.zeros((batch.longest, batch.pages, 1), np.float32)
    inside[batch.place, batch.page] = 1
    score = x @ model.out[2 * h:] + model.shift[0]
    for d in (0, 1):
        given = padded @ model.inputs[d] + model.bias[d]
        state = np.zeros((batch.pages, h), np.float32)
        cell = np.zeros((batch.pages, h), np.float32)
        states = np.empty((batch.longest, batch.pages, h), np.float32)
        steps = []
        for t in (range(batch.longest) if d == 0 else range(batch.longest - 1, -1, -1)):
            g = given[t] + state @ model.state[d]
            i, f, o = (_sigmoid(g[:, k * h:(k + 1) * h]) for k in (0, 1, 2))
            c = np.tanh(g[:, 3 * h:])
            m = inside[t]
            new = f * cell + i * c
            bent = np.tanh(new)
            if tape is not None:
                steps.append((t, state, cell, i, f, o, c, bent, m))
            cell = m * new + (1 - m) * cell
            state = m * (o * bent) + (1 - m) * state
            states[t] = state
        own = states[batch.place, batch.page]
        score = score + own @ model.out[d * h:(d + 1) * h]
        if tape is not None:
            tape[d] = (steps, own)
    if tape is not None:
        tape["x"], tape["padded"] = x, padded
    return score


def gradients(model: Model, batch: Batch, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    h = model.state.shape[1]
    tape: dict = {}
    score = forward(model, batch, tape)
    p = _sigmoid(score)
    total = max(float(weight.sum()), 1.0)
    loss = float(-(weight * np.where(labels == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / total)
    back = ((p - labels) * weight / total).astype(np.float32)
    x, padded = tape["x"], tape["padded"]
    grad = {f: np.zeros_like(getattr(model, f)) for f in Model.FIELDS}
    grad["shift"][0] = back.sum()
    grad["out"][2 * h:] = x.T @ back
    dx = np.outer(back, model.out[2 * h:])
    for d in (0, 1):
        steps, own = tape[d]
        grad["out"][d * h:(d + 1) * h] = own.T @ back
        above = np.zeros((batch.longest, batch.pages, h), np.float32)
        above[batch.place, batch.page] = np.outer(back, model.out[d * h:(d + 1) * h])
        dstate = np.zeros((batch.pages, h), np.float32)
        dcell = np.zeros((batch.pages, h), np.float32)
        for t, state, cell, i, f, o, c, bent, m in reversed(steps):
            dstate = dstate + above[t]
            ds = dstate * m
            dnew = dcell * m + ds * o * (1 - bent * bent)
            g = np.concatenate([dnew * c * i * (1 - i), dnew * cell * f * (1 - f), ds * bent * o * (1 - o), dnew * i * (1 - c * c)], 1)
            grad["inputs"][d] += padded[t].T @ g
            grad["state"][d] += state.T @ g
            grad["bias"][d] += g.sum(0)
            at = np.nonzero(batch.place == t)[0]
            dx[at] += g[batch.page[at]] @ model.inputs[d].T
            dcell = dcell * (1 - m) + dnew * f
            dstate = dstate * (1 - m) + g @ model.state[d].T
    for name, (slots, bounds), part in (("paths", batch.paths, slice(0, EMBED)), ("words", batch.words, slice(EMBED, 2 * EMBED))):
        size = np.diff(bounds)
        np.add.at(grad[name], slots, np.repeat(dx[:, part] / size[:, None], size, axis=0))
    return loss, grad


def described(block: Block) -> tuple:
    return block.home, word_slots(block.text), counts_of(block.text)


def train(pages: list[str], steps: int = STEPS, seed: int = 11) -> Model | None:
    """The model for labelled pages; None if no page has a label of each kind."""
    rng = np.random.default_rng(seed)
    found = []
    for page in pages:
        own = blocks(page)
        labels = [b.label for b in own]
        if 1 in labels:
            found.append(([(b.path, b.text) for b in own], labels))
    if not found:
        return None
    model = new_model(seed)
    first = {f: np.zeros_like(getattr(model, f)) for f in Model.FIELDS}
    second = {f: np.zeros_like(getattr(model, f)) for f in Model.FIELDS}
    for step in range(1, steps + 1):
        chosen, labels = [], []
        for k in rng.integers(0, len(found), BATCH):
            own, said = found[k]
            if rng.random() < 0.4:
                rows = [(path, text, label) for (path, text), label in zip(own, said)]
            else:
                spelling = Spelling(rng)
                rows = [(spelling.spelled(path, label), text, label) for (path, text), label in zip(own, said)]
                for _ in range(rng.integers(0, 4)):  # more of other things: before, within and after the text
                    texts = [own[i][1] for i in rng.integers(0, len(own), rng.integers(1, 5))]
                    at = int(rng.choice([0, len(rows), rng.integers(0, len(rows) + 1)]))
                    rows[at:at] = [(path, t, 0) for path, t in spelling.aside(texts)]
            chosen.append([(path_slots(path), word_slots(t), counts_of(t)) for path, t, _ in rows])
            labels += [label for *_, label in rows]
        weight = np.array([x is not None for x in labels], np.float32)
        _, grad = gradients(model, batch_of(chosen), np.array([x or 0 for x in labels], np.float32), weight)
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 3 * (1 - step / (steps + 1)))
        for f, g in grad.items():
            g = g * min(1.0, 1 / (size + 1e-9))
            first[f] += 0.1 * (g - first[f])
            second[f] += 0.01 * (g * g - second[f])
            setattr(model, f, (getattr(model, f) - rate * (first[f] / (1 - 0.9**step)) / (
                np.sqrt(second[f] / (1 - 0.99**step)) + 1e-6)).astype(np.float32))
    return model


def fit(pages: DataFrame, sample: int = SAMPLE, page_id: str = "page_id", html: str = "html") -> Model | None:
    """Trains on the ``sample`` pages of smallest hash among those of up to ``SAMPLE_CHARS`` characters."""
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{html}`").cast("string").alias("html"))
    rows = rows.where(f"html <> '' AND length(html) <= {SAMPLE_CHARS}")
    return train([r[0] for r in hash_sample(rows, sample, "page_id", "html").select("html").collect()])


def main_texts(model: Model | None, pages: list[str | None]) -> list[str]:
    """The article of every page: the blocks that the network calls text, a line each."""
    own = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    some = sorted((i for i, b in enumerate(own) if b), key=lambda i: len(own[i]))
    at = 0
    while at < len(some):
        # Pages are in order of length, so padding stays within PLACES but for a page that is longer by itself.
        stop = at + 1
        while stop < min(len(some), at + PAGES) and (stop + 1 - at) * len(own[some[stop]]) <= PLACES:
            stop += 1
        part, at = some[at:stop], stop
        if model is None:
            keep = [b.label != 0 for i in part for b in own[i]]
        else:
            keep = (forward(model, batch_of([[described(b) for b in own[i]] for i in part])) > 0).tolist()
        k = 0
        for i in part:
            out[i] = "\n".join(b.text for b, yes in zip(own[i], keep[k:k + len(own[i])]) if yes)
            k += len(own[i])
    return out


def extract(pages: DataFrame, model: Model | None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_chunks(batches, "html"):
            texts = main_texts(shared.value, batch.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
        F.col(f"`{html}`").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extract_all(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
