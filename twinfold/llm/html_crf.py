"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A block is the text between two borders of block-level elements.  Its features
are the tags, classes, ids and roles of its ancestors and the shape of its text
(length, links, sentence ends).  A chain of two states (main, other) is trained
on labelled pages by its exact likelihood (forward-backward) and decoded by
Viterbi.  The blocks in state *main* are the text, in page order.

Defined results: character references are decoded, white space inside a block is
one space, blocks are joined by two line feeds; scripts, styles, templates, page
heads and comments are no text.  Null, empty and broken markup is read as far
as it goes; a page without main blocks gives the empty text.  Whole pages are
read.  Repeated rows are extracted each for itself, an empty table gives an
empty result, extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinfold.llm.labelled_pages import labelled_pages

_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html iframe label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th "
    "thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template noscript head title svg math iframe object".split())
#: A new element of the key ends an open one of the values, if it is in the same container.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = frozenset("article aside body div footer form header main nav section table ul ol dl td th blockquote html".split())


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # (tag, words of its class, id and role), outermost first
    link_chars: int
    label: str | None


class _Leaves(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...], str | None]] = []
        self.hidden = self.links = 0
        self.parts: list[str] = []
        self.link_parts = 0
        self.blocks: list[Block] = []

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            label = next((x[2] for x in reversed(self.stack) if x[2]), None)
            self.blocks.append(Block(text, tuple((t, w) for t, w, _ in self.stack), self.link_parts, label))
        self.parts, self.link_parts = [], 0

    def _pop_to(self, at: int) -> None:
        for tag, _, _ in self.stack[at:]:
            self.hidden -= tag in _HIDDEN
            self.links -= tag == "a"
        del self.stack[at:]

    def _close(self, tags: Iterable[str]) -> None:
        """Ends the innermost open element of ``tags`` unless a container is in between."""
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at][0]
            if tag in tags:
                return self._pop_to(at)
            if tag in _CONTAINERS:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self.cut()
            self._close({"p"})
            if tag == "body":
                self._close({"head", "title"})
            if tag in _ENDS:
                self._close(_ENDS[tag])
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        named = dict(attrs)
        words = " ".join(named.get(k) or "" for k in ("class", "id", "role")).lower()
        for c in "-_:/.":
            words = words.replace(c, " ")
        self.stack.append((tag, tuple(words.split()), named.get("data-label")))
        self.hidden += tag in _HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), -1)
        if tag in _BLOCKS:
            self.cut()
        if at >= 0:
            self._pop_to(at)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.link_parts += len(data.strip())


def leaf_blocks(html: str | None) -> list[Block]:
    parser = _Leaves()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    return parser.blocks


def _path_features(path: tuple) -> list[str]:
    tags = [t for t, _ in path]
    out = {f"in {t}" for t in tags if t not in ("html", "body")} | {f"class {w}" for _, words in path for w in words}
    blocks = [t for t in tags if t in _BLOCKS] or ["none"]
    out |= {f"tag {blocks[-1]}", f"tags {' '.join(blocks[-2:])}"}
    out |= {f"near {t} {w}" for t, words in path[-3:] for w in words}
    return sorted(out)


def _text_features(block: Block, at: int, n: int) -> list[str]:
    text, words = block.text, block.text.count(" ") + 1
    out = [f"words {min(7, int(np.log2(words)))}", f"linked {min(4, 4 * block.link_chars // len(text))}", f"sentence {text[-1] in '.!?…”\"'}"]
    if "©" in text or "|" in text:
        out.append("mark")
    if at == 0 or at == n - 1:
        out.append("first" if at == 0 else "last")
    return out


@dataclass(frozen=True)
class CrfModel:
    state: dict[str, tuple[float, float]]  # feature -> weight for (other, main)
    step: tuple[tuple[float, float], tuple[float, float]]  # from, to
    start: tuple[float, float]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: Iterable[str] | None = None, steps: int = 150, ridge: float = 0.02) -> CrfModel:
    """A model of labelled pages (see :mod:`twinfold.llm.labelled_pages`; they are few and stay on the driver)."""
    chains = [b for b in map(leaf_blocks, labelled_pages() if pages is None else pages) if b]
    names: dict[str, int] = {}
    longest = max(map(len, chains))
    rows, cols, mask, gold = [], [], np.zeros((len(chains), longest), bool), np.zeros((len(chains), longest), int)
    for i, chain in enumerate(chains):
        for j, block in enumerate(chain):
            mask[i, j], gold[i, j] = True, block.label == "main"
            for f in _path_features(block.path) + _text_features(block, j, len(chain)):
                rows.append(i * longest + j)
                cols.append(names.setdefault(f, len(names)))
    rows, cols, k, total = np.array(rows), np.array(cols), len(names), mask.sum()
    theta = np.zeros(2 * k + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    hot = np.eye(2)[gold] * mask[:, :, None]
    pair_gold = np.einsum("bti,btj->ij", hot[:, :-1], hot[:, 1:])
    for t in range(1, steps + 1):
        w, step, start = theta[: 2 * k].reshape(k, 2), theta[2 * k: 2 * k + 4].reshape(2, 2), theta[2 * k + 4:]
        score = np.stack([np.bincount(rows, w[cols, s], mask.size) for s in (0, 1)], 1).reshape(*mask.shape, 2)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = start + score[:, 0]
        for j in range(1, longest):
            new = _log_sum(ahead[:, j - 1, :, None] + step, 1) + score[:, j]
            ahead[:, j] = np.where(mask[:, j, None], new, ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            new = _log_sum(step + (score[:, j + 1] + back[:, j + 1])[:, None, :], 2)
            back[:, j] = np.where(mask[:, j + 1, None], new, back[:, j + 1])
        norm = _log_sum(ahead[:, -1], 1)
        seen = np.exp(ahead + back - norm[:, None, None]) * mask[:, :, None]
        pairs = np.exp(ahead[:, :-1, :, None] + step + (score + back)[:, 1:, None, :] - norm[:, None, None, None]) * mask[:, 1:, None, None]
        off = (seen - hot).reshape(-1, 2)
        grad = np.concatenate([np.stack([np.bincount(cols, off[rows, s], k) for s in (0, 1)], 1).ravel(),
                               (pairs.sum((0, 1)) - pair_gold).ravel(), off.reshape(*mask.shape, 2)[:, 0].sum(0)]) / total + ridge / total * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w = theta[: 2 * k].reshape(k, 2)
    return CrfModel({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()},
                    tuple(map(tuple, theta[2 * k: 2 * k + 4].reshape(2, 2).tolist())), tuple(theta[2 * k + 4:].tolist()))


def viterbi(scores: list[tuple[float, float]], model: CrfModel) -> list[int]:
    """The best chain of states (0 other, 1 main)."""
    if not scores:
        return []
    (s00, s01), (s10, s11) = model.step
    a, b = model.start[0] + scores[0][0], model.start[1] + scores[0][1]
    came = []
    for x, y in scores[1:]:
        to_a, to_b = b + s10 > a + s00, b + s11 >= a + s01
        came.append((to_a, to_b))
        a, b = (b + s10 if to_a else a + s00) + x, (b + s11 if to_b else a + s01) + y
    state = int(b >= a)
    out = [state]
    for step in reversed(came):
        state = int(step[state])
        out.append(state)
    return out[::-1]


class Extractor:
    """Decodes pages; scores of ancestor paths are remembered."""

    def __init__(self, model: CrfModel):
        self.model, self.paths = model, {}

    def _sum(self, features: list[str]) -> tuple[float, float]:
        got = [self.model.state[f] for f in features if f in self.model.state]
        return sum(x for x, _ in got), sum(y for _, y in got)

    def labelled(self, html: str | None) -> list[tuple[Block, int]]:
        blocks, scores = leaf_blocks(html), []
        for at, block in enumerate(blocks):
            if block.path not in self.paths:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                self.paths[block.path] = self._sum(_path_features(block.path))
            (a, b), (c, d) = self.paths[block.path], self._sum(_text_features(block, at, len(blocks)))
            scores.append((a + c, b + d))
        return list(zip(blocks, viterbi(scores, self.model)))

    def text(self, html: str | None) -> str:
        return "\n\n".join(block.text for block, state in self.labelled(html) if state)


def extract(pages: DataFrame, model: CrfModel, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the markup."""
    rest = [c for c in pages.columns if c not in (html_column, text_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extractor.text(h.as_py()) for h in part.column(html_column)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, text_column])

    fields = pages.select(*rest).schema.fields
    return pages.select(*rest, html_column).mapInArrow(run, T.StructType([*fields, T.StructField(text_column, T.StringType())]))
