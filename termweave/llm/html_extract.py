"""Main-text extraction by minimum-cut labelling.

Every text block of a page is a node.  A logistic model of its features gives the cost of calling it
content or boilerplate (the capacities to the terminals); neighbours in page order and blocks near
each other in the element tree are tied by smoothness edges.  The minimum cut is the cheapest
labelling of all blocks together.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.html_blocks import APART, ARTICLE, FEATURES, FORM, HEADING, HIDDEN, HINT_OUT, MAIN, Block, blocks

#: Where the fit starts from and is drawn to, in the order of FEATURES; with no pages to learn from it stays.
PRIOR = np.array([-1.0, 3.0, 2.0, -5.0, -5.0, 0.7, 1.0, 0.8, -0.7, -4.0, -6.0, 0.8, -3.0, 0.5])
ADJACENT, SIBLING, HEADED, CONTRAST = 0.8, 0.6, 1.2, 0.2
#: Blocks that differ in one of these are tied by CONTRAST of what they would be.
PARTS = ARTICLE | MAIN | APART | HINT_OUT | FORM | HIDDEN


def weak_labels(pages: list[list[str]], several: int = 3, words: int = 15) -> list[list[int | None]]:
    """Labels of the texts of pages that don't look at the markup.

    0 where a text stands on ``several`` pages (a template's), 1 where one of at least ``words`` words
    stands on one page only (it was written for it), else unknown.
    """
    on = Counter(t for page in pages for t in set(page))
    return [[0 if on[t] >= several else 1 if on[t] == 1 and t.count(" ") + 1 >= words else None for t in page] for page in pages]


def fit_costs(x: np.ndarray, y: np.ndarray, hide: float = 0.4, copies: int = 4, pull: float = 0.05, seed: int = 5) -> np.ndarray:
    """Logistic weights near PRIOR; in copies of the rows the structural features are hidden, so that no single one must tell all.

    Labels are given by length and repetition, so the weights of length and sentence end, which they
    would bias, and the constant stay; the others are fitted, but not below half of their PRIOR.
    """
    if len(y) == 0:
        return PRIOR.copy()
    rng = np.random.RandomState(seed)
    x, y = np.tile(x, (copies, 1)), np.tile(y, copies)
    x[:, 1:11] *= (rng.rand(len(x)) >= hide)[:, None]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    free = np.array([f not in ("bias", "words", "sentence") for f in FEATURES])
    w = PRIOR.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(((np.logaddexp(0, z) - y * z) * weight).sum() + pull / 2 * ((w - PRIOR) ** 2).sum())

    for _ in range(20):  # Newton steps, halved while they don't help
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = (x.T @ ((p - y) * weight) + pull * (w - PRIOR))[free]
        hess = ((x * (weight * p * (1 - p))[:, None]).T @ x)[np.ix_(free, free)] + pull * np.eye(free.sum())
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(hess, grad)
        while np.abs(step).max() > 1e-6 and loss(w - step) > loss(w):
            step /= 2
        w = w - step
    return np.where(w * np.sign(PRIOR) < np.abs(PRIOR) / 2, PRIOR / 2, w)


def min_cut(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise sum of |gain| lost where a label goes against it plus the ties cut.

    Nodes whose gain outweighs all their ties are settled first; the rest is a maximum flow
    (shortest augmenting paths over level graphs).  Equal costs go to boilerplate.
    """
    n = len(gain)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in ties:
        if a != b and c > 0:
            near[a].append((b, c))
            near[b].append((a, c))
    pull = [sum(c for _, c in near[i]) for i in range(n)]
    gain = list(gain)
    label: list[bool | None] = [None] * n
    queue = deque(i for i in range(n) if abs(gain[i]) > pull[i] or not near[i])
    while queue:
        i = queue.popleft()
        if label[i] is not None:
            continue
        label[i] = gain[i] > 0
        for j, c in near[i]:
            if label[j] is None:
                gain[j] += c if label[i] else -c
                pull[j] -= c
                if abs(gain[j]) > pull[j]:
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    index = {i: k + 2 for k, i in enumerate(rest)}
    to, cap, edges = [], [], [[] for _ in range(len(rest) + 2)]

    def add(u: int, v: int, c: float, back: float) -> None:
        edges[u].append(len(to))
        to.append(v)
        cap.append(c)
        edges[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in rest:
        if gain[i] > 0:
            add(0, index[i], gain[i], 0.0)
        elif gain[i] < 0:
            add(index[i], 1, -gain[i], 0.0)
        for j, c in near[i]:
            if j > i and label[j] is None:
                add(index[i], index[j], c, c)
    tiny = 1e-9
    while True:
        level = [-1] * len(edges)
        level[0] = 0
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for e in edges[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[1] < 0:
            break
        turn = [0] * len(edges)
        path: list[int] = []
        u = 0
        while True:
            if u == 1:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path, u = [], 0
                continue
            while turn[u] < len(edges[u]):
                e = edges[u][turn[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(edges[u]):
                path.append(edges[u][turn[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                break
    for i in rest:
        label[i] = level[index[i]] >= 0
    return label


def content(page: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks of a page are main text."""
    if not page:
        return []
    gain = (np.array([b.features() for b in page]) @ weights).tolist()
    ties: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}  # the last block of each parent element

    def tie(i: int, j: int, c: float) -> None:
        ties.append((i, j, c * CONTRAST if (page[i].flags ^ page[j].flags) & PARTS else c))

    for i, b in enumerate(page):
        if i:
            heads = page[i - 1].flags & HEADING and not b.flags & HEADING  # a heading belongs to what follows it
            tie(i - 1, i, HEADED if heads else ADJACENT * 2.0 ** -max(0, page[i - 1].node.apart(b.node) - 2))
        parent = id(b.node.parent)
        if parent in last:
            tie(last[parent], i, SIBLING)
        last[parent] = i
    return min_cut(gain, ties)


def _extract(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html in batch.column(2):
                page = blocks(html.as_py() or "")
                texts.append("\n".join(b.text for b, keep in zip(page, content(page, weights)) if keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def learn(pages: DataFrame, max_pages: int = 300, max_chars: int = 100_000, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Costs fitted on at most ``max_pages`` pages of at most ``max_chars`` characters, taken by a hash of the id; see :func:`weak_labels`."""
    some = pages.select(F.col(html_col).cast("string").alias("html"), F.col(id_col).cast("string").alias("i")).where(f"length(html) <= {max_chars}")
    some = some.select("html", F.xxhash64("i").alias("r"), "i").orderBy("r", "i", "html").limit(max_pages)
    seen = [blocks(r["html"]) for r in some.select("html").collect()]
    x, y = [], []
    for page, labels in zip(seen, weak_labels([[b.text for b in page] for page in seen])):
        for b, label in zip(page, labels):
            if label is not None:
                x.append(b.features())
                y.append(label)
    return fit_costs(np.array(x).reshape(-1, len(FEATURES)), np.array(y))


def extract_text(pages: DataFrame, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row.

    Blocks labelled content are joined in page order by one newline.  A null or empty page, or one
    without content, has an empty text; null ids and urls are kept; repeated rows are treated each;
    an empty table gives no rows.
    """
    weights = learn(pages, id_col=id_col, html_col=html_col) if weights is None else weights
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(_extract(weights), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
