"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from credtrace.llm.html_blocks import Block, Element, read

#: Share of the text-weighted mean ratio above which a node is content; width of the smoothing in nodes.
THRESHOLD, SIGMA = 0.5, 1.0
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：¡¿«»\"'()-]")


def path_scores(blocks: list[Block], sigma: float) -> np.ndarray:
    """Per block the fused ratio of its path: text per node times punctuation per node, both smoothed in page order."""
    paths, own = np.unique([b.path for b in blocks], return_inverse=True)
    lengths = np.array([max(len(b.text) - b.linked, 0) for b in blocks], dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in blocks], dtype=float)
    nodes = np.bincount(own, minlength=len(paths))
    ratios = [np.bincount(own, v, minlength=len(paths))[own] / nodes[own] for v in (lengths, marks + 1)]
    reach = np.arange(-2, 3)
    kernel = np.exp(-reach ** 2 / (2 * sigma ** 2))
    smooth = []
    for r in ratios:
        padded = np.pad(r, 2, mode="edge")
        s = sum(k * padded[2 + j: 2 + j + len(r)] for j, k in zip(reach, kernel)) / kernel.sum()
        smooth.append(s / s.max() if s.max() > 0 else s)
    return np.sqrt(smooth[0] * smooth[1])


def common_root(elements: list[Element], nodes: list[int]) -> int:
    root = nodes[0]
    for n in nodes[1:]:
        while not root <= n <= elements[root].last:
            root = elements[root].parent
    return root


def main_blocks(elements: list[Element], blocks: list[Block], threshold: float = THRESHOLD, sigma: float = SIGMA) -> list[Block]:
    """The blocks of the article.

    Nodes whose path scores above the threshold are content. They fix where the article is: the element that holds them
    all, or, where that is the whole page, the containers that hold one. Headings, list items and other short nodes in
    there belong to it, unless they are mostly links.
    """
    if not blocks:
        return []
    lengths = np.array([len(b.text) for b in blocks], dtype=float)
    linked = np.array([b.linked for b in blocks])
    scores = path_scores(blocks, sigma)
    chosen = (scores >= threshold * (scores * lengths).sum() / lengths.sum()) & (linked * 2 <= lengths)
    if not chosen.any():
        return [b for b, link in zip(blocks, linked * 2 <= lengths) if link]
    root = common_root(elements, [b.element for b, c in zip(blocks, chosen) if c])
    while elements[root].tag not in ("#", "html", "body", "main", "article", "section", "div", "td"):
        root = elements[root].parent
    if elements[root].tag in ("#", "html", "body"):
        homes = {elements[b.element].container for b, c in zip(blocks, chosen) if c}
        inside = np.array([elements[b.element].container in homes for b in blocks])
    else:
        inside = np.array([root <= b.element <= elements[root].last for b in blocks])
    return [b for b, keep in zip(blocks, chosen | (inside & (linked * 2 <= lengths))) if keep]


def main_text(page: str) -> str:
    return "\n".join(b.text for b in main_blocks(*read(page)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from the whole html.

    Null or empty html, and pages without text outside menus, forms and the like, give an empty text. White space inside
    a block is one space, blocks are joined by a line break in page order. Repeated pages give repeated rows; null ids
    and urls are passed through; no rows give no rows; further columns are ignored. Broken pages are read as far as they
    go: open tags end with the page.
    """
    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py() or "") for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        batch, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
