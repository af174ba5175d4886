"""Main text of web pages: gradient-boosted trees over the nodes of the page, decoded as a tree.

The trees give for each node the probability that its subtree holds main text. They learn from
``TRAIN_PAGES`` generated pages (html_pages), a fixed number, in the driver; the model is small
and goes to the workers with the task. Decisions are decoded for the page as a whole (dom.decode),
so no node is kept below one that is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifel.llm import common
from motifel.llm.boosting import Trees, boost
from motifel.llm.dom import Page, decode, features
from motifel.llm.html_pages import pages

TRAIN_PAGES = 500
"""Generated pages that the trees learn from."""
SILENT_EACH = 3
"""Of so many of them one more copy without classes, ids and roles."""
NODES_AT_ONCE = 20_000
_SILENT = re.compile(r' (?:class|id|role)="[^"]*"')


def labels(page: Page) -> np.ndarray:
    """1 for each node with marked text in its subtree; the nearest mark above a text decides."""
    n = len(page.tags)
    marked, y = [0] * n, np.zeros(n)
    for i in range(n):
        p = page.parents[i]
        marked[i] = marked[p] if p >= 0 else 0
        if page.marks[i]:
            marked[i] = int('data-main="1"' in page.marks[i])
        if marked[i] and page.texts[i]:
            y[i] = 1
    for i in range(n - 1, 0, -1):
        y[page.parents[i]] = max(y[page.parents[i]], y[i])
    return y


@lru_cache(2)
def trained(n_pages: int = TRAIN_PAGES, seed: int = 11) -> Trees:
    sources = pages(n_pages, seed)
    made = [Page(h) for h in sources + [_SILENT.sub("", h) for h in sources[:: SILENT_EACH]]]
    x = np.concatenate([features(p) for p in made]).astype(np.float64)
    y = np.concatenate([labels(p) for p in made])
    # Each page counts alike, not by its number of nodes.
    weight = np.concatenate([np.full(len(p.tags), 40 / (20 + len(p.tags))) for p in made])
    return boost(x, y, trees=110, depth=6, rate=0.2, weight=weight, columns=0.4)


def main_texts(sources: list[str], model: Trees) -> list[str]:
    """The text of the kept leaves of each page, in page order, joined by \\n."""
    out: list[str] = []
    waiting: list[Page] = []

    def settle() -> None:
        if not waiting:
            return
        p = model.probabilities(np.concatenate([features(x) for x in waiting]))
        at = 0
        for page in waiting:
            n = len(page.tags)
            kept = decode(page.parents, p[at : at + n])
            out.append("\n".join(t for t, k in zip(page.texts, kept.tolist(), strict=True) if k and t))
            at += n
        waiting.clear()

    nodes = 0
    for s in sources:
        waiting.append(Page(s))
        nodes += len(waiting[-1].tags)
        if nodes > NODES_AT_ONCE:
            settle()
            nodes = 0
    settle()
    return out


def _extract(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = main_texts([x or "" for x in b.column("html").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract_main_text(web: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars.

    text: the article without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, markup and reader comments; character references decoded, white space
    inside a block one space, blocks in page order joined by one \\n; empty if there is none.
    n_chars: its code points. Null or empty html gives the empty text; null ids and urls stay.
    Rows that repeat are each extracted. Broken markup is read as far as it goes. An empty
    table gives an empty result.
    """
    common.bound_batches(web.sparkSession)
    base = web.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    kind = dict(base.dtypes)["page_id"]
    return base.mapInArrow(common.tidy(_extract(trained())), f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
