"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree of hidden labels, main or other. A
parent's and a child's label share a potential, which depends on the child's
kind: its tag, length and links; its names give evidence besides. Sum-product messages pass upward and then
downward once, and a text run is kept if its element's marginal favours main.
All potentials are counted on labelled pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import html_training
from starloom.llm.common import free_name
from starloom.llm.html_tree import Node, parse

NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that are never main text, whatever surrounds them.
NEVER = frozenset("nav footer aside form button select option dialog menu".split())


def kind(node: Node) -> str:
    """An element's tag with how much text of its own it holds and whether links make it up."""
    if not node.text:
        return f"{node.tag} empty"
    size = "short" if node.text < 40 else "middle" if node.text < 160 else "long"
    return f"{node.tag} {size}{' linked' if 2 * node.link > node.text else ''}"


def names(node: Node) -> list[str]:
    """The words of an element's id, classes and roles."""
    return sorted({w.lower().removesuffix("s") for w in NAME.findall(node.names)})


class Model:
    """Log potentials: of the root, of (parent, child, the child's kind), and of each name by label; 0 other, 1 main."""

    def __init__(self, pages: list[str]):
        pair, root, seen, total, kinds = Counter(), Counter(), Counter(), Counter(), Counter()
        for page in pages:
            nodes, _ = parse(page)
            for node in nodes:
                label = int(node.mark == "1")
                if node.parent < 0:
                    root[label] += 1
                else:
                    above = int(nodes[node.parent].mark == "1")
                    pair[above, label] += 1
                    kinds[above, label, kind(node)] += 1
                own = names(node)
                total[label] += bool(own)
                for e in own:
                    seen[e, label] += 1
        self.root = [math.log((root[x] + 1) / (sum(root.values()) + 2)) for x in (0, 1)]
        known = {k for _, _, k in kinds}
        steps = [[(pair[a, b] + 1) / (pair[a, 0] + pair[a, 1] + 2) for b in (0, 1)] for a in (0, 1)]
        #: By kind: [parent][child]; a kind never seen has the labels' own step.
        self.pair = {k: [[math.log(steps[a][b] * (kinds[a, b, k] + 0.5) / (pair[a, b] + 0.5 * len(known))) for b in (0, 1)] for a in (0, 1)] for k in known}
        self.step = [[math.log(x) for x in row] for row in steps]
        # A name seen under neither label says nothing.
        self.seen = {e: tuple(math.log((seen[e, x] + 0.5) / (total[x] + 1)) for x in (0, 1)) for e in {e for e, _ in seen}}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of main for every element."""
        n = len(nodes)
        up = [[0.0, 0.0] for _ in range(n)]
        for i, node in enumerate(nodes):
            for e in names(node):
                if e in self.seen:
                    up[i][0] += self.seen[e][0]
                    up[i][1] += self.seen[e][1]
            if node.tag in NEVER or "hidden-element" in node.names:
                up[i][1] -= 30
        pair = [self.pair.get(kind(node), self.step) for node in nodes]
        message = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # upward: children come after their parents
            message[i] = tuple(_sum(pair[i][a][0] + up[i][0], pair[i][a][1] + up[i][1]) for a in (0, 1))
            parent = up[nodes[i].parent]
            parent[0] += message[i][0]
            parent[1] += message[i][1]
        full = [None] * n
        full[0] = (up[0][0] + self.root[0], up[0][1] + self.root[1])
        for i in range(1, n):  # downward: what the parent knows without this child
            p = full[nodes[i].parent]
            rest = (p[0] - message[i][0], p[1] - message[i][1])
            full[i] = tuple(up[i][b] + _sum(rest[0] + pair[i][0][b], rest[1] + pair[i][1][b]) for b in (0, 1))
        return [1 / (1 + math.exp(max(-700, min(700, a - b)))) for a, b in full]


def _sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


@cache
def trained() -> Model:
    return Model(html_training.pages())


def main_text(page: str | None, model: Model | None = None) -> str:
    """The page's main text blocks, joined by an empty line; '' for null, empty or textless pages."""
    nodes, blocks = parse(page or "")
    p = (model or trained()).marginals(nodes)
    return "\n\n".join(text for at, text in blocks if p[at] > 0.5)


def extract(pages: DataFrame, html_col: str = "html", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The columns of ``pages`` but its html, with ``text`` and ``chars`` (code points) added.

    Null and empty pages give empty text. Other columns pass through, repeated
    rows give equal rows, and a new name that a column has gets underscores
    before it. No rows: no rows.
    """
    others = pages.drop(html_col)
    text, chars = free_name(others, text), free_name(others, chars)
    keys = [c for c in pages.columns if c != html_col]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keys), f"`{text}` string", f"`{chars}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(html_col))
            texts = [main_text(x.as_py(), model) for x in source]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keys), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, text, chars])

    return pages.select(*keys, F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, schema)
