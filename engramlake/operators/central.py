"""A summariser without a model: the sentences most central to a text.

Sentences are linked by the words they share; a walk that follows links, and now and then starts anew,
says how central each is. The links are never laid out: sentences and words are two sides of a graph,
and a step goes from sentences to words and back, so memory grows with the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from ..model import L1_OUTPUT

#: The share of steps that follow links, the most steps, and the change below which they end.
DAMPING, STEPS, CLOSE = 0.85, 100, 1e-10
_SENTENCE, _WORD, _MARKUP = re.compile(r"[^.!?\n]+[.!?]*"), re.compile(r"\w+"), re.compile(r"^[#>*\s-]+")


def sentences(text: str) -> list[str]:
    """The sentences of a text, of one line each, without Markdown marks in front; those without words go."""
    found = (_MARKUP.sub("", m.group()).strip() for m in _SENTENCE.finditer(text))
    return [s for s in found if _WORD.search(s)]


def centrality(found: list[str]) -> np.ndarray:
    """How central each sentence is; the sum is 1. A sentence that shares no word with another has its share of the new starts alone."""
    n = len(found)
    words: dict[str, int] = {}
    lists = [sorted({words.setdefault(w, len(words)) for w in _WORD.findall(s.lower())}) for s in found]
    size = np.array([len(x) for x in lists], np.int64)
    row, column = np.repeat(np.arange(n), size), np.concatenate([np.array(x, np.int64) for x in lists]) if n else np.zeros(0, np.int64)
    weight = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)

    def linked(x: np.ndarray) -> np.ndarray:
        """The cosine of every two sentences' words, but their own, times x."""
        there = np.bincount(column, weights=weight * x[row], minlength=len(words))
        return np.bincount(row, weights=weight * there[column], minlength=n) - x

    degree = np.maximum(linked(np.ones(n)), 0) if n else np.zeros(0)
    degree[degree < 1e-12] = 0
    share = np.divide(1.0, degree, out=np.zeros(n), where=degree > 0)
    x = np.full(n, 1 / max(n, 1))
    for _ in range(STEPS):
        walk = np.maximum(linked(x * share), 0)
        y = (1 - DAMPING) / max(n, 1) + DAMPING * (walk + x[degree == 0].sum() / max(n, 1))
        if np.abs(y - x).sum() < CLOSE:
            return y
        x = y
    return x


def overview(title: str | None, text: str | None, most: int = 4 * L1_OUTPUT, part: float = 0.2) -> str:
    """The title and the most central sentences in the order of the text: a fifth of them, three at least, as far as they fit. Of equally central ones (to nine places) the earlier comes first; equal sentences count once."""
    found = list(dict.fromkeys(sentences(text or "")))
    score = centrality(found)
    order = sorted(range(len(found)), key=lambda i: (-round(float(score[i]), 9), i))[: max(3, int(part * len(found)))]
    head = f"# {title or ''}".strip()
    left, kept = most - len(head) - 2, []
    for i in order:
        if len(found[i]) + 1 <= left:
            kept.append(i)
            left -= len(found[i]) + 1
    return f"{head}\n\n{' '.join(found[i] for i in sorted(kept))}".strip()


@F.pandas_udf(T.StringType())
def _overviews(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for titles, texts in parts:
        yield pd.Series([overview(a, b) for a, b in zip(titles, texts, strict=True)], dtype=object)


def central(title: Column, path: Column, doc_type: Column, content: Column) -> tuple[Column, Column]:
    """A summariser for ``DocumentStore``: no abstract of its own (the fallback stands in), and as overview the most central sentences. The package must have been sent (``session.ship``)."""
    return F.lit(""), E.strip(_overviews(title, content))
