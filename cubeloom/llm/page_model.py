"""Fit of the block classifier of :mod:`cubeloom.llm.html_text`.

Training pages are laid out from texts at hand: every layout puts sentences and
headings of the texts into the places that pages have for content and for
boilerplate (menus, headers, notices, adverts, sidebars, comments, forms, footers;
by element, by class name, by attribute, or by nothing but their wording), so the
label of each block is known.  A logistic regression with a quadratic penalty, by
Newton's steps, gives the weights; they are rounded and kept as ``WEIGHTS``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np

from cubeloom.llm.html_text import blocks_of, features_of

#: Places on a page: label, what stands before and after the text, and which kind of text it takes.
_PLACES = (
    (1, "<p>", "</p>", "long"),
    (1, "<h2>", "</h2>", "short"),
    (1, "<blockquote>", "</blockquote>", "sentence"),
    (1, "<ul><li>", "</li></ul>", "sentence"),
    (0, '<div class="ad">', "</div>", "sentence"),
    (0, '<div class="promo-box"><p>', "</p></div>", "long"),
    (0, "<aside><p>", "</p></aside>", "long"),
    (0, "<form><p>", "</p></form>", "short"),
    (0, '<div style="display:none">', "</div>", "long"),
    (0, '<ul><li><a href="/x">', "</a></li></ul>", "short"),
)
_ABOVE = (
    (0, "<header><h1>", "</h1></header>", "short"),
    (0, '<div class="header"><p>', "</p></div>", "sentence"),
    (0, '<nav><ul><li><a href="/">', "</a></li></ul></nav>", "word"),
    (0, '<ul class="menu"><li><a href="/">', "</a></li></ul>", "word"),
    (0, '<div id="cookie-notice"><p>', "</p></div>", "long"),
    (0, "<div hidden><p>", "</p></div>", "long"),
    (0, "<p>", "</p>", "word"),
)
_BELOW = (
    (0, '<section id="comments"><p>', "</p></section>", "long"),
    (0, '<div class="sidebar"><h3>', "</h3></div>", "short"),
    (0, "<footer>", "</footer>", "sentence"),
    (0, "<p>", "</p>", "word"),
    (0, '<p><a href="/">', "</a></p>", "short"),
)
#: What stands outside an article or main element without a word on what it is.
_UNNAMED = (
    (0, "<div><p>", "</p></div>", "long"),
    (0, "<section><p>", "</p></section>", "sentence"),
)
_BODIES = (("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ("<div>", "</div>"), ("", ""))


def laid_out(texts: list[str], seed: int, pages: int) -> Iterator[tuple[str, list[int]]]:
    """Pages and the labels of their blocks."""
    rng = random.Random(seed)
    words = [w for w in (t.split() for t in texts) if len(w) >= 20]

    def piece(kind: str) -> str:
        source = rng.choice(words)
        size = {"word": rng.randint(1, 2), "short": rng.randint(2, 7), "sentence": rng.randint(3, 14), "long": rng.randint(8, 70)}[kind]
        at = rng.randint(0, max(0, len(source) - size))
        found = " ".join(source[at : at + size]).replace("&", "&amp;").replace("<", "&lt;").rstrip(".!?\"”…,;:") or "x"
        # Menus and headings end like a sentence now and then, and sentences without a mark.
        return found + ("." if rng.random() < (0.1 if kind in ("word", "short") else 0.75) else "")

    for _ in range(pages):
        parts, labels = [], []
        opening, closing = rng.choice(_BODIES)
        unnamed = _UNNAMED if opening in ("<article>", "<main>") else ()
        for places, low, high in ((_ABOVE + unnamed, 1, 4), (_PLACES, 3, 9), (_BELOW + unnamed, 1, 3)):
            parts.append(opening if places is _PLACES else "")
            if places is _PLACES:
                parts.append(f"<h1>{piece('short')}</h1><p>{piece('long')}</p>")
                labels += [1, 1]
            for label, before, after, kind in rng.choices(places, k=rng.randint(low, high)):
                parts.append(before + piece(kind) + after)
                labels.append(label)
            parts.append(closing if places is _PLACES else "")
        yield f"<html><body>{''.join(parts)}</body></html>", labels


def fit_weights(pages: list[tuple[str, list[int]]], penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """The weights of the block features, one decimal each."""
    x, y = [], []
    for page, labels in pages:
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            x += [features_of(b) for b in blocks]
            y += labels
    x, y = np.array(x), np.array(y, dtype=float)
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - penalty * weights
        weights = weights + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(weights)), slope)
    return np.round(weights, 1)
