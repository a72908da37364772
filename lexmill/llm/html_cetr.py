"""Main-text extraction by text-to-tag ratios.

Each page runs once through the standard library's streaming HTML parser.  Its
events fill *lines*, which end at line ends of the source and at block-level
tags; a line's ratio is its text characters over its tags (at least one).  The
ratios are smoothed by a Gaussian and split into two clusters by one-dimensional
2-means; lines in the upper cluster are content.

What stands in scripts, styles, heads and the like is no line.  Such an element
has to be closed: one that isn't (but for scripts and styles, which swallow the
page in a browser too) hides nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import need

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = frozenset("head script style noscript template svg iframe object textarea".split())
#: Silent up to the page's end if they aren't closed.
_RAW_TAGS = frozenset(("script", "style"))
#: What a head may hold; any other tag ends it.
_HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Smoothing:
    """Standard deviation of the Gaussian in lines, and its reach in deviations."""

    sigma: float = 1.0
    reach: float = 3.0


class _Lines(HTMLParser):
    """Collects (text, number of tags) by line.

    A silent element is read like any other, and taken back when it is closed.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.parts: list[str] = []
        self.count = 0
        self.open: list[tuple[str, int, list[str], int]] = []  # silent elements, and what there was before them

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text or self.count:
            self.texts.append(text)
            self.tags.append(self.count)
        self.parts, self.count = [], 0

    def take_back(self, k: int) -> None:
        """To what there was before the k-th open silent element."""
        _, n, self.parts, self.count = self.open[k]
        del self.texts[n:], self.tags[n:], self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:  # noqa: ARG002
        if tag == "body" or (self.open and self.open[-1][0] == "head" and tag not in _HEAD_TAGS):
            heads = [k for k, x in enumerate(self.open) if x[0] == "head"]
            if heads:
                self.take_back(heads[0])
        if tag in SILENT_TAGS:
            self.open.append((tag, len(self.texts), self.parts, self.count))
            self.parts, self.count = [], 0
            return
        if tag in BLOCK_TAGS:
            self.flush()
        self.count += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in SILENT_TAGS:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS:
            own = [k for k, x in enumerate(self.open) if x[0] == tag]
            if own:
                self.take_back(own[-1])
            return
        self.count += 1
        if tag in BLOCK_TAGS:
            self.flush()

    def handle_data(self, data: str) -> None:
        head, *rest = data.split("\n")
        self.parts.append(head)
        for line in rest:
            self.flush()
            self.parts.append(line)

    def finish(self) -> None:
        raw = [k for k, x in enumerate(self.open) if x[0] in _RAW_TAGS]
        if raw:
            self.take_back(raw[0])
        kept = [part for x in self.open for part in x[2]]
        counts = sum(x[3] for x in self.open)
        self.parts, self.count = kept + self.parts, counts + self.count
        self.flush()


_OPENERS = re.compile(r"<[!?/a-zA-Z]")


def closable(html: str) -> tuple[str, str]:
    """(what the parser can read in one go, the text after the last tag).

    After the last ``>`` no tag can end, and a comment that isn't closed is no
    comment: fed as they are, each start of one would make the parser search the
    rest of the page.
    """
    stop = html.rfind(">") + 1
    last = html.rfind("-->", 0, stop)
    head, tail = html[:stop], html[stop:]
    if "<!--" in head[max(0, last) :]:
        cut = max(0, last)
        head = head[:cut] + head[cut:].replace("<!--", "")
    for opener, closer in (("<?", ">"), ("<![", "]"), ("<!", ">")):
        cut = head.rfind(closer) + 1
        if opener in head[cut:]:
            head = head[:cut] + head[cut:].replace(opener, "")
    return head, unescape(_OPENERS.split(tail, maxsplit=1)[0])


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """Text and number of tags of every line of a page."""
    parser = _Lines()
    head, tail = closable(html)
    parser.feed(head)
    parser.close()
    if tail and not (parser.open and parser.open[-1][0] in _RAW_TAGS):
        parser.handle_data(tail)
    parser.finish()
    return parser.texts, parser.tags


def smooth(ratios: np.ndarray, s: Smoothing) -> np.ndarray:
    """Gaussian mean of neighbouring lines; at the ends the kernel is renormalised."""
    radius = int(np.ceil(s.sigma * s.reach))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / s.sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """The boundary of the best split into two clusters (least squared error), found exactly."""
    x = np.sort(values)
    if len(x) < 2 or x[0] == x[-1]:
        return float(x[0]) if len(x) else 0.0
    total = np.cumsum(x)
    n = np.arange(1, len(x))
    gain = total[:-1] ** 2 / n + (total[-1] - total[:-1]) ** 2 / (len(x) - n)
    gain[x[1:] == x[:-1]] = -1.0
    k = int(np.argmax(gain))
    return float((x[k] + x[k + 1]) / 2)


def content_mask(texts: list[str], tags: list[int], s: Smoothing) -> np.ndarray:
    """Which lines are content.

    The ratios are clustered on a logarithmic scale, so that one very long
    paragraph doesn't hide shorter ones.
    """
    length = np.array([len(t) for t in texts], dtype=np.float64)
    ratio = np.log1p(length / np.maximum(1, np.array(tags, dtype=np.float64)))
    smoothed = smooth(ratio, s)
    return (smoothed >= threshold(smoothed)) & (length > 0)


def _extract(s: Smoothing):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lines, kept = [], [], []
            for html in batch.column("html"):
                if not html.is_valid:
                    out.append(None)
                    lines.append(0)
                    kept.append(0)
                    continue
                page = html.as_py()
                texts, tags = page_lines(page.decode("utf-8", "replace") if isinstance(page, bytes) else page)
                mask = content_mask(texts, tags, s) if texts else np.zeros(0, dtype=bool)
                out.append("\n".join(t for t, k in zip(texts, mask, strict=True) if k))
                lines.append(len(texts))
                kept.append(int(mask.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, type=pa.string()), pa.array(lines, type=pa.int32()), pa.array(kept, type=pa.int32())],
                names=["page_id", "url", "text", "n_lines", "n_content"],
            )

    return run


def extract_pages(pages: DataFrame, s: Smoothing = Smoothing()) -> DataFrame:  # noqa: B008
    """(page_id, url, text, n_lines, n_content) of every row of ``pages``; narrow, no shuffle.

    Binary HTML is read as UTF-8, with a mark for bytes that aren't.  Null HTML
    gives a null text; empty HTML, or HTML without text, gives an empty
    text.  A page of one line, or of equal ratios, is content throughout.
    Malformed markup is read as the parser recovers it; a tag that never ends is dropped.
    """
    need(pages, "page_id", "url", "html")
    schema = T.StructType(
        [
            T.StructField("page_id", pages.schema["page_id"].dataType),
            T.StructField("url", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("n_lines", T.IntegerType()),
            T.StructField("n_content", T.IntegerType()),
        ]
    )
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(_extract(s), schema)
