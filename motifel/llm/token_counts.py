"""Token counts by offset-mapped attribution.

A document is the text of its fields joined by one \\n, and is encoded once as a whole. The
character spans of its tokens are joined to the spans of its sections (an interval join of
two sorted lists), and each token is counted in just one section:

* a token inside one section counts there;
* a token over a boundary counts in the section that holds most of its characters, and of
  equal shares in the earliest one;
* characters that belong to no section (the \\n between fields) join the section before them.

So the counts of the sections add up to the count of the document.

Encoding. The tokenizer first takes its added tokens (such as an end of text) out of a text;
what stands between them is cut, each stretch on its own, into units: a run of no white space
with the one space before it, or white space. No token crosses their ends. Each different unit
is encoded once with the tokenizer and remembered with the offsets of its tokens, so a document
is encoded exactly as by one call for the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifel.llm import common
from motifel.llm.units import Memory

#: White space as Unicode's property has it, which is that of the tokenizer's own pattern.
_WS = "\t-\r \x85\xa0  -     　"
_UNITS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_SENTENCE = re.compile(f"[.!?]+[{_WS}]+|\n+")
#: Different units that a worker remembers.
REMEMBERED = 400_000


class Units(Memory):
    """Numbers of tokens of units, and offsets of those that are asked for."""

    def __init__(self, path: str):
        super().__init__(path, str, len, REMEMBERED)
        self.spans: dict[str, list[tuple[int, int]]] = {}
        self.added = re.compile("(" + "|".join(map(re.escape, self.bpe.added)) + ")") if self.bpe.added else None

    def cut(self, text: str) -> list[str]:
        """The units of a text, in order and without gaps."""
        if self.added is None or not any(t in text for t in self.bpe.added):
            return _UNITS.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.added.split(text)):
            out += [part] if i % 2 else _UNITS.findall(part)
        return out

    def offsets(self, unit: str) -> list[tuple[int, int]]:
        if unit not in self.spans:
            if len(self.spans) > REMEMBERED // 4:
                self.spans.clear()
            self.spans[unit] = self.bpe.tokenizer.encode(unit, add_special_tokens=False).offsets
        return self.spans[unit]


@lru_cache(1)
def _units(path: str) -> Units:
    """One memory for all tasks of a worker process."""
    return Units(path)


def sentence_ends(text: str) -> list[int]:
    """Ends of sections: after a sentence with the white space that follows it, or after line ends; the last is the text's."""
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def attribute(units: list[str], known: dict[str, int], offsets, ends: list[int]) -> tuple[list[int], int]:
    """Tokens of each section, which end at ``ends``, and how many tokens cross a boundary."""
    bounds = np.array(ends, np.int64)
    length = np.fromiter(map(len, units), np.int64, len(units))
    tokens = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
    end = np.cumsum(length)
    first = np.searchsorted(bounds, end - length, "right")
    last = np.searchsorted(bounds, end - 1, "right")
    inside = first == last
    counts = np.bincount(first[inside], tokens[inside], len(ends)).astype(np.int64)
    crossing = 0
    for i in np.flatnonzero(~inside).tolist():
        base = int(end[i] - length[i])
        for a, b in offsets(units[i]):
            a, b = base + a, base + max(b, a + 1)
            k = bisect_right(ends, a)
            if b > ends[k]:
                crossing += 1
                share = [min(b, ends[j]) - max(a, ends[j - 1] if j else 0) for j in range(k, bisect_right(ends, b - 1) + 1)]
                k += share.index(max(share))
            counts[k] += 1
    return counts.tolist(), crossing


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("field_sections", pa.list_(pa.int32())), ("section_tokens", pa.list_(pa.int32()))])


def _count(path: str, fields: list[str], split: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _units(path)
        for b in batches:
            columns = [[x or "" for x in b.column(f"f{i}").to_pylist()] for i in range(len(fields))]
            rows, docs, new = [], [], set()
            for parts in zip(*columns, strict=True):
                ends, sizes, at = [], [], 0
                for i, part in enumerate(parts):
                    own = sentence_ends(part) if fields[i] in split else [len(part)]
                    ends += [at + e for e in own]
                    sizes.append(len(own))
                    at += len(part) + 1
                    if i + 1 < len(parts):
                        ends[-1] += 1  # the \n joins the section before it
                units = memory.cut("\n".join(parts))
                new.update(units)
                docs.append((units, ends, sizes))
            memory.learn(new)
            for doc_id, (units, ends, sizes) in zip(b.column("doc_id").to_pylist(), docs, strict=True):
                counts, crossing = attribute(units, memory.known, memory.offsets, ends)
                rows.append((doc_id, sum(counts), crossing, sizes, counts))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def token_counts(docs: DataFrame, tokenizer: str, fields: tuple[str, ...] = ("text",), split: tuple[str, ...] = ("text",), id_col: str = "doc_id") -> DataFrame:
    """A row per document: id, n_tokens, n_crossing, field_sections, section_tokens.

    tokenizer: path of a byte-level BPE file of the tokenizers library, which workers can read.
    fields: the columns that make up the document, in order; those in split are divided into
    sentences, others are one section. field_sections: sections of each field; section_tokens:
    tokens of each section in order, which add up to n_tokens; n_crossing: tokens over a
    boundary. Every field has at least one section; a null counts as empty, so an empty
    document of one field has one section of 0 tokens. Rows that repeat an id are counted
    each. An empty table gives an empty result.
    """
    common.bound_batches(docs.sparkSession)
    base = docs.select(common.internal_id(id_col).alias("doc_id"), *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    schema = "doc_id long, n_tokens long, n_crossing long, field_sections array<int>, section_tokens array<int>"
    return base.mapInArrow(common.tidy(_count(tokenizer, list(fields), list(split))), schema).withColumn("doc_id", common.public_id("doc_id"))
