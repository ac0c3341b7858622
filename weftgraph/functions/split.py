"""Text splitters: fixed and token windows as expressions, recursive splitters as Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftgraph.functions import text as tx

#: Separators of each splitter, tried from coarse to fine.
PLAIN = ("\n\n", "\n", " ", "")
CHINESE = ("\n\n", "\n", "。|！|？", r"\.\s|\!\s|\?\s", "；|;\\s", "，|,\\s")
MARKDOWN = ("\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", "")


def fixed_windows(text: Column, width: int = 512) -> Column:
    """Character windows of ``width``; none for an empty text."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(width)))
    return F.coalesce(F.transform(starts, lambda i: F.substring(text, i, F.lit(width))), F.array().cast("array<string>"))


def token_windows(tokens: Column, most: int = 1024, overlap: int = 128) -> Column:
    """array<struct<ord,tokens,n>> of windows that advance by ``most - overlap`` tokens."""
    step = most - overlap
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step)))
    return F.transform(starts, lambda i: F.struct((i / step).cast("int").alias("ord"), F.slice(tokens, i + 1, F.lit(most)).alias("tokens"), F.least(F.lit(most), F.size(tokens) - i).alias("n")))


@dataclass(frozen=True)
class Splitter:
    """A recursive splitter.

    Text is cut at the first separator that occurs in it; pieces shorter than
    ``size`` are packed greedily, longer ones cut by the finer separators. With
    ``keep`` "start" or "end" the separator stays with the piece behind or
    before it.
    """

    separators: tuple[str, ...] = PLAIN
    size: int = 1024
    overlap: int = 100
    keep: str = "start"
    regex: bool = False
    squeeze: bool = False
    length: Callable[[str], int] = len

    def _pieces(self, text: str, separator: str) -> list[str]:
        if not separator:
            return list(text)
        pattern = re.compile(separator if self.regex else re.escape(separator))
        cuts, at = [], 0
        for m in pattern.finditer(text):
            if m.start() == m.end():
                continue
            if self.keep == "end":
                cuts.append(text[at : m.end()])
                at = m.end()
            else:
                cuts.append(text[at : m.start()])
                at = m.start() if self.keep == "start" else m.end()
        cuts.append(text[at:])
        return [c for c in cuts if c]

    def pack(self, parts: Sequence[str], glue: str) -> Iterator[str]:
        """Runs of parts up to ``size``; each run starts with up to ``overlap`` of the last one's end."""
        gap, ends = self.length(glue), [0, *accumulate(map(self.length, parts))]
        width = lambda a, b: ends[b] - ends[a] + gap * max(0, b - a - 1)
        first = 0
        for last in range(1, len(parts) + 1):
            if first < last - 1 and width(first, last) > self.size:
                yield glue.join(parts[first : last - 1])
                first = next(a for a in range(first + 1, last) if a == last - 1 or width(a, last - 1) <= self.overlap and width(a, last) <= self.size)
        yield glue.join(parts[first:])

    def _occurs(self, level: int, text: str) -> bool:
        s = self.separators[level]
        return not s or bool(re.search(s if self.regex else re.escape(s), text))

    def _step(self, text: str, level: int) -> Iterator[tuple[str, int | None]]:
        """What cutting at the first separator from ``level`` on gives: finished chunks, and pieces for the level named."""
        coarse = range(level, len(self.separators) - 1)
        at = next((k for k in coarse if self._occurs(k, text)), len(self.separators) - 1)
        finer = at + 1 if at in coarse and self.separators[at] else None
        glue = "" if self.keep else self.separators[at]
        for short, pieces in groupby(self._pieces(text, self.separators[at]), lambda x: self.length(x) < self.size):
            yield from ((x, None) for x in self.pack(list(pieces), glue)) if short else ((x, finer) for x in pieces)

    def _cut(self, text: str) -> Iterator[str]:
        todo: list[tuple[str, int | None]] = [(text, 0)]
        while todo:
            piece, level = todo.pop()
            if level is None:
                yield piece
            else:
                todo += [*self._step(piece, level)][::-1]

    def split(self, text: str) -> list[str]:
        out = [c.strip() for c in self._cut(text or "")]
        if self.squeeze:
            out = [re.sub("\n{2,}", "\n", c) for c in out]
        return [c for c in out if c]


def recursive(size: int = 1024, overlap: int = 100) -> Splitter:
    return Splitter(PLAIN, size, overlap)


def chinese(size: int = 1024, overlap: int = 100) -> Splitter:
    return Splitter(CHINESE, size, overlap, keep="end", regex=True, squeeze=True)


def markdown(size: int = 1024, overlap: int = 100) -> Splitter:
    return Splitter(MARKDOWN, size, overlap, regex=True)


@dataclass(frozen=True)
class CharacterSplitter(Splitter):
    """One separator; pieces are packed whatever their length."""

    separators: tuple[str, ...] = ("\n\n",)
    keep: str = ""

    def split(self, text: str) -> list[str]:
        parts = self._pieces(text or "", self.separators[0])
        return [c.strip() for c in self.pack(parts, "" if self.keep else self.separators[0]) if c.strip()]


def split_udf(by_language: dict[str, Splitter]):
    """An Arrow UDF (text, language) -> array of chunks."""

    @pandas_udf("array<string>")
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([by_language[k if k in by_language else "en"].split(t) for t, k in zip(texts, languages, strict=True)])

    return run


def chunk(docs: DataFrame, *, size: int = 1024, overlap: int = 100, splitters: dict[str, Splitter] | None = None, length: Callable[[Column], Column] = tx.token_count) -> DataFrame:
    """Rows (doc_trace_id, ord, content, type, language, length, metadata) from documents.

    Text rows are split by language; rows of other types or without one pass as
    one chunk with their further columns in ``metadata`` (a JSON string).
    """
    splitters = splitters or {"en": recursive(size, overlap), "zh": chinese(size, overlap)}
    rest = [c for c in docs.columns if c not in ("content", "type", "_trace_id")]
    base = docs.select(F.col("_trace_id").alias("doc_trace_id"), "type", "content", F.to_json(F.struct(*rest) if rest else F.struct(F.lit(None).cast("string").alias("none"))).alias("metadata"))
    text = base.filter("type = 'text'").withColumn("language", tx.main_language(F.coalesce("content", F.lit(""))))
    text = text.withColumn("parts", split_udf(splitters)("content", "language")).select("doc_trace_id", F.posexplode("parts").alias("ord", "content"), "type", "language", "metadata")
    other = base.filter("type IS NULL OR type != 'text'").select("doc_trace_id", F.lit(0).alias("ord"), "content", "type", F.lit("").alias("language"), "metadata")
    out = text.unionByName(other).withColumn("length", length(F.col("content")))
    return out.withColumn("_trace_id", F.concat(F.lit("chunk-"), F.md5(F.concat_ws("|", "doc_trace_id", F.col("ord").cast("string"), "content"))))
