"""Fill-in-the-middle transformation of documents.

A text is a row of units: a run of the letters A-Z and a-z is one unit, every
other code point is one by itself. Two hashed unit ranks cut the text into
prefix, middle and suffix, which are written out behind sentinels, either prefix
first (``psm``) or suffix first (``spm``).

Cutting needs the code point of a rank only. One Aho-Corasick automaton scans a
text once: its patterns are the pairs of ASCII characters in which the class
changes between letter and other, and the three sentinels. Code points outside
ASCII are one non-letter symbol, characters of one class are one symbol but
where a sentinel needs them, so the automaton has seven symbols and a fixed
number of states. Between two events lies a run of one class, whose units follow
from its length (one for letters, its length otherwise). Their running sum is
searched for the rank; units are never listed.

One pass over the documents, no shuffle.

Defined cases: a null text is empty, and an empty one stays plain, as does a text
that holds a sentinel; a null id is hashed as no characters; texts of any length
are handled one by one, in memory of a few numbers an event; equal rows give
equal results each; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import pieces, tidy

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Symbols of the automaton: those of the sentinels, any other letter, any other character.
LETTERS, OTHERS = "PSMa", "<>."


def _symbol(c: str) -> str:
    return c if c in "PSM<>" else "a" if c in string.ascii_letters else "."


_TABLE = "".join(_symbol(chr(i)) if i < 128 else "." for i in range(256)).encode("ascii")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Finds class changes (value False, ending at a run's first character) and sentinels (True)."""
    out = ahocorasick.Automaton()
    for a in LETTERS:
        for b in OTHERS:
            out.add_word(a + b, False)
            out.add_word(b + a, False)
    for s in SENTINELS:
        out.add_word(s, True)
    out.make_automaton()
    return out


class Units:
    """Ranks of a text's units, from the events of the automaton."""

    def __init__(self, text: str):
        coded = text.encode("ascii", "replace").translate(_TABLE).decode("ascii")  # one symbol a code point
        changes, self.marked = [0], False
        for end, sentinel in automaton().iter(coded):
            if sentinel:
                self.marked = True
            else:
                changes.append(end)
        if not coded:
            changes = []
        self.starts = np.array([*changes, len(coded)], np.int64)
        sizes = np.diff(self.starts)
        self.letters = (np.arange(len(sizes)) % 2 == 0) == (coded[:1] in LETTERS)
        self.before = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, sizes))])

    def __len__(self) -> int:
        return int(self.before[-1])

    def end(self, rank: int) -> int:
        """The code point behind the first ``rank`` units."""
        if not rank:
            return 0
        run = int(np.searchsorted(self.before, rank)) - 1
        return int(self.starts[run + 1] if self.letters[run] else self.starts[run] + rank - self.before[run])


def infill(text: str, doc_id, *, seed: int = 1, percent: int = 90, suffix_first: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of one text."""
    units = Units(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or units.marked or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.end(a), units.end(b)
    first, middle, last = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{last}{PREFIX}{first}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{first}{SUFFIX}{last}{MIDDLE}{middle}"


def transform(docs: DataFrame, *, seed: int = 1, percent: int = 90, suffix_first: int = 20) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output.

    ``percent`` of the documents are transformed; of these ``suffix_first``
    percent start with the suffix.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = [infill(text.as_py() or "", i, seed=seed, percent=percent, suffix_first=suffix_first) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text behind an output: no part of a transformed text holds a sentinel, nor do two parts and a sentinel make another."""
    parts = F.split(output, "|".join(SENTINELS))
    text = lambda *order: F.concat(*[F.element_at(parts, i) for i in order])
    return F.when(form == "psm", text(2, 4, 3)).when(form == "spm", text(3, 4, 2)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), k AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), c AS (
  SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM f
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
