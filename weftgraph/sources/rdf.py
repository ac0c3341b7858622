"""RDF in Turtle, N-Triples and RDF/XML (OWL): own parsers over whole files, documents by Spark.

A file is the unit of parsing, as prefixes and blank nodes belong to it; triples
of all files meet in one grouped aggregate per subject. Blank nodes are named by
their file, so equal labels of two files stay apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary that the syntaxes themselves use.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TYPE, FIRST, REST, NIL = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil"
_XML = "{http://www.w3.org/XML/1998/namespace}"

#: (subject, predicate, object, whether it is a literal)
Triple = tuple[str, str, str, bool]

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<long>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3})
    |(?P<text>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<typed>\^\^)
    |(?P<blank>_:\w(?:[\w-]|\.(?=[\w-]))*)
    |(?P<name>(?:\w(?:[\w-]|\.(?=[\w-]))*)?:(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%]|\.(?=[\w:%\\-]))*)
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,()\[\]])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text) if "\\" in text else text


def resolve(base: str, iri: str) -> str:
    """An IRI as it is if it has a scheme, else seen from the base."""
    return iri if not base or re.match(r"[A-Za-z][\w+.-]*:", iri) else urljoin(base, iri)


class Turtle:
    """A reader of one Turtle text (N-Triples are Turtle too)."""

    def __init__(self, text: str, base: str = "", scope: str = ""):
        self.base, self.scope, self.prefixes = base, scope, {}
        self.made = 0
        self.tokens = self._tokens(text)
        self.now: tuple[str, str] | None = None
        self.out: list[Triple] = []
        self._next()

    @staticmethod
    def _tokens(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at character {at}: {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup or "", m[0]

    def _next(self) -> tuple[str, str] | None:
        was, self.now = self.now, next(self.tokens, None)
        return was

    def _is(self, mark: str) -> bool:
        return self.now == ("mark", mark)

    def _take(self, mark: str) -> None:
        if not self._is(mark):
            raise ValueError(f"{mark!r} is due, not {self.now}")
        self._next()

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}g{self.made}"

    def triples(self) -> Iterator[Triple]:
        """Statement by statement."""
        while self.now:
            kind, token = self.now
            if kind == "at" and token in ("@prefix", "@base") or kind == "word" and token.upper() in ("PREFIX", "BASE"):
                self._directive(token)
            else:
                anonymous = self._is("[")
                subject = self._term()[0]
                if not (anonymous and self._is(".")):
                    self._properties(subject, ".")
                self._take(".")
            yield from self.out
            self.out.clear()

    def _directive(self, token: str) -> None:
        self._next()
        name = self._next()[1] if token.lower().endswith("prefix") else None
        iri = self._term()[0]
        if name is None:
            self.base = iri
        else:
            self.prefixes[name[:-1]] = iri
        if token[0] == "@":
            self._take(".")

    def _properties(self, subject: str, end: str) -> None:
        while not self._is(end):
            if self.now == ("word", "a"):
                self._next()
                predicate = TYPE
            else:
                predicate = self._term()[0]
            while True:
                value, literal = self._term()
                self.out.append((subject, predicate, value, literal))
                if not self._is(","):
                    break
                self._next()
            while self._is(";"):
                self._next()
                if self._is(end):
                    return
            if not self._is(end) and self.now is None:
                raise ValueError("the text ends inside a statement")

    def _term(self) -> tuple[str, bool]:
        if self.now is None:
            raise ValueError("the text ends inside a statement")
        kind, token = self._next()
        if kind == "iri":
            return resolve(self.base, unescape(token[1:-1])), False
        if kind == "name":
            prefix, local = token.split(":", 1)
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), False
        if kind == "blank":
            return f"_:{self.scope}{token[2:]}", False
        if kind in ("text", "long"):
            width = 3 if kind == "long" else 1
            if self.now and self.now[0] == "at":
                self._next()
            elif self.now and self.now[0] == "typed":
                self._next()
                self._term()
            return unescape(token[width:-width]), True
        if kind == "number" or kind == "word" and token in ("true", "false"):
            return token, True
        if (kind, token) == ("mark", "["):
            node = self.fresh()
            self._properties(node, "]")
            self._take("]")
            return node, False
        if (kind, token) == ("mark", "("):
            return self._collection(), False
        raise ValueError(f"no term: {token!r}")

    def _collection(self) -> str:
        items = []
        while not self._is(")"):
            items.append(self._term())
        self._next()
        return chain(items, self.fresh, self.out)


def chain(items: list[tuple[str, bool]], fresh: Callable[[], str], out: list[Triple]) -> str:
    """The list of the items as cells; its first cell, or nil."""
    cells = [fresh() for _ in items]
    for cell, nxt, (value, literal) in zip(cells, [*cells[1:], NIL], items, strict=False):
        out += [(cell, FIRST, value, literal), (cell, REST, nxt, False)]
    return cells[0] if cells else NIL


class RdfXml:
    """A reader of one RDF/XML document."""

    def __init__(self, body: bytes, base: str = "", scope: str = ""):
        self.root, self.base, self.scope = ElementTree.fromstring(body), base, scope
        self.made, self.out = 0, []

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}g{self.made}"

    def triples(self) -> list[Triple]:
        base = self.root.get(_XML + "base", self.base)
        for node in self.root if self.root.tag == f"{{{RDF}}}RDF" else [self.root]:
            self._node(node, base)
        return self.out

    @staticmethod
    def _iri(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def _own(self, e: ElementTree.Element, base: str) -> str:
        at = lambda name: e.get(f"{{{RDF}}}{name}")
        if (about := at("about")) is not None:
            return resolve(base, about)
        if (name := at("ID")) is not None:
            return f"{base.split('#')[0]}#{name}"
        return f"_:{self.scope}{at('nodeID')}" if at("nodeID") else self.fresh()

    def _attributes(self, e: ElementTree.Element, subject: str) -> None:
        for name, value in e.attrib.items():
            if name == f"{{{RDF}}}type":
                self.out.append((subject, TYPE, value, False))
            elif not name.startswith((f"{{{RDF}}}", _XML)):
                self.out.append((subject, self._iri(name), value, True))

    def _node(self, e: ElementTree.Element, base: str) -> str:
        base = e.get(_XML + "base", base)
        subject = self._own(e, base)
        if e.tag != f"{{{RDF}}}Description":
            self.out.append((subject, TYPE, self._iri(e.tag), False))
        self._attributes(e, subject)
        self._properties(e, subject, base)
        return subject

    def _properties(self, e: ElementTree.Element, subject: str, base: str) -> None:
        items = 0
        for p in e:
            if p.tag == f"{{{RDF}}}li":
                items += 1
                predicate = f"{RDF}_{items}"
            else:
                predicate = self._iri(p.tag)
            value, literal = self._value(p, p.get(_XML + "base", base))
            self.out.append((subject, predicate, value, literal))

    def _value(self, p: ElementTree.Element, base: str) -> tuple[str, bool]:
        at = lambda name: p.get(f"{{{RDF}}}{name}")
        if (resource := at("resource")) is not None:
            return resolve(base, resource), False
        if at("nodeID"):
            return f"_:{self.scope}{at('nodeID')}", False
        parse = at("parseType")
        if parse == "Literal":
            return (p.text or "") + "".join(ElementTree.tostring(x, "unicode") for x in p), True
        if parse == "Collection":
            return chain([(self._node(x, base), False) for x in p], self.fresh, self.out), False
        if parse == "Resource":
            node = self.fresh()
            self._properties(p, node, base)
            return node, False
        if len(p):
            return self._node(p[0], base), False
        if any(not k.startswith((f"{{{RDF}}}", _XML)) for k in p.attrib):
            node = self.fresh()
            self._attributes(p, node)
            return node, False
        return p.text or "", True


def parse(body: bytes, path: str) -> Iterator[Triple]:
    """The triples of a file; RDF/XML and OWL by their first mark, all else is Turtle."""
    scope = hashlib.md5(path.encode()).hexdigest()[:8] + "-"
    if re.match(rb"\s*(?:\xef\xbb\xbf)?\s*<(?:\?xml|!DOCTYPE|!--|[\w.-]*:?RDF\b)", body):
        yield from RdfXml(body, scope=scope).triples()
    else:
        yield from Turtle(body.decode("utf-8-sig"), scope=scope).triples()


def read_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(subject, predicate, value, literal, path) of every file; ``literal`` is null for other values."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, body in zip(batch["path"], batch["content"], strict=True):
                rows = [(s, p, o, o if literal else None, file) for s, p, o, literal in parse(body, file)]
                yield pd.DataFrame(rows, columns=["subject", "predicate", "value", "literal", "path"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", "content").mapInPandas(load, "subject string, predicate string, value string, literal string, path string")


def subjects(triples: DataFrame) -> DataFrame:
    """One text document per subject: literals joined by blanks, properties map<predicate,array>."""
    props = triples.groupBy("subject", "predicate").agg(F.array_sort(F.collect_set("value")).alias("values"), F.array_join(F.array_sort(F.collect_set("literal")), " ").alias("said"))
    docs = props.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "values")))).alias("properties"), F.sort_array(F.collect_list(F.struct("predicate", "said"))).alias("s"))
    said = F.array_join(F.filter(F.transform("s", lambda x: x["said"]), lambda x: x != ""), " ")
    return docs.select(F.lit("text").alias("type"), F.col("subject").alias("id"), F.when(said != "", said).otherwise(F.col("subject")).alias("content"), "properties")
