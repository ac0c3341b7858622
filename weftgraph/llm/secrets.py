"""Secret scan: fixed patterns plus automata inferred from labelled credentials.

Base patterns find assignments, access keys and long hex runs. Beside them,
each labelled credential format is learned as a probabilistic automaton: the
format's strings form a prefix tree with counts, and states whose futures are
statistically compatible (Hoeffding bound on every outgoing frequency) are
merged, red-blue order, folding subtrees together. Every run of 16 credential
characters or more is read once from left to right by all automata. A finding
starts at the run's start or behind a joint (one of ``/ . = _ -``) and ends at
its end or before a joint; its score is the log-likelihood ratio of its symbols
under one format against a character model of ordinary tokens, less a threshold
for each symbol. The findings of kind ``grammar`` are the stretches, side by side,
whose scores have the largest sum. For each state and format only the best
start is carried on, so a run takes time in proportion to its symbols, whatever
its joints. Symbols are the literal character at the first positions (where
formats carry their marks) and the character's class behind.

A finding has at least 16 symbols, which is less than any labelled format, and a
format is given up where its own score falls ``DROP`` below zero, as no
credential has so unlikely a part.

One pass over the documents, no shuffle; the automata are small and fixed.

Defined cases: a null text is empty; offsets are code points, ends exclusive; a
grammar finding inside a base span is not reported again; repeated rows are
scanned each; texts of any length are scanned whole; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.common import pieces, tidy

#: The base kinds in their order, with the least length of the part that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "grammar")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
LEAST_RUN = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Where one token of a run may end and another begin.
JOINTS = frozenset("/.=_-")
#: What each finding of a run costs, and how far below zero a format is followed.
COST, DROP = 4.0, 40.0
#: What any finding holds; RE2 decides with it which texts are scanned at all.
ANY = r"""[0-9a-f]{24}|AKIA[A-Z0-9]{16}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|[A-Za-z0-9+/_.=-]{16}"""

UPPER, LOWER_HEX, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdef", "ghijklmnopqrstuvwxyz", "0123456789"
MARK = 4
#: Log-probabilities of a symbol that a state never saw, and of a literal character given its class.
FLOOR, LITERAL = math.log(1e-4), math.log(1 / 16)


def character_class(c: str) -> str:
    return "d" if c in DIGITS else "h" if c in LOWER_HEX else "l" if c in LOWER else "u" if c in UPPER else c


def symbols(token: str) -> list[str]:
    """The token's symbols: first characters themselves, then classes; the end is a symbol too."""
    return [*token[:MARK], *map(character_class, token[MARK:]), "$"]


class Automaton:
    """A probabilistic automaton from merged prefix-tree states."""

    def __init__(self, samples: Sequence[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for sample in samples:
            state = 0
            for s in symbols(sample):
                self.count[state][s] += 1
                if s not in self.next[state]:
                    self.next.append({})
                    self.count.append(Counter())
                    self.next[state][s] = len(self.next) - 1
                state = self.next[state][s]
        self.alpha = alpha
        self._merge()

    def _differ(self, a: int, b: int) -> bool:
        n, m = sum(self.count[a].values()), sum(self.count[b].values())
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(self.count[a][s] / n - self.count[b][s] / m) > bound for s in self.count[a] | self.count[b])

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            if self._differ(*pair):
                return False
            todo += [(self.next[pair[0]][s], t) for s, t in self.next[pair[1]].items() if s in self.next[pair[0]]]
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            self.count[x] += self.count[y]
            for s, t in self.next[y].items():
                if s in self.next[x]:
                    todo.append((self.next[x][s], t))
                else:
                    self.next[x][s] = t

    def _merge(self) -> None:
        red, blue = [0], [(0, s) for s in sorted(self.next[0])]
        while blue:
            parent, s = blue.pop(0)
            state = self.next[parent][s]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][s] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            blue = sorted({(r, x) for r in red for x, t in self.next[r].items() if t not in red})
        place = {r: i for i, r in enumerate(red)}
        self.next = [{s: place[t] for s, t in self.next[r].items()} for r in red]
        totals = [max(1, sum(self.count[r].values())) for r in red]
        self.log = [{s: math.log(n / totals[i]) for s, n in self.count[r].items()} for i, r in enumerate(red)]
        #: (next state, log-probability) of each symbol that a state has seen
        self.step = [{s: (self.next[i].get(s, i), x) for s, x in log.items()} for i, log in enumerate(self.log)]

    def loglik(self, syms: Sequence[str]) -> float:
        """Log-probability; a symbol that the state never saw costs the floor and keeps the state."""
        state, out = 0, 0.0
        for s in syms:
            if s in self.log[state]:
                out += self.log[state][s]
                state = self.next[state][s]
            else:
                out += FLOOR
        return out


class Background:
    """Bigrams of symbols of ordinary tokens, add-one smoothed."""

    def __init__(self, samples: Sequence[str]):
        self.pairs, self.ones = Counter(), Counter()
        for sample in samples:
            syms = ["^", *symbols("----" + sample)[MARK:]]
            self.pairs.update(zip(syms, syms[1:], strict=False))
            self.ones.update(syms[:-1])

    def pair(self, a: str, b: str) -> float:
        return math.log((self.pairs[a, b] + 1) / (self.ones[a] + 12))

    def loglik(self, token: str) -> float:
        syms = ["^", *symbols("----" + token)[MARK:]]
        return LITERAL * min(MARK, len(token)) + sum(self.pair(a, b) for a, b in zip(syms, syms[1:], strict=False))


#: Labelled formats: (prefix, alphabet, lengths); the labelled strings are drawn from them by rule.
FORMATS = {
    "cloud access key": ("AKIA", UPPER + DIGITS, (16,)),
    "digest or key in hex": ("", LOWER_HEX + DIGITS, (32, 40, 64)),
    "repository token": ("ghp_", UPPER + LOWER_HEX + LOWER + DIGITS, (36,)),
    "payment key": ("sk_live_", UPPER + LOWER_HEX + LOWER + DIGITS, (24, 32)),
    "publishable key": ("pk_live_", UPPER + LOWER_HEX + LOWER + DIGITS, (24, 32)),
    "model key": ("sk-", UPPER + LOWER_HEX + LOWER + DIGITS, (32, 48)),
    "chat token": ("xoxb-", DIGITS, (11,)),
    "user's chat token": ("xoxp-", DIGITS, (11,)),
    "key of letters and digits": ("", UPPER + LOWER_HEX + LOWER + DIGITS, (24, 32)),
    "maps key": ("AIza", UPPER + LOWER_HEX + LOWER + DIGITS + "-_", (35,)),
    "secret in base 64": ("", UPPER + LOWER_HEX + LOWER + DIGITS + "+/", (40,)),
    "web token": ("eyJ", UPPER + LOWER_HEX + LOWER + DIGITS + "-_", (60, 90)),
}
#: Ordinary long tokens: fixed values.
ORDINARY = """
internationalization misunderstanding responsibilities characteristically Geschwindigkeitsbegrenzung
Krankenversicherungen extraordinairement constitutionnellement desafortunadamente responsabilidades
mail.example.com docs.example.org/guide en.wikipedia.org/wiki/Index http.server.handler www.example.net/about
2024-01-01T00.00.00 2023-11-30-update-notes 1234567890123456 1000000000000000 192.168.100.200 3.14159265358979
some_long_variable_name another_function_name MAX_BUFFER_SIZE_BYTES src/main/resources/config.yaml
READ_ONLY_MODE_FLAG user-interface-design state-of-the-art --------------- =============== _______________
UNDERSTANDINGSOFTHEWORLD UNINTERRUPTEDLY. Internationalization. Verantwortungsbewusstsein.
"""


def labelled(n: int = 60, seed: int = 5) -> dict[str, list[str]]:
    rng = random.Random(seed)
    out = {}
    for name, (prefix, alphabet, lengths) in FORMATS.items():
        out[name] = [prefix + "".join(rng.choices(alphabet, k=lengths[i % len(lengths)])) for i in range(n)]
    for name in ("chat token", "user's chat token"):
        out[name] = [f"{x}-{''.join(rng.choices(UPPER + LOWER + DIGITS, k=24))}" for x in out[name]]
    return out


class SecretScanner:
    def __init__(self, credentials: dict[str, list[str]] | None = None, ordinary: Sequence[str] | None = None, threshold: float = 0.35):
        self.automata = {k: Automaton(v) for k, v in (credentials or labelled()).items()}
        self.background = Background(ordinary or ORDINARY.split())
        self.threshold = threshold

    def score(self, token: str) -> tuple[float, str]:
        """The best format's log-likelihood ratio per symbol, and its name."""
        syms, base = symbols(token), self.background.loglik(token)
        return max(((a.loglik(syms) - base) / len(syms), name) for name, a in self.automata.items())

    def segments(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the findings of a run, side by side, with the largest sum of scores."""
        n, classes = len(run), [character_class(c) for c in run]
        known: dict[tuple[str, str], float] = {}

        def pair(a: str, b: str) -> float:
            if (a, b) not in known:
                known[a, b] = self.background.pair(a, b)
            return known[a, b]

        automata = list(self.automata.values())
        best, chain = 0.0, None
        # of each automaton, by state and age up to LEAST_RUN: (sum so far, start, sum before the start, findings before)
        active: list[dict] = [{} for _ in automata]
        for i in range(n + 1):
            joint = i == n or run[i] in JOINTS
            if joint and i and run[i - 1] not in JOINTS:
                more = pair(classes[i - 1], "$") + self.threshold
                top, over = best, chain
                for a, held in zip(automata, active, strict=True):
                    for (state, age), (total, start, _, before) in held.items():
                        if age == LEAST_RUN and (x := total + a.log[state].get("$", FLOOR) - more) > top:
                            top, over = x, (start, i, before)
                best, chain = top, over
            if i == n:
                break
            begins = not joint and (not i or run[i - 1] in JOINTS) and n - i >= LEAST_RUN
            c, cls = run[i], classes[i]
            cost = self.threshold + (pair(classes[i - 1], cls) if i else 0.0)
            opening = self.threshold + pair("^", cls) + LITERAL
            for k, a in enumerate(automata):
                held = active[k]
                if not held and not begins:
                    continue
                moved: dict = {}
                if begins:
                    state, x = a.step[0].get(c, (0, FLOOR))
                    moved[state, 1] = (best - COST + x - opening, i, best, chain)
                for (state, age), (total, start, floor, before) in held.items():
                    if age < MARK:
                        to, x = a.step[state].get(c, (state, FLOOR))
                        total += x - cost - LITERAL
                    else:
                        to, x = a.step[state].get(cls, (state, FLOOR))
                        total += x - cost
                    if total < floor - DROP:
                        continue
                    key = (to, age + 1 if age < LEAST_RUN else age)
                    if key not in moved or moved[key][0] < total:
                        moved[key] = (total, start, floor, before)
                active[k] = moved
        found = []
        while chain:
            found.append(chain[:2])
            chain = chain[2]
        return found[::-1]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of all findings, sorted; kind is the place in ``KINDS``."""
        out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        starts, ends = [], []  # of base spans by start; ends hold the furthest end so far
        for a, _, b in sorted(out):
            starts.append(a)
            ends.append(max(b, ends[-1] if ends else 0))
        for m in CANDIDATE.finditer(text):
            for a, b in self.segments(m[0]):
                a, b = m.start() + a, m.start() + b
                if not ((i := bisect_right(starts, a)) and b <= ends[i - 1]):
                    out.append((a, 3, b))
        return sorted(out)


def scan(docs: DataFrame, scanner: SecretScanner | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    held = docs.sparkSession.sparkContext.broadcast(scanner or SecretScanner())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in pieces(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            likely = pc.match_substring_regex(texts, ANY).to_pylist()
            rows = []
            for text, scan_it in zip(texts, likely, strict=True):
                found = held.value.spans(text.as_py()) if scan_it else []
                if not found:
                    rows.append((0, 0, 0, none, ""))
                    continue
                named = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in found]
                n = Counter(k for k, _ in named)
                rows.append((n[0], n[1], n[2], hashlib.sha256(",".join(x for k, x in named if k < 3).encode()).hexdigest(), ",".join(x for _, x in named)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
