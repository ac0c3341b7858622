"""Personal data: fixed patterns plus a linear-chain conditional random field.

Base patterns find mail addresses, IP addresses, payment cards and telephone
numbers with a country code. Beside them a conditional random field labels every
word of every text as part of a name, a postal address, a telephone number
without such a code, an account or other personal number, or as none of these.
Its features are shapes (classes of characters, runs shortened), cue words and
word ends of a word and of its neighbours. It is trained on a small labelled
table (:func:`labelled`) by gradient steps on the exact log-likelihood,
computed by forward and backward passes over the padded batch.

Decoding works on Arrow batches. The scores of a word are made once for each
distinct word and gathered by numpy. A word that is none of the kinds whatever
stands around it cuts the chain: its score for "none" is ahead by more than all
that transitions can give. Only the stretches between such words, most of them
short, go through Viterbi, all stretches of a batch at once, position by
position. The best labelling is that of the whole chain.

One pass over the documents, no shuffle; the model is small and fixed.

Defined cases: a null text is empty; offsets are code points, ends exclusive; a
span of the field that overlaps a base span is not reported; neighbouring words
of one kind are one span, without the punctuation at its ends; patterns take time
in proportion to the text, so very long runs of one class are no exception;
repeated rows are scanned each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.common import pieces, split_words, tidy

#: The base kinds in their order, then those of the field.
BASE_KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", "name", "address", "number", "account")
KINDS = (*BASE_KINDS, *LABELS[1:])
#: The base patterns. Those of addresses and numbers are bound to the start of their run, where alone a leftmost match can begin.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What any base match holds; RE2 decides with it which texts are scanned.
ANY = r"@[A-Za-z0-9-]+\.|\+[0-9][ ().0-9-]+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){11}"
#: Characters that don't belong to a finding at its ends.
OUTER = "!\"#$%&'()*,-./:;<=>?@[\\]^_`{|}~“”„«»‘’…¡¿"


def _luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return sum(back[::2] + [x * 2 - 9 * (x > 4) for x in back[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, sorted."""
    out, done = [], 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        before = text[max(done, text.rfind("@", done, at) + 1) : at]
        if size := len(before) - len(before.rstrip(LOCAL)):
            out.append((at - size, 0, done := m.end()))
    for m in IP.finditer(text):
        if all(len(part := x.lstrip("0")) <= 3 and int(part or "0") <= 255 for x in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the labelled table ---

FIRST = "Anna James Maria Peter Sofia John Laura Thomas Emma David Lucía Pierre Chloé Jürgen Ingrid Carlos Elena Michael Sarah Paul".split()
LAST = "Smith Müller Garcia Dupont Johnson Schneider Martinez Bernard Brown Weber Lopez Moreau Wilson Fischer Sanchez Laurent Taylor Hoffmann O'Brien Smith-Jones".split()
STREETS = ("Oak Street", "Maple Avenue", "Hill Road", "Church Lane", "King Street", "Lindenstraße", "Hauptstraße", "Gartenweg", "Schillerplatz", "rue Victor Hugo", "rue de la Paix", "avenue Foch", "calle Mayor", "calle de Alcalá", "Park Drive")
CITIES = "London Berlin Paris Madrid Boston Hamburg Lyon Sevilla Denver Dresden".split()
TITLES = "Mr. Mrs. Ms. Dr. Prof. Herr Frau Monsieur Madame Señor Señora".split()
#: Sentences with slots: ``{name:...}`` and so on are labelled, all other words are none.
TEMPLATES = (
    "My name is {name:F L} and I live here.", "Her name is {name:F L}, she said.", "Dear {name:T L}, thank you for the letter.", "We met {name:T F L} at the office.", "please ask {name:T L} about it", "Ich heiße {name:F L} und wohne hier.",
    "Mein Name ist {name:F L}.", "Je m'appelle {name:F L} depuis toujours.", "Me llamo {name:F L} y vivo aquí.", "signed by {name:F L}", "Contact: {name:F L}", "Name: {name:F L}", "Patient: {name:F L}, seen today", "Customer {name:T F L} called again.", "Kind regards, {name:F L}",
    "He lives at {address:N S} in the city.", "Address: {address:N S, C}", "Our office is at {address:N S, Z C} now.", "Sie wohnt in der {address:S N} seit Jahren.", "Adresse: {address:S N, Z C}", "Ship it to {address:N S, C Z} please.", "Vive en la {address:S N} desde entonces.", "J'habite {address:N S} à côté.", "home address {address:N S}",
    "Tel: {number:P}", "Phone: {number:P} or write.", "call me at {number:P} tomorrow", "Telefon: {number:P}", "Tel. {number:P}, office hours", "Fax: {number:P}", "mobile {number:P}", "Téléphone: {number:P} le matin", "Teléfono: {number:P}", "my phone number is {number:P} these days",
    "IBAN: {account:I}", "IBAN {account:J} at the bank", "SSN: {account:Q}", "social security number {account:Q} on file", "Passport no. {account:R} expired", "account number: {account:A}", "Steuernummer: {account:A}", "Kontonummer {account:A} bitte", "passport number {account:R}", "SSN {account:Q}", "{number:W}", "call {number:W} now", "or {number:W} and 10.0.0.1 here", "my SSN is {account:Q}.",
)
#: Sentences without personal data, where capitals and numbers stand too.
ORDINARY = (
    "The report of the year was long. It had a page for each state.", "In June the house was sold for 250,000 to the bank.", "Chapter 12 of The Long Road is on page 345.", "He said that The Street was the name of the song.", "Version 2.10.3 was built on 2024-01-15 at 10:30.", "See figure 3, table 14 and section 2.1 below.",
    "The number of users is 1234567 this month.", "Call the function with 5 arguments or more.", "Das Haus und der Garten sind schön. Der Weg ist lang.", "Die Straße war leer. In der Stadt waren Leute.", "Le nom de la rue est long. La maison est grande.", "El nombre de la calle es largo. La casa es grande.", "id 4785380592391139 was seen 12 times", "order 9890149938096989 was sent",
    "token 24be64439e3e49cf46b2d7 and hash 0f46b2d7c90f3602", "A phone call is a call. The phone was on the table.", "Her address to the house was short.", "On Monday the Bank of the North said No.", "NOTE: ALL RIGHTS RESERVED. USE AS IS.", "GNU General Public License, version 3 or later", "Dear all, thank you for the letter.", "Name the file and address the issue.", "My name was on the list. Her name too.", "the account of the year 1984 and the passport of time",
    "Patient work is needed. Customer service is closed.", "Contact us for more. Kind words help.", "Tel Aviv is a city. Fax machines are old.", "1. Open the file 2. Close the file 3. Run it", "We counted 12 streets and 45 roads in 1999.", "| the | of | and | 12 | 45 |", "The answer is 42. Why? Because 6 times 7 is.", "Mr. and Mrs. are titles; Dr. is one too.", "in 12 of 30 cases", "Street 5 and avenue 7 cross.",
)
#: What invented rows of words are made of.
SYLLABLES = "an th er ti on ing ble re the st ha en ou ed nd sh wh ly qu ción ment eau ie ung schö ß lla ró que des pas".split()
FUNCTION = "the of and in to a is der die und den mit ist de la el que los et les des une y en a por du".split()
NOISE = ("", "", "", "", "", ",", ".", "%%%", "###", "!!", "***", "&&&", "$$$", ";", ":")


def _fill(code: str, rng: random.Random) -> str:
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    blocks = lambda *sizes, by=" ": by.join(map(digits, sizes))
    made = {
        "F": lambda: rng.choice(FIRST), "L": lambda: rng.choice(LAST), "T": lambda: rng.choice(TITLES), "S": lambda: rng.choice(STREETS), "C": lambda: rng.choice(CITIES), "Z": lambda: digits(5), "N": lambda: str(rng.randint(1, 299)) + rng.choice(("", "", "a", "b")),
        "P": lambda: rng.choice((lambda: blocks(3, 3, 4, by="-"), lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"0{digits(2)} {digits(7)}", lambda: f"0{digits(3)}/{digits(6)}", lambda: blocks(2, 2, 2, 2, 2), lambda: blocks(3, 3, 3), lambda: blocks(3, 3, 4, by=".")))(),
        "W": lambda: f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}",
        "I": lambda: rng.choice(("DE", "FR", "ES", "GB")) + blocks(2, 4, 4, 4, 4, 2), "J": lambda: rng.choice(("DE", "FR", "ES", "NL")) + digits(20), "Q": lambda: blocks(3, 2, 4, by="-"), "R": lambda: rng.choice("CFGHX") + digits(8), "A": lambda: rng.choice((digits(8), digits(10), blocks(3, 3, 4, by="/"))),
    }
    return "".join(made[c]() if c in made else c for c in code)


def labelled(rounds: int = 10, seed: int = 3) -> list[tuple[list[str], list[int]]]:
    """(words, labels) of sentences: the templates filled by rule, ordinary ones, and rows of invented words."""
    rng, out = random.Random(seed), []

    def row(k: int) -> list[str]:
        noise, case, mark = rng.choice((NOISE, ("", "", "", ".", ","), rng.choices(NOISE, k=1))), rng.choice((str, str, str, str.upper)), rng.choice((*[0] * 6, 1))
        words = [rng.choice(FUNCTION) if rng.random() < 0.3 else "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(k)]
        words = [case(w.capitalize() if rng.random() < 0.2 else w) + rng.choice(noise) for w in words]
        if words and rng.random() < 0.15:  # one word again and again
            return words[: k // 2] + [words[-1].replace(".", "").capitalize()] * rng.randint(3, 14) + words[k // 2 :]
        return [x for w in words for x in (w, "|")][:k] if mark else words

    for _ in range(rounds):
        for template in TEMPLATES:
            words, labels = [], []
            lead, tail = row(rng.randint(0, 3)), row(rng.randint(0, 3))
            for part in re.split(r"(\{[^}]*\}\S*)", template):
                if m := re.match(r"\{(\w+):([^}]*)\}(\S*)", part):
                    got = (_fill(m[2], rng) + m[3]).split()
                    label = LABELS.index(m[1])
                    # the title belongs to the sentence, not to the name
                    labels += [0 if w in TITLES else label for w in got]
                else:
                    got = part.split()
                    labels += [0] * len(got)
                words += got
            out.append((lead + words + tail, [0] * len(lead) + labels + [0] * len(tail)))
        out += [((w := s.split()), [0] * len(w)) for s in ORDINARY]
        for _ in range(60):
            w = row(rng.randint(4, 14))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice((str(rng.randint(0, 2000)), "".join(rng.choices("0123456789", k=rng.randint(8, 19))), f"({rng.randint(1, 99)})", f"{rng.randint(1, 99)}."))
            out.append((w, [0] * len(w)))
    return out


# --- the field ---


#: A word's shape: each run of letters of one case and each run of digits is shortened, other characters stay.
SHORTER = ((r"\p{Lu}{2,}", "AA"), (r"\p{Lu}", "A"), (r"\p{Ll}{2,}", "aa"), (r"[0-9]{5,}", "00000"), (r"[0-9]", "0"))
#: Groups of features that a word has, and those of them that speak about its neighbours too.
GROUPS = ("any", "shape", "core shape", "word", "ending", "mark", "length")
NEAR = ("core shape", "word", "mark")
#: Offsets at which neighbours are looked at.
AROUND = (-2, -1, 1, 2)
#: What stands before the first and behind the last word.
EDGE = "\n"


def shapes(words: pa.Array) -> pa.Array:
    for pattern, short in SHORTER:
        words = pc.replace_substring_regex(words, pattern, short)
    return pc.utf8_slice_codeunits(words, 0, 16)


def features(words: pa.Array) -> dict[str, pa.Array]:
    """Each group's feature of each word."""
    core = pc.utf8_trim(words, OUTER)
    low, last = pc.utf8_lower(core), pc.utf8_slice_codeunits(words, -1, None)
    size = pc.min_element_wise(pc.utf8_length(core), pa.scalar(12, pa.int32()))
    return {
        "any": pa.array(np.full(len(words), "*")), "shape": shapes(words), "core shape": shapes(core), "word": low, "ending": pc.utf8_slice_codeunits(low, -3, None),
        "mark": pc.if_else(pc.is_in(last, pa.array(list(OUTER))), last, ""), "length": size.cast(pa.string()),
    }


class ConditionalRandomField:
    """Weights of features for each label, and of pairs of neighbouring labels."""

    def __init__(self, sentences: Sequence[tuple[list[str], list[int]]], *, steps: int = 100, rate: float = 0.15, l2: float = 0.05, least: int = 5, caution: float = 2.5):
        n, k = len(sentences), len(LABELS)
        width = max(len(w) for w, _ in sentences)
        words = pa.array([x for w, _ in sentences for x in w] + [EDGE]).dictionary_encode()
        codes = words.indices.to_numpy()
        place = np.concatenate([i * width + np.arange(len(w)) for i, (w, _) in enumerate(sentences)])
        grid = np.full((n, width + 4), codes[-1])
        live, gold = np.zeros((n, width), bool), np.zeros((n, width), np.int64)
        at = 0
        for i, (w, labels) in enumerate(sentences):
            grid[i, 2 : 2 + len(w)] = codes[at : at + len(w)]
            live[i, : len(w)], gold[i, : len(w)], at = True, labels, at + len(w)
        #: of each group its known features, and the number of the first one at each offset
        self.known: dict[str, pa.Array] = {}
        self.first: dict[tuple[str, int], int] = {}
        rows, cols, size = [], [], 0
        for group, column in features(words.dictionary).items():
            found = column.dictionary_encode()
            of = found.indices.to_numpy()[grid]
            seen = np.bincount(of[:, 2:-2][live], minlength=len(found.dictionary))
            keep = np.flatnonzero(seen >= least)
            self.known[group] = found.dictionary.take(pa.array(keep))
            number = np.full(len(seen), -1)
            number[keep] = np.arange(len(keep))
            for d in (0, *AROUND) if group in NEAR else (0,):
                got = number[of[:, 2 + d : 2 + d + width][live]]
                self.first[group, d] = size
                rows.append(place[got >= 0])
                cols.append(size + got[got >= 0])
                size += len(keep)
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        by_row = np.argsort(rows, kind="stable")
        rows, cols = rows[by_row], cols[by_row]
        order = np.argsort(cols, kind="stable")
        by_feature, feature_starts = rows[order], np.flatnonzero(np.r_[True, np.diff(cols[order]) > 0])
        numbers = cols[order][feature_starts]
        row_starts = np.flatnonzero(np.r_[True, np.diff(rows) > 0])
        theta = {"w": np.zeros((size, k)), "t": np.zeros((k, k))}
        first, second = ({x: np.zeros_like(v) for x, v in theta.items()} for _ in range(2))
        pairs = live[:, 1:]
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
        one_hot = np.eye(k)[gold] * live[:, :, None]
        for step in range(1, steps + 1):
            e = np.zeros((n * width, k))
            e[rows[row_starts]] = np.add.reduceat(theta["w"][cols], row_starts)
            node, pair = self._marginals(e.reshape(n, width, k), theta["t"], live)
            apart = (node - one_hot).reshape(-1, k)
            g = {"w": l2 / n * theta["w"], "t": (pair - gold_pairs) / n + l2 / n * theta["t"]}
            g["w"][numbers] += np.add.reduceat(apart[by_feature], feature_starts) / n
            for x in theta:
                first[x] = 0.9 * first[x] + 0.1 * g[x]
                second[x] = 0.999 * second[x] + 0.001 * g[x] ** 2
                theta[x] = theta[x] - rate * (first[x] / (1 - 0.9**step)) / (np.sqrt(second[x] / (1 - 0.999**step)) + 1e-8)
        self.w, self.t = theta["w"], theta["t"]
        self.bias = np.where(np.arange(k) > 0, -caution, 0.0)
        # by how much the pairs around a word can speak for another label than none, at most; an end of the text adds nothing
        before = np.vstack([self.t, np.zeros(k)])
        behind = np.hstack([self.t, np.zeros((k, 1))])
        self.most = (before - before[:, :1]).max(axis=0) + (behind - behind[:1]).max(axis=1)

    @staticmethod
    def _marginals(e: np.ndarray, t: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals of each live position, and the summed marginals of neighbouring pairs."""
        n, width, k = e.shape
        total = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, width):
            now = e[:, i] + total(alpha[:, i - 1, :, None] + t, 1)
            alpha[:, i] = np.where(live[:, i, None], now, alpha[:, i - 1])
        for i in range(width - 2, -1, -1):
            now = total(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(live[:, i + 1, None], now, 0.0)
        z = total(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        pair = np.zeros((k, k))
        for i in range(1, width):
            p = np.exp(alpha[:, i - 1, :, None] + t + (e[:, i] + beta[:, i])[:, None, :] - z[:, None, None])
            pair += p[live[:, i]].sum(axis=0)
        return node, pair

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """What each word says about itself and about its neighbours at ``AROUND``: (words, 1 + neighbours, labels)."""
        out = np.zeros((len(words), 1 + len(AROUND), len(LABELS)), np.float32)
        out[:, 0] = self.bias
        for group, column in features(words).items():
            of = pc.index_in(column, self.known[group]).fill_null(len(self.known[group])).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(of < len(self.known[group]))
            for j, d in enumerate((0, *AROUND) if group in NEAR else (0,)):
                out[hit, j] += self.w[self.first[group, d] + of[hit]]
        return out

    def scores(self, offsets: np.ndarray, flat: pa.Array) -> np.ndarray:
        """(words, labels): the sum of what each word of the texts and its neighbours say; each distinct word is described once."""
        coded = flat.dictionary_encode()
        table = self.word_scores(pa.concat_arrays([coded.dictionary, pa.array([EDGE])]))
        codes, edge = coded.indices.to_numpy(), len(coded.dictionary)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        low, high, place = offsets[row], offsets[row + 1], np.arange(len(codes))
        out = table[codes, 0]
        for j, d in enumerate(AROUND, 1):
            there = place + d
            out += table[np.where((there >= low) & (there < high), codes[np.clip(there, 0, len(codes) - 1)], edge), j]
        return out

    def decode(self, e: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best label of each word; rows of ``e`` are words, ``offsets`` bound the texts."""
        best = np.zeros(len(e), np.int8)
        open_ = (e[:, :1] - e[:, 1:] <= self.most[1:]).any(axis=1)
        at = np.flatnonzero(open_)
        if not at.size:
            return best
        fresh = np.zeros(len(e) + 1, bool)
        fresh[offsets[:-1]] = True
        starts = np.flatnonzero(np.r_[True, np.diff(at) > 1] | fresh[at])
        sizes = np.diff(np.r_[starts, len(at)])
        order = np.argsort(-sizes, kind="stable")
        first, sizes = at[starts[order]], sizes[order]
        edge = np.zeros(len(e) + 1, bool)
        edge[offsets] = True
        # a stretch stands between words that are none, or at an end of its text
        score = e[first] + np.where(edge[first, None], 0.0, self.t[0])
        back = np.zeros((len(e), len(LABELS)), np.int8)
        last = np.empty((len(first), len(LABELS)))
        live = len(first)
        for i in range(1, int(sizes[0]) + 1):
            now = int(np.searchsorted(-sizes, -i, "left"))  # stretches longer than i
            last[now:live] = score[now:live]
            live = now
            if not live:
                break
            paths = score[:live, :, None] + self.t
            back[first[:live] + i] = paths.argmax(axis=1)
            score = paths.max(axis=1) + e[first[:live] + i]
        end = first + sizes
        label = (last + np.where(edge[end, None], 0.0, self.t[:, 0])).argmax(axis=1).astype(np.int8)
        for i in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -i, "left"))
            place = end[:live] - 1 - i
            best[place] = label[:live]
            label = np.take_along_axis(back[place], label[:live, None].astype(np.int64), 1)[:, 0]
        return best


@lru_cache(maxsize=1)
def trained() -> ConditionalRandomField:
    return ConditionalRandomField(labelled())


def _places(text: str, labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the labelled words of a text, neighbours of one kind together."""
    held = None
    for label, m in zip(labels.tolist(), re.finditer(r"[^\x20\x09-\x0D]+", text), strict=True):
        if held and label != held[1]:
            yield held
            held = None
        if label:
            held = (held[0] if held else m.start(), label, m.end())
    if held:
        yield held


def field_spans(text: str, labels: np.ndarray, base: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The field's findings beside the base ones."""
    out = []
    taken = sorted((a, b) for a, _, b in base)
    for a, label, b in _places(text, labels):
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip(OUTER)), b - len(part) + len(part.rstrip(OUTER))
        if a < b and not any(x < b and a < y for x, y in taken):
            out.append((a, len(BASE_KINDS) + label - 1, b))
    return out


def scan(docs: DataFrame, field: ConditionalRandomField | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    held = docs.sparkSession.sparkContext.broadcast(field or trained())
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in BASE_KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in pieces(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            offsets, flat = split_words(texts, lower=False)
            labels = held.value.decode(held.value.scores(offsets, flat), offsets) if len(flat) else np.zeros(0, np.int8)
            marked = np.add.reduceat(np.r_[labels != 0, False].astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0)
            rows = []
            for i, (text, likely) in enumerate(zip(texts, pc.match_substring_regex(texts, ANY).to_pylist(), strict=True)):
                text = text.as_py() if likely or marked[i] else ""
                base = base_spans(text) if likely else []
                found = sorted(base + field_spans(text, labels[offsets[i] : offsets[i + 1]], base)) if marked[i] else base
                name = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(name(base).encode()).hexdigest() if base else none, name(found)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], ["doc_id", *counts, "base_sha256", "spans"])

    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in counts)}, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
