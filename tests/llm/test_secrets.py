from __future__ import annotations

import hashlib
import random
import re

import pytest

from weftgraph.llm import secrets


def base(text):
    """The base spans by the contract's words, without the scanner's shortcuts."""
    out = []
    for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [x for _, _, x in sorted(out)]


TEXTS = [
    None, "", "no secrets here", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "PassWord:abc", "password: abcdef", "é😀 api_key='A.b/c+d' and APIKEY=xx_yy-zz", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "B", "xAKIAAKIA" + "Z9" * 9, "0" * 23 + "g" + "f" * 24,
    "toKen=abcdefgh", "ſecret=abcdefgh", "token token=aaaaaa token==bbbbbb", "passwd\n=abcdef", "secret\"  :  'x=y.z/1", "token = short password=longenough",
]


def check(rows, texts):
    for r in rows:
        found = base(texts[r.doc_id] or "")
        kinds = [x.split(":")[0] for x in found]
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds.count("assign"), kinds.count("access"), kinds.count("hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("grammar")] == found
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])))


def test_base_spans(spark):
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    rows = secrets.scan(frame).collect()
    assert len(rows) == len(TEXTS)
    check(rows, dict(enumerate(TEXTS)))


def test_query_matches_brute_force(spark, sf001):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    rows = secrets.op3_secret_scan(spark, sf001).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check(rows, texts)


@pytest.fixture(scope="module")
def scanner():
    return secrets.SecretScanner()


def test_unseen_credentials_are_found(scanner):
    fresh = secrets.labelled(40, seed=77)
    for name, samples in fresh.items():
        hit = sum(any(k for _, k, _ in scanner.spans(f"use {s} now")) for s in samples)
        assert hit >= 0.9 * len(samples), name


def test_ordinary_tokens_are_left_alone(scanner):
    rng = random.Random(4)
    syllables = ["an", "th", "er", "tion", "ing", "ble", "hea", "ou", "sch", "keit"]
    texts = ["".join(rng.choices(syllables, k=7)) + "." for _ in range(200)]
    texts += ["mail7.example.com", "2024-05-01T10.20.30", "https://www.example.org/en/2021/05/a-long-title-of-an-article", "chapter_12_section_4_title", "1234567890123456789", "IMG_20210501_123456.jpg"]
    assert [t for t in texts if scanner.spans(t)] == []


def best_segments(scanner, run):
    """The stretches with the largest sum of scores, by scoring each of them whole."""
    n = len(run)
    starts = [i for i in range(n) if run[i] not in secrets.JOINTS and (not i or run[i - 1] in secrets.JOINTS)]
    ends = [i for i in range(1, n + 1) if run[i - 1] not in secrets.JOINTS and (i == n or run[i] in secrets.JOINTS)]
    best = [(0.0, [])] * (n + 1)
    for i in range(1, n + 1):
        best[i] = best[i - 1]
        for a in starts if i in ends else ():
            if i - a >= secrets.LEAST_RUN:
                token = run[a:i]
                x = scanner.score(token)[0] * (len(token) + 1) - scanner.threshold * (len(token) + 1) - secrets.COST + best[a][0]
                if x > best[i][0] + 1e-9:
                    best[i] = (x, [*best[a][1], (a, i)])
    return best[n][1]


def test_segments_have_the_largest_sum(scanner):
    rng = random.Random(8)
    fresh = [s for samples in secrets.labelled(6, seed=12).values() for s in samples]
    words = ["src", "main", "internationalization", "2024", "readme", "x"]
    for _ in range(150):
        run = "".join(rng.choice(fresh if rng.random() < 0.5 else words) + rng.choice("/._-=") for _ in range(rng.randint(1, 4)))
        assert scanner.segments(run) == best_segments(scanner, run), run


def test_all_credentials_of_a_run_are_found(scanner):
    rng = random.Random(3)
    letters = secrets.UPPER + secrets.LOWER_HEX + secrets.LOWER + secrets.DIGITS
    draw = lambda k: "".join(rng.choices(letters, k=k))
    for _ in range(30):
        one, two = "ghp_" + draw(36), "AIza" + draw(35)
        found = [(a, b) for a, k, b in scanner.spans(f"{one}/{two}") if k == 3]
        assert found == [(0, len(one)), (len(one) + 1, len(one) + 1 + len(two))]
    for make in (lambda: f"xoxp-{rng.randint(10**10, 10**11)}-{draw(32)}", lambda: "pk_live_51" + draw(24), lambda: "sk-" + draw(48), lambda: "sk-proj-" + draw(40), lambda: "npm_" + draw(36)):
        assert sum(any(k == 3 for _, k, _ in scanner.spans(f"use {make()} now")) for _ in range(50)) >= 45, make()


def test_long_runs_take_time_in_proportion(scanner):
    import time

    rng = random.Random(2)
    blob = "".join(rng.choices(secrets.UPPER + secrets.LOWER + secrets.LOWER_HEX + secrets.DIGITS + "+/", k=400_000))
    for text in (blob, "-".join(blob[i : i + 7] for i in range(0, 200_000, 7)), "a" * 400_000):
        began = time.time()
        scanner.spans(text[: len(text) // 8])
        part = time.time() - began
        scanner.spans(text)
        assert time.time() - began < 16 * part + 3


def test_merging_shrinks_the_prefix_tree():
    samples = secrets.labelled()["repository token"]
    assert len(secrets.Automaton(samples).next) < 60


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_credentials_of_other_formats_and_without_digits_are_found():
    rng, scanner = random.Random(99), secrets.SecretScanner()
    letters = secrets.UPPER + secrets.LOWER_HEX + secrets.LOWER
    draw = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    formats = {
        "known prefix, letters alone": lambda: "ghp_" + draw(letters, 36),
        "base 64, letters alone": lambda: draw(letters, 40),
        "unknown prefix": lambda: "npm_" + draw(letters + secrets.DIGITS, 36),
        "two parts": lambda: "SG." + draw(letters + secrets.DIGITS, 22) + "." + draw(letters + secrets.DIGITS, 43),
        "behind a path": lambda: "src/main/AIza" + draw(letters + secrets.DIGITS + "-_", 35),
    }
    for name, make in formats.items():
        found = sum(any(k == 3 for _, k, _ in scanner.spans(f"see {make()} there")) for _ in range(100))
        assert found >= 90, (name, found)
    prose = "Internationalization/responsibilities characteristically_misunderstood Geschwindigkeitsbegrenzungen www.example.org/some/longer/path"
    assert scanner.spans(prose) == []
