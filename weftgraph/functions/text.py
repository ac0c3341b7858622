"""Scalar text functions as column expressions: language, cleaning, hashes, tags, JSON."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

CJK = "[\\u4e00-\\u9fff]"

#: What titles, captions and image lines look like, for Python and for Spark alike.
MARKED_TITLE = r"#{1,6}\s+.+"
NUMBERED_TITLE = r"(?:\d+(?:\.\d+)+(?:\s+.*)?|\d+\s+.+)$"
CHAPTER_TITLE = "第[一二三四五六七八九十百千万\\d]+[章节篇]\\s*.+"
TABLE_CAPTION = r"(?i)(?:table|tab\.?)\s*\d+[\.:]?\s+"
IMAGE_CAPTION = r"(?i)(?:figure|fig\.?|image|img\.?)\s*\d+[\.:]?\s+"
CHINESE_CAPTION = "图\\s*\\d+[\\.:：]?\\s*"
MARK_IMAGE = r"!\[[^\]]*\]\([^)]+\)"
MARK_IMAGE_PATH = r'!\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
HTML_IMAGE = r"(?i)<img\b[^>]*src=['\"]([^'\"]+)['\"][^>]*>"


def _count(text: Column, kind: str) -> Column:
    """Characters of a class: what the text is longer than without its runs of them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def main_language(text: Column) -> Column:
    """zh where at least half of the CJK and ASCII letters are CJK, else en."""
    han, latin = _count(text, CJK), _count(text, "[A-Za-z]")
    return F.when((han > 0) & (han * 2 >= han + latin), "zh").otherwise("en")


def has_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def content_hash(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.md5(text.cast("binary")))


def trace_id(prefix: str, *columns: str) -> Column:
    """Content address of a row: prefix and MD5 of the JSON of the named columns in name order."""
    return content_hash(F.to_json(F.struct(*sorted(columns))), prefix)


def split_markers(text: Column, markers: list[str]) -> Column:
    """Parts between any of the literal markers, trimmed, blanks dropped."""
    pattern = "|".join("\\Q" + m + "\\E" for m in markers)
    parts = F.split(text, pattern) if markers else F.array(text)
    return F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != "")


#: White space as ``strip`` takes it.
BLANK = " \t\n\x0b\f\r\u00a0\x1c\x1d\x1e\x1f"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text, F.lit(BLANK))


@arrow_udf(StringType())
def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


def unescape(text: Column) -> Column:
    """HTML entities resolved, by name or number; only texts with an ampersand leave the JVM."""
    marked = F.contains(text, F.lit("&"))
    return F.when(marked, _unescaped(F.when(marked, text))).otherwise(text)


def _bare(text: Column) -> Column:
    """Without control characters and outer double, then single quotes."""
    out = F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", "")
    return F.trim(F.trim(out, F.lit('"')), F.lit("'"))


def clean(text: Column) -> Column:
    """Trimmed, entities resolved, control characters deleted, outer double then single quotes removed."""
    return _bare(unescape(strip(text)))


def clean_parts(text: Column, mark: str) -> Column:
    """``clean`` of each part between the marks; only texts with an ampersand leave the JVM, whole."""

    @arrow_udf(ArrayType(StringType()))
    def unescaped(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [html.unescape(x.strip(BLANK)) for x in t.split(mark)] for t in texts.to_pylist()], pa.list_(pa.string()))

    marked = F.contains(text, F.lit("&"))
    parts = F.transform(F.split(text, "\\Q" + mark + "\\E"), lambda x: strip(x))
    return F.transform(F.when(marked, unescaped(F.when(marked, text))).otherwise(parts), _bare)


def normalize_evidence(text: Column) -> Column:
    """Cleaned, then white space runs as one blank; line ends were deleted by cleaning."""
    return strip(F.regexp_replace(clean(text), r"[\s ]+", " "))


def evidence_supported(evidence: Column, source: Column) -> Column:
    e = normalize_evidence(evidence)
    return F.coalesce((e != "") & F.contains(normalize_evidence(source), e), F.lit(False))


def is_float(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), F.lit(False))


def without_think(text: Column) -> Column:
    """Reasoning blocks removed; an orphan closing tag removes all before it; never empty."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    out = strip(F.regexp_replace(out, r"(?s)^.*</think>", ""))
    return F.when(F.contains(text, F.lit("</think>")), F.coalesce(F.nullif(out, F.lit("")), strip(text))).otherwise(strip(text))


def tag(text: Column, name: str) -> Column:
    """The first <name>…</name>, trimmed and without outer quotes; null where absent."""
    pattern = rf"(?s)<{name}>(.*?)</{name}>"
    found = F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))
    return F.regexp_replace(F.regexp_replace(found, '^"+|"+$', ""), "^'+|'+$", "")


def tags(text: Column, name: str) -> Column:
    """All bodies of <name>…</name> in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{name}>(.*?)</{name}>"), F.lit(1))


def json_payload(text: Column) -> Column:
    """JSON in a reply: the text itself, else a fenced block, else first to last brace; null otherwise (VARIANT)."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(strip(text)), F.try_parse_json(F.nullif(strip(fenced), F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))


def metadata_map(text: Column) -> Column:
    """A JSON object as map<string,string>; empty for anything else."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def compact(text: Column, limit: int = 240) -> Column:
    """Trimmed; longer texts cut to the limit with an ellipsis."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def clip_score(text: Column, default: float = 0.0) -> Column:
    value = text.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def allowed_values(values: Column, allowed: list[str], fallback: list[str]) -> Column:
    """Allowed values that occur, in the allowed order; the fallback where none does."""
    hit = F.filter(F.array(*map(F.lit, allowed)), lambda x: F.array_contains(values, x))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(*map(F.lit, fallback)))


def edge_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def source_ids(text: Column) -> Column:
    return F.filter(F.split(text, "\\Q<SEP>\\E"), lambda x: F.trim(x) != "")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def history(texts: Column) -> Column:
    """Texts as messages that alternate between user and assistant."""
    return F.transform(texts, lambda t, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), t.alias("content")))


def ocr_lines(text: Column, limit: int = 1600) -> Column:
    """OCR text without short, numeric, page and axis lines, repeats (any case) dropped, cut at whole lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: (F.length(x) >= 3) & ~x.rlike(r"^[-\d\s.,:%/()]+$") & ~F.lower(x).rlike(r"^(page|p\.?)\s*\d+(\s*(of|/)\s*\d+)?$") & ~F.lower(x).rlike(r"^[xy]([- ]?axis)?$"))
    unique = F.aggregate(lines, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def add(acc, x):
        n = acc["n"] + F.length(x) + F.when(acc["n"] > 0, 1).otherwise(0)
        fits = acc["open"] & (n <= limit)
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"), F.when(fits, n).otherwise(acc["n"]).alias("n"), fits.alias("open"))

    return F.array_join(F.aggregate(unique, start, add, lambda acc: acc["kept"]), "\n")


def title_level(title: Column) -> Column:
    """1..6 from markdown marks, dotted numbers or Chinese chapter marks; the deeper of mark and number."""
    t = strip(F.coalesce(title, F.lit("")))
    marks = F.length(F.regexp_extract(t, r"^(#{1,6})\s+.+$", 1))
    body = F.when(marks > 0, strip(F.regexp_extract(t, r"^#{1,6}\s+(.+)$", 1))).otherwise(t)
    dots = F.regexp_extract(body, r"^(\d+(?:\.\d+)*)(?:\s+.+)?$", 1)
    chapter = F.regexp_extract(body, "^第[一二三四五六七八九十百千万\\d]+([章节篇])", 1)
    numeric = F.least(F.lit(6), F.regexp_count(dots, F.lit(r"\.")) + 1)
    level = F.when(dots != "", F.greatest(marks, numeric)).when(chapter != "", F.greatest(marks, F.when(chapter.isin("章", "篇"), 1).otherwise(2))).when(marks > 0, marks).otherwise(1)
    return level.cast("int")


def is_title(line: Column) -> Column:
    t = strip(F.coalesce(line, F.lit("")))
    return t.rlike(f"^{MARKED_TITLE}") | t.rlike(f"^{NUMBERED_TITLE}") | t.rlike(f"^{CHAPTER_TITLE}")


def is_table_caption(line: Column) -> Column:
    return strip(line).rlike(f"^{TABLE_CAPTION}")


def is_image_caption(line: Column) -> Column:
    t = strip(line)
    return t.rlike(f"^{IMAGE_CAPTION}") | t.rlike(f"^{CHINESE_CAPTION}")


def image_path(line: Column) -> Column:
    """The path of a markdown or HTML image; empty where there is none."""
    t = strip(line)
    mark = F.regexp_extract(t, f"^{MARK_IMAGE_PATH}", 1)
    return F.when(mark != "", mark).otherwise(F.regexp_extract(t, HTML_IMAGE, 1))


def section_slug(title: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(title)), r"[^0-9a-z一-鿿]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", "section").otherwise(s)


#: A token of the default counter: a CJK character, a word or a mark.
TOKEN = "[\\u4e00-\\u9fff]|[A-Za-z0-9_\\u00c0-\\u024f]+|[^\\sA-Za-z0-9_\\u00c0-\\u024f\\u4e00-\\u9fff]"


def token_count(text: Column) -> Column:
    """Default token counter."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("int")


def words(text: Column) -> Column:
    """Lower-case word tokens; each CJK character is one."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\u4e00-\\u9fff]|[a-z0-9\\u00c0-\\u024f]+"), F.lit(0))
