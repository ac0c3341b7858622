"""Document trees: markdown components, levels, tree rows, chunks with paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftgraph.functions import text as tx
from weftgraph.functions.split import Splitter, recursive, split_udf

COMPONENT = "struct<type:string,title:string,content:string,img_path:string,caption:array<string>,body:string,note:string>"

_TITLES = [re.compile(p) for p in (tx.MARKED_TITLE, tx.NUMBERED_TITLE, tx.CHAPTER_TITLE)]
_CAPTIONS = [re.compile(p) for p in (tx.IMAGE_CAPTION, tx.CHINESE_CAPTION)]
_TABLE_CAPTION = re.compile(tx.TABLE_CAPTION)
_MARK_IMAGE, _MARK_IMAGE_PATH, _HTML_IMAGE = (re.compile(p) for p in (tx.MARK_IMAGE, tx.MARK_IMAGE_PATH, tx.HTML_IMAGE))

#: What a line may open; all other lines are prose.
TITLE, TABLE, IMAGE, PROSE = "title", "table", "image", "prose"


def line_kind(line: str) -> str:
    """The kind of a stripped line by its own looks."""
    if any(p.match(line) for p in _TITLES):
        return TITLE
    if line[:6].lower() == "<table":
        return TABLE
    return IMAGE if _MARK_IMAGE.match(line) or _HTML_IMAGE.search(line) else PROSE


def _image_path(line: str) -> str:
    found = _MARK_IMAGE_PATH.match(line) or _HTML_IMAGE.search(line)
    return found[1] if found else ""


def _squeeze(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text.strip())


@dataclass
class Block:
    """Lines of one kind that belong together: a title, an image, a whole table, or prose between such."""

    kind: str
    lines: list[str]

    def paragraphs(self) -> list[list[str]]:
        return [list(held) for blank, held in groupby(self.lines, lambda x: not x.strip()) if not blank]


def blocks(content: str) -> list[Block]:
    """The text as blocks; there is a prose block, maybe empty, before, between and behind all others."""
    out: list[Block] = [Block(PROSE, [])]
    table: Block | None = None
    for raw in content.splitlines():
        kind = TABLE if table else line_kind(raw.strip())
        if table:
            table.lines.append(raw)
        elif kind == PROSE:
            out[-1].lines.append(raw)
        else:
            out += [Block(kind, [raw]), Block(PROSE, [])]
        if kind == TABLE:
            table = None if "</table>" in raw.lower() else out[-2]
    return out


def _image(block: Block, behind: Block) -> dict:
    """An image with what is said behind it; the prose is used up if a caption is in it."""
    said = [x.strip() for x in behind.lines]
    at = next((i for i, x in enumerate(said) if any(p.match(x) for p in _CAPTIONS)), None)
    notes, caption = ([], []) if at is None else ([x for x in said[:at] if x], [x for x in said[at:] if x])
    if at is not None:
        behind.lines = []
    note, shown = _squeeze("\n".join(notes)), _squeeze("\n".join(caption))
    content = "\n\n".join([*([shown] if shown else []), *([f"[Notes]\n{note}"] if note else [])])
    return {"type": "image", "content": content, "img_path": _image_path(block.lines[0].strip()), "caption": caption, "note": note}


def _table(block: Block, before: Block) -> dict:
    """A table with the paragraph before it, if that is a caption, which it takes away."""
    held, caption = before.paragraphs(), ""
    if held and _TABLE_CAPTION.match(last := _squeeze("\n".join(held[-1]))):
        caption, before.lines = last, [x for paragraph in held[:-1] for x in (*paragraph, "")]
    body = _squeeze("\n".join(block.lines))
    content = (f"[Table Caption]\n{caption}\n\n" if caption else "") + f"[Table Body]\n{body}"
    return {"type": "table", "content": content, "caption": [caption] if caption else [], "body": body}


def parse_markdown(content: str) -> list[dict]:
    """Sections, paragraphs, tables and images in order.

    A table takes the paragraph before it as caption when that looks like one;
    an image takes the lines behind it as notes and caption when a caption is
    among them.
    """
    held = blocks(content or "")
    made: dict[int, dict] = {}
    # images first, since their captions may stand before a table too
    for kind in (IMAGE, TABLE):
        for i in range(1, len(held), 2):
            if held[i].kind == kind:
                made[i] = _image(held[i], held[i + 1]) if kind == IMAGE else _table(held[i], held[i - 1])
    out, title = [], "Document"
    for i, block in enumerate(held):
        if block.kind == TITLE:
            title = block.lines[0].strip()
            parts = [{"type": "section", "content": ""}]
        elif block.kind == PROSE:
            parts = [{"type": "text", "content": "\n".join(p).strip()} for p in block.paragraphs()]
        else:
            parts = [made[i]]
        out += [{"type": "", "title": title, "content": "", "img_path": "", "caption": [], "body": "", "note": ""} | p for p in parts]
    return out


def components(content: Column) -> Column:
    """The components of a markdown text, by an Arrow UDF."""

    @pandas_udf(f"array<{COMPONENT}>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(parse_markdown)

    return parse(content)


def analyze_structure(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, type, title, content, img_path, caption, body, note) per component, ord from 1."""
    return docs.select("doc_id", F.posexplode(components(F.col("content"))).alias("pos", "c")).select("doc_id", (F.col("pos") + 1).alias("ord"), "c.*")


def assign_levels(parts: DataFrame) -> DataFrame:
    """``title_level`` from the title; a level that a caller has set (1 or more) stays."""
    given = F.when(F.col("title_level") > 0, F.col("title_level")) if "title_level" in parts.columns else F.lit(None).cast("int")
    return parts.withColumn("title_level", F.coalesce(given, tx.title_level(F.col("title"))))


def construct_tree(parts: DataFrame, *, max_level: int = 6) -> DataFrame:
    """Rows with node_id, parent_id, key and path.

    A section's parent is the last section before it with a lower level; other
    rows hang below the last section. The stack form pops sections of the same
    or a deeper level, so per level the last section is open only if no later
    section of a lower level closed it: the parent is the latest of them.
    Levels over ``max_level`` count as that level.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    level = F.least(F.greatest(F.lit(1), F.coalesce("title_level", F.lit(1))), F.lit(max_level))
    p = parts.withColumn("level", level)
    section = F.col("type") == "section"
    lasts = [F.last(F.when(section & (F.col("level") == k), F.col("ord")), ignorenulls=True).over(w) for k in range(1, max_level + 1)]
    p = p.withColumn("__last", F.array(*lasts))
    lower = F.array_max(F.filter("__last", lambda x, i: x.isNotNull() & (i + 1 < F.col("level"))))
    p = p.withColumn("parent_ord", F.when(section, lower).otherwise(F.array_max("__last"))).drop("__last")
    slug = F.when(section, tx.section_slug(F.col("title"))).otherwise(F.col("type"))
    p = p.withColumn("slug", slug)
    same = F.row_number().over(Window.partitionBy("doc_id", "parent_ord", "slug").orderBy("ord")) - 1
    p = p.withColumn("key", F.when(same == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), same.cast("string"))))
    # paths: ancestors are at most one section per level above, so max_level joins reach the root
    up = p.filter(section).select("doc_id", F.col("ord").alias("up"), F.col("key").alias("a_key"), F.col("parent_ord").alias("a_parent"))
    out = p.withColumn("path", F.col("key")).withColumn("up", F.col("parent_ord"))
    for _ in range(max_level):
        out = out.join(up, ["doc_id", "up"], "left")
        out = out.withColumn("path", F.when(F.col("a_key").isNotNull(), F.concat("a_key", F.lit("/"), "path")).otherwise(F.col("path"))).withColumn("up", F.col("a_parent")).drop("a_key", "a_parent")
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    return out.withColumn("path", F.concat(F.lit("root/"), "path")).withColumn("node_id", name("ord")).withColumn("parent_id", F.coalesce(name("parent_ord"), F.lit("root"))).drop("up", "slug", "parent_ord")


def chunk_tree(tree: DataFrame, splitter: Splitter | None = None) -> DataFrame:
    """Chunks of the tree's content rows with their path; ``length`` is in characters here."""
    t = tree.filter("type != 'section' AND trim(content) != ''")
    keep = ["doc_id", "node_id", "parent_id", "path", "level", "type", "img_path", "caption", "body", "note"]
    text = t.filter("type = 'text'").withColumn("parts", split_udf({"en": splitter or recursive()})("content", tx.main_language(F.col("content")))).select(*keep, F.posexplode("parts").alias("ord", "content"))
    whole = t.filter("type != 'text'").select(*keep, F.lit(0).alias("ord"), "content")
    out = text.unionByName(whole)
    return out.withColumn("length", F.length("content")).withColumn("chunk_id", F.concat(F.lit("chunk-"), F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "node_id", F.col("ord").cast("string"), "content"))))
