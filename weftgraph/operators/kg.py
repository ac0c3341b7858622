"""Knowledge-graph extraction and merging.

``extraction replies → records → grounded records → nodes and edges`` are all
column expressions and grouped aggregates; only the reply itself comes from a
model. Multi-valued fields are arrays and joined with ``<SEP>`` at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.models.base import Model, complete
from weftgraph.sources.storage import cut_lineage

#: The delimiters of an extraction reply.
FIELD, RECORD, DONE = "<|>", "##", "<|COMPLETE|>"
SEP = "<SEP>"


def records(replies: DataFrame, *also: str) -> DataFrame:
    """(chunk_id, ord, kind, f) of every well-formed record in ``reply``: its first field, and all fields cleaned; further columns are kept."""
    parts = replies.select("chunk_id", *also, F.posexplode(tx.split_markers(F.col("reply"), [RECORD, DONE])).alias("ord", "record"))
    parts = parts.withColumn("body", F.regexp_extract("record", r"\((.*)\)", 1)).filter(F.size(F.split("body", "\\Q" + FIELD + "\\E")) >= 4)
    return parts.select("chunk_id", "ord", *also, tx.strip(F.substring_index("body", FIELD, 1)).alias("kind"), tx.clean_parts(F.col("body"), FIELD).alias("f"))


def _at(i: int) -> Column:
    return F.get("f", F.lit(i))


def _typed() -> Column:
    return F.size("f") >= 7


def _evidence() -> Column:
    """Of a record of either kind."""
    return F.when((F.col("kind") == '"relationship"') & _typed(), _at(5)).otherwise(F.coalesce(_at(4), F.lit("")))


def _held(recs: DataFrame) -> list[str]:
    return [c for c in ("stated", "supported") if c in recs.columns]


def entity_mentions(recs: DataFrame) -> DataFrame:
    """(chunk_id, ord, name, type, description, evidence); names and types in upper case, blank names dropped."""
    e = recs.filter(F.col("kind") == '"entity"')
    return e.select("chunk_id", "ord", F.upper(_at(1)).alias("name"), F.upper(_at(2)).alias("type"), _at(3).alias("description"), _evidence().alias("evidence"), *_held(recs)).filter("name != ''")


def relation_mentions(recs: DataFrame) -> DataFrame:
    """(chunk_id, ord, src, dst, relation, description, evidence, confidence).

    Seven fields make a typed relation; four to six an untyped one with
    confidence 0.5. A confidence that is no plain number counts as 0.5, others
    are clamped to 0..1.
    """
    r = recs.filter(F.col("kind") == '"relationship"')
    raw = _at(6)
    value = F.when(tx.is_float(raw), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw.try_cast("double")))).otherwise(0.5)
    empty = F.lit("")
    return r.select(
        "chunk_id", "ord", F.upper(_at(1)).alias("src"), F.upper(_at(2)).alias("dst"),
        F.when(_typed(), F.coalesce(F.nullif(_at(3), empty), F.lit("related_to"))).otherwise("related_to").alias("relation"),
        F.when(_typed(), _at(4)).otherwise(_at(3)).alias("description"), _evidence().alias("evidence"), F.when(_typed(), value).otherwise(0.5).alias("confidence"), *_held(recs),
    ).filter("src != '' AND dst != ''")


def tested(replies: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """``records`` with ``stated``, whether there is evidence, and with ``chunks`` (chunk_id, content) ``supported``, whether the chunk has it.

    A chunk's text is normalised once, before its records are taken apart. The
    table is written, as mentions of both kinds and all that is merged of them read it.
    """
    also = []
    if chunks is not None:
        replies, also = replies.join(chunks.select("chunk_id", tx.normalize_evidence(F.col("content")).alias("source")), "chunk_id"), ["source"]
    recs = records(replies, *also).withColumn("evidence", _evidence()).withColumn("plain", tx.normalize_evidence(F.col("evidence")))
    out = ["chunk_id", "ord", "kind", "f", (F.col("plain") != "").alias("stated")]
    if chunks is not None:
        found = (F.col("plain") != "") & F.contains("source", "plain")
        out.append(((F.col("evidence") == "") | F.coalesce(found, F.lit(False))).alias("supported"))
    return cut_lineage(recs.select(*out))


def ground(mentions: DataFrame, *, require: bool, least: float | None = None) -> DataFrame:
    """Mentions of ``tested`` records that pass the evidence and confidence rules."""
    out = mentions.filter(F.col("confidence") >= least) if least is not None and "confidence" in mentions.columns else mentions
    if require:
        out = out.filter("stated")
    if "supported" in mentions.columns:
        out = out.filter("supported")
    return out.drop("stated", "supported")


def strict_triplets(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations whose ends are entities of the same chunk, and the entities that such a relation uses."""
    names = entities.select("chunk_id", "name").distinct()
    r = relations.join(names.withColumnRenamed("name", "src"), ["chunk_id", "src"], "left_semi").join(names.withColumnRenamed("name", "dst"), ["chunk_id", "dst"], "left_semi")
    used = r.select("chunk_id", F.explode(F.array("src", "dst")).alias("name"))
    return entities.join(used, ["chunk_id", "name"], "left_semi"), r


def majority(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent ``value`` per key; ties go to the first seen (chunk_id, ord), then the name."""
    n = rows.groupBy(*key, value).agg(F.count("*").alias("n"), F.min(F.struct("chunk_id", "ord")).alias("first"))
    order = Window.partitionBy(*key).orderBy(F.desc("n"), "first", value)
    return n.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select(*key, value)


#: Sums of confidences are exact decimals, so they don't depend on the order of the increments.
EXACT = "decimal(38,18)"


class GraphState:
    """What merging has to remember, as three tables that merge by one grouped union each.

    ``labels``: (src, dst, label, n, first), how often a name (dst null) or pair was given a type or
    relation, and the first mention (chunk_id, ord) that did. ``values``: (src, dst, field, value), the distinct descriptions,
    evidence spans and chunks. ``sums``: (src, dst, total, n) of confidences.
    Counts, sums, minima and sets of two states add up to those of all their
    mentions, so increments in any order give what one run gives.
    """

    TABLES = ("labels", "values", "sums")

    def __init__(self, labels: DataFrame, values: DataFrame, sums: DataFrame):
        self.labels, self.values, self.sums = labels, values, sums

    @classmethod
    def of(cls, entities: DataFrame, relations: DataFrame) -> GraphState:
        """The state of mentions; relations between a name and itself are none."""
        one = F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("ord").cast("bigint").alias("ord"))
        e = entities.select(F.col("name").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("type").alias("label"), "description", "evidence", F.col("chunk_id").cast("string").alias("chunk"), one.alias("first"), F.lit(None).cast(EXACT).alias("confidence"))
        r = relations.filter("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("relation").alias("label"), "description", "evidence", F.col("chunk_id").cast("string").alias("chunk"), one.alias("first"), F.col("confidence").cast(EXACT).alias("confidence"))
        both = e.unionByName(r)
        fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("description", "evidence", "chunk")])
        return cls(
            both.groupBy("src", "dst", "label").agg(F.count("*").alias("n"), F.min("first").alias("first")),
            both.select("src", "dst", F.explode(fields).alias("x")).select("src", "dst", "x.*").filter("value != ''").distinct(),
            r.groupBy("src", "dst").agg(F.sum("confidence").cast(EXACT).alias("total"), F.count("confidence").alias("n")),
        )

    def merge(self, other: GraphState) -> GraphState:
        union = lambda t: getattr(self, t).unionByName(getattr(other, t))
        return GraphState(
            union("labels").groupBy("src", "dst", "label").agg(F.sum("n").alias("n"), F.min("first").alias("first")),
            union("values").distinct(),
            union("sums").groupBy("src", "dst").agg(F.sum("total").cast(EXACT).alias("total"), F.sum("n").alias("n")),
        )

    def save(self, path: str) -> GraphState:
        """Writes the state below ``path``, which must be new, and reads it from there."""
        for t in self.TABLES:
            getattr(self, t).write.parquet(f"{path}/{t}")
        return self.load(self.labels.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphState:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in cls.TABLES])

    def _label(self, rows: DataFrame, *key: str) -> DataFrame:
        """The most frequent label of each key; ties go to the first seen, then the label. No key gathers its labels."""
        top = rows.groupBy(*key).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "first", "label")).alias("label"))
        return top

    def _joined(self, rows: DataFrame, key: list[str], most: int | None) -> DataFrame:
        """Sorted values of each field, as arrays; with ``most``, tasks cut them before the shuffle."""
        if most is not None:
            place = F.row_number().over(Window.partitionBy(*key, "field").orderBy("value"))
            rows = rows.withColumn("__n", place).filter(F.col("__n") <= most)
        return rows.groupBy(*key).agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == f, F.col("value")))).alias(f) for f in ("description", "evidence", "chunk")])

    def _columns(self, limit: int) -> list[Column]:
        described = F.array_join(F.coalesce("description", F.array()), SEP)
        joined = lambda c: F.array_join(F.coalesce(c, F.array()), SEP)
        return [described.alias("description"), joined("evidence").alias("evidence_span"), joined("chunk").alias("source_id"), tx.token_count(described).alias("length"), (tx.token_count(described) >= limit).alias("too_long")]

    def nodes(self, *, limit: int = 200, most: int | None = None) -> DataFrame:
        """One row per name; ``most`` bounds the values of a field that a row holds (the state keeps all)."""
        label = self._label(self.labels.filter("dst IS NULL"), "src")
        out = label.join(self._joined(self.values.filter("dst IS NULL"), ["src"], most), "src", "left")
        description, evidence, source, length, too_long = self._columns(limit)
        return out.select(F.col("src").alias("id"), F.col("label").alias("entity_type"), description, evidence, source, length, too_long)

    def edges(self, *, limit: int = 200, most: int | None = None) -> DataFrame:
        """One row per unordered pair whose ends are names; confidence is the mean."""
        names = self.labels.filter("dst IS NULL").select("src").distinct()
        key = ["src", "dst"]
        label = self._label(self.labels.filter("dst IS NOT NULL"), *key).join(names, "src", "left_semi").join(names.withColumnRenamed("src", "dst"), "dst", "left_semi")
        out = label.join(self._joined(self.values.filter("dst IS NOT NULL"), key, most), key, "left").join(self.sums, key)
        description, evidence, source, length, too_long = self._columns(limit)
        mean = F.col("total").cast("double") / F.col("n")
        return out.select("src", "dst", F.col("label").alias("relation_type"), description, evidence, source, mean.alias("confidence"), F.col("total").cast("double").alias("sum_confidence"), F.col("n").alias("n_confidence"), length, too_long)


def _no_relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "src string, dst string, relation string, description string, evidence string, confidence double, chunk_id string, ord bigint")


def merge_nodes(entities: DataFrame, *, limit: int = 200, most: int | None = None) -> DataFrame:
    """One row per name: majority type, sorted distinct descriptions, evidence and sources, token length."""
    return GraphState.of(entities, _no_relations(entities.sparkSession)).nodes(limit=limit, most=most)


def merge_edges(relations: DataFrame, nodes: DataFrame, *, limit: int = 200, most: int | None = None) -> DataFrame:
    """One row per unordered pair whose ends are nodes (id)."""
    named = nodes.select(F.col("id").alias("name"), F.lit("").alias("type"), F.lit("").alias("description"), F.lit("").alias("evidence"), F.lit("").alias("chunk_id"), F.lit(0).alias("ord"))
    return GraphState.of(named, relations).edges(limit=limit, most=most)


def summarize(rows: DataFrame, model: Model, *, tokens: int = 200) -> DataFrame:
    """Descriptions over the limit are replaced by the model's summary of their first ``tokens`` tokens."""
    name = F.col("id") if "id" in rows.columns else F.concat_ws(" - ", "src", "dst")
    first = F.regexp_extract("description", rf"(?s)^(?:\s*(?:{tx.TOKEN})){{0,{tokens}}}", 0)
    prompt = F.when(F.col("too_long"), F.concat(F.lit("Summarize what is said of "), name, F.lit(" in a few sentences:\n"), F.replace(first, F.lit(SEP), F.lit("\n"))))
    out = complete(rows.withColumn("prompt", prompt), model, "prompt", "summary")
    return out.withColumn("description", F.coalesce(F.nullif("summary", F.lit("")), "description")).drop("prompt", "summary").withColumn("length", tx.token_count(F.col("description")))


EXTRACT_PROMPT = """Extract the entities and the relations between them from the text.
Write each entity as ("entity"<|>name<|>type<|>summary<|>evidence) and each relation as
("relationship"<|>source<|>target<|>relation type<|>summary<|>evidence<|>confidence).
Separate records with ## and end with <|COMPLETE|>. Evidence is quoted from the text.
Text:
"""
CONTINUE_PROMPT = "\nRecords so far are above. Add the ones that are missing, in the same format."
AGAIN_PROMPT = "\nRecords so far are above. Are entities or relations missing? Answer yes or no."


def extraction_replies(chunks: DataFrame, model: Model, *, max_loop: int = 3) -> DataFrame:
    """(chunk_id, reply): the first reply and up to ``max_loop`` further ones, each after the model said that some are missing."""
    rows = chunks.select("chunk_id", "content").withColumn("prompt", F.concat(F.lit(EXTRACT_PROMPT), "content"))
    rows = complete(rows, model, "prompt", "reply").withColumn("open", F.col("reply").isNotNull())
    asked = lambda more: F.when(F.col("open"), F.concat("prompt", F.lit("\n"), "reply", F.lit(more)))
    for _ in range(max_loop):
        rows = complete(rows.withColumn("ask", asked(AGAIN_PROMPT)), model, "ask", "again")
        said = F.lower(F.regexp_replace(tx.strip(F.col("again")), "^[\"']+|[\"']+$", ""))
        rows = rows.withColumn("open", F.coalesce(said == "yes", F.lit(False)))
        rows = complete(rows.withColumn("ask", asked(CONTINUE_PROMPT)), model, "ask", "more")
        rows = rows.withColumn("reply", F.when(F.col("more").isNotNull(), F.concat("reply", F.lit(RECORD), "more")).otherwise(F.col("reply"))).drop("ask", "again", "more")
    return rows.select("chunk_id", "reply").filter("reply IS NOT NULL")


def mentions(chunks: DataFrame, replies: DataFrame, *, require_entity_evidence: bool = False, require_relation_evidence: bool = True, validate: bool = True, least_confidence: float = 0.5, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entity and relation mentions of text chunks (chunk_id, content) that pass the rules."""
    recs = tested(replies, chunks if validate else None)
    entities = ground(entity_mentions(recs), require=require_entity_evidence)
    relations = ground(relation_mentions(recs), require=require_relation_evidence, least=least_confidence)
    return strict_triplets(entities, relations) if strict else (entities, relations)


def build(chunks: DataFrame, replies: DataFrame, *, multimodal: tuple[DataFrame, DataFrame] | None = None, summarizer: Model | None = None, limit: int = 200, **rules) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from chunks and their extraction replies.

    ``multimodal`` holds chunks of images and tables as :func:`multimodal_text`
    gives them, and their replies. No evidence rule applies to these, as what
    they show isn't quoted; the node that stands for an image or table carries
    the chunk's ``metadata`` as JSON. With ``summarizer`` descriptions of
    ``limit`` tokens or more are summarised.
    """
    entities, relations = mentions(chunks, replies, **rules)
    shown = None
    if multimodal is not None:
        rows, answers = multimodal
        recs = records(answers.join(rows.select("chunk_id"), "chunk_id", "left_semi"))
        more = entity_mentions(recs)
        entities, relations = entities.unionByName(more), relations.unionByName(relation_mentions(recs))
        of = rows.select("chunk_id", F.upper("type").alias("type"), "metadata")
        shown = more.join(of, ["chunk_id", "type"]).groupBy(F.col("name").alias("id")).agg(F.min_by("metadata", F.struct("chunk_id", "ord")).alias("metadata"))
    state = GraphState.of(entities, relations)
    nodes, edges = state.nodes(limit=limit), state.edges(limit=limit)
    if shown is not None:
        nodes = nodes.join(shown, "id", "left")
    if summarizer is not None:
        nodes, edges = summarize(nodes, summarizer), summarize(edges, summarizer)
    return nodes, edges


def build_tree(chunks: DataFrame, replies: DataFrame, *, grounded: bool = False, **rules) -> tuple[DataFrame, DataFrame]:
    """As ``build``, for chunks of a document tree; grounded switches every evidence rule on."""
    if grounded:
        rules |= {"require_entity_evidence": True, "require_relation_evidence": True, "validate": True, "strict": True}
    return build(chunks, replies, **rules)


def with_document_path(chunks: DataFrame) -> DataFrame:
    """Chunk contents with the path of their section in front."""
    return chunks.withColumn("content", F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit("[Document Path]\n"), "path", F.lit("\n\n"), "content")).otherwise(F.col("content")))


#: An image's text that is shorter than this is too little to extract from.
LEAST_IMAGE_TEXT = 40


def multimodal_text(rows: DataFrame) -> DataFrame:
    """(chunk_id, type, content, metadata) of images and tables: the text that stands for them.

    An image has its caption, the notes near it and its OCR lines; where that is
    under 40 characters, its own content comes behind. A table has its caption
    and body, or else its content. ``caption`` may be a string or an array.
    Formulas and other types give no rows.
    """
    flat = lambda c: F.coalesce(F.array_join(c, "\n") if dict(rows.dtypes)[c].startswith("array") else F.col(c), F.lit(""))
    column = lambda c: tx.strip(flat(c)) if c in rows.columns else F.lit("")
    part = lambda label, c: F.when(c != "", F.concat(F.lit(f"[{label}]\n"), c))
    own = column("content")
    packed = F.concat_ws("\n\n", part("Image Caption", column("caption")), part("Nearby Text", column("note")), part("OCR", tx.ocr_lines(column("ocr"))))
    image = F.when((F.length(packed) >= LEAST_IMAGE_TEXT) | (own == ""), packed).when(packed == "", own).otherwise(F.concat(packed, F.lit("\n\n[Fallback Context]\n"), own))
    body = F.concat_ws("\n\n", *[F.nullif(column(c), F.lit("")) for c in ("caption", "body")])
    table = F.when(body != "", body).otherwise(own)
    held = [c for c in ("caption", "note", "ocr", "body", "img_path") if c in rows.columns]
    meta = F.to_json(F.struct(*held)) if held else F.lit("{}")
    return rows.filter(F.col("type").isin("image", "table")).select("chunk_id", "type", F.when(F.col("type") == "image", image).otherwise(table).alias("content"), meta.alias("metadata"))


def filter_entities(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a span of evidence in one of their source chunks, and edges between kept nodes.

    Spans meet only the node's own sources: an equi-join on the chunk id, with
    containment as the residual condition.
    """
    flat = nodes.select("id", F.explode(tx.source_ids(F.col("source_id"))).alias("chunk_id"), "evidence_span")
    spans = flat.select("id", "chunk_id", F.explode(F.split("evidence_span", "\\Q" + SEP + "\\E")).alias("span"))
    held = spans.join(chunks.select("chunk_id", "content"), "chunk_id").filter(tx.evidence_supported(F.col("span"), F.col("content"))).select("id").distinct()
    kept = nodes.join(held, "id", "left_semi")
    gone = nodes.join(held, "id", "left_anti").select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, left.select(*edges.columns)


def containing(docs: DataFrame, spans: DataFrame, *, words: int = 8) -> DataFrame:
    """(doc_id, t, item_id, span) for each ``span`` that occurs whole in ``t``; runs of blanks are single spaces in both.

    Inner words of a span are bounded by spaces, so they are words of the text
    too: candidates share the hash of the first ``words`` of them (or all, if
    fewer) and are then tested on the whole span. Spans without an inner word
    are tested on every text.
    """
    inner = F.split("span", " ")
    s = spans.withColumn("__inner", F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))).withColumn("__n", F.least(F.size("__inner"), F.lit(words)))
    keyed = cut_lineage(s.filter("__n > 0").select("item_id", "span", "__n", F.xxhash64(F.slice("__inner", 1, F.col("__n"))).alias("__key")))
    sizes = sorted(r["__n"] for r in keyed.select("__n").distinct().collect())
    gram = lambda w, n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(F.lit(n).alias("__n"), F.xxhash64(*[F.get(w, i + k) for k in range(n)]).alias("__key")))
    short = docs.join(s.filter("__n <= 0").select("item_id", "span"), F.contains("t", "span"))
    if not sizes:
        return short.select("doc_id", "t", "item_id", "span")
    empty = F.array().cast("array<struct<__n:int,__key:bigint>>")
    grams = lambda w: F.concat(*[F.when(F.size(w) >= n, gram(w, n)).otherwise(empty) for n in sizes])
    # the words are bound by a lambda and taken one by one: an inlined column would split the text anew
    # for each of them, and a slice copies all of them
    own = docs.select("doc_id", F.explode(F.get(F.transform(F.array(F.split("t", " ")), grams), F.lit(0))).alias("g")).select("doc_id", "g.*")
    pairs = own.join(keyed.select("item_id", "__n", "__key"), ["__n", "__key"]).select("doc_id", "item_id").distinct()
    found = docs.join(pairs, "doc_id").join(keyed.select("item_id", "span"), "item_id").filter(F.contains("t", "span"))
    return found.select("doc_id", "t", "item_id", "span").unionByName(short.select("doc_id", "t", "item_id", "span"))
