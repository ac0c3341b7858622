"""Training records from subgraphs: context, prompts, reply parsing, formats.

Input communities are rows of ``graph.community_payloads``: arrays of node and
edge structs. Prompts, parsing and formats are expressions; one Arrow call per
prompt asks the model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.models.base import Model, complete


def context(nodes: Column, edges: Column, *, evidence: bool = True) -> Column:
    """Numbered entities and relations, with their evidence where they have some."""
    quoted = lambda x: F.when(F.coalesce(x["evidence_span"], F.lit("")) != "", F.concat(F.lit("\n   Evidence: "), x["evidence_span"])).otherwise("") if evidence else F.lit("")
    number = lambda i: F.concat((i + 1).cast("string"), F.lit(". "))
    n = F.transform(nodes, lambda x, i: F.concat(number(i), x["id"], F.lit(": "), F.coalesce(x["description"], F.lit("")), quoted(x)))
    e = F.transform(edges, lambda x, i: F.concat(number(i), x["src"], F.lit(" -- "), x["dst"], F.lit(" ["), F.coalesce(x["relation_type"], F.lit("related_to")), F.lit("]: "), F.coalesce(x["description"], F.lit("")), quoted(x)))
    return F.concat(F.lit("Entities:\n"), F.array_join(n, "\n"), F.lit("\n\nRelations:\n"), F.array_join(e, "\n"))


#: What each method asks for; (instruction, pieces of the reply).
PROMPTS = {
    "atomic": "Write one question that the facts below answer, and its answer, as <question>…</question><answer>…</answer>.",
    "multi_hop": "Write one question that needs several of the facts below together, and its answer, as <question>…</question><answer>…</answer>.",
    "aggregated": "Write one coherent paragraph that tells all facts below, as <rephrased_text>…</rephrased_text>.",
    "aggregated_question": "Write the question that the following text answers in full, as <question>…</question>.",
    "cot": "Write a question on the facts below and the steps that solve it, as <question>…</question><reasoning_path>…</reasoning_path>.",
    "cot_answer": "Answer the question along the given steps, as <answer>…</answer>.",
    "multi_choice": "Write questions with four options A to D and one right letter, each as <qa_pair><question>…</question><options>A. …</options><answer>A</answer></qa_pair>.",
    "multi_answer": "Write questions with lettered options and all right letters, each as <qa_pair><question>…</question><options>A. …</options><answer>A, B</answer></qa_pair>.",
    "fill_in_blank": "Write sentences with a blank and what fills it, each as <qa_pair><question>…</question><answer>…</answer></qa_pair>.",
    "true_false": "Write statements that are true or false, each as <qa_pair><question>…</question><answer>True</answer></qa_pair>.",
    "vqa": "Write questions on the image and the facts below, each as <qa_pair><question>…</question><answer>…</answer></qa_pair>.",
}
VQA_OF = {"vqa": "vqa", "atomic_vqa": "atomic", "aggregated_vqa": "aggregated", "multi_hop_vqa": "multi_hop"}


def _pairs(rows: DataFrame, reply: str) -> DataFrame:
    return rows.select("*", F.posexplode(tx.tags(F.col(reply), "qa_pair")).alias("qa_ord", "pair"))


def options(block: Column, letters: str = "A-Z") -> Column:
    """map<letter,text> of lines such as ``A. text`` or ``A text``; other lines don't count, the last of equal letters does."""
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: tx.strip(x)), lambda x: x.rlike(rf"^[{letters}][.\s]"))
    entry = lambda x: F.struct(F.substring(x, 1, 1).alias("key"), tx.strip(F.regexp_replace(x, r"^.[.\s]\s*", "")).alias("value"))
    last = F.filter(F.transform(lines, entry), lambda x, i: ~F.exists(F.slice(F.transform(lines, lambda y: F.substring(y, 1, 1)), i + 2, F.size(lines)), lambda k: k == x["key"]))
    return F.map_from_entries(last)


def parse_single(rows: DataFrame, reply: str = "reply") -> DataFrame:
    return rows.withColumn("question", tx.tag(F.col(reply), "question")).withColumn("answer", tx.tag(F.col(reply), "answer")).filter("question != '' AND answer != ''")


def parse_multi_choice(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Exactly the options A to D, and an answer that is one of these letters and nothing else."""
    p = _pairs(rows, reply).withColumn("question", tx.tag(F.col("pair"), "question")).withColumn("options", options(tx.tag(F.col("pair"), "options"), "A-D"))
    p = p.withColumn("answer", tx.tag(F.col("pair"), "answer"))
    return p.filter(F.col("question").isNotNull() & (F.size("options") == 4) & F.array_contains(F.map_keys("options"), F.col("answer"))).drop("pair")


def parse_multi_answer(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Every listed letter, in either case, must be an option; records carry ``answers`` and an empty ``answer``."""
    p = _pairs(rows, reply).withColumn("question", tx.tag(F.col("pair"), "question")).withColumn("options", options(tx.tag(F.col("pair"), "options")))
    letters = F.filter(F.transform(F.split(F.upper(tx.tag(F.col("pair"), "answer")), ","), lambda x: tx.strip(x)), lambda x: x != "")
    p = p.withColumn("answers", letters).withColumn("answer", F.lit(""))
    return p.filter(F.col("question").isNotNull() & (F.size("answers") > 0) & F.forall("answers", lambda x: F.array_contains(F.map_keys("options"), x))).drop("pair")


def parse_fill_in_blank(rows: DataFrame, reply: str = "reply") -> DataFrame:
    p = _pairs(rows, reply).withColumn("question", tx.tag(F.col("pair"), "question")).withColumn("answer", tx.tag(F.col("pair"), "answer"))
    p = p.withColumn("answers", F.filter(F.transform(F.split("answer", "[,，;；]"), lambda x: tx.strip(x)), lambda x: x != ""))
    return p.filter("question != '' AND size(answers) > 0").drop("pair")


def parse_true_false(rows: DataFrame, reply: str = "reply") -> DataFrame:
    p = _pairs(rows, reply).withColumn("question", tx.tag(F.col("pair"), "question")).withColumn("answer", tx.tag(F.col("pair"), "answer"))
    return p.filter((F.col("question") != "") & F.lower("answer").isin("true", "false")).withColumn("answer", F.initcap("answer")).drop("pair")


def parse_vqa(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Pairs that pass the quality rules: no placeholders, no unknowns, a word in common with the context, no repeats."""
    p = _pairs(rows, reply).withColumn("question", tx.tag(F.col("pair"), "question")).withColumn("answer", tx.tag(F.col("pair"), "answer"))
    both = F.lower(F.concat_ws(" ", "question", "answer"))
    shared = F.size(F.array_intersect(F.filter(tx.words(both), lambda w: F.length(w) > 3), tx.words(F.col("context")))) > 0
    p = p.filter((F.col("question") != "") & (F.col("answer") != "") & ~both.rlike(r"\b(todo|placeholder|n/a|unknown)\b") & shared)
    signature = F.regexp_replace(F.lower(F.concat_ws("|", "question", "answer")), r"[^\p{L}\p{N}|]+", " ")
    rank = F.row_number().over(Window.partitionBy("community_id", signature).orderBy("qa_ord"))
    return p.withColumn("rank", rank).filter("rank = 1").drop("rank", "pair")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"multi_choice": parse_multi_choice, "multi_answer": parse_multi_answer, "fill_in_blank": parse_fill_in_blank, "true_false": parse_true_false, "vqa": parse_vqa}


def _prompt(name: str, *more: Column) -> Column:
    return F.concat(F.lit(PROMPTS[name] + "\nText:\n"), *more)


def generate(communities: DataFrame, model: Model, method: str) -> DataFrame:
    """(community_id, nodes, edges, …) to rows with question, answer and what the method adds."""
    rows = communities if "context" in communities.columns else communities.withColumn("context", context(F.col("nodes"), F.col("edges")))
    kind = VQA_OF.get(method, method)
    if method.endswith("vqa") and "img_path" not in rows.columns:
        rows = rows.withColumn("img_path", visual_asset(F.col("nodes")))
    if kind == "aggregated":
        rows = complete(rows.withColumn("prompt", _prompt("aggregated", F.col("context"))), model, "prompt", "reply")
        rows = rows.withColumn("answer", F.coalesce(tx.tag(F.col("reply"), "rephrased_text"), tx.tag(F.col("reply"), "answer")))
        rows = complete(rows.withColumn("prompt", _prompt("aggregated_question", F.col("answer"))), model, "prompt", "reply")
        out = rows.withColumn("question", tx.tag(F.col("reply"), "question")).filter("question != '' AND answer != ''")
    elif kind == "cot":
        rows = complete(rows.withColumn("prompt", _prompt("cot", F.col("context"))), model, "prompt", "reply")
        rows = rows.withColumn("question", tx.tag(F.col("reply"), "question")).withColumn("reasoning_path", F.coalesce(tx.tag(F.col("reply"), "reasoning_path"), F.lit("")))
        rows = complete(rows.withColumn("prompt", _prompt("cot_answer", F.col("question"), F.lit("\n"), F.col("reasoning_path"))), model, "prompt", "reply")
        out = rows.withColumn("answer", tx.tag(F.col("reply"), "answer")).filter("question != '' AND answer != ''")
    elif kind in PROMPTS:
        rows = complete(rows.withColumn("prompt", _prompt(kind, F.col("context"))), model, "prompt", "reply")
        out = PARSERS.get(kind, parse_single)(rows)
    else:
        raise ValueError(f"unknown method {method}")
    return out.drop("prompt", "reply").withColumn("method", F.lit(method))


def generate_auto(selected: DataFrame, model: Model, *, most: int = 3) -> DataFrame:
    """Routes each selected subgraph by its ``qa_family``; at most three distinct records per subgraph."""
    route = {"atomic": "atomic_vqa", "aggregated": "aggregated_vqa", "multi_hop": "multi_hop_vqa"}
    parts = [generate(selected.filter(F.col("qa_family") == family), model, method) for family, method in route.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    signature = F.regexp_replace(F.lower(F.concat_ws("|", "question", "answer")), r"[^\p{L}\p{N}|]+", " ")
    first = F.row_number().over(Window.partitionBy("community_id", signature).orderBy("method"))
    nth = F.row_number().over(Window.partitionBy("community_id").orderBy("method", "question"))
    return out.withColumn("__first", first).filter("__first = 1").withColumn("__nth", nth).filter(F.col("__nth") <= most).drop("__first", "__nth")


def quiz_prompts(items: DataFrame, *, samples: int = 1) -> DataFrame:
    """(item, kind, n, prompt): per description ``samples`` negations and ``samples - 1`` rewordings."""
    kinds = F.flatten(F.array(F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: F.struct(F.lit("anti").alias("kind"), i.alias("n"))), F.slice(F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: F.struct(F.lit("same").alias("kind"), i.alias("n"))), 1, samples - 1)))
    rows = items.withColumn("k", F.explode(kinds)).select("*", "k.kind", "k.n").drop("k")
    ask = F.when(F.col("kind") == "anti", "Negate the statement below in one sentence.").otherwise("Say the statement below in other words.")
    return rows.withColumn("prompt", F.concat(ask, F.lit("\nText:\n"), "description"))


def judge_prompts(quizzes: DataFrame) -> DataFrame:
    return quizzes.withColumn("prompt", F.concat(F.lit("Is the following statement true? Answer yes or no.\nText:\n"), "statement"))


STYLES = ("critical analysis", "popular science", "technical report", "dialogue", "story", "summary for executives", "cross-domain analogy", "interview")


def rephrase(chunks: DataFrame, model: Model, style: str) -> DataFrame:
    if style not in STYLES:
        raise ValueError(f"unknown style {style}; known: {', '.join(STYLES)}")
    rows = chunks.withColumn("prompt", F.concat(F.lit(f"Rewrite the text as: {style}. Keep every fact. Reply as <rephrased_text>…</rephrased_text>.\nText:\n"), "content"))
    out = complete(rows, model, "prompt", "reply")
    return out.withColumn("content", F.coalesce(tx.tag(F.col("reply"), "rephrased_text"), "reply")).drop("prompt", "reply")


def extract(chunks: DataFrame, model: Model, schema: dict) -> DataFrame:
    """Schema-guided extraction: map<string,string> per row; rows lacking a required key are dropped."""
    import json

    rows = chunks.withColumn("prompt", F.concat(F.lit("Fill this JSON schema from the text, reply with the object alone:\n" + json.dumps(schema, ensure_ascii=False) + "\nText:\n"), "content"))
    out = complete(rows, model, "prompt", "reply").withColumn("extracted", F.from_json(F.to_json(tx.json_payload(F.col("reply"))), "map<string,string>"))
    for key in schema.get("required", []):
        out = out.filter(F.trim(F.coalesce(F.try_element_at("extracted", F.lit(key)), F.lit(""))) != "")
    return out.filter("extracted IS NOT NULL").drop("prompt", "reply")


def resolve_coreference(chunks: DataFrame, model: Model) -> DataFrame:
    """Later chunks of a document rewritten against its first chunk; the first stays."""
    first = F.first("content").over(Window.partitionBy("doc_id").orderBy("ord"))
    rows = chunks.withColumn("first_content", first)
    prompt = F.when(F.col("content") != F.col("first_content"), F.concat(F.lit("Replace pronouns in the text by what they refer to.\nReference:\n"), "first_content", F.lit("\nText:\n"), "content"))
    out = complete(rows.withColumn("prompt", prompt), model, "prompt", "reply")
    return out.withColumn("content", F.coalesce("reply", "content")).drop("prompt", "reply", "first_content")


def source_chunks(units: DataFrame, edges: DataFrame, chunks: DataFrame, *, top: int = 3) -> DataFrame:
    """(id, chunk_id, content, rank): the best source chunks of each entity.

    Candidates are the entity's own sources, then those of incident edges, each
    once; visual trace ids come first, then visual paths, then the rest.
    """
    own = units.select("id", F.posexplode(tx.source_ids(F.col("source_id"))).alias("ord", "chunk_id"), F.lit(0).alias("origin"), "visual_trace", "visual_path")
    ends = edges.select(F.col("src").alias("id"), "source_id").unionByName(edges.select(F.col("dst").alias("id"), "source_id"))
    via = ends.select("id", F.posexplode(tx.source_ids(F.col("source_id"))).alias("ord", "chunk_id")).join(units.select("id", "visual_trace", "visual_path"), "id").withColumn("origin", F.lit(1))
    seen = Window.partitionBy("id", "chunk_id").orderBy("origin", "ord")
    both = own.unionByName(via).withColumn("seen", F.row_number().over(seen)).filter("seen = 1")
    joined = both.join(chunks.select("chunk_id", "content", "path"), "chunk_id")
    kind = F.when(F.col("chunk_id") == F.col("visual_trace"), 0).when((F.coalesce("visual_path", F.lit("")) != "") & (F.col("path") == F.col("visual_path")), 1).otherwise(2)
    order = Window.partitionBy("id").orderBy(kind, "origin", "ord", "chunk_id")
    return joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("id", "chunk_id", "content", "rank")


def visual_asset(nodes: Column) -> Column:
    """The first path among the nodes' image metadata."""
    paths = F.transform(nodes, lambda n: F.coalesce(*[F.nullif(tx.metadata_map(n["metadata"])[k], F.lit("")) for k in ("img_path", "image_path", "table_img_path", "equation_img_path")]))
    return F.get(F.filter(paths, lambda p: p.isNotNull()), F.lit(0))


def question_with_options(question: Column, opts: Column | None) -> Column:
    """Options are appended under the question, by letter."""
    if opts is None:
        return question
    lines = F.transform(F.array_sort(F.map_entries(opts)), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))
    return F.when(opts.isNotNull(), F.concat(question, F.lit("\nOptions:\n"), F.array_join(lines, "\n"))).otherwise(question)


def to_format(rows: DataFrame, kind: str, *, image: bool = False) -> DataFrame:
    """Rows with ``record``: the training record as a struct."""
    ask = question_with_options(F.col("question"), F.col("options") if "options" in rows.columns else None)
    said = F.coalesce("answer", F.lit(""))
    if kind == "Alpaca":
        record = F.struct(ask.alias("instruction"), F.lit("").alias("input"), said.alias("output"))
        return rows.withColumn("record", F.struct(record["instruction"].alias("instruction"), record["input"].alias("input"), record["output"].alias("output"), *([F.col("img_path").alias("image")] if image else [])))
    if kind == "Sharegpt":
        ask = F.concat(F.lit("<image>\n"), ask) if image else ask
        turns = F.array(F.struct(F.lit("human").alias("from"), ask.alias("value")), F.struct(F.lit("gpt").alias("from"), said.alias("value")))
        return rows.withColumn("record", F.struct(turns.alias("conversations"), *([F.array("img_path").alias("images")] if image else [])))
    if kind == "ChatML":
        if image:
            user = F.to_json(F.array(F.struct(F.lit("text").alias("type"), ask.alias("text"), F.lit(None).cast("string").alias("image")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.col("img_path").alias("image"))))
        else:
            user = ask
        return rows.withColumn("record", F.struct(F.array(F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), said.alias("content"))).alias("messages")))
    raise ValueError(f"unknown format {kind}; known: Alpaca, Sharegpt, ChatML")


def subgraph_summary(nodes: Column, edges: Column) -> Column:
    """Counts and the first ten labels of a subgraph."""
    return F.struct(F.size(nodes).alias("n_nodes"), F.size(edges).alias("n_edges"), F.slice(F.transform(nodes, lambda n: n["id"]), 1, 10).alias("node_labels"), F.slice(F.transform(edges, lambda e: F.concat(e["src"], F.lit(" - "), e["dst"])), 1, 10).alias("edge_labels"))
