"""Record and graph evaluation, metric filters, and loss on graph units."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftgraph.functions import confidence as cf
from weftgraph.functions import text as tx
from weftgraph.models.base import Model, complete, yes_no

#: Words that lexical diversity ignores.
STOPWORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()


def qa_length(question: Column, answer: Column) -> Column:
    return tx.token_count(F.concat(F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")))).cast("double")


def segment_diversity(tokens: list[str], threshold: float) -> float:
    """Tokens per factor: a factor ends where the share of distinct words falls to the threshold."""
    factors, seen, n = 0.0, set(), 0
    for token in tokens:
        n += 1
        seen.add(token)
        if len(seen) <= threshold * n:
            factors += 1
            seen, n = set(), 0
    if n:
        factors += (1 - len(seen) / n) / (1 - threshold)
    return len(tokens) / factors if factors else float(len(tokens))


def mtld(answer: Column, threshold: float = 0.72) -> Column:
    """Lexical diversity of an answer: mean of both reading directions; 0 for no words.

    The fold keeps a set per segment, which higher-order functions would copy at
    every word.
    """
    skip = frozenset(STOPWORDS)

    @pandas_udf("double")
    def run(lists: pd.Series) -> pd.Series:
        def one(words) -> float:
            kept = [w for w in words if w not in skip]
            return (segment_diversity(kept, threshold) + segment_diversity(kept[::-1], threshold)) / 2 if kept else 0.0

        return lists.map(one).astype("float64")

    return run(tx.words(answer))


UNI_DIMENSIONS = ("naturalness", "coherence", "understandability")


def uni_scores(rows: DataFrame, model: Model) -> DataFrame:
    """p(yes) / (p(yes) + p(no)) of three questions per record."""
    for name in UNI_DIMENSIONS:
        rows = yes_no(rows.withColumn("__p", F.concat(F.lit(f"Does this answer have {name}? Answer yes or no.\nText:\n"), "question", F.lit("\n"), "answer")), model, "__p", "__d")
        mass = cf.yes_no_mass(F.col("__d"))
        rows = rows.withColumn(name, mass["yes"] / (mass["yes"] + mass["no"])).drop("__p", "__d")
    return rows


def reward_scores(rows: DataFrame, score) -> DataFrame:
    """``reward_score`` from a scorer (question series, answer series) -> score series, loaded once per task."""
    return rows.withColumn("reward_score", pandas_udf(score, "double")("question", "answer"))


def with_metrics(rows: DataFrame, **metrics: Column) -> DataFrame:
    """``metrics`` map<string,double>; later values replace earlier ones of the same name."""
    new = F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))])
    if "metrics" not in rows.columns:
        return rows.withColumn("metrics", new)
    old = F.map_filter("metrics", lambda k, v: ~k.isin(list(metrics)))
    return rows.withColumn("metrics", F.map_concat(old, new))


def range_filter(rows: DataFrame, metric: str, low: float | None = None, high: float | None = None, *, with_low: bool = True, with_high: bool = True) -> DataFrame:
    """Rows whose metric lies in the range; a missing metric drops the row."""
    value = F.try_element_at("metrics", F.lit(metric))
    keep = value.isNotNull()
    if low is not None:
        keep &= value >= low if with_low else value > low
    if high is not None:
        keep &= value <= high if with_high else value < high
    return rows.filter(keep)


def normalize_qa(rows: DataFrame) -> DataFrame:
    """question, answer and option text from ChatML (messages), Sharegpt (conversations) or Alpaca columns, in that order."""
    have = set(rows.columns)
    first = lambda c, key, who, body: F.get(F.filter(F.col(c), lambda m: m[key] == who), F.lit(0))[body]
    asks, says = [], []
    if "messages" in have:
        asks.append(first("messages", "role", "user", "content"))
        says.append(first("messages", "role", "assistant", "content"))
    if "conversations" in have:
        asks.append(first("conversations", "from", "human", "value"))
        says.append(first("conversations", "from", "gpt", "value"))
    if "instruction" in have:
        asks.append(F.col("instruction"))
        says.append(F.col("output"))
    if not asks:
        raise ValueError("no known record format among the columns")
    ask = F.coalesce(*asks)
    parts = F.split(ask, "\nOptions:\n", 2)
    return rows.withColumn("question", parts[0]).withColumn("options_text", F.get(parts, F.lit(1))).withColumn("answer", F.coalesce(*says, F.lit("")))


def unit_losses(judged: DataFrame) -> DataFrame:
    """(unit, loss): mean -ln p(truth) over a unit's judged statements (unit, candidates, truth)."""
    grouped = judged.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("n", "candidates", "truth"))).alias("s"))
    return grouped.select("unit", cf.entropy_loss(F.transform("s", lambda x: x["candidates"]), F.transform("s", lambda x: x["truth"])).alias("loss"))


def set_losses(nodes: DataFrame, losses: DataFrame, key: str = "id") -> DataFrame:
    """Losses onto nodes or edges; units that weren't judged get the default loss."""
    plain = nodes.drop("loss") if "loss" in nodes.columns else nodes
    return plain.join(losses.withColumnRenamed("unit", key), key, "left").withColumn("loss", F.coalesce("loss", F.lit(cf.DEFAULT_LOSS)))


def triple_prompts(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, lineage: DataFrame) -> DataFrame:
    """Per chunk what was extracted from it: lineage (chunk_id, unit) joined to units and chunks."""
    n = lineage.join(nodes.select(F.col("id").alias("unit"), "entity_type", "description"), "unit").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("unit", "entity_type", "description"))).alias("entities"))
    key = F.concat_ws("|", "src", "dst")
    e = lineage.join(edges.select(key.alias("unit"), "relation_type", F.col("description")), "unit").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("unit", "relation_type", "description"))).alias("relations"))
    out = chunks.select("chunk_id", "content").join(n, "chunk_id", "left").join(e, "chunk_id", "left").filter("entities IS NOT NULL OR relations IS NOT NULL")
    return out.withColumn("prompt", F.concat(F.lit("Score how well these were extracted from the text, 0 to 1, as JSON with accuracy, completeness, precision.\nText:\n"), "content", F.lit("\n"), F.coalesce(F.to_json("entities"), F.lit("[]")), F.coalesce(F.to_json("relations"), F.lit("[]"))))


def triple_accuracy(prompts: DataFrame, model: Model) -> DataFrame:
    """Scores parsed from the judge's JSON; zero where it is missing or malformed."""
    out = complete(prompts, model, "prompt", "reply").withColumn("j", F.from_json(F.to_json(tx.json_payload(F.col("reply"))), "map<string,string>"))
    return out.select("chunk_id", *[tx.clip_score(F.try_element_at("j", F.lit(k))).alias(k) for k in ("accuracy", "completeness", "precision")])
