from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.models.base import HttpModel, RateLimit, ScriptedModel, StubModel, complete, from_environment
from weftgraph.operators import evaluate, generate, sample, tree


def plain_mtld(words, threshold=0.72):
    def one(tokens):
        factors, seen, n = 0.0, set(), 0
        for t in tokens:
            n += 1
            seen.add(t)
            if len(seen) / n <= threshold:
                factors, seen, n = factors + 1, set(), 0
        if n:
            factors += 1 - (len(seen) / n - threshold) / (1 - threshold)
        return len(tokens) / factors if factors else len(tokens)

    kept = [w for w in words if w not in evaluate.STOPWORDS]
    return (one(kept) + one(kept[::-1])) / 2 if kept else 0.0


@pytest.mark.parametrize("text", ["", "the of and", "cat cat cat cat dog", "one fish two fish red fish blue fish " * 3, "all different words appear once only"])
def test_mtld(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(evaluate.mtld(F.col("t")).alias("v")).first().v
    assert got == pytest.approx(plain_mtld(text.split()))


def test_vqa_quality_rules(spark):
    reply = "".join(f"<qa_pair><question>{q}</question><answer>{a}</answer></qa_pair>" for q, a in [("What is the valve?", "A valve part"), ("What is the valve?", "a valve  part"), ("valve TODO", "x"), ("valve?", "unknown"), ("Why?", "because")])
    rows = generate.parse_vqa(spark.createDataFrame([("c", reply, "The valve opens")], "community_id string, reply string, context string")).collect()
    assert [r.answer for r in rows] == ["A valve part"]


@pytest.mark.parametrize("method", ["atomic", "multi_hop", "aggregated", "cot", "multi_choice", "multi_answer", "fill_in_blank", "true_false", "vqa", "atomic_vqa", "aggregated_vqa", "multi_hop_vqa"])
def test_every_method_generates(spark, method):
    reply = "<question>Q alpha?</question><answer>A</answer><rephrased_text>alpha</rephrased_text><reasoning_path>r</reasoning_path>"
    pair = {"multi_choice": "<options>A. a\nB. b\nC. c\nD. d</options><answer>A</answer>", "multi_answer": "<options>A. a\nB. b</options><answer>A, B</answer>", "true_false": "<answer>False</answer>"}.get(method, "<answer>alpha one</answer>")
    model = ScriptedModel((), f"{reply}<qa_pair><question>alpha?</question>{pair}</qa_pair>")
    node = "struct<id:string,description:string,evidence_span:string,metadata:string>"
    frame = spark.createDataFrame([("c", [("ALPHA", "alpha one", "", '{"img_path":"p.png"}')], [("ALPHA", "BETA", "uses", "d", "")])], f"community_id string, nodes array<{node}>, edges array<struct<src:string,dst:string,relation_type:string,description:string,evidence_span:string>>")
    [row] = generate.generate(frame, model, method).collect()
    assert row.question and (method != "multi_answer" or row.answers == ["A", "B"])
    if method.endswith("vqa"):
        assert row.img_path == "p.png"
    for kind in ("Alpaca", "Sharegpt", "ChatML"):
        assert generate.to_format(generate.generate(frame, model, method), kind, image=method.endswith("vqa")).first().record


def test_unknown_names_are_errors(spark):
    frame = spark.createDataFrame([("q", "a")], "question string, answer string")
    with pytest.raises(ValueError):
        generate.to_format(frame, "CSV")
    with pytest.raises(ValueError):
        generate.rephrase(frame, StubModel(), "haiku")


def test_extract_requires_keys(spark):
    model = ScriptedModel((("first", '{"name": "x", "age": 3}'),), '```json\n{"name": ""}\n```')
    rows = generate.extract(spark.createDataFrame([("first",), ("two",)], "content string"), model, {"required": ["name"]}).collect()
    assert [(r.content, r.extracted["age"]) for r in rows] == [("first", "3")]


def test_failed_prompts_are_null(spark):
    class Broken(StubModel):
        def answer(self, prompt):
            raise OSError("down")

    assert complete(spark.createDataFrame([("p",), (None,)], "p string"), Broken(), "p", "r").select("r").distinct().collect() == [(None,)]


def test_http_model_retries():
    calls = []

    def send(request, timeout):
        calls.append(json.loads(request.data))
        if len(calls) < 3:
            raise OSError("busy")
        return json.dumps({"choices": [{"message": {"content": "hi"}}]}).encode()

    model = HttpModel("http://localhost/x", "m", "k", send=send, pause=lambda s: None)
    assert model.answer("q") == "hi" and len(calls) == 3
    assert isinstance(from_environment("TRAINEE", {}), StubModel)


def test_rate_limit_waits():
    now, slept = [0.0], []
    limit = RateLimit(2, clock=lambda: now[0], sleep=lambda s: slept.append(s))
    for _ in range(3):
        limit.wait()
    assert slept == [60.0]


def session(replies, family="aggregated"):
    near = {"s": [{"parent": "s", "id": "a", "score": 0.9, "text": ""}, {"parent": "s", "id": "b", "score": 0.5, "text": "secret"}], "a": [{"parent": "a", "id": "c", "score": 0.1, "text": ""}]}
    script = iter(replies)
    return sample.Session("s", family, near, lambda kind, state: next(script)).run()


BOOT = {"intent": "i", "forbidden_patterns": []}
GOOD = {"decision": "accept", "scores": {k: 0.3 if k == "hallucination_risk" else 0.9 for k in sample.GATE}}


def pick(x):
    return {"decision": "select_candidate", "node_id": x}


@pytest.mark.parametrize("replies, family, status, reason", [
    ([{}], "atomic", "abstained", "bootstrap_invalid"),
    ([BOOT, pick("a"), GOOD], "atomic", "accepted", "accepted"),
    ([BOOT, pick("a"), GOOD, pick("b"), GOOD], "aggregated", "accepted", "accepted"),
    ([BOOT, pick("a"), GOOD, pick("c"), GOOD], "multi_hop", "accepted", "accepted"),
    ([BOOT, pick("zz"), pick("zz")], "aggregated", "abstained", "invalid_selection_repeated"),
    ([BOOT, {"decision": "?"}, {}], "aggregated", "abstained", "selector_protocol_error"),
    ([BOOT, {"decision": "stop_selection"}], "aggregated", "abstained", "selector_stop_requested"),
    ([BOOT, pick("a"), {"decision": "reject", "termination_reason": "no"}], "aggregated", "rejected", "no"),
    ([BOOT, pick("a"), {"decision": "rollback_last_step"}, pick("b"), {"decision": "rollback_last_step"}], "aggregated", "abstained", "max_rollbacks_reached"),
    ([BOOT | {"forbidden_patterns": ["secret", "a"]}], "aggregated", "abstained", "candidate_pool_exhausted"),
    ([BOOT | {"forbidden_patterns": ["secret", "a"]}], "atomic", "accepted", "fallback"),
])
def test_sessions(replies, family, status, reason):
    out = session(replies, family)
    assert (out["status"], out["reason"]) == (status, reason)
    assert bool(out["nodes"]) == (status == "accepted")


def test_markdown_components():
    parts = tree.parse_markdown("# T\n\npara one\n\nTable 1: cap\n\n<table>\n<tr></tr>\n</table>\n![i](x.png)\nnote here\nFigure 2: shown\n# 2 Next\nend")
    assert [p["type"] for p in parts] == ["section", "text", "table", "image", "section", "text"]
    assert parts[2]["caption"] == ["Table 1: cap"] and parts[3]["img_path"] == "x.png"
    assert parts[3]["caption"] == ["Figure 2: shown"] and parts[3]["note"] == "note here"


def test_tree_paths(spark):
    doc = spark.createDataFrame([(1, "# A\n\nx\n\n## 1.1 B\n\ny\n\nz\n\n# A\n\nw")], "doc_id int, content string")
    rows = tree.construct_tree(tree.assign_levels(tree.analyze_structure(doc))).orderBy("ord").collect()
    assert [r.path for r in rows] == ["root/a", "root/a/text", "root/a/1_1_b", "root/a/1_1_b/text", "root/a/1_1_b/text_1", "root/a_1", "root/a_1/text"]
    assert [r.parent_id for r in rows] == ["root", "n1", "n1", "n3", "n3", "root", "n6"]
