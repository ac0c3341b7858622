"""Confidence and loss measures over token distributions, as higher-order functions.

A token is struct<text:string, prob:double[, top:array<struct<text,prob>>]>.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that count as yes and as no.
YES = "yes yeah yea yep yup yay ya yah sure certainly absolutely definitely exactly indeed right correct true t 1 是 对 好的 行 可以 没错 当然 确实 正确 真 对的".split()
NO = "no nope nop nah naw na negative never not false f 0 不 不是 没有 错 不对 不行 不能 否 假的".split()
DEFAULT_LOSS = -math.log(0.1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _probs(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, lambda t: t["prob"]), lambda p: p > 0)


def average_prob(tokens: Column) -> Column:
    p = _probs(tokens)
    return F.when(F.size(p) > 0, _sum(p) / F.size(p))


def min_prob(tokens: Column) -> Column:
    return F.array_min(_probs(tokens))


def joint_probability(tokens: Column) -> Column:
    """exp of the mean log-probability."""
    p = _probs(tokens)
    return F.when(F.size(p) > 0, F.exp(_sum(F.transform(p, lambda x: F.log(x))) / F.size(p)))


def average_confidence(tokens: Column) -> Column:
    """Mean share of a token's probability in its five likeliest candidates."""
    share = F.transform(tokens, lambda t: t["prob"] / _sum(F.transform(F.slice(t["top"], 1, 5), lambda c: c["prob"])))
    return F.when(F.size(tokens) > 0, _sum(share) / F.size(tokens))


def yes_no_loss(tokens: Column, truths: Column) -> Column:
    """Mean of 1 - p where the token is the truth, else p; one token per judged statement."""
    each = F.zip_with(tokens, truths, lambda t, y: F.when(t["text"] == y, 1 - t["prob"]).otherwise(t["prob"]))
    return F.when(F.size(tokens) > 0, _sum(each) / F.size(tokens))


def yes_no_mass(candidates: Column) -> Column:
    """struct<yes,no,uncertain> of a candidate distribution, summing to one."""
    word = lambda c: F.trim(F.lower(c["text"]))
    mass = lambda keep: _sum(F.transform(F.filter(candidates, keep), lambda c: c["prob"]))
    yes, no = mass(lambda c: word(c).isin(YES)), mass(lambda c: word(c).isin(NO))
    rest = mass(lambda c: ~word(c).isin(YES + NO))
    total = yes + no + rest
    return F.struct((yes / total).alias("yes"), (no / total).alias("no"), (rest / total).alias("uncertain"))


def entropy_loss(distributions: Column, truths: Column) -> Column:
    """Mean of -ln p(truth) over judged statements; a zero probability gives the default loss."""
    each = F.zip_with(distributions, truths, lambda d, y: F.when(y == "yes", yes_no_mass(d)["yes"]).otherwise(yes_no_mass(d)["no"]))
    logs = F.transform(each, lambda p: F.when(p > 0, -F.log(p)))
    bad = F.exists(logs, lambda x: x.isNull()) | (F.size(logs) == 0)
    return F.when(bad, F.lit(DEFAULT_LOSS)).otherwise(_sum(F.coalesce(F.filter(logs, lambda x: x.isNotNull()), F.array())) / F.size(logs))
