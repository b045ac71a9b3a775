"""Rewards, losses, schedules, hashes and token-array algebra as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def mean_or_zero(x) -> Column:
    return F.coalesce(F.avg(_c(x)), F.lit(0.0))


def ratio_or_zero(num, den) -> Column:
    return F.when(_c(den) != 0, _c(num) / _c(den)).otherwise(0.0)


def percentile_or_zero(x, share: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.coalesce(F.percentile(_c(x), F.lit(share)), F.lit(0.0))


def process_score(intent, retrieval) -> Column:
    return ((_c(intent) == 1) & (_c(retrieval) == 1)).cast("int")


def array_mean(x) -> Column:
    """Mean of an array, 0.0 if empty."""
    a = _c(x)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)).otherwise(0.0)


def mini_reward(outcome, scores, weight) -> Column:
    """outcome + weight * share of good queries; raises on a weight outside [0, 1) or a score that is not 0 or 1."""
    w, s = _c(weight).cast("double"), _c(scores)
    bad = ~F.forall(s, lambda v: F.coalesce(v.isin(0, 1), F.lit(False)))
    reward = _c(outcome).cast("int") + w * array_mean(s)
    return F.when(~F.coalesce((w >= 0) & (w < 1), F.lit(False)), F.raise_error(F.lit("process weight must be in [0, 1)")).cast("double")).when(bad, F.raise_error(F.lit("process scores must be 0 or 1")).cast("double")).otherwise(reward)


def ablation_reward(correct, good, bad, valid_format) -> Column:
    base = F.when(_c(correct), F.greatest(1 - 0.1 * _c(bad), F.lit(0.7))).otherwise(F.least(0.1 * _c(good), F.lit(0.3)))
    return base + 0.1 * _c(valid_format).cast("int")


def preference_logit(policy_chosen, policy_rejected, ref_chosen, ref_rejected, beta) -> Column:
    return _c(beta) * ((_c(policy_chosen) - _c(policy_rejected)) - (_c(ref_chosen) - _c(ref_rejected)))


def softplus_loss(logit: Column) -> Column:
    """-log sigmoid(logit), without overflow."""
    return F.greatest(-logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))


def sequence_logp(logps, labels, ignore: int = -100) -> Column:
    """Sum of token log-probabilities where the label counts."""
    return F.aggregate(F.zip_with(_c(logps), _c(labels), lambda p, l: F.when(l != ignore, p).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)


def kl_k3(ref, policy) -> Column:
    d = _c(ref) - _c(policy)
    return F.exp(d) - d - 1


def policy_ratio(new, old) -> Column:
    """Probability under the new policy over that under the old one, from log-probabilities."""
    return F.exp(_c(new) - _c(old))


def lr_scale(step, warmup: int, total: int, kind: str = "cosine") -> Column:
    """Learning-rate factor: linear warm-up, then constant or cosine decay."""
    s = _c(step)
    rest = F.lit(1.0) if kind == "constant" else 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), (s - warmup) / max(1, total - warmup))))
    return F.when(s < warmup, s / max(1, warmup)).otherwise(rest)


def steps_in(rows: Column, batch: int) -> Column:
    return F.ceil(rows / batch)


def inner_product(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def first_difference(a, b) -> Column:
    """Position (from 0) of the first difference of two arrays; null if they are equal."""
    x, y = _c(a), _c(b)
    n = F.least(F.size(x), F.size(y))
    head = F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: ~p.eqNullSafe(q))
    at = F.array_position(head, True) - 1
    return F.when(at >= 0, at).when(F.size(x) != F.size(y), n.cast("bigint"))


def pad(ids, length: Column, value: int = 0) -> Column:
    a = _c(ids)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(length - F.size(a), F.lit(0)).cast("int")))


def overlap_mask(offsets, spans) -> Column:
    """For each (start, end) offset whether it overlaps a span: start < span end and end > span start."""
    return F.transform(_c(offsets), lambda o: F.exists(_c(spans), lambda s: (o["start"] < s["end"]) & (o["end"] > s["start"])))


def containing_kind(offsets, spans, default: str = "RUNTIME_INJECTED") -> Column:
    """For each offset the kind of the last span that contains it."""
    inside = lambda o: F.filter(_c(spans), lambda s: (o["start"] >= s["start"]) & (o["end"] <= s["end"]) & (o["end"] > o["start"]))
    return F.transform(_c(offsets), lambda o: F.coalesce(F.try_element_at(F.transform(inside(o), lambda s: s["kind"]), F.lit(-1)), F.lit(default)))


def replay_segment(state_ids, action_ids) -> Column:
    """Ids and masks of a sampled segment; raises without sampled tokens."""
    s, a = _c(state_ids), _c(action_ids)
    both = F.concat(s, a)
    zeros, ones = F.array_repeat(F.lit(0), F.size(s)), F.array_repeat(F.lit(1), F.size(a))
    made = F.struct(both.alias("input_ids"), F.array_repeat(F.lit(1), F.size(both)).alias("attention_mask"), F.concat(zeros, ones).alias("loss_mask"))
    return F.when(F.size(a) == 0, F.raise_error(F.lit("zero sampled action tokens")).cast("struct<input_ids:array<int>,attention_mask:array<int>,loss_mask:array<int>>")).otherwise(made)


def ids_digest(ids) -> Column:
    """SHA-256 of the JSON text of an id array."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(_c(ids), lambda i: i.cast("string")), ", "), F.lit("]")), 256)


def canonical_action(queries) -> Column:
    """Canonical JSON of a search action; keys stand in alphabetical order."""
    return F.to_json(F.struct(F.struct(_c(queries).alias("query")).alias("arguments"), F.lit("search").alias("name")))


def listed(x) -> Column:
    """A JSON text that is a string or a list of strings, as array<string>; null gives an empty array."""
    t = _c(x)
    many = F.from_json(t, "array<string>")
    return F.when(t.isNull(), F.array().cast("array<string>")).when(F.ltrim(t).startswith("["), many).otherwise(F.array(t))


def day_text(ts) -> Column:
    """Date of a time as prompts show it."""
    return F.date_format(F.to_date(_c(ts)), "yyyy-MM-dd")


def latency_seconds(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / 1e6
