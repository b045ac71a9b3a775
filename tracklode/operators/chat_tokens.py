"""Tokens of chat messages: what is supervised, where each token comes from, and what a cutoff leaves.

Spans come from the messages themselves, not from a search in the rendered
text, so content that looks like a marker changes nothing.  Only the tokenizer
runs in Python, on Arrow batches; masks, labels, origins and counts are array
expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import containing_kind, overlap_mask
from ..functions.text import _c

#: Markers of the chat format, tags of an observation, kinds of origin and the label of masked tokens; fixed values.
OPEN, CLOSE, IGNORED = "<|im_start|>", "<|im_end|>", -100
RESPONSE = ("<tool_response>", "</tool_response>")
PROMPT, POLICY, ENVIRONMENT, INJECTED = "PROMPT", "POLICY_GENERATED", "ENVIRONMENT_OBSERVATION", "RUNTIME_INJECTED"
SPANS = "array<struct<start:int,end:int,role:string,index:int>>"
TOKENS = "struct<ids:array<int>,offsets:array<struct<start:int,end:int>>>"


def chat_text(messages) -> Column:
    """``messages`` (role, content) in the chat format."""
    return F.array_join(F.transform(_c(messages), lambda m: F.concat(F.lit(OPEN), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(f"{CLOSE}\n"))), "")


def message_spans(messages) -> Column:
    """Where the content of each message lies in ``chat_text``, in characters, end exclusive."""
    start = lambda at, m: at + len(OPEN) + F.length(m["role"]) + 1
    size = lambda m: F.length(F.coalesce(m["content"], F.lit("")))
    span = lambda s, m: F.struct(start(s["at"], m).alias("start"), (start(s["at"], m) + size(m)).alias("end"), m["role"].alias("role"), F.size(s["found"]).alias("index"))
    step = lambda s, m: F.struct((start(s["at"], m) + size(m) + len(CLOSE) + 1).alias("at"), F.concat(s["found"], F.array(span(s, m))).alias("found"))
    return F.aggregate(_c(messages), F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found")), step, lambda s: s["found"])


def tokenized(df: DataFrame, text, make: Callable[[], Callable[[str], tuple[list[int], list[tuple[int, int]]]]], out: str = "tokens") -> DataFrame:
    """``df`` with ids and character offsets of a text; ``make`` is called once a task and returns the tokenizer."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = make()
        for s in batches:
            made = [encode(t or "") for t in s]
            yield pd.DataFrame({"ids": [list(ids) for ids, _ in made], "offsets": [[{"start": a, "end": b} for a, b in offsets] for _, offsets in made]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}  # as types, not as their names
    return df.withColumn(out, F.pandas_udf(run, TOKENS)(_c(text)))


def split_tokens(text) -> Column:
    """Tokens without a vocabulary: runs without blanks, and single blanks; the id is the length of the token."""
    parts = F.regexp_extract_all(_c(text), F.lit(r"[^ \n]+|[ \n]"), F.lit(0))
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda s, p: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + F.length(p))))
    offsets = F.zip_with(parts, ends, lambda p, e: F.struct((e - F.length(p)).alias("start"), e.alias("end")))
    return F.struct(F.transform(parts, F.length).alias("ids"), offsets.alias("offsets"))


def supervised(tokens, spans, mode: str = "assistant") -> Column:
    """For each token whether it is learned from.

    ``assistant``: it overlaps an assistant's content.  ``trajectory``: it ends
    after the start of the first assistant's content, observations included.
    """
    t, s = _c(tokens), _c(spans)
    own = F.filter(s, lambda x: x["role"] == "assistant")
    if mode == "assistant":
        return overlap_mask(t["offsets"], own)
    if mode != "trajectory":
        raise ValueError(f"no supervision mode {mode}")
    first = F.get(own, 0)["start"]
    return F.transform(t["offsets"], lambda o: F.coalesce(o["end"] > first, F.lit(False)))


def labelled(tokens, mask, cutoff: int, on_long: str = "cut", strict: bool = True) -> Column:
    """``input_ids, labels, original_length, effective_length, truncated, supervised_tokens, masked_tokens`` after the cutoff.

    ``on_long`` is ``cut``, or ``raise`` where nothing may be cut.  With ``strict`` a
    sample without a supervised token raises.
    """
    t, n = _c(tokens), F.size(_c(tokens)["ids"])
    ids = F.slice(t["ids"], 1, cutoff)
    labels = F.slice(F.zip_with(t["ids"], _c(mask), lambda i, m: F.when(m, i).otherwise(IGNORED)), 1, cutoff)
    learned = F.size(F.filter(labels, lambda x: x != IGNORED))
    made = F.struct(ids.alias("input_ids"), labels.alias("labels"), n.alias("original_length"), F.size(ids).alias("effective_length"), (n > cutoff).alias("truncated"), learned.alias("supervised_tokens"), (F.size(ids) - learned).alias("masked_tokens"))
    kind = "struct<input_ids:array<int>,labels:array<int>,original_length:int,effective_length:int,truncated:boolean,supervised_tokens:int,masked_tokens:int>"
    wrong = lambda what: F.raise_error(F.lit(what)).cast(kind)
    if strict:
        made = F.when(learned == 0, wrong("a sample has no supervised token")).otherwise(made)
    return F.when(n > cutoff, wrong(f"a sample is longer than {cutoff} tokens")).otherwise(made) if on_long == "raise" else made


def origin_spans(messages, prompts: int = 2) -> Column:
    """Kinds of text by place: the first messages are the prompt, assistants are the policy, a ``<tool_response>`` is the environment's, the rest is injected.

    An observation's span follows its message's, so that the last span wins.
    """
    m = F.zip_with(_c(messages), message_spans(messages), lambda x, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["role"].alias("role"), s["index"].alias("index"), F.coalesce(x["content"], F.lit("")).alias("content")))
    kind = lambda x: F.when(x["role"] == "assistant", POLICY).when(x["index"] < prompts, PROMPT).otherwise(INJECTED)
    whole = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind(x).alias("kind"))
    begin = lambda x: F.locate(RESPONSE[0], x["content"])
    finish = lambda x: F.locate(RESPONSE[1], F.substr(x["content"], begin(x)))
    until = lambda x: F.when(finish(x) > 0, begin(x) + finish(x) - 2 + len(RESPONSE[1])).otherwise(F.raise_error(F.lit("unclosed observation")).cast("int"))
    seen = lambda x: F.when(x["role"].isin("user", "tool") & (begin(x) > 0), F.struct((x["start"] + begin(x) - 1).alias("start"), (x["start"] + until(x)).alias("end"), F.lit(ENVIRONMENT).alias("kind")))
    return F.flatten(F.transform(m, lambda x: F.array_compact(F.array(whole(x), seen(x)))))


def token_origins(tokens, messages, prompts: int = 2) -> Column:
    """The kind of each token: that of the last span that contains it."""
    return containing_kind(_c(tokens)["offsets"], origin_spans(messages, prompts), INJECTED)
