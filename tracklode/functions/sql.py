"""The engine's functions for ``spark.sql``: registered once a session, plain SQL inside, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import ARTICLES, HEADER, SPACE


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_PUNCTUATION = rf"[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]"

def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {_text('^' + SPACE + '+')}, ''), {_text(SPACE + '+$')}, '')"


def _tokens(x: str) -> str:
    bare = f"regexp_replace(lower(coalesce({x}, '')), {_text(_PUNCTUATION)}, '')"
    return f"filter(split(trim(regexp_replace({bare}, {_text(SPACE + '+')}, ' ')), ' '), w -> w <> '' AND w NOT IN ({', '.join(map(_text, ARTICLES))}))"


def _overlap(a: str, b: str) -> str:
    return f"aggregate(array_distinct({a}), 0, (n, w) -> n + least(size(filter({a}, y -> y = w)), size(filter({b}, y -> y = w))))"


def _f1(p: str, g: str) -> str:
    """F1 of two token arrays; its overlap is computed once."""
    some = f"element_at(transform(array(CAST({_overlap(p, g)} AS DOUBLE)), n -> CASE WHEN n = 0 THEN 0D ELSE 2 * (n / size({p})) * (n / size({g})) / (n / size({p}) + n / size({g})) END), 1)"
    return f"CASE WHEN size({p}) = 0 AND size({g}) = 0 THEN 1D WHEN size({p}) = 0 OR size({g}) = 0 THEN 0D ELSE {some} END"


_SECTIONS = f"filter(split(coalesce(observation, ''), {_text('(?md)^(?=' + HEADER + '.*$)')}, -1), s -> startswith(s, {_text(HEADER)}))"
_EM = f"CAST(exists(golds, g -> array_join({_tokens('g')}, ' ') = array_join({_tokens('prediction')}, ' ')) AS DOUBLE)"
_BEST = f"coalesce(array_max(transform(golds, g -> element_at(transform(array(named_struct('p', {_tokens('prediction')}, 'g', {_tokens('g')})), x -> {_f1('x.p', 'x.g')}), 1))), 0D)"

#: Temporary functions by signature; a function is not called inside another one's lambda, so bodies are whole.
FUNCTIONS = {
    "qa_tokens(x STRING) RETURNS ARRAY<STRING>": _tokens("x"),
    "qa_normalize(x STRING) RETURNS STRING": f"array_join({_tokens('x')}, ' ')",
    "answer_em(prediction STRING, golds ARRAY<STRING>) RETURNS DOUBLE": _EM,
    "answer_f1(prediction STRING, golds ARRAY<STRING>) RETURNS DOUBLE": _BEST,
    "score_answer(prediction STRING, golds ARRAY<STRING>) RETURNS STRUCT<em: DOUBLE, f1: DOUBLE>": f"named_struct('em', {_EM}, 'f1', {_BEST})",
    "inner_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "result_sections(observation STRING) RETURNS ARRAY<STRING>": _SECTIONS,
    "parse_sections(observation STRING) RETURNS TABLE(query_idx INT, query STRING, result_section STRING)": f"""SELECT pos, {_strip(f"substring_index(substr(s, {len(HEADER) + 1}), chr(10), 1)")}, regexp_replace(s, {_text(SPACE + '+$')}, '')
      FROM (SELECT posexplode({_SECTIONS}) AS (pos, s))""",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary ones of the session; returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
