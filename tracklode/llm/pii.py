"""Operator 1: personal data by bootstrapped contextual extraction.

1. One pass over the texts finds the base kinds (email, ip, card, phone) and
   all other identifier-like tokens, each with the words around it.
2. Base matches are seeds.  Every mention gives edges from its instance
   (normalised string) to lexical patterns (left word, left two words, left
   and right word, each with the token's shape).  Edges are counted once per
   distinct (pattern, instance) before anything else is done with them, so a
   pattern or an instance that holds a third of all mentions stays small.
3. Spark scores the graph round by round until the kinds stop changing.  What a
   pattern says for a kind is the pointwise mutual information of both over its
   scored instances, as a share of the most it could be: 1 where all are of the
   kind, 0 where the kind is as frequent as among all seeds.  Instances of other
   kinds count against it, unknown ones do not.  A pattern counts once it
   reaches ``MIN_SCORE``, ``MIN_SEEDS`` different seeds support it, that is more
   than the number of patterns would bring about by chance (``CHANCE``), and at
   least ``MIN_KNOWN`` of its instances have a score: a word that stands before
   all kinds of numbers tells nothing.  The score of an instance is the noisy-or
   of its patterns; a seed keeps 1.
4. Mentions whose instance reaches ``MIN_SCORE`` become spans of that kind,
   beside the base spans, which all stay.

Texts of any length are read whole, and so are tokens and context words; of
long ones a digest stands in the graph.  Null text counts as empty; empty texts have no spans.  Kinds that score alike
go to the one listed first.  Repeated rows get the same spans each.  An empty
table gives an empty result.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SLICE_ROWS, id_field, map_rows, materialize, small_batches, struct

KINDS = ("email", "ip", "card", "phone")
#: Rounds at most; few are needed, as each one adds what the patterns of the last one found.
ROUNDS = 8
MIN_SEEDS = 5
MIN_SCORE = 0.8
MIN_KNOWN = 0.25
#: Patterns that may pass by chance, of all that have seeds; and the most frequent that a kind counts as.
CHANCE, MOST_FREQUENT = 1e-3, 0.5
#: Instances and context words longer than this are named by a digest.
LONG = 64

_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Digits cannot be given back for a match to succeed, so possessive runs that start at a run's first digit find the same matches in linear time.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_hit = re.compile(r"[0-9@]")
_number = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9])*+")
_word = re.compile(r"\S+")
_allowed = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """For each @ the characters before it, back to the last match, and the longest domain after it."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _allowed:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, start)  # what lies before start cannot begin a later match
        at = text.find("@", max(at + 1, m.end() if m else 0))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if _hit.search(text):
        for m in _ip.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def render(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _shape(token: str) -> str:
    return ("mail" if re.fullmatch("[^@]*[A-Za-z0-9][^@]*@[^@]*[A-Za-z0-9][^@]*", token) else "at") if "@" in token else "number" if not re.search("[A-Za-z]", token) else "name"


def _named(word: str) -> str:
    """The word, or a digest of a long one."""
    return word if len(word) <= LONG else xxhash.xxh3_128_hexdigest(word.encode("utf-8", "surrogatepass"))


def _before(text: str, at: int, n: int, floor: int) -> list[str]:
    """Up to n words between ``floor`` and ``at`` on the same line, nearest first."""
    words = []
    while len(words) < n:
        while at > floor and text[at - 1] in " \t":
            at -= 1
        end = at
        while at > floor and not text[at - 1].isspace():
            at -= 1
        if at == end:
            break
        words.append(_named(re.sub("[0-9]", "0", text[at:end].lower())))
    return words


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, kind number or null, instance, patterns) of base matches and other identifier-like tokens."""
    spots = [(a, b, k) for a, k, b in base]
    taken = [(a, b) for a, _, b in base]
    at = t = 0
    m = _hit.search(text)
    while m:
        start, n = m.start(), m.end()
        while t < len(taken) and taken[t][1] <= start:
            t += 1
        if t < len(taken) and taken[t][0] <= start:
            at = taken[t][1]
        else:
            while start > at and not text[start - 1].isspace():
                start -= 1
            end = _word.match(text, start).end()
            number = _number.match(text, n - 1)
            end = max(end, number.end()) if number and number.end() - n >= 6 else end
            at = end
            if t < len(taken):
                end = min(end, taken[t][0])
            token = text[start:end]
            lead = len(token) - len(token.lstrip(".,;:!?\"'([{<=*"))
            token = token[lead:].rstrip(".,;:!?\"')]}>*")
            if len(token) >= 5 and (sum(c in "0123456789" for c in token) >= 3 or "@" in token):
                spots.append((start + lead, start + lead + len(token), None))
        m = _hit.search(text, max(at, n))
    made, floor = [], 0
    for a, b, kind in sorted(spots, key=lambda s: s[:2]):
        token = text[a:b]
        shape = _shape(token)
        left = _before(text, a, 2, min(floor, a))  # the words since the identifier before it
        floor = max(floor, b)
        after = _word.match(text, b + 1) if text[b : b + 1] == " " else None
        right = _named(after[0].lower()) if after else ""
        patterns = []
        if left:
            patterns.append(f"{shape} {left[0]} _")
            patterns.append(f"{shape} {left[0]} _ {right}")
        if len(left) > 1:
            patterns.append(f"{shape} {left[1]} {left[0]} _")
        made.append((a, b, kind, _named(re.sub(r"[^a-z0-9@]", "", token.lower())), patterns))
    return made


MENTION = ("start", "end", "kind", "instance", "patterns")


def annotation(texts: list[str | None]) -> tuple[list, list]:
    """Base spans and mentions of texts, as lists of dicts."""
    base = [base_spans(t or "") for t in texts]
    found = [mentions(t or "", b) for t, b in zip(texts, base, strict=True)]
    return [[{"start": a, "kind": k, "end": e} for a, k, e in b] for b in base], [[dict(zip(MENTION, m, strict=True)) for m in ms] for ms in found]


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """One pass over the texts: base spans and mentions of each row.

    With the text wanted back, only the text goes to Python and all columns
    stay in the JVM.
    """
    fields = struct(("base", "array<struct<start:int,kind:int,end:int>>"), ("mentions", "array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>>"))
    if with_text:
        small_batches(docs.sparkSession)
        kind = to_arrow_type(fields)

        def read(texts: pa.Array) -> pa.Array:
            parts = [pa.array([], kind)]
            for at in range(0, len(texts), SLICE_ROWS):
                base, found = annotation(texts.slice(at, SLICE_ROWS).to_pylist())
                parts.append(pa.array([{"base": b, "mentions": m} for b, m in zip(base, found, strict=True)], kind))
            return pa.concat_arrays(parts)

        noted = docs.select(*keep, F.col(text_col).alias("__text"), F.arrow_udf(read, fields)(F.col(text_col)).alias("__found"))
        return noted.select(*keep, "__found.base", "__found.mentions", "__text")

    schema = T.StructType([*(id_field(docs, c) for c in keep), *fields])

    def make():
        def f(cols):
            base, found = annotation(cols["__text"])
            return {c: cols[c] for c in keep} | {"base": base, "mentions": found}

        return f

    return map_rows(docs.select(*keep, F.col(text_col).alias("__text")), make, schema)


def score_graph(edges: DataFrame) -> DataFrame:
    """Kinds of instances, by scoring patterns and instances in turn.

    ``edges`` has distinct (pattern, instance) and the seed kinds of the
    instance as columns k0..k3 (0 or 1).  Returns ``instance, new_kind`` of the
    instances that are no seeds and reach MIN_SCORE.
    """
    n = range(len(KINDS))
    seed = F.greatest(*(F.col(f"k{k}") for k in n)) > 0
    all_of = edges.agg(F.count_distinct(F.when(seed, F.col("pattern"))), *(F.coalesce(F.sum(f"k{k}"), F.lit(0)) for k in n)).first()
    patterns_met, seeds = all_of[0], [all_of[1 + k] for k in n]
    share = [min(MOST_FREQUENT, x / max(1, sum(seeds))) or MOST_FREQUENT for x in seeds]
    enough = math.log(max(1, patterns_met) / CHANCE)
    # Instances that are seeds keep their kind; all others start at 0.
    edges = edges.withColumns({f"s{k}": F.col(f"k{k}").cast("double") for k in n})
    scores = before = None
    for _ in range(ROUNDS):
        patterns = edges.groupBy("pattern").agg(F.count("*").alias("n"), *(F.sum(f"k{k}").alias(f"seeds{k}") for k in n), *(F.sum(f"s{k}").alias(f"sum{k}") for k in n))
        scored = sum((F.col(f"sum{k}") for k in n), F.lit(0.0))
        trust = {}
        for k in n:
            information = F.log(F.col(f"sum{k}") / scored / share[k])
            told = (F.col(f"seeds{k}") >= MIN_SEEDS) & (scored >= MIN_KNOWN * F.col("n")) & (F.col(f"seeds{k}") * information >= enough)
            trust[f"r{k}"] = F.when(told, F.least(information / -math.log(share[k]), F.lit(1.0))).otherwise(0.0)
        good = patterns.select("pattern", *(v.alias(c) for c, v in trust.items())).filter(F.greatest(*(F.col(f"r{k}") for k in n)) >= MIN_SCORE)
        known = edges.drop(*(f"s{k}" for k in n)).join(good, "pattern", "left")
        scores = materialize(
            known.groupBy("instance").agg(
                F.max(seed).alias("seed"),
                *(F.max(f"k{k}").alias(f"was{k}") for k in n),
                *((1 - F.exp(F.sum(F.log1p(-F.least(F.coalesce(F.col(f"r{k}"), F.lit(0.0)), F.lit(0.999)))))).alias(f"t{k}") for k in n),
            ).select("instance", "seed", *(F.when(F.col("seed"), F.col(f"was{k}").cast("double")).when(F.col(f"t{k}") >= MIN_SCORE, F.col(f"t{k}")).otherwise(0.0).alias(f"s{k}") for k in n)),
            "instances",
        )
        now = scores.filter(~F.col("seed")).agg(*(F.count_if(F.col(f"s{k}") > 0) for k in n)).first()
        if now == before:
            break
        before = now
        edges = edges.drop(*(f"s{k}" for k in n)).join(scores.drop("seed"), "instance")
    best = F.greatest(*(F.col(f"s{k}") for k in n))
    kind = F.lit(None).cast("int")
    for k in reversed(n):
        kind = F.when(F.col(f"s{k}") == best, k).otherwise(kind)
    return scores.filter(~F.col("seed") & (best >= MIN_SCORE)).select("instance", kind.alias("new_kind"))


def discover(found: DataFrame) -> DataFrame:
    """``__row, extra`` (spans) of the rows of ``found`` in which high-confidence patterns point at new identifiers."""
    each = found.filter(F.size("mentions") > 0).select("__row", F.explode("mentions").alias("m")).select("__row", "m.*")
    n = range(len(KINDS))
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", *(F.coalesce((F.col("kind") == k).cast("int"), F.lit(0)).alias(f"k{k}") for k in n)).groupBy("pattern", "instance").agg(*(F.max(f"k{k}").alias(f"k{k}") for k in n))
    kinds = score_graph(materialize(edges, "edges"))
    new = each.filter(F.col("kind").isNull()).join(kinds, "instance")
    return new.groupBy("__row").agg(F.collect_list(F.struct("start", F.col("new_kind").alias("kind"), "end")).alias("extra"))  # at most the mentions of one text


def find(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Columns ``keep`` with ``base`` and ``spans`` (arrays of start, kind number, end, in order)."""
    found = scan(docs, text_col, keep, with_text).withColumn("__row", F.monotonically_increasing_id())
    found = materialize(found, "pii")
    columns = [*keep, "base", *(["__text"] if with_text else [])]
    # Rows without mentions need no join.
    bare = found.filter(F.size("mentions") == 0).select(*columns, F.col("base").alias("spans"))
    rest = found.filter(F.size("mentions") > 0).drop("mentions").join(discover(found), "__row", "left")
    return bare.unionByName(rest.select(*columns, F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra"))).alias("spans")))


def report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans."""
    found = find(docs, text_col, (id_col,))
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(id_col, *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_discovered"))


def redact_text(text: str, spans: list) -> str:
    """Spans become [KIND]; overlapping spans become one mark of the first kind."""
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        at = s["end"]
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by the name of its kind; null text stays null."""
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("__others"), text_col)  # so that no column of the caller's can clash
    found = find(packed, text_col, ("__others",), with_text=True)

    def write(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([redact_text(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    # Texts without spans, and null ones, do not go to Python again.
    clean = found.filter(F.size("spans") == 0).select("__others", "__text")
    marked = found.filter(F.size("spans") > 0).select("__others", F.arrow_udf(write, T.StringType())("__text", "spans").alias("__text"))
    made = clean.unionByName(marked)
    return made.select(*(F.col("__text").alias(c) if c == text_col else F.col("__others").getField(c).alias(c) for c in docs.columns))
