"""Operators against plain Python on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import DATA, same_rows
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracklode.llm.buckets import bucket_pairs, mixed_pairs
from tracklode.llm.common import settings
from tracklode.llm import bpe, chat, html, language, lines, minhash, packing, pii, quality, queries, vectors

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
CLASH = {c: "x" for c in ("__text", "__id", "__row", "base", "spans", "mentions", "gone", "row", "id", "text_hash", "n", "hi", "key", "label", "score", "ids")}


def table(spark, rows, ddl="doc_id long, text string"):
    """Rows with extra columns whose names clash with everything inside."""
    df = spark.createDataFrame(rows, ddl)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents of the fixture with odd rows added."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    odd = [(10_000, None), (10_001, ""), (10_002, " \t\n"), (10_003, "one two"), (10_004, "one two"), (None, docs[0][1]), (10_005, long), (10_006, long + " tail"), docs[5], docs[5], (10_007, "a" * 40_000)]
    return docs + odd


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return table(spark, corpus)


def none(spark):
    return table(spark, [])


# 1 -------------------------------------------------------------------------


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(n if not k % 2 else 2 * n - 9 * (n > 4) for k, n in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base_is_the_plain_patterns():
    r = random.Random(3)
    parts = ["1", "25", "0.", ".", "-", " ", "+", "(", ")", "a@b", "@", "x.y", "é", "555", "\n", "4111111111111111", "10.1.2.3", "٣"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == base_spans(t)
        pii.mentions(t, base_spans(t))


def test_pii_report(spark, corpus, docs):
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in pii.report(docs).collect())
    want = Counter()
    for i, t in corpus:
        spans = base_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want[(i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(text.encode()).hexdigest(), text)] += 1
    assert got == want
    assert pii.report(none(spark)).count() == 0


def test_pii_discovers_by_context(spark):
    seeds = [(k, f"some text\nplease call +1 (555) 010-{1000 + k} today") for k in range(40)]
    new = [(100, "some text\nplease call 0155 2368 771 today"), (101, "in 1998 we saw 0155 2368 99 birds")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(table(spark, seeds + new)).collect()}
    assert got[100] == "phone:22:35" and got[101] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact(table(spark, seeds + new + [(102, None)])).collect()}
    assert text[100] == "some text\nplease call [PHONE] today" and text[0] == "some text\nplease call [PHONE] today" and text[102] is None


def labelled_identifiers(unseen: float, n: int = 1_500, seed: int = 7):
    """Texts of labelled identifiers and of numbers that are none; of the identifiers a share has a form the base patterns do not match."""
    r = random.Random(seed)
    contexts = {
        "email": ["contact e-mail: {} today", "escribe al correo {} ahora", "adresse courriel {} merci"],
        "ip": ["from host address {} port", "login from ip {} failed", "serveur joint {} hier"],
        "card": ["paid with card {} on", "tarjeta numero {} cargada", "karte nummer {} belastet"],
        "phone": ["please call {} today", "tel. privat {} abends", "numero de telephone {} svp"],
    }
    decoys = ["in total {} birds were seen", "order number {} was shipped", "zwischen {} und mehr stimmen", "version {} was released"]
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    octets = lambda first: ".".join(map(str, [first, *(r.randrange(256) for _ in range(3))]))

    def card(off):
        d = digits(15)
        d += str((off - sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))) % 10)
        return " ".join(d[i : i + 4] for i in range(0, 16, 4))

    known = {"email": lambda: f"{name()}@site{r.randrange(999)}.org", "ip": lambda: octets(r.randrange(256)), "card": lambda: card(0), "phone": lambda: f"+{r.randrange(10, 99)} {digits(3)} {digits(6)}"}
    hidden = {"email": lambda: f"{name()}@intranet", "ip": lambda: octets(r.randrange(300, 999)), "card": lambda: card(1), "phone": lambda: f"0{digits(3)} {digits(6)}"}
    rows, want = [], set()
    for i in range(n):
        text = ""
        for _ in range(3):
            if r.random() < 0.35:
                text += r.choice(decoys).format(r.choice([digits(4), f"{digits(4)} {digits(6)}", f"{r.randrange(9)}.{r.randrange(99)}.{r.randrange(99)}"])) + "\n"
                continue
            kind, new = r.choice(list(contexts)), r.random() < unseen
            before, after = r.choice(contexts[kind]).split("{}")
            value = (hidden if new else known)[kind]()
            if new:
                want.add((i, pii.KINDS.index(kind), len(text) + len(before), len(text) + len(before) + len(value)))
            text += before + value + after + "\n"
        rows.append((i, text))
    return rows, want


@pytest.mark.parametrize("unseen, least", [(0.05, 0.99), (0.10, 0.99), (0.30, 0.99), (0.50, 0.99)])
def test_pii_discovery_on_generated_contexts(spark, unseen, least):
    """Nothing that is no identifier is found, also where half of a context's identifiers are unknown."""
    rows, want = labelled_identifiers(unseen)
    found = pii.find(table(spark, rows)).collect()
    spans = lambda r, c: {(r["doc_id"], s["kind"], s["start"], s["end"]) for s in r[c]}
    assert not any(spans(r, "base") & want for r in found)
    new = set().union(*(spans(r, "spans") - spans(r, "base") for r in found))
    assert new <= want and len(new) >= least * len(want)


def plain_scores(edges):
    """Kinds of the instances that are no seeds: {(pattern, instance): seed kinds} scored in plain Python."""
    seeds = [sum(k[x] for k in edges.values()) for x in range(4)]
    share = [min(pii.MOST_FREQUENT, x / max(1, sum(seeds))) or pii.MOST_FREQUENT for x in seeds]
    enough = math.log(max(1, len({p for (p, _), k in edges.items() if any(k)})) / pii.CHANCE)
    own = {i: tuple(map(float, k)) for (_, i), k in edges.items()}
    score, before = dict(own), None
    for _ in range(pii.ROUNDS):
        trust = {}
        for p in {p for p, _ in edges}:
            members = [i for q, i in edges if q == p]
            sums = [sum(score[i][x] for i in members) for x in range(4)]
            trust[p] = [0.0] * 4
            for x in range(4):
                n = sum(edges[p, i][x] for i in members)
                if n >= pii.MIN_SEEDS and sum(sums) >= pii.MIN_KNOWN * len(members) and n * (told := math.log(sums[x] / sum(sums) / share[x])) >= enough:
                    trust[p][x] = min(1.0, told / -math.log(share[x]))
            if max(trust[p]) < pii.MIN_SCORE:
                trust[p] = [0.0] * 4
        for i in own:
            if not any(own[i]):
                t = [1 - math.prod(1 - min(0.999, trust[p][x]) for p, j in edges if j == i) for x in range(4)]
                score[i] = tuple(v if v >= pii.MIN_SCORE else 0.0 for v in t)
        now = [sum(score[i][x] > 0 for i in own if not any(own[i])) for x in range(4)]
        if now == before:
            break
        before = now
    return {i: s.index(max(s)) for i, s in score.items() if not any(own[i]) and max(s) >= pii.MIN_SCORE}


def test_pii_graph_scores_are_the_plain_ones(spark):
    r, found = random.Random(11), 0
    for _ in range(4):
        kinds = {f"i{k}": r.choice([(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]) for k in range(400)}
        favourite = {f"p{k}": r.randrange(4) for k in range(12)}
        edges = {}
        for p, x in favourite.items():
            for i, k in kinds.items():
                if r.random() < (0.5 if k[x] else 0.1 if not any(k) else 0.01):
                    edges[p, i] = k
        rows = [(p, i, *k) for (p, i), k in edges.items()]
        got = {x["instance"]: x["new_kind"] for x in pii.score_graph(spark.createDataFrame(rows, "pattern string, instance string, k0 int, k1 int, k2 int, k3 int")).collect()}
        assert got == plain_scores(edges)
        found += len(got)
    assert found


def test_pii_words_before_anything_tell_nothing(spark):
    """A word before all kinds of numbers, and one before few known ones among many unknown."""
    r = random.Random(1)
    seeds = ["+1 555 010 {:04}", "10.0.{}.7", "4111 1111 1111 1111"]
    rows = [(k, f"then it was {seeds[k % 2].format(r.randrange(200))} there") for k in range(200)]
    rows += [(1000 + k, f"then it was {k + 10_000} there") for k in range(50)]
    rows += [(2000 + k, f"since about +1 555 020 {k:04}") for k in range(40)] + [(3000 + k, f"since about {k + 20_000}") for k in range(400)]
    assert all(x["n_discovered"] == 0 for x in pii.report(table(spark, rows)).collect())


def test_pii_redact_keeps_columns(spark, docs):
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert not any(base_spans(r["text"]) for r in got.filter("text IS NOT NULL").collect() if "[" not in r["text"])


# 2 -------------------------------------------------------------------------


@pytest.fixture(scope="session")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken(encoding):
    c, r = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(1)
    texts = ["", "a" * 3000, "ab" * 2000, " " * 500 + "x", "\x1c a b  c", "日本語" * 200, "😀😀 x\n\n\n y", "\x00\x01"]
    texts += ["".join(r.choice("abcde  \n'stñé12。") for _ in range(r.randint(0, 60))) for _ in range(1000)]
    for t in texts:
        ids = c.encode(t)
        assert ids == encoding.encode_ordinary(t) and c.decode(ids).decode() == t


def test_bpe_round_trip(spark, corpus, docs, encoding):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in corpus:
        ids = encoding.encode_ordinary(t or "")
        want[(i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()) == want
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in corpus)
    assert bpe.round_trip(none(spark), RANKS, public_tokenizers.PATTERN).count() == 0


# 3 -------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97


def test_language_odd_rows(spark):
    rows = [(k, f"the cat sat on the mat number {k}" if k % 2 else f"le chat est sur la table {k}", "en" if k % 2 else "fr") for k in range(200)]
    rows += [(500, None, "en"), (501, "123 !!", "en"), (502, "le chat", None), (None, "the mat", "fr"), (1, rows[1][1], "en")]
    got = {r["doc_id"]: r for r in language.identify(table(spark, rows, "doc_id long, text string, lang string")).collect()}
    assert (got[500]["lang_pred"], got[501]["lang_pred"], got[501]["score"]) == ("und", "und", 0.0)
    assert got[502]["lang_pred"] == "fr" and got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    unlabelled = table(spark, [(1, "x", None)], "doc_id long, text string, lang string")
    assert language.identify(unlabelled).first()["lang_pred"] == "und"
    assert language.identify(unlabelled.filter("false")).count() == 0
    assert language.accept(table(spark, rows, "doc_id long, text string, lang string")).filter("doc_id >= 500").select("doc_id").collect() == [Row(doc_id=502)]


@pytest.mark.parametrize("block", [64, 7])
def test_language_equals_brute_force(spark, monkeypatch, block):
    """Naive Bayes by hand on a few rows, ties among them, with the labels in several blocks."""
    monkeypatch.setattr(language, "BLOCK", block)
    rows = [(k, f"abc{chr(97 + k % 26)}{chr(97 + k // 26)} xyz", f"l{k:03}") for k in range(90)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    blocks = [model.block(k) for k in range(model.n_blocks)]
    assert [x for labels, _ in blocks for x in labels] == sorted(r[2] for r in rows) and all(t.shape == (len(x), 1 << 16) and len(x) <= block for x, t in blocks)
    counts = {r[2]: Counter(language.grams([r[1]])[0].tolist()) for r in rows}

    def by_hand(text):
        grams = language.grams([text])[0].tolist()
        log = {x: sum(np.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * 2**16)) for g in grams) * min(1, language.EVIDENCE / len(grams)) for x, c in counts.items()}
        top = max(log.values())
        return {x: np.exp(v - top) for x, v in log.items()}

    texts = [r[1] for r in rows[:20]] + ["zzz", None, "12 !", rows[3][1] * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "label", "top", "kept", "score", "all")})
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    for k, text in enumerate(texts):
        name, score = found[k]
        if text is None or text == "12 !":
            assert (name, score) == ("und", 0.0)
        else:
            want = by_hand(text)
            assert want[name] > 0.999 * max(want.values()) and abs(score - want[name] / sum(want.values())) < 1e-3
    assert language.score(["q"], ["a", "b"], np.zeros((2, 1 << 16), np.float32))[0] == ["a"]
    labelled = spark.createDataFrame([(i, t, "l000") for i, t in enumerate(texts)] + [(r[0] + 100, r[1], r[2]) for r in rows], "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("row", "all")})
    kept = language.accept(labelled, 0.02)
    assert kept.columns == labelled.columns and not kept.filter("text IS NULL OR text = '12 !'").count() and kept.count()


def test_language_grams_by_hand():
    one = language.grams(["ab cd", "", "é1è", "ab cd"])
    assert one[1].tolist() == [11, 0, 7, 11] and one[0][:11].tolist() == one[0][-11:].tolist()


# 4 -------------------------------------------------------------------------


def near(corpus, width, num=80, den=100):
    sets = {}
    for k, (_, t) in enumerate(corpus):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    shared = Counter((a, b) for own in holders.values() for j, b in enumerate(own) for a in own[:j])
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n) and corpus[a][0] is not None and corpus[b][0] is not None:
            root[find(a)] = find(b)
    low = {}
    for k in sets:
        if corpus[k][0] is not None:
            low[find(k)] = min(low.get(find(k), 1 << 60), corpus[k][0])
    return Counter((i, len(sets[k]), low.get(find(k)) if i is not None else None, i == low.get(find(k)) if i is not None else True) for k, (i, _) in enumerate(corpus))


def copies():
    """Groups of near copies of many degrees around one text, unrelated texts with a shared passage, and exact copies."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join([word() for _ in range(60)] + passage)) for k in range(80)]
    rows += [(300 + k, "copy of one text in many documents") for k in range(60)]
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_equals_brute_force(spark, corpus, width):
    rows = corpus + copies()
    got = Counter(tuple(r) for r in minhash.near_duplicates(table(spark, rows), width=width).collect())
    assert got == near(rows, width)


@pytest.mark.parametrize("batch", ["1", "2", "3", "10000"])
def test_large_buckets_name_each_member_once(spark, batch):
    """The first member of a bucket of more than ``pivots`` members is paired with all others as large, whatever the batches."""
    r = random.Random(11)
    keys = [(k, h, h % 3) for k, n in enumerate((1, 2, 3, 4, 9, 40)) for h in r.sample(range(10 * k, 10 * k + 60), n)]
    likely = lambda x, y: np.where(x[:, 0] == y[:, 0], x[:, 0] + 1, 0)
    want, some = set(), {}
    for k in range(6):
        own = sorted((h, c) for key, h, c in keys if key == k)
        want |= {(own[0][0], h) for h, _ in own[1:] if len(own) > 2}
        for p, (a, x) in enumerate(own[:2]):
            some |= {(a, b): x + 1 for b, y in own[p + 1 :] if x == y}
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=batch):
        got = bucket_pairs(spark.createDataFrame(keys, "key long, hi long, c long"), 2, likely).collect()
    assert len({(x.a, x.b) for x in got}) == len(got)
    assert {(x.a, x.b) for x in got if x.large} == want
    assert {(x.a, x.b): x.likely for x in got if x.likely} == some


def test_near_copies_are_not_compared_around_every_pivot(spark):
    """Rows around pivots of a group of near copies; with both pivots of each bucket they were 20,769 of 1,142 classes, with the first 11,613."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(150)], []
    for k in range(1200):
        w = list(base)
        for j in r.sample(range(150), r.randrange(20)):
            w[j] = word()
        rows.append((k, " ".join(w)))
    around, real = [], minhash.materialize
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(minhash, "materialize", lambda df, name: around.append((name, real(df, name))) or around[-1][1])
        got = Counter(tuple(x) for x in minhash.near_duplicates(table(spark, rows), width=4).collect())
    assert got == near(rows, 4)
    assert dict(around)["around"].count() < 15_000


def test_minhash_empty(spark):
    assert minhash.near_duplicates(none(spark)).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(table(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


# 5 -------------------------------------------------------------------------


def test_html_equals_markup(spark):
    from html import unescape

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = (" ".join(unescape(b).split()) for b in re.split(r"</?(?:p|h1|b|br)>", article))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


EDGES = ["<div><div><h2>EDGE</h2></div></div>", "<section><div><h3>EDGE</h3></div></section>", "<figure><img src=x><figcaption>EDGE</figcaption></figure>", "<table><tbody><tr><td>EDGE</td></tr></tbody></table>", "<ul><li><span><em>EDGE</em></span></li></ul>", "<header><hgroup><h1>EDGE</h1></hgroup></header>", "<blockquote><p><i>EDGE</i></p></blockquote>"]


@pytest.mark.parametrize("marked", [True, False])
@pytest.mark.parametrize("edge", EDGES)
def test_html_keeps_short_blocks_at_the_edges(spark, edge, marked):
    """Whatever tags they have, also where the page marks nothing and the text is one element's."""
    if "header" in edge and not marked:
        return  # a page's own header goes
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    weights = html.weigh(html.count_events(pages, "html", "page_id", html.SAMPLE))
    for r in pages.collect():
        raw = r["html"] if marked else r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        start, end = ("<article>", "</article>") if marked else ("<div>", "</div>")
        plain = html.main_text(r["html"], weights)
        if not marked and len(plain.split()) < 50:
            continue  # an advert may be longer than the text
        at = raw.index(start, raw.index("<body")) + len(start) if marked else r["html"].index("<article>") + len("<div>")
        to = raw.index(end, at)
        assert html.main_text(raw[:at] + edge + raw[at:], weights) == "EDGE\n" + plain
        assert html.main_text(raw[:to] + edge + raw[to:], weights) == plain + "\nEDGE"


@pytest.mark.parametrize("name", ["commentList", "user_comments_box", "post-comments-section", "sidebarRight", "cookieBanner", "site-header", "leftSidebarWrap"])
def test_html_names_in_parts(name):
    page = f"<body><div class='{name}'><p>{'not this text ' * 5}</p></div><div class='text'><p>{'some words here ' * 20}</p><p>the end</p></div></body>"
    assert html.main_text(page, html.weigh({})).split("\n") == [("some words here " * 20).strip(), "the end"]
    assert not html.names_dropped("article-header") and not html.names_dropped("headline main-text no-comments")


def test_html_without_article():
    page = """<html><body><header><a href=/>Site</a></header><div id="cookie-notice"><p>We use cookies to make this site work well for all of our users.</p></div>
    <div class="content"><h2>Head &amp; line</h2><p>Some <b>bold</b>   text here with many words.</p><ul><li>one item</li><li>two</li></ul><form><p>Name</p></form>
    <div class="comments"><p>I like this, said the reader.</p></div></div><aside>Related</aside><footer>foot</footer><script>var a = "<p>x</p>";</script></body></html>"""
    assert html.main_text(page, html.weigh({})) == "Head & line\nSome bold text here with many words.\none item\ntwo"


@pytest.mark.parametrize("raw", [None, "", "<p>", "<div", "<script>x", "<" * 50_000, "<a " * 20_000, "<div>" * 20_000, "</p>" * 20_000])
def test_html_odd(raw):
    assert html.main_text(raw, html.weigh({})).strip("<") == ""


def test_html_region_is_the_best():
    r = random.Random(2)
    for _ in range(300):
        s = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        a, b = html.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


@pytest.mark.parametrize("attributes", ['class="no-sidebar"', 'class="with-sidebar x"', 'id="market-share-report"', 'class="sidebar"', 'data-props="' + "<p>not this</p>" * 1_000 + '"'])
def test_html_containers_that_hold_the_text(attributes):
    page = f"<body><div class='ad'>buy me now</div><div {attributes}><p>{'some words here ' * 20}</p><p>the end</p></div></body>"
    assert html.main_text(page, html.weigh({})).split("\n") == [("some words here " * 20).strip(), "the end"]


def test_html_long_attribute_values():
    for n in (3_000, 5_000, 1_000_000):
        for quote in "'\"":
            page = f"<p>one</p><div data-props={quote}{'<b>x</b> > ' * (n // 11)}{quote}>two</div>"
            assert html.main_text(page, html.weigh({})) == "one\ntwo"
    assert [k for k, *_ in html.events("<p title='>a</p>")] == ["p", "word", "/p"]  # never closed: the tag ends at the next >


def test_html_two_articles():
    page = f"<nav>a b c</nav><article><p>{'one ' * 30}</p></article><article><p>{'two ' * 30}</p></article><footer>x y</footer>"
    assert html.main_text(page, html.weigh({})).split("\n") == [("one " * 30).strip(), ("two " * 30).strip()]
    small = f"<main><p>{'text ' * 30}</p><div class='share-buttons'>send it on</div><p>{'more ' * 30}</p></main>"
    assert html.main_text(small, html.weigh({})) == f"{('text ' * 30).strip()}\n{('more ' * 30).strip()}"


def test_html_odd_rows(spark):
    rows = [(None, None, "<p>some text here</p>"), (1, "u", "<p>a b c</p>"), (1, "u", "<p>a b c</p>"), (2, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "__html")})
    got = Counter(map(tuple, html.extract(df).collect()))
    assert got == Counter([(None, None, "some text here", 14), (1, "u", "a b c", 5), (1, "u", "a b c", 5), (2, None, "", 0)])


def test_html_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 6 -------------------------------------------------------------------------


def test_packing(spark, corpus):
    t = Tokenizer.from_file(WORDS)
    corpus = [*corpus, (20_000, "a <|endoftext|> b"), (20_001, "x<|startoftext|><|endoftext|>y <|EndOfText|>"), (20_002, "<|endoftext|>" * 3_000)]
    docs = table(spark, corpus)
    want = Counter()
    for i, text in corpus:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = packing.pack(docs, WORDS).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(bins) <= least + 3
    assert packing.pack(none(spark), WORDS).count() == 0


def test_packing_plan_is_fullest():
    r = random.Random(4)
    for _ in range(100):
        left = Counter(r.randint(1, 20) for _ in range(r.randint(1, 10)))
        used = packing.fullest(25, sorted(left, reverse=True), left)
        sums = {0}
        for n, c in left.items():
            for _ in range(c):
                sums |= {s + n for s in sums}
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= 25) and all(k <= left[n] for n, k in used.items())
        bins = packing.plan(left, 25)
        assert sum((Counter({n: k * times for n, k in u.items()}) for times, u in bins), Counter()) == left


def test_packing_word_ids():
    w, r = packing.WordIds(WORDS), random.Random(1)
    for _ in range(3000):
        x = "".join(r.choice("abcde  \n\t'sStTrRñÑéÉé̀İıßΣςσAé12½。日\x1c  ­ǅﬁ") for _ in range(r.randint(0, 40)))
        assert w.encode(x) == w.whole(x)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|end", "oftext|>", "a", " ", "\n", "é"]
    for _ in range(3000):
        x = "".join(r.choice(marks) for _ in range(r.randint(0, 9)))
        assert w.encode(x) == w.whole(x) == np.array(Tokenizer.from_file(WORDS).encode(x, add_special_tokens=False).ids if _ < 30 else w.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


# 7 -------------------------------------------------------------------------


def test_viterbi_is_the_best_path():
    import itertools

    r = np.random.default_rng(1)
    for _ in range(50):
        n = r.integers(1, 6)
        first, step, emit = r.normal(size=3), r.normal(size=(3, 3)), r.normal(size=(n, 3))
        worth = lambda p: first[p[0]] + emit[range(n), p].sum() + sum(step[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: worth(list(p)))
        assert chat.viterbi(first, step, emit) == list(best)
        assert np.allclose(chat.between(step, emit).max(), chat.viterbi is not None and max(worth(list(p)) - first[p[0]] for p in itertools.product(range(3), repeat=int(n))))


def test_chat_cut_conversations_are_exact(spark):
    """One conversation over all tasks is decoded as in one piece."""
    r = random.Random(1)
    rows = [(5, k, "?" * r.randint(0, 1) + "word " * r.randint(1, 300)) for k in range(400)] + [(None, 0, None), (None, None, "user: hi"), (6, 0, "Human: x"), (6, 0, "Human: x"), (7, 1, "")]
    df = table(spark, rows, "conv_id long, turn long, text string")
    m = chat.Model()
    got = {r["turn"]: r["role_pred"] for r in chat.recover(df, m).filter("conv_id = 5").collect()}
    emit = np.array([m.emit(t) for c, _, t in rows if c == 5])
    assert [got[k] for k in range(400)] == [chat.ROLES[s] for s in chat.viterbi(m.start, m.step, emit)]
    rest = chat.recover(df, m).filter("conv_id IS NULL OR conv_id > 5").collect()
    assert len(rest) == 5
    want = chat.viterbi(m.start, m.step, np.array([m.emit("Human: x")] * 2))
    assert sorted(r["rendered"] for r in rest if r["conv_id"] == 6) == sorted(chat.render(chat.ROLES[s], "Human: x") for s in want)


def test_chat_recovers_roles(spark):
    c = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = chat.format_chats(c).join(c.select("conv_id", "turn", "role"), ["conv_id", "turn"]).collect()
    assert len(rows) == c.count() and sum(r["role"] == r["role_pred"] for r in rows) / len(rows) > 0.85
    assert chat.format_chats(c.filter("false")).count() == 0


def test_chat_transcript():
    text = "System: be kind\nUser: hello?\nare you there\nAssistant: yes.\nUser: good"
    assert chat.split_transcript(text) == [("system", "be kind"), ("user", "hello?\nare you there"), ("assistant", "yes."), ("user", "good")]
    assert len(chat.split_transcript(None)) == 1


def test_chat_query_parses_transcripts(spark):
    """A row with a whole transcript becomes a row for each turn; marks and markers inside texts are kept apart."""
    rows = [(1, 0, "System: be kind\nUser: hello?\nare you there\nAssistant: yes."), (1, 1, "User: good <|end|> <\\|end|>"), (2, 0, None)]
    got = chat.recover(spark.createDataFrame(rows, "conv_id long, turn long, text string"), chat.Model()).orderBy("conv_id", "turn", "piece").collect()
    assert [(r["conv_id"], r["turn"], r["piece"], r["rendered"]) for r in got[:4]] == [
        (1, 0, 0, "<|system|>\nbe kind\n<|end|>"),
        (1, 0, 1, "<|user|>\nhello?\nare you there\n<|end|>"),
        (1, 0, 2, "<|assistant|>\nyes.\n<|end|>"),
        (1, 1, 0, "<|user|>\ngood <\\|end|> <\\\\|end|>\n<|end|>"),
    ]
    assert len(got) == 5 and got[4]["rendered"].endswith("|>\n\n<|end|>")
    assert chat.strip_marker("user", "A: first option") == "A: first option" and chat.strip_marker("assistant", "A: first option") == "first option"


# 8 -------------------------------------------------------------------------


def test_quality_equals_sql(spark, duck):
    same_rows(queries.op8_quality(spark, DATA), duck, quality.SQL)


def test_quality_odd_rows(spark, docs):
    got = quality.assess(docs, with_text=True).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[10_000]["n_words"] == 0 and by[10_000]["base_failed"] and not by[10_001]["kept"]
    good = "\n".join(" ".join(f"w{k}x{j}" for j in range(8)) + "." for k in range(20))
    menu = good + "\n" + "\n".join(f"a{k} | b{k} | c{k}" for k in range(200))
    rows = {r["doc_id"]: r for r in quality.assess(table(spark, [(1, good), (2, menu), (3, "word " * 60)]), with_text=True).collect()}
    assert rows[1]["kept"] and rows[1]["cleaned"] == good and not rows[2]["kept"] and not rows[2]["base_failed"] and rows[3]["base_failed"]
    assert quality.assess(none(spark)).count() == 0


# 9 -------------------------------------------------------------------------


def repeated(corpus, n):
    """Of each document, by (id, text), the places of words that stand in a run of n words found earlier."""
    docs = sorted({(i is not None, i or 0, t) for i, t in corpus if t is not None}, key=lambda d: d[:2])
    seen, out = set(), {}
    for key in docs:
        words = key[2].encode().split()
        covered = set()
        for k in range(len(words) - n + 1):
            run = tuple(words[k : k + n])
            if run in seen:
                covered |= set(range(k, k + n))
            seen.add(run)
        out[key] = covered
    return out


def repeated_lines(corpus):
    """Likewise the places of words in real lines of LEAST or more words that stood before."""
    docs = sorted({(i is not None, i or 0, t) for i, t in corpus if t is not None}, key=lambda d: d[:2])
    seen, out = set(), {}
    for key in docs:
        covered, at = set(), 0
        for line in key[2].encode().split(b"\n"):
            words = tuple(line.split())
            if len(words) >= lines.LEAST:
                if words in seen:
                    covered |= set(range(at, at + len(words)))
                seen.add(words)
            at += len(words)
        out[key] = covered
    return out


def test_lines_real_lines_go_and_nothing_else(spark):
    """Without long runs the result is the exact rule: later copies of lines of LEAST or more words go, with their ends."""
    r = random.Random(6)
    pool = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(60)]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(0, 4)))) for k in range(300)]
    rows += [(None, pool[0]), (None, None), (7, "x y z\n\nx  y\tz\nu v"), rows[3], rows[3], (400, "  x y z  \nend")]
    gone, want = repeated_lines(rows), Counter()
    for i, t in rows:
        if t is None:
            want[i, None] += 1
            continue
        away, kept, at, total = gone[i is not None, i or 0, t], [], 0, len(t.split())
        for line in t.split("\n"):
            n = len(line.split())
            around = [k in away for k in (at - 1, at) if 0 <= k < total]
            if not (n and at in away) and not (not n and around and all(around)):
                kept.append(line)
            at += n
        want[i, "\n".join(kept)] += 1
    assert Counter((x["doc_id"], x["text"]) for x in lines.dedup(table(spark, rows)).collect()) == want
    assert sum(map(len, gone.values())) > 100


def test_lines_equal_brute_force(spark, corpus):
    """All that stands in repeated lines or in repeated runs of 50 words goes, and nothing outside of repeated lines and of repeated runs of NOISE words."""
    r = random.Random(5)
    line = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(7)) for _ in range(n))
    passage, long = [line(12) for _ in range(6)], line(60)
    extra = []
    for k in range(30):
        own = [line(r.randint(3, 20)) for _ in range(6)]
        own[3:3] = passage[r.randint(0, 2) : r.randint(4, 6)] if k % 3 else [f"{line(4)} {long} {line(5)}"]
        extra.append((20_000 + k, "\n".join(own)))
    extra.append((20_100, "\n".join([line(9)] * 3 + passage + passage)))
    rows = corpus + extra
    got = lines.dedup(table(spark, rows))
    assert got.columns == table(spark, []).columns
    found = {(d["doc_id"], d["text"]) for d in got.collect()}
    must, may, whole = repeated(rows, lines.NOISE + lines.WINDOW - 1), repeated(rows, lines.NOISE), repeated_lines(rows)
    must, may = ({k: x[k] | whole[k] for k in x} for x in (must, may))
    texts = {}
    for i, t in found:
        texts.setdefault(i, []).append(t)
    for (has_id, i, t), away in must.items():
        i = i if has_id else None
        words = t.split()
        kept = [w for x in texts[i] for w in x.split()]
        left = [w for k, w in enumerate(words) if k not in may[has_id, i or 0, t]]
        most = [w for k, w in enumerate(words) if k not in away]
        assert len(left) <= len(kept) <= len(most)
        at = iter(kept)
        assert all(w in at for w in left)  # in order
        if not away and not may[has_id, i or 0, t]:
            assert texts[i] == [t]
    assert (None, ) not in texts
    texts = {d["doc_id"]: d["text"] for d in got.filter("doc_id >= 20000").collect()}
    assert sum(long in t for t in texts.values()) == 1  # a passage inside a line stays once
    assert lines.dedup(none(spark)).count() == 0


def test_lines_by_hand(spark):
    words = [f"w{k}" for k in range(60)]
    run = " ".join(words)
    rows = [(1, f"a b {run} c d\ne"), (2, f"x {run} y\n\nz"), (3, f"q\n{run}\nr"), (4, " ".join(words[:26])), (5, " ".join(words[:25])), (None, None)]
    got = {r["doc_id"]: (r["text"], r["n"]) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), count_col="n").collect()}
    assert got == {1: (rows[0][1], 0), 2: ("x y\n\nz", 60), 3: ("q\nr", 60), 4: got[4], 5: (rows[4][1], 0), None: (None, 0)}
    assert got[4][1] in (0, 26)


def test_lines_hashes(monkeypatch):
    monkeypatch.setattr(lines, "STEP", 100)
    r = random.Random(7)
    texts = ["".join(r.choice("ab \n\té€") for _ in range(n)) for n in (3_000, 0, 40, 200, 1_000, 7, 220)]
    raw = "\n".join(texts).encode()
    h, starts = lines.word_hashes(raw)
    words = raw.split()
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert dict(zip(words, h.tolist(), strict=True)) == {w: int(lines.word_hashes(w)[0][0]) for w in words}
    assert all(raw[s : s + len(w)] == w for s, w in zip(starts.tolist(), words, strict=True))
    counts = np.array([len(t.split()) for t in texts])
    g, places = lines.fingerprints(h, counts)
    whole, want, at = lines.line_hashes(h).tolist(), [], 0
    assert whole[3] == int(lines.line_hashes(h[3 : 3 + lines.NOISE])[0])
    for n in counts.tolist():
        mine = range(at, at + max(0, n - lines.NOISE + 1))
        for s in range(mine.start, max(mine.start + 1, mine.stop - lines.WINDOW + 1)):
            window = [p for p in range(s, s + lines.WINDOW) if p in mine]
            want += [p for p in window if whole[p] == min(whole[q] for q in window)]
        at += n
    assert places.tolist() == sorted(set(want)) and g.tolist() == [whole[p] for p in places]


def test_lines_equal_lines_are_linear():
    h = lines.word_hashes(b"same line here\n" * 200_000)[0]
    assert len(lines.fingerprints(h, np.array([len(h)]))[1]) < len(h) / 15
    assert lines.cut("a b\n" * 100_000, [{"start": 2, "end": 200_000}]) == ("a b", 199_998)


# 10 ------------------------------------------------------------------------


def test_vectors_equal_sql(spark, duck):
    same_rows(queries.op10_vectors(spark, DATA), duck, vectors.SQL)


def test_vectors_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    centers = r.normal(size=(6, 16))
    rows = [(k, (centers[k % 6] + r.normal(size=16) * (0.05 + 0.07 * (k % 5))).tolist()) for k in range(240)]
    rows += [(1000 + k, r.normal(size=16).tolist()) for k in range(60)]
    rows += [(2000 + k, rows[0][1]) for k in range(30)] + [(2100, (2 * np.array(rows[1][1])).tolist())]
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (3004, []), (3005, [1.0, 2.0]), (3006, [1e-300] * 16), (3007, [1e300] * 16), (rows[3][0], rows[3][1])]
    everything = rows + odd
    good = [k for k, (i, v) in enumerate(everything) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {k: vectors.unit(np.array([everything[k][1]]))[0] for k in good}
    links = {k: [j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.9] for k in good}
    want = Counter()
    for k, (i, _) in enumerate(everything):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(everything[j][0] for j in seen)
        want[(i, len(links.get(k, [])), low, i == low)] += 1
    df = table(spark, everything, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in vectors.near_duplicates(df).collect()) == want
    monkeypatch.setattr(vectors, "BLOCK", 16)  # many blocks a component
    assert Counter(tuple(r) for r in vectors.near_duplicates(df).collect()) == want


def test_vectors_empty(spark):
    assert vectors.near_duplicates(table(spark, [], "vec_id long, embedding array<double>")).count() == 0


# pipeline --------------------------------------------------------------------


def test_pipeline_by_stages(spark):
    """run() gives what the plain stages give, each on what the one before it kept."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    pred = {r["doc_id"]: r for r in language.predict(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), language.fit(spark.read.parquet(f"{DATA}/documents.parquet").filter(~language.held_out()))).collect()}
    kept = [(i, t) for i, t, _ in rows if pred[i]["score"] >= 0.5]
    shorter = lines.dedup(spark.createDataFrame(kept, "doc_id long, text string")).collect()  # brute-forced above
    kept = [(r["doc_id"], r["text"]) for r in shorter if r["text"].split() or not dict(kept)[r["doc_id"]].split()]
    verdict = {i for (i, _, low, keep) in near(kept, 5).elements() if keep}
    kept = [(i, t) for i, t in kept if i in verdict]
    redacted = {}
    for i, t in kept:
        redacted[i] = pii.redact_text(t, [{"start": a, "kind": k, "end": b} for a, k, b in base_spans(t)])
    t = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, text in redacted.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, DATA).collect()) == want


def test_pipeline_stages_keep_columns(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (77_777, "", "en", "s", 0)], documents.schema)
    for rows in (documents.limit(0), documents.limit(20).unionByName(odd)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, DATA).columns == documents.columns
            stage(spark, rows, DATA).count()


def test_mixed_pairs_equal_brute_force(spark):
    r = np.random.default_rng(8)
    rows = [(int(k), i, int(r.integers(4)), int(r.integers(8)), 0) for i, k in enumerate(r.choice(5, 150, p=[0.6, 0.2, 0.1, 0.05, 0.05]))]
    keep = lambda x, y: (x[:, 0] != y[:, 0]) & (x[:, 1] == y[:, 1])
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] != b[2] and a[3] == b[3]}
    keys = spark.createDataFrame(rows, "key long, hi long, group long, s0 long, s1 long")
    for block in (4, 1000):
        assert {tuple(x) for x in mixed_pairs(keys, keep, block).collect()} == want
    assert mixed_pairs(keys.limit(0), keep, 4).count() == 0
