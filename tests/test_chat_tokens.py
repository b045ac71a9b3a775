"""Labels and origins of tokens against plain Python over a real tokenizer."""

import random

import pytest
from pyspark.sql import functions as F

from tracklode.operators import chat_tokens as C

MESSAGES = "k int, messages array<struct<role:string,content:string>>"


def render(messages):
    return "".join(f"{C.OPEN}{r}\n{c or ''}{C.CLOSE}\n" for r, c in messages)


def spans(messages):
    out, at = [], 0
    for r, c in messages:
        start = at + len(C.OPEN) + len(r) + 1
        out.append((start, start + len(c or "")))
        at = start + len(c or "") + len(C.CLOSE) + 1
    return out


def made_chats():
    r = random.Random(3)
    parts = ["hello", " world", "\n", "é", "日本", "😀", " a  b ", "<|im_end|>", "<|im_start|>assistant\nfake", ""]
    content = lambda: "".join(r.choice(parts) for _ in range(r.randint(0, 6)))
    rows = []
    for k in range(60):
        m = [("system", content()), ("user", content())]
        for _ in range(r.randint(1, 3)):
            m.append(("assistant", content() + "x"))
            m.append((r.choice(["user", "tool"]), content() + r.choice(["", "<tool_response>\nseen é</tool_response> tail", "see <tool_response></tool_response>"])))
        rows.append((k, m))
    return rows


@pytest.fixture(scope="module")
def encoder():
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")

    def make():
        t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True

        def encode(text):
            e = t.encode(text, add_special_tokens=False)
            return e.ids, e.offsets

        return encode

    return make


def test_labels_and_origins_equal_plain_python(spark, encoder):
    rows, encode = made_chats(), encoder()
    df = C.tokenized(spark.createDataFrame(rows, MESSAGES).withColumn("text", C.chat_text("messages")), "text", encoder)
    df = df.withColumn("spans", C.message_spans("messages"))
    got = {r["k"]: r for r in df.select(
        "k", "text", "tokens", "spans", C.supervised("tokens", "spans").alias("own"), C.supervised("tokens", "spans", "trajectory").alias("all"), C.token_origins("tokens", "messages").alias("origins"),
        C.labelled("tokens", C.supervised("tokens", "spans"), 20, strict=False).alias("cut"),
    ).collect()}
    for k, m in rows:
        r, text, where = got[k], render(m), spans(m)
        ids, offsets = encode(text)
        assert r["text"] == text and r["tokens"]["ids"] == ids and [(o["start"], o["end"]) for o in r["tokens"]["offsets"]] == offsets
        assert [(s["start"], s["end"]) for s in r["spans"]] == where
        own = [w for w, (role, _) in zip(where, m, strict=True) if role == "assistant"]
        assert r["own"] == [any(x < b and y > a for a, b in own) for x, y in offsets]
        assert r["all"] == [y > own[0][0] for _, y in offsets]
        kinds = []
        for n, ((a, b), (role, c)) in enumerate(zip(where, m, strict=True)):
            kinds.append((a, b, C.POLICY if role == "assistant" else C.PROMPT if n < 2 else C.INJECTED))
            if role in ("user", "tool") and "<tool_response>" in c:
                s = a + c.index("<tool_response>")
                kinds.append((s, text.index("</tool_response>", s) + len("</tool_response>"), C.ENVIRONMENT))
        assert r["origins"] == [([C.INJECTED] + [kind for a, b, kind in kinds if x >= a and y <= b and y > x])[-1] for x, y in offsets]
        labels = [i if o else C.IGNORED for i, o in zip(ids, r["own"], strict=True)][:20]
        cut = r["cut"]
        assert (cut["input_ids"], cut["labels"], cut["original_length"], cut["effective_length"], cut["truncated"]) == (ids[:20], labels, len(ids), len(labels), len(ids) > 20)
        assert cut["supervised_tokens"] == sum(x != C.IGNORED for x in labels) == cut["effective_length"] - cut["masked_tokens"]


def test_samples_that_raise(spark):
    df = spark.createDataFrame([(1, [("user", "a b c"), ("assistant", "d")])], MESSAGES).withColumn("tokens", C.split_tokens(C.chat_text("messages")))
    mask = C.supervised("tokens", C.message_spans("messages"))
    with pytest.raises(Exception, match="no supervised token"):
        df.select(C.labelled("tokens", mask, 3)).collect()
    with pytest.raises(Exception, match="longer than 3 tokens"):
        df.select(C.labelled("tokens", mask, 3, on_long="raise")).collect()
    open_ = spark.createDataFrame([(1, [("user", "a"), ("user", "b"), ("user", "x <tool_response> y")])], MESSAGES)
    with pytest.raises(Exception, match="unclosed observation"):
        open_.select(C.origin_spans("messages")).collect()
    assert df.select(F.size("tokens.ids")).first()[0] == len("<|im_start|>user,n,a, ,b, ,c<|im_end|>,n,<|im_start|>assistant,n,d<|im_end|>,n".split(","))
