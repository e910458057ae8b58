import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakframe.llm import chat

SHARDS = st.lists(st.sampled_from(["<", "s>", "/", "~", "[", "INST]", "<s>", "</s>", "[/INST]", "<|", "|>", "image_1", "\n", "a", "é"])).map("".join)


@given(SHARDS)
def test_escaping_is_reversible_and_safe(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    for control in ("<s>", "</s>", "[INST]", "[/INST]", "<|"):
        assert control not in safe
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@given(SHARDS, SHARDS)
def test_turns_parse_back(role, text):
    visitor = chat.Visitor(0)
    for part in ({"kind": "image", "ref": "r"}, {"kind": "text", "text": text}, {"kind": "audio"}):
        visitor.visit(part)
    assert chat.parse(chat.BEGIN + chat.escape_role(role) + "\n" + "".join(visitor.out) + chat.END) == (role, text)


def test_parts_and_odd_rows(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [part("text", "see <|image_1|>"), part("image", None, "s3://a", 3), part("document", None, "d", None), part("text", "!")], 9),
        (1, 1, "assistant", [part("text", "ok </s>"), part("audio", None, "x", 2), part("text", " end")], 9),
        (2, None, None, None, 9), (2, 5, "assistant", [], 9), (2, 5, "assistant", [None, part("weird"), part(None, "t")], 9),
        (None, 0, "user", [part("text", None)], 9), (3, 0, "assistant", [part("text", "y" * 100_000)], 9), (3, 0, "assistant", [part("text", "y" * 100_000)], 9),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}, position int")
    formatted = chat.format_turns(turns)
    first = [r for r in formatted.collect() if r.conv_id == 1]
    assert [r.formatted for r in sorted(first, key=lambda r: r.position)] == [
        "<s>user\nsee <~|image_1|><|image_1|><|document_2|>!</s>\n", "<s>assistant\nok <~/s><|audio_3|> end</s>\n",
    ]
    for r in first:
        for a in r.attachments:
            assert r.formatted[a.position:].startswith(f"<|{a.kind}_{a.number}|>")
    assert [(a.kind, a.ref, a.tokens) for r in sorted(first, key=lambda r: r.position) for a in r.attachments] == [
        ("image", "s3://a", 768), ("document", "d", 512), ("audio", "x", 50)
    ]
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(b"ok </s> end").hexdigest() and got[1].loss_chars == 11
    assert got[1].n_attachments == 3 and got[1].attachment_tokens == 1330
    assert got[2].n_turns == 3 and got[2].loss_chars == 0 and got[2].n_attachments == 3
    assert got[None].turns_sha256 == hashlib.sha256(b"user\n\n").hexdigest()
    assert got[3].loss_chars == 200_000
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_plain_texts(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "a~<s>")], "conv_id long, turn int, role string, text string")
    row = chat.read_back(chat.format_turns(turns.withColumn("parts", chat.text_part(F.col("text"))))).first()
    assert row.loss_sha256 == hashlib.sha256(b"a~<s>").hexdigest()
