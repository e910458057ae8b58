import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leakframe.llm import packing, token_store, tokens
from leakframe.llm.tokens import Encoder

ODD = [
    "", None, "a  b", "  lead", "trail ", "a\n\nb", "a\x01b", "don't I'll  x", "Ünï çÅÿ×÷  x", "数字 123 4,5", "a\tb \t c", "\n", "é́ é  x",
    "<|endoftext|> x <|startoftext|>", "İstanbul ΣΑΣ ß", "a\u0085 b", "''s 's", "x" * 5000, "A.b,c;'d_e __ f`g", " ", "!?! a!b", "Foo, bar.\nBaz' q",
]


def texts():
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice("aB é's.,\n  \t1<|\x01ß😀") for _ in range(rnd.randint(0, 40))) for _ in range(200)]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("remembered", [50, 100_000])
def test_encoder_agrees_with_the_library(name, remembered):
    plain, own = library(name), Encoder(public_tokenizers.path(name), remembered)
    for _ in range(2):
        ids, counts = own.encode(pa.array(texts()))
        at = 0
        for text, n in zip(texts(), counts.tolist()):
            assert ids[at:at + n].tolist() == plain.encode(text or "", add_special_tokens=False).ids
            at += n
    assert own.encode(pa.array([], pa.string()))[0].tolist() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_word_is_remembered_once_for_all_its_spellings(name):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeéöx") for _ in range(9)) for _ in range(800)]
    plain, own = library(name), Encoder(public_tokenizers.path(name), 900 * 300)  # room for each word once
    asked = []
    for step in ("_library", "_joined"):
        setattr(own, step, lambda found, f=getattr(own, step): asked.extend(found) or f(found))
    for part in (words[:400], words[400:]):
        spelled = [[w + tail for w in part] for tail in ("", ",", ".", "!?", "...", ");")]
        if "word" in name:
            spelled += [[w.capitalize() for w in part], [w.upper() for w in part]]
        for text in (" " + " ".join(some) for some in spelled):
            assert own.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(asked) < 850 and own.held <= own.remembered


@pytest.mark.parametrize("n", [1, 255, 256, 257, 70_000, 131_072, 131_073, 300_000])
def test_coding_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_000).astype(np.uint32)
    table, blocks = token_store.encode_segment(ids)
    decoder = token_store.Decoder(table)
    assert (decoder.blocks(blocks) == ids).all()
    first = ids[:token_store.BLOCK]
    for begin, end in ((0, 1), (n // 3, n // 2), (len(first) - 1, len(first)), (0, len(first))):
        assert (decoder.span(blocks[0], begin, end) == first[begin:end]).all()


def test_one_symbol_and_damage():
    table, blocks = token_store.encode_segment(np.zeros(5000, np.uint32))
    assert token_store.Decoder(table).blocks(blocks).tolist() == [0] * 5000
    table, blocks = token_store.encode_segment(np.arange(5000, dtype=np.uint32))
    with pytest.raises(ValueError, match="damaged"):
        token_store.Decoder(table).blocks([blocks[0][:-1] + bytes([blocks[0][-1] ^ 1])])


def docs_with_ids():
    return [(None, "no id")] + [(i * 3 % 251, t) for i, t in enumerate(texts())] + [(7, "again"), (400, "Ab, " * 30_000)]


def test_files_round_trip(spark, tmp_path):
    rows = docs_with_ids()
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, part string").repartition(5)
    path = public_tokenizers.path("word_bpe_49k.json")
    token_store.write(docs, str(tmp_path / "f"), path, segment=20_000)
    got = token_store.read(spark, str(tmp_path / "f"), with_ids=True).orderBy("start").collect()
    plain = library("word_bpe_49k.json")
    want = sorted(((d, np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    for row in got:
        assert row.start == start and row.n_tokens == len(row.ids) // 4 and row.ids_crc32 == zlib.crc32(row.ids)
        start += row.n_tokens
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert sorted((r.doc_id or -1, bytes(r.ids)) for r in got) == sorted((d or -1, i) for d, i in want)
    token_store.write(docs.limit(0), str(tmp_path / "e"), path)
    assert token_store.read(spark, str(tmp_path / "e")).count() == 0


def test_cut():
    assert packing.cut(1, 10) == [1] and packing.cut(10, 10) == [10] and packing.cut(20, 10) == [10, 10] and packing.cut(23, 10) == [3, 10, 10]


def test_packing(spark):
    rows = docs_with_ids() + [(1000 + i, "word " * (37 * i % 900)) for i in range(300)] + [(5000, "same")] * 3
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, length int").repartition(4)
    found = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    packed = packing.pack(found, island_size=64)
    got = packed.collect()
    plain = library("byte_bpe_50k.json")
    want = {}
    for d, t in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        start = 0
        for number, n in enumerate(packing.cut(len(ids), 1024)):
            want.setdefault((d, number, start, n, zlib.crc32(ids[start:start + n].tobytes())), []).append(1)
            start += n
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert have == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r.length for r in got) // 1024)
    assert len(sequences) <= 1.03 * least + 2
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert whole == {k: b"".join(x[2] for x in sorted(v)) for k, v in sequences.items()}
    assert packing.pack(found.limit(0)).count() == 0


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(3)
    sizes = sorted(rng.integers(1, 1023, 500).tolist(), reverse=True)
    groups = [[i for i in range(490, 500)]]
    best = packing.evolve(sizes, groups if sum(sizes[490:]) <= 1024 else [], 1024, 5, 4, 10)
    assert sorted(i for b in best.members for i in b) == list(range(500))
    assert all(sum(sizes[i] for i in b) == 1024 - g for b, g in zip(best.members, best.gaps)) and min(best.gaps) >= 0


def test_a_part_gives_its_memory_back_and_loses_no_text(monkeypatch):
    calls = []
    monkeypatch.setattr(tokens, "trim", lambda: calls.append(1), raising=False)
    monkeypatch.setattr(tokens, "PART_BYTES", 100)
    own, plain = Encoder(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    found = list(own.parts(pa.array(texts())))
    assert [f[:2] for f in found] == list(zip([0] + [f[1] for f in found[:-1]], [f[1] for f in found])) and found[-1][1] == len(texts())
    assert np.concatenate([f[2] for f in found]).tolist() == [i for t in texts() for i in plain.encode(t or "", add_special_tokens=False).ids]
    assert len(calls) == len(found) > 10
