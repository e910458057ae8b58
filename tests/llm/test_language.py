import math
import random
from collections import Counter, defaultdict

import pytest

from leakframe.llm import language


class Brute:
    """The definition, byte by byte."""

    def __init__(self, texts, order):
        self.order, self.after = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            data = b" " * order + language.folded(t)
            for i in range(order, len(data)):
                for o in range(order + 1):
                    self.after[o][data[i - o:i]][data[i]] += 1

    def bits(self, text):
        data, total = b" " * self.order + language.folded(text), 0.0
        for i in range(self.order, len(data)):
            for o in range(self.order, -1, -1):
                seen = self.after[o].get(data[i - o:i])
                if seen is None:
                    continue
                whole = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    total += math.log2(whole / seen[data[i]])
                    break
                total += math.log2(whole / len(seen))
            else:
                total += 8
        return total


TEXTS = {
    "de": ["der Hund und die Katze für über", "ein schöner Tag, und der Abend"], "en": ["the dog and the cat", "a fine day and the evening, they say"],
    "fr": ["le chien et la chatte, été", "une belle journée et le soir"],
}


@pytest.mark.parametrize("order", [0, 2, 3])
def test_code_lengths_by_definition(spark, order):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in TEXTS.items() for t in ts)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=order)
    brute = {lang: Brute(ts, order) for lang, ts in TEXTS.items()}
    rnd = random.Random(1)
    probes = ["the", "und der", "zzz qqq", "é", "Été 99", "the dog " * 50] + ["".join(rnd.choice("abtehé nd") for _ in range(60)) for _ in range(20)]
    got = model.code_lengths([language.folded(p) for p in probes])
    for p, row in zip(probes, got):
        assert row.tolist() == pytest.approx([brute[lang].bits(p) for lang in model.languages], abs=1e-6)


def test_long_text_is_coded_in_pieces_exactly(spark, monkeypatch):
    rows = [(1, "the dog and the cat", "en"), (2, "der Hund und die Katze", "de")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    whole = model.code_lengths([b"the cat and the dog " * 40])
    monkeypatch.setattr(language, "_PIECE", 17)
    assert model.code_lengths([b"the cat and the dog " * 40])[0] == pytest.approx(whole[0])


def test_odd_rows(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in TEXTS.items() for t in ts)]
    docs = spark.createDataFrame(rows + [(90, "x", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    odd = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "123 !?", 0), (None, "und der Abend", 0), (5, "the evening " * 20_000, 0), (5, "the day", 0), (6, "数字", 0)],
        "doc_id long, text string, score int",
    )
    got = language.predict(odd, model).collect()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "en")} <= by and len(got) == 7
    assert all(0 <= r.score <= 1 for r in got)
    assert sorted(r.doc_id for r in language.identified(odd, model).where("doc_id IS NOT NULL").collect()) == [5, 5]
    assert language.identified(odd, model).columns == odd.columns
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from leakframe.llm.queries import op5_language

    got = op5_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
