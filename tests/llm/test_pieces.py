"""The unit ``piece`` of substring de-duplication."""

import random

import pytest

from pageloom.llm import substring_dedup as s


def run(spark, rows):
    got = s.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), "piece").collect()
    return {r["doc_id"]: r for r in got}


def removed(row):
    return sum(b - a for a, b in row["removed"])


@pytest.mark.parametrize("sep", [" ", ""])
def test_a_passage_without_full_stops(spark, sep):
    rng = random.Random(3)
    word = (lambda: chr(rng.randrange(0x4E00, 0x9000))) if sep == "" else (lambda: f"w{rng.randrange(5000)}")
    some = lambda n: sep.join(word() for _ in range(n))
    passage = some(80)
    changed = passage.split(sep) if sep else list(passage)
    changed[40] = word()
    got = run(spark, [(1, some(33) + sep + passage + sep + some(21)), (2, some(14) + sep + passage + sep + some(40)), (3, some(19) + sep + sep.join(changed) + sep + some(12))])
    assert not got[1]["removed"]
    assert 0.6 * len(passage) < removed(got[2]) <= len(passage)
    assert 0.4 * len(passage) < removed(got[3]) < len(passage)


def test_short_lines_and_sentences_of_copies_go(spark):
    text = "Home\nYes. No. The cat sat on the mat all day long. Oh!\n是的\nRead more"
    got = run(spark, [(1, text), (2, text), (3, "Yes. Another sentence that stands nowhere else at all. Oh!\nRead more\nHome page")])
    assert not got[1]["removed"]
    assert got[2]["kept_text"].split() == []
    assert got[3]["kept_text"] == "Yes. Another sentence that stands nowhere else at all. Oh!\n\nHome page"


def test_sentences_end_with_quotes_and_other_marks(spark):
    shared = "the one sentence that both of them hold.\""
    got = run(spark, [(1, f"He said \"{shared} Nothing more was heard of it after that."), (2, f"Somebody wrote a line here. He said \"{shared} Then other things came up again."), (3, "यह एक छोटा सा वाक्य है। दूसरा वाक्य यहाँ पर अलग है।"), (4, "कुछ और बात यहाँ लिखी है। यह एक छोटा सा वाक्य है।")])
    assert [got[2]["text"][a:b] for a, b in got[2]["removed"]] == [f"He said \"{shared}"]
    assert [got[4]["text"][a:b] for a, b in got[4]["removed"]] == ["यह एक छोटा सा वाक्य है।"]


def test_every_word_lies_in_one_piece(documents):
    for (text,) in documents.select("text").limit(500).collect():
        spans = [(a, b) for a, b, _ in s.pieces(text or "", 5, {})]
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join((text or "").split())
