import random

import pytest

from lakeloom.llm.sentences import paragraphs, sentences, split_sentences


def texts(t, known=()):
    return [t[a:b] for a, b in split_sentences(t, set(known))]


def test_rules():
    assert texts('The banner said "Plan changed. Check it." and then closed. Next one!') == ['The banner said "Plan changed. Check it." and then closed.', "Next one!"]
    assert texts("A heading\n \nOne two.\nThree?") == ["A heading", "One two.", "Three?"]
    assert texts("Version 1.5.2 of config.yaml (see 3.1) works. Yes.") == ["Version 1.5.2 of config.yaml (see 3.1) works.", "Yes."]
    assert texts("丁斯卡写道：“不见了。请检查。”我们走了。好！") == ["丁斯卡写道：“不见了。请检查。”", "我们走了。", "好！"]
    assert texts("「消えました。確認。」と書きました。次。") == ["「消えました。確認。」と書きました。", "次。"]
    assert texts("Wait... the box moved?! (Fully inside. Yes.) Then on.") == ["Wait... the box moved?!", "(Fully inside. Yes.)", "Then on."]
    assert texts("She met Dr. Sefka there.", ["a\tdr"]) == ["She met Dr. Sefka there."]
    assert texts("No end mark") == ["No end mark"] and split_sentences("", set()) == [] and split_sentences(None, set()) == [] and split_sentences(" \n\n ", set()) == []
    assert texts('An "open quote. It goes on. And on.') == ['An "open quote.', "It goes on.", "And on."]


@pytest.mark.parametrize("t", ["a\n\nb", "  x \n \n\n y", "\n\n", "z"])
def test_paragraphs(t):
    assert [t[a:b] for a, b in paragraphs(t)] == t.split() and all(t[a:b] == t[a:b].strip() for a, b in paragraphs(t))


def test_learned(spark):
    names = ["Sefka", "Tavish", "Orvella", "Ilmari", "Wenna"]
    parts, rows = [], []
    for i in range(300):
        one = ["It changed the guide.", f"The end came, as Dr. {names[(i + 1) % 5]} said.", "We saw the rest here.", f"A plan of Dr. {names[i % 5]} costs {i} euros, e.g. in May."]
        random.Random(i).shuffle(one)
        parts.append(one)
        rows.append((i, " ".join(one[:3]) + "\n\n" + one[3], ["en", "EN", None][i % 3 if i > 50 else 0]))
    rows += [(900, None, "en"), (901, "", None)]
    got = {}
    for r in sentences(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        got.setdefault(r.doc_id, []).append((r.sentence_no, r.start_char, r.end_char, r.sentence))
    assert set(got) == set(range(300))
    for i, t, _ in rows[:300]:
        one = sorted(got[i])
        assert [s for *_, s in one] == parts[i]
        assert all(t[a:b] == s for _, a, b, s in one)
    assert sentences(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_script_of_the_whole_text():
    from lakeloom.llm.sentences import script_of

    latin, thai = "word " * 300, "ภาษาไทย" * 300
    text = latin + thai + latin + thai + latin
    assert script_of(text) == script_of(thai) == "Thai"


def test_whole_words_quotes_and_the_joined_way(spark):
    from lakeloom.llm.sentences import sentences, shielded, split_sentences

    long = "(" + "word " * 2000 + "end. More) stays. Next one."
    assert shielded(long)[0] == (0, long.index(")"))
    assert len(split_sentences(long, set())) == 2
    assert split_sentences("a." * 50_000, set())[-1][1] == 100_000
    rows = [(i, f"Dr. No came at noon. He left{i}. The end was near.", "en") for i in range(40)] + [(50, "ไทย ภาษา", "th"), (51, None, "en"), (52, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small, large = (sorted(map(tuple, sentences(docs, most_shipped=n).collect())) for n in (200_000, 0))
    assert small == large and len(small) == 81
    assert sentences(docs.limit(0)).count() == 0
