import re
from collections import Counter

from continuity.llm.quality import judge_texts
from tests.llm.cases import documents, no_documents, prose, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered), failed,
    )


def test_base_figures_equal_brute_force(spark):
    df = documents(spark)
    rows = judge_texts(df, out="judged").select("text", "judged.*").collect()
    assert len(rows) == df.count()
    for r in rows:
        figures = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert figures == base(r.text), r.text
        assert not (r.kept and r.base_failed)


def test_lines_are_judged_one_by_one(spark):
    good = prose(1, 60)
    bad = [
        "home | about | news | contact",
        "THIS!! IS!! SHOUTED!! OUT!! LOUD!!",
        "All rights reserved. Example Ltd",
        "w1### w2$$$ w3%%% w4&&& w5***",
        "nine words in a row that have no end",
        "Read more",
    ]
    text = good + "\n\n" + "\n".join(bad)
    row = judge_texts(documents(spark, [(1, text)]), out="q").select("q.*").first()
    assert row.clean_text == good + "\n"
    assert (row.n_boilerplate, row.n_navigation, row.n_punctuation) == (1, 2, 3)
    assert row.lost_chars == sum(len(b.replace(" ", "")) for b in bad)


def test_documents_that_lose_much_are_rejected(spark):
    menu = "\n".join(f"a{k} | b{k} | c{k} | d{k}" for k in range(60))
    rows = [(1, prose(1, 100)), (2, prose(2, 60) + "\n" + menu), (3, None), (4, prose(3, 49))]
    got = judge_texts(documents(spark, rows), out="q").select("doc_id", "q.kept").collect()
    assert dict(map(tuple, got)) == {1: True, 2: False, 3: False, 4: False}


def test_no_rows_and_no_python(spark):
    judged = judge_texts(no_documents(spark), out="q")
    assert judged.count() == 0
    plan = judge_texts(documents(spark), out="q")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert len(texts()) > 10
