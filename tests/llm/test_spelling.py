from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from continuity.llm import spelling
from continuity.llm.queries import op12_spelling_variants
from tests.llm import cases

RULES = spelling.SpellingRules()


def apart_by_one(a: str, b: str) -> bool:
    """By trying every edit."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def literal(rows, rules):
    """The whole result from the rule: all pairs of words, chains followed one by one."""
    counts: Counter[str] = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if rules.misspell_one_in and h % rules.misspell_one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= rules.min_chars and n >= rules.min_count}
    near = {w: [v for v in words if v != w and apart_by_one(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= rules.ratio * words[w]:
            form[w] = best
    made = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        made.add((w, f, root, n, len(near[w]), words[f] if f else None))
    return made


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def typo(rng, word):
    at = rng.randrange(len(word))
    letter = rng.choice("abcdefghijéü")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


def corpus(seed: int, n_words: int = 60):
    """Words with chains of misspellings, the further from the first the rarer."""
    rng = random.Random(seed)
    pool = []
    for _ in range(n_words):
        word = "".join(rng.choice("abcdefgÀéüß÷") for _ in range(rng.randint(5, 9)))
        count = 400
        while count and word:
            pool += [word.upper() if rng.random() < 0.3 else word] * count
            word, count = typo(rng, word), count // rng.choice([4, 5, 6])
    rng.shuffle(pool)
    return [(k, " ".join(pool[at : at + 50]) + " , 漢字 x") for k, at in enumerate(range(0, len(pool), 50))]


@pytest.mark.parametrize("rules", [RULES, replace(RULES, bundle_words=7, groups=5, misspell_one_in=13), replace(RULES, min_chars=1, min_count=1, misspell_one_in=0, bundle_words=50)])
def test_rows_are_those_of_all_pairs(spark, rules):
    rows = corpus(3, 60 if rules.min_chars > 1 else 25)
    rows += [(None, "abcdefg abcdefg " * 5), (1, None), (2, ""), rows[0], rows[0]]
    expected = literal(rows, rules)
    assert got(spelling.spelling_variants(cases.documents(spark, rows), rules=rules)) == expected
    # There are chains of two forms or more, so roots that are not forms.
    assert any(root not in (word, form) for word, form, root, *_ in expected)


def test_search_and_pairs_against_every_pair():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcé漢") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    words += ["x" * 60 + "y", "x" * 61 + "y", "x" * 62, "x" * 60 + "z", "y" + "x" * 60]
    letters, n = spelling.Letters(words), len(words)
    a, b = (m.ravel() for m in np.meshgrid(np.arange(n), np.arange(n)))
    expected = {(i, j) for i in range(n) for j in range(n) if apart_by_one(words[i], words[j])}
    near = letters.one_apart(a, b)
    assert set(zip(a[near].tolist(), b[near].tolist())) == expected
    for groups in (1, 3, 22):
        counts = spelling.group_counts(words, groups)
        piece = np.array([len(w) // 100 for w in words])
        found = set()
        trie = spelling.Trie(piece, counts)
        trie.PART = 64
        for q, w in trie.search(piece, counts):
            pairs = set(zip(q.tolist(), w.tolist()))
            assert not pairs & found
            found |= pairs
        assert found >= expected
        off = counts[:, None, :] - counts[None, :, :]
        fits = (np.maximum(off, 0).sum(2) <= 1) & (np.minimum(off, 0).sum(2) >= -1)
        assert found == set(zip(*(x.tolist() for x in np.nonzero(fits))))


def test_long_texts_in_pieces(monkeypatch):
    text = "abc ÉÀé-def\n" * 50 + "z" * 500 + " end"
    whole = spelling.words_of_text(7, text, 3)
    for size in (1, 5, 64):
        monkeypatch.setattr(spelling, "_PIECE", size)
        assert spelling.words_of_text(7, text, 3) == whole


def test_one_ending_for_all_words(spark):
    """A bundle that holds every word is cut into blocks; nothing is lost."""
    rng = random.Random(8)
    stems = {"pre" + "".join(rng.choice("abc") for _ in range(4)) + "ing" for _ in range(70)}
    rows = [(k, " ".join(sorted(stems)[k % 3 :])) for k in range(12)]
    rules = replace(RULES, bundle_words=10, misspell_one_in=0)
    expected = literal(rows, rules)
    assert sum(r[4] for r in expected) > 100
    assert got(spelling.spelling_variants(cases.documents(spark, rows), rules=rules)) == expected


def test_query_on_cases_and_empty_tables(spark, tmp_path):
    cases.documents(spark).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in cases.documents(spark).collect()]
    assert got(op12_spelling_variants(spark, str(tmp_path / "some"))) == literal(rows, RULES)
    cases.no_documents(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert got(op12_spelling_variants(spark, str(tmp_path / "none"))) == set()
