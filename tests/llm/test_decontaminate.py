import random

from continuity.llm import decontaminate as D
from tests.llm.cases import documents, no_documents, prose

ITEMS = [
    (1, prose(31, 40)),
    (2, prose(32, 20)),
    (3, "nine plain words make up this very short item"),
    (4, "too short"),
    (5, None),
    (5, ""),
    (1, prose(33, 30)),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id int, text string")


def replaced(text, every, seed):
    rng = random.Random(seed)
    words = text.split()
    for start in range(0, len(words), every):
        words[min(start + rng.randrange(every), len(words) - 1)] = "other"
    return " ".join(words)


def test_planted_overlaps_are_found_and_nothing_else(spark):
    item = {k: t for k, (_, t) in enumerate(ITEMS)}
    rows = [
        (10, prose(41, 100) + " " + item[0] + " " + prose(42, 50)),
        (11, prose(43, 100) + " " + replaced(item[0], 9, 1)),
        (12, item[1].upper()),
        (13, prose(44, 30) + " (" + item[2].replace(" ", ", ") + ")"),
        (14, prose(45, 30) + " nine plain words make up this other short item"),
        (15, prose(46, 200)),
        (16, item[6]),
        (17, "too short"),
        (18, prose(47, 30) + " Too, short! " + prose(48, 30)),
        (19, "too very short"),
        (20, prose(49, 30) + " nine plain nouns make up this other short item"),
        (10, prose(41, 100) + " " + item[0] + " " + prose(42, 50)),
    ]
    df = documents(spark).unionByName(documents(spark, rows))
    got = D.overlaps(df, items(spark)).collect()
    # One of nine words may differ, two may not; an item of two words must be found whole.
    assert sorted((r.doc_id, r.item_id) for r in got) == [
        (10, 1), (10, 1), (11, 1), (12, 2), (13, 3), (14, 3), (16, 1), (17, 4), (18, 4)
    ]
    first = next(r for r in got if r.doc_id == 10)
    assert (first.start_word, first.n_words, first.n_equal) == (100, 40, 40)
    kept = D.without_overlaps(df, items(spark))
    assert kept.columns == df.columns
    assert kept.count() == df.count() - 9


def test_best_stretch_equals_brute_force():
    rng = random.Random(2)
    import numpy as np

    search = D.Search(overlap_words=4)
    for _ in range(300):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randint(0, 25))], dtype=bool)
        best = 0
        for s in range(len(equal)):
            for e in range(s + 4, len(equal) + 1):
                part = equal[s:e]
                if part[0] and part[-1] and 100 * part.sum() >= 80 * len(part):
                    best = max(best, e - s)
        assert D.best_stretch(equal, search, 30)[1] == best


def test_empty_sides(spark):
    assert D.overlaps(no_documents(spark), items(spark)).count() == 0
    assert D.overlaps(documents(spark), items(spark, [])).count() == 0


def test_masks_lose_no_overlap_that_the_comparison_accepts():
    search = D.DEFAULT_SEARCH
    # From 42 words on, a stretch holds a shorter one: of some two halves of at least 13 words,
    # cut between two equal words, one has the share.
    for n in range(search.overlap_words, 61):
        assert D.most_missed(search, n, False) > n * (100 - search.equal_percent) // 100


def test_recall_equals_brute_force():
    rng = random.Random(5)
    search = D.DEFAULT_SEARCH
    import numpy as np

    def hit(equal):
        return any(
            all(equal[at + k] for k, c in enumerate(mask) if c == "1")
            for mask in search.masks
            for at in range(len(equal) - len(mask) + 1)
        )

    tried = 0
    for n in range(8, 61):
        cases = [[k % 5 != shift for k in range(n)] for shift in range(5)]
        cases += [[k != place for k in range(n)] for place in range(n)]
        for _ in range(60):
            differ = set(rng.sample(range(n), n // 5))
            cases.append([k not in differ for k in range(n)])
        for equal in cases:
            if D.best_stretch(np.array(equal), search, n)[1]:
                tried += 1
                assert hit(equal)
    assert tried > 3000


def test_short_runs_and_replaced_words_are_found(spark):
    def other(text, *places):
        return " ".join("other" if k in places else w for k, w in enumerate(text.split()))

    text = {1: prose(61, 40), 3: prose(63, 16)}
    some = [" ".join(text[1].split()[7 : 7 + n]) for n in (13, 14, 15)]
    cases = [(some[0], 1), (some[1], 1), (some[2], 1)]
    cases += [(other(text[1], *range(shift, 40, 5)), 1) for shift in range(5)]
    cases += [(other(text[3], place), 3) for place in range(16)]
    rows = [(k, f"{prose(200 + k, 20)} {t} {prose(500 + k, 20)}") for k, (t, _) in enumerate(cases)]
    rows += [(1000 + k, t) for k, (t, _) in enumerate(cases)]
    # One word more than allowed.
    # One word fewer than an overlap has.
    rows += [(2002, " ".join(some[0].split()[:12]))]
    got = D.overlaps(documents(spark, rows), items(spark, list(text.items()))).collect()
    wanted = [(k + b, item) for k, (_, item) in enumerate(cases) for b in (0, 1000)]
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(wanted)


def test_short_runs_and_short_items_with_replaced_words_are_found(spark):
    def other(text, *places):
        return " ".join("other" if k in places else w for k, w in enumerate(text.split()))

    lengths = {1: 40, 2: 15, 3: 16, 4: 12, 5: 10, 6: 14, 7: 13}
    text = {k: prose(60 + k, n) for k, n in lengths.items()}
    cases = [(other(text[2], place), 2) for place in range(15)]
    cases += [(" ".join(text[2].split()[1:14]), 2), (other(text[2], 0, 7, 14), 2)]
    cases += [(other(text[4], place), 4) for place in range(12)]
    cases += [(other(text[4], 0, 6), 4), (other(text[5], 4, 9), 5), (other(text[6], 0, 13), 6)]
    cases += [(other(text[7], 0), 7), (" ".join(text[7].split()[:11]), 7)]
    rows = [(k, f"{prose(200 + k, 20)} {t} {prose(500 + k, 20)}") for k, (t, _) in enumerate(cases)]
    rows += [(1000 + k, t) for k, (t, _) in enumerate(cases)]
    # One word more than allowed.
    rows += [(2000, other(text[5], 1, 4, 7)), (2001, other(text[4], 1, 5, 9))]
    got = D.overlaps(documents(spark, rows), items(spark, list(text.items()))).collect()
    wanted = [(k + b, item) for k, (_, item) in enumerate(cases) for b in (0, 1000)]
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(wanted)
    whole = next(r for r in got if r.doc_id == 1000 + len(cases) - 2)
    assert (whole.start_word, whole.n_words, whole.n_equal, whole.item_words) == (1, 12, 12, 13)


def test_masks_lose_no_short_item_with_replaced_words():
    search = D.DEFAULT_SEARCH
    for n in range(search.whole_below, 16):
        assert D.most_missed(search, n, True) > n * (100 - search.percent(n)) // 100


def literal_overlap(document, item, search):
    """Whether the two overlap, by laying them side by side in every way."""
    import numpy as np

    a, b = D.words_of_text(document), D.words_of_text(item)
    for diagonal in range(-len(b) + 1, len(a)):
        ks = range(max(0, -diagonal), min(len(b), len(a) - diagonal))
        if D.best_stretch(np.array([b[k] == a[k + diagonal] for k in ks], dtype=bool), search, len(b))[1]:
            return True
    return False


def test_items_of_every_length_against_brute_force(spark):
    """Whole, and with so many words replaced, from one word to sixty."""
    rng = random.Random(12)
    search = D.DEFAULT_SEARCH
    rows, table = [], []
    for n in range(1, 61):
        item = prose(1000 + n, n).replace("\n", " ")
        table.append((n, item))
        for replaced_words in (0, 1, n // 5, n // 5 + 1):
            words = item.split()
            for at in rng.sample(range(n), min(replaced_words, n)):
                words[at] = f"other{at}"
            rows.append((len(rows), f"{prose(3000 + len(rows), 15)} {' '.join(words)} {prose(6000 + len(rows), 15)}"))
    got = {(r.doc_id, r.item_id) for r in D.overlaps(documents(spark, rows), items(spark, table)).collect()}
    expected = {(d, n) for d, text in rows for n, item in table if literal_overlap(text, item, search)}
    assert got == expected and len(expected) > 150


def test_an_item_that_stands_everywhere(spark):
    rows = [(k, "the " * 3000 + prose(k, 20)) for k in range(6)]
    got = D.overlaps(documents(spark, rows), items(spark, [(1, "the"), (2, "the the")])).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word) for r in got) == [(k, i, 0) for k in range(6) for i in (1, 2)]
