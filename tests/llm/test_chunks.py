import numpy as np

from continuity.llm import chunks as C
from tests.llm.cases import documents, no_documents, prose

GEAR = C._gear()


def data(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def test_rolling_hash_and_cuts_equal_byte_by_byte():
    cuts = C.Cuts(most=64)
    for text in ["", "a", prose(1, 50), "aaaa" * 100, "漢字🙂é" * 60]:
        h, marks, start, want = 0, [], 0, []
        raw = text.encode()
        for k, b in enumerate(raw):
            h = (2 * h + int(GEAR[b])) & 0xFFFF
            whole = k + 1 == len(raw) or raw[k + 1] & 0xC0 != 0x80
            marks.append(h >> 11 == 0 and whole)
        for k in range(len(raw)):
            end = k + 1
            if end - start > cuts.most:
                forced = start + cuts.most
                while raw[forced] & 0xC0 == 0x80:
                    forced -= 1
                want.append(forced)
                start = forced
            if marks[k] and end - start >= cuts.least or end == len(raw):
                want.append(end)
                start = end
        got = C.cut_points(data(text), GEAR, cuts)
        assert "".join(raw[a:b].decode() for a, b in zip([0, *got], got, strict=False)) == text
        assert got == want, text[:20]


def test_an_insertion_moves_only_near_cuts():
    text = prose(2, 400)
    moved = text[:100] + "INSERTED" + text[100:]

    def pieces(t):
        ends = C.cut_points(data(t), GEAR)
        return {t[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    before, after = pieces(text), pieces(moved)
    assert len(before & after) > 0.9 * len(before)


def test_planted_passages_are_found_and_clean_texts_left(spark):
    shared = prose(3, 60)
    rows = [(k, prose(100 + k, 150)) for k in range(20)]
    rows += [(50, prose(50, 80) + "\n" + shared + "\n" + prose(51, 80)), (40, shared + "\n" + prose(40, 90))]
    rows += [(60, prose(60, 70) + "\n" + shared), (7, rows[7][1]), (70, rows[3][1]), (80, None), (81, "")]
    got = {r.doc_id: r for r in C.repeated_passages(documents(spark, rows)).collect()}
    assert set(got) == {50, 60, 70}
    assert got[50].source_ids == [40] and got[60].source_ids == [40] and got[70].source_ids == [3]
    whole = rows[20][1]
    found = whole[got[50].start : got[50].end]
    assert found in shared + "\n" + prose(51, 80) or shared in found or len(found) > 0.6 * len(shared)
    clean = {r.doc_id: r.text for r in C.without_repeats(documents(spark, rows)).collect()}
    assert clean[70] == "" and clean[3] == rows[3][1] and clean[80] is None
    assert clean[50] == whole[: got[50].start] + whole[got[50].end :]


def test_every_case_has_a_result(spark):
    df = documents(spark)
    assert C.without_repeats(df).count() == df.count()
    assert C.repeated_passages(no_documents(spark)).count() == 0


def literal_passages(rows, cuts=C.DEFAULT_CUTS):
    """Chunk by chunk: the first place of each, and runs of those that stood elsewhere before."""
    pieces = {}
    for key, text, h in rows:
        ends = C.cut_points(data(text), GEAR, cuts) if text else []
        raw, at, found = (text or "").encode(), 0, []
        for a, b in zip([0, *ends], ends, strict=False):
            chunk = raw[a:b].decode()
            before = raw[:a].decode()
            begun = sum(not c.isspace() and (k == 0 and (not before or before[-1] in " \t\n\v\f\r") or k > 0 and chunk[k - 1] in " \t\n\v\f\r") for k, c in enumerate(chunk))
            found.append((at, at + len(chunk), begun, chunk))
            at += len(chunk)
        pieces[(key is not None, key, h)] = found
    seen = {}
    for place, found in pieces.items():
        for start, _, _, chunk in found:
            seen.setdefault(chunk, []).append((*place, start))
    made = set()
    for place, found in pieces.items():
        run = []
        for start, end, n, chunk in [*found, (-1, -1, 0, None)]:
            first = min(seen[chunk]) if chunk is not None else None
            if chunk is not None and first != (*place, start):
                run.append((start, end, n, first[1]))
                continue
            if sum(r[2] for r in run) >= cuts.min_words:
                sources = sorted({r[3] for r in run if r[3] is not None})
                made.add((place[1], run[0][0], run[-1][1], sum(r[2] for r in run), len(run), tuple(sources)))
            run = []
    return made


def test_passages_equal_the_definition(spark):
    import random

    rng = random.Random(7)
    shared = [prose(k, rng.randint(30, 120)) for k in range(5)]
    rows = []
    for k in range(40):
        parts = [prose(300 + k, rng.randint(10, 60))]
        parts += [rng.choice(shared) for _ in range(rng.randint(0, 3))] + ["漢字 é " * rng.randint(0, 30)]
        rng.shuffle(parts)
        rows.append((k, "\n".join(parts)))
    rows += [(None, shared[0] + " x"), (41, ""), (42, None), (43, "same same " * 200), (44, "same same " * 200), rows[3]]
    df = documents(spark, rows)
    hashes = df.selectExpr("doc_id", "text", "xxhash64(text) AS h").distinct().collect()
    expected = literal_passages([(r.doc_id, r.text, r.h) for r in hashes if r.text is not None])
    got = {
        (r.doc_id, r.start, r.end, r.n_words, r.n_chunks, tuple(r.source_ids))
        for r in C.repeated_passages(df).collect()
    }
    assert got == expected and len(expected) > 20


def test_ids_of_any_type(spark):
    shared = prose(5, 90)
    rows = [("b", prose(1, 40) + " " + shared), ("a", shared), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert [(r.doc_id, r.source_ids) for r in C.repeated_passages(df).collect()] == [("b", ["a"])]
    assert C.without_repeats(df).count() == 3
