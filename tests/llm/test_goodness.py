from __future__ import annotations

import random
import zlib

import numpy as np

from continuity.llm import goodness
from continuity.llm.queries import op13_quality_classifier, read
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.01"


def samples(seed: int, n: int = 120):
    """Prose against shouted and repeated words."""
    rng = random.Random(seed)
    good = [cases.prose(seed * 1000 + k, rng.randint(20, 150)) for k in range(n)]
    bad = []
    for k in range(n):
        words = cases.prose(seed * 1000 + k, 40).split()
        bad.append(" !! ".join(words).upper() if k % 2 else " ".join(w for w in words[:9] for _ in range(12)))
    return good, bad


def test_scores_tell_texts_apart():
    good, bad = samples(1)
    model = goodness.fit_texts(good, bad, (120, 120))
    more_good, more_bad = samples(2)
    right = np.r_[model.scores(more_good) >= 0.5, model.scores(more_bad) < 0.5]
    assert right.mean() > 0.97
    scores = model.scores([None, "", "x", "漢字🙂" * 30_000, more_good[0]])
    assert scores[0] == scores[1] and ((scores >= 0) & (scores <= 1)).all()


def test_sizes_are_those_of_each_block():
    """The difference against compressing block by block by hand."""
    import zstandard

    good, bad = samples(3)
    model = goodness.fit_texts(good, bad, (1, 1), goodness.FitRules(block=100))
    text = cases.prose(4, 300) + " ünï"
    sizes = []
    for raw in (model.good, model.bad):
        compressor = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(raw),
            write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        data = text.encode()
        sizes.append(sum(len(compressor.compress(data[k : k + 100])) for k in range(0, len(data), 100)))
    off, share = model._measured([text])[0]
    assert off == (sizes[1] - sizes[0]) / sum(sizes)
    assert share == np.log(sum(sizes) / 2 / len(data))


def test_too_few_labels_give_their_share():
    model = goodness.fit_texts(["a"], [], (3, 1))
    assert model.scores(["x", None]).tolist() == [0.75, 0.75]
    assert goodness.fit_texts([], [], (0, 0)).scores([None]).tolist() == [0.5]


def test_sample_is_bounded_and_defined(spark):
    good, bad = samples(5, 60)
    rows = list(enumerate(good + bad)) + [(0, good[0]), (None, "no id"), (500, None), (501, "x" * 20_000)]
    docs = cases.documents(spark, rows)
    labels = [(k, int(k < 60), "clash") for k in range(120)]
    labels += [(None, 1, "c"), (500, 0, "c"), (501, 0, "c"), (3, 1, "c"), (4, 0, "c"), (5, 7, "c"), (6, None, "c")]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, text string")
    rules = goodness.FitRules(rows_per_class=40)
    model = goodness.fit(docs, table, rules=rules)
    # By hand: ids whose labels agree, by the hash of the id, one text each.
    place = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    kinds: dict[int, set[int]] = {}
    for k, q, _ in labels:
        if k is not None and q in (0, 1):
            kinds.setdefault(k, set()).add(q)
    agreed = {k: min(q) for k, q in kinds.items() if len(q) == 1}
    texts = {k: t for k, t in rows if t and len(t) <= 10_000}
    picked = {
        kind: [texts[k] for k in sorted(agreed, key=lambda k: place[k]) if agreed[k] == kind and k in texts][:40]
        for kind in (0, 1)
    }
    totals = sum(q == 1 for q in agreed.values()), sum(q == 0 for q in agreed.values())
    assert model == goodness.fit_texts(picked[1], picked[0], totals, rules)
    got = {(r.doc_id, r.text): r.s for r in docs.select("doc_id", "text", model.score().alias("s")).collect()}
    assert len(got) == len(set(rows)) and got[(500, None)] == model.scores([None])[0]


def test_labels_of_the_held_out_part_do_not_matter(spark, tmp_path):
    rows = list(enumerate(samples(6, 80)[0] + samples(6, 80)[1]))
    out = {}
    for turn in ("as is", "turned"):
        folder = tmp_path / turn
        cases.documents(spark, rows).write.parquet(str(folder / "documents.parquet"))
        labels = [
            (k, int((k < 80) != (turn == "turned" and zlib.crc32(str(k).encode()) % 3 == 1)), 0)
            for k, _ in rows
        ]
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
            str(folder / "labels.parquet")
        )
        out[turn] = sorted(op13_quality_classifier(spark, str(folder)).collect())
    assert out["as is"] == out["turned"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out["as is"])


def test_held_out_accuracy(spark):
    scored = {r.doc_id: r for r in op13_quality_classifier(spark, SF_DIR).collect()}
    assert len(scored) == read(spark, SF_DIR, "documents").count()
    held = [
        (scored[r.doc_id], r.quality)
        for r in read(spark, SF_DIR, "labels").collect()
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1
    ]
    assert all(r.held_out and r.predicted == int(r.score >= 0.5) for r, _ in held)
    assert sum(r.predicted == quality for r, quality in held) / len(held) > 0.93


def test_query_on_cases_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(k, k % 2, "c") for k in range(16)], "doc_id bigint, quality int, score string")
    for name, docs in (("some", cases.documents(spark)), ("none", cases.no_documents(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        made = op13_quality_classifier(spark, str(tmp_path / name)).collect()
        assert len(made) == docs.count() and all(0 <= r.score <= 1 for r in made)
        assert all(not r.held_out for r in made if r.doc_id is None)
    labels.limit(0).write.mode("overwrite").parquet(str(tmp_path / "some" / "labels.parquet"))
    assert {r.score for r in op13_quality_classifier(spark, str(tmp_path / "some")).collect()} == {0.5}
