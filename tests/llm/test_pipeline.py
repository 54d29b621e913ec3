import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from continuity.llm import decontaminate, pii
from tests.llm.cases import documents, no_documents, prose
from tests.llm.test_simhash import components, fingerprint

BENCHMARK = [(1, prose(31, 40)), (2, None)]


def rows():
    made = [(r.doc_id, r.text) for r in ()]
    made += [(k, prose(300 + k, 90)) for k in range(10)]
    made += [
        (20, made[3][1]), (21, made[4][1]), (3, made[3][1]),
        (30, prose(400, 60) + "\n" + BENCHMARK[0][1]),
        (31, prose(401, 70) + "\nwrite to jane.doe@mail.example.com or 10.1.2.3 today."),
        (32, prose(402, 70) + "\nhome | about | news | contact"),
        (33, "same same same same " * 40), (34, None), (35, ""), (None, prose(403, 80)),
    ]
    return made


def expected(made):
    """Each stage again, one row at a time."""
    docs = []
    for i, text in made:
        if text and len(set(text.split())) > 20:
            docs.append((i, text.replace("\nhome | about | news | contact", "")))
    label = components([fingerprint(t) for _, t in docs], 2)
    groups = {}
    for (i, t), c in zip(docs, label, strict=True):
        groups.setdefault(c, []).append((i is None, i or 0, t))
    docs = [(None if none else i, t) for none, i, t in (min(g) for g in groups.values())]
    item = b" ".join(decontaminate.words_of_text(BENCHMARK[0][1]))
    docs = [(i, t) for i, t in docs if item not in b" ".join(decontaminate.words_of_text(t))]
    cleaned = []
    for i, text in docs:
        for kind, start, end in sorted(pii.base_spans(text), key=lambda s: -s[1]):
            text = text[:start] + pii.LABELS[kind] + text[end:]
        cleaned.append((i, text))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return sorted(str((i, library.encode(t, add_special_tokens=False).ids)) for i, t in cleaned)


def write(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_equals_brute_force(spark, tmp_path):
    made = rows()
    got = corpus_pipeline.run(spark, write(spark, tmp_path / "a", documents(spark, made)))
    assert sorted(str((r.doc_id, r.ids)) for r in got.collect()) == expected(made)


def test_stages_keep_the_columns_and_take_every_case(spark, tmp_path):
    folder = write(spark, tmp_path / "b", documents(spark))
    for docs in (documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.dtypes == docs.dtypes
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
    lengths = corpus_pipeline.pii_removal(spark, documents(spark), folder)
    assert lengths.filter("n_chars <> char_length(text)").count() == 0
