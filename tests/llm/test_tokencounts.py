import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from continuity.llm import codec, tokencounts
from tests.llm.cases import documents, no_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(spans, sections, rule):
    out = []
    for s, e in spans:
        shares = [max(0, min(e, b) - max(s, a)) for a, b in sections]
        if rule == "most":
            rest = e - s - sum(shares)
            best = max(range(len(sections)), key=lambda k: (shares[k], -k)) if sections else -1
            out.append(best if best >= 0 and shares[best] and shares[best] >= rest else -1)
        else:
            at = s if rule == "first" else e - 1
            out.append(next((k for k, (a, b) in enumerate(sections) if a <= at < b), -1))
    return out


def test_attribution_equals_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        cuts = sorted(rng.sample(range(60), rng.randint(0, 12)))
        sections = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if rng.random() < 0.7]
        if sections and rng.random() < 0.3:
            sections.insert(1, (sections[0][1], sections[0][1]))
        bounds = [0, *sorted(rng.sample(range(1, 60), 15)), 60]
        spans = list(zip(bounds, bounds[1:], strict=False))
        for rule in tokencounts.RULES:
            a, b = (np.array([s[k] for s in spans]) for k in (0, 1))
            c, d = (np.array([s[k] for s in sections], dtype=int) for k in (0, 1))
            owner, _ = tokencounts.attribute(a, b, c, d, rule)
            assert owner.tolist() == brute(spans, sections, rule), (spans, sections, rule)


def test_spans_are_those_of_the_library():
    library, own = Tokenizer.from_file(PATH), codec.load(PATH)
    for text in ["", "plain text here", "héllo 漢字 🙂🙂 x", "a\n\n b", "x<|endoftext|>é"]:
        starts, ends = tokencounts.token_spans(own, text)
        encoded = library.encode(text, add_special_tokens=False)
        # The library leaves the space before a word out of its span.
        for (a, b), s, e in zip(encoded.offsets, starts.tolist(), ends.tolist(), strict=True):
            assert b == e and (a == s or text[s:a].isspace()), text


def test_lines_add_up_to_the_text(spark):
    own = codec.load(PATH)
    df = documents(spark)
    counted = tokencounts.count_by_line(df, PATH, out="counted")
    rows = counted.select("text", "counted").collect()
    assert len(rows) == df.count()
    for r in rows:
        text = r.text or ""
        assert sum(r.counted.tokens) == len(own.encode(text))
        assert "".join(text[a:b] for a, b in zip(r.counted.starts, r.counted.ends, strict=True)) == text
    flat = tokencounts.line_rows(counted, "counted", ("doc_id",))
    assert flat.columns == ["doc_id", "line", "start_char", "end_char", "n_tokens", "n_crossing"]
    assert flat.count() == sum(len((r.text or "").split("\n")) for r in rows)
    assert tokencounts.count_by_line(no_documents(spark), PATH, out="counted").count() == 0
