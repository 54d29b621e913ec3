import random

import public_tokenizers
from tokenizers import Tokenizer

from continuity.llm import bpe, codec
from tests.llm.cases import documents, no_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_texts_are_encoded_as_the_library_does(spark):
    library = Tokenizer.from_file(PATH)
    df = documents(spark)
    got = bpe.encode_texts(df, PATH, long_chars=300, leaf_chars=50).collect()
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.ids, r.decoded)) for r in got)
    assert bpe.encode_texts(no_documents(spark), PATH).count() == 0


def test_trees_of_any_leaf_give_the_ids_of_the_whole():
    library, own = Tokenizer.from_file(PATH), codec.load(PATH)
    rng = random.Random(3)
    alphabets = ["ab'srelvdm tT  \n\t12é漢🙂.,!　", "abcdehilnorst", "  \n\n\t", "1234567890'"]
    for k in range(400):
        text = "".join(rng.choice(alphabets[k % 4]) for _ in range(rng.randint(0, 200)))
        want = library.encode(text, add_special_tokens=False).ids
        for leaf in (1, 4, 30):
            parts = [bpe.encode_leaf(own, x) for x in bpe.leaves_of(text, leaf)]
            joined, _, ids = bpe.join_tree(own, parts)
            assert joined == text
            assert [i for each in ids for i in each] == want, (text, leaf)


def test_windows_stay_small_on_long_unsplit_text(monkeypatch):
    own = codec.load(PATH)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdehilnorst") for _ in range(20_000))
    parts = [bpe.encode_leaf(own, x) for x in bpe.leaves_of(text, 2_000)]
    seen = []
    plain = codec.Codec.encode_piece
    monkeypatch.setattr(codec.Codec, "encode_piece", lambda self, p: seen.append(len(p)) or plain(self, p))
    _, _, ids = bpe.join_tree(own, parts)
    assert [i for each in ids for i in each] == plain(own, text.encode())
    assert max(seen) < 500
