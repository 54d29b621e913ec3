import numpy as np
import xxhash

from continuity.llm import simhash
from continuity.llm.components import component_labels
from tests.llm.cases import documents, no_documents, prose


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words[k : k + 3] for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    """Component of each position, by comparing everything."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def test_rows_equal_brute_force(spark):
    base = prose(20, 300)
    rows = [(100 + k, base.replace("1", str(k % 3), k)) for k in range(12)]
    df = documents(spark).unionByName(documents(spark, rows))
    source = [(r.doc_id, r.text) for r in df.collect()]
    prints = [fingerprint(t) for _, t in source]
    label = components(prints, 2)
    ids = {}
    for (i, _), c in zip(source, label, strict=True):
        if i is not None:
            ids[c] = min(ids.get(c, i), i)
    want = sorted(
        (str(i), f"{p:016x}", ids.get(c)) for (i, _), p, c in zip(source, prints, label, strict=True)
    )
    got = [(str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_all_close_pairs_are_found_whatever_the_tile():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40, dtype=np.int64)
    flips = [0, 1, 1 << 63, 3, (1 << 40) | 1, 7 << 20, (1 << 63) | (1 << 5)]
    prints = np.unique(np.array([int(s) ^ f for s in seeds.tolist() for f in flips], dtype=np.uint64))
    want = {
        (i, j)
        for i in range(len(prints))
        for j in range(i + 1, len(prints))
        if int(prints[i] ^ prints[j]).bit_count() <= 2
    }
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64))], names=["fp"])
    sent = next(simhash._tile_rows(iter([batch]), 2))
    tile, fp = (sent.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(tile, kind="stable")
    place = {int(p): k for k, p in enumerate(prints.view(np.int64))}
    found = set()
    for i, j in simhash.close_pairs(tile[order], fp[order], 2):
        for a, b in zip(fp[order][i].tolist(), fp[order][j].tolist(), strict=True):
            found.add(tuple(sorted((place[a], place[b]))))
    assert found == want


def test_large_tiles_are_compared_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    monkeypatch.setattr(simhash, "_SHIFTS", 3)
    fps = np.arange(50, dtype=np.int64)
    keys = np.zeros(50, np.int64)
    got = {(a, b) for i, j in simhash.close_pairs(keys, fps, 1) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(a, b) for a in range(50) for b in range(a + 1, 50) if (a ^ b).bit_count() <= 1}


def test_tiles_are_dealt_into_blocks_and_compared_as_they_come(spark):
    rng = np.random.default_rng(9)
    # Many fingerprints with the same counts in every byte, some a bit apart, some two.
    base = np.array([int("".join(f"{1 << int(b):08b}" for b in rng.integers(0, 8, 8)), 2) for _ in range(300)], dtype=np.uint64)
    flipped = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    prints = np.unique(np.concatenate([base, flipped])).tolist()
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp bigint")
    label = components(prints, 2)
    want = {frozenset(p for p, c in zip(prints, label, strict=True) if c == one) for one in set(label)}
    signed = lambda p: int(np.uint64(p).astype(np.int64))
    for tile_rows in (7, 1 << 17):
        large = simhash._large_tiles(df, 2, tile_rows)
        assert (large.count() > 1) == (tile_rows == 7)
        got = {r.node: r.label for r in component_labels(simhash.links(df, radius=2, tile_rows=tile_rows)).collect()}
        found = {}
        for p in prints:
            found.setdefault(got.get(signed(p), signed(p)), set()).add(p)
        assert {frozenset(v) for v in found.values()} == want
    sent = df.mapInArrow(lambda it: simhash._tile_rows(it, 2), "tile bigint, fp bigint")
    dealt = simhash._dealt(sent, simhash._large_tiles(df, 2, 7)).toPandas()
    dealt["pair"] = dealt.part // (1 << simhash._BITS)
    assert dealt.groupby(["tile", "pair"]).size().max() < 60 < sent.groupBy("tile").count().agg({"count": "max"}).first()[0]


def test_forests_do_not_depend_on_batches():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 4096, 900))
    tile = np.sort(rng.integers(0, 6, len(fp)))
    zero = np.zeros(len(fp), np.int64)

    def forest(size, at_once):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in (tile, zero, fp)], names=["tile", "part", "fp"])
            for k in range(0, len(fp), size)
        ]
        out = list(simhash._forest(iter(batches), 2, at_once))
        pairs = {(a, b) for o in out for a, b in zip(o.column(0).to_pylist(), o.column(1).to_pylist(), strict=True)}
        return len(out), {frozenset(g) for g in _groups(pairs)}

    chunks, many = forest(13, 50)
    one, whole = forest(10_000, 1 << 20)
    assert (one, chunks > 2) == (1, True) and many == whole and whole
    assert list(simhash._forest(iter([]), 2)) == []


def _groups(pairs):
    groups = []
    for a, b in pairs:
        near = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in near] + [{a, b}.union(*near)]
    return groups


def test_one_row_of_each_component_stays(spark):
    df = documents(spark)
    stays = simhash.one_per_component(df)
    assert stays.columns == df.columns
    found = simhash._labelled(df, "doc_id", "text", 3, 2, ())
    assert stays.count() == found.select("label").distinct().count()
    kept = [r.doc_id for r in stays.collect()]
    assert 6 in kept and 7 not in kept and kept.count(6) == 1
    assert simhash.one_per_component(no_documents(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(200, k) for k in range(201, 300)]
    edges = spark.createDataFrame(chain + star + [(500, 500)], "a bigint, b bigint")
    got = {r.node: r.label for r in component_labels(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 200 for k in range(200, 300)}}
