import hashlib
from collections import Counter

import pytest

from continuity.llm import sharding
from tests.llm.cases import documents, no_documents

NAMES = [f"s{k}" for k in range(7)]


def brute(names, size):
    """Every shard's whole order of preference is written down, then turns are taken."""
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    orders = []
    for name in names:
        start, step = h(f"{name}:start") % size, h(f"{name}:step") % (size - 1) + 1
        orders.append([(start + k * step) % size for k in range(size)])
    owner = {}
    while len(owner) < size:
        for shard, order in enumerate(orders):
            free = next((s for s in order if s not in owner), None)
            if free is not None:
                owner[free] = shard
    return [owner[s] for s in range(size)]


def test_table_equals_brute_force_and_is_even():
    table = sharding.lookup_table(NAMES, 211)
    assert table == brute(NAMES, 211)
    sizes = Counter(table).values()
    assert max(sizes) - min(sizes) <= 1


def test_most_slots_stay_when_a_shard_leaves():
    before = sharding.lookup_table(NAMES, 1009)
    after = sharding.lookup_table(NAMES[:-1], 1009)
    kept = sum(a == b for a, b in zip(before, after, strict=True) if a != 6)
    assert kept > 0.8 * sum(a != 6 for a in before)


def test_rows_are_placed_by_key(spark):
    df = documents(spark).drop("slot", "shard")
    placed = sharding.place(df, "doc_id", NAMES, 211)
    table = sharding.lookup_table(NAMES, 211)
    rows = placed.collect()
    assert len(rows) == df.count()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 211
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.place(no_documents(spark).drop("slot", "shard"), "doc_id", NAMES).count() == 0
    plan = sharding.place(spark.range(9), "id", NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan and "ExistingRDD" not in plan
    with pytest.raises(ValueError):
        sharding.place(documents(spark), "doc_id", NAMES)
    with pytest.raises(ValueError):
        sharding.lookup_table(NAMES, 210)


def test_shards_are_written_apart(spark, tmp_path):
    df = documents(spark)
    sharding.write_shards(df, str(tmp_path / "out"), "doc_id", NAMES, files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()
