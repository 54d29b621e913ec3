import tracemalloc

import numpy as np

from continuity.llm import bits as B

HASHES = "hash bigint"


def literal_map(hashes, log2_bits):
    made = np.zeros(1 << log2_bits, dtype=np.uint8)
    made[[h & ((1 << log2_bits) - 1) for h in hashes if h is not None]] = 1
    return np.packbits(made, bitorder="little")


def test_map_equals_bit_by_bit(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(2**63), 2**63 - 1, 3_000).tolist()
    hashes += [0, -1, 63, 64, 2**63 - 1, -(2**63), 2**24 - 1, *hashes[:5], None, None]
    df = spark.createDataFrame([(h,) for h in hashes], HASHES)
    for log2_bits in (6, 12, 19, 24, 25):
        got = B.bit_filter(df, "hash", log2_bits)
        assert got.dtype == np.uint8 and (got == literal_map(hashes, log2_bits)).all()
        assert B.passes(got, np.array([h for h in hashes if h is not None])).all()
    assert len(B.bit_filter(df, "hash")) == 1 << B.LEAST_LOG2_BITS - 3


def test_no_hashes_make_an_empty_map(spark):
    for rows in ([], [(None,)]):
        assert not B.bit_filter(spark.createDataFrame(rows, HASHES), "hash").any()


def test_driver_needs_no_more_than_a_few_maps(spark):
    df = spark.range(400_000).selectExpr("xxhash64(id) AS hash")
    B.bit_filter(df.limit(1), "hash", 24)
    tracemalloc.start()
    try:
        made = B.bit_filter(df, "hash", 24)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * made.nbytes, f"{peak} bytes for a map of {made.nbytes}"
    low = np.array([r.hash for r in df.limit(1_000).collect()])
    assert B.passes(made, low).all()
