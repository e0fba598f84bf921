import base64
import random
import time

from pyspark.sql import functions as F

from gradelake.operators import integrity as I


def test_long_vectors_cost_their_length(spark):
    """Two vectors of 1.6 million bits, whose steps must not each go through a whole vector, and the bits of a shorter one."""
    n, r = 1_600_005, random.Random(5)
    one, two = (r.getrandbits(n).to_bytes(-(-n // 8), "little") for _ in range(2))
    df = spark.createDataFrame([tuple(base64.b64encode(x).decode() for x in (one, two))], "a string, b string")
    began = time.time()
    got = df.select(I.bit_sums(I.checked_bits(F.col("a"), F.lit(n)), I.checked_bits(F.col("b"), F.lit(n))).alias("s")).first().s
    assert time.time() - began < 30
    x, y = (int.from_bytes(v, "little") for v in (one, two))
    assert (got.one, got.two, got.differ) == (x.bit_count(), y.bit_count(), (x ^ y).bit_count())
    sizes = [0, 1, 8, 4_095, 4_096, 4_097, 9_001]
    rows = [(k, m, base64.b64encode((x & ((1 << m) - 1)).to_bytes(-(-m // 8), "little")).decode()) for k, m in enumerate(sizes)]
    bits = I.unpack_bits(spark.createDataFrame(rows, "k int, rows int, bits string"), ["k"], "bits", F.col("rows"))
    assert sorted(map(tuple, bits.collect())) == [(k, p, x >> p & 1) for k, m in enumerate(sizes) for p in range(m)]
