import math
import struct

import duckdb

from lodeworks.catalogue import _round


def test_rounds_as_duckdb_does(spark):
    """Small negatives become -0, and ties are those of the product, to the bit."""
    values = [-3e-7, 3e-7, -0.0, 0.0, 1.0000005, -1.0000005, 0.1234565, 0.0000005, -0.0000025, 1e300, -1e305, 5e15 + 1, float("inf"), 0.49999949999999997]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*values, None])], "i int, x double")
    got = [r.y for r in df.select("i", _round("x").alias("y")).orderBy("i").collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in [*values, None]]
    bits = lambda x: None if x is None else struct.pack("<d", x)
    assert [bits(x) for x in got] == [bits(x) for x in want] and math.copysign(1, got[0]) == -1
