"""The reference's own job sizes, end to end on this engine (prints one JSON line).

* skew job: the 3.2e9-byte two-key input (400,179,505 lines) -> hot-key sums, plain and salted;
* bloat job: the 3.2e9-byte unique-key input (28,210,216 lines) -> x4 map output -> self-check,
  and the whole job: 112,840,864 records shuffled by key and sorted within partitions.

Inputs are generated with ``spark.range`` across partitions; nothing is written to disk
except shuffle files.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import functions as F

    from faultlens.operators import mapreduce as mr
    from faultlens.session import build_session
    from faultlens.sources import generate as gen

    spark = build_session(shuffle_partitions=16)
    out = {}
    lines = gen.skew_lines(spark)
    t0 = time.perf_counter()
    res = mr.key_sum(mr.skew_map(lines, keep=())).collect()
    out["skew_job_s"] = round(time.perf_counter() - t0, 1)
    out["skew_result"] = sorted((r.key, r.total) for r in res)
    t0 = time.perf_counter()
    mr.salted_key_sum(mr.skew_map(lines, keep=("line_id",)), salts=16, salt_source=F.col("line_id")).collect()
    out["skew_salted_s"] = round(time.perf_counter() - t0, 1)
    bloat = gen.bloat_lines(spark)
    t0 = time.perf_counter()
    chk = mr.bloat_check(bloat, mr.bloat_expand(bloat, copies=4, keep=())).first()
    out["bloat_check_s"] = round(time.perf_counter() - t0, 1)
    out["bloat"] = chk.asDict()
    # the full job: x4 records shuffled by key and sorted in each partition (reducer = cat)
    t0 = time.perf_counter()
    mr.identity_shuffle(mr.bloat_expand(bloat, copies=4, keep=("line_id",)), ["line_id", "copy"]).write.format("noop").mode("overwrite").save()
    out["bloat_shuffle_sort_s"] = round(time.perf_counter() - t0, 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
