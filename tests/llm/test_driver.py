"""What the training-data operators ask of the driver."""

import hashlib
import tracemalloc

import numpy as np

from notelode.llm import neardup, secrets


def test_labelled_findings_draw_each_part_once(spark):
    """Their plan names digests and draws instead of repeating them in every form; the findings are the same as ever."""
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        found = secrets.labelled_findings(spark)
        query = found._jdf.queryExecution()
        plans = [query.analyzed().toString(), query.optimizedPlan().toString()]
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    for plan in plans:
        print(len(plan), plan.count("sha2("), plan.count("xxhash64("))
        assert plan.count("sha2(") <= 2 * 20  # for each label
        assert plan.count("xxhash64(") <= 2 * 60
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == secrets.TRAIN_ROWS
    assert hashlib.sha256(repr(rows).encode()).hexdigest() == "c205205f6e18d07352fa805f7c525532c0f6ad144b35c049a8f3ce1d41128d8c"


def test_bins_reach_the_driver_without_a_row_each(spark):
    """Counts of a hundred thousand bins and more take the driver's Python a few bytes each, and are those of a plain loop."""
    texts = [" ".join(f"w{k}-{i}" for i in range(2000)) for k in range(100)] + ["one two three four five"] * 3 + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    neardup.workers_find_package(spark)
    tracemalloc.start()
    try:
        counts, n = neardup.frequencies(docs, neardup.BUCKETS)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = np.zeros(neardup.BUCKETS, np.int64)
    for t in texts:
        want[np.unique(neardup.shingles([t])[0] % np.uint64(neardup.BUCKETS)).astype(np.int64)] += 1
    print(peak, np.count_nonzero(counts))
    assert n == len(texts) and (counts == want).all() and np.count_nonzero(counts) > 100_000
    assert peak < 15e6
    empty, none = neardup.frequencies(docs.where("false"), neardup.BUCKETS)
    assert none == 0 and not empty.any()
