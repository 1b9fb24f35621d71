"""Publication lineage against a plain fold over each log, with chains of refused rows between accepted ones."""

import random

from pyspark.sql import functions as F

from beaconry.operators import generations as N
from beaconry.plans.common import written

LOG = "dataset string, generation_id string, base_generation_id string, state string, error_count long, created_us long, published_us long"
DAY = 86_400_000_000


def folded(rows):
    out = []
    for dataset in {r[0] for r in rows}:
        log = sorted((r for r in rows if r[0] == dataset), key=lambda r: (r[5], r[1]))
        current, at, made = None, None, []
        for n, (_, name, base, state, errors, _, published) in enumerate(log):
            ok = state == "ready" and errors == 0 and base == current and (at is None or (published is not None and published > at))
            made.append([dataset, n, name, current, ok, False])
            if ok:
                current, at = name, published
        last = max((m[1] for m in made if m[4]), default=None)
        out += [tuple(m[:5]) + (m[4] and m[1] == last,) for m in made]
    return sorted(out, key=str)


def history(rng, dataset, size):
    rows, current, last = [], None, None
    for k in range(size):
        at = k * DAY // 3 + rng.randrange(1000)
        honest = rng.random() < 0.6
        base = current if honest else rng.choice([None, "g0", f"g{max(0, k - 2)}", current])
        state, errors = rng.choice(["ready"] * 5 + ["failed"]), rng.choice([0] * 5 + [1])
        published = at + rng.choice([5, 5, 5, -2 * DAY])
        published = None if rng.random() < 0.03 else published
        rows.append((dataset, f"g{k}", base, state, errors, at, published))
        if state == "ready" and errors == 0 and base == current and (last is None or published is not None and published > last):
            current, last = f"g{k}", published
    return rows


def test_links_equal_the_fold(spark):
    rng = random.Random(8)
    rows = [row for d in range(12) for row in history(rng, f"d{d}", rng.randint(1, 60))] + history(rng, None, 20)
    rows += [("none", "g0", "gone", "ready", 0, 5, 6), ("one", "g0", None, "ready", 0, 5, 6)]
    got = N.publication_lineage(spark.createDataFrame(rows, LOG).repartition(3), written)
    cols = ["dataset", "log_no", "generation_id", "previous", "accepted", "current"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == folded(rows)
    assert got.filter("accepted").count() > 60


def test_long_chain_and_empty_log(spark):
    chain = spark.range(300).select(F.lit("d").alias("dataset"), F.concat(F.lit("g"), "id").alias("generation_id"), F.when(F.col("id") > 0, F.concat(F.lit("g"), F.col("id") - 1)).alias("base_generation_id"),
                                    F.lit("ready").alias("state"), F.lit(0).cast("long").alias("error_count"), (F.col("id") * 7_000_000_000).alias("created_us"), F.col("id").alias("published_us"))
    got = N.publication_lineage(chain, written).collect()
    assert len(got) == 300 and all(r.accepted for r in got) and [r.log_no for r in got if r.current] == [299]
    assert all(r.previous == (f"g{r.log_no - 1}" if r.log_no else None) for r in got)
    assert N.publication_lineage(chain.limit(0), written).collect() == []
