"""Golomb-coded sets and the order-wise question whether a key was seen."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from seqbucket.llm.seen import GolombSet, GrowingSet, build, error_rates, extended, seen_before


@given(st.sets(st.integers(0, (1 << 40) - 1), min_size=1, max_size=700))
def test_set_gives_its_values_back(values):
    v = np.array(sorted(values), np.uint64)
    held = GolombSet(v)
    assert (held.values() == v).all()
    back = GolombSet.unpacked(held.packed())
    assert (back.values() == v).all() and back.contains(v).all() and back.packed() == held.packed()


@pytest.mark.parametrize("n", [1, 127, 128, 129, 20_000])
def test_contains(n):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, 1 << 33, n, dtype=np.uint64))
    probes = np.unique(np.concatenate([v[::3], rng.integers(0, 1 << 33, 300, dtype=np.uint64)]))
    assert (GolombSet(v).contains(probes) == np.isin(probes, v)).all()


def test_a_key_takes_few_bits():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 33, 1 << 17, dtype=np.uint64))
    assert GolombSet(v).nbytes * 8 / len(v) < 20


def test_growing_set_stays_in_few_parts():
    rng, held, all_ = np.random.default_rng(2), GrowingSet(), set()
    for _ in range(40):
        v = np.unique(rng.integers(0, 1 << 20, 500, dtype=np.uint64))
        new = v[~held.contains(v)]
        assert set(new.tolist()) == set(v.tolist()) - all_
        held.add(new)
        all_ |= set(v.tolist())
    assert held.n == len(all_) and len(held.sets) < 12


def brute(records, known):
    first: dict = {}
    for i, k in records:
        first[k] = min(i, first.get(k, i))
    return sorted({(i,) for i, k in records if k in known or first[k] < i}, key=repr)


def data(seed=3):
    rnd = random.Random(seed)
    records = [(i, 7 if rnd.random() < 0.35 else rnd.randrange(3000)) for i in range(6000)]
    records += rnd.sample(records, 200)
    rnd.shuffle(records)
    return records, [rnd.randrange(3000) for _ in range(100)] * 2


@pytest.mark.parametrize("bits", [1, 30])
def test_against_brute_force(spark, rows, bits):
    records, known = data()
    df = spark.createDataFrame(records, "order_id long, key long").repartition(5)
    old = spark.createDataFrame([(k,) for k in known], "key long")
    size = dict(rows=len(records), capacity=512, bits=bits)
    got, want = rows(seen_before(df, build(old, **size), **size)), brute(records, set(known))
    assert set(want) <= set(got)  # a seen key is never taken for a new one
    rates = error_rates(df, old, **size).first()
    assert rates["asked"] == len({k for _, k in records} - set(known))
    assert rates["wrong"] == len(got) - len(want) and (rates["wrong"] > 0) == (bits == 1)
    assert rates["rate_audited"] <= 3 * rates["rate_in_theory"] + 0.01
    if bits == 30:
        assert rates["keys"] == len({k for _, k in records} | set(known))


def test_sets_are_carried_on(spark, rows):
    """Records in two deliveries: the second is asked against the sets after the first, and no key is read again."""
    records, known = data(5)
    size = dict(rows=len(records), capacity=512)
    df = spark.createDataFrame(records, "order_id long, key long")
    sets = build(spark.createDataFrame([(k,) for k in known], "key long"), **size)
    first, second = df.where("order_id < 2500"), df.where("order_id >= 2500")
    after = extended(sets, first, **size)
    got = rows(seen_before(first, sets, **size).unionByName(seen_before(second, after, **size)))
    assert got == brute(records, set(known))
    sizes = after.collect()
    assert sum(r["n"] for r in sizes) == len({k for i, k in records if i < 2500} | set(known))
    assert all(len(r["golomb"]) < 40 + 9 * r["n"] for r in sizes)


def test_no_key_and_no_window_in_a_probe(spark):
    records, known = data()
    sets = build(spark.createDataFrame([(k,) for k in known], "key long"), 6000)
    plan = seen_before(spark.createDataFrame(records, "order_id long, key long"), sets, 6000)._jdf.queryExecution().toString()
    assert "Window" not in plan and plan.count("Scan parquet") <= 2 and "golomb" in plan


def test_a_hot_key_sends_its_shard_a_row_a_batch():
    import pyarrow as pa

    from seqbucket.llm.seen import _within_batches

    rng = np.random.default_rng(1)
    hashed = np.where(rng.random(9000) < 0.4, 77, rng.integers(0, 1 << 62, 9000))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 1000)), pa.array(hashed[i : i + 1000])], names=["order_id", "hash"]) for i in range(0, 9000, 1000)]
    out = pa.Table.from_batches(list(_within_batches(iter(batches), 16, 45))).to_pandas()
    assert (out[out["hash"] == 77]["again"]).sum() == (hashed == 77).sum() - 9
    assert out.groupby("shard").size().max() < 9000 / 16 * 1.4


def test_empty(spark):
    df, old = spark.createDataFrame([], "order_id long, key long"), spark.createDataFrame([], "key long")
    assert seen_before(df, build(old, 0), 0).collect() == []
    assert error_rates(df, old, 0).first()["keys"] == 0


def test_nulls_and_clashing_columns(spark, rows):
    df = spark.createDataFrame([(1, 5, "x", 1), (2, 5, None, 2), (None, 5, "y", 3), (3, None, "z", 4)], "order_id long, key long, hash string, shard int")
    old = spark.createDataFrame([(None, 1), (9, 2)], "key long, order_id int")
    assert rows(seen_before(df, build(old, 4), 4)) == [(2,)]
