"""Sharding and mixing: laws, and the same draws in plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logsift.llm import mixing, sharding


def uniform(*parts):
    return int(hashlib.sha256(":".join(parts).encode()).hexdigest()[:13], 16) / 2**52


def brute_shard(key, places):
    path = ""
    for level in ("region", "rack", "shard"):
        weights, names = Counter(), {}
        for p in places:
            at = f"/region{p.region}" + (f"/rack{p.rack}" if level != "region" else "") + (f"/shard{p.shard}" if level == "shard" else "")
            if at.rpartition("/")[0] == path:
                weights[at] += p.weight
                names[at] = p.shard
        path = min(weights, key=lambda n: (-math.log(1 - uniform(n, key)) / weights[n], n))
    return names[path]


def test_shards(docs_of):
    rows = [(i, f"text {i % 50}" * (i % 7)) for i in range(2000)] + [(None, None), (5, "again"), (5, "again")]
    rows += [(10**6, "é" * 200_000)] + [(77, "hot")] * 900
    got = sharding.assign(docs_of(rows, "1 AS shard,2 AS size,3 AS bucket")).collect()
    assert len(got) == len(rows)
    eight, nine = sharding.topology(8), sharding.topology(9)
    want = {i: (brute_shard("" if i is None else str(i), eight), brute_shard("" if i is None else str(i), nine)) for i in {r[0] for r in rows}}
    for r in got:
        assert (r.shard, r.grown_shard) == want[r.doc_id]
        assert r.grown_shard in (r.shard, 8)
    plain = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == plain
    for shard, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    ids = {i for i in range(2000)}
    for shard, n in Counter(want[i][0] for i in ids).items():
        assert 170 < n < 330


def test_only_changed_subtrees_move(docs_of):
    table = docs_of([(i, "t") for i in range(4000)])
    before = sharding.topology(8)
    after = [sharding.Place(p.region, p.rack, p.shard, 3.0 if p.shard == 7 else 1.0) for p in before]
    moved = table.select(
        sharding.shard_of(F.col("doc_id"), before).alias("a"), sharding.shard_of(F.col("doc_id"), after).alias("b")
    ).filter("a <> b")
    # Region 1 holds shard 7: nothing moves within region 0, nor within rack 0 of region 1.
    region, rack = {p.shard: p.region for p in before}, {p.shard: p.rack for p in before}
    rows = moved.collect()
    assert rows and all(region[r.b] == 1 for r in rows)
    assert not [r for r in rows if region[r.a] == 1 and rack[r.a] == rack[r.b] == 0]


def test_every_growth_takes_rows_only_into_the_new_shard(docs_of):
    table = docs_of([(i, "t") for i in range(1500)])
    for n in (8, 9, 10):
        old, new = (sharding.shard_of(F.col("doc_id"), sharding.topology(k)) for k in (n, n + 1))
        assert {r[0] for r in table.filter(old != new).select(new).collect()} == {n}


def test_shards_empty(docs_of):
    assert sharding.assign(docs_of([])).collect() == []


def brute_copies(doc_id, rate):
    u, total, k = uniform(mixing.SEED, "" if doc_id is None else str(doc_id)), 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
        if u < total or k > rate + 12 * math.sqrt(rate) + 30:
            return k
        k += 1


def mix_rows():
    rows = [(i, "x" * (i % 40), "hot") for i in range(600)] + [(1000 + i, "yy", f"s{i % 9}") for i in range(300)]
    return rows + [(None, "null id", "s1"), (5000, None, "s2"), (5001, "null source", None), (5002, "é" * 200_000, "long"), (5003, "", "")]


@pytest.mark.parametrize("small", [True, False])
def test_mix(docs_of, monkeypatch, small):
    if not small:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    rows = mix_rows()
    weights = {"hot": 1.0, "s1": 2.0, None: 3.0, "long": 0.5, "": 1.0, "s2": 0.0}
    size = Counter()
    for i, t, s in rows:
        size[s] += len((t or "").encode()) + 1
    rate = {s: sum(size.values()) * weights.get(s, 0.0) / 7.5 / size[s] for s in size}
    got = mixing.mix(docs_of(rows, "1 AS copies,2 AS rate,3 AS steps"), weights).collect()
    want = Counter()
    for i, t, s in rows:
        want[i, t, s] += brute_copies(i, rate[s])
    assert Counter((r.doc_id, r.text, r.source) for r in got) == +want
    assert all(abs(r.rate - rate[r.source]) < 1e-9 * r.rate for r in got)
    for r in got:
        assert 0 <= r.copy_no < r.copies


def test_mix_meets_the_targets(docs_of):
    rows = [(i, "x" * 20, "a") for i in range(3000)] + [(10_000 + i, "x" * 20, "b") for i in range(300)]
    share = Counter(r.source for r in mixing.mix(docs_of(rows), {"a": 1, "b": 1}).collect())
    assert 1450 < share["a"] < 1850 and 1450 < share["b"] < 1850


def test_mix_empty(docs_of):
    assert mixing.mix(docs_of([])).collect() == []


@pytest.mark.parametrize("shards", [1, 4, 7, 8, 11])
def test_one_more_shard_takes_rows_only_into_itself(docs_of, shards):
    got = sharding.assign(docs_of([(i, f"t{i % 9}") for i in range(1500)] + [(3, f"own {i}") for i in range(400)]), shards)
    rows = got.collect()
    assert {r.shard for r in rows} == set(range(shards))
    assert all(r.grown_shard in (r.shard, shards) for r in rows) and any(r.grown_shard == shards for r in rows)
    for shard in range(shards):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    again = {r.doc_id: r.shard for r in sharding.assign(docs_of([(i, "t") for i in range(1500)]), shards + 1, base=min(shards, 8)).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in rows)


def test_portions_by_bytes():
    import pyarrow as pa

    from logsift.llm.tables import portions

    texts = ["x" * 30, None, "y" * 100, "", "é" * 10, "z" * 90, "w"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], names=["text", "i"])
    got = [b.column("text").to_pylist() for b in portions(iter([batch, batch.slice(0, 0), batch.slice(4)]), 3, 100)]
    assert got == [["x" * 30, None], ["y" * 100, ""], ["é" * 10], ["z" * 90, "w"], ["é" * 10], ["z" * 90, "w"]]
