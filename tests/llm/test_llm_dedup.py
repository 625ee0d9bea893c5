"""Exact and near duplicates against brute force."""

import json
import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from logsift.llm import components, exact_dedup, simhash


def exact_rows():
    rows = [(i, "hot text") for i in range(400)] + [(1000 + i, f"own {i}") for i in range(300)]
    rows += [(2000 + i, f"pair {i // 2}") for i in range(100)]
    rows += [(3000, None), (3001, ""), (3002, None), (None, "hot text"), (None, "null id"), (None, "null id")]
    rows += [(3003, "repeat"), (3003, "repeat"), (399, "hot text"), (3004, "x" * 300_000), (3005, "x" * 300_000)]
    rows += [(3006, "Case"), (3007, "case"), (3008, "case ")] + [(5000, "one row repeated")] * 300
    return rows


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids)) for i in ids]
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("counters", [2, 4096])
def test_exact(spark, docs_of, counters):
    rows = exact_rows()
    got = exact_dedup.label_copies(docs_of(rows, "1 AS keep_id,2 AS rows,3 AS digest"), counters).collect()
    want, groups = brute_exact(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.drop_copies(docs_of(rows, "1 AS keep_id,2 AS rows,3 AS digest"), counters)
    assert left.columns[-3:] == ["keep_id", "rows", "digest"]
    assert sorted([(r.doc_id, r.text or "") for r in left.collect()], key=repr) == sorted(
        [(i, t) for t in {t or "" for _, t in rows} for i in [max((x for x, u in rows if (u or "") == t and x is not None), default=None)]],
        key=repr,
    )


def test_exact_empty(docs_of):
    assert exact_dedup.label_copies(docs_of([])).collect() == []
    assert exact_dedup.drop_copies(docs_of([])).collect() == []


def test_misra_gries_finds_the_frequent():
    rng = random.Random(1)
    digests = [b"hot"] * 400 + [b"warm"] * 200 + [rng.randbytes(4) for _ in range(600)]
    rng.shuffle(digests)
    batches = [pa.RecordBatch.from_arrays([pa.array(digests[i : i + 50])], names=["digest"]) for i in range(0, 1200, 50)]
    out = {r["digest"]: r["at_least"] for b in exact_dedup._summary(10)(iter(batches)) for r in b.to_pylist()}
    assert len(out) <= 10
    assert 400 - 1200 / 11 <= out[b"hot"] <= 400 and 200 - 1200 / 11 <= out[b"warm"] <= 200


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, near):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and near(fps[a], fps[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(300)]
    texts = {}
    for g in range(12):
        base = [rng.choice(words) for _ in range(200)]
        for v in range(6):
            copy = list(base)
            for _ in range(v):
                copy[rng.randrange(200)] = rng.choice(words)
            texts[g * 10 + v] = " ".join(copy)
    texts |= {500: None, 501: "", 502: " \t", 503: "One Two", 504: "one\x0btwo", 505: "one", 506: "ONE two three", 507: "é É"}
    texts |= {600 + i: texts[0].upper() for i in range(50)}
    return texts


def test_near_groups(docs_of):
    texts = near_texts()
    got = simhash.near_groups(docs_of(list(texts.items()), "1 AS fp,2 AS component_id")).collect()
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    left = simhash.drop_near_copies(docs_of(list(texts.items()), "1 AS fp,2 AS key,3 AS mark"))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_near_odd_tables(docs_of):
    assert simhash.near_groups(docs_of([])).collect() == []
    assert simhash.drop_near_copies(docs_of([])).collect() == []
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "q r s t"), (3, "q r s t"), (3, "zz yy xx ww vv uu")]
    got = simhash.near_groups(docs_of(rows)).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.doc_id is None} == {None}
    assert len(simhash.drop_near_copies(docs_of(rows)).collect()) == 3


def test_long_text_bits():
    text = " ".join(str(i % 700) for i in range(30_000))
    assert int(simhash.fingerprints_of([text])[0]) == brute_fingerprint(text)


def test_links_find_all_pairs(spark):
    """Fingerprints around a few centres: every pair at most 2 bits apart is linked."""
    rng = random.Random(9)
    fps = set()
    for centre in [0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(12))]:
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    sizes = [r[0] for r in table.select(F.size(simhash.anchors(F.col("fp")))).collect()]
    assert set(sizes) <= {2, 33}
    got = {tuple(r) for r in simhash.links(table).collect()}
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    assert got == {(a, b) for a in signed for b in signed if a < b and near(a, b)}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1200)]
    pairs += [(7, 7), (2000, 5), (5, 2000)]
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    linked = {frozenset(p) for p in pairs}
    want = brute_components({n: n for n in nodes}, lambda a, b: frozenset((a, b)) in linked)
    got = components.components(spark.createDataFrame(pairs, "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def shingle_set(text, words=5):
    """Runs of words, all words if there are fewer; only A-Z lower-cased."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited(rng, words, changes):
    copy = list(words)
    for _ in range(changes):
        copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
    return copy


def test_similar_against_brute_jaccard(docs_of):
    """The pipeline's near-dedup: every pair of Jaccard 0.8 or more by five words, and no other."""
    rng = random.Random(5)
    texts = {}
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 9, 60, 200]))]
        for _ in range(4):
            texts[len(texts)] = " ".join(edited(rng, words, rng.randrange(1 + len(words) // 25)))
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = brute_components(sets, similar)
    assert 12 < len(set(want.values())) < len(texts)
    docs = docs_of(list(texts.items()), "1 AS sid,2 AS key,3 AS mark,4 AS doc")
    got = corpus_pipeline.near(docs.sparkSession, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))
    left = simhash.drop_similar(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))
    assert simhash.drop_similar(docs_of([])).collect() == []
    rows = [(None, "a b c d"), (None, "a b c d"), (3, ""), (4, None), (5, "A b  c d")] + [(9, "one two three four five six")] * 40
    assert sorted(map(str, (r.doc_id for r in simhash.drop_similar(docs_of(rows)).collect()))) == ["3", "5", "9"]


def test_similar_recall_and_a_large_group(docs_of):
    """300 pairs near Jaccard 0.8 to 0.85, a group of 250 edited copies, a passage that 150 texts share."""
    rng = random.Random(11)
    new = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    texts, pairs = [], []
    for _ in range(300):
        base = new(rng.choice([60, 120, 300]))
        texts += [" ".join(base), " ".join(edited(rng, base, max(1, round(len(base) * 0.022))))]
        pairs.append((len(texts) - 2, len(texts) - 1))
    base = new(150)
    first = len(texts)
    texts += [" ".join(edited(rng, base, rng.randrange(3))) for _ in range(250)]
    passage = new(60)
    texts += [" ".join(new(60) + passage + new(60)) for _ in range(150)]
    sets = [shingle_set(t) for t in texts]
    left = {r.doc_id for r in simhash.drop_similar(docs_of(list(enumerate(texts)))).collect()}
    want = [(a, b) for a, b in pairs if similar(sets[a], sets[b])]
    assert len(want) > 150
    assert sum(b not in left for _, b in want) >= 0.98 * len(want)
    alone = [i for a, b in pairs if not similar(sets[a], sets[b]) for i in (a, b)]
    assert set(alone) <= left and set(range(first + 250, len(texts))) <= left
    group = brute_components(dict(enumerate(sets[first : first + 250])), similar)
    assert {i - first for i in left if first <= i < first + 250} == set(group.values())


def test_block_anchors(spark):
    """Every 15-bit word has the codewords within 2 bits as anchors, and words within 2 bits share one."""
    rows = spark.range(1 << 15).select("id", simhash.block_anchors(F.col("id").cast("int")).alias("a")).collect()
    near = {r.id: set(r.a) for r in rows}
    assert {len(a) for a in near.values()} == {1, 8}
    assert all((i ^ c).bit_count() <= 2 for i, a in near.items() for c in a)
    rng = random.Random(1)
    for _ in range(3000):
        i = rng.randrange(1 << 15)
        j = i ^ (1 << rng.randrange(15)) ^ (1 << rng.randrange(15))
        assert near[i] & near[j]


def test_no_similar_pair_is_left_out(docs_of):
    """800 pairs of Jaccard 0.8 or hardly more, as many of hardly less, and a chain of such links."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**7)}"
    rows, gone = [], set()

    def pair(at, same, left, right):
        """Two texts whose sets share `same` shingles and have so many of their own."""
        shared = [word() for _ in range(same + 4)]
        rows.append((at, " ".join([word() for _ in range(left)] + shared)))
        rows.append((at + 1, " ".join(shared + [word() for _ in range(right)])))

    for n in range(800):
        pair(2 * n, 80, 10, 10)
        gone.add(2 * n + 1)
    for n in range(800, 1000):
        pair(2 * n, 79, 10, 10)
    for n in range(1000, 1100):
        pair(2 * n, 80, 0, 20)
        gone.add(2 * n + 1)
    base = [word() for _ in range(460)]
    for n in range(20):
        # Windows of 100 shingles, 11 further each: neighbours have Jaccard 89/111.
        rows.append((5000 + n, " ".join(base[11 * n : 11 * n + 104])))
    gone |= {5000 + n for n in range(1, 20)}
    # Rows repeated in full, and a text without words.
    rows += [rows[0]] * 30 + [(9000, None), (9001, " "), (9002, "one"), (9003, "one")]
    gone |= {9001, 9003}
    left = [r.doc_id for r in simhash.drop_similar(docs_of(rows)).collect()]
    assert len(left) == len(set(left))
    assert {r[0] for r in rows} - set(left) == gone


def test_parities_rule_out_no_similar_pair():
    """Sets of all sizes: pairs of Jaccard 0.8 or more stay, hardly any of much less do."""
    rng = np.random.default_rng(3)
    rows, jaccard = [], []
    for n in [0, 1, 2, 5, 31, 32, 33, 63, 64, 65, 200, 1023, 1025, 5000]:
        for kept in (1.0, 0.95, 0.9, 0.89, 0.88, 0.8, 0.5, 0.0):
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            same = base[: round(kept * n)]
            other = np.unique(np.concatenate([same, rng.integers(0, 2**63, n - len(same), dtype=np.uint64)]))
            sides = [simhash._parity(side) for side in ((base, other) if len(rows) % 2 else (other, base))]
            rows.append((len(rows), len(rows), *sides, len(base) + len(other)))
            jaccard.append(len(same) / max(1, 2 * n - len(same)) if n else 1.0)
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()], strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["u", "v", "a", "b", "total"])
    left = {u for out in simhash._possible_batches(0.8)(iter([batch])) for u in out.column("u").to_pylist()}
    assert {i for i, j in enumerate(jaccard) if j >= 0.8} <= left
    assert not left & {i for i, j in enumerate(jaccard) if j <= 0.5 and rows[i][4] > 100}


_NEAR_RUN = """
import sys
from pyspark.sql import SparkSession
from logsift.llm import simhash
at, event_log = sys.argv[1], {"spark.eventLog.enabled": "true", "spark.eventLog.compress": "false"}
places = {"spark.eventLog.dir": f"file://{at}/events", "spark.checkpoint.dir": f"file://{at}/shared", "spark.local.dir": f"{at}/local"}
# As with tables of many rows, no side of a join is small.
quiet = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.autoBroadcastJoinThreshold": "-1"}
spark = SparkSession.builder.master("local[4]").config(map=event_log | places | quiet).getOrCreate()
print("kept", simhash.drop_similar(spark.read.parquet(f"{at}/docs.parquet")).count())
spark.stop()
"""


def test_texts_that_stay_are_not_shuffled(tmp_path):
    """Unlike texts and a few near copies: what the near dedup shuffles is less than the texts, once."""
    rng = random.Random(4)
    word = lambda: f"{rng.getrandbits(40):x}"
    texts = [[word() for _ in range(1500)] for _ in range(900)]
    texts += [edited(rng, words, 3) for words in texts[:20]]
    ids = list(range(len(texts)))
    joined = [" ".join(words) for words in texts]
    # Repeated rows come through once.
    rows = pa.table({"doc_id": ids + ids[-30:], "text": joined + joined[-30:]})
    pq.write_table(rows, tmp_path / "docs.parquet")
    (tmp_path / "events").mkdir()
    place = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run(
        [sys.executable, "-c", _NEAR_RUN, str(tmp_path)],
        cwd=place, env=os.environ | {"PYTHONPATH": place}, capture_output=True, text=True, timeout=300,
    )
    assert "kept 900" in done.stdout, done.stderr[-2000:]
    logs = [p for p in (tmp_path / "events").rglob("*") if p.is_file() and not p.name.startswith((".", "appstatus"))]
    events = [json.loads(line) for p in logs for line in p.read_text().splitlines()]
    written = sum(e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"] for e in events if e["Event"] == "SparkListenerTaskEnd")
    assert 0 < written < 0.8 * sum(map(len, joined)), written


def rows_of_joins(at, texts):
    """doc_ids that the near dedup keeps, and rows that joins by a shingle or a set make on its way."""
    (at / "events").mkdir(parents=True)
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), at / "docs.parquet")
    place = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = _NEAR_RUN.replace('print("kept",', 'print("ids", [r[0] for r in').replace(".count())", '.select("doc_id").collect()])')
    done = subprocess.run(
        [sys.executable, "-c", run, str(at)],
        cwd=place, env=os.environ | {"PYTHONPATH": place}, capture_output=True, text=True, timeout=300,
    )
    assert "ids [" in done.stdout, done.stderr[-2000:]
    logs = [p for p in (at / "events").rglob("*") if p.is_file() and not p.name.startswith((".", "appstatus"))]
    events = [json.loads(line) for p in logs for line in p.read_text().splitlines()]
    counters = set()

    def walk(plan):
        if re.match(r"\w*Join \[(token|u|root, token)\b", re.sub(r"#\d+L?", "", plan["simpleString"])):
            counters.update(m["accumulatorId"] for m in plan["metrics"] if m["name"] == "number of output rows")
        for child in plan["children"]:
            walk(child)

    for event in events:
        if "sparkPlanInfo" in event:
            walk(event["sparkPlanInfo"])
    parts = [a for e in events if e["Event"] == "SparkListenerTaskEnd" for a in e["Task Info"]["Accumulables"]]
    made = sum(int(a["Update"]) for a in parts if a["ID"] in counters)
    return json.loads(done.stdout.split("ids ")[1].splitlines()[0]), made


def test_a_large_group_meets_no_set_in_full(tmp_path):
    """Copies with up to 5 edits, of which those with 2 or more may be left to the shingles: rows follow the group's size."""
    made = {}
    for n in (600, 1800):
        rng = random.Random(21)
        base = [f"w{rng.randrange(10**7)}" for _ in range(150)]
        copies = [" ".join(edited(rng, base, k % 6)) for k in range(n)]
        texts = copies + [" ".join(f"o{rng.randrange(10**7)}" for _ in range(60)) for _ in range(200)]
        kept, made[n] = rows_of_joins(tmp_path / str(n), texts)
        if n == 600:
            want = brute_components(dict(enumerate(shingle_set(t) for t in texts)), similar)
            assert sorted(kept) == sorted(set(want.values()))
    assert made[1800] < 5 * made[600], made
