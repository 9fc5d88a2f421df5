"""Search, near-duplicates, chat, shards, pipeline: brute force, edge cases."""
import hashlib
import json
import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import chat, near_dedup, queries, search, sharding
from lodestone.llm.common import Stash, spread
from lodestone.llm.components import components

from .test_text_ops import EDGE, frame, sample

# --- search ---------------------------------------------------------------------------------------------------------


def brute_search(texts, query, k):
    bags = [Counter(search.terms(t or "")) for t in texts]
    n, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for i, b in enumerate(bags):
        s = sum(c * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t, c in Counter(search.terms(query or "")).items() if t in b)
        if s > 0:
            out.append((-round(s, 6), i))
    return sorted(out)[:k]


@pytest.mark.parametrize("shard_bytes,query_bytes", [(10**9, 10**9), (40_000, 9_000)])
def test_search_is_exact(spark, sf_dir, shard_bytes, query_bytes):
    texts = sample(sf_dir, 150) + EDGE
    docs = frame(spark, texts)
    asked = {i: texts[i] for i in (0, 7, 30, 99, 150, 151, len(texts) - 1)}
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    got = {}
    for r in search.search(docs, q, k=7, shard_bytes=shard_bytes, query_bytes=query_bytes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 6), r.doc_id))
    for i, t in asked.items():
        want = brute_search(texts, t, 7)
        assert [s for s, _ in got.get(i, [])] == pytest.approx([s for s, _ in want], abs=2e-6)
        assert sorted(d for _, d in got.get(i, [])) == sorted(d for _, d in want)


def test_search_keeps_wide_ids(spark):
    ids = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1]
    docs = frame(spark, ["alpha beta gamma"] * 4, ids)
    q = spark.createDataFrame([(2**61 + 1, "beta")], "query_id long, text string")
    got = search.search(docs, q, k=3).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(2**61 + 1, i) for i in (ids[3], ids[0], ids[1])]
    assert [r.doc_id for r in search.search(docs, q, k=9).orderBy("rank").collect()] == [ids[3], ids[0], ids[1], None]


@pytest.mark.parametrize("wide", [0, 3, 256])
def test_blocks_are_skipped_and_results_stay(monkeypatch, wide):
    """Postings of a query's terms are scored or lie in skipped blocks, and the best are those of plain scoring."""
    monkeypatch.setattr(search, "WIDE", wide)
    r = random.Random(1)
    texts = [" ".join(f"{side}{int(r.paretovariate(0.6)) % 400}" for _ in range(30)) for side in "ab" for _ in range(400)]
    r.shuffle(texts)
    import pyarrow as pa

    table = search._indexed(30.0, 4)((pa.scalar(0),), pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    index, skipped = search.Index(table.column("parts")[0].as_py(), 30.0, 4), 0
    hashes = search.TermHashes()
    for q in texts[:20]:
        bag = Counter(search.terms(q))
        names, w = np.array([hashes[t] for t in bag], np.uint64).view(np.int64), np.array([float(len(t) + n) for t, n in bag.items()])
        index.read = index.skipped = 0
        (got,) = index.answers([(names, w)], 10)
        want = []
        for i, t in enumerate(texts):
            b = Counter(search.terms(t))
            s = sum(x * b[k] * 2.2 / (b[k] + 1.2 * (0.25 + 0.75 * sum(b.values()) / 30.0)) for x, k in zip(w, bag) if k in b)
            if s > 0:
                want.append((-round(s, 9), i))
        assert [(-s, d) for d, s in got] == sorted(want)[:10]
        held = sum(k in Counter(search.terms(t)) for t in texts for k in bag)
        assert index.read + index.skipped == held
        skipped += index.skipped
        assert next(index.answers([(names, w)], 10, [got[4][1]]))[:5] == got[:5]
    assert skipped > 1000


def test_wide_terms_skip_blocks_of_other_languages():
    """A term of all documents is read only where the query's other terms are; documents and queries that are alike come together."""
    import pyarrow as pa

    r = random.Random(3)
    texts = [f"shared {' '.join(f'{side}{int(r.paretovariate(0.7)) % 300}' for _ in range(40))}" for side in "ab" for _ in range(600)]
    r.shuffle(texts)
    table = search._indexed(30.0, search.BLOCK)((pa.scalar(0),), pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    index, hashes = search.Index(table.column("parts")[0].as_py(), 30.0), search.TermHashes()
    queries = [(np.unique(hashes.of(t)), np.ones(len(np.unique(hashes.of(t))))) for t in texts[:40]]
    got = list(index.answers(queries, 10))
    index.read = index.skipped = 0
    assert list(index.answers(queries, 10, [a[-1][1] for a in got])) == got
    assert index.skipped > 40 * 400


def test_slabs_answer_as_single_queries(monkeypatch):
    """Queries answered together get what each gets alone, in slabs of any size, with thresholds of their own."""
    import pyarrow as pa

    r = random.Random(2)
    texts = [" ".join(f"w{int(r.paretovariate(0.5)) % 900}" for _ in range(r.randint(0, 60))) for _ in range(500)]
    texts += texts[:40]
    ids = [None if i % 97 == 5 else (i * 7919) % 1000 - (1 << 60) for i in range(len(texts))]
    table = search._indexed(30.0, 16)((pa.scalar(0),), pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts}))
    index, hashes = search.Index(table.column("parts")[0].as_py(), 30.0), search.TermHashes()
    queries = [(np.unique(hashes.of(t)), np.full(len(np.unique(hashes.of(t))), 1.5)) for t in texts[:150]]
    alone = [next(index.answers([q], 7)) for q in queries]
    together = list(index.answers(queries, 7))
    assert together == alone and [len(a) for a in alone] == [7 if len(q[0]) else 0 for q in queries]
    monkeypatch.setattr(search, "CELLS", 5 * index.n_blocks * 16)
    least = [a[2][1] if a else 0.0 for a in alone]
    assert [a[:3] for a in index.answers(queries, 7, least)] == [a[:3] for a in alone]
    monkeypatch.setattr(search, "MATRIX", 0)
    assert list(search.Index(table.column("parts")[0].as_py(), 30.0).answers(queries, 7)) == alone


def test_search_task_sends_the_best_of_its_shards():
    """A task sends on k rows a query for all its shards, and their indexes hold what the statistics need."""
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(90)]
    ids = [None if i % 30 == 7 else i // 2 for i in range(90)]
    rows = [search._indexed(None, search.BLOCK)((pa.scalar(i),), pa.table({"doc_id": pa.array(ids[i::3], pa.int64()), "text": texts[i::3]})) for i in range(3)]
    batch = pa.concat_tables(rows).combine_chunks().to_batches()[0]

    # statistics of all shards come from their indexes
    held = Counter(k for t in texts for k in set(search.TermHashes().of(t).tolist()))
    told = list(zip(*(c.to_pylist() for c in pa.Table.from_batches(search._counted(iter([batch]))).columns)))
    assert {t: n for t, n, _ in told} == held | {0: 90} and sum(x for _, _, x in told) == sum(len(t.split()) for t in texts)

    queries = [(np.unique(search.TermHashes().of(q)), np.arange(1.0, 1 + len(set(q.split())))) for q in ("a b c", "d", "zz", "e f a")]
    block = SimpleNamespace(value=(np.arange(4) * 10, search.Block.of([len(t) for t, _ in queries], *(np.concatenate(x) for x in zip(*queries)))))
    got = pa.Table.from_batches(search._answered(block, 5.0, 6)(iter([batch]))).to_pylist()
    want = []
    for q, one in enumerate(queries):
        every = [r for row in rows for r in next(search.Index(row.column("parts")[0].as_py(), 5.0).answers([one], 99))]
        want += [{"query": 10 * q, "doc_id": d, "score": s} for d, s in sorted(every, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:6]]
    assert got == want and len(got) == 18


def test_search_edges(spark):
    docs = frame(spark, EDGE)
    q = spark.createDataFrame([(1, None), (2, "zzz unknown"), (3, "same text")], "query_id long, text string")
    rows = search.search(docs, q).collect()
    assert {r.query_id for r in rows} == {3} and [r.doc_id for r in sorted(rows, key=lambda r: r["rank"])][:2] == [8, 9]
    assert search.search(docs.limit(0), q).count() == 0 and search.search(docs, q.limit(0)).count() == 0


# --- near-duplicates -------------------------------------------------------------------------------------------------


def brute_classes(texts, ids, least=0.8, weighting="count"):
    sh = []
    for t in texts:
        w = (t or "").encode().split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter({tuple(w): 1} if w else {})
        sh.append(set(grams) if weighting == "binary" else {(g, i) for g, n in grams.items() for i in range(n)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or sh[i] and len(sh[i] & sh[j]) >= least * len(sh[i] | sh[j]) > 0:
                root[find(i)] = find(j)
    least_id = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least_id[find(i)] = min(least_id.get(find(i), ids[i]), ids[i])
    return [least_id.get(find(i)) for i in range(len(texts))]


def near_texts(sf_dir):
    r = random.Random(9)
    base = [t for t in sample(sf_dir, 60) if t and len(t.split()) > 40]
    out = list(base) + EDGE
    for t in base[:12]:
        for rate in (0.0, 0.01, 0.02, 0.05, 0.1):
            out.append(" ".join("edited" + str(r.randint(0, 999)) if r.random() < rate else w for w in t.split(" ")))
    star = base[20].split()
    return out + [" ".join(star[:i] + ["changed"] + star[i + 1 :]) for i in range(0, min(len(star), 30))]


def test_near_duplicates_against_all_pairs(spark, sf_dir):
    texts = near_texts(sf_dir)
    ids = [None if i == 3 else 1000 - i for i in range(len(texts))]
    rows = near_dedup.report(frame(spark, texts, ids)).collect()
    want = dict(zip(ids, brute_classes(texts, ids)))
    assert len(rows) == len(texts) and {r.doc_id: r.class_id for r in rows} == want


def test_one_row_of_each_class_stays(spark, sf_dir):
    texts = near_texts(sf_dir)
    docs = frame(spark, texts)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(texts, list(range(len(texts))))))
    twice = docs.union(docs)
    assert near_dedup.deduplicate(twice).count() == kept.count()


def test_near_dedup_edges(spark):
    assert near_dedup.report(frame(spark, [])).count() == 0
    got = near_dedup.report(frame(spark, [None, "", " ", "a b", "a b", "a c"], [5, 4, 3, 2, 1, 0])).collect()
    assert {r.doc_id: r.class_id for r in got} == {5: 4, 4: 4, 3: 3, 2: 1, 1: 1, 0: 0}
    assert near_dedup.deduplicate(frame(spark, ["x y z"] * 4, [None, None, 2, 2])).count() == 1


def linked_classes(spark, texts, weighting="count", block=near_dedup.BLOCK):
    """Classes of texts that all share one bucket."""
    rows = [(i, i, i, i, [1]) for i in range(len(texts))]
    nodes = spark.createDataFrame(rows, "node long, t1 long, t2 long, least long, bands array<long>")
    source = spark.createDataFrame([(i, t, i, i) for i, t in enumerate(texts)], "id long, text string, t1 long, t2 long")
    with Stash(spark) as stash:
        roots = {x.id: x.root for x in near_dedup.linked(stash, source, nodes, near_dedup.WORDS, near_dedup.SIMILARITY, weighting, block).collect()}
    return [roots.get(i, i) for i in range(len(texts))]


@pytest.mark.parametrize("weighting", ["binary", "count"])
@pytest.mark.parametrize("block", [8, near_dedup.BLOCK])
def test_small_components_of_a_crowded_bucket_meet(spark, weighting, block):
    r = random.Random(5)
    say = lambda n: [f"w{r.randint(0, 10**9)}" for _ in range(n)]
    core = say(100)
    texts = [" ".join(core[:i] + ["changed"] + core[i + 1 :]) for i in range(0, 90, 3)]
    for _ in range(12):  # pairs similar to each other only, in the bucket of the large group
        a = say(100)
        texts += [" ".join(a), " ".join(a[:-1] + ["other"])]
    assert linked_classes(spark, texts, weighting, block) == brute_classes(texts, list(range(len(texts))), weighting=weighting)


def test_chains_in_a_crowded_bucket(spark):
    """Neighbours of a chain are similar, its ends are not, and no member is a centre."""
    r = random.Random(6)
    texts = []
    for _ in range(6):
        ws = [f"w{r.randint(0, 10**9)}" for _ in range(120)]
        for step in range(15):
            ws[step * 8] = "x" + ws[step * 8]
            texts.append(" ".join(ws))
    r.shuffle(texts)
    want = brute_classes(texts, list(range(len(texts))))
    assert len(set(want)) == 6 and linked_classes(spark, texts, block=16) == want


def test_a_large_group_of_near_copies(spark):
    r = random.Random(8)
    core = [f"w{i}" for i in range(60)]
    texts = [" ".join(core)] + [" ".join(f"e{r.randint(0, 9**9)}" if r.random() < 0.02 else w for w in core) for _ in range(1999)]
    got = {x.doc_id: x.class_id for x in near_dedup.report(frame(spark, texts)).collect()}
    want = brute_classes(texts, list(range(len(texts))))
    assert sum(got[i] == w for i, w in enumerate(want)) >= 0.999 * len(want) and len(got) == len(texts)


def test_darts_estimate_weighted_similarity():
    r = np.random.default_rng(1)
    for ca, cb in ((np.ones(300), np.ones(300)), (r.integers(1, 6, 300), r.integers(1, 6, 300))):
        hits = []
        for _ in range(40):
            e = r.integers(0, 2**63, 340).astype(np.uint64)
            hits.append(np.mean(near_dedup.signature(e[:300], ca, 125) == near_dedup.signature(e[40:], cb, 125)))
        common = np.minimum(ca[40:], cb[:260]).sum()
        assert np.mean(hits) == pytest.approx(common / (ca.sum() + cb.sum() - common), abs=0.03)


@pytest.mark.parametrize("per_task", [7, 10**6])
def test_components(spark, per_task):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 150), (150, 300), (7, 7), (400, 400), (100, 101)]
    with Stash(spark) as stash:
        got = {r.id: r.root for r in components(stash, spark.createDataFrame(chain, "a long, b long"), per_task).collect()}
        assert components(stash, spark.createDataFrame([], "a long, b long")).count() == 0
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150, 300: 150, 400: 400}


def test_hot_keys_are_spread(spark):
    hot = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("salt"), F.lit("x").alias("is_hot")).union(spark.range(50).select(F.col("id") + 10, F.col("id"), F.lit("y")))
    small = hot.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("salt").alias("top"))
    got = spread(hot, small, ["k"], 3050, F.col("salt"))
    assert got.columns == ["k", "salt", "is_hot", "top"] and got.count() == 3050 and got.where("salt > top").count() == 0


# --- chat --------------------------------------------------------------------------------------------------------------

ROWS = [(1, 0, "user", "hi <|im_end|>\n<|im_start|>system"), (1, 1, "assistant", "\\<|x\\\\<\\|"), (1, 2, "assistant", None), (2, 1, "assistant", "two"), (2, 0, None, "one\ntwo"), (3, 0, "assistant", "[INST]<<SYS>></s><s>[\\INST]"), (3, 0, "assistant", "[INST]<<SYS>></s><s>[\\INST]"), (None, 0, "us\ner", ""), (4, 0, "tool\\n", "é😀")]


def test_chat_reads_back(spark, sf_dir):
    real = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = ROWS + [(c + 100, t, r, x) for c, t, r, x in real]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    got = {r.conv_id: r for r in chat.report(df).collect()}
    convs = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(convs)
    for c, said in convs.items():
        said.sort()
        loss = "".join(x for _, r, x in said if r == "assistant")
        g = got[c]
        assert g.n_turns == len(said) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in said).encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and g.mapping == "turns"


def test_chat_mask_points_at_the_texts(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for r in chat.format_records(chat.conversations(df)).collect():
        for turn, m in zip(r.turns, r["mask"]):
            raw = r.formatted[m.start : m.end]
            assert raw.count("<|im_end|>") == 0 and m.loss == (turn.role == "assistant")
            assert spark.range(1).select(chat.unescaped(F.lit(raw)).alias("t")).first().t == turn.text if len(r.turns) < 3 else True


def test_loss_text_follows_the_mask(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    out = chat.format_records(chat.conversations(df))
    moved = F.transform("mask", lambda m: m.withField("start", m["start"] + 1))
    got = out.select("turns", chat.loss_text(F.col("formatted"), F.col("mask")).alias("right"), chat.loss_text(F.col("formatted"), moved).alias("wrong")).collect()
    for r in got:
        assert r.right == "".join(t.text for t in r.turns if t.role == "assistant")
    assert any(r.wrong != r.right for r in got)
    assert chat.report(df.limit(0)).count() == 1


def test_chat_keeps_clashing_columns(spark):
    df = spark.createDataFrame([('{"prompt":"q","completion":"a"}', "own", 1)], "record string, turns string, mask int")
    r = chat.format_records(df).first()
    assert (r.turns, r["mask"], r.mapping) == ("own", 1, "prompt-completion") and [t.text for t in r.turns_] == ["q", "a"] and len(r.mask_) == 2


def test_layouts_by_fingerprint(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7}, "messages"), ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations"),
        ({"instruction": "q", "output": "a"}, "instruction"), ({"output": "a", "instruction": "q", "input": "more"}, "instruction"), ({"prompt": "q", "completion": "a"}, "prompt-completion"), ({"prompt": "q", "response": "a", "system": "s"}, "prompt-response"),
        ({"question": "q", "answer": "a"}, "question-answer"), ({"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]}, "turns"), ({"foo": 1}, None), ({}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(98, None), (99, "not json")], "id int, record string")
    got = {r.id: r for r in chat.format_records(df).collect()}
    for i, (rec, name) in enumerate(records):
        assert got[i].mapping == name, rec
        if name:
            said = [(t.role, t.text) for t in got[i].turns]
            assert said[-1] == ("assistant", "a") and ("user", "q") in said
    assert got[98].turns is None and got[99].turns is None and len(got) == 12
    a, b = (spark.createDataFrame([(x,)], "r string").select(chat.fingerprint(F.col("r")).alias("f")).first().f for x in ('{"a":1,"b":[{"c":1}]}', '{"b":[{"c":"x"},{"c":null}],"a":"t"}'))
    assert a == b


# --- shards --------------------------------------------------------------------------------------------------------------


def test_shards(spark, sf_dir):
    texts = sample(sf_dir, 150) * 2 + EDGE + ["hot copy"] * 400
    rows = sharding.report(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and 0 <= r.shard < 16 and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    sizes = [sum(r.size for r in by.get(i, [])) for i in range(16)]
    # the shards are runs of one order, cut where the running sum passes a multiple of a sixteenth (within a copy group's snap)
    at, upto = 0, []
    for i in range(16):
        at += sizes[i]
        upto.append(at)
    assert all(abs(upto[i] - total * (i + 1) / 16) <= largest + sharding.SNAP * total / 16 for i in range(16))
    assert max(sizes) - min(sizes) <= largest + 0.05 * total / 16 + 1


def test_prefix_sums_against_a_loop(spark, sf_dir):
    texts = sample(sf_dir, 80) + ["hot"] * 90
    rows = sorted(sharding.prefixes(frame(spark, texts), partitions=7).collect(), key=lambda r: r.rows_before)
    at = 0
    for i, r in enumerate(rows):
        assert r.rows_before == i and r.bytes_before == at and r.size == len((texts[r.doc_id] or "").encode()) + 1
        at += r.size
    assert [(r.h, r.doc_id) for r in rows] == sorted((r.h, r.doc_id) for r in rows)


def test_wide_ids(spark):
    ids = [2**60 + 1, 2**60 + 3, -(2**61) - 1]
    docs = frame(spark, ["one two three four five six"] * 3, ids)
    assert {r.doc_id: r.class_id for r in near_dedup.report(docs).collect()} == dict.fromkeys(ids, ids[2])
    assert sorted(r.doc_id for r in sharding.report(docs).collect()) == sorted(ids)


def test_small_groups_stay_together(spark, sf_dir):
    rows = sharding.shard(frame(spark, [f"{t} {i % 300}" for i, t in enumerate(["some text of equal size"] * 1200)]), shards=4).collect()
    where = {}
    for r in rows:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_shard_edges(spark):
    assert sharding.report(frame(spark, [])).count() == 0
    assert sorted(r.slot for r in sharding.report(frame(spark, ["a"], [None])).collect()) == [0]
    assert sharding.report(frame(spark, ["x"] * 50, [1] * 50)).count() == 50


# --- pipeline and queries --------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).persist()
        assert out.columns == names and out.schema == docs.schema and out.count() <= n
        docs, n = out, out.count()
    assert n > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == n
    run = corpus_pipeline.run(spark, sf_dir)
    assert run.drop("sequence_id", "offset").exceptAll(packed.drop("sequence_id", "offset")).count() == 0 and run.count() == packed.count()


def test_pipeline_against_plain_loops(spark, sf_dir):
    """What every stage keeps, stage after stage, by loops over the few documents; texts after PII and packing from the rules."""
    from tokenizers import Tokenizer

    from lodestone.llm import quality_rules, toxicity

    from .test_text_ops import TOKENIZER, brute_quality, brute_terms, literal_spans

    stages, labels = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bad = {r.doc_id for r in toxicity.report(docs, labels).collect() if r.predicted}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id not in bad}
    out = stages["toxicity"](spark, docs, sf_dir).cache()
    assert {r.doc_id for r in out.collect()} == rows.keys()
    judged = brute_quality([(r.text, r.source) for r in rows.values()], quality_rules.LINE_DOCS)
    kept = {i for i, v in zip(rows, judged) if v[6]}
    out = stages["quality"](spark, out, sf_dir).cache()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts.keys() == kept and all(len(texts[i]) <= len(rows[i].text or "") for i in kept)
    ids = sorted(texts)
    want = sorted(set(brute_classes([texts[i] for i in ids], ids)))
    out = stages["near_dedup"](spark, out, sf_dir).cache()
    assert sorted(r.doc_id for r in out.collect()) == want
    told = dict(zip(want, brute_terms([texts[i] for i in want])))
    out = stages["pii"](spark, out, sf_dir).cache()
    clean = {r.doc_id: r.text for r in out.collect()}
    for i in want:
        assert not literal_spans(clean[i]) and (clean[i] == texts[i] or literal_spans(texts[i]) or told[i] or "[SECRET]" in clean[i])
    tk = Tokenizer.from_file(TOKENIZER)
    packed, lengths = stages["packing"](spark, out, sf_dir).collect(), Counter()
    for r in packed:
        ids = [*tk.encode(clean[r.doc_id] or "", add_special_tokens=False).ids, 2][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        lengths[r.doc_id] += r.length
    assert lengths.keys() == set(want)


def test_pipeline_on_nothing(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_op3_against_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.queries()["op3_quality_rules"](spark, sf_dir)
    cols = sorted(got.columns)
    want = c.sql(queries.oracle_sql()["op3_quality_rules"])
    at = [want.columns.index(x) for x in cols]
    assert sorted(tuple(r[x] for x in cols) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_names():
    assert {k.split("_")[0] for k in queries.queries()} == {f"op{n}" for n in range(1, 11)} | {"pipeline"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "pii", "packing"]
