"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from larkspur.llm import langid, mixing, packing

from .test_operators import awkward, brute_seed_packs, components, docs, jaccard_pairs, rows, shingle_sets  # noqa: F401

SF = "/root/testdata/sf0.001"


def md5(x):
    import hashlib

    return hashlib.md5(str(x).encode()).hexdigest()


def test_pipeline_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    left = sorted(table.collect(), key=lambda r: r["doc_id"])
    model = langid.Labeller(langid.fit(table))
    keep = np.concatenate([(counted > 0) & (shares.max(1) >= langid.MIN_SHARE) for _, _, shares, counted, _, _ in model.label([r["text"] for r in left])])
    left = [r for r, k in zip(left, keep) if k]
    first = {}
    for r in left:
        first.setdefault(r["text"], r["doc_id"])
    left = [r for r in left if first[r["text"]] == r["doc_id"]]
    root = components(len(left), jaccard_pairs(shingle_sets([r["text"] for r in left]), 0.5))
    left = [r for i, r in enumerate(left) if root[i] == i]
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in left)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {r["doc_id"]: len(r["text"].split()) for r in left}
    want = brute_seed_packs([r["doc_id"] for r in left], [r["text"] for r in left], packing.WINDOW)
    packs = defaultdict(list)
    for r in got:
        packs[r["pack_id"]].append((r["part"], r["doc_id"]))
    assert all([d for _, d in sorted(p)] in packs_of(left, want) for p in packs.values() if min(p)[1] % packing.SEED_EVERY == 0) and want
    size = Counter()
    for r in got:
        size[r["pack_id"]] += r["n_tokens"]
    assert all(size[r["pack_id"]] <= packing.WINDOW * r["windows"] for r in got)


def packs_of(left, want):
    return [[left[s]["doc_id"], *(left[d]["doc_id"] for d in docs)] for s, docs in want.items()]


def test_mixing_stage_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    tokens = {r["doc_id"]: len(r["text"]) - len(r["text"].translate(str.maketrans("", "", " \t\n"))) + 1 if r["text"] else 0 for r in table.collect()}
    by = defaultdict(list)
    for r in table.collect():
        by[r["source"]].append(r["doc_id"])
    supply = {s: sum(tokens[d] for d in ids) for s, ids in by.items()}
    total = sum(supply.values())
    q = {s: n / total for s, n in supply.items()}
    due = {s: [0.0] for s in by}
    for k in range(mixing.STEPS):
        t = (k + 0.5) / mixing.STEPS
        w = {s: (1 - t) * q[s] + t * math.sqrt(q[s]) for s in by}
        for s in by:
            due[s].append(due[s][-1] + total * w[s] / sum(w.values()) / mixing.STEPS)
    want = {}
    for s, ids in by.items():
        upto = 0
        for d in sorted(ids, key=md5):
            c, upto = upto + tokens[d] / 2, upto + tokens[d]
            k = min(sum(x <= c for x in due[s]) - 1, mixing.STEPS - 1)
            want[d] = (k + (c - due[s][k]) / (due[s][k + 1] - due[s][k])) / mixing.STEPS
    got = {r["row"]["doc_id"]: r["_at"] for r in mixing.curriculum(table).select("row", "_at").collect()}
    assert all(abs(got[d] - want[d]) < 2e-6 for d in want)


def test_packs_come_in_training_order(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120")
    at = {r["row"]["doc_id"]: r["_at"] for r in mixing.curriculum(table).select("row", "_at").collect()}
    got = corpus_pipeline.pack(spark, table, SF).collect()
    seed = {r["pack_id"]: r["doc_id"] for r in got if r["part"] == 0}
    assert [r["position"] for r in got] == sorted(at[seed[r["pack_id"]]] for r in got)
    assert all(r["position"] == at[seed[r["pack_id"]]] for r in got)
    assert sorted(r[:7] for r in got) == sorted(r[:] for r in packing.packs(table).collect())


def test_stages_on_awkward_rows(spark, awkward, tmp_path):  # noqa: F811
    now = awkward
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == awkward.columns
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
    assert now.count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
