"""Packing by jumps against a fold, and reduction in rounds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as fx
from docloom.operators import chunking, compiling, packing
from docloom.session import materialize


def by_hand(tokens, alone, most):
    out, used, shut = [], 0, True
    for t, a in zip(tokens, alone, strict=True):
        if shut or a or used + t > most:
            out.append((out[-1] if out else -1) + 1)
            used = t
        else:
            out.append(out[-1])
            used += t
        shut = a
    return out


def test_jumps_equal_a_fold(spark):
    rng, rows, want = random.Random(1), [], {}
    for key in range(40):
        n = rng.choice([1, 2, 5, 30, 80])
        tokens, alone = [rng.choice([1, 3, 10, 25, 60, 61, 90]) for _ in range(n)], [rng.random() < 0.1 for _ in range(n)]
        rows += [(key, k, t, a) for k, (t, a) in enumerate(zip(tokens, alone, strict=True))]
        want |= {(key, k): b for k, b in enumerate(by_hand(tokens, alone, 60))}
    df = spark.createDataFrame(rows, "key long, n long, tokens long, alone boolean")
    assert {(r.key, r.n): r.bin for r in packing.next_fit(df, 60).collect()} == want
    assert packing.next_fit(df.limit(0), 60).count() == 0


def test_one_document_of_100_000_sections(spark):
    n = 100_000
    items = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("n"), (F.col("id") % 37 + 1).alias("tokens"), (F.col("id") % 5000 == 77).alias("alone"))
    got = materialize(packing.next_fit(items, 500), "bins")
    want = by_hand([k % 37 + 1 for k in range(n)], [k % 5000 == 77 for k in range(n)], 500)
    assert [r.bin for r in got.orderBy("n").collect()] == want


@pytest.mark.parametrize("fold", [0, 3, 512])
def test_packing_is_alike_by_fold_and_by_jumps(spark, fold, monkeypatch):
    rng = random.Random(2)
    docs = [(k, "\n\n".join(f"# S{j}\n\n" + "\n\n".join("word " * rng.randint(1, 60) + "end. More here!" for _ in range(rng.randint(1, 3))) for j in range(rng.randint(1, 12)))) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, content string")
    want = {(r.doc_id, r.pos, r.part): (r.chunk, r.tokens) for r in chunking.pack(chunking.sections(df), 80).collect()}
    monkeypatch.setattr(chunking, "FOLD", fold)
    assert {(r.doc_id, r.pos, r.part): (r.chunk, r.tokens) for r in chunking.pack(chunking.sections(df), 80).collect()} == want


def test_rounds_keep_to_the_budget_and_to_the_order(spark):
    rng = random.Random(3)
    chunks = [(d, k, f"{d}:{k} " + "x" * rng.randint(0, 200)) for d, n in ((1, 1), (2, 2), (3, 17), (4, 90)) for k in range(n)]
    prompts = spark.sparkContext.accumulator(0)

    def completion(asked):
        for p in asked:
            prompts.add(1)
            if len(p.encode()) > 4 * 100:
                raise ValueError("above the budget")
        return [" ".join(w for w in p.split() if ":" in w) for p in asked]

    got = {r.doc_id: (r.summary, r.rounds) for r in compiling.summarised_within(spark.createDataFrame(chunks, "doc_id long, index long, content string"), completion, 100).collect()}
    assert got[1] == ("1:0", 0) and got[2] == ("2:0 2:1", 1)
    assert got[3][0] == " ".join(f"3:{k}" for k in range(17)) and got[4][1] >= 2
    assert got[4][0].startswith("4:0 4:1 ") and len(got[4][0]) <= 4 * 42


def test_heads_of_bytes(spark):
    df = spark.createDataFrame([("héé",), ("abc",), (None,), ("한국",)], "t string")
    assert [r[0] for r in df.select(fx.byte_head(F.col("t"), 4)).collect()] == ["hé", "abc", None, "한"]
