"""Structure repair, tokenizer alignment and the language model against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import alignment, arrays, lm, secrets, structure
from docloom.llm.queries import ALIGNMENT
from docloom.llm.textkit import SPACED, WordHasher

# ---------------------------------------------------------------- structure repair


def cheapest(turns: str) -> tuple[int, str]:
    """All edits of a short conversation, by a walk over states with the least (cost, audit) of each."""
    best = {0: (0, "")}
    for turn in [*turns, ""]:
        for _ in range(3):  # insertions
            for s, (cost, audit) in list(best.items()):
                to, new = 2 if s == 3 else 3, (cost + 3, audit + "I")
                if to not in best or new < best[to]:
                    best[to] = new
        if not turn:
            break
        now: dict[int, tuple[int, str]] = {}

        def offer(state: int, cost: int, audit: str, now=now) -> None:
            if state not in now or (cost, audit) < now[state]:
                now[state] = (cost, audit)

        for s, (cost, audit) in best.items():
            offer(s, cost + 4, audit + "D")
            if turn == "d":
                continue
            extra, initial = (3 if turn.isupper() else 0), turn.lower()
            if s == 0 and initial == "s":
                offer(1, cost + extra, audit + "K")
            due, to = ("a", 2) if s == 3 else ("u", 3)
            offer(to, cost + extra + (0 if initial == due else 3), audit + ("K" if initial == due else "R"))
        best = now
    return min(best[s] for s in (0, 2) if s in best)


def test_alignment_of_turns_is_cheapest_and_least():
    for n in (1, 2, 3):
        for turns in itertools.product("suaxSUAXd", repeat=n):
            assert structure._ended(structure._table("".join(turns), (0,))[0])[:2] == cheapest("".join(turns)), turns
    rng = random.Random(3)
    for _ in range(300):
        turns = "".join(rng.choice("uauauauasxSUAXd") for _ in range(rng.randint(4, 40)))
        assert structure._ended(structure._table(turns, (0,))[0])[:2] == cheapest(turns), turns


def test_blocks_put_together_are_the_whole():
    rng = random.Random(4)
    for _ in range(60):
        turns = "".join(rng.choice("uauauauasxSUAXd") for _ in range(rng.randint(2, 30)))
        parts, at = [], 0
        while at < len(turns):
            size = rng.randint(1, 7)
            parts.append(turns[at : at + size])
            at += size
        tables = [structure._table(x, (0, 1, 2, 3)) for x in parts]
        costs = [[c[0] if c else structure._INF for row in t for c in row] for t in tables]
        audits = [[c[1] if c else "" for row in t for c in row] for t in tables]
        later, state, audit = structure._later(costs, [0, 6, 0, 3]), 0, ""
        for c, a, v in zip(costs, audits, later, strict=True):
            after = structure._choices(c, a, v)[state]
            audit, state = audit + a[4 * state + after], after
        assert audit + structure.CLOSING[state] == cheapest(turns)[1]
        assert min(structure._product(costs)[x] + (0, 6, 0, 3)[x] for x in range(4)) == cheapest(turns)[0]


def by_hand(rows: list[tuple]) -> dict:
    """The digest of each conversation of (conv_id, turn, role, text), without damage."""
    out, conversations = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        conversations[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, turns in conversations.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{x[1]}\0{x[2]}".encode()).hexdigest()))
        seen, letters, faults = set(), "", Counter()
        for _, role, text in turns:
            rest, initial = text.rstrip(structure.SPACE), role[:1]
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            initial = initial if initial in ("s", "u", "a") else "x"
            letters += "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = cheapest(letters)
        fixed = structure.repaired(audit, [(r, t) for _, r, t in turns], 0)
        known = {t for t, _, _ in turns if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def digests(df) -> dict:
    got = structure.digest(structure.repair(df)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_repair_of_odd_conversations(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, None, None), (2, 5, "system", "Be kind."), (2, 5, "system", "Be kind."), (2, 9, "user", "cut"),
        (None, 0, "user", "a."), (None, 3, "user", "b."), (3, 0, "", ""), (4, 1, "assistant", "é!"), (4, 1, "tool", "x."), (5, None, "user", "x."), (5, None, "user", "y."), (6, 0, "user", "w " * 60_000 + "."),
        (7, 0, "system", "only."), (8, -3, "user", "q?"), (8, 2, "assistant", "\x0b"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("x").alias(c) for c in ("n", "_c", "again", "part", "seq", "cost", "audit", "state")])
    assert digests(df) == by_hand(rows)
    assert digests(df.limit(0)) == {}


def test_repair_of_a_hot_conversation(spark):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["Fine.", "cut", ""]) if rng.random() < 0.2 else f"t{k}.") for k in range(3000)]
    rows += [(k, t, ("user", "assistant")[t % 2], f"{k} {t}.") for k in range(100, 140) for t in range(4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    blocks = structure.repair(df)
    assert blocks.where("conv_id = 7").count() >= 3000 // structure.BLOCK
    assert blocks.where("conv_id = 7").select(F.max(F.size("roles"))).first()[0] <= 3 * structure.BLOCK
    assert digests(df) == by_hand(rows)


# ---------------------------------------------------------------- the ledger of secrets


@pytest.mark.parametrize("bound", [0, 500_000])
def test_a_second_scan_takes_unseen_contents_only(spark, bound, monkeypatch):
    taken, write = {}, secrets.materialize
    monkeypatch.setattr(secrets, "materialize", lambda df, label: taken.setdefault(label, []).append(df) or write(df, label))
    rows = [(k, 1, f"known {k} token = abcdefgh") for k in range(30)]
    first = spark.createDataFrame(rows, "path long, version int, content string")
    ledger, _ = secrets.scan(first, rules=secrets.BASE, broadcast_blobs=bound)
    more = first.union(spark.createDataFrame([(k, 2, f"fresh {k} token = abcdefgh") for k in range(5)] + [(40, 1, "fresh 1 token = abcdefgh")], first.schema))
    after, found = secrets.scan(more, ledger, rules=secrets.BASE, broadcast_blobs=bound)
    assert [x.count() for x in taken["blobs"]] == [30, 5] and [x.count() for x in taken["ledger"]] == [30, 5]
    assert after.count() == 35 and {len(r.spans) for r in found.collect()} == {1} and found.count() == 36
    assert secrets.scan(more, after, rules=secrets.BASE, broadcast_blobs=bound)[0].count() == 35 and taken["blobs"][-1].count() == 0
    # a rule matches no content before the unseen blobs are known
    plan = taken["blobs"][1]._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.split("Join")[0] + plan.split("Join")[1].split("\n")[0] and "RLIKE" not in plan.split("Join", 1)[1].split("\n", 1)[1]


# ---------------------------------------------------------------- tokenizer alignment


def test_gallop_finds_what_lists_share():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(2))
        ours, theirs = alignment.gallop(a, b)
        assert [a[i] for i in ours] == sorted(set(a) & set(b)) == [b[j] for j in theirs]
    assert alignment.gallop([999_999], list(range(1_000_000))) == ([0], [999_999])


def test_gallop_reads_lists_that_are_much_alike_about_once():
    class Counted(list):
        reads = 0

        def __getitem__(self, k):
            self.reads += 1
            return super().__getitem__(k)

    long = Counted(range(1000))
    for short in (range(1000), range(0, 1000, 2)):
        long.reads = 0
        assert alignment.gallop(list(short), long) == (list(range(len(short))), list(short))
        assert long.reads <= 3 * len(short)


ODD_TEXTS = [
    "plain words here", "", None, "two  spaces", " lead and trail ", "\n new\n lines \t tabs", "l'été it's they're", "日本語 の テキスト", "▁ mark", "nul \x00 byte", "<|endoftext|> <s> </s>", "\U0001f468‍\U0001f469‍\U0001f467 ​ x",
    "x　y   z", "ﬁ ligature", "é ́ combining", "a" * 5000, "1234567890 " * 50, "\x1c fs \x85 nel", "café " * 30, " ", "  ", "<0x41> piece", "plain words here",
]


def test_alignment_by_brute_force(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(None, "no id here"), (0, "plain words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("chunk", "pair", "n", "docs", "k")]).repartition(3)
    a, b = Tokenizer.from_file(ALIGNMENT.bytes_file), sentencepiece.SentencePieceProcessor(model_file=ALIGNMENT.pieces_file)
    a.encode_special_tokens = True
    own, found, held = alignment.Aligner(ALIGNMENT), [], Counter()
    assert own.cuts
    for doc_id, text in rows:
        found.append((doc_id, 0, 0, [], []))
        if not text:
            continue
        data, ids = (" " + text).encode(), [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        tokens = [[own.a_bytes[x] for x in ids[0]], [own.b_bytes[x] for x in ids[1]]]
        if any(b"".join(t) != data for t in tokens):
            continue
        spans = [list(zip(np.cumsum([0, *map(len, t)]), np.cumsum(list(map(len, t))))) for t in tokens]  # noqa: B905
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        own_groups = [[[i for i, (_, e) in zip(x, s, strict=True) if lo < e <= hi] for x, s in zip(ids, spans, strict=True)] for lo, hi in itertools.pairwise([0, *shared])]
        links = [(x, y) for g in own_groups for x in g[0] for y in g[1]]
        found[-1] = (doc_id, len(ids[0]), len(ids[1]), own_groups, links)
        held.update(set(links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    want = []
    for doc_id, n_a, n_b, gs, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        want.append((doc_id, n_a, n_b, len(gs), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if gs else ""))
    for p in (ALIGNMENT, alignment.Alignment(ALIGNMENT.bytes_file, ALIGNMENT.pieces_file, chunk=20)):
        got, pairs = alignment.align(df, p)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {k: (n, n == top[k[0]]) for k, n in held.items()}
    assert sum(w[1] == 0 for w in want) == 3  # empty, null and the mark that no piece gives back
    assert alignment.align(df.limit(0), ALIGNMENT)[0].count() == 0


def test_texts_that_begin_or_end_in_white_space_are_aligned_as_whole_texts(spark):
    rng = random.Random(12)
    texts = ["first ", "second", "third\n", "\n fourth", "  fifth  ", "sixth\u3000", "\u200bseventh ", " ", "  ", "eighth\t", "'s", "ninth \r\n"]
    parts = ["the", "a", "é", "日本", " ", " ", "  ", "\n", "\t", "\u00a0", "'s", "1", "!", "\u0301", "\x00"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)  # all in one chunk
    own, want, held = alignment.Aligner(ALIGNMENT), {}, Counter()
    for k, text in enumerate(texts):
        found = own.aligned([" " + text])
        want[k] = (*found.totals[0].tolist(), hashlib.sha256(found.shown[0].encode()).hexdigest())
        held.update(set(found.pair.tolist()))
    got, pairs = alignment.align(df, ALIGNMENT)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in got.collect()} == want
    assert {r.a << alignment.SHIFT | r.b: r.n for r in pairs.collect()} == held


# ---------------------------------------------------------------- language model


def brute(texts: list[str | None], train: list[str | None], order: int) -> list[tuple[float, float]]:
    """(base, score) of texts by dictionaries."""
    tokens = lambda t: [*(w for w in _words(t)), "<end>"]
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        seq = ["<start>"] * (order - 1) + tokens(t)
        counts[order].update(tuple(seq[i : i + order]) for i in range(len(seq) - order + 1))
    raw = Counter(w for t in train for w in tokens(t))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    d = {k: lm.discounts(*[sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4)]) for k in range(1, order + 1)}
    followers = {k: defaultdict(list) for k in range(1, order + 1)}
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            followers[k][g[:-1]].append(c)

    def p(gram: tuple) -> float:
        k = len(gram)
        if not k:
            return 1 / (len(raw) + 1)
        own = followers[k][gram[:-1]]
        if not own:
            return p(gram[1:])
        cut = lambda c: d[k][min(c, 3) - 1] if c else 0
        c = counts[k][gram]
        return (c - cut(c) + sum(map(cut, own)) * p(gram[1:])) / sum(own)

    out = []
    for t in texts:
        seq = ["<start>"] * (order - 1) + tokens(t)
        full = math.fsum(math.log10(p(tuple(seq[i : i + order]))) for i in range(len(seq) - order + 1))
        out.append((math.fsum(math.log10((raw[w] + 1) / (raw.total() + len(raw) + 1)) for w in tokens(t)), full))
    return out


def _words(text: str | None) -> list[str]:
    lowered = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


@pytest.mark.parametrize(("order", "bucket"), [(1, 50), (2, 40), (2, 10**6), (3, 60), (4, 300)])
def test_language_model_by_brute_force(spark, order, bucket):
    rng = random.Random(order)
    made = [" ".join(rng.choice(["the", "the", "The", "a", "cat", "dog", "runs", f"r{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    rows = list(enumerate([*made, None, "", "unseen words only", " \t\n ", "Été été"])) + [(None, "the cat"), (3, made[3]), (3, made[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("hash", "n", "bucket", "kind", "score", "first")]).repartition(4)
    training = df.where(~lm.held_out(F.col("doc_id")))
    ids = [tuple(r) for r in training.select("doc_id", "text").collect()]
    assert 0 < len(ids) < len(rows)
    model = lm.fit(training, lm.KneserNey(order=order, bucket=bucket, chunk=100))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.base_score, r.score, r.n_tokens) for r in lm.score(df, model).collect()))
    train = [t for _, t in ids]
    want = sorted((d is None, d or 0, b, s, len(_words(t)) + 1) for (d, t), (b, s) in zip(rows, brute([t for _, t in rows], train, order), strict=True))
    assert [x[:2] + x[4:] for x in got] == [x[:2] + x[4:] for x in want]
    np.testing.assert_allclose([x[2:4] for x in got], [x[2:4] for x in want], rtol=1e-10)
    assert len(model.hot) <= model.buckets


def test_probabilities_of_all_words_sum_to_one(spark):
    words = [f"w{k}" for k in range(12)]
    rng = random.Random(9)
    df = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(20))) for k in range(20)], "doc_id long, text string")
    model = lm.fit(df, lm.KneserNey(order=3, bucket=100))
    hashes = np.sort(np.concatenate([WordHasher(SPACED).words(" ".join(words).encode()).view(np.int64), [lm.END]]))
    ids = model.word_ids(hashes)[0]
    assert len(ids) == model.words
    every = np.append(ids, model.words + 1).astype(model.id_type)  # and the unknown word
    for before in ([ids[0], ids[1]], [ids[2], model.words + 1], [model.words + 1, ids[3]]):
        texts = np.stack([np.full(len(every), before[0]), np.full(len(every), before[1]), every], axis=1).astype(model.id_type)
        p = lm.probabilities(model, texts.reshape(-1), np.full(len(every), 3))
        assert abs(p.reshape(-1, 3)[:, 2].sum() - 1) < 1e-12


def test_language_model_without_training_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(df, lm.fit(df.limit(0))).collect()}
    assert got == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}
    assert lm.score(df.limit(0), lm.fit(df)).count() == 0


def test_files_of_arrays_come_back(spark, tmp_path):
    given = {"a": np.arange(5, dtype="<u8"), "b": np.empty(0, dtype="<u4"), "c": np.array([1, 2, 3], dtype="<u1"), "d": np.array([0.5])}
    arrays.write_arrays(f"file://{tmp_path}", "x", given)
    arrays.write_arrays(f"file://{tmp_path}", "x", given)
    back = arrays.read_arrays(f"file://{tmp_path}", "x")
    assert all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in given.items())
    assert arrays.read_arrays(f"file://{tmp_path}", "y") is None
