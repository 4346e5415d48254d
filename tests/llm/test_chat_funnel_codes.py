"""Chat formatting, funnels and vector codes against plain loops, and on odd rows."""

import collections
import datetime
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("evigraph.llm")
from evigraph.llm import chat, codes, funnel, queries  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string"
EVENTS = "client_id long, kind string, ts timestamp_ntz"
VECTORS = "vec_id long, embedding array<float>, label int"


def odd_turns():
    rng = random.Random(3)
    parts = ["<s>", "</s>", "<~s>", "<~~s>", "[INST]", "[/INST]", "[~INST]", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>\n\n", "<", "[", "~", "s>", "/s>", "|eot_id|>", "é", "😀", "\n", "\\", "$1", " ok"]
    made = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    rows = [(c, t, rng.choice(["user", "user", "assistant", "assistant", "system", None, "", made(3)]), made(12) if rng.random() < 0.9 else None) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "no id either"), (50, None, "assistant", "null turn"), (50, 0, "user", "a"), (50, 0, "user", "a"), (50, 0, "assistant", "tie")]
    rows += [(51, 0, "assistant", "long é " * 200_000 + "<s>"), (52, 0, "assistant", "")]
    return rows


def test_chat_round_trip(spark):
    rows = odd_turns()
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = spark.createDataFrame(rows, TURNS)
    made = chat.format_conversations(turns.repartition(5))
    got = {r["conv_id"]: r for r in made.collect()}
    back = {r["conv_id"]: r for r in chat.read(made).collect()}
    t = chat.Template()
    assert set(got) == set(back) == set(by_conv)
    for conv, want in by_conv.items():
        want = sorted(want)
        r = got[conv]
        assert r["n_turns"] == len(want)
        assert [(x["role"], x["text"]) for x in back[conv]["turns"]] == [(role, text) for _, _, role, text in want]
        assert back[conv]["loss_text"] == "".join(text for _, _, role, text in want if role == "assistant")
        # code point spans hold what byte spans hold
        data = r["formatted"].encode()
        assert [r["formatted"][s["start"] : s["end"]] for s in r["loss"]] == [data[s["start_byte"] : s["end_byte"]].decode() for s in r["loss"]]
        # one header for a run of turns of one role, and no control string but the template's own
        runs = 1 + sum(a[2] != b[2] for a, b in zip(want, want[1:]))
        assert r["formatted"].count(t.header) == r["formatted"].count(t.header_end) == runs
        assert r["formatted"].count(t.turn_end) == len(want)
        assert not any(c in r["formatted"] for c in t.foreign)
    assert chat.read(spark.createDataFrame([(1, "not of the template")], "conv_id long, formatted string").withColumn("loss", F.lit(None).cast(made.schema["loss"].dataType))).first()["turns"] is None


def test_chat_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template(foreign=("<a<",)).controls()


def plain_funnel(rows, funnels, limit):
    """Every attempt by a scan over the client's later rows."""
    events = collections.defaultdict(set)
    for client, kind, ts in rows:
        if client is not None and kind is not None and ts is not None:
            events[client].add((round((ts - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1)), kind))
    out = {}
    for f in funnels:
        for client, own in events.items():
            waits = [[] for _ in f.steps]
            for t, kind in own:
                if kind != f.steps[0]:
                    continue
                waits[0].append(0)
                now = t
                for k, step in enumerate(f.steps[1:], 1):
                    later = [x for x, kind in own if kind == step and x > now]
                    if not later or min(later) - now > limit or any(kind == f.excluded and now < x <= min(later) for x, kind in own):
                        break
                    waits[k].append(min(later) - now)
                    now = min(later)
            if waits[0]:
                middle = [sorted(w)[math.ceil(50 * len(w) / 100) - 1] if w else None for w in waits[1:]]
                out[f.name, client] = (*map(len, waits), max(k for k, w in enumerate(waits, 1) if w), *middle)
    depths = collections.Counter((f, v[4]) for (f, _), v in out.items())
    return {k: (*v, depths[k[0], v[4]]) for k, v in out.items()}


@pytest.mark.parametrize(("slot_rows", "least"), [(1 << 20, 1_000_000), (30, 1_000_000), (1, 7_000_000)])
def test_funnels_against_plain_loops(spark, monkeypatch, slot_rows, least):
    """Also with slots far narrower than an attempt, so that chains run over dozens of them."""
    monkeypatch.setattr(funnel, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(funnel, "LEAST_SLOT", least)
    rng = random.Random(slot_rows)
    zero = datetime.datetime(2024, 1, 31, 23, 0)
    kinds = ["view"] * 6 + ["click"] * 5 + ["purchase"] * 2 + ["signup", "error", "other", None]
    at = lambda most: zero + datetime.timedelta(microseconds=rng.choice([rng.randint(0, most * 1_000_000), rng.randint(0, most) * 1_000_000]))
    rows = [(c, rng.choice(kinds), at(7200)) for c in range(12) for _ in range(rng.randint(1, 40))]
    rows += [(99, rng.choice(kinds), at(3000)) for _ in range(400)]  # a dense client
    rows += [(None, "view", zero), (3, "view", None), (-5, "view", datetime.datetime(1969, 12, 31, 23, 59, 59)), (-5, "click", datetime.datetime(1970, 1, 1, 0, 14, 59)), (-5, "view", datetime.datetime(1970, 1, 1, 0, 29, 59, 1))]
    rows += rows[:50]
    want = plain_funnel(rows, queries.FUNNELS, 15 * funnel.MINUTE)
    assert want["A", -5][:2] == (2, 1) and want["A", -5][2] == 0
    got = funnel.count(spark.createDataFrame(rows, EVENTS).repartition(7), queries.FUNNELS)
    columns = ["n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
    assert {(r["funnel"], r["client_id"]): tuple(r[c] for c in columns) for r in got.collect()} == want


def test_groups_that_fill_whole_batches():
    """Batches are cut at the ends of groups only, however long a group is."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sizes = [1, 250, 3, 1, 900, 2, 40, 1]
    client = np.repeat(np.arange(len(sizes)), sizes)
    whole = [client, client * 2, np.arange(len(client)), rng.integers(0, 9, len(client)), np.ones(len(client), np.int64)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 37]) for c in whole], names=list("abcde")) for i in range(0, len(client), 37)]
    got = list(funnel.whole_groups(iter(batches), rows=100))
    assert all((np.concatenate([g[i] for g in got]) == whole[i]).all() for i in range(5))
    ends = [set(g[0].tolist()) for g in got]
    assert len(got) > 2 and all(not a & b for i, a in enumerate(ends) for b in ends[i + 1 :])


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[list(cut(v)[p]) for _, v, _ in kept[:entries]] for p in range(parts)]
    distance = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    best = lambda x, p: min(range(len(books[p])), key=lambda e: (distance(x, books[p][e]), e))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                groups[p, best(x, p)].append(x)
        for (p, e), xs in groups.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = [(i, "".join(f"{best(x, p):02x}" for p, x in enumerate(cut(v))), sum(distance(x, books[p][best(x, p)]) for p, x in enumerate(cut(v))), label) for i, v, label in kept]
    sums = collections.Counter()
    for _, _, error, label in out:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=str)


@pytest.mark.parametrize(("n", "entries"), [(300, 20), (5, 256)])
def test_codes_against_plain_loops(spark, n, entries):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=12)], int(rng.integers(3))) for i in rng.permutation(n)]
    rows += [(rows[0][0], rows[1][1], None), (None, rows[2][1], None), (10**6, [0.0] * 12, 1), rows[3], rows[3]]
    rows += [(-1, None, 1), (-2, [float("nan")] + [0.0] * 11, 1), (-3, [float("inf")] * 12, 1), (-4, [None] + [1.0] * 11, 1)]
    got = codes.compress(spark.createDataFrame(rows, VECTORS).repartition(6), entries=entries)
    assert sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in got.collect()), key=str) == plain_codes(rows, 4, entries, codes.ROUNDS)


def test_codes_ties_and_vectors_left_out(spark):
    same = [(i, [1.0, -1.0, 0.5, 2.0], 0) for i in range(9)]
    odd = [(-9, [], 0), (20, [1.0] * 3, 0), (21, [1.0] * 8, 0), (22, [1e30, 0.0, 0.0, 0.0], 0)]
    got = codes.compress(spark.createDataFrame(same + odd, VECTORS)).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(9))
    assert {(r["code"], r["error"], r["label_error"]) for r in got} == {("00000000", 0, 0)}
    books = codes.train(spark.createDataFrame(same, VECTORS))
    assert codes.decode("00000000", books) == [1024, -1024, 512, 2048]


def test_plans(spark):
    text = queries.op11_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))
    assert text.count("Exchange hashpartitioning") == 1
