"""Prefix trie, chat formatting and hard negatives against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from check import TABLES, compare
from tessera.llm import chat, hard_negatives, prefix_trie
from tessera.llm.common import table
from tessera.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, node int, at string"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_hard_negatives", "op13_chat"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) == ""


# --- prefix trie ------------------------------------------------------------------------------------

def gathered(rows) -> dict:
    convs: dict = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def plain_trie(rows) -> list:
    convs = gathered(r for r in rows if r[0] is not None)
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    nodes: dict = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    n_children = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            n_children[k[:-1]] += 1
    leaves, saved = {k: 0 for k in nodes}, {k: 0 for k in nodes}
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not n_children[k]
    ends = {k: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k)) for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), n_children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest())
                  for k, m in nodes.items())


def hot_turns() -> list:
    """A third of all turns in one conversation, many copies of another, one first turn for most, odd values."""
    rng = random.Random(5)
    rows = [(700, k // 2, "user", f"t{k % 7}", 1, "x") for k in range(400)]
    rows += [(c, t, "user", ["hello", "copy", "bye"][t], 1, "x") for c in range(1000, 1150) for t in range(3)]
    rows += [(c, t, rng.choice(["user", "assistant", None]), "hello" if t == 0 else rng.choice(["a", "b", None, "é" * 5]), 1, None)
             for c in range(0, 330, 3) for t in range(rng.randrange(1, 7))]
    rows += [(None, 1, "user", "lost", 1, "x"), (5, None, "user", "first", 1, "x"), (5, 1, "a", "tie", 1, "x"), (5, 1, "a", "tie", 1, "x"), (5, 1, "A", "tie", 1, "x"),
             (-7, 1, "user", "minus", 1, "x"), (-100, 1, "user", "lead", 1, "x"), (3_000_000_000_000, 1, "user", "w " * 400_000, 1, "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 8, "rest": 12}])
def test_trie_equals_brute_force(spark, options):
    rows = hot_turns()
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS), **options)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_trie(rows), key=str)


def test_ends_pass_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = hot_turns()
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_trie(rows), key=str)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "x")], TURNS)).collect() == []


def test_list_rank_of_scattered_lists(spark):
    rng = random.Random(2)
    ids = rng.sample(range(100_000), 3000)
    lists = [ids[:2000], ids[2000:2999], ids[2999:]]
    rows = [(a, b) for one in lists for a, b in zip(one, [*one[1:], None])]
    got = dict(map(tuple, prefix_trie.list_rank(spark.createDataFrame(rows, "id long, next long"), block=64, rest=40).collect()))
    assert got == {a: len(one) - k for one in lists for k, a in enumerate(one)}


# --- chat formatting ----------------------------------------------------------------------------------

PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "s>", " ", "\n", "INST]", "é", "/", "ROLE] ", " [/ROLE] ", "[\\INST]", "<\\\\s>"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]) | PARTS, PARTS), max_size=5), st.integers(1, 9))
def test_any_turns_come_back(turns, step):
    pieces = [chat.render(r, x) for r, x in turns]
    whole = "".join(p for p, _, _ in pieces)
    assert [t[:2] for t in chat.parse(whole)] == turns
    parser, got = chat.Parser(), []
    for at in range(0, len(whole), step):
        got += parser.feed(whole[at:at + step])
    parser.end()
    assert got == chat.parse(whole)
    assert [chat.unescape(whole[s:s + n]) for _, _, s, n in got if s >= 0] == [x for r, x in turns if r == "assistant"]
    assert all(chat._CONTROL.search(chat.escape(x)) is None for _, x in turns)


@pytest.mark.parametrize("text", ["x", "<s>[INST] a [/INST] b", "<s>[INST] a", "[OUT] a [/INST]", "[OUT] a</s>", "[ROLE] a [/ROLE]b [/TURN]", "[ROLE] a [/TURN]"])
def test_other_texts_are_unreadable(text):
    with pytest.raises(chat.Unreadable):
        chat.parse(text)


def test_only_conflicts_are_escaped():
    assert chat.render("user", "a \\ [x] <b>")[0] == "<s>[INST] a \\ [x] <b> [/INST]"
    assert chat.render("assistant", chat.HOSTILE) == ("[OUT] <\\/s>[\\INST] ok [\\/INST] </s>", 6, 24)


def plain_chat(rows) -> list:
    convs: dict = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault((c, False), []).append((t is not None, t or 0, r or "", x or ""))
    convs[-1, True] = [(True, 0, "user", chat.HOSTILE), (True, 1, "assistant", chat.HOSTILE)]
    out = []
    for (c, _), v in convs.items():
        turns = [(r, x) for _, _, r, x in sorted(v)]
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(chat.render(r, x)[0] for r, x in turns)
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
    return sorted(out, key=str)


def test_chat_equals_plain_on_odd_turns(spark):
    rows = [*hot_turns(), (-1, 0, "assistant", "own", 1, "x"), (None, None, None, None, 1, "x"), (8, 2, "assistant", "</s>", 1, "x"), (8, 1, "tool]", "[/ROLE] <\\s>", 1, "x")]
    df = spark.createDataFrame(rows, TURNS)
    assert sorted(map(tuple, chat.round_trip(df).collect()), key=str) == plain_chat(rows)
    assert [tuple(r) for r in chat.round_trip(df.limit(0)).collect()] == plain_chat([])


def test_texts_and_masks(spark):
    rows = [(1, 1, "user", "a", 1, "x"), (1, 2, "assistant", "</s>", 1, "x"), (1, None, "system", "s", 1, "x"), (2, 1, "user", "", 1, "x")]
    got = {r["key"]: r for r in chat.conversation_texts(chat.format_turns(spark.createDataFrame(rows, TURNS))).collect()}
    assert got[1]["text"] == "[ROLE] system [/ROLE] s [/TURN]<s>[INST] a [/INST][OUT] <\\/s> </s>"
    assert [got[1]["text"][m["start"]:m["start"] + m["length"]] for m in got[1]["masks"]] == ["<\\/s>"] and got[2]["masks"] == []


# --- hard negatives -------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, dim int, pivot string"


def plain_negatives(rows) -> list:
    known = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v], l) for i, v, l, *_ in rows
             if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    top, out = hard_negatives.LONGEST, []
    for a, va, la in known:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, l) for i, v, l in known if len(v) == len(va))
        for s, p in [(s, i) for s, i, l in scored if l == la and i != a][:5]:
            found = [(t, i) for t, i, l in scored if l != la and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k + 1, i, max(-top, min(top, -s)), max(-top, min(top, -t))) for k, (t, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("cells", [hard_negatives.BLOCK_CELLS, 12 * 60])
def test_negatives_equal_brute_force(spark, cells):
    rng = np.random.default_rng(11)
    centres = 2 * rng.standard_normal((9, 12))
    v = centres[rng.integers(0, 9, 900)] + 0.3 * rng.standard_normal((900, 12))
    v[100:400] = v[0]
    rows = [(i, x.tolist(), i % 4, 1, "x") for i, x in enumerate(v)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), block_cells=cells)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_negatives_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (100, [0.0, 0.0], 1), (200, [], 1), (300, [1e200, 1.0], 1), (400, None, 1), (500, [nan, 1.0], 1), (600, [1.0, None], 1), (700, [inf, 0.0], 1),
            (800, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (2, [1.0, 0.0], 2), (3, [0.9, 5.0], 2), (4, [0.5, 0.0], 2), (5, [-1.0, 0.0], 2),
            (6, [], 2), (7, [], 1), (8, [1.0], 1), (9, [1e200, 0.0], 2), (10, [1.0, 2.0, 3.0], 1), (11, [0.95, 1.0], 1), (12, [1.5e308, 0.0], 2)]
    rows = [(*r, 1, "x") for r in rows]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, hard_negatives.mine(df).collect()))
    # scores beyond 64 bits are all the largest long once they leave their block
    assert [r for r in got if r[0] != 300 and r[4] < hard_negatives.LONGEST] == [r for r in plain_negatives(rows) if r[0] != 300 and r[4] < hard_negatives.LONGEST]
    assert {r[:2] for r in got if r[4] == hard_negatives.LONGEST} >= {(0, 300)}
    assert hard_negatives.mine(df.limit(0)).collect() == []


def test_nodes_cover_their_members():
    rng = np.random.default_rng(1)
    v = np.floor(256 * np.vstack([rng.standard_normal((300, 6)), np.tile(rng.standard_normal(6), (80, 1))]))
    order, t = hard_negatives.cover_tree(v, np.arange(380) % 3)
    assert sorted(order.tolist()) == list(range(380))
    norms = (v * v).sum(axis=1)
    lifted = np.column_stack([v, np.sqrt(norms.max() - norms)])[order]
    for c, a, b, r, p in zip(*(t[k].tolist() for k in ("centre", "start", "end", "radius", "parent"))):
        assert a <= c < b and np.sqrt(((lifted[a:b] - lifted[c]) ** 2).sum(axis=1)).max() <= r + 1e-9
        assert p < 0 or (t["start"][p] <= a and b <= t["end"][p] and r <= t["radius"][p] / 2 + 1e-9)
    assert (t["end"] - t["start"])[t["leaf"]].sum() == 380


def test_the_index_skips_far_blocks(spark):
    """On clusters far apart an anchor meets its own cluster's blocks only, in both searches."""
    rng = np.random.default_rng(3)
    centres = 40 * np.eye(8)
    v = centres[np.arange(800) % 8] + 0.1 * rng.standard_normal((800, 8))
    df = spark.createDataFrame([(i, x.tolist(), i // 8 % 3, 1, "x") for i, x in enumerate(v)], VECTORS)
    rows = hard_negatives.usable(df, "vec_id", "embedding", "label")
    index = hard_negatives.Index(rows, 256, 8 * 20)
    from pyspark.sql import functions as F
    anchors = hard_negatives._routed(rows.filter("vec_id % 100 = 0"), index.tops, 256).withColumnRenamed("pivot", "own").withColumn("aid", F.col("vec_id"))
    asked = anchors.select("*", F.array(F.lit(256 ** 2 * 1200).cast("long")).alias("lows"), F.array(F.lit(hard_negatives.LONGEST)).alias("highs"))
    blocks = index.trees.count()
    assert blocks >= 40 and index.visits(asked, "all").count() <= blocks * 8 / 4
