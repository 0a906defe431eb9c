"""Repairs cost no more than the cheapest of all repairs, and the rendering is legal."""

import itertools
import re

from marginalia.llm import chat

TURN = re.compile(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", re.S)


def cheapest(roles):
    """Cost of the best repair, by trying every assignment of roles, merges and insertions."""
    states = {chat.START: 0.0}
    for role in roles:
        after = {}
        for s, c in states.items():
            for new in ("system", "user", "assistant"):
                named = 0 if role == new else chat.RELABEL if role in chat.ROLES else chat.UNKNOWN
                x = chat.ROLES[new]
                options = [c + named] if x in chat.LEGAL[s] else []
                options += [c + named + chat.MERGE] if x == s else []
                options += [c + named + chat.INSERT for e in (chat.USER, chat.ASSISTANT) if e in chat.LEGAL[s] and x in chat.LEGAL[e]]
                for o in options:
                    after[x] = min(o, after.get(x, o))
        states = after
    return min(c + chat.END_COST[s] for s, c in states.items())


def price(rows):
    total = 0
    for r in rows:
        for a in r.action.split("+"):
            total += {"keep": 0, "merge": chat.MERGE, "insert": chat.INSERT}.get(a, 0)
            if a == "relabel":
                total += chat.RELABEL if r.role in chat.ROLES else chat.UNKNOWN
            if a == "complete":
                total += chat.INSERT * (2 if r.repaired_role == "system" else 1)
    return total


def check(rows, roles, texts):
    rows = sorted(rows, key=lambda r: r.position)
    whole = "".join(r.fragment for r in rows)
    turns = TURN.findall(whole)
    assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) == whole
    names = [r for r, _ in turns]
    assert re.fullmatch(r"(system )?(user assistant )+", "".join(n + " " for n in names)), names
    assert price(rows) == cheapest(roles)
    at = 0
    for t in texts:
        at = whole.index(t, at) + len(t)


def frame(spark, conversations):
    rows = [(c, k, r, f"t{c}_{k}") for c, roles in enumerate(conversations) for k, r in enumerate(roles)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def by_conversation(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.conv_id, []).append(r)
    return out


def test_all_short_sequences(spark):
    roles = ["system", "user", "assistant", "tool", None]
    conversations = [list(s) for n in (1, 2, 3, 4) for s in itertools.product(roles, repeat=n)]
    got = by_conversation(chat.repair(frame(spark, conversations)))
    assert len(got) == len(conversations)
    for c, s in enumerate(conversations):
        check(got[c], s, [f"t{c}_{k}" for k in range(len(s))])


def test_conversation_over_many_tasks(spark):
    long = (["system", "user", "user", "assistant", "tool"] * 400)[:1999]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    try:
        got = by_conversation(chat.repair(frame(spark, [["user"], long, ["assistant"]])))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert len({r.position >> 33 for r in got[1]}) > 1
    for c, s in enumerate([["user"], long, ["assistant"]]):
        check(got[c], s, [f"t{c}_{k}" for k in range(len(s))])


def test_edge_rows(spark):
    rows = [(None, None, None, None, 1), (None, None, None, None, 1), (1, 0, "user", "", 1), (1, 0, "user", "x" * 300_000 + "<|im_end|>", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    got = by_conversation(chat.repair(df))
    assert len(got[None]) == 2 and len(got[1]) == 2
    assert sum(r.fragment.count("<|im_end|>") for r in got[1]) == 2  # one user turn, one empty answer
    assert chat.repair(df.limit(0)).count() == 0
