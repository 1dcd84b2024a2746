"""Conversations that span partitions, and rows repeated many times, against a plain Python version."""

from collections import Counter, defaultdict

from kilnflow.llm import chat

SCHEMA = "part int, conv_id long, turn long, role string, text string, k1 string, slice int"


def plain(rows):
    convs = defaultdict(list)
    key = lambda v: (v is not None, v if v is not None else 0)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text))
    turns = {c: tuple(x[1:] for x in sorted(t, key=lambda x: (key(x[0]), (x[1] is not None, x[1] or ""), (x[2] is not None, x[2] or "")))) for c, t in convs.items()}
    inner = {t[:k] for t in turns.values() for k in range(1, len(t))}
    same = defaultdict(list)
    for c, t in turns.items():
        same[t].append(c)
    show = lambda r, x: f"<|{'unknown' if r is None else r}|>\n{x or ''}\n<|end|>\n"
    return Counter((min(cs, key=key), len(t), len(cs), "".join(show(*x) for x in t)) for t, cs in same.items() if t not in inner)


def rows():
    hot = [(None, i, ("user", "assistant")[i % 2], f"turn {i % 50}" if i % 7 else None) for i in range(1500)]
    copies = [(5, None, None, None)] * 700 + [(5, 1, "user", "end")]
    snapshots = [(9, *r[1:]) for r in hot[:600]] + [(10, *r[1:]) for r in hot[:601]] + [(11, *r[1:]) for r in hot]
    other = [(12, *r[1:]) for r in hot[:599]] + [(12, 2000, "user", "leaves the others")]
    part_of_copies = [(6, None, None, None)] * 300
    return hot + copies + snapshots + other + part_of_copies + [(c, 0, "user", f"alone {c}") for c in range(20, 60)]


def test_long_conversations(spark):
    given = rows()
    df = spark.createDataFrame([(1, *r, "x", 1) for r in given], SCHEMA).repartition(5)
    got = Counter((r.conv_id, r.n_turns, r.n_same, r.chat) for r in chat.format_chats(df).collect())
    assert got == plain(given)
    assert {(c, n) for c, n, _, _ in got if n > 100} == {(None, 1500), (5, 701), (12, 600)}


def test_slices_make_up_the_chats(spark):
    given = rows()
    df = spark.createDataFrame([(1, *r, "x", 1) for r in given], SCHEMA)
    slices = chat.format_slices(df).collect()
    assert max(r.n_slices for r in slices) > 1
    joined = defaultdict(str)
    for r in sorted(slices, key=lambda r: r.slice):
        joined[r.conv_id, r.n_turns, r.n_same] += r.chat
    assert Counter((*k, v) for k, v in joined.items()) == plain(given)
    assert chat.format_slices(df.limit(0)).count() == 0
