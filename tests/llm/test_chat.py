import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remitspark.llm import chat

SCHEMA = "conv_id long, seq long, message string, step long, turn long, kind string, role string, text string, part int, whole string"


def plain_fold(events):
    """Event by event over one conversation's sorted log: {message: (turn, at, role, text)}."""
    open_ = {}
    for seq, message, turn, kind, role, text in events:
        if kind == "start":
            open_[message] = [turn, seq, role or "", text or ""]
        elif message in open_:
            open_[message][3] = open_[message][3] + (text or "") if kind == "delta" else text or ""
        if kind == "regenerate":
            open_ = {m: x for m, x in open_.items() if x[0] <= turn}
    return {m: tuple(x) for m, x in open_.items()}


def log_rows(events):
    return [(c, seq, m, 0, turn, kind, role, text, 7, "x") for c, seq, m, turn, kind, role, text in events]


def random_log(rng, conv, n):
    out = []
    for seq in range(n):
        turn = rng.randrange(6)
        kind = rng.choices(["start", "delta", "edit", "regenerate"], [3, 8, 2, 1])[0]
        out.append((conv, seq, f"m{turn}", turn, kind, rng.choice(["user", "assistant"]), rng.choice(["a", "bc ", "", None, "é#"])))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_fold_is_the_same_however_the_log_is_cut(spark, partitions):
    rng = random.Random(partitions)
    # one conversation holds most events, so it goes over many partitions
    events = random_log(rng, 1, 400) + random_log(rng, None, 30) + [e for c in range(2, 8) for e in random_log(rng, c, 12)]
    rows = log_rows(events)
    rng.shuffle(rows)
    got = chat.fold_log(spark.createDataFrame(rows, SCHEMA).repartition(4), partitions=partitions).collect()
    want = {(c, m): x for c in {e[0] for e in events} for m, x in plain_fold([e[1:] for e in events if e[0] == c]).items()}
    assert {(r["conv_id"], r["message"]): (r["turn"], r["at"], r["role"], r["text"]) for r in got} == want and len(got) == len(want)


def test_edit_regenerate_and_events_that_come_too_late(spark):
    e = [
        (1, 0, "q", 0, "start", "user", "Hi"), (1, 1, "a", 1, "start", "assistant", "He"), (1, 2, "a", 1, "delta", None, "llo"), (1, 3, "q2", 2, "start", "user", "more"),
        (1, 4, "q", 0, "edit", None, "Hi!"), (1, 5, "a", 1, "regenerate", None, ""), (1, 6, "a", 1, "delta", None, "Good day"), (1, 7, "q2", 2, "delta", None, " late"), (1, 8, "z", 9, "delta", None, "?"),
    ]
    got = {r["message"]: r["text"] for r in chat.fold_log(spark.createDataFrame(log_rows(e), SCHEMA)).collect()}
    assert got == {"q": "Hi!", "a": "Good day"}
    with pytest.raises(Exception, match="unknown kind"):
        chat.fold_log(spark.createDataFrame(log_rows([(1, 0, "q", 0, "shout", "user", "x")]), SCHEMA)).count()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab:#\\/<>t\n ", max_size=12), st.text(alphabet="#\\/<>turn:é \n", max_size=30)), max_size=5))
def test_round_trip(turns):
    out = [chat.rendered(r, t, learn=("a",)) for r, t in turns]
    assert chat.parsed("".join(x for x, _ in out)) == turns
    for (r, t), (x, span) in zip(turns, out):
        body = x[span[0]: span[1]] if span else chat.escaped(t)
        assert chat.unescaped(body) == t and "</" not in body and "##" not in body and (span is not None) == (r == "a")


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv], key=lambda y: (y[0] is not None, y[0] or 0))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        size = sum(len(chat.rendered(r, x)[0]) for _, r, x in turns)
        out.append((conv, len(turns), sha, len(learned), hashlib.sha256(learned.encode()).hexdigest(), size))
    return sorted(out, key=repr)


def chats(spark, rows):
    full = [(*r, "x", "y", 1) for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, message string, kind string, step int").repartition(3)


@pytest.mark.parametrize("piece, partitions", [(1 << 20, None), (50, 7), (1, 2)])
def test_table_to_digests(spark, piece, partitions):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 3, "assistant", "late"), (1, 1, "user", None), (1, None, "system", "first"), (1, 2, None, "no role")]
    rows += [(2, 0, "user", "long " * 50_000), (2, 1, "assistant", "é \n#" * 3000), (3, 0, "user", ""), (None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    rows += [(4, 0, "user", "again"), (4, 0, "user", "again"), (4, 1, "assistant", "tw\tice")]
    rows += [(5, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 9)) for i in range(300)]
    rows += [(10 + i, j, ("user", "assistant")[j % 2], f"</turn>{i} {j}") for i in range(40) for j in range(2)]
    made = chat.format_chats(chat.fold_log(chat.as_log(chats(spark, rows), delta=64), partitions=partitions), piece=piece, partitions=partitions)
    got = sorted((tuple(r) for r in chat.read_back(made).collect()), key=repr)
    assert got == expected(rows)
    texts = {}
    for r in sorted(made.collect(), key=lambda r: (str(r["conv_id"]), r["piece"])):
        texts.setdefault(r["conv_id"], []).append((r["piece"], r["formatted"]))
    assert all([p for p, _ in x] == list(range(len(x))) for x in texts.values())
    assert [(a, b) for a, b in chat.parsed("".join(t for _, t in texts[-7]))] == [("user", said), ("assistant", said)]


def test_rows_of_one_turn_stay_apart_and_in_one_order(spark):
    rows = [(1, 0, "user", x) for x in ("b", "a", "a", "c")]
    a, b = (chat.read_back(chat.format_chats(chat.fold_log(chat.as_log(chats(spark, r))))).collect()[0] for r in (rows, rows[::-1]))
    assert a == b and a["n_turns"] == 4


def test_no_rows(spark):
    assert chat.read_back(chat.format_chats(chat.fold_log(chat.as_log(chats(spark, []))))).count() == 0
