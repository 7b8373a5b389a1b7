import itertools
import random
import re

from tideframe.llm import chat

LEGAL = re.compile(r"(s)?(ua)+")


def cheapest(codes):
    """Brute force: every choice of emitted role, merge and insertions for each turn, as a search over whole outputs."""
    best = {("", None): 0}
    for code in codes:
        new = {}
        for (text, last), cost in best.items():
            for chain in itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(4)):
                base = text + "".join(chain)
                at = chain[-1] if chain else last
                for role in "sua":
                    label = 0 if code == role else chat.UNKNOWN if code is None else chat.RELABEL
                    for merged in (False, True):
                        if merged and (chain or at != role):
                            continue
                        done = base if merged else base + role
                        if not re.fullmatch(r"s?(ua)*u?", done):
                            continue
                        total = cost + chat.INSERT * len(chain) + label + chat.MERGE * merged
                        if total < new.get((done, role), 1 << 30):
                            new[done, role] = total
        best = new
    out = 1 << 30
    for (text, _), cost in best.items():
        for chain in itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(3)):
            if LEGAL.fullmatch(text + "".join(chain)):
                out = min(out, cost + chat.INSERT * len(chain))
    return out


def test_cost_is_least_and_result_legal():
    code = {"s": 1, "u": 2, "a": 3, None: None}
    names = {"s": "system", "u": "user", "a": "assistant", None: "tool"}
    assert code["s"] == chat.SYSTEM
    for n in (1, 2, 3, 4):
        for roles in itertools.product(["s", "u", "a", None], repeat=n):
            rows = chat.repaired([(i, names[r], f"t{i}") for i, r in enumerate(roles)], chat.START, None, 0, True)
            assert sum(r[5] for r in rows) == cheapest(roles), roles
            turns = "".join(r[3][0] for r in rows if "merge" not in r[4])
            assert LEGAL.fullmatch(turns)
            assert [r[6] for r in rows if r[4] != "insert"] == [f"t{i}" for i in range(n)]


def sample():
    rng = random.Random(5)
    rows = []
    for conv in [*range(30), None]:
        for i in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([i, i, None]), rng.choice(["system", "user", "assistant", "User ", "tool", None]), rng.choice([None, "", f"text {i}", "long " * 500])))
    rows += [(99, i, rng.choice(["user", "assistant", None]), f"x{i}") for i in range(800)]
    rows += [(77, 1, "user", "same")] * 40
    return rows


def test_result_does_not_depend_on_partitioning(spark):
    rows = sample()
    frames = []
    for parts in (1, 5, 23):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seq string")
        got = [tuple(r) for r in chat.repair(turns).collect()]
        frames.append(sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3])))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert frames[0] == frames[1] == frames[2]
    pieces = spark.createDataFrame(frames[0], "conv_id long, turn long, seq long, sub long, role string, action string, cost long, text string, rendered string")
    for r in chat.render(pieces).collect():
        assert re.fullmatch(r"(<\|im_start\|>system\n[^<]*<\|im_end\|>\n)?(<\|im_start\|>user\n[^<]*<\|im_end\|>\n<\|im_start\|>assistant\n[^<]*<\|im_end\|>\n)+", r.rendered)
    n = sum(r[5] != "insert" for r in frames[0])
    assert n == len(rows)


def test_whole_table_against_one_conversation_at_a_time(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    by = {}
    for r in sorted(table.collect(), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {(c, *row) for c, turns in by.items() for row in chat.repaired(turns, chat.START, None, 0, True)}
    assert {tuple(r) for r in chat.op3_chat_repair(spark, "/root/testdata/sf0.001").collect()} == want


def test_empty_table(spark):
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_very_long_texts_pass_whole(spark):
    long = "word " * 400_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "end"), (2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    rows = {(r.conv_id, r.turn): r for r in chat.repair(turns).collect() if r.action != "insert"}
    assert rows[1, 0].text == long and rows[1, 1].text == long + "end" and len(rows) == 3
