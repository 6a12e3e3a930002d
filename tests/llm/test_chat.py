import hashlib
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pointweave.llm import chat
from pointweave.llm.queries import PROBE

SCHEMA = "conv_id long, turn long, role string, text string, window string, tokens int"


def conversations():
    rng = random.Random(2)
    rows = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE), (1, 0, "system", "only the system"), (2, 0, "assistant", None),
            (2, 1, "assistant", ""), (3, 0, None, "</turn>\n### a: \\s"), (3, None, "ro:le: x", "b"), (None, 0, "user", "a"), (None, 1, "assistant", "b"),
            (4, 0, "user", "x" * 200000), (4, 1, "assistant", "y" * 9000), (4, 2, "assistant", "z"),
            (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 1, "assistant", "same")]
    for c in range(10, 30):
        if c % 3:
            rows.append((c, 0, "system", "be good " * rng.randint(0, 40)))
        for t in range(1, rng.randint(2, 60)):
            rows.append((c, t, ["assistant", "user"][t % 2], "".join(rng.choice("ab #<\\\n") for _ in range(rng.randint(0, 900)))))
    return [(*r, "w", 1) for r in rows]


def test_windows_read_back_and_keep_to_the_budget(spark):
    rows = conversations()
    made = chat.windows(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = {}
    for c, turn, role, text, *_ in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    windows = {}
    for w in made.collect():
        windows.setdefault(w.conv_id, []).append(w)
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(w.text) for w in windows[c])
        for w in windows[c]:
            parts = w.text.split("</turn>\n")[:-1]
            bodies = [p.split(": ", 1)[1].replace("\\h", "#").replace("\\l", "<").replace("\\s", "\\") for p in parts]
            tokens = sum(-(-len(b) // 4) + 4 for b in bodies)
            assert tokens <= chat.BUDGET or len(parts) - w.n_repeated <= 1 + parts[0].startswith("### system")
            if turns[0][2] == "system":
                assert parts[0].startswith("### system: ")
    assert any(w.n_repeated > 1 for ws in windows.values() for w in ws)


def test_empty_table(spark):
    assert chat.digests(chat.windows(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="\\#<slhc: \n</turn>", max_size=20), min_size=1, max_size=30))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one = chat.escape(F.col("t"), chat._COLON)
    back = df.select("t", one.alias("e"), chat.unescape(one, chat._COLON).alias("u")).collect()
    assert all(r.t == r.u and "#" not in r.e and "<" not in r.e and ":" not in r.e for r in back)
