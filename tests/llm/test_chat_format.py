"""Preference pairs against a loop over the turns."""

import random

from recollect.llm.chat_format import neighbours, preference_pairs


def show(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def brute(conversations):
    out = {}
    for pair in {i // 2 for i in conversations}:
        a, b = conversations.get(2 * pair), conversations.get(2 * pair + 1)
        n = 0
        while a and b and n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        sides = []
        for side in (a, b):
            if side is None:
                sides += [None, None]
                continue
            text, mask = "", []
            for role, said in side[n:]:
                start = len(text) + len(f"<|im_start|>{role}\n")
                text += show([(role, said)])
                if role == "assistant":
                    mask.append([start, len(text)])
            sides += [text, mask]
        out[pair] = (n, show((a or b)[:n]), *sides)
    return out


def test_against_a_loop(spark):
    r = random.Random(4)
    conversations = {}
    for pair in range(30):
        shared = [(r.choice(["user", "assistant", "system"]), r.choice(["hi", "ja é", "", "漢字 ok"])) for _ in range(r.randint(0, 4))]
        for k in (0, 1):
            if r.random() < 0.9:
                own = [(r.choice(["user", "assistant"]), r.choice(["x", "longer answer", "z"])) for _ in range(r.randint(0, 4))]
                if shared + own:
                    conversations[2 * pair + k] = shared + own
    rows = [(i, 10 * n, role, said, "extra") for i, turns in conversations.items() for n, (role, said) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string").repartition(7)
    got = {x["pair"]: (x["n_common"], x["prompt"], x["chosen_completion"], x["chosen_mask"], x["rejected_completion"], x["rejected_mask"]) for x in preference_pairs(neighbours(df)).collect()}
    assert got == brute(conversations)


def test_nulls_and_repeats(spark):
    rows = [(0, 0, None, None), (0, 0, None, None), (1, 0, "user", ""), (1, 1, "assistant", "yes"), (None, 0, "user", "x"), (2, None, "user", "x"), (5, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["pair"]: x for x in preference_pairs(neighbours(df)).collect()}
    assert set(got) == {0, 2}
    assert got[0]["n_common"] == 1 and got[0]["chosen_completion"] == "" and got[0]["chosen_mask"] == []
    assert got[0]["rejected_mask"] == [[22, 36]]
    assert got[2]["chosen_id"] is None and got[2]["chosen_completion"] is None and got[2]["chosen_mask"] is None and got[2]["n_common"] == 0
    assert preference_pairs(neighbours(df.limit(0))).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = preference_pairs(neighbours(spark.read.parquet(f"{sf}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
