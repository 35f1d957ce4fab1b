import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import preference, queries

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", None]), st.sampled_from(["a", "bé", "", "a\n", None])), max_size=5)


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def render(turns):
        text, spans = "", []
        for role, t in turns:
            text += f"<|{role or 'unknown'}|>\n"
            begin = len(text)
            text += f"{t or ''}<|end|>\n"
            if role == "assistant":
                spans.append((begin, len(text)))
        return text, spans

    return (n, render(a[:n])[0], *(x for y in (a[n:], b[n:]) for x in render(y)), n == len(a) == len(b))


def got(spark, pairs):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    out = preference.formatted(rows).orderBy("pair_id").collect()
    return [(r.n_prompt_turns, r.prompt, r.chosen, [tuple(s) for s in r.chosen_mask], r.rejected, [tuple(s) for s in r.rejected_mask], r.identical) for r in out]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(TURNS, TURNS), min_size=25, max_size=40))
def test_against_brute_force(spark, pairs):
    assert got(spark, pairs) == [brute(a, b) for a, b in pairs]


def test_edges(spark):
    assert got(spark, [(None, None), ([("user", "x")], None), ([("user", "x" * 100_000)] * 400, [("user", "x" * 100_000)] * 400)])[0] == (0, "", "", [], "", [], True)


def test_pairs_of_neighbours(spark):
    rows = [(2, 0, "user", "q", 1), (2, 1, "assistant", "a", 1), (2, 2, "user", "more", 1), (3, 0, "assistant", "b", 1), (4, 0, "assistant", "alone", 1), (6, 0, "user", "x", 1), (7, 0, "assistant", "y", 1), (None, 0, "assistant", "z", 1), (8, 1, "assistant", "t2", 1), (8, 1, "assistant", "t1", 1), (9, None, "assistant", None, 1), (9, None, "assistant", None, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chosen int")
    out = {r.pair_id: r for r in preference.formatted(preference.swapped_answers(turns)).collect()}
    assert sorted(out) == [2, 3, 8, 9]
    assert out[2].n_prompt_turns == 1 and "a<|end|>" in out[2].chosen and "b<|end|>" in out[2].rejected and "more" not in out[2].prompt + out[2].chosen
    assert preference.formatted(preference.swapped_answers(turns.limit(0))).count() == 0


def test_unpaired_conversations_can_be_kept(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "assistant", "b"), (4, 0, "user", "q"), (4, 1, "assistant", "alone"), (6, 0, "user", "x"), (7, 0, "assistant", "y"), (None, 0, "assistant", "z"), (8, 0, "assistant", None), (9, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = {r.pair_id: r.rejected for r in preference.swapped_answers(turns, unpaired=True).collect()}
    assert sorted(pairs) == [2, 3, 4, 7, 8, 9] and [k for k, v in sorted(pairs.items()) if v is None] == [4, 7]
    out = {r.pair_id: r for r in preference.formatted(preference.swapped_answers(turns, unpaired=True)).collect()}
    assert (out[4].n_prompt_turns, out[4].chosen, out[4].rejected, out[4].rejected_mask) == (0, "<|user|>\nq<|end|>\n<|assistant|>\nalone<|end|>\n", "", [])
    assert not out[4].identical and out[8].identical


def test_branches(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (0, 3, "assistant", "b"), (1, 0, "user", "q"), (1, 1, "assistant", "c"), (1, 2, "user", "left out"),
            (5, 0, "user", "q"), (5, 1, "assistant", "alone"), (6, 0, "user", "no answer"), (7, 0, "system", "s"), (7, 1, "user", "u"), (7, 2, "assistant", "v"), (-3, 0, "assistant", None), (-4, 0, "assistant", "x"), (None, 0, "assistant", "z")]
    turns = spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, pairing string")
    pairs = {r.pair_id: r for r in preference.branched(turns).collect()}
    plain = lambda x: x and "".join(t.text or "-" for t in x)
    assert {k: (r.pairing, plain(r.chosen), plain(r.rejected)) for k, r in pairs.items()} == {
        0: ("paired", "qarb", "qc"), 1: ("paired", "qc", "qarb"), 5: ("no_partner", "qalone", None), 6: ("no_answer", None, None), 7: ("no_partner", "suv", None), -3: ("paired", "-", "x"), -4: ("paired", "x", "-"),
    }
    out = {r.pair_id: r for r in preference.formatted(preference.branched(turns), keep=("pairing",)).collect()}
    assert out[0].n_prompt_turns == 1 and out[1].n_prompt_turns == 1 and out[6].pairing == "no_answer" and out[6].chosen == ""
    assert preference.branched(turns.limit(0)).count() == 0


def test_the_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for i in rnd.sample(range(60), 45):
        rows += [(i, k, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["a", "b", "été\n"])) for k in range(rnd.randint(1, 7))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    convs = {}
    for i, k, role, text in sorted(rows):
        convs.setdefault(i, []).append((role, text))
    cut = {i: c[: max([k + 1 for k, t in enumerate(c) if t[0] == "assistant"], default=0)] for i, c in convs.items()}
    want, masks = {}, lambda m: ",".join(f"{a}-{b}" for a, b in m)
    for i, a in cut.items():
        d, k = cut.get(i ^ 1, []), i % max(len(a), 1)
        b = a[:k] + d[min(k, len(d) - 1) :] if a and d else []
        n, prompt, ca, ma, cb, mb, same = brute(a, b)
        want[i] = ("paired" if a and d else "no_partner" if a else "no_answer", n, prompt, ca, cb, masks(ma), masks(mb), same)
    found = queries.op1_preference_pairs(spark, str(tmp_path)).collect()
    assert {r.pair_id: tuple(r)[1:] for r in found} == want and len({r.n_prompt_turns for r in found}) > 3
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in db.execute(queries.OP1_SQL).fetchall()} == want
