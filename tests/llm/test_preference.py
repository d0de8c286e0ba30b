from docloom.llm import preference as P

TURNS = "pair_id long, turn long, role string, text string, prompt string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], TURNS)


def shown(*turns):
    return "".join(f"<|{r}|>\n{t}\n" for r, t in turns)


def test_common_turns_are_rendered_once(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "good")]
    rejected = [*chosen[:3], (1, 3, "assistant", "bad"), (1, 4, "user", "why"), (1, 5, "assistant", "so")]
    row = P.format_pairs(frame(spark, chosen[::-1]), frame(spark, rejected)).first()
    assert row.n_prompt_turns == 3 and row.prompt == shown(("user", "q"), ("assistant", "a"), ("user", "r"))
    assert row.chosen == shown(("assistant", "good"))
    assert row.rejected == shown(("assistant", "bad"), ("user", "why"), ("assistant", "so"))
    learned = [row.rejected[s.begin : s.end] for s in row.rejected_spans]
    assert learned == ["bad\n", "so\n"] and [row.chosen[s.begin : s.end] for s in row.chosen_spans] == ["good\n"]


def test_edge_rows(spark):
    chosen = [(1, 0, "user", "same"), (2, 0, "user", "only chosen"), (None, 0, None, None), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, "a", None)]
    rejected = [(1, 0, "user", "same"), (None, 0, None, None), (3, 0, "user", "x"), (5, None, "assistant", "alone"), (4, 0, "a", "")]
    got = {r.pair_id: r for r in P.format_pairs(frame(spark, chosen), frame(spark, rejected)).collect()}
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == (shown(("user", "same")), "", "")
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].rejected) == (0, "", "")
    assert got[None].n_prompt_turns == 1 and got[None].prompt == "<||>\n\n"
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == (shown(("user", "x")), shown(("user", "x")), "")
    assert got[4].n_prompt_turns == 0 and got[4].chosen == got[4].rejected == shown(("a", ""))
    assert got[5].rejected == shown(("assistant", "alone"))
    none = frame(spark, [])
    assert P.format_pairs(none, none).count() == 0


def test_long_conversations(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", "t" * i) for i in range(300)]
    row = P.format_pairs(frame(spark, turns), frame(spark, turns[:-1])).first()
    assert row.n_prompt_turns == 299 and len(row.chosen_spans) == 1 and row.rejected == ""
