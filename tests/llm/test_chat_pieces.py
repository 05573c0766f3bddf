from collections import defaultdict

from shelfwatch.llm import chat


def test_repeated_and_missing_turn_numbers_are_cut_by_position(spark):
    rows = [(None, i % 8, "user" if i % 2 else "assistant", f"say {i:04}") for i in range(700)]
    rows += [(1, None, "user", f"late {i:04}") for i in range(150)] + [(1, None, "user", "same")] * 100 + [(1, 3, "bot", "first")]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert max(r["n_turns"] for r in got) == chat.PART_TURNS
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["part"], r["piece"])):
        by[r["conv_id"], r["speaker"]].append(r)
        assert all(r["text"][m["start"]:m["stop"]].endswith(chat.END) for m in r["masks"])
    assert set(by) == {(None, "user"), (None, "assistant"), (1, "user"), (1, "bot")}
    for (conv, speaker), parts in by.items():
        turns = sorted((9999 if t is None else t, who, text) for c, t, who, text in rows if c == conv)
        want = "".join(f"<|assistant|>\n{x}{chat.END}" if who == speaker else f"<|user|> {who}\n{x}{chat.END}" for _, who, x in turns)
        assert "".join(r["text"] for r in parts) == want
        assert sum(len(r["masks"]) for r in parts) == sum(who == speaker for _, who, _ in turns)


def test_offsets_join_the_parts(spark):
    rows = [(1, 0, "system", "rules")] + [(c, i, f"p{i % 3}", f"say {i}") for c in (1, None) for i in range(1, 200)]
    rendered = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    starts = {tuple(r)[:4]: r["offset"] for r in chat.offsets(rendered).collect()}
    got = sorted(rendered.collect(), key=lambda r: r["part"])
    for conv, speaker in {(r["conv_id"], r["speaker"]) for r in got}:
        parts = [r for r in got if (r["conv_id"], r["speaker"]) == (conv, speaker)]
        whole = "".join(r["text"] for r in parts)
        assert len(parts) == 4
        for r in parts:
            at = starts[conv, speaker, r["part"], r["piece"]]
            assert whole[at:at + len(r["text"])] == r["text"]
            assert all(whole[at + m["start"]:at + m["stop"]].startswith("say ") for m in r["masks"])
