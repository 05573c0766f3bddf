from collections import defaultdict

from shelfwatch.llm import chat

ROWS = [(1, 0, "ann", "hello"), (1, 1, "bob", "hi <|end|> there"), (1, 2, "ann", None), (1, 3, None, "who"), (1, None, "cat", "late"),
        (1, 1, "bob", "hi <|end|> there"), (2, 0, "system", "rules"), (3, 0, "system", "be kind"), (3, 1, "user", "q"), (3, 2, "assistant", "a"),
        (None, 5, "user", "x"), (4, 0, "", "nobody"), *[(5, i, f"p{i % 3}", f"say {i}") for i in range(200)]]


def brute(rows):
    by = defaultdict(list)
    for conv, turn, who, text in rows:
        turn = (1 << 63) - 1 if turn is None else turn
        by[conv].append((turn, not who, (who or "").replace("<|", "< |"), (text or "").replace("<|", "< |")))
    out = set()
    for conv, turns in by.items():
        for me in {w for _, _, w, _ in turns if w and w != "system"}:
            parts = defaultdict(list)
            for t in sorted(turns):
                parts[t[0] // chat.PART_TURNS].append(t)
            for part, said in parts.items():
                text, masks = "", []
                for _, _, who, line in said:
                    text += "<|system|>\n" if who == "system" else "<|assistant|>\n" if who == me else f"<|user|> {who}\n" if who else "<|user|>\n"
                    if who == me:
                        masks.append((len(text), len(text) + len(line) + len(chat.END)))
                    text += line + chat.END
                out.add((conv, me, part, len(said), text, tuple(masks)))
    return out


def test_every_participant_is_the_assistant_once(spark):
    turns = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, speaker string, part int")
    got = [(r["conv_id"], r["speaker"], r["part"], r["n_turns"], r["text"], tuple((m["start"], m["stop"]) for m in r["masks"]))
           for r in chat.perspectives(turns).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ROWS)
    assert all(r[4][a:b].endswith(chat.END) for r in got for a, b in r[5])
    assert {r[0] for r in got if r[0] in (2, 4)} == set()
    assert chat.perspectives(turns.limit(0)).count() == 0
