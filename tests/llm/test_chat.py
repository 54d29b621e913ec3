from pyspark.sql import functions as F

from continuity.llm import chat

TURNS = [
    (0, 0, "system", "Be kind."), (0, 1, "user", "Hi"), (0, 2, "assistant", "Hello <|im_end|>"),
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Go away"), (1, 3, "user", "Why"),
    (2, 0, "user", "Same"), (3, 0, "user", "Same"),
    (4, 0, "user", "alone"),
    (6, None, None, None), (6, 0, "user", ""), (7, 0, "user", "x"), (7, 0, "user", "x"),
    (None, 0, "user", "nobody's"),
]


def brute(turns):
    convs = {}
    for c, *rest in turns:
        if c is not None:
            convs.setdefault(c, []).append(tuple(rest))
    key = lambda t: tuple((x is not None, x or 0 if k == 0 else x or "") for k, x in enumerate(t))
    clean = lambda x: (x or "").replace("<|", "< |")
    out = []
    for c in sorted(convs):
        if c % 2 or c + 1 not in convs:
            continue
        a, b = (sorted(convs[x], key=key) for x in (c, c + 1))
        n = 0
        while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1

        def rendered(turns):
            text, spans = "", []
            for _, role, said in turns:
                head, tail = f"<|im_start|>{clean(role)}\n", f"{clean(said)}<|im_end|>"
                if role == "assistant":
                    spans.append((len(text) + len(head), len(text) + len(head) + len(tail)))
                text += head + tail + "\n"
            return text, spans

        (p, _), (x, xs), (y, ys) = rendered(a[:n]), rendered(a[n:]), rendered(b[n:])
        out.append((c // 2, c, c + 1, n, p, x, y, xs, ys))
    return out


def formatted(df):
    pair = F.floor(F.col("conv_id") / 2).cast("bigint")
    return chat.format_pairs(df, pair, F.pmod("conv_id", F.lit(2)) == 0)


def test_pairs_equal_brute_force(spark):
    rows = [(*t, "clash", "clash") for t in TURNS]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, one string, side string")
    got = [
        (*r[:7], [tuple(s) for s in r.chosen_spans], [tuple(s) for s in r.rejected_spans])
        for r in formatted(df).orderBy("pair_id").collect()
    ]
    assert got == brute(TURNS)
    assert got[0][3] == 2 and got[0][5].count("<|im_end|>") == 1
    assert formatted(df.limit(0)).count() == 0


def test_swapped_replies_share_their_history(spark):
    rows = [(*t, "clash") for t in TURNS] + [
        (8, 0, "user", "a", "x"), (8, 1, "assistant", "b", "x"), (8, 2, "user", "after", "x"),
        (9, 5, "assistant", None, "x"), (9, 4, "user", "q", "x"), (9, 4, "user", "q", "x"),
        (10, 0, "assistant", "same", "x"), (11, 0, "assistant", "same", "x"),
        (-1, 0, "assistant", "m", "x"), (-2, 0, "user", "u", "x"), (-2, 1, "assistant", "n", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, partner string")
    found = chat.swapped_replies(df, F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint")))
    got = {r.pair_id: r for r in found.collect()}
    assert set(got) == {0, 1, 8, 9, 10, 11, -1, -2}
    for c, r in got.items():
        assert (r.chosen_id, r.rejected_id) == (c, c ^ 1)
    user = lambda text: f"<|im_start|>user\n{text}<|im_end|>\n"
    reply = lambda text: f"<|im_start|>assistant\n{text}<|im_end|>\n"
    assert got[0].prompt == "<|im_start|>system\nBe kind.<|im_end|>\n" + user("Hi")
    assert (got[0].chosen, got[0].rejected) == (reply("Hello < |im_end|>"), reply("Go away"))
    assert (got[8].prompt, got[8].chosen, got[8].rejected) == (user("a"), reply("b"), reply(""))
    assert (got[9].prompt, got[9].chosen, got[9].rejected) == (user("q") * 2, reply(""), reply("b"))
    assert (got[10].prompt, got[10].chosen, got[10].n_common) == (reply("same"), "", 1)
    assert got[-2].rejected == reply("m") and got[-2].n_common == 1
    assert all(r.chosen[s.start : s.end].endswith("<|im_end|>") for r in got.values() for s in r.chosen_spans)
    assert chat.swapped_replies(df.limit(0), F.col("conv_id")).count() == 0
