from knotwork.llm.preferences import format_pairs, preference_rows

SCHEMA = "conv_id long, turn long, role string, text string, chosen string, prompt int"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    last = {c: max((i for i, t in enumerate(ts) if t[0] == "assistant"), default=len(ts) - 1) for c, ts in turns.items()}
    out = []
    for c, a in sorted(turns.items()):
        o = c ^ 1 if c ^ 1 in turns else None
        b = a[: last[c]] + [("assistant", turns[o][last[o]][1] if o is not None else "")]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        show = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)

        def mask(ts):
            at, spans = 0, []
            for r, t in ts:
                start = at + len(r) + 5
                at = start + len(t) + 8
                spans += [f"{start}:{at}"] if r == "assistant" else []
            return ",".join(spans)

        out.append((c, o, n, show(a[:n]), show(a[n:]), show(b[n:]), mask(a[n:]), mask(b[n:])))
    return out


def run(df):
    return sorted((tuple(r) for r in preference_rows(df).collect()), key=lambda r: r[0])


def test_prefixes_masks_and_odd_rows(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good é𝒳"), (0, 2, "user", "more"), (0, 3, "assistant", "yes"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "good é𝒳"), (1, 2, "user", "less"),
        (2, 0, "user", "same"), (3, 0, "user", "same"),
        (4, 0, "user", None), (4, 0, None, "x"), (4, None, "assistant", ""), (5, 0, "user", "q" * 50_000), (5, 0, "user", "q" * 50_000),
        (6, 0, "user", "alone"), (None, 0, "user", "nobody"), (8, 0, "a", "b"), (9, 0, "a", "c"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert run(df) == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])


def test_most_prompts_hold_turns(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = preference_rows(df).collect()
    assert len(rows) == df.select("conv_id").distinct().count()
    assert all(r["prompt_turns"] > 0 and r["prompt"] for r in rows) and sum(r["prompt_turns"] > 2 for r in rows) > len(rows) / 3
    assert all(r["chosen"] != r["rejected"] and r["rejected_mask"] for r in rows)


def test_pairs_that_share_some_turns_all_turns_and_none(spark):
    turn = "struct<role:string,text:string>"
    rows = [(1, [("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "a"), ("assistant", "b"), ("user", "d")], "kept"), (2, [("user", "a")], [("user", "a")], None), (3, [("user", "a")], [("user", "b")], "x"), (4, None, [("user", "b")], "y"), (5, [("user", "a")], [("user", "a"), ("assistant", "z")], "w")]
    by = {r["id"]: r for r in format_pairs(spark.createDataFrame(rows, f"id int, chosen array<{turn}>, rejected array<{turn}>, note string")).collect()}
    assert [by[i]["prompt_turns"] for i in range(1, 6)] == [2, 1, 0, 0, 1] and [by[i]["note"] for i in (1, 2, 4)] == ["kept", None, "y"]
    assert by[2]["chosen_text"] == by[2]["rejected_text"] == "" and by[5]["chosen_text"] == "" and by[5]["rejected_text"] == "<|assistant|>\nz<|end|>\n"
