from lodeworks.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segment string"


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", __import__("hashlib").md5((r[3] or "").encode()).hexdigest()))
        for who in {r[2] for r in turns} - {None, "system"}:
            at = 0
            for k, (_, turn, role, text) in enumerate(turns):
                head = "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user:{role or 'unknown'}|>\n"
                seg = head + (text or "") + "\n"
                mask = (at + len(head), at + len(seg)) if role == who else (None, None)
                out.append((conv, who, turn, k, role, seg, at, len(seg), *mask))
                at += len(seg)
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hallo é"), (1, 2, "bob", "yes\nno"), (1, 3, "ann", None), (1, 3, "ann", "tie"), (1, 3, "ann", "tie")]
    rows += [(2, None, "ann", "early"), (2, 5, None, "who"), (3, 0, "system", "alone"), (None, 1, "cy", "lost"), (None, 2, "ann", "found")]
    rows += [(4, k, "ann" if k % 3 else "bob", "t" * (k % 7)) for k in range(1100)] + [(5, -300, "ann", "x"), (5, 0, "ann", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, chat.perspectives(df).collect()), key=str)
    assert got == plain(rows)
    assert chat.perspectives(df.limit(0)).count() == 0
