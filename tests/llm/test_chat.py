from foliant.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, rendered string"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or ""))
        for who in {r[2] or "unknown" for r in said} - {"system"}:
            text, mask = "", []
            for _, _, role, body, _ in said:
                role, body = role or "unknown", body or ""
                text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user:{role}|>\n"
                start = len(text)
                text += body + "<|end|>\n"
                if role == who:
                    mask.append((start, len(text)))
            out[conv, who] = (text, mask)
    return out


def test_every_speaker_is_assistant_once(spark):
    rows = [(1, 0, "system", "be kind", "z"), (1, 1, "anna", "hé", "z"), (1, 2, "bob", None, "z"), (1, 3, "anna", "you", "z"), (1, 3, "anna", "you", "z"), (2, None, None, "x", "z"), (None, 1, "c", "y", "z"), (3, 0, "system", "alone", "z")]
    got = chat.perspectives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.conv_id, r.perspective): (r.rendered, list(zip(r.mask_starts, r.mask_ends, strict=True))) for r in got} == {k: v for k, v in brute(rows).items()}
    assert all(r.n_chars == len(r.rendered) and r.n_masked == sum(b - a for a, b in zip(r.mask_starts, r.mask_ends, strict=True)) for r in got)


def test_long_dialogues_come_in_parts(spark):
    rows = [(1, i, "ab"[i % 2], f"turn {i}", None) for i in range(400)]
    got = chat.perspectives(spark.createDataFrame(rows, SCHEMA)).orderBy("part").collect()
    assert len(got) == 8
    want, mask = brute(rows)[1, "a"]
    assert "".join(r.rendered for r in got if r.perspective == "a") == want
    whole = [r for r in chat.whole_parts(chat.perspectives(spark.createDataFrame(rows, SCHEMA))).orderBy("part").collect() if r.perspective == "a"]
    assert all(want[r.first_char : r.first_char + r.n_chars] == r.rendered for r in whole)
    assert [(r.first_char + a, r.first_char + b) for r in whole for a, b in zip(r.mask_starts, r.mask_ends, strict=True)] == mask


def test_native_and_empty(spark):
    out = chat.perspectives(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_null_and_repeated_turns_come_in_pieces(spark):
    rows = [(1, None, "ab"[i % 2], f"null {i:04}", None) for i in range(700)] + [(1, 5, "abc"[i % 3], f"five {i:04}", None) for i in range(500)] + [(None, 7, "a", "same", None)] * 300
    pieces = chat.perspectives(spark.createDataFrame(rows, SCHEMA))
    got = pieces.orderBy("part", "piece").collect()
    assert max(r.n_turns for r in got) <= chat.PART
    want = brute(rows)
    assert {k: "".join(r.rendered for r in got if (r.conv_id, r.perspective) == k) for k in want} == {k: text for k, (text, _) in want.items()}
    whole = chat.whole_parts(pieces).collect()
    assert len(whole) == len(want)
    for r in whole:
        text, mask = want[r.conv_id, r.perspective]
        assert (r.rendered, list(zip(r.mask_starts, r.mask_ends, strict=True)), r.n_chars) == (text, mask, len(text))
        assert r.n_masked == sum(b - a for a, b in mask)
