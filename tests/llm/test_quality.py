import random
import re
from collections import Counter

from foliant.llm import quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    seen, dup_lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            if line in seen:
                dup_lines += 1
                line_chars += sum(map(len, own))
            seen.add(line)
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup_lines, "dup_line_chars": line_chars}
    grams = lambda n: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    counts = Counter(grams(3))
    out["n_repeat_words"] = len({i + k for i, g in enumerate(grams(3)) if counts[g] > 1 for k in range(3)})
    for n in quality.LIMITS:
        earlier, covered = set(), set()
        for i, g in enumerate(grams(n)):
            if g in earlier:
                covered |= set(range(i, i + n))
            earlier.add(g)
        out[f"dup_{n}gram_chars"] = sum(len(words[i]) for i in covered)
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    out["kept"] = not out["base_failed"] and 100 * line_chars <= quality.LINE_LIMIT * chars and all(100 * out[f"dup_{n}gram_chars"] <= m * chars for n, m in quality.LIMITS.items())
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    vocabulary = [f"w{i}é" for i in range(30)] + ["#a", "*", "x<y>"]
    texts = [None, "", " \n\t\n", "one", "same line\nsame line\nsame line", "\n\n\x0bx\n\nx\n"]
    for _ in range(120):
        lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 14))) for _ in range(rnd.randint(1, 20))]
        texts.append("\n".join(lines + lines[: rnd.randint(0, 6)]))
    texts += [" ".join(f"u{i}" for i in range(k, k + 200)) for k in (0, 5)] + ["a b c d e f g " * 5000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "one", "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, quality string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in queries.op3_repetition(spark, str(tmp_path)).collect()]
    want = [{"doc_id": i, **brute(t)} for i, t, _ in rows]
    order = lambda d: (d["doc_id"], str(d))
    keys = set(want[0])
    assert sorted(({k: r[k] for k in sorted(keys)} for r in got), key=order) == sorted(({k: r[k] for k in sorted(keys)} for r in want), key=order)
    assert any(r["kept"] for r in got) and any(not r["kept"] and not r["base_failed"] for r in got)


def test_empty_table(spark):
    assert quality.repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0
