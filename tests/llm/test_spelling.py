import random
import re
import zlib
from collections import Counter

from layerframe.llm import spelling


def plain_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 6:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(rows):
    counts = plain_counts(rows)
    forms, nears = {}, {}
    for word, n in counts.items():
        others = [o for o in counts if near(word, o)]
        nears[word] = len(others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[word] = best if best and counts[best] >= 5 * n else None
    out = {}
    for word in counts:
        root = word
        while forms[root]:
            root = forms[root]
        out[word] = (forms[word], root, counts[word], nears[word], counts.get(forms[word]))
    return out


def random_rows(seed, n=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÉé÷zZ") for _ in range(rng.randint(5, 8))) for _ in range(12)]
    stems += ["aaaaaaa", "aaaaaa", "aaaaaaaa", "bbaaab", "x" * 70, "x" * 71, "x" * 69 + "y"]

    def word():
        w = stems[min(rng.randrange(19), rng.randrange(19))]
        if rng.random() < 0.3:
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", "a", "z", "É", w[i] + "b"]) + w[i + 1 :]
        return w

    rows = [(rng.choice([None, rng.randrange(99)]), " ,1"[rng.randrange(3)].join(word() for _ in range(30))) for _ in range(n)]
    chain = [(4, "chained " * 160), (5, "chaineds " * 30), (6, "chainedss " * 6)]
    return rows + [(1, None), (2, ""), (3, "... 12 İK")] + chain + rows[:20]


def groups(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n long, word string")
    got = spelling.spelling_groups(docs).collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def test_against_plain_python(spark, monkeypatch):
    for seed in (1,):
        rows = random_rows(seed)
        expected = plain_groups(rows)
        assert groups(spark, rows) == expected
        assert any(v[0] for v in expected.values()) and any(v[1] != v[0] != None for v in expected.values())  # noqa: E711
    # Small dictionaries in the tasks and small tasks change nothing.
    monkeypatch.setattr(spelling, "_MOST_HELD", 10)
    monkeypatch.setattr(spelling, "WORDS_A_TASK", 7)
    assert groups(spark, rows) == expected


def test_filters_out_of_room_give_the_same_pairs(spark, tmp_path):
    rows = [(w, n) for w, n in plain_counts(random_rows(3)).items()]
    spark.createDataFrame(rows, "word string, n long").write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    expected = {(a, b, n) for a, _ in rows for b, n in rows if near(a, b)}
    for most in (spelling.MOST_BLOCKS, 1):
        got = [tuple(r) for r in spelling.near_pairs(words, most).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert len(spelling.filters_of(words, 1).bits) <= spelling.SHARDS
    assert spelling.Filters({6: 10**9, 7: 10**9}).bits.nbytes <= 8 * spelling.MOST_BLOCKS + 8 * spelling.SHARDS


def test_filters_leave_out_most_edits(spark, tmp_path):
    words = [("".join(random.Random(i).choices("abcdefghij", k=9)), 5) for i in range(3000)]
    spark.createDataFrame(list(dict(words).items()), "word string, n long").write.parquet(str(tmp_path / "words"))
    vocabulary = spark.read.parquet(str(tmp_path / "words"))
    filters = spelling.filters_of(vocabulary)
    own = [r["word"] for r in vocabulary.collect()]
    letters = spelling.np.array([ord(c) for c in "abcdefghij"], spelling.np.uint64)
    edits = list(spelling._edits(own, filters, letters))
    exact = {(a, b) for a in own for b in own if near(a, b) and a < b}
    assert exact <= {(own[i], w) for i, w in edits}
    probes = 9 * 4.5 * len(own)
    assert len(edits) - len(exact) < 0.02 * probes


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")
    for table in (docs, docs.limit(0)):
        assert spelling.spelling_groups(table).isEmpty()
