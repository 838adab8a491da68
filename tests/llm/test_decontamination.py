import random
import re

from ondula.llm import decontamination as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    wins = {(i, tuple(w[k:k + window])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - window + 1))}
    out = []
    for t in texts:
        w, hit, own = words(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    own |= {i} - {None}
        out.append((len(w), len(hit), sorted(own)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "Été", "x1", "naïve", "42"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "_", "\n", "\x00"]) for _ in range(n))

    items = [(str(i), text(rng.choice([3, 10, 14]))) for i in range(12)] + [("3", "beta"), (None, "42 42 42 42"), ("9", None), ("n", "?!")]
    texts = [text(rng.randrange(60)) for _ in range(60)] + [None, "", "--", items[1][1] + " END " + items[2][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = dict(enumerate(brute(texts, items)))
    for block in (d.BLOCK_CHARS, 200):
        rows = d.contamination(docs, bench, block_chars=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == want
        for r in rows:
            covered = [w for a, b in r.spans for w in words(texts[r.doc_id][a:b])]
            assert len(covered) == r.n_hit and all(a < b for (_, a), (b, _) in zip(r.spans, r.spans[1:]))


def test_spans_are_offsets_of_the_original(spark):
    item = "one two three four five six seven eight nine ten"
    text = "É — " + item.upper().replace(" ", " \n") + " tail"
    docs = spark.createDataFrame([(1, text, "mine")], "doc_id long, text string, items string")
    r = d.contamination(docs, spark.createDataFrame([(8, item)], "item_id long, text string")).first()
    assert [text[a:b] for a, b in r.spans] == [item.upper().replace(" ", " \n")]
    assert r["items"] == ["8"]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "q " * 100000)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in d.contamination(docs, none).collect()] == [0] * 4
    assert d.contamination(docs.where("false"), none).count() == 0
    bench = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert sorted(r.n_hit for r in d.contamination(docs, bench).collect()) == [0, 0, 1, 1]
