"""The near-copy stage of the pipeline against all pairs of five-word shingle sets."""

import random

from quillward.session import ready

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def kept(rows):
    sets = {i: shingles(t) for i, t in rows}
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 10 * both >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return {i for i in sets if find(i) == i}


def test_near_copies_by_five_words_go(spark):
    import corpus_pipeline

    r = random.Random(8)
    rows, i = [], 0
    for size in (60, 200, 400):
        base = [f"w{r.randrange(5000)}" for _ in range(size)]
        rows.append((i, " ".join(base)))
        i += 1
        for part in (0.01, 0.02, 0.03, 0.05):  # scattered words changed
            t = list(base)
            for k in r.sample(range(size), max(1, int(part * size))):
                t[k] = f"x{r.randrange(10**6)}"
            rows.append((i, " ".join(t)))
            i += 1
        for part in (0.12, 0.2, 0.24, 0.3):  # new text appended
            rows.append((i, " ".join(base + [f"y{r.randrange(10**6)}" for _ in range(int(part * size))])))
            i += 1
    t = [f"v{k}" for k in range(200)]
    copy = [f"z{k}" if k in (30, 80, 130, 180) else x for k, x in enumerate(t)]
    rows += [(900, " ".join(t)), (901, " ".join(copy)), (902, ""), (903, "a b c"), (904, "A  b\nc")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = [x.doc_id for x in corpus_pipeline.one_of_each_group(ready(spark), docs, "").collect()]
    assert sorted(got) == sorted(kept(rows)) and 901 not in got
