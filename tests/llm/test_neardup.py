"""Near duplicates against an all-pairs brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from touchline.llm import neardup as nd


def words(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    par = list(range(len(sets)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(a), find(b)
                if x != y:
                    par[max(x, y)] = min(x, y)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    return sorted((i, len(s), min(groups[find(k)])) for k, (i, s) in enumerate(sets))


def corpus(rng, n=40):
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):  # copies with a few changed words
            c = list(base)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            out.append(" ".join(c))
    rng.shuffle(out)
    return list(enumerate(out))


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def test_components_equal_brute_force(make_docs):
    rows = corpus(random.Random(3))
    assert result(nd.near_duplicates(make_docs(rows))) == brute(rows)


def test_cut_regions_and_long_runs_lose_no_link(make_docs):
    """A tiny leaf makes every group a region that must be cut, and equal
    signatures a run that is linked neighbour by neighbour."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    rows = []
    for i in range(60):
        c = list(base)
        for _ in range(rng.randrange(3)):
            c[rng.randrange(len(c))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(c)))
    assert result(nd.near_duplicates(make_docs(rows), nd.Forest(leaf=8))) == brute(rows)


def test_odd_rows(make_docs, odd_texts):
    rows = list(enumerate(odd_texts))
    assert result(nd.near_duplicates(make_docs(rows))) == brute(rows)
    assert nd.near_duplicates(make_docs([])).count() == 0
    got = nd.near_duplicates(make_docs([(None, "a b c d e f"), (5, "a b c d e f"), (None, ""), (None, "z")])).collect()
    assert sorted(((r.doc_id is None), r.n_shingles, r.component_id is None, r.kept) for r in got) == [
        (False, 2, False, True), (True, 0, True, True), (True, 1, True, True), (True, 2, False, False)]


def test_keep_one_keeps_columns_and_one_row_of_each(make_docs, odd_texts):
    docs = make_docs([(i, t) for i, t in enumerate(odd_texts)] + [(4, "a b c d"), (5, "a b c d")])
    got = nd.keep_one(docs)
    assert got.columns == docs.columns
    texts = sorted((r.text or "") for r in got.select("text").collect())
    want = sorted(["", "", "   \n"] + sorted({t for t in odd_texts if words(t)}))
    assert texts == want
    # an id that two different texts share names two components: both stay
    two = make_docs([(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "a b c d e f g")])
    assert sorted(r.text for r in nd.keep_one(two).collect()) == ["a b c d e f g", "p q r s t u v"]


def test_hot_group_is_not_expanded(spark, make_docs):
    """Copies are one node: candidates do not grow with their number."""
    rows = [(i, "one two three four five six seven") for i in range(500)] + [(500, "p q r s t u v w x y")]
    sk = nd.sketches(make_docs(rows))
    nodes = sk.groupBy("fp").agg(F.first("sig").alias("sig"))
    assert nodes.count() == 2 and nd.candidates(nodes).count() == 0


def star(rng, n):
    """A text and ``n`` edited copies, each of which links with the text only."""
    base = [f"w{i}" for i in range(200)]
    rows = [" ".join(base)]
    for i in range(n):
        c = list(base)
        for at in rng.sample(range(10, 190, 6), 3):
            c[at] = f"x{i}y{at}"
        rows.append(" ".join(c))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_group_above_the_leaf_keeps_links_to_its_one_hub(make_docs):
    rows = star(random.Random(5), 120)
    want = brute(rows)
    assert sum(c == 0 for _, _, c in want) > 60  # most copies hang on the hub
    assert result(nd.near_duplicates(make_docs(rows), nd.Forest(leaf=8))) == want


def test_candidates_do_not_depend_on_the_partitions(spark, make_docs):
    f = nd.Forest(probe=0.82)
    nodes = nd.sketches(make_docs(star(random.Random(6), 120)), f).select("fp", "sig").cache()
    brief = {bytes(r.fp): np.frombuffer(r.sig, np.uint32) & 255 for r in nodes.collect()}
    pairs = {(a, b) for a in brief for b in brief if a < b and (brief[a] == brief[b]).sum() >= 105}
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    old = [spark.conf.get(k) for k in keys]
    groups = []
    try:
        for n in ("1", "64"):
            for k, v in zip(keys, (n, "false"), strict=True):
                spark.conf.set(k, v)
            found = {(bytes(r.a), bytes(r.b)) for r in nd.candidates(nodes, f).collect()}
            assert found <= pairs
            sets = nd.Union()
            for a, b in found:
                sets.join(a, b)
            groups.append({x: sets.find(x) for x in brief})
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)
    assert groups[0] == groups[1]


def test_groups_are_bounded_in_bytes_too(make_docs):
    """Sets of about 1.6 KB each, of which four or so may meet at a time: no link is lost."""
    rows = star(random.Random(7), 60)
    long = " ".join(f"z{i}" for i in range(4000))
    rows += [(100, long), (101, long.replace("z7 ", "y7 ")), (102, long + " end"), (103, "z1 z2 z3 z4 z5 z6")]
    assert result(nd.near_duplicates(make_docs(rows), nd.Forest(leaf_bytes=6400))) == brute(rows)
    assert result(nd.near_duplicates(make_docs(rows), nd.Forest(leaf=8, leaf_bytes=3000))) == brute(rows)
