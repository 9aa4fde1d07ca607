import random

import pytest
from pyspark.sql import functions as F

from tallyspan.llm import passages, weighted_minhash


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base, passage = [prose(rng, 200) for _ in range(6)], prose(rng, 70)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, edited(rng, base[0], 2)) for i in range(60)]  # near copies
    out += [(200 + i, base[1].upper() + "!") for i in range(40)]  # copies but for case
    out += [(300 + i, f"{prose(rng, 80)} {passage} {prose(rng, 60)}") for i in range(50)]  # one passage in unlike texts
    out += [(400, None), (401, ""), (402, "..."), (403, "one two"), (404, "one two"), (405, "word " * 5000), (0, base[0])]
    return out


def test_classes(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    found = {r.doc_id: r for r in weighted_minhash.near_duplicates(docs).collect()}
    assert {found[100 + i].class_id for i in range(60)} == {0}
    assert {(found[200 + i].class_id, found[200 + i].text_id) for i in range(40)} == {(1, 1)}
    assert all(found[i].class_id == i for i in [*range(6), *range(300, 350), 400, 401, 402, 403, 405]) and found[404].class_id == 403
    kept = weighted_minhash.keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == {*range(6), *range(300, 350), 400, 401, 402, 403, 405} and kept.columns == docs.columns
    assert weighted_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_classes_equal_components_of_all_similar_pairs(spark, rows):
    import pyarrow as pa

    from tallyspan.llm.words import Words

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idf, _ = weighted_minhash.document_frequencies(docs)
    found = Words(pa.array([t for _, t in rows]))
    sets = [weighted_minhash.shingles(found.of(i), idf) for i in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if weighted_minhash.weighted_jaccard(sets[i], sets[j]) >= weighted_minhash.SIMILARITY:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        least[x] = min(doc, least.get(x, doc))
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(docs).collect()}
    assert got == {doc: least[x] for (doc, _), x in zip(rows, label, strict=True)}


def test_crowded_buckets_go_on_finely(spark, rows, monkeypatch):
    monkeypatch.setattr(weighted_minhash, "CROWD", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(docs).collect()}
    assert {found[100 + i] for i in range(60)} == {0} and all(found[300 + i] == 300 + i for i in range(50))


def test_no_similar_pair_of_a_crowded_bucket_is_lost(spark):
    import numpy as np
    import pyarrow as pa

    from tallyspan.llm.words import Words

    rng, rows = random.Random(9), []
    idf = weighted_minhash.Idf(np.empty(0, np.uint64), np.empty(0, np.int64), 1)
    while len(rows) < 200:  # pairs alike by 0.80 to 0.83, all in one bucket
        base = prose(rng, 150)
        copy = edited(rng, base, 3)
        found = Words(pa.array([base, copy]))
        if 0.8 <= weighted_minhash.weighted_jaccard(*(weighted_minhash.shingles(found.of(i), idf) for i in (0, 1))) <= 0.83:
            rows += [(len(rows), base), (len(rows) + 1, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(F.col("doc_id").alias("text_id"), F.array(F.lit(1).cast("long")).alias("bands"))
    got = {r.text_id: r.label for r in weighted_minhash.classes_of(texts, docs.withColumnRenamed("doc_id", "text_id"), idf).collect()}
    assert got == {i: i - i % 2 for i in range(200)}


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (1, a), (2, a), (3, a), (3, b), (4, b), (None, c), (None, c), (None, d), (5, d), (6, ""), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(weighted_minhash.keep_one(docs).collect(), key=str)
    assert kept == sorted([(1, a), (3, b), (None, c), (5, d), (6, ""), (6, "")], key=lambda r: f"Row(doc_id={r[0]}, text={r[1]!r})")
    found = sorted((r.doc_id or 0, r.class_id or 0, r.text_id or 0, r.class_texts) for r in weighted_minhash.near_duplicates(docs).collect())
    assert found == sorted([(1, 1, 1, 1)] * 3 + [(2, 1, 1, 1), (3, 1, 1, 1), (3, 3, 3, 1), (4, 3, 3, 1), (0, 0, 0, 1), (0, 0, 0, 1), (0, 5, 5, 1), (5, 5, 5, 1), (6, 6, 6, 1), (6, 6, 6, 1)])


def test_samples_agree_as_often_as_sets_are_alike():
    import numpy as np

    rng = np.random.default_rng(1)
    sampler = weighted_minhash.Sampler(4000)
    names = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = (np.sort(names[:200]), rng.uniform(0.5, 4, 200).astype(np.float32))
    b = (np.sort(names[50:250]), rng.uniform(0.5, 4, 200).astype(np.float32))
    share = (sampler.sample(*a) == sampler.sample(*b)).mean()
    assert share == pytest.approx(weighted_minhash.weighted_jaccard(a, b), abs=0.03)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 105), (105, 100)]
    found = {r.id: r.label for r in weighted_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {100: 100, 101: 100, 105: 100}


def test_passages(spark, rows):
    docs = spark.createDataFrame([r for r in rows if r[0] != 0 or r is rows[0]] + [(None, rows[300 - 300][1])], "doc_id long, text string")
    found = passages.passages(docs).collect()
    hit = {r.doc_id for r in found}
    # two documents may share a word beside the passage too, and then a seed of their own
    shared = [r for r in found if 301 <= r.doc_id < 350]
    assert {r.doc_id for r in shared if r.anchor_id == 300} == {*range(301, 350)} and all(300 <= r.anchor_id < 350 for r in shared)
    assert all(80 - 2 <= r.start <= 80 and 150 <= r.end <= 152 and r.identity == 1 for r in shared)
    assert {*range(100, 160)} <= hit and {*range(200, 240)} <= hit
    assert not hit & {1, 2, 3, 4, 5, 400, 401, 402, 403, 404}
    assert passages.passages(docs.limit(0)).count() == 0


def test_chains_are_ordered_and_best():
    line = [(i * 9, 500 + i * 9) for i in range(8)]
    noise = [(20, 900), (25, 3), (60, 560), (30, 531)]
    chained = [c for cluster in passages.clusters(line + noise) for c in passages.chain(cluster)]
    best = max(chained, key=len)
    assert len(best) >= 8 and all(a < c and b < d for (a, b), (c, d) in zip(best, best[1:], strict=False))


def test_chains_score_as_those_of_all_predecessors():
    """Against the chainer that tries every predecessor of every match."""
    score = lambda own: sum([passages.SEED, *(passages.joined(0, x, y) for x, y in zip(own, own[1:], strict=False))])
    for seed in range(200):
        rng = random.Random(seed)
        matches, drift = [], 0
        for a in sorted(rng.sample(range(300), rng.randint(2, 60))):
            drift += rng.choice([0, 0, 0, 1, -2, 7, -30, 25])
            matches.append((a, max(0, 400 + a + drift)))
        best = [float(passages.SEED)] * len(matches)
        for i, (a, b) in enumerate(matches):
            for j, (x, y) in enumerate(matches[:i]):
                if x < a and y < b and a - x <= passages.GAP + passages.SEED and abs(a - x - b + y) <= passages.DRIFT:
                    best[i] = max(best[i], passages.joined(best[j], (x, y), (a, b)))
        chains = passages.chain(matches)
        assert score(chains[0]) == pytest.approx(max(best)) and sorted(x for c in chains for x in c) == matches


def test_a_passage_in_parts_of_two_anchors_is_found(spark):
    rng = random.Random(8)
    passage = prose(rng, 60).split()
    around = lambda own: f"{prose(rng, 50)} {' '.join(own)} {prose(rng, 50)}"
    rows = [(1, around(passage[:32])), (2, around(passage[28:])), (3, around(passage)), (4, around(passage)), (5, around(passage))]
    rows += [(6, prose(rng, 90)), (6, around(passage))]  # two texts under one id
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {frozenset((r.doc_id, r.anchor_id)) for r in found if r.end - r.start >= 58}
    assert len(linked) == 3 and set().union(*linked) == {3, 4, 5, 6}


def test_recall_of_fuzzy_passages(spark):
    """Passages of 100 words that every document has with words replaced at random: the share
    of documents found, by how alike two of them are."""
    rng, rows, alike = random.Random(11), [], {}
    for n, rate in enumerate((0.0, 0.025, 0.05, 0.075)):  # 1, 0.95, 0.90 and 0.85 between two
        for k in range(25):
            passage = prose(rng, 100)
            for side in range(2):
                own = [prose(rng, 1) if rng.random() < rate else w for w in passage.split()]
                doc = n * 1000 + k * 2 + side
                alike[doc] = n
                rows.append((doc, f"{prose(rng, 40)} {' '.join(own)} {prose(rng, 40)}"))
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {frozenset((r.doc_id, r.anchor_id)) for r in found}
    assert all(max(p) - min(p) == 1 for p in pairs)
    share = [sum(frozenset((n * 1000 + k * 2, n * 1000 + k * 2 + 1)) in pairs for k in range(25)) / 25 for n in range(4)]
    assert share[0] == 1 and share[1] >= 0.95 and share[2] >= 0.8 and share[3] >= 0.5, share


def test_exact_runs_are_all_found(spark):
    """Brute force: every run of LEAST words that stands in two texts lies in passages of one."""
    unlike = lambda rng, n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    rng, pool = random.Random(13), [unlike(random.Random(i), 45) for i in range(12)]
    rows = [(i, " ".join(rng.choice([unlike(rng, 30), rng.choice(pool)]) for _ in range(5))) for i in range(60)]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {(r.doc_id, w) for r in found for w in range(r.start, r.end)} | {(r.anchor_id, w) for r in found for w in range(r.anchor_start, r.anchor_end)}
    where = {}
    for i, text in rows:
        words = text.split()
        for at in range(len(words) - passages.LEAST + 1):
            where.setdefault(tuple(words[at : at + passages.LEAST]), []).append((i, at))
    shared = [place for places in where.values() if len(places) > 1 for place in places]
    assert shared and all((i, at + k) in covered for i, at in shared for k in range(passages.LEAST))


def test_passages_whose_parts_stand_alone_elsewhere(spark):
    """Triples: a passage of 60 words in two texts, its halves apart in all three, and first in an older one."""
    unlike = lambda rng, n: [f"{rng.randrange(10**9):x}" for _ in range(n)]
    rng, rows = random.Random(21), []
    for t in range(40):
        first, second = unlike(rng, 30), unlike(rng, 30)
        apart = lambda a, b: unlike(rng, 20) + a + unlike(rng, 20) + b + unlike(rng, 20)
        rows += [(1000 + t, apart(first, second)), (2000 + t, apart(second, first) + first + second), (3000 + t, apart(second, first) + first + second)]
    found = passages.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    pairs = {(r.doc_id, r.anchor_id) for r in found if r.end - r.start >= 60}
    assert all((3000 + t, 2000 + t) in pairs for t in range(40))


def test_a_chain_whose_seeds_have_different_anchors_is_found(spark):
    """Triples: an older text has the start of what two others share, so one of these is the anchor of
    the end's seeds and not of the start's. All pairs of theirs that share two seeds are found."""
    unlike = lambda rng, n: [f"{rng.randrange(10**9):x}" for _ in range(n)]
    rng, rows = random.Random(5), {}
    for t in range(60):
        start, end, between = unlike(rng, 13), unlike(rng, 13), [unlike(rng, 4) for _ in range(3)]
        own = lambda: unlike(rng, 30) + start + [w for some in between for w in unlike(rng, 1) + some] + unlike(rng, 1) + end + unlike(rng, 30)
        rows |= {1000 + t: unlike(rng, 30) + start + unlike(rng, 30), 2000 + t: own(), 3000 + t: own()}
    texts = passages.keyed(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string"))
    seeds = {}
    for r in passages.seeds(texts).where("NOT long").collect():
        seeds.setdefault(r.doc_id, set()).add(r.seed)
    found = {(r.doc_id, r.anchor_id) for r in passages.passages(texts).collect()}
    two = [t for t in range(60) if len(seeds[2000 + t] & seeds[3000 + t]) > 1]
    assert len(two) > 20 and all((3000 + t, 2000 + t) in found for t in two), [t for t in two if (3000 + t, 2000 + t) not in found]


def test_long_runs_name_their_words():
    import numpy as np

    words = np.random.default_rng(1).integers(0, 1 << 62, 300).astype(np.uint64)
    words[200:260] = words[20:80]
    for n in (1, 2, 7, 40):
        names = passages.long_runs(words, n)
        assert len(names) == 300 - n + 1 and len(set(names.tolist())) == len({tuple(words[i : i + n].tolist()) for i in range(300 - n + 1)})
        assert (names[200 : 260 - n + 1] == names[20 : 80 - n + 1]).all()
    assert len(passages.long_runs(words[:39], 40)) == 0 == len(passages.long_runs(words[:0], 40))


def test_edit_distance():
    import numpy as np

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        assert passages.edit_distance(np.array(a), np.array(b)) == plain(a, b)
