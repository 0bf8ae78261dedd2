"""Sharding, mixing, decontamination, SimHash neighbours and the pipeline against plain Python."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from parcelwise.llm import decontaminate, mixing, sharding, simhash


@pytest.mark.parametrize("population,good,draws", [(50, 20, 10), (1000, 400, 300), (100_000, 5000, 40_000), (10**9, 10**6, 5 * 10**8)])
def test_hypergeometric_moments(spark, population, good, draws):
    expr = sharding.hypergeometric(f"{population}L", f"{good}L", f"{draws}L", "id")
    x = np.array([r[0] for r in spark.range(12_000).select(F.expr(expr)).collect()], float)
    mean = draws * good / population
    var = mean * (1 - good / population) * (population - draws) / (population - 1)
    assert abs(x.mean() - mean) < 5 * (var / len(x)) ** 0.5
    assert x.var() == pytest.approx(var, rel=0.08)
    assert x.min() >= max(0, draws + good - population) and x.max() <= min(good, draws)


def test_matrix_keeps_its_margins(spark):
    sizes = [7, 0, 100, 31, 5, 58, 1]
    row = spark.createDataFrame([(sizes,)], "sizes array<long>")
    capacity = "array(50L, 0L, 101L, 51L)"
    got = {r.part: r.share for r in sharding.communication_matrix(row, capacity, len(sizes)).collect()}
    assert [sum(got[i]) for i in range(len(sizes))] == sizes
    assert [sum(c) for c in zip(*got.values())] == [50, 0, 101, 51]


def test_shards_are_exact_and_even(spark, odd, none):
    many = spark.range(5003).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 100).alias("text"))
    for docs in (odd, many):
        got = sharding.digest(docs, shards=4).collect()
        n = docs.count()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert len(got) == n and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16) for r in docs.collect())
        assert Counter((r.doc_id, r.size) for r in got) == want
    again = sharding.digest(many.repartition(7), shards=4).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}
    # neighbours in the input spread evenly: a chi-square of 4 shards by 10 ranges of ids
    table = np.zeros((4, 10))
    for r in got:
        table[r.shard, r.doc_id * 10 // 5003] += 1
    expected = table.sum(1)[:, None] * table.sum(0) / table.sum()
    assert ((table - expected) ** 2 / expected).sum() < 55
    assert sharding.digest(none).count() == 0


def mix_by_hand(rows):
    """rows: (key, doc_id, source, size); the same queues and cut, by sorting everything."""
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    size = Counter()
    for r in rows:
        size[r[2]] += r[3]
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    total, held = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in held)
        open_ = [s for s in sources if s not in held]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level >= 3 * size[s]}
        if not over:
            break
        held |= over
    target = {s: 3.0 * size[s] if s in held else weight[s] * level for s in sources}
    copies, upto = [], Counter()
    for key, doc, source, n in sorted(rows, key=lambda r: (r[0], r[3])):
        upto[source] += n
        copies += [((e * size[source] + upto[source]) / target[source], source is None, source or "", e, key, n, doc) for e in range(3) if n]
    run, taken = 0, Counter()
    for c in sorted(copies):
        run += c[5]
        if run > total:
            break
        taken[c[6]] += c[5]
    return target, taken


def test_mix_against_sorting(spark):
    import hashlib

    rng = random.Random(2)
    rows = []
    for i in range(900):
        source = rng.choice(["a"] * 8 + ["b", "c", "é", None] + ["tiny"] * (i % 90 == 0))
        rows.append((i, " ".join("w" for _ in range(rng.randrange(30))), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block_rows=2).collect()
    keyed = [(hashlib.md5(f"mix|{i}".encode()).hexdigest(), i, s, len(t.split())) for i, t, s in rows]
    target, taken = mix_by_hand(keyed)
    source = {i: s for i, _, s in rows}
    assert {r.doc_id: r.taken for r in got} == {i: taken[i] for i, _, _ in rows}
    assert all(r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 3 * r.size for r in got)
    assert mixing.mixed(docs).count() == sum(r.copies for r in got)


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert all(r.taken <= 3 * r.size and (r.size or r.taken == 0) for r in got)
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0


def semi_global(item, text):
    """Fewest edits between all of item and any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j in range(1, len(text) + 1):
            last, row[j] = row[j], min(last + (text[j - 1] != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination_finds_every_item_within_the_budget():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(8, 40))) for i in range(12)]
    index = decontaminate.Index.build(items)
    hits = 0
    for trial in range(150):
        k = trial % 12
        body = list(items[k][1])
        for _ in range(int(len(body) * rng.choice([0, 0.02, 0.05, 0.08]))):
            at = rng.randrange(len(body))
            body[at : at + rng.randrange(2)] = [rng.choice("abcdefgh")] if rng.random() < 0.7 else []
        whole = f"{text(rng.randrange(60))} {''.join(body)} {text(rng.randrange(60))}".strip()
        folded = " ".join(whole.split()).encode()
        item = items[k][1].encode()
        edits = semi_global(item, folded)
        found = {m[0]: m for m in decontaminate.matches(np.frombuffer(folded, np.uint8), index)}
        assert (k in found) == (edits <= decontaminate.budget(len(item), decontaminate.EDIT_RATE))
        if k in found:
            hits += 1
            assert found[k][1] == edits
            assert semi_global(item, folded[found[k][2] : found[k][3]]) == edits
    assert hits > 60


def test_decontamination_frames(spark, odd, none):
    item = "The quick brown fox, and the lazy dog; they never met again."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (5, item)], "item_id int, text string")
    long_text = "filler words go here " * 3000
    docs = spark.createDataFrame(
        [(1, f"x {item.upper()} y"), (2, long_text + item.replace(", ", "  - ") + long_text), (3, "the quick brown"), (3, f"{item}"), (None, item)],
        "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == {(d, i): 1 for d in (1, 2, 3, None) for i in (1, 5)}
    span = next(r for r in got if r.doc_id == 1)
    assert f"x {item.upper()} y"[span.start : span.end].startswith("THE QUICK")
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()] == [3]
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.keep_clean(odd, bench).count() == odd.count()
    assert decontaminate.contaminated(none, bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def fingerprint_by_hand(text, shingle):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(fps, radius):
    label = {f: f for f in fps}
    while True:
        new = {a: min(label[b] for b in fps if (a ^ b).bit_count() <= radius) for a in fps}
        if new == label:
            return label
        label = new


def test_simhash_matches_spark_hash_and_brute_force(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    rows = odd.collect()
    fps = {fingerprint_by_hand(r.text, 4) for r in rows}
    label = components_by_hand(fps, 4)
    smallest = {}
    for r in rows:
        k = label[fingerprint_by_hand(r.text, 4)]
        ids = [i for i in (smallest.get(k), r.doc_id) if i is not None]
        smallest[k] = min(ids) if ids else None
    want = Counter((r.doc_id, f := fingerprint_by_hand(r.text, 4), smallest[label[f]]) for r in rows)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    three = spark.createDataFrame([("One TWO three",)], "t string").select(F.xxhash64(F.lower("t"))).first()[0]
    assert simhash.fingerprint(b"One  TWO\nthree") == three % 2**64
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.text or "" if (r.text or "").strip() else "" for r in rows}) - 1
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0


def test_vantage_trees_lose_no_link(spark):
    rng = random.Random(6)
    fps = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            f = centre
            for b in rng.sample(range(64), rng.randrange(5)):
                f ^= 1 << b
            fps.add(f)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    label = components_by_hand(fps, 4)
    edges = simhash.links(frame, leaf_rows=16).collect()
    assert all(label[e.a % 2**64] == label[e.b % 2**64] for e in edges)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[find(e.a % 2**64)] = find(e.b % 2**64)
    assert len({find(f) for f in fps}) == len(set(label.values()))


def test_route_reaches_every_neighbour():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 3000).astype(np.uint64)
    tree = simhash.VantageTree.fit(fps, 0, 21, 50, 1)
    row, leaf = tree.route(fps, 0)
    home = np.empty(len(fps), np.int64)
    home[row] = leaf
    assert len(row) == len(fps) and tree.leaf.max() > 10
    row, leaf = tree.route(fps, 1)
    reached = set(zip(row.tolist(), leaf.tolist()))
    low = fps & np.uint64(2**21 - 1)
    for i in range(300):
        for j in np.flatnonzero(np.bitwise_count(low ^ low[i]) <= 1):
            assert (i, home[j]) in reached


def test_pipeline_stages(spark, tmp_path):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(30)
    docs = [(i, text(60), "en", "ab"[i % 2], 1) for i in range(120)]
    docs += [(200 + i, docs[i][1], "en", "a", 1) for i in range(10)]
    docs += [(300 + i, f"{text(30)} {item} {text(30)}", "en", "b", 1) for i in range(5)]
    docs += [(400 + i, " ".join(w.upper() + "!!" for w in text(60).split()), "en", "b", 1) for i in range(60)]
    labels = [(d[0], int(d[0] < 400), 0) for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, left, str(tmp_path))
        assert out.schema == left.schema
        out.write.parquet(f"{tmp_path}/out{i}")
        left = spark.read.parquet(f"{tmp_path}/out{i}")
        ids.append({r.doc_id for r in left.select("doc_id").collect()})
    assert not {i for i in ids[0] if i >= 400} and len({i for i in ids[0] if i < 400}) > 130
    assert not {i for i in ids[1] if 200 <= i < 300 and i - 200 in ids[0]}
    assert ids[2] == {i for i in ids[1] if not 300 <= i < 400}
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert set(final.columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    assert {r.doc_id for r in final.collect()} <= ids[2]


def test_short_items_between_word_borders(spark):
    bench = spark.createDataFrame([(1, "What is 2 plus 2? Four"), (2, "two words"), (3, "nine letters")], "item_id int, text string")
    docs = spark.createDataFrame([
        (1, "so: WHAT is 2, plus 2 - four! and more"), (2, "somewhat is 2 plus 2 fourteen"), (3, "what is 2 plus 2 fou"), (4, "two words"),
        (5, "canine letters and nine letters"), (6, "nine letters"), (7, "nine lettersx, nine  letters"), (8, "what is 2 plus 3 four"),
    ], "doc_id int, text string")
    got = {(r.doc_id, r.item_id, r.edits, r.start) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1, 0, 4), (5, 3, 0, 19), (6, 3, 0, 0), (7, 3, 0, 15)}


def wide_rows(seed=3, n=400):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, (30, 4), dtype=np.uint64)
    out = []
    for i in range(n):
        w = base[i % 30].copy()
        for b in rng.choice(256, rng.integers(0, 50), replace=False):
            w[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        out.append((int(i).to_bytes(16, "big"), i if i % 50 else None, w.astype("<u8").tobytes()))
    return out


def test_wide_candidates_are_all_pairs_that_share_a_range(spark):
    rows = wide_rows()
    df = spark.createDataFrame(rows, "key binary, low long, wide binary").repartition(3)
    got = {(bytes(r.later), bytes(r.earlier)) for r in simhash.wide_candidates(df, 60, -1, 4, leaf_rows=10**6).collect()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] is None, rows[i][1] or 0, rows[i][0]))
    value = [int.from_bytes(rows[i][2], "little") for i in order]
    # one leaf per range, so every pair within the radius is met
    want = {(rows[order[j]][0], rows[order[i]][0]) for j in range(len(order)) for i in range(j) if (value[i] ^ value[j]).bit_count() <= 60}
    assert got == want
    few = {(bytes(r.later), bytes(r.earlier)) for r in simhash.wide_candidates(df, 60, 30, 4, leaf_rows=16).collect()}
    assert few < want
    split = {(bytes(r.later), bytes(r.earlier)) for r in simhash.wide_candidates(df, 60, -1, 4, leaf_rows=16).collect()}
    close = {p for p, q in zip(want, want) if (int.from_bytes(dict((r[0], r[2]) for r in rows)[p[0]], "little")
             ^ int.from_bytes(dict((r[0], r[2]) for r in rows)[p[1]], "little")).bit_count() <= 39}
    assert len(split & close) >= 0.98 * len(close)


def test_leaders_cover_a_leaf():
    prints = np.array([np.frombuffer(r[2], "<u8") for r in wide_rows(4)])
    later, earlier = simhash.candidate_pairs(prints, 60, 30, block=64)
    far = simhash._apart(prints, prints)
    assert (later > earlier).all() and (far[later, earlier] <= 60).all()
    covered = set(later[far[later, earlier] <= 30].tolist())
    leaders = [i for i in range(len(prints)) if i not in covered]
    pairs = set(zip(later.tolist(), earlier.tolist()))
    assert all(any(far[j, i] <= 30 for i in earlier[later == j]) for j in covered)
    assert all((j, i) in pairs for x, i in enumerate(leaders) for j in leaders[x + 1 :] if far[i, j] <= 60)
    assert set(earlier.tolist()) <= set(leaders)


def test_similar_pairs_of_real_texts(spark):
    """On sf0.01: nothing goes that is not similar to a text that stays; nearly no two that stay are similar."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stay = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    sets = {r.doc_id: set(simhash.shingle_set(r.text.encode(), 5).tolist()) for r in docs.collect()}
    by = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            by[s].append(i)
    shared = Counter(p for ids in by.values() for p in itertools.combinations(ids, 2))
    near = defaultdict(set)
    for (i, j), n in shared.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            near[i].add(j)
            near[j].add(i)
    gone = set(sets) - stay
    assert len(gone) > 20 and all(near[i] & stay or not sets[i] for i in gone)
    assert sum(1 for i in stay for j in near[i] if j in stay and i < j) <= 0.05 * len(gone)


def test_a_repeated_line_makes_no_near_duplicate(spark):
    line = "one line of ten words that both of them repeat\n" * 30
    rows = [(i, line + " ".join(f"d{i}w{j}" for j in range(96)) + " " + line) for i in range(2)]
    assert simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_order_of_staying(spark):
    rows = [(b"b", b"a"), (b"c", b"b"), (b"d", b"c"), (b"d", b"b"), (b"e", b"a")]
    got = simhash.left_out(spark.createDataFrame(rows, "later binary, earlier binary")).collect()
    assert sorted(bytes(r.key) for r in got) == [b"b", b"d", b"e"]


def test_keep_one_takes_similar_texts_together(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9)))
    rows = []
    for i in range(40):
        body = [word() for _ in range(200)]
        rows.append((10 * i, " ".join(body)))
        for k in (1, 2, 3):
            body = list(body)
            body[rng.randrange(200)] = word()
            rows.append((10 * i + k, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [10 * i for i in range(40)]


def test_a_text_whose_first_partner_goes_meets_the_others(spark):
    """Of a, b, c, d only a and b, b and d, c and d are similar: b goes, so d must be found to be similar to c, which stays."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9)))
    rows = []
    for i in range(20):
        body = [word() for _ in range(400)]
        places = list(range(10, 390, 20))

        def changed(text, some):
            text = list(text)
            for p in some:
                text[p] = word()
            return text

        d = changed(body, places[6:12])
        texts = [changed(body, places[:6]), body, changed(d, places[12:18]), d]
        rows += [(4 * i + k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [4 * i + k for i in range(20) for k in (0, 2)]


def test_pairs_of_fresh_rows_come_once(spark):
    rows = [(*r, i % 7 == 0) for i, r in enumerate(wide_rows(5))]
    df = spark.createDataFrame(rows, "key binary, low long, wide binary, fresh boolean").repartition(3)
    is_fresh = {r[0]: r[3] for r in rows}
    pairs = lambda d: [(bytes(r.later), bytes(r.earlier)) for r in simhash.wide_candidates(d, 60, -1, 4, leaf_rows=16).collect()]
    some, every = pairs(df), pairs(df.drop("fresh"))
    assert len(set(some)) == len(some) > 0 and set(some) == {p for p in every if is_fresh[p[0]] or is_fresh[p[1]]}
