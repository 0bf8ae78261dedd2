"""Classifiers, counts and language models against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parcelwise.llm import automaton, perplexity, quality, repeats, rollups, textbytes, toxicity
from parcelwise.llm.fmindex import Index

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def label_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_words_and_hashes_of_slices():
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \t\nabé c") for _ in range(rng.randrange(40))) for _ in range(200)] + [None, ""]
    seen = {}
    for lo, hi, buf, off in textbytes.slices(pa.array(texts), 100):
        start, end, doc = textbytes.words(buf, off)
        hashes = textbytes.span_hashes(buf, start, end)
        for i in range(lo, hi):
            mine = [buf[a:b].tobytes().decode() for a, b, d in zip(start, end, doc) if d == i - lo]
            assert mine == WORD.findall(texts[i] or "")
        for a, b, h in zip(start, end, hashes.tolist()):
            assert seen.setdefault(buf[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_quality_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = quality.Network.start()
    for p in net.parameters():
        p += rng.normal(0, 0.05, p.shape).astype(np.float32)
    chunks = rng.integers(1, 257, (5, quality.CHUNK))
    row, y = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.probabilities(net.describe(chunks), row, 3)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for p, g in zip(net.parameters(), net.gradients(chunks, row, y)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = p[at], 3e-3
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=2e-4)


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        buf = np.arange(n, dtype=np.int64).astype(np.uint8)
        rows, row = quality.chunk_rows(buf, np.array([0, n]))
        assert len(rows) == len(quality.chunk_starts(n)) and set(row) == {0}
        covered = {s + i for s in quality.chunk_starts(n) for i in range(quality.CHUNK)}
        assert set(range(n)) <= covered


def test_classifiers_learn_and_take_odd_rows(spark, odd, none):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(240):
        bad, toxic = i % 3 == 0, i % 4 == 0
        parts = [rng.choice(["the", "house", "stands", "near", "water"]) for _ in range(80)]
        if bad:
            parts = [w.upper() + "!!" for w in parts]
        if toxic:
            parts[rng.randrange(80)] = "blockhead" + rng.choice(["s", "ed", ""])
        docs.append((i, " ".join(parts)))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(5000, None, None), (None, 1, 1), (3, 7, 7)]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), label_frame(spark, labels)
    net, model = quality.fit(frame, marks), toxicity.fit(frame, marks)
    good = {r.doc_id: r.score for r in quality.score(frame, net).collect()}
    tox = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    held = lambda i, n, k: zlib.crc32(str(i).encode()) % n == k
    assert np.mean([(good[i] >= quality.THRESHOLD) == (i % 3 != 0) for i in good if held(i, 5, 0)]) > 0.9
    assert np.mean([(tox[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in tox if held(i, 3, 1)]) > 0.9
    for scored in (quality.score(odd, net), toxicity.score(odd, model)):
        rows = scored.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(odd, net)
    assert kept.schema == odd.schema and kept.count() <= odd.count()
    assert quality.score(none, net).count() == toxicity.score(none, model).count() == quality.keep_good(none, net).count() == 0


def test_classifiers_without_labels(spark, odd):
    empty = label_frame(spark, [])
    assert {r.score for r in quality.score(odd, quality.fit(odd, empty)).collect()} == {0.5}
    assert max(r.score for r in toxicity.score(odd, toxicity.fit(odd, empty)).collect()) < 1e-9
    one_class = label_frame(spark, [(i, 1, 1) for i in range(20)])
    assert min(r.score for r in toxicity.score(odd, toxicity.fit(odd, one_class)).collect()) > 1 - 1e-9


def test_toxicity_features_are_distinct_ngrams():
    texts = ["Abc ab", "", "aaaaaa", "été"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    row, feature = toxicity.features(buf, off)
    for i, t in enumerate(texts):
        low = t.lower().encode()
        assert np.sum(row == i) == len({low[k : k + n] for n in toxicity.SIZES for k in range(len(low) - n + 1)})


def test_rollup_batches(spark, tmp_path):
    rows = [("a", "en", "w", 5), ("a", "en", "w", 7), (None, None, "w", None), ("b", "de", "w", 1)]
    counts = spark.createDataFrame(rows, "source string, lang string, tokenizer string, tokens long")
    roll = rollups.Rollup(spark, str(tmp_path / "roll"))
    assert roll.totals().count() == 0
    assert roll.apply("one", rollups.inserted(counts)) and not roll.apply("one", rollups.inserted(counts))
    assert roll.apply("two", rollups.deleted(counts.where("source = 'b'")))
    change = counts.where("tokens = 7").withColumn("old_tokens", counts.tokens).withColumn("tokens", counts.tokens - 3)
    assert roll.apply("three", rollups.revised(change)) and roll.apply("four", rollups.inserted(counts.limit(0)))
    want = {("a", "en", "w", 2, 9), (None, None, "w", 1, 0)}
    assert {tuple(r) for r in roll.totals().collect()} == want
    roll.compact()
    assert {tuple(r) for r in roll.totals().collect()} == want
    assert not roll.apply("three", rollups.revised(change))
    assert roll.apply("five", rollups.inserted(counts.where("source = 'b'")))
    roll.compact()
    again = rollups.Rollup(spark, str(tmp_path / "roll"))
    assert {tuple(r) for r in again.totals().collect()} == want | {("b", "de", "w", 1, 1)}
    with pytest.raises(ValueError):
        roll.apply("../x", rollups.inserted(counts))


def test_vocabulary_counts(spark, odd):
    pytest.importorskip("tokenizers")
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file here")
    got = rollups.count_by_vocabulary(odd, path, "n_tokens").collect()
    assert len(got) == odd.count() and all((r.n_tokens > 0) == bool(r.text) for r in got)


def base_rules(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_perplexity_rules_on_odd_rows(spark, odd, none):
    got = perplexity.judge(odd).collect()
    counts = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert sorted((str(r.doc_id), *counts(r)) for r in got) == sorted((str(r.doc_id), *base_rules(r.text)) for r in odd.collect())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert perplexity.judge(none).count() == 0


def test_kneser_ney_sums_to_one(spark):
    texts = ["the cat sat on the mat", "the cat ran", "a mat", "", "cattle thrive"] * 2
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = perplexity.fit(docs, order=4)["en"]
    for context in (b"", b"\n", b"the", b"cat", b"zz", b"\nth"):
        last = [context[-3:] + bytes([s]) for s in range(256)]
        key = np.array([int.from_bytes(g, "big") | len(g) << 56 for g in last], np.uint64)
        assert np.exp(model.log_chances(key)).sum() == pytest.approx(1, abs=1e-6)


def test_no_language_is_a_language_of_its_own(spark):
    docs = spark.createDataFrame([(1, "alpha beta", None), (2, "gamma delta", ""), (3, "epsilon", "~")], "doc_id long, text string, lang string")
    models = perplexity.fit(docs, order=3)
    assert set(models) == {None, "", "~"}
    text = np.frombuffer(b"alpha", np.uint8)
    assert models[None].log_perplexity(text, np.array([0, 5]))[0] < models[""].log_perplexity(text, np.array([0, 5]))[0]


def test_hash_hits_are_checked_against_the_ngram():
    key = np.array([5 | 2 << 56, 9 | 2 << 56], np.uint64)
    model = perplexity.KneserNey.of_block(key, np.array([-1.0, -2.0]))
    assert model.log_chances(key).tolist() == [-1.0, -2.0]
    model.gram_key[:] = 7  # as if other n-grams had these hashes
    assert np.isnan(model.log_chances(key)).all()


@pytest.mark.parametrize("rare", [0, 3, 70_000])
def test_packed_words_come_back(rare):
    rng = np.random.default_rng(rare)
    # some words once, some often, and with 70 000 some codes of three bytes
    numbers = rng.permutation(np.concatenate([np.repeat(np.arange(rare), 2), np.repeat(np.arange(rare, rare + 5 * (rare > 0)), 1)]))
    words = [f"é{i * 7919 % 70_001}" for i in range(rare + 5 * (rare > 0))]
    spelling = "".join(w + " " for w in words).encode()
    told, letters = perplexity.unpacked_words(*perplexity.packed_words(numbers, spelling))
    again = letters.decode().split(" ")[:-1]
    assert sorted(again) == sorted(words)
    assert [again[i] for i in told] == [words[i] for i in numbers]


def test_documents_take_little_room_on_their_way_to_the_ngrams(spark):
    rng = np.random.default_rng(7)
    # words as uneven as those of a language, most of them used once
    texts = [" ".join(f"w{x * 2654435761 % 2**32:x}" for x in rng.zipf(1.2, 400) % 10**9) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    rows = perplexity.packed(docs).where("words IS NOT NULL OR spelling IS NOT NULL").select("words", "spelling").collect()
    room = sum(len(r.words or b"") + len(r.spelling or b"") for r in rows)
    assert room < 0.25 * sum(map(len, texts))


def test_block_automaton_walks_what_tables_say():
    rng = np.random.default_rng(2)
    texts = [rng.choice(np.frombuffer(b"abc d", np.uint8), n).tobytes() for n in (0, 1, 3, 900, 40, 5000)]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    symbols, at = automaton.stream(buf, off)
    grams = automaton.keys(symbols, at)
    key = np.unique(grams)
    weight = -rng.random(len(key))
    order = rng.permutation(len(key))
    model = automaton.BlockAutomaton(key[order], weight[order])
    want = [weight[np.searchsorted(key, grams[a:b])].sum() for a, b in zip(at, at[1:])]
    assert model.walk(symbols, at) == pytest.approx(want)
    with pytest.raises(ValueError, match="no (arc|state)"):
        model.walk(*automaton.stream(np.frombuffer(b"abcz", np.uint8), np.array([0, 4])))


def random_texts():
    """Texts with more than a million n-grams of five or six bytes and less."""
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 .,;:!?-", np.uint8)
    return ["", None, *(rng.choice(letters, 12_000).tobytes().decode() for _ in range(40))]


def test_perplexity_uses_every_ngram(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "BLOCK_BYTES", 100_000, raising=False)
    rows = [(i, t, ["en", "de"][i % 2]) for i, t in enumerate(random_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r.log_perplexity for r in perplexity.judge(docs).collect()}
    assert len(got) == len(rows)
    for lang in ("en", "de"):
        # every n-gram has the count of a plain Counter, and one model of all of them in memory gives the same values
        mine = [(i, (t or "").encode()) for i, t, x in rows if x == lang]
        grams = Counter()
        for _, t in mine:
            line = b"\n" + b" ".join(t.split()) + b"\n"
            for p in range(1, len(line)):
                for k in range(1, min(5, p + 1) + 1):
                    grams[line[p - k + 1 : p + 1]] += 1
        assert len(grams) > 500_000  # in each of two languages
        before, total, kinds = Counter(g[1:] for g in grams if len(g) > 1), Counter(), {}
        c = {g: n if len(g) == 5 else before.get(g, n) for g, n in grams.items()}
        for g, n in c.items():
            total[g[:-1]] += n
            kinds.setdefault(len(g), Counter())[n] += 1
        key = np.array([int.from_bytes(g, "big") | len(g) << 56 for g in c], np.uint64)
        model = perplexity.KneserNey.build(
            key, np.array(list(c.values())), np.array([total[g[:-1]] for g in c]), {k: [x[i] for i in (1, 2, 3, 4)] for k, x in kinds.items()}
        )
        for i, t in mine:
            want = model.log_perplexity(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
            assert got[i] == pytest.approx(want, rel=1e-6)
        for context in (b"", b"\n", rows[2][1][:4].encode(), rows[3][1][50:53].encode()):
            last = [context + bytes([s]) for s in range(256)]
            every = np.array([int.from_bytes(g, "big") | len(g) << 56 for g in last], np.uint64)
            assert np.exp(model.log_chances(every)).sum() == pytest.approx(1, abs=1e-6)


def test_perplexity_bands_reject_the_outlier(spark):
    rng = random.Random(4)
    plain = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(i % 50) for i in range(70)) for _ in range(60)]
    noise = " ".join("".join(rng.choice("QXZJ0987") for _ in range(6)) for _ in range(70))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*plain, noise])], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in perplexity.judge(docs).collect()}
    assert not kept[60] and sum(kept.values()) == 60


def repeats_by_hand(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_index_finds_repeated_windows():
    rng = np.random.default_rng(0)
    for _ in range(60):
        window = int(rng.integers(2, 7))
        seqs = list({tuple(rng.integers(1, 4, size=rng.integers(1, 30)).tolist()) for _ in range(rng.integers(1, 12))})
        symbols = np.array([x for s in seqs for x in [*s, 0]], dtype=np.int64)
        size = np.array([len(s) for s in seqs])
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        found = Index(symbols).repeated(start, size, window)
        seen = Counter(s[i : i + window] for s in seqs for i in range(len(s) - window + 1))
        for s, a in zip(seqs, start):
            for i in range(len(s) - window + 1):
                assert found[a + i] == (seen[s[i : i + window]] > 1)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_match_a_full_count(spark, odd, hot):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(100, 140):
        body = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(10, 120))]
        at = rng.randrange(len(body))
        cut = rng.randrange(30, 60)
        rows.append((i, " ".join(body[:at] + passage[:cut] * (1 + i % 2) + body[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted([tuple(r) for r in repeats.remove_repeats(docs, hot=hot, shard_bytes=5000).collect()], key=str)
    assert got == repeats_by_hand(rows, 35)


def test_repeats_of_nothing(none):
    assert repeats.remove_repeats(none).count() == 0


def test_automaton_against_recursion():
    texts = ["The cat  sat.\n on THE mat", "", "   ", "a", "the  the cat", "é ü the"] * 3
    counts = Counter()
    for t in texts:
        line = b"\n" + b" ".join(t.encode().lower().split()) + b"\n"
        for p in range(1, len(line)):
            for k in range(1, min(6, p + 1) + 1):
                counts[line[p - k + 1 : p + 1]] += 1
    key = np.array([int.from_bytes(g, "big") | len(g) << 56 for g in counts], np.uint64)
    model = automaton.Automaton.build(key, np.array(list(counts.values())), discount=0.7)

    def chance(context, s):
        if not context:
            return (counts[s] + 0.5) / (sum(v for g, v in counts.items() if len(g) == 1) + 128)
        kids = [g for g in counts if len(g) == len(context) + 1 and g[:-1] == context]
        if not kids:
            return chance(context[1:], s)
        total = counts[context]
        left = 1 - sum(max(counts[g] - 0.7, 0) for g in kids) / total
        return max(counts[context + s] - 0.7, 0) / total + left * chance(context[1:], s)

    for t in ("the cat", "zebra THE mat", "", "caté", "the cat " * 400):
        line = b"\n" + b" ".join(t.encode().lower().split()) + b"\n"
        want = sum(math.log10(chance(line[max(0, i - 5) : i], line[i : i + 1])) for i in range(1, len(line)))
        buf = np.frombuffer(t.encode(), np.uint8)
        assert model.score(buf, np.array([0, len(buf)]))[0] == pytest.approx(want, rel=1e-5)
    for state in range(len(model.failure)):
        _, weight = model.step(np.full(256, state, np.int32), np.arange(256))
        assert (10.0 ** weight.astype(float)).sum() == pytest.approx(1, abs=1e-5)


def test_varints():
    values = np.array([0, 5, 127, 128, 16383, 16384, 2**21, 2**28 + 3])
    assert (automaton._unvarints(automaton._varints(values)[0]) == values).all()


def test_lm_scores_on_odd_rows(spark, odd, none):
    rows = odd.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    seen = Counter(x for r in rows if not held(r.doc_id) for x in tokens(r.text))
    total, kinds = sum(seen.values()), len(seen)
    got = automaton.score(odd).collect()
    order = lambda x: (str(x[0]), x[2], x[5])
    want = sorted(
        [(r.doc_id, held(r.doc_id), len(tokens(r.text)), sum(seen[x] > 0 for x in tokens(r.text)), total,
          sum(math.log10((seen[x] + 1) / (total + kinds + 1)) for x in tokens(r.text))) for r in rows], key=order)
    for a, b in zip(sorted([tuple(r) for r in got], key=order), want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 0
    assert automaton.score(none).count() == 0


def test_lm_scores_use_every_ngram(spark, monkeypatch):
    monkeypatch.setattr(automaton, "BLOCK_BYTES", 100_000)
    rows = list(enumerate(random_texts()))
    counts, lines = Counter(), {}
    for i, t in rows:
        line = lines[i] = b"\n" + b" ".join((t or "").encode().lower().split()) + b"\n"
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for p in range(1, len(line)):
                for k in range(1, min(6, p + 1) + 1):
                    counts[line[p - k + 1 : p + 1]] += 1
    assert len(counts) > 1_000_000
    total = sum(n for g, n in counts.items() if len(g) == 1)
    kids, after = Counter(g[:-1] for g in counts if len(g) > 1), Counter()
    for g, n in counts.items():
        after[g[:-1]] += n

    def chance(g):
        if len(g) == 1:
            return (counts[g] + 0.5) / (total + 128)
        lower, n = chance(g[1:]), after[g[:-1]]
        return max(counts[g] - 0.8, 0) / n + 0.8 * kids[g[:-1]] / n * lower if n else lower

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.held_out, r.score) for r in automaton.score(docs).collect()}
    assert len(got) == len(rows) and len({h for h, _ in got.values()}) == 2
    for i, line in lines.items():
        want = sum(math.log10(chance(line[max(0, p - 5) : p + 1])) for p in range(1, len(line)))
        assert got[i][1] == pytest.approx(want, rel=1e-6)
