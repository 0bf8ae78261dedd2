"""Conversation repair, URL templates and ranked search against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import audit, lexical, queries, urls

# conversation repair


def audit_by_hand(rows):
    """rows: (role, text) in order; (faults, cost, audit, repaired) by a backward search over whole strings."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    nxt, turn = (2, 2, 3, 2), {2: "u", 3: "a"}
    best = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for (role, _), fault in zip(reversed(rows), reversed(faults)):
        base = []
        for s in range(4):
            to, more = nxt[s], fault == "truncated"
            options = [(3 + best[s][0], "D" + best[s][1])]
            if fault not in ("blank", "duplicate"):
                options.append((2 + more + best[to][0], "R" + best[to][1]))
                if role[:1] == turn[to]:
                    options.append((more + best[to][0], "K" + best[to][1]))
                if s == 0 and role[:1] == "s":
                    options.append((more + best[1][0], "K" + best[1][1]))
            base.append(min(options))
        best = [min((2 * n + base[t][0], "I" * n + base[t][1]) for n, t in enumerate((s, nxt[s], nxt[nxt[s]]))) for s in range(4)]
    cost, edits = best[0] if rows else (0, "")
    out, it, state = [], iter(rows), 0
    for e in edits:
        if e == "I":
            state = nxt[state]
            out.append(({2: "user", 3: "assistant"}[state], ""))
            continue
        role, text = next(it)
        if e == "D":
            continue
        state = 1 if e == "K" and state == 0 and role[:1] == "s" else nxt[state]
        out.append((role if e == "K" else {2: "user", 3: "assistant"}[state], text))
    return faults, cost, edits, "\n".join(f"{r}:{t}" for r, t in out)


def talks(seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", " ", "ufo", ""], ["Yes.", "no", "Why?", " ", "", "Well. \n", "ok! x"]
    long = [("long", i, rng.choice(roles[:2] * 3 + roles), rng.choice([f"t{i}.", f"t{i}", *texts])) for i in range(150)]
    short = [(f"c{c}", i // 2 if c % 5 == 0 else i, rng.choice(roles[:3] * 2 + roles), rng.choice([f"t{i}.", f"t{i}.", *texts]))
             for c in range(60) for i in range(rng.randrange(1, 9))]
    return long + short


@pytest.mark.parametrize("chunk", [3, 1024])
def test_repair_against_search_over_strings(spark, monkeypatch, chunk):
    monkeypatch.setattr(audit, "CHUNK", chunk)
    rows = talks(chunk)
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(3)
    told, edited = audit.repair(df)
    got = {r.conv: r for r in audit.digest(edited).collect()}
    facts = {r.conv: r for r in audit.counts(told).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by["=" + c].append((t, role, hashlib.sha256(text.encode()).hexdigest(), text))
    assert set(got) == set(by) == set(facts)
    for conv, x in by.items():
        ordered = [(r[1], r[3]) for r in sorted(x)]
        faults, cost, edits, out = audit_by_hand(ordered)
        assert (got[conv].cost, got[conv].audit) == (cost, edits)
        assert got[conv].repaired_sha256 == hashlib.sha256(out.encode()).hexdigest()
        turns = {r[0] for r in x}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(ordered, ordered[1:])]
        assert facts[conv][1:] == (max(turns) - min(turns) + 1 - len(turns), *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                                   sum(p not in ("su", "ua", "au") for p in pairs))
    text = {}
    for r in sorted(audit.repaired(edited).collect(), key=lambda r: (r.conv, r.place, r.step)):
        text.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(text.get(c, [])).encode()).hexdigest() == got[c].repaired_sha256 for c in by)


@pytest.mark.parametrize("prime", [1, (1 << 61) - 1])
def test_prefix_order_with_and_without_collisions(monkeypatch, prime):
    """With a modulus of 1 all hashes are equal, so only the verification tells prefixes apart."""
    monkeypatch.setattr(audit, "_PRIME", prime)
    rng, nodes, text = random.Random(5), audit.Prefixes(0), {0: ""}
    level = [0]
    for _ in range(70):
        new = []
        for state in range(4):
            parent, rank = rng.choice(level), state
            n = nodes.add(parent, state, rank)
            text[n] = text[parent] + "DIKR"[rank]
            new.append(n)
        for a in new:
            for b in new:
                assert nodes.compare(a, b) == (text[a] > text[b]) - (text[a] < text[b])
        level = new


def test_repair_of_odd_rows(spark):
    rows = [
        (None, 0, "user", "a."), (None, None, "user", "b."), (None, 1, None, None), (1, 0, "user", "same."), (1, 0, "user", "same."),
        (1, None, "assistant", "x" * 3_000_000), (2, 5, "system", "S."), (3, None, None, None), (4, 0, "user", "Hi."), (4, 1, "assistant", "Ho."),
    ]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, place int, conv string")
    told, edited = audit.repair(df)
    got = {r.conv: (r.cost, r.audit) for r in audit.digest(edited).collect()}
    assert got["=4"] == (0, "KK") and got["=2"] == (3, "D") and got["=3"] == (3, "D")
    assert got["~"] == min((3 + 0 + 2 + 3, "KDID"), (0 + 2 + 3, "KRD"))  # b. (no turn), a., the nulls
    faults = Counter((r.conv, r.fault) for r in told.collect())
    assert faults["=1", "duplicate"] == 1 and faults["=1", "truncated"] == 1 and faults["~", "blank"] == 1
    none, edited = audit.repair(df.limit(0))
    assert none.count() == edited.count() == audit.digest(edited).count() == audit.counts(none).count() == 0
    # the query keeps conversations that lose all their rows
    whole = queries.damaged(df.select("conv_id", "turn", "role", "text"))
    assert whole.columns == ["conv_id", "turn", "role", "text"]


# url templates


def templates_by_hand(rows, rules):
    """rows: (id, url) -> id: (host, path, rule, verdict), by walking each host's tree."""
    def split(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule_of(host, path):
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fit, key=lambda r: len(r[1] + r[2]), default=None)

    def shape(segs, d):
        if len(segs) <= d:
            return "ends"
        return "digits" if re.fullmatch("[0-9]+", segs[d]) else "mixed" if re.search("[0-9]", segs[d]) else "other"

    def chi(a, b, names):
        n1, n2 = sum(a[c] for c in names), sum(b[c] for c in names)
        return sum((a[c] * n2 - b[c] * n1) ** 2 / ((a[c] + b[c]) * n1 * n2) for c in names if a[c] + b[c])

    info = []
    for i, url in rows:
        host, path = split(url)
        r = rule_of(host, path)
        info.append([i, host, path, r, path.split("/")[1:], ""])
    for d in range(1, urls.DEPTH + 1):
        branch = defaultdict(lambda: defaultdict(Counter))
        for _, host, _, r, segs, t in info:
            if len(segs) >= d:
                c = branch[host, t][segs[d - 1]]
                c["n"] += 1
                c[{"block": "blocked", "allow": "allowed", None: "unknown"}[r and r[0]]] += 1
                c[shape(segs, d)] += 1
        name = {}
        for key, kids in branch.items():
            total = sum(c["n"] for c in kids.values())
            kept = sorted((c["blocked"] / c["n"], c["allowed"] / c["n"], s) for s, c in kids.items() if c["n"] >= urls.LEAST and c["n"] >= urls.SHARE * total)
            k = 0
            for j, (_, _, s) in enumerate(kept):
                if j and (chi(kids[s], kids[kept[j - 1][2]], urls.LABELS) >= urls.LABEL_LIMIT or chi(kids[s], kids[kept[j - 1][2]], urls.SHAPES) >= urls.SHAPE_LIMIT):
                    k += 1
                name[(*key, s)] = f"#{k}"
        for x in info:
            if len(x[4]) >= d:
                x[5] += "/" + name.get((x[1], x[5], x[4][d - 1]), "*")
    b, n = Counter(), Counter()
    for x in info:
        x[5] += "/**" * (len(x[4]) > urls.DEPTH)
        n[x[1], x[5]] += x[3] is not None
        b[x[1], x[5]] += x[3] is not None and x[3][0] == "block"
    base = sum(b.values()) / sum(n.values()) if sum(n.values()) else 0.5
    out = {}
    for i, host, path, r, _, t in info:
        bad = n[host, t] and (b[host, t] + urls.PRIOR * base) / (n[host, t] + urls.PRIOR) >= urls.PURITY
        out[i] = (host, path, r and r[1] + r[2], r[0] if r else "block" if bad else "allow")
    return out


def test_templates_by_hand(spark):
    rng, rows = random.Random(3), []
    rules = [*urls.RULES, ("block", "shop.org", "/p/1"), ("allow", "shop.org", "/blog/"), ("block", "tiny.org", "/t")]
    for i in range(3000):
        host = rng.choice(["big.org"] * 6 + ["Www.Example.com", "a.example.com", "b.net", "shop.org", "x.shop.org", "c.net:80"])
        path = rng.choice([
            f"/{rng.choice(['es', 'fr', 'en', 'de'])}/{rng.randrange(10**6)}", f"/p/{rng.randrange(1, 4)}{rng.randrange(9)}/{rng.choice('abc')}", "", "/",
            f"/blog/{rng.randrange(2000, 2004)}/{rng.randrange(1, 13)}/{rng.randrange(99)}-a/x/y", f"/blog/{rng.randrange(50)}/", "/*/{a|b}", "/fr",
        ])
        rows.append((i, f"http{'s' * (i % 2)}://{host}{path}{rng.choice(['', '?q=1', '#t', '?a=/es/#b'])}"))
    rows += [(4000 + i, f"http://tiny.org/{'t' if i % 9 else 'u'}{i}") for i in range(45)]  # rare segments share a template
    rows += [(3000, None), (3001, "no scheme/es/1"), (3002, ""), (3003, "x://"), (3004, "a://b://c/d"), (3005, "http://l.net/" + "es/" * 30_000), (3005, "http://l.net/" + "es/" * 30_000)]
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id long, url string, host string, template string").repartition(4)
    got = urls.judge(df, rules).collect()
    want = templates_by_hand(rows, rules)
    assert len(got) == len(rows)
    assert all((r.host, r.path, r.rule, r.verdict) == want[r.page_id] for r in got)
    assert len({r.verdict for r in got if r.rule is None}) == 2  # both verdicts by the method
    assert any(r.template.startswith("/{") for r in got) and any(r.template.endswith("/**") for r in got)
    assert urls.judge(df.limit(0)).count() == 0


def test_longest_rule(spark):
    df = spark.createDataFrame([(h, p) for h in ("com", "acom", "a.com", "example.com", "m.example.com", "www.example.com", "v.www.example.com") for p in ("", "/", "/en", "/en/x")], "h string, p string")
    got = {(r.h, r.p): (r.r, r.a) for r in df.select("*", urls.longest_rule(F.col("h"), F.col("p"), urls.RULES)[0].alias("r"), urls.longest_rule(F.col("h"), F.col("p"), urls.RULES)[1].alias("a")).collect()}
    assert got["com", "/"] == ("com/", "allow") and got["acom", "/"] == got["com", ""] == (None, None)
    assert got["m.example.com", "/en/x"] == ("example.com/en/", "block") and got["m.example.com", "/en"] == ("com/", "allow")
    assert got["v.www.example.com", "/en/x"] == ("www.example.com/en/", "allow")


# ranked search


def search_by_hand(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in set(items):
        found = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if s:
                found.append((-s, i is None, i or 0))
        out |= {(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("pairs", [20, 200_000])
def test_search_by_hand(spark, odd, monkeypatch, pairs):
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([3, 30, 300])))) for i in range(600)] + [(1000 + i, "Copy one TWO w1.") for i in range(60)]
    items = [(1, "w1 w2 w3 w900 unknown"), (2, None), (3, " ?! "), (4, "copy Two two"), (5, "w5 w5 w5 É1 w7"), (5, "w5 w5 w5 É1 w7"), (None, "word3 and4 same x"), (6, "unknown")]
    rows = docs + [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s")).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit(1))
    got = lexical.search(df, asked).collect()
    want = search_by_hand(rows, items)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_search_of_nothing(spark, odd, none):
    asked = spark.createDataFrame([(1, "word1")], "item_id long, text string")
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(odd, asked.limit(0)).count() == 0
    assert lexical.search(odd.where("text = ''"), asked).count() == 0


def test_bounds_hold_and_prune():
    rng = random.Random(4)
    texts = [" ".join(f"v{int(rng.paretovariate(0.8))}" for _ in range(120)) for _ in range(3000)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    q = lexical.Queries([Counter([b"v3", b"v17", b"v400"]), Counter([b"v1", b"v2", b"v2"])])
    terms = lexical.Terms(buf, off, q.vocabulary, True)
    df = np.bincount(terms.found % len(q.vocabulary), minlength=len(q.vocabulary))
    q.weigh(len(texts), df)
    m = 75 + 25 * terms.n * len(texts) // terms.n.sum()
    bound = lexical.Sketches(terms, m).bounds(q)
    best, every = lexical.Best(q, 20), np.arange(len(texts))
    for i, pairs in enumerate(best.pairs):
        assert (bound[:, i] >= best.exact(terms, m, every, pairs)).all()
    best.rescored = 0
    best.meet(terms, m, every, np.zeros(len(texts), bool))
    assert best.rescored < len(texts)  # of two queries' 6000


def test_a_text_above_a_slice_counts_the_same(monkeypatch):
    text = " ".join(f"a{i % 300}é{i % 7}" for i in range(4000)) + " " + "z" * 900 + " end"
    buf, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    q = lexical.Queries([Counter([b"a1\xc3\xa91", b"end", b"z" * 900])])
    whole = lexical.Terms(buf, off, q.vocabulary, True)
    monkeypatch.setattr(lexical, "SLICE", 256)
    cut = lexical.Terms(buf, off, q.vocabulary, True)
    for name in ("n", "found", "tf", "cells", "cell_tf"):
        assert (getattr(whole, name) == getattr(cut, name)).all()
    assert whole.n[0] == 4002 and len(whole.found) == 3
