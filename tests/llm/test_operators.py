"""Every operator on small tables against brute force, and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate as D
from tesserae.llm import exact_dedup as E
from tesserae.llm import jaccard as J
from tesserae.llm import packing as P
from tesserae.llm import suffix_dedup as X
from tesserae.llm.components import components
from tesserae.llm.langid import identify
from tesserae.llm.pii import replace_pii
from tesserae.llm.quality import classify
from tesserae.llm.queries import tokenizer_file
from tesserae.llm.sampling import fold
from tesserae.llm.suffix_tree import score_texts
from tesserae.llm.toxicity import score_toxicity

SPACES = " \t\n\v\f\r"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choices("abcdeé", k=RNG.randrange(1, 6))) for _ in range(60)]


def prose(rng, n):
    return " ".join(rng.choices(VOCAB, k=n))


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, and awkward ones."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(n)]
    for i in range(0, n, 6):
        words = texts[i].split(" ")
        near = list(words)
        near[rng.randrange(len(near))] = "zz"
        texts += [texts[i], " " + texts[i] + "\n", " ".join(near), prose(rng, 20) + " " + passage + " " + prose(rng, 20)]
    texts += [None, "", " \t\n", "a", "a b c d", "A B C D", "!!! 123 ---", "x" * 5000, prose(rng, 3000), "dup", "dup"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    data = [(i, t, "en" if i % 2 else None, "s", 0, i, "q") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, rid long, digest string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def strip(text):
    return "".join(c for c in text or "" if c not in SPACES)


def test_exact_dedup(docs, none, rows):
    got = by_id(E.exact_dedup(docs))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i))
    for i, t in rows:
        own = groups[strip(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(own)[1], len(own), min(own)[1] == i, hashlib.sha256(strip(t).encode()).hexdigest())
    assert E.exact_dedup(none).count() == 0


def test_exact_dedup_against_history(spark, docs):
    past = spark.createDataFrame([(1000, "d u p"), (1001, None)], "doc_id long, text string")
    got = by_id(E.exact_dedup(docs, past))
    assert all(r.kept is False and r.keep_id == 1000 for i, r in got.items() if r.text_sha256 == hashlib.sha256(b"dup").hexdigest())
    assert sum(r.kept for r in got.values()) == len({r.text_sha256 for r in got.values()}) - 2


def test_exact_dedup_splits_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(E, "HOT_ROWS", 20)
    monkeypatch.setattr(E, "BUCKET_KEYS", 7)
    many = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")
    got = by_id(E.exact_dedup(many))
    assert len(got) == 300 and got[2].group_size == 200 and sum(r.kept for r in got.values()) == 101


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
        sizes, bits, slot = E.build_mphf(keys)
        assert sorted(slot) == list(range(n))
        assert (E.probe_mphf(sizes, bits, keys) == slot).all()
        if n:
            E.probe_mphf(sizes, bits, rng.integers(0, 1 << 63, (50, 4), dtype=np.uint64))


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(parent, i)) for i in ids}


@pytest.mark.parametrize("single,pair", [(2048, 65536), (1, 2), (0, 0)])
def test_jaccard(docs, none, rows, monkeypatch, single, pair):
    """Also with nearly all tokens in the classes that are indexed by pairs and triples."""
    monkeypatch.setattr(J, "SINGLE_DF", single)
    monkeypatch.setattr(J, "PAIR_DF", pair)
    if single < 2048:
        monkeypatch.setattr(J, "MINHASHES", 1)
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(J.jaccard_components(docs)).items()}
    assert got == brute_components(rows)
    if single == 2048:
        assert J.jaccard_components(none).count() == 0


def test_jaccard_in_blocks_and_without_pivots(docs, rows, monkeypatch):
    """Every signature over two documents is dealt in blocks, and no link is found early."""
    monkeypatch.setattr(J, "GROUP_ROWS", 2)
    monkeypatch.setattr(J, "PIVOTS", 0)
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(J.jaccard_components(docs)).items()}
    assert got == brute_components(rows)


def test_jaccard_of_null_and_repeated_ids(spark):
    """Different texts of one id, and of rows without, keep their own links."""
    rng = random.Random(11)
    a, b, c = (" ".join(f"{k}{rng.random()}" for _ in range(40)) for k in "abc")
    near = [t + " more" for t in (a, b, c)]
    data = [(None, a), (None, b), (5, near[0]), (6, near[1]), (7, c), (7, "x y z"), (8, near[2]), (9, "x y z"), (None, None), (4, "")]
    got = J.jaccard_components(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(-1, -1), (-1, -1), (-1, -1), (4, 4), (5, -1), (6, -1), (7, 7), (7, 7), (8, 7), (9, 7)]


def test_jaccard_sketch():
    rng = np.random.default_rng(5)
    sets = [rng.choice(500, k, replace=False) for k in (0, 1, 40, 300)]
    first = np.cumsum([0, *map(len, sets)])
    s0, s1 = J.sketch(np.concatenate(sets).astype(np.int64), first)
    for x in range(4):
        for y in range(4):
            apart = sum(int(np.bitwise_count(np.uint64(s[x] ^ s[y] & -1) if s[x] ^ s[y] >= 0 else np.int64(s[x] ^ s[y]).view(np.uint64))) for s in (s0, s1))
            assert apart <= len(set(sets[x]) ^ set(sets[y])) and (x != y or apart == 0)


def test_jaccard_chain_of_near_copies(spark):
    """Neighbours link, ends don't: one component through the links alone."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        words = list(base)
        words[: 6 * k] = [f"v{i}" for i in range(6 * k)]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {i: r.component_id for i, r in by_id(J.jaccard_components(docs)).items()} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_signatures_are_shared_by_all_linked_sets(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(J, "SINGLE_DF", 3)
    monkeypatch.setattr(J, "PAIR_DF", 6)
    df = {t: rng.randrange(1, 10) for t in range(400)}
    for _ in range(200):
        x = set(rng.sample(range(400), rng.randrange(5, 60)))
        y = set(x)
        for t in rng.sample(sorted(x), len(x) // 9):
            y.discard(t)
        y |= set(rng.sample(range(400), rng.randrange(0, 3)))
        if len(x & y) * 100 < 80 * len(x | y) or x == y:
            continue
        made = []
        for s in (x, y):
            order = sorted(s, key=lambda t: (df[t], t))
            made.append(dict(zip(*(a.tolist() for a in J.signatures(np.array(order), np.array([df[t] for t in order]), len(s))))))
        both = made[0].keys() & made[1].keys()
        assert any(min(made[0][s], made[1][s]) * 180 >= 80 * (len(x) + len(y)) for s in both)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (7, 9), (5, 5)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components(path).collect()} == {0}


def item_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    texts = dict(rows)
    long = next(t for i, t in rows if t and 30 < len(t.split()) < 100)
    items = [(1, long), (2, "A b C d"), (3, None), (4, "..."), (10, " ".join(long.split()[:12]).upper()), (11, texts[len(rows) - 3][:200])]
    return spark.createDataFrame(items, "item_id long, text string")


def brute_hits(rows, items):
    wins = collections.defaultdict(set)
    for item, text in items:
        ws = item_words(text)
        size = min(10, len(ws))
        for i in range(len(ws) - size + 1 if size else 0):
            wins[tuple(ws[i : i + size])].add(item)
    out = {}
    for i, t in rows:
        ws, hit, found = item_words(t), set(), set()
        for w, its in wins.items():
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    found |= its
        names = ",".join(sorted(map(str, found)))
        out[i] = (len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("most", [1 << 26, 64])
def test_decontaminate(docs, none, rows, benchmark, monkeypatch, most):
    """With bitmaps that tell windows apart, and with full ones."""
    monkeypatch.setattr(D, "MOST_BITS", most)
    got = {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in by_id(D.decontaminate(docs, benchmark)).items()}
    assert got == brute_hits(rows, [tuple(r) for r in benchmark.collect()])
    assert D.decontaminate(none, benchmark).count() == 0
    assert D.decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_decontaminate_with_a_large_benchmark(spark):
    """Some 200,000 windows, and letters whose lower case depends on their neighbours."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    items = [(i, " ".join(rng.choices(words, k=200))) for i in range(1050)] + [(2000, "ΟΔΟΣ Α ΟΔΟΣ Β ΟΔΟΣ Γ ΟΔΟΣ Δ ΟΔΟΣ Ε")]
    texts = [(i, " ".join(rng.choices(words, k=300))) for i in range(40)] + [(100 + i, "x " + items[i * 7][1][50:400]) for i in range(40)] + [(500, "ΟΔΟΣ.Α'ΟΔΟΣ-Β ΟΔΟΣ.Γ ΟΔΟΣ Δ,ΟΔΟΣ Ε")]
    got = by_id(D.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert {i for i, r in got.items() if r.contaminated} == {i for i, _ in texts if i >= 100} and all(r.n_items == 1 for i, r in got.items() if i >= 100)


def test_decontaminate_removes(spark, benchmark):
    docs = spark.createDataFrame([(1, "One, a B c d! two"), (2, "clean"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in D.remove_documents(docs, benchmark).orderBy("doc_id").collect()] == [2, 3]
    assert {r.doc_id: r.text for r in D.remove_spans(docs, benchmark).collect()} == {1: "One, two", 2: "clean", 3: None}
    same = spark.createDataFrame([(None, "a b c d", 1), (None, "clean", 2), (4, "a b c d", 3), (4, "clean too", 4)], "doc_id long, text string, hit int")
    assert sorted(r.hit for r in D.remove_documents(same, benchmark).collect()) == [2, 4]
    assert {r.hit: r.text for r in D.remove_spans(same, benchmark).collect()} == {1: "", 2: "clean", 3: "", 4: "clean too"}


def brute_repeats(rows):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    out = {}
    for i, b in raw.items():
        cover = [False] * len(b)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                cover[k : k + 200] = [True] * 200
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("run,hot", [(8192, 50_000), (3, 3), (8192, 0)])
def test_suffix_dedup(docs, none, rows, monkeypatch, run, hot):
    """Also with short runs, and with some or all leading tokens counted by digest."""
    monkeypatch.setattr(X, "RUN_SEGMENTS", run)
    monkeypatch.setattr(X, "HOT_SEGMENTS", hot)
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(X.suffix_dedup(docs)).items()}
    assert got == brute_repeats(rows)
    assert X.suffix_dedup(none).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    for size in (1, 300, 3000):
        data = rng.integers(0, 2, size, dtype=np.uint8).repeat(2)
        start = np.arange(max(0, len(data) - 23))
        seen = collections.Counter(data[i : i + 24].tobytes() for i in start)
        assert (X.repeated(data, start, 24) == [seen[data[i : i + 24].tobytes()] > 1 for i in start]).all()


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    context = 64
    path = tokenizer_file()
    got = P.best_fit_packing(docs, path, context).collect()
    tokenizer = Tokenizer.from_file(path)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, own in ids.items():
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine[:-1]]))
        assert sum(r.length for r in mine) == len(own) and all(r.length == context for r in mine[1:]) and (len(own) > context or len(mine) == 1)
        assert all(zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0] + [n for _, n in spans[:-1]])) and sum(n for _, n in spans) <= context
    assert len(places) <= -(-sum(map(len, ids.values())) // context) + 2
    assert P.best_fit_packing(none, path, context).count() == 0


def test_plan_uses_every_piece_and_fills_exactly():
    rng = random.Random(4)
    for _ in range(30):
        context = rng.choice([8, 50, 200])
        counts = collections.Counter(rng.randrange(1, context + 1) for _ in range(rng.randrange(0, 400)))
        made = P.plan(dict(counts), context)
        used = collections.Counter()
        for pattern, times in made:
            assert times > 0 and sum(pattern) <= context
            for x in pattern:
                used[x] += times
        assert used == counts
    assert P.plan({5: 3, 3: 3, 2: 6, 1: 6}, 8) and sum(t for _, t in P.plan({5: 4, 3: 4}, 8)) == 4


def test_token_ids_of_awkward_texts():
    from tokenizers import Tokenizer

    texts = ["", "  a b\n\n c", "it's ok", "日本語 test 123", " lead", "trail ", "x\ty", "é×÷ 12a!?", "\xa0 nb", "a\r\nb", "<|endoftext|>", "hello <|endoftext|> world", "x<|endoftext|><|endoftext|>y plain", "<|endoftext|", None]
    tokenizer = Tokenizer.from_file(tokenizer_file())
    assert 50256 in tokenizer.encode("hello <|endoftext|> world", add_special_tokens=False).ids
    ids = P.Ids(tokenizer_file())
    for s in P.slices(pa.array(texts)):
        assert [list(x) for x in ids(s)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_lm_scores(docs, none, rows):
    got = by_id(score_texts(docs, fold(F.col("doc_id"), 10) != 0))
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    known = [i for i in tokens if not held[i]]
    assert sum(got[i].score for i in known) > sum(got[i].base_score for i in known)
    assert score_texts(none, F.lit(True)).count() == 0
    assert {r.score for r in score_texts(docs, F.lit(False)).collect()} == {0.0}


def brute_scores(tokens, trained, rare):
    """Scores of a suffix tree with every count at hand: words, pairs and triples of tokens, None the end and 0 the start."""
    from tesserae.llm import suffix_tree as T

    grams = [collections.Counter() for _ in range(3)]
    for i in trained:
        line = [0, *tokens[i]]
        for k in range(1, len(line)):
            for d in range(3):
                if k >= d:
                    grams[d][tuple(line[k - d : k + 1])] += 1
    total, once = sum(grams[0].values()), sum(n == 1 for n in grams[0].values())
    unknown = min(0.5, max(once, 1) / (total + 1))
    known = {g[0] for g, n in grams[0].items() if n > 1} | {0}
    frequent = max(T.LEAST, rare * total)

    def states(d, take, parent):
        """Each state's seen next words with their probabilities, and the weight of passing on."""
        by, seen = collections.defaultdict(dict), {}
        for g, n in grams[d].items():
            if all(x in known for x in g[:-1]) and take(g[:-1]):
                by[g[:-1]][g[-1]] = n
        for context, after in by.items():
            n_all, able = sum(after.values()), {w: n for w, n in after.items() if w in known and (context_counts[d](context) < frequent or n >= frequent)}
            p = {w: parent(context, w) for w in able}
            rest, left = n_all - sum(able.values()), max(1 - sum(p.values()), 1e-9)
            gain = sum(n * math.log2(n / n_all / p[w]) for w, n in able.items()) + (rest * math.log2(rest / n_all / left) if rest else 0)
            if n_all > 1 and able and gain >= T.DIVERGENCE or n_all > 1 and not able and gain >= T.DIVERGENCE:
                q = {w: (n + T.PRIOR * p[w]) / (n_all + T.PRIOR) for w, n in able.items()}
                seen[context] = (q, max(1 - sum(q.values()), 1e-12) / left)
        return seen

    pairs = grams[1]
    context_counts = [None, lambda c: grams[0][(None,)] if c == (0,) else grams[0][c], lambda c: pairs[c]]
    root = lambda w: (1 - unknown) * grams[0][(w,)] / total if grams[0][(w,)] else unknown

    def prob(held, context, w):
        if not held:
            return root(w)
        state = held[0].get(context)
        if state and w in state[0]:
            return state[0][w]
        return (state[1] if state else 1) * prob(held[1:], context[1:], w)

    one = states(1, lambda c: context_counts[1](c) >= frequent and any(n >= frequent for g, n in pairs.items() if g[0] == c[0]), lambda c, w: root(w))
    two = states(2, lambda c: pairs[c] > 1 and (pairs[c] < frequent or any(n >= frequent for g, n in grams[2].items() if g[:2] == c)), lambda c, w: prob([one], c[1:], w))
    out = {}
    for i, line in tokens.items():
        line, logs = [0, *line], 0.0
        for k in range(1, len(line)):
            ahead = tuple(line[max(0, k - 2) : k])
            use = [two, one] if len(ahead) == 2 and all(x in known for x in ahead) else [one] if ahead[-1] in known else []
            logs += math.log10(prob(use, ahead[-len(use) :] if use else (), line[k]))
        out[i] = logs
    return out


@pytest.mark.parametrize("rare,small", [(1e-6, False), (0.02, False), (0.02, True)])
def test_lm_scores_against_brute_force(spark, monkeypatch, rare, small):
    """With most contexts frequent, with most in buckets, and with many small slices and a full filter."""
    from tesserae.llm import suffix_tree as T

    monkeypatch.setattr(T, "RARE", rare)
    if small:
        monkeypatch.setattr(T, "SLICE_ROWS", 3)
        monkeypatch.setattr(T, "MOST_FILTER_BITS", 16)
    rng = random.Random(9)
    some = ["".join(x) for x in itertools.product("abcd", repeat=3)]
    passage = rng.choices(some, k=30)
    texts = [" ".join([*rng.choices(some, weights=range(1, 65), k=rng.randrange(1, 40)), *(passage if i % 5 == 0 else []), f"once{i}"]) for i in range(80)] + ["a", "", None, " ".join(passage) + " new words"]
    docs = spark.createDataFrame([(i if i else None, t, i % 7 != 0) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(3)
    got = {r.doc_id: r.score for r in score_texts(docs, F.col("learn")).collect()}
    tokens = {i if i else -1: [*(t or "").split(), None] for i, t in enumerate(texts)}
    want = brute_scores(tokens, [i for i in tokens if (i if i > 0 else 0) % 7 != 0], rare)
    assert got.keys() == want.keys()
    for i, score in want.items():
        assert math.isclose(got[i], score, rel_tol=1e-3, abs_tol=2e-3 * len(tokens[i])), (i, got[i], score)


@pytest.mark.parametrize("rare,most", [(1e-6, 5), (0.02, 0), (0.005, 30)])
def test_lm_words_outside_the_vocabulary_are_told_apart(spark, monkeypatch, rare, most):
    """With a vocabulary of few words or none of its own, contexts and next words of all others count as they do with every count at hand."""
    from tesserae.llm import suffix_tree as T

    rng = random.Random(11)
    some = ["".join(x) for x in itertools.product("abcde", repeat=3)]
    passages = [rng.choices(some, k=12) for _ in range(9)]
    texts = [" ".join([*passages[i % 9], *rng.choices(some, k=rng.randrange(4)), *(passages[i % 9] if i % 4 == 0 else []), f"once{i}"]) for i in range(70)]
    texts += ["", None, "qq", "qq", passages[0][0], " ".join(passages[1][:2]) + " new words", *[" ".join(["stop", "go", *rng.choices(some, k=2)]) for _ in range(30)]]
    docs = spark.createDataFrame([(i, t, i % 7 != 0) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(3)
    tokens = {i: [*(t or "").split(), None] for i, t in enumerate(texts)}
    want = brute_scores(tokens, [i for i in tokens if i % 7], rare)
    whole = {r.doc_id: r for r in score_texts(docs, F.col("learn")).collect()} if rare == 1e-6 else {}
    monkeypatch.setattr(T, "RARE", rare)
    monkeypatch.setattr(T, "VOCABULARY", most)
    monkeypatch.setattr(T, "SLICE_ROWS", 7)
    got = {r.doc_id: r for r in score_texts(docs, F.col("learn")).collect()}
    for i, score in want.items():
        assert math.isclose(got[i].score, score, rel_tol=1e-3, abs_tol=2e-3 * len(tokens[i])), (i, got[i].score, score)
    for i, r in whole.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (r.n_tokens, r.n_known, r.train_tokens)
        assert math.isclose(got[i].base_score, r.base_score, rel_tol=1e-9)


def test_next_word_probabilities_sum_to_one(spark):
    from tesserae.llm.suffix_tree import START_HASH, U, build_tree

    texts = ["a b a b a b c"] * 40 + ["a c d"] * 10 + ["e"]
    tree = build_tree(spark.createDataFrame([(t,) for t in texts], "text string"), F.lit(True))
    words = [w for w in {w for t in texts for w in t.split()}]
    from tesserae.llm.kernels import buffers, prefix_sums, range_hash
    from tesserae.llm.suffix_tree import END_HASH

    def hash_of(w):
        data, offsets = buffers(pa.array([w]))
        return range_hash(prefix_sums(data), offsets[:1], offsets[1:])[0]

    counts = collections.Counter(w for t in texts for w in [*t.split(), None])
    for context in ([], ["a"], ["a", "b"], ["b", "a"], ["d"], ["e"]):
        total = tree.unknown
        if context:
            probe = np.array([*map(hash_of, context), U(12345)], np.uint64)
            logs, _ = tree.score(probe, np.array([0, len(probe)]))
            total *= 10 ** logs[-1]
        for w in [*words, None]:
            probe = np.array([*map(hash_of, context), END_HASH if w is None else hash_of(w)], np.uint64)
            logs, root = tree.score(probe, np.array([0, len(probe)]))
            if not context:
                continue
            total += 10 ** (logs[-1] + (tree.root(np.array([counts[w]]))[0] if root[-1] else 0))
        if context:
            assert math.isclose(total, 1.0, rel_tol=1e-5), (context, total)
    assert START_HASH != END_HASH


EN, DE = "the of and to in that with was for it".split(), "der die und nicht mit das ist ein zu von".split()


def speech(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def test_language_id(spark, none):
    rng = random.Random(6)
    data = [(i, speech(rng, EN if i % 2 else DE, rng.randrange(5, 60)), "en" if i % 2 else "de") for i in range(200)]
    mixed = speech(rng, EN, 60) + " " + speech(rng, DE, 40)
    data += [(900, mixed, None), (901, None, "en"), (902, "", None), (903, "123 !!! 45", "de"), (904, " \n", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = by_id(identify(docs, fold(F.col("doc_id"), 4) != 2))
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in data[:200])
    assert got[900].lang_pred == "en" and got[900].languages == ["en", "de"] and 0.5 < got[900].score < 0.7
    assert all((got[i].lang_pred, got[i].score, got[i].languages) == ("und", 0.0, []) for i in (901, 902, 903, 904))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert identify(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in identify(docs, F.lit(False)).collect()} == {"und"}
    more = docs.where("doc_id < 40").withColumns({"lang_pred": F.lit("x"), "score": F.lit(None), "found": F.lit(1)})
    assert identify(more, F.lit(True)).count() == 40


def test_language_of_texts_alone_in_their_slice_and_of_many_languages(spark):
    """One letter is enough, whatever stands beside it; a text of five languages has them all."""
    rng = random.Random(8)
    words = {f"l{k}": [x * 3 + y + z for x in a for y in "aeiou" for z in a] for k, a in enumerate(("bc", "df", "gh", "jk", "lm"))}
    data = [(i, speech(rng, words[f"l{i % 5}"], 40), f"l{i % 5}") for i in range(100)]
    data += [(200, " ".join(speech(rng, w, 40) for w in words.values()), None), (201, "a", None), (202, "ж", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(103, "doc_id")
    got = by_id(identify(docs, F.lit(True)))
    assert sorted(got[200].languages) == sorted(words) and got[201].lang_pred != "und" and got[202].lang_pred != "und"
    together = by_id(identify(docs.coalesce(1), F.lit(True)))
    assert {i: r.lang_pred for i, r in got.items()} == {i: r.lang_pred for i, r in together.items()}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    data, labels = [], []
    for i in range(400):
        text = prose(rng, rng.randrange(20, 80))
        bad, toxic = i % 3 == 0, i % 4 == 0
        if bad:
            text = " ".join(w + "%%%" for w in text.split())
        if toxic:
            words = text.split()
            for w in ("idiot", "scum", "blorg"):
                words.insert(rng.randrange(len(words)), w)
            text = " ".join(words)
        data.append((i, text))
        if i % 5:
            labels.append((i, None if i == 1 else int(not bad), int(toxic)))
    data += [(500, None), (501, ""), (501, "")]
    labels.append((999, 1, 1))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(labelled, none):
    docs, labels = labelled
    got = classify(docs, labels, "quality", fold(F.col("doc_id"), 5) != 0)
    rows = got.collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert held and sum(r.predicted == (r.doc_id % 3 != 0) for r in held) / len(held) > 0.95
    assert classify(none, labels, "quality", F.lit(True)).count() == 0
    assert {r.score for r in classify(docs, labels.limit(0), "quality", F.lit(True)).collect()} == {0.5}


def test_toxicity(labelled, none):
    docs, labels = labelled
    rows = score_toxicity(docs, labels, fold(F.col("doc_id"), 3) != 1).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert held and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert all(r.predicted == 0 for r in rows if r.doc_id >= 500)
    assert score_toxicity(none, labels, F.lit(True)).count() == 0
    assert score_toxicity(docs, labels.limit(0), F.lit(True)).count() == 403


def test_label_model_against_brute_force():
    """Expected counts and posteriors by plain loops; a voter that copies another hangs on it and counts once."""
    from tesserae.llm import toxicity as T

    rng = np.random.default_rng(4)
    toxic = rng.random(600) < 0.3
    vote = np.stack([rng.random(600) < np.where(toxic, a, b) for a, b in ((0.8, 0.05), (0.6, 0.1), (0.7, 0.02))], axis=1).astype(np.uint8)
    vote = np.concatenate([vote, vote[:, :1] ^ (rng.random((600, 1)) < 0.02)], axis=1)
    parent = T.dependences(vote, toxic.astype(float))
    assert {(v, int(p)) for v, p in enumerate(parent) if p >= 0} in ({(0, 3)}, {(3, 0)})
    q, weight = rng.random(600), rng.integers(1, 5, 600).astype(float)
    want = np.zeros((2, 4, 2, 2))
    for row, p, w in zip(vote, q, weight):
        for v in range(4):
            u = row[parent[v]] if parent[v] >= 0 else 0
            want[1, v, u, row[v]] += w * p
            want[0, v, u, row[v]] += w * (1 - p)
    got = T.count_votes(vote, parent, q, weight)
    assert np.allclose(got, want)
    model = T.LabelModel(parent, got, 0.2)
    for row in itertools.product((0, 1), repeat=4):
        joint = []
        for y, prior in ((0, 0.8), (1, 0.2)):
            p = prior
            for v in range(4):
                u = row[parent[v]] if parent[v] >= 0 else 0
                p *= (want[y, v, u, row[v]] + T.SMOOTHING) / (want[y, v, u].sum() + 2 * T.SMOOTHING)
            joint.append(p)
        assert math.isclose(model.posterior(np.array([row]))[0], joint[1] / sum(joint), rel_tol=1e-9)


def test_label_model_counts_all_documents(spark):
    """The rounds over patterns in tables give what they give on the rows themselves."""
    from tesserae.llm import toxicity as T

    rng = np.random.default_rng(6)
    vote = (rng.random((300, 9)) < 0.3).astype(np.uint8)
    labels = np.where(rng.random(300) < 0.5, (vote[:, 0] | vote[:, 1]).astype(int), -1)
    kinds, count = np.unique(np.packbits(vote, axis=1), axis=0, return_counts=True)
    patterns = spark.createDataFrame([(bytearray(k.tobytes()), int(n)) for k, n in zip(kinds, count)], "pattern binary, count long").repartition(3)
    model = T.fit_label_model(patterns, vote, labels, 0.4)
    guess = np.where(labels >= 0, labels, vote[:, -2] * 0.7 + 0.05).astype(float)
    parent, one = T.dependences(vote, guess), np.ones(300)
    want = T.LabelModel(parent, T.count_votes(vote, parent, guess, one), 0.4)
    for _ in range(T.EM_ROUNDS):
        want = T.LabelModel(parent, T.count_votes(vote, parent, guess, one) + T.count_votes(vote, parent, want.posterior(vote), one), 0.4)
    assert np.allclose(model.log, want.log)


def test_quality_training_against_plain_gradient_descent(monkeypatch):
    """One pass over single documents, with dictionaries instead of arrays."""
    from tesserae.llm import quality as Q

    monkeypatch.setattr(Q, "EPOCHS", 1)
    monkeypatch.setattr(Q, "BATCH", 1)
    texts, y = ["good words here", "bad bad", "other good", "x"], np.array([1, 0, 1, 0])
    weights, bias = Q.train(pa.array(texts), y)
    rng = np.random.default_rng(Q.SEED)
    index, share, bound = Q._sparse(pa.array(texts))
    table = rng.uniform(-1 / Q.DIM, 1 / Q.DIM, (Q.FAMILIES << Q.GRAM_BITS, Q.DIM)).astype(np.float32)
    top, b = np.zeros((Q.DIM, 2)), np.zeros(2)
    for step, i in enumerate(rng.permutation(4)):
        bag = list(zip(index[bound[i] : bound[i + 1]].tolist(), share[bound[i] : bound[i + 1]].tolist()))
        mean = sum(table[k].astype(float) * w for k, w in bag)
        z = mean @ top + b
        p = np.exp(z) / np.exp(z).sum()
        error, rate = np.eye(2)[y[i]] - p, Q.RATE * (1 - step / 4)
        back = top @ error
        top, b = top + rate * np.outer(mean, error), b + rate * error
        for k, w in bag:
            table[k] += rate * w * back
    assert np.allclose(weights, table @ (top[:, 1] - top[:, 0]), atol=1e-4) and math.isclose(bias, b[1] - b[0], abs_tol=1e-4)


def test_scores_do_not_depend_on_neighbouring_rows(labelled):
    docs, labels = labelled
    labels = labels.unionByName(labels.limit(1).selectExpr("doc_id", "7 as quality", "7 as toxic"))
    for score in (lambda d: classify(d, labels, "quality", F.lit(True)), lambda d: score_toxicity(d, labels, F.lit(True))):
        together, apart = ({(r.doc_id, round(r.score, 9)) for r in score(d).collect()} for d in (docs.coalesce(1), docs.repartition(50)))
        assert together == apart


def test_language_inference_against_brute_force():
    """Proportions by plain expectation-maximisation, and the set by its penalised likelihood."""
    from tesserae.llm import langid as L

    rng = np.random.default_rng(8)
    like = rng.normal(-20, 4, (60, 4))
    like[:30, 1] += 8
    first = np.array([0, 25, 40, 41, 60])
    got = L.infer(like, first)

    def em(rows, able):
        share = [1 / len(able)] * len(able)
        for _ in range(L.ROUNDS if len(able) > 1 else 0):
            parts = [[s * math.exp(row[k]) for s, k in zip(share, able)] for row in rows]
            share = [sum(p[i] / sum(p) for p in parts) / len(rows) for i in range(len(able))]
        return share

    for r in range(4):
        rows = like[first[r] : first[r + 1]]
        order = np.argsort([-x for x in em(rows, range(4))], kind="stable")
        best, best_score = None, -math.inf
        for size in range(1, 5):
            able = order[:size].tolist()
            share = [1 / size] * size
            for _ in range(L.ROUNDS if size > 1 else 0):
                parts = [[s * math.exp(row[k]) for s, k in zip(share, able)] for row in rows]
                share = [sum(p[i] / sum(p) for p in parts) / len(rows) for i in range(size)]
            score = sum(math.log(sum(s * math.exp(row[k]) for s, k in zip(share, able))) for row in rows) - L.PENALTY * math.log(len(rows) + 1) * (size - 1)
            if score <= best_score:
                break
            best, best_score = dict(zip(able, share)), score
        assert all(math.isclose(got[r, k], best.get(k, 0.0), abs_tol=1e-6) for k in range(4))


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits if c.isdigit()])):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def test_pii(spark, none):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    data = [
        (1, "Mail a.b@Mail2.example.com or A.B@MAIL2.EXAMPLE.COM."), (2, f'call +1 (017) 555-7713 token = "{key}" and {key}'), (3, "at 97.51.17.173, card 4111 1111 1111 1111 or 4111-1111-1111-1111"),
        (4, "Mr. John Smith, Mrs. Anna Smith and г-жа Анна Петрова"), (5, None), (6, ""), (7, "no data 12 345, 1.2.3 or v1.2.3.4.5"), (8, "a.b@mail2.example.com"), (9, "ssn 123-45-6789"), (9, "ssn 123-45-6789"),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in replace_pii(docs, "k").collect():
        got[r.doc_id].append(r)
    text = {i: rs[0].text for i, rs in got.items()}
    for gone in ("a.b@", "555-7713", key, "97.51.17.173", "4111 1111", "Smith", "Anna", "Анна", "Петрова", "123-45"):
        assert not any(gone in (t or "") for t in text.values())
    lower, upper = text[1].split()[1], text[1].split()[3].rstrip(".")
    assert upper == lower.upper() and text[8] == lower and "@" in lower and lower.endswith(".com")
    assert text[2].count(text[2].split('"')[1]) == 2 and len(text[2]) == len(data[1][1]) and "+1 (" in text[2]
    cards = text[3].split("card ")[1].split(" or ")
    assert cards[0].replace(" ", "-") == cards[1] and luhn(cards[0]) and cards[0] != "4111 1111 1111 1111"
    names = text[4].replace(",", "").split()
    assert names[2] == names[5]
    assert text[5] is None and text[6] == "" and text[7] == data[6][1] and got[7][0].n_entities == 0
    assert got[9][0].text == got[9][1].text and got[1][0].n_entities == 2 and got[1][0].kinds == ["email"]
    assert replace_pii(none, "k").count() == 0


def test_pii_surrogates_stay_distinct(spark):
    """More entities than a narrow kind first maps apart."""
    docs = spark.createDataFrame([(i, f"Mr. {a}{b} here") for i, (a, b) in enumerate((a, b) for a in "ABCDEFGHIJ" for b in ("na", "ra", "to", "mi", "lu"))], "doc_id long, text string")
    names = [r.text.split()[1] for r in replace_pii(docs, "k").collect()]
    assert len(set(names)) == 50


def test_pii_names_come_again_and_keep_their_surrogate(spark):
    data = [
        (1, "Mr John Smith wrote. John Smith signed; Dr John Smith left, SMITH too. Johnson stays."),
        (2, "Mrs Anna Smith and Frau Anna-Maria O'Neil met John and Smith."),
        (3, "Smith without a title"), (4, "Mr Σωκράτης and г-н Иван Петров"),
    ]
    docs = spark.createDataFrame([*data, (None, "Dr John")], "doc_id long, text string")
    text = {r.doc_id: r.text for r in replace_pii(docs, "k").collect()}
    john, smith = text[1].split()[1:3]
    smith = smith.rstrip(".")
    assert text[1] == f"Mr {john} {smith} wrote. {john} {smith} signed; Dr {john} {smith} left, {smith.upper()} too. Johnson stays."
    assert john[-1] in "nrs" and text[2].split()[2] == smith and text[2].endswith(f"met John and {smith}.") and text[3] == data[2][1] and text[-1] == f"Dr {john}"
    assert text[2].split()[1].endswith(("na", "la", "ra")) and "-" in text[2].split()[5] and "'" in text[2].split()[6]
    assert not any(x in text[4] for x in ("Σωκρ", "Иван", "Петров")) and text[4].split()[1][0] in "ΒΓΔΘΚΛΜΝΠΡΣΤΦ"


def test_pii_names_come_again_in_any_case(spark):
    data = [(1, "Mrs. ANNA KAREN wrote; Anna Karen signed, anna karen left."), (2, "Mr May may come in May with karen and Karen."), (3, "Sr José Ruiz; JOSÉ, José, josé ruiz-x, joséx")]
    text = {r.doc_id: r.text for r in replace_pii(spark.createDataFrame(data, "doc_id long, text string"), "k").collect()}
    anna, karen = text[1].split()[1:3]
    assert anna.isupper() and text[1] == f"Mrs. {anna} {karen} wrote; {anna.capitalize()} {karen.capitalize()} signed, {anna.lower()} {karen.lower()} left."
    may = text[2].split()[1]
    assert may != "May" and text[2] == f"Mr {may} may come in {may} with karen and Karen."
    jose, ruiz = text[3].rstrip(";").split()[1], text[3].split()[2].rstrip(";")
    assert text[3] == f"Sr {jose} {ruiz}; {jose.upper()}, {jose}, {jose.lower()} {ruiz.lower()}-x, joséx"


def test_pii_check_digits_and_countries(spark):
    def mod97(iban):
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97

    ibans = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606", "GB00 WEST 1234 5698 7654 32"]
    phones = ["+49 30 1234 5678", "+1 (555) 123-4567", "+358 40 123 4567", "(555) 123-4567", "+7 495 123 4567"]
    docs = spark.createDataFrame([(i, f"to {x} now") for i, x in enumerate(ibans + phones)], "doc_id long, text string")
    got = [r.text[3:-4] for r in sorted(replace_pii(docs, "k").collect())]
    for old, new in zip(ibans, got):
        plain = new.replace(" ", "")
        assert new != old and plain[:2] == old[:2] and [c == " " for c in new] == [c == " " for c in old]
        assert (mod97(plain) == 1) == (mod97(old.replace(" ", "")) == 1) or mod97(old.replace(" ", "")) != 1
    for old, new, kept in zip(phones, got[len(ibans) :], ("+49 ", "+1 (", "+358 ", "(5", "+7 ")):
        assert new != old and new.startswith(kept) and [c.isdigit() for c in new] == [c.isdigit() for c in old]


def test_pii_extra_columns_with_clashing_names(spark):
    """Columns named as those of the plan are not read."""
    docs = spark.createDataFrame([(None, "Mr John Smith", 1, "x", "y", 2), (7, None, 1, "x", "y", 2), (7, "", 1, "x", "y", 2)], "doc_id long, text string, rid int, kind string, names string, pos int")
    got = {(r.doc_id, r.n_entities): r.text for r in replace_pii(docs, "k").collect() if r.text != ""}
    assert set(got) == {(-1, 2), (7, 0)} and got[7, 0] is None and "Smith" not in got[-1, 2]


def test_pii_of_very_long_repetitions(spark):
    """Texts that a recursive matcher would overflow its stack on."""
    texts = ["Mr A" + "-A" * 500_000, "a@b" + ".b" * 500_000 + ".com", "a@" + "b." * 500_000, "Dr A" + " A" * 300_000, "+1" + " 22" * 300_000, "key=" + "x" * 1_000_000, "1" + "-1" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(replace_pii(docs, "k"))
    assert len(got) == len(texts) and all(got[i].n_entities for i in (0, 1, 3, 5)) and "-A-A" not in got[0].text and ".b" * 9 not in got[1].text


def test_pii_distinct_entities_stay_distinct(spark):
    """Far more names than syllables first tell apart, and more short numbers than half of all there are."""
    names = ["".join(x).capitalize() for x in itertools.product("bcdfg", "aeiou", "lmnrt", "aeiou", "bcdfg", "ao")]
    numbers = [f"(01) 555-{i:04d}" for i in range(0, 10_000, 3)]
    docs = spark.createDataFrame([(i, f"Mr {x} X1" if x[0] != "(" else x) for i, x in enumerate(names + numbers)], "doc_id long, text string")
    got = by_id(replace_pii(docs, "k"))
    after = [got[i].text.split()[1] if x[0] != "(" else got[i].text for i, x in enumerate(names + numbers)]
    assert len(set(after)) == len(after) and not set(after) & set(names + numbers) and all(x.isalpha() for x in after[: len(names)])


def test_pii_longer_surrogates_keep_separators(spark):
    from tesserae.llm.pii import _refill

    row = spark.createDataFrame([("912-34-5678", "987654321"), ("912-34-5678", "98765432100")], "raw string, made string").select(_refill(F.col("raw"), F.col("made"))).collect()
    assert [r[0] for r in row] == ["987-65-4321", "987-65-432100"]


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1 << 60, "a b c")], "doc_id long, text string")
    assert {r.component_id for r in J.jaccard_components(docs).collect()} == {-1}
    assert {r.keep_id for r in E.exact_dedup(docs).collect()} == {-1}


def test_pii_needs_no_other_trigger(spark):
    """Each entity alone in its text, so that nothing else there can set off the search."""
    alone = [
        "a@b.cd", "8.8.8.8", "1.1.1.1", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "Pwd: hunterxyz", "PassWord = hunterxyz", "pAsSwD:hunterxyz",
        "kEy=hunterxyz", "Api_Key = hunterxyz", "aCCess-key: hunterxyz", "tOKEN  =  'hunterxyz", "SeCret :hunterxyz", "abcdef" * 6, "123-45-6789", "+1 (017) 555-7713", "+1 55 55", "017.555.7713",
        "DE44 ABCD EFGH IJKL", "Mr. Smith", "г-жа Петрова", "Dr Smith",
    ]
    docs = spark.createDataFrame([(i, f"so {t} ok") for i, t in enumerate(alone)], "doc_id long, text string")
    got = by_id(replace_pii(docs, "k"))
    assert [t for i, t in enumerate(alone) if got[i].n_entities != 1 or t in got[i].text] == []


@pytest.mark.parametrize("bits", [8, 9, 11])
def test_leading_tokens_of_texts_longer_than_a_place(monkeypatch, bits):
    """The same tokens lead the same windows whether or not a text's places fit in PLACE_BITS."""
    rng = np.random.default_rng(6)
    size = [0, 199, 5000, 200, 3, 2047, 2048, 1, 300]
    data, offsets = rng.integers(97, 123, sum(size), dtype=np.uint8), np.cumsum([0, *size])
    data[900:1900] = data[3900:4900]
    want = X.leading(data, offsets)
    assert (want[3] - want[2] + 1).sum() == sum(max(0, n - 199) for n in size)
    monkeypatch.setattr(X, "PLACE_BITS", bits)
    for a, b in zip(X.leading(data, offsets), want, strict=True):
        assert a.tolist() == b.tolist()
    assert all(len(x) == 0 for x in X.leading(np.zeros(3000, np.uint8), np.arange(0, 3001, 100)))
