"""Operators against plain rewrites on the small tables."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from helpers import rows
from tokenizers import Tokenizer

from attesta.llm import decontamination, licenses, mixing, packing, quality, simhash, substring, token_counts, trees
from attesta.llm.queries import ORACLE_SQL, QUERIES
from attesta.llm.statistics import measure
from attesta.llm.tokens import WordEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return dict(rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text"))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_op5(spark, sf, texts):
    prints = {}
    for i, t in texts.items():
        w = WORD.findall(low(t))
        hs = [xxhash.xxh64_intdigest(" ".join(w[j : j + 4]).encode(), 42) for j in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    parent = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    want = sorted((i, f"{prints[i]:016x}", find(parent, i)) for i in texts)
    assert sorted(rows(QUERIES["op5_simhash"](spark, sf), "doc_id", "fingerprint", "component_id")) == want


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_links_connect_all_close_pairs(spark, blocks):
    r = np.random.default_rng(blocks)
    centres = [int(x) for x in r.integers(0, 1 << 63, 12)]
    fps = sorted({c ^ sum(1 << int(b) for b in r.choice(63, r.integers(0, 5), replace=False)) for c in centres for _ in range(12)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    edges = {(min(a, b), max(a, b)) for a, b in rows(simhash.links(df, blocks))}
    close = {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4}
    assert edges <= close
    groups = []
    for pairs in (edges, close):
        parent = {f: f for f in fps}
        for a, b in pairs:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
        groups.append({f: find(parent, f) for f in fps})
    assert groups[0] == groups[1]


def test_op2_counts(spark, sf, texts):
    got = {r[0]: r[1:] for r in rows(QUERIES["op2_forest_quality"](spark, sf), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
    for i, t in texts.items():
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n, rep = len(w), len(inside)
        assert got[i] == (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n)


def test_repeat_words_with_wide_vocabulary():
    words = [b"w%d" % i for i in range(40)] * 2
    import attesta.llm.statistics as s

    old, s._WIDE = s._WIDE, 3
    try:
        assert s.repeat_words(words) == 80 and s.repeat_words(words[:41]) == 0
    finally:
        s._WIDE = old


def test_op1_held_out(labelled):
    docs, labels = labelled
    got = {r[0]: r[1:] for r in rows(quality.rule_quality(docs, labels), "doc_id", "held_out", "score", "predicted")}
    truth = {r[0]: r[1] for r in rows(labels, "doc_id", "quality")}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i][0] == (i in set(held)) and got[i][2] == int(got[i][1] >= 0.7) for i in truth)
    assert sum(got[i][2] == truth[i] for i in held) >= 0.97 * len(held)


def test_rule_columns_equal_numpy(spark, labelled):
    docs, labels = labelled
    model = quality.fit_rules(*quality.training_rows(docs, labels))
    assert model.rules
    from attesta.llm.statistics import FEATURES, statistics

    table = statistics(docs).select(*FEATURES, model.column().alias("s")).toPandas()
    assert np.allclose(table["s"], model.score(table[list(FEATURES)].to_numpy()), atol=1e-9)


def test_forest_is_monotone():
    r = np.random.default_rng(3)
    x = r.random((3000, 3))
    y = (r.random(3000) < 0.2 + 0.6 * x[:, 0] + 0.2 * np.sin(9 * x[:, 0])).astype(float)
    f = trees.fit(x, y, rounds=40, depth=4, monotone={0: 1, 1: -1})
    probe = r.random((200, 3))
    for feature, sign in ((0, 1), (1, -1)):
        steps = []
        for v in np.linspace(0, 1, 40):
            p = probe.copy()
            p[:, feature] = v
            steps.append(f.margin(p))
        assert (sign * np.diff(np.array(steps), axis=0) >= -1e-9).all()
    assert trees.fit(np.zeros((0, 3)), np.zeros(0)).score(np.ones((2, 3))).tolist() == [0.5, 0.5]


def test_op3(spark, sf, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(QUERIES["op3_best_two_fit"](spark, sf), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    want, total = [], 0
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        total += len(ids)
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(r[:5] for r in got) == sorted(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r[5]].append((r[6], r[3]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= math.ceil(total / 2048) * 1.02 + 1


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(1)
    for most in (30, 2048):
        counts = collections.Counter(int(x) for x in r.integers(1, most + 1, 400))
        used = collections.Counter()
        for times, lengths in packing.plan(dict(counts), 2048):
            assert sum(lengths) <= 2048
            for k in lengths:
                used[k] += times
        assert used == counts
    assert packing._replace_smallest([1500, 300], 248, np.bincount([1500, 300, 290, 250], minlength=2049)) == [1500, 290, 250]


def test_encoder_equals_tokenizer(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["don't. it's! İstanbul ΣΑΣ. a...b <|endoftext|>, <|ENDOFTEXT|> x1! 3. ½. é́ 你好。 foo bar.", " lead  two\n", "", "é. ﬁne; Å. straße ß ÿ ÷ × aé", "x" * 300, "a\x00b"]
    all_ = [*list(texts.values())[:60], *odd]
    small = WordEncoder(most=50)
    for enc in (WordEncoder(), small):
        got = [np.frombuffer(b, "<u4").tolist() for t in all_ for b in enc.encode([t.encode()])]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in all_]


def repeated_runs(texts, n=50):
    """Places of each document's ``n``-word runs that a document of smaller id holds."""
    first, need = {}, collections.defaultdict(set)
    for i in sorted(texts):
        w = WORD.findall(low(texts[i]))
        for j in range(len(w) - n + 1):
            if first.setdefault(tuple(w[j : j + n]), i) != i:
                need[i].add(j)
    return need


def covered_runs(found, n=50):
    """The same of passages (doc, start, n_words)."""
    got = collections.defaultdict(set)
    for i, start, words in found:
        got[i] |= set(range(start, start + words - n + 1))
    return got


def check_passages(texts, found):
    """Each passage (doc, source, start, n_words, source_start, similarity) is what it says."""
    words = {i: WORD.findall(low(t)) for i, t in texts.items()}
    sets = lambda i, a, n: {tuple(words[i][j : j + 5]) for j in range(a, a + n - 4)}
    for d, s, a, n, b, like in found:
        assert s < d and 0 <= a and n >= 50 and a + n <= len(words[d]) and like >= 0.8
        if like == 1.0:
            assert sets(d, a, n) <= sets(s, 0, len(words[s]))


def test_op4_covers_all_exact_passages(spark, sf, texts):
    got = rows(QUERIES["op4_substring_dedup"](spark, sf), "doc_id", "source_doc_id", "start", "n_words", "source_start", "similarity", "class_id", "n_links")
    need, have = repeated_runs(texts), covered_runs([(r[0], r[2], r[3]) for r in got])
    assert need and all(runs <= have[i] for i, runs in need.items())
    check_passages(texts, [r[:6] for r in got])
    parent = {i: i for i in texts}
    for d, s, *_ in got:
        x, y = find(parent, d), find(parent, s)
        parent[max(x, y)] = min(x, y)
    links = collections.defaultdict(set)
    for d, s, *_ in got:
        links[d].add(s), links[s].add(d)
    assert all(r[6] == find(parent, r[0]) and r[7] == len(links[r[0]]) for r in got)


@pytest.mark.parametrize("hot", [substring.HOT, 8])
def test_op4_passages_of_common_phrases(spark, monkeypatch, hot):
    """Texts of 12 out of 18 phrases of 17 words, three rows to a batch; also with groups split at eight rows."""
    monkeypatch.setattr(substring, "HOT", hot)
    r = np.random.default_rng(8)
    phrases = [[f"p{k}w{j}" for j in range(17)] for k in range(18)]
    texts = {i: " ".join(w for k in r.permutation(18)[:12] for w in phrases[k]) for i in range(500 if hot > 8 else 60)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = rows(substring.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")), "doc", "source", "start", "n_words", "source_start", "similarity")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    need, have = repeated_runs(texts), covered_runs([(x[0], x[2], x[3]) for x in got])
    assert need and all(runs <= have[i] for i, runs in need.items())
    check_passages(texts, got)


def test_compact_windows_cover_each_run_once():
    r = np.random.default_rng(2)
    v = substring.mixed(r.integers(1, 40, 60).astype(np.uint64), 0)
    windows = list(zip(*substring.compact_windows(v, 7, np.array([20])), strict=True))
    for a in range(60):
        for b in range(a + 6, 60):
            holding = [w for w in windows if w[0] <= a <= w[1] <= b <= w[2]]
            if a <= 20 <= b:
                assert not holding
            else:
                assert len(holding) == 1 and v[holding[0][1]] == v[a : b + 1].min()


def test_windows_of_one_repeated_word_are_few():
    v = np.full(1_000_000, 12345, np.uint64)
    assert len(substring.compact_windows(substring.mixed(v, 1))[0]) < 100_000


def test_near_spans_by_brute_force():
    r = np.random.default_rng(9)
    for _ in range(60):
        base = r.integers(1, 1 << 31, 91).astype(np.uint32)
        x, y = base.copy(), base.copy()
        for at in r.choice(91, 6):
            x[at : at + 5] = r.integers(1, 1 << 31, len(x[at : at + 5]))
        if r.random() < 0.5:  # a word more on one side
            y = np.concatenate([y[:60], r.integers(1, 1 << 31, 1).astype(np.uint32), y[60:-1]])
        start, stop, c, d = (int(v[0]) for v in substring.near_spans(x[None], y[None]))
        shared = [any(0 <= k + s < 91 and x[k] == y[k + s] for s in range(-3, 4)) for k in range(91)]
        best = 0
        for i in range(46):
            for j in range(max(45, i + 45), 91):
                k = sum(shared[i : j + 1])
                if shared[i] and shared[j] and k / (2 * (j - i + 1) - k) >= 0.8 - 1e-9:
                    best = max(best, j - i + 1)
        assert max(0, stop - start + 1) == best
        assert not best or (x[start] == y[c] and x[stop] == y[d])


def family(n=300, seed=3):
    """Copies of a passage, each edited in one word, and the clean original at a middle id."""
    import random

    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    docs = []
    for i in range(n):
        words = list(base)
        if i != n // 2:
            words[r.choice([*range(5), *range(55, 60)] if i % 3 == 0 else range(60))] = f"e{i}"
        docs.append((i, " ".join([f"a{i}x{k}" for k in range(20)] + words + [f"b{i}x{k}" for k in range(20)])))
    return docs


def similar(x, y, least=50):
    """Whether texts of 100 words, alike at the same places only, share a passage of 0.8."""
    for a in range(len(x) - least + 1):
        for b in range(a + least, len(x) + 1):
            k = sum(x[j : j + 5] == y[j : j + 5] for j in range(a, b - 4))
            if k >= 0.8 * (2 * (b - a - 4) - k):
                return True
    return False


@pytest.mark.parametrize("hot", [substring.HOT, 64])
def test_op4_edited_copies_find_an_original_of_any_id(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    docs = family(200)
    got = rows(substring.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")), "doc", "source", "start", "n_words", "source_start", "similarity")
    check_passages(dict(docs), got)
    words = {i: t.split()[18:82] for i, t in docs}
    want = {i for i in words if any(similar(words[i], words[j]) for j in range(i))}
    assert len(want) > 100 and {r[0] for r in got} <= want and len({r[0] for r in got}) >= 0.97 * len(want)


@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
def test_op4_recall_of_edited_passages(spark, kind):
    """100 pairs of texts that share a passage of 60 to 100 words with one or two edits."""
    r = np.random.default_rng(11)
    docs = []
    for i in range(100):
        words = [f"w{x}" for x in r.integers(0, 10**6, 60 + 40 * (i % 2))]
        other = list(words)
        for k in range(1 + i % 2):
            at = len(words) * (k + 1) // (2 + i % 2) + int(r.integers(-8, 8))
            other[at : at + (kind != "insert")] = [] if kind == "delete" else ["edit"]
        for j, w in enumerate((words, other)):
            docs.append((2 * i + j, " ".join([f"l{i}x{j}y{k}" for k in range(30)] + w + [f"r{i}x{j}y{k}" for k in range(30)])))
    got = rows(substring.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")), "doc", "source", "start", "n_words", "source_start", "similarity")
    assert {(d, s) for d, s, *_ in got} <= {(2 * i + 1, 2 * i) for i in range(100)}
    assert len({d for d, *_ in got}) >= 90
    check_passages(dict(docs), got)


def test_near_copies_with_edits(spark):
    r = np.random.default_rng(4)
    base = [f"w{i}" for i in r.integers(0, 5000, 300)]
    near = base.copy()
    for k in range(60, 300, 60):
        near[k] = "edit"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"z{i}" for i in range(300)))], "doc_id bigint, text string")
    got = rows(substring.repeated_passages(docs), "doc", "source")
    assert got and set(got) == {(2, 1)}
    assert substring.cut(b"a b  c\nd e", [(1, 2)]) == b"a d e"


def test_op4_rows_that_share_an_id(spark):
    """Different texts under one id are cut each by its own repeats, in either order."""
    passage = " ".join(f"p{k}" for k in range(80))
    other = " ".join(f"o{k}" for k in range(180))
    held = " ".join([*(f"x{k}" for k in range(60)), passage, *(f"y{k}" for k in range(40))])
    first = " ".join([passage, *(f"z{k}" for k in range(30))])
    for two in ((other, held), (held, other)):
        docs = spark.createDataFrame([(1, first), (5, two[0]), (5, two[1]), (5, two[1])], "doc_id bigint, text string")
        want = sorted([(1, first), (5, other), (5, held.replace(passage + " ", ""))] + [(5, two[1] if two[1] == other else held.replace(passage + " ", ""))])
        assert rows(substring.without_repeats(docs), "doc_id", "text") == want


def test_op6(spark, sf, duck):
    got = QUERIES["op6_decontamination"](spark, sf)
    want = duck.sql(ORACLE_SQL["op6_decontamination"])
    assert rows(got, "doc_id", "item_id", "n_found") == sorted(want.project("doc_id, item_id, n_found").fetchall(), key=repr)


def test_decontamination_in_blocks_and_at_edges(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(5000))
    item = " ".join(f"w{i}" for i in range(2100, 2140))
    edited = item.replace("w2103", "x")
    docs = spark.createDataFrame([(1, long), (2, "a b c"), (3, None), (4, ""), (5, "w1 w2 w3")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, edited), (3, "A b C"), (4, None), (5, "w4998 w4999 end of it all now"), (6, "W1 w2"), (7, "w2 w1")], "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "ITEMS_PER_PASS", 2)
    assert rows(decontamination.contained_items(docs, items), "doc", "item") == [(1, 1), (1, 2), (1, 6), (2, 3), (5, 6)]
    assert rows(decontamination.without_items(docs, items), "doc_id") == [(3,), (4,)]
    typed = items.where("item_id < 2").selectExpr("cast(item_id AS decimal(5, 1)) AS item_id", "text")
    assert [float(r[1]) for r in rows(decontamination.contained_items(docs, typed), "doc", "item")] == [1.0]


def test_op7(spark, sf, texts):
    got = {r[0]: r[1:] for r in rows(QUERIES["op7_context_mixing"](spark, sf), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
    tokens = {i: [*WORD.findall(low(t)), ""] for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    c = collections.Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert got[i][:4] == (i in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(got[i][4], base, rel_tol=1e-9) and got[i][5] < 0
    assert sum(got[i][5] for i in held) > sum(got[i][4] for i in held)


def test_mixing_probabilities_add_up(monkeypatch):
    """After any beginning, the next symbol's probabilities sum to one."""
    head = [(b"a", 50), (b"b", 30), (b"c", 5)]
    codes = mixing.Codes.build(head, 10, np.ones(mixing.BUCKETS, np.int64))
    r = np.random.default_rng(0)
    slots = mixing.slots_for(1000)
    tables = [r.normal(0, 1, slots).astype(np.float32) for _ in range(mixing.CONTEXTS)]
    mixer = mixing.Mixer(codes, tables, slots)
    monkeypatch.setattr(mixing, "BLOCK", 2)
    n = len(codes.length)
    start = [0, 1, 2, 1, 0]
    score = lambda rows_: mixer.score(np.concatenate(rows_), np.concatenate([[0], np.cumsum([len(x) for x in rows_])]))
    before = score([np.array(start)])[0]
    after = score([np.array([*start, k]) for k in range(n)])
    assert math.isclose(np.exp(after - before).sum(), 1, rel_tol=1e-4)


def test_slot_tables_by_brute_force(spark, monkeypatch):
    """Log-odds of all decisions in all contexts, from tasks' chunks, as one loop over the texts counts them."""
    monkeypatch.setattr(mixing, "CHUNK", 8)
    texts = ["a b a c", "a b b", None, "c x a b", ""]
    codes = mixing.Codes.build([(b"a", 4), (b"b", 4), (b"c", 2)], 5, np.ones(mixing.BUCKETS, np.int64))
    slots = mixing.slots_for(0)
    shipped = spark.sparkContext.broadcast(codes)
    got = mixing.slot_tables(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), shipped, slots, len(codes.gate))
    counts = [collections.Counter() for _ in range(3)]
    for t in texts:
        sym, cuts, _, _ = codes.tokens([(t or "").encode()])
        path, n = codes.bits(sym)
        for k, slot in enumerate(mixing.context_slots(path >> 1, list(codes.slots(sym, cuts)), n, slots)):
            counts[k].update(zip(slot.tolist(), (path & 1).tolist()))
    for k in range(3):
        seen = {s for s, _ in counts[k]}
        for s in seen:
            n0, n1 = counts[k][s, 0], counts[k][s, 1]
            assert math.isclose(got[k][s], math.log((n1 + 0.4) / (n0 + 0.4)) * (n0 + n1) / (n0 + n1 + (mixing.DOUBT if k else 0)), rel_tol=1e-5, abs_tol=1e-6)
        assert not any(got[k][s] for s in set(range(len(got[k]))) - seen)


def test_mixing_counts_every_context_by_itself(spark, monkeypatch):
    """Scores of all texts, with few slots to share, several units and shards, as plain loops over dictionaries find them."""
    for name, value in (("SLOTS", (16, 16)), ("HEAD", 40), ("UNIT", 500), ("SHARD", 700)):
        monkeypatch.setattr(mixing, name, value, raising=False)
    r = random.Random(3)
    word = lambda: f"w{min(r.randrange(1, 90), r.randrange(1, 90), r.randrange(1, 90))}"
    texts = {i: " ".join(word() for _ in range(r.choice([0, 1, 5, 40, 150, 300]))) for i in range(60)}
    texts |= {61: None, 62: "never seen before w1 w2"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {d: (h, v) for d, h, v in rows(mixing.score_texts(docs), "id", "held_out", "score")}
    train = [(t or "").split() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in t)
    sizes = collections.Counter(c.values())
    least = min(n for n in sizes if sum(sizes[k] for k in sizes if k >= n) <= mixing.HEAD)
    top = sorted(((w.encode(), n) for w, n in c.items() if n >= least), key=lambda x: (-x[1], x[0]))
    mass, once = np.zeros(mixing.BUCKETS, np.int64), np.zeros(mixing.BUCKETS, np.int64)
    for w, n in c.items():
        if n < least:
            mass[mixing.bucket(w.encode())] += n
            once[mixing.bucket(w.encode())] += n == 1
    codes = mixing.Codes.build(top, len(train), mass + once)
    end = len(top)
    symbol = lambda w: codes.symbols.get(w.encode(), end + 1 + mixing.bucket(w.encode()))

    def decisions(words):
        before = far = None
        for s in [*map(symbol, words), end]:
            yield [(int(p) >> 1, int(p) & 1, (None, before, far)) for p in codes.path[codes.start[s] : codes.start[s] + codes.length[s]]]
            before, far = s, s if s < min(mixing.FREQUENT, end) else far

    seen = collections.Counter((k, own[k], node, bit) for t in train for path in decisions(t) for node, bit, own in path for k in range(3))

    def odds(k, context, node):
        n0, n1 = seen[k, context, node, 0], seen[k, context, node, 1]
        return math.log((n1 + 0.4) / (n0 + 0.4)) * (n0 + n1) / max(1, n0 + n1 + (mixing.DOUBT if k else 0))

    for i, text in texts.items():
        words = (text or "").split()
        paths, shift, total = list(decisions(words)), [0.0] * 3, 0.0
        for a in range(0, len(paths), mixing.BLOCK):
            moves, n = [0.0] * 3, 0
            for node, bit, own in (d for path in paths[a : a + mixing.BLOCK] for d in path):
                x = [odds(k, own[k], node) for k in range(3)]
                p = 1 / (1 + math.exp(-sum(v * (mixing.WEIGHTS[codes.gate[node], k] + shift[k]) for k, v in enumerate(x))))
                total += math.log10(p if bit else 1 - p)
                moves, n = [m + v * (bit - p) for m, v in zip(moves, x)], n + 1
            shift = [s + mixing.RATE * m / (8 * n) for s, m in zip(shift, moves)]
        for w in words:
            if w.encode() not in codes.symbols:
                k = mixing.bucket(w.encode())
                unknown = (once[k] + 1) / (mass[k] + once[k] + 2)
                total += math.log10((1 - unknown) * c[w] / mass[k] if c[w] else unknown)
        assert math.isclose(got[i][1], total, rel_tol=1e-2), (i, got[i], total)


def test_pairs_packed_and_summed():
    r = np.random.default_rng(1)
    for a in (np.zeros(0, np.int64), np.zeros(3, np.int64), np.array([0, 255, 256, 1 << 40]), r.integers(0, 1 << 20, 100).astype("<i4"), r.normal(0, 9, 50).astype("<f2")):
        assert np.array_equal(mixing.unpack(mixing.pack(a), a.dtype.str), a)
    odds = np.linspace(-24, 24, 4801)
    assert np.array_equal(mixing.coarse(-odds), -mixing.coarse(odds))
    assert np.all(np.abs(mixing.FINE[mixing.coarse(odds).view(np.uint8)] - odds) <= 0.01 + np.abs(odds) / 50)
    keys, n = mixing.summed(np.array([5, 2, 5, 9]), np.array([1, 2, 3, 0]))
    assert keys.tolist() == [2, 5, 9] and n.tolist() == [2, 4, 0]


def test_op8(spark, sf, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = sorted(len(tok.encode(t, add_special_tokens=False).ids) for t in texts.values())
    got = {r[0]: r[1:] for r in rows(QUERIES["op8_token_counts"](spark, sf), "tokens", "docs", "docs_over", "tokens_over", "truncated_tokens", "dropped_tokens", "quantile")}
    assert set(got) == set(n)
    for k in got:
        over = [x for x in n if x > k]
        assert got[k] == (n.count(k), len(over), sum(over), sum(min(x, k) for x in n), sum(n) - sum(min(x, k) for x in n), (len(n) - len(over)) / len(n))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert dict(rows(token_counts.quantile_lengths(token_counts.length_histogram(docs), (0.5, 0.9)))) == {q: n[math.ceil(q * len(n)) - 1] for q in (0.5, 0.9)}


def test_op9_held_out(labelled):
    from attesta.llm.toxicity import score_toxicity

    docs, labels = labelled
    got = {r[0]: r[1:] for r in rows(score_toxicity(docs, labels), "doc_id", "held_out", "score", "predicted")}
    truth = {r[0]: r[1] for r in rows(labels, "doc_id", "toxic")}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in truth if got[i][0]} == set(held)
    assert sum(got[i][2] == truth[i] for i in held) >= 0.97 * len(held)


def test_label_model_discounts_correlated_voters():
    from attesta.llm.toxicity import LabelModel, Sums
    from attesta.llm.trees import sigmoid

    r = np.random.default_rng(6)
    y = (r.random(4000) < 0.3).astype(float)
    vote = lambda hit, false: (r.random(4000) < np.where(y > 0, hit, false)).astype(float)
    a, b = vote(0.7, 0.02), vote(0.5, 0.01)
    votes = np.column_stack([a, a, a, b])
    seen, rest = slice(0, 1000), slice(1000, 4000)
    labelled, once = Sums.of(votes[seen], y[seen], np.ones(1000)), np.ones(3000)
    model = LabelModel.fit(labelled, (votes[seen].T @ votes[seen], votes[rest].T @ votes[rest]), lambda m: Sums.of(votes[rest], sigmoid(m.margin(votes[rest])), once))
    posterior = sigmoid(model.margin(votes))
    assert model.shares[0] < 0.5 and model.shares[3] > 0.9
    assert abs(model.rates[1, 3] - 0.5) < 0.06 and ((posterior > 0.5) == ((a > 0) | (b > 0))).mean() > 0.99


def test_label_model_by_brute_force(spark):
    """Tables of votes give the model that a plain loop over all rows gives."""
    from attesta.llm import toxicity
    from attesta.llm.trees import sigmoid

    r = np.random.default_rng(7)
    y = r.random(400) < 0.3
    fired = [[j for j in range(5) if r.random() < (0.4 if y[i] else 0.03)] for i in range(400)]
    x = toxicity.matrix([np.array(f, "<u2").tobytes() for f in fired], 5)
    table = spark.createDataFrame([(bytearray(np.array(f, "<u2").tobytes()), 1) for f in fired], "votes binary, times bigint").repartition(3)
    labelled = toxicity.Sums.of(x[:50], y[:50].astype(float), np.ones(50))
    together = toxicity.fired_together(table, 5)
    got = toxicity.LabelModel.fit(labelled, (x[:50].T @ x[:50], together), toxicity.expected_sums(table, 5), rounds=3)
    want, p = toxicity.LabelModel.made(labelled, x[:50].T @ x[:50]), None
    for _ in range(3):
        p = sigmoid(want.margin(x))
        rows_, votes_, squares, silent, pairs = np.zeros(2), np.zeros((2, 5)), np.zeros(3), np.zeros(2), np.zeros((5, 5))
        for q, v in [*zip(y[:50].astype(float), x[:50]), *zip(p, x)]:
            rows_ += [1 - q, q]
            votes_ += np.outer([1 - q, q], v)
            squares += [(1 - q) ** 2, q * (1 - q), q * q]
            silent += [(1 - q) * (not v.any()), q * (not v.any())]
            pairs += np.outer(v, v)
        want = toxicity.LabelModel.made(toxicity.Sums(rows_, votes_, squares, silent), pairs)
    residual = np.array([v - (1 - q) * want.rates[0] - q * want.rates[1] for q, v in [*zip(y[:50].astype(float), x[:50]), *zip(p, x)]])
    cov = residual.T @ residual / 450
    corr = np.clip(cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov))), 0, 1)
    assert np.allclose(got.rates, want.rates) and np.allclose(got.correlations, np.where(corr > 0.3, corr, 0)) and math.isclose(got.prior, want.prior) and math.isclose(got.silent, want.silent)


def test_op9_learns_words_beyond_the_lexicon(labelled):
    """Toxic texts whose toxic words no lexicon has, among them some only in unlabelled rows' company."""
    from pyspark.sql import functions as F

    from attesta.llm.toxicity import score_toxicity

    docs, labels = labelled
    docs = docs.withColumn("text", F.regexp_replace("text", "idiot", "grumblefex"))
    got = {r[0]: r[1] for r in rows(score_toxicity(docs, labels), "doc_id", "predicted")}
    truth = {r[0]: r[1] for r in rows(labels, "doc_id", "toxic")}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i] == truth[i] for i in held) >= 0.97 * len(held)


def test_op10():
    ids = licenses.identifiers("Intro. Released under the MIT License.\nThis program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License.", licenses.SENTENCES)
    assert [x for x, _ in ids] == ["mit-short", "gpl-free", "gpl-terms"]
    assert [m[0] for m in licenses.match_rules([x for x, _ in ids], licenses.RULES)] == ["MIT", "GPL"]
    assert licenses.match_rules(["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], licenses.RULES) == [("BSD-3-Clause", 0, 4)]


def test_op10_on_documents(spark, sf, texts):
    got = collections.Counter(r[1] for r in rows(QUERIES["op10_licenses"](spark, sf), "doc_id", "licence", "start"))
    lines = [x for t in texts.values() for x in t.split("\n")]
    assert got["MIT"] == sum("Released under the MIT License." in x for x in lines)
    assert got["CC-BY-NC-4.0"] == sum("Licensed under CC BY-NC 4.0." in x for x in lines)


STOCK = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
}
STOCK |= {
    "LGPL-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain worldwide.

You should have received a copy of the CC0 Public Domain Dedication along with this software.""",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
}
STOCK["BSD-3-Clause"] = STOCK["BSD-2-Clause"] + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("licence", STOCK)
def test_op10_stock_texts(licence, mark):
    for text in (STOCK[licence], re.sub(r"(?<=\S)\n *(?=\S)", " ", STOCK[licence])):
        marked = "\n".join(mark + line for line in text.split("\n"))
        ids = licenses.identifiers(marked, licenses.SENTENCES)
        found = licenses.match_rules([x for x, _ in ids], licenses.RULES)
        assert [m[0] for m in found] == [licence] and found[0][2] == len(ids)


@pytest.mark.parametrize("tag", ["MIT", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "CC-BY-4.0"])
def test_op10_tags(tag):
    for suffix in ("", "-or-later" if "GPL" in tag else ""):
        ids = licenses.identifiers(f"#!/bin/sh\n# SPDX-License-Identifier: {tag}{suffix}\nset -e", licenses.SENTENCES)
        assert [m[0] for m in licenses.match_rules([x for x, _ in ids], licenses.RULES)] == [tag]


def test_op10_every_rule(spark):
    """Each rule is found in a text of its sentences, wrapped behind comment marks, among other lines."""
    import textwrap

    sentence = {}
    for text, name in licenses.SENTENCES.items():
        sentence.setdefault(name, text)
    docs = []
    for i, (_, wanted) in enumerate(licenses.RULES):
        lines = [line for name in wanted for line in [*textwrap.wrap(sentence[name].capitalize() + ".", 50), "", "Some other line."]]
        docs.append((i, "Head of the file.\n" + "\n".join("# " + x for x in lines)))
    got = {r[0]: r[1] for r in rows(licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")), "id", "licence")}
    assert got == {i: licence for i, (licence, _) in enumerate(licenses.RULES)}


def test_op10_sentences_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "Use as you\nlike it. Thanks."), (2, "Nothing here.")], "doc_id bigint, text string")
    got = rows(licenses.scan(docs, sentences={"use as you like it": "free", "thanks": "polite"}, rules=(("Free", ("free", "polite")),)), "id", "licence", "n_sentences")
    assert got == [(1, "Free", 2)]


def test_measure_of_odd_texts():
    assert measure(None) == measure("") == ([0] * 5, measure("")[1])
    assert measure("a<b> c")[0] == [2, 5, 2, 0, 0]


def test_op4_rows_of_a_common_phrase_cost_no_comparison(monkeypatch):
    """Rows that share 20 tokens and no more stand, and are never compared; edited copies among them are found."""
    r, tried = np.random.default_rng(1), []
    around = r.integers(1, 1 << 24, (400, substring._WIDTH)).astype(np.uint32)
    around[:, substring.REACH - 10 : substring.REACH + 10] = r.integers(1, 1 << 24, 20)
    around[300] = around[100]
    around[300, 30:35] = r.integers(1, 1 << 24, 5)
    whole = substring.near_spans
    monkeypatch.setattr(substring, "near_spans", lambda x, y, *a: tried.append(len(x)) or whole(x, y, *a))
    links, stands = substring.near_links(around, np.full(400, 7, np.int64), np.arange(400))
    assert [(i, p) for i, _, _, p, _, _ in links] == [(300, 100)] and len(stands) >= 399 and sum(tried) < 10


def test_op4_skips_only_runs_that_add_nothing(monkeypatch):
    """Links are those of trying every pair."""
    r = np.random.default_rng(2)
    around = np.repeat(r.integers(1, 1 << 24, (3, substring._WIDTH)).astype(np.uint32), 50, axis=0)[r.permutation(150)]
    for row in around:
        for p in (r.integers(24, 42), r.integers(50, 66)):
            row[p - 4 : p + 1] = r.integers(1, 1 << 24, 5)
        row[: r.integers(0, 30)] = 0
    got = substring.near_links(around, np.zeros(150, np.int64), np.arange(150))
    whole = substring.near_spans
    monkeypatch.setattr(substring, "near_spans", lambda x, y, *_: whole(x, y))
    monkeypatch.setattr(substring, "SHARED", 0)
    want = substring.near_links(around, np.zeros(150, np.int64), np.arange(150))
    assert len(got[0]) > 20 and got[0] == want[0] and sorted(got[1]) == sorted(want[1])
