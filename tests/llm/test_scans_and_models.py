import hashlib
import math
import time
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpbooks.llm import context_tree, secrets, token_counts, topk_search, toxicity

from .conftest import words_of


def base_spans(text):
    kinds = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24))
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


SECRETS = [
    "token = \"11acdfb36bb72224148e6160f674b4be45601bff\"", "PassWord:'hunter2' api_key=abc secret=short1", "token=token: abcdefg", "AKIA" + "Z" * 16 + " AKIAB " + "a" * 24,
    "password=pass secret: é token=abcdef", "pwd := Zq8!vT#4mLp0x&Wd and pwd=password2019", "", "漢字 api-key: q7Xw9ZtR3mKp", "passwordpassword=secretsecret", "auth: aaaaaaaaaaaaaaaaaaaa",
]


def test_secret_spans(make):
    docs = make([(i, t, "s") for i, t in enumerate(SECRETS)] + [(100, None, None), (None, "token=abcdef", None), (None, "token=abcdef", None)])
    got = secrets.find(docs).collect()
    assert len(got) == len(SECRETS) + 3
    for r in got:
        text = "" if r.doc_id == 100 else "token=abcdef" if r.doc_id is None else SECRETS[r.doc_id]
        want = base_spans(text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x and not x.startswith("guess")) == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(f"{k}:") for k in secrets.BASE_KINDS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].n_guess == 1 and by_id[9].n_guess == 0
    assert secrets.find(docs.limit(0)).count() == 0


def span_cost(x, ranks):
    """What a span costs by each rule on its own, whatever the programme offers."""
    out, low, log = [], x.lower(), math.log10
    for w, more in ((low, 0), (low[::-1], log(2)), ("".join(dict(zip("@0$1!3457", "aosiieast")).get(c, c) for c in low), None)):
        if w in ranks and len(x) >= 3:
            changed = sum(a != b for a, b in zip(low, w))
            caps = sum(c.isupper() for c in x)
            out.append(log(ranks[w] + 1) + (log(2) * (1 + changed) if more is None else more) + (log(2) if caps else 0) + (log(len(x)) if 1 < caps < len(x) else 0))
    y, md = r"(19|20)\d\d", r"(0?[1-9]|1[0-2])"
    d, sep = r"(0?[1-9]|[12]\d|3[01])", "[-/._]"
    if re.fullmatch(f"{y}|{y}{sep}?{md}|{y}{sep}?{md}{sep}?{d}|{d}{sep}{md}{sep}(19|20)?\\d\\d", x):
        out.append(log(119) if len(x) == 4 else log(365.25 * 119))
    near = {a + b for r in secrets.ROWS for q in (r, r[::-1]) for a, b in zip(q, q[1:])}
    if len(x) >= 3 and all(low[k : k + 2] in near for k in range(len(x) - 1)):
        out.append(log(len(secrets.ROWS) * 20) + (len(x) - 1) * log(2))
    for p in range(1, len(x) // 2 + 1):
        if len(x) >= 3 and len(x) % p == 0 and low == low[:p] * (len(x) // p):
            out.append(p * log(secrets.alphabet(x[:p])) + 0.1 * (len(x) // p - 1))
    return min(out, default=math.inf)


def cheapest(value, ranks):
    """The minimum over all segmentations, from all spans."""
    each, best = math.log10(secrets.alphabet(value)), {}

    def go(i, before):
        """From i on, after a brute-force letter, another segment ("cut") or what needs no cut ("free")."""
        if i == len(value):
            return math.inf if i and before == "free" else 0.0
        if (i, before) not in best:
            pay = 0.0 if before == "free" else 1.0
            options = [go(i + 1, "brute") + each + (0.0 if before == "brute" else pay)]
            options += [go(j, "cut") + span_cost(value[i:j], ranks) + pay for j in range(i + 3, len(value) + 1)]
            if before != "free" and value[i] in secrets.SEPARATORS:
                options.append(go(i + 1, "free") + math.log10(6))
            best[i, before] = min(options)
        return best[i, before]

    return go(0, "free")


VALUES = ["password", "P4ssw0rd2019", "qwertyuiop", "aaaaaaaaab", "abcabcabc9", "x8Kq!2Lm", "secret2020-12-31admin", "zz", "", "aaaaaAdmin1", "drowssap", "qwertypassword", "3asdfg1.2.1999", "abababab", "aAaAaA1", "xyzxyz12xyz", "asdfghjkjhgf", "1999199919", "20201231", "your_api_key_here", "a-b", "-pass-", "user--name", "x8Kq_2Lm.Zz", "pass_"]


@pytest.mark.parametrize("value", VALUES)
def test_guess_cost(value):
    cost, cuts = secrets.guess_cost(value)
    assert cost == pytest.approx(cheapest(value, secrets.RANKS))
    assert "".join(value[a:b] for a, b, _ in cuts) == value
    assert cost <= len(value) * math.log10(secrets.alphabet(value) if value else 1) + 1e-9


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["pass", "word", "1999", "-12", "a", "ab", "qwe", "rty", "Admin", "0", "!", "12", "nimda", "_", "."]), max_size=5))
def test_guess_cost_is_least(parts):
    value = "".join(parts)
    assert secrets.guess_cost(value)[0] == pytest.approx(cheapest(value, secrets.RANKS))


@pytest.mark.parametrize("value", ["a1" * 500_000, "x" * 1_000_000, "qwerty" * 100_000, "".join(random.Random(1).choices("abcXYZ0189", k=300_000))])
def test_long_values_end_soon(value):
    assert secrets.guess_cost(value, None, secrets.ENOUGH) == (secrets.ENOUGH, [])
    assert secrets.guess_cost(value[:40])[0] == pytest.approx(secrets.guess_cost(value[:40], None, 1e9)[0])


def test_guess_cost_orders_values():
    ranks = secrets.ranked([*secrets.WORDS, *secrets.vocabulary_words(secrets.VOCABULARY)])
    costs = [secrets.guess_cost(v, ranks)[0] for v in ("password", "password1987", "mountainriver", "correcthorsebatterystaple", "f7!Kq9zR2mXwv8#Lp")]
    assert costs == sorted(costs) and costs[2] < secrets.MIN_LOG10 < costs[3]


def test_guess_cost_tells_secrets_from_placeholders():
    """300 random values of 12 letters, and 300 that people make up."""
    rng, ranks = random.Random(6), secrets.ranked([*secrets.WORDS, *secrets.vocabulary_words(secrets.VOCABULARY)])
    words = [w for w in secrets.vocabulary_words(secrets.VOCABULARY)[2000:12000] if len(w) > 4]
    keys = ["".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(12)) for _ in range(300)]
    made_up = [rng.choice([rng.choice(words) + str(rng.randint(1950, 2025)), rng.choice(words).capitalize() + "123", rng.choice(words)[::-1], "qwerty" * rng.randint(1, 3), rng.choice(secrets.WORDS) + rng.choice(secrets.WORDS), "x" * rng.randint(6, 40), f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1950, 2020)}"]) for _ in range(300)]
    found = sum(secrets.guess_cost(v, ranks)[0] >= secrets.MIN_LOG10 for v in keys)
    wrong = sum(secrets.guess_cost(v, ranks)[0] >= secrets.MIN_LOG10 for v in made_up)
    print("found", found, "wrong", wrong)
    assert found >= 297 and wrong <= 3


def test_names_and_placeholders_are_no_secrets():
    """300 names of two to four common words as code has them, and 300 random keys in groups."""
    rng, ranks = random.Random(9), secrets.ranked([*secrets.WORDS, *secrets.vocabulary_words(secrets.VOCABULARY)])
    common = [w for w in secrets.WORDS if len(w) > 2]
    names = ["your_api_key_here", "process.env.TOKEN", "config.settings.api", "user_password_field", "os.environ", "my-secret-token"]
    names += [rng.choice("_-.").join(rng.choices(common, k=rng.randint(2, 4))) for _ in range(294)]
    keys = ["-".join("".join(rng.choices("abcdefghjkmnpqrstuvwxyz23456789", k=4)) for _ in range(4)) for _ in range(300)]
    wrong = [v for v in names if secrets.guess_cost(v, ranks)[0] >= secrets.MIN_LOG10]
    found = sum(secrets.guess_cost(v, ranks)[0] >= secrets.MIN_LOG10 for v in keys)
    print("found", found, "wrong", len(wrong), wrong[:5])
    assert found == 300 and len(wrong) <= 15


def test_token_histogram(spark, make, sample):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = [len(coder.encode_ordinary(t or "")) for _, t, _ in sample]
    sums = token_counts.suffix_sums(token_counts.length_histogram(make(sample)), block=16).cache()
    got = {r.n_tokens: (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_total) for r in sums.collect()}
    assert got == token_counts.brute(lengths)
    limits = {r.context_limit: (r.truncated_total, r.docs_cut) for r in token_counts.totals_at(sums, [0, 7, 512, 10**6]).collect()}
    assert limits == {x: (sum(min(n, x) for n in lengths), sum(n > x for n in lengths)) for x in (0, 7, 512, 10**6)}
    half = token_counts.quantiles(sums, [0.5]).first().n_tokens
    assert half == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(make([(1, "a", "s")]).limit(0))).count() == 0


@pytest.mark.parametrize("text", ["a" + " " * 20_000 + "b", " " * 20_001, "x\n" + "\n" * 15_000 + "7", "\t" * 12_000 + " b " + "\u3000" * 11_000 + "!", "a\x1c" * 12_000])
def test_long_white_space_is_cut_where_the_pattern_cuts(text):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert token_counts.n_tokens(coder, text) == len(coder.encode_ordinary(text))


def test_very_long_texts(make):
    rows = [(1, " " * 2_000_000 + "a", "s"), (2, "ab " * 1_000_000, "s"), (3, "7" * 1_500_000, "s")]
    assert token_counts.length_histogram(make(rows)).count() == 3
    spans = {r.doc_id: r for r in secrets.find(make([*rows, (4, "x " * 2_000_000 + "password=Zq8vT4mLp0xWd", "s"), (5, "token=" + "a1" * 500_000, "s")])).collect()}
    assert spans[4].spans.startswith("assign:4000000:") and spans[5].n_assign == 1


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 30])]) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # one very common vector
    odd = [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (2200, []), (2250, [2.0, 1.0]), (2300, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(7)
    good = [(i, [math.floor(256 * x) for x in v] + [0] * (8 - len(v))) for i, v in rows + odd[4:7]]
    want = set()
    for i, q in good:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i)[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)}
    got = topk_search.topk(df, F.col("vec_id") % 50 == 0, query_block=10, first_bucket=64)
    assert {tuple(r) for r in got.collect()} == want
    assert topk_search.topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = topk_search.topk(df.filter("vec_id in (0, 7, 9)"), F.col("vec_id") % 50 == 0)
    assert few.count() == 2


def test_topk_of_repeated_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 2.0]), (50, [1.0, 0.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [-1.0, 5.0]), (100, [0.5, 0.5])]
    got = topk_search.topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0, k=3)
    want = []
    for n, (i, q) in enumerate(rows):
        if i % 50 == 0:
            others = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(rows) if m != n)[:3]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(others)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 12


def test_white_space_in_many_runs_is_quick(make):
    text = ("x" + " " * 9_999) * 300
    began = time.time()
    assert token_counts.length_histogram(make([(1, text, "s")])).count() == 1
    assert time.time() - began < 15


def test_topk_large_values(spark):
    df = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, 5.0]), (2, [-1e6, 1.0]), (3, [1e15, 1e15])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk_search.topk(df, F.col("vec_id") == 0).collect()}
    assert got == {1: 256000000**2 + 768 * 1280, 2: -(256000000**2) + 768 * 256, 3: 2**63 - 1}


def kt_tree_bits(train, test, depth):
    """log10 probability of the last byte's bits by a plain context-tree mixture."""
    nodes = {}
    for ctx, sym in train:
        for k in range(8):
            prefix, bit = (1 << k) | (sym >> (8 - k)), (sym >> (7 - k)) & 1
            for d in range(depth + 1):
                nodes.setdefault((prefix, ctx[depth - d :]), [0, 0])[bit] += 1

    def log_kt(a, b):
        out = 0.0
        for k in range(a):
            out += math.log((k + 0.5) / (k + 1))
        for k in range(b):
            out += math.log((k + 0.5) / (a + k + 1))
        return out

    kids = {}
    for prefix, ctx in nodes:
        if ctx:
            kids.setdefault((prefix, ctx[1:]), []).append((prefix, ctx))
    logw = {}

    def weighted(key):
        if key not in logw:
            own = log_kt(*nodes[key])
            logw[key] = own if len(key[1]) == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(weighted(c) for c in kids.get(key, ())))
        return logw[key]

    out = []
    for ctx, sym in test:
        total = 0.0
        for k in range(8):
            prefix, bit = (1 << k) | (sym >> (8 - k)), (sym >> (7 - k)) & 1
            p = None
            for d in range(depth, -1, -1):
                key = (prefix, ctx[depth - d :])
                a, b = nodes.get(key, (0, 0))
                own = (b + 0.5) / (a + b + 1)
                share = 1.0 if d == depth else math.exp(math.log(0.5) + log_kt(a, b) - weighted(key)) if key in nodes else 0.5
                p = own if p is None else share * own + (1 - share) * p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def contexts(text, depth):
    data = bytes([255] * depth) + bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()) + b"\xff"
    return [(data[i - depth : i], data[i]) for i in range(depth, len(data))]


def test_context_tree_scores(make):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAé \n") for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "zzz new"]
    docs = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "ab ab", "s"), (7, texts[7], "s")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    assert any(held(i) for i, _, _ in docs)
    depth, train = 3, [x for i, t, _ in docs if not held(i) for x in contexts(t, 3)]
    tokens = Counter(w for i, t, _ in docs if not held(i) for w in [*words_of(t), None])
    n, floor = sum(tokens.values()), sum(tokens.values()) + 0.5 * (len(tokens) + 1)
    for frequent in (1 << 21, 50):  # 50: most keys take the join
        rows = context_tree.scored(make(docs).repartition(3), depth=depth, frequent=frequent).collect()
        assert len(rows) == len(docs)
        for r in rows:
            text = "ab ab" if r.doc_id is None else texts[r.doc_id]
            own = [*words_of(text), None]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(tokens[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(math.log10((tokens[w] + 0.5) / floor) for w in own), abs=1e-6)
            assert r.score == pytest.approx(sum(kt_tree_bits(train, contexts(text, depth), depth)), abs=1e-6)
    assert context_tree.scored(make(docs).limit(0)).count() == 0


def test_contexts_come_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(context_tree, "_TAKEN", 10)
    at = np.sort(np.random.default_rng(1).integers(0, 12, 200))
    rows = pa.table({"key": np.arange(200), "n": np.arange(200), "context": at})
    got = list(context_tree._contexts(rows.to_batches(max_chunksize=7)))
    assert np.concatenate([k for k, _ in got]).tolist() == list(range(200)) and len(got) > 3
    seen = [set(at[k]) for k, _ in got]
    assert all(not a & b for a, b in zip(seen, seen[1:]))


def test_context_tree_anchor_falls_back(spark):
    codes = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 500))
    table = spark.createDataFrame([(int(c), int(c) % 7) for c in codes], "key long, n long")
    whole = {r.key: r.x for r in context_tree.predicted(table, depth=3).collect()}
    less = {r.key: r.x for r in context_tree.predicted(table, depth=3, most_above=0).collect()}
    assert whole.keys() == less.keys() and all(whole[k] == pytest.approx(less[k]) for k in whole)


def test_upper_nodes_as_a_table(spark, monkeypatch):
    """Random bytes, so that most nodes above the anchor differ, and few letters, so that they are shared; some contexts at a time."""
    monkeypatch.setattr(context_tree, "_TAKEN", 500)
    rng = np.random.default_rng(4)
    few = rng.choice(np.array([97, 98, 99, 255]), (3000, 6)) @ (256 ** np.arange(6))
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 48, 1500), few]))
    table = spark.createDataFrame([(int(c), int(c) % 5) for c in codes], "key long, n long")
    whole = {r.key: r.x for r in context_tree.predicted(table).collect()}
    joined = {r.key: r.x for r in context_tree.predicted(table, most_above=0).collect()}
    assert len(whole) == len(codes) and whole.keys() == joined.keys() and all(whole[k] == pytest.approx(joined[k]) for k in whole)


def test_ordinal_model_recovers_order():
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(1500)]
    w = np.concatenate([np.full(3, 3.0), np.zeros(9)])
    z = np.array([w[r].sum() for r in rows]) + rng.logistic(size=1500)
    grade = (z > 2).astype(int) + (z > 5)
    m = toxicity.Ordinal.fit(rows, grade, 12, 3, np.ones(1500))
    assert m.thresholds[0] < m.thresholds[1] and m.weights[:3].min() > 1.5 > np.abs(m.weights[3:]).max()
    above = m.at_least(np.array([0.0, 3.0, 6.0]))
    assert (np.diff(above, axis=0) > 0).all() and (above[:, 0] > above[:, 1]).all()


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(8)
    n, rows = 6, [np.flatnonzero(rng.random(6) < 0.5) for _ in range(40)]
    at, col = np.repeat(np.arange(40), [len(r) for r in rows]), np.concatenate(rows)
    grades, share, p = rng.integers(0, 4, 40), rng.random(40), rng.normal(size=n + 3) * 0.5
    _, g = toxicity.loss(p, at, col, grades, share / share.sum(), n, 0.3)
    for k in range(len(p)):
        step = np.eye(len(p))[k] * 1e-6
        up, down = (toxicity.loss(p + d, at, col, grades, share / share.sum(), n, 0.3)[0] for d in (step, -step))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_threshold_errs_least():
    rng = np.random.default_rng(9)
    for _ in range(20):
        toxic, weight = rng.random(60) < 0.3, rng.integers(1, 4, 60).astype(float)
        p = np.round(np.clip(toxic * 0.3 + rng.random(60) * 0.7, 0, 1), 2)
        wrong = lambda t: (weight * (toxic != (p >= t))).sum()
        assert wrong(toxicity.best_threshold(p, toxic, weight)) == min(wrong(t) for t in np.linspace(-0.005, 1.005, 102))


def test_toxicity_held_out(spark, make):
    rng = random.Random(2)
    vocabulary, bad = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], ["vileone", "viletwo", "grimthing", "foulword"]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for x in rng.choices(bad, k=4):
                w.insert(rng.randint(0, len(w)), x)
        docs.append((i, " ".join(w), "s"))
        if i % 2 == 0 and i != 4:
            labels.append((i, 1, int(toxic)))
    docs += [(5000, None, None), (5001, "", None), (None, "plain", None)]
    table, names = make(docs), spark.createDataFrame(labels + [(4, 1, None), (None, 1, 1), (77777, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    grader = toxicity.fit(table, names)
    rows = toxicity.grade(table, grader).select("row.doc_id", "grade", "expected_severity", "p_toxic", "toxic").collect()
    assert len(rows) == len(docs)
    wrong = sum(r.toxic != (r.doc_id is not None and r.doc_id < 900 and r.doc_id % 5 == 0) for r in rows)
    assert wrong <= 5
    kept = toxicity.accepted(table, grader)
    assert kept.columns == table.columns and kept.count() == sum(not r.toxic for r in rows)
    none = toxicity.fit(table, names.limit(0))
    assert toxicity.grade(table, none).filter("toxic").count() == 0
    assert toxicity.accepted(table.limit(0), grader).count() == 0
