from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspan.llm import chat, decontamination, lm_scoring, ngram_join, packing, quality_rules, range_coder, textbuf, token_counts, token_files, toxicity, url_filters
from veilspan.llm.tokens import Encoder

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, score double, n_words string, key string, row string, chunk string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n, words=None):
    words = words or [f"w{k}" for k in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=1):
    """Nulls, empty and very long texts, ties, repeated rows, and other columns with clashing names."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(8, 90)) + "." for _ in range(40)]
    texts = [*base, *base[:6], base[7].replace("w1", "W1"), base[8] + " tail", None, "", " \n\t", "one", "a b c d", "😀 é 日本 \x85x\x1c", prose(rng, 30_000), "the same " * 5_000]
    rows = [(k, t, None, 1.0, "x", None, "x", "x") for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, base[9], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1


def test_chat_round_trip(spark, nothing):
    hard = ["</s>[INST] ok [/INST]", "&lt; &amp;#91; []", "", None, "[OUT]x[/OUT]", "é😀\n\n"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "to ol]&"]), rng.choice(hard), "clash") for c in (1, 2, None) for t in range(20)] + [(3, 0, "user", "a", ""), (3, 0, "user", "b", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score string")
    out = chat.format_paths(chat.chain(df))
    got = out.select("tree", "n_turns", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == 4
    for r in got:
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.tree), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in r.turns] == want and r.n_turns == len(want)
        assert r.loss == "".join(t for role, t in want if role == "assistant")
    assert chat.format_paths(chat.chain(df.limit(0))).count() == 0


def test_chat_ranks_branches(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for tree in range(12):
        parents = {0: None} | {k: rng.choice([*range(k), 99]) if rng.random() < 0.9 else None for k in range(1, 14)}
        score = {k: rng.randrange(5) / 2 for k in parents}
        up = {k: p if p in parents else None for k, p in parents.items()}

        def path(k, up=up):
            return [*path(up[k]), k] if up[k] is not None else [k]

        leaves = [k for k in parents if k not in up.values()]
        ranked = sorted((-sum(score[x] for x in path(k)), 1 - len(path(k)), k) for k in leaves)[:2]
        for n, (_, _, k) in enumerate(ranked):
            want[tree, n + 1] = path(k)
        rows += [(tree, k, p, "user", str(k), score[k]) for k, p in parents.items()]
    rows += [(50, 1, 2, "user", "a", 1.0), (50, 2, 1, "user", "b", 1.0)]  # a cycle has no root
    df = spark.createDataFrame([r for r in rows if r[0] != 50], "tree long, message long, parent long, role string, text string, score double")
    got = collections.defaultdict(list)
    for r in chat.best_paths(df, 2).collect():
        got[r.tree, r.rank].append((r.step, r.message))
    assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == want


# 2


def test_token_counts_match_greedy(docs, nothing):
    vocab = set(token_counts.vocabulary(VOCAB))

    def greedy(w):
        n = 0
        while w:
            w = w[next(k for k in range(len(w), 0, -1) if w[:k] in vocab) :]
            n += 1
        return n

    known = {r[0]: r[1] for r in corpus() if r[0] is not None}
    for r in token_counts.count_tokens(docs, VOCAB).collect():
        if r.doc_id is not None:
            words = WORD.findall(known[r.doc_id] or "")
            assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w.encode()) for w in words))
    assert token_counts.count_tokens(nothing, VOCAB).count() == 0


def test_automaton_on_small_vocabularies():
    rng = random.Random(6)
    for _ in range(30):
        tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 6))) for _ in range(8)}
        machine = token_counts.Automaton(tokens)
        for _ in range(40):
            word, n = bytes(rng.choice(b"abc") for _ in range(rng.randrange(15))), 0
            left = word
            while left:
                left = left[next(k for k in range(len(left), 0, -1) if left[:k] in tokens) :]
                n += 1
            assert machine.count(word) == n
    with pytest.raises(ValueError):
        token_counts.Automaton([b"a"])


# 3


def page_rank(edges, seeds, steps=8, d=0.85):
    out = collections.Counter()
    for (a, _), w in edges.items():
        out[a] += w
    rank = dict(seeds)
    for _ in range(steps):
        new = collections.Counter({h: m * (1 - d) for h, m in seeds.items()})
        for (a, b), w in edges.items():
            new[b] += rank.get(a, 0) * w / out[a] * d
        rank = new
    return rank


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_url_rules(spark):
    cases = [
        ("http://a.NET/x", "a.net", "/x", "net/"),
        ("http://net", "net", "", None),
        ("http://x.example.net/en/1?q#f", "x.example.net", "/en/1", "example.net/en/"),
        ("http://x.example.net/fr?/en/", "x.example.net", "/fr", "net/"),
        ("https://example.com?/de/", "example.com", "", None),
        ("https://example.com/de/", "example.com", "/de/", "example.com/de/"),
        ("x://a.org/fr/://b", "a.org", "/fr/://b", "org/fr/"),
        ("http://myexample.com/de/", "myexample.com", "/de/", None),
        ("http://É.ORG/fr/\nx", "É.org", "/fr/\nx", "org/fr/"),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
    ]
    df = spark.createDataFrame([(k, c[0], None, "clash") for k, c in enumerate(cases)], "page_id long, url string, html string, host string")
    for r in url_filters.judge(df, RULES).collect():
        assert (r.host, r.path, r.rule) == cases[r.page_id][1:]
        if r.rule:
            assert r.verdict == {rule: verdict for verdict, rule in RULES}[r.rule]
        elif r.host in ("", "myexample.com"):  # neither linked nor a seed
            assert r.verdict == "allow"
    assert url_filters.judge(df.limit(0), RULES).count() == 0


def test_url_propagation(spark):
    rng = random.Random(8)
    hosts = ["good.org", "bad.net", *(f"h{k}.com" for k in range(8))]
    rows, edges, count = [], collections.Counter(), collections.Counter()
    for k in range(80):
        h = rng.choice(hosts)
        path = "/fr/" if h.endswith("org") else "/x"
        links = [rng.choice(hosts) for _ in range(rng.randrange(4))]
        html = "".join(f'<a class="x" href="http://{x}/p">y</a>' for x in links) + '<a href="/own">z</a>'
        rows.append((k, f"http://{h}{path}", html))
        count[h] += 1
        for x in [*links, h]:
            edges[h, x] += 1
    trust = page_rank(edges, {"good.org": 1.0})
    distrust = page_rank({(b, a): w for (a, b), w in edges.items()}, {"bad.net": 1.0})
    seen = set()
    for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect():
        assert r.trust == pytest.approx(trust.get(r.host, 0)) and r.distrust == pytest.approx(distrust.get(r.host, 0))
        if r.rule is None:
            assert r.verdict == ("block" if distrust.get(r.host, 0) > trust.get(r.host, 0) else "allow")
            seen.add(r.verdict)
    assert seen == {"allow", "block"}


def test_url_ranks_settle(spark, tmp_path):
    from veilspan.llm import queries

    link = lambda h: f'<a href="http://{h}/">x</a>'
    chain = ["bad.net", *(f"h{k}.com" for k in range(1, 13))]
    rows = [(k, f"http://{h}/", link(chain[k - 1]) if k else "") for k, h in enumerate(chain)]
    ring = ["good.org", *(f"r{k}.com" for k in range(5))]
    rows += [(100 + k, f"http://{h}/fr/", link(ring[(k + 1) % 6]) + link(ring[k * k % 6])) for k, h in enumerate(ring)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    verdicts = {r.host: r.verdict for r in queries.op3_url_filters(spark, str(tmp_path)).collect()}
    assert {verdicts[h] for h in chain} == {"block"} and {verdicts[h] for h in ring} == {"allow"}
    edges = collections.Counter({(ring[k], ring[j % 6]): 0 for k in range(6) for j in (k + 1, k * k)})
    for k in range(6):
        edges[ring[k], ring[(k + 1) % 6]] += 1
        edges[ring[k], ring[k * k % 6]] += 1
    want = page_rank(edges, {"good.org": 1.0}, steps=400)
    for r in url_filters.judge(df, RULES, steps=None).where("page_id >= 100").collect():
        assert r.trust == pytest.approx(want[r.host], abs=1e-9)


# 4 and 8


@pytest.mark.parametrize("block", [16, 100, 1024])
def test_range_coder_round_trip(block):
    rng = np.random.default_rng(1)
    for ids in ([], [5], [0] * 50, [65535] * 300, list(range(300)) * 3, rng.integers(0, 65536, 3000), rng.zipf(1.3, 3000) % 50257):
        ids = np.array(ids, "<u2")
        data = range_coder.encode(ids, block)
        assert np.array_equal(range_coder.decode(data), ids)
        if len(ids) > block:
            parts = np.array_split(ids, -(-len(ids) // block))
            assert np.array_equal(range_coder.decode(data, only=[1]), parts[1])
            assert np.array_equal(range_coder.decode(data, only=[1, 0]), np.concatenate([parts[1], parts[0]]))


def test_range_coder_uses_all_orders():
    """Far below the order-0 entropy where contexts tell, near it where they don't, for whole lanes and rests."""
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 3000, (2, 400_003)).min(axis=0).astype("<u2")
    share = np.bincount(flat) / len(flat)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    data = range_coder.encode(flat)
    assert np.array_equal(range_coder.decode(data), flat)
    assert len(data) * 8 < 1.05 * entropy * len(flat)
    follows = rng.permutation(3000)
    chained = np.empty(400_003, dtype="<u2")
    x = 0
    for k, jump in enumerate(rng.random(len(chained)) < 0.1):
        x = int(rng.integers(3000)) if jump else int(follows[x])
        chained[k] = x
    data = range_coder.encode(chained)
    assert np.array_equal(range_coder.decode(data), chained)
    assert len(data) * 8 < 4 * len(chained)  # order 0 alone needs 11.5 bits an id


def test_range_coder_on_texts(docs):
    ids = np.concatenate([np.array(ids_of(r[1], 2)) for r in corpus()]).astype("<u2")
    data = range_coder.encode(ids)
    assert np.array_equal(range_coder.decode(data), ids) and len(data) < 0.6 * 2 * len(ids)


def test_range_coder_compresses_and_detects_damage():
    ids = np.array([3, 900, 17, 4, 4] * 2000, "<u2")
    data = range_coder.encode(ids)
    assert len(data) < len(ids) / 4
    bad = bytearray(data)
    bad[len(data) // 2] ^= 255
    with pytest.raises(ValueError):
        range_coder.decode(bytes(bad))
    with pytest.raises(ValueError):
        range_coder.decode(b"x" * 40)


def test_encoder_matches_library():
    """Against the plain library, which takes the name of a special token within a text for that token."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCAB)
    rng = random.Random(4)
    odd = "ab é'stre \n\t.,12½ªµ—–\xa0\x85\xadœ\x1c…€“日😀"
    texts = [r[1] or "" for r in corpus()] + ["I'll 've'd 'x", " \n\n a  b", "½ ²3 <|endoftext|>", "a<|endoftext|>b", "<|endoftext", "\x1f\x1e x\x1f", "\xa0\x85 z", "\x00", "x" * 70_000]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(500)]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert 50256 in want[texts.index("a<|endoftext|>b")]
    for max_chars in (2000, 1 << 24):
        assert [np.frombuffer(x, "<u2").tolist() for x in Encoder(VOCAB, max_chars).batch(texts)] == want


def test_token_files(spark, docs, nothing):
    rows = sorted((r for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = collections.defaultdict(list)
    for r in token_files.round_trip(docs, VOCAB, container_ids=9000, block=5000).collect():
        got[r.doc_id].append((r.start, r.n_tokens, r.ids_crc32))
    at = 0
    for doc_id, group in itertools.groupby(rows, key=lambda r: r[0]):
        all_ = [ids_of(r[1], 2) for r in group]
        assert sorted(n for _, n, _ in got[doc_id]) == sorted(map(len, all_))
        assert sorted(c for *_, c in got[doc_id]) == sorted(map(crc, all_))
        for start, n, _ in sorted(got[doc_id]):
            assert start == at
            at += n
    assert token_files.round_trip(nothing, VOCAB).count() == 0


def test_packing(docs, nothing):
    pieces = packing.pack(docs, VOCAB).collect()
    want = {r[0]: ids_of(r[1], 1) for r in corpus() if r[0] is not None}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        if p.doc_id is not None and p.doc_id != 3:
            by_doc[p.doc_id].append((p.start, p.length))
            ids = want[p.doc_id]
            assert p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    for runs in [*by_doc.values(), *by_sequence.values()]:
        at = 0
        for start, n in sorted(runs):
            assert start == at and n > 0
            at += n
    assert all(sum(n for _, n in by_doc[d]) == len(ids) for d, ids in want.items() if d != 3)
    short = [s for s in (sum(n for _, n in v) for v in by_sequence.values()) if s < 2048]
    assert len(short) <= 3 and all(sum(n for _, n in v) <= 2048 for v in by_sequence.values())
    assert packing.pack(nothing, VOCAB).count() == 0


def test_packer_takes_least_sum_of_squares():
    rng, p = random.Random(3), packing.Packer(16)
    for k in range(300):
        r = rng.randrange(1, 16)
        n = p.levels.copy()
        n[16] = 0

        def cost(h, n=n, r=r):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + r < 16:
                m[h + r] += 1
            return int((m**2).sum())

        allowed = [h for h in range(17 - r) if h == 0 or n[h] > 0]
        assert cost(p.choose(r)) == min(map(cost, allowed))
        list(p.place((k, 0, bytes(2 * r), r)))
    small = packing.Packer(16, max_open=4)
    out = [x for k in range(100) for x in small.add(k, bytes(2 * (1 + k % 15)))] + list(small.drain())
    assert small.n_open == 0 and sum(len(p[2]) // 2 for x in out for p in x) == sum(1 + k % 15 for k in range(100))


# 5


def test_nearest_is_exact():
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        row = {t: rng.random() for t in rng.sample(range(12), rng.randrange(4))}
        norm = math.sqrt(sum(w * w for w in row.values()))
        rows.append({t: w / norm for t, w in row.items()})
    as_vector = lambda row: (np.array(sorted(row), dtype=np.int64), np.array([row[t] for t in sorted(row)]))
    index = toxicity.BlockMaxIndex([as_vector(r) for r in rows + rows[:20]], 12, block=8)
    for q in rows[:60]:
        score = [(-round(sum(w * r.get(t, 0) for t, w in q.items()), 12), k) for k, r in enumerate(rows + rows[:20])]
        want = sorted(s for s in score if s[0] < 0)[:7]
        got, sims = index.nearest(as_vector(q), 7)
        assert [k for _, k in want] == got.tolist() and np.allclose([-s for s, _ in want], sims)


def test_nearest_takes_terms_of_no_length():
    """Weights whose squares vanish beside 1 count as well."""
    term = np.arange(400)
    for seed in range(20):
        rng = np.random.default_rng(seed)
        rows = []
        for _ in range(40):
            w = rng.random(400) * np.where(rng.random(400) < 0.02, 1.0, 1e-9)
            rows.append((term, w / np.sqrt((w * w).sum())))
        index = toxicity.BlockMaxIndex(rows, 400, block=8)
        want = np.round(np.array([w for _, w in rows]) @ rows[0][1], 12)
        got, sims = index.nearest(rows[0], 30)
        assert np.allclose(sims, np.sort(want)[::-1][:30]) and np.allclose(want[got], sims)


def plain_toxicity(examples, texts, k=15):
    """Dense cosines over all terms, similarity-weighted votes, and the best rising fit of labels over leave-one-out votes."""
    words = [collections.Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for _, t, _ in examples]
    y = np.array([label for *_, label in examples], dtype=float)
    vocabulary = sorted(set().union(*words))
    has = np.array([[w in c for w in vocabulary] for c in words], dtype=float)
    df, hits, n = has.sum(axis=0), (has * y[:, None]).sum(axis=0), len(y)
    table = np.array([hits, df - hits, y.sum() - hits, n - y.sum() - df + hits])
    expected = np.array([df * y.mean(), df * (1 - y.mean()), (n - df) * y.mean(), (n - df) * (1 - y.mean())])
    chi = ((table - expected) ** 2 / np.where(expected, expected, 1)).sum(axis=0) / n
    weight = (np.log((1 + n) / (1 + df)) + 1) * chi**2

    def vector(counts):
        v = np.array([(1 + math.log(counts[w])) if counts.get(w) else 0.0 for w in vocabulary]) * weight
        return v / np.linalg.norm(v) if v.any() else v

    matrix = np.array([vector(c) for c in words])
    empty = ~matrix.any(axis=1)
    bare = y[empty].mean() if empty.any() else y.mean()

    def vote(v, skip=None):
        sims = sorted((-round(float(s), 10), r) for r, s in enumerate(matrix @ v) if r != skip and s > 1e-12)[:k]
        return sum(s * y[r] for s, r in sims) / sum(s for s, _ in sims) if sims else bare

    votes = np.array([vote(v, r) if v.any() else bare for r, v in enumerate(matrix)]).round(9)
    cuts = np.unique(votes)
    means = {(a, b): y[(votes >= cuts[a]) & (votes <= cuts[b])].mean() for a in range(len(cuts)) for b in range(a, len(cuts))}
    values = [max(min(means[a, b] for b in range(x, len(cuts))) for a in range(x + 1)) for x in range(len(cuts))]  # isotonic regression by its max-min formula
    return [float(np.interp(vote(vector(collections.Counter(re.findall(r"[^\W\d_]+", (t or "").lower())))), cuts, values)) for t in texts]


def test_toxicity_equals_a_plain_version(spark):
    rng = random.Random(17)
    texts = [prose(rng, rng.randrange(3, 30), [f"w{chr(97 + j)}{chr(97 + i)}" for i in range(9) for j in range(9)]) for _ in range(160)]
    texts = [t + (" vile" * rng.randrange(1, 3) if k % 4 == 0 else "") + (" rude" if k % 6 == 0 else "") for k, t in enumerate(texts)]
    texts[7] = texts[8] = None
    texts[9] = texts[10]
    examples = [(k, texts[k], int(k % 4 == 0 or k % 13 == 0)) for k in range(100)]
    model = toxicity.fit_examples(examples, block=8)
    got = [model.scorer(3)(t) for t in texts]
    assert [g[0] for g in got] == pytest.approx(plain_toxicity(examples, texts), abs=1e-6)
    assert sum(not g[2] for g in got) == 2  # the nulls only; all others have evidence
    assert all(x == y for x, y in zip(got, [model.scorer(3)(t) for t in texts], strict=True))


def test_toxicity_examples_are_bounded_in_characters(spark):
    df = spark.createDataFrame([(k, "word " * 100 if k % 2 else "vile " * 1000) for k in range(40)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, toxic int")
    ids = toxicity.fit(df, lab, F.lit(True), max_chars=30_000).ids
    assert sum(500 if k % 2 else 5000 for k in ids) <= 30_000 and any(k % 2 == 0 for k in ids) and sum(k % 2 for k in ids) > 5


def test_toxicity(spark, nothing):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        text = prose(rng, 40) + (" Vile! " + prose(rng, 5) if bad else "")
        rows.append((k, text, None, None, None, None, None, None))
        labels.append((k, int(bad), None))
    rows += [(900, None, None, None, None, None, None, None), (901, "", None, None, None, None, None, None), (902, "vile " * 50_000, None, None, None, None, None, None), rows[0]]
    labels += [(0, 1, 1), (None, 1, 1), (5, None, 0), (7777, 1, 0)]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, lab, F.col("doc_id") % 3 != 2)
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    for k in range(600):
        assert (out[k].score >= 0.3) == (k % 5 == 0)
    assert out[902].score >= 0.3 and out[900].score == out[901].score < 0.3
    assert all(x < 600 and x % 3 != 2 for x in out[0].neighbour_ids)
    assert toxicity.keep_clean(df, model).columns == df.columns
    assert toxicity.keep_clean(df, model).where("doc_id < 600").count() == 480
    assert toxicity.score(nothing, model).count() == 0
    often = df.unionByName(df.where("doc_id = 0").withColumn("text", F.lit(None).cast("string")))
    for _ in range(3):
        often = often.unionByName(often.where("doc_id = 0"))
    again = toxicity.fit(often, lab, F.col("doc_id") % 3 != 2)
    assert (again.ids, again.values.tolist()) == (model.ids, model.values.tolist())  # an id is one example, however many rows it has
    blank = toxicity.fit(df, lab.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(df, blank).collect()} == {0.0}

def test_toxicity_frequencies_are_of_all_documents(spark):
    rows = [(k, "vile words here" if k % 2 else "kind words here") for k in range(80)]
    rows += [(100 + k, "Vile vile, of no label" if k < 30 else None) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab, F.lit(True))
    idf = {"vile": math.log(131 / 71) + 1, "kind": math.log(131 / 41) + 1, "words": math.log(131 / 81) + 1, "here": math.log(131 / 81) + 1}
    assert {w: model.idf[t] for w, t in model.term.items()} == pytest.approx(idf)



# 6


def near_brute(rows, threshold=0.8):
    sets = []
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    group, links = list(range(n)), [0] * n

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            group[find(b)] = find(a)
    least = {}
    for k in range(n):
        known = [rows[j][0] for j in range(n) if find(j) == find(k) and rows[j][0] is not None]
        least[k] = min(known) if known else None
    return sorted((rows[k][0] is not None, rows[k][0] or 0, least[k] is not None, least[k] or 0, links[k]) for k in range(n))


@pytest.mark.parametrize("tile", [3, 256])
def test_near_classes(spark, tile, nothing):
    rng = random.Random(11)
    words = prose(rng, 120).split()
    family = []
    for k in range(40):  # many different texts near each other
        w = list(words)
        w[rng.randrange(len(w))] = f"z{k}"
        family.append((200 + k, " ".join(w), None, None, None, None, None, None))
    rows = corpus() + family
    got = ngram_join.near_classes(spark.createDataFrame(rows, DOCS), tile=tile).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.class_id is not None, r.class_id or 0, r.n_links) for r in got) == near_brute(rows)
    kept = ngram_join.keep_first(spark.createDataFrame(rows, DOCS), tile=tile)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert kept.count() == len({r.class_key for r in got})
    assert ngram_join.near_classes(nothing).count() == 0 and ngram_join.keep_first(nothing).count() == 0


def test_bands_reach_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128


# 7


def test_lm_scores(spark, docs, nothing):
    rows = corpus()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7))
    count, n = collections.Counter(), 0
    for r in rows:
        if not held(r[0]):
            t = [*WORD.findall(lower(r[1])), None]
            count.update(t)
            n += len(t)
    out = lm_scoring.score(docs, fold == 2, fold == 3, chunk_bytes=20_000).collect()
    assert len(out) == len(rows)
    known = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in out:
        assert r.train_tokens == n and r.score < 0
        if r.doc_id is not None:
            t = [*WORD.findall(lower(known[r.doc_id])), None]
            assert (r.held_out, r.n_tokens, r.n_known) == (held(r.doc_id), len(t), sum(count[x] > 0 for x in t))
            assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + len(count) + 1)) for x in t))
    again = {r.doc_id: r.n_known for r in lm_scoring.score(docs, fold == 2, fold == 3, chunk_bytes=1 << 20).collect()}
    assert again == {r.doc_id: r.n_known for r in out}
    assert lm_scoring.score(nothing, fold == 2, fold == 3).count() == 0
    assert all(r.n_known == 0 for r in lm_scoring.score(docs, F.lit(True), F.lit(False)).collect())


def test_lm_estimates_are_a_distribution():
    w = lm_scoring.learn_weights({(3 * lm_scoring._Q2 + 5) * lm_scoring._Q1 + 20: 100, (3 * lm_scoring._Q2) * lm_scoring._Q1: 2}, 1e-4)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 2] > w[3, 1]


# 9


def test_quality_rules(spark, docs, nothing):
    extra = [
        (900, "\n".join(["The first line has words enough to be one, it seems."] * 3 + ["Home | About | Contact | Login"]), None, None, None, None, None, None),
        (901, "\n".join(f"a{k} | b{k} | c{k} | d{k}" for k in range(9)), None, None, None, None, None, None),
        (902, " ".join(f"x{k}###" for k in range(30)), None, None, None, None, None, None),
    ]
    rows = corpus() + extra
    out = quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    known = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in out:
        if r.doc_id is None:
            continue
        t = known[r.doc_id]
        w, seen, dup, cover = WORD.findall(t), set(), 0, set()
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        wins = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        for k in range(len(w) - 4):
            if wins[tuple(w[k : k + 5])] > 1:
                cover.update(range(k, k + 5))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    verdict = {r.doc_id: r for r in out}
    assert verdict[900].n_failed_lines == 1 and "Home" not in verdict[900].cleaned_text
    assert not verdict[901].kept and not verdict[902].kept and verdict[1].kept
    assert quality_rules.judge(docs).where("kept").count() > 30
    assert quality_rules.judge(nothing).count() == 0
    plan = quality_rules.judge(spark.createDataFrame(rows, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# 10


def test_decontamination(spark, nothing):
    rng = random.Random(13)
    items = [prose(rng, rng.randrange(18, 60), [f"b{k}" for k in range(3000)]) for _ in range(60)]
    rows, want = [], set()
    for k, item in enumerate(items):
        a, b = prose(rng, rng.randrange(200)), prose(rng, rng.randrange(200))
        rows.append((k, f"{a} {item} {b}", None, None, None, None, None, None))
        want.add((k, k))
        words = [w if j % 6 else "other" for j, w in enumerate(item.split())]
        rows.append((100 + k, f"{a} {' '.join(words)} {b}", None, None, None, None, None, None))
        want.add((100 + k, k))
        rows.append((200 + k, f"{a} {b}", None, None, None, None, None, None))
    rows += [(900, None, None, None, None, None, None, None), (901, "", None, None, None, None, None, None), rows[0]]
    df = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([*enumerate(items), (70, None), (71, ""), (None, "x y")], "item_id long, text string")
    index = decontamination.build(df, bench)
    found = decontamination.matches(df, index).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(got & want) >= 0.95 * len(want) and got <= want and len([r for r in found if r.doc_id == 0]) == 2
    clean = decontamination.drop_contaminated(df, index)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} >= {*range(200, 260), 900, 901}
    assert not {r.doc_id for r in clean.collect()} & {d for d, _ in got}
    assert decontamination.matches(nothing, index).count() == 0
    none = decontamination.build(df, bench.limit(0))
    assert decontamination.matches(df, none).count() == 0 and decontamination.drop_contaminated(df, none).count() == len(rows)


def test_a_passage_of_a_long_item_is_found(spark):
    rng = random.Random(31)
    items = [prose(rng, n, [f"b{k}" for k in range(3000)]) for n in (185, 300, 100, 40)]
    rows, want = [], set()
    for k, item in enumerate(items):
        words = item.split()
        for j, at in enumerate([*range(0, max(1, len(words) - 64), 13), max(0, len(words) - 64)]):
            rows.append((100 * k + j, f"{prose(rng, 90)} {' '.join(words[at : at + 64])} {prose(rng, 70)}", None, None, None, None, None, None))
            want.add((100 * k + j, k))
        rows.append((900 + k, f"{prose(rng, 90)} {item} {prose(rng, 70)}", None, None, None, None, None, None))
        want.add((900 + k, k))
        rows.append((1000 + k, prose(rng, 200), None, None, None, None, None, None))
    df = spark.createDataFrame(rows, DOCS)
    index = decontamination.build(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(df, index).collect()} == want


def test_verbatim_items_do_not_depend_on_the_rank(spark):
    rng = random.Random(37)
    items = [prose(rng, rng.randrange(15, 60), [f"b{k}" for k in range(3000)]) for _ in range(60)]
    rows = [(k, f"{prose(rng, 90)} {item} {prose(rng, 70)}", None, None, None, None, None, None) for k, item in enumerate(items)]
    rows += [(100 + k, f"{prose(rng, 250)} {item}", None, None, None, None, None, None) for k, item in enumerate(items)]
    df = spark.createDataFrame(rows, DOCS)
    index = decontamination.build(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), rank=2)
    found = decontamination.matches(df, index).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(r[0], r[0] % 100) for r in rows} and all(0 < r.cosine <= 1.0001 for r in found)


def test_svd_is_near_exact(spark):
    rng = random.Random(17)
    lists = [[rng.randrange(50) for _ in range(20)] for _ in range(30)]
    idf = np.linspace(1, 3, 50)
    got = decontamination.randomised_svd(spark.createDataFrame([(x,) for x in lists], "terms array<long>").repartition(3), idf, 10, extra=15, rounds=4)
    row, term, weight = decontamination._rows(lists, idf)
    dense = np.zeros((30, 50))
    dense[row, term] = weight
    best = np.linalg.svd(dense, full_matrices=False)
    assert np.linalg.norm(dense @ got) >= 0.99 * np.linalg.norm(best[1][:10])
    assert np.allclose(got.T @ got, np.eye(10), atol=1e-8)


def test_subsequence():
    rng = random.Random(19)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.common_subsequence(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) == t[-1][-1]


# shared


def test_words_and_windows():
    texts = ["ab  cd", None, "", "é日 x", "A b c d e f g", " \n"]
    data, offsets = textbuf.text_bytes(pa.array(texts))
    starts, ends, first = textbuf.word_bounds(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in WORD.findall(t or "")]
    h = textbuf.word_hashes(data, starts, ends, lower=True)
    assert h[words.index("A")] != h[words.index("b")] and len(set(h.tolist())) == len(words)
    assert np.diff(textbuf.window_hashes(h, first)[1]).tolist() == [1, 0, 0, 1, 3, 0]
    assert list(textbuf.pieces(pa.array(["x" * 10] * 5), 20)) == [(0, 2), (2, 4), (4, 5)]


CLASHES = [*quality_rules.RESULT, "_id", "_row", "_words", "_lines", "_good", "_clean", "_windows", "_repeats", "_w", "_h", "_rep", "row", "key", "cleaned_text", "_", "__x"]


def clashing(spark):
    """A table with a column of every internal and result name, each row with its own values there."""
    body = [(0, "A first line of words here, with an end. " * 4), (1, "Another text, quite unlike it, that ends as well. " * 3), (2, "A first line of words here, with an end. " * 4), (3, " ".join(f"word{k}" for k in range(30)) + "."), (None, None)]
    names = list(dict.fromkeys(CLASHES))
    return spark.createDataFrame([(*r, *(f"{n}{k}" for n in names)) for k, r in enumerate(body)], ["doc_id", "text", *names]).withColumn("doc_id", F.col("doc_id").cast("long"))


def test_no_column_clashes(spark):
    df = clashing(spark)
    own = [n for n in df.columns if n not in quality_rules.RESULT]
    judged = quality_rules.judge(df)
    assert sorted(map(str, judged.select(own).collect())) == sorted(map(str, df.select(own).collect()))
    first = ngram_join.keep_first(df)
    assert first.columns == df.columns
    rows = {str(r) for r in df.collect()}
    assert {str(r) for r in first.collect()} < rows and first.count() == 4


def test_pipeline_stages_keep_all_columns(spark):
    import corpus_pipeline

    df = clashing(spark)
    out = corpus_pipeline.apply_quality_rules(spark, df, "")
    assert out.columns == df.columns and out.dtypes == df.dtypes
    others = [n for n in df.columns if n != "text"]
    kept = {str(r) for r in out.select(others).collect()}
    assert kept and kept <= {str(r) for r in df.select(others).collect()}


def test_merges_of_many_pieces_are_those_of_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(5)
    texts = ["".join(rng.choice("aaabcdeeenrsttio'0123éüß ,.-=\n\t_#") for _ in range(rng.randrange(1, 90))) for _ in range(3000)] + ["a" * 32, "b" * 33, "é" * 16, "=" * 32, "ab" * 4000, None, ""]
    for max_chars in (24_000_000, 4_000):  # the second table is emptied again and again
        few = Encoder(path, max_chars)
        asked = []
        monkeypatch.setattr(few.known, "model", type("Counted", (), {"tokenize": lambda _, x, model=few.known.model: asked.append(x) or model.tokenize(x)})())
        got = few.batch(texts)
        assert got == [np.array(few.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
        assert asked and min(map(len, asked)) > 32
