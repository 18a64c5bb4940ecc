"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, exact, packing, passages, pii, queries, secrets, sentencepiece, sharding, simhash, similar, suffixes, toxicity
from tidemark.llm.shared import components

SF = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [prose(rng.randint(1, 200)) for _ in range(60)]
    passage = prose(30)
    out += [prose(20) + " " + passage + " " + prose(20) for _ in range(8)]
    out += [out[0]] * 5 + [out[1]] + ["", "   ", "one", "two words", "x" * 300, "x" * 500, "漢字 " * 50, "token = \"0123abcd0123abcd0123abcd0123abcd\""]
    near = out[2].split()
    out += [" ".join([*near[:-1], "other"]), " ".join(near)]
    out.append("long " + prose(6000))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())] + [(900, None, None), (901, None, "en"), (5, texts()[5], "en"), (None, "no id here", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_exact(docs, empty):
    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups[t].append(i)
    for keep, f in (("smallest", min), ("largest", max)):
        for r in exact.exact_duplicates(docs, keep).collect():
            g = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).digest() == bytes(r.digest))
            keep_id = f([x for x in g if x is not None], default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep_id, len(g), r.doc_id == keep_id)
    assert exact.exact_duplicates(empty).count() == 0


def test_exact_without_ids(spark):
    docs = spark.createDataFrame([(1, "a", 0), (None, "a", 1), (None, "b", 2), (None, "b", 3), (None, None, 4), (2, "", 5)], "doc_id long, text string, keep_id int")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(docs).collect()), key=str)
    want = [(1, 1, 2, True), (None, 1, 2, False), (None, None, 2, True), (None, None, 2, True), (None, 2, 2, False), (2, 2, 2, True)]
    assert got == sorted(want, key=str)
    kept = exact.remove_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["", "a", "b"]


def test_removal_goes_by_rows(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "only here", "z"), (3, "b", "s"), (3, "b", "s"), (3, "b", "t"), (4, "b", "u"), (5, None, "v"), (6, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted((r.doc_id, r.text or "") for r in exact.remove_duplicates(docs).collect())
    assert got == [(1, "a"), (2, "only here"), (3, "b"), (5, "")]
    got = sorted((r.doc_id, r.text or "") for r in exact.remove_duplicates(docs, "largest").collect())
    assert got == [(2, "a"), (2, "only here"), (4, "b"), (6, "")]
    assert exact.remove_duplicates(docs.limit(0)).count() == 0


def test_tree_merge_keeps_unlike_witnesses_apart(spark):
    """Equal digests of unlike texts, which no real text gives, on every level and over many runs."""
    rows = [(i, bytes([i % 5]) * 32, (i % 2, i % 10)) for i in range(500)]
    slim = spark.createDataFrame(rows, "doc_id long, digest binary, witness struct<bytes:int,hash:long>").repartition(7)
    got = {(bytes(r.digest)[0], r.witness.hash): (r.keep_id, r.copies, r.group_size) for r in exact.tree_merge(slim, 500).collect()}
    assert got == {(k % 5, k): (k, 1, 50) for k in range(10)}


def reference_fingerprint(text, words=3):
    import xxhash

    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    s = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(items, near):
    up = {i: i for i, _ in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if near(a, b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in items}


def test_simhash(docs, empty):
    items = [(i, reference_fingerprint(t)) for i, t in rows_of(docs) if i is not None]
    want = linked(items, lambda a, b: (a ^ b).bit_count() <= 3)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == {i: (f, want[i]) for i, f in items}
    assert simhash.near_duplicates(empty).count() == 0


def test_variants_reach_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        b = a.copy()
        for k, x in enumerate(b):
            for p in rng.choice(64, bits, replace=False):
                b[k] = x = x ^ (np.uint64(1) << np.uint64(p))
        assert all(set(u.tolist()) & set(v.tolist()) for u, v in zip(simhash.variants(a), simhash.variants(b), strict=True))


def test_keys_of_many_fingerprints(monkeypatch):
    """All have one half, give or take a bit; cutting again finds the links that comparing all does."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) & np.uint64(0xFFFFFFFF)
    for shift in (np.uint64(0), np.uint64(32)):
        fp = rng.choice(base, 3000)
        for _ in range(3):
            fp = fp ^ (np.uint64(1) << rng.integers(0, 32, 3000).astype(np.uint64)) * (rng.random(3000) < 0.6).astype(np.uint64)
        fp = np.unique(fp << shift | (np.uint64(7) << (np.uint64(32) - shift)))
        keys, node = simhash.variants(fp).ravel(), np.arange(len(fp))
        got = []
        for most in (10, 1 << 40):
            monkeypatch.setattr(simhash, "LONG", most)
            a, b = simhash.linked(keys, np.repeat(fp, 64), np.repeat(node, 64), 3)
            label = node.copy()
            label[a] = b
            got.append(label.tolist())
        near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 3
        want = node.copy()
        while True:
            new = np.where(near, want[None], len(fp)).min(1)
            if (new == want).all():
                break
            want = new
        assert got[0] == got[1] == want.tolist() and 5 < len(set(want.tolist())) < len(fp) / 2


def test_links_of_many_groups(spark, monkeypatch):
    """Groups of entries go to their partitions in small rows, unsorted, and together find all links."""
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp = np.unique(np.r_[fp, fp[:200] ^ np.uint64(1 << 40 | 1 << 3), fp[:100] ^ np.uint64(1 << 63 | 1 << 40 | 1 << 3 | 1)])
    nodes = spark.createDataFrame([(int(f), k) for k, f in enumerate(fp.view(np.int64))], "fp long, node long").repartition(3)
    monkeypatch.setattr(simhash, "ENTRIES", 4000)
    found = simhash.links(nodes, len(fp))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "FlatMapGroups" not in plan
    assert found.rdd.getNumPartitions() == -(-64 * len(fp) // 4000) > 1
    got = {r.node: r.component for r in components(found, forests=True).collect()}
    want = linked(list(enumerate(fp.tolist())), lambda a, b: (a ^ b).bit_count() <= 3)
    assert {k: got.get(k, k) for k in want} == want and 150 < len(got) < len(fp)


def test_similar(docs):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = [(i, shingles(t)) for i, t in dict(rows_of(docs)).items() if i is not None]
    want = linked(items, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = {r.doc_id: r.component_id for r in similar.similar(docs).collect()}
    assert {i: got.get(i, i) for i in want} == want


def similar_by_force(spark, texts):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    items = [(i, shingles(t)) for i, t in enumerate(texts)]
    want = linked(items, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = {r.doc_id: r.component_id for r in similar.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    return {i: got.get(i, i) for i, _ in items}, want


def test_similar_in_large_groups(spark):
    rng = random.Random(11)
    out = []
    for _ in range(2):  # texts of the same words in other orders: all have one fingerprint, few are near copies
        frame = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(150)]

        def turned(w, k):
            at = rng.randrange(150 - k)
            return [*w[:at], *w[at : at + k][::-1], *w[at + k :]]

        for n in range(120):
            w = turned(frame, 6)
            out.append(" ".join(w))
            if n % 3 == 0:
                out.append(" ".join(turned(w, 10)))
        out += [" ".join(rng.sample(frame, 150)) for _ in range(50)]
    got, want = similar_by_force(spark, out)
    assert got == want and 100 <= len(set(want.values())) < len(out) / 2


def test_similar_near_the_threshold(spark):
    rng = random.Random(12)
    out = []
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n)]
    for n, more, gone in ((100, 24, 0), (100, 15, 0), (100, 25, 0), (100, 10, 10), (400, 60, 0), (14, 1, 1), (8, 1, 0), (4, 0, 0), (9, 1, 1)):
        for _ in range(8):
            w = fresh(n)
            out += [" ".join(w), " ".join(w[: n - gone] + fresh(more))]
    got, want = similar_by_force(spark, out)
    assert got == want and sum(i != c for i, c in want.items()) >= 50


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, k) for k in range(2000, 2300)]
    want = linked([(n, n) for n in {x for e in edges for x in e}], lambda a, b: (a, b) in pairs or (b, a) in pairs) if (pairs := set(edges)) else {}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: c for n, c in want.items() if n in touched}


def test_sharding(docs, empty):
    out = sharding.shard_documents(docs, 4).toPandas()
    assert len(out) == docs.count()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    load = out.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= out["size"].max()
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_splits_by_share_only(spark, monkeypatch):
    for name in ("WINDOW_ROWS", "PORTION_ROWS"):
        monkeypatch.setattr(sharding, name, 5, raising=False)
    rows = [(i, "one text of many" if i < 25 else "often and long" if i < 225 else f"text number {i} of its own") for i in range(2000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).toPandas()
    assert len(out) == 2000 and out[out.doc_id < 25].shard.nunique() == 1 and out[out.doc_id.between(25, 224)].shard.nunique() > 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_packing(docs, empty):
    path = queries.tokenizer()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    for t in [*texts(), "hello <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>\n a", "<|endoftext", "it's 12  \n\n é 漢字😀"]:
        assert packing.encoder(path)(t) == tok.encode(t, add_special_tokens=False).ids
    out = packing.packed(docs, path).toPandas()
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in rows_of(docs) if i is not None}
    for r in out[out.doc_id.notna() & (out.doc_id != 5)].itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all()
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 1
    assert packing.packed(empty, path).count() == 0


def test_plan_fills_and_keeps_order():
    rows, n = packing.plan({2048: 3, 1000: 5, 600: 7, 48: 100, 1: 9}, 2048)
    assert rows[:, 2].sum() == 124
    used = defaultdict(int)
    for length, _, many, first, _ in rows:
        for s in range(first, first + many):
            used[s] += length
    assert len(used) == n and max(used.values()) <= 2048


def test_suffix_array():
    rng = np.random.default_rng(0)
    for k in range(80):
        s = np.concatenate([rng.integers(1, 2 + k % 5, int(rng.integers(1, 300))), [0]])
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffixes.suffix_array(s).tolist() == want


def test_shared_prefixes():
    rng = np.random.default_rng(1)
    for length in (3, 8, 13, 20):
        raw = rng.integers(1, 3, 400).astype(np.uint8)
        order = np.array(sorted(range(380), key=lambda i: bytes(raw[i:])))
        order = order[rng.random(len(order)) < 0.8]
        padded = np.concatenate([raw, np.zeros(length + 16, np.uint8)])
        want = [False] + [bytes(padded[a : a + length]) == bytes(padded[b : b + length]) for a, b in zip(order, order[1:], strict=False)]
        assert suffixes.shares_prefix(padded, order, length, 64).tolist() == want


def test_passages(docs, empty):
    rows = sorted((i, t.encode()) for i, t in rows_of(docs) if i is not None)
    first = {}
    for i, t in rows:
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    want = []
    for i, t in rows:
        m = np.zeros(len(t), bool)
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                m[j : j + 50] = True
        spans = int(m[:1].sum()) + int((m[1:] & ~m[:-1]).sum())
        want.append((i, len(t), int(m.sum()), spans, np.frombuffer(t, np.uint8)[~m].tobytes()))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in passages.remove_passages(docs).collect() if r.doc_id is not None)
    assert got == want and sum(w[2] for w in want) > 0
    assert passages.remove_passages(empty).count() == 0


def test_sentencepiece(docs, empty):
    import public_tokenizers
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m = library.SentencePieceProcessor(model_file=path), sentencepiece.model(path)
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab \n▁é漢😀the  on.") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for t in [*texts(), *odd]:
        assert m.encode(t) == sp.encode(t)
        if t:
            assert m.stream(sentencepiece.SPACE + t.replace(" ", sentencepiece.SPACE)) == sp.encode(t)
        assert m.decode(m.encode(t)) == t.replace("▁", " ")
    v = sentencepiece.StreamingViterbi(m)
    v.feed("▁the▁cat▁sat" * 400)
    assert len(v.text) <= 3 * m.longest  # decided parts are let go
    assert len(m.known) + len(m.older) > 0 and all(len(k) <= 64 for k in m.known)
    out = sentencepiece.decoded(sentencepiece.encoded(docs, path), path).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(i), t.replace("▁", " ")) for i, t in rows_of(docs))
    for r in sentencepiece.encoded(docs, path).collect():
        t = {**dict(rows_of(docs)), 5: texts()[5]}[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == sp.encode(t)
    assert sentencepiece.encoded(empty, path).count() == 0
    assert sentencepiece_model_pb2 is not None


def test_pii(spark, empty):
    rows = [(1, "Mr. John Smith met Frau Anna Meier; it.26@mail6.example.com and it.26@mail6.example.com."), (2, "card 4111-1111-1111-1111, ip 129.38.82.176 tel +1 (487) 555-7209"), (3, None), (4, ""), (5, "nothing to see"), (6, "Mr. John Smith again, 129.38.82.176")]
    out = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert out[3].text is None and out[4].text == "" and out[5].text == "nothing to see"
    for secret in ("John", "Smith", "Meier", "it.26", "4111", "129.38.82.176", "487"):
        assert not any(secret in (r.text or "") for r in out.values())
    import re

    name = re.match(r"Mr\. (\w+ \w+)", out[1].text)[1]
    assert name in out[6].text and name.split()[0] in pii.GIVEN["latin", "m"]
    mails = re.findall(r"\S+@\S+\.com", out[1].text)
    assert len(mails) == 2 and mails[0] == mails[1]
    card = [int(c) for c in re.search(r"[\d-]{19}", out[2].text)[0] if c != "-"]
    assert sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(card)) % 10 == 0
    assert re.search(r"tel \+1 \(\d{3}\) \d{3}-\d{4}", out[2].text)
    assert pii.pseudonymised(empty, "k").count() == 0


def test_pii_collisions(spark):
    rows = [(i, f"ip 10.0.{i // 250}.{i % 250 + 1} phone 555-{i:04d}") for i in range(3000)]
    out = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k")
    found = out.select(F.explode(pii.found(F.col("text"))).alias("e"))
    assert found.distinct().count() == 6000
    real = spark.createDataFrame(rows, "doc_id long, text string").select(F.explode(pii.found(F.col("text"))).alias("e"))
    assert found.join(real.distinct(), "e", "left_semi").count() == 0


def test_pii_formats_of_one_entity(spark):
    import re

    cards = ["4111-1111-1111-1111", "4111 1111 1111 1111", "4111111111111111"]
    phones = ["+1 (487) 555-7209", "+1 487 555 7209", "+14875557209", "+351 912 345 678", "+351912345678"]
    ibans = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]
    people = [f"Mr. {g} Smith" for g in "John Jack Jim Joe Jon Jeff Jake Josh Jay Juan Jude Jed Jan Jon Jules Jasper Jared Joel Jonah Joss Jago Jem".split()]
    rows = [(i, f"x {e} y") for i, e in enumerate([*cards, *phones, *ibans, *people, "Mr. Smith", "Mr. SMITH"])]
    out = [r.text[2:-2] for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    plain = [re.sub(r"[^A-Z0-9+]", "", e) for e in out[:10]]
    assert len(set(plain[:3])) == 1 and len(set(plain[3:6])) == 1 and len(set(plain[6:8])) == 1 and len(set(plain[8:])) == 1
    assert plain[3].startswith("+1") and plain[6].startswith("+351")
    names = [e.split() for e in out[10:]]
    assert len({n[-1] for n in names}) == 1 and len({n[1] for n in names[:-2]}) == len(set(people))


def test_pii_leaves_numbers_alone(spark):
    text = "from 1999-2000 about 10 000 people came, 25 3000 lines, see 12.345, 100 000 000 in 2024-01-15, 3.141.592, v1.2.3-444"
    out = pii.pseudonymised(spark.createDataFrame([(1, text), (2, "call 555-123-4567 or 0170 1234567 or (487) 555-7209 or +33 1 23 45 67 89")], "doc_id long, text string"), "k").collect()
    got = {r.doc_id: r for r in out}
    assert got[1].text == text and got[2].types == {"phone": 4} and not any(x in got[2].text for x in ("4567", "1234567", "7209", "23 45 67"))


def test_pii_iban_stays_valid_in_its_country(spark):
    def valid(iban):
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1

    ibans = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606"]
    out = pii.pseudonymised(spark.createDataFrame([(i, f"x {e} y") for i, e in enumerate(ibans)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    for old, r in zip(ibans, out, strict=True):
        new = r.text[2:-2]
        assert valid(old) and valid(new) and new != old and new[:2] == old[:2] and len(new) == len(old)


def test_pii_keys_and_rows_without_ids(spark):
    rows = [(None, f"Mr. {g} Smith" + "!" * i, 0) for i, g in enumerate("John Jack Jim Joe Jon Jeff Jake Josh Jay Juan Jude Jed Jan Jules Jasper Jared Joel Jonah Joss Jago Jem Jorge".split())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entity int")
    out = {k: sorted(r.text.rstrip("!") for r in pii.pseudonymised(docs, k).collect()) for k in "ab"}
    assert len(set(out["a"])) == len(rows) and out["a"] != out["b"]
    long = "word " * 200_000 + "mail one@host.org"
    got = pii.pseudonymised(spark.createDataFrame([(1, long), (1, long), (2, "")], "doc_id long, text string"), "a").collect()
    assert len({r.text for r in got}) == 2 and all("one@host" not in r.text for r in got) and sorted(r.n_entities for r in got) == [0, 1, 1]


def test_pii_ends_where_a_shape_is_full(spark):
    import itertools

    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{x}@{y}.de" for x, y in itertools.product(letters, letters)][:600]
    out = pii.pseudonymised(spark.createDataFrame([(i, m) for i, m in enumerate(mails)], "doc_id long, text string"), "k").collect()
    new = {r.doc_id: r.text for r in out}
    assert len(set(new.values())) == 600 and all(v[1] == "@" and v[3:] == ".de" for v in new.values())
    assert sum(new[i] == m for i, m in enumerate(mails)) <= 10


def test_secrets(docs, empty):
    forest = secrets.trained()
    fresh = secrets.labelled_findings(1000, seed=77)
    score = forest.score(np.array([secrets.features(*r[:4]) for r in fresh]))
    assert ((score >= 0.5) == np.array([r[4] for r in fresh])).mean() > 0.97
    out = {r.doc_id: r for r in secrets.scan(docs, forest).collect() if r.doc_id is not None}
    hit = [i for i, r in out.items() if any(f.secret for f in r.findings)]
    assert len(hit) == 1 and "<secret>" in out[hit[0]].redacted and "0123abcd" not in out[hit[0]].redacted
    assert all(r.redacted == r.text for i, r in out.items() if i not in hit)
    assert secrets.redact(docs, forest).columns == docs.columns and secrets.redact(docs, forest).count() == docs.count()
    assert secrets.scan(empty, forest).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + 0.15 * rng.normal(size=16)).astype(np.float32).tolist(), int(i % 3)) for i in range(900)]
    rows += [(1000 + k, rows[7][1], 1) for k in range(20)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (2004, [1.0, None], 1), (2005, [], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=150).collect()}
    good = [r for r in rows if r[0] < 2000]
    x, lab = embeddings.unit(np.array([r[1] for r in good], float)), np.array([r[2] for r in good])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    ids = np.array([r[0] for r in good])
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(near, comp[None], 1 << 40).min(1))
        if (new == comp).all():
            break
        comp = new
    assert all(got[i] == (int(n), int(c)) for i, n, c in zip(ids.tolist(), near.sum(1), comp, strict=True))
    assert all(got[i] == (0, i) for i in range(2000, 2006))


def test_embeddings_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, label int, kept string, shard int"
    assert embeddings.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 1, "x", 9), (1, v, 1, "x", 9), (1, v, 1, "y", 9), (2, [2.0, 4.0, 6.0], 1, None, 1), (3, v, 2, None, 1), (4, [3.0, -1.0, 0.0], 1, None, None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)], key=str)


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = embeddings.unit(rng.normal(size=(1500, 24)) + 3 * rng.normal(size=(30, 24))[rng.integers(0, 30, 1500)])
    g = embeddings.Graph(x)
    ids, _ = g.query(x[:200].astype(np.float32), 64)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10].tolist()) & set(b.tolist())) / 10 for a, b in zip(ids, true, strict=True)]) >= 0.9


def test_toxicity(spark, empty):
    rng = random.Random(8)
    clean = ["river", "stone", "table", "green", "walks", "under", "light", "paper", "seven", "north"]
    bad = ["grubble", "grubbled", "grubbling", "snark", "snarky"]

    def one(toxic):
        w = [rng.choice(clean) for _ in range(rng.randint(20, 60))]
        for _ in range(3 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        return " ".join(w) + "."

    y = np.array([k % 3 == 0 for k in range(300)])
    model = toxicity.fit([one(t) for t in y], y.astype(int))
    rows = [(k, one(k % 2 == 0), "en") for k in range(100)] + [(200, None, "en"), (201, "", None), (202, "grubblest here", "x")]
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()}
    assert np.mean([(out[k].score >= 0.5) == (k % 2 == 0) for k in range(100)]) > 0.95
    assert out[200].score < 0.5 and out[201].score < 0.5
    k = next(k for k in range(0, 100, 2) if out[k].spans)
    assert all(any(w in rows[k][1][s.start : s.end] for w in bad) for s in out[k].spans)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), toxicity.Model()).where("score > 0").count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    c = toxicity.chains([np.array([1, 2, 3, 4, 0, 5])])
    u, moves, start = rng.normal(size=5), rng.normal(size=(2, 2)), 0.3
    p, _ = toxicity.marginals(c, u, moves, start)
    import itertools

    z = {s: np.exp(sum(u[i] * s[i] for i in range(4)) + sum(moves[s[i], s[i + 1]] for i in range(3)) + start * s[0]) for s in itertools.product((0, 1), repeat=4)}
    want = [sum(v for s, v in z.items() if s[i]) / sum(z.values()) for i in range(4)]
    assert np.allclose(p[:4], want) and np.isclose(p[4], 1 / (1 + np.exp(-(u[4] + start))))


def test_held_out_ranking(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.trained(docs, labels)
    held = docs.join(labels.where(toxicity.held_out()), "doc_id", "left_semi")
    rows = toxicity.score(held, model).join(labels, "doc_id").select("score", "toxic").collect()
    bad, good = np.array([r.score for r in rows if r.toxic]), np.array([r.score for r in rows if not r.toxic])
    auc = np.mean([np.mean(b > good) + 0.5 * np.mean(b == good) for b in bad])
    assert len(bad) >= 20 and auc >= 0.9 and np.mean(bad >= 0.5) >= 0.7 and np.mean(good >= 0.5) <= 0.05


def test_offsets_are_places_in_the_text(spark):
    y = np.array([k % 3 == 0 for k in range(300)])
    rng = random.Random(8)
    words = ["river", "stone", "table", "green", "walks", "under"]
    model = toxicity.fit([" ".join(rng.choice(words) for _ in range(30)) + (" grubble grubble" if t else "") for t in y], y.astype(int))
    text = "İİİİ river STONE Grubble GRUBBLE under"
    r = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert len(toxicity.lowered(text)) == len(text) and [text[s.start : s.end].lower() for s in r.spans] == ["grubble grubble"]


def test_placing_against_force():
    rng = np.random.default_rng(6)
    demand = rng.random((60, 3)) * np.array([0.1, 0.05, 0.02])
    left = np.ones((5, 3))
    want = np.empty(60, int)
    for i in np.argsort(-demand.max(axis=1), kind="stable"):
        dots = [sum(w * d * r for w, d, r in zip(sharding.WEIGHTS, demand[i], row, strict=True)) for row in left]
        want[i] = max(range(5), key=lambda k: (round(dots[k], 12), -k))
        left[want[i]] -= demand[i]
    residual = np.ones((5, 3))
    assert sharding.place(demand, residual).tolist() == want.tolist() and np.allclose(residual, left)


def test_planted_secrets_are_found(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in secrets.scan(docs, secrets.trained()).collect()}
    planted = {r.doc_id: re.findall(r'(?:token|key|secret|password)\s*=\s*"([0-9a-f]{40})"', r.text or "") for r in docs.collect()}
    with_ = [i for i, x in planted.items() if x]
    assert len(with_) >= 5 and all(x not in out[i].redacted for i in with_ for x in planted[i])
    assert sum(any(f.secret for f in out[i].findings) for i in out if not planted[i]) <= 0.02 * len(out)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "secret scan", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, kept, SF).write.parquet(str(tmp_path / name.replace(" ", "_")))
        kept = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert kept.columns == docs.columns
    assert kept.count() == kept.select("text").distinct().count()
    assert kept.where("text rlike 'token = \"[0-9a-f]{40}\"'").count() == 0
    out = pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_against_force(spark, tmp_path):
    """Every stage's rows against plain Python, on texts with exact and near copies, nulls, repeated rows and clashing columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    rng = random.Random(5)
    base = texts()
    for t in base[3:9]:
        w = t.split()
        base += [" ".join([*w, "added"]), " ".join(w[:-1]), " ".join(rng.sample(w, len(w)))]
    rows = [(i, t, "en", "s", len(t), i) for i, t in enumerate(base)]
    rows += [(700, None, None, None, None, None), (701, base[10], "en", "s", 1, 1), (701, base[10], "en", "s", 1, 1), (5, "another text of five", "en", "s", 1, 1), (None, "no id", "en", "s", 1, 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, digest long"
    docs = spark.createDataFrame(rows, kind).repartition(4)
    model = toxicity.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    steps = dict(pipeline.STAGES)

    def run(name, df):
        out = steps[name](spark, df, SF)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        return spark.read.parquet(str(tmp_path / name.replace(" ", "_")))

    key = lambda x: (str(x[0]), str(x[1]))
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=key)
    scores = {(r.doc_id, r.text): toxicity.score(spark.createDataFrame([(r.doc_id, r.text)], "doc_id long, text string"), model).first().score for r in docs.limit(5).collect()}
    clean = run("toxicity", docs)
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    assert pairs(clean) == sorted(((i, t) for i, t, *_ in rows if i is None or i not in bad), key=key) and all(0 <= s <= 1 for s in scores.values())
    once = run("exact dedup", clean)
    best = {}
    for i, t in pairs(clean):
        k = t or ""
        if k not in best or (i is not None and (best[k] is None or i < best[k])):
            best[k] = i
    assert sorted(((r.doc_id, r.text or "") for r in once.collect()), key=key) == sorted(((i, t) for t, i in best.items()), key=key)
    sets_ = {}
    for i, t in pairs(once):
        if i is not None:
            w = (t or "").encode().lower().split()
            sets_.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    want = linked(list(sets_.items()), lambda a, b: any(len(x & y) >= 0.8 * len(x | y) for x in a for y in b))
    apart = run("near dedup", once)
    assert pairs(apart) == [x for x in pairs(once) if x[0] is None or want[x[0]] == x[0]] and len(pairs(apart)) < len(pairs(once))
    hidden = run("secret scan", apart)
    assert [i for i, _ in pairs(hidden)] == [i for i, _ in pairs(apart)]
    changed = [(a, b) for a, b in zip(pairs(apart), pairs(hidden), strict=True) if a != b]
    assert len(changed) == 1 and "0123abcd" in changed[0][0][1] and "0123abcd" not in changed[0][1][1]
    packed = run("packing", hidden).toPandas()
    tok = Tokenizer.from_file(queries.tokenizer())
    assert packed.length.sum() == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs(hidden))
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all()
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for _, stage in pipeline.STAGES)
    assert all(c.columns == docs.columns for c in (clean, once, apart, hidden))
