"""The training-data operators against brute force, libraries, exact round trips and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adledger.llm import (bagminhash, bpe_dropout, context_mixing, exact_dedup, hnsw, html_blocks, packing, quality_gam,
                          secret_scan, token_counts)
from adledger.llm.queries import vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, rep string, t string"
ODD = [None, "", " ", "A", "a", "é  z\x1c\tq\n\n x", "▁a ▁", "日本 😀", "x" * 5000, "<|endoftext|> b", "the cat"]


def lower(t):
    return (t or "").encode().translate(context_mixing.LOWER).decode()


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, copies, near copies, secrets; ids with ties, repeated rows and extra columns of clashing names."""
    r = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    texts = list(ODD)
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(30, 120))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            near = list(base)
            near[r.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
        if r.random() < 0.4:
            texts.append(" ".join(base).upper())
    texts += [f'say {i} token = "{hashlib.sha1(str(i % 7).encode()).hexdigest()}" AKIA{"B" * (i + 8)} z' for i in range(12)]
    texts.append("key Zx8Qw2Lm9Rt4Vb7Nc1Ks5Hd3Fg6 end " + " ".join(words))
    rows = [(i, t, "en de fr".split()[i % 3] if i % 11 else None, "s%d" % min(i % 9, 3) if i % 13 else None, len(t or ""), "k", "r", "t")
            for i, t in enumerate(texts)]
    rows += [rows[12], rows[12]]  # repeated rows
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_dedup(docs, empty):
    rows = pairs(docs)
    ids = defaultdict(list)
    for i, t in rows:
        ids[lower(t)].append(i)
    want = sorted((i, max(ids[lower(t)]), len(ids[lower(t)]), i == max(ids[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest())
                  for i, t in rows)
    for bits in (26, 4):  # the bitmap may be full
        got = exact_dedup.exact_dedup(docs, bits=bits).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(i for i, _ in pairs(kept)) == sorted(w[0] for w in want if w[3])
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.drop_copies(empty).count() == 0


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_classes(docs, empty):
    rows = pairs(docs)
    bags = {i: bag(t) for i, t in rows}
    top = {i: i for i in bags}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in bags:
        for b in bags:
            x, y = bags[a], bags[b]
            shared, whole = sum((x & y).values()), sum((x | y).values())
            if a < b and ((not x and not y) or (whole and shared / whole >= 0.8)):
                p, q = sorted((root(a), root(b)))
                top[q] = p
    got = bagminhash.near_classes(docs).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(i, root(i)) for i in bags}
    assert len(got) == len(rows)
    kept = bagminhash.drop_near_copies(docs)
    assert {i for i, _ in pairs(kept)} == {root(i) for i in bags} and kept.columns == docs.columns
    assert bagminhash.near_classes(empty).count() == bagminhash.drop_near_copies(empty).count() == 0


def test_near_classes_of_a_chain(spark):
    """A large bucket whose members are linked in a chain is one class, whatever the rounds leave."""
    r = random.Random(5)
    words = ["v%d" % i for i in range(400)]
    text = [r.choice(words) for _ in range(120)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(text)))
        for _ in range(2):
            text[r.randrange(len(text))] = r.choice(words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bags = {i: bag(t) for i, t in rows}
    near = lambda x, y: sum((x & y).values()) / sum((x | y).values()) >= 0.8
    top = {i: i for i in bags}
    for _ in bags:
        for a in bags:
            for b in bags:
                if near(bags[a], bags[b]):
                    top[a] = top[b] = min(top[a], top[b])
    for rounds in (0, 2):
        got = bagminhash.near_classes(df, rounds=rounds, delegates=1).collect()
        assert {r.doc_id: r.class_id for r in got} == top


def test_stragglers_are_dealt_once_each(spark):
    """Texts just under the threshold: rows sent to the comparison grow with the group, links are all found."""
    r = random.Random(6)

    def dealt(group):
        base = [r.choice([f"u{i}" for i in range(500)]) for _ in range(60)]
        rows = []
        for i in range(group):
            text = list(base)
            for at in r.sample(range(0, 60, 6), 2):
                text[at] = f"x{i}_{at}"
            rows.append((i, " ".join(text)))
        rows.append((group, rows[3][1] + " tail"))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        seen = []
        kept = bagminhash._across

        def counted(apart, *args, **options):
            minor = apart.where("comp <> main").select("band").distinct()
            seen.append(apart.join(minor, "band").count())
            return kept(apart, *args, **options)

        bagminhash._across = counted
        try:
            got = {x.doc_id: x.class_id for x in bagminhash.near_classes(df).collect()}
        finally:
            bagminhash._across = kept
        assert got[group] == got[3]
        return sum(seen)

    small, large = dealt(100), dealt(400)
    assert large <= 6 * max(small, 100)


def test_blocks_of_a_bucket_meet(spark):
    """However small the blocks, the same links between components are found."""
    r = random.Random(8)
    base = [f"v{i}" for i in range(80)]
    bags_of, rows = {}, []
    for i in range(60):
        text = list(base)
        for _ in range(r.randint(0, 6)):
            text[r.randrange(80)] = f"y{r.randrange(30)}"
        rows.append((i, " ".join(text)))
        bags_of[i] = bag(rows[-1][1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = bagminhash._across
    found = []
    for size in (16 << 20, 3000):
        bagminhash._across = lambda *a, size=size: kept(*a, block_bytes=size)
        try:
            found.append({x.doc_id: x.class_id for x in bagminhash.near_classes(df, rounds=0).collect()})
        finally:
            bagminhash._across = kept
    assert found[0] == found[1]


def test_signatures_are_unbiased():
    r = np.random.default_rng(0)
    a, b = [" ".join(r.choice([f"q{i}" for i in range(6)], 400)) for _ in range(2)]
    doc, element, weight, _ = bagminhash.bags([a, b], words=2)
    s = bagminhash.signatures(doc, element, weight, 2, 4000)
    x, y = (Counter(zip(t.split(), t.split()[1:])) for t in (a, b))
    true = sum((x & y).values()) / sum((x | y).values())
    assert weight.max() > 4 and abs((s[0] == s[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 4000)


def test_packing(docs, empty, spark):
    big = docs.unionByName(spark.createDataFrame([(900, "y" * 2500, None, "s1", 2500, "", "", "")], DOC))
    got = packing.pack(big, capacity=1000, max_per_source=2, shard_chars=8000, shard_rows=100).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append((r.start, r.stop))
    for b in bins.values():
        assert sum(r.stop - r.start for r in b) == b[0].bin_used <= 1000
        assert len({r.cluster for r in b}) == len(b)
        assert max(Counter(r.source for r in b).values()) <= 2
        assert sorted(r.position for r in b) == list(range(len(b)))
    for i, t in set(pairs(big)):
        spans = sorted(set(pieces[i]))
        assert spans[0][0] == 0 and spans[-1][1] == len(t or "") and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    assert len(got) == sum(max(1, -(-len(t or "") // 1000)) for _, t in pairs(big)) and packing.pack(empty).count() == 0


def test_best_fit_is_the_tightest_compatible_bin():
    r = random.Random(2)
    bins, plain = packing.Bins(100, 2), []
    for _ in range(600):
        size, source, cluster = r.randint(0, 60), r.randrange(4), r.choice([-1, -1, 0, 1, 2])
        fits = [(b["left"], k) for k, b in enumerate(plain) if b["left"] >= size and b["n"][source] < 2 and cluster not in b["c"]]
        k = min(fits)[1] if fits else len(plain)
        if k == len(plain):
            plain.append({"left": 100, "n": Counter(), "c": set()})
        plain[k]["left"] -= size
        plain[k]["n"][source] += 1
        plain[k]["c"] |= {cluster} - {-1}
        assert bins.place(size, source, cluster) == k


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in pairs(docs))
    got = token_counts.count_tokens(docs, path).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    texts = [t or "" for t in ODD] + ["a  b \n c", " lead", "trail ", "don't  '"]
    cut = token_counts.Counter(path, part_chars=2)  # cut wherever it is safe
    assert cut.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_tokens(empty, path).count() == 0


def test_merge_dropout(docs, empty):
    from sentencepiece import SentencePieceProcessor

    path = vocabulary("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    texts = [t or "" for _, t in pairs(docs)] + ["  two  spaces ", "\n"]
    plain, varied = bpe_dropout.Coder(path, 0.0), bpe_dropout.Coder(path, 0.3)
    known = [t for t in texts if "▁" not in t]
    assert [x.tolist() for x in plain.encode_batch(known, [0] * len(known))] == [library.encode(t) for t in known]
    ids = varied.encode_batch(texts, list(range(len(texts))))
    assert [varied.decode(x.tolist()) if len(x) else "" for x in ids] == texts
    assert any(varied.encode(t, 1).tolist() != varied.encode(t, 2).tolist() for t in texts)
    assert all(varied._unit(u) == tuple(varied.unskipped(u)[0]) for u in list(varied.number))  # in step as one by one
    back = bpe_dropout.decode_ids(bpe_dropout.encode_texts(docs, path), path)
    assert sorted(pairs(back)) == sorted((i, t or "") for i, t in pairs(docs))
    assert all(r.lossless for r in bpe_dropout.encoding_digest(docs, path).collect())
    assert bpe_dropout.encoding_digest(empty, path).count() == 0


def test_every_occurrence_is_cut_for_itself():
    path = vocabulary("piece_bpe_32k.model")
    coder = bpe_dropout.Coder(path, 0.1)
    plain = bpe_dropout.Coder(path, 0.0)

    def cuts(n, unit):
        keys = [coder._units(" ".join([unit] * 100), d)[1] for d in range(n // 100)]
        one_by_one = [coder._unit(" " + unit, int(k)) for ks in keys for k in ks]
        rows = coder.encode_batch([" ".join([unit] * 100)] * (n // 100), list(range(n // 100)))
        assert [i for x in one_by_one for i in x] == np.concatenate(rows).tolist()
        return one_by_one

    for unit in ("a", "the", "international", "x" * 50, "a▁bcde"):
        merges = plain.unskipped(" " + unit)[1]
        few, many = cuts(100, unit), cuts(4000, unit)
        keys = np.concatenate([coder._units(" ".join([unit] * 100), d)[1] for d in range(40)])
        skips = coder._skipped(keys[:, None] + merges)
        assert abs(skips.mean() - 0.1) < 0.02
        assert abs((~skips).all(axis=1).mean() - 0.9 ** len(merges)) < 0.03
        kept = sum(x == plain._unit(" " + unit) for x in many) / 4000
        assert kept > 0.9 ** len(merges) - 0.03 and (len(merges) > 1 or kept < 0.93)
        if unit == "international":
            assert len(set(many)) > len(set(few)) > 4


def test_states_of_skips_give_what_each_occurrence_gives():
    r = random.Random(3)
    coder = bpe_dropout.Coder(vocabulary("piece_bpe_32k.model"), 0.3, seed=5, cache=200)
    words = ["international", "house", "the", "a", "naïve", "漢字", "line\nbreak.\n", "x" * 60, "m▁k", "", "word" * 9]
    words += ["".join(r.choices("etaoins", k=r.randint(3, 15))) for _ in range(60)]
    for batch in range(4):  # the cache is emptied between them
        texts = [" ".join(r.choices(words, k=400)) for _ in range(8)]
        documents = [r.randrange(1 << 40) for _ in texts]
        got = coder.encode_batch(texts, documents)
        for text, document, ids in zip(texts, documents, got):
            units, keys = coder._units(text, document)
            assert ids.tolist() == [i for u, k in zip(units, keys) for i in coder._unit(u, int(k))]
            assert coder.decode(ids) == text
    assert len(coder.forks) > 100


def test_secret_scan(docs, empty):
    got = {r.doc_id: r for r in secret_scan.find_secrets(docs).collect()}
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in pairs(docs):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        names = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r.spans.split(",")) | {""}
    assert any("loose" in r.spans for r in got.values())
    clean = dict(pairs(secret_scan.redact(docs)))
    assert "Zx8Qw2Lm9Rt4Vb7Nc1Ks5Hd3Fg6" not in str(clean) and any("[SECRET]" in (t or "") for t in clean.values())
    assert all(clean[i] == t for i, t in pairs(docs) if not got[i].n_live)
    assert secret_scan.find_secrets(empty).count() == secret_scan.redact(empty).count() == 0


def test_widely_copied_values_are_no_live_secrets(spark):
    value = hashlib.sha1(b"x").hexdigest()
    rows = [(i, f"token={value}", f"s{i}") for i in range(6)] + [(9, f"token={value[::-1]}", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_live for r in secret_scan.find_secrets(df).collect()}
    assert got == {**{i: 0 for i in range(6)}, 9: 2}


def test_secrets_belong_to_their_row(spark):
    """Null and repeated ids: each row has its own spans, and each credential is masked where it stands."""
    value = "token=" + hashlib.sha1(b"z").hexdigest()
    rows = [(None, value, "s1", "a", 0, "x"), (7, value, "s1", "b", 0, "x"), (7, "later " + value, "s1", "c", 0, "x"), (7, value, "s1", "d", 0, "x"),
            (8, None, None, "e", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, live_spans string, row int, text_hash string")
    got = sorted((str(r.doc_id), r.spans.split(",")[0]) for r in secret_scan.find_secrets(df).collect())
    assert got == [("7", "assign:0:46"), ("7", "assign:0:46"), ("7", "assign:6:52"), ("8", ""), ("None", "assign:0:46")]
    clean = secret_scan.redact(df)
    assert clean.columns == df.columns
    assert {r.live_spans: r.text for r in clean.collect()} == {"a": "[SECRET]", "b": "[SECRET]", "c": "later [SECRET]", "d": "[SECRET]", "e": None}


def test_no_gate_loses_a_loose_token():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for n in [*range(24, 44), 90, 200]:  # digits in the middle only; the long ones have no digit among the first 40
        side = (n - 3) // 2
        value = "".join(r.choices(letters, k=side)) + "407" + "".join(r.choices(letters, k=n - 3 - side))
        for text in (value, f"say {value} z", f"say {value} z 0123456789abcdefABCDEFG"):
            at = text.index(value)
            assert (4, at, at + n, value) in secret_scan.all_spans(text), value


def test_context_mixing(docs, empty):
    got = {r.doc_id: r for r in context_mixing.score(docs).collect()}
    rows = pairs(docs)
    tokens = {i: [*context_mixing.tokens(t), b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, _ in rows if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(w in counts for w in words), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) < 1e-6
        assert r.score < 0
    assert sum(r.score for r in got.values() if r.held_out) > 2 * sum(r.base_score for r in got.values() if r.held_out)
    assert context_mixing.score(empty).count() == 0


def test_bits_of_a_byte_sum_to_one():
    table = np.zeros((1 << 12, 2), np.float32)
    context_mixing.add_counts(table, [b"abc", b"abd"], np.array([5, 3]), 12, 1)
    m = context_mixing.fresh_mixer(12, context_mixing.packed(table[:, 0], table[:, 1])[:, None])
    words = [b"ab" + bytes([c]) for c in range(256) if c != 32]
    tail = 10 ** m.log10([w for w in words])[:, 0]
    stop = 10 ** m.log10([b"ab"])[0, 0]
    # each is also followed by its terminator, so together they are below one
    assert 0 < tail.sum() + stop <= 1


def test_contexts_run_across_tokens(spark):
    texts = ["the cat sat on the mat " * 8, "a dog ran", "", "x" * 300 + " y"]
    data, begins, _ = context_mixing._run(texts)
    got = context_mixing.contexts(data, begins)
    seen = [{} for _ in got]
    for b, e in zip(begins, [*begins[1:], len(data)]):
        raw = bytes(data[b:e])
        for i in range(len(raw)):
            *before, so_far = raw[:i].split(b" ")
            wants = [*((o, raw[max(0, i - o):i]) for o in (1, 2, 3)), (4, so_far), (5, so_far, *before[-1:])]
            for k, want in enumerate(wants):  # equal contexts and no others share a hash
                assert seen[k].setdefault(want, got[k][b + i]) == got[k][b + i]
    assert all(len(set(s.values())) == len(s) for s in seen)
    mixer = context_mixing.fresh_mixer(14, np.random.default_rng(0).integers(0, 9, 1 << 14).astype(np.uint16))
    whole = mixer.texts(data, begins)
    for most in (1, 7, 40):  # however the texts are cut into windows
        cut = sorted((lo, hi) for _, lo, hi, _ in context_mixing.windows(data, begins, most))
        assert [lo for lo, _ in cut] == [0, *(hi for _, hi in cut[:-1])] and cut[-1][1] == len(data)
        for lead, lo, hi, inside in context_mixing.windows(data, begins, most):
            assert (context_mixing.contexts(data[lead:hi], inside)[:, lo - lead:] == got[:, lo:hi]).all()
    assert np.allclose(whole, [mixer.texts(*context_mixing._run([t])[:2])[0] for t in texts], rtol=1e-4)


def test_order_of_words_counts(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(40)]
    rows = []
    for i in range(300):  # each word has its successor; a shuffled copy has the same words
        at = r.randrange(40)
        text = [words[(at + j) % 40] for j in range(60)]
        rows += [(2 * i, " ".join(text))]
    shuffled = [(i + 1, " ".join(r.sample(t.split(), 60))) for i, t in rows if zlib.crc32(str(i + 1).encode()) % 7 == 2]
    got = {x.doc_id: x for x in context_mixing.score(spark.createDataFrame(rows + shuffled, "doc_id long, text string"), bits=18).collect()}
    assert len(shuffled) > 20 and all(got[i].held_out and got[i].score < 2 * got[i - 1].score for i, _ in shuffled)
    assert all(abs(got[i].base_score - got[i - 1].base_score) < 1e-6 for i, _ in shuffled)


def test_equal_contexts_are_predicted_once(monkeypatch):
    r = random.Random(8)
    words = ["a", "b", "an", "\x01", "\u00e9t\u00e9", "x" * 70, "x" * 70 + "y", *("".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(60))]
    texts = ["", "a", "a b", "b a b", None, *(" ".join(r.choices(words, k=r.randint(1, 40))) for _ in range(60))]
    data, begins, _ = context_mixing._run(texts)
    before = np.append(np.uint8(0), data[:-1])
    before[begins] = 0
    code = context_mixing.codes_after(np.bincount(before.astype(int) << 8 | data, minlength=1 << 16).reshape(256, 256))
    symbols, hashes = code.symbols(before, data), context_mixing.contexts(data, begins)
    predicted, plain = [], context_mixing.decisions

    def counted(some, *rest):
        predicted.append(len(some))
        return plain(some, *rest)

    monkeypatch.setattr(context_mixing, "decisions", counted)
    for most, part in ((1, 1), (50, 1 << 20), (1 << 20, 300), (1 << 20, 1 << 20)):  # bytes of a piece and of a part of its pairs
        monkeypatch.setattr(context_mixing, "SHARED", most)
        monkeypatch.setattr(context_mixing, "PART_BYTES", part)
        # byte by byte
        wanted, got = np.zeros((1 << 16, 2), np.uint32), np.zeros((1 << 16, 2), np.uint32)
        place, each = plain(symbols, hashes, 16, code)
        for _, taken, slots in each:
            np.add.at(wanted.reshape(-1), (slots * 2 + taken).ravel(), 1)
        context_mixing.add_texts(got, data, begins, 16, code)
        assert (got == wanted).all()
        m = context_mixing.fresh_mixer(16, context_mixing.packed(got[:, 0], got[:, 1]), code)
        m.weights += np.random.default_rng(1).random(m.weights.shape, np.float32) / 4
        logs, followed = np.zeros(len(data)), np.zeros((2, context_mixing.DEPTH, context_mixing.STEPS))
        place, each = plain(symbols, hashes, 16, code)
        for d, taken, slots in each:
            x, gate = m.inputs(slots, taken)
            where = context_mixing.step_of(m.mixed(x, gate), context_mixing.STEPS)
            np.add.at(followed[:, d], (taken, where), 1)
            logs[place[:len(taken)]] += np.log10(np.abs(m.final(d, m.mixed(*m.inputs(slots))) - (1 - taken)))
        assert np.allclose(m.texts(data, begins), np.add.reduceat(logs, begins), rtol=1e-4)
        learned = np.zeros_like(followed)
        context_mixing.learn(m, data, begins, learned, rate=0)
        assert learned.sum() == followed.sum() and np.abs(learned - followed).sum() < 1e-3 * followed.sum()
    predicted.clear()
    repeated, starts, _ = context_mixing._run(texts * 20)
    m.texts(repeated, starts)
    assert sum(predicted) < len(repeated) / 10


def test_bytes_sum_to_one_under_a_short_code():
    seen = np.zeros(256)
    seen[97:123] = np.arange(1, 27) ** 4
    code = context_mixing.short_code(seen)
    assert sum(0.5 ** float(n) for n in code.length) == 1 and code.length[122] < 8 < code.length[97]
    data, begins, _ = context_mixing._run(["zyx zyy", "zyx zya zy"] * 5)
    table = np.zeros((1 << 16, 2), np.uint32)
    context_mixing.add_texts(table, data, begins, 16, code)
    m = context_mixing.fresh_mixer(16, context_mixing.packed(table[:, 0], table[:, 1]), code)
    each = context_mixing.contexts(np.frombuffer(b"zyx zy ", np.uint8), np.array([0]))[:, -1:]
    total = 0.0
    for c in range(256):  # every byte after the same contexts
        _, steps = context_mixing.decisions(np.array([c], np.uint8), each, 16, code)
        total += np.prod([abs(m.final(d, m.mixed(*m.inputs(slots)))[0] - (1 - taken[0])) for d, taken, slots in steps])
    assert abs(total - 1) < 1e-4


def test_quality(docs, empty, spark):
    r = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        good = i % 4 > 0
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(60)]
        rows.append((i, (" " if good else " | ").join(words) + ".", None, None, 0, "", "", ""))
        marks += [(i, int(good)), (i, None)] if i % 3 else [(i, int(good))] * 2
    df = spark.createDataFrame(rows, DOC).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    labels = spark.createDataFrame(marks + [(None, 1)], "doc_id long, quality int")
    got = quality_gam.classify(df, labels).collect()
    truth = dict(m for m in marks if m[1] is not None)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(got) == df.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held) > 50
    kept = quality_gam.keep_good(df, labels)
    assert kept.columns == df.columns and {i for i, _ in pairs(kept)} == {x.doc_id for x in got if x.predicted}
    assert quality_gam.classify(df, labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality_gam.classify(empty, labels).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(4)
    vectors = r.normal(size=(1500, 16)).astype(np.float32).astype(float).tolist()
    vectors[300:420] = [vectors[5]] * 120  # a common vector, its ids in ties
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    rows += [(2000, None, ""), (2100, [0.0] * 16, ""), (2200, [float("nan")] * 16, ""), (2300, [None] * 16, ""), (2400, [1.0], ""), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = hnsw.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=400).collect()
    hits = total = 0
    x = np.array(vectors)
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.rank for g in mine] == list(range(1, 11))
        assert [(g.score, g.vec_id) for g in mine] == sorted((g.score, g.vec_id) for g in mine)
        assert all(abs(g.score - d[g.vec_id]) < 1e-9 for g in mine)
        hits += len({g.vec_id for g in mine} & set(want))
        total += 10
    assert hits >= 0.9 * total and {g.query_id for g in got} == set(range(0, 1500, 100))
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, score string")
    assert hnsw.nearest(few, F.lit(True)).count() == 12 and hnsw.nearest(df.limit(0), F.lit(True)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">%s</a></li>
</ul></nav><!-- ad --><div class="ad">%s</div><article><h1>%s</h1><p><b>%s<br><p>x &amp; y</p></article><footer>&copy; %s</footer></body></html>"""


def test_nearest_of_every_shard_and_dimension(spark):
    """Few vectors over many shards, some of which stay empty, and vectors of other dimensions."""
    r = np.random.default_rng(3)
    vectors = {i: r.normal(size=4).tolist() for i in range(12)} | {100 + i: r.normal(size=3).tolist() for i in range(3)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    for shard_rows in (1, 3, 4096):
        got = defaultdict(list)
        for x in hnsw.nearest(df, F.lit(True), shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            got[x.query_id].append(x.vec_id)
        for q, v in vectors.items():
            near = sorted((math.dist(v, w), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            assert got[q] == [i for _, i in near[:10]]


def test_text_in_rare_tags_stays():
    page = "<body><article><p>area is <math><mi>x</mi></math> units <object>old</object> <svg>s</svg></p><noscript>for all</noscript>"
    page += "<p>before <object>open</p><p>after</p><script>var a</script><p>last</p><template>no</template></article></body>"
    assert [t for _, t, _ in html_blocks.blocks(page)] == ["area is x units old s", "for all", "before open", "after", "last"]
    assert [t for _, t, _ in html_blocks.blocks("<p>a</p><template>x<p>b</p>")][-1] == "b"


def test_html(spark):
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(n))
    parts = [tuple(say(r.randint(1, 30)) for _ in range(5)) for _ in range(60)]
    rows = [(i, "u", PAGE % p, "t") for i, p in enumerate(parts)] + [(90, "u", None, ""), (91, "u", "", ""), (92, None, "<p", "")] + [(0, "u", PAGE % parts[0], "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    model = html_blocks.train(pages, drawn=250)
    got = [(x.page_id, x.text, x.n_chars) for x in html_blocks.extract(pages, model, keep=["url"]).collect()]
    for i, p in enumerate(parts):
        want = f"{p[2]}\n{p[3]}\nx & y"
        assert (i, want, len(want)) in got
    assert len(got) == len(rows) and {(90, "", 0), (91, "", 0)} <= set(got)
    assert html_blocks.extract(pages.limit(0), model).count() == 0
    assert html_blocks.train(pages.limit(0), drawn=5).label([]) == []


def test_blocks_of_broken_markup():
    page = "<div>a<p>b &lt; c<p>d<li>e<li>f</div>g <b>h</b>i<script>no</div></script> j<p title='x>y'>k<"
    assert [t for _, t, _ in html_blocks.blocks(page)] == ["a", "b < c", "d", "e", "f", "g hi j", "k<"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [t for _, t, _ in html_blocks.blocks(deep)] == ["x"]


def test_lstm_gradients():
    r = np.random.default_rng(1)
    m = html_blocks.Labeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, mask = r.normal(size=(4, 2, html_blocks.WIDTH)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    y = r.integers(0, 2, (4, 2)).astype(float)

    def loss():
        z = m.logits(x, mask)
        return ((np.log1p(np.exp(z)) - y * z) * mask).sum() / mask.sum()

    grads = m.gradients(x, mask, y)
    for name, at in (("xf", (3, 5)), ("hb", (2, 9)), ("bf", (40,)), ("o", (4,)), ("c", (0,))):
        m.w[name][at] += 1e-3
        up = loss()
        m.w[name][at] -= 2e-3
        down = loss()
        m.w[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    labels = [(i, int(i % 5 > 0)) for i in range(60)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = dict(pairs(kept))
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and set(dict(pairs(kept))) <= set(before)
        names.append(name)
    assert names == ["quality", "exact", "near", "secrets"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(dict(pairs(kept)))


def test_components_grow_by_further_edges(spark):
    """As if all edges had been given at once, also for nodes that were in none before."""
    from adledger.llm.components import components, merged

    rnd = random.Random(5)
    edges = [(rnd.randrange(60), 60 + rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(200, 230)]
    rnd.shuffle(edges)
    frame = lambda part: spark.createDataFrame(part, "a long, b long")
    grown = merged(components(frame(edges[:30])), frame(edges[30:] + edges[:5]))
    assert sorted(grown.collect()) == sorted(components(frame(edges)).collect())
