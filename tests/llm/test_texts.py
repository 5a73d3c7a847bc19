"""Operators on single texts against brute force, with odd inputs."""

import collections
import math
import pickle
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import byte_cnn, context_mixing, decontaminate, language_id, order_minhash, packing, pseudonyms, quality_rules, section_tokens, wavelet
from lumenframe.llm.word_ids import WordEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
KEY = b"test"
ODD = ["", " \n\t ", "a", "İstanbul ΑΣ ΟΔΟΣ. éa Å ﬁ don't I'LL x's", "<|endoftext|>a <|x ½³ ª", "b\x1cc\x85d 日本語 12345 á £€5 naïve\xadx", "a" * 300 + "é" * 200, "x\x00y ?!?? ···"]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(WORDS)


def direct(encoder, text):
    return np.asarray(encoder.whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", [None, *ODD])
def test_ids_are_the_tokenizers(encoder, text):
    assert encoder.encode(text) == direct(encoder, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_ids_of_any_text(text):
    e = test_ids_of_any_text.__dict__.setdefault("e", WordEncoder(WORDS))
    assert e.encode(text) == direct(e, text)


def test_ids_when_the_memory_is_small(encoder):
    e = WordEncoder(WORDS)
    e.chunks.most = e.words.most = 3
    texts = [f"word{i % 7} other{i} the" for i in range(40)]
    assert [e.encode(t) for t in texts] == [direct(encoder, t) for t in texts]


def test_the_library_is_asked_once_for_each_distinct_word():
    """However a word is written or what stands around it: words are cut from texts as arrays."""
    texts = ["Über, ÜBER; über... 2020 naïve", None, "don't Don't über--naïve ×÷ 日本 a<b", "", "The the,THE! (the) 日本 a <|endoftext|>x"] * 3
    e, asked = WordEncoder(WORDS), []

    class Model:
        def tokenize(self, word):
            asked.append(word)
            return e.whole.model.tokenize(word)

    e.model = Model()
    assert [e.encode(t) for t in texts] == [direct(e, t) for t in texts] == e.encode_many(texts)
    plain = [w for w in asked if w not in ("don", "'t")]  # those of a chunk with an apostrophe are asked for with it
    assert len(plain) == len(set(plain)) and {"the", "a", "b", "<", ",", "2", "0"} <= set(plain) and len(e.words.keys) == len(set(e.words.keys.to_pylist()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aZé×ÉßÿÃ '<|.,15\t\n\x00\x1c\x85\xa0\u0301\u2003日K", max_size=30), max_size=4))
def test_ids_of_texts_of_few_characters(encoder, texts):
    assert encoder.encode_many(texts) == [direct(encoder, t) for t in texts]


@pytest.mark.parametrize("n,most", [(0, 1), (1, 1), (7, 2), (1000, 30), (5000, 40000), (64, 3), (513, 1)])
def test_wavelet_shard(n, most):
    t = np.random.default_rng(n).integers(0, most, n).astype("<u4") * 3
    lengths = [n // 2, n - n // 2]
    s = wavelet.WaveletShard.from_bytes(wavelet.WaveletShard.build([None, 7], lengths, t).to_bytes())
    assert s.decode().tolist() == t.tolist() and s.doc_ids == [None, 7] and s.lengths.tolist() == lengths
    for i in range(0, n, max(1, n // 20)):
        assert s.access(i) == t[i]
    for token in {0, 3, 1, *t[:5].tolist()}:
        where = np.flatnonzero(t == token)
        assert s.count(token) == len(where) and s.rank(token, n // 3) == (where < n // 3).sum()
        for k in range(0, len(where), max(1, len(where) // 9)):
            assert s.select(token, k) == where[k]
        if len(where) < 50:
            assert s.occurrences(token) == where.tolist()
    with pytest.raises(IndexError):
        s.access(n)
    with pytest.raises(ValueError):
        wavelet.WaveletShard.from_bytes(b"x" * 64)


def brute_windows(text, items):
    w = decontaminate.words(text)
    hit, ids = set(), set()
    for i, t in items:
        p = decontaminate.words(t)
        m = min(10, len(p))
        windows = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if m else set()
        for k in range(len(w) - m + 1 if m else 0):
            if tuple(w[k : k + m]) in windows:
                hit.update(range(k, k + m))
                ids.add(i)
    return len(w), len(hit), sorted(ids)


def test_wu_manber_against_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(60):
        vocabulary = [f"w{i}" for i in range(2 + trial % 5)]
        items = [(str(k), " ".join(rng.choice(vocabulary, rng.integers(0, 16)))) for k in range(5)] + [("n", None), ("s", vocabulary[0])]
        searchers = decontaminate.compile_items(items)
        text = " ".join(rng.choice(vocabulary, rng.integers(0, 80)))
        n, spans, ids = decontaminate.search(text, searchers)
        assert (n, sum(spans[1::2]) - sum(spans[::2]), ids) == brute_windows(text, items)
    assert decontaminate.search(None, searchers) == (0, [], []) and decontaminate.compile_items([]) == []


@pytest.mark.parametrize("size", [1, 2, 3, 10, 257, 1000])
def test_permutations(size):
    image = [pseudonyms.permute(x, size, KEY, "t") for x in range(size)]
    assert sorted(image) == list(range(size))
    assert [pseudonyms.permute(y, size, KEY, "t", back=True) for y in image] == list(range(size))
    if size > 100:
        assert image != [pseudonyms.permute(x, size, b"other", "t") for x in range(size)]


VALID = {
    "mail": ["hein.19@mail5.example.com", "A_b+c@x.org"], "card": ["4390698575873170", "4111 1111 1111 1111"], "ip": ["233.233.171.252", "1.2.3.4"],
    "phone": ["+1 (743) 555-3824", "(456) 555-2186", "456-555-2186"], "ssn": ["123-45-6789", "899-01-0001"], "date": ["1984-02-29", "02/28/1999", "31.12.2001", "28/02/1999"],
    "secret": ["11acdfb36bb72224148e6160f674b4be45601bff", "Ab3dEf6hIj9lMnOp"], "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
}
SHAPE = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "bcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "BCDEFGHIJKLMNOPQRSTUVWXYZ"}})


@pytest.mark.parametrize("kind,value", [(k, x) for k, xs in VALID.items() for x in xs])
def test_pseudonyms_keep_format_and_go_back(kind, value):
    new = pseudonyms.pseudonym(kind, value, KEY)
    assert new != value and pseudonyms.pseudonym(kind, new, KEY, back=True) == value
    if kind not in ("ip", "secret"):
        assert new.translate(SHAPE) == value.translate(SHAPE)
    text = f'about {value if kind != "secret" else f"""token = "{value}" """}, and so on'
    out, found = pseudonyms.replace(text, KEY)
    assert [k for k, _, _ in found] == [kind] and value not in out and new in out
    k, start, length = found[0]
    assert out[start : start + length] == new
    assert pseudonyms.replace(text, KEY) == (out, found)


def test_invalid_values_stay():
    for text in ("8007782375593431", "999.1.1.1", "000-12-3456", "2001-02-30", "Version 2.0.", "GB00WEST12345698765432", "1111111111111111", "clean text", "", "x" * 5000, "1" * 5000, "a@b"):
        assert pseudonyms.replace(text, KEY) == (text, [])
    assert pseudonyms.replace(None, KEY) == (None, [])
    out, found = pseudonyms.replace("4390698575873170 8007782375593431 4390698575873170", KEY)
    assert len(found) == 2 and out.split()[0] == out.split()[2] != "4390698575873170" and out.split()[1] == "8007782375593431"


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines), len(re.findall("[A-Z]", t))


@settings(max_examples=200, deadline=None)
@given(st.text("ab# \n\t\x0b\x1c\xa0É|", max_size=60))
def test_statistics(text):
    assert quality_rules.text_stats(text) == (brute_stats(text) if text else (0,) * 7)


def test_binomial_tails_and_cutoffs():
    for n, k, p in ((10, 0, 0.1), (20, 3, 0.2), (50, 7, 0.05)):
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert quality_rules.binomial_tail(5, 5, 0.1) == 1
    assert quality_rules.choose([0, 0, 30], [5, 9, 20], 1000, 0.01, 0.01) == 1  # the third rejects 3 % of the good
    assert quality_rules.choose([0, 0], [5, 9], 100, 0.01, 0.01) is None  # too few to tell
    assert quality_rules.choose([0, 0], [0, 0], 1000, 0.01, 0.01) is None  # nothing to gain
    assert quality_rules.choose([], [], 0, 0.01, 0.01) is None


def full_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        e = [i + 1]
        for j, y in enumerate(b):
            e.append(min(d[j + 1] + 1, e[j] + 1, d[j] + (x != y)))
        d = e
    return d[-1]


def test_banded_distance():
    rng = np.random.default_rng(1)
    for _ in range(600):
        a, b = (rng.integers(0, 4, rng.integers(0, 14)).tolist() for _ in range(2))
        want = full_distance(a, b)
        for band in (1, 3, 8, 14):
            got = order_minhash.distance(a, b, band)
            assert got >= want and (got == want or want > band)


def test_similarity_and_sketches():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 50, rng.integers(1, 60))
        b = a.copy()
        b[rng.random(len(b)) < rng.random() * 0.4] = 99
        b = np.delete(b, rng.integers(0, len(b))) if len(b) > 1 and rng.random() < 0.5 else b
        want = 1 - full_distance(a.tolist(), b.tolist()) / max(len(a), len(b))
        assert order_minhash.similarity(a, b) == pytest.approx(want if want >= 0.8 - 1e-9 else 0)
    hashes = order_minhash._Hashes()
    for empty in ("", None, " ,. "):
        assert order_minhash.sketch(empty, hashes) == (None, None, 0, None)
    assert order_minhash.sketch("One, two", hashes) == order_minhash.sketch("one TWO!", hashes)
    # repeated words count: k-mers carry their occurrence number
    once, thrice = (np.frombuffer(order_minhash.sketch("a b c d e f g " * n, hashes)[3], "<u4").astype(np.uint64) for n in (1, 3))
    assert len(set(order_minhash.kmers(thrice).tolist())) == len(thrice) - order_minhash.K + 1 and set(order_minhash.kmers(once).tolist()) < set(order_minhash.kmers(thrice).tolist())


def test_histograms_bound_the_distance_from_below():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 2**32, rng.integers(1, 60)).astype(np.uint32)
        b = np.where(rng.random(len(a)) < 0.2, rng.integers(0, 2**32, len(a)), a).astype(np.uint32)[int(rng.integers(0, 2)) :]
        for bins in (order_minhash.BINS, order_minhash.FINE_BINS):
            assert np.abs(order_minhash.histogram(a, bins).astype(int) - order_minhash.histogram(b, bins)).sum() <= 2 * full_distance(a.tolist(), b.tolist())


def test_a_token_over_a_boundary_goes_by_the_rule():
    ends, starts = np.array([3, 8, 10]), np.array([0, 5, 9])
    assert section_tokens.attribute(ends, starts, "largest")[0].tolist() == [0, 1, 1]
    assert section_tokens.attribute(ends, starts, "first")[0].tolist() == [0, 0, 1]
    assert section_tokens.attribute(ends, starts, "last")[0].tolist() == [0, 1, 2]
    assert section_tokens.attribute(ends, starts)[1].tolist() == [False, True, True]
    assert section_tokens.attribute(np.array([4]), np.array([0, 2]), "largest")[0].tolist() == [0]  # equal shares: the earlier


@pytest.mark.parametrize("rule", section_tokens.RULES)
def test_tokens_by_section_against_brute_force(rule):
    enc, _ = section_tokens.encoding(RANKS)
    for text in ("a\n\n\n  b\nthe end\n", "été\nça va\n\n日本語\n", "one line", "\n\n", "x"):
        starts = section_tokens.line_sections(text)
        got, crossing = section_tokens.count(text, starts, RANKS, rule)
        ids = enc.encode_ordinary(text)
        section_of_byte = [max(i for i, s in enumerate(starts) if s <= c) for c, ch in enumerate(text) for _ in ch.encode()]
        want, cross, at = [0] * len(starts), [0] * len(starts), 0
        for i in ids:
            n = len(enc.decode_single_token_bytes(i))
            own = section_of_byte[at : at + n]
            at += n
            pick = own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=lambda s: (own.count(s), -s))
            want[pick] += 1
            cross[pick] += own[0] != own[-1]
        assert got.tolist() == want and crossing.tolist() == cross and sum(want) == len(ids)


def test_packer_fills_sequences():
    rng = np.random.default_rng(3)
    for segments, cut in ((64, True), (4, True), (64, False)):
        limits = packing.Limits(256, segments, 256)
        p, out, lengths = packing.Packer(limits, cut, waiting=50), [], rng.integers(1, 256 if not cut else 900, 400).tolist()
        for i, n in enumerate(lengths):
            out += p.add(i, 0, n, n - 1)
        out += p.finish()
        seen = collections.defaultdict(list)
        for s in out:
            assert sum(x.length for x in s) <= 256 and len(s) <= segments and sum(x.loss for x in s) <= 256
            for x in s:
                seen[x.item].append((x.start, x.length))
        for i, n in enumerate(lengths):
            at = 0
            for start, length in sorted(seen[i]):
                assert start == at and length > 0
                at += length
            assert at == n
            assert cut or len(seen[i]) == 1
        if cut and segments == 64:
            assert all((n := sum(x.length for x in s)) == 256 or n & (n - 1) == 0 for s in out)


def test_packer_respects_loss_limits():
    p = packing.Packer(packing.Limits(100, 10, 20), cut=False)
    out = [s for i in range(30) for s in p.add(i, 0, 20, 9)] + list(p.finish())
    assert all(sum(x.loss for x in s) <= 20 for s in out) and sum(map(len, out)) == 30
    with pytest.raises(ValueError):
        list(p.add(0, 0, 101, 0))


def test_language_classifier():
    c = language_id.Classifier({"a": b"the quick brown fox jumps over the lazy dog and runs away " * 3, "b": b"der schnelle braune fuchs springt ueber den faulen hund davon " * 3})
    assert c.predict("The quick fox runs over the dog")[0] == "a" and c.predict("der faule Hund springt davon")[0] == "b"
    assert c.predict(None) == c.predict("") == c.predict("12 ! 3") == ("und", 0.0, False)
    assert language_id.Classifier({}).predict("abc")[0] == "und"
    assert 0 <= c.predict("x" * 100_000)[1] <= 1


def test_network_gradients_and_long_texts():
    net = byte_cnn.Net(1)
    docs = [byte_cnn.blocks_of(byte_cnn.to_bytes(t)) for t in ("some text here, and more of it", "another one that differs", "x")]
    y = np.array([1, 0, 1], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.grads(docs, y)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if k == "e":
                at = (docs[0][0].reshape(-1)[int(rng.integers(0, 20))], at[1])
            keep, eps = v[at], 1e-3
            v[at] = keep + eps
            up = net.grads(docs, y)[0]
            v[at] = keep - eps
            down = net.grads(docs, y)[0]
            v[at] = keep
            assert (up - down) / (2 * eps) == pytest.approx(float(g[k][at]), abs=3e-3)
    net = byte_cnn.Net(2)
    for n in (0, 1, 31, 32, 33, 4000):
        raw = np.random.default_rng(n).integers(97, 100, n).astype(np.uint8)
        whole = net.chunks(net.inputs(*byte_cnn.blocks_of(raw))).max(0)
        old, byte_cnn.SEGMENT = byte_cnn.SEGMENT, 256
        try:
            parts = net.pooled(raw)
        finally:
            byte_cnn.SEGMENT = old
        assert (parts >= whole - 1e-4).all() and np.allclose(net.pooled(raw), whole, atol=1e-4)
        assert np.allclose(parts, whole, atol=0.35)
    assert byte_cnn.Net().score([]).shape == (0,) and 0 <= byte_cnn.Net().score([None, ""])[0] <= 1


def test_classifier_learns():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    good = [" ".join(rng.choice(words, 80)) for _ in range(80)]
    bad = [" | ".join(rng.choice(words, 60)) for _ in range(40)] + [" ".join(np.repeat(rng.choice(words, 8), 10)) for _ in range(40)]
    net = byte_cnn.train(good[:60] + bad[10:], [1] * 60 + [0] * 70, epochs=12)
    assert (net.score(good[60:]) > 0.5).all() and (net.score(bad[:10]) < 0.5).all()
    assert (byte_cnn.train(["a"], [1]).score(["b"]) > 0.9).all()


def test_bits_of_a_word_sum_to_one():
    """The probabilities of all words over a tiny alphabet, up to a length, and of what goes beyond, are 1."""
    counts = np.zeros(256, np.int64)
    counts[[97, 98, 32]] = (10, 5, 7)
    code = context_mixing.Code(counts)
    gates = context_mixing.Gates({b"ab": 0})
    tables = [np.zeros((2, 1 << b), np.float32) for b in context_mixing.SLOT_BITS]
    items = [b"ab", b"a", b"", b"b", b"ab"]
    e = context_mixing.Events(code, items, np.zeros(5, np.int64))
    for t, s in zip(tables, e.slots):
        np.add.at(t, (e.bit.astype(int), s), 3)
    model = context_mixing.Model(code, gates, tables)
    model.learn(items, np.zeros(5, np.int64), np.full(5, 3), np.full(5, 3))
    every = [bytes([b]) for b in range(256) if b != 32]
    first = 10 ** model.log_probabilities([b""], np.zeros(1, np.int64))[0]
    # a byte's probability: all words that begin with it; the end of the word after one byte splits it further
    e = context_mixing.Events(code, every + [b""], np.zeros(256, np.int64))
    x, sets = model._inputs(e, np.zeros(256, np.int64))
    p = model._refine(model._mix(x, sets), np.zeros(len(e.bit), np.int64))
    own = e.byte == np.concatenate([[0], np.cumsum([len(w) + 1 for w in every])])[e.word]  # the first byte alone
    logs = np.bincount(e.word[own], np.log(np.where(e.bit, p, 1 - p))[own], 256)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-6) and np.exp(logs[255]) == pytest.approx(first)


def test_large_counts_stay_finite():
    n0, n1 = np.array([0, 4e9, 0, 5], np.float32), np.array([4e9, 0, 0, 1e9], np.float32)
    x = context_mixing.stretch(n0, n1)
    assert np.isfinite(x).all() and x[0] == 12 and x[1] == -12 and x[2] == 0
    code = context_mixing.Code(np.zeros(256, np.int64))
    tables = [np.full((2, 1 << b), 0, np.float32) for b in context_mixing.SLOT_BITS]
    for t in tables:
        t[1] = 3e8
    model = context_mixing.Model(code, context_mixing.Gates({}), tables)
    for _ in range(3):
        model.learn([b"the", b"a"], np.zeros(2, np.int64), np.array([10**8, 1]), np.array([10**8, 1]))
    assert np.isfinite(model.weights).all() and np.isfinite(model.log_probabilities([b"the", b"x"], np.zeros(2, np.int64))).all()


def test_gates_follow_the_text():
    g = context_mixing.Gates({b"the": 0, b"der": 1})
    gates_of = lambda *texts: g.of(np.array([g.classes.get(w, -1) for t in texts for w in t.split()], np.int8), np.cumsum([0] + [len(t.split()) for t in texts])[:-1]).tolist()
    assert gates_of(b"x the y the z der q der r") == [2, 2, 0, 0, 0, 0, 0, 0, 1]
    assert gates_of(b"x the y", b"a b", b"der z the z") == [2, 2, 0, 2, 2, 2, 1, 1, 1]  # every text begins anew
    assert gates_of(b"z") == [2] and g.of(np.zeros(0, np.int8), np.zeros(0, np.int64)).tolist() == []
    together = np.array([[10, 9, 0], [9, 10, 0], [0, 0, 10]])
    c = context_mixing.Gates.cluster([b"a", b"b", b"c"], together).classes
    assert c[b"a"] == c[b"b"] != c[b"c"]


def test_crc32_is_unsigned():
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == 0x99F8B879


def test_alike_texts_share_a_key_whatever_their_length():
    """Recall of the search by similarity: every word changed independently, all pairs of a family, by the operator's own similarity."""
    rng = np.random.default_rng(4)
    for n in (6, 12, 19, 22, 30, 60, 119, 125, 200, 600):
        met = {0.80: [], 0.85: [], 0.90: []}
        for rate in (0.05, 0.08, 0.1):
            for _ in range(12):
                base = rng.integers(1, 2**32, n)
                family = [np.where(rng.random(n) < rate, rng.integers(1, 2**32, n), base).astype(np.uint32) for _ in range(4)]
                keys = [set(order_minhash.keys_of(h).tolist()) for h in family]
                for i in range(4):
                    for j in range(i):
                        if (s := order_minhash.similarity(family[i], family[j])) and s < 1:
                            met[max(k for k in met if k <= s + 1e-9)].append(bool(keys[i] & keys[j]))
        for least, found in met.items():
            assert not found or np.mean(found) >= (1 if n < 20 else 0.9), (n, least)


def test_segments_find_every_pair_of_few_words():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(4, 23))
        a = rng.integers(1, 60, n).astype(np.uint32)
        b = a.tolist()
        for _ in range(int(rng.integers(1, 5))):
            at = int(rng.integers(0, len(b) + 1))
            kind = int(rng.integers(0, 3))
            b[at : at + (kind > 0)] = [int(rng.integers(60, 99))] if kind < 2 else []
        b = np.array(b, np.uint32)
        if min(len(a), len(b)) < order_minhash.FEW_WORDS and order_minhash.similarity(a, b):
            assert np.array_equal(a, b) or set(order_minhash.keys_of(a).tolist()) & set(order_minhash.keys_of(b).tolist())


def test_a_text_s_own_predictors_against_a_plain_loop():
    rng = np.random.default_rng(2)
    word = rng.integers(0, 6, 200)
    spelt = np.log10(rng.dirichlet(np.ones(6)))[word]
    starts = np.array([0, 1, 40, 41, 160])
    got = context_mixing.adapted(spelt, word, starts)
    for a, b in zip(starts, [*starts[1:], 200]):
        logs, seen, pairs = np.zeros(3), collections.Counter(), collections.Counter()
        for i in range(a, b):
            p, t, d = 10 ** spelt[i], sum(seen.values()), len(seen)
            words = (seen[word[i]] + d * p) / (t + d) if t else p
            own = words
            if i > a:
                n_v = sum(n for (v, _), n in pairs.items() if v == word[i - 1])
                own = (pairs[word[i - 1], word[i]] + words) / (n_v + 1)
            x = np.array([p, words, own])
            w = np.exp(context_mixing.ADAPT * logs)
            w = context_mixing.FLOOR + (1 - 3 * context_mixing.FLOOR) * w / w.sum()
            assert got[i] == pytest.approx(np.log10(w @ x), rel=1e-9)
            logs += np.log(x)
            seen[word[i]] += 1
            if i > a:
                pairs[word[i - 1], word[i]] += 1


def test_large_counts_travel_unharmed():
    model = context_mixing.Model(context_mixing.Code(np.ones(256)), context_mixing.Gates({}), [np.full((2, 1 << b), 5e12, np.float32) for b in context_mixing.SLOT_BITS])
    again = pickle.loads(pickle.dumps(model))
    assert all(np.array_equal(x, y) for x, y in zip(model.tables, again.tables))
    assert np.isfinite(again.log_probabilities([b"word", b""], np.zeros(2, np.int64))).all()


def test_parts_count_words_by_gate(monkeypatch):
    """Words numbered without becoming objects, in several rounds, against plain loops over gates and counters."""
    monkeypatch.setattr(context_mixing, "SOME_BYTES", 300)
    rng = np.random.default_rng(4)
    gates = context_mixing.Gates({b"a": 0, b"bb": 1, b"c": 0})
    vocabulary = ["a", "BB", "c", "\u00e4x", "d\u2003d", "e" * 300, "f\x00"]
    texts = [None, "", " \t ", "a"] + ["\n".join(rng.choice(vocabulary, rng.integers(0, 40))) for _ in range(60)]
    raws = [b" ".join(context_mixing.words(t)) for t in texts]
    lengths, at, distinct = context_mixing.numbered(raws)
    names, tokens = distinct.to_pylist(), [[*context_mixing.words(t), b""] for t in texts]
    assert [names[i] for i in at] == [w for own in tokens for w in own] and lengths.tolist() == [len(own) for own in tokens] and len(set(names)) == len(names)
    part, want, seen = context_mixing._Part(gates), {}, set()
    for i, (t, own) in enumerate(zip(texts, tokens)):
        part.add(i, t, i % 3 > 0)
        classes = np.array([gates.classes.get(w, -1) for w in own], np.int8)
        for w, g in zip(own, gates.of(classes, np.array([0])).tolist()):
            seen.add((w, g))
            want[w, g] = want.get((w, g), 0) + (i % 3 > 0)
    got = {}
    for row in part.vocabulary(0, 3):
        own = context_mixing.unpack(row.column(3)[0].as_py()).split(b"\n")
        both = np.frombuffer(context_mixing.unpack(row.column(4)[0].as_py()), "<i4").reshape(gates.n, -1)
        got |= {(w, g): int(both[g, j]) for j, w in enumerate(own) for g in range(gates.n) if both[g, j]}
    assert len(part.found) > 1 and got == {k: 2 * n + 1 for k, n in want.items()} and seen == got.keys()
    key = rng.integers(0, 9, 500)
    for k in (key, key - 4, key << 56):  # small, negative and too large keys
        n, number = context_mixing.earlier(k)
        assert n.tolist() == [int((k[:i] == x).sum()) for i, x in enumerate(k)] and number.tolist() == np.unique(k, return_inverse=True)[1].tolist()


def test_parts_keep_texts_as_numbers_of_their_words(monkeypatch):
    """The rows of documents, with the words of the shards in their order, give every token back, over several rounds and rows; so do the profile's counts."""
    monkeypatch.setattr(context_mixing, "SOME_BYTES", 400)
    monkeypatch.setattr(context_mixing, "BLOB_BYTES", 150)
    rng = np.random.default_rng(5)
    texts = [None, "", " \t ", "A\x0bb \u00c4\u2003x\r\nb"] + [" ".join(rng.choice(["a", "BB", "c\x1cd", "\u00e4", "e" * 40], rng.integers(0, 30))) for _ in range(70)]
    part = context_mixing._Part(context_mixing.Gates({b"a": 0, b"bb": 1}))
    for i, t in enumerate(texts):
        part.add(None if i == 5 else i - 3, t, i % 2 == 0)
    rows = [r.to_pylist()[0] for r in [*part.vocabulary(7, 4), *part.texts(7)]]
    words = [w for r in sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["r"]) for w in context_mixing.unpack(r["words"]).split(b"\n")]
    assert context_mixing.listed(b"\n".join(words)).to_pylist() == words and len(set(words)) == len(words)
    got = []
    for r in rows:
        if r["kind"] == 1:
            at = np.ascontiguousarray(np.frombuffer(context_mixing.unpack(r["words"]), np.uint8).reshape(4, -1).T).view("<u4").ravel().tolist()
            for key, null, train, n, size in np.frombuffer(context_mixing.unpack(r["counts"]), context_mixing.DOCUMENT).tolist():
                got.append((None if null else key, train, [words[i] for i in at[:n]], size))
                at = at[n:]
            assert not at
    own = [context_mixing.words(t) for t in texts]
    assert got == [(None if i == 5 else i - 3, i % 2 == 0, [*w, b""], len(b" ".join(w)) + 1) for i, w in enumerate(own)] and sum(r["kind"] == 1 for r in rows) > len(part.found) > 1
    batch = lambda t: context_mixing.pa.RecordBatch.from_pydict({"t": context_mixing.pa.array(t, "string")})
    monkeypatch.setattr(context_mixing, "TOP_SHARE", 0.05)
    profile = [x for b in context_mixing._profile([batch(texts[:40]), batch(texts[40:])]) for x in b.to_pylist()]
    often = collections.Counter(w for x in own for w in x)
    assert {w for w, n in often.items() if n >= 0.05 * often.total()} <= {x["key"] for x in profile if x["kind"] == 0} <= often.keys() and profile[-1]["n"] == often.total()
    together = {(x["i"], x["j"]): x["n"] for b in context_mixing._together([batch(texts)], [b"a", b"bb"]) for x in b.to_pylist()}
    a, b = ({i for i, w in enumerate(own) if name in w} for name in (b"a", b"bb"))
    assert together == {(0, 0): len(a), (0, 1): len(a & b), (1, 0): len(a & b), (1, 1): len(b), (0, None): often[b"a"], (1, None): often[b"bb"]}
