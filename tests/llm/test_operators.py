"""Each corpus operator on hand-made frames, against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, frame
from vigitab.llm import bpe, exact_dedup, langid, mixing, pii, quality_classifier, quality_rules, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = {
    "en": "the water of this old river runs over stones and under the long bridge where children play in summer",
    "de": "der alte fluss zieht sich über steine und unter der langen brücke hindurch wo kinder im sommer spielen",
    "fr": "la vieille rivière coule sur les pierres et sous le long pont où les enfants jouent pendant l'été",
}


def prose(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE[lang].split()) for _ in range(n))


def odd_texts():
    """Null, empty, blank, repeated, very long, without a letter, with a special token."""
    long = prose("en", 1, 60_000)
    return [None, "", " \t\n", "one", "one", "One  one", long, long, "12 + 34 = 46 %%%", "x<|endoftext|>y", "a" * 30_000, "🙂 ñ\u0085  e"]


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    ids = [*range(len(texts) - 1), 3]  # an id comes twice
    df = frame(spark, texts, [None, "en", *["de", "en", None] * 4][: len(texts)], ids=ids)
    return df.withColumns({c: F.lit("mine") for c in ("digest", "fingerprint", "words", "key", "label", "ids", "score", "tokens", "n", "bin", "kept", "unit")}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- exact dedup ------------------------------------------------------------


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return sorted((d, min(v), len(v), d == min(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for d in v)


def test_exact_dedup(spark, odd, none):
    def run(df, index):
        return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in exact_dedup.exact_dedup(df, index).collect())

    index = exact_dedup.new_index(spark)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(odd, index) == expected_groups(rows)
    assert run(odd, index) == expected_groups(rows)  # the same batch again
    assert run(none, index) == []
    later = frame(spark, ["one", "two"], ids=[1, 90])
    assert [(d, k, n, kept) for d, k, n, kept, _ in run(later, index)] == [(1, 3, 1, False), (90, 90, 1, True)]
    again = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    assert again.rows().count() == again.rows().select("digest").distinct().count() == len({x[4] for x in expected_groups(rows)}) + 1


def test_index_side_is_not_shuffled(spark):
    index = exact_dedup.new_index(spark)
    exact_dedup.exact_dedup(frame(spark, ["a", "b"]), index)
    batch = index.rows().select("digest").hint("merge").join(index.rows().hint("merge"), "digest", "left_anti")
    assert "Exchange" not in batch._jdf.queryExecution().sparkPlan().toString()


def test_batches_meet_a_filled_index(spark, odd, monkeypatch):
    given, dropped = [], []
    fresh = exact_dedup.DigestIndex.fresh

    def watched(self, batch):
        out = fresh(self, batch)
        given.append(batch.count())
        dropped.append(given[-1] - out.count())
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan and "Aggregate" not in plan  # the batch is reduced and written before it meets the index
        assert batch.select("digest").distinct().count() == given[-1]
        return out

    monkeypatch.setattr(exact_dedup.DigestIndex, "fresh", watched)
    texts = [f"text {k % 30}" for k in range(200)] + [None]
    df = frame(spark, texts, ids=[*range(200, 0, -1), None])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, exact_dedup.new_index(spark), batches=4).collect()), key=repr)
    first = {}
    for t, d in zip(texts[:200], range(200, 0, -1)):
        first[t] = min(d, first.get(t, d))
    want = [(d, first[t], texts.count(t), d == first[t]) for t, d in zip(texts[:200], range(200, 0, -1))] + [(None, None, 1, True)]
    assert got == sorted(want, key=repr) and len(given) == 4 and dropped[0] == 0 and dropped[1:] == [30, 30, 30]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    again = exact_dedup.exact_dedup(odd, exact_dedup.new_index(spark), batches=3).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in again) == expected_groups(rows)


# --- near dedup -------------------------------------------------------------


def brute_fingerprint(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            up[root(a)] = root(b)
    return [root(k) for k in range(len(prints))]


def near_texts():
    rng, out = random.Random(4), []
    for k in range(12):
        base = prose("en", k, 400).split()
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "changed"
            out.append(" ".join(own))
    return out + ["", None, "a b", "A B"]


@pytest.mark.parametrize("members", [4096, 2])
def test_near_duplicates(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "NODE_ROWS", members)
    texts = near_texts()
    prints = [brute_fingerprint(t) for t in texts]
    roots = brute_components(prints)
    first = {r: min(i for i, x in enumerate(roots) if x == r) for r in roots}
    got = {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (prints[i], first[roots[i]]) for i in range(len(texts))}


def test_null_ids_carry_links(spark, monkeypatch):
    values = {b"a": 0, b"b": 3, b"c": 15, b"d": 0x7777}
    monkeypatch.setattr(simhash, "_fingerprints", lambda batches: (
        simhash.pa.RecordBatch.from_arrays([b.column("doc_id"), simhash.pa.array([values[t.as_py().encode()] for t in b.column("text")], simhash.pa.int64())], ["doc_id", "fingerprint"]) for b in batches))
    got = simhash.near_duplicates(frame(spark, ["a", "b", "c", "d", "b"], ids=[4, None, 3, None, None])).collect()
    assert sorted((r.fingerprint, r.doc_id or -1, r.component_id) for r in got) == [(0, 4, 3), (3, -1, 3), (3, -1, 3), (15, 3, 3), (0x7777, -1, None)]


def test_near_duplicates_on_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in odd.collect())
    assert {r.component_id for r in got if r.fingerprint == 0} == {0}
    assert simhash.near_duplicates(none).collect() == []


def test_trie_pairs_are_all_pairs():
    rng = np.random.default_rng(2)
    ball = np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    values = np.unique(np.concatenate([ball, rng.integers(0, 2**63, 200).astype(np.uint64)]))
    want = {(int(a), int(b)) for a, b in itertools.combinations(values, 2) if int(a ^ b).bit_count() <= 2}
    got = set()
    for by, bits in simhash.BLOCKS:
        turned = np.sort(values << np.uint64(by) | values >> np.uint64(64 - by) if by else values)
        left, right = simhash.trie_pairs((turned >> np.uint64(64 - bits)).astype(np.int64), np.zeros(len(turned), np.int64), turned, np.full(len(turned), bits))
        back = (lambda v: v >> np.uint64(by) | v << np.uint64(64 - by)) if by else (lambda v: v)
        got |= {tuple(sorted((int(a), int(b)))) for a, b in zip(back(turned[left]), back(turned[right]))}
    assert got == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40, 80)] + [(1, 2), (2, 1), (7, 7)], "u long, v long")
    got = {r.id: r.label for r in simhash.components(edges).collect()}
    assert got == {**{i: 40 for i in range(40, 81)}, 1: 1, 2: 1}


# --- personal data ----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            right = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if right[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_spans_equal_the_patterns():
    rng, anchors = random.Random(9), pii.automaton()
    parts = ["1", "2", "40", ".", ".", " ", "-", "+", "@", "a", "b-", "x.", "(", ")", "é", "٣", "12.34.5.6", "4417467210607149", "a@b.c", "+1 (664) 555-5990", "256", "\n", "iban ", "://"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert [s for s in pii.find_spans(text, anchors) if s[0] in pii.BASE] == base_spans(text), text


def test_cues_lead_to_accounts():
    text = "IBAN: DE89370400440532013000, iban DE00370400440532013000; http://u:pw@h.com/x http://h.com ssn 123-45-6789 account no. 12345678 mac 00:1b:44:11:3a:b7 accounts 12345678"
    found = [(k, text[s:e]) for k, s, e in pii.find_spans(text, pii.automaton()) if k not in pii.BASE]
    assert found == [("account", "DE89370400440532013000"), ("login", "http://u:pw@h.com"), ("account", "123-45-6789"), ("account", "12345678"), ("address", "00:1b:44:11:3a:b7")]


def test_cues_lead_to_secrets():
    key = "9f86d081884c7d659a2f"
    text = f'token = "{key}" TOKEN:{key}. my_api_key=\'{key}\', password: hunter2hunter22; token = short1 token {key} mistoken = {key} secret = onlylettershere passwords: {key} Secret_key = "{key}=='
    found = [(s, text[s:e]) for k, s, e in pii.find_spans(text, pii.automaton()) if k == "secret"]
    assert [v for _, v in found] == [key, key, key, "hunter2hunter22", key]
    assert all(text[s - 1] in "\"':= " for s, _ in found)
    assert [k for k, _, _ in pii.find_spans("The token was lost: nobody knew the password of 12345678901234.", pii.automaton()) if k == "secret"] == []


def test_personal_data_rows(odd, none):
    got = {(r.doc_id, len(r.spans)) for r in pii.personal_data(odd).collect()}
    assert got == {(r.doc_id, len(base_spans(r.text or ""))) for r in odd.collect()}
    assert pii.personal_data(none).collect() == []


# --- BPE --------------------------------------------------------------------


def test_bpe_equals_the_tokenizers_library(odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_vocabulary()
    reference = tokenizers.Tokenizer.from_file(path)
    both = bpe.decoded(bpe.encoded(odd, path), path)
    for r in both.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == reference.decode(ids, skip_special_tokens=False)
        assert r.digest == "mine"
    assert bpe.digests(none, path).collect() == []


def test_long_pieces():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    vocabulary = bpe.Vocabulary(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = random.Random(2)
    for n in (64, 65, 300, 200_000):
        text = "".join(rng.choices("abcdeéñ", k=n))
        assert np.frombuffer(bpe.Coder(vocabulary).encode_batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, odd, none):
    rows = bpe.round_trip(odd, bpe.default_vocabulary()).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows) and "text" not in rows[0].asDict() and rows[0].words == "mine"
    assert bpe.round_trip(none, bpe.default_vocabulary()).collect() == []


def test_merge_pieces_side_by_side():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_vocabulary()
    with open(path, encoding="utf-8") as f:
        coder = bpe.Coder(bpe.Vocabulary(f.read()))
    reference, rng = tokenizers.Tokenizer.from_file(path), random.Random(1)
    texts = ["".join(rng.choice("the in' s1²漢🙂.<\n ß") for _ in range(rng.randrange(300))) for _ in range(300)] + ["ab" * 3000, " " * 999]
    for text, ids in zip(texts, coder.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == text


# --- language identification ------------------------------------------------


def test_models_are_distributions():
    counts = {}
    for lang, text in PROSE.items():
        grams, n = np.unique(langid.trigrams(langid.folded(text)), return_counts=True)
        counts[lang] = (grams, n)
    models = langid.Models(counts)
    letters = np.unique(np.concatenate([langid.folded(t) for t in PROSE.values()]))
    for a, b in [(32, 32), (ord("t"), ord("h")), (ord("z"), ord("q"))]:
        p = sum(2 ** models._total(np.array([a << 42 | b << 21 | int(c)], dtype=np.uint64)) for c in letters)
        p = p + 2 ** models._total(np.array([a << 42 | b << 21 | 0x4E00], dtype=np.uint64))
        assert np.allclose(p, 1, atol=1e-4)


def test_language_rows(spark):
    texts = [prose(lang, s) for lang in PROSE for s in range(30)] + [None, "", "123 !!", "xq" * 200]
    langs = [lang for lang in PROSE for _ in range(30)] + ["en", None, "en", None]
    got = {r.doc_id: r for r in langid.identify(frame(spark, texts, langs)).collect()}
    assert all(got[i].lang_pred == langs[i] and not got[i].rejected for i in range(90))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (90, 91, 92))
    assert got[93].rejected and got[93].lang_pred in PROSE
    assert all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_language_of_odd_rows(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert langid.identify(none).collect() == []
    unlabelled = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in unlabelled} == {("und", 0.0, True)}


def test_statistics_are_those_of_the_whole_table(spark):
    texts = [prose(lang, s) for lang in PROSE for s in range(30)] + [f"{chr(97 + k % 26)}{chr(97 + k // 26)} rare" for k in range(100)]
    langs = [lang for lang in PROSE for _ in range(30)] + [f"label{k}" for k in range(100)]
    df = frame(spark, texts, langs)
    counts = {}
    for lang in set(langs):
        parts = [langid.trigrams(langid.folded(t)) for t, own in zip(texts, langs) if own == lang]
        counts[lang] = np.unique(np.concatenate(parts), return_counts=True)
    whole, _ = langid.whole_orders(counts)
    names, cut = sorted(counts), langid.train(df, room=(2000, 800, 950))
    for order, room in zip((0, 1, 2), (2000, 800, 950)):
        rows = [langid.trigram_counts(df.select("lang", "text"))]
        rows.append(rows[0].groupBy("lang", F.col("gram").bitwiseAND(int(langid.LOW)).alias("gram")).agg(F.count("n").alias("n")))
        rows.append(rows[1].groupBy("lang", F.col("gram").bitwiseAND(int(langid.ONE)).alias("gram")).agg(F.count("n").alias("n")))
        got = langid.stored_order(rows[2 - order], names, room)
        assert np.allclose(got.discounts, whole[order].discounts) and len(got.gram) <= room
        want = {(k, g): (n, t) for k, g, n, t in zip(whole[order].lang, whole[order].gram, whole[order].n, whole[order].total)}
        assert all(want[k, g] == (n, t) for k, g, n, t in zip(got.lang, got.gram, got.n, got.total))
    assert len(cut.three.values) < len(whole[2].gram) and set(cut.langs) == set(names)
    assert all(cut.langs[int(np.argmin(cut.entropies(prose(lang, 99))[1]))] == lang for lang in PROSE)
    letters = np.unique(np.concatenate([langid.folded(t) for t in texts]))
    for a, b in [(32, 32), (ord("t"), ord("h")), (ord("z"), ord("q"))]:
        p = sum(2 ** cut._total(np.array([a << 42 | b << 21 | int(c)], dtype=np.uint64)) for c in letters)
        assert np.allclose(p + 2 ** cut._total(np.array([a << 42 | b << 21 | 0x4E00], dtype=np.uint64)), 1, atol=1e-4)


def test_no_ngram_is_left_out_when_there_is_no_room(spark):
    texts = [prose(lang, s) for lang in PROSE for s in range(12)] + [None, "", "12 34", "xq" * 40]
    docs = frame(spark, texts, [lang for lang in PROSE for _ in range(12)] + ["en", None, "en", None])
    want = {r.doc_id: r for r in langid.identify(docs).collect()}
    got = {r.doc_id: r for r in langid.identify(docs, room=(20, 60, 90)).collect()}
    assert set(got) == set(want)
    for i, r in want.items():
        assert (got[i].lang_pred, got[i].letters, got[i].rejected, got[i].held_out) == (r.lang_pred, r.letters, r.rejected, r.held_out)
        assert got[i].entropy == r.entropy or abs(got[i].entropy - r.entropy) < 1e-4


def test_rare_labels_leave_room_to_large_ones():
    sizes = {"en": 5000, "de": 4000, **{f"label{k}": 2 for k in range(1000)}}
    assert langid.shares_of_room(sizes, 8000) == 3000 and langid.shares_of_room(sizes, 20_000) == 20_000


# --- quality rules ----------------------------------------------------------


def brute_counts(text):
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_counts(spark, odd, none):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "d#\t", "é ", "|", "the ", "\n", "same words once more in a row again\n"]) for _ in range(rng.randrange(90))) for _ in range(150)]
    for df in (frame(spark, texts), odd):
        rows = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(df).collect()}
        for r in df.collect():
            want = brute_counts(r.text or "")
            got = rows[r.doc_id, want[0]]
            assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed) == want
            assert not (got.base_failed and got.kept)
    assert quality_rules.quality_rules(none).collect() == []


def test_divergent_documents_fall(spark):
    good = [prose("en", s, 150) for s in range(60)]
    bad = [" ".join(w + "###" for w in prose("en", 99, 150).split()), " | ".join(f"zq{k}xx" for k in range(150))]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, good + bad)).collect()}
    assert all(got[i] for i in range(60)) and not got[60] and not got[61]


def test_rare_languages_have_their_own_reference(spark):
    rng, arabic = random.Random(5), "الماء في هذا النهر القديم يجري فوق الحجارة وتحت الجسر الطويل حيث يلعب الأطفال".split()
    rare = [" ".join(rng.choice(arabic) for _ in range(150)) for _ in range(21)]
    texts = [prose("en", s, 20_000) for s in range(170)] + rare + [rare[0], rare[1], " ".join(w + "###" for w in rare[2].split())]
    langs = ["en"] * 170 + ["ar"] * 21 + [None, "fa", "ar"]
    df = frame(spark, texts, langs)
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert len(got) == len(texts) and 1000 * 22 * 150 < 170 * 20_000
    assert all(got[i].kept and got[i].class_distance is not None and got[i].word_distance is not None for i in range(170, 191))
    assert all(got[i].kept and got[i].class_distance is None and got[i].word_distance is None for i in (191, 192))
    assert not got[193].kept


def test_distance_is_jensen_shannon(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    half = lambda x: sum(a * np.log2(a / c) for a, c in zip(x, m) if a) / 2
    row = spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()
    assert abs(row.d - np.sqrt(half(p) + half(q))) < 1e-12


# --- sharding ---------------------------------------------------------------


def test_shards(spark, odd, none):
    rng = random.Random(6)
    texts = [prose("en", s, rng.randrange(1, 80)) for s in range(800)] + ["copy of one text"] * 400
    rows = sharding.shard_rows(frame(spark, texts), 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1200))
    load, slots, rows_of = Counter(), defaultdict(list), Counter()
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 8
        load[r.shard] += r["size"]
        rows_of[r.shard] += 1
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert max(load.values()) < 1.03 * min(load.values()) and max(rows_of.values()) < 1.2 * min(rows_of.values())
    odd_rows = sharding.shard_rows(odd, 4).collect()
    assert len(odd_rows) == odd.count() and all(r["size"] >= 8 for r in odd_rows)
    assert sharding.shard_rows(none, 4).collect() == []


def test_packing_prefers_matching_room():
    sizes = np.array([[8.0, 1, 1], [1, 8, 1], [1, 1, 8], [8, 1, 1], [1, 8, 1], [1, 1, 8]])
    at = sharding.pack(sizes, 2)
    assert [at[k] != at[k + 3] for k in range(3)] == [True] * 3


# --- mixing -----------------------------------------------------------------


def brute_fill(children, budget):
    """Water-filling by trying every number of filled children; children: (supply, weight) in order of supply over weight."""
    left, weight, out = budget, sum(w for _, w in children), []
    for k, (s, w) in enumerate(children):
        if s * weight <= w * left:
            out.append(s)
            left, weight = left - s, weight - w
        else:
            return out + [w2 * left // weight for _, w2 in children[k:]]
    return out


def test_budgets_and_prefixes(spark, odd, none):
    rng = random.Random(8)
    texts = [prose("en", s, rng.randrange(1, 40)) for s in range(300)]
    df = frame(spark, texts, [rng.choice(["en", "de", None]) for _ in texts], [rng.choice(["src0", "src1", "src7", "src12", None]) for _ in texts])
    weights = {"lang": {"en": 3}, "source": {"src0": 5}}
    got = mixing.mix(df, {"lang": F.col("lang"), "source": F.col("source")}, weights, 70, 2, 1).collect()
    leaves = defaultdict(list)
    for r in got:
        leaves[r.lang, r.source].append(r)
    total = sum(r.tokens for r in got)
    supply = {k: 2 * sum(r.tokens for r in v) for k, v in leaves.items()}
    order = lambda items: sorted(items, key=lambda x: (x[1] / x[2], x[0]))
    langs = order([(lang, sum(s for k, s in supply.items() if k[0] == lang), weights["lang"].get(lang, 1)) for lang in {k[0] for k in supply}])
    for (lang, _, _), budget in zip(langs, brute_fill([x[1:] for x in langs], total * 70 // 100)):
        own = order([(k[1], s, weights["source"].get(k[1], 1)) for k, s in supply.items() if k[0] == lang])
        for (source, _, _), part in zip(own, brute_fill([x[1:] for x in own], budget)):
            rows = leaves[lang, source]
            assert {r.leaf_budget for r in rows} == {part}
            epochs, rest = divmod(part, sum(r.tokens for r in rows))
            upto = 0
            for r in sorted(rows, key=lambda r: (hashlib.md5(f"1|{epochs}|{r.doc_id}".encode()).hexdigest(), r.doc_id)):
                upto += r.tokens
                assert r.copies == epochs + (upto <= rest and rest > 0 and epochs < 2)
    assert len(mixing.mix(odd, mixing.source_tree(), mixing.TREE_WEIGHTS, 50).collect()) == odd.count()
    assert mixing.mix(none, mixing.source_tree(), mixing.TREE_WEIGHTS, 50).collect() == []


# --- toxicity and quality classifiers ---------------------------------------


def labelled(spark, n=400):
    rng, texts, rows = random.Random(12), [], []
    for i in range(n):
        words = prose("en", i, 50).split()
        toxic = rng.random() < 0.3
        for _ in range(rng.randrange(1, 8) if toxic else 0):
            words[rng.randrange(50)] = rng.choice(["blighter", "rotter", "cadder"])
        good = rng.random() < 0.8
        texts.append(" ".join(words) if good else " ".join(w + "%%#" for w in words))
        rows.append((i, int(good), int(toxic)))
    return frame(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd, none):
    docs, labels = labelled(spark)
    learn, held = labels.where("doc_id < 300"), {r.doc_id: r.toxic for r in labels.where("doc_id >= 300").collect()}
    model = toxicity.train(docs, learn)
    assert (np.diff(model.ordinal.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.severities(docs, model).collect()}
    assert sum(got[i].toxic == bool(y) for i, y in held.items()) >= 0.97 * len(held)
    assert all(0 <= r.severity <= toxicity.GRADES - 1 and 0 <= r.score <= 1 for r in got.values())
    assert all(not r.toxic for r in toxicity.severities(odd, model).collect())
    assert toxicity.severities(none, model).collect() == []
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert {(r.severity, r.toxic) for r in toxicity.severities(odd, None).collect()} == {(0.0, False)}


def test_rare_labels_are_seen(spark):
    rng, texts, rows = random.Random(5), [], []
    for i in range(3000):
        words, toxic = prose("en", i, 40).split(), i % 300 == 7
        for _ in range(6 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["blighter", "rotter", "cadder"])
        texts.append(" ".join(words))
        rows.append((i, int(toxic)))
    docs, labels = frame(spark, texts), spark.createDataFrame(rows, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, rows=100)
    assert model.tilt == pytest.approx((90 / 2990) / 1)
    got = {r.doc_id: r for r in toxicity.severities(docs, model).collect()}
    assert sum(got[i].toxic for i, y in rows if y) == 10 and sum(got[i].toxic for i, y in rows if not y) <= 3
    assert sum(r.score for r in got.values()) < 100  # chances are those of all rows, not of the sample
    with pytest.warns(UserWarning, match="no model"):
        assert toxicity.train(docs, labels.where("toxic = 0")) is None
    with pytest.warns(UserWarning, match="0 toxic rows among 0"):
        assert toxicity.train(docs, labels.where("doc_id < 0")) is None


def test_samples_are_shared_by_class():
    assert toxicity.sample_sizes(2990, 10, 100) == (90, 10) and toxicity.sample_sizes(10, 2990, 100) == (10, 90)
    assert toxicity.sample_sizes(500, 500, 100) == (50, 50) and toxicity.sample_sizes(30, 20, 100) == (30, 20) and toxicity.sample_sizes(0, 0, 100) == (0, 0)


def test_ordinal_fit_equals_a_plain_maximum():
    """Against the likelihood written out and climbed by finite differences."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    grade = (x @ [1.5, -1.0] + rng.logistic(size=300) > np.array([[0.0], [1.0], [2.0]])).sum(axis=0)
    row, col = np.repeat(np.arange(300), 2), np.tile(np.arange(2), 300)
    got = toxicity.fit_ordinal(row, col, x.ravel(), grade, 2, steps=3000, ridge=0.01, pace=0.02)

    def loss(v):
        theta = np.concatenate([[-np.inf], v[2:], [np.inf]])
        cut = lambda t: 1 / (1 + np.exp(-(t - x @ v[:2])))
        return -np.log(cut(theta[grade + 1]) - cut(theta[grade])).mean() + 0.005 * (v[:2] ** 2).sum()

    best = np.concatenate([got.weights, got.thresholds])
    for k in range(5):  # no direction leads down from the fit
        for step in (0.01, -0.01):
            assert loss(best + step * np.eye(5)[k]) > loss(best) - 1e-7
    assert np.abs([(loss(best + 1e-5 * e) - loss(best - 1e-5 * e)) / 2e-5 for e in np.eye(5)]).max() < 1e-3


def test_ordinal_gradient_finds_the_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    grade = (x[:, None] * 2 + rng.logistic(size=(4000, 1)) > np.array([[0.0, 1.5, 3.0]])).sum(axis=1)
    fit = toxicity.fit_ordinal(np.arange(4000), np.zeros(4000, np.int64), x, grade, 1, ridge=0)
    assert abs(fit.weights[0] - 2) < 0.15 and np.allclose(fit.thresholds, [0, 1.5, 3], atol=0.2)


def test_quality_classifier(spark, odd, none):
    docs, labels = labelled(spark)
    learn, held = labels.where("doc_id < 200"), {r.doc_id: r.quality for r in labels.where("doc_id >= 200").collect()}
    got = {r.doc_id: r for r in quality_classifier.classify(docs, learn).collect()}
    assert sum(got[i].kept == bool(y) for i, y in held.items()) >= 0.97 * len(held)
    scores = quality_classifier.classify(docs.unionByName(odd.select(docs.columns)), learn).collect()
    assert len(scores) == 400 + odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality_classifier.classify(none, learn).collect() == []
    assert {(r.score, r.kept) for r in quality_classifier.classify(odd, learn.where("quality = 1")).collect()} == {(None, True)}


def test_views_exchange_labels():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400).astype(float)
    view = lambda labels: labels[:, None] * 4 + rng.normal(size=(len(labels), 2))
    hidden = rng.integers(0, 2, 2000).astype(float)
    model = quality_classifier.co_train([view(y), view(y)], y, [view(hidden), view(hidden)])
    assert min(model.exchanged[0]) > 100
