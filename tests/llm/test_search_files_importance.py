"""Lexical search, token files and importance resampling against SQL, the public library and plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.helpers import DOCS, against_sql, frame, saved
from tests.llm.test_operators import odd_texts, prose
from vigitab.llm import importance, lexical_search, token_files
from vigitab.llm.bpe import default_vocabulary
from vigitab.llm.common import TEXT_PART, term_lists

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def mixed_texts():
    """Odd texts and texts of several lines, with copies, shared lines and capitals."""
    rng = random.Random(5)
    lines = [prose("en", k, 6 + k % 5) for k in range(12)] + ["", " ", "ÉTÉ Élan 12x", "..."]
    return [*odd_texts(), *("\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) for _ in range(60)), "Water\nWATER\r\nwater", "\n\n"]


@pytest.fixture(scope="module")
def mixed(spark):
    texts = mixed_texts()
    ids = [*range(len(texts) - 3), 3, 3, None]
    return frame(spark, texts, ids=ids).withColumns({c: F.lit(7) for c in ("row", "n", "terms", "times", "at", "score", "rank", "block", "digest", "part", "place", "frames")}).cache()


@pytest.fixture(scope="module")
def items(spark):
    rows = [(k % 9, prose("en", k, 5 + k)) for k in range(14)] + [(3, None), (20, ""), (21, "water"), (21, "water"), (22, "unheardof"), (None, "the Water"), (23, prose("de", 1, 2000))]
    return spark.createDataFrame(rows, ITEMS).withColumns({c: F.lit("x") for c in ("term", "times", "block", "doc_id", "kind", "parts")})


def test_terms():
    text = "aB9é\x00Z-z_" * 5
    assert [t.decode() for part in term_lists(text.encode()) for t in part] == terms(text)
    long = ("wort éa " * (TEXT_PART // 4)) + "x" * (TEXT_PART * 2)
    assert [t.decode() for part in term_lists(long.encode()) for t in part] == terms(long)
    assert list(term_lists(b"")) == []


# --- lexical search ---------------------------------------------------------


def brute_search(docs, items, top=20):
    """Ranked rows of plain sums, item by item."""
    counts = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in {i for i, _ in items}:
        query = Counter(t for text in {x for i, x in items if i == item} for t in terms(text))
        scored = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in query.items() if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        out += [(item, k + 1, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_search_equals_plain_sums(mixed, items):
    docs = [(r.doc_id, r.text) for r in mixed.collect()]
    want = brute_search(docs, [(r.item_id, r.text) for r in items.collect()])
    assert found(lexical_search.search(mixed, items)) == want and {20, 22}.isdisjoint({r[0] for r in want}) and None in {r[0] for r in want}
    assert found(lexical_search.search(mixed, items, top=2)) == [r for r in want if r[1] <= 2]


def test_search_in_blocks_and_small_steps(mixed, items, monkeypatch):
    want = found(lexical_search.search(mixed, items))
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 20)
    assert items.transform(lexical_search.item_terms).select("block").distinct().count() > 3
    assert found(lexical_search.search(mixed, items)) == want
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 1 << 16)
    monkeypatch.setattr(lexical_search, "CELLS", 1)  # a document at a time
    assert found(lexical_search.search(mixed, items)) == want


def test_search_of_empty_tables(spark, mixed, items):
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    for df in (lexical_search.search(none, items), lexical_search.search(mixed, nothing), lexical_search.search(none, nothing)):
        assert df.collect() == [] and df.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(lexical_search.search(frame(spark, [None, "", "--"]), items)) == []


@pytest.mark.parametrize("mined", [2, 64])
def test_plan_gives_every_item_its_terms(monkeypatch, mined):
    monkeypatch.setattr(lexical_search, "MINED", mined)
    rng = random.Random(1)
    common = [rng.sample(range(40), 12) for _ in range(3)]
    entries = {}
    for item in range(30):
        for t in {*common[item % 3], *rng.sample(range(40, 200), 6)}:
            entries[item, t] = rng.choice([1, 1, 1, 2, 5])
    sums, pairs, own = lexical_search.sharing_plan([(i, t, n) for (i, t), n in entries.items()])
    value = [Counter(dict(s)) for s in sums]
    for a, b in pairs:
        assert max(a, b) < len(value)
        value.append(value[a] + value[b])
    assert {i: sum((value[k] for k in parts), Counter()) for i, parts in own.items()} == {i: Counter({t: n for (j, t), n in entries.items() if j == i}) for i in range(30)}
    additions = sum(len(s) - 1 for s in sums) + len(pairs) + sum(len(p) - 1 for p in own.values())
    assert pairs and additions < len(entries) - 30


def test_search_sql_on_odd_rows(spark, tmp_path):
    path = saved(spark, frame(spark, mixed_texts()), tmp_path)
    spark.createDataFrame([(k, prose("en", k, 9)) for k in range(8)] + [(90, None), (91, "")], ITEMS).write.parquet(f"{path}/benchmark.parquet")
    assert against_sql(spark, path, "op11_lexical_search") is None


# --- token files ------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def expected_ids(library, rows):
    """Documents in file order with their start and ids."""
    coded = sorted(((d is not None, d or 0, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows), key=lambda r: (r[0], r[1], len(r[2])))
    at, out = 0, []
    for known, d, ids in coded:
        out.append((d if known else None, at, len(ids), ids))
        at += len(ids)
    return out


def test_files_hold_the_library_ids(spark, mixed, library, tmp_path):
    want = expected_ids(library, [(r.doc_id, r.text) for r in mixed.collect()])
    files = token_files.write_files(mixed, default_vocabulary(), str(tmp_path / "a"), file_bytes=4000)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_checks(files).orderBy("start").collect()]
    sums = [(d, at, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, at, n, ids in want]
    assert [g[:3] for g in got] == [s[:3] for s in sums] and sorted((g[0] or -1, g[3]) for g in got) == sorted((s[0] or -1, s[3]) for s in sums)
    manifest = files.orderBy("part", "seq").collect()
    assert len(manifest) > 4 and sum(f.documents for f in manifest) == len(want)
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f.file, "rb"), read_across_frames=True).read() for f in manifest)
    assert len(plain) == 2 * sum(f.ids for f in manifest) and np.frombuffer(plain, "<u2").tolist().count(0) >= len(want)

    wanted = spark.createDataFrame([(5,), (3,), (5,), (None,), (10**6,)], "doc_id long")
    asked = {(r.doc_id, tuple(r.ids)) for r in token_files.fetch(files, wanted).collect()}
    assert asked == {(d, tuple(ids)) for d, _, _, ids in want if d in (5, 3, None)}


def test_reader_touches_only_the_asked_frames(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 10)
    writer = token_files.FrameWriter(str(tmp_path / "f.zst"), 4)
    compressor = zstandard.ZstdCompressor(write_checksum=True)
    docs = [np.arange(n, dtype="<u4") * 70_000 % 99_991 for n in (3, 25, 0, 1000, 7)]
    for k, ids in enumerate(docs):
        writer.add(None if k == 1 else k, len(ids), token_files.frames_of(ids.tobytes(), 4, compressor))
    writer.close()
    assert writer.documents[1][-1] == 3 and not (tmp_path / "f.zst.open").exists()
    reader = token_files.FrameReader(str(tmp_path / "f.zst"))
    assert reader.documents["known"].tolist() == [1, 0, 1, 1, 1]
    read = []
    monkeypatch.setattr(reader, "_at", lambda start, length, f=reader._at: read.append(length) or f(start, length))
    assert [reader.ids(p).tolist() for p in (3, 0, 1, 2, 4)] == [docs[p].tolist() for p in (3, 0, 1, 2, 4)]
    assert sum(read[:2]) <= sum(int(reader.entries["packed"][k]) for k in range(len(reader.entries))) and len(read) <= 5
    raw = bytearray((tmp_path / "f.zst").read_bytes())
    first = int(reader.entries["packed"][0])
    raw[first + int(reader.entries["packed"][1]) - 3] ^= 1
    (tmp_path / "g.zst").write_bytes(raw)
    broken = token_files.FrameReader(str(tmp_path / "g.zst"))
    assert broken.ids(0).tolist() == docs[0].tolist()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.ids(1)
    with pytest.raises(ValueError):
        (tmp_path / "h.zst").write_bytes(bytes(raw[:-4]) + b"zstd")
        token_files.FrameReader(str(tmp_path / "h.zst"))


def test_encoder_equals_library(library):
    spec = open(default_vocabulary(), encoding="utf-8").read()
    encoder = token_files.Encoder(spec)
    rng = random.Random(3)
    texts = [t or "" for t in mixed_texts()] + ["".join(rng.choice(" \n\t\x1c\x85 'sabé9�🙂-—٣") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["x<|endoftext|>'ll  y"]
    assert [np.frombuffer(i, encoder.kind).tolist() for i in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.held = 1 << 40
    assert np.frombuffer(encoder.encode(["neverseen words"])[0], encoder.kind).tolist() == library.encode("neverseen words", add_special_tokens=False).ids and not encoder.known


def test_files_of_an_empty_table(spark, tmp_path):
    files = token_files.write_files(spark.createDataFrame([], DOCS), default_vocabulary(), str(tmp_path))
    assert files.collect() == [] and token_files.read_checks(files).collect() == []
    assert token_files.fetch(files, spark.range(3).toDF("doc_id")).collect() == []


# --- importance resampling --------------------------------------------------


def brute_importance(docs, target, percent, least, grams, buckets, seed):
    def features(text):
        words = terms(text)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(words) - n + 1)]

    own = [(d, *features(t)) for d, t in docs]
    s, t = (Counter(b for f in side for b in f) for side in ([f for _, _, f in own], [features(x)[1] for x in target]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, words, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    drawn = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize(("grams", "percent", "least", "buckets"), [(1, 10, 20, 10_000), (1, 100, 0, 7), (2, 50, 3, 50), (3, 60, 1, 1000)])
def test_importance(spark, mixed, grams, percent, least, buckets):
    aims = ["the water of", "stones\nand under\nthe\n\nlong bridge", None, "été"]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(aims)], ITEMS)
    got = importance.resample(mixed, target, percent, least, grams, buckets, 2024)
    want = brute_importance([(r.doc_id, r.text) for r in mixed.collect()], aims, percent, least, grams, buckets, 2024)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == want


def test_importance_of_copies_and_hot_lines(spark):
    texts = ["same line of many words here\n" * 3] * 300 + [f"same line of many words here\nown {k} line" for k in range(200)]
    docs = frame(spark, texts, ids=[0] * 150 + list(range(150, 500)))
    want = brute_importance(list(zip([0] * 150 + list(range(150, 500)), texts)), ["own line"], 10, 5, 1, 100, 1)
    got = importance.resample(docs, spark.createDataFrame([(1, "own line")], ITEMS), 10, 5, 1, 100, 1).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51))


def test_importance_of_empty_tables(spark, mixed):
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert importance.resample(none, nothing).collect() == []
    assert importance.resample(mixed, nothing).count() == mixed.count()


def test_lines_are_counted_once(spark):
    docs = frame(spark, ["a b\nc", "a b\n\na b", None, "--\nc"])
    lines = importance.line_features(docs.select("text"), 2, 10**6)
    want = {(2, 3, 3): 1, (1, 2, 1): 1}  # words, occurrences, features
    assert Counter((r.words, r.times, len(r.buckets)) for r in lines.collect()) == want
    assert importance.crossing_buckets(b"a b\nc\n\nd e f", 3, 10**9).tolist() == [zlib.crc32(x) % 10**9 for x in (b"b c", b"c d", b"a b c", b"b c d", b"c d e")]
