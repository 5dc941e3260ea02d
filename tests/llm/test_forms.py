"""BPE, JPEG, shards, WARC and SimHash: exact round trips and brute force."""

import hashlib
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalyn.llm import bpe, common, jpeg, queries, shards, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
needs_vocabulary = pytest.mark.skipif(not Path(queries.VOCABULARY).exists(), reason="the vocabulary is not here")
ODD = ["", "a", "<|endoftext|>x <|startoftext|>", "Ünï “q” it's we'll 123 ½ ²", "日本語 テスト ΑΣ Σίγμα", "a" * 21, "\x00\x01 \x85 \xa0 ​ x́ é", "😀😀👍🏽 Ǆ ﬁ İI", "<|endoftext|", "...!!! ---- ab--cd", "K Å", "ha" * 10, "\x1c\x1d a", "x" * 3000]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    return ODD + ["".join(r.choice("abcdeéñ thinanerINTH!.'0123\n") for _ in range(200)) for _ in range(200)]


@needs_vocabulary
def test_encoding_is_the_librarys(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    t = bpe.Tokenizer(bpe.read_vocabulary(queries.VOCABULARY))
    for x in texts:
        want = lib.encode(x, add_special_tokens=False).ids
        assert t.encode(x) == want and t.decode(want) == lib.decode(want, skip_special_tokens=False), x
    docs = spark.createDataFrame([(i, x, None, "s", 0) for i, x in enumerate(texts)] + [(None, None, None, None, None)], DOCS).withColumn("ids", F.lit("taken"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.digest(docs, queries.VOCABULARY).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids if r.doc_id is not None else []
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    back = bpe.decode(bpe.encode(docs.drop("ids").where("doc_id = 3"), queries.VOCABULARY), queries.VOCABULARY).first()
    assert back.decoded == lib.decode(back.ids, skip_special_tokens=False)
    assert bpe.digest(docs.limit(0), queries.VOCABULARY).count() == 0


@needs_vocabulary
def test_other_spellings_of_special_tokens_are_plain_text():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    t = bpe.Tokenizer(bpe.read_vocabulary(queries.VOCABULARY))
    for x in ("a <|ENDOFTEXT|> b", "<|EndOfText|>", "<|endoftext|> <|ENDOFTEXT|><|startoftext|> <|StartOfText|>", "日本 <|ENDOFTEXT|> é", "<|EndOfText|><|endoftext|>x"):
        want = lib.encode(x, add_special_tokens=False).ids
        assert t.encode(x) == want, x


def test_production_parameters_of_shards():
    assert (shards.LENGTH, shards.PER_SHARD) == (512, 16384)


@needs_vocabulary
def test_every_token_encodes_to_itself(monkeypatch):
    t = bpe.Tokenizer(bpe.read_vocabulary(queries.VOCABULARY))
    assert all(t.whole(i) for i in range(49406))
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    small, x = bpe.Tokenizer(t.source), "many different words that do not fit the table at all"
    assert small.encode(x) == t.encode(x)


@needs_vocabulary
def test_blocks_groups_and_single_words_give_the_same_ids(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    lib, source = tokenizers.Tokenizer.from_file(queries.VOCABULARY), bpe.read_vocabulary(queries.VOCABULARY)
    r = random.Random(3)
    word = lambda: "".join(r.choice(["the", "ing", "qu", "é", "x", "tion", "'s", "7", "½", "!?", "zz"]) for _ in range(r.randint(1, 9)))
    many = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(400)]
    long = ["z" * 20_000, "ab" * 3_000 + " the", " ".join(word() for _ in range(40_000)), "日本 " * 5_000 + "<|endoftext|>", "a\xa0b " * 9_000, ("x" * 70 + "\n") * 400]
    want = [e.ids for e in lib.encode_batch(many + long, add_special_tokens=False)]
    for block, few in ((8 << 20, 48), (4096, 1), (1 << 14, 10**9)):
        monkeypatch.setattr(bpe, "BLOCK", block)
        monkeypatch.setattr(bpe, "FEW", few)
        t = bpe.Tokenizer(source)
        assert [np.concatenate(x).tolist() for x in t.texts(pa.array(many + long))] == want


@needs_vocabulary
def test_counting_puts_no_ids_together(texts, monkeypatch):
    t = bpe.Tokenizer(bpe.read_vocabulary(queries.VOCABULARY))
    many = [*texts, None, "", "z" * 9_000 + " the" * 3_000, "日本 " * 3_000 + "<|endoftext|>"]
    want = [len(t.encode(x)) for x in many]
    monkeypatch.setattr(bpe, "BLOCK", 4096)
    monkeypatch.setattr(bpe.Tokenizer, "encode_block", lambda *_: pytest.fail("ids were put together"))
    assert t.counts(pa.array(many)).tolist() == want and t.counts(pa.array([], pa.string())).tolist() == []


@needs_vocabulary
def test_words_that_begin_alike_are_looked_at_once(monkeypatch):
    t, r, looked = bpe.Tokenizer(bpe.read_vocabulary(queries.VOCABULARY)), random.Random(4), []
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(3_000)})
    r.shuffle(words)
    given = bpe.Tokenizer._next_state
    monkeypatch.setattr(bpe.Tokenizer, "_next_state", lambda self, at, s: looked.append(len(s)) or given(self, at, s))
    assert [np.concatenate(x).tolist() for x in t.texts(pa.array(words))] == [t.encode_symbols([*(t._byte[b][0] for b in w[:-1].encode()), t._byte[ord(w[-1])][1]]) for w in words]
    assert sum(looked) == len({w[:i] for w in words for i in range(1, len(w))}) + len(words)  # a word's end is a sign of its own


@needs_vocabulary
def test_a_full_table_keeps_the_words_at_hand(monkeypatch):
    t, learnt = bpe.Tokenizer(bpe.read_vocabulary(queries.VOCABULARY)), []
    first, second = "one two three four", "four five three six"
    want = [t.encode(x) for x in (first, second, first)]
    t._forget()
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    given = bpe.Tokenizer._encode_words
    monkeypatch.setattr(bpe.Tokenizer, "_encode_words", lambda self, words: learnt.append(sorted(words.to_pylist())) or given(self, words))
    assert [t.encode(x) for x in (first, second, first)] == want
    assert learnt == [["four", "one", "three", "two"], ["five", "six"], ["one", "two"]] and len(t.known) == 4


@needs_vocabulary
def test_encoding_keeps_columns_and_mends_bytes(spark, monkeypatch):
    docs = spark.sql("select 1 doc_id, 'the cat' text, 2 _text, 3 `_text_`, 4 TEXT_, 5 _ids union all select 2, cast(x'74686520ff636174' as string), 6, 7, 8, 9")
    got = bpe.decode(bpe.encode(docs, queries.VOCABULARY), queries.VOCABULARY).orderBy("doc_id").collect()
    t = bpe.Tokenizer(bpe.read_vocabulary(queries.VOCABULARY))
    assert [tuple(r[c] for c in ("_text", "_text_", "TEXT_", "_ids")) for r in got] == [(2, 3, 4, 5), (6, 7, 8, 9)]
    assert [r.ids for r in got] == [t.encode("the cat"), t.encode("the \ufffdcat")] and got[0].decoded == "the</w> cat</w>"
    assert bpe.digest(docs, queries.VOCABULARY).count() == 2 and shards.round_trip(docs, queries.VOCABULARY).count() == 2


def slow_slot(i, n, key):
    """The keyed Feistel permutation with cycle-walking, one index at a time."""
    half, full = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2), (1 << 64) - 1

    def mixed(x, k):
        x = ((x ^ (k & full)) * 0x9E3779B97F4A7C15) & full
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & full
        return x ^ (x >> 32)

    while True:
        left, right = i >> half, i & ((1 << half) - 1)
        for r in range(4):
            left, right = right, left ^ (mixed(right, key + 0x1000003 * (r + 1)) & ((1 << half) - 1))
        i = left << half | right
        if i < n:
            return i


@needs_vocabulary
def test_shards_hold_the_bytes_of_a_slow_writer(spark):
    r, t = random.Random(9), bpe.Tokenizer(bpe.read_vocabulary(queries.VOCABULARY))
    rows = [(i if i % 9 else None, " ".join(r.choice(["the", "cat", "sat", "é"]) for _ in range(r.choice([0, 1, 16, 17, 100]))), None, "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1).checkpoint()
    length, per_shard, key = 16, 7, 12345
    manifest = sorted(shards.materialise(docs, queries.VOCABULARY, key, length, per_shard).collect(), key=lambda m: m.shard)
    records = []
    for doc_id, text, *_ in rows:
        ids = t.encode(text)
        for chunk, at in enumerate(range(0, len(ids), length)):
            piece = ids[at : at + length]
            records.append(struct.pack("<qii", -(1 << 63) if doc_id is None else doc_id, chunk, len(piece)) + struct.pack(f"<{length}H", *piece, *[0] * (length - len(piece))))
    placed = {slow_slot(i, len(records), key): x for i, x in enumerate(records)}
    assert sorted(placed) == list(range(len(records)))
    assert [(m.shard, m.first_slot, m.n) for m in manifest] == [(s, s * per_shard, min(per_shard, len(records) - s * per_shard)) for s in range(-(-len(records) // per_shard))]
    for m in manifest:
        raw = Path(m.file.removeprefix("file:")).read_bytes()
        assert raw == b"".join(placed[m.first_slot + i] for i in range(m.n)) and hashlib.sha256(raw).hexdigest() == m.sha256


@pytest.mark.parametrize("n", [64, 128, 384, 385 * 64, 64 * 4095 * 6 + 64])
def test_payloads_come_back(n):
    p = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    image = jpeg.read(jpeg.store(p))
    assert jpeg.payload_of(image) == p and jpeg.tensor(image).shape == (image.height, image.width, 3)


def test_digest_of_media(spark):
    texts = [None, "", "é" * 40, "abc" * 5000, "abc" * 5000]
    docs = spark.createDataFrame([(i, x, None, "s", 0) for i, x in enumerate(texts)], DOCS).withColumn("feature", F.lit(1))
    rows = {r.doc_id: r for r in jpeg.digest(docs).collect()}
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[3][1:] == rows[4][1:] and rows[0][1:] == rows[1][1:] and jpeg.digest(docs.limit(0)).count() == 0


def slow_progressive(blocks, across, down, script):
    """A plain progressive encoder of one grey component, code by code: (first, last, high, low) a scan."""
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + bytes([2]) * 64), jpeg._segment(0xC2, b"\x08" + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + b"\x01\x01\x11\x00")]
    size = lambda x: abs(x).bit_length()
    cut = lambda x, low: (abs(x) >> low) * (1 if x > 0 else -1)
    for first, last, high, low in script:
        marks = []  # (symbol or None, extra bits)
        bits_of = lambda x, n: [(x >> (n - 1 - i)) & 1 for i in range(n)]
        extra = lambda x: bits_of(x if x > 0 else x + (1 << size(x)) - 1, size(x))
        if first == 0 and not high:
            prev = 0
            for b in blocks:
                v = int(b[0]) >> low
                marks.append((size(v - prev), extra(v - prev) if v != prev else []))
                prev = v
        elif first == 0:
            marks = [(None, [(int(b[0]) >> low) & 1]) for b in blocks]
        else:
            run, held = 0, []

            def flush():
                nonlocal run, held
                if run:
                    r = run.bit_length() - 1
                    marks.append((r << 4, bits_of(run - (1 << r), r) + held))
                    run, held = 0, []

            for b in blocks:
                v = [cut(int(x), low) for x in b]
                new = [k for k in range(first, last + 1) if v[k] and (not high or abs(v[k]) == 1)]
                zeros, fix = 0, []
                end = new[-1] if new else first - 1
                for k in range(first, last + 1):
                    known = high and abs(v[k]) > 1
                    if known:
                        fix.append(abs(v[k]) & 1)
                        continue
                    if not v[k]:
                        if k > end:
                            continue
                        if zeros == 15:
                            flush()
                            marks.append((0xF0, fix))
                            zeros, fix = 0, []
                            # the sixteenth zero is this one
                            continue
                        zeros += 1
                        continue
                    flush()
                    marks.append((zeros << 4 | (1 if high else size(v[k])), ([1 if v[k] > 0 else 0] if high else extra(v[k])) + fix))
                    zeros, fix = 0, []
                if end < last:
                    run += 1
                    held += fix
                    if run == 0x7FFF:
                        flush()
            flush()
        symbols = sorted({s for s, _ in marks if s is not None})
        if symbols:
            table = symbols + [s for s in range(256) if s not in symbols][: max(0, 2 - len(symbols))]  # never a table of one
            out.append(jpeg._table(0 if first == 0 else 1, 0, table))
            n = len(table).bit_length()
        stream = [x for s, e in marks for x in ((bits_of(table.index(s), n) if s is not None else []) + e)]
        out += [jpeg._scan([1], 0, first, last, high, low), jpeg._entropy(np.array(stream, np.uint8))]
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_any_progressive_scan_is_accumulated(seed):
    r = np.random.default_rng(seed)
    blocks = np.where(r.random((12, 64)) < (0.05, 0.3, 0.8)[seed], r.integers(-60, 61, (12, 64)), 0)
    blocks[:, 0] = r.integers(-200, 200, 12)
    blocks[5:8, 1:] = 0
    script = [(0, 0, 0, 1), (1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
    image = jpeg.read(slow_progressive(blocks, 4, 3, script))
    assert (image.components[0].coefficients == blocks).all()
    want = np.zeros((24, 32))
    c = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    for i, b in enumerate(blocks):
        f = np.zeros(64)
        f[jpeg.ZIGZAG] = b * 2
        want[i // 4 * 8 : i // 4 * 8 + 8, i % 4 * 8 : i % 4 * 8 + 8] = c @ f.reshape(8, 8) @ c.T
    assert np.abs(jpeg.tensor(image)[:, :, 0].astype(int) - np.clip(want + 128, 0, 255)).max() <= 1


@pytest.mark.parametrize("n", [64, 640, 64 * 61])
def test_colours_are_those_of_the_definition(n):
    """Inverse cosine transform by its sums, chroma of the block it belongs to, and colours in floating point."""
    image = jpeg.read(jpeg.store(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()))
    assert [(c.h, c.v) for c in image.components] == [(2, 2), (1, 1), (1, 1)]
    basis = [[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]

    def sample(c, y, x):
        block = c.coefficients[(y // 8) * c.blocks_x + x // 8] * image.tables[c.table]
        total = sum(block[i] * basis[jpeg.ZIGZAG[i] // 8][y % 8] * basis[jpeg.ZIGZAG[i] % 8][x % 8] for i in range(64))
        return min(255, max(0, int(np.floor(total + 0.5)) + 128))

    got, r, off = jpeg.tensor(image).astype(int), np.random.default_rng(1), []
    assert got.shape == (image.height, image.width, 3)
    for y, x in zip(r.integers(0, image.height, 150).tolist(), r.integers(0, image.width, 150).tolist()):
        luma, cb, cr = (sample(c, y * c.v // 2, x * c.h // 2) for c in image.components)
        want = (luma + 1.402 * (cr - 128), luma - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), luma + 1.772 * (cb - 128))
        off += [abs(g - min(255, max(0, w))) for g, w in zip(got[y, x], want)]
    # a sample near a half may round to the other side in whole numbers, which moves a colour by one, or by 1.8 from chroma
    assert max(off) <= 3.3 and np.mean(np.array(off) > 1.01) < 0.05


def test_broken_media_keep_their_row(spark):
    ok = jpeg.store(b"x" * 64)
    df = spark.createDataFrame([(1, ok), (2, b"no"), (3, None), (4, ok[:200])], "id int, content binary").withColumns({c: F.lit(c) for c in ("_raw", "row", "value", "a.b", "rgb")})
    assert jpeg.decode(df).select("_raw", "row", "value", "`a.b`").distinct().collect() == [("_raw", "row", "value", "a.b")]
    rows = {r.id: r for r in jpeg.decode(df).collect()}
    assert len(rows[1].rgb) == rows[1].height * rows[1].width * 3 and rows[1].error is None
    assert all(rows[i].rgb is None and rows[i].error for i in (2, 3))


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 5, 100, 4097):
        slots = shards.permute(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
    assert shards.permute(np.arange(100), 100).tolist() != shards.permute(np.arange(100), 100, 5).tolist()


@needs_vocabulary
def test_shards_read_back_and_resume(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "cat", "sat"]) for _ in range(r.choice([0, 3, 600, 1500]))), None, "s", 0) for i in range(40)] + [(None, "a b", None, "s", 0), (99, None, None, "s", 0), (5, "same id", None, "s", 0)]
    docs, t = spark.createDataFrame(rows, DOCS), bpe.Tokenizer(bpe.read_vocabulary(queries.VOCABULARY))
    manifest = shards.materialise(docs, queries.VOCABULARY)
    back = shards.read_shards(manifest).collect()
    assert sorted(x.slot for x in back) == list(range(len(back)))
    parts = {}
    for x in sorted(back, key=lambda x: x.chunk):
        parts.setdefault(x.doc_id, []).append(np.frombuffer(x.ids, "<u2").tolist())
    for doc_id, text, *_ in rows:
        if doc_id != 5 and t.encode(text):
            assert sum(parts[doc_id], []) == t.encode(text)
    assert sorted(x.slot for x in shards.read_shards(manifest, resume_at=7).collect()) == list(range(7, len(back)))
    assert shards.round_trip(docs.limit(0), queries.VOCABULARY).count() == 0


def test_archives_are_normalised_and_read(spark):
    rows = [(4, "u", "<p>é</p>\r\n\r\nx"), (2, "v", "<p>é</p>\r\n\r\nx"), (9, None, None), (3, "w w", ""), (7, "x", "only"), (4, "u", "<p>é</p>\r\n\r\nx"), (None, "n", "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("taken"))
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    for r in got:
        h = next((x or "") for p, _, x in rows if p == r.page_id)
        raw = h.encode()
        revisit = r.page_id is not None and first[h] != r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), warc.payload_digest(raw), "revisit" if revisit else "response", first[h] if revisit else None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_a_stream_of_any_members_gives_its_records():
    raw = [warc.record("response", i, "u", b"x" * n, "D", n) for i, n in enumerate((0, 5, 3_000_000, 1))]
    one, many = warc.gzip_member(b"".join(raw)), b"".join(map(warc.gzip_member, raw))
    for data in (one, many):
        for step in (1 << 20, 1000):
            assert list(warc.records(iter([data[i : i + step] for i in range(0, len(data), step)]))) == raw
    with pytest.raises(ValueError):
        list(warc.records(iter([warc.gzip_member(raw[1][:-20])])))


def groups(fps, ids):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= simhash.RADIUS:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, x in enumerate(ids):
        if x is not None:
            best[find(i)] = min(best.get(find(i), x), x)
    return [best.get(find(i)) for i in range(len(fps))]


def slow_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("largest, n", [(1 << 18, None), (3, None), (1 << 18, 1 << 24)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, largest, n):
    monkeypatch.setattr(simhash, "MAX_SHARD", largest)
    if n:  # the forest of an input of that many fingerprints
        forest = simhash.plan_forest(n)
        assert len(forest[0]) >= 7
        monkeypatch.setattr(simhash, "plan_forest", lambda _: forest)
    r = random.Random(9)
    words, texts = [f"w{i}" for i in range(400)], [None, "", "  ", "One", "one", "É x", "é x"]
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.choice([3, 40, 300]))]
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
        texts += [" ".join(base)] * r.choice([0, 0, 3])
    rows = [(i if i != 9 else None, x, None, "s", 0) for i, x in enumerate(texts)] + [(20, texts[20], None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("taken"))
    got = simhash.near_duplicates(docs, ["doc_id", "text"]).collect()
    fps = [slow_fingerprint(x[1]) for x in rows]
    want = sorted(zip([x[0] for x in rows], fps, groups(fps, [x[0] for x in rows])), key=str)
    assert sorted(((x.doc_id, x.fp & (1 << 64) - 1, x.component_id) for x in got), key=str) == want
    if largest == 3 or n:
        return
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len({(c, f if c is None else 0) for _, f, c in want})
    assert simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [50, 3000])
def test_a_shard_links_exactly(n):
    r = np.random.default_rng(n)
    base = r.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64)
    fps = base[r.integers(0, 60, n)] ^ np.array([sum(1 << int(b) for b in r.integers(0, 64, r.integers(0, 6))) & (1 << 64) - 1 for _ in range(n)], np.uint64)
    fps = np.unique(fps)
    root = simhash.link_shard(fps, len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= simhash.RADIUS
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (root == label).all()


def test_split_shards_still_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_SHARD", 4)
    rows = [(0, 0, 0, int(i >= 15), i) for i in range(20)] + [(0, 1, 0, 0, i) for i in range(3)]
    df = spark.createDataFrame(rows, "tree int, branch long, shell int, guest int, fp long")
    met, homes = {}, {}
    for r in simhash.split_large(df).collect():
        homes.setdefault((r.branch, r.pair), ([], []))[r.guest].append(r.fp)
    for (branch, _), (h, g) in homes.items():
        for i, a in enumerate(h):
            for b in [*h[i + 1 :], *g]:
                met[branch, min(a, b), max(a, b)] = met.get((branch, min(a, b), max(a, b)), 0) + 1
    want = {(0, a, b) for a in range(15) for b in range(a + 1, 20)} | {(1, a, b) for a in range(3) for b in range(a + 1, 3)}
    assert set(met) == want and max(len(h) + len(g) for h, g in homes.values()) < 20


def test_queries_of_a_small_shard_are_split(spark):
    """Few homes and very many queries: each query meets each home once, and no pair of blocks holds them all."""
    df = spark.createDataFrame([(0, 0, 0, int(i >= 3), i) for i in range(203)], "tree int, branch long, shell int, guest int, fp long")
    pairs = {}
    for r in simhash.split_large(df, 20).collect():
        pairs.setdefault(r.pair, ([], []))[r.guest].append(r.fp)
    met = [(a, b) for h, g in pairs.values() for a in h for b in g]
    assert sorted(met) == [(a, b) for a in range(3) for b in range(3, 203)]
    assert max(len(h) + len(g) for h, g in pairs.values()) < 60


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 8)
    left = spark.createDataFrame([(1 if i % 3 == 0 else i, i) for i in range(300)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("k < 200")
    for how in ("inner", "left"):
        got = common.join_counted(left, right, ["k"], "n", 300, how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right.drop("n"), "k", how).collect()), key=str)


def test_the_forest_covers_every_link():
    r = random.Random(3)
    for n in (10, 1 << 24, 1 << 34):
        offsets, choices = simhash.plan_forest(n)
        for _ in range(200):
            flipped = r.sample(range(64), simhash.RADIUS)
            hit = {next(i for i in range(len(offsets) - 1) if offsets[i] <= b < offsets[i + 1]) for b in flipped}
            assert any(not hit & set(c) for c in choices)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}
