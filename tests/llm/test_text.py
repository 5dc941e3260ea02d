"""PII, quality rules, classifier, language identification and mixing against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalyn.llm import boosting, langid, mixing, pii, quality_knn, quality_rules, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group())]


@pytest.fixture(scope="module")
def pii_docs(spark):
    r = random.Random(1)
    texts = [
        "a@b.c%d@e.f @ a@@b.c a@b", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.01", "4111 1111-1111 1111 4111111111111111 5 4111-1111-1111-1111", "+1 (652) 555-4544x+123 +12345678901234567890",
        "é" * 50 + " ü@x.de ñ +49 170 1234567.", None, "", "a" * 3000 + "@" + "b." * 2000, "1 " * 4000, "\U0001f600 x@y.zz", "a.b.@-.c..d", "version 2.0.1 of 1999, see 10.0.0.1",
    ]
    texts += ["".join(r.choice("ab1234567890.@+- ()") for _ in range(60)) for _ in range(300)]
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], None, "s", 0)], DOCS).withColumn("base", F.lit("taken"))


def test_base_spans_are_those_of_the_patterns(pii_docs):
    texts = {r.doc_id: r.text for r in pii_docs.collect()}
    rows = pii.digest(pii_docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in want) for k in ("email", "ip", "card", "phone"))


def test_the_trees_add_spans_and_leave_prose_alone(spark):
    docs = spark.createDataFrame([(1, 'an token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" re', None, "s", 0), (2, "call 652-555-4544 now", None, "s", 0), (3, "met at noon. Then dot by dot, page 12, in 1999, version 3.0", None, "s", 0), (4, "ana.re[at]mola[dot]com", None, "s", 0)], DOCS)
    got = {r.doc_id: r.spans for r in pii.digest(docs).collect()}
    assert got[1].startswith("secret:") and got[2] == "phone:5:17" and got[3] == "" and got[4].startswith("email:0:")


def test_secrets_of_any_length_are_candidates(spark):
    r = random.Random(5)
    some = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    late = "".join(r.choice("ABCDEFghijkl") for _ in range(60)) + "7"
    keys = [some(n) for n in (200, 201, 240, 1000, 50000)] + [late]
    docs = spark.createDataFrame([(i, f'an token = "{x}" re', None, "s", 0) for i, x in enumerate(keys)], DOCS)
    found = {r.doc_id: [c for c in r.c if c.kind == "secret"] for r in docs.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    assert all([(c.start, c.end) for c in found[i]] == [(12, 12 + len(x))] for i, x in enumerate(keys))
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(clean[i] == 'an token = "[SECRET]" re' for i in range(5))


def test_items_that_hold_a_base_span_are_scored(spark):
    texts = ['an token = "sk_live_4242424242424242abcdEFGH12345678" re', "an account DE18 4242 4242 4242 4242 re", "card 4242 4242 4242 4242 re"]
    assert [len(base_spans(x)) for x in texts] == [1, 1, 1]
    docs = spark.createDataFrame([(i, x, None, "s", 0) for i, x in enumerate(texts)], DOCS)
    spans = {r.doc_id: r.spans.split(",") for r in pii.digest(docs).collect()}
    assert all(set(base_spans(x)) <= set(spans[i]) for i, x in enumerate(texts))
    assert "secret:12:52" in spans[0] and spans[2] == base_spans(texts[2])
    assert "iban:11:35" in spans[1]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean == {0: 'an token = "[SECRET]" re', 1: "an account [IBAN] re", 2: "card [CARD] re"}


def test_redaction_replaces_spans_only(spark):
    docs = spark.createDataFrame([(1, "ü a@b.cc, +1 (652) 555-4544!", "en", "s", 28), (2, None, None, None, None), (3, "clean", "en", "s", 5)], DOCS)
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert got == {1: ("ü [EMAIL], [PHONE]!", 19), 2: (None, None), 3: ("clean", 5)}
    assert pii.redact(docs.limit(0)).count() == 0


def test_expression_of_the_trees_is_their_prediction(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = boosting.fit(x, y)
    p = model.predict(x)
    assert ((p > 0.5) == y).mean() > 0.85
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x[:50])], "i int, a double, b double, c double, d double")
    got = {r.i: r.p for r in df.select("i", model.expression([F.col(c) for c in "abcd"]).alias("p")).collect()}
    assert all(math.isclose(got[i], p[i], abs_tol=1e-9) for i in got)


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win, covered = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if win[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_are_those_of_the_text(spark):
    r = random.Random(2)
    texts = ["a b c a b c a b", "", None, "x\ny\nx\n \n \nx ", "\x0b\x0c a b", "a a a a a", "a b c x a b c y b c a b c", "é# ü|  x", "w " * 3000]
    texts += [" ".join(r.choice(["a", "b", "c", "d\n"]) for _ in range(r.randint(0, 80))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], DOCS)
    for row in quality_rules.judge(docs, []).collect():
        n, chars, symbols, dup, repeat = statistics(row.text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, repeat), row.text
        assert row.base_failed == (n < 50 or 100 * repeat > 50 * n) and row.kept == (not row.base_failed)
    assert quality_rules.judge(docs.limit(0), []).count() == 0


def made_corpus(spark, n=400):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["the", "an", "re", "ti", "on", "es", "la"]) for _ in range(r.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        good, words = i % 4 > 0, [word() for _ in range(r.randint(60, 90))]
        docs.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words) if i % 8 else " | ".join(words), "en", "s", 0))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_decision_list_holds_out(spark):
    docs, labels = made_corpus(spark)
    rules = quality_rules.fit(docs, labels)
    assert rules and all(len(x.tests) <= quality_rules.MAX_TESTS for x in rules)
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == (i % 4 > 0) for i in held) / len(held) > 0.95
    assert quality_rules.fit(docs, labels.limit(0)) == []


def test_neighbour_votes_hold_out_and_match_brute_force(spark):
    docs, labels = made_corpus(spark)
    rows = quality_knn.report(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) / len(held) > 0.95
    model = quality_knn.fit(docs.select("doc_id", "text"), labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows[:40]:
        v = model.latent(quality_knn.damped(quality_knn.counts(texts[r.doc_id].encode())))[0]
        like = [(-round(float(v @ u), 9), i) for i, u in enumerate(model.vectors)]
        near = [(-s, i) for s, i in sorted(like)[: quality_knn.NEIGHBOURS]]
        w = [math.exp(quality_knn.SHARPNESS * (s - 1)) for s, _ in near]
        assert math.isclose(r.score, sum(a * model.labels[i] for a, (_, i) in zip(w, near)) / sum(w), abs_tol=1e-4)


def test_scores_of_odd_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x" * 300000, "en", "s", 0)], DOCS).withColumn("score", F.lit("taken"))
    _, labels = made_corpus(spark, 40)
    assert all(0 <= r.score <= 1 for r in quality_knn.report(docs, labels).collect())
    assert {r.score for r in quality_knn.report(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_knn.report(docs.limit(0), labels).count() == 0


def slow_ppm(model_samples, raw, lang):
    """Escape method C with plain dictionaries over the same symbols and contexts."""
    m = langid.train(model_samples)
    n = langid.SYMBOLS
    seen = {}
    for k, texts in model_samples.items():
        for x in texts:
            s = [0] * langid.ORDER + m.symbol[np.frombuffer(x, np.uint8)].tolist()
            for i in range(langid.ORDER, len(s)):
                for o in range(langid.ORDER + 1):
                    seen.setdefault((k, tuple(s[i - o : i])), Counter())[s[i]] += 1
    known = {c for (k, c), v in seen.items()} | {()}

    def bits(context, symbol):
        while context not in known:
            context = context[1:]
        total = 0.0
        while True:
            c = seen.get((lang, context), Counter())
            t, kinds = sum(c.values()), len(c)
            if c[symbol]:
                return total - math.log2(c[symbol] / (t + kinds))
            if t:
                total -= math.log2(kinds / (t + kinds))
            if not context:
                return total + math.log2(n)
            context = context[1:]
            while context not in known:
                context = context[1:]

    s = [0] * langid.ORDER + m.symbol[np.frombuffer(raw, np.uint8)].tolist()
    return sum(bits(tuple(s[i - langid.ORDER : i]), s[i]) for i in range(langid.ORDER, len(s)))


def test_code_lengths_are_those_of_the_context_trees(monkeypatch):
    samples = {"a": [b"the cat sat on the mat and the hat" * 3], "b": [b"der hut und die katze auf der matte" * 3]}
    m = langid.train(samples)
    raw = "the hut xyz é and".encode()
    got = m.code_lengths(raw)
    for j, k in enumerate(m.languages):
        assert math.isclose(got[j], slow_ppm(samples, raw, k), rel_tol=1e-5)
    monkeypatch.setattr(langid, "PIECE", 5)
    assert np.allclose(m.code_lengths(raw), got)


def test_every_byte_of_the_samples_has_its_own_symbol(monkeypatch):
    common = bytes(range(32, 127)) * 40  # more kinds than any cut of the alphabet to its most frequent bytes
    samples = {"a": [common + "яюэ".encode() * 9], "b": [common + "ґєї".encode() * 9], "c": [common + "日本語".encode() * 9]}
    m = langid.train(samples)
    held = {x for v in samples.values() for raw in v for x in raw}
    assert len({int(m.symbol[x]) for x in held}) == len(held) and m.symbol[0] == m.symbol[255] == 1
    for k, text in (("a", "эюя"), ("b", "їєґ"), ("c", "語本日"), ("a", "\0 юэ \x7f")):
        raw = text.encode()
        bits = m.code_lengths(raw)
        assert m.languages[int(np.argmin(bits))] == k
        assert all(math.isclose(bits[j], slow_ppm(samples, raw, name), rel_tol=1e-5) for j, name in enumerate(m.languages))


def test_languages_hold_out(spark):
    r = random.Random(6)
    parts = {"en": ["the", "ing", "and", "th"], "de": ["der", "sch", "ung", "ein"], "fr": ["eau", "que", "les", "é"]}
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(2)) for _ in range(30)), k, "s", 0) for i, k in enumerate(list(parts) * 60)]
    odd = [(1000, None, "en", "s", 0), (1001, "12 34 !", "en", "s", 0), (1002, "", None, None, None), (None, "the and", None, "s", 0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    got = langid.report(docs).collect()
    lang = {x[0]: x[2] for x in rows}
    held = [x for x in got if x.held_out and x.doc_id in lang]
    assert len(got) == len(rows) + 4 and sum(x.lang_pred == lang[x.doc_id] for x in held) / len(held) > 0.98
    assert {(x.lang_pred, x.score) for x in got if x.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    assert langid.report(docs.where("lang is null")).where("lang_pred <> 'und'").count() == 0


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 30, 200]))), "en", r.choice(["b", "a", None, "Z", "é"]), 0) for i in range(400)]
    rows += [(None, "a b c", None, "a", 0), (7, None, None, None, None), rows[3], rows[3]]
    return rows, spark.createDataFrame(rows, DOCS)


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left, w = total - sum(out.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_mix_meets_its_targets(mixed):
    rows, docs = mixed
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = targets(dict(sizes))
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted(by) == sorted((sizes[s], round(want[s], 6)) for s in sizes)
    assert all(abs(sum(v) - t) <= mixing.QUANTUM + 1 for (_, t), v in by.items())
    assert sum(map(sum, by.values())) == sum(sizes.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.report(docs).collect()), key=str)


def test_mix_serves_the_sorted_queue(mixed):
    """Every quantum of every pass in one list, sorted by virtual finish time and served until the budget is spent."""
    rows, docs = mixed
    sources = sorted({s for *_, s, _ in rows if s is not None}) + ([None] if any(s is None for *_, s, _ in rows) else [])
    queue, served = [], Counter()
    for rank, src in enumerate(sources):
        mine = sorted((hashlib.md5((mixing.SEED + str(t if i is None else i)).encode()).hexdigest(), i if i is not None else -1, len((t or "").split())) for i, t, _, s, _ in rows if s == src)
        size, weight = sum(x[2] for x in mine), mixing.WEIGHTS[rank % 3]
        for e in range(mixing.EPOCHS):
            at = e * size
            for md5, i, n in mine:
                for begin in range(0, n, 16):
                    queue.append(((at + min(n, begin + 16)) / weight, rank, (md5, n), min(16, n - begin)))
                at += n
    left = sum(len((t or "").split()) for _, t, *_ in rows)
    for _, _, doc, words in sorted(queue, key=lambda q: q[:2]):
        served[doc] += min(words, left)
        left -= min(words, left)
    plans = mixing.plan(docs, quantum=16, span=100).collect()
    assert sorted(sum(r.served) for r in plans if r.size) == sorted(served[k] for k in served)


def test_mix_repeats_and_cuts_rows(mixed):
    rows, docs = mixed
    plan = mixing.report(docs).collect()
    out = mixing.mix(docs).collect()
    assert sum(len((r.text or "").split()) for r in out) == sum(r.taken for r in plan)
    texts = {}
    for x in rows:
        texts.setdefault(x[0], []).append(x[1] or "")
    assert all(any(t.startswith(r.text) for t in texts[r.doc_id]) for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.report(docs.where("text is null")).first().taken == 0


def test_clashing_columns_pass_or_are_replaced(spark):
    docs, labels = made_corpus(spark, 60)
    names = ["score", "spans", "base", "kept", "n_words", "size", "weight", "ids", "fp", "src", "_mark", "_n", "_size", "_text", "_spans", "_score", "_raw", "_f", "_words", "mark", "row", "all", "i", "pass", "served", "label", "base_spans", "text_given", "raw", "slice", "at", "d.row"]
    wide = docs.withColumns({n: F.lit(f"mine {n}") for n in names})
    mine = lambda df: {n: {r[0] for r in df.select(f"`{n}`").collect()} for n in names}
    want = {n: {f"mine {n}"} for n in names}
    for stage in (pii.redact, mixing.mix, lambda d: quality_knn.accepted(d, labels), simhash.one_of_each):
        made = stage(wide)
        assert made.columns == wide.columns and mine(made) == want
    judged = quality_rules.judge(wide, [])
    assert judged.columns.count("kept") == 1 and [r[0] for r in judged.select("_f").distinct().collect()] == ["mine _f"]
    assert quality_knn.score(wide, quality_knn.fit(docs, labels)).columns.count("score") == 1


def test_learning_takes_one_row_of_a_doc_id(spark):
    """5,000 rows of one doc_id count once, so bounds on ids are bounds on rows."""
    docs, labels = made_corpus(spark, 80)
    one = next(r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5)
    many = docs.union(docs.where(F.col("doc_id") == one).crossJoin(spark.range(5000)).drop("id"))
    want, got = quality_knn.fit(docs, labels), quality_knn.fit(many, labels)
    assert len(got.labels) == len(want.labels) <= 80 and np.array_equal(got.labels, want.labels) and np.allclose(got.vectors, want.vectors)
    assert quality_rules.fit(many, labels) == quality_rules.fit(docs, labels)
    few, lots = (langid.fit(d.select("doc_id", "text", "lang"), 30) for d in (docs, many))
    assert few.languages == lots.languages and np.array_equal(few.bits, lots.bits) and np.array_equal(few.keys, lots.keys)


def test_texts_without_letters_have_no_language(spark):
    docs, _ = made_corpus(spark, 40)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    odd = [None, "", "½ ² 12", "٣ Ⅷ ① ㊗", "_-!", "é", "字", "a1"]
    got = [r.lang_pred for r in langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got == ["und"] * 5 + ["en"] * 3
    broken = spark.sql("select 1L doc_id, cast(x'ff74686520616e' as string) text")
    assert langid.identify(broken, model).first().lang_pred == "en"


def test_languages_of_many_scripts_keep_all_bytes():
    """Code lengths over more than 96 distinct bytes are those of a slow coder."""
    r = random.Random(8)
    scripts = {"aa": range(0x61, 0x7B), "bb": range(0x410, 0x450), "cc": range(0x3B1, 0x3CA), "dd": range(0x4E00, 0x6E80, 61), "ee": range(0x5D0, 0x5EA)}
    samples = {k: ["".join(chr(r.choice(v)) for _ in range(400)).encode() for _ in range(4)] for k, v in scripts.items()}
    assert len({b for v in samples.values() for x in v for b in x}) > 96
    model = langid.train(samples)
    for k, v in scripts.items():
        text = "".join(chr(r.choice(v)) for _ in range(60)).encode()
        assert model.predict(text)[0] == k


def test_very_long_texts_are_read_whole(spark):
    """Personal data, statistics and languages of texts of several MB, in time that follows their length."""
    model = pii.train(spark)
    docs = spark.createDataFrame([(1, "call 555-123-4567 or a@b.de, " * 60_000, "en", "s", 0)], DOCS)
    began = time.time()
    found = pii.digest(docs, model).first()
    assert found.n_email == 60_000 and found.spans.count(",") == 119_999
    clean = pii.redact(docs, model).first()
    assert clean.text == "call [PHONE] or [EMAIL], " * 60_000 and clean.n_chars == len(clean.text)
    assert time.time() - began < 240
    long = spark.createDataFrame([(1, "the an re ti on es la " * 60_000, "en", "s", 0), (2, None, "en", "s", 0)], DOCS)
    got = {r.doc_id: r for r in quality_rules.judge(long, []).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[2].n_words) == (420_000, 420_000, 0)
    assert {r.doc_id: r.size for r in mixing.report(long).collect()} == {1: 420_000, 2: 0}


def test_added_spans_on_sentences_the_trees_have_not_seen(spark):
    """Precision and recall of what the trees add, on made sentences of another seed."""
    made = pii._examples(1200, 991)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _, _ in made], DOCS)
    spans = {r.doc_id: [tuple(x.split(":")) for x in r.spans.split(",") if x] for r in pii.digest(docs).collect()}
    hit = wrong = personal = 0
    for i, text, span, label in made:
        at = text.index(span)
        over = any(int(s) < at + len(span) and int(e) > at for _, s, e in spans[i])
        personal += label
        hit, wrong = hit + (over and label), wrong + (over and not label)
    assert hit / personal >= 0.95 and hit / max(1, hit + wrong) >= 0.95, (hit, wrong, personal)


def test_repeated_windows_survive_colliding_hashes(spark):
    import random

    from pyspark.sql import functions as F

    from stratalyn.llm import quality_rules
    from stratalyn.llm.common import words_of

    r = random.Random(11)
    texts = [" ".join(r.choice("abcdé"[: r.randint(1, 5)]) for _ in range(r.randint(0, 60))) for _ in range(120)]

    def want(text):
        w = text.split()
        places = [i for i in range(len(w) - 2) if any(w[i : i + 3] == w[j : j + 3] for j in range(len(w) - 2) if j != i)]
        return len({i + k for i in places for k in range(3)})

    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", words_of(F.col("text")).alias("w"))
    for bits in (31, 62):  # 62 leave two bits of a hash
        found = df.select("text", quality_rules._repeat_words(F.col("w"), bits).alias("n"))
        assert [x.n for x in found.collect()] == [want(x) for x in texts]
    # a comparator made of lambdas, called for every pair of windows, took most of the time
    assert "array_sort" not in quality_rules.statistics(df)._jdf.queryExecution().optimizedPlan().toString()
