"""Corpus operators against brute force, round trips and held-out labels; odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import _text as t
from weftgraph.llm import decontaminate, jaccard_join, licenses, mixing, ordinal, queries, repeats, repetition, surrogates, token_store, url_filter
from weftgraph.llm._common import least_hashed, prefix_sums, stage, workspace

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, cid string, n int, size string, bucket int, taken string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(3)
    long = prose(rng, 4000)
    base = prose(rng, 120)
    shared = prose(rng, 90)
    texts = [
        None, "", " \n\t ", "one", "a b c d", "é é\u0301 ß Ωmega 漢字 😀 x", base, base, base.replace(base.split()[60], "changed", 1), long, long + " tail",
        prose(rng, 40) + "\n" + shared + "\n" + prose(rng, 30), prose(rng, 50) + "\n" + shared, "spam " * 300, "l one two three\nl one two three\n\nl one two three\nx",
        "<|endoftext|> <|ENDOFTEXT|> don't 5.00", "\x00 nul \x1c unit\x85next",
    ]
    rows = [(k if k != 4 else None, x, None if k % 3 else "en", [None, "a", "b", "é"][k % 4], None, 1, "x", 2, "y", 3, "z") for k, x in enumerate(texts)]
    rows += [rows[6], rows[9], (6, texts[7], "fr", "b", 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# Shared parts.


def test_suffix_array_is_sorted_and_lcp_is_right():
    rng = np.random.default_rng(1)
    for n, k in ((0, 1), (1, 1), (30, 2), (200, 2), (200, 20)):
        x = rng.integers(0, k, n)
        a = t.SuffixArray(x, np.full(n, n))
        assert a.order.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
        want = [0] * n
        for j in range(1, n):
            p, q = x[a.order[j - 1] :].tolist(), x[a.order[j] :].tolist()
            while want[j] < min(len(p), len(q)) and p[want[j]] == q[want[j]]:
                want[j] += 1
        assert a.lcp().tolist() == want


def test_prefix_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 300) if rng.random() < 0.95 else None, rng.randint(0, 9), k) for k in range(2000)]
    df = stage(spark.createDataFrame(rows, "k long, v long, tie long"), "t")
    got = {(r.k, r.tie): r.s for r in prefix_sums(df, ["k", "tie"], "v", "s", rows_per_bucket=20).collect()}
    total = 0
    for k, v, tie in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        assert got[k, tie] == total
        total += v
    assert prefix_sums(stage(df.limit(0), "t"), ["k"], "v", "s").count() == 0


def test_least_hashed(spark):
    df = spark.range(5000).withColumnRenamed("id", "x")
    got = {r.x for r in least_hashed(df, ["x"], 100).collect()}
    assert got == {r.x for r in df.orderBy(F.xxhash64("x")).limit(100).collect()}
    assert least_hashed(df.where("x < 5"), ["x"], 100).count() == 5
    assert least_hashed(df.select((F.col("x") % 2).alias("x")), ["x"], 100).count() == 100


# 1: token store.


def test_token_store(spark, odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_store.Encoder(path)
    to = workspace(spark, "store")
    token_store.write_store(odd, to, path)
    want = []
    for d, x in texts_of(odd):
        want.append((d, [*encoder.tokenizer.encode(x, add_special_tokens=False).ids, 1]))
    got = [(r.doc_id, list(r.ids)) for r in token_store.read_ids(spark, to).collect()]
    assert Counter((d, tuple(x)) for d, x in got) == Counter((d, tuple(x)) for d, x in want)
    rows = sorted(token_store.verify(spark, to).collect(), key=lambda r: r.start)
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in rows] == sorted((d for d, _ in want), key=lambda d: (d is not None, d or 0))
    crc = Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == crc
    chunks = spark.read.parquet(f"{to}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    bad = workspace(spark, "bad")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{to}/{name}").write.parquet(f"{bad}/{name}")
    chunks.withColumn("payload", F.concat("payload", F.lit(b"\x01\x00"))).write.parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="doesn't hold what its digest says"):
        token_store.verify(spark, bad).collect()
    none = workspace(spark, "none")
    token_store.write_store(empty, none, path)
    assert token_store.verify(spark, none).count() == 0


def test_encoder_equals_the_library():
    import duckdb
    import public_tokenizers

    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    texts += ["don't.we'll('s)!!a...b,,c é.a a.\u0301b a\u226eb $5.00a", "ÉCOLE Œuvre ÀÈ×÷ ǅ İ ﬁ", "a\u00a0b\u2028c\u3000d", ""]
    encoder = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    data, offsets = t.buffers(__import__("pyarrow").array(texts))
    ids, bounds = encoder(data, offsets)
    for k, x in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*encoder.tokenizer.encode(x, add_special_tokens=False).ids, 1], x[:50]


def test_encoder_on_odd_texts():
    """Random Unicode, and texts whose pieces have equal polynomial hashes."""
    import pyarrow as pa
    import public_tokenizers

    encoder = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.by_pieces
    rng = random.Random(31)
    alphabet = "aZé'.,!?# \n\t09ßİıǅﬁ漢\u0301\u0338\u00a0\u2028\u200d😀<|>sdtmvelr" + "".join(map(chr, range(0xC0, 0x100)))
    texts = ["".join(rng.choice(alphabet) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for n in (512, 1024):
        texts += [" ".join(thue_morse(n)), " ".join(thue_morse(n, "-", "Y"))]
    data, offsets = t.buffers(pa.array(texts))
    for by_pieces in (True, False):
        encoder.by_pieces = by_pieces
        ids, bounds = encoder(data, offsets)
        for k, x in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*encoder.tokenizer.encode(x, add_special_tokens=False).ids, 1], x[:50]


def test_encoder_asks_once_for_a_piece(monkeypatch):
    """A task's different pieces, some 320,000 in a file of the check's size, are kept; the library gets each once."""
    import pyarrow as pa
    import public_tokenizers

    encoder = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    words = encoder.words
    monkeypatch.setattr(encoder, "words", lambda new: asked.extend(new) or words(new))
    letters = str.maketrans("0123456789", "abcdefghij")
    parts = [" ".join(str(k).translate(letters) for k in range(a, a + 60_000)) for a in range(0, 300_000, 60_000)]
    for x in [*parts, parts[0]]:
        encoder(*t.buffers(pa.array([x])))
    assert len(asked) == len(set(asked)) == 300_000


def test_tasks_leave_no_memory_behind():
    """A Python worker takes one task after the other; what a task encoded is let go, and the tokenizer is loaded once."""
    import gc
    import tracemalloc

    import pyarrow as pa
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(7)
    words = prose(rng, 2000).split()
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([" ".join(rng.choices(words, k=150_000))])], ["doc_id", "text"]) for k in range(4)]

    def task():
        return sum(len(x) for b in token_store.encode_batches(iter(batches), path) for own in b.column(6).to_pylist() for x in own)

    size = task()
    assert size > 2 << 20
    encoder = token_store.encoder_of(path)
    tracemalloc.start()
    try:
        task()
        gc.collect()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < size / 4
    assert token_store.encoder_of(path) is encoder


def test_distinct_pieces():
    data = np.frombuffer(b"ab  a ab\nb a" + bytes([0xC3, 0xA9]), np.uint8)
    starts, ends = np.array([0, 4, 6, 9, 11, 12]), np.array([2, 5, 8, 10, 12, 14])
    keys, which = token_store.distinct_pieces(data, starts, ends)
    assert len(keys) == len(set(keys))
    assert [keys[k] for k in which] == [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert token_store.distinct_pieces(data, starts[:0], ends[:0])[0] == []


def test_store_files_are_in_order(spark, monkeypatch):
    import public_tokenizers

    whole = token_store.prefix_sums
    monkeypatch.setattr(token_store, "prefix_sums", lambda *a: whole(*a, rows_per_bucket=40))
    docs = spark.createDataFrame([((k * 7919) % 1009, f"text {k % 5}") for k in range(300)], "doc_id long, text string")
    to = workspace(spark, "store")
    token_store.write_store(docs, to, public_tokenizers.path("word_bpe_49k.json"))
    files = spark.read.parquet(f"{to}/recipes").groupBy(F.input_file_name()).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(files, files[1:], strict=False))
    rows = token_store.verify(spark, to).orderBy("doc_id").collect()
    assert len(rows) == 300 and all(y.start == x.start + x.n_tokens for x, y in zip(rows, rows[1:], strict=False))


def test_chunks_follow_content():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 40_000, 20_000).astype(np.int32)
    pieces = lambda ids: {ids[a:b].tobytes() for ends in [token_store.cut(ids, np.array([0, len(ids)]))] for a, b in zip([0, *ends[:-1]], ends, strict=True)}
    a, b = pieces(x), pieces(np.concatenate([x[:37], x]))
    assert len(a & b) > 0.8 * len(a)
    assert max(map(len, a)) <= token_store.LONGEST * 4
    assert token_store.merkle([b"a", b"b", b"c"]) != token_store.merkle([b"a", b"c", b"b"])


# 2: ordinal quality.


def test_ordinal_quality(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grades = labels.select("doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    fitted, held = grades.where("doc_id % 2 = 0"), {r.doc_id: r.grade for r in grades.where("doc_id % 2 = 1").collect()}
    model = ordinal.train(docs, fitted, 3, sample=1500)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in ordinal.score(docs, model).collect()}
    assert len(got) == docs.count()
    right = np.mean([round(got[d].expected_grade) == g for d, g in held.items()])
    kept = np.mean([(got[d].p_best >= 0.5) == (g == 2) for d, g in held.items()])
    assert right > 0.9
    assert kept > 0.95
    assert ordinal.score(odd, model).count() == odd.count()
    assert ordinal.score(empty, model).count() == 0
    one = ordinal.train(docs, fitted.where("grade = 2"), 3, sample=50)
    assert all(r.expected_grade > 1.99 for r in ordinal.score(odd, one).collect())
    none = ordinal.train(docs, fitted.limit(0), 3)
    assert all(r.expected_grade < 0.01 for r in ordinal.score(odd, none).collect())


# 3: repetition.


def brute_repetition(x):
    words = WORD.findall(x)
    lines, seen, dup = [z for z in x.split("\n") if WORD.search(z)], set(), 0
    for z in lines:
        dup += z in seen
        seen.add(z)

    def repeated(m):
        at = {}
        for i in range(len(words) - m + 1):
            at.setdefault(tuple(words[i : i + m]), []).append(i)
        return {i + k for g in at.values() if len(g) > 1 for i in g for k in range(m)}

    longest = 0
    while longest < len(words) and repeated(longest + 1):
        longest += 1
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(repeated(5)), len(repeated(repetition.MIN_REPEAT)), longest


def test_repetition(spark, odd, empty):
    rng = random.Random(7)
    some = [(100 + k, " ".join(rng.choice("ab|") for _ in range(rng.randint(0, 60))) + "\n" + "x y z\n" * rng.randint(0, 3)) for k in range(60)]
    docs = odd.where("length(text) < 5000 or text is null").select("doc_id", "text").unionByName(spark.createDataFrame(some, "doc_id long, text string"))
    got = Counter(tuple(r)[:8] for r in repetition.repetition(docs).collect())
    assert got == Counter((d, *brute_repetition(x)) for d, x in texts_of(docs))
    for r in repetition.repetition(odd).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = repetition.keep(odd)
    assert kept.schema == odd.schema
    assert kept.count() == repetition.repetition(odd).where("kept").count()
    assert repetition.repetition(empty).count() == repetition.keep(empty).count() == 0


def thue_morse(n, a="a", b="b"):
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_spans_with_equal_polynomial_hashes_stay_apart(spark):
    x, y = thue_morse(1024)
    data = np.frombuffer((x + y).encode(), np.uint8)
    starts = np.array([0, 1024])
    assert len(set(t.rolling_hash(t.prefix_hash(data), starts, starts + 1024).tolist())) == 1
    one, which = t.span_numbers(data, starts, starts + 1024)
    assert len(one) == 2 and which[0] != which[1]
    rows = {r.doc_id: r for r in repetition.repetition(spark.createDataFrame([(1, f"{x}\n{y}"), (2, f"{x}\n{x}")], "doc_id long, text string")).collect()}
    assert (rows[1].n_dup_lines, rows[2].n_dup_lines) == (0, 1)


def test_span_numbers_with_colliding_hashes(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 17, 64, 200]))) for _ in range(300)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(t, "span_hash", lambda d, a, b: (b - a).astype(np.uint64) & np.uint64(3))
        one, which = t.span_numbers(data, starts, ends)
        assert len(one) == len(set(words))
        assert all(words[one[k]] == w for k, w in zip(which.tolist(), words, strict=True))


def test_repetition_rejects_beyond_the_base_rule(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    ten, more = words(10), words(22)
    texts = [
        words(45) + " " + ten + " " + words(45) + " " + ten,  # 20 of 110 words covered
        words(230) + " " + more + " " + words(230) + " " + more,  # 44 of 504 covered, one repeat of 22
        words(120),
        words(250) + " " + ten + " " + words(250) + " " + ten,  # 20 of 520 covered
        words(9),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.repetition(docs).collect()}
    assert [got[k].base_failed for k in range(5)] == [False, False, False, False, True]
    assert [got[k].kept for k in range(5)] == [False, False, True, True, False]
    assert got[1].n_covered_words <= repetition.MAX_COVERED * got[1].n_words
    assert {r.doc_id for r in repetition.keep(docs).collect()} == {2, 3}


# 4: surrogates.

PII = [
    "mail for.43@mail7.example.com or FOR.43@MAIL7.EXAMPLE.COM!!", "call +1 (974) 555-3436 or 974-555-3436 from 97.51.17.173.", "cards 4111111111111111 7536784127813050, 4111 1111 1111 1111",
    'token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" and 123-45-6789', "Mr. John Smith met Mrs. Smith; г-жа Анна Иванова и г-н Иванов", "plain v 4.0 of 12 words", None, "", "plain v 4.0 of 12 words",
]


def test_surrogates(spark, odd, empty):
    docs = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.anonymize(docs).collect()}
    assert [got[k].text for k in (5, 6, 7, 8)] == [PII[5], None, "", PII[5]]
    text = " ".join(got[k].text for k in range(5))
    for gone in ("for.43", "974", "555-3436", "97.51", "41111", "4111 1111", "75367", "cb1a9f", "123-45", "John", "Smith", "Анна", "Иванов"):
        assert gone not in text, gone
    a, b = re.findall(r"\S+@\S+", got[0].text)
    assert a.upper() + "!!" == b
    phones = re.findall(r"\(?(\d{3})\)?[ -](555-\d{4})", got[1].text)
    assert phones[0] == phones[1]
    luhn = lambda n: sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if k % 2 else int(c) for k, c in enumerate(reversed(n))) % 10 == 0
    first, second, third = re.findall(r"\d{16}|\d{4}(?: \d{4}){3}", got[2].text)
    assert luhn(first)
    assert luhn("7536784127813050") == luhn(second)
    assert third.replace(" ", "") == first
    man, wife = re.search(r"Mr\. (\S+ \S+) met Mrs\. (\S+);", got[4].text).groups()
    assert man.split()[1] == wife
    assert man.split()[0] in surrogates.MALE
    her, him = re.search(r"г-жа (\S+ \S+) и г-н (\S+)", got[4].text).groups()
    assert her.split()[1] == him + "а"
    assert surrogates.anonymize(docs, "another key").where("doc_id = 0").first().text != got[0].text
    assert surrogates.anonymize(odd).count() == odd.count()
    assert surrogates.anonymize(empty).count() == 0


def test_surrogates_stay_distinct(spark, monkeypatch):
    names = [f"{a}{b}{c}" for a in "BCDFGHKLMNPR" for b in ("ada", "ele", "iri", "oro", "unu") for c in ("k", "l", "m", "n", "r", "s", "t")]
    docs = spark.createDataFrame([(k, f"Mr. {x} wrote.") for k, x in enumerate(names)], "doc_id long, text string")
    odd = surrogates.exceptions(docs).cache()
    assert odd.count() > 20  # 420 names, 380 plain surrogates
    plain = {r.doc_id: r.text for r in surrogates.anonymize(docs).collect()}
    made = [re.search(r"Mr\. (\S+) wrote", x)[1] for x in plain.values()]
    assert len(set(made)) == len(names)
    assert not set(made) & set(names)
    monkeypatch.setattr(surrogates, "BROADCAST_EXCEPTIONS", 0)
    assert {r.doc_id: r.text for r in surrogates.anonymize(docs).collect()} == plain


WHOLE_MENTIONS = {
    "met Mr. O'Brien, Mr. O’Brien and Mr. O'Brien's dog": "met Mr. (S), Mr. (S) and Mr. (S)'s dog",
    "by Dr. J. Smith and Dr. Smith": "by Dr. \\w\\. (S) and Dr. (S)",
    "saw Mr. McDonald here, Mr. MCDONALD there": None,
    "and Mrs. Smith-Jones": "and Mrs. (S)",
    "for Mr. John Paul Smith, Mrs. Smith": "for Mr. \\S+ \\S+ (S), Mrs. (S)",
    "von Herr von Berg": "von Herr (S)",
    "г-жа Иванова И. И. и г-н Иванов": "г-жа (S)а \\w\\. \\w\\. и г-н (S)",
    "Mr. T. came, Mr. J. R. Smith Jr. went": None,
    "tel +14155552671 or 4155552671 or 415-555-2671": "tel \\+1(\\d{10}) or (\\d{10}) or (\\d{3}-\\d{3}-\\d{4})",
    "tel +44 20 7946 0958 or +44 (0)20 7946 0958": "tel \\+44 (\\d\\d \\d{4} \\d{4}) or \\+44 \\(0\\)(\\d\\d \\d{4} \\d{4})",
    "tel +49 30 901820 or +8613812345678": "tel \\+49 \\d\\d \\d{6} or \\+86\\d{11}",
    "tel (415)5552671 or 415 5552671": "tel \\((\\d{3}\\)\\d{7}) or (\\d{3} \\d{7})",
    "card 3782 822463 10005 or 3782-822463-10005 or 378282246310005": "card (\\d{4} \\d{6} \\d{5}) or (\\d{4}-\\d{6}-\\d{5}) or (\\d{15})",
    "card 3056 930902 5904, 6212 3456 7890 1234 589": "card \\d{4} \\d{6} \\d{4}, \\d{4} \\d{4} \\d{4} \\d{4} \\d{3}",
}


def test_surrogates_leave_nothing_of_a_mention(spark):
    docs = spark.createDataFrame(list(enumerate(WHOLE_MENTIONS)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in surrogates.anonymize(docs).collect()}
    for k, (text, form) in enumerate(WHOLE_MENTIONS.items()):
        for gone in re.findall(r"O.Brien|J\.|R\.|T\.|Smith|Jones|Mc|Donald|(?i:mcdonald)|John|Paul|Berg|Иванов|И\.|415|2671|7946|0958|9018|1381|5678|3782|822|1000|3056|9309|5904|6212|3456|7890|589", text):
            assert gone not in got[k], (text, got[k])
        if form:
            found = re.fullmatch(form.replace("(S)", "([A-Z][a-z]+|[А-Я][а-я]+?)"), got[k])
            assert found, (text, got[k])
            assert len({re.sub(r"\D", "", x) or x for x in found.groups()}) <= 1, (text, got[k])  # one entity, one surrogate
    plain = ["in 1700000000 s, 0.4155552671 of 12 345 678", "Mr. and Mrs. of the house", "Dr. who, +1 for it"]
    same = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in surrogates.anonymize(same).collect()} == dict(enumerate(plain))


def test_looks_ahead_change_no_mention(spark):
    """The pattern finds what its alternatives find by themselves, in text made of all that they turn on."""
    plain = "|".join([surrogates._EMAIL, surrogates._HEX, surrogates._IBAN, surrogates._IPV6, surrogates._IP, surrogates._CARD, surrogates._SSN, surrogates._PHONE, surrogates._PERSON])
    bits = ["a@b.co", "é.x%y@z.de", "1.2.3.4", "::1", "A::b", "fe80::1", "(415) 555-2671", "+49 30 901820", "4155552671", "4111111111111111", "123-45-6789", "DE89 3704 0044 0532 0130 00"]
    bits += ["deadbeef" * 4, "Mr. J. O'Brien", "г-н Иванов", "Dr. Who", "é", "𝐀", "🙂", "x", "5", ".", "_", "%", "-", "+", "(", ":", " ", " ", "\n"]
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(bits, 12)) for _ in range(3000)]
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(found(plain).alias("a"), found(surrogates.PATTERN).alias("b"))
    n, same = rows.agg(F.sum(F.size("a")), F.bool_and(F.col("a") == F.col("b"))).first()
    assert n > 3000 and same


def test_surrogates_of_untitled_names_and_accounts(spark):
    texts = ["Mr. John Smith wrote. John Smith then left; Smith came back. A smith forged.", "Prof. Ada Lovelace and Professor Lovelace", "pay DE89370400440532013000 or DE89370400440532013001", "host 2001:db8::1 and fe80:0:0:0:1:2:3:4, std::abc, 12:30:45"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in surrogates.anonymize(rows).collect()}
    assert "Smith" not in got[0] and "John" not in got[0] and got[0].endswith("A smith forged.")
    surname = got[0].split()[2].rstrip(".")
    assert got[0].count(surname) == 3
    assert "Lovelace" not in got[1] and "Ada" not in got[1]
    rest = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    assert [rest(x) == 1 for x in re.findall(r"DE\d{20}", got[2])] == [True, False]
    assert "2001:db8::1" not in got[3] and "fe80" not in got[3] and got[3].endswith("std::abc, 12:30:45") and "::" in got[3].split()[1]


# 5: repeats.


def brute_repeats(texts, least):
    raw = [x.encode() for _, x in texts]
    seen = Counter(x[i : i + least] for x in raw for i in range(len(x) - least + 1))
    out = Counter()
    for (d, _), x in zip(texts, raw, strict=True):
        mask = np.zeros(len(x), bool)
        for i in range(len(x) - least + 1):
            if seen[x[i : i + least]] > 1:
                mask[i : i + least] = True
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[d, len(x), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~mask].tobytes()).hexdigest()] += 1
    return out


def repeats_of(df, least):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).hex()) for r in repeats.remove(df, least, digest=True).collect())


def test_repeats(spark, odd, empty, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 400)
    made = []
    for k in range(40):
        w = base.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = prose(rng, 1)
        made.append((1000 + k, " ".join(w[rng.randrange(200) :])))
    made += [(2000, "ab" * 300), (2001, "x" * 500), (2002, "\x00" * 450 + "y")]
    docs = odd.where("length(text) < 30000 or text is null").select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    for least in (60, 400):
        want = brute_repeats(texts_of(docs), least)
        assert repeats_of(docs, least) == want
    monkeypatch.setattr(repeats, "HOT_BYTES", 300)
    assert repeats_of(docs, 60) == brute_repeats(texts_of(docs), 60)
    assert repeats.remove(empty).count() == 0


def brute_passages(texts, least):
    words = [WORD.findall(x) for _, x in texts]
    seen = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = Counter()
    for (d, _), w in zip(texts, words, strict=True):
        hit = {k for i in range(len(w) - least + 1) if seen[tuple(w[i : i + least])] > 1 for k in range(i, i + least)}
        out[d, len(hit)] += 1
    return out


def test_repeated_passages(spark, odd, empty, monkeypatch):
    rng = random.Random(12)
    p, q = " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(55)), prose(rng, 160)
    assert len(p) < repeats.MIN
    made = [(3000, f"{prose(rng, 30)} {p} {prose(rng, 20)}"), (3001, f"{prose(rng, 8)}\n{p}"), (3002, p.replace(" ", "\n\t")), (3003, " ".join(p.split()[:50])), (3004, "ab " * 300)]
    for k in range(40):
        w = q.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = prose(rng, 1)
        made.append((4000 + k, " ".join(w[rng.randrange(60) :])))
    docs = odd.where("length(text) < 30000 or text is null").select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    rows = lambda words: repeats.remove(docs, digest=True, words=words).collect()
    got = rows(51)
    found = {r.doc_id: r for r in got}
    assert [found[k].n_passage_words for k in (3000, 3001, 3002, 3003, 3004)] == [55, 55, 55, 0, 300]
    assert [found[k].n_removed for k in (3000, 3001)] == [0, 0]
    assert Counter((r.doc_id, r.n_passage_words) for r in got) == brute_passages(texts_of(docs), 51)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).hex()) for r in got) == brute_repeats(texts_of(docs), 400)
    monkeypatch.setattr(repeats, "HOT_BYTES", 300)
    for words in (51, 9):
        assert Counter((r.doc_id, r.n_passage_words) for r in rows(words)) == brute_passages(texts_of(docs), words)
    assert repeats.remove(empty, words=51).count() == 0


def brute_groups(texts, least):
    """All maximal repeats, by extending every repeated window to both sides."""
    at = {}
    raw = [x.encode() for _, x in texts]
    for d, x in enumerate(raw):
        for i in range(len(x) - least + 1):
            at.setdefault(x[i : i + least], []).append((d, i))
    out, todo = set(), [(w, tuple(p)) for w, p in at.items() if len(p) > 1]
    while todo:
        w, places = todo.pop()
        before = {raw[d][i - 1] if i else (d, i) for d, i in places}
        after = {}
        for d, i in places:
            end = i + len(w)
            after.setdefault(raw[d][end : end + 1] or (d, i), []).append((d, i))
        if len(after) > 1 and len(before) > 1:
            out.add((len(w), tuple(sorted((texts[d][0], i) for d, i in places))))
        for x, own in after.items():
            if len(own) > 1:
                todo.append((w + x, tuple(own)))
    return out


def test_repeat_groups(spark, monkeypatch):
    rng = random.Random(10)
    p, q, r = prose(rng, 25), prose(rng, 25), prose(rng, 25)
    rows = [f"{prose(rng, 10)} {p}|{q}|{r} {prose(rng, 10)}", f"{prose(rng, 12)} {p}|{q}|{r}", f"{p}|{q} {prose(rng, 9)}", f"x{q}|{r}", f"x{q}|{r} tail"]
    rows += [prose(rng, 60)] * 3 + [f"é{p}{p}", "ab" * 90, prose(rng, 30), None, ""]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "doc_id long, text string")
    want = brute_groups([(d, x) for d, x in texts_of(docs)], 60)

    def groups():
        out = {}
        for x in repeats.repeat_groups(docs, 60).collect():
            out.setdefault((x.group, x.length), set()).add((x.doc_id, x.start))
        return {(length, tuple(sorted(places))) for (_, length), places in out.items()}

    got = groups()
    assert got == want
    covered = {}
    for length, places in got:
        for d, i in places:
            covered.setdefault(d, set()).update(range(i, i + length))
    removed = {x.doc_id: x.n_removed for x in repeats.remove(docs, 60).collect()}
    assert {d: len(covered.get(d, ())) for d in removed} == removed
    for name, value in (("HOT_BYTES", 200), ("GROUP_BYTES", 1500)):
        monkeypatch.setattr(repeats, name, value)
    assert groups() == want


def test_interval_tree():
    # banana: suffixes a, ana, anana, banana, na, nana
    got = set(t.interval_tree(np.array([0, 1, 3, 0, 0, 2]), np.array([ord("n"), ord("n"), ord("b"), -1, ord("a"), ord("a")]), 1))
    assert got == {(1, 2, 3), (0, 2, 1)}  # na is always after an a


# 6: licences.


def test_licenses(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licenses.train(docs, sample=500)
    rng = np.random.default_rng(99)  # other variants than those it was fitted on
    lines, classes = licenses.variants(rng, 5)
    rows = [(k, "some text before\n" + x) for k, x in enumerate(lines)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).where("last = 1").collect()}
    names = [*licenses.FAMILIES, "unknown", None]
    assert np.mean([(found[k].family if k in found else None) == names[c] for k, c in enumerate(classes)]) > 0.95
    assert np.mean([r.confirmed for r in found.values() if r.family != "unknown"]) > 0.95
    tx = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    hits = licenses.scan(docs, model).join(tx, ["doc_id", "paragraph"]).collect()
    assert hits
    assert all(re.search("(?i)licen|rights", r.line) for r in hits if r.confirmed)
    assert licenses.scan(odd, model).count() == 0
    assert licenses.scan(empty, model).count() == 0
    assert licenses.train(empty).temperature > 0


# 7: decontamination.


def test_licences_in_paragraphs_and_unknown_ones(spark):
    rng = random.Random(51)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files, to deal in the\nSoftware without restriction"
    texts = [f"{prose(rng, 30)}\n\n{mit}\n\n{prose(rng, 30)}", "Licensed under the Eclipse Public License, version 2.0", "Distributed under the Boost Software License, Version 1.0", "Licensed under the EUPL License", prose(rng, 300), f"{prose(rng, 9)}\nLicensed under the Apache License, Version 2.0\n{prose(rng, 9)}"]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    model = licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {}
    for r in licenses.scan(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.family, r.confirmed, r.paragraph, r.last) for r in got[0]] == [("MIT", True, 2, 4)]
    assert [[r.family for r in got[k]] for k in (1, 2, 3)] == [["unknown"]] * 3
    assert 4 not in got and [(r.family, r.paragraph, r.last) for r in got[5]] == [("Apache", 1, 1)]


def test_fm_index():
    rng = np.random.default_rng(8)
    for _ in range(20):
        x = np.append(rng.integers(0, 5, rng.integers(1, 200)), 0)
        index = decontaminate.FMIndex(x, 4)
        for m in (1, 2, 3, 5):
            p = rng.integers(1, 5, m)
            low, high = index.search(np.concatenate([np.zeros(2, int), p])[None, :])
            want = [i for i in range(len(x) - m + 1) if (x[i : i + m] == p).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def brute_hits(texts, items, width=10):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = {}
    for name, x in items:
        w = words(x)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(name))
    out = Counter()
    for d, x in texts:
        w, hit, found = words(x), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        out[d, len(w), len(hit), len(found), tuple(sorted(found))] += 1
    return out


def test_decontamination(spark, odd, empty):
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randint(8, 30))) for k in range(30)] + [(30, "Tail"), (31, None), (32, ""), (2, "a B c"), (33, "a b c")]
    some = [(500 + k, prose(rng, 20) + " " + items[rng.randrange(30)][1].upper() + ". " + prose(rng, 9)) for k in range(40)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(some, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in decontaminate.scan(docs, bench).collect())
    assert got == brute_hits(texts_of(docs), items)
    clean = decontaminate.clean(odd, bench)
    assert clean.schema == odd.schema
    assert clean.count() == sum(n for k, n in brute_hits(texts_of(odd), items).items() if not k[2])
    assert decontaminate.scan(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan(empty, bench).count() == 0


def test_decontamination_query(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_hits(texts_of(docs), [(r.item_id, r.text) for r in bench.collect()])
    got = queries.op7_decontaminate(spark, SF).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter({(d, n, h, k, hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0): c for (d, n, h, k, x), c in want.items()})
    assert any(r.contaminated for r in got)


def test_decontamination_in_passes(spark, odd, monkeypatch):
    rng = random.Random(41)
    items = [(f"i{k}" if k else None, prose(rng, rng.choice([0, 3, 25]))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [(k, f"{prose(rng, 20)} {items[k % 40][1].upper()} {prose(rng, 9)} {items[(k + 3) % 40][1]}") for k in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows = lambda x: Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in x.collect())
    want, clean = rows(decontaminate.scan(docs, bench)), decontaminate.clean(docs, bench).count()
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 100)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    assert rows(decontaminate.scan(docs, bench)) == want and sum(n for r, n in want.items() if r[2]) >= 40
    assert decontaminate.clean(docs, bench).count() == clean


# 8: mixing.


def test_targets():
    sizes = {"a": 1000, "b": 10, "c": 500, None: 400}
    got = mixing.targets(sizes)
    assert got["b"] == 20
    assert sum(got.values()) == Fraction(3, 2) * sum(sizes.values())
    assert got["a"] / 5 == got[None] / 5 or got[None] == 800 or got["a"] == 2000
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0}) == {"a": 0}


def test_flow_prefers_new_words():
    # Documents of both sources can serve either; repeating them is the last resort.
    flow = mixing.min_cost_flow({"x": 100, "xy": 100, "y": 10}, {"x": ["x"], "xy": ["x", "y"], "y": ["y"]}, {"x": 100, "y": 110})
    used = Counter()
    for (p, s), v in flow.items():
        used[p] += v
        used["to", s] += v
    assert (used["x"], used["xy"], used["y"]) == (100, 100, 10)
    assert (used["to", "x"], used["to", "y"]) == (100, 110)


def test_fill():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 30, 400):
        x = rng.integers(0, 300, n)
        for gap in (0, 1, int(x.sum()) // 3, max(0, int(x.sum()) - 1)):
            c = mixing.fill(x, gap, 2)
            assert c.max(initial=0) <= 2
            assert n < 30 or abs(int((c * x).sum()) - gap) <= max(3, 0.003 * gap)
    assert mixing.fill(np.array([5, 7, 11]), 12).tolist() == [1, 1, 0]
    assert mixing.fill(np.array([100, 90]), 185, 2).tolist() in ([1, 1], [0, 2])


def test_mixture(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixture(docs).collect()
    sizes = Counter()
    text = {r.doc_id: r for r in docs.collect()}
    for d, r in text.items():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target = mixing.targets(sizes)
    taken = Counter()
    assert len(rows) == len(text)
    for r in rows:
        assert r["size"] == len(WORD.findall(text[r.doc_id].text or ""))
        assert r.source_size == sizes[r.source]
        assert r.target == float(target[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - float(target[s])) <= 0.01 * float(target[s]) for s in target)
    again = {r.doc_id: r.taken for r in mixing.mixture(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == Counter({r.doc_id: r.taken // r["size"] for r in rows if r.taken})
    assert mixing.mixture(odd).count() == odd.count()
    assert mixing.mixed(odd).schema == odd.schema
    assert mixing.mixture(empty).count() == mixing.mixed(empty).count() == 0
    assert mixing.n_words(F.lit("")) is not None


def test_mixture_of_overlapping_sources(spark, monkeypatch):
    """Shared documents serve the source that lacks words; nothing is repeated while new words are left."""
    rows = [(k, None, "w " * 50, own) for k, own in enumerate([["a"]] * 40 + [["a", "b"]] * 60 + [["b"]] * 20 + [None, []])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, own array<string>")
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 7)
    monkeypatch.setattr(mixing, "MAX_BUCKETS", 3)
    options = {"weights": (1, 1), "share": Fraction(3, 4)}
    got = mixing.mixture(docs, F.col("own"), **options).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        taken[tuple(r.sources)] += r.taken
        assert r.taken <= r["size"] or not r.taken  # 4500 of 6000 words: no repetition
    quota = {tuple(r.sources): r.quota for r in got}
    assert sum(quota.values()) == 4500 and quota["a",] + quota["a", "b"] >= 2250 and quota["b",] + quota["a", "b"] >= 2250
    assert quota[()] == 0 and all(abs(taken[p] - n) <= 25 for p, n in quota.items())
    copies = Counter(r.doc_id for r in mixing.mixed(docs, F.col("own"), **options).collect())
    assert copies == Counter({r.doc_id: r.taken // r["size"] for r in got if r.taken})


def test_mixed_takes_of_repeated_rows_what_the_mixture_says(spark):
    rows = [(k // 3, "a" if k % 2 else "b", "x " * (3 + k // 6)) for k in range(60)] + [(None, "a", "y " * 7)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sum(r.taken for r in mixing.mixture(docs).collect())
    assert sum(len(r.text.split()) for r in mixing.mixed(docs).collect()) == want


# 9: Jaccard join.


def brute_join(texts):
    sets = []
    for _, x in texts:
        w = WORD.findall(x)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    lead = {}
    for k, (d, _) in enumerate(texts):
        if d is not None:
            lead[find(k)] = min(d, lead.get(find(k), d))
    return Counter((d, lead.get(find(k)), links[k], len(sets[k])) for k, (d, _) in enumerate(texts)), len({find(k) for k in range(len(sets))})


def families(spark, rng, n, each):
    rows = []
    for f in range(n):
        base = prose(rng, rng.choice([8, 40, 200])).split()
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 50))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((len(rows) + 5000, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def check_join(df):
    want, n = brute_join(texts_of(df))
    got = Counter(tuple(r) for r in jaccard_join.join(df).collect())
    assert got == want
    assert jaccard_join.keep_one(df).count() == n


def test_join(spark, odd, empty):
    check_join(odd.select("doc_id", "text").unionByName(families(spark, random.Random(21), 12, 12)))
    assert jaccard_join.keep_one(odd).schema == odd.schema
    assert jaccard_join.join(empty).count() == jaccard_join.keep_one(empty).count() == 0


def test_join_splits_large_buckets(spark, monkeypatch):
    for name, value in (("SMALL", 6), ("BLOCK_ROWS", 9), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    check_join(families(spark, random.Random(22), 4, 40))


def test_join_of_texts_with_a_common_passage(spark, monkeypatch):
    """Large buckets that a passage makes, of texts that aren't alike, beside some that are."""
    for name, value in (("SMALL", 6), ("BLOCK_ROWS", 9)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(23)
    passage = prose(rng, 60)
    rows = [f"{prose(rng, 60)} {passage}" for _ in range(60)]
    rows += [x.replace(x.split()[3], "changed", 1) for x in rows[:12]]
    check_join(spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "doc_id long, text string"))


def test_sketch_keeps_pairs_at_the_limit():
    """Of pairs of similarity 0.8 and few shingles, the sketch passes nearly all; of unlike ones few."""
    rng = np.random.default_rng(5)
    lost = found = 0
    for n in (64, 90, 200):
        for _ in range(400):
            common = int(np.ceil(n * 8 / 9))
            x = rng.integers(0, 2**63, 3 * n).astype(np.uint64)
            a, b, c = np.sort(x[:n]), np.sort(np.concatenate([x[:common], x[n : 2 * n - common]])), np.sort(x[2 * n :])
            h, at = np.concatenate([a, b, c]), np.array([0, n, 2 * n, 3 * n])
            s = jaccard_join.sketches(h, at)
            size = np.full(3, n)
            one, two = np.array([0, 0]), np.array([1, 2])
            may = jaccard_join._may_link(size, s[:, 0].copy(), s[:, 1].copy(), one, two)
            lost += not may[0]
            found += bool(may[1])
    assert lost <= 2 and found <= 20
    bits, splits = jaccard_join.sketch_splits(10**9)
    assert bits > jaccard_join.sketch_splits(1000)[0] and splits > jaccard_join.sketch_splits(1000)[1]


def test_join_finds_the_pairs_of_a_corpus(spark):
    """Against all pairs of sf0.001, brute force: more than 0.9 of the links, and no other ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want, _ = brute_join(texts_of(docs))
    got = Counter(tuple(r) for r in jaccard_join.join(docs).collect())
    links = lambda x: sum(r[2] * n for r, n in x.items())
    assert 0.9 * links(want) < links(got) <= links(want)


def test_runs():
    assert jaccard_join.runs_needed(0.999) > jaccard_join.runs_needed(0.9) >= 1


# 10: URL filter.


def brute_url(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "https://example.org", "http://example.com/de/1", "http://xcom/de/", "ftp://com/fr/a://b", "http://m.x.example.net/a/index.html?utm_source=q&b=2&a=1",
        "https://x.example.net/a?a=1&b=2", "http://x.example.net/other", "http://com#f", "http://É.com/de/é", "http://x.example.net/a/?b=2&a=1&ref=z", "http://x.example.net/a/?b=2&a=1&ref=z",
    ]
    pages = spark.createDataFrame([(k, u, "h", "c") for k, u in enumerate(urls)], "page_id long, url string, host string, canon string")
    listed = spark.createDataFrame([("https://www.x.example.net/a?b=2&a=1",), (None,), ("junk",)], "url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, listed, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == (verdict or ("block" if k in (9, 10, 14, 15) else "allow")), u
    assert {r.verdict for r in url_filter.filter_urls(pages, listed.limit(0), ()).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), listed, queries.URL_RULES).count() == 0


def test_bloom_has_no_false_negatives(spark):
    urls = spark.range(3000).select(F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".net/x")).alias("url"))
    pages = urls.select(F.monotonically_increasing_id().alias("page_id"), "url")
    assert url_filter.filter_urls(pages, urls, ()).where("verdict = 'block'").count() == 3000
    others = pages.withColumn("url", F.concat("url", F.lit("y")))
    assert url_filter.filter_urls(others, urls, ()).where("verdict = 'block'").count() == 0
