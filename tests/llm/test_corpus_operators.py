"""Each operator against brute force on a table of odd cases and on the smallest documents."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import lm, merkle, mixing, near_dedup, neighbours, suffix_dedup, token_file, tokens, toxicity
from quillgraph.llm.base import word_codes
from quillgraph.llm.components import components
from quillgraph.llm.queries import QUERIES
from quillgraph.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, chunk string, ids string, score string"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(text):
    return (text or "").encode().lower().split()


def _odd_rows():
    rng = random.Random(5)
    vocab = ["ba", "Du", "ki", "lo", "mé", "no", "zu", "ta", "re", "xi", "Über", "日本", "a1"]
    long = " ".join(rng.choice(vocab) + rng.choice(vocab) for _ in range(4000))
    base = " ".join(rng.choice(vocab) + rng.choice(vocab) for _ in range(120))
    passage = " ".join(f"shared{i} passage word" for i in range(25))
    texts = [None, "", "   ", "\n", "one", "two words", "two words", "ONE", base, base, base.replace("ba", "bo", 1), base + " end", long, long[:9000] + " x " + long[9000:],
             passage, "intro " + passage + " outro", "other start " + passage, "ab" * 300, "a" * 400, "x y  z\n\n w", " lead", "trail ", "tab\tsep\r\nline", " ", "a   b",
             "don't 123 ... <|endoftext|> é", "\x1c\x1d odd", base.upper()]
    rows = [(i * 3 - 6, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "k", "c", "i", "s") for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), rows[8], (rows[9][0], passage, "en", "s1", 3, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()] if not cols else [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


# ---------------------------------------------------------------- near duplicates


def shingles(text, size):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute_components(pairs, size, percent):
    sets = [(i, shingles(t, size)) for i, t in pairs]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is None or j is None or not x or not y:
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else find(i) if s else i) for i, s in sets]


@pytest.mark.parametrize("size,percent,tile,check", [(3, 85, 2048, 512), (5, 80, 2, 2)])
def test_near_duplicates_match_brute_force(odd, docs, size, percent, tile, check):
    p = near_dedup.Params(size, percent, tile=tile, verify_tile=check)
    for df in (odd, docs):
        got = rows_of(near_dedup.near_duplicates(df, p), "doc_id", "n_shingles", "component_id", "kept")
        want = brute_components(rows_of(df), size, percent)
        assert Counter(g[:3] for g in got) == Counter(want)
        assert all(k == (i is None or i == c) for i, _, c, k in got)


def test_near_duplicates_of_a_chain_of_copies(spark):
    """Members far from their bucket's least member are still linked through others."""
    rng = random.Random(3)
    rows, w = [], [f"w{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(60):
        rows.append((i, " ".join(w)))
        for _ in range(2):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(near_dedup.near_duplicates(df, near_dedup.Params(3, 85, tile=16, verify_tile=16)), "doc_id", "n_shingles", "component_id")
    assert Counter(got) == Counter(brute_components(rows, 3, 85))


def test_words_of_a_slice_are_those_of_its_texts():
    texts = pa.array([None if i % 11 == 0 else f"Über A{i} {'bC ' * (i % 4)}" for i in range(60)])
    for part in (texts.slice(7, 20), texts.cast(pa.large_string()).slice(9), texts.slice(5).cast(pa.large_string()), pa.array(texts.drop_null().to_pylist()).slice(12, 30), pa.chunked_array([texts.slice(20, 5), texts.slice(3, 9)])):
        codes, hashes, sizes = word_codes(part)
        want = [words(t) for t in part.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want]
        assert hashes[codes].tolist() == [xxhash.xxh64_intdigest(x) for w in want for x in w]


def test_near_duplicates_of_more_text_than_one_slice(spark):
    """Documents of a partition with over 8 MB of text keep their own sets: only planted copies are linked."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(25_000)) for _ in range(60)]
    texts += [texts[3].upper(), texts[55] + " end", "One two three four", "five six Seven eight", "one two three FOUR"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sum(map(len, texts)) > 8 << 20
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, near_dedup.Params(3, 85)).collect()}
    assert got == {i: (len(shingles(t, 3)), {60: 3, 61: 55, 64: 62}.get(i, i)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [24, 10])
def test_rows_that_may_be_among_ids(spark, most):
    """Both parts together are the rows; none of the ids is in the second."""
    rows = spark.range(-500, 9500).select(F.col("id").alias("doc_id"), F.lit(1).alias("word"), F.lit("x").alias("bits"))
    ids = spark.range(0, 9000, 9)
    some, others = near_dedup.may_hold(rows, "doc_id", ids, most)
    a, b = ([r["doc_id"] for r in x.collect()] for x in (some, others))
    assert sorted(a + b) == list(range(-500, 9500)) and set(range(0, 9000, 9)) <= set(a)
    assert some.columns == rows.columns and (most < 24 or len(a) < 2000)
    assert near_dedup.may_hold(rows, "doc_id", ids.limit(0))[1].count() == 10000


def test_empty_tables(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert tokens.length_histogram(tokens.encoded_lengths(empty, MULTI)).count() == 0
    assert token_file.read_ids(token_file.write_ids(empty, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    assert tokens.decode(tokens.encode(empty, MULTI), MULTI).count() == 0
    assert lm.backoff_scores(empty).count() == 0
    assert merkle.edit_likeness(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty.select("doc_id", "text"), toxicity.fit(empty, labels)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (500, 400), (400, 500)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long")), "id", "component"))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 500: 400, 400: 400}


def test_components_write_few_files_and_no_round_for_stars(spark):
    """Each file costs an executor two child processes; edges that are stars already are written once."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir
    files = lambda: {f for f in Path(folder().get().removeprefix("file:")).rglob("part-*")} if folder().isDefined() else set()
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        stars = [(100, i) for i in range(101, 130)] + [(3, 2), (9, 2)]
        for edges, rounds, want in ((stars, 0, {**{i: 100 for i in range(100, 130)}, 2: 2, 3: 2, 9: 2}), ([(1, 5), (5, 7), (3, 7)], 3, {1: 1, 3: 1, 5: 1, 7: 1})):
            before = files()
            got = components(spark.createDataFrame(edges, "a long, b long"))
            assert 0 < len(files() - before) <= 8 * (1 + rounds)
            assert dict(rows_of(got, "id", "component")) == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


# ---------------------------------------------------------------- repeated strings


def brute_repeats(pairs, length):
    order = sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), []
    for i, t in order:
        b = (t or "").encode()
        off = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                off[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for k in range(len(b)) if off[k] and (k == 0 or not off[k - 1]))
        out.append((i, len(b), sum(off), spans, hashlib.sha256(bytes(x for x, o in zip(b, off, strict=True) if not o)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("params", [{}, {"hot_anchor": 1, "chunk": 20_000}, {"length": 20, "gram": 7}])
def test_repeats_match_brute_force(odd, docs, params):
    p = suffix_dedup.Params(**params)
    for df in (odd, docs):
        got = rows_of(suffix_dedup.remove_repeats(df, p), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert Counter(got) == brute_repeats(rows_of(df), p.length)


def test_replacement_characters_outside_repeats_stay(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    passage = "".join(f"shared {i} " for i in range(20))
    rows = [(1, "\ufffdé" + passage + "à"), (2, "a\ufffdb è" + passage + "á \ufffd end"), (3, "c\ufffd")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.cut_repeats(spark, docs, small).collect()}
    # the passage repeats with the lead byte of the character after it, which goes whole
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("a\ufffdb è \ufffd end", 11), 3: ("c\ufffd", 2)}


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        t = np.r_[rng.integers(1, k + 1, n), 0].astype(np.uint16)
        s = t.tolist()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        sa = suffix_array(t, k + 1)
        assert sa.tolist() == want
        lcp = common_prefixes(t, sa)
        for x in range(1, len(s)):
            a, b = s[want[x - 1] :], s[want[x] :]
            assert lcp[x] == next(c for c in range(len(s) + 1) if c >= len(a) or c >= len(b) or a[c] != b[c])


# ---------------------------------------------------------------- tokens


def test_encoding_is_that_of_the_library_and_round_trips(odd, docs):
    ranks = tokens.read_ranks(MULTI)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd, docs):
        got = rows_of(tokens.decode(tokens.encode(df, MULTI), MULTI), "doc_id", "ids", "decoded")
        want = [(i, t or "") for i, t in rows_of(df)]
        assert Counter((i, tuple(x), bytes(b)) for i, x, b in got) == Counter((i, tuple(e.encode_ordinary(t)), t.encode()) for i, t in want)


def test_round_trip_of_the_pipeline_takes_one_worker_a_task(spark, odd, docs, small):
    for df in (odd, docs):
        got, want = (Counter((i, tuple(x), bytes(b)) for i, x, b in rows_of(d, "doc_id", "ids", "decoded")) for d in (tokens.encode_and_decode(df, MULTI), tokens.decode(tokens.encode(df, MULTI), MULTI)))
        assert got == want
    plan = pytest.importorskip("corpus_pipeline").encode(spark, docs, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_fold_of_long_words_and_the_native_fold(spark):
    ranks = tokens.read_ranks(MULTI)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for n in (65, 300, 5000):
        w = "".join(rng.choice("abcdeé") for _ in range(n))
        assert tokens.fold_word(w.encode(), ranks) == e.encode_ordinary(w)
        assert tokens.fold_word(b"a" * n, ranks) == e.encode_ordinary("a" * n)
    some = [" " + "".join(rng.choice("abcdefgéß") for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["a", "é", "the"]
    df = spark.createDataFrame([(w,) for w in some], "w string").select("w", tokens.fold_native(F.col("w").cast("binary"), ranks).alias("ids"))
    assert all(list(r["ids"]) == e.encode_ordinary(r["w"]) for r in df.collect())


def test_encoders_are_the_libraries_on_random_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    plain = public_tokenizers.path("byte_bpe_50k.tiktoken")
    alike = lambda ranks: tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(ranks), special_tokens={})
    rng = random.Random(4)
    texts = ["Title\n\xa0\xa0Text follows", "a\n\t\tb c", "a\t \tb c", "x\xa0 \u3000y", "a\n\xa0b", "a\u2003\u2003\nb", "a\r\n\r\nb", "\x1c \x1cb", "\xa0", "a\tb", "a\u2028 b", "", "\n", " "]
    some = ["a", "bc", "the", "Ab", "É", "日", ".", ",", "!?", "_", "'s", "'ll", "'", "7", "²", "\u0301", "\u200b", "\ufeff", "\x00", "😀", "<|endoftext|>"]
    some += [" ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 12))) for _ in range(100_000)]
    texts += [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(300_000)), "x" * 100_000 + " .\n" * 5000]
    ids = lambda e: [np.frombuffer(b, "<i4").tolist() for a in range(0, len(texts), 5000) for b in e.batch(texts[a : a + 5000])]
    assert ids(tokens.library_encoder(path, public_tokenizers.PATTERN)) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for make, ranks in ((tokens.rank_encoder, plain), (tokens.fold_encoder, MULTI)):
        assert ids(make(ranks, public_tokenizers.PATTERN)) == alike(ranks).encode_ordinary_batch(texts)


def test_units_are_encoded_together_as_the_library_does():
    """Blanks of all kinds at the ends of units; no unit is left to the cache but those that end in one."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokens.library_encoder(path, public_tokenizers.PATTERN)
    assert {c for c in map(chr, range(0x110000)) if re.match(r"\s", c)} == {c for c in map(chr, range(0x3100)) if pc.match_substring_regex(pa.array([c]), tokens._BLANK)[0].as_py()}
    rng = random.Random(2)
    some = ["a", "B", "é", "日", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u2003", "'s", "1", "²", ".", "!?", "ab cd", "don't", "\u200b", "<|endoftext|>", "Ⅷ", "\u0301", "😀", "\u3000", "yz ", "q\n"]
    for _ in range(30):
        texts = ["".join(rng.choices(some, k=rng.randrange(30))) for _ in range(60)]
        assert own.batch(texts) == [np.array(e.ids, "<i4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    own.known.clear()
    own.batch(["plain words, that no cache holds\nnow "])
    assert set(own.known) <= {"", "\n"}


def test_encoders_forget_units_without_changing_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 40)
    e = alike = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(MULTI), special_tokens={})
    own = tokens.Encoder(public_tokenizers.PATTERN, lambda pieces: [np.array(e.encode_ordinary(x), "<i4").tobytes() for x in pieces])
    rng = random.Random(8)
    for _ in range(60):
        texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) + rng.choice(["", ".", "\n"]) + rng.choice(["", "x"]) for _ in range(20)) for _ in range(3)]
        assert [np.frombuffer(b, "<i4").tolist() for b in own.batch(texts)] == [alike.encode_ordinary(t) for t in texts]
        assert len(own.known) + len(own.old) <= 4 * 60


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(odd, docs, kind):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (odd, docs):
        files = token_file.write_ids(df, public_tokenizers.path("byte_bpe_50k.json"), kind=kind)
        got = sorted(rows_of(token_file.read_ids(files), "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r[1])
        order = sorted(rows_of(df), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, (r[1] or "").encode())))
        at, want = 0, []
        for i, x in order:
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == want


def test_token_file_random_access():
    rng = np.random.default_rng(0)
    for kind in ("byte", "bit"):
        sink = io.BytesIO()
        w = token_file.Writer(sink, kind, block=100)
        docs = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 3, 99, 100, 350, 1)]
        for i, d in enumerate(docs):
            w.add(i if i else None, d)
        w.close()

        class Source(io.BytesIO):
            def size(self):
                return len(self.getvalue())

        r = token_file.Reader(Source(sink.getvalue()))
        flat = np.concatenate(docs)
        assert all((a[1] == b).all() and a[0] == (i or None) for i, (a, b) in enumerate(zip(r.documents(), docs, strict=True)))
        for a, b in ((0, 0), (0, 553), (99, 101), (250, 251), (552, 553)):
            assert (r.read(a, b) == flat[a:b]).all()


def test_length_histogram_answers_every_limit(odd, docs):
    ranks = tokens.read_ranks(MULTI)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd, docs):
        n = sorted(len(e.encode_ordinary(t or "")) for _, t in rows_of(df))
        h = tokens.length_histogram(tokens.encoded_lengths(df, MULTI), coarse=64).cache()
        for r in h.collect():
            x = r["n_tokens"]
            assert r["n_docs"] == n.count(x) and r["docs_up_to"] == sum(v <= x for v in n) and r["docs_from"] == sum(v >= x for v in n)
            assert r["tokens_up_to"] == sum(v for v in n if v <= x) and r["tokens_from"] == sum(v for v in n if v >= x)
            assert r["truncated_total"] == sum(min(v, x) for v in n) and r["quantile"] == pytest.approx(r["docs_up_to"] / len(n))
        assert h.count() == len(set(n))
        limits = [0, 1, 7, 100, 10**6]
        assert rows_of(tokens.answer(h, limits), "context", "docs_over", "truncated_total") == [(c, sum(v > c for v in n), sum(min(v, c) for v in n)) for c in limits]


# ---------------------------------------------------------------- mixing


def test_mixture_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choices(["big", "mid", "tiny", None], [80, 15, 3, 2])[0]) for i in range(1500)] + [(None, "a b", "big"), (3, None, "mid"), (3, None, "mid"), (9999, "", "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s or ""] += len(words(t))
    total = sum(size.values())
    sources = spark.createDataFrame(list(size.items()), "source string, tokens long")
    a, table = mixing.mixture(sources, 0.9, 1000.0)
    w = {r["source"]: r["weight"] for r in table.collect()}
    entropy = -sum(x * math.log(x) for x in w.values() if x)
    assert 0 < a < 1 and entropy == pytest.approx(0.9 * math.log(4), abs=1e-4) and w["void"] == 0
    a, table = mixing.mixture(sources, 1.0, 3.0)
    repeats = {r["source"]: r["weight"] * total / r["tokens"] for r in table.collect() if r["tokens"]}
    assert max(repeats.values()) == pytest.approx(3.0, abs=1e-3)
    taken = mixing.mix(df, 0.9, 1000.0, block_tokens=500).collect()
    budget = {r["source"]: r["budget"] for r in mixing.mixture(sources, 0.9, 1000.0)[1].collect()}
    for s in ("big", "mid", "tiny", ""):
        own = sorted((r for r in taken if r["source"] == s), key=lambda r: (r["start"], r["start"] + r["n_tokens"]))
        at = 0
        for r in own:  # the stream has no gap and no overlap, and stops at its budget
            assert r["start"] == at
            at += r["n_tokens"]
        assert budget[s] <= at < budget[s] + 60
        once = Counter(r["doc_id"] for r in own if r["epoch"] == 0)
        if budget[s] >= size[s]:
            assert once == Counter(i for i, _, x in rows if (x or "") == s)


def test_mixed_documents_keep_every_document(odd):
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(odd).collect())
    want = Counter(rows_of(odd))
    assert all(got[k] >= want[k] for k in want) and set(got) == set(want)


# ---------------------------------------------------------------- toxicity


def test_folding_and_exceptions():
    assert toxicity.fold("ⅰD1ОТ, Ѕtup!d s c u m you") == ["ⅰdiot", "stupid", "scum", "you"] or toxicity.fold("1D1ОТ Ѕtup!d s c u m you") == ["idiot", "stupid", "scum", "you"]
    x = toxicity.Lexicon({"idiot ": 2.0, "stup": 1.5}, frozenset({("not", "idiot")}), (-3.0, 4.0))
    assert x.weight("what an 1di0t") == pytest.approx(2 / (1 + math.log1p(3 / 200)))
    assert x.weight("not idiot") == 0 and x.weight("idiotic") == 0 and x.weight("stupefy") > 0 and x.weight("") == 0
    assert x.score("an idiot") > 0.5 > x.score("fine")
    long = "fine " * 2000
    assert x.weight("idiot " + long) < x.weight("idiot fine")


def test_toxicity_on_held_out_labels(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in rows_of(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "toxic") if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)
    assert not any(p and not y for p, y in held)


def test_toxicity_does_not_see_held_out_labels(spark, odd):
    labels = spark.createDataFrame([(i, 0, 1) for i in range(-6, 80) if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd, labels).terms == {}
    scored = toxicity.score(odd.select("doc_id", "text"), toxicity.Lexicon({"ba": 9.0}, curve=(-2.0, 3.0)))
    assert scored.count() == odd.count() and scored.filter("text IS NULL AND predicted = 1").count() == 0


def test_few_toxic_labels_teach_their_plain_words(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    toxic = dict(rows_of(spark.read.parquet(f"{small}/labels.parquet"), "doc_id", "toxic"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, small).collect()}
    plain = {"disgusting", "loser", "moron", "scum", "trash"}
    rude = {i for i, t in rows_of(docs) if toxic.get(i) == 1 and plain & {w.decode().strip(".,;:!?") for w in words(t)}}
    assert len(rude) >= 5 and not rude & kept
    assert {i for i, y in toxic.items() if not y} & {i for i, _ in rows_of(docs)} <= kept


def test_support_follows_the_share_of_toxic_rows():
    counts = {(3, 0): 900, (3, 3): 20, (4, 0): 690, (4, 4): 12}
    assert toxicity.telling(counts, 0.147) == {(4, 4)}
    assert toxicity.telling(counts, 0.01) == {(3, 3), (4, 4)} and toxicity.telling(counts, 0.5) == set()
    assert toxicity.telling({(2, 2): 5}, 1e-6) == set()


# ---------------------------------------------------------------- language model


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def brute_scores(rows, m2, m3):
    """Scores by plain dictionaries: the interpolated model, word by word."""
    end, start = ("end",), ("start",)
    seqs = [(i, t, [start, *words(t), end]) for i, t in rows]
    train = [w for i, _, w in seqs if not held(i)]
    c1 = Counter(x for w in train for x in w[1:])
    c2 = Counter(p for w in train for p in zip(w, w[1:], strict=False))
    c3 = Counter(p for w in train for p in zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c1.values()), len(c1)
    n1, n2 = (sum(1 for x in c1.values() if x == k) for k in (1, 2))
    d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.1
    hist = lambda h: c1[end] if h == start else c1[h]
    p1 = lambda x: (c1[x] - d) / n if c1[x] else d * v / n if n else 1.0
    p2 = lambda h, x: (c2[h, x] + m2 * p1(x)) / (hist(h) + m2)
    p3 = lambda u, h, x: (c3[u, h, x] + m3 * p2(h, x)) / (c2[u, h] + m3)
    out = []
    for i, _, w in seqs:
        base = sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w[1:])
        score = math.log10(p2(w[0], w[1])) + sum(math.log10(p3(*x)) for x in zip(w, w[1:], w[2:], strict=False))
        out.append((i, held(i), len(w) - 1, sum(c1[x] > 0 for x in w[1:]), n, base, score))
    some = [(start, None)] + [(x, u) for w in train[:3] for u, x in list(zip(w, w[1:-1], strict=False))[:40]]
    for h, u in some:  # the model sums to one after every history
        p = (lambda x: p2(h, x)) if u is None else (lambda x: p3(u, h, x))  # noqa: B023
        rest = d * v / n * m2 / (hist(h) + m2) * (1 if u is None else m3 / (c2[u, h] + m3))
        assert sum(map(p, c1)) + rest == pytest.approx(1)
    likely = {}
    for a, b in lm.PRIORS:
        total = 0.0
        for w in train:
            for k in range(1, len(w)):
                x, h = w[k], w[k - 1]
                p = (c1[x] - 1 - d) / (n - 1) if c1[x] > 1 else d * v / n
                p = (c2[h, x] - 1 + a * p) / (hist(h) - 1 + a)
                if k > 1:
                    p = (c3[w[k - 2], h, x] - 1 + b * p) / (c2[w[k - 2], h] - 1 + b)
                total += math.log10(p)
        likely[a, b] = total
    return out, likely


def _as_numbers(r):
    return tuple((x is not None, x) for x in r[:5]), tuple(round(x, 4) for x in r[5:])


def test_scores_follow_the_model(odd, docs):
    for df in (odd, docs):
        got = lm.backoff_scores(df).collect()
        m2, m3 = got[0]["prior"]
        want, likely = brute_scores(rows_of(df), m2, m3)
        assert max(likely, key=likely.get) == (m2, m3)
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        have = sorted((tuple(r[c] for c in names) for r in got), key=_as_numbers)
        want = sorted(want, key=_as_numbers)
        assert [h[:5] for h in have] == [w[:5] for w in want]
        for h, w in zip(have, want, strict=True):
            assert h[5:] == pytest.approx(w[5:], abs=1e-4)


def test_pieces_of_a_document_are_read_like_the_whole(docs, monkeypatch):
    """The traversal ends in the same states and arcs whatever the pieces that are read side by side."""
    import pyarrow as pa

    rows = [(i, t or "", held(i)) for i, t in rows_of(docs)]
    g = lm._Grams(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "held_out": [r[2] for r in rows]}))
    word, pair = g.counts(g.token, g.symbols)[0].astype(int), g.counts(g.pair_of, len(g.pair))[0].astype(int)
    triple = g.counts(g.triple_of, len(g.triple), np.flatnonzero(g.inner))[0].astype(int)
    word[g.start] = word[g.end]
    machine = lm.Automaton(g, word, pair, triple)
    monkeypatch.setattr(lm, "PIECE", 1 << 20)
    states, taken = machine.read(g.token, g.first, g.sizes, g.start)
    for piece in (1, 2, 3, 64):
        monkeypatch.setattr(lm, "PIECE", piece)
        again = machine.read(g.token, g.first, g.sizes, g.start)
        assert (again[0] == states).all() and (again[1] == taken).all()
    naive = dict(zip(machine.arcs.tolist(), range(len(machine.arcs)), strict=True))
    for a, n in zip(g.first[:40].tolist(), g.sizes[:40].tolist(), strict=True):  # one state after the other
        s = int(machine.enter[g.start])
        for at in range(a, a + n):
            w = int(g.token[at])
            assert states[at] == s
            while s and s * machine.symbols + w not in naive:
                s = int(machine.fail[s])
            arc = naive.get(s * machine.symbols + w, -1)
            assert taken[at] == arc
            s = int(machine.target[arc]) if arc >= 0 else int(machine.enter[w])


def test_numbers_do_not_depend_on_the_order_of_rows(docs):
    import pyarrow as pa

    rows = [(i, t or "", held(i)) for i, t in rows_of(docs)]
    made = []
    for own in (rows, rows[::-1]):
        g = lm._Grams(pa.table({"doc_id": [r[0] for r in own], "text": [r[1] for r in own], "held_out": [r[2] for r in own]}))
        made.append((g.word, g.pair, g.triple, g.triple_first, g.triple_last, *g.counts(g.triple_of, len(g.triple), np.flatnonzero(g.inner))))
    assert all((a == b).all() for a, b in zip(*made, strict=True))


def test_copies_are_likelier_than_their_like(spark, docs):
    """Held-out documents that training holds too are told from those that it does not."""
    rows = [(i, t) for i, t in rows_of(docs) if len(words(t)) > 40]
    texts = list({t: i for i, t in rows if not held(i)})
    fresh = [i for i in range(10**6, 10**6 + 2000) if held(i)][:20]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(list(zip(fresh, texts[:20], strict=True)), "doc_id long, text string"))
    got = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in lm.backoff_scores(more).collect()}
    known = {t for i, t in rows if not held(i)}
    alone = [got[i] for i, t in rows if held(i) and t not in known]
    assert min(got[i] for i in fresh) > np.median(alone)


def test_model_beats_its_base_on_held_out_documents(docs):
    held = [r for r in lm.backoff_scores(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# ---------------------------------------------------------------- fingerprints


def naive_tree(text):
    """Levels of (hash, bytes) by plain loops."""
    digest = lambda x: xxhash.xxh3_128(x).digest()
    if not text:
        return [[(digest(b""), 0)]]

    def asks(end, one_in):
        """end: the place after the last byte that is looked at."""
        back = [text[max(end - 1 - k, 0)] for k in range(4)]
        h = sum(x << 8 * k for k, x in enumerate(back))
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
        return (h ^ h >> 31) % one_in == 0

    ends = {len(text)} | {i + 1 for i, c in enumerate(text) if c == 10 or c == 32 and i and asks(i, 3)}
    last = 0
    for e in sorted(ends):
        if e - last > 256:
            ends |= {i + 1 for i in range(last + 8, e - 8) if asks(i + 1, 32)}
        last = e
    last = 0
    for e in sorted(ends):
        ends |= set(range(last + 256, e, 256))
        last = e
    level, at = [], 0
    for e in sorted(ends):
        level.append((digest(text[at:e]), e - at, text[e - 1] == 10))
        at = e
    levels = [[x[:2] for x in level]]
    closes = [line or h[0] % 16 == 0 for h, _, line in level]
    while True:
        up, own = [], []
        for node, close in zip(levels[-1], closes, strict=True):
            own.append(node)
            if close or len(own) == 32:
                up.append(own)
                own = []
        up += [own] if own else []
        if len(up) == len(levels[-1]) and len(levels) > 1:
            up = [levels[-1]]
        levels.append([(digest(b"".join(h for h, _ in x)), sum(n for _, n in x)) for x in up])
        if len(levels[-1]) == 1:
            return levels
        closes = [h[1] % 4 == 0 for h, _ in levels[-1]]


def naive_likeness(x, y):
    """x, y: levels of two texts."""
    if x[-1][0][0] == y[-1][0][0]:
        return 1.0
    carried = lambda levels: {k for k, z in enumerate(levels[:-1]) if len(z) <= merkle.MOST}
    both = carried(x) & carried(y)
    if not both:
        return 0.0
    p, q = (Counter((h[2:6], n) for h, n in z[min(both)]) for z in (x, y))
    size = lambda c: sum(n * k for (_, n), k in c.items())
    return min(size(p & q), size(p | q) - min(n for _, n in x[min(both)])) / size(p | q)


def test_edits_and_neighbours(odd, docs):
    for df in (odd, docs):
        got = merkle.edit_likeness(df, some=7).collect()
        order = sorted(((i, t or "") for i, t in rows_of(df)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = []
        for k, (i, t) in enumerate(order):
            q, nxt = len(t) // 4, order[(k + 1) % len(order)][1]
            edited = t[: len(t) - q] + nxt[:q]
            x, y, z = (naive_tree(v.encode()) for v in (t, edited, nxt))
            want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), x[-1][0][0].hex(), y[-1][0][0].hex(), round(naive_likeness(x, y), 9), round(naive_likeness(x, z), 9)))
        have = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"][:32], r["edited_fingerprint"][:32], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
        assert Counter(have) == Counter(want)
    far = [r for r in got if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in far]) > 0.5 and np.median([r["near_next"] for r in far]) < 0.1


def test_neighbours_across_ranges_of_one_id(spark):
    rows = [(5, f"t{k:03d}") for k in range(40)] + [(None, "n"), (1, None), (9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["edited_sha256"] for r in merkle.edit_likeness(df).collect()}
    order = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    assert got == {hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest() for t, u in zip(order, order[1:] + order[:1], strict=True)}


def test_trees_locate_edits():
    rng = random.Random(6)
    lines = [b" ".join(b"%d" % rng.randrange(10**6) for _ in range(12)) for _ in range(900)]
    a = b"\n".join(lines)
    for at in (0, 57, 450, 899):
        other = [*lines]
        other[at] = b"changed " * 9
        b = b"\n".join(other)
        x, y = merkle.fingerprint(a), merkle.fingerprint(b)
        ranges = merkle.changed(x, y)
        first = sum(len(v) + 1 for v in other[:at])
        assert all(any(p <= k < q for p, q in ranges) for k in (first, first + 40, first + len(other[at]) - 1))
        assert sum(q - p for p, q in ranges) < len(b) / 8
        assert 0.8 < merkle.likeness(x, y) < 1
    assert merkle.changed(x, x) == [] and merkle.likeness(x, x) == 1.0


def test_unlike_texts_without_blanks_are_told_apart():
    a = b"abba" * 512
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(bytes(a.translate(bytes.maketrans(b"ab", b"ba"))))) < 1
    thue = bytes(97 + bin(i).count("1") % 2 for i in range(2048))
    other = bytes(195 - c for c in thue)
    assert merkle.fingerprint(thue)[:32] != merkle.fingerprint(other)[:32] and merkle.likeness(merkle.fingerprint(thue), merkle.fingerprint(other)) < 1


# ---------------------------------------------------------------- nearest neighbours


def test_nearest_matches_brute_force(spark, small):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (420, [0.0] * 16), (440, [float("nan")] + [1.0] * 15), (460, [None] + [1.0] * 15), (480, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (500, [1.0, 2.0]), (520, [3.0, 1.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = rows_of(neighbours.nearest(df, 20), "query_id", "rank", "vec_id", "score")
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    want = []
    for q in (i for i in ok if i % 20 == 0):
        c = []
        for i, v in ok.items():
            if i != q and len(v) == len(ok[q]):
                s = 0.0
                for a, b in zip(ok[q], v, strict=True):
                    s += a * b
                c.append((-s, i))
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(c)[:20], 1)]
    assert sorted(got) == sorted(want)


# ---------------------------------------------------------------- queries and pipeline


def test_pipeline_against_brute_force(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        out = stage(spark, docs, small).cache()
        if name == "toxicity":
            want = Counter((i, t) for i, t, _ in before if lexicon.score(t) < 0.5)
        elif name == "near_dedup":
            want = Counter((i, t) for (i, t, _), (_, _, c) in zip(before, brute_components([b[:2] for b in before], 5, 80), strict=True) if i == c)
        elif name == "suffix_dedup":
            lost = {r[0]: r[1:] for r in brute_repeats([b[:2] for b in before], 100)}
            have = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(have) == {i for i, r in lost.items() if r[1] < r[0] or not r[0]}
            assert all(len(have[i].encode()) <= lost[i][0] - lost[i][1] <= len(have[i].encode()) + 6 * lost[i][2] for i in have)
            assert all(have[i] == t for i, t, _ in before if not lost[i][1])
            want = None
        elif name == "mixing":
            want = None
            assert {b[:2] for b in before} == {(r["doc_id"], r["text"]) for r in out.collect()}
        else:
            want = None
            e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(MULTI), special_tokens={})
            assert Counter((r["doc_id"], tuple(r["ids"]), r["n_bytes"]) for r in out.collect()) == Counter((i, tuple(e.encode_ordinary(t)), len(t.encode())) for i, t, _ in before)
        if want is not None:
            assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
        if name != "bpe":
            assert out.columns == names
        docs = out


def naive_weight(x, text):
    """Every word against every term, without a machine."""
    w = toxicity.fold(text or "")
    total = 0.0
    for i, word in enumerate(w):
        best = max((v for t, v in x.terms.items() if (word == t[:-1] if t.endswith(" ") else word.startswith(t))), default=None)
        around = {(a, b) for a, b in ((w[i - 1] if i else "", word), (word, w[i + 1] if i + 1 < len(w) else ""))}
        if best is not None and not around & x.exceptions:
            total += best
    return total / (1 + math.log1p(len(w) / 200))


def test_scores_match_a_naive_matcher(spark, odd, docs, small):
    x = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert x.terms
    x = toxicity.Lexicon({**x.terms, "ba": 0.7, "lo ": 1.1}, x.exceptions | {("ba", "lo")}, x.curve)
    for df in (odd.withColumn("predicted", F.lit("clash")), docs):
        got = toxicity.score(df, x)
        assert [c for c in got.columns if c in ("score", "predicted")] == ["score", "predicted"]
        a, b = x.curve
        for r in got.collect():
            s = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * naive_weight(x, r["text"])))))
            assert r["score"] == pytest.approx(s) and r["predicted"] == int(r["score"] >= 0.5)


def test_a_labelled_id_with_many_texts_teaches_once(spark):
    rows = [(1, "foul mouth")] * 50 + [(1, f"other {k}") for k in range(300)] + [(i, ("foul " if i % 2 else "kind ") + " ".join(f"{c}{i}" for c in "uvwxyz")) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 60)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    x = toxicity.fit(docs, labels, F.lit(True))
    assert any(t.startswith(toxicity.fold("foul")[0]) for t in x.terms) and not any(t.startswith("other") for t in x.terms)


def test_tiny_huge_and_tied_vectors(spark):
    rows = [(0, [1e-320, 0.0]), (1, [5e-324, 5e-324]), (2, [1e-318, -1e-319]), (3, [1e200, 1e200]), (20, [1e200, -1e200]), (21, [1e200, 1.0]), (22, [1.0, 1.0]), (23, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for q, r, i, s in sorted(rows_of(neighbours.nearest(df, 20), "query_id", "rank", "vec_id", "score")):
        got.setdefault(q, []).append((i, s))
    v = dict(rows)
    for q in (0, 20):
        want = []
        for i in v:
            if i != q:
                s = 0.0
                for a, b in zip(v[q], v[i], strict=True):
                    s += a * b
                want.append((math.isnan(s), 0 if math.isnan(s) else -s, i, s))
        assert [i for i, _ in got[q]] == [i for _, _, i, _ in sorted(want)]
        assert [repr(s) for _, s in got[q]] == [repr(s) for *_, s in sorted(want)]


def test_hot_source_is_mixed_in_strata(spark, monkeypatch):
    """Offsets summed in two levels are those of one sorted list of blocks."""
    rows = [(i, " ".join(["w"] * (i % 7)), "hot" if i % 3 else "cold") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df, 1.0, 9.0, block_tokens=4)
    once = sorted(map(tuple, taken.collect()))
    monkeypatch.setattr(mixing, "STRATUM_SHIFT", 59)
    assert sorted(map(tuple, mixing.mix(df, 1.0, 9.0, block_tokens=4).collect())) == once
    own = sorted((r["start"], r["n_tokens"]) for r in taken.collect() if r["source"] == "cold")
    assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:], strict=False))


def test_rows_of_one_id_with_unlike_texts_both_stay(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, a), (2, b + " end"), (3, c), (None, a), (None, a), (4, None), (4, ""), (5, "")]
    out = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), near_dedup.Params())
    assert Counter(rows_of(out)) == Counter([(1, a), (1, b), (3, c), (None, a), (None, a), (4, None), (4, ""), (5, "")])


def test_large_clusters_ask_their_least_member_first(spark):
    """Clusters over several groups, with members that only others link, against brute force."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(90):
        w = [*base]
        for _ in range(rng.choice([0, 0, 1, 4, 6])):
            w[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for side in (4, 16):
        got = rows_of(near_dedup.near_duplicates(df, near_dedup.Params(3, 85, tile=side, verify_tile=side)), "doc_id", "n_shingles", "component_id")
        assert Counter(got) == Counter(brute_components(rows, 3, 85))


def test_every_stage_takes_odd_rows_and_empty_tables(spark, odd, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd.withColumn("toxic", F.lit("t")).withColumn("_tokens", F.lit(1)).withColumn("row", F.lit(2)).withColumn("none", F.lit(3))
    for df in (docs, docs.limit(0)):
        names, n = df.columns, df.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, small)
            assert out.columns == names
            rows = [(r["doc_id"], r["text"], r["toxic"], r["none"]) for r in out.collect()]
            assert all(r[2:] == ("t", 3) for r in rows) and bool(rows) == bool(n)
            if n and name != "near_dedup":
                assert sum(r[1] is None for r in rows) >= sum(t is None for _, t in rows_of(df))
        assert corpus_pipeline.STAGES[-1][1](spark, df, small).count() == n


CONTRACT = {
    "op2_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_token_file": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_lm_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op10_nearest": "query_id bigint, rank int, vec_id bigint, score double",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_queries_have_the_columns_of_their_contract(spark, small, name):
    got = QUERIES[name](spark, small)
    kinds = dict(got.dtypes)
    assert all(kinds[c] == k for c, k in (x.split(" ") for x in CONTRACT[name].split(", ")))
    if name == "op7_bpe":
        e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.read_ranks(MULTI), special_tokens={})
        want = []
        for i, t in rows_of(spark.read.parquet(f"{small}/documents.parquet")):
            ids = e.encode_ordinary(t)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    elif name != "op10_nearest":
        ids = [r["doc_id"] for r in got.select("doc_id").collect()]
        assert sorted(ids) == sorted(i for i, _ in rows_of(spark.read.parquet(f"{small}/documents.parquet")))


def test_toxic_ids_are_whole_words_of_digits():
    assert re.fullmatch(r"[a-z]+", toxicity.fold("5cum")[0])
