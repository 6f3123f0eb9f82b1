"""Operators against brute force on small tables, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tickloom.llm import bpe, chosen_path, components, embedding_dedup, exact_dedup, lang_id, lm_score, mixing, quality, token_output, toxicity
from tickloom.llm.common import shared_dir
from tickloom.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")

#: Null and empty texts, ties, a repeated row, a null id, white space, marks beyond ASCII, and columns whose names clash.
ODD = [
    (1, "a b c d e f g", "en"), (2, "a  b\tc d e f g", "en"), (2, "a  b\tc d e f g", "en"), (3, None, None), (4, "", "fr"), (5, "A B C d e f G", "en"),
    (None, "a b c d e f g", None), (6, " \n ", "de"), (7, "日本 é \U0001f600 don't", "fr"), (8, "x " * 30_000, "en"), (9, "one", "es"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({"row_id": F.lit(1), "component": F.lit(2), "id": F.lit(3), "first": F.lit(4), "n": F.lit(5)})


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return {r.doc_id: r.text or "" for r in small.select("doc_id", "text").collect()}


def held(i, n):
    return zlib.crc32(str(i).encode()) % n == 2


# --- language model -----------------------------------------------------------------------------------------------


class BruteModel:
    """The smoothed n-gram probabilities by their recursive definition."""

    def __init__(self, docs, order, k=(1000.0, 100.0)):
        self.order, self.k, self.seqs = order, k, []
        self.count = [collections.Counter() for _ in range(order)]
        for i, t in docs:
            w = (t or "").encode().lower().split() + [None]
            self.seqs.append((i, w))
            if i is None or not held(i, 7):
                for n in range(order):
                    self.count[n].update(tuple(([None] + w)[j - n + 1 : j + 2]) for j in range(len(w)) if j >= n - 1)
        self.n, self.v = sum(self.count[0].values()), len(self.count[0])
        n1, n2 = (sum(c == x for c in self.count[0].values()) for x in (1, 2))
        self.d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)

    def p(self, history, w):
        if not history:
            c = self.count[0][w,]
            return (c - self.d if c else self.d * self.v) / self.n
        k, c = self.k[len(history) - 1], self.count[len(history) - 1][history]
        return (self.count[len(history)][(*history, w)] + k * self.p(history[1:], w)) / (c + k)

    def scores(self):
        out = []
        for i, w in self.seqs:
            seq = [None] + w
            score = sum(math.log10(self.p(tuple(seq[max(0, j - self.order + 1) : j]), seq[j])) for j in range(1, len(seq)))
            base = sum(math.log10((self.count[0][x,] + 1) / (self.n + self.v + 1)) for x in w)
            out.append((str(i), len(w), sum(self.count[0][x,] > 0 for x in w), self.n, round(base, 6), round(score, 6)))
        return sorted(out)


def got_scores(df):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_matches_brute_force(small, texts, order):
    got = lm_score.score(small, order=order, chunk_bytes=60_000, shard_tokens=20_000)
    assert got_scores(got) == BruteModel(texts.items(), order).scores()


def test_lm_matches_brute_force_with_copies_across_chunks(spark, monkeypatch):
    """N-grams that only held-out or only other chunks' texts share, higher orders, and stretches of a few words."""
    monkeypatch.setattr(lm_score, "_LANES", 7)
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices("abcdef", k=rng.randint(0, 30)))) for i in range(120)]
    docs += [(200 + i, docs[i][1]) for i in range(0, 120, 7)] + [(400, "q r s t u v"), (401, "q r s t u v"), (402, "w x y z")]
    got = lm_score.score(spark.createDataFrame(docs, "doc_id long, text string"), 4, (30.0, 10.0, 3.0), chunk_bytes=300, shard_tokens=200)
    assert got_scores(got) == BruteModel(docs, 4, (30.0, 10.0, 3.0)).scores()


def test_lm_edge_cases(spark, odd):
    assert got_scores(lm_score.score(odd)) == BruteModel([(i, t) for i, t, _ in ODD], 3).scores()
    assert lm_score.score(odd.where("false")).count() == 0
    with pytest.raises(ValueError, match="order"):
        lm_score.score(odd, order=4)


def test_lm_is_a_distribution():
    m = BruteModel([(1, "a b a c"), (3, "b a c d")], 3, (10.0, 10.0))
    words = [w for w, in m.count[0]]
    for history in ((), (None,), (b"a",), (b"b", b"a"), (b"zz", b"a")):
        assert abs(sum(m.p(history, w) for w in [*words, b"unknown"]) - 1) < 1e-9


# --- classifiers --------------------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lang_id.predict(docs, lang_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    test = got[[held(i, 4) for i in got.doc_id]]
    assert (test.lang == test.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.05


def test_language_edge_cases(odd):
    models = lang_id.train(odd.where("text is not null"))
    got = lang_id.predict(odd, models).toPandas()
    assert len(got) == len(ODD) and set(got[got.doc_id.isin([3, 4, 6])].lang_pred) == {"und"}
    assert lang_id.predict(odd.where("false"), models).count() == 0
    none = lang_id.predict(odd, lang_id.train(odd.where("false"))).toPandas()
    assert set(none.lang_pred) == {"und"} and set(none.score) == {0.0}
    assert set(lang_id.accepted(odd, models).columns) == set(odd.columns)


def brute_kneser_ney(words, order, alphabet):
    """p(character | those before it in its word), by the recursive definition over strings."""
    marked = ["\x02" + w + "\x03" for w in words]
    raw = collections.Counter(m[i - order + 1 : i + 1] for m in marked for i in range(order - 1, len(m)))
    count = {order: raw}
    for n in range(order - 1, 0, -1):
        before = collections.defaultdict(set)
        for m in marked:
            for i in range(max(n - 1, 1), len(m)):
                # what stands before the n-gram; where a word begins with it, that is one thing more
                before[m[i - n + 1 : i + 1]].add(m[i - n] if i >= n else "begin")
        count[n] = {g: len(b) for g, b in before.items()}

    def discount(n):
        ones, twos = (sum(c == k for c in count[n].values()) for k in (1, 2))
        return min(max(ones / max(ones + 2.0 * twos, 1.0), 0.1), 0.9)

    def p(history, c):
        n = len(history) + 1
        below = p(history[1:], c) if history else 1.0 / (alphabet + 1)
        total = sum(v for g, v in count[n].items() if g[:-1] == history)
        if not total:
            return below
        kinds, d = sum(g[:-1] == history for g in count[n]), discount(n)
        return (max(count[n].get(history + c, 0) - d, 0) if history + c in count[n] else 0) / total + d * kinds / total * below

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_matches_brute_force(order):
    words = "abab abba baba aab bba cab bac abba".split()
    models = lang_id._fit({"x": [" ".join(words)]}, order)
    p = brute_kneser_ney(words, order, len(set("abc\x02\x03")))
    for w in ["abab", "cc", "bca", "aabbccab", "b"]:
        marked = "\x02" + w + "\x03"
        got = models.characters(np.array([ord(c) for c in marked], np.uint64), np.arange(len(marked)))[1:, 0]
        want = [math.log(p(marked[max(0, i - order + 1) : i], marked[i])) for i in range(1, len(marked))]
        assert np.allclose(got, want, atol=1e-4), w


def test_long_runs_of_letters_are_scored_in_stretches(monkeypatch):
    models = lang_id._fit({"x": ["abab abba baba"], "y": ["cdcd dccd"]}, 4)
    word = "abbacd" * 50
    whole = models.words([word, "ab", word])
    monkeypatch.setattr(lang_id, "_CHARACTERS", 40)
    assert np.allclose(models.words([word, "ab", word]), whole)


def test_language_rejects_foreign_texts_and_keeps_short_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    models = lang_id.train(docs)
    score = lang_id._Scorer(models)
    rng = random.Random(4)
    foreign = [
        "Wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw", "Все люди рождаются свободными и равными в своем достоинстве",
        "すべての人間は、生まれながらにして自由であり", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van",
        "Questa è una semplice frase in italiano che parla del tempo e della vita quotidiana nelle città del paese, e di come gli anni passano",
        *("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300)) for _ in range(40)), *("".join(rng.choices("aeioubcd ", k=300)) for _ in range(10)),
    ]
    assert score(foreign).rejected.mean() > 0.98
    clean = [r.text for r in docs.where("text is not null").select("doc_id", "text").collect() if held(r.doc_id, 4)]
    whole = score(clean)
    assert whole.rejected[whole.lang_pred != "und"].mean() < 0.001
    short = score([" ".join(t.split()[a : a + n]) for t in clean[:1500] for n in (1, 2, 5, 20) for a in (0, 9)])
    assert short.rejected[short.lang_pred != "und"].mean() < 0.002


def test_language_bounds(spark, small):
    with pytest.raises(ValueError, match="languages"):
        lang_id.train(small, max_languages=1)
    texts = spark.createDataFrame([(i, "wort " * 50 if i % 2 else "word " * 60, "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string")
    assert sorted(lang_id.train(texts, max_chars=600).langs) == ["de", "en"]


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.92), (quality, "quality", 0.97)])
def test_scores_of_held_out_texts(module, label, least, spark):
    """Some labelled texts show nothing of their label, so toxicity can't reach 1 here."""
    large = "/root/testdata/sf0.1"
    docs, marks = (spark.read.parquet(f"{large}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, marks)
    got = module.predict(docs.join(marks, "doc_id", "left_semi"), model).join(marks, "doc_id").toPandas()
    assert got.score.between(0, 1).all()
    got = got[[held(i, 4) for i in got.doc_id]]
    pos, neg = got[got[label] == 1].score, got[got[label] == 0].score
    assert np.mean(pos.to_numpy()[:, None] > neg.to_numpy()[None]) > least


def test_quality_contexts_are_sums_over_whole_words():
    long = "wörd" * 10
    split = [["A1", "bee", long + "x", "bee"], ["bee", long + "yy", "A2", "9!"], ["cat"]]
    m = quality.QualityModel(16)
    quality._contexts(m, split, backoff=3.0)
    index = lambda w: (quality.index_vectors([w], 16)[0] + quality.index_vectors([quality._shape(w)], 16)[0]) / 2**0.5
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    own, whole = collections.defaultdict(lambda: np.zeros(16)), collections.defaultdict(lambda: np.zeros(16))
    for s in split:
        for i, w in enumerate(s):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(s):
                    own[w] += index(s[j])
                    whole[quality._shape(w)] += index(s[j])
    for w in {w for s in split for w in s}:
        got = m.words([w])[0, :16]
        assert np.allclose(got, unit(own[w] + 3.0 * unit(whole[quality._shape(w)])), atol=1e-5), w
    unknown = m.words(["A7", "dog", "?"])[:, :16]
    assert np.allclose(unknown[0], unit(whole[quality._shape("A7")]), atol=1e-5)
    assert np.allclose(unknown[1], unit(whole[quality._shape("dog")]), atol=1e-5)
    assert not unknown[2].any()
    assert quality._shape("a" + "-a" * 9) != quality._shape("a" + "-a" * 8)


def test_quality_learns_nothing_from_shuffled_labels(spark, small):
    rng = np.random.default_rng(2)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality is not null").select("doc_id", "quality").toPandas()
    labels["quality"] = rng.permutation(labels.quality.to_numpy())
    model = quality.train(small, spark.createDataFrame(labels))
    rows = quality.predict(small.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2), model).toPandas()
    rows = rows.merge(labels, on="doc_id")
    low, high = rows.score[rows.quality == 0], rows.score[rows.quality == 1]
    assert 0.2 < (high.to_numpy()[:, None] > low.to_numpy()).mean() < 0.8


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_without_labels(module, odd, labels):
    model = module.train(odd, labels.where("false"))
    got = module.predict(odd, model).toPandas()
    assert len(got) == len(ODD) and set(got.score) == {0.5}
    assert module.predict(odd.where("false"), model).count() == 0


def test_misspellings_share_vectors():
    texts = [f"nice words here {w} and more" for w in ("stupid", "stupids", "stupidly")] * 20 + ["nice words here and more of them"] * 60
    scores, bias = toxicity._fit(texts, np.array([1] * 60 + [0] * 60), 1 << 12, 4, 4, 30)
    model = toxicity.ToxicityModel(scores, bias, 4)
    s = model.words(["stupiid", "nicely"])[:, 0]
    assert s[0] > s[1]


# --- byte-level BPE -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(tiktoken_encoding, texts):
    encoder = bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, budget=100_000)
    encoder.machine.max_states = 3_000
    rng = random.Random(5)
    signs = [chr(i) for i in [*range(0, 0x250), 0x85, 0x2003, 0x1C, 0x4E00, 0x1F600, 0x301]]
    odd = ["".join(rng.choices(signs if k % 2 else "abet  's\n\x1c", k=rng.randint(0, 40))) for k in range(3000)]
    for t in [*list(texts.values())[:60], *odd, " " * 500, "ab" * 5000, None]:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert encoder.encode(t) == struct.pack(f"<{len(ids)}I", *ids)


def test_streamed_decoding_holds_unfinished_characters():
    text = "aé日\U0001f600z"
    table = [bytes([b]) for b in range(256)]
    stream = bpe.StreamDecoder(table)
    parts = [stream.feed([b]) for b in text.encode()]
    assert "".join(parts) + stream.close() == text and "" in parts
    broken = bpe.StreamDecoder(table)
    assert broken.feed([0xE6, 0x97]) == "" and broken.close() == "�"


def test_bpe_query_equals_the_library(spark, tiktoken_encoding):
    """Every row of a whole table, through Spark."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries()["op5_bpe"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for doc_id, t in docs:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_of_long_texts_in_stretches(tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "_STRETCH", 50)
    monkeypatch.setattr(bpe, "_STEP", 7)
    encoder = bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(8)
    for space in (" ", "\n", "  "):
        t = space.join("".join(rng.choices("abcdeé.'s", k=rng.randint(1, 9))) for _ in range(3000))
        ids = tiktoken_encoding.encode_ordinary(t)
        assert encoder.encode(t) == struct.pack(f"<{len(ids)}I", *ids)
    word = "".join(rng.choices("abcdefghij", k=200_000))  # no white space at all
    ids = tiktoken_encoding.encode_ordinary(word)
    encoder.machine.max_states = 2_000
    assert encoder.encode(word) == struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_round_trip_of_odd_rows(odd):
    coded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(coded, RANKS, step=7)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in ODD)
    once = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, once.select(back.columns).collect()), key=str) == sorted(map(tuple, back.collect()), key=str)
    assert bpe.encode(odd.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


# --- exact dedup --------------------------------------------------------------------------------------------------


def test_exact_dedup_of_odd_rows(spark, odd):
    index = exact_dedup.DigestIndex(spark, shared_dir(spark, "t"), 4)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in index.dedup(odd).collect())
    want = [("1", "1", 4, True), ("2", "1", 4, False), ("2", "1", 4, False), ("None", "1", 4, False), ("3", "3", 2, True), ("4", "3", 2, False)]
    want += [(str(i), str(i), 1, True) for i in (5, 6, 7, 8, 9)]
    assert got == sorted(want)
    again = index.dedup(odd)
    assert again.where("kept").count() == 0  # the index persists
    assert {r.keep_id for r in again.collect()} == {1, 3, 5, 6, 7, 8, 9}
    reopened = exact_dedup.DigestIndex(spark, index.path, 4)
    assert reopened.read().count() == 7
    assert exact_dedup.DigestIndex(spark, shared_dir(spark, "t"), 4).dedup(odd.where("false")).count() == 0


def test_distinct_rows_keep_columns(spark, odd):
    got = exact_dedup.distinct_rows(odd, exact_dedup.DigestIndex(spark, shared_dir(spark, "t"), 4))
    assert got.columns == odd.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 6, 7, 8, 9]


def test_exact_dedup_twin(spark, same):
    for name, sql in oracle_sql().items():
        same(queries()[name](spark, "/root/testdata/sf0.01"), sql)


# --- token shards -------------------------------------------------------------------------------------------------


def test_token_shards(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    out = shared_dir(spark, "t")
    totals = token_output.write_shards(odd, WORDS, out, end_id=2, shard_bytes=300)
    assert len(totals) > 1
    got = token_output.read_shards(spark, out, totals).collect()
    want = sorted((i if i is not None else -1, struct.pack(f"<{len(x) + 1}I", *x, 2)) for i, text, _ in ODD for x in [t.encode(text or "", add_special_tokens=False).ids])
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in got) == want
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    shard = next(s for s in (token_output.Shard(out, i) for i in range(len(totals))) if 7 in s.documents()[0])
    assert shard.get(7)[-1] == 2 and shard.get(12345) is None
    assert token_output.write_shards(odd.where("false"), WORDS, shared_dir(spark, "t"), 2) == []
    assert token_output.read_shards(spark, out, []).count() == 0


def test_token_query_equals_the_library(spark):
    """Every row of a whole table, through the files."""
    from tokenizers import Tokenizer

    t, place = Tokenizer.from_file(WORDS), 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries()["op7_token_output"](spark, "/root/testdata/sf0.01").collect()}
    for doc_id, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (place, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        place += len(ids)


@pytest.mark.parametrize("special", [True, False])
def test_word_encoder_equals_the_library(special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = not special
    with open(WORDS, encoding="utf-8") as f:
        encoder = token_output.WordEncoder(f.read(), special, budget=20_000)
    rng = random.Random(3)
    signs = [chr(i) for i in [*range(1, 0x180), 0x85, 0x2003, 0x4E00, 0x1F600, 0x301, 0x30C, 0x30A, 0x212A]]
    odd = ["".join(rng.choices(signs if k % 2 else "aBJ 's\n1.\u030c", k=rng.randint(0, 40))) for k in range(3000)]
    odd += ["a <|endoftext|> b", "A<|ENDOFTEXT|>b", "x<|startoftext|>y <|EndOfText|>", "w" * 100_000, None, ""]
    for a in range(0, len(odd), 100):
        for text, packed in zip(odd[a : a + 100], encoder.encode(odd[a : a + 100]), strict=True):
            assert np.frombuffer(packed, encoder.dtype).tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_wide_ids_take_four_bytes(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    out = shared_dir(spark, "t")
    totals = token_output.write_shards(docs, WORDS, out, end_id=70_000)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_output.read_shards(spark, out, totals).collect()}
    assert got[2] == [70_000] and got[1][-1] == 70_000 and len(got[1]) == 3 and token_output.Shard(out, 0).get(2).tolist() == [70_000]
    assert token_output.id_type(1 << 16) == "<u2" and token_output.id_type((1 << 16) + 1) == "<u4"


def test_minimal_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    h = token_output.MinimalPerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    with pytest.raises(ValueError):
        token_output.MinimalPerfectHash.build(np.array([1, 1], np.uint64))


# --- mixing -------------------------------------------------------------------------------------------------------


def test_rates_meet_their_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([4, 1, 1], 200)
    rows = [(i, i, int(n), *map(float, q)) for i, (n, q) in enumerate(zip(rng.integers(1, 900, 200), p, strict=True))]
    members = spark.createDataFrame(rows, "row long, doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")
    target = {"clean": 0.7, "low": 0.2, "toxic": 0.1}
    got = mixing.rates(members, target, steps=40).toPandas()
    mass = np.array([(got.rate * got.n_tokens * got[f"p_{d}"]).sum() for d in target])
    assert np.allclose(mass / mass.sum(), list(target.values()), atol=0.02)
    assert (got.rate >= 0).all() and ((got.copies - got.rate).abs() < 1).all()
    # the same descent in numpy
    n, q = got.n_tokens.to_numpy(float), got[[f"p_{d}" for d in target]].to_numpy()
    m, r = (n[:, None] * q).sum(0), np.ones(len(n))
    want = 1.1 * m[0] / 0.7 * np.array(list(target.values()))
    for _ in range(40):
        left = ((r * n)[:, None] * q).sum(0) - want
        if np.abs(left / m).max() < 1e-6:
            break
        r = np.maximum(0, r - np.round(q, 3) @ (left / m))
    assert np.allclose(r, got.rate, atol=1e-6)
    left = ((r * n)[:, None] * q).sum(0) - want
    assert np.allclose(got.gap, np.abs(left / m).max())
    longer = mixing.rates(members, target, steps=2000).toPandas()
    assert longer.gap[0] < 2e-3


def brute_posteriors(docs, labels, support, errors, absence):
    """Naive Bayes of the words' presence, restated with Counters."""
    words = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] for i, t in docs.items()}
    bag = {i: set(w) | {"\0variety%d" % (10 * len(set(w)) // max(len(w), 1))} for i, w in words.items()}
    domain = {}
    for i, q, t in labels:
        d = "toxic" if t == 1 else "low" if q == 0 else "clean" if (q, t) == (1, 0) else None
        if i is not None and d and not held(i, 4):
            domain[i] = d
    seen = {i: d for i, d in domain.items() if docs.get(i)}
    n = [sum(d == x for d in seen.values()) for x in mixing.DOMAINS]
    prior = [(sum(d == x for d in domain.values()) + 1) / (len(domain) + 3) for x in mixing.DOMAINS]
    count = [collections.Counter(w for i, d in seen.items() if d == x for w in bag[i]) for x in mixing.DOMAINS]
    weight, start = {}, [0.0]
    for k in (1, 2):
        lacking = 0.0
        for w in set().union(*count):
            c0, ck = count[0][w], count[k][w]
            p0, pk, both = (c0 + 0.5) / (n[0] + 1), (ck + 0.5) / (n[k] + 1), (c0 + ck + 0.5) / (n[0] + n[k] + 1)
            if pk - p0 > errors * math.sqrt(both * (1 - both) * (1 / (n[0] + 1) + 1 / (n[k] + 1))) and c0 + ck >= support:
                absent = math.log((1 - pk) / (1 - p0))
                weight[k, w] = math.log(pk / p0) - absent
                lacking += absent
        start.append(math.log(prior[k] / prior[0]) + max(-absence, lacking))
    out = {}
    for i, b in bag.items():
        s = [0.0] + [start[k] + sum(weight.get((k, w), 0.0) for w in b) for k in (1, 2)]
        e = [math.exp(x - max(s)) for x in s]
        out[i] = [x / sum(e) for x in e]
    return out


@pytest.mark.parametrize(("support", "errors", "absence"), [(8, 6.0, 3.0), (0, 0.0, math.inf), (3, 1.0, 3.0)])
def test_posteriors_match_brute_force(spark, support, errors, absence):
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.posteriors(docs, labels, support=support, errors=errors, absence=absence).collect()
    want = brute_posteriors({r.doc_id: r.text for r in docs.collect()}, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()], support, errors, absence)
    assert len(got) == len(want)
    for r in got:
        assert np.allclose([r.p_clean, r.p_low, r.p_toxic], want[r.doc_id], atol=1e-9)


def test_stages_keep_clashing_columns_and_repeated_ids(spark, labels):
    """Columns named like the operators' own stay as they are, and decisions are by row, not by id."""
    rows = [(1, "a b c d e f g h i j k l m n", 7), (2, "a b c d e f g h i j k l m n o", 7), (2, "nothing like the others at all here", 7), (3, None, 7), (None, "x", 7), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long")
    for c in ("_row_key", "_copies", "_copy", "_nth", "_class", "_size", "_sha_of_row", "_sha", "row", "row_key", "text_sha256", "component"):
        docs = docs.withColumn(c, F.lit(7).cast("long"))
    index = exact_dedup.DigestIndex(spark, shared_dir(spark, "t"), 4)
    for got in (mixing.mixed(docs, labels), exact_dedup.distinct_rows(docs, index), chosen_path.distinct_rows(docs)):
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(set(r[2:]) == {7} for r in rows)
    kept = [(r.doc_id, r.text or None) for r in chosen_path.distinct_rows(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c d e f g h i j k l m n"), (2, "nothing like the others at all here"), (3, None), (None, "x")], key=str)
    for stage in (lambda d: mixing.mixed(d, labels), chosen_path.distinct_rows):
        assert stage(docs.where("false")).count() == 0


def test_mixing_edge_cases(spark, odd, labels):
    got = mixing.mix(odd, labels.where("false")).toPandas()
    assert len(got) == len(ODD) and got.rate.round(9).nunique() == 1
    assert mixing.mix(odd.where("false"), labels).count() == 0
    assert mixing.mixed(odd, labels).columns == odd.columns


# --- near duplicates ----------------------------------------------------------------------------------------------


def brute_components(items, linked):
    """Smallest id reachable from each, by trying all pairs."""
    ids = [i for i, _ in items]
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if linked(items[a][1], items[b][1]):
                parent[root(a)] = root(b)
    low = {}
    for i, x in enumerate(ids):
        low[root(i)] = min(low.get(root(i), x), x)
    return {x: low[root(i)] for i, x in enumerate(ids)}


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def planted(seed=6):
    """Families of copies with edits, chains of ever more distant copies, short texts and unrelated ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    out = []
    for size in (2, 5, 40):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    chain = [word() for _ in range(80)]
    for _ in range(12):
        chain[rng.randrange(len(chain))] = word()
        chain[rng.randrange(len(chain))] = word()
        out.append(" ".join(chain))
    out += [" ".join(word() for _ in range(rng.randint(1, 50))) for _ in range(40)] + ["", None, "one", "one", "ONE two"]
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, width):
    docs = planted()
    got = chosen_path.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width).collect()
    want = brute_components([(i, shingles(t, width)) for i, t in docs], alike)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingles(dict(docs)[r.doc_id], width)) and r.kept == (r.component_id == r.doc_id) for r in got)


@pytest.mark.parametrize(("limit", "value"), [("GROUP", 12), ("SHINGLES", 900)])
def test_near_duplicates_in_large_nodes_and_groups(limit, value, spark, monkeypatch):
    """Nodes and groups above their limits are dealt into blocks without losing links."""
    monkeypatch.setattr(chosen_path, "NODE", 8)
    monkeypatch.setattr(chosen_path, limit, value)
    docs = planted(9)
    got = chosen_path.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components([(i, shingles(t, 2)) for i, t in docs], alike)


def template_group(n, shared, own, edits, seed=3):
    """Pairs of near copies that share a long template with all others; the template alone makes no link."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    template, out = [word() for _ in range(shared)], []
    for _ in range(n // 2):
        one = template + [word() for _ in range(own)]
        out += [" ".join(one), " ".join(one[:-edits] + [word() for _ in range(edits)])]
    rng.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize(("limit", "value"), [("GROUP", 12), ("SHINGLES", 12 * 105)])
def test_near_duplicates_of_a_template_group_hold_two_tiles_a_task(limit, value, spark, monkeypatch, tmp_path):
    """A candidate group with hardly any link is compared in groups bounded by rows or by shingles, and no link is lost."""
    real, seen = chosen_path._confirm, str(tmp_path)

    def confirm(rows, *args):
        import uuid
        from pathlib import Path

        Path(seen, uuid.uuid4().hex).write_text(str(rows.groupby("gkey").size().max()))
        return real(rows, *args)

    monkeypatch.setattr(chosen_path, "_confirm", confirm)
    monkeypatch.setattr(chosen_path, limit, value)
    docs = template_group(120, 85, 20, 4)
    got = chosen_path.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components([(i, shingles(t, 2)) for i, t in docs], alike)
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) <= 4 * 12


def test_trees_of_large_nodes_use_coordinates_of_their_own():
    """Signatures of a pair at the threshold agree in the same share of places, but not in the same places."""
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (4000, 500, 500))
    one, two = np.concatenate([both, a]), np.concatenate([both, b])
    first, second = (chosen_path._signature(one, k) == chosen_path._signature(two, k) for k in (0, 1))
    assert 0.7 < first.mean() < 0.9 and 0.7 < second.mean() < 0.9
    assert not np.array_equal(first, second)
    assert not set(chosen_path._signature(one, 0).tolist()) & set(chosen_path._signature(one, 1).tolist())


def test_near_duplicates_of_nodes_that_stay_large(spark, monkeypatch):
    """Documents of large nodes get more trees, and all blocks of a node that stays large meet."""
    monkeypatch.setattr(chosen_path, "NODE", 20)
    monkeypatch.setattr(chosen_path, "MORE_LEVELS", 0)
    docs = template_group(400, 62, 38, 11)
    got = chosen_path.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1, trees=4).collect()
    want = brute_components([(i, shingles(t, 1)) for i, t in docs], alike)
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_of_odd_rows(odd):
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in chosen_path.near_duplicates(odd, 2).collect())
    want = [("1", "1", True), ("2", "1", False), ("2", "1", False), ("5", "1", False), ("None", "None", True)]
    assert got == sorted(want + [(str(i), str(i), True) for i in (3, 4, 6, 7, 8, 9)])
    assert chosen_path.near_duplicates(odd.where("false")).count() == 0


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "_EDGES", 10)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    linked = {frozenset(e) for e in edges}
    want = brute_components([(x, x) for x in nodes], lambda a, b: frozenset((a, b)) in linked)
    assert got == {k: v for k, v in want.items() if k != v}


def vectors(seed=8):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(12):
        c = rng.normal(size=20)
        out += [(c + rng.normal(size=20) * rng.choice([0.1, 0.25, 0.4])).astype(np.float32).tolist() for _ in range(rng.integers(1, 14))]
    out += [out[0]] * 5 + [[2 * x for x in out[1]], None, [0.0] * 20, [None] * 20, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [1.0, 2.0], [2.0, 4.0], []]
    return list(enumerate(out, 10))


def test_embeddings_match_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, size int")
    sound = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}

    def linked(a, b):
        if a not in sound or b not in sound or len(sound[a]) != len(sound[b]):
            return False
        return float(sound[a] @ sound[b] / np.linalg.norm(sound[a]) / np.linalg.norm(sound[b])) >= 0.9

    ids = [i for i, _ in rows]
    want = brute_components([(i, i) for i in ids], linked)
    for tile in (4096, 16):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
        assert got == {i: (sum(linked(i, j) for j in ids if j != i), want[i], want[i] == i) for i in ids}
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0
    assert embedding_dedup.near_duplicates(df.where("embedding is null")).first().n_links == 0


@pytest.mark.parametrize("tile", [4096, 4])
def test_embeddings_in_double_precision(spark, tile):
    rng = np.random.default_rng(5)
    a = rng.normal(size=8)
    a /= np.linalg.norm(a)
    b = rng.normal(size=8)
    b -= (b @ a) * a
    b /= np.linalg.norm(b)
    at = lambda c: (c * a + math.sqrt(1 - c * c) * b).tolist()
    rows = [(1, a.tolist()), (2, at(0.9 + 1e-9)), (3, at(0.9 - 1e-9)), (4, (a * 1e300).tolist()), (5, (a * 1e-300).tolist()), (6, (-a).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
    assert got == {1: 3, 2: 4, 3: 1, 4: 3, 5: 3, 6: 0}


# --- queries and pipeline -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_has_a_row_for_each_input_row(name, spark):
    got = queries()[name](spark, SMALL)
    source = "embeddings" if "embedding" in name else "documents"
    assert got.count() == spark.read.parquet(f"{SMALL}/{source}.parquet").count()


def test_pipeline_against_brute_force(spark, small, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs, kept = small, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == small.columns
        docs = spark.createDataFrame(docs.collect(), small.schema)
        kept.append([r.doc_id for r in docs.collect()])
    first = {}
    for i in sorted(kept[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert sorted(kept[1]) == sorted(first.values())
    near = brute_components([(i, shingles(texts[i], 5)) for i in kept[1]], alike)
    assert sorted(kept[2]) == sorted(set(near.values()))
    assert set(kept[3]) <= set(kept[2])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sorted(r.doc_id for r in last) == sorted(kept[3])
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_embedding_rows_that_are_unsound_or_alike_come_back_whole(spark):
    """Most rows are null or copies of one vector, and a null id stays with its row."""
    one, other = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(i, None) for i in range(40)] + [(100 + i, one) for i in range(30)] + [(200, other), (None, one), (None, None), (201, [float("nan"), 1.0, 0.0]), (202, [0.0, 0.0, 0.0]), (203, [])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows) and sum(r.vec_id is None for r in got) == 2
    told = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert told[None] == (0, None, True)
    assert all(told[100 + i] == (29, 100, i == 0) for i in range(30))
    assert all(told[i] == (0, i, True) for i in [*range(40), 200, 201, 202, 203])
