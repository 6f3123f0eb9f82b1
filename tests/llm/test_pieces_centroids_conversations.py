"""Piece BPE against the library, centroids and conversation repair against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tickloom.llm import centroids, conversations, piece_bpe
from tickloom.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_centroids", "op13_conversation_repair"])
def test_twin(name, spark, sf, same):
    same(queries()[name](spark, sf), oracle_sql()[name])


# --- pieces -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return piece_bpe.Model(f.read())


def _odd_texts():
    r = random.Random(7)
    letters = "\n\nab thes,.\n\t日é\U0001f600▁\r<>0x4  "
    some = ["".join(r.choice(letters) for _ in range(r.randrange(70))) for _ in range(1500)]
    fixed = ["", " ", "  ", "\n", " \n", "\n ", "a", "  x  y ", "▁a▁▁b", "日本 \x00 ퟿ <s> </s> <0x41> <unk>", "a b\n\nc", "a" * 5_000, "abc" * 3_000, "x y" * 3_000, "the " * 9_000, "\r" * 50]
    return fixed + some


def test_pieces_equal_the_library_on_odd_texts(model, library):
    texts, encoder, table = _odd_texts(), piece_bpe.PieceEncoder(model, most=50), model.table()
    for part in (texts[:40], texts[40:], texts[:300]):  # the last time from what is remembered
        for t, got in zip(part, encoder.encode(part), strict=True):
            want = library.encode(t)
            assert got == " ".join(map(str, want)), t
            assert piece_bpe.decode_ids(got.split(" ") if got else [], table) == library.decode(want), t


def test_agenda_of_one_word_equals_all_agendas_together(model):
    r = random.Random(3)
    words = ["▁" + "".join(r.choice("thering安 é") for _ in range(r.randrange(1, 40))).replace(" ", "▁") for _ in range(400)]
    for w, got in zip(words, piece_bpe._agendas(words, model), strict=True):
        ids = [i for s in piece_bpe.merge(w, model.rank) for i in ([model.id[s]] if s in model.id else [model.byte[b] for b in s.encode()])]
        assert got == " ".join(map(str, ids))


def test_pieces_over_a_whole_table(spark, library):
    got = {r.doc_id: r for r in queries()["op12_piece_bpe"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert got[d.doc_id].decoded_sha256 == sha(library.decode(ids))


def test_pieces_of_nulls_repeated_rows_and_empty_tables(spark, library):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b", 5), (3, "a b", 5), (None, "c", 5)], "doc_id long, text string, ids int")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids, r.text) for r in piece_bpe.round_trip(df, MODEL).collect())
    ab, c = (" ".join(map(str, library.encode(t, add_eos=True))) for t in ("a b", "c"))
    assert got == [("1", 1, "2", ""), ("2", 1, "2", ""), ("3", 3, ab, "a b"), ("3", 3, ab, "a b"), ("None", 2, c, "c")]
    assert piece_bpe.round_trip(df.limit(0), MODEL).count() == 0
    ids = piece_bpe.round_trip(df, MODEL, end=False).select(piece_bpe.as_array("ids").alias("a")).collect()
    assert sorted(len(r.a) for r in ids) == [0, 0, 1, 2, 2]


def test_a_difference_from_the_library_is_an_error(model):
    encoder = piece_bpe.PieceEncoder(model, check=lambda texts: [[0] for _ in texts])
    with pytest.raises(RuntimeError):
        encoder.encode(["some words"])


def test_other_kinds_of_model_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.Model(b"")


# --- centroids ----------------------------------------------------------------------------------------------------


def _brute(rows, k=8, rounds=10, dims=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(np.float64(x) * 1024)) if abs(x) < 2**40 else int(x) * 1024 for x in v]) for i, v in kept]
    cents = [v for _, v in sorted(((sha(f"3:{i}") if i is not None else "~", v) for i, v in ints), key=lambda p: p)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in ints]
        for n in range(len(cents)):
            mine = [v for (_, v), c in zip(ints, of, strict=True) if c == n]
            if mine:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *near(v)) for i, v in ints]
    total = {n: sum(d for _, d, c in out if c == n) for n in range(len(cents))}
    return sorted((str(i), c, d, total[c], sum(total.values()), sha(",".join(map(str, cents[c])))) for i, d, c in out)


def _clusters(df, **options):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clusters_with_sums(df, **options).collect())


def test_clusters_of_odd_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-0.25, 0.0, 0.125, 1.0, 3.75]) for _ in range(64)]) for i in range(40)]
    rows += [(40, rows[0][1]), (0, rows[0][1]), (None, rows[3][1]), (41, [0.0] * 64), (42, [0.0] * 64), (43, [1.0] * 63), (44, None), (45, [None] + [0.0] * 63), (46, [float("nan")] + [0.0] * 63), (47, [float("-inf")] * 64), (48, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int")
    assert _clusters(df) == _brute(rows)
    assert _clusters(df.limit(0)) == [] and _clusters(df.where("vec_id in (41, 42)")) == _brute(rows[43:45])


def test_clusters_of_huge_components_are_exact(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randrange(-(2**18), 2**18)) / 4 for _ in range(64)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert _clusters(df) == _brute(rows)
    huge = spark.createDataFrame([*rows, (99, [1e300] * 64)], "vec_id long, embedding array<double>")
    assert len(_clusters(huge)) == 31 and {x[2] is None for x in _clusters(huge) if x[0] != "99"} == {False}


def test_progressive_search_equals_all_distances_and_eliminates():
    rng = np.random.default_rng(5)
    cents = rng.integers(-900, 900, (8, 64))
    x = np.concatenate([cents[rng.integers(0, 8, 300)] + rng.integers(-40, 40, (300, 64)), rng.integers(-2, 2, (300, 64)), np.zeros((3, 64), np.int64)])
    cents[5] = cents[2]  # ties go to the smaller number
    at, d, out = centroids.nearest(x, cents)
    every = ((x[:, None] - cents[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (d == every.min(1)).all() and out > 600
    assert (np.array(centroids.nearest(x.astype(object), cents)[1], np.int64) == d).all()


def test_walsh_orders_by_sequency_and_keeps_distances():
    rows = centroids.walsh(np.eye(16, dtype=np.int64)).T
    assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(16))
    assert (rows @ rows.T == 16 * np.eye(16)).all()


# --- conversations ------------------------------------------------------------------------------------------------

ODD = re.compile(r"[^\x20\x09-\x0D]")


def _damage(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _exhaustive(rows):
    """All edits of a conversation tried out."""
    seen, facts = set(), []
    for role, text in rows:
        blank, last = not ODD.search(text), (ODD.findall(text) or [""])[-1]
        facts.append((blank or (role, text) in seen, not blank and (role, text) not in seen and last not in ".!?", blank, (role, text) in seen))
        seen.add((role, text))
    choices = []
    for (role, text), (gone, cut, *_ ) in zip(rows, facts, strict=True):
        keep = [(5 * cut, "K", [(role, text)]), *((1 + 5 * cut, "R", [(w, text)]) for w in ("user", "assistant"))]
        own = [(2, "D", [])] + ([] if gone else keep)
        insert = [(0, "", [])] + [(5, "I", [(w, "")]) for w in ("user", "assistant")]
        choices.append([(a + b, x + y, p + q) for a, x, p in insert for b, y, q in own])
    best = None
    for path in itertools.product(*choices, [(0, "", [])] + [(5, "I", [(w, "")]) for w in ("user", "assistant")]):
        out = [t for p in path for t in p[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            got = (sum(p[0] for p in path), "".join(p[1] for p in path), "\n".join(f"{r}:{t}" for r, t in out))
            best = min(best or got, got)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
    blank, twice, cut = sum(f[2] for f in facts), sum(f[3] and not f[2] for f in facts), sum(f[1] for f in facts)
    return blank, twice, cut, sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], sha(best[2])


def test_repair_equals_all_edits_tried_out(spark):
    r, rows = random.Random(11), []
    texts = ["Yes.", "No!", "half", " ", "", None, "Why? ", "a\n.\n", "x."]
    for c in [None, *range(60)]:
        for t in range(r.randrange(1, 5)):
            rows.append((c, r.choice([t, t, t, None, 2]), r.choice(["user", "assistant", "system", "tool", "", None, "user"]), r.choice(texts)))
    df = spark.createDataFrame([(*x, "k", 3) for x in rows], "conv_id long, turn long, role string, text string, conv string, n int")
    got = {x.conv_id: tuple(x)[1:] for x in conversations.repair(df).collect()}
    assert set(got) == {x[0] for x in rows}
    for c, mine in got.items():
        left = sorted((x for x in _damage(rows) if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        turns = {x[1] for x in left} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        assert mine == (gaps, *_exhaustive([x[2:] for x in left])), (c, left)
    assert conversations.repair(df.limit(0)).count() == 0


def test_long_conversations_span_blocks_and_tasks(spark, monkeypatch):
    r = random.Random(5)
    rows = [(r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "no", "Why?", " "]) + str(r.randrange(60)) + ".") for _ in range(700)]
    df = spark.createDataFrame([(1, t, a, b) for t, (a, b) in enumerate(rows)], "conv_id long, turn long, role string, text string")
    whole, _ = conversations.repaired(df)
    want = whole.first()
    monkeypatch.setattr(conversations, "BLOCK", 8)
    blocks, lines = conversations.repaired(df)
    assert blocks.first() == want and want.cost > 100 and len(want.audit) == 700
    text = "\n".join(x for (_, xs) in sorted((x.rid, x.lines) for x in lines.collect()) for x in xs)
    assert sha(text) == want.repaired_sha256


def test_many_equal_rows_are_one_with_their_number(spark):
    one = spark.createDataFrame([(7, 1, "user", "Hm.", 3000), (7, 2, "assistant", "Ah.", 1), (8, None, "x", "", 2)], "conv_id long, turn long, role string, text string, n long")
    got = {r.conv: r for r in conversations.repaired(one)[0].collect()}
    assert got["7"].audit == "K" + "D" * 2999 + "K" and got["7"].cost == 5998 and got["7"].duplicate == 2999 and got["7"].illegal == 2999
    assert (got["8"].audit, got["8"].blank, got["8"].gaps, got["8"].repaired_sha256) == ("DD", 2, 0, sha(""))


def test_inserts_when_they_are_the_cheapest(spark):
    df = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A.")], "conv_id long, turn long, role string, text string")
    out, _ = conversations.repaired(df, conversations.Costs(rerole=9, delete=9, insert=2))
    r = out.first()
    assert (r.cost, r.audit, r.repaired_sha256) == (2, "KIK", sha("system:S.\nuser:\nassistant:A."))


# --- bounded samples ----------------------------------------------------------------------------------------------


def test_a_long_text_takes_no_language_or_domain_out_of_a_sample(spark):
    from pyspark.sql import functions as F

    from tickloom.llm import lang_id, mixing

    rows = [(i, "wort " * (4000 if i == 1 else 20), "de") for i in range(60)] + [(100 + i, "word " * 20, "en") for i in range(60)] + [(300, "parola " * 9000, "it")]
    # whatever the order of the hashes, the long text is the one that is left out
    for shift in range(3):
        df = spark.createDataFrame([(i + 1000 * shift, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
        langs = lang_id.train(df, max_chars=9_000).langs
        assert {"de", "en"} <= set(langs) and set(langs) <= {"de", "en", "it"}
    marks = df.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    label = mixing._labelled(marks)
    got = mixing._sample(df.select("doc_id", "text"), label, 1000, 9_000)
    assert got.count() > 50 and got.agg(F.max(F.length("text"))).first()[0] < 1000
    assert mixing._sample(df.where("lang = 'it'").select("doc_id", "text"), label, 1000, 10).count() <= 1
