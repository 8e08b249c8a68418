"""The three newest operators against brute force and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sitesignal.llm import resampling as R
from sitesignal.llm import spelling as W
from sitesignal.llm import toxicity as X
from sitesignal.llm.pieces import Encoder, Pieces
from sitesignal.llm.queries import QUERIES, tokenizer_file
from sitesignal.llm.text import maybe_wanted

DOCS = "doc_id long, text string, lang string, weight string, rank int, form string, toxic int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like those the operators make."""
    long = " ".join("word%d" % (i % 977) for i in range(30_000)) + " " + "q" * 5000
    texts = [None, "", "  ", "a", "Ünï-cödé 日本 x\x00y 1_2", long, "one two three " * 10, "one two three " * 10, "\x7f{A}Z[z]`0/9:", "abcdefgh abcdefgi"]
    rows = [(i, t, "en", "w", i, "f", 1 if i == 6 else 0) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "one two three " * 10, None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, Counter(zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1))


def drawn(rows, target):
    raw, wanted = Counter(), Counter()
    found = [(r[0], *grams(r[1])) for r in rows]
    for _, _, g in found:
        raw += g
    for t in target:
        wanted += grams(t)[1]
    s_all, t_all = sum(raw.values()) + 10_000, sum(wanted.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * s_all / ((n + 1.0) * t_all))) for b, n in raw.items()}
    out = []
    for ident, words, g in found:
        weight = sum(n * gain[b] for b, n in g.items())
        h = int(hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append((ident, len(words), sum(g.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    quota = len(able) * 5 // 100
    return Counter((i, n, w, s) for i, _, n, w, s in out), [r[0] for r in able[:quota]]


def test_resampling_against_brute_force(spark, awkward):
    r = random.Random(4)
    vocabulary = ["w%d" % i for i in range(200)] + ["Ünder", "日本", "X9"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 90))).replace(" ", r.choice([" ", ", ", "\n"]))) for i in range(600)]
    rows += [(i, rows[i][1]) for i in range(0, 600, 9)]
    target = [" ".join(r.choice(vocabulary[:30]) for _ in range(50)) for _ in range(20)] + [None, ""]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resampled(docs.repartition(5), wanted).collect()
    scores, order = drawn(rows, target)
    assert Counter((g.id, g.n_features, g.weight, g.score) for g in got) == scores
    assert [g.id for g in sorted((g for g in got if g.rank is not None), key=lambda g: g.rank)] == order
    assert sorted(g.rank for g in got if g.rank is not None) == list(range(1, len(order) + 1))
    odd, odd_rows = awkward
    got = R.resampled(odd, wanted, percent=50).collect()
    assert Counter((g.id, g.n_features, g.weight, g.score) for g in got) == drawn(odd_rows, target)[0]
    ranks = sorted(g.rank for g in got if g.rank is not None)
    assert ranks == [1, 2, 3] and R.resampled(odd.limit(0), wanted).count() == 0
    assert R.resampled(odd, wanted.limit(0)).count() == len(odd_rows)
    left = R.draw(odd, wanted, percent=50)
    assert left.columns == odd.columns and left.count() == 3


def test_runs_do_not_cross_documents():
    joined = R.Joined([b"a b", b"c", b"", b"d " + b"e" * 300 + b" f"])
    found = [Counter(zip(t.tolist(), b.tolist())) for t, b in joined.features()]
    want = [[(0, "a"), (0, "b"), (1, "c"), (3, "d"), (3, "e" * 300), (3, "f")], [(0, "a b"), (3, "d " + "e" * 300), (3, "e" * 300 + " f")], [(3, "d " + "e" * 300 + " f")]]
    assert found == [Counter((t, zlib.crc32(s.encode()) % R.BUCKETS) for t, s in own) for own in want]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelled(counts, ratio=10):
    out, forms = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = len(others)
    root = lambda w: w if forms[w] is None else root(forms[w])
    return {(w, forms[w], root(w), counts[w], out[w], counts.get(forms[w])) for w in counts}


def test_spelling_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    counts = {}
    for base in ["".join(r.choice("abà") for _ in range(r.randrange(1, 9))) for _ in range(120)] + ["aaaa", "aaaaa", "aaaaaa", "x" * 3000, "x" * 3001, "x" * 2999 + "y"]:
        counts[base] = r.choice([1, 2, 5, 20, 50, 200, 2000, 2000, 20_000])
        for _ in range(3):
            i = r.randrange(len(base))
            edit = r.choice([base[:i] + base[i + 1:], base[:i] + r.choice("abà") + base[i:], base[:i] + r.choice("abà") + base[i + 1:]])
            if edit:
                counts.setdefault(edit, r.choice([1, 2, 5, 20, 200]))
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    for parts in (1, 7):  # ranges share beginnings and endings with the ones before
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {tuple(g) for g in W.variants(frame).collect()}
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        assert got == spelled(counts)
    assert W.variants(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        W.variants(frame, ratio=1)


def test_words_counted(spark, awkward):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["Straße", "ÉTÉlongue", "abcdefgh", "ABCDEFGH", "kurz", "naïvement", "x-abcdefgh"]) for _ in range(40))) for i in range(60)]
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{low}".encode())
            at = h % len(low)
            want[low[:at] + low[at + 1:] if h % 31 == 0 else low] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g.word: g.n for g in W.counted(docs, drop_every=31).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2} and any(len(w) == 7 for w in got)
    odd, _ = awkward
    assert W.counted(odd).count() == 0  # the long run occurs once, and so do both near words
    assert {(g.word, g.n_near) for g in W.variants(W.counted(odd, min_count=1)).collect()} == {("q" * 5000, 0), ("abcdefgh", 1), ("abcdefgi", 1)}
    assert W.counted(odd.limit(0)).count() == 0


def test_isotonic_and_trees():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = X.boosted(x, y)
    assert (((model.margin(x) > 0) == y).mean()) > 0.97
    for n in (1, 2, 7, 40):
        margin, y = np.round(r.normal(size=n), 1), r.integers(0, 2, n).astype(float)
        knots, shares = X.isotonic(margin, y)
        assert (np.diff(knots) > 0).all() and (np.diff(shares) > 0).all()
        # the least squares fit of a rising function: minimum over later of maximum over earlier means
        places = np.unique(margin)
        mean = lambda a, b: y[(margin >= a) & (margin <= b)].mean()
        fit = [max(min(mean(a, b) for b in places[places >= p]) for a in places[places <= p]) for p in places]
        assert sorted(set(np.round(fit, 9))) == np.round(shares, 9).tolist()


def test_features_of_disguise_and_second_person():
    f = X.Features({"idiot": 3.0, "clow*": 1.0})
    names = X.FEATURES
    one = dict(zip(names, f.of("YOU are an 1d10t and an i.d.i.o.t, you idiot!")))
    assert one["hidden_hits"] > 0 and one["hits_near_second_person"] > 0 and one["largest_weight"] == 3.0 and one["exclamations"] > 0
    assert dict(zip(names, f.of("clowning")))["beginning_density_4"] == 1.0 and len(f.of(None)) == len(names) == len(f.of("x" * 200_000))
    assert X.clear("@$$") == "ass" and X.clear("tr@sh") == "trash"


def test_toxicity_on_held_out_rows(spark, awkward):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op11_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) >= 0.95 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)
    low, high = [r.score for r in rows if not r.toxic], [r.score for r in toxic]
    assert all(0 <= s <= 1 for s in low + high) and np.mean([a < b for a, b in itertools.product(low, high)]) > 0.99
    odd, odd_rows = awkward
    known = odd.select("doc_id", "toxic")
    for learn in (known, known.limit(0), known.withColumn("toxic", X.F.lit(None).cast("int"))):
        model = X.fit(odd, learn, X.F.lit(True))
        assert X.scored(odd.select("doc_id", "text", "rank"), model).filter("score between 0 and 1").count() == len(odd_rows)
    assert X.scored(odd.select("doc_id", "text").limit(0), X.fit(odd.limit(0), known, X.F.lit(True))).count() == 0


def test_encoder_forgets_within_its_bounds(monkeypatch):
    from sitesignal.llm import pieces as P
    pieces = Pieces(tokenizer_file("piece_bpe_32k.model"))
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(400)) for _ in range(60)]
    want = [x for t in texts for x in Encoder(pieces, 4).encode([t])]
    monkeypatch.setattr(P, "WORD_BYTES", 20_000)
    monkeypatch.setattr(P, "SEARCH_BYTES", 5_000)
    monkeypatch.setattr(P, "CELLS", 100)
    small, got = Encoder(pieces, 4), []
    for t in texts:
        got += small.encode([t])
        assert small.searched_bytes <= 5_000
    assert all([s for s, _ in a] == [s for s, _ in b] and all((x == y).all() for (_, x), (_, y) in zip(a, b)) for a, b in zip(want, got))


@pytest.mark.parametrize("text, count", [("".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(100_000)), 8), ("ab" * 50_000, 8),
                                         ("日本" * 20_000, 1)])  # no piece joins these two characters
def test_long_text_without_blanks(text, count):
    pieces = Pieces(tokenizer_file("piece_bpe_32k.model"))
    found = Encoder(pieces, 8).encode([text])[0]
    assert len(found) == count and all(pieces.decode(ids.tolist()) == text for _, ids in found) and sorted((s for s, _ in found), reverse=True) == [s for s, _ in found]


def test_filter_keeps_all_wanted(spark):
    rows = spark.range(20_000).selectExpr("id", "sha2(cast(id AS string), 256) AS k")
    wanted = rows.filter("id % 50 = 0").selectExpr("k AS w")
    kept = maybe_wanted(rows, wanted, "w", "k")
    assert kept.filter("id % 50 = 0").count() == 400 and kept.count() < 5_000 and kept.columns == rows.columns
