"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitesignal.llm import exact_dedup as X
from sitesignal.llm import html_text as H
from sitesignal.llm import language as L
from sitesignal.llm import mixing as M
from sitesignal.llm import near_dedup as N
from sitesignal.llm import pieces as P
from sitesignal.llm import quality as Q
from sitesignal.llm import substring_dedup as S
from sitesignal.llm import token_files as T
from sitesignal.llm import url_filter as U
from sitesignal.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, kept boolean, sha string, row string, size int"


def words(n, seed, vocabulary=5000):
    r = random.Random(seed)
    return ["w%d" % r.randrange(vocabulary) for _ in range(n)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like those the operators make."""
    long = " ".join(words(30_000, 1))
    texts = [None, "", "  ", "a", "a b  c", "a b c", "a\tb\nc", long, long, " ".join(words(80, 2)), "\x00 é 日本 ▁ 𝄞", "'s don't !!!"]
    rows = [(i, t, "en" if i % 2 else None, "s%d" % (i % 3) if i % 4 else None, None, "x", "y", i) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "a b c", None, None, True, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS), rows


def squeeze(text):
    import re
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_golomb_round_trip():
    r = np.random.default_rng(0)
    for n, span in ((1, 10), (50, 64), (1000, 1 << 30)):
        values = np.unique(r.integers(0, span, n))
        k, unary, rests = X.golomb_encode(values, span)
        assert (X.golomb_decode(len(values), k, unary, rests) == values).all()


def test_exact_groups(awkward):
    docs, rows = awkward
    groups = defaultdict(list)
    for r in rows:
        groups[squeeze(r[1])].append(r[0])
    got = X.exact_groups(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (i is None, i or 0))
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((g.id, g.keep_id, g.group_size, g.sha) for g in got) == want
    assert sum(g.kept for g in got) == len(groups)
    left = X.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    stays = {(min(ids, key=lambda i: (i is None, i or 0)), text) for text, ids in groups.items()}
    assert {(r.doc_id, squeeze(r.text)) for r in left.collect()} == stays
    assert X.exact_groups(docs.limit(0)).count() == 0


def test_mixing(spark, awkward):
    r = random.Random(3)
    rows = [(i, " ".join("x" * r.randrange(1, 60)), None, r.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {g.id: g for g in M.allocation(docs).collect()}
    sizes, by_source = {i: len(t.split()) for i, t, _, _ in rows}, Counter()
    for i, _, _, s in rows:
        by_source[s] += sizes[i]
    ranked = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(ranked)}
    target, open_, left = {}, set(ranked), 1.5 * sum(by_source.values())
    while True:  # deal out the excess until no source is above its limit
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * by_source[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * by_source[s]
        open_ -= set(over)
        left = 1.5 * sum(by_source.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for i, _, _, s in rows:
        assert (got[i].size, got[i].source_size) == (sizes[i], by_source[s]) and got[i].target == pytest.approx(target[s])
        assert got[i].taken in (0, sizes[i], 2 * sizes[i])
        taken[s] += got[i].taken
    assert sum(taken.values()) <= 1.5 * sum(by_source.values()) and all(abs(taken[s] - target[s]) <= 120 for s in ranked)
    assert {g.id: g.taken for g in M.allocation(docs.repartition(7)).collect()} == {i: g.taken for i, g in got.items()}
    odd, odd_rows = awkward
    assert M.allocation(odd).count() == len(odd_rows) and M.mixed(odd).columns == odd.columns
    assert M.allocation(odd.limit(0)).count() == 0


def test_rules_and_segments(spark):
    urls = [(1, "https://A.example.com/en/1?x", "allow?"), (2, "http://www.example.com/en/2#t", None), (3, "https://x.net/fr/1", None), (4, "x.net/es/", None),
            (5, None, None), (6, "https://example.com", None), (7, "https://thble.org/en/1", None), (7, "https://thble.org/en/1", None)]
    pages = spark.createDataFrame([(i, u, "<title>the thble and the</title>", v) for i, u, v in urls], "page_id long, url string, html string, verdict string")
    got = {g.id: g for g in U.judged(pages).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3)] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/fr/", "block")]
    assert (got[1].host, got[1].path) == ("a.example.com", "/en/1") and (got[4].host, got[5].path, got[6].rule) == ("", "", None)
    assert all(g.verdict in ("allow", "block") for g in got.values()) and U.judged(pages.limit(0)).count() == 0
    counts = {"a": 5, "ab": 3, "abc": 1, "c": 4, "bca": 2}
    segmenter = U.Segmenter(counts)
    for name in map("".join, itertools.product("abcd", repeat=5)):
        splits = ([name[i:j] for i, j in zip((0, *cut), (*cut, 5))] for k in range(5) for cut in itertools.combinations(range(1, 5), k))
        cost = lambda parts: sum(segmenter.cost.get(p, segmenter.unknown if len(p) == 1 else float("inf")) for p in parts)
        assert cost(segmenter.split(name)) == pytest.approx(min(map(cost, splits)))


def test_elias_fano_and_token_files(spark, awkward):
    r = np.random.default_rng(1)
    values = np.cumsum(r.integers(0, 900, 2000))
    code = T.EliasFano.of(values, int(values[-1]) + 1)
    assert (code.all() == values).all() and all(code.select(i) == values[i] for i in range(0, 2000, 7))
    docs, rows = awkward
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    shards = T.encoded_shards(docs, T.word_tokenizer(tokenizer_file("word_bpe_49k.json")), 1, shard_ids=5000)
    got = T.read_documents(shards.persist()).collect()
    want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, *_ in rows]
    import zlib
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == Counter((row[0], len(w), zlib.crc32(w.tobytes())) for row, w in zip(rows, want))
    ordered = sorted(got, key=lambda g: g.start)
    assert [g.start for g in ordered] == [0, *itertools.accumulate(g.n_tokens for g in ordered)][:-1]
    assert [g.doc_id for g in ordered if g.doc_id is not None] == sorted(row[0] for row in rows if row[0] is not None)
    image = T.Shard(shards.first().image)
    assert sum(len(image.document(i)) for i in range(image.n_docs)) == image.n_ids
    assert T.read_documents(T.encoded_shards(docs.limit(0), T.word_tokenizer(tokenizer_file("word_bpe_49k.json")), 1)).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 62, 300).astype(np.uint64)
    for weighted in (False, True):
        a, b = base[:250], base[50:]
        wa, wb = (r.uniform(0.2, 3, 250), r.uniform(0.2, 3, 250)) if weighted else (np.ones(250), np.ones(250))
        x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
        true = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
        k = 2048
        sets = N.dart_signatures(np.concatenate([a, b]), np.array([0, 250, 500]), k, np.concatenate([wa, wb]) if weighted else None)
        assert abs((sets[0] == sets[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5


def shingle_set(text):
    w = squeeze(text).split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_classes_against_all_pairs(spark, awkward):
    r, rows = random.Random(5), []
    for g in range(30):
        base = words(120, 100 + g)
        for c in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 12])):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))
    top = lambda i: i if parent[i] == i else top(parent[i])
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[max(top(i), top(j))] = min(top(i), top(j))
    got = N.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.id: g.class_id for g in got} == {i: top(i) for i in range(len(rows))}
    assert sum(g.kept for g in got) == len({top(i) for i in range(len(rows))})
    docs, odd = awkward
    assert N.near_classes(docs).count() == len(odd) and N.drop_near_copies(docs).columns == docs.columns
    assert N.near_classes(docs.limit(0)).count() == 0


def test_languages_of_held_out_texts(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.filter("doc_id % 4 <> 2"))
    got = L.predicted(docs.filter("doc_id % 4 = 2").select("lang", "text"), model).collect()
    assert sum(g.lang == g.lang_pred for g in got) >= 0.97 * len(got) and all(0 <= g.score <= 1 for g in got)
    odd, rows = awkward
    judged = L.predicted(odd.select("doc_id", "text"), model).collect()
    assert len(judged) == len(rows) and {g.lang_pred for g in judged if g.doc_id in (0, 1, 2)} == {"und"}
    assert L.predicted(odd.select("text"), L.fit(odd.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert model.predict(["0x1f 9f3c zq"] * 2)[2].all()  # far from every centroid


def test_quality(spark, awkward):
    r = random.Random(7)
    for _ in range(200):
        w = [r.choice("abc") for _ in range(r.randrange(0, 30))]
        runs = Counter(zip(w, w[1:], w[2:]))
        inside = {i + k for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] > 1 for k in range(3)}
        assert Q.repeated_words(w) == len(inside)
    text = "a## b" + "\n" * 2 + "c d\n" * 3 + " c d\n "
    assert Q.base_counts(text, Q.code_points(text)) == (10, 12, 2, 2, 8)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality_report(docs, labels).join(labels, Q.F.col("id") == labels["doc_id"]).filter("NOT base_failed").collect()
    assert sum(g.kept == (g.quality == 1) for g in got) >= 0.98 * len(got)
    odd, rows = awkward
    assert Q.quality_report(odd, labels).count() == len(rows) and Q.keep_good(odd, labels).columns == odd.columns
    assert Q.quality_report(odd.limit(0), labels).count() == 0 and Q.quality_report(odd, labels.limit(0)).filter("score <> 0").count() == 0


PARA = "The quick brown fox is one of the animals that we have seen in the woods and it was not at all afraid of us when we came by."


UNLISTED = (
    "Вчера вечером в городе открылась новая выставка, на которой представлены работы местных художников и скульпторов.",
    "昨日の夕方、市内の美術館で新しい展覧会が始まり、地元の画家や彫刻家の作品が数多く展示されました。",
    "Ontem à tarde abriu na cidade uma nova exposição com trabalhos de artistas locais que vieram de várias regiões do país.",
    "Wczoraj wieczorem w mieście otwarto nową wystawę, na której pokazano prace miejscowych malarzy i rzeźbiarzy.",
    "افتتح مساء أمس في المدينة معرض جديد يضم أعمال فنانين محليين جاؤوا من مناطق مختلفة من البلاد ومن خارجها.",
)


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<p>a &lt;b", ""), (f"<p>{PARA}</p>" * 3, f"{PARA} {PARA} {PARA}"),
    (f"<title>t</title><nav><a href=x>m</a></nav><div class='ad'>{PARA}</div><article><h1>T &amp; t</h1><p>{PARA}<p>Oh\n no.</p></article><footer>&copy; me</footer>",
     f"T & t {PARA} Oh no."),
    (f"<article><p>{PARA}</p><!-- x > y --><aside>{PARA}</aside><script>var a='</p>';</script><form>name</form><p>End.</p><div id='comments'><p>{PARA}</p></div></article>",
     f"{PARA} End."),
    *((f"<nav><a href=/>{line[:9]}</a></nav>" + f"<p>{line}</p>" * 3 + f"<p>{line[:20]}</p><footer>{line}</footer>", " ".join([line] * 3)) for line in UNLISTED),
    (f"<p>{UNLISTED[0]}</p><p>Да.</p><p>{UNLISTED[0]}</p>", f"{UNLISTED[0]} Да. {UNLISTED[0]}"),
    (f"<p>{PARA}</p>" * 4 + "<p>Apples Pears Plums Cherries Lemons Limes Melons Grapes Figs Dates Kiwis Mangos Peaches</p>", " ".join([PARA] * 4)),
    (f"<div class=cookie-notice>We use {PARA}</div><main><p><b>a</b>b <a href='y'>link</a> {PARA}</p></main>", f"ab link {PARA}"),
])
def test_main_text(html, want):
    assert H.main_text(html) == want


def test_pages_whole(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<p>" * 5000 + PARA, "y"), (2, "u", '<a "' * 20000, "z")], "page_id long, url string, html string, text string")
    got = H.extracted(pages)
    assert got.columns == ["id", "url", "text", "n_chars"] and H.extracted(pages.limit(0)).count() == 0
    assert sorted((g.id, g.url, g.text[:9], g.n_chars) for g in got.collect() if g.id == 1 or g.text == PARA) == [(1, None, "", 0), (2, "u", PARA[:9], len(PARA))]
    assert got.count() == 3


@pytest.mark.parametrize("piece", ["<a ", "</p ", '<a "', "<a'<", "<!-", "<script", "<b><i ", "<" + "x" * 50])
def test_broken_pages_take_linear_time(piece):
    import time
    start = time.process_time()
    H.main_text(piece * (1_000_000 // len(piece)))
    H.main_text(piece * (1_000_000 // len(piece)) + ">")
    assert time.process_time() - start < 10


def test_nbest_against_all_segmentations(spark, awkward):
    pieces = P.Pieces(tokenizer_file("piece_bpe_32k.model"))

    def every(text, at=0):
        if at == len(text):
            return [(0.0, ())]
        return [(s + v, ids + own) for end in range(at + 1, len(text) + 1) for start, v, ids in edges[end] if start == at for s, own in every(text, end)]

    for text in ("thing", "ing.\nA", "日x", "▁a", "tt tt", "to be"):
        whole = []
        for word in text.split(" "):
            edges = pieces.edges(P.BLANK + word, True)
            whole.append(every(P.BLANK + word))
        sums = sorted((sum(s for s, _ in choice) for choice in itertools.product(*whole)), reverse=True)[:3]
        got = P.Encoder(pieces, 3).encode([text])[0]
        assert [s for s, _ in got] == sums and all(pieces.decode(ids.tolist()) == text for _, ids in got)
        assert len({tuple(ids.tolist()) for _, ids in got}) == len(got)
    docs, rows = awkward
    got = P.digest(docs, tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows) and all(g.round_trip for g in got)
    assert P.encoded(docs, tokenizer_file("piece_bpe_32k.model")).columns == [*docs.columns, "scores", "segmentations"]
    assert P.digest(docs.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_chains_and_alignment():
    r = random.Random(9)
    for _ in range(50):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(0, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert S.common_words(a, b) == best[-1][-1]
        parts = np.array([(r.randrange(60), r.randrange(60), r.randrange(3, 9)) for _ in range(7)])

        def score(order):
            total = 0.0
            for k, i in enumerate(order):
                x, y, n = parts[i]
                if k:
                    px, py, pn = parts[order[k - 1]]
                    if px + pn > x or py + pn > y:
                        return -1
                    total -= S.GAP_COST * (x - px - pn + y - py - pn)
                total += n
            return total

        found = max(score([i for i in order]) for k in range(1, 8) for order in itertools.permutations(range(7), k) if k < 5)
        assert score(S.chains(parts)[0]) >= found - 1e-9


def test_planted_passages(spark, awkward):
    shared, other = words(70, 50), words(60, 51)
    fuzzy = [w if i % 30 != 15 else "edit" for i, w in enumerate(shared)]
    texts = [words(100, 60) + shared + words(40, 61), words(20, 62) + fuzzy + words(90, 63), words(50, 64) + other, other + words(9, 65), words(200, 66),
             words(30, 67) + shared[:30] + words(30, 68)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(g.id, g.other_id): g for g in S.passages(docs).collect()}
    assert set(got) == {(1, 0), (3, 2)}
    assert (got[1, 0].at, got[1, 0].n_words, got[1, 0].other_at, got[1, 0].matched) == (20, 70, 100, 68)
    assert (got[3, 2].at, got[3, 2].n_words, got[3, 2].other_at) == (0, 60, 50)
    odd, _ = awkward
    whole = S.passages(odd).collect()
    assert [(g.id, g.other_id, g.whole) for g in whole] == [(8, 7, True)] and S.passages(odd.limit(0)).count() == 0


def test_two_passages_in_one_pair(spark):
    rows, want = [], {}
    for gap in (0, 5, 20, 40, 70, 100, 150, 300, 500):
        for size in (60, 100, 200):
            n = len(rows)
            one, two = words(size, 30_000 + n), words(size, 40_000 + n)
            for side in (0, 1):
                between = words(gap, 100 * n + side, 10**6)
                rows.append((n + side, " ".join(words(30, 10_000 + n + side, 10**6) + one + between + two + words(30, 20_000 + n + side, 10**6))))
            want[n + 1] = [(30, 2 * size)] if not gap else [(30, size), (30 + size + gap, size)]
            if gap and 2 * size >= 0.8 * (2 * size + gap):
                want[n + 1] = [(30, 2 * size + gap)]
    got = defaultdict(list)
    for g in S.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert g.other_id == g.id - 1
        got[g.id].append((g.at, g.n_words))
    assert {i: sorted(x) for i, x in got.items()} == want


def test_recall_of_edited_passages(spark):
    r, rows, planted = random.Random(11), [], {}
    for size, identity in itertools.product((50, 60, 100), (0.8, 0.85, 0.9, 0.95)):
        for _ in range(30):
            n = len(rows)
            base = words(size, 50_000 + n)
            edited = list(base)
            for k in r.sample(range(1, size - 1), round((1 - identity) * size)):
                edited[k] = "edit%d" % r.randrange(10**6)
            planted[n + 1] = (size, identity)
            for side, passage in ((0, base), (1, edited)):
                rows.append((n + side, " ".join(words(80, 60_000 + n + side, 10**6) + passage + words(80, 70_000 + n + side, 10**6))))
    found = Counter()
    for g in S.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        size = planted[g.id][0]
        assert g.other_id == g.id - 1 and min(g.at + g.n_words, 80 + size) - max(g.at, 80) >= 0.8 * size
        found[planted[g.id]] += 1
    assert all(found[s, i] >= {0.8: 27}.get(i, 30) for s, i in planted.values()), found


def test_passage_whose_phrases_stand_alone_elsewhere(spark):
    passage, rows = words(60, 80_000, 10**6), []
    for group in range(2):
        for at in range(0, 51, 2):  # every phrase of ten words, ahead of both documents and between them
            n = len(rows)
            rows.append((n, " ".join(words(20, 90_000 + n, 10**6) + passage[at:at + 10] + words(20, 95_000 + n, 10**6))))
        n = len(rows)
        early = passage[20:30] if group else []  # one phrase once more ahead of the passage
        rows.append((n, " ".join(words(30, 90_000 + n, 10**6) + early + words(30, 99_000 + n, 10**6) + passage + words(30, 95_000 + n, 10**6))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(g.id, g.other_id): g.n_words for g in S.passages(docs).collect()}
    assert got == {(len(rows) - 1, len(rows) // 2 - 1): 60}


def test_added_tokens_keep_their_ids():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    texts = ["a <|endoftext|> b", "<|startoftext|>a<|endoftext|>", "日<|endoftext|>本 é", "A <|ENDOFTEXT|> b", "a <|end oftext|> b", "plain"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in T.word_tokenizer(tokenizer_file("word_bpe_49k.json"))()(texts)] == want and 49407 in want[0]
    assert all(49406 in w or 49407 in w for w in want[:3])


def test_quality_scores_do_not_move_with_size(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.trusted_rows(docs, labels).select("text", "trusted")
    times = spark.range(50).crossJoin(rows).select("text", "trusted")
    assert np.abs(Q.ratios(rows) - Q.ratios(times)).max() < 1e-4
    judged = Q.quality_report(docs, labels).join(labels.select(Q.F.col("doc_id").alias("l_id"), "quality"), Q.F.col("id") == Q.F.col("l_id"))
    assert judged.filter("NOT base_failed AND kept <> (quality = 1)").count() == 0


def test_host_words_from_all_pages_without_a_limit(spark):
    letters = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in range(4))
    common = " ".join(f"q{letters(i)}" for i in range(21_000))
    rows = [(1, "https://rarewordhere.org/x", f"<title>{common} {common}</title><p>rareword</p>"), (2, "https://abc1.example.com/en/1", "<p>here <script>rarewordhere</script></p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hosts = pages.select(U.host_of(pages["url"]).alias("host"))
    got = {r.host: r.words for r in U.host_segments(hosts, U.page_words(pages)).collect()}
    assert got["rarewordhere.org"][:2] == ["rareword", "here"] and "#1" in got["abc1.example.com"]
    assert U.judged(pages).count() == 2


def test_long_host_labels_and_broken_pages(spark):
    long = "thequickbrownfox" * 6250
    rows = [(1, f"https://{long}.org/x", "<p>the quick brown fox fox</p>"), (2, "https://quickfox.net/fr/1", "<script" * 50_000), (3, "https://foxthe.net/a", "<!-- " * 50_000),
            (4, None, "<a " * 100_000), (4, None, "&a" * 100_000), (5, "https://thefox.com/" + "a" * 100_000, None),
            (6, "http://" + "".join(random.Random(1).choices("thequickfoxbrw", k=30_000)), "")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, words string")
    hosts = pages.select(U.host_of(pages["url"]).alias("host"))
    got = {r.host: r.words for r in U.host_segments(hosts, U.page_words(pages)).collect()}
    assert got[f"{long}.org"][:-1] == ["the", "quick", "brown", "fox"] * 6250 + list("or") and got["quickfox.net"][:2] == ["quick", "fox"]
    assert sorted(r.id for r in U.judged(pages).collect()) == [1, 2, 3, 4, 4, 5, 6]


def test_substrings_meet_all_words(spark):
    r = random.Random(3)
    counts = {"".join(r.choice("ab") for _ in range(r.randrange(1, 12))): r.randrange(1, 50) for _ in range(150)}
    names = ["".join(r.choice("abc") for _ in range(r.randrange(1, 40))) for _ in range(60)]
    segments = U.host_segments(spark.createDataFrame([(n,) for n in names], "host string"), spark.createDataFrame(list(counts.items()), "word string, n long"))
    whole = U.Segmenter(counts)
    cost = lambda parts: sum(whole.cost.get(p, whole.unknown if len(p) == 1 else float("inf")) for p in parts)
    for row in segments.collect():
        assert "".join(row.words) == row.host and cost(row.words) == pytest.approx(cost(whole.split(row.host)))


def test_texts_of_an_unlearned_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("lang IS NOT NULL AND length(text) > 200")
    unlearned = docs.groupBy("lang").count().orderBy("count", "lang").first()["lang"]
    learned = docs["lang"] != unlearned
    model = L.fit(docs.filter(learned & (docs["doc_id"] % 3 != 0)))
    got = L.predicted(docs.filter(~learned | (docs["doc_id"] % 3 == 0)).select("doc_id", "lang", "text"), model).collect()
    foreign, own = ([g.rejected for g in got if (g.lang == unlearned) == which] for which in (True, False))
    assert np.mean(foreign) >= 0.9 and np.mean(own) <= 0.04


def test_language_sample_without_copies(spark):
    texts = [("aa", "same text of many rows")] * 500 + [("aa", f"text {w} of one row") for w in words(30, 4)] + [("bb", "zwei Worte")] + [(None, "x"), ("aa", None)]
    rows = spark.createDataFrame(texts, "lang string, text string")
    model = L.fit(rows, fit_rows=10)
    assert model.languages == ["aa", "bb"] and list(model.owner) == [0, 0, 0, 0, 1] and model.least[-1] == 0
    again = L.fit(rows.repartition(5), fit_rows=10)
    assert np.allclose(model.centres, again.centres) and np.allclose(model.least, again.least)
