"""Each operator on odd rows, and against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenledger.llm import cuckoo, html_text, langid, merkle, minhash, mixing, pieces, resharding, toxicity, warc
from tokenledger.llm.common import word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, bucket string, size long"
EN = "the of and to in is that with for was on are by this from at be as it an"
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als"
FR = "de la le et les des en un du une que est pour qui dans par sur pas plus au"
ES = "de la que el en y los se del las un por con no una su para es al lo como"


def sentences(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words.split()) + r.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal texts, and extra columns whose names
    clash with the operators' own."""
    long = sentences(EN, 60_000, 1)
    near = sentences(EN + " " + FR, 120, 2)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n", None, "a", 3), (4, "word", "en", "b", 4), (5, "word", "en", "b", 4), (5, "word", "en", "b", 4), (6, "WORD", None, None, 4),
        (7, "12 34 !?", "de", "b", 8), (8, long, "en", "c", len(long)), (9, long + " end", "en", "c", 0), (10, near, "fr", "a", None), (11, near + " x", "fr", "a", 1), (12, near.replace(" ", "  "), "fr", "c", 1),
        (13, "a\nb\n\nc", "es", "c", 6), (14, "é😀ßﬁ x", "de", "b", 7), (None, "no id", "en", "a", 5), (15, "a b c d e", "en", "a", 9), (16, "a b c d f", "en", "a", 9),
    ]
    return spark.createDataFrame([(*r, 7, "z", 9) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_word_hashes_tell_words_apart():
    data = b"the cat the  dog\tcat"
    h = word_hashes(data)
    assert len(h) == 5 and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0
    assert set(word_hashes(b"catalogue", stems=(3,)).tolist()) & set(word_hashes(b"category", stems=(3,)).tolist())


def test_revisits(spark):
    base = [
        (1, "response", "http://www.A.example/x?b=1&a=2#f", 10, {"etag": '"1"', "content-length": "5", "age": "1", "x": "old"}, "p1"),
        (2, "response", "https://a.example/x?a=2&b=1", 20, {"last-modified": "d2"}, "p2"),
        (3, "revisit", "a.example/x?a=2&b=1", 15, {"etag": 'W/"1"', "content-length": "0", "x": "new", "y": "1"}, None),
        (4, "revisit", "a.example/x?b=1&a=2", 20, {"etag": '"2"'}, None),  # a response in its own second isn't earlier
        (5, "revisit", "a.example:443/x?a=2&b=1", 5000, {"last-modified": "d2"}, None),
        (6, "revisit", "a.example/x?a=2&b=1", 5, None, None),
        (7, "revisit", None, 50, None, None),
        (8, "revisit", "a.example/x?a=2&b=1", 5001, None, None),
    ]
    df = spark.createDataFrame(base, "record_id long, kind string, url string, at long, headers map<string,string>, payload string").withColumn("bucket", F.lit("clash"))
    got = {r.revisit_id: (r.response_id, r.state, r.headers, r.payload) for r in warc.resolve_revisits(df).collect()}
    assert got[3] == (1, "resolved", {"etag": 'W/"1"', "content-length": "5", "age": "1", "x": "new", "y": "1"}, "p1")
    assert got[4][:2] == (1, "mismatch") and got[4][2] is None
    assert got[5] == (2, "resolved", {"last-modified": "d2"}, "p2")
    assert got[6][:2] == got[7][:2] == (None, "missing")
    assert got[8][:2] == (2, "unvalidated")
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_as_of_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["response", "revisit"]), r.choice([1, 1, 1, 2, 3]), r.randrange(40)) for i in range(400)]
    captures = spark.createDataFrame(rows, "record_id long, kind string, url_key long, at long").withColumn("answer", F.struct("at", "record_id"))
    got = {x.record_id: x.found.record_id if x.found else None for x in warc.latest_earlier(captures, 7).collect()}
    want = {i: max(((t, j) for j, k2, u2, t in rows if k2 == "response" and u2 == u and t < at), default=(0, None))[1] for i, k, u, at in rows if k == "revisit"}
    assert got == want


def test_revisits_that_repeat_an_id_or_have_none(spark):
    """Random captures of few urls, with record_ids null or repeated on either side, against a loop over them."""
    r = random.Random(8)
    rows = []
    for _ in range(300):
        kind = r.choice(["response", "revisit", "revisit"])
        headers = {k: r.choice("ab") for k in ("etag", "last-modified") if r.random() < 0.6} or None
        rows.append((r.choice([None, 1, 2, 3, 4]), kind, r.choice(["h.example/x", "h.example/y"]), r.randrange(60), headers, f"body {len(rows)}" if kind == "response" else None))
    rows = [x for i, x in enumerate(rows) if x[1] == "revisit" or not any((y[:4], y[4] or {}) == (x[:4], x[4] or {}) for y in rows[:i])]
    schema = "record_id long, kind string, url string, at long, headers map<string,string>, payload string"
    got = sorted((tuple(x) for x in warc.resolve_revisits(spark.createDataFrame(rows, schema).repartition(5), 10).collect()), key=repr)

    def mark(headers):
        return hashlib.md5(("{" + ",".join(f'"{k}":"{v}"' for k, v in sorted((headers or {}).items())) + "}").encode()).hexdigest()

    want = []
    for d, kind, url, at, headers, _ in rows:
        if kind == "response":
            continue
        before = [(t, i is not None, i or 0, mark(h), i, h or {}, body) for i, k, u, t, h, body in rows if k == "response" and u == url and t < at]
        if not before:
            want.append((d, None, "missing", None, None))
            continue
        *_, i, old, body = max(before, key=lambda x: x[:4])
        new = headers or {}
        state = next(("resolved" if old[k] == new[k] else "mismatch" for k in ("etag", "last-modified") if k in old and k in new), "unvalidated")
        want.append((d, i, state, old | new, body) if state == "resolved" else (d, i, state, None, None))
    plain = lambda found: sorted(((*x[:3], sorted(x[3].items()) if x[3] else None, x[4]) for x in found), key=repr)
    assert plain(got) == plain(want) and {x[2] for x in got} == {"missing", "resolved", "mismatch", "unvalidated"}


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_main_text(spark):
    note = '<section><p>Join our club of readers now</p></section>'
    rows = [(i, f"http://h.example/{i}", page(f"{note}<div class='story'><p>Story {i} &amp; more\n text</p><p>Shared line</p></div><footer>f</footer>")) for i in range(8)]
    rows += [(20, "http://other.example/", page("<nav>menu</nav><article><h1>Head</h1><p>One<b>two</b><p>Three<br>four &lt;5<script>x='</p>'</script><div class='ad'>buy</div><section id=comments><p>hi</p></section></article><aside>s</aside>"))]
    rows += [(21, None, None), (22, "", ""), (23, "http://x.example", "<p>open <i>tags <p>and &unknown; &am"), (20, "http://other.example/", "plain text only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", F.lit(1)).withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()]
    by = dict((a, b) for a, b, _ in got if a != 20)
    assert all(n == len(t) for _, t, n in got)
    assert "Join our club" not in by[3] and by[3].startswith("Story 3 & more text")
    assert sorted(t for a, t, _ in got if a == 20) == ["Head\nOnetwo\nThree four <5", "plain text only"]
    assert by[21] == by[22] == "" and by[23] == "open tags\nand &unknown; &am"
    assert html_text.extract(df.limit(0)).count() == 0


def test_a_block_on_many_pages_goes_however_large_the_host(spark):
    """On 60 of 900 pages of one host; by the list of the host and by each page's own subtrees."""
    note = "<div><p>Notice of one section</p></div>"
    rows = [(i, f"http://h.example/{i}", page(f"{note if i < 60 else ''}{'<div><p>Twenty</p></div>' if i < 20 else ''}<div><p>Story {i}</p></div>")) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (2000, 0):
        got = {r.page_id: r.text for r in html_text.extract(df, most=most).collect()}
        assert len(got) == 900 and all(t == (f"Twenty\nStory {i}" if i < 20 else f"Story {i}") for i, t in got.items())


def test_long_unclosed_markup_is_read_in_linear_time():
    html_text.main_text(html_text.parse("<a b='" * 20_000))
    html_text.main_text(html_text.parse("<div><b>" * 20_000))


def test_flow_is_least():
    r = random.Random(5)
    for _ in range(20):
        supply = [r.randrange(4) for _ in range(3)]
        capacity = [r.randrange(1, 5) for _ in range(3)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = [[r.randrange(4) for _ in range(3)] for _ in range(3)]
        flow = resharding.least_cost_flow(supply, capacity, cost)
        assert [sum(x) for x in flow] == supply and all(sum(c) <= k for c, k in zip(zip(*flow), capacity))
        units = [i for i, n in enumerate(supply) for _ in range(n)]
        best = min(sum(cost[i][j] for i, j in zip(units, to)) for to in itertools.product(range(3), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(3))) if units else 0
        assert sum(f * c for fs, cs in zip(flow, cost) for f, c in zip(fs, cs)) == best
    with pytest.raises(ValueError):
        resharding.least_cost_flow([3], [2], [[0]])


def test_reshard(spark, odd, empty, tmp_path):
    placed, _ = resharding.reshard(odd, resharding.old_shard_by_source(8), 8, 8)
    rows = placed.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r.shard < 8
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in rows}
    for d, t in texts_of(odd):
        assert sizes[d] == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert resharding.reshard(empty, resharding.old_shard_by_source(8), 8, 8)[0].count() == 0
    docs = spark.createDataFrame([(i, "x" * (i % 50), "s%d" % (i % 3)) for i in range(600)], "doc_id long, text string, source string")
    placed, flow = resharding.reshard(docs, resharding.old_shard_by_source(4), 4, 5)
    total = [r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(total) - min(total) <= 60
    moved = placed.where("shard <> old_shard").agg(F.sum("size")).first()[0]
    assert abs(moved - sum(f for i, x in enumerate(flow) for j, f in enumerate(x) if i != j)) <= 200
    shards = resharding.rewrite(docs, placed, flow, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == placed.where(F.col("shard").isin(shards)).count()


def test_equal_texts_stay_together(spark):
    """Groups over several old shards; one of a quarter of all bytes is dealt out, as no shard could hold it."""
    r = random.Random(2)
    rows = [(i, f"text {i % 300} " + "x" * (i % 300 % 40), f"s{r.randrange(6)}") for i in range(1200)] + [(5000 + i, "hot " * 5, f"s{r.randrange(6)}") for i in range(700)] + [(None, "no id", "s1"), (None, "no id", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, _ = resharding.reshard(docs, resharding.old_shard_by_source(4), 4, 5, spread=100)
    found = placed.collect()
    text = {d: t for d, t, _ in rows}
    shards = {}
    for x in found:
        shards.setdefault(text[x.doc_id], set()).add(x.shard)
    assert len(found) == len(rows) and all(len(s) == 1 for t, s in shards.items() if t != "hot " * 5) and len(shards["hot " * 5]) > 1
    total = [x.b for x in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(total) - min(total) <= 0.05 * sum(total)
    for s in range(5):
        assert sorted(x.slot for x in found if x.shard == s) == list(range(sum(x.shard == s for x in found)))


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = sentences(EN + " é ß", 400, 3)
    whole = langid.ngram_counts(text)
    for chunk in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "_CHUNK", chunk)
        assert (langid.ngram_counts(text) == whole).all()


def test_pairwise_margin_is_the_sum_over_pairs():
    r = np.random.default_rng(3)
    terms = np.sort(r.choice(1 << toxicity.BITS, 40, replace=False)).astype(np.int32)
    model = toxicity.FactorizationMachine(terms, -0.3, r.normal(0, 0.5, 40), r.normal(0, 0.5, (40, toxicity.FACTORS)))
    for _ in range(20):
        row = np.sort(np.concatenate([r.choice(terms, r.integers(0, 12), replace=False), np.setdiff1d(r.integers(0, 1 << toxicity.BITS, 5), terms)]).astype(np.int32))
        on = [i for i, t in enumerate(terms) if t in row]
        margin = model.bias + sum(model.weights[i] for i in on) + sum(float(model.factors[i] @ model.factors[j]) for i, j in itertools.combinations(on, 2))
        assert model.score(row) == pytest.approx(1 / (1 + np.exp(-margin)))
        x = np.array([[float(i in on) for i in range(40)]])
        assert model._margin(x, x @ model.factors)[0] == pytest.approx(margin)


def test_mix(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    sizes = {d: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]) for d, t in texts_of(odd)}
    assert all(r.size == sizes[r.doc_id] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(odd.repartition(3)).collect()), key=repr)
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert sum(t for _, t in by.values()) == pytest.approx(sum(r.size for r in rows))
    assert all(abs(k - t) <= max(1, 0.01 * t) for k, t in by.values())
    assert mixing.mix(empty).count() == 0


def test_small_sources_beside_a_hot_one_have_their_seats(spark):
    rows = [(0, "a " * 700_000, "hot")] + [(k, "a b c", f"tiny{k:02}") for k in range(1, 31)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.taken for r in got if r.source != "hot"} == {9} and {r.target for r in got if r.source != "hot"} == {9.0}
    assert sum(r.taken for r in got) == 700_090
    got = {r.source: (r.target, r.taken) for r in mixing.mix(spark.createDataFrame([(0, "a " * 800_000, "hot"), (1, "a b c", "three"), (2, "a b", "two")], "doc_id long, text string, source string")).collect()}
    assert got["three"] == (9.0, 9) and got["two"] == (6.0, 6) and abs(got["hot"][0] - got["hot"][1]) <= 1
    goal, quotas, seats = mixing.plan([5 * 10**9] + [5_000] * 40, [5, 2, 1] * 13 + [5, 2])
    quota = [sum(q[k] for q in quotas) for k in range(41)]
    assert sum(quota) == 8 * seats and all(sum(q) == seats for q in quotas)
    assert all(abs(n * sum(goal) / sum(quota) - t) <= 0.01 * t for n, t in zip(quota, goal, strict=True))


def test_seats_are_those_given_one_by_one():
    r = random.Random(3)
    for n in (1, 2, 7, 40):
        shares = [r.choice([0.0, 1.0, 2.0, 5.0, r.random() * 100]) for _ in range(n)] + [1.0]
        for seats in (1, 5, 100, 3000):
            order = mixing.apportion(shares, seats)
            assert mixing.seats_of(shares, seats) == [order.count(k) for k in range(n + 1)]


def test_apportionment_is_sainte_lague():
    order = mixing.apportion([53.0, 24.0, 23.0], 7)
    assert [order.count(k) for k in range(3)] == [3, 2, 2]
    goal = mixing.targets([100, 10, 1], [1, 1, 1])
    assert [float(x) for x in goal] == [78.0, 30.0, 3.0]


def plain_grams(text, features):
    """Counts of hashed 1- to 3-grams, one gram at a time."""
    low = (1 << 64) - 1

    def spread(x, k):
        x = (x + 0x632BE59BD9B4E019 * (k + 1)) & low
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & low
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & low
        return x ^ (x >> 31)

    signs = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
    counts = [0] * features
    for k in (1, 2, 3):
        for i in range(len(signs) - k + 1):
            gram = signs[i : i + k]
            if gram[1] if k == 3 else any(gram):  # of three signs the middle one is a letter
                code = 0
                for c in gram:
                    code = (code * 0x110000 + c) & low
                counts[(spread(code, k) >> 40) % features] += 1
    return counts


def test_families_and_votes_one_by_one():
    """Predictions against plain loops over grams, families, pairs of languages and votes."""
    import math

    r = random.Random(3)
    langs = ["de", "en", "nl", "es", "fr", "pt", "fi", "xx"]
    words = {k: ["".join(r.choices("abcdefghijklmnoprstuväöé", k=r.randrange(2, 9))) for _ in range(60)] for k in langs}
    shared = ["".join(r.choices("aeinrst", k=4)) for _ in range(60)]
    text = lambda k: " ".join(r.choices(words[k] + shared, k=r.randrange(3, 25)))
    learn = [(k, text(k)) for k in langs for _ in range(25)]
    model = langid.LanguageModel(langid.scaled(np.array([langid.ngram_counts(t) for _, t in learn])), [k for k, _ in learn])
    asked = [text(r.choice(langs)) for _ in range(60)] + ["a", "é9é", "x " * 50]
    names, scores = langid._predict(model, asked)
    for t, name, score in zip(asked, names, scores, strict=True):
        counts = plain_grams(t, langid.FEATURES)
        assert counts == langid.ngram_counts(t).tolist()
        norm = math.sqrt(sum(counts))
        x = [(i, math.sqrt(c) / norm) for i, c in enumerate(counts) if c]
        margin = lambda w: sum(v * float(w[i]) for i, v in x) + float(w[-1])  # noqa: B023, E731
        families = [margin(w) for w in model.family]
        family = model.families[families.index(max(families))]
        near = [k for k in langs if langid.family_of(k) == family]
        votes, sums, own = dict.fromkeys(near, 0), dict.fromkeys(near, 0.0), {}
        for a in near:
            for b in near:
                if a < b:
                    m = margin(model.pairs[a, b])
                    own[a, b], own[b, a] = m, -m
                    votes[a if m > 0 else b] += 1
                    sums[a] += m
                    sums[b] -= m
        best = max(near, key=lambda k: (votes[k], sums[k]))  # noqa: B023
        sure = lambda m: 1 / (1 + math.exp(-4 * m))
        assert name == best and score == pytest.approx(sure(max(families)) * min((sure(own[best, k]) for k in near if k != best), default=1.0), rel=1e-3)
    assert langid._predict(model, [None, "", "12 !"])[0] == ["und"] * 3


def test_language(spark, odd, empty):
    rows = [(i, sentences(w, 60, i), k) for i in range(160) for k, w in [[("en", EN), ("de", DE), ("fr", FR), ("es", ES)][i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = langid.identify(docs, model).join(docs, "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    found = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd, model).collect()]
    assert len(found) == odd.count() and all(0 <= s <= 1 for _, _, s in found)
    assert {d for d, k, _ in found if k == "und"} == {1, 2, 3, 7}
    assert langid.fit(empty) is None and langid.identify(odd, None).select("lang_pred").distinct().count() == 1
    assert langid.identify(empty, model).count() == 0
    changed = langid.fit(docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))))
    assert "xx" not in changed.langs


@pytest.fixture(scope="module")
def model_path():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(spark, odd, empty, model_path):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model_path)
    extra = ["  lead", "▁x ▁", "a" * 300, "\x00", "日本語 テスト", "<s> <0x41>", "\t\t x "]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, x) for i, x in enumerate(extra)], "doc_id long, text string"))
    encoded = pieces.encode(docs, model_path)
    got = [(r.doc_id, list(r.ids), list(r.starts), list(r.ends)) for r in encoded.collect()]
    back = [(r.doc_id, r.text) for r in pieces.decode(encoded, model_path).collect()]
    want = {d: t or "" for d, t in texts_of(docs)}
    assert len(got) == docs.count()
    for d, ids, starts, ends in got:
        assert ids == lib.encode(want[d])
        raw = want[d].encode()
        assert starts == sorted(starts) and all(a <= b for a, b in zip(starts, ends)) and (not ids or ends[-1] == len(raw))
        assert b"".join(raw[a:b] for a, b in zip(starts, ends)) == raw
    for d, text in back:
        assert text == lib.decode(lib.encode(want[d]))
    short = pieces.decode(pieces.encode(docs, model_path, digests=True), model_path, ("covered_bytes", "spans_sha256")).collect()
    spans = {d: (list(zip(starts, ends)), len(want[d].encode())) for d, _, starts, ends in got}
    assert len(short) == len(got) and {r.doc_id: r.text for r in short} == dict(back)
    for r in short:
        own, size = spans[r.doc_id]
        assert r.covered_bytes == (size if r.ids else 0) and r.spans_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for ab in own for x in ab)).hexdigest()
    assert pieces.encode(empty, model_path).count() == 0


def double_array(keys):
    """A character map's blob for single-byte keys, built by hand."""
    units = [0] * 1024
    values, places = b"", {}
    for k, v in keys.items():
        places[k] = len(values)
        values += v + b"\0"
    units[0] = 1 << 10  # children of the root at 1 ^ byte
    for n, k in enumerate(keys):
        node = 1 ^ k[0]
        leaf = 512 + n
        units[node] = k[0] | 1 << 8 | (node ^ leaf) << 10
        units[leaf] = 0x80000000 | places[k]
    blob = b"".join(u.to_bytes(4, "little") for u in units)
    return len(blob).to_bytes(4, "little") + blob + values


def test_character_map_records_alignment(model_path):
    with open(model_path, "rb") as f:
        model = pieces.PieceModel(f.read())
    model.map = pieces.CharacterMap(double_array({b"x": b"yz", b"q": b""}))
    text, source = model.normalise("axqb")
    assert text == "▁ayzb" and source.tolist() == [0, 0, 0, 0, 1, 1, 3, 4]
    ids, starts, ends = model.encode("axqb")
    assert starts.min() == 0 and ends.max() == 4
    model.squeeze = True
    assert model.normalise("  a  b ")[0] == "▁a▁b"


def plain_likeness(a, b):
    """The share of text in common, over nested tuples instead of hashes: sections, then paragraphs, then sentences."""
    import re

    def parts(text):
        sections, run = [], []
        for p in text.split("\n"):
            leaves = tuple(x[i : i + 400] for x in re.findall(r"[^.!?]*[.!?]+\s*|[^.!?]+", p) for i in range(0, len(x), 400)) or ("",)
            size = (sum(map(len, leaves)) + 1).to_bytes(8, "little")
            own = b"".join(hashlib.blake2b(x.encode(), digest_size=8, person=b"leaf").digest() for x in leaves)
            run.append(leaves)
            if hashlib.blake2b(size + own, digest_size=8, person=b"paragraph").digest()[0] % 4 == 0:
                sections.append(tuple(run))
                run = []
        return sections + ([tuple(run)] if run else [])

    def signs(x):
        return len(x) if isinstance(x, str) else sum(map(signs, x)) + (1 if x and isinstance(x[0], str) else 0)

    if a == b:
        return 1.0
    left, right, common = parts(a), parts(b), 0
    for _ in range(3):
        rest, kept = list(right), []
        for x in left:
            if x in rest:
                rest.remove(x)
                common += signs(x)
            else:
                kept.append(x)
        if kept and isinstance(kept[0], str):
            break
        left, right = [c for x in kept for c in x], [c for x in rest for c in x]
    return common / max(len(a) + 1, len(b) + 1)


def test_texts_whose_short_checksums_agree_have_different_roots():
    """Two sentences with one CRC-32."""
    one, two = "bxnlbkuqbjuhtrrceldh.", "cpjhclogasbejxmokhon."
    assert zlib.crc32(one.encode()) == zlib.crc32(two.encode())
    a, b = (merkle.tree(f"First. {x}\nLast.") for x in (one, two))
    assert a.hash != b.hash and merkle.likeness(a, b) < 0.9 and merkle.edits(a, b) == [(7, 28)]


def test_the_root_follows_from_every_leaf():
    text = "\n".join(f"Line {i}. And more." for i in range(40))
    root = merkle.tree(text)
    assert merkle.read(merkle.shown(root)).hash == root.hash
    assert len({merkle.tree(text[:i] + "#" + text[i + 1 :]).hash for i in range(len(text)) if text[i] != "#"}) == len(text)
    digest, _, rest = merkle.shown(root).partition(":")
    with pytest.raises(ValueError):
        merkle.read("0" * 32 + ":" + rest)
    assert merkle.edits(merkle.tree("a.b."), merkle.tree("a.")) != [] and merkle.edits(merkle.tree("a."), merkle.tree("b.a.")) == []


def test_the_plan_does_not_grow_with_the_blocks(spark):
    docs = spark.createDataFrame([(2**60 + i, f"Text {i}.") for i in range(400)] + [(None, "x")], "doc_id long, text string")
    plans = [len(merkle.compare_with_next(docs, per_block=k)._jdf.queryExecution().optimizedPlan().toString()) for k in (200, 2)]
    assert abs(plans[0] - plans[1]) < 100
    keys = docs.select("doc_id", F.xxhash64("text").alias("digest"))
    cuts = merkle.ranges(keys, 40)
    marked = keys.withColumn("b", merkle.block_of(spark, cuts)).withColumn("block", F.expr("if(b < 0, -b - 1, b)"))
    order = sorted(marked.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.digest), reverse=True)
    assert [r.block for r in order] == sorted(r.block for r in order) and order[-1].doc_id is None
    assert [r.b < 0 for r in order] == [k == 0 or order[k - 1].block != r.block for k, r in enumerate(order)] and len({r.block for r in order}) == len(cuts[0]) > 20


def test_places_that_many_rows_share(spark):
    """Null and repeated ids, with equal texts and others: every row is returned, and the order is whole."""
    texts = [(None, f"Text {i % 40}.") for i in range(120)] + [(7, f"Seven {i}.") for i in range(50)] + [(i, f"Own {i}.") for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = merkle.compare_with_next(docs, per_block=9).collect()
    assert len(rows) == len(texts)
    order = sorted({(d, h) for d, h in ((r.doc_id, r.h) for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect())}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    text = {(r.doc_id, r.h): r.text for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    want = {}
    for k, nxt in zip(order, order[1:] + order[:1]):
        t, n = text[k], text[nxt]
        half = len(t) // 2
        want[k[0], t] = hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.edited_sha256), 0)
        got[r.doc_id, r.edited_sha256] += 1
    from collections import Counter

    assert got == Counter((d, want[d, t]) for d, t in texts)


def test_fingerprints(spark, odd, empty):
    docs = odd.where("doc_id is null or doc_id <> 5").unionByName(odd.where("doc_id = 5").limit(1))
    rows = {r.doc_id: r for r in merkle.compare_with_next(docs, per_block=3).collect()}
    order = sorted(((d, t or "") for d, t in texts_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    assert len(rows) == len(order)
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = rows[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = merkle.tree(t), merkle.tree(edited), merkle.tree(nxt)
        assert r.near_edited == pytest.approx(plain_likeness(t, edited), abs=1e-6) and r.near_next == pytest.approx(plain_likeness(t, nxt), abs=1e-6)
        assert (r.near_edited == 1) == (t == edited) == (r.fingerprint == r.edited_fingerprint) and (r.near_next == 1) == (t == nxt)
        spans = [tuple(map(int, x.split("-"))) for x in r.edited_at.split(",") if x]
        assert all(0 <= x < y <= len(t) + 1 for x, y in spans) and (t != edited or not spans)
        assert (r.fingerprint, r.edited_fingerprint) == (merkle.shown(a), merkle.shown(b))
        assert r.near_edited == merkle.likeness(merkle.read(r.fingerprint), merkle.read(r.edited_fingerprint)) == merkle.likeness(a, b)
        assert r.near_next == merkle.likeness(a, c) and 0 <= r.near_next <= 1
    assert merkle.compare_with_next(odd).where("doc_id = 5").count() == 2
    one = merkle.compare_with_next(odd.where("doc_id = 8")).first()
    assert one.near_next == 1
    assert merkle.compare_with_next(empty).count() == 0 and merkle.fingerprints(odd).count() == odd.count()


def test_edits_are_located():
    old = "\n".join(f"Paragraph {i} has a line. And another." for i in range(30))
    new = old.replace("Paragraph 17 has", "Paragraph 17 had")
    spans = merkle.edits(merkle.tree(old), merkle.tree(new))
    assert len(spans) == 1 and spans[0][0] <= old.index("Paragraph 17 has") < spans[0][1] <= old.index("Paragraph 17 has") + 30
    assert 0.9 < merkle.likeness(merkle.tree(old), merkle.tree(new)) < 1 and merkle.edits(merkle.tree(old), merkle.tree(old)) == []


def test_exact_duplicates(spark, odd, empty):
    import re

    rows = cuckoo.exact_duplicates(odd).collect()
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in texts_of(odd)]
    assert len(rows) == len(norm)
    for r in rows:
        text = next(t for d, t in norm if d == r.doc_id)
        same = [d for d, t in norm if t == text]
        keep = min((d for d in same if d is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), r.doc_id == keep) and r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert cuckoo.exact_duplicates(empty).count() == 0


def test_cuckoo_filter():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    live = cuckoo.DigestFilter()
    assert sum(live.insert(d) for d in digests) < 50 and live.resized > 0
    assert all(d in live.filter for d in digests) and all(live.insert(d) for d in digests)
    other = [hashlib.sha256(b"x%d" % i).digest() for i in range(5000)]
    assert sum(d in live.filter for d in other) < 50
    full, _ = cuckoo._built(digests)
    assert all(full.delete(d) for d in digests[:4000]) and all(d in full for d in digests[4000:])
    assert sum(d in full for d in digests[:4000]) < 50


def test_index_against_a_plain_one(spark):
    """Inserted, deleted and looked up in turns, with copies, a null id, what isn't live, full filters and more buckets."""
    from collections import Counter

    r = random.Random(12)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    norm = lambda t: " ".join((t or "").split(" "))
    live: Counter = Counter()
    index = cuckoo.empty_index(spark, bits=1)
    sizes = set()
    for turn in range(4):
        new = [(r.choice([None, *range(40)]), r.choice([None, "", *(f"text {k}" for k in range(1200 if turn == 1 else 25))])) for _ in range(1500 if turn == 1 else 40)]
        index = cuckoo.insert(index, docs(new), per_bucket=500 if turn < 2 else 100)
        live.update((d, norm(t)) for d, t in new)
        gone = r.sample(sorted(live.elements(), key=repr), 20) + [(99, "never there"), (5, "text 1")]
        for x in gone:
            live[x] = max(0, live[x] - 1)
        index = cuckoo.delete(index, docs(gone), per_bucket=500 if turn < 2 else 100)
        groups: dict = {}
        for (d, t), n in live.items():
            if n:
                groups.setdefault(t, []).append((d, n))
        want = {hashlib.sha256(t.encode()).hexdigest(): (min((d for d, _ in x if d is not None), default=None), sum(n for _, n in x)) for t, x in groups.items()}
        assert {x.text_sha256: (x.keep_id, x.group_size) for x in index.live().collect()} == want
        assert {x.text_sha256 for x in index.content.collect()} == set(want)
        asked = [(1000 + k, f"text {k}") for k in range(0, 1300, 7)] + [(7, None), (8, "other")]
        found = {(x.doc_id, x.text_sha256): (x.keep_id, x.live) for x in cuckoo.lookup(index, docs(asked)).collect()}
        for d, t in asked:
            sha = hashlib.sha256(norm(t).encode()).hexdigest()
            assert found[d, sha] == (want.get(sha, (None,))[0], sha in want)
        sizes.update(len(x["filter"]) for x in index.filters.collect())
    assert len(sizes) > 1 and index.bits > 1, (sizes, index.bits)


def test_the_index_reads_and_writes_touched_buckets_only(spark, tmp_path):
    import pathlib

    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    files = lambda name: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in pathlib.Path(tmp_path).rglob("*.parquet") if f"/{name}/" in str(p)}
    folders = lambda some: {f.split("bucket=")[1].split("/")[0] for f in some}
    own = lambda t: str(int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) >> 26)
    index = cuckoo.insert(cuckoo.empty_index(spark, path=str(tmp_path)), docs([(k, f"text {k}") for k in range(2000)]))
    content, filters = files("content"), files("filters")
    index = cuckoo.insert(index, docs([(5000, "one more"), (5001, "text 7")]))
    assert folders(files("content").keys() - content.keys()) == {own("one more")} and content.items() <= files("content").items()
    assert folders(files("filters").keys() ^ filters.keys()) == {own("one more")}
    content = files("content")
    index = cuckoo.delete(index, docs([(5000, "one more"), (7, "text 7"), (4, "not live")]))
    assert folders(files("content").keys() ^ content.keys()) == {own("one more")}
    found = cuckoo.lookup(index, docs([(1, "no hit at all"), (2, "text 7"), (3, "one more")]))
    assert {r.doc_id: (r.keep_id, r.live) for r in found.collect()} == {1: (None, False), 2: (5001, True), 3: (None, False)}
    none = cuckoo.lookup(index, docs([(1, "no hit at all")]))
    assert "bucket=" not in none._jdf.queryExecution().executedPlan().toString() and not any("content" in f for f in none.inputFiles())
    assert "PartitionFilters" in cuckoo.lookup(index, docs([(2, "text 7")]))._jdf.queryExecution().executedPlan().toString()


def test_the_index_shuffles_a_text_once(spark, tmp_path):
    """When it is inserted, and neither when others of its bucket are deleted nor when it is looked up; copies in a task are one."""
    import time

    def shuffled():
        time.sleep(1)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    text = lambda k: random.Random(k).randbytes(20000).hex()
    docs = spark.createDataFrame([(k, text(k if k < 200 else 0)) for k in range(400)], "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = shuffled()
    index = cuckoo.insert(cuckoo.empty_index(spark, path=f"{tmp_path}/index"), docs)
    put = shuffled()
    index = cuckoo.delete(index, docs.where("doc_id % 3 = 1"))
    found = cuckoo.lookup(index, docs.where("doc_id < 200")).collect()
    assert [(r.doc_id, r.live) for r in sorted(found)] == [(k, k % 3 != 1) for k in range(200)]
    stored = 200 * 40000
    assert put - before < 1.2 * stored and shuffled() - put < 0.1 * stored


def test_a_lookup_shuffles_no_text_where_nothing_is_broadcast(spark, tmp_path, monkeypatch):
    """As when an index has too many digests for that."""
    plans, write = [], cuckoo.written
    monkeypatch.setattr(cuckoo, "written", lambda df, name, **more: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), write(df, name, **more))[1])
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    index = cuckoo.insert(cuckoo.empty_index(spark, path=str(tmp_path)), docs)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert all(r.live for r in cuckoo.lookup(index, docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    plan = dict(plans)["answers"]
    lines = plan.split("\n")
    made = next(k for k, line in enumerate(lines) if "sha2(" in line)
    met = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line and "bucket" in line)
    assert met < made and any("Exchange" in line for line in lines[met:made])  # the plan's top is its last step


def test_white_space_that_is_one_space_stays(spark):
    texts = ["a  b", " a\tb ", "\n", "  ", "a \t\x0b b", "\t a", "a\u00a0 b", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text_sha256 for r in cuckoo._keyed(df).collect()} == {r.doc_id: r.text_sha256 for r in cuckoo.exact_duplicates(df).collect()}


def test_many_equal_rows_are_numbered_in_parts(spark):
    """Half of all texts empty: they stay together, and no task numbers them all."""
    rows = [(i, "" if i % 2 else f"text {i}", "s") for i in range(6000)] + [(None, "", "s")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    placed, _ = resharding.reshard(df, resharding.old_shard_by_source(8), 8, 8, part=100)
    found = placed.collect()
    assert len(found) == 6500 and len({r.shard for r in found if r.size == 1}) <= 8
    for shard in range(8):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    counts = {(h, b): n for h, b, n in [(0, 0, 3500), (0, 1, 1), (1, 0, 150)]}
    flat = spark.createDataFrame([(h, b, 10 * h, i, i, 1, 1) for (h, b), n in counts.items() for i in range(n)], "home int, block int, first_slot long, doc_id long, spread long, size int, text_crc32 int")
    done = resharding.numbered(flat, counts, 100)
    parts = done.groupBy("home", "block", "part").count().agg(F.max("count")).first()[0]
    assert parts < 200 and sorted(r.slot for r in done.where("home = 0 and block = 0").collect()) == list(range(3500))


def brute_components(texts, words, percent):
    ids = sorted({d for d, _ in texts if d is not None})
    sets = {d: set() for d in ids}
    for d, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        if d is not None and w:
            sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}
    comp = {d: d for d in ids}
    for a, b in itertools.combinations(ids, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            lo, hi = sorted((comp[a], comp[b]))
            comp = {d: lo if c == hi else c for d, c in comp.items()}
    return comp, {d: len(s) for d, s in sets.items()}


def test_near_duplicates(spark, odd, empty):
    r = random.Random(9)
    base = [[r.choice((EN + " " + DE + " " + FR).split()) for _ in range(n)] for n in (5, 8, 30, 80, 300)]
    rows = []
    for k, words in enumerate(base * 6):
        w = list(words)
        for _ in range(r.randrange(0, max(1, len(w) // 12) + 1)):
            w[r.randrange(len(w))] = r.choice(ES.split())
        rows.append((1000 + k, " ".join(w)))
    # pairs at 79, 80 and 81 % of two-word shingles, with the rest on one side or both
    for k, (common, more, other) in enumerate([(79, 21, 0), (79, 10, 11), (80, 20, 0), (80, 10, 10), (81, 19, 0), (81, 9, 10)]):
        stem = [f"p{k}w{i}" for i in range(common + 1)]
        rows += [(2000 + 2 * k, " ".join(stem + [f"p{k}a{i}" for i in range(more)])), (2001 + 2 * k, " ".join(stem + [f"p{k}b{i}" for i in range(other)]))]
    # a chain whose neighbours are linked and whose ends have nothing in common, in an order that isn't the chain's
    long = [f"chain{i}" for i in range(260)]
    rows += [(2100 + i * 7 % 16, " ".join(long[10 * i : 10 * i + 101])) for i in range(16)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("component", F.lit(3))
    for words in (2, 5):
        got = minhash.near_duplicates(docs, words, 80).collect()
        comp, n = brute_components(texts_of(docs), words, 80)
        assert len(got) == docs.count()
        if words == 2:
            assert [comp[2001 + 2 * k] == 2000 + 2 * k for k in range(6)] == [False, False, True, True, True, True] and all(comp[2100 + k] == 2100 for k in range(16))
        assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got if r.doc_id is not None} == {d: (c, n[d], c == d) for d, c in comp.items()}
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(empty, 2).count() == 0
    assert minhash.near_duplicates(odd.where("doc_id in (1, 2)"), 2).where("kept").count() == 2


def test_no_pair_of_a_large_bucket_is_left_out(spark):
    """Documents of one template, all too different but one pair, at neither end of the only bucket."""
    r = random.Random(6)
    template = [f"w{k}" for k in range(400)]

    def changed(words, own, places):
        return [f"{own}x{k}" if k in places else w for k, w in enumerate(words)]

    made = {d: changed(template, f"d{d}", set(r.sample(range(0, 400, 6), 7))) for d in range(300)}
    made[171] = changed(made[87], "d171", {399, 398})
    texts = [(d, " ".join(x)) for d, x in made.items()]
    comp, _ = brute_components(texts, 5, 80)
    assert sum(comp[d] != d for d in made) == 1 and comp[171] == 87
    bucket = {d: int(minhash.shingle_set(t, 5)[0]) for d, t in texts}
    assert bucket[87] == bucket[171] and sum(x == bucket[87] for x in bucket.values()) > 100
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80, bands=1, rows=1).collect()}
    assert got == comp


def test_blocks_are_compared_whole(spark):
    """Small blocks, pure and mixed: the links join what brute force joins."""
    texts = [(d, f"{'same words go on and on for a while ' * 3} end {' '.join(f't{d % 7}k{k}' for k in range(20))} {d}") for d in range(60)]
    rows = spark.createDataFrame([(1, d, 0 if d in (0, 7, 14, 21) else d) for d, _ in texts], "bucket long, id long, component long")
    found = minhash.across(rows, spark.createDataFrame(texts, "doc_id long, text string"), 5, 80, most=3)
    edges = [(r.a, r.b) for r in found.collect()] + [(0, 7), (0, 14), (0, 21)]
    group = {d: d for d, _ in texts}
    for _ in texts:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert group == brute_components(texts, 5, 80)[0]


def test_densified_bins_agree_like_the_sets():
    rng, order = np.random.default_rng(1), minhash.probe_order(200)
    for n in (20, 1000):
        hits = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            y = x.copy()
            y[: n // 9] = rng.integers(0, 1 << 63, n // 9, np.uint64) * np.uint64(2) + np.uint64(1)
            hits.append((minhash.one_permutation(np.unique(x), order) == minhash.one_permutation(np.unique(y), order)).mean())
        j = (n - n // 9) / (n + n // 9)
        assert abs(np.mean(hits) - j) < 0.04


def test_toxicity(spark, odd, empty):
    rows, labels = [], []
    for i in range(400):
        r = random.Random(i)
        bad = i % 4 == 0
        words = [r.choice(EN.split()) for _ in range(30)] + (["gromp", "group"] if bad else [r.choice(["gromp", "group", "tree"])])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, None if i % 10 == 9 else int(bad), "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, lab)
    got = [(r.doc_id % 4 == 0, r.predicted) for r in toxicity.score(docs, model).where(langid.held_out(F.col("doc_id"))).collect()]
    assert len(got) > 50 and np.mean([a == bool(b) for a, b in got]) > 0.95  # neither word alone is toxic: the pair is
    found = toxicity.score(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert toxicity.score(empty, model).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(odd, toxicity.fit(empty, lab.limit(0))).collect())


def test_head_without_an_end_tag():
    html = "<html><head><title>T</title><body><article><p>Body text here</p></article></body></html>"
    assert html_text.main_text(html_text.parse(html)) == "Body text here"
    assert html_text.main_text(html_text.parse("<head><meta charset=x><p>One<p>Two")) == "One\nTwo"
    assert html_text.main_text(html_text.parse("<html><head><title>T</title>Loose text<script>x</script> goes on")) == "Loose text goes on"


def test_odd_markup_takes_time_in_proportion():
    import time

    shapes = {
        "quote left open": lambda n: '<div x="' + ">" * n + "<a " * n,
        "stray ends": lambda n: "<b>" * n + "</i>" * n + "text",
        "stray ends in a block": lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
        "void blocks": lambda n: "<b>" * n + "<hr>" * n,
        "items deep down": lambda n: "<li><ul>" + "<div>" * n + "<li></li>" * n,
        "quotes of two kinds": lambda n: "<a '\"> " * n + "<b \"'>" * n + "'",
        "raw without an end": lambda n: "<script>" * n,
        "comments without an end": lambda n: "<!--" * n + "<!" * n,
    }

    def seconds(page):
        t = time.process_time()
        html_text.main_text(html_text.parse(page))
        return time.process_time() - t

    for name, shape in shapes.items():
        seconds(shape(2_000))
        few, many = seconds(shape(5_000)), seconds(shape(40_000))
        assert many < max(0.5, 24 * few), (name, few, many)


def test_prose_stays_whatever_word_its_class_has():
    story = "This is a sentence of the story that goes on for a while and has no links at all."
    body = f"<p class='text share'>{story} 1</p><div class='related'><p>{story} 2</p></div><div class='widget body'>{story} 3</div>"
    gone = "<div class='related'>Read <a href=a>another story of ours</a> <a href=b>and one more of them</a></div><div class='social'>Share</div><div class=comments><p>A reader said so at length, in prose of their own.</p></div>"
    root = html_text.parse(f"<article data-class='ad'>{body}{gone}</article>")
    assert html_text.main_text(root) == f"{story} 1\n{story} 2\n{story} 3"
    widget = next(x for x in html_text._walk(root, lambda _: False) if "widget" in x.marks)
    assert widget.hash in html_text.candidates(root) and html_text.main_text(root, {widget.hash}) == f"{story} 1\n{story} 2"


def test_templates_against_a_plain_count(spark):
    """Subtrees of a small site, counted by their own markup with the standard parser."""
    from collections import Counter, defaultdict
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.found = [], set()

        def handle_starttag(self, tag, attrs):
            self.stack.append([f"<{tag} {sorted(attrs)}>"])

        def handle_data(self, data):
            if self.stack:
                self.stack[-1].append(data)

        def handle_endtag(self, tag):
            own = "".join(self.stack.pop()) + f"</{tag}>"
            if tag in ("div", "section", "ul", "li", "p"):
                self.found.add(own)
            if self.stack:
                self.stack[-1].append(own)

    r = random.Random(4)
    pool = [f"<section><p>Block {k} of the site</p><ul><li>a{k}</li><li>b{k % 3}</li></ul></section>" for k in range(12)]
    rows = []
    for i in range(120):
        host = "ab"[i % 3 == 0]
        inner = "".join(r.sample(pool, 3)) + f"<div><p>Story {i} is of its own</p></div>"
        rows.append((i, f"http://{host}.example/{i}", f"<html><body>{inner}</body></html>"))
    counts, pages = defaultdict(Counter), Counter()
    for _, url, text in rows:
        parser = Blocks()
        parser.feed(text)
        host = url.split("/")[2]
        pages[host] += 1
        counts[host].update(parser.found)
    want = {h: sum(n >= 5 and (n >= 0.1 * pages[h] or n >= 50) for n in c.values()) for h, c in counts.items()}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = html_text.templates(html_text.subtrees(df)).join(df.select(html_text.host_of(F.col("url")).alias("host"), html_text.host_key_of(F.col("url"))).distinct(), "host_key")
    assert {x["host"]: x["count"] for x in known.groupBy("host").count().collect()} == want
    got = {x.page_id: x.text for x in html_text.extract(df).collect()}
    assert all(got[i].endswith(f"Story {i} is of its own") for i in got)


PROSE = " ".join(f"Sentence {w} of this article says something at length about the matter in hand." for w in "one two three four five six seven eight nine ten".split())


@pytest.mark.parametrize("body", ["<div id='page' class='has-sidebar'>{}</div>", "<div class='content no-comments'>{}</div>", "<article><div class='entry comments-open'>{}</div></article>", "<div class='ad-free'>{}</div>", "<div class='menu'>{}</div>", "<div class='banner'>{}</div>"])
def test_no_article_is_lost_to_a_class_word(body):
    assert html_text.main_text(html_text.parse(page(body.format(f"<p>{PROSE}</p>")))) == PROSE


@pytest.mark.parametrize("mark", ["comments", "comment-list", "post-comments", "ad-box-2", "cookie-banner", "reader comments", "sidebar left", "site notice"])
def test_marked_elements_go_beside_prose(mark):
    said = "I read this and found it good, said a reader of ours who goes on for some time about it. " * 12
    text = html_text.main_text(html_text.parse(page(f"<div class='story'><p>{PROSE}</p></div><div class='{mark}'><p>{said}</p></div>")))
    assert text == PROSE
    assert html_text.main_text(html_text.parse(page(f"<article><p>{PROSE}</p><div class='{mark}'><p>{said}</p></div></article>"))) == PROSE


@pytest.mark.parametrize("body", ["<div class='post'><p>{}</p></div>", "<article><div class='body'><p>{}</p></div></article>"])
@pytest.mark.parametrize("copies", [4, 5, 50])
def test_copies_and_captures_of_a_page_stay(spark, body, copies):
    rows = [(i, "http://h.example/a", page(body.format(PROSE))) for i in range(copies)]
    rows += [(100 + i, f"http://copy.example/{i}", page(body.format(PROSE))) for i in range(copies)]
    rows += [(200 + i, "http://c.example/a", page(body.format(f"{PROSE} Read {i} times."))) for i in range(5)]
    rows += [(300 + i, f"http://d.example/{i}", page(body.format(f"{PROSE} Read {i} times."))) for i in range(5)]
    rows += [(400 + i, "http://e.example/a", page(body.format(f"{PROSE}</p><p>Version {'abcdefgh'[i] * 9} of it."))) for i in range(6)]
    rows += [(500 + i, None, page(body.format(PROSE))) for i in range(copies)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(t.startswith(PROSE) for t in got.values())
    assert got[203] == f"{PROSE} Read 3 times." and got[402] == f"{PROSE}\nVersion {'c' * 9} of it."


def test_references_are_read_in_each_text_alone():
    assert html_text.main_text(html_text.parse("<p>&<b>lt;</b> &amp;lt; &lt;b&gt; &#233;</p>")) == "&lt; &lt; <b> é"


def test_all_articles_of_a_page_stay():
    one, two = PROSE, PROSE.replace("article", "second piece")
    text = html_text.main_text(html_text.parse(page(f"<article><p>{one}</p><article class='comment'><p>So it is</p></article></article><article><p>{two}</p></article>")))
    assert text == f"{one}\n{two}"


def test_text_of_a_site_with_known_articles(spark):
    """A generated site: the text of every page is its article, whatever stands around it."""
    r, rows, want = random.Random(9), [], {}
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    menu = "<div class='top'><ul>" + "".join(f"<li><a href=/{k}>Part {k}</a></li>" for k in range(6)) + "</ul></div>"
    foot, side = "<div class='low'><p>All rights are with the owners of this site since long ago.</p></div>", "<div class='box'><h3>About us</h3><p>We are a small paper from a small town by the sea.</p></div>"
    for i in range(60):
        parts = [" ".join(r.choice(words) for _ in range(r.randrange(12, 60))) for _ in range(r.randrange(1, 6))]
        if i % 4 == 0:
            parts.append("Terms may change without word.")  # a line that many articles share
        body = "".join(f"<p>{p}</p>" for p in parts)
        body = f"<article>{body}</article>" if i % 2 == 0 else f"<div class='has-sidebar story'>{body}</div>"
        if i % 4 == 0:
            assert body.startswith("<article>")
        ad = f"<div class='ad'>Buy {' '.join(r.choice(words) for _ in range(15))}</div>"
        talk = "<div class='comments'>" + "".join(f"<p>{' '.join(r.choice(words) for _ in range(20))}</p>" for _ in range(i % 3)) + "</div>"
        rows.append((i, f"http://paper.example/{i}", page(f"{menu}{side if i % 3 else ''}{body}{ad}{talk}{foot}")))
        want[i] = "\n".join(parts)
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
