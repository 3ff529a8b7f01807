import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import distinctive, languages, leaks, nearcopies, packing, subjects
from weftline.llm.sentences import sentences_of


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).withColumn("h", F.lit(1)).withColumn("term", F.lit("z"))


def base(seed, n=60):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = {}
    for g in range(12):
        b = base(g, 80)
        for c in range(4):
            t = list(b)
            for at in rng.choice(len(t), rng.integers(0, 8), replace=False):
                t[at] = f"x{rng.integers(9999)}"
            texts[len(texts)] = " ".join(t)
    texts[100], texts[101] = texts[0], texts[0].upper()
    texts[102], texts[103], texts[104] = None, "", "short text"
    sets = {i: {tuple(t.lower().split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in texts.items() if t and len(t.split()) >= 25}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    member, links = nearcopies.similar_sets(frame(spark, list(texts.items())), "doc_id", "text", shingle=3, num=1, den=2, min_words=25)
    got = {(r.a, r.b) for r in nearcopies.similar_pairs(member, links, "a", "b").collect()}
    assert got == want and (0, 100) in got


def test_groups_cover_every_row(spark):
    t = " ".join(base(1))
    rows = [(1, t), (2, t), (3, t + " more"), (4, None), (5, ""), (6, "alone"), (None, "x")]
    got = {r.doc_id: (r.group_id, r.n_links, r.n_copies) for r in nearcopies.similar_groups(frame(spark, rows), "doc_id", "text").collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (1, 1, 1), 4: (4, 0, 1), 5: (5, 0, 1), 6: (6, 0, 1)}
    assert nearcopies.similar_groups(frame(spark, []), "doc_id", "text").count() == 0


def test_equal_texts_shorter_than_a_shingle_are_copies(spark):
    long = " ".join(base(1))
    rows = [(1, "alone"), (2, "Alone"), (3, "two words"), (4, long), (5, "two words"), (6, "words two"), (7, "two words"), (8, "a b c d"), (9, "a b c d e"), (10, ""), (11, long), (12, "a b c d")]
    got = {r.doc_id: (r.group_id, r.n_copies) for r in nearcopies.similar_groups(frame(spark, rows), "doc_id", "text").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 3), 5: (3, 3), 7: (3, 3), 6: (6, 1), 4: (4, 2), 11: (4, 2), 8: (8, 2), 12: (8, 2), 9: (9, 1), 10: (10, 1)}


def test_covering_guarantee():
    width = 7
    odd = np.array([[bin((v + 1) & (i + 1)).count("1") & 1 for i in range(width)] for v in range(width)], bool)
    assert (odd.sum(1) == 4).all()
    for i in range(width):
        for j in range(i):
            assert any(not odd[v, i] and not odd[v, j] for v in range(width))


def test_number_of_parts():
    assert nearcopies.parts_for(0.5, 2, 0.0051) == 16 and nearcopies.parts_for(0.8, 2, 0.0005) == 4 and nearcopies.parts_for(1.0, 2, 0.01) == 1


def test_keys_are_not_broadcast(spark):
    """The table of keys has many rows for each record: no estimate may put it into a broadcast."""
    docs = frame(spark, [(i, " ".join(base(i, 40))) for i in range(20)])
    _, links = nearcopies.similar_sets(docs, "doc_id", "text")
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchangeExec", "")
    small = nearcopies.cut(docs)
    assert int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 1 << 40


def test_leaks_with_places(spark):
    item = " ".join(base(5, 30))
    doc = "Before. " + item[:3].upper() + item[3:] + " after"
    docs = frame(spark, [(1, doc), (2, " ".join(item.split()[4:17])), (3, " ".join(item.split()[4:16])), (4, None), (5, ""), (6, "a​ " + "  ".join(item.split()[:13]))])
    items = spark.createDataFrame([(7, item), (8, item), (9, "too short"), (10, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.leaked_items(docs, items).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 6) for i in (7, 8)}
    r = got[(1, 7)]
    assert r.n_words == 30 and doc[r.begin_char : r.end_char].lower() == item
    assert leaks.leaked_items(docs.limit(0), items).count() == 0
    assert leaks.leaked_items(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at most 10"):
        leaks.leaked_items(docs, items, most_chars=10)


@pytest.mark.parametrize("run", [1, 4, 5])
def test_leaks_against_brute_force(spark, run):
    rng = np.random.default_rng(run)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], n)) for n in rng.integers(0, 14, 60)]
    docs, items = list(enumerate(texts[:40])), list(enumerate(texts[40:]))
    runs = lambda t: {tuple(t.split()[j : j + run]) for j in range(len(t.split()) - run + 1)}
    want = {(i, j) for i, t in docs for j, x in items if runs(t) & runs(x)}
    found = leaks.leaked_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), run=run)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_distinctive_terms_against_plain_em(spark):
    rows = [(1, "the cat the cat sat"), (2, "the dog and the cat"), (3, "the the the"), (4, None), (5, "a 1 b"), (6, "the cat the cat sat")]
    got = {(r.doc_id, r.t): (r.tf, r.df, r.score) for r in distinctive.distinctive_terms(frame(spark, rows), ["doc_id"]).withColumnRenamed("term", "t").collect()}
    counts = {i: {w: t.split().count(w) for w in t.split() if len(w) > 2} for i, t in rows if t and i != 5}
    total = sum(sum(c.values()) for c in counts.values())
    bg = {}
    for c in counts.values():
        for w, n in c.items():
            bg[w] = bg.get(w, 0) + n / total
    for i, c in counts.items():
        p = {w: n / sum(c.values()) for w, n in c.items()}
        for _ in range(distinctive.MAX_ROUNDS):
            e = {w: n * 0.1 * p[w] / (0.1 * p[w] + 0.9 * bg[w]) for w, n in c.items()}
            q = {w: x / sum(e.values()) for w, x in e.items()}
            done = max(abs(q[w] - p[w]) for w in p) < 1e-9
            p = q
            if done:
                break
        for w in c:
            assert got[(i, w)][0] == c[w] and abs(got[(i, w)][2] - p[w]) < 1e-3
    assert len(got) == sum(map(len, counts.values())) and got[(1, "sat")][1] == 2


def test_sentences():
    s = sentences_of(pa.array(["One here. Two there! http://a.b/c @x #y &amp; three", None, "", "..."]))
    cut = ["".join(map(chr, s.cp[a:b])).strip() for a, b in zip(s.begin, s.end, strict=True)]
    assert cut == ["one here.", "two there!", "three"] and s.off.tolist() == [0, 3, 3, 3, 3]


EN = ["the house of my friend is on the hill", "we think that nothing will change this year", "who wants to read the long letter again", "there was a small boat near the shore"]
DE = ["das haus von meinem freund steht auf dem berg", "wir glauben dass sich dieses jahr nichts ändert", "wer will den langen brief noch einmal lesen", "am ufer lag ein kleines boot und wartete"]


def corpus(k=60):
    rng = np.random.default_rng(0)
    out = []
    for i in range(k):
        src, lab = (EN, "en") if i % 2 else (DE, "German")
        out.append((i, ". ".join(rng.choice(src, 3)) + ".", "de" if i % 13 == 0 and i % 2 else lab))
    return out


def test_languages_held_out_and_mixed(spark):
    extra = [(100, "the friend will read this letter on the boat. nothing is small near the hill.", None), (101, "dieser freund liest den kleinen brief am berg.", "en_US"), (102, EN[0] + ". " + DE[0] + ".", "en"), (103, None, "en"), (104, "ok", "xx"), (105, EN[1] + ".", "English")]
    df = spark.createDataFrame(corpus() + extra, "doc_id long, text string, lang string").withColumn("segments", F.lit(1))
    shares = languages.language_shares(languages.language_segments(df)).cache()
    by = {r.doc_id: [x.lang for x in r.langs] for r in shares.collect()}
    assert by[100] == ["en"] and by[101] == ["de"] and set(by[102]) == {"de", "en"} and by[103] == [] and by[104] == []
    found = {(r.doc_id, r.lang) for r in languages.wrong_languages(shares).collect() if r.doc_id >= 100}
    assert found == {(100, "en"), (101, "de"), (102, "de"), (102, "en")}
    none = df.where("false")
    assert languages.language_segments(none).count() == 0
    # sentences too short by themselves are told together
    few = spark.createDataFrame([(1, "das boot. mein freund liest. ein berg. am ufer.", None), (2, "the hill. my friend. a long letter. the shore.", "de"), (3, "ja. ok.", "en")], df.drop("segments").schema)
    model = languages.fit_languages(df)
    told = {r.doc_id: [(x.lang, x.confidence > 0.5) for x in r.langs] for r in languages.language_shares(languages.language_segments(few, model)).collect()}
    assert told == {1: [("de", True)], 2: [("en", True)], 3: []}


def test_calibrated_rejection_and_confidence():
    rng = np.random.default_rng(0)
    words_ = {0: EN, 1: DE}
    vocab = {k: " ".join(v).split() for k, v in words_.items()}
    texts_ = [" ".join(rng.choice(vocab[i % 2], 9)) + "." for i in range(800)]
    m = languages.fit(texts_, [i % 2 for i in range(800)], 2)
    fresh = [" ".join(rng.choice(vocab[i % 2], 9)) + "." for i in range(400)]
    best, conf, _ = languages.tell(m, sentences_of(pa.array(fresh)))
    assert (best == np.arange(400) % 2).mean() > 0.98 and (best < 0).mean() < 0.02 and conf.min(where=best >= 0, initial=1) > 0.5
    assert m.reliability < 0.1
    other = ["zxq vvk wqx jjy qqz kxv zzw xqj", "мама мыла раму и потом ушла гулять", "łąka żółw śćź ęół ńąś źżć łół óść"]
    assert (languages.tell(m, sentences_of(pa.array(other)))[0] == -1).all()


@pytest.mark.parametrize("raw", ["en", "EN", "en-GB", "eng", " English "])
def test_label_spellings(spark, raw):
    assert spark.createDataFrame([(raw,)], "l string").select(languages.label_language(F.col("l")).alias("x")).first().x == "en"


def test_subjects(spark):
    rng = np.random.default_rng(1)
    nouns = {"law": ["judge", "court", "appeal", "clause"], "food": ["soup", "oven", "bread", "salad"]}
    say = lambda w: rng.choice([f"we tried the {w} again last week", f"my friend says the {w} was quite strange", f"do not buy any {w} from this place"])
    rows, labels = [], []
    for i in range(160):
        s = ["law", "food", None][i % 3]
        words_ = nouns[s] if s else ["friend", "week", "place", "story"]
        rows.append((i, ". ".join(say(rng.choice(words_)) for _ in range(4)) + ".", "en"))
        if i % 2 == 0:
            labels.append((i, s if i % 4 else (s.upper() if s else None)))
    docs = spark.createDataFrame(rows + [(500, None, "en"), (501, "", None)], "doc_id long, text string, lang string")
    model = subjects.fit_subjects(docs, spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([("law",), ("food",)], "subject string"))
    got = {(r.doc_id, r.subject) for r in subjects.accepted(subjects.subject_shares(docs, model)).collect()}
    want = {(i, ["law", "food"][i % 3]) for i in range(160) if i % 3 < 2}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 3


@pytest.mark.parametrize("kind", ["long", "many"])
def test_subjects_are_fitted_on_all_documents(spark, kind):
    """Long documents only, and a subject whose documents come after 5,000 others in an order by hash."""
    rng = np.random.default_rng(2)
    nouns = {"law": ["judge", "court", "appeal", "clause"], "food": ["soup", "oven", "bread", "salad"], None: ["friend", "week", "place", "story"]}
    say = lambda w: rng.choice([f"we tried the {w} again last week", f"my friend says the {w} was quite strange", f"do not buy any {w} from this place"])
    ids = [r.id for r in spark.range(60 if kind == "long" else 5600).orderBy(F.xxhash64("id")).collect()]
    late, size = (20, 120) if kind == "long" else (400, 3)
    of = {i: "food" if at >= len(ids) - late else "law" if at % 2 else None for at, i in enumerate(ids)}
    docs = spark.createDataFrame([(i, ". ".join(say(rng.choice(nouns[x])) for _ in range(size)) + ".", None) for i, x in of.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(list(of.items()), "doc_id long, subject string")
    model = subjects.fit_subjects(docs, labels, spark.createDataFrame([("law",), ("food",)], "subject string"))
    got = {(r.doc_id, r.subject) for r in subjects.accepted(subjects.subject_shares(docs, model)).collect()}
    want = {(i, x) for i, x in of.items() if x}
    food = {w for w in want if w[1] == "food"}
    assert len(got & food) >= 0.95 * len(food) and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_no_documents_of_subjects(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    model = subjects.fit_subjects(docs, none, none.select("subject"))
    assert subjects.accepted(subjects.subject_shares(docs, model)).count() == 0
    named = subjects.fit_subjects(docs.limit(0), none, spark.createDataFrame([("law",)], "subject string"))
    assert subjects.accepted(subjects.subject_shares(docs, named)).count() == 0


def check_packing(rows, capacity, sizes):
    per = {}
    for r in rows:
        per.setdefault(r.container, []).append(r)
    for c in per.values():
        c.sort(key=lambda r: r.place)
        assert [r.place for r in c] == list(range(len(c))) and sum(r.n_tokens for r in c) <= capacity
        at = 0
        for r in c:
            assert r.offset == at
            at += r.n_tokens
    got = {}
    for r in rows:
        got[r.id] = got.get(r.id, 0) + r.n_tokens
        assert r.n_tokens <= capacity and (sizes[r.id] > capacity or r.n_tokens == sizes[r.id])
    assert got == sizes
    return len(per)


@pytest.mark.parametrize("kind", ["mixed", "hot", "empty", "long"])
def test_packing(spark, kind):
    rng = np.random.default_rng(3)
    sizes = {"mixed": rng.integers(0, 150, 400), "hot": np.array([40] * 300 + [17] * 50), "empty": np.array([], int), "long": np.array([1000, 128, 129, 256, 0])}[kind]
    sizes = {i: int(n) for i, n in enumerate(sizes)}
    rows = packing.pack(spark.createDataFrame(list(sizes.items()), "id long, n_tokens int"), 128).collect()
    n = check_packing(rows, 128, sizes)
    if kind == "mixed":
        assert n <= 1.03 * -(-sum(sizes.values()) // 128) + 2


def test_least_squares_and_combinations():
    a, b = np.array([[1.0, 0], [0, 1], [1, 1]]), np.array([1.0, -1, 0.5])
    x = packing.nnls(a, b)
    assert (x >= 0).all() and abs(x[1]) < 1e-9 and abs(x[0] - 0.75) < 1e-9
    assert packing.combinations(4, 3) == [(1, 1, 2), (1, 3), (2, 2), (4,)]
